"""All registered queries outside of the text operators: name -> (query, SQL or None)."""

from __future__ import annotations

from tidegate.plans import admission, evaluation, federated, fits, grids, learning, record, scenarios, studies

QUERIES = {**admission.QUERIES, **record.QUERIES, **federated.QUERIES, **evaluation.QUERIES, **learning.QUERIES, **studies.QUERIES, **scenarios.QUERIES, **grids.QUERIES, **fits.QUERIES}
