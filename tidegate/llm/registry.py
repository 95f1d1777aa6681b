"""The queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidegate.llm import alignment, chat, decontamination, fingerprints, licenses, periodic, privacy, quality, secrets, sentencepieces, sharding, simhash, substrings

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_sentencepiece_trie": sentencepieces.query,
        "op2_shard_tree": sharding.query,
        "op3_merkle_fingerprints": fingerprints.query,
        "op4_prefix_suffix_trees": substrings.query,
        "op5_simhash_bktree": simhash.query,
        "op6_perspective_rotation": chat.query,
        "op7_secret_novelty": secrets.query,
        "op8_disclosure_sanitiser": privacy.query,
        "op9_simhash_windows": decontamination.query,
        "op10_quality_trees": quality.query,
        "op11_synchronising_runs": periodic.query,
        "op12_fuzzy_notices": licenses.query,
        "op13_token_alignment": alignment.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_shard_tree": sharding.sql(),
        "op3_merkle_fingerprints": fingerprints.sql(),
        "op4_prefix_suffix_trees": substrings.sql(),
        "op6_perspective_rotation": chat.sql(),
    }
