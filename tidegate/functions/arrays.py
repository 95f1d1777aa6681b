"""Arrow columns of lists as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Lists of one length, at least one of them and none null, as rows of doubles (null as 0), and which numbers are known."""
    flat = lists.flatten()
    known = flat.is_valid().to_numpy(zero_copy_only=False)
    values = (flat.fill_null(0) if flat.null_count else flat).to_numpy(zero_copy_only=False).astype(float)
    return values.reshape(len(lists), -1), known.reshape(len(lists), -1)
