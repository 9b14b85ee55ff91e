"""Runs of rows with the same key in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def key_changes(key: pa.RecordBatch) -> np.ndarray:
    """Whether each row but the first has another key than the row before; nulls are equal."""
    found = np.zeros(max(key.num_rows - 1, 0), bool)
    for c in key.columns:
        a, b = c.slice(0, len(found)), c.slice(1)
        differ = pc.if_else(pc.or_(a.is_null(), b.is_null()), pc.not_equal(a.is_null(), b.is_null()), pc.not_equal(a, b))
        found |= differ.to_numpy(zero_copy_only=False).astype(bool)
    return found
