"""Vector columns as matrices inside tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SPARSE = 0


def parts(vector: str | Column) -> Column:
    """The stored parts of a vector column, for a function over batches: type, size, indices, values."""
    return F.unwrap_udt(F.col(vector) if isinstance(vector, str) else vector)


def columns_of(vectors: pd.DataFrame, wanted: np.ndarray) -> np.ndarray:
    """The entries at the wanted (sorted) places, a row per vector; what a vector does not store is 0."""
    out = np.zeros((len(vectors), len(wanted)))
    for row, (kind, indices, values) in enumerate(zip(vectors["type"], vectors["indices"], vectors["values"])):
        if kind != SPARSE:
            out[row] = np.asarray(values)[wanted]
            continue
        indices, values = np.asarray(indices, np.int64), np.asarray(values, float)
        at = np.minimum(np.searchsorted(wanted, indices), max(0, len(wanted) - 1))
        if len(wanted) and len(indices):
            met = wanted[at] == indices
            out[row, at[met]] = values[met]
    return out
