"""Integer vectors for the vector operators: which rows take part, and their packing in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components become floor(SCALE * x).
SCALE = 256
#: Integer vectors per Arrow record batch: 64 components of 8 bytes make 2 MB.
BATCH_ROWS = 4096


def finite(vector: str) -> Column:
    """True for vectors that are not null and hold no null, NaN or infinity."""
    return F.coalesce(F.expr(f"{vector} IS NOT NULL AND forall({vector}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(double(x)) < double('Infinity'))"), F.lit(False))


def scaled(vector: str) -> Column:
    """floor(256 * x) of each component, x as double."""
    return F.expr(f"transform({vector}, x -> CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT))")


def dimension(rows: DataFrame, vector: str) -> tuple[int, int]:
    """The length of all the vectors and the largest magnitude of a component: (0, 0) of an empty table.

    Vectors of more than one length are no embeddings: a ValueError.
    """
    top = F.expr(f"coalesce(array_max(transform({vector}, x -> abs(x))), 0)")
    lo, hi, most = rows.agg(F.min(F.size(vector)), F.max(F.size(vector)), F.max(top)).first()
    if lo != hi:
        raise ValueError(f"vectors of {lo} and of {hi} components in one table")
    return lo or 0, most or 0


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """A list column of n vectors of d integers as an (n, d) array."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), d)
