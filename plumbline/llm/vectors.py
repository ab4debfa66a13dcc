"""What the vector operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(column: str) -> Column:
    """Whether a vector isn't null, empty or zero and has finite components only."""
    v = F.col(column).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def vectors(df: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id (long) and vector (array of double) of ``df``; other columns go."""
    return df.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("vector"))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The rows of a list column of equal lengths, as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
