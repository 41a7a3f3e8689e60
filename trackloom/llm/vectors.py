"""Vector columns: which rows count, and their integers as numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def finite(vector: Column) -> Column:
    """Whether a vector is there and holds neither nulls nor NaN nor infinities."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return F.coalesce(vector.isNotNull() & whole, F.lit(False))


def sound(df: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """The rows whose vector is finite and as long as most of these are (of equally common lengths the longest),
    and that length.  Empty vectors never count; 0 stands for no row at all.

    Elements that are neither float nor double become double.
    """
    kind = df.schema[vector].dataType.elementType
    if not isinstance(kind, (T.FloatType, T.DoubleType)):
        df = df.withColumn(vector, F.col(vector).cast("array<double>"))
    kept = df.filter(finite(F.col(vector)) & (F.size(vector) > 0))
    usual = kept.groupBy(F.size(vector).alias("long")).count().orderBy(F.desc("count"), F.desc("long")).limit(1).collect()
    if not usual:
        return kept, 0
    return kept.filter(F.size(vector) == usual[0]["long"]), usual[0]["long"]


def floored(column: pa.Array, dims: int, scale: int, most: int) -> np.ndarray:
    """floor(scale * x) of an Arrow column of vectors as int64, rows by dims, held within -most and most."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    with np.errstate(over="ignore"):
        values *= scale
    return np.clip(np.floor(values, out=values), -most, most).astype(np.int64)
