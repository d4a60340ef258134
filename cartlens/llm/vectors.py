"""Integer vectors from a column of embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column, limit: float) -> Column:
    """True for a vector that is there and whose components are all there,
    finite and smaller than ``limit`` in magnitude (beyond it the integers
    made from them could not be added exactly; such components count as not
    finite)."""
    return vector.isNotNull() & ~F.exists(
        vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) >= F.lit(float(limit))))


def scaled(vector: Column, scale: int, offset: int = 0) -> Column:
    """``floor(scale * c) + offset`` of every component, as longs."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("bigint") + F.lit(offset).cast("bigint"))


def usual_length(vectors: DataFrame, name: str) -> int:
    """The most common length of the vectors, the greater one if two are
    equally common; 0 for an empty table.  One row reaches the driver."""
    sizes = vectors.groupBy(F.size(name).alias("_len")).agg(F.count(F.lit(1)).alias("_n"))
    first = sizes.orderBy(F.desc("_n"), F.desc("_len")).first()
    return int(first["_len"]) if first else 0


def matrix(column: pa.ListArray, length: int) -> np.ndarray:
    """A batch's vectors as the rows of a matrix of 64-bit integers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), length)
