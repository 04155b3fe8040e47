"""Vectors of whole numbers, and exact sums over them, for the operators that code and cluster them."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components of a larger magnitude have no squared distances that fit a long; their rows take no part.
LARGEST = float(1 << 20)


def whole_vectors(vectors: DataFrame, vector_column: str, scale: int, **columns: str) -> DataFrame:
    """``x``, the components times ``scale`` rounded down, beside ``columns`` (new name = column).

    Rows whose vector is null or empty, or holds null or non-finite components, are left out, and so
    are those with a component beyond ``LARGEST``.
    """
    v = F.col("x")
    usable = vectors.select(*[F.col(f"`{c}`").alias(n) for n, c in columns.items()], F.col(f"`{vector_column}`").cast("array<double>").alias("x"))
    return (usable.filter(v.isNotNull() & (F.size(v) > 0))
            .filter(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST)))
            .withColumn("x", F.transform(v, lambda c: F.floor(c * F.lit(float(scale))).cast("int"))))


def matrix(column: pa.Array, width: int, kind=np.int64) -> np.ndarray:
    """An Arrow column of lists of ``width`` numbers as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    width = rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.array(rows.ravel(), kind))


def group_sums(x: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Per group the rows and the sums of their components, exact: (groups, 1 + width)."""
    n = np.bincount(group, minlength=groups)
    sums = [np.bincount(group, weights=x[:, j], minlength=groups) for j in range(x.shape[1])]  # below 2^53 for any batch
    return np.stack([n, *sums], axis=1).astype(np.int64)


def summed(rows: DataFrame, partial: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows of a fixed number of whole figures; each task sends one row per figure.

    ``size`` rows reach the driver, whatever the input's size.
    """
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += partial(batch).ravel()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["slot", "amount"])

    out = np.zeros(size, np.int64)
    for slot, amount in rows.mapInArrow(parts, "slot bigint, amount bigint").groupBy("slot").agg(F.sum("amount")).collect():
        out[slot] = amount
    return out
