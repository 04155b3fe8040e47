"""Vector codes of parts by active-entry Lloyd.

Vectors of whole numbers are cut into equal parts, each part position has a codebook. A round
assigns every part to the nearest entry and moves the entries to the means. The code of a part and
its exact distance are stored; in the next round a part whose entry stayed where it was compares
only the entries that moved against that distance: the others were not nearer before and are not
now. A part whose entry moved compares all entries. Ties go to the lower index, in both ways.

Sums per entry are made in each task, so neither a vector that most rows repeat nor a common entry
gathers rows in one place; codebooks are the only thing that reaches the driver.

Left out: rows whose vector is null, empty, holds null or non-finite components or one beyond 2^20 in
magnitude, or differs in length from most vectors (of equally frequent lengths the smaller counts).
Rows without id are coded like others; they start a codebook only where fewer rows have ids.
Rows that repeat an id are rows of their own, ordered by their vectors. Fewer rows than entries:
the codebooks are that much smaller. An empty table gives an empty result. Lengths must be a
multiple of the number of parts (ValueError). Columns other than those named are not read.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlens.llm.registry import query, table
from firmlens.llm.scratch import stored
from firmlens.llm.whole_vectors import group_sums, lists, matrix, summed, whole_vectors

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``a`` to those of ``b``."""
    reach = max(int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0)))
    if 4 * reach * reach * a.shape[1] < 1 << 53:  # every step is a whole number that a double holds
        a, b = a.astype(np.float64), b.astype(np.float64)
    return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (the lower of equals) and its distance."""
    d = distances(x, book)
    at = d.argmin(axis=1)
    return at, d[np.arange(len(x)), at]


def reassign(x: np.ndarray, book: np.ndarray, moved: np.ndarray, code: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``nearest`` of one part position, from the codes and exact distances before the marked entries moved."""
    code, distance = code.copy(), distance.copy()
    lost = moved[code]
    if lost.any():
        code[lost], distance[lost] = nearest(x[lost], book)
    active = np.flatnonzero(moved)
    stay = np.flatnonzero(~lost)
    if len(active) and len(stay):
        at, d = nearest(x[stay], book[active])
        entry = active[at]
        better = (d < distance[stay]) | ((d == distance[stay]) & (entry < code[stay]))
        code[stay[better]], distance[stay[better]] = entry[better], d[better]
    return code, distance


def _assigned(rows: DataFrame, books: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """Rows with code and distance of every part; ``moved`` marks entries that changed since the stored codes."""
    parts, _, width = books.shape

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), parts * width).reshape(-1, parts, width)
            if moved is None:
                found = [nearest(x[:, p], books[p]) for p in range(parts)]
            else:
                code, distance = matrix(batch.column("code"), parts), matrix(batch.column("distance"), parts)
                found = [reassign(x[:, p], books[p], moved[p], code[:, p], distance[:, p]) for p in range(parts)]
            code, distance = (np.stack(f, axis=1) for f in zip(*found))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("x"), lists(code, pa.int16()),
                                              lists(distance, pa.int64())], ["vec_id", "label", "x", "code", "distance"])

    label = dict(rows.dtypes)["label"]
    return rows.mapInArrow(assign, f"vec_id bigint, label {label}, x array<int>, code array<smallint>, distance array<bigint>")


def _means(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The entries at the means of their parts, rounded down; entries without parts stay."""
    parts, entries, width = books.shape

    def partial(batch: pa.RecordBatch) -> np.ndarray:
        x, code = matrix(batch.column("x"), parts * width).reshape(-1, parts, width), matrix(batch.column("code"), parts)
        return np.stack([group_sums(x[:, p], code[:, p], entries) for p in range(parts)])

    total = summed(rows.select("x", "code"), partial, parts * entries * (1 + width)).reshape(parts, entries, 1 + width)
    n = total[..., :1]
    return np.where(n > 0, total[..., 1:] // np.maximum(n, 1), books)


def product_codes(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str | None = None, parts: int = PARTS,
                  entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, distance) per kept vector, arrays by part, and the codebooks (parts, entries, width)."""
    named = {"vec_id": vec_id} | ({"label": label} if label else {})
    kept = whole_vectors(vectors, vector, scale, **named).withColumn("vec_id", F.col("vec_id").cast("bigint"))
    kept = kept if label else kept.withColumn("label", F.lit(None).cast("int"))
    usual = kept.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    width = usual["n"] if usual else parts
    if width % parts:
        raise ValueError(f"vectors of {width} components cannot be cut into {parts} equal parts")
    kept = kept.filter(F.size("x") == width).select("vec_id", "label", "x")
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).select("x").collect()
    books = np.array([r["x"] for r in first], np.int64).reshape(len(first), parts, width // parts).transpose(1, 0, 2)
    if not first:
        empty = kept.select("vec_id", "label", F.array().cast("array<smallint>").alias("code"), F.array().cast("array<bigint>").alias("distance"))
        return empty, books
    state, moved = kept, None
    for _ in range(rounds):
        state = stored(_assigned(state, books, moved), "codes", "zstd")
        new = _means(state, books)
        moved, books = (new != books).any(axis=2), new
    return _assigned(state, books, moved).select("vec_id", "label", "code", "distance"), books


def codebook_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


@query("op11_active_entry_codes")
def op11_active_entry_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = product_codes(table(spark, sf_dir, "embeddings"), label="label")
    digits = F.array_join(F.transform("code", lambda c: F.lpad(F.lower(F.hex(c.cast("bigint"))), 2, "0")), "")
    rows = stored(found.select("vec_id", "label", digits.alias("code"), F.aggregate("distance", F.lit(0).cast("bigint"), lambda a, d: a + d).alias("error")), "coded")
    by_label = rows.groupBy(F.col("label").alias("__label")).agg(F.try_sum("error").alias("label_error"))
    return rows.join(by_label, F.col("label").eqNullSafe(F.col("__label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"))
