"""Multi-index hashing: learned rotated binary codes in substrings, probed by pigeonhole, reranked by floats.

Largest inner product becomes nearest direction by one more component, the square root of what a
vector's squared norm lacks to the largest (zero for queries). Rotations are learned on a bounded
sample (iterative quantisation: each rotation brings the projected sample close to its own signs);
every vector is coded by all rotations, 256 bits in 16 substrings.

Index rows and queries are dealt to blocks by hash, each pair of blocks is one task. In a block every
substring has a table from value to rows. If two codes differ in at most 16 * (s + 1) - 1 bits, one
substring differs in at most s (pigeonhole), so probing all values within s bits of each substring of
a query retrieves every code within that radius. The reach grows by further probes, from s = 2, until
it holds ``enough`` codes of the block or all; codes that no probe has reached are not looked at. All
codes within the smallest radius that holds as many are reranked with exact inner products in double precision.

The radius follows the data: near neighbours need few probes. Vectors without structure lie at almost
the same distance from each other; there the probes reach most rows of a block before the radius holds
enough, and the work is that of all pairs, in blocks of bounded size. The README gives figures.

Rows that are null, zero, of another length than most, or that hold null or non-finite components
take no part. Rows with the query's vec_id are never its results; of rows that repeat another
vec_id the best counts. Ties go to the smaller vec_id. Other columns are not read; an empty table
or no queries give an empty result.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from firmlens.llm.registry import query, table
from firmlens.llm.scratch import stored

#: Vectors that rotations are learned on at most, and rotations.
SAMPLE, ROTATIONS = 4000, 4
BITS, SUBSTRING = 256, 16
#: Index rows and queries of a block at most on average.
INDEX_BLOCK, QUERY_BLOCK = 32768, 1024
#: A query's radius grows until it holds so many codes of a block.
ENOUGH = 512


def clean_vectors(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, v): usable vectors as doubles."""
    v = F.col("v")
    usable = vectors.select(F.col(id_column).alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v")).filter(
        "vec_id is not null and v is not null").filter(
        F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    usual = usable.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return usable.filter(F.size("v") == (usual["n"] if usual else 0))


def learn(sample: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Projections of the sample's dimensions to 256 signs, by iterative quantisation from several starts."""
    dim = sample.shape[1]
    _, vectors = np.linalg.eigh(sample.T @ sample)
    axes = vectors[:, ::-1][:, :min(dim, BITS // ROTATIONS)]
    projected = sample @ axes
    made = []
    for seed in range(-(-BITS // axes.shape[1])):
        turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(axes.shape[1],) * 2))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(projected.T @ np.where(projected @ turn >= 0, 1.0, -1.0))
            turn = u @ w
        made.append(axes @ turn)
    return np.concatenate(made, axis=1)[:, :BITS]


def codes_of(directions: np.ndarray, projection: np.ndarray) -> np.ndarray:
    return np.packbits(directions @ projection >= 0, axis=1).view(">u2").astype(np.uint16)


def _lifted(v: np.ndarray, largest: float, as_query: bool) -> np.ndarray:
    """Directions whose angles order like inner products."""
    if as_query:
        return np.pad(v / np.linalg.norm(v, axis=1, keepdims=True), ((0, 0), (0, 1)))
    v = v / largest
    return np.column_stack([v, np.sqrt(np.maximum(0, 1 - (v * v).sum(axis=1)))])


VALUES = 1 << SUBSTRING
#: 16-bit values by their number of ones: what a substring may differ in.
FLIPS = [np.flatnonzero(np.bitwise_count(np.arange(VALUES)) == ones).astype(np.int32) for ones in range(SUBSTRING + 1)]


class Block:
    """Substring tables of the codes of one block."""

    def __init__(self, codes: np.ndarray):
        n, parts = codes.shape
        self.words = np.ascontiguousarray(codes).view(np.uint64)
        order = np.argsort(codes, axis=0, kind="stable")
        self.rows = order.T.ravel().astype(np.int32)  # table after table
        self.starts = np.concatenate([j * n + np.searchsorted(codes[order[:, j], j], np.arange(VALUES + 1)) for j in range(parts)]).astype(np.int32)
        self.tables = np.arange(parts, dtype=np.int32)[:, None] * (VALUES + 1)

    def probed(self, query: np.ndarray, ones: int) -> np.ndarray:
        """Rows whose value in some substring differs from the query's in exactly ``ones`` bits (repeats included)."""
        at = ((query[:, None].astype(np.int32) ^ FLIPS[ones]) + self.tables).ravel()
        first = self.starts.take(at)
        size = self.starts.take(at + 1) - first
        full = np.flatnonzero(size)
        first, size = first[full], size[full]
        return self.rows.take(np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum()))

    def within(self, query: np.ndarray, enough: int, begin: int = 2) -> tuple[np.ndarray, int, int]:
        """Every row within the smallest radius that holds enough codes (or all), that radius, and the rows that probes reached."""
        n = len(self.words)
        word = np.ascontiguousarray(query).view(np.uint64)
        distance = np.full(n, BITS + 1, np.int32)  # beyond any radius until reached
        enough = min(enough, n)
        for s in range(SUBSTRING + 1):
            fresh = np.zeros(n, bool)
            fresh[self.probed(query, s)] = True
            new = np.flatnonzero(fresh & (distance > BITS))
            distance[new] = np.bitwise_count(self.words.take(new, axis=0) ^ word).sum(axis=1)
            if s < begin:
                continue
            found = np.flatnonzero(distance < SUBSTRING * (s + 1))  # all of them, by the pigeonhole
            if len(found) >= enough:
                break
        near = distance[found]
        radius = int(np.partition(near, enough - 1)[enough - 1]) if enough else 0
        return found[near <= radius], radius, int((distance <= BITS).sum())


def _nearest(query_ids: np.ndarray, queries: np.ndarray, query_codes: np.ndarray, ids: np.ndarray, vectors: np.ndarray,
             codes: np.ndarray, k: int, enough: int) -> pd.DataFrame:
    block = Block(codes)
    out = []
    for i, code in enumerate(query_codes):
        rows, _, _ = block.within(code, enough)
        rows = rows[ids[rows] != query_ids[i]]
        score = (vectors[rows] * queries[i]).sum(axis=1)
        # of rows that repeat an id the best counts, and only k ids go on
        best = rows[np.lexsort((ids[rows], -score))]
        best = best[np.sort(np.unique(ids[best], return_index=True)[1])][:k]
        out.append(pd.DataFrame({"query_id": query_ids[i], "vec_id": ids[best], "score": (vectors[best] * queries[i]).sum(axis=1)}))
    return pd.concat(out, ignore_index=True)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, sample: int = SAMPLE, index_block: int = INDEX_BLOCK,
           query_block: int = QUERY_BLOCK, enough: int = ENOUGH) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of ``vectors`` to each of ``queries``, both (vec_id, v)."""
    vectors, queries = stored(vectors, "vectors"), stored(queries, "queries")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    n, largest = vectors.agg(F.count(F.lit(1)), F.max(norm)).first()
    n_queries = queries.count()
    empty = "query_id bigint, rank int, vec_id bigint, score double"
    if not n or not n_queries:
        return vectors.sparkSession.createDataFrame([], empty)
    chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").collect()  # a bounded sample
    projection = learn(_lifted(np.array([r["v"] for r in chosen]), largest, False))

    def coded(as_query: bool):
        def of(batches):
            for frame in batches:
                v = np.array(frame["v"].tolist(), float).reshape(len(frame), -1)
                if len(frame):
                    frame["code"] = [c.tobytes() for c in codes_of(_lifted(v, largest, as_query), projection)]
                    frame["v"] = [x.tobytes() for x in v]
                    yield frame
        return of

    n_blocks, n_groups = -(-n // index_block), -(-n_queries // query_block)
    row_block = F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int")
    query_group = F.pmod(F.xxhash64("vec_id"), F.lit(n_groups)).cast("int")
    ddl = "vec_id bigint, v binary, code binary"
    left = (queries.select("vec_id", "v").mapInPandas(coded(True), ddl).withColumn("g", query_group)
            .withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))))
    right = (vectors.select("vec_id", "v").mapInPandas(coded(False), ddl).withColumn("b", row_block)
             .withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1)))))

    def pair(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})

        def array(column, kind):
            return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)

        return _nearest(q["vec_id"].to_numpy(), array(q["v"], float), array(q["code"], np.uint16), x["vec_id"].to_numpy(), array(x["v"], float),
                        array(x["code"], np.uint16), k, enough)

    best = (left.groupBy("g", "b").cogroup(right.groupBy("g", "b")).applyInPandas(pair, "query_id bigint, vec_id bigint, score double")
            .groupBy("query_id", "vec_id").agg(F.max("score").alias("score")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@query("op10_multi_index_hashing")
def op10_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = clean_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return search(vectors, vectors.filter("vec_id % 20 = 0"))
