"""Centroid clustering with an incremental distance matrix.

Each vector of whole numbers keeps its exact dot products with all centroids. When centroids move,
a product changes only by the vector's components at the places where the centroid changed, times
the change; the squared distance is the vector's square minus twice the product plus the centroid's
square. So the stored products are updated by the nonzero component changes and the nearest centroid
(the lowest number of equals) is looked up anew, exactly as a full computation would.

The means come from sums that each task makes of its rows, so a vector that most rows repeat does not
gather anywhere; only centroids and one figure per centroid reach the driver.

Left out: vectors that are null, have another number of components than asked for, hold null or
non-finite ones or one beyond 2^20 in magnitude. Rows without id come after all others when
centroids are chosen; rows that repeat an id are ordered by their vectors. Fewer rows than centroids:
that many centroids. An empty table gives an empty result. Other columns are not read.
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

WIDTH, CENTROIDS, ROUNDS, SCALE, SEED = 64, 16, 3, 64, 1


def updated(products: np.ndarray, x: np.ndarray, change: np.ndarray) -> np.ndarray:
    """Dot products after the centroids changed by ``change``, from its nonzero components alone."""
    products = products.copy()
    for c in np.flatnonzero(change.any(axis=1)):
        at = np.flatnonzero(change[c])
        products[:, c] += x[:, at] @ change[c, at]
    return products


def nearest(products: np.ndarray, x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid and squared distance from the dot products."""
    d = (x * x).sum(axis=1)[:, None] - 2 * products + (centroids * centroids).sum(axis=1)
    at = d.argmin(axis=1)
    return at, d[np.arange(len(x)), at]


def _assigned(rows: DataFrame, centroids: np.ndarray, change: np.ndarray) -> DataFrame:
    """(vec_id, x, products, cluster, distance); rows without ``products`` have met no centroid yet (all zero)."""
    fresh = "products" not in rows.columns
    n, width = centroids.shape

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), width)
            products = updated(np.zeros((len(x), n), np.int64) if fresh else matrix(batch.column("products"), n), x, change)
            cluster, distance = nearest(products, x, centroids)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), lists(products, pa.int64()), pa.array(cluster, pa.int32()),
                                              pa.array(distance, pa.int64())], ["vec_id", "x", "products", "cluster", "distance"])

    return rows.mapInArrow(assign, "vec_id bigint, x array<int>, products array<bigint>, cluster int, distance bigint")


def cluster(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", width: int = WIDTH, centroids: int = CENTROIDS,
            rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) per kept vector, and the final centroids (number, width)."""
    kept = whole_vectors(vectors, vector, scale, vec_id=vec_id).filter(F.size("x") == width).select(F.col("vec_id").cast("bigint").alias("vec_id"), "x")
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(place.asc_nulls_last(), "x").limit(centroids).select("x").collect()
    now = np.array([r["x"] for r in first], np.int64).reshape(len(first), width)
    if not first:
        return kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")), now
    n = len(now)

    def partial(batch: pa.RecordBatch) -> np.ndarray:
        return group_sums(matrix(batch.column("x"), width), batch.column("cluster").to_numpy(), n)

    state, change = kept, now
    for _ in range(rounds):
        state = stored(_assigned(state, now, change), "products", "zstd")
        total = summed(state.select("x", "cluster"), partial, n * (1 + width)).reshape(n, 1 + width)
        new = np.where(total[:, :1] > 0, total[:, 1:] // np.maximum(total[:, :1], 1), now)
        change, now = new - now, new
        state = state.select("vec_id", "x", "products")
    return _assigned(state, now, change).select("vec_id", "cluster", "distance"), now


@query("op12_incremental_centroids")
def op12_incremental_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = cluster(table(spark, sf_dir, "embeddings"))
    rows = stored(found, "clusters")
    inertia = {r[0]: r[1] for r in rows.groupBy("cluster").agg(F.sum("distance")).collect()}  # one row per centroid
    known = [(c, inertia[c], hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c in sorted(inertia)]
    facts = spark.createDataFrame(known, "cluster int, cluster_inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select(  # at most as many rows as centroids
        "vec_id", "cluster", "distance", "cluster_inertia", F.lit(sum(inertia.values())).cast("bigint").alias("inertia"), "centroid_sha256")
