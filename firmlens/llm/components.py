"""Connected components of a distributed edge table."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.llm.scratch import stored


def components(edges: DataFrame) -> DataFrame:
    """Smallest node that each node reaches: (node, component), for nodes with an edge.

    ``edges`` has long columns a and b; self-loops and repeated edges do no harm, null ends are
    left out. Large-star and small-star steps take turns until no edge changes, which needs about
    log(n) rounds. A step hangs the neighbours of a node on the smallest of them by a minimum per
    node (combined map-side) and a join; both inputs of the join are stored tables, so a node with
    very many neighbours is split by adaptive execution. Edges never gather in one place.
    """
    current = stored(edges.filter("a is not null and b is not null and a <> b")
                     .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
        current = _small_star(_large_star(current))
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked to the smallest node of its surroundings."""
    both = stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both")
    least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
    return stored(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                  .filter("a <> b").distinct(), "edges")


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = stored(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return stored(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
