"""Exact ordered computations whose tasks stay small when one key is hot.

A plain ``Window.partitionBy(key).orderBy(...)`` puts every row of a key in one
task. The helpers here take *bucket* columns that grow with the sort order
(a page number, a ten-minute slot, a block of ids). The heavy window then runs
per (key, bucket); only one summary row per bucket is ordered per key.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmlens.operators.durable import stored


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join in which null keys meet null keys; keeps the left key columns."""
    tmp = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys],
                       *[c for c in right.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(tmp[f"__r_{k}"]) for k in keys])
    return left.join(tmp, cond, how).drop(*[f"__r_{k}" for k in keys])


def running_totals(df: DataFrame, keys: list[str], levels: list[list[str]],
                   order: list, totals: dict[str, Column]) -> DataFrame:
    """Add inclusive running sums of ``totals`` per ``keys`` in ``order``.

    ``levels`` lists bucket columns from coarse to fine; the order must sort by
    them first. With no keys the coarsest level is the only global ordering, so
    it must have few distinct values.
    """
    flat = [c for lvl in levels for c in lvl]
    parts = {n: f"__part_{n}" for n in totals}
    work = df.select("*", *[e.alias(parts[n]) for n, e in totals.items()])
    finest = work.groupBy(*keys, *flat).agg(*[F.sum(p).alias(p) for p in parts.values()])
    offsets = None
    for depth in range(len(levels), 0, -1):
        group = keys + [c for lvl in levels[:depth - 1] for c in lvl]
        own = levels[depth - 1]
        at = finest if depth == len(levels) else (
            finest.groupBy(*group, *own).agg(*[F.sum(p).alias(p) for p in parts.values()]))
        before = (Window.partitionBy(*group).orderBy(*own)
                  .rowsBetween(Window.unboundedPreceding, -1))
        level = at.select(*group, *own, *[
            F.coalesce(F.sum(p).over(before), F.lit(0)).alias(f"__off{depth}_{n}")
            for n, p in parts.items()])
        offsets = level if offsets is None else join_null_safe(offsets, level, group + own)
    inside = (Window.partitionBy(*keys, *flat).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, 0))
    out = join_null_safe(work, offsets, keys + flat)
    sums = {}
    for n, p in parts.items():
        total = F.sum(p).over(inside)
        for depth in range(1, len(levels) + 1):
            total = total + F.col(f"__off{depth}_{n}")
        sums[n] = total
    out = out.withColumns(sums)
    return out.select(*df.columns, *totals)


def dealt(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """``df`` in parts by ranges of (keys, order), stored, with the part's number ``__part``.

    Bounds come from a sample, so a key that holds most rows, or most rows of one hour, is spread over many parts;
    rows that are equal in keys and order share a part. Numbers grow along the order.
    """
    return stored(df.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()), "dealt")


def totals_along(df: DataFrame, keys: list[str], order: list, totals: dict[str, Column]) -> DataFrame:
    """Inclusive running sums of ``totals`` per ``keys`` in ``order``, which must tell rows apart.

    Sums before a part come from one summary row per key and part; only the rows of a part are ordered together.
    """
    rows = dealt(df.select("*", *[e.alias(f"__t_{n}") for n, e in totals.items()]), keys, order)
    sums = rows.groupBy(*keys, "__part").agg(*[F.sum(f"__t_{n}").alias(f"__s_{n}") for n in totals])
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "__part", *[F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in totals])
    inside = Window.partitionBy(*keys, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = join_null_safe(rows, sums, [*keys, "__part"])
    return out.select(*df.columns, *[(F.sum(f"__t_{n}").over(inside) + F.col(f"__b_{n}")).alias(n) for n in totals])


def largest_so_far(df: DataFrame, keys: list[str], at: str, value: str, name: str, before: bool = False) -> DataFrame:
    """Adds the largest ``value`` of the key's rows up to the row's ``at`` (with ``before``: strictly before it)."""
    rows = dealt(df, keys, [at])
    tops = rows.groupBy(*keys, "__part").agg(F.max(value).alias("__top"))
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*keys, "__part", F.max("__top").over(earlier).alias("__carried"))
    inside = Window.partitionBy(*keys, "__part").orderBy(at).rangeBetween(Window.unboundedPreceding, -1 if before else 0)
    out = join_null_safe(rows, tops, [*keys, "__part"])
    return out.select(*df.columns, F.greatest("__carried", F.max(value).over(inside)).alias(name))


def row_numbers(df: DataFrame, keys: list[str], levels: list[list[str]], order: list,
                name: str = "row_num") -> DataFrame:
    return running_totals(df, keys, levels, order, {name: F.lit(1).cast("long")})


def previous_values(df: DataFrame, keys: list[str], bucket: list[str], order: list[str],
                    columns: dict[str, str]) -> DataFrame:
    """Lag by one row per key: ``columns`` maps source column to new column."""
    packed = F.struct(*[F.col(s).alias(d) for s, d in columns.items()])
    last = df.groupBy(*keys, *bucket).agg(
        F.max_by(packed, F.struct(*order)).alias("__last"))
    carried = last.select(*keys, *bucket, F.lag("__last").over(
        Window.partitionBy(*keys).orderBy(*bucket)).alias("__carried"))
    inside = Window.partitionBy(*keys, *bucket).orderBy(*order)
    out = (join_null_safe(df, carried, keys + bucket)
           .withColumn("__prev", F.coalesce(F.lag(packed).over(inside), F.col("__carried"))))
    return out.select(*df.columns, *[F.col(f"__prev.{d}").alias(d) for d in columns.values()])


def trailing_counts(df: DataFrame, keys: list[str], at: str, width: int, name: str = "in_window",
                    include_self: bool = True) -> DataFrame:
    """Rows of the same key whose integer time lies in ``[t - width, t]``.

    Each row is also sent to the next slot of ``width`` as context, so a task
    holds two slots of one key and not the whole key. Rows without a time only meet
    each other, once.
    """
    slot = F.floor(F.col(at) / F.lit(width)).cast("long")
    spread = (df.withColumn("__slot", slot)
              .withColumn("__copy", F.explode(F.when(F.col(at).isNull(), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
              .withColumn("__slot", F.col("__slot") + F.col("__copy")))
    reach = Window.partitionBy(*keys, "__slot").orderBy(at).rangeBetween(-width, 0)
    seen = F.count(F.lit(1)).over(reach)
    return (spread.withColumn(name, seen if include_self else seen - 1)
            .filter("__copy = 0").select(*df.columns, name))


def streaks(df: DataFrame, keys: list[str], levels: list[list[str]], order: list, hit: Column,
            aggs: list[Column], min_length: int) -> DataFrame:
    """Runs of consecutive rows where ``hit`` holds, at least ``min_length`` long."""
    marked = running_totals(df.withColumn("__hit", F.coalesce(hit, F.lit(False))), keys, levels, order,
                            {"streak_id": F.when(F.col("__hit"), 0).otherwise(1).cast("long")})
    return (marked.filter("__hit").groupBy(*keys, "streak_id")
            .agg(F.count(F.lit(1)).alias("streak_length"), *aggs)
            .filter(F.col("streak_length") >= min_length))


def order_statistics(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """Exact k-th smallest values per key, at ranks given as expressions over ``n``.

    Equal values are counted map-side, and the counted values are dealt out by ranges of (key, value)
    whose bounds come from a sample, so a key with most of the values is spread over many parts. That
    table is stored. Prefix counts over the parts of a key find the part that holds a rank, and only
    such parts are sorted, each by itself. The input is read once.
    """
    base = df if keys else df.withColumn("__all", F.lit(0))
    by = keys or ["__all"]
    counted = base.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    values = stored(counted.repartitionByRange(*by, "__v").withColumn("__part", F.spark_partition_id()), "values")
    upto = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)
    parts = values.groupBy(*by, "__part").agg(F.sum("__c").alias("__pc")).withColumns({
        "__to": F.sum("__pc").over(upto), "n": F.sum("__pc").over(Window.partitionBy(*by))})
    wanted = F.array(*[F.struct(F.lit(nm).alias("what"), e.cast("long").alias("rank")) for nm, e in ranks.items()])
    rest = F.col("__w.rank") - F.col("__to") + F.col("__pc")
    targets = (parts.withColumn("__w", F.explode(wanted)).filter((rest > 0) & (F.col("__w.rank") <= F.col("__to")))
               .groupBy(*by, "__part", "n").agg(F.map_from_entries(F.collect_list(F.struct("__w.what", rest))).alias("__ranks")))  # one entry per rank
    along = Window.partitionBy(*by, "__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = join_null_safe(values, targets, [*by, "__part"], "inner").withColumn("__to", F.sum("__c").over(along))

    def pick(name: str) -> Column:
        rank = F.try_element_at("__ranks", F.lit(name))
        return F.max(F.when((rank <= F.col("__to")) & (rank > F.col("__to") - F.col("__c")), F.col("__v"))).alias(name)

    picked = ranked.groupBy(*by).agg(*[pick(nm) for nm in ranks])
    sizes = parts.groupBy(*by).agg(F.max("n").alias("n"))
    out = join_null_safe(sizes, picked, by)
    return out if keys else out.drop("__all")
