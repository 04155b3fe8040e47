"""Cache keys and what a time-limited cache would have answered."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlens.operators import ordered
from firmlens.operators.dimensions import CACHE_SECONDS


def company_key(name: Column, domain: Column, mode: Column) -> Column:
    parts = F.array_compact(F.array(F.lower(F.trim(name)), F.nullif(F.lower(domain), F.lit("")), F.lower(mode)))
    return F.concat(F.lit("company:"), F.md5(F.array_join(parts, "|")))


def search_key(query: Column, country: Column, language: Column, page: Column) -> Column:
    return F.concat(F.lit("serp:"), F.md5(F.concat_ws("|", F.lower(F.trim(query)), F.lower(country), F.lower(language), page.cast("string"))))


def crawl_key(url: Column) -> Column:
    return F.concat(F.lit("crawl:"), F.md5(url))


def batch_key(names: Column, mode: Column) -> Column:
    clean = F.array_sort(F.transform(names, lambda n: F.lower(F.trim(n))))
    return F.concat(F.lit("batch:"), F.md5(F.concat(F.array_join(clean, "|"), F.lit("|"), F.lower(mode))))


def valid_seconds(kind: Column) -> Column:
    out = F.lit(CACHE_SECONDS["default"])
    for name, seconds in CACHE_SECONDS.items():
        if name != "default":
            out = F.when(kind == name, seconds).otherwise(out)
    return out


def cache_answers(lookups: DataFrame, entries: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """Latest entry still valid at each lookup (``us``), or null.

    Lookups and entries lie along one line per key; the latest entry so far is carried over the parts of
    a key, so no task holds the whole history of one.
    """
    span = valid_seconds(F.col(kind)).cast("long") * 1_000_000
    asks = lookups.withColumns({"entry_us": F.lit(None).cast("long"), "asks": F.lit(True)})
    puts = entries.select(*keys, "us").withColumns({"entry_us": F.col("us"), "asks": F.lit(False)})
    both = ordered.largest_so_far(asks.unionByName(puts, allowMissingColumns=True), keys, "us", "entry_us", "cached_us")
    return (both.filter("asks").withColumn("cached_us", F.when(F.col("us") - F.col("cached_us") < span, F.col("cached_us")))
            .withColumn("hit", F.col("cached_us").isNotNull()).select(*lookups.columns, "cached_us", "hit"))
