"""Robots rules and crawl pacing."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmlens.functions import urls
from firmlens.operators import ordered, sequential

SECOND = 1_000_000
HOUR = 3600 * SECOND


def politeness(log: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """Gap to the previous crawl of the same domain against the delay it asks for."""
    seen = ordered.previous_values(log.withColumn("slot", F.floor(F.col("us") / HOUR).cast("long")), keys, ["slot"],
                                   ["us", "event_id"], {"us": "prev_us"})
    gap = (F.col("us") - F.col("prev_us")) / SECOND
    polite = F.col("prev_us").isNull() | (gap >= F.col(delay))
    return seen.withColumns({"gap": gap, "polite": polite,
                             "wait": F.when(polite, 0.0).otherwise(F.col(delay) - gap)}).drop("slot", "prev_us")


def hourly_counts(log: DataFrame, keys: list[str], limit: int = 100, width_us: int = HOUR,
                  chunk_us: int = 24 * HOUR) -> DataFrame:
    """Crawls since the domain's last counter reset; the reset is anchored at a crawl."""
    chunk_us = max(chunk_us, 10 * width_us)
    work = log.withColumn("chunk", F.floor(F.col("us") / chunk_us).cast("long"))
    out = sequential.chunked_scan(work, keys, "chunk", ["us", "event_id"], "us",
                                  sequential.anchored_count_scan(width_us), "hour_count long")
    return out.withColumn("over_limit", F.col("hour_count") > limit).drop("chunk")


def robots_rules(files: DataFrame) -> DataFrame:
    """One row per allow/disallow line of each robots file (``domain``, ``content``), lower-cased.

    A line belongs to the last agent named before it; the lines of a file are gone through once.
    """
    lines = F.transform(F.split(F.lower("content"), "\n"), lambda s: F.trim(s))
    value = F.trim(F.regexp_replace("line", "^[^:]*:", ""))
    along = Window.partitionBy("domain").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)  # a domain has one file
    named = (files.select("domain", F.posexplode(lines).alias("seq", "line"))
             .filter(F.col("line").startswith("user-agent:") | F.col("line").startswith("allow:") | F.col("line").startswith("disallow:"))
             .withColumn("agent", F.last(F.when(F.col("line").startswith("user-agent:"), value), ignorenulls=True).over(along)))
    return named.filter(~F.col("line").startswith("user-agent:")).select(
        "domain", "seq", F.coalesce("agent", F.lit("*")).alias("agent"), F.col("line").startswith("allow:").alias("allowed"), value.alias("path"))


def robots_settings(files: DataFrame, least_delay: float = 1.0) -> DataFrame:
    """Crawl delay (at least ``least_delay``) and sitemap addresses per domain."""
    lines = F.transform(F.split("content", "\n"), lambda s: F.trim(s))
    pick = lambda key: F.transform(F.filter(lines, lambda s: F.lower(s).startswith(key + ":")),
                                   lambda s: F.trim(F.regexp_replace(s, "^[^:]*:", "")))
    delays = F.transform(pick("crawl-delay"), lambda s: F.try_to_number(s, F.lit("999990.999999")).cast("double"))
    return files.select("domain", F.greatest(F.lit(least_delay), F.array_max(delays)).alias("crawl_delay"),
                        pick("sitemap").alias("sitemaps"))


def robots_verdicts(pages: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """Whether each address may be fetched: an allow line wins, then a disallow line.

    A rule holds for the paths that begin with it, so each path is cut to the lengths that the rules of its
    domain have, and the pieces are joined to the rules by equality; rules that do not fit never meet a page.
    Addresses are told apart by (domain, path), once each.
    """
    name = agent.lower()
    path = F.coalesce(F.nullif(urls.path(F.col("url")), F.lit("")), F.lit("/"))
    work = pages.withColumns({"domain": urls.site(F.col("url")), "page_path": F.lower(path)})
    mine = rules.filter(F.col("agent").isin("*", name) & (F.col("allowed") | (F.col("path") != "")))
    lengths = mine.groupBy("domain").agg(F.collect_set(F.length("path")).alias("lengths"))  # at most as many as a path has places
    cut = (work.select("domain", "page_path").distinct().join(lengths, "domain")
           .select("domain", "page_path", F.explode(F.filter("lengths", lambda n: n <= F.length("page_path"))).alias("n"))
           .withColumn("path", F.substring(F.col("page_path"), F.lit(1), F.col("n"))))
    first = lambda allow: F.min(F.when(F.col("allowed") == allow, F.struct("seq", "agent")))
    found = cut.join(mine, ["domain", "path"]).groupBy("domain", "page_path").agg(first(True).alias("yes"), first(False).alias("no"))
    known = rules.filter(F.col("agent").isin("*", name)).select("domain").distinct().withColumn("has_rules", F.lit(True))
    joined = work.join(known, "domain", "left").join(found, ["domain", "page_path"], "left")
    yes, no = F.col("yes"), F.col("no")
    return joined.select(
        *pages.columns, "domain", (yes.isNotNull() | no.isNull()).alias("can_fetch"),
        F.when(F.col("has_rules").isNull(), "no robots file")
        .when(yes.isNotNull(), F.concat(F.lit("allowed for "), yes["agent"]))
        .when(no.isNotNull(), F.concat(F.lit("disallowed for "), no["agent"]))
        .otherwise("no matching rule").alias("reason"))


def block_windows(log: DataFrame, status: Column) -> DataFrame:
    """Blocks a failed crawl starts: a day after 429/503, an hour after 401/403."""
    hours = F.when(status.isin(429, 503), 24).when(status.isin(401, 403), 1)
    return (log.withColumn("hours", hours).filter("hours is not null")
            .withColumn("until_us", F.col("us") + F.col("hours") * HOUR))


def outside_blocks(log: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the log that fall into no block of their key (block start excluded, end excluded).

    The latest end of the blocks that began before a row is carried along the key's line of blocks and rows.
    """
    marks = blocks.select(*keys, F.col("us").alias("at"), "until_us").withColumn("row", F.lit(False))
    rows = log.withColumn("at", F.col("us")).withColumn("until_us", F.lit(None).cast("long")).withColumn("row", F.lit(True))
    both = ordered.largest_so_far(rows.unionByName(marks, allowMissingColumns=True), keys, "at", "until_us", "blocked_to", before=True)
    return both.filter("row").filter(F.col("blocked_to").isNull() | (F.col("blocked_to") <= F.col("at"))).select(*log.columns)
