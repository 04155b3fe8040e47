"""Batches of companies: clean-up, order, progress, outcome, export, re-runs."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlens.operators import ordered


def distinct_names(items: DataFrame, batch: str, name: str, pos: str) -> DataFrame:
    """Each company of a batch once: first spelling and first position."""
    return (items.groupBy(batch, F.lower(F.trim(name)).alias("name_key"))
            .agg(F.min_by(F.trim(name), pos).alias(name), F.min(pos).alias(pos)).drop("name_key"))


def priority_rank(priority: Column) -> Column:
    return F.when(priority == "urgent", 1).when(priority == "high", 2).when(priority == "low", 4).otherwise(3)


def backlog_order(items: DataFrame) -> DataFrame:
    """Global processing order: priority, then age, then position."""
    work = items.withColumn("prio", priority_rank(F.col("priority")))
    return ordered.totals_along(work, [], ["prio", "created_us", "pos"], {"queue_pos": F.lit(1).cast("long")}).drop("prio")


def submit_chunks(items: DataFrame, key: str, pos: str, size: int = 20, block: int = 65_536) -> DataFrame:
    """Number of the submit call each item of a list goes into."""
    numbered = ordered.row_numbers(items.withColumn("block", F.floor(F.col(pos) / block).cast("long")), [key], [["block"]], [pos], "rn")
    return numbered.withColumn("chunk", F.ceil(F.col("rn") / size)).drop("block", "rn")


def summaries(items: DataFrame, batch: str) -> DataFrame:
    """Totals, success rate, averages and how many results carry contacts, profiles, people."""
    ok, n = F.col("success"), F.count(F.lit(1))
    good = F.count_if(ok)
    out = items.groupBy(batch).agg(
        n.alias("total_companies"), good.alias("successful"), (good / n * 100).alias("success_rate"),
        F.avg(F.when(ok, F.col("confidence"))).alias("avg_confidence"), F.avg("seconds").alias("avg_seconds"),
        F.count_if(ok & F.col("has_contact")).alias("with_contact"), F.count_if(ok & (F.col("n_social") > 0)).alias("with_social"),
        F.count_if(ok & (F.col("n_people") > 0)).alias("with_people"))
    some = lambda c: F.when(F.col("successful") > 0, F.col(c))
    return out.withColumns({c: some(c) for c in ("avg_confidence", "avg_seconds", "with_contact", "with_social", "with_people")}).withColumn(
        "status", F.when(F.col("successful") == F.col("total_companies"), "completed").when(F.col("successful") > 0, "partially_completed")
        .otherwise("failed"))


def distributions(items: DataFrame, batch: str, fields: list[str]) -> DataFrame:
    """Number of successful results per value of each field."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields]))
    return (items.filter("success").select(batch, pairs.alias("p")).filter("p.value is not null")
            .groupBy(batch, "p.field", "p.value").agg(F.count(F.lit(1)).alias("n")))


def service_statistics(batch_summaries: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    count = lambda s: F.count_if(F.col("status") == s)
    return batch_summaries.agg(
        n.alias("total_batches"), count("completed").alias("completed"), count("partially_completed").alias("partially_completed"),
        count("failed").alias("failed"), (count("completed") / F.greatest(n, F.lit(1)) * 100).alias("success_rate"))


def progress(items: DataFrame, batch: str) -> DataFrame:
    """State of the batch after each finished item, with the expected seconds left."""
    run = ordered.totals_along(items.select(batch, "pos", "created_us", "success", "seconds"), [batch], ["created_us", "pos"], {
        "done": F.lit(1).cast("long"), "failed": F.when(F.col("success"), 0).otherwise(1).cast("long"),
        "elapsed": F.round(F.col("seconds") * 100000).cast("long")})
    total = items.groupBy(batch).agg(F.count(F.lit(1)).alias("total"))
    avg = F.col("elapsed") / 100000 / F.col("done")
    return run.join(total, batch).select(
        batch, "pos", "total", "done", "failed", ((F.col("done") - F.col("failed")) / F.col("done") * 100).alias("success_rate"),
        avg.alias("avg_seconds"), F.when(F.col("done") < F.col("total"), avg * (F.col("total") - F.col("done"))).alias("seconds_left"))


def extraction_statistics(items: DataFrame, keys: list[str]) -> DataFrame:
    ok, n = F.col("success"), F.count(F.lit(1))
    rate = F.count_if(ok) / n
    return items.groupBy(*keys).agg(
        n.alias("requests"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"),
        F.avg(F.when(ok, F.col("seconds"))).alias("avg_seconds"), F.avg(F.when(ok, F.col("confidence"))).alias("avg_confidence"),
        F.countDistinct(F.when(ok, F.lower("company"))).alias("companies"), F.round(rate, 3).alias("success_rate"),
        F.round(1 - rate, 3).alias("failure_rate"))


def export_rows(items: DataFrame) -> DataFrame:
    """Flat sheet row per company; missing text becomes empty, numbers of failed rows zero."""
    text = lambda c: F.coalesce(F.when(F.col("success"), F.col(c)), F.lit(""))
    num = lambda c, z: F.when(F.col("success"), F.col(c)).otherwise(F.lit(z))
    return items.select(
        F.col("company").alias("Company Name"), F.col("success").alias("Success"), F.col("seconds").alias("Processing Time (s)"),
        text("description").alias("Description"), text("industry").alias("Industry"), F.when(F.col("success"), F.col("founded_year")).alias("Founded Year"),
        F.when(F.col("success"), F.col("employees")).alias("Employee Count"), text("company_size").alias("Company Size"),
        text("email").alias("Email"), text("phone").alias("Phone"), text("address").alias("Address"), text("city").alias("City"),
        text("country").alias("Country"), num("n_social", 0).alias("Social Media Count"), num("n_people", 0).alias("Key Personnel Count"),
        num("confidence", 0.0).alias("Confidence Score"), num("quality", 0.0).alias("Data Quality Score"),
        num("completeness", 0.0).alias("Completeness Score"),
        F.array_join(F.transform("errors", lambda e: e["error_message"]), "; ").alias("Errors"), F.array_join("warnings", "; ").alias("Warnings"))


def rerun_requests(requests: DataFrame, failures: DataFrame) -> DataFrame:
    """Changed requests to try again after a failure (``request_id``, ``failure_class``)."""
    c, k = F.col, F.col("failure_class")
    late, poor, gone = k == "timeout", k == "data_quality", k == "not_found"
    bare = F.array(c("company_name"),
                   F.regexp_replace(F.regexp_replace(F.regexp_replace("company_name", " Inc", ""), " LLC", ""), " Corp", ""),
                   F.regexp_replace(F.regexp_replace("company_name", " Company", ""), r" Co\.", ""))
    joined = requests.join(failures, "request_id").filter(late | poor | gone | (k == "rate_limit"))
    changed = joined.withColumns({
        "timeout_seconds": F.when(late, F.greatest(c("timeout_seconds") * 0.7, F.lit(10.0))).otherwise(c("timeout_seconds").cast("double")),
        "max_pages_to_crawl": F.when(late, F.greatest(F.floor(c("max_pages_to_crawl") / 2).cast("int"), F.lit(1)))
        .when(poor, F.least(c("max_pages_to_crawl") + 2, F.lit(10))).otherwise(c("max_pages_to_crawl")),
        "extraction_mode": F.when(late, "basic").when(poor, "comprehensive").otherwise(c("extraction_mode")),
        "include_social_media": poor | c("include_social_media"), "include_key_personnel": poor | c("include_key_personnel"),
        "domain": F.when(~gone, c("domain")),
        "search_name": F.explode(F.when(gone, bare).otherwise(F.array("company_name")))})
    return changed


def with_domain_hint(items: DataFrame, hints: DataFrame, name: str) -> DataFrame:
    """Domain the submitter gave for a company, if any."""
    return items.join(hints, name, "left")
