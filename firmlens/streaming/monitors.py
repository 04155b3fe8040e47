"""Structured Streaming forms of the log analytics.

Input streams carry ``at`` (event time), ``us`` (the same in microseconds) and ``event_id``.
Event time and watermarks decide what is late; the stateful rules judge rows in event-time order (``in_order``).
"""
from __future__ import annotations

import sys
import uuid
from collections.abc import Callable
from contextlib import nullcontext

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmlens.operators import abuse, privacy, sequential, telemetry
from firmlens.operators.durable import shared_folder, stored
from firmlens.operators.ordered import join_null_safe
from firmlens.sources import stored_days
from firmlens.streaming import in_order

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SECOND = 1_000_000
HOUR = 3600 * SECOND


def finished(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all input there is, write it to the shared folder, and read it back."""
    spark: SparkSession = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    done = (stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{folder}/progress")
            .trigger(availableNow=True).start(f"{folder}/rows"))
    done.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def finished_windows(stream: DataFrame, keys: list[str], on_disk: bool = False) -> DataFrame:
    """Run a windowed stream over all input there is; every window with its last state, closed by the watermark or not.

    Each micro-batch writes the windows it changed under its number, so a replay overwrites. With ``on_disk`` the state
    lies in RocksDB, for keys so fine that there are about as many windows as rows.
    """
    spark: SparkSession = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    spark.createDataFrame([], stream.schema).write.parquet(f"{folder}/rows/batch=-1")
    with in_order.state_on_disk(spark) if on_disk else nullcontext():
        done = (stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True)
                .foreachBatch(lambda rows, number: rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")).start())
        done.awaitTermination()
    ids = [*keys, "window_us"]
    values = [c for c in stream.columns if c not in ids]
    rows = spark.read.schema(T.StructType([*stream.schema, T.StructField("batch", T.LongType())])).parquet(f"{folder}/rows")
    return rows.groupBy(*ids).agg(F.max_by(F.struct(*values), "batch").alias("last")).select(*ids, "last.*").select(*stream.columns)


def event_stream(spark: SparkSession, folder: str, schema: str, files: str = "*", files_per_batch: int = 1000) -> DataFrame:
    """Event log files as a stream, with event time in both forms."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", files).parquet(folder)
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return raw.withColumns({"us": us, "at": F.timestamp_micros(us)})


def without_replays(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each event once, even when a sender repeats it within the delay."""
    return stream.withWatermark("at", delay).dropDuplicatesWithinWatermark(["event_id"])


def windowed(stream: DataFrame, keys: list[str], length: str, step: str | None, aggs: list[Column], delay: str = "10 minutes") -> DataFrame:
    """Aggregates per tumbling (``step`` is None) or sliding window."""
    w = F.window("at", length, step) if step else F.window("at", length)
    return (stream.withWatermark("at", delay).groupBy(*keys, w.alias("w")).agg(*aggs)
            .withColumn("window_us", F.unix_micros("w.start")).drop("w"))


def rollups(stream: DataFrame, keys: list[str], value: str, length: str = "1 minute", step: str | None = None) -> DataFrame:
    return windowed(stream, keys, length, step, [F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most")])


def ratios(stream: DataFrame, keys: list[str], part: Column, length: str = "5 minutes", step: str | None = None) -> DataFrame:
    return windowed(stream, keys, length, step, [F.count(F.lit(1)).alias("n"), F.count_if(part).alias("hits")]).withColumn("ratio", F.col("hits") / F.col("n"))


def service_levels(stream: DataFrame, keys: list[str], value: str, target: float, alert: float) -> DataFrame:
    """One-hour level every five minutes, higher values being worse."""
    out = windowed(stream, keys, "1 hour", "5 minutes", [F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")])
    return out.withColumn("status", F.when(F.col("mean") <= target, "meeting").when(F.col("mean") <= alert, "at_risk").otherwise("breach"))


def value_histograms(stream: DataFrame, keys: list[str], value: str, step: str, resolution: float = 0.01, delay: str = "10 minutes") -> DataFrame:
    """Mergeable histogram of the values of each ``step`` of time: rows of ``n`` and ``total`` per cell of width ``resolution``.

    A row is counted once; windows that overlap are put together from these by ``levels_of``.
    """
    cells = stream.withColumn("cell", F.round(F.col(value) / resolution).cast("long"))
    return windowed(cells, [*keys, "cell"], step, None, [F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")], delay)


BLOCK = 256  # cells that are ranked together at first


def levels_of(histograms: DataFrame, keys: list[str], length_us: int, step_us: int, target: float, alert: float, resolution: float = 0.01,
              above: bool = False) -> DataFrame:
    """Samples, mean, nearest-rank p95 and state of windows of ``length_us`` every ``step_us``, whole steps of ``value_histograms``; p95 decides,
    or the mean where high values are good.

    Windows first add up blocks of cells, which are few, and find the block that holds the rank; only the cells of that block
    are added up by themselves. Steps that share windows are added up together before they are shuffled.
    """
    steps = F.sequence(F.lit(0).cast("long"), F.lit(length_us // step_us - 1).cast("long"))
    start = F.floor(F.col("window_us") / step_us) * step_us
    fine = (histograms.withColumns({"step": start, "block": F.floor(F.col("cell") / BLOCK)}).groupBy(*keys, "step", "block", "cell")
            .agg(F.sum("n").alias("n"), F.sum("total").alias("total")))
    fine = stored(fine, "cells")
    group = F.floor(F.col("step") / length_us)

    def in_windows(rows: DataFrame, more: list[str], *aggs: Column) -> DataFrame:
        near = rows.withColumn("__group", group).repartition(*keys, "__group")
        each = near.withColumn("window_us", F.explode(F.transform(steps, lambda i: F.col("step") - i * step_us)))
        return each.groupBy(*keys, "window_us", *more).agg(*aggs)

    blocks = fine.groupBy(*keys, "step", "block").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    blocks = in_windows(blocks, ["block"], F.sum("n").alias("n"), F.sum("total").alias("total"))
    w = Window.partitionBy(*keys, "window_us")
    upto = w.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)  # a window has as many blocks as its values span
    ranked = blocks.withColumns({"__to": F.sum("n").over(upto), "__rank": F.floor(F.sum("n").over(w) * 0.95)})
    hit = (F.col("__to") > F.col("__rank")) & F.col("block").isNotNull()
    levels = stored(ranked.groupBy(*keys, "window_us").agg(
        F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean"),
        F.min(F.when(hit, F.struct("block", (F.col("__rank") - F.col("__to") + F.col("n")).alias("rest")))).alias("__hit")), "levels")
    wanted = levels.filter("__hit is not null").select(*keys, "window_us", F.col("__hit.block").alias("block"), F.col("__hit.rest").alias("__rest"),
                                                       F.explode(F.transform(steps, lambda i: F.col("window_us") + i * step_us)).alias("step"))
    cells = join_null_safe(fine.select(*keys, "step", "block", "cell", "n"), wanted, [*keys, "step", "block"], "inner")
    cells = cells.groupBy(*keys, "window_us", "cell").agg(F.sum("n").alias("n"), F.first("__rest").alias("__rest"))
    ranked = cells.withColumn("__to", F.sum("n").over(w.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)))
    found = ranked.filter(F.col("__to") > F.col("__rest")).groupBy(*keys, "window_us").agg((F.min("cell") * resolution).alias("p95"))
    out = join_null_safe(levels.drop("__hit"), found, [*keys, "window_us"])
    good = (lambda limit: F.col("mean") >= limit) if above else (lambda limit: F.col("p95") <= limit)
    return out.withColumn("status", F.when(good(target), "meeting").when(good(alert), "at_risk").otherwise("breach"))


ALERT_SCHEMA = "event_id long, ts timestamp_ntz, metric string, severity string, value double, limit double"


def threshold_alerts(samples: DataFrame, rules: Callable[[], DataFrame], folder: str) -> None:
    """Samples (``event_id``, ``ts``, ``metric``, ``value``) at or above their limits, as files of ``ALERT_SCHEMA`` by micro-batch.

    ``rules`` is called for every micro-batch, so changed limits hold from the next one on.
    """
    def each(batch: DataFrame, number: int) -> None:
        found = telemetry.threshold_alerts(batch.filter("event_id is not null"), rules())
        found.select("event_id", "ts", "metric", "severity", "value", "limit").write.mode("overwrite").parquet(f"{folder}/alerts/batch={number}")
    (samples.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination())


def sent_alerts(spark: SparkSession, folder: str, wait_seconds: int = 300, send: Callable[[DataFrame, int], None] | None = None, delay: str = "1 hour") -> DataFrame:
    """The alerts of ``threshold_alerts`` that outlive the cooldown of their metric and severity, each handed to ``send`` once."""
    alerts, closing = in_order.event_stream(spark, f"{folder}/alerts", ALERT_SCHEMA, "*.parquet")
    quiet = alert_cooldown(alerts, ["metric", "severity"], "metric string, severity string", wait_seconds, delay)
    return in_order.finished(quiet, closing, send)


def alert_cooldown(alerts: DataFrame, keys: list[str], key_ddl: str, wait_seconds: int = 300, delay: str = "1 hour") -> DataFrame:
    """Alerts more than ``wait_seconds`` after the last one sent for their key."""
    scan = sequential.cooldown_scan(wait_seconds * SECOND)

    def step(state, rows):
        last, found = scan(state, rows["us"].tolist())
        return last, rows[found["emitted"]][[*keys, "event_id", "us"]]
    return in_order.stateful(alerts, keys, "", f"{key_ddl}, event_id long, us long", step, wait_seconds * SECOND, delay)


def rate_limits(requests: DataFrame, keys: list[str], key_ddl: str, limit: int, window_seconds: int, delay: str = "1 hour") -> DataFrame:
    """Limiter verdict per request; only allowed requests use up the window."""
    scan = sequential.window_limit_scan(window_seconds * SECOND, limit)

    def step(state, rows):
        kept, found = scan(state, rows["us"].tolist())
        return kept, rows[[*keys, "event_id", "us"]].assign(allowed=found["allowed"])
    return in_order.stateful(requests, keys, "", f"{key_ddl}, event_id long, us long, allowed boolean", step, window_seconds * SECOND, delay)


def rule_chain(requests: DataFrame, keys: list[str], key_ddl: str, rules: list[tuple], block_seconds: int = 3600, limits: dict | None = None,
               delay: str = "1 hour") -> DataFrame:
    """Streaming form of ``abuse.rule_chain``: each verdict uses the score as it runs, from requests up to the one judged.

    Requests have ``endpoint``, which rules and score look at, ``agent`` and ``is_error``.
    A key's state goes once it is silent for the longest window, block and profile age.
    """
    chain, profile = abuse.chain_scan(rules, block_seconds), sequential.profile_scan(abuse.limits_with(limits), 24 * HOUR)

    def step(state, rows):
        passed, seen = state or (None, None)
        seen, scores = profile(seen, *(rows[c].tolist() for c in ("us", "endpoint", "agent", "is_error")))
        passed, verdicts = chain(passed, rows["us"].tolist(), rows["mask"].tolist(), scores["score"])
        return [passed, seen], rows[[*keys, "event_id", "us"]].assign(**scores, **verdicts)
    longest = max([24 * 3600, block_seconds, *(r[2] for r in rules)]) * SECOND
    out = in_order.stateful(abuse.chain_inputs(requests, rules), keys, "mask long, endpoint string, agent long, is_error boolean",
                            f"{key_ddl}, event_id long, us long, score double, {abuse.CHAIN_FIELDS}", step, longest, delay)
    return abuse.chain_verdicts(out, rules, block_seconds)


def crawl_tracker(crawls: DataFrame, key: str, key_ddl: str, limit: int = 100, delay: str = "1 hour") -> DataFrame:
    """Whether each crawl of a domain was due: not while blocked, not above the hourly count.

    ``status`` 429 or 503 blocks the domain for a day, 401 or 403 for an hour.
    """
    def step(state, rows):
        until, anchor, count = state if state else (0, -1, 0)
        verdicts = []
        for t, code in zip(rows["us"].tolist(), rows["status"].tolist()):
            if t < until:
                verdicts.append("blocked")
                continue
            count += 1
            if anchor < 0 or t - anchor >= HOUR:
                anchor, count = t, 1
            verdicts.append("over_limit" if count > limit else "ok")
            hours = 24 if code in (429, 503) else 1 if code in (401, 403) else 0
            if hours:
                until = t + hours * HOUR
        return [until, anchor, count], rows[[key, "event_id", "us"]].assign(verdict=verdicts)
    return in_order.stateful(crawls, [key], "status int", f"{key_ddl}, event_id long, us long, verdict string", step, 24 * HOUR, delay)


def abuse_profiles(requests: DataFrame, key: str, key_ddl: str, limits: dict, idle_hours: int = 24, delay: str = "1 hour") -> DataFrame:
    """Running suspicion score after each request; a client silent for a day starts afresh."""
    scan = sequential.profile_scan(abuse.limits_with(limits), idle_hours * HOUR)

    def step(state, rows):
        state, found = scan(state, *(rows[c].tolist() for c in ("us", "endpoint", "agent", "is_error")))
        return state, rows[[key, "event_id", "us"]].assign(**found)
    return in_order.stateful(requests, [key], "endpoint string, agent long, is_error boolean", f"{key_ddl}, event_id long, us long, score double", step, idle_hours * HOUR, delay)


SWEPT = ["swept_us", "signature"]


def retention_sweeper(records: DataFrame, policies: DataFrame, folder: str, as_of: int):
    """Stores arriving records by month and sweeps what is due at ``as_of``, on whatever schedule starts the job.

    Records to be archived are copied to ``folder/archive`` first; a swept record leaves a row with its id, the time and
    the signature of its deletion, and nothing else. Both are merged by key, so a replayed micro-batch changes nothing.
    """
    kept, archive = f"{folder}/records", f"{folder}/archive"
    columns = [c for c in records.columns if c != "record_id"]

    def each(batch: DataFrame, number: int) -> None:
        month = F.expr("trunc(timestampadd(MICROSECOND, created_us, timestamp_ntz'1970-01-01 00:00:00'), 'month')")
        fresh = batch.filter("record_id is not null and created_us is not null").withColumn("month", month)
        fresh = fresh.withColumns({"swept_us": F.lit(None).cast("long"), "signature": F.lit(None).cast("string")})
        before = stored_days.rows_of(batch.sparkSession, kept)
        if before is not None:  # a record once swept does not come back
            fresh = fresh.join(before.filter("swept_us is not null").select("record_id", "month"), ["record_id", "month"], "left_anti")
        stored_days.merge_days(fresh, kept, ["record_id"], ["month"])
        current = batch.sparkSession.read.parquet(kept).filter("swept_us is null")
        to_archive, due, audit = privacy.retention_sweep(privacy.with_retention(current, policies), as_of)
        stored_days.merge_days(to_archive.select("record_id", *columns, "month"), archive, ["record_id"], ["month"])
        types = dict(current.dtypes)
        gone = due.select("record_id", "month").join(audit.select("record_id", F.col("at_us").alias("swept_us"), "signature"), "record_id")
        stored_days.merge_days(gone.select("record_id", "month", *SWEPT, *[F.lit(None).cast(types[c]).alias(c) for c in columns]), kept, ["record_id"], ["month"])

    return records.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
