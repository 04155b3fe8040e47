"""Streaming jobs run to the end of the event log, comparable with their batch twins."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from firmlens.operators.durable import shared_folder, stored
from firmlens.operators import dimensions as dims
from firmlens.operators import privacy
from firmlens.plans import telemetry, views
from firmlens.plans.abuse import CHAIN, CHAIN_COLUMNS, CHAIN_LIMITS, CHAIN_SQL, RUNNING_SQL, on_paths
from firmlens.plans.privacy import AS_OF, RETENTION_SQL
from firmlens.plans.registry import query
from firmlens.plans.telemetry import rounded
from firmlens.sources import sinks
from firmlens.sources.captured import EVENT_SCHEMA
from firmlens.streaming import in_order, monitors


def log_stream(spark, sf):
    return _as_log(monitors.event_stream(spark, sf, EVENT_SCHEMA, "events.parquet*"))


def ordered_log(spark, sf):
    """The log as a stream for rules that need event-time order, and the folder for its closing row."""
    s, closing = in_order.event_stream(spark, sf, EVENT_SCHEMA, "events.parquet*")
    return _as_log(s), closing


def _as_log(s):
    return s.select("event_id", "us", "at", F.col("user_id").alias("client"), F.col("event_type").alias("endpoint"), F.col("value").alias("ms"),
                    (F.col("event_type") == "error").alias("is_error"), F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("agent"))


def _rollup_sql(minutes):
    """Windows of so many minutes that start every minute."""
    return f"""s AS (SELECT endpoint, (us // 60000000 - i) * 60000000 AS slot, ms FROM req, range(0, {minutes}) t(i))
    SELECT endpoint, slot AS window_us, count(*) AS n, round(sum(ms), 4) AS total, min(ms) AS least, max(ms) AS most FROM s GROUP BY ALL"""


@query("stream_rollups", "req", _rollup_sql(1))
def stream_rollups(spark, sf):
    return rounded(monitors.finished_windows(monitors.rollups(log_stream(spark, sf), ["endpoint"], "ms"), ["endpoint"]), "total", digits=4)


@query("stream_recent_view", "req", _rollup_sql(5))
def stream_recent_view(spark, sf):
    """The last five minutes, as seen every minute."""
    return rounded(monitors.finished_windows(monitors.rollups(log_stream(spark, sf), ["endpoint"], "ms", "5 minutes", "1 minute"), ["endpoint"]), "total", digits=4)


@query("stream_error_ratios", "req", """w AS (SELECT client % 10 AS service, us // 300000000 * 300000000 AS slot, count(*) AS n, count(*) FILTER (is_error) AS hits FROM req GROUP BY ALL)
    SELECT service, slot AS window_us, n, hits, round(hits / n, 6) AS ratio FROM w""")
def stream_error_ratios(spark, sf):
    log = log_stream(spark, sf).withColumn("service", F.col("client") % 10)
    return rounded(monitors.finished_windows(monitors.ratios(log, ["service"], F.col("is_error")), ["service"]), "ratio")


@query("stream_cache_ratios", "req", """w AS (SELECT endpoint, us // 600000000 * 600000000 AS slot, count(*) AS n, count(*) FILTER (event_id % 3 <> 0) AS hits FROM req GROUP BY ALL)
    SELECT endpoint, slot AS window_us, n, hits, round(hits / n, 6) AS ratio FROM w""")
def stream_cache_ratios(spark, sf):
    return rounded(monitors.finished_windows(monitors.ratios(log_stream(spark, sf), ["endpoint"], F.col("event_id") % 3 != 0, "10 minutes"), ["endpoint"]), "ratio")


def _level_sql(slots):
    return f"""s AS (SELECT endpoint, (us // 300000000 - i) * 300000000 AS slot, ms FROM req, range(0, {slots}) t(i)),
    w AS (SELECT endpoint, slot, count(*) AS n, avg(ms) AS mean FROM s GROUP BY ALL)
    SELECT endpoint, slot AS window_us, n, round(mean, 8) AS mean, CASE WHEN mean <= 30 THEN 'meeting' WHEN mean <= 60 THEN 'at_risk' ELSE 'breach' END AS status FROM w"""


@query("stream_service_levels", "req", _level_sql(12))
def stream_service_levels(spark, sf):
    return rounded(monitors.finished_windows(monitors.service_levels(log_stream(spark, sf), ["endpoint"], "ms", 30.0, 60.0), ["endpoint"]), "mean", digits=8)


def _percentile_sql():
    part = """SELECT endpoint, {h} AS hours, (us // {step} - i) * {step} AS slot, CAST(round(ms / 0.01) AS BIGINT) AS cell, ms FROM req, range(0, {n}) t(i)"""
    both = " UNION ALL ".join(part.format(h=h, step=step, n=n) for h, step, n in ((1, 300_000_000, 12), (24, 3_600_000_000, 24)))
    return f"""s AS ({both}), w AS (SELECT endpoint, hours, slot, count(*) AS n, avg(ms) AS mean, list_sort(list(cell))[CAST(floor(count(*) * 0.95) AS BIGINT) + 1] * 0.01::DOUBLE AS p95 FROM s GROUP BY ALL)
    SELECT endpoint, hours, slot AS window_us, n, round(mean, 8) AS mean, round(p95, 2) AS p95, CASE WHEN p95 <= 60 THEN 'meeting' WHEN p95 <= 120 THEN 'at_risk' ELSE 'breach' END AS status FROM w"""


@query("stream_service_percentiles", "req", _percentile_sql())
def stream_service_percentiles(spark, sf):
    """Service levels by nearest-rank p95 over the last hour, every five minutes, and the last day, every hour."""
    cells = monitors.value_histograms(log_stream(spark, sf), ["endpoint"], "ms", "5 minutes", delay="23 hours 10 minutes")
    cells = stored(monitors.finished_windows(cells, ["endpoint", "cell"], on_disk=True), "histograms")
    out = None
    for hours, minutes in ((1, 5), (24, 60)):
        level = monitors.levels_of(cells, ["endpoint"], hours * 3600 * monitors.SECOND, minutes * 60 * monitors.SECOND, 60.0, 120.0).withColumn("hours", F.lit(hours))
        out = level if out is None else out.unionByName(level)
    return rounded(rounded(out, "mean", digits=8), "p95", digits=2)


@query("stream_threshold_alerts", "metric", "RECURSIVE " + telemetry.ALERT_WALK_SQL)
def stream_threshold_alerts(spark, sf):
    """Limits joined per micro-batch, then the cooldown per metric and severity in event-time order; the batch form is ``alert_cooldown``."""
    folder = f"{shared_folder(spark)}/alerts-{uuid.uuid4().hex}"
    log = monitors.event_stream(spark, sf, EVENT_SCHEMA, "events.parquet*")
    samples = log.select("event_id", "ts", telemetry.metric_name(F.col("event_type")).alias("metric"), "value")
    monitors.threshold_alerts(samples, lambda: dims.frame(spark, dims.METRIC_THRESHOLDS, dims.METRIC_THRESHOLDS_DDL), folder)
    return monitors.sent_alerts(spark, folder, 1800).select("event_id", "metric", "severity", "us")


@query("stream_retention_sweep", "data_record", f"""{RETENTION_SQL} SELECT record_id, 'archive' AS step FROM ret WHERE {AS_OF} > expires_us AND coalesce(archive, false)
    UNION ALL SELECT record_id, sha256('{AS_OF}delete' || subject_id || 'retention_system') FROM ret WHERE {AS_OF} > expires_us
    UNION ALL SELECT record_id, 'kept ' || category FROM ret WHERE {AS_OF} <= expires_us""")
def stream_retention_sweep(spark, sf):
    """Records stored as they arrive and swept: what was archived, the signature of each deletion, and what is still there."""
    folder = f"{shared_folder(spark)}/sweep-{uuid.uuid4().hex}"
    orders = spark.readStream.schema(views.table(spark, sf, "orders").schema).option("pathGlobFilter", "orders.parquet*").parquet(sf)
    policies = dims.frame(spark, privacy.RETENTION, privacy.RETENTION_DDL)
    monitors.retention_sweeper(views.data_records(spark, sf, orders), policies, folder, AS_OF).awaitTermination()
    rows = spark.read.parquet(f"{folder}/records")
    step = F.when(F.col("swept_us").isNotNull(), F.col("signature")).otherwise(F.concat(F.lit("kept "), "category"))
    return rows.select("record_id", step.alias("step")).unionByName(spark.read.parquet(f"{folder}/archive").select("record_id", F.lit("archive").alias("step")))


@query("stream_alert_cooldown", "req", """RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY endpoint ORDER BY us, event_id) AS k FROM req WHERE ms > 50),
    walk AS (SELECT endpoint, k, event_id, us, us AS last, true AS emitted FROM r WHERE k = 1
      UNION ALL SELECT r.endpoint, r.k, r.event_id, r.us, CASE WHEN r.us - w.last > 1800000000 THEN r.us ELSE w.last END, r.us - w.last > 1800000000 FROM walk w JOIN r ON r.endpoint = w.endpoint AND r.k = w.k + 1)
    SELECT endpoint, event_id, us FROM walk WHERE emitted""")
def stream_alert_cooldown(spark, sf):
    log, closing = ordered_log(spark, sf)
    return in_order.finished(monitors.alert_cooldown(in_order.where(log, F.col("ms") > 50), ["endpoint"], "endpoint string", 1800), closing)


@query("stream_rate_limits", "req", """RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY us, event_id) AS k FROM req),
    walk AS (SELECT client, k, event_id, us, [us] AS kept, true AS allowed FROM r WHERE k = 1
      UNION ALL SELECT client, k, event_id, us, CASE WHEN len(old) < 3 THEN list_append(old, us) ELSE old END, len(old) < 3
      FROM (SELECT r.client, r.k, r.event_id, r.us, list_filter(w.kept, lambda x: x >= r.us - 172800000000) AS old FROM walk w JOIN r ON r.client = w.client AND r.k = w.k + 1))
    SELECT client, event_id, us, allowed FROM walk""")
def stream_rate_limits(spark, sf):
    log, closing = ordered_log(spark, sf)
    return in_order.finished(monitors.rate_limits(log, ["client"], "client long", 3, 172800), closing)


@query("stream_rule_chain", "req", CHAIN_SQL)
def stream_rule_chain(spark, sf):
    """The batch form is ``rule_chain_verdicts``."""
    log, closing = ordered_log(spark, sf)
    return in_order.finished(monitors.rule_chain(on_paths(log), ["client"], "client long", CHAIN, 86400, CHAIN_LIMITS), closing).select(*CHAIN_COLUMNS)


@query("stream_crawl_tracker", "req", """RECURSIVE r AS (SELECT *, CASE agent % 20 WHEN 0 THEN 24 WHEN 1 THEN 1 ELSE 0 END AS hours, row_number() OVER (PARTITION BY client ORDER BY us, event_id) AS k FROM req),
    walk AS (SELECT client, k, event_id, us, us AS anchor, 1 AS n, CASE WHEN hours > 0 THEN us + hours * 3600000000 ELSE 0 END AS until_us, 'ok' AS verdict FROM r WHERE k = 1
      UNION ALL SELECT r.client, r.k, r.event_id, r.us, CASE WHEN r.us < until_us THEN anchor WHEN r.us - anchor >= 3600000000 THEN r.us ELSE anchor END,
        CASE WHEN r.us < until_us THEN n WHEN r.us - anchor >= 3600000000 THEN 1 ELSE n + 1 END, CASE WHEN r.us >= until_us AND hours > 0 THEN r.us + hours * 3600000000 ELSE until_us END,
        CASE WHEN r.us < until_us THEN 'blocked' WHEN r.us - anchor < 3600000000 AND n + 1 > 1 THEN 'over_limit' ELSE 'ok' END
      FROM walk w JOIN r ON r.client = w.client AND r.k = w.k + 1)
    SELECT client, event_id, us, verdict FROM walk""")
def stream_crawl_tracker(spark, sf):
    a = F.col("agent") % 20
    log, closing = ordered_log(spark, sf)
    crawls = log.withColumn("status", F.when(a == 0, 429).when(a == 1, 403).otherwise(200))
    return in_order.finished(monitors.crawl_tracker(crawls, "client", "client long", limit=1), closing)


@query("stream_abuse_profiles", "req", f"{RUNNING_SQL} SELECT client, event_id, us, round(score, 6) AS score FROM running")
def stream_abuse_profiles(spark, sf):
    """Running scores; the batch form is ``running_scores``."""
    log, closing = ordered_log(spark, sf)
    return rounded(in_order.finished(monitors.abuse_profiles(log, "client", "client long", CHAIN_LIMITS), closing), "score")


@query("stream_without_replays", "req", "SELECT event_id, us, client FROM req")
def stream_without_replays(spark, sf):
    log = log_stream(spark, sf)
    return monitors.finished(monitors.without_replays(log.unionByName(log.filter("event_id % 3 = 0"))).select("event_id", "us", "client"))


@query("routed_events", "req", """SELECT kind, us // 86400000000 AS day, count(*) AS n FROM (SELECT us, unnest(list_filter(['all', CASE WHEN is_error THEN 'errors' END,
    CASE WHEN endpoint IN ('purchase', 'signup') THEN 'business' END], lambda x: x IS NOT NULL)) AS kind FROM req) GROUP BY ALL""")
def routed_events(spark, sf):
    """The log written by kind and day, and what was read back per folder."""
    folder = f"{shared_folder(spark)}/routed-{uuid.uuid4().hex}"
    sinks.route_events(views.logged(spark, sf), folder)
    return spark.read.parquet(folder).groupBy("kind", F.datediff("day", F.lit("1970-01-01")).cast("long").alias("day")).agg(F.count(F.lit(1)).alias("n"))
