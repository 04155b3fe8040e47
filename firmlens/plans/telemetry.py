"""Queries over the service log: metrics, alerts, errors, service levels."""
from __future__ import annotations

from pyspark.sql import functions as F

from firmlens.functions import numbers
from firmlens.operators import dimensions as dims
from firmlens.operators import ordered, sequential, telemetry
from firmlens.plans import views
from firmlens.plans.registry import query

AS_OF = 1706486400000000  # 2024-01-29 00:00:00

# How the given event types stand for resource series.
NAMED_SQL = """named AS (SELECT *, us // 86400000000 AS day, CASE WHEN name = 'view' AND event_id % 2 = 0 THEN 'cpu_usage'
    WHEN name = 'view' THEN 'total_requests' WHEN name = 'click' AND event_id % 2 = 0 THEN 'memory_usage'
    WHEN name = 'click' THEN 'connection_pool_usage' WHEN name = 'purchase' THEN 'response_time'
    WHEN name = 'error' THEN 'rate_limit_errors' WHEN event_id % 5 = 0 THEN 'error_rate' ELSE 'queue_depth' END AS series
    FROM metric)"""


def named_series(spark, sf):
    m, even = views.metrics(spark, sf), F.col("event_id") % 2 == 0
    n = F.col("name")
    series = (F.when((n == "view") & even, "cpu_usage").when(n == "view", "total_requests")
              .when((n == "click") & even, "memory_usage").when(n == "click", "connection_pool_usage")
              .when(n == "purchase", "response_time").when(n == "error", "rate_limit_errors")
              .when(F.col("event_id") % 5 == 0, "error_rate").otherwise("queue_depth"))
    return m.withColumn("name", series).withColumn("day", F.expr("us div 86400000000"))


def rounded(df, *cols, digits=6):
    return df.withColumns({c: numbers.rounded(F.col(c), digits) for c in cols})


_EXCL = """(s[greatest(1, least({i} * (n + 1) // {n}, n - 1))] * ({n} - ({i} * (n + 1) - greatest(1, least({i} * (n + 1) // {n}, n - 1)) * {n}))
  + s[greatest(1, least({i} * (n + 1) // {n}, n - 1)) + 1] * ({i} * (n + 1) - greatest(1, least({i} * (n + 1) // {n}, n - 1)) * {n})) / {n}"""


@query("metric_statistics", "metric", f"""agg AS (SELECT name, list_sort(list(value)) AS s, count(*) AS n, min(value) AS mn,
    max(value) AS mx, avg(value) AS av, coalesce(stddev_samp(value), 0) AS sd, max(us) AS last_time,
    arg_max(value, (us, event_id)) AS last_value FROM metric GROUP BY name)
    SELECT name, n AS count, mn AS min, mx AS max, round(av, 6) AS avg,
    round((s[(n + 1) // 2] + s[n // 2 + 1]) / 2, 6) AS median, round(sd, 6) AS std_dev,
    round(CASE WHEN n >= 20 THEN {_EXCL.format(i=19, n=20)} ELSE mx END, 6) AS p95,
    round(CASE WHEN n >= 100 THEN {_EXCL.format(i=99, n=100)} ELSE mx END, 6) AS p99, last_value, last_time FROM agg""")
def metric_statistics(spark, sf):
    return rounded(telemetry.metric_statistics(views.metrics(spark, sf), ["name"], "value", ["us", "event_id"]),
                   "avg", "median", "std_dev", "p95", "p99")


@query("nearest_rank_p95", "metric", """SELECT name, n, s[CAST(floor(n * 0.95::DOUBLE) AS BIGINT) + 1] AS p95,
    s[least(CAST(floor(n * 0.95::DOUBLE) AS BIGINT), n - 1) + 1] AS p95_clamped
    FROM (SELECT name, count(*) AS n, list_sort(list(value)) AS s FROM metric GROUP BY name)""")
def nearest_rank_p95(spark, sf):
    return telemetry.nearest_rank_p95(views.metrics(spark, sf), ["name"], "value")


@query("load_run_summary", "req", """agg AS (SELECT endpoint, count(*) AS total, count(*) FILTER (NOT is_error) AS successful,
    avg(ms) AS mean_ms, list_sort(list(ms)) AS s, (max(us) - min(us)) / 1e6 AS seconds FROM req GROUP BY endpoint)
    SELECT endpoint, total, successful, round(successful / total * 100, 6) AS success_pct, round(mean_ms, 6) AS mean_ms,
    round((s[(total + 1) // 2] + s[total // 2 + 1]) / 2, 6) AS median_ms,
    s[least(CAST(floor(total * 0.95::DOUBLE) AS BIGINT), total - 1) + 1] AS p95_ms,
    round(CASE WHEN seconds > 0 THEN total / seconds ELSE 0 END, 9) AS per_second FROM agg""")
def load_run_summary(spark, sf):
    out = telemetry.load_run_summary(views.events(spark, sf), ["endpoint"])
    return rounded(rounded(out, "success_pct", "mean_ms", "median_ms"), "per_second", digits=9)


_LEVELS = "(VALUES " + ", ".join(f"('{a}', '{b}', {c}::DOUBLE, {d}::DOUBLE, {e}, '{f}')" for a, b, c, d, e, f in dims.SERVICE_LEVELS) + \
    ") l(sla, metric, target, alert_limit, hours, direction)"
_SLA_NAMES = {"view": "response_time_p95", "purchase": "request_success_rate", "click": "error_rate_percent",
              "signup": "uptime_percent"}


@query("service_level_status", "metric", f"""agg AS (SELECT sla, l.metric, target, alert_limit, direction, count(*) AS samples,
      avg(value) AS mean, list_sort(list(value)) AS s
    FROM metric m JOIN {_LEVELS} ON l.metric = CASE m.name WHEN 'view' THEN 'response_time_p95' WHEN 'purchase'
      THEN 'request_success_rate' WHEN 'click' THEN 'error_rate_percent' WHEN 'signup' THEN 'uptime_percent' END
    WHERE us >= {AS_OF} - hours * 3600000000 AND us <= {AS_OF} GROUP BY ALL),
    v AS (SELECT *, CASE WHEN metric LIKE 'response_time%' THEN s[CAST(floor(samples * 0.95::DOUBLE) AS BIGINT) + 1] ELSE mean END AS x FROM agg)
    SELECT sla, metric, samples, round(x, 6) AS current_value, target,
    CASE WHEN (direction = 'above' AND x >= target) OR (direction = 'below' AND x <= target) THEN 'meeting'
      WHEN (direction = 'above' AND x >= alert_limit) OR (direction = 'below' AND x <= alert_limit) THEN 'at_risk'
      ELSE 'breach' END AS status FROM v""")
def service_level_status(spark, sf):
    names = F.create_map(*[F.lit(x) for kv in _SLA_NAMES.items() for x in kv])
    longest = max(hours for *_, hours, _ in dims.SERVICE_LEVELS) * 3_600_000_000
    samples = views.metrics(spark, sf, AS_OF - longest - 1, AS_OF).withColumn("name", F.try_element_at(names, F.col("name"))).filter("name is not null")
    levels = dims.frame(spark, dims.SERVICE_LEVELS, dims.SERVICE_LEVELS_DDL)
    return rounded(telemetry.service_levels(samples, levels, AS_OF), "current_value")


_BOTTLENECK_SQL = NAMED_SQL + """, agg AS (SELECT day, avg(value) FILTER (series = 'cpu_usage') AS cpu,
    avg(value) FILTER (series = 'memory_usage') AS mem, avg(value) FILTER (series = 'response_time') AS rt,
    avg(value) FILTER (series = 'queue_depth') AS qd, avg(value) FILTER (series = 'connection_pool_usage') AS cp,
    count(*) FILTER (series = 'rate_limit_errors') / greatest(count(*) FILTER (series = 'total_requests'), 1) * 100 AS rl
    FROM named GROUP BY day),
    found AS (SELECT day, 'cpu_bound' AS bottleneck, least(cpu / 100, 1.0) AS severity, cpu AS observed FROM agg WHERE cpu > 70
    UNION ALL SELECT day, 'memory_bound', least(mem / 100, 1.0), mem FROM agg WHERE mem > 80
    UNION ALL SELECT day, 'io_bound', least(rt / 30, 1.0), rt FROM agg WHERE rt > 5
    UNION ALL SELECT day, 'concurrency_limited', least(qd / 100, 1.0), qd FROM agg WHERE qd > 10
    UNION ALL SELECT day, 'resource_contention', least(cp / 100, 1.0), cp FROM agg WHERE cp > 80
    UNION ALL SELECT day, 'rate_limited', least(rl / 10, 1.0), rl FROM agg WHERE rl > 1)"""


@query("bottlenecks", "metric", _BOTTLENECK_SQL + """ SELECT day, bottleneck, round(severity, 6) AS severity,
    round(observed, 6) AS observed, CASE WHEN severity > 0.7 THEN 'high' WHEN severity > 0.4 THEN 'medium' ELSE 'low' END
    AS priority FROM found""")
def bottlenecks(spark, sf):
    return rounded(telemetry.bottlenecks(named_series(spark, sf), ["day"]), "severity", "observed")


_ACTIONS_SQL = "(VALUES " + ", ".join(f"('{b}', {k}, '{a}', {str(auto).lower()})" for b, k, a, auto in dims.RECOMMENDATIONS) + ") t(bottleneck, step, action, automated)"
_TOLD_SQL = f", told AS (SELECT bottleneck, string_agg(action, '; ' ORDER BY step) AS recommendations, bool_or(automated) AS automated_fixes_available FROM {_ACTIONS_SQL} GROUP BY 1)"


def actions(spark):
    return dims.frame(spark, dims.RECOMMENDATIONS, dims.RECOMMENDATIONS_DDL)


@query("bottleneck_alerts", "metric", _BOTTLENECK_SQL + _TOLD_SQL + """ SELECT day, found.bottleneck, round(severity, 6) AS severity,
    CASE WHEN severity > 0.8 THEN 'critical' ELSE 'high' END AS alert, recommendations FROM found JOIN told ON found.bottleneck = told.bottleneck WHERE severity > 0.7""")
def bottleneck_alerts(spark, sf):
    found = telemetry.bottleneck_alerts(telemetry.bottlenecks(named_series(spark, sf), ["day"]), actions(spark))
    return rounded(found.select("day", "bottleneck", "severity", "alert", F.array_join("recommendations", "; ").alias("recommendations")), "severity")


@query("optimization_recommendations", "metric", _BOTTLENECK_SQL + _TOLD_SQL + """ SELECT day, found.bottleneck, round(severity, 6) AS severity,
    CASE WHEN severity > 0.7 THEN 'high' WHEN severity > 0.4 THEN 'medium' ELSE 'low' END AS priority, recommendations, automated_fixes_available FROM found JOIN told ON found.bottleneck = told.bottleneck""")
def optimization_recommendations(spark, sf):
    found = telemetry.optimization_recommendations(telemetry.bottlenecks(named_series(spark, sf), ["day"]), actions(spark))
    return rounded(found.select("day", "bottleneck", "severity", "priority", F.array_join("recommendations", "; ").alias("recommendations"), "automated_fixes_available"), "severity")


@query("performance_grades", "metric", _BOTTLENECK_SQL + """, m AS (SELECT day, avg(value) FILTER (series = 'response_time') AS rt,
    avg(value) FILTER (series = 'cpu_usage') AS cpu, avg(value) FILTER (series = 'memory_usage') AS mem,
    avg(value) FILTER (series = 'error_rate') AS er FROM named GROUP BY day),
    p AS (SELECT *, 100 - CASE WHEN rt > 30 THEN 50 WHEN rt > 10 THEN 30 WHEN rt > 3 THEN 15 WHEN rt > 1 THEN 5 ELSE 0 END
      - CASE WHEN cpu > 95 THEN 25 WHEN cpu > 85 THEN 15 WHEN cpu > 70 THEN 10 ELSE 0 END
      - CASE WHEN mem > 95 THEN 25 WHEN mem > 85 THEN 15 WHEN mem > 80 THEN 10 ELSE 0 END
      - CASE WHEN er > 10 THEN 30 WHEN er > 5 THEN 15 WHEN er > 1 THEN 5 ELSE 0 END AS points FROM m),
    f AS (SELECT day, sum(severity) AS sev, count(*) FILTER (severity > 0.8) AS crit FROM found GROUP BY day)
    SELECT p.day, CASE WHEN points >= 90 THEN 'excellent' WHEN points >= 75 THEN 'good' WHEN points >= 60 THEN 'acceptable'
      WHEN points >= 40 THEN 'poor' ELSE 'critical' END AS level,
    round(greatest(0, least(100, 100 - coalesce(sev, 0) * 20 - CASE WHEN er IS NULL THEN 0 ELSE least(er * 2, 20) END)), 6) AS score,
    coalesce(crit, 0) AS critical_bottlenecks FROM p LEFT JOIN f ON p.day = f.day""")
def performance_grades(spark, sf):
    return rounded(telemetry.performance_grades(named_series(spark, sf), ["day"]), "score")


@query("top_errors", "req", f"""SELECT operation, error_type, count(*) AS errors, count(*) FILTER (us > {AS_OF} - 3600000000) AS recent,
    max(us) AS last_us, round(count(*) FILTER (us > {AS_OF} - 3600000000) / 60, 6) AS per_minute
    FROM (SELECT 'op' || (client % 7) AS operation, 'E' || (agent % 4) AS error_type, us FROM req WHERE is_error)
    WHERE us > {AS_OF} - 744 * 3600000000 AND us <= {AS_OF} GROUP BY 1, 2 ORDER BY errors DESC, 1, 2 LIMIT 10""")
def top_errors(spark, sf):
    e = views.events(spark, sf, AS_OF - 744 * 3_600_000_000, AS_OF).filter("is_error").select(
        F.concat(F.lit("op"), (F.col("client") % 7).cast("string")).alias("operation"),
        F.concat(F.lit("E"), (F.col("agent") % 4).cast("string")).alias("error_type"), "us")
    return rounded(telemetry.top_errors(e, AS_OF, keep_hours=744), "per_minute")


@query("cache_statistics", "req", """SELECT endpoint, count(*) FILTER (event_id % 3 <> 0) AS hits,
    count(*) FILTER (event_id % 3 = 0) AS misses, round(count(*) FILTER (event_id % 3 <> 0) / count(*) * 100, 2) AS hit_rate
    FROM req GROUP BY endpoint""")
def cache_statistics(spark, sf):
    return telemetry.cache_statistics(views.events(spark, sf).withColumn("hit", F.col("event_id") % 3 != 0), ["endpoint"])


@query("hourly_performance", "req", """SELECT us // 3600000000 AS hour, count(*) AS tasks, count(*) FILTER (NOT is_error) AS successful,
    round(count(*) FILTER (NOT is_error) / count(*) * 100, 2) AS success_pct, round(avg(ms / 1000), 10) AS avg_seconds,
    round(avg(agent / 10), 10) AS avg_waited FROM req GROUP BY 1""")
def hourly_performance(spark, sf):
    t = views.events(spark, sf).select("us", (~F.col("is_error")).alias("success"), (F.col("ms") / 1000).alias("seconds"),
                                       (F.col("agent") / 10).alias("waited"))
    return rounded(telemetry.hourly_performance(t), "avg_seconds", "avg_waited", digits=10)


@query("last_hour_performance", "req", f"""SELECT count(*) AS tasks, count(*) FILTER (NOT is_error) AS successful,
    round(coalesce(count(*) FILTER (NOT is_error) / nullif(count(*), 0) * 100, 0), 2) AS success_pct,
    round(coalesce(avg(ms / 1000), 0), 2) AS avg_seconds
    FROM req WHERE us > {AS_OF} - 3600000000 AND us <= {AS_OF}""")
def last_hour_performance(spark, sf):
    t = views.events(spark, sf, AS_OF - 3_600_000_000, AS_OF)
    n, ok = F.count(F.lit(1)), F.count_if(~F.col("is_error"))
    return t.agg(n.alias("tasks"), ok.alias("successful"),
                 F.round(F.coalesce(F.try_divide(ok, n) * 100, F.lit(0.0)), 2).alias("success_pct"),
                 F.round(F.coalesce(F.avg(F.col("ms") / 1000), F.lit(0.0)), 2).alias("avg_seconds"))


@query("health_rollup", "req", """s AS (SELECT client, arg_max(CASE WHEN ms > 200 THEN 'critical' WHEN ms > 100 THEN 'unhealthy'
      WHEN ms > 40 THEN 'degraded' ELSE 'healthy' END, (us, event_id)) AS status FROM req GROUP BY client)
    SELECT count(*) FILTER (status = 'healthy') AS healthy, count(*) FILTER (status = 'degraded') AS degraded,
    count(*) FILTER (status = 'unhealthy') AS unhealthy, count(*) FILTER (status = 'critical') AS critical,
    count(*) AS components, CASE WHEN count(*) FILTER (status = 'critical') > 0 THEN 'critical'
      WHEN count(*) FILTER (status = 'unhealthy') > 0 THEN 'unhealthy'
      WHEN count(*) FILTER (status = 'degraded') > 0 THEN 'degraded' ELSE 'healthy' END AS overall FROM s""")
def health_rollup(spark, sf):
    ms = F.col("ms")
    return telemetry.health_rollup(views.events(spark, sf).select(
        F.col("client").alias("component"), "us", "event_id",
        F.when(ms > 200, "critical").when(ms > 100, "unhealthy").when(ms > 40, "degraded").otherwise("healthy").alias("status")))


@query("resource_health", "req", """SELECT endpoint, count(*) FILTER (s = 'healthy') AS healthy, count(*) FILTER (s = 'degraded') AS degraded,
    count(*) FILTER (s = 'unhealthy') AS unhealthy FROM (SELECT endpoint, CASE WHEN ms > 90 OR agent > 95 OR event_id % 97 > 95 THEN 'unhealthy'
    WHEN ms > 80 OR agent > 90 OR event_id % 97 > 85 THEN 'degraded' ELSE 'healthy' END AS s FROM req) GROUP BY endpoint""")
def resource_health(spark, sf):
    s = telemetry.resource_status(F.col("ms"), F.col("agent"), F.col("event_id") % 97)
    return views.events(spark, sf).withColumn("s", s).groupBy("endpoint").agg(
        *[F.count_if(F.col("s") == x).alias(x) for x in ("healthy", "degraded", "unhealthy")])


_BUCKETS = ", ".join(str(b) for b in dims.DURATION_BUCKETS)


@query("duration_buckets", "req", f"""b AS (SELECT unnest([{_BUCKETS}, 'inf'::DOUBLE]) AS le)
    SELECT endpoint, CASE WHEN isinf(le) THEN '+Inf' ELSE CAST(CAST(le * 10 AS BIGINT) AS VARCHAR) END AS le_tenths,
    count(*) FILTER (ms / 10 <= le) AS cumulative FROM req, b GROUP BY 1, 2""")
def duration_buckets(spark, sf):
    h = telemetry.histogram(views.events(spark, sf), ["endpoint"], F.col("ms") / 10, dims.DURATION_BUCKETS)
    return h.select("endpoint", F.explode("buckets").alias("b")).select(
        "endpoint", F.when(F.col("b.le") == float("inf"), "+Inf").otherwise(
            F.round(F.col("b.le") * 10).cast("long").cast("string")).alias("le_tenths"), "b.cumulative")


@query("bucket_quantiles", "req", f"""b AS (SELECT unnest([{_BUCKETS}, 'inf'::DOUBLE]) AS le),
    c AS (SELECT endpoint, le, count(*) FILTER (ms / 10 <= le) AS cum FROM req, b GROUP BY 1, 2),
    w AS (SELECT *, lag(cum, 1, 0) OVER (PARTITION BY endpoint ORDER BY le) AS pc, lag(le, 1, 0) OVER (PARTITION BY endpoint ORDER BY le) AS pl,
      max(cum) OVER (PARTITION BY endpoint) AS n FROM c),
    q AS (SELECT endpoint, qq, arg_min(CASE WHEN isinf(le) THEN pl ELSE pl + (le - pl) * (qq * n - pc) / (cum - pc) END, le) AS v
      FROM w, (SELECT unnest([0.5::DOUBLE, 0.95::DOUBLE]) AS qq) WHERE cum >= qq * n GROUP BY 1, 2)
    SELECT endpoint, round(max(v) FILTER (qq = 0.5), 6) AS p50, round(max(v) FILTER (qq = 0.95), 6) AS p95 FROM q GROUP BY 1""")
def bucket_quantiles(spark, sf):
    h = telemetry.histogram(views.events(spark, sf), ["endpoint"], F.col("ms") / 10, dims.DURATION_BUCKETS)
    return rounded(h.select("endpoint", telemetry.bucket_quantile(F.col("buckets"), 0.5).alias("p50"),
                            telemetry.bucket_quantile(F.col("buckets"), 0.95).alias("p95")), "p50", "p95")


@query("resource_report", "metric", """r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY us DESC, event_id DESC) AS k FROM metric)
    SELECT name, count(*) AS points, round(avg(value), 2) AS avg_value,
    round(avg(value) / CASE name WHEN 'view' THEN 512 WHEN 'click' THEN 80 ELSE 100 END * 100, 2) AS utilisation_pct
    FROM r WHERE k <= 100 GROUP BY name""")
def resource_report(spark, sf):
    return telemetry.resource_report(views.metrics(spark, sf), ["name"], [F.desc("us"), F.desc("event_id")],
                                     {"view": 512.0, "click": 80.0, "purchase": 100.0, "error": 100.0, "signup": 100.0})


@query("kpi_board", "req", """b AS (SELECT avg(ms / 10) AS lat, count(*) / greatest((max(us) - min(us)) / 3600e6, 0.1) AS thr,
    count(*) FILTER (is_error) / count(*) * 100 AS err, count(*) FILTER (event_id % 3 <> 0) / count(*) * 100 AS cache,
    list_sort(list(ms / 10))[CAST(floor(count(*) * 0.95::DOUBLE) AS BIGINT) + 1] AS p95 FROM req)
    SELECT 'latency_seconds' AS kpi, round(lat, 6) AS value, lat < 30 AS on_target, p95 > 60 AS alerting FROM b
    UNION ALL SELECT 'throughput_per_hour', round(thr, 6), thr > 100, thr < 50 FROM b
    UNION ALL SELECT 'error_percent', round(err, 6), err < 1, err > 5 FROM b
    UNION ALL SELECT 'cache_hit_percent', round(cache, 6), cache > 70, cache < 50 FROM b""")
def kpi_board(spark, sf):
    r = views.events(spark, sf).select("us", (F.col("ms") / 10).alias("seconds"), "is_error",
                                       (F.col("event_id") % 3 != 0).alias("hit"))
    return rounded(telemetry.kpi_board(r), "value")


_THRESH = "(VALUES " + ", ".join(f"('{m}', {w}::DOUBLE, {c}::DOUBLE)" for m, w, c in dims.METRIC_THRESHOLDS) + ") t(metric, warning, critical)"
_METRIC_OF = {"view": "cpu_percent", "click": "memory_percent", "purchase": "disk_usage_percent",
              "error": "error_rate_percent", "signup": "request_rate_per_minute"}
_ALERT_SQL = f"""alert AS (SELECT event_id, us, t.metric, value, CASE WHEN value >= critical THEN 'critical' ELSE 'warning' END AS severity,
    CASE WHEN value >= critical THEN critical ELSE warning END AS "limit"
    FROM metric m JOIN {_THRESH} ON t.metric = CASE m.name WHEN 'view' THEN 'cpu_percent' WHEN 'click' THEN 'memory_percent'
      WHEN 'purchase' THEN 'disk_usage_percent' WHEN 'error' THEN 'error_rate_percent' ELSE 'request_rate_per_minute' END
    WHERE value >= warning)"""


def metric_name(kind):
    """The metric that an event type stands for."""
    return F.create_map(*[F.lit(x) for kv in _METRIC_OF.items() for x in kv])[kind]


def alerts(spark, sf):
    samples = views.metrics(spark, sf).select("event_id", "us", metric_name(F.col("name")).alias("metric"), "value")
    return telemetry.threshold_alerts(samples, dims.frame(spark, dims.METRIC_THRESHOLDS, dims.METRIC_THRESHOLDS_DDL))


@query("threshold_alerts", "metric", _ALERT_SQL + " SELECT * FROM alert")
def threshold_alerts(spark, sf):
    return alerts(spark, sf)


ALERT_WALK_SQL = _ALERT_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY metric, severity
      ORDER BY us, event_id) AS k FROM alert),
    walk AS (SELECT metric, severity, k, event_id, us, us AS last, true AS emitted FROM r WHERE k = 1
      UNION ALL SELECT r.metric, r.severity, r.k, r.event_id, r.us,
        CASE WHEN r.us - w.last > 1800000000 THEN r.us ELSE w.last END, r.us - w.last > 1800000000
      FROM walk w JOIN r ON r.metric = w.metric AND r.severity = w.severity AND r.k = w.k + 1)
    SELECT event_id, metric, severity, us FROM walk WHERE emitted"""


@query("alert_cooldown", "metric", "RECURSIVE " + ALERT_WALK_SQL)
def alert_cooldown(spark, sf):
    a = alerts(spark, sf).select("event_id", "metric", "severity", "us")
    return telemetry.emitted_alerts(a, ["metric", "severity"], wait_seconds=1800, chunk_us=5 * views.DAY_US)


@query("alert_flapping", "metric", _ALERT_SQL + """ SELECT event_id, metric, us, count(*) OVER w AS recent, count(*) OVER w > 5 AS is_flapping
    FROM alert WINDOW w AS (PARTITION BY metric ORDER BY us RANGE BETWEEN 10799999999 PRECEDING AND CURRENT ROW)""")
def alert_flapping(spark, sf):
    return telemetry.flapping(alerts(spark, sf).select("event_id", "metric", "us"), "metric", minutes=180)


@query("memory_trend", "metric", """r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY us DESC, event_id DESC) AS k FROM metric),
    l AS (SELECT *, count(*) OVER (PARTITION BY name) AS n FROM r WHERE k <= 10),
    a AS (SELECT name, count(*) AS readings, (avg(value) FILTER (k <= 2) - avg(value) FILTER (k > n - 2)) / greatest(1, count(*) - 1) AS slope,
      arg_min(value, k) AS cur, avg(value) AS av, min(value) AS mn, max(value) AS mx FROM l GROUP BY name)
    SELECT name, readings, round(slope, 2) AS per_reading, cur AS current, round(av, 6) AS avg, mn AS min, mx AS max,
    CASE WHEN readings < 2 THEN 'insufficient_data' WHEN abs(slope) < 1 THEN 'stable' WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END AS trend FROM a""")
def memory_trend(spark, sf):
    t = telemetry.memory_trend(views.metrics(spark, sf), ["name"], [F.desc("us"), F.desc("event_id")], "value")
    return rounded(rounded(t, "avg"), "per_reading", digits=2)


def _sustained_sql(width, part, cond, hold):
    return f"""p AS (SELECT client % 10 AS service, us // {width} AS slot, count(*) FILTER ({part}) / count(*) AS ratio
      FROM req GROUP BY 1, 2), b AS (SELECT *, slot - row_number() OVER (PARTITION BY service ORDER BY slot) AS run FROM p WHERE {cond})
    SELECT service, min(slot) AS first_slot, max(slot) AS last_slot, count(*) AS windows, round(max(ratio), 6) AS peak_ratio
    FROM b GROUP BY service, run HAVING count(*) >= {hold}"""


@query("sustained_error_ratio", "req", _sustained_sql(21600000000, "is_error", "ratio > 0.05", 2))
def sustained_error_ratio(spark, sf):
    log = views.events(spark, sf).withColumn("service", F.col("client") % 10)
    return rounded(telemetry.sustained_ratio(log, ["service"], 21_600_000_000, F.col("is_error"), F.lit(True),
                                             lambda r: r > 0.05, 2), "peak_ratio")


@query("sustained_low_cache", "req", _sustained_sql(21600000000, "event_id % 3 <> 0", "ratio < 0.5", 2))
def sustained_low_cache(spark, sf):
    log = views.events(spark, sf).withColumn("service", F.col("client") % 10)
    return rounded(telemetry.sustained_ratio(log, ["service"], 21_600_000_000, F.col("event_id") % 3 != 0, F.lit(True),
                                             lambda r: r < 0.5, 2), "peak_ratio")


@query("failure_streaks", "req", """m AS (SELECT *, sum(CASE WHEN ms > 30 THEN 0 ELSE 1 END) OVER (PARTITION BY client ORDER BY us, event_id) AS g FROM req)
    SELECT client, count(*) AS streak_length, min(us) AS from_us, max(us) AS to_us FROM m WHERE ms > 30 GROUP BY client, g HAVING count(*) >= 5""")
def failure_streaks(spark, sf):
    log = views.events(spark, sf).withColumn("slot", F.expr(f"us div {views.DAY_US}"))
    return ordered.streaks(log, ["client"], [["slot"]], ["us", "event_id"], F.col("ms") > 30,
                           [F.min("us").alias("from_us"), F.max("us").alias("to_us")], 5).drop("streak_id")


@query("newest_events", "req", """SELECT endpoint, event_id, us, ms, age_rank FROM (SELECT *, row_number() OVER (PARTITION BY endpoint
    ORDER BY us DESC, event_id DESC) AS age_rank FROM req) WHERE age_rank <= 25""")
def newest_events(spark, sf):
    return telemetry.newest(views.events(spark, sf).select("endpoint", "event_id", "us", "ms"), ["endpoint"],
                            [F.desc("us"), F.desc("event_id")], 25)


@query("sample_alerts", "req", """s AS (SELECT event_id, NOT is_error AS healthy, ms / 10 AS seconds, agent / 500 AS error_rate, agent AS queue FROM req)
    SELECT event_id, 'health_check_failed' AS type, 'critical' AS severity, 1.0::DOUBLE AS observed FROM s WHERE NOT healthy
    UNION ALL SELECT event_id, 'slow_response_time', CASE WHEN seconds > 10 THEN 'critical' ELSE 'warning' END, round(seconds, 6) FROM s WHERE seconds > 5
    UNION ALL SELECT event_id, 'high_error_rate', CASE WHEN error_rate > 0.10 THEN 'critical' ELSE 'warning' END, round(error_rate, 6) FROM s WHERE error_rate > 0.05
    UNION ALL SELECT event_id, 'large_queue_size', CASE WHEN queue > 100 THEN 'critical' ELSE 'warning' END, queue FROM s WHERE queue > 50""")
def sample_alerts(spark, sf):
    s = views.events(spark, sf).select("event_id", (~F.col("is_error")).alias("healthy"), (F.col("ms") / 10).alias("seconds"),
                                       (F.col("agent") / 500).alias("error_rate"), F.col("agent").alias("queue"))
    return rounded(telemetry.sample_alerts(s).select("event_id", "type", "severity", "observed"), "observed")


_KINDS = ["rate_limit_error", "search_timeout", "crawl_timeout", "search_api_error", "company_not_found",
          "insufficient_data", "connection_error", "value_error"]
_KIND_SQL = "([" + ", ".join(f"'{k}'" for k in _KINDS) + "])[agent % 8 + 1]"
_CLASS_SQL = f"""f AS (SELECT event_id, {_KIND_SQL} AS kind, CASE WHEN event_id % 2 = 0 THEN 'Service unavailable' ELSE 'bad key' END AS msg FROM req),
    c AS (SELECT event_id, kind, CASE kind WHEN 'rate_limit_error' THEN 'rate_limit' WHEN 'search_timeout' THEN 'timeout' WHEN 'crawl_timeout' THEN 'timeout'
      WHEN 'search_api_error' THEN CASE WHEN event_id % 2 = 0 THEN 'transient' ELSE 'permanent' END WHEN 'company_not_found' THEN 'not_found'
      WHEN 'insufficient_data' THEN 'data_quality' WHEN 'connection_error' THEN 'transient' ELSE 'permanent' END AS failure_class FROM f)"""


def failures(spark, sf):
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), F.col("agent") % 8 + 1)
    msg = F.when(F.col("event_id") % 2 == 0, "Service unavailable").otherwise("bad key")
    return views.events(spark, sf).select("event_id", kind.alias("kind"), msg.alias("message")).withColumn(
        "failure_class", telemetry.failure_class(F.col("kind"), F.col("message")))


@query("failure_classes", "req", _CLASS_SQL + """ SELECT kind, failure_class, failure_class IN ('transient', 'timeout', 'rate_limit', 'data_quality') AS retryable,
    count(*) AS n FROM c GROUP BY ALL""")
def failure_classes(spark, sf):
    return failures(spark, sf).groupBy("kind", "failure_class", telemetry.is_retryable(F.col("failure_class")).alias("retryable")).agg(
        F.count(F.lit(1)).alias("n"))


@query("retry_delays", "req", _CLASS_SQL + """ SELECT event_id, attempt, least(CASE failure_class WHEN 'rate_limit' THEN 3.0 WHEN 'timeout' THEN 0.5 ELSE 1.0 END
    * pow(2, attempt), 60) AS delay FROM c, range(0, 6) t(attempt) WHERE failure_class IN ('transient', 'timeout', 'rate_limit', 'data_quality')""")
def retry_delays(spark, sf):
    f = failures(spark, sf).filter(telemetry.is_retryable(F.col("failure_class")))
    return telemetry.retry_delays(f, attempts=6).select("event_id", F.col("attempt").cast("long").alias("attempt"), "delay")


@query("threshold_compare", "req", """SELECT event_id, CASE agent % 3 WHEN 0 THEN ms < 20 WHEN 1 THEN ms > 20 ELSE abs(ms - 20) < 0.001 END AS met FROM req""")
def threshold_compare(spark, sf):
    op = F.element_at(F.array(F.lit("less"), F.lit("greater"), F.lit("equal")), F.col("agent") % 3 + 1)
    return views.events(spark, sf).select("event_id", telemetry.compare(F.col("ms"), op, F.lit(20.0)).alias("met"))


@query("resource_limits", "req", """SELECT event_id, ms * 3 <= 512 AND agent <= 80 AND client <= 100 AND event_id % 60 <= 50 AS within_limits,
    concat_ws(',', CASE WHEN ms * 3 > 409.6 THEN 'memory' END, CASE WHEN agent > 56 THEN 'cpu' END, CASE WHEN client > 80 THEN 'connections' END) AS warnings FROM req""")
def resource_limits(spark, sf):
    ok, warn = telemetry.resource_check(F.col("ms") * 3, F.col("agent"), F.col("client"), F.col("event_id") % 60)
    return views.events(spark, sf).select("event_id", ok.alias("within_limits"), F.array_join(warn, ",").alias("warnings"))


@query("crawl_politeness", "req", """g AS (SELECT event_id, client, us, lag(us) OVER (PARTITION BY client ORDER BY us, event_id) AS prev_us,
    1 + (agent % 3) * 7200 AS delay FROM req)
    SELECT event_id, client, delay, round((us - prev_us) / 1e6, 6) AS gap, prev_us IS NULL OR (us - prev_us) / 1e6 >= delay AS polite,
    round(CASE WHEN prev_us IS NULL OR (us - prev_us) / 1e6 >= delay THEN 0 ELSE delay - (us - prev_us) / 1e6 END, 6) AS wait FROM g""")
def crawl_politeness(spark, sf):
    from firmlens.operators import crawl
    log = views.events(spark, sf).select("event_id", "client", "us", (1 + (F.col("agent") % 3) * 7200).cast("long").alias("delay"))
    return rounded(crawl.politeness(log, ["client"], "delay"), "gap", "wait").select(
        "event_id", "client", "delay", "gap", "polite", "wait")


@query("crawl_hour_counts", "req", """RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY us, event_id) AS k FROM req),
    walk AS (SELECT client, k, event_id, us AS anchor, 1 AS n FROM r WHERE k = 1
      UNION ALL SELECT r.client, r.k, r.event_id, CASE WHEN r.us - w.anchor >= 86400000000 THEN r.us ELSE w.anchor END,
        CASE WHEN r.us - w.anchor >= 86400000000 THEN 1 ELSE w.n + 1 END FROM walk w JOIN r ON r.client = w.client AND r.k = w.k + 1)
    SELECT event_id, client, CAST(n AS BIGINT) AS hour_count, n > 3 AS over_limit FROM walk""")
def crawl_hour_counts(spark, sf):
    from firmlens.operators import crawl
    log = views.events(spark, sf).select("event_id", "client", "us")
    return crawl.hourly_counts(log, ["client"], limit=3, width_us=views.DAY_US, chunk_us=7 * views.DAY_US).select(
        "event_id", "client", "hour_count", "over_limit")


@query("request_intervals", "req", """g AS (SELECT *, us - lag(us) OVER (PARTITION BY client ORDER BY us, event_id) AS gap,
    row_number() OVER (PARTITION BY client ORDER BY us DESC, event_id DESC) AS k FROM req)
    SELECT client, count(gap) AS intervals, round(var_pop(gap / 1e6), 3) AS variance FROM g WHERE k <= 10 GROUP BY client""")
def request_intervals(spark, sf):
    from firmlens.operators import abuse
    return rounded(abuse.recent_interval_variance(views.events(spark, sf), ["client"]), "variance", digits=3)


@query("requests_in_window", "req", """SELECT event_id, client, count(*) OVER (PARTITION BY client ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS in_window FROM req""")
def requests_in_window(spark, sf):
    return ordered.trailing_counts(views.events(spark, sf).select("event_id", "client", "us"), ["client"], "us", views.DAY_US).drop("us")
