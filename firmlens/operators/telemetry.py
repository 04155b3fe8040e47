"""Request, metric and error log analytics."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmlens.operators import dimensions as dims
from firmlens.operators import ordered, sequential

SECOND = 1_000_000


def exclusive_cut(i: int, n: int):
    """Ranks and weight of the i-th of n exclusive quantile cuts."""
    p = F.lit(i) * (F.col("n") + 1)
    j = F.greatest(F.lit(1), F.least(F.floor(p / n), F.col("n") - 1))
    return j, p - j * n


def metric_statistics(samples: DataFrame, keys: list[str], value: str, time: list[str]) -> DataFrame:
    """Count, extremes, mean, median, deviation, p95/p99 and the last value."""
    (j95, d95), (j99, d99) = exclusive_cut(19, 20), exclusive_cut(99, 100)
    n = F.col("n")
    ranks = ordered.order_statistics(samples, keys, value, {
        "m1": F.floor((n + 1) / 2), "m2": F.floor(n / 2) + 1,
        "a": j95, "b": F.least(j95 + 1, n), "c": j99, "d": F.least(j99 + 1, n)})
    basic = samples.groupBy(*keys).agg(
        F.count(value).alias("count"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.avg(value).alias("avg"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std_dev"),
        F.max_by(value, F.struct(*time)).alias("last_value"), F.max(time[0]).alias("last_time"))
    both = ordered.join_null_safe(basic, ranks, keys)
    return both.select(
        *keys, "count", "min", "max", "avg", ((F.col("m1") + F.col("m2")) / 2).alias("median"), "std_dev",
        F.when(n >= 20, (F.col("a") * (20 - d95) + F.col("b") * d95) / 20).otherwise(F.col("max")).alias("p95"),
        F.when(n >= 100, (F.col("c") * (100 - d99) + F.col("d") * d99) / 100).otherwise(F.col("max")).alias("p99"),
        "last_value", "last_time")


def nearest_rank_p95(samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    at = F.floor(F.col("n") * 0.95)
    return ordered.order_statistics(samples, keys, value, {"p95": at + 1, "p95_clamped": F.least(at, F.col("n") - 1) + 1})


def load_run_summary(requests: DataFrame, keys: list[str]) -> DataFrame:
    """Success rate, response times and request rate of a load run (``ms``, ``us``, ``is_error``)."""
    n = F.col("n")
    stats = ordered.order_statistics(requests, keys, "ms", {
        "m1": F.floor((n + 1) / 2), "m2": F.floor(n / 2) + 1, "p95": F.least(F.floor(n * 0.95), n - 1) + 1})
    agg = requests.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~F.col("is_error")).alias("successful"),
        F.avg("ms").alias("mean_ms"), ((F.max("us") - F.min("us")) / SECOND).alias("seconds"))
    return ordered.join_null_safe(agg, stats.drop("n"), keys).select(
        *keys, "total", "successful", (F.col("successful") / F.col("total") * 100).alias("success_pct"),
        "mean_ms", ((F.col("m1") + F.col("m2")) / 2).alias("median_ms"), F.col("p95").alias("p95_ms"),
        F.when(F.col("seconds") > 0, F.col("total") / F.col("seconds")).otherwise(0.0).alias("per_second"))


def service_levels(samples: DataFrame, levels: DataFrame, as_of: int) -> DataFrame:
    """State of each service level over its own window before ``as_of`` (``name``, ``value``, ``us``)."""
    due = (samples.join(levels, F.col("name") == F.col("metric"))
           .filter((F.col("us") >= as_of - F.col("hours") * (3600 * SECOND)) & (F.col("us") <= as_of)))
    p95 = ordered.order_statistics(due.filter(F.startswith("metric", F.lit("response_time"))), ["sla"], "value",
                                   {"p95": F.floor(F.col("n") * 0.95) + 1}).drop("n")
    stats = due.groupBy("sla", "metric", "target", "alert_limit", "direction").agg(
        F.count(F.lit(1)).alias("samples"), F.avg("value").alias("mean"))
    value = F.when(F.startswith("metric", F.lit("response_time")), F.col("p95")).otherwise(F.col("mean"))
    good = lambda lim: F.when(F.col("direction") == "above", value >= lim).otherwise(value <= lim)
    return stats.join(p95, "sla", "left").select(
        "sla", "metric", "samples", value.alias("current_value"), "target",
        F.when(good(F.col("target")), "meeting").when(good(F.col("alert_limit")), "at_risk")
         .otherwise("breach").alias("status"))


def bottlenecks(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Overloaded resources per period, with severity 0..1."""
    def mean(series):
        return F.avg(F.when(F.col("name") == series, F.col("value")))
    agg = samples.groupBy(*keys).agg(
        *[mean(s).alias(s) for _, s, _, _ in dims.BOTTLENECKS],
        F.count_if(F.col("name") == "rate_limit_errors").alias("limited"),
        F.greatest(F.count_if(F.col("name") == "total_requests"), F.lit(1)).alias("total"))
    rate = F.col("limited") / F.col("total") * 100
    rows = [F.when(F.col(s) > limit, F.struct(F.lit(kind).alias("bottleneck"),
                                              F.least(F.col(s) / scale, F.lit(1.0)).alias("severity"),
                                              F.col(s).alias("observed")))
            for kind, s, limit, scale in dims.BOTTLENECKS]
    rows.append(F.when(rate > 1.0, F.struct(F.lit("rate_limited").alias("bottleneck"),
                                            F.least(rate / 10.0, F.lit(1.0)).alias("severity"),
                                            rate.alias("observed"))))
    return agg.select(*keys, F.explode(F.array_compact(F.array(*rows))).alias("b")).select(*keys, "b.*").withColumn(
        "priority", F.when(F.col("severity") > 0.7, "high").when(F.col("severity") > 0.4, "medium").otherwise("low"))


def optimization_recommendations(found: DataFrame, actions: DataFrame) -> DataFrame:
    """Bottlenecks with the actions against them, in order, and whether any can be taken automatically; kinds without actions are left out.

    ``actions`` (bottleneck, step, action, automated) is a short configuration table and can be replaced.
    """
    told = actions.groupBy("bottleneck").agg(F.array_sort(F.collect_list(F.struct("step", "action"))).alias("steps"), F.bool_or("automated").alias("automated_fixes_available"))
    return found.join(told, "bottleneck").withColumn("recommendations", F.col("steps.action")).drop("steps")


def bottleneck_alerts(found: DataFrame, actions: DataFrame) -> DataFrame:
    """Alerts on severe bottlenecks with the actions against them."""
    severe = found.filter("severity > 0.7").withColumn("alert", F.when(F.col("severity") > 0.8, "critical").otherwise("high"))
    told = actions.groupBy("bottleneck").agg(F.array_sort(F.collect_list(F.struct("step", "action"))).alias("steps"))
    return severe.join(told, "bottleneck", "left").withColumn("recommendations", F.coalesce(F.col("steps.action"), F.array().cast("array<string>"))).drop("steps")


def steps(value: Column, cuts: list[tuple[float, float]]) -> Column:
    """Deduction of the first limit exceeded."""
    out = F.lit(0.0)
    for limit, points in reversed(cuts):
        out = F.when(value > limit, F.lit(float(points))).otherwise(out)
    return out


def performance_grades(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Performance level and score per period."""
    series = ["response_time", "cpu_usage", "memory_usage", "error_rate"]
    agg = samples.groupBy(*keys).agg(*[F.avg(F.when(F.col("name") == s, F.col("value"))).alias(s) for s in series])
    level = (F.lit(100.0)
             - steps(F.col("response_time"), [(30, 50), (10, 30), (3, 15), (1, 5)])
             - steps(F.col("cpu_usage"), [(95, 25), (85, 15), (70, 10)])
             - steps(F.col("memory_usage"), [(95, 25), (85, 15), (80, 10)])
             - steps(F.col("error_rate"), [(10, 30), (5, 15), (1, 5)]))
    load = bottlenecks(samples, keys).groupBy(*keys).agg(
        F.sum("severity").alias("severities"), F.count_if(F.col("severity") > 0.8).alias("critical_bottlenecks"))
    score = (100.0 - F.coalesce(F.col("severities"), F.lit(0.0)) * 20
             - F.when(F.col("error_rate").isNull(), 0.0).otherwise(F.least(F.col("error_rate") * 2, F.lit(20.0))))
    return ordered.join_null_safe(agg.withColumn("points", level), load, keys).select(
        *keys, F.when(F.col("points") >= 90, "excellent").when(F.col("points") >= 75, "good")
        .when(F.col("points") >= 60, "acceptable").when(F.col("points") >= 40, "poor").otherwise("critical")
        .alias("level"), F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)).alias("score"),
        F.coalesce("critical_bottlenecks", F.lit(0)).alias("critical_bottlenecks"))


def top_errors(errors: DataFrame, as_of: int, keep_hours: int = 24, limit: int = 10,
               rate_minutes: int = 60) -> DataFrame:
    """Most frequent (operation, error type) pairs before ``as_of``."""
    recent = F.col("us") > as_of - 3600 * SECOND
    return (errors.filter((F.col("us") > as_of - keep_hours * 3600 * SECOND) & (F.col("us") <= as_of))
            .groupBy("operation", "error_type").agg(
                F.count(F.lit(1)).alias("errors"), F.count_if(recent).alias("recent"), F.max("us").alias("last_us"),
                (F.count_if(F.col("us") > as_of - rate_minutes * 60 * SECOND) / rate_minutes).alias("per_minute"))
            .orderBy(F.desc("errors"), "operation", "error_type").limit(limit))


def cache_statistics(lookups: DataFrame, keys: list[str]) -> DataFrame:
    hits, all_ = F.count_if("hit"), F.count(F.lit(1))
    return lookups.groupBy(*keys).agg(
        hits.alias("hits"), (all_ - hits).alias("misses"),
        F.when(all_ > 0, F.round(hits / all_ * 100, 2)).otherwise(0.0).alias("hit_rate"))


def hourly_performance(tasks: DataFrame) -> DataFrame:
    """Task totals and averages per hour (``us``, ``success``, ``seconds``, ``waited``)."""
    n = F.count(F.lit(1))
    return tasks.groupBy(F.expr("us div 3600000000").alias("hour")).agg(
        n.alias("tasks"), F.count_if("success").alias("successful"),
        F.round(F.count_if("success") / n * 100, 2).alias("success_pct"),
        F.avg("seconds").alias("avg_seconds"), F.avg("waited").alias("avg_waited"))


def newest(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The k first rows per key; each task keeps only k rows per key before the shuffle."""
    return (df.withColumn("age_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
            .filter(F.col("age_rank") <= k))


def health_rollup(checks: DataFrame) -> DataFrame:
    """Components per status and the worst status present (``component``, ``status``, ``us``)."""
    last = checks.groupBy("component").agg(F.max_by("status", F.struct("us", "event_id")).alias("status"))
    names = ["healthy", "degraded", "unhealthy", "critical"]
    worst = F.max(F.array_position(F.array(*[F.lit(s) for s in names]), F.col("status")))
    return last.agg(*[F.count_if(F.col("status") == s).alias(s) for s in names],
                    F.count(F.lit(1)).alias("components"),
                    F.element_at(F.array(*[F.lit(s) for s in names]), worst.cast("int")).alias("overall"))


def resource_status(cpu: Column, memory: Column, disk: Column) -> Column:
    return (F.when((cpu > 90) | (memory > 95) | (disk > 95), "unhealthy")
            .when((cpu > 80) | (memory > 90) | (disk > 85), "degraded").otherwise("healthy"))


def histogram(samples: DataFrame, keys: list[str], value: Column, bounds: list[float]) -> DataFrame:
    """Cumulative bucket counts per key; the last bucket is unbounded."""
    agg = samples.groupBy(*keys).agg(
        *[F.count_if(value <= b).alias(f"__b{i}") for i, b in enumerate(bounds)], F.count(value).alias("__total"))
    cells = [F.struct(F.lit(float(b)).alias("le"), F.col(f"__b{i}").alias("cumulative")) for i, b in enumerate(bounds)]
    cells.append(F.struct(F.lit(float("inf")).alias("le"), F.col("__total").alias("cumulative")))
    return agg.select(*keys, F.array(*cells).alias("buckets"))


def bucket_quantile(buckets: Column, q: float) -> Column:
    """Quantile interpolated inside the bucket that holds it."""
    total = F.element_at(buckets, -1)["cumulative"]
    rank = total * q
    at = F.array_position(F.transform(buckets, lambda b: b["cumulative"] >= rank), F.lit(True)).cast("int")
    upper = F.element_at(buckets, at)
    low_le = F.when(at > 1, F.try_element_at(buckets, at - 1)["le"]).otherwise(0.0)
    low_n = F.when(at > 1, F.try_element_at(buckets, at - 1)["cumulative"]).otherwise(0)
    inside = low_le + (upper["le"] - low_le) * (rank - low_n) / (upper["cumulative"] - low_n)
    return F.when(at == F.size(buckets), F.element_at(buckets, -2)["le"]).otherwise(inside)


def memory_trend(readings: DataFrame, keys: list[str], order: list[Column], value: str) -> DataFrame:
    """Direction of the last ten readings: mean of the last two against the first two."""
    last = newest(readings, keys, order, 10)
    size = F.count(F.lit(1))
    most = Window.partitionBy(*keys)
    marked = last.withColumn("n", F.count(F.lit(1)).over(most))
    slope = ((F.avg(F.when(F.col("age_rank") <= 2, F.col(value)))
              - F.avg(F.when(F.col("age_rank") > F.col("n") - 2, F.col(value)))) / F.greatest(F.lit(1), size - 1))
    out = marked.groupBy(*keys).agg(
        size.alias("readings"), slope.alias("per_reading"), F.max_by(value, -F.col("age_rank")).alias("current"),
        F.avg(value).alias("avg"), F.min(value).alias("min"), F.max(value).alias("max"))
    return out.withColumn("trend", F.when(F.col("readings") < 2, "insufficient_data")
                          .when(F.abs("per_reading") < 1, "stable")
                          .when(F.col("per_reading") > 0, "increasing").otherwise("decreasing"))


def sustained_ratio(log: DataFrame, keys: list[str], width: int, part: Column, whole: Column,
                    beyond, hold: int) -> DataFrame:
    """Stretches of at least ``hold`` consecutive windows whose ratio is out of bounds."""
    per = (log.withColumn("slot", F.floor(F.col("us") / width).cast("long")).groupBy(*keys, "slot")
           .agg(F.count_if(part).alias("part"), F.count_if(whole).alias("whole"))
           .filter(F.col("whole") > 0).withColumn("ratio", F.col("part") / F.col("whole")).filter(beyond(F.col("ratio"))))
    run = F.col("slot") - F.row_number().over(Window.partitionBy(*keys).orderBy("slot"))
    return (per.withColumn("run", run).groupBy(*keys, "run")
            .agg(F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"),
                 F.count(F.lit(1)).alias("windows"), F.max("ratio").alias("peak_ratio"))
            .filter(F.col("windows") >= hold).drop("run"))


def threshold_alerts(samples: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Samples at or above their warning or critical limit."""
    hit = (F.when(F.col("value") >= F.col("critical"), F.struct(F.lit("critical").alias("severity"), F.col("critical").alias("limit")))
           .when(F.col("value") >= F.col("warning"), F.struct(F.lit("warning").alias("severity"), F.col("warning").alias("limit"))))
    return (samples.join(thresholds, "metric").withColumn("hit", hit).filter("hit is not null")
            .select(*samples.columns, "hit.severity", "hit.limit"))


def emitted_alerts(alerts: DataFrame, keys: list[str], wait_seconds: int = 300,
                   chunk_us: int = 86_400_000_000) -> DataFrame:
    """Alerts that survive the per-key cooldown."""
    chunk_us = max(chunk_us, 10 * wait_seconds * SECOND)
    work = alerts.withColumn("chunk", F.floor(F.col("us") / chunk_us).cast("long"))
    out = sequential.chunked_scan(work, keys, "chunk", ["us", "event_id"], "us",
                                  sequential.cooldown_scan(wait_seconds * SECOND), "emitted boolean")
    return out.filter("emitted").drop("emitted", "chunk")


def flapping(alerts: DataFrame, name: str, minutes: int = 30, more_than: int = 5) -> DataFrame:
    """Alerts raised as the sixth or later of their name within half an hour."""
    return ordered.trailing_counts(alerts, [name], "us", minutes * 60 * SECOND - 1, "recent").withColumn(
        "is_flapping", F.col("recent") > more_than)


def compare(value: Column, operator: Column, limit: Column) -> Column:
    return (F.when(operator == "less", value < limit).when(operator == "greater", value > limit)
            .when(operator == "equal", F.abs(value - limit) < 0.001).otherwise(False))


def sample_alerts(samples: DataFrame) -> DataFrame:
    """Alert rows of one health and load sample (``healthy``, ``seconds``, ``error_rate``, ``queue``)."""
    def graded(kind, value, warn, crit):
        def one(sev):
            return F.struct(F.lit(kind).alias("type"), F.lit(sev).alias("severity"), value.cast("double").alias("observed"))
        return F.when(value > crit, one("critical")).when(value > warn, one("warning"))
    failed = F.when(~F.col("healthy"), F.struct(F.lit("health_check_failed").alias("type"),
                                                F.lit("critical").alias("severity"), F.lit(1.0).alias("observed")))
    rows = F.array_compact(F.array(failed, graded("slow_response_time", F.col("seconds"), 5.0, 10.0),
                                   graded("high_error_rate", F.col("error_rate"), 0.05, 0.10),
                                   graded("large_queue_size", F.col("queue"), 50, 100)))
    return samples.withColumn("a", F.explode(rows)).select(*samples.columns, "a.*")


def failure_class(kind: Column, message: Column) -> Column:
    """How a failure should be handled, from its type and text."""
    text = F.lower(message)
    passing = text.contains("timeout") | text.contains("temporary") | text.contains("unavailable") | text.contains("5")
    return (F.when(kind == "rate_limit_error", "rate_limit")
            .when(kind.isin("search_timeout", "crawl_timeout", "extraction_timeout", "timeout"), "timeout")
            .when(kind == "search_api_error", F.when(passing, "transient").otherwise("permanent"))
            .when(kind == "company_not_found", "not_found").when(kind == "insufficient_data", "data_quality")
            .when(kind.isin("connection_error", "os_error"), "transient").otherwise("permanent"))


def is_retryable(klass: Column) -> Column:
    return klass.isin("transient", "timeout", "rate_limit", "data_quality")


def retry_delays(failures: DataFrame, attempts: int = 3, base: float = 1.0, cap: float = 60.0) -> DataFrame:
    """One row per planned retry with its delay (``failure_class``)."""
    first = (F.when(F.col("failure_class") == "rate_limit", base * 3).when(F.col("failure_class") == "timeout", base * 0.5)
             .otherwise(base))
    return (failures.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))))
            .withColumn("delay", F.greatest(F.least(first * F.pow(F.lit(2.0), "attempt"), F.lit(cap)), F.lit(0.1))))


def resource_check(memory_mb: Column, cpu: Column, connections: Column, active: Column):
    """Whether usage is within limits, and which resources come near theirs."""
    ok = (memory_mb <= 512) & (cpu <= 80.0) & (connections <= 100) & (active <= 50)
    warn = F.array_compact(F.array(F.when(memory_mb > 512 * 0.8, "memory"), F.when(cpu > 80.0 * 0.7, "cpu"),
                                   F.when(connections > 100 * 0.8, "connections")))
    return ok, warn


def kpi_board(requests: DataFrame) -> DataFrame:
    """Latency, throughput, error and cache figures against target and alert limit."""
    n = F.count(F.lit(1))
    base = requests.agg(
        F.avg("seconds").alias("latency"), (n / F.greatest((F.max("us") - F.min("us")) / (3600 * SECOND), F.lit(0.1))).alias("throughput"),
        (F.count_if("is_error") / n * 100).alias("errors"), (F.count_if("hit") / n * 100).alias("cache"))
    p95 = ordered.order_statistics(requests, [], "seconds", {"p95": F.floor(F.col("n") * 0.95) + 1}).select("p95")

    both = base.unionByName(p95, allowMissingColumns=True)
    one = both.agg(*[F.max(c).alias(c) for c in both.columns])

    def row(kpi, value, watched, target, alert, up):
        good = value > target if up else value < target
        bad = watched < alert if up else watched > alert
        return F.struct(F.lit(kpi).alias("kpi"), value.alias("value"), good.alias("on_target"), bad.alias("alerting"))
    c = F.col
    return one.select(F.explode(F.array(
        row("latency_seconds", c("latency"), c("p95"), 30.0, 60.0, False),
        row("throughput_per_hour", c("throughput"), c("throughput"), 100.0, 50.0, True),
        row("error_percent", c("errors"), c("errors"), 1.0, 5.0, False),
        row("cache_hit_percent", c("cache"), c("cache"), 70.0, 50.0, True))).alias("k")).select("k.*")


def resource_report(points: DataFrame, keys: list[str], order: list[Column], limits: dict[str, float]) -> DataFrame:
    """Average of the last hundred points per series and its share of the limit."""
    limit = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])[F.col(keys[0])]
    return newest(points, keys, order, 100).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"), F.round(F.avg("value"), 2).alias("avg_value"),
        F.round(F.avg("value") / F.first(limit) * 100, 2).alias("utilisation_pct"))
