"""Small fixed tables: thresholds, targets, rules, keywords.

Each is a plain list so that callers may pass their own rows instead.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def frame(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """Table of literal rows; unlike a parallelized list it has a size Catalyst knows."""
    fields = [f.strip().split(" ") for f in ddl.split(",")]
    items = [F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(row, fields)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*items)))


# Metric, warning limit, critical limit.
METRIC_THRESHOLDS = [
    ("cpu_percent", 70.0, 85.0), ("memory_percent", 80.0, 90.0), ("disk_usage_percent", 80.0, 90.0),
    ("response_time_ms", 1000.0, 5000.0), ("error_rate_percent", 1.0, 5.0),
    ("request_rate_per_minute", 1000.0, 2000.0)]
METRIC_THRESHOLDS_DDL = "metric string, warning double, critical double"

# Service level, metric, target, alert limit, window hours, direction.
SERVICE_LEVELS = [
    ("api_availability", "request_success_rate", 99.9, 99.0, 24, "above"),
    ("response_time", "response_time_p95", 1000.0, 1500.0, 1, "below"),
    ("error_rate", "error_rate_percent", 1.0, 2.0, 1, "below"),
    ("system_availability", "uptime_percent", 99.9, 99.5, 24, "above")]
SERVICE_LEVELS_DDL = "sla string, metric string, target double, alert_limit double, hours int, direction string"

# Bottleneck, series, limit on its average, divisor giving severity.
BOTTLENECKS = [
    ("cpu_bound", "cpu_usage", 70.0, 100.0), ("memory_bound", "memory_usage", 80.0, 100.0),
    ("io_bound", "response_time", 5.0, 30.0), ("concurrency_limited", "queue_depth", 10.0, 100.0),
    ("resource_contention", "connection_pool_usage", 80.0, 100.0)]

# What to do about each bottleneck, in order, and whether it can be done automatically.
RECOMMENDATIONS = [
    ("cpu_bound", 1, "Reduce concurrent extraction tasks", True), ("cpu_bound", 2, "Enable request queuing", True),
    ("cpu_bound", 3, "Optimize parsing algorithms", False),
    ("memory_bound", 1, "Enable memory optimization", True), ("memory_bound", 2, "Reduce batch sizes", True),
    ("memory_bound", 3, "Clear cache more frequently", True),
    ("io_bound", 1, "Increase connection pool size", True), ("io_bound", 2, "Reduce request timeouts", True),
    ("io_bound", 3, "Enable HTTP/2", True),
    ("rate_limited", 1, "Implement exponential backoff", True), ("rate_limited", 2, "Reduce request rate", True),
    ("rate_limited", 3, "Implement request prioritization", True),
    ("concurrency_limited", 1, "Increase worker count", True), ("concurrency_limited", 2, "Implement task prioritization", True),
    ("concurrency_limited", 3, "Optimize task processing time", False),
    ("resource_contention", 1, "Increase connection pool size", True), ("resource_contention", 2, "Implement connection recycling", True),
    ("resource_contention", 3, "Monitor connection leaks", True)]
RECOMMENDATIONS_DDL = "bottleneck string, step int, action string, automated boolean"

# Upper bounds of duration buckets in seconds.
DURATION_BUCKETS = [0.1, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 120.0]

# Seconds a cached entry of a kind stays valid.
CACHE_SECONDS = {"company": 86400, "serp": 21600, "crawl": 43200, "batch": 21600, "performance": 300,
                 "default": 3600}

# Rule, requests, window seconds, endpoint prefixes, priority (the lowest number is checked first).
RATE_RULES = [
    ("search_endpoint_strict", 10, 60, ["/api/v1/search", "/api/v1/search/batch"], 10),
    ("crawl_endpoint_moderate", 20, 60, ["/api/v1/crawl"], 20),
    ("company_endpoint_generous", 50, 60, ["/api/v1/company/extract", "/api/v1/company/batch_extract"], 30),
    ("global_per_ip", 100, 60, None, 100),
    ("burst_protection", 200, 300, None, 5)]
