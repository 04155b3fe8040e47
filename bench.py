"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all),
BENCH_ALL=1 for every query.
"""
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = [
    "host_profiles", "page_parts", "document_sectors", "document_emails", "document_phones", "text_threats", "sanitized_text",
    "organic_results", "merged_ranks", "page_connections", "platform_filter_matches", "crawl_shortlist", "discovery_queries",
    "fused_companies", "fused_people", "fused_locations", "batch_summaries", "batch_progress", "backlog_order", "batch_export_sheet",
    "cache_answers", "company_intelligence", "industry_breakdown", "crm_upserts", "crm_new_contacts", "metric_statistics",
    "service_level_status", "alert_cooldown", "sustained_error_ratio", "failure_streaks", "rate_limit_verdicts", "abuse_profiles",
    "robots_verdicts", "access_verdicts", "kept_after_erasure", "compliance_report", "stream_rollups", "stream_rate_limits"]


def main():
    from pyspark.sql import SparkSession

    from firmlens.plans import catalog
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("firmlens-bench")
             .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g")).config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    names = list(catalog.QUERIES) if os.environ.get("BENCH_ALL") else HEADLINES
    spark.read.parquet(f"{sf}/nation.parquet").count()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total" if names is HEADLINES else "all_queries_total", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
