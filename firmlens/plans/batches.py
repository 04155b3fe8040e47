"""Queries over batches of companies and over caches."""
from __future__ import annotations

from pyspark.sql import functions as F

from firmlens.operators import batches, caching, telemetry
from firmlens.plans import views
from firmlens.plans.registry import query
from firmlens.plans.telemetry import rounded
from firmlens.sources import sinks


@query("distinct_batch_names", "batch_item", """SELECT batch_id, arg_min(trim(company), pos) AS company, min(pos) AS pos FROM batch_item GROUP BY batch_id, lower(trim(company))""")
def distinct_batch_names(spark, sf):
    return batches.distinct_names(views.batch_items(spark, sf), "batch_id", "company", "pos")


@query("backlog_order", "batch_item", """SELECT pos, priority, row_number() OVER (ORDER BY CASE priority WHEN 'urgent' THEN 1 WHEN 'high' THEN 2 WHEN 'low' THEN 4 ELSE 3 END,
    created_us, pos) AS queue_pos FROM batch_item""")
def backlog_order(spark, sf):
    return batches.backlog_order(views.batch_items(spark, sf).select("pos", "priority", "created_us")).drop("created_us")


@query("submit_chunks", "batch_item", "SELECT batch_id, pos, CAST(ceil(row_number() OVER (PARTITION BY batch_id ORDER BY pos) / 20) AS BIGINT) AS chunk FROM batch_item")
def submit_chunks(spark, sf):
    return batches.submit_chunks(views.batch_items(spark, sf).select("batch_id", "pos"), "batch_id", "pos")


_SUMMARY = """s AS (SELECT batch_id, count(*) AS total_companies, count(*) FILTER (success) AS successful, count(*) FILTER (success) / count(*) * 100 AS success_rate,
    avg(confidence) FILTER (success) AS avg_confidence, avg(seconds) AS avg_seconds, count(*) FILTER (success AND has_contact) AS with_contact,
    count(*) FILTER (success AND n_social > 0) AS with_social, count(*) FILTER (success AND n_people > 0) AS with_people,
    CASE WHEN count(*) FILTER (success) = count(*) THEN 'completed' WHEN count(*) FILTER (success) > 0 THEN 'partially_completed' ELSE 'failed' END AS status
    FROM batch_item GROUP BY batch_id)"""


@query("batch_summaries", "batch_item", _SUMMARY + """ SELECT batch_id, total_companies, successful, round(success_rate, 6) AS success_rate, round(avg_confidence, 6) AS avg_confidence,
    round(avg_seconds, 6) AS avg_seconds, with_contact, with_social, with_people, status FROM s""")
def batch_summaries(spark, sf):
    return rounded(batches.summaries(views.batch_items(spark, sf), "batch_id"), "success_rate", "avg_confidence", "avg_seconds")


@query("company_batch_outcomes", "batch_item", """SELECT company_id, count(*) AS total_companies, count(*) FILTER (success) AS successful,
    CASE WHEN count(*) FILTER (success) > 0 THEN round(avg(seconds), 6) END AS avg_seconds,
    CASE WHEN count(*) FILTER (success) = count(*) THEN 'completed' WHEN count(*) FILTER (success) > 0 THEN 'partially_completed' ELSE 'failed' END AS status
    FROM batch_item GROUP BY company_id""")
def company_batch_outcomes(spark, sf):
    s = batches.summaries(views.batch_items(spark, sf), "company_id")
    return rounded(s.select("company_id", "total_companies", "successful", "avg_seconds", "status"), "avg_seconds")


@query("batch_distributions", "batch_item", """SELECT batch_id, 'industry' AS field, industry AS value, count(*) AS n FROM batch_item WHERE success AND industry IS NOT NULL GROUP BY ALL
    UNION ALL SELECT batch_id, 'company_size', company_size, count(*) FROM batch_item WHERE success AND company_size IS NOT NULL GROUP BY ALL""")
def batch_distributions(spark, sf):
    return batches.distributions(views.batch_items(spark, sf), "batch_id", ["industry", "company_size"])


@query("batch_service_statistics", "batch_item", """s AS (SELECT company_id, count(*) AS n, count(*) FILTER (success) AS ok FROM batch_item GROUP BY company_id)
    SELECT count(*) AS total_batches, count(*) FILTER (ok = n) AS completed, count(*) FILTER (ok > 0 AND ok < n) AS partially_completed, count(*) FILTER (ok = 0) AS failed,
    round(count(*) FILTER (ok = n) / count(*) * 100, 6) AS success_rate FROM s""")
def batch_service_statistics(spark, sf):
    return rounded(batches.service_statistics(batches.summaries(views.batch_items(spark, sf), "company_id")), "success_rate")


@query("status_counts", "batch_item", "SELECT status_code, priority, count(*) AS n FROM batch_item GROUP BY ALL")
def status_counts(spark, sf):
    return views.batch_items(spark, sf).groupBy("status_code", "priority").agg(F.count(F.lit(1)).alias("n"))


@query("batch_progress", "batch_item", """p AS (SELECT batch_id, pos, count(*) OVER (PARTITION BY batch_id) AS total, count(*) OVER w AS done, CAST(sum(CASE WHEN success THEN 0 ELSE 1 END) OVER w AS BIGINT) AS failed,
    CAST(sum(CAST(round(seconds * 100000) AS BIGINT)) OVER w AS BIGINT) / 100000 AS elapsed FROM batch_item WINDOW w AS (PARTITION BY batch_id ORDER BY created_us, pos ROWS UNBOUNDED PRECEDING))
    SELECT batch_id, pos, total, done, failed, round((done - failed) / done * 100, 6) AS success_rate, round(elapsed / done, 6) AS avg_seconds,
    CASE WHEN done < total THEN round(elapsed / done * (total - done), 4) END AS seconds_left FROM p""")
def batch_progress(spark, sf):
    p = batches.progress(views.batch_items(spark, sf), "batch_id")
    return rounded(rounded(p, "success_rate", "avg_seconds"), "seconds_left", digits=4)


@query("extraction_statistics", "batch_item", """SELECT priority, count(*) AS requests, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed,
    round(avg(seconds) FILTER (success), 6) AS avg_seconds, round(avg(confidence) FILTER (success), 6) AS avg_confidence, count(DISTINCT lower(company)) FILTER (success) AS companies,
    round(count(*) FILTER (success) / count(*), 3) AS success_rate, round(1 - count(*) FILTER (success) / count(*), 3) AS failure_rate FROM batch_item GROUP BY priority""")
def extraction_statistics(spark, sf):
    return rounded(batches.extraction_statistics(views.batch_items(spark, sf), ["priority"]), "avg_seconds", "avg_confidence")


_RESULT_SQL = """res AS (SELECT b.pos, b.batch_id, trim(b.company) AS company, b.success, b.seconds, b.confidence, b.industry, b.company_size, b.n_social, b.n_people, c.description, c.founded_year,
    c.employees, c.email, c.phone, c.address, c.city, c.country, c.quality, c.completeness, CASE WHEN success THEN '' WHEN pos % 2 = 0 THEN 'timed out; retry failed' ELSE 'blocked' END AS errs,
    CASE WHEN pos % 3 = 0 THEN 'low quality' ELSE '' END AS warns FROM batch_item b JOIN company c ON b.company_id = c.company_id)"""


def results(spark, sf):
    b = views.batch_items(spark, sf).select("pos", "batch_id", F.trim("company").alias("company"), "success", "seconds", "confidence", "industry", "company_size",
                                            "n_social", "n_people", "company_id")
    c = views.companies(spark, sf).select("company_id", "description", "founded_year", "employees", "email", "phone", "address", "city", "country", "quality", "completeness")
    err = lambda t, m: F.struct(F.lit(t).alias("error_type"), F.lit(m).alias("error_message"))
    none = F.array().cast("array<struct<error_type:string,error_message:string>>")
    return b.join(c, "company_id").withColumns({
        "errors": F.when(F.col("success"), none).when(F.col("pos") % 2 == 0, F.array(err("Timeout", "timed out"), err("Retry", "retry failed")))
        .otherwise(F.array(err("Blocked", "blocked"))),
        "warnings": F.when(F.col("pos") % 3 == 0, F.array(F.lit("low quality"))).otherwise(F.array().cast("array<string>"))})


@query("batch_export_sheet", "batch_item company", _RESULT_SQL + """ SELECT company AS "Company Name", success AS "Success", seconds AS "Processing Time (s)",
    coalesce(CASE WHEN success THEN description END, '') AS "Description", coalesce(CASE WHEN success THEN industry END, '') AS "Industry", CASE WHEN success THEN founded_year END AS "Founded Year",
    CASE WHEN success THEN employees END AS "Employee Count", coalesce(CASE WHEN success THEN company_size END, '') AS "Company Size", coalesce(CASE WHEN success THEN email END, '') AS "Email",
    coalesce(CASE WHEN success THEN phone END, '') AS "Phone", coalesce(CASE WHEN success THEN address END, '') AS "Address", coalesce(CASE WHEN success THEN city END, '') AS "City",
    coalesce(CASE WHEN success THEN country END, '') AS "Country", CASE WHEN success THEN n_social ELSE 0 END AS "Social Media Count", CASE WHEN success THEN n_people ELSE 0 END AS "Key Personnel Count",
    CASE WHEN success THEN confidence ELSE 0 END AS "Confidence Score", round(CASE WHEN success THEN quality ELSE 0 END, 6) AS "Data Quality Score",
    round(CASE WHEN success THEN completeness ELSE 0 END, 6) AS "Completeness Score", errs AS "Errors", warns AS "Warnings" FROM res""")
def batch_export_sheet(spark, sf):
    return rounded(batches.export_rows(results(spark, sf)), "Data Quality Score", "Completeness Score")


@query("batch_csv_sheet", "batch_item company", _RESULT_SQL + """ SELECT company AS "Company Name", success AS "Success", coalesce(CASE WHEN success THEN description END, '') AS "Basic Info - Description",
    coalesce(CASE WHEN success THEN CAST(founded_year AS VARCHAR) END, '') AS "Basic Info - Founded Year", coalesce(CASE WHEN success THEN email END, '') AS "Contact - Email",
    errs AS "Errors", warns AS "Warnings" FROM res""")
def batch_csv_sheet(spark, sf):
    r = batches.export_rows(results(spark, sf))
    return r.select("Company Name", "Success", F.col("Description").alias("Basic Info - Description"),
                    F.coalesce(F.col("Founded Year").cast("string"), F.lit("")).alias("Basic Info - Founded Year"), F.col("Email").alias("Contact - Email"), "Errors", "Warnings")


@query("batch_json_lines", "batch_item", """SELECT batch_id, 0 AS part, CAST(NULL AS BIGINT) AS pos, CAST(count(*) AS VARCHAR) AS mark FROM batch_item GROUP BY 1
    UNION ALL SELECT batch_id, 1, pos, trim(company) FROM batch_item""")
def batch_json_lines(spark, sf):
    r = results(spark, sf)
    lines = sinks.batch_documents(r, batches.summaries(views.batch_items(spark, sf), "batch_id"), "batch_id")
    return lines.select("batch_id", "part", "pos", F.coalesce(F.get_json_object("line", "$.company_name"), F.get_json_object("line", "$.summary.total_companies")).alias("mark"))


@query("response_flags", "batch_item company", _RESULT_SQL + """ SELECT pos, errs <> '' AS has_errors, warns <> '' AS has_warnings,
    CASE WHEN errs = '' THEN '' WHEN pos % 2 = 0 THEN 'Retry, Timeout' ELSE 'Blocked' END AS error_summary FROM res""")
def response_flags(spark, sf):
    from firmlens.operators import validation
    return validation.response_flags(results(spark, sf)).select("pos", "has_errors", "has_warnings", "error_summary")


@query("rerun_requests", "company_request", """f AS (SELECT *, (['timeout', 'rate_limit', 'data_quality', 'not_found', 'permanent', 'transient'])[request_id % 6 + 1] AS k FROM company_request),
    v AS (SELECT *, unnest(CASE WHEN k = 'not_found' THEN [company_name, replace(replace(replace(company_name, ' Inc', ''), ' LLC', ''), ' Corp', ''),
      replace(replace(company_name, ' Company', ''), ' Co.', '')] ELSE [company_name] END) AS search_name FROM f WHERE k IN ('timeout', 'rate_limit', 'data_quality', 'not_found'))
    SELECT request_id, k AS failure_class, search_name, CASE WHEN k <> 'not_found' THEN domain END AS domain,
    round(CASE WHEN k = 'timeout' THEN greatest(timeout_seconds * 0.7::DOUBLE, 10) ELSE timeout_seconds END, 4) AS timeout_seconds,
    CASE WHEN k = 'timeout' THEN greatest(max_pages_to_crawl // 2, 1) WHEN k = 'data_quality' THEN least(max_pages_to_crawl + 2, 10) ELSE max_pages_to_crawl END AS max_pages_to_crawl,
    CASE WHEN k = 'timeout' THEN 'basic' WHEN k = 'data_quality' THEN 'comprehensive' ELSE extraction_mode END AS extraction_mode,
    k = 'data_quality' OR include_social_media AS include_social_media FROM v""")
def rerun_requests(spark, sf):
    r = views.company_requests(spark, sf)
    kind = F.element_at(F.array(*[F.lit(k) for k in ("timeout", "rate_limit", "data_quality", "not_found", "permanent", "transient")]), (F.col("request_id") % 6 + 1).cast("int"))
    out = batches.rerun_requests(r, r.select("request_id", kind.alias("failure_class")))
    return rounded(out.select("request_id", "failure_class", "search_name", "domain", "timeout_seconds", "max_pages_to_crawl", "extraction_mode", "include_social_media"), "timeout_seconds", digits=4)


@query("domain_hints", "company_request", """SELECT request_id, company_name, CASE WHEN request_id % 5 = 0 THEN 'hint' || c_custkey || '.org' END AS hint FROM company_request
    LEFT JOIN customer ON company_name = 'Customer ' || c_custkey || ' Inc'""")
def domain_hints(spark, sf):
    k = F.col("c_custkey").cast("string")
    hints = views.table(spark, sf, "customer").select(F.concat(F.lit("Customer "), k, F.lit(" Inc")).alias("company_name"), F.concat(F.lit("hint"), k, F.lit(".org")).alias("hint"))
    return batches.with_domain_hint(views.company_requests(spark, sf).select("request_id", "company_name"), hints, "company_name")


@query("cached_companies", "batch_item", "SELECT batch_id, count(*) AS cached FROM batch_item WHERE company_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) GROUP BY batch_id")
def cached_companies(spark, sf):
    cached = views.table(spark, sf, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("company_id"))
    return views.batch_items(spark, sf).join(cached, "company_id", "left_semi").groupBy("batch_id").agg(F.count(F.lit(1)).alias("cached"))


@query("uncached_companies", "batch_item", "SELECT batch_id, pos, company_id FROM batch_item WHERE company_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def uncached_companies(spark, sf):
    cached = views.table(spark, sf, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("company_id"))
    return views.batch_items(spark, sf).join(cached, "company_id", "left_anti").select("batch_id", "pos", "company_id")


@query("cache_warm_list", "batch_item", "SELECT company_id FROM batch_item WHERE priority = 'urgent' EXCEPT SELECT company_id FROM batch_item WHERE success")
def cache_warm_list(spark, sf):
    b = views.batch_items(spark, sf)
    return b.filter("priority = 'urgent'").select("company_id").subtract(b.filter("success").select("company_id"))


@query("cache_keys", "company_request", """SELECT request_id, 'company:' || md5(concat_ws('|', lower(trim(company_name)), nullif(lower(domain), ''), lower(extraction_mode))) AS company_key,
    'serp:' || md5(concat_ws('|', lower(trim(company_name)), lower(country), lower(language), CAST(max_pages_to_crawl AS VARCHAR))) AS search_key,
    'crawl:' || md5('https://' || coalesce(domain, 'none') || '/') AS crawl_key,
    'batch:' || md5(array_to_string(list_sort([lower(trim(company_name)), 'acme', 'zeta']), '|') || '|' || lower(extraction_mode)) AS batch_key FROM company_request""")
def cache_keys(spark, sf):
    r = views.company_requests(spark, sf)
    c = F.col
    return r.select("request_id", caching.company_key(c("company_name"), c("domain"), c("extraction_mode")).alias("company_key"),
                    caching.search_key(c("company_name"), c("country"), c("language"), c("max_pages_to_crawl")).alias("search_key"),
                    caching.crawl_key(F.concat(F.lit("https://"), F.coalesce("domain", F.lit("none")), F.lit("/"))).alias("crawl_key"),
                    caching.batch_key(F.array("company_name", F.lit(" Acme"), F.lit("zeta")), c("extraction_mode")).alias("batch_key"))


@query("cache_answers", "req", """k AS (SELECT event_id, us, client % 20 AS item, (['company', 'serp', 'crawl', 'performance', 'other'])[client % 5 + 1] AS kind,
      CASE client % 5 WHEN 0 THEN 86400 WHEN 1 THEN 21600 WHEN 2 THEN 43200 WHEN 3 THEN 300 ELSE 3600 END * 1000000::BIGINT AS ttl, event_id % 4 = 0 AS put FROM req),
    e AS (SELECT kind, item, us FROM k WHERE put),
    a AS (SELECT k.*, e.us AS cached_us FROM (SELECT * FROM k WHERE NOT put) k ASOF LEFT JOIN e ON k.kind = e.kind AND k.item = e.item AND k.us >= e.us)
    SELECT event_id, kind, item, CASE WHEN us - cached_us < ttl THEN cached_us END AS cached_us, coalesce(us - cached_us < ttl, false) AS hit FROM a""")
def cache_answers(spark, sf):
    kind = F.element_at(F.array(*[F.lit(k) for k in ("company", "serp", "crawl", "performance", "other")]), (F.col("client") % 5 + 1).cast("int"))
    e = views.events(spark, sf).select("event_id", "us", (F.col("client") % 20).alias("item"), kind.alias("kind"))
    return caching.cache_answers(e.filter("event_id % 4 <> 0"), e.filter("event_id % 4 = 0"), ["kind", "item"], "kind").drop("us")
