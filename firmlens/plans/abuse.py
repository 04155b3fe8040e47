"""Queries on rate limits, abuse, robots rules and blocked crawls."""
from __future__ import annotations

from pyspark.sql import functions as F

from firmlens.functions import urls
from firmlens.operators import abuse, crawl, validation
from firmlens.operators import dimensions as dims
from firmlens.operators.durable import stored
from firmlens.plans import views
from firmlens.plans.registry import ORACLES, query
from firmlens.plans.telemetry import AS_OF, rounded
from firmlens.plans.validation import text_threats  # noqa: F401  (its SQL is part of the rollup's)

_LIMITS = {"per_hour": 0.1, "endpoints": 4, "agents": 45, "errors": 0.1, "variance": 4e8}
_PROFILE = """g AS (SELECT *, us - lag(us) OVER (PARTITION BY client ORDER BY us, event_id) AS gap, row_number() OVER (PARTITION BY client ORDER BY us DESC, event_id DESC) AS k FROM req),
    v AS (SELECT client, var_pop(gap / 1e6) AS variance FROM g WHERE k <= 10 GROUP BY client),
    b AS (SELECT client, count(*) AS requests, count(DISTINCT endpoint) AS endpoints, count(DISTINCT agent) AS agents, count(*) FILTER (is_error) / count(*) AS error_rate,
      count(*) / greatest((max(us) - min(us)) / 3600e6, 0.1::DOUBLE) AS per_hour FROM req GROUP BY client),
    prof AS (SELECT b.*, least(CASE WHEN per_hour > 0.1 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN endpoints > 4 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN agents > 45 THEN 0.15::DOUBLE ELSE 0 END
      + CASE WHEN error_rate > 0.1 THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN requests > 11 AND variance < 4e8 THEN 0.1::DOUBLE ELSE 0 END, 1) AS score FROM b JOIN v ON b.client = v.client)"""


@query("abuse_profiles", "req", _PROFILE + " SELECT client, requests, endpoints, agents, round(error_rate, 6) AS error_rate, round(per_hour, 6) AS per_hour, round(score, 6) AS score, score >= 0.7 AS suspicious FROM prof")
def abuse_profiles(spark, sf):
    return rounded(abuse.abuse_profiles(views.events(spark, sf), ["client"], _LIMITS), "error_rate", "per_hour", "score")


_AGENTS = ["sqlmap/1.5", "Mozilla/5.0", "curl/7.68.0", "curl/7.68.0 custom", "python-requests/2.25.1", "Safari"]
_AGENT_SQL = "([" + ", ".join(f"'{a}'" for a in _AGENTS) + "])[client % 6 + 1]"


def with_agents(spark, sf):
    names = F.array(*[F.lit(a) for a in _AGENTS])
    return views.events(spark, sf).withColumn("user_agent", F.element_at(names, (F.col("client") % 6 + 1).cast("int")))


@query("activity_alerts", "req", f"""a AS (SELECT client, count(*) FILTER (us > {AS_OF} - 3600000000 AND us <= {AS_OF}) AS hour, count(*) FILTER (agent % 5 = 0) AS fails,
      regexp_matches(lower({_AGENT_SQL}), 'sqlmap|nmap|nikto|dirb|gobuster|python-requests/\\d+\\.\\d+\\.\\d+$|curl/\\d+\\.\\d+\\.\\d+$') AS scan, count(*) FILTER (is_error) / count(*) AS errors FROM req GROUP BY client),
    n AS (SELECT client, concat_ws(',', CASE WHEN hour > 0 THEN 'HIGH_REQUEST_RATE' END, CASE WHEN fails > 10 THEN 'MULTIPLE_AUTH_FAILURES' END, CASE WHEN scan THEN 'SUSPICIOUS_USER_AGENT' END,
      CASE WHEN errors > 0.5 THEN 'HIGH_ERROR_RATE' END) AS alerts FROM a) SELECT * FROM n WHERE alerts <> ''""")
def activity_alerts(spark, sf):
    log = with_agents(spark, sf).withColumn("auth_failed", F.col("agent") % 5 == 0)
    return abuse.activity_alerts(log, ["client"], AS_OF, busy=0).withColumn("alerts", F.array_join("alerts", ","))


_PATHS = {"view": "/api/v1/search", "click": "/api/v1/crawl/x", "purchase": "/api/v1/company/extract", "error": "/api/v1/search/batch", "signup": "/health"}
_PATH_SQL = "CASE endpoint " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _PATHS.items()) + " END"


@query("rate_rule_matches", "req", f"""r AS (SELECT event_id, {_PATH_SQL} AS path, {_AGENT_SQL} AS ua, client % 4 AS net FROM req),
    m AS (SELECT event_id, 'burst_protection' AS rule, 5 AS priority FROM r WHERE net <> 1 UNION ALL SELECT event_id, 'search_endpoint_strict', 10 FROM r WHERE path LIKE '/api/v1/search%'
      UNION ALL SELECT event_id, 'crawl_endpoint_moderate', 20 FROM r WHERE path LIKE '/api/v1/crawl%' UNION ALL SELECT event_id, 'company_endpoint_generous', 30 FROM r WHERE path LIKE '/api/v1/company/extract%'
      UNION ALL SELECT event_id, 'global_per_ip', 100 FROM r UNION ALL SELECT event_id, 'curl_agents', 15 FROM r WHERE lower(ua) LIKE '%curl%')
    SELECT event_id, rule, priority FROM m""")
def rate_rule_matches(spark, sf):
    rules = [(n, q, w, p, None, ["10.0.1.0/24", "10.9.9.9"] if n == "burst_protection" else None, pr) for n, q, w, p, pr in dims.RATE_RULES]
    rules.append(("curl_agents", 5, 60, None, ["CURL"], None, 15))
    paths = F.create_map(*[F.lit(x) for kv in _PATHS.items() for x in kv])
    log = with_agents(spark, sf).select("event_id", paths[F.col("endpoint")].alias("endpoint"), "user_agent",
                                        F.concat(F.lit("10.0."), (F.col("client") % 4).cast("string"), F.lit("."), (F.col("client") % 250).cast("string")).alias("ip"))
    return abuse.applicable_rules(log, rules).select("event_id", "rule", "priority")


@query("rate_limit_verdicts", "req", """RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY us, event_id) AS k FROM req),
    walk AS (SELECT client, k, event_id, [us] AS kept, true AS allowed, CAST(1 AS BIGINT) AS remaining FROM r WHERE k = 1
      UNION ALL SELECT client, k, event_id, CASE WHEN len(old) < 2 THEN list_append(old, us) ELSE old END, len(old) < 2, CASE WHEN len(old) < 2 THEN 2 - len(old) - 1 ELSE 0 END
      FROM (SELECT r.client, r.k, r.event_id, r.us, list_filter(w.kept, lambda x: x >= r.us - 86400000000) AS old FROM walk w JOIN r ON r.client = w.client AND r.k = w.k + 1))
    SELECT event_id, client, allowed, remaining FROM walk""")
def rate_limit_verdicts(spark, sf):
    log = views.events(spark, sf).select("event_id", "client", "us")
    return abuse.sliding_limit(log, ["client"], 2, 86400, chunk_us=7 * views.DAY_US).select("event_id", "client", "allowed", "remaining")


# The fixed rules at the pace of this log, which is slower by about 1440: a minute becomes a day, ten requests become one.
CHAIN = [(n, max(1, q // 10), w * 1440, p, None, None, pr) for n, q, w, p, pr in dims.RATE_RULES]
CHAIN_LIMITS = {"per_hour": 0.5, "endpoints": 3, "agents": 10, "errors": 0.1, "variance": 4e8}

# A client's score as it stood with each request; silence of more than a day starts afresh.
RUNNING_SQL = """g AS (SELECT *, us - lag(us) OVER (PARTITION BY client ORDER BY us, event_id) AS gap FROM req),
    s AS (SELECT * REPLACE (CASE WHEN gap <= 86400000000 THEN gap END AS gap), count(*) FILTER (gap IS NULL OR gap > 86400000000) OVER (PARTITION BY client ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS visit FROM g),
    u AS (SELECT *, count(*) OVER w AS n, count(*) FILTER (is_error) OVER w AS wrong, min(us) OVER w AS since, len(list_distinct(list(endpoint) OVER w)) AS endpoints,
      len(list_distinct(list(agent) OVER w)) AS agents, var_pop(gap / 1e6) OVER (PARTITION BY client, visit ORDER BY us, event_id ROWS 9 PRECEDING) AS variance
      FROM s WINDOW w AS (PARTITION BY client, visit ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)),
    running AS (SELECT client, event_id, us, endpoint, CASE WHEN n / greatest((us - since) / 3600e6, 0.1::DOUBLE) > 0.5 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN endpoints > 3 THEN 0.2::DOUBLE ELSE 0 END
      + CASE WHEN agents > 10 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN wrong / n > 0.1 THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN n > 11 AND variance < 4e8 THEN 0.1::DOUBLE ELSE 0 END AS score FROM u)"""


def _chain_sql():
    """The walk over each client's requests, with one list of passed times per rule."""
    ranked = list(enumerate(sorted(CHAIN, key=lambda r: r[6])))
    hit = ", ".join((" OR ".join(f"path LIKE '{p}%'" for p in r[3]) if r[3] else "true") + f" AS m{i}" for i, r in ranked)
    quota = ", ".join(f"CASE WHEN score > 0.8 THEN {max(1, r[1] // 4)} ELSE {r[1]} END AS l{i}" for i, r in ranked)
    old = ", ".join(f"list_filter(w.q{i}, lambda x: x >= r.us - {r[2] * 1_000_000}) AS o{i}" for i, r in ranked)
    first = "CASE " + " ".join(f"WHEN m{i} AND (blocked OR len(o{i}) >= l{i}) THEN {i}" for i, _ in ranked) + " ELSE 99 END AS denied"
    after = ", ".join(f"CASE WHEN m{i} AND {i} < denied THEN list_append(o{i}, us) ELSE o{i} END AS q{i}" for i, _ in ranked)
    names = "CASE denied " + " ".join(f"WHEN {i} THEN '{r[0]}'" for i, r in ranked) + " END"
    empty = ", ".join(f"CAST([] AS BIGINT[]) AS q{i}" for i, _ in ranked)
    return f"""RECURSIVE {RUNNING_SQL},
    r AS (SELECT *, {hit}, {quota} FROM (SELECT event_id, client, us, {_PATH_SQL} AS path, score, row_number() OVER (PARTITION BY client ORDER BY us, event_id) AS k FROM running)),
    walk AS (SELECT client, 0::BIGINT AS k, 0::BIGINT AS event_id, 99 AS denied, false AS blocked, 0::DOUBLE AS score, 0::BIGINT AS until_us, {empty} FROM r WHERE k = 1
      UNION ALL SELECT client, k, event_id, denied, blocked, score, CASE WHEN denied < 99 AND score > 0.9 THEN us + 86400000000 ELSE until_us END AS until_us, {after}
      FROM (SELECT *, {first} FROM (SELECT r.*, w.until_us, r.us < w.until_us AS blocked, {old} FROM walk w JOIN r ON r.client = w.client AND r.k = w.k + 1)))
    SELECT event_id, client, denied = 99 AS allowed, {names} AS rule, CASE WHEN denied < 99 THEN CASE WHEN blocked THEN 'client_blocked' ELSE 'rate_limit_exceeded' END END AS reason,
    CASE WHEN denied < 99 THEN CASE WHEN score >= 0.7 THEN 'high' ELSE 'medium' END END AS threat_level, CASE WHEN denied < 99 THEN CASE WHEN score > 0.9 THEN 'client_blocked_24h' ELSE 'request_blocked' END END AS action
    FROM walk WHERE k > 0"""


CHAIN_SQL = _chain_sql()
CHAIN_COLUMNS = ["event_id", "client", "allowed", "rule", "reason", "threat_level", "action"]


def on_paths(requests):
    """Requests (batch or stream) with the service's paths as endpoints."""
    paths = F.create_map(*[F.lit(x) for kv in _PATHS.items() for x in kv])
    return requests.withColumn("endpoint", paths[F.col("endpoint")])


def chain_verdicts(spark, sf):
    """The log under all rules, each request judged with its client's score as it stood with that request."""
    log = abuse.running_scores(on_paths(views.events(spark, sf).select("event_id", "client", "us", "endpoint", "agent", "is_error")), ["client"], CHAIN_LIMITS)
    return abuse.rule_chain(stored(log.drop("agent", "is_error"), "scored"), ["client"], CHAIN, block_seconds=86400, chunk_us=10 * views.DAY_US)


@query("rule_chain_verdicts", "req", CHAIN_SQL)
def rule_chain_verdicts(spark, sf):
    """All rules in turn with quartered limits and blocks, under running scores."""
    return chain_verdicts(spark, sf).select(*CHAIN_COLUMNS)


@query("running_scores", "req", f"{RUNNING_SQL} SELECT client, event_id, us, round(score, 6) AS score FROM running")
def running_scores(spark, sf):
    """The batch form of ``stream_abuse_profiles``."""
    log = views.events(spark, sf).select("event_id", "client", "us", "endpoint", "agent", "is_error")
    return rounded(abuse.running_scores(log, ["client"], CHAIN_LIMITS), "score").select("client", "event_id", "us", "score")


def robots_files(spark, sf):
    p = views.pages(spark, sf).select(urls.site(F.col("url")).alias("domain")).distinct()
    n = F.length("domain") % 4
    return p.filter(n < 3).select("domain", F.concat(
        F.lit("# rules\nUser-Agent: *\nDisallow: /en/\nAllow: /fr/1\nDisallow: /fr/\nCrawl-delay: "), n.cast("string"), F.lit(".5\n"),
        F.when(n == 1, "User-agent: CompanyBot\nAllow: /en/\n").when(n == 2, "User-agent: otherbot\nDisallow: /\n").otherwise("Disallow:\n"),
        F.lit("Sitemap: "), "domain", F.lit("/sitemap.xml")).alias("content"))


@query("robots_verdicts", "page", r"""d AS (SELECT page_id, scheme || '://' || regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS domain, lower(path) AS p FROM page), n AS (SELECT *, length(domain) % 4 AS n FROM d)
    SELECT page_id, domain, n = 3 OR p LIKE '/fr/1%' OR (n = 1 AND p LIKE '/en/%') OR NOT (p LIKE '/en/%' OR p LIKE '/fr/%') AS can_fetch,
    CASE WHEN n = 3 THEN 'no robots file' WHEN p LIKE '/fr/1%' THEN 'allowed for *' WHEN n = 1 AND p LIKE '/en/%' THEN 'allowed for companybot' WHEN p LIKE '/en/%' OR p LIKE '/fr/%' THEN 'disallowed for *'
    ELSE 'no matching rule' END AS reason FROM n""")
def robots_verdicts(spark, sf):
    rules = crawl.robots_rules(robots_files(spark, sf))
    return crawl.robots_verdicts(views.pages(spark, sf).select("page_id", "url"), rules, "CompanyBot").drop("url")


@query("robots_settings", "page", """d AS (SELECT DISTINCT scheme || '://' || regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS domain FROM page)
    SELECT domain, greatest(1.0::DOUBLE, length(domain) % 4 + 0.5::DOUBLE) AS crawl_delay, domain || '/sitemap.xml' AS sitemaps FROM d WHERE length(domain) % 4 < 3""")
def robots_settings(spark, sf):
    return crawl.robots_settings(robots_files(spark, sf)).withColumn("sitemaps", F.array_join("sitemaps", ","))


@query("robots_cache_statistics", "page", """d AS (SELECT scheme || '://' || regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS domain, max(page_id) AS last_id FROM page GROUP BY 1)
    SELECT count(*) AS domains, count(*) FILTER (last_id < 125) AS expired, round((count(*) - count(*) FILTER (last_id < 125)) / count(*), 6) AS hit_rate FROM d""")
def robots_cache_statistics(spark, sf):
    n = F.count(F.lit(1))
    d = views.pages(spark, sf).groupBy(urls.site(F.col("url")).alias("domain")).agg(F.max("page_id").alias("last_id"))
    old = F.count_if(F.col("last_id") < 125)
    return rounded(d.agg(n.alias("domains"), old.alias("expired"), ((n - old) / F.greatest(n, F.lit(1))).alias("hit_rate")), "hit_rate")


@query("page_addresses", "page", """SELECT page_id, host, path, scheme || '://' || regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS site,
    scheme || '://' || regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) || '/robots.txt' AS robots FROM page""")
def page_addresses(spark, sf):
    return views.pages(spark, sf).select("page_id", "host", "path", urls.site(F.col("url")).alias("site"), urls.robots_address(F.col("url")).alias("robots"))


_STATUS = "CASE agent % 20 WHEN 0 THEN 429 WHEN 1 THEN 403 WHEN 2 THEN 503 WHEN 3 THEN 401 ELSE 200 END"


@query("crawls_outside_blocks", "req", f"""s AS (SELECT event_id, client, us, {_STATUS} AS status FROM req),
    b AS (SELECT client, us, us + CASE WHEN status IN (429, 503) THEN 24 ELSE 1 END * 3600000000 AS until_us FROM s WHERE status <> 200)
    SELECT event_id, client, us FROM s WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.client = s.client AND b.us < s.us AND s.us < b.until_us)""")
def crawls_outside_blocks(spark, sf):
    a = F.col("agent") % 20
    log = views.events(spark, sf).select("event_id", "client", "us", F.when(a == 0, 429).when(a == 1, 403).when(a == 2, 503).when(a == 3, 401).otherwise(200).alias("status"))
    blocks = crawl.block_windows(log, F.col("status")).select("client", "us", "until_us")
    return crawl.outside_blocks(log.select("event_id", "client", "us"), blocks, ["client"])


def threats(spark, sf):
    d = views.documents(spark, sf)
    return validation.scan_text(d, "text").filter("sql or script or command or traversal")


@query("security_rollup", "req", "RECURSIVE " + _PROFILE + """, n AS (SELECT ms, is_error FROM req WHERE us > (SELECT max(us) FROM req) - 604800000000),
    found AS (""" + ORACLES["text_threats"] + """), verdict AS (WITH """ + CHAIN_SQL + """)
    SELECT (SELECT count(*) FROM verdict WHERE NOT allowed) AS rate_limit_violations, (SELECT count(*) FROM verdict WHERE action LIKE '%blocked%') AS blocked_requests,
    (SELECT count(*) FROM found WHERE sql OR script OR command OR traversal) AS security_violations, (SELECT count(*) FROM prof WHERE score > 0.7) AS suspicious_clients,
    (SELECT round(avg(ms), 6) FROM n) AS avg_ms, (SELECT round(count(*) FILTER (is_error) / count(*) * 100, 6) FROM n) AS error_pct""")
def security_rollup(spark, sf):
    """Limiter events are the denials of the rule chain; the last week is found first, so that its range reaches the scan."""
    e = views.events(spark, sf)
    denied = chain_verdicts(spark, sf).filter("not allowed")
    latest = e.agg(F.max("us")).first()[0]
    week = views.events(spark, sf, after=latest - 7 * views.DAY_US) if latest is not None else e
    return rounded(abuse.security_rollup(denied, threats(spark, sf), abuse.abuse_profiles(e, ["client"], _LIMITS), week), "avg_ms", "error_pct")


@query("security_event_feed", "req", f"""SELECT 'alert' AS kind, event_id AS id, us, 'critical' AS severity, NULL AS client FROM req WHERE ms > 200
    UNION ALL SELECT 'rate_limit', event_id, us, NULL, client FROM req WHERE agent > 95 UNION ALL SELECT 'violation', event_id, us, 'medium', client FROM req WHERE is_error""")
def security_event_feed(spark, sf):
    e = views.events(spark, sf)
    alerts = e.filter("ms > 200").select(F.lit("alert").alias("kind"), F.col("event_id").alias("id"), "us", F.lit("critical").alias("severity"))
    limits = e.filter("agent > 95").select(F.lit("rate_limit").alias("kind"), F.col("event_id").alias("id"), "us", "client")
    wrong = e.filter("is_error").select(F.lit("violation").alias("kind"), F.col("event_id").alias("id"), "us", F.lit("medium").alias("severity"), "client")
    return alerts.unionByName(limits, allowMissingColumns=True).unionByName(wrong, allowMissingColumns=True)
