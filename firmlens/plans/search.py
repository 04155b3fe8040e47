"""Queries over search requests, result pages and crawl candidates."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from firmlens.functions import numbers, urls
from firmlens.operators import search
from firmlens.operators.durable import shared_folder
from firmlens.plans import views
from firmlens.plans.registry import query
from firmlens.sources import captured

_SUFFIX_VALUES = "(VALUES " + ", ".join(f"('{p}', '{c}', '{s}')" for p, c, s in search.PLATFORM_SUFFIXES) + ") s(p, c, suffix)"


@query("platform_queries", "search_request", f"""SELECT request_id, query || coalesce(suffix, '') AS platform_query FROM search_request
    LEFT JOIN {_SUFFIX_VALUES} ON p = social_platform AND c = CASE WHEN social_platform = 'instagram' THEN instagram_content_type
      WHEN social_platform = 'linkedin' THEN linkedin_content_type END""")
def platform_queries(spark, sf):
    return search.platform_queries(views.search_requests(spark, sf)).select("request_id", "platform_query")


_CORPUS = """corpus AS (SELECT page_id, ([ 'https://www.linkedin.com/in/p', 'https://linkedin.com/company/c', 'https://www.instagram.com/reel/',
    'https://business.instagram.com/p/', 'https://instagram.com/p/', 'https://linkedin.com/feed/u', 'https://id.linkedin.com/jobs/view/', 'https://linkedin.com/pulse/a',
    'https://instagram.com/tv/', 'https://instagram.com/explore/locations/', 'https://instagram.com/user', 'https://linkedin.com/company/x/posts/',
    'https://other.com/in/'])[page_id % 13 + 1] || page_id AS url FROM pages)"""
_CORPUS_HEADS = ["https://www.linkedin.com/in/p", "https://linkedin.com/company/c", "https://www.instagram.com/reel/",
                 "https://business.instagram.com/p/", "https://instagram.com/p/", "https://linkedin.com/feed/u", "https://id.linkedin.com/jobs/view/",
                 "https://linkedin.com/pulse/a", "https://instagram.com/tv/", "https://instagram.com/explore/locations/", "https://instagram.com/user",
                 "https://linkedin.com/company/x/posts/", "https://other.com/in/"]


@query("platform_filter_matches", "", _CORPUS + """, u AS (SELECT page_id, url,
      regexp_matches(url, '^https://([a-z]+\\.)?linkedin\\.com/') AS li,
      regexp_matches(url, '^https://([a-z]+\\.)?instagram\\.com/') AND NOT url LIKE '%business.instagram%' AS ig FROM corpus),
    m AS (SELECT page_id, url, 'linkedin' AS platform, unnest(['all' , CASE WHEN url LIKE '%/in/%' THEN 'profiles' END,
       CASE WHEN url LIKE '%/company/%' AND NOT url LIKE '%/posts/%' THEN 'companies' END,
       CASE WHEN url LIKE '%/feed/%' THEN 'posts' END, CASE WHEN url LIKE '%/jobs/view/%' THEN 'jobs' END, CASE WHEN url LIKE '%/pulse/%' THEN 'articles' END]) AS content_type FROM u WHERE li
     UNION ALL SELECT page_id, url, 'instagram', unnest(['all', CASE WHEN url LIKE '%/reel/%' THEN 'reels' END, CASE WHEN url LIKE '%/p/%' THEN 'posts' END,
       CASE WHEN NOT regexp_matches(url, '/(reel|p|tv|explore)/') THEN 'accounts' END, CASE WHEN url LIKE '%/tv/%' THEN 'tv' END,
       CASE WHEN url LIKE '%/explore/locations/%' THEN 'locations' END]) FROM u WHERE ig)
    SELECT * FROM m WHERE content_type IS NOT NULL""")
def platform_filter_matches(spark, sf):
    heads = F.array(*[F.lit(h) for h in _CORPUS_HEADS])
    corpus = views.table(spark, sf, "pages").select("page_id", F.concat(
        F.element_at(heads, (F.col("page_id") % 13 + 1).cast("int")), F.col("page_id").cast("string")).alias("url"))
    return search.matching_filters(corpus)


@query("search_addresses", "search_request", """SELECT request_id, 'https://www.google.com/search?q=' || replace(url_encode(query), '%2F', '/') || '&gl=' || lower(country)
    || '&hl=' || language || '&start=' || greatest(0, (page - 1) * results_per_page) || '&num=' || results_per_page AS address FROM search_request""")
def search_addresses(spark, sf):
    r = views.search_requests(spark, sf)
    return r.select("request_id", search.search_address(*[F.col(c) for c in ("query", "country", "language", "page", "results_per_page")]).alias("address"))


@query("page_requests", "search_request", """SELECT request_id, CAST(p AS INT) AS fetch_page, CAST((p - 1) * results_per_page AS INT) AS start FROM (SELECT *,
    unnest(range(coalesce(start_page, page), coalesce(start_page, page) + max_pages)) AS p FROM search_request WHERE max_pages >= 1)""")
def page_requests(spark, sf):
    r = search.page_requests(views.search_requests(spark, sf).filter("max_pages >= 1"))
    return r.select("request_id", "fetch_page", numbers.start_index(F.col("fetch_page"), F.col("results_per_page")).alias("start"))


@query("pagination_metadata", "search_request", """f AS (SELECT request_id, page + 1 AS page, results_per_page + 1 AS per, CASE WHEN request_id % 7 = 0 THEN 0
      ELSE (request_id % (results_per_page + 1)) + 1 END AS found, CASE WHEN request_id % 3 <> 0 THEN request_id * 13 END AS total FROM search_request),
    g AS (SELECT *, least(CAST(ceil(total / per) AS BIGINT), 1000) AS pages FROM f)
    SELECT request_id, CAST((page - 1) * per AS INT) AS start_index, CASE WHEN total IS NOT NULL THEN pages END AS total_pages,
    CASE WHEN page >= 1000 THEN false WHEN total IS NOT NULL THEN page < pages ELSE found >= per END AS has_next, page > 1 AS has_previous,
    CASE WHEN found = 0 THEN 0 ELSE (page - 1) * per + 1 END AS range_start, CASE WHEN found = 0 THEN 0 ELSE (page - 1) * per + found END AS range_end FROM g""")
def pagination_metadata(spark, sf):
    r = views.search_requests(spark, sf).withColumns({"p": F.col("page") + 1, "per": F.col("results_per_page") + 1})
    found = F.when(F.col("request_id") % 7 == 0, 0).otherwise(F.col("request_id") % F.col("per") + 1)
    total = F.when(F.col("request_id") % 3 != 0, F.col("request_id") * 13)
    return search.pagination(r, F.col("p"), F.col("per"), found, total).select(
        "request_id", "start_index", "total_pages", "has_next", "has_previous", "range_start", "range_end")


@query("stated_totals", "firm_text", """SELECT firm_id, CAST(replace(coalesce(nullif(regexp_extract(total_text, 'About\\s+([\\d,]+)\\s+results', 1), ''),
    nullif(regexp_extract(total_text, '([\\d,]+)\\s+results', 1), ''), nullif(regexp_extract(total_text, 'Showing\\s+[\\d,]+-[\\d,]+\\s+of\\s+([\\d,]+)', 1), ''),
    nullif(regexp_extract(total_text, 'Page\\s+\\d+\\s+of\\s+about\\s+([\\d,]+)', 1), '')), ',', '') AS BIGINT) AS total FROM firm_text""")
def stated_totals(spark, sf):
    return views.firm_texts(spark, sf).select("firm_id", numbers.stated_total(F.col("total_text")).alias("total"))


@query("result_validity", "page", """SELECT page_id, length(title) > 0 AND regexp_matches(url, '^https?://') AND length(trim(title)) >= 3 AS valid_result,
    scheme IN ('http', 'https') AND host <> '' AND length(url) > 10 AS valid_address FROM (SELECT page_id, scheme, host,
      CASE WHEN page_id % 5 = 0 THEN 'ab ' ELSE title END AS title, CASE WHEN page_id % 7 = 0 THEN 'ftp://x/' || page_id ELSE url END AS url FROM page)
    WHERE page_id % 7 <> 0 UNION ALL SELECT page_id, false, false FROM page WHERE page_id % 7 = 0""")
def result_validity(spark, sf):
    p = views.pages(spark, sf).select(
        "page_id", F.when(F.col("page_id") % 5 == 0, "ab ").otherwise(F.col("title")).alias("title"),
        F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("ftp://x/"), F.col("page_id").cast("string"))).otherwise(F.col("url")).alias("url"))
    return p.select("page_id", urls.is_valid_result(F.col("title"), F.col("url")).alias("valid_result"),
                    urls.is_result_address(F.col("url")).alias("valid_address"))


@query("blocked_pages", "", """t AS (SELECT page_id AS id, 'page' AS kind, html AS h FROM pages UNION ALL SELECT doc_id, 'document', CASE WHEN doc_id % 9 = 0
      THEN text || ' Unusual traffic' WHEN doc_id % 11 = 0 THEN 'CAPTCHA ' || text ELSE text END FROM documents)
    SELECT kind, count(*) AS n, count(*) FILTER (lower(h) LIKE '%captcha%') AS captcha,
    count(*) FILTER (lower(h) LIKE '%blocked%' OR lower(h) LIKE '%unusual traffic%') AS blocked FROM t GROUP BY kind""")
def blocked_pages(spark, sf):
    k = F.col("doc_id")
    p = views.table(spark, sf, "pages").select(F.lit("page").alias("kind"), F.col("html").alias("h"))
    d = views.table(spark, sf, "documents").select(F.lit("document").alias("kind"), F.when(k % 9 == 0, F.concat("text", F.lit(" Unusual traffic")))
        .when(k % 11 == 0, F.concat(F.lit("CAPTCHA "), "text")).otherwise(F.col("text")).alias("h"))
    captcha, blocked = search.blocked_flags(F.col("h"))
    return p.unionByName(d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(captcha).alias("captcha"), F.count_if(blocked).alias("blocked"))


@query("merged_ranks", "serp", """SELECT query, page, rank, page_id, row_number() OVER (PARTITION BY query ORDER BY page, rank) AS merged_rank FROM serp""")
def merged_ranks(spark, sf):
    return search.merged_ranks(views.serp_results(spark, sf).select("query", "page", "rank", "page_id"), ["query"])


@query("merge_summary", "serp", """asked AS (SELECT query, (page - 1) // 5 AS request_no, page, min(page_id) AS first_id FROM serp GROUP BY ALL),
    kept AS (SELECT query, page, count(*) AS found FROM serp GROUP BY ALL)
    SELECT a.query, request_no, count(*) AS pages_requested, count(*) FILTER (a.page % 4 <> 0) AS pages_fetched, CAST(sum(CASE WHEN a.page % 4 <> 0 THEN found ELSE 0 END) AS BIGINT) AS total_results,
    arg_min(first_id * 10, a.page) FILTER (first_id % 2 = 0 AND a.page % 4 <> 0) AS estimate,
    string_agg(CAST(a.page AS VARCHAR), ',' ORDER BY a.page) FILTER (found > 0 AND a.page % 4 <> 0) AS pages_included
    FROM asked a LEFT JOIN kept k ON a.query = k.query AND a.page = k.page GROUP BY ALL""")
def merge_summary(spark, sf):
    s = views.serp_results(spark, sf).withColumn("request_no", F.expr("(page - 1) div 5"))
    asked = s.groupBy("query", "request_no", "page").agg(F.min("page_id").alias("first_id")).select(
        "query", "request_no", "page", (F.col("page") % 4 != 0).alias("fetched"),
        F.when((F.col("first_id") % 2 == 0) & (F.col("page") % 4 != 0), F.col("first_id") * 10).alias("estimate"))
    out = search.merge_summary(s, asked, ["query", "request_no"])
    return out.withColumn("pages_included", F.array_join("pages_included", ","))


@query("page_overlaps", "serp", """SELECT a.query, a.page, count(DISTINCT a.host) AS shared FROM serp a JOIN serp b
    ON a.query = b.query AND b.page = a.page + 1 AND a.host = b.host GROUP BY ALL""")
def page_overlaps(spark, sf):
    return search.page_overlaps(views.serp_results(spark, sf), "query", "host")


@query("page_connections", "serp", """p AS (SELECT query, page, count(*) AS found, max((page - 1) * 10 + rank) AS last_rank, min((page - 1) * 10 + rank) AS first_rank FROM serp GROUP BY ALL),
    o AS (SELECT a.query, a.page, count(DISTINCT a.host) AS shared FROM serp a JOIN serp b ON a.query = b.query AND b.page = a.page + 1 AND a.host = b.host GROUP BY ALL)
    SELECT p.query, p.page, p.found, p.last_rank, n.first_rank AS next_first, n.first_rank - p.last_rank AS rank_gap, coalesce(shared, 0) AS shared,
    coalesce(shared, 0) = 0 AS properly_connected FROM p JOIN p n ON n.query = p.query AND n.page = p.page + 1 LEFT JOIN o ON o.query = p.query AND o.page = p.page""")
def page_connections(spark, sf):
    s = views.serp_results(spark, sf).withColumn("merged_rank", (F.col("page") - 1) * 10 + F.col("rank"))
    return search.page_connections(s, "query", "host")


@query("hosts_on_both_page_kinds", "serp", "SELECT host FROM serp WHERE page % 2 = 1 INTERSECT SELECT host FROM serp WHERE page % 2 = 0")
def hosts_on_both_page_kinds(spark, sf):
    s = views.serp_results(spark, sf)
    return s.filter("page % 2 = 1").select("host").intersect(s.filter("page % 2 = 0").select("host"))


@query("result_stability", "serp", """f AS (SELECT query, page, count(*) AS found, arg_min(title, rank) AS t FROM serp GROUP BY ALL)
    SELECT query, count(*) AS fetches, min(found) AS least, max(found) AS most, count(DISTINCT found) = 1 AS count_consistent, count(DISTINCT t) > 1 AS first_title_varies FROM f GROUP BY query""")
def result_stability(spark, sf):
    return search.result_stability(views.serp_results(spark, sf), "query", "page")


@query("domain_diversity", "serp", """SELECT query, count(*) AS results, count(DISTINCT host) AS domains, count(*) FILTER (host LIKE '%example.com%') AS on_platform,
    count(*) FILTER (NOT host LIKE '%example.com%') AS elsewhere FROM serp GROUP BY query""")
def domain_diversity(spark, sf):
    return search.domain_diversity(views.serp_results(spark, sf), ["query"], "example.com")


@query("discovery_queries", "company_request", """q AS (SELECT request_id, list_concat(list_concat(list_concat(list_concat(
      [CASE WHEN domain IS NOT NULL THEN '"' || company_name || '" site:' || domain ELSE '"' || company_name || '" company information' END],
      CASE WHEN extraction_mode IN ('comprehensive', 'contact_focused') THEN ['"' || company_name || '" contact information', '"' || company_name || '" address phone email', '"' || company_name || '" about us'] ELSE [] END),
      CASE WHEN extraction_mode IN ('comprehensive', 'financial_focused') THEN ['"' || company_name || '" funding investors', '"' || company_name || '" revenue valuation', '"' || company_name || '" crunchbase'] ELSE [] END),
      CASE WHEN include_social_media THEN ['"' || company_name || '" linkedin', '"' || company_name || '" twitter', '"' || company_name || '" social media'] ELSE [] END),
      CASE WHEN include_key_personnel THEN ['"' || company_name || '" CEO founder', '"' || company_name || '" leadership team', '"' || company_name || '" executives'] ELSE [] END) AS l FROM company_request)
    SELECT request_id, CAST(i AS INT) AS query_no, l[i + 1] AS query FROM q, range(0, 3) t(i) WHERE i < len(l)""")
def discovery_queries(spark, sf):
    return search.discovery_queries(views.company_requests(spark, sf))


_CANDIDATES = """cand AS (SELECT page_id, page_id // 8 AS request_id, CAST(page_id % 2 AS INT) AS query_no, CAST(page_id % 8 // 2 + 1 AS INT) AS rank, 'Firm ' || (page_id // 8) AS name,
    CASE WHEN page_id // 8 % 2 = 0 THEN 'firm' || (page_id // 8) || '.com' END AS domain,
    (['comprehensive', 'contact_focused', 'financial_focused'])[page_id // 8 % 3 + 1] AS mode,
    CASE page_id % 7 WHEN 0 THEN 'https://www.firm' || (page_id // 8) || '.com/about' WHEN 1 THEN 'https://linkedin.com/company/firm' WHEN 2 THEN url
      WHEN 3 THEN 'https://en.wikipedia.org/wiki/Firm' WHEN 4 THEN 'https://firm-' || (page_id // 8) || '-shop.net/x' WHEN 5 THEN 'https://www.firm' || (page_id // 8) || '.com/about'
      ELSE 'https://www.facebook.com/firm' END AS url,
    CASE WHEN page_id % 3 = 0 THEN 'Firm ' || (page_id // 8) || ' contact and funding' ELSE title END AS title,
    CASE WHEN page_id % 5 = 0 THEN 'Firm ' || (page_id // 8) || ' is a company' ELSE text END AS description FROM page)"""


def _any(field, words):
    return "(" + " OR ".join(f"contains({field}, '{w}')" for w in words) + ")"


_PRIORITY = _CANDIDATES + """, parts AS (SELECT *, replace(regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1), 'www.', '') AS host,
      regexp_extract(lower(url), '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, lower(title) AS t, lower(description) AS d, lower(name) AS who FROM cand),
    raw AS (SELECT *, CASE WHEN domain IS NOT NULL AND contains(host, domain) THEN 0.4::DOUBLE WHEN contains(replace(replace(host, '-', ''), '_', ''), replace(who, ' ', '')) THEN 0.3::DOUBLE ELSE 0 END
      + CASE WHEN """ + _any("host", search.TRUSTED_DOMAINS) + " THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN " + _any("path", search.TELLING_PATHS) + """ THEN 0.15::DOUBLE ELSE 0 END
      + CASE WHEN t <> '' AND contains(t, who) THEN 0.2::DOUBLE ELSE 0 END
      + CASE WHEN t <> '' AND ((mode = 'contact_focused' AND """ + _any("t", search.CONTACT_WORDS) + ") OR (mode = 'financial_focused' AND " + _any("t", search.FINANCE_WORDS) + """)) THEN 0.1::DOUBLE ELSE 0 END
      + CASE WHEN d <> '' AND contains(d, who) THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN """ + _any("d", search.BUSINESS_WORDS) + """ THEN 0.05::DOUBLE ELSE 0 END AS s FROM parts),
    scored AS (SELECT *, least(s * CASE WHEN """ + _any("host", search.UNHELPFUL_DOMAINS) + """ THEN 0.7::DOUBLE ELSE 1 END, 1) AS priority FROM raw)"""


def candidates(spark, sf):
    k, r = F.col("page_id"), F.expr("page_id div 8")
    rs = r.cast("string")
    return views.pages(spark, sf).select(
        "page_id", r.alias("request_id"), (k % 2).cast("int").alias("query_no"), F.expr("int(page_id % 8 div 2) + 1").alias("rank"),
        F.concat(F.lit("Firm "), rs).alias("name"), F.when(r % 2 == 0, F.concat(F.lit("firm"), rs, F.lit(".com"))).alias("domain"),
        F.element_at(F.array(F.lit("comprehensive"), F.lit("contact_focused"), F.lit("financial_focused")), (r % 3 + 1).cast("int")).alias("mode"),
        F.when(k % 7 == 0, F.concat(F.lit("https://www.firm"), rs, F.lit(".com/about"))).when(k % 7 == 1, "https://linkedin.com/company/firm")
        .when(k % 7 == 2, F.col("url")).when(k % 7 == 3, "https://en.wikipedia.org/wiki/Firm")
        .when(k % 7 == 4, F.concat(F.lit("https://firm-"), rs, F.lit("-shop.net/x"))).when(k % 7 == 5, F.concat(F.lit("https://www.firm"), rs, F.lit(".com/about")))
        .otherwise("https://www.facebook.com/firm").alias("url"),
        F.when(k % 3 == 0, F.concat(F.lit("Firm "), rs, F.lit(" contact and funding"))).otherwise(F.col("title")).alias("title"),
        F.when(k % 5 == 0, F.concat(F.lit("Firm "), rs, F.lit(" is a company"))).otherwise(F.col("text")).alias("description"))


def scored(spark, sf):
    c = candidates(spark, sf)
    results = c.select("page_id", "request_id", "query_no", "rank", "url", "title", "description")
    requests = c.select("request_id", "name", "domain", "mode").distinct()
    return results.join(requests, "request_id").withColumn("priority", search.address_priority(
        *[F.col(x) for x in ("url", "title", "description", "name", "domain", "mode")]))


@query("address_priorities", "page", _PRIORITY + " SELECT page_id, request_id, url, round(priority, 6) AS priority FROM scored")
def address_priorities(spark, sf):
    return scored(spark, sf).select("page_id", "request_id", "url", F.round("priority", 6).alias("priority"))


@query("first_results", "page", _CANDIDATES + """ SELECT request_id, query_no, rank, url FROM (SELECT *, row_number() OVER (PARTITION BY request_id, query_no ORDER BY rank) AS k FROM cand) WHERE k <= 5""")
def first_results(spark, sf):
    return search.first_results(candidates(spark, sf).select("request_id", "query_no", "rank", "url"), ["request_id", "query_no"])


@query("best_addresses", "page", _PRIORITY + " SELECT request_id, url, round(max(priority), 6) AS priority FROM scored GROUP BY ALL")
def best_addresses(spark, sf):
    return search.best_addresses(scored(spark, sf)).select("request_id", "url", F.round("priority", 6).alias("priority"))


@query("crawl_shortlist", "page", _PRIORITY + """, t AS (SELECT *, row_number() OVER (PARTITION BY request_id, query_no ORDER BY rank) AS k FROM scored),
    b AS (SELECT request_id, url, max(round(priority, 6)) AS priority, min(query_no * 100 + rank) AS seen FROM t WHERE k <= 5 GROUP BY ALL)
    SELECT request_id, url, priority, position FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY priority DESC, seen, url) AS position FROM b)
    WHERE position <= request_id % 4 + 1""")
def crawl_shortlist(spark, sf):
    first = search.first_results(scored(spark, sf), ["request_id", "query_no"])
    best = search.best_addresses(first.withColumn("priority", F.round("priority", 6))).withColumn("max_pages_to_crawl", F.col("request_id") % 4 + 1)
    return search.crawl_shortlist(best).select("request_id", "url", "priority", "position")


_CRAWLED = """crawled AS (SELECT page_id, url, page_id % 9 <> 0 AS success, CASE WHEN page_id % 3 = 0 THEN html WHEN page_id % 3 = 1 THEN '' END AS cleaned_html,
    CASE WHEN page_id % 5 = 0 THEN 'Page ' || page_id ELSE text END AS markdown FROM page),
    chosen AS (SELECT *, coalesce(nullif(cleaned_html, ''), nullif(markdown, ''), '') AS content FROM crawled)"""


def crawled(spark, sf):
    k = F.col("page_id")
    return views.pages(spark, sf).select(
        "page_id", "url", (k % 9 != 0).alias("success"), F.when(k % 3 == 0, F.col("html")).when(k % 3 == 1, "").alias("cleaned_html"),
        F.when(k % 5 == 0, F.concat(F.lit("Page "), k.cast("string"))).otherwise(F.col("text")).alias("markdown"))


@query("usable_pages", "page", _CRAWLED + """ SELECT page_id, md5(content) AS content_md5, CASE WHEN NOT success THEN 'crawl_failed'
    WHEN length(trim(content)) <= 100 THEN 'insufficient_content' END AS problem FROM chosen""")
def usable_pages(spark, sf):
    return captured.usable_pages(crawled(spark, sf)).select("page_id", F.md5("content").alias("content_md5"), "problem")


@query("crawl_facts", "page", r"""l AS (SELECT page_id, url, host, text, html, regexp_extract_all(html, '<a[^>]*href="([^"]*)"', 1) AS links FROM page),
    o AS (SELECT *, len(list_filter(links, lambda u: regexp_matches(u, '^https?://') AND replace(regexp_extract(u, '^[a-z]+://([^/?#]*)', 1), 'www.', '') <> host)) AS away FROM l)
    SELECT page_id, url, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS INT) AS words, CAST(len(links) - away AS INT) AS internal_links,
    CAST(away AS INT) AS external_links, CAST(len(regexp_extract_all(html, '<img[^>]*src="([^"]*)"', 1)) AS INT) AS images FROM o""")
def crawl_facts(spark, sf):
    return captured.crawl_facts(views.pages(spark, sf))


@query("request_page_outcomes", "page", _CRAWLED + """ SELECT page_id // 8 AS request_id, count(*) AS attempted, count(*) FILTER (success AND length(trim(content)) > 100) AS crawled,
    count(*) FILTER (NOT success OR length(trim(content)) <= 100) AS failed, coalesce(string_agg(url, ' ' ORDER BY url) FILTER (success AND length(trim(content)) > 100), '') AS sources_found,
    count(*) FILTER (NOT success) AS crawl_errors, count(*) FILTER (success AND length(trim(content)) <= 100) AS insufficient_content_errors FROM chosen GROUP BY 1""")
def request_page_outcomes(spark, sf):
    p = captured.usable_pages(crawled(spark, sf)).withColumn("request_id", F.expr("page_id div 8"))
    return captured.request_outcomes(p, "request_id").withColumn("sources_found", F.array_join("sources_found", " "))


@query("captured_search_pages", "serp", """f AS (SELECT query, page, min(page_id) AS first_id, count(*) AS n FROM serp GROUP BY ALL)
    SELECT CASE WHEN first_id % 5 <> 0 THEN query END AS query, CASE WHEN first_id % 5 <> 0 THEN page END AS page, CASE query WHEN 'en' THEN 'US' WHEN 'fr' THEN 'FR' ELSE 'XX' END AS country, query AS language,
    first_id % 5 <> 0 AS intact, CASE WHEN first_id % 5 <> 0 THEN n END AS boxes, CASE WHEN first_id % 5 = 0 THEN '{"query": "' || query || '", "page": ' || page END AS broken FROM f""")
def captured_search_pages(spark, sf):
    """Search pages with the country and language of their requests, captured as JSON lines of which some are cut off."""
    s = views.serp_results(spark, sf).groupBy("query", "page").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    html = F.concat(F.lit("<html>"), F.repeat(F.lit('<div class="g"></div>'), F.col("n").cast("int")), F.lit("</html>"))
    whole = F.to_json(F.struct(F.concat_ws("-", "query", "page").alias("serp_id"), "query", "page", F.lit(10).alias("results_per_page"), html.alias("html")))
    cut = F.concat(F.lit('{"query": "'), "query", F.lit('", "page": '), F.col("page").cast("string"))
    folder = f"{shared_folder(spark)}/serps-{uuid.uuid4().hex}"
    country = F.when(F.col("query") == "en", "US").when(F.col("query") == "fr", "FR").otherwise("XX")
    (s.select(F.when(F.col("first_id") % 5 == 0, cut).otherwise(whole).alias("value"), country.alias("country"), F.col("query").alias("language"))
     .write.partitionBy("country", "language").text(folder))
    found = captured.search_pages(spark, folder)
    boxes = F.size(F.regexp_extract_all("html", F.lit('<div class="g">'), F.lit(0)))
    intact = F.col("broken").isNull()
    return found.select("query", "page", "country", "language", intact.alias("intact"), F.when(intact, boxes).alias("boxes"), "broken")
