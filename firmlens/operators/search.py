"""Search requests, result pages, and the choice of pages to crawl."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmlens.functions import numbers, urls
from firmlens.operators import ordered

# Query endings per platform and kind of content.
PLATFORM_SUFFIXES = [
    ("instagram", "all", ' site:instagram.com -site:business.instagram.com'),
    ("instagram", "reels", ' site:instagram.com inurl:"/reel/" -site:business.instagram.com'),
    ("instagram", "posts", ' site:instagram.com inurl:"/p/" -site:business.instagram.com'),
    ("instagram", "accounts", ' site:instagram.com -inurl:"/reel/" -inurl:"/p/" -inurl:"/tv/" -inurl:"/explore/"'
                              ' -site:business.instagram.com'),
    ("instagram", "tv", ' site:instagram.com inurl:"/tv/" -site:business.instagram.com'),
    ("instagram", "locations", ' site:instagram.com inurl:"/explore/locations/" -site:business.instagram.com'),
    ("linkedin", "all", ' site:linkedin.com'),
    ("linkedin", "profiles", ' site:linkedin.com inurl:"/in/" -inurl:"/company/" -inurl:"/jobs/" -inurl:"/posts/"'
                             ' -inurl:"/feed/" -inurl:"/pulse/"'),
    ("linkedin", "companies", ' site:linkedin.com inurl:"/company/" -inurl:"/posts/" -inurl:"/feed/" -inurl:"/pulse/"'
                              ' -inurl:"/in/"'),
    ("linkedin", "posts", ' site:linkedin.com (inurl:"/feed/" OR inurl:"/posts/") -inurl:"/company/" -inurl:"/in/"'
                          ' -inurl:"/jobs/" -inurl:"/pulse/"'),
    ("linkedin", "jobs", ' site:linkedin.com inurl:"/jobs/view/" -inurl:"/company/" -inurl:"/in/" -inurl:"/posts/"'
                         ' -inurl:"/feed/" -inurl:"/pulse/"'),
    ("linkedin", "articles", ' site:linkedin.com inurl:"/pulse/" -inurl:"/company/" -inurl:"/in/" -inurl:"/posts/"'
                             ' -inurl:"/feed/" -inurl:"/jobs/"')]


def platform_queries(requests: DataFrame) -> DataFrame:
    """Query text narrowed to the requested platform and content kind."""
    kind = F.when(F.col("social_platform") == "instagram", F.col("instagram_content_type")).otherwise(F.col("linkedin_content_type"))
    ending = F.lit("")
    for platform, content, suffix in PLATFORM_SUFFIXES:
        ending = F.when((F.col("social_platform") == platform) & (kind == content), suffix).otherwise(ending)
    return requests.withColumn("platform_query", F.concat("query", ending))


def suffix_predicate(suffix: str, url: Column) -> Column:
    """What a query ending demands of a result address."""
    import re
    host = urls.host(F.lower(url))
    ok = F.lit(True)
    either = re.search(r"\(([^)]*)\)", suffix)
    if either:
        ok = ok & F.lower(url).rlike("|".join(re.escape(x) for x in re.findall(r'inurl:"([^"]+)"', either.group(1))))
        suffix = suffix.replace(either.group(0), "")
    for minus, word, value in re.findall(r'(-?)(site|inurl):"?([^"\s]+)"?', suffix):
        hit = ((host == value) | host.endswith("." + value)) if word == "site" else F.lower(url).contains(value)
        ok = ok & (~hit if minus else hit)
    return ok


def matching_filters(results: DataFrame, url: str = "url") -> DataFrame:
    """Every result with each platform filter its address satisfies."""
    kept = [F.when(suffix_predicate(s, F.col(url)), F.struct(F.lit(p).alias("platform"), F.lit(c).alias("content_type")))
            for p, c, s in PLATFORM_SUFFIXES]
    return results.withColumn("f", F.explode(F.array_compact(F.array(*kept)))).select(*results.columns, "f.*")


def search_address(query: Column, country: Column, language: Column, page: Column, per_page: Column) -> Column:
    start = F.greatest(F.lit(0), numbers.start_index(page, per_page))
    return F.concat(F.lit("https://www.google.com/search?q="), urls.quoted(query), F.lit("&gl="), F.lower(country), F.lit("&hl="), language,
                    F.lit("&start="), start.cast("string"), F.lit("&num="), per_page.cast("string"))


def page_requests(requests: DataFrame) -> DataFrame:
    """One row per page of a multi-page request."""
    start = F.coalesce("start_page", "page")
    return requests.withColumn("fetch_page", F.explode(F.sequence(start, start + F.col("max_pages") - 1)))


def pagination(df: DataFrame, page: Column, per_page: Column, found: Column, total: Column, most: int = 1000) -> DataFrame:
    """Page numbers, ranges and neighbours of a fetched page."""
    pages = numbers.total_pages(total, per_page, most)
    first, last = numbers.page_range(page, per_page, found)
    more = F.when(page >= most, False).when(pages.isNotNull(), page < pages).otherwise(found >= per_page)
    return df.withColumns({"start_index": numbers.start_index(page, per_page), "total_pages": pages, "has_next": more,
                           "has_previous": page > 1, "range_start": first, "range_end": last})


def blocked_flags(html: Column) -> tuple[Column, Column]:
    low = F.lower(html)
    return low.contains("captcha"), low.contains("blocked") | low.contains("unusual traffic")


def merged_ranks(results: DataFrame, keys: list[str]) -> DataFrame:
    """Continuous rank over all pages of a query."""
    return ordered.row_numbers(results, keys, [["page"]], ["page", "rank"], "merged_rank")


def merge_summary(results: DataFrame, requested: DataFrame, keys: list[str]) -> DataFrame:
    """Per request: pages fetched, results, the first known estimate, pages with results.

    ``requested`` has one row per asked page (at most ten per request) with its estimate;
    results of pages that were not fetched do not count.
    """
    counts = results.groupBy(*keys, "page").agg(F.count(F.lit(1)).alias("found"))
    per_page = requested.join(counts, keys + ["page"], "left").withColumn(
        "found", F.when(F.col("fetched"), F.coalesce("found", F.lit(0))).otherwise(0))
    return per_page.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pages_requested"), F.count_if("fetched").alias("pages_fetched"), F.sum("found").alias("total_results"),
        F.min_by("estimate", F.when(F.col("estimate").isNotNull(), F.col("page"))).alias("estimate"),
        F.array_sort(F.collect_list(F.when(F.col("found") > 0, F.col("page")))).alias("pages_included"))


def page_overlaps(results: DataFrame, query: str, item: str) -> DataFrame:
    """Items shared by each page and the next one of the same query."""
    one = results.select(query, "page", item).distinct()
    nxt = one.select(F.col(query), (F.col("page") - 1).alias("page"), F.col(item))
    return one.join(nxt, [query, "page", item]).groupBy(query, "page").agg(F.count(F.lit(1)).alias("shared"))


def page_connections(results: DataFrame, query: str, item: str) -> DataFrame:
    """How each page joins the next: rank gap, shared items, properly connected or not."""
    per = results.groupBy(query, "page").agg(F.count(F.lit(1)).alias("found"), F.min("merged_rank").alias("first_rank"),
                                             F.max("merged_rank").alias("last_rank"))
    w = Window.partitionBy(query).orderBy("page")
    pairs = per.withColumns({"next_page": F.lead("page").over(w), "next_first": F.lead("first_rank").over(w)}).filter("next_page is not null")
    shared = page_overlaps(results, query, item)
    out = pairs.join(shared, [query, "page"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    return out.select(query, "page", "found", "last_rank", "next_first", (F.col("next_first") - F.col("last_rank")).alias("rank_gap"),
                      "shared", (F.col("shared") == 0).alias("properly_connected"))


def result_stability(results: DataFrame, query: str, fetch: str) -> DataFrame:
    """Whether repeated fetches of a query give equally many results and the same first title."""
    per = results.groupBy(query, fetch).agg(F.count(F.lit(1)).alias("found"), F.min_by("title", "rank").alias("first_title"))
    return per.groupBy(query).agg(
        F.count(F.lit(1)).alias("fetches"), F.min("found").alias("least"), F.max("found").alias("most"),
        (F.countDistinct("found") == 1).alias("count_consistent"), (F.countDistinct("first_title") > 1).alias("first_title_varies"))


def domain_diversity(results: DataFrame, keys: list[str], platform: str) -> DataFrame:
    on = F.col("host").contains(platform)
    return results.groupBy(*keys).agg(F.count(F.lit(1)).alias("results"), F.countDistinct("host").alias("domains"),
                                      F.count_if(on).alias("on_platform"), F.count_if(~on).alias("elsewhere"))


def discovery_queries(requests: DataFrame, most: int = 3) -> DataFrame:
    """Search texts for a company, in order of use; only the first few are used."""
    name = F.concat(F.lit('"'), "company_name", F.lit('"'))
    ask = lambda *ends: F.array(*[F.concat(name, F.lit(e)) for e in ends])
    none = F.array().cast("array<string>")
    mode = F.col("extraction_mode")
    # Endings of the search texts.
    every = F.concat(
        F.array(F.when(F.col("domain").isNotNull() & (F.col("domain") != ""), F.concat(name, F.lit(" site:"), "domain"))
                .otherwise(F.concat(name, F.lit(" company information")))),
        F.when(mode.isin("comprehensive", "contact_focused"), ask(" contact information", " address phone email", " about us")).otherwise(none),
        F.when(mode.isin("comprehensive", "financial_focused"), ask(" funding investors", " revenue valuation", " crunchbase")).otherwise(none),
        F.when(F.col("include_social_media"), ask(" linkedin", " twitter", " social media")).otherwise(none),
        F.when(F.col("include_key_personnel"), ask(" CEO founder", " leadership team", " executives")).otherwise(none))
    return (requests.select("request_id", F.posexplode(F.slice(every, 1, most)).alias("query_no", "query")))


# Domains, path parts and words that raise or lower the priority of an address.
TRUSTED_DOMAINS = ["linkedin.com", "crunchbase.com", "bloomberg.com", "forbes.com", "reuters.com", "sec.gov"]
TELLING_PATHS = ["about", "contact", "company", "team", "leadership", "investors", "careers", "press", "news"]
CONTACT_WORDS = ["contact", "address", "phone", "email", "location"]
FINANCE_WORDS = ["investor", "funding", "financial", "revenue", "valuation"]
BUSINESS_WORDS = ["company", "business", "corporation", "organization", "startup", "enterprise", "firm"]
UNHELPFUL_DOMAINS = ["wikipedia.org", "facebook.com", "instagram.com", "twitter.com", "youtube.com", "pinterest.com", "reddit.com"]


def has_any(value: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(value, F.lit(w))
    return out


def address_priority(url: Column, title: Column, description: Column, name: Column, domain: Column, mode: Column) -> Column:
    """Worth 0..1 of crawling an address for facts about a company."""
    low = F.lower(url)
    host, path = urls.host(low), urls.path(low)
    who = F.lower(name)
    t, d = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(description, F.lit("")))
    plus = lambda test, x: F.when(test, x).otherwise(0.0)
    own = domain.isNotNull() & (domain != "") & F.contains(host, F.lower(domain))
    named = F.contains(F.regexp_replace(host, "[-_]", ""), F.replace(who, F.lit(" "), F.lit("")))
    wanted = F.when(mode == "contact_focused", has_any(t, CONTACT_WORDS)).when(mode == "financial_focused", has_any(t, FINANCE_WORDS)).otherwise(False)
    score = (F.when(F.coalesce(own, F.lit(False)), 0.4).when(named, 0.3).otherwise(0.0) + plus(has_any(host, TRUSTED_DOMAINS), 0.2)
             + plus(has_any(path, TELLING_PATHS), 0.15) + plus((t != "") & F.contains(t, who), 0.2) + plus((t != "") & wanted, 0.1)
             + plus((d != "") & F.contains(d, who), 0.1) + plus(has_any(d, BUSINESS_WORDS), 0.05))
    for bad in UNHELPFUL_DOMAINS:
        score = score * F.when(F.contains(host, F.lit(bad)), 0.7).otherwise(1.0)
    return F.least(score, F.lit(1.0))


def first_results(results: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("rank")
    return results.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k).drop("rn")


def best_addresses(scored: DataFrame) -> DataFrame:
    """Highest priority of each address of a request, and where it was first seen."""
    return scored.groupBy("request_id", "url").agg(F.max("priority").alias("priority"),
                                                   F.min(F.struct("query_no", "rank")).alias("seen"))


def crawl_shortlist(best: DataFrame, most: str = "max_pages_to_crawl") -> DataFrame:
    """The addresses of each request worth crawling; ``best`` also carries the request's page limit."""
    w = Window.partitionBy("request_id").orderBy(F.desc("priority"), "seen", "url")
    return best.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= F.col(most))
