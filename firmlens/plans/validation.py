"""Queries that check requests, records and texts."""
from __future__ import annotations

from pyspark.sql import functions as F

from firmlens.functions import text, urls
from firmlens.operators import quality, validation
from firmlens.plans import views
from firmlens.plans.registry import query


def joined(df, *cols):
    return df.withColumns({c: F.array_join(c, "; ") for c in cols})


def case_list(*checks):
    return "concat_ws('; ', " + ", ".join(f"CASE WHEN NOT coalesce({ok}, false) THEN '{m}' END" for ok, m in checks) + ")"


_SEARCH = case_list(
    ("length(query) >= 1", "query is empty"), ("regexp_full_match(country, '[A-Z]{2}')", "country is not two capitals"),
    ("regexp_full_match(language, '[a-z]{2}')", "language is not two small letters"), ("page BETWEEN 1 AND 100", "page is not 1..100"),
    ("results_per_page BETWEEN 1 AND 100", "results per page is not 1..100"),
    ("max_pages IS NULL OR max_pages BETWEEN 1 AND 10", "max pages is not 1..10"),
    ("start_page IS NULL OR start_page >= 1", "start page is below 1"),
    ("start_page IS NULL OR max_pages IS NOT NULL", "start page needs max pages"))


@query("search_request_checks", "search_request", f"SELECT request_id, {_SEARCH} AS errors, {_SEARCH} = '' AS is_valid FROM search_request")
def search_request_checks(spark, sf):
    return joined(validation.check_search_requests(views.search_requests(spark, sf)).select("request_id", "errors", "is_valid"), "errors")


_COMPANY = case_list(
    ("length(trim(company_name)) >= 2", "name is too short"), ("length(company_name) <= 100", "name is too long"),
    ("domain IS NULL OR length(domain) <= 100", "domain is too long"), ("max_pages_to_crawl <= 20", "too many pages"),
    ("timeout_seconds <= 120", "timeout is too long"),
    ("NOT (extraction_mode = ''basic'' AND NOT include_contact_info AND NOT include_social_media AND NOT include_financial_data)".replace("''", "'"),
     "nothing to extract"))


@query("company_request_checks", "company_request", f"SELECT request_id, {_COMPANY} AS errors, {_COMPANY} = '' AS is_valid FROM company_request")
def company_request_checks(spark, sf):
    return joined(validation.check_company_requests(views.company_requests(spark, sf)).select("request_id", "errors", "is_valid"), "errors")


_DOMAIN = ("regexp_full_match({0}, '[a-zA-Z0-9]([a-zA-Z0-9\\-]{{0,61}}[a-zA-Z0-9])?(\\.[a-zA-Z0-9]([a-zA-Z0-9\\-]{{0,61}}[a-zA-Z0-9])?)*')"
           " AND length({0}) <= 253")
_NORMAL = "rtrim(regexp_replace(regexp_replace(lower(trim({0})), '^https?://', ''), '^www\\.', ''), '/')"
_NAME = "regexp_full_match({0}, '[\\p{{L}}\\p{{N}}_\\s\\-.,&()''\"]+')"
_STRICT = case_list(
    ("length(trim(company_name)) >= 2", "name is too short"), ("length(trim(company_name)) <= 200", "name is too long"),
    ("length(trim(company_name)) < 2 OR " + _NAME.format("trim(company_name)"), "name has invalid characters"),
    ("domain IS NULL OR (" + _DOMAIN.format(_NORMAL.format("domain")) + ")", "domain is malformed"),
    ("regexp_full_match(country, '[A-Z]{2}')", "country is not two capitals"),
    ("regexp_full_match(language, '[a-z]{2}')", "language is not two small letters"),
    ("timeout_seconds > 0 AND timeout_seconds <= 300", "timeout is not 1..300"),
    ("max_pages_to_crawl > 0 AND max_pages_to_crawl <= 20", "pages is not 1..20"))


@query("company_request_strict_checks", "company_request", f"SELECT request_id, {_STRICT} AS errors, {_STRICT} = '' AS is_valid FROM company_request")
def company_request_strict_checks(spark, sf):
    return joined(validation.check_company_requests_strictly(views.company_requests(spark, sf)).select("request_id", "errors", "is_valid"), "errors")


_PAGES = case_list(
    ("coalesce(start_page, page) >= 1", "page is below 1"), ("coalesce(start_page, page) <= 100", "page is above 100"),
    ("results_per_page >= 1", "results per page is below 1"), ("results_per_page <= 100", "results per page is above 100"),
    ("max_pages <= 10", "more than 10 pages"), ("coalesce(start_page, page) + max_pages - 1 <= 100", "end page is above 100"),
    ("max_pages * results_per_page <= 1000", "more than 1000 results"))


@query("page_request_checks", "search_request", f"SELECT request_id, {_PAGES} AS errors, {_PAGES} = '' AS is_valid FROM search_request WHERE max_pages IS NOT NULL")
def page_request_checks(spark, sf):
    r = views.search_requests(spark, sf).filter("max_pages is not null")
    return joined(validation.check_page_requests(r).select("request_id", "errors", "is_valid"), "errors")


_RECORD_SQL = """rec AS (SELECT company_id, CASE WHEN company_id % 17 = 0 THEN 'A' WHEN company_id % 19 = 0 THEN 'Bad<Name>' ELSE name END AS name,
    CASE WHEN company_id % 5 = 0 THEN NULL WHEN company_id % 23 = 0 THEN 'not..valid' ELSE 'https://www.customer' || company_id || '.com/' END AS domain,
    CASE WHEN company_id % 10 = 0 THEN 'Bad@' ELSE email END AS email, CASE WHEN company_id % 11 = 0 THEN '12' ELSE phone END AS phone,
    CASE WHEN company_id % 13 = 0 THEN 'ftp://x' ELSE website END AS website,
    description, industry, founded_year, address, city, country, n_social, n_people, revenue, employees FROM company)"""


def records(spark, sf):
    k = F.col("company_id")
    return views.companies(spark, sf).select(
        "company_id", F.when(k % 17 == 0, "A").when(k % 19 == 0, "Bad<Name>").otherwise(F.col("name")).alias("name"),
        F.when(k % 5 == 0, None).when(k % 23 == 0, "not..valid")
         .otherwise(F.concat(F.lit("https://www.customer"), k.cast("string"), F.lit(".com/"))).alias("domain"),
        F.when(k % 10 == 0, "Bad@").otherwise(F.col("email")).alias("email"),
        F.when(k % 11 == 0, "12").otherwise(F.col("phone")).alias("phone"),
        F.when(k % 13 == 0, "ftp://x").otherwise(F.col("website")).alias("website"),
        "description", "industry", "founded_year", "address", "city", "country", "n_social", "n_people", "revenue", "employees")


def _count(fields):
    return "(" + " + ".join(f"CASE WHEN {f} IS NOT NULL AND CAST({f} AS VARCHAR) NOT IN ('', '0', '0.0', 'false') THEN 1 ELSE 0 END" for f in fields) + ")"


_Q1 = f"""q1 AS (SELECT *, {_count(quality.BASIC)} / 5 AS b, {_count(quality.CONTACT)} / 5 AS c, {_count(quality.EXTRA)} / 3 AS e FROM rec),
    q AS (SELECT *, b * 0.6::DOUBLE + c * 0.4::DOUBLE + CASE WHEN e > 0.5 THEN 0.1::DOUBLE ELSE 0 END AS q,
      b * 0.5 + c * 0.5 + CASE WHEN e > 0.5 THEN 0.1::DOUBLE ELSE 0 END AS comp FROM q1)"""


@query("validator_quality", "company", f"""{_RECORD_SQL}, {_Q1} SELECT company_id, round(q, 2) AS quality_score, round(comp, 2) AS completeness_score,
    CASE WHEN q >= 0.8 THEN 'excellent' WHEN q >= 0.6 THEN 'good' WHEN q >= 0.4 THEN 'fair' ELSE 'poor' END AS quality_level,
    concat_ws('; ', CASE WHEN b < 0.5 THEN 'basic' END, CASE WHEN c < 0.3 THEN 'contact' END) AS issues FROM q""")
def validator_quality(spark, sf):
    return joined(quality.validator_score(records(spark, sf)).select(
        "company_id", "quality_score", "completeness_score", "quality_level", "issues"), "issues")


@query("record_checks", "company", f"""{_RECORD_SQL}, {_Q1}, ok AS (SELECT *, length(trim(name)) BETWEEN 2 AND 200 AND {_NAME.format('trim(name)')} AS good FROM q)
    SELECT company_id, good AS is_valid, CASE WHEN good THEN '' ELSE 'name' END AS errors, {case_list(
        ("domain IS NULL OR domain = '' OR (" + _DOMAIN.format(_NORMAL.format("domain")) + ")", "domain"),
        ("email IS NULL OR email = '' OR regexp_full_match(lower(trim(email)), '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+[.][a-zA-Z]{2,}')", "email"),
        ("phone IS NULL OR phone = '' OR regexp_full_match(regexp_replace(trim(phone), '[^0-9+()\\s.\\-]', '', 'g'), '[+]?[1-9]?[0-9\\s()\\-.]{7,15}')", "phone"),
        ("website IS NULL OR website = '' OR regexp_matches(trim(website), '^https?://[^/?#]+')", "website"), ("round(q, 2) >= 0.4", "low quality"))} AS warnings FROM ok""")
def record_checks(spark, sf):
    scored = quality.validator_score(records(spark, sf))
    out = validation.check_records(scored, F.col("quality_score"))
    return joined(out.select("company_id", "is_valid", "errors", "warnings"), "errors", "warnings")


@query("quality_assessment", "company", f"""{_RECORD_SQL}, a AS (SELECT *, {_count(["name", "description", "website"])} / 3 AS b,
      {_count(["email", "phone", "address"])} / 3 AS c, {_count(["industry", "founded_year", "employees", "n_social", "n_people"])} / 5 AS m FROM rec),
    q AS (SELECT *, b * 0.4::DOUBLE + c * 0.3::DOUBLE + m * 0.3::DOUBLE AS q FROM a)
    SELECT company_id, round(q, 2) AS quality_score, CASE WHEN q >= 0.8 THEN 'high_quality' WHEN q >= 0.6 THEN 'good_quality'
      WHEN q >= 0.4 THEN 'moderate_quality' ELSE 'low_quality' END AS assessment,
    concat_ws(', ', CASE WHEN description IS NULL THEN 'description' END, CASE WHEN website IS NULL THEN 'website' END) AS missing_basic,
    concat_ws(', ', CASE WHEN email IS NULL THEN 'email' END, CASE WHEN phone IS NULL THEN 'phone' END, CASE WHEN address IS NULL THEN 'address' END) AS missing_contact,
    round(m, 2) AS additional_share, concat_ws('; ', CASE WHEN round(q, 2) < 0.6 THEN 'domain; mode; website' END, CASE WHEN b < 1 THEN 'spelling' END,
      CASE WHEN c < 1 THEN 'contact' END, CASE WHEN round(m, 2) < 0.5 THEN 'social' END) AS suggestions FROM q""")
def quality_assessment(spark, sf):
    return joined(quality.assessment(records(spark, sf)).select(
        "company_id", "quality_score", "assessment", "missing_basic", "missing_contact", "additional_share", "suggestions"), "suggestions")


@query("weighted_confidence", "company", f"""{_RECORD_SQL} SELECT company_id, round({_count(["name", "website", "email"])} / 3 * 0.7
    + {_count(["description", "phone", "industry", "city"])} / 4 * 0.3, 6) AS confidence_score FROM rec""")
def weighted_confidence(spark, sf):
    out = quality.weighted_confidence(records(spark, sf), ["name", "website", "email"], ["description", "phone", "industry", "city"])
    return out.select("company_id", F.round("confidence_score", 6).alias("confidence_score"))


@query("populated_share", "company", _RECORD_SQL + """, p AS (SELECT company_id, """ + " + ".join(
    f"CASE WHEN {f} IS NOT NULL THEN 1 ELSE 0 END" for f in ["name", "description", "website", "industry", "email", "phone", "address", "city"]) + """ AS n FROM rec)
    SELECT company_id, CAST(n AS INT) AS populated, round(n / CASE company_id % 4 WHEN 0 THEN 6 WHEN 1 THEN 11 WHEN 2 THEN 15 ELSE 11 END, 6) AS data_completeness FROM p""")
def populated_share(spark, sf):
    mode = F.element_at(F.array(*[F.lit(m) for m in ("basic", "standard", "comprehensive", "other")]), (F.col("company_id") % 4 + 1).cast("int"))
    out = quality.populated_share(records(spark, sf), ["name", "description", "website", "industry", "email", "phone", "address", "city"], mode)
    return out.select("company_id", "populated", F.round("data_completeness", 6).alias("data_completeness"))


@query("extraction_scores", "company", """SELECT company_id, round((15 + CASE WHEN length(description) > 20 THEN 10 ELSE 0 END
      + CASE WHEN website IS NOT NULL THEN 10 ELSE 0 END + 5 + CASE WHEN email IS NOT NULL THEN 15 ELSE 0 END + CASE WHEN phone IS NOT NULL THEN 10 ELSE 0 END
      + CASE WHEN address IS NOT NULL THEN 5 ELSE 0 END + least(n_social * 4, 20) + CASE WHEN money_text IS NOT NULL THEN 5 ELSE 0 END
      + CASE WHEN n_people > 0 THEN 5 ELSE 0 END) / 100, 2) AS confidence_score,
    round((1 + CASE WHEN description IS NULL THEN 0 ELSE least(length(description) / 100, 1) END + (CASE WHEN email IS NOT NULL THEN 0.4::DOUBLE ELSE 0 END
      + CASE WHEN phone IS NOT NULL THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN address IS NOT NULL THEN 0.3::DOUBLE ELSE 0 END) + least(n_social / 3, 1)) / 4, 2) AS data_quality_score,
    round((3 + (description IS NOT NULL)::INT + (website IS NOT NULL)::INT + (city IS NOT NULL)::INT + (email IS NOT NULL)::INT + (phone IS NOT NULL)::INT
      + (address IS NOT NULL)::INT + (city IS NOT NULL)::INT + (state IS NOT NULL)::INT + least(n_social, 5) + CASE WHEN money_text IS NOT NULL THEN 2 ELSE 0 END
      + least(n_people, 2)) / 20, 2) AS completeness_score FROM company""")
def extraction_scores(spark, sf):
    c = views.companies(spark, sf).withColumns({"headquarters": F.col("city"), "has_financials": F.col("money_text").isNotNull()})
    return quality.extraction_scores(c).select("company_id", "confidence_score", "data_quality_score", "completeness_score")


@query("sanitized_records", "company", r"""SELECT company_id, regexp_replace(trim(regexp_replace('  <b>' || name || '</b>  x ', '\s+', ' ', 'g')), '<[^>]+>', '', 'g') AS name,
    coalesce(lower(trim(' ' || upper(email))), '') AS email, coalesce(regexp_replace(trim(phone || ' ext#9'), '[^0-9+()\s.\-]', '', 'g'), '') AS phone,
    CASE WHEN website IS NULL THEN '' WHEN company_id % 2 = 0 THEN website ELSE 'https://' || replace(website, 'https://', '') END AS website,
    'customer' || company_id || '.com' AS domain FROM company""")
def sanitized_records(spark, sf):
    k = F.col("company_id")
    c = views.companies(spark, sf)
    return c.select(
        "company_id", text.sanitized(F.concat(F.lit("  <b>"), "name", F.lit("</b>  x "))).alias("name"),
        text.clean_email(F.concat(F.lit(" "), F.upper("email"))).alias("email"),
        text.clean_phone(F.concat("phone", F.lit(" ext#9"))).alias("phone"),
        urls.with_scheme(F.when(k % 2 == 0, F.col("website")).otherwise(F.replace("website", F.lit("https://"), F.lit("")))).alias("website"),
        urls.normal_domain(F.concat(F.lit(" HTTPS://www.Customer"), k.cast("string"), F.lit(".com/"))).alias("domain"))


@query("sanitized_text", "", r"""t AS (SELECT doc_id, regexp_replace(regexp_replace(trim(regexp_replace(text, '[\t\n\v\f\r\x{85}\p{Z}]+', ' ', 'g')), '<[^>]+>', '', 'g'),
      '[\x00-\x08\x0B-\x0C\x0E-\x1F\x7F]', '', 'g') AS t FROM documents)
    SELECT doc_id, length(t) AS clean_chars, md5(t) AS clean_md5, CASE WHEN length(t) > 200 THEN regexp_replace(left(t, 200), ' [^ ]*$', '') || '...' ELSE t END AS summary,
    CASE WHEN length(t) > 80 THEN left(t, 80) || '...' ELSE t END AS label FROM t""")
def sanitized_text(spark, sf):
    t = views.documents(spark, sf).select("doc_id", text.sanitized(F.col("text")).alias("t"))
    return t.select("doc_id", F.length("t").cast("long").alias("clean_chars"), F.md5("t").alias("clean_md5"),
                    text.cut_at_word(F.col("t"), 200).alias("summary"), text.shortened(F.col("t"), 80).alias("label"))


_W = r"[\p{L}\p{N}_]"
_NW = r"(?:^|$|[^\p{L}\p{N}_])"


def _re2(patterns):
    out = [p.replace(r"\b(", r"(?:^|[^\p{L}\p{N}_])(").replace(r")\b", r")(?:$|[^\p{L}\p{N}_])").replace(r"\w", _W).replace("'", "''") for p in patterns]
    return " OR ".join(f"regexp_matches({{0}}, '(?i){p}')" for p in out)


def _strip():
    expr = "text"
    for p in validation.SCRIPT_PATTERNS:
        expr = f"regexp_replace({expr}, '(?i){p.replace(chr(92) + 'w', _W)}', '', 'g')"
    return expr


@query("text_threats", "", f"""c AS (SELECT doc_id, text, {_strip()} AS clean FROM documents), d AS (SELECT *, url_decode(clean) AS decoded FROM c)
    SELECT doc_id, length(text) > 10000 AS too_long, {_re2(validation.SQL_PATTERNS).replace('{0}', 'text')} AS sql, clean <> text AS script,
    {_re2(validation.COMMAND_PATTERNS).replace('{0}', 'clean')} AS command, {_re2(validation.TRAVERSAL_PATTERNS).replace('{0}', 'clean')} AS traversal,
    decoded <> clean AND ({_re2(validation.SQL_PATTERNS + validation.SCRIPT_PATTERNS).replace('{0}', 'decoded')}) AS evasion, md5(clean) AS clean_md5 FROM d""")
def text_threats(spark, sf):
    d = views.documents(spark, sf)
    return validation.scan_text(d, "text").select("doc_id", "too_long", "sql", "script", "command", "traversal", "evasion",
                                                  F.md5("clean_text").alias("clean_md5"))


_HEADS_SQL = """h AS (SELECT event_id, CASE agent % 5 WHEN 0 THEN '' WHEN 1 THEN repeat('x', 1001) WHEN 2 THEN 'curl/7.68.0' ELSE 'Mozilla/5.0' END AS ua,
    CASE event_id % 6 WHEN 0 THEN '<b>' WHEN 1 THEN '../x' WHEN 2 THEN 'http://a' WHEN 3 THEN 'do exec now' WHEN 4 THEN '10.0.0.1' END AS v FROM req)"""


@query("header_threats", "req", _HEADS_SQL + """ SELECT event_id, ua = '' OR length(ua) > 1000 AS odd_agent,
    v IS NOT NULL AND regexp_matches(v, '[<>"&]|\\.\\./|(http|https|ftp)://|(^|[^a-z])(eval|exec|system|shell_exec)($|[^a-z])') AS odd_header FROM h""")
def header_threats(spark, sf):
    e = views.events(spark, sf).select(
        "event_id", F.when(F.col("agent") % 5 == 0, "").when(F.col("agent") % 5 == 1, F.repeat(F.lit("x"), F.lit(1001)))
        .when(F.col("agent") % 5 == 2, "curl/7.68.0").otherwise("Mozilla/5.0").alias("user_agent"),
        F.element_at(F.array(F.lit("<b>"), F.lit("../x"), F.lit("http://a"), F.lit("do exec now"), F.lit("10.0.0.1"), F.lit(None)),
                     (F.col("event_id") % 6 + 1).cast("int")).alias("header_value"))
    return validation.scan_headers(e).select("event_id", "odd_agent", "odd_header")


@query("field_checks", "company", r"""f AS (SELECT company_id, CASE company_id % 4 WHEN 0 THEN 'a@b.co' WHEN 1 THEN 'a@b' WHEN 2 THEN name || '@x.com' ELSE email END AS e,
      CASE company_id % 3 WHEN 0 THEN '(555) 123-' || company_id WHEN 1 THEN 'call ' || company_id ELSE phone END AS p,
      CASE company_id % 3 WHEN 0 THEN 'https://WWW.x' || company_id || '.org/' WHEN 1 THEN 'a_b' ELSE 'x.y.z' END AS d FROM company)
    SELECT company_id, coalesce(regexp_full_match(lower(trim(e)), '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}'), false) AS email_ok,
    coalesce(regexp_full_match(regexp_replace(trim(p), '[^0-9+()\s.\-]', '', 'g'), '[+]?[1-9]?[0-9\s()\-.]{7,15}'), false) AS phone_ok,
    rtrim(regexp_replace(regexp_replace(lower(trim(d)), '^https?://', ''), '^www\.', ''), '/') AS domain,
    regexp_full_match(rtrim(regexp_replace(regexp_replace(lower(trim(d)), '^https?://', ''), '^www\.', ''), '/'), '[a-z0-9.\-]+') AS domain_ok FROM f""")
def field_checks(spark, sf):
    k = F.col("company_id")
    s = k.cast("string")
    f = views.companies(spark, sf).select(
        "company_id", F.when(k % 4 == 0, "a@b.co").when(k % 4 == 1, "a@b").when(k % 4 == 2, F.concat("name", F.lit("@x.com"))).otherwise(F.col("email")).alias("e"),
        F.when(k % 3 == 0, F.concat(F.lit("(555) 123-"), s)).when(k % 3 == 1, F.concat(F.lit("call "), s)).otherwise(F.col("phone")).alias("p"),
        F.when(k % 3 == 0, F.concat(F.lit("https://WWW.x"), s, F.lit(".org/"))).when(k % 3 == 1, "a_b").otherwise("x.y.z").alias("d"))
    return f.select("company_id", text.is_email(F.col("e")).alias("email_ok"), text.is_phone(F.col("p")).alias("phone_ok"),
                    urls.normal_domain(F.col("d")).alias("domain"), urls.is_domain(F.col("d")).alias("domain_ok"))
