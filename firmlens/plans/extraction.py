"""Queries that extract company facts and search results from pages."""
from __future__ import annotations

from pyspark.sql import functions as F

from firmlens.operators import extraction, fusion, quality
from firmlens.operators.durable import computed_once
from firmlens.plans import views
from firmlens.plans.registry import query
from firmlens.plans.telemetry import rounded
from firmlens.sources import html_tables

_PLAIN = r"""plain AS (SELECT page_id, replace(replace(replace(replace(title, '&amp;', '&'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·') AS title,
    replace(replace(replace(replace(h1, '&amp;', '&'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·') AS h1, html, url,
    replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script[^>]*>.*?</script>', '', 'g'), '(?s)<style[^>]*>.*?</style>', '', 'g'),
      '(?s)<!--.*?-->', '', 'g'), '<[^>]+>', '', 'g'), '&amp;', '&'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·') AS t FROM page)"""


def parts(spark, sf):
    return html_tables.page_table(views.table(spark, sf, "pages"), ["page_id", "url"])


@query("page_parts", "page", _PLAIN + r""" SELECT page_id, trim(title) AS title, trim(h1) AS h1, len(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS links,
    md5(regexp_replace(t, '\s+', '', 'g')) AS text_md5, length(regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1)) > 0 AS has_contact FROM plain""")
def page_parts(spark, sf):
    return parts(spark, sf).select("page_id", "title", extraction.first_item(F.col("h1s")).alias("h1"), F.size("links").cast("long").alias("links"),
                                   F.md5(F.regexp_replace("text", r"\s+", "")).alias("text_md5"), (F.col("contact_text") != F.col("text")).alias("has_contact"))


@query("page_company_names", "page", r"""n AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'Home - ' || title WHEN page_id % 4 = 1 THEN 'Acme' || page_id || ' Ltd | ' || title WHEN page_id % 4 = 2 THEN title || ' - About' ELSE title END AS t,
      CASE WHEN page_id % 4 = 0 THEN h1 END AS h FROM page),
    c AS (SELECT page_id, h, t, trim(regexp_extract(t, '^([^|]+)\|', 1)) AS a, trim(regexp_extract(t, '^([^-]+)-', 1)) AS b, trim(regexp_extract(t, '^(.+?)(?:\s*-\s*.+)?$', 1)) AS c FROM n)
    SELECT page_id, coalesce(CASE WHEN length(a) > 2 AND NOT lower(a) LIKE '%home%' THEN a END, CASE WHEN length(b) > 2 AND NOT lower(b) LIKE '%home%' THEN b END,
      CASE WHEN length(c) > 2 AND NOT lower(c) LIKE '%home%' THEN c END, CASE WHEN length(h) > 2 AND length(h) < 100 THEN h END, 'Unknown Company') AS name FROM c""")
def page_company_names(spark, sf):
    k = F.col("page_id")
    p = views.pages(spark, sf).select(
        "page_id", F.when(k % 4 == 0, F.concat(F.lit("Home - "), "title")).when(k % 4 == 1, F.concat(F.lit("Acme"), k.cast("string"), F.lit(" Ltd | "), "title"))
        .when(k % 4 == 2, F.concat("title", F.lit(" - About"))).otherwise(F.col("title")).alias("t"),
        F.when(k % 4 == 0, F.array("h1")).otherwise(F.array().cast("array<string>")).alias("h"))
    none = F.lit(None).cast("string")
    return p.select("page_id", extraction.company_name(none, F.col("t"), F.col("h"), none).alias("name"))


def _count(word):
    return f"((length(low) - length(replace(low, '{word}', ''))) // {len(word)})"


_SCORES = ", ".join(f"({' + '.join(_count(w) for w in words)}) AS s_{s}" for s, words in extraction.SECTOR_WORDS.items())
_BEST = "greatest(" + ", ".join(f"s_{s}" for s in extraction.SECTOR_WORDS) + ")"
_SECTOR = "CASE WHEN top = 0 THEN NULL " + " ".join(f"WHEN s_{s} = top THEN '{s}'" for s in extraction.SECTOR_WORDS) + " END"
_TITLED = {w: " ".join(x.capitalize() for x in w.split(" ")) for ws in extraction.SECTOR_WORDS.values() for w in ws}
_WORD = "CASE sector " + " ".join(f"WHEN '{s}' THEN CASE " + " ".join(f"WHEN contains(low, '{w}') THEN '{_TITLED[w]}'" for w in ws) + " END"
                                  for s, ws in extraction.SECTOR_WORDS.items()) + " END"


def sector_sql(source, keys, text):
    return (f"sc AS (SELECT {keys}, low, {_SCORES} FROM (SELECT {keys}, lower({text}) AS low FROM {source})), sb AS (SELECT *, {_BEST} AS top FROM sc), "
            f"ss AS (SELECT *, {_SECTOR} AS sector FROM sb), sector AS (SELECT {keys}, sector, {_WORD} AS industry FROM ss)")


@query("document_sectors", "", sector_sql("documents", "doc_id", "text") + " SELECT doc_id, sector, industry FROM sector")
def document_sectors(spark, sf):
    return extraction.with_sector(views.documents(spark, sf), "text").select("doc_id", "sector", "industry")


_EMAIL_SQL = r"""list_distinct_ordered(list_filter(list_transform(regexp_extract_all({0}, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}'), lambda e: lower(e)),
    lambda e: NOT regexp_matches(e, '@(gmail\.com|yahoo\.com|hotmail\.com|outlook\.com)$|@(example\.com|test\.com|domain\.com)$|(no-?reply|noreply|donotreply){1}')))"""


def ordered_distinct(expr):
    return f"list_filter({expr}, lambda x, i: list_position({expr}, x) = i)"


def emails_sql(text, role=r"|(support|help|contact|info)@"):
    inner = _EMAIL_SQL.format(text, role)[len("list_distinct_ordered("):-1]
    return ordered_distinct(inner)


def phones_sql(text):
    found = "list_concat(list_concat(" + ", ".join(f"regexp_extract_all({text}, '{p}')" for p in extraction.PHONES[:2]) + f"), regexp_extract_all({text}, '{extraction.PHONES[2]}'))"
    return ordered_distinct(f"list_filter(list_transform({found}, lambda p: trim(p)), lambda p: length(regexp_replace(p, '[^0-9+]', '', 'g')) >= 7)")


@query("document_emails", "", f"""SELECT doc_id, array_to_string({emails_sql('text')}, ' ') AS emails, array_to_string({emails_sql('text', '')}, ' ') AS emails_with_roles FROM documents""")
def document_emails(spark, sf):
    return views.documents(spark, sf).select("doc_id", F.array_join(extraction.emails(F.col("text")), " ").alias("emails"),
                                                      F.array_join(extraction.emails(F.col("text"), True), " ").alias("emails_with_roles"))


@query("document_phones", "", f"SELECT doc_id, array_to_string({phones_sql('text')}, '; ') AS phones FROM documents")
def document_phones(spark, sf):
    return views.documents(spark, sf).select("doc_id", F.array_join(extraction.phones(F.col("text")), "; ").alias("phones"))


def _years(text):
    one = lambda p: (f"list_filter(list_transform(regexp_extract_all({text}, '(?i){p}', 1), lambda y: TRY_CAST(y AS INT)), lambda y: y BETWEEN 1800 AND 2030)[1]")
    return "coalesce(" + ", ".join(one(p) for p in extraction.YEARS) + ")"


@query("document_years", "", f"SELECT doc_id, {_years('t')} AS founded_year FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || ' Established 1' || (doc_id % 900 + 100) ELSE text END AS t FROM documents)")
def document_years(spark, sf):
    k = F.col("doc_id")
    d = views.documents(spark, sf).select("doc_id", F.when(k % 3 == 0, F.concat("text", F.lit(" Established 1"), (k % 900 + 100).cast("string"))).otherwise(F.col("text")).alias("t"))
    return d.select("doc_id", extraction.founded_year(F.col("t")).alias("founded_year"))


@query("firm_years", "firm_text", f"SELECT firm_id, {_years('text')} AS founded_year FROM firm_text")
def firm_years(spark, sf):
    return views.firm_texts(spark, sf).select("firm_id", extraction.founded_year(F.col("text")).alias("founded_year"))


@query("firm_sizes", "firm_text", """n AS (SELECT firm_id, firm_id % 6 AS v, firm_id // 6 AS j FROM firm_text),
    c AS (SELECT firm_id, CASE v WHEN 0 THEN j % 400 + 5 WHEN 1 THEN j % 70 + 3 WHEN 2 THEN j % 2000 + 1 WHEN 3 THEN j % 90 + 60 WHEN 4 THEN j % 30 + 1 END AS employee_count,
      CASE v WHEN 0 THEN (j % 400 + 5) || '-' || (j % 400 + 90) END AS employee_range FROM n)
    SELECT *, CASE WHEN employee_count <= 10 THEN 'startup' WHEN employee_count <= 50 THEN 'small' WHEN employee_count <= 250 THEN 'medium' WHEN employee_count <= 1000 THEN 'large'
      WHEN employee_count > 1000 THEN 'enterprise' END AS company_size FROM c""")
def firm_sizes(spark, sf):
    from firmlens.operators import insight
    count, ranged = extraction.people_counts(F.col("text"))
    f = views.firm_texts(spark, sf).select("firm_id", count.alias("employee_count"), ranged.alias("employee_range"))
    return f.withColumn("company_size", insight.size_class(F.col("employee_count")))


@query("firm_stocks", "firm_text", """SELECT firm_id, CASE firm_id % 7 WHEN 0 THEN 'C' || chr(CAST(65 + firm_id % 26 AS INT)) || 'X' WHEN 2 THEN chr(CAST(65 + firm_id % 26 AS INT)) || 'Q' END AS stock_symbol,
    CASE WHEN firm_id % 7 IN (0, 2, 4) THEN true WHEN firm_id % 7 = 3 THEN false END AS is_public FROM firm_text""")
def firm_stocks(spark, sf):
    symbol, public = extraction.stock(F.col("text"))
    return views.firm_texts(spark, sf).select("firm_id", symbol.alias("stock_symbol"), public.alias("is_public"))


@query("firm_money", "firm_text", """SELECT firm_id, CASE firm_id % 4 WHEN 0 THEN (firm_id % 90 + 1) || '.5M' WHEN 1 THEN (firm_id % 70 + 1) || 'K' END AS funding_total,
    CASE firm_id % 4 WHEN 2 THEN (firm_id % 9 + 1) || 'B' END AS valuation FROM firm_text""")
def firm_money(spark, sf):
    funding, value = extraction.financial_mentions(F.col("text"))
    return views.firm_texts(spark, sf).select("firm_id", funding.alias("funding_total"), value.alias("valuation"))


@query("firm_executives", "firm_text", r"""m AS (SELECT firm_id, regexp_extract_all(text, '(?i)([\p{L}\p{N}_\s]+),?\s+(CEO|CTO|CFO|COO|President|Founder)', 1) AS n, regexp_extract_all(text, '(?i)([\p{L}\p{N}_\s]+),?\s+(CEO|CTO|CFO|COO|President|Founder)', 2) AS t FROM firm_text)
    SELECT firm_id, CAST(i AS INT) AS place, regexp_replace(n[i], '^\s+|\s+$', '', 'g') AS name, upper(t[i]) AS title FROM m, range(1, 6) r(i) WHERE i <= len(n)""")
def firm_executives(spark, sf):
    p = views.firm_texts(spark, sf).select("firm_id", F.posexplode(extraction.executives(F.col("text"))).alias("pos", "p"))
    return p.select("firm_id", (F.col("pos") + 1).alias("place"), "p.name", "p.title")


_ADDR = [p.replace("'", "''") for p in extraction.ADDRESSES]


@query("firm_addresses", "firm_text", f"""m AS (SELECT firm_id, """ + ", ".join(
    f"list_filter(list_transform(regexp_extract_all(text, '(?i){p}'), lambda m: regexp_replace(m, '^\\s+|\\s+$', '', 'g')), lambda m: length(m) > 10 AND NOT regexp_matches(m, '^\\+?[\\d\\s\\-\\(\\)\\.]+$'))[1] AS a{i}"
    for i, p in enumerate(_ADDR)) + """ FROM firm_text)
    SELECT firm_id, coalesce(a2, a1, a0) AS address, """ + "coalesce(" + ", ".join(f"nullif(regexp_extract(a{i}, '\\b\\d{{5}}(?:-\\d{{4}})?\\b'), '')" for i in (2, 1, 0)) + ") AS postal_code, coalesce("
    + ", ".join(f"nullif(regexp_extract(a{i}, '\\b([A-Z]{{2}})\\s*\\d{{5}}', 1), '')" for i in (2, 1, 0)) + ") AS state, coalesce("
    + ", ".join(f"trim(nullif(regexp_extract(a{i}, ',\\s*([^,]+),\\s*[A-Z]{{2}}\\s*\\d{{5}}', 1), ''))" for i in (2, 1, 0)) + ") AS city FROM m")
def firm_addresses(spark, sf):
    p = extraction.address_parts(F.col("text"))
    return views.firm_texts(spark, sf).select("firm_id", *[p[c].alias(c) for c in ("address", "postal_code", "state", "city")])


@query("firm_places", "firm_text", "m AS (SELECT firm_id, list_filter(list_transform(" + "list_concat(list_concat(" + ", ".join(f"regexp_extract_all(address_text, '(?i){p}')" for p in _ADDR[:2])
    + f"), regexp_extract_all(address_text, '(?i){_ADDR[2]}'))" + r""", lambda m: regexp_replace(m, '^\s+|\s+$', '', 'g')), lambda m: length(m) > 10) AS f,
      list_filter(list_transform(regexp_extract_all(text, '(?i)""" + extraction.PLACES[0] + r"""', 1), lambda m: regexp_replace(m, '^\s+|\s+$', '', 'g')), lambda m: length(m) > 5 AND length(m) < 100)[1] AS p1,
      list_filter(list_transform(regexp_extract_all(text, '(?i)""" + extraction.PLACES[1] + r"""', 1), lambda m: regexp_replace(m, '^\s+|\s+$', '', 'g')), lambda m: length(m) > 5 AND length(m) < 100)[1] AS p2 FROM firm_text)
    SELECT firm_id, coalesce(f[1], p1, p2) AS headquarters, CAST(len(list_distinct(f[2:])) AS INT) AS others FROM m""")
def firm_places(spark, sf):
    hq, rest = extraction.places(F.array("address_text"), F.col("text"))
    return views.firm_texts(spark, sf).select("firm_id", hq.alias("headquarters"), F.size(rest).alias("others"))


@query("firm_contacts", "firm_text", f"""c AS (SELECT firm_id, {emails_sql("concat_ws(E'.\\n', address_text, mail_text, phone_text)")} AS e, {phones_sql("concat_ws(E'.\\n', address_text, mail_text, phone_text)")} AS p,
      firm_id % 4 <> 3 AS has_address FROM firm_text)
    SELECT firm_id, e[1] AS email, p[1] AS phone, CAST(greatest(len(e) - 1, 0) AS INT) AS more_emails, CAST(greatest(len(p) - 1, 0) AS INT) AS more_phones,
    e[1] IS NOT NULL OR p[1] IS NOT NULL OR has_address AS has_contact FROM c""")
def firm_contacts(spark, sf):
    t = views.firm_texts(spark, sf).select("firm_id", F.concat_ws(".\n", "address_text", "mail_text", "phone_text").alias("contact_text"))
    c = extraction.contact(t, "contact_text")
    return c.select("firm_id", "email", "phone", F.size("more_emails").alias("more_emails"), F.size("more_phones").alias("more_phones"), "has_contact")


def firm_pages(spark, sf):
    """Full pages about each company: metas, sections, profile links, JSON-LD."""
    k = F.col("firm_id")
    s = k.cast("string")
    about = F.when(k % 3 == 0, F.concat(F.lit('<div class="about-us"><p>'), F.repeat(F.lit("We make fine things. "), (k % 30).cast("int")), F.lit("</p></div>"))).otherwise(F.lit(""))
    meta = F.when(k % 3 == 1, F.concat(F.lit('<meta name="description" content="Company '), s, F.lit(' makes many fine things">'))).otherwise(F.lit('<meta name="description" content="short">'))
    og = F.when(k % 6 == 2, F.concat(F.lit('<meta property="og:description" content="The open page of company '), s, F.lit('">'))).otherwise(F.lit(""))
    ld = F.when(k % 4 == 0, F.concat(F.lit('<script type="application/ld+json">{"@type": "Organization", "name": "LD '), s, F.lit('", "foundingDate": "1999-05-01", "email": "ld@firm.com", '
                '"address": {"streetAddress": "1 Ld Way", "addressLocality": "Ldtown", "addressCountry": "CH"}}</script>')))\
        .when(k % 4 == 1, F.concat(F.lit('<script type="application/ld+json">[{"@type": "Person", "name": "P"}, {"@type": "Corporation", "description": "Ld text '), s, F.lit('", "telephone": "+41 1"}]</script>')))\
        .when(k % 4 == 2, F.lit('<script type="application/ld+json">{broken</script>')).otherwise(F.lit(""))
    links = F.concat(F.lit('<a href="https://www.linkedin.com/company/c'), s, F.lit('?x=1">in</a><a href="#top">top</a>'),
                     F.when(k % 2 == 0, F.concat(F.lit('<a href="https://x.com/x'), s, F.lit('">x</a><a href="https://x.com/x'), s, F.lit('">again</a>'))).otherwise(F.lit("")),
                     F.when(k % 5 == 0, F.concat(F.lit('<a href="https://youtube.com/channel/y'), s, F.lit('/v">yt</a>'))).otherwise(F.lit("")), F.lit('<a href="/about">us</a>'))
    page = F.concat(F.lit("<html><head><title>Firm "), s, F.lit(" | Official</title>"), meta, og, ld, F.lit("</head><body><h1>Firm "), s, F.lit("</h1>"), about, links, F.lit("<p>"),
                    F.concat_ws(".\n", "size_text", "year_text", "stock_text", "money_text", "people_text"), F.lit('.\n</p><footer class="contact">'),
                    F.concat_ws(".\n", "address_text", "mail_text", "phone_text"), F.lit("</footer></body></html>"))
    return views.firm_texts(spark, sf).select("firm_id", F.lit(None).cast("string").alias("known_name"), F.concat(F.lit("https://www.firm"), s, F.lit(".com/about?x")).alias("url"),
                                              F.when(k % 17 == 5, "").otherwise(page).alias("html"))


def firm_parts(spark, sf):
    return html_tables.page_table(firm_pages(spark, sf), ["firm_id", "url", "known_name"])


_LIVE = "live AS (SELECT *, firm_id % 17 <> 5 AS ok, firm_id AS k FROM firm_text)"


@query("firm_descriptions", "firm_text", _LIVE + """, a AS (SELECT *, repeat('We make fine things. ', k % 30) AS ab FROM live)
    SELECT firm_id, CASE WHEN NOT ok THEN NULL WHEN k % 3 = 1 THEN 'Company ' || k || ' makes many fine things' WHEN k % 6 = 2 THEN 'The open page of company ' || k
      WHEN k % 3 = 0 AND length(trim(ab)) > 50 AND length(trim(ab)) < 500 THEN trim(ab) END AS description FROM a""")
def firm_descriptions(spark, sf):
    return firm_parts(spark, sf).select("firm_id", extraction.description(F.col("meta_description"), F.col("og_description"), F.col("about")).alias("description"))


@query("firm_profiles", "firm_text", _LIVE + """ SELECT firm_id, 'https://www.linkedin.com/company/c' || k || '?x=1' AS href, 'linkedin' AS platform, 'c' || k AS username FROM live WHERE ok
    UNION ALL SELECT firm_id, 'https://x.com/x' || k, 'twitter', 'x' || k FROM live WHERE ok AND k % 2 = 0
    UNION ALL SELECT firm_id, 'https://youtube.com/channel/y' || k || '/v', 'youtube', 'y' || k FROM live WHERE ok AND k % 5 = 0""")
def firm_profiles(spark, sf):
    return extraction.profiles(firm_parts(spark, sf), ["firm_id"])


@query("firm_structured_data", "firm_text", _LIVE + """ SELECT firm_id, CASE WHEN k % 4 = 0 THEN 'LD ' || k END AS ld_name, CASE WHEN k % 4 = 1 THEN 'Ld text ' || k END AS ld_description,
    CASE WHEN k % 4 = 0 THEN 1999 END AS ld_founded_year, CASE WHEN k % 4 = 0 THEN 'ld@firm.com' END AS ld_email, CASE WHEN k % 4 = 1 THEN '+41 1' END AS ld_phone,
    CASE WHEN k % 4 = 0 THEN '1 Ld Way, Ldtown' END AS ld_address, CASE WHEN k % 4 = 0 THEN 'CH' END AS ld_country FROM live WHERE ok""")
def firm_structured_data(spark, sf):
    p = firm_parts(spark, sf).filter("text <> ''")
    return extraction.with_structured_data(p, "jsonld").select("firm_id", "ld_name", "ld_description", "ld_founded_year", "ld_email", "ld_phone", "ld_address", "ld_country")


@query("firm_page_records", "firm_text", _LIVE + f""", c AS (SELECT *, concat_ws(E'.\\n', address_text, mail_text, phone_text) AS ct, concat_ws(E'.\\n', size_text, year_text, stock_text, money_text, people_text) || E'.\\n' AS body FROM live),
    y AS (SELECT *, {_years("'Firm ' || k || ' | OfficialFirm ' || k || repeat('We make fine things. ', CASE WHEN k % 3 = 0 THEN k % 30 ELSE 0 END) || 'intop' || CASE WHEN k % 2 = 0 THEN 'xagain' ELSE '' END || CASE WHEN k % 5 = 0 THEN 'yt' ELSE '' END || 'us' || body || ct")} AS yr,
      {emails_sql('ct')}[1] AS em, {phones_sql('ct')}[1] AS ph FROM c)
    SELECT firm_id, CASE WHEN ok THEN 'Firm ' || k ELSE 'Unknown' END AS name, 'https://www.firm' || k || '.com' AS website, CASE WHEN ok THEN coalesce(yr, CASE WHEN k % 4 = 0 THEN 1999 END) END AS founded_year,
    CASE WHEN ok THEN coalesce(em, CASE WHEN k % 4 = 0 THEN 'ld@firm.com' END) END AS email, CASE WHEN ok THEN coalesce(ph, CASE WHEN k % 4 = 1 THEN '+41 1' END) END AS phone,
    CASE WHEN ok AND k % 4 = 0 THEN 'CH' END AS country FROM y""")
def firm_page_records(spark, sf):
    p = firm_parts(spark, sf).withColumn("html_text", F.col("text"))
    return extraction.company_facts(p).select("firm_id", "name", "website", "founded_year", "email", "phone", "country")


def scored_firms(spark, sf):
    p = firm_parts(spark, sf).withColumn("html_text", F.col("text"))
    facts = extraction.company_facts(p).withColumns({
        "n_social": F.size(extraction.profile_list(F.col("links"))), "n_people": F.size("people"), "has_financials": F.coalesce("funding_total", "valuation").isNotNull()})
    return quality.extraction_scores(facts)


@query("firm_page_scores", "firm_text")
def firm_page_scores(spark, sf):
    """Whole chain for the firm pages; its steps are each checked on their own."""
    return scored_firms(spark, sf).select("firm_id", "name", "sector", "industry", "employee_count", "headquarters", "founded_year", "stock_symbol", "is_public",
                                          "email", "phone", "address", "city", "n_social", "n_people", "confidence_score", "data_quality_score", "completeness_score")


# Search result pages built from the captured pages, with ads, boxes without link, and bad addresses.
def serp_pages(spark, sf):
    s = views.serp_results(spark, sf)
    k = F.col("page_id")
    head = F.concat(F.lit('<div class="g">'), F.when(k % 7 == 0, '<div class="ads-fr">ad</div>').otherwise(""))
    url = F.when(k % 7 == 2, "http://").otherwise(F.col("url"))
    heading = F.concat(F.lit('<h3 class="LC20lb">'), "title", F.lit("</h3>"))
    link = F.when(k % 7 == 1, heading).otherwise(F.concat(F.lit('<a href="'), url, F.lit('">'), heading, F.lit("</a>")))
    about = F.when(k % 7 == 3, F.lit("")).otherwise(F.concat(F.lit('<div class="VwiC3b">• Facts   about <b>page '), k.cast("string"), F.lit("</b></div>")))
    items = s.select("query", "page", F.struct("rank", F.concat(head, link, about, F.lit("</div>")).alias("box")).alias("item"))
    boxes = F.array_join(F.transform(F.array_sort(F.collect_list("item")), lambda x: x["box"]), "")
    total = F.concat(F.lit('<div id="result-stats">About '), F.format_number(F.col("page") * 1234, 0), F.lit(" results</div>"))
    return items.groupBy("query", "page").agg(boxes.alias("boxes")).select(
        "query", "page", F.lit(6).alias("results_per_page"), F.concat(F.lit("<html><body>"), total, F.lit('<div id="search">'), "boxes", F.lit("</div></body></html>")).alias("html"))


_BOXES = r"""box AS (SELECT query, page, rank AS pos, page_id, trim(replace(replace(title, '&amp;', '&'), '&quot;', '"')) AS title, CASE page_id % 7 WHEN 0 THEN 'non_organic' WHEN 1 THEN 'missing_data'
      WHEN 2 THEN 'invalid_url' ELSE 'success' END AS outcome, replace(url, '&amp;', '&') AS url FROM serp),
    run AS (SELECT *, count(*) FILTER (outcome = 'success') OVER (PARTITION BY query, page ORDER BY pos) AS rk FROM box), kept AS (SELECT * FROM run WHERE rk < 6 OR (rk = 6 AND outcome = 'success'))"""


def boxes(spark, sf):
    keys = ["query", "page", "results_per_page"]
    return extraction.organic_results(html_tables.result_table(serp_pages(spark, sf), keys), ["query", "page"], "results_per_page")


@query("organic_results", "serp", _BOXES + """ SELECT query, page, CAST(rk AS INT) AS rank, title, url, CASE WHEN page_id % 7 <> 3 THEN 'Facts about page ' || page_id END AS description FROM kept WHERE outcome = 'success'""")
def organic_results(spark, sf):
    return boxes(spark, sf).filter("outcome = 'success'").select("query", "page", "rank", "title", "url", "description")


@query("parse_statistics", "serp", _BOXES + """ SELECT query, page, count(*) AS processed, count(*) FILTER (outcome = 'non_organic') AS non_organic, count(*) FILTER (outcome = 'missing_data') AS missing_data,
    count(*) FILTER (outcome = 'invalid_url') AS invalid_url, count(*) FILTER (outcome = 'success') AS success, round(count(*) FILTER (outcome = 'success') / count(*) * 100, 6) AS success_pct,
    count(DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) FILTER (outcome = 'success') AS domains FROM kept GROUP BY ALL""")
def parse_statistics(spark, sf):
    return rounded(extraction.parse_statistics(boxes(spark, sf), ["query", "page"]), "success_pct")


@query("search_page_totals", "serp", """b AS (SELECT query, page, '<div class="g">' || CASE WHEN page_id % 7 = 0 THEN '<div class="ads-fr">ad</div>' ELSE '' END
      || CASE WHEN page_id % 7 = 1 THEN '<h3 class="LC20lb">' || title || '</h3>' ELSE '<a href="' || CASE WHEN page_id % 7 = 2 THEN 'http://' ELSE url END || '"><h3 class="LC20lb">' || title || '</h3></a>' END
      || CASE WHEN page_id % 7 = 3 THEN '' ELSE '<div class="VwiC3b">• Facts   about <b>page ' || page_id || '</b></div>' END || '</div>' AS box FROM serp),
    t AS (SELECT query, page, 'About ' || format('{:,}', page * 1234) || ' results' AS stats_text, sum(length(box)) AS boxes FROM b GROUP BY ALL)
    SELECT query, page, stats_text, CAST(page * 1234 AS BIGINT) AS total_results,
    CAST(length('<html><body><div id="result-stats">' || stats_text || '</div><div id="search"></div></body></html>') + boxes AS BIGINT) AS content_length FROM t""")
def search_page_totals(spark, sf):
    return extraction.with_result_total(html_tables.statistics_table(serp_pages(spark, sf), ["query", "page"]))


# The chain from captured pages to one profile per host.
_HOSTS = _PLAIN + ", " + sector_sql("page", "page_id", "text") + f""", ex AS (SELECT p.page_id, p.host, p.scheme, p.text, p.title, s.sector, s.industry, {emails_sql('p.text')}[1] AS email, {phones_sql('p.text')}[1] AS phone,
      {_years('p.text')} AS founded_year FROM page p JOIN sector s ON p.page_id = s.page_id),
    nm AS (SELECT *, coalesce(CASE WHEN length(a) > 2 AND NOT lower(a) LIKE '%home%' THEN a END, CASE WHEN length(b) > 2 AND NOT lower(b) LIKE '%home%' THEN b END,
      CASE WHEN length(c) > 2 AND NOT lower(c) LIKE '%home%' THEN c END, 'Unknown Company') AS name FROM (SELECT *, trim(regexp_extract(title, '^([^|]+)\\|', 1)) AS a, trim(regexp_extract(title, '^([^-]+)-', 1)) AS b,
      trim(regexp_extract(title, '^(.+?)(?:\\s*-\\s*.+)?$', 1)) AS c FROM ex)),
    sc2 AS (SELECT *, round((CASE WHEN name <> 'Unknown Company' THEN 15 ELSE 0 END + 10 + CASE WHEN industry IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN email IS NOT NULL THEN 15 ELSE 0 END
        + CASE WHEN phone IS NOT NULL THEN 10 ELSE 0 END) / 100, 2) AS confidence,
      round((CASE WHEN length(name) > 2 THEN 1 ELSE 0 END + (CASE WHEN email IS NOT NULL THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN phone IS NOT NULL THEN 0.3::DOUBLE ELSE 0 END)) / 4, 2) AS quality,
      round((2 + (industry IS NOT NULL)::INT + (founded_year IS NOT NULL)::INT + (email IS NOT NULL)::INT + (phone IS NOT NULL)::INT) / 20, 2) AS completeness, lpad(page_id::VARCHAR, 12, '0') AS source FROM nm),
    g AS (SELECT *, (-confidence, source) AS o FROM sc2 WHERE confidence > 0.1),
    f AS (SELECT host, count(*) AS sources, arg_min(name, o) AS name, arg_min(industry, o) FILTER (industry IS NOT NULL) AS industry, arg_min(sector, o) FILTER (sector IS NOT NULL) AS sector,
      arg_min(founded_year, o) FILTER (founded_year IS NOT NULL) AS founded_year, arg_min(email, o) FILTER (email IS NOT NULL) AS email, arg_min(phone, o) FILTER (phone IS NOT NULL) AS phone,
      avg(confidence) AS m, max(quality) AS quality, max(completeness) AS completeness FROM g GROUP BY host)
    SELECT host, sources, name, industry, sector, founded_year, email, phone, round(least(m + least(0.1::DOUBLE * (sources - 1), 0.3), 1), 6) AS confidence, quality, completeness FROM f"""


@query("host_profiles", "page", _HOSTS)
def host_profiles(spark, sf):
    none = F.lit(None).cast("string")
    p = views.pages(spark, sf).select("page_id", "host", "scheme", "title", "text")
    facts = computed_once(
        extraction.with_sector(p, "text"), sector=F.col("sector"), industry=F.col("industry"),
        name=extraction.company_name(none, F.col("title"), F.array().cast("array<string>"), none),
        email=extraction.first_item(extraction.emails(F.col("text"))), phone=extraction.first_item(extraction.phones(F.col("text"))),
        founded_year=extraction.founded_year(F.col("text"))).withColumns({
            "website": F.concat("scheme", F.lit("://"), "host"), "description": none, "headquarters": none, "address": none, "city": none, "state": none,
            "n_social": F.lit(0), "n_people": F.lit(0), "has_financials": F.lit(False), "employee_count": F.lit(None).cast("long")})
    scored = quality.extraction_scores(facts).withColumns({
        "source": F.lpad(F.col("page_id").cast("string"), 12, "0"), "confidence": F.col("confidence_score"), "quality": F.col("data_quality_score"), "completeness": F.col("completeness_score")})
    fused = fusion.fuse(scored, "host", simple=["name", *fusion.SIMPLE])
    return rounded(fused.select("host", "sources", "name", "industry", "sector", "founded_year", "email", "phone", "confidence", "quality", "completeness"), "confidence")
