"""Company facts from page text, as native column expressions."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmlens.functions import urls
from firmlens.operators.durable import computed_once

# Words that speak for a sector, in order of precedence.
SECTOR_WORDS = {
    "technology": ["tech", "software", "ai", "artificial intelligence", "saas", "cloud"],
    "finance": ["finance", "financial", "banking", "investment", "fintech"],
    "healthcare": ["health", "medical", "pharma", "biotech", "healthcare"],
    "retail": ["retail", "ecommerce", "shopping", "commerce"],
    "manufacturing": ["manufacturing", "industrial", "factory", "production"],
    "education": ["education", "learning", "school", "university", "training"],
    "consulting": ["consulting", "advisory", "services", "professional services"],
    "real_estate": ["real estate", "property", "realty"],
    "media": ["media", "publishing", "entertainment", "content"],
    "energy": ["energy", "oil", "gas", "renewable", "solar", "wind"]}
# Patterns for mail addresses, phone numbers and postal addresses.
EMAIL = r"(?i)\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"
PRIVATE_MAIL = [r"@(gmail\.com|yahoo\.com|hotmail\.com|outlook\.com)$", r"@(example\.com|test\.com|domain\.com)$",
                r"(no-?reply|noreply|donotreply)"]
ROLE_MAIL = r"(support|help|contact|info)@"
PHONES = [r"\+\d{1,4}[-.\s]?\(?\d{1,4}\)?[-.\s]?\d{1,4}[-.\s]?\d{1,9}", r"\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}",
          r"(?:\+?\d{1,4}[-.\s]?)?\(?\d{1,4}\)?[-.\s]?\d{1,4}[-.\s]?\d{4,9}"]
ADDRESSES = [
    r"\d+\s+[A-Za-z0-9\s,.-]+(?:Street|St|Avenue|Ave|Road|Rd|Drive|Dr|Boulevard|Blvd|Lane|Ln|Way|Plaza|Place|Pl|Court|Ct)",
    r"(?:P\.?O\.?\s+)?Box\s+\d+", r"\d+\s+[^,\n]+,\s*[A-Za-z\s]+,?\s*[A-Z]{2}\s*\d{5}(?:-\d{4})?"]
PLACES = [r"(?:headquarters?|located|based)\s+(?:in|at)?\s*([^,\n]+(?:,\s*[A-Z]{2})?)", r"([A-Za-z\s]+,\s*[A-Z]{2})"]
PEOPLE_COUNTS = [r"(\d+[\-–]?\d*)\s*employees?", r"team\s+of\s+(\d+)", r"staff\s+of\s+(\d+)", r"(\d+)\+?\s*people"]
YEARS = [r"(?:founded|established|since)\s+(?:in\s+)?(\d{4})", r"(?:est\.?|since)\s+(\d{4})", r"(\d{4})\s*[-–]\s*present"]
SYMBOLS = [r"(?:nasdaq|nyse|stock):\s*([A-Z]{1,5})", r"ticker:\s*([A-Z]{1,5})", r"\(([A-Z]{2,5})\)"]
MONEY = [r"raised\s+\$?([\d.]+[MBK]?)\s*(?:million|billion|thousand)?", r"funding[:\s]+\$?([\d.]+[MBK]?)", r"valuation[:\s]+\$?([\d.]+[MBK]?)"]
LEADERS = r"([\w\s]+),?\s+(CEO|CTO|CFO|COO|President|Founder)"
# Addresses of social profiles; group 1 is the account.
PROFILES = [
    ("linkedin", r"(?:https?://)?(?:www\.)?linkedin\.com/(?:company|in)/([^/\s?]+)"),
    ("twitter", r"(?:https?://)?(?:www\.)?(?:twitter|x)\.com/([^/\s?]+)"),
    ("facebook", r"(?:https?://)?(?:www\.)?facebook\.com/([^/\s?]+)"),
    ("instagram", r"(?:https?://)?(?:www\.)?instagram\.com/([^/\s?]+)"),
    ("youtube", r"(?:https?://)?(?:www\.)?youtube\.com/(?:c/|channel/|user/)?([^/\s?]+)"),
    ("github", r"(?:https?://)?(?:www\.)?github\.com/([^/\s?]+)"),
    ("tiktok", r"(?:https?://)?(?:www\.)?tiktok\.com/@?([^/\s?]+)"),
    ("crunchbase", r"(?:https?://)?(?:www\.)?crunchbase\.com/organization/([^/\s?]+)")]


def all_matches(text: Column, pattern: str, group: int = 0, flags: str = "(?i)") -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(flags + pattern), F.lit(group)), F.array().cast("array<string>"))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with a costly value evaluated once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def first_item(items: Column) -> Column:
    return F.try_element_at(items, F.lit(1))


def title_name(title: Column) -> Column:
    """Company name at the start of a page title."""
    usable = lambda n: F.when((F.length(n) > 2) & ~F.lower(n).contains("home"), n)
    piped = F.trim(F.regexp_extract(title, r"^([^|]+)\|", 1))
    dashed = F.trim(F.regexp_extract(title, r"^([^-]+)-", 1))
    return F.coalesce(usable(piped), usable(dashed), usable(F.trim(F.regexp_extract(title, r"^(.+?)(?:\s*-\s*.+)?$", 1))))


def company_name(known: Column, title: Column, h1s: Column, og_title: Column) -> Column:
    heading = first_item(F.filter(F.slice(F.coalesce(h1s, F.array().cast("array<string>")), 1, 3), lambda h: (F.length(h) > 2) & (F.length(h) < 100)))
    return F.coalesce(F.nullif(known, F.lit("")), title_name(title), heading, og_title, F.lit("Unknown Company"))


def description(meta: Column, og: Column, about: Column) -> Column:
    long = lambda d: F.when(F.length(F.trim(d)) > 20, F.trim(d))
    part = first_item(F.filter(about, lambda t: (F.length(t) > 50) & (F.length(t) < 500)))
    return F.coalesce(long(meta), long(og), F.regexp_replace(part, r"(?U)\s+", " "))


def with_sector(df: DataFrame, text: str, keywords: str | None = None) -> DataFrame:
    """Sector with most keyword hits (substring counts) and the first of its keywords that occurs."""
    low = F.lower(F.col(text)) if keywords is None else F.concat(F.coalesce(F.concat(F.lower(F.col(keywords)), F.lit(" ")), F.lit("")), F.lower(F.col(text)))
    hits = lambda words: " + ".join(f"int((length(__low) - length(replace(__low, '{w}', ''))) / {len(w)})" for w in words)
    scores = ", ".join(f"struct({hits(words)} AS score, {-i} AS precedence, '{s}' AS sector)" for i, (s, words) in enumerate(SECTOR_WORDS.items()))
    first = " ".join(f"WHEN '{s}' THEN CASE " + " ".join(f"WHEN contains(__low, '{w}') THEN '{w}'" for w in words) + " END" for s, words in SECTOR_WORDS.items())
    return (df.withColumn("__low", low).withColumn("__best", F.expr(f"array_max(array({scores}))"))
            .withColumn("sector", F.when(F.col("__best.score") > 0, F.col("__best.sector")))
            .withColumn("industry", F.initcap(F.expr(f"CASE sector {first} END"))).drop("__low", "__best"))


def people_counts(text: Column) -> tuple[Column, Column]:
    """Head count and range; a later phrasing overrides an earlier one."""
    low = F.lower(text)
    ranged = lambda m: m.rlike("[-–]")

    def sizes(found: Column) -> Column:
        plain = first_item(F.filter(found, lambda m: ~ranged(m)))
        stop = F.array_position(F.transform(found, ranged), F.lit(False)).cast("int")
        before = F.when(stop > 0, F.slice(found, F.lit(1), F.greatest(stop - 1, F.lit(0)))).otherwise(found)
        return F.struct(plain.alias("plain"), F.try_element_at(F.filter(before, ranged), F.lit(-1)).alias("range"))
    both = once(all_matches(low, PEOPLE_COUNTS[0], 1, ""), sizes)
    last_range = both["range"]
    first = once(both, lambda s: F.coalesce(s["plain"].try_cast("long"), F.regexp_extract(s["range"], r"^(\d+)", 1).try_cast("long")))
    later = [first_item(all_matches(low, p, 1, "")).try_cast("long") for p in PEOPLE_COUNTS[1:]]
    return F.coalesce(*reversed(later), first), last_range


def founded_year(text: Column) -> Column:
    years = [first_item(F.filter(F.transform(all_matches(text, p, 1), lambda y: y.try_cast("int")), lambda y: y.between(1800, 2030))) for p in YEARS]
    return F.coalesce(*years)


def stock(text: Column) -> tuple[Column, Column]:
    symbol = F.coalesce(*[first_item(F.filter(all_matches(text, p, 1), lambda s: (F.length(s) <= 5) & (s == F.upper(s)))) for p in SYMBOLS])
    public = (F.when(symbol.isNotNull(), True).when(text.rlike(r"(?i)\b(?:private|privately held)\b"), False)
              .when(text.rlike(r"(?i)\b(?:public|publicly traded|listed)\b"), True))
    return symbol, public


def emails(text: Column, keep_role_mailboxes: bool = False) -> Column:
    """Distinct business mail addresses in order of appearance."""
    drop = "(?i)" + "|".join(PRIVATE_MAIL + ([] if keep_role_mailboxes else [ROLE_MAIL]))
    found = F.when(F.contains(text, F.lit("@")), all_matches(text, EMAIL, 0, "")).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.transform(found, lambda e: F.lower(e)), lambda e: ~e.rlike(drop)))


def phones(text: Column) -> Column:
    """Distinct phone numbers with at least seven digits."""
    found = F.concat(*[all_matches(text, p, 0, "") for p in PHONES])
    return F.array_distinct(F.filter(F.transform(found, lambda p: F.trim(p)), lambda p: F.length(F.regexp_replace(p, r"[^\d+]", "")) >= 7))


def stripped(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def address_parts(text: Column) -> dict[str, Column]:
    """Postal address and its parts; later patterns overwrite what earlier ones found."""
    picks = [first_item(F.filter(F.transform(all_matches(text, p), stripped), lambda m: (F.length(m) > 10) & ~m.rlike(r"^\+?[\d\s\-\(\)\.]+$"))) for p in ADDRESSES]
    latest = list(reversed(picks))
    some = lambda m, p, g: F.nullif(F.regexp_extract(m, p, g), F.lit(""))
    return {"address": F.coalesce(*latest), "postal_code": F.coalesce(*[some(m, r"\b\d{5}(?:-\d{4})?\b", 0) for m in latest]),
            "state": F.coalesce(*[some(m, r"\b([A-Z]{2})\s*\d{5}", 1) for m in latest]),
            "city": F.coalesce(*[F.trim(some(m, r",\s*([^,]+),\s*[A-Z]{2}\s*\d{5}", 1)) for m in latest])}


def places(sections: Column, text: Column) -> tuple[Column, Column]:
    """Headquarters and other locations: addresses in contact and frame sections, else a place named in the text."""
    # the selectors of a page often pick the same section: each text is searched once
    searched = F.transform(F.array_distinct(sections), lambda s: F.struct(s.alias("text"), F.concat(*[all_matches(s, p) for p in ADDRESSES]).alias("found")))
    each = once(searched, lambda d: F.flatten(F.transform(sections, lambda s: F.element_at(F.filter(d, lambda x: x["text"].eqNullSafe(s)), 1)["found"])))
    found = F.filter(F.transform(each, stripped), lambda a: F.length(a) > 10)
    named = F.coalesce(*[first_item(F.filter(F.transform(all_matches(text, p, 1), stripped), lambda a: (F.length(a) > 5) & (F.length(a) < 100))) for p in PLACES])
    both = once(found, lambda f: F.struct(first_item(f).alias("first"), F.array_distinct(F.slice(f, F.lit(2), F.greatest(F.size(f) - 1, F.lit(0)))).alias("rest")))
    return F.coalesce(both["first"], named), both["rest"]


def contact(df: DataFrame, text: str) -> DataFrame:
    """Primary and further mail addresses and phones, and the postal address."""
    mails, numbers_ = emails(F.col(text)), phones(F.col(text))
    rest = lambda c: F.slice(F.col(c), F.lit(2), F.greatest(F.size(c) - 1, F.lit(0)))
    return computed_once(df, emails=mails, phones=numbers_, **address_parts(F.col(text))).withColumns({
        "email": first_item(F.col("emails")), "phone": first_item(F.col("phones")), "more_emails": rest("emails"), "more_phones": rest("phones")}).withColumn(
        "has_contact", F.col("email").isNotNull() | F.col("phone").isNotNull() | F.col("address").isNotNull())


def profile_list(links: Column) -> Column:
    """Social profiles among a page's links: distinct addresses, each with the first platform that fits."""
    fits = lambda u: F.coalesce(*[F.when(u.rlike("(?i)" + p), F.lit(n)) for n, p in PROFILES])
    account = lambda u: F.coalesce(*[F.nullif(F.regexp_extract(u, "(?i)" + p, 1), F.lit("")) for _, p in PROFILES])
    named = F.filter(F.array_distinct(links), lambda u: (u != "") & ~u.startswith("#") & fits(u).isNotNull())
    return F.transform(named, lambda u: F.struct(fits(u).alias("platform"), u.alias("href"), account(u).alias("username")))


def profiles(pages: DataFrame, keys: list[str]) -> DataFrame:
    """One row per social profile a page links to."""
    return pages.select(*keys, F.explode(profile_list(F.col("links"))).alias("p")).select(*keys, "p.*")


def financial_mentions(text: Column) -> tuple[Column, Column]:
    raised, funding, value = [F.nullif(F.regexp_extract(text, "(?i)" + p, 1), F.lit("")) for p in MONEY]
    return F.coalesce(funding, raised), value


def executives(text: Column, most: int = 5) -> Column:
    """Names with their titles among the first ``most`` mentions."""
    found = F.when(text.rlike("(?iU)" + LEADERS[LEADERS.rindex("("):]), F.slice(all_matches(text, LEADERS, 0, "(?iU)"), 1, most)).otherwise(F.array().cast("array<string>"))
    pairs = F.transform(found, lambda m: F.struct(stripped(F.regexp_extract(m, "(?iU)" + LEADERS, 1)).alias("name"), F.upper(F.regexp_extract(m, "(?iU)" + LEADERS, 2)).alias("title")))
    return F.filter(pairs, lambda p: (F.length(p["name"]) > 2) & (F.length(p["name"]) < 50))


LD_SCHEMA = ("array<struct<`@type`:string,name:string,description:string,url:string,foundingDate:string,email:string,telephone:string,"
             "address:struct<streetAddress:string,addressLocality:string,addressRegion:string,postalCode:string,addressCountry:string>>>")


def with_structured_data(df: DataFrame, scripts: str) -> DataFrame:
    """Organisation facts from embedded JSON-LD; the last item with facts of a kind wins."""
    items = F.filter(F.flatten(F.transform(scripts, lambda s: F.coalesce(F.from_json(s, LD_SCHEMA), F.from_json(F.lit("[]"), LD_SCHEMA)))),
                     lambda i: F.lower(i["@type"]).isin("organization", "localbusiness", "corporation"))
    basic = lambda i: F.coalesce(i["name"], i["description"], i["url"], i["foundingDate"]).isNotNull()
    reach = lambda i: F.coalesce(i["email"], i["telephone"], i["address"]["streetAddress"], i["address"]["addressLocality"],
                                 i["address"]["addressRegion"], i["address"]["postalCode"], i["address"]["addressCountry"]).isNotNull()
    last = lambda f: F.try_element_at(F.filter("__ld", f), F.lit(-1))
    b, r = F.col("__b"), F.col("__r")
    a = r["address"]
    return (df.withColumn("__ld", items).withColumns({"__b": last(basic), "__r": last(reach)}).withColumns({
        "ld_name": b["name"], "ld_description": b["description"], "ld_website": b["url"], "ld_founded_year": F.substring(b["foundingDate"], 1, 4).try_cast("int"),
        "ld_email": r["email"], "ld_phone": r["telephone"], "ld_city": a["addressLocality"], "ld_state": a["addressRegion"], "ld_postal_code": a["postalCode"],
        "ld_country": a["addressCountry"], "ld_address": F.nullif(F.concat_ws(", ", a["streetAddress"], a["addressLocality"], a["addressRegion"], a["postalCode"]), F.lit(""))})
        .drop("__ld", "__b", "__r"))


MERGED = ["name", "description", "website", "founded_year", "email", "phone", "address", "city", "state", "country", "postal_code"]


def with_gaps_filled(df: DataFrame) -> DataFrame:
    """Page values first, structured data where the page gave none; a default name counts as none."""
    own = lambda c: F.nullif(F.col(c), F.lit("Unknown Company")) if c == "name" else F.col(c)
    filled = {c: F.coalesce(own(c), F.col(f"ld_{c}")) for c in MERGED}
    filled["name"] = F.coalesce(filled["name"], F.lit("Unknown Company"))
    return df.withColumns(filled).drop(*[f"ld_{c}" for c in MERGED])


def company_facts(parts: DataFrame, url: str = "url", known: str = "known_name") -> DataFrame:
    """All facts of a page from its table of parts, before scoring."""
    size, size_range = people_counts(F.col("text"))
    symbol, public = stock(F.col("text"))
    hq, others = places(F.col("sections"), F.col("text"))
    money, value = financial_mentions(F.col("text"))
    empty = F.coalesce(F.length(F.trim("html_text")) == 0, F.lit(True)) if "html_text" in parts.columns else F.lit(False)
    facts = computed_once(with_sector(parts, "text", "meta_keywords"), **{
        "sector": F.col("sector"), "industry": F.col("industry"), "name": F.when(empty, F.coalesce(F.nullif(F.col(known), F.lit("")), F.lit("Unknown"))).otherwise(
            company_name(F.col(known), F.col("title"), F.col("h1s"), F.col("og_title"))),
        "description": description(F.col("meta_description"), F.col("og_description"), F.col("about")),
        "website": F.when(F.length(url) > 0, urls.site(F.col(url))), "domain": urls.host(F.col(url)), "employee_count": size, "employee_range": size_range,
        "headquarters": hq, "locations": others, "founded_year": founded_year(F.col("text")), "stock_symbol": symbol, "is_public": public,
        "funding_total": money, "valuation": value, "people": executives(F.col("text"))})
    facts = contact(facts, "contact_text").withColumn("country", F.lit(None).cast("string"))
    return with_gaps_filled(with_structured_data(facts, "jsonld"))


def organic_results(boxes: DataFrame, keys: list[str], wanted: str) -> DataFrame:
    """Boxes with their outcome and, for accepted ones, a gapless rank; ``wanted`` results are kept.

    A captured page holds a few hundred boxes at most, so the window per page is small.
    """
    outcome = (F.when(F.col("is_ad"), "non_organic").when(F.col("title").isNull() | F.col("url").isNull(), "missing_data")
               .when(~urls.is_result_address(F.col("url")), "invalid_url").otherwise("success"))
    text = F.trim(F.regexp_replace(F.regexp_replace("raw_description", r"(?U)\s+", " "), r"(?U)^[•·\-\s]+", ""))
    upto = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ranked = boxes.withColumn("outcome", outcome).withColumn("rank", F.count_if(F.col("outcome") == "success").over(upto).cast("int"))
    limit = F.col(wanted)
    seen = (F.col("rank") < limit) | ((F.col("rank") == limit) & (F.col("outcome") == "success"))
    return ranked.filter(seen).withColumn("description", text)


def parse_statistics(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    n = F.count(F.lit(1))
    count = lambda o: F.count_if(F.col("outcome") == o)
    return outcomes.groupBy(*keys).agg(
        n.alias("processed"), *[count(o).alias(o) for o in ("non_organic", "missing_data", "invalid_url", "success")],
        (count("success") / n * 100).alias("success_pct"), F.countDistinct(F.when(F.col("outcome") == "success", urls.authority(F.col("url")))).alias("domains"))


def with_result_total(stats: DataFrame) -> DataFrame:
    """First number of the statistics line."""
    return stats.withColumn("total_results", F.replace(F.regexp_extract("stats_text", r"([\d,]+)", 1), F.lit(","), F.lit("")).try_cast("long"))
