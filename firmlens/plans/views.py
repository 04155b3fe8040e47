"""Domain tables derived from the given star-schema, event and page tables."""
from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlens.functions import urls
from firmlens.operators import ordered
from firmlens.operators.sizes import spread

AS_OF = "2024-01-31 00:00:00"
AS_OF_US = 1706659200000000
MINUTE_US = 60_000_000
HOUR_US = 3_600_000_000
DAY_US = 86_400_000_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text"))


def epoch_us(col: str) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {col})")


def logged(spark, sf, after: int | None = None, until: int | None = None) -> DataFrame:
    """The event log, or what of it lies in (after, until], in microseconds; the range reaches the scan as time stamps."""
    log = table(spark, sf, "events")
    for us, sign in ((after, ">"), (until, "<=")):
        if us is not None:
            log = log.filter(f"ts {sign} timestamp_ntz'{datetime(1970, 1, 1) + timedelta(microseconds=us)}'")
    return log


def events(spark, sf, after: int | None = None, until: int | None = None) -> DataFrame:
    """Service request log: who called what, when, how long, with which agent."""
    return logged(spark, sf, after, until).select(
        "event_id", epoch_us("ts").alias("us"), F.col("user_id").alias("client"),
        F.col("event_type").alias("endpoint"), F.col("value").alias("ms"),
        (F.col("event_type") == "error").alias("is_error"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("agent"))


def metrics(spark, sf, after: int | None = None, until: int | None = None) -> DataFrame:
    """Metric samples: one named series per event type."""
    return logged(spark, sf, after, until).select(
        "event_id", F.col("event_type").alias("name"), "value", epoch_us("ts").alias("us"))


def pages(spark, sf) -> DataFrame:
    """Captured pages with address parts, title, heading and visible text."""
    html = F.col("html")
    bare = F.regexp_replace(html, r"(?s)<script[^>]*>.*?</script>", " ")
    bare = F.regexp_replace(bare, r"(?s)<style[^>]*>.*?</style>", " ")
    bare = F.regexp_replace(bare, r"(?s)<!--.*?-->", " ")
    text = F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]+>", " "), r"[ \t\r\n\f]+", " "))
    return spread(table(spark, sf, "pages")).select(
        "page_id", "url", "html", urls.scheme(F.col("url")).alias("scheme"),
        urls.host(F.col("url")).alias("host"), urls.path(F.col("url")).alias("path"),
        F.regexp_extract("url", r"^[a-z]+://[^/]+/([a-z]{2})/", 1).alias("lang"),
        F.regexp_extract(html, r"<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_extract(html, r"<h1>([^<]*)</h1>", 1).alias("h1"), text.alias("text"))


def companies(spark, sf) -> DataFrame:
    """Extracted company records; optional fields are missing on key patterns."""
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("spent"))
    c = (table(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
         .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
         .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")))
    k = F.col("c_custkey")
    ks = k.cast("string")
    n = F.coalesce("n_orders", F.lit(0))
    employees = (n * (k % 40 + 1) * 7).cast("long")
    es = employees.cast("string")

    def some(div: int, value: Column) -> Column:
        return F.when(k % div != 0, value)

    return c.select(
        k.alias("company_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("industry"),
        F.col("n_name").alias("country"), F.col("r_name").alias("region"),
        F.round(F.abs("c_acctbal") * 100000, 2).alias("valuation"),
        F.round(F.coalesce("spent", F.lit(0.0)), 2).alias("revenue"), employees.alias("employees"),
        (1990 + k % 34).cast("int").alias("founded_year"),
        some(3, F.concat(F.lit("https://www.customer"), ks, F.lit(".com"))).alias("website"),
        some(4, F.concat(F.lit("sales"), ks, F.lit("@customer"), ks, F.lit(".com"))).alias("email"),
        some(5, F.concat(F.lit("+1-555-"), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit("-"),
                         F.lpad((k * 7 % 10000).cast("string"), 4, "0"))).alias("phone"),
        some(6, F.concat((k % 900 + 10).cast("string"), F.lit(" Main Street"))).alias("address"),
        some(8, F.concat(F.lit("City"), (k % 50).cast("string"))).alias("city"),
        some(9, F.concat(F.lit("S"), F.expr("chr(65 + int(c_custkey % 26))"))).alias("state"),
        some(7, F.concat(F.col("c_name"), F.lit(" provides "), F.lower("c_mktsegment"),
                         F.expr("repeat(' goods and services', int(c_custkey % 12))"))).alias("description"),
        F.when(k % 4 == 0, es).when(k % 4 == 1, F.concat(es, F.lit("-"), (employees * 2).cast("string")))
         .when(k % 4 == 2, F.concat(es, F.lit("+"))).alias("employee_text"),
        F.when(k % 5 == 0, F.concat(F.lit("$"), (k % 90 + 1).cast("string"), F.lit(".5 billion")))
         .when(k % 5 == 1, F.concat(F.lit("$"), (k % 900 + 1).cast("string"), F.lit("M")))
         .when(k % 5 == 2, F.concat((k % 700 + 1).cast("string"), F.lit(",500K")))
         .when(k % 5 == 3, F.concat((k % 50 + 1).cast("string"), F.lit(".25B"))).alias("money_text"),
        F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("is_public"),
        (k % 4).cast("int").alias("n_social"), (k % 3).cast("int").alias("n_people"),
        F.when(k % 3 == 1, F.concat(F.lit("Ann Lee "), ks)).alias("ceo_name"),
        F.when(k % 3 == 0, None).when(k % 6 == 1, "Chief Executive Officer, CEO")
         .when(k % 6 == 2, "Founder").when(k % 6 == 4, "CEO").otherwise("Head of Sales").alias("lead_title"),
        ((k % 11) / 10.0).alias("confidence"), ((k % 7) / 6.0).alias("quality"),
        ((k % 13) / 12.0).alias("completeness"))


def batch_items(spark, sf) -> DataFrame:
    """One extraction inside a submitted batch."""
    k, o = F.col("o_custkey"), F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        (k % 50).alias("batch_id"), o.alias("pos"),
        F.concat(F.when(o % 3 == 0, F.lit("CUSTOMER ")).otherwise(F.lit(" Customer ")), k.cast("string"),
                 F.when(o % 4 == 0, F.lit(" ")).otherwise(F.lit(""))).alias("company"),
        k.alias("company_id"), F.col("o_orderstatus").alias("status_code"),
        (F.col("o_orderstatus") == "F").alias("success"),
        F.when(F.col("o_orderpriority").startswith("1"), "urgent").when(
            F.col("o_orderpriority").startswith("2"), "high").when(
            F.col("o_orderpriority").startswith("5"), "low").otherwise("normal").alias("priority"),
        (F.col("o_totalprice") / 1000).alias("seconds"), epoch_us("o_orderdate").alias("created_us"),
        ((o % 90 + 10) / 100.0).alias("confidence"),
        F.when(o % 6 != 0, F.concat(F.lit("industry"), (k % 5).cast("string"))).alias("industry"),
        F.element_at(F.array(*[F.lit(s) for s in ("startup", "small", "medium", "large", "enterprise")]),
                     (k % 5 + 1).cast("int")).alias("company_size"),
        (o % 3 != 0).alias("has_contact"), (o % 4).cast("int").alias("n_social"),
        (o % 5).cast("int").alias("n_people"))


def serp_results(spark, sf) -> DataFrame:
    """Result pages of ten per query; the query is the page's language."""
    p = pages(spark, sf).select("page_id", "url", "host", "title", F.col("lang").alias("query"),
                                F.floor(F.col("page_id") / 4096).alias("block"))
    r = ordered.row_numbers(p, ["query"], [["block"]], ["page_id"], "rank_all")
    return r.select("query", F.expr("int((rank_all - 1) div 10) + 1").alias("page"),
                    F.expr("int((rank_all - 1) % 10) + 1").alias("rank"),
                    "page_id", "url", "host", "title")


def source_records(spark, sf) -> DataFrame:
    """Per-source facts about a company (a part); one row per source."""
    def some(div: int, base: str, value: Column) -> Column:
        return F.when(F.col(base) % div != 0, value)
    s = lambda c: F.col(c).cast("string")
    order, supp, line = "l_orderkey", "l_suppkey", "l_linenumber"
    return table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("company"),
        F.concat_ws("/", F.lpad(s(order), 12, "0"), s(line), F.lpad(s(supp), 8, "0"),
                    F.lpad(F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"), 12, "0"),
                    F.lpad(F.col("l_quantity").cast("long").cast("string"), 3, "0"),
                    epoch_us("l_shipdate").cast("string")).alias("source"),
        F.round(F.col("l_discount") * 8 + 0.1, 2).alias("confidence"),
        F.round(F.col("l_tax") * 10, 2).alias("quality"),
        F.round(F.col("l_quantity") / 50, 2).alias("completeness"),
        some(3, order, F.concat(F.lit("about "), s(order))).alias("description"),
        some(4, order, F.when(F.col(supp) % 6 == 0, "").otherwise(F.concat(F.lit("industry"), (F.col(supp) % 7).cast("string")))).alias("industry"),
        some(5, order, F.concat(F.lit("sector"), (F.col(supp) % 5).cast("string"))).alias("sector"),
        some(3, supp, (1900 + F.col(order) % 120).cast("int")).alias("founded_year"),
        some(4, supp, (F.col("l_quantity") * 10).cast("int")).alias("employee_count"),
        some(2, supp, F.concat(F.lit("HQ "), (F.col(supp) % 20).cast("string"))).alias("headquarters"),
        F.concat(F.lit("Office "), (F.col(order) % 15).cast("string")).alias("location"),
        some(2, order, F.concat(F.lit("mail"), s(order), F.lit("@x.com"))).alias("email"),
        some(5, supp, F.concat(F.lit("555-"), s(order))).alias("phone"),
        some(3, line, F.concat(s(supp), F.lit(" Oak Road"))).alias("address"),
        some(3, line, F.concat(F.lit("City"), (F.col(supp) % 30).cast("string"))).alias("city"),
        F.concat(F.lit("State"), (F.col(supp) % 9).cast("string")).alias("state"), some(2, line, F.concat(F.lit("Country"), (F.col(supp) % 4).cast("string"))).alias("country"),
        some(2, supp, F.lpad((F.col(order) % 100000).cast("string"), 5, "0")).alias("postal_code"), some(2, line, F.concat(F.lit("https://c"), s("l_partkey"), F.lit(".com"))).alias("website"),
        some(3, supp, F.concat(F.lit("S"), (F.col(supp) % 50).cast("string"))).alias("stock_symbol"),
        some(4, order, F.concat(F.col("l_quantity").cast("long").cast("string"), F.lit(" million"))).alias("funding"),
        some(5, order, F.when(F.col(line) % 2 == 0, "").otherwise(F.concat(F.col("l_quantity").cast("long").cast("string"), F.lit(" billion")))).alias("valuation"),
        F.element_at(F.array(*[F.lit(x) for x in (
            "linkedin", "twitter", "facebook", "instagram", "youtube", "github", "tiktok")]),
            F.col(line)).alias("platform"),
        F.concat(F.lit("https://social/"), s(order)).alias("profile_url"),
        (F.col("l_returnflag") == "R").alias("verified"),
        F.concat(F.when(F.col(order) % 2 == 0, F.lit(" Person ")).otherwise(F.lit("PERSON ")),
                 (F.col(supp) % 40).cast("string")).alias("person"),
        F.when(F.col(line) % 2 == 0, "CEO").otherwise("CTO").alias("person_title"))


def data_records(spark, sf, orders: DataFrame | None = None) -> DataFrame:
    """Personal-data records kept about a subject; ``orders`` may be a stream."""
    pr, st = F.col("o_orderpriority"), F.col("o_orderstatus")
    category = (F.when(pr.startswith("1"), "personal_identifiable").when(pr.startswith("2"), "business_data")
                .when(pr.startswith("3"), "technical_logs").when(pr.startswith("5"), "analytics_data")
                .otherwise("security_logs"))
    return (table(spark, sf, "orders") if orders is None else orders).select(
        F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("subject_id"),
        category.alias("category"),
        F.when(st == "F", "consent").when(st == "O", "legitimate_interests").otherwise("legal_obligation")
         .alias("basis"),
        F.when(F.col("o_orderkey") % 6 == 0, "security_logging").otherwise("service").alias("purpose"),
        epoch_us("o_orderdate").alias("created_us"), (F.col("o_orderkey") % 4 == 0).alias("is_sensitive"))


def subjects(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("subject_id"), (F.col("c_acctbal") > 0).alias("consent_given"),
        (F.col("c_custkey") % 7 == 0).alias("consent_withdrawn"),
        F.concat(F.lit("10.0."), (F.col("c_custkey") % 250).cast("string"), F.lit("."),
                 (F.col("c_custkey") % 200).cast("string")).alias("ip"),
        F.concat(F.lit("agent/"), (F.col("c_custkey") % 9).cast("string")).alias("user_agent"))


def accesses(spark, sf) -> DataFrame:
    """Access log over data records."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("record_id"), F.col("l_linenumber").alias("line"),
        F.col("l_suppkey").alias("operator"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("salt"),
        F.when(F.col("l_returnflag") == "R", "read").when(F.col("l_returnflag") == "A", "update")
         .otherwise("delete").alias("action"), epoch_us("l_shipdate").alias("at_us"))


def company_requests(spark, sf) -> DataFrame:
    """Requests to look a company up, some of them malformed."""
    o, k = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf, "orders").select(
        o.alias("request_id"),
        F.when(o % 31 == 0, F.lit("")).when(o % 37 == 0, F.lit("X")).when(
            o % 41 == 0, F.concat(F.lit("Bad<Name>"), k.cast("string")))
         .otherwise(F.concat(F.lit("Customer "), k.cast("string"),
                             F.when(o % 5 == 0, F.lit(" Inc")).when(o % 5 == 1, F.lit(" LLC"))
                              .when(o % 5 == 2, F.lit(" Company")).otherwise(F.lit("")))).alias("company_name"),
        F.when(o % 4 == 0, None).when(o % 29 == 0, "not..valid")
         .otherwise(F.concat(F.lit("customer"), k.cast("string"), F.lit(".com"))).alias("domain"),
        F.element_at(F.array(*[F.lit(m) for m in (
            "basic", "standard", "comprehensive", "contact_focused", "financial_focused")]),
            (o % 5 + 1).cast("int")).alias("extraction_mode"),
        F.when(o % 23 == 0, "usa").otherwise("US").alias("country"),
        F.when(o % 19 == 0, "EN").otherwise("en").alias("language"),
        (o % 2 == 0).alias("include_social_media"), (o % 3 == 0).alias("include_financial_data"),
        (o % 7 == 0).alias("include_contact_info"), (o % 11 == 0).alias("include_key_personnel"),
        (o % 27).cast("int").alias("max_pages_to_crawl"), (o % 140 + 1).cast("int").alias("timeout_seconds"))


def search_requests(spark, sf) -> DataFrame:
    """Web search requests, some of them malformed."""
    o = F.col("o_orderkey")
    pick = lambda names, e: F.element_at(F.array(*[F.lit(x) for x in names]), (e + 1).cast("int"))
    return table(spark, sf, "orders").select(
        o.alias("request_id"),
        F.when(o % 43 == 0, F.lit("")).otherwise(F.concat(F.lit("café & "), F.col("o_orderpriority"), F.lit("/"),
                                                 F.col("o_custkey").cast("string"))).alias("query"),
        F.when(o % 23 == 0, "usa").when(o % 17 == 0, "id").otherwise("ID").alias("country"),
        F.when(o % 19 == 0, "EN").otherwise("en").alias("language"),
        (o % 103).cast("int").alias("page"), (o % 104).cast("int").alias("results_per_page"),
        F.when(o % 3 != 0, (o % 12).cast("int")).alias("max_pages"),
        F.when(o % 5 == 0, (o % 9).cast("int")).alias("start_page"),
        pick(("none", "instagram", "linkedin"), F.expr("o_orderkey div 7") % 3).alias("social_platform"),
        pick(("all", "reels", "posts", "accounts", "tv", "locations"), F.expr("o_orderkey div 5") % 6)
        .alias("instagram_content_type"),
        pick(("all", "profiles", "companies", "posts", "jobs", "articles"), F.expr("o_orderkey div 3") % 6)
        .alias("linkedin_content_type"))


def firm_texts(spark, sf) -> DataFrame:
    """Prose about each company in the phrasings an extractor meets."""
    k = F.col("c_custkey")
    s = lambda e: e.cast("string")
    j = F.expr("c_custkey div 6")
    size = (F.when(k % 6 == 0, F.concat(F.lit("We have "), s(j % 400 + 5), F.lit("-"), s(j % 400 + 90), F.lit(" employees")))
            .when(k % 6 == 1, F.concat(F.lit("A team of "), s(j % 70 + 3)))
            .when(k % 6 == 2, F.concat(F.lit("Our staff of "), s(j % 2000 + 1)))
            .when(k % 6 == 3, F.concat(F.lit("We employ 50-"), s(j % 90 + 60), F.lit(" people")))
            .when(k % 6 == 4, F.concat(s(j % 900), F.lit(" employees and "), s(j % 30 + 1), F.lit("+ people")))
            .otherwise(F.lit("A growing group")))
    year = (F.when(k % 5 == 0, F.concat(F.lit("Founded in "), s(k % 60 + 1960)))
            .when(k % 5 == 1, F.concat(F.lit("Established "), s(k % 900 + 1500)))
            .when(k % 5 == 2, F.concat(F.lit("Est. "), s(k % 60 + 1950)))
            .when(k % 5 == 3, F.concat(s(k % 60 + 1970), F.lit(" - present")))
            .otherwise(F.lit("Founded long ago")))
    stock = (F.when(k % 7 == 0, F.concat(F.lit("NASDAQ: C"), F.expr("chr(65 + int(c_custkey % 26))"), F.lit("X")))
             .when(k % 7 == 1, F.lit("ticker: lower"))
             .when(k % 7 == 2, F.concat(F.lit("Listed firm ("), F.expr("chr(65 + int(c_custkey % 26))"), F.lit("Q)")))
             .when(k % 7 == 3, F.lit("We are privately held")).when(k % 7 == 4, F.lit("A publicly traded group"))
             .otherwise(F.lit("No market data")))
    money = (F.when(k % 4 == 0, F.concat(F.lit("We raised $"), s(k % 90 + 1), F.lit(".5M million last year")))
             .when(k % 4 == 1, F.concat(F.lit("Funding: $"), s(k % 70 + 1), F.lit("K. Raised 3M before")))
             .when(k % 4 == 2, F.concat(F.lit("Valuation: $"), s(k % 9 + 1), F.lit("B")))
             .otherwise(F.lit("No figures")))
    people = (F.when(k % 3 == 0, F.concat(F.lit("Ann Lee"), F.lit(", CEO")))
              .when(k % 3 == 1, F.lit("Bob Ray, founder; Cy Moe, CTO")).otherwise(F.lit("The board")))
    addr = (F.when(k % 4 == 0, F.concat(s(k % 900 + 1), F.lit(" Main Street, Springfield, CA "), s(k % 80000 + 10000)))
            .when(k % 4 == 1, F.concat(F.lit("P.O. Box "), s(k + 10000)))
            .when(k % 4 == 2, F.concat(s(k % 900 + 1), F.lit(" Oak Avenue")))
            .otherwise(F.lit("Headquarters in Geneva")))
    mail = (F.when(k % 3 == 0, F.concat(F.lit("sales@customer"), s(k), F.lit(".com, info@customer.com, SALES@customer"),
                                        s(k), F.lit(".com")))
            .when(k % 3 == 1, F.concat(F.lit("x"), s(k), F.lit("@gmail.com no-reply@customer.com j.doe@firm"),
                                       s(k % 40), F.lit(".co.uk")))
            .otherwise(F.lit("no mail")))
    phone = (F.when(k % 4 == 0, F.concat(F.lit("+1-555-123-"), F.lpad(s(k % 10000), 4, "0")))
             .when(k % 4 == 1, F.concat(F.lit("(555) 987-"), F.lpad(s(k % 10000), 4, "0")))
             .when(k % 4 == 2, F.lit("+44 20 1234 5678")).otherwise(F.lit("call us")))
    total = (F.when(k % 4 == 0, F.concat(F.lit("About "), F.format_number(k * 1234, 0), F.lit(" results")))
             .when(k % 4 == 1, F.concat(F.lit("Showing 1-10 of "), s(k * 17)))
             .when(k % 4 == 2, F.concat(F.lit("Page 2 of about "), s(k))).otherwise(F.lit("none")))
    parts = [size, year, stock, money, people, addr, mail, phone]
    return spread(table(spark, sf, "customer")).select(
        k.alias("firm_id"), F.col("c_name").alias("known_name"), size.alias("size_text"), year.alias("year_text"),
        stock.alias("stock_text"), money.alias("money_text"), people.alias("people_text"),
        addr.alias("address_text"), mail.alias("mail_text"), phone.alias("phone_text"),
        total.alias("total_text"), F.concat_ws(".\n", *parts).alias("text"))
