"""Field extraction on fixture texts."""
import pytest
from pyspark.sql import functions as F

from firmlens.functions import numbers, text, urls
from firmlens.operators import extraction, insight, validation
from firmlens.sources import html_tables


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).collect()[0]["x"]


def test_pagination_tables(spark):
    starts = [(1, 10, 0), (1, 100, 0), (2, 10, 10), (2, 100, 100), (3, 10, 20), (3, 100, 200), (5, 50, 200), (10, 100, 900)]
    pages = [(100, 10, 10), (100, 100, 1), (150, 100, 2), (999, 100, 10), (1000, 100, 10), (1001, 100, 11), (50, 10, 5), (55, 10, 6), (0, 10, 0), (None, 10, None), (95, 10, 10)]
    ranges = [(1, 10, 10, 1, 10), (1, 100, 85, 1, 85), (2, 10, 10, 11, 20), (2, 100, 75, 101, 175), (3, 50, 50, 101, 150), (5, 20, 20, 81, 100), (1, 10, 0, 0, 0)]
    a = spark.createDataFrame(starts, "p int, n int, want int").filter(numbers.start_index(F.col("p"), F.col("n")) != F.col("want"))
    b = spark.createDataFrame(pages, "t int, n int, want int").filter(~numbers.total_pages(F.col("t"), F.col("n")).eqNullSafe(F.col("want")))
    lo, hi = numbers.page_range(F.col("p"), F.col("n"), F.col("k"))
    c = spark.createDataFrame(ranges, "p int, n int, k int, lo int, hi int").filter((lo != F.col("lo")) | (hi != F.col("hi")))
    assert (a.count(), b.count(), c.count()) == (0, 0, 0)


@pytest.mark.parametrize("value,year", [("Founded in 2010", 2010), ("Established 2015", 2015), ("Since 2008", 2008), ("Est. 2020", 2020), ("Founded 1500", None)])
def test_founded_year(spark, value, year):
    assert one(spark, value, extraction.founded_year) == year


@pytest.mark.parametrize("value,count,ranged", [("We employ 50-100 people", 100, None), ("300 employees", 300, None), ("250-500 employees", 250, "250-500"), ("team of 12", 12, None), ("none", None, None)])
def test_people_counts(spark, value, count, ranged):
    df = spark.createDataFrame([(value,)], "t string")
    c, r = extraction.people_counts(F.col("t"))
    row = df.select(c.alias("c"), r.alias("r")).collect()[0]
    assert (row["c"], row["r"]) == (count, ranged)


def test_emails_and_phones(spark):
    mail = "john.doe@firm.io sales@firm.io info@firm.io help@firm.io a@gmail.com b@example.com noreply@firm.io"
    assert one(spark, mail, extraction.emails) == ["john.doe@firm.io", "sales@firm.io"]
    assert one(spark, mail, lambda c: extraction.emails(c, True)) == ["john.doe@firm.io", "sales@firm.io", "info@firm.io", "help@firm.io"]
    found = one(spark, "+1-555-123-4567, (555) 987-6543, +44 20 1234 5678, 555.123.4567", extraction.phones)
    assert len(found) >= 3 and "(555) 987-6543" in found


def test_address_stock_money_people(spark):
    df = spark.createDataFrame([("Visit 123 Main Street, San Francisco, CA 94105 today",)], "t string")
    row = df.select(*[c.alias(n) for n, c in extraction.address_parts(F.col("t")).items()]).collect()[0]
    assert (row["city"], row["state"], row["postal_code"]) == ("San Francisco", "CA", "94105")
    symbol, public = extraction.stock(F.col("t"))
    got = spark.createDataFrame([("NASDAQ: ABC",), ("privately held",), ("publicly traded",), ("x",)], "t string").select(symbol.alias("s"), public.alias("p")).collect()
    assert [(r["s"], r["p"]) for r in got] == [("ABC", True), (None, False), (None, True), (None, None)]
    assert [tuple(p) for p in one(spark, "Ann Lee, CEO; Bo Kim, founder", extraction.executives)] == [("Ann Lee", "CEO"), ("Bo Kim", "FOUNDER")]


def test_urls_and_text(spark):
    assert one(spark, "https://www.a.com:8080/x?y", urls.host) == "a.com:8080"
    assert one(spark, "a b/ü", urls.quoted) == "a%20b/%C3%BC"
    assert [one(spark, d, urls.is_domain) for d in ("not..valid", "a-b.co", "HTTPS://www.x.org/")] == [False, True, True]
    assert one(spark, " a\n <b>bold</b>  text ", text.sanitized) == "a bold text"
    assert one(spark, "one two three", lambda c: text.cut_at_word(c, 9)) == "one two..."
    assert one(spark, "100% sure+%2e%2e%2f", validation.percent_decoded) == "100% sure+../"


def test_amounts(spark):
    assert [one(spark, v, numbers.money_worded) for v in ("$1.5 billion", "3B", "20 million", "x")] == [1.5e9, 3e9, 2e7, None]
    assert [one(spark, v, numbers.money_suffixed) for v in ("$1.2B", "500M", "10K", "7", "1 million")] == [1.2e9, 5e8, 1e4, 7.0, None]
    assert [one(spark, v, numbers.people_count) for v in ("1,000+", "100-500", "42", "many")] == [1000, 100, 42, None]
    assert [one(spark, v, lambda c: numbers.people_count(c, True)) for v in ("501-1000", "500+", "42")] == [1000, None, 42]
    assert [one(spark, v, insight.market_cap) for v in ("$250 billion", "$12.5 billion", "$3 billion", "5 million", "2 trillion", "")] == [
        "Large Cap ($200B+)", "Mid Cap ($10B-$200B)", "Small Cap ($2B-$10B)", "Micro Cap (<$2B)", "Mega Cap (>$1T)", "Unknown"]


SERP = ("<html><body><div id='result-stats'>About 1,250 results</div>" + "".join(
    f"<div class='g'><a href='https://site{i}.com/p'><h3 class='LC20lb'>Title {i}</h3></a><div class='VwiC3b'>• A snippet   number {i}</div></div>" for i in (1, 2, 3)) + "</body></html>")


@pytest.mark.parametrize("html,n", [(SERP, 3), ("", 0), ("<html><body>No results</body></html>", 0), ("<div><p>unclosed", 0), ("<div class='g'><div id='tads'>x</div><a href='http://a.com/long'><h3>An ad</h3></a></div>", 0)])
def test_search_page(spark, html, n):
    df = spark.createDataFrame([("s", 10, html)], "id string, per int, html string")
    rows = extraction.organic_results(html_tables.result_table(df, ["id", "per"]), ["id"], "per").filter("outcome = 'success'").orderBy("rank").collect()
    assert len(rows) == n
    if n:
        assert [(r["rank"], r["title"], r["url"], r["description"]) for r in rows] == [
            (i, f"Title {i}", f"https://site{i}.com/p", f"A snippet number {i}") for i in (1, 2, 3)]
        total = extraction.with_result_total(html_tables.statistics_table(df, ["id"])).collect()[0]
        assert total["total_results"] == 1250


def test_company_page(spark):
    html = """<html><head><title>Acme Robotics | Home</title><meta name="description" content="Acme builds software robots for factories">
      <script type="application/ld+json">{"@type": "Organization", "name": "Acme LD", "telephone": "+1 555 000 1111"}</script></head><body>
      <p>Founded in 2015. We have 300 employees. Ann Lee, CEO</p><a href="https://linkedin.com/company/acme">l</a><a href="https://twitter.com/acme">t</a>
      <a href="https://github.com/acme">g</a><p>unclosed <b>tags
      <footer>Mail hello@acme.io or call (555) 123-4567. 12 Long Street, Boston, MA 02110</footer></body></html>"""
    df = spark.createDataFrame([(1, "https://www.acme.io/about", None, html), (2, "", "Known", "")], "id int, url string, known_name string, html string")
    parts = html_tables.page_table(df, ["id", "url", "known_name"]).withColumn("html_text", F.col("text"))
    r = {x["id"]: x for x in extraction.company_facts(parts).collect()}
    a = r[1]
    assert (a["name"], a["founded_year"], a["employee_count"], a["email"], a["state"], a["postal_code"]) == ("Acme Robotics", 2015, 300, "hello@acme.io", "MA", "02110")
    assert a["sector"] == "technology" and a["phone"] == "(555) 123-4567" and a["website"] == "https://www.acme.io"
    assert r[2]["name"] == "Known" and r[2]["email"] is None
    assert {p["platform"] for p in extraction.profiles(parts, ["id"]).collect()} == {"linkedin", "twitter", "github"}


def test_request_rules(spark):
    rows = [("ok", "Acme", "acme.com", "US", "en", 5, 30), ("name", "", None, "US", "en", 5, 30), ("country", "Acme", None, "usa", "en", 5, 30), ("language", "Acme", None, "US", "EN", 5, 30),
            ("pages", "Acme", None, "US", "en", 25, 30), ("domain", "Acme", "not..valid", "US", "en", 5, 30)]
    df = spark.createDataFrame(rows, "id string, company_name string, domain string, country string, language string, max_pages_to_crawl int, timeout_seconds int")
    got = {r["id"]: r["is_valid"] for r in validation.check_company_requests_strictly(df).collect()}
    assert got == {"ok": True, "name": False, "country": False, "language": False, "pages": False, "domain": False}


def test_a_section_picked_by_many_selectors_is_read_once(monkeypatch):
    """Selectors only look at tags that can match, and the text of a tag is put together once; what they find is the same."""
    html = ('<body><div class="company-info x" id="about">A <b>b</b></div><main><p id="x">m</p></main><header class="header">h</header><p class="contact-us">c</p>'
            '<footer class="contact" id="footer"><p>mail</p></footer><section><i data-k="v">d</i><i data-k="">e</i></section></body>')
    extra = ['[data-k="v"]', "[data-k]", "section i", '[data-k=""]', "main .x", "main #x"]
    tags, calls = html_tables.read_html(html).tags(), []
    text = html_tables.Tag.text
    monkeypatch.setattr(html_tables.Tag, "text", lambda t: (calls.append(t.name), text(t))[1])
    got = dict(zip(html_tables.PARTS, html_tables.page_parts(html, [*html_tables.ABOUT, *extra], html_tables.CONTACT)))
    assert calls.count("footer") == 1 and calls.count("header") == 1
    find = lambda selectors: [t for s in selectors for t in html_tables.selected(tags, s)]
    assert got["about"] == [t.tight_text() for t in find([*html_tables.ABOUT, *extra])] and "d" in got["about"] and "m" in got["about"]
    assert got["sections"] == [text(t) for t in find([*html_tables.CONTACT, *html_tables.FRAME])]
