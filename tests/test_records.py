"""Fusion, exports, privacy and search scoring invariants."""
import random

import pytest
from pyspark.sql import functions as F

from firmlens.operators import crawl, crm, fusion, privacy, search
from firmlens.plans import views
from firmlens.sources import sinks

SF = "/root/testdata/sf0.001"
DDL = ("company string, source string, confidence double, quality double, completeness double, description string, industry string, sector string, founded_year int, "
       "employee_count int, company_size string, headquarters string, location string, email string, phone string, address string, city string")
ROWS = [("A", "s1", 0.8, 0.5, 0.4, "first", None, None, None, None, "small", None, "Rome", None, None, None, None),
        ("A", "s2", 0.7, 0.9, 0.2, "second", "ai", None, 1999, 40, "small", "Paris", "Oslo", "a@b.c", None, None, None),
        ("A", "s3", 0.6, 0.1, 0.6, None, "web", "tech", 2001, 900, "large", None, "Rome", "x@y.z", "5", "1 Road", "Bonn"),
        ("A", "s4", 0.1, 1.0, 1.0, "never", None, None, None, None, None, None, "Cairo", None, None, None, None)]


def test_fusion_fixture(spark):
    r = fusion.fuse(spark.createDataFrame(ROWS, DDL), "company").collect()[0]
    assert r["confidence"] == pytest.approx(0.9) and r["sources"] == 3 and r["base_source"] == "s1"
    assert (r["description"], r["industry"], r["email"], r["phone"], r["city"]) == ("first", "ai", "a@b.c", "5", "Bonn")
    assert (r["employee_count"], r["company_size"], r["headquarters"], r["quality"]) == (40, "small", None, 0.9)
    assert fusion.fuse(spark.createDataFrame(ROWS, DDL), "company", fill_headquarters=True).collect()[0]["headquarters"] == "Paris"
    places = {x["location"] for x in fusion.fused_locations(spark.createDataFrame(ROWS, DDL), "company").collect()}
    assert places == {"Rome", "Oslo", "Paris"}


def test_fusion_ignores_row_order(spark):
    base = fusion.fuse(spark.createDataFrame(ROWS, DDL), "company").collect()
    for seed in range(3):
        rows = ROWS[:]
        random.Random(seed).shuffle(rows)
        assert fusion.fuse(spark.createDataFrame(rows, DDL).repartition(seed + 1), "company").collect() == base


def test_erasure_splits_input(spark):
    records, subjects = views.data_records(spark, SF), views.subjects(spark, SF)
    asked = subjects.filter("subject_id % 2 = 0").select("subject_id", F.lit("erasure").alias("request_type"))
    kept, erased = privacy.after_erasure(records, asked)
    assert kept.count() + erased.count() == records.count()
    assert kept.join(erased, "record_id").count() == 0


def test_address_priorities(spark):
    rows = [("own", "https://www.acme.com/about", "Acme about", "Acme is a company"), ("products", "https://www.acme.com/shop", "Shop", "things"),
            ("review", "https://reviews.net/acme", "Acme review", "text"), ("linkedin", "https://linkedin.com/company/acme", "Acme", ""), ("facebook", "https://facebook.com/acme", "Acme", "")]
    df = spark.createDataFrame(rows, "id string, url string, title string, description string")
    s = {r["id"]: r["s"] for r in df.select("id", search.address_priority(F.col("url"), F.col("title"), F.col("description"), F.lit("Acme"), F.lit("acme.com"), F.lit("basic")).alias("s")).collect()}
    assert s["own"] > 0.5 > s["review"] and s["own"] > s["products"] and s["linkedin"] > 0.2 and s["own"] > s["facebook"]


def test_robots(spark):
    f = spark.createDataFrame([("https://a.com", "User-agent: *\nAllow: /public/\nDisallow: /private/\nDisallow: /admin/\nCrawl-delay: 2\nSitemap: https://a.com/s.xml")], "domain string, content string")
    pages = spark.createDataFrame([(u,) for u in ("https://a.com/public/x", "https://a.com/private/x", "https://a.com/", "https://b.org/admin/")], "url string")
    got = {r["url"]: r["can_fetch"] for r in crawl.robots_verdicts(pages, crawl.robots_rules(f), "bot").collect()}
    assert got == {"https://a.com/public/x": True, "https://a.com/private/x": False, "https://a.com/": True, "https://b.org/admin/": True}
    assert crawl.robots_settings(f).collect()[0]["crawl_delay"] == 2.0


def test_sheets_and_routing(spark, tmp_path):
    sheet = views.companies(spark, SF).select("company_id", F.struct("name", F.struct("city").alias("hq")).alias("info"))
    flat = crm.flattened(sheet)
    assert flat.columns == ["company_id", "info.name", "info.hq.city"]
    sinks.write_sheet(flat, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == flat.count()
    for fmt in ("json", "parquet", "orc"):
        sinks.write_sheet(views.companies(spark, SF), str(tmp_path / fmt), fmt)
        assert spark.read.format(fmt).load(str(tmp_path / fmt)).count() == flat.count()
    e = views.table(spark, SF, "events")
    for _ in range(2):  # a re-run replaces
        sinks.route_events(e, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "kind=all")).count() == e.count()
    assert spark.read.parquet(str(tmp_path / "out" / "kind=errors")).count() == e.filter("event_type = 'error'").count()
    assert spark.read.parquet(str(tmp_path / "out" / "kind=business")).count() == e.filter("event_type in ('purchase', 'signup')").count()
