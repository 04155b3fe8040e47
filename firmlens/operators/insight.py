"""Scores, categories and industry reports over company records."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmlens.functions import numbers
from firmlens.operators import ordered


def size_class(n: Column) -> Column:
    return (F.when((n.isNull()) | (n == 0), None).when(n <= 10, "startup").when(n <= 50, "small").when(n <= 250, "medium")
            .when(n <= 1000, "large").otherwise("enterprise"))


def size_category(n: Column) -> Column:
    return (F.when(n.isNull(), "Unknown").when(n < 50, "Startup").when(n < 200, "Small").when(n < 1000, "Medium")
            .when(n < 5000, "Large").otherwise("Enterprise"))


def funding_stage(valuation: Column) -> Column:
    return (F.when(valuation.isNull() | (valuation == 0), "Unknown").when(valuation < 1e7, "Early Stage")
            .when(valuation < 1e8, "Growth Stage").when(valuation < 1e9, "Late Stage").otherwise("Unicorn"))


def ratio(a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), a / b)


def market_cap(text: Column) -> Column:
    """Category named by a valuation text; digits before "billion" are read as one number."""
    t = F.lower(text)
    num = F.regexp_replace(F.split(t, "billion")[0], "[^0-9]", "").try_cast("double")
    return (F.when(text.isNull() | (text == ""), "Unknown")
            .when(t.contains("trillion") | t.contains("1000"), "Mega Cap (>$1T)")
            .when(t.contains("billion"), F.when(num >= 200, "Large Cap ($200B+)").when(num >= 10, "Mid Cap ($10B-$200B)")
                  .when(num.isNotNull(), "Small Cap ($2B-$10B)").otherwise("Unknown"))
            .when(t.contains("million"), "Micro Cap (<$2B)").otherwise("Unknown"))


# Names of well-known leaders and groups of industries.
LEADERS = ["microsoft", "apple", "google", "amazon", "meta", "tesla", "nvidia", "jpmorgan", "goldman sachs", "morgan stanley", "blackrock"]
LOW_RISK = ["healthcare", "utilities", "consumer staples"]
HIGH_RISK = ["cryptocurrency", "biotech", "energy"]
VALUED = ["technology", "software", "fintech", "healthcare"]
TARGETED = ["Technology", "Software", "SaaS", "E-commerce", "FinTech"]


def any_of(value: Column, words: list[str]) -> Column:
    return F.coalesce(value.rlike("|".join(words)), F.lit(False))


def leadership(name: Column, industry: Column) -> Column:
    i = F.lower(industry)
    return (F.when(any_of(F.lower(name), LEADERS), "Market Leader").when(i.contains("technology") | i.contains("software"), "Technology Player")
            .otherwise("Industry Participant"))


def within(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def plus(test: Column, points: float) -> Column:
    return F.when(test, points).otherwise(0.0)


def confidence_level(score: Column) -> Column:
    return (F.when(score >= 0.9, "Very High").when(score >= 0.8, "High").when(score >= 0.6, "Medium").when(score >= 0.4, "Low")
            .otherwise("Very Low"))


def intelligence(df: DataFrame, as_of_year: int) -> DataFrame:
    """Market position, risks, opportunity and confidence level of each company.

    Reads name, industry, revenue_text, valuation_text, profitability, growth, employee_text,
    founded_year and confidence.
    """
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    rev, val, profit, growth, industry = low("revenue_text"), low("valuation_text"), low("profitability"), low("growth"), low("industry")
    money = (F.lit(0.5) + F.when(rev.contains("billion"), -0.2).when((rev == "") | rev.contains("unknown"), 0.2).otherwise(0.0)
             + F.when(profit.contains("unprofitable"), 0.1).when(profit.contains("profitable"), -0.1).otherwise(0.0)
             + F.when(growth.contains("high") | growth.contains("rapid"), -0.1)
             .when(growth.contains("declining") | growth.contains("negative"), 0.2).otherwise(0.0))
    market = F.lit(0.5) + F.when(any_of(industry, LOW_RISK), -0.2).when(any_of(industry, HIGH_RISK), 0.2).otherwise(0.0)
    staff = F.regexp_replace("employee_text", "[,+]", "").try_cast("long")
    age = F.lit(as_of_year) - F.col("founded_year")
    running = (F.lit(0.5) + F.when(staff > 10000, -0.1).when(staff < 100, 0.1).otherwise(0.0)
               + F.when(age > 20, -0.1).when(age < 5, 0.1).otherwise(0.0))
    staged = df.withColumns({
        "market_cap": market_cap(F.col("valuation_text")), "position": leadership(F.col("name"), F.col("industry")),
        "financial_risk": within(money, 0.0, 1.0), "market_risk": within(market, 0.0, 1.0), "operational_risk": within(running, 0.0, 1.0)})
    staged = staged.withColumn("overall_risk", (F.col("financial_risk") + F.col("market_risk") + F.col("operational_risk")) / 3)
    score = (F.lit(50.0) + F.when(rev.contains("billion"), 15).when(rev.contains("million"), 10).otherwise(0)
             + F.when(val.contains("billion"), 15).when(val.contains("million"), 8).otherwise(0)
             + F.when(F.col("market_cap").startswith("Large Cap"), 20).when(F.col("market_cap").startswith("Mid Cap"), 15).otherwise(0)
             + plus(F.col("position") == "Market Leader", 10.0) + (F.lit(0.5) - F.col("overall_risk")) * 40)
    return staged.withColumns({"opportunity": within(score, 0.0, 100.0), "confidence_level": confidence_level(F.col("confidence"))})


def executive_summary(reports: DataFrame) -> DataFrame:
    return reports.agg(F.count(F.lit(1)).alias("companies"), F.avg("opportunity").alias("avg_opportunity"),
                       F.count_if(F.col("opportunity") >= 70).alias("high_opportunity"),
                       F.count_if(F.col("confidence_level").isin("High", "Very High")).alias("high_confidence"))


def sure(reports: DataFrame) -> DataFrame:
    return reports.filter(F.col("confidence_level").isin("High", "Very High"))


def qualified_leads(reports: DataFrame, least: float = 60) -> DataFrame:
    return sure(reports).filter(F.col("opportunity") >= least)


def lead_score(df: DataFrame) -> Column:
    """Lead value 0..100 from revenue text, head count, industry and confidence."""
    rev = F.lower("revenue_text")
    n = numbers.people_count(F.col("employee_text"))
    money = F.when(rev.isNull() | (rev == ""), 0).when(rev.contains("billion"), 40).when(rev.contains("million"), 25).otherwise(10)
    staff = F.when(n.isNull(), 0).when(n >= 10000, 30).when(n >= 1000, 20).when(n >= 100, 15).otherwise(10)
    sureness = F.when(F.col("confidence") > 0.8, 15).when(F.col("confidence") > 0.6, 10).otherwise(0)
    return F.least(money + staff + F.when(any_of(F.lower("industry"), VALUED), 15).otherwise(0) + sureness, F.lit(100))


def sales_priority() -> Column:
    t, n = F.col("employee_text"), F.col("employees")
    size = (F.when(F.contains(t, F.lit("1000+")) | (n > 1000), 30).when(F.contains(t, F.lit("500-1000")) | (n > 500), 20)
            .when(F.contains(t, F.lit("200-500")) | (n > 200), 10).otherwise(0))
    some = lambda c: F.coalesce(F.length(F.col(c)) > 0, F.lit(False))
    return F.least(size + F.when(F.col("industry").isin(*TARGETED), 20).otherwise(0) + F.when(some("revenue_text"), 15).otherwise(0)
                   + F.when(some("funding_text"), 10).otherwise(0) + F.when(some("email"), 10).otherwise(0) + F.col("n_people") * 2, F.lit(100))


def analysis_rows(df: DataFrame, as_of_year: int) -> DataFrame:
    """Numeric twins, categories, ratios and flags used by the reports."""
    c = F.col
    has = lambda p: F.coalesce(F.array_contains("platforms", p), F.lit(False))
    work = df.withColumns({
        "employee_count_numeric": numbers.people_count(c("employee_text"), upper=True),
        "revenue_numeric": numbers.money_suffixed(c("revenue_text")), "valuation_numeric": numbers.money_suffixed(c("valuation_text")),
        "company_age": F.lit(as_of_year) - c("founded_year"), "has_twitter": has("twitter"), "has_linkedin": has("linkedin"), "has_github": has("github"),
        "social_media_presence": F.size(F.array_intersect("platforms", F.array(*[F.lit(p) for p in (
            "twitter", "linkedin", "github", "youtube", "facebook", "instagram")])))})
    return work.withColumns({
        "company_size_category": size_category(c("employee_count_numeric")), "funding_stage": funding_stage(c("valuation_numeric")),
        "revenue_per_employee": ratio(c("revenue_numeric"), c("employee_count_numeric")),
        "valuation_to_revenue": ratio(c("valuation_numeric"), c("revenue_numeric"))})


def industry_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("companies"), F.countDistinct("industry").alias("industries"), F.countDistinct("country").alias("countries"),
                    F.avg("company_age").alias("avg_age"), F.sum("employees").alias("employees"), F.sum("valuation").alias("valuation"))


def medians(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Exact medians of several columns in one pass over (column, value) pairs."""
    n = F.col("n")
    pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("measure"), F.col(v).cast("double").alias("x")) for v in values]))
    long = rows.select(*keys, pairs.alias("p")).select(*keys, "p.*")
    m = ordered.order_statistics(long, keys + ["measure"], "x", {"a": F.floor((n + 1) / 2), "b": F.floor(n / 2) + 1})
    mid = (F.col("a") + F.col("b")) / 2
    return m.groupBy(*keys).agg(*[F.max(F.when(F.col("measure") == v, mid)).alias(f"{v}_median") for v in values])


def industry_breakdown(rows: DataFrame) -> DataFrame:
    agg = rows.groupBy("industry").agg(
        F.count(F.lit(1)).alias("companies"), F.avg("employees").alias("employees_mean"), F.sum("employees").alias("employees_sum"),
        F.avg("valuation").alias("valuation_mean"), F.sum("valuation").alias("valuation_sum"), F.avg("revenue").alias("revenue_mean"),
        F.avg("company_age").alias("age_mean"))
    return ordered.join_null_safe(agg, medians(rows, ["industry"], ["employees", "valuation", "revenue"]), ["industry"])


def industry_rollup(rows: DataFrame) -> DataFrame:
    """Companies and valuation per industry and country, with subtotals."""
    return rows.rollup("industry", "country").agg(F.count(F.lit(1)).alias("companies"), F.avg("company_age").alias("avg_age"))


def value_counts(rows: DataFrame, field: str, k: int | None = None) -> DataFrame:
    out = rows.filter(F.col(field).isNotNull()).groupBy(F.col(field).alias("value")).agg(F.count(F.lit(1)).alias("companies"))
    return out if k is None else out.orderBy(F.desc("companies"), "value").limit(k)


def top_performers(rows: DataFrame, measures: list[str], key: str, k: int = 5) -> DataFrame:
    """The k highest companies for each measure; ranks are limited before the shuffle, so few rows of a measure meet."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures]))
    long = rows.select(key, "name", "industry", pairs.alias("m")).select("m.measure", key, "name", "industry", "m.value").filter("value is not null")
    best = Window.partitionBy("measure").orderBy(F.desc("value"), key)
    return long.withColumn("__rank", F.row_number().over(best)).filter(F.col("__rank") <= k).drop("__rank")


def best_industries(rows: DataFrame, value: str, k: int = 10) -> DataFrame:
    return (rows.filter(F.col(value).isNotNull()).groupBy("industry").agg(F.avg(value).alias("mean_value"))
            .orderBy(F.desc("mean_value"), "industry").limit(k))


def size_value_trend(rows: DataFrame) -> DataFrame:
    """Line through log valuation against log head count."""
    x, y = F.ln("employees"), F.ln("valuation")
    return rows.filter((F.col("employees") > 0) & (F.col("valuation") > 0)).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))
