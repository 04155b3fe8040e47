"""Queries that merge, score, report and hand over company records."""
from __future__ import annotations

from pyspark.sql import functions as F

from firmlens.functions import numbers
from firmlens.operators import crm, fusion, insight
from firmlens.plans import views
from firmlens.plans.registry import query
from firmlens.plans.telemetry import rounded

_GOOD = "g AS (SELECT *, (-confidence, source) AS o FROM source_record WHERE confidence > 0.1)"


def _fused_sql():
    first = lambda c, test: f"arg_min_null({c}, o) FILTER ({test}) AS {c}"
    simple = ", ".join(first(c, f"{c} <> ''" if c in ("description", "industry", "sector") else f"{c} IS NOT NULL") for c in fusion.SIMPLE)
    place = ", ".join(f"CASE WHEN bool_or(address <> '') THEN arg_min_null({c}, o) FILTER (address <> '') ELSE arg_min_null({c}, o) FILTER (email <> '' OR phone <> '' OR address <> '') END AS {c}"
                      for c in fusion.PLACE)
    base = ", ".join(f"nullif(arg_min_null({c}, o), '') AS {c}" for c in fusion.BASE_ONLY)
    return f"""{_GOOD}, a AS (SELECT company, count(*) AS sources, arg_min(source, o) AS base_source, {simple}, {first("employee_count", "employee_count IS NOT NULL")}, arg_min_null(headquarters, o) AS headquarters,
    {first("email", "email <> ''")}, {first("phone", "phone <> ''")}, {place}, {base}, avg(confidence) AS m, max(quality) AS quality, max(completeness) AS completeness FROM g GROUP BY company)
    SELECT * EXCLUDE (m), round(least(m + least(0.1 * (sources - 1), 0.3), 1), 6) AS confidence FROM a"""


@query("fused_companies", "source_record", _fused_sql())
def fused_companies(spark, sf):
    return rounded(fusion.fuse(views.source_records(spark, sf), "company"), "confidence")


@query("fused_profiles", "source_record", """g AS (SELECT * FROM source_record WHERE confidence > 0.1)
    SELECT company, platform, coalesce(arg_max(profile_url, (source, profile_url)) FILTER (verified), arg_min(profile_url, (source, profile_url))) AS profile_url, bool_or(verified) AS verified
    FROM g WHERE platform IS NOT NULL GROUP BY ALL""")
def fused_profiles(spark, sf):
    return fusion.fused_profiles(views.source_records(spark, sf), "company")


_PEOPLE = """people AS (SELECT company, arg_min(person, (source, person, person_title)) AS person, arg_min(person_title, (source, person, person_title)) AS person_title, min(source) AS seen
    FROM source_record WHERE confidence > 0.1 GROUP BY company, lower(trim(person)))"""


@query("fused_people", "source_record", _PEOPLE + " SELECT company, person, person_title FROM people")
def fused_people(spark, sf):
    return fusion.fused_people(views.source_records(spark, sf), "company")


@query("fused_locations", "source_record", _GOOD + """, b AS (SELECT company, count(*) AS n, arg_min_null(headquarters, o) AS hq FROM g GROUP BY company),
    l AS (SELECT company, location, false AS is_hq FROM g UNION ALL SELECT company, headquarters, true FROM g WHERE headquarters IS NOT NULL),
    u AS (SELECT company, location, bool_and(is_hq) AS only_hq FROM l GROUP BY ALL)
    SELECT u.company, location FROM u JOIN b ON u.company = b.company WHERE CASE WHEN n = 1 THEN NOT only_hq ELSE location IS DISTINCT FROM hq END""")
def fused_locations(spark, sf):
    return fusion.fused_locations(views.source_records(spark, sf), "company")


@query("locations_without_headquarters", "source_record", """SELECT DISTINCT company, replace(location, 'Office', 'HQ') AS place FROM source_record
    EXCEPT SELECT company, headquarters FROM source_record WHERE headquarters IS NOT NULL""")
def locations_without_headquarters(spark, sf):
    s = views.source_records(spark, sf)
    return fusion.locations_without(s.select("company", F.replace("location", F.lit("Office"), F.lit("HQ")).alias("place")),
                                    s.filter("headquarters is not null").select("company", F.col("headquarters").alias("place")))


@query("source_counts", "source_record", """SELECT company, count(*) AS attempted, count(*) FILTER (confidence > 0.1) AS used, count(DISTINCT email) AS emails,
    count(*) FILTER (confidence > 0.8) AS confident FROM source_record GROUP BY company""")
def source_counts(spark, sf):
    return views.source_records(spark, sf).groupBy("company").agg(
        F.count(F.lit(1)).alias("attempted"), F.count_if(F.col("confidence") > 0.1).alias("used"), F.countDistinct("email").alias("emails"),
        F.count_if(F.col("confidence") > 0.8).alias("confident"))


@query("role_counts", "source_record", _PEOPLE + " SELECT person_title, count(*) AS people FROM people GROUP BY person_title")
def role_counts(spark, sf):
    return fusion.role_counts(fusion.fused_people(views.source_records(spark, sf), "company"), "person_title")


_INDUSTRY = "CASE industry WHEN 'HOUSEHOLD' THEN 'Healthcare' WHEN 'MACHINERY' THEN 'Energy' WHEN 'FURNITURE' THEN 'Technology' WHEN 'BUILDING' THEN 'Software' ELSE 'Automobile' END"
_REPORT_SQL = f"""base AS (SELECT * REPLACE ({_INDUSTRY} AS industry, CASE WHEN company_id % 13 = 0 THEN 'Apple ' || name ELSE name END AS name,
      CASE WHEN company_id % 4 = 1 THEN 5 ELSE founded_year END AS founded_year),
      money_text AS revenue_text, CASE company_id % 5 WHEN 0 THEN '$' || (company_id % 300) || ' billion' WHEN 1 THEN company_id || ' million' WHEN 2 THEN '1.2 trillion' WHEN 3 THEN 'n/a' END AS valuation_text,
      CASE company_id % 3 WHEN 0 THEN 'Profitable' WHEN 1 THEN 'unprofitable' END AS profitability, CASE company_id % 4 WHEN 0 THEN 'High growth' WHEN 1 THEN 'declining' END AS growth FROM company),
    r1 AS (SELECT *, lower(coalesce(revenue_text, '')) AS rev, lower(coalesce(valuation_text, '')) AS val, lower(coalesce(profitability, '')) AS pro, lower(coalesce(growth, '')) AS gro,
      lower(industry) AS ind, TRY_CAST(replace(replace(employee_text, ',', ''), '+', '') AS BIGINT) AS staff, 2024 - founded_year AS age,
      TRY_CAST(regexp_replace(split_part(lower(valuation_text), 'billion', 1), '[^0-9]', '', 'g') AS DOUBLE) AS num FROM base),
    r2 AS (SELECT *, CASE WHEN valuation_text IS NULL THEN 'Unknown' WHEN val LIKE '%trillion%' OR val LIKE '%1000%' THEN 'Mega Cap (>$1T)'
        WHEN val LIKE '%billion%' THEN CASE WHEN num >= 200 THEN 'Large Cap ($200B+)' WHEN num >= 10 THEN 'Mid Cap ($10B-$200B)' WHEN num IS NOT NULL THEN 'Small Cap ($2B-$10B)' ELSE 'Unknown' END
        WHEN val LIKE '%million%' THEN 'Micro Cap (<$2B)' ELSE 'Unknown' END AS market_cap,
      CASE WHEN lower(name) LIKE '%apple%' THEN 'Market Leader' WHEN ind LIKE '%technology%' OR ind LIKE '%software%' THEN 'Technology Player' ELSE 'Industry Participant' END AS position,
      greatest(0, least(1, 0.5::DOUBLE + CASE WHEN rev LIKE '%billion%' THEN -0.2 WHEN rev = '' THEN 0.2 ELSE 0 END
        + CASE WHEN pro LIKE '%unprofitable%' THEN 0.1 WHEN pro LIKE '%profitable%' THEN -0.1 ELSE 0 END + CASE WHEN gro LIKE '%high%' THEN -0.1 WHEN gro LIKE '%declining%' THEN 0.2 ELSE 0 END)) AS financial_risk,
      0.5::DOUBLE + CASE WHEN ind = 'healthcare' THEN -0.2 WHEN ind = 'energy' THEN 0.2 ELSE 0 END AS market_risk,
      0.5::DOUBLE + CASE WHEN staff > 10000 THEN -0.1 WHEN staff < 100 THEN 0.1 ELSE 0 END + CASE WHEN age > 20 THEN -0.1 WHEN age < 5 THEN 0.1 ELSE 0 END AS operational_risk FROM r1),
    r3 AS (SELECT *, (financial_risk + market_risk + operational_risk) / 3 AS overall_risk FROM r2),
    rep AS (SELECT *, greatest(0, least(100, 50 + CASE WHEN rev LIKE '%billion%' THEN 15 WHEN rev LIKE '%million%' THEN 10 ELSE 0 END
        + CASE WHEN val LIKE '%billion%' THEN 15 WHEN val LIKE '%million%' THEN 8 ELSE 0 END
        + CASE WHEN market_cap LIKE 'Large Cap%' THEN 20 WHEN market_cap LIKE 'Mid Cap%' THEN 15 ELSE 0 END + CASE WHEN position = 'Market Leader' THEN 10 ELSE 0 END
        + (0.5 - overall_risk) * 40)) AS opportunity, CASE WHEN confidence >= 0.9 THEN 'Very High' WHEN confidence >= 0.8 THEN 'High' WHEN confidence >= 0.6 THEN 'Medium' WHEN confidence >= 0.4 THEN 'Low'
        ELSE 'Very Low' END AS confidence_level FROM r3)"""


def base(spark, sf):
    k = F.col("company_id")
    ind = F.col("industry")
    return views.companies(spark, sf).withColumns({
        "industry": F.when(ind == "HOUSEHOLD", "Healthcare").when(ind == "MACHINERY", "Energy").when(ind == "FURNITURE", "Technology").when(ind == "BUILDING", "Software").otherwise("Automobile"),
        "name": F.when(k % 13 == 0, F.concat(F.lit("Apple "), "name")).otherwise(F.col("name")),
        "founded_year": F.when(k % 4 == 1, 5).otherwise(F.col("founded_year")), "revenue_text": F.col("money_text"),
        "valuation_text": F.when(k % 5 == 0, F.concat(F.lit("$"), (k % 300).cast("string"), F.lit(" billion"))).when(k % 5 == 1, F.concat(k.cast("string"), F.lit(" million")))
        .when(k % 5 == 2, "1.2 trillion").when(k % 5 == 3, "n/a"),
        "profitability": F.when(k % 3 == 0, "Profitable").when(k % 3 == 1, "unprofitable"), "growth": F.when(k % 4 == 0, "High growth").when(k % 4 == 1, "declining")})


def reports(spark, sf):
    return insight.intelligence(base(spark, sf), 2024)


@query("company_intelligence", "company", _REPORT_SQL + """ SELECT company_id, market_cap, position, round(financial_risk, 6) AS financial_risk, round(market_risk, 6) AS market_risk,
    round(operational_risk, 6) AS operational_risk, round(overall_risk, 6) AS overall_risk, round(opportunity, 6) AS opportunity, confidence_level FROM rep""")
def company_intelligence(spark, sf):
    r = reports(spark, sf).select("company_id", "market_cap", "position", "financial_risk", "market_risk", "operational_risk", "overall_risk", "opportunity", "confidence_level")
    return rounded(r, "financial_risk", "market_risk", "operational_risk", "overall_risk", "opportunity")


@query("executive_summary", "company", _REPORT_SQL + """ SELECT count(*) AS companies, round(avg(opportunity), 6) AS avg_opportunity, count(*) FILTER (opportunity >= 70) AS high_opportunity,
    count(*) FILTER (confidence_level IN ('High', 'Very High')) AS high_confidence FROM rep""")
def executive_summary(spark, sf):
    return rounded(insight.executive_summary(reports(spark, sf)), "avg_opportunity")


@query("qualified_leads", "company", _REPORT_SQL + " SELECT company_id, round(opportunity, 6) AS opportunity, confidence_level FROM rep WHERE opportunity >= 60 AND confidence_level IN ('High', 'Very High')")
def qualified_leads(spark, sf):
    return rounded(insight.qualified_leads(reports(spark, sf)).select("company_id", "opportunity", "confidence_level"), "opportunity")


@query("investment_targets", "company", _REPORT_SQL + " SELECT company_id, name, round(opportunity, 6) AS opportunity FROM rep WHERE confidence_level IN ('High', 'Very High') ORDER BY opportunity DESC")
def investment_targets(spark, sf):
    return rounded(insight.sure(reports(spark, sf)).select("company_id", "name", "opportunity"), "opportunity").orderBy(F.desc("opportunity"), "company_id")


@query("market_research", "company", _REPORT_SQL + " SELECT company_id, industry, round(opportunity, 6) AS opportunity FROM rep")
def market_research(spark, sf):
    return rounded(reports(spark, sf).select("company_id", "industry", "opportunity"), "opportunity")


_LEAD = _REPORT_SQL + """, lead AS (SELECT company_id, least(CASE WHEN rev = '' THEN 0 WHEN rev LIKE '%billion%' THEN 40 WHEN rev LIKE '%million%' THEN 25 ELSE 10 END
    + CASE WHEN n IS NULL THEN 0 WHEN n >= 10000 THEN 30 WHEN n >= 1000 THEN 20 WHEN n >= 100 THEN 15 ELSE 10 END
    + CASE WHEN ind IN ('technology', 'software', 'healthcare') THEN 15 ELSE 0 END + CASE WHEN confidence > 0.8 THEN 15 WHEN confidence > 0.6 THEN 10 ELSE 0 END, 100) AS lead_score
    FROM (SELECT *, TRY_CAST(split_part(replace(replace(employee_text, ',', ''), '+', ''), '-', 1) AS BIGINT) AS n FROM rep))"""


@query("lead_scores", "company", _LEAD + " SELECT company_id, lead_score FROM lead")
def lead_scores(spark, sf):
    b = base(spark, sf)
    return b.select("company_id", insight.lead_score(b).alias("lead_score"))


@query("high_priority_leads", "company", _LEAD + " SELECT company_id, lead_score FROM lead WHERE lead_score > 70 ORDER BY lead_score DESC")
def high_priority_leads(spark, sf):
    return lead_scores(spark, sf).filter("lead_score > 70").orderBy(F.desc("lead_score"), "company_id")


@query("sales_priorities", "company", _REPORT_SQL + """ SELECT company_id, CAST(least(CASE WHEN employee_text LIKE '%1000+%' OR employees > 1000 THEN 30 WHEN employees > 500 THEN 20 WHEN employees > 200 THEN 10 ELSE 0 END
    + CASE WHEN industry IN ('Technology', 'Software') THEN 20 ELSE 0 END + CASE WHEN revenue_text IS NOT NULL THEN 15 ELSE 0 END + CASE WHEN valuation_text IS NOT NULL THEN 10 ELSE 0 END
    + CASE WHEN email IS NOT NULL THEN 10 ELSE 0 END + n_people * 2, 100) AS INT) AS sales_priority FROM rep""")
def sales_priorities(spark, sf):
    return base(spark, sf).withColumn("funding_text", F.col("valuation_text")).select("company_id", insight.sales_priority().alias("sales_priority"))


_PLAIN = r"regexp_full_match(trim({0}), '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)')"
_SUFFIXED = ("CASE WHEN " + _PLAIN.format("regexp_replace({0}, '[KMB]$', '')") + " THEN CAST(regexp_replace({0}, '[KMB]$', '') AS DOUBLE) * "
             "CASE right({0}, 1) WHEN 'K' THEN 1e3 WHEN 'M' THEN 1e6 WHEN 'B' THEN 1e9 ELSE 1 END END")
_CLEAN = "upper(replace(replace({0}, '$', ''), ',', ''))"


@query("analysis_rows", "company", _REPORT_SQL + """, n AS (SELECT *, CASE WHEN contains(employee_text, '-') THEN TRY_CAST(split_part(replace(employee_text, ',', ''), '-', 2) AS BIGINT)
      ELSE TRY_CAST(replace(employee_text, ',', '') AS BIGINT) END AS emp, """ + _SUFFIXED.format(_CLEAN.format("revenue_text")) + """ AS revn, """ + _SUFFIXED.format(_CLEAN.format("money_text")) + """ AS valn FROM rep)
    SELECT company_id, emp AS employee_count_numeric, revn AS revenue_numeric, valn AS valuation_numeric, CAST(2024 - founded_year AS INT) AS company_age, n_social >= 1 AS has_twitter, n_social >= 2 AS has_linkedin,
    n_social >= 3 AS has_github, n_social AS social_media_presence, CASE WHEN emp IS NULL THEN 'Unknown' WHEN emp < 50 THEN 'Startup' WHEN emp < 200 THEN 'Small' WHEN emp < 1000 THEN 'Medium' WHEN emp < 5000 THEN 'Large'
      ELSE 'Enterprise' END AS company_size_category, CASE WHEN valn IS NULL OR valn = 0 THEN 'Unknown' WHEN valn < 1e7 THEN 'Early Stage' WHEN valn < 1e8 THEN 'Growth Stage' WHEN valn < 1e9 THEN 'Late Stage' ELSE 'Unicorn' END AS funding_stage,
    round(CASE WHEN revn > 0 AND emp > 0 THEN revn / emp END, 6) AS revenue_per_employee, round(CASE WHEN revn > 0 AND valn > 0 THEN valn / revn END, 6) AS valuation_to_revenue FROM n""")
def analysis_rows(spark, sf):
    b = base(spark, sf).withColumns({"valuation_text": F.col("money_text"), "platforms": F.slice(F.array(*[F.lit(p) for p in ("twitter", "linkedin", "github")]), F.lit(1), F.col("n_social"))})
    r = insight.analysis_rows(b, 2024).select("company_id", "employee_count_numeric", "revenue_numeric", "valuation_numeric", "company_age", "has_twitter", "has_linkedin", "has_github",
                                              "social_media_presence", "company_size_category", "funding_stage", "revenue_per_employee", "valuation_to_revenue")
    return rounded(r, "revenue_per_employee", "valuation_to_revenue")


@query("amount_parsing", "company", f"""t AS (SELECT company_id, lower(replace(replace(money_text, '$', ''), ',', '')) AS w, {_CLEAN.format('money_text')} AS u, employee_text AS e FROM company),
    s AS (SELECT *, trim(CASE WHEN contains(w, 'b') THEN replace(replace(w, 'billion', ''), 'b', '') WHEN contains(w, 'm') THEN replace(replace(w, 'million', ''), 'm', '') ELSE w END) AS d FROM t)
    SELECT company_id, CASE WHEN {_PLAIN.format('d')} THEN CAST(d AS DOUBLE) * CASE WHEN contains(w, 'b') THEN 1e9 WHEN contains(w, 'm') THEN 1e6 ELSE 1 END END AS worded,
    {_SUFFIXED.format('u')} AS suffixed, TRY_CAST(split_part(replace(replace(e, ',', ''), '+', ''), '-', 1) AS BIGINT) AS least_people,
    CASE WHEN contains(e, '-') THEN TRY_CAST(split_part(e, '-', 2) AS BIGINT) ELSE TRY_CAST(e AS BIGINT) END AS most_people FROM s""")
def amount_parsing(spark, sf):
    c = views.companies(spark, sf)
    return c.select("company_id", numbers.money_worded(F.col("money_text")).alias("worded"), numbers.money_suffixed(F.col("money_text")).alias("suffixed"),
                    numbers.people_count(F.col("employee_text")).alias("least_people"), numbers.people_count(F.col("employee_text"), upper=True).alias("most_people"))


def rows(spark, sf):
    return views.companies(spark, sf).withColumns({
        "company_age": F.lit(2024) - F.col("founded_year"), "size_category": insight.size_category(F.col("employees")), "size_class": insight.size_class(F.col("employees")),
        "funding_stage": insight.funding_stage(F.col("valuation")), "revenue_per_employee": insight.ratio(F.col("revenue"), F.col("employees"))})


_ROWS = """r AS (SELECT *, 2024 - founded_year AS company_age, CASE WHEN employees < 50 THEN 'Startup' WHEN employees < 200 THEN 'Small' WHEN employees < 1000 THEN 'Medium' WHEN employees < 5000 THEN 'Large' ELSE 'Enterprise' END AS size_category,
    CASE WHEN employees = 0 THEN NULL WHEN employees <= 10 THEN 'startup' WHEN employees <= 50 THEN 'small' WHEN employees <= 250 THEN 'medium' WHEN employees <= 1000 THEN 'large' ELSE 'enterprise' END AS size_class,
    CASE WHEN valuation = 0 THEN 'Unknown' WHEN valuation < 1e7 THEN 'Early Stage' WHEN valuation < 1e8 THEN 'Growth Stage' WHEN valuation < 1e9 THEN 'Late Stage' ELSE 'Unicorn' END AS funding_stage,
    CASE WHEN revenue > 0 AND employees > 0 THEN revenue / employees END AS revenue_per_employee FROM company)"""


@query("industry_totals", "company", _ROWS + """ SELECT count(*) AS companies, count(DISTINCT industry) AS industries, count(DISTINCT country) AS countries, round(avg(company_age), 6) AS avg_age,
    CAST(sum(employees) AS BIGINT) AS employees, round(sum(valuation), 2) AS valuation FROM r""")
def industry_totals(spark, sf):
    return rounded(rounded(insight.industry_totals(rows(spark, sf)), "avg_age"), "valuation", digits=2)


@query("industry_breakdown", "company", _ROWS + """ SELECT industry, count(*) AS companies, round(avg(employees), 4) AS employees_mean, CAST(sum(employees) AS BIGINT) AS employees_sum,
    round(avg(valuation), 2) AS valuation_mean, round(sum(valuation), 2) AS valuation_sum, round(avg(revenue), 3) AS revenue_mean, round(avg(company_age), 6) AS age_mean,
    round(median(employees), 2) AS employees_median, round(median(valuation), 3) AS valuation_median, round(median(revenue), 3) AS revenue_median FROM r GROUP BY industry""")
def industry_breakdown(spark, sf):
    b = rounded(insight.industry_breakdown(rows(spark, sf)), "valuation_mean", "valuation_sum", "employees_median", digits=2)
    b = rounded(rounded(b, "age_mean"), "employees_mean", digits=4)
    return rounded(b, "revenue_mean", "valuation_median", "revenue_median", digits=3)


@query("industry_rollup", "company", _ROWS + " SELECT industry, country, count(*) AS companies, round(avg(company_age), 6) AS avg_age FROM r GROUP BY ROLLUP (industry, country)")
def industry_rollup(spark, sf):
    return rounded(insight.industry_rollup(rows(spark, sf)), "avg_age")


@query("category_counts", "company", _ROWS + """ SELECT 'size' AS kind, size_category AS value, count(*) AS companies FROM r GROUP BY 2 UNION ALL SELECT 'stage', funding_stage, count(*) FROM r GROUP BY 2
    UNION ALL SELECT 'class', size_class, count(*) FROM r WHERE size_class IS NOT NULL GROUP BY 2""")
def category_counts(spark, sf):
    r = rows(spark, sf)
    kinds = {"size": "size_category", "stage": "funding_stage", "class": "size_class"}
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in kinds.items()]))
    return r.select(pairs.alias("p")).select("p.*").filter("value is not null").groupBy("kind", "value").agg(F.count(F.lit(1)).alias("companies"))


@query("top_countries", "company", "SELECT country AS value, count(*) AS companies FROM company GROUP BY 1 ORDER BY companies DESC, 1 LIMIT 10")
def top_countries(spark, sf):
    return insight.value_counts(rows(spark, sf), "country", 10)


@query("top_performers", "company", _ROWS + ", t AS (" + " UNION ALL ".join(
    f"(SELECT '{m}' AS measure, company_id, name, industry, CAST({m} AS DOUBLE) AS value FROM r WHERE {m} IS NOT NULL ORDER BY {m} DESC, company_id LIMIT 5)"
    for m in ("valuation", "revenue", "employees", "revenue_per_employee")) + ") SELECT measure, company_id, name, industry, round(value, 6) AS value FROM t")
def top_performers(spark, sf):
    return rounded(insight.top_performers(rows(spark, sf), ["valuation", "revenue", "employees", "revenue_per_employee"], "company_id"), "value")


@query("best_industries", "company", _ROWS + " SELECT industry, round(avg(revenue_per_employee), 6) AS mean_value FROM r WHERE revenue_per_employee IS NOT NULL GROUP BY industry ORDER BY 2 DESC LIMIT 10")
def best_industries(spark, sf):
    return rounded(insight.best_industries(rows(spark, sf), "revenue_per_employee"), "mean_value")


@query("size_value_trend", "company", """SELECT round(regr_slope(ln(valuation), ln(employees)), 6) AS slope, round(regr_intercept(ln(valuation), ln(employees)), 6) AS intercept,
    round(regr_r2(ln(valuation), ln(employees)), 6) AS r2 FROM company WHERE employees > 0 AND valuation > 0""")
def size_value_trend(spark, sf):
    return rounded(insight.size_value_trend(rows(spark, sf)), "slope", "intercept", "r2")


def with_people(c):
    person = lambda n, t: F.struct(F.lit(n).alias("name"), F.lit(t).alias("title"))
    lead = F.when(F.col("lead_title").isNotNull(), F.array(F.struct(F.coalesce("ceo_name", F.lit("Bo Kim")).alias("name"), F.col("lead_title").alias("title")))).otherwise(
        F.array().cast("array<struct<name:string,title:string>>"))
    return c.withColumn("people", F.concat(F.array(person("Cy Moe", "CTO")), lead, F.array(person("Dee Fox", "Vice CEO"))))


@query("crm_account_fields", "company", """f AS (SELECT company_id, unnest([{'field': 'Name', 'value': name}, {'field': 'Website', 'value': website}, {'field': 'Industry', 'value': industry},
      {'field': 'Description', 'value': substring(description, 1, 32000)}, {'field': 'Phone', 'value': phone}, {'field': 'BillingStreet', 'value': address}, {'field': 'BillingCity', 'value': city},
      {'field': 'BillingState', 'value': state}, {'field': 'BillingCountry', 'value': country},
      {'field': 'NumberOfEmployees', 'value': CAST(TRY_CAST(split_part(replace(employee_text, '+', ''), '-', 1) AS BIGINT) AS VARCHAR)},
      {'field': 'AnnualRevenue', 'value': CASE company_id % 5 WHEN 0 THEN (company_id % 90 + 1) || '500000000' WHEN 1 THEN (company_id % 900 + 1) || '000000' WHEN 3 THEN (company_id % 50 + 1) || '250000000' END},
      {'field': 'YearStarted', 'value': CAST(founded_year AS VARCHAR)}, {'field': 'Domain', 'value': replace(replace(website, 'https://', ''), 'www.', '')},
      {'field': 'CeoName', 'value': CASE WHEN lead_title LIKE '%CEO%' THEN coalesce(ceo_name, 'Bo Kim') ELSE 'Dee Fox' END}]) AS p FROM company)
    SELECT company_id, p.field AS field, p.value AS value FROM f WHERE p.value IS NOT NULL""")
def crm_account_fields(spark, sf):
    a = crm.account_rows(with_people(views.companies(spark, sf)))
    return a.select("company_id", F.explode("fields").alias("field", "value"))


@query("crm_names", "company", r"""SELECT company_id, coalesce(split_part(ceo_name, ' ', 1), '') AS first_name, coalesce(substring(ceo_name, length(split_part(ceo_name, ' ', 1)) + 2), '') AS last_name,
    replace(replace(website, 'https://', ''), 'www.', '') AS domain FROM company""")
def crm_names(spark, sf):
    return views.companies(spark, sf).select("company_id", crm.first_name(F.col("ceo_name")).alias("first_name"), crm.last_name(F.col("ceo_name")).alias("last_name"),
                                             crm.site_domain(F.col("website")).alias("domain"))


@query("crm_upserts", "company", """acc AS (SELECT s_suppkey AS account_id, 'Customer#' || lpad(CAST(s_suppkey * 7 AS VARCHAR), 9, '0') AS name, 'https://www.customer' || (s_suppkey * 4) || '.com' AS website FROM supplier),
    hit AS (SELECT company_id, account_id FROM company c JOIN acc a ON c.name = a.name UNION ALL SELECT company_id, account_id FROM company c JOIN acc a ON c.website = a.website),
    m AS (SELECT company_id, min(account_id) AS account_id FROM hit GROUP BY 1)
    SELECT c.company_id, account_id, CASE WHEN account_id IS NULL THEN 'insert' ELSE 'update' END AS action FROM company c LEFT JOIN m ON c.company_id = m.company_id""")
def crm_upserts(spark, sf):
    k = F.col("s_suppkey")
    acc = views.table(spark, sf, "supplier").select(
        k.alias("account_id"), F.concat(F.lit("Customer#"), F.lpad((k * 7).cast("string"), 9, "0")).alias("name"),
        F.concat(F.lit("https://www.customer"), (k * 4).cast("string"), F.lit(".com")).alias("website"))
    return crm.match_accounts(views.companies(spark, sf).select("company_id", "name", "website"), acc, "company_id").select("company_id", "account_id", "action")


@query("crm_new_contacts", "source_record", _PEOPLE + """, f AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY seen, person) AS k FROM people)
    SELECT company, person, person_title FROM f WHERE k <= 5 AND NOT EXISTS (SELECT 1 FROM source_record e WHERE e.company = f.company AND e.person = f.person AND e.verified)""")
def crm_new_contacts(spark, sf):
    s = views.source_records(spark, sf)
    order = F.struct("source", "person", "person_title")
    people = (fusion.trusted(s).groupBy("company", F.lower(F.trim("person")).alias("k"))
              .agg(F.min_by(F.struct("person", "person_title"), order).alias("p"), F.min("source").alias("seen")).select("company", "p.*", "seen"))
    return crm.new_contacts(people, s.filter("verified"), "company", 5).select("company", "person", "person_title")


@query("report_sheet", "company", f"""SELECT company_id, name, industry, substring(coalesce(description, ''), 1, 500) AS description, coalesce(CASE WHEN contains(employee_text, '-') THEN TRY_CAST(split_part(employee_text, '-', 2) AS BIGINT)
    ELSE TRY_CAST(employee_text AS BIGINT) END, 0) AS employee_count, founded_year, website, email, phone, city, state, country, coalesce({_SUFFIXED.format(_CLEAN.format('money_text'))}, 0) AS revenue,
    n_people AS key_personnel_count FROM company WHERE company_id % 6 <> 0""")
def report_sheet(spark, sf):
    return crm.report_sheet(views.companies(spark, sf).withColumn("success", F.col("company_id") % 6 != 0))


@query("flattened_reports", "company", _REPORT_SQL + """ SELECT company_id, name AS "basic_info.company_name", industry AS "basic_info.industry", country AS "basic_info.headquarters.country", market_cap AS "market_position.market_cap",
    round(overall_risk, 6) AS "risk_assessment.overall" FROM rep""")
def flattened_reports(spark, sf):
    r = reports(spark, sf).select("company_id", F.struct(F.col("name").alias("company_name"), "industry", F.struct("country").alias("headquarters")).alias("basic_info"),
                                  F.struct("market_cap").alias("market_position"), F.struct(F.round("overall_risk", 6).alias("overall")).alias("risk_assessment"))
    return crm.flattened(r)


@query("crm_export_rows", "company", """SELECT company_id, name, website, 'Product A, Product ' || company_id AS key_products, CASE WHEN n_social = 0 THEN '' WHEN n_social = 1 THEN 'x' WHEN n_social = 2 THEN 'x, y' ELSE 'x, y, z' END AS tags FROM company""")
def crm_export_rows(spark, sf):
    c = views.companies(spark, sf).select("company_id", "name", "website", F.array(F.lit("Product A"), F.concat(F.lit("Product "), F.col("company_id").cast("string"))).alias("key_products"),
                                          F.slice(F.array(F.lit("x"), F.lit("y"), F.lit("z")), F.lit(1), F.col("n_social")).alias("tags"))
    return crm.joined_lists(c)
