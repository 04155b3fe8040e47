"""Preparing company records for a CRM."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmlens.functions import numbers


def site_domain(website: Column) -> Column:
    bare = website
    for part in ("https://", "http://", "www."):
        bare = F.replace(bare, F.lit(part), F.lit(""))
    return F.split(bare, "/")[0]


def first_name(name: Column) -> Column:
    return F.coalesce(F.try_element_at(F.split(F.trim(name), r"\s+"), F.lit(1)), F.lit(""))


def last_name(name: Column) -> Column:
    parts = F.split(F.trim(name), r"\s+")
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 2, F.size(parts)), " ")).otherwise("")


def chief(people: Column) -> Column:
    """Name of the first person whose title holds "CEO"."""
    return F.try_element_at(F.filter(people, lambda p: p["title"].contains("CEO")), F.lit(1))["name"]


def account_rows(records: DataFrame, people: str = "people", description_limit: int = 32000) -> DataFrame:
    """Account fields: cut texts, parsed numbers, domain, chief; missing fields are left out of the map."""
    c = F.col
    # Names of the account fields.
    fields = {
        "Name": c("name"), "Website": c("website"), "Industry": c("industry"), "Description": F.substring("description", 1, description_limit),
        "Phone": c("phone"), "BillingStreet": c("address"), "BillingCity": c("city"), "BillingState": c("state"), "BillingCountry": c("country"),
        "NumberOfEmployees": numbers.people_count(c("employee_text")).cast("string"),
        "AnnualRevenue": numbers.money_worded(c("money_text")).cast("decimal(20,0)").cast("string"),
        "YearStarted": c("founded_year").cast("string"), "Domain": site_domain(c("website")), "CeoName": chief(c(people))}
    pairs = F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v)])
    return records.withColumn("fields", F.map_filter(pairs, lambda k, v: v.isNotNull()))


def match_accounts(companies: DataFrame, accounts: DataFrame, key: str) -> DataFrame:
    """Existing account of each company by name or website; null means a new one.

    Two equi joins stand in for the either-or condition, so neither becomes a nested loop.
    Accounts are reduced to one per name or website first: a common name adds no rows.
    """
    by = lambda c: (companies.select(key, c).filter(F.col(c).isNotNull())
                    .join(accounts.filter(F.col(c).isNotNull()).groupBy(c).agg(F.min("account_id").alias("account_id")), c).select(key, "account_id"))
    found = by("name").unionByName(by("website")).groupBy(key).agg(F.min("account_id").alias("account_id"))
    return companies.join(found, key, "left").withColumn("action", F.when(F.col("account_id").isNull(), "insert").otherwise("update"))


def new_contacts(people: DataFrame, existing: DataFrame, company: str, k: int) -> DataFrame:
    """The first k people of each company who are no contacts yet."""
    w = Window.partitionBy(company).orderBy("seen", "person")
    first = people.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k).drop("rn")
    return first.join(existing.select(company, "person").distinct(), [company, "person"], "left_anti")


def flattened(df: DataFrame) -> DataFrame:
    """Nested fields as dotted columns ``a.b``."""
    cols = []

    def walk(schema: T.StructType, path: list[str]):
        for f in schema.fields:
            here = path + [f.name]
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType, here)
            else:
                cols.append(F.col(".".join(f"`{p}`" for p in here)).alias(".".join(here)))
    walk(df.schema, [])
    return df.select(*cols)


def joined_lists(df: DataFrame) -> DataFrame:
    """List fields as text with ", " between items; other fields stay."""
    return df.select(*[F.coalesce(F.array_join(F.transform(F.col(f.name), lambda x: x.cast("string")), ", "), F.lit("")).alias(f.name)
                       if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in df.schema.fields])


def report_sheet(records: DataFrame) -> DataFrame:
    """Sheet for reporting tools: successes only, short text, upper end of ranges, zero for missing numbers."""
    return records.filter("success").select(
        "company_id", "name", "industry", F.substring(F.coalesce("description", F.lit("")), 1, 500).alias("description"),
        F.coalesce(numbers.people_count(F.col("employee_text"), upper=True), F.lit(0)).alias("employee_count"), "founded_year", "website", "email", "phone",
        "city", "state", "country", F.coalesce(numbers.money_suffixed(F.col("money_text")), F.lit(0.0)).alias("revenue"),
        F.col("n_people").alias("key_personnel_count"))
