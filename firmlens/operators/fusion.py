"""Merging what several sources say about a company.

Which source wins a field is decided in two steps. The highest confidence at which a field is known is a
maximum of numbers, which combines on the map side without sorting. Only records that are at the top for
some field go on; among them ``min_by`` finds the first source, again combined on the map side, so a company
with very many sources costs no more memory than one with two.

An empty text counts as missing.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIMPLE = ["description", "industry", "sector", "founded_year"]
#: What comes together from the source of the address, and what the base record alone says.
PLACE = ["address", "city", "state", "country", "postal_code"]
BASE_ONLY = ["website", "stock_symbol", "funding", "valuation"]


def trusted(records: DataFrame, least: float = 0.1) -> DataFrame:
    return records.filter(F.col("confidence") > least)


def at_the_top(records: DataFrame, key: str, known: dict[str, Column]) -> DataFrame:
    """Records of the highest confidence of their company for at least one of the ``known`` conditions; the others can win nothing."""
    best = records.groupBy(F.col(key).alias("__key")).agg(*[F.max(F.when(test, F.col("confidence"))).alias(f"__top_{name}") for name, test in known.items()])
    tops = [test & (F.col("confidence") == F.col(f"__top_{name}")) for name, test in known.items()]
    joined = records.join(best, F.col(key).eqNullSafe(F.col("__key")))
    return joined.filter(reduce(lambda a, b: a | b, tops)).select(*records.columns)


def present(records: DataFrame, column: str) -> Column:
    known = F.col(column).isNotNull()
    return known & (F.col(column) != "") if dict(records.dtypes)[column] == "string" else known


def fuse(records: DataFrame, key: str, fill_headquarters: bool = False, simple: list[str] = SIMPLE) -> DataFrame:
    """One record per company: the most confident source, gaps filled from the others in order.

    The order is confidence, highest first, then source name. Address, city, state, country and postal
    code come together from one source, the first with an address, else the first with any contact; so do head count
    and size class. Website, stock symbol, funding and valuation are the base record's. Of the columns
    of ``PLACE`` and ``BASE_ONLY``, those that the input has are given. The mean is taken over decimals,
    so that it does not depend on the order of partial sums.
    """
    have = [c for c in (*simple, "employee_count", "company_size", "headquarters", "email", "phone", *PLACE, *BASE_ONLY) if c in records.columns]
    good = trusted(records).select(key, "source", "confidence", "quality", "completeness", *have)
    has = {c: present(good, c) for c in have}
    fields = [*simple, "employee_count", "email", "phone", *(["headquarters"] if fill_headquarters else [])]
    known = {"base": F.lit(True), "contact": has["email"] | has["phone"] | has["address"], "address": has["address"], **{c: has[c] for c in fields}}
    order = F.struct((-F.col("confidence")).alias("c"), "source")

    def first(value: Column, name: str) -> Column:
        return F.min_by(value, F.when(known[name], order))

    given = lambda c: F.when(F.col(c) != "", F.col(c)) if dict(good.dtypes)[c] == "string" else F.col(c)
    places = F.struct(*[given(c).alias(c) for c in PLACE if c in have])
    people = F.struct("employee_count", *(["company_size"] if "company_size" in have else []))
    alone = [c for c in (*([] if fill_headquarters else ["headquarters"]), "company_size", *BASE_ONLY) if c in have]
    winners = at_the_top(good, key, known).groupBy(key).agg(
        first(F.struct("source", *[given(c).alias(c) for c in alone]), "base").alias("__base"), *[first(F.col(c), c).alias(c) for c in fields if c != "employee_count"],
        first(people, "employee_count").alias("__people"), first(places, "address").alias("__address"), first(places, "contact").alias("__contact"))
    counted = good.groupBy(F.col(key).alias("__key")).agg(
        F.count(F.lit(1)).alias("sources"), F.avg(F.col("confidence").cast("decimal(20,10)")).cast("double").alias("__mean"),
        F.max("quality").alias("quality"), F.max("completeness").alias("completeness"))
    where = F.coalesce("__address", "__contact")
    sized = {"employee_count": F.col("__people.employee_count")}
    if "company_size" in have:
        sized["company_size"] = F.coalesce("__people.company_size", "__base.company_size")
    headquarters = F.col("headquarters") if fill_headquarters else F.col("__base.headquarters")
    bonus = F.least((F.col("sources") - 1) * 0.1, F.lit(0.3))
    return counted.join(winners, F.col(key).eqNullSafe(F.col("__key"))).select(
        key, "sources", F.col("__base.source").alias("base_source"), *simple, *[e.alias(c) for c, e in sized.items()], headquarters.alias("headquarters"),
        "email", "phone", *[where[c].alias(c) for c in PLACE if c in have], *[F.col(f"__base.{c}").alias(c) for c in BASE_ONLY if c in have],
        F.least(F.col("__mean") + bonus, F.lit(1.0)).alias("confidence"), "quality", "completeness")


def fused_profiles(records: DataFrame, key: str) -> DataFrame:
    """One social profile per platform: the last verified one seen, else the first seen."""
    order = F.struct("source", "profile_url")
    pick = F.struct("profile_url", "verified")
    return (trusted(records).filter("platform is not null").groupBy(key, "platform")
            .agg(F.coalesce(F.max_by(pick, F.when(F.col("verified"), order)), F.min_by(pick, order)).alias("p"))
            .select(key, "platform", "p.*"))


def fused_people(records: DataFrame, key: str) -> DataFrame:
    """Each person once, as first seen."""
    first = F.min(F.struct("source", "person", "person_title"))
    return (trusted(records).filter("person is not null").groupBy(key, F.lower(F.trim("person")).alias("person_key"))
            .agg(first.alias("p")).select(key, "p.person", "p.person_title"))


def fused_locations(records: DataFrame, key: str) -> DataFrame:
    """Offices and headquarters of all sources without the base's own headquarters."""
    good = trusted(records).select(key, "source", "confidence", "headquarters", "location")
    counted = good.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("n"))
    base = at_the_top(good, key, {"base": F.lit(True)}).groupBy(key).agg(F.min(F.struct("source", "headquarters")).alias("b"))
    base = base.join(counted, F.col(key).eqNullSafe(F.col("__key"))).select(key, "n", F.col("b.headquarters").alias("base_hq"))
    named = good.select(key, F.explode(F.array(F.struct(F.lit(False).alias("hq"), F.col("location").alias("location")),
                                               F.struct(F.lit(True).alias("hq"), F.col("headquarters").alias("location")))).alias("l"))
    every = named.filter("l.location is not null").groupBy(key, "l.location").agg(F.bool_and("l.hq").alias("only_hq"))
    return (every.join(base, key).filter(F.when(F.col("n") == 1, ~F.col("only_hq"))
                                         .otherwise(~F.col("location").eqNullSafe(F.col("base_hq")))).select(key, "location"))


def locations_without(all_places: DataFrame, headquarters: DataFrame) -> DataFrame:
    """Relational twin: rows of the first table that the second does not have."""
    return all_places.distinct().exceptAll(headquarters.distinct())


def role_counts(people: DataFrame, title: str) -> DataFrame:
    return people.groupBy(title).agg(F.count(F.lit(1)).alias("people"))
