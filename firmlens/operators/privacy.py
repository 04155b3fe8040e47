"""Retention, consent, access checks and data-subject requests as table rewrites."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = 86_400_000_000

# Category, days kept, needs consent, archived before deletion.
RETENTION = [("personal_identifiable", 365, True, True), ("technical_logs", 90, False, False), ("security_logs", 2555, False, False),
             ("analytics_data", 730, True, False), ("performance_metrics", 180, False, False)]
RETENTION_DDL = "category string, keep_days int, needs_consent boolean, archive boolean"
DEFAULT_DAYS = 30


def subject_id(ip: Column, user_agent: Column) -> Column:
    return F.sha2(F.concat(ip, F.lit(":"), F.coalesce(user_agent, F.lit(""))), 256)


def signature(*parts: Column) -> Column:
    return F.sha2(F.concat(*[p.cast("string") for p in parts]), 256)


def remediation_days(severity: Column) -> Column:
    return F.when(severity == "low", 30).when(severity == "medium", 14).when(severity == "critical", 1).otherwise(7)


def with_retention(records: DataFrame, policies: DataFrame) -> DataFrame:
    """Days kept and expiry per record; a category without policy is kept 30 days."""
    out = records.join(policies, "category", "left")
    return out.withColumns({"has_policy": F.col("keep_days").isNotNull(), "keep_days": F.coalesce("keep_days", F.lit(DEFAULT_DAYS))}).withColumn(
        "expires_us", F.col("created_us") + F.col("keep_days").cast("long") * DAY)


def processing_violations(retained: DataFrame, subjects: DataFrame) -> DataFrame:
    """Records without a policy, and records that need a consent nobody gave."""
    checked = retained.join(subjects.select("subject_id", "consent_given"), "subject_id", "left")
    row = lambda kind, sev: F.struct(F.lit(kind).alias("violation"), F.lit(sev).alias("severity"))
    found = F.array_compact(F.array(
        F.when(~F.col("has_policy"), row("missing_retention_policy", "high")),
        F.when(F.coalesce("needs_consent", F.lit(False)) & ~F.coalesce("consent_given", F.lit(False)), row("processing_without_consent", "critical"))))
    return checked.select("record_id", "subject_id", "category", "created_us", F.explode(found).alias("v")).select(
        "record_id", "subject_id", "category", "created_us", "v.*").withColumn(
        "deadline_us", F.col("created_us") + remediation_days(F.col("severity")).cast("long") * DAY).drop("created_us")


def access_verdicts(accesses: DataFrame, retained: DataFrame, subjects: DataFrame) -> DataFrame:
    """Whether each access was allowed: not after expiry, not to private data after consent was withdrawn.

    Accesses to records that do not exist keep their audit row with no verdict.
    """
    r = retained.select("record_id", "subject_id", "category", "expires_us", "is_sensitive")
    joined = accesses.join(r, "record_id", "left").join(subjects.select("subject_id", "consent_withdrawn"), "subject_id", "left")
    late = F.col("at_us") > F.col("expires_us")
    private = (F.col("is_sensitive") | (F.col("category") == "personal_identifiable")) & F.coalesce("consent_withdrawn", F.lit(False))
    why = F.when(late, "access_to_expired_data").when(private, "access_after_consent_withdrawal")
    return joined.withColumns({"violation": why, "verdict": F.when(F.col("category").isNull(), None).when(why.isNotNull(), "non_compliant").otherwise("compliant")})


def requested(records: DataFrame, requests: DataFrame, kind: str) -> DataFrame:
    """Records of the subjects who filed a request of a kind."""
    asked = requests.filter(F.col("request_type") == kind).select("subject_id").distinct()
    return records.join(asked, "subject_id", "left_semi")


def access_report(records: DataFrame, requests: DataFrame, accesses: DataFrame) -> DataFrame:
    """Everything held about the asking subjects: record rows and audit rows."""
    mine = requested(records, requests, "access")
    held = mine.select("subject_id", "record_id", F.lit("record").alias("part"), F.col("created_us").alias("at_us"), F.col("basis").alias("detail"))
    trail = accesses.join(mine.select("record_id", "subject_id"), "record_id").select(
        "subject_id", "record_id", F.lit("audit").alias("part"), "at_us", F.col("action").alias("detail"))
    return held.unionByName(trail)


def portable_records(records: DataFrame, requests: DataFrame) -> DataFrame:
    return requested(records, requests, "portability").filter(F.col("basis").isin("consent", "contract"))


def rectified(records: DataFrame, corrections: DataFrame) -> DataFrame:
    """Content maps with the subject's own corrections merged in; the correction wins."""
    c = corrections.select("record_id", F.col("subject_id").alias("by_subject"), "changes")
    joined = records.join(c, "record_id", "left")
    mine = F.col("by_subject") == F.col("subject_id")
    kept = F.map_filter("content", lambda k, v: ~F.map_contains_key(F.col("changes"), k))
    return joined.withColumns({"content": F.when(mine, F.map_concat(kept, "changes")).otherwise(F.col("content")),
                               "updated": F.coalesce(mine, F.lit(False))}).drop("by_subject", "changes")


def may_erase(basis: Column, category: Column) -> Column:
    return (basis != "legal_obligation") & (category != "security_logs")


def after_erasure(records: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kept and erased records; together they are the input."""
    erased = requested(records, requests, "erasure").filter(may_erase(F.col("basis"), F.col("category")))
    return records.join(erased.select("record_id"), "record_id", "left_anti"), erased


def with_restrictions(records: DataFrame, requests: DataFrame) -> DataFrame:
    """Flags for restricted processing and for objections (legitimate interests only)."""
    asked = requests.groupBy("subject_id").agg(F.bool_or(F.col("request_type") == "restrict_processing").alias("r"),
                                               F.bool_or(F.col("request_type") == "object").alias("o"))
    j = records.join(asked, "subject_id", "left")
    return j.withColumns({"restricted": F.coalesce("r", F.lit(False)),
                          "objected": F.coalesce("o", F.lit(False)) & (F.col("basis") == "legitimate_interests")}).drop("r", "o")


def register_subjects(visits: DataFrame) -> DataFrame:
    """One subject per (address, agent): consent as on the first visit, and its time."""
    return (visits.groupBy(subject_id(F.col("ip"), F.col("user_agent")).alias("subject_id"))
            .agg(F.min_by("consent", F.struct("us", "visit_id")).alias("consent_given"), F.min("us").alias("first_us"))
            .withColumn("consent_us", F.when(F.col("consent_given"), F.col("first_us"))))


def retention_sweep(retained: DataFrame, as_of: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records to archive, records to delete, and the audit rows of the deletions."""
    due = retained.filter(F.lit(as_of) > F.col("expires_us"))
    archive = due.filter(F.coalesce("archive", F.lit(False)))
    audit = due.select("record_id", "subject_id", F.lit("delete").alias("action"), F.lit("retention_system").alias("operator"),
                       F.lit(as_of).cast("long").alias("at_us"),
                       signature(F.lit(as_of), F.lit("delete"), F.col("subject_id"), F.lit("retention_system")).alias("signature"))
    return archive, due, audit


def compliance_report(retained: DataFrame, subjects: DataFrame, violations: DataFrame, as_of: int) -> DataFrame:
    """Long report: section, item, count; severities without violations are reported as 0."""
    n = F.count(F.lit(1))
    subj = subjects.agg(n.alias("total"), F.count_if("consent_given").alias("with_consent"), F.count_if(~F.coalesce("consent_given", F.lit(False))).alias("without_consent"))
    recs = retained.agg(n.alias("total"), F.count_if(F.lit(as_of) > F.col("expires_us")).alias("expired"), F.count_if("is_sensitive").alias("sensitive"))
    cats = retained.groupBy(F.col("category").alias("item")).agg(n.alias("n")).select(F.lit("category").alias("section"), "item", "n")
    names = ["low", "medium", "high", "critical"]
    viol = violations.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in names], n.alias("total"))

    def long(df, section, cols):
        return df.select(F.explode(F.array(*[F.struct(F.lit(section).alias("section"), F.lit(c).alias("item"), F.col(c).alias("n")) for c in cols])).alias("x")).select("x.*")
    return (long(subj, "subjects", ["total", "with_consent", "without_consent"]).unionByName(long(recs, "records", ["total", "expired", "sensitive"]))
            .unionByName(cats).unionByName(long(viol, "violations", names + ["total"])))


def overall_compliance(violations: DataFrame) -> DataFrame:
    open_ = violations.agg(F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("high"))
    return open_.withColumn("status", F.when(F.col("critical") > 0, "NON_COMPLIANT").when(F.col("high") > 3, "REQUIRES_IMMEDIATE_ATTENTION")
                            .when(F.col("high") > 0, "REQUIRES_REVIEW").otherwise("COMPLIANT"))
