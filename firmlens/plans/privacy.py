"""Queries on personal-data records, consents and data-subject requests."""
from __future__ import annotations

from pyspark.sql import functions as F

from firmlens.operators import dimensions as dims
from firmlens.operators import privacy
from firmlens.plans import views
from firmlens.plans.registry import query

AS_OF = 978307200000000  # 2001-01-01
DAY = privacy.DAY

_POLICIES = "(VALUES " + ", ".join(f"('{c}', {d}, {str(n).lower()}, {str(a).lower()})" for c, d, n, a in privacy.RETENTION) + ") p(category, keep_days, needs_consent, archive)"
RETENTION_SQL = f"""ret AS (SELECT d.*, p.keep_days IS NOT NULL AS has_policy, coalesce(p.keep_days, 30) AS keep_days, p.needs_consent, p.archive,
    created_us + coalesce(p.keep_days, 30)::BIGINT * {DAY} AS expires_us FROM data_record d LEFT JOIN {_POLICIES} ON p.category = d.category)"""
_VIOL = RETENTION_SQL + f""", viol AS (SELECT record_id, subject_id, category, 'missing_retention_policy' AS violation, 'high' AS severity, created_us + 7 * {DAY} AS deadline_us FROM ret WHERE NOT has_policy
    UNION ALL SELECT record_id, r.subject_id, category, 'processing_without_consent', 'critical', created_us + {DAY} FROM ret r LEFT JOIN subject s ON r.subject_id = s.subject_id
      WHERE needs_consent AND NOT coalesce(consent_given, false))"""
_REQ = """asked AS (SELECT subject_id, (['access', 'portability', 'erasure', 'restrict_processing', 'object'])[subject_id % 5 + 1] AS request_type FROM subject WHERE subject_id % 3 = 0)"""


def retained(spark, sf):
    return privacy.with_retention(views.data_records(spark, sf), dims.frame(spark, privacy.RETENTION, privacy.RETENTION_DDL))


def requests(spark, sf):
    kinds = F.array(*[F.lit(k) for k in ("access", "portability", "erasure", "restrict_processing", "object")])
    return views.subjects(spark, sf).filter("subject_id % 3 = 0").select("subject_id", F.element_at(kinds, (F.col("subject_id") % 5 + 1).cast("int")).alias("request_type"))


def violations(spark, sf):
    return privacy.processing_violations(retained(spark, sf), views.subjects(spark, sf))


@query("record_retention", "data_record", RETENTION_SQL + " SELECT record_id, keep_days, has_policy, expires_us FROM ret")
def record_retention(spark, sf):
    return retained(spark, sf).select("record_id", "keep_days", "has_policy", "expires_us")


@query("processing_violations", "data_record subject", _VIOL + " SELECT * FROM viol")
def processing_violations(spark, sf):
    return violations(spark, sf)


@query("access_verdicts", "data_record subject access", RETENTION_SQL + """, j AS (SELECT a.*, r.subject_id, category, CASE WHEN at_us > expires_us THEN 'access_to_expired_data'
      WHEN (is_sensitive OR category = 'personal_identifiable') AND coalesce(consent_withdrawn, false) THEN 'access_after_consent_withdrawal' END AS violation
      FROM access a LEFT JOIN ret r ON a.record_id = r.record_id LEFT JOIN subject s ON r.subject_id = s.subject_id)
    SELECT record_id, line, salt, action, at_us, violation, CASE WHEN category IS NULL THEN NULL WHEN violation IS NOT NULL THEN 'non_compliant' ELSE 'compliant' END AS verdict FROM j""")
def access_verdicts(spark, sf):
    v = privacy.access_verdicts(views.accesses(spark, sf), retained(spark, sf), views.subjects(spark, sf))
    return v.select("record_id", "line", "salt", "action", "at_us", "violation", "verdict")


@query("subject_access_report", "data_record subject access", _REQ + """, mine AS (SELECT d.* FROM data_record d SEMI JOIN (SELECT * FROM asked WHERE request_type = 'access') q ON d.subject_id = q.subject_id)
    SELECT subject_id, record_id, 'record' AS part, created_us AS at_us, basis AS detail FROM mine
    UNION ALL SELECT subject_id, a.record_id, 'audit', at_us, action FROM access a JOIN mine m ON a.record_id = m.record_id""")
def subject_access_report(spark, sf):
    return privacy.access_report(views.data_records(spark, sf), requests(spark, sf), views.accesses(spark, sf))


@query("portable_records", "data_record subject", _REQ + """ SELECT record_id, subject_id, basis FROM data_record WHERE basis IN ('consent', 'contract')
    AND subject_id IN (SELECT subject_id FROM asked WHERE request_type = 'portability')""")
def portable_records(spark, sf):
    return privacy.portable_records(views.data_records(spark, sf), requests(spark, sf)).select("record_id", "subject_id", "basis")


@query("rectified_records", "data_record", """SELECT record_id, CASE WHEN record_id % 4 = 0 AND record_id % 3 <> 0 THEN 'city=Paris,name=new' || record_id || ',purpose=' || purpose
    ELSE 'name=old' || record_id || ',purpose=' || purpose END AS content, record_id % 4 = 0 AND record_id % 3 <> 0 AS updated FROM data_record""")
def rectified_records(spark, sf):
    k = F.col("record_id")
    records = views.data_records(spark, sf).select("record_id", "subject_id", F.create_map(F.lit("name"), F.concat(F.lit("old"), k.cast("string")), F.lit("purpose"), F.col("purpose")).alias("content"))
    corrections = views.data_records(spark, sf).filter("record_id % 4 = 0").select(
        "record_id", F.when(k % 3 == 0, F.col("subject_id") + 1).otherwise(F.col("subject_id")).alias("subject_id"),
        F.create_map(F.lit("name"), F.concat(F.lit("new"), k.cast("string")), F.lit("city"), F.lit("Paris")).alias("changes"))
    out = privacy.rectified(records, corrections)
    text = F.array_join(F.array_sort(F.transform(F.map_entries("content"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return out.select("record_id", text.alias("content"), "updated")


_ERASED = _REQ + """, gone AS (SELECT record_id FROM data_record WHERE basis <> 'legal_obligation' AND category <> 'security_logs' AND subject_id IN (SELECT subject_id FROM asked WHERE request_type = 'erasure'))"""


@query("kept_after_erasure", "data_record subject", _ERASED + " SELECT record_id, subject_id, category FROM data_record WHERE record_id NOT IN (SELECT record_id FROM gone)")
def kept_after_erasure(spark, sf):
    return privacy.after_erasure(views.data_records(spark, sf), requests(spark, sf))[0].select("record_id", "subject_id", "category")


@query("erased_records", "data_record subject", _ERASED + " SELECT record_id FROM gone")
def erased_records(spark, sf):
    return privacy.after_erasure(views.data_records(spark, sf), requests(spark, sf))[1].select("record_id")


@query("processing_restrictions", "data_record subject", _REQ + """ SELECT record_id, subject_id IN (SELECT subject_id FROM asked WHERE request_type = 'restrict_processing') AS restricted,
    basis = 'legitimate_interests' AND subject_id IN (SELECT subject_id FROM asked WHERE request_type = 'object') AS objected FROM data_record""")
def processing_restrictions(spark, sf):
    return privacy.with_restrictions(views.data_records(spark, sf), requests(spark, sf)).select("record_id", "restricted", "objected")


@query("registered_subjects", "req subject", """v AS (SELECT sha256(ip || ':' || user_agent) AS subject_id, event_id, us, consent_given FROM req r JOIN subject s ON r.client = s.subject_id)
    SELECT subject_id, arg_min(consent_given, (us, event_id)) AS consent_given, min(us) AS first_us, CASE WHEN arg_min(consent_given, (us, event_id)) THEN min(us) END AS consent_us FROM v GROUP BY subject_id""")
def registered_subjects(spark, sf):
    s = views.subjects(spark, sf)
    visits = views.events(spark, sf).select(F.col("event_id").alias("visit_id"), "us", F.col("client").alias("subject_id")).join(s, "subject_id").select(
        "visit_id", "us", "ip", "user_agent", F.col("consent_given").alias("consent"))
    return privacy.register_subjects(visits)


@query("audit_signatures", "access", "SELECT record_id, line, salt, sha256(CAST(at_us AS VARCHAR) || action || CAST(operator AS VARCHAR) || '/records') AS signature FROM access")
def audit_signatures(spark, sf):
    return views.accesses(spark, sf).select("record_id", "line", "salt", privacy.signature(F.col("at_us"), F.col("action"), F.col("operator"), F.lit("/records")).alias("signature"))


@query("retention_sweep", "data_record", RETENTION_SQL + f""" SELECT record_id, 'archive' AS step FROM ret WHERE {AS_OF} > expires_us AND coalesce(archive, false)
    UNION ALL SELECT record_id, 'delete' FROM ret WHERE {AS_OF} > expires_us UNION ALL SELECT record_id, sha256('{AS_OF}delete' || subject_id || 'retention_system') FROM ret WHERE {AS_OF} > expires_us""")
def retention_sweep(spark, sf):
    archive, due, audit = privacy.retention_sweep(retained(spark, sf), AS_OF)
    step = lambda df, s: df.select("record_id", s.alias("step"))
    return step(archive, F.lit("archive")).unionByName(step(due, F.lit("delete"))).unionByName(step(audit, F.col("signature")))


@query("compliance_report", "data_record subject", _VIOL + f""" SELECT 'subjects' AS section, 'total' AS item, count(*) AS n FROM subject
    UNION ALL SELECT 'subjects', 'with_consent', count(*) FROM subject WHERE consent_given UNION ALL SELECT 'subjects', 'without_consent', count(*) FROM subject WHERE NOT consent_given
    UNION ALL SELECT 'records', 'total', count(*) FROM ret UNION ALL SELECT 'records', 'expired', count(*) FROM ret WHERE {AS_OF} > expires_us UNION ALL SELECT 'records', 'sensitive', count(*) FROM ret WHERE is_sensitive
    UNION ALL SELECT 'category', category, count(*) FROM ret GROUP BY category
    UNION ALL SELECT 'violations', s, (SELECT count(*) FROM viol WHERE severity = s) FROM (VALUES ('low'), ('medium'), ('high'), ('critical')) v(s) UNION ALL SELECT 'violations', 'total', count(*) FROM viol""")
def compliance_report(spark, sf):
    return privacy.compliance_report(retained(spark, sf), views.subjects(spark, sf), violations(spark, sf), AS_OF)


@query("overall_compliance", "data_record subject", _VIOL + """, c AS (SELECT category, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high FROM viol GROUP BY ALL)
    SELECT CAST(sum(critical) AS BIGINT) AS critical, CAST(sum(high) AS BIGINT) AS high, CASE WHEN sum(critical) > 0 THEN 'NON_COMPLIANT' WHEN sum(high) > 3 THEN 'REQUIRES_IMMEDIATE_ATTENTION'
    WHEN sum(high) > 0 THEN 'REQUIRES_REVIEW' ELSE 'COMPLIANT' END AS status FROM c""")
def overall_compliance(spark, sf):
    return privacy.overall_compliance(violations(spark, sf))
