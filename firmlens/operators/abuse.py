"""Rate limits and abuse detection over a request log."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmlens.operators import ordered, sequential, telemetry

SECOND = 1_000_000
HOUR = 3600 * SECOND


def with_previous(log: DataFrame, keys: list[str]) -> DataFrame:
    return ordered.previous_values(log.withColumn("slot", F.floor(F.col("us") / HOUR).cast("long")), keys, ["slot"],
                                   ["us", "event_id"], {"us": "prev_us"}).drop("slot")


def recent_interval_variance(log: DataFrame, keys: list[str], k: int = 10) -> DataFrame:
    """Population variance of the last ``k`` intervals, in seconds squared."""
    gaps = with_previous(log.select(*keys, "us", "event_id"), keys).withColumn("gap", (F.col("us") - F.col("prev_us")) / SECOND)
    last = telemetry.newest(gaps, keys, [F.desc("us"), F.desc("event_id")], k)
    return last.groupBy(*keys).agg(F.count("gap").alias("intervals"), F.var_pop("gap").alias("variance"))


# Limits of the suspicion score.
SCORE_LIMITS = {"per_hour": 100, "endpoints": 20, "agents": 5, "errors": 0.5, "variance": 0.1}


def limits_with(own: dict | None) -> dict:
    return {**SCORE_LIMITS, **(own or {})}


def running_scores(log: DataFrame, keys: list[str], limits: dict | None = None, idle: int = 24 * HOUR) -> DataFrame:
    """Adds ``score``, the suspicion score of each request's client as it stood with that request.

    A client silent for longer than ``idle`` starts afresh. The log is scanned in chunks of time whose states are joined
    (``sequential.joined_scan``), so a client may hold most of the log. A request without a time is judged by itself.
    """
    p = limits_with(limits)
    keep = [c for c in log.columns if c != "score"]
    scan = sequential.visit_scan(p, idle)
    timed = sequential.joined_scan(log.select(keep).filter(F.col("us").isNotNull()), keys, "us", 7 * idle, ["us", "event_id"],
                                   ["us", "event_id", "endpoint", "agent", "is_error"], scan, "score")
    one = lambda c: F.when(F.col(c), 1).otherwise(0) if c == "is_error" else F.col(c).isNotNull().cast("int")
    tests = [(F.lit(1 / 0.1) > p["per_hour"], 0.3), (one("endpoint") > p["endpoints"], 0.2), (one("agent") > p["agents"], 0.15), (one("is_error") > p["errors"], 0.25)]
    score = sum((F.when(test, weight).otherwise(0.0) for test, weight in tests), F.lit(0.0))
    return timed.unionByName(log.select(keep).filter(F.col("us").isNull()).withColumn("score", F.least(score, F.lit(1.0))))


def abuse_profiles(log: DataFrame, keys: list[str], limits: dict | None = None) -> DataFrame:
    """Suspicion score per client from rate, endpoint and agent variety, errors and regularity."""
    p = limits_with(limits)
    base = log.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"), F.countDistinct("endpoint").alias("endpoints"),
        F.countDistinct("agent").alias("agents"), (F.count_if("is_error") / F.count(F.lit(1))).alias("error_rate"),
        F.greatest((F.max("us") - F.min("us")) / HOUR, F.lit(0.1)).alias("hours"))
    both = ordered.join_null_safe(base, recent_interval_variance(log, keys), keys)
    per_hour = F.col("requests") / F.col("hours")

    def part(test, weight):
        return F.when(test, weight).otherwise(0.0)
    score = (part(per_hour > p["per_hour"], 0.3) + part(F.col("endpoints") > p["endpoints"], 0.2)
             + part(F.col("agents") > p["agents"], 0.15) + part(F.col("error_rate") > p["errors"], 0.25)
             + part((F.col("requests") > 11) & (F.col("variance") < p["variance"]), 0.1))
    return both.select(*keys, "requests", "endpoints", "agents", "error_rate", per_hour.alias("per_hour"),
                       F.least(score, F.lit(1.0)).alias("score")).withColumn("suspicious", F.col("score") >= 0.7)


# Agents of scanners and of bare clients.
SCANNER_AGENTS = ["sqlmap", "nmap", "nikto", "dirb", "gobuster", r"python-requests/\d+\.\d+\.\d+$", r"curl/\d+\.\d+\.\d+$"]


def activity_alerts(log: DataFrame, keys: list[str], as_of: int, busy: int = 1000, auth_fails: int = 10) -> DataFrame:
    """Alert names per client: busy last hour, failed logins, scanner agents, error share."""
    scanner = F.lower("user_agent").rlike("|".join(SCANNER_AGENTS))
    agg = log.groupBy(*keys).agg(
        F.count_if((F.col("us") > as_of - HOUR) & (F.col("us") <= as_of)).alias("hour"), F.count_if("auth_failed").alias("fails"),
        F.bool_or(scanner).alias("scan"), (F.count_if("is_error") / F.count(F.lit(1))).alias("errors"))
    names = F.array_compact(F.array(
        F.when(F.col("hour") > busy, "HIGH_REQUEST_RATE"), F.when(F.col("fails") > auth_fails, "MULTIPLE_AUTH_FAILURES"),
        F.when(F.col("scan"), "SUSPICIOUS_USER_AGENT"), F.when(F.col("errors") > 0.5, "HIGH_ERROR_RATE")))
    return agg.select(*keys, names.alias("alerts")).filter(F.size("alerts") > 0)


def ip_number(ip: Column) -> Column:
    parts = F.split(ip, r"\.")
    return sum((F.element_at(parts, i + 1).cast("long") * 256 ** (3 - i) for i in range(4)), F.lit(0).cast("long"))


def in_network(ip: Column, cidr: Column) -> Column:
    """Whether an IPv4 address lies in ``a.b.c.d`` or ``a.b.c.d/n``."""
    bits = F.coalesce(F.try_element_at(F.split(cidr, "/"), F.lit(2)).cast("int"), F.lit(32))
    size = F.pow(F.lit(2.0), 32 - bits).cast("long")
    net = ip_number(F.element_at(F.split(cidr, "/"), 1))
    return F.floor(ip_number(ip) / size) == F.floor(net / size)


def covers(prefixes: list[str] | None, agents: list[str] | None, exempt: list[str] | None) -> Column:
    """Whether a rule covers a request; a missing list asks nothing."""
    def any_of(tests):
        out = F.lit(False)
        for t in tests:
            out = out | F.coalesce(t, F.lit(False))
        return out
    ok = F.lit(True)
    if prefixes:
        ok = ok & any_of(F.startswith(F.col("endpoint"), F.lit(p)) for p in prefixes)
    if agents:
        ok = ok & any_of(F.contains(F.lower("user_agent"), F.lit(a.lower())) for a in agents)
    if exempt:
        ok = ok & ~any_of(in_network(F.col("ip"), F.lit(n)) for n in exempt)
    return ok


def applicable_rules(log: DataFrame, rules: list[tuple]) -> DataFrame:
    """Requests with each rule that covers them.

    A rule is (name, requests, window seconds, endpoint prefixes, agent parts, exempt networks,
    priority). Rules are a short configuration list, so each request tests them in place.
    """
    hits = [F.when(covers(p, a, n), F.struct(F.lit(name).alias("rule"), F.lit(q).alias("requests"), F.lit(w).alias("window_seconds"),
                                             F.lit(pr).alias("priority"))) for name, q, w, p, a, n, pr in rules]
    return log.withColumn("r", F.explode(F.array_compact(F.array(*hits)))).select(*log.columns, "r.*")


RULES_DDL = "name string, requests int, window_seconds int, prefixes array<string>, agents array<string>, exempt array<string>, priority int"


def rules_from(table: DataFrame, most: int = 1000) -> list[tuple]:
    """Rules kept as a table (``RULES_DDL``), so that they can be changed without code; at most ``most``, as every request is tested against each."""
    rows = table.select(*[c.split()[0] for c in RULES_DDL.split(", ")]).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules")
    return sorted((tuple(r) for r in rows), key=lambda r: (r[6], r[0]))


def rule_chain(log: DataFrame, keys: list[str], rules: list[tuple], block_seconds: int = 3600, chunk_us: int | None = None) -> DataFrame:
    """Limiter verdict of each request (``us``, ``event_id``, ``endpoint``, ``score``) under all rules that cover it.

    Rules as in ``applicable_rules``, asked by priority until one denies; a request that no rule covers is allowed.
    ``score`` is the suspicion score known at the request (null: none). Added columns: ``allowed``, ``rule`` and
    ``reason`` of the denial, and ``threat_level`` and ``action`` of its security event, all null if allowed.
    """
    longest = max([block_seconds, *(r[2] for r in rules)]) * SECOND
    work = chain_inputs(log, rules).withColumn("chunk", F.floor(F.col("us") / F.lit(chunk_us or max(24 * HOUR, 10 * longest))).cast("long"))
    out = sequential.chunked_scan(work, keys, "chunk", ["us", "event_id"], ["us", "mask", "score"], chain_scan(rules, block_seconds), CHAIN_FIELDS)
    return chain_verdicts(out.drop("chunk"), rules, block_seconds)


CHAIN_FIELDS = "denied_by int, in_block boolean"


def by_priority(rules: list[tuple]) -> list[tuple]:
    return sorted(rules, key=lambda r: r[6])


def chain_inputs(log: DataFrame, rules: list[tuple]) -> DataFrame:
    """The log with ``mask``, whose bit i says that the rule of rank i covers the request, and without missing scores if it has scores."""
    bits = [F.when(covers(p, a, n), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, _, _, p, a, n, _) in enumerate(by_priority(rules))]
    masked = log.withColumn("mask", sum(bits, F.lit(0)).cast("long"))
    return masked.withColumn("score", F.coalesce(F.col("score").cast("double"), F.lit(0.0))) if "score" in log.columns else masked


def chain_scan(rules: list[tuple], block_seconds: int):
    return sequential.rule_chain_scan([(q, w * SECOND) for _, q, w, *_ in by_priority(rules)], block_seconds * SECOND)


def chain_verdicts(scanned: DataFrame, rules: list[tuple], block_seconds: int) -> DataFrame:
    """Names of the denying rules, reasons, and the security events' levels and actions."""
    denied = F.col("denied_by") >= 0
    return scanned.withColumns({
        "allowed": ~denied, "rule": F.when(denied, F.element_at(F.array(*[F.lit(r[0]) for r in by_priority(rules)]), F.col("denied_by") + 1)),
        "reason": F.when(denied, F.when(F.col("in_block"), "client_blocked").otherwise("rate_limit_exceeded")),
        "threat_level": F.when(denied, F.when(F.col("score") >= 0.7, "high").otherwise("medium")),
        "action": F.when(denied, F.when(F.col("score") > 0.9, f"client_blocked_{block_seconds // 3600}h").otherwise("request_blocked")),
    }).drop("mask", "denied_by", "in_block")


def sliding_limit(log: DataFrame, keys: list[str], limit: int, window_seconds: int,
                  chunk_us: int = 24 * HOUR) -> DataFrame:
    """Exact limiter verdict per request: only allowed requests use up the window."""
    # Chunks much longer than the window settle in few rounds.
    chunk_us = max(chunk_us, 10 * window_seconds * SECOND)
    work = log.withColumn("chunk", F.floor(F.col("us") / chunk_us).cast("long"))
    return sequential.chunked_scan(work, keys, "chunk", ["us", "event_id"], "us",
                                   sequential.window_limit_scan(window_seconds * SECOND, limit),
                                   "allowed boolean, remaining long").drop("chunk")


def security_rollup(events: DataFrame, violations: DataFrame, profiles: DataFrame, samples: DataFrame) -> DataFrame:
    """One row: limiter and security violations, blocks, suspicious clients, response time, error share."""
    parts = [
        events.agg(F.count(F.lit(1)).alias("rate_limit_violations"),
                   F.count_if(F.contains("action", F.lit("blocked"))).alias("blocked_requests")),
        violations.agg(F.count(F.lit(1)).alias("security_violations")),
        profiles.agg(F.count_if(F.col("score") > 0.7).alias("suspicious_clients")),
        samples.agg(F.coalesce(F.avg("ms"), F.lit(0.0)).alias("avg_ms"),
                    (F.count_if("is_error") / F.greatest(F.count(F.lit(1)), F.lit(1)) * 100).alias("error_pct"))]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])
