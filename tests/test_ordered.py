"""Ordered helpers against brute force, with one key holding most rows."""
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from firmlens.operators import abuse, crawl, durable, ordered, telemetry


def log(seed=3, n=600):
    rnd = random.Random(seed)
    rows, t = [], 0
    for i in range(n):
        t += rnd.choice([1, 5, 40, 200, 2000]) * 1_000_000
        key = "hot" if rnd.random() < 0.6 else rnd.choice("abc")
        rows.append((i, key, t + rnd.randrange(1000), rnd.choice([1.0, 2.5, 9.0, 1e6]) * rnd.random()))
    return rows


@pytest.fixture
def frame(spark):
    return spark.createDataFrame(log(), "event_id long, key string, us long, value double")


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        out.setdefault(r[1], []).append(r)
    return out


@pytest.fixture
def many_parts(spark):
    """Small parts are not put together again."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_order_statistics_long_tail(frame, many_parts):
    n = F.col("n")
    got = {r["key"]: r for r in ordered.order_statistics(frame, ["key"], "value", {"lo": F.lit(1), "mid": F.floor((n + 1) / 2), "hi": n}).collect()}
    for key, rows in by_key(log()).items():
        v = sorted(r[3] for r in rows)
        assert (got[key]["lo"], got[key]["mid"], got[key]["hi"]) == (v[0], v[(len(v) + 1) // 2 - 1], v[-1])


def test_exclusive_quantiles_match_definition(frame, many_parts):
    import statistics
    got = {r["key"]: r for r in telemetry.metric_statistics(frame, ["key"], "value", ["us", "event_id"]).collect()}
    for key, rows in by_key(log()).items():
        v = [r[3] for r in rows]
        assert got[key]["median"] == pytest.approx(statistics.median(v))
        assert got[key]["std_dev"] == pytest.approx(statistics.stdev(v))
        assert got[key]["p95"] == pytest.approx(statistics.quantiles(v, n=20)[18] if len(v) >= 20 else max(v))
        assert got[key]["p99"] == pytest.approx(statistics.quantiles(v, n=100)[98] if len(v) >= 100 else max(v))
        assert got[key]["last_value"] == rows[-1][3]


def test_running_totals_and_lag(frame):
    slots = frame.withColumn("slot", F.floor(F.col("us") / 60_000_000)).withColumn("sub", F.floor(F.col("us") / 7_000_000))
    run = {r["event_id"]: r["total"] for r in ordered.running_totals(slots, ["key"], [["slot"], ["sub"]], ["us", "event_id"], {"total": F.lit(1).cast("long")}).collect()}
    lag = {r["event_id"]: r["before"] for r in ordered.previous_values(slots, ["key"], ["slot"], ["us", "event_id"], {"us": "before"}).collect()}
    for rows in by_key(log()).values():
        for i, r in enumerate(rows):
            assert run[r[0]] == i + 1
            assert lag[r[0]] == (rows[i - 1][2] if i else None)


def test_trailing_counts_and_streaks(frame):
    got = {r["event_id"]: r["in_window"] for r in ordered.trailing_counts(frame, ["key"], "us", 300_000_000).collect()}
    slots = frame.withColumn("slot", F.floor(F.col("us") / 600_000_000))
    runs = sorted((r["key"], r["streak_length"]) for r in ordered.streaks(slots, ["key"], [["slot"]], ["us", "event_id"], F.col("value") < 5, [], 3).collect())
    want = []
    for key, rows in by_key(log()).items():
        length = 0
        for i, r in enumerate(rows):
            assert got[r[0]] == sum(1 for o in rows if r[2] - 300_000_000 <= o[2] <= r[2])
            if r[3] < 5:
                length += 1
            if (r[3] >= 5 or i == len(rows) - 1) and length:
                want += [(key, length)] if length >= 3 else []
                length = 0
    assert runs == sorted(want)


@pytest.mark.parametrize("chunk_seconds", [40_000, 10 ** 6])
def test_limiter_equals_single_scan(frame, chunk_seconds):
    got = {r["event_id"]: r["allowed"] for r in abuse.sliding_limit(frame, ["key"], 3, 600, chunk_us=chunk_seconds * 1_000_000).collect()}
    for rows in by_key(log()).values():
        kept = []
        for r in rows:
            kept = [t for t in kept if t >= r[2] - 600_000_000]
            assert got[r[0]] == (len(kept) < 3)
            if len(kept) < 3:
                kept.append(r[2])


def test_limiter_remaining_then_blocked(spark):
    rows = spark.createDataFrame([(i, "c", i * 1_000_000) for i in range(3)], "event_id long, key string, us long")
    out = sorted(abuse.sliding_limit(rows, ["key"], 2, 60).collect(), key=lambda r: r["event_id"])
    assert [(r["allowed"], r["remaining"]) for r in out] == [(True, 1), (True, 0), (False, 0)]


def test_cooldown_and_hour_counts(frame):
    sent = {r["event_id"] for r in telemetry.emitted_alerts(frame, ["key"], 300, chunk_us=40_000_000_000).collect()}
    counts = {r["event_id"]: r["hour_count"] for r in crawl.hourly_counts(frame, ["key"], chunk_us=40_000_000_000).collect()}
    for rows in by_key(log()).values():
        last = anchor = None
        n = 0
        for r in rows:
            ok = last is None or r[2] - last > 300_000_000
            assert (r[0] in sent) == ok
            last = r[2] if ok else last
            n += 1
            if anchor is None or r[2] - anchor >= 3_600_000_000:
                anchor, n = r[2], 1
            assert counts[r[0]] == n


def test_abuse_fixture(spark):
    rows = [(i, "c", i * 10_000 * (1 + i % 3), f"/e{i}", 1, i % 5 == 0) for i in range(50)]
    df = spark.createDataFrame(rows, "event_id long, client string, us long, endpoint string, agent int, is_error boolean")
    r = abuse.abuse_profiles(df, ["client"]).collect()[0]
    assert r["score"] == pytest.approx(0.6) and not r["suspicious"]
    assert np.isclose(r["error_rate"], 0.2)


def test_trailing_counts_with_null_times_equals_a_plain_window(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from firmlens.operators.ordered import trailing_counts
    df = spark.createDataFrame([(1, 1, None), (2, 1, None), (3, 1, 5), (4, 1, 12), (5, 2, None), (6, 2, 0), (7, 1, 30)], "i int, k int, t long")
    plain = df.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("k").orderBy("t").rangeBetween(-10, 0)))
    assert {(r["i"], r["n"]) for r in trailing_counts(df, ["k"], "t", 10, "n").collect()} == {(r["i"], r["n"]) for r in plain.collect()}


def test_one_key_with_most_rows_of_one_hour(spark, many_parts):
    """Running totals and carried maxima of a hot key, many of its rows at one time, over several parts."""
    pick = random.Random(8)
    rows = [(k, "hot" if k % 10 else None, pick.choice([5_000, 5_000, pick.randint(0, 9_000)]), pick.choice([None, pick.randint(0, 99)])) for k in range(4000)]
    df = spark.createDataFrame(rows, "event_id long, key string, us long, value long").repartition(4)
    parts = ordered.dealt(df, ["key"], ["us", "event_id"]).groupBy("key", "__part").count().collect()
    assert max(r["count"] for r in parts) < 2500 and len(parts) >= 4
    got = {r["event_id"]: (r["n"], r["total"]) for r in ordered.totals_along(df, ["key"], ["us", "event_id"], {"n": F.lit(1).cast("long"), "total": F.coalesce("value", F.lit(0))}).collect()}
    upto = {r["event_id"]: r["top"] for r in ordered.largest_so_far(df, ["key"], "us", "value", "top").collect()}
    before = {r["event_id"]: r["top"] for r in ordered.largest_so_far(df, ["key"], "us", "value", "top", before=True).collect()}
    for key in ("hot", None):
        mine = sorted([(r[2], r[0], r[3]) for r in rows if r[1] == key], key=lambda r: r[:2])
        total = 0
        for i, (us, k, value) in enumerate(mine):
            total += value or 0
            assert got[k] == (i + 1, total)
        tops, top = {}, None
        for us in sorted({m[0] for m in mine}):
            earlier = top
            for m in (m for m in mine if m[0] == us):
                top = m[2] if top is None or (m[2] is not None and m[2] > top) else top
            tops[us] = (top, earlier)
        for us, k, _ in mine:
            assert (upto[k], before[k]) == tops[us]


def test_robots_rules_by_prefix(spark):
    files = spark.createDataFrame([("http://a", "User-agent: x\nDisallow: /\n\nUser-Agent: *\nAllow: /pub\nDisallow: /p\nDisallow:\nAllow: /p/q"), ("http://b", "")], "domain string, content string")
    pages = spark.createDataFrame([(1, "http://a/pub/1"), (2, "http://a/private"), (3, "http://a/p/q/r"), (4, "http://a"), (5, "http://b/x"), (6, "http://c/x")], "page_id long, url string")
    got = {r["page_id"]: (r["can_fetch"], r["reason"]) for r in crawl.robots_verdicts(pages, crawl.robots_rules(files), "bot").collect()}
    assert got == {1: (True, "allowed for *"), 2: (False, "disallowed for *"), 3: (True, "allowed for *"), 4: (True, "no matching rule"), 5: (True, "no robots file"), 6: (True, "no robots file")}
    assert crawl.robots_verdicts(pages, crawl.robots_rules(files), "X").filter("not can_fetch").count() == 2


def test_rules_from_a_table(spark):
    rules = spark.createDataFrame([("b", 5, 60, None, ["CURL"], None, 15), ("a", 10, 60, ["/api"], None, None, 5)], abuse.RULES_DDL)
    assert abuse.rules_from(rules) == [("a", 10, 60, ["/api"], None, None, 5), ("b", 5, 60, None, ["CURL"], None, 15)]
    with pytest.raises(ValueError):
        abuse.rules_from(rules, most=1)


def test_scratch_tables_are_removed(spark):
    kept = durable.stored(spark.range(3))
    with durable.scratch():
        rows = durable.stored(spark.range(5))
        path = rows.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert rows.count() == 5 and os.path.isdir(path)
    assert not os.path.exists(path) and kept.count() == 3


def test_a_cluster_needs_a_shared_folder():
    class Conf(dict):
        def get(self, key, default=None):
            return super().get(key, default)

    class Session:
        conf = Conf({"spark.master": "spark://host:7077", "spark.sql.warehouse.dir": "file:/x"})
    with pytest.raises(RuntimeError):
        durable.shared_folder(Session)
    Session.conf["spark.checkpoint.dir"] = "hdfs://host/x/"
    assert durable.shared_folder(Session) == "hdfs://host/x"
