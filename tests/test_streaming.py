"""Streams over an event log in several files, against their batch twins."""
import random

import pytest
from pyspark.sql import functions as F

from firmlens.operators import abuse, privacy, sequential, telemetry
from firmlens.plans import views
from firmlens.sources import sinks, stored_days
from firmlens.sources.captured import EVENT_SCHEMA
from firmlens.streaming import in_order, monitors

SF = "/root/testdata/sf0.001"


def split_log(spark, tmp_path):
    """The log in five files, each later than the one before."""
    folder = str(tmp_path / "log")
    for i in range(5):
        part = views.table(spark, SF, "events").orderBy("ts").filter(f"event_id div 200 = {i}")
        part.coalesce(1).write.mode("append").parquet(folder)
    return folder


def stream(spark, folder):
    s = monitors.event_stream(spark, folder, EVENT_SCHEMA, "*.parquet", files_per_batch=1)
    return s.selectExpr("event_id", "us", "at", "user_id AS client", "event_type AS endpoint", "value AS ms", "event_type = 'error' AS is_error")


DELAY = "14 days"
PROFILE = {"per_hour": 0.5, "endpoints": 3, "agents": 10, "errors": 0.1, "variance": 4e8}


def mixed_log(spark, tmp_path):
    """The log in six files that overlap: each row comes with its fifth of the month or the next one, files and rows in no order."""
    folder = str(tmp_path / "mixed")
    log = views.table(spark, SF, "events")
    fifth = F.floor((F.dayofmonth("ts") - 1) / 6.3) + F.pmod(F.xxhash64("event_id"), F.lit(2))
    for i in range(7):
        log.filter(fifth == i).orderBy(F.xxhash64("event_id")).coalesce(1).write.mode("append").parquet(folder)
    return folder


def mixed(spark, folder):
    s, closing = in_order.event_stream(spark, folder, EVENT_SCHEMA, "*.parquet", files_per_batch=1)
    return s.selectExpr("event_id", "us", "at", "user_id AS client", "event_type AS endpoint", "value AS ms", "event_type = 'error' AS is_error",
                        "CAST(regexp_extract(props, '([0-9]+)', 1) AS LONG) AS agent"), closing


def test_rows_in_any_order_equal_the_batch_twins(spark, tmp_path):
    folder = mixed_log(spark, tmp_path)
    log = views.events(spark, SF)
    requests, closing = mixed(spark, folder)
    got = {(r["event_id"], r["allowed"]) for r in in_order.finished(monitors.rate_limits(requests, ["client"], "client long", 2, 86400, DELAY), closing).collect()}
    assert got == {(r["event_id"], r["allowed"]) for r in abuse.sliding_limit(log.select("event_id", "client", "us"), ["client"], 2, 86400).collect()}
    requests, closing = mixed(spark, folder)
    sent = in_order.finished(monitors.alert_cooldown(in_order.where(requests, F.col("ms") > 30), ["endpoint"], "endpoint string", 3600, DELAY), closing)
    twin = telemetry.emitted_alerts(log.filter("ms > 30").select("event_id", "endpoint", "us"), ["endpoint"], 3600)
    assert {r["event_id"] for r in sent.collect()} == {r["event_id"] for r in twin.collect()}


def test_chain_and_scores_in_any_order(spark, tmp_path):
    folder = mixed_log(spark, tmp_path)
    scored = abuse.running_scores(views.events(spark, SF), ["client"], PROFILE)
    requests, closing = mixed(spark, folder)
    got = in_order.finished(monitors.abuse_profiles(requests, "client", "client long", PROFILE, delay=DELAY), closing)
    want = {r["event_id"]: round(r["score"], 9) for r in scored.collect()}
    assert {r["event_id"]: round(r["score"], 9) for r in got.collect()} == want and len(set(want.values())) > 3
    requests, closing = mixed(spark, folder)
    got = in_order.finished(monitors.rule_chain(requests, ["client"], "client long", RULES, 7200, PROFILE, DELAY), closing)
    want = abuse.rule_chain(scored.drop("agent", "is_error", "ms"), ["client"], RULES, 7200)
    verdicts = lambda df: {(r["event_id"], r["rule"], r["reason"], r["action"]) for r in df.collect()}
    assert verdicts(got) == verdicts(want)


def test_rows_are_released_before_the_end(spark, tmp_path):
    folder = mixed_log(spark, tmp_path)
    requests, closing = mixed(spark, folder)
    out = monitors.rate_limits(requests, ["client"], "client long", 2, 86400, DELAY)
    spark.conf.set(in_order.PROVIDER, in_order.ROCKS_DB)
    out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "p")).trigger(availableNow=True).start(str(tmp_path / "r")).awaitTermination()
    spark.conf.unset(in_order.PROVIDER)
    assert 0 < spark.read.parquet(str(tmp_path / "r")).count() < views.events(spark, SF).count()


def test_running_scores_of_one_busy_client(spark):
    """One client holds the whole log: native running totals against the scan of the stream."""
    pick = random.Random(2)
    t, rows = 0, []
    for k in range(2600):
        t += pick.choice([1, 1_000_000, 60_000_000, 60_000_000, 30 * 3_600_000_000 if pick.random() < 0.02 else 5])
        rows.append((k, t, None if k % 7 == 0 else "one", pick.choice("abcdef") if k % 11 else None, pick.randint(0, 12), pick.random() < 0.4))
    df = spark.createDataFrame([r[:2] + ("one",) + r[3:] for r in rows], "event_id long, us long, client string, endpoint string, agent int, is_error boolean")
    limits = {"per_hour": 50, "endpoints": 4, "agents": 9, "errors": 0.4, "variance": 900.0}
    _, want = sequential.profile_scan(limits, 24 * abuse.HOUR)(None, *([r[i] for r in rows] for i in (1, 3, 4, 5)))
    got = {r["event_id"]: r["score"] for r in abuse.running_scores(df, ["client"], limits).collect()}
    assert [round(got[k], 9) for k in range(2600)] == [round(x, 9) for x in want["score"]] and len(set(want["score"])) > 5


def test_running_scores_shuffle_the_log_twice(spark):
    """Two shuffles of the log and one of the few states that pass from chunk to chunk; null clients are one client, requests without time stand alone."""
    hour, limits = abuse.HOUR, {"per_hour": 0.9, "endpoints": 2, "agents": 2, "errors": 0.3, "variance": 1.0}
    rows = [(k, k * 20 * hour, None, "abcd"[k // 9 % 4], k // 5 % 4, k % 3 == 0) for k in range(60)] + [(100 + k, k * 30 * hour, "x", "a", 1, None) for k in range(20)]
    rows += [(200, None, "x", "a", None, True), (201, None, None, None, 1, False)]
    df = spark.createDataFrame(rows, "event_id long, us long, client string, endpoint string, agent int, is_error boolean")
    out = abuse.running_scores(df, ["client"], limits)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 3
    got = {r["event_id"]: r["score"] for r in out.collect()}
    scan = sequential.profile_scan(limits, 24 * hour)
    for part in (rows[:60], rows[60:80]):
        _, want = scan(None, *([r[i] for r in part] for i in (1, 3, 4, 5)))
        assert [round(got[r[0]], 9) for r in part] == [round(x, 9) for x in want["score"]]
    assert len({got[k] for k in range(60)}) > 2 and got[200] == 0.55 and got[201] == 0.3


class Kept:
    """Value or map state of one key, in memory."""
    def __init__(self):
        self.map, self.value = {}, None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def updateValue(self, key, value):
        self.map[key] = value

    def getValue(self, key):
        return self.map[key]

    def removeKey(self, key):
        del self.map[key]


class Handle:
    def __init__(self):
        self.timers = set()

    def getMapState(self, *_):
        return Kept()

    getValueState = getMapState

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.discard(ms)


class Clock:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def test_a_key_with_most_of_the_log_waits_in_pieces(spark, monkeypatch):
    """Rows of one key in any order are sorted and judged a part at a time; what is not final yet waits on."""
    for name, value in (("SORTED", 100), ("PIECE", 10), ("TOGETHER", 4)):
        monkeypatch.setattr(in_order, name, value)
    pick, sizes, seen = random.Random(5), [], []

    def step(state, rows):
        sizes.append(len(rows))
        return (state or 0) + len(rows), rows.assign(before=state or 0)
    rule = in_order.InOrder(["key"], "us long, event_id long, note string", step, None)
    rule.init(handle := Handle())
    rows = [(pick.randint(0, 2_000_000), k, pick.choice(["a", None])) for k in range(3000)] + [(in_order.CLOSING_US, -1, None)]
    for mark in (-1, 900, 900, 5000):  # no watermark yet, one amid the log, again with rows that come after it, and the end
        if mark in (-1, 900):
            new = [r for k, r in enumerate(rows) if k % 2 == (mark > 0) and (mark < 0 or r[0] > 900_000)]
            frames = [new[a:a + 70] for a in range(0, len(new), 70)] if not (mark > 0 and handle.timers == set()) else []
            if mark < 0 or not seen:
                list(rule.handleInputRows(("one",), (sequential.pd.DataFrame(f, columns=["us", "event_id", "note"]) for f in frames), Clock(max(mark, 0))))
        due = {t for t in handle.timers if t <= mark}
        assert len(handle.timers) <= 1
        handle.timers -= due
        if due:
            seen += [tuple(r) for f in rule.handleExpiredTimer(("one",), Clock(mark), None) for r in f.itertuples(index=False, name=None)]
    want = sorted(r for k, r in enumerate(rows[:-1]) if k % 2 == 0 or r[0] > 900_000)
    assert [r[:3] for r in seen] == [(a, b, c) for a, b, c in want] and [r[3] for r in seen] == ["one"] * len(want)
    assert max(sizes) < 500 and sum(sizes) == len(want) and not rule.waiting.map and not rule.known.exists()
    assert rule.rule.get() == (str(len(want)), want[-1][0])


def test_histograms_count_a_row_once(spark, tmp_path):
    """The stream keeps one cell for a row, not one for each window it lies in; the windows are the same."""
    folder = split_log(spark, tmp_path)
    cells = monitors.finished_windows(monitors.value_histograms(stream(spark, folder), ["endpoint"], "ms", "1 hour", delay=DELAY), ["endpoint", "cell"], on_disk=True)
    log = views.events(spark, SF).select("endpoint", "us", "ms").collect()
    assert cells.agg(F.sum("n")).first()[0] == len(log)
    extra = spark.createDataFrame([(None, None, h * abuse.HOUR, 1, None) for h in (1, 2, 9)] + [(None, 300, 2 * abuse.HOUR, 40, 120.0), (None, 900, 9 * abuse.HOUR, 1, 9.0)],
                                  "endpoint string, cell long, window_us long, n long, total double")
    windows = {}
    for endpoint, us, cell, n, value in [(r["endpoint"], r["us"], round(r["ms"] / 0.01), 1, r["ms"]) for r in log] + [(r["endpoint"], r["window_us"], r["cell"], r["n"], r["total"]) for r in extra.collect()]:
        for i in range(6):
            windows.setdefault((endpoint, us // abuse.HOUR - i), []).append((cell, n, value))
    got = {(r["endpoint"], r["window_us"] // abuse.HOUR): r for r in monitors.levels_of(cells.unionByName(extra), ["endpoint"], 6 * abuse.HOUR, abuse.HOUR, 60.0, 120.0).collect()}
    assert got.keys() == windows.keys()
    for at, parts in windows.items():
        many = sorted(((c, n) for c, n, _ in parts), key=lambda x: -1 if x[0] is None else x[0])
        every = [c for c, n in many for _ in range(n)]
        later = [c for c in every[int(len(every) * 0.95):] if c is not None]
        assert got[at]["n"] == len(every) and (got[at]["p95"] is None) == (not later)
        assert not later or abs(got[at]["p95"] - later[0] * 0.01) < 1e-9
        total = [v for *_, v in parts if v is not None]
        assert (got[at]["mean"] is None and not total) or abs(got[at]["mean"] - sum(total) / len(every)) < 1e-6


def test_chunks_are_cut_at_pauses(spark):
    """A log with pauses takes one round, whatever its length; a stretch without them is handed on chunk by chunk."""
    rows = [(k, "x", 1000 * (k // 3) + k % 3) for k in range(300)] + [(1000 + k, "y", 7 * k) for k in range(900)]
    df = spark.createDataFrame(rows, "event_id long, key string, us long").withColumn("chunk", F.floor(F.col("us") / 1000).cast("long"))
    got = sequential.chunked_scan(df, ["key"], "chunk", ["us", "event_id"], "us", sequential.window_limit_scan(100, 2), "allowed boolean, remaining long").collect()
    for key in "xy":
        mine = sorted((r["us"], r["event_id"], r["allowed"], r["remaining"]) for r in got if r["key"] == key)
        _, want = sequential.window_limit_scan(100, 2)(None, [m[0] for m in mine])
        assert [m[2] for m in mine] == want["allowed"] and [m[3] for m in mine] == want["remaining"]


def test_replays_and_routing(spark, tmp_path):
    folder = split_log(spark, tmp_path)
    s = stream(spark, folder)
    assert monitors.finished(monitors.without_replays(s.unionByName(s))).count() == views.events(spark, SF).count()
    raw = monitors.event_stream(spark, folder, EVENT_SCHEMA, "*.parquet", files_per_batch=2).drop("us", "at")
    sinks.route_stream(raw, str(tmp_path / "routed"), str(tmp_path / "progress")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "routed")).filter("kind = 'all'").count() == views.events(spark, SF).count()


RULES = [("all", 2, 86400, None, None, None, 9), ("searches", 1, 43200, ["view", "err"], None, None, 1)]


def test_rule_chain_over_chunks(spark):
    log = views.events(spark, SF).selectExpr("event_id", "us", "client", "endpoint", "client % 11 / 10D AS score")
    verdicts = lambda df: {(r["event_id"], r["rule"], r["reason"], r["action"]) for r in df.collect()}
    want = verdicts(abuse.rule_chain(log, ["client"], RULES, 7200))
    assert {v[1] for v in want} == {None, "all", "searches"} and {v[2] for v in want} == {None, "client_blocked", "rate_limit_exceeded"}
    assert verdicts(abuse.rule_chain(log, ["client"], RULES, 7200, chunk_us=86_400_000_000)) == want


def test_rule_chain_quarters_and_blocks():
    scan = sequential.rule_chain_scan([(4, 100), (8, 100)], 50)
    masks, calm, bad = [3] * 6, [0.0] * 6, [0.95] * 6
    assert scan(None, list(range(6)), masks, calm)[1]["denied_by"] == [-1, -1, -1, -1, 0, 0]
    state, out = scan(None, list(range(6)), masks, bad)
    assert out == {"denied_by": [-1, 0, 0, 0, 0, 0], "in_block": [False, False, True, True, True, True]}
    assert scan(state, [54, 106], [2, 2], [0.0, 0.0])[1] == {"denied_by": [1, -1], "in_block": [True, False]}
    assert scan(None, [0, 1], [0, 0], [1.0, 1.0])[1]["denied_by"] == [-1, -1]


def test_open_windows_are_returned(spark, tmp_path):
    folder = split_log(spark, tmp_path)
    got = monitors.finished_windows(monitors.rollups(stream(spark, folder), ["endpoint"], "ms", "7 days"), ["endpoint"])
    assert sum(r["n"] for r in got.collect()) == views.events(spark, SF).count()
    assert monitors.finished_windows(monitors.rollups(stream(spark, folder).filter("false"), ["endpoint"], "ms"), ["endpoint"]).count() == 0


def test_a_late_row_joins_its_day(spark, tmp_path):
    folder = str(tmp_path / "routed")
    log = views.logged(spark, SF)
    sinks.route_events(log.filter("event_id % 50 <> 7"), folder)
    late = log.filter("event_id % 50 = 7")
    sinks.route_events(late, folder)
    sinks.route_events(late, folder)  # a re-run changes nothing
    sinks.route_events(late.limit(1).withColumn("value", F.lit(-1.0)), folder)  # a corrected row replaces the stored one
    rows = spark.read.parquet(folder).filter("kind = 'all'")
    assert sorted(r[0] for r in rows.select("event_id").collect()) == sorted(r[0] for r in log.select("event_id").collect())
    assert rows.filter("value = -1").count() == 1


def test_alerts_are_delivered_once(spark, tmp_path):
    sent = []
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "event_id long, metric string")
    for number in (0, 1, 1, 0):  # both micro-batches are replayed
        stored_days.delivered(rows, number, str(tmp_path / "d"), lambda df, n: sent.append((n, df.count())))
    assert sent == [(0, 2), (1, 2)]

    def fails(df, n):
        raise OSError("no connection")
    with pytest.raises(OSError):
        stored_days.delivered(rows, 2, str(tmp_path / "d"), fails)
    stored_days.delivered(rows, 2, str(tmp_path / "d"), lambda df, n: sent.append((n, df.count())))
    assert sent[-1] == (2, 2)


def test_limits_are_read_anew_for_every_batch(spark, tmp_path):
    folder, limits, sent = str(tmp_path / "alerts"), iter([10.0, 1000.0, 1000.0]), []
    for i in range(2):
        part = views.table(spark, SF, "events").orderBy("ts").filter(f"event_id div 500 = {i}")
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    log = monitors.event_stream(spark, str(tmp_path / "log"), EVENT_SCHEMA, "*.parquet", files_per_batch=1)
    samples = log.select("event_id", "ts", F.col("event_type").alias("metric"), "value")
    monitors.threshold_alerts(samples, lambda: spark.createDataFrame([("view", (x := next(limits)), x * 5)], "metric string, warning double, critical double"), folder)
    got = monitors.sent_alerts(spark, folder, 3600, lambda df, n: sent.append(df.count()))
    seen = views.events(spark, SF).selectExpr("event_id", "us", "endpoint AS metric", "ms AS value").filter("metric = 'view' and event_id < 500 and value >= 10")
    graded = seen.withColumn("severity", F.expr("CASE WHEN value >= 50 THEN 'critical' ELSE 'warning' END"))
    want = {r["event_id"] for r in telemetry.emitted_alerts(graded, ["metric", "severity"], 3600).collect()}
    assert {r["event_id"] for r in got.collect()} == want and sum(sent) == len(want) > 3


def test_sweep_over_many_batches(spark, tmp_path):
    day = 86_400_000_000
    policies = spark.createDataFrame(privacy.RETENTION, privacy.RETENTION_DDL)
    rows = [(k, 100 + k, ["technical_logs", "personal_identifiable", "other"][k % 3], k * 10 * day) for k in range(60)]
    for i in range(3):
        spark.createDataFrame([r for r in rows if r[0] % 3 == i] + rows[:2], "record_id long, subject_id long, category string, created_us long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    folder = str(tmp_path / "store")

    def sweep(as_of):
        s = spark.readStream.schema("record_id long, subject_id long, category string, created_us long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        monitors.retention_sweeper(s, policies, folder, as_of).awaitTermination()
        return {r["record_id"]: r["swept_us"] for r in spark.read.parquet(f"{folder}/records").collect()}
    keep = {"technical_logs": 90, "personal_identifiable": 365, "other": 30}
    got = sweep(500 * day)
    assert {k: v is not None for k, v in got.items()} == {k: t + keep[c] * day < 500 * day for k, _, c, t in rows}
    assert {r["record_id"] for r in spark.read.parquet(f"{folder}/archive").collect()} == {k for k, _, c, t in rows if c == "personal_identifiable" and t + 365 * day < 500 * day}
    assert spark.read.parquet(f"{folder}/records").filter("swept_us is not null and (subject_id is not null or category is not null or signature is null)").count() == 0
