"""Order-dependent rules (cooldowns, rate limits, anchored counters) at scale.

Each key's log is cut into time chunks. Every chunk is scanned on its own, first as if nothing came
before it; its exit state, as it looks at the time of the next chunk's first row, becomes that chunk's
entry state. After a pause longer than the rule remembers, that state is empty, so the chunk was right
at once. Only chunks with another entry state than assumed are scanned again, until there are none:
the rounds follow the longest stretch without such a pause, not the length of the log. The first chunk
of a key is right after the first round, so the result equals a single scan of the whole log. Rows
stream through the scan in Arrow batches, so a chunk need not fit in memory.

Building the result runs jobs: one scan of the slim log, a small one per round, and further scans of
changed chunks only.
"""
from __future__ import annotations

import json
import sys
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmlens.operators.durable import stored
from firmlens.operators.ordered import join_null_safe

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def segments(frame: pd.DataFrame, ids: list[str]) -> list[tuple[int, int]]:
    """Start and end of each run of equal ids in a sorted frame."""
    change = np.zeros(len(frame), dtype=bool)
    for c in ids:
        v = frame[c].to_numpy()
        change[1:] |= v[1:] != v[:-1]
    starts = [0, *np.flatnonzero(change).tolist()]
    return list(zip(starts, [*starts[1:], len(frame)]))


def chunked_scan(df: DataFrame, keys: list[str], chunk: str, order: list[str], inputs: str | list[str],
                 scan: Callable, out_fields: str) -> DataFrame:
    """Run ``scan(state, *inputs) -> (state, {column: values})`` along each key.

    ``inputs`` names the columns whose values the scan is given (one list each), the time first.
    ``state`` is None or a JSON-able value; a scan may be called several times for one chunk, each
    time with the next rows. ``scan.settle(state, time)`` is what of a state still matters at a time,
    or None. Keys must not be null. Output: the input columns plus ``out_fields`` (a DDL list such
    as ``"allowed boolean"``).
    """
    ids = keys + [chunk]
    inputs = [inputs] if isinstance(inputs, str) else inputs
    settle = scan.settle
    types = dict(df.dtypes)
    id_ddl = ", ".join(f"{c} {types[c]}" for c in ids)
    full_ddl = ", ".join(f"{c} {t}" for c, t in df.dtypes) + ", " + out_fields
    columns = [c for c, _ in df.dtypes]

    def walk(batches, on_rows, on_end):
        at, state, first = None, None, None
        for frame in batches:
            if frame.empty:
                continue
            for a, b in segments(frame, ids):
                here = tuple(frame[c].iloc[a] for c in ids)
                values = [frame[c].to_numpy()[a:b].tolist() for c in inputs]
                if here != at:
                    if at is not None:
                        on_end(at, first, state)
                    start = frame["__entry"].iloc[a]
                    at, state, first = here, (json.loads(start) if isinstance(start, str) else None), values[0][0]
                state, new = scan(state, *values)
                on_rows(new)
            yield frame
        if at is not None:
            on_end(at, first, state)

    def exit_states(batches):
        found: list[tuple] = []
        names = [*ids, "__first", "__exit"]
        for _ in walk(batches, lambda new: None, lambda at, first, s: found.append((*at, first, None if s is None else json.dumps(s)))):
            if len(found) > 10000:
                yield pd.DataFrame(found, columns=names)
                found.clear()
        yield pd.DataFrame(found, columns=names)

    def verdicts(batches):
        parts: list[dict] = []
        for frame in walk(batches, parts.append, lambda at, first, s: None):
            new = {c: [x for p in parts for x in p[c]] for c in parts[0]}
            parts.clear()
            yield frame[columns].assign(**new)

    def settled(batches):
        """Entry states: the exit before, as it looks at the first row."""
        for frame in batches:
            before = [None if not isinstance(s, str) else settle(json.loads(s), t) for s, t in zip(frame["__before"], frame["__first"].tolist())]
            yield frame.drop(columns="__before").assign(__entry=[None if s is None else json.dumps(s) for s in before])

    def in_order(rows: DataFrame) -> DataFrame:
        return rows.repartition(*ids).sortWithinPartitions(*ids, *order)

    def exits_of(rows: DataFrame) -> DataFrame:
        return in_order(rows).mapInPandas(exit_states, f"{id_ddl}, __first long, __exit string")

    slim = df.select(*dict.fromkeys(ids + order + inputs))
    none = F.lit(None).cast("string")
    chunks = stored(exits_of(slim.withColumn("__entry", none)).withColumn("__used", none), "chunks")
    follow = Window.partitionBy(*keys).orderBy(chunk)
    while True:
        before = chunks.withColumn("__before", F.lag("__exit").over(follow))
        entered = before.mapInPandas(settled, f"{id_ddl}, __first long, __exit string, __used string, __entry string")
        changed = entered.filter(~F.col("__entry").eqNullSafe(F.col("__used"))).select(*ids, "__entry")
        if changed.isEmpty():
            break
        again = exits_of(join_null_safe(slim, changed, ids, "inner")).select(*ids, F.col("__exit").alias("__new"), F.lit(True).alias("__again"))
        chunks = stored(join_null_safe(entered, again, ids).select(
            *ids, "__first", F.when(F.col("__again"), F.col("__new")).otherwise(F.col("__exit")).alias("__exit"), F.col("__entry").alias("__used")), "chunks")
    entries = entered.filter("__entry is not null").select(*ids, "__entry")
    return in_order(join_null_safe(df, entries, ids)).mapInPandas(verdicts, full_ddl)


def joined_scan(df: DataFrame, keys: list[str], at: str, width: int, order: list[str], inputs: list[str], scan: Callable, out: str) -> DataFrame:
    """Adds ``out``, the numbers that ``scan(state, *inputs) -> (state, numbers)`` gives along each key.

    For scans whose state after a chunk follows from the state before it and the state of the chunk scanned alone:
    ``scan.join(before, rows, alone)``. The log is cut into chunks of ``width`` by its time ``at``, which must not be null;
    keys may be. Each chunk is scanned alone, the states that still matter at its end (``scan.settle``) are joined along
    the key, and each is sent to the next chunk as a row of its own. So rows are shuffled twice, in any log, and no job
    runs before. A pause longer than ``width`` must leave nothing that matters.
    """
    ids = [*keys, "__chunk"]
    rows = df.withColumn("__chunk", F.floor(F.col(at) / width).cast("long"))
    settle, join, columns = scan.settle, scan.join, df.columns

    def runs(batches):
        """Each batch with its runs of equal ids: ids, first row, end, and the state sent to the chunk, if that is the first row."""
        for batch in batches:
            here = list(zip(*(batch.column(c).to_pylist() for c in ids)))
            sent = batch.column("__entry").to_pylist() if "__entry" in batch.schema.names else [None] * len(here)
            cuts = [k for k in range(len(here)) if k == 0 or here[k] != here[k - 1]] + [len(here)]
            yield batch, [batch.column(c).to_pylist() for c in inputs], [(here[a], a, b, sent[a]) for a, b in zip(cuts, cuts[1:])]

    def states(batches):
        names, kinds, last, state, n = [*ids, "__rows", "__state"], None, None, None, 0

        def ended(found):
            left = settle(state, (last[-1] + 1) * width)
            if left is not None:
                found.append((*last, n, json.dumps(left)))
        for batch, values, parts in runs(batches):
            kinds, found = [*(batch.schema.field(c).type for c in ids), pa.int64(), pa.string()], []
            for here, a, b, _ in parts:
                if here != last:
                    if last is not None:
                        ended(found)
                    last, state, n = here, None, 0
                state, _ = scan(state, *(v[a:b] for v in values))
                n += b - a
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(kinds)], names=names)
        if last is not None:
            ended(found := [])
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(kinds)], names=names)

    def entries(batches):
        """What each chunk's successor starts from."""
        last, state = None, None
        for batch in batches:
            sent = []
            for here, n, alone in zip(zip(*(batch.column(c).to_pylist() for c in ids)), batch.column("__rows").to_pylist(), batch.column("__state").to_pylist()):
                follows = last is not None and last[:-1] == here[:-1] and last[-1] + 1 == here[-1]
                last, state = here, join(state, n, json.loads(alone)) if follows else json.loads(alone)
                sent.append(json.dumps(state))
            chunk = pa.array([None if c is None else c + 1 for c in batch.column("__chunk").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), chunk, pa.array(sent, pa.string())], names=[*ids, "__entry"])

    def numbers(batches):
        last, state = None, None
        for batch, values, parts in runs(batches):
            found = []
            for here, a, b, sent in parts:
                if here != last:
                    last, state = here, None
                if sent is not None:
                    a, state = a + 1, json.loads(sent)
                state, new = scan(state, *(v[a:b] for v in values))
                found += new
            kept = batch.filter(batch.column("__entry").is_null())
            yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in columns), pa.array(found, pa.float64())], names=[*columns, out])

    def typed(names, **more):
        return T.StructType([T.StructField(c, rows.schema[c].dataType) for c in names] + [T.StructField(c, t) for c, t in more.items()])

    slim = rows.select(*dict.fromkeys(ids + order + inputs)).repartition(*ids).sortWithinPartitions(*ids, *order)
    alone = slim.mapInArrow(states, typed(ids, __rows=T.LongType(), __state=T.StringType()))
    sent = alone.repartition(*keys).sortWithinPartitions(*ids).mapInArrow(entries, typed(ids, __entry=T.StringType()))
    both = rows.unionByName(sent, allowMissingColumns=True)
    dealt = both.repartition(*ids).sortWithinPartitions(*ids, F.col("__entry").isNull(), *order)
    return dealt.mapInArrow(numbers, typed(columns, **{out: T.DoubleType()}))


def settles(settle: Callable):
    """Names what of a scan's state still matters at a later time."""
    def named(scan):
        scan.settle = settle
        return scan
    return named


def cooldown_scan(wait: int):
    """Emit a row only if more than ``wait`` passed since the last emitted one."""
    @settles(lambda last, t: last if t - last <= wait else None)
    def scan(state, times):
        last, emitted = state, []
        for t in times:
            ok = last is None or t - last > wait
            emitted.append(ok)
            last = t if ok else last
        return last, {"emitted": emitted}
    return scan


def window_limit_scan(width: int, limit: int):
    """Sliding-window limiter in which only allowed requests count."""
    @settles(lambda kept, t: [x for x in kept if x >= t - width] or None)
    def scan(state, times):
        kept, allowed, remaining = list(state or []), [], []
        for t in times:
            while kept and kept[0] < t - width:
                kept.pop(0)
            ok = len(kept) < limit
            remaining.append(limit - len(kept) - 1 if ok else 0)
            allowed.append(ok)
            if ok:
                kept.append(t)
        return kept or None, {"allowed": allowed, "remaining": remaining}
    return scan


def rule_chain_scan(rules: list[tuple[int, int]], block: int):
    """Limiter rules (limit, width) asked in turn; the first denial ends the check.

    Bit i of a row's mask says that rule i covers it. Each rule counts the requests it let pass itself.
    A score above 0.8 quarters the limits; a denial at a score above 0.9 blocks the key for ``block``,
    and a blocked key is denied by the first rule that covers the request.
    """
    def later(state, t):
        kept = [[x for x in q if x >= t - width] for q, (_, width) in zip(state[0], rules)]
        until = state[1] if state[1] is not None and state[1] > t else None
        return [kept, until] if any(kept) or until is not None else None

    @settles(later)
    def scan(state, times, masks, scores):
        kept, until = state or ([[] for _ in rules], None)
        kept, denied_by, in_block = [list(q) for q in kept], [], []
        for t, mask, score in zip(times, masks, scores):
            blocked, denied = until is not None and t < until, -1
            for i, (limit, width) in enumerate(rules):
                if not mask >> i & 1:
                    continue
                queue = kept[i]
                while queue and queue[0] < t - width:
                    queue.pop(0)
                if blocked or len(queue) >= (max(1, limit // 4) if score > 0.8 else limit):
                    denied = i
                    break
                queue.append(t)
            if denied >= 0 and score > 0.9:
                until = t + block
            denied_by.append(denied)
            in_block.append(blocked and denied >= 0)
        if times:  # what no later request can see is no state
            kept = [[x for x in q if x >= times[-1] - width] for q, (_, width) in zip(kept, rules)]
            until = until if until is not None and until > times[-1] else None
        return ([kept, until] if any(kept) or until is not None else None), {"denied_by": denied_by, "in_block": in_block}
    return scan


def profile_scan(limits: dict, idle: int):
    """Suspicion score after each request, from what the client did up to and with it; silence beyond ``idle`` starts afresh.

    The state holds counts, first and last time, the last eleven gaps, and of endpoints and agents as many as
    still matter: once there are more than the limit, more of them change nothing.
    """
    def scan(state, times, endpoints, agents, errors):
        n, wrong, first, last, seen, used, gaps = state or (0, 0, 0, 0, [], [], [])
        seen, used, gaps, scores = set(seen), set(used), list(gaps), []
        for t, endpoint, agent, bad in zip(times, endpoints, agents, errors):
            if n and t - last > idle:
                n, wrong, seen, used, gaps = 0, 0, set(), set(), []
            if n:
                gaps = [*gaps, (t - last) / 1_000_000][-11:]
            else:
                first = t
            n, wrong, last = n + 1, wrong + bool(bad), t
            if len(seen) <= limits["endpoints"] and endpoint is not None:
                seen.add(endpoint)
            if len(used) <= limits["agents"] and agent is not None:
                used.add(agent)
            recent = gaps[-10:]
            mean = sum(recent) / len(recent) if recent else 0.0
            even = len(gaps) > 10 and sum((g - mean) ** 2 for g in recent) / len(recent) < limits["variance"]
            score = (0.3 * (n / max((last - first) / 3_600_000_000, 0.1) > limits["per_hour"]) + 0.2 * (len(seen) > limits["endpoints"])
                     + 0.15 * (len(used) > limits["agents"]) + 0.25 * (wrong / n > limits["errors"]) + 0.1 * even)
            scores.append(min(score, 1.0))
        return [n, wrong, first, last, sorted(seen), sorted(used), gaps], {"score": scores}
    return scan


def visit_scan(limits: dict, idle: int):
    """The scores of ``profile_scan`` for ``joined_scan``, whose inputs are time, id, endpoint, agent and error.

    Of endpoints and agents the state holds how many rows each came with first: a row that comes twice with the same time
    and id counts twice. Once there are more than the limit, more of them change nothing.
    """
    def settle(state, t):
        return state if t - state[3] <= idle else None

    def join(before, rows, alone):
        n, wrong, first, last, seen, used, gaps, _, _ = alone
        if n != rows or first - before[3] > idle:  # it does not go back to the chunk's first row, or that began afresh
            return alone
        merge = lambda old, new, limit: sorted(({**dict(new), **dict(old)}).items(), key=lambda x: str(x[0]))[:limit + 1]
        return [before[0] + n, before[1] + wrong, before[2], last, merge(before[4], seen, limits["endpoints"]), merge(before[5], used, limits["agents"]),
                [*before[6], (first - before[3]) / 1_000_000, *gaps][-11:], None, []]

    def scan(state, times, numbers, endpoints, agents, errors):
        n, wrong, first, last, seen, used, gaps, at, fresh = state or (0, 0, 0, 0, [], [], [], None, [])
        seen, used, gaps, at, scores = dict(seen), dict(used), list(gaps), at and tuple(at), []
        fresh = {tuple(f) for f in fresh}

        def met(known, limit, kind, what):
            if what is None:
                return
            if what not in known:
                if len(known) <= limit:
                    known[what] = 1
                    fresh.add((kind, what))
            elif (kind, what) in fresh:
                known[what] += 1
        for t, number, endpoint, agent, bad in zip(times, numbers, endpoints, agents, errors):
            if n and t - last > idle:
                n, wrong, seen, used, gaps = 0, 0, {}, {}, []
            if at != (t, number):
                at = (t, number)
                fresh.clear()
            if n:
                gaps.append((t - last) / 1_000_000)
                if len(gaps) > 11:
                    del gaps[0]
            else:
                first = t
            n, wrong, last = n + 1, wrong + bool(bad), t
            met(seen, limits["endpoints"], "endpoint", endpoint)
            met(used, limits["agents"], "agent", agent)
            even = False
            if len(gaps) > 10:
                mean = sum(gaps[-10:]) / 10
                even = sum((g - mean) ** 2 for g in gaps[-10:]) / 10 < limits["variance"]
            score = (0.3 * (n / max((last - first) / 3_600_000_000, 0.1) > limits["per_hour"]) + 0.2 * (sum(seen.values()) > limits["endpoints"])
                     + 0.15 * (sum(used.values()) > limits["agents"]) + 0.25 * (wrong / n > limits["errors"]) + 0.1 * even)
            scores.append(min(score, 1.0))
        return [n, wrong, first, last, list(seen.items()), list(used.items()), gaps, at, list(fresh)], scores
    scan.settle, scan.join = settle, join
    return scan


def anchored_count_scan(width: int):
    """Counter that restarts at 1 once ``width`` passed since its last restart."""
    @settles(lambda state, t: state if t - state[0] < width else None)
    def scan(state, times):
        anchor, count = state or (None, 0)
        counts = []
        for t in times:
            count += 1
            if anchor is None or t - anchor >= width:
                anchor, count = t, 1
            counts.append(count)
        return (None if anchor is None else [anchor, count]), {"hour_count": counts}
    return scan
