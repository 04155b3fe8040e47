"""Rules that need event-time order, on streams whose rows arrive in any order within the watermark's delay.

A row waits in its key's state until the watermark has passed its time; from then on nothing earlier
is accepted, so the waiting rows up to there are final. A timer releases them in order of time and id and
hands them to the rule, whose state is a value of its own. What the rule says does not depend on how rows
were dealt to micro-batches.

A key may hold most of a log: its rows are sorted a hundred thousand at a time and wait in small pieces,
each with its first and last time. Releasing reads the pieces by their first times, so the rows in memory
are those of the pieces that overlap, and hands rows on as soon as no later piece can hold an earlier one.

The end of a log has no later rows to move the watermark. ``finished`` therefore restarts the stream once
its input is used up, with one closing row whose time lies beyond all others; it belongs to no key.
"""
from __future__ import annotations

import json
import sys
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from firmlens.operators.durable import shared_folder
from firmlens.sources.stored_days import delivered

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CLOSING_US = 4_000_000_000_000_000  # in the year 2096
#: Rows of a key that are sorted together, rows of a piece, and pieces that are read together.
SORTED, PIECE, TOGETHER = 100_000, 2_000, 25


def event_stream(spark: SparkSession, folder: str, schema: str, files: str = "*", files_per_batch: int = 1000) -> tuple[DataFrame, str]:
    """Event log files as a stream with ``us`` and ``at`` (event time), and the folder for its closing row, empty as yet."""
    closing = f"{shared_folder(spark)}/closing-{uuid.uuid4().hex}"
    spark.createDataFrame([], schema).write.parquet(closing)

    def read(path: str, glob: str) -> DataFrame:
        reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", glob)
        return reader.option("recursiveFileLookup", True).parquet(path)

    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    both = read(folder, files).unionByName(read(closing, "*.parquet"))
    return both.withColumns({"us": us, "at": F.timestamp_micros(us)}), closing


def where(stream: DataFrame, condition: Column) -> DataFrame:
    """Rows that meet the condition, and the closing row."""
    return stream.filter(F.coalesce(condition, F.lit(False)) | F.col("event_id").isNull())


class InOrder(StatefulProcessor):
    """Holds rows back until they are final and runs ``step(state, rows) -> (state, rows)`` over them in order.

    ``state`` is None or a JSON-able value. With ``idle`` microseconds a key that stays silent so long loses it.
    """

    def __init__(self, keys: list[str], ddl: str, step: Callable, idle: int | None):
        self.keys, self.ddl, self.step, self.idle = keys, ddl, step, idle
        self.columns, kinds = zip(*(c.split() for c in ddl.split(", ")))
        self.casts = [{"long": int, "int": int, "double": float, "boolean": bool}.get(k, str) for k in kinds]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "piece long", "rows string")
        self.known = handle.getValueState("known", "pieces string, due long")
        self.rule = handle.getValueState("rule", "state string, last long")

    def _index(self) -> tuple[list, int | None]:
        """The waiting pieces as [first time, last time, number], and when the key's one timer goes off."""
        found = self.known.get() if self.known.exists() else None
        return ([], None) if found is None else (json.loads(found[0]), found[1])

    def _put(self, rows: list[tuple], pieces: list) -> None:
        """Adds sorted rows as pieces, each column's values together."""
        number = max((p[2] for p in pieces), default=-1)
        for a in range(0, len(rows), PIECE):
            part, number = rows[a:a + PIECE], number + 1
            self.waiting.updateValue((number,), (json.dumps(list(zip(*part))),))
            pieces.append([part[0][0], part[-1][0], number])

    def _wake(self, ms: int, pieces: list, due: int | None) -> None:
        """One timer per key: at the earliest time something is due."""
        if due is None or ms < due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(ms)
            due = ms
        self.known.update((json.dumps(pieces), due))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pieces, due = self._index()
        new, first = [], None
        for frame in rows:
            values = [[None if x is None or x != x else cast(x) for x in frame[c].tolist()] for c, cast in zip(self.columns, self.casts)]
            new += [row for row in zip(*values) if row[0] < CLOSING_US]
            if len(new) >= SORTED:
                first = min(first, self._sorted(new, pieces)) if first is not None else self._sorted(new, pieces)
                new = []
        if new:
            first = min(first, self._sorted(new, pieces)) if first is not None else self._sorted(new, pieces)
        if first is not None:
            self._wake(max(first // 1000, timerValues.getCurrentWatermarkInMs()) + 1, pieces, due)
        return iter([])

    def _sorted(self, rows: list[tuple], pieces: list) -> int:
        rows.sort(key=lambda r: (r[0], r[1]))
        self._put(rows, pieces)
        return rows[0][0]

    def _final(self, pieces: list, until: int) -> Iterator[list[tuple]]:
        """Rows up to ``until`` in order, in parts; pieces that were read go, what is later in them comes back as pieces."""
        ready = sorted(p for p in pieces if p[0] <= until)
        pieces[:] = [p for p in pieces if p[0] > until]
        pool: list[tuple] = []
        for k, (_, _, number) in enumerate(ready):
            pool += zip(*json.loads(self.waiting.getValue((number,))[0]))
            self.waiting.removeKey((number,))
            if k + 1 < len(ready) and (k + 1) % TOGETHER:
                continue
            pool.sort(key=lambda r: (r[0], r[1]))
            upto = bisect_left(pool, ready[k + 1][0], key=lambda r: r[0]) if k + 1 < len(ready) else bisect_right(pool, until, key=lambda r: r[0])
            if upto:
                yield pool[:upto]
                del pool[:upto]
        self._put(pool, pieces)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        pieces, _ = self._index()
        kept = self.rule.get() if self.rule.exists() else None
        state, last = None if kept is None or kept[0] is None else json.loads(kept[0]), None if kept is None else kept[1]
        judged = False
        for rows in self._final(pieces, mark * 1000):
            frame = pd.DataFrame(rows, columns=list(self.columns)).assign(**dict(zip(self.keys, key)))
            state, out = self.step(state, frame)
            last, judged = rows[-1][0], True
            yield out
        if judged:
            self.rule.update((None if state is None else json.dumps(state), last))
        wake = [min(p[0] for p in pieces) // 1000 + 1] if pieces else []
        if self.idle is not None and last is not None:
            gone = (last + self.idle) // 1000 + 1
            if gone <= mark:
                self.rule.clear()
            else:
                wake.append(gone)
        if wake:
            self._wake(max(min(wake), mark + 1), pieces, None)
        else:
            self.known.clear()

    def close(self) -> None:
        pass


def stateful(stream: DataFrame, keys: list[str], payload: str, fields: str, step: Callable, idle: int | None = None, delay: str = "1 hour") -> DataFrame:
    """Run ``step`` per key in event-time order; ``payload`` (DDL) lists what it reads besides keys, ``us`` and ``event_id``.

    Rows without time or id are not judged; rows later than ``delay`` are dropped, as everywhere in streams.
    """
    ddl = "us long, event_id long" + (f", {payload}" if payload else "")
    known = stream.filter((F.col("us") >= CLOSING_US) | (F.col("us").isNotNull() & F.col("event_id").isNotNull())).withColumn("event_id", F.coalesce("event_id", F.lit(-1)))
    slim = known.withWatermark("at", delay).select(*keys, *[c.split()[0] for c in ddl.split(", ")], "at")
    return slim.groupBy(*keys).transformWithStateInPandas(InOrder(keys, ddl, step, idle), fields, "Append", "EventTime")


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB."""
    provider = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS_DB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if provider is None else spark.conf.set(PROVIDER, provider)


def finished(stream: DataFrame, closing: str, send: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Run a stream over all input there is, then over its closing row, and read back what it wrote.

    Micro-batches are kept under their numbers, so a replay overwrites; ``send`` gets each once (``stored_days.delivered``).
    """
    spark: SparkSession = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    with state_on_disk(spark):
        for close in (False, True):
            if close:
                end = spark.read.parquet(closing).schema
                blank = spark.range(1).select(*[(F.expr(f"timestampadd(MICROSECOND, {CLOSING_US}, timestamp_ntz'1970-01-01 00:00:00')") if f.name == "ts" else F.lit(None))
                                                .cast(f.dataType).alias(f.name) for f in end])
                blank.write.mode("append").parquet(closing)
            run = (stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True)
                   .foreachBatch(lambda rows, number: delivered(rows, number, folder, send)).start())
            run.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(f"{folder}/rows")
