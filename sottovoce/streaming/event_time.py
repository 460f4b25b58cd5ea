"""Live state in event time (R3-R6, R10, E4-E9): rows wait until the watermark has passed them, then go through their state
machine in order, so that a stream gives what the finished table gives, however its rows were shuffled within the delay.

A row that comes later than the delay behind the newest one is late: Spark drops it before it gets here. Equal times go by
`order`; a row that repeats another's time and order replaces it. What waits (a map by time and order) and what a machine
keeps (a typed value) are state in RocksDB, so a query that starts again goes on where it stopped. A key without rows
for `idle` of event time is closed and leaves the state; a row after that begins anew. Keys must not be null."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sottovoce.operators.machines import Confirm, Escalation, Levels, Machine, Segments

DELAY, IDLE_MS = "30 seconds", 600_000


class InOrder(StatefulProcessor):
    """Runs a machine over a key's rows (us, order, values) as the watermark passes them."""

    def __init__(self, machine: Machine, names: list[str], idle_ms: int) -> None:
        self.machine, self.names, self.idle_ms = machine, names, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "us long, ord long", self.machine.takes)
        self.kept = handle.getValueState("kept", self.machine.kept)
        self.newest = handle.getValueState("newest", "us long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        times = set()
        for r in rows:
            self.waiting.updateValue((r["us"], r["ord"]), tuple(r)[-len(self.names) :])
            times.add(r["us"])
        for us in (min(times), max(times)):  # at the first rows can go on; later timers are set as they expire
            self.handle.registerTimer(us // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = [(tuple(at), tuple(v)) for at, v in self.waiting.iterator()]
        due = sorted(x for x in held if x[0][0] // 1000 < passed) if held else []
        out: list[tuple] = []
        if due:
            rows = [(*at, *values) for at, values in due]
            newest = rows[-1][0]
            if self.kept.exists() and rows[0][0] - self.newest.get()[0] > self.idle_ms * 1000:
                out += self.machine.end(tuple(self.kept.get()))
                self.kept.clear()
            kept = tuple(self.kept.get()) if self.kept.exists() else self.machine.begin(rows[0])
            begun = 0
            for k in range(1, len(rows) + 1):  # a pause closes the key here as it would if it came alone
                if k == len(rows) or rows[k][0] - rows[k - 1][0] > self.idle_ms * 1000:
                    kept, found = self.machine.feed(kept, rows[begun:k])
                    out += found
                    if k < len(rows):
                        out += self.machine.end(kept)
                        kept = self.machine.begin(rows[k])
                    begun = k
            self.kept.update(kept)
            self.newest.update((newest,))
            for at, _ in due:
                self.waiting.removeKey(at)
            self.handle.registerTimer(newest // 1000 + self.idle_ms + 1)
        elif self.kept.exists() and passed > self.newest.get()[0] // 1000 + self.idle_ms:
            out += self.machine.end(tuple(self.kept.get()))
            self.kept.clear()
            self.newest.clear()
        later = [at[0] for at, _ in held if at[0] // 1000 >= passed]
        if later:
            self.handle.registerTimer(min(later) // 1000 + 1)
        return iter([Row(**dict(zip(self.fields, (*key, *x), strict=True))) for x in out])

    def close(self) -> None:
        pass


def run(rows: DataFrame, machine: Machine, key: str, ts: str, order: str, values: list[str], delay: str = DELAY, idle_ms: int = IDLE_MS) -> DataFrame:
    """The machine's output, after the key, over a stream of rows (key, ts, order and the machine's values, in its order)."""
    use_rocksdb(rows.sparkSession)
    slim = rows.select(F.col(key), F.col(ts).alias("ts"), F.unix_micros(ts).alias("us"), F.col(order).cast("long").alias("ord"), *[F.col(v).alias(f"v{k}") for k, v in enumerate(values)])
    processor = InOrder(machine, values, idle_ms)
    processor.fields = [key, *[f.strip().split(" ")[0] for f in machine.gives.split(",")]]
    kind = dict(rows.dtypes)[key]
    return slim.withWatermark("ts", delay).groupBy(key).transformWithState(processor, f"`{key}` {kind}, {machine.gives}", "append", "EventTime")


def use_rocksdb(spark: SparkSession) -> None:
    """Typed state needs RocksDB's store, unless the session already names one of its kind."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(name, ""):
        spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def segments(chunks: DataFrame, key: str = "session_id", ts: str = "ts", delay: str = DELAY, idle_ms: int = IDLE_MS) -> DataFrame:
    """R3-R5 on a stream of (key, ts, chunk_idx, speech_prob)."""
    flagged = chunks.withColumn("_speech", F.coalesce(F.col("speech_prob") >= 0.5, F.lit(False)))
    return run(flagged, Segments(), key, ts, "chunk_idx", ["_speech"], delay, idle_ms)


def confirm(windows: DataFrame, key: str = "segment_id", ts: str = "ts", needed: int = 2, delay: str = DELAY, idle_ms: int = IDLE_MS) -> DataFrame:
    """R6 on a stream of (key, ts, window_idx, phrases)."""
    return run(windows, Confirm(needed), key, ts, "window_idx", ["phrases"], delay, idle_ms)


def escalation(verdicts: DataFrame, endpoint: str = "endpoint_id", ts: str = "ts", order: str = "id", seconds: int = 600, needed: int = 2, delay: str = DELAY, idle_ms: int = IDLE_MS) -> DataFrame:
    """R10 on a stream of (endpoint, ts, id, severity, categories)."""
    return run(verdicts, Escalation(seconds, needed), endpoint, ts, order, ["severity", "categories"], delay, max(idle_ms, seconds * 1000)).withColumnRenamed("order", order)


def environment(chunks: DataFrame, key: str = "session_id", ts: str = "ts", delay: str = DELAY, idle_ms: int = IDLE_MS) -> DataFrame:
    """E4-E9 on a stream of (key, ts, chunk_idx, level_db, speech_prob, and in_segment, if given)."""
    told = F.coalesce("in_segment", F.lit(False)) if "in_segment" in chunks.columns else F.lit(False)
    wide = chunks.withColumns({"_speech": F.coalesce(F.col("speech_prob") >= 0.5, F.lit(False)), "_in": told})
    return run(wide, Levels(), key, ts, "chunk_idx", ["level_db", "_speech", "_in"], delay, idle_ms)
