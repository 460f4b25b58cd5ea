"""Live monitoring (3.1): keyed stream state for segments, confirmation, environment and escalation, and the sinks after it.

Every state machine is the same code as in sottovoce.operators.state; here it is kept per key between micro-batches."""

from __future__ import annotations

import logging
import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sottovoce.operators import audit
from sottovoce.operators.environment import Environment
from sottovoce.operators.state import filled, segment

#: A key without input for so long leaves the state.
FORGET_MS = 3_600_000


class ConsentError(PermissionError):
    """Monitoring needs a recorded consent."""


def segments(chunks: DataFrame, key: str = "session_id", idle_ms: int = 60_000) -> DataFrame:
    """R3-R5 on a stream of (key, chunk_idx, speech_prob), in order within a key; missing chunks are silent; a key that falls
    idle is flushed. streaming.event_time puts rows in order first."""
    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, kept = pickle.loads(state.get[0]) if state.exists else (0, None)
        if state.hasTimedOut:
            found, kept = segment([], closing=True, state=kept)
            state.remove()
        else:
            rows = pd.concat(list(frames)).sort_values("chunk_idx")
            at = kept[0] if kept else int(rows["chunk_idx"].iloc[0])
            found, kept = segment(filled(rows["chunk_idx"].tolist(), (rows["speech_prob"] >= 0.5).tolist(), at), closing=False, state=kept or (at, -1, 0, 0, at))
            state.update((pickle.dumps((number + len(found), kept)),))
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([(k[0], number + i, a, b, n) for i, (a, b, n) in enumerate(found)], columns=[key, "segment_id", "first", "stop", "speech"])

    kind = dict(chunks.dtypes)[key]
    return chunks.select(key, "chunk_idx", "speech_prob").groupBy(key).applyInPandasWithState(
        run, f"{key} {kind}, segment_id long, first long, stop long, speech long", "s binary", "append", GroupStateTimeout.ProcessingTimeTimeout)


def environment(chunks: DataFrame, key: str = "session_id") -> DataFrame:
    """E4-E9 on a stream of (key, chunk_idx, level_db, speech_prob, and in_segment, if given). A session that is silent for FORGET_MS leaves the state."""
    chunks = chunks if "in_segment" in chunks.columns else chunks.withColumn("in_segment", F.lit(False))
    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        env = pickle.loads(state.get[0]) if state.exists else Environment()
        out = []
        for r in pd.concat(list(frames)).sort_values("chunk_idx").itertuples():
            out += [(k[0], int(r.chunk_idx), e["kind"], e["level_db"], e["baseline_db"], e["delta_db"]) for e in env.feed(r.level_db, r.speech_prob >= 0.5, bool(r.in_segment))]
        state.update((pickle.dumps(env),))
        state.setTimeoutDuration(FORGET_MS)
        yield pd.DataFrame(out, columns=[key, "chunk_idx", "kind", "level_db", "baseline_db", "delta_db"])

    kind = dict(chunks.dtypes)[key]
    return chunks.groupBy(key).applyInPandasWithState(
        run, f"{key} {kind}, chunk_idx long, kind string, level_db double, baseline_db double, delta_db double", "s binary", "append", GroupStateTimeout.ProcessingTimeTimeout)


def confirm(windows: DataFrame, key: str = "segment_id", needed: int = 2) -> DataFrame:
    """R6 on a stream of (key, window_idx, phrases): each phrase once a segment, when it stands in `needed` windows in a row."""
    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, streak, told = pickle.loads(state.get[0]) if state.exists else (None, {}, set())
        out = []
        for r in pd.concat(list(frames)).sort_values("window_idx").itertuples():
            before = streak if r.window_idx - 1 == last else {}  # a window that is missing breaks a streak
            last, streak = r.window_idx, {p: before.get(p, 0) + 1 for p in set(r.phrases)}
            for p in sorted(streak):
                if streak[p] >= needed and p not in told:
                    told.add(p)
                    out.append((k[0], p, int(r.window_idx), streak[p]))
        state.update((pickle.dumps((last, streak, told)),))
        state.setTimeoutDuration(FORGET_MS)
        yield pd.DataFrame(out, columns=[key, "phrase", "confirmed_at", "windows"])

    kind = dict(windows.dtypes)[key]
    return windows.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, phrase string, confirmed_at long, windows int", "s binary", "append", GroupStateTimeout.ProcessingTimeTimeout)


def escalation(verdicts: DataFrame, endpoint: str = "endpoint_id", seconds: int = 600, needed: int = 2) -> DataFrame:
    """R10 on a stream of (endpoint, ts, severity, categories): with repeats and the severity after escalation. Earlier entries older than `seconds` leave the state."""
    order = ["NONE", "LOW", "MEDIUM", "HIGH", "CRITICAL"]

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        past: list[tuple[float, str]] = pickle.loads(state.get[0]) if state.exists else []
        out = []
        for r in pd.concat(list(frames)).sort_values("ts").itertuples():
            now, repeats, after = r.ts.timestamp(), 0, r.severity
            if order.index(r.severity) >= 2 and len(r.categories):
                past = [p for p in past if now - p[0] <= seconds]
                repeats = max(sum(c == p[1] for p in past) for c in r.categories)
                past += [(now, c) for c in r.categories]
                after = order[min(order.index(r.severity) + (repeats >= needed), 4)]
            out.append((k[0], r.ts, r.severity, repeats, after))
        state.update((pickle.dumps(past),))
        state.setTimeoutDuration(max(FORGET_MS, seconds * 1000))
        yield pd.DataFrame(out, columns=[endpoint, "ts", "severity", "repeats", "escalated"])

    kind = dict(verdicts.dtypes)[endpoint]
    return verdicts.select(endpoint, "ts", "severity", "categories").groupBy(endpoint).applyInPandasWithState(
        run, f"{endpoint} {kind}, ts timestamp, severity string, repeats long, escalated string", "s binary", "append", GroupStateTimeout.ProcessingTimeTimeout)


def latest(events: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """The newest event of each key."""
    row = F.struct(*[c for c in events.columns if c != key])
    return events.groupBy(key).agg(F.max_by(row, ts).alias("e")).select(key, "e.*")


def start_monitoring(verdicts: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, consent: bool, record_consent: Callable[[str], None] = lambda action: None):
    """Starts the query that stores violations; without consent it refuses."""
    if not consent:
        raise ConsentError("monitoring needs consent")
    record_consent("start")
    stored = verdicts.where("verdict.is_violation")
    return stored.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).start()


def parquet_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A micro-batch becomes one folder named by its number, so a batch that is tried again replaces itself."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def _chain_before(spark: SparkSession, path: str, number: int) -> DataFrame | None:
    """The newest part of a chain that batches before `number` wrote; it holds the head."""
    try:
        chain = spark.read.parquet(path).where(F.col("batch") < number)
    except AnalysisException:
        return None  # nothing was written yet
    last = chain.agg(F.max("batch")).head()[0]
    return None if last is None else chain.where(F.col("batch") == last).drop("batch")


def audited_sink(path: str, kind: str, store_texts: bool = False) -> Callable[[DataFrame, int], None]:
    """Rows (id, ts, ...) of a micro-batch go to <path>/<kind>, without their texts unless those may be stored, and an
    entry for each to the chain of that table, <path>/<kind>_chain. Both are folders by batch, and a batch builds on the
    chain before it only, so one that is tried again replaces itself."""
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = audit.minimised(batch, store_texts, "transcript", "translation" if "translation" in batch.columns else None) if "transcript" in batch.columns else batch
        rows.write.mode("overwrite").parquet(f"{path}/{kind}/batch={number}")
        stored = spark.read.schema(rows.schema).parquet(f"{path}/{kind}/batch={number}")
        entries = stored.select(F.lit(kind).alias("kind"), F.col("id").alias("ref_id"), "ts", audit.payload_hash(stored, stored.columns).alias("payload_hash"), F.lit("").alias("detail"), F.col("id").alias("ord"))
        audit.append(_chain_before(spark, f"{path}/{kind}_chain", number), entries).write.mode("overwrite").parquet(f"{path}/{kind}_chain/batch={number}")

    return write


def environment_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Environment events with their levels to one place; that a session has no input is not stored."""
    def write(batch: DataFrame, number: int) -> None:
        rows = batch.where("kind <> 'input_silent'").withColumns({c: F.round(c, 1) for c in ("level_db", "baseline_db", "delta_db")})
        parquet_sink(path)(rows, number)

    return write


class Telemetry(StreamingQueryListener):
    """Hands the progress of streaming queries (observed counters included) to callbacks; one that fails doesn't disturb the others."""

    def __init__(self, *callbacks: Callable) -> None:
        self.callbacks = callbacks

    def _tell(self, told) -> None:
        for callback in self.callbacks:
            try:
                callback(told)
            except Exception:
                logging.getLogger(__name__).exception("a telemetry callback failed")

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        self._tell(event.progress)

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...
