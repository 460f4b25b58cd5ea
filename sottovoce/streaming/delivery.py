"""The outbox as a sink (O4-O8, S12): events of each micro-batch are delivered by the executors, in order for each endpoint.

Events and attempts are tables, a folder for each micro-batch. A batch first stores its events; then everything that is due
by the attempts of the batches before it goes out, and the attempts are stored, which Spark commits as a whole. A batch that
is tried again finds the same rows due, sends them under the same idempotency keys, and replaces its own attempts; so an
event may reach a receiver twice under one key, but none is lost. Attempts never pass through the driver (a stream writer's
commit messages would). An endpoint's events go out one after the other, oldest first, and stop at its first failure;
endpoints don't wait for each other."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sottovoce.operators import outbox

Sender = Callable[[str, str], None]
_ATTEMPT = "id long, at timestamp, ok boolean, error string"


def deliver(due: DataFrame, sender: Callable[[], Sender], now: dt.datetime, endpoint: str = "endpoint_id") -> DataFrame:
    """Attempts (id, at, ok, error) at rows (id, endpoint, event_json). sender() is called once a task and gives a function
    of an idempotency key and a body that raises where delivery fails. Reading the result sends: write it, once."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        send, stopped, last = sender(), False, object()
        for frame in frames:
            out = []
            for id_, to, body in zip(frame["id"], frame["to"], frame["event_json"], strict=True):
                if to != last:
                    last, stopped = to, False
                if stopped:
                    continue
                try:
                    send(str(id_), body)
                    out.append((id_, now, True, None))
                except Exception as e:  # noqa: BLE001 - any failure of the receiver is recorded and holds its endpoint
                    out.append((id_, now, False, str(e)[:300]))
                    stopped = True
            yield pd.DataFrame(out, columns=["id", "at", "ok", "error"])

    rows = due.select("id", F.coalesce(F.col(endpoint).cast("string"), F.lit("")).alias("to"), "event_json")
    return rows.repartition("to").sortWithinPartitions("to", "id").mapInPandas(run, _ATTEMPT)


def _before(spark: SparkSession, path: str, number: int, schema: str) -> DataFrame:
    try:
        return spark.read.schema(f"{schema}, batch int").parquet(path).where(F.col("batch") < number).drop("batch")
    except AnalysisException:
        return spark.createDataFrame([], schema)


def state(spark: SparkSession, path: str, until: int = 1 << 30) -> DataFrame:
    """The outbox (see outbox.current) that the batches before `until` left."""
    box = _before(spark, f"{path}/events", until, "id long, endpoint_id string, created timestamp, event_json string")
    return outbox.current(box, _before(spark, f"{path}/attempts", until, _ATTEMPT))


def sink(path: str, sender: Callable[[], Sender], clock: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.timezone.utc)) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: takes events (id, endpoint_id, created, event_json) and delivers what is due."""
    def write(batch: DataFrame, number: int) -> None:
        spark, now = batch.sparkSession, clock()
        rows = batch.select(F.col("id").cast("long").alias("id"), F.col("endpoint_id").cast("string").alias("endpoint_id"), "created", "event_json")
        rows.write.mode("overwrite").parquet(f"{path}/events/batch={number}")
        stored = _before(spark, f"{path}/events", number + 1, "id long, endpoint_id string, created timestamp, event_json string")
        now_is = outbox.current(stored, _before(spark, f"{path}/attempts", number, _ATTEMPT))
        due = now_is.where(F.col("delivered_at").isNull() & (F.col("next_attempt") <= F.lit(now)))
        deliver(due, sender, now).write.mode("overwrite").parquet(f"{path}/attempts/batch={number}")

    return write


def newest_rows(rows: DataFrame, key: list[str], ts: str, order: str, most: int) -> DataFrame:
    """The `most` newest rows of each key (of the whole table without one). Each task keeps its own newest before they meet."""
    from pyspark.sql import Window as W

    w = (W.partitionBy(*key) if key else W.partitionBy(F.lit(0))).orderBy(F.desc(ts), F.desc(order))
    return rows.withColumn("_newest", F.row_number().over(w)).where(F.col("_newest") <= most).drop("_newest")


def ring_sink(path: str, key: list[str], ts: str, order: str, most: int) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: keeps the `most` newest rows of each key. A batch builds on the ring that the batch before left, and
    writes its own, <path>/batch=<n>; so nothing but rings is read, and one that is tried again replaces itself."""
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            rings = spark.read.parquet(path)
            last = rings.where(F.col("batch") < number).agg(F.max("batch")).head()[0]
        except AnalysisException:
            last = None
        before = batch.limit(0) if last is None else spark.read.schema(batch.schema).parquet(f"{path}/batch={last}")
        newest_rows(before.unionByName(batch), key, ts, order, most).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
