import datetime as dt
import json

from pyspark.sql import functions as F

from sottovoce.operators import audit, outbox, reporting

T = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
COLS = ["id", "text", "tags"]


def rows(spark, ids):
    return spark.createDataFrame([(i, T + dt.timedelta(minutes=i), f"t{i}", ["a", None] if i % 2 else None) for i in ids], "id bigint, ts timestamp, text string, tags array<string>")


def entries(df):
    return df.select(F.lit("alert").alias("kind"), F.col("id").alias("ref_id"), "ts", audit.payload_hash(df, COLS).alias("payload_hash"), F.lit("").alias("detail"), F.col("id").alias("ord"))


def problems(chain, alerts):
    return sorted((r["seq"], r["problem"]) for r in audit.verify(chain, {"alert": (alerts, COLS)}, slices=4).collect())


def test_chain(spark):
    alerts = rows(spark, range(1, 13))
    first = audit.append(None, entries(alerts.where("id <= 6")))
    chain = first.unionByName(audit.append(first, entries(alerts.where("id > 6")))).cache()
    assert chain.count() == 12 and problems(chain, alerts) == []
    edited = alerts.withColumn("text", F.when(F.col("id") == 4, "x").otherwise(F.col("text")))
    assert problems(chain, edited) == [(4, "edited row")]
    assert problems(chain, alerts.where("id <> 5")) == [(5, "missing row")]
    assert problems(chain.where("seq <> 7"), alerts) == [(8, "broken link"), (8, "missing entry")]
    rewritten = chain.withColumn("payload_hash", F.when(F.col("seq") == 3, F.sha2(F.lit("z"), 256)).otherwise(F.col("payload_hash")))
    assert (3, "rewritten entry") in problems(rewritten, alerts)
    lawful = chain.unionByName(audit.append(chain, audit.erase_entry(spark, "op", "asked", T, ids=[5])))
    assert problems(lawful, alerts.where("id <> 5")) == []
    every = chain.unionByName(audit.append(chain, audit.erase_entry(spark, "op", "all", T, all_until=12)))
    assert problems(every, alerts.where("id > 99")) == []


def test_retention_and_minimising(spark):
    kept, gone = audit.purge(rows(spark, [0, 1440 * 5]), T + dt.timedelta(days=6), 3)
    assert [r["id"] for r in kept.collect()] == [7200] and [r["id"] for r in gone.collect()] == [0]
    m = audit.minimised(rows(spark, [1]), False, "text", None).head()
    assert m["text"] is None and len(m["transcript_hash"]) == 16
    assert "transcript" not in audit.privacy_manifest(False, True)["sent"]


def test_outbox(spark):
    box = spark.createDataFrame([(i, T, "{}") for i in range(1, 4)], "id bigint, created timestamp, event_json string")
    none = spark.createDataFrame([], "id bigint, at timestamp, ok boolean, error string")
    sent = []

    def send(key, body):
        if key == "2":
            raise OSError("x" * 400)
        sent.append(key)

    tries = outbox.flush(outbox.current(box, none), send, T)
    assert sent == ["1"] and [t[2] for t in tries] == [True, False]  # it stops at the first failure
    state = outbox.current(box, spark.createDataFrame(tries, none.schema))
    s = outbox.stats(state).head()
    assert (s["pending"], s["delivered"], len(s["last_error"])) == (2, 1, 300)
    assert [r["id"] for r in outbox.due(state, T).collect()] == [3]
    assert [r["id"] for r in outbox.due(state, T + dt.timedelta(seconds=5)).collect()] == [2, 3]
    assert outbox.signature("k", "1", "b").startswith("sha256=") and json.loads(outbox.status_event("on"))["state"] == "on"


def test_reports(spark):
    df = spark.createDataFrame([(i, T + dt.timedelta(hours=i), "HIGH" if i % 2 else "LOW", None if i == 1 else "en", ["a", "b"] if i else [], 10 * i if i else None) for i in range(5)],
                               "id int, ts timestamp, severity string, language string, categories array<string>, latency_ms int")
    page, total = reporting.list_alerts(df, severity="high", limit=0, offset=-3)
    assert [r["id"] for r in page.collect()] == [3] and total.head()["total"] == 2
    assert {r["language"]: r["n"] for r in reporting.by_language(df).collect()} == {"en": 4, "unknown": 1}
    assert {r["category"]: r["n"] for r in reporting.by_category(df).collect()} == {"a": 4, "b": 4}
    s = reporting.stats(df, T + dt.timedelta(hours=26)).head()
    assert (s["total"], s["last_24h"], s["avg_latency_ms"], s["max_latency_ms"]) == (5, 3, 25, 40)
    assert reporting.newest(df, -1).count() == 0


def test_a_chain_for_each_key(spark):
    alerts = rows(spark, range(1, 13)).withColumn("endpoint", F.col("id") % 3)
    each = entries(alerts).withColumn("endpoint", F.col("ref_id") % 3)
    first = audit.append(None, each.where("ref_id <= 6"), ["endpoint"])
    chain = first.unionByName(audit.append(first, each.where("ref_id > 6"), ["endpoint"])).cache()
    alone = audit.append(None, entries(alerts.where("endpoint = 1")))
    assert sorted(r["row_hash"] for r in chain.where("endpoint = 1").collect()) == sorted(r["row_hash"] for r in alone.collect())
    check = lambda c, a: sorted((r["endpoint"], r["seq"], r["problem"]) for r in audit.verify(c, {"alert": (a, COLS)}, key=["endpoint"]).collect())
    assert chain.count() == 12 and check(chain, alerts) == []
    assert check(chain.where("endpoint <> 2 or seq <> 2"), alerts) == [(2, 3, "broken link"), (2, 3, "missing entry")]
    assert check(chain, alerts.where("id <> 5")) == [(2, 2, "missing row")]
