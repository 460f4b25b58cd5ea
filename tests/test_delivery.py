import datetime as dt
import random

from pyspark.sql import functions as F

from sottovoce.streaming import delivery

T = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "id long, endpoint_id string, created timestamp, event_json string"


def receiver(folder):
    """Keeps a line for each delivery; fails for the keys that stand in `failing`."""
    def make():
        def send(key, body):
            if key in (folder / "failing").read_text().split():
                raise OSError("no answer " + "x" * 400)
            with open(folder / "got", "a") as f:
                f.write(f"{key} {body}\n")

        return send

    return make


def got(folder):
    return [line.split()[0] for line in (folder / "got").read_text().splitlines()] if (folder / "got").exists() else []


def test_an_outbox_with_a_failing_receiver_and_a_batch_tried_again(spark, tmp_path):
    now = [T]
    (tmp_path / "failing").write_text("3")
    write = delivery.sink(str(tmp_path / "box"), receiver(tmp_path), lambda: now[0])
    events = lambda *rows: spark.createDataFrame([(i, e, T, f"body{i}") for i, e in rows], SCHEMA)
    first = events((1, "a"), (3, "a"), (5, "a"), (2, "b"), (4, "b"), (6, None))
    write(first, 0)
    assert sorted(got(tmp_path)) == ["1", "2", "4", "6"]  # 5 waits behind 3; other endpoints don't
    state = {r["id"]: r for r in delivery.state(spark, str(tmp_path / "box")).collect()}
    assert state[3]["attempts"] == 1 and len(state[3]["last_error"]) == 300 and state[5]["attempts"] == 0 and state[1]["delivered_at"] is not None
    write(first, 0)  # the query stopped before it had noted the batch: the same rows under the same keys
    assert sorted(got(tmp_path)) == sorted(["1", "2", "4", "6"] * 2)
    assert {r["id"]: r["attempts"] for r in delivery.state(spark, str(tmp_path / "box")).collect()}[3] == 1
    (tmp_path / "failing").write_text("")
    now[0] = T + dt.timedelta(seconds=2)
    write(events((7, "a")), 1)  # 3 is not due yet
    assert got(tmp_path)[8:] == ["5", "7"]
    now[0] = T + dt.timedelta(seconds=5)
    write(events(), 2)
    assert got(tmp_path)[10:] == ["3"] and delivery.state(spark, str(tmp_path / "box")).where("delivered_at is null").count() == 0
    assert delivery.state(spark, str(tmp_path / "box"), until=1).where("delivered_at is null").count() == 2


def test_endpoints_keep_their_order(spark, tmp_path):
    (tmp_path / "failing").write_text("")
    rows = [(i, f"e{i % 7}", T, "b") for i in range(200)]
    random.Random(1).shuffle(rows)
    tries = delivery.deliver(spark.createDataFrame(rows, SCHEMA).repartition(5), receiver(tmp_path), T)
    tries.write.parquet(str(tmp_path / "tries"))
    order = list(map(int, got(tmp_path)))
    assert len(order) == 200 and all([i for i in order if i % 7 == e] == list(range(e, 200, 7)) for e in range(7))


def test_rings_of_a_stream_equal_the_table(spark, tmp_path):
    rng = random.Random(6)
    rows = [(k, rng.choice("abc"), T + dt.timedelta(seconds=rng.randrange(50))) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp")
    write, every = delivery.ring_sink(str(tmp_path / "ring"), ["k"], "ts", "id", 20), delivery.ring_sink(str(tmp_path / "all"), [], "ts", "id", 100)
    for n in (0, 1, 2, 2):
        for one in (write, every):
            one(df.where(F.col("id") % 3 == n), n)
    for path, key, most in (("ring", ["k"], 20), ("all", [], 100)):
        kept = sorted(map(tuple, spark.read.parquet(str(tmp_path / path / "batch=2")).collect()))
        assert kept == sorted(map(tuple, delivery.newest_rows(df, key, "ts", "id", most).collect()))
    by = {k: sorted(((t, i) for i, key, t in rows if key == k), reverse=True)[:20] for k in "abc"}
    assert sorted(i for ts in by.values() for _, i in ts) == sorted(r["id"] for r in delivery.newest_rows(df, ["k"], "ts", "id", 20).collect())
    assert "WindowGroupLimit" in delivery.newest_rows(df, ["k"], "ts", "id", 20)._jdf.queryExecution().toString()
