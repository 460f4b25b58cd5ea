import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sottovoce.operators import state
from sottovoce.streaming import monitor


def test_segment_rules():
    silence, speech = [False], [True]
    assert state.segment(silence * 50)[0] == []
    assert state.segment(silence * 10 + speech * 10 + silence * 30)[0] == [(4, 26, 10)]  # six chunks before, six after
    assert state.segment(speech * 3 + silence * 30)[0] == []  # too short
    assert [n for _, _, n in state.segment(speech * 400)[0]] == [375, 25]
    assert state.segment(speech * 9)[0] == [(0, 9, 9)]
    assert state.segment(speech * 9, closing=False)[0] == []


def test_segment_state_goes_on():
    chunks = ([False] * 7 + [True] * 20 + [False] * 25) * 3 + [True] * 500
    whole, _ = state.segment(chunks)
    kept, out = None, []
    for i in range(0, len(chunks), 11):
        found, kept = state.segment(chunks[i : i + 11], closing=False, state=kept)
        out += found
    assert out + state.segment([], state=kept)[0] == whole


def test_confirm(spark):
    rows = [("s", "p", w) for w in (1, 3, 4, 5)] + [("s", "q", 1), ("s", "q", 3)]
    out = state.confirm(spark.createDataFrame(rows, "seg string, phrase string, window_idx int"), ["seg", "phrase"]).collect()
    assert [(r["phrase"], r["confirmed_at"]) for r in out] == [("p", 4)]


def _alerts():
    base = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    return [(i, "e", base + dt.timedelta(seconds=s), "MEDIUM", ["c"]) for i, s in enumerate((0, 100, 100, 650, 2000))]


def test_repeats_batch_equals_stream(spark, tmp_path):
    df = spark.createDataFrame(_alerts(), "id int, endpoint_id string, ts timestamp, severity string, categories array<string>")
    batch = state.repeats(df.withColumn("category", F.explode("categories")), "endpoint_id", "category", "ts", "id").orderBy("id")
    counts = [r["repeats"] for r in batch.collect()]
    assert counts == [0, 1, 2, 2, 0]
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = monitor.escalation(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("esc").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r["ts"], r["repeats"], r["escalated"]) for r in spark.table("esc").collect())
    assert sorted(r[1] for r in got) == sorted(counts) and [r[2] for r in got].count("HIGH") == 2


def test_segments_stream_equals_batch(spark, tmp_path):
    chunks = [("a", i, 0.9 if 10 <= i < 40 else 0.1) for i in range(80)] + [("b", i, 0.1) for i in range(40)]
    df = spark.createDataFrame(chunks, "session_id string, chunk_idx bigint, speech_prob double")
    batch = [tuple(r) for r in state.segments(df).collect()]
    assert batch == [("a", 0, 4, 46, 30)]
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = monitor.segments(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("seg").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [tuple(r) for r in spark.table("seg").collect()] == batch


def test_environment():
    env = state.Environment()
    events = [e["kind"] for _ in range(300) for e in env.feed(-90, False)]
    assert events == ["input_silent"]
    env = state.Environment()
    levels = [(-60, False)] * 50 + [(-20, False)] + [(-60, False)] * 20
    assert [e["kind"] for x in levels for e in env.feed(*x)] == ["sudden_sound"]
    env = state.Environment()
    levels = [(-60, False)] * 50 + [(-20, False)] + [(-30, True)] * 20
    assert [e["kind"] for x in levels for e in env.feed(*x)] == []
    env = state.Environment()
    levels = [(-60, False)] * 20 + [(-40, True)] * 80 + [(-10, True)] * 30
    assert "raised_voice" in [e["kind"] for x in levels for e in env.feed(*x)]


def test_cooldown():
    assert state.cooled([0, 3, 5, 9, 10], 5) == [True, False, True, False, True]


def test_muted_and_floor(spark):
    df = spark.createDataFrame([("a", i, -90.0 if 3 <= i < 9 else -50.0) for i in range(12)], "k string, i int, v double")
    assert [(r["first"], r["last"], r["n"]) for r in state.muted_runs(df, ["k"], "i", "v", chunks=5).collect()] == [(3, 8, 6)]
    floor = -50.0
    for i in range(1, 12):
        floor += 0.01 * ((-90.0 if 3 <= i < 9 else -50.0) - floor)
    assert state.noise_floor(df, ["k"], "i", "v").head()["floor"] == pytest.approx(floor)


def test_monitoring_needs_consent(spark):
    with pytest.raises(monitor.ConsentError):
        monitor.start_monitoring(spark.range(1), lambda df, n: None, "/tmp/x", consent=False)


def test_escalate(spark):
    rows = spark.createDataFrame(pd.DataFrame({"s": ["LOW", "MEDIUM", "HIGH", "CRITICAL", "MEDIUM"], "r": [5, 2, 2, 9, 1]}))
    assert [r["x"] for r in rows.select(state.escalate(F.col("s"), F.col("r")).alias("x")).collect()] == ["LOW", "HIGH", "CRITICAL", "CRITICAL", "MEDIUM"]


def test_spikes_and_floor_rest_inside_segments():
    def events(chunks):
        env = state.Environment()
        return [e["kind"] for c in chunks for e in env.feed(*c)], env

    quiet, loud = (-50, False, False), (-20, False, False)
    assert events([quiet] * 5 + [loud] + [quiet] * 20)[0] == ["sudden_sound"]
    assert events([quiet] * 5 + [loud, (-50, False, True)] + [quiet] * 20)[0] == []  # a segment cancels what is pending
    assert events([quiet] * 5 + [(-20, False, True)] + [quiet] * 20)[0] == []  # and none begins in one
    assert events([quiet] * 5 + [loud] * 9 + [quiet] * 20 + [loud] + [quiet] * 20)[0] == ["sudden_sound"]  # nor while it cools down
    assert events([quiet] * 5 + [(-40, False, True)] * 100)[1].floor == -50


def test_environment_takes_segments_from_a_column(spark):
    rows = [("s", i, -20.0 if i == 5 else -50.0, 0.0, i == 6) for i in range(30)]
    df = spark.createDataFrame(rows, "session_id string, chunk_idx long, level_db double, speech_prob double, in_segment boolean")
    assert state.environment(df).count() == 0 and state.environment(df.drop("in_segment")).count() == 1
