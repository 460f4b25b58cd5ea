import datetime as dt

from pyspark.sql import functions as F

from sottovoce.operators import audit, fusion, live
from sottovoce.sources.policy import Policy
from sottovoce.streaming import monitor

T = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def test_spotting_windows_grow_by_a_hop_of_speech(spark):
    rows = [("s", i, not 110 <= i < 130) for i in range(1, 200)] + [("short", i, True) for i in range(1, 78)]
    df = spark.createDataFrame(rows, "seg string, at int, speech boolean")
    out = live.spotting_windows(df, ["seg"], "at", F.col("speech")).orderBy("window_idx").collect()
    assert [(r["seg"], r["stop"] // 512) for r in out] == [("s", 79), ("s", 130), ("s", 162), ("s", 194)]
    assert out[0]["start"] == 79 * 512 - 40_000
    assert live.spotting_windows(df.where("false"), ["seg"], "at", F.col("speech")).count() == 0


def test_early_warning_takes_the_first_of_the_heaviest(spark):
    rows = [(1, [("a", "x", 0.3), ("b", "y", 0.7), ("c", "z", 0.7)]), (2, []), (3, None)]
    df = spark.createDataFrame(rows, "id int, matches array<struct<category:string,phrase:string,weight:double>>")
    assert [(r["id"], r["category"], r["estimated_severity"]) for r in live.early_warnings(df, Policy.example()).collect()] == [(1, "b", "HIGH")]


def test_a_second_hearing_keeps_what_the_first_pass_knew(spark):
    policy = Policy.example()
    kws = [("credentials", "private key", 0.45, "en", "kws", None, None, 2)]
    kind = "array<struct<category:string,phrase:string,weight:double,lang:string,match:string,similarity:double,pattern:string,windows:int>>"
    df = spark.createDataFrame([(1, "please send them a token", kws), (2, "please send them a token", []), (3, "an api key", []), (4, "please send them a token", [])], f"id int, text string, extras {kind}")
    first = fusion.score(df, policy, "id", "text", extras_col="extras", latin=True)
    second = spark.createDataFrame([(1, "an access token"), (2, "nothing"), (3, "an api key"), (4, " ")], "id int, text string")
    got = live.heard_again(first, second, policy, "id", latin=True).collect()
    assert [(r["id"], r["severity_before"], r["verdict"]["severity"]) for r in got] == [(1, "MEDIUM", "CRITICAL")]
    assert "kws" in got[0]["verdict"]["sources"] and got[0]["verdict"]["risk_factors"] == ["second opinion"]


def test_counters_and_the_event(spark):
    df = spark.createDataFrame([("transcript", T, 40, 1.5, 7, None), ("transcript", T + dt.timedelta(1), 30, 0.25, None, None), ("verified", T, None, None, None, True)], "type string, ts timestamp, latency_ms long, asr_seconds double, alert_id long, upgraded boolean")
    got = df.agg(*live.counters()).head()
    assert len(got) == 14 and (got["transcribed"], got["alerts"], got["verify_upgrades"], got["last_latency_ms"], got["max_latency_ms"], got["asr_seconds_total"]) == (2, 1, 1, 30, 40, 1.75)
    v = fusion.score(spark.createDataFrame([(1, "an api key")], "id int, text string"), Policy.example(), "id", "text", latin=True)
    event = v.select(live.transcript_event(F.col("verdict"), F.struct("text"), F.lit("stream"), F.lit(T), F.lit(5)).alias("e")).head()["e"]
    assert (event["type"], event["severity"], event["latency_ms"], event["alert_id"], event["transcription"]["text"]) == ("transcript", "CRITICAL", 5, None, "an api key")


def test_sinks_minimise_and_chain(spark, tmp_path):
    sink = monitor.audited_sink(str(tmp_path), "alert")
    rows = spark.createDataFrame([(i, T, f"t{i}", None) for i in range(1, 7)], "id bigint, ts timestamp, transcript string, translation string")
    sink(rows.where("id <= 3"), 0)
    sink(rows.where("false"), 1)
    for _ in range(2):  # a batch that is tried again
        sink(rows.where("id > 3"), 2)
    stored, chain = spark.read.parquet(f"{tmp_path}/alert").drop("batch"), spark.read.parquet(f"{tmp_path}/alert_chain").drop("batch")
    assert stored.where("transcript is not null").count() == 0 and stored.where("length(transcript_hash) = 16").count() == 6
    assert sorted(r["seq"] for r in chain.collect()) == [1, 2, 3, 4, 5, 6]
    assert audit.verify(chain, {"alert": (stored, stored.columns)}).count() == 0
    gone = audit.append(chain, audit.purge_entries(stored.where("id in (2, 5)"), 30, T, block=4))
    assert gone.count() == 2 and audit.verify(chain.unionByName(gone), {"alert": (stored.where("id not in (2, 5)"), stored.columns)}).count() == 0
    left, entry = audit.erase_all(stored, "op", "asked", T)
    assert left.count() == 0 and audit.verify(chain.unionByName(audit.append(chain, entry)), {"alert": (left, stored.columns)}).count() == 0
    env = spark.createDataFrame([("input_silent", -90.0, -50.0, 0.0), ("sudden_sound", -20.04, -50.06, 30.02)], "kind string, level_db double, baseline_db double, delta_db double")
    monitor.environment_sink(str(tmp_path / "env"))(env, 0)
    assert [tuple(r)[:4] for r in spark.read.parquet(str(tmp_path / "env")).collect()] == [("sudden_sound", -20.0, -50.1, 30.0)]


def test_a_failing_callback_does_not_disturb_others():
    class Event:
        progress = "p"

    told = []
    monitor.Telemetry(lambda p: 1 / 0, told.append).onQueryProgress(Event)
    assert told == ["p"]
