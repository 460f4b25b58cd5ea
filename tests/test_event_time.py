import datetime as dt
import math
import random

import pytest

from sottovoce.operators import state
from sottovoce.streaming import event_time

T = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    names = ("spark.sql.shuffle.partitions", "spark.sql.streaming.stateStore.providerClass")
    before = {n: spark.conf.get(n, None) for n in names}
    spark.conf.set(names[0], "2")
    yield
    for n, v in before.items():
        spark.conf.set(n, v) if v else spark.conf.unset(n)


def streamed(spark, tmp_path, name, make, rows, schema, files, beat, restart=True):
    """The rows of make(stream) over files of shuffled rows, read one a batch, with a stop in between; beat: a row of another key far on, which lets the watermark pass."""
    for k, some in enumerate([*files, [beat]]):
        spark.createDataFrame(some, schema).coalesce(1).write.parquet(str(tmp_path / "all" / f"{k:03}"))
    out = []
    for upto in (len(files) // 2, len(files) + 1) if restart else (len(files) + 1,):
        for k in range(upto):
            for f in sorted((tmp_path / "all" / f"{k:03}").glob("part-*.parquet")):
                to = tmp_path / "in" / f"{k:03}.parquet"
                to.parent.mkdir(exist_ok=True)
                if not to.exists():
                    to.write_bytes(f.read_bytes())
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
        q = make(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert q.awaitTermination(300)
    out = spark.read.parquet(str(tmp_path / "out"))
    return sorted((tuple(r) for r in out.collect()), key=repr)


def shuffled(rng, rows, n, seconds):
    """Rows in files by time, each moved by less than `seconds` of it."""
    late = sorted(rows, key=lambda r: (r[1] + dt.timedelta(seconds=rng.random() * seconds)))
    size = -(-len(late) // n)
    files = [late[k : k + size] for k in range(0, len(late), size)]
    for f in files:
        rng.shuffle(f)
    return files


def test_segments_equal_the_batch_when_shuffled_late_and_started_again(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for s, base in (("a", 0), ("b", 500), ("c", 7)):
        speech, probability = [], 0.1
        for _ in range(900):
            probability = (0.9 if probability < 0.5 else 0.1) if rng.random() < 0.04 else probability
            speech.append(probability)
        rows += [(s, T + dt.timedelta(milliseconds=32 * (base + k)), base + k, p) for k, p in enumerate(speech) if p > 0.5 or k in (0, 899) or rng.random() < 0.8]
    schema = "session_id string, ts timestamp, chunk_idx long, speech_prob double"
    want = sorted((tuple(r) for r in state.segments(spark.createDataFrame(rows, schema)).collect()), key=repr)
    assert len(want) > 10
    files = shuffled(rng, rows, 4, 4)
    files[-1].append(("a", T, 0, 0.9))  # too late: it changes nothing
    got = streamed(spark, tmp_path, "s", lambda df: event_time.segments(df, delay="5 seconds", idle_ms=60_000), rows, schema, files, ("beat", T + dt.timedelta(hours=1), 0, 0.1))
    assert got == want


def test_escalation_equals_the_batch(spark, tmp_path):
    rng = random.Random(8)
    rows = [(f"e{rng.randrange(3)}", T + dt.timedelta(seconds=rng.randrange(4000)), k, rng.choice(("LOW", "MEDIUM", "HIGH")), rng.choice((["x"], ["x", "y"], [], ["z"]))) for k in range(160)]
    schema = "endpoint_id string, ts timestamp, id long, severity string, categories array<string>"
    batch = state.escalated(spark.createDataFrame(rows, schema), "endpoint_id", "ts", "id")
    want = sorted(((r["endpoint_id"], r["id"], r["severity"], r["repeats"], r["escalated"]) for r in batch.collect()), key=repr)
    assert any(w[2] != w[4] for w in want)
    got = streamed(spark, tmp_path, "e", lambda df: event_time.escalation(df, delay="200 seconds"), rows, schema, shuffled(rng, rows, 3, 150), ("beat", T + dt.timedelta(days=1), 0, "LOW", []))
    assert [g for g in got if g[0] != "beat"] == want


def test_environment_equals_the_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for s in ("a", "b"):
        for k in range(700):
            speech = 300 < k < 520
            level = -95.0 if s == "b" and 50 < k < 330 else -50 + 5 * math.sin(k / 9) + (30 if k in (100, 560, 565) or (speech and k > 470) else 0)
            rows.append((s, T + dt.timedelta(milliseconds=32 * k), k, level, 0.9 if speech else 0.1))
    schema = "session_id string, ts timestamp, chunk_idx long, level_db double, speech_prob double"
    want = sorted((tuple(r) for r in state.environment(spark.createDataFrame(rows, schema)).collect()), key=repr)
    assert {w[2] for w in want} >= {"sudden_sound", "raised_voice", "input_silent"}
    got = streamed(spark, tmp_path, "v", lambda df: event_time.environment(df, delay="5 seconds"), rows, schema, shuffled(rng, rows, 3, 4), ("beat", T + dt.timedelta(hours=1), 0, -50.0, 0.1))
    assert got == want


def fed(machine, rows, cuts):
    kept, out, at = machine.begin(rows[0]), [], 0
    for cut in [*cuts, len(rows)]:
        kept, found = machine.feed(kept, rows[at:cut]) if cut > at else (kept, [])
        out, at = out + found, max(at, cut)
    return out + machine.end(kept)


def test_confirmation_breaks_at_missing_windows():
    rows = [(k, w, p) for k, (w, p) in enumerate([(3, ["a", "b"]), (4, ["a"]), (6, ["b", "c"]), (7, ["b", "a", None and ""]), (8, None), (9, ["c"]), (10, ["c", "a"]), (11, ["a"])])]
    rows = [(k, w, [x for x in p or () if x] if p else p) for k, w, p in rows]
    want = [("a", 4, 2), ("b", 7, 2), ("c", 10, 2)]
    for cuts in ([], [1], [2, 3, 7], list(range(len(rows)))):
        assert fed(event_time.Confirm(), rows, cuts) == want
