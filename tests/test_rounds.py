import math
import random

from sottovoce.operators import environment, rounds, state
from sottovoce.operators.machines import Baselines


def chunks(rng, n):
    rows = []
    for s, base in (("a", 0), ("b", 40), ("c", 9)):
        speech, loud, muted = False, 0, 0
        for k in range(n if s != "c" else 30):
            speech = not speech if rng.random() < 0.01 else speech
            muted = rng.choice((100, 400)) if rng.random() < 0.001 else max(muted - 1, 0)
            level = -50 + 6 * math.sin(k / 700) + rng.random() * 3 + (14 if speech else 0) + (18 if speech and k % 900 > 700 else 0) + (30 if rng.random() < 0.004 else 0) + (16 if k > n / 2 else 0)
            rows.append((s, base + k, -95.0 if muted else level, 0.9 if speech else 0.1, rng.random() < 0.05))
    return rows


SCHEMA = "session_id string, chunk_idx long, level_db double, speech_prob double, in_segment boolean"


def folded(rows):
    events, levels = [], []
    for s in sorted({r[0] for r in rows}):
        e = environment.Environment()
        for _, k, level, p, inside in sorted(r for r in rows if r[0] == s):
            events += [(s, k, x["kind"], x["level_db"], x["baseline_db"], x["delta_db"]) for x in e.feed(level, p >= 0.5, inside)]
            levels.append((s, k, e.floor, e.speaking))
    return events, levels


def test_blocks_agree_with_one_pass(spark):
    settled = 700
    rows = chunks(random.Random(500), 3000)
    events, levels = folded(rows)
    assert {e[2] for e in events} >= {"sudden_sound", "raised_voice", "input_silent", "ambient_shift"}
    shuffled = list(rows) + rows[:50]
    random.Random(1).shuffle(shuffled)
    df = spark.createDataFrame(shuffled, SCHEMA)
    assert sorted(map(tuple, state.environment(df, block=settled).collect())) == sorted(events)
    assert sorted(map(tuple, state.baselines(df, block=settled).collect()), key=str) == sorted(levels, key=str)


def test_a_session_of_many_blocks_settles_in_a_few_rounds(spark, monkeypatch):
    """With blocks as long as the averages settle over."""
    rows = [r for r in chunks(random.Random(2), 40_000) if r[0] == "a"]
    seen = []
    was = rounds.checkpointed
    monkeypatch.setattr(rounds, "checkpointed", lambda df: seen.append(1) or was(df))
    got = sorted(map(tuple, state.environment(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == sorted(folded(rows)[0]) and len(seen) <= 2 + 3 * 6


def test_empty_and_null_keys(spark):
    df = spark.createDataFrame([(None, 1, -50.0, 0.1, False), ("a", None, -50.0, 0.1, False)], SCHEMA)
    assert state.environment(df).count() == 0 and rounds.run(df, Baselines(), "session_id", "chunk_idx", ["level_db", "in_segment", "in_segment"]).count() == 0
