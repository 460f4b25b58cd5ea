import datetime as dt
import random

import pytest

from sottovoce.operators import jumps, state

T = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def test_spaced_equals_a_fold(spark):
    rng = random.Random(4)
    rows = [(f"k{rng.randrange(4)}", T + dt.timedelta(milliseconds=rng.randrange(60_000) // 250 * 250), i) for i in range(600)] + [("alone", T, 1000), ("none", None, 1001), (None, T, 1002), (None, T, 1003)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, id int")
    df = df.na.fill("null", ["k"])
    want = set()
    for k in {r[0] for r in rows}:
        mine = sorted((t, i) for key, t, i in rows if key == k and t)
        want |= {i for (_, i), ok in zip(mine, state.cooled([(t - T).total_seconds() for t, _ in mine], 2.5), strict=True) if ok}
    got = jumps.spaced(df, ["k"], "ts", "id", 2.5)
    assert got.columns == df.columns and sorted(r["id"] for r in got.collect()) == sorted(want)
    assert jumps.spaced(df.limit(0), ["k"], "ts", "id", 2.5).count() == 0


def _sessions(rng, n):
    out = {}
    for s in range(n):
        speech, at = [], 0
        while len(speech) < 220:
            speech += [True] * rng.choice((1, 2, 9, 30, 90)) + [False] * rng.choice((1, 4, 5, 6, 7, 8, 9, 12, 40))
            speech = [x if rng.random() < 0.97 else not x for x in speech]
        out[f"s{s}"] = (rng.choice((0, 3, 1000)), speech[: rng.choice((200, 217, 1, 2, 60))])
    out["silent"], out["loud"] = (0, [False] * 40), (5, [True] * 300)
    return out


@pytest.mark.parametrize("limits", [{"pre": 3, "hang": 5, "least": 4, "most": 25}, {"pre": 6, "hang": 5, "least": 1, "most": 12}, {"pre": 0, "hang": 1, "least": 2, "most": 10}, {}])
def test_segments_equal_the_fold(spark, limits):
    rng = random.Random(len(limits) + limits.get("pre", 9))
    sessions = _sessions(rng, 25)
    rows, want = [], []
    for name, (base, speech) in sessions.items():
        there = [k for k in range(len(speech)) if k in (0, len(speech) - 1) or speech[k] or rng.random() < 0.8]  # some silent chunks are missing
        rows += [(name, base + k, 0.9 if speech[k] else 0.1) for k in there] + [(name, base + there[-1], 0.9 if speech[there[-1]] else 0.1)]
        found, _ = state.segment(speech, **limits)
        want += [(name, i, base + a, base + b, n) for i, (a, b, n) in enumerate(found)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "session_id string, chunk_idx long, speech_prob double")
    assert sorted(map(tuple, state.segments(df, **limits).collect())) == sorted(want)


def test_filled():
    assert state.filled([3, 4, 4, 7, 6], [True, True, False, True, True], 2) == [False, True, True, False, False, True]
