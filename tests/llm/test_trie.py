import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from sottovoce.llm import trie


def brute(listed):
    """listed: id -> tuple of turns, each (role, text). The nodes by their whole prefixes."""
    members = defaultdict(list)
    for i, turns in listed.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(i)
    below = defaultdict(list)
    for p in members:
        for d in range(len(p) + 1):
            below[p[:d]].append(p)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    size = lambda p: len(p[-1][1].encode()) if p else 0
    out = []
    for p, ids in members.items():
        ends = ",".join(str(i) for i in sorted(i for i in ids if len(listed[i]) == len(p)))
        out.append((min(ids), len(p), min(members[p[:-1]]) if p else None, len(ids), children[p], sum(not children[q] for q in below[p]), sum((len(members[q]) - 1) * size(q) for q in below[p]), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def ordered(rows):
    """Conversations of (conv_id, turn, role, text) rows, as they come: equal numbers by role and digest."""
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            r, t = role or "", text or ""
            by[c].append(((turn is not None, turn or 0, r, hashlib.sha256(f"{len(r)}:{r}{t}".encode()).hexdigest()), (r, t)))
    return {c: tuple(x for _, x in sorted(turns)) for c, turns in by.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, ())[:h] + own[h:]
    return out


def nodes(df):
    return sorted((tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in df.collect()), key=repr)


def conversations(seed):
    rng = random.Random(seed)
    said = ["", "é", "hello", "yes", "no " * 40]
    rows = []
    for c in range(300):
        kind = rng.random()
        n = rng.choice((1, 2, 3, 5, 9, 14))
        if kind < 0.35:  # copies of one conversation, and beginnings of it
            rows += [(c, k, "user", f"common {k}") for k in range(min(n, 9))]
        else:
            rows += [(c, k if rng.random() < 0.9 else None, rng.choice(("user", "bot", None)), rng.choice(said) if rng.random() < 0.9 else None) for k in range(n)]
    rows += [(1000, k, "user", f"turn {k % 7}") for k in range(700)] + [(1001, k, "user", f"turn {k % 7}") for k in range(650)]
    rows += [(None, 1, "user", "nobody's"), (1002, 1, "user", "twice"), (1002, 1, "user", "twice"), (1002, 1, "bot", "twice"), (2**40, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("ranges, run_paths", [(1, 1000), (1, 7), (6, 40), (40, 3)])
def test_nodes_equal_brute_force(spark, ranges, run_paths):
    rows = conversations(4)
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id bigint, turn bigint, role string, text string, path string").repartition(5)
    listed = ordered(rows)
    plain = trie.paths(df).select("conv_id", trie.packed(trie.F.col("turns")).alias("path"))
    assert nodes(trie.trie(plain, ranges, run_paths)) == brute(listed)
    assert nodes(trie.trie(trie.rebuilt(trie.paths(df)), ranges, run_paths)) == brute(rebuilt(listed))


def test_copies_over_many_ranges(spark):
    """One node holds most of the ends, and its ids meet again in order."""
    listed = {i: (("u", "first"), ("u", "second")) for i in range(30_000)} | {-3: (("u", "first"),), 40_000: (("u", "first"), ("u", "second"), ("u", "third")), 40_001: (), 40_002: (("b", "first"),)}
    df = spark.createDataFrame([(c, k, r, t) for c, turns in listed.items() for k, (r, t) in enumerate(turns)], "conv_id bigint, turn bigint, role string, text string")
    given = trie.paths(df).select("conv_id", trie.packed(trie.F.col("turns")).alias("path")).union(spark.createDataFrame([(40_001, bytearray())], "conv_id bigint, path binary"))
    assert nodes(trie.trie(given, 9)) == brute(listed)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert trie.trie(trie.rebuilt(trie.paths(df))).count() == 0


def _paths(rng, n):
    turn = lambda: bytes([rng.randrange(3)]) * trie.STEP
    stem = b"".join(turn() for _ in range(40))
    return [(stem[: trie.STEP * rng.randrange(41)] + b"".join(turn() for _ in range(rng.randrange(4))), rng.randrange(50)) for _ in range(n)]


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16])
def test_runs_merge_in_order_with_their_lcps(k):
    rng = random.Random(k)
    for _ in range(30):
        parts = [_paths(rng, rng.randrange(12)) for _ in range(k)]
        out = list(trie.merged([trie.sorted_run(p) for p in parts]))
        assert [x[:2] for x in out] == sorted(x for p in parts for x in p)
        for a, b in zip([(b"", 0, 0), *out], out, strict=False):
            same = next((j for j in range(len(b[0]) // trie.STEP) if a[0][j * trie.STEP : (j + 1) * trie.STEP] != b[0][j * trie.STEP : (j + 1) * trie.STEP]), len(b[0]) // trie.STEP)
            assert b[2] == same == trie.shared(a[0], b[0])


def test_merging_does_not_compare_shared_turns_again(monkeypatch):
    """Copies of a long path: turns are looked at once for each run, not once for each path."""
    long = b"x" * trie.STEP * 2000
    runs = [trie.sorted_run([(long, 10 * r + k) for k in range(10)]) for r in range(4)]
    looked = []
    was = trie.shared
    monkeypatch.setattr(trie, "shared", lambda a, b, at=0: looked.append((out := was(a, b, at)) - at) or out)
    assert len(list(trie.merged(runs))) == 40 and sum(looked) <= 2000 * 4
