import itertools
import random
import re

import numpy as np
import pytest

from sottovoce.llm import near_dedup

WORD = re.compile("[^\x20\x09-\x0d]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, width, percent=80):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(FOLD))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.choice((3, 12, 60, 150)))] for _ in range(40)]
    rows = []
    for b in base:
        for _ in range(rng.choice((1, 1, 2, 5))):
            c = list(b)
            for _ in range(rng.choice((0, 1, 2, 6))):
                c[rng.randrange(len(c))] = rng.choice(words)
            rows.append(" ".join(c))
    hub = [rng.choice(words) for _ in range(100)]
    for _ in range(60):  # a group of near copies of which many do not link to each other
        c = list(hub)
        for _ in range(rng.randrange(14)):
            c[rng.randrange(100)] = rng.choice(words)
        rows.append(" ".join(c))
    rows += [None, "", " \t", "One", "one", "ONE two", "one Two", "x" * 100_000, "long " * 20_000, "É a b c", "é a b c"]
    return list(enumerate(rows))


@pytest.mark.parametrize("width", [2, 5])
def test_groups_equal_brute_force(spark, width):
    rows = corpus()
    df = spark.createDataFrame([(i, t, None) for i, t in rows], "doc_id bigint, text string, n string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.groups(df, width=width).collect()}
    assert got == brute(rows, width)


def test_dedup_keeps_columns_and_empties(spark):
    df = spark.createDataFrame([(3, "a b c d e f", 1), (1, "a b c d e f", 2), (2, None, 3), (4, "", 4)], "doc_id bigint, text string, row int")
    out = near_dedup.dedup(df)
    assert out.columns == df.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 2, 4]


def test_dedup_of_repeated_and_null_ids_and_clashing_names(spark):
    a, b, c = "a b c d e f", "g h i j k l m", "n o p q r s t"
    near = " ".join(f"w{k}" for k in range(60))
    rows = [(1, a), (1, a), (2, a), (None, b), (None, b), (3, c), (3, near), (3, near + " end"), (4, near), (5, None), (5, None), (5, ""), (None, " \t"), (6, a.upper())]
    df = spark.createDataFrame([(i, t, k, k, k, k, k) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, _row int, `row` int, id int, grp int, `a.b` int").repartition(3)
    out = near_dedup.dedup(df)
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)
    assert out.columns == df.columns
    (third,) = {(3, near), (3, near + " end")} & set(got)
    assert got == sorted([(1, a), (None, b), (3, c), third, (5, None), (5, None), (5, ""), (None, " \t")], key=repr)


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (9, "A b c d e f"), (None, "other words stand in here"), (None, None)], "doc_id bigint, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.groups(df).collect()), key=repr)
    assert got == sorted([(None, 9, False), (None, 9, False), (9, 9, True), (None, None, True), (None, None, True)], key=repr)


def frames(n, own, common=200, seed=3):
    """Texts that share a frame, but too little to link, and now and then a copy with one word changed."""
    rng = random.Random(seed)
    frame = [f"f{k}" for k in range(common)]
    rows = []
    for i in range(n):
        words = frame + [f"o{i}x{k}" for k in range(own)]
        rows.append((i, " ".join(words)))
        if i % 50 == 0:
            words[rng.randrange(len(words))] = "changed"
            rows.append((n + i, " ".join(words)))
    return rows


@pytest.mark.parametrize("own", [21, 30])
def test_a_family_that_shares_a_frame(spark, own):
    rows = frames(120, own)
    rows += [(1000 + i, " ".join([f"f{k}" for k in range(200)] + [f"z{i}x{k}" for k in range(3)])) for i in range(40)]  # these do link, and to nothing else
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.groups(df, width=2).collect()}
    assert got == brute(rows, 2)


@pytest.mark.parametrize("percent", [50, 80, 95, 100])
def test_sets_that_link_meet_in_their_prefixes(percent):
    rng = random.Random(percent)
    met = 0
    for _ in range(4000):
        core = rng.sample(range(60), rng.randrange(1, 40))
        x, y = (sorted({k for k in core if rng.random() < 0.95} | set(rng.sample(range(60), rng.randrange(4)))) for _ in range(2))
        both = len(set(x) & set(y))
        if not x or not y or 100 * both < percent * (len(x) + len(y) - both):
            continue
        met += 1
        (x, y) = sorted((x, y), key=len)
        small, large = near_dedup.prefixes(np.array([len(x), len(y)]), percent)
        first = min(set(x) & set(y))
        assert x.index(first) < large[0] and y.index(first) < small[1]
        assert (100 + percent) * min(len(x) - x.index(first), len(y) - y.index(first)) >= percent * (len(x) + len(y))
    assert met > 50


@pytest.mark.parametrize("text", ["That it.", "that is it", "one"])
def test_a_block_of_fewer_words_than_a_shingle(spark, text):
    df = spark.createDataFrame([(7, text)], "doc_id bigint, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.groups(df, width=5).collect()} == brute([(7, text)], 5)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert near_dedup.groups(df).count() == 0


def test_estimates():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    for shared in (0, 1000, 2500):
        a, b = x[:2750], x[2750 - shared : 3000] if shared else x[2750:]
        k = near_dedup.sketch([a, b])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        got = near_dedup.jaccard((k[:1] > k[1:]).sum(1), (k[:1] < k[1:]).sum(1), np.array([float(len(a))]), np.array([float(len(b))]))[0]
        assert abs(got - true) < 0.13
        assert (near_dedup.merge(k[0], k[1]) == near_dedup.sketch([np.union1d(a, b)])[0]).all()
