import random

import pytest
from pyspark.sql import functions as F

from sottovoce.functions.fuzzy import PhraseIndex, allowed, lcs_length, partial_ratio
from sottovoce.functions.text import normalize, skeleton
from sottovoce.operators import keywords
from sottovoce.sources.policy import EXAMPLE, Policy


def floor(p):
    return 86.0 if len(p) >= 10 else 90.0


def garbled(rng, p, letters):
    p = list(p)
    for _ in range(rng.randrange(5)):
        k = rng.randrange(len(p))
        match rng.randrange(3):
            case 0:
                p[k] = rng.choice(letters)
            case 1 if len(p) > 3:
                del p[k]
            case _:
                p.insert(k, rng.choice(letters))
    return "".join(p)


@pytest.mark.parametrize("seed", range(12))
def test_the_index_equals_brute_force(seed):
    rng = random.Random(seed)
    letters = "abcdefgé日z"[: rng.choice((2, 4, 7, 10))]
    phrases = [(p, floor(p)) for p in ("".join(rng.choice(letters) for _ in range(rng.choice((1, 2, 6, 9, 10, 14, 19, 22, 30, 63, 64, 65, 90)))) for _ in range(30))]
    texts = [None, "", "a", "ab"]
    for _ in range(40):
        t = "".join(rng.choice(letters + "#") for _ in range(rng.choice((2, 7, 12, 40, 300))))
        for _ in range(rng.randrange(4)):
            cut = rng.choice((0, len(t), rng.randrange(len(t) + 1)))
            t = t[:cut] + garbled(rng, rng.choice(phrases)[0], letters) + t[cut:]
        texts.append(t)
    for text, found in zip(texts, PhraseIndex(phrases).find(texts), strict=True):
        want = [(k, v) for k, (p, f) in enumerate(phrases) if text and (v := partial_ratio(p, text, f))]
        assert [k for k, _ in found] == [k for k, _ in want] and [v for _, v in found] == pytest.approx([v for _, v in want])


def test_an_index_of_nothing():
    assert PhraseIndex([]).find(["abc", None]) == [[], []]


@pytest.mark.parametrize("n", range(1, 90))
def test_what_may_be_lost(n):
    for f in (86.0, 90.0):
        most = allowed(n, f)
        assert all(n + m - 2 * k <= most for m in range(1, n + 1) for k in range(m + 1) if 200 * k >= f * (n + m))


def test_subsequences_in_bits():
    rng = random.Random(5)

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0, *[max(row[j] + 1 if x == b[j] else 0, row[j + 1]) for j in range(len(b))]]
            for j in range(len(b)):
                row[j + 1] = max(row[j + 1], row[j])
        return row[-1]

    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in range(2))
        assert lcs_length(a, b) == plain(a, b)


def _policy(**categories):
    return Policy(EXAMPLE | {"categories": categories})


def test_matched_equals_brute_force(spark):
    rng = random.Random(2)
    policy = _policy(one={"weight": 0.9, "phrases": ["green apples fall", "sour plum", {"text": "plum", "weight": 0.5}, "fall"]}, two={"weight": 0.6, "phrases": ["the apple falls down", "plum pudding"], "variants": {"ur": ["پاس ورڈ"]}})
    words = ["green", "aples", "apples", "fall", "falls", "plum", "plums", "sour", "sower", "puding", "pudding", "the", "down", "apple", "پاس", "وڑٹ", "ورڈ"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 14)))) for i in range(400)] + [(400, None), (401, ""), (402, "plum " * 3000), (403, "x")]
    docs = spark.createDataFrame(rows, "id int, t string").select("id", normalize(F.col("t")).alias("n"))
    docs = docs.select("id", "n", skeleton(F.col("n")).alias("s"))
    listed = policy.phrases(spark).collect()
    endings = ["", *keywords.SUFFIXES]
    for r in keywords.matched(docs, policy, "n", "hits").collect():
        exact = {p["text"]: min(f" {r['n']} ".index(f" {p['key']}{e} ") for e in endings if f" {p['key']}{e} " in f" {r['n']} ") for p in listed if any(f" {p['key']}{e} " in f" {r['n']} " for e in endings)}
        near = {p["text"]: round(v, 1) for p in listed if p["text"] not in exact and len(p["skeleton"]) >= 6 and len(r["s"]) >= 6 and (v := partial_ratio(p["skeleton"], r["s"], floor(p["skeleton"])))}
        assert {h["phrase"] for h in r["hits"] if h["match"] == "exact"} == set(exact)
        assert {h["phrase"]: h["similarity"] for h in r["hits"] if h["match"] == "fuzzy"} == near
        assert len(r["hits"]) == len(exact) + len(near)
    assert keywords.matched(docs.limit(0), policy, "n", "hits").count() == 0


def test_a_misheard_word_of_another_script(spark):
    policy = _policy(credentials={"weight": 0.9, "phrases": ["root password"], "variants": {"ur": ["سرور کا پاس ورڈ"]}})
    docs = spark.createDataFrame([("یار سرور کا پاس وڑٹ بتا دو",)], "t string").select(normalize(F.col("t")).alias("n"))
    (h,) = keywords.matched(docs, policy, "n", "hits").head()["hits"]
    assert (h["lang"], h["match"], h["weight"]) == ("ur", "fuzzy", 0.81)
