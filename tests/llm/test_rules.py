import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sottovoce.llm import rules, vectext

WORD = re.compile("[^\x20\x09-\x0d]+")
TOKEN = re.compile("[^\x20\x09-\x0d.,;:!?\"'()]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    lines = Counter(x for x in t.split("\n") if WORD.search(x))
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), sum(n - 1 for n in lines.values()), len(covered)


def kind(c):
    return 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3 if c in " \t\n\x0b\x0c\r" else 4 if c in ".,;:!?\"'()" else 5 if ord(c) < 128 else 6


def squared(p, q):
    a, b = sum(p), sum(q)
    if not a:
        return 0.0
    total = 0.0
    for x, y in zip(p, q, strict=True):
        x, y = x / a, y / b
        total += sum(v * math.log2(v / ((x + y) / 2)) for v in (x, y) if v) / 2
    return total


def histograms(t):
    return [sum(kind(c) == k for c in t) for k in range(7)], Counter(TOKEN.findall(t.translate(FOLD)))


def known_of(rows):
    kinds, words, texts = defaultdict(lambda: np.zeros(7)), defaultdict(Counter), Counter()
    for lang, t in {(lang, t) for _, t, lang in rows if t is not None and lang is not None}:
        n = brute(t)
        if n[0] >= 50 and 100 * n[4] <= 50 * n[0]:
            c, w = histograms(t)
            kinds[lang] += [x * 10**6 // sum(c) for x in c]
            words[lang].update({k: x * 10**6 // sum(w.values()) for k, x in w.items()})
            texts[lang] += bool(w)
    return {x: (kinds[x], {w: n for w, n in words[x].items() if n * 200 >= texts[x] * 10**6}, texts[x] * 10**6) for x in texts if texts[x] >= 20}


def verdict(text, lang, known):
    t, n = text or "", brute(text)
    failed = n[0] < 50 or 100 * n[4] > 50 * n[0]
    if failed:
        return n, True, False
    c, w = histograms(t)
    best = []
    for x, (kinds, words, total) in known.items():
        if lang in known and x != lang:
            continue
        listed = sorted(words)
        p = [w[k] for k in listed] + [sum(w.values()) - sum(w[k] for k in listed)]
        q = [words[k] for k in listed] + [total - sum(words.values())]
        chance = lambda bins, size: 1.5 * (bins - 1) / (8 * math.log(2) * max(size, 1))
        best.append(max(squared(c, kinds) - 0.09 - chance(7, sum(c)), squared(p, q) - 0.05 - chance(len(p), sum(p))))
    return n, False, not best or min(best) <= 0


def rows():
    rng = random.Random(11)
    usual = {"en": ["the", "of", "and", "to", "in"], "fr": ["le", "la", "et", "à", "été"]}
    rare = ["".join(rng.choice("abcdefgé") for _ in range(rng.randrange(3, 9))) for _ in range(600)]
    out = []
    for i in range(260):
        lang = rng.choice(("en", "fr"))
        words = [rng.choice(usual[lang]) if rng.random() < 0.45 else rng.choice(rare) for _ in range(rng.choice((30, 55, 90, 200)))]
        how = rng.random()
        if how < 0.1:
            words = [w.upper() + "!!" for w in words]
        elif how < 0.2:
            words = [w + rng.choice(("###", "&&&", "***")) for w in words]
        elif how < 0.3:
            words = [rng.choice(rare) for _ in words]
        elif how < 0.35:
            words = words[:4] * 30
        elif how < 0.45:
            words = words + ["\n", "same", "line.", "\n"] * 3
        out.append((i, rng.choice((" ", "\n", "  ")).join(words), lang))
    text = " ".join(rng.choice(usual["en"]) if rng.random() < 0.45 else rng.choice(rare) for _ in range(120))
    out += [(1000 + k, text, "en") for k in range(300)]  # copies weigh once
    out += [(2000, None, "en"), (2001, "", None), (2002, text, None), (2003, text, "xx"), (None, text, "fr"), (2004, None, None), (2005, " \n \t", "en"), (2006, "a a a a", "en"), (2007, "x" * 300_000, "en"), (2008, ("word %d and\n" * 20_000) % tuple(range(20_000)), "en")]
    return out


def test_equals_brute_force(spark):
    data = rows()
    df = spark.createDataFrame([(*r, 1, 2) for r in data], "doc_id bigint, text string, lang string, n_words int, r int").repartition(5)
    known = known_of(data)
    assert set(known) == {"en", "fr"}
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = sorted(((r["doc_id"], tuple(r[c] for c in names), r["base_failed"], r["kept"]) for r in rules.judge(df).collect()), key=repr)
    assert got == sorted(((i, *verdict(t, lang, known)) for i, t, lang in data), key=repr)
    kept = {r[0]: r[3] for r in got}
    assert sum(not kept[i] for i in range(260)) > 60 and sum(kept[i] for i in range(260)) > 80 and all(kept[1000 + k] for k in range(300)) and kept[2002]


def test_references_count_distinct_texts(spark):
    data = rows()
    found = rules.references(spark.createDataFrame(data, "doc_id bigint, text string, lang string").repartition(7))
    for lang, (kinds, words, total) in known_of(data).items():
        assert found[lang].classes.tolist() == list(kinds) and found[lang].total == total and sorted(found[lang].counts.tolist()) == sorted(words.values())
    assert rules.references(spark.createDataFrame([], "doc_id bigint, text string, lang string")) == {}


def test_without_references_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "only a few words", "en"), (2, " ".join(f"w{k}" for k in range(60)), None)], "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: (r["base_failed"], r["kept"], r["class_distance"]) for r in rules.judge(df).collect()}
    assert got == {1: (True, False, None), 2: (False, True, None)}
    assert rules.judge(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_base_counts(seed):
    rng = random.Random(seed)
    parts = ["a", "b b", "\n", "\r", " ", "é#", "|", "\n\n", "a b c", "x\ny", "\x0b", "\x1f", "日本", "<>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(80))) for _ in range(300)] + [None, "", "\n", "a\na", "a\r\na\r", "q q q q q"]
    data, starts = vectext.text_bytes(pa.array(texts, pa.string()))
    assert [tuple(r) for r in rules.base(data, starts).tolist()] == [brute(t) for t in texts]
