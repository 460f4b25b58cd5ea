"""Decontamination, exact dedup, sharding and licences."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sottovoce.llm import decontaminate, exact_dedup, licenses, sharding

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").translate(FOLD))


def brute(docs, items, window=13):
    out = {}
    for i, t in docs:
        w, hit, met = words(t), set(), set()
        for item, text in items:
            b = words(text)
            n = min(window, len(b))
            for s in range(len(b) - n + 1) if b else ():
                for at in range(len(w) - n + 1):
                    if w[at : at + n] == b[s : s + n]:
                        hit.update(range(at, at + n))
                        met.add(str(item))
        out[i] = (len(w), len(hit), len(met), sorted(met))
    return out


def cases():
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(30)] + ["É", "é", "x"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(n)) for k, n in enumerate((20, 13, 14, 3, 1, 40))] + [(6, None), (7, " .,"), (8, "the the the")]
    docs = []
    for i in range(30):
        b = rng.choice(items)[1] or ""
        docs.append((i, f"{text(rng.randrange(40))}. {b.upper()}!{b} {text(rng.randrange(60))}"))
    docs += [(30, None), (31, ""), (32, "..."), (33, "the the the the"), (34, text(20_000))]
    return docs, items


@pytest.mark.parametrize("limit", [1 << 20, 0])  # broadcast, and the way without
def test_decontamination(spark, limit):
    docs, items = cases()
    d = spark.createDataFrame([(i, t, "n") for i, t in docs], "doc_id bigint, text string, word string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items"]) for r in decontaminate.verdicts(d, b, broadcast_bytes=limit).collect()}
    assert got == brute(docs, items)


def test_decontamination_removes(spark):
    item = " ".join(f"b{i}" for i in range(13))
    docs = [(1, f"Start, {item} end."), (2, "clean"), (2, "clean"), (None, None), (3, f"{item} " + "z " * 400)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    assert decontaminate.verdicts(d, b).count() == 5
    assert sorted((r["doc_id"] or 0) for r in decontaminate.decontaminate(d, b).collect()) == [0, 2, 2, 3]
    cut = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(d, b, remove="spans").collect()}
    assert cut[1] == "Start, end." and cut[2] == "clean" and cut[3] == "z " * 400 and cut[None] is None
    assert decontaminate.verdicts(d, b.limit(0)).where("contaminated").count() == 0
    assert decontaminate.verdicts(d.limit(0), b).count() == 0


def test_decontamination_with_clashing_names(spark):
    item = " ".join(f"b{i}" for i in range(13))
    d = spark.createDataFrame([(1, f"Start, {item} end. {item}", 1, 2, 3, 4), (2, "clean", 1, 2, 3, 4)], "doc_id bigint, text string, _id int, digest int, spans int, `a.b` int")
    b = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    cut = decontaminate.decontaminate(d, b, remove="spans")
    assert cut.columns == d.columns and sorted(r["text"] for r in cut.collect()) == ["Start, end. ", "clean"]
    assert [r["doc_id"] for r in decontaminate.decontaminate(d, b).collect()] == [2]


def _collide(c):
    return F.pmod(F.crc32(c.cast("binary")), F.lit(5))


@pytest.mark.parametrize("options", [{}, {"digest": _collide, "low": 3, "high": 9}])
def test_exact_dedup(spark, options):
    rows = [(1, "Hello World. More\ntext"), (5, "hello world. more\nTEXT"), (3, "hello world. More\ntexT "), (2, None), (4, ""), (6, "É"), (7, "é"), (8, "a" * 50_000), (9, "A" * 50_000), (7, "é")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, d int")
    got = sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.groups(df, **options).collect())
    norm = [(i, (t or "").translate(FOLD)) for i, t in rows]
    want = sorted((i, max(j for j, u in norm if u == t), sum(u == t for _, u in norm), i == max(j for j, u in norm if u == t), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm)
    assert got == want
    assert sorted(r["doc_id"] for r in exact_dedup.dedup(df).collect()) == [3, 4, 5, 6, 7, 9]
    assert exact_dedup.groups(df.limit(0)).count() == 0


def test_exact_dedup_with_repeated_and_null_ids(spark):
    rows = [(None, "alpha", 1), (None, "beta", 1), (7, "one", 1), (7, "two", 1), (8, "three", 1), (8, "Three", 2), (8, "THREE", 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, sha int")
    out = exact_dedup.dedup(df)
    got = out.collect()
    assert out.columns == df.columns and sorted(r["text"].lower() for r in got) == ["alpha", "beta", "one", "three", "two"]
    assert {(r["doc_id"], r["text"].lower()) for r in got} == {(i, t.lower()) for i, t, _ in rows}


@pytest.mark.parametrize("kind", ["words", "letters"])
def test_chunks_realign_without_sentence_ends(spark, kind):
    rng = random.Random(8)
    body = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(60_000)) if kind == "letters" else " ".join("".join(rng.choice("aeioutrns") for _ in range(5)) for _ in range(10_000))
    a, b = (r["c"] for r in spark.createDataFrame([(body,), ("of some length" + body,)], "t string").select(exact_dedup.chunks(F.col("t")).alias("c")).collect())
    assert "".join(a) == body and len(set(a) & set(b)) > len(a) * 0.5


def test_chunks_join_to_the_text_and_meet_again(spark):
    rng = random.Random(1)
    body = " ".join(rng.choice(("one", "two.", "three\n", "four")) for _ in range(5000))
    df = spark.createDataFrame([(body,), ("prefix of another length. " + body,)], "t string")
    a, b = (r["c"] for r in df.select(exact_dedup.chunks(F.col("t")).alias("c")).collect())
    assert "".join(a) == body and "".join(b).endswith(body) and len(set(a) & set(b)) > len(a) * 0.5


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_sharding(spark):
    ids = [*range(-50, 200), 2**63 - 1, -(2**63)]
    df = spark.createDataFrame([(i, "é" * (i % 5), "s") for i in ids] + [(None, None, None), (3, "x", "s")], "doc_id bigint, text string, shard string").drop("shard")
    for n in (1, 16, 100):
        got = {r["doc_id"]: r["shard"] for r in sharding.assign(df, n).collect()}
        assert all(got[i] == jump(i % 2**64, n) for i in ids)
    m = sharding.manifest(df, 16).collect()
    assert len(m) == len(ids) + 2 and all(r["grown_shard"] in (r["shard"], 16) for r in m)
    for s in range(16):
        slots = sorted(r["slot"] for r in m if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert {r["size"] for r in m if r["doc_id"] is None} == {1} and sharding.manifest(df.limit(0), 16).count() == 0


def test_licenses(spark):
    rows = [
        ("a/LICENSE", "Released under the MIT License."), ("a/b/x.py", "print"), ("a/b/y.py", "code " * 50 + "\nLicensed under the Apache License, Version 2.0.\n"),
        ("a/b/c/COPYING", "filler\nSPDX-License-Identifier: GPL-3.0\n"), ("a/b/c/d/e/z.py", None), ("root.txt", ""), (None, "x"), ("other/q", "this license is unlike any of them"), ("a/b/x.py", "print"),
    ]
    df = spark.createDataFrame([(p, t, 1) for p, t in rows], "path string, text string, license int")
    got = sorted(((r["path"] or ""), r["own_license"], r["license"], r["inherited_from"]) for r in licenses.scan(df).collect())
    assert got == sorted([
        ("a/LICENSE", "MIT", "MIT", None), ("a/b/x.py", None, "MIT", "a"), ("a/b/x.py", None, "MIT", "a"), ("a/b/y.py", "Apache-2.0", "Apache-2.0", None),
        ("a/b/c/COPYING", "GPL-3.0", "GPL-3.0", None), ("a/b/c/d/e/z.py", None, "GPL-3.0", "a/b/c"), ("root.txt", None, None, None), ("", None, None, None), ("other/q", None, None, None)], key=lambda x: (x[0], x[1] or ""))
    assert licenses.scan(df.limit(0)).count() == 0


def test_licenses_tell_creative_commons_apart(spark):
    said = {"a": "Licensed under CC BY-NC 4.0.", "b": "Licensed under CC BY 4.0.", "c": "Licensed under CC BY-SA 4.0.", "d": "Licensed under CC BY-NC-ND 4.0."}
    got = {r["path"]: r["own_license"] for r in licenses.scan(spark.createDataFrame(list(said.items()), "path string, text string")).collect()}
    assert got == {"a": "CC-BY-NC-4.0", "b": "CC-BY-4.0", "c": "CC-BY-SA-4.0", "d": "CC-BY-NC-ND-4.0"}


def test_licenses_of_whole_texts(spark):
    mit, (bsd2,), (bsd3,) = licenses.TEXTS["MIT"][0], licenses.TEXTS["BSD-2-Clause"], licenses.TEXTS["BSD-3-Clause"]
    rows = [
        ("m/LICENSE", "Copyright 2020 Foo. All rights reserved.\n\n" + mit.replace(". ", ".\n")), ("m/x.c", "int x;"), ("b/two", bsd2.upper()), ("b2/three", "Copyright 2021 Bar\n" + bsd3.replace(", ", ",\n")),
        ("p/LICENSE", "All rights reserved."), ("q/novel", "Permission is hereby granted, said the king. " + "And so they went on and on through the woods. " * 50),
    ]
    files = spark.createDataFrame(rows, "path string, text string")
    got = {r["path"]: (r["own_license"], r["license"]) for r in licenses.scan(files).collect()}
    assert got == {"m/LICENSE": ("MIT",) * 2, "m/x.c": (None, "MIT"), "b/two": ("BSD-2-Clause",) * 2, "b2/three": ("BSD-3-Clause",) * 2, "p/LICENSE": ("proprietary",) * 2, "q/novel": (None, None)}
    assert all(r["license"] is None for r in licenses.scan(files, templates={}, texts={}).collect())


def test_licenses_keep_clashing_names(spark):
    clashing = ["row", "share", "license", "path", "cosine", "body", "whole", "text", "a.b"]
    files = spark.createDataFrame([("d/f", "Released under the MIT License.", *[f"v{k}" for k in range(7)])], "`path` string, `text` string, `row` string, share string, license string, cosine string, body string, whole string, `a.b` string")
    out = licenses.scan(files, keep=clashing)
    assert out.columns == ["row", "share", "kept_license", "kept_path", "kept_cosine", "body", "whole", "text", "a.b", "path", "own_license", "cosine", "license", "inherited_from"]
    (r,) = out.collect()
    assert (r["row"], r["share"], r["kept_license"], r["kept_path"], r["kept_cosine"], r["a.b"], r["license"], r["path"]) == ("v0", "v1", "v2", "d/f", "v3", "v6", "MIT", "d/f")


def test_cosines_equal_brute_force(spark):
    known = licenses.Templates(licenses.TEMPLATES)
    lines = ["Released under the MIT License.", "licensed under the gnu general public license version 2", "all rights reserved by the license", "MIT license MIT license"]

    def cosine(line, terms):
        own = Counter(re.findall("[a-z0-9]+", line.lower()))
        w = {t: n * known.idf.get(t, known.unseen) for t, n in own.items()}
        f = {t: n * known.idf[t] for t, n in terms.items()}
        return sum(v * f.get(t, 0) for t, v in w.items()) / math.sqrt(sum(v * v for v in w.values()) * sum(v * v for v in f.values()))

    got = {r["path"]: (r["own_license"], r["cosine"]) for r in licenses.scan(spark.createDataFrame([(x, x) for x in lines], "path string, text string"), min_cosine=0.1).collect()}
    for x in lines:
        best = max(cosine(x, t) for _, t in known.forms)
        assert got[x][1] == pytest.approx(best, abs=1e-6) and any(n == got[x][0] and cosine(x, t) > best - 1e-6 for n, t in known.forms)
