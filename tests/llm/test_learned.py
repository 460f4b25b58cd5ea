"""Tokens, archives, toxicity, languages and quality."""

import base64
import gzip
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from sottovoce.llm import bpe, language, quality, toxicity, vectext, warc

P = pytest.importorskip("public_tokenizers")
RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def known():
    ranks = bpe.parse_ranks(open(RANKS, "rb").read())
    return ranks, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library():
    ranks, library = known()
    encoder, rng = bpe.Encoder(ranks, P.PATTERN), random.Random(2)
    letters = "aaabbcdeéñ漢字🙂 \n\t\x1c\x85 'sT019²½…--=="
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(1500)] + ["<|endoftext|>", "a" * 30_000, "ab" * 20_000, " " * 5000]
    for t in texts:
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == library.encode_ordinary(t)
        assert encoder.decode(encoder.encode(t)) == t.encode()


def test_bpe_columns(spark):
    _, library = known()
    rows = [(1, "Hello wörld"), (2, None), (3, ""), (3, "")]
    df = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id bigint, text string, decoded0 int")
    out = bpe.decode(bpe.encode(df, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert [(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist(), bytes(r["decoded"]).decode(), r["decoded0"]) for r in out] == [(i, library.encode_ordinary(t or ""), t or "", 9) for i, t in rows]
    assert bpe.encode(df.limit(0), RANKS, P.PATTERN).count() == 0


def pages(spark):
    big = "x" * 3_000_000
    rows = [(5, "http://a/é b", "same"), (2, None, "same"), (7, "u", None), (3, "u", ""), (4, "u", big), (9, "u", "WARC/1.1\r\n\r\nfake"), (8, "u", "é")]
    return rows, spark.createDataFrame([(i, u, h, 0) for i, u, h in rows], "page_id bigint, url string, html string, size int").repartition(2)


def test_warc_round_trip(spark, tmp_path):
    rows, df = pages(spark)
    folder = f"file://{tmp_path}"
    archives = warc.write(df, f"{folder}/whole", archive_bytes=1000)
    done = warc.normalise(archives, f"{folder}/members")
    places = warc.index(spark, f"{folder}/members")
    assert done.agg(F.sum("records")).head()[0] == places.count() == len(rows)
    got = {int(r["record_id"][10:-1]): r for r in warc.read(places).collect()}
    for r in places.collect():  # what the sidecar says is what lies there
        with open(r["uri"].removeprefix("file://"), "rb") as f:
            f.seek(r["offset"])
            head = gzip.decompress(f.read(r["length"])).decode()
        assert f"WARC-Type: {r['type']}\r\n" in head and f"WARC-Record-ID: {r['id']}\r\n" in head
    first = {}
    for i, _, h in sorted(rows, key=lambda r: r[0]):
        first.setdefault(h or "", i)
    for i, _, h in rows:
        data, r = (h or "").encode(), got[i]
        assert r["size"] == len(data) and r["digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        if first[h or ""] == i:
            assert r["record_type"] == "response" and bytes(r["payload"]) == data and r["refers_to"] is None
        else:
            assert r["record_type"] == "revisit" and r["payload"] is None and r["refers_to"] == f"<urn:page:{first[h or '']}>"
    names = sorted(p.name for p in (tmp_path / "members").iterdir())
    assert any(n.endswith(".idx") for n in names) and not any(".warc.gz." in n and not n.endswith(".idx") for n in names)
    for n in names:  # the members joined are the archive that was whole
        if n.endswith(".gz"):
            assert gzip.open(tmp_path / "members" / n).read() == gzip.open(tmp_path / "whole" / n).read()
    warc.normalise(warc.write(df.limit(0), f"{folder}/none"), f"{folder}/none2")
    assert warc.read(warc.index(spark, f"{folder}/none2")).count() == 0
    assert warc.with_revisits(df, "page_id", "html", min_bytes=3).where("revisit").count() == 1


def test_toxicity(spark):
    rng = random.Random(4)
    words = ["ber", "ta", "lin", "go", "sta", "mer", "ro", "ne"]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(words) for _ in range(n))
    rows = [(i, text(rng.randrange(5, 200)) + (f" you zumpf{rng.choice(words)} " if i % 4 == 0 else " ") + text(20), int(i % 4 == 0)) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.train(df.where("doc_id < 600"), F.col("doc_id") >= 500)
    more = spark.createDataFrame([(1000, None, None), (1001, "", None), (1002, "zumpf" + "x" * 100_000, None)], df.schema)
    out = {r["doc_id"]: r for r in toxicity.score(df.where("doc_id >= 600").union(more), model, keep=["toxic"]).collect()}
    assert np.mean([r["predicted"] == r["toxic"] for i, r in out.items() if i < 1000]) > 0.97
    assert out[1000]["score"] == out[1001]["score"] < 0.5 and all(0 <= r["score"] <= 1 for r in out.values())
    assert toxicity.reject(df, model).count() < 650
    assert {r["score"] for r in toxicity.score(df, toxicity.train(df.where("toxic = 0"), F.lit(False))).collect()} == {0.0}
    assert toxicity.score(df.limit(0), toxicity.train(df.limit(0), F.lit(False))).count() == 0


def test_toxicity_backs_off_as_it_learned(spark):
    """Log-ratios against the models worked out gram by gram, also for grams that no labelled text has."""
    taught = [("you zumpf there", 1), ("the zumpf", 1), ("you there", 0), ("the other one there", 0)]
    model = toxicity.train(spark.createDataFrame(taught * 200, "text string, toxic int"), F.lit(False))
    shared = {r["g"]: r["p"] for r in toxicity._shared(toxicity.gram_counts(spark.createDataFrame(taught, "text string, toxic int"))).collect()}
    n = [{}, {}]
    for t, c in taught * 200:
        padded = " " * 5 + t
        for i in range(5, len(padded)):
            for size in range(3, 7):
                of = n[c].setdefault(padded[i - size + 1 : i], {})
                of[padded[i]] = of.get(padded[i], 0) + 1

    def both(gram):
        """Kneser-Ney of both classes together."""
        if len(gram) == toxicity.SHARED:
            return shared.get(int.from_bytes(gram.encode(), "big"), 1e-9)
        of = {k: sum(m.get(gram[:-1], {}).get(k, 0) for m in n) for m in n for k in m.get(gram[:-1], {})}
        if not of:
            return both(gram[1:])
        return (max(of.get(gram[-1], 0) - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * len(of) * both(gram[1:])) / sum(of.values())

    def ratio(c, gram):
        if len(gram) == toxicity.SHARED:
            return 1.0
        of = n[c].get(gram[:-1], {})
        own = of.get(gram[-1], 0)
        return ((own / both(gram) if own else 0) + toxicity.PRIOR * ratio(c, gram[1:])) / (sum(of.values()) + toxicity.PRIOR)

    for t in ("my oldzumpfer", "qq zum", "you zumpf there"):
        padded, data = " " * 5 + t, np.frombuffer(t.encode(), np.uint8)
        grams = [padded[i : i + 6] for i in range(len(t))]
        want = [np.log(ratio(1, g) / ratio(0, g)) for g in grams]
        assert model.ratios(vectext.grams(data, np.array([0, len(t)]), toxicity.ORDER)) == pytest.approx(want, abs=1e-4)
    known, new = model.comparisons(pa.array(["qqzumpf", "qqqqqqq"]))
    assert known[0] > new[0]  # no 6-gram of either was seen


def test_toxicity_weighs_passages_by_length():
    """One strong passage in a short and in a long text, and none; against passages summed one by one."""
    key = int.from_bytes(b"zumpf ", "big")
    model = toxicity.Model({(6, False): (np.array([key]), np.array([4.0]))})
    short, long, none, empty = model.comparisons(pa.array(["a zumpf b", "a zumpf b" + " c" * 500, "a b", None]))
    assert short[0] == long[0] == 4 and none[0] == empty[0] == 0
    ratios = [0.0] * 7 + [4.0, 0.0]
    passages = [sum(ratios[i : i + toxicity.PASSAGE]) for i in range(9)]
    assert short[1] == pytest.approx(np.log(sum(max(x - 1, 0) for x in passages) / (9 + toxicity.BESIDE) + 1e-3))
    assert short[2] == pytest.approx(np.log(sum(x > 3 for x in passages) / (9 + toxicity.BESIDE) + 1e-3))
    assert short[3] == pytest.approx(np.log((sum(map(np.exp, passages)) + toxicity.BESIDE_RATIO) / (9 + toxicity.BESIDE_RATIO)))
    assert (short[1:] > long[1:]).all() and empty[3] == 0


def test_toxicity_tables_beyond_a_broadcast_stay_whole(spark, monkeypatch):
    rng = random.Random(6)
    text = lambda toxic: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(20)) + (" zumpf" if toxic else "")
    df = spark.createDataFrame([(i, text(i % 3 == 0), int(i % 3 == 0)) for i in range(300)], "doc_id bigint, text string, toxic int")
    small = toxicity.train(df, F.lit(False))
    monkeypatch.setattr(toxicity, "BROADCAST_ENTRIES", 100)
    monkeypatch.setattr(toxicity, "PACKED", 1000)
    large = toxicity.train(df, F.lit(False))
    assert large.files and not small.files
    assert {k: b - a for k, (a, b) in large.files.spans.items()} == {k: len(grams) for k, (grams, _) in small.tables.items()}
    scores = [sorted(toxicity.score(df, m).select("doc_id", "score").collect()) for m in (small, large)]
    assert scores[0] == scores[1] and sum(s > 0.5 for _, s in scores[0]) == 100
    assert toxicity.reject(df, large).count() == 200


def test_language(spark):
    rng = random.Random(4)
    said = {"aa": ["kala", "malo", "tiki", "nano"], "bb": ["schlacht", "grund", "wurm"], "ç": ["łódź", "żółw"]}
    rows = [(i, " ".join(rng.choice(said[k]) for _ in range(rng.randrange(1, 40))), k) for i in range(300) for k in said]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.train(df.where("doc_id < 200"))
    test = df.where("doc_id >= 200").union(spark.createDataFrame([(900, None, "und"), (901, "", "und"), (902, "12 -!", "und"), (903, "kala " * 30_000, "aa")], df.schema))
    out = language.predict(test.withColumnRenamed("lang", "score"), model).collect()
    want = {(r["doc_id"], r["text"]): r["lang"] for r in test.collect()}
    assert len(out) == len(test.collect()) and sum(r["lang_pred"] != "und" for r in out) == 301
    joined = language.predict(test.withColumn("doc_id", F.struct("doc_id", "text")), model).collect()
    assert all(want[tuple(r["doc_id"])] == r["lang_pred"] and 0 <= r["score"] <= 1 for r in joined)
    assert {r["lang_pred"] for r in language.predict(df, language.train(df.where("lang is null"))).collect()} == {"und"}
    assert language.predict(df.limit(0), model).count() == 0


def test_language_learns_each_text_once(spark):
    """A text copied so often that it is most rows of a language neither hides the others nor outweighs them."""
    rows = [("aa", f"kala malo tiki {i} nano") for i in range(4)] + [("aa", " ".join(["tiki", "nano", "malo"] * i)) for i in range(1, 17)] + [("bb", "schlacht grund " + "wurm " * i) for i in range(20)]
    few = spark.createDataFrame(rows, "lang string, text string")
    many = few.union(spark.range(4000).select(F.lit("aa"), F.lit("kala kala kala")))
    once = few.union(spark.createDataFrame([("aa", "kala kala kala")], few.schema))
    a, b = language.train(many, sample_docs=5), language.train(once, sample_docs=5)
    texts = pa.array(["kala nano", "grund wurm", "tiki tiki"])
    assert a.langs == b.langs == ["aa", "bb"] and (a.costs(texts) == b.costs(texts)).all()


def test_ppm_costs_are_exact():
    """Against a tree walked byte by byte."""
    texts = {"a": "abracadabra abra", "b": "banana band"}
    langs, of, keys, counts = sorted(texts), [], [], []
    for k, name in enumerate(sorted(texts)):
        data = vectext.letters(np.frombuffer(texts[name].encode(), np.uint8))
        found, n = np.unique(vectext.grams(data, np.array([0, len(data)]), language.DEPTH), return_counts=True)
        of += [k] * len(found)
        keys += found.tolist()
        counts += n.tolist()
    model = language.Model(langs, np.array(of), np.array(keys, np.uint64), np.array(counts))

    def bits(train, text):
        tree = {}
        padded = " " * 4 + train
        for i in range(4, len(padded)):
            for d in range(5):
                tree.setdefault(padded[i - d : i], {}).setdefault(padded[i], 0)
                tree[padded[i - d : i]][padded[i]] += 1
        total, padded = 0.0, " " * 4 + text
        for i in range(4, len(padded)):
            for d in range(4, -2, -1):
                if d < 0:
                    total += 8
                    break
                seen = tree.get(padded[i - d : i])
                if seen is None:
                    continue
                n = sum(seen.values()) + len(seen)
                if padded[i] in seen:
                    total -= np.log2(seen[padded[i]] / n)
                    break
                total -= np.log2(len(seen) / n)
        return total

    for text in ("abra band", "zzz", "cadabana", ""):
        assert model.costs(pa.array([text]))[0] == pytest.approx([bits(texts[x], text) for x in langs], rel=1e-5)


def test_quality(spark):
    rng = random.Random(4)
    good = lambda: ". ".join("Then " + " ".join(rng.choice(("river", "stone", "walks", "under", "light")) for _ in range(9)) for _ in range(6)) + "."
    bad = lambda: "\n".join(["BUY##$$ NOW!! 55555 | click"] * rng.randrange(4, 20))
    df = spark.createDataFrame([(i, good() if i % 3 else bad(), "x") for i in range(600)] + [(900, None, "x"), (901, "", "x"), (901, "", "x")], "doc_id bigint, text string, score string")
    out = quality.classify(df).collect()
    assert len(out) == 603
    assert np.mean([r["predicted"] == (r["doc_id"] % 3 > 0) for r in out if r["doc_id"] < 900]) > 0.97
    assert quality.classify(df.limit(0)).count() == 0


def test_label_model_equals_brute_force():
    """One round of expectation-maximisation, text by text; and accuracies found again from votes drawn with known ones."""
    rng = np.random.default_rng(3)
    patterns = np.array([[1, -1, 0], [0, 0, -1], [1, 1, 1], [-1, 0, 0]])
    counts = np.array([3.0, 2.0, 5.0, 1.0])
    model = quality.LabelModel(patterns, counts, rounds=1)
    start = quality.LabelModel(patterns, counts, rounds=0)
    texts = [p for p, n in zip(patterns, counts, strict=True) for _ in range(int(n))]
    weight = []
    for p in texts:
        good, bad = start.share, 1 - start.share
        for k, v in enumerate(p):
            good *= start.rates["good"][k][v + 1]
            bad *= start.rates["bad"][k][v + 1]
        weight.append(good / (good + bad))
    assert model.share == pytest.approx(sum(weight) / len(texts))
    for k in range(3):
        for v in (-1, 0, 1):
            seen = sum(w for p, w in zip(texts, weight, strict=True) if p[k] == v)
            assert model.rates["good"][k][v + 1] == pytest.approx((seen + 0.1) / (sum(weight) + 0.3))
    truth = rng.random(4000) < 0.7
    right = [0.9, 0.8, 0.7, 0.85]
    votes = np.stack([np.where(rng.random(4000) < a, truth, ~truth) for a in right], axis=1).astype(int)
    found, n = np.unique(votes, axis=0, return_counts=True)
    assert quality.LabelModel(found, n.astype(float)).accuracy() == pytest.approx(right, abs=0.05)


def test_places_finds_every_key():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 40, 50_000, dtype=np.uint64))
    places = vectext.Places(keys)
    assert (places.find(keys) == np.arange(len(keys))).all()
    assert (places.find(keys + np.uint64(1 << 41)) == -1).all()


def test_words_do_not_cross_rows():
    inside = vectext.spaced((0x20, 0x20))
    data, starts = vectext.text_bytes(pa.array(["ab cd", None, "", "ab", "b cd ab"]))
    hashes, at = vectext.words(data, starts, inside)
    assert at.tolist() == [0, 2, 2, 2, 3, 6] and hashes[0] == hashes[2] == hashes[5] and hashes[1] == hashes[4] and len(set(hashes.tolist())) == 3
