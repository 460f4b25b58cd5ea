import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from sottovoce.llm import fim

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def brute(i, text, marks=fim.MARKS, rate=50, spm=80, seed=42):
    t, (P, S, M) = text or "", marks
    u = UNIT.findall(t)
    digest = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not t or any(m in t for m in marks) or h[2] % 100 >= rate:
        return len(u), "plain", None, None, t
    a, b = sorted(x % (len(u) + 1) for x in h[:2])
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h[3] % 100 < spm:
        return len(u), "spm", len(p), len(m), f"{S}{s}{P}{p}{M}{m}"
    return len(u), "psm", len(p), len(m), f"{P}{p}{S}{s}{M}{m}"


def rows():
    rng = random.Random(7)
    parts = ["a", "Bc", "é", "日本", " x", "<", "P>", "<S", ">", "𝄞", " ", "  ", "\n", "\t\x0b", "\x0d", "\x0c", "\x1f", "\x00"]
    out = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(60)))) for i in range(400)]
    out += [(400, None), (401, ""), (402, " "), (403, "x"), (404, "a <M> b"), (None, "null id here"), (None, None), (7, "again and again"), (7, "again and again"), (-5, "less than none")]
    return out + [(500 + k, "long é " * 200_000 + str(k)) for k in range(4)]


COLUMNS = ("n", "form", "prefix_chars", "middle_chars", "output", "restored")


@pytest.mark.parametrize("rate", [50, 100])
def test_equals_brute_force_and_comes_back(spark, rate):
    data = rows()
    df = spark.createDataFrame(data, "doc_id bigint, text string").repartition(3)
    got = sorted(((r["doc_id"], r["text"], *(r[c] for c in COLUMNS)) for r in fim.restore(fim.transform(df, rate=rate)).collect()), key=repr)
    assert got == sorted(((i, t, *brute(i, t, rate=rate), t or "") for i, t in data), key=repr)
    assert {r[3] for r in got} == {"plain", "psm", "spm"}


def test_other_marks_and_seed(spark):
    marks = ("[[prefix", "[[suffix", "[[mid")
    data = rows()[:200]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    got = sorted((r["doc_id"], *(r[c] for c in COLUMNS[:5])) for r in fim.transform(df, seed=9, marks=marks, rate=90, spm_rate=10).collect())
    assert got == sorted((i, *brute(i, t, marks, 90, 10, 9)) for i, t in data)


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("", "b", "c"), ("aba", "c", "d"), ("ab", "bc", "d"), ("xPy", "P", "q")])
def test_marks_that_could_be_mistaken(spark, marks):
    with pytest.raises(ValueError):
        fim.transform(spark.createDataFrame([(1, "x")], "doc_id bigint, text string"), marks=marks)


@pytest.mark.parametrize("output, form", [("<P>a<S>b", "psm"), ("<P>a<S>b<M>c<M>", "psm"), ("<S>a<P>b<M>c", "psm"), ("x<P>a<S>b<M>c", "psm"), ("<P>a<S>b<M>c", "other")])
def test_malformed_outputs(output, form):
    with pytest.raises(ValueError):
        fim.restored(pa.array(["fine", output]), pa.array(["plain", form]))


def test_clashing_names_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "some text", "v", 2, "w", "z", "q")], "doc_id bigint, output string, N string, _fim int, kept_n string, restored string, `a.b` string")
    out = fim.restore(fim.transform(df, text_col="output", rate=100))
    (r,) = out.collect()
    assert (r["kept_output"], r["kept_kept_N"], r["kept__fim"], r["kept_n"], r["kept_restored"], r["a.b"], r["restored"]) == ("some text", "v", 2, "w", "z", "q", "some text")
    assert out.columns[-6:] == list(COLUMNS) and fim.restore(fim.transform(df.limit(0), text_col="output")).count() == 0


def test_pieces_do_not_cross_rows():
    data, starts = np.frombuffer(b"a<P>b<", np.uint8), np.array([0, 2, 5, 6])
    assert fim.places(data, starts, np.frombuffer(b"<P>", np.uint8))[0].tolist() == []
