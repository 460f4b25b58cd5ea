"""Fill-in-middle transformation by a numpy kernel over the UTF-8 buffer of a whole Arrow batch.

A text is a row of units: `[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+`, or the white space that ends it. Bytes are classed by a
table; a unit ends where a byte and the next differ in class (or the document ends), and running sums of those ends, set
back at each document, number the units, so one binary search finds the cuts of all rows at once. The pieces of all rows
are then copied in their new order by one gather. A hash of seed and id draws cuts and form, so a row's result depends on
nothing else.

Forms: plain (the text), psm (P prefix S suffix M middle), spm (S suffix P prefix M middle), by three marks. restore()
rebuilds the exact text from output and form: texts that hold a mark stay plain, and no mark's end begins a mark, so a
mark in an output is one that was put there.

Defined cases: null counts as empty; empty texts, and those that hold a mark, are plain; a null id is drawn as the empty
string; equal ids draw equal numbers, repeated rows equal results; an empty table gives an empty result; columns of docs
that bear a result's name come back as kept_<name>, further columns untouched. A text that is no output of its form is an
error in restore()."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sottovoce.llm import vectext
from sottovoce.llm.common import clear_of, prepare, table

MARKS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Of a hundred rows so many are cut, and of a hundred of those so many begin with the suffix.
RATE, SPM_RATE = 50, 80

_GAP = ~vectext.spaced((0x20, 0x20), (0x09, 0x0D))
_RESULT = "n long, form string, prefix_chars long, middle_chars long, output string"


def _check(marks: tuple[str, str, str]) -> list[np.ndarray]:
    raw = [m.encode() for m in marks]
    if len(set(raw)) < 3 or not all(raw) or any((a != b and a in b) or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))) for a in raw for b in raw):
        raise ValueError(f"marks must be three different ones, of which none's end begins one: {marks}")
    return [np.frombuffer(m, np.uint8) for m in raw]


def unit_ends(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many units end up to each byte, and how many do before each row starts (one more than rows)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(starts), np.int64)
    gap = _GAP[data]
    ends = np.empty(len(data), bool)
    ends[:-1] = ~gap[:-1] & gap[1:]
    ends[starts[1:][np.diff(starts) > 0] - 1] = True
    done = np.cumsum(ends)
    return done, np.concatenate([[0], done])[starts]


def places(data: np.ndarray, starts: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a mark stands within one row: positions and rows, rising."""
    m = len(mark)
    hit = np.ones(max(len(data) - m + 1, 0), bool)
    for k in range(m):
        hit &= data[k : k + len(hit)] == mark[k]
    at = np.flatnonzero(hit)
    row = np.searchsorted(starts, at, side="right") - 1
    inside = at + m <= starts[row + 1]
    return at[inside], row[inside]


def gather(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The pieces of data that begin at `at` and have the sizes given, one after the other."""
    before = np.cumsum(size) - size
    return data[np.repeat(at - before, size) + np.arange(int(size.sum()))]


def _strings(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """A string array of (bytes, sizes of the rows) blocks."""
    sizes = np.concatenate([s for _, s in parts]) if parts else np.zeros(0, np.int64)
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    body = np.concatenate([b for b, _ in parts]) if parts else np.zeros(0, np.uint8)
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets.tobytes()), pa.py_buffer(body.tobytes())).cast(pa.string())


def arranged(column: pa.Array, draws: list[np.ndarray], marks: tuple[str, str, str] = MARKS, rate: int = RATE, spm_rate: int = SPM_RATE) -> pa.StructArray:
    """n, form, prefix_chars, middle_chars and output of each text; draws: four arrays of unsigned integers."""
    raw = _check(marks)
    numbers: list[list[np.ndarray]] = [[], [], [], []]
    outputs = []
    for row, data, starts in vectext.blocks(*vectext.text_bytes(column)):
        h1, h2, h3, h4 = (d[row : row + len(starts) - 1] for d in draws)
        first, last = starts[:-1], starts[1:]
        done, before = unit_ends(data, starts)
        n = np.diff(before)
        marked = np.zeros(len(n), bool)
        for m in raw:
            marked[places(data, starts, m)[1]] = True
        plain = (n == 0) | marked | (h3 % 100 >= rate)
        spm = ~plain & (h4 % 100 < spm_rate)
        a, b = h1 % (n + 1), h2 % (n + 1)
        cut = [np.where(k > 0, np.searchsorted(done, before[:-1] + k) + 1, first) for k in (np.minimum(a, b), np.maximum(a, b))]
        lead = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
        # the marks stand behind the texts in one buffer, so that all pieces come from there
        base = len(data) + np.cumsum([0, *map(len, raw)])
        marks_at = [np.full(len(n), base[k]) for k in range(3)]
        prefix, middle, suffix = (first, cut[0] - first), (cut[0], cut[1] - cut[0]), (cut[1], last - cut[1])
        p, s, m = ((marks_at[k], np.full(len(n), len(raw[k]))) for k in range(3))
        pieces = []
        for of_psm, of_spm in ((p, s), (prefix, suffix), (s, p), (suffix, prefix), (m, m), (middle, middle)):
            pieces.append([np.where(spm, y, x) for x, y in zip(of_psm, of_spm, strict=True)])
        at, size = (np.stack([piece[k] for piece in pieces], axis=1) for k in range(2))
        size[plain] = 0
        at[plain, 0], size[plain, 0] = first[plain], (last - first)[plain]
        outputs.append((gather(np.concatenate([data, *raw]), at.ravel(), size.ravel()), size.sum(1)))
        for kept, x in zip(numbers, (n, np.where(plain, 0, np.where(spm, 2, 1)), np.where(plain, -1, lead[cut[0]] - lead[first]), np.where(plain, -1, lead[cut[1]] - lead[cut[0]])), strict=True):
            kept.append(x)
    n, form, before, between = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in numbers)
    forms = pa.array(np.array([PLAIN, PSM, SPM], object)[form], pa.string())
    chars = [pa.array(x, pa.int64(), mask=x < 0) for x in (before, between)]
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), forms, *chars, _strings(outputs)], ["n", "form", "prefix_chars", "middle_chars", "output"])


def restored(outputs: pa.Array, forms: pa.Array, marks: tuple[str, str, str] = MARKS) -> pa.Array:
    """The texts that outputs of the given forms were made of."""
    raw = _check(marks)
    form = np.asarray(forms.to_pandas(), object)
    texts = []
    for row, data, starts in vectext.blocks(*vectext.text_bytes(outputs)):
        kind = form[row : row + len(starts) - 1]
        cut = np.flatnonzero(kind != PLAIN)
        first, last = starts[:-1], starts[1:]
        at, size = np.stack([first] * 3, axis=1), np.zeros((len(kind), 3), np.int64)
        size[:, 0] = last - first
        found = []
        for m in raw:
            where, which = places(data, starts, m)
            ours = kind[which] != PLAIN
            if not np.array_equal(which[ours], cut):
                raise ValueError("an output must hold each mark once")
            found.append(where[ours])
        p, s, m = found
        p_end, s_end, m_end = (x + len(r) for x, r in zip(found, raw, strict=True))
        psm = kind[cut] == PSM
        if not (np.where(psm, (p == first[cut]) & (p_end <= s) & (s_end <= m), (s == first[cut]) & (s_end <= p) & (p_end <= m)).all() and (psm | (kind[cut] == SPM)).all()):
            raise ValueError("the marks of an output must stand as its form has them")
        at[cut] = np.stack([p_end, m_end, s_end], axis=1)
        size[cut] = np.stack([np.where(psm, s, m) - p_end, last[cut] - m_end, np.where(psm, m, p) - s_end], axis=1)
        texts.append((gather(data, at.ravel(), size.ravel()), size.sum(1)))
    return _strings(texts)


def draws(id_: Column, seed: int) -> list[Column]:
    """The first four 8-digit groups of the hex SHA-256 of seed:id, as integers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, marks: tuple[str, str, str] = MARKS, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """docs with n (units), form, prefix_chars, middle_chars (code points; null where plain) and output."""
    _check(marks)
    prepare(docs.sparkSession)

    @F.arrow_udf(_RESULT)
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        from sottovoce.llm import fim

        for text, *hs in batches:
            yield fim.arranged(text, [h.to_numpy(zero_copy_only=False) for h in hs], marks, rate, spm_rate)

    names = [x.split(" ")[0] for x in _RESULT.split(", ")]
    wide, of = clear_of(docs, "_fim", *names)
    wide = wide.withColumn("_fim", run(F.coalesce(of(text_col), F.lit("")), *draws(of(id_col), seed)))
    return wide.select(*[F.col(f"`{c}`") for c in wide.columns[:-1]], *[F.col("_fim")[n].alias(n) for n in names])


def restore(outputs: DataFrame, output_col: str = "output", form_col: str = "form", text_col: str = "restored", marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """outputs with the exact texts they were made of."""
    _check(marks)
    prepare(outputs.sparkSession)

    @F.arrow_udf("string")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        from sottovoce.llm import fim

        for output, form in batches:
            yield fim.restored(output, form, marks)

    clear, of = clear_of(outputs, text_col)
    return clear.withColumn(text_col, run(of(output_col), of(form_col)))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = restore(transform(table(spark, sf_dir, "documents").select("doc_id", "text")))
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output").alias("output_sha256"), sha("restored").alias("restored_sha256"))


def op11_sql() -> str:
    space, other = "[\\x20\\x09-\\x0D]", "[^\\x20\\x09-\\x0D]"
    digits = ", ".join(f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT) AS h{k + 1}" for k in range(4))
    return f"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
b AS (SELECT doc_id, t, regexp_extract_all(t, '{space}*{other}+|{space}+') AS u, {digits} FROM a),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS i, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS j,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM b),
d AS (SELECT *, array_to_string(u[1:i], '') AS p, array_to_string(u[i + 1:j], '') AS m, array_to_string(u[j + 1:], '') AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM d
"""
