"""Quality rules: base rules of a text, and how far its histograms stand from those of its language.

Two histograms of a text, of character classes and of the common words of its language, are compared to the language's own
by Jensen-Shannon distance. The references are the mean histograms of the distinct texts of the whole corpus that pass the
base rules: a text that stands there a thousand times weighs once, and a long one no more than a short one. Shares are
counted in millionths, so that sums do not depend on their order. A word is common when its mean share is at least
1/COMMON; so a language has at most COMMON of them, and only they and the class shares come to the driver.

Guards: chance alone sets a short text's histogram off, by about (bins - 1) / (8 n ln 2) in squared distance, so the limit
gives way by NOISE times that; texts of fewer than MIN_WORDS words fail the base rules and are not compared; a language
with fewer than MIN_REFERENCE such texts is no reference. Its texts, and those without a language, are held against the nearest
of all references; without any reference the base rules alone decide.

Defined cases: null counts as empty, and an empty text fails the base rules; ids may be null or repeat; rows that repeat get
equal results; an empty table gives an empty result; further columns are not looked at. Words, lines and windows of words
are told apart by 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sottovoce.llm import vectext
from sottovoce.llm.common import flagged, materialise, prepare, table

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 50, 50, 3
COMMON, MIN_REFERENCE = 200, 20
#: A share of 1.
UNIT = 1_000_000
#: Limits of the squared distances (of class and word histograms), and what chance is allowed.
CLASS_LIMIT, WORD_LIMIT, NOISE = 0.09, 0.05, 1.5

SYMBOLS = "#*$%&|<>"
_SPACE = ~vectext.spaced((0x20, 0x20), (0x09, 0x0D))
_WORD = ~_SPACE
_LINE = vectext.spaced((0x0A, 0x0A))
_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS.encode(), np.uint8))
#: Words of the histograms end at marks too.
MARKS = ".,;:!?\"'()"
_TOKEN = _WORD & ~np.isin(np.arange(256), np.frombuffer(MARKS.encode(), np.uint8))
#: Classes: small and capital letters, digits, white space, marks, other signs, all beyond ASCII; -1 is no first byte.
CLASSES = 7
#: Rows that references() gathers: 0 for a word, 1 to CLASSES for a class, and this for the number of texts with a word.
TEXTS = CLASSES + 1
_CLASS = np.full(256, 6, np.int8)
_CLASS[:128] = 5
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[_SPACE], _CLASS[np.frombuffer(MARKS.encode(), np.uint8)] = 3, 4
_CLASS[0x80:0xC0] = -1

_BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_RESULT = f"{_BASE}, base_failed boolean, kept boolean, class_distance double, word_distance double"


def _again(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occurred before in their row, and which occur there more than once."""
    order = np.lexsort((np.arange(len(keys)), keys, rows))
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = (keys[order][1:] == keys[order][:-1]) & (rows[order][1:] == rows[order][:-1])
    earlier, often = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    earlier[order] = same[:-1]
    often[order] = same[:-1] | same[1:]
    return earlier, often


def base(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each row."""
    rows = len(starts) - 1
    out = np.zeros((rows, 5), np.int64)
    if not len(data):
        return out
    of = lambda at: np.searchsorted(starts, at, side="right") - 1
    count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[starts])
    at, to = vectext.runs(data, starts, _WORD)
    row, hashes = of(at), vectext.run_hashes(data, at, to)
    out[:, 0] = np.bincount(row, minlength=rows)
    out[:, 1] = count(_WORD[data] & ((data & 0xC0) != 0x80))
    out[:, 2] = count(_SYMBOL[data])
    begin, end = vectext.runs(data, starts, _LINE)
    full = np.concatenate([[0], np.cumsum(_WORD[data])])
    full = full[end + 1] > full[begin]
    begin, end = begin[full], end[full]
    earlier, _ = _again(of(begin), vectext.run_hashes(data, begin, end))
    out[:, 3] = np.bincount(of(begin)[earlier], minlength=rows)
    n = len(hashes) - WINDOW + 1
    if n > 0:
        grams = np.zeros(n, np.uint64)
        for k in range(WINDOW):
            grams = grams * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
        inside = np.flatnonzero(row[:n] == row[WINDOW - 1 :])
        _, often = _again(row[inside], vectext.mix(grams[inside]))
        covered = np.zeros(len(hashes), bool)
        for k in range(WINDOW):
            covered[inside[often] + k] = True
        out[:, 4] = np.bincount(row[covered], minlength=rows)
    return out


def failed(counts: np.ndarray, min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT_PERCENT) -> np.ndarray:
    """Whether the base rules reject a row of base()."""
    return (counts[:, 0] < min_words) | (100 * counts[:, 4] > max_repeat * counts[:, 0])


def classes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many characters of each class a row has."""
    kind = _CLASS[data]
    lead = np.flatnonzero(kind >= 0)
    row = np.searchsorted(starts, lead, side="right") - 1
    return np.bincount(row * CLASSES + kind[lead], minlength=(len(starts) - 1) * CLASSES).reshape(-1, CLASSES)


def tokens(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows and hashes (A-Z lower-cased) of the words that the histograms count."""
    hashes, at = vectext.words(vectext.fold(data), starts, _TOKEN)
    return np.repeat(np.arange(len(starts) - 1), np.diff(at)), hashes


def divergence(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """The squared Jensen-Shannon distance (bits, 0 to 1) of each row of counts to the reference; 0 for a row without counts."""
    sums = counts.sum(1, keepdims=True)
    p, q = counts / np.maximum(sums, 1), reference / max(reference.sum(), 1)
    m = (p + q) / 2
    part = lambda x: np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0).sum(1)
    return np.where(sums[:, 0] > 0, np.clip((part(p) + part(np.broadcast_to(q, p.shape))) / 2, 0, 1), 0)


@dataclass
class Reference:
    """A language's shares, summed over its texts: of classes, of its common words by hash, and of all words."""

    classes: np.ndarray
    words: np.ndarray
    counts: np.ndarray
    total: int
    table: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        order = np.argsort(self.words)
        self.words, self.counts = self.words[order], self.counts[order]
        self.table = np.append(self.counts, self.total - self.counts.sum()).astype(float)

    def histogram(self, rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
        """Of each of n rows, how often it has each common word, and others."""
        place = np.searchsorted(self.words, hashes)
        found = place < len(self.words)
        found[found] = self.words[place[found]] == hashes[found]
        wide = len(self.table)
        return np.bincount(rows * wide + np.where(found, place, wide - 1), minlength=n * wide).reshape(n, wide)


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", common: int = COMMON, min_reference: int = MIN_REFERENCE, min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT_PERCENT) -> dict[str, Reference]:
    """The references of all languages of docs, counted over the distinct texts that pass the base rules.

    Only texts that occur again move, once a task."""
    prepare(docs.sparkSession)
    slim = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    keyed = slim.withColumn("key", F.xxhash64("lang", "text"))
    again = materialise(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "again")
    parted = flagged(keyed, "key", again, "again")
    once = parted.where("not again").select("lang", "text")
    distinct = parted.where("again").groupBy("key", "lang").agg(F.first("text").alias("text")).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sottovoce.llm import rules

        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            names, code = langs.dictionary, langs.indices.to_numpy(zero_copy_only=False)
            for row, data, starts in vectext.blocks(*vectext.text_bytes(batch.column("text"))):
                n = len(starts) - 1
                lang = code[row : row + n]
                good = ~rules.failed(rules.base(data, starts), min_words, max_repeat)
                kinds = rules.classes(data, starts)
                rows, hashes = rules.tokens(data, starts)
                held = np.bincount(rows, minlength=n)
                order = np.lexsort((hashes, rows))
                of, hashes = rows[order], hashes[order]
                new = np.ones(len(of), bool)
                new[1:] = (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])
                new = np.flatnonzero(new)
                counts = np.diff(np.append(new, len(of)))
                new, counts = new[good[of[new]]], counts[good[of[new]]]
                texts = np.flatnonzero(good)
                shares = [counts * rules.UNIT // held[of[new]], (kinds[texts] * rules.UNIT // np.maximum(kinds[texts].sum(1, keepdims=True), 1)).ravel(), (held[texts] > 0).astype(np.int64)]
                kind = [np.zeros(len(new), np.int32), np.tile(np.arange(1, rules.CLASSES + 1, dtype=np.int32), len(texts)), np.full(len(texts), rules.TEXTS, np.int32)]
                word = [hashes[new].view(np.int64), np.zeros(len(texts) * (rules.CLASSES + 1), np.int64)]
                row_of = np.concatenate([of[new], np.repeat(texts, rules.CLASSES), texts])
                table = pa.table([pa.array(lang[row_of]), pa.array(np.concatenate(kind)), pa.array(np.concatenate(word)), pa.array(np.concatenate(shares))], ["lang", "kind", "word", "n"])
                table = table.group_by(["lang", "kind", "word"]).aggregate([("n", "sum")]).combine_chunks()
                if table.num_rows:
                    yield pa.RecordBatch.from_arrays([names.take(table["lang"].chunk(0)), *(table[c].chunk(0) for c in ("kind", "word", "n_sum"))], ["lang", "kind", "word", "n"])

    counted = once.unionByName(distinct).mapInArrow(run, "lang string, kind int, word long, n long").groupBy("lang", "kind", "word").agg(F.sum("n").alias("n"))
    counted = materialise(counted, "counted")
    totals = counted.where((F.col("kind") == TEXTS) & (F.col("n") >= min_reference)).select("lang", (F.col("n") * UNIT).alias("total"))
    kept = counted.join(F.broadcast(totals), "lang").where((F.col("kind") > 0) | (F.col("n") * common >= F.col("total")))
    found: dict[str, list] = {}
    for r in kept.collect():  # a language has at most COMMON + TEXTS rows
        found.setdefault(r["lang"], []).append(r)
    out = {}
    for lang, rows in sorted(found.items()):
        kinds, words = {r["kind"]: r["n"] for r in rows if r["kind"]}, [r for r in rows if not r["kind"]]
        out[lang] = Reference(np.array([kinds.get(k + 1, 0) for k in range(CLASSES)], float), np.array([r["word"] for r in words], np.int64).view(np.uint64), np.array([r["n"] for r in words], np.int64), rows[0]["total"])
    return out


def verdicts(column: pa.Array, langs: list, known: dict[str, Reference], min_words: int, max_repeat: int, limits: tuple[float, float], noise: float) -> pa.StructArray:
    """The rows of _RESULT for texts and their languages."""
    parts: list[list[np.ndarray]] = []
    for row, data, starts in vectext.blocks(*vectext.text_bytes(column)):
        n = len(starts) - 1
        counts, kinds = base(data, starts), classes(data, starts)
        bad = failed(counts, min_words, max_repeat)
        rows, hashes = tokens(data, starts)
        held = np.bincount(rows, minlength=n)
        near = np.full((n, 2), np.nan)  # the distances to the nearest reference, and how far they exceed what is allowed
        excess = np.full(n, np.inf)
        of = langs[row : row + n]
        for name, ref in known.items():
            ours = ~bad & np.array([x == name or x not in known for x in of])
            if not ours.any():
                continue
            pick = ours[rows]
            new = np.cumsum(ours) - 1
            words = ref.histogram(new[rows[pick]], hashes[pick], int(ours.sum()))
            d = np.stack([divergence(kinds[ours], ref.classes), divergence(words, ref.table)], axis=1)
            chance = lambda bins, size: noise * (bins - 1) / (8 * np.log(2) * np.maximum(size, 1))
            over = np.maximum(d[:, 0] - limits[0] - chance(CLASSES, kinds[ours].sum(1)), d[:, 1] - limits[1] - chance(len(ref.table), held[ours]))
            at = np.flatnonzero(ours)
            closer = over < excess[at]
            excess[at[closer]], near[at[closer]] = over[closer], np.sqrt(d[closer])
        parts.append([*counts.T, bad, ~bad & ((excess <= 0) | np.isinf(excess)), near[:, 0], near[:, 1]])
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
    names = [x.split(" ")[0] for x in _RESULT.split(", ")]
    columns = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in range(len(names))]
    return pa.StructArray.from_arrays([pa.array(c, t, mask=np.isnan(c) if t == pa.float64() else None) for c, t in zip(columns, kinds, strict=True)], names)


def judge(docs: DataFrame, known: dict[str, Reference] | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT_PERCENT,
          class_limit: float = CLASS_LIMIT, word_limit: float = WORD_LIMIT, noise: float = NOISE) -> DataFrame:
    """A row per document: id, the base counts, base_failed, kept, and class_distance and word_distance to the reference
    (null where there was nothing to compare). known: references of another corpus; by default those of docs."""
    spark = docs.sparkSession
    prepare(spark)
    known = references(docs, text_col, lang_col, min_words=min_words, max_repeat=max_repeat) if known is None else known
    shared = spark.sparkContext.broadcast(known)

    @F.arrow_udf(_RESULT)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        from sottovoce.llm import rules

        for text, lang in batches:
            yield rules.verdicts(text, lang.to_pylist(), shared.value, min_words, max_repeat, (class_limit, word_limit), noise)

    return docs.select(F.col(id_col), run(F.coalesce(text_col, F.lit("")), F.col(lang_col).cast("string")).alias("r")).select(F.col(id_col), "r.*")


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def op12_sql() -> str:
    space = "\\x20\\x09-\\x0D"
    token = f"[^{space}.,;:!?\"''()]+"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    sets = ["[^a-z]", "[^A-Z]", "[^0-9]", f"[^{space}]", "[^.,;:!?\"''()]", None, "[\\x00-\\x7F]"]
    kinds = [f"length(regexp_replace(t, '{s}', '', 'g'))" if s else f"length(regexp_replace(t, '[a-zA-Z0-9{space}.,;:!?\"''()]|[^\\x00-\\x7F]', '', 'g'))" for s in sets]
    half = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / ((p + q) / 2)) ELSE 0 END"
    return f"""
WITH a AS (SELECT row_number() OVER () AS k, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, doc_id, lang, t, regexp_extract_all(t, '[^{space}]+') AS w FROM a),
g AS (SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT k, count(DISTINCT i) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM g) WHERE n > 1) GROUP BY k),
l AS (SELECT k, sum(n - 1) AS n FROM (SELECT k, x, count(*) AS n FROM (SELECT k, unnest(string_split(t, chr(10))) AS x FROM a) WHERE regexp_matches(x, '[^{space}]') GROUP BY k, x) GROUP BY k),
b AS (SELECT w.k, doc_id, lang, t, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN r ON r.k = w.k LEFT JOIN l ON l.k = w.k),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed, [{', '.join(kinds)}] AS c, regexp_extract_all(translate(t, '{upper}', '{lower}'), '{token}') AS x FROM b),
u AS (SELECT DISTINCT lang, t, c, x FROM f WHERE NOT base_failed AND lang IS NOT NULL),
tot AS (SELECT lang, count(*) * {UNIT} AS total FROM u WHERE len(x) > 0 GROUP BY lang HAVING count(*) >= {MIN_REFERENCE}),
com AS (SELECT lang, x, n, total FROM (SELECT lang, x, sum(n) AS n FROM (SELECT lang, x, count(*) * {UNIT} // any_value(size) AS n FROM (SELECT lang, t, len(x) AS size, unnest(x) AS x FROM u) GROUP BY lang, t, x) GROUP BY lang, x)
  JOIN tot USING (lang) WHERE n * {COMMON} >= total),
ref AS (SELECT lang, 'w' AS h, x AS bin, n FROM com UNION ALL SELECT lang, 'w', NULL, total - coalesce((SELECT sum(n) FROM com WHERE com.lang = tot.lang), 0) FROM tot
  UNION ALL SELECT lang, 'c', j::VARCHAR, sum(c[j] * {UNIT} // greatest(list_sum(c), 1)) FROM u JOIN tot USING (lang), range(1, {CLASSES + 1}) z(j) GROUP BY lang, j),
q AS (SELECT lang, h, bin, n / sum(n) OVER (PARTITION BY lang, h) AS q, count(*) OVER (PARTITION BY lang, h) AS bins FROM ref),
d AS (SELECT k, f.lang, CASE WHEN f.lang IN (SELECT lang FROM tot) THEN f.lang END AS own, c, x FROM f WHERE NOT base_failed),
v AS (SELECT k, tot.lang FROM d JOIN tot ON d.own IS NULL OR d.own = tot.lang),
y AS (SELECT k, lang, h, bin, sum(n) AS n FROM (
  SELECT v.k, v.lang, 'w' AS h, com.x AS bin, s.n FROM v JOIN (SELECT k, x, count(*) AS n FROM (SELECT k, unnest(x) AS x FROM d) GROUP BY k, x) s ON s.k = v.k LEFT JOIN com ON com.lang = v.lang AND com.x = s.x
  UNION ALL SELECT v.k, v.lang, 'c', j::VARCHAR, c[j] FROM v JOIN d ON d.k = v.k, range(1, {CLASSES + 1}) z(j)) GROUP BY k, lang, h, bin),
e AS (SELECT v.k, v.lang, q.h, q.bin, q.q, q.bins, coalesce(y.n, 0) AS n FROM v JOIN q ON q.lang = v.lang LEFT JOIN y ON y.k = v.k AND y.lang = v.lang AND y.h = q.h AND y.bin IS NOT DISTINCT FROM q.bin),
p AS (SELECT *, sum(n) OVER (PARTITION BY k, lang, h) AS size, n / greatest(sum(n) OVER (PARTITION BY k, lang, h), 1) AS p FROM e),
j AS (SELECT k, lang, h, CASE WHEN any_value(size) = 0 THEN 0 ELSE sum({half('p')} + {half('q')}) / 2 END - CASE h WHEN 'c' THEN {CLASS_LIMIT} ELSE {WORD_LIMIT} END - {NOISE} * (any_value(bins) - 1) / (8 * ln(2) * greatest(any_value(size), 1)) AS over FROM p GROUP BY k, lang, h),
z AS (SELECT k, min(over) AS over FROM (SELECT k, lang, max(over) AS over FROM j GROUP BY k, lang) GROUP BY k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(z.over, 0) <= 0 AS kept FROM f LEFT JOIN z ON z.k = f.k
"""
