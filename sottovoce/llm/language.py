"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts, up to four bytes deep, with the counts of a training sample, frozen. A byte
costs the exact code length of escape method C: along the longest context that the language knows, either the byte's own
code or an escape and the cost in the next shorter context; below the empty context all 256 bytes cost the same. The
language with the shortest code for the whole text wins. Costs for every sequence that any language has seen are worked
out once, so a byte takes about one search for all languages together.

The training sample is a bounded one: whole texts, about SAMPLE_DOCS distinct ones of each language (all, if there are no
more), taken by a hash of the text; each counts once, however often it is copied.

Defined cases: null texts and texts without a letter are `und` with score 0, as are all texts if nothing was learned;
null languages teach nothing; of equal costs the language that sorts first wins; rows that repeat get equal answers; an
empty table gives an empty result; predict() returns its own three columns only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sottovoce.llm import vectext
from sottovoce.llm.common import materialise, prepare, table

#: The longest sequence: four bytes of context and the byte they predict.
DEPTH = 5
SAMPLE_DOCS = 300


def _mask(size: int) -> np.uint64:
    return np.uint64((1 << 8 * size) - 1)


def sequence_counts(sample: DataFrame) -> DataFrame:
    """Of rows (lang, text): how often each language has each sequence of DEPTH bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for row, data, starts in vectext.blocks(*vectext.text_bytes(batch.column("text"))):
                keys = vectext.grams(vectext.letters(data), starts, DEPTH)
                names = langs[row : row + len(starts) - 1]
                of = np.repeat(np.array([names.index(x) for x in names], np.int64), np.diff(starts))
                for first in np.unique(of):
                    found, n = np.unique(keys[of == first], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([names[first]] * len(found)), pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "g", "n"])

    return sample.select("lang", "text").mapInArrow(run, "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n"))


class Model:
    """Code lengths in bits. For each size of sequence: the sequences that any language has seen, with the cost of their last byte in every language; the contexts, with the cost of an escape in each."""

    def __init__(self, langs: list[str], of: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> None:
        self.langs = langs
        self.seen: list[tuple[np.ndarray, np.ndarray]] = []
        self.escape: list[tuple[np.ndarray, np.ndarray]] = []
        self.places: list[tuple[vectext.Places, vectext.Places]] | None = None
        lower: tuple[np.ndarray, np.ndarray] | None = None
        for size in range(1, DEPTH + 1):
            sequences, back = np.unique(keys & _mask(size), return_inverse=True)
            n = np.zeros((len(sequences), len(langs)))
            np.add.at(n, (back, of), counts)
            contexts, inside = np.unique(sequences >> np.uint64(8), return_inverse=True)
            total, kinds = np.zeros((len(contexts), len(langs))), np.zeros((len(contexts), len(langs)))
            np.add.at(total, inside, n)
            np.add.at(kinds, inside, n > 0)
            escape = np.where(total > 0, -np.log2(np.maximum(kinds, 1) / np.maximum(total + kinds, 1)), 0.0)
            if lower is None:
                rest = np.full((len(sequences), len(langs)), 8.0)
            else:
                rest = lower[1][np.searchsorted(lower[0], sequences & _mask(size - 1))]
            own = -np.log2(np.maximum(n, 1) / np.maximum((total + kinds)[inside], 1))
            cost = np.where(n > 0, own, escape[inside] + rest)
            lower = (sequences, cost)
            self.seen.append((sequences, cost.astype(np.float32)))
            self.escape.append((contexts, escape.astype(np.float32)))

    def costs(self, column: pa.Array) -> np.ndarray:
        """Bits of each text in each language."""
        self.places = self.places or [(vectext.Places(s[0]), vectext.Places(e[0])) for s, e in zip(self.seen, self.escape, strict=True)]
        out = [np.zeros((0, len(self.langs)))]
        for _, data, starts in vectext.blocks(*vectext.text_bytes(column), size=max(1 << 16, (1 << 22) // max(len(self.langs), 4))):
            keys = vectext.grams(vectext.letters(data), starts, DEPTH)
            cost = np.zeros((len(data), len(self.langs)), np.float32)
            left = np.arange(len(data))
            for size in range(DEPTH, 0, -1):
                asked = keys[left] & _mask(size)
                place = self.places[size - 1][0].find(asked)
                known = place >= 0
                cost[left[known]] += self.seen[size - 1][1][place[known]]
                left, asked = left[~known], asked[~known]
                if not len(left):
                    break
                place = self.places[size - 1][1].find(asked >> np.uint64(8))
                known = place >= 0
                cost[left[known]] += self.escape[size - 1][1][place[known]]
            cost[left] += np.float32(8)
            out.append(vectext.row_sums(cost, starts))
        return np.concatenate(out)


def train(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """labelled: rows (lang, text). None if there is nothing to learn from."""
    prepare(labelled.sparkSession)
    rows = labelled.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("text").alias("h"))
    sizes = {r["lang"]: r["count"] for r in rows.select("lang", "h").distinct().groupBy("lang").count().collect()}  # as many rows as languages
    if not sizes:
        return None
    limits = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1 << 30, sample_docs * (1 << 30) // n))])
    sample = rows.where(F.pmod("h", F.lit(1 << 30)) < limits[F.col("lang")])
    sample = sample.groupBy("lang", "h").agg(F.min("text").alias("text"))  # copies meet in their own partition first
    counts = materialise(sequence_counts(sample), "sequences").toArrow()  # bounded by the sample
    langs = sorted(set(counts["lang"].to_pylist()))
    number = {lang: i for i, lang in enumerate(langs)}
    return Model(langs, np.array([number[x] for x in counts["lang"].to_pylist()]), counts["g"].to_numpy().astype(np.uint64), counts["n"].to_numpy()) if langs else None


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each row: id, lang_pred and score, the share of the winner among the languages' probabilities of the text."""
    prepare(docs.sparkSession)
    lettered = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), lettered.alias("lettered"))
    if model is None:
        return slim.select(F.col("id").alias(id_col), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = sent.value.costs(batch.column("text"))
            best = bits.argmin(1)
            share = 1 / np.exp2(-np.minimum(bits - bits.min(1, keepdims=True), 500)).sum(1)
            known = batch.column("lettered").to_pylist()
            langs = [sent.value.langs[b] if k else "und" for b, k in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(langs), pa.array(np.where(known, share, 0.0))], ["id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))  # null ids are not held out
    model = train(documents.where(~held_out).select("lang", "text"))
    return predict(documents, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
