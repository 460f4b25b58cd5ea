"""Quality by weak labels: expectation-maximisation over overlapping heuristic labellers, then a hashed linear scorer.

Each labeller votes good (1), bad (0) or nothing (null) on a text. The votes of all texts are counted by pattern (at most
3 ** labellers of them), and expectation-maximisation on those counts estimates every labeller's accuracy and the share
of good texts; so the estimate covers all rows though only the counts leave the executors. The posterior of a row's
pattern is its label. A linear scorer on hashed words and on binned shares of kinds of characters is fitted to the
posteriors of a bounded sample (about FIT_DOCS texts and FIT_BYTES bytes, by a hash of the text) and scores every text, so
that texts on which no labeller votes get a score too. label() gives the posteriors themselves.

Defined cases: null and empty texts have no words and no vote but that for length; they get a score like any other;
rows that repeat get equal scores; an empty table gives an empty result; classify()
returns its own columns only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sottovoce.llm import vectext
from sottovoce.llm.common import materialise, prepare, table

HASH_BITS = 18
#: The sample: at most about so many texts, and bytes of text; no text of more than a hundredth of the bytes.
FIT_DOCS, FIT_BYTES = 4000, 64 << 20
#: Bins of each share.
BINS = 64
#: Passes over the sample, and the step, which each weight's own gradients so far divide.
PASSES, STEP = 30, 0.3
_WORD = vectext.spaced((0x20, 0x20), (0x09, 0x0D))


def measures(text: Column) -> dict[str, Column]:
    """Numbers of a text that labellers judge by; each takes one pass over it."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    lines = F.split(t, "\n")
    return {
        "words": (F.length(t) - F.length(F.translate(t, " \n", ""))).cast("double") + 1,
        "letters": F.length(F.regexp_replace(t, r"[^\p{L}\s]+", "")) / n,
        "digits": (F.length(t) - F.length(F.translate(t, "0123456789", ""))) / n,
        "upper": F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")) / n,
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "variety": F.size(F.array_distinct(F.split(t, r"\s+"))) / F.size(F.split(t, r"\s+")),
        "marks": (F.length(t) - F.length(F.translate(t, "#*$%&@{}<>|\\^~=_", ""))) / n,
        "doubled": F.size(F.regexp_extract_all(t, F.lit(r"!!|\?\?| \| "), F.lit(0))) / (n / 100),
        "repeats": F.size(F.regexp_extract_all(t, F.lit(r"(?<!\S)(\S+)\s(?=\1(?!\S))"), F.lit(0))) / (F.length(t) - F.length(F.translate(t, " \n", "")) + 1),
        "stops": F.size(F.regexp_extract_all(t, F.lit(r"[.!?]"), F.lit(0))) / (n / 100),
    }


def votes(m: dict[str, Column]) -> dict[str, Column]:
    """The labellers."""
    bad = lambda test: F.when(test, 0)

    return {
        "length": F.when(m["words"].between(30, 20000), 1).when(m["words"] < 3, 0),
        "letters": F.when(m["letters"] >= 0.95, 1).when(m["letters"] < 0.8, 0),
        "stops": F.when(m["stops"].between(0.3, 4.0), 1).when(m["stops"] > 8, 0),
        "digits": bad(m["digits"] > 0.08),
        "case": bad(m["upper"] > 0.2),
        "lines": bad(m["distinct_lines"] < 0.7),
        "variety": bad((m["variety"] < 0.42) & (m["words"] >= 20)),
        "repeats": bad((m["repeats"] > 0.2) & (m["words"] >= 5)),
        "marks": bad(m["marks"] > 0.01),
        "doubled": bad(m["doubled"] > 0.3),
    }


class LabelModel:
    """How often each labeller votes bad, good or nothing on good and on bad texts, and the share of good texts.

    A vote withheld tells something too: most labellers only speak up against a text."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 300) -> None:
        """patterns: rows of votes 1, 0 or -1 (none); counts: texts with each. The first guess gives the classes their meaning."""
        cast = patterns.shape[1]
        self.share = 0.85
        self.rates = {"good": np.tile([0.38, 0.02, 0.6], (cast, 1)), "bad": np.tile([0.4, 0.3, 0.3], (cast, 1))}  # none, bad, good
        for _ in range(rounds):
            p = self.posterior(patterns)
            before = self.rates["bad"].copy()
            for side, w in (("good", counts * p), ("bad", counts * (1 - p))):
                seen = np.stack([(w[:, None] * (patterns == v)).sum(0) for v in (-1, 0, 1)], axis=1)
                self.rates[side] = (seen + 0.1) / (seen.sum(1, keepdims=True) + 0.3)
            self.share = float(np.clip((counts * p).sum() / max(counts.sum(), 1), 0.02, 0.98))
            if np.abs(before - self.rates["bad"]).max() < 1e-7:
                break

    def accuracy(self) -> np.ndarray:
        """Of the votes that each labeller casts, the share that is right."""
        good, bad = self.share * self.rates["good"], (1 - self.share) * self.rates["bad"]
        return (good[:, 2] + bad[:, 1]) / np.maximum((good + bad)[:, 1:].sum(1), 1e-12)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability that texts with these votes are good."""
        at = np.arange(patterns.shape[1])
        a = np.log(self.share) + np.log(self.rates["good"][at, patterns + 1]).sum(1)
        b = np.log(1 - self.share) + np.log(self.rates["bad"][at, patterns + 1]).sum(1)
        return 1 / (1 + np.exp(np.clip(b - a, -50, 50)))


def _kinds() -> list[np.ndarray]:
    byte = np.arange(256)
    letter = (byte >= 128) | (byte >= 65) & (byte < 91) | (byte >= 97) & (byte < 123)
    marks = np.isin(byte, list(b"#*$%&@{}<>|\\^~=_"))
    return [letter, (byte >= 48) & (byte < 58), (byte >= 65) & (byte < 91), marks, np.isin(byte, list(b".!?")), byte == 10, np.isin(byte, [9, 13, 32]), byte >= 128, byte == 124, np.isin(byte, list(b"!?"))]


_KINDS = _kinds()
_LINE = vectext.spaced((0x0A, 0x0A))
SHARES = len(_KINDS) + 4
SLOTS = (1 << HASH_BITS) + SHARES * BINS


def _distinct(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each row, the share of its pieces that differ from those before."""
    rows = len(at) - 1
    of = np.repeat(np.arange(rows), np.diff(at))
    _, first = np.unique(vectext.mix(hashes ^ vectext.mix(of.astype(np.uint64))), return_index=True)
    return np.bincount(of[first], minlength=rows) / np.maximum(np.diff(at), 1)


def _features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of some rows at a time: the slots of their hashed words, where each row starts among them, and a row's SHARES slots of binned shares."""
    for _, data, starts in vectext.blocks(*vectext.text_bytes(column)):
        hashes, at = vectext.words(vectext.fold(data), starts, _WORD)
        n, words, rows = np.maximum(np.diff(starts), 1), np.maximum(np.diff(at), 1), len(starts) - 1
        of, again = np.repeat(np.arange(rows), np.diff(at)), np.zeros(len(hashes))
        again[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
        shares = [np.sqrt(vectext.row_sums(kind[data], starts) / n) for kind in _KINDS]
        shares += [_distinct(hashes, at), _distinct(*vectext.words(data, starts, _LINE)), vectext.row_sums(again, at) / words, np.log2(words) / 20]
        bins = np.minimum((np.stack(shares, axis=1) * BINS).astype(np.int64), BINS - 1) + np.arange(SHARES) * BINS + (1 << HASH_BITS)
        yield (hashes >> np.uint64(64 - HASH_BITS)).astype(np.int64), at, bins


def fit_scorer(column: pa.Array, target: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer on the shares of hashed words, by gradient steps scaled for each weight."""
    weights, squares, row = np.zeros(SLOTS), np.full(SLOTS, 1e-4), 0
    parts = []
    for words, at, bins in _features(column):
        parts.append((words, at, bins, target[row : row + len(at) - 1]))
        row += len(at) - 1
    if not row:
        return weights.astype(np.float32), 0.0
    mean = float(np.clip(target.mean(), 0.01, 0.99))
    bias = float(np.log(mean / (1 - mean)))
    for _ in range(PASSES):
        for words, at, bins, y in parts:
            n = np.diff(at)
            off = _sigmoid(bias + _sums(weights, words, at, bins)) - y
            slope = np.bincount(words, weights=np.repeat(off / np.sqrt(np.maximum(n, 1)), n), minlength=SLOTS)
            slope = (slope + np.bincount(bins.ravel(), weights=np.repeat(off, SHARES), minlength=SLOTS)) / len(y)
            squares += slope**2
            weights -= STEP * (slope / np.sqrt(squares) + 1e-4 * weights)
            bias -= STEP * float(off.mean())
    return weights.astype(np.float32), bias


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def _sums(weights: np.ndarray, words: np.ndarray, at: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Of each row, the weights of its words over the root of their number, and those of its shares."""
    return vectext.row_sums(weights[words], at) / np.sqrt(np.maximum(np.diff(at), 1)) + weights[bins].sum(1)


def label(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, LabelModel]:
    """Rows (id, digest of the text, its bytes, posterior) and the model of the labellers."""
    named = votes({k: F.col(k) for k in measures(F.lit(""))})
    measured = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"), F.octet_length(text_col).alias("size"), *[c.alias(k) for k, c in measures(F.col(text_col)).items()])
    voted = materialise(measured.select("id", "digest", "size", *[F.coalesce(c, F.lit(-1)).alias(k) for k, c in named.items()]), "votes")
    found = voted.groupBy(*named).count().toPandas()  # at most 3 ** labellers rows
    patterns = found[list(named)].to_numpy().reshape(-1, len(named)).astype(int)
    model = LabelModel(patterns, found["count"].to_numpy(float))
    terms = []
    for side, share in (("good", model.share), ("bad", 1 - model.share)):
        term = F.lit(float(np.log(share)))
        for rates, k in zip(np.log(model.rates[side]), named, strict=True):
            term = term + F.when(F.col(k) == 1, float(rates[2])).when(F.col(k) == 0, float(rates[1])).otherwise(float(rates[0]))
        terms.append(term)
    return voted.select("id", "digest", "size", (1 / (1 + F.exp(terms[1] - terms[0]))).alias("posterior")), model


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_docs: int = FIT_DOCS, fit_bytes: int = FIT_BYTES) -> DataFrame:
    """A row per document: id, score (of the scorer) and predicted (score >= 0.5)."""
    spark = docs.sparkSession
    prepare(spark)
    labels, _ = label(docs, id_col, text_col)
    fits = F.coalesce(F.col("size"), F.lit(0)) <= fit_bytes // 100
    total, n_bytes = labels.where(fits).agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).head()
    part = int(min(1.0, fit_docs / max(total, 1), fit_bytes / max(n_bytes, 1)) * (1 << 30))
    hashed = F.pmod(F.xxhash64("digest"), F.lit(1 << 30))
    taken = labels.where(fits & (hashed < part)).groupBy("digest").agg(F.first("posterior").alias("posterior"))
    size = F.coalesce(F.octet_length(text_col), F.lit(0))
    texts = docs.where(size <= fit_bytes // 100).select(F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text")).where(hashed < part).dropDuplicates(["digest"])
    sample = texts.join(taken, "digest").orderBy("digest").toArrow()  # bounded by fit_docs and fit_bytes
    scorer = spark.sparkContext.broadcast(fit_scorer(sample["text"], sample["posterior"].to_numpy()))
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = scorer.value
        for batch in batches:
            out = [np.zeros(0)]
            for words, at, bins in _features(batch.column("text")):
                out.append(_sigmoid(bias + _sums(weights, words, at, bins)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.concatenate(out))], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = slim.mapInArrow(run, f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"))
