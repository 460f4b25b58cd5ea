"""Toxicity by class-conditional Kneser-Ney models.

Two models over letters, of toxic and of ordinary labelled texts, predict each byte from the five before it. Beneath both
lies one Kneser-Ney model of all labelled texts, from the counts they share: each order discounts its counts and backs
off to the next, the lowest by continuation counts. A class departs from it only as far as its own counts go: at every
order its ratio to the shared probability is drawn, as by PRIOR bytes, to the ratio one order lower. So a rare expression,
known in part, counts as far as its parts are known, and what neither class has shown counts for neither.

The log-likelihood difference of the two models is taken over all passages of PASSAGE bytes of a text, and compared four
ways: the most toxic passage (one expression shows in a long text too), and three normalised by the text's length (how
many passages are strongly toxic, by how much passages exceed a limit, and the mean likelihood ratio of passages). A
logistic curve, fitted on labelled rows that the counts leave out, weighs the four and makes them a score.

Counts cover every labelled text, whole; they are gathered by key. Scoring backs off as learning does: a byte counts by
the longest gram that was seen, plus, for each longer context that was seen without it, the difference of the two models'
back-off weights there; so the finished tables hold every gram and every context of each order, whole. Up to
BROADCAST_ENTRIES they are broadcast; larger ones go as sorted files to the disk of each node, where the tasks map them
into memory, so that they may grow with the labelled texts. Ids, languages and sources are no inputs.

Defined cases: null and empty texts have no passages and get the score of none; rows of a null id are not held out; labels that are null teach nothing; with
labels of one class only, every score is 0 (or 1, if all are toxic); rows that repeat get equal scores; an empty table
gives an empty result; further columns pass through untouched."""

from __future__ import annotations

import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sottovoce.llm import vectext
from sottovoce.llm.common import materialise, maybe_in, prepare, table

ORDER = 6
DISCOUNT = 0.75
#: Orders up to this one are shared by the classes.
SHARED = 2
#: Bytes of a context that a class must show before its own counts outweigh the lower order's ratio.
PRIOR = 600.0
#: Bytes of a passage over which the log-likelihoods are compared.
PASSAGE = 12
#: Log-likelihood ratio of a passage from which it exceeds, and from which it is strongly toxic; length (in bytes) that
#: every text is taken to have besides its own, in the mean ratio and in the other two.
EXCEEDS, STRONG, BESIDE_RATIO, BESIDE = 1.0, 3.0, 50, 200
#: Entries of all tables, up to which they are broadcast: about 100 MB a task, slots included.
BROADCAST_ENTRIES = 1 << 21
#: Entries that travel to the driver in one row, on the way to a file.
PACKED = 1 << 16
#: Labelled rows, at most about, on which the curve is fitted.
CURVE_ROWS = 20_000
#: A task's table of counts is merged when it has gathered this many entries, and handed on at half of that.
GATHER = 4_000_000


def gram_counts(labelled: DataFrame) -> DataFrame:
    """Of rows (text, toxic): each ORDER-gram with its counts in ordinary and toxic texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list) -> pa.RecordBatch:
            keys, counts = parts[0]
            return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts[:, 0]), pa.array(counts[:, 1])], ["g", "o", "t"])

        parts, size = [], 0
        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
            for row, data, starts in vectext.blocks(*vectext.text_bytes(batch.column("text"))):
                keys = vectext.grams(vectext.letters(data), starts, ORDER)
                of = np.repeat(toxic[row : row + len(starts) - 1], np.diff(starts))
                for c in (0, 1):
                    found, n = np.unique(keys[of == c], return_counts=True)
                    counts = np.zeros((len(found), 2), np.int64)
                    counts[:, c] = n
                    parts.append((found, counts))
                    size += len(found)
            if size > GATHER:
                parts = [vectext.merge_counts(parts)]
                size = len(parts[0][0])
                if size > GATHER // 2:
                    yield out(parts)
                    parts, size = [], 0
        if size:
            yield out([vectext.merge_counts(parts)])

    return labelled.select("text", "toxic").mapInArrow(run, "g long, o long, t long").groupBy("g").agg(F.sum("o").alias("o"), F.sum("t").alias("t"))


def _last(size: int) -> F.Column:
    return F.col("g").bitwiseAND(F.lit((1 << 8 * size) - 1))


def _shared(counts: DataFrame) -> DataFrame:
    """Each SHARED-gram with p, by continuation counts: how many distinct longer grams of either class end in it. At most 256 ** SHARED rows."""
    grams = counts.select(_last(SHARED + 1).alias("g")).distinct()
    tables = []
    for size in range(SHARED, 0, -1):
        grams = materialise(grams.groupBy(_last(size).alias("g")).agg(F.count(F.lit(1)).cast("double").alias("n")), "shared")
        tables.append(grams)
    lower = None
    for size, grams in enumerate(reversed(tables), 1):
        context = grams.groupBy(F.shiftright("g", 8).alias("h")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("types"))
        joined = grams.withColumn("h", F.shiftright("g", 8)).join(context, "h")
        if lower is None:
            lower = joined.select("g", (F.col("n") / F.col("total")).alias("p"))
            continue
        joined = joined.withColumn("s", _last(size - 1)).join(lower.select(F.col("g").alias("s"), F.col("p").alias("q")), "s")
        lower = joined.select("g", ((F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("types") * F.col("q")) / F.col("total")).alias("p"))
    return materialise(lower, "shared")


def log_ratios(counts: DataFrame) -> DataFrame:
    """Rows (size, escape, g, ratio) of the orders above SHARED: ln P_toxic - ln P_ordinary of each gram of `size` bytes
    (context and byte), and, with escape, of the weights that each context (size - 1 bytes) gives to the next order."""
    lower = _shared(counts).select("g", "p", F.lit(1.0).alias("r_o"), F.lit(1.0).alias("r_t"))
    tables = []
    for size in range(SHARED + 1, ORDER + 1):
        grams = counts if size == ORDER else counts.groupBy(_last(size).alias("g")).agg(F.sum("o").alias("o"), F.sum("t").alias("t"))
        grams = grams.withColumn("h", F.shiftright("g", 8)).withColumn("s", _last(size - 1))
        context = materialise(grams.groupBy("h").agg(F.sum("o").alias("all_o"), F.sum("t").alias("all_t"), F.count(F.lit(1)).alias("types")), "contexts")
        joined = grams.join(context, "h").join(lower.select(F.col("g").alias("s"), F.col("p").alias("q"), F.col("r_o").alias("q_o"), F.col("r_t").alias("q_t")), "s")
        n = F.col("o") + F.col("t")
        joined = joined.withColumn("p", (F.greatest(n - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("types") * F.col("q")) / (F.col("all_o") + F.col("all_t")))

        def ratio(c: str) -> F.Column:
            return (F.col(c) / F.col("p") + PRIOR * F.col(f"q_{c}")) / (F.col(f"all_{c}") + PRIOR)

        lower = materialise(joined.select("g", "p", ratio("o").alias("r_o"), ratio("t").alias("r_t")), "order")
        tables.append(lower.select(F.lit(size).alias("size"), F.lit(False).alias("escape"), "g", F.ln(F.col("r_t") / F.col("r_o")).alias("ratio")))
        rest = F.ln((F.col("all_o") + PRIOR) / (F.col("all_t") + PRIOR))
        tables.append(context.select(F.lit(size).alias("size"), F.lit(True).alias("escape"), F.col("h").alias("g"), rest.alias("ratio")))
    return reduce(DataFrame.union, tables)


class Sorted:
    """Finds where keys stand in a sorted array, which may be a mapped file; the interface of vectext.Places."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys

    def find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys) or not len(keys):
            return np.full(len(keys), -1)
        asked, back = np.unique(keys, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        return np.where(self.keys[at] == asked, at, -1)[back]


class Files:
    """Tables in two files (keys, ratios) that Spark sends to each node, and where each table starts and stops in them."""

    def __init__(self, name: str, spans: dict[tuple[int, bool], tuple[int, int]]) -> None:
        self.name, self.spans = name, spans

    def tables(self) -> dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]]:
        keys, ratios = (np.memmap(SparkFiles.get(f"{self.name}.{part}"), kind, "r") for part, kind in (("keys", np.uint64), ("ratios", np.float32)))
        return {k: (keys[a:b], ratios[a:b]) for k, (a, b) in self.spans.items() if b > a}


class Model:
    """For each (size, escape): grams or contexts and their log-ratios; the weights of the four comparisons; and the curve (slope, middle) from the evidence, their weighted sum, to the score."""

    def __init__(self, tables: dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]] | Files, slope: float = 1.0, middle: float = 0.0, constant: float | None = None) -> None:
        self.files = tables if isinstance(tables, Files) else None
        self.tables = {} if self.files else {k: (grams.astype(np.uint64), ratios.astype(np.float32)) for k, (grams, ratios) in tables.items()}
        self.slope, self.middle, self.constant = slope, middle, constant
        self.weights = np.array([1.0, 0.0, 0.0, 0.0])
        self.places: dict[tuple[int, bool], vectext.Places | Sorted] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"places": None} | ({"tables": {}} if self.files else {})

    def ratios(self, keys: np.ndarray) -> np.ndarray:
        """The log-ratio of the last byte of each ORDER-gram, by the longest of its endings that was seen."""
        if self.places is None:
            if self.files:
                self.tables = self.files.tables()
            self.places = {k: Sorted(grams) if self.files else vectext.Places(grams) for k, (grams, _) in self.tables.items()}
        out, left = np.zeros(len(keys), np.float32), np.arange(len(keys))
        for size in range(ORDER, SHARED, -1):
            for escape in (False, True):
                if (size, escape) in self.tables and len(left):
                    found = self.places[size, escape].find((keys[left] & np.uint64((1 << 8 * size) - 1)) >> np.uint64(8 * escape))
                    known = found >= 0
                    out[left[known]] += self.tables[size, escape][1][found[known]]
                    left = left if escape else left[~known]
        return out

    def comparisons(self, column: pa.Array) -> np.ndarray:
        """A row per text: its largest log-likelihood ratio of a passage; the logarithms of its excess and of its share of
        strong passages; the logarithm of its mean likelihood ratio of passages."""
        out = [np.zeros((0, 4))]
        for _, data, starts in vectext.blocks(*vectext.text_bytes(column)):
            ratios = self.ratios(vectext.grams(vectext.letters(data), starts, ORDER))
            total = np.concatenate([[0.0], np.cumsum(ratios, dtype=np.float64)])
            ends = np.minimum(np.arange(len(data)) + PASSAGE, np.repeat(starts[1:], np.diff(starts)))
            passages = total[ends] - total[:-1]
            n, most, full = np.diff(starts), np.zeros(len(starts) - 1), np.flatnonzero(np.diff(starts))
            if len(full):
                most[full] = np.maximum.reduceat(passages, starts[full])
            excess = vectext.row_sums(np.maximum(passages - EXCEEDS, 0), starts) / (n + BESIDE)
            strong = vectext.row_sums(passages > STRONG, starts) / (n + BESIDE)
            mean = (vectext.row_sums(np.exp(np.minimum(passages, 50)), starts) + BESIDE_RATIO) / (n + BESIDE_RATIO)
            out.append(np.stack([most, np.log(excess + 1e-3), np.log(strong + 1e-3), np.log(mean)], axis=1))
        return np.concatenate(out)

    def evidence(self, column: pa.Array) -> np.ndarray:
        return self.comparisons(column) @ self.weights

    def score(self, evidence: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(evidence), self.constant)
        return 1 / (1 + np.exp(np.clip(-self.slope * (evidence - self.middle), -50, 50)))


def _evidence(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns `keep` of docs and the evidence of its column text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*[F.col(f"`{k}`") for k in keep], F.col("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(sent.value.evidence(batch.columns[len(keep)]))], [*keep, "evidence"])

    return kept.mapInArrow(run, ", ".join(f"`{k}` {kept.schema[k].dataType.simpleString()}" for k in keep) + ", evidence double")


def _compared(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The four comparisons and the labels of rows (text, toxic), of which there are few."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            four = sent.value.comparisons(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *map(pa.array, four.T)], ["toxic", "a", "b", "c", "d"])

    got = rows.select("text", "toxic").mapInArrow(run, "toxic int, a double, b double, c double, d double").toArrow()
    return np.stack([got[c].to_numpy() for c in "abcd"], axis=1), got["toxic"].to_numpy()


def fit_weights(compared: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression with a slight ridge on standardised comparisons, by Newton's steps."""
    spread = compared.std(0) + 1e-9
    x = np.c_[(compared - compared.mean(0)) / spread, np.ones(len(compared))]
    ridge, w = np.diag([0.1] * compared.shape[1] + [1e-6]), np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge, x.T @ (toxic - p) - ridge @ w)
    return w[:-1] / spread


def fit_curve(evidence: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """(slope, middle): the middle lies in the gap that divides the classes with the fewest errors, there as near as may be
    to where both classes' means are equally many deviations away; the slope follows the classes' distance."""
    order = np.argsort(evidence, kind="stable")
    x, y = evidence[order], toxic[order].astype(float)
    missed, wrong = np.concatenate([[0], np.cumsum(y)]), (1 - y).sum() - np.concatenate([[0], np.cumsum(1 - y)])
    errors = missed + wrong  # if all rows from the cut on count as toxic
    best = np.flatnonzero(errors == errors.min())
    cut = int(best[len(best) // 2])
    below, above = x[max(cut - 1, 0)], x[min(cut, len(x) - 1)]
    spread = [x[y == c].std() + 1e-9 for c in (0, 1)]
    even = (x[y == 0].mean() * spread[1] + x[y == 1].mean() * spread[0]) / sum(spread)
    middle = np.clip(even, below + 0.1 * (above - below), above - 0.1 * (above - below))
    apart = max(x[y == 1].mean() - x[y == 0].mean(), 1e-6)
    return 8 / apart, float(middle)


def _tables(ratios: DataFrame) -> dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]] | Files:
    """The tables of a model: in the driver's memory, or, if they are more than may be broadcast, in files."""
    ratios = ratios.withColumn("ratio", F.col("ratio").cast("float"))
    if ratios.count() > BROADCAST_ENTRIES:
        return _files(ratios)
    got = ratios.toArrow()
    size, escape, grams, values = (got[c].to_numpy() for c in ("size", "escape", "g", "ratio"))
    picks = {(k, e): np.flatnonzero((size == k) & (escape == e)) for k in range(SHARED + 1, ORDER + 1) for e in (False, True)}
    return {k: (grams[at], values[at]) for k, at in picks.items()}


def _files(ratios: DataFrame) -> Files:
    """Sorts the tables in the cluster, and streams them through the driver into files; it holds one partition at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table_ = pa.Table.from_batches(held)
            kind, grams, values = table_["kind"].to_numpy(), table_["g"].to_numpy().astype(np.uint64), table_["ratio"].to_numpy()
            for k in np.unique(kind):  # rows are sorted by kind
                yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int32()), pa.array([grams[kind == k].tobytes()]), pa.array([values[kind == k].tobytes()])], ["kind", "keys", "ratios"])

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= PACKED:
                yield from out(held)
                held, n = [], 0
        if n:
            yield from out(held)

    rows = ratios.select((F.col("size") * 2 + F.col("escape").cast("int")).alias("kind"), "g", "ratio").orderBy("kind", "g")
    packed = rows.mapInArrow(run, "kind int, keys binary, ratios binary")
    name, folder, sizes = f"toxicity-{uuid.uuid4().hex[:12]}", tempfile.mkdtemp(prefix="sottovoce-"), Counter()
    with open(f"{folder}/{name}.keys", "wb") as keys, open(f"{folder}/{name}.ratios", "wb") as values:
        for r in packed.toLocalIterator():
            sizes[r["kind"]] += keys.write(r["keys"]) // 8
            values.write(r["ratios"])
    for part in ("keys", "ratios"):
        ratios.sparkSession.sparkContext.addFile(f"{folder}/{name}.{part}")
    stops = np.cumsum([sizes[k] for k in sorted(sizes)]).tolist()
    return Files(name, {(k // 2, k % 2 == 1): (stop - sizes[k], stop) for k, stop in zip(sorted(sizes), stops, strict=True)})


def train(labelled: DataFrame, in_curve: F.Column) -> Model:
    """labelled: rows (text, toxic 0 or 1). The counts take the rows outside in_curve, the curve those inside."""
    prepare(labelled.sparkSession)
    rows = labelled.where("toxic in (0, 1)").select(F.col("text"), F.col("toxic").cast("int").alias("toxic"), in_curve.alias("inside"))
    rows = rows.withColumn("inside", F.coalesce("inside", F.lit(False)))
    sizes = {(r["inside"], r["toxic"]): r["count"] for r in rows.groupBy("inside", "toxic").count().collect()}
    seen = {t for (_, t), n in sizes.items() if n}
    if len(seen) < 2:
        return Model({}, constant=float(max(seen, default=0)))
    if not all(sizes.get((inside, t)) for inside in (False, True) for t in (0, 1)):
        rows = rows.withColumn("inside", F.lit(False))  # too few rows to spare: all count
    counts = materialise(gram_counts(rows.where("not inside")), "grams")
    model = Model(_tables(log_ratios(counts)))
    spared = rows.where("inside") if all(sizes.get((True, t)) for t in (0, 1)) and any(inside for inside, _ in sizes) else rows
    share = min(1.0, CURVE_ROWS / max(sum(sizes.values()), 1) * 4)
    picked = spared.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)))
    compared, toxic = _compared(picked, model)
    if len(set(toxic.tolist())) == 2:
        model.weights = fit_weights(compared, toxic)
        model.slope, model.middle = fit_curve(compared @ model.weights, toxic)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Of each row: id, score (0 to 1), predicted (score >= 0.5), and further columns `keep`."""
    prepare(docs.sparkSession)
    names = [id_col, *(keep or [])]
    scored = _evidence(docs if text_col == "text" else docs.select(*names, F.col(text_col).alias("text")), model, names)
    if model.constant is not None:
        value = F.lit(model.constant)
    else:
        value = 1 / (1 + F.exp(F.least(F.greatest(-model.slope * (F.col("evidence") - model.middle), F.lit(-50.0)), F.lit(50.0))))
    return scored.withColumn("score", value).withColumn("predicted", (F.col("score") >= 0.5).cast("int")).drop("evidence")


def reject(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows that are not predicted toxic, all columns kept."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(sent.value.score(sent.value.evidence(pa.array(texts, pa.large_string()))) < 0.5)

    return docs.where(clean(F.col(text_col)))


def fold(docs_id: F.Column, folds: int) -> F.Column:
    return F.crc32(docs_id.cast("string").cast("binary")) % folds


def learned(documents: DataFrame, labels: DataFrame) -> Model:
    """Learns from labelled documents outside fold 0 of 5: counts from folds 1 to 3, the curve from fold 4."""
    taught = fold(F.col("doc_id"), 5) != 0
    known = labels.where("toxic in (0, 1)").where(taught).select("doc_id", "toxic").dropDuplicates(["doc_id", "toxic"])
    # only texts that have labels move; both sides always do, so that the plan is the same at every size
    texts = maybe_in(documents.select("doc_id", "text").where(taught), "doc_id", known.select("doc_id"))
    rows = texts.join(known.hint("merge"), "doc_id")
    rows = materialise(rows, "labelled")
    return train(rows, fold(F.col("doc_id"), 5) == 4)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = learned(documents, table(spark, sf_dir, "labels"))
    scored = score(documents, model)
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")
