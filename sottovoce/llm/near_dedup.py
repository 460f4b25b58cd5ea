"""Near-duplicate groups by SetSketch registers: band register values, estimate jointly by likelihood, verify on full sets.

A document's set holds its distinct `width`-word shingles (fewer words: the whole sequence as one; no words: nothing).
Documents link when intersection / union of their sets reaches the threshold; groups are the connected components.

How no link between different sets gets lost, while no bucket is expanded into all its pairs:
1. documents with equal sets collapse to one node, so exact copies cost one row; nodes are numbered, in 8 bytes;
2. one pass over the band values counts every bucket and finds its first and last node: of two nodes that is the pair.
   Only nodes of larger buckets move once more; each is compared to one pivot of its bucket (a star);
3. rounds of labelling along the links found so far give (parts of) components. The nodes of buckets that still hold
   several show their rarest shingles, as many as two sets that link must have one of in common; a family of texts that
   share a frame, but too little to link, thereby does not meet in the frame. Where nodes of several components meet in a
   shingle, those outside its largest component are compared with the others, in blocks spread over tasks: by size, by
   how many shingles are left behind the common one, and by their registers' estimate; what is left, each pair once, on
   full sets.
Pairs that share no band are lost: with 32 bands of 5 registers that is 1 pair in 300,000 at similarity 0.8, fewer above.

Defined cases: null and empty texts have empty sets, stay alone and are kept; a component's id is its smallest id; rows
that repeat an id and text share a node; null ids never become a component's id unless it has no other; an empty table
gives an empty result; further columns pass through untouched by dedup()."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sottovoce.llm import vectext
from sottovoce.llm.common import HOT_SLICES, MIN_HOT_ROWS, discard, hot_keys, materialise, maybe_in, prepare, skew_join, table

BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
#: The base of the exponential spacing, and the rate of the exponential values.
BASE, RATE = 1.02, 20.0
#: A pair whose estimate falls short of the threshold by more than this (four standard errors) is not verified.
MARGIN = 0.13
#: Nodes in a block of step 3, and pairs that are looked at together.
BLOCK, PAIRS = 256, 1 << 20
#: Binary logarithms of the fewest and the most cells (a byte each, so at most 16 MB) in which shingles are counted to tell which are rare;
#: cells that are packed together, and parts in which a pack's counts are added up first.
LEAST_CELLS, MOST_CELLS, CELL_CHUNK, CELL_SALTS = 16, 24, 1 << 16, 64
#: Packs of counts that the driver takes at once (at most 5 MB).
CHUNKS = 8

_WORD = vectext.spaced((0x20, 0x20), (0x09, 0x0D))
_RNG = np.random.default_rng(977)
_MULTIPLY = _RNG.integers(1, 1 << 32, REGISTERS, dtype=np.uint32) | np.uint32(1)
_FLIP = _RNG.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)


def shingle_sets(column: pa.Array, width: int) -> Iterator[list[np.ndarray]]:
    """The sorted distinct shingle hashes of each row, some rows at a time."""
    for _, data, starts in vectext.blocks(*vectext.text_bytes(column)):
        hashes, at = vectext.words(vectext.fold(data), starts, _WORD)
        grams = np.zeros(len(hashes), np.uint64)
        for k in range(width):  # of the last width - 1 words of a row nothing is used
            m = max(len(hashes) - k, 0)  # a block may hold fewer words than a shingle
            grams[:m] = grams[:m] * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + m]
        grams = vectext.mix(grams)
        sets = []
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if hi - lo >= width:
                sets.append(np.unique(grams[lo : hi - width + 1]))
            elif hi > lo:
                whole = np.uint64(hi - lo)
                for h in hashes[lo:hi]:
                    whole = vectext.mix(np.array([whole ^ h], np.uint64))[0]
                sets.append(np.array([whole], np.uint64))
            else:
                sets.append(np.zeros(0, np.uint64))
        yield sets


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers of non-empty sets: of exponential values per register the smallest, spaced exponentially and truncated."""
    items = np.concatenate(sets)
    low = (items >> np.uint64(32)).astype(np.uint32) ^ items.astype(np.uint32)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    least = np.empty((len(sets), REGISTERS), np.uint32)
    for r in range(REGISTERS):
        least[:, r] = np.minimum.reduceat((low ^ _FLIP[r]) * _MULTIPLY[r], starts)
    smallest = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(smallest) / np.log(BASE)), 0, 65535).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def jaccard(above: np.ndarray, below: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The similarity of highest joint likelihood, given how many of the registers of a are above and below those of b, and both sizes."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    same = REGISTERS - above - below

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 1e-9, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def loss(j: np.ndarray) -> np.ndarray:
        more, less = p(u - v * j), p(v - u * j)
        return -(above * np.log(more) + below * np.log(less) + same * np.log(np.clip(1 - more - less, 1e-9, 1)))

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    step = (5**0.5 - 1) / 2
    for _ in range(24):  # golden section; the likelihood has one peak
        left, right = hi - step * (hi - lo), lo + step * (hi - lo)
        first = loss(left) < loss(right)
        lo, hi = np.where(first, lo, left), np.where(first, right, hi)
    return (lo + hi) / 2


def features(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """A row per document: id, row (hash of id and text), n (set size), digest (128 bits, of the set) and registers."""
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, sketches = [], [], []
            for sets in shingle_sets(batch.column("text"), width):
                sizes += [len(s) for s in sets]
                for s in sets:
                    twice = vectext.mix(s ^ np.uint64(0x5851F42D4C957F2D))
                    digests.append(np.array([s.sum(dtype=np.uint64), twice.sum(dtype=np.uint64)]).tobytes() if len(s) else None)
                full = [s for s in sets if len(s)]
                rows = iter(sketch(full)) if full else iter(())
                sketches += [next(rows).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("row"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary())], ["id", "row", "n", "digest", "registers"])

    kind = docs.schema[id_col].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, row long, n long, digest binary, registers binary")


def _estimate(a: pd.Series, b: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
    x, y = (np.frombuffer(b"".join(s), np.uint16).reshape(-1, REGISTERS) for s in (a, b))
    return pd.Series(jaccard((x > y).sum(1), (x < y).sum(1), n_a.to_numpy(float), n_b.to_numpy(float)))


def _texts(docs: DataFrame, needed: DataFrame, id_col: str, text_col: str, most: int) -> DataFrame:
    """A row (row, text_id, text) for each needed row, and some more: documents are picked by a bitmap of fixed size over
    the hashes of the needed ones. Different documents may share a hash; the id tells them apart. most: rows of docs, at most."""
    text = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("row"), F.col(id_col).alias("text_id"), F.col(text_col).alias("text"))
    picked = maybe_in(text, "row", needed)
    return materialise(picked.dropDuplicates(["row", "text_id"]), "texts", most)


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, most: int) -> DataFrame:
    """Of the node pairs (a, b), those whose full sets reach the threshold. most: rows of docs, at most."""
    n_pairs = pairs.count()
    estimate = F.pandas_udf(_estimate, "double")
    named = pairs.select(F.col("a").alias("x")).union(pairs.select("b"))
    about = materialise(maybe_in(nodes.select("node", "registers", "n", "row", "id"), "node", named), "about")
    side = {s: about.select(*[F.col(c).alias(f"{c}_{s}" if c != "node" else s) for c in about.columns]) for s in "ab"}
    # size alone rules a pair out at once; registers rule out most others
    sized = skew_join(skew_join(pairs, side["b"], "b"), side["a"], "a", counted=pairs).where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    likely = sized.where(estimate("registers_a", "registers_b", "n_a", "n_b") >= percent / 100 - MARGIN).select("a", "b", "row_a", "id_a", "row_b", "id_b")
    likely = materialise(likely, "likely", n_pairs)
    discard(about)
    texts = _texts(docs, likely.select(F.col("row_a").alias("row")).union(likely.select("row_b")), id_col, text_col, most)
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = (s for some in shingle_sets(batch.column("text_a"), width) for s in some)
            right = (s for some in shingle_sets(batch.column("text_b"), width) for s in some)
            good = []
            for x, y in zip(left, right, strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    of = {s: texts.select(F.col("row").alias(f"row_{s}"), F.col("text_id").alias(f"text_id_{s}"), F.col("text").alias(f"text_{s}")) for s in "ab"}
    own = lambda s: F.col(f"id_{s}").eqNullSafe(F.col(f"text_id_{s}"))
    both = skew_join(skew_join(likely, of["b"], "row_b").where(own("b")), of["a"], "row_a", counted=likely).where(own("a"))
    found = materialise(both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long"), "links", n_pairs)
    discard(texts)
    discard(likely)
    return found


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """A row per linked node: node, label (the smallest node it reaches). Rounds of taking the neighbours' smallest label
    and then the label's label; each is written out. After a given number of rounds, labels are nodes of the same
    component, though it may still have several."""
    most = 2 * links.count()
    edges = materialise(links.select("a", "b").union(links.select("b", "a")).distinct().toDF("u", "v"), "edges", most)
    labels = materialise(edges.groupBy("u").agg(F.min("v").alias("l")).select(F.col("u").alias("node"), F.least("u", "l").alias("label")), "labels", most)
    hot = hot_keys(edges, "v")
    done = False
    while not done:
        near = skew_join(edges, labels.select(F.col("node").alias("v"), F.col("label").alias("l")), "v", hot=hot).groupBy("u").agg(F.min("l").alias("l"))
        lower = labels.join(near.withColumnRenamed("u", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "l").alias("mid"))
        lower = materialise(lower, "lower", most)
        jumped = skew_join(lower, lower.select(F.col("node").alias("mid"), F.col("mid").alias("far")), "mid")
        after = materialise(jumped.select("node", F.least("mid", "far").alias("label"), "old"), "labels", most)
        discard(lower)
        rounds = rounds and rounds - 1
        done = rounds == 0 or not after.where("label <> old").head(1)
        discard(labels)
        labels = after.select("node", "label")
    discard(edges)
    return labels


def _bands(nodes: DataFrame) -> DataFrame:
    """A row per node and band: node, band and the hash of its registers there."""
    keys = [F.xxhash64(F.lit(k), F.substring("registers", 2 * ROWS * k + 1, 2 * ROWS)) for k in range(BANDS)]
    return nodes.select("node", F.posexplode_outer(F.array(*keys)).alias("band", "key"))


def _buckets(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b) to compare first, and the buckets of more than two nodes, a row (key, band, node) for each of their nodes."""
    bands = _bands(nodes)
    # numbers are mixed with the key, so that each bucket has a first node of its own; that and the key tell the number
    mixed = F.col("node").bitwiseXOR(F.col("key"))
    counted = bands.select("key", mixed.alias("m")).groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("m").alias("lo"), F.max("m").alias("hi"))
    shared = materialise(counted.where("c > 1").select("key", "c", (F.col("lo").bitwiseXOR(F.col("key"))).alias("pivot"), (F.col("hi").bitwiseXOR(F.col("key"))).alias("other")), "shared")
    wide = shared.where("c > 2")
    share = F.greatest(F.floor(F.lit((wide.agg(F.sum("c")).head()[0] or 0) / HOT_SLICES)), F.lit(MIN_HOT_ROWS))
    hot = wide.where(F.col("c") > share).select("key", F.ceil(F.col("c") / share).cast("int").alias("_n"))  # at most HOT_SLICES rows
    members = skew_join(maybe_in(bands, "key", wide.select("key")), wide.select("key", "pivot"), "key", hot=hot if hot.head(1) else None)
    buckets = materialise(members.select("key", "band", "node", "pivot"), "buckets")
    stars = buckets.where("node <> pivot").select(F.col("node").alias("x"), F.col("pivot").alias("y")).union(shared.where("c = 2").select("pivot", "other"))
    pairs = materialise(stars.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "pairs")
    discard(shared)
    return pairs, buckets


def prefixes(sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of its rarest shingles a set must show so that each set which it links to meets one of them: towards sets that are no larger, and towards those that are no smaller.

    Two sets that link share at least percent / (100 + percent) of their summed sizes. So of two sets whose first common
    shingle (in one order for all) stands behind these places in either, too few are left."""
    return sizes - -(-sizes * percent // 100) + 1, sizes - -(-2 * sizes * percent // (100 + percent)) + 1


def _rarest(docs: DataFrame, opened: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """A row (node, label, n, index, token, place) for each of the rarest shingles of the opened nodes (node, label, row, id, n), by
    which they may link: `index` of them towards nodes that are no smaller.

    Rarity is a count by hash, in a table of bounded size, so that the order is the same everywhere. Texts don't move."""
    text = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("row"), F.col(id_col).alias("text_id"), F.col(text_col).alias("text"))
    picked = maybe_in(text, "row", opened.select("row"))
    total = opened.agg(F.sum("n")).head()[0]
    cells = 1 << min(max(int(total).bit_length() - 4, LEAST_CELLS), MOST_CELLS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(cells, np.int32)
        for batch in batches:
            for sets in shingle_sets(batch.column("text"), width):
                held += np.bincount((np.concatenate(sets) % np.uint64(cells)).astype(np.int64), minlength=cells).astype(np.int32)
        salt = TaskContext.get().partitionId() % CELL_SALTS
        for chunk in range(0, cells, CELL_CHUNK):
            part = held[chunk : chunk + CELL_CHUNK]
            at = np.flatnonzero(part)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([chunk // CELL_CHUNK]), pa.array([salt]), pa.array([at.astype(np.uint16).tobytes()], pa.binary()), pa.array([part[at].astype(np.int64).tobytes()], pa.binary())], ["chunk", "salt", "cells", "counts"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        """The counts of a chunk from several tasks, added up."""
        total = np.zeros(CELL_CHUNK, np.int64)
        for at, counts in zip(frame["cells"], frame["counts"], strict=True):
            total[np.frombuffer(at, np.uint16)] += np.frombuffer(counts, np.int64)
        at = np.flatnonzero(total)
        return pd.DataFrame({"chunk": frame["chunk"].iloc[:1], "salt": frame["salt"].iloc[:1], "cells": [at.astype(np.uint16).tobytes()], "counts": [total[at].tobytes()]})

    kind = "chunk long, salt long, cells binary, counts binary"
    counted = picked.mapInArrow(count, kind).groupBy("chunk", "salt").applyInPandas(add, kind).withColumn("salt", F.lit(0).cast("long")).groupBy("chunk", "salt").applyInPandas(add, kind)
    logged = np.zeros(cells, np.uint8)  # a byte for each cell: how often, as a logarithm of eight steps an octave
    for r in counted.repartition(-(-cells // (CELL_CHUNK * CHUNKS))).toLocalIterator():  # a job for each partition, so few of them
        logged[r["chunk"] * CELL_CHUNK + np.frombuffer(r["cells"], np.uint16).astype(np.int64)] = np.minimum(8 * np.log2(np.frombuffer(r["counts"], np.int64) + 1.0), 255)
    shared = docs.sparkSession.sparkContext.broadcast(logged)

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, index = [], []
            for sets in shingle_sets(batch.column("text"), width):
                for s in sets:
                    towards_smaller, towards_larger = prefixes(np.array([len(s)]), percent)
                    order = np.lexsort((s, shared.value[(s % np.uint64(cells)).astype(np.int64)]))[: towards_smaller[0]]
                    tokens.append(s[order].view(np.int64))
                    index.append(int(towards_larger[0]))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text_id"), pa.array(tokens, pa.list_(pa.int64())), pa.array(index, pa.int32())], ["row", "text_id", "tokens", "index"])

    kind = docs.schema[id_col].dataType.simpleString()
    met = opened.join(picked.mapInArrow(show, f"row long, text_id {kind}, tokens array<long>, index int"), "row").where(F.col("id").eqNullSafe(F.col("text_id"))).dropDuplicates(["node"])
    return met.select("node", "label", "n", "index", F.posexplode_outer("tokens").alias("place", "token"))


def _crossing(buckets: DataFrame, labels: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, most: int) -> DataFrame:
    """Links between nodes of different components in the open buckets (step 3). most: rows of docs, at most."""
    spark = docs.sparkSession
    labelled = skew_join(buckets.select("key", "node"), labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    labelled = materialise(labelled, "labelled")
    still = materialise(labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key"), "still", buckets.count())
    if not still.head(1):
        discard(labelled)
        return spark.createDataFrame([], "a long, b long")
    of_open = skew_join(labelled, still, "key").groupBy("node").agg(F.first("label").alias("label"))
    opened = materialise(of_open.join(nodes.select("node", "row", "id", "n"), "node"), "opened", most)
    discard(labelled)
    tokens = materialise(_rarest(docs, opened, id_col, text_col, width, percent), "tokens")
    met_in = tokens.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max(F.col("place") < F.col("index")).alias("indexed")).where("lo <> hi and indexed").select("token")
    met_in = materialise(met_in, "met")
    if not met_in.head(1):
        return spark.createDataFrame([], "a long, b long")
    shown = skew_join(maybe_in(tokens, "token", met_in), met_in, "token").select(F.col("token").alias("key"), "node", "label", "n", "place", "index")
    shown = materialise(shown, "shown")
    discard(tokens)
    sizes = shown.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    state = sizes.groupBy("key").agg(F.sum("c").alias("all"), F.max(F.struct("c", "label")).alias("major"))
    state = state.select("key", F.col("major.label").alias("major"), F.ceil((F.col("all") - F.col("major.c")) / BLOCK).cast("int").alias("nq"), F.ceil(F.col("all") / BLOCK).cast("int").alias("ns"))
    state = materialise(state, "open", met_in.count())
    rows = skew_join(shown, state, "key")
    own = lambda c: F.pmod(F.xxhash64("node", F.lit(3)), F.col(c)).cast("int")
    every = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    cols = ["node", "key", "label", "n", "place", "index"]
    stands = rows.select(*cols, F.lit(0).alias("asks"), F.explode_outer(every("nq")).alias("q"), own("ns").alias("s"))
    asks = rows.where("label <> major").select(*cols, F.lit(1).alias("asks"), own("nq").alias("q"), F.explode_outer(every("ns")).alias("s"))
    placed = materialise(stands.union(asks), "placed")
    about = materialise(maybe_in(nodes.select("node", "registers"), "node", opened.select("node")), "about")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # blocks are few bytes but long to compare, so they are not packed by size
    block = skew_join(placed, about, "node").select("key", "q", "s", "asks", "node", "label", "n", "place", "index", "registers")
    dealt = block.repartition(tasks, "key", "q", "s").sortWithinPartitions("key", "q", "s", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["key", "q", "s"]):
            yield from likely_pairs(rows, percent)

    pairs = materialise(dealt.mapInArrow(run, "a long, b long").distinct(), "pairs")
    links = verified(pairs, nodes, docs, id_col, text_col, width, percent, most)
    for used in (opened, met_in, shown, state, placed, about, pairs):
        discard(used)
    return links


def whole_groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Sorted rows in pieces that end where a group ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in by]
        new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        if held and batch.num_rows and any(held[-1].column(c)[-1] != batch.column(c)[0] for c in by):
            yield pa.Table.from_batches(held)
            held = []
        if len(new):
            yield pa.Table.from_batches([*held, batch.slice(0, int(new[-1]))])
            held = [batch.slice(int(new[-1]))]
        elif batch.num_rows:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def likely_pairs(rows: pa.Table, percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) of an asking and an asked node of one block (rows by key, q, s; the asked first) that may link, in pieces."""
    key, q, s, asks, node, label, n, place, index = (rows.column(c).to_numpy() for c in ("key", "q", "s", "asks", "node", "label", "n", "place", "index"))
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (q[1:] != q[:-1]) | (s[1:] != s[:-1])
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    asked = np.bincount(group, weights=asks == 0).astype(np.int64)
    ask = np.flatnonzero(asks == 1)
    many = asked[group[ask]]
    # as many askers at a time as keep their pairs within a bound; one asker has at most a block of partners
    piece = np.cumsum(many) // PAIRS
    registers = None
    for k in np.unique(piece):
        i = ask[piece == k]
        m = many[piece == k]
        x = np.repeat(i, m)
        y = np.repeat(first[group[i]] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
        a, b = n[x], n[y]
        left = np.minimum(a - place[x], b - place[y])  # this shingle and those behind it: where it is the first in common, the two share no more
        fit = (label[x] != label[y]) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & ((100 + percent) * left >= percent * (a + b))
        fit &= ((a <= b) & (place[x] < index[x])) | ((b <= a) & (place[y] < index[y]))
        lo, hi = np.minimum(node[x[fit]], node[y[fit]]), np.maximum(node[x[fit]], node[y[fit]])
        _, once = np.unique(np.stack([lo, hi], axis=1), axis=0, return_index=True)
        x, y = x[fit][once], y[fit][once]
        if not len(x):
            continue
        if registers is None:
            registers = np.frombuffer(b"".join(rows.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        for at in range(0, len(x), PAIRS // REGISTERS):
            u, v = x[at : at + PAIRS // REGISTERS], y[at : at + PAIRS // REGISTERS]
            good = jaccard((registers[u] > registers[v]).sum(1), (registers[u] < registers[v]).sum(1), n[u].astype(float), n[v].astype(float)) >= percent / 100 - MARGIN
            u, v = node[u[good]], node[v[good]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["a", "b"])


def _grouped(docs: DataFrame, id_col: str, text_col: str, width: int, threshold: float) -> DataFrame:
    """A row per document: id, n (set size), row (hash of id and text), grp (a number of its group; null for empty sets) and component_id."""
    prepare(docs.sparkSession)
    percent = round(threshold * 100)
    sketched = materialise(features(docs, id_col, text_col, width), "features")
    most = sketched.count()
    first = F.first(F.struct("registers", "n", "row", "id"))
    nodes = sketched.where("n > 0").groupBy("digest").agg(first.alias("f"), F.min("id").alias("least")).select(F.monotonically_increasing_id().alias("node"), "digest", "f.*", "least")
    nodes = materialise(nodes, "nodes")  # numbers are fixed by writing them
    found = materialise(sketched.select("id", "row", "n", "digest"), "found")
    discard(sketched)
    pairs, buckets = _buckets(nodes)
    links = verified(pairs, nodes, docs, id_col, text_col, width, percent, most)
    discard(pairs)
    labels = components(links, rounds=4)
    more = _crossing(buckets, labels, nodes, docs, id_col, text_col, width, percent, most)
    discard(buckets)
    discard(labels)
    labels = components(links.union(more))
    named = nodes.select("node", "digest", "least").join(labels, "node", "left").select("digest", "least", F.coalesce("label", "node").alias("grp"))
    named = materialise(named, "named")
    for used in (links, more, labels, nodes):
        discard(used)
    smallest = named.groupBy("grp").agg(F.min("least").alias("component_id"))
    by_node = materialise(skew_join(named, smallest, "grp").select("digest", "grp", "component_id"), "by_node")
    discard(named)
    out = skew_join(found, by_node, "digest", "left")
    return out.select("id", "n", "row", "grp", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """A row per document: id, n_shingles, component_id, kept (id = component_id)."""
    kept = F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    return _grouped(docs, id_col, text_col, width, threshold).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", kept)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row of each group, all columns kept, whatever their names: one of its smallest id (of several such rows, one with
    the smallest hash of its text, and any one of rows that repeat that). Rows without words belong to no group and all stay."""
    found = _grouped(docs, id_col, text_col, width, threshold).where("grp is not null")
    rows = found.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("grp", "row").agg(F.first("id").alias("id"), F.count(F.lit(1)).alias("c"))
    stay = materialise(rows.groupBy("grp").agg(F.min(F.struct("row", "id", "c")).alias("s")).select("s.*"), "stay")
    id_, text = docs[f"`{id_col}`"], docs[f"`{text_col}`"]
    wordless = ~F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]")

    def of(some: DataFrame) -> DataFrame:
        return docs.where(~wordless).join(some, (F.xxhash64(id_, text) == some["row"]) & id_.eqNullSafe(some["id"]), "left_semi")

    kept = docs.where(wordless).unionByName(of(stay.where("c = 1")))
    repeated = stay.where("c > 1")
    if not repeated.head(1):
        return kept
    held = of(repeated)  # only rows that repeat are merged
    one = held.select(F.struct(*[held[f"`{c}`"] for c in held.columns]).alias("doc"), F.xxhash64(held[f"`{id_col}`"], held[f"`{text_col}`"]).alias("row"), held[f"`{id_col}`"].alias("id"))
    return kept.unionByName(one.dropDuplicates(["row", "id"]).select("doc.*"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"), width=2)
