"""One audit chain for a table of any size (A1-A4): a hash tree over each batch, and a chain over the trees' roots.

Entries of a batch are leaves, in order. FANOUT neighbours make a node of the next level, up to one root, so a batch of n
entries takes log16(n) shuffles of digests and no task holds more than FANOUT of them together. Only roots are chained, a
row per batch. Whoever holds the chain's last row can tell that any entry stood where it stands: by its proof (its
siblings on the way up) and the root, or by comparing levels, which shows what was changed.

A batch is a micro-batch, a day or a range of ids: a column. Leaves and nodes are hashed under different names, so that
neither passes for the other. Entries of a null batch have no place in the order and are an error."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sottovoce.operators.audit import GENESIS
from sottovoce.operators.jumps import checkpointed

FANOUT = 16
_CHAIN = "seq bigint, batch bigint, n bigint, root string, prev_hash string, row_hash string"


def leaf_hash(kind: Column, ref: Column, ts: Column, payload: Column, detail: Column) -> Column:
    """The digest of an entry; ts in microseconds."""
    return F.sha2(F.concat_ws("|", F.lit("leaf"), kind, ref.cast("string"), ts.cast("string"), payload, F.coalesce(detail, F.lit(""))), 256)


def node_hash(children: Column) -> Column:
    """The digest of an array of digests."""
    return F.sha2(F.concat(F.lit("node|"), F.array_join(children, ",")), 256)


def leaves(entries: DataFrame, batch: str = "batch", order: str = "ord") -> DataFrame:
    """Entries (batch, kind, ref_id, ts, payload_hash, detail, ord) with their place in the batch, `pos`, and `hash`."""
    checked = entries.withColumn(batch, F.coalesce(F.col(batch), F.raise_error(F.lit("an entry has no batch"))).cast("bigint"))
    pos = (F.row_number().over(W.partitionBy(batch).orderBy(order, "kind", "ref_id")) - 1).cast("bigint")
    return checked.withColumns({"pos": pos, "hash": leaf_hash(F.col("kind"), F.col("ref_id"), F.unix_micros("ts"), F.col("payload_hash"), F.col("detail"))})


def forest(hashed: DataFrame, batch: str = "batch") -> DataFrame:
    """All nodes (batch, level, pos, hash, width: nodes of that level) of the trees over leaves()."""
    level = hashed.groupBy(F.col(batch).alias("batch")).agg(F.count(F.lit(1)).alias("width"))
    level = checkpointed(hashed.select(F.col(batch).alias("batch"), "pos", "hash").join(level, "batch").select("batch", F.lit(0).alias("level"), "pos", "hash", "width"))
    out, depth = level, 0
    while (open_ := level.where("width > 1")).head(1):
        depth += 1
        group = open_.groupBy("batch", F.floor(F.col("pos") / FANOUT).alias("pos")).agg(F.sort_array(F.collect_list(F.struct("pos", "hash"))).alias("c"), F.first("width").alias("width"))
        up = group.select("batch", F.lit(depth).alias("level"), "pos", node_hash(F.transform("c", lambda x: x["hash"])).alias("hash"), F.ceil(F.col("width") / FANOUT).alias("width"))
        level = checkpointed(up)
        out = out.unionByName(level)
    return out


def heads(nodes: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Chain rows (seq, batch, n, root, prev_hash, row_hash) for the trees, in the order of their batches, after the last row
    of the chain `before`. A chain is serial, so one task passes over the roots, a row per batch, and holds none of them; a
    stream adds one at a time."""
    sizes = nodes.where("level = 0").groupBy("batch").agg(F.count(F.lit(1)).alias("n"))
    roots = nodes.where("width = 1").select("batch", F.col("hash").alias("root")).join(sizes, "batch")
    last = before.agg(F.max(F.struct("seq", "row_hash")).alias("h")).head()["h"] if before is not None else None
    seq, prev = (last["seq"], last["row_hash"]) if last else (0, GENESIS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, head = seq, prev
        for roots_ in batches:
            out = []
            for r in roots_.to_pylist():
                row = hashlib.sha256(f"{head}|batch|{r['batch']}|{r['n']}|{r['root']}".encode()).hexdigest()
                at += 1
                out.append((at, r["batch"], r["n"], r["root"], head, row))
                head = row
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["seq", "batch", "n", "root", "prev_hash", "row_hash"])

    return roots.select("batch", "n", "root").repartition(1).sortWithinPartitions("batch").mapInArrow(run, _CHAIN)


def proofs(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """For wanted leaves (batch, pos): batch, pos, leaf and proof, the array (from below) of the siblings of each level, own
    place among them included as null."""
    def masked(c: Column, own: Column) -> Column:
        return F.transform(c, lambda x: F.when(x["pos"] != own, x["hash"]))

    family = nodes.where("width > 1").groupBy("batch", "level", F.floor(F.col("pos") / FANOUT).alias("pos")).agg(F.sort_array(F.collect_list(F.struct("pos", "hash"))).alias("c"))
    family, none = checkpointed(family), F.array().cast("array<array<string>>")
    above = None
    # from the top down: siblings share what lies above them, so it moves once for each family, and reaches leaves only in the end
    for level in range(family.agg(F.max("level")).head()[0] or 0, -1, -1):
        here = family.where(F.col("level") == level).select("batch", "pos", "c")
        here = here.withColumn("up", none) if above is None else here.join(above, ["batch", "pos"], "left").withColumn("up", F.coalesce("up", none))
        if level:
            above = here.select("batch", "up", "c", F.explode_outer("c").alias("m")).select("batch", F.col("m.pos").alias("pos"), F.concat(F.array(masked(F.col("c"), F.col("m.pos"))), F.col("up")).alias("up"))
    alone = nodes.where("level = 0 and width = 1").select("batch", F.lit(0).cast("bigint").alias("pos"), F.array(F.struct("pos", "hash")).alias("c"), F.lit(None).cast("array<array<string>>").alias("up"))
    asked = wanted.select("batch", F.col("pos").alias("own"), F.floor(F.col("pos") / FANOUT).alias("pos")).distinct()
    met = asked.join(here.unionByName(alone), ["batch", "pos"])
    leaf = F.get(F.filter("c", lambda x: x["pos"] == F.col("own")), F.lit(0))["hash"]
    proof = F.when(F.col("up").isNull(), none).otherwise(F.concat(F.array(masked(F.col("c"), F.col("own"))), F.col("up")))
    return met.select("batch", F.col("own").alias("pos"), leaf.alias("leaf"), proof.alias("proof")).where("leaf is not null")


def proven_root(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda below, siblings: node_hash(F.transform(siblings, lambda s: F.coalesce(s, below))))


def verify(chain: DataFrame, nodes: DataFrame, entries: DataFrame) -> DataFrame:
    """Problems (batch, level, pos, ref_id, problem) of the chain, the stored trees, and the entries as they are now (of
    (batch, kind, ref_id) each once, with pos as leaves() gave it): what was edited, is missing, or was put in; nodes that
    don't follow from those below; roots and links of the chain that don't fit."""
    none = F.lit(None).cast("bigint")
    now = entries.select("batch", "pos", "ref_id", leaf_hash(F.col("kind"), F.col("ref_id"), F.unix_micros("ts"), F.col("payload_hash"), F.col("detail")).alias("now"))
    told = nodes.where("level = 0").select("batch", "pos", "hash").join(now, ["batch", "pos"], "full")
    what = F.when(F.col("now").isNull(), "missing entry").when(F.col("hash").isNull(), "unknown entry").when(F.col("now") != F.col("hash"), "edited entry")
    problems = told.select("batch", F.lit(0).alias("level"), "pos", "ref_id", what.alias("problem"))
    made = nodes.where("width > 1").groupBy("batch", (F.col("level") + 1).alias("level"), F.floor(F.col("pos") / FANOUT).alias("pos")).agg(F.sort_array(F.collect_list(F.struct("pos", "hash"))).alias("c"))
    made = made.select("batch", "level", "pos", node_hash(F.transform("c", lambda x: x["hash"])).alias("made"))
    inner = nodes.where("level > 0").select("batch", "level", "pos", "hash").join(made, ["batch", "level", "pos"], "full")
    problems = problems.unionByName(inner.select("batch", "level", "pos", none.alias("ref_id"), F.when(~F.col("hash").eqNullSafe(F.col("made")), "rewritten node").alias("problem")))
    roots = nodes.where("width = 1").select("batch", F.col("hash").alias("is"))
    after = chain.select((F.col("seq") + 1).alias("seq"), F.col("row_hash").alias("want"))
    row = F.sha2(F.concat_ws("|", "prev_hash", F.lit("batch"), F.col("batch").cast("string"), F.col("n").cast("string"), "root"), 256)
    linked = chain.join(roots, "batch", "full").join(after, "seq", "left")
    wrong = F.array_compact(F.array(
        F.when(F.col("seq").isNull(), "unchained batch"), F.when(F.col("seq").isNotNull() & ~F.col("root").eqNullSafe(F.col("is")), "wrong root"),
        F.when(F.col("prev_hash") != F.coalesce("want", F.when(F.col("seq") == 1, F.lit(GENESIS)).otherwise(F.lit(""))), "broken link"), F.when(F.col("row_hash") != row, "rewritten row")))
    problems = problems.unionByName(linked.select("batch", F.lit(None).cast("int").alias("level"), none.alias("pos"), none.alias("ref_id"), F.explode(wrong).alias("problem")))
    return problems.where("problem is not null")
