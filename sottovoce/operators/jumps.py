"""Greedy choices over ordered rows, in which each choice depends on the last, without a fold per key.

Where the next choice after any row can be told from that row alone, every row points to it, and the rows that are chosen
are those that pointers lead to from the first. Pointers are doubled: after k rounds a pointer spans 2^k choices, so a chain
of n choices takes about log2(n) rounds of joins, each spread over all tasks, however long one key's chain is."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; on a local master, where none is set, one of our own."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not where:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="sottovoce-"))
        where = context.getCheckpointDir()
    return where.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed and written to the shared folder as a table. That cuts its lineage, and what is estimated of its size is
    what it has: in rounds of joins, estimates upon estimates would grow without bound."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def reached(nodes: DataFrame, key: list[str]) -> DataFrame:
    """Of nodes (key, at, nxt: the node they lead to, or null; start) those that are a start or are led to: key and at.

    Joins here are merges: rows of small numbers take far less room in a file than in memory, so a broadcast, of which one
    a round passes through the driver, would be of many times the size that its file promises."""
    jump = checkpointed(nodes.select(*key, "at", "nxt", "start"))
    seen, jump = jump.where("start").select(*key, "at"), jump.where("nxt is not null").select(*key, "at", "nxt")
    while jump.head(1):
        led = seen.join(jump.hint("merge"), [*key, "at"]).select(*key, F.col("nxt").alias("at"))
        seen = checkpointed(seen.union(led).distinct())
        on = jump.select(*key, F.col("at").alias("nxt"), F.col("nxt").alias("far"))
        jump = checkpointed(jump.join(on.hint("merge"), [*key, "nxt"]).select(*key, "at", F.col("far").alias("nxt")))
    return seen


def first_from(rows: DataFrame, probes: DataFrame, key: list[str], place: str, taken: list[str], out: str) -> DataFrame:
    """probes (key, place and more) with a struct `out` of `taken` of the first row of its key at its place or behind; null if there is none.

    Both are sorted together once, from the end, and each probe takes the row that passed last; so a window runs over a key's
    rows without holding them."""
    named = F.struct(*[F.col(f"`{c}`").alias(c) for c in taken])
    kept = [c for c in probes.columns if c not in (*key, place)]
    a = rows.select(*key, F.col(place).alias("_x"), F.lit(1).alias("_row"), named.alias(out))
    b = probes.select(*key, F.col(place).alias("_x"), F.lit(0).alias("_row"), F.struct(*kept).alias("_probe"))
    w = W.partitionBy(*key).orderBy(F.desc("_x"), F.desc("_row"), F.desc(out)).rowsBetween(W.unboundedPreceding, 0)
    met = a.unionByName(b, allowMissingColumns=True).withColumn(out, F.last(out, ignorenulls=True).over(w))
    return met.where("_row = 0").select(*key, F.col("_x").alias(place), "_probe.*", out)


def spaced(events: DataFrame, key: list[str], ts: str, order: str, gap_seconds: float) -> DataFrame:
    """The events of which each comes at least gap_seconds after the last one of its key that passed; the first passes.
    Equal times go by `order`, which tells a key's events apart. Events without a time don't pass."""
    numbered = events.where(F.col(ts).isNotNull()).withColumn("_at", F.row_number().over(W.partitionBy(*key).orderBy(ts, order)))
    rows = checkpointed(numbered.select(*key, F.unix_micros(ts).alias("_us"), F.col("_at").cast("long").alias("at")))
    probes = rows.select(*key, (F.col("_us") + int(gap_seconds * 1e6)).alias("_us"), "at")
    led = first_from(rows.withColumnRenamed("at", "_to"), probes, key, "_us", ["_to"], "_n")
    chosen = reached(led.select(*key, "at", F.col("_n._to").alias("nxt"), (F.col("at") == 1).alias("start")), key)
    return numbered.join(chosen.withColumnRenamed("at", "_at").hint("merge"), [*key, "_at"], "left_semi").select(*events.columns)


def forced_segments(chunks: DataFrame, key: str, pre: int, hang: int, least: int, most: int, keep: int) -> DataFrame:
    """R3-R5 over finished sessions: key, segment_id, first, stop, speech of rows (key, chunk_idx, speech), as state.segment has
    them; chunks that are missing are silent.

    Only chunks of speech can open a segment. Where one that opens at p closes depends on p and on how many chunks before p
    it took along (0 to `pre`), so these are the nodes: it closes where its run of speech has been silent for `hang`
    chunks, or when it is `most` long, and leads to the first chunk of speech behind. Runs so far from the one before
    that nothing of it can be taken along begin chains of their own, so that most chains have one segment."""
    k = [key]
    w = W.partitionBy(key).orderBy("i")
    spoken = chunks.where("speech").select(key, F.col("chunk_idx").cast("long").alias("i")).distinct()
    ends = chunks.groupBy(key).agg(F.min("chunk_idx").cast("long").alias("begin"), (F.max("chunk_idx") + 1).cast("long").alias("end"))
    marked = spoken.withColumns({"r": F.row_number().over(w).cast("long"), "prev": F.lag("i").over(w)}).withColumn("gap", F.col("i") - F.col("prev") - 1)
    runs = marked.withColumns({"run": F.sum((F.coalesce(F.col("gap") >= hang, F.lit(True))).cast("int")).over(w), "chain": F.sum((F.coalesce(F.col("gap") >= hang + pre, F.lit(True))).cast("int")).over(w)})
    runs = checkpointed(runs)
    closes = runs.groupBy(key, "run").agg((F.max("i") + hang + 1).alias("_by"))
    sized = runs.groupBy(key, "chain").agg(F.min("i").alias("head"), F.max("i").alias("last"), F.min("run").alias("_a"), F.max("run").alias("_b"))
    sized = sized.withColumn("alone", (F.col("_a") == F.col("_b")) & (F.col("last") + hang + 1 - F.col("head") + pre <= most)).select(key, "chain", "head", "alone")
    total = runs.groupBy(key).agg(F.max("r").alias("rows"), F.max("i").alias("final"))
    wide = runs.join(closes, [key, "run"]).join(sized, [key, "chain"]).join(ends, key).join(total, key).withColumn("_by", F.least("_by", "end"))
    wide = wide.where(~F.col("alone") | (F.col("i") == F.col("head")))
    opening = F.least(F.lit(pre), F.col("i") - F.col("begin")).cast("int")
    nodes = wide.withColumn("o", F.explode(F.when(F.col("alone"), F.array(opening)).otherwise(F.sequence(F.lit(0), F.lit(pre)))))
    nodes = nodes.withColumn("close", F.least("_by", F.col("i") - F.col("o") + most)).withColumn("start", (F.col("i") == F.col("head")) & (F.col("o") == opening))
    nodes = nodes.select(key, "close", "i", "o", "r", "chain", "start", "rows", "final")
    led = checkpointed(first_from(runs.select(key, F.col("i").alias("close"), "r", "i", "prev", "chain"), nodes, k, "close", ["r", "i", "prev", "chain"], "n"))
    number = lambda r, o: F.col(r) * (pre + 1) + o
    onward = F.when(F.col("n.chain") == F.col("chain"), number("n.r", F.least(F.lit(pre), F.col("n.i") - F.col("close"))))
    taken = reached(led.select(key, number("r", F.col("o")).alias("at"), onward.alias("nxt"), "start"), k)
    segments = led.withColumn("at", number("r", F.col("o"))).join(taken, [key, "at"], "left_semi")
    silent = F.col("close") - 1 - F.coalesce("n.prev", "final")
    found = segments.select(key, (F.col("i") - F.col("o")).alias("first"), (F.col("close") - F.greatest(silent - keep, F.lit(0))).alias("stop"), (F.coalesce("n.r", F.col("rows") + 1) - F.col("r")).alias("speech"))
    found = found.where(F.col("speech") >= least).withColumn("segment_id", (F.row_number().over(W.partitionBy(key).orderBy("first")) - 1).cast("long"))
    return found.select(key, "segment_id", "first", "stop", "speech")
