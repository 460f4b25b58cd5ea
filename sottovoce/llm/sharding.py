"""Sharding by jump consistent hashing: a stable key and the number of shards decide; there is no ring table.

The generator is the published one (a 64-bit linear congruence). With one more shard, only rows that go into the new shard move.

Defined cases: a null key is sharded as the key 0 and a null text has no bytes; equal keys share a shard; rows that
repeat get slots next to each other; an empty table gives an empty result. assign() and write_shards() keep all columns,
those named shard or grown_shard as kept_<name>; manifest() returns its own columns only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sottovoce.llm.common import clear_of, materialise, table

# The multiplier of the published generator.
MULTIPLIER = 2862933555777941757
WORD = 1 << 64
#: The expected number of jumps is about the logarithm of the shard count; rows that need more steps take the long way.
SHORT = 64
#: Rows that a slice of a shard should hold at most, and the fewest slices.
SLICE_ROWS, SLICES = 100_000, 16
#: Offsets of slices that are broadcast at most; more are joined.
BROADCAST_OFFSETS = 1 << 18


def _walk(key: Column, shards: int, steps: int) -> Column:
    """struct(k, b, j) after `steps` jumps; the walk is over once j >= shards."""
    word = lambda x: F.lit(str(x)).cast("decimal(38,0)")
    start = F.struct(key.alias("k"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def jump(acc: Column, _: Column) -> Column:
        k = (acc["k"] * F.lit(str(MULTIPLIER)).cast("decimal(19,0)") + F.lit(1)).cast("decimal(38,0)") % word(WORD)
        high = F.floor(k / word(1 << 33)).cast("double")
        j = F.floor((acc["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (high + 1.0))).cast("long")
        return F.when(acc["j"] >= shards, acc).otherwise(F.struct(k.cast("decimal(20,0)").alias("k"), acc["j"].alias("b"), j.alias("j")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, jump)


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, 0 to shards - 1, of a bigint key."""
    wide = F.coalesce(key, F.lit(0)).cast("decimal(20,0)")
    unsigned = F.when(wide < 0, (wide + F.lit(str(WORD)).cast("decimal(20,0)")).cast("decimal(20,0)")).otherwise(wide)
    walked = _walk(unsigned, shards, min(SHORT, shards))
    if shards <= SHORT:
        return walked["b"].cast("int")
    return F.when(walked["j"] >= shards, walked["b"]).otherwise(_walk(unsigned, shards, shards)["b"]).cast("int")


def assign(docs: DataFrame, shards: int, id_col: str = "doc_id", key_col: str | None = None) -> DataFrame:
    """docs with `shard` and, for one shard more, `grown_shard`. Keys that are not integers are hashed first."""
    clear, of = clear_of(docs, "shard", "grown_shard")
    key = of(key_col or id_col)
    if docs.schema[key_col or id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        key = F.when(key.isNotNull(), F.xxhash64(key))
    return clear.withColumns({"shard": jump_hash(key.cast("long"), shards), "grown_shard": jump_hash(key.cast("long"), shards + 1)})


def manifest(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document, without its text: id, size (UTF-8 bytes and 1), text_crc32, law, shard, slot (its place in
    the shard, without gaps from 0) and grown_shard.

    Slots: the rows of a shard are dealt into slices by hash, as many as keep a slice at about SLICE_ROWS, numbered within a
    slice, and shifted by the rows of the slices before; no task holds a shard."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col), F.octet_length(text).cast("long") + 1, F.crc32(text.cast("binary")).cast("long")).toDF(id_col, "size", "text_crc32")
    spread = F.xxhash64(F.col(id_col), F.col("text_crc32"), F.spark_partition_id())  # the partition parts even rows that are all alike
    dealt = materialise(assign(slim, shards, id_col).withColumn("spread", spread), "dealt")
    slices = max(SLICES, -(-dealt.count() // (shards * SLICE_ROWS)))
    dealt = dealt.withColumn("slice", F.pmod("spread", F.lit(slices)).cast("int")).drop("spread")
    counts = dealt.groupBy("shard", "slice").count()  # shards x slices rows
    before = F.sum("count").over(W.partitionBy("shard").orderBy("slice").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select("shard", "slice", F.coalesce(before, F.lit(0)).alias("before"))
    offsets = F.broadcast(offsets) if shards * slices <= BROADCAST_OFFSETS else offsets
    place = F.row_number().over(W.partitionBy("shard", "slice").orderBy(id_col, "text_crc32", "size"))
    placed = dealt.withColumn("place", place).join(offsets, ["shard", "slice"])
    return placed.select(id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("place") - 1).cast("long").alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int, id_col: str = "doc_id") -> None:
    """Writes docs as Parquet in one folder for each shard; large shards take several files."""
    assign(docs, shards, id_col).drop("grown_shard").write.partitionBy("shard").parquet(path)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"), 16)
