"""The audit chain, erasure, retention and minimisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GENESIS = "0" * 64
#: Rows of a key's chain that one task checks.
SLICE = 100_000


def canonical(cols: list[str], schema: DataFrame) -> Column:
    """A1: one string of the columns, each by its length, so that no two rows share one; times count in microseconds, arrays and structs as JSON."""
    parts = []
    for c in cols:
        kind = schema.schema[c].dataType.typeName()
        v = F.unix_micros(c).cast("string") if kind == "timestamp" else F.to_json(c) if kind in ("array", "struct", "map") else F.col(c).cast("string")
        parts.append(F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("-")))
    return F.concat_ws(",", *parts)


def payload_hash(rows: DataFrame, cols: list[str]) -> Column:
    return F.sha2(canonical(sorted(cols), rows), 256)


def row_hash(prev: Column, kind: Column, ref: Column, ts: Column, payload: Column, detail: Column) -> Column:
    return F.sha2(F.concat_ws("|", prev, kind, ref.cast("string"), ts.cast("string"), payload, F.coalesce(detail, F.lit(""))), 256)


def append(chain: DataFrame | None, entries: DataFrame, key: list[str] | None = None) -> DataFrame:
    """A2: new chain rows for entries (kind, ref_id, ts, payload_hash, detail, ord), after the chain's head.

    A hash chain is serial: an append folds the entries of one micro-batch in order, seeded with the stored head. With
    `key` (columns of both: endpoints, say) each key has a chain of its own and all are folded at once; only digests
    take part. A key's entries of one batch meet in one row, so a batch should be as small as its trigger makes it."""
    key = key or []
    e = F.struct("ord", "kind", "ref_id", F.unix_micros("ts").alias("us"), "payload_hash", F.coalesce("detail", F.lit("")).alias("detail"))
    listed = entries.groupBy(*key).agg(F.array_sort(F.collect_list(e)).alias("es"))
    if chain is None:
        listed = listed.withColumn("head", F.lit(None).cast("struct<seq:bigint,row_hash:string>"))
    else:
        heads = chain.groupBy(*key).agg(F.max(F.struct(F.col("seq").cast("bigint").alias("seq"), "row_hash")).alias("head"))
        listed = listed.join(heads, key, "left") if key else listed.crossJoin(heads)  # without keys both have one row
    kind = "struct<seq:bigint,kind:string,ref_id:bigint,us:bigint,payload_hash:string,detail:string,prev_hash:string,row_hash:string>"
    start = F.struct(F.array().cast(f"array<{kind}>").alias("rows"), F.coalesce("head.row_hash", F.lit(GENESIS)).alias("prev"), F.coalesce("head.seq", F.lit(0).cast("bigint")).alias("seq"))

    def step(acc: Column, x: Column) -> Column:
        h = row_hash(acc["prev"], x["kind"], x["ref_id"], x["us"], x["payload_hash"], x["detail"])
        row = F.struct((acc["seq"] + 1).alias("seq"), x["kind"].alias("kind"), x["ref_id"].cast("bigint").alias("ref_id"), x["us"].alias("us"), x["payload_hash"].alias("payload_hash"), x["detail"].alias("detail"), acc["prev"].alias("prev_hash"), h.alias("row_hash"))
        return F.struct(F.array_append(acc["rows"], row.cast(kind)).alias("rows"), h.alias("prev"), (acc["seq"] + 1).alias("seq"))

    rows = listed.select(*key, F.explode(F.aggregate("es", start, step, lambda a: a["rows"])).alias("r")).select(*key, "r.*")
    return rows.withColumn("ts", F.timestamp_micros("us")).drop("us")


def verify(chain: DataFrame, tables: dict[str, tuple[DataFrame, list[str]]], slices: int = 64, key: list[str] | None = None) -> DataFrame:
    """A3, A4: problems (key, seq, problem) of a chain, or of the chains of all keys. tables: kind -> (rows with id, hashed columns).

    Each slice of seq is checked on its own, and the first row of a slice against the last one of those before, so no
    task holds the chain."""
    key = key or []
    size = F.greatest(F.ceil(F.lit(chain.agg(F.max("seq")).head()[0] or 0) / slices), F.lit(1)).cast("bigint") if not key else F.lit(SLICE)
    want = row_hash(F.col("prev_hash"), F.col("kind"), F.col("ref_id"), F.unix_micros("ts"), F.col("payload_hash"), F.col("detail"))
    # a row is checked against itself where it is, so that only its place and links move
    c = chain.select(*key, "seq", "prev_hash", "row_hash", (F.col("row_hash") != want).alias("rewritten"), F.floor((F.col("seq") - 1) / size).alias("slice"))
    ends = c.groupBy(*key, "slice").agg(F.max(F.struct("seq", "row_hash")).alias("e"))  # a row per slice
    before = ends.select(*key, "slice", F.lag("e").over(W.partitionBy(*key).orderBy("slice")).alias("b"))
    w = W.partitionBy(*key, "slice").orderBy("seq")
    linked = c.join(before if key else F.broadcast(before), [*key, "slice"]).select(
        c["*"], F.coalesce(F.lag("row_hash").over(w), F.col("b.row_hash"), F.lit(GENESIS)).alias("want_prev"), F.coalesce(F.lag("seq").over(w), F.col("b.seq"), F.lit(0)).alias("last_seq"))
    checks = F.array_compact(F.array(
        F.when(F.col("seq") != F.col("last_seq") + 1, "missing entry"), F.when(F.col("prev_hash") != F.col("want_prev"), "broken link"), F.when(F.col("rewritten"), "rewritten entry")))
    problems = linked.select(*key, "seq", F.explode(checks).alias("problem"))
    erased = chain.where("kind = 'erase'")
    until = erased.agg(F.max(F.get_json_object("detail", "$.all_until").cast("bigint")).alias("until"))
    ids = erased.select(F.explode(F.from_json(F.get_json_object("detail", "$.ids"), "array<bigint>")).alias("ref_id")).distinct().withColumn("erased", F.lit(True))
    for kind, (rows, cols) in tables.items():
        now = rows.select(F.col("id").alias("ref_id"), payload_hash(rows, cols).alias("now"))
        met = chain.where(F.col("kind") == kind).select(*key, "seq", "ref_id", "payload_hash").join(now, "ref_id", "left")
        # edited and missing rows come from one join, in which entries move once
        found = met.select(*key, "seq", "ref_id", F.when(F.col("now").isNull(), "missing row").when(F.col("now") != F.col("payload_hash"), "edited row").alias("problem")).where("problem is not null")
        covered = F.col("erased").isNotNull() | F.coalesce(F.col("ref_id") <= F.coalesce("until", F.lit(-1)), F.lit(False))
        told = found.join(ids, "ref_id", "left").crossJoin(F.broadcast(until)).where((F.col("problem") == "edited row") | ~covered)
        problems = problems.union(told.select(*key, "seq", "problem"))
    return problems


def erase_entry(spark: SparkSession, operator: str, reason: str, ts, all_until: int | None = None, ids: list[int] | None = None) -> DataFrame:
    """A5: the chain entry that covers an erasure; it is appended even if nothing was erased."""
    detail = F.to_json(F.struct(F.lit(operator).alias("operator"), F.lit(reason).alias("reason"), F.lit(all_until).cast("bigint").alias("all_until"), F.array(*[F.lit(i).cast("bigint") for i in ids or []]).alias("ids")))
    return spark.range(1).select(F.lit("erase").alias("kind"), F.lit(0).cast("bigint").alias("ref_id"), F.lit(ts).cast("timestamp").alias("ts"), F.sha2(detail, 256).alias("payload_hash"), detail.alias("detail"), F.lit(0).alias("ord"))


def erase_all(alerts: DataFrame, operator: str, reason: str, ts) -> tuple[DataFrame, DataFrame]:
    """A5: (what is left of the alerts: nothing, the chain entry with the largest id that was erased)."""
    last = alerts.agg(F.max("id")).head()[0]
    return alerts.where(F.lit(False)), erase_entry(alerts.sparkSession, operator, reason, ts, all_until=last)


def purge_entries(expired: DataFrame, days: int, ts, block: int = 10_000) -> DataFrame:
    """Chain entries that list the ids of expired alerts, a block of ids each, so that no entry grows with the table."""
    listed = expired.groupBy(F.floor(F.col("id") / block).alias("ord")).agg(F.sort_array(F.collect_set(F.col("id").cast("bigint"))).alias("ids"))
    detail = F.to_json(F.struct(F.lit(f"retention_{days}d").alias("reason"), F.col("ids")))
    return listed.select(F.lit("erase").alias("kind"), F.lit(0).cast("bigint").alias("ref_id"), F.lit(ts).cast("timestamp").alias("ts"), F.sha2(detail, 256).alias("payload_hash"), detail.alias("detail"), "ord")


def purge(rows: DataFrame, as_of, days: int) -> tuple[DataFrame, DataFrame]:
    """(rows kept, rows expired); each table is purged by its own ages."""
    limit = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))
    return rows.where(F.col("ts") >= limit), rows.where(F.col("ts") < limit)


def minimised(rows: DataFrame, store: bool, text_col: str = "transcript", translation_col: str | None = "translation") -> DataFrame:
    """With transcript_hash (16 digits), and without the texts unless they may be stored."""
    out = rows.withColumn("transcript_hash", F.substring(F.sha2(F.coalesce(text_col, F.lit("")), 256), 1, 16))
    for c in [text_col, *([translation_col] if translation_col else [])]:
        out = out.withColumn(c, F.col(c) if store else F.lit(None).cast("string"))
    return out


def privacy_manifest(store_transcripts: bool, send_transcripts: bool) -> dict:
    """A9."""
    always = ["id", "ts", "endpoint_id", "transcript_hash", "language", "severity", "threat_score", "matches", "categories"]
    return {"persisted": always + (["transcript", "translation"] if store_transcripts else []), "sent": ["event_id", "ts", "endpoint_id", "severity", "categories", "phrases"] + (["transcript"] if store_transcripts and send_transcripts else []), "audio": "never stored"}
