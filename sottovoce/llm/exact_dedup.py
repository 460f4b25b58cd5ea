"""Exact deduplication over content-defined chunk recipes.

Each text, with A-Z lower-cased, is cut where its content says so: after a line or sentence end, once a chunk is long
enough; where there is none for long, after a space behind certain letters, or else between certain pairs of characters.
So equal passages give equal chunks at any place. Chunks are deduplicated to verified identifiers: a chunk's digest, and
a rank where distinct chunks share a digest, which comparing the chunks themselves shows. Documents are equal when their
ordered identifier lists are. Digests are counted first; only chunks whose digest occurs again move, once, after merging
within each task.

Defined cases: null counts as empty, and all empty texts are equal; of equal texts the row with the largest id stays;
rows that repeat the id that stays are all kept by op7's digest but dedup() keeps one of those with that id and text;
null ids lose to any id; further columns pass through untouched, whatever their names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sottovoce.llm.common import ascii_lower, materialise, maybe_in, skew_join, table

MIN_CHUNK, MAX_CHUNK = 512, 4096
#: Where chunks end, the first that is found: a line or sentence end; a space behind a letter that many words end with;
#: a pair of characters, of which the first is of one half of the usual ones and the second of the other.
SENTENCE_END = r"(?:[\n\r]|[.!?;:。！？।]\s)"
WORD_END = r"[aenrt]\s"
PAIR = r"[a-fA-F0-4\x{4E00}-\x{5FFF}][g-zG-Z5-9\x{6000}-\x{9FFF}]"


def chunks(text: Column, low: int = MIN_CHUNK, high: int = MAX_CHUNK) -> Column:
    """The text cut into chunks of `low` to `high` characters (the last may be shorter), each ending where its content says so, if anything there does. Joined they give the text."""
    ends = "|".join(rf".{{{low},{high}}}?{end}" for end in (SENTENCE_END, WORD_END, PAIR))
    return F.regexp_extract_all(text, F.lit(rf"(?s){ends}|.{{1,{high}}}"), F.lit(0))


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns id and text: the text is lower-cased, null counts as empty."""
    return docs.select(F.col(id_col).alias("id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = F.xxhash64,
            low: int = MIN_CHUNK, high: int = MAX_CHUNK) -> DataFrame:
    """A row per document: id, text_sha256 (of the lower-cased text) and recipe, the array of verified identifiers (digest, rank)."""
    named = _named(docs, id_col, text_col)
    digests = named.select("id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), F.transform(chunks(F.col("text"), low, high), lambda c: digest(c).cast("long")).alias("ds"))
    digests = materialise(digests, "digests")
    again = digests.select(F.explode("ds").alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("d")
    again = materialise(again, "again")
    # a digest that occurs once stands for one chunk; the others' chunks meet, copies within a task merged before
    cut = named.select(F.explode(chunks(F.col("text"), low, high)).alias("chunk")).withColumn("d", digest(F.col("chunk")).cast("long"))
    distinct = maybe_in(cut, "d", again).groupBy("d", "chunk").agg(F.lit(1).alias("one"))
    clash = distinct.groupBy("d").agg(F.count("one").alias("n")).where("n > 1").select("d")
    clash = materialise(clash, "clash")
    plain = F.transform("ds", lambda d: F.struct(d.alias("d"), F.lit(0).alias("rank")))
    if not clash.head(1):  # every digest stands for one chunk
        return digests.select("id", "text_sha256", plain.alias("recipe"))
    # distinct chunks share a digest: those chunks get ranks, and the texts that hold one are looked at again
    texts = distinct.join(clash, "d", "left_semi").withColumn("rank", F.row_number().over(W.partitionBy("d").orderBy("chunk")) - 1)
    ranks = materialise(texts.select("chunk", "rank"), "ranks")
    rows = materialise(named.withColumn("row", F.monotonically_increasing_id()), "rows")
    sha = rows.select("row", "id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
    parts = materialise(rows.select("row", F.posexplode(chunks(F.col("text"), low, high)).alias("at", "chunk")), "parts")
    ranked = skew_join(parts, ranks, "chunk", "left")
    ordered = ranked.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", digest(F.col("chunk")).cast("long").alias("d"), F.coalesce("rank", F.lit(0)).alias("rank")))).alias("parts"))
    recipe = F.transform("parts", lambda p: F.struct(p["d"].alias("d"), p["rank"].alias("rank")))
    none = F.array().cast("array<struct<d:bigint,rank:int>>")
    return sha.join(ordered, "row", "left").select("id", "text_sha256", F.coalesce(recipe, none).alias("recipe"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """A row per document: id, keep_id (largest id among equal texts), group_size, kept (id = keep_id), text_sha256."""
    listed = materialise(recipes(docs, id_col, text_col, **options), "recipes")
    same = listed.groupBy("recipe").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    out = skew_join(listed, same, "recipe")
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each group of equal texts, all columns kept. Of rows that repeat the id and the text that stay, one stays."""
    found = groups(docs, id_col, text_col, **options).where("kept").select(F.col(id_col).alias("id"), F.col("text_sha256").alias("sha"))
    found = materialise(found.groupBy("id", "sha").agg(F.count(F.lit(1)).alias("n")), "kept")
    sha = F.sha2(ascii_lower(F.coalesce(docs[text_col], F.lit(""))).cast("binary"), 256)

    def of(some: DataFrame) -> DataFrame:
        return docs.join(some, docs[id_col].eqNullSafe(some["id"]) & (sha == some["sha"]), "left_semi")

    repeated = found.where("n > 1")
    if not repeated.head(1):
        return of(found)
    held = of(repeated)  # only rows that repeat move here
    one = held.select(F.struct(*[held[f"`{c}`"] for c in held.columns]).alias("doc"), F.sha2(ascii_lower(F.coalesce(held[text_col], F.lit(""))).cast("binary"), 256).alias("sha"), held[id_col].alias("id"))
    return of(found.where("n = 1")).unionByName(one.dropDuplicates(["id", "sha"]).select("doc.*"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))


def op7_sql() -> str:
    return """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
