"""Benchmark decontamination: a broadcast hash set of the benchmark's word windows, scanned over every training window.

A word is a run of characters other than ASCII delimiters; A-Z are lower-cased. An item's windows are its runs of
`window` consecutive words; an item with fewer words, but not none, is one window.

The windows' hashes are the set. Every training window of as many words is hashed by position and looked up; what is
found is compared word by word. Up to BROADCAST_BYTES the set is broadcast. A larger one is joined by shuffle: a bitmap
of fixed size over its hashes picks the training windows that move, each with its own words only, and hot hashes are
dealt over several tasks.

Defined cases: null and empty texts have no words, hit nothing and are kept; null item texts have no windows; rows that
repeat a document give equal rows; an empty benchmark contaminates nothing; further columns pass through untouched,
whatever their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sottovoce.llm.common import ascii_lower, materialise, maybe_in, skew_join, table

_ASCII_DELIMITERS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
DELIMITERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
#: The window table is broadcast up to so many bytes of words, item ids and WINDOW_BYTES a window.
BROADCAST_BYTES, WINDOW_BYTES = 64 << 20, 200


def word_array(text: Column) -> Column:
    """The words in order; null has none."""
    inner = F.btrim(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(_ASCII_DELIMITERS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, DELIMITERS))


def item_windows(benchmark: DataFrame, window: int, item_col: str, text_col: str) -> DataFrame:
    """A row per distinct window: its hash h, its words, and the items that hold it."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), word_array(F.col(text_col)).alias("w")).where("size(w) > 0")
    last = F.greatest(F.size("w") - F.lit(window - 1), F.lit(1))
    starts = items.select("item", "w", F.explode_outer(F.sequence(F.lit(1), last)).alias("at"))
    cut = starts.select("item", F.slice("w", F.col("at"), F.lit(window)).alias("words"))
    found = cut.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return found.select(F.xxhash64(F.transform("words", lambda x: F.xxhash64(x))).alias("h"), "words", "items")


def spans(docs: DataFrame, benchmark: DataFrame, key: list[str], text_col: str = "text", item_col: str = "item_id",
          item_text_col: str = "text", window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per distinct key: the key, n_words, copies (rows with that key), spans (array of the hit word ranges
    (first, words), in order; ranges may overlap) and items (sorted ids of the items with occurring windows).

    One pass over the texts: the words are hashed once, and at every place the hashes of the windows that begin there,
    one for each length that occurs in the benchmark, are looked up. The place 0 of a document stands for itself, so that
    documents without hits stay."""
    found = materialise(item_windows(benchmark, window, item_col, item_text_col), "windows")
    size = F.sum(F.aggregate("words", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x)) + F.aggregate("items", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x)) + WINDOW_BYTES)
    lengths, n_bytes = found.agg(F.sort_array(F.collect_set(F.size("words"))), F.coalesce(size, F.lit(0))).head()  # at most `window` lengths
    words = docs.select(*key, word_array(F.col(text_col)).alias("w")).withColumn("hashes", F.transform("w", lambda x: F.xxhash64(x)))
    each = words.select(*key, F.size("w").alias("n_words"), "w", "hashes", F.explode_outer(F.sequence(F.lit(0), F.size("w"))).alias("at"))
    if len(lengths) == 1:
        each = each.withColumn("len", F.lit(lengths[0]))
    elif lengths:
        each = each.withColumn("len", F.explode_outer(F.when(F.col("at") == 0, F.array(F.lit(0))).otherwise(F.array(*map(F.lit, lengths)))))
    else:
        each = each.where("at = 0").withColumn("len", F.lit(0))
    is_marker = F.col("at") == 0
    # a place without a full window has no hash; the marker has that of no window
    none = F.xxhash64(F.lit("no window"))
    hashed = F.when(is_marker, none).when(F.col("at") + F.col("len") - 1 <= F.col("n_words"), F.xxhash64(F.slice("hashes", F.greatest("at", F.lit(1)), F.col("len"))))
    own = F.slice("w", F.greatest("at", F.lit(1)), F.col("len"))
    same = (F.size("words") == F.col("len")) & (own == F.col("words"))
    hashes = each.withColumn("h", hashed)
    if n_bytes <= broadcast_bytes:
        marker = found.sparkSession.range(1).select(none.alias("h"), F.array().cast("array<string>").alias("words"), F.array().cast("array<string>").alias("items"))
        hit = hashes.join(F.broadcast(found.unionByName(marker)), "h").where((is_marker & (F.size("items") == 0)) | (~is_marker & same))
        return _gather(hit.select(*key, "n_words", (~is_marker).alias("is_hit"), "items", "at", "len"), key)
    likely = maybe_in(hashes.where(~is_marker & F.col("h").isNotNull()), "h", found.select("h"))
    likely = materialise(likely.select(*key, "n_words", "at", "len", "h", own.alias("own")), "likely")
    # distinct windows may share a hash: then each of them meets what has it
    hit = skew_join(likely, found, "h").where(F.col("own") == F.col("words")).select(*key, "n_words", F.lit(True).alias("is_hit"), "items", "at", "len")
    markers = words.select(*key, F.size("w").alias("n_words"), F.lit(False).alias("is_hit"), F.array().cast("array<string>").alias("items"), F.lit(0).alias("at"), F.lit(0).alias("len"))
    return _gather(hit.unionByName(markers), key)


def _gather(hit: DataFrame, key: list[str]) -> DataFrame:
    return hit.select(*key, "n_words", "is_hit", "items", F.struct("at", "len").alias("span")).groupBy(*key).agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.count(F.when(~F.col("is_hit"), 1)).alias("copies"),
        F.sort_array(F.collect_set(F.when(F.col("is_hit"), F.col("span")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("is_hit"), F.col("items")))))).alias("items"))


def covered(spans_col: str) -> Column:
    """Words inside any of the sorted ranges."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def step(acc: Column, s: Column) -> Column:
        end = s["at"] + s["len"]
        return F.struct((acc["n"] + F.greatest(end - F.greatest(acc["end"], s["at"]), F.lit(0))).alias("n"), F.greatest(acc["end"], end).alias("end"))

    return F.aggregate(spans_col, zero, step, lambda acc: acc["n"])


def verdicts(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_share: float = 0.05, **options) -> DataFrame:
    """A row per document: id, n_words, n_hit, n_items, items, spans, contaminated (n_hit > 0 and n_hit >= min_share * n_words)."""
    digest = F.xxhash64(F.col(text_col))
    keyed = docs.select(F.col(id_col).alias("_id"), digest.alias("_digest"), F.col(text_col).alias("_text"))
    parts = round(1 / min_share)
    found = spans(keyed, benchmark, ["_id", "_digest"], "_text", **options)
    n_hit = covered("spans").cast("long")
    one = found.select(F.col("_id").alias(id_col), F.col("_digest").alias("digest"), "copies", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans")
    one = one.withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(parts) * F.col("n_hit") >= F.col("n_words")))
    return one.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("_copy", "copies")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", remove: str = "documents", **options) -> DataFrame:
    """The documents without what the benchmark shares with them, all columns kept.

    remove="documents" drops contaminated documents; remove="spans" cuts the hit words out of every text and keeps all rows."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    found = verdicts(docs, benchmark, id_col, text_col, **options).where("n_hit > 0").select(F.col(id_col).alias("id"), "digest", "spans", "contaminated")
    found = materialise(found.dropDuplicates(["id", "digest"]), "verdicts")
    same = found["id"].eqNullSafe(docs[id_col]) & (found["digest"] == F.xxhash64(docs[text_col]))
    if remove == "documents":
        return docs.join(found.where("contaminated"), same, "left_anti")
    whole = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"), docs[id_col].alias("of"), F.xxhash64(docs[text_col]).alias("has"))
    joined = whole.join(found, F.col("id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("has")), "left")
    text = F.when(F.col("spans").isNull(), F.col("doc")[text_col]).otherwise(_cut(F.col("doc")[text_col], F.col("spans")))
    return joined.select(*[(text if c == text_col else F.col("doc")[c]).alias(c) for c in docs.columns])


def _cut(text: Column, hit: Column) -> Column:
    """The text without the words of the hit ranges; each word goes with the delimiters after it."""
    pieces = F.regexp_extract_all(text, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+|^)[\x00-\x2F\x3A-\x60\x7B-\x7F]*"), F.lit(0))
    lead = text.rlike(r"^[\x00-\x2F\x3A-\x60\x7B-\x7F]").cast("int")  # a first piece without a word
    # what stays is between one hit range and the next: ranges come in order, so one walk tells (first word, words) of each
    start = F.struct(F.lit(1).alias("from"), F.array().cast("array<struct<at:int,len:int>>").alias("gaps"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.struct(acc["from"].alias("at"), (s["at"] - acc["from"]).alias("len"))
        gaps = F.when(s["at"] > acc["from"], F.concat(acc["gaps"], F.array(gap))).otherwise(acc["gaps"])
        return F.struct(F.greatest(acc["from"], s["at"] + s["len"]).alias("from"), gaps.alias("gaps"))

    end = F.struct((F.lit(1 << 30)).alias("at"), F.lit(0).alias("len"))
    gaps = F.aggregate(F.concat(hit, F.array(end)), start, step, lambda acc: acc["gaps"])
    stay = F.flatten(F.transform(gaps, lambda g: F.slice(pieces, g["at"] + lead, g["len"])))
    return F.concat(F.when(lead == 1, F.element_at(pieces, 1)).otherwise(F.lit("")), F.array_join(stay, ""))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op1_sql() -> str:
    return """
WITH lowered AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
dw AS (SELECT doc_id, regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM lowered),
bw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bi AS (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS pos FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item, array_to_string(w[pos:pos + 12], ' ') AS k, least(len(w), 13) AS n FROM bi),
lens AS (SELECT DISTINCT n FROM win),
di AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS pos FROM dw, lens WHERE len(w) >= n),
hit AS (SELECT di.doc_id, di.pos, di.n, win.item FROM di JOIN win ON win.n = di.n AND win.k = array_to_string(di.w[di.pos:di.pos + di.n - 1], ' ')),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN pos ON pos.doc_id = dw.doc_id LEFT JOIN its ON its.doc_id = dw.doc_id
"""
