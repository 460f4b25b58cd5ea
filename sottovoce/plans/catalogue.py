"""The registered queries of the disclosure engine and their SQL.

Doubles are quantised by floor(x * 1e4 + 0.5) / 1e4 in both engines; counts are bigint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sottovoce.functions import audio, numbers, text
from sottovoce.operators import audit, fusion, jumps, keywords, live, merkle, outbox, reporting, semantic, state
from sottovoce.operators.fusion import quantised
from sottovoce.sources.policy import EXAMPLE, Policy, reported, resolved, summarised

AS_OF = "2024-02-01 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def normal_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "lang", text.normalize(F.col("text"), latin=True).alias("normal"))


def norm_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = normal_documents(spark, sf_dir)
    return n.select("doc_id", F.sha2("normal", 256).alias("normal_sha256"), F.length("normal").cast("bigint").alias("n_chars"))


def norm_text_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2 by Python for texts beyond Latin, and T8."""
    n = text.normalize(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", n.alias("normal")).select("doc_id", "normal", text.skeleton(F.col("normal")).alias("skeleton"))


def script_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", text.dominant_script(F.col("text")).alias("script"))
    return docs.select("doc_id", "script", (F.col("script") == text.RTL_SCRIPT).alias("is_rtl"))


def phrase_hits_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.exact_hits(normal_documents(spark, sf_dir), Policy.example(), "doc_id", "normal").select("doc_id", "category", "phrase", "weight", "lang")


def phrase_hits_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = keywords.exact_array(normal_documents(spark, sf_dir), Policy.example(), "doc_id", "normal")
    ranked = hits.select("doc_id", keywords.ranked(keywords.suppress(F.col("hits"))).alias("m"))
    return ranked.select("doc_id", F.size("m").cast("bigint").alias("n_matches"), F.get("m", F.lit(0))["weight"].alias("score"), F.array_join(F.array_sort(F.transform("m", lambda m: m["phrase"])), "|").alias("phrases"))


#: Phrases that sound like some of the made-up words of the turns, beside words that stand in them.
SPOKEN = Policy(EXAMPLE | {"categories": {
    "spoken": {"weight": 0.5, "phrases": ["in thereon an", "there in the", {"text": "of the ration", "weight": 0.6}, {"text": "that", "weight": 0.5}, {"text": "in the", "weight": 0.3}]},
    "other": {"weight": 0.4, "phrases": ["in the reason", "the other one", {"text": "the other one is", "weight": 0.9}]},
}})


def phrase_hits_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3-K9 on the turns of conversations, by words and by sound."""
    turns = read(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), text.normalize(F.col("text"), latin=True).alias("normal"))
    found = keywords.matched(turns, SPOKEN, "normal", "hits")
    return found.select("id", F.explode(keywords.ranked(keywords.suppress(F.col("hits")))).alias("m")).select("id", "m.category", "m.phrase", "m.weight", "m.match", "m.similarity")


def ipv4_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = numbers.written_ipv4(text.casefold_latin(F.col("text")))
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(found)).alias("ip"))


def iban_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N6 on documents, of which every tenth asks to pay into an account (they hold none of their own)."""
    account = F.format_string(" Pay to DE%02d 3704 0044 0532 %04d 00, or gb%02dwest1234569876%04d.", F.col("doc_id") % 90 + 10, F.col("doc_id") % 10_000, F.col("doc_id") % 80 + 11, F.col("doc_id") % 10_000)
    asked = F.concat("text", F.when(F.col("doc_id") % 10 == 0, account).otherwise(F.lit("")))
    rows = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(numbers.ibans(text.casefold_latin(asked)))).alias("iban"))
    return rows.select("doc_id", "iban", numbers.mask(F.upper("iban")).alias("masked"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = text.casefold_latin(F.col("text"))
    runs = numbers.digit_runs(text.fold_marks(numbers.residual(folded)))
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(runs)).alias("run"))


def digit_runs_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _runs(spark, sf_dir).where(F.length("run") >= numbers.MIN_RUN)
    return r.select("doc_id", "run", numbers.classify(F.col("run")).alias("kind"), numbers.luhn(F.col("run")).alias("luhn_ok"))


def masked_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).select("doc_id", numbers.mask(F.col("run")).alias("masked"), F.length("run").cast("bigint").alias("n"))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return fusion.score(docs, Policy.example(), "doc_id", "text", language_col="lang", latin=True)


def verdict_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("verdict")
    return verdicts(spark, sf_dir).select(
        "doc_id", v["keyword_score"].alias("keyword_score"), v["pattern_score"].alias("pattern_score"), v["threat_score"].alias("threat_score"), v["severity"].alias("severity"), v["is_violation"].alias("is_violation"),
        F.size(v["matches"]).cast("bigint").alias("n_matches"), F.array_join(F.array_sort(v["categories"]), "|").alias("categories"), F.array_join(v["sources"], "|").alias("sources"))


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts that stand for events: severity by value, latency from the id."""
    e = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    p = Policy.example()
    return e.select(F.col("event_id").alias("id"), "ts", F.col("user_id").alias("endpoint_id"), F.col("event_type").alias("category"), F.col("value"), p.severity(F.pmod(F.col("value"), F.lit(100.0)) / 100.0).alias("severity"), F.when(F.col("event_id") % 7 != 0, F.col("event_id") % 5000).alias("latency_ms"))


def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.by_severity(verdict_fused(spark, sf_dir).select("severity"))


def language_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = verdicts(spark, sf_dir).where("verdict.severity <> 'NONE'")
    return reporting.by_language(v.select(F.col("verdict.language").alias("language")))


def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.by_category(verdicts(spark, sf_dir).select(F.col("verdict.categories").alias("categories")))


def alert_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    page, _ = reporting.list_alerts(_alerts(spark, sf_dir), severity="high", limit=50, offset=10)
    return page.select("id", "severity", "endpoint_id", "category")


def alert_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.stats(_alerts(spark, sf_dir), AS_OF)


def _sentences(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = read(spark, sf_dir, "embeddings")
    pick = lambda lo, hi: e.where(F.col("vec_id").between(lo, hi)).select(F.col("vec_id").cast("int").alias("idx"), "embedding")
    return e, pick(0, 22), pick(23, 35)


def nearest_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, refs, _ = _sentences(spark, sf_dir)
    return semantic.nearest(e, refs, "vec_id", "embedding").select("vec_id", "idx", quantised(F.col("similarity")).alias("similarity"))


def semantic_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, refs, benign = _sentences(spark, sf_dir)
    return semantic.margin(e, refs, benign, "vec_id", "embedding").select("vec_id", quantised(F.col("margin")).alias("margin"), quantised(F.col("score")).alias("score"))


def repeat_escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = _alerts(spark, sf_dir).where("severity in ('MEDIUM', 'HIGH', 'CRITICAL')")
    counted = state.repeats(alerts, "endpoint_id", "category", "ts", "id", 86400)
    return counted.select("id", "repeats", state.escalate(F.col("severity"), F.col("repeats")).alias("severity"))


def segments_sessionised(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _alerts(spark, sf_dir)
    s = state.sessionise(e, ["endpoint_id"], "ts", 7200.0)
    return s.select("endpoint_id", "segment", F.unix_micros("start").alias("start_us"), F.unix_micros("stop").alias("stop_us"), "chunks")


def phrase_confirmation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("user_id"), F.col("event_type"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000).cast("bigint").alias("window_idx"))
    return state.confirm(e, ["user_id", "event_type"]).select("user_id", "event_type", "confirmed_at")


def muted_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return state.muted_runs(e, ["user_id"], "event_id", "value", limit=30.0, chunks=3).select("user_id", "first", "last", "n")


def noise_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.noise_floor(read(spark, sf_dir, "events"), ["user_id"], "event_id", "value").select("user_id", quantised(F.col("floor")).alias("floor"))


def raised_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id", "event_id", (-F.pmod("value", F.lit(60.0))).alias("level"))
    return state.raised(e, ["user_id"], "event_id", "level").select("event_id", (F.floor(F.col("mean_db") * 100 + 0.5) / 100).alias("mean_db"))


def level_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return e.select("vec_id", quantised(audio.rms_db(F.col("embedding"))).alias("db"), quantised(audio.peak(F.col("embedding"))).alias("peak"))


def spectral_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", quantised(audio.spectral_centroid("embedding")).alias("centroid"))


def _audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows: the orders, of which each customer has a chain."""
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("endpoint"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))


def _chain(rows: DataFrame) -> DataFrame:
    entries = rows.select("endpoint", F.lit("alert").alias("kind"), F.col("id").alias("ref_id"), "ts", audit.payload_hash(rows, ["id", "status", "priority"]).alias("payload_hash"), F.lit("").alias("detail"), F.col("id").alias("ord"))
    return audit.append(None, entries, ["endpoint"])


def chain_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chain(_audit_rows(spark, sf_dir)).select("endpoint", "seq", "ref_id", "row_hash")


def chain_tamper_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of key divisible by 8 are edited and by 12 deleted after the fact."""
    rows = _audit_rows(spark, sf_dir)
    edited = rows.where("id % 12 <> 0").withColumn("status", F.when(F.col("id") % 8 == 0, F.lit("X")).otherwise(F.col("status")))
    return audit.verify(_chain(rows), {"alert": (edited, ["id", "status", "priority"])}, key=["endpoint"])


def retention_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, gone = audit.purge(_alerts(spark, sf_dir), AS_OF, 20)
    return kept.groupBy("category").agg(F.count(F.lit(1)).alias("n")).withColumn("state", F.lit("kept")).unionByName(gone.groupBy("category").agg(F.count(F.lit(1)).alias("n")).withColumn("state", F.lit("expired")))


def transcript_minimised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.minimised(read(spark, sf_dir, "conversations"), False, "text", None).select("conv_id", "turn", "transcript_hash", "text")


def _outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _alerts(spark, sf_dir).where("severity in ('HIGH', 'CRITICAL')")
    box = e.select("id", F.col("ts").alias("created"), F.concat(F.lit('{"id":'), F.col("id").cast("string"), F.lit("}")).alias("event_json"))
    tries = e.where("id % 3 <> 0").select("id", F.col("ts").alias("at"), (F.col("id") % 2 == 0).alias("ok"), F.when(F.col("id") % 2 == 1, F.concat(F.lit("failed "), F.col("id").cast("string"))).alias("error"))
    return outbox.current(box, tries)


def outbox_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outbox.due(_outbox(spark, sf_dir), AS_OF).select("id", "attempts")


def outbox_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outbox.stats(_outbox(spark, sf_dir))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policy entries that stand for benchmark items: the first two words of each, so that some have equal keys."""
    b = read(spark, sf_dir, "benchmark")
    words = F.array_join(F.slice(F.split(F.col("text"), " "), 1, 2), " ")
    return b.select(F.concat(F.lit("topic "), F.col("item_id") % 4).alias("category"), F.when(F.col("item_id") % 3 == 0, "fr").otherwise("en").alias("lang"), words.alias("text"), ((F.col("item_id") % 7 + 1) / 8.0).alias("weight"), F.col("item_id").alias("ord"))


def policy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarised(resolved(_entries(spark, sf_dir), latin=True))


def policy_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reported(resolved(_entries(spark, sf_dir), latin=True))


def detector_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = verdict_fused(spark, sf_dir).select("doc_id", F.contains("categories", F.lit("safety_threats")).alias("hit"))
    j = v.join(read(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")
    return j.groupBy("toxic", "hit").agg(F.count(F.lit(1)).alias("n"))


def second_opinion_upgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and the last turn of a conversation as two transcripts of one segment."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    edge = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("first"), F.max_by("text", "turn").alias("last"))
    policy = Policy.example()
    one = fusion.score(edge.select("conv_id", F.concat("first", F.lit(" token")).alias("t")), policy, "conv_id", "t", latin=True)
    two = fusion.score(edge.select("conv_id", F.concat("last", F.when(F.length("last") % 2 == 0, F.lit(" access token")).otherwise(F.lit(""))).alias("t")), policy, "conv_id", "t", latin=True)
    found = fusion.second_opinion(one, two, "conv_id")
    return found.select("conv_id", "severity_before", F.col("verdict.severity").alias("severity_after"), F.col("verdict.threat_score").alias("threat_score"))


def spotting_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as chunks, 375 to a segment; windows of 20 chunks, 5 apart."""
    n = F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1
    chunks = read(spark, sf_dir, "events").withColumn("n", n).select("user_id", F.floor(F.col("n") / 375).alias("segment"), (F.col("n") % 375 + 1).alias("at"), "value")
    return live.spotting_windows(chunks, ["user_id", "segment"], "at", F.col("value") >= 20, 20, 5, 1).select("user_id", "segment", F.col("window_idx").cast("bigint").alias("window_idx"), "start", "stop")


def early_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = keywords.exact_array(normal_documents(spark, sf_dir), Policy.example(), "doc_id", "normal")
    listed = hits.select("doc_id", F.array_sort(F.transform("hits", lambda h: F.struct(h["phrase"].alias("phrase"), h["category"].alias("category"), h["weight"].alias("weight")))).alias("matches"))
    return live.early_warnings(listed, Policy.example()).drop("matches")


def session_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("p", (F.col("doc_id") % 10) / 10)
    return live.session_language(docs, ["source"], "doc_id", "lang", "p")


_TYPES = ["segment", "transcript", "discarded", "early_warning", "verified", "verify_skipped", "dropped", "overflow", "environment"]


def session_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events stand for what a session tells; speech ended up to 5 s before."""
    k = F.col("event_id")
    kind = F.get(F.array(*[F.lit(t) for t in _TYPES]), (k % len(_TYPES)).cast("int"))
    e = read(spark, sf_dir, "events").select("user_id", kind.alias("type"), F.col("ts").cast("timestamp").alias("ts"), F.when(k % 4 != 0, k).alias("alert_id"), (k % 2 == 0).alias("upgraded"), (k % 40 / 4.0).alias("asr_seconds"))
    e = e.withColumn("end", F.timestamp_micros(F.unix_micros("ts") - F.unix_micros("ts") % 5_000_000)).withColumn("latency_ms", F.when(F.col("type") == "transcript", live.latency_ms(F.col("ts"), F.col("end"))))
    return e.groupBy("user_id").agg(*live.counters())


def translated_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document has a translation, which nobody asks for if the text alone is CRITICAL."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rendered = lambda c: F.when(c.isNotNull() & (F.col("doc_id") % 3 == 0), F.lit("an access token"))
    v = live.translated(docs, Policy.example(), "doc_id", "text", rendered, latin=True)
    return v.select("doc_id", F.col("verdict.severity").alias("severity"), F.array_contains("verdict.sources", "translation").alias("translated"))


def level_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.told_levels(read(spark, sf_dir, "events"), ["user_id"], "event_id").select("user_id", "event_id")


def noise_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    quiet = read(spark, sf_dir, "events").where("value <= 50").select("user_id", "event_id", "value")
    return live.noise_profile(quiet, ["user_id"], "event_id", "value").select("event_id", "profile_n", quantised(F.col("profile_power")).alias("profile_power"))


def event_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a user's events those that come six hours or more after the last that passed."""
    e = read(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return jumps.spaced(e, ["user_id"], "ts", "event_id", 21_600).select("user_id", "event_id")


def segments_forced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as chunks, of which some are missing; segments are short here, so that many are forced."""
    e = read(spark, sf_dir, "events").select("user_id", F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).cast("long").alias("n"), "value")
    chunks = e.select("user_id", (F.col("n") + F.floor(F.col("n") / 10) * 2).alias("chunk_idx"), F.when(F.col("value") >= 30, 0.9).otherwise(0.1).alias("speech_prob"))
    return state.segments(chunks, "user_id", pre=3, hang=8, least=3, most=20)


def joint_escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of two categories each, escalated by whichever was disclosed most in a day."""
    categories = F.array("category", F.concat(F.lit("group "), F.col("id") % 3))
    alerts = _alerts(spark, sf_dir).withColumns({"categories": F.when(F.col("id") % 11 != 0, categories).otherwise(F.array().cast("array<string>")), "score": F.pmod(F.col("value"), F.lit(100.0)) / 100.0})
    told = state.escalated(alerts, "endpoint_id", "ts", "id", seconds=86400, score="score", bands=Policy.example().bands)
    return told.select("id", "repeats", F.col("escalated").alias("severity"), quantised(F.col("lifted")).alias("score"))


def _sounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as chunks: levels, of which some are speech, and some lie in segments."""
    e = read(spark, sf_dir, "events")
    n = F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    return e.select("user_id", n.alias("chunk_idx"), (-F.pmod("value", F.lit(90.0))).alias("level_db"), F.when(F.col("event_id") % 3 == 0, 0.9).otherwise(0.1).alias("speech_prob"), (F.col("event_id") % 7 == 0).alias("in_segment"))


def chunk_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise floor and speaking level after every chunk, in blocks of 32 that are run at once."""
    told = state.baselines(_sounds(spark, sf_dir), "user_id", block=32)
    return told.select("user_id", "chunk_idx", quantised(F.col("floor_db")).alias("floor_db"), quantised(F.col("speaking_db")).alias("speaking_db"))


def environment_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the chunks' levels tell."""
    return state.environment(_sounds(spark, sf_dir), "user_id")


def _leaves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The orders as entries of one chain, a batch for each thousand order keys; and the orders."""
    rows = _audit_rows(spark, sf_dir)
    entries = rows.select(F.floor(F.col("id") / 1000).alias("batch"), F.lit("alert").alias("kind"), F.col("id").alias("ref_id"), "ts", audit.payload_hash(rows, ["id", "status", "priority"]).alias("payload_hash"), F.lit("").alias("detail"), F.col("id").alias("ord"))
    return merkle.leaves(entries), rows


def merkle_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 without a key: all orders under one chain of roots."""
    return merkle.heads(merkle.forest(_leaves(spark, sf_dir)[0])).select("seq", "batch", "n", "root", "row_hash")


def merkle_tamper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: orders of key divisible by 8 are edited and by 12 deleted after the fact."""
    leaves, _ = _leaves(spark, sf_dir)
    nodes = merkle.forest(leaves)
    edited = leaves.where("ref_id % 12 <> 0").withColumn("payload_hash", F.when(F.col("ref_id") % 8 == 0, F.sha2("payload_hash", 256)).otherwise(F.col("payload_hash")))
    return merkle.verify(merkle.heads(nodes), nodes, edited).select("batch", "level", "pos", "problem")


def merkle_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's proof, as the root it leads to and the digest of its siblings."""
    leaves, _ = _leaves(spark, sf_dir)
    found = merkle.proofs(merkle.forest(leaves), leaves)
    flat = F.array_join(F.transform("proof", lambda level: F.array_join(level, ",", "-")), ";")
    return found.select("batch", "pos", F.size("proof").cast("bigint").alias("steps"), merkle.proven_root(F.col("leaf"), F.col("proof")).alias("root"), F.sha2(flat, 256).alias("proof_sha256"))


def text_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.text_filter(read(spark, sf_dir, "documents"), "Apache License", ["text"]).select("doc_id")


def csv_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("verdict")
    rows = verdicts(spark, sf_dir).select(
        F.col("doc_id").alias("id"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"), F.lit("upload").alias("source"), F.col("source").alias("endpoint_id"), v["language"].alias("language"), v["severity"].alias("severity"),
        v["threat_score"].alias("threat_score"), v["keyword_score"].alias("keyword_score"), v["semantic_score"].alias("semantic_score"), v["pattern_score"].alias("pattern_score"), F.array_sort(v["categories"]).alias("categories"),
        F.lit(None).cast("string").alias("transcript"), F.lit(None).cast("string").alias("translation"))
    return reporting.csv_rows(rows)


_QUERIES = [
    norm_text, norm_text_unicode, script_profile, phrase_hits_exact, phrase_hits_ranked, phrase_hits_fuzzy, ipv4_hits, iban_hits, digit_runs_classified, masked_values, verdict_fused,
    severity_counts, language_counts, category_counts, alert_page, alert_stats, nearest_reference, semantic_margin, repeat_escalation, segments_sessionised, phrase_confirmation, muted_runs,
    noise_floor, raised_level, level_db, spectral_centroid, chain_build, chain_tamper_detect, retention_purge, transcript_minimised, outbox_due, outbox_stats, policy_summary, policy_report,
    detector_quality, second_opinion_upgrade, text_filter, csv_projection,
    spotting_windows, early_warnings, session_language, session_metrics, translated_verdicts, level_telemetry, noise_profile, event_cooldown, segments_forced, joint_escalation, merkle_chain, merkle_tamper, merkle_proofs, chunk_baselines, environment_events,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in _QUERIES}


def oracle_sql() -> dict[str, str]:
    from sottovoce.plans import oracles

    return oracles.sql(SPOKEN)
