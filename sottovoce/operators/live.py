"""What a monitor tells beside its verdicts (R7, R9, R14, R16-R19, R22, E3, E13), over finished tables or micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sottovoce.operators.fusion import FOUND, candidates, score, upgraded
from sottovoce.sources.policy import Policy

#: Samples of a chunk, of a spotting window, and by which a segment grows between two windows.
CHUNK, SPOT_WINDOW, SPOT_HOP = 512, 40_000, 16_000
#: Chunks between two levels that are told (the least that last 0.2 s), and chunks of a noise profile: at most, at least.
TOLD_EVERY, PROFILE_MOST, PROFILE_LEAST = 7, 46, 15


def spotting_windows(chunks: DataFrame, key: list[str], at: str, speech: Column, window: int = SPOT_WINDOW, hop: int = SPOT_HOP, chunk: int = CHUNK) -> DataFrame:
    """Key, window_idx, start and stop (samples from the segment's start) of the windows in which phrases are looked for.

    at: the number of the chunk within its segment, from 1. A window ends with a chunk of speech, once the segment is as
    long as a window and has grown by `hop` since the last one. Where one ends depends on the one before, so the chunks
    of speech of a segment are folded in a row; a segment is closed after 375 chunks, which bounds that row."""
    heard = chunks.where(speech & (F.col(at) * chunk >= window)).groupBy(*key).agg(F.array_sort(F.collect_set(F.col(at).cast("long") * chunk)).alias("stops"))
    taken = F.aggregate("stops", F.array().cast("array<bigint>"), lambda acc, x: F.when((F.size(acc) == 0) | (x - F.element_at(F.concat(F.array(F.lit(0).cast("long")), acc), -1) >= hop), F.array_append(acc, x)).otherwise(acc))
    return heard.select(*key, F.posexplode(taken).alias("window_idx", "stop")).select(*key, "window_idx", (F.col("stop") - window).alias("start"), "stop")


def top_match(matches: Column) -> Column:
    """The heaviest of an array of matches; of equally heavy ones the first."""
    return F.reduce(F.slice(matches, 2, 1 << 30), F.get(matches, F.lit(0)), lambda best, m: F.when(m["weight"] > best["weight"], m).otherwise(best))


def early_warnings(confirmed: DataFrame, policy: Policy, matches: str = "matches") -> DataFrame:
    """Rows with matches, with the category and phrase of the heaviest and the severity that its weight alone would have."""
    top = confirmed.where(F.size(matches) > 0).withColumn("_top", top_match(F.col(matches)))
    return top.select(*confirmed.columns, F.col("_top.category").alias("category"), F.col("_top.phrase").alias("phrase"), policy.severity(F.col("_top.weight")).alias("estimated_severity"))


def session_language(transcripts: DataFrame, key: list[str], order: str, language: str = "language", probability: str = "language_probability", least: float = 0.6) -> DataFrame:
    """Of each session the last language that was heard with enough certainty, null without one."""
    sure = F.col(language).isNotNull() & (F.col(probability) >= least)
    return transcripts.groupBy(*key).agg(F.max_by(language, F.when(sure, F.col(order))).alias("session_language"))


def latency_ms(done: Column, speech_end: Column) -> Column:
    """Whole milliseconds from the end of speech; null where that is unknown."""
    return F.floor((F.unix_micros(done) - F.unix_micros(speech_end)) / 1000).cast("bigint")


def counters() -> list[Column]:
    """The monitor's counters over rows (type, ts, latency_ms, asr_seconds, alert_id, upgraded), for agg() or observe()."""
    kind = lambda name, extra=F.lit(True): F.count(F.when((F.col("type") == name) & extra, 1))
    named = {
        "segments": kind("segment"), "transcribed": kind("transcript"), "discarded_segments": kind("discarded"), "alerts": kind("transcript", F.col("alert_id").isNotNull()), "early_warnings": kind("early_warning"),
        "verifications": kind("verified"), "verify_upgrades": kind("verified", F.col("upgraded")), "verify_skipped": kind("verify_skipped"), "dropped_chunks": kind("dropped"), "input_overflows": kind("overflow"),
        "environment_events": kind("environment"), "asr_seconds_total": F.round(F.coalesce(F.sum("asr_seconds"), F.lit(0.0)), 2),
        "last_latency_ms": F.max_by("latency_ms", F.when(F.col("latency_ms").isNotNull(), F.col("ts"))), "max_latency_ms": F.max("latency_ms")}
    return [c.alias(n) for n, c in named.items()]


def translated(df: DataFrame, policy: Policy, id_col: str, text_col: str, translate: Callable[[Column], Column], **options) -> DataFrame:
    """Verdicts with translations, which are asked for only where the text alone is not CRITICAL yet.

    translate gets null for the others and must give null for it: Spark runs a Python function on every row below a
    condition, so the condition has to be in its input."""
    alone = score(df, policy, id_col, text_col, keep=True, **options)
    asked = translate(F.when(F.col("verdict.severity") != "CRITICAL", F.col(text_col)))
    return score(alone.withColumn("_translation", asked).drop("verdict"), policy, id_col, text_col, translation_col="_translation", known=True, **options).drop("_translation", *FOUND)


def heard_again(first: DataFrame, second: DataFrame, policy: Policy, key: str, text_col: str = "text", latin: bool = False) -> DataFrame:
    """Second transcripts (key, text) of the candidates among first verdicts (key, verdict), scored with what the first
    pass knows: its language, its translation, and the matches that spotting confirmed. Only upgrades are returned."""
    v = F.col("before")
    carried = candidates(first).select(key, F.col("verdict").alias("before")).withColumns({"_translation": v["translation"], "_language": v["language"], "_spotted": F.filter(v["matches"], lambda m: m["match"] == "kws")})
    heard = carried.join(second.select(key, F.col(text_col).alias("_text")).where("trim(_text) <> ''"), key)
    again = score(heard, policy, key, "_text", translation_col="_translation", language_col="_language", extras_col="_spotted", latin=latin)
    return upgraded(again.withColumnRenamed("verdict", "after"), key)


def transcript_event(verdict: Column, transcription: Column, source: Column, ts: Column, latency: Column, preprocessing: Column | None = None) -> Column:
    """One event of a transcription (struct), its verdict and what came before it, as a struct; to_json makes it a message."""
    names = ["transcript", "translation", "language", "keyword_score", "semantic_score", "pattern_score", "threat_score", "severity", "is_violation", "matches", "sources", "categories", "risk_factors", "semantic_reference", "review_only"]
    return F.struct(
        F.lit("transcript").alias("type"), source.alias("source"), ts.alias("timestamp"), transcription.alias("transcription"), *[verdict[n].alias(n) for n in names],
        latency.alias("latency_ms"), (preprocessing if preprocessing is not None else F.lit(None).cast("string")).alias("preprocessing"), F.lit(None).cast("bigint").alias("alert_id"))


def told_levels(levels: DataFrame, key: list[str], order: str, every: int = TOLD_EVERY) -> DataFrame:
    """The first of each `every` rows of a session; chunks follow each other without gaps, so they tell the time."""
    n = F.row_number().over(W.partitionBy(*key).orderBy(order)) - 1
    return levels.withColumn("_n", n).where(F.col("_n") % every == 0).drop("_n")


def noise_profile(quiet: DataFrame, key: list[str], order: str, power: str, most: int = PROFILE_MOST, least: int = PROFILE_LEAST) -> DataFrame:
    """Rows without speech, each with how many of the latest (`profile_n`, at most `most`) make up the noise profile there
    and their summed power (`profile_power`), which is null until there are `least`."""
    w = W.partitionBy(*key).orderBy(order).rowsBetween(1 - most, 0)
    n = F.count(F.lit(1)).over(w)
    return quiet.withColumns({"profile_n": n, "profile_power": F.when(n >= least, F.sum(F.col(power)).over(w))})
