"""Stream state over finished tables (R3-R11, E3-E9): segments, confirmations, escalation, levels.

Where a rule has a closed form it is a window; where each step depends on what the last decided, pointers are doubled
(operators.jumps) or blocks of a session are run at once until they agree (operators.rounds)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sottovoce.operators.environment import Environment as Environment
from sottovoce.operators.jumps import forced_segments

PRE_ROLL, HANG_OVER, MIN_SPEECH, MAX_CHUNKS, KEEP_TAIL = 6, 18, 8, 375, 6


def islands(df: DataFrame, key: list[str], order: str, breaks: Column, name: str = "island") -> DataFrame:
    """Numbers runs of rows: a new one begins where `breaks` holds."""
    w = W.partitionBy(*key).orderBy(order)
    return df.withColumn(name, F.sum(F.when(breaks, 1).otherwise(0)).over(w))


def sessionise(speech: DataFrame, key: list[str], ts: str, gap_seconds: float) -> DataFrame:
    """R3 without a maximum length: rows of speech whose gaps do not exceed gap_seconds form a segment."""
    w = W.partitionBy(*key).orderBy(ts)
    late = (F.unix_micros(F.col(ts)) - F.unix_micros(F.lag(ts).over(w))) > int(gap_seconds * 1e6)
    marked = speech.withColumn("_new", F.coalesce(late, F.lit(True)))
    numbered = islands(marked, key, ts, F.col("_new"), "segment")
    return numbered.groupBy(*key, "segment").agg(F.min(ts).alias("start"), F.max(ts).alias("stop"), F.count(F.lit(1)).alias("chunks"))


def segment(speech: list[bool], closing: bool = True, pre: int = PRE_ROLL, hang: int = HANG_OVER, least: int = MIN_SPEECH, most: int = MAX_CHUNKS, state: tuple | None = None) -> tuple[list[tuple[int, int, int]], tuple]:
    """R3-R5 over one session's chunks: segments (first chunk, one past the last, speech chunks), and the state to go on from.

    The state is (next index, start or -1, speech chunks, silent run, earliest chunk that may be pre-roll)."""
    at, start, spoken, silent, free = state or (0, -1, 0, 0, 0)
    out = []
    for is_speech in speech:
        if start < 0 and is_speech:
            start, spoken, silent = max(at - pre, free), 0, 0
        at += 1
        if start < 0:
            continue
        spoken, silent = (spoken + 1, 0) if is_speech else (spoken, silent + 1)
        if silent >= hang or at - start >= most:
            if spoken >= least:
                out.append((start, at - max(silent - KEEP_TAIL, 0), spoken))
            start, free = -1, at
    if closing and start >= 0 and spoken >= least:
        out.append((start, at - max(silent - KEEP_TAIL, 0), spoken))
        start = -1
    return out, (at, start, spoken, silent, free)


def filled(chunks: list[int], speech: list[bool], at: int) -> list[bool]:
    """The speech flags from chunk `at` on, of chunks in order: one that is missing is silent; one that comes again, or too late, is left out."""
    out: list[bool] = []
    for i, is_speech in zip(chunks, speech, strict=True):
        if i >= at + len(out):
            out += [False] * (i - at - len(out)) + [is_speech]
    return out


def segments(chunks: DataFrame, key: str = "session_id", pre: int = PRE_ROLL, hang: int = HANG_OVER, least: int = MIN_SPEECH, most: int = MAX_CHUNKS) -> DataFrame:
    """Segments of rows (key, chunk_idx, speech_prob): key, segment_id, first, stop, speech, as segment() has them, without a fold over a session."""
    return forced_segments(chunks.select(key, "chunk_idx", (F.col("speech_prob") >= 0.5).alias("speech")), key, pre, hang, least, most, KEEP_TAIL)


def confirm(hits: DataFrame, key: list[str], window: str = "window_idx", needed: int = 2) -> DataFrame:
    """A phrase counts once it stands in `needed` consecutive windows, and once a segment. Rows: key + phrase + window."""
    w = W.partitionBy(*key).orderBy(window)
    one = hits.select(*key, window).distinct()
    runs = islands(one, key, window, F.coalesce(F.col(window) - F.lag(window).over(w) > 1, F.lit(True)), "_run")
    placed = runs.withColumn("_n", F.row_number().over(W.partitionBy(*key, "_run").orderBy(window)))
    return placed.where(F.col("_n") == needed).groupBy(*key).agg(F.min(window).alias("confirmed_at")).withColumn("windows", F.lit(needed))


def repeats(rows: DataFrame, endpoint: str, category: str, ts: str, order: str, seconds: int = 600) -> DataFrame:
    """Rows (one per endpoint, category and event) with the number of earlier ones within `seconds`; equal times by `order`."""
    us = F.unix_micros(F.col(ts))
    key = W.partitionBy(endpoint, category)
    span = key.orderBy(us).rangeBetween(-seconds * 1_000_000, 0)
    peers = W.partitionBy(endpoint, category, ts)
    later = F.count(F.lit(1)).over(peers) - F.row_number().over(peers.orderBy(order))
    return rows.withColumn("repeats", F.count(F.lit(1)).over(span) - 1 - later)


def escalate(severity: Column, repeats_: Column, needed: int = 2) -> Column:
    """One band up (CRITICAL stays) once there were `needed` repeats; only from MEDIUM on."""
    up = F.when(severity == "MEDIUM", "HIGH").when(severity.isin("HIGH", "CRITICAL"), "CRITICAL")
    return F.coalesce(F.when(repeats_ >= needed, up), severity)


def lifted(score: Column, before: Column, after: Column, bands: dict[str, float]) -> Column:
    """R11."""
    floor = F.create_map(*[F.lit(x) for k, v in bands.items() for x in (k.upper(), float(v))])
    return F.when(before == after, score).otherwise(F.greatest(score, F.element_at(floor, after)))


def escalated(rows: DataFrame, endpoint: str, ts: str, order: str, severity: str = "severity", categories: str = "categories", seconds: int = 600, needed: int = 2,
              score: str | None = None, bands: dict[str, float] | None = None) -> DataFrame:
    """Rows with `repeats`, the most earlier disclosures within `seconds` that any of their categories had at the
    endpoint, and `escalated`, the severity after that; with a score and the bands also `lifted`, the score after it.

    Only rows from MEDIUM on with a category disclose anything. `order` tells an endpoint's rows apart."""
    discloses = F.col(severity).isin("MEDIUM", "HIGH", "CRITICAL") & (F.size(categories) > 0)
    each = rows.where(discloses).select(endpoint, ts, order, F.explode(F.array_distinct(categories)).alias("_category"))
    most = repeats(each, endpoint, "_category", ts, order, seconds).groupBy(endpoint, ts, order).agg(F.max("repeats").alias("repeats"))
    out = rows.join(most, [endpoint, ts, order], "left").withColumn("repeats", F.coalesce("repeats", F.lit(0).cast("long")))
    out = out.withColumn("escalated", F.when(discloses, escalate(F.col(severity), F.col("repeats"), needed)).otherwise(F.col(severity)))
    return out.withColumn("lifted", lifted(F.col(score), F.col(severity), F.col("escalated"), bands)) if score else out


def muted_runs(levels: DataFrame, key: list[str], order: str, level: str, limit: float = -80.0, chunks: int = 250) -> DataFrame:
    """E5: runs of at least `chunks` rows at or below the limit: key, first, last and length."""
    w = W.partitionBy(*key).orderBy(order)
    quiet = F.col(level) <= limit
    turned = levels.withColumn("_q", quiet).withColumn("_turn", F.coalesce(F.col("_q") != F.lag("_q").over(w), F.lit(True)))
    runs = islands(turned, key, order, F.col("_turn"), "run").where("_q")
    return runs.groupBy(*key, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= chunks)


def raised(levels: DataFrame, key: list[str], order: str, level: str, window: int = 10) -> DataFrame:
    """The mean power of the last `window` rows, in dB."""
    w = W.partitionBy(*key).orderBy(order).rowsBetween(1 - window, 0)
    return levels.withColumn("mean_db", 10.0 * F.log10(F.avg(F.pow(F.lit(10.0), F.col(level) / 10.0)).over(w)))


def noise_floor(levels: DataFrame, key: list[str], order: str, level: str, rate: float = 0.01) -> DataFrame:
    """The floor of E4 over levels of quiet (filter speech, segments and loud sounds before): after the last row of each
    key, the first level, then a moving average. In closed form: each level weighs (1 - rate) to the number of later ones,
    times the rate but for the first."""
    back = W.partitionBy(*key).orderBy(F.desc(order))
    later, first = F.row_number().over(back) - 1, F.lead(F.lit(1)).over(back).isNull()
    weighed = levels.withColumn("_w", F.pow(F.lit(1 - rate), later) * F.when(first, 1.0).otherwise(rate))
    return weighed.groupBy(*key).agg(F.sum(F.col("_w") * F.col(level)).alias("floor"))


def cooled(times: list[float], gap: float) -> list[bool]:
    """Which of rising times pass, each at least `gap` after the last that did."""
    last, out = None, []
    for t in times:
        out.append(last is None or t - last >= gap)
        last = t if out[-1] else last
    return out


def environment(chunks: DataFrame, key: str = "session_id", block: int | None = None) -> DataFrame:
    """Environment events of rows (key, chunk_idx, level_db, speech_prob, and in_segment, if given: whether a segment is
    open there, in which the floor rests and no spike begins or stays). Sessions are cut into blocks that are run at once."""
    from sottovoce.operators import machines, rounds

    return rounds.run(_levels(chunks, key), machines.Levels(), key, "chunk_idx", ["level_db", "speech", "in_segment"], block or rounds.BLOCK)


def baselines(chunks: DataFrame, key: str = "session_id", block: int | None = None) -> DataFrame:
    """Noise floor and speaking level after each chunk, of rows as environment() takes them: key, chunk_idx, floor_db, speaking_db."""
    from sottovoce.operators import machines, rounds

    return rounds.run(_levels(chunks, key), machines.Baselines(), key, "chunk_idx", ["level_db", "speech", "in_segment"], block or rounds.BLOCK)


def _levels(chunks: DataFrame, key: str) -> DataFrame:
    told = F.coalesce("in_segment", F.lit(False)) if "in_segment" in chunks.columns else F.lit(False)
    return chunks.select(key, F.col("chunk_idx").cast("long").alias("chunk_idx"), F.col("level_db").cast("double").alias("level_db"), F.coalesce(F.col("speech_prob") >= 0.5, F.lit(False)).alias("speech"), told.alias("in_segment"))
