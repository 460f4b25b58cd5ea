"""Verdicts (F1-F13, V9): what the detectors find in a text and its translation, fused to one score and severity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sottovoce.functions import numbers, text
from sottovoce.operators import keywords
from sottovoce.operators.semantic import best_of
from sottovoce.sources.policy import Policy

SEVERITIES = ["NONE", "LOW", "MEDIUM", "HIGH", "CRITICAL"]
#: Sources: a text counts as semantically close from this score on.
SEMANTIC_SOURCE = 0.5
#: What score() finds in a text before it is fused.
FOUND = ["_native", "_native_hits", "_native_numbers"]


def rank(severity: Column) -> Column:
    """0 for NONE and anything unknown."""
    return F.greatest(F.coalesce(F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity), F.lit(0)) - 1, F.lit(0)).cast("int")


def quantised(x: Column) -> Column:
    """Four places, half up on the binary value; the same in every engine."""
    return F.floor(x * 1e4 + 0.5) / 1e4


def exact_round4(x: Column) -> Column:
    """Four places, half to even on the decimal rendering."""
    return F.replace(F.call_function("format_number", x, F.lit("0.0000")), F.lit(","), F.lit("")).cast("double")


def noisy_or(keyword: Column, semantic: Column, pattern: Column, policy: Policy) -> Column:
    """F4."""
    s = policy.raw["scoring"]
    fused = 1.0 - (1.0 - keyword) * (1.0 - float(s["semantic_weight"]) * semantic) * (1.0 - float(s.get("pattern_weight", 1.0)) * pattern)
    return quantised(F.least(F.greatest(fused, F.lit(0.0)), F.lit(1.0)))


def _texts(df: DataFrame, cols: list[str], policy: Policy, latin: bool, with_fuzzy: bool) -> DataFrame:
    """df with, for each text column c: c_hits (ranked keyword matches) and c_numbers (pattern matches)."""
    fold = text.casefold_latin if latin else text.casefold
    out = df
    for c in cols:
        out = out.withColumn(f"{c}_folded", fold(F.col(c)))
        folded, marked = F.col(f"{c}_folded"), F.col(f"{c}_marked")
        # marks are folded once; normal form with and without dots as words both follow from that
        out = out.withColumn(f"{c}_marked", numbers.dotted(folded, text.fold_marks))
        out = out.withColumn(f"{c}_normal", numbers.undotted(folded, marked, text.fold_marks))
        out = keywords.matched(out, policy, f"{c}_normal", f"{c}_all", with_fuzzy, f"{c}_may").withColumn(f"{c}_hits", keywords.ranked(keywords.suppress(F.col(f"{c}_all"))))
        where = lambda name, found, none: F.when(F.col(f"{c}_may")[name], found).otherwise(none)  # noqa: E731, B023
        nowhere = F.array().cast("array<string>")
        out = out.withColumns({f"{c}_written": where("written", numbers.written_ipv4(folded), nowhere), f"{c}_accounts": where("accounts", numbers.account_shapes(folded), nowhere),
                               f"{c}_digits": where("digits", numbers.digit_words(numbers.spelled(folded, marked, text.fold_marks)), F.lit(""))})
        written, accounts, digits = F.col(f"{c}_written"), F.col(f"{c}_accounts"), F.col(f"{c}_digits")
        out = out.withColumns({f"{c}_runs": numbers.long_runs_in(folded, digits, written, accounts, text.fold_marks), f"{c}_quads": F.array_union(written, numbers.spoken_ipv4(digits))})
        out = out.withColumn(f"{c}_numbers", numbers.scan(folded, F.col(f"{c}_runs"), F.col(f"{c}_quads"), policy.rules, accounts))
    return out


def score(df: DataFrame, policy: Policy, id_col: str, text_col: str, translation_col: str | None = None, language_col: str | None = None, semantic_col: str | None = None,
          duration_col: str | None = None, extras_col: str | None = None, latin: bool = False, with_fuzzy: bool = True, translated_semantic_col: str | None = None, keep: bool = False, known: bool = False) -> DataFrame:
    """df with a verdict struct (15 fields) for each row; ids may repeat or be null.

    semantic_col, translated_semantic_col: struct<score, reference> of a scorer for the text and its translation, of which the
    better counts (V9; 0 without one, V8). extras_col: array of matches confirmed by
    spotting (F3). latin=True promises Latin text, which needs no Python to be folded. with_fuzzy=False leaves out phrases
    that are only similar (K6), and with them the last of Python. Everything is found within the row. keep: with what was found in
    the text, FOUND; known: df has that, so that the text is not looked through again."""
    stripped = lambda c: text.without_edges(F.col(c))
    base = df if known else df.withColumn("_native", stripped(text_col))
    base = base.withColumn("_translated", stripped(translation_col) if translation_col else F.lit(""))
    cols = ["_native"] + (["_translated"] if translation_col else [])
    wide = _texts(base, [c for c in cols if not known or c != "_native"], policy, latin, with_fuzzy)
    kind = f"array<struct<{numbers.MATCH}>>"
    none = F.array().cast(kind)
    extras = F.coalesce(F.col(extras_col).cast(kind), none) if extras_col else none
    words = F.concat(*[F.col(f"{c}_hits") for c in cols])
    found = F.concat(words, *[F.col(f"{c}_numbers") for c in cols], extras)
    wide = wide.withColumn("_found", found).withColumn("_words", words).withColumn("_extras", extras)
    found, words, extras = F.col("_found"), F.col("_words"), F.col("_extras")
    first = F.filter(found, lambda m, i: ~F.exists(F.slice(found, F.lit(1), i), lambda o: (o["category"] == m["category"]) & (o["phrase"] == m["phrase"])))
    wide = wide.withColumn("_matches", F.array_sort(first, lambda a, b: F.when(a["weight"] > b["weight"], -1).when(a["weight"] < b["weight"], 1).otherwise(0)))
    top = lambda ms: F.coalesce(F.array_max(F.transform(ms, lambda m: m["weight"])), F.lit(0.0))
    new = F.filter(extras, lambda e: ~F.exists(words, lambda m: (m["category"] == e["category"]) & (m["phrase"] == e["phrase"])))
    keyword = F.greatest(top(words), top(new))
    pattern = F.greatest(*[top(F.col(f"{c}_numbers")) for c in cols], F.lit(0.0))
    if semantic_col and translated_semantic_col:
        wide = wide.withColumn("_best", best_of(F.col(semantic_col), F.col(translated_semantic_col)))
        semantic_col = "_best"
    semantic = F.coalesce(F.col(semantic_col)["score"], F.lit(0.0)) if semantic_col else F.lit(0.0)
    wide = wide.withColumns({"_kw": keyword, "_pat": pattern, "_sem": semantic})
    wide = wide.withColumn("_fused", noisy_or(F.col("_kw"), F.col("_sem"), F.col("_pat"), policy)).withColumn("_sev", policy.severity(F.col("_fused")))
    categories = F.array_distinct(F.transform("_matches", lambda m: m["category"]))
    has = lambda test: F.exists("_matches", test)
    tags = F.array(
        F.when(F.size("_extras") > 0, "kws"),
        F.when(has(lambda m: (m["match"] == "exact") & m["pattern"].isNull()), "keyword"),
        F.when(has(lambda m: m["match"] == "fuzzy"), "phonetic"),
        F.when(F.col("_pat") > 0, "pattern"),
        F.when(F.col("_sem") >= SEMANTIC_SOURCE, "semantic"),
        F.when(F.size("_translated_hits") > 0, "translation") if translation_col else F.lit(None).cast("string"))
    factors = F.when((F.coalesce(F.col(duration_col), F.lit(0.0)) >= 8.0) & (rank(F.col("_sev")) >= 2), F.lit("sustained speech")) if duration_col else F.lit(None).cast("string")
    blank = (F.col("_native") == "") & (F.col("_translated") == "")
    verdict = F.struct(
        F.col("_native").alias("transcript"), F.col("_translated").alias("translation"), (F.col(language_col) if language_col else F.lit(None).cast("string")).alias("language"),
        quantised(F.col("_kw")).alias("keyword_score"), quantised(F.col("_sem")).alias("semantic_score"), quantised(F.col("_pat")).alias("pattern_score"),
        F.when(blank, 0.0).otherwise(F.col("_fused")).alias("threat_score"), F.when(blank, "NONE").otherwise(F.col("_sev")).alias("severity"),
        (~blank & F.col("_sev").isin("HIGH", "CRITICAL")).alias("is_violation"), F.col("_matches").alias("matches"), F.array_compact(tags).alias("sources"), categories.alias("categories"),
        F.array_compact(F.array(factors)).alias("risk_factors"), (F.col(semantic_col)["reference"] if semantic_col else F.lit(None).cast("string")).alias("semantic_reference"),
        F.coalesce(F.get(categories, F.lit(0)).isin(policy.review_categories()), F.lit(False)).alias("review_only"))
    # a filter on the verdict must find it finished: pushed down, it would have everything above computed again in its
    # condition. None is pushed below a generator on what that gives (and of an outer one nothing is inferred).
    return wide.withColumn("_verdict", verdict).select(*df.columns, *(FOUND if keep else []), F.explode_outer(F.array("_verdict")).alias("verdict"))


def analyze(df: DataFrame, policy: Policy, id_col: str, text_col: str, translation_col: str | None = None, language_col: str | None = None, max_chars: int = 4000) -> DataFrame:
    """score() for texts of 1 to max_chars characters, with `error`; others have an error and no verdict."""
    fits = F.coalesce(F.length(text_col).between(1, max_chars), F.lit(False))
    marked = df.withColumn("error", F.when(~fits, F.lit(f"a text must have 1 to {max_chars} characters")))
    # what is refused is not scored: it goes through as no text
    given = marked.withColumn("_given", F.when(fits, F.col(text_col)))
    scored = score(given, policy, id_col, "_given", translation_col, language_col).drop("_given")
    return scored.withColumn("verdict", F.when(F.col("error").isNull(), F.col("verdict")))


def candidates(first: DataFrame) -> DataFrame:
    """Verdicts that a second opinion may raise."""
    v = F.col("verdict")
    return first.where((v["severity"] != "CRITICAL") & ((v["threat_score"] >= 0.2) | (F.size(v["matches"]) > 0)))


def upgraded(rows: DataFrame, key: str) -> DataFrame:
    """Of rows (key, before, after: verdicts), those whose second verdict ranks higher and is a violation, with a factor more."""
    better = (rank(F.col("after.severity")) > rank(F.col("before.severity"))) & F.col("after.is_violation")
    factor = F.array_append(F.col("after.risk_factors"), F.lit("second opinion"))
    return rows.where(better).select(key, F.col("before.severity").alias("severity_before"), F.col("after").withField("risk_factors", factor).alias("verdict"))


def second_opinion(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Candidates among the first verdicts whose second verdict ranks higher and is a violation, upgraded.

    first, second: rows (key, verdict)."""
    joined = candidates(first).select(key, F.col("verdict").alias("before")).join(second.select(key, F.col("verdict").alias("after")), key)
    return upgraded(joined, key)
