"""Keyword detection (K3-K9): policy phrases in normalised text, exactly with inflection, or by sound.

Phrases are found within the row: a policy is small, so its phrases travel as literals (exact) or with the function that
looks for them (by sound), and no text is joined or shuffled."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sottovoce.functions.fuzzy import PhraseIndex
from sottovoce.functions.numbers import MATCH, MAY, any_word
from sottovoce.functions.text import skeletons
from sottovoce.sources.policy import SUFFIXES, Policy

FUZZY_MIN, FUZZY_DISCOUNT = 6, 0.9
#: Letters from which on the lower of the two similarities is enough, and these.
FUZZY_LONG, FUZZY_FLOOR, FUZZY_FLOOR_SHORT = 10, 86.0, 90.0
_ENTRY = f"struct<{MATCH},ord:int,at:int,key:string>"


def _listed(policy: Policy, spark: SparkSession) -> list[dict]:
    """The policy's phrases, in its order."""
    return [r.asDict() for r in policy.phrases(spark).orderBy("ord").collect()]


def _book(phrases: list[dict]) -> dict[str, list[dict]]:
    """By the first word: the words of each phrase and inflection (K4), and the phrase's number. Inflection is spelled out here, so that texts are only ever compared by whole words."""
    book: dict[str, list[dict]] = {}
    for n, p in enumerate(phrases):
        for ending in ["", *SUFFIXES]:
            words = (p["key"] + ending).split(" ")
            book.setdefault(words[0], []).append({"words": words, "n": n})
    return book


def _floor(sound: str) -> float:
    return FUZZY_FLOOR if len(sound) >= FUZZY_LONG else FUZZY_FLOOR_SHORT


def looked_through(normal: Column, sounds: list[tuple[int, str]], keys: list[str]) -> Column:
    """One pass of Arrow batches over texts in normal form: a struct of `sounding`, those of (number, skeleton) phrases that sound like a
    part of the text (K6; array of n and similarity), and booleans: `worded`, whether one of the keys may stand there, and the numbers.MAY
    that may. Patterns of one automaton read a text in a small part of the time that the JVM's take, which then read what is left."""
    wanted = [(n, s) for n, s in sounds if len(s) >= FUZZY_MIN]
    may = {"worded": f"(?:^| ){any_word(keys)}"} | MAY
    hits = pa.list_(pa.struct([("n", pa.int32()), ("similarity", pa.float64())]))

    @F.arrow_udf(f"sounding array<struct<n:int,similarity:double>>, {', '.join(f'{name} boolean' for name in may)}")
    def near(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = PhraseIndex([(s, _floor(s)) for _, s in wanted])
        for texts in batches:
            found = index.find([t if t and len(t) >= FUZZY_MIN else None for t in skeletons(texts)])
            sounding = pa.array([[{"n": wanted[k][0], "similarity": round(v, 1)} for k, v in f] for f in found], hits)
            yield pa.StructArray.from_arrays([sounding, *(pc.match_substring_regex(texts, p).fill_null(False) for p in may.values())], ["sounding", *may])

    return near(normal)


def matched(docs: DataFrame, policy: Policy, normal_col: str, out_col: str, with_fuzzy: bool = True, may_col: str | None = None) -> DataFrame:
    """docs with out_col, the array of phrases (struct of a match, ord, at and key) that stand in the text in normal form:
    exactly, up to inflection (K3-K5; at: where the first hit ends), or else by sound (K6). Each phrase once.
    may_col: with a struct of the numbers.MAY that the text may hold, all where nothing by sound is looked for."""
    phrases = _listed(policy, docs.sparkSession)
    anything = F.struct(*[F.lit(True).alias(name) for name in MAY])
    if not phrases:
        none = docs.withColumn(out_col, F.array().cast(f"array<{_ENTRY}>"))
        return none.withColumn(may_col, anything) if may_col else none
    book = _book(phrases)
    # literals: a JSON text that is parsed once, when the plan is made
    known = F.from_json(F.lit(json.dumps(book)), "map<string,array<struct<words:array<string>,n:int>>>")
    shown = [{"category": p["category"], "phrase": p["text"], "weight": p["weight"], "faint": round(p["weight"] * FUZZY_DISCOUNT, 4), "lang": p["lang"], "ord": p["ord"], "key": p["key"]} for p in phrases]
    table = F.from_json(F.lit(json.dumps(shown)), "array<struct<category:string,phrase:string,weight:double,faint:double,lang:string,ord:int,key:string>>")
    # most texts hold no phrase, which one pattern tells; only the words of others are listed
    whole = F.coalesce(normal_col, F.lit(""))
    keys = [p["key"] for p in phrases]
    wide, worded = docs, F.concat(F.lit(" "), whole).rlike(f" {any_word(keys)}")
    if with_fuzzy:
        wide = wide.withColumn("_f", looked_through(F.col(normal_col), [(n, p["skeleton"]) for n, p in enumerate(phrases)], keys))
        worded = F.col("_f")["worded"] & worded
    wide = wide.withColumn("_w", F.when(worded, F.split(whole, " ")).otherwise(F.array().cast("array<string>")))
    wide = wide.withColumn("_s", F.filter(F.transform("_w", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(sorted(book))))
    stands = lambda x: lambda v: F.slice("_w", x["i"] + 1, F.size(v["words"])) == v["words"]
    spot = lambda x: F.transform(F.filter(F.element_at(known, x["w"]), stands(x)), lambda v: F.struct(v["n"].alias("n"), (x["i"] + F.size(v["words"])).alias("at")))
    wide = wide.withColumn("_o", F.flatten(F.transform("_s", spot)))
    wide = wide.withColumn("_n", F.array_distinct(F.transform("_o", lambda o: o["n"])))

    def entry(n: Column, weight: str, kind: str, similarity: Column, at: Column) -> Column:
        p = F.get(table, n)
        return F.struct(p["category"].alias("category"), p["phrase"].alias("phrase"), p[weight].alias("weight"), p["lang"].alias("lang"), F.lit(kind).alias("match"), similarity.alias("similarity"),
                        F.lit(None).cast("string").alias("pattern"), F.lit(None).cast("int").alias("windows"), p["ord"].alias("ord"), at.cast("int").alias("at"), p["key"].alias("key"))

    first = lambda n: F.array_min(F.transform(F.filter("_o", lambda o: o["n"] == n), lambda o: o["at"]))
    found = F.transform("_n", lambda n: entry(n, "weight", "exact", F.lit(None).cast("double"), first(n)))
    if with_fuzzy:
        others = F.filter(F.col("_f")["sounding"], lambda f: ~F.array_contains("_n", f["n"]))
        found = F.concat(found, F.transform(F.coalesce(others, F.array().cast("array<struct<n:int,similarity:double>>")), lambda f: entry(f["n"], "faint", "fuzzy", f["similarity"], F.lit(1 << 30))))
    wide = wide.withColumn(out_col, found)
    if may_col:
        wide = wide.withColumn(may_col, F.struct(*[F.col("_f")[name].alias(name) for name in MAY]) if with_fuzzy else anything)
    return wide.drop("_w", "_s", "_o", "_n", "_f")


def each(df: DataFrame, kept: list[str], array: Column, name: str) -> DataFrame:
    """A row per row of df and element of a computed array, of which none is null. The generator is outer: of another one Spark
    infers a filter on the array's size, pushed below, in whose condition all that the array is made of is computed again, inner
    columns once a word."""
    return df.select(*kept, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def exact_hits(docs: DataFrame, policy: Policy, id_col: str, normal_col: str) -> DataFrame:
    """A row per row of docs, category and phrase that occurs (K3-K5): id, weight, lang, ord, key, at (place of the first hit's end)."""
    found = matched(docs.select(id_col, normal_col), policy, normal_col, "_hits", with_fuzzy=False)
    return each(found, [id_col], F.col("_hits"), "h").select(id_col, "h.category", "h.phrase", "h.weight", "h.lang", "h.ord", "h.key", "h.at")


def exact_array(docs: DataFrame, policy: Policy, id_col: str, normal_col: str) -> DataFrame:
    """A row per row of docs with exact hits: id, hits."""
    found = matched(docs.select(id_col, normal_col), policy, normal_col, "hits", with_fuzzy=False)
    # behind a generator the filter finds the hits finished, as in each()
    return found.select(id_col, F.explode_outer(F.array("hits")).alias("hits")).where(F.size("hits") > 0)


def suppress(hits: Column) -> Column:
    """K7, K8: a fuzzy hit stays only if it outweighs every exact hit of its category; a hit inside another of its category that weighs no less goes."""
    def beaten(h: Column) -> Column:
        return (h["match"] == "fuzzy") & F.exists(hits, lambda o: (o["match"] == "exact") & (o["category"] == h["category"]) & (o["weight"] >= h["weight"]))

    kept = F.filter(hits, lambda h: ~beaten(h))
    pad = lambda h: F.concat(F.lit(" "), h["key"], F.lit(" "))
    return F.filter(kept, lambda h: ~F.exists(kept, lambda o: (o["category"] == h["category"]) & (o["key"] != h["key"]) & (o["weight"] >= h["weight"]) & F.contains(pad(o), pad(h))))


def ranked(hits: Column) -> Column:
    """K9: heaviest first, then by place, then in the policy's order."""
    def order(a: Column, b: Column) -> Column:
        key = lambda h: F.struct((-h["weight"]).alias("w"), h["at"].alias("at"), h["ord"].alias("ord"))
        return F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)

    return F.transform(F.array_sort(hits, order), lambda h: F.struct(*[h[n.split(":")[0]].alias(n.split(":")[0]) for n in MATCH.split(",")]))
