"""What findings on larger tables were about: work that is done once a row, and does not grow faster than the tables."""

import random
import re
import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from sottovoce.functions import numbers, text
from sottovoce.operators import jumps, keywords, merkle, rounds
from sottovoce.plans import catalogue
from sottovoce.sources.policy import EXAMPLE, Policy

SF = "/root/testdata/sf0.001"
RANGES = {"arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)], "devanagari": [(0x900, 0x97F)], "latin": [(0, 0x24F)]}


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_hits_are_computed_once(spark):
    for query in (catalogue.early_warnings, catalogue.phrase_hits_ranked, catalogue.phrase_hits_exact):
        assert plan(query(spark, SF)).count("split(") == 1, query.__name__


def test_a_script_is_found_in_one_pass_over_a_text(spark):
    assert plan(catalogue.script_profile(spark, SF)).count("text#") <= 3  # the relation's, the expression's, and none more
    rng = random.Random(7)
    texts = ["".join(rng.choice("aé ßا1ںनीяЖ漢.\n𐐀") for _ in range(rng.randrange(9))) for _ in range(3000)]

    def slow(t):
        kinds = [next((n for n, rs in RANGES.items() if any(a <= ord(c) <= b for a, b in rs)), "other") for c in t if unicodedata.category(c)[0] == "L"]
        return max(kinds, key=lambda k: (kinds.count(k), -kinds.index(k)), default="none")

    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.dominant_script(F.col("t")).alias("s")).collect()
    assert [(r["t"], r["s"]) for r in got if r["s"] != slow(r["t"])] == []


def test_a_translated_text_is_looked_through_once(spark):
    assert plan(catalogue.translated_verdicts(spark, SF)).count("near(") == 2  # one each for the text and its translation


def test_what_is_folded_once_is_what_was_folded_thrice(spark):
    rng = random.Random(3)
    pieces = ["one", "Dot", "do", ".", "'", " ", "1.2.3.4", "\uE000", "é.", "…", "\n", "seven", "DE12 3456 7890 1234 56", "٣", "no", "d'ot", "12345", "triple", ","]
    df = spark.createDataFrame([("".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(rng.randrange(14))),) for _ in range(2000)], "t string")
    f, fold = F.col("f"), text.fold_marks
    df = df.select(text.casefold_latin(F.col("t")).alias("f")).withColumn("m", numbers.dotted(f, fold))
    df = df.withColumn("s", numbers.spelled(f, F.col("m"), fold)).select(
        "f", numbers.undotted(f, F.col("m"), fold).alias("normal"), fold(f).alias("normal_"), numbers.long_runs(f, fold).alias("runs_"), numbers.quads(f, fold).alias("quads_"),
        numbers.long_runs_in(f, F.col("s"), numbers.written_ipv4(f), numbers.account_shapes(f), fold).alias("runs"), F.array_union(numbers.written_ipv4(f), numbers.spoken_ipv4(F.col("s"))).alias("quads"))
    got = df.collect()
    assert all((r["normal"], r["runs"], r["quads"]) == (r["normal_"], r["runs_"], r["quads_"]) for r in got)
    assert any(r["runs"] for r in got) and any(r["quads"] for r in got)


def test_families_meet_leaves_only_in_the_end(spark):
    leaves, _ = catalogue._leaves(spark, SF)
    found = merkle.proofs(merkle.forest(leaves), leaves)
    assert plan(found).count("collect_list") == 0  # no siblings are listed anew for every leaf


def test_rounds_of_pointers_send_nothing_to_the_driver(spark, monkeypatch):
    plans, was = [], jumps.checkpointed
    monkeypatch.setattr(jumps, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or was(df))
    plans.append(catalogue.event_cooldown(spark, SF)._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 3 and not any("Broadcast" in p for p in plans)


def test_few_blocks_are_held_at_a_time(spark, monkeypatch):
    key, seen, was = "spark.sql.execution.arrow.maxRecordsPerBatch", [], rounds.checkpointed
    before = spark.conf.get(key)
    monkeypatch.setattr(rounds, "checkpointed", lambda df: seen.append(int(spark.conf.get(key))) or was(df))
    catalogue.environment_events(spark, SF)
    assert min(seen) * rounds.BLOCK <= rounds.TOGETHER and spark.conf.get(key) == before


def test_only_texts_that_hold_a_phrase_are_split(spark):
    assert "split(coalesce" not in plan(catalogue.phrase_hits_ranked(spark, SF)).split("CASE WHEN RLIKE(")[0]
    rows = [("an access token",), ("an access-token",), ("xaccess token",), ("access tokens",), ("",), (None,)]
    docs = spark.createDataFrame(rows, "t string").select("t", text.normalize(F.col("t"), latin=True).alias("n"))
    found = keywords.exact_hits(docs, Policy(EXAMPLE | {"categories": {"c": {"weight": 0.5, "phrases": ["access token"]}}}), "t", "n")
    assert sorted(r["t"] for r in found.collect()) == ["access tokens", "an access token", "an access-token"]


def test_long_stretches_of_digits_and_dots_are_read_whole(spark):
    df = spark.createDataFrame([("one 2 " * 20_000,), ("1 dot " * 20_000 + "x 1 dot 2 dot 3 dot 4",)], "t string").select(F.trim("t").alias("t"))
    got = df.select(F.transform(numbers.digit_runs(F.col("t")), F.length).alias("n"), numbers.spoken_ipv4(F.col("t")).alias("q")).collect()
    assert got[0]["n"] == [40_000] and got[1]["q"] == ["1.2.3.4"]


def test_edited_and_missing_rows_come_from_one_join(spark):
    assert plan(catalogue.chain_tamper_detect(spark, SF)).count("Relation [") <= 6  # two less than with a join for each


@pytest.mark.parametrize("query", ["severity_counts", "language_counts", "detector_quality", "csv_projection", "category_counts"])
def test_numbers_are_looked_for_where_they_may_stand(spark, query):
    found = plan(catalogue.queries()[query](spark, SF))
    # one pass tells where numbers may stand, nothing looks behind every letter, and dots are only spelled out for some texts
    assert "_may" in found and "(?<![^ ])" not in found and found.count("near(") == 1


def test_texts_that_are_passed_over_hold_no_numbers(spark):
    rng = random.Random(11)
    pieces = ["one", "dot", "do", ".", "1.2.3.4", "\uE000", "\n", "seven", "DE12 3456 7890 1234 56", "gb29\u00a0nwbk60161331926819", "٣", "no", "12345", "double", "triple", ",", "and", "point", "4111111111111110", "\u0661.2.3.4", "x"]
    df = spark.createDataFrame([("".join(rng.choice(pieces) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(14))),) for _ in range(4000)] + [("so. 4111111111111110",)], "t string")
    f, fold = F.col("f"), text.fold_marks
    df = df.select(text.casefold_latin(F.col("t")).alias("f")).select("f", fold(f).alias("n"), fold(F.replace(f, F.lit("."), F.lit(" dot "))).alias("s"))
    # what is asked for by patterns that look behind, and without a part first
    plain = lambda p: F.regexp_extract_all("f", F.lit(f"(?U){p}"), F.lit(0))
    df = df.select("n", numbers.digit_runs(F.col("s"), numbers.MIN_RUN).alias("runs"), numbers.spoken_ipv4(F.col("s")).alias("quads"), numbers.digit_words(F.col("s")).alias("d"), numbers.written_ipv4(f).alias("written"),
                   plain(numbers.IPV4).alias("written_"), numbers.account_shapes(f).alias("accounts"), plain(numbers.IBAN).alias("accounts_"))
    got = df.select("*", numbers.digit_runs(F.col("d"), numbers.MIN_RUN).alias("runs_"), numbers.spoken_ipv4(F.col("d")).alias("quads_")).collect()
    may = {name: pc.match_substring_regex(pa.array([r["n"] for r in got]), p).to_pylist() for name, p in numbers.MAY.items()}
    for i, r in enumerate(got):
        assert all(r[c] == r[c + "_"] for c in ("runs", "quads", "written", "accounts"))
        assert (may["digits"][i] or not r["runs"] + r["quads"]) and (may["written"][i] or not r["written"]) and (may["accounts"][i] or not r["accounts"])
    assert all(any(r[c] for r in got) for c in ("runs", "quads", "written", "accounts")) and got[-1]["runs"] == ["4111111111111110"]
    assert not all(may["digits"]) and not all(may["written"]) and not all(may["accounts"])


def test_gaps_of_plain_and_other_text_are_the_same(spark):
    rng = random.Random(13)
    texts = ["".join(rng.choice("ab9é ß  ..,'\t\n!-_\uE000") if plain else rng.choice("aé  .,'’…“\u00a0\x7f×ª²٣") for _ in range(rng.randrange(16))) for plain in (True, False) for _ in range(2000)]
    gap = lambda c: c.isspace() or unicodedata.category(c)[0] in "PS" or unicodedata.category(c) == "Cc"

    def slow(t):
        t = t.translate(dict.fromkeys(map(ord, "'’")) | {ord("٣"): "3"})
        return re.sub(" +", " ", "".join(" " if gap(c) else c for c in t)).strip(" ")

    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.fold_marks(F.col("t")).alias("n")).collect()
    assert [(r["t"], r["n"]) for r in got if r["n"] != slow(r["t"])] == []
    normal = [r["n"] for r in got] + ["डب ڑھ", "xی ؤ"]
    want = spark.createDataFrame([(t,) for t in normal], "n string").select(text.skeleton(F.col("n")).alias("s")).collect()
    assert text.skeletons(pa.array(normal)) == [r["s"] for r in want]
