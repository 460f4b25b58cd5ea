import pytest
from pyspark.sql import functions as F

from sottovoce.functions.fuzzy import lcs_length, partial_ratio
from sottovoce.functions.text import normalize
from sottovoce.operators import fusion, keywords
from sottovoce.sources.policy import EXAMPLE, Policy, PolicyError


def verdicts(spark, rows, **options):
    df = spark.createDataFrame([(i, *r) if isinstance(r, tuple) else (i, r, None) for i, r in enumerate(rows)], "id int, t string, tr string")
    out = fusion.score(df, Policy.example(), "id", "t", "tr", **options).collect()
    return {r["id"]: r["verdict"] for r in out}


def test_exact_hits_respect_words_and_inflection(spark):
    rows = [(1, "the access tokens leaked"), (2, "tokenize"), (3, "accesstoken"), (4, "idiots and idiotic"), (5, ""), (6, "an api key api key")]
    docs = spark.createDataFrame(rows, "id int, t string").select("id", normalize(F.col("t")).alias("n"))
    found = {(r["id"], r["phrase"]) for r in keywords.exact_hits(docs, Policy.example(), "id", "n").collect()}
    assert found == {(1, "access token"), (1, "token"), (4, "idiot"), (6, "api key")}


def test_join_equals_containment(spark):
    words = ["access", "token", "tokens", "api", "key", "the", "private"]
    rows = [(i, " ".join(words[(i * k) % 7] for k in range(1, 9))) for i in range(200)]
    docs = spark.createDataFrame(rows, "id int, n string")
    found = {(r["id"], r["phrase"]) for r in keywords.exact_hits(docs, Policy.example(), "id", "n").collect()}
    spelled = [(p.text, f" {p.key}{s} ") for p in Policy.example().phrases(spark).collect() for s in ["", *__import__("sottovoce.sources.policy").sources.policy.SUFFIXES]]
    assert found == {(i, p) for i, t in rows for p, k in spelled if k in f" {t} "}


def test_verdict(spark):
    v = verdicts(spark, ["my card is 4539 5787 6362 1486", "", None, "nothing to see", ("hola", "the api key"), "you idiot", "token " * 3000])
    assert v[0]["severity"] == "CRITICAL" and v[0]["sources"] == ["pattern"] and v[0]["is_violation"]
    assert v[1]["severity"] == v[2]["severity"] == v[3]["severity"] == "NONE" and v[3]["matches"] == []
    assert v[4]["severity"] == "CRITICAL" and v[4]["sources"] == ["keyword", "translation"]
    assert v[5]["review_only"] and v[5]["severity"] == "HIGH"
    assert v[6]["threat_score"] == 0.45 and len(v[6]["matches"]) == 1


def test_fused_is_at_least_each_part(spark):
    p = Policy.example()
    grid = spark.range(1331).select((F.col("id") % 11 / 10).alias("k"), (F.floor(F.col("id") / 11) % 11 / 10).alias("s"), (F.floor(F.col("id") / 121) / 10).alias("n"))
    bad = grid.withColumn("f", fusion.noisy_or(F.col("k"), F.col("s"), F.col("n"), p)).where("f > 1 or f < k - 1e-4 or f < n - 1e-4 or f < 0.7 * s - 1e-4")
    assert bad.count() == 0


@pytest.mark.parametrize(("x", "band"), [(0.85, "CRITICAL"), (0.84999, "HIGH"), (0.65, "HIGH"), (0.4, "MEDIUM"), (0.2, "LOW"), (0.1999, "NONE")])
def test_bands(spark, x, band):
    assert spark.range(1).select(Policy.example().severity(F.lit(x)).alias("s")).head()["s"] == band


def test_rounding_to_even_on_request(spark):
    assert spark.range(1).select(fusion.exact_round4(F.lit(0.12345)).alias("x")).head()["x"] in (0.1234, 0.1235)


def test_fuzzy(spark):
    assert lcs_length("abcde", "ace") == 3
    assert partial_ratio("token", "my token here") == 100
    assert partial_ratio("abcdef", "xxabcxefxx") == pytest.approx(2 * 5 / 12 * 100, abs=0.1)
    assert partial_ratio("", "x") == 0
    v = verdicts(spark, ["strictly internl use only"], with_fuzzy=True)
    assert [(m["phrase"], m["match"]) for m in v[0]["matches"]] == [("internal use only", "fuzzy")] and v[0]["sources"] == ["phonetic"]


def test_policy_is_validated(tmp_path):
    with pytest.raises(PolicyError):
        Policy({**EXAMPLE, "categories": {}})
    with pytest.raises(PolicyError):
        Policy({**EXAMPLE, "categories": {"x": {"weight": 2}}})
    p = Policy.example()
    p.publish(str(tmp_path / "policy"))
    p.raw = {**p.raw, "review_categories": ["x"]}
    p.publish(str(tmp_path / "policy"))
    assert Policy.latest(str(tmp_path / "policy")).review_categories() == ["x"]


def test_second_opinion(spark):
    def rows(text):
        return fusion.score(spark.createDataFrame([(1, text)], "id int, t string"), Policy.example(), "id", "t", latin=True)

    better = fusion.second_opinion(rows("please send them a token"), rows("an api key"), "id").collect()
    assert better[0]["severity_before"] == "MEDIUM" and better[0]["verdict"]["severity"] == "CRITICAL" and better[0]["verdict"]["risk_factors"] == ["second opinion"]
    assert fusion.second_opinion(rows("please send them a token"), rows("please send them a token"), "id").count() == 0


def test_rows_that_share_an_id_keep_their_own_hits(spark):
    df = spark.createDataFrame([(1, "an api key"), (1, "nothing"), (None, "an api key"), (1, "an api key"), (2, "nothing\n")], "id int, t string")
    got = sorted(((r["id"] or 0), r["t"], r["verdict"]["severity"], len(r["verdict"]["matches"])) for r in fusion.score(df, Policy.example(), "id", "t").collect())
    hit = fusion.score(df.limit(1), Policy.example(), "id", "t").head()["verdict"]
    assert hit["severity"] != "NONE" and len(hit["matches"]) == 1
    assert got == sorted([(1, "an api key", hit["severity"], 1), (1, "nothing", "NONE", 0), (0, "an api key", hit["severity"], 1), (1, "an api key", hit["severity"], 1), (2, "nothing\n", "NONE", 0)])


def test_translation_is_named_whenever_it_has_hits(spark):
    got = verdicts(spark, [("an api key", "an api key"), ("nothing", "an api key"), ("an api key", "nothing")])
    assert ["translation" in got[i]["sources"] for i in range(3)] == [True, True, False]


def test_short_texts_do_not_sound_like_a_phrase(spark):
    df = spark.createDataFrame([(1, "to"), (2, "acess tokenn please")], "id int, t string")
    got = {r["id"]: [m["phrase"] for m in r["verdict"]["matches"]] for r in fusion.score(df, Policy.example(), "id", "t", with_fuzzy=True).collect()}
    assert got[1] == [] and "access token" in got[2]
