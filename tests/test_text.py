import pytest
from pyspark.sql import functions as F

from sottovoce.functions import text


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).head()["x"]


@pytest.mark.parametrize(
    ("given", "expected"),
    [(None, ""), ("", ""), ("  Hello,   WORLD! ", "hello world"), ("don't", "dont"), ("Straße", "strasse"), ("ＡＢＣ", "abc"), ("٣۴५", "345"), ("كتاب", "کتاب"), ("كِتَاب", "کتاب"), ("a_b-c", "a b c"), ("é", "é")],
)
def test_normalize(spark, given, expected):
    assert one(spark, text.normalize(F.lit(given))) == expected


def test_normalize_is_idempotent_and_latin_path_agrees(spark):
    rows = spark.createDataFrame([("Größe ÉTÉ, l'été 12.5%",), ("x" * 5000,), (None,)], "t string")
    out = rows.select(text.normalize(F.col("t")).alias("a"), text.normalize(F.col("t"), latin=True).alias("b")).select("a", "b", text.normalize(F.col("a")).alias("c")).collect()
    assert all(r["a"] == r["b"] == r["c"] for r in out)


def test_skeleton_joins_letters_that_sound_alike(spark):
    assert one(spark, text.skeleton(text.normalize(F.lit("ذرا سا")))) == one(spark, text.skeleton(text.normalize(F.lit("زرا صا"))))


@pytest.mark.parametrize(("given", "expected"), [("hello", "latin"), ("سلام hi", "arabic"), ("नमस्ते", "devanagari"), ("привет", "other"), ("123 !", "none"), (None, "none"), ("ab سل", "latin"), ("سل ab", "arabic")])
def test_dominant_script(spark, given, expected):
    assert one(spark, text.dominant_script(F.lit(given).cast("string"))) == expected
