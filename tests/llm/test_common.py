import pytest
from pyspark.sql import functions as F

from sottovoce.llm import common


@pytest.mark.parametrize("small", [0, common.SMALL_ROWS])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_skew_join_equals_a_plain_join(spark, monkeypatch, small, how):
    monkeypatch.setattr(common, "SMALL_ROWS", small)
    left = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 400).alias("k"), F.col("id").alias("v"))
    right = spark.range(300).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    got = common.skew_join(left, right, "k", how)
    assert sorted(map(tuple, got.select("k", "v", "w").collect()), key=repr) == sorted(map(tuple, left.join(right, "k", how).select("k", "v", "w").collect()), key=repr)
    hot = common.hot_keys(left, "k")
    assert (hot is None) if small else ([r["k"] for r in hot.collect()] == [7] or 7 in [r["k"] for r in hot.collect()])


@pytest.mark.parametrize("keys, most", [(1, 1 << 31), (5000, 1 << 31), (300_000, 1 << 20), (5000, 4096), (0, 1 << 31)])
def test_flagged_misses_nothing(spark, keys, most):
    needed = spark.range(keys).select((F.col("id") * 7 - 3).alias("any_name"))
    df = spark.range(40_000).select((F.col("id") - 3).alias("key")).union(spark.createDataFrame([(None,)], "key long"))
    got = common.flagged(df, "key", needed, "hit", most)
    assert got.columns == ["key", "hit"] and got.count() == 40_001
    wrong = got.where("key is not null and pmod(key + 3, 7) = 0").where(F.col("key") < keys * 7 - 3).where("not hit")
    assert wrong.count() == 0
    others = got.where("key is not null").join(needed, F.col("key") == F.col("any_name"), "left_anti").where("hit").count()
    assert others == 35_000 if most == 4096 else keys * 8 > most or others < 10_000


def test_clear_of(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "A int, kept_a int, `x.y` int, b int")
    out, of = common.clear_of(df, "a", "c")
    assert out.columns == ["kept_kept_A", "kept_a", "x.y", "b"]
    assert tuple(out.select(of("A"), of("x.y"), of("b")).head()) == (1, 3, 4)
    assert common.clear_of(df, "z")[0].columns == df.columns


def test_few_rows_are_written_to_few_files(spark):
    many = spark.range(1000).repartition(40, "id")
    few = common.materialise(many, "few", 5000)
    assert len(few.inputFiles()) == 2 and sorted(r["id"] for r in few.collect()) == list(range(1000))
    assert len(common.materialise(many, "many", common.FEW_ROWS + 1).inputFiles()) > 30
