import numpy as np
import pytest
from pyspark.sql import functions as F

from sottovoce.operators import semantic


def frame(spark, rows, name="id"):
    return spark.createDataFrame([(int(i), None if v is None else [float(x) for x in v]) for i, v in rows], f"{name} int, embedding array<float>")


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    vectors, refs = rng.normal(size=(300, 8)), rng.normal(size=(40, 8))
    refs[17] = refs[3] * 2  # the same direction: the lower number wins
    vectors[5], vectors[6] = refs[3], 0
    return vectors, refs, rng.normal(size=(9, 8))


def plain(v, refs):
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-9)
    products = unit(v.astype(np.float32).astype(float)) @ unit(refs.astype(np.float32).astype(float)).T
    return (products >= products.max() - 1e-12).argmax(), products.max()


def test_nearest_and_margin(spark, data, monkeypatch):
    monkeypatch.setattr(semantic, "PRODUCTS", 70)
    vectors, refs, benign = data
    df = frame(spark, [*enumerate(vectors), (1000, None)]).repartition(3)
    r, b = frame(spark, enumerate(refs), "idx"), frame(spark, enumerate(benign), "idx")
    got = {x["id"]: x for x in semantic.margin(df, r, b, "id", "embedding").collect()}
    for k, v in enumerate(vectors):
        idx, sim = plain(v, refs)
        assert got[k]["idx"] == idx and got[k]["similarity"] == pytest.approx(sim) and got[k]["margin"] == pytest.approx(sim - plain(v, benign)[1])
        assert got[k]["score"] == pytest.approx(min(max((got[k]["margin"] - 0.04) / 0.26, 0), 1))
    assert got[5]["idx"] == 3 and got[1000]["idx"] is None and got[1000]["similarity"] is None
    alone = {x["id"]: x for x in semantic.margin(df, r, None, "id", "embedding").collect()}
    assert alone[7]["margin"] == alone[7]["similarity"]
    assert semantic.nearest(df, r.limit(0), "id", "embedding").where("idx is not null").count() == 0 and semantic.nearest(df.limit(0), r, "id", "embedding").count() == 0


def test_phrases_and_blank_texts(spark, data):
    vectors, refs, _ = data
    df = frame(spark, enumerate(vectors[:4])).withColumn("text", F.when(F.col("id") == 1, " ").when(F.col("id") != 2, "said"))
    phrases = spark.createDataFrame([(i, f"phrase {i}") for i in range(40)], "idx int, phrase string")
    got = {x["id"]: x for x in semantic.margin(df, frame(spark, enumerate(refs), "idx"), None, "id", "embedding", "text", phrases).collect()}
    assert got[0]["phrase"] == f"phrase {plain(vectors[0], refs)[0]}" and [(got[k]["score"], got[k]["phrase"]) for k in (1, 2)] == [(0.0, None)] * 2


def test_ten_thousand_references(spark):
    rng = np.random.default_rng(1)
    refs = rng.normal(size=(10_000, 16)).astype(np.float32)
    got = semantic.nearest(frame(spark, enumerate(refs[::50])), frame(spark, enumerate(refs), "idx"), "id", "embedding").collect()
    assert len(got) == 200 and all(r["idx"] == 50 * r["id"] and r["similarity"] == pytest.approx(1) for r in got)


def test_too_many_references(spark, data, monkeypatch):
    monkeypatch.setattr(semantic, "REFERENCE_BYTES", 100)
    with pytest.raises(ValueError, match="bytes"):
        semantic.nearest(frame(spark, enumerate(data[0])), frame(spark, enumerate(data[1]), "idx"), "id", "embedding")


def test_the_better_of_text_and_translation_counts(spark):
    from sottovoce.operators import fusion
    from sottovoce.sources.policy import Policy

    kind = "struct<score:double,reference:string>"
    df = spark.createDataFrame([(1, "said", (0.2, "a"), (0.9, "b")), (2, "said", (0.9, "a"), None), (3, "said", None, None)], f"id int, t string, s {kind}, u {kind}")
    got = {r["id"]: r["verdict"] for r in fusion.score(df, Policy.example(), "id", "t", semantic_col="s", translated_semantic_col="u").collect()}
    assert [(got[i]["semantic_score"], got[i]["semantic_reference"]) for i in (1, 2, 3)] == [(0.9, "b"), (0.9, "a"), (0.0, None)]
    assert got[1]["sources"] == ["semantic"] and fusion.score(df, Policy.example(), "id", "t", semantic_col="s").where("id = 1").head()["verdict"]["semantic_score"] == 0.2
