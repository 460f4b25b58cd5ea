"""Semantic intent over embeddings (V2-V9). The model itself is a plug-in: any function from text to vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of a scored margin: what counts as no and as full evidence.
FLOOR, CEILING = 0.04, 0.30


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalise(v: Column) -> Column:
    """V3."""
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-9))
    return F.transform(v, lambda x: x.cast("double") / norm)


def mean_pool(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """V2, for embedding plug-ins: (batch, tokens, size) and (batch, tokens) to (batch, size)."""
    m = mask[..., None].astype(hidden.dtype)
    return (hidden * m).sum(1) / np.maximum(m.sum(1), 1e-9)


def calibrate(margin: Column, floor: float = FLOOR, ceiling: float = CEILING) -> Column:
    """V6."""
    return F.greatest(F.least((margin - floor) / (ceiling - floor), F.lit(1.0)), F.lit(0.0))


#: Bytes that all reference vectors may take together, as they travel to every task, and products that are held at once.
REFERENCE_BYTES, PRODUCTS = 256 << 20, 1 << 22


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """V3 for a matrix."""
    wide = vectors.astype(np.float64)
    return wide / np.maximum(np.sqrt((wide * wide).sum(1, keepdims=True)), 1e-9)


def closest(vectors: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each unit vector the place of its nearest reference (the first of equally near ones) and their cosine, in blocks."""
    place, best = np.zeros(len(vectors), np.int64), np.zeros(len(vectors))
    step = max(1, PRODUCTS // max(len(references), 1))
    for at in range(0, len(vectors), step):
        products = vectors[at : at + step] @ references.T
        top = products.max(1)
        # equal references may differ in the last bits of their products
        place[at : at + step], best[at : at + step] = (products >= top[:, None] - 1e-12).argmax(1), top
    return place, best


def _matrix(references: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The numbers and unit vectors of references (idx, embedding), by number; checked against REFERENCE_BYTES before they come to the driver."""
    size = references.agg(F.sum(F.size("embedding").cast("long") * 8)).head()[0] or 0
    if size > REFERENCE_BYTES:
        raise ValueError(f"reference vectors of {size} bytes; at most {REFERENCE_BYTES} can be sent to every task")
    rows = references.select("idx", "embedding").orderBy("idx").toArrow()
    vectors = rows.column("embedding").combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return rows.column("idx").to_numpy(), unit_rows(flat.reshape(len(rows), -1)) if len(rows) else np.zeros((0, 0))


def _compared(df: DataFrame, references: DataFrame, benign: DataFrame | None, id_col: str, vector_col: str) -> DataFrame:
    """id, idx, similarity and benign (the similarity to the nearest benign sentence) in one pass over the vectors; null for a null vector, and where there is nothing to compare to."""
    context = df.sparkSession.sparkContext
    sides = [_matrix(references), _matrix(benign) if benign is not None else (np.zeros(0, np.int64), np.zeros((0, 0)))]
    shared = context.broadcast(sides)

    @F.arrow_udf("idx int, similarity double, benign double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for vectors in batches:
            there = np.asarray(vectors.is_valid())
            flat = vectors.drop_null().flatten().to_numpy(zero_copy_only=False)
            out = []
            for k, (numbers, matrix) in enumerate(shared.value):
                cosine, idx = np.full(len(vectors), np.nan), np.full(len(vectors), -1, np.int64)
                if len(numbers) and there.any():
                    place, cosine[there] = closest(unit_rows(flat.reshape(int(there.sum()), -1)), matrix)
                    idx[there] = numbers[place]
                out += [pa.array(idx, pa.int32(), mask=np.isnan(cosine))] * (k == 0) + [pa.array(cosine, pa.float64(), mask=np.isnan(cosine))]
            yield pa.StructArray.from_arrays(out, ["idx", "similarity", "benign"])

    return df.select(F.col(id_col), run(F.col(vector_col)).alias("_m")).select(id_col, "_m.idx", "_m.similarity", "_m.benign")


def nearest(df: DataFrame, references: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """V4: id, idx and similarity of the nearest reference (idx, embedding); the lowest idx wins ties."""
    return _compared(df, references, None, id_col, vector_col).drop("benign")


def margin(df: DataFrame, references: DataFrame, benign: DataFrame | None, id_col: str, vector_col: str, text_col: str | None = None, phrases: DataFrame | None = None) -> DataFrame:
    """V5-V7: id, idx, similarity, margin to the nearest benign sentence (to 0 without any) and calibrated score.

    With text_col, blank texts score 0 and have no reference; with phrases (idx, phrase) the nearest one's text is given as `phrase`."""
    vectors = df if text_col is None else df.withColumn(vector_col, F.when(F.trim(F.coalesce(text_col, F.lit(""))) != "", F.col(vector_col)))
    both = _compared(vectors, references, benign, id_col, vector_col)
    both = both.withColumn("margin", F.col("similarity") - F.coalesce("benign", F.lit(0.0)))
    score = F.when(F.col("margin").isNotNull(), calibrate(F.col("margin")))  # least() and greatest() pass over nulls
    both = both.withColumn("score", F.coalesce(score, F.lit(0.0)) if text_col else score).drop("benign")
    return both if phrases is None else both.join(F.broadcast(phrases.select("idx", "phrase")), "idx", "left").select(*both.columns, "phrase")


def best_of(native: Column, translated: Column) -> Column:
    """V9: of two struct<score, reference> the better; the native one wins ties; never below 0."""
    zero = F.struct(F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("reference"))
    n, t = F.coalesce(native, zero), F.coalesce(translated, zero)
    best = F.when(t["score"] > n["score"], t).otherwise(n)
    return F.when(best["score"] > 0, best).otherwise(zero)


def embed(df: DataFrame, text_col: str, vector_col: str, model: Callable[[], Callable]) -> DataFrame:
    """V1: adds vectors by a plug-in. model() is called once a task and gives a function from a list of texts to vectors."""
    @F.pandas_udf("array<float>")
    def run(batches):
        import pandas as pd

        encode = model()
        for texts in batches:
            yield pd.Series([list(map(float, v)) for v in encode(texts.fillna("").tolist())])

    return df.withColumn(vector_col, run.asNondeterministic()(F.col(text_col)))
