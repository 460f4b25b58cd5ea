"""WAV clips and PCM blocks as rows of samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sottovoce.functions import audio

MAX_BYTES = 25 << 20


def clips(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """path, samples and error of WAV files; those above the limit (which are not read), broken or long ones have an error and no samples."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path)
    files = found.where(F.col("length") <= max_bytes)
    large = found.where(F.col("length") > max_bytes).select("path", F.lit(None).cast("array<float>").alias("samples"), F.lit(f"the file has more than {max_bytes} bytes").alias("error"))

    @F.pandas_udf("struct<samples:array<float>,error:string>")
    def decode(contents: pd.Series) -> pd.DataFrame:
        out = []
        for data in contents:
            try:
                out.append((audio.decode_wav(data).tolist(), None))
            except Exception as e:  # noqa: BLE001 - whatever is wrong with a clip belongs to its row
                out.append((None, str(e) or type(e).__name__))
        return pd.DataFrame(out, columns=["samples", "error"])

    return files.withColumn("d", decode("content")).select("path", "d.samples", "d.error").unionByName(large)


def chunked(clips_: DataFrame, size: int = audio.CHUNK) -> DataFrame:
    """Rows (path, chunk_idx, samples) of whole chunks."""
    n = F.floor(F.size("samples") / size).cast("int")
    each = clips_.where("samples is not null").select("path", "samples", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))).alias("k"))
    return each.select("path", F.col("k").cast("bigint").alias("chunk_idx"), F.slice("samples", F.col("k") * size + 1, F.lit(size)).alias("samples"))


def reblock(blocks: DataFrame, key: str = "session_id", order: str = "block", data: str = "data", size: int = audio.CHUNK) -> DataFrame:
    """PCM blocks of any size to whole chunks, the rest carried on; an odd byte at a block's end is dropped."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        samples = np.concatenate([audio.pcm16(b) for b in frame.sort_values(order)[data]] or [np.zeros(0, np.float32)])
        n = len(samples) // size
        return pd.DataFrame({key: [frame[key].iloc[0]] * n, "chunk_idx": range(n), "samples": list(samples[: n * size].reshape(n, size))})

    return blocks.groupBy(key).applyInPandas(run, f"{key} {dict(blocks.dtypes)[key]}, chunk_idx long, samples array<float>")


def carried(tail: np.ndarray, blocks: Iterator[bytes], size: int = audio.CHUNK) -> tuple[list[np.ndarray], np.ndarray]:
    """The chunks that blocks complete after a tail, and the new tail; for streams."""
    x = np.concatenate([tail, *[audio.pcm16(b) for b in blocks]])
    n = len(x) // size
    return list(x[: n * size].reshape(n, size)), x[n * size :]
