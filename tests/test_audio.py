import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from sottovoce.functions import audio, transcripts
from sottovoce.operators import semantic
from sottovoce.sources import settings, wav


def tone(rate, seconds=0.5, hz=440):
    return (0.5 * np.sin(2 * np.pi * hz * np.arange(int(rate * seconds)) / rate)).astype(np.float32)


def test_wav_round_trip_and_resampling(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(audio.encode_wav(tone(16000)))
    with wave.open(str(tmp_path / "b.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(44100)
        w.writeframes((np.repeat(tone(44100)[:, None], 2, 1) * 32767).astype("<i2").tobytes())
    (tmp_path / "c.wav").write_bytes(b"garbage")
    rows = {r["path"][-5]: r for r in wav.clips(spark, str(tmp_path)).collect()}
    assert rows["c"]["samples"] is None and rows["c"]["error"]
    assert np.abs(np.array(rows["a"]["samples"]) - tone(16000)).max() < 1e-3
    b = np.array(rows["b"]["samples"])
    assert abs(len(b) - 8000) <= 1 and np.abs(b[200:7800] - tone(16000)[200:7800]).max() < 0.02


def test_too_long_is_refused():
    with pytest.raises(ValueError):
        audio.decode_wav(audio.encode_wav(np.zeros(61 * 16000, np.float32)))


def test_reblocking(spark):
    data = (np.arange(1500) % 100).astype("<i2").tobytes()
    df = spark.createDataFrame([("s", i, data[a:b]) for i, (a, b) in enumerate([(0, 1000), (1000, 1002), (1002, 3000)])], "session_id string, block int, data binary")
    out = wav.reblock(df).orderBy("chunk_idx").collect()
    assert [r["chunk_idx"] for r in out] == [0, 1] and out[1]["samples"][0] == pytest.approx(12 / 32768)


def test_levels(spark):
    df = spark.createDataFrame([([0.5, -0.5],), ([],), ([0.0, 0.0],)], "s array<float>")
    out = df.select(audio.rms_db(F.col("s")).alias("d"), audio.peak(F.col("s")).alias("p")).collect()
    assert out[0]["d"] == pytest.approx(-6.0206, abs=1e-3) and out[0]["p"] == 0.5 and out[1]["d"] == -90 and out[2]["d"] == -90


def test_centroid(spark):
    df = spark.createDataFrame([(tone(16000, 512 / 16000, 1000).tolist(),)], "s array<float>")
    assert df.select(audio.spectral_centroid("s").alias("c")).head()["c"] == pytest.approx(1000, rel=0.1)


def test_transcripts(spark):
    assert transcripts.collapse("go go go go home") == "go home"
    assert transcripts.collapse("a b a b a b c") == "a b c"
    assert transcripts.collapse("no no no") == "no no no"  # under four words
    assert transcripts.collapse("a b a b c d") == "a b a b c d"  # two copies stay
    assert transcripts.collapse("x a b a b a b a y") == "x a b a y"  # a further half copy stays
    assert transcripts.collapse("go go go stop go go go stop go go go stop") == "go stop"
    df = spark.createDataFrame([("Thank you!", {"en": 0.4, "hi": 0.6})], "t string, p map<string,double>")
    r = df.select(transcripts.is_hallucination(F.col("t")).alias("h"), transcripts.remap(transcripts.detect_language(F.col("p"))).alias("l"), transcripts.language_name(F.lit("xx")).alias("n")).head()
    assert (r["h"], r["l"], r["n"]) == (True, "ur", "xx")
    assert [len(w) for w in spark.range(1).select(transcripts.windows(F.array_repeat(F.lit(0.0), 7), 3).alias("w")).head()["w"]] == [3, 3, 1]


def test_semantics(spark):
    refs = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "idx int, embedding array<double>")
    df = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0])], "id int, v array<double>")
    out = {r["id"]: r for r in semantic.margin(df, refs.where("idx < 2"), refs.where("idx = 2"), "id", "v").collect()}
    assert out[1]["idx"] == 0 and out[1]["margin"] == pytest.approx(1) and out[1]["score"] == 1 and out[2]["score"] == 0
    r = spark.range(1).select(semantic.best_of(F.struct(F.lit(0.5).alias("score"), F.lit("a").alias("reference")), F.struct(F.lit(0.5).alias("score"), F.lit("b").alias("reference"))).alias("b")).head()
    assert r["b"]["reference"] == "a"


def test_settings(spark):
    spark.conf.set("spark.sottovoce.retention_days", "7")
    assert settings.Settings.read(spark).retention_days == 7
