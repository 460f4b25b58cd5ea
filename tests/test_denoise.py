import numpy as np
import pytest

from sottovoce.functions import denoise
from sottovoce.operators import fusion
from sottovoce.sources import wav
from sottovoce.sources.policy import Policy


@pytest.mark.parametrize("n", [1, 255, 256, 1024, 5000, 16_001])
def test_a_spectrum_comes_back(n):
    x = np.random.default_rng(n).normal(size=n)
    assert np.allclose(denoise.signal(denoise.spectrum(x), n), x, atol=1e-9)


def _clip():
    rng = np.random.default_rng(5)
    t = np.arange(32_000) / 16_000
    voice = np.where((t % 0.5) < 0.3, 0.1 * np.sin(2 * np.pi * 440 * t) + 0.05 * np.sin(2 * np.pi * 900 * t), 0)
    return voice, voice + rng.normal(scale=0.08, size=len(t)), rng.normal(scale=0.08, size=24_000)


def test_the_gate_raises_the_signal_above_the_noise():
    voice, noisy, noise = _clip()
    ratio = lambda x: 10 * np.log10((voice**2).mean() / ((x - voice) ** 2).mean())
    assert ratio(denoise.cleaned(noisy, noise)) > ratio(noisy) + 5


def test_only_noisy_segments_are_cleaned(spark):
    voice, noisy, noise = (x.astype(float).tolist() for x in _clip())
    rows = [(1, noisy, noise), (2, voice, [x / 100 for x in noise]), (3, noisy, None), (4, None, noise), (5, [], noise)]
    df = spark.createDataFrame(rows, "id int, s array<double>, n array<double>")
    got = {r["id"]: r for r in denoise.denoised(df, "s", "n").collect()}
    assert [got[i]["applied"] for i in range(1, 6)] == [True, False, False, False, False]
    assert np.allclose(got[1]["cleaned"], denoise.cleaned(np.array(noisy, np.float32), np.array(noise, np.float32)), atol=1e-6)
    assert got[2]["cleaned"] == pytest.approx(voice, abs=1e-6) and len(got[3]["cleaned"]) == len(noisy) and got[4]["cleaned"] is None and got[5]["cleaned"] == []
    assert got[1]["snr_db"] < 3 < got[2]["snr_db"] and all(not r["applied"] for r in denoise.denoised(df, "s", "n", mode="off").collect())


def test_what_is_too_large_comes_back_with_an_error(spark, tmp_path):
    from sottovoce.functions import audio

    (tmp_path / "a.wav").write_bytes(audio.encode_wav(np.zeros(1600, np.float32)))
    (tmp_path / "b.wav").write_bytes(b"x" * 10_000)
    got = {r["path"][-5:]: (r["samples"] is None, r["error"]) for r in wav.clips(spark, str(tmp_path), max_bytes=5000).collect()}
    assert got["a.wav"] == (False, None) and got["b.wav"][0] and "5000" in got["b.wav"][1]
    df = spark.createDataFrame([(1, "an api key"), (2, ""), (3, None), (4, "x" * 4001)], "id int, t string")
    said = {r["id"]: (r["verdict"] is None, r["error"]) for r in fusion.analyze(df, Policy.example(), "id", "t").collect()}
    assert said[1] == (False, None) and all(said[i][0] and "4000" in said[i][1] for i in (2, 3, 4))
