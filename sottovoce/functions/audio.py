"""Audio as arrays of samples (S2-S5, E1, E2, E10, E14, E15): levels as expressions, decoding in Arrow functions."""

from __future__ import annotations

import io
import math
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

RATE, CHUNK, FLOOR_DB, MAX_SECONDS = 16_000, 512, -90.0, 60


def power(samples: Column) -> Column:
    total = F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return total / F.size(samples)


def rms_db(samples: Column) -> Column:
    """The level in dB, -90 at least and for no samples."""
    level = 20.0 * F.log10(F.sqrt(power(samples)) + 1e-12)
    return F.when(F.size(samples) > 0, F.greatest(level, F.lit(FLOOR_DB))).otherwise(FLOOR_DB)


def peak(samples: Column) -> Column:
    """E2."""
    return F.coalesce(F.array_max(F.transform(samples, lambda x: F.abs(x.cast("double")))), F.lit(0.0))


def snr_db(signal_power: Column, noise_power: Column) -> Column:
    """E14."""
    return 10.0 * F.log10(F.greatest(signal_power - noise_power, F.lit(1e-12)) / (noise_power + 1e-12))


def gate(mode: str, snr: Column, limit: float = 3.0) -> Column:
    """Whether a segment is denoised."""
    return {"off": F.lit(False), "on": F.lit(True), "auto": F.coalesce(snr < limit, F.lit(False))}[mode]


@F.arrow_udf(DoubleType())
def spectral_centroid(samples: pa.Array) -> pa.Array:
    """Mean frequency, weighted by magnitude under a Hann window; 0 for no samples. Rows of a length are transformed together."""
    rows = samples.fill_null(pa.scalar([], samples.type))
    lengths, starts = rows.value_lengths().to_numpy(), rows.offsets.to_numpy()[:-1]
    values, out = rows.values.to_numpy(zero_copy_only=False).astype(np.float64), np.zeros(len(rows))
    for n in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == n)
        mag = np.abs(np.fft.rfft(values[starts[at][:, None] + np.arange(n)] * np.hanning(n), axis=1))
        out[at] = (mag * np.fft.rfftfreq(n, 1 / RATE)).sum(1) / np.maximum(mag.sum(1), 1e-12)
    return pa.array(out)


def pcm16(data: bytes) -> np.ndarray:
    """Little-endian 16-bit samples to -1..1; an odd byte at the end is left out."""
    return np.frombuffer(data[: len(data) // 2 * 2], "<i2").astype(np.float32) / 32768


def resample(x: np.ndarray, rate: int, to: int = RATE) -> np.ndarray:
    """Band-limited resampling by up and down factors: a windowed-sinc filter, evaluated where samples are wanted."""
    if rate == to or not len(x):
        return x.astype(np.float32)
    g = math.gcd(rate, to)
    up, down = to // g, rate // g
    half = 10 * max(up, down)
    t = np.arange(-half, half + 1)
    cut = 1 / max(up, down)
    taps = up * cut * np.sinc(cut * t) * np.kaiser(len(t), 5.0)
    n = -(-len(x) * up // down)
    out = np.zeros(n, np.float64)
    at = np.arange(n) * down  # in upsampled places
    for k in range(-(-len(taps) // up)):
        source = (at + half) // up - k
        tap = at + half - source * up
        ok = (source >= 0) & (source < len(x)) & (tap >= 0) & (tap < len(taps))
        out[ok] += x[source[ok]] * taps[tap[ok]]
    return out.astype(np.float32)


def decode_wav(data: bytes) -> np.ndarray:
    """S3: PCM of 8, 16 or 32 bits, any rate and channels, to mono samples at 16 kHz; too long or broken clips raise."""
    with wave.open(io.BytesIO(data)) as w:
        rate, width, channels, n = w.getframerate(), w.getsampwidth(), w.getnchannels(), w.getnframes()
        if n / rate > MAX_SECONDS:
            raise ValueError("the clip is longer than a minute")
        raw = w.readframes(n)
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width in (2, 4):
        x = np.frombuffer(raw, f"<i{width}").astype(np.float32) / 2.0 ** (8 * width - 1)
    else:
        raise ValueError(f"{8 * width}-bit samples are not supported")
    return np.clip(resample(x.reshape(-1, channels).mean(1), rate), -1, 1)


def encode_wav(samples: np.ndarray) -> bytes:
    """16-bit mono at 16 kHz."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(RATE)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def decimate(x: np.ndarray, rate: int) -> np.ndarray:
    """Box filter to 16 kHz, as 16-bit integers."""
    edges = (np.arange(int(len(x) * RATE / rate) + 1) * rate / RATE).astype(int)
    means = np.clip([x[a : max(b, a + 1)].mean() for a, b in zip(edges[:-1], edges[1:], strict=True)], -1, 1)
    return np.where(means < 0, means * 0x8000, means * 0x7FFF).astype(np.int16)
