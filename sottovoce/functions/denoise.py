"""A stationary spectral gate (E15): what does not stand out from a session's noise, frequency by frequency, is turned down."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sottovoce.functions.audio import gate, power, snr_db

#: Samples of a frame and between frames; deviations that a sound must stand above the noise's mean level; frames and
#: frequencies over which the mask is evened out; what is taken off where nothing stands out.
FRAME, HOP, DEVIATIONS, FRAMES, BINS, DECREASE = 1024, 256, 1.5, 5, 9, 0.9
_WINDOW = np.hanning(FRAME + 1)[:-1]


def spectrum(samples: np.ndarray) -> np.ndarray:
    """Short-time Fourier transform: a row per frame; the clip is padded by a frame at either end, so every sample lies in as many frames."""
    padded = np.concatenate([np.zeros(FRAME), samples, np.zeros(FRAME + -len(samples) % HOP)])
    frames = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    return np.fft.rfft(frames * _WINDOW, axis=1)


def signal(spectra: np.ndarray, n: int) -> np.ndarray:
    """The n samples that spectrum() came from, by weighted overlap-add."""
    frames = np.fft.irfft(spectra, FRAME, axis=1) * _WINDOW
    out, weight = np.zeros((len(frames) - 1) * HOP + FRAME), np.zeros((len(frames) - 1) * HOP + FRAME)
    for k, frame in enumerate(frames):
        out[k * HOP : k * HOP + FRAME] += frame
        weight[k * HOP : k * HOP + FRAME] += _WINDOW**2
    return (out / np.maximum(weight, 1e-9))[FRAME : FRAME + n]


def profile(noise: np.ndarray) -> np.ndarray:
    """For each frequency the level (dB) that a sound must exceed."""
    inside = spectrum(noise)[FRAME // HOP : -(FRAME // HOP)]
    level = 20 * np.log10(np.abs(inside if len(inside) else spectrum(noise)) + 1e-12)
    return level.mean(0) + DEVIATIONS * level.std(0)


def _evened(mask: np.ndarray, size: int, axis: int) -> np.ndarray:
    """Means under a triangle of `size` places on either side, weighted less at the edges."""
    weights = 1 - np.abs(np.arange(1 - size, size)) / size
    total = np.zeros_like(mask)
    for w, shift in zip(weights, range(1 - size, size), strict=True):
        moved = np.roll(mask, shift, axis)
        edge = [slice(None)] * 2
        edge[axis] = slice(0, shift) if shift > 0 else slice(shift, None) if shift else slice(0, 0)
        moved[tuple(edge)] = 0
        total += w * moved
    return total / weights.sum()


def cleaned(samples: np.ndarray, noise: np.ndarray, decrease: float = DECREASE) -> np.ndarray:
    """samples with what lies below the noise's profile turned down by `decrease`."""
    spectra = spectrum(samples.astype(np.float64))
    stands = (20 * np.log10(np.abs(spectra) + 1e-12) > profile(noise.astype(np.float64))).astype(float)
    mask = _evened(_evened(stands, FRAMES, 0), BINS, 1)
    return signal(spectra * (mask * decrease + 1 - decrease), len(samples)).astype(np.float32)


def denoised(segments: DataFrame, samples: str, noise: str, mode: str = "auto", limit: float = 3.0, decrease: float = DECREASE, out: str = "cleaned") -> DataFrame:
    """segments with snr_db, applied, and `out`, the samples after the gate: those of a low signal-to-noise ratio, by the
    noise of their session (samples of chunks without speech, joined together before); the others as they are. Without
    noise or samples nothing is done."""
    @F.arrow_udf("array<float>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for clips, noises, wanted in batches:
            rows = []
            for k in range(len(clips)):
                clip = clips[k].values
                if clip is not None and wanted[k].as_py():
                    rows.append(cleaned(clip.to_numpy(zero_copy_only=False), noises[k].values.to_numpy(zero_copy_only=False), decrease))
                else:
                    rows.append(None if clip is None else clip.to_numpy(zero_copy_only=False))
            yield pa.array(rows, pa.list_(pa.float32()))

    there: Column = (F.coalesce(F.size(noise), F.lit(0)) > 0) & (F.coalesce(F.size(samples), F.lit(0)) > 0)
    rated = segments.withColumn("snr_db", F.when(there, snr_db(power(F.col(samples)), power(F.col(noise)))))
    rated = rated.withColumn("applied", there & gate(mode, F.col("snr_db"), limit))
    return rated.withColumn(out, run(F.col(samples).cast("array<float>"), F.when(F.col("applied"), F.col(noise).cast("array<float>")), F.col("applied")))
