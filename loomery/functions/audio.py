"""Audio features: windows, spectrogram, mel filter bank, cepstrum."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cosine sums of the windows, by term; fixed values.
COSINES = {"none": (1.0,), "hann": (0.5, -0.5), "hamming": (0.54, -0.46), "blackman": (0.42, -0.5, 0.08)}


def window(kind: str, n: int) -> Column:
    """A window of n samples as an array column."""
    i = F.sequence(F.lit(0), F.lit(n - 1))
    if kind == "bartlett":
        return F.transform(i, lambda k: 1.0 - F.abs(2.0 * k - (n - 1)) / (n - 1))
    terms = COSINES[kind]
    turn = 2 * math.pi / (n - 1)
    return F.transform(i, lambda k: sum((c * F.cos(k * (turn * t)) for t, c in enumerate(terms) if t), F.lit(float(terms[0]))))


def window_array(kind: str, n: int) -> np.ndarray:
    k = np.arange(n)
    if kind == "bartlett":
        return 1 - np.abs(2 * k - (n - 1)) / (n - 1)
    return sum(c * np.cos(2 * np.pi * t * k / (n - 1)) for t, c in enumerate(COSINES[kind]))


def spectrogram(wave: np.ndarray, frame: int, stride: int, max_steps: int, win: np.ndarray | None = None) -> np.ndarray:
    """Magnitudes of the half spectrum of overlapping frames, one row per frame."""
    steps = min(max_steps, (len(wave) - frame) // stride + 1)
    frames = np.lib.stride_tricks.sliding_window_view(wave, frame)[: steps * stride : stride]
    return np.abs(np.fft.rfft(frames * (1 if win is None else win), axis=1))


def hz_to_mel(hz):
    return 2595 * np.log10(1 + hz / 700)


def mel_to_hz(mel):
    return 700 * (10 ** (mel / 2595) - 1)


def mel_edges(n: int, fft: int, rate: int) -> list[int]:
    """FFT bins at which the n triangles begin, peak and end: n + 2 of them, evenly spaced in mel."""
    top = 2595 * math.log10(1 + rate / 2 / 700)
    return [int(math.floor((fft + 1) * 700 * (10 ** (top * k / (n + 1) / 2595) - 1) / rate)) for k in range(n + 2)]


def filterbank(n: int, fft: int, rate: int) -> np.ndarray:
    """Triangular filters, one column each, over the bins of the half spectrum."""
    edges, out = mel_edges(n, fft, rate), np.zeros((fft // 2 + 1, n))
    for k, (lo, mid, hi) in enumerate(zip(edges, edges[1:], edges[2:])):
        out[lo:mid, k] = (np.arange(lo, mid) - lo) / max(1, mid - lo)
        out[mid:hi, k] = (hi - np.arange(mid, hi)) / max(1, hi - mid)
    return out


def cepstrogram(spec: np.ndarray, bank: np.ndarray) -> np.ndarray:
    """Log filter-bank energies."""
    power = spec**2 / ((spec.shape[1] - 1) * 2)
    return np.log(np.maximum(power @ bank, np.finfo("f4").tiny))


def mfcc(ceps: np.ndarray, n: int) -> np.ndarray:
    """The first n coefficients of the orthonormal cosine transform of each row."""
    size = ceps.shape[1]
    k, i = np.arange(n)[:, None], np.arange(size)
    basis = np.sqrt(2 / size) * np.cos(np.pi * k * (2 * i + 1) / (2 * size))
    basis[0] /= np.sqrt(2)
    return ceps @ basis.T
