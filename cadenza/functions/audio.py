"""Signal functions over sample arrays (numpy), for ``mapInArrow`` folds."""

from __future__ import annotations

import math

import numpy as np


def resample(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear resampling from one rate to another."""
    n = int(len(x) * to / rate)
    return np.interp(np.arange(n) * rate / to, np.arange(len(x)), x) if len(x) and n else np.zeros(0)


def high_pass(x: np.ndarray, rate: float = 24_000, cutoff: float = 80) -> np.ndarray:
    """One-pole filter against rumble; the first sample stays."""
    rc = 1 / (2 * math.pi * cutoff)
    a, out = rc / (rc + 1 / rate), np.array(x, float)
    y = 0.0
    for i in range(1, len(out)):
        y = a * (y + x[i] - x[i - 1])
        out[i] = y
    return out


def low_pass(x: np.ndarray, rate: float = 24_000, cutoff: float = 10_000) -> np.ndarray:
    """One-pole smoothing; the first sample stays."""
    dt = 1 / rate
    a, out = dt / (1 / (2 * math.pi * cutoff) + dt), np.array(x, float)
    for i in range(1, len(out)):
        out[i] = a * x[i] + (1 - a) * out[i - 1]
    return out


def shelf(cutoff: float, rate: int, gain: float, q: float = 0.707) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (numerator, denominator) of a high shelf of ``gain`` dB, by the bilinear transform of the analogue prototype."""
    a, w = 10 ** (gain / 40), 2 * math.pi * cutoff / rate
    c, slope = math.cos(w), math.sqrt(a) * math.sin(w) / q
    top = np.array([a + 1 + (a - 1) * c + slope, -2 * (a - 1 + (a + 1) * c), a + 1 + (a - 1) * c - slope]) * a
    low = np.array([a + 1 - (a - 1) * c + slope, 2 * (a - 1 - (a + 1) * c), a + 1 - (a - 1) * c - slope])
    return top / low[0], low / low[0]


def de_ess(x: np.ndarray, rate: int = 24_000, cutoff: float = 6000.0, gain: float = -3.0) -> np.ndarray:
    """Sibilants softened: what lies above ``cutoff`` is lowered by ``gain`` dB; two samples or fewer stay as they are."""
    x = np.array(x, float)
    if len(x) <= 2:
        return x
    top, low = shelf(cutoff, rate, gain)
    fed = np.convolve(x, top)[: len(x)]  # the part without feedback at once
    out = np.zeros(len(x) + 2)
    for i in range(len(x)):
        out[i + 2] = fed[i] - low[1] * out[i + 1] - low[2] * out[i]
    return out[2:]


def mel_filters(bands: int, fft: int, rate: int) -> np.ndarray:
    """Triangles on the mel scale (linear below 1 kHz, logarithmic above), of like area."""
    def mel(f):
        return np.where(f < 1000, f * 3 / 200, 15 + np.log(np.maximum(f, 1e-9) / 1000) * 27 / math.log(6.4))

    def hertz(m):
        return np.where(m < 15, m * 200 / 3, 1000 * np.exp((m - 15) * math.log(6.4) / 27))

    edge = hertz(np.linspace(0.0, float(mel(np.array(rate / 2.0))), bands + 2))
    f = np.linspace(0, rate / 2, fft // 2 + 1)
    up = (f[None] - edge[:-2, None]) / (edge[1:-1] - edge[:-2])[:, None]
    down = (edge[2:, None] - f[None]) / (edge[2:] - edge[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edge[2:] - edge[:-2]))[:, None]


def mel_spectrogram(x: np.ndarray, rate: int = 16_000, bands: int = 128, fft: int = 512, window: int = 400, hop: int = 160, emphasis: float = 0.97) -> np.ndarray:
    """Log mel energies, one row a frame: pre-emphasis, centred Hann windows, power spectrum, floor of 2 ** -24."""
    if not len(x):
        return np.zeros((0, bands))
    x = np.asarray(x, float)
    y = np.concatenate([np.zeros(fft // 2), x - emphasis * np.concatenate([[0.0], x[:-1]]), np.zeros(fft // 2)])
    n, off = 1 + (len(y) - fft) // hop, (fft - window) // 2
    frames = np.zeros((n, fft))
    frames[:, off : off + window] = np.lib.stride_tricks.sliding_window_view(y[off:], window)[::hop][:n] * np.hanning(window)
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    return np.log(power @ mel_filters(bands, fft, rate).T + 2.0**-24)
