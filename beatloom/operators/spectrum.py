"""Spectra on even grids: monotone cubic resampling of intervals, Welch periodograms, signal-to-noise ratios."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beatloom.operators.conditioning import per_series
from beatloom.operators.hrv import band_power


def pchip(t: np.ndarray, v: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Monotone piecewise cubic Hermite interpolation (Fritsch and Carlson)."""
    h, d = np.diff(t), np.diff(v) / np.diff(t)
    m = np.zeros(len(t))
    if len(t) == 2:
        m[:] = d[0]
    else:
        w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
        same = d[:-1] * d[1:] > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            m[1:-1] = np.where(same, (w1 + w2) / (w1 / d[:-1] + w2 / d[1:]), 0.0)
        for end, h0, h1, d0, d1 in ((0, h[0], h[1], d[0], d[1]), (-1, h[-1], h[-2], d[-1], d[-2])):
            s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
            s = 0.0 if s * d0 <= 0 else s
            m[end] = 3 * d0 if d0 * d1 < 0 and abs(s) > 3 * abs(d0) else s
    k = np.clip(np.searchsorted(t, at, side="right") - 1, 0, len(t) - 2)
    u = (at - t[k]) / h[k]
    return (1 + 2 * u) * (1 - u) ** 2 * v[k] + u * (1 - u) ** 2 * h[k] * m[k] + u**2 * (3 - 2 * u) * v[k + 1] + u**2 * (u - 1) * h[k] * m[k + 1]


def welch(x: np.ndarray, fs: float, size: int) -> tuple[np.ndarray, np.ndarray]:
    """One-sided power density: Hann segments of ``size`` with half overlap, each with its line taken off, averaged."""
    size = min(size, len(x))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    step = max(1, size - size // 2)
    n = 1 + (len(x) - size) // step
    parts = np.lib.stride_tricks.sliding_window_view(x, size)[::step][:n]
    i = np.arange(size) - (size - 1) / 2
    parts = parts - parts.mean(axis=1, keepdims=True)
    parts = parts - np.outer(parts @ i / (i @ i), i)
    p = (np.abs(np.fft.rfft(parts * window, axis=1)) ** 2).mean(axis=0) / (fs * (window**2).sum())
    p[1 : None if size % 2 else -1] *= 2
    return np.fft.rfftfreq(size, 1 / fs), p


def interval_spectrum(df: DataFrame, keys: list[str], fs: float = 4.0, least: int = 20, span_s: float = 60.0) -> DataFrame:
    """Welch spectrum of each interval series resampled to ``fs``: ``keys``, ``f``, ``p`` (ms^2 / Hz).

    Series of fewer than ``least`` intervals, or shorter than ``span_s``, have none.
    """

    def work(a: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        t = np.cumsum(a["ibi_s"])
        if len(t) < least or t[-1] - t[0] < span_s:
            return {"f": np.zeros(0), "p": np.zeros(0)}
        grid = np.arange(t[0], t[-1], 1 / fs)
        x = pchip(t, a["ibi_s"] * 1000.0, grid)
        f, p = welch(x - x.mean(), fs, 480)
        return {"f": f, "p": p}

    return per_series(df, keys, "n", ["ibi_s"], work, [("f", T.DoubleType()), ("p", T.DoubleType())])


def interval_bands(df: DataFrame, keys: list[str]) -> DataFrame:
    return band_power(interval_spectrum(df, keys), keys)


def pulse_snr(signal: DataFrame, rates: DataFrame, keys: list[str]) -> DataFrame:
    """10 log10 of the power between 0.7 and 3.5 times the pulse rate over the rest; ``rates`` has ``keys``, ``rate`` (per minute)."""

    def work(a: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        if len(a["x"]) < 64:
            return {"snr_db": np.zeros(0)}
        f, p = welch(a["x"], float(a["fs"][0]), 2048)
        hz = float(a["rate"][0]) / 60
        band = (f > 0.7 * hz) & (f < 3.5 * hz)
        rest = p[~band].sum()
        return {"snr_db": np.array([10 * np.log10(p[band].sum() / rest)]) if rest > 0 and p[band].sum() > 0 else np.zeros(0)}

    known = signal.join(rates.select(*keys, F.col("rate").cast("double").alias("rate")).where("rate is not null"), keys)
    return per_series(known, keys, "i", ["fs", "x", "rate"], work, [("snr_db", T.DoubleType())])
