"""Correction of interval series: hard screen, moving median and MAD, and the adaptive-threshold beat classification."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beatloom.functions.numbers import ratio
from beatloom.operators.conditioning import per_series

# The intervals a heart can have (s), and the filter's width and limit.
SHORTEST, LONGEST = 0.30, 2.00
WIDE, LIMIT, EPS = 9, 5.0, 2.220446049250313e-16


def screen(df: DataFrame) -> DataFrame:
    """Strategy "none": intervals outside 0.30 to 2.00 s go."""
    return df.where(F.col("ibi_s").between(SHORTEST, LONGEST))


def median_mad(df: DataFrame, keys: list[str]) -> DataFrame:
    """Intervals within 5 x 1.4826 x MAD of the median of the nine around them, and inside the screen.

    Ends are continued by their own value; series of fewer than nine intervals are only screened. ``n`` numbers a series.
    """
    half = WIDE // 2
    w = Window.partitionBy(*keys)
    around = w.orderBy("n").rowsBetween(-half, half)
    own = df.withColumn("__many", F.count("*").over(w)).withColumn("__w", F.collect_list("ibi_s").over(around))
    first, last = F.min_by("ibi_s", "n").over(w), F.max_by("ibi_s", "n").over(w)
    own = own.withColumn("__first", first).withColumn("__last", last)
    before = F.array_repeat("__first", F.greatest(F.lit(0), half - F.col("n")).cast("int"))
    after = F.array_repeat("__last", F.greatest(F.lit(0), F.col("n") + half + 1 - F.col("__many")).cast("int"))
    own = own.withColumn("__w", F.concat(before, "__w", after))
    own = own.withColumn("__m", F.sort_array("__w")[half])
    away = F.sort_array(F.transform("__w", lambda v: F.abs(v - F.col("__m"))))[half]
    limit = F.lit(LIMIT * 1.4826) * F.when(away == 0, F.lit(EPS)).otherwise(away)
    keep = (F.col("__many") < WIDE) | (F.abs(F.col("ibi_s") - F.col("__m")) <= limit)
    return screen(own.where(keep)).drop("__many", "__w", "__m", "__first", "__last")


def _quartile_deviation(x: np.ndarray, half: int = 45) -> np.ndarray:
    """Half the distance of the quartiles of |x| in the 91 values around each one, ends shortened."""
    n = len(x)
    at = np.arange(n)
    padded = np.full(n + 2 * half, np.inf)
    padded[half : half + n] = np.abs(x)
    ordered = np.sort(np.lib.stride_tricks.sliding_window_view(padded, 2 * half + 1), axis=1)
    last = np.minimum(at + half, n - 1) - np.maximum(at - half, 0)

    def quartile(share: float) -> np.ndarray:
        place = last * share
        low = np.floor(place).astype(np.int64)
        a, b = ordered[at, low], ordered[at, np.minimum(low + 1, last)]
        return a + (b - a) * (place - low)

    return np.maximum((quartile(0.75) - quartile(0.25)) / 2, 1e-6)


def classify_beats(rr: np.ndarray) -> np.ndarray:
    """Class of each interval (ms): 0 normal, 1 ectopic, 2 long, 3 short, 4 missed beat, 5 extra beat.

    Differences of neighbours and distances from the median of 11, each over an adaptive threshold of 5.2 quartile
    deviations, are judged together (after Lipponen and Tarvainen 2019).
    """
    n = len(rr)
    kind = np.zeros(n, np.int64)
    if n < 6:
        return kind
    drr = np.r_[0.0, np.diff(rr)]
    drr[0] = drr[1:].mean()
    padded = np.pad(rr, 5, mode="reflect")
    med = np.median(np.lib.stride_tricks.sliding_window_view(padded, 11), axis=1)
    mrr = rr - med
    mrr = np.where(mrr < 0, 2 * mrr, mrr)
    d, m = drr / (5.2 * _quartile_deviation(drr)), mrr / (5.2 * _quartile_deviation(mrr))
    i = 1
    while i < n - 2:
        if abs(d[i]) <= 1:
            i += 1
            continue
        after = (max if d[i] > 0 else min)(d[i + 1], d[i + 2])
        s12 = min(d[i - 1], d[i + 1]) if d[i] < 0 else max(d[i - 1], d[i + 1])
        if (d[i] > 1 and s12 < -0.13 * d[i] - 0.17 and d[i + 1] < 0) or (d[i] < -1 and s12 > -0.13 * d[i] + 0.17 and d[i + 1] > 0):
            kind[i] = 1
            i += 1
            continue
        if not ((d[i] > 1 and after < -1) or (d[i] < -1 and after > 1) or abs(m[i]) > 3):
            i += 1
            continue
        j = i
        if d[i] < 0 and i + 1 < n and abs(rr[i] + rr[i + 1] - med[i]) < 0.2 * med[i]:
            kind[i] = 5
            i += 2
            continue
        if d[i] > 0 and abs(rr[i] / 2 - med[i]) < 0.2 * med[i]:
            kind[i] = 4
            i += 1
            continue
        kind[j] = 2 if d[i] > 0 else 3
        i += 1
    return kind


def correct_series(ibi: np.ndarray) -> tuple[np.ndarray, int]:
    """Corrected intervals (s) and how many were corrected: extra beats are joined, missed split, others interpolated."""
    rr = np.round(ibi * 1000.0)
    kind = classify_beats(rr)
    out: list[float] = []
    bad: list[bool] = []
    i = 0
    while i < len(rr):
        if kind[i] == 5 and i + 1 < len(rr):
            out.append(rr[i] + rr[i + 1])
            bad.append(False)
            i += 2
            continue
        if kind[i] == 4:
            out += [rr[i] / 2] * 2
            bad += [False] * 2
        else:
            out.append(rr[i])
            bad.append(kind[i] in (1, 2, 3))
        i += 1
    x, wrong = np.array(out), np.array(bad, bool)
    if wrong.any() and not wrong.all():
        at = np.arange(len(x))
        x[wrong] = np.interp(at[wrong], at[~wrong], x[~wrong])
    x = x / 1000.0
    inside = (x >= SHORTEST) & (x <= LONGEST)
    return x[inside], int((kind > 0).sum() + (~inside).sum())


def adaptive(df: DataFrame, keys: list[str]) -> DataFrame:
    """Strategy "adaptive": ``keys``, ``n``, ``ibi_s``, and the series' ``n_corrected``."""

    def work(a: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        x, many = correct_series(a["ibi_s"])
        return {"n": np.arange(len(x), dtype=np.int64), "ibi_s": x, "n_corrected": np.full(len(x), many, np.int64)}

    return per_series(df, keys, "n", ["ibi_s"], work, [("n", T.LongType()), ("ibi_s", T.DoubleType()), ("n_corrected", T.LongType())])


def fraction_corrected(n_corrected: Column, n_input: Column) -> Column:
    return ratio(n_corrected, n_input)


#: Correction by name; each takes a numbered series and its keys.
CORRECTIONS = {"none": lambda df, keys: screen(df), "median_mad": median_mad, "adaptive": adaptive}
