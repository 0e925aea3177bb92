"""Signal conditioning: relational where the arithmetic allows, an Arrow block per group of series for recursive filters.

Signals are long tables: ``keys``, a dense sample number ``i`` from 0, ``x``, and ``fs``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beatloom.functions.numbers import ratio
from beatloom.operators.series import _whole_groups


def remove_mean(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumn("x", F.col("x") - F.avg("x").over(Window.partitionBy(*keys)))


def detrend(df: DataFrame, keys: list[str]) -> DataFrame:
    """The least-squares line of ``x`` on ``i`` taken off."""
    w = Window.partitionBy(*keys)
    i = F.col("i").cast("double")
    slope = F.coalesce(ratio(F.covar_pop("x", i).over(w), F.var_pop(i).over(w)), F.lit(0.0))
    return df.withColumn("x", F.col("x") - F.avg("x").over(w) - slope * (i - F.avg(i).over(w)))


def normalise(df: DataFrame, keys: list[str]) -> DataFrame:
    """z-score by the population SD; only centred where that is 0."""
    w = Window.partitionBy(*keys)
    centred, sd = F.col("x") - F.avg("x").over(w), F.stddev_pop("x").over(w)
    return df.withColumn("x", F.when(sd > 0, centred / sd).otherwise(centred))


def fir_taps(q: int) -> list[float]:
    """Hamming-windowed low-pass of 20 q + 1 taps with cut-off 1 / q and unit gain; taps from the middle outwards."""
    half = 10 * q
    n = np.arange(-half, half + 1)
    h = np.sinc(n / q) * (0.54 + 0.46 * np.cos(np.pi * n / half))
    h /= h.sum()
    return h[half:].tolist()


def decimate(df: DataFrame, keys: list[str], q: int) -> DataFrame:
    """Every ``q``-th sample of the zero-phase FIR-filtered signal: ``keys``, ``i``, ``x``.

    The mean is taken off first: beyond its ends the signal counts as 0, which next to a level would be a step. Each sample adds to the 21 outputs its tap reaches; sums are combined in the map tasks.
    """
    half = 10 * q
    taps = F.array(*map(F.lit, fir_taps(q)))
    last = F.floor((F.max("i").over(Window.partitionBy(*keys))) / q)
    lo, hi = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("i") - half) / q)), F.least(last, F.floor((F.col("i") + half) / q))
    reach = remove_mean(df, keys).select(*keys, "i", "x", lo.cast("long").alias("lo"), hi.cast("long").alias("hi")).where(F.col("lo") <= F.col("hi"))
    spread = reach.withColumn("j", F.explode(F.sequence("lo", "hi")))
    tap = F.element_at(taps, (F.abs(F.col("i") - F.col("j") * q) + 1).cast("int"))
    return spread.groupBy(*keys, F.col("j").alias("i")).agg(F.sum(F.col("x") * tap).alias("x"))


def kaiser_taps(up: int, down: int) -> list[float]:
    """Kaiser(5.0) low-pass for a resampling by ``up`` / ``down``, gain ``up``; taps from the middle outwards."""
    wide = max(up, down)
    half = 10 * wide
    n = np.arange(-half, half + 1)
    h = np.sinc(n / wide) * np.i0(5.0 * np.sqrt(np.maximum(0, 1 - (n / half) ** 2))) / np.i0(5.0)
    h = h / h.sum() * up
    return h[half:].tolist()


def resample(df: DataFrame, keys: list[str], up: int, down: int) -> DataFrame:
    """Polyphase resampling of the centred signal by ``up`` / ``down``: ``keys``, ``i`` (of the new rate), ``x``."""
    g = math.gcd(up, down)
    up, down = up // g, down // g
    half = 10 * max(up, down)
    taps = F.array(*map(F.lit, kaiser_taps(up, down)))
    last = F.ceil((F.max("i").over(Window.partitionBy(*keys)) + 1) * up / down) - 1
    lo, hi = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("i") * up - half) / down)), F.least(last, F.floor((F.col("i") * up + half) / down))
    reach = remove_mean(df, keys).select(*keys, "i", "x", lo.cast("long").alias("lo"), hi.cast("long").alias("hi")).where(F.col("lo") <= F.col("hi"))
    spread = reach.withColumn("j", F.explode(F.sequence("lo", "hi")))
    tap = F.element_at(taps, (F.abs(F.col("j") * down - F.col("i") * up) + 1).cast("int"))
    return spread.groupBy(*keys, F.col("j").alias("i")).agg(F.sum(F.col("x") * tap).alias("x"))


def to_rate(df: DataFrame, keys: list[str], rate: float, rates: list[float]) -> DataFrame:
    """Each series, of one of ``rates`` samples a second, at ``rate``: ``keys``, ``fs``, ``i``, ``x`` (centred).

    By a whole factor of 2 or more it is decimated, by another one resampled as the nearest fraction with a denominator
    of at most 1000. ``rates`` are what ``df`` holds, a handful of recorders' rates; series of other rates are left out.
    """
    out = None
    for fs in rates:
        own = df.where(F.col("fs") == fs)
        factor = fs / rate
        if abs(factor - 1) < 1e-8:
            one = remove_mean(own, keys).select(*keys, "i", "x")
        elif round(factor) >= 2 and abs(factor - round(factor)) < 1e-8:
            one = decimate(own, keys, round(factor))
        else:
            share = Fraction(rate / fs).limit_denominator(1000)
            one = resample(own, keys, share.numerator, share.denominator)
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = df.limit(0).select(*keys, "i", "x")
    return out.select(*keys, F.lit(float(rate)).alias("fs"), "i", "x")


def per_series(df: DataFrame, keys: list[str], order: str, values: list[str], work: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], out: list[tuple[str, T.DataType]]) -> DataFrame:
    """``work`` on each series in order, several to an Arrow block; it returns columns of any one length.

    A series is one session's; its length is bounded by the session, and sessions spread over the tasks.
    """
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField(n, t) for n, t in out])
    placed = df.select(*keys, order, *values).repartition(*keys).sortWithinPartitions(*keys, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in _whole_groups(batches, keys, 50_000):
            arrays = {c: t[c].to_numpy() for c in [order, *values]}
            stops = np.r_[starts[1:], t.num_rows]
            parts: list[dict[str, np.ndarray]] = []
            for a, b in zip(starts, stops):
                parts.append(work({c: v[a:b] for c, v in arrays.items()}))
            sizes = [len(p[out[0][0]]) for p in parts]
            source = np.repeat(starts, sizes)
            columns = [t[k].take(pa.array(source)).combine_chunks() for k in keys]
            columns += [pa.array(np.concatenate([p[n] for p in parts]) if parts else np.zeros(0)) for n, _ in out]
            if len(source):
                yield from pa.Table.from_arrays(columns, names=schema.names).to_batches()

    return placed.mapInArrow(run, schema)


def butterworth(order: int, low: float | None, high: float, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """Frequency response squared at zero phase is what the caller needs, so poles and gain of the digital filter suffice.

    Returns (zeros, poles) of a low-pass (``low`` None) or band-pass by the bilinear transform; the gain is set to 1 in
    the pass band by ``zero_phase``.
    """
    k = np.arange(order)
    proto = np.exp(1j * np.pi * (2 * k + order + 1) / (2 * order))
    warp = lambda f: 2 * fs * np.tan(np.pi * f / fs)
    if low is None:
        poles = proto * warp(high)
        zeros = -np.ones(order)
    else:
        band, centre = warp(high) - warp(low), np.sqrt(warp(low) * warp(high))
        half = proto * band / 2
        poles = np.r_[half + np.sqrt(half**2 - centre**2), half - np.sqrt(half**2 - centre**2)]
        zeros = np.r_[np.ones(order), -np.ones(order)]
    return zeros, (2 * fs + poles) / (2 * fs - poles)


def zero_phase(x: np.ndarray, fs: float, order: int, low: float | None, high: float) -> np.ndarray:
    """``x`` filtered forwards and backwards: its spectrum times the squared magnitude of the Butterworth response.

    The signal is continued at both ends by its point reflection, so a level at an end rings neither way.
    """
    n = len(x)
    high = min(high, 0.95 * fs / 2)
    pad = min(n - 1, int(8 * fs))
    if n < 4:
        return x - x.mean() if low is not None else x
    long = np.r_[2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]
    zeros, poles = butterworth(order, low, high, fs)
    f = np.fft.rfftfreq(len(long))
    z = np.exp(2j * np.pi * f)[:, None]
    response = np.abs(np.prod(z - zeros, axis=1) / np.prod(z - poles, axis=1))
    mid = 0.0 if low is None else np.arctan(np.sqrt(np.tan(np.pi * low / fs) * np.tan(np.pi * high / fs))) / np.pi
    zm = np.exp(2j * np.pi * mid)
    response /= np.abs(np.prod(zm - zeros) / np.prod(zm - poles))
    return np.fft.irfft(np.fft.rfft(long) * response**2, len(long))[pad : pad + n]


def band_pass(df: DataFrame, keys: list[str], order: int = 4, low: float | None = 0.5, high: float = 8.0) -> DataFrame:
    """Zero-phase Butterworth filter of each series: ``keys``, ``i``, ``fs``, ``x``."""
    work = lambda a: {"i": a["i"], "fs": a["fs"], "x": zero_phase(a["x"], float(a["fs"][0]), order, low, high)}
    return per_series(df, keys, "i", ["fs", "x"], work, [("i", T.LongType()), ("fs", T.DoubleType()), ("x", T.DoubleType())])


def prepare(df: DataFrame, keys: list[str], rate: float | None = None, rates: list[float] | None = None) -> DataFrame:
    """Centred, brought to ``rate`` where one is given (see to_rate), detrended, band-passed and normalised."""
    if rate is not None:
        df = to_rate(df, keys, rate, rates or [])
    return normalise(band_pass(detrend(df, keys), keys), keys)


def polarity(filtered: DataFrame, keys: list[str]) -> DataFrame:
    """+1 or -1 by the sign of the skewness of the first differences."""
    d = F.col("x") - F.lag("x").over(Window.partitionBy(*keys).orderBy("i"))
    return filtered.withColumn("d", d).groupBy(*keys).agg(F.when(F.coalesce(F.skewness("d"), F.lit(0.0)) >= 0, 1).otherwise(-1).alias("polarity"))


def motion_index(df: DataFrame, keys: list[str], axes: tuple[str, str, str], per_block: int, short: bool = True) -> DataFrame:
    """RMS of the rotation's norm about its median in blocks of ``per_block`` samples.

    Where no block is full, all samples are one block, or, without ``short``, there is none (the quality windows' form).
    """
    x, y, z = (F.col(a) for a in axes)
    size = df.select(*keys, "i", F.sqrt(x * x + y * y + z * z).alias("norm"))
    middle = size.groupBy(*keys).agg(F.median("norm").alias("mid"), F.count("*").alias("many"))
    moved = size.join(middle, keys).withColumn("m", F.col("norm") - F.col("mid"))
    whole_blocks = F.floor(F.col("many") / per_block)
    block: Column = F.when(whole_blocks == 0, F.lit(0).cast("long")).otherwise(F.floor(F.col("i") / per_block))
    inside = moved.withColumn("block", block).where(((whole_blocks == 0) & F.lit(short)) | (F.col("block") < whole_blocks))
    return inside.groupBy(*keys, "block").agg(F.sqrt(F.avg(F.col("m") * F.col("m"))).alias("rms"))


def clip_square(df: DataFrame) -> DataFrame:
    return df.withColumn("sq", F.pow(F.greatest("x", F.lit(0.0)), F.lit(2.0)))
