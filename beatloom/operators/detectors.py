"""Beat detectors: signal to sorted sample numbers of pulse peaks or onsets.

TERMA is relational (moving averages as window frames, blocks as islands). The others look back and forth along a
series in ways frames cannot say; each is a small numpy function on one session, or on one 6 s window of it, and Spark
spreads those over the cluster. ``signal`` has ``keys``, ``i``, ``x`` (prepared) and ``fs``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beatloom.operators.conditioning import clip_square, per_series, zero_phase

# Fixed values of the published detectors (seconds unless noted).
PEAK_S, BEAT_S, OFFSET, REFRACTORY_S = 0.111, 0.667, 0.02, 0.30
SLOPE_S, LEARN_S = 0.128, 10.0
WINDOW_S, OVERLAP_S, SHORTEST_TAIL_S, APART_S = 6.0, 1.0, 2.0, 0.25


def _frame_sum(keys: list[str], value: Column, before: Column) -> Column:
    """Sum of ``value`` over a sample and the ``before`` ones ahead of it (behind it if ``before`` is negative).

    The number may differ from row to row with the sampling rate, so samples are placed at multiples of a step that puts
    just that many of them into a frame of fixed width.
    """
    place = F.round(F.col("i") * 1_000_000 / (F.abs(before) + 0.5)).cast("long")
    w = Window.partitionBy(*keys).orderBy(place)
    return F.sum(value).over(w.rangeBetween(-1_000_000, 0))


def centred_mean(keys: list[str], value: str, seconds: float) -> Column:
    """Moving average over ``seconds`` at any rate, zeros beyond the ends; an even width has one sample more behind it."""
    w = F.greatest(F.lit(1), F.bround(F.col("fs") * seconds).cast("int"))
    behind, ahead = F.floor(w / 2), F.floor((w - 1) / 2)
    place = F.round(F.col("i") * 1_000_000 / (ahead + 0.5)).cast("long")
    after = F.sum(value).over(Window.partitionBy(*keys).orderBy(place).rangeBetween(0, 1_000_000))
    return (_frame_sum(keys, F.col(value), behind) + after - F.col(value)) / w


def slope_sums(signal: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``z``, the rises of the last 0.128 s summed, and ``seed``, the threshold that onsets start from.

    The seed is three times the mean of the first 10 s, or of what there is; a fifth of the greatest where that is 0.
    """
    order, whole = Window.partitionBy(*keys).orderBy("i"), Window.partitionBy(*keys)
    up = F.coalesce(F.greatest(F.col("x") - F.lag("x").over(order), F.lit(0.0)), F.lit(0.0))
    w = F.greatest(F.lit(1), F.bround(F.col("fs") * SLOPE_S).cast("int"))
    rises = signal.withColumn("up", up).withColumn("z", _frame_sum(keys, F.col("up"), w - 1))
    head = F.avg(F.when(F.col("i") < F.bround(F.col("fs") * LEARN_S), F.col("z"))).over(whole)
    return rises.withColumn("seed", F.when(head > 0, 3.0 * head).otherwise(0.2 * F.max("z").over(whole))).drop("up")


def terma_blocks(signal: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks in which the short moving average of the squared signal is over the long one: ``keys``, ``fs``, ``wide``, ``idx``, ``x``.

    ``idx`` is the first greatest sample of a block; blocks narrower than a peak, and series under 2 s, have none.
    """
    order, whole = Window.partitionBy(*keys).orderBy("i"), Window.partitionBy(*keys)
    sq = clip_square(signal).withColumn("many", F.count("*").over(whole)).where(F.col("many") >= F.floor(2 * F.col("fs")))
    ma = sq.withColumn("short", centred_mean(keys, "sq", PEAK_S)).withColumn("long", centred_mean(keys, "sq", BEAT_S)).withColumn("level", F.avg("sq").over(whole))
    on = ma.withColumn("on", F.round(F.col("short") - F.col("long") - OFFSET * F.col("level"), 9) > 0)
    edge = on.withColumn("edge", (F.col("on") != F.coalesce(F.lag("on").over(order), F.lit(False))).cast("int"))
    island = edge.withColumn("island", F.sum("edge").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("on")
    tops = island.groupBy(*keys, "fs", "island").agg(F.count("*").alias("wide"), F.max(F.struct("x", (-F.col("i")).alias("n"))).alias("m"))
    return tops.where(F.col("wide") >= F.bround(F.col("fs") * PEAK_S)).select(*keys, "fs", "wide", (-F.col("m.n")).alias("idx"), F.col("m.x").alias("x"))


def terma(signal: DataFrame, keys: list[str]) -> DataFrame:
    """Two moving averages of the squared signal; each block where the short one is over the long one holds a peak.

    Of peaks closer than the refractory time to the one kept before, the taller one stays.
    """
    peaks = terma_blocks(signal, keys).select(*keys, "fs", F.struct("idx", "x").alias("p"))
    lists = peaks.groupBy(*keys, "fs").agg(F.array_sort(F.collect_list("p")).alias("ps"))

    def step(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        close = (F.size(acc) > 0) & ((p["idx"] - F.get(acc, F.size(acc) - 1)["idx"]) < F.bround(F.col("fs") * REFRACTORY_S))
        kept = F.when(p["x"] > last["x"], F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(p))).otherwise(acc)
        return F.when(close, kept).otherwise(F.concat(acc, F.array(p)))

    none = F.filter("ps", lambda p: F.lit(False))
    return lists.select(*keys, F.explode(F.aggregate("ps", none, step)).alias("p")).select(*keys, F.col("p.idx").cast("long").alias("idx"))


def local_maxima(x: np.ndarray) -> np.ndarray:
    """Samples higher than both sides; of a plateau the middle one."""
    if len(x) < 3:
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    last = np.r_[first[1:] - 1, len(x) - 1]
    v = x[first]
    top = np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])) + 1
    return (first[top] + last[top]) // 2


def _spaced(at: np.ndarray, height: np.ndarray, distance: int) -> np.ndarray:
    """The tallest first; those closer than ``distance`` to a kept one go."""
    keep = np.ones(len(at), bool)
    for k in np.argsort(height, kind="stable")[::-1]:
        if keep[k]:
            keep &= (np.abs(at - at[k]) >= distance) | (np.arange(len(at)) == k)
    return at[keep]


def _prominent(x: np.ndarray, at: np.ndarray, least: float) -> np.ndarray:
    kept = []
    for p in at:
        higher = np.flatnonzero(x > x[p])
        k = int(np.searchsorted(higher, p))
        a = higher[k - 1] + 1 if k else 0
        b = higher[k] if k < len(higher) else len(x)
        if x[p] - max(x[a : p + 1].min(), x[p:b].min()) >= least:
            kept.append(p)
    return np.array(kept, np.int64)


def find_peaks(x: np.ndarray, fs: float) -> np.ndarray:
    """Maxima at least 0.3 s apart with a prominence of 0.3 SD."""
    at = local_maxima(x)
    return _prominent(x, _spaced(at, x[at], round(0.3 * fs)), 0.3 * x.std()) if len(at) else at


def slope_sum(x: np.ndarray, fs: float) -> np.ndarray:
    """Rises of the last 0.128 s summed."""
    up = np.r_[0.0, np.maximum(np.diff(x), 0.0)]
    total = np.cumsum(up)
    w = max(1, round(SLOPE_S * fs))
    return total - np.r_[np.zeros(w), total[:-w]][: len(total)]


def _foot(z: np.ndarray, top: int, back: int) -> int:
    """The last place before ``top``, at most ``back`` samples, where the slope sum is a hundredth of its greatest there."""
    start = max(0, top - back)
    low = np.flatnonzero(z[start : top + 1] <= 0.01 * z[start : top + 1].max())
    return start + int(low[-1]) if len(low) else start


def qppg(x: np.ndarray, fs: float) -> np.ndarray:
    """Onsets where the slope sum crosses an adaptive threshold upwards.

    The onset is the foot of the rise that peaks within 0.15 s of the crossing. Where the pause between two onsets is
    over 1.5 times the median of the last eight intervals, the greatest slope sum inside it gives one more onset if it
    exceeds half the threshold.
    """
    if len(x) < int(2 * fs):
        return np.zeros(0, np.int64)
    z = slope_sum(zero_phase(x, fs, 2, None, 16.0) if 16.0 < 0.95 * fs / 2 else x, fs)
    n, eye, ahead = len(z), round(0.30 * fs), round(0.15 * fs)
    head = z[: round(LEARN_S * fs)].mean()
    level = 3 * head if head > 0 else 0.2 * z.max()
    if level <= 0:
        return np.zeros(0, np.int64)
    onsets: list[int] = []
    pauses: list[int] = []
    rising = np.flatnonzero(z[1:] > z[:-1]) + 1
    i = 1
    while True:
        k = np.searchsorted(rising, i)
        crossing = rising[k:][(z[rising[k:]] > level) & (z[rising[k:] - 1] <= level)][:1]
        if not len(crossing):
            break
        i = int(crossing[0])
        top = i + int(np.argmax(z[i : i + ahead]))
        onset = _foot(z, top, eye)
        if onsets and (onset <= onsets[-1] or i - onsets[-1] < eye):
            i += 1
            continue
        before = onsets[-1] if onsets else None
        onsets.append(onset)
        level = 0.8 * level + 0.2 * 0.6 * z[top]
        if before is not None:
            pauses.append(onset - before)
            a, b = before + eye, onset - eye
            if len(pauses) >= 3 and onset - before > 1.5 * np.median(pauses[-8:]) and b > a and z[a:b].max() > 0.5 * level:
                found = _foot(z, a + int(np.argmax(z[a:b])), eye)
                if before < found < onset:
                    onsets.insert(-1, found)
        i = max(i + 1, onset + eye)
    return np.unique(np.array(onsets, np.int64)) if onsets else np.zeros(0, np.int64)


def msptd_window(x: np.ndarray, scales: int | None = None) -> np.ndarray:
    """Multi-scale peaks of one window: maxima at every scale up to the one at which most samples are maxima."""
    n = len(x)
    most = -(-n // 2) - 1
    if n < 4 or most < 1:
        return np.zeros(0, np.int64)
    i = np.arange(n)
    x = x - np.polyval(np.polyfit(i, x, 1), i)
    most = min(most, scales or most)
    higher = np.zeros((most, n), bool)
    for k in range(1, most):
        j = slice(k + 1, n - k)
        higher[k - 1, j] = (x[j] > x[1 : n - 2 * k]) & (x[j] > x[2 * k + 1 : n])
    best = int(np.argmax(higher.sum(axis=1)))
    return np.flatnonzero(higher[: best + 1].all(axis=0))


def by_windows(find: Callable[[np.ndarray], np.ndarray], x: np.ndarray, fs: float) -> np.ndarray:
    """``find`` on 6 s windows with 1 s overlap; half the overlap is left to the window before; 0.25 s apart, first kept."""
    n, size, step, tail = len(x), round(WINDOW_S * fs), round((WINDOW_S - OVERLAP_S) * fs), round(SHORTEST_TAIL_S * fs)
    skip, found = round(OVERLAP_S * fs / 2), []
    for a in range(0, max(n, 1), step):
        part = x[a : a + size]
        if len(part) < tail:
            break
        at = find(part)
        found.append(at[(at >= skip) | (a == 0)] + a)
    at = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    kept: list[int] = []
    for p in at:
        if not kept or p - kept[-1] >= APART_S * fs:
            kept.append(int(p))
    return np.array(kept, np.int64)


def msptd(x: np.ndarray, fs: float) -> np.ndarray:
    return by_windows(msptd_window, x, fs)


def msptd_fast(x: np.ndarray, fs: float) -> np.ndarray:
    """The same on a 20 Hz copy with scales for over 30 beats a minute; peaks are then moved to the maximum nearby."""
    q = max(1, int(fs // 20))
    low = x[: len(x) // q * q].reshape(-1, q).mean(axis=1)
    rough = by_windows(lambda part: msptd_window(part, scales=int(fs / q)), low, fs / q) * q + q // 2
    reach = max(1, round(0.1 * fs))
    return np.unique([max(0, p - reach) + int(np.argmax(x[max(0, p - reach) : p + reach + 1])) for p in rough if p < len(x)]).astype(np.int64)


def moving_average_peaks(x: np.ndarray, fs: float) -> np.ndarray:
    """Maxima of stretches above a 0.75 s moving average raised by the share that makes intervals most even; odd ones go."""
    w = max(1, round(0.75 * fs))
    base = np.convolve(np.pad(x, (w // 2, w - 1 - w // 2), mode="edge"), np.ones(w) / w, "valid")
    best: tuple[float, np.ndarray] = (np.inf, np.zeros(0, np.int64))
    for share in (5, 10, 15, 20, 25, 30, 40, 50, 60, 70, 80, 90, 100, 120, 150):
        on = x > base + share / 100 * np.abs(x).mean()
        edge = np.flatnonzero(np.diff(np.r_[False, on, False].astype(np.int8)))
        at = np.array([a + int(np.argmax(x[a:b])) for a, b in zip(edge[::2], edge[1::2])], np.int64)
        if len(at) < 3:
            continue
        rr = np.diff(at) / fs
        rate = 60 / rr.mean()
        if rr.std() > 0.01 and 40 <= rate <= 180 and rr.std() < best[0]:
            best = (float(rr.std()), at)
    at = best[1]
    if len(at) > 2:
        rr = np.diff(at)
        middle = rr.mean()
        odd = np.r_[False, (rr < middle - max(0.3 * middle, 0.3 * fs)) | (rr > middle + max(0.3 * middle, 0.3 * fs))]
        at = at[~odd]
    return at


#: Key to (label, kind of anchor, function on one session's samples); TERMA is relational.
REGISTRY: dict[str, tuple[str, str, Callable[[np.ndarray, float], np.ndarray] | None]] = {
    "findpeaks": ("find_peaks baseline", "peak", find_peaks),
    "terma": ("TERMA", "peak", None),
    "qppg": ("qppg (slope-sum)", "onset", qppg),
    "msptd": ("MSPTD", "peak", msptd),
    "msptdfast": ("MSPTDfast v2", "peak", msptd_fast),
    "heartpy": ("HeartPy", "peak", moving_average_peaks),
}


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, v[0], v[1]) for k, v in REGISTRY.items()], "detector string, detector_label string, anchor string")


def detect(signal: DataFrame, keys: list[str], names: list[str] | None = None) -> DataFrame:
    """Anchors of several detectors: ``keys``, ``detector``, ``idx``. The signal is read once for all numpy detectors."""
    names = names or list(REGISTRY)
    order = list(REGISTRY)
    plain = [n for n in names if REGISTRY[n][2] is not None]

    def work(a: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        found = [REGISTRY[n][2](a["x"], float(a["fs"][0])) for n in plain]
        return {"which": np.repeat([order.index(n) for n in plain], [len(f) for f in found]).astype(np.int64), "idx": np.concatenate(found).astype(np.int64)}

    parts = []
    if plain:
        numbered = per_series(signal, keys, "i", ["fs", "x"], work, [("which", T.LongType()), ("idx", T.LongType())])
        key_of = F.array(*map(F.lit, order))
        parts.append(numbered.select(*keys, key_of[F.col("which").cast("int")].alias("detector"), "idx"))
    if "terma" in names:
        parts.append(terma(signal, keys).select(*keys, F.lit("terma").alias("detector"), "idx"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
