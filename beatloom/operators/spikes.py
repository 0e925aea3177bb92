"""Implausible readings: Hampel filter, stuck values, physical bounds, and beats off the rhythm.

Every function judges a reading by its own series. Null and NaN readings are never faulty and take no part; a reading
that was sent twice counts once; a series of equal values only has no stuck runs; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatloom.operators.series import dense, exact_quantiles, map_series
from beatloom.session import written


@dataclass(frozen=True)
class LevelRule:
    """How a level series (intervals, samples) is judged.

    low, high: a reading at or beyond ``low``/``high`` is impossible if ``closed``, else only beyond them.
    half: readings on each side in the rolling median.
    limit: a reading is a spike if it departs from the rolling median by more than ``limit`` times the scatter.
    scatter: 1.4826 x a median absolute deviation of the series: with "residual" that of the readings from their rolling
    median; with "step" that of the first differences from none, for pulsating signals sampled many times a pulse, of
    which most lie on flanks and so on their rolling median.
    stuck: length from which a run of equal readings is faulty.
    floor: least scatter, for nearly constant series.
    """

    low: float
    high: float
    closed: bool
    half: int
    limit: float
    scatter: str
    stuck: int
    floor: float


INTERVALS = LevelRule(low=0.30, high=2.00, closed=False, half=8, limit=6.5, scatter="residual", stuck=10, floor=0.001)
SAMPLES = LevelRule(low=0.0, high=262143.0, closed=True, half=3, limit=18.0, scatter="step", stuck=25, floor=0.5)


def _runs(x: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Length of the run of equal values that each element is in."""
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (group[1:] != group[:-1])
    at = np.flatnonzero(new)
    return np.repeat(np.diff(np.r_[at, len(x)]), np.diff(np.r_[at, len(x)]))


def _by_group(values: np.ndarray, group: np.ndarray, shares: list[float]) -> list[np.ndarray]:
    """For each element the quantiles of its group (groups are contiguous)."""
    at = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    n = np.diff(np.r_[at, len(values)])
    ordered = values[np.lexsort((values, group))]
    found = []
    for share in shares:
        place = (n - 1) * share
        lo = np.floor(place).astype(np.int64)
        hi = np.minimum(lo + 1, n - 1)
        q = ordered[at + lo] + (ordered[at + hi] - ordered[at + lo]) * (place - lo)
        found.append(np.repeat(q, n))
    return found


def rolling_median(x: np.ndarray, group: np.ndarray, half: int) -> np.ndarray:
    """Median of up to ``2 * half + 1`` readings around each one, inside its group."""
    n = len(x)
    window = np.full((n, 2 * half + 1), np.inf)
    count = np.zeros(n, np.int64)
    for k in range(-half, half + 1):
        a, b = max(0, -k), n - max(0, k)
        if b <= a:
            continue
        same = group[a + k : b + k] == group[a:b]
        window[a:b, k + half][same] = x[a + k : b + k][same]
        count[a:b] += same
    window.sort(axis=1)
    rows = np.arange(n)
    return (window[rows, (count - 1) // 2] + window[rows, count // 2]) / 2


def steps(x: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Distance of each reading from the one before it in its group; NaN for the first."""
    out = np.full(len(x), np.nan)
    out[1:] = np.where(group[1:] == group[:-1], np.abs(np.diff(x)), np.nan)
    return out


def impossible_or_stuck(x: np.ndarray, group: np.ndarray, rule: LevelRule, varies: np.ndarray) -> np.ndarray:
    impossible = ((x <= rule.low) | (x >= rule.high)) if rule.closed else ((x < rule.low) | (x > rule.high))
    return impossible | ((_runs(x, group) >= rule.stuck) & varies)


def _varies(x: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Whether each reading's group has different values."""
    at = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    return np.repeat(np.minimum.reduceat(x, at) < np.maximum.reduceat(x, at), np.diff(np.r_[at, len(x)]))


def judge_level(x: np.ndarray, group: np.ndarray, rule: LevelRule) -> np.ndarray:
    """Mask of the faulty readings of whole level series that stand one after the other."""
    out = np.zeros(len(x), bool)
    real = np.flatnonzero(~np.isnan(x))
    if not len(real):
        return out
    x, group = x[real], group[real]
    bad = impossible_or_stuck(x, group, rule, _varies(x, group))
    good = np.flatnonzero(~bad)
    if len(good):
        y, g = x[good], group[good]
        away = np.abs(y - rolling_median(y, g, rule.half))
        spread = away if rule.scatter == "residual" else steps(y, g)
        known = np.flatnonzero(~np.isnan(spread))
        scale = np.zeros(len(y))
        if len(known):
            at = np.flatnonzero(np.r_[True, g[known][1:] != g[known][:-1]])
            middle = np.full(int(g[-1]) + 1, 0.0)
            middle[g[known][at]] = _by_group(spread[known], g[known], [0.5])[0][at]
            scale = 1.4826 * middle[g]
        bad[good] = away > rule.limit * np.maximum(scale, rule.floor)
    out[real] = bad
    return out


@dataclass(frozen=True)
class RhythmRule:
    """How beat times are judged: see judge_rhythm.

    stuck: length from which a run of equal times is faulty.
    half: intervals on each side in the rolling median and the rolling median absolute deviation.
    limit, band: an interval is suspect if it departs from the rolling median by more than ``limit`` times the scatter
    or by more than the share ``band`` of it; ``band`` is also how far off the rhythm a kept step may be.
    context: beats on each side of a suspect stretch that are looked at with it.
    reach: kept beats follow each other with fewer than this many left out between them.
    longest_gap_s: a later beat is no beat of the session (a recording's pause is shorter).
    drop, broken, gap, skipped: prices of leaving a beat out, of a step off the rhythm, of a stretch without beats, and
    of a step over missed beats.
    """

    stuck: int = 3
    half: int = 5
    limit: float = 3.0
    band: float = 0.2
    context: int = 14
    longest_gap_s: float = 600.0
    reach: int = 12
    drop: float = 1.0
    broken: float = 4.0
    gap: float = 0.7
    skipped: float = 0.3


RHYTHM = RhythmRule()


def local_interval(t: np.ndarray, group: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each beat the interval to the one before it, and the rolling median and scatter of the intervals there.

    A beat without a usable interval (0.2 to 3 s) takes both from the beat before it, else from the one after it.
    """
    step = np.r_[np.nan, np.diff(t)]
    new = np.r_[True, group[1:] != group[:-1]]
    step[new] = np.nan
    usable = np.flatnonzero((step > 0.2) & (step < 3.0))
    local, scatter = np.full(len(t), np.nan), np.full(len(t), np.nan)
    if len(usable):
        local[usable] = rolling_median(step[usable], group[usable], half)
        scatter[usable] = 1.4826 * rolling_median(np.abs(step[usable] - local[usable]), group[usable], half)
    number = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    ends = np.r_[at[1:], len(t)]
    has = ~np.isnan(local)
    before = np.maximum.accumulate(np.where(has, np.arange(len(t)), -1))
    before = np.where(before >= at[number], before, -1)
    after = np.minimum.accumulate(np.where(has, np.arange(len(t)), len(t))[::-1])[::-1]
    after = np.where(after < ends[number], after, -1)
    source = np.where(before >= 0, before, after)
    known = np.maximum(source, 0)
    return step, np.where(source >= 0, local[known], 0.8), np.where(source >= 0, scatter[known], 0.0)


def suspect_beats(t: np.ndarray, group: np.ndarray, rule: RhythmRule = RHYTHM) -> tuple[np.ndarray, np.ndarray]:
    """Hampel filter on the intervals: mask of the beats at either end of an interval that departs, and the local interval."""
    step, local, scatter = local_interval(t, group, rule.half)
    first = np.isnan(step)
    away = np.abs(step - local)
    odd = ~first & ((step <= 0.2) | (step >= 3.0) | (away > rule.limit * np.maximum(scatter, 0.004)) | (away > rule.band * local))
    return odd | np.r_[odd[1:], False], local


def judge_rhythm(t: np.ndarray, group: np.ndarray, rule: RhythmRule = RHYTHM, varies: np.ndarray | None = None) -> np.ndarray:
    """Mask of the faulty beat times.

    Negative times and runs of equal times are faulty. Of the others, a Hampel filter on the intervals (rolling median
    and rolling median absolute deviation) finds the suspect stretches. An interval departs at both of its ends, so in
    each stretch the cheapest chain of beats that keeps the rhythm tells which of them has left it: leaving a beat out
    costs ``drop``; a step to the next kept beat costs little if it is within ``band`` of the local interval or of a
    whole number of them, ``gap`` if it is a longer stretch without beats, and ``broken`` otherwise (also a step back in
    time or beyond ``longest_gap_s``). Suspect beats outside the chain are faulty.
    """
    out = np.zeros(len(t), bool)
    real = np.flatnonzero(~np.isnan(t))
    if not len(real):
        return out
    t, group = t[real], group[real]
    varies = varies[real] if varies is not None else _varies(t, group)
    bad = (t < 0) | ((_runs(t, group) >= rule.stuck) & varies)
    good = np.flatnonzero(~bad)
    if len(good):
        t, group = t[good], group[good]
        suspect, local = suspect_beats(t, group, rule)
        near = suspect.copy()
        for k in range(1, rule.context + 1):
            near[k:] |= suspect[:-k] & (group[k:] == group[:-k])
            near[:-k] |= suspect[k:] & (group[:-k] == group[k:])
        at = np.flatnonzero(near)
        if len(at):
            stretch = np.cumsum(np.r_[True, (np.diff(at) > 1) | (group[at][1:] != group[at][:-1])])
            bad[good[at]] = _off_chain(t[at], local[at], stretch, rule) & suspect[at]
    out[real] = bad
    return out


def _off_chain(t: np.ndarray, local: np.ndarray, group: np.ndarray, rule: RhythmRule) -> np.ndarray:
    """Mask of the beats outside the cheapest chain of their group; groups of like size are laid side by side."""
    head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[head, len(t)])
    out = np.zeros(len(t), bool)
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        least = int(sizes[order[at]])
        stop = int(np.searchsorted(sizes[order], max(least + 4, least * 5 // 4), side="right"))
        stop = max(at + 1, min(stop, at + 2_000_000 // (2 * least)))
        some = order[at:stop]
        n = sizes[some]
        rows = np.repeat(np.arange(len(some)), n)
        column = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        place = np.repeat(head[some], n) + column
        grid_t, grid_m = np.full((len(some), int(n.max())), np.nan), np.full((len(some), int(n.max())), 0.8)
        grid_t[rows, column] = t[place]
        grid_m[rows, column] = local[place]
        out[place] = ~_chains(grid_t, grid_m, n, rule)[rows, column]
        at = stop
    return out


def _chains(grid_t: np.ndarray, grid_m: np.ndarray, sizes: np.ndarray, rule: RhythmRule) -> np.ndarray:
    """Which beats of each row (``sizes`` of them) are in its cheapest chain."""
    many, wide = grid_t.shape
    cost = np.full((many, wide), np.inf)
    back = np.full((many, wide), -1, np.int32)
    for j in range(wide):
        best = np.full(many, float(j) * rule.drop)  # all beats before this one are left out
        link = np.full(many, -1, np.int32)
        m = grid_m[:, j]
        for i in range(max(0, j - rule.reach), j):
            gap_s = grid_t[:, j] - grid_t[:, i]
            r = gap_s / m
            whole = np.maximum(np.rint(r), 1.0)
            off = np.abs(r - whole)
            price = np.where(off <= rule.band * np.minimum(whole, 2.0) ** 0.5, np.where(whole == 1, off, rule.skipped), np.where(r > 1.6, rule.gap, rule.broken))
            price = np.where((gap_s <= 0) | (gap_s > rule.longest_gap_s), rule.broken, price)
            total = cost[:, i] + price + (j - i - 1) * rule.drop
            better = total < best
            best = np.where(better, total, best)
            link = np.where(better, np.int32(i), link)
        here = j < sizes
        cost[here, j] = best[here]
        back[here, j] = link[here]
    # The chain may end before the last beat; the beats after its end are left out too.
    left = (sizes[:, None] - 1 - np.arange(wide)[None, :]) * rule.drop
    final = np.where(left >= 0, cost + left, np.inf)
    place = np.argmin(final, axis=1)
    kept = np.zeros((many, wide), bool)
    rows = np.arange(many)
    while len(rows):
        kept[rows, place] = True
        place = back[rows, place]
        rows, place = rows[place >= 0], place[place >= 0]
    return kept


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & a[k].eqNullSafe(b[f"__{k}"])
    return on


def _by_length(slim: DataFrame, keys: list[str], order: str, value: str, length: int) -> tuple[DataFrame, DataFrame | None]:
    """The series that lie in one chunk, and the rows of the longer ones (None if there are none), each place once.

    A longer series' rows come with ``__varies`` (1 or 0), which tells of the whole series.
    """
    ends = slim.where(F.col(order).isNotNull()).groupBy(*keys).agg(F.min(order).alias("__a"), F.max(order).alias("__b"), (F.min(value) < F.max(value)).cast("double").alias("__varies"))
    long = ends.where(F.floor(F.col("__a") / length) < F.floor(F.col("__b") / length)).select(*[F.col(k).alias(f"__{k}") for k in keys], "__varies")
    long = written(long, "long-series")
    if long.isEmpty():
        return slim, None
    on = _same(slim, long, keys)
    rows = slim.where(F.col(order).isNotNull()).join(long, on).groupBy(*[slim[k] for k in keys], slim[order]).agg(F.min(slim[value]).alias(value), F.first("__varies").alias("__varies"))
    return slim.join(long, on, "left_anti"), rows


def faulty_levels(df: DataFrame, keys: list[str], order: str, value: str, rule: LevelRule, length: int = 50_000) -> DataFrame:
    """``keys`` and ``order`` of the readings of ``value`` that ``rule`` finds faulty, each once.

    A series that does not lie in one stretch of ``length`` places is judged in chunks with margins: impossible and
    stuck readings first, then, over the readings that are left, numbered anew, the rolling median; its scatter is taken
    over the whole series. So the result is the same for every ``length``.
    """
    slim = df.select(*keys, F.col(order).cast("long").alias(order), F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull() & ~F.isnan(value))
    short, long = _by_length(slim, keys, order, value, length)
    margin = max(rule.stuck, 2 * rule.half + 2)
    found = map_series(short, keys, order, [value], lambda a, g: judge_level(a[value], g, rule), length, 0)
    if long is None:
        return found
    first = lambda a, g: {"__bad": impossible_or_stuck(a[value], g, rule, a["__varies"] > 0).astype(float)}
    judged = written(map_series(dense(long, keys, order, "__n", length), keys, "__n", [value, "__varies"], first, length, margin, keep=[order, value], extra=["__bad"]), "judged")
    second = lambda a, g: {"__away": np.abs(a[value] - rolling_median(a[value], g, rule.half)), "__step": steps(a[value], g)}
    good = dense(judged.where("__bad = 0").drop("__n"), keys, order, "__n", length)
    looked = written(map_series(good, keys, "__n", [value], second, length, margin, keep=[order], extra=["__away", "__step"]), "departures")
    middle = exact_quantiles(looked, keys, "__away" if rule.scatter == "residual" else "__step", [0.5])
    scale = middle.select(*[F.col(k).alias(f"__{k}") for k in keys], (1.4826 * F.col("quantiles")[0]).alias("__scale"))
    spikes = looked.join(scale, _same(looked, scale, keys), "left").where(F.col("__away") > rule.limit * F.greatest("__scale", F.lit(rule.floor)))
    return found.unionByName(judged.where("__bad = 1").select(*keys, order)).unionByName(spikes.select(*[looked[c] for c in (*keys, order)]))


def faulty_beats(df: DataFrame, keys: list[str], order: str, time: str, rule: RhythmRule = RHYTHM, length: int = 4_096) -> DataFrame:
    """``keys`` and ``order`` of the beat times that leave the rhythm of their series, each once; rows without ``order`` are marks.

    A longer series is judged in chunks of ``length`` beats with a margin: a beat's verdict needs the beats around it.
    """
    slim = df.select(*keys, F.col(order).cast("long").alias(order), F.col(time).cast("double").alias(time)).where(F.col(time).isNotNull() & ~F.isnan(time))
    short, long = _by_length(slim, keys, order, time, length)
    found = map_series(short, keys, order, [time], lambda a, g: judge_rhythm(a[time], g, rule), length, 0, rows=60_000)
    if long is None:
        return found
    judge = lambda a, g: judge_rhythm(a[time], g, rule, a["__varies"] > 0)
    parts = map_series(dense(long, keys, order, "__n", length), keys, "__n", [time, "__varies"], judge, length, 128, rows=60_000, keep=[order])
    return found.unionByName(parts.select(*keys, order))
