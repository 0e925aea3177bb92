"""Percentiles of very large groups by distributed multi-select, and summaries that can be put together later.

multi_select finds order statistics exactly (rank error 0) without sorting any group as a whole. Each round, every
partition proposes quantiles of its own part of each open bracket (its local medians and their neighbours); their
weighted quantiles around the wanted rank become pivots; values are counted below, at and between the pivots; ranges
that cannot hold a wanted rank are ruled out and their values discarded. It goes on until the wanted value is a pivot or
its bracket holds a few dozen values, which are read off. Proposals and counts are combined in the map tasks, so a hot
group costs no task more than others.

What is looked up (pivots, open brackets) has some rows for each group: while they are at most BROADCAST_ROWS, counted
beforehand, they are broadcast and the values stay where they are; beyond that both sides are shuffled by bracket and
salt. The values are written once, and after each round those that are left.

summaries keeps, per part (a day, a file), the values at ``points`` + 1 evenly spaced ranks. combine puts any number of
parts together: a part of n values adds at most n / points to the rank error, so the answer's rank is off by at most
1 / points of all values; the bound comes out with each row.

Nulls, NaN and infinite values are no values. A group without values has no row. A percentile is the least value with at
least that share of the group at or below it. A null in a group column is a group of its own. Ties need no care: equal
values are one pivot. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beatloom.session import written

#: Quantiles that a partition proposes for each bracket.
GRID = 48
#: A looked-up table of so many rows (some hundred bytes each) is broadcast.
BROADCAST_ROWS = 100_000


def finite(c: Column) -> Column:
    """The column, null where it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def _key(groups: list[str]) -> Column:
    """One number for a group; which of its columns are null is a part of it, since the hash passes nulls over."""
    nulls = F.concat(F.lit("-"), *[F.when(F.col(g).isNull(), F.lit("0")).otherwise(F.lit("1")) for g in groups])
    return F.xxhash64(nulls, *groups)


def _look_up(values: DataFrame, table: DataFrame, on: list[str], how: str = "inner", salts: int = 32) -> DataFrame:
    """``values`` joined with a written ``table``, which is broadcast if it is small and salted if it is not."""
    if table.count() <= BROADCAST_ROWS:
        return values.join(F.broadcast(table), on, how)
    copies = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salt = F.pmod(F.xxhash64("__v", F.monotonically_increasing_id()), F.lit(salts)).cast("int")
    return values.withColumn("__salt", salt).join(copies, [*on, "__salt"], how).drop("__salt")


def multi_select(df: DataFrame, groups: list[str], value: str, shares: list[float], bound: int = 32) -> DataFrame:
    """Order statistics of each group: ``groups``, ``n``, ``share``, ``rank``, ``value`` (rank from 1; exact).

    ``bound``: brackets of up to this many values are read off.
    """
    named = df.select(*groups, finite(F.col(value).cast("double")).alias("__v")).where("__v is not null")
    base = written(named.withColumn("__bracket", _key(groups)), "values")
    sizes = base.groupBy(*groups, "__bracket").agg(F.count("*").alias("n"))
    wanted = sizes.withColumn("share", F.explode(F.array(*[F.lit(float(p)) for p in shares])))
    rank = F.greatest(F.lit(1), F.least("n", F.ceil(F.round(F.col("share") * F.col("n"), 9)))).cast("long")
    # A bracket: values of one group between two pivots; its key, how many values lie below it and how many in it.
    targets = written(wanted.select(*groups, "n", "share", rank.alias("rank"), "__bracket", F.lit(0).cast("long").alias("__below"), F.col("n").alias("__in")), "targets")
    candidates = base.select("__bracket", "__v")
    done: list[DataFrame] = []
    while not targets.isEmpty():
        small, large = targets.where(F.col("__in") <= bound), targets.where(F.col("__in") > bound)
        if not small.isEmpty():
            done.append(_read_off(small, candidates, groups))
        if large.isEmpty():
            break
        found, targets, candidates = _round(large, candidates, groups)
        done.append(found)
    if not done:
        return targets.select(*groups, "n", "share", "rank", F.lit(None).cast("double").alias("value"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _read_off(targets: DataFrame, candidates: DataFrame, groups: list[str]) -> DataFrame:
    keys = written(targets.select("__bracket").distinct(), "small")
    ranked = _look_up(candidates, keys, ["__bracket"], "left_semi").withColumn("__r", F.row_number().over(Window.partitionBy("__bracket").orderBy("__v")))
    picks = targets.select(*groups, "n", "share", "rank", "__bracket", (F.col("rank") - F.col("__below")).cast("int").alias("__r"))
    return picks.join(ranked, ["__bracket", "__r"]).select(*groups, "n", "share", "rank", F.col("__v").alias("value"))


def _pivots(brackets: DataFrame, candidates: DataFrame) -> DataFrame:
    """Weighted quantiles of what the partitions propose, around the wanted ranks: ``__bracket``, ``__pivots``."""
    shares = F.array(*[F.lit((i + 0.5) / GRID) for i in range(GRID)])
    live = _look_up(candidates, brackets.select("__bracket"), ["__bracket"], "left_semi")
    local = live.groupBy("__bracket", F.spark_partition_id().alias("__part")).agg(F.percentile_approx("__v", shares, 1_000).alias("__q"), F.count("*").alias("__weight"))
    # The pivots are proposed values themselves.
    steps = local.select("__bracket", "__weight", F.explode("__q").alias("__v")).groupBy("__bracket", "__v").agg(F.sum("__weight").alias("__weight"))
    whole = Window.partitionBy("__bracket")
    steps = steps.withColumn("__upto", F.sum("__weight").over(whole.orderBy("__v"))).withColumn("__all", F.sum("__weight").over(whole))
    around = F.array(F.lit(-0.75), F.lit(0.0), F.lit(0.75))
    mark = lambda r, d: F.greatest(F.lit(0.0), F.least(F.lit(1.0), r / F.col("__in") + d / GRID))
    spread = F.array_distinct(F.flatten(F.transform("__ranks", lambda r: F.transform(around, lambda d: mark(r.cast("double"), d)))))
    marks = brackets.select("__bracket", F.explode(spread).alias("__mark"))
    at = steps.join(marks, "__bracket").where(F.col("__upto") >= F.col("__mark") * F.col("__all")).groupBy("__bracket", "__mark").agg(F.min("__v").alias("__v"))
    return at.groupBy("__bracket").agg(F.sort_array(F.collect_set("__v")).alias("__pivots"))


def _round(targets: DataFrame, candidates: DataFrame, groups: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round: what it found, the targets still open, and the values that may still hold them."""
    brackets = written(targets.groupBy("__bracket").agg(F.first("__in").alias("__in"), F.collect_set(F.col("rank") - F.col("__below")).alias("__ranks")), "brackets")
    pivots = written(_pivots(brackets, candidates), "pivots")
    # Three-way place of a value: even = strictly between pivots, odd = equal to one.
    place = F.size(F.filter("__pivots", lambda p: p < F.col("__v"))) * 2 + F.array_contains("__pivots", F.col("__v")).cast("int")
    placed = _look_up(candidates, pivots, ["__bracket"]).select("__bracket", "__v", place.alias("__place"))
    counts = placed.groupBy("__bracket", "__place").agg(F.count("*").alias("__n"), F.min("__v").alias("__min"), F.max("__v").alias("__max"))
    upto = F.sum("__n").over(Window.partitionBy("__bracket").orderBy("__place"))
    ranges = counts.withColumn("__upto", upto).withColumn("__base", F.col("__upto") - F.col("__n"))
    inside = F.col("rank") - F.col("__below")
    hit = written(targets.join(ranges, "__bracket").where((inside > F.col("__base")) & (inside <= F.col("__upto"))), "hits")
    found = hit.where(F.col("__min") == F.col("__max")).select(*groups, "n", "share", "rank", F.col("__min").alias("value"))
    still = hit.where(F.col("__min") < F.col("__max"))
    key = F.xxhash64("__bracket", "__place")
    left = written(still.select(*groups, "n", "share", "rank", key.alias("__bracket"), (F.col("__below") + F.col("__base")).alias("__below"), F.col("__n").alias("__in")), "targets")
    keep = written(still.select("__bracket", "__place").distinct(), "open")
    rest = written(_look_up(placed, keep, ["__bracket", "__place"], "left_semi").select(key.alias("__bracket"), "__v"), "values")
    return found, left, rest


def summaries(df: DataFrame, groups: list[str], part: str, value: str, points: int = 50) -> DataFrame:
    """One row for each group and part: ``n`` and ``knots``, the values at ``points`` + 1 evenly spaced ranks."""
    shares = [i / points for i in range(points + 1)]
    found = multi_select(df, [*groups, part], value, shares)
    knots = F.transform(F.sort_array(F.collect_list(F.struct("share", "value"))), lambda s: s["value"])
    return found.groupBy(*groups, part).agg(F.first("n").alias("n"), knots.alias("knots"))


def combine(summary: DataFrame, groups: list[str], shares: list[float], points: int = 50) -> DataFrame:
    """Percentiles over any parts put together: ``groups``, ``n``, ``share``, ``value``, ``rank_error``.

    ``rank_error`` bounds how far the value's rank is from the wanted one, as a share of ``n``: 1 / points.
    """
    bins = summary.select(*groups, "n", F.posexplode("knots").alias("__i", "__v")).where(F.col("__i") > 0)
    weight = F.col("n") / F.lit(float(points))
    steps = bins.groupBy(*groups, "__v").agg(F.sum(weight).alias("__w"))
    steps = steps.withColumn("__upto", F.sum("__w").over(Window.partitionBy(*groups).orderBy("__v")))
    totals = summary.groupBy(*groups).agg(F.sum("n").alias("n"))
    same = [F.col(f"t.{g}").eqNullSafe(F.col(f"s.{g}")) for g in groups]
    on = F.lit(True)
    for c in same:
        on = on & c
    marks = totals.withColumn("share", F.explode(F.array(*[F.lit(float(p)) for p in shares])))
    joined = marks.alias("t").join(steps.alias("s"), on).where(F.col("s.__upto") >= F.col("t.share") * F.col("t.n") - 1e-6)
    return joined.groupBy(*[F.col(f"t.{g}").alias(g) for g in groups], F.col("t.n").alias("n"), F.col("t.share").alias("share")).agg(F.min("s.__v").alias("value"), F.lit(1.0 / points).alias("rank_error"))
