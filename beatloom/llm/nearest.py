"""Matching records by nearest time: tick expansion, then an equi-join on entity and tick.

Times are whole microseconds and ticks whole numbers. The right side is copied to every tick within reach of it, and of
the copies in a tick only those are kept that can be the nearest of something in it (see nearest_ticks); the left side
keeps its one tick, and entity and tick together are the join key. So no record meets more than the few right records
that a tick may have as its nearest, and a hot entity spreads over as many keys as it has ticks.

Nulls: a record whose time or entity is null has no partner. Infinite and NaN times have none either, nor those of
9e12 s and more, which have no microseconds. Repeated rows give the same pair once. Empty tables give no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beatloom.session import written

#: Tables of so many rows, counted beforehand, are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 100_000
TICK = "__tick"


def _micros(c: Column) -> Column:
    """Whole microseconds of finite seconds; null for others."""
    return F.round(F.when(F.abs(c) < 9e12, c.cast("double")) * F.lit(1e6)).cast("long")


def _tick(c: Column, tick: int) -> Column:
    """``c`` / ``tick`` rounded down: the multiple of ``tick`` first, so that no long is too large for the division."""
    return F.floor((c - F.pmod(c, F.lit(tick))) / F.lit(tick) + 0.5)


def nearest_ticks(right: DataFrame, entity: list[str], reach: int, tick: int) -> DataFrame:
    """Each right record (``__rid``, ``__r``) at every tick within ``reach`` of it, as far as it can be nearest there.

    For any time in a tick the nearest right record is one inside the tick, or the last one before it, or the first one
    after it. So of the copies from before (and from after) the one nearest to the tick's edge is kept, and inside one
    of each time; of equal times the lowest ``__rid``. Tasks combine the copies they make before they are shuffled.
    """
    home = _tick(F.col("__r"), tick)
    copies = right.select(*entity, "__rid", "__r", home.alias("__home"), F.explode(F.sequence(_tick(F.col("__r") - reach, tick), _tick(F.col("__r") + reach, tick))).alias(TICK))
    side = F.signum(F.col("__home") - F.col(TICK)).cast("int")
    edge = F.when(side > 0, (F.col(TICK) + 1) * tick).otherwise(F.col(TICK) * tick)
    off = F.abs(F.col("__r") - edge)
    slots = copies.select(*entity, TICK, side.alias("__side"), F.when(side == 0, off).otherwise(F.lit(0)).alias("__slot"), F.struct(off.alias("off"), F.col("__rid").alias("rid")).alias("__one"))
    kept = slots.groupBy(*entity, TICK, "__side", "__slot").agg(F.min("__one").alias("__one"))
    time = F.when(F.col("__side") > 0, (F.col(TICK) + 1) * tick + F.col("__one.off")).when(F.col("__side") < 0, F.col(TICK) * tick - F.col("__one.off")).otherwise(F.col(TICK) * tick + F.col("__one.off"))
    return kept.select(*entity, TICK, F.col("__one.rid").alias("__rid"), time.cast("long").alias("__r"))


def nearest_of(left: DataFrame, ticks: DataFrame, entity: list[str], name: list[str], reach: int, tick: int) -> DataFrame:
    """The nearest of ``ticks`` to each left record (``name``, ``__l``): adds ``__d`` (distance), ``__rid`` and ``__r``.

    Ties go to the lower ``__rid``. The minimum is taken where the join has brought the records together.
    """
    met = left.withColumn(TICK, _tick(F.col("__l"), tick)).join(ticks, [*entity, TICK])
    d = F.abs(F.col("__l") - F.col("__r"))
    best = met.where(d <= reach).groupBy(*entity, TICK, *name, "__l").agg(F.min(F.struct(d.alias("d"), F.col("__rid").alias("rid"), F.col("__r").alias("r"))).alias("__m"))
    return best.select(*entity, *name, "__l", F.col("__m.d").alias("__d"), F.col("__m.rid").alias("__rid"), F.col("__m.r").alias("__r"))


def nearest_pairs(left: DataFrame, right: DataFrame, entity: list[str], left_id: list[str], right_id: str, left_time: str, right_time: str, tolerance: float, tick: float | None = None) -> DataFrame:
    """For each left record the nearest right record of its entity within ``tolerance``.

    Columns: ``entity``, ``left_id``, ``right_id`` and ``distance``; ties go to the lower ``right_id``. Left records
    without a partner are left out. ``entity`` and ``left_id`` name a left record; the same record twice counts once.
    Distances are told apart to the microsecond. A tick is as wide as the tolerance unless given.
    """
    reach = round(tolerance * 1e6)
    wide = round((tick or tolerance) * 1e6)
    l_rows = left.select(*entity, *left_id, _micros(F.col(left_time)).alias("__l")).where("__l is not null")
    r_rows = right.select(*entity, F.col(right_id).alias("__rid"), _micros(F.col(right_time)).alias("__r")).where("__r is not null")
    found = nearest_of(l_rows, nearest_ticks(r_rows, entity, reach, wide), entity, left_id, reach, wide)
    return found.select(*entity, *left_id, F.col("__rid").alias(right_id), (F.col("__d") / 1e6).alias("distance"))


def _small(df: DataFrame) -> DataFrame:
    """A written table with a broadcast hint if its rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def constant_delay(left: DataFrame, right: DataFrame, entity: list[str], run: list[str], longest: int = 600_000, width: int = 5_000) -> DataFrame:
    """The constant delay (0 to ``longest``) of each run of ``left`` behind the right side: ``entity``, ``run``, ``__delay``.

    ``left`` has ``__lid`` and ``__l``, ``right`` has ``__rid`` and ``__r``; all times are microseconds.
    Differences of all pairs that the delay allows are counted in bins of ``width``; the mode of the counts, smoothed
    over nine bins, is refined three times to the mean of the differences around it. Ties go to the shorter delay.
    Runs without any pair have no row. Counts and means are combined in the map tasks; no run is brought together.
    """
    key = [*entity, *run]
    slack, tick = 50_000, longest + 100_000
    looks = left.withColumn(TICK, F.explode(F.sequence(_tick(F.col("__l") - longest - slack, tick), _tick(F.col("__l") + slack, tick))))
    apart = F.col("__l") - F.col("__r")
    met = looks.join(right.withColumn(TICK, _tick(F.col("__r"), tick)), [*entity, TICK]).where(apart.between(-slack, longest + slack))
    # A right record is at one tick, so a pair meets once; one that was sent twice counts once.
    pairs = met.select(*entity, TICK, *run, "__lid", "__rid", apart.alias("__d")).dropDuplicates([*entity, TICK, *run, "__lid", "__rid"])
    diffs = written(pairs.select(*key, "__d"), "differences")
    bins = diffs.groupBy(*key, F.floor(F.col("__d") / width).alias("__bin")).agg(F.count("*").alias("__one"))
    near = Window.partitionBy(*key).orderBy("__bin").rangeBetween(-4, 4)
    centre = (F.col("__bin") + 0.5) * width
    smooth = bins.select(*key, F.sum("__one").over(near).alias("__n"), centre.alias("__c")).where((F.col("__c") >= 0) & (F.col("__c") <= longest + width))
    mean = written(smooth.groupBy(*key).agg((-F.max(F.struct("__n", (-F.col("__c")).alias("c")))["c"]).alias("__m")), "delays")
    for reach in (50_000, 40_000, 40_000):
        told = diffs.select(F.struct(*key).alias("__key"), "__d").join(_small(mean.select(F.struct(*key).alias("__key"), "__m")), "__key")
        mean = written(told.where(F.abs(F.col("__d") - F.col("__m")) <= reach).groupBy("__key").agg(F.avg("__d").alias("__m")).select("__key.*", "__m"), "delays")
    return mean.select(*key, F.round("__m").cast("long").alias("__delay"))


def run_delays(left: DataFrame, right: DataFrame, entity: list[str], run: list[str], left_id: str, right_id: str, left_time: str, right_time: str) -> DataFrame:
    """constant_delay of each run of ``left`` in seconds: ``entity``, ``run``, ``delay``."""
    slim = left.select(*entity, *run, F.col(left_id).alias("__lid"), _micros(F.col(left_time)).alias("__l")).where("__lid is not null and __l is not null")
    r_rows = right.select(*entity, F.col(right_id).alias("__rid"), _micros(F.col(right_time)).alias("__r")).where("__rid is not null and __r is not null")
    return constant_delay(slim, r_rows, entity, run).select(*entity, *run, (F.col("__delay") / 1e6).alias("delay"))


def first_choices(left: DataFrame, right: DataFrame, entity: list[str], run: list[str], reach: int, tick: int, block: int) -> DataFrame:
    """Each left record's nearest right record: ``entity``, ``run``, ``__rid``, ``__lid``, ``__d``, ``__l``, ``__place``.

    ``__place`` is 1 for the nearest of the run's left records that chose the same right record (ties: the lower
    ``__lid``), then 2 and so on.

    Both sides are shuffled once, by entity and block of time; left records within ``reach`` of a block, and right ones
    within twice that, are copied into it, so whoever may choose a block's right records is there, with all that they
    choose from. Ticks, their join and the places are made within the blocks.
    """
    blocks = lambda c, margin: F.explode(F.sequence(_tick(c - margin, block), _tick(c + margin, block))).alias("__block")
    part = [*entity, "__block"]
    l_rows = left.select(*entity, *run, "__lid", "__l", blocks(F.col("__l"), reach)).repartition(*part)
    r_rows = right.select(*entity, "__rid", "__r", blocks(F.col("__r"), 2 * reach)).repartition(*part)
    near = nearest_of(l_rows, nearest_ticks(r_rows, part, reach, tick), part, [*run, "__lid"], reach, tick)
    own = near.where(_tick(F.col("__r"), block) == F.col("__block"))
    place = F.row_number().over(Window.partitionBy(*part, *run, "__rid").orderBy("__d", "__lid"))
    return own.withColumn("__place", place).select(*entity, *run, "__rid", "__lid", F.col("__d").cast("int").alias("__d"), "__l", "__place")


def match_runs(left: DataFrame, right: DataFrame, entity: list[str], run: list[str], left_id: str, right_id: str, left_time: str, right_time: str, delay: str, tolerance: float) -> DataFrame:
    """One-to-one matches of each run of ``left`` with ``right``, the run's delay taken off: the closest pairs first.

    ``delay`` is a column of ``left``, constant over a run; where it is null (or NaN) it is estimated by constant_delay.
    Ties go to the lower right, then left id. Columns: ``entity``, ``run``, ``right_id``, ``left_id``.

    Taking the closest pair first is the one matching in which no two records would both rather have each other, so it
    is reached by rounds: every left record chooses its nearest right record, which holds the nearest of those that
    chose it; the others choose the nearest right record that has not refused them yet, which may let go of the one it
    holds. After the first round, by first_choices, only refused records are looked at, a few in a hundred.
    """
    spark = left.sparkSession
    key = [*entity, *run]
    reach = round(tolerance * 1e6)
    tick, block = reach, 64 * reach
    lag = _micros(F.when(~F.isnan(F.col(delay)), F.col(delay)))
    slim = left.select(*key, F.col(left_id).alias("__lid"), _micros(F.col(left_time)).alias("__l"), lag.alias("__delay")).where("__lid is not null and __l is not null")
    r_rows = right.select(*entity, F.col(right_id).alias("__rid"), _micros(F.col(right_time)).alias("__r")).where("__rid is not null and __r is not null")
    placed = slim.where("__delay is not null")
    blank = slim.where("__delay is null").drop("__delay")
    delays = constant_delay(blank, r_rows, entity, run).select(F.struct(*key).alias("__key"), "__delay")
    found = blank.withColumn("__key", F.struct(*key)).join(_small(written(delays, "delays")), "__key")
    placed = placed.unionByName(found.drop("__key")).select(*key, "__lid", (F.col("__l") - F.col("__delay")).alias("__l"))

    # The join of a block's ticks is satisfied with sides that are shuffled by a part of its keys.
    option = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(option)
    spark.conf.set(option, "false")
    try:
        choices = written(first_choices(placed, r_rows, entity, run, reach, tick, block), "choices")
    finally:
        spark.conf.set(option, before)

    of = F.struct(*key).alias("__key")
    named = ["__key", "__rid", "__lid", "__d", "__l"]
    held = choices.where("__place = 1").select(of, *named[1:])
    # Refused records, with the distance and id of the right record that refused them; and who came to be held since.
    free = choices.where("__place > 1").select(of, *named[1:])
    copies = r_rows.select(*entity, "__rid", "__r", F.explode(F.sequence(_tick(F.col("__r") - reach, block), _tick(F.col("__r") + reach, block))).alias(TICK))
    since = written(held.limit(0), "since")
    while not free.isEmpty():
        asks = _small(written(free.select(*[F.col(f"__key.{e}").alias(e) for e in entity], "__key", "__lid", "__l", F.struct("__d", "__rid").alias("__after"), _tick(F.col("__l"), block).alias(TICK)), "free"))
        d = F.abs(F.col("__l") - F.col("__r")).cast("int")
        met = copies.join(asks, [*entity, TICK]).withColumn("__next", F.struct(d.alias("__d"), "__rid")).where((d <= reach) & (F.col("__next") > F.col("__after")))
        turn = written(met.groupBy("__key", "__lid", "__l").agg(F.min("__next").alias("__next")).select("__key", "__next.__rid", "__lid", "__next.__d", "__l"), "turn")
        if turn.isEmpty():
            break
        asked = _small(written(turn.select("__key", "__rid").distinct(), "asked"))
        first = held.join(asked, ["__key", "__rid"], "left_semi").join(_small(since).select("__key", "__rid"), ["__key", "__rid"], "left_anti")
        now = turn.unionByName(since.join(asked, ["__key", "__rid"], "left_semi")).unionByName(first)
        ranked = written(now.withColumn("__place", F.row_number().over(Window.partitionBy("__key", "__rid").orderBy("__d", "__lid"))), "ranked")
        since = written(since.join(asked, ["__key", "__rid"], "left_anti").unionByName(ranked.where("__place = 1").drop("__place")), "since")
        free = ranked.where("__place > 1").select(*named)
    kept = held.join(_small(since).select("__key", "__rid"), ["__key", "__rid"], "left_anti").unionByName(since)
    return kept.select("__key.*", F.col("__rid").alias(right_id), F.col("__lid").alias(left_id))
