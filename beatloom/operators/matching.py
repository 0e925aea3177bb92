"""Reference and detected beats: delay, one-to-one matches, paired intervals, accuracy.

References: ``entity``, ``ref_idx``, ``rt``; detections: ``entity``, ``run``, ``test_idx``, ``tt`` (seconds).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beatloom.functions.numbers import ratio

EPS = 1e-9


def band_join(ref: DataFrame, test: DataFrame, entity: list[str], low: float, high: float) -> DataFrame:
    """All pairs of an entity with ``tt - rt`` in [low, high].

    Time buckets as wide as the band make the join an equi-join inside an entity: references sit in their bucket,
    detections look into the two or three that the band touches.
    """
    width = max(high - low, 0.5)
    bucket = lambda c: F.floor(c / width)
    r = ref.withColumn("__b", bucket(F.col("rt")))
    t = test.withColumn("__b", F.explode(F.sequence(bucket(F.col("tt") - high - EPS), bucket(F.col("tt") - low + EPS))))
    return r.join(t, [*entity, "__b"]).where((F.col("tt") - F.col("rt")).between(low - EPS, high + EPS)).drop("__b")


def nearest(ref: DataFrame, test: DataFrame, entity: list[str]) -> DataFrame:
    """The nearest detection in time of each reference, on either side: ``entity``, ``ref_idx``, ``test_idx``, ``distance``.

    One sort of both sides together; the last detection before and the first after a reference are its candidates. Ties
    go to the earlier one. References of an entity without detections have none.
    """
    none = F.lit(None)
    both = ref.select(*entity, F.col("rt").alias("__t"), F.lit(1).alias("__side"), "ref_idx", none.cast("long").alias("__i"), none.cast("double").alias("__tt")).unionByName(
        test.select(*entity, F.col("tt").alias("__t"), F.lit(0).alias("__side"), none.cast("long").alias("ref_idx"), F.col("test_idx").alias("__i"), F.col("tt").alias("__tt"))
    )
    spot = F.when(F.col("__tt").isNotNull(), F.struct("__tt", "__i"))
    w = Window.partitionBy(*entity).orderBy("__t", "__side", "__i")
    back = F.last(spot, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(spot, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    looked = both.withColumn("__b", back).withColumn("__a", ahead).where(F.col("__side") == 1)
    db, da = F.round(F.col("__t") - F.col("__b.__tt"), 9), F.round(F.col("__a.__tt") - F.col("__t"), 9)
    earlier = F.col("__a").isNull() | (F.col("__b").isNotNull() & (db <= da))
    found = looked.where(F.col("__a").isNotNull() | F.col("__b").isNotNull())
    return found.select(*entity, "ref_idx", F.when(earlier, F.col("__b.__i")).otherwise(F.col("__a.__i")).alias("test_idx"), F.when(earlier, db).otherwise(da).alias("distance"))


def grid_delay(ref: DataFrame, test: DataFrame, entity: list[str], run: list[str], near: float = 0.05) -> DataFrame:
    """Delay of each run: the grid value (-0.10 to under 0.60 s by 5 ms) that puts a detection within ``near`` of most references.

    Ties go to the smaller delay. The value is refined by the median of the nearest detections' remaining distance,
    where at least three are near. Runs of fewer than 3 beats, with fewer than 3 references, or without any pair, have
    delay 0.
    """
    key = [*entity, *run]
    pairs = band_join(ref, test, entity, -0.10 - near, 0.60 + near).withColumn("__d", F.col("tt") - F.col("rt"))
    first, last = F.ceil((F.col("__d") - near + 0.10) / 0.005 - 1e-6), F.floor((F.col("__d") + near + 0.10) / 0.005 + 1e-6)
    # A pair votes for a stretch of the grid. Of one reference's stretches each grid value counts once, so they are made
    # disjoint, and only their ends (+1, -1) are summed: two rows a pair, not one for each grid value.
    stretch = pairs.select(*key, "ref_idx", F.greatest(first, F.lit(0)).cast("int").alias("__lo"), F.least(last, F.lit(139)).cast("int").alias("__hi"))
    before = F.max("__hi").over(Window.partitionBy(*key, "ref_idx").orderBy("__lo", "__hi").rowsBetween(Window.unboundedPreceding, -1))
    alone = stretch.withColumn("__lo", F.greatest("__lo", F.coalesce(before + 1, F.lit(0)))).where(F.col("__lo") <= F.col("__hi"))
    ends = F.array(F.struct(F.col("__lo").alias("g"), F.lit(1).alias("s")), F.struct((F.col("__hi") + 1).alias("g"), F.lit(-1).alias("s")))
    steps = alone.select(*key, F.explode(ends).alias("__e")).groupBy(*key, F.col("__e.g").alias("__g")).agg(F.sum("__e.s").alias("__s"))
    votes = steps.withColumn("__n", F.sum("__s").over(Window.partitionBy(*key).orderBy("__g").rowsBetween(Window.unboundedPreceding, 0)))
    best = votes.where(F.col("__g") <= 139).groupBy(*key).agg(F.max(F.struct("__n", (-F.col("__g")).alias("__m"))).alias("__b")).select(*key, (-F.col("__b.__m") * 0.005 - 0.10).alias("__coarse"))
    rest = pairs.join(best, key).withColumn("__r", F.round(F.col("__d") - F.col("__coarse"), 9))
    nearest = rest.groupBy(*key, "__coarse", "ref_idx").agg(F.min(F.struct(F.abs("__r").alias("a"), "__r")).alias("__m"))
    fine = nearest.where(F.col("__m.a") <= near).groupBy(*key, "__coarse").agg(F.count("*").alias("__n"), F.median("__m.__r").alias("__shift"))
    known = fine.select(*key, (F.col("__coarse") + F.when(F.col("__n") >= 3, F.col("__shift")).otherwise(0.0)).alias("delay"))
    sizes = test.groupBy(*key).agg(F.count("*").alias("n_test")).join(ref.groupBy(*entity).agg(F.count("*").alias("n_ref")), entity, "left")
    enough = (F.col("n_test") >= 3) & (F.col("n_ref") >= 3)
    return sizes.join(known, key, "left").select(*key, F.when(enough, F.coalesce("delay", F.lit(0.0))).otherwise(0.0).alias("delay"))


def with_delay(ref: DataFrame, test: DataFrame, entity: list[str], run: list[str], delay: str) -> DataFrame:
    """``test`` (``t``) with the delay that ``grid_delay`` finds in ``delay`` of the rows that state none; a run states one or none."""
    key = [*entity, *run]
    stated = F.when(~F.isnan(delay), F.col(delay))
    blank = test.where(stated.isNull()).select(*key, F.col("t").alias("tt"))
    found = grid_delay(ref, blank, entity, run).withColumnRenamed("delay", "__found")
    return test.join(found, key, "left").withColumn(delay, F.coalesce(stated, "__found")).drop("__found")


def one_to_one(pairs: DataFrame, run: list[str]) -> DataFrame:
    """Of a run's pairs (``__d``, ``ref_idx``, ``test_idx``, ``__lo`` and ``__hi``, its earlier and later time) the closest first, each beat once.

    Pairs that share a beat overlap in time, so a run's pairs, by time, fall into islands of overlapping pairs, and the
    choice is made in each on its own; nearly all islands are one pair.
    """
    order = Window.partitionBy(*run).orderBy("__lo")
    reach = F.max("__hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = pairs.withColumn("__new", (reach.isNull() | (F.col("__lo") > reach)).cast("int"))
    islands = opened.withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    lists = islands.groupBy(*run, "__island").agg(F.collect_list(F.struct("__d", "ref_idx", "test_idx")).alias("__p"))

    def step(taken: Column, p: Column) -> Column:
        free = ~F.exists(taken, lambda q: (q["ref_idx"] == p["ref_idx"]) | (q["test_idx"] == p["test_idx"]))
        return F.when(free, F.concat(taken, F.array(p))).otherwise(taken)

    none = F.filter("__p", lambda p: F.lit(False))
    chosen = F.when(F.size("__p") == 1, F.col("__p")).otherwise(F.aggregate(F.array_sort("__p"), none, step))
    return lists.select(*run, F.explode(chosen).alias("__z")).select(*run, F.col("__z.ref_idx").alias("ref_idx"), F.col("__z.test_idx").alias("test_idx"), F.col("__z.__d").alias("distance"))


def match(ref: DataFrame, test: DataFrame, entity: list[str], run: list[str], tolerance: float) -> DataFrame:
    """Matches of ``test`` (``tt`` with the delay taken off) with ``ref``."""
    near = band_join(ref, test, entity, -tolerance, tolerance)
    pairs = near.select(*entity, *run, F.round(F.abs(F.col("tt") - F.col("rt")), 9).alias("__d"), "ref_idx", "test_idx", F.least("tt", "rt").alias("__lo"), F.greatest("tt", "rt").alias("__hi"))
    return one_to_one(pairs, [*entity, *run])


def detection_counts(matches: DataFrame, ref: DataFrame, test: DataFrame, entity: list[str], run: list[str]) -> DataFrame:
    """tp, fp, fn, sensitivity, ppv and f1 of each run; f1 is null where one of its parts is 0."""
    key = [*entity, *run]
    n_test = test.groupBy(*key).agg(F.count("*").alias("n_test"))
    n_ref = ref.groupBy(*entity).agg(F.count("*").alias("n_ref"))
    tp = matches.groupBy(*key).agg(F.count("*").alias("tp"))
    both = n_test.join(n_ref, entity).join(tp, key, "left").withColumn("tp", F.coalesce("tp", F.lit(0)))
    se, ppv = ratio(F.col("tp"), F.col("n_ref")), ratio(F.col("tp"), F.col("n_test"))
    return both.select(*key, "tp", (F.col("n_test") - F.col("tp")).alias("fp"), (F.col("n_ref") - F.col("tp")).alias("fn"), se.alias("sensitivity"), ppv.alias("ppv"), F.when((se > 0) & (ppv > 0), 2 * se * ppv / (se + ppv)).alias("f1"))


def paired_intervals(matches: DataFrame, ref: DataFrame, test: DataFrame, entity: list[str], run: list[str]) -> DataFrame:
    """Intervals between matches that follow each other on both sides: ``ref_idx`` (of the first), ``rr_s``, ``pp_s``.

    ``rk`` and ``tk`` number the beats of each side in time.
    """
    key = [*entity, *run]
    placed = matches.select(*key, "ref_idx", "test_idx").join(ref.select(*entity, "ref_idx", "rt", "rk"), [*entity, "ref_idx"]).join(test.select(*key, "test_idx", "tt", "tk"), [*key, "test_idx"])
    w = Window.partitionBy(*key).orderBy("rk")
    nxt = placed.select(*key, "ref_idx", (F.lead("rt").over(w) - F.col("rt")).alias("rr_s"), (F.lead("tt").over(w) - F.col("tt")).alias("pp_s"), (F.lead("rk").over(w) - F.col("rk")).alias("__dr"), (F.lead("tk").over(w) - F.col("tk")).alias("__dt"))
    return nxt.where((F.col("__dr") == 1) & (F.col("__dt") == 1)).select(*key, "ref_idx", "rr_s", "pp_s")


def interval_error(pairs: DataFrame, key: list[str]) -> DataFrame:
    """mae, rmse, bias, sd (ms) and number of the paired intervals; null with fewer than 2."""
    e = (F.col("pp_s") - F.col("rr_s")) * 1000.0
    g = pairs.groupBy(*key).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("ibi_mae"), F.sqrt(F.avg(e * e)).alias("ibi_rmse"), F.avg(e).alias("ibi_bias"), F.stddev_samp(e).alias("ibi_sd"))
    ok = F.col("n") >= 2
    return g.select(*key, *[F.when(ok, F.col(c)).alias(c) for c in ("ibi_mae", "ibi_rmse", "ibi_bias", "ibi_sd")], F.when(ok, F.col("n")).alias("n_ibi"))


def bland_altman(df: DataFrame, key: list[str], a: str, b: str) -> DataFrame:
    """Bias and limits of agreement of ``b - a``; null with fewer than 3 pairs, the number kept."""
    d = F.col(b) - F.col(a)
    g = df.where(d.isNotNull() & ~F.isnan(d)).groupBy(*key).agg(F.count("*").alias("n"), F.avg(d).alias("__m"), F.stddev_samp(d).alias("__s"))
    ok = F.col("n") >= 3
    return g.select(*key, "n", F.when(ok, F.col("__m")).alias("bias"), F.when(ok, F.col("__m") - 1.96 * F.col("__s")).alias("lower"), F.when(ok, F.col("__m") + 1.96 * F.col("__s")).alias("upper"))


def concordance(df: DataFrame, key: list[str], a: str, b: str) -> DataFrame:
    """Lin's concordance correlation; null with fewer than 3 pairs or without spread."""
    x, y = F.col(a), F.col(b)
    g = df.where(x.isNotNull() & y.isNotNull()).groupBy(*key).agg(F.count("*").alias("n"), F.covar_samp(x, y).alias("__c"), F.var_samp(x).alias("__vx"), F.var_samp(y).alias("__vy"), F.avg(x).alias("__mx"), F.avg(y).alias("__my"))
    low = F.col("__vx") + F.col("__vy") + F.pow(F.col("__mx") - F.col("__my"), 2)
    return g.select(*key, "n", F.when((F.col("n") >= 3) & (low > 0), 2 * F.col("__c") / low).alias("ccc"))


def consensus_floor(votes: DataFrame, key: list[str], least: int = 3, fewest: int = 5) -> DataFrame:
    """Error of the median interval over detectors: ``votes`` has ``key``, ``detector``, ``ref_idx``, ``rr_s``, ``pp_s``.

    Only detectors with more than 5 paired intervals vote, and at least three must; an interval needs ``least`` votes.
    Errors are null with fewer than ``fewest`` such intervals, the number kept.
    """
    w = Window.partitionBy(*key, "detector")
    able = votes.withColumn("mine", F.count("*").over(w)).where(F.col("mine") > 5)
    panel = able.groupBy(*key).agg(F.countDistinct("detector").alias("n_detectors")).where(F.col("n_detectors") >= 3)
    middle = able.groupBy(*key, "ref_idx").agg(F.count("*").alias("n"), F.median("pp_s").alias("pp"), F.min("rr_s").alias("rr")).where(F.col("n") >= least)
    e = (F.col("pp") - F.col("rr")) * 1000.0
    g = middle.groupBy(*key).agg(F.count("*").alias("n_intervals"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))
    ok = F.col("n_intervals") >= fewest
    return g.join(panel, key).select(*key, F.when(ok, F.col("rmse")).alias("floor_rmse"), F.when(ok, F.col("mae")).alias("floor_mae"), "n_intervals", "n_detectors")


def equivalence(df: DataFrame, key: list[str], a: str, b: str, margin: float = 0.10) -> DataFrame:
    """Two one-sided t tests of ``b - a`` against ``margin`` x mean |a|: ``n``, ``p``, ``equivalent`` (at 0.05).

    Null with fewer than 5 pairs; without spread of the differences p is 0 and the pair equivalent.
    """
    from beatloom.functions.student import upper_tail

    d = F.col(b) - F.col(a)
    g = df.where(d.isNotNull() & ~F.isnan(d)).groupBy(*key).agg(F.count("*").alias("n"), F.avg(d).alias("__m"), F.stddev_samp(d).alias("__s"), (F.avg(F.abs(a)) * margin).alias("__bound"))
    se, free = F.col("__s") / F.sqrt("n"), (F.col("n") - 1).cast("double")
    tests = g.withColumn("__t1", ratio(F.col("__m") + F.col("__bound"), se)).withColumn("__t2", ratio(F.col("__bound") - F.col("__m"), se)).withColumn("__df", free)
    p = F.greatest(upper_tail("__t1", "__df"), upper_tail("__t2", "__df"))
    whole = tests.withColumn("p", F.when(F.col("__s") == 0, F.lit(0.0)).otherwise(p))
    ok = F.col("n") >= 5
    return whole.select(*key, "n", F.when(ok, F.col("p")).alias("p"), F.when(ok, (F.col("p") < 0.05).cast("int")).alias("equivalent"))
