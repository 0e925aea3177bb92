"""Variability indices of interval series.

Input: ``keys``, a dense position ``n`` from 0, and ``ibi_s`` in seconds (screened). All results are in milliseconds
unless named otherwise and null where a guard (a least number of intervals or seconds) is not met. Groups are sessions
of one visit; every step is a window, join or aggregate by the group, so groups spread over the cluster.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beatloom.functions.numbers import ratio

# Bands in Hz.
LF, HF, TOTAL = (0.04, 0.15), (0.15, 0.40), (0.0033, 0.40)


def _ms() -> Column:
    return F.col("ibi_s") * 1000.0


def with_difference(df: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``d``, the change from the interval before, in ms."""
    return df.withColumn("d", _ms() - F.lag(_ms()).over(Window.partitionBy(*keys).orderBy("n")))


def time_domain(df: DataFrame, keys: list[str]) -> DataFrame:
    """mean_nn, mean_hr (per minute), sdnn, rmssd, pnn50 (per cent), sdsd; from 3 intervals on."""
    d = F.col("d")
    g = with_difference(df, keys).groupBy(*keys)
    out = g.agg(
        F.count("*").alias("n_intervals"),
        F.avg(_ms()).alias("mean_nn"),
        F.stddev_samp(_ms()).alias("sdnn"),
        F.sqrt(F.avg(d * d)).alias("rmssd"),
        (F.avg(F.when(d.isNotNull(), (F.abs(d) > 50.0).cast("double"))) * 100.0).alias("pnn50"),
        F.stddev_samp(d).alias("sdsd"),
    )
    out = out.withColumn("mean_hr", ratio(F.lit(60_000.0), F.col("mean_nn")))
    enough = F.col("n_intervals") >= 3
    return out.select(*keys, "n_intervals", *[F.when(enough, F.col(c)).alias(c) for c in ("mean_nn", "mean_hr", "sdnn", "rmssd", "pnn50", "sdsd")])


def poincare(df: DataFrame, keys: list[str]) -> DataFrame:
    """sd1, sd2 and their ratio; from 10 intervals on."""
    g = with_difference(df, keys).groupBy(*keys).agg(F.count("*").alias("n_intervals"), F.stddev_samp(_ms()).alias("__s"), F.stddev_samp("d").alias("__sd"))
    sd1 = F.sqrt(F.lit(0.5)) * F.col("__sd")
    square = 2.0 * F.col("__s") * F.col("__s") - sd1 * sd1
    sd2 = F.when(square > 0, F.sqrt(square))
    enough = F.col("n_intervals") >= 10
    return g.select(*keys, "n_intervals", F.when(enough, sd1).alias("sd1"), F.when(enough, sd2).alias("sd2"), F.when(enough, ratio(sd1, sd2)).alias("sd1_sd2"))


def sample_entropy(df: DataFrame, keys: list[str], share: float = 0.2, least: int = 10) -> DataFrame:
    """-ln(A / B): pairs of stretches of 3 and of 2 intervals that agree within ``share`` x the SD; ``keys``, ``n_intervals``, ``sampen``.

    Null from fewer than ``least`` intervals, without spread, and where A or B is 0. Pairs are joined by the cell, as
    wide as the tolerance, of their first interval: partners lie in the same cell or the next one.
    """
    w = Window.partitionBy(*keys).orderBy("n")
    whole = Window.partitionBy(*keys)
    rows = df.select(*keys, "n", _ms().alias("x0"), F.lead(_ms(), 1).over(w).alias("x1"), F.lead(_ms(), 2).over(w).alias("x2"), (F.stddev_samp(_ms()).over(whole) * share).alias("r"), F.count("*").over(whole).alias("n_intervals"))
    cell = F.floor(F.col("x0") / (F.col("r") * (1 + 1e-9)))
    starts = rows.where(F.col("x1").isNotNull() & (F.col("n_intervals") >= least) & (F.col("r") > 0)).withColumn("cell", cell)
    a = starts.select(*keys, "cell", F.col("n").alias("i"), "x0", "x1", "x2", "r")
    # Each start is met in its own cell, and from the cells below and above.
    b = starts.select(*keys, F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"), F.col("n").alias("j"), F.col("x0").alias("y0"), F.col("x1").alias("y1"), F.col("x2").alias("y2"))
    near = a.join(b, [*keys, "cell"]).where((F.col("i") < F.col("j")) & (F.abs(F.col("x0") - F.col("y0")) <= F.col("r")) & (F.abs(F.col("x1") - F.col("y1")) <= F.col("r")))
    longer = F.abs(F.col("x2") - F.col("y2")) <= F.col("r")
    counts = near.groupBy(*keys).agg(F.count("*").alias("b"), F.sum(F.coalesce(longer, F.lit(False)).cast("long")).alias("a"))
    groups = df.groupBy(*keys).agg(F.count("*").alias("n_intervals"))
    value = F.when((F.col("a") > 0) & (F.col("b") > 0), -F.log(F.col("a") / F.col("b")))
    return groups.join(counts, keys, "left").select(*keys, "n_intervals", value.alias("sampen"))


def dfa_alpha1(df: DataFrame, keys: list[str], scales: tuple[int, int] = (4, 16), least: int = 32) -> DataFrame:
    """Short-term detrended fluctuation exponent: slope of ln F(s) on ln s for the whole scales given."""
    whole = Window.partitionBy(*keys)
    ordered = whole.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    centred = df.withColumn("__c", F.col("ibi_s") - F.avg("ibi_s").over(whole)).withColumn("__many", F.count("*").over(whole))
    profile = centred.withColumn("__y", F.sum("__c").over(ordered)).where(F.col("__many") >= least)
    spread = profile.withColumn("__s", F.explode(F.sequence(F.lit(scales[0]), F.lit(scales[1])))).withColumn("__seg", F.floor(F.col("n") / F.col("__s")))
    inside = spread.where(F.col("__seg") < F.floor(F.col("__many") / F.col("__s"))).withColumn("__p", (F.col("n") - F.col("__seg") * F.col("__s")).cast("double"))
    fits = inside.groupBy(*keys, "__s", "__seg").agg(F.regr_syy("__y", "__p").alias("syy"), F.regr_sxy("__y", "__p").alias("sxy"), F.regr_sxx("__y", "__p").alias("sxx"))
    residual = F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"), F.lit(0.0)) / F.col("__s")
    fluct = fits.groupBy(*keys, "__s").agg(F.sqrt(F.avg(residual)).alias("__f")).where(F.col("__f") > 0)
    return fluct.groupBy(*keys).agg(F.count("*").alias("n_scales"), F.regr_slope(F.log("__f"), F.log("__s")).alias("slope")).select(*keys, "n_scales", F.when(F.col("n_scales") >= 3, F.col("slope")).alias("dfa_alpha1"))


def lomb_scargle(df: DataFrame, keys: list[str], low: float = 0.01, high: float = 0.5, steps: int = 500, least: int = 20, span_s: float = 60.0, below: float | None = None) -> DataFrame:
    """Power at ``steps`` even frequencies of the centred intervals at times cumsum(ibi): ``keys``, ``f``, ``p`` (x 2 / N).

    With ``below``, those from there on, which no band holds, are not computed.
    """
    whole = Window.partitionBy(*keys)
    ordered = whole.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    timed = df.select(*keys, "n", "ibi_s", F.sum("ibi_s").over(ordered).alias("t"))
    ready = timed.select(*keys, "t", ((F.col("ibi_s") - F.avg("ibi_s").over(whole)) * 1000.0).alias("v"), F.count("*").over(whole).alias("many"), (F.max("t").over(whole) - F.min("t").over(whole)).alias("span"))
    step = (high - low) / (steps - 1)
    last = steps - 1 if below is None else min(steps - 1, math.ceil((below - low) / step))
    waves = ready.where((F.col("many") >= least) & (F.col("span") >= span_s)).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(last)))).withColumn("f", F.lit(low) + F.col("q") * F.lit(step))
    angle = F.lit(2 * math.pi) * F.col("f") * F.col("t")
    c, s, v = F.cos("a"), F.sin("a"), F.col("v")
    sums = waves.withColumn("a", angle).groupBy(*keys, "f").agg(F.count("*").alias("many"), F.sum(v * c).alias("vc"), F.sum(v * s).alias("vs"), F.sum(c * c).alias("cc"), F.sum(s * s).alias("ss"), F.sum(s * c).alias("sc"))
    tau = F.atan2(2.0 * F.col("sc"), F.col("cc") - F.col("ss")) / 2.0
    ct, st = F.cos(tau), F.sin(tau)
    top_c, top_s = F.col("vc") * ct + F.col("vs") * st, F.col("vs") * ct - F.col("vc") * st
    low_c = ct * ct * F.col("cc") + 2.0 * ct * st * F.col("sc") + st * st * F.col("ss")
    low_s = ct * ct * F.col("ss") - 2.0 * ct * st * F.col("sc") + st * st * F.col("cc")
    power = 0.5 * (ratio(top_c * top_c, low_c) + ratio(top_s * top_s, low_s)) * 2.0 / F.col("many")
    return sums.select(*keys, "f", power.alias("p"))


def band_power(spectrum: DataFrame, keys: list[str]) -> DataFrame:
    """lf, hf, total_power by the trapezoid rule over the frequencies inside each band, and lf_hf."""
    bands = F.array(*[F.struct(F.lit(name).alias("band"), F.lit(b[0]).alias("lo"), F.lit(b[1]).alias("hi")) for name, b in (("lf", LF), ("hf", HF), ("total_power", TOTAL))])
    inside = spectrum.withColumn("b", F.explode(bands)).where((F.col("f") >= F.col("b.lo")) & (F.col("f") < F.col("b.hi")))
    w = Window.partitionBy(*keys, "b.band").orderBy("f")
    area = inside.select(*keys, F.col("b.band").alias("band"), ((F.col("f") - F.lag("f").over(w)) * (F.col("p") + F.lag("p").over(w)) / 2.0).alias("area"))
    wide = area.groupBy(*keys).agg(*[F.sum(F.when(F.col("band") == name, F.col("area"))).alias(name) for name in ("lf", "hf", "total_power")])
    return wide.withColumn("lf_hf", F.when(F.col("hf") > 0, F.col("lf") / F.col("hf")))


def all_indices(df: DataFrame, keys: list[str]) -> DataFrame:
    """Every index of a series in one row; spectral ones have the suffix ``_ls``."""
    spectral = band_power(lomb_scargle(df, keys, below=TOTAL[1]), keys).withColumnsRenamed({c: f"{c}_ls" for c in ("lf", "hf", "total_power", "lf_hf")})
    return (
        time_domain(df, keys)
        .join(poincare(df, keys).drop("n_intervals"), keys, "left")
        .join(sample_entropy(df, keys).drop("n_intervals"), keys, "left")
        .join(dfa_alpha1(df, keys).drop("n_scales"), keys, "left")
        .join(spectral, keys, "left")
    )
