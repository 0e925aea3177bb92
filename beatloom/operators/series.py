"""Series in sorted blocks: the frame for operators that look at a reading's neighbours with numpy.

Spark partitions, shuffles and sorts; a task then sees whole groups, one group being a chunk of one series with a
margin of neighbours on both sides. So a group's size is bounded however long a series grows, and a hot series is
spread over as many groups as it has chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "__chunk"
GROUP = "__group"


def with_chunks(df: DataFrame, order: str, length: int, margin: int) -> DataFrame:
    """Give each row its chunk ``floor(order / length)``, and a copy in a neighbouring chunk if it lies within ``margin`` of it."""
    base = F.floor(F.col(order) / F.lit(length))
    offset = F.col(order) - base * F.lit(length)
    near: Column = F.when(offset < margin, F.array(base, base - 1)).when(offset >= length - margin, F.array(base, base + 1)).otherwise(F.array(base))
    return df.withColumn(CHUNK, F.explode(near))


def dense(df: DataFrame, keys: list[str], order: str, name: str, length: int = 50_000) -> DataFrame:
    """Adds ``name``, the place of each row in its series, from 0; rows of a series differ in ``order`` (a long).

    A series is numbered stretch by stretch (of ``length`` in ``order``): a stretch's rows start at the count of the
    stretches before it, so no task sorts a whole series.
    """
    part = df.withColumn("__part", F.floor(F.col(order) / F.lit(length)))
    counts = part.groupBy(*keys, "__part").agg(F.count("*").alias("__many"))
    before = F.sum("__many").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*[F.col(k).alias(f"__o_{k}") for k in keys], F.col("__part").alias("__o_part"), F.coalesce(before, F.lit(0)).alias("__before"))
    local = part.withColumn("__local", F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(order)) - 1)
    on = F.col("__part") == F.col("__o_part")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__o_{k}"))
    return local.join(offsets, on).select(*df.columns, (F.col("__before") + F.col("__local")).alias(name))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float], bins: int = 4_096) -> DataFrame:
    """Quantiles of each series (linear between neighbouring values): ``keys`` and ``quantiles``, an array.

    Values are counted in ``bins`` bins between a series' least and greatest one, and only the values of the bins that
    hold a wanted rank are looked at one by one, each distinct value once; counting is combined in the map tasks, so a
    series of any length will do. Nulls and NaN are no values; a series without values has no row.
    """
    real = df.select(*keys, F.col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    ends = real.groupBy(*keys).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.count("*").alias("__n"))
    place = lambda share: (F.col("__n") - 1) * F.lit(float(share))
    ranks = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.array(F.floor(place(q)), F.ceil(place(q))) for q in shares]))))
    known = ends.select(*[F.col(k).alias(f"__k_{k}") for k in keys], "__lo", "__hi", "__n", ranks.alias("__ranks"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    width = F.col("__hi") - F.col("__lo")
    bin_of = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("__v") - F.col("__lo")) / width * bins))).otherwise(0).cast("int")
    binned = real.join(known, on).select(*keys, "__v", "__n", "__ranks", bin_of.alias("__bin"))
    upto = F.sum("__many").over(Window.partitionBy(*keys).orderBy("__bin"))
    counts = binned.groupBy(*keys, "__bin", "__ranks").agg(F.count("*").alias("__many")).withColumn("__first", upto - F.col("__many"))
    asked = F.filter("__ranks", lambda r: (r >= F.col("__first")) & (r < F.col("__first") + F.col("__many")))
    held = counts.withColumn("__asked", asked).where(F.size("__asked") > 0)
    held = held.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__bin").alias("__k_bin"), "__first", "__asked")
    each = binned.groupBy(*keys, "__bin", "__v", "__n").agg(F.count("*").alias("__many"))
    inside = each.join(held, on & (F.col("__bin") == F.col("__k_bin")))
    through = F.col("__first") + F.sum("__many").over(Window.partitionBy(*keys, "__bin").orderBy("__v"))
    found = inside.withColumn("__upto", through).withColumn("__rank", F.explode("__asked")).where((F.col("__rank") < F.col("__upto")) & (F.col("__rank") >= F.col("__upto") - F.col("__many")))
    at = found.groupBy(*keys, "__n").agg(F.map_from_entries(F.collect_set(F.struct("__rank", "__v"))).alias("__at"))
    value_at = lambda q: F.col("__at")[F.floor(place(q))] + (F.col("__at")[F.ceil(place(q))] - F.col("__at")[F.floor(place(q))]) * (place(q) - F.floor(place(q)))
    return at.select(*keys, F.array(*[value_at(q) for q in shares]).alias("quantiles"))


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables made of whole groups, with the position at which each group starts."""
    held: list[pa.RecordBatch] = []
    n = 0

    def starts(t: pa.Table) -> np.ndarray:
        change = np.zeros(t.num_rows, bool)
        change[0] = True
        for k in keys:
            column = t[k].combine_chunks()
            if isinstance(column, pa.ChunkedArray):
                column = pa.concat_arrays(column.chunks)
            a, b = column.slice(1), column.slice(0, len(column) - 1)
            differ = pc.fill_null(pc.not_equal(a, b), False)
            nulls = pc.xor(pc.is_null(a), pc.is_null(b))
            change[1:] |= np.asarray(pc.or_(differ, nulls).to_numpy(zero_copy_only=False), bool)
        return np.flatnonzero(change)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            t = pa.Table.from_batches(held).combine_chunks()
            s = starts(t)
            if len(s) > 1:
                yield t.slice(0, s[-1]), s[:-1]
                t = t.slice(s[-1])
            held, n = t.to_batches(), t.num_rows
    if n:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, starts(t)


def map_series(
    df: DataFrame,
    keys: list[str],
    order: str,
    values: list[str],
    work: Callable[[dict[str, np.ndarray], np.ndarray], np.ndarray | dict[str, np.ndarray]],
    length: int,
    margin: int,
    rows: int = 200_000,
    keep: list[str] | None = None,
    extra: list[str] | None = None,
) -> DataFrame:
    """Rows of ``df`` (``keys``, ``order`` and the columns of ``keep``) that ``work`` picks.

    ``work`` gets the arrays of ``values`` and ``order`` of several groups in order, repeated rows taken out, and for
    each row the number of its group; it returns a mask. Rows without a value of ``order`` have no place in a series
    and are left out; a null in a key is a value like others. With ``extra``, ``work`` returns a number for each row
    under each of those names instead, and all rows come out with them.
    """
    names = [*keys, order, *(keep or [])]
    out_schema = df.select(*names).schema
    for name in extra or []:
        out_schema = out_schema.add(name, "double")
    columns = list(dict.fromkeys([*names, *values]))
    slim = with_chunks(df.select(*columns).where(F.col(order).isNotNull()), order, length, margin)
    slim = slim.withColumn(GROUP, F.xxhash64(*keys, CHUNK))
    placed = slim.repartition(GROUP).sortWithinPartitions(GROUP, *keys, CHUNK, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in _whole_groups(batches, [GROUP, *keys, CHUNK], rows):
            group = np.zeros(t.num_rows, np.int64)
            group[starts] = 1
            group = np.cumsum(group) - 1
            place = t[order].to_numpy()
            first = np.ones(len(place), bool)
            first[1:] = (place[1:] != place[:-1]) | (group[1:] != group[:-1])
            kept = np.flatnonzero(first)
            arrays = {v: t[v].to_numpy()[kept] for v in values}
            arrays[order] = place[kept]
            found = work(arrays, group[kept])
            mask = np.floor_divide(place[kept], length) == t[CHUNK].to_numpy()[kept]
            if not extra:
                mask &= found
            hit = kept[mask]
            if len(hit):
                picked = t.select(names).take(pa.array(hit))
                for name in extra or []:
                    picked = picked.append_column(name, pa.array(found[name][mask], pa.float64()))
                yield from picked.to_batches()

    return placed.mapInArrow(run, out_schema)
