"""Filling containers of fixed capacity with items of varying length, planned on the histogram of lengths.

The plan sees counts of lengths and no items: best-fit over the counts, longest first, opens runs of equal containers
and fills the tightest run that has room. Its size depends on the capacity and the spread of lengths, hardly on the
number of items. Items then take the planned places by their rank within their length; ranks are counted in salted
groups, so a length that a third of all items have is spread over many tasks. Ranks and places meet in an equi-join on
blocks of ranks, which are as wide, for each length, as its places are on average.

An item longer than the capacity is cut into full pieces, each a container of its own, and a rest that is an item like
others; no other item is cut. Items of length 0 or null need no room and get no row. Repeated items are items of their
own. Empty tables give empty results.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beatloom.session import written

SLOTS = "length long, first long, last long, container long"
MOST_KINDS = 1_000


def plan_counts(capacity: int, counts: dict[int, int]) -> list[tuple[int, int, int, int]]:
    """Places for ``counts`` items of each length (1 to ``capacity``): rows (length, first, last, container).

    Items of that length with ranks ``first`` to ``last`` (from 0) go one each to the containers from ``container`` on.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # runs (first container, how many) by the room they have left
    rooms: list[int] = []
    slots: list[tuple[int, int, int, int]] = []
    opened = 0

    def add(left: int, first: int, many: int) -> None:
        if left == 0 or many == 0:
            return
        if left not in room:
            room[left] = []
            insort(rooms, left)
        room[left].append((first, many))

    for length in sorted(counts, reverse=True):
        rank, n = 0, counts[length]
        while n:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                left = rooms[at]
                first, many = room[left].pop()
                if not room[left]:
                    del room[left]
                    rooms.pop(at)
                take = min(n, many)
                add(left, first + take, many - take)
            else:
                left, first, take = capacity, opened, -(-n // (capacity // length))
                opened += take
            slots.append((length, rank, rank + take - 1, first))
            add(left - length, first, take)
            rank, n = rank + take, n - take
    return slots


def pieces(items: DataFrame, keys: list[str], length: str, capacity: str) -> DataFrame:
    """Each item of positive length as pieces no longer than ``capacity``: adds ``piece``, ``start`` and ``size``."""
    n, c = F.col(length), F.col(capacity)
    last = F.floor((n - 1) / c)
    cut = items.where((n > 0) & (c > 0)).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    start = F.col("piece") * c
    return cut.withColumn("start", start.cast("long")).withColumn("size", F.least(c, n - start).cast("long"))


def pack(items: DataFrame, keys: list[str], length: str, kinds: DataFrame, kind: str, capacity: str, salts: int = 64) -> DataFrame:
    """Every item in a container of each kind: ``kind``, ``container``, ``keys``, ``piece``, ``start``, ``size``.

    ``kinds`` has one row for each kind of container, at most MOST_KINDS, and is broadcast; how the plan, of some rows
    for each length up to the capacity, is joined is left to Spark.
    """
    if kinds.count() > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of containers")
    parts = pieces(items.select(*keys, length).crossJoin(F.broadcast(kinds.select(kind, capacity))), keys, length, capacity)
    salt = F.pmod(F.xxhash64(*keys, "piece"), F.lit(salts)).cast("int")
    parts = parts.select(kind, F.col(capacity).cast("long").alias("__capacity"), *keys, "piece", "start", "size", salt.alias("__salt"))
    counts = parts.groupBy(kind, "__capacity", "size", "__salt").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(kind, "size").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(kind, "size", "__salt", before.alias("__before"))

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        slots = plan_counts(int(pdf["__capacity"].iloc[0]), dict(zip(pdf["size"].astype(int), pdf["__n"].astype(int))))
        out = pd.DataFrame(slots, columns=["length", "first", "last", "container"])
        out.insert(0, kind, pdf[kind].iloc[0])
        return out

    kind_type = dict(kinds.dtypes)[kind]
    histogram = counts.groupBy(kind, "__capacity", "size").agg(F.sum("__n").alias("__n"))
    slots = written(histogram.groupBy(kind).applyInPandas(plan, f"{kind} {kind_type}, {SLOTS}"), "places")
    # Blocks of ranks: as many as a length has places, so items and places meet about twice as often as there are items.
    wide = slots.groupBy(kind, F.col("length").alias("size")).agg(F.ceil((F.max("last") + 1) / F.count("*")).alias("__wide"))
    local = F.row_number().over(Window.partitionBy(kind, "size", "__salt").orderBy(*keys, "piece")) - 1
    ranked = parts.withColumn("__local", local).join(offsets.join(wide, [kind, "size"]), [kind, "size", "__salt"]).withColumn("__rank", F.col("__local") + F.col("__before"))
    ranked = ranked.select(kind, *keys, "piece", "start", "size", "__rank", F.floor(F.col("__rank") / F.col("__wide")).alias("__block"))
    places = slots.withColumnRenamed("length", "size").join(wide, [kind, "size"])
    blocks = F.explode(F.sequence(F.floor(F.col("first") / F.col("__wide")), F.floor(F.col("last") / F.col("__wide"))))
    places = places.select(kind, "size", F.col("first").alias("__first"), F.col("last").alias("__last"), F.col("container").alias("__container"), blocks.alias("__block"))
    taken = ranked.join(places, [kind, "size", "__block"]).where(F.col("__rank").between(F.col("__first"), F.col("__last")))
    return taken.select(kind, (F.col("__container") + F.col("__rank") - F.col("__first")).alias("container"), *keys, "piece", "start", "size")


def fill_report(packed: DataFrame, kinds: DataFrame, kind: str, capacity: str) -> DataFrame:
    """Per kind: containers, items, tokens and the share of room used."""
    totals = packed.groupBy(kind).agg(F.countDistinct("container").alias("n_containers"), F.count("*").alias("n_pieces"), F.sum("size").alias("n_tokens"))
    return totals.join(F.broadcast(kinds.select(kind, capacity)), kind).select(kind, capacity, "n_containers", "n_pieces", "n_tokens", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col(capacity)), 6).alias("fill"))

