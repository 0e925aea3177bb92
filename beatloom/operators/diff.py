"""Differences between two copies of a table, by a tree of checksums over key ranges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANGE = "__range"


@dataclass(frozen=True)
class Field:
    """A compared field; numbers that differ by no more than ``tolerance`` agree."""

    name: str
    tolerance: float | None = None


def latest(df: DataFrame, keys: list[str], version: str, fields: list[str]) -> DataFrame:
    """The row of each key with the greatest ``version``; ties go to the greatest fields, a null version is the oldest."""
    row = F.struct(F.col(version).isNotNull().alias("__has"), F.col(version).alias("__version"), *fields)
    return df.groupBy(*keys).agg(F.max(row).alias("__row")).select(*keys, *[F.col(f"__row.{f}").alias(f) for f in fields])


def _prints(field: Field) -> list[Column]:
    """What the checksum sees. Two numbers in one cell of the tolerance's width can't differ by more than it.

    Cells are whole numbers as long as doubles are exact; a number beyond that (2^53 cells) is its own print.
    """
    x = F.col(field.name)
    if field.tolerance is None:
        return [x]
    cells = x.cast("double") / F.lit(field.tolerance)
    exact = F.abs(cells) < F.lit(2.0**53)
    return [F.when(exact, F.floor(cells).cast("long")), F.when(~exact, x)]


def _differs(field: Field, kind: str) -> Column:
    a, b = F.col(f"__a.{field.name}"), F.col(f"__b.{field.name}")
    one_missing = a.isNull() != b.isNull()
    apart = a != b
    if field.tolerance is not None:
        # Whole numbers are subtracted as decimals, which neither overflow nor lose their last digits.
        x, y = (c.cast("decimal(20,0)") if kind in ("bigint", "int", "smallint", "tinyint") else c for c in (a, b))
        apart &= F.abs(x - y) > F.lit(field.tolerance)
    return one_missing | F.coalesce(apart, F.lit(False))


def tree_depth(rows: int, bits: int, leaf_rows: int = 64) -> int:
    """Levels of a tree with 2^``bits`` children a node whose leaves hold about ``leaf_rows`` of ``rows`` rows."""
    leaves = max(1, -(-rows // leaf_rows))
    return max(1, min(63 // bits, -(-(leaves - 1).bit_length() // bits)))


def table_diff(a: DataFrame, b: DataFrame, keys: list[str], fields: list[Field], rows: int | None = None, bits: int = 5) -> DataFrame:
    """Rows that only one copy has, and fields in which the copies disagree.

    ``keys`` are unique on each side; nulls in keys are equal to each other, a field that is null or NaN is missing.
    Result: ``keys``, ``kind`` ("only_a", "only_b", "differs"), ``field_name`` (empty but for "differs"). Two empty
    tables give none.

    Key ranges are ranges of the key's hash, which no hot key can fill unevenly. The tree's depth follows ``rows``, about
    how many rows a side has (counted where it is not given), so a leaf holds some dozens of them at any size. Each leaf
    range of each side has a row count and two order-free checksums; ranges one level up take the sums of theirs. From the
    top, only the children of mismatched ranges are looked at, and rows are joined and compared field by field only in
    mismatched leaves. Numbers of any size are told apart, and so are infinite ones. Agreement in all
    checksums proves agreement up to a hash collision (2 x 64 bits); the comparison in the leaves is exact, so noise below
    the tolerance that falls into another cell costs a comparison and never a row of the result.
    """
    names = [f.name for f in fields]
    depth = tree_depth(max(a.count(), b.count()) if rows is None else rows, bits)

    def clean(df: DataFrame) -> DataFrame:
        for f in fields:
            if dict(df.dtypes)[f.name] in ("double", "float"):
                df = df.withColumn(f.name, F.when(~F.isnan(f.name), F.col(f.name)))
        span = F.shiftrightunsigned(F.xxhash64(*keys), 64 - depth * bits)
        return df.select(*keys, *names, span.alias(RANGE))

    a, b = clean(a), clean(b)
    kinds = dict(a.dtypes)
    # The hash passes nulls over, so which columns are null is a part of the print.
    nulls = F.concat(*[F.when(F.col(c).isNull(), F.lit("0")).otherwise(F.lit("1")) for c in (*keys, *names)])
    row_hash = [F.xxhash64(*keys, *[p for f in fields for p in _prints(f)], nulls, F.lit(seed)).cast("decimal(20,0)") for seed in (1, 2)]

    def sums(df: DataFrame, sign: int) -> DataFrame:
        return df.select(RANGE, F.lit(sign).cast("long").alias("__n"), *[(h * sign).alias(f"__h{i}") for i, h in enumerate(row_hash)])

    total = [F.sum(c).alias(c) for c in ("__n", "__h0", "__h1")]
    # Levels and leaves read the same shuffles of both sides, so the tables are read and shuffled once in one job.
    leaves = sums(a, 1).unionByName(sums(b, -1)).groupBy(RANGE).agg(*total)
    levels = [leaves]
    for _ in range(depth - 1):
        levels.append(levels[-1].withColumn(RANGE, F.shiftrightunsigned(RANGE, bits)).groupBy(RANGE).agg(*total))
    unequal = (F.col("__n") != 0) | (F.col("__h0") != 0) | (F.col("__h1") != 0)
    wrong = levels[-1].where(unequal).select(RANGE)
    for level in reversed(levels[:-1]):
        parent = wrong.withColumnRenamed(RANGE, "__parent")
        wrong = level.where(unequal).join(parent, F.shiftrightunsigned(RANGE, bits) == F.col("__parent"), "left_semi").select(RANGE)

    def in_wrong(df: DataFrame, side: str) -> DataFrame:
        return df.join(wrong, RANGE, "left_semi").select(RANGE, *keys, F.struct(*names).alias(f"__{side}"))

    left, right = in_wrong(a, "a").alias("l"), in_wrong(b, "b").alias("r")
    same = F.col(f"l.{RANGE}") == F.col(f"r.{RANGE}")
    for k in keys:
        same &= F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    pairs = left.withColumn("__in_a", F.lit(True)).alias("l").join(right.withColumn("__in_b", F.lit(True)).alias("r"), same, "full_outer")
    found = F.when(F.col("__in_b").isNull(), F.array(F.struct(F.lit("only_a").alias("kind"), F.lit("").alias("field_name")))).when(F.col("__in_a").isNull(), F.array(F.struct(F.lit("only_b").alias("kind"), F.lit("").alias("field_name"))))
    unlike = F.array_compact(F.array(*[F.when(_differs(f, kinds[f.name]), F.struct(F.lit("differs").alias("kind"), F.lit(f.name).alias("field_name"))) for f in fields]))
    key_of = [F.when(F.col("__in_a").isNotNull(), F.col(f"l.{k}")).otherwise(F.col(f"r.{k}")).alias(k) for k in keys]
    return pairs.select(*key_of, F.explode(found.otherwise(unlike)).alias("__case")).select(*keys, "__case.kind", "__case.field_name")

