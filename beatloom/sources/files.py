"""Sources and sinks beside the parquet tables: CSV, JSON, binary files with checksums, headers in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a declared schema: no pass over the data to guess one."""
    return spark.read.option("header", True).schema(schema).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def header_fields(text: Column) -> Column:
    """Map of the ``<name>: value`` fields of a header text; of a repeated name the last value counts."""
    pattern = F.lit(r"<([^>]+)>:\s*([^<]+?)(?=\s*<|$)")
    names, values = F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(2))
    pairs = F.arrays_zip(names.alias("k"), values.alias("v"))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(names, i + 2, F.greatest(F.size(names) - i - 1, F.lit(0))), lambda k: k == p["k"]))
    return F.map_from_arrays(F.transform(last, lambda p: p["k"]), F.transform(last, lambda p: p["v"]))


def listing(spark: SparkSession, pattern: str) -> DataFrame:
    """Files with their size, none of their content read: ``name``, ``path``, ``length``."""
    files = spark.read.format("binaryFile").load(pattern).select("path", "length")
    return files.withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1))


def complete_records(files: DataFrame, parts: list[str], least: dict[str, int]) -> DataFrame:
    """Records (file names without ending) that have every part, each at least its size in bytes."""
    named = files.select(F.regexp_extract("name", r"^(.*)\.([^.]+)$", 1).alias("record"), F.regexp_extract("name", r"^(.*)\.([^.]+)$", 2).alias("part"), "length")
    need = F.lit(0)
    for p in parts:
        need = F.when(F.col("part") == p, F.lit(least.get(p, 0))).otherwise(need)
    full = named.where(F.col("part").isin(parts) & (F.col("length") >= need))
    return full.groupBy("record").agg(F.countDistinct("part").alias("n")).where(F.col("n") == len(parts)).select("record")


def checksums(spark: SparkSession, pattern: str, manifest: DataFrame) -> DataFrame:
    """SHA-256 of files against a manifest (``name``, ``sha256``): ``name``, ``status`` (ok, differs, missing, unlisted)."""
    files = spark.read.format("binaryFile").load(pattern).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("found"))
    both = files.join(manifest, "name", "full_outer")
    status = F.when(F.col("found").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted").when(F.col("found") == F.col("sha256"), "ok").otherwise("differs")
    return both.select("name", status.alias("status"))


def pulse_train(beats: DataFrame, keys: list[str], fs: float, duration_s: float | None = None) -> DataFrame:
    """A synthetic pulse signal from beat times: ``keys``, ``i``, ``x``; ``beats`` has ``keys`` and ``t``.

    Each beat adds a raised-cosine rise of 0.12 s, an exponential decay of 0.35 s and a dicrotic bump; only the samples
    within 2 s of a beat are made for it, and they are summed per sample. Without ``duration_s`` a series goes on to the
    end of its last beat.
    """
    first = F.greatest(F.lit(0), F.ceil(F.col("t") * fs)).cast("long")
    last = F.floor((F.col("t") + 2.0) * fs).cast("long")
    if duration_s is not None:
        last = F.least(F.lit(int(fs * duration_s) - 1), last).cast("long")
        beats = beats.where(F.col("t") < duration_s)
    near = beats.where(first <= last).withColumn("i", F.explode(F.sequence(first, last)))
    u = F.col("i") / fs - F.col("t")
    rise = 0.5 * (1 - F.cos(F.lit(3.141592653589793) * u / 0.12))
    fall = F.exp(-(u - 0.12) / 0.35)
    bump = 0.25 * F.exp(-0.5 * F.pow((u - 0.40) / 0.05, F.lit(2)))
    return near.groupBy(*keys, "i").agg(F.sum(F.when(u < 0.12, rise).otherwise(fall) + bump).alias("x"))
