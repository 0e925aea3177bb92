"""Structured Streaming forms of the windowed operators. Late rows beyond the watermark are dropped, as Spark does."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from beatloom.session import ensure_checkpoint_dir


def stream_of(spark: SparkSession, path: str, files_at_once: int = 8) -> DataFrame:
    """A parquet file or folder as a stream."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once)
    return reader.option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(f"{folder}/{name}*")


def tumbling(df: DataFrame, keys: list[str], time: str, value: str, width: str, late: str = "1 hour") -> DataFrame:
    g = df.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys)
    return g.agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(*keys, F.col("w.start").alias("start"), "n", "mean")


def sliding(df: DataFrame, keys: list[str], time: str, value: str, width: str, step: str, late: str = "1 hour") -> DataFrame:
    g = df.withWatermark(time, late).groupBy(F.window(time, width, step).alias("w"), *keys)
    return g.agg(F.count("*").alias("n"), F.max(value).alias("top")).select(*keys, F.col("w.start").alias("start"), "n", "top")


def sessions(df: DataFrame, keys: list[str], time: str, gap: str, late: str = "1 hour") -> DataFrame:
    g = df.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *keys)
    return g.agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def band_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, seconds: int, late: str = "1 hour") -> DataFrame:
    """Pairs of two streams of one key at most ``seconds`` apart; both watermarks bound the state."""
    l_rows, r_rows = left.withWatermark(left_time, late).alias("l"), right.withWatermark(right_time, late).alias("r")
    near = F.expr(f"l.{key} = r.{key} AND r.{right_time} >= l.{left_time} - INTERVAL {seconds} SECONDS AND r.{right_time} <= l.{left_time} + INTERVAL {seconds} SECONDS")
    return l_rows.join(r_rows, near)


def adaptive_level(df: DataFrame, key: str, time: str, value: str, start: float = 0.0) -> DataFrame:
    """Onsets where a value rises over a per-key threshold that follows its peaks (level <- 0.8 level + 0.12 value).

    State per key: the level and the last onset's time; after an onset 0.3 s are blind. Rows of one key and trigger are
    taken in order of time.
    """
    out = f"{key} long, onset double, level double"

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, last = state.get if state.exists else (start, -1e18)
        rows = pd.concat(list(parts)).sort_values(time)
        found = []
        for t, v in zip(rows[time].astype("int64") / 1e9, rows[value]):
            if v == v and v > level and t - last >= 0.3:
                level, last = 0.8 * level + 0.12 * v, float(t)
                found.append((k[0], last, level))
        state.update((float(level), float(last)))
        yield pd.DataFrame(found, columns=[key, "onset", "level"])

    return df.groupBy(key).applyInPandasWithState(step, out, "level double, last double", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all files there are and read its result: written as a table in the shared checkpoint folder."""
    spark = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"
    out = f"{base}/rows"

    def keep(batch: DataFrame, number: int) -> None:
        # In complete mode each batch is the whole result and replaces the one before.
        batch.write.mode("overwrite").parquet(f"{out}/batch={number if mode == 'append' else 0}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/offsets").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out).drop("batch")
