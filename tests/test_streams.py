"""Streams over several files and triggers against their batch twins."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from beatloom.streaming import windows as st


@pytest.fixture()
def stream(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(seconds=40 * i), i % 3, float(i % 17)) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double")
    for part in range(3):
        df.where(F.floor(F.col("event_id") / 100) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    return df, lambda: st.stream_of(spark, str(tmp_path / "events.parquet"), files_at_once=1)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_windows_over_several_triggers(stream):
    df, read = stream
    got = rows(st.drain(st.tumbling(read(), ["user_id"], "ts", "value", "10 minutes"), "t", "complete"))
    g = df.groupBy("user_id", F.window("ts", "10 minutes").alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("m"))
    assert got == rows(g.select("user_id", "w.start", "n", "m"))


def test_state_lives_between_triggers(stream):
    df, read = stream
    got = rows(st.drain(st.adaptive_level(read(), "user_id", "ts", "value"), "a"))
    want = []
    for user in range(3):
        level, last = 0.0, -1e18
        for r in sorted(df.where(F.col("user_id") == user).collect(), key=lambda r: r["ts"]):
            t = r["ts"].replace(tzinfo=dt.timezone.utc).timestamp()
            if r["value"] > level and t - last >= 0.3:
                level, last = 0.8 * level + 0.12 * r["value"], t
                want.append((user, level))
    assert [(u, pytest.approx(v)) for u, _, v in got] == sorted(want, key=lambda x: x[0])


def test_band_join(stream):
    df, read = stream
    a = read().select("user_id", F.col("ts").alias("lt"), F.col("event_id").alias("i"))
    b = read().select("user_id", F.col("ts").alias("rt"), F.col("event_id").alias("j"))
    got = rows(st.drain(st.band_join(a, b, "user_id", "lt", "rt", 120, late="1 day").select("i", "j"), "b"))
    assert got == sorted((i, j) for i in range(300) for j in range(300) if i % 3 == j % 3 and abs(i - j) * 40 <= 120)
