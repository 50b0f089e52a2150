"""Streams run to the end over files and compared with batch results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pgspark.streaming import jobs

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture()
def source(spark, tmp_path):
    rows = [(1, "t", T0 + dt.timedelta(seconds=s), v) for s, v in ((0, 1.0), (10, 1.0), (20, 2.0), (65, 3.0), (200, 3.0))]
    spark.createDataFrame(rows, jobs.SAMPLE).coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(jobs.SAMPLE).parquet(str(tmp_path / "in"))


def run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_rolling(source):
    got = {(r.window_start - T0).seconds: (r["count"], r["sum"]) for r in run(jobs.rolling(source), "rolling", "complete")}
    assert got == {0: (3, 4.0), 60: (1, 3.0), 180: (1, 3.0)}


def test_sessions(source):
    got = sorted(r["count"] for r in run(jobs.sessions(source, "50 seconds"), "sessions", "complete"))
    assert got == [1, 4]


def test_ingest_drops_repeats(source):
    assert [r.value for r in run(jobs.ingest(source), "ingest", "append")] == [1.0, 2.0, 3.0]


def test_change_feed(source):
    feed = jobs.change_feed(source.withColumn("label", F.lit("sensor")).withColumn("change", F.lit("set")), ["sensor"], ["set"], F.col("value") > 2)
    assert len(run(feed, "feed", "append")) == 2


def test_view(spark, tmp_path):
    rows = [(1, 5.0), (1, 7.0), (-1, 5.0)]
    spark.createDataFrame(rows, "sign int, value double").coalesce(1).write.parquet(str(tmp_path / "v"))
    s = spark.readStream.schema("sign int, value double").parquet(str(tmp_path / "v"))
    assert [tuple(r) for r in run(jobs.view(s), "view", "complete")] == [(1, 7.0, 7.0)]


def test_late_samples_by_arrival(spark, tmp_path):
    schema = "entity_id long, property string, ts timestamp, value double, arrival int"
    rows = [(1, "t", T0 + dt.timedelta(seconds=s), v, a) for a, (s, v) in enumerate([(100, 1.0), (97, 2.0), (10, 3.0), (101, 4.0)])]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "late"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "late"))
    assert [r.value for r in run(jobs.ingest(stream(), arrival="arrival"), "late_by_arrival", "append")] == [1.0, 2.0, 4.0]
    assert [r.value for r in run(jobs.ingest(stream()), "late_by_time", "append")] == [3.0, 2.0, 1.0, 4.0]


def test_sliding_windows(source):
    got = {(r.window_start - T0).total_seconds(): r["count"] for r in run(jobs.rolling(source, "60 seconds", slide="30 seconds"), "sliding", "complete")}
    assert got == {-30: 3, 0: 3, 30: 1, 60: 1, 150: 1, 180: 1}


def test_extremes_after_removal(spark):
    first = jobs.value_counts(spark.createDataFrame([(1, 5.0), (1, 9.0), (1, 5.0)], "sign int, value double"))
    later = jobs.value_counts(spark.createDataFrame([(-1, 9.0), (1, 7.0)], "sign int, value double"), first)
    assert tuple(jobs.extremes(first).first()) == (5.0, 9.0, [5.0, 5.0, 9.0])
    assert tuple(jobs.extremes(later).first()) == (5.0, 7.0, [5.0, 5.0, 7.0])


def test_triggers_cascade_and_stop(spark, tmp_path):
    spark.createDataFrame([(3,)], "n int").coalesce(1).write.parquet(str(tmp_path / "c"))
    seen = []
    stream = lambda: spark.readStream.schema("n int").parquet(str(tmp_path / "c"))
    lower = lambda df: df.where("n > 0").select((F.col("n") - 1).alias("n"))
    jobs.on_change(stream(), lower, lambda df: seen.extend(r.n for r in df.collect()), str(tmp_path / "k1")).awaitTermination(120)
    assert seen == [2, 1, 0]
    with pytest.raises(Exception, match="still follow"):
        jobs.on_change(stream(), lambda df: df, lambda df: None, str(tmp_path / "k2")).awaitTermination(120)
