"""Streams give what the batch gives."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.streaming import frames as T


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("events") / "table")
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.repartition(4).write.parquet(d)
    return spark.read.parquet(d), spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(d)


def drain(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_windows(spark, events):
    batch, stream = events
    want = T.window_statistics(batch, "ts", "1 hour", ("event_type",), "value").select("start", "event_type", "n")
    got = drain(spark, T.window_statistics(stream, "ts", "1 hour", ("event_type",), "value"), "windows", "complete").select("start", "event_type", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    sliding = T.window_statistics(batch, "ts", "2 hours", (), "value", slide="1 hour")
    assert sliding.agg(F.sum("n")).first()[0] == 2 * batch.count()


def test_sessions(spark, events):
    batch, stream = events
    want = T.sessions(batch, "ts", "2 hours", ("user_id",), "value").select("user_id", "start", "n")
    got = drain(spark, T.sessions(stream, "ts", "2 hours", ("user_id",), "value"), "sessions", "complete").select("user_id", "start", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_running_moments(spark, events):
    batch, stream = events
    vec = F.array(F.col("value"), F.col("value") * F.col("value"), F.lit(1.0))
    got = drain(spark, T.running_moments(stream.select("event_type", vec.alias("v")), "event_type", "v"), "moments", "update")
    last = {r.event_type: r for r in got.orderBy("n").collect()}
    for kind in {r.event_type for r in batch.select("event_type").distinct().collect()}:
        x = np.array([r.v for r in batch.where(F.col("event_type") == kind).select(vec.alias("v")).collect()])
        assert last[kind].n == len(x) and np.allclose(last[kind]["mean"], x.mean(axis=0))
        assert np.allclose(np.reshape(last[kind].covariance, (3, 3)), np.cov(x.T, bias=True), rtol=1e-6, atol=1e-6)


def test_running_moments_far_from_zero(spark, events):
    batch, stream = events
    far = F.array(F.col("value") + 1e9, F.col("value") * 2 - 1e9)
    got = drain(spark, T.running_moments(stream.select("event_type", far.alias("v")), "event_type", "v"), "far_moments", "update")
    last = {r.event_type: r for r in got.orderBy("n").collect()}
    for kind, r in last.items():
        x = np.array([v.value for v in batch.where(F.col("event_type") == kind).collect()])
        assert np.allclose(r.covariance, np.var(x) * np.array([1, 2, 2, 4]), rtol=1e-4)


def test_static_join_and_slices(spark, events):
    batch, stream = events
    users = batch.select("user_id").distinct().withColumn("tag", F.lit("u"))
    assert drain(spark, T.with_atoms(stream, users, "user_id"), "joined", "append").count() == batch.count()
    assert T.frames_between(spark.range(10), "id", 1, 8, 3).count() == 3
