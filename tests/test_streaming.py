"""Streams against their batch twins."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from wavecrate.streaming import activity, throughput

T0 = dt.datetime(2024, 1, 1)
EVENTS = [(i, T0 + dt.timedelta(minutes=37 * i), i % 3, ("click", "error")[i % 4 == 0], float(i)) for i in range(120)]
SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


@pytest.fixture
def folder(spark, tmp_path):
    path = str(tmp_path / "events")
    spark.createDataFrame(EVENTS, SCHEMA).repartition(3).write.parquet(path)
    return path


def run(stream, name, tmp_path, mode):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return query


@pytest.mark.parametrize("twin", [throughput.hourly, throughput.daily, throughput.sliding])
def test_rollups(spark, folder, tmp_path, twin):
    stream = spark.readStream.schema(SCHEMA).parquet(folder)
    run(twin(stream), f"s_{twin.__name__}", tmp_path, "complete")
    got = {tuple(r) for r in spark.table(f"s_{twin.__name__}").collect()}
    assert got == {tuple(r) for r in twin(spark.read.parquet(folder)).collect()} and got


def test_duplicates(spark, folder, tmp_path):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    run(activity.deduplicated(stream, ["user_id", "event_type"], "30 days").select("user_id", "event_type"), "s_dedup", tmp_path, "append")
    got = [tuple(r) for r in spark.table("s_dedup").collect()]
    batch = activity.deduplicated(spark.read.parquet(folder), ["user_id", "event_type"])
    assert sorted(got) == sorted(tuple(r) for r in batch.select("user_id", "event_type").collect())


def test_staleness(spark):
    df = spark.createDataFrame(EVENTS, SCHEMA)
    last = EVENTS[-1][1]
    assert throughput.stale(df, F.lit(last + dt.timedelta(hours=1))).first()["stale"] is False
    assert throughput.stale(df, F.lit(last + dt.timedelta(hours=3))).first()["stale"] is True


def test_streaks(spark):
    kinds = ["e", "e", "c", "e", "c", "c", "e", "e", "e"]
    df = spark.createDataFrame([(i, T0 + dt.timedelta(hours=i), 1, k) for i, k in enumerate(kinds)], "event_id long, ts timestamp, user_id long, event_type string")
    assert tuple(activity.streaks(df, F.col("event_type") == "e").first()) == (1, 3, 3)


MEMBERS = "playlist string, crawl long, track string, at timestamp"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before)


def changes(df):
    return sorted(tuple(r) for r in df.select("playlist", "crawl", "track", "change").collect())


def test_membership(spark, tmp_path, rocks):
    at = lambda n: T0 + dt.timedelta(days=n)
    rows = [("p", 1, "a", at(1)), ("p", 1, "b", at(1)), ("p", 2, "a", at(2)), ("p", 2, "c", at(2)), ("p", 3, "b", at(3)), ("q", 1, None, at(1)), ("r", 1, "a", at(1)), ("r", 2, "a", at(500)), ("r", 2, "b", at(500))]
    path = str(tmp_path / "crawls")
    spark.createDataFrame(rows, MEMBERS).coalesce(1).write.parquet(path)
    run(activity.membership(spark.readStream.schema(MEMBERS).parquet(path)), "s_members", tmp_path, "append")
    got = changes(spark.table("s_members"))
    assert [x[1:] for x in got if x[0] == "p"] == [(1, "a", "inserted"), (1, "b", "inserted"), (2, "b", "removed"), (2, "c", "inserted"), (3, "a", "removed"), (3, "b", "restored"), (3, "c", "removed")]
    assert [x[1:] for x in got if x[0] == "r"] == [(1, "a", "inserted"), (2, "a", "inserted"), (2, "b", "inserted")]
    assert got == changes(activity.membership_batch(spark.read.parquet(path)))


def test_membership_forgets(spark, tmp_path, rocks):
    """A simulated year of crawls: the state doesn't grow, and the changes are those of the batch twin."""
    r = random.Random(3)
    for part in range(6):
        rows = []
        for playlist in "pqrs":
            for crawl in range(part * 12, part * 12 + 12):
                if playlist == "s" and 15 < crawl < 40:
                    continue
                tracks = [f"t{k}" for k in range(crawl, crawl + 12) if r.random() < 0.7] + (["evergreen"] if crawl % 9 < 4 else [])
                rows += [(playlist, crawl, t, T0 + dt.timedelta(days=5 * crawl)) for t in tracks or [None]]
        spark.createDataFrame(rows, MEMBERS).coalesce(1).write.parquet(str(tmp_path / "crawls" / f"n{part}"))
    folder = str(tmp_path / "crawls" / "*")
    stream = spark.readStream.schema(MEMBERS).option("maxFilesPerTrigger", 1).parquet(folder)
    query = run(activity.membership(stream, keep=30), "s_forgets", tmp_path, "append")
    want = changes(activity.membership_batch(spark.read.schema(MEMBERS).parquet(folder), keep=30))
    assert changes(spark.table("s_forgets")) == want and {x[3] for x in want} == {"inserted", "removed", "restored"}
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["numInputRows"]]
    assert len(held) == 6 and max(held[3:]) <= 1.3 * max(held[:3])
