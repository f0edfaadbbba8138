"""Throughput, backlog and state of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavecrate.plans.topk import one_per


def counter(stats: str, name: str) -> Column:
    """A whole number of a JSON object; what isn't a number counts as 0."""
    return F.coalesce(F.get_json_object(stats, f"$.{name}").try_cast("double").cast("long"), F.lit(0))


def throughput(runs: DataFrame, enriched: Column, not_found: Column, merged: Column) -> DataFrame:
    """By day, task and source: runs, errors, sums, hit rate, average and longest duration of those known."""
    day = F.to_date("started_at").alias("day")
    sums = runs.groupBy(day, "task_type", "source").agg(
        F.count(F.lit(1)).alias("runs"),
        F.count(F.when(F.col("status") == "error", True)).alias("errors"),
        F.sum(enriched).alias("enriched"),
        F.sum(not_found).alias("not_found"),
        F.sum(merged).alias("merged"),
        F.bround(F.avg("duration_ms"), 0).cast("long").alias("duration_avg"),
        F.max("duration_ms").alias("duration_max"),
    )
    return sums.withColumn("hit_rate", F.bround(F.col("enriched") / F.nullif(F.col("enriched") + F.col("not_found"), F.lit(0)), 4))


def status(runs: DataFrame, known: tuple[str, ...] = ()) -> DataFrame:
    """The latest run of each task; known tasks first in their order, then the rest by name."""
    latest = one_per(runs, ["task_type"], [F.desc("started_at"), F.desc("id")])
    place = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(k) for k in known]).cast("array<string>"), F.col("task_type")), F.lit(0)), F.lit(len(known) + 1))
    return latest.select("task_type", "id", "status", place.alias("place"))


def snapshot(catalog: DataFrame, artists: DataFrame, not_found: str = "NOT_FOUND") -> DataFrame:
    """One row of backlog counters; each table is read once."""
    count = lambda c: F.count(F.when(c, True))
    tracks = catalog.agg(
        F.count(F.lit(1)).alias("tracks"),
        count(F.col("bpm").isNull()).alias("no_bpm"),
        count(F.coalesce(F.size("genres"), F.lit(0)) == 0).alias("no_genre"),
        count(~F.coalesce("has_artwork", F.lit(False))).alias("no_artwork"),
        count(F.col("deezer_id").isNull()).alias("unlinked_tracks"),
        count(F.col("deezer_id") == not_found).alias("absent_tracks"),
    )
    people = artists.agg(F.count(F.lit(1)).alias("artists"), count(F.col("deezer_id").isNull()).alias("unlinked_artists"), count(F.col("deezer_id").isNotNull() & (F.col("deezer_id") != not_found)).alias("linked_artists"))
    return tracks.crossJoin(people)


def retained(series: DataFrame, at: str, as_of: Column, days: int = 396) -> DataFrame:
    """The rows of the last ``days`` before ``as_of``, to the second; rows without a time go."""
    return series.filter(F.col(at) >= as_of - F.make_dt_interval(F.lit(days)))
