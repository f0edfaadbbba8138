"""Time-decayed trend scores of tracks from playlist and set detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavecrate.functions.time import decay, release_freshness
from wavecrate.params import OTHER_PILLAR, Trends
from wavecrate.plans.ranking import global_rank
from wavecrate.plans.visibility import root_sets


def detections(radar: DataFrame, sets: DataFrame, set_tracks: DataFrame) -> DataFrame:
    """(catalog_id, entity, source, detected_at, size, weight_set, initial): active playlist members and identified tracks of root sets."""
    sizes = radar.filter("active").groupBy("playlist_id").agg(F.count(F.lit(1)).alias("size"))
    lists = radar.filter("active").join(sizes, "playlist_id").select(
        "catalog_id", F.concat(F.lit("p"), F.col("playlist_id").cast("string")).alias("entity"), F.col("source"), "detected_at", "size", F.lit(False).alias("in_set"), "initial"
    )
    counts = set_tracks.groupBy("set_id").agg(F.count(F.lit(1)).alias("size"))
    played = set_tracks.filter("catalog_id is not null").join(root_sets(sets).select(F.col("id").alias("set_id"), "played_date"), "set_id").join(counts, "set_id")
    return lists.unionByName(
        played.select("catalog_id", F.concat(F.lit("s"), F.col("set_id").cast("string")).alias("entity"), F.lit("set").alias("source"), F.col("played_date").alias("detected_at"), "size", F.lit(True).alias("in_set"), F.lit(False).alias("initial"))
    )


def trend_scores(found: DataFrame, catalog: DataFrame, as_of: Column, p: Trends = Trends()) -> DataFrame:
    """(catalog_id, score, detection_count, source_count, velocity) of all tracks detected in the window.

    One aggregation yields the decayed sum and both weeks of the velocity, so the
    detections are shuffled once, and combined before.
    """
    age = F.datediff(as_of, F.col("detected_at")).cast("double")
    last = F.datediff(as_of, F.col("detected_at"))
    live = found.filter((last <= p.window_days) & (last >= 0))
    mass = decay(age, p.half_life_days) * F.when(F.col("in_set"), p.set_weight).otherwise(1.0) / F.sqrt(F.greatest("size", F.lit(1)).cast("double"))
    recent = ~F.col("initial") & (last <= p.recent_days)
    before = ~F.col("initial") & (last > p.recent_days) & (last <= 2 * p.recent_days)
    sums = live.groupBy("catalog_id").agg(
        F.sum(mass).alias("mass"),
        F.countDistinct("entity").alias("detection_count"),
        F.countDistinct("source").alias("source_count"),
        F.count(F.when(recent, True)).alias("recent"),
        F.count(F.when(before, True)).alias("before"),
    )
    years = F.datediff(as_of, F.col("release_date")) / 365.0
    velocity = F.least(F.greatest(F.col("recent") / F.greatest("before", F.lit(1)) - 1, F.lit(0.0)), F.lit(p.velocity_cap))
    fresh = sums.join(catalog.select(F.col("id").alias("catalog_id"), "release_date"), "catalog_id").withColumn("velocity", velocity)
    score = F.col("mass") * release_freshness(years) * (1 + p.source_bonus * (F.col("source_count") - 1)) * (1 + p.velocity_bonus * F.col("velocity"))
    return fresh.select("catalog_id", F.round(score, 6).alias("score"), "detection_count", "source_count", F.round("velocity", 6).alias("velocity"))


def family(tracks: DataFrame, pillars: DataFrame, ident: str = "id") -> DataFrame:
    """(id, family): the first genre's pillar that is known and not the other one, else the first genre's pillar, else null."""
    each = tracks.select(ident, F.posexplode("genres").alias("pos", "raw_name")).join(pillars.select("raw_name", "pillar"), "raw_name", "left")
    first = each.groupBy(ident).agg(
        F.min_by("pillar", F.when(F.col("pillar") != OTHER_PILLAR, F.col("pos"))).alias("known"),
        F.min_by("pillar", "pos").alias("any"),
    )
    return first.select(ident, F.coalesce("known", "any").alias("family"))


def ranked(scores: DataFrame, families: DataFrame) -> DataFrame:
    """Adds family, rank_global and rank_in_family (null without a family); ties by id."""
    out = scores.join(families.withColumnRenamed("id", "catalog_id"), "catalog_id", "left")
    order = [F.desc("score"), F.col("catalog_id")]
    out = out.withColumn("rank_in_family", F.when(F.col("family").isNotNull(), F.row_number().over(Window.partitionBy("family").orderBy(*order))))
    return global_rank(out, "score", "catalog_id", "rank_global")
