"""Genre statistics, dominant genres and pillars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavecrate.params import PILLARS
from wavecrate.plans.quantiles import exact_percentiles
from wavecrate.plans.topk import top_k


def exploded(catalog: DataFrame) -> DataFrame:
    """One row per track and genre; tracks without genres have none."""
    return catalog.withColumn("genre", F.explode("genres"))


def genre_stats(catalog: DataFrame) -> DataFrame:
    """(genre, tracks, artists, bpm_low, bpm_high): exact continuous percentiles of the tempo, rounded half to even, 0 without a tempo."""
    each = exploded(catalog)
    counts = each.groupBy("genre").agg(F.countDistinct("id").alias("tracks"), F.countDistinct(F.lower("artist")).alias("artists"))
    ends = exact_percentiles(each, ["genre"], "bpm", [0.05, 0.95])
    ends = ends.groupBy("genre").agg(*[F.max(F.when(F.col("at") == p, F.rint("value"))).cast("int").alias(name) for p, name in ((0.05, "bpm_low"), (0.95, "bpm_high"))])
    ends = ends.withColumnRenamed("genre", "__genre")
    out = counts.join(ends, F.col("genre").eqNullSafe(F.col("__genre")), "left").drop("__genre")
    return out.select("genre", "tracks", "artists", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("bpm_low", "bpm_high")])


def top_genres(tracks: DataFrame, group: str, cap: int = 5) -> DataFrame:
    """(group, genre, n, pct, rank): a track counts once a genre; pct over tracks that have any, half to even."""
    with_any = tracks.filter(F.coalesce(F.size("genres"), F.lit(0)) > 0)
    whole = with_any.groupBy(group).agg(F.count(F.lit(1)).alias("total"))
    each = with_any.select(group, F.explode(F.array_distinct("genres")).alias("genre")).groupBy(group, "genre").agg(F.count(F.lit(1)).alias("n"))
    ranked = top_k(each, [group], [F.desc("n"), F.col("genre")], cap)
    return ranked.join(whole, group).select(group, "genre", "n", F.bround(100 * F.col("n") / F.col("total"), 0).cast("int").alias("pct"), "rank")


def artist_genres(links: DataFrame, catalog: DataFrame, share: float = 0.2) -> DataFrame:
    """(artist_id, genre, n, rank): genres with at least that share of the artist's genre mentions, and one."""
    each = exploded(links.join(catalog.select(F.col("id").alias("catalog_id"), "genres"), "catalog_id")).groupBy("artist_id", "genre").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("artist_id"))
    kept = each.withColumn("least", F.greatest(F.lit(1), F.floor(total * share))).filter(F.col("n") >= F.col("least"))
    order = Window.partitionBy("artist_id").orderBy(F.desc("n"), "genre")
    return kept.select("artist_id", "genre", "n", F.row_number().over(order).alias("rank"))


def pillar_counts(genres: DataFrame, pillars: DataFrame) -> DataFrame:
    """(pillar, n) of distinct genres, every pillar listed."""
    named = genres.select(F.col("genre").alias("raw_name")).distinct().join(pillars, "raw_name", "left")
    counts = named.groupBy(F.coalesce("pillar", F.lit(PILLARS[-1])).alias("pillar")).agg(F.count(F.lit(1)).alias("n"))
    every = genres.sparkSession.range(1).select(F.explode(F.array(*[F.lit(p) for p in PILLARS])).alias("pillar"))
    return every.join(counts, "pillar", "left").select("pillar", F.coalesce("n", F.lit(0)).alias("n"))


def neighbours(catalog: DataFrame, least: int = 1) -> DataFrame:
    """(genre, other, common): genres that share artists."""
    held = exploded(catalog).select("genre", F.lower("artist").alias("artist")).distinct()
    a, b = held, held.withColumnRenamed("genre", "other")
    pairs = a.join(b, "artist").filter("genre <> other").groupBy("genre", "other").agg(F.count(F.lit(1)).alias("common"))
    return pairs.filter(F.col("common") >= least)
