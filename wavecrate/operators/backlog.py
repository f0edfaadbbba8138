"""What to enrich, crawl and analyse next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavecrate.plans.topk import top_k


def due(as_of: Column, searched: str = "searched_at", attempts: str = "attempts") -> Column:
    """A retry whose wait is over: 30 days after the first attempt, 90 after the second."""
    age = F.datediff(as_of, F.col(searched))
    return ((F.col(attempts) == 1) & (age > 30)) | ((F.col(attempts) == 2) & (age > 90))


def candidates(rows: DataFrame, missing: Column, as_of: Column, budget: int, newest_first: bool = True) -> DataFrame:
    """(…, tier, place): rows never searched first, then due retries, oldest search first, up to the budget."""
    never = F.col("searched_at").isNull()
    tiered = rows.filter(missing & (never | due(as_of))).withColumn("tier", F.when(never, 1).otherwise(2))
    fresh = F.when(F.col("tier") == 1, F.col("id"))
    order = [F.col("tier"), fresh.desc() if newest_first else fresh.asc(), F.col("searched_at"), F.col("id")]
    return top_k(tiered.orderBy(*order).limit(budget), [], order, budget, "place")


def partition(rows: DataFrame, missing: Column, as_of: Column, limit: int = 3) -> DataFrame:
    """One row: never, due, cooldown, abandoned, total_missing, total_linked."""
    never = missing & F.col("searched_at").isNull()
    gone = missing & F.col("searched_at").isNotNull() & (F.col("attempts") >= limit)
    waits = missing & F.col("searched_at").isNotNull() & (F.col("attempts") < limit)
    count = lambda c: F.count(F.when(c, True))
    return rows.agg(
        count(never).alias("never"),
        count(waits & due(as_of)).alias("due"),
        count(waits & ~due(as_of)).alias("cooldown"),
        count(gone).alias("abandoned"),
        count(missing).alias("total_missing"),
        count(~missing).alias("total_linked"),
    )


def batch(rows: DataFrame, cap: int) -> DataFrame:
    """Due playlists, followed ones first, then the most recent, up to the cap, with how many were left out."""
    order = [F.desc("followed"), F.desc_nulls_last("changed_at"), F.col("id")]
    kept = top_k(rows.orderBy(*order).limit(cap), [], order, cap, "place")
    dropped = rows.agg(F.greatest(F.count(F.lit(1)) - cap, F.lit(0)).alias("dropped_by_cap"))
    return kept.crossJoin(F.broadcast(dropped))


def outcome(old: Column, new: Column, stale: Column) -> Column:
    """struct(stale, final) after a re-crawl: the counter starts anew on progress; complete or three without progress is final."""
    n = F.when(old.isNull() | (new > old), 0).otherwise(F.coalesce(stale, F.lit(0)) + 1)
    return F.struct(n.alias("stale"), F.when(new >= 1.0, "complete").when(n >= 3, "stale").alias("final"))


def verdict(bpm: Column, estimate: Column, confidence: Column, least: float = 2.0) -> Column:
    """An estimate counts if it is sure enough and there is no tempo yet."""
    return F.coalesce(bpm, F.when(confidence >= least, estimate))


def cooled(as_of: Column, searched: Column, hours: int = 24) -> Column:
    """Never searched, or longer ago than the wait."""
    return searched.isNull() | (searched < as_of - F.make_dt_interval(F.lit(0), F.lit(hours)))


def before_cut(rows: DataFrame, cut: Column, limit: int, ident: str = "deezer_id") -> DataFrame:
    """Rows with an id that were searched before ``cut``, oldest first, up to the limit; those never stamped are left out."""
    held = rows.filter(F.col(ident).isNotNull() & (F.col("searched_at") < cut))
    return held.orderBy("searched_at", "id").limit(limit)
