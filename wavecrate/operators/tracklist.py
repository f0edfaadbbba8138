"""Tracklists: merging detections, duplicates and parts of sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavecrate.functions.text import normalize
from wavecrate.params import SetMatching
from wavecrate.plans.topk import one_per


def merge_detections(found: DataFrame) -> DataFrame:
    """(set_id, mtid, start_ms, place): one row a track at its earliest known start, in order of starts (unknown: 0).

    ``found``: set_id, mtid, start_ms, seq (order of arrival).
    """
    best = one_per(found.filter("mtid is not null"), ["set_id", "mtid"], [F.col("start_ms").asc_nulls_last(), F.col("seq")])
    first = found.filter("mtid is not null").groupBy("set_id", "mtid").agg(F.min("seq").alias("arrived"))
    w = Window.partitionBy("set_id").orderBy(F.coalesce("start_ms", F.lit(0)), "arrived")
    return best.join(first, ["set_id", "mtid"]).select("set_id", "mtid", "start_ms", F.row_number().over(w).alias("place"))


def _key() -> F.Column:
    return normalize(F.concat(F.coalesce("raw_artist", F.lit("")), F.lit("|"), F.coalesce("raw_title", F.lit(""))))


def merge_duplicates(children: DataFrame, tracks: DataFrame) -> DataFrame:
    """(parent, mtid, raw_artist, raw_title, timecode_ms, place): the tracklists of one performance's uploads as one.

    The upload with most identified tracks is the reference; others are shifted by
    the median difference of common tracks (three at least), then tracks are
    united by id, a known timecode first, and by artist and title, an id first.
    ``children``: parent, set_id; ``tracks``: set_id, mtid, raw_artist, raw_title, timecode_ms, is_id, position.
    """
    t = children.join(tracks, "set_id")
    known = t.groupBy("parent", "set_id").agg(F.count(F.when(~F.col("is_id"), True)).alias("known"))
    order = known.withColumn("child", F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("known"), "set_id")))
    t = t.join(order.select("parent", "set_id", "child"), ["parent", "set_id"])
    reference = t.filter("child = 1 and mtid is not null and timecode_ms is not null").groupBy("parent", "mtid").agg(F.max_by("timecode_ms", "position").alias("at"))
    deltas = t.filter("child > 1 and timecode_ms is not null").join(reference, ["parent", "mtid"]).groupBy("parent", "set_id").agg(F.percentile(F.col("timecode_ms") - F.col("at"), 0.5).alias("median"), F.count(F.lit(1)).alias("n"))
    shift = deltas.select("parent", "set_id", F.when(F.col("n") >= 3, F.col("median").cast("int")).otherwise(0).alias("shift"))
    t = t.join(shift, ["parent", "set_id"], "left").withColumn("timecode_ms", F.col("timecode_ms") - F.coalesce("shift", F.lit(0)))
    arrival = [F.col("child"), F.col("position")]
    first = Window.partitionBy("parent", "mtid")
    by_id = t.filter("mtid is not null").withColumn("arrived", F.min(F.struct("child", "position")).over(first))
    by_id = one_per(by_id, ["parent", "mtid"], [F.col("timecode_ms").isNull(), *arrival])
    rest = t.filter("mtid is null").withColumn("arrived", F.struct("child", "position"))
    pool = by_id.unionByName(rest).withColumn("key", _key())
    pool = pool.withColumn("key", F.when(F.col("key").isin("", "|"), F.concat(F.lit("_"), F.col("set_id").cast("string"), F.lit("_"), F.col("position").cast("string"))).otherwise(F.col("key")))
    out = one_per(pool, ["parent", "key"], [F.col("mtid").isNull(), F.col("arrived")])
    w = Window.partitionBy("parent").orderBy(F.col("timecode_ms").asc_nulls_last(), F.col("mtid").isNull(), "arrived")
    return out.select("parent", "mtid", "raw_artist", "raw_title", "timecode_ms", F.row_number().over(w).alias("place"))


def merge_parts(children: DataFrame, tracks: DataFrame, p: SetMatching = SetMatching()) -> DataFrame:
    """(parent, set_id, mtid, timecode_ms, place): parts in order, each shifted by the lengths before it; a track that goes on over a boundary counts once.

    A part of unknown length lasts until its last timecode and three minutes.
    ``children``: parent, set_id, part_number, duration_ms.
    """
    order = Window.partitionBy("parent").orderBy(F.col("part_number").asc_nulls_last(), "set_id")
    parts = children.withColumn("nth", F.row_number().over(order))
    t = parts.select("parent", "set_id", "nth").join(tracks, "set_id")
    last = t.groupBy("parent", "nth").agg(F.max_by("timecode_ms", F.when(F.col("timecode_ms").isNotNull(), F.col("position"))).alias("last"))
    length = parts.join(last, ["parent", "nth"], "left").withColumn("length", F.coalesce("duration_ms", F.coalesce("last", F.lit(0)) + p.unknown_duration_ms))
    before = Window.partitionBy("parent").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    shift = length.select("parent", "nth", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("shift"))
    t = t.join(shift, ["parent", "nth"]).withColumn("timecode_ms", F.col("timecode_ms") + F.col("shift")).withColumn("key", _key())
    line = Window.partitionBy("parent").orderBy("nth", "position")
    t = t.withColumn("b_nth", F.lag("nth").over(line)).withColumn("b_mtid", F.lag("mtid").over(line)).withColumn("b_key", F.lag("key").over(line))
    same = F.when(F.col("mtid").isNotNull() & F.col("b_mtid").isNotNull(), F.col("mtid") == F.col("b_mtid")).otherwise((F.col("key") == F.col("b_key")) & ~F.col("key").isin("", "|"))
    kept = t.filter(~(F.coalesce(F.col("b_nth") != F.col("nth"), F.lit(False)) & F.coalesce(same, F.lit(False))))
    return kept.select("parent", "set_id", "mtid", "timecode_ms", F.row_number().over(line).alias("place"))
