"""Sources that are read page by page, and streams that stop and go on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavecrate.plans.ranking import global_rank
from wavecrate.queries.registry import query
from wavecrate.scratch import scratch_dir
from wavecrate.shipping import ship
from wavecrate.sources import listing, playlists
from wavecrate.testbed import Bed

STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def _folder(b: Bed, name: str) -> str:
    return f"{scratch_dir(b.spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS added_on, user_id, event_type FROM events")
def Q06_resumed_listing(b: Bed, page_size: int = 500) -> DataFrame:
    """All events as a newest-first listing, read by a stream that is stopped and resumed until nothing is left."""
    ship(b.spark)
    b.spark.dataSource.register(listing.Listing)
    events = b.events.select("event_id", "user_id", "event_type", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    ranked = global_rank(events, "at", "event_id").withColumn("page", F.floor((F.col("rank") - 1) / page_size))
    pages, sink = _folder(b, "listing"), _folder(b, "taken")
    shown = ranked.select("page", "rank", "event_id", F.date_format("ts", STAMP).alias("added_on"), "user_id", "event_type")
    shown.repartition("page").sortWithinPartitions("page", "rank").drop("rank").write.partitionBy("page").json(pages)
    total = b.events.count()
    stream = b.spark.readStream.format("newest_first").option("limit", total // 3 + 1).load(pages)
    for _ in range(3):
        run = stream.writeStream.format("parquet").option("checkpointLocation", f"{sink}-state").option("path", sink).trigger(availableNow=True).start()
        run.awaitTermination()
    taken = b.spark.read.schema("added_on string, entry string").parquet(sink)
    entry = F.from_json("entry", "event_id long, user_id long, event_type string")
    return taken.select(entry.alias("e"), "added_on").select("e.event_id", "added_on", "e.user_id", "e.event_type")


@query(
    """SELECT 'n' || c_nationkey AS playlist, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS INT) AS position, CAST(c_custkey AS VARCHAR) AS external_id,
       c_name AS title, c_mktsegment AS artist, NULLIF(substr(c_name, length(c_name), 1), '7') AS isrc FROM customer"""
)
def A06_paged_playlists(b: Bed, page_size: int = 40) -> DataFrame:
    """The customers of each nation as a playlist of several pages, written and read again."""
    ship(b.spark)
    b.spark.dataSource.register(playlists.Playlists)
    last = F.col("c_name").substr(F.length("c_name"), F.lit(1))
    order = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1
    rows = b.customer.select(F.concat(F.lit("n"), "c_nationkey").alias("playlist"), order.alias("at"), F.struct(F.col("c_custkey").alias("track_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("artist_name"), F.nullif(last, F.lit("7")).alias("isrc")).alias("track"))
    paged = rows.groupBy("playlist", F.floor(F.col("at") / page_size).alias("page")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "track"))), lambda x: x["track"]).alias("tracks"))
    pages = paged.groupBy("playlist").agg(F.max("page").alias("last")).join(paged, "playlist")
    pages = pages.withColumn("next", F.when(F.col("page") < F.col("last"), F.col("page") + 1)).drop("last")
    folder = _folder(b, "playlists")
    pages.repartition("playlist").write.partitionBy("playlist", "page").json(folder)
    return b.spark.read.format("playlists").option("source", "beta").option("path", folder).load()
