"""Duplicates, velocities, streaks and the life of playlist members."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def deduplicated(events: DataFrame, keys: list[str], within: str = "48 hours") -> DataFrame:
    """The first of the events that share keys; a stream forgets them after ``within``."""
    if events.isStreaming:
        return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(keys)
    w = Window.partitionBy(*keys).orderBy("ts")
    return events.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def velocity(events: DataFrame, days: int = 7, cap: float = 5.0) -> DataFrame:
    """(user_id, recent, before, velocity): events of the last week over those of the week before, less one, within 0 and the cap."""
    per_day = events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    last = per_day.agg(F.max("day").alias("last"))
    age = F.datediff("last", "day")
    out = per_day.crossJoin(F.broadcast(last)).groupBy("user_id").agg(
        F.coalesce(F.sum(F.when(age < days, F.col("n"))), F.lit(0)).alias("recent"),
        F.coalesce(F.sum(F.when((age >= days) & (age < 2 * days), F.col("n"))), F.lit(0)).alias("before"),
    )
    return out.withColumn("velocity", F.round(F.least(F.greatest(F.col("recent") / F.greatest("before", F.lit(1)) - 1, F.lit(0.0)), F.lit(cap)), 6))


def streaks(events: DataFrame, bad: Column, key: str = "user_id") -> DataFrame:
    """(key, islands, longest): runs of consecutive bad events."""
    order = ["ts", "event_id"]
    marked = events.withColumn("bad", bad)
    g = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - F.row_number().over(Window.partitionBy(key, "bad").orderBy(*order))
    runs = marked.withColumn("g", g).filter("bad").groupBy(key, "g").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy(key).agg(F.count(F.lit(1)).alias("islands"), F.max("n").alias("longest"))


class Membership(StatefulProcessor):
    """Of one playlist: what its last crawl held, and what each new crawl changes.

    Input rows: crawl (number), track, at (time). A crawl is one batch of a playlist; a
    marker row with a null track stands for an empty one. A track that was removed is
    forgotten ``keep`` days after that, and a playlist that isn't crawled for so long
    is forgotten whole, by a timer on event time; what comes back after that is new.
    So the state holds present members and what was removed lately.
    """

    def __init__(self, keep: int):
        self.keep = keep * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.members = handle.getMapState("members", "track string", "removed_at long")
        self.crawled = handle.getValueState("crawled", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        table = pd.concat(list(rows))
        out, known = [], {k[0]: v[0] for k, v in self.members.iterator()}
        last = self.crawled.get()[0] if self.crawled.exists() else None
        for crawl, part in table.sort_values("crawl").groupby("crawl"):
            here, now = set(part["track"].dropna()), int(part["at"].max().timestamp() * 1000)
            if last is not None and now - last > self.keep:
                known = {}
            last = now
            for track in [t for t, at in known.items() if 0 <= at < now - self.keep]:
                del known[track]
            for track in sorted(here):
                if track not in known:
                    out.append((key[0], crawl, track, "inserted"))
                elif known[track] >= 0:
                    out.append((key[0], crawl, track, "restored"))
                known[track] = -1
            for track in sorted(t for t, at in known.items() if at < 0 and t not in here):
                out.append((key[0], crawl, track, "removed"))
                known[track] = now
        self.members.clear()
        for track, at in known.items():
            self.members.updateValue((track,), (at,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.crawled.update((last,))
        self.handle.registerTimer(last + self.keep)
        yield pd.DataFrame(out, columns=["playlist", "crawl", "track", "change"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        self.members.clear()
        self.crawled.clear()
        yield pd.DataFrame([], columns=["playlist", "crawl", "track", "change"]).astype({"crawl": "int64"})

    def close(self) -> None:
        pass


CHANGES = "playlist string, crawl long, track string, change string"


def membership(crawls: DataFrame, keep: int = 396, delay: str = "1 day") -> DataFrame:
    """(playlist, crawl, track, change) of a stream of crawls: playlist, crawl, track, at."""
    late = crawls.withWatermark("at", delay)
    return late.groupBy("playlist").transformWithStateInPandas(Membership(keep), CHANGES, "append", "eventTime")


def membership_batch(crawls: DataFrame, keep: int = 396) -> DataFrame:
    """The same of a table of all crawls: each member's presence over its playlist's crawls, compared with the crawl before.

    A track that is there and wasn't in the crawl before is restored if it was there
    and its removal is no more than ``keep`` days old, else inserted. A longer gap
    between two crawls begins anew.
    """
    days = F.make_dt_interval(F.lit(keep))
    each = crawls.groupBy("playlist", "crawl").agg(F.max("at").alias("at"))
    order = Window.partitionBy("playlist").orderBy("crawl")
    each = each.withColumn("n", F.row_number().over(order)).withColumn("gap", (F.col("at") > F.lag("at").over(order) + days).cast("int"))
    each = each.withColumn("era", F.coalesce(F.sum("gap").over(order), F.lit(0)))
    after = Window.partitionBy("playlist", "era").orderBy("crawl")
    each = each.withColumn("next_crawl", F.lead("crawl").over(after)).withColumn("next_at", F.lead("at").over(after))
    held = crawls.filter("track is not null").select("playlist", "crawl", "track").distinct().join(each, ["playlist", "crawl"])
    one = Window.partitionBy("playlist", "era", "track").orderBy("n")
    held = held.withColumn("before", F.lag("n").over(one)).withColumn("left_at", F.lag("next_at").over(one)).withColumn("after", F.lead("n").over(one))
    fresh = F.col("before").isNull() | (F.col("left_at") < F.col("at") - days)
    came = held.filter(F.col("before").isNull() | (F.col("before") < F.col("n") - 1)).select("playlist", "crawl", "track", F.when(fresh, "inserted").otherwise("restored").alias("change"))
    gone = held.filter(F.col("next_crawl").isNotNull() & (F.col("after").isNull() | (F.col("after") > F.col("n") + 1)))
    return came.unionByName(gone.select("playlist", F.col("next_crawl").alias("crawl"), "track", F.lit("removed").alias("change")))
