"""Exact percentiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavecrate.scratch import materialize, small

#: Parts that the values around a wanted rank are cut into in each round.
BINS = 512
#: Rows around a wanted rank that are sorted outright.
ENOUGH = 2000


def exact_percentiles(df: DataFrame, keys: list[str], value: str, at: list[float], bins: int = BINS, enough: int = ENOUGH, weight: str | None = None) -> DataFrame:
    """(keys, at, value): continuous percentiles of each group, between the two values nearest to rank at * (n - 1).

    The values of a wanted rank are narrowed down by histograms: a round counts
    ``bins`` equal parts between the least and the greatest value left and keeps the
    part that holds the rank. Only counts and ends of parts are shuffled, and no
    buffer holds the values of a group. Ranks with ``enough`` rows or fewer around
    them are sorted. Nulls count as no value; groups without values have no rows; null
    keys are a group. NaN must not occur. A row stands ``weight`` times (a count above 0).
    """
    key = [f"__k{i}" for i in range(len(keys))]
    rows = df.filter(F.col(value).isNotNull()).select(*[F.col(k).alias(n) for k, n in zip(keys, key, strict=True)], F.col(value).cast("double").alias("v"), (F.col(weight).cast("long") if weight else F.lit(1).cast("long")).alias("w"))
    rows = rows.groupBy(*key, "v").agg(F.sum("w").alias("w")) if weight else rows
    rows = materialize(rows, "percentile-values")
    spread = rows.groupBy(*key).agg(F.sum("w").alias("n"), F.count(F.lit(1)).alias("rows"), F.min("v").alias("low"), F.max("v").alias("high"))
    asked = spread.select(*key, "n", "rows", "low", "high", F.explode(F.array(*[F.lit(float(a)) for a in at])).alias("at")).withColumn("rank", F.col("at") * (F.col("n") - 1))
    asked = materialize(asked, "percentile-ranks")
    place = F.explode(F.array_distinct(F.array(F.floor("rank"), F.ceil("rank"))))
    open_ = asked.select(*key, place.alias("place"), "low", "high", F.lit(0).cast("long").alias("before"), "n", "rows").distinct()
    found = None
    while True:
        open_ = materialize(open_, "percentile-parts")
        done = open_.filter("low = high").select(*key, "place", F.col("low").alias("value"))
        few = open_.filter(F.col("low") < F.col("high")).filter(F.col("rows") <= enough)
        many = open_.filter(F.col("low") < F.col("high")).filter(F.col("rows") > enough)
        side = lambda x: F.broadcast(x) if small(open_) else x
        alike = [F.col(f"r.{k}").eqNullSafe(F.col(f"o.{k}")) for k in key] or [F.lit(True)]
        near = lambda x: rows.alias("r").join(side(x).alias("o"), alike).filter("r.v between o.low and o.high")
        sorted_ = near(few).groupBy(*[F.col(f"o.{k}").alias(k) for k in key], F.col("o.place").alias("place"), F.col("o.before").alias("before")).agg(F.array_sort(F.collect_list(F.struct("r.v", "r.w"))).alias("vs"))
        # The first value that those up to it reach beyond the place.
        reach = lambda s, x: F.when(s["v"].isNotNull(), s).otherwise(F.struct((s["n"] + x["w"]).alias("n"), F.when(s["n"] + x["w"] > F.col("place") - F.col("before"), x["v"]).alias("v")))
        nth = F.aggregate("vs", F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("v")), reach)["v"]
        done = done.unionByName(sorted_.select(*key, "place", nth.alias("value")))
        done = materialize(done, "percentile-found")
        found = done if found is None else found.unionByName(done)
        if many.isEmpty():
            break
        part = F.least(F.lit(bins - 1), F.floor((F.col("r.v") - F.col("o.low")) / (F.col("o.high") - F.col("o.low")) * bins)).cast("int")
        counts = near(many).groupBy(*[F.col(f"o.{k}").alias(k) for k in key], F.col("o.place").alias("place"), F.col("o.before").alias("start"), part.alias("part"))
        counts = counts.agg(F.sum("r.w").alias("n"), F.count(F.lit(1)).alias("rows"), F.min("r.v").alias("low"), F.max("r.v").alias("high"))
        upto = Window.partitionBy(*key, "place").orderBy("part")
        counts = counts.withColumn("before", F.col("start") + F.sum("n").over(upto) - F.col("n"))
        open_ = counts.filter((F.col("before") <= F.col("place")) & (F.col("place") < F.col("before") + F.col("n"))).select(*key, "place", "low", "high", "before", "n", "rows")
    ends = lambda name: found.select(*[F.col(k).alias(f"{name}{k}") for k in key], F.col("place").alias(f"{name}place"), F.col("value").alias(name))
    on = lambda name, rank: [F.col(k).eqNullSafe(F.col(f"{name}{k}")) for k in key] + [F.col(f"{name}place") == rank]
    out = asked.join(ends("low_"), on("low_", F.floor("rank"))).join(ends("high_"), on("high_", F.ceil("rank")))
    part = F.col("rank") - F.floor("rank")
    return out.select(*[F.col(n).alias(k) for k, n in zip(keys, key, strict=True)], "at", (F.col("low_") + part * (F.col("high_") - F.col("low_"))).alias("value"))
