"""Flags, part groups, virtual parents and their state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavecrate.functions.text import set_title, token_jaccard
from wavecrate.params import SetMatching
from wavecrate.plans.cooc import pair_counts
from wavecrate.plans.text_joins import token_join


def part_groups(sets: DataFrame, members: DataFrame, p: SetMatching = SetMatching()) -> DataFrame:
    """(channel, base_title, members, kind, confidence): sets of one channel whose titles differ in the part alone.

    ``sets``: id, channel, title, base_title, part, total, played_date. Valid if part
    numbers differ and totals agree; parts that share much are an anomaly.
    """
    g = sets.filter("part is not null").groupBy("channel", "base_title").agg(
        F.sort_array(F.collect_list("id")).alias("ids"),
        F.count(F.lit(1)).alias("members"),
        F.countDistinct("part").alias("parts"),
        F.countDistinct("total").alias("totals"),
        F.coalesce(F.datediff(F.max("played_date"), F.min("played_date")), F.lit(0)).alias("span"),
    )
    g = g.filter("members > 1 and parts = members and totals <= 1")
    each = g.select("channel", "base_title", F.explode("ids").alias("id")).join(sets.select("id", "title"), "id")
    held = members.filter("mtid is not null").select(F.col("set_id").alias("id"), "mtid").distinct()
    sizes = held.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    empty = each.join(sizes, "id", "left").groupBy("channel", "base_title").agg(F.count(F.when(F.col("n").isNull(), True)).alias("empty"))
    a = each.select("channel", "base_title", F.col("id").alias("a"), F.col("title").alias("ta"))
    b = each.select("channel", "base_title", F.col("id").alias("b"), F.col("title").alias("tb"))
    pairs = a.join(b, ["channel", "base_title"]).filter("a < b")
    tracks = held.join(each.select("id", "channel", "base_title"), "id").withColumn("item", F.concat_ws("|", "channel", "base_title", "mtid"))
    shared = pair_counts(tracks, "item", "id")
    n = sizes.select(F.col("id").alias("k"), "n")
    pairs = pairs.join(shared, ["a", "b"], "left").withColumnRenamed("n", "shared")
    pairs = pairs.join(n.select(F.col("k").alias("a"), F.col("n").alias("na")), "a", "left").join(n.select(F.col("k").alias("b"), F.col("n").alias("nb")), "b", "left")
    pairs = pairs.withColumn("overlap", F.coalesce(F.coalesce("shared", F.lit(0)) / F.nullif(F.least("na", "nb"), F.lit(0)), F.lit(0.0)))
    worst = pairs.groupBy("channel", "base_title").agg(F.max("overlap").alias("overlap"), F.min(token_jaccard(F.col("ta"), F.col("tb"))).alias("sim"))
    out = g.join(worst, ["channel", "base_title"]).join(empty, ["channel", "base_title"])
    bonus = F.when(F.col("totals") == 1, 0.05).otherwise(0.0) + F.when(F.col("span") <= 1, 0.03).otherwise(0.0)
    confidence = F.bround(F.col("sim") + bonus - F.when(F.col("span") > 60, 0.10).otherwise(0.0) - 0.05 * F.col("empty"), 4)
    kind = F.when(F.col("overlap") > p.part_overlap, "part_overlap_anomaly").otherwise("part_candidate")
    return out.select("channel", "base_title", "members", kind.alias("kind"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)).alias("confidence"))


def similar_titles(sets: DataFrame, p: SetMatching = SetMatching()) -> DataFrame:
    """(a, b, jaccard) of base titles that are nearly the same."""
    titles = sets.groupBy("base_title").agg(F.min("id").alias("id"))
    return token_join(titles.withColumn("tokens", F.filter(F.split("base_title", r"\s+"), lambda t: t != "")), "id", "tokens", p.part_title)


def new_flags(pairs: DataFrame, existing: DataFrame) -> DataFrame:
    """(a, b, confidence): flags to raise, one a pair whatever its order, none that was raised before."""
    each = pairs.filter("verdict = 'flag'").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "confidence")
    return each.groupBy("a", "b").agg(F.max("confidence").alias("confidence")).join(existing.select("a", "b"), ["a", "b"], "left_anti")


def rescored(flags: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, confidence, status): pending flags with their pair's present score; below the verdict they are rejected."""
    x = flags.join(pairs.select("a", "b", F.col("confidence").alias("now"), "verdict"), ["a", "b"], "left")
    drop = (F.col("status") == "pending") & (F.coalesce("verdict", F.lit("nothing")) == "nothing")
    return x.select("a", "b", F.coalesce("now", "confidence").alias("confidence"), F.when(drop, "rejected").otherwise(F.col("status")).alias("status"))


def detached(children: DataFrame, gone: DataFrame) -> DataFrame:
    """(set_id, parent): children after some leave; a parent with one child or none left goes. ``children``: set_id, parent; ``gone``: set_id."""
    left = children.join(gone.select("set_id"), "set_id", "left_anti")
    alive = left.groupBy("parent").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("parent")
    return left.join(alive, "parent", "left_semi").select("set_id", "parent")


def part_changes(sets: DataFrame) -> DataFrame:
    """(id, part_number, part_total): sets whose stored part differs from what the title says. ``sets``: id, title, part_number, part_total."""
    x = sets.withColumn("t", set_title(F.col("title")))
    same = F.col("part_number").eqNullSafe(F.col("t.part_number")) & F.col("part_total").eqNullSafe(F.col("t.part_total"))
    return x.filter(~same).select("id", "t.part_number", "t.part_total")


def source_url(url: Column, slug: Column, prefix: str) -> Column:
    """A lost address made anew from the slug."""
    return F.coalesce(url, F.concat(F.lit(prefix), slug))


def flag_listing(flags: DataFrame, sets: DataFrame, status: str, limit: int, offset: int = 0) -> DataFrame:
    """(id, title_a, title_b, confidence, member_titles, total): a page of flags of one status, surest first, unknown confidence last, then newest.

    ``flags``: id, a, b, confidence, status, created_at, members (array of set ids or
    null); ``sets``: id, title. A flag needs its first set; titles of members follow
    their order, unknown ones as empty texts. total counts all flags of the status.
    """
    chosen = flags.filter(F.col("status") == status)
    total = chosen.agg(F.count(F.lit(1)).alias("total"))
    a, b = (sets.select(F.col("id").alias(n), F.col("title").alias(f"title_{n}")) for n in "ab")
    order = [F.col("confidence").desc_nulls_last(), F.desc("created_at"), F.col("id")]
    page = chosen.join(a, "a").join(b, "b", "left").orderBy(*order).offset(offset).limit(limit)
    each = page.select("id", F.posexplode("members").alias("pos", "member")).join(sets.select(F.col("id").alias("member"), "title"), "member", "left")
    entry = F.struct("pos", F.coalesce("title", F.lit("")).alias("title"))
    titles = each.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["title"]).alias("member_titles"))
    out = page.join(titles, "id", "left").crossJoin(F.broadcast(total))
    return out.select("id", F.coalesce("title_a", F.lit("")).alias("title_a"), "title_b", "confidence", F.coalesce("member_titles", F.array().cast("array<string>")).alias("member_titles"), "total")
