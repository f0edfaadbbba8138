"""Duplicate tracks and sets: pairs, verdicts, clusters, canonical rows and merges."""

from __future__ import annotations

import math
from collections import OrderedDict, defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavecrate.functions.text import token_jaccard, track_title
from wavecrate.params import NOT_FOUND, SetMatching
from wavecrate.plans.cooc import overlapping
from wavecrate.plans.topk import one_per, top_k
from wavecrate.scratch import materialize
from wavecrate.shipping import ship


def same_track(a: str, b: str) -> Column:
    """Both recordings codes: equal ones; else equal conservative titles. ``a`` and ``b`` are structs with isrc and title."""
    codes = F.nullif(F.col(f"{a}.isrc"), F.lit("")).isNotNull() & F.nullif(F.col(f"{b}.isrc"), F.lit("")).isNotNull()
    return F.when(codes, F.col(f"{a}.isrc") == F.col(f"{b}.isrc")).otherwise(track_title(F.col(f"{a}.title")) == track_title(F.col(f"{b}.title")))


def canonical_order() -> list[Column]:
    """Recording code first, then the oldest, the most complete, the least id."""
    filled = [F.col(c).isNotNull().cast("int") for c in ("bpm", "key", "duration_ms", "label", "release_date")]
    flags = [F.coalesce(F.col(c), F.lit(False)).cast("int") for c in ("has_artwork", "has_preview")]
    complete = sum(flags, sum(filled, F.lit(0)))
    return [F.nullif("isrc", F.lit("")).isNull(), F.col("created_at").asc_nulls_last(), complete.desc(), F.col("id")]


def pick_canonical(rows: DataFrame, cluster: list[str]) -> DataFrame:
    return one_per(rows, cluster, canonical_order())


def _clusters(rows: list[tuple[int, str | None, str]]) -> dict[int, int]:
    """{id: first id of its cluster} of rows (id, code or None, title) by rising id, each row taken up once.

    A cluster with a row without a code has one title, and one code among the rows
    that have one; else it has one code and any titles. Which of the two a row with a
    code begins is settled by the next row that would join it.
    """
    coded: dict[str, OrderedDict[int, str]] = defaultdict(OrderedDict)  # by code: id to title
    named: dict[str, OrderedDict[int, str]] = defaultdict(OrderedDict)  # by title: id to code
    plain: dict[str, OrderedDict[int, None]] = defaultdict(OrderedDict)  # by title, rows without a code
    both: dict[tuple[str, str], OrderedDict[int, None]] = defaultdict(OrderedDict)
    for ident, code, title in rows:
        if code is None:
            plain[title][ident] = None
        else:
            coded[code][ident], named[title][ident], both[code, title][ident] = title, code, None
    codes, titles = {r[0]: r[1] for r in rows}, {r[0]: r[2] for r in rows}
    out: dict[int, int] = {}

    def take(idents: list[int], first: int) -> None:
        for ident in idents:
            out[ident] = first
            code, title = codes[ident], titles[ident]
            if code is None:
                del plain[title][ident]
            else:
                del coded[code][ident], named[title][ident], both[code, title][ident]

    for ident, code, title in rows:
        if ident in out:
            continue
        take([ident], ident)
        if code is None:
            code = next(iter(named[title].values()), None)
        else:
            other = next((i for i, t in coded[code].items() if t != title), None)
            if other is not None and other < next(iter(plain[title]), math.inf):
                take(list(coded[code]), ident)
                continue
        if code is not None:
            take(list(both[code, title]), ident)
        take(list(plain[title]), ident)
    return out


def cliques(rows: DataFrame, group: str) -> DataFrame:
    """(group, id, cluster): rows of a group (sharing a platform id) by whether they are one recording.

    In order of id, a row joins the first cluster all of whose members are the same
    track; cluster is its first member's id. A group is held by one task, which takes
    up each of its rows once, so its time is in proportion to its rows. Rows without a
    platform id, or marked as not found, are in no group.
    """
    ship(rows.sparkSession)

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        found = _clusters([(int(i), c if isinstance(c, str) and c else None, t) for i, c, t in zip(pdf["id"], pdf["isrc"], pdf["plain"], strict=True)])
        return pd.DataFrame({group: pdf[group].iloc[0], "id": list(found), "cluster": list(found.values())})

    need = rows.filter(F.col(group) != NOT_FOUND).select(group, F.col("id").cast("long").alias("id"), "isrc", track_title(F.col("title")).alias("plain"))
    kind = rows.schema[group].dataType.simpleString()
    return need.groupBy(group).applyInPandas(cluster, f"{group} {kind}, id long, cluster long")


def merge_tracks(rows: DataFrame, cluster: str) -> DataFrame:
    """One row per cluster: the canonical one with gaps filled from the others, genres united, flags or-ed, attempts and dates at their latest, shared if any is."""
    w = Window.partitionBy(cluster).orderBy(*canonical_order())
    ranked = rows.withColumn("__n", F.row_number().over(w))
    fill = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("__n"))).alias(c) for c in ("bpm", "key", "duration_ms", "label", "release_date", "isrc")]
    genres = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("__n", F.coalesce("genres", F.array().cast("array<string>")).alias("g")))), lambda x: x["g"])))
    return ranked.groupBy(cluster).agg(
        F.min_by("id", "__n").alias("id"),
        F.min_by("title", "__n").alias("title"),
        *fill,
        genres.alias("genres"),
        F.max(F.coalesce("has_artwork", F.lit(False))).alias("has_artwork"),
        F.max(F.coalesce("has_preview", F.lit(False))).alias("has_preview"),
        F.max("attempts").alias("attempts"),
        F.max("searched_at").alias("searched_at"),
        F.when(F.max(F.col("scope") == "shared"), "shared").otherwise("private").alias("scope"),
        F.count(F.lit(1)).alias("merged"),
    )


def set_pairs(sets: DataFrame, members: DataFrame, p: SetMatching = SetMatching()) -> DataFrame:
    """Signals, confidence and verdict of all pairs of sets with enough shared tracks.

    ``sets``: id, title, played_date, part; ``members``: set_id, mtid, position.
    Shared tracks are distinct ones; lengths count repeats.
    """
    held = members.filter("mtid is not null")
    sizes = held.groupBy("set_id").agg(F.count(F.lit(1)).alias("len"), F.min_by("mtid", "position").alias("opener"))
    first = held.groupBy("set_id", "mtid").agg(F.min("position").alias("pos"))
    df = first.groupBy("mtid").agg(F.count(F.lit(1)).alias("df"))
    first = materialize(first.join(df, "mtid").withColumn("w", 1 / F.log2(1 + F.greatest("df", F.lit(1)).cast("double"))).select("set_id", "mtid", "pos", "w"), "first-places")
    mass = first.groupBy("set_id").agg(F.sum("w").alias("mass"))
    a = first.select(F.col("set_id").alias("a"), "mtid", F.col("pos").alias("pos_a"), "w")
    b = first.select(F.col("set_id").alias("b"), "mtid", F.col("pos").alias("pos_b"))
    # Only pairs with enough in common are spelled out, track by track.
    pairs = materialize(overlapping(first, "mtid", "set_id", p.min_shared).select("a", "b"), "overlapping-sets")
    shared = pairs.join(a, "a").join(b, ["b", "mtid"])
    # Everything about a pair sits in one partition from here: count, ranks and sums need no further shuffle.
    by = Window.partitionBy("a", "b")
    ranked = shared.withColumn("n", F.count(F.lit(1)).over(by))
    ranked = ranked.withColumn("d", F.row_number().over(by.orderBy("pos_a", "mtid")) - F.row_number().over(by.orderBy("pos_b", "mtid")))
    n = F.max("n").cast("double")
    pairs = ranked.groupBy("a", "b").agg(F.max("n").alias("shared"), F.sum("w").alias("w"), (1 - 6 * F.sum(F.col("d") * F.col("d")) / (n * (n * n - 1))).alias("order_corr"))
    info = sets.join(sizes, sets["id"] == sizes["set_id"]).drop("set_id").join(mass, F.col("id") == F.col("set_id")).drop("set_id")
    side = lambda s: info.select(*[F.col(c).alias(f"{c}_{s}") for c in ("id", "title", "played_date", "part", "len", "opener", "mass")])
    x = pairs.join(side("a"), F.col("a") == F.col("id_a")).join(side("b"), F.col("b") == F.col("id_b"))
    gap = F.abs(F.datediff("played_date_a", "played_date_b"))
    small = F.when(F.col("len_a") <= F.col("len_b"), F.col("mass_a")).otherwise(F.col("mass_b"))
    x = x.select(
        "a",
        "b",
        "shared",
        (F.col("shared") / F.least("len_a", "len_b")).alias("overlap"),
        F.coalesce(F.col("w") / F.nullif(small, F.lit(0.0)), F.lit(0.0)).alias("weighted"),
        token_jaccard(F.coalesce("title_a", F.lit("")), F.coalesce("title_b", F.lit(""))).alias("title_sim"),
        gap.alias("gap"),
        (F.col("opener_a") == F.col("opener_b")).alias("same_opener"),
        "order_corr",
        "part_a",
        "part_b",
    )
    base = p.w_overlap * F.col("weighted") + p.w_title * F.col("title_sim") + p.w_order * F.greatest(F.col("order_corr"), F.lit(0.0)) + p.w_first * F.col("same_opener").cast("double")
    factor = F.when(F.col("gap").isNull(), 1.0).when(F.col("gap") <= 1, 1.15).when(F.col("gap") == 2, 1.0).when(F.col("gap") <= 30, 0.6).otherwise(0.3)
    x = x.withColumn("confidence", F.least(F.lit(1.0), F.bround(base * factor, 4)))
    apart = F.coalesce(F.col("part_a") != F.col("part_b"), F.lit(False))
    match = (F.col("overlap") >= p.attach_overlap) & ((F.col("title_sim") >= p.attach_title) | F.coalesce(F.col("gap") <= 1, F.lit(False)))
    flag = (F.col("confidence") >= p.flag_confidence) | ((F.col("title_sim") >= p.flag_title) & (F.col("overlap") >= p.flag_overlap))
    verdict = F.when(apart, "nothing").when(match & F.coalesce(F.col("gap") > p.attach_max_gap, F.lit(False)), "flag").when(match, "attach").when(flag, "flag").otherwise("nothing")
    return x.withColumn("verdict", verdict).drop("part_a", "part_b")


def attach_groups(pairs: DataFrame, rounds: int = 30) -> DataFrame:
    """(set_id, parent) of sets joined by attach verdicts: the least set reachable.

    Labels spread along the pairs and halve their paths until none changes.
    """
    edges = materialize(pairs.select("a", "b").union(pairs.select("b", "a")).toDF("x", "y").distinct(), "attach-pairs")
    labels = materialize(edges.select(F.col("x").alias("node")).distinct().withColumn("label", F.col("node")), "attach-labels")
    before = None
    for _ in range(rounds):
        near = edges.join(labels, F.col("y") == F.col("node")).groupBy("x").agg(F.min("label").alias("near"))
        labels = labels.join(near, F.col("node") == F.col("x"), "left").select("node", F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        labels = materialize(labels.join(up, "label").select("node", F.col("above").alias("label")), "attach-labels")
        mark = labels.agg(F.sum("label"), F.count(F.lit(1))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"groups did not settle in {rounds} rounds")
    return labels.select(F.col("node").alias("set_id"), F.col("label").alias("parent"))


def divergent(catalog: DataFrame, links: DataFrame, artists: DataFrame) -> DataFrame:
    """(id, artist, linked): tracks whose flat artist and first linked artist have nothing in common."""
    first = links.groupBy("catalog_id").agg(F.min_by("artist_id", F.struct(F.coalesce("position", F.lit(2_147_483_647)), "artist_id")).alias("artist_id"))
    named = first.join(artists.select(F.col("id").alias("artist_id"), F.col("name").alias("linked")), "artist_id")
    both = catalog.join(named, catalog["id"] == named["catalog_id"]).select("id", "artist", "linked")
    a, b = F.lower(F.trim("artist")), F.lower(F.trim("linked"))
    return both.filter((a != "") & (b != "") & ~F.contains(a, b) & ~F.contains(b, a))


def unlinked(catalog: DataFrame, links: DataFrame) -> DataFrame:
    return catalog.join(links.select(F.col("catalog_id").alias("id")), "id", "left_anti")


def reconcile(library: DataFrame, streaming: DataFrame, located: DataFrame) -> DataFrame:
    """(playlist, key, issue): what the streaming side has and the library lacks, the reverse, and what lies elsewhere.

    Frames: (playlist, key); ``located`` is (key, playlist) of the whole library.
    """
    both = library.withColumn("l", F.lit(True)).join(streaming.withColumn("s", F.lit(True)), ["playlist", "key"], "full_outer")
    elsewhere = located.groupBy("key").agg(F.min("playlist").alias("found"))
    issue = F.when(F.col("l").isNull() & F.col("found").isNotNull(), "MISPLACED").when(F.col("l").isNull(), "DOWNLOAD_NEEDED").when(F.col("s").isNull(), "ANOMALY")
    return both.join(elsewhere, "key", "left").select("playlist", "key", issue.alias("issue")).filter("issue is not null")


def first_holder(claims: DataFrame, catalog: DataFrame) -> DataFrame:
    """(id, holder): of the rows that hold a claimed platform id and are the same track, the least; claims without one have no row.

    ``claims``: id, platform_id, isrc, title; ``catalog``: id, platform_id, isrc, title.
    A claim with a code looks among the holders of its code and, by title, among those
    without one; a claim without looks by title among all. Only the two smallest ids
    of each kind are kept, as one may be the claim's own: holders are not paired.
    """
    code, plain = F.nullif("isrc", F.lit("")).alias("code"), track_title(F.col("title")).alias("plain")
    a = materialize(claims.filter(F.col("platform_id").isNotNull()).select("id", "platform_id", code, plain), "claims")
    b = materialize(catalog.filter(F.col("platform_id").isNotNull()).select(F.col("id").alias("other"), "platform_id", code, plain), "holders")

    def least(rows: DataFrame, key: str, name: str) -> DataFrame:
        """(platform_id, key, name): the two smallest ids."""
        rows = rows.filter(F.col(key).isNotNull()).select("platform_id", key, "other").distinct()
        two = top_k(rows, ["platform_id", key], [F.col("other")], 2, "nth").groupBy("platform_id", key)
        return two.agg(F.struct(F.min("other").alias("a"), F.max("other").alias("b")).alias(name))

    def not_own(name: str) -> Column:
        x = F.col(name)
        return F.when(x["a"] != F.col("id"), x["a"]).when(x["b"] != F.col("id"), x["b"])

    coded = a.filter("code is not null").join(least(b, "code", "x"), ["platform_id", "code"], "left").join(least(b.filter("code is null"), "plain", "y"), ["platform_id", "plain"], "left")
    bare = a.filter("code is null").join(least(b, "plain", "x"), ["platform_id", "plain"])
    out = coded.select("id", F.least(not_own("x"), not_own("y")).alias("holder")).unionByName(bare.select("id", not_own("x").alias("holder")))
    return out.filter("holder is not null").groupBy("id").agg(F.min("holder").alias("holder"))
