"""Filters, sorts, search and the composed listings that users see."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavecrate.functions.text import relevance, search_match
from wavecrate.operators.genres import exploded
from wavecrate.params import NOT_FOUND
from wavecrate.plans.topk import top_k
from wavecrate.plans.visibility import preferred_bpm, reliable, visible


@dataclass(frozen=True)
class Filters:
    """The explorer's filters; what isn't set doesn't filter. A null value meets no bound."""

    in_lib: bool | None = None
    genres: tuple[str, ...] = ()
    bpm: tuple[float | None, float | None] = (None, None)
    keys: tuple[str, ...] = ()
    duration_ms: tuple[int | None, int | None] = (None, None)
    has_preview: bool | None = None
    years: tuple[int | None, int | None] = (None, None)
    label: str | None = None
    opinion: str | None = None

    def condition(self, bpm: str = "bpm", key: str = "key") -> Column:
        out = F.lit(True)
        if self.in_lib is not None:
            out = out & (F.col("in_lib") == self.in_lib)
        if self.genres:
            out = out & F.arrays_overlap("genres", F.array(*[F.lit(g) for g in self.genres]))
        for name, (low, high) in ((bpm, self.bpm), ("duration_ms", self.duration_ms)):
            out = out if low is None else out & (F.col(name) >= low)
            out = out if high is None else out & (F.col(name) <= high)
        if self.keys:
            out = out & F.col(key).isin(*self.keys)
        if self.has_preview is not None:
            out = out & (F.coalesce("has_preview", F.lit(False)) == self.has_preview)
        first, last = self.years  # as bounds on the date, so that a scan can use them
        out = out if first is None else out & (F.col("release_date") >= F.make_date(F.lit(first), F.lit(1), F.lit(1)))
        out = out if last is None else out & (F.col("release_date") < F.make_date(F.lit(last + 1), F.lit(1), F.lit(1)))
        if self.label:
            out = out & F.contains(F.lower("label"), F.lit(self.label.lower()))
        if self.opinion:
            out = out & (F.col("opinion").isNull() if self.opinion == "none" else F.col("opinion") == self.opinion)
        return out


def order_by(name: str, descending: bool) -> list[Column]:
    """A sort by one of the explorer's columns: nulls last both ways, ids follow the direction."""
    keys = {
        "title": [F.lower(F.trim("title"))],
        "label": [F.lower(F.nullif(F.trim("label"), F.lit("")))],
        "key": [F.length("key"), F.col("key")],
    }.get(name, [F.col(name)])
    way = (lambda c: c.desc_nulls_last()) if descending else (lambda c: c.asc_nulls_last())
    return [*map(way, keys), F.desc("id") if descending else F.asc("id")]


def analysis_candidate() -> Column:
    """Has a preview and a confirmed id, but neither a tempo nor an attempt at one."""
    return F.coalesce("has_preview", F.lit(False)) & F.col("bpm").isNull() & F.col("deezer_id").isNotNull() & (F.col("deezer_id") != NOT_FOUND) & F.col("searched_at").isNull()


def dominated(tracks: DataFrame, group: str, genre: str, percent: int = 25) -> DataFrame:
    """(group, hits, total) where at least that share of tracks carries the genre, in whole numbers."""
    hit = F.coalesce(F.array_contains("genres", genre), F.lit(False))
    return tracks.groupBy(group).agg(F.count(F.when(hit, True)).alias("hits"), F.count(F.lit(1)).alias("total")).filter((F.col("hits") > 0) & (F.col("hits") * 100 >= F.col("total") * percent))


def list_catalog(catalog: DataFrame, library: DataFrame, radar: DataFrame, sets: DataFrame, set_tracks: DataFrame, opinions: DataFrame, user_id: int) -> DataFrame:
    """Visible tracks with their counts, tempo and opinion for the viewer; every side is aggregated by track before it is joined."""
    own = library.filter(F.col("user_id") == user_id).select(F.col("catalog_id").alias("id"), "rb_bpm")
    lists = radar.filter("active").groupBy(F.col("catalog_id").alias("id")).agg(F.countDistinct("playlist_id").alias("n_lists"))
    played = set_tracks.filter("catalog_id is not null").join(sets.filter(reliable()).select(F.col("id").alias("set_id")), "set_id")
    n_sets = played.groupBy(F.col("catalog_id").alias("id")).agg(F.countDistinct("set_id").alias("n_sets"))
    said = opinions.filter(F.col("user_id") == user_id).select(F.col("entity_key").cast("long").alias("id"), "opinion")
    out = visible(catalog, library, user_id).join(own, "id", "left").join(lists, "id", "left").join(n_sets, "id", "left").join(said, "id", "left")
    return out.select("id", "title", "in_lib", preferred_bpm().alias("bpm_shown"), F.coalesce("n_lists", F.lit(0)).alias("n_lists"), F.coalesce("n_sets", F.lit(0)).alias("n_sets"), "opinion")


def list_artists(artists: DataFrame, links: DataFrame, catalog: DataFrame, radar: DataFrame) -> DataFrame:
    tracks = links.join(catalog.select(F.col("id").alias("catalog_id"), "has_preview"), "catalog_id", "left")
    n = tracks.groupBy(F.col("artist_id").alias("id")).agg(F.countDistinct("catalog_id").alias("tracks"), F.countDistinct(F.when(F.col("has_preview"), F.col("catalog_id"))).alias("previews"))
    members = radar.filter("active").select("playlist_id", "catalog_id").distinct()
    lists = members.join(links.select("catalog_id", "artist_id"), "catalog_id").groupBy(F.col("artist_id").alias("id")).agg(F.countDistinct("playlist_id").alias("playlists"))
    return artists.select("id", "name").join(n, "id", "left").join(lists, "id", "left").na.fill(0, ["tracks", "previews", "playlists"])


def search_all(q: str, catalog: DataFrame, artists: DataFrame, sets: DataFrame, playlists: DataFrame, radar: DataFrame, per_kind: int = 30) -> DataFrame:
    """(kind, id, name, relevance, popularity, rank) over all kinds: exact names first, then prefixes, then the rest, popular ones first."""
    lists = radar.filter("active").groupBy(F.col("catalog_id").alias("id")).agg(F.countDistinct("playlist_id").alias("popularity"))

    def kind(df: DataFrame, name: str, place: int, label: str, popularity: Column) -> DataFrame:
        hits = df.filter(search_match(q, F.col(label)))
        return hits.select(F.lit(name).alias("kind"), F.lit(place).alias("place"), F.col("id").cast("long").alias("id"), F.col(label).alias("name"), popularity.cast("long").alias("popularity"))

    genres = exploded(catalog).groupBy("genre").agg(F.count(F.lit(1)).alias("n")).withColumn("id", F.lit(None))
    every = (
        kind(catalog.join(lists, "id", "left"), "track", 0, "title", F.coalesce("popularity", F.lit(0)))
        .unionByName(kind(artists, "artist", 1, "name", F.round("fans")))
        .unionByName(kind(sets, "set", 2, "title", F.lit(0)))
        .unionByName(kind(playlists, "playlist", 3, "title", F.round("followers")))
        .unionByName(kind(genres, "genre", 4, "genre", F.col("n")))
    ).withColumn("relevance", relevance(q, F.col("name")))
    order = [F.desc("relevance"), F.desc("popularity")]
    shown = top_k(every, ["kind"], [*order, F.col("id"), F.col("name")], per_kind, "n")
    return top_k(shown.drop("n"), [], [*order, F.col("place"), F.col("id").asc_nulls_last(), F.col("name")], per_kind * 6).select("kind", "id", "name", "relevance", "popularity", "rank")


def random_one(rows: DataFrame, seed: int, without: int | None = None, ident: str = "id") -> DataFrame:
    """One row, drawn by chance, not ``without``; none of an empty table."""
    left = rows if without is None else rows.filter(F.col(ident) != without)
    return left.orderBy(F.rand(seed)).limit(1)


def taxonomy(nodes: DataFrame, query: str = "", limit: int = 50, offset: int = 0) -> DataFrame:
    """(id, label, total): a page of genre nodes whose label holds the query, by label; total counts them all."""
    q = query.strip().lower()
    found = nodes.filter(F.contains(F.lower("label"), F.lit(q))) if q else nodes
    total = found.agg(F.count(F.lit(1)).alias("total"))
    page = found.orderBy("label", "id").offset(offset).limit(limit)
    return page.crossJoin(F.broadcast(total)).select("id", "label", "total")
