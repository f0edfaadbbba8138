"""What outside records may change, and which of them are the same recording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavecrate.functions.text import strip_safe_suffixes, title_key, track_title
from wavecrate.operators.artists import folded
from wavecrate.patterns import FLAT_ARTISTS
from wavecrate.plans.topk import one_per, top_k


def hit_matches(pairs: DataFrame) -> DataFrame:
    """Adds ``ok``: whether a hit names the wanted recording. ``pairs``: isrc, artist, title, hit_isrc, hit_artist, hit_title.

    Codes on both sides decide; else the artists overlap and the titles are equal but for formatting.
    """
    x = pairs.withColumns({"__a": F.coalesce("artist", F.lit("")), "__h": F.coalesce("hit_artist", F.lit("")), "__t": track_title(F.col("title")), "__u": track_title(F.col("hit_title"))})
    for c in ("__a", "__h", "__t", "__u"):
        x = folded(x, c, c)
    names = lambda c: F.filter(F.transform(F.split(c, FLAT_ARTISTS), lambda t: F.trim(t)), lambda t: t != "")
    overlap = F.exists(names("__a"), lambda w: F.exists(names("__h"), lambda g: F.contains(g, w) | F.contains(w, g)))
    artist = (F.col("__a") == "") | overlap
    t, u = title_key(F.col("__t")), title_key(F.col("__u"))
    codes = F.nullif("isrc", F.lit("")).isNotNull() & F.nullif("hit_isrc", F.lit("")).isNotNull()
    ok = F.when(codes, F.col("isrc") == F.col("hit_isrc")).otherwise(artist & (u != "") & (t == u))
    return x.withColumn("ok", F.coalesce(ok, F.lit(False))).drop("__a", "__h", "__t", "__u")


def queries_of(title: Column, artist: Column) -> Column:
    """The searches to try in turn: as given, without safe suffixes, by title alone, by artist and bare title."""
    bare = F.coalesce(strip_safe_suffixes(title), title)
    return F.array_distinct(F.array(F.concat_ws(" ", artist, title), F.concat_ws(" ", artist, bare), title, bare))


def best_hit(matched: DataFrame) -> DataFrame:
    """The first strategy's first confirmed hit of each track: id, strategy, seq, hit_id, ok."""
    return one_per(matched.filter("ok"), ["id"], [F.col("strategy"), F.col("seq")]).select("id", "hit_id", "strategy")


def apply_record(catalog: DataFrame, records: DataFrame) -> DataFrame:
    """Catalog rows after a confirmed outside record: tempo and key are overwritten unless they come from there, the rest only filled.

    A private row that gets an id becomes shared. ``records``: id, record_id, bpm, key, label, genre, release_date (prefix r_).
    """
    x = catalog.join(records, "id", "left")
    hit = F.col("r_record_id").isNotNull()
    bpm = hit & F.col("r_bpm").isNotNull() & (F.coalesce("bpm_source", F.lit("")) != "beatport")
    key = hit & F.col("r_key").isNotNull() & (F.coalesce("key_source", F.lit("")) != "beatport")
    genre = (F.coalesce(F.size("genres"), F.lit(0)) == 0) & F.col("r_genre").isNotNull()
    promoted = hit & (F.col("scope") == "private")
    changes = {
        "bpm": F.when(bpm, F.col("r_bpm")).otherwise(F.col("bpm")),
        "bpm_source": F.when(bpm, "beatport").otherwise(F.col("bpm_source")),
        "key": F.when(key, F.col("r_key")).otherwise(F.col("key")),
        "key_source": F.when(key, "beatport").otherwise(F.col("key_source")),
        "label": F.coalesce("label", F.left("r_label", F.lit(255))),
        "genres": F.when(genre, F.array(F.left("r_genre", F.lit(100)))).otherwise(F.col("genres")),
        "release_date": F.coalesce("release_date", "r_release_date"),
        "scope": F.when(promoted, "shared").otherwise(F.col("scope")),
        "owner_id": F.when(~promoted, F.col("owner_id")),
    }
    return x.select(*[changes[c].alias(c) if c in changes else F.col(c) for c in catalog.columns])


def resolve(wanted: DataFrame, table: DataFrame, aliases: DataFrame) -> DataFrame:
    """(row_id, id, how): by platform id, else by name, else by alias, else new.

    ``wanted``: row_id, platform_id, name; ``table``: id, platform_id, name; ``aliases``: alias, id.
    """
    first = lambda df, key, out: df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("id").alias(out))
    x = wanted.join(first(table, "platform_id", "i"), "platform_id", "left").join(first(table, "name", "j"), "name", "left")
    x = x.join(first(aliases.withColumnRenamed("alias", "name"), "name", "k"), "name", "left")
    how = F.when(F.col("i").isNotNull(), "platform").when(F.col("j").isNotNull(), "name").when(F.col("k").isNotNull(), "alias").otherwise("new")
    return x.select("row_id", F.coalesce("i", "j", "k").alias("id"), how.alias("how"))


def suspect_ids(cliques: DataFrame, group: str) -> DataFrame:
    """Platform ids that stand on two recordings or more: all their rows are suspect. ``cliques``: group, id, cluster."""
    wide = cliques.groupBy(group).agg(F.countDistinct("cluster").alias("n")).filter("n > 1").select(group)
    return cliques.join(wide, group, "left_semi")


def reset_suspects(catalog: DataFrame, suspects: DataFrame) -> DataFrame:
    """Suspect rows lose the id, their search state and what came with it."""
    x = catalog.join(suspects.select("id").distinct().withColumn("__bad", F.lit(True)), "id", "left")
    bad = F.coalesce("__bad", F.lit(False))
    cleared = {"deezer_id", "searched_at"}
    out = []
    for c in catalog.columns:
        if c in cleared:
            out.append(F.when(~bad, F.col(c)).alias(c))
        elif c == "attempts":
            out.append(F.when(bad, 0).otherwise(F.col(c)).cast("int").alias(c))
        elif c == "has_preview":
            out.append(F.when(bad, False).otherwise(F.col(c)).alias(c))
        elif c in ("bpm", "key") and f"{c}_source" in catalog.columns:
            out.append(F.when(bad & (F.col(f"{c}_source") == "beatport"), None).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return x.select(*out)


def import_binding(incoming: DataFrame, catalog: DataFrame, user: str = "user_id") -> DataFrame:
    """(row_id, id, action): where an imported track goes. ``incoming``: row_id, user, key; ``catalog``: id, key, scope, owner_id."""
    x = incoming.join(catalog.select("id", "key", "scope", "owner_id"), "key", "left")
    action = F.when(F.col("id").isNull(), "create_private").when(F.col("scope") == "shared", "reuse_shared").when(F.col("owner_id") == F.col(user), "refresh_own").otherwise("reuse_foreign")
    return x.select("row_id", "id", action.alias("action"))


def propagate(opinions: DataFrame) -> DataFrame:
    """(user_id, catalog_id, opinion, status): a track's state that follows from each opinion."""
    status = F.when(F.col("opinion") == "liked", "added").when(F.col("opinion") == "disliked", "ignored").otherwise("new")
    return opinions.select("user_id", F.col("entity_key").try_cast("long").alias("catalog_id"), "opinion", status.alias("status"))


def get_or_create(catalog: DataFrame, incoming: DataFrame) -> DataFrame:
    """(row_id, id, created): by recording code, else by key; unknown keys get one new id each, after the greatest.

    ``incoming``: row_id, isrc, key; ``catalog``: id, isrc, key.
    """
    code = catalog.filter("isrc is not null").groupBy("isrc").agg(F.min("id").alias("i"))
    name = catalog.groupBy("key").agg(F.min("id").alias("j"))
    x = incoming.join(code, "isrc", "left").join(name, "key", "left").withColumn("known", F.coalesce("i", "j"))
    fresh = x.filter("known is null").groupBy("key").agg(F.min("row_id").alias("first"))
    # New keys are numbered in parts by hash, each after the sizes of those before.
    parts = 64
    dealt = fresh.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over at most ``parts`` rows
    starts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    most = catalog.agg(F.coalesce(F.max("id"), F.lit(0)).alias("most"))
    new = dealt.withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy("first"))).join(F.broadcast(starts), "part").crossJoin(F.broadcast(most))
    new = new.select("key", (F.col("most") + F.col("start") + F.col("nth")).alias("new_id"))
    out = x.join(new, "key", "left")
    return out.select("row_id", F.coalesce("known", "new_id").alias("id"), F.col("known").isNull().alias("created"))


def expand_releases(albums: DataFrame, done: DataFrame, as_of: Column, horizon: int = 30, cap: int = 40) -> DataFrame:
    """(artist_id, album_id, track, place): tracks of recent albums, one activity each, none that is there already.

    ``albums``: artist_id, album_id, released (text), tracks (array); albums without a date are left out.
    """
    released = F.col("released").try_cast("date")
    recent = albums.filter((released <= as_of) & (released > F.date_sub(as_of, horizon)))
    each = recent.select("artist_id", "album_id", F.posexplode(F.slice("tracks", 1, cap)).alias("place", "track"))
    return each.join(done, ["artist_id", "track"], "left_anti").select("artist_id", "album_id", "track", "place")


def merge_external(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both sources; of one recording code only the first source's stays, rows without a code all do."""
    codes = a.filter("isrc is not null").select("isrc").distinct()
    return a.unionByName(b.filter("isrc is null")).unionByName(b.filter("isrc is not null").join(codes, "isrc", "left_anti").select(*b.columns))


def followed_news(activity: DataFrame, followed: DataFrame, as_of: Column, hours: int = 48) -> DataFrame:
    """Activity of followed artists in the last hours: artist_id, at and more."""
    recent = activity.filter(F.col("at") >= as_of - F.make_dt_interval(F.lit(0), F.lit(hours)))
    return recent.join(followed.select("artist_id").distinct(), "artist_id", "left_semi")


def pages(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return top_k(rows.orderBy(*order).offset(offset).limit(limit), [], order, limit, "place")
