"""Visibility, filters, search, genre statistics and composed listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecrate.functions import text as X
from wavecrate.operators import genres as G
from wavecrate.operators import listings as V
from wavecrate.plans.closure import ancestors, ancestors_sql, node_weights, pillars
from wavecrate.plans.topk import one_per, top_k
from wavecrate.plans.visibility import preferred_bpm, root_sets, visible
from wavecrate.queries.registry import query
from wavecrate.queries.scoring import PILLAR_SQL
from wavecrate.testbed import Bed

SEEN = "SELECT c.*, l.catalog_id IS NOT NULL AS in_lib, l.rb_bpm FROM catalog c LEFT JOIN (SELECT * FROM library WHERE user_id = 5) l ON l.catalog_id = c.id WHERE c.scope = 'shared' OR c.owner_id = 5 OR l.catalog_id IS NOT NULL"


@query("SELECT id, scope, in_lib FROM (" + SEEN + ") v")
def B01_visible_catalog(b: Bed) -> DataFrame:
    return visible(b.catalog, b.library, 5).select("id", "scope", "in_lib")


@query("SELECT id, FALSE AS in_lib FROM catalog WHERE scope = 'shared'")
def B01_guest_catalog(b: Bed) -> DataFrame:
    return visible(b.catalog, b.library, None).select("id", "in_lib")


@query("SELECT id, title FROM sets WHERE parent_set_id IS NULL AND unreliable IS NOT TRUE")
def B02_root_reliable_sets(b: Bed) -> DataFrame:
    return root_sets(b.sets).select("id", "title")


@query(
    "SELECT id, title, bpm_shown FROM (SELECT v.*, coalesce(rb_bpm, bpm) AS bpm_shown FROM ("
    + SEEN
    + ") v) w WHERE list_has_any(genres, ['red', 'ring', 'promo']) AND bpm_shown BETWEEN 90 AND 150 AND key IN ('1A', '2A', '3B', '8A', '9B') AND duration_ms BETWEEN 130000 AND 340000 AND has_preview AND release_date >= DATE '1995-01-01' AND release_date < DATE '2016-01-01'"
)
def B04_explorer_filters(b: Bed) -> DataFrame:
    own = b.library.filter("user_id = 5").select(F.col("catalog_id").alias("id"), "rb_bpm")
    seen = visible(b.catalog, b.library, 5).join(own, "id", "left").withColumn("bpm_shown", preferred_bpm())
    f = V.Filters(genres=("red", "ring", "promo"), bpm=(90, 150), keys=("1A", "2A", "3B", "8A", "9B"), duration_ms=(130_000, 340_000), has_preview=True, years=(1995, 2015))
    return seen.filter(f.condition(bpm="bpm_shown")).select("id", "title", "bpm_shown")


@query(
    "SELECT id, title FROM catalog WHERE (contains(lower(title), 'd bo') OR contains(replace(lower(title), ' ', ''), 'dbo')) OR (contains(lower(artist), 'd bo') OR contains(replace(lower(artist), ' ', ''), 'dbo'))"
)
def B05_compact_search(b: Bed) -> DataFrame:
    return b.catalog.filter(X.search_match("D bo", F.col("title"), F.col("artist"))).select("id", "title")


@query("SELECT id FROM catalog WHERE list_contains(list_transform(genres, lambda x: lower(x)), 'red') AND bpm >= 100 AND year(release_date) BETWEEN 2000 AND 2010")
def B08_feed_filters(b: Bed) -> DataFrame:
    return b.catalog.filter(F.exists("genres", lambda g: F.lower(g).isin("red")) & (F.col("bpm") >= 100) & F.year("release_date").between(2000, 2010)).select("id")


@query("SELECT id FROM catalog WHERE list_contains(genres, 'gear')")
def B09_array_membership(b: Bed) -> DataFrame:
    return b.catalog.filter(F.array_contains("genres", "gear")).select("id")


@query("SELECT id FROM catalog WHERE genres IS NULL OR len(genres) = 0")
def B10_no_genres(b: Bed) -> DataFrame:
    return b.catalog.filter(F.coalesce(F.size("genres"), F.lit(0)) == 0).select("id")


@query("SELECT id FROM catalog WHERE has_preview AND bpm IS NULL AND deezer_id IS NOT NULL AND deezer_id <> 'NOT_FOUND' AND searched_at IS NULL")
def B13_analysis_candidates(b: Bed) -> DataFrame:
    return b.catalog.filter(V.analysis_candidate()).select("id")


@query("SELECT lower(g) AS folded, min(g) AS genre FROM (SELECT unnest(genres) AS g FROM catalog) x GROUP BY 1")
def B16_canonical_genre(b: Bed) -> DataFrame:
    return G.exploded(b.catalog).groupBy(F.lower("genre").alias("folded")).agg(F.min("genre").alias("genre"))


@query(
    "SELECT c.id, count(DISTINCT r.playlist_id) FILTER (WHERE r.active) AS n_lists FROM catalog c LEFT JOIN radar_tracks r ON r.catalog_id = c.id GROUP BY c.id"
)
def D01_playlists_per_track(b: Bed) -> DataFrame:
    counts = b.radar_tracks.filter("active").groupBy(F.col("catalog_id").alias("id")).agg(F.countDistinct("playlist_id").alias("n_lists"))
    return b.catalog.select("id").join(counts, "id", "left").na.fill(0)


@query(
    """SELECT genre, count(DISTINCT id) AS tracks, count(DISTINCT lower(artist)) AS artists, CAST(coalesce(round_even(quantile_cont(bpm, 0.05), 0), 0) AS INT) AS bpm_low,
       CAST(coalesce(round_even(quantile_cont(bpm, 0.95), 0), 0) AS INT) AS bpm_high FROM (SELECT id, artist, bpm, unnest(genres) AS genre FROM catalog) x GROUP BY genre"""
)
def D03_genre_stats(b: Bed) -> DataFrame:
    return G.genre_stats(b.catalog)


@query(
    "SELECT t.set_id FROM set_tracks t JOIN catalog c ON c.id = t.catalog_id GROUP BY t.set_id HAVING count(*) FILTER (WHERE list_contains(coalesce(c.genres, []), 'red')) * 100 >= count(*) * 25 AND count(*) FILTER (WHERE list_contains(coalesce(c.genres, []), 'red')) > 0"
)
def D08_dominant_in_sets(b: Bed) -> DataFrame:
    tracks = b.set_tracks.join(b.catalog.select(F.col("id").alias("catalog_id"), "genres"), "catalog_id")
    return V.dominated(tracks, "set_id", "red").select("set_id")


@query(
    "SELECT playlist_id FROM (SELECT DISTINCT r.playlist_id, c.id, coalesce(list_contains(c.genres, 'ring'), FALSE) AS hit FROM radar_tracks r JOIN catalog c ON c.id = r.catalog_id WHERE r.active) x GROUP BY 1 HAVING count(*) FILTER (WHERE hit) * 100 >= count(*) * 25 AND count(*) FILTER (WHERE hit) > 0"
)
def D08_dominant_in_playlists(b: Bed) -> DataFrame:
    members = b.radar_tracks.filter("active").select("playlist_id", "catalog_id").distinct()
    return V.dominated(members.join(b.catalog.select(F.col("id").alias("catalog_id"), "genres"), "catalog_id"), "playlist_id", "ring").select("playlist_id")


@query(
    """SELECT set_id, genre, n, CAST(round_even(100 * n / total, 0) AS INT) AS pct, rank FROM (
       SELECT set_id, genre, n, total, row_number() OVER (PARTITION BY set_id ORDER BY n DESC, genre) AS rank FROM (
         SELECT t.set_id, g.genre, count(*) AS n FROM set_tracks t JOIN (SELECT DISTINCT id, unnest(genres) AS genre FROM catalog) g ON g.id = t.catalog_id GROUP BY 1, 2) a
       JOIN (SELECT t.set_id, count(*) AS total FROM set_tracks t JOIN catalog c ON c.id = t.catalog_id WHERE len(c.genres) > 0 GROUP BY 1) z USING (set_id)) y WHERE rank <= 5"""
)
def D12_top_genres_of_sets(b: Bed) -> DataFrame:
    tracks = b.set_tracks.join(b.catalog.select(F.col("id").alias("catalog_id"), "genres"), "catalog_id")
    return G.top_genres(tracks, "set_id")


@query(
    """SELECT artist_id, genre, n, row_number() OVER (PARTITION BY artist_id ORDER BY n DESC, genre) AS rank FROM (
       SELECT artist_id, genre, n, sum(n) OVER (PARTITION BY artist_id) AS total FROM (
         SELECT k.artist_id, g.genre, count(*) AS n FROM (SELECT DISTINCT l_orderkey AS artist_id, l_partkey AS catalog_id FROM lineitem) k JOIN (SELECT id, unnest(genres) AS genre FROM catalog) g ON g.id = k.catalog_id GROUP BY 1, 2) a) z WHERE n >= greatest(1, floor(total * 0.2))"""
)
def D13_artist_genres(b: Bed) -> DataFrame:
    links = b.lineitem.select(F.col("l_partkey").alias("catalog_id"), F.col("l_orderkey").alias("artist_id")).distinct()
    return G.artist_genres(links, b.catalog)


@query(
    "WITH RECURSIVE "
    + PILLAR_SQL
    + """, every(pillar) AS (VALUES ('house'), ('techno'), ('trance'), ('dnb'), ('hardcore'), ('harddance'), ('autres')),
    n AS (SELECT coalesce(p.pillar, 'autres') AS pillar, count(*) AS n FROM (SELECT DISTINCT unnest(genres) AS g FROM catalog) x LEFT JOIN pillar_of p ON p.raw_name = x.g GROUP BY 1)
    SELECT every.pillar, coalesce(n.n, 0) AS n FROM every LEFT JOIN n ON n.pillar = every.pillar"""
)
def D14_pillar_counts(b: Bed) -> DataFrame:
    return G.pillar_counts(G.exploded(b.catalog), pillars(b.genre_nodes, b.genre_edges, b.genre_map))


@query("SELECT lower(trim(label)) AS name, count(*) AS n FROM catalog WHERE label IS NOT NULL GROUP BY 1")
def D15_label_counts(b: Bed) -> DataFrame:
    return b.catalog.filter("label is not null").groupBy(F.lower(F.trim("label")).alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT catalog_id, count(DISTINCT set_id) AS df, round(1 / log2(1 + greatest(count(DISTINCT set_id), 1)), 6) AS weight FROM set_tracks WHERE catalog_id IS NOT NULL GROUP BY 1")
def D17_document_frequency(b: Bed) -> DataFrame:
    df = F.countDistinct("set_id")
    return b.set_tracks.filter("catalog_id is not null").groupBy("catalog_id").agg(df.alias("df"), F.round(1 / F.log2(1 + F.greatest(df, F.lit(1)).cast("double")), 6).alias("weight"))


@query(
    "SELECT genre, id, rank FROM (SELECT genre, id, row_number() OVER (PARTITION BY genre ORDER BY id DESC) AS rank FROM (SELECT id, unnest(genres) AS genre FROM catalog WHERE has_artwork AND scope = 'shared') g) x WHERE rank <= 4"
)
def E01_topk_per_genre(b: Bed) -> DataFrame:
    arts = G.exploded(b.catalog.filter("has_artwork and scope = 'shared'")).select("genre", "id")
    return top_k(arts, ["genre"], [F.desc("id")], 4)


@query(
    "SELECT * FROM (SELECT genre, artist_id, n, row_number() OVER (PARTITION BY genre ORDER BY n DESC, artist_id) AS rank FROM (SELECT g.genre, k.artist_id, count(*) AS n FROM (SELECT id, unnest(genres) AS genre FROM catalog) g JOIN catalog_artists k ON k.catalog_id = g.id GROUP BY 1, 2) a) x WHERE rank <= 3"
)
def E02_top_artists_per_genre(b: Bed) -> DataFrame:
    n = G.exploded(b.catalog).select("genre", F.col("id").alias("catalog_id")).join(b.catalog_artists, "catalog_id").groupBy("genre", "artist_id").agg(F.count(F.lit(1)).alias("n"))
    return top_k(n, ["genre"], [F.desc("n"), F.col("artist_id")], 3)


@query("SELECT id, round(followers / nullif(max(followers) OVER (), 0) * 10, 4) AS share FROM playlists")
def E04_normalised_by_max(b: Bed) -> DataFrame:
    most = b.playlists.agg(F.max("followers").alias("most"))
    return b.playlists.crossJoin(F.broadcast(most)).select("id", F.round(F.col("followers") / F.nullif("most", F.lit(0.0)) * 10, 4).alias("share"))


@query("SELECT task_type, id, started_at FROM (SELECT *, row_number() OVER (PARTITION BY task_type ORDER BY started_at DESC, id DESC) AS n FROM runs) x WHERE n = 1", text=("started_at",))
def E08_latest_run(b: Bed) -> DataFrame:
    return one_per(b.runs, ["task_type"], [F.desc("started_at"), F.desc("id")]).select("task_type", "id", "started_at")


@query(
    "SELECT id, place FROM (SELECT id, row_number() OVER (ORDER BY bpm DESC NULLS LAST, lower(nullif(trim(label), '')) ASC NULLS LAST, length(key) ASC NULLS LAST, key ASC NULLS LAST, id DESC) AS place FROM catalog) x WHERE place <= 200"
)
def F01_explorer_sort(b: Bed) -> DataFrame:
    order = [F.col("bpm").desc_nulls_last(), *V.order_by("label", False)[:1], *V.order_by("key", False)[:2], F.desc("id")]
    return top_k(b.catalog.orderBy(*order).limit(200), [], order, 200, "place").select("id", "place")


@query("SELECT id, TRY_CAST(regexp_replace(key, '[^0-9]', '', 'g') AS INT) AS number, nullif(regexp_extract(key, '[A-B]$'), '') AS letter FROM catalog")
def F04_camelot_sort_keys(b: Bed) -> DataFrame:
    n = F.regexp_replace("key", "[^0-9]", "").try_cast("int")
    return b.catalog.select("id", n.alias("number"), F.nullif(F.regexp_extract("key", "[A-B]$", 0), F.lit("")).alias("letter"))


@query("SELECT id, title FROM (SELECT id, title, row_number() OVER (ORDER BY played_date DESC, id DESC) AS n FROM sets WHERE parent_set_id IS NULL) x WHERE n > 40 AND n <= 60")
def F06_page_of_sets(b: Bed) -> DataFrame:
    return b.sets.filter("parent_set_id is null").orderBy(F.desc("played_date"), F.desc("id")).offset(40).limit(20).select("id", "title")


@query("WITH RECURSIVE up AS (SELECT id, id AS ancestor, 0 AS depth FROM genre_nodes UNION ALL SELECT up.id, e.parent_id, up.depth + 1 FROM up JOIN genre_edges e ON e.child_id = up.ancestor WHERE e.type = 'parent' AND up.depth < 10) SELECT id, ancestor, min(depth) AS depth FROM up GROUP BY 1, 2")
def I02_closure(b: Bed) -> DataFrame:
    return ancestors(b.genre_nodes, b.genre_edges)


@query("WITH RECURSIVE up AS (SELECT id, id AS ancestor, 0 AS depth FROM genre_nodes UNION ALL SELECT up.id, e.parent_id, up.depth + 1 FROM up JOIN genre_edges e ON e.child_id = up.ancestor WHERE e.type = 'parent' AND up.depth < 10) SELECT id, ancestor, min(depth) AS depth FROM up GROUP BY 1, 2")
def I02_closure_recursive_sql(b: Bed) -> DataFrame:
    return ancestors_sql(b.spark, b.genre_nodes, b.genre_edges)


@query("WITH RECURSIVE " + PILLAR_SQL + " SELECT * FROM pillar_of")
def I01_pillars(b: Bed) -> DataFrame:
    return pillars(b.genre_nodes, b.genre_edges, b.genre_map)


@query(
    """SELECT e.child_id AS node, e.parent_id AS other, 'to' AS direction FROM genre_edges e WHERE e.type = 'influence'
       UNION ALL SELECT e.parent_id, e.child_id, 'from' FROM genre_edges e WHERE e.type = 'influence'"""
)
def I04_influence_neighbours(b: Bed) -> DataFrame:
    e = b.genre_edges.filter("type = 'influence'")
    return e.select(F.col("child_id").alias("node"), F.col("parent_id").alias("other"), F.lit("to").alias("direction")).unionByName(
        e.select(F.col("parent_id").alias("node"), F.col("child_id").alias("other"), F.lit("from").alias("direction"))
    )


@query("SELECT n.id, n.label FROM genre_nodes n WHERE NOT EXISTS (SELECT 1 FROM genre_edges e WHERE e.child_id = n.id AND e.type = 'parent')")
def I05_roots(b: Bed) -> DataFrame:
    up = b.genre_edges.filter("type = 'parent'").select(F.col("child_id").alias("id"))
    return b.genre_nodes.join(up, "id", "left_anti")


@query(
    """SELECT id, node_id, max(w) AS weight FROM (
       SELECT DISTINCT g.id, m.node_id, CAST(1 AS DOUBLE) AS w FROM (SELECT id, unnest(genres) AS g FROM catalog) g JOIN genre_map m ON m.raw_name = g.g WHERE m.node_id IS NOT NULL
       UNION ALL SELECT g.id, e.parent_id, 0.5 FROM (SELECT id, unnest(genres) AS g FROM catalog) g JOIN genre_map m ON m.raw_name = g.g JOIN genre_edges e ON e.child_id = m.node_id AND e.type = 'parent') x GROUP BY 1, 2"""
)
def I06_node_weights(b: Bed) -> DataFrame:
    return node_weights(b.catalog, b.genre_map, b.genre_edges)


@query(
    "WITH seen AS ("
    + SEEN
    + """), pl AS (SELECT catalog_id, count(DISTINCT playlist_id) AS n FROM radar_tracks WHERE active GROUP BY 1),
    st AS (SELECT t.catalog_id, count(DISTINCT t.set_id) AS n FROM set_tracks t JOIN sets s ON s.id = t.set_id WHERE s.unreliable IS NOT TRUE AND t.catalog_id IS NOT NULL GROUP BY 1),
    op AS (SELECT CAST(entity_key AS BIGINT) AS id, opinion FROM opinions WHERE user_id = 5)
    SELECT v.id, v.title, v.in_lib, coalesce(v.rb_bpm, v.bpm) AS bpm_shown, coalesce(pl.n, 0) AS n_lists, coalesce(st.n, 0) AS n_sets, op.opinion
    FROM seen v LEFT JOIN pl ON pl.catalog_id = v.id LEFT JOIN st ON st.catalog_id = v.id LEFT JOIN op ON op.id = v.id"""
)
def V01_list_catalog(b: Bed) -> DataFrame:
    return V.list_catalog(b.catalog, b.library, b.radar_tracks, b.sets, b.set_tracks, b.opinions, 5)


@query(
    """WITH s AS (SELECT genre, count(DISTINCT id) AS tracks FROM (SELECT id, unnest(genres) AS genre FROM catalog) x GROUP BY 1),
    a AS (SELECT genre, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank) AS artworks FROM (SELECT genre, id, row_number() OVER (PARTITION BY genre ORDER BY id DESC) AS rank FROM (SELECT id, unnest(genres) AS genre FROM catalog WHERE has_artwork AND scope = 'shared') g) x WHERE rank <= 4 GROUP BY 1)
    SELECT s.genre, s.tracks, a.artworks FROM s LEFT JOIN a USING (genre)"""
)
def V03_list_genres(b: Bed) -> DataFrame:
    arts = top_k(G.exploded(b.catalog.filter("has_artwork and scope = 'shared'")).select("genre", "id"), ["genre"], [F.desc("id")], 4)
    cards = arts.groupBy("genre").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"].cast("string")), ",").alias("artworks"))
    return G.exploded(b.catalog).groupBy("genre").agg(F.countDistinct("id").alias("tracks")).join(cards, "genre", "left")


@query(
    "WITH h AS (SELECT DISTINCT genre, lower(artist) AS artist FROM (SELECT artist, unnest(genres) AS genre FROM catalog) x) SELECT a.genre, b.genre AS other, count(*) AS common FROM h a JOIN h b ON a.artist = b.artist AND a.genre <> b.genre GROUP BY 1, 2"
)
def V04_genre_neighbours(b: Bed) -> DataFrame:
    return G.neighbours(b.catalog)


@query("SELECT g AS genre, count(*) AS n FROM (SELECT unnest(genres) AS g FROM catalog) x GROUP BY 1")
def V05_genre_counts(b: Bed) -> DataFrame:
    return G.exploded(b.catalog).groupBy("genre").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT a.id, a.name, count(DISTINCT k.catalog_id) AS tracks, count(DISTINCT CASE WHEN c.has_preview THEN k.catalog_id END) AS previews, count(DISTINCT r.playlist_id) AS playlists
       FROM artists a LEFT JOIN catalog_artists k ON k.artist_id = a.id LEFT JOIN catalog c ON c.id = k.catalog_id LEFT JOIN (SELECT DISTINCT catalog_id, playlist_id FROM radar_tracks WHERE active) r ON r.catalog_id = k.catalog_id GROUP BY 1, 2"""
)
def V06_list_artists(b: Bed) -> DataFrame:
    return V.list_artists(b.artists, b.catalog_artists, b.catalog, b.radar_tracks)


@query(
    """SELECT s.id, s.title, count(*) AS total, count(t.catalog_id) AS identified FROM sets s JOIN set_tracks t ON t.set_id = s.id
       WHERE s.parent_set_id IS NULL AND s.unreliable IS NOT TRUE GROUP BY 1, 2 HAVING count(t.catalog_id) >= 1"""
)
def V08_list_sets(b: Bed) -> DataFrame:
    counts = b.set_tracks.groupBy(F.col("set_id").alias("id")).agg(F.count(F.lit(1)).alias("total"), F.count("catalog_id").alias("identified")).filter("identified >= 1")
    return root_sets(b.sets).select("id", "title").join(counts, "id")


@query(
    """SELECT playlist_id, artist_id, n, rank FROM (SELECT playlist_id, artist_id, n, row_number() OVER (PARTITION BY playlist_id ORDER BY n DESC, artist_id) AS rank FROM (
       SELECT r.playlist_id, k.artist_id, count(*) AS n FROM (SELECT DISTINCT playlist_id, catalog_id FROM radar_tracks WHERE active) r JOIN catalog_artists k ON k.catalog_id = r.catalog_id GROUP BY 1, 2) a) x WHERE rank <= 6"""
)
def V10_playlist_top_artists(b: Bed) -> DataFrame:
    members = b.radar_tracks.filter("active").select("playlist_id", "catalog_id").distinct()
    n = members.join(b.catalog_artists, "catalog_id").groupBy("playlist_id", "artist_id").agg(F.count(F.lit(1)).alias("n"))
    return top_k(n, ["playlist_id"], [F.desc("n"), F.col("artist_id")], 6)


@query("SELECT user_id, opinion, string_agg(entity_key, ',' ORDER BY entity_key) AS keys, count(*) AS n FROM opinions GROUP BY 1, 2")
def V14_opinions_grouped(b: Bed) -> DataFrame:
    return b.opinions.groupBy("user_id", "opinion").agg(F.array_join(F.array_sort(F.collect_list("entity_key")), ",").alias("keys"), F.count(F.lit(1)).alias("n"))


_Q = "bo"
_HIT = "(contains(lower({c}), 'bo') OR contains(replace(lower({c}), ' ', ''), 'bo'))"
_REL = "CASE WHEN lower({c}) = 'bo' THEN 3 WHEN starts_with(lower({c}), 'bo') THEN 2 ELSE 1 END"


@query(
    """WITH hits AS (
    SELECT 'track' AS kind, 0 AS place, id, title AS name, coalesce(n, 0) AS popularity FROM catalog LEFT JOIN (SELECT catalog_id, count(DISTINCT playlist_id) AS n FROM radar_tracks WHERE active GROUP BY 1) p ON p.catalog_id = id WHERE """
    + _HIT.format(c="title")
    + """ UNION ALL SELECT 'artist', 1, id, name, CAST(fans AS BIGINT) FROM artists WHERE """
    + _HIT.format(c="name")
    + """ UNION ALL SELECT 'set', 2, id, title, 0 FROM sets WHERE parent_set_id IS NULL AND unreliable IS NOT TRUE AND """
    + _HIT.format(c="title")
    + """ UNION ALL SELECT 'playlist', 3, id, title, CAST(followers AS BIGINT) FROM playlists WHERE """
    + _HIT.format(c="title")
    + """ UNION ALL SELECT 'genre', 4, NULL, g, count(*) FROM (SELECT unnest(genres) AS g FROM catalog) x WHERE """
    + _HIT.format(c="g")
    + """ GROUP BY g),
    capped AS (SELECT *, """
    + _REL.format(c="name")
    + """ AS relevance, row_number() OVER (PARTITION BY kind ORDER BY """
    + _REL.format(c="name")
    + """ DESC, popularity DESC, id, name) AS n FROM hits)
    SELECT kind, id, name, relevance, popularity, row_number() OVER (ORDER BY relevance DESC, popularity DESC, place, id, name) AS rank FROM capped WHERE n <= 30"""
)
def U_search_all(b: Bed) -> DataFrame:
    return V.search_all(_Q, b.catalog, b.artists, root_sets(b.sets), b.playlists, b.radar_tracks)


@query("SELECT count(DISTINCT r.catalog_id) AS unseen FROM radar_tracks r JOIN catalog c ON c.id = r.catalog_id LEFT JOIN opinions o ON o.user_id = 5 AND o.entity_key = CAST(r.catalog_id AS VARCHAR) WHERE r.active AND c.scope = 'shared' AND coalesce(o.opinion, 'new') = 'new'")
def N09_unseen_count(b: Bed) -> DataFrame:
    judged = b.opinions.filter("user_id = 5").select(F.col("entity_key").cast("long").alias("catalog_id"))
    fresh = b.radar_tracks.filter("active").join(b.catalog.filter("scope = 'shared'").select(F.col("id").alias("catalog_id")), "catalog_id").join(judged, "catalog_id", "left_anti")
    return fresh.agg(F.countDistinct("catalog_id").alias("unseen"))


