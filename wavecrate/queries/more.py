"""Artists, sets, enrichment, details and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavecrate.functions import music
from wavecrate.functions.text import set_title
from wavecrate.operators import artists as A
from wavecrate.operators import embeddings as E
from wavecrate.operators import enrichment as R
from wavecrate.operators import genres as G
from wavecrate.operators import monitoring as M
from wavecrate.operators import sets as S
from wavecrate.operators.backlog import outcome
from wavecrate.plans.topk import one_per, top_k
from wavecrate.plans.visibility import root_sets, visible
from wavecrate.queries.listings import SEEN
from wavecrate.queries.linkage import PAIRS_SQL, _pairs
from wavecrate.plans.quantiles import exact_percentiles
from wavecrate.queries.registry import query
from wavecrate.testbed import Bed


def _names(b: Bed) -> DataFrame:
    """Spellings of supplier names: every fourth without '#', with a bullet or in parts."""
    n = F.col("s_suppkey")
    name = F.when(n % 4 == 0, F.replace("s_name", F.lit("#"), F.lit("-"))).when(n % 4 == 1, F.concat(F.lit("Vinyl • "), F.col("s_name"))).when(n % 4 == 2, F.concat(F.col("s_name"), F.lit(" (GEMA)"))).otherwise(F.col("s_name"))
    return b.supplier.select(n.alias("id"), name.alias("name"))


@query(
    "SELECT s_suppkey AS id, s_name AS clean FROM supplier WHERE s_suppkey % 4 IN (1, 2)"
)
def P37_noise_pass(b: Bed) -> DataFrame:
    return A.cleaned_names(_names(b)).select("id", "clean")


@query(
    """SELECT key, CASE WHEN linked = 1 AND nulls > 0 AND linked + nulls = members THEN 'merge' ELSE 'flag' END AS decision,
       CASE WHEN linked = 1 AND nulls > 0 AND linked + nulls = members THEN 'one_linked_nulls' WHEN linked = 0 THEN 'no_linked' WHEN linked >= 2 THEN 'multi_linked' ELSE 'one_linked_mixed' END AS reason,
       CASE WHEN linked = 1 AND nulls > 0 AND linked + nulls = members THEN anchor END AS canonical, members
       FROM (SELECT lower(substr(s_name, 1, 8)) || CAST(s_suppkey % 30 AS VARCHAR) AS key, count(*) AS members, count(*) FILTER (WHERE s_suppkey % 5 = 0) AS linked, count(*) FILTER (WHERE s_suppkey % 5 IN (1, 2)) AS nulls,
             min(s_suppkey) FILTER (WHERE s_suppkey % 5 = 0) AS anchor FROM supplier GROUP BY 1) g WHERE members > 1"""
)
def P12_artist_clusters(b: Bed) -> DataFrame:
    n = F.col("s_suppkey")
    base = F.concat(F.left("s_name", F.lit(8)), (n % 30).cast("string"))
    name = F.when(n % 3 == 0, F.concat(F.left(base, F.lit(3)), F.lit("."), F.substr(base, F.lit(4)))).otherwise(base)
    rows = b.supplier.select(n.alias("id"), name.alias("name"), F.when(n % 5 == 0, n.cast("string")).when(n % 5 > 2, "NOT_FOUND").alias("deezer_id"), F.lit(0).alias("fans"))
    return A.clusters(rows)


@query("SELECT catalog_id, string_agg(name, ', ' ORDER BY position, lower(name)) AS flat FROM catalog_artists k JOIN artists a ON a.id = k.artist_id GROUP BY 1")
def P09_flat_artists(b: Bed) -> DataFrame:
    return A.flat_from_links(b.catalog_artists, b.artists)


@query("SELECT c.id, 'resync' AS outcome FROM catalog c WHERE EXISTS (SELECT 1 FROM catalog_artists k WHERE k.catalog_id = c.id)")
def P09_resync(b: Bed) -> DataFrame:
    return A.resync(b.catalog, b.catalog_artists, b.artists).select("id", "outcome")


@query("SELECT DISTINCT p_brand || ', ' || p_type AS raw, 'comma' AS rule, CASE WHEN p_type IN ('PROMO', 'SMALL') THEN 'split' ELSE 'needs_lookup' END AS outcome FROM part")
def P10_classify_artists(b: Bed) -> DataFrame:
    strings = b.part.select(F.concat_ws(", ", "p_brand", "p_type").alias("raw")).distinct()
    known = b.spark.createDataFrame([("promo",), ("small",)], "name string")
    return A.classify(strings, known).select("raw", "rule", "outcome")


@query(
    "SELECT artist_id, action, hit_id, holder FROM (SELECT s_suppkey AS artist_id, CASE WHEN s_suppkey % 10 < 5 AND s_suppkey = min(s_suppkey) OVER (PARTITION BY s_suppkey % 10) THEN 'link' ELSE 'merge' END AS action, s_suppkey % 10 AS hit_id, CASE WHEN s_suppkey % 10 >= 5 THEN 1000 + s_suppkey % 10 WHEN s_suppkey <> min(s_suppkey) OVER (PARTITION BY s_suppkey % 10) THEN min(s_suppkey) OVER (PARTITION BY s_suppkey % 10) END AS holder FROM supplier) x"
)
def P35_link_or_merge(b: Bed) -> DataFrame:
    hits = b.supplier.select(F.col("s_suppkey").alias("artist_id"), (F.col("s_suppkey") % 10).alias("hit_id"), F.lit(1).alias("rank"))
    held = b.spark.range(5, 10).select(F.col("id").alias("hit_id"), (F.col("id") + 1000).alias("holder"))
    return A.link_or_merge(hits, held)


@query(
    "SELECT c.id AS catalog_id, a.s_suppkey AS artist_id, 'primary' AS role, 0 AS position FROM catalog c JOIN supplier a ON lower(a.s_name) = 'supplier#' || lpad(CAST(c.id % 100 AS VARCHAR), 9, '0')"
)
def P34_new_links(b: Bed) -> DataFrame:
    rows = b.catalog.select("id", F.concat(F.lit("Supplier#"), F.lpad((F.col("id") % 100).cast("string"), 9, "0")).alias("artist"))
    names = b.artists.select(F.col("normalized_name").alias("name"), F.col("id").alias("artist_id"), F.lit(False).alias("alias"))
    return A.new_links(rows, names)


@query(
    "SELECT id, CASE WHEN r THEN 130.0 ELSE bpm END AS bpm, coalesce(label, CASE WHEN r THEN 'L' END) AS label, release_date, CASE WHEN r AND scope = 'private' THEN 'shared' ELSE scope END AS scope FROM (SELECT *, TRUE AS r FROM catalog) c",
    text=("release_date",),
)
def P27_apply_record(b: Bed) -> DataFrame:
    catalog = b.catalog.withColumns({"bpm_source": F.lit(None).cast("string"), "key_source": F.lit("beatport")})
    records = b.catalog.select(
        "id", F.col("id").cast("string").alias("r_record_id"), F.lit(130.0).alias("r_bpm"), F.lit("1A").alias("r_key"), F.lit("L").alias("r_label"), F.lit("house").alias("r_genre"), F.lit(None).cast("date").alias("r_release_date")
    )
    return R.apply_record(catalog, records).select("id", "bpm", "label", "release_date", "scope")


@query(
    "SELECT c.id, c.isrc IS NOT NULL AND d.isrc IS NOT NULL AND c.isrc = d.isrc AS ok FROM catalog c JOIN catalog d ON d.id = c.id + 1500 WHERE c.isrc IS NOT NULL AND d.isrc IS NOT NULL"
)
def P25_hit_matches(b: Bed) -> DataFrame:
    hit = b.catalog.filter("isrc is not null").select((F.col("id") - 1500).alias("id"), F.col("isrc").alias("hit_isrc"), F.col("artist").alias("hit_artist"), F.col("title").alias("hit_title"))
    return R.hit_matches(b.catalog.filter("isrc is not null").select("id", "isrc", "artist", "title").join(hit, "id")).select("id", "ok")


@query(
    "WITH inc AS (SELECT p_partkey AS row_id, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey % 900 AS VARCHAR) END AS pid, p_name AS name FROM part), i AS (SELECT deezer_id, min(id) AS id FROM catalog WHERE deezer_id IS NOT NULL GROUP BY 1), j AS (SELECT title, min(id) AS id FROM catalog GROUP BY 1) SELECT row_id, coalesce(i.id, j.id) AS id, CASE WHEN i.id IS NOT NULL THEN 'platform' WHEN j.id IS NOT NULL THEN 'name' ELSE 'new' END AS how FROM inc LEFT JOIN i ON i.deezer_id = inc.pid LEFT JOIN j ON j.title = inc.name"
)
def P28_resolve(b: Bed) -> DataFrame:
    wanted = b.part.select(F.col("p_partkey").alias("row_id"), F.when(F.col("p_partkey") % 2 == 0, (F.col("p_partkey") % 900).cast("string")).alias("platform_id"), F.col("p_name").alias("name"))
    table = b.catalog.select("id", F.col("deezer_id").alias("platform_id"), F.col("title").alias("name"))
    return R.resolve(wanted, table, b.spark.createDataFrame([], "alias string, id long"))


@query(
    "SELECT user_id, CAST(entity_key AS BIGINT) AS catalog_id, opinion, CASE opinion WHEN 'liked' THEN 'added' WHEN 'disliked' THEN 'ignored' ELSE 'new' END AS status FROM opinions"
)
def K07_propagate_opinions(b: Bed) -> DataFrame:
    return R.propagate(b.opinions)


@query(
    "SELECT l.user_id * 100000 + l.catalog_id AS row_id, c.id, CASE WHEN c.id IS NULL THEN 'create_private' WHEN c.scope = 'shared' THEN 'reuse_shared' WHEN c.owner_id = l.user_id THEN 'refresh_own' ELSE 'reuse_foreign' END AS action FROM library l LEFT JOIN (SELECT * FROM catalog WHERE id % 10 <> 3) c ON c.id = l.catalog_id"
)
def K09_import_binding(b: Bed) -> DataFrame:
    incoming = b.library.select((F.col("user_id") * 100_000 + F.col("catalog_id")).alias("row_id"), "user_id", F.col("catalog_id").alias("key"))
    return R.import_binding(incoming, b.catalog.filter("id % 10 <> 3").withColumn("key", F.col("id")))


@query(
    "WITH inc AS (SELECT p_partkey AS row_id, CASE WHEN p_partkey % 3 = 0 THEN 'ISRC' || CAST(p_partkey % 3000 AS VARCHAR) END AS isrc, p_name || CAST(p_size AS VARCHAR) AS key FROM part), i AS (SELECT isrc, min(id) AS id FROM catalog WHERE isrc IS NOT NULL AND id % 2 = 0 GROUP BY 1) SELECT inc.row_id, i.id IS NULL AS created, i.id FROM inc LEFT JOIN i ON i.isrc = inc.isrc WHERE i.id IS NOT NULL UNION ALL SELECT inc.row_id, TRUE, NULL FROM inc LEFT JOIN i ON i.isrc = inc.isrc WHERE i.id IS NULL"
)
def K06_get_or_create(b: Bed) -> DataFrame:
    incoming = b.part.select(F.col("p_partkey").alias("row_id"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("ISRC"), (F.col("p_partkey") % 3000).cast("string"))).alias("isrc"), F.concat("p_name", F.col("p_size").cast("string")).alias("key"))
    catalog = b.catalog.filter("id % 2 = 0").select("id", "isrc", F.concat(F.lit("c"), F.col("id").cast("string")).alias("key"))
    out = R.get_or_create(catalog, incoming)
    return out.select("row_id", "created", F.when(~F.col("created"), F.col("id")).alias("id"))


@query("SELECT id, title, isrc, 1 AS source FROM catalog WHERE id % 2 = 0 UNION ALL SELECT id, title, isrc, 2 FROM catalog WHERE id % 2 = 1 AND (isrc IS NULL OR isrc NOT IN (SELECT isrc FROM catalog WHERE id % 2 = 0 AND isrc IS NOT NULL))")
def G06_merge_external(b: Bed) -> DataFrame:
    c = b.catalog.select("id", "title", "isrc")
    return R.merge_external(c.filter("id % 2 = 0").withColumn("source", F.lit(1)), c.filter("id % 2 = 1").withColumn("source", F.lit(2)))


_PARTS = "SELECT id, channel_id % 20 AS channel, lower(title) AS title, CASE WHEN regexp_matches(lower(title), 'part [0-9]+$') THEN regexp_replace(lower(title), ' part [0-9]+$', '') ELSE lower(title) END AS base_title, TRY_CAST(regexp_extract(lower(title), 'part ([0-9]+)$', 1) AS INT) AS part, played_date FROM sets"


@query(
    "WITH s AS (" + _PARTS + ") SELECT channel, base_title, count(*) AS members FROM s WHERE part IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1 AND count(DISTINCT part) = count(*)"
)
def P18_part_groups(b: Bed) -> DataFrame:
    s = b.sets.select("id", (F.col("channel_id") % 20).alias("channel"), set_title(F.col("title")).alias("t"), "played_date")
    s = s.select("id", "channel", F.col("t.text").alias("title"), "t.base_title", F.col("t.part_number").alias("part"), F.col("t.part_total").alias("total"), "played_date")
    return S.part_groups(s, b.set_tracks.select("set_id", F.col("catalog_id").alias("mtid"))).select("channel", "base_title", "members")


@query(PAIRS_SQL + " SELECT a, b FROM conf WHERE NOT coalesce(part_a <> part_b, FALSE) AND (CASE WHEN overlap >= 0.8 AND (title_sim >= 0.5 OR gap <= 1) THEN gap > 2 ELSE round_even(c, 4) >= 0.45 OR (title_sim >= 0.9 AND overlap >= 0.3) END) AND a % 10 <> 0")
def P20_new_flags(b: Bed) -> DataFrame:
    pairs = _pairs(b)
    return S.new_flags(pairs, pairs.filter("a % 10 = 0").select("a", "b")).select("a", "b")


@query(
    "WITH ch AS (SELECT id AS set_id, CAST(floor(id / 10) AS BIGINT) AS parent FROM sets WHERE id % 10 < 3), l AS (SELECT * FROM ch WHERE set_id % 4 <> 1) SELECT set_id, parent FROM l WHERE parent IN (SELECT parent FROM l GROUP BY 1 HAVING count(*) > 1)"
)
def P24_detached(b: Bed) -> DataFrame:
    children = b.sets.filter("id % 10 < 3").select(F.col("id").alias("set_id"), F.floor(F.col("id") / 10).alias("parent"))
    return S.detached(children, children.filter("set_id % 4 = 1"))


@query("SELECT id, CAST(regexp_extract(lower(title), 'part ([0-9]+)$', 1) AS INT) AS part_number FROM sets WHERE regexp_matches(lower(title), 'part [0-9]+$') AND id % 3 <> CAST(regexp_extract(lower(title), 'part ([0-9]+)$', 1) AS INT) UNION ALL SELECT id, NULL FROM sets WHERE NOT regexp_matches(lower(title), 'part [0-9]+$')")
def P43_part_changes(b: Bed) -> DataFrame:
    stored = b.sets.select("id", "title", (F.col("id") % 3).cast("int").alias("part_number"), F.lit(None).cast("int").alias("part_total"))
    return S.part_changes(stored).select("id", "part_number")


@query("SELECT event_id, CASE WHEN value > 100 THEN 0 ELSE CAST(user_id % 4 AS INT) + 1 END AS stale, CASE WHEN value > 400 THEN 'complete' WHEN value <= 100 AND user_id % 4 >= 2 THEN 'stale' END AS final FROM events")
def Q07_recrawl_outcome(b: Bed) -> DataFrame:
    new = F.when(F.col("value") > 400, 1.0).when(F.col("value") > 100, 0.5).otherwise(0.2)
    return b.events.select("event_id", F.inline(F.array(outcome(F.lit(0.2), new, (F.col("user_id") % 4).cast("int")))))


@query(
    "WITH v AS (" + SEEN + "), t AS (SELECT user_id, rank FROM (SELECT 5 AS user_id, 1 AS rank) x) SELECT v.id, v.title, v.in_lib, n FROM (SELECT v.*, row_number() OVER (PARTITION BY artist ORDER BY in_lib DESC, lower(title), id) AS n FROM v) v WHERE n <= 10"
)
def V02_same_artist(b: Bed) -> DataFrame:
    seen = visible(b.catalog, b.library, 5)
    return top_k(seen, ["artist"], [F.desc("in_lib"), F.lower("title"), F.col("id")], 10, "n").select("id", "title", "in_lib", "n")


@query(
    "SELECT artist_id, catalog_id, n FROM (SELECT k.artist_id, k.catalog_id, row_number() OVER (PARTITION BY k.artist_id ORDER BY c.release_date DESC NULLS LAST, c.id) AS n FROM catalog_artists k JOIN catalog c ON c.id = k.catalog_id WHERE c.scope = 'shared') x WHERE n <= 200"
)
def V07_artist_tracks(b: Bed) -> DataFrame:
    t = b.catalog_artists.select("artist_id", "catalog_id").join(b.catalog.filter("scope = 'shared'").select(F.col("id").alias("catalog_id"), "release_date"), "catalog_id")
    return top_k(t, ["artist_id"], [F.col("release_date").desc_nulls_last(), F.col("catalog_id")], 200, "n").select("artist_id", "catalog_id", "n")


@query(
    "SELECT t.set_id, t.position, t.catalog_id, c.title, l.catalog_id IS NOT NULL AS in_lib FROM set_tracks t JOIN sets s ON s.id = t.set_id LEFT JOIN (SELECT * FROM catalog WHERE scope = 'shared') c ON c.id = t.catalog_id LEFT JOIN (SELECT DISTINCT catalog_id FROM library WHERE user_id = 5) l ON l.catalog_id = t.catalog_id WHERE s.parent_set_id IS NULL AND s.unreliable IS NOT TRUE"
)
def V09_set_tracklists(b: Bed) -> DataFrame:
    titles = b.catalog.filter("scope = 'shared'").select(F.col("id").alias("catalog_id"), "title")
    own = b.library.filter("user_id = 5").select("catalog_id").distinct().withColumn("held", F.lit(True))
    t = b.set_tracks.join(root_sets(b.sets).select(F.col("id").alias("set_id")), "set_id").join(titles, "catalog_id", "left").join(own, "catalog_id", "left")
    return t.select("set_id", "position", "catalog_id", "title", F.coalesce("held", F.lit(False)).alias("in_lib"))


@query("SELECT album_key AS album, count(*) AS tracks, min(release_date) AS released, CAST(sum(duration_ms) AS BIGINT) AS duration_ms FROM catalog GROUP BY 1", text=("released",))
def V11_albums(b: Bed) -> DataFrame:
    return b.catalog.groupBy(F.col("album_key").alias("album")).agg(F.count(F.lit(1)).alias("tracks"), F.min("release_date").alias("released"), F.sum("duration_ms").alias("duration_ms"))


@query("SELECT user_id, count(*) FILTER (WHERE ts > seen) AS fresh FROM (SELECT e.user_id, e.ts, m.seen FROM events e JOIN (SELECT user_id, min(ts) + INTERVAL 10 DAY AS seen FROM events GROUP BY 1) m ON m.user_id = e.user_id) x GROUP BY 1")
def V12_new_since_seen(b: Bed) -> DataFrame:
    seen = b.events.groupBy("user_id").agg(F.min("ts").alias("first")).withColumn("seen", F.expr("first + INTERVAL '10' DAY"))
    return b.events.join(seen, "user_id").groupBy("user_id").agg(F.count(F.when(F.col("ts") > F.col("seen"), True)).alias("fresh"))


@query(
    "WITH items AS (SELECT id AS item_id, CASE id % 3 WHEN 0 THEN 'track' WHEN 1 THEN 'artist' ELSE 'set' END AS item_type, id AS position FROM catalog) SELECT i.position, i.item_type, i.item_id, coalesce(c.title, a.name, s.title) AS name, coalesce(c.title, a.name, s.title) IS NULL AS missing FROM items i LEFT JOIN catalog c ON i.item_type = 'track' AND c.id = i.item_id LEFT JOIN artists a ON i.item_type = 'artist' AND a.id = i.item_id LEFT JOIN sets s ON i.item_type = 'set' AND s.id = i.item_id"
)
def V13_collection_items(b: Bed) -> DataFrame:
    kind = F.when(F.col("id") % 3 == 0, "track").when(F.col("id") % 3 == 1, "artist").otherwise("set")
    items = b.catalog.select(F.col("id").alias("item_id"), kind.alias("item_type"), F.col("id").alias("position"))
    every = b.catalog.select(F.lit("track").alias("item_type"), F.col("id").alias("item_id"), F.col("title").alias("name"))
    every = every.union(b.artists.select(F.lit("artist"), "id", "name")).union(b.sets.select(F.lit("set"), "id", "title"))
    return items.join(every, ["item_type", "item_id"], "left").select("position", "item_type", "item_id", "name", F.col("name").isNull().alias("missing"))


@query(
    "SELECT g.genre, count(DISTINCT t.set_id) AS sets, count(DISTINCT r.playlist_id) AS playlists FROM (SELECT id, unnest(genres) AS genre FROM catalog) g LEFT JOIN set_tracks t ON t.catalog_id = g.id LEFT JOIN (SELECT DISTINCT catalog_id, playlist_id FROM radar_tracks WHERE active) r ON r.catalog_id = g.id GROUP BY 1"
)
def V04_genre_detail(b: Bed) -> DataFrame:
    each = G.exploded(b.catalog).select(F.col("id").alias("catalog_id"), "genre")
    n_sets = each.join(b.set_tracks.select("catalog_id", "set_id"), "catalog_id").groupBy("genre").agg(F.countDistinct("set_id").alias("sets"))
    lists = b.radar_tracks.filter("active").select("catalog_id", "playlist_id").distinct()
    n_lists = each.join(lists, "catalog_id").groupBy("genre").agg(F.countDistinct("playlist_id").alias("playlists"))
    return each.select("genre").distinct().join(n_sets, "genre", "left").join(n_lists, "genre", "left").na.fill(0)


@query("SELECT DISTINCT x.catalog_id AS a, y.catalog_id AS b FROM set_tracks x JOIN set_tracks y ON x.set_id = y.set_id AND x.catalog_id <> y.catalog_id AND abs(x.position - y.position) <= 1")
def T05_adjacent(b: Bed) -> DataFrame:
    return E.adjacent(b.set_tracks, 1)


@query(
    "WITH f AS (SELECT id, bpm, CAST(regexp_replace(key, '[AB]', '') AS INT) AS number, right(key, 1) AS letter, coalesce(genres, []) AS genres, label, year(release_date) AS year FROM catalog), p AS (SELECT a.id AS seed, b.id, [1 - least(abs(a.bpm - b.bpm) / 60, 1), 1 - (least(abs(a.number - b.number), 12 - abs(a.number - b.number)) + CASE WHEN a.letter <> b.letter THEN 1 ELSE 0 END) / 7.0, CASE WHEN len(a.genres) > 0 AND len(b.genres) > 0 THEN len(list_intersect(a.genres, b.genres)) / len(list_distinct(list_concat(a.genres, b.genres))) END, CASE WHEN a.label IS NULL OR b.label IS NULL THEN NULL WHEN a.label = b.label THEN 1.0 ELSE 0.0 END, 1 - least(abs(a.year - b.year) / 30, 1)] AS parts, a.number IS NULL OR b.number IS NULL AS nokey FROM f a JOIN f b ON a.id <> b.id WHERE a.id % 100 = 0) SELECT seed, id, round(coalesce(list_avg(list_filter(CASE WHEN nokey THEN [parts[1], parts[3], parts[4], parts[5]] ELSE parts END, lambda x: x IS NOT NULL)), 0), 6) AS score FROM p"
)
def T09_gower(b: Bed) -> DataFrame:
    f = b.catalog.select("id", "bpm", music.camelot_number(F.col("key")).alias("number"), music.camelot_letter(F.col("key")).alias("letter"), F.coalesce("genres", F.array().cast("array<string>")).alias("genres"), "label", F.year("release_date").alias("year"))
    return E.gower_pairs(f, f.filter("id % 100 = 0"), digits=6)


@query(
    "WITH s AS (SELECT round(abs(a.bpm - b.bpm), 3) AS d FROM catalog a JOIN catalog b ON a.id < b.id AND a.artist = b.artist WHERE a.bpm IS NOT NULL AND b.bpm IS NOT NULL) SELECT q, round(v, 6) AS v FROM (SELECT 0.25 AS q, quantile_cont(d, 0.25) AS v FROM s UNION ALL SELECT 0.5, quantile_cont(d, 0.5) FROM s UNION ALL SELECT 0.9, quantile_cont(d, 0.9) FROM s) x".replace("0.25 AS q", "CAST(0.25 AS DOUBLE) AS q")
)
def T12_quantiles(b: Bed) -> DataFrame:
    """Pairs are counted by tempo: an artist's tracks of one tempo meet those of another at once."""
    c = b.catalog.filter("bpm is not null").groupBy("artist", "bpm").agg(F.count(F.lit(1)).alias("n"))
    pairs = c.alias("a").join(c.alias("b"), "artist").filter("a.bpm <= b.bpm")
    n = F.when(F.col("a.bpm") < F.col("b.bpm"), F.col("a.n") * F.col("b.n")).otherwise(F.expr("a.n * (a.n - 1) div 2"))
    pairs = pairs.select(F.round(F.abs(F.col("a.bpm") - F.col("b.bpm")), 3).alias("d"), n.alias("n")).filter("n > 0")
    return exact_percentiles(pairs, [], "d", [0.25, 0.5, 0.9], weight="n").select(F.col("at").alias("q"), F.round("value", 6).alias("v"))


@query("SELECT round(avg(CASE WHEN abs(bpm - 128) <= 2 THEN 1.0 ELSE 0.0 END), 6) AS raw, round(avg(CASE WHEN abs(bpm - 128) <= 2 OR abs(bpm * 0.5 - 128) <= 2 OR abs(bpm * 2 - 128) <= 2 THEN 1.0 ELSE 0.0 END), 6) AS octaves FROM catalog WHERE bpm IS NOT NULL")
def T11_tempo_quality(b: Bed) -> DataFrame:
    return E.tempo_quality(b.catalog.filter("bpm is not null").select(F.lit(128.0).alias("truth"), "bpm", F.lit(3.0).alias("confidence"))).select("raw", "octaves")


@query("SELECT task_type, id, started_at, status FROM (SELECT *, row_number() OVER (ORDER BY started_at DESC, id DESC) AS n FROM runs WHERE status = 'error') x WHERE n <= 100", text=("started_at",))
def S07_run_logs(b: Bed) -> DataFrame:
    return b.runs.filter("status = 'error'").orderBy(F.desc("started_at"), F.desc("id")).limit(100).select("task_type", "id", "started_at", "status")


@query("SELECT id, started_at FROM runs WHERE started_at >= (SELECT max(started_at) FROM runs) - INTERVAL 20 DAY", text=("started_at",))
def A17_retention(b: Bed) -> DataFrame:
    last = b.runs.agg(F.max("started_at").alias("last")).first()["last"]
    return M.retained(b.runs, "started_at", F.lit(last), 20).select("id", "started_at")


@query("SELECT user_id, catalog_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, catalog_id) AS place FROM library")
def D22_positions(b: Bed) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("created_at"), "catalog_id")
    return b.library.select("user_id", "catalog_id", F.row_number().over(w).alias("place"))


@query("SELECT family, count(*) AS n FROM (SELECT id, genres[1] AS family FROM catalog) x WHERE family IS NOT NULL GROUP BY 1")
def D23_family_counts(b: Bed) -> DataFrame:
    return b.catalog.select(F.try_element_at("genres", F.lit(1)).alias("family")).filter("family is not null").groupBy("family").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT catalog_id, album FROM (SELECT l.catalog_id, c.album_key AS album, row_number() OVER (PARTITION BY l.catalog_id ORDER BY l.user_id) AS n FROM library l JOIN catalog c ON c.id = l.catalog_id) x WHERE n = 1")
def D09_representative_album(b: Bed) -> DataFrame:
    held = b.library.join(b.catalog.select(F.col("id").alias("catalog_id"), F.col("album_key").alias("album")), "catalog_id")
    return one_per(held, ["catalog_id"], [F.col("user_id")]).select("catalog_id", "album")
