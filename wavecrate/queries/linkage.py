"""Joins, record linkage, tracklists and table transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavecrate.functions import text as X
from wavecrate.operators import linkage as L
from wavecrate.operators import tracklist as T
from wavecrate.plans import merge as M
from wavecrate.plans.band_join import band_join
from wavecrate.plans.cooc import overlapping
from wavecrate.plans.text_joins import containment_join, token_join
from wavecrate.plans.topk import one_per
from wavecrate.queries.registry import query
from wavecrate.testbed import Bed


@query("SELECT c.id, c.title, e.opinion FROM catalog c LEFT JOIN (SELECT CAST(entity_key AS BIGINT) AS id, opinion FROM opinions WHERE user_id = 7) e ON e.id = c.id")
def C03_left_join_one_viewer(b: Bed) -> DataFrame:
    said = b.opinions.filter("user_id = 7").select(F.col("entity_key").cast("long").alias("id"), "opinion")
    return b.catalog.select("id", "title").join(said, "id", "left")


@query("SELECT a.id, a.name FROM artists a WHERE EXISTS (SELECT 1 FROM catalog_artists k WHERE k.artist_id = a.id) OR EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = a.id)")
def C06_attached_artists(b: Bed) -> DataFrame:
    played = b.lineitem.select(F.col("l_suppkey").alias("id"))
    held = b.catalog_artists.select(F.col("artist_id").alias("id")).union(played).distinct()
    return b.artists.select("id", "name").join(held, "id", "left_semi")


@query("SELECT id, title FROM catalog c WHERE NOT EXISTS (SELECT 1 FROM catalog_artists k WHERE k.catalog_id = c.id)")
def C07_unlinked_tracks(b: Bed) -> DataFrame:
    return L.unlinked(b.catalog.select("id", "title"), b.catalog_artists)


@query("WITH h AS (SELECT DISTINCT playlist_id, catalog_id FROM radar_tracks WHERE active) SELECT a.catalog_id AS a, b.catalog_id AS b, count(*) AS n FROM h a JOIN h b ON a.playlist_id = b.playlist_id AND a.catalog_id < b.catalog_id GROUP BY 1, 2 HAVING count(*) >= 3")
def C10_cooc_pairs(b: Bed) -> DataFrame:
    return overlapping(b.radar_tracks.filter("active"), "playlist_id", "catalog_id", 3)


@query(
    "SELECT a.id, count(*) AS n, CAST(sum(b.id) AS BIGINT) AS ids FROM catalog a JOIN catalog b ON b.id <> a.id AND (abs(b.bpm - a.bpm) <= 16 OR abs(b.bpm - a.bpm * 0.5) <= 16 OR abs(b.bpm - a.bpm * 2) <= 16) GROUP BY 1"
)
def C12_band_pairs(b: Bed) -> DataFrame:
    """Counts and sums of the pairs; both sides are summed up by tempo first, so a band meets tempos, not tracks."""
    c = b.catalog.filter("bpm is not null")
    by = c.groupBy("bpm").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))
    near = band_join(by, by, "bpm", 16.0, (1.0, 0.5, 2.0)).groupBy(F.col("l.bpm").alias("bpm")).agg(F.sum("r.n").alias("n"), F.sum("r.ids").alias("ids"))
    out = c.select("id", "bpm").join(near, "bpm").select("id", (F.col("n") - 1).alias("n"), (F.col("ids") - F.col("id")).alias("ids"))
    return out.filter("n > 0")  # a track's own tempo is always within its band


@query("SELECT catalog_id, artist_id FROM (SELECT *, row_number() OVER (PARTITION BY catalog_id ORDER BY position, artist_id) AS n FROM catalog_artists) x WHERE n = 1")
def C15_first_artist(b: Bed) -> DataFrame:
    first = F.min_by("artist_id", F.struct(F.coalesce("position", F.lit(2_147_483_647)), F.col("artist_id"))).alias("artist_id")
    return b.catalog_artists.groupBy("catalog_id").agg(first)


@query("SELECT c.id, a.brand FROM catalog c JOIN (SELECT DISTINCT p_brand AS brand FROM part) a ON contains(replace(lower(c.title), '_', ' '), lower(a.brand))")
def C18_containment_join(b: Bed) -> DataFrame:
    return containment_join(b.catalog.select("id", "title"), b.part.select(F.col("p_brand").alias("brand")).distinct(), "title", "brand").select("id", "brand")


_FUZZY = "SELECT min(p_partkey) AS id, split(lower(p_name || ' ' || p_brand || ' ' || p_type), ' ') AS t FROM {} GROUP BY p_name, p_brand, p_type"


@query("WITH t AS (" + _FUZZY.format("part") + ") SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) AS jaccard FROM t a JOIN t b ON a.id < b.id AND len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) >= 0.6")
def C19_fuzzy_token_join(b: Bed) -> DataFrame:
    t = b.part.groupBy("p_name", "p_brand", "p_type").agg(F.min("p_partkey").alias("id"))
    t = t.select("id", F.split(F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type")), " ").alias("t"))
    return token_join(t, "id", "t", 0.6).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


_INCOMING = "SELECT p_partkey AS row_id, CASE WHEN p_partkey % 2 = 0 THEN 'ISRC' || CAST(p_partkey % 1500 AS STRING) END AS isrc, p_name || ' - ' || p_brand AS k FROM {part}"


@query(
    "WITH inc AS (" + _INCOMING.replace("{part}", "part") + "), i AS (SELECT isrc, min(id) AS id FROM catalog WHERE isrc IS NOT NULL GROUP BY 1), k AS (SELECT title || ' - ' || artist AS k, min(id) AS id FROM catalog GROUP BY 1) SELECT inc.row_id, coalesce(i.id, k.id) AS id, CASE WHEN i.id IS NOT NULL THEN 'isrc' WHEN k.id IS NOT NULL THEN 'key' END AS how FROM inc LEFT JOIN i ON i.isrc = inc.isrc LEFT JOIN k ON k.k = inc.k"
)
def C21_two_stage_lookup(b: Bed) -> DataFrame:
    incoming = b.spark.sql(_INCOMING, part=b.part)
    by_code = b.catalog.filter("isrc is not null").groupBy("isrc").agg(F.min("id").alias("i"))
    by_key = b.catalog.groupBy(F.concat_ws(" - ", "title", "artist").alias("k")).agg(F.min("id").alias("j"))
    out = incoming.join(by_code, "isrc", "left").join(by_key, "k", "left")
    return out.select("row_id", F.coalesce("i", "j").alias("id"), F.when(F.col("i").isNotNull(), "isrc").when(F.col("j").isNotNull(), "key").alias("how"))


@query(
    "SELECT set_id, mtid, start_ms, row_number() OVER (PARTITION BY set_id ORDER BY coalesce(start_ms, 0), arrived) AS place FROM (SELECT set_id, catalog_id AS mtid, timecode_ms AS start_ms, row_number() OVER (PARTITION BY set_id, catalog_id ORDER BY timecode_ms NULLS LAST, position) AS n, min(position) OVER (PARTITION BY set_id, catalog_id) AS arrived FROM (SELECT t.*, s.channel_id FROM set_tracks t JOIN sets s ON s.id = t.set_id) q WHERE catalog_id IS NOT NULL) x WHERE n = 1"
)
def A10_merge_tracklist(b: Bed) -> DataFrame:
    return T.merge_detections(b.set_tracks.select("set_id", F.col("catalog_id").alias("mtid"), F.col("timecode_ms").alias("start_ms"), F.col("position").alias("seq")))


@query("SELECT id, title, coalesce(r.rb_bpm, c.bpm) AS bpm FROM catalog c LEFT JOIN (SELECT catalog_id, max(rb_bpm) AS rb_bpm FROM library GROUP BY 1) r ON r.catalog_id = c.id")
def A12_upsert(b: Bed) -> DataFrame:
    old = b.catalog.select("id", "title", "bpm")
    new = b.library.groupBy(F.col("catalog_id").alias("id")).agg(F.max("rb_bpm").alias("new_bpm")).filter("new_bpm is not null")
    new = old.join(new, "id").select("id", "title", F.col("new_bpm").alias("bpm"))
    return M.upsert(old, new, ["id"])


@query("SELECT k, min(id) AS id FROM (SELECT lower(title) || ' - ' || lower(artist) AS k, id FROM catalog WHERE id % 2 = 1) x WHERE k NOT IN (SELECT lower(title) || ' - ' || lower(artist) FROM catalog WHERE id % 2 = 0) GROUP BY k")
def A13_insert_missing(b: Bed) -> DataFrame:
    keyed = b.catalog.select(F.concat(F.lower("title"), F.lit(" - "), F.lower("artist")).alias("k"), "id")
    return M.insert_missing(keyed.filter("id % 2 = 0"), keyed.filter("id % 2 = 1"), ["k"], [F.col("id")])


@query("SELECT id, coalesce(c.bpm, v.bpm) AS bpm FROM catalog c LEFT JOIN (SELECT catalog_id, max(rb_bpm) AS bpm FROM library GROUP BY 1) v ON v.catalog_id = c.id")
def A14_guarded_update(b: Bed) -> DataFrame:
    values = b.library.groupBy(F.col("catalog_id").alias("id")).agg(F.max("rb_bpm").alias("bpm"))
    return M.fill_nulls(b.catalog.select("id", "bpm"), values, "id", ["bpm"])


@query(
    "WITH claims AS (SELECT id, 'ISRC' || CAST(id % 800 AS VARCHAR) AS isrc FROM catalog WHERE isrc IS NULL), win AS (SELECT isrc, min(id) AS id FROM claims WHERE isrc NOT IN (SELECT isrc FROM catalog WHERE isrc IS NOT NULL) GROUP BY 1) SELECT c.id, coalesce(c.isrc, w.isrc) AS isrc FROM catalog c LEFT JOIN win w ON w.id = c.id"
)
def A15_unique_fill(b: Bed) -> DataFrame:
    claims = b.catalog.filter("isrc is null").select("id", F.concat(F.lit("ISRC"), (F.col("id") % 800).cast("string")).alias("isrc"))
    return M.fill_unique(b.catalog.select("id", "isrc"), claims, "id", "isrc")


@query("SELECT l.user_id, l.catalog_id FROM library l WHERE NOT EXISTS (SELECT 1 FROM opinions o WHERE o.user_id = l.user_id AND CAST(o.entity_key AS BIGINT) = l.catalog_id)")
def A21_checkpoint_rest(b: Bed) -> DataFrame:
    keyed = b.library.select("user_id", "catalog_id", F.concat_ws(":", "user_id", "catalog_id").alias("key"))
    done = b.opinions.select(F.concat_ws(":", "user_id", "entity_key").alias("key"))
    return M.not_done(keyed, done, "key").select("user_id", "catalog_id")


_DUPES = "SELECT deezer_id, min(id) AS canonical FROM catalog WHERE deezer_id IS NOT NULL AND deezer_id <> 'NOT_FOUND' GROUP BY 1 HAVING count(*) > 1"


@query(
    "WITH g AS (" + _DUPES + "), m AS (SELECT c.id AS loser, g.canonical FROM catalog c JOIN g ON g.deezer_id = c.deezer_id WHERE c.id <> g.canonical) SELECT DISTINCT l.user_id, coalesce(m.canonical, l.catalog_id) AS catalog_id FROM library l LEFT JOIN m ON m.loser = l.catalog_id"
)
def K01_repoint(b: Bed) -> DataFrame:
    linked = b.catalog.filter("deezer_id is not null and deezer_id <> 'NOT_FOUND'").select("id", "deezer_id")
    groups = linked.groupBy("deezer_id").agg(F.min("id").alias("canonical"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    mapping = linked.join(groups, "deezer_id").filter("id <> canonical").select(F.col("id").alias("loser"), "canonical")
    return M.repoint(b.library.select("user_id", "catalog_id"), mapping, "catalog_id", ["user_id", "catalog_id"])


@query("SELECT id, list_distinct(list_transform(genres, lambda g: CASE WHEN g = 'red' THEN 'blue' ELSE g END)) IS NOT NULL AS has, len(list_distinct(list_transform(genres, lambda g: CASE WHEN g = 'red' THEN 'blue' ELSE g END))) AS n FROM catalog")
def K04_genre_merge(b: Bed) -> DataFrame:
    merged = F.array_distinct(F.transform("genres", lambda g: F.when(g == "red", "blue").otherwise(g)))
    return b.catalog.select("id", merged.isNotNull().alias("has"), F.size(merged).alias("n"))


@query(
    """WITH state AS (SELECT DISTINCT playlist_id, catalog_id FROM radar_tracks WHERE NOT initial),
    st AS (SELECT playlist_id, catalog_id, DATE '2000-01-01' AS detected_at, CASE WHEN catalog_id % 5 = 0 THEN DATE '2000-06-01' END AS removed_at FROM state),
    crawl AS (SELECT DISTINCT playlist_id, catalog_id FROM radar_tracks WHERE active AND playlist_id % 2 = 0)
    SELECT coalesce(s.playlist_id, c.playlist_id) AS playlist_id, coalesce(s.catalog_id, c.catalog_id) AS catalog_id, coalesce(s.detected_at, DATE '2001-01-01') AS detected_at,
           CASE WHEN c.playlist_id IS NOT NULL THEN NULL WHEN s.playlist_id IN (SELECT playlist_id FROM crawl) AND s.removed_at IS NULL THEN DATE '2001-01-01' ELSE s.removed_at END AS removed_at,
           CASE WHEN s.playlist_id IS NULL THEN 'inserted' WHEN c.playlist_id IS NOT NULL AND s.removed_at IS NOT NULL THEN 'restored'
                WHEN c.playlist_id IS NULL AND s.playlist_id IN (SELECT playlist_id FROM crawl) AND s.removed_at IS NULL THEN 'removed' ELSE 'kept' END AS change
    FROM st s FULL OUTER JOIN crawl c ON c.playlist_id = s.playlist_id AND c.catalog_id = s.catalog_id""",
    text=("detected_at", "removed_at"),
)
def K05_diff_lifecycle(b: Bed) -> DataFrame:
    state = b.radar_tracks.filter("not initial").select("playlist_id", "catalog_id").distinct()
    state = state.select("*", F.lit("2000-01-01").cast("date").alias("detected_at"), F.when(F.col("catalog_id") % 5 == 0, F.lit("2000-06-01").cast("date")).alias("removed_at"))
    crawl = b.radar_tracks.filter("active and playlist_id % 2 = 0").select("playlist_id", "catalog_id").distinct()
    return M.lifecycle(state, crawl, ["playlist_id", "catalog_id"], "playlist_id", F.lit("2001-01-01").cast("date"))


@query("SELECT playlist_id, catalog_id, CASE WHEN a AND NOT s THEN 'ANOMALY' WHEN s AND NOT a AND loc THEN 'MISPLACED' WHEN s AND NOT a THEN 'DOWNLOAD_NEEDED' END AS issue FROM (SELECT coalesce(l.playlist_id, r.playlist_id) AS playlist_id, coalesce(l.catalog_id, r.catalog_id) AS catalog_id, l.playlist_id IS NOT NULL AS a, r.playlist_id IS NOT NULL AS s, coalesce(l.catalog_id, r.catalog_id) IN (SELECT catalog_id FROM radar_tracks WHERE active) AS loc FROM (SELECT DISTINCT playlist_id, catalog_id FROM radar_tracks WHERE active) l FULL OUTER JOIN (SELECT DISTINCT playlist_id, catalog_id FROM radar_tracks WHERE initial) r ON r.playlist_id = l.playlist_id AND r.catalog_id = l.catalog_id) x WHERE a <> s")
def P31_reconcile(b: Bed) -> DataFrame:
    lists = b.radar_tracks.select(F.col("playlist_id").alias("playlist"), F.col("catalog_id").alias("key"), "active", "initial")
    library, streaming = lists.filter("active").select("playlist", "key").distinct(), lists.filter("initial").select("playlist", "key").distinct()
    return L.reconcile(library, streaming, library.select("key", "playlist")).select(F.col("playlist").alias("playlist_id"), F.col("key").alias("catalog_id"), "issue")


@query(
    "SELECT deezer_id, id FROM (SELECT *, row_number() OVER (PARTITION BY deezer_id ORDER BY isrc IS NULL, created_at NULLS LAST, (CASE WHEN bpm IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN key IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN duration_ms IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN label IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN release_date IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN has_artwork THEN 1 ELSE 0 END + CASE WHEN has_preview THEN 1 ELSE 0 END) DESC, id) AS n FROM catalog WHERE deezer_id IS NOT NULL AND deezer_id <> 'NOT_FOUND') x WHERE n = 1"
)
def P04_canonical_pick(b: Bed) -> DataFrame:
    return L.pick_canonical(b.catalog.filter("deezer_id is not null and deezer_id <> 'NOT_FOUND'"), ["deezer_id"]).select("deezer_id", "id")


@query(
    r"""WITH RECURSIVE plain_ AS (SELECT deezer_id, id, isrc, trim(regexp_replace(regexp_replace(lower(trim(title)), '\s*[(\[]\s*original(?:\s+mix)?\s*[)\]]\s*$', ''), '\s+(?:featuring|feat|ft)\b\.?\s[^(\[]*$', '')) AS plain FROM catalog WHERE deezer_id <> 'NOT_FOUND'),
    r AS (SELECT *, row_number() OVER (PARTITION BY deezer_id ORDER BY id) AS k FROM plain_),
    st AS (
        SELECT deezer_id, CAST(1 AS BIGINT) AS k, [id] AS ids, [id] AS seeds FROM r WHERE k = 1
        UNION ALL
        SELECT st.deezer_id, r.k, list_append(st.ids, r.id), list_append(st.seeds, coalesce((
            SELECT min(x.seed) FROM (
                SELECT z.seed, bool_and(CASE WHEN r.isrc IS NOT NULL AND m.isrc IS NOT NULL THEN r.isrc = m.isrc ELSE r.plain = m.plain END) AS ok
                FROM (SELECT unnest(st.ids) AS id, unnest(st.seeds) AS seed) z JOIN r m ON m.id = z.id GROUP BY z.seed) x WHERE x.ok), r.id))
        FROM st JOIN r ON r.deezer_id = st.deezer_id AND r.k = st.k + 1
    )
    SELECT deezer_id, unnest(ids) AS id, unnest(seeds) AS cluster FROM (SELECT *, max(k) OVER (PARTITION BY deezer_id) AS last_ FROM st) e WHERE k = last_"""
)
def P03_cliques(b: Bed) -> DataFrame:
    return L.cliques(b.catalog.filter("deezer_id <> 'NOT_FOUND'"), "deezer_id")


@query(
    "SELECT deezer_id, arg_min(id, n) AS id, arg_min(bpm, n) FILTER (WHERE bpm IS NOT NULL) AS bpm, arg_min(label, n) FILTER (WHERE label IS NOT NULL) AS label, arg_min(isrc, n) FILTER (WHERE isrc IS NOT NULL) AS isrc, bool_or(has_artwork) AS has_artwork, max(attempts) AS attempts, max(searched_at) AS searched_at, CASE WHEN bool_or(scope = 'shared') THEN 'shared' ELSE 'private' END AS scope, count(*) AS merged FROM (SELECT *, row_number() OVER (PARTITION BY deezer_id ORDER BY isrc IS NULL, created_at NULLS LAST, (CASE WHEN bpm IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN key IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN label IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN release_date IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN has_artwork THEN 1 ELSE 0 END + CASE WHEN has_preview THEN 1 ELSE 0 END) DESC, id) AS n FROM catalog WHERE deezer_id IS NOT NULL AND deezer_id <> 'NOT_FOUND') x GROUP BY 1",
    text=("searched_at",),
)
def P05_merge_tracks(b: Bed) -> DataFrame:
    rows = b.catalog.filter("deezer_id is not null and deezer_id <> 'NOT_FOUND'")
    return L.merge_tracks(rows, "deezer_id").select("deezer_id", "id", "bpm", "label", "isrc", "has_artwork", "attempts", "searched_at", "scope", "merged")


@query(
    "SELECT c.id, c.artist, a.name AS linked FROM catalog c JOIN (SELECT catalog_id, artist_id FROM (SELECT *, row_number() OVER (PARTITION BY catalog_id ORDER BY position, artist_id) AS n FROM catalog_artists) x WHERE n = 1) f ON f.catalog_id = c.id JOIN artists a ON a.id = f.artist_id WHERE NOT contains(lower(trim(c.artist)), lower(trim(a.name))) AND NOT contains(lower(trim(a.name)), lower(trim(c.artist)))"
)
def P08_artist_divergence(b: Bed) -> DataFrame:
    return L.divergent(b.catalog, b.catalog_artists, b.artists)


PAIRS_SQL = """
    WITH mem AS (SELECT playlist_id AS set_id, catalog_id AS mtid, row_number() OVER (PARTITION BY playlist_id ORDER BY detected_at, catalog_id) AS position FROM radar_tracks WHERE active),
    st AS (SELECT c_custkey AS id, c_mktsegment || ' night ' || CAST(c_nationkey % 4 AS VARCHAR) AS title, DATE '2020-01-01' + CAST(c_custkey % 40 AS INT) AS played_date, CASE WHEN c_custkey % 10 = 0 THEN CAST(c_custkey % 3 AS INT) END AS part FROM customer),
    sz AS (SELECT set_id, count(*) AS len, arg_min(mtid, position) AS opener FROM mem GROUP BY 1),
    f AS (SELECT set_id, mtid, min(position) AS pos FROM mem GROUP BY 1, 2),
    idf AS (SELECT mtid, 1 / log2(1 + greatest(count(*), 1)) AS w FROM f GROUP BY 1),
    mass AS (SELECT f.set_id, sum(w) AS mass FROM f JOIN idf ON idf.mtid = f.mtid GROUP BY 1),
    sh AS (SELECT * FROM (SELECT x.set_id AS a, y.set_id AS b, x.mtid, x.pos AS pa, y.pos AS pb, w, count(*) OVER (PARTITION BY x.set_id, y.set_id) AS n FROM f x JOIN f y ON x.mtid = y.mtid AND x.set_id < y.set_id JOIN idf ON idf.mtid = x.mtid) q WHERE n >= 3),
    rk AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY pa, mtid) - row_number() OVER (PARTITION BY a, b ORDER BY pb, mtid) AS d FROM sh),
    pr AS (SELECT a, b, max(n) AS shared, sum(w) AS w, 1 - 6 * sum(d * d) / (max(n) * (max(n) * max(n) - 1)) AS order_corr FROM rk GROUP BY 1, 2),
    sig AS (
        SELECT pr.a, pr.b, pr.shared, pr.shared / least(za.len, zb.len) AS overlap, pr.w / CASE WHEN za.len <= zb.len THEN ma.mass ELSE mb.mass END AS weighted,
               len(list_intersect(split(sa.title, ' '), split(sb.title, ' '))) / len(list_distinct(list_concat(split(sa.title, ' '), split(sb.title, ' ')))) AS title_sim,
               CAST(abs(sa.played_date - sb.played_date) AS INT) AS gap, za.opener = zb.opener AS same_opener, order_corr, sa.part AS part_a, sb.part AS part_b
        FROM pr JOIN sz za ON za.set_id = pr.a JOIN sz zb ON zb.set_id = pr.b JOIN mass ma ON ma.set_id = pr.a JOIN mass mb ON mb.set_id = pr.b JOIN st sa ON sa.id = pr.a JOIN st sb ON sb.id = pr.b
    ),
    conf AS (SELECT *, least(1.0, (0.55 * weighted + 0.25 * title_sim + 0.1 * greatest(order_corr, 0) + 0.1 * CASE WHEN same_opener THEN 1 ELSE 0 END) * CASE WHEN gap <= 1 THEN 1.15 WHEN gap = 2 THEN 1 WHEN gap <= 30 THEN 0.6 ELSE 0.3 END) AS c FROM sig)"""


def _pairs(b: Bed) -> DataFrame:
    members = b.radar_tracks.filter("active").select(F.col("playlist_id").alias("set_id"), F.col("catalog_id").alias("mtid"), "detected_at")
    members = members.withColumn("position", F.row_number().over(Window.partitionBy("set_id").orderBy("detected_at", "mtid")))
    key = F.col("c_custkey")
    title = F.concat("c_mktsegment", F.lit(" night "), (F.col("c_nationkey") % 4).cast("string"))
    sets = b.customer.select(key.alias("id"), title.alias("title"), F.date_add(F.lit("2020-01-01").cast("date"), (key % 40).cast("int")).alias("played_date"), F.when(key % 10 == 0, (key % 3).cast("int")).alias("part"))
    return L.set_pairs(sets, members)


@query(PAIRS_SQL + " SELECT a, b, shared, round(overlap, 6) AS overlap, round(weighted, 6) AS weighted, round(title_sim, 6) AS title_sim, gap, same_opener, round(order_corr, 6) AS order_corr, round_even(c, 4) AS confidence FROM conf")
def P14_set_pair_signals(b: Bed) -> DataFrame:
    r = lambda c, n: F.round(c, n).alias(c)
    return _pairs(b).select("a", "b", "shared", r("overlap", 6), r("weighted", 6), r("title_sim", 6), "gap", "same_opener", r("order_corr", 6), "confidence")


@query(
    PAIRS_SQL
    + """ SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN coalesce(part_a <> part_b, FALSE) THEN 'nothing' WHEN overlap >= 0.8 AND (title_sim >= 0.5 OR gap <= 1) THEN CASE WHEN gap > 2 THEN 'flag' ELSE 'attach' END
       WHEN c >= 0.45 THEN 'flag' WHEN title_sim >= 0.9 AND overlap >= 0.3 THEN 'flag' ELSE 'nothing' END AS verdict FROM conf) v GROUP BY 1"""
)
def P17_verdicts(b: Bed) -> DataFrame:
    return _pairs(b).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT title, id FROM (SELECT title, id, n, row_number() OVER (PARTITION BY lower(title) ORDER BY n DESC, title) AS k FROM (SELECT title, min(id) AS id, count(*) AS n FROM sets GROUP BY 1) a) x WHERE k = 1"
)
def P38_most_frequent_spelling(b: Bed) -> DataFrame:
    n = b.sets.groupBy("title").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).withColumn("folded", F.lower("title"))
    return one_per(n, ["folded"], [F.desc("n"), F.col("title")]).select("title", "id")


@query("SELECT id, CASE WHEN scope = 'private' AND deezer_id IS NOT NULL AND deezer_id <> 'NOT_FOUND' THEN 'shared' ELSE scope END AS scope, CASE WHEN scope = 'private' AND deezer_id IS NOT NULL AND deezer_id <> 'NOT_FOUND' THEN NULL ELSE owner_id END AS owner_id FROM catalog")
def P41_promotion(b: Bed) -> DataFrame:
    promoted = (F.col("scope") == "private") & F.coalesce(F.col("deezer_id") != "NOT_FOUND", F.lit(False))
    return b.catalog.select("id", F.when(promoted, "shared").otherwise(F.col("scope")).alias("scope"), F.when(~promoted, F.col("owner_id")).alias("owner_id"))


@query(
    "SELECT id, lower(title) AS text, CASE WHEN regexp_matches(lower(title), 'part [0-9]+$') THEN regexp_replace(lower(title), ' part [0-9]+$', '') ELSE lower(title) END AS base_title, TRY_CAST(regexp_extract(lower(title), 'part ([0-9]+)$', 1) AS INT) AS part_number FROM sets"
)
def H11_set_title_parts(b: Bed) -> DataFrame:
    t = X.set_title(F.col("title"))
    return b.sets.select("id", t["text"].alias("text"), t["base_title"].alias("base_title"), t["part_number"].alias("part_number"))


@query(
    r"SELECT id, trim(regexp_replace(regexp_replace(lower(trim(title)), '\s*[(\[]\s*original(?:\s+mix)?\s*[)\]]\s*$', ''), '\s+(?:featuring|feat|ft)\b\.?\s[^(\[]*$', '')) AS plain, lower(trim(title)) || ' - ' || lower(trim(artist)) AS key FROM catalog".replace(
        "lower(trim(title)) || ' - '", "regexp_replace(lower(trim(title)), '\\b(ft|feat)\\.', '\\1', 'g') || ' - '"
    )
)
def H08_track_titles(b: Bed) -> DataFrame:
    return b.catalog.select("id", X.track_title(F.col("title")).alias("plain"), X.normalized_key(F.col("title"), F.col("artist")).alias("key"))


@query(
    """SELECT id, 'ampersand' AS rule, artist AS token, 'primary' AS role, 0 AS position FROM catalog WHERE label IS NOT NULL
       UNION ALL SELECT id, 'ampersand', label, 'primary', 1 FROM catalog WHERE label IS NOT NULL
       UNION ALL SELECT id, 'single', artist, 'primary', 0 FROM catalog WHERE label IS NULL"""
)
def J05_artist_parts(b: Bed) -> DataFrame:
    raw = b.catalog.select("id", F.concat_ws(" & ", "artist", "label").alias("raw"))
    return raw.select("id", X.artist_parts(F.col("raw")).alias("p")).select("id", "p.rule", F.inline("p.parts"))


@query(
    """WITH ch AS (SELECT CAST(floor(id / 10) AS BIGINT) AS parent, id AS set_id FROM sets WHERE id % 10 < 3),
    od AS (SELECT parent, set_id, row_number() OVER (PARTITION BY parent ORDER BY known DESC, set_id) AS child FROM (
        SELECT ch.parent, ch.set_id, count(*) FILTER (WHERE NOT t.is_id) AS known FROM ch JOIN set_tracks t ON t.set_id = ch.set_id GROUP BY 1, 2) k),
    tt AS (SELECT od.parent, od.set_id, od.child, t.catalog_id AS mtid, t.timecode_ms, t.position FROM od JOIN set_tracks t ON t.set_id = od.set_id),
    ref AS (SELECT parent, mtid, arg_max(timecode_ms, position) AS at_ FROM tt WHERE child = 1 AND mtid IS NOT NULL GROUP BY 1, 2),
    dl AS (SELECT tt.parent, tt.set_id, quantile_cont(tt.timecode_ms - ref.at_, 0.5) AS med, count(*) AS n FROM tt JOIN ref ON ref.parent = tt.parent AND ref.mtid = tt.mtid WHERE tt.child > 1 GROUP BY 1, 2),
    adj AS (SELECT tt.parent, tt.mtid, tt.timecode_ms - CASE WHEN dl.n >= 3 THEN CAST(trunc(dl.med) AS INT) ELSE 0 END AS timecode_ms, tt.child * 1000000 + tt.position AS place_,
                   min(tt.child * 1000000 + tt.position) OVER (PARTITION BY tt.parent, tt.mtid) AS first_ FROM tt LEFT JOIN dl ON dl.parent = tt.parent AND dl.set_id = tt.set_id),
    pool AS (SELECT parent, mtid, timecode_ms, first_ AS arrived FROM (SELECT *, row_number() OVER (PARTITION BY parent, mtid ORDER BY timecode_ms IS NULL, place_) AS n FROM adj WHERE mtid IS NOT NULL) a WHERE n = 1
             UNION ALL SELECT parent, mtid, timecode_ms, place_ FROM adj WHERE mtid IS NULL),
    kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY parent, coalesce(mtid, -1) ORDER BY mtid IS NULL, arrived) AS n FROM pool) b WHERE n = 1)
    SELECT parent, mtid, 'a' AS raw_artist, CAST(mtid AS VARCHAR) AS raw_title, timecode_ms, row_number() OVER (PARTITION BY parent ORDER BY timecode_ms NULLS LAST, mtid IS NULL, arrived) AS place FROM kept"""
)
def P21_merge_duplicates(b: Bed) -> DataFrame:
    children = b.sets.filter("id % 10 < 3").select(F.floor(F.col("id") / 10).alias("parent"), F.col("id").alias("set_id"))
    tracks = b.set_tracks.select("set_id", F.col("catalog_id").alias("mtid"), F.lit("a").alias("raw_artist"), F.col("catalog_id").cast("string").alias("raw_title"), "timecode_ms", "is_id", "position")
    return T.merge_duplicates(children, tracks)


@query(
    """WITH ch AS (SELECT CAST(floor(id / 10) AS BIGINT) AS parent, id AS set_id, CAST(id % 10 AS INT) AS part_number FROM sets WHERE id % 10 < 3),
    ord AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY part_number, set_id) AS nth FROM ch),
    len_ AS (SELECT o.parent, o.nth, CASE WHEN o.part_number = 1 THEN 3600000 ELSE coalesce(arg_max(t.timecode_ms, t.position), 0) + 180000 END AS length FROM ord o LEFT JOIN set_tracks t ON t.set_id = o.set_id GROUP BY o.parent, o.nth, o.part_number),
    sft AS (SELECT parent, nth, CAST(coalesce(sum(length) OVER (PARTITION BY parent ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS shift FROM len_),
    tr AS (SELECT o.parent, o.set_id, o.nth, t.catalog_id AS mtid, t.timecode_ms + s.shift AS timecode_ms, t.position FROM ord o JOIN set_tracks t ON t.set_id = o.set_id JOIN sft s ON s.parent = o.parent AND s.nth = o.nth),
    lg AS (SELECT *, lag(nth) OVER w AS bn, lag(mtid) OVER w AS bm FROM tr WINDOW w AS (PARTITION BY parent ORDER BY nth, position))
    SELECT parent, set_id, mtid, timecode_ms, row_number() OVER (PARTITION BY parent ORDER BY nth, position) AS place FROM lg WHERE NOT (coalesce(bn <> nth, FALSE) AND coalesce(bm = mtid, FALSE))"""
)
def P22_merge_parts(b: Bed) -> DataFrame:
    children = b.sets.filter("id % 10 < 3").select(F.floor(F.col("id") / 10).alias("parent"), F.col("id").alias("set_id"), (F.col("id") % 10).cast("int").alias("part_number"))
    children = children.withColumn("duration_ms", F.when(F.col("part_number") == 1, 3_600_000))
    tracks = b.set_tracks.select("set_id", F.col("catalog_id").alias("mtid"), F.lit(None).cast("string").alias("raw_artist"), F.lit(None).cast("string").alias("raw_title"), F.col("timecode_ms").cast("long").alias("timecode_ms"), "position")
    return T.merge_parts(children, tracks)
