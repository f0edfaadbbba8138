"""Sources over files written from the tables, text and time functions, listings and transitions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecrate.functions import music
from wavecrate.functions import text as X
from wavecrate.functions import time as D
from wavecrate.operators import artists as A
from wavecrate.operators import backlog as B
from wavecrate.operators import embeddings as E
from wavecrate.operators import enrichment as R
from wavecrate.operators import genres as G
from wavecrate.operators import library, similarity
from wavecrate.operators import linkage as L
from wavecrate.operators import listings as V
from wavecrate.operators import sets as S
from wavecrate.plans import merge as M
from wavecrate.queries.registry import query
from wavecrate.queries.scoring import CONTEXT_SQL, SCORED_SQL, _context
from wavecrate.scratch import scratch_dir
from wavecrate.sources import files
from wavecrate.streaming import deadletter
from wavecrate.testbed import Bed


def _path(b: Bed, name: str) -> str:
    return f"{scratch_dir(b.spark)}/{name}-{uuid.uuid4().hex}"


# --- sources ----------------------------------------------------------------


@query("SELECT CAST(child_id AS VARCHAR) AS from_id, CAST(parent_id AS VARCHAR) AS to_id, type FROM genre_edges WHERE child_id <> 12 AND parent_id <> 12")
def A03_taxonomy_files(b: Bed) -> DataFrame:
    """Edges with an end that the file of nodes lacks are left out."""
    nodes, edges = _path(b, "nodes"), _path(b, "edges")
    files.export_csv(b.genre_nodes.filter("id <> 12").select("id", F.concat(F.lit(" "), "label").alias("label")), nodes)
    files.export_csv(b.genre_edges.select("child_id", "parent_id", "type", F.lit("x").alias("source")), edges)
    known, _ = files.taxonomy_edges(b.spark, edges, files.taxonomy_nodes(b.spark, nodes))
    return known.select("from_id", "to_id", "type")


@query("SELECT id, title, bpm FROM catalog")
def A04_export(b: Bed) -> DataFrame:
    path = _path(b, "catalog")
    files.export_csv(b.catalog.select("id", "title", "bpm"), path)
    return b.spark.read.csv(path, header=True, schema="id long, title string, bpm double")


@query("SELECT CAST(id AS INT) AS track_id, title, bpm, key, CAST(duration_ms / 1000 AS BIGINT) * 1000 AS duration_ms FROM catalog")
def A05_library_file(b: Bed) -> DataFrame:
    path = _path(b, "library")
    c = b.catalog.select(
        F.col("id").alias("_TrackID"), F.col("title").alias("_Name"), F.col("artist").alias("_Artist"), F.col("bpm").alias("_AverageBpm"), F.col("key").alias("_Tonality"),
        F.expr("duration_ms div 1000").alias("_TotalTime"), F.lit(None).cast("string").alias("_DateAdded"), F.lit("/x").alias("_Location"),
    )
    c.write.format("xml").option("rowTag", "TRACK").option("rootTag", "COLLECTION").save(path)
    return files.library_xml(b.spark, path).select("track_id", "title", "bpm", "key", "duration_ms")


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN TRUE ELSE event_id % 3 = 0 END AS again FROM events")
def A07_changed(b: Bed) -> DataFrame:
    crawled = F.when(F.col("event_id") % 5 != 0, F.when(F.col("event_id") % 3 == 0, F.col("ts") - F.expr("INTERVAL '1' HOUR")).otherwise(F.col("ts")))
    return b.events.select("event_id", files.changed(F.col("ts"), crawled).alias("again"))


@query("SELECT CAST(id AS VARCHAR) AS id, title, bpm, label, isrc FROM catalog")
def A09_payloads(b: Bed) -> DataFrame:
    c = b.catalog
    page = F.to_json(F.struct(F.col("id").alias("track_id"), F.col("title").alias("track_name"), "bpm", F.struct(F.col("label").alias("label_name")).alias("label"), "isrc"))
    api = F.to_json(F.struct("id", F.col("title").alias("name"), "bpm", F.struct(F.struct(F.col("label").alias("name")).alias("label")).alias("release"), "isrc"))
    odd = F.col("id") % 2 == 1
    return files.payload_rows(c.select(F.when(odd, page).otherwise(api).alias("payload"), F.when(odd, "page").otherwise("api").alias("shape"))).select("id", "title", "bpm", "label", "isrc")


@query("SELECT id, CASE WHEN id % 3 = 1 THEN CAST(id + duration_ms AS DOUBLE) END AS total FROM catalog")
def A11_vector_texts(b: Bed) -> DataFrame:
    """Vectors of another size, and what is no vector, are null."""
    good = F.concat(F.lit("["), F.col("id").cast("string"), F.lit(","), F.col("duration_ms").cast("string"), F.lit("]"))
    raw = F.when(F.col("id") % 3 == 1, good).when(F.col("id") % 3 == 2, "[1]").otherwise("none")
    v = E.parsed(raw, 2)
    return b.catalog.select("id", (v[0].cast("double") + v[1].cast("double")).alias("total"))


@query("SELECT vec_id AS id, label FROM embeddings WHERE len(embedding) = 64 OR len(embedding) = (SELECT max(len(embedding)) FROM embeddings)")
def T02_vectors_of_one_size(b: Bed) -> DataFrame:
    """Vectors come back from their text file if they have the size asked for."""
    path, e = _path(b, "vectors"), b.embeddings
    size = e.agg(F.max(F.size("embedding"))).first()[0]
    text = F.concat(F.lit("["), F.array_join(F.transform("embedding", lambda x: x.cast("string")), ","), F.lit("]"))
    files.export_csv(e.select(F.col("vec_id").alias("id"), F.lit("ok").alias("status"), F.size("embedding").alias("dim"), text.alias("emb")), path)
    return files.vectors_csv(b.spark, path, size).join(e.select(F.col("vec_id").alias("id"), "label"), "id").select("id", "label")


@query("SELECT event_id FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type = 'error') x WHERE n <= 1000")
def Q10_dead_letters(b: Bed) -> DataFrame:
    return deadletter.latest(b.events.filter("event_type = 'error'")).select("event_id")


# --- functions --------------------------------------------------------------


@query("SELECT p_partkey AS id, round(len(list_intersect(split(p_name, ' '), split(p_name || ' ' || p_type, ' '))) / len(list_distinct(split(p_name || ' ' || p_type, ' '))), 6) AS sim FROM part")
def H13_token_jaccard(b: Bed) -> DataFrame:
    return b.part.select(F.col("p_partkey").alias("id"), F.round(X.token_jaccard(F.col("p_name"), F.concat_ws(" ", "p_name", "p_type")), 6).alias("sim"))


@query("SELECT id, CASE id % 5 WHEN 0 THEN '8A' WHEN 1 THEN '8B' WHEN 2 THEN '1A' WHEN 3 THEN '11A' END AS wheel FROM catalog")
def H15_key_names(b: Bed) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, ("A Minor", "C Major", "Ab Minor", "F# Minor", "H Minor"))), (F.col("id") % 5 + 1).cast("int"))
    return b.catalog.select("id", music.key_to_camelot(name).alias("wheel"))


@query("SELECT id, CASE WHEN id % 4 = 0 THEN NULL WHEN id % 4 = 1 THEN (id % 3) * 86400000 + (id % 24) * 3600000 + (id % 60) * 60000 + 7000 + 500 ELSE (id % 24) * 3600000 + (id % 60) * 60000 + 7000 END AS ms FROM catalog")
def H20_time_spans(b: Bed) -> DataFrame:
    two = lambda n: F.lpad((F.col("id") % n).cast("string"), 2, "0")
    clock = F.concat(two(24), F.lit(":"), two(60), F.lit(":07"))
    span = F.when(F.col("id") % 4 == 0, "soon").when(F.col("id") % 4 == 1, F.concat((F.col("id") % 3).cast("string"), F.lit("."), clock, F.lit(".5000000"))).otherwise(clock)
    return b.catalog.select("id", D.timespan_ms(span).alias("ms"))


@query("SELECT id, CASE WHEN id % 3 > 0 AND release_date IS NOT NULL THEN strftime(release_date, '%Y-%m-%d') END AS day FROM catalog")
def H21_iso_dates(b: Bed) -> DataFrame:
    text = F.when(F.col("id") % 3 == 0, "0001-01-01T00:00:00").otherwise(F.concat(F.date_format("release_date", "yyyy-MM-dd"), F.lit("T10:00:00Z")))
    return b.catalog.select("id", F.date_format(D.iso_date(text), "yyyy-MM-dd").alias("day"))


@query("SELECT id, id % 4 IN (0, 2) AS unknown FROM catalog")
def H22_unidentified(b: Bed) -> DataFrame:
    title = F.element_at(F.array(F.lit(" ID "), F.col("title"), F.lit(""), F.lit("ID")), (F.col("id") % 4 + 1).cast("int"))
    return b.catalog.select("id", X.is_id_track(title, F.when(F.col("id") % 4 == 0, "id").otherwise(F.col("artist"))).alias("unknown"))


@query("SELECT set_id, n <= 0 OR k / n >= 0.8 OR (set_id % 5 = 0 AND set_id % 2 = 0) AS bad FROM (SELECT set_id, count(*) AS n, count(*) FILTER (WHERE is_id) AS k FROM set_tracks GROUP BY 1) x")
def H23_unreliable_sets(b: Bed) -> DataFrame:
    n = b.set_tracks.groupBy("set_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_id"), True)).alias("k"))
    url = F.when(F.col("set_id") % 5 != 0, "https://x")
    return n.select("set_id", D.set_unreliable(F.col("n"), F.col("k"), url, F.col("set_id") % 2 == 0).alias("bad"))


@query("SELECT event_id, round(epoch(ts - TIMESTAMP '2024-01-01') / 86400.0, 4) AS days FROM events")
def H26_day_gaps(b: Bed) -> DataFrame:
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return b.events.select("event_id", F.round(D.days_between(F.col("ts").cast("timestamp_ntz"), start), 4).alias("days"))


@query("SELECT id, starts_with(md5(title), 'a') AS generic, md5(lower(trim(title))) AS key FROM catalog")
def H31_digests(b: Bed) -> DataFrame:
    return b.catalog.select("id", X.is_placeholder(F.col("title").cast("binary"), "a").alias("generic"), X.cache_key(F.col("title")).alias("key"))


@query("SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k FROM events")
def H27_json_counter(b: Bed) -> DataFrame:
    from wavecrate.operators.monitoring import counter

    return b.events.select("event_id", counter("props", "k").alias("k"))


@query("SELECT id, CASE WHEN id % 3 = 0 THEN TRUE ELSE FALSE END AS stylized, CASE id % 3 WHEN 0 THEN NULL WHEN 1 THEN artist ELSE artist || ' x' END AS first_ FROM catalog")
def H07_stylized_names(b: Bed) -> DataFrame:
    name = F.when(F.col("id") % 3 == 0, "A B C def").when(F.col("id") % 3 == 1, F.concat("artist", F.lit(" & somebody else"))).otherwise(F.concat("artist", F.lit(" x, other")))
    return b.catalog.select("id", X.is_stylized(name).alias("stylized"), X.first_artist(name).alias("first_"))


@query("SELECT s_suppkey AS id, 'eoss ' || lower(s_name) AS fold FROM supplier")
def J03_folds(b: Bed) -> DataFrame:
    return b.supplier.select(F.col("s_suppkey").alias("id"), X.ascii_fold(F.concat(F.lit(" Éöşś "), "s_name")).alias("fold"))


@query("SELECT a.id, b.id AS other, round(CASE WHEN len(a.genres) > 0 AND len(b.genres) > 0 THEN len(list_intersect(a.genres, b.genres)) / len(list_distinct(list_concat(a.genres, b.genres))) ELSE 0 END, 6) AS sim FROM (SELECT id, list_distinct(genres) AS genres FROM catalog) a JOIN (SELECT id, list_distinct(genres) AS genres FROM catalog) b ON b.id = a.id + 1")
def L11_legacy_overlap(b: Bed) -> DataFrame:
    c = b.catalog.select("id", F.array_distinct("genres").alias("g"))
    other = c.select((F.col("id") - 1).alias("id"), F.col("id").alias("other"), F.col("g").alias("h"))
    return c.join(other, "id").select("id", "other", F.round(music.sim_cooc(F.col("g"), F.col("h")), 6).alias("sim"))


# --- filters, sorts, listings -----------------------------------------------


@query("SELECT id, key IN ('1A', '2B', '3A') AS inside, coalesce(key NOT IN ('1A', '2B'), FALSE) AS outside FROM catalog")
def B12_literal_lists(b: Bed) -> DataFrame:
    return b.catalog.select("id", F.col("key").isin("1A", "2B", "3A").alias("inside"), F.coalesce(~F.col("key").isin("1A", "2B"), F.lit(False)).alias("outside"))


@query("SELECT id FROM catalog WHERE searched_at IS NULL OR searched_at < DATE '2024-06-01' - INTERVAL 24 HOUR")
def B15_cooldown(b: Bed) -> DataFrame:
    as_of = F.lit("2024-06-01").cast("timestamp_ntz")
    return b.catalog.filter(B.cooled(as_of, F.col("searched_at").cast("timestamp_ntz"))).select("id")


@query("SELECT id, unnest(genres) AS genre FROM catalog")
def C13_exploded_genres(b: Bed) -> DataFrame:
    return G.exploded(b.catalog).select("id", "genre")


@query("SELECT genre, n, count(*) OVER () AS total FROM (SELECT genre, count(*) AS n FROM (SELECT unnest(genres) AS genre FROM catalog) x GROUP BY 1) g ORDER BY n DESC, genre LIMIT 20")
def E05_page_total(b: Bed) -> DataFrame:
    n = G.exploded(b.catalog).groupBy("genre").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.count(F.lit(1)).alias("total"))
    return n.orderBy(F.desc("n"), "genre").limit(20).crossJoin(F.broadcast(total))


@query("SELECT id, place, (SELECT greatest(count(*) - 50, 0) FROM playlists) AS dropped_by_cap FROM (SELECT id, row_number() OVER (ORDER BY followers > 5000 DESC, followers DESC NULLS LAST, id) AS place FROM playlists) x WHERE place <= 50")
def R05_crawl_batch(b: Bed) -> DataFrame:
    rows = b.playlists.select("id", (F.col("followers") > 5000).alias("followed"), F.col("followers").alias("changed_at"))
    return B.batch(rows, 50).select("id", "place", "dropped_by_cap")


@query("SELECT 1 AS n, TRUE AS member")
def F11_random_one(b: Bed) -> DataFrame:
    """Whatever is drawn is one row of the table, and not the one left out."""
    drawn = V.random_one(b.catalog.select("id"), seed=3, without=5).withColumn("ok", F.col("id") != 5)
    return drawn.join(b.catalog.select("id"), "id", "left_semi").agg(F.count(F.lit(1)).cast("int").alias("n"), F.min("ok").alias("member"))


@query("SELECT id, label, total FROM (SELECT id, label, count(*) OVER () AS total, row_number() OVER (ORDER BY label, id) AS n FROM genre_nodes WHERE contains(lower(label), 'o')) x WHERE n > 2 AND n <= 10")
def V16_taxonomy_page(b: Bed) -> DataFrame:
    return V.taxonomy(b.genre_nodes, " O ", limit=8, offset=2)


_FLAGS = "SELECT id, id AS a, CASE WHEN id % 3 > 0 THEN id + 1 END AS b, CASE WHEN id % 4 > 0 THEN price END AS confidence, CASE WHEN id % 2 = 0 THEN 'pending' ELSE 'resolved' END AS status, played_date AS created_at, CASE WHEN id % 5 = 0 THEN ARRAY(id, id + 1, -1L) END AS members FROM {sets}"


@query(
    "WITH f AS ("
    + _FLAGS.format(sets="sets").replace("ARRAY(id, id + 1, -1L)", "[id, id + 1, -1]")
    + "), p AS (SELECT f.*, s.title AS title_a, t.title AS title_b, row_number() OVER (ORDER BY confidence DESC NULLS LAST, created_at DESC, f.id) AS n FROM f JOIN sets s ON s.id = f.a LEFT JOIN sets t ON t.id = f.b WHERE f.status = 'pending') "
    "SELECT p.id, title_a, title_b, confidence, CASE WHEN members IS NULL THEN '' ELSE coalesce((SELECT title FROM sets WHERE id = p.members[1]), '') || '|' || coalesce((SELECT title FROM sets WHERE id = p.members[2]), '') || '|' END AS member_titles, (SELECT count(*) FROM f WHERE status = 'pending') AS total FROM p WHERE n > 10 AND n <= 210"
)
def V15_set_flags(b: Bed) -> DataFrame:
    flags = b.spark.sql(_FLAGS, sets=b.sets)
    return S.flag_listing(flags, b.sets, "pending", 200, 10).withColumn("member_titles", F.array_join("member_titles", "|"))


@query(
    "WITH own AS (SELECT DISTINCT k.artist_id, m.node_id FROM catalog_artists k JOIN (SELECT id, unnest(genres) AS g FROM catalog) c ON c.id = k.catalog_id JOIN genre_map m ON m.raw_name = c.g WHERE m.node_id IS NOT NULL), "
    "r AS (SELECT o.artist_id, m.raw_name, row_number() OVER (PARTITION BY o.artist_id ORDER BY m.node_id, m.raw_name) AS n FROM own o JOIN genre_map m ON m.node_id = o.node_id) SELECT artist_id, string_agg(raw_name, '|' ORDER BY n) AS genres FROM r WHERE n <= 5 GROUP BY 1"
)
def M05_direct_genres(b: Bed) -> DataFrame:
    out = similarity.direct_genres(b.artists.select(F.col("id").alias("artist_id")), b.catalog_artists, b.catalog, b.genre_map)
    return out.select("artist_id", F.array_join("genres", "|").alias("genres"))


@query(
    "WITH seeds AS (SELECT id AS seed FROM catalog WHERE id % 100 = 0), "
    + CONTEXT_SQL
    + ","
    + SCORED_SQL
    + """, mine AS (SELECT DISTINCT catalog_id FROM library WHERE user_id = 7),
    top AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY score DESC, cooc_only, id) AS rank FROM scored WHERE score >= 0.05 AND id IN (SELECT catalog_id FROM mine)),
    lone AS (SELECT *, row_number() OVER (PARTITION BY seed, coalesce('a' || album, 't' || id) ORDER BY rank) AS k FROM top WHERE rank <= 100),
    placed AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY rank) AS place FROM lone WHERE k = 1)
    SELECT p.seed, p.id, p.place, c.title, (SELECT string_agg(a.name, '|' ORDER BY k.position, k.artist_id) FROM catalog_artists k JOIN artists a ON a.id = k.artist_id WHERE k.catalog_id = p.id) AS artists, TRUE AS in_lib,
           (SELECT string_agg(CAST(node_id AS VARCHAR), '|' ORDER BY node_id) FROM own WHERE own.id = p.id) AS nodes
    FROM placed p JOIN catalog c ON c.id = p.id WHERE place <= 20"""
)
def L10_similar_in_library(b: Bed) -> DataFrame:
    """Similar tracks among one viewer's own, with what a page shows of the winners."""
    seeds = b.catalog.filter("id % 100 = 0").select(F.col("id").alias("seed"))
    own = b.library.filter("user_id = 7").select("catalog_id")
    found = similarity.similar_tracks(_context(b), seeds, floor=0.05, only=own.select(F.col("catalog_id").alias("id"))).select("seed", "id", "place")
    out = similarity.hydrated(found, b.catalog, b.catalog_artists, b.artists, own, b.genre_map)
    nodes = F.array_join(F.transform("nodes", lambda n: n.cast("string")), "|")
    return out.select("seed", "id", "place", "title", F.array_join("artists", "|").alias("artists"), "in_lib", nodes.alias("nodes"))


# --- linkage and writes -----------------------------------------------------


@query("SELECT id, bpm FROM catalog WHERE bpm IS NOT NULL")
def A16_purged(b: Bed) -> DataFrame:
    """What a run computes replaces what it computed before; rows that it didn't touch go."""
    c = b.catalog.select("id", "bpm")
    old, new = c.withColumn("run", F.lit(1)), c.filter("bpm is not null").withColumn("run", F.lit(2))
    return M.purged(M.upsert(old, new, ["id"]), "run", F.lit(2)).select("id", "bpm")


@query("SELECT user_id, catalog_id, 0 AS mark FROM library WHERE user_id % 2 = 1 UNION ALL SELECT user_id, min(catalog_id), 1 FROM library WHERE user_id % 2 = 0 GROUP BY 1")
def A18_replaced_children(b: Bed) -> DataFrame:
    old = b.library.select("user_id", "catalog_id", F.lit(0).alias("mark"))
    fresh = b.library.filter("user_id % 2 = 0").groupBy("user_id").agg(F.min("catalog_id").alias("catalog_id")).withColumn("mark", F.lit(1))
    return M.replace_children(old, fresh, "user_id")


_KEYED = "SELECT s_suppkey AS id, lower(substr(s_name, 1, 8)) || CAST(CAST(floor(s_suppkey / 4) AS BIGINT) AS VARCHAR) AS key FROM supplier"


@query("WITH k AS (" + _KEYED + "), h AS (SELECT key, min(id) AS holder FROM k WHERE id % 5 = 0 GROUP BY 1 HAVING count(*) = 1) SELECT k.id, h.holder FROM k JOIN h ON h.key = k.key WHERE k.id % 5 IN (1, 2)")
def C20_orphans(b: Bed) -> DataFrame:
    n = F.col("s_suppkey")
    base = F.concat(F.left("s_name", F.lit(8)), F.floor(n / 4).cast("string"))
    rows = b.supplier.select(n.alias("id"), F.when(n % 2 == 0, F.upper(base)).otherwise(base).alias("name"), F.when(n % 5 == 0, n.cast("string")).when(n % 5 > 2, "NOT_FOUND").alias("deezer_id"))
    return A.orphans(rows)


@query("SELECT DISTINCT k.catalog_id, t.artist_id FROM catalog_artists k JOIN (SELECT id AS source_id, id + 1 AS artist_id FROM artists UNION ALL SELECT id, id + 2 FROM artists) t ON t.source_id = k.artist_id WHERE NOT EXISTS (SELECT 1 FROM catalog_artists x WHERE x.catalog_id = k.catalog_id AND x.artist_id = t.artist_id)")
def K03_fan_out(b: Bed) -> DataFrame:
    tokens = b.artists.select(F.col("id").alias("source_id"), F.explode(F.array(F.col("id") + 1, F.col("id") + 2)).alias("artist_id"))
    return M.fan_out(b.catalog_artists, tokens)


_PLAIN = r"trim(regexp_replace(regexp_replace(lower(trim(title)), '\s*[(\[]\s*original(?:\s+mix)?\s*[)\]]\s*$', ''), '\s+(?:featuring|feat|ft)\b\.?\s[^(\[]*$', ''))"
_SAME = "CASE WHEN a.isrc IS NOT NULL AND b.isrc IS NOT NULL THEN a.isrc = b.isrc ELSE a.plain = b.plain END"


@query("WITH p AS (SELECT id, isrc, " + _PLAIN + " AS plain FROM catalog) SELECT a.id, b.id AS other, " + _SAME + " AS same FROM p a JOIN p b ON b.id = a.id + 1500")
def P01_same_tracks(b: Bed) -> DataFrame:
    c = b.catalog.select("id", F.struct("isrc", "title").alias("x"))
    other = c.select((F.col("id") - 1500).alias("id"), F.col("id").alias("other"), F.col("x").alias("y"))
    return c.join(other, "id").select("id", "other", L.same_track("x", "y").alias("same"))


@query("WITH p AS (SELECT id, deezer_id, isrc, " + _PLAIN + " AS plain FROM catalog WHERE deezer_id IS NOT NULL) SELECT a.id, min(b.id) AS holder FROM p a JOIN p b ON b.deezer_id = a.deezer_id AND b.id <> a.id AND " + _SAME + " GROUP BY 1")
def P06_first_holders(b: Bed) -> DataFrame:
    c = b.catalog.select("id", F.col("deezer_id").alias("platform_id"), "isrc", "title")
    return L.first_holder(c, c)


@query(
    "WITH w AS (SELECT deezer_id FROM catalog WHERE deezer_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT album_key) > 1) SELECT c.id, CASE WHEN w.deezer_id IS NULL THEN c.deezer_id END AS deezer_id, CASE WHEN w.deezer_id IS NULL OR c.id % 2 = 0 THEN c.bpm END AS bpm, CASE WHEN w.deezer_id IS NULL THEN c.attempts ELSE 0 END AS attempts, w.deezer_id IS NULL AND c.has_preview AS has_preview FROM catalog c LEFT JOIN w ON w.deezer_id = c.deezer_id"
)
def P07_reset_suspects(b: Bed) -> DataFrame:
    """Rows of platform ids that stand on two recordings lose the id, and only what came with it."""
    c = b.catalog.withColumn("bpm_source", F.when(F.col("id") % 2 == 1, "beatport"))
    clusters = c.filter("deezer_id is not null").select("deezer_id", "id", F.col("album_key").alias("cluster"))
    return R.reset_suspects(c, R.suspect_ids(clusters, "deezer_id")).select("id", "deezer_id", "bpm", "attempts", "has_preview")


@query("SELECT DISTINCT catalog_id, CASE WHEN artist_id % 4 = 1 THEN artist_id - 1 ELSE artist_id END AS artist_id FROM catalog_artists")
def P13_merged_links(b: Bed) -> DataFrame:
    mapping = b.artists.filter("id % 4 = 1").select(F.col("id").alias("loser"), (F.col("id") - 1).alias("canonical"))
    return M.repoint(b.catalog_artists.select("catalog_id", "artist_id"), mapping, "artist_id", ["catalog_id", "artist_id"])


@query("SELECT id AS catalog_id, 1 + id % 3 AS contributor, 'primary' AS role, 0 AS position FROM catalog UNION ALL SELECT id, 100, 'featured', 1 FROM catalog")
def P29_contributors(b: Bed) -> DataFrame:
    who = lambda i, r: F.struct(i.cast("long").alias("id"), F.lit(r).alias("role"))
    own = F.col("id") % 3 + 1
    payload = b.catalog.select(F.col("id").alias("catalog_id"), F.array(who(own, "Main"), who(F.lit(100), "Featured"), who(own, "Featured")).alias("contributors"))
    return A.contributors(payload)


@query("SELECT id, CASE id % 4 WHEN 0 THEN '_IMPORT' WHEN 1 THEN 'W - House' END AS target FROM catalog")
def P32_relocation(b: Bed) -> DataFrame:
    tags = F.element_at(F.array(F.array(F.lit("SoundCloud"), F.lit("House")), F.array(F.lit("TO_sort"), F.lit("House")), F.array(F.lit("House")), F.array(F.lit("TO_sort"))), (F.col("id") % 4 + 1).cast("int"))
    return b.catalog.select("id", library.relocation(tags, F.when(F.col("id") % 4 == 2, "W - House").otherwise("x")).alias("target"))


@query("SELECT CAST(id AS VARCHAR) AS raw, CASE WHEN id % 2 = 0 THEN CASE WHEN id % 3 = 2 THEN 'split' ELSE 'flag' END WHEN id % 5 = 0 AND id % 3 < 2 THEN 'duo' WHEN id % 5 > 0 AND id % 3 = 2 THEN 'split' ELSE 'flag' END AS outcome FROM catalog")
def P33_disambiguation(b: Bed) -> DataFrame:
    n = F.col("id")
    looked = b.catalog.select(n.cast("string").alias("raw"), F.when(n % 2 == 0, "comma").otherwise("ampersand").alias("rule"), (n % 5 == 0).alias("full"), (n % 3).alias("found"), F.lit(2).alias("tokens"))
    return A.disambiguate(looked)


@query("SELECT artist_id, album_id, track, place FROM (SELECT id % 50 AS artist_id, id AS album_id, id * 100 + k AS track, k AS place FROM catalog, range(50) r(k) WHERE id % 3 = 0) x WHERE place < 40 AND NOT (artist_id % 2 = 0 AND track % 10 = 0)")
def P44_release_tracks(b: Bed) -> DataFrame:
    """Albums without a readable date and old ones have no rows; forty tracks an album at most, as the rule says."""
    n = F.col("id")
    released = F.when(n % 3 == 0, "2024-05-20").when(n % 3 == 1, "2023-01-01").otherwise("soon")
    albums = b.catalog.select((n % 50).alias("artist_id"), n.alias("album_id"), released.alias("released"), F.transform(F.sequence(F.lit(0), F.lit(49)), lambda k: n * 100 + k).alias("tracks"))
    each = albums.select("artist_id", F.explode("tracks").alias("track")).filter("artist_id % 2 = 0 and track % 10 = 0").distinct()
    return R.expand_releases(albums, each, F.lit("2024-06-01").cast("date")).select("artist_id", "album_id", "track", "place")


@query("SELECT DISTINCT album_key AS album_id FROM catalog WHERE album_key % 2 = 1")
def P45_new_albums(b: Bed) -> DataFrame:
    payload = F.to_json(F.struct(F.struct(F.col("album_key").alias("id")).alias("album")))
    found = b.catalog.select(F.get_json_object(payload, "$.album.id").try_cast("long").alias("album_id"))
    held = b.catalog.filter("album_key % 2 = 0").select(F.col("album_key").alias("album_id"))
    return M.insert_missing(held, found, ["album_id"], [F.col("album_id")])


@query("SELECT id FROM (SELECT id, row_number() OVER (ORDER BY searched_at, id) AS n FROM catalog WHERE deezer_id IS NOT NULL AND searched_at < DATE '2024-06-01') x WHERE n <= 500")
def P46_searched_before(b: Bed) -> DataFrame:
    return B.before_cut(b.catalog, F.lit("2024-06-01").cast("date"), 500).select("id")


@query("SELECT id, coalesce(bpm, 1.0) AS bpm, coalesce(label, 'L') AS label, CASE WHEN bpm IS NULL THEN 1 ELSE 0 END + CASE WHEN label IS NULL THEN 1 ELSE 0 END AS changed FROM catalog")
def P47_top_up(b: Bed) -> DataFrame:
    records = b.catalog.select("id", F.lit(1.0).alias("bpm"), F.lit("L").alias("label"))
    return M.top_up(b.catalog.select("id", "bpm", "label"), records, "id", ["bpm", "label"])


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 48 HOUR AND user_id % 3 = 0")
def R12_followed_news(b: Bed) -> DataFrame:
    news = b.events.select("event_id", F.col("user_id").alias("artist_id"), F.col("ts").alias("at"))
    followed = news.filter("artist_id % 3 = 0").select("artist_id")
    return R.followed_news(news, followed, F.lit(b.events.agg(F.max("ts")).first()[0])).select("event_id")


@query("SELECT id, coalesce(bpm, CASE WHEN id % 5 >= 2 THEN 99.0 END) AS bpm FROM catalog")
def R13_tempo_verdict(b: Bed) -> DataFrame:
    return b.catalog.select("id", B.verdict(F.col("bpm"), F.lit(99.0), (F.col("id") % 5).cast("double")).alias("bpm"))


@query("SELECT id, CASE WHEN id % 2 = 0 THEN 'u' WHEN id % 3 > 0 THEN 'https://s/' || title END AS url FROM sets")
def R15_source_urls(b: Bed) -> DataFrame:
    url, slug = F.when(F.col("id") % 2 == 0, "u"), F.when(F.col("id") % 3 > 0, F.col("title"))
    return b.sets.select("id", S.source_url(url, slug, "https://s/").alias("url"))


@query("SELECT least(40, count(*)) AS sets, TRUE AS whole FROM (SELECT t.set_id FROM set_tracks t JOIN catalog c ON c.id = t.catalog_id WHERE c.has_preview GROUP BY 1 HAVING count(DISTINCT t.catalog_id) >= 3) x")
def T01_sampled_sets(b: Bed) -> DataFrame:
    """However they are drawn, there are as many sets as asked for, each with all its playable tracks."""
    playable = b.catalog.filter("has_preview").select(F.col("id").alias("catalog_id"))
    drawn = E.sampled_sets(b.set_tracks, playable, 3, 40).groupBy("set_id").agg(F.count(F.lit(1)).alias("k"))
    every = b.set_tracks.join(playable, "catalog_id").groupBy("set_id").agg(F.countDistinct("catalog_id").alias("m"))
    return drawn.join(every, "set_id").agg(F.count(F.lit(1)).alias("sets"), F.min((F.col("k") == F.col("m")) & (F.col("k") >= 3)).alias("whole"))


@query("SELECT a.s_suppkey AS id, 'sup' || CAST(a.s_suppkey AS VARCHAR) AS name, 'Sup ' || CAST(a.s_suppkey AS VARCHAR) AS repaired FROM supplier a WHERE a.s_suppkey % 2 = 0")
def P39_slug_names(b: Bed) -> DataFrame:
    n = F.col("s_suppkey")
    rows = b.supplier.select(n.alias("id"), F.when(n % 2 == 0, F.concat(F.lit("sup"), n.cast("string"))).otherwise(F.col("s_name")).alias("name"))
    return A.slug_names(rows, b.supplier.select(F.concat(F.lit("Sup "), n.cast("string")).alias("artist")))


@query("SELECT id, CASE WHEN id % 2 = 0 THEN 'Deep Night' ELSE 'Deep Night Live' END AS name FROM sets")
def P40_names_from_titles(b: Bed) -> DataFrame:
    even = F.col("id") % 2 == 0
    title = F.when(even, F.concat(F.lit("Deep Night - "), "title")).otherwise(F.col("title"))
    return b.sets.select("id", A.name_from_title(title, F.when(even, "deepnight").otherwise("deep-night_live")).alias("name"))


@query("SELECT id, started_at FROM runs WHERE started_at >= (SELECT max(started_at) FROM runs) - INTERVAL 20 DAY", text=("started_at",))
def S01_series(b: Bed) -> DataFrame:
    since = b.runs.agg(F.max("started_at").alias("last")).select(F.expr("last - INTERVAL '20' DAY").alias("cut"))
    return b.runs.crossJoin(F.broadcast(since)).filter("started_at >= cut").select("id", "started_at").orderBy("started_at", "id")
