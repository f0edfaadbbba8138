"""Backlogs, cadences, monitoring, embeddings and the batch twins of streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecrate.functions import music, time
from wavecrate.operators import backlog as B
from wavecrate.operators import embeddings as E
from wavecrate.operators import monitoring as S
from wavecrate.plans.pairs import all_pairs, numbered, of, valued
from wavecrate.queries.registry import query
from wavecrate.sources.html import page_fields
from wavecrate.streaming import activity, throughput
from wavecrate.testbed import Bed

AS_OF = "2024-12-01"


def _as_of() -> F.Column:
    return F.lit(AS_OF).cast("date")


@query(
    f"""SELECT id, tier, row_number() OVER (ORDER BY tier, CASE WHEN tier = 1 THEN id END DESC, searched_at, id) AS place FROM (
    SELECT *, CASE WHEN searched_at IS NULL THEN 1 ELSE 2 END AS tier FROM catalog WHERE deezer_id IS NULL AND (searched_at IS NULL OR (attempts = 1 AND DATE '{AS_OF}' - searched_at > 30) OR (attempts = 2 AND DATE '{AS_OF}' - searched_at > 90))) x
    ORDER BY place LIMIT 150"""
)
def R01_enrich_candidates(b: Bed) -> DataFrame:
    return B.candidates(b.catalog, F.col("deezer_id").isNull(), _as_of(), 150).select("id", "tier", "place")


@query(
    f"""SELECT count(*) FILTER (WHERE m AND searched_at IS NULL) AS never, count(*) FILTER (WHERE m AND searched_at IS NOT NULL AND attempts < 3 AND d) AS due,
    count(*) FILTER (WHERE m AND searched_at IS NOT NULL AND attempts < 3 AND NOT d) AS cooldown, count(*) FILTER (WHERE m AND searched_at IS NOT NULL AND attempts >= 3) AS abandoned,
    count(*) FILTER (WHERE m) AS total_missing, count(*) FILTER (WHERE NOT m) AS total_linked
    FROM (SELECT *, deezer_id IS NULL AS m, (attempts = 1 AND DATE '{AS_OF}' - searched_at > 30) OR (attempts = 2 AND DATE '{AS_OF}' - searched_at > 90) AS d FROM catalog) x"""
)
def R02_backlog_partition(b: Bed) -> DataFrame:
    return B.partition(b.catalog, F.col("deezer_id").isNull(), _as_of())


_DAYS = "epoch_us(({a}) - ({b})) / 86400000000.0"


@query(
    f"""SELECT id, CASE WHEN crawled IS NULL OR (NOT followed AND changed IS NULL) OR {_DAYS.format(a="now_", b="crawled")} > CASE WHEN followed THEN 1 WHEN {_DAYS.format(a="now_", b="changed")} > 60 THEN 30 WHEN {_DAYS.format(a="now_", b="changed")} > 14 THEN 7 ELSE 1 END - 0.25 THEN 'crawl' ELSE 'wait' END AS decision
    FROM (SELECT event_id AS id, user_id % 7 = 0 AS followed, CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts - INTERVAL 20 DAY END AS changed, CASE WHEN event_id % 13 = 0 THEN NULL ELSE ts END AS crawled, (SELECT max(ts) FROM events) AS now_ FROM events) x"""
)
def R04_crawl_cadence(b: Bed) -> DataFrame:
    now = F.lit(b.events.agg(F.max("ts")).first()[0]).cast("timestamp_ntz")
    e = b.events.select(
        F.col("event_id").alias("id"),
        (F.col("user_id") % 7 == 0).alias("followed"),
        F.when(F.col("event_id") % 11 != 0, F.expr("ts - INTERVAL '20' DAY")).alias("changed"),
        F.when(F.col("event_id") % 13 != 0, F.col("ts")).alias("crawled"),
    )
    none = F.lit(None).cast("timestamp_ntz")
    return e.select("id", time.crawl_decision(now, F.col("followed"), F.col("changed"), none, F.col("crawled")).alias("decision"))


@query(
    f"""SELECT id, CASE WHEN age > 90 THEN 'final' WHEN ref IS NULL OR {_DAYS.format(a="now_", b="ref")} > CASE WHEN age > 30 THEN 30 WHEN age > 7 THEN 7 ELSE 1 END - 0.25 THEN 'crawl' ELSE 'wait' END AS decision
    FROM (SELECT event_id AS id, {_DAYS.format(a="(SELECT max(ts) FROM events)", b="ts - INTERVAL 70 DAY * (event_id % 2)")} AS age, CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts END AS ref, (SELECT max(ts) FROM events) AS now_ FROM events) x"""
)
def R06_recrawl_decision(b: Bed) -> DataFrame:
    now = F.lit(b.events.agg(F.max("ts")).first()[0]).cast("timestamp_ntz")
    created = F.when(F.col("event_id") % 2 == 1, F.expr("ts - INTERVAL '70' DAY")).otherwise(F.col("ts"))
    return b.events.select(F.col("event_id").alias("id"), time.recrawl_decision(now, created, F.when(F.col("event_id") % 5 != 0, F.col("ts"))).alias("decision"))


@query(
    "SELECT set_id, round((count(*) - count(*) FILTER (WHERE is_id)) / count(*), 6) AS completion, count(*) FILTER (WHERE is_id) / count(*) >= 0.8 AS unreliable FROM set_tracks GROUP BY 1"
)
def R08_reliability(b: Bed) -> DataFrame:
    n = b.set_tracks.groupBy("set_id").agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("is_id"), True)).alias("open"))
    lost = time.set_unreliable(F.col("total"), F.col("open"), F.lit("x"), F.lit(False))
    return n.select("set_id", F.round(time.completion(F.col("total"), F.col("open")), 6).alias("completion"), lost.alias("unreliable"))


@query("SELECT catalog_id FROM catalog_artists GROUP BY 1 HAVING count(*) = 1")
def R10_single_artist(b: Bed) -> DataFrame:
    return b.catalog_artists.groupBy("catalog_id").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("catalog_id")


_THROUGHPUT = """SELECT CAST(started_at AS DATE) AS day, task_type, source, count(*) AS runs, count(*) FILTER (WHERE status = 'error') AS errors, CAST(sum(k) AS BIGINT) AS enriched, CAST(sum(k % 7) AS BIGINT) AS not_found,
    CAST(round_even(avg(duration_ms), 0) AS BIGINT) AS duration_avg, max(duration_ms) AS duration_max, round_even(sum(k) / nullif(sum(k) + sum(k % 7), 0), 4) AS hit_rate
    FROM (SELECT *, CAST(json_extract(stats, '$.k') AS BIGINT) AS k FROM runs) r GROUP BY 1, 2, 3"""


@query(_THROUGHPUT, text=("day",))
def S02_throughput(b: Bed) -> DataFrame:
    k = S.counter("stats", "k")
    out = S.throughput(b.runs, k, k % 7, F.lit(0))
    return out.select("day", "task_type", "source", "runs", "errors", "enriched", "not_found", "duration_avg", "duration_max", "hit_rate")


@query("SELECT task_type, id, status, CASE task_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS place FROM (SELECT *, row_number() OVER (PARTITION BY task_type ORDER BY started_at DESC, id DESC) AS n FROM runs) x WHERE n = 1")
def S03_status(b: Bed) -> DataFrame:
    return S.status(b.runs, ("purchase", "click"))


@query(
    "SELECT * FROM (SELECT count(*) AS tracks, count(*) FILTER (WHERE bpm IS NULL) AS no_bpm, count(*) FILTER (WHERE genres IS NULL) AS no_genre, count(*) FILTER (WHERE NOT has_artwork) AS no_artwork, count(*) FILTER (WHERE deezer_id IS NULL) AS unlinked_tracks, count(*) FILTER (WHERE deezer_id = 'NOT_FOUND') AS absent_tracks FROM catalog) a, (SELECT count(*) AS artists, count(*) FILTER (WHERE deezer_id IS NULL) AS unlinked_artists, count(*) FILTER (WHERE deezer_id IS NOT NULL AND deezer_id <> 'NOT_FOUND') AS linked_artists FROM artists) b"
)
def S06_snapshot(b: Bed) -> DataFrame:
    return S.snapshot(b.catalog, b.artists)


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2", text=("hour",))
def Q01_hourly_counts(b: Bed) -> DataFrame:
    return throughput.hourly(b.events.withColumn("ts", F.col("ts").cast("timestamp"))).select(F.col("hour").cast("timestamp_ntz").alias("hour"), "event_type", "n")


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2", text=("day",))
def Q02_daily_rollup(b: Bed) -> DataFrame:
    return throughput.daily(b.events.withColumn("ts", F.col("ts").cast("timestamp")))


@query(
    "WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2), m AS (SELECT max(day) AS last FROM d) SELECT user_id, CAST(coalesce(sum(n) FILTER (WHERE last - day < 7), 0) AS BIGINT) AS recent, CAST(coalesce(sum(n) FILTER (WHERE last - day BETWEEN 7 AND 13), 0) AS BIGINT) AS before, round(least(greatest(coalesce(sum(n) FILTER (WHERE last - day < 7), 0) / greatest(coalesce(sum(n) FILTER (WHERE last - day BETWEEN 7 AND 13), 0), 1) - 1, 0), 5), 6) AS velocity FROM d, m GROUP BY 1"
)
def Q04_velocity(b: Bed) -> DataFrame:
    return activity.velocity(b.events)


@query("SELECT user_id, event_type, min(ts) AS first_ts FROM events GROUP BY 1, 2", text=("first_ts",))
def Q05_first_activity(b: Bed) -> DataFrame:
    return activity.deduplicated(b.events, ["user_id", "event_type"]).select("user_id", "event_type", F.col("ts").alias("first_ts"))


@query(
    "SELECT user_id, islands, longest FROM (SELECT user_id, count(*) AS islands, max(n) AS longest FROM (SELECT user_id, g, count(*) AS n FROM (SELECT user_id, event_id, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY ts, event_id) AS g FROM events) x WHERE bad GROUP BY 1, 2) y GROUP BY 1) z"
)
def Q07_failure_streaks(b: Bed) -> DataFrame:
    return activity.streaks(b.events, F.col("event_type") == "error")


@query(
    "WITH s AS (SELECT vec_id AS seed, embedding AS sv FROM embeddings WHERE vec_id % 100 = 0) SELECT seed, id, score, rank FROM (SELECT seed, id, score, row_number() OVER (PARTITION BY seed ORDER BY score DESC, id) AS rank FROM (SELECT s.seed, e.vec_id AS id, round(list_sum(list_transform(list_zip(CAST(sv AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), lambda z: z[1] * z[2])), 6) AS score FROM embeddings e JOIN s ON s.seed <> e.vec_id) x) y WHERE rank <= 10"
)
def T04_cosine_topk(b: Bed) -> DataFrame:
    v = b.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return E.top_neighbours(v, v.filter("id % 100 = 0"), 10)


@query(
    "WITH s AS (SELECT vec_id AS seed, label, embedding AS sv FROM embeddings WHERE vec_id % 100 = 0), r AS (SELECT seed, id, row_number() OVER (PARTITION BY seed ORDER BY score DESC, id) AS rank, hit FROM (SELECT s.seed, e.vec_id AS id, e.label = s.label AS hit, round(list_sum(list_transform(list_zip(CAST(sv AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), lambda z: z[1] * z[2])), 6) AS score FROM embeddings e JOIN s ON s.seed <> e.vec_id) x), p AS (SELECT s.seed, count(*) AS n_pos FROM s JOIN embeddings e ON e.label = s.label AND e.vec_id <> s.seed GROUP BY 1), ks(k) AS (VALUES (1), (5), (10), (20)), h AS (SELECT p.seed, p.n_pos, ks.k, count(*) FILTER (WHERE r.hit AND r.rank <= ks.k) AS hits FROM p JOIN r ON r.seed = p.seed, ks GROUP BY 1, 2, 3) SELECT k, count(*) AS seeds, round(avg(hits / k / (n_pos / ((SELECT count(*) FROM embeddings) - 1))), 6) AS lift, round(avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM h GROUP BY 1"
)
def T06_lift_at_k(b: Bed) -> DataFrame:
    v = b.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    seeds = v.filter("id % 100 = 0")
    near = E.top_neighbours(v, seeds, 20)
    positives = seeds.select(F.col("id").alias("seed"), "label").join(v.select("id", "label"), "label").filter("id <> seed").select("seed", "id")
    return E.lift(near, positives, v.count())


@query("SELECT CAST(floor(bpm / 10) * 10 AS BIGINT) AS low, count(*) AS n FROM catalog WHERE bpm IS NOT NULL GROUP BY 1")
def T14_bpm_histogram(b: Bed) -> DataFrame:
    return E.histogram(b.catalog, "bpm")


@query("SELECT id, CASE WHEN bpm IS NULL THEN NULL WHEN bpm >= 90 AND bpm < 180 THEN bpm WHEN bpm < 90 THEN bpm * 2 ELSE bpm / 2 END AS folded FROM catalog")
def T14_bpm_fold(b: Bed) -> DataFrame:
    return b.catalog.select("id", music.fold_bpm(F.col("bpm")).alias("folded"))


@query(
    "WITH k AS (SELECT id, CAST(regexp_replace(key, '[AB]', '') AS INT) AS n, right(key, 1) AS m FROM catalog WHERE key IS NOT NULL), q AS (SELECT a.id, b.id AS other, least(abs(a.n - b.n), 12 - abs(a.n - b.n)) AS d, a.m = b.m AS s FROM k a JOIN k b ON a.id <> b.id WHERE a.id % 100 = 0) SELECT id, other, CAST(CASE WHEN s AND d = 0 THEN 1.0 WHEN d = 0 THEN 0.9 WHEN s AND d = 1 THEN 0.8 WHEN s AND d = 2 THEN 0.5 WHEN d = 1 THEN 0.4 ELSE 0.0 END AS DOUBLE) AS sim FROM q"
)
def H16_key_similarity(b: Bed) -> DataFrame:
    k = b.catalog.filter("key is not null").select("id", "key")
    wanted, a = numbered(k.filter("id % 100 = 0").select(F.col("id").alias("seed"), F.col("key").alias("asked")), "asked", "at")
    rows = valued(k, "key", wanted, "asked", "at", music.sim_key, "sims").select(F.col("id").alias("other"), "sims")
    return all_pairs(rows, a.select("seed", "at"), "other").select(F.col("seed").alias("id"), "other", of("sims", "at").alias("sim"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a href=\"/([^\"]*)\">', 1)) AS links FROM pages")
def A08_page_fields(b: Bed) -> DataFrame:
    return page_fields(b.pages)
