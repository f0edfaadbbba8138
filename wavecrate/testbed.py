"""The engine's tables as views over the driver's test tables.

One SQL text a view, in the part of SQL that Spark and DuckDB share, so operators
and their oracles start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Genre graph: nodes (label), edges (child, parent), influences. Raw genres are words of part names and types.
GENRE_NODES = (
    "house music", "techno", "trance", "drum and bass", "hardcore", "deep house", "tech house", "minimal", "acid", "jungle",
    "red", "blue", "hot", "cold", "small", "large", "old", "new", "ring", "widget", "bolt", "gear", "gizmo", "plate", "anvil",
    "economy", "promo",
)
GENRE_PARENTS = (
    ("deep house", "house music"), ("tech house", "house music"), ("tech house", "techno"), ("minimal", "techno"), ("acid", "techno"),
    ("jungle", "drum and bass"), ("red", "deep house"), ("blue", "tech house"), ("hot", "minimal"), ("cold", "acid"), ("small", "jungle"),
    ("large", "hardcore"), ("old", "trance"), ("ring", "red"), ("widget", "blue"), ("bolt", "cold"), ("gear", "small"), ("gizmo", "house music"),
)
GENRE_INFLUENCES = (("techno", "house music"), ("trance", "techno"), ("jungle", "hardcore"))
_ID = {label: i for i, label in enumerate(GENRE_NODES, 1)}
_MAPPED = [*GENRE_NODES[10:], "medium"]


def _values(rows: list[tuple], columns: str) -> str:
    shown = ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else "'" + v + "'" for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {shown}) AS t({columns})"


VIEWS: dict[str, str] = {
    "catalog": """
        SELECT p_partkey AS id,
               p_name || CASE p_partkey % 7 WHEN 0 THEN ' (Original Mix)' WHEN 1 THEN ' (Club Remix)' WHEN 2 THEN ' feat. ' || p_brand ELSE '' END AS title,
               p_brand AS artist,
               CASE WHEN p_size % 9 = 0 THEN NULL ELSE p_brand || ' ' || p_type END AS label,
               CASE WHEN p_size % 10 = 0 THEN NULL ELSE CAST(80 + 2 * p_size AS DOUBLE) END AS bpm,
               CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE CAST(p_partkey % 12 + 1 AS STRING) || CASE WHEN p_size % 2 = 0 THEN 'A' ELSE 'B' END END AS key,
               CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE DATE '1990-01-01' + CAST(p_partkey * 37 % 12000 AS INT) END AS release_date,
               CASE WHEN p_size % 8 = 0 THEN NULL ELSE split(p_name || ' ' || lower(p_type), ' ') END AS genres,
               120000 + p_size * 5000 AS duration_ms,
               CASE WHEN p_size % 7 = 0 THEN 'private' ELSE 'shared' END AS scope,
               CASE WHEN p_size % 7 = 0 THEN p_partkey % 20 END AS owner_id,
               p_size % 4 <> 0 AS has_artwork,
               p_size % 3 <> 0 AS has_preview,
               CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'ISRC' || CAST(p_partkey % 1500 AS STRING) END AS isrc,
               CASE WHEN p_size % 6 = 0 THEN NULL WHEN p_size % 25 = 0 THEN 'NOT_FOUND' ELSE CAST(p_partkey % 700 AS STRING) END AS deezer_id,
               DATE '2024-01-01' + CAST(p_partkey % 365 AS INT) AS created_at,
               CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE DATE '2024-01-01' + CAST(p_partkey * 7 % 300 AS INT) END AS searched_at,
               CAST(CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE p_partkey % 5 END AS INT) AS attempts,
               p_partkey % 97 AS album_key
        FROM {part}""",
    "artists": """
        SELECT s_suppkey AS id, s_name AS name, lower(s_name) AS normalized_name, s_acctbal AS fans,
               CASE WHEN s_suppkey % 4 = 0 THEN NULL WHEN s_suppkey % 4 = 1 THEN 'NOT_FOUND' ELSE CAST(s_suppkey AS STRING) END AS deezer_id,
               s_suppkey % 3 <> 0 AS has_artwork
        FROM {supplier}""",
    "catalog_artists": """
        SELECT catalog_id, artist_id, row_number() OVER (PARTITION BY catalog_id ORDER BY artist_id) AS position
        FROM (SELECT DISTINCT l_partkey AS catalog_id, l_suppkey AS artist_id FROM {lineitem} WHERE l_quantity >= 48) d""",
    "sets": """
        SELECT o_orderkey AS id, o_orderpriority || ' night ' || CAST(o_custkey % 50 AS STRING) || CASE WHEN o_orderkey % 5 = 0 THEN ' part ' || CAST(o_orderkey % 3 + 1 AS STRING) ELSE '' END AS title,
               CAST(o_orderdate AS DATE) AS played_date, o_custkey AS channel_id, o_orderstatus = 'P' AS unreliable,
               CASE WHEN o_orderkey % 50 = 1 THEN o_orderkey - 1 END AS parent_set_id, o_totalprice AS price
        FROM {orders}""",
    "set_tracks": """
        SELECT l_orderkey AS set_id, CASE WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN NULL ELSE l_partkey END AS catalog_id,
               row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS position,
               CAST(l_quantity AS INT) * 10000 AS timecode_ms, l_returnflag = 'R' AND l_linenumber >= 5 AS is_id
        FROM {lineitem}""",
    "playlists": "SELECT c_custkey AS id, c_name AS title, c_mktsegment AS source, c_nationkey AS owner_id, c_acctbal AS followers FROM {customer}",
    "radar_tracks": """
        SELECT o_custkey AS playlist_id, l_partkey AS catalog_id, CAST(l_shipdate AS DATE) AS detected_at, l_returnflag <> 'R' AS active, l_linenumber = 1 AS initial
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "library": """
        SELECT o_custkey AS user_id, l_partkey AS catalog_id, max(CAST(l_shipdate AS DATE)) AS created_at,
               CASE WHEN l_partkey % 11 = 0 THEN CAST(0 AS DOUBLE) WHEN l_partkey % 3 = 0 THEN CAST(100 + l_partkey % 60 AS DOUBLE) END AS rb_bpm
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_linestatus = 'F' GROUP BY o_custkey, l_partkey""",
    "opinions": """
        SELECT o_custkey AS user_id, CAST(l_partkey AS STRING) AS entity_key, CASE WHEN max(l_quantity) >= 46 THEN 'liked' ELSE 'disliked' END AS opinion
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_quantity >= 46 OR l_quantity <= 2 GROUP BY o_custkey, l_partkey""",
    # Below the named genres: a node for each part name, for each brand's parts of a name, and for each part.
    "genre_names": """
        SELECT p_name AS name, CAST(1000 + row_number() OVER (ORDER BY p_name) AS BIGINT) AS id, split(p_name, ' ') AS words
        FROM (SELECT DISTINCT p_name FROM {part}) d""",
    "genre_brands": """
        SELECT p_brand AS brand, p_name AS name, CAST(10000 + row_number() OVER (ORDER BY p_brand, p_name) AS BIGINT) AS id, lead(p_name) OVER (PARTITION BY p_brand ORDER BY p_name) AS next_name
        FROM (SELECT DISTINCT p_brand, p_name FROM {part}) d""",
    "genre_nodes": _values([(i, label) for label, i in _ID.items()], "id, label")
    + """ UNION ALL SELECT id, name FROM {genre_names}
        UNION ALL SELECT id, brand || ' ' || name FROM {genre_brands}
        UNION ALL SELECT 1000000 + p_partkey, 'no ' || CAST(p_partkey AS STRING) FROM {part}""",
    "genre_edges": _values([(_ID[a], _ID[b], "parent") for a, b in GENRE_PARENTS] + [(_ID[a], _ID[b], "influence") for a, b in GENRE_INFLUENCES], "child_id, parent_id, type")
    + f""" UNION ALL SELECT n.id, w.id, 'parent' FROM {{genre_names}} n JOIN ({_values([(i, label) for label, i in _ID.items()], "id, label")}) w ON array_contains(n.words, w.label)
        UNION ALL SELECT b.id, n.id, 'parent' FROM {{genre_brands}} b JOIN {{genre_names}} n ON n.name = b.name
        UNION ALL SELECT 1000000 + p.p_partkey, b.id, 'parent' FROM {{part}} p JOIN {{genre_brands}} b ON b.brand = p.p_brand AND b.name = p.p_name
        UNION ALL SELECT b.id, c.id, 'influence' FROM {{genre_brands}} b JOIN {{genre_brands}} c ON c.brand = b.brand AND c.name = b.next_name""",
    "genre_map": _values([(raw, _ID.get(raw)) for raw in _MAPPED], "raw_name, node_id"),
    "runs": """
        SELECT event_id AS id, event_type AS task_type, CASE user_id % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' END AS source,
               CASE WHEN event_id % 9 = 0 THEN 'error' ELSE 'success' END AS status, ts AS started_at,
               CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(floor(value * 10) AS BIGINT) END AS duration_ms, props AS stats
        FROM {events}""",
}
BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Bed:
    """The views and tables of one data folder as DataFrames, by attribute."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name not in VIEWS:
            raise AttributeError(name)
        used = {t: getattr(self, t) for t in re.findall(r"\{(\w+)\}", VIEWS[name])}
        return self.spark.sql(VIEWS[name], **used)


def oracle(sql: str) -> str:
    """``sql`` for DuckDB, with the views that it names in front."""
    named = {v for v in VIEWS if re.search(rf"\b{v}\b", sql)}
    while more := {t for v in named for t in re.findall(r"\{(\w+)\}", VIEWS[v]) if t in VIEWS} - named:
        named |= more
    ctes = [f"{v} AS ({text.format(**{t: t for t in (*BASE, *VIEWS)})})" for v, text in VIEWS.items() if v in named]
    sql = sql.strip()
    if not ctes:
        return sql
    if re.match(r"(?i)with\s+recursive\b", sql):
        return "WITH RECURSIVE " + ", ".join(ctes) + ", " + re.sub(r"(?i)^with\s+recursive\b", "", sql)
    if re.match(r"(?i)with\b", sql):
        return "WITH " + ", ".join(ctes) + ", " + re.sub(r"(?i)^with\b", "", sql)
    return "WITH " + ", ".join(ctes) + " " + sql
