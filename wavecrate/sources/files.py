"""CSV, XML and JSON files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def taxonomy_nodes(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, header=True, schema="id string, label string")
    return raw.select(F.trim("id").alias("id"), F.trim("label").alias("label")).filter("id <> ''")


def taxonomy_edges(spark: SparkSession, path: str, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges whose ends are known, and those left out."""
    raw = spark.read.csv(path, header=True, schema="from_id string, to_id string, type string, source string")
    raw = raw.select(*[F.trim(c).alias(c) for c in raw.columns])
    known = nodes.select("id").distinct()
    a, b = known.select(F.col("id").alias("from_id"), F.lit(True).alias("a")), known.select(F.col("id").alias("to_id"), F.lit(True).alias("b"))
    both = raw.join(a, "from_id", "left").join(b, "to_id", "left")
    good = F.col("a").isNotNull() & F.col("b").isNotNull()
    return both.filter(good).select(*raw.columns), both.filter(~good).select(*raw.columns)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, mode="overwrite")


def _number(name: str, kind: str) -> Column:
    return F.nullif(F.trim(F.col(name)), F.lit("")).try_cast(kind)


def library_xml(spark: SparkSession, path: str) -> DataFrame:
    """Tracks of a DJ library export; those without a whole-number id or a name are left out, empty values are null."""
    fields = ("TrackID", "Name", "Artist", "AverageBpm", "Tonality", "TotalTime", "DateAdded", "Location")
    schema = ", ".join(f"_{f} string" for f in fields)
    raw = spark.read.format("xml").option("rowTag", "TRACK").schema(schema).load(path)
    text = lambda n: F.nullif(F.trim(F.col(f"_{n}")), F.lit(""))
    out = raw.select(
        _number("_TrackID", "int").alias("track_id"),
        text("Name").alias("title"),
        text("Artist").alias("artist"),
        _number("_AverageBpm", "double").alias("bpm"),
        text("Tonality").alias("key"),
        (_number("_TotalTime", "long") * 1000).alias("duration_ms"),
        F.try_to_timestamp("_DateAdded", F.lit("yyyy-MM-dd")).cast("date").alias("date_added"),
        text("Location").alias("location"),
    )
    return out.filter("track_id is not null and title is not null")


def is_library_xml(spark: SparkSession, path: str) -> bool:
    """Whether the file's root is a library with a version."""
    raw = spark.read.format("xml").option("rowTag", "DJ_PLAYLISTS").schema("_Version string").load(path)
    return not raw.filter("_Version is not null").isEmpty()


def vectors_csv(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(id, v) of well-formed vectors of the right size; everything else is left out."""
    from wavecrate.operators.embeddings import parsed

    raw = spark.read.csv(path, header=True, escape='"', schema="id long, status string, dim int, emb string")
    return raw.filter("status = 'ok'").select("id", parsed(F.col("emb"), size).alias("v")).filter("v is not null")


def payload_rows(df: DataFrame) -> DataFrame:
    """Tracks of two payload shapes as one: ``payload`` is JSON text, ``shape`` is ``page`` or ``api``."""
    from wavecrate.functions.music import key_to_camelot

    j = lambda path: F.get_json_object("payload", path)
    page = F.col("shape") == "page"
    pick = lambda a, b: F.when(page, j(a)).otherwise(j(b))
    return df.select(
        pick("$.track_id", "$.id").alias("id"),
        pick("$.track_name", "$.name").alias("title"),
        pick("$.bpm", "$.bpm").try_cast("double").alias("bpm"),
        key_to_camelot(pick("$.key_name", "$.key.name")).alias("key"),
        pick("$.label.label_name", "$.release.label.name").alias("label"),
        pick("$.genre[0].genre_name", "$.genre.name").alias("genre"),
        j("$.isrc").alias("isrc"),
        F.left(pick("$.release_date", "$.new_release_date"), F.lit(10)).try_cast("date").alias("release_date"),
    )


def changed(modified: Column, crawled: Column) -> Column:
    """Whether a source is worth reading again; without both dates it is."""
    return F.coalesce(modified > crawled, F.lit(True))
