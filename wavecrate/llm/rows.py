"""Row identity, distributed numbering and selection of whole rows by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavecrate.llm.scratch import materialize, small


def row_key(doc_id: Column, text: Column) -> Column:
    """128-bit key of a row, as 16 bytes; rows that share id and text share it and are interchangeable.

    At 10^11 rows two different ones share a key with a chance of about 10^-17.
    """
    parts = (doc_id.cast("string"), doc_id.isNull(), text, text.isNull())
    return F.unhex(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(half), *parts)), 16, "0") for half in (1, 2)]))


def private(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``docs`` has it, whatever its case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keep_rows(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeated: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` whose row key is in ``keys`` (row_key, materialised), with all their columns.

    ``repeated``: keys (row_key) of rows that stand more than once in ``docs``; of
    each of those one row stays. No keys or no rows give no rows.
    """
    key = private(docs, "__row_key")
    held = docs.withColumn(key, row_key(F.col(id_col), F.col(text_col)))
    chosen = keys.select(F.col("row_key").alias(key))
    out = held.join(F.broadcast(chosen) if small(keys) else chosen, key, "left_semi")
    if repeated is not None and not repeated.isEmpty():
        again = repeated.select(F.col("row_key").alias(key))
        again = F.broadcast(again) if small(repeated) else again
        once = out.join(again, key, "left_semi").dropDuplicates([key])
        out = out.join(again, key, "left_anti").unionByName(once)
    return out.drop(key)


def drop_rows(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose row key is not in ``keys`` (row_key, materialised), with all their columns; repeated rows go or stay together."""
    key = private(docs, "__row_key")
    held = docs.withColumn(key, row_key(F.col(id_col), F.col(text_col)))
    gone = keys.select(F.col("row_key").alias(key)).distinct()
    return held.join(F.broadcast(gone) if small(keys) else gone, key, "left_anti").drop(key)


#: Rows that one window of ``numbered`` sorts.
BUCKET_ROWS = 400


def numbered(df: DataFrame, group: str, tie: list[str], name: str, sizes: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Number the rows of each group gaplessly from 0 without gathering a group in one task.

    ``sizes`` has (group, n) for each group; a group of n rows is dealt to about
    n / ``bucket_rows`` buckets by a hash of ``tie``. Each bucket is numbered by a
    window and shifted by the rows of the buckets before it. Rows equal in ``tie``
    share a bucket. Group values must not be null; there should be far fewer
    groups than rows. ``df`` should be a materialised table, as it is read twice.
    """
    parts = sizes.select(group, F.greatest(F.lit(1), F.ceil(F.col("n") / bucket_rows)).cast("int").alias("__parts"))
    if small(sizes):
        parts = F.broadcast(parts)
    dealt = df.join(parts, group).withColumn("__bucket", F.pmod(F.xxhash64(*tie), F.col("__parts")).cast("int")).drop("__parts")
    keys = [group, "__bucket"]
    before = Window.partitionBy(group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    starts = materialize(counts.select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")), "bucket-starts")
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*tie)) - 1
    out = dealt.withColumn("__within", inside).join(starts, keys)
    return out.withColumn(name, (F.col("__within") + F.col("__start")).cast("long")).drop("__within", "__start", "__bucket")
