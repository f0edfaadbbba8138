"""Exact dedup by skew-safe combining.

Rows are combined three times: inside every input partition (the map side of the
first aggregation), then per digest and salt, then the salts' winners per digest.
A group that holds a third of all rows therefore reaches the last step as at most
``SALTS`` rows, and its members learn their winner salt by salt.

Digests alone settle nothing. The full contents of all digests that stand more
than once are combined along the same three steps, and a digest that turns out to
cover several contents is parted by content before the winners are chosen.
Digests that stand once have nothing to be compared with, so their texts are not
moved.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavecrate.llm.rows import keep_rows, row_key
from wavecrate.llm.scratch import materialize, small

#: Parts that the rows of a digest are dealt to.
SALTS = 256
#: Deleted before comparing: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\f\r"


def normalised(text: Column) -> Column:
    """The compared content; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def _salt(key: str, salts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(salts)).cast("int").alias("salt")


def _parted(docs: DataFrame, digests: DataFrame, salts: int, id_col: str, text_col: str) -> DataFrame | None:
    """(row_key, part) of the rows whose digest covers several contents; None if there is no such digest."""
    repeated = materialize(digests.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest"), "repeated-digests")
    if repeated.isEmpty():
        return None
    wanted = digests.join(F.broadcast(repeated) if small(repeated) else repeated, "digest", "left_semi").select("row_key", "digest").distinct()
    wanted = materialize(wanted, "compared-rows")
    rows = docs.select(row_key(F.col(id_col), F.col(text_col)).alias("row_key"), normalised(F.col(text_col)).alias("content"))
    rows = rows.join(F.broadcast(wanted) if small(wanted) else wanted, "row_key")
    salted = rows.select("digest", _salt("row_key", salts), "content").groupBy("digest", "salt", "content").count()
    whole = salted.groupBy("digest", "content").count()
    several = materialize(whole.groupBy("digest").count().filter("count > 1").select("digest"), "parted-digests")
    if several.isEmpty():
        return None
    rows = rows.join(several, "digest", "left_semi")
    least = rows.groupBy("digest", "content").agg(F.min("row_key").alias("part"))
    return materialize(rows.join(least, ["digest", "content"]).select("row_key", "part").distinct(), "parts")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """One row per row of ``docs``: id, row_key, keep_id, group_size, kept, text_sha256.

    Equal: identical after deleting blanks. The row with the most code points of
    original text stays, then the smallest id; null ids come last. Of repeated
    rows (same id, same content and length) exactly one is ``kept``. Null and
    empty texts form one group. An empty table gives an empty result. Only the
    two named columns are read, so other columns never clash. ``digest`` replaces
    the SHA-256 of the combining steps (tests pass a weak one).
    """
    ident, text = F.col(id_col).cast("long"), F.col(text_col)
    rows = docs.select(ident.alias("id"), row_key(F.col(id_col), text).alias("row_key"), normalised(text).alias("content"), F.coalesce(F.length(text), F.lit(0)).alias("points"))
    sha = F.coalesce(F.unhex(F.sha2("content", 256)), F.lit(b""))
    own = F.coalesce(digest(F.col("content")).cast("string").cast("binary"), F.lit(b"")) if digest else F.col("sha")
    # Written once, so that numbers of rows stay as they are.
    digests = rows.withColumn("sha", sha).select("id", "row_key", "points", "sha", own.alias("digest"), F.monotonically_increasing_id().alias("row"))
    digests = materialize(digests, "digests")
    parts = _parted(docs, digests, salts, id_col, text_col)
    if parts is None:
        digests = digests.withColumn("part", F.lit(b""))
    else:
        digests = digests.join(parts, "row_key", "left").withColumn("part", F.coalesce("part", F.lit(b"")))
    keys = ["digest", "part"]
    members = digests.withColumn("salt", _salt("row", salts))
    # The greatest of these stays: nulls are the least, and ~id falls as the id rises.
    order = F.struct("points", F.bitwise_not("id").alias("low"), "row_key", "row")
    salted = materialize(members.groupBy(*keys, "salt").agg(F.max(order).alias("best"), F.count(F.lit(1)).alias("n")), "salt-winners")
    whole = salted.groupBy(*keys).agg(F.max("best").alias("best"), F.sum("n").alias("group_size"))
    whole = whole.select(*keys, F.bitwise_not("best.low").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size")
    winners = salted.select(*keys, "salt").join(whole, keys)
    joined = members.join(winners, [*keys, "salt"])
    return joined.select(
        F.col("id").alias("doc_id"),
        "row_key",
        "keep_id",
        F.col("group_size").cast("long"),
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def unique_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; nulls, ties and repeated rows as in ``exact_dedup``."""
    told = exact_dedup(docs, id_col, text_col).groupBy("row_key").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    told = materialize(told.filter("kept"), "kept-rows")
    return keep_rows(docs, told.select("row_key"), id_col, text_col, repeated=told.filter("n > 1").select("row_key"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS kept,
       text_sha256
FROM t
"""
