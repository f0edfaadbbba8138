"""Secret scans with multipart credential linking, with DataFrame functions only.

A credential has parts: an identifier, a secret and perhaps an endpoint. Strong
shapes (assignments, access ids, long hex) are reported alone. Weak shapes (user
names, mixed-case blobs, addresses of services) are reported only if a
complementary part lies within the scope: an interval join over buckets of the
scope's length, each side summed up to its least and greatest start per bucket,
so a text full of candidates makes no pairs.

Spans come from splitting a text at a pattern: the lengths of the pieces and of
the matches between them, added up, are the code points where matches stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavecrate.llm.rows import row_key
from wavecrate.llm.scratch import materialize

#: Code points between the starts of parts that belong together.
SCOPE = 200
BASE = ("assign", "access", "hex")
WEAK = ("ident", "blob", "endpoint")
KINDS = (*BASE, *WEAK)
#: Where a base pattern takes less than its rule, failing matches are dropped by ``GROUP``.
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{12,}",
    "hex": r"[0-9a-f]{32,}",
    "ident": r"""\b(?i:user(?:_?name|_?id)?|login|client_?id|account_?id|key_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}""",
    "blob": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])[A-Za-z0-9+/_-]{20,}+={0,2}",
    "endpoint": r"""\b(?i:https?|wss?|s3|ftp|sftp|ssh|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?)://[^\s"'<>]+""",
}
#: The shortest value of an assignment.
VALUE = 8
#: Kinds by the part that they are.
PARTS = {"identifier": ("access", "ident"), "secret": ("assign", "hex", "blob"), "endpoint": ("endpoint",)}
#: The parts that a weak candidate needs one of.
NEEDS = {"ident": ("secret",), "blob": ("identifier", "endpoint"), "endpoint": ("secret",)}


def _matches(text: Column, kind: str) -> Column:
    """Array of (kind, nth, gap, size, ok): gap is the length of the text since the match before."""
    p = F.lit(PATTERNS[kind])
    whole = F.regexp_extract_all(text, p, F.lit(0))
    sizes = F.transform(whole, lambda m: F.length(m))
    ok = F.transform(F.regexp_extract_all(text, p, F.lit(1)), lambda v: F.length(v) >= VALUE) if kind == "assign" else F.transform(whole, lambda m: F.lit(True))
    gaps = F.transform(F.split(text, PATTERNS[kind], -1), lambda x: F.length(x))
    zipped = F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), ok.alias("ok"))
    found = F.transform(F.filter(zipped, lambda z: z["size"].isNotNull()), lambda z, i: F.struct(F.lit(kind).alias("kind"), i.alias("nth"), z["gap"].alias("gap"), z["size"].alias("size"), z["ok"].alias("ok")))
    none = F.array().cast("array<struct<kind:string,nth:int,gap:int,size:int,ok:boolean>>")
    return F.when(text.rlike(PATTERNS[kind]), found).otherwise(none)


def _rank(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind)


def _linked(spans: DataFrame, scope: int) -> DataFrame:
    """The weak spans of ``spans`` (row_key, kind, start, end) that have a complementary part within the scope."""
    part = F.coalesce(*[F.when(F.col("kind").isin(*kinds), p) for p, kinds in PARTS.items()])
    bucket = F.floor(F.col("start") / scope)
    held = spans.withColumn("bucket", bucket)
    ends = held.groupBy("row_key", "bucket", part.alias("part")).agg(F.min("start").alias("least"), F.max("start").alias("greatest"))
    weak = held.filter(F.col("kind").isin(*WEAK)).select("row_key", "kind", "start", "end", F.col("bucket").alias("own"), F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    near = weak.join(ends, ["row_key", "bucket"])
    close = F.when(F.col("bucket") < F.col("own"), F.col("start") - F.col("greatest") <= scope).when(F.col("bucket") > F.col("own"), F.col("least") - F.col("start") <= scope).otherwise(True)
    fits = F.coalesce(*[F.when(F.col("kind") == k, F.col("part").isin(*parts)) for k, parts in NEEDS.items()])
    return near.filter(close & fits).select("row_key", "kind", "start", "end").distinct()


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per row of ``docs``: doc_id, row_key, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    spans: kind:start:end (code points, end exclusive) by start, then kind, comma-
    joined; base_sha256 covers the base kinds alone; n_linked counts the weak
    candidates reported. Weak candidates that overlap a base span are left out.
    Null and empty texts have no span. Repeated rows give repeated results; texts
    are read whole, in one pass over the table. An empty table gives an empty
    result. Only the named columns are read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(F.col(id_col), F.col(text_col)).alias("row_key"), F.col(text_col).alias("text"))
    scan = materialize(rows.select("doc_id", "row_key", F.concat(*[_matches(text, k) for k in KINDS]).alias("found")), "secret-candidates")
    each = scan.filter("size(found) > 0").dropDuplicates(["row_key"]).select("row_key", F.inline("found"))
    # Windows over one text's candidates.
    upto = Window.partitionBy("row_key", "kind").orderBy("nth")
    end = F.sum(F.col("gap").cast("long") + F.col("size")).over(upto)
    spans = each.withColumn("end", end).withColumn("start", F.col("end") - F.col("size")).filter("ok")
    base = F.col("kind").isin(*BASE)
    before = Window.partitionBy("row_key").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy("row_key").orderBy("start").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    spans = spans.withColumn("held", F.coalesce(F.max(F.when(base, F.col("end"))).over(before), F.lit(0)) > F.col("start"))
    spans = spans.withColumn("holds", F.coalesce(F.min(F.when(base, F.col("start"))).over(after) < F.col("end"), F.lit(False)))
    spans = materialize(spans.filter(base | ~(F.col("held") | F.col("holds"))).select("row_key", "kind", "start", "end"), "secret-spans")
    told = spans.filter(base).unionByName(_linked(spans, scope))
    entry = F.struct("start", _rank(F.col("kind")).alias("rank"), F.concat_ws(":", "kind", "start", "end").alias("s"))
    lists = told.groupBy("row_key").agg(
        *[F.count(F.when(F.col("kind") == k, True)).alias(f"n_{k}") for k in BASE],
        F.count(F.when(~base, True)).alias("n_linked"),
        F.array_sort(F.collect_list(F.when(base, entry))).alias("base"),
        F.array_sort(F.collect_list(entry)).alias("all"),
    )
    text_of = lambda c: F.coalesce(F.array_join(F.transform(c, lambda e: e["s"]), ","), F.lit(""))
    joined = scan.select("doc_id", "row_key").join(lists, "row_key", "left")
    return joined.select(
        "doc_id",
        "row_key",
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(text_of(F.col("base")), 256).alias("base_sha256"),
        text_of(F.col("all")).alias("spans"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
    )
