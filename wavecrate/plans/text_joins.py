"""Joins on containment and on token overlap, without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavecrate.scratch import materialize, small

GRAM = 3


def _grams(text: Column) -> Column:
    """The distinct grams of a text; none of one that is shorter."""
    return F.when(F.length(text) >= GRAM, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - (GRAM - 1)), lambda i: F.substr(text, i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


def rarest_grams(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(name, gram, n): of each name (``names``: name) the gram that the fewest texts (``texts``: gram, one row each) have; names with a gram that none has are left out."""
    counted = texts.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    each = names.select("name", F.explode(_grams(F.col("name"))).alias("gram")).join(counted, "gram", "left")
    # No text holds a name with a gram that no text has.
    best = each.groupBy("name").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("x"))
    return best.filter("x.n > 0").select("name", "x.gram", "x.n")


def containment_join(texts: DataFrame, names: DataFrame, text: str, name: str, told: dict[str, float] | None = None) -> DataFrame:
    """Pairs where the text holds the name, both lower-cased, underscores of the text as spaces; names under three characters match nothing.

    A name meets the texts that have its rarest three characters, by counted
    frequencies, and is compared there; so a beginning that many names share is no
    key. ``told`` gets the candidates and the share of them that the largest key makes.
    """
    low = F.lower(F.translate(text, "_", " "))
    left = texts.filter(F.length(text) >= GRAM).select("*", low.alias("__low")).withColumn("gram", F.explode(_grams(F.col("__low"))))
    right = names.withColumn("__name", F.lower(name)).filter(F.length("__name") >= GRAM)
    keys = materialize(rarest_grams(left.select("gram"), right.select(F.col("__name").alias("name")).distinct()), "rarest-grams")
    if told is not None:
        of = keys.join(right.select(F.col("__name").alias("name")), "name").groupBy("gram").agg(F.sum("n").alias("n"))
        sums = of.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("candidates"), F.coalesce(F.max("n") / F.sum("n"), F.lit(0.0)).alias("largest_share")).first()
        told |= sums.asDict()
    right = materialize(right.join(keys.select(F.col("name").alias("__name"), "gram"), "__name"), "named-grams")
    # The optimizer takes texts with a row for each gram for as small as the table they came from; they are never sent to all.
    side = F.broadcast(right) if small(right) else right.hint("merge")
    return left.join(side, "gram").filter(F.contains("__low", "__name")).drop("gram", "__low", "__name")


def token_join(df: DataFrame, ident: str, tokens: str, threshold: float) -> DataFrame:
    """(a, b, jaccard), a < b: rows whose token sets (arrays) overlap in ``threshold`` or more.

    Prefix filtering: with tokens from rare to common, such sets share one of
    their first n - ceil(threshold * n) + 1, so only those are joined. Rows with
    the same tokens should be grouped before.
    """
    rows = df.select(F.col(ident).alias("id"), F.array_distinct(tokens).alias("t")).filter("size(t) > 0")
    each = rows.select("id", F.explode("t").alias("tok"))
    freq = each.groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    ordered = each.join(freq, "tok").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "tok"))), lambda x: x["tok"]).alias("t"))
    n = F.size("t")
    heads = ordered.select("id", F.explode(F.slice("t", F.lit(1), n - F.ceil(n * threshold).cast("int") + 1)).alias("tok"))
    pairs = heads.withColumnRenamed("id", "a").join(heads.withColumnRenamed("id", "b"), "tok").filter("a < b").select("a", "b").distinct()
    both = pairs.join(rows.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a").join(rows.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b")
    shared = F.size(F.array_intersect("ta", "tb"))
    return both.select("a", "b", (shared / (F.size("ta") + F.size("tb") - shared)).alias("jaccard")).filter(F.col("jaccard") >= threshold)
