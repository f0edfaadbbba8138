"""Top k of each group, and of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group with their rank; k is pushed below the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def one_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_k(df, keys, order, 1, "__nth").drop("__nth")


def one_per_album(df: DataFrame, keys: list[str], album: str, ident: str, rank: str, n: int, over: int) -> DataFrame:
    """Of each group's first n * over ranks at most one row per album (none for no album), then the first n of them."""
    head = df.filter(F.col(rank) <= n * over)
    lone = F.coalesce(F.concat(F.lit("a"), F.col(album).cast("string")), F.concat(F.lit("t"), F.col(ident).cast("string")))
    first = one_per(head.withColumn("__album", lone), [*keys, "__album"], [F.col(rank)])
    return top_k(first.drop("__album"), keys, [F.col(rank)], n, "place")
