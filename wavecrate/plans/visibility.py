"""Which rows a viewer sees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def visible(catalog: DataFrame, library: DataFrame, user_id: int | None) -> DataFrame:
    """Guests see shared rows; a viewer also sees own rows and those in the viewer's library.

    The library side is reduced to one viewer's ids before the join, so it
    broadcasts; ``in_lib`` says whether a row is among them.
    """
    if user_id is None:
        return catalog.filter("scope = 'shared'").withColumn("in_lib", F.lit(False))
    own = library.filter(F.col("user_id") == user_id).select(F.col("catalog_id").alias("id")).distinct().withColumn("held", F.lit(True))
    seen = catalog.join(own, "id", "left").withColumn("in_lib", F.coalesce("held", F.lit(False))).drop("held")
    return seen.filter((F.col("scope") == "shared") | (F.col("owner_id") == user_id) | F.col("in_lib"))


def reliable(flag: str = "unreliable") -> Column:
    """Not known to be unreliable; null counts as reliable."""
    return ~F.coalesce(F.col(flag), F.lit(False))


def root_sets(sets: DataFrame) -> DataFrame:
    """Reliable sets that are not part of another."""
    return sets.filter(F.col("parent_set_id").isNull() & reliable())


def preferred_bpm(library_bpm: str = "rb_bpm", bpm: str = "bpm", zero_is_value: bool = True) -> Column:
    """The viewer's own tempo where there is one; details treat 0 as none, lists as a value."""
    own = F.col(library_bpm) if zero_is_value else F.nullif(F.col(library_bpm), F.lit(0.0))
    return F.coalesce(own, F.col(bpm))
