"""Table writes as pure transitions from one state to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavecrate.plans.topk import one_per


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str] | None = None) -> DataFrame:
    """New rows replace old ones of their key; columns in ``keep`` stay where the old value isn't null."""
    kept = old.join(new.select(*keys), keys, "left_anti")
    if keep:
        before = old.select(*keys, *[F.col(c).alias(f"__{c}") for c in keep])
        new = new.join(before, keys, "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in keep else F.col(c) for c in new.columns])
    return kept.unionByName(new.select(*old.columns))


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The rows of ``new`` to append: one a key, none that ``old`` has."""
    return one_per(new, keys, order).join(old.select(*keys), keys, "left_anti")


def fill_nulls(table: DataFrame, values: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Values go only where the table has none."""
    found = values.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    return table.join(found, key, "left").select(*[F.coalesce(c, f"__{c}").alias(c) if c in columns else F.col(c) for c in table.columns])


def fill_unique(table: DataFrame, claims: DataFrame, key: str, column: str) -> DataFrame:
    """Claims (key, column) fill nulls, but no value twice and none that is held; the least key wins a value."""
    held = table.filter(F.col(column).isNotNull()).select(column).distinct()
    open_ = table.filter(F.col(column).isNull()).select(key)
    wins = one_per(claims.filter(F.col(column).isNotNull()).join(open_, key, "left_semi").join(held, column, "left_anti"), [column], [F.col(key)])
    return fill_nulls(table, one_per(wins, [key], [F.col(column)]), key, [column])


def repoint(table: DataFrame, mapping: DataFrame, column: str, key: list[str], order: list[Column] | None = None) -> DataFrame:
    """Losers' references go to their canonical (mapping: loser, canonical); of rows that then share a key one stays, the canonical's first."""
    moved = table.join(mapping.select(F.col("loser").alias(column), "canonical"), column, "left")
    moved = moved.withColumn("__moved", F.col("canonical").isNotNull()).withColumn(column, F.coalesce("canonical", column)).drop("canonical")
    return one_per(moved, key, [F.col("__moved"), *(order or [])]).select(*table.columns)


def lifecycle(state: DataFrame, crawl: DataFrame, keys: list[str], entity: str, now: Column) -> DataFrame:
    """Playlist members after a crawl: (keys, detected_at, removed_at, change).

    Members of crawled entities that are absent are marked removed; those that
    are back are cleared; new ones are inserted. Entities not crawled stay.
    """
    crawled = crawl.select(entity).distinct().withColumn("__crawled", F.lit(True))
    here = crawl.select(*keys).distinct().withColumn("__here", F.lit(True))
    both = state.join(here, keys, "full_outer").join(crawled, entity, "left")
    new, back, gone = F.col("detected_at").isNull(), F.col("__here") & F.col("removed_at").isNotNull(), F.col("__crawled") & F.col("__here").isNull() & F.col("removed_at").isNull()
    return both.select(
        *keys,
        F.coalesce("detected_at", now).alias("detected_at"),
        F.when(F.coalesce("__here", F.lit(False)), None).when(gone, now).otherwise(F.col("removed_at")).alias("removed_at"),
        F.when(new, "inserted").when(back, "restored").when(gone, "removed").otherwise("kept").alias("change"),
    )


def not_done(candidates: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a checkpoint of processed keys leaves to do."""
    return candidates.join(done.select(key), key, "left_anti")


def replace_children(children: DataFrame, fresh: DataFrame, parent: str) -> DataFrame:
    """Children of the parents in ``fresh`` are deleted and inserted anew."""
    return children.join(fresh.select(parent).distinct(), parent, "left_anti").unionByName(fresh.select(*children.columns))


def purged(table: DataFrame, at: str, run: Column) -> DataFrame:
    """Rows that the run at ``run`` touched; older ones and those without a date go."""
    return table.filter(F.col(at) >= run)


def fan_out(links: DataFrame, tokens: DataFrame) -> DataFrame:
    """(catalog_id, artist_id): new links of each source's tracks to the source's tokens, none that is there.

    ``links``: catalog_id, artist_id; ``tokens``: source_id, artist_id.
    """
    wide = links.select("catalog_id", F.col("artist_id").alias("source_id")).join(tokens, "source_id").select("catalog_id", "artist_id").distinct()
    return wide.join(links.select("catalog_id", "artist_id"), ["catalog_id", "artist_id"], "left_anti")


def top_up(table: DataFrame, records: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Nulls filled from records (key, columns), and ``changed``: how many of the row's columns were."""
    found = records.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    x = table.join(found, key, "left")
    changed = sum(((F.col(c).isNull() & F.col(f"__{c}").isNotNull()).cast("int") for c in columns), F.lit(0))
    return x.select(*[F.coalesce(c, f"__{c}").alias(c) if c in columns else F.col(c) for c in table.columns], changed.alias("changed"))
