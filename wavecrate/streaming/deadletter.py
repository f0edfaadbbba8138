"""Records that can't be used, kept apart and bounded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_batches(good: Callable[[DataFrame], None], path: str, usable: Column) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: usable rows go to ``good``, all others are written under ``path``.

    A batch that is run again replaces what it wrote.
    """

    def run(batch: DataFrame, number: int) -> None:
        ok = F.coalesce(usable, F.lit(False))
        good(batch.filter(ok))
        batch.filter(~ok).withColumn("batch", F.lit(number)).write.mode("overwrite").json(f"{path}/batch={number}")

    return run


def latest(letters: DataFrame, at: str = "ts", ident: str = "event_id", keep: int = 1000) -> DataFrame:
    """The list as it is read: the last ``keep`` of all dead letters, newest first."""
    return letters.orderBy(F.desc_nulls_last(at), F.desc(ident)).limit(keep)
