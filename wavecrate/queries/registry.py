"""The table of queries with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecrate.testbed import Bed, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, text: tuple[str, ...] = ()) -> Callable:
    """Register a function of a ``Bed`` under its name; ``sql`` is what DuckDB runs over the same views.

    ``text``: dates and timestamps that both sides give as text.
    """

    def add(f: Callable[[Bed], DataFrame]) -> Callable[[Bed], DataFrame]:
        QUERIES[f.__name__] = lambda spark, folder: f(Bed(spark, folder)).withColumns({c: F.col(c).cast("string") for c in text})
        if sql:
            plain = oracle(sql)
            shown = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in text)
            ORACLES[f.__name__] = f"SELECT * REPLACE ({shown}) FROM ({plain}) AS q" if text else plain
        return f

    return add
