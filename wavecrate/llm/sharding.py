"""Sharding by a k-d tree over document metadata.

A node splits along its widest metadata dimension at a weighted median: the
point that parts its bytes in proportion to the leaves on either side. Medians
are found for all nodes of a level at once by narrowing histograms, each a
map-side combined count of at most ``BINS`` bins a node; rows that share a value
are parted by a hash, so one source with a third of all rows splits like any
other. Only bins reach the driver, never rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecrate.llm.rows import numbered, private, row_key
from wavecrate.llm.scratch import materialize

BINS = 1024
#: Bytes that a row takes besides its text.
ROW_BYTES = 8
#: Ties are 62-bit hashes.
TIES = (1 << 62) - 1


@dataclass
class Node:
    """A node with its leaves; ``search`` is the interval that holds the split point."""

    first: int
    leaves: int
    weight: int = 0
    dim: int = 0
    target: float = 0.0
    below: int = 0
    phase: str = "value"
    lo: int = 0
    hi: int = 0
    value: int = 0
    cut: int = field(default=-1)


def _dimensions(docs: DataFrame, id_col: str, dims: dict[str, Column] | None) -> dict[str, Column]:
    if dims is not None:
        return dims
    found = {"id": F.call_function("shiftright", F.coalesce(F.col(id_col).cast("long"), F.lit(0)), F.lit(1))}
    found |= {c: F.crc32(F.col(c).cast("string")) for c in ("source", "lang") if c in docs.columns}
    return found


def _local(spark: SparkSession, rows: list[tuple], kinds: dict[str, str]) -> DataFrame:
    """A few rows of the driver's as a local relation, which needs no Python on the executors."""
    columns = list(zip(*rows)) or [()] * len(kinds)
    return spark.createDataFrame(pa.table([pa.array(c, k) for c, k in zip(columns, kinds.values())], names=list(kinds)))


def _level(meta: DataFrame, nodes: list[Node], names: list[str], spread: list[int]) -> None:
    """Find the split points of ``nodes``, which have the rows of ``meta`` with their first leaf as ``node``."""
    spark = meta.sparkSession
    ends = [f(f"d{i}").alias(f"{n}{i}") for i in range(len(names)) for f, n in ((F.min, "lo"), (F.max, "hi"))]
    for row in meta.groupBy("node").agg(F.sum("size").alias("w"), *ends).collect():
        for x in nodes:
            if x.first == row["node"]:
                x.weight, x.target = row["w"], row["w"] * (x.leaves // 2) / x.leaves
                widths = [(row[f"hi{i}"] - row[f"lo{i}"]) / max(1, spread[i]) for i in range(len(names))]
                x.dim = max(range(len(names)), key=lambda i: (widths[i], -i))
                x.lo, x.hi = row[f"lo{x.dim}"], row[f"hi{x.dim}"]
                if x.lo == x.hi:
                    x.phase, x.value, x.lo, x.hi = "tie", x.lo, 0, TIES
    open_nodes = [x for x in nodes if x.weight]
    value = F.element_at(F.array(*[F.col(f"d{i}") for i in range(len(names))]), F.col("dim") + 1)
    while open_nodes:
        steps = {x.first: max(1, -(-(x.hi - x.lo + 1) // BINS)) for x in open_nodes}
        rows = [(x.first, x.dim, x.phase == "tie", x.value, x.lo, x.hi, steps[x.first]) for x in open_nodes]
        state = _local(spark, rows, {"node": "int32", "dim": "int32", "tied": "bool", "value": "int64", "lo": "int64", "hi": "int64", "step": "int64"})
        held = meta.join(F.broadcast(state), "node").withColumn("v", value)
        held = held.withColumn("x", F.when(F.col("tied"), F.when(F.col("v") == F.col("value"), F.col("tie"))).otherwise(F.col("v")))
        held = held.filter("x between lo and hi").withColumn("bin", F.expr("(x - lo) div step"))
        bins: dict[int, list] = {}
        for r in held.groupBy("node", "bin").agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n")).collect():
            bins.setdefault(r["node"], []).append((r["bin"], r["w"], r["n"]))
        still = []
        for x in open_nodes:
            at, step = x.below, steps[x.first]
            for k, w, n in sorted(bins[x.first]):
                if at + w >= x.target or (k, w, n) == max(bins[x.first]):
                    break
                at += w
            lo = x.lo + k * step
            x.below, x.lo, x.hi = at, lo, min(x.hi, lo + step - 1)
            if x.phase == "value" and x.lo == x.hi:
                x.phase, x.value, x.lo, x.hi = "tie", x.lo, 0, TIES
                still.append(x)
            elif x.phase == "tie" and (n == 1 or x.lo == x.hi):
                x.cut = x.hi if at + w - x.target <= x.target - at else x.lo - 1
            else:
                still.append(x)
        open_nodes = still


def kd_shards(
    docs: DataFrame,
    target_bytes: int | None = None,
    shards: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    dims: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, row_key, size, text_crc32, shard, slot.

    Splits until leaves reach ``target_bytes`` (or into ``shards`` leaves). Size is
    the text's UTF-8 bytes plus 8; a null text has none. ``dims`` maps names to
    whole-number columns (default: the id and hashes of source and lang); a null
    counts as 0 there. Slots are gapless from 0 in each shard. Repeated rows (same
    id and text) stay in one shard, as they share every key; an empty table gives
    an empty result. Only the columns named are read, so others never clash.
    """
    found = _dimensions(docs, id_col, dims)
    names = list(found)
    text = F.coalesce(F.col(text_col), F.lit(""))
    meta = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        row_key(F.col(id_col), F.col(text_col)).alias("row_key"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        *[F.coalesce(c.cast("long"), F.lit(0)).alias(f"d{i}") for i, c in enumerate(found.values())],
    )
    meta = materialize(meta.withColumn("tie", F.call_function("shiftrightunsigned", F.xxhash64("row_key"), F.lit(2))), "metadata")
    ends = [f(f"d{i}").alias(f"{n}{i}") for i in range(len(names)) for f, n in ((F.min, "lo"), (F.max, "hi"))]
    whole = meta.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("w"), *ends).first()
    leaves = shards or max(1, -(-whole["w"] // (target_bytes or 1)))
    spread = [(whole[f"hi{i}"] or 0) - (whole[f"lo{i}"] or 0) for i in range(len(names))]
    tree = meta.withColumn("node", F.lit(0))
    level = [Node(0, leaves)] if whole["w"] else []
    value = F.element_at(F.array(*[F.col(f"d{i}") for i in range(len(names))]), F.col("dim") + 1)
    while level := [x for x in level if x.leaves > 1]:
        _level(tree, level, names, spread)
        rows = [(x.first, x.dim, x.value, x.cut, x.first + x.leaves // 2) for x in level if x.weight]
        splits = _local(docs.sparkSession, rows, {"node": "int32", "dim": "int32", "value": "int64", "cut": "int64", "right": "int32"})
        left = (value < F.col("value")) | ((value == F.col("value")) & (F.col("tie") <= F.col("cut")))
        tree = tree.join(F.broadcast(splits), "node", "left").withColumn("node", F.when(left | F.col("right").isNull(), F.col("node")).otherwise(F.col("right"))).drop("dim", "value", "cut", "right")
        level = [y for x in level for y in (Node(x.first, x.leaves // 2), Node(x.first + x.leaves // 2, x.leaves - x.leaves // 2))]
    placed = materialize(tree.select("doc_id", "row_key", "size", "text_crc32", F.col("node").alias("shard")), "placed")
    sizes = materialize(placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")), "shard-rows")
    return numbered(placed, "shard", ["row_key", "doc_id"], "slot", sizes).select("doc_id", "row_key", "size", "text_crc32", "shard", "slot")


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", **how) -> None:
    """Write all rows of ``docs`` under ``path`` with all their columns, one folder a shard.

    The folders' column is ``shard``, or a longer name if ``docs`` has that one.
    Repeated rows are all written, in one shard; an empty table writes no folder.
    """
    key, shard = private(docs, "__row_key"), private(docs, "shard")
    placed = kd_shards(docs, id_col=id_col, text_col=text_col, **how).select(F.col("row_key").alias(key), F.col("shard").alias(shard)).distinct()
    held = docs.withColumn(key, row_key(F.col(id_col), F.col(text_col)))
    held.join(placed, key).drop(key).write.partitionBy(shard).parquet(path)
