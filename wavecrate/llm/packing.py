"""Packing token sequences by non-negative least squares.

A document's ids are cut into full windows and a remainder. Combinations of up
to three remainder lengths that fill the window exactly are enumerated, repeat
counts are solved against the histogram of remainders by non-negative least
squares, rounded down, and what is left is packed greedily, largest first. The
histogram has a bin per length, so the plan's size depends on the window alone;
it is joined back to the documents, each numbered within its length.

Ids are needed once: tokenizing keeps the checksums of the full windows and of
the remainder's prefixes at every ``GRID`` ids; the greedy step cuts a remainder
only there, and the checksum of a cut's second part follows from two prefixes.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from wavecrate.llm.rows import numbered, row_key
from wavecrate.llm.scratch import materialize, small
from wavecrate.shipping import ship

WINDOW = 2048
#: Remainders are cut at multiples of this many ids.
GRID = 64
#: First lengths of three-part combinations are multiples of this.
STRIDE = 64
#: The id that ends a document.
END = 1


class Ids:
    """The ids that ``tokenizers`` gives for a byte-level BPE file.

    The file's vocabulary also feeds an encoder that yields the same ids several
    times faster; texts that it can't take, or that hold one of the file's added
    tokens, go to ``tokenizers`` itself.
    """

    #: Fixed value: the split pattern of the byte-level pre-tokenizer.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    #: The fast encoder's pattern engine runs out of stack in very long blanks.
    LONG_BLANK = r"\s{5000}"

    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec.get("added_tokens", ())}
        self.odd = re.compile("|".join([self.LONG_BLANK, *map(re.escape, sorted(special))]))
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.fast = tiktoken.Encoding("ranks", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def slow(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    def __call__(self, text: str) -> np.ndarray:
        if self.odd.search(text):
            ids = self.slow.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return np.array([*ids, END], dtype="<u4")


_IDS: dict[str, Ids] = {}


def piece_sums(ids: np.ndarray, window: int, grid: int) -> tuple[list[int], list[int]]:
    """Checksums of the full windows, and of the remainder's prefixes at every ``grid`` ids and at its end."""
    raw, n = ids.tobytes(), len(ids)
    full = [zlib.crc32(raw[4 * k : 4 * (k + window)]) for k in range(0, n - window + 1, window)]
    start, sums, crc = n - n % window, [], 0
    for k in range(start, n, grid):
        crc = zlib.crc32(raw[4 * k : 4 * min(k + grid, n)], crc)
        sums.append(crc)
    return full, sums


def tokenized(docs: DataFrame, path: str, id_col: str, text_col: str, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _IDS.get(path) or _IDS.setdefault(path, Ids(path))
        for batch in batches:
            n, full, rest = [], [], []
            for text in batch.column(2):
                ids = ids_of(text.as_py() or "")
                a, b = piece_sums(ids, window, GRID)
                n.append(len(ids))
                full.append(a)
                rest.append(b)
            sums = pa.list_(pa.int64())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(full, sums), pa.array(rest, sums)], names=["doc_id", "row_key", "doc_tokens", "full", "rest"])

    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(F.col(id_col), F.col(text_col)).alias("row_key"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, "doc_id long, row_key binary, doc_tokens long, full array<long>, rest array<long>")


def combinations(window: int) -> np.ndarray:
    """Rows of three lengths (0: none) that add up to the window."""
    two = [(a, window - a, 0) for a in range(window // 2, window)]
    three = [(a, b, window - a - b) for a in range(STRIDE, window // 3 + 1, STRIDE) for b in range(a, (window - a) // 2 + 1)]
    return np.array(two + three, dtype=np.int64).reshape(-1, 3)


def repeats(histogram: np.ndarray, combos: np.ndarray, steps: int = 200) -> np.ndarray:
    """Whole repeat counts: non-negative least squares by multiplicative updates, scaled to what is there, rounded down."""
    n, parts = len(histogram), combos.T
    present = histogram > 0
    present[0] = True
    x = np.where(present[combos].all(axis=1), 1.0, 0.0)
    goal = histogram.astype(float)
    goal[0] = 0.0

    def used(x: np.ndarray) -> np.ndarray:
        u = sum(np.bincount(p, weights=x, minlength=n) for p in parts)
        u[0] = 0.0
        return u

    wanted = goal[combos].sum(axis=1)
    for _ in range(steps):
        x *= wanted / np.maximum(used(x)[combos].sum(axis=1), 1e-9)
    share = np.ones(n)
    u = used(x)
    np.divide(goal, u, out=share, where=u > 0)
    share[0] = 1.0
    return np.floor(x * np.minimum(1.0, share[combos].min(axis=1)) + 1e-9).astype(np.int64)


@dataclass
class Placed:
    """Remainders ``lo`` to ``hi`` of one length: ids from ``start`` on, ``length`` of them, ``per`` to a sequence."""

    rem: int
    lo: int
    hi: int
    start: int
    length: int
    sequence: int
    per: int
    offset: int


def plan(histogram: np.ndarray, window: int = WINDOW, grid: int = GRID) -> tuple[list[Placed], int]:
    """Where each remainder goes, and the number of sequences used. ``histogram``: documents by remainder length."""
    out: list[Placed] = []
    used, sequence = np.zeros(len(histogram), dtype=np.int64), 0
    combos = combinations(window)
    counts = repeats(histogram, combos)
    for k in np.flatnonzero(counts):
        n, offset = int(counts[k]), 0
        for length in (int(v) for v in combos[k] if v):
            out.append(Placed(length, int(used[length]), int(used[length]) + n, 0, length, sequence, 1, offset))
            used[length] += n
            offset += length
        sequence += n
    # What is left: (length, remainder, start) -> ranges of numbers.
    ranges: dict[tuple[int, int, int], list[list[int]]] = {}
    order: list[tuple[int, int, int]] = []

    def add(key: tuple[int, int, int], lo: int, hi: int) -> None:
        if key not in ranges:
            ranges[key] = []
            insort(order, key)
        ranges[key].append([lo, hi])

    def take(key: tuple[int, int, int], n: int) -> tuple[int, int]:
        top = ranges[key][-1]
        lo = top[0]
        top[0] += n
        if top[0] == top[1]:
            ranges[key].pop()
            if not ranges[key]:
                del ranges[key]
                order.remove(key)
        return lo, lo + n

    for length in range(1, window):
        if histogram[length] > used[length]:
            add((length, length, 0), int(used[length]), int(histogram[length]))
    while order:
        # A template: (key, uses in a sequence, ids of it); then as many sequences as the ranges on hand allow.
        template, space, taken = [], window, {}
        while space and order:
            k = bisect_right(order, (space, window, window)) - 1
            while k >= 0 and taken.get(order[k], 0) >= ranges[order[k]][-1][1] - ranges[order[k]][-1][0]:
                k -= 1
            if k < 0:
                break
            key = order[k]
            on_hand = ranges[key][-1][1] - ranges[key][-1][0] - taken.get(key, 0)
            per = min(space // key[0], on_hand)
            template.append((key, per, key[0]))
            taken[key] = taken.get(key, 0) + per
            space -= per * key[0]
        chunk = space // grid * grid
        if chunk:
            longer = [key for key in order[bisect_right(order, (chunk, window, window)) :] if taken.get(key, 0) < ranges[key][-1][1] - ranges[key][-1][0]]
            if longer:
                key = longer[-1]
                template.append((key, 1, chunk))
                taken[key] = taken.get(key, 0) + 1
        n = min((ranges[key][-1][1] - ranges[key][-1][0]) // uses for key, uses in taken.items())
        offset, rest = 0, []
        for key, per, length in template:
            lo, hi = take(key, n * per)
            out.append(Placed(key[1], lo, hi, key[2], length, sequence, per, offset))
            offset += per * length
            if length < key[0]:
                rest.append(((key[0] - length, key[1], key[2] + length), lo, hi))
        for key, lo, hi in rest:
            add(key, lo, hi)
        sequence += n
    return out, sequence


@F.pandas_udf(T.LongType())
def _second_part(whole: pd.Series, first: pd.Series, length: pd.Series) -> pd.Series:
    """The checksum of the last ``length`` ids of a text, from those of the text and of what is before them."""
    zeros = bytes(4 * int(length.max())) if len(length) else b""
    view = memoryview(zeros)
    return pd.Series([w if f is None or f != f else int(w) ^ zlib.crc32(view[: 4 * n], int(f)) ^ zlib.crc32(view[: 4 * n]) for w, f, n in zip(whole, first, length)], dtype="int64")


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and id 1; null and empty texts are that id alone. Every
    id lies in one piece; a sequence's pieces fill it from 0 without gaps, and only
    the last sequences of the greedy step fall short of the window by more than
    ``GRID`` ids. Repeated rows are packed once each. An empty table gives an empty
    result. Only the two named columns are read. ``tokenizer``: path of the BPE file.
    """
    if window % GRID:
        raise ValueError(f"the window must be a multiple of {GRID}")
    rows = tokenized(docs, tokenizer, id_col, text_col, window)
    rows = materialize(rows.withColumn("rem", (F.col("doc_tokens") % window).cast("int")), "tokenized")
    sizes = materialize(rows.groupBy("rem").agg(F.count(F.lit(1)).alias("n")), "remainders")
    histogram, total = np.zeros(window, dtype=np.int64), 0
    for r in sizes.collect():  # at most one row a length
        total += r["n"]
        histogram[r["rem"]] = r["n"]
    bases = np.concatenate(([0], np.cumsum(histogram)))[:-1]
    histogram[0] = 0
    placed, sequences = plan(histogram, window)
    spark = docs.sparkSession
    numbers = numbered(rows, "rem", ["row_key", "doc_id"], "nth", sizes)
    ordinal = F.broadcast(spark.createDataFrame([(i, int(b)) for i, b in enumerate(bases)], "rem int, base long"))
    numbers = numbers.join(ordinal, "rem").withColumn("ordinal", F.col("base") + F.col("nth")).drop("base")
    numbers = materialize(numbers, "numbered")

    full = numbers.select("doc_id", "doc_tokens", "ordinal", F.posexplode("full").alias("k", "ids_crc32")).select(
        "doc_id",
        (F.col("k") * window).cast("long").alias("start"),
        F.lit(window).cast("long").alias("length"),
        "ids_crc32",
        "doc_tokens",
        (F.lit(sequences) + F.col("ordinal") + F.col("k").cast("long") * total).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    schema = "rem int, lo long, hi long, first long, length long, sequence long, per long, base_offset long"
    table = materialize(spark.createDataFrame(pd.DataFrame([vars(p) for p in placed], columns=["rem", "lo", "hi", "start", "length", "sequence", "per", "offset"]), schema), "plan")
    parts = numbers.filter("rem > 0").join(F.broadcast(table) if small(table) else table, "rem").filter("nth >= lo and nth < hi")
    prefix = F.element_at("rest", F.ceil((F.col("first") + F.col("length")) / GRID).cast("int"))
    before = F.when(F.col("first") > 0, F.element_at("rest", F.greatest(F.lit(1), (F.col("first") / GRID).cast("int"))))
    at = F.col("nth") - F.col("lo")
    rest = parts.select(
        "doc_id",
        (F.col("doc_tokens") - F.col("rem") + F.col("first")).alias("start"),
        "length",
        prefix.alias("whole"),
        before.alias("before"),
        "doc_tokens",
        (F.col("sequence") + F.expr("(nth - lo) div per")).alias("sequence_id"),
        (F.col("base_offset") + at % F.col("per") * F.col("length")).alias("offset"),
    ).withColumn("ids_crc32", _second_part("whole", "before", "length"))
    return full.unionByName(rest.select(*full.columns))
