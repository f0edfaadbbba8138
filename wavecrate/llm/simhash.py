"""SimHash near-dedup with pigeonring filtering.

Fingerprints are cut into segments on a ring. If two differ in at most ``bits``
bits, then from some segment on every chain of consecutive segments stays within
its proportional budget: the first l segments differ in at most l * bits / m bits
(Qin and Xiao, "Pigeonring", 2018). With more segments than bits the first
segment of such a chain is equal and the first two differ in at most one bit, so
one half of the second is equal too: an equi-join key of about half the bits.
Pairs that share a key must pass the chain budgets before the full Hamming check.

Only distinct fingerprints are compared. A bucket of more than ``BUCKET``
fingerprints is not paired: each of them emits itself and its one-bit
neighbours instead (a fingerprint at distance 2 shares one of those), which
links the same fingerprints through groups of at most 65 members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavecrate.llm.components import connected_components
from wavecrate.llm.rows import keep_rows, row_key
from wavecrate.llm.scratch import materialize
from wavecrate.shipping import ship

#: Distinct fingerprints of one key that are compared pairwise; larger buckets go another, exact way.
BUCKET = 16
#: Shingles whose bits are added up at once.
BLOCK = 1 << 16


def fingerprint(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a UTF-8 text's word shingles; 0 for null and for no word."""
    if not text:
        return 0
    parts = text.lower().split()  # of bytes: folds A-Z only, splits at 20 and 09-0D only
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    gaps = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
    starts = np.concatenate(([0], gaps[: len(parts) - words] + 1)).tolist()
    ends = np.concatenate((gaps[words - 1 :], [len(joined)])).tolist()
    n, ones = len(starts), np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, n, BLOCK):
        h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[k : k + BLOCK], ends[k : k + BLOCK])), dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(t.as_py()) for t in batch.column(2)), dtype="<u8", count=batch.num_rows)
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(prints.view("<i8"))], names=["doc_id", "row_key", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_key, fp) of every row; fp holds the 64 bits as a signed long."""
    ship(docs.sparkSession)
    ident, text = F.col(id_col), F.col(text_col)
    rows = docs.select(ident.cast("long").alias("doc_id"), row_key(ident, text).alias("row_key"), text.cast("binary").alias("t"))
    return rows.mapInArrow(_fingerprints, "doc_id long, row_key binary, fp long")


def _shift(bits: Column, left: int) -> Column:
    return F.call_function("shiftleft", bits, F.lit(left)) if left >= 0 else F.call_function("shiftrightunsigned", bits, F.lit(-left))


def _mask(low: int, high: int) -> int:
    """Bits low to high - 1, as a signed long."""
    m = ((1 << (high - low)) - 1) << low
    return m - (1 << 64) if m >> 63 else m


def segments(m: int) -> list[tuple[int, int]]:
    edges = [round(64 * i / m) for i in range(m + 1)]
    return list(zip(edges, edges[1:]))


def ring_keys(fp: Column, m: int) -> list[Column]:
    """For each start on the ring: the first segment with either half of the second."""
    cuts, out = segments(m), []
    for i in range(m):
        (a, b), (c, d) = cuts[i], cuts[(i + 1) % m]
        for low, high in ((c, (c + d) // 2), ((c + d) // 2, d)):
            out.append(fp.bitwiseAND(F.lit(_mask(a, b) | _mask(low, high)).cast("long")))
    return out


def within_ring(diff: Column, start: Column, m: int, bits: int) -> Column:
    """Whether the chains from segment ``start`` on stay within l * bits / m, for all l."""
    cuts = segments(m)
    ones = [F.bit_count(diff.bitwiseAND(F.lit(_mask(a, b)).cast("long"))) for a, b in cuts]
    held = F.lit(False)
    for i in range(m):
        chain, ok = F.lit(0), F.lit(True)
        for length in range(1, m + 1):
            chain = chain + ones[(i + length - 1) % m]
            ok = ok & (chain * m <= length * bits)
        held = F.when(start == i, ok).otherwise(held)
    return held


def links(prints: DataFrame, bits: int = 2, m: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """(a, b): pairs that connect all distinct fingerprints within ``bits`` bits of each other.

    ``prints`` has one column fp, each value once. Every pair returned is a true
    link; pairs implied through a third member of a large bucket may be left out.
    Beyond 2 bits all members of a bucket are paired, so its cost grows with its square.
    """
    m = m or bits + 1
    if m <= bits:
        raise ValueError("the ring needs more segments than bits")
    keyed = prints.select("fp", F.posexplode(F.array(*ring_keys(F.col("fp"), m))).alias("k", "key"))
    sizes = keyed.groupBy("k", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = materialize(keyed.join(sizes, ["k", "key"]), "ring-keys")
    # Members of large buckets meet in another way, which is known for up to 2 bits; beyond, all are paired.
    few = (shared if bits > 2 else shared.filter(F.col("n") <= bucket)).select("k", "key", "fp")
    other = few.withColumnRenamed("fp", "fp2")
    diff = F.col("fp").bitwiseXOR(F.col("fp2"))
    ring = within_ring(diff, (F.col("k") / 2).cast("int"), m, bits)
    pairs = few.join(other, ["k", "key"]).filter((F.col("fp") < F.col("fp2")) & ring & (F.bit_count(diff) <= bits)).select("fp", "fp2")
    if bits > 2:
        return pairs.distinct().toDF("a", "b")
    crowd = shared.filter(F.col("n") > bucket).select("fp").distinct()
    return pairs.union(_neighbours(crowd, bits)).distinct().toDF("a", "b")


def _neighbours(prints: DataFrame, bits: int) -> DataFrame:
    """Links of fingerprints by shared neighbours at up to half of ``bits`` bits, for 2 bits or fewer.

    Members of one key lie within bits / 2 of it, so all are linked to its least
    member; a key has at most 65 members.
    """
    if bits > 2:
        raise ValueError("large buckets are linked for up to 2 bits")
    flips = [F.lit(0).cast("long")] + ([F.lit(_mask(i, i + 1)).cast("long") for i in range(64)] if bits else [])
    keyed = prints.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(f) for f in flips])).alias("key"))
    least = keyed.groupBy("key").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low < high")
    pairs = keyed.join(least, "key").filter("fp <> low").select(F.col("low").alias("fp"), F.col("fp").alias("fp2"))
    if bits == 1:  # members of a key may be two bits apart
        pairs = pairs.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= 1)
    return pairs


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, row_key, fingerprint, component_id, n_links, root.

    Fingerprints link at ``bits`` or fewer differing bits; component_id is the
    least non-null id reachable (null if all are null); n_links counts the links
    found for the row's fingerprint; root names the component, also where ids are
    null. Null and wordless texts have
    fingerprint zero and link like any other. Repeated rows and ties share their
    fingerprint and component. An empty table gives an empty result. Only the two
    named columns are read.
    """
    prints = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    edges = materialize(links(classes.select("fp"), bits), "links")
    roots = materialize(connected_components(edges), "components")
    linked = roots.join(classes, F.col("node") == F.col("fp")).groupBy("root").agg(F.min("first_id").alias("component_id"))
    degree = edges.select(F.col("a").alias("fp")).union(edges.select(F.col("b").alias("fp"))).groupBy("fp").agg(F.count(F.lit(1)).alias("n_links"))
    known = roots.join(linked, "root").select(F.col("node").alias("fp"), "root", "component_id", F.lit(True).alias("linked"))
    named = classes.join(known, "fp", "left").join(degree, "fp", "left")
    named = materialize(
        named.select(
            "fp",
            F.coalesce("root", "fp").alias("root"),
            F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("first_id")).alias("component_id"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        ),
        "named",
    )
    return prints.join(named, "fp").select("doc_id", "row_key", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_links", "root")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 2) -> DataFrame:
    """One row of ``docs`` per component, with all its columns: of the least id, null ids last."""
    told = near_duplicates(docs, id_col, text_col, bits)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("first")
    keys = materialize(told.groupBy("root").agg(first).select("first.row_key"), "representatives")
    repeated = told.groupBy("row_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("row_key")
    repeated = materialize(repeated.join(keys, "row_key", "left_semi"), "repeated-rows")
    return keep_rows(docs, keys, id_col, text_col, repeated)
