"""SimHash near-dedup down to a stated similarity: texts whose word shingles have a Jaccard similarity of ``SIMILAR`` or more.

SimHash fingerprints of the shingle sets are linked by pigeonring filtering first,
which joins what differs in a word or two. Fingerprints alone can't reach a
similarity of 0.8: there two differ in 10 of 64 bits on average and often in 14, and
a ring of 15 segments has keys of a few bits, which nearly all texts share. Further
candidates therefore share one of ``BANDS`` keys of ``ROWS`` minhashes each; at 0.8 a
pair shares none with a chance of (1 - 0.8 ** 4) ** 40, or 7e-10, whatever its texts'
lengths. All candidates are verified against the whole shingle sets.

Texts with equal sets are one class. Components need not all links: the members of
a key are verified against its least class and its greatest. Classes apart even then
are never all paired: such two must share one of their rarest shingles (prefix
filtering), with enough shingles after it in both (positional filtering), and only
those that do meet: those outside a shingle's largest component meet all that have
it, and two meet at the first shingles that they share, not at each. Wherever two
classes meet, bitmaps of their sets bound from below how much these differ, and
pairs that differ too much go no further (bitmap filtering). All filters are exact.
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
from wavecrate.llm.scratch import materialize, small
from wavecrate.llm.simhash import links
from wavecrate.shipping import ship

WORDS, SIMILAR = 5, (4, 5)
BANDS, ROWS = 40, 4
#: Longs of a set's bitmap.
BITMAP = 8
BITS = [f"b{i}" for i in range(BITMAP)]
#: Shingles before a shared one that are looked at for whether two classes have met already.
BEFORE = 8
#: Shingles whose minhashes are taken at once.
BLOCK = 1 << 12
_SALTS = np.random.default_rng(42).integers(1, 1 << 63, size=(BANDS * ROWS, 2), dtype=np.uint64) | np.uint64(1)


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a UTF-8 text's word shingles; a shorter text is one shingle, a wordless one has none."""
    parts = text.lower().split() if text else []  # of bytes, as in simhash.fingerprint
    if not parts:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined)], dtype=np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
    starts = np.concatenate(([0], gaps[: len(parts) - words] + 1)).tolist()
    ends = np.concatenate((gaps[words - 1 :], [len(joined)])).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b]) for a, b in zip(starts, ends)), dtype=np.uint64, count=len(starts)))


def bands(found: np.ndarray) -> list[int]:
    """The keys of a set of shingles, as signed longs; none for the empty set."""
    if not len(found):
        return []
    least = np.full(len(_SALTS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(found), BLOCK):
        h = (found[None, k : k + BLOCK] ^ _SALTS[:, :1]) * _SALTS[:, 1:]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9FB21C651E98DF25)
        np.minimum(least, h.min(axis=1), out=least)
    rows = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(r.tobytes(), i) - (1 << 63) for i, r in enumerate(rows)]


def print_of(found: np.ndarray) -> int:
    """The 64-bit SimHash of a set of shingles, as a signed long."""
    if not len(found):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(found), BLOCK):
        ones += np.unpackbits(found[k : k + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(found), bitorder="little").tobytes(), "little", signed=True)


def bitmap(found: np.ndarray) -> np.ndarray:
    """Parities of a set's shingles by place: two sets' bitmaps differ in no more bits than the sets have shingles that only one of them has."""
    odd = np.bincount((found & np.uint64(64 * BITMAP - 1)).astype(np.int64), minlength=64 * BITMAP) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _signed(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes()) - (1 << 63)


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cls, n, fps, bits, keys = [], [], [], [], []
        for text in batch.column(2):
            found = shingles(text.as_py())
            cls.append(_signed(found))
            n.append(len(found))
            fps.append(print_of(found))
            bits.append(bitmap(found))
            keys.append(bands(found))
        numbers = [pa.array(c, pa.int64()) for c in (cls, n, fps, *np.array(bits, dtype=np.int64).reshape(-1, BITMAP).T)]
        yield pa.record_batch([batch.column(0), batch.column(1), *numbers, pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "row_key", "cls", "n", "fp", *BITS, "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingles(t.as_py()) for t in batch.column(1)]
        sets = pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64()))
        yield pa.record_batch([batch.column(0), sets], names=["cls", "shingles"])


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of ``pairs`` (a, b) whose sets are similar enough."""
    left, right = sets.toDF("a", "sa"), sets.toDF("b", "sb")
    met = pairs.join(left, "a").join(right, "b").select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("both"), (F.size("sa") + F.size("sb")).alias("sum"))
    p, q = SIMILAR  # both / (sum - both) >= p / q
    return met.filter(F.col("both") * (p + q) >= F.col("sum") * p).select("a", "b")


def _print_pairs(prints: DataFrame) -> DataFrame:
    """(a, b): classes whose fingerprints are equal or linked, by way of each fingerprint's least class."""
    classes = prints.filter("n > 0").select("fp", "cls").distinct()
    least = materialize(classes.groupBy("fp").agg(F.min("cls").alias("low"), F.max("cls").alias("high")), "least-classes")
    same = classes.join(least.filter("low < high"), "fp").filter("cls <> low").select(F.col("low").alias("x"), F.col("cls").alias("y"))
    near = links(least.select("fp")).join(least.select(F.col("fp").alias("a"), F.col("low").alias("x")), "a").join(least.select(F.col("fp").alias("b"), F.col("low").alias("y")), "b")
    both = same.union(near.select("x", "y")).filter("x <> y")
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _pivot_pairs(shared: DataFrame) -> DataFrame:
    """(a, b): each class of ``shared`` (cls, n, key, bitmap) with the least and the greatest class of its keys."""
    p = F.struct("cls", "n", *BITS)
    ends = shared.groupBy("key").agg(F.array(F.min(p), F.max(p)).alias("p"))
    pivots = ends.select("key", F.explode("p").alias("p")).select("key", *[F.col(f"p.{c}").alias(c + "2") for c in ("cls", "n", *BITS)])
    return _pairs(shared.join(pivots, "key").filter((F.col("cls") != F.col("cls2")) & _alike()))


def _open_classes(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """(cls, n, root): classes that share a key with a class of another root."""
    rooted = shared.join(F.broadcast(roots) if small(roots) else roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    several = rooted.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).filter("r < s").select("key")
    return rooted.join(several, "key", "left_semi").select("cls", "n", "root").distinct()


def _rare_shingles(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """(cls, key, after, before, ...): of each class of ``open_`` (cls, n, root, bitmap), the shingles that similar sets can't all lack.

    With shingles from rare to common, two sets of a similarity of p / q share one
    of the first n - ceil(n * p / q) + 1 of either. Those that one class alone has
    come first and meet nothing. ``after`` counts the class's shingles from this one
    on; ``before`` has up to ``BEFORE`` that come just before it.
    """
    p, q = SIMILAR
    each = sets.join(open_.select("cls", "n"), "cls").select("cls", "n", F.explode("shingles").alias("s"))
    known = each.groupBy("s").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    shared = each.join(known, "s").groupBy("cls", "n").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("t"))
    first = F.col("n") - F.ceil(F.col("n") * p / q) + 1
    heads = shared.select("cls", F.size("t").alias("m"), F.slice("t.s", F.lit(1), F.greatest(F.lit(0), first - (F.col("n") - F.size("t"))).cast("int")).alias("h"))
    placed = F.transform("h", lambda s, i: F.struct(s.alias("key"), (F.col("m") - i).alias("after"), F.slice("h", F.greatest(i - BEFORE, F.lit(0)) + 1, F.least(i, F.lit(BEFORE))).alias("before")))
    return heads.select("cls", F.explode(placed).alias("x")).select("cls", "x.*").join(open_, "cls")


def _rare_rows(heads: DataFrame) -> DataFrame:
    """Rows of two classes of ``heads``, of unlike roots, that may be similar: one at least for each such pair, at the first shingle they share."""
    p, q = SIMILAR
    groups = heads.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m"))
    most = groups.groupBy("key").agg(F.max(F.struct("m", "root")).alias("most"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    # Those of a key's largest component never meet each other; the others meet all.
    outer = heads.join(most.select("key", F.col("most.root").alias("most")), "key").filter("root <> most")
    other = heads.select("key", *[F.col(c).alias(c + "2") for c in ("cls", "n", "root", "after", "before", *BITS)])
    once = (F.col("root2") == F.col("most")) | (F.col("cls") < F.col("cls2"))
    enough = F.least("after", "after2") * (p + q) >= (F.col("n") + F.col("n2")) * p
    return outer.join(other, "key").filter((F.col("root") != F.col("root2")) & once & enough & _alike() & ~F.arrays_overlap("before", "before2"))


def _alike() -> Column:
    """Whether two classes (n, bitmap; n2, bitmap 2) are of sizes and bitmaps that similar sets may have."""
    p, q = SIMILAR
    apart = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(b + "2"))) for b in BITS), F.lit(0))
    # Similar sets differ in (q - p) / (q + p) of both sizes at most.
    return (F.least("n", "n2") * q >= F.greatest("n", "n2") * p) & (apart * (p + q) <= (F.col("n") + F.col("n2")) * (q - p))


def _pairs(met: DataFrame) -> DataFrame:
    return met.select(F.least("cls", "cls2").alias("a"), F.greatest("cls", "cls2").alias("b")).distinct()


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_key, root) of every row: rows with one root are linked by similar texts."""
    ship(docs.sparkSession)
    ident, text = F.col(id_col), F.col(text_col)
    rows = docs.select(ident.cast("long").alias("doc_id"), row_key(ident, text).alias("row_key"), text.cast("binary").alias("t"))
    prints = materialize(rows.mapInArrow(_prints, f"doc_id long, row_key binary, cls long, n long, fp long, {', '.join(b + ' long' for b in BITS)}, keys array<long>"), "shingle-prints")
    keyed = prints.select("cls", "n", F.explode("keys").alias("key")).distinct()
    keyed = materialize(keyed, "band-keys")
    sizes = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("key"), "shared-bands")
    shared = materialize(keyed.join(F.broadcast(sizes) if small(sizes) else sizes, "key", "left_semi"), "shared-keys")
    # One text of each class that may have a link is read again.
    wanted = prints.join(shared.select("cls").distinct(), "cls", "left_semi").groupBy("cls").agg(F.min("row_key").alias("row_key"), *[F.min(b).alias(b) for b in BITS])
    wanted = materialize(wanted, "candidates")
    maps, chosen = wanted.drop("row_key"), wanted.select("cls", "row_key")
    texts = rows.select("row_key", "t").join(F.broadcast(chosen) if small(wanted) else chosen, "row_key").select("cls", "t").dropDuplicates(["cls"])
    sets = materialize(texts.mapInArrow(_sets, "cls long, shingles array<long>"), "candidate-sets")
    tried = materialize(_print_pairs(prints).union(_pivot_pairs(shared.join(maps, "cls"))).distinct(), "similar-candidates")
    found = materialize(_links(tried, sets), "similar-links")
    roots = materialize(connected_components(found), "set-components").toDF("cls", "root")
    open_ = materialize(_open_classes(shared, roots).join(maps, "cls"), "open-classes")
    if not open_.isEmpty():
        heads = materialize(_rare_shingles(open_, sets), "rare-shingles")
        pairs = materialize(_pairs(_rare_rows(heads)).join(tried, ["a", "b"], "left_anti"), "similar-candidates")
        found = materialize(_links(pairs, sets), "similar-links")
        if not found.isEmpty():
            roots = materialize(connected_components(roots.union(found)), "set-components").toDF("cls", "root")
    told = prints.select("doc_id", "row_key", "cls").join(F.broadcast(roots) if small(roots) else roots, "cls", "left")
    return told.select("doc_id", "row_key", F.coalesce("root", "cls").alias("root"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` per component of similar texts, with all its columns: of the least id, null ids last.

    Null and wordless texts are one component. An empty table gives an empty result.
    """
    told = materialize(similar_classes(docs, id_col, text_col), "similar-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("first")
    keys = materialize(told.groupBy("root").agg(first).select("first.row_key"), "representatives")
    repeated = told.groupBy("row_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("row_key")
    repeated = materialize(repeated.join(keys, "row_key", "left_semi"), "repeated-rows")
    return keep_rows(docs, keys, id_col, text_col, repeated)
