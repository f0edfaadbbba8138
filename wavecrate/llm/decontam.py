"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

A seed mask slides over the tokens of test and training texts and hashes those at
its ones; positions at its zeros may differ, so a passage with replaced words
still meets its source. Equal hashes are joined, each hit names a diagonal (an
ungapped alignment of item and document), and the tokens along it are compared:
a document is contaminated by an item if any stretch of the alignment of at least
``MIN_OVERLAP`` tokens, or the whole item if it is shorter, agrees in 0.8 or more.
Shorter items are cut into one run more than tokens of them may differ, so one run
is equal in both; runs are hashed as masks of ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavecrate.llm.rows import drop_rows, row_key
from wavecrate.llm.scratch import materialize, small

#: Ones are compared, zeros ignored. In 13 tokens or more, one replaced in five leaves a window that one of the two fits, wherever they are.
MASKS = ("111101", "110111")
MIN_OVERLAP = 13
#: Stretches agree in 4 of 5 at least.
AGREE = (4, 5)
#: Windows taken from an array at once; bounds the memory that a very long text takes.
CHUNK = 2048
#: A benchmark's seeds beyond the broadcast bound are filtered by 2 ** FILTER words of 64 bits: 16 MB at most.
FILTER = 20


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def seeds(rows: DataFrame, key: list[str], masks: tuple[str, ...] = MASKS) -> DataFrame:
    """(key..., pos, seed, hash) of every window of ``rows`` (key..., words); a mask longer than the text gives none."""
    span = max(map(len, masks))
    places = sorted({i for m in masks for i, c in enumerate(m) if c == "1"})
    chunks = rows.select(*key, "words", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - 1), F.lit(CHUNK))).alias("from"))
    chunks = chunks.select(*key, "from", F.expr(f"slice(words, from + 1, {CHUNK + span - 1})").alias("w"))
    shifted = [F.expr(f"slice(w, {i + 1}, {CHUNK})").alias(f"t{i}") for i in places]
    # Zipped once, so that hashing, probing and all after it run in generated code.
    wide = chunks.select(*key, "from", F.posexplode(F.arrays_zip(*shifted)).alias("k", "t"))
    found = []
    for n, m in enumerate(masks):
        ones = [F.col(f"t.t{i}") for i, c in enumerate(m) if c == "1"]
        whole = F.col(f"t.t{len(m) - 1}").isNotNull()  # masks end in a one
        found.append(F.when(whole, F.struct(F.lit(n).alias("seed"), F.xxhash64(*ones).alias("hash"))))
    each = wide.select(*key, (F.col("from") + F.col("k")).alias("pos"), F.explode(F.array(*found)).alias("s"))
    return each.filter("s is not null").select(*key, "pos", "s.seed", "s.hash")


def _bit(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))


def _filter_bits(rows: DataFrame) -> tuple[Column, Column]:
    """The word and the bits of a hash in a Bloom filter of 2 ** ``FILTER`` words."""
    h = F.xxhash64("seed", "hash")
    word = F.call_function("shiftrightunsigned", h, F.lit(64 - FILTER)).cast("int")
    return word, _bit(h.bitwiseAND(F.lit(63))).bitwiseOR(_bit(F.call_function("shiftrightunsigned", h, F.lit(6)).bitwiseAND(F.lit(63))))


def _meet(windows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``windows`` joined with ``wanted`` (materialised) on seed and hash.

    Seeds beyond the broadcast bound are first looked up in a Bloom filter, whose
    words are a broadcast table of a fixed greatest size; what passes is shuffled.
    """
    if small(wanted):
        return windows.join(F.broadcast(wanted), ["seed", "hash"])
    word, bits = _filter_bits(wanted)
    held = materialize(wanted.groupBy(word.alias("word")).agg(F.bit_or(bits).alias("bits")), "seed-filter")
    word, bits = _filter_bits(windows)
    asked = windows.withColumn("asked", word).withColumn("mask", bits)
    passed = asked.join(F.broadcast(held), (F.col("asked") == F.col("word")) & (F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask")), "left_semi")
    return passed.drop("asked", "mask").join(wanted, ["seed", "hash"])


def run_length(size: Column) -> Column:
    """Tokens in each of the runs that an item of ``size`` tokens is cut into: one run more than tokens may differ."""
    p, q = AGREE
    return F.floor(size / (F.floor(size * (q - p) / q) + 1)).cast("int")


def reaches(same: Column, least: Column) -> Column:
    """Whether a stretch of ``least`` or more of an array of booleans agrees in 0.8 or more; one pass."""
    p, q = AGREE
    steps = F.transform(same, lambda hit: F.when(hit, q - p).otherwise(-p))
    # Beside each step, the step ``least`` places before it, which is where the shortest stretch that ends here begins.
    late = F.concat(F.array_repeat(F.lit(None).cast("int"), least), steps)
    pairs = F.zip_with(steps, F.slice(late, 1, F.size(steps)), lambda a, b: F.struct(a.alias("now"), b.alias("late")))
    zero = F.struct(*[F.lit(0).alias(c) for c in ("n", "sum", "before", "low")], F.lit(False).alias("found"))

    def step(a: Column, x: Column) -> Column:
        n, total, before = a["n"] + 1, a["sum"] + x["now"], a["before"] + F.coalesce(x["late"], F.lit(0))
        low = F.least(a["low"], before)
        return F.struct(n.alias("n"), total.alias("sum"), before.alias("before"), low.alias("low"), (a["found"] | ((n >= least) & (total >= low))).alias("found"))

    return F.aggregate(pairs, zero, step, lambda a: a["found"])


def stretches(aligned: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, length, matched) of the longest stretch of ``least`` or more of each row's ``same`` that agrees in 0.8 or more, of those the best; rows without one go.

    With the steps of ``reaches`` added up, a stretch agrees enough if the sum at its
    end is not below that at its start. So for each end the longest one starts at the
    first place whose sum is not above: a minimum over the places in order of their
    sums. Two sorts of a row's places, however long it is. ``keys`` tell all rows apart.
    """
    p, q = AGREE
    steps = F.concat(F.array(F.lit(0)), F.transform("same", lambda hit: F.when(hit, q - p).otherwise(-p)))
    places = aligned.select(*keys, "least", F.posexplode(steps).alias("place", "step"))
    row = Window.partitionBy(*keys)
    sums = places.withColumn("sum", F.sum("step").over(row.orderBy("place")))
    first = F.min(F.struct("place", "sum")).over(row.orderBy("sum").rangeBetween(Window.unboundedPreceding, 0))
    length = F.col("place") - F.col("first.place")
    # Each of them adds q - p to the sum, and each of the others takes p from it.
    matched = (F.col("sum") - F.col("first.sum") + p * length) / q
    held = sums.withColumn("first", first).filter(length >= F.col("least"))
    best = held.groupBy(*keys).agg(F.max(F.struct(length.alias("length"), matched.cast("int").alias("matched"))).alias("s"))
    return best.select(*keys, "s.length", "s.matched")


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    masks: tuple[str, ...] = MASKS,
    min_overlap: int = MIN_OVERLAP,
) -> DataFrame:
    """One row per document and item that contaminates it: doc_id, row_key, item_id, overlap, matched, at, contaminated.

    overlap and matched: tokens of the best stretch and how many agree; at: the
    document's token where the alignment puts the item's first (negative if it is
    cut off); contaminated: always true. Clean documents have no row. Null and
    empty texts on either side have no tokens and match nothing. Repeated rows are reported once; of ties the
    alignment that comes first is named. An empty table on either side gives an
    empty result. Only the named columns are read. A benchmark beyond the broadcast
    bound is joined by shuffling.
    """
    named = benchmark.select(F.col(item_col).alias("item_id"), tokens(F.col(item_text)).alias("words"))
    items = materialize(named.select("item_id", F.xxhash64("words").alias("item_key"), "words").filter("size(words) > 0").distinct(), "benchmark-items")
    size = F.size("words")
    brief = items.filter(size < min_overlap)
    runs = sorted(r[0] for r in brief.select(run_length(size)).distinct().collect())
    first_run = len(masks)
    masks = (*masks, *("1" * n for n in runs))
    item_seeds = seeds(items.filter(size >= min_overlap), ["item_key"], masks).filter(F.col("seed") < first_run)
    if runs:
        lengths = brief.select("item_key", (F.array_position(F.array(*map(F.lit, runs)), run_length(size)) - 1 + first_run).alias("own")).distinct()
        item_seeds = item_seeds.union(seeds(brief, ["item_key"], masks).join(lengths, "item_key").filter("seed = own").drop("own"))
    wanted = materialize(item_seeds.select("seed", "hash", "item_key", F.col("pos").alias("q")).distinct(), "benchmark-seeds")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(F.col(id_col), F.col(text_col)).alias("row_key"), F.col(text_col).alias("text"))
    words = rows.select("row_key", tokens(F.col("text")).alias("words")).filter("size(words) > 0")
    met = _meet(seeds(words, ["row_key"], masks), wanted).select("row_key", "item_key", (F.col("pos") - F.col("q")).alias("at"))
    hits = materialize(met.distinct(), "seed-hits")
    # Only documents with a hit are read again.
    texts = rows.join(F.broadcast(hits.select("row_key").distinct()) if small(hits) else hits.select("row_key").distinct(), "row_key", "left_semi").dropDuplicates(["row_key"])
    texts = materialize(texts.select("doc_id", "row_key", tokens(F.col("text")).alias("words")), "hit-texts")
    known = items.withColumnRenamed("words", "item")
    aligned = texts.join(hits, "row_key").join(F.broadcast(known) if small(known) else known, "item_key")
    first = F.greatest(F.lit(0), -F.col("at"))
    count = F.least(F.size("item"), F.size("words") - F.col("at")) - first
    pairs = F.zip_with(F.slice("words", F.col("at") + first + 1, count), F.slice("item", first + 1, count), lambda a, b: a == b)
    least = F.least(F.lit(min_overlap), F.size("item"))
    keys = ["doc_id", "row_key", "item_id", "item_key", "at"]
    compared = aligned.filter(count >= least).select(*keys, least.alias("least"), pairs.alias("same"))
    held = materialize(compared.filter(reaches(F.col("same"), F.col("least"))), "leaks")
    best = stretches(held, keys).groupBy("doc_id", "row_key", "item_id").agg(F.max(F.struct("length", "matched", (-F.col("at")).alias("minus"))).alias("b"))
    return best.select(
        "doc_id",
        "row_key",
        "item_id",
        F.col("b.length").cast("long").alias("overlap"),
        F.col("b.matched").cast("long").alias("matched"),
        (-F.col("b.minus")).cast("long").alias("at"),
        F.lit(True).alias("contaminated"),
    )


def clean_rows(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with all their columns.

    Null and empty texts stay; repeated rows stay or go together; an empty table on
    either side leaves the rows as they are.
    """
    keys = materialize(contaminated(docs, benchmark, **how).select("row_key").distinct(), "contaminated-rows")
    return drop_rows(docs, keys, how.get("id_col", "doc_id"), how.get("text_col", "text"))
