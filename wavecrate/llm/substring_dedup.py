"""Substring dedup by sliding sentence spans.

A span starts at every sentence and runs over consecutive sentences until it has
at least ``RUN`` of them and ``MIN_WORDS`` words; another ends at every sentence
and starts as late as it can. Long sentences are cut where a word's hash is the
least around it, so a passage is cut alike whatever stands before it. Spans are hashed and counted over
all documents; of the places of one span the first (lowest id, then position)
stays and the sentences of every other place are removed. Where a span starts and
ends depends on what it holds alone, so copies of a passage give the same spans
wherever they stand.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavecrate.llm.rows import row_key
from wavecrate.llm.scratch import materialize, small
from wavecrate.shipping import ship

#: Consecutive sentences in a span, at least.
RUN = 2
#: Words in a span, at least.
MIN_WORDS = 20
#: A sentence of more words counts as several.
LONG = 16
#: It is cut after words whose hash is the least of so many words on either side, and after ``CAP`` words without such a one.
AROUND, CAP = 4, 64
SENTENCE = re.compile(r"\s*(\S[^.!?\n]*+(?:[.!?]++(?!\s|\Z)[^.!?\n]*+)*+[.!?]*+)")
WORD = re.compile(r"\S+")
#: Null ids come after all others (below this), each text in a place of its own.
LAST = 1 << 62
#: Spans that stand more often are joined by broadcasting them.
HOT = 1000


def cuts(long: list[list[str]]) -> list[list[int]]:
    """Numbers of words after which each long sentence is cut, its end included.

    A cut comes after each word but the last whose hash is below those of the ``AROUND`` words
    before it and at most those of the ``AROUND`` words after it.
    """
    apart, h, starts = [1 << 32] * AROUND, [], []
    for parts in long:
        h += apart
        starts.append(len(h))
        h += [xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass")) for w in parts]
    h = np.array(h + apart)
    n = len(h)
    least = h < 1 << 32
    for k in range(1, AROUND + 1):
        least[k:] &= h[k:] < h[: n - k]
        least[: n - k] &= h[: n - k] <= h[k:]
    at = np.flatnonzero(least)
    bounds = np.searchsorted(at, [starts, [s + len(p) - 1 for s, p in zip(starts, long)]]).tolist()
    at, out = (at + 1).tolist(), []
    for parts, start, first, last in zip(long, starts, *bounds):
        ends, before = [], 0
        for end in [*(x - start for x in at[first:last]), len(parts)]:
            ends.extend(range(before + CAP, end, CAP))
            ends.append(end)
            before = end
        out.append(ends)
    return out


def sentences(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, words joined by spaces, number of words) of each sentence."""
    held = [(m.start(1), m.end(1), m[1].split()) for m in SENTENCE.finditer(text)]
    long = [parts for *_, parts in held if len(parts) > LONG]
    ends_of, out = iter(cuts(long) if long else ()), []
    for a, b, parts in held:
        if len(parts) <= LONG:
            out.append((a, b, " ".join(parts), len(parts)))
            continue
        begin = 0
        if sum(map(len, parts)) + len(parts) - 1 == b - a:  # one blank between words
            for end in next(ends_of):
                words = " ".join(parts[begin:end])
                out.append((a, a + len(words), words, end - begin))
                a += len(words) + 1
                begin = end
            continue
        places = [m.span() for m in WORD.finditer(text, a, b)]
        for end in next(ends_of):
            out.append((places[begin][0], places[end - 1][1], " ".join(parts[begin:end]), end - begin))
            begin = end
    return out


def spans(parts: list[tuple[int, int, str, int]], run: int, min_words: int) -> Iterator[tuple[int, int, bytes]]:
    """(first sentence, number of sentences, 128-bit hash) of every span, in order: the shortest from each sentence on and the shortest up to each.

    At 10^12 spans two different ones share a hash with a chance of about 10^-15.
    """
    before = [0]
    for p in parts:
        before.append(before[-1] + p[3])
    places, last = set(), 0
    for first in range(len(parts)):
        while last < len(parts) and (last - first < run or before[last] - before[first] < min_words):
            last += 1
        if last - first < run or before[last] - before[first] < min_words:
            break
        places.add((first, last))
    first = 0
    for last in range(run, len(parts) + 1):
        if before[last] - before[first] < min_words:
            continue
        while last - first - 1 >= run and before[last] - before[first + 1] >= min_words:
            first += 1
        places.add((first, last))
    # A hash for each sentence keeps spans apart that differ only in where sentences end.
    each = [xxhash.xxh3_128_digest(p[2].encode("utf-8", "surrogatepass")) for p in parts] if places else []
    for first, last in sorted(places):
        yield first, last - first, xxhash.xxh3_128_digest(b"".join(each[first:last]))


def _spans(run: int, min_words: int):
    """Of spans that stand in a row of the table more than once, all places but the first are marked ``again``."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, place, again, hashes = [], [], [], []
            for i, text in enumerate(batch.column(2)):
                seen = set()
                for a, n, h in spans(sentences(text.as_py() or ""), run, min_words):
                    place.append(a << 32 | n)
                    again.append(h in seen)
                    seen.add(h)
                    hashes.append(h)
                rows.append(len(place))
            at = np.repeat(np.arange(len(rows)), np.diff(rows, prepend=0))
            halves = np.frombuffer(b"".join(hashes), dtype="<i8").reshape(-1, 2)
            yield pa.record_batch(
                [batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(place, pa.int64()), pa.array(again, pa.bool_()), *(pa.array(np.ascontiguousarray(halves[:, k])) for k in (0, 1))],
                names=["id", "key", "place", "again", "hash", "hash2"],
            )

    return go


def remove(text: str, covered: set[int]) -> tuple[str, list[tuple[int, int]]]:
    """The text without the covered sentences, and the code points that went; blanks go with the sentence before them."""
    parts, out, gone, at = sentences(text), [], [], 0
    for i, part in enumerate(parts):
        end = parts[i + 1][0] if i + 1 < len(parts) else len(text)
        if i in covered:
            out.append(text[at : part[0]])
            if gone and gone[-1][1] == part[0]:
                gone[-1] = (gone[-1][0], end)
            else:
                gone.append((part[0], end))
            at = end
    out.append(text[at:])
    return "".join(out), gone


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, counts, gone = [], [], []
        for text, covers in zip(batch.column(2), batch.column(3)):
            covered = {i for c in covers.as_py() for i in range(c >> 32, (c >> 32) + (c & (1 << 32) - 1))}
            t, g = remove(text.as_py(), covered)
            texts.append(t)
            counts.append(len(covered))
            gone.append(",".join(f"{a}:{b}" for a, b in g))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.string())], names=["doc_id", "row_key", "text", "n_removed", "removed"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per row of ``docs`` that loses a sentence: doc_id, row_key, text, n_removed, removed.

    text: what is left; n_removed: sentences removed; removed: start:end of what
    went, code points of the whole text, comma-joined. Rows that keep everything
    have none. Ids order the places of a span, null ids last; within a row, and
    among rows of one id, the earlier position stays. Repeated rows (same id and
    text) count as one text and are cleaned alike. Null, empty and short texts have
    no span. An empty table gives an empty result. Only the named columns are read.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(F.col(id_col), F.col(text_col)).alias("row_key"), F.col(text_col).alias("text"))
    # With the id, 126 bits or more tell rows apart.
    ident = F.coalesce("doc_id", F.lit(LAST) + F.call_function("shiftrightunsigned", F.xxhash64("row_key"), F.lit(2)))
    rows = rows.withColumns({"id": ident, "key": F.xxhash64(F.lit(1), "row_key")})
    found = rows.select("id", "key", "text").mapInArrow(_spans(run, min_words), "id long, key long, place long, again boolean, hash long, hash2 long")
    found = materialize(found, "spans")
    firsts, row, span = found.filter("not again"), ["id", "key"], ["hash", "hash2"]
    counts = firsts.groupBy(*span).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).filter("n > 1")
    counts = materialize(counts, "repeated-spans")
    hot = materialize(counts.filter(F.col("n") > HOT).select(*span, "first_id"), "hot-spans")
    if small(hot):  # at most one in HOT spans, so places of one span never meet in one task
        # One plan at every size: a broadcast of the others would only do for small tables.
        rest = counts.filter(F.col("n") <= HOT).select(*span, "first_id").hint("merge")
        places = firsts.join(F.broadcast(hot.select(*span)), span, "left_anti").join(rest, span)
        places = places.unionByName(firsts.join(F.broadcast(hot), span))
    else:
        places = firsts.join(counts.select(*span, "first_id"), span)
    gone = found.filter("again").select(*row, "place").union(places.filter("id > first_id").select(*row, "place"))
    # Rows of one id: the first of their places stays.
    shared = firsts.groupBy("id").agg(F.min("key").alias("least"), F.max("key").alias("greatest")).filter("least < greatest").select("id")
    shared = materialize(shared, "shared-ids")
    if not shared.isEmpty():
        order = Window.partitionBy(*span, "id").orderBy(F.shiftright("place", 32), "key")
        among = places.filter("id = first_id").join(shared, "id", "left_semi").withColumn("nth", F.dense_rank().over(order))
        gone = gone.union(among.filter("nth > 1").select(*row, "place"))
    covers = materialize(gone.groupBy(*row).agg(F.collect_list("place").alias("covers")), "covered")
    # Where their keys are few enough, only the texts that lose something are shuffled.
    keys = materialize(covers.select(*row), "covered-keys")
    held = rows.join(F.broadcast(keys), row, "left_semi") if small(keys) else rows
    touched = held.join(covers, row)
    return touched.select("doc_id", "row_key", "text", "covers").mapInArrow(_cleaned, "doc_id long, row_key binary, text string, n_removed long, removed string")
