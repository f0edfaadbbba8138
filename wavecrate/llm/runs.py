"""All runs (maximal repetitions) of words in each text.

A run is a stretch of words of smallest period q and at least 2q words that no
neighbour extends with that period. The texts of an Arrow batch are worked on
together, as one row of word numbers in which words of two texts never agree:

* names of all blocks of 1, 2, 4, ... words by prefix doubling. Only blocks that
  still share their name are sorted again; the last names order the suffixes.
  Two positions have the same block exactly if they have the same name, which
  answers how far two positions agree, forwards and backwards.
* previous and next smaller positions in suffix order give each position's
  longest previous factor, and these the blocks of the Lempel-Ziv parse.
* A run that touches a border of blocks (Main's extension) has a period of at
  most the two blocks beside it: if a run [s, t) ends in block i and holds the
  border b before it, then s > start of block i-1 minus q, or block i-1 and one
  more word would occur q words earlier. So 2q <= |i-1| + q + |i|. All these
  periods are extended both ways at once.
* Other runs lie inside a block and are those of the block's earlier occurrence,
  which are copied from buckets by their start, from left to right.

A run of ``least`` words or more repeats half of its words at once, so texts
without a repeated block of that length are left out before the suffixes are
ordered to the end.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavecrate.llm.rows import row_key
from wavecrate.shipping import ship

#: Words of texts that are worked on together; a longer text is worked on alone.
TOGETHER = 400_000

Run = tuple[int, int, int]


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of ``keys``, and for each place of it the first place of its equals."""
    order = np.argsort(keys)
    held = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = held[1:] != held[:-1]
    return order, np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))


def block_names(ids: np.ndarray, levels: int | None = None) -> list[np.ndarray]:
    """Names of the blocks of 2^k words from each position, k = 0, 1, ..., until none is shared or ``levels`` are made.

    A name is the number of blocks that are less, so the last names are the order
    of the suffixes. Blocks cut off by the end are like no other. Each array has
    one more entry, of -1.
    """
    n = len(ids)
    order, first = _ranked(ids)
    names = np.empty(n + 1, np.int64)
    names[order], names[n] = first, -1
    out = [names]
    while levels is None or len(out) < levels:
        names = out[-1]
        size = np.bincount(names[:n], minlength=n)
        tied = np.flatnonzero(size[names[:n]] > 1)
        if not len(tied):
            break
        width = 1 << (len(out) - 1)
        after = names[np.minimum(tied + width, n)]
        order, first = _ranked(names[tied] * (n + 1) + after + 1)
        group = names[tied][order]
        # Places count from the first member of the block that was shared.
        lead = np.ones(len(group), bool)
        lead[1:] = group[1:] != group[:-1]
        start = np.maximum.accumulate(np.where(lead, np.arange(len(group)), 0))
        longer = names.copy()
        longer[tied[order]] = group + first - start
        out.append(longer)
    return out


def agree(names: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Words from ``i`` on that equal those from ``j`` on; i and j differ everywhere."""
    i, j = i.copy(), j.copy()
    begun = i.copy()
    for k in range(len(names) - 1, -1, -1):
        step = (names[k][i] == names[k][j]).astype(np.int64) << k
        i += step
        j += step
    return i - begun


def agree_back(names: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Words up to and with ``i`` that equal those up to and with ``j``, counted backwards; i and j differ everywhere, -1 is before the first."""
    i, j = i.copy(), j.copy()
    begun = i.copy()
    for k in range(len(names) - 1, -1, -1):
        a, b = i - (1 << k) + 1, j - (1 << k) + 1
        same = (a >= 0) & (b >= 0)
        same &= names[k][np.maximum(a, 0)] == names[k][np.maximum(b, 0)]
        step = same.astype(np.int64) << k
        i -= step
        j -= step
    return begun - i


def _smaller_before(values: np.ndarray) -> np.ndarray:
    """The place of the nearest smaller value before each place, -1 if none; all values differ.

    Pointers start at the place before and jump by the pointer found there until
    they meet a smaller value. All between a place and its pointer is larger, at
    any time, so jumps may be made at once.
    """
    at = np.arange(len(values)) - 1
    held = np.append(values, -1)  # place -1
    live = np.flatnonzero(held[at] > values)
    while len(live):
        at[live] = at[at[live]]
        live = live[held[at[live]] > values[live]]
    return at


def longest_previous(names: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of each position the longest factor that also starts earlier, and where it does (-1 if nowhere)."""
    n = len(names[0]) - 1
    suffixes = np.empty(n, np.int64)
    suffixes[names[-1][:n]] = np.arange(n)
    length, source = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    for turned in (False, True):
        order = suffixes[::-1] if turned else suffixes
        place = _smaller_before(order)
        has = place >= 0
        i, j = order[has], order[place[has]]
        same = agree(names, i, j)
        better = same > length[i]
        length[i[better]], source[i[better]] = same[better], j[better]
    return length, source


def lz_borders(length: np.ndarray) -> np.ndarray:
    """Starts of the Lempel-Ziv blocks and the end: each block is its start's longest previous factor, or one new word."""
    out, at, steps = [], 0, np.maximum(length, 1).tolist()
    while at < len(steps):
        out.append(at)
        at += steps[at]
    return np.array([*out, len(steps)], np.int64)


def _at_borders(names: list[np.ndarray], borders: np.ndarray, least: int) -> dict[tuple[int, int], int]:
    """{(start, end): period} of the runs that touch a border."""
    n = int(borders[-1])
    sizes = np.diff(borders)
    beside = np.append(0, sizes) + np.append(sizes, 0)
    b = np.repeat(borders, beside)
    q = np.arange(len(b)) - np.repeat(np.cumsum(beside) - beside, beside) + 1
    words = names[0]
    found: dict[tuple[int, int], int] = {}
    for left in (True, False):  # the squares beside the border: a period before it, or after it
        lo = b - q if left else b
        use = (lo >= 0) & (lo + q <= n)
        lo, p = lo[use], q[use]
        # Nothing grows where neither the words at the two places nor those before them agree.
        use = (words[lo] == words[lo + p]) & (lo + p < n)
        use |= (lo > 0) & (words[np.maximum(lo - 1, 0)] == words[np.maximum(lo + p - 1, 0)])
        lo, p = lo[use], p[use]
        ahead = agree(names, lo, lo + p)
        back = agree_back(names, lo - 1, lo + p - 1)
        use = (ahead + back >= p) & (ahead + back + p >= least)
        for s, t, period in zip((lo - back)[use].tolist(), (lo + p + ahead)[use].tolist(), p[use].tolist(), strict=True):
            found[s, t] = min(period, found.get((s, t), period))
    return found


def all_runs(ids: np.ndarray, least: int) -> list[Run]:
    """(start, end, smallest period) of all runs of ``least`` numbers or more, by start, then end."""
    if len(ids) < 2:
        return []
    names = block_names(ids)
    length, source = longest_previous(names)
    borders = lz_borders(length)
    found = _at_borders(names, borders, least)
    buckets: dict[int, list[tuple[int, int]]] = {}
    for (s, t), q in found.items():
        buckets.setdefault(s, []).append((t, q))
    starts = sorted(buckets)
    large = np.flatnonzero(np.diff(borders) >= least + 2)
    for begin, size in zip(borders[large].tolist(), np.diff(borders)[large].tolist(), strict=True):
        origin = int(source[begin])
        end, shift = origin + size, begin - origin
        at = bisect.bisect_right(starts, origin)
        while at < len(starts) and starts[at] < end:
            s = starts[at]
            for t, q in list(buckets[s]):
                if t < end and (s + shift, t + shift) not in found:
                    found[s + shift, t + shift] = q
                    if s + shift not in buckets:
                        buckets[s + shift] = []
                        bisect.insort(starts, s + shift)
                    buckets[s + shift].append((t + shift, q))
            at += 1
    return sorted((s, t, q) for (s, t), q in found.items())


def _repeating(ids: np.ndarray, doc: np.ndarray, docs: int, half: int) -> np.ndarray:
    """Whether each text has some ``half`` words twice; only such texts can have runs."""
    level = half.bit_length() - 1
    names = block_names(ids, level + 1)
    level, n = len(names) - 1, len(ids)
    out = np.zeros(docs, bool)
    tied = np.flatnonzero(np.bincount(names[level][:n], minlength=n)[names[level][:n]] > 1)
    if len(tied):
        # Two blocks that overlap make one of ``half`` words.
        pair = names[level][tied] * (n + 1) + names[level][np.minimum(tied + max(half - (1 << level), 0), n)] + 1
        order, first = _ranked(pair)
        size = np.bincount(first, minlength=len(pair))
        out[doc[tied[order[size[first] > 1]]]] = True
    return out


def _numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word of all texts in turn, and its text; equal words of two texts have different numbers."""
    known: dict[bytes, int] = {}
    number = known.setdefault
    ids = np.fromiter((number(w, len(known)) for words in texts for w in words), np.int64, sum(map(len, texts)))
    doc = np.repeat(np.arange(len(texts)), [len(words) for words in texts])
    return ids + doc * max(1, len(known)), doc


def runs_of(texts: list[list[bytes]], least: int) -> list[list[Run]]:
    """The runs of each text."""
    out: list[list[Run]] = [[] for _ in texts]
    if not any(texts):
        return out
    ids, doc = _numbered(texts)
    live = _repeating(ids, doc, len(texts), max(1, -(-least // 2)))
    if live.any():
        keep = live[doc]
        ids, doc = ids[keep], doc[keep]
        begins = np.searchsorted(doc, np.arange(len(texts))).tolist()
        for s, t, q in all_runs(ids, least):
            k = int(doc[s])
            out[k].append((s - begins[k], t - begins[k], q))
    return out


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for s, t, q in runs:
        change[s + q] += 1
        change[t] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()]


def _find(least: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or b"").split() for t in batch.column(2).cast(pa.binary()).to_pylist()]
            begin, held = 0, 0
            for at, words in enumerate(texts):
                held += len(words)
                if held >= TOGETHER or at + 1 == len(texts):
                    yield _answer(batch.slice(begin, at + 1 - begin), texts[begin : at + 1], least)
                    begin, held = at + 1, 0

    return find


def _answer(batch: pa.RecordBatch, texts: list[list[bytes]], least: int) -> pa.RecordBatch:
    runs = runs_of(texts, least)
    listed = [[{"start": s, "length": t - s, "period": q} for s, t, q in sorted(own, key=lambda r: (r[0], r[2]))] for own in runs]
    kept = [b" ".join(collapsed(words, own)) for words, own in zip(texts, runs, strict=True)]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    return pa.record_batch([batch.column(0), batch.column(1), pa.array(listed, kind), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "row_key", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, least: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, row_key, runs, collapsed.

    Words are what stands between blanks (space, tab to carriage return), compared
    byte by byte. runs: array of (start, length, period) in words, by start, then
    period, of the runs of ``least`` words or more. collapsed: the words that no run
    holds after its first period, joined by one space. Null, empty and blank texts
    have no word, so no run, and an empty ``collapsed``. Repeated rows give repeated
    results. An empty table gives an empty result. Only the named columns are read.
    Nothing is shuffled; a text is held whole by one task, with 8 bytes a word for
    each doubling of its longest repeat.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(F.col(id_col), F.col(text_col)).alias("row_key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_find(least), "doc_id long, row_key binary, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(ident: Column, text: Column) -> Column:
    """The text in which, for one id in ten by its CRC-32, a stretch of words is repeated to the end; others as they are.

    With h the CRC-32 of the decimal id, g = floor(h / 10), n words, a = g mod n and
    p = 1 + floor((n - a) / (3 + g mod 8)), word i from a on becomes word
    a + (i - a) mod p. A null id leaves the text as it is.
    """
    h = F.crc32(ident.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    changed = F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), a), again), F.lit(1), n), " ")
    return F.when((h % 10 == 0) & (n > 0), changed).otherwise(text)


def digests(found: DataFrame) -> DataFrame:
    """``found`` (of ``periodic_runs``) with the number of runs, the longest run and digests instead of the runs and texts.

    The longest run's ties go to the smallest start, then the smallest period; without
    a run its columns are null.
    """
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws("", F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select("doc_id", "row_key", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id",
        "row_key",
        "n_runs",
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
