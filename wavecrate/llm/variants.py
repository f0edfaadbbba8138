"""Spelling variants: words one edit apart, and the form that each stands for.

Words are met by a positional q-gram inverted index with a count filter. A word
of n letters has n + 2 grams of three, with two marks at each end. One edit
touches at most three, so of two near words' grams all but three of the longer
word's are in both. Hence:

* prefix: with each word's grams in one fixed order, rarest first, two near words
  share one of the first four (of the first 3 + c, they share c; grams equal to the
  last come along). Only these are posted and shuffled, frequent grams hardly ever.
* position: a shared gram before the edit stands at the same place from the
  start, one after it at the same place from the end. Postings are keyed by gram
  and place, once from either side.
* length: a posting list is read in order of length, and only words of the same
  length or one letter less are met.

A task gets whole posting lists and works on many of them at once, sorted by length:
pairs of a list stay if they share enough grams at their places, and are verified.
(Merging by a heap in Python took four times as long.) Lists of more than ``crowd``
words are posted again under two grams, then three: near words share so many. A list
yields verified pairs only, and those that meet in several lists from one of them.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecrate.llm.scratch import materialize, small
from wavecrate.shipping import ship

Q = 3
MARK = "\x00"
#: The most frequent grams whose frequency orders a word's grams; others count as rarest. Bounds what is broadcast.
RANKED_GRAMS = 50_000
#: Words of a posting list that are compared as they are, and rows of lists that are worked on together.
CROWD, AT_ONCE = 5000, 40_000
#: Letters of a word that are compared in arrays; longer words are compared one by one.
WIDE = 48
#: Grams that make a key, at most. Two words of five letters share four.
MOST_GRAMS = 3

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def lowered(word: str) -> str:
    """The word with A-Z in lower case; other letters stay."""
    return word.lower() if word.isascii() else word.translate(LOWER)


def misspelt(ident: int | None, word: str) -> str:
    """The word without one letter, in one of 97 by the CRC-32 of the row's id and the word; a null id changes nothing."""
    if ident is None:
        return word
    h = zlib.crc32(f"{ident}:{word}".encode())
    if h % 97:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, edit: Callable[[int | None, str], str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of all texts, A-Z lower-cased, and how often each stands.

    Words are maximal runs of letters, A-Z, a-z and U+00C0 to U+00FF. ``edit`` is
    given the row's id and the lower-cased word and returns what is counted. Null
    and empty texts have no word; repeated rows count each time. Counted per batch
    before anything is shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: Counter[str] = Counter()
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                own: Counter[str] = Counter()
                for word, n in Counter(LETTERS.findall(text)).items():
                    own[lowered(word)] += n
                for word, n in own.items():
                    held[edit(ident, word) if edit else word] += n
            yield pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    ship(docs.sparkSession)
    parts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def grams(word: str) -> list[str]:
    padded = MARK * (Q - 1) + word + MARK * (Q - 1)
    return [padded[i : i + Q] for i in range(len(word) + Q - 1)]


def near(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point makes ``b`` of ``a``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = 0
    while at < len(a) and a[at] == b[at]:
        at += 1
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def prefix(word: str, rank: dict[str, int], c: int) -> list[tuple[int, str, int]]:
    """(frequency, gram, place) of the first Q + c grams of the word, rarest first, with all that equal the last of them.

    Of the grams that one edit leaves untouched, the c rarest stand among these in both words.
    """
    listed = sorted([(rank.get(gram, 0), gram, at) for at, gram in enumerate(grams(word))])
    end = Q + c
    while end < len(listed) and listed[end][1] == listed[end - 1][1]:
        end += 1
    return listed[:end]


def _number(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) >> 1


def postings(word: str, rank: dict[str, int], c: int) -> set[int]:
    """The lists that the word is posted in: each of its first grams by its place from the start, and from the end, with ``c`` - 1 others of these grams wherever they stand."""
    chosen, size, out = prefix(word, rank, c), len(word), set()
    held = Counter(gram for _, gram, _ in chosen) if c > 1 else {}
    for _, gram, at in chosen:
        others = sorted(g for g, k in held.items() for _ in range(min(k - (g == gram), c - 1)))
        for some in set(combinations(others, c - 1)) if c > 1 else ((),):
            names = "\x01".join((gram, *some))
            out |= {_number(f"{names}\x02<{at}"), _number(f"{names}\x02>{size - at}")}
    return out


class Lists:
    """Whole posting lists, worked on together: rows (key, word, n, keys of the word) in order of key and length.

    Row i is compared with the rows 1, 2, ... after it, as long as the list goes on and
    lengths differ by one at most, for all i at once. A pair stays if the bit sets of its
    letter pairs differ in four at most (an edit takes two away and brings two), if it
    shares enough grams at their places, and if it is one edit apart.
    """

    def __init__(self, rows: list[tuple[int, str, int, bytes]], unique: bool):
        rows.sort(key=lambda r: (r[0], len(r[1])))
        self.rows, self.unique = rows, unique
        self.key = np.fromiter((r[0] for r in rows), np.int64, len(rows))
        self.size = np.fromiter((len(r[1]) for r in rows), np.int64, len(rows))
        width = int(min(WIDE, self.size.max())) + 2
        # Two marks behind each word make all its grams whole; those in front are the same for all.
        self.letters = np.array([r[1][: width - 2] for r in rows], f"<U{width}").view(np.uint32).reshape(len(rows), width)
        two = self.letters[:, :-1] * np.uint32(2654435761) + self.letters[:, 1:] * np.uint32(40503)
        self.sets = np.bitwise_or.reduce(np.left_shift(np.uint64(1), (two >> 8).astype(np.uint64) & np.uint64(63)), axis=1)

    def candidates(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        live, held, n = np.arange(len(self.rows)), [], 0
        step = 0
        while len(live):
            step += 1
            live = live[live < len(self.rows) - step]
            after = live + step
            go_on = (self.key[live] == self.key[after]) & (self.size[after] - self.size[live] <= 1)
            live = live[go_on]
            some = live[np.bitwise_count(self.sets[live] ^ self.sets[live + step]) <= 4]
            if len(some):
                held.append((some, some + step))
                n += len(some)
            if n > 100_000:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, n = [], 0
        if held:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs are one edit apart; j is as long as i, or one letter longer."""
        a, b, longer = self.letters[i], self.letters[j], self.size[j] - self.size[i]
        same = a == b
        # Of the longer word's n + 2 grams all but three must stand in the other one, at the same place or one before.
        shifted = np.zeros_like(same)
        shifted[:, 1:] = a[:, :-1] == b[:, 1:]
        gram = lambda x: x[:, 2:] & x[:, 1:-1] & x[:, :-2]
        inner = np.arange(a.shape[1] - 2)[None, :] < (self.size[j] - 2)[:, None]
        common = ((gram(same) | (gram(shifted) & (longer == 1)[:, None])) & inner).sum(1)
        enough = common >= self.size[j] - 2 - Q
        lead = np.logical_and.accumulate(same, axis=1).sum(1)
        tail = np.logical_and.accumulate(shifted[:, :0:-1], axis=1).sum(1) - (a.shape[1] - 1 - self.size[i])
        out = enough & np.where(longer == 0, (~same).sum(1) == 1, lead + tail >= self.size[i])
        wide = np.flatnonzero(self.size[j] > WIDE)
        out[wide] = [near(self.rows[x][1], self.rows[y][1]) for x, y in zip(i[wide].tolist(), j[wide].tolist(), strict=True)]
        return out

    def pairs(self) -> Iterator[tuple[str, str, int]]:
        """Both directions of the near pairs; where keys are unique to lists, only from the least list that both are posted in."""
        for i, j in self.candidates():
            use = self.near(i, j)
            for x, y in zip(i[use].tolist(), j[use].tolist(), strict=True):
                k, a, m, mine = self.rows[x]
                _, b, n, theirs = self.rows[y]
                if not self.unique or least_common(mine, theirs) == k:
                    yield a, b, n
                    yield b, a, m


def least_common(a: bytes, b: bytes) -> int:
    """The least of the numbers that two packed lists share."""
    size = len(a) // 8
    theirs = set(struct.unpack(f"<{len(b) // 8}q", b))
    return next(k for k in struct.unpack(f"<{size}q", a) if k in theirs)


def _merge(unique: bool):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Near words of the posting lists of a partition; its rows come sorted by key, and are worked on in whole lists."""
        held: list[tuple[int, str, int, bytes]] = []

        def told(rows: list[tuple[int, str, int, bytes]]) -> pa.RecordBatch:
            columns = list(zip(*Lists(rows, unique).pairs(), strict=True)) if rows else []
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns or [()] * 3, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["word", "near", "near_n"])

        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            if len(held) >= AT_ONCE:
                cut = len(held)
                while cut and held[cut - 1][0] == held[-1][0]:
                    cut -= 1
                if cut:
                    yield told(held[:cut])
                    held = held[cut:]
        yield told(held)

    return merge


def _ranks(words: DataFrame) -> dict[str, int]:
    """How often each of the most frequent grams stands."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = Counter(g for w in batch.column(0).to_pylist() for g in grams(w))
            yield pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["gram", "n"])

    told = words.select("word").mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r["gram"]: r["n"] for r in told.orderBy(F.desc("n"), "gram").limit(RANKED_GRAMS).collect()}


def near_words(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(word, near, near_n), both ways round, for all pairs of different words one edit apart; a pair may stand more than once.

    ``words``: (word, n), materialised, each word once, not null, of at least four
    letters (shorter ones need not share a gram).
    """
    spark = words.sparkSession
    ship(spark)
    rank = spark.sparkContext.broadcast(_ranks(words))

    def posted(c: int):
        def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    keys = sorted(postings(w, rank.value, c))
                    packed = struct.pack(f"<{len(keys)}q", *keys) if c == 1 else b""
                    rows += [(k, w, n, packed) for k in keys]
                columns = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.record_batch([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.binary()), strict=True)], names=["key", "word", "n", "keys"])

        return post

    found, left = None, words
    for c in range(1, MOST_GRAMS + 1):
        lists = left.select("word", "n").mapInArrow(posted(c), "key long, word string, n long, keys binary")
        hot = None
        if c < MOST_GRAMS:
            hot = materialize(lists.groupBy("key").count().filter(F.col("count") > crowd).select("key"), "crowded-postings")
            hot = None if hot.isEmpty() else hot
        some = lists
        if hot is not None:
            side = F.broadcast(hot) if small(hot) else hot
            some = lists.join(side, "key", "left_anti")
            left = materialize(lists.join(side, "key", "left_semi").select("word", "n").distinct(), "crowded-words")
        pairs = some.select("key", "word", "n", "keys").repartition("key").sortWithinPartitions("key").mapInArrow(_merge(c == 1), "word string, near string, near_n long")
        found = pairs if found is None else found.unionByName(pairs)
        if hot is None:
            break
    return found


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the forms of (word, form) end. A form has no way back, so each round doubles the steps taken."""
    at = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        at = materialize(at.join(ahead, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        if at.filter("moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")


def spelling_variants(counts: DataFrame, least_letters: int = 5, least_count: int = 3, ratio: int = 2, crowd: int = CROWD) -> DataFrame:
    """One row per word of (word, n) with ``least_letters`` code points and ``least_count`` occurrences or more.

    word, form, root, n, n_near, form_n. Near: exactly one inserted, deleted or
    replaced code point. form: the near word of largest n (ties: smallest in code-
    point order), if that is ``ratio`` times the word's own or more, else null. root:
    the word at the end of the chain of forms, itself if it has none. Null words are
    left out; a word on several rows counts with their sum. ``least_letters`` is at
    least 4, ``ratio`` at least 2. An empty table gives an empty result; further
    columns are not read.
    """
    if least_letters < 4 or ratio < 2:
        raise ValueError("least_letters must be at least 4 and ratio at least 2")
    words = counts.filter(F.char_length("word") >= least_letters).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)
    words = materialize(words, "words")
    pairs = near_words(words, crowd)
    best = pairs.groupBy("word").agg(F.count_distinct("near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("low"), "near")).alias("best"))
    held = words.join(best, "word", "left")
    takes = -F.col("best.low") >= ratio * F.col("n")
    held = held.select("word", F.when(takes, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, -F.col("best.low")).alias("form_n"))
    held = materialize(held, "forms")
    ends = roots(held.filter(F.col("form").isNotNull()))
    return held.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
