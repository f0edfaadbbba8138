"""Runs of words, against every period tried at every place."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from wavecrate.llm import queries, runs


def brute(words: list, least: int) -> list[tuple[int, int, int]]:
    """(start, end, period): longest stretches for each period, the smallest period of each."""
    found: dict[tuple[int, int], int] = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - s >= q:
                found.setdefault((s, i + q), q)
            i += 1
    return sorted(((s, t, q) for (s, t), q in found.items() if t - s >= least), key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=50), max_size=4), st.sampled_from([2, 3, 6, 12]))
def test_all_runs(texts, least):
    texts = [[b"%d" % w for w in words] for words in texts]
    assert [sorted(own, key=lambda r: (r[0], r[2])) for own in runs.runs_of(texts, least)] == [brute(words, least) for words in texts]


def test_runs_inside_copied_blocks():
    r = random.Random(5)
    inner = [b"%d" % r.randrange(50) for _ in range(9)]
    block = [b"%d" % r.randrange(500) for _ in range(40)] + inner * 3 + [b"%d" % r.randrange(500) for _ in range(40)]
    words = block + [b"x"] + block + [b"y"] + block * 2
    assert runs.runs_of([words], 12)[0] == brute(words, 12)


def test_long_texts_take_little_time():
    assert runs.runs_of([[b"a"] * 300_000], 12) == [[(0, 300_000, 1)]]
    r = random.Random(1)
    words = [b"%d" % r.randrange(3000) for _ in range(30_000)]
    words = words[:7000] + words[7000:16_000] * 3
    assert runs.runs_of([words], 12) == [[(7000, len(words), 9000)]]


def plainly(doc_id, text):
    """A row of the query, by its rules."""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words, 12)
    gone = {i for s, t, q in found for i in range(s + q, t)}
    best = min(((s - t, s, q) for s, t, q in found), default=None)
    sums = ["".join(f"{s},{t - s},{q}\n" for s, t, q in found), " ".join(w for i, w in enumerate(words) if i not in gone)]
    longest = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *longest, *(hashlib.sha256(x.encode()).hexdigest() for x in sums))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query(spark, docs, corpus, tmp_path):
    r = random.Random(8)
    rows = [row[:2] for row in corpus]
    rows += [(1000 + i, " ".join(r.choice("abc") for _ in range(r.randint(0, 40)))) for i in range(300)]
    rows += [(1400 + i, "   ".join(r.choice(["é", "ü", "x\x1cy"]) for _ in range(30))) for i in range(20)]
    spark.createDataFrame([(*row, "s", 3, [1]) for row in rows], "doc_id long, text string, runs string, collapsed int, words array<int>").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_lpf_word_runs(spark, str(tmp_path))
    assert got.columns == COLUMNS
    key = lambda row: tuple((x is not None, x) for x in row)
    assert sorted((tuple(x) for x in got.collect()), key=key) == sorted((plainly(*row) for row in rows), key=key)


def test_operator(spark, none):
    assert runs.periodic_runs(none).count() == 0 and runs.digests(runs.periodic_runs(none)).count() == 0
    rows = [(1, "a b " * 4 + "c"), (1, "a b " * 4 + "c"), (2, None), (3, ""), (4, " \n")]
    got = runs.periodic_runs(spark.createDataFrame(rows, "id long, words string"), 4, "id", "words").drop("row_key").collect()
    assert [tuple(x) for x in got] == [(1, [(0, 8, 2)], "a b c"), (1, [(0, 8, 2)], "a b c"), (2, [], ""), (3, [], ""), (4, [], "")]
