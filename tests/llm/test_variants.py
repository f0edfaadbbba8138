"""Spelling variants, against all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wavecrate.llm import queries, variants


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    long, short = max(a, b, key=len), min(a, b, key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plainly(counts: dict[str, int], least_letters=5, least_count=3) -> list[tuple]:
    words = {w: n for w, n in counts.items() if len(w) >= least_letters and n >= least_count}
    by = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, others in by.items():
        best = min(others, key=lambda x: (-words[x], [ord(c) for c in x]), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n, len(by[w]), words.get(form[w], 0)) for w, n in words.items())


def told(df) -> list[tuple]:
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


def some_words(r: random.Random, letters: str, n: int) -> dict[str, int]:
    out = {}
    for _ in range(n):
        word = "".join(r.choice(letters) for _ in range(r.randint(4, 12)))
        for _ in range(r.randint(1, 4)):
            out[word] = r.randint(1, 60)
            at = r.randrange(len(word))
            word = r.choice([word[:at] + word[at + 1 :], word[:at] + r.choice(letters) + word[at:], word[:at] + r.choice(letters) + word[at + 1 :]]) or word
    return out


@pytest.mark.parametrize("crowd", [variants.CROWD, 6, 2])
def test_all_pairs(spark, crowd):
    """Also where posting lists are crowded, so that more grams make their keys."""
    r = random.Random(crowd)
    counts = some_words(r, "abcdefgh", 250) | some_words(r, "abé", 120) | {"a" * k: 4 * k for k in range(4, 60)} | {"aaaab" * k: 9 for k in range(1, 9)}
    rows = [(w, n, "x") for w, n in counts.items()] + [(None, 99, "x")]
    df = spark.createDataFrame(rows, "word string, n long, near string").repartition(3)
    assert told(variants.spelling_variants(df, crowd=crowd)) == plainly(counts)


@settings(max_examples=400, deadline=None)
@given(st.text("ab", min_size=4, max_size=9), st.integers(0, 10), st.sampled_from(["", "a", "b", "c"]), st.booleans(), st.sampled_from([1, 2, 3]))
def test_near_words_share_a_key(word, at, letter, insert, c):
    other = word[:at] + letter + word[at + (not insert) :]
    if len(other) >= 4 and one_edit(word, other):
        assert variants.near(word, other) and variants.near(other, word)
        for rank in ({}, {"aba": 5, "bab": 3}):
            assert variants.postings(word, rank, c) & variants.postings(other, rank, c)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abé", min_size=4, max_size=8), max_size=12), st.booleans())
def test_pairs_of_a_list(words, long):
    words = [w * 7 if long and i % 3 == 0 else w for i, w in enumerate(sorted(words))]
    words = sorted(set(words) | ({words[0] + "a", "b" + words[0]} if words else set()))
    rows = [(k, w, 1, b"") for k in (1, 2) for w in words]
    want = sorted((a, b) for a in words for b in words if one_edit(a, b))
    got = sorted((a, b) for a, b, _ in variants.Lists(rows, False).pairs()) if rows else []
    assert got == sorted(want * 2)


def test_chains_of_forms(spark):
    counts = {"aaaaa" + "bcdefghijklmnopqrst"[:k]: 3 << (19 - k) for k in range(20)}
    assert told(variants.spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long"))) == plainly(counts)


def test_query(spark, corpus, tmp_path):
    r = random.Random(2)
    words = list(some_words(r, "abcÀÿ×deF", 60))
    rows = [row[:2] for row in corpus] + [(1000 + i, " ".join(r.choices(words, k=60)) + r.choice(["", "5", "_x", "ĀB"])) for i in range(80)]
    spark.createDataFrame([(*row, 1, "s") for row in rows], "doc_id long, text string, n int, word string").write.parquet(f"{tmp_path}/documents.parquet")
    counts: Counter[str] = Counter()
    for ident, text in rows:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in word)
            h = zlib.crc32(f"{ident}:{word}".encode())
            if ident is not None and h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    got = queries.op13_spelling_variants(spark, str(tmp_path))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plainly(counts)
    assert told(got) == want and any(w[1] for w in want)


def test_empty(spark, none):
    assert variants.spelling_variants(variants.word_counts(none)).count() == 0
    rows = [(1, None), (2, ""), (3, "12 _ 3")]
    assert variants.word_counts(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        variants.spelling_variants(variants.word_counts(none), least_letters=3)
