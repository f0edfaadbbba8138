"""Exact, near and substring dedup against brute force."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wavecrate.llm import exact_dedup, simhash, substring_dedup
from wavecrate.llm.components import connected_components
from wavecrate.llm.queries import ORACLE_SQL

BLANKS = str.maketrans("", "", " \t\n\x0b\f\r")


def groups(corpus):
    out = {}
    for i, (d, t, *_) in enumerate(corpus):
        out.setdefault((t or "").translate(BLANKS), []).append((-(len(t or "")), d is None, d or 0, i))
    return out


@pytest.mark.parametrize("digest", [None, lambda c: F.length(c), lambda c: F.lit("same")])
def test_exact(docs, corpus, digest):
    rows = exact_dedup.exact_dedup(docs, digest=digest).collect()
    assert len(rows) == len(corpus)
    want = {}
    for members in groups(corpus).values():
        keep = corpus[min(members)[3]][0]
        for *_, i in members:
            want.setdefault(corpus[i][0], []).append((keep, len(members)))
    for r in rows:
        assert (r["keep_id"], r["group_size"]) in want[r["doc_id"]]
    assert sum(r["kept"] for r in rows) == len(groups(corpus))


def test_exact_hot_groups_are_dealt(spark):
    """Repeated rows without an id, half of the table, reach many tasks and one of them stays."""
    rows = [(None, "same text")] * 2000 + [(i, f"text {i}") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = exact_dedup.exact_dedup(df).collect()
    assert len(out) == 4000 and sum(r["kept"] for r in out) == 2001 and sum(r["group_size"] == 2000 for r in out) == 2000


def test_exact_rows(docs, corpus, none):
    kept = exact_dedup.unique_rows(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups(corpus))
    assert exact_dedup.exact_dedup(none).count() == 0 and exact_dedup.unique_rows(none).count() == 0


def test_exact_oracle(spark, docs, corpus):
    some = [(d, t) for d, t, *_ in corpus if d is not None]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [s for i, s in enumerate(some) if s not in some[:i]])
    want = sorted(con.execute(ORACLE_SQL["op4_exact_dedup"]).fetchall())
    df = spark.createDataFrame([s for i, s in enumerate(some) if s not in some[:i]], "doc_id long, text string")
    assert sorted(tuple(r) for r in exact_dedup.exact_dedup(df).drop("row_key").collect()) == want


def plain_print(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").translate(str.maketrans("\t\n\x0b\f\r", "     ")).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """Least reachable id of each (id, print), ids None last."""
    unique = sorted({p for _, p in prints})
    root = {p: p for p in unique}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(unique):
        for b in unique[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(b)] = find(a)
    least = {}
    for d, p in prints:
        if d is not None:
            least[find(p)] = min(least.get(find(p), d), d)
    return [(d, p, least.get(find(p))) for d, p in prints]


def test_near(docs, corpus, none):
    rows = simhash.near_duplicates(docs).collect()
    want = components([(d, plain_print(t)) for d, t, *_ in corpus])
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted([(r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in rows], key=key) == sorted(want, key=key)
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns and kept.count() == len({r["root"] for r in rows})
    assert simhash.representatives(none).count() == 0


def test_fingerprint_matches_engine_hash(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b ç"))).first()[0] & (2**64 - 1) == xxhash.xxh64_intdigest("a b ç".encode(), 42)
    assert simhash.fingerprint("A  b".encode()) == xxhash.xxh64_intdigest(b"a b", 42)


@pytest.mark.parametrize("bucket", [2, 16, 10_000])
def test_links_lose_nothing(spark, bucket):
    r = random.Random(3)
    prints = set()
    for _ in range(30):  # crowds of close fingerprints around centres
        c = r.getrandbits(64)
        prints |= {c} | {c ^ (1 << r.randrange(64)) for _ in range(20)} | {c ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(20)}
    prints = sorted(prints)
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    edges = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), bucket=bucket)
    pairs = [(a & (2**64 - 1), b & (2**64 - 1)) for a, b in edges.collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in pairs)
    want = {}
    for d, p, c in components(list(enumerate(prints))):
        want[p] = c
    got = {p: i for i, p in enumerate(prints)}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(got[a], got[b])
            changed |= got[a] != low or got[b] != low
            got[a] = got[b] = low
    assert got == want


def test_ring_covers_all_patterns(spark):
    flips = [0] + [1 << i for i in range(64)] + [(1 << i) | (1 << j) for i in range(64) for j in range(i)]
    signed = np.array(flips, dtype=np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(0, s) for s in signed], "fp long, fp2 long")
    diff = F.col("fp").bitwiseXOR(F.col("fp2"))
    ok = F.lit(False)
    for k, (a, b) in enumerate(zip(simhash.ring_keys(F.col("fp"), 3), simhash.ring_keys(F.col("fp2"), 3))):
        ok = ok | ((a == b) & simhash.within_ring(diff, F.lit(k // 2), 3, 2))
    assert df.filter(ok).count() == len(flips)


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100)] + [(500, 500 + i) for i in range(1, 80)] + [(7, 7), (900, 901), (901, 900)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(101)}, **{500 + i: 500 for i in range(80)}, 900: 900, 901: 900}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_spans(spark, docs, corpus, none, monkeypatch):
    passage = "Every second thing was blue that day, and nobody had a word for it. They went on all the same, until the road ended. Then it rained for three whole days."
    rows = [(d, t) for d, t, *_ in corpus] + [(1000 + i, f"Intro number {i} stands here. {passage} And then something else {i * 7}.") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in substring_dedup.repeated_spans(df).collect()}
    places = {}
    for d, t in rows:
        for a, n, h in substring_dedup.spans(substring_dedup.sentences(t or ""), 2, 20):
            places.setdefault(h, set()).add((d is None, d or 0, a, n, d))  # a repeated row stands where the first does
    covered = {}
    for p in places.values():
        for *_, a, n, d in sorted(p)[1:]:
            covered.setdefault(d, set()).update(range(a, a + n))
    told = {d: r["n_removed"] for d, r in got.items()}
    assert told.pop(None, 0) > 0  # the copy without an id
    covered.pop(None, None)
    assert told == {d: len(c) for d, c in covered.items()}
    assert 1000 not in got and all(passage not in got[1000 + i]["text"] and f"Intro number {i}" in got[1000 + i]["text"] for i in range(1, 5))
    assert substring_dedup.repeated_spans(none).count() == 0
    for hot, small in ((1, "hot covered"), (1, ""), (10**6, "hot covered")):
        monkeypatch.setattr(substring_dedup, "HOT", hot)
        monkeypatch.setattr(substring_dedup, "small", lambda df, small=small: any(f"/{x}-" in df.inputFiles()[0] for x in small.split()))
        assert {r["doc_id"]: (r["n_removed"], r["removed"]) for r in substring_dedup.repeated_spans(df).collect()} == {d: (r["n_removed"], r["removed"]) for d, r in got.items()}


def test_removed_spans_are_what_went():
    text = "One here now. Two\nthree, four! Five."
    left, gone = substring_dedup.remove(text, {1, 3})
    assert left == "".join(c for i, c in enumerate(text) if not any(a <= i < b for a, b in gone)) and "Two" not in left and "Five" not in left


def test_passages_amid_long_sentences(spark):
    """A passage stands mid-sentence at different offsets; of later copies all but a piece at each edge goes."""
    r = random.Random(12)
    passage = [f"p{r.randrange(10**6)}" for _ in range(120)]
    rows = []
    for k in range(24):
        lead, tail = ([f"u{k}x{r.randrange(10**6)}" for _ in range(n)] for n in (3 + k, 5 + k % 7))
        rows.append((k, " ".join(["Start", *lead, *passage, *tail]) + "."))
    got = {x["doc_id"]: x["text"].split() for x in substring_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == set(range(1, 24))
    assert all(sum(w in passage for w in got[k]) <= 30 and sum(w.startswith("u") for w in got[k]) >= k for k in got)


def test_cuts_follow_their_rule():
    """Against the rule said word by word, over words with few and many equal hashes."""
    r = random.Random(9)
    for _ in range(300):
        long = [[f"w{r.randrange(r.choice((2, 9, 1000)))}" for _ in range(r.randrange(17, 200))] for _ in range(r.randrange(1, 4))]
        expected = []
        for parts in long:
            h = [xxhash.xxh32_intdigest(w) for w in parts]
            ends = [0]
            for i in range(len(h) - 1):
                if i + 1 - ends[-1] >= substring_dedup.CAP or (all(x > h[i] for x in h[max(0, i - 4) : i]) and all(x >= h[i] for x in h[i : i + 5])):
                    ends.append(i + 1)
            expected.append([*ends[1:], len(h)])
        assert substring_dedup.cuts(long) == expected


def test_rows_of_one_id_keep_the_first_place(spark):
    """Two texts of one id share a passage: it stays where it begins earlier; within a row the first of two copies stays."""
    passage = "Every second thing was blue that day, and nobody had a word for it. They went on all the same, until the road ended."
    rows = [(1, f"A start of a text. Then some. {passage}"), (1, f"A start. {passage}"), (2, f"{passage} Well, so much for that. {passage}"), (2, None)]
    got = sorted((x["doc_id"], x["text"]) for x in substring_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, "A start of a text. Then some. "), (2, "Well, so much for that. ")]
    alone = substring_dedup.repeated_spans(spark.createDataFrame(rows[2:], "doc_id long, text string")).collect()
    assert [x["text"] for x in alone] == [f"{passage} Well, so much for that. "]


def test_spans_reach_every_sentence_end():
    parts = substring_dedup.sentences(" ".join(f"One two three four five six seven eight nine {i}." for i in range(7)) + " End of it.")
    assert {a + n for a, n, _ in substring_dedup.spans(parts, 2, 20)} >= set(range(2, len(parts) + 1))


def test_long_sentences_lose_no_word():
    r = random.Random(2)
    for words in (["same"] * 500, [r.choice("abcde") for _ in range(300)], [str(r.random()) for _ in range(300)]):
        parts = substring_dedup.sentences(" ".join(words))
        assert " ".join(p[2] for p in parts) == " ".join(words) and max(p[3] for p in parts) <= substring_dedup.CAP
