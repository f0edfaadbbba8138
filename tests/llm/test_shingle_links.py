"""Near copies by true shingle similarity, and fingerprint links beyond two bits."""

from __future__ import annotations

import random

import numpy as np

import corpus_pipeline
from wavecrate.llm import shingle_links, simhash


def roots(texts):
    """Least id of each component of brute-force links at a five-word Jaccard similarity of 0.8."""
    sets = {}
    for d, t in texts:
        w = t.lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in sets}


def near_copies(seed=5, groups=12, words=150):
    r, out = random.Random(seed), []
    for g in range(groups):
        base = [f"w{r.randrange(3000)}" for _ in range(words)]
        for k in range(1 + 30 * (g == 0) + g % 4):  # a crowd, and groups of up to four
            w = list(base)
            for _ in range(r.randrange(4)):
                w[r.randrange(words)] = f"x{r.randrange(10**6)}"
            out.append((len(out), " ".join(w)))
    return out


def test_pipeline_stage_finds_all_similar_texts(spark):
    texts = near_copies()
    want = sorted(set(roots(texts).values()))
    assert len(want) < len(texts) - 25
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(texts, "doc_id long, text string"), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == want


def test_nulls_repeats_and_nothing(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A  b c d e f"), (None, "a b c d e f"), (3, None), (4, ""), (5, "other words stand here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in shingle_links.representatives(df).collect()) == [1, 3, 5]
    assert shingle_links.representatives(df.limit(0)).count() == 0


def test_fingerprint_of_a_set():
    r = random.Random(1)
    h = np.unique(np.array([r.getrandbits(64) for _ in range(9001)], dtype=np.uint64))
    want = sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h) > len(h))
    assert shingle_links.print_of(h) & (2**64 - 1) == want and shingle_links.print_of(h[:0]) == 0


def test_bitmaps_bound_the_difference():
    r = random.Random(2)
    for _ in range(200):
        pool = [r.getrandbits(64) for _ in range(r.randrange(1, 900))]
        a, b = ({x for x in pool if r.random() < 0.7} for _ in range(2))
        x, y = (shingle_links.bitmap(np.array(sorted(v), dtype=np.uint64)) for v in (a, b))
        assert sum(((int(u) ^ int(v)) & (2**64 - 1)).bit_count() for u, v in zip(x, y)) <= len(a ^ b)


def test_links_beyond_two_bits(spark):
    r = random.Random(3)
    base = r.getrandbits(64)
    prints = sorted({base ^ sum(1 << b for b in r.sample(range(64), k % 6)) for k in range(60)})
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    got = {tuple(e) for e in simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), bits=5).collect()}
    mask = 2**64 - 1
    assert got == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= 5}


def crowd(seed=8, texts=60, words=800, edits=11):
    """Texts of one origin, most pairs of them just below a similarity of 0.8."""
    r = random.Random(seed)
    base, out = [f"w{r.randrange(9000)}" for _ in range(words)], []
    for k in range(texts):
        w = list(base)
        for i in r.sample(range(0, words, 5), edits):
            w[i] = f"x{k}-{i}"
        out.append((k, " ".join(w)))
    return out


def work(spark, call):
    """The result of ``call``, the executions it took and the most rows that a kind of join put out."""
    store = spark._jsparkSession.sharedState().statusStore()
    bus = spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    seen = {e.executionId() for e in (store.executionsList().apply(i) for i in range(store.executionsList().size()))}
    out = call()
    bus.waitUntilEmpty()
    every = store.executionsList()
    new = [e for e in (every.apply(i).executionId() for i in range(every.size())) if e not in seen]
    rows = {}
    for e in new:
        values, nodes = store.executionMetrics(e), store.planGraph(e).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            for m in (node.metrics().apply(i) for i in range(node.metrics().size())):
                if "Join" in node.name() and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    rows[node.desc()] = rows.get(node.desc(), 0) + int(values.apply(m.accumulatorId()).replace(",", ""))
    return out, len(new), max(rows.values())


def test_a_crowd_below_the_bound_meets_once_a_pair(spark):
    texts = crowd()
    df = spark.createDataFrame(texts, "doc_id long, text string")
    told, executions, most = work(spark, lambda: shingle_links.similar_classes(df).collect())
    want = roots(texts)
    assert len(set(want.values())) > len(texts) // 4  # most are apart
    by = {}
    for r in told:
        by.setdefault(r["root"], set()).add(r["doc_id"])
    assert sorted(map(sorted, by.values())) == sorted(sorted(d for d in want if want[d] == x) for x in set(want.values()))
    # No join makes more rows than the texts have shingles; met at each shared shingle, the pairs made several times as many.
    assert most <= 800 * len(texts), most
    assert executions <= 40, executions
