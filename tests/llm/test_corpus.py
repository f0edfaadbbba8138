"""Sharding, packing, language identification and the pipeline."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from wavecrate.llm import exact_dedup, langid, packing, rows, sharding, shingle_links, simhash
from wavecrate.llm.scratch import materialize

BPE = public_tokenizers.path("byte_bpe_50k.json")


# --- sharding -------------------------------------------------------------


def check_shards(out, corpus, shards):
    assert sorted((r["size"], r["text_crc32"]) for r in out) == sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t, *_ in corpus)
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r)
    assert set(by) <= set(range(shards))
    for rs in by.values():
        assert sorted(r["slot"] for r in rs) == list(range(len(rs)))
    return [sum(r["size"] for r in rs) for rs in by.values()]


def test_shards(docs, corpus, none):
    check_shards(sharding.kd_shards(docs, shards=5).collect(), corpus, 5)
    assert sharding.kd_shards(none, shards=5).count() == 0
    assert {r["shard"] for r in sharding.kd_shards(docs, shards=1).collect()} == {0}


def test_shards_are_near_equal(spark):
    r = random.Random(4)
    corpus = [(i, "x" * r.randint(1, 400), "en" if i % 3 else "fr", "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(3000)]
    corpus += [(9000 + i, "same text", "en", "hot") for i in range(1000)]
    df = spark.createDataFrame(corpus, "doc_id long, text string, lang string, source string")
    sizes = check_shards(sharding.kd_shards(df, shards=24).collect(), corpus, 24)
    assert len(sizes) == 24 and max(sizes) - min(sizes) <= 2 * 408
    target = sum(sizes) // 10
    assert len({x["shard"] for x in sharding.kd_shards(df, target_bytes=target).collect()}) == 11


def test_shards_of_one_value(spark):
    df = spark.createDataFrame([(i, "abc") for i in range(200)], "doc_id long, text string")
    out = sharding.kd_shards(df, shards=8, dims={"none": F.lit(None).cast("long")}).collect()
    assert max(Counter(r["shard"] for r in out).values()) - min(Counter(r["shard"] for r in out).values()) <= 2


def test_written_shards_have_every_row(spark, tmp_path):
    rows_ = [(1, "a", "x", 7), (1, "a", "y", 8), (1, "a", "y", 8), (2, None, "z", None), (None, "", "z", 1), (3, "b" * 500, "z", 2)]
    df = spark.createDataFrame(rows_, "doc_id long, text string, __row_key string, Shard int")
    sharding.write_shards(df, str(tmp_path / "out"), shards=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(repr, map(tuple, back.select(*df.columns).collect()))) == sorted(map(repr, rows_)) and "shard_" in back.columns


def test_clashing_names_stay(spark):
    df = spark.createDataFrame([(1, "a b", "mine", 5), (2, "a  b", "yours", 6), (2, "a  b", "yours", 6)], "doc_id long, text string, __Row_Key string, digest int")
    for kept in (exact_dedup.unique_rows(df), simhash.representatives(df), shingle_links.representatives(df)):
        assert kept.columns == df.columns and kept.collect()[0]["__Row_Key"] in ("mine", "yours") and kept.count() == 1


def test_numbering(spark):
    df = materialize(spark.createDataFrame([("hot" if i % 3 else "cold", i % 500) for i in range(2000)], "g string, k int"), "t")
    sizes = materialize(df.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "t")
    out = rows.numbered(df, "g", ["k"], "nth", sizes, bucket_rows=50).collect()
    for g in ("hot", "cold"):
        nth = sorted(r["nth"] for r in out if r["g"] == g)
        assert nth == list(range(len(nth)))


# --- packing --------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(BPE)


def test_ids_agree(tokenizer):
    fast = packing.Ids(BPE)
    r = random.Random(1)
    texts = ["", " ", "a" * 3000, "it's  2²½ x y\n\n z", "<|endoftext|>", "a <|endoftext|> b", " <|endoftext|><|endoftext|>\n", "<|endoftext| >", "日本語 тест ß🎧", " " * 9000 + "x", "\r\n\t "]
    texts += ["".join(r.choice("ab '’1½²_.-\n\t é日🎧  \x1c") for _ in range(80)) for _ in range(400)]
    for t in texts:
        assert fast(t).tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 1], repr(t)


def check_packing(out, corpus, tokenizer, window):
    want = Counter()
    for d, t, *_ in corpus:
        want[d, len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1] += 1
    ids = {(d, (t or "")): np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4") for d, t, *_ in corpus}
    cover, lines = Counter(), {}
    sums = {}
    for (d, _), v in ids.items():
        sums.setdefault((d, len(v)), []).append(v)
    for p in out:
        assert 0 < p["length"] <= window
        assert p["ids_crc32"] in {zlib.crc32(v[p["start"] : p["start"] + p["length"]].tobytes()) for v in sums[p["doc_id"], p["doc_tokens"]]}
        cover[p["doc_id"], p["doc_tokens"]] += p["length"]
        lines.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert cover == Counter({k: k[1] * n for k, n in want.items()})
    for line in lines.values():
        at = 0
        for offset, length in sorted(line):
            assert offset == at
            at += length
        assert at <= window
    return lines


@pytest.mark.parametrize("window", [64, 128, 2048])
def test_packing(docs, corpus, none, tokenizer, window):
    lines = check_packing(packing.pack(docs, BPE, window=window).collect(), corpus, tokenizer, window)
    short = sorted(sum(n for _, n in line) for line in lines.values() if sum(n for _, n in line) < window)
    if window == 2048:
        assert all(s > window - packing.GRID for s in short[1:])
    assert packing.pack(none, BPE, window=window).count() == 0


@pytest.mark.parametrize("shape", ["even", "few", "one", "ones", "two"])
def test_plan_places_everything(shape):
    r = np.random.default_rng(2)
    h = np.zeros(2048, dtype=np.int64)
    h[:] = {"even": r.integers(0, 300, 2048), "few": r.integers(0, 2, 2048), "one": 0, "ones": 0, "two": 0}[shape]
    if shape == "one":
        h[1500] = 5000
    if shape == "ones":
        h[1] = 5000
    if shape == "two":
        h[1025], h[1030] = 3000, 7
    h[0] = 0
    placed, sequences = packing.plan(h)
    seen = {}
    used = np.zeros(sequences, dtype=np.int64)
    for p in placed:
        for nth in range(p.lo, p.hi):
            seen.setdefault((p.rem, nth), []).append((p.start, p.length))
        per = np.bincount(np.arange(p.hi - p.lo) // p.per) * p.length
        used[p.sequence : p.sequence + len(per)] += per
    for (rem, _), parts in seen.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == rem
    assert len(seen) == h.sum() and used.max() <= 2048 and used.sum() == (h * np.arange(2048)).sum()
    assert used.sum() >= 0.95 * (sequences - 1) * 2048


def test_least_squares_share():
    """Most of a rich histogram is packed by the solved counts, not by the greedy rest."""
    h = np.full(2048, 500)
    h[0] = 0
    counts = packing.repeats(h, packing.combinations(2048))
    assert counts.sum() * 2048 > 0.8 * (h * np.arange(2048)).sum()


# --- language -------------------------------------------------------------

WORDS = {"aa": ["tor", "mella", "sunt", "viro", "cana", "domus"], "bb": ["gruk", "zlat", "vrzk", "prst", "hlav", "dny"], "cc": ["ooku", "nani", "mitsu", "kawa", "hoshi", "yama"]}


@pytest.fixture
def labelled(spark):
    r = random.Random(6)
    data = [(i, " ".join(r.choice(WORDS[k]) + r.choice(["", "a", "u"]) for _ in range(r.randint(3, 40))), k) for i in range(400) for k in [r.choice("abc") * 2]]
    data += [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 !! ²½", "cc"), (1003, "tor mella", None), (None, "gruk zlat", "bb"), (1004, "tor " * 20_000, "aa"), (1005, "x" * 100_000, None)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string")


def test_languages(labelled):
    out = {r["doc_id"]: r for r in langid.identify(labelled).collect()}
    truth = {r["doc_id"]: r["lang"] for r in labelled.collect()}
    held = [d for d, r in out.items() if r["held_out"] and d < 1000]
    assert all(out[d]["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d in out if d is not None) and not out[None]["held_out"]
    assert len(held) > 60 and sum(out[d]["lang_pred"] == truth[d] for d in held) / len(held) > 0.99
    assert [out[d]["lang_pred"] for d in (1000, 1001, 1002)] == ["und"] * 3 and out[1003]["lang_pred"] == "aa" and out[None]["lang_pred"] == "bb" and out[1004]["lang_pred"] == "aa"
    assert all(0 <= r["score"] <= 1 for r in out.values())
    kept = {r["doc_id"] for r in langid.accepted_rows(labelled).collect()}
    assert {d for d in out if d is not None and d < 1000} <= kept and not kept & {1000, 1001, 1002, 1005}


def test_nothing_to_learn(labelled):
    blank = labelled.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.identify(blank).collect()} == {"und"}
    assert langid.accepted_rows(blank).count() == labelled.count() and langid.identify(labelled.limit(0)).count() == 0


def test_model_is_a_distribution():
    """Over all next characters, seen or not, the interpolated probabilities of a context add up to about 1."""
    model = langid.fit({k: Counter(v) for k, v in WORDS.items()}, order=3)
    alphabet = sorted({c for v in WORDS.values() for w in v for c in w})
    scores, n = model.score(["t" + c for c in alphabet] + ["t"])
    whole, m = model.score(["t"])
    assert n[-1] == 2 and scores.shape == (len(alphabet) + 1, 3) and np.isfinite(scores).all()
    codes, at, _ = langid._padded(["t" + c for c in alphabet] + ["t"], 3)
    grams = langid._hashes(codes, 3)
    # the probability of what follows "t": second character of each word, or the end
    total = np.zeros(3)
    for i in range(len(alphabet) + 1):
        place = at[n[:i].sum() + 1 : n[:i].sum() + 2]
        p, open_ = np.zeros((1, 3)), place
        for k in (3, 2, 1):
            seen, row = langid._find(model.keys[k - 1], grams[k - 1][open_])
            if seen[0]:
                p += model.logp[k - 1][row]
                break
            known, row = langid._find(model.contexts[k - 1], langid._context(grams, k, open_))
            if known[0]:
                p += model.weights[k - 1][row]
            if k == 1:
                p += -np.log(len(model.keys[0]) + 1)
        total += np.exp(p[0])
    assert total == pytest.approx(np.ones(3), abs=0.12)


def test_bounds_come_from_unseen_rows(spark):
    """Unseen clean documents of a rare language pass, a foreign one doesn't, and other languages' sizes change nothing."""
    r = random.Random(9)
    letters = {"aa": "abcdefgh", "bb": "ijklmnop"}

    def text(k):
        return " ".join("".join(r.choice(letters[k]) for _ in range(r.randint(4, 9))) for _ in range(r.randint(8, 30)))

    data = [(i, text("aa"), "aa") for i in range(60)] + [(1000 + i, text("bb"), "bb") for i in range(300)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    fresh = spark.createDataFrame([(5000 + i, text("aa"), None) for i in range(200)] + [(6000, "qrstu vwxyz " * 20, None)], "doc_id long, text string, lang string")
    small = langid.train(df, sample=400, calibration=100)
    big = langid.train(df, sample=60, calibration=40)  # now only aa is rare
    for model in (small, big):
        out = {x["doc_id"]: x["rejected"] for x in langid.identify(fresh, model=model).collect()}
        assert out.pop(6000) and not any(out.values())
    assert all(sum(small.bounds[k]) == pytest.approx(sum(big.bounds[k]), abs=0.6) for k in letters)


# --- pipeline -------------------------------------------------------------


def test_pipeline(spark, tmp_path, corpus, tokenizer):
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi")]
    data = [(d, t, "en", "s", len(t or "")) for d, t, *_ in corpus if d is not None] + [(700 + i, f"start {i} {items[0][1]} end", "en", "s", 1) for i in range(3)]
    folder = str(tmp_path / "in")
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, kept = [n for n, _ in corpus_pipeline.STAGES], {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, folder), name)
        kept[name] = docs
    assert names == ["language_id", "exact_dedup", "near_dedup", "decontamination", "packing"]
    assert all(kept[n].columns == ["doc_id", "text", "lang", "source", "n_chars"] for n in names[:-1])
    # Plain version of every stage, on the rows that the stage before kept.
    have = [(d, t) for d, t, *_ in data if t and any(c.isalpha() for c in t)]
    assert sorted((r["doc_id"], r["text"]) for r in kept["language_id"].collect()) == sorted(have)
    best = {}
    for d, t in have:
        k = t.translate(str.maketrans("", "", exact_dedup.BLANKS))
        best[k] = min(best.get(k, (1, 0, "")), (-len(t), d, t))
    have = [(d, t) for _, d, t in best.values()]
    assert sorted((r["doc_id"], r["text"]) for r in kept["exact_dedup"].collect()) == sorted(have)
    prints = [(d, simhash.fingerprint(t.encode())) for d, t in have]
    groups = {d: d for d, _ in prints}

    def find(x):
        while groups[x] != x:
            x = groups[x]
        return x

    for i, (a, p) in enumerate(prints):
        for b, q in prints[i + 1 :]:
            if (p ^ q).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                groups[y] = x
    have = [(d, t) for d, t in have if find(d) == d]
    assert sorted((r["doc_id"], r["text"]) for r in kept["near_dedup"].collect()) == sorted(have)
    have = [(d, t) for d, t in have if items[0][1] not in t]
    assert sorted((r["doc_id"], r["text"]) for r in kept["decontamination"].collect()) == sorted(have)
    check_packing(kept["packing"].collect(), have, tokenizer, 2048)
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == sorted(map(tuple, kept["packing"].collect()))
