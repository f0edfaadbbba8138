"""Plan builders against plain versions, and table transitions."""

from __future__ import annotations

import random
from bisect import bisect_left, bisect_right
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavecrate.plans import band_join as band_join_module
from wavecrate.plans import cooc, merge
from wavecrate.plans.band_join import band_join
from wavecrate.plans.closure import ancestors, ancestors_sql
from wavecrate.plans.cooc import overlapping, pair_counts, seed_counts
from wavecrate.plans.quantiles import exact_percentiles
from wavecrate.plans.ranking import global_rank
from wavecrate.plans.text_joins import containment_join, token_join
from wavecrate.plans.topk import one_per_album, top_k
from wavecrate.plans.visibility import preferred_bpm, visible


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_band_join(spark):
    r = random.Random(5)
    data = [(i, None if i % 9 == 0 else float(r.randint(50, 220))) for i in range(80)]
    df = spark.createDataFrame(data, "id int, bpm double")
    got = rows(band_join(df, df, "bpm", 16.0, (1.0, 0.5, 2.0)), "l.id", "r.id")
    want = sorted((a, b) for a, x in data for b, y in data if x is not None and y is not None and min(abs(y - x), abs(y - x * 0.5), abs(y - x * 2)) <= 16)
    assert got == want


def test_band_join_deals_a_common_value(spark):
    """A third of all rows at one tempo: the cells, and so the tasks, have about as many pairs to look at."""
    r = random.Random(6)
    data = [(i, 128.0 if i % 3 == 0 else round(r.uniform(60, 200), 2)) for i in range(6000)]
    df = spark.createDataFrame(data, "id int, bpm double")
    for cells in (1, 24):
        got = band_join(df, df, "bpm", 0.5, cells=cells)
        counts = Counter(x for _, x in data)
        values = sorted(counts)
        want = sum(counts[a] * counts[b] for a in values for b in values[bisect_left(values, a - 0.5) : bisect_right(values, a + 0.5)])
        assert got.count() == want
    bounds = band_join_module._bounds(df, "bpm", 256)
    side = lambda name: band_join_module._range(df, F.col("bpm"), bounds, "range")
    grid = band_join_module._grid(side("l"), side("r"), 16 * 8)
    ranges = Counter(row["range"] for row in side("l").collect())
    cells_ = [(k, i, j, ranges[k] ** 2 / (a * b)) for k, (a, b) in grid.items() for i in range(a) for j in range(b)]
    task = F.pmod(F.hash("range", "i", "j"), F.lit(8))  # as a shuffle to 8 tasks deals them
    work = sorted(r["w"] for r in spark.createDataFrame(cells_, "range int, i int, j int, w double").groupBy(task).agg(F.sum("w").alias("w")).collect())
    assert max(ranges.values()) >= 2000 and len(work) == 8 and work[-1] <= 2 * work[4]
    empty = df.limit(0)
    assert band_join(empty, df, "bpm", 1.0).count() == band_join(df, empty, "bpm", 1.0).count() == 0


def test_overlapping(spark):
    r = random.Random(9)
    data = [(g, i) for i in range(60) for g in {r.randrange(25) for _ in range(r.randint(1, 9))} | {99}] + [(None, 1), (3, None)]
    held = {i: {g for g, j in data if j == i and g is not None} for i in range(60)}
    df = spark.createDataFrame(data + data[:50], "g int, x int")
    for least in (1, 2, 3):
        want = sorted((a, b, len(held[a] & held[b])) for a in held for b in held if a < b and len(held[a] & held[b]) >= least)
        assert rows(overlapping(df, "g", "x", least)) == want


def test_overlapping_leaves_the_common_group_out(spark):
    """One item in every set: twice the sets give twice the candidates, not four times."""
    made = []
    for n in (400, 800):
        df = spark.range(n).select(F.col("id").alias("x"), F.explode(F.array(F.lit(-1), F.lit(-2), F.col("id"), F.floor(F.col("id") / 2) + 10**6, F.floor(F.col("id") / 2) + 2 * 10**6)).alias("g"))
        assert overlapping(df, "g", "x", 3).count() == n // 2
        posted = cooc._posted(cooc._lists(df, "g", "x", 3), "g", "x", 3).groupBy("g").count()
        made.append(posted.agg(F.sum(F.col("count") * F.col("count"))).first()[0])
    assert made[1] == 2 * made[0]


def test_exact_percentiles(spark):
    r = random.Random(3)
    data = [(k, v) for k in ("a", "b", None) for v in [r.choice([1.0, 2.5, r.uniform(-5, 5)]) for _ in range(r.randint(1, 400))] + [None]]
    data += [("ties", 7.0)] * 500 + [("one", 3.0), ("none", None)] + [("wide", float(10**k)) for k in range(-20, 20)]
    df = spark.createDataFrame(data, "k string, v double")
    at = [0.0, 0.05, 0.5, 0.9, 1.0]
    for enough in (5, 2000):
        got = {(row["k"], row["at"]): row["value"] for row in exact_percentiles(df, ["k"], "v", at, bins=4, enough=enough).collect()}
        want = {(k, q): float(np.percentile([v for key, v in data if key == k and v is not None], 100 * q)) for k in ("a", "b", None, "ties", "one", "wide") for q in at}
        assert got == pytest.approx(want)
    whole = exact_percentiles(df, [], "v", [0.5], bins=8, enough=20).collect()
    assert [x["value"] for x in whole] == pytest.approx([float(np.percentile([v for _, v in data if v is not None], 50))])
    assert exact_percentiles(df.limit(0), ["k"], "v", at).count() == 0


def test_exact_percentiles_of_counted_values(spark):
    """Rows that stand for billions: sums of weights, never a row for each."""
    r = random.Random(8)
    data = [(r.choice("ab"), float(r.randrange(300)) / 4, r.randint(1, 5)) for _ in range(400)]
    df = spark.createDataFrame(data, "k string, v double, n long")
    at = [0.0, 0.25, 0.5, 0.9, 1.0]
    for enough in (3, 2000):
        got = {(row["k"], row["at"]): row["value"] for row in exact_percentiles(df, ["k"], "v", at, bins=8, enough=enough, weight="n").collect()}
        want = {(k, q): float(np.percentile([v for key, v, n in data if key == k for _ in range(n)], 100 * q)) for k in "ab" for q in at}
        assert got == pytest.approx(want)
    many = spark.createDataFrame([(1.0, 3 * 10**10), (2.0, 10**10), (5.0, 10**10)], "v double, n long")
    assert rows(exact_percentiles(many, [], "v", [0.25, 0.7, 0.9], weight="n"), "at", "value") == [(0.25, 1.0), (0.7, 2.0), (0.9, 5.0)]


def test_containment_by_the_rarest_gram(spark):
    """All names begin alike, so their beginnings tell nothing; no key makes most of the candidates."""
    titles = spark.createDataFrame([(i, f"the band {i:03d} live, the best of the {i % 7}") for i in range(300)] + [(900, "Nob"), (901, "xx")], "id int, title string")
    names = spark.createDataFrame([(f"the band {i:03d}",) for i in range(100)] + [("never seen here",), ("NOB",)], "name string")
    told: dict = {}
    got = rows(containment_join(titles, names, "title", "name", told), "id", "name")
    assert got == [(i, f"the band {i:03d}") for i in range(100)] + [(900, "NOB")]
    assert told["candidates"] <= 3000 and told["largest_share"] <= 0.2


def test_closure_ends_in_cycles(spark):
    nodes = spark.createDataFrame([(i, str(i)) for i in range(1, 6)], "id int, label string")
    edges = spark.createDataFrame([(1, 2, "parent"), (2, 3, "parent"), (3, 1, "parent"), (1, 3, "parent"), (4, 1, "influence")], "child_id int, parent_id int, type string")
    got = rows(ancestors(nodes, edges))
    assert got == rows(ancestors_sql(spark, nodes, edges))
    assert (1, 3, 1) in got and (1, 2, 1) in got and (4, 4, 0) in got and not any(r[0] == 4 and r[1] != 4 for r in got)


def test_recursive_closure_beyond_a_million_paths(spark):
    """Half a million leaves under a chain: 1.5 million paths, while Spark's recursion ends at a million rows."""
    nodes = spark.range(500_000).select("id", F.col("id").cast("string").alias("label"))
    edges = spark.range(1, 500_000).select(F.col("id").alias("child_id"), F.when(F.col("id") < 4, F.col("id") - 1).otherwise(F.col("id") % 4).alias("parent_id"), F.lit("parent").alias("type"))
    got = {r["depth"]: r["count"] for r in ancestors_sql(spark, nodes, edges).groupBy("depth").count().collect()}
    want = {r["depth"]: r["count"] for r in ancestors(nodes, edges).groupBy("depth").count().collect()}
    assert got == want and sum(got.values()) > 10**6


def test_recursive_closure_in_parts(spark):
    r = random.Random(4)
    nodes = spark.createDataFrame([(i, str(i)) for i in range(40)], "id int, label string")
    edges = spark.createDataFrame([(r.randrange(60), r.randrange(45), r.choice(["parent", "parent", "influence"])) for _ in range(70)], "child_id int, parent_id int, type string")
    for depth in (1, 10):
        assert rows(ancestors_sql(spark, nodes, edges, depth, starts=20)) == rows(ancestors(nodes, edges, depth))


def test_cooccurrence(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "a"), (2, "b"), (2, "c"), (3, None)], "g int, x string")
    assert rows(pair_counts(df, "g", "x")) == [("a", "b", 2), ("a", "c", 1), ("b", "c", 1)]
    seeds = spark.createDataFrame([("a",)], "seed string")
    assert rows(seed_counts(df, seeds, "g", "x")) == [("a", "b", 2), ("a", "c", 1)]


def test_global_rank(spark):
    r = random.Random(2)
    data = [(i, round(r.random(), 2)) for i in range(500)]
    got = {i: n for i, _, n in rows(global_rank(spark.createDataFrame(data, "id int, s double"), "s", "id", buckets=8))}
    assert [i for i, _ in sorted(data, key=lambda t: (-t[1], t[0]))] == sorted(got, key=got.get) and sorted(got.values()) == list(range(1, 501))


def test_top_k_and_albums(spark):
    df = spark.createDataFrame([("g", 1, 9.0, 7), ("g", 2, 8.0, 7), ("g", 3, 7.0, None), ("g", 4, 6.0, None), ("h", 5, 1.0, 7)], "g string, id int, s double, album int")
    ranked = top_k(df, ["g"], [F.desc("s")], 10)
    assert rows(one_per_album(ranked, ["g"], "album", "id", "rank", 2, 5), "g", "id", "place") == [("g", 1, 1), ("g", 3, 2), ("h", 5, 1)]


def test_text_joins(spark):
    titles = spark.createDataFrame([(1, "Live_with Bob Sol at X"), (2, "Nobody"), (3, None)], "id int, title string")
    names = spark.createDataFrame([("bob sol",), ("Nob",), ("X",), (None,)], "name string")
    assert rows(containment_join(titles, names, "title", "name"), "id", "name") == [(1, "bob sol"), (2, "Nob")]
    r = random.Random(4)
    data = [(i, [r.choice("abcdef") for _ in range(r.randint(1, 6))]) for i in range(60)]
    got = rows(token_join(spark.createDataFrame(data, "id int, t array<string>"), "id", "t", 0.6), "a", "b")
    assert got == [(a, b) for a, x in data for b, y in data if a < b and len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.6]


def test_visibility(spark):
    catalog = spark.createDataFrame([(1, "shared", None), (2, "private", 7), (3, "private", 8), (4, "private", 9)], "id long, scope string, owner_id long")
    library = spark.createDataFrame([(7, 3), (7, 3), (8, 4)], "user_id long, catalog_id long")
    assert rows(visible(catalog, library, 7), "id", "in_lib") == [(1, False), (2, False), (3, True)]
    assert rows(visible(catalog, library, None), "id") == [(1,)]
    df = spark.createDataFrame([(0.0, 120.0), (None, 121.0), (99.0, 1.0)], "rb_bpm double, bpm double")
    assert [r[0] for r in df.select(preferred_bpm()).collect()] == [0.0, 121.0, 99.0]
    assert [r[0] for r in df.select(preferred_bpm(zero_is_value=False)).collect()] == [120.0, 121.0, 99.0]


def test_writes(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "id int, name string, node string")
    new = spark.createDataFrame([(2, "B", "y"), (3, "c", None)], "id int, name string, node string")
    assert rows(merge.upsert(old, new, ["id"]), "id", "name") == [(1, "a"), (2, "B"), (3, "c")]
    assert rows(merge.upsert(old, new, ["id"], keep=["node"]).filter("id = 2"), "node") == [("x",)]
    assert rows(merge.insert_missing(old, new.union(new), ["id"], [F.col("name")]), "id") == [(3,)]
    claims = spark.createDataFrame([(1, "x"), (1, "z")], "id int, node string")
    assert rows(merge.fill_unique(old, claims, "id", "node"), "id", "node") == [(1, "z"), (2, "x")]
    mapping = spark.createDataFrame([(2, 1)], "loser int, canonical int")
    links = spark.createDataFrame([(1, 10), (2, 10), (2, 11)], "id int, k int")
    assert rows(merge.repoint(links, mapping, "id", ["id", "k"])) == [(1, 10), (1, 11)]
    assert rows(merge.replace_children(links, spark.createDataFrame([(2, 99)], "id int, k int"), "id")) == [(1, 10), (2, 99)]
    assert rows(merge.not_done(old, new, "id"), "id") == [(1,)]


def test_lifecycle(spark):
    d = "cast('2020-01-01' as date)"
    state = spark.sql(f"select 1 as p, 'a' as t, {d} as detected_at, cast(null as date) as removed_at union all select 1, 'b', {d}, {d} union all select 1, 'c', {d}, null union all select 2, 'a', {d}, null")
    crawl = spark.createDataFrame([(1, "a"), (1, "b"), (1, "n")], "p int, t string")
    got = {(r["p"], r["t"]): (r["change"], r["removed_at"] is not None) for r in merge.lifecycle(state, crawl, ["p", "t"], "p", F.lit("2021-01-01").cast("date")).collect()}
    assert got == {(1, "a"): ("kept", False), (1, "b"): ("restored", False), (1, "c"): ("removed", True), (1, "n"): ("inserted", False), (2, "a"): ("kept", False)}


def test_containment_never_sends_the_texts(spark, tmp_path):
    """Texts come from a file that is small while their grams are not: what is broadcast holds no grams of texts."""
    spark.range(3000).select("id", F.concat(F.lit("a title of band "), F.col("id").cast("string")).alias("title")).write.parquet(f"{tmp_path}/texts")
    names = spark.createDataFrame([("Band 17",), ("band 2999",)], "name string")
    got = containment_join(spark.read.parquet(f"{tmp_path}/texts"), names, "title", "name")
    lines = got._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :|+-*()0123456789"))
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = [x for x in lines[i + 1 :]]
            under = below[: next((j for j, x in enumerate(below) if depth(x) <= depth(line)), len(below))]
            assert not any("Generate" in x for x in under)
    assert got.filter("name = 'band 2999'").count() == 1 and got.count() == 1 + 11 + 100
