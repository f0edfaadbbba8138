"""Artists, enrichment, sets and evaluation on small cases."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wavecrate.operators import artists as A
from wavecrate.operators import backlog, embeddings, library, sets
from wavecrate.operators import enrichment as R
from wavecrate.streaming.deadletter import latest, split_batches


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def test_clusters(spark):
    data = [
        (1, "St. Germain", "10", 0), (2, "St Germain", None, 0),
        (3, "N.E.R.D.", "11", 0), (4, "NERD", None, 0),
        (5, "Mr. Oizo", None, 0), (6, "Mr Oizo", None, 0),
        (7, "Cro-Magnon", "12", 50_000), (8, "Cromagnon", "13", 100),
        (9, "Fred again..", "14", 0), (10, "Fred Again", "NOT_FOUND", 0),
        (11, "東京", None, 0), (12, "大阪", None, 0), (13, "Alone", "15", 0),
    ]
    df = spark.createDataFrame(data, "id long, name string, deezer_id string, fans long")
    got = {r["key"]: (r["decision"], r["reason"], r["canonical"]) for r in A.clusters(df).collect()}
    assert got == {"st germain": ("merge", "one_linked_nulls", 1), "nerd": ("flag", "acronym", None), "mr oizo": ("flag", "no_linked", None), "cromagnon": ("flag", "multi_linked", None), "fred again": ("flag", "one_linked_mixed", None)}
    with_fans = {r["key"]: (r["reason"], r["canonical"]) for r in A.clusters(df, fans=True).collect()}
    assert with_fans["cromagnon"] == ("fan_dominant", 7)


def test_orphans_and_hits(spark):
    df = spark.createDataFrame([(1, "Béla", "10"), (2, "Bela", None), (3, "Zoé", "11"), (4, "Zoe", "12"), (5, "zoe", None), (6, "東京", None)], "id long, name string, deezer_id string")
    assert rows(A.orphans(df)) == [(2, 1)]
    hits = spark.createDataFrame([(2, 100, "BELA", 5, 1), (2, 101, "Béla", 900, 2), (2, 102, "Be.la", 10, 3), (2, 103, "B-ela", 2000, 4), (2, 104, "Other", 9999, 5), (6, 105, "大阪", 9, 1), (6, 106, "東京", 1, 2)], "artist_id long, hit_id long, hit_name string, fans long, seq int")
    assert rows(A.hits_ranked(df, hits), "artist_id", "hit_id", "how", "rank") == [(2, 100, "exact", 3), (2, 101, "accent", 2), (2, 103, "punct", 1), (6, 106, "exact", 1)]


def test_link_or_merge(spark):
    ranked = spark.createDataFrame([(1, 100, 1), (1, 101, 2), (2, 101, 1), (3, 100, 1)], "artist_id long, hit_id long, rank int")
    held = spark.createDataFrame([(100, 50)], "hit_id long, holder long")
    assert rows(A.link_or_merge(ranked, held)) == [(1, "link", 101, None), (2, "merge", 101, 1), (3, "merge", 100, 50)]


def test_disambiguation(spark):
    data = [("a, b", "comma", False, 2, 2), ("a, c", "comma", True, 1, 2), ("a & b", "ampersand", True, 1, 2), ("c & d", "ampersand", False, 2, 2), ("e & f", "ampersand", True, 2, 2), ("g & h", "ampersand", False, 0, 2)]
    df = spark.createDataFrame(data, "raw string, rule string, full boolean, found int, tokens int")
    assert [r["outcome"] for r in A.disambiguate(df).collect()] == ["split", "flag", "duo", "split", "flag", "flag"]


def test_resync(spark):
    catalog = spark.createDataFrame([(1, "Ann, Bob"), (2, "Ann, Old"), (3, "Stale"), (4, "Ann & Bob"), (5, " ")], "id long, artist string")
    links = spark.createDataFrame([(i, a, p) for i in range(1, 6) for a, p in ((10, 0), (11, None))], "catalog_id long, artist_id long, position int")
    artists = spark.createDataFrame([(10, "Ann"), (11, "Bob")], "id long, name string")
    assert rows(A.resync(catalog, links, artists), "id", "outcome") == [(1, "coherent"), (2, "ambiguous"), (3, "resync"), (4, "resync")]


def test_names(spark):
    artists = spark.createDataFrame([(1, "boysnoize"), (2, "Harvey (GEMA)"), (3, "Harvey"), (4, "two words")], "id long, name string")
    catalog = spark.createDataFrame([("Boys Noize",), ("Boys Noize",), ("BOYS NOIZE",), ("HARVEY",)], "artist string")
    assert rows(A.slug_names(artists, catalog)) == [(1, "boysnoize", "Boys Noize")]
    assert rows(A.cleaned_names(artists)) == [(2, "Harvey (GEMA)", "Harvey", 3)]
    assert rows(A.aliases(catalog, artists)) == [(3, "HARVEY")]
    titles = spark.createDataFrame([("Live - Boys Noize @ X", "boysnoize"), ("nothing", "some-one")], "t string, s string")
    assert [r[0] for r in titles.select(A.name_from_title(F.col("t"), F.col("s"))).collect()] == ["Boys Noize", "Some One"]
    payload = spark.createDataFrame([(1, [(7, "Main"), (8, "Featured"), (7, "Featured")])], "catalog_id long, contributors array<struct<id:long,role:string>>")
    assert rows(A.contributors(payload)) == [(1, 7, "primary", 0), (1, 8, "featured", 1)]


def test_hits_name_the_recording(spark):
    data = [
        ("A", "x", "t", "A", "y", "u", True), ("A", "x", "t", "B", "x", "t", False),
        (None, "Béla", "Song (Original Mix)", None, "Bela & Co", "Song", True), (None, "Ann", "Song (Bob Remix)", None, "Ann", "Song - Bob Remix", True),
        (None, "Ann", "Song (Bob Remix)", None, "Ann", "Song", False), (None, None, "Song", None, "Who", "Song", True), (None, "Ann", "Song", None, None, "Song", False), (None, "Ann", None, None, "Ann", None, False),
    ]
    df = spark.createDataFrame(data, "isrc string, artist string, title string, hit_isrc string, hit_artist string, hit_title string, want boolean")
    assert all(r["ok"] == r["want"] for r in R.hit_matches(df).collect())
    assert R.queries_of(F.lit("T (Extended Mix)"), F.lit("A")) is not None


def test_suspects(spark):
    cl = spark.createDataFrame([("p", 1, 1), ("p", 2, 2), ("q", 3, 3), ("q", 4, 3)], "pid string, id long, cluster long")
    bad = R.suspect_ids(cl, "pid")
    assert rows(bad, "id") == [(1,), (2,)]
    catalog = spark.createDataFrame([(1, "p", 120.0, "beatport", 2, True), (3, "q", 121.0, "beatport", 1, True), (2, "p", 99.0, "own", 1, True)], "id long, deezer_id string, bpm double, bpm_source string, attempts int, has_preview boolean")
    assert rows(R.reset_suspects(catalog, bad), "id", "deezer_id", "bpm", "attempts", "has_preview") == [(1, None, None, 0, False), (2, None, 99.0, 0, False), (3, "q", 121.0, 1, True)]


def test_releases_and_news(spark):
    albums = spark.createDataFrame([(1, 5, "2024-05-20", [f"t{i}" for i in range(60)]), (1, 6, "bad", ["x"]), (1, 7, "2023-01-01", ["y"]), (1, 8, "2024-07-01", ["z"])], "artist_id long, album_id long, released string, tracks array<string>")
    done = spark.createDataFrame([(1, "t3")], "artist_id long, track string")
    out = R.expand_releases(albums, done, F.lit(dt.date(2024, 6, 1)))
    assert out.count() == 39 and {r["album_id"] for r in out.collect()} == {5}
    activity = spark.createDataFrame([(1, dt.datetime(2024, 6, 1, 10)), (1, dt.datetime(2024, 5, 1)), (2, dt.datetime(2024, 6, 1, 10))], "artist_id long, at timestamp")
    followed = spark.createDataFrame([(1,), (1,)], "artist_id long")
    assert R.followed_news(activity, followed, F.lit(dt.datetime(2024, 6, 2))).count() == 1


def test_part_groups(spark):
    d = dt.date
    s = [(1, 7, "x part 1", "x", 1, None, d(2024, 1, 1)), (2, 7, "x part 2", "x", 2, None, d(2024, 1, 2)), (3, 8, "x part 1", "x", 1, None, None), (4, 7, "y part 1", "y", 1, None, None), (5, 7, "y part 1", "y", 1, None, None), (6, 7, "z part 1", "z", 1, 2, None), (7, 7, "z part 2", "z", 2, 2, None)]
    df = spark.createDataFrame(s, "id long, channel long, title string, base_title string, part int, total int, played_date date")
    members = spark.createDataFrame([(1, m) for m in range(10)] + [(2, m) for m in range(20, 30)] + [(6, m) for m in range(10)] + [(7, m) for m in range(4)], "set_id long, mtid long")
    got = {r["base_title"]: (r["members"], r["kind"], round(r["confidence"], 4)) for r in sets.part_groups(df, members).collect()}
    assert got == {"x": (2, "part_candidate", 0.53), "z": (2, "part_overlap_anomaly", 0.58)}


def test_rescoring(spark):
    flags = spark.createDataFrame([(1, 2, 0.9, "pending"), (3, 4, 0.9, "pending"), (5, 6, 0.9, "accepted")], "a long, b long, confidence double, status string")
    pairs = spark.createDataFrame([(1, 2, 0.5, "flag"), (3, 4, 0.1, "nothing")], "a long, b long, confidence double, verdict string")
    assert rows(sets.rescored(flags, pairs)) == [(1, 2, 0.5, "pending"), (3, 4, 0.1, "rejected"), (5, 6, 0.9, "accepted")]
    assert rows(sets.new_flags(spark.createDataFrame([(2, 1, 0.5, "flag"), (1, 2, 0.6, "flag"), (3, 4, 0.5, "flag")], "a long, b long, confidence double, verdict string"), flags.filter("a = 3"))) == [(1, 2, 0.6)]


def test_exclusions_and_intervals(spark):
    features = spark.createDataFrame([(1, "a", "L", None, None, "t"), (2, "a", "M", 1, None, "u"), (3, "b", "L", 1, "X", "t"), (4, "c", None, None, None, None)], "id int, artist string, label string, album int, isrc string, title_key string")
    positives = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (2, 3)], "seed int, id int")
    assert rows(embeddings.excluded(positives, features, "cross_artist")) == [(1, 3), (1, 4), (2, 3)]
    assert rows(embeddings.excluded(positives, features, "cross_label")) == [(1, 4), (2, 3)]
    assert rows(embeddings.excluded(positives, features, "cross_release")) == [(1, 4)]
    v = spark.range(500).select("id", (F.col("id") % 10).cast("double").alias("v"), (F.col("id") % 2).alias("s"))
    (row,) = embeddings.bootstrap(v, "id", "v").collect()
    # The interval of a mean of 500 values with a standard deviation of 2.87.
    assert row["n"] == 500 and row["mean"] == 4.5 and row["high"] - row["low"] == pytest.approx(2 * 1.96 * 2.872 / 500**0.5, rel=0.15) and row["low"] < 4.5 < row["high"]
    two = embeddings.bootstrap(v, "id", "v", ["s"], 200).orderBy("s").collect()
    assert [(x["s"], x["n"], x["mean"]) for x in two] == [(0, 250, 4.0), (1, 250, 5.0)] and all(x["low"] < x["mean"] < x["high"] for x in two)
    p = embeddings.permuted(v, "id").collect()
    assert sorted(x["id"] for x in p) == sorted(x["as_id"] for x in p) == list(range(500)) and sum(x["id"] == x["as_id"] for x in p) < 20
    a = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.5)], "seed int, id int, score double")
    b = spark.createDataFrame([(1, 2, 0.1), (1, 3, 0.5)], "seed int, id int, score double")
    assert rows(embeddings.fused([a, b])) == [(1, 2, 3), (1, 3, 3)]


def test_folders_and_outcomes(spark):
    tags = [(["TO_SORT", "Nu-Disco"], "W - Nu Disco"), (["House", "SoundCloud"], "x"), (["House"], "x"), (["TO_DO"], "x")]
    df = spark.createDataFrame(tags, "t array<string>, f string")
    assert [r[0] for r in df.select(library.relocation(F.col("t"), F.col("f"))).collect()] == [None, "_IMPORT", "W - House", None]
    cases = spark.createDataFrame([(None, 0.5, 2), (0.5, 0.6, 2), (0.5, 0.5, 2), (0.5, 1.0, 0), (0.5, 0.4, None)], "o double, n double, s int")
    got = [tuple(r[0]) for r in cases.select(backlog.outcome(F.col("o"), F.col("n"), F.col("s"))).collect()]
    assert got == [(0, None), (0, None), (3, "stale"), (0, "complete"), (1, None)]


def test_dead_letters(spark, tmp_path):
    kept = []
    run = split_batches(lambda df: kept.append(df.count()), str(tmp_path), F.col("x") > 0)
    run(spark.createDataFrame([(1,), (2,), (-1,), (-2,), (-3,), (None,)], "x int"), 7)
    letters = spark.read.json(str(tmp_path))
    assert kept == [2] and letters.count() == 4
    assert [r["x"] for r in latest(letters, "x", "batch", keep=2).collect()] == [-1, -2]


@pytest.mark.parametrize(("confidence", "want"), [(2.0, 120.0), (1.9, None)])
def test_verdict(spark, confidence, want):
    assert spark.range(1).select(backlog.verdict(F.lit(None).cast("double"), F.lit(120.0), F.lit(confidence))).first()[0] == want
