"""Scalar expressions against literal values."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wavecrate.functions import music, text, time
from wavecrate.params import CAMELOT


def values(spark, rows, schema, *columns):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
    return [tuple(r) if len(columns) > 1 else r[0] for r in df.select(*columns).collect()]


def test_camelot(spark):
    keys = ["8A", "8a", "12B", None, "", "13A", "0B", "Am"]
    got = values(spark, keys, "k string", music.camelot_number(F.col("k")), music.camelot_letter(F.col("k")))
    assert got == [(8, "A"), (8, "A"), (12, "B")] + [(None, None)] * 5
    assert len(CAMELOT) == 39 and CAMELOT["Ab Minor"] == "1A" and CAMELOT["E Major"] == "12B"
    assert values(spark, ["F# Minor", "H Minor", None], "k string", music.key_to_camelot(F.col("k"))) == ["11A", None, None]


def test_sim_key(spark):
    cases = {("8A", "8A"): 1.0, ("8A", "8B"): 0.9, ("8A", "9A"): 0.8, ("8A", "7A"): 0.8, ("12A", "1A"): 0.8, ("6A", "8A"): 0.5, ("11A", "1A"): 0.5, ("7B", "8A"): 0.4, ("12B", "1A"): 0.4, ("1A", "6A"): 0.0, ("1A", "x"): 0.0, (None, "1A"): 0.0}
    assert values(spark, list(cases), "a string, b string", music.sim_key(F.col("a"), F.col("b"))) == list(cases.values())


def test_tempo(spark):
    got = values(spark, [(128.0, 128.0), (128.0, 143.0), (128.0, 160.0), (130.0, 65.0)], "a double, b double", music.sim_bpm(F.col("a"), F.col("b")))
    assert got[:3] == [1.0, 0.0, 0.0] and 0.8 < got[3] <= 0.9
    assert values(spark, [(None, 128.0)], "a double, b double", music.bpm_factor(F.col("a"), F.col("b"))) == [0.3]
    assert values(spark, [64.0, 200.0, 130.0, None], "a double", music.fold_bpm(F.col("a"))) == [128.0, 100.0, 130.0, None]


def test_era_and_jaccard(spark):
    d = dt.date
    got = values(spark, [(d(2020, 1, 1), d(2021, 12, 31)), (d(2020, 1, 1), d(2030, 1, 1)), (d(2020, 1, 1), None)], "a date, b date", music.sim_era(F.col("a"), F.col("b")))
    assert got == [1.0, 0.0, 0.0]
    maps = [({1: 1.0, 2: 0.5}, {1: 0.5}), ({}, {}), ({1: 1.0}, {2: 1.0})]
    assert values(spark, maps, "a map<int,double>, b map<int,double>", music.weighted_jaccard(F.col("a"), F.col("b"))) == [pytest.approx(0.5 / 1.5), 0.0, 0.0]


def test_normalize(spark):
    rows = ["  Déjà Vu ft. X", "Don’t feat. Y", "aft.er", None]
    assert values(spark, rows, "t string", text.normalize(F.col("t"))) == ["déjà vu ft x", "don't feat y", "aft.er", ""]
    assert values(spark, ["ë"], "t string", text.normalize(F.col("t"), unicode=True)) == ["ë"]
    assert values(spark, [("A", None)], "t string, a string", text.normalized_key(F.col("t"), F.col("a"))) == ["a - "]


def test_folds(spark):
    assert values(spark, ["Béla", "東京", None, " N.E.R.D. "], "t string", text.ascii_fold(F.col("t"))) == ["bela", "", None, "n.e.r.d."]
    assert values(spark, ["st. germain", "cro-magnon", "fred again.."], "t string", text.punct_fold(F.col("t"))) == ["st germain", "cromagnon", "fred again"]


def test_artist_noise(spark):
    rows = {"Ioannis Siopis (GEMA)": "Ioannis Siopis", "Vinyl • Harvey Mason": "Harvey Mason", "Kapchiz (Sofa Beats)": "Kapchiz (Sofa Beats)", "X (4)": "X (4)", "(GEMA)": "(GEMA)", "AC/DC": "AC/DC"}
    assert values(spark, list(rows), "t string", text.strip_artist_noise(F.col("t"))) == list(rows.values())


def test_acronyms_and_stylized(spark):
    rows = {"N.E.R.D.": True, "L.I.L.Y": True, "A X L": True, "St. Germain": False, "Mr. Oizo": False, "": False, "Tomeka Reid Quartet": False}
    assert values(spark, list(rows), "t string", text.looks_acronym(F.col("t"))) == list(rows.values())
    assert values(spark, ["A X L", "Amy X", "t e s t press"], "t string", text.is_stylized(F.col("t"))) == [True, False, True]


def test_track_title(spark):
    rows = {"Song (feat. X)": "song", "Song feat. X (Club Mix)": "song feat. x (club mix)", "Song (Original Mix)": "song", "Song  ft. Y": "song", "Song (Bob Remix)": "song (bob remix)", None: ""}
    assert values(spark, list(rows), "t string", text.track_title(F.col("t"))) == list(rows.values())


def test_suffixes(spark):
    assert values(spark, ["A (Extended Mix)", "A (Remastered 2011)", "A (Bob Edit)", "A"], "t string", text.strip_safe_suffixes(F.col("t"))) == ["A", "A", None, None]
    rows = ["A (Extended Mix)", "A (Adam Port Edit)", "A [Remix]", "A", "A (Remix) (Bob Mix)"]
    assert values(spark, rows, "t string", text.strip_generic_parens(F.col("t"))) == ["A", None, "A", None, "A  (Bob Mix)"]
    assert values(spark, ["X feat. Y", "A & B, C", "solo", "A x B"], "t string", text.first_artist(F.col("t"))) == ["X", "A & B", None, "A"]


@pytest.mark.parametrize(
    ("raw", "channel", "expected"),
    [
        ("Boiler_Room - DJ X @Club | Live [12.03.2021]", "Boiler Room", ("dj x @ club - live", "dj x @ club - live", None, None, dt.date(2021, 3, 12))),
        ("Sunset Set Part 2", None, ("sunset set part 2", "sunset set", 2, None, None)),
        ("Sunset pt. IV", None, ("sunset pt. iv", "sunset", 4, None, None)),
        ("Marathon 2/3", None, ("marathon 2/3", "marathon", 2, 3, None)),
        ("Night 5/6/21", None, ("night 5/6/21", "night 5/6/21", None, None, None)),
        ("Night 9/3", None, ("night 9/3", "night 9/3", None, None, None)),
        ("Live (01.02.51) [4K]", None, ("live", "live", None, None, dt.date(1951, 2, 1))),
        ("Set - chan", "chan", ("set", "set", None, None, None)),
    ],
)
def test_set_title(spark, raw, channel, expected):
    [row] = values(spark, [(raw, channel)], "t string, c string", text.set_title(F.col("t"), F.col("c") if channel else None))
    assert tuple(row) == expected


def test_token_jaccard(spark):
    rows = {("a b c", "a b c"): 1.0, ("a", "b"): 0.0, ("a b c", "a b d"): 0.5, ("", ""): 1.0, ("a", ""): 0.0, ("a b", "a b c"): 2 / 3, ("A", "a"): 0.0}
    assert values(spark, list(rows), "a string, b string", text.token_jaccard(F.col("a"), F.col("b"))) == pytest.approx(list(rows.values()))


def test_artist_parts(spark):
    rows = {
        "A feat. B": ("local", [("A", "primary"), ("B", "featured")]),
        "A presents B": ("local", [("A", "primary"), ("B", "primary")]),
        "A, B": ("comma", [("A", "primary"), ("B", "primary")]),
        "A & B": ("ampersand", [("A", "primary"), ("B", "primary")]),
        "A|B": ("ampersand", [("A", "primary"), ("B", "primary")]),
        "A X L": ("single", [("A X L", "primary")]),
        "Amyl and the Sniffers": ("single", [("Amyl and the Sniffers", "primary")]),
        "Simon and Art": ("ampersand", [("Simon", "primary"), ("Art", "primary")]),
        "Solo": ("single", [("Solo", "primary")]),
    }
    got = values(spark, list(rows), "t string", text.artist_parts(F.col("t")))
    assert [(g["rule"], [(p["token"], p["role"]) for p in g["parts"]]) for g in got] == list(rows.values())


def test_search_and_relevance(spark):
    rows = ["House Music", "housemusic", "tech", None]
    assert values(spark, rows, "t string", text.search_match("house m", F.col("t"))) == [True, True, False, False]
    assert values(spark, ["bo", "Bolt", "abo"], "t string", text.relevance("BO", F.col("t"))) == [3, 2, 1]
    assert text.escape_like("50%_\\") == "50\\%\\_\\\\"
    assert values(spark, [("ID", "ID"), ("", "X"), ("Song", "X"), ("?", None), ("ID", "X")], "t string, a string", text.is_id_track(F.col("t"), F.col("a"))) == [True, True, False, True, False]


def test_times(spark):
    rows = {"01:02:03": 3_723_000, "1.00:00:00.5": 86_400_500, "00:00:01.1234567": 1_123, "": None, None: None, "x": None}
    assert values(spark, list(rows), "t string", time.timespan_ms(F.col("t"))) == list(rows.values())
    got = values(spark, ["2024-01-02T03:04:05Z", "0001-01-01T00:00:00", "bad", None], "t string", time.iso_date(F.col("t")))
    assert got == [dt.datetime(2024, 1, 2, 3, 4, 5), None, None, None]
    assert values(spark, [0.0, 5.0, 20.0, 100.0, None], "y double", time.release_freshness(F.col("y"))) == pytest.approx([1.0, 0.7, 0.5, 0.1, 1.0])
    assert values(spark, [(0, 0), (10, 8), (10, 7)], "t int, i int", time.set_unreliable(F.col("t"), F.col("i"), F.lit("u"), F.lit(True))) == [True, True, False]


def test_cadence(spark):
    now = dt.datetime(2024, 6, 1)
    ago = lambda d: now - dt.timedelta(days=d)
    rows = [(True, ago(100), None, ago(0.8)), (True, ago(100), None, ago(0.5)), (False, ago(30), None, ago(6)), (False, ago(30), None, ago(6.9)), (False, ago(90), None, ago(20)), (False, None, None, ago(0)), (False, ago(3), None, None)]
    got = values(spark, rows, "f boolean, c timestamp, n timestamp, k timestamp", time.crawl_decision(F.lit(now), F.col("f"), F.col("c"), F.col("n"), F.col("k")))
    assert got == ["crawl", "wait", "wait", "crawl", "wait", "crawl", "crawl"]
    rows = [(ago(91), None), (ago(40), ago(10)), (ago(40), ago(29.9)), (ago(3), ago(0.8)), (None, None)]
    got = values(spark, rows, "a timestamp, r timestamp", time.recrawl_decision(F.lit(now), F.col("a"), F.col("r")))
    assert got == ["final", "wait", "crawl", "crawl", "crawl"]
