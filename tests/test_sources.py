"""Formats, on small files."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from wavecrate.operators import embeddings
from wavecrate.sources import files, html, listing, playlists


def test_taxonomy(spark, tmp_path):
    (tmp_path / "n.csv").write_text("id,label\nQ1, House \nQ2,Techno\n")
    (tmp_path / "e.csv").write_text("from_id,to_id,type,source\nQ2,Q1,parent,w\nQ2,Q9,parent,w\n")
    nodes = files.taxonomy_nodes(spark, str(tmp_path / "n.csv"))
    good, bad = files.taxonomy_edges(spark, str(tmp_path / "e.csv"), nodes)
    assert [r["label"] for r in nodes.orderBy("id").collect()] == ["House", "Techno"]
    assert [r["to_id"] for r in good.collect()] == ["Q1"] and [r["to_id"] for r in bad.collect()] == ["Q9"]
    files.export_csv(good, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).columns == ["from_id", "to_id", "type", "source"]


def test_library_xml(spark, tmp_path):
    path = tmp_path / "lib.xml"
    path.write_text('<DJ_PLAYLISTS Version="1.0.0"><COLLECTION><TRACK TrackID="7" Name="A" Artist="" AverageBpm="128.50" TotalTime="300" DateAdded="2024-02-03"/><TRACK TrackID="x" Name="B"/><TRACK TrackID="8" Name=""/><TRACK TrackID="9" Name="C" AverageBpm="n/a" DateAdded="bad"/></COLLECTION></DJ_PLAYLISTS>')
    rows = {r["track_id"]: r for r in files.library_xml(spark, str(path)).collect()}
    assert set(rows) == {7, 9}
    assert (rows[7]["artist"], rows[7]["bpm"], rows[7]["duration_ms"], rows[7]["date_added"]) == (None, 128.5, 300_000, dt.date(2024, 2, 3))
    assert rows[9]["bpm"] is None and rows[9]["date_added"] is None
    assert files.is_library_xml(spark, str(path))


def _playlist(folder, pages):
    folder.mkdir(parents=True)
    for n, (tracks, nxt) in pages.items():
        (folder / f"page-{n}.json").write_text(json.dumps({"tracks": tracks, "next": nxt}))


def test_playlists(spark, tmp_path):
    spark.dataSource.register(playlists.Playlists)
    _playlist(tmp_path / "a" / "p1", {0: ([{"id": 1, "title": "x", "artist": "y"}], 1), 1: ([{"id": 2, "title": "z"}], None)})
    _playlist(tmp_path / "a" / "p2", {0: ([], None)})
    read = spark.read.format("playlists").option("source", "alpha").option("path", str(tmp_path / "a"))
    assert [(r["playlist"], r["position"], r["external_id"], r["artist"]) for r in read.load().orderBy("position").collect()] == [("p1", 0, "1", "y"), ("p1", 1, "2", None)]
    (tmp_path / "a" / "p1" / "page-1.json").unlink()
    with pytest.raises(Exception, match="page-1.json"):  # noqa: PT011
        read.load().collect()
    with pytest.raises(Exception, match="unknown playlist source"):  # noqa: PT011
        spark.read.format("playlists").option("source", "nope").option("path", str(tmp_path)).load().collect()


class Shown:
    """A listing that changes: entries by falling timestamp, so many a page."""

    def __init__(self, folder, size):
        self.folder, self.size, self.entries = folder, size, []

    def show(self, entries):
        self.entries = sorted(self.entries + entries, key=lambda e: (e["added_on"] or "~"), reverse=True)
        for old in self.folder.glob("page=*/*.json"):
            old.unlink()
        for n in range(0, len(self.entries), self.size):
            page = self.folder / f"page={n // self.size}"
            page.mkdir(parents=True, exist_ok=True)
            (page / "a.json").write_text("".join(json.dumps(e) + "\n" for e in self.entries[n : n + self.size]))

    def drop(self, ids):
        self.entries = [e for e in self.entries if e["id"] not in ids]
        self.show([])


def stamped(ids, day):
    """Entries of one day; every third shares its timestamp with the one before, and one has none."""
    return [{"id": i, "added_on": None if i % 50 == 33 else f"2024-01-{day:02d}T10:{(i - (i % 3 == 2)) % 60:02d}:00"} for i in ids]


def test_listing_is_resumed(spark, tmp_path):
    """A stream is stopped and resumed while entries are added on top and some that were taken go away."""
    spark.dataSource.register(listing.Listing)
    shown = Shown(tmp_path / "listing", 7)
    shown.show(stamped(range(40), 5) + stamped(range(100, 140), 6))
    stream = spark.readStream.format("newest_first").option("limit", 25).load(str(tmp_path / "listing"))

    def run():
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return [json.loads(r["entry"])["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()]

    first = run()
    assert 25 <= len(first) <= 26 and len(set(first)) == len(first) and min(first) >= 100
    shown.show(stamped(range(200, 210), 7))
    second = run()
    assert set(range(200, 210)) <= set(second) and 50 <= len(second) <= 52
    shown.drop(set(second[:20]))
    for _ in range(6):
        last = run()
    assert sorted(last) == sorted(e["id"] for e in stamped([*range(40), *range(100, 140), *range(200, 210)], 5) if e["added_on"])


def test_listing_positions(tmp_path):
    shown = Shown(tmp_path, 4)
    shown.show(stamped(range(30), 5))
    pages = listing.Pages(str(tmp_path), "added_on")
    reader = listing.ListingStreamReader(pages, 5)
    zero = reader.initialOffset()
    one = reader.latestOffset()
    assert one == reader.latestOffset() != zero  # the same until a batch moves the position
    taken = [e for part in reader.partitions(zero, one) for e in reader.read(part)]
    assert 5 <= len(taken) <= 6 and [t for t, _ in taken] == sorted((t for t, _ in taken), reverse=True)
    again = listing.ListingStreamReader(pages, 5)  # a restart: the position comes from the log
    assert again.partitions(one, one) == [] and again.latestOffset() == reader.latestOffset()
    parts = again.partitions(one, again.latestOffset())
    before = [e for part in parts for e in again.read(part)]
    shown.show(stamped(range(60, 71), 9))  # everything moves down three pages after the batch was planned
    assert [e for part in parts for e in again.read(part)] == before
    assert listing.resume_page(3, None, "x") == 0 and listing.resume_page(3, "a", "b") == 0 and listing.resume_page(3, "c", "b") == 3 and listing.resume_page(0, "c", "b") == 0
    assert listing.ListingStreamReader(listing.Pages(str(tmp_path / "none"), "added_on"), 5).latestOffset() == zero


def test_embedded_items(spark):
    state = lambda data: {"state": {"data": data}}
    body = {"props": {"pageProps": {"dehydratedState": {"queries": [state({"user": 1}), state({"releases": [{"id": i} for i in range(12)]}), state({"tracks": [{"id": 99}]})]}}}}
    page = f'<html><script id="__NEXT_DATA__" type="application/json">{json.dumps(body)}</script></html>'
    df = spark.createDataFrame([(1, page), (2, "<html></html>"), (3, None)], "page_id int, html string")
    rows = html.embedded_items(df).orderBy("pos").collect()
    assert len(rows) == 10 and json.loads(rows[0]["item"]) == {"id": 0}


def test_payloads(spark):
    a = json.dumps({"track_id": 1, "track_name": "t", "bpm": 128, "key_name": "A Minor", "label": {"label_name": "L"}, "genre": [{"genre_name": "G"}], "isrc": "X", "release_date": "2024-01-02T00:00"})
    b = json.dumps({"id": 2, "name": "u", "key": {"name": "B Major"}, "release": {"label": {"name": "M"}}, "genre": {"name": "H"}, "new_release_date": "bad"})
    rows = files.payload_rows(spark.createDataFrame([(a, "page"), (b, "api")], "payload string, shape string")).orderBy("id").collect()
    assert tuple(rows[0]) == ("1", "t", 128.0, "8A", "L", "G", "X", dt.date(2024, 1, 2))
    assert tuple(rows[1]) == ("2", "u", None, "1B", "M", "H", None, None)


def test_vectors(spark, tmp_path):
    texts = ["[1, 0.5,2e-1]", "1,2,3", "[1,2]", "", None, "[1,null,3]"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(embeddings.parsed(F.col("t"), 3)).collect()]
    assert got[0] == pytest.approx([1.0, 0.5, 0.2]) and got[1:] == [None] * 5
    (tmp_path / "v.csv").write_text('id,status,dim,emb\n1,ok,3,"[1,2,3]"\n2,error,,\n3,ok,2,"[1,2]"\n')
    assert [r["id"] for r in files.vectors_csv(spark, str(tmp_path / "v.csv"), 3).collect()] == [1]


def test_evaluation(spark):
    import random

    r = random.Random(0)
    rows = []
    for i in range(80):
        v = [r.gauss(0, 0.01) for _ in range(4)]
        v[i // 40] += 1
        rows.append((i, v, i // 40))
    df = spark.createDataFrame(rows, "id int, v array<double>, c int")
    near = embeddings.top_neighbours(df, df.select("id", "v"), 20)
    positives = df.select(F.col("id").alias("seed"), "c").join(df.select("id", "c"), "c").filter("id <> seed").select("seed", "id")
    real = {r["k"]: r for r in embeddings.lift(near, positives, 80).collect()}
    assert real[1]["lift"] > 1 and real[10]["hit_rate"] == 1.0
    shuffled = near.select("seed", ((F.col("id") * 37 + 11) % 80).alias("id"), "rank").filter("id <> seed")
    assert {r["k"]: r["lift"] for r in embeddings.lift(shuffled, positives, 80).collect()}[10] < real[10]["lift"]
