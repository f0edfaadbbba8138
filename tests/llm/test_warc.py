"""Archives: what is read back, the bytes that are written, and what happens to broken ones."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random
from pathlib import Path

import pytest

from wavecrate.llm import queries, warc

SCHEMA = "page_id long, url string, html string, shard string, own int, payload string"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "s", 1, "p") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    out = [(i, f"https://{r.choice('abc')}.example.org/{i % 40}?q=é {i}", f"<p>{'x' * r.randint(0, 300)}é</p>") for i in range(150)]
    out += [(200 + i, f"http://a.example.org/{i}", "<p>copy</p>") for i in range(60)]
    out += [(300, "http://x/1", None), (301, "http://x/2", ""), (None, "http://x/3", ""), (None, None, "<p>alone</p>"), (302, None, "<p>no address</p>"), (303, "", "")]
    out += [(304, "http://x/\r\nInjected: 1", "long " * 30_000), (305, "http://x/5", "twice"), (305, "http://x/5", "twice"), (305, "http://x/6", "twice"), (None, "http://x/7", "nobody"), (None, "http://x/7", "nobody")]
    return out


def plainly(rows, least=0):
    """(page_id, bytes, digest, type, refers_to) by the rules."""
    groups: dict[bytes, list] = {}
    for i, _, html in rows:
        groups.setdefault((html or "").encode(), []).append(i)
    out = []
    for data, ids in groups.items():
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        ids = sorted(ids, key=lambda i: (i is not None, i))
        for k, i in enumerate(ids):
            first = k == len(ids) - 1 or len(data) < least
            out.append((i, len(data), digest, "response" if first else "revisit", None if first else ids[-1]))
    return sorted(out, key=str)


def told(df):
    return sorted(map(tuple, df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def contents(folder: Path) -> dict[str, bytes]:
    return {p.name: p.read_bytes() for p in folder.glob("*.warc.gz")}


def test_round_trip_and_bytes(spark, rows, tmp_path):
    """The same rows dealt otherwise give the same bytes; small files roll; no temporary file stays."""
    pages = pages_of(spark, rows)
    for name, dealt in (("a", pages.repartition(1)), ("b", pages.repartition(7, "html"))):
        warc.write_archive(dealt, f"{tmp_path}/{name}", least_shards=5, roll_bytes=3000)
    a, b = contents(tmp_path / "a"), contents(tmp_path / "b")
    assert a == b and len(a) > 5 and not (tmp_path / "a" / "_temporary").exists() and not (tmp_path / "a" / "_manifest").exists()
    back = warc.read_archive(spark, f"{tmp_path}/a", payloads=True)
    assert told(back) == plainly(rows)
    payloads = {r.payload.decode() for r in back.filter("record_type = 'response'").collect()}
    assert payloads == {html or "" for _, _, html in rows}
    assert back.select("record_id").distinct().count() == len(rows)
    texts = [gzip.decompress(x).decode() for x in a.values()]
    assert all(t.startswith("WARC/1.1\r\nWARC-Type: warcinfo\r\n") for t in texts) and not any("\nInjected" in t for t in texts)
    order = [line for name in sorted(a) for line in gzip.decompress(a[name]).decode().split("\r\n") if line.startswith("WARC-Target-URI: http")]
    assert [x.split("//")[1].split("/")[0] for x in order] == sorted(x.split("//")[1].split("/")[0] for x in order)


def test_least_revisit_bytes(spark, rows, tmp_path):
    out = warc.write_archive(pages_of(spark, rows), f"{tmp_path}/w", least_revisit_bytes=8)
    assert told(warc.read_archive(spark, out)) == plainly(rows, 8)


def test_a_broken_file_is_told(spark, rows, tmp_path):
    warc.write_archive(pages_of(spark, rows), f"{tmp_path}/w", least_shards=2)
    path = sorted((tmp_path / "w").glob("*.warc.gz"))[0]
    records = list(warc.members(iter([path.read_bytes()])))
    path.write_bytes(b"".join(warc.member(r.replace(b"xx", b"xy", 1)) for r in records))
    with pytest.raises(Exception, match="digest"):
        warc.read_archive(spark, f"{tmp_path}/w").count()


def test_empty(spark, tmp_path):
    warc.write_archive(pages_of(spark, []), f"{tmp_path}/w")
    assert warc.read_archive(spark, f"{tmp_path}/w").count() == 0 and not contents(tmp_path / "w")


def test_query(spark, rows, tmp_path):
    pages_of(spark, rows).write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op11_sharded_warc(spark, str(tmp_path))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] and told(got) == plainly(rows)
