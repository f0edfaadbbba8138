"""WARC archives: a deterministic sharded writer, and a reader that checks what it reads.

The same rows give the same files, byte for byte, whatever the cluster:

* Of equal payloads one record is a response, the others revisit it. Winners are
  combined per digest and salt, then per digest, without the payloads.
* Records are range-sorted by address and id. The ranges end at byte-weighted
  quantiles of a sample of the keys that a hash of the key draws; Spark's own range
  partitioner draws another sample each time. A payload is shuffled once: what kind
  of record it becomes goes to its shard as a row of its own, sorted before it.
* Each shard is written in order, a gzip member for each record without time or
  name, and rolls to the next file when it has ``roll_bytes``. Headers, record ids
  and both digests are made anew from the row.
* A task writes files under temporary names of its own attempt and returns their
  manifest; only the rows of attempts that Spark commits say what is renamed.
  Renaming may be repeated: a file that is there already is left. The manifest of
  the archive is written last, under a temporary name, and its renaming is the commit.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecrate.llm.rows import row_key
from wavecrate.llm.scratch import materialize
from wavecrate.shipping import ship

#: Parts that the copies of a payload are dealt to.
SALTS = 256
#: Payload bytes of a shard, shards of an archive at least, and compressed bytes at which a file ends.
SHARD_BYTES, LEAST_SHARDS, ROLL_BYTES = 256 << 20, 48, 64 << 20
#: Keys in the sample for each shard, about, and in all at most, about.
SAMPLES, MOST_SAMPLES = 50, 1_000_000
#: The date of every record; a crawl's own date is not in the table.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PIECE = 1 << 16
NO_ID = -(1 << 63)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store that an address names, and the path in it."""
    return pafs.FileSystem.from_uri(uri)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the store that Spark takes it for."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    told = str(there.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(there))
    return told.replace("file:", "file://", 1) if told.startswith("file:/") and not told.startswith("file://") else told


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# Which record is a response

KEY = ["site", "id", "tie"]


def keyed(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """(site, id, tie, url, payload): rows that agree in the first three are interchangeable.

    site: the address behind its host, read from the top domain down.
    """
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(url, "^[A-Za-z]+://([^/:?#]+)", 1))
    site = F.concat(F.array_join(F.reverse(F.split(host, "[.]")), ","), F.lit(" "), url)
    tie = F.hex(row_key(F.col(id_col), F.col(payload_col)))
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    return pages.select(site.alias("site"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), tie.alias("tie"), url.alias("url"), payload.alias("payload"))


def record_types(rows: DataFrame, least_bytes: int) -> DataFrame:
    """(site, id, tie, size, copies, response, chosen) of each different row of ``keyed``.

    response: the id that copies of this payload revisit, null if it has no copies;
    chosen: whether it is one of these rows. Equal payloads: same SHA-256 and length.
    """
    held = rows.select(*KEY, F.sha2("payload", 256).alias("digest"), F.length("payload").cast("long").alias("size"))
    held = materialize(held.groupBy(*KEY, "digest", "size").agg(F.count(F.lit(1)).alias("copies")), "payloads")
    held = held.withColumn("salt", F.pmod(F.xxhash64(*KEY), F.lit(SALTS)).cast("int"))
    group = ["digest", "size"]
    salted = held.filter(F.col("size") >= least_bytes).groupBy(*group, "salt").agg(F.max(F.struct("id", "site", "tie")).alias("best"), F.sum("copies").alias("n"))
    salted = materialize(salted, "salted-payloads")
    whole = salted.groupBy(*group).agg(F.max("best").alias("best"), F.sum("n").alias("n")).filter("n > 1").select(*group, "best")
    best = salted.select(*group, "salt").join(whole, group)
    out = held.join(best, [*group, "salt"], "left")
    return out.select(*KEY, "size", "copies", F.col("best.id").alias("response"), F.coalesce(F.col("best") == F.struct("id", "site", "tie"), F.lit(False)).alias("chosen"))


# Ranges


def range_bounds(types: DataFrame, shards: int) -> list[tuple]:
    """Keys at which a next shard begins, so that shards have about as many bytes, from a sample of the keys that depends on them alone."""
    part = max(1, types.count() // min(SAMPLES * shards, MOST_SAMPLES))
    drawn = types.filter(F.pmod(F.xxhash64(*KEY), F.lit(part)) == 0).select(*KEY, (F.col("size") * F.col("copies") + 500).alias("weight"))
    keys = sorted((r["site"], r["id"], r["tie"], r["weight"]) for r in drawn.collect())
    total, at, bounds = sum(k[3] for k in keys), 0, []
    for *key, weight in keys:
        if at * shards // max(total, 1) > len(bounds):
            bounds.append(tuple(key))
        at += weight
    return bounds


def sharded(rows: DataFrame, bounds: list[tuple]) -> DataFrame:
    """``rows`` with the number of the range that each is in."""
    held = rows.sparkSession.sparkContext.broadcast(bounds)

    @F.pandas_udf("int")
    def shard(site: pd.Series, ident: pd.Series, tie: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(held.value, k) for k in zip(site, ident.tolist(), tie, strict=True)], dtype="int32")

    return rows.withColumn("shard", shard(*KEY))


# Records


def header(lines: list[tuple[str, str]]) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n"


def member(data: bytes) -> bytes:
    """One gzip member without a time or a name."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, json.dumps([str(p) for p in parts]))}>"


def target(url: str, ident: int) -> str:
    """The address with everything escaped that a header line can't hold; rows without one get an address of their own."""
    return quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else f"urn:page:{'' if ident == NO_ID else ident}"


def record(row: dict, response: int | None, copy: int) -> bytes:
    """A response, or a revisit of ``response`` without its payload; the length of the whole payload stands in the HTTP header of both."""
    payload, digest = row["payload"], base32_sha1(row["payload"])
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if response is not None else http + payload
    lines = [
        ("WARC-Type", "revisit" if response is not None else "response"),
        ("WARC-Record-ID", record_id("record", row["id"], row["url"], row["tie"], copy)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", target(row["url"], row["id"])),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if row["id"] != NO_ID:
        lines.append(("WARC-Page-ID", str(row["id"])))
    if response is not None:
        lines.insert(2, ("WARC-Profile", PROFILE))
        if response != NO_ID:
            lines.append(("WARC-Refers-To-Page-ID", str(response)))
    return header(lines) + block + b"\r\n\r\n"


def warcinfo(name: str) -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    lines = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("file", name)), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(block)))]
    return header(lines) + block + b"\r\n\r\n"


class Shard:
    """The files of one shard, written in turn under temporary names."""

    def __init__(self, out: str, number: int, roll_bytes: int):
        self.store, self.top = filesystem(out)
        self.number, self.roll, self.files, self.stream = number, roll_bytes, 0, None
        self.attempt = uuid.uuid4().hex

    def _open(self) -> None:
        self.name = f"part-{self.number:06d}-{self.files:05d}.warc.gz"
        self.temporary = f"_temporary/{self.attempt}-{self.name}"
        self.store.create_dir(f"{self.top}/_temporary", recursive=True)
        self.stream = self.store.open_output_stream(f"{self.top}/{self.temporary}", compression=None)
        self.bytes, self.records, self.sum = 0, 0, hashlib.sha256()
        self._put(member(warcinfo(self.name)))

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.sum.update(data)
        self.bytes += len(data)

    def write(self, data: bytes) -> Iterator[tuple]:
        if self.stream is None:
            self._open()
        self._put(member(data))
        self.records += 1
        if self.bytes >= self.roll:
            yield from self.close()

    def close(self) -> Iterator[tuple]:
        """The manifest's row of the file that ends."""
        if self.stream is not None:
            self.stream.close()
            self.stream, self.files = None, self.files + 1
            yield self.name, self.temporary, self.bytes, self.records, self.sum.hexdigest()


MANIFEST_COLUMNS = {"name": pa.string(), "temporary": pa.string(), "bytes": pa.int64(), "records": pa.int64(), "sha256": pa.string()}


def _rows(values: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*values, strict=True)) or [()] * len(MANIFEST_COLUMNS)
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, MANIFEST_COLUMNS.values(), strict=True)], names=list(MANIFEST_COLUMNS))


def _writer(out: str, roll_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by shard and key, the type of a key's rows before them."""
        shard, told, copy = None, None, 0
        for batch in batches:
            done: list[tuple] = []
            for i in range(batch.num_rows):
                row = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
                if shard is None or row["shard"] != shard.number:
                    done += shard.close() if shard else ()
                    shard = Shard(out, row["shard"], roll_bytes)
                if row["payload"] is None:
                    told, copy = row, 0
                    continue
                own = told["response"] is None or (told["chosen"] and copy == 0)
                done += shard.write(record(row, None if own else told["response"], copy))
                copy += 1
            yield _rows(done)
        if shard:
            yield _rows(list(shard.close()))

    return write


def _renamer(out: str):
    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = filesystem(out)
        for batch in batches:
            for row in batch.to_pylist():
                there = store.get_file_info(f"{top}/{row['name']}")
                if there.type != pafs.FileType.File or there.size != row["bytes"]:
                    store.move(f"{top}/{row['temporary']}", f"{top}/{row['name']}")
            yield batch

    return rename


def write_archive(
    pages: DataFrame,
    out: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    least_revisit_bytes: int = 0,
    shard_bytes: int = SHARD_BYTES,
    least_shards: int = LEAST_SHARDS,
    roll_bytes: int = ROLL_BYTES,
) -> str:
    """Write one record for each row of ``pages`` below the new folder ``out`` and return the folder's address.

    The payload is the text in UTF-8, null counts as empty. Of equal payloads of
    ``least_revisit_bytes`` or more the row with the largest id is a response and the
    others revisit it; null ids are the least, of repeated rows one is the response.
    Rows without an address are named by their id. Further columns are not read. An
    empty table gives an archive without files. ``out`` is a path or address that
    every executor reaches and that pyarrow can write. Shards follow from the bytes of
    payload. At most about ``MOST_SAMPLES`` keys come to the driver, as with Spark's
    own range sort; each payload is shuffled once.
    """
    spark = pages.sparkSession
    ship(spark)
    out = qualified(spark, out)
    rows = keyed(pages, id_col, url_col, payload_col)
    types = materialize(record_types(rows, least_revisit_bytes), "record-types")
    size = types.agg(F.coalesce(F.sum(F.col("size") * F.col("copies")), F.lit(0)).alias("n")).first()["n"]
    shards = max(least_shards, -(-size // shard_bytes))
    told = types.select(*KEY, F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "response", "chosen")
    both = told.unionByName(rows.select(*KEY, "url", "payload", F.lit(None).cast("long").alias("response"), F.lit(None).cast("boolean").alias("chosen")))
    dealt = sharded(both, range_bounds(types, shards)).repartition(min(4 * shards, 20_000), "shard")
    # Null payloads come first.
    sorted_ = dealt.sortWithinPartitions("shard", *KEY, F.col("payload").isNotNull())
    manifest = "name string, temporary string, bytes long, records long, sha256 string"
    written = materialize(sorted_.mapInArrow(_writer(out, roll_bytes), manifest), "written-files")
    renamed = written.repartition(min(shards, 1000), "name").mapInArrow(_renamer(out), manifest)
    renamed.drop("temporary").coalesce(max(1, shards // 1000)).write.parquet(f"{out}/_manifest")
    store, top = filesystem(out)
    store.move(f"{top}/_manifest", f"{top}/manifest")
    if store.get_file_info(f"{top}/_temporary").type == pafs.FileType.Directory:
        store.delete_dir(f"{top}/_temporary")
    return out


# Reading


def members(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The gzip members of a stream, decompressed one at a time."""
    rest, z, parts = b"", zlib.decompressobj(31), []
    for piece in pieces:
        rest = piece
        while rest:
            parts.append(z.decompress(rest))
            rest = z.unused_data
            if not z.eof:
                break
            yield b"".join(parts)
            z, parts = zlib.decompressobj(31), []
    if parts:
        raise ValueError("the last gzip member is cut off")


def parsed(data: bytes) -> dict:
    """The headers and the block of a record; its digests are compared with what it holds."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    told = fields.get("WARC-Block-Digest")
    if told and told != f"sha1:{base32_sha1(block)}":
        raise ValueError(f"{fields['WARC-Record-ID']}: the block is not what its digest says")
    return fields | {"block": block}


def page_row(fields: dict, name: str) -> tuple:
    """A response's or revisit's row; a response's payload is compared with its digest and length."""
    http, _, payload = fields["block"].partition(b"\r\n\r\n")
    size = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload is not what its digest says")
    number = lambda key: int(fields[key]) if key in fields else None
    return number("WARC-Page-ID"), fields["WARC-Target-URI"], size, digest, fields["WARC-Type"], number("WARC-Refers-To-Page-ID"), fields["WARC-Record-ID"], name, payload if fields["WARC-Type"] == "response" else None


RECORD = "page_id long, target_uri string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, file string, payload binary"
RECORD_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]


def _reader(out: str, payloads: bool):
    names = [c.split()[0] for c in RECORD.split(", ")][: None if payloads else -1]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(RECORD_TYPES)
        return pa.record_batch([pa.array(c, t) for c, t, _ in zip(columns, RECORD_TYPES, names, strict=False)], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = filesystem(out)
        for batch in batches:
            for name, sha in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total, rows, held = hashlib.sha256(), [], 0
                with store.open_input_stream(f"{top}/{name}", compression=None) as stream:

                    def pieces(stream=stream, total=total):
                        while piece := stream.read(PIECE):
                            total.update(piece)
                            yield piece

                    for data in members(pieces()):
                        fields = parsed(data)
                        if fields["WARC-Type"] in ("response", "revisit"):
                            rows.append(page_row(fields, name))
                            held += len(data) if payloads else 300
                        if held > 8 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if total.hexdigest() != sha:
                    raise ValueError(f"{name} is not the file that the manifest names")
                yield batch_of(rows)

    return read


def read_archive(spark: SparkSession, out: str, payloads: bool = False) -> DataFrame:
    """One row per response and revisit of the archive in ``out``, with the payload of responses if asked for.

    Only files that the manifest names are read. Their digests, those of all blocks
    and of all payloads are made again and compared; a difference is an error. A file
    is read as a stream, a record at a time.
    """
    ship(spark)
    out = qualified(spark, out)
    files = spark.read.parquet(f"{out}/manifest").select("name", "sha256")
    kinds = RECORD if payloads else RECORD.rsplit(", ", 1)[0]
    return files.repartition(max(1, min(files.count(), 20_000)), "name").mapInArrow(_reader(out, payloads), kinds)
