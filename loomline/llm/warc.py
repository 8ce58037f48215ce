"""WARC: a deterministic sharded writer, and a reader.

Records are range-partitioned by id, at boundaries drawn from a sample in proportion to size, and sorted. Each
shard writes gzip members, one a record, and rolls to the next file when the compressed size reaches a limit.
Headers, lengths and digests are made anew from the payload. A file is written under a temporary name
and renamed when whole; its bytes depend on the records alone, so a second attempt at a task writes the same file, and finds it if the first got so far.
The manifest is a table of one row a file, written by Spark below ``manifest``; its success marker, which comes last, commits the run: files
it does not name do not count.

Of records with equal payloads the one of smallest id is a response and the others revisit it, from
``revisit_from`` bytes on.

How it scales. Digests are grouped with partial aggregation over narrow rows, and what revisits another is settled there; a
page's html is shuffled once, to its shard, where the note that it revisits sorts right before it. The writer streams its rows, the reader its
files. The driver sees DRAWS sampled ids a shard, of SHARDS shards at most; manifest rows stay on the executors.

Cases. Null html is an empty payload, a null url an empty one; line breaks in a url are escaped. Rows that share an
id and payload are responses alike. A null id is written as such and counts as larger than all. An empty table writes an
empty manifest. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import parts_for, shared_dir, stash, table
from .sharding import DRAWS, draw, quantiles

#: Compressed bytes from which a file is closed, and payload bytes of a shard.
ROLL, SHARD = 64 << 20, 64 << 20
#: Shards at most; beyond it they hold more bytes and roll over more files.
SHARDS = 20_000
DATE = "2000-01-01T00:00:00Z"
MANIFEST = "manifest"


def place(uri: str):
    """(file system, path) of a folder that all executors reach."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def name_of(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def record(page: int | None, url: str, payload: bytes, refers: int | None, revisit: bool) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name_of(page)}", f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"), f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name_of(refers)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def member(raw: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


class Roller:
    """The files of one shard, one after another."""

    def __init__(self, fs, folder: str, shard: int, roll: int) -> None:
        self.fs, self.folder, self.shard, self.roll = fs, folder, shard, roll
        self.seq, self.out, self.done = 0, None, []

    def add(self, page: int | None, raw: bytes) -> None:
        if self.out is None:
            self.name = f"part-{self.shard:06d}-{self.seq:04d}.warc.gz"
            self.temp = f"{self.folder}/.{self.name}.{uuid.uuid4().hex}.tmp"
            self.out, self.size, self.records, self.sha = self.fs.open_output_stream(self.temp), 0, 0, hashlib.sha256()
            info = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:file:{self.name}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
            self._write(member(info.encode()))
        self._write(member(raw))
        self.records += 1
        if self.size >= self.roll:
            self.close()

    def _write(self, z: bytes) -> None:
        self.out.write(z)
        self.size += len(z)
        self.sha.update(z)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            if self.fs.get_file_info(f"{self.folder}/{self.name}").type.name == "NotFound":
                self.fs.move(self.temp, f"{self.folder}/{self.name}")
            else:  # an earlier attempt has written the same bytes
                self.fs.delete_file(self.temp)
            self.done.append({"file": self.name, "records": self.records, "bytes": self.size, "sha256": self.sha.hexdigest()})
            self.out, self.seq = None, self.seq + 1


FILE = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])


def _write(uri: str, roll: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = place(uri)
        own, noted = None, (None, None, None)
        for batch in batches:
            for k in range(0, len(batch), 200):
                for row in batch.slice(k, 200).to_pylist():
                    if own is None or own.shard != row["shard"]:
                        if own:
                            own.close()
                            yield pa.RecordBatch.from_pylist(own.done, FILE)
                        own = Roller(fs, folder, row["shard"], roll)
                    if not row["page"]:
                        noted = row["page_id"], row["digest"], row["first"]
                        continue
                    revisit = row["digest"] is not None and noted[:2] == (row["page_id"], row["digest"])
                    own.add(row["page_id"], record(row["page_id"], row["url"], row["html"].encode(), noted[2] if revisit else None, revisit))
        if own:
            own.close()
            yield pa.RecordBatch.from_pylist(own.done, FILE)

    return go


def _shard_of(bounds: list[int]):
    at = np.array(bounds, np.int64)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("page_id").fill_null(np.iinfo(np.int64).max).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.searchsorted(at, ids, "right").astype(np.int32))], [*batch.schema.names, "shard"])

    return go


def write(pages: DataFrame, uri: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_from: int = 0, roll: int = ROLL, shard_bytes: int = SHARD) -> DataFrame:
    """Write one record per row to the folder ``uri``; returns the manifest: file, records, bytes, sha256."""
    spark = pages.sparkSession
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    size = F.octet_length("html").cast("long")
    digest_of = F.when(size >= revisit_from, F.sha1("html"))
    rows = stash(pages.select("page_id", digest_of.alias("digest"), size.alias("size")), "digests")
    many = rows.where("digest is not null").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    notes = rows.join(stash(many, "repeated"), "digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).select("page_id", "digest", "first").distinct()
    total = rows.agg(F.coalesce(F.sum(F.col("size") + 1), F.lit(0))).first()[0]
    shards = min(SHARDS, parts_for(total, shard_bytes))
    bounds = quantiles(draw(rows.where("page_id is not null").withColumn("weight", F.col("size") + 1), "page_id", "weight", total, DRAWS * shards), shards)
    both = notes.withColumn("page", F.lit(False)).unionByName(pages.withColumn("digest", digest_of).withColumn("page", F.lit(True)), allowMissingColumns=True)
    both = both.select("page_id", "digest", "page", "first", "url", "html").mapInArrow(_shard_of(bounds), "page_id long, digest string, page boolean, first long, url string, html string, shard int")
    both = both.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", F.col("page_id").asc_nulls_last(), "digest", "page", "url", "html")
    fs, folder = place(uri)
    fs.create_dir(folder, recursive=True)
    both.mapInArrow(_write(uri, roll), "file string, records long, bytes long, sha256 string").write.parquet(f"{uri}/{MANIFEST}")
    return manifest(spark, uri)


def manifest(spark: SparkSession, uri: str) -> DataFrame:
    """The committed files of a folder."""
    fs, folder = place(uri)
    if fs.get_file_info(f"{folder}/{MANIFEST}/_SUCCESS").type.name == "NotFound":
        raise FileNotFoundError(f"{uri} holds no committed run")
    return spark.read.schema("file string, records long, bytes long, sha256 string").parquet(f"{uri}/{MANIFEST}")


def members(stream, block: int = 1 << 20) -> Iterator[bytes]:
    """Each gzip member's content, reading the stream in blocks."""
    z, out, rest = zlib.decompressobj(31), [], b""
    while rest or (rest := stream.read(block)):
        out.append(z.decompress(rest))
        rest = b""
        if z.eof:
            rest = z.unused_data
            yield b"".join(out)
            z, out = zlib.decompressobj(31), []
    if out:
        raise ValueError("the file ends inside a record")


def fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}


def _page(urn: str) -> int | None:
    name = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(name) if name else None


RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _read(uri: str, with_payload: bool):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = place(uri)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                    for raw in members(stream):
                        head, _, rest = raw.partition(b"\r\n\r\n")
                        h = fields(head)
                        if h["warc-type"] == "warcinfo":
                            continue
                        block = rest[: int(h["content-length"])]
                        http, _, payload = block.partition(b"\r\n\r\n")
                        own = h["warc-payload-digest"].removeprefix("sha1:")
                        response = h["warc-type"] == "response"
                        if h["warc-block-digest"] != f"sha1:{digest(block)}" or response and digest(payload) != own:
                            raise ValueError(f"{name}: record {h['warc-record-id']} does not match its digest")
                        rows.append({
                            "page_id": _page(h["warc-record-id"]), "url": h.get("warc-target-uri", ""), "record_type": h["warc-type"], "payload_bytes": int(fields(http)["content-length"]), "payload_digest": own,
                            "refers_to": None if response else _page(h["warc-refers-to"]), "payload": payload if response and with_payload else None,
                        })
                        held += len(payload) if with_payload else 200
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, RECORD)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, RECORD)

    return go


def read(spark: SparkSession, uri: str, payload: bool = True) -> DataFrame:
    """One row per record of the committed files: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload (responses only)."""
    files = manifest(spark, uri)
    listed = files.select("file").repartition(max(1, min(files.count(), SHARDS)), "file")
    return listed.mapInArrow(_read(uri, payload), "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC files and read back."""
    uri = f"{shared_dir(spark)}/loomline/warc-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "pages"), uri)
    return read(spark, uri, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op5_warc": op5_warc}
SQL: dict[str, str] = {}
