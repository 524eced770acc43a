"""WARC archives as a Spark data source: one gzip member a record, read and written as streams."""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from quadrille.session import bounded_batches, shared_dir

__all__ = ["WarcDataSource", "WarcError", "read_records", "record_bytes", "archive_pages", "register"]

READ = 1 << 16
LEVEL = 4
BATCH = 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records as rows. payload: the HTTP body (null for revisits); digest: SHA-1 of the full payload.
SCHEMA = "record_id string, record_type string, uri string, date string, refers_to string, length long, digest string, payload binary"


class WarcError(ValueError):
    """An archive that breaks off, is damaged, or does not hold what its headers say."""


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _b32(hexed: str) -> str:
    return base64.b32encode(bytes.fromhex(hexed)).decode()


def record_bytes(record_id: str, kind: str, uri: str, date: str, payload: bytes, refers_to: str | None, level: int = LEVEL) -> bytes:
    """One record as a gzip member. A revisit has the HTTP head of its payload, not the body."""
    clean = lambda s: " ".join((s or "").split())  # noqa: E731  a header is one line
    sha = hashlib.sha1(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (b"" if kind == "revisit" else payload)
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {clean(uri)}"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{_b32(sha)}", f"WARC-Block-Digest: sha1:{_b32(hashlib.sha1(block).hexdigest())}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def _members(stream: BinaryIO) -> Iterator[bytes]:
    """The gzip members of a stream, inflated piece by piece."""
    rest = stream.read(READ)
    while rest:
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            if not rest and not (rest := stream.read(READ)):
                raise WarcError("the archive breaks off inside a record")
            try:
                out.append(z.decompress(rest))
            except zlib.error as e:
                raise WarcError(f"damaged member: {e}") from e
            rest = z.unused_data
        yield b"".join(out)
        rest = rest or stream.read(READ)


def _headers(lines: bytes) -> tuple[str, dict[str, str]]:
    first, _, rest = lines.decode("utf-8", "replace").partition("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in rest.split("\r\n") if x)}


def read_records(stream: BinaryIO) -> Iterator[dict]:
    """The records of an archive in order, framed by Content-Length and checked by digest."""
    for member in _members(stream):
        head, sep, body = member.partition(b"\r\n\r\n")
        version, h = _headers(head)
        if not sep or not version.startswith("WARC/"):
            raise WarcError("a member does not begin with a WARC record")
        n = int(h.get("content-length", -1))
        if n < 0 or body[n:] != b"\r\n\r\n":
            raise WarcError(f"the block of {h.get('warc-record-id')} is not as long as it says")
        block = body[:n]
        sha = lambda x: f"sha1:{_b32(hashlib.sha1(x).hexdigest())}"
        if h.get("warc-block-digest", sha(block)) != sha(block):
            raise WarcError(f"block digest of {h.get('warc-record-id')} differs")
        http, _, payload = block.partition(b"\r\n\r\n")
        length = int(_headers(http)[1].get("content-length", -1))
        revisit = h.get("warc-type") == "revisit"
        if not revisit and (len(payload) != length or h.get("warc-payload-digest", sha(payload)) != sha(payload)):
            raise WarcError(f"payload of {h.get('warc-record-id')} differs from its length or digest")
        plain = lambda s: s[1:-1] if s else None
        digest = base64.b32decode(h["warc-payload-digest"].split(":")[1]).hex() if "warc-payload-digest" in h else hashlib.sha1(payload).hexdigest()
        yield {"record_id": plain(h.get("warc-record-id")), "record_type": h.get("warc-type"), "uri": h.get("warc-target-uri"), "date": h.get("warc-date"), "refers_to": plain(h.get("warc-refers-to")), "length": length, "digest": digest, "payload": None if revisit else payload}


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(folder)`` and ``df.write.format("warc").save(folder)``.

    Reading: a task per ``*.warc.gz`` file, in file order. Option ``payload`` (true) says whether
    bodies are returned; they are verified either way. Writing: columns record_id, record_type,
    uri, date, refers_to and payload; a file per task, written under a name of its own and
    put in place when the job commits, so that repeated tasks leave nothing behind.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, overwrite)


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.payload = options["path"], options.get("payload", "true").lower() != "false"

    def partitions(self) -> list[InputPartition]:
        fs, base = _fs(self.path)
        found = fs.get_file_info(pafs.FileSelector(base, allow_not_found=False))
        return [InputPartition(x.path) for x in sorted(found, key=lambda x: x.path) if x.is_file and x.path.endswith(".warc.gz")] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        fs, _ = _fs(self.path)
        kinds = pa.schema([(x.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for x in SCHEMA.split(", ")])
        rows, held = [], 0
        with fs.open_input_stream(partition.value, compression=None) as f:
            for r in read_records(f):
                if not self.payload:
                    r["payload"] = None
                rows.append(r)
                held += 500 + len(r["payload"] or b"")
                if held >= BATCH:
                    yield pa.RecordBatch.from_pylist(rows, kinds)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kinds)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite, self.level = options["path"], overwrite, int(options.get("level", LEVEL))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, base = _fs(self.path)
        fs.create_dir(base, recursive=True)
        at = f"{base}/.{uuid.uuid4().hex}.warc.gz.part"
        n = 0
        with fs.open_output_stream(at, compression=None) as out:
            for b in iterator:
                cols = [b.column(c) for c in ("record_id", "record_type", "uri", "date", "payload", "refers_to")]
                for i in range(b.num_rows):
                    rid, kind, uri, date, payload, ref = (c[i].as_py() for c in cols)
                    out.write(record_bytes(rid, kind, uri, date, payload or b"", ref, self.level))
                    n += 1
        if not n:
            fs.delete_file(at)
        return _Written(at if n else None)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, base = _fs(self.path)
        fs.create_dir(base, recursive=True)
        done = [m.path for m in messages if m and m.path]
        if self.overwrite:
            for x in fs.get_file_info(pafs.FileSelector(base)):
                if x.is_file and x.path.endswith(".warc.gz"):
                    fs.delete_file(x.path)
        for k, p in enumerate(done):
            fs.move(p, f"{base}/{os.path.basename(p)[1:33]}-{k:05d}.warc.gz")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, _ = _fs(self.path)
        for m in messages:
            if m and m.path and fs.get_file_info(m.path).type != pafs.FileType.NotFound:
                fs.delete_file(m.path)


class _Written(WriterCommitMessage):
    def __init__(self, path: str | None) -> None:
        self.path = path


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)


def archive_pages(pages: DataFrame, path: str | None = None, least: int = 1000, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write ``pages(page_id, url, html)`` as WARC archives into ``path`` and read them back.

    The payload is the html in UTF-8 (null: empty). Of payloads of at least ``least`` bytes that
    are equal (same length and SHA-1) the row with the largest page_id is a response and the
    others revisit it; rows that share that largest page_id are all responses, and a null page_id
    is the smallest. All other rows are responses. A record's id is made of page_id, as
    ``urn:page:<page_id>``, so repeated rows have equal ids. Returns, from the archives, page_id,
    url, payload_bytes, payload_digest (bare lower-case hexadecimal SHA-1), record_type and
    refers_to (page_id of the response). Empty tables give an empty result.
    """
    spark = pages.sparkSession
    register(spark)
    bounded_batches(spark)
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    raw = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", "url", raw.alias("payload")).withColumns({"n": F.octet_length("payload"), "sha": F.sha1("payload")})
    # who comes first is settled on narrow rows; the copies of one payload are counted before the shuffle
    same = pages.select("page_id", F.octet_length(raw).alias("n"), F.sha1(raw).alias("sha")).where(F.col("n") >= least)
    first = same.groupBy("n", "sha").agg(F.max("page_id").alias("top"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("")))
    revisit = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    records = rows.join(first, ["n", "sha"], "left").select(
        urn(F.col("page_id")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.coalesce("url", F.lit("")).alias("uri"), F.lit(date).alias("date"),
        F.when(revisit, urn(F.col("top"))).alias("refers_to"), "payload",
    )
    records.write.format("warc").mode("append").save(path)
    back = spark.read.format("warc").option("payload", "false").load(path)
    page = lambda c: F.nullif(F.substring(c, 10, 1 << 20), F.lit("")).cast(pages.schema["page_id"].dataType)
    return back.select(page("record_id").alias("page_id"), F.col("uri").alias("url"), F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"))
