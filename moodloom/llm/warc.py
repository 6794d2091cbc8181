"""WARC archives as a table of chunks.

Writing: every row becomes one record. Records with equal payloads are a response once, for the smallest id, and
revisits that name it otherwise. Ids, digests and lengths are settled first, in small rows without payloads; the payloads
then meet their row by id. Each task streams its records into one archive (a gzip member per record), under a temporary name until it is whole, so
a task that runs again leaves no half archive.

Reading: each archive is streamed. The block of a record comes out as rows (record_id, chunk_no, chunk) of `chunk` bytes
at most, with the digest of the bytes so far; no record is ever held as a whole.

Null payloads are empty. Ids may repeat: of wholly repeated rows the first is the response. Payloads below `least` bytes
are always responses. An empty table gives no archives and no rows. Any further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as c

CHUNK = 1 << 20
CHUNKS = ("record_id string, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, "
          "chunk_no long, last boolean, chunk binary, digest_so_far string")


def sha1_base32(raw: bytes) -> str:
    return base64.b32encode(raw).decode()


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def roles(pages: DataFrame, least: int = 0) -> DataFrame:
    """One row (page_id, digest, record_type, refers_to) for each id and payload, without payloads."""
    body = F.coalesce("html", F.lit("")).cast("binary")
    small = pages.select("page_id", F.sha1(body).alias("digest"), F.octet_length(body).alias("size")).distinct()
    known = small.join(small.groupBy("digest").agg(F.min("page_id").alias("first")), "digest")
    response = (F.col("size") < least) | F.col("page_id").eqNullSafe(F.col("first"))
    return known.select("page_id", "digest", F.when(response, "response").otherwise("revisit").alias("record_type"),
                        F.when(~response, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write pages (page_id, url, html) to WARC files in `folder`; returns one row per archive."""
    pages = c.as_documents(pages, ("page_id", "url", "html"))
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("name")
    rows = pages.select("*", name, F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"))
    # Join and numbering need the same distribution: payloads are shuffled once, by id.
    rows = rows.join(roles(pages, least).select(name, "digest", "record_type", "refers_to"), ["name", "digest"])
    nth = F.row_number().over(Window.partitionBy("name", "digest").orderBy("url"))
    again = (F.col("record_type") == "response") & (F.octet_length(F.coalesce("html", F.lit(""))) >= least) & (F.col("nth") > 1)
    rows = rows.withColumn("nth", nth).select(
        "page_id", "url", "html", "digest", F.when(again, "revisit").otherwise(F.col("record_type")).alias("record_type"),
        F.when(again, F.col("page_id")).otherwise(F.col("refers_to")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _filesystem(folder)
        task = TaskContext.get()
        name = f"{path}/part-{task.partitionId():06d}.warc.gz"
        held = f"{path}/.{task.partitionId():06d}-{uuid.uuid4().hex}"
        files.create_dir(path, recursive=True)
        n = 0
        with files.open_output_stream(held, compression=None) as out:
            for batch in batches:
                columns = [batch.column(i) for i in range(6)]
                for i in range(batch.num_rows):
                    page, url, html, sha, kind, refers = (col[i] for col in columns)
                    body = html.cast(pa.binary()).as_buffer() if html.is_valid else b""
                    head = _head(page.as_py(), url.as_py(), sha.as_py(), kind.as_py(), refers.as_py(), len(body))
                    # Each record is a gzip member of its own, as usual for archives that are read in parts.
                    member = zlib.compressobj(1, wbits=31)
                    out.write(member.compress(head))
                    for at in range(0, len(body) if kind.as_py() == "response" else 0, CHUNK):
                        out.write(member.compress(memoryview(body)[at:at + CHUNK]))
                    out.write(member.compress(b"\r\n\r\n") + member.flush())
                    n += 1
        if n:
            files.move(held, name)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], ["path", "records"])
        else:
            files.delete_file(held)

    return rows.mapInArrow(run, "path string, records long")


def _head(page: int | None, url: str | None, sha: str, kind: str, refers: int | None, size: int) -> bytes:
    def named(key) -> str:
        return f"<urn:page:{'' if key is None else key}>"

    clean = "".join(ch for ch in url or "" if ch > " ")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {named(page)}", f"WARC-Target-URI: {clean}", "WARC-Date: 1970-01-01T00:00:00Z",
             f"WARC-Payload-Digest: sha1:{sha1_base32(bytes.fromhex(sha))}"]
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {named(refers)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"X-Payload-Length: {size}"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {size if kind == 'response' else 0}", "", ""]
    return "\r\n".join(lines).encode()


class _Members:
    """Bytes of the gzip members of a stream, one after another, a block at a time."""

    def __init__(self, raw, block: int = 1 << 18):
        self.raw, self.block, self.pending, self.member = raw, block, b"", zlib.decompressobj(31)

    def read(self, n: int) -> bytes:
        while True:
            out = self.member.decompress(self.pending, n)
            if self.member.eof:
                self.pending, self.member = self.member.unused_data, zlib.decompressobj(31)
            else:
                self.pending = self.member.unconsumed_tail
            if out:
                return out
            if not self.pending:
                self.pending = self.raw.read(self.block)
                if not self.pending:
                    return b""


class _Buffered:
    """Reads through a block, so that header lines cost no call to the store per byte."""

    def __init__(self, raw, block: int = 1 << 20):
        self.raw, self.block, self.held, self.at = raw, block, b"", 0

    def read(self, n: int) -> bytes:
        if self.at >= len(self.held):
            self.held, self.at = self.raw.read(self.block), 0
        got = self.held[self.at:self.at + n]
        self.at += len(got)
        return got

    def line(self) -> bytes:
        out = b""
        while True:
            end = self.held.find(b"\n", self.at)
            if end >= 0:
                out, self.at = out + self.held[self.at:end + 1], end + 1
                return out.rstrip(b"\r\n") if out else out
            out, self.held, self.at = out + self.held[self.at:], self.raw.read(self.block), 0
            if not self.held:
                return out


def records(stream, chunk: int = CHUNK) -> Iterator[dict]:
    """Chunk rows of one archive, in order."""
    source = _Buffered(_Members(stream))
    while True:
        line = source.line()
        if not line:
            if not source.held:
                return
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        head = {}
        while line := source.line():
            key, _, value = line.decode().partition(": ")
            head[key] = value
        left, no, digest = int(head["Content-Length"]), 0, hashlib.sha1()
        refers = head.get("WARC-Refers-To", "")[len("<urn:page:"):-1]
        page = head["WARC-Record-ID"][len("<urn:page:"):-1]
        row = {"record_id": head["WARC-Record-ID"], "page_id": int(page) if page else None, "record_type": head["WARC-Type"],
               "refers_to": int(refers) if refers else None, "payload_bytes": int(head.get("X-Payload-Length", left)),
               "payload_digest": head["WARC-Payload-Digest"].removeprefix("sha1:")}
        while True:
            part = bytearray()
            while len(part) < min(chunk, left):
                got = source.read(min(chunk, left) - len(part))
                if not got:
                    raise ValueError(f"{row['record_id']} ends early")
                part += got
            left -= len(part)
            digest.update(part)
            yield row | {"chunk_no": no, "last": not left, "chunk": bytes(part), "digest_so_far": sha1_base32(digest.digest())}
            no += 1
            if not left:
                break


def read_archives(spark: SparkSession, archives: DataFrame, folder: str, chunk: int = CHUNK) -> DataFrame:
    """The chunk table of the archives in column `path`."""
    schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[t]) for n, t in (
        x.split() for x in CHUNKS.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = _filesystem(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with files.open_input_stream(path, compression=None) as stream:
                    held, size = [], 0
                    for row in records(stream, chunk):
                        held.append(row)
                        size += len(row["chunk"]) + 400
                        if size > 4 * chunk:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema)

    return archives.select("path").mapInArrow(run, CHUNKS)


def payloads(chunks: DataFrame) -> DataFrame:
    """One row per record, checked: the digest of a response's bytes must be the one its header names."""
    last = chunks.where("last").drop("chunk", "chunk_no", "last")
    bad = (F.col("record_type") == "response") & (F.col("digest_so_far") != F.col("payload_digest"))
    checked = F.when(bad, F.raise_error(F.concat(F.lit("digest differs: "), "record_id"))).otherwise(F.col("payload_digest"))
    return last.select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")


def round_trip(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    spark = pages.sparkSession
    archives = c.settle(write_archives(pages, folder, least), "archives")
    # As many reading tasks as archives: each is streamed by one task.
    n = max(1, archives.count())
    return payloads(read_archives(spark, archives.repartition(n), folder))
