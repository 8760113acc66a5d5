"""WARC: revisit resolution and deduplicated archives with fresh headers.

Only headers (digest, length, id) are shuffled, by payload digest, to find groups of equal payloads: a partial aggregation
per digest keeps the row with the largest id, so a digest that holds a third of all records sends one
row per task. Groups of one drop out. The largest groups, BROADCAST_GROUPS at most, are broadcast, so their records meet
their originals where they are; only if there are more groups, and then smaller ones, are the other records joined by digest.
Payloads of revisits are dropped before they are written.

Archives are written by the tasks, one gzip member per record, to a temporary name that is renamed
when complete; names tell the attempt, and files of attempts that the manifest does not list are deleted. Reading is streamed
record by record. Payloads that are equal share a SHA-1.
"""

from __future__ import annotations

import base64
import binascii
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.work import Scratch, map_batches

MIN_REVISIT_BYTES = 1000
BROADCAST_GROUPS = 100_000
#: An archive is closed when it has so many compressed bytes.
ARCHIVE_BYTES = 64 << 20
#: Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def resolve_revisits(records: DataFrame, scratch: Scratch, min_bytes: int = MIN_REVISIT_BYTES, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """Adds record_type, refers_to, refers_to_uri to records(record_no, uri, payload).

    Of records with equal payloads of at least ``min_bytes`` the one with the largest record_no is the
    response. Rows that repeat both that number and the payload are each a response. A null payload
    is empty; a record without a number is a revisit if any record of its payload has one. Payloads of any length are read
    whole; other columns, whatever their names, are not read; an empty table gives no rows.
    """
    full = records.select("record_no", "uri", F.coalesce(F.col("payload"), F.lit(b"").cast("binary")).alias("payload"))
    full = full.withColumn("payload_digest", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    headers = full.where(F.col("payload_bytes") >= min_bytes).select("payload_digest", "payload_bytes", "record_no", "uri")
    key = ["payload_digest", "payload_bytes"]
    groups = headers.groupBy(*key).agg(F.max(F.struct("record_no", "uri")).alias("top"), F.count("*").alias("n")).where("n > 1 and top.record_no is not null")
    groups = scratch.write(groups, "groups")
    large = rest = groups
    if many := groups.count() > broadcast_groups:
        large = scratch.write(groups.orderBy(F.desc("n"), *key).limit(broadcast_groups), "large")
        rest = groups.join(large.select(*key), key, "left_anti")
    joined = full.join(F.broadcast(large.drop("n")), key, "left")
    if many:
        open_yet = F.col("top").isNull() & (F.col("payload_bytes") >= min_bytes)
        joined = joined.where(~open_yet).unionByName(joined.where(open_yet).drop("top").join(rest.drop("n"), key, "left"))
    revisit = F.col("top").isNotNull() & ~F.col("record_no").eqNullSafe(F.col("top.record_no"))
    return joined.select(
        "record_no", "uri", "payload_digest", "payload_bytes",
        F.when(revisit, F.lit(None)).otherwise(F.col("payload")).alias("payload"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("top.record_no")).alias("refers_to"),
        F.when(revisit, F.col("top.uri")).alias("refers_to_uri"),
    )


def record_id(number: int | None, digest: str) -> str:
    """A name that depends on the record's number and payload alone, so that revisits can cite it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{number}/{digest}')}>"


def _uri(text: str | None) -> str:
    """A header value on one line; WARC wants a URI for each of these records."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text or "") or "urn:x-unknown"


def encode_record(number, uri, digest, size, kind, refers_to, refers_uri, payload) -> bytes:
    """One WARC record with fresh headers: a response with the payload or a revisit with HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"" if kind == "response" else b"")
    b32 = lambda raw: base64.b32encode(raw).decode()
    head = [
        VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(number, digest)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_uri(uri)}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{b32(binascii.unhexlify(digest))}", f"WARC-Block-Digest: sha1:{b32(hashlib.sha1(block).digest())}",
        f"Content-Length: {len(block)}", f"X-Record-Number: {'' if number is None else number}", f"X-Has-URI: {int(uri is not None)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Refers-To-Target-URI: {_uri(refers_uri)}", f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Number: {refers_to}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _filesystem(url: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(url if "://" in url or url.startswith("/") else f"/{url}")


def write_archives(resolved: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes resolved records to ``folder``; a lazy (path, records, bytes) row per archive."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        attempt = TaskContext.get().taskAttemptId()
        store, top = _filesystem(folder)
        store.create_dir(top, recursive=True)
        out, size, count, seq, made = None, 0, 0, 0, []

        def close():
            nonlocal out, size, count, seq
            if out is not None:
                out.close()
                final = f"{top}/part-{part:05d}-{seq:04d}-{attempt}.warc.gz"
                store.move(f"{final}.tmp", final)
                made.append((final, count, size))
                out, size, count, seq = None, 0, 0, seq + 1

        for batch in batches:
            columns = [batch.column(n) for n in ("record_no", "uri", "payload_digest", "payload_bytes", "record_type", "refers_to", "refers_to_uri", "payload")]
            for k in range(batch.num_rows):
                if out is None:
                    out = store.open_output_stream(f"{top}/part-{part:05d}-{seq:04d}-{attempt}.warc.gz.tmp", compression=None)
                member = gzip.compress(encode_record(*(c[k].as_py() for c in columns)), 6, mtime=0)
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= archive_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    return map_batches(resolved, write, "path string, records long, bytes long")


def parse_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a file of gzip members or plain records, one at a time."""
    head = stream.read(2)
    raw = io.BufferedReader(gzip.GzipFile(fileobj=_Joined(head, stream)) if head == b"\x1f\x8b" else _Joined(head, stream), 1 << 16)
    while True:
        line = raw.readline()
        while line in (b"\r\n", b"\n"):
            line = raw.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        headers = {}
        while (line := raw.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        block = raw.read(int(headers["content-length"]))
        if len(block) != int(headers["content-length"]):
            raise ValueError("a WARC record is cut short")
        yield headers, block


class _Joined(io.RawIOBase):
    """A stream with the bytes already read put back in front."""

    def __init__(self, head: bytes, rest):
        self.head, self.rest = head, rest

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        got = self.head[: len(into)] or self.rest.read(len(into))
        self.head = self.head[len(got) :] if self.head else b""
        into[: len(got)] = got
        return len(got)

    def read(self, n: int = -1) -> bytes:
        if n is None or n < 0:
            got, self.head = self.head + self.rest.read(), b""
            return got
        if self.head:
            got, self.head = self.head[:n], self.head[n:]
            return got
        return self.rest.read(n)


def _drop_strays(made: DataFrame, folder: str) -> None:
    """Deletes files of tasks that ran again; few, whatever the number of archives."""
    spark = made.sparkSession
    there = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"))
    known = made.select(F.element_at(F.split("path", "/"), -1).alias("name"))
    store, top = _filesystem(folder)
    for r in there.join(known, "name", "left_anti").toLocalIterator():
        store.delete_file(f"{top}/{r.name}")


def read_archives(paths: DataFrame, with_payload: bool = False) -> DataFrame:
    """Records of the archives in ``paths(path)``; the payload digest of responses is computed anew and must agree."""
    names = ["record_no", "uri", "record_type", "refers_to", "payload_bytes", "payload_digest", "warc_record_id", "warc_refers_to", *(["payload"] if with_payload else [])]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *([pa.binary()] if with_payload else [])]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: int(x) if x else None
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, at = _filesystem(path)
                rows, held = [], 0
                with store.open_input_stream(at, compression=None) as stream:
                    for h, block in parse_records(stream):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(re.search(rb"(?i)content-length:\s*(\d+)", http)[1])
                        digest = base64.b32decode(h["warc-payload-digest"].partition(":")[2]).hex()
                        if h["warc-type"] == "response" and (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
                            raise ValueError(f"{path}: the payload of {h['warc-record-id']} does not fit its headers")
                        uri = h["warc-target-uri"] if h.get("x-has-uri") == "1" else None
                        rows.append((number(h.get("x-record-number")), uri, h["warc-type"], number(h.get("x-refers-to-number")), size, digest, h["warc-record-id"], h.get("warc-refers-to"), *([payload] if with_payload else [])))
                        held += len(block) if with_payload else 200
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    schema = "record_no long, uri string, record_type string, refers_to long, payload_bytes long, payload_digest string, warc_record_id string, warc_refers_to string" + ", payload binary" * with_payload
    return map_batches(paths, read, schema)


def dedupe_archives(records: DataFrame, scratch: Scratch, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Resolves, writes and reads back: (archives written, records read from them)."""
    spark = records.sparkSession
    folder = folder or scratch.path("warc")
    made = scratch.write(write_archives(resolve_revisits(records, scratch), folder), "manifest")
    _drop_strays(made, folder)
    scheme = folder.split("://")[0] + "://" if "://" in folder else "file://"
    paths = made.select(F.when(F.col("path").contains("://"), F.col("path")).otherwise(F.concat(F.lit(scheme), "path")).alias("path"))
    return made, read_archives(paths.repartition(max(2, min(made.count(), spark.sparkContext.defaultParallelism * 4))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per row of ``pages``, archives written and read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("record_no"), F.col("url").alias("uri"), F.col("html").cast("binary").alias("payload"))
    _, back = dedupe_archives(pages, Scratch(spark, "warc"))
    return back.select(F.col("record_no").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH r AS (SELECT page_id, octet_length(encode(coalesce(html,''))) AS payload_bytes, sha1(coalesce(html,'')) AS payload_digest FROM pages),
t AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM r)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to FROM t
"""
