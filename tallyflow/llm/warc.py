"""WARC archives: writing, normalising to one gzip member a record, indexing, reading (operator 3).

``write_archives`` writes each task's records as one whole-file gzip stream,
as monolithic archives come.  ``normalise`` inflates each such stream once and
writes every record as a gzip member of its own; ``write_index`` writes the
sidecar index (archive, offset, length, record id, type), with which
``read_records`` inflates single members.

Files are written by Spark's own committer, so lost tasks leave nothing, and
any file system that Spark knows will do.  The text sink writes bytes as they
are and ends each row with the separator; with a zero byte as separator, the
stream split at its zero bytes gives exactly its bytes again (and at most one
zero at the end, which gzip defines as padding).

A file's size is that of a task's share of the rows; a task streams its
records and holds one archive at a time.

Payloads that are read back are compared with their digests, and revisits with
the responses that they name.

Edge cases: a null html is an empty payload.  A null url leaves its header
out; control characters in it are percent-encoded.  Repeated page ids give
repeated records.  A null page_id is written as such and read back as null; it
is the response of no other page.  Of rows that share both the largest id and
the payload all are responses.  Further columns are ignored, whatever their
names.  An empty table gives archives without records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange

REVISIT_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SUFFIX = ".warc.gz"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
INDEX = "archive string, offset long, length long, record_id string, record_type string"


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, digest (hex) and refers_to: of equal payloads the largest id is the response."""
    rows = pages.select(exchange.quoted(id_col).cast("long").alias("page_id"), exchange.quoted(url_col).cast("string").alias("url"), F.encode(F.coalesce(exchange.quoted(html_col), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    same = rows.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("first")).where("n > 1")
    # written first, so its size is known: Spark sends it to all tasks if it is small, and else sorts both sides, splitting hot digests
    same = exchange.materialize(same.select(F.col("digest").alias("d"), "first"), "payloads")
    out = rows.join(same, F.col("digest") == F.col("d"), "left")
    return out.select("page_id", "url", "payload", "digest", F.when((F.col("page_id") != F.col("first")) | (F.col("page_id").isNull() & F.col("first").isNotNull()), F.col("first")).alias("refers_to"))


def urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def page_of(name: str | None) -> int | None:
    return None if name is None or name.endswith(":null>") else int(name[len("<urn:x-page:") : -1])


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit holds the HTTP header of the full payload, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(), "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Header fields (lower-case names) and block of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    return fields | {"block": rest[: int(fields["content-length"])]}


def records_of(stream) -> object:
    """Cut a stream of byte strings to whole records, holding one record at a time."""
    held = bytearray()
    need = None
    for chunk in stream:
        held += chunk
        while True:
            if need is None:
                at = held.find(b"\r\n\r\n")
                if at < 0:
                    break
                size = re.search(rb"(?i)\r\nContent-Length: *(\d+)", held[:at])
                need = at + 4 + int(size[1]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise ValueError("an archive ends inside a record")


def inflated(content: memoryview, step: int = 1 << 18):
    """The bytes of a gzip file, whatever its members; zero padding at the end is no member."""
    coder, at = zlib.decompressobj(31), 0
    while at < len(content):
        chunk = content[at : at + step]
        at += len(chunk)
        yield coder.decompress(chunk)
        while coder.eof:
            rest = coder.unused_data
            coder = zlib.decompressobj(31)
            if not rest.strip(b"\0") and not bytes(content[at : at + 1]).strip(b"\0"):
                return
            yield coder.decompress(rest)


def _rows_of_bytes(chunks):
    """Pieces between zero bytes, for the text sink; the last separator ends the file."""
    held = b""
    for chunk in chunks:
        parts = (held + chunk).split(b"\0")
        held = parts.pop()
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary())], ["b"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([held], pa.binary())], ["b"])


def _write_bytes(df: DataFrame, path: str) -> None:
    """One file a task, of the bytes in column b; then give the files their archive names."""
    spark = df.sparkSession
    df.select(F.col("b").cast("string").alias("value")).write.option("lineSep", "\0").text(path)
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for i, status in enumerate(sorted(fs.listStatus(top), key=lambda s: s.getPath().getName())):
        if status.getPath().getName().startswith("part-"):
            if status.getLen():
                fs.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(top, f"{uuid.uuid4().hex[:8]}-{i:06d}{SUFFIX}"))
            else:
                fs.delete(status.getPath(), False)


def write_archives(rows: DataFrame, path: str, level: int = 3) -> None:
    """Write ``with_revisits`` rows as monolithic archives, one gzip stream a file."""
    exchange.ship(rows.sparkSession)

    def write(batches):
        def stream():
            coder, any_row = zlib.compressobj(level, zlib.DEFLATED, 31), False
            for b in batches:
                for i, u, p, d, r in zip(*(c if j == 2 else c.to_pylist() for j, c in enumerate(b.columns)), strict=True):
                    any_row = True
                    yield coder.compress(record(i, u, p.as_py(), d, r))
            if any_row:
                yield coder.flush()

        yield from _rows_of_bytes(stream())

    _write_bytes(rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(write, "b binary"), path)


def archives(spark: SparkSession, path: str) -> DataFrame:
    """archive (file name) and content of each archive below ``path``."""
    return spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", f"*{SUFFIX}").load(path).select(F.substring_index("path", "/", -1).alias("archive"), "content")


def normalise(spark: SparkSession, source: str, target: str, level: int = 6) -> None:
    """Inflate each archive below ``source`` once and write every record as its own member below ``target``."""
    exchange.ship(spark)

    def rewrite(batches):
        def stream():
            for b in batches:
                for content in b.column(0):
                    for r in records_of(inflated(memoryview(content.as_buffer()))):
                        coder = zlib.compressobj(level, zlib.DEFLATED, 31)
                        yield coder.compress(r) + coder.flush()

        yield from _rows_of_bytes(stream())

    _write_bytes(archives(spark, source).select("content").mapInArrow(rewrite, "b binary"), target)


def members(content: memoryview):
    """(offset, length, bytes) of each member of a normalised archive."""
    at = 0
    while at < len(content) and content[at]:
        coder, out, start = zlib.decompressobj(31), [], at
        while not coder.eof and at < len(content):
            chunk = content[at : at + (1 << 16)]
            out.append(coder.decompress(chunk))
            at += len(chunk) - len(coder.unused_data)
        yield start, at - start, b"".join(out)


def write_index(spark: SparkSession, path: str, target: str) -> None:
    """The sidecar of the archives below ``path``: where each record's member is."""

    def scan(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = []
                for offset, length, raw in members(memoryview(content.as_buffer())):
                    f = parse(raw)
                    rows.append((name, offset, length, f["warc-record-id"], f["warc-type"]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["archive", "offset", "length", "record_id", "record_type"])

    archives(spark, path).mapInArrow(scan, INDEX).write.parquet(target)


def read_records(spark: SparkSession, path: str, index: str) -> DataFrame:
    """The records of normalised archives, each inflated at the place that the index gives.

    Archives meet their part of the index, two numbers a record; it is written
    first, so its size is known: Spark sends it to all tasks if it is small.
    """
    exchange.ship(spark)
    at = spark.read.schema(INDEX).parquet(index).groupBy("archive").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("at"))
    held = archives(spark, path).join(exchange.materialize(at, "places"), "archive").select("content", "at")

    def read(batches):
        for b in batches:
            for content, places in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                raw = memoryview(content.as_buffer())
                for k in range(0, len(places), 256):
                    yield _decoded([zlib.decompress(raw[p["offset"] : p["offset"] + p["length"]], 31) for p in places[k : k + 256]])

    return held.mapInArrow(read, RECORD)


def _decoded(raws: list[bytes]) -> pa.RecordBatch:
    rows = []
    for raw in raws:
        f = parse(raw)
        head, _, payload = f["block"].partition(b"\r\n\r\n")
        size = int(re.search(rb"(?i)\r\nContent-Length: *(\d+)", head)[1])
        digest = base64.b32decode(f["warc-payload-digest"].removeprefix("sha1:")).hex()
        if f["warc-type"] == "response" and (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
            raise ValueError(f"the payload of record {f['warc-record-id']} is not the one that was written")
        rows.append((page_of(f["warc-record-id"]), f.get("warc-target-uri"), size, digest, f["warc-type"], page_of(f.get("warc-refers-to")), None if f["warc-type"] == "revisit" else payload))
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])


def resolved(records: DataFrame) -> DataFrame:
    """Records without payloads, where a revisit has the size of the response that it names, of the same digest; fails if there is none."""
    names = [c for c in records.columns if c not in ("payload", "url")]
    records = exchange.materialize(records.select(*names), "records")
    revisit = F.col("record_type") == "revisit"
    full = records.where(~revisit & F.col("page_id").isNotNull()).groupBy(F.col("page_id").alias("p"), F.col("payload_digest").alias("d")).agg(F.max("payload_bytes").alias("size"))
    found = exchange.lookup(records.where(revisit), full, {"k1": F.bitwise_not("refers_to"), "k2": F.reverse("payload_digest")}, {"k1": F.bitwise_not("p"), "k2": F.reverse("d")})
    missing = F.raise_error(F.lit("a revisit names a response that is not there")).cast("long")
    found = found.withColumn("payload_bytes", F.coalesce("size", missing)).select(*names)
    return records.where(~revisit).unionByName(found)


def scan_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of normalised archives, member after member, without the index."""
    exchange.ship(spark)

    def scan(batches):
        for b in batches:
            for content in b.column(0):
                raws: list[bytes] = []
                for _, _, raw in members(memoryview(content.as_buffer())):
                    raws.append(raw)
                    if len(raws) == 256:
                        yield _decoded(raws)
                        raws = []
                if raws:
                    yield _decoded(raws)

    return archives(spark, path).select("content").mapInArrow(scan, RECORD)


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
