"""WARC archives: write, normalise from one gzip stream to a member a record with an offset index, read back."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import open_shared, scratch, ship, stash

ship(__name__)

CRLF = b"\r\n"
CHUNK = 1 << 16
#: The date that every record carries: archives of equal pages are equal byte for byte.
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, size: int) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit with only the HTTP head."""
    head = CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % size, b"", b""])
    block = head if refers_to is not None else head + payload
    clean = "".join(c for c in (url or "") if c >= " " and c != "\x7f")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", clean),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        fields[4:4] = [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", REVISIT)]
    top = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields)
    return top.encode() + CRLF + block + CRLF + CRLF


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of a record."""
    top, _, rest = raw.partition(CRLF + CRLF)
    lines = top.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(fields["content-length"])
    if len(rest) < n:
        raise ValueError("the record is cut off")
    return fields, rest[:n]


def inflated(source) -> Iterator[bytes]:
    """The bytes of a gzip file of any number of members, chunk by chunk."""
    engine = zlib.decompressobj(31)
    while data := source.read(CHUNK):
        while data:
            if out := engine.decompress(data, 1 << 20):
                yield out
            if engine.eof:
                data, engine = engine.unused_data, zlib.decompressobj(31)
            else:
                data = engine.unconsumed_tail


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an uncompressed stream; holds one record at a time."""
    held = bytearray()
    ended = False

    def more() -> bool:
        nonlocal ended
        if ended:
            return False
        part = next(chunks, None)
        if part is None:
            ended = True
            return False
        held.extend(part)
        return True

    while held or more():
        at = 0
        while (end := held.find(b"\r\n\r\n", at)) < 0:
            at = max(0, len(held) - 3)
            if not more():
                raise ValueError("the stream ends inside a record's head")
        fields = dict(x.lower().split(b":", 1) for x in bytes(held[:end]).split(CRLF)[1:])
        size = end + 4 + int(fields[b"content-length"]) + 4
        while len(held) < size:
            if not more():
                raise ValueError("the stream ends inside a record")
        yield bytes(held[:size])
        del held[:size]


def plan(pages: DataFrame, least: int = 100) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is the smallest page_id of the rows with the same
    payload of at least ``least`` bytes, null on that row itself and on payloads of their own."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"),
        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"),
    )
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    shared = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
    shared = stash(shared.where("n > 1 and first is not null").select(F.col("digest").alias("same"), "first"), "payloads")
    joined = rows.join(shared, rows["digest"] == shared["same"], "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_archives(planned: DataFrame, at: str, level: int = 1) -> DataFrame:
    """Write a single-stream .warc.gz a partition under ``at``; (path, records). A retried task writes a file
    of its own name, and only files named in the result count."""

    def run(batches):
        to, engine, n, path = None, None, 0, f"{at}/raw-{uuid.uuid4().hex}.warc.gz"
        for b in batches:
            for page_id, url, payload, digest, refers in zip(*(b.column(i) for i in range(5)), strict=True):
                if to is None:
                    to, engine = open_shared(path, "wb"), zlib.compressobj(level, zlib.DEFLATED, 31)
                payload = payload.as_py()
                raw = record(page_id.as_py(), url.as_py(), payload, digest.as_py(), refers.as_py(), len(payload))
                to.write(engine.compress(raw))
                n += 1
        if to is not None:
            to.write(engine.flush())
            to.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n])], names=["path", "records"])

    return planned.mapInArrow(run, "path string, records long")


def normalise(archives: DataFrame, level: int = 4) -> DataFrame:
    """Rewrite every archive with each record as its own gzip member, and beside it a sidecar index, a line a record:
    offset, length, type and id. Each archive is inflated once, record by record. Returns (path, records) of the new
    archives; the index of x.warc.gz is x.idx."""

    def run(frames):
        for pdf in frames:
            for raw in pdf["path"]:
                path, at, n = raw.replace("/raw-", f"/members-{uuid.uuid4().hex[:8]}-"), 0, 0
                with open_shared(raw, "rb") as source, open_shared(path, "wb") as to, open_shared(path.removesuffix(".warc.gz") + ".idx", "wb") as index:
                    for one in records(inflated(source)):
                        engine = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = engine.compress(one) + engine.flush()
                        to.write(member)
                        fields, _ = parse(one)
                        index.write(f"{at} {len(member)} {fields['warc-type']} {fields['warc-record-id']}\n".encode())
                        at += len(member)
                        n += 1
                yield pd.DataFrame([(path, n)], columns=["path", "records"])

    return archives.select("path").mapInPandas(run, "path string, records long")


def read_index(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The sidecar index files as rows (offset, length, type, record_id, file), file being the index's name."""
    rows = spark.read.schema("offset long, length long, type string, record_id string").csv(paths, sep=" ")
    return rows.select("*", F.col("_metadata.file_name").alias("file"))


def indexed(archives: DataFrame, at: str) -> DataFrame:
    """(path, offset, length) of every record of the archives (path) under ``at``, from their sidecar indexes; what
    a task that was run again has left there is in no archive's name and doesn't count."""
    spark = archives.sparkSession
    if not archives.limit(1).count():
        return spark.createDataFrame([], "path string, offset long, length long")
    named = archives.select("path", F.regexp_replace(F.substring_index("path", "/", -1), r"\.warc\.gz$", ".idx").alias("file"))
    rows = read_index(spark, f"{at}/members-*.idx").join(named, "file").select("path", "offset", "length")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return rows.repartition(parts, "path").sortWithinPartitions("path", "offset")


def read_records(index: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of every indexed record,
    each inflated from its own member; a response's digest and length are taken from its payload."""

    def run(batches):
        at, source = None, None
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for path, offset, length in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if path != at:
                    if source is not None:
                        source.close()
                    at, source = path, open_shared(path, "rb")
                source.seek(offset)
                fields, block = parse(zlib.decompress(source.read(length), 31))
                head, _, payload = block.partition(CRLF + CRLF)
                number = lambda name: int(x) if (x := fields[name].removeprefix("<urn:page:").removesuffix(">")) else None
                digest, size = fields["warc-payload-digest"].removeprefix("sha256:"), len(payload)
                if fields["warc-type"] == "revisit":
                    size = next(int(x.split(b":")[1]) for x in head.split(CRLF) if x.lower().startswith(b"content-length:"))
                elif hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"{path} at {offset}: the payload doesn't have its digest")
                refers = number("warc-refers-to") if fields["warc-type"] == "revisit" else None
                row = (number("warc-record-id"), fields["warc-target-uri"], size, digest, fields["warc-type"], refers, payload)
                for to, x in zip(out, row, strict=True):
                    to.append(x)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
            names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=names)
        if source is not None:
            source.close()

    return index.select("path", "offset", "length").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def round_trip(pages: DataFrame, at: str | None = None) -> DataFrame:
    """Write pages as archives under ``at`` (a new folder of the shared one by default), normalise them, and
    read every record back through the index.

    Nulls: a null html is the empty payload, a null url an empty target; a null page_id gives a record without
    a number, that revisits a numbered equal one and is never referred to. Rows that repeat the smallest
    page_id of equal payloads are all responses. An empty table writes nothing and gives no rows. Columns
    other than page_id, url and html are ignored.
    """
    spark = pages.sparkSession
    at = at or scratch(spark, "warc")
    archives = stash(write_archives(plan(pages), at), "archives")
    slots = spark.sparkContext.defaultParallelism
    members = stash(normalise(archives.repartition(4 * slots)), "members")
    return read_records(indexed(members, at))
