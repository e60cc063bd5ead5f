"""WARC archives through a chunked record table.

A payload becomes rows (record, chunk number, bytes) of bounded size, each with the digest of the payload up to and
including it.  Spark cuts payloads into pieces before any are encoded, and digests are carried from piece to piece, so no
task encodes, digests, writes or parses more of a record than one chunk.  Of records with equal payloads the smallest page_id
is the response and the others revisit it.  Archives are written by Spark, one segment record a chunk (WARC 1.1
continuation records for all but the first), and read back by Spark.
"""

from __future__ import annotations

import gzip
import hashlib
import io

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Payload bytes in a chunk at most, and segment records in an archive file at most: together they bound a file by 128 MB.
CHUNK, RECORDS_PER_FILE = 256 * 1024, 512
#: Payloads below this size are never revisited.
MIN_REVISIT = 100
#: Shared payloads whose responses are broadcast; more are joined by a shuffle.
BROADCAST_PAYLOADS = 1_000_000
#: The time that records carry: a run's own, or this one where results must not depend on the clock.
DATE = "1970-01-01T00:00:00Z"
CHUNKS = "page_id long, record long, url string, chunk long, last boolean, bytes binary, total long, digest string"


def chunk_table(pages: DataFrame, size: int = CHUNK) -> DataFrame:
    """CHUNKS rows of every row of ``pages`` (page_id, url, html): digest and total run up to and including the chunk.

    A record is a row, also one that repeats another or has a null page_id, and is numbered by its place; store the table before
    it is used twice.  A null html is an empty payload, one empty chunk.
    """
    chars = max(1, size // 4)  # of at most four bytes each
    html = F.coalesce("html", F.lit(""))
    # a row's pieces stay together and in order
    pieces = F.when(F.length(html) <= chars, F.array(html)).otherwise(F.regexp_extract_all(html, F.lit(f"(?s).{{1,{chars}}}"), F.lit(0)))
    cut = pages.select("page_id", "url", pieces.alias("pieces")).select("page_id", "url", F.size("pieces").alias("n"), F.posexplode("pieces").alias("chunk", "piece"))

    def run(batches):
        record, h, total = TaskContext.get().partitionId() << 40, None, 0
        for b in batches:
            out, held = [], 0
            for page_id, url, n, k, piece in zip(*b.columns, strict=True):
                data, k, n = piece.as_py().encode("utf-8", "surrogatepass"), k.as_py(), n.as_py()
                if k == 0:
                    record, h, total = record + 1, hashlib.sha256(), 0
                h.update(data)
                total += len(data)
                out.append((page_id.as_py(), record, url.as_py(), k, k == n - 1, data, total, h.hexdigest()))
                held += len(data)
                if held >= 8 * size:
                    yield _batch(out)
                    out, held = [], 0
            if out:
                yield _batch(out)

    return cut.mapInArrow(run, CHUNKS)


def _batch(rows) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["page_id", "record", "url", "chunk", "last", "bytes", "total", "digest"])


def roles(chunks: DataFrame) -> DataFrame:
    """(record, payload_bytes, payload_digest, refers_to, origin) of each record; refers_to, a page_id, is null for responses.

    ``origin`` is the record that is referred to.  Sizes and digests stand in the last chunks; the digests are grouped with map-side
    minima, so a payload that a third of all pages share costs a row a task.  Records that repeat the smallest page_id of a
    payload are all responses, and so are those without a page_id.
    """
    whole = chunks.where("last").select("page_id", "record", F.col("total").alias("payload_bytes"), F.col("digest").alias("payload_digest"))
    first = whole.where(f"payload_bytes >= {MIN_REVISIT} and page_id is not null").groupBy("payload_digest").agg(F.min(F.struct("page_id", "record")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = common.staged(first, "warc-shared")
    both = whole.join(F.broadcast(first) if first.count() <= BROADCAST_PAYLOADS else first, "payload_digest", "left")
    other = F.col("first.page_id") != F.col("page_id")
    return both.select("record", "payload_bytes", "payload_digest", F.when(other, F.col("first.page_id")).alias("refers_to"), F.when(other, F.col("first.record")).alias("origin"))


def _record_id(name: Column) -> Column:
    """A record id made from its name, so that a rerun task writes the same record."""
    h = F.md5(F.concat(F.lit("page:"), name))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def write(chunks: DataFrame, role: DataFrame, path: str, date: str = DATE) -> None:
    """Archives of all records at ``path``: responses in segments with their payload, revisits without one.

    Text files with one segment record a row: the writer's line feed ends the record's final CRLF pair.
    """
    row = chunks.join(role, "record").where("refers_to is null or chunk = 0")
    body = F.when(F.col("refers_to").isNull(), F.col("bytes")).otherwise(F.lit(b""))
    kind = F.when(F.col("refers_to").isNotNull(), "revisit").when(F.col("chunk") == 0, "response").otherwise("continuation")
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7f]", "")
    own = F.concat_ws("/", "record", "payload_digest")
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), F.when(F.col("chunk") == 0, _record_id(own)).otherwise(_record_id(F.concat_ws("/", own, "chunk"))),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), uri, F.lit("\r\nX-Page-ID: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("payload_digest"), F.lit("\r\nX-Payload-Length: "), F.col("payload_bytes").cast("string"),
        F.when(F.col("refers_to").isNotNull(), F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), _record_id(F.concat_ws("/", "origin", "payload_digest")), F.lit("\r\nX-Refers-To-Page-ID: "), F.col("refers_to").cast("string"))).otherwise(""),
        F.when(F.col("refers_to").isNull() & ((F.col("chunk") > 0) | ~F.col("last")), F.concat(F.lit("\r\nWARC-Segment-Number: "), (F.col("chunk") + 1).cast("string"))).otherwise(""),
        F.when(kind == "continuation", F.concat(F.lit("\r\nWARC-Segment-Origin-ID: "), _record_id(own))).otherwise(""),
        F.when((kind == "continuation") & F.col("last"), F.concat(F.lit("\r\nWARC-Segment-Total-Length: "), F.col("payload_bytes").cast("string"))).otherwise(""),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    record = F.concat(F.encode(header, "utf-8"), body, F.lit(b"\r\n\r")).cast("string")
    row.select(record.alias("value")).write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse(archive):
    """(headers, body) of each record of an archive, a binary file that is read record by record, by Content-Length."""
    while line := archive.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record at {line[:40]!r}")
        headers = {}
        while (line := archive.readline()) != b"\r\n":
            key, _, value = line.partition(b":")
            headers[key.decode().lower()] = value.strip().decode("utf-8", "surrogatepass")
        yield headers, archive.read(int(headers["content-length"]))
        if archive.read(4) != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its length says")


SEGMENTS = "page_id long, record string, segment long, kind string, refers_to long, stated string, payload_bytes long, size long, bytes binary, digest string"
SUMS = "page_id long, payload_bytes long, payload_digest string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives at ``path``: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A task holds a file as it is stored, and one segment of it unpacked.  Sizes and digests are those of the bytes read: a record
    of one segment is digested where it is read, the segments of a longer one in order, chunk by chunk.
    """

    def records(batches):
        types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string())
        make = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[x.split()[0] for x in SEGMENTS.split(", ")])
        for b in batches:
            for (content,) in common.rows(b, "content"):
                out, held = [], 0
                for h, body in parse(gzip.GzipFile(fileobj=io.BytesIO(content))):
                    alone = "warc-segment-number" not in h
                    page, refers = h["x-page-id"], h.get("x-refers-to-page-id")
                    stated = h["warc-payload-digest"].removeprefix("sha256:")
                    record = h.get("warc-segment-origin-id", h["warc-record-id"])
                    out.append((int(page) if page else None, record, int(h.get("warc-segment-number", 1)), h["warc-type"], refers and int(refers), stated, int(h["x-payload-length"]), len(body), None if alone else body, hashlib.sha256(body).hexdigest() if alone and not refers else None))
                    held += 0 if alone else len(body)
                    if held >= 8 * CHUNK:
                        yield make(out)
                        out, held = [], 0
                if out:
                    yield make(out)

    def joined(batches):
        of, page, h, size = None, None, None, 0
        for b in batches:
            out = []
            for record, page_id, data in common.rows(b, "record", "page_id", "bytes"):
                if record != of:
                    if of is not None:
                        out.append((page, size, h.hexdigest()))
                    of, page, h, size = record, page_id, hashlib.sha256(), 0
                h.update(data)
                size += len(data)
            yield _sums(out)
        if of is not None:
            yield _sums([(page, size, h.hexdigest())])

    def _sums(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[], [], []], (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["page_id", "payload_bytes", "payload_digest"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    seen = common.staged(files.mapInArrow(records, SEGMENTS), "warc-segments")
    one = seen.where("bytes is null").select("page_id", F.when(F.col("kind") == "revisit", F.col("payload_bytes")).otherwise(F.col("size")).alias("payload_bytes"), F.coalesce("digest", "stated").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")
    long = seen.where("bytes is not null").select("record", "page_id", "segment", "bytes").repartition("record").sortWithinPartitions("record", "segment").mapInArrow(joined, SUMS)
    return one.unionByName(long.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")))


def op8_warc(spark, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record and read back from the archives."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    table, path = (common.staged_path(spark, x) for x in ("warc-chunks", "warc"))
    chunks = common.staged(chunk_table(pages), "warc-chunks", table)
    write(chunks, common.staged(roles(chunks), "warc-roles"), path)
    common.drop_staged(spark, table)
    return read(spark, path)


OP8_SQL = f"""
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select payload_digest, min(page_id) as first from p group by payload_digest),
r as (select p.*, case when payload_bytes >= {MIN_REVISIT} and first <> page_id then first end as refers_to from p join f using (payload_digest))
select page_id, payload_bytes, payload_digest, case when refers_to is null then 'response' else 'revisit' end as record_type, refers_to from r"""
