import gzip
import hashlib
from pathlib import Path

from tarnlight.llm import common
from tarnlight.llm import warc as W


def pages(spark, rows):
    return spark.createDataFrame([(k, u, h, "x", 5) for k, u, h in rows], "page_id long, url string, html string, digest string, total long")


LONG = "é<p>\r\n\r\nWARC/1.1\r\nline\n" * 4000
ROWS = [
    (5, "http://a/ b\nc", "x" * 100), (3, "http://b", "x" * 100), (9, None, "x" * 100), (4, "u", "x" * 99), (6, "u", "x" * 99), (7, "u", None), (8, "u", ""),
    (10, "u", LONG), (2, "u", LONG), (11, "u", "WARC/1.1\r\n\r\n" * 30), (12, "u", "ends with feed\n" * 10 + "\n"), (13, "u", "\x00\x01" * 90), (20, "u", "one payload" * 20), (20, "u", "another payload" * 20), (21, "u", "one payload" * 20), (None, "u", "z" * 200), (30, "u", LONG[:-1]), (30, "u", LONG[:-1]),
]


def brute(rows):
    """A record for every row, also repeated ones and those without a page_id, as the SQL has it."""
    records = [(k, (h or "").encode()) for k, _, h in rows]
    out = []
    for k, data in records:
        first = min((q for q, d in records if d == data and q is not None), default=None)
        to = first if len(data) >= 100 and k is not None and first != k else None
        out.append((k, len(data), hashlib.sha256(data).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=repr)


def round_trip(spark, rows, size):
    chunks = common.staged(W.chunk_table(pages(spark, rows), size), "chunks")
    path = common.staged_path(spark, "warc")
    W.write(chunks, common.staged(W.roles(chunks), "roles"), path)
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in W.read(spark, path).collect()]
    return chunks, path, sorted(got, key=repr)


def test_round_trip_with_small_and_large_chunks(spark):
    for size in (W.CHUNK, 1000, 7):
        rows = ROWS if size > 7 else [r for r in ROWS if len(r[2] or "") < 1000]
        chunks, _, got = round_trip(spark, rows, size)
        assert got == brute(rows)
        assert chunks.selectExpr("max(length(bytes))").first()[0] <= size
        assert chunks.where("last").count() == chunks.select("record").distinct().count() == len(rows)
        assert chunks.groupBy("record").agg({"chunk": "max", "*": "count"}).where("`max(chunk)` + 1 <> `count(1)`").count() == 0


def test_archives_are_warc(spark):
    _, path, _ = round_trip(spark, ROWS, 1000)
    payload, kinds, totals = {}, set(), []
    for f in Path(path.removeprefix("file:")).glob("*.gz"):
        records = list(W.parse(gzip.open(f)))
        assert len(records) <= W.RECORDS_PER_FILE
        for h, body in records:
            assert h["warc-record-id"].startswith("<urn:uuid:") and len(h["warc-record-id"]) == 47 and "\n" not in h["warc-target-uri"]
            kinds.add(h["warc-type"])
            if "warc-segment-total-length" in h:
                totals.append(h["warc-segment-total-length"] == h["x-payload-length"])
            if h["warc-type"] != "revisit":
                payload.setdefault((h["x-page-id"], h["warc-payload-digest"]), {})[int(h.get("warc-segment-number", 1))] = bytes(body)
    assert kinds == {"response", "revisit", "continuation"}
    assert len(totals) >= 2 and all(totals)
    whole = {k: b"".join(v[i] for i in sorted(v)) for k, v in payload.items()}
    assert whole["2", "sha256:" + hashlib.sha256(LONG.encode()).hexdigest()] == LONG.encode()
    assert all("sha256:" + hashlib.sha256(v).hexdigest() == k[1] for k, v in whole.items())


def test_empty_table(spark):
    _, _, got = round_trip(spark, [], 1000)
    assert got == []
