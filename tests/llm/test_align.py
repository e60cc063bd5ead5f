"""The alignment against one token at a time in plain Python."""

import hashlib
import random

import pytest

from tarnlight.llm import align

from .util import docs


def brute(texts, both=align.tokenizers()):
    found, corpus = [], {}
    for text in texts:
        raw = (" " + text).encode() if text else b""
        a = both.plain.encode(" " + text, add_special_tokens=False).ids if text else []
        b = both.pieces.encode(text) if text else []
        if b"".join(both.bytes_a[i] for i in a) != raw or b"".join(both.bytes_b[i] for i in b) != raw:
            a = b = []
        spans = []
        for ids, table in ((a, both.bytes_a), (b, both.bytes_b)):
            at, out = 0, []
            for i in ids:
                out.append((at, at + len(table[i]), i))
                at += len(table[i])
            spans.append(out)
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, lo = [], 0
        for hi in cuts:
            groups.append("|".join(",".join(str(i) for s, e, i in side if lo <= s and e <= hi) for side in spans))
            lo = hi
        links = [(x, y) for s, e, x in spans[0] for t, u, y in spans[1] if s < u and t < e]
        for p in set(links):
            corpus[p] = corpus.get(p, 0) + 1
        found.append((a, b, groups, links))
    best = {}
    for (x, _), n in corpus.items():
        best[x] = max(best.get(x, 0), n)
    return [
        (len(a), len(b), len(g), len(ln), sum(corpus[p] == best[p[0]] for p in ln), sum(corpus[p] for p in ln), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "")
        for a, b, g, ln in found
    ]


def texts():
    rng = random.Random(3)
    words = ["the", "tokenizer", "naïve", "Größe", "don't", "x=1;", "日本語", "🙂👍", "1,234.5", "aaaaaaa", "<|endoftext|>", "</s>", "\n", "\t", "  ", "été", "é", "▁", "\x00", "<0x0A>"]
    made = [" ".join(rng.choices(words, k=rng.randrange(1, 25))) for _ in range(60)]
    return [*made, None, "", " ", "\n", "a", made[0], made[0], "word " * 3000, "<|endoftext|>"]


@pytest.mark.parametrize("block", [1, 300, align.BLOCK_BYTES])
def test_alignment_equals_brute_force(spark, block):
    rows = texts()
    got = align.align(docs(spark, list(enumerate(rows))).repartition(3), block).collect()
    assert len(got) == len(rows)
    columns = (*align.COUNTS, "n_best", "count_sum", "groups_sha256")
    assert {r["doc_id"]: tuple(r[c] for c in columns) for r in got} == dict(enumerate(brute(rows)))


def test_marks_are_counted_in_windows(monkeypatch):
    import numpy as np

    monkeypatch.setattr(align, "MARK_BYTES", 4)
    ends = np.array([1, 3, 4, 8, 9])
    assert np.flatnonzero(align._marks(ends, 9)).tolist() == ends.tolist()


def test_repeated_and_missing_ids_and_no_rows(spark):
    got = align.align(docs(spark, [(1, "one two"), (1, "one three"), (None, "one")])).collect()
    assert sorted((r["doc_id"] is None, r["n_links"] > 0) for r in got) == [(False, True), (False, True), (True, True)]
    assert align.align(docs(spark, [(1, "x")]).limit(0)).collect() == []


def test_query_equals_brute_force(spark, tmp_path):
    rows = texts()
    docs(spark, list(enumerate(rows))).write.parquet(f"{tmp_path}/documents.parquet")
    got = align.op12_alignment(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["n_best"], r["count_sum"]) for r in got) == [(k, x[4], x[5]) for k, x in enumerate(brute(rows))]


def test_pairs_are_dealt_in_narrow_rows_of_any_batches(spark):
    """Rows of pairs once held empty columns for all that a block has, which cost more than the pairs."""
    rows = texts()
    blocks = align.aligned_blocks(docs(spark, list(enumerate(rows))).repartition(2), 300)
    assert blocks.columns == ["block", "pairs", "holding", "rest"] and blocks.count() > 3
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = align.documents(blocks, align.pair_counts(blocks)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    columns = (*align.COUNTS, "n_best", "count_sum", "groups_sha256")
    assert {r["doc_id"]: tuple(r[c] for c in columns) for r in got} == dict(enumerate(brute(rows)))
