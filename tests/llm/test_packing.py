import math
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tarnlight.llm import packing as P

from .util import docs


def reference_ids(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [np.array(t.encode(x or "", add_special_tokens=False).ids + [0], dtype="<u4") for x in texts]


ODD = ["", "a", " ", "\n\n \t x", "don't we'll I'D", "naïve Größe é̀ 漢字 🙂", "<|endoftext|> in text<|endoftext|>", "1234 5 67890 !!??", "\x00\x01﻿", "x" * 5000, "a " * 3000]


def test_ids_equal_the_tokenizer():
    r = random.Random(0)
    texts = ODD + ["".join(r.choice("ab c'd9é\n ſ<|>漢🙂-") for _ in range(80)) for _ in range(300)]
    encode = P.encoder()
    for text, want in zip(texts, reference_ids(texts), strict=True):
        assert np.array_equal(np.append(encode(text), 0), want), repr(text[:60])


LONG = [c * 1_000_000 for c in (" ", "\n", "\t", "\u3000", "a", "!", "é", "1", " a", "\t \n")] + ["word " + " " * 1_000_000 + "end", "漢" * 200_000]


def test_very_long_runs(spark):
    encode = P.encoder()
    for text, want in zip(LONG, reference_ids(LONG), strict=True):
        assert np.array_equal(np.append(encode(text), 0), want), repr(text[:20])
    rows = list(enumerate(LONG))
    check([p.asDict() for p in P.pack(docs(spark, rows)).collect()], rows)


def test_any_number_of_equal_rests(spark):
    rows = [(k, "the same words in every document") for k in range(500)] + [(7, "the same words in every document")] * 20
    table = P.pack(docs(spark, rows), shard_rows=40)
    sizes = check([p.asDict() for p in table.collect()], rows)
    assert sum(s < 1024 for s in sizes) <= 8


def check(pieces, rows, window=1024):
    """Every token of every row in one piece, sequences gapless and within the window."""
    want = {}
    for (d, _), ids in zip(rows, reference_ids([t for _, t in rows]), strict=True):
        want.setdefault(d, []).append(ids)
    got = {}
    for p in pieces:
        got.setdefault(p["doc_id"], []).append(p)
    assert got.keys() == want.keys()
    for d, mine in got.items():
        assert sum(p["length"] for p in mine) == sum(map(len, want[d]))
        if len(want[d]) == 1:
            (ids,), at = want[d], 0
            for p in sorted(mine, key=lambda p: p["start"]):
                assert p["start"] == at and p["doc_tokens"] == len(ids)
                assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
                at += p["length"]
    seqs = {}
    for p in pieces:
        seqs.setdefault(p["sequence_id"], []).append(p)
    for mine in seqs.values():
        at = 0
        for p in sorted(mine, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window
    return [sum(p["length"] for p in s) for s in seqs.values()]


def test_every_token_once_and_little_padding(spark):
    r = random.Random(1)
    rows = [(k, " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) + str(r.randrange(50)) for _ in range(r.randint(1, 900)))) for k in range(60)]
    rows += [(100 + k, t) for k, t in enumerate(ODD)] + [(200, None), (None, "no id"), (300, "twice"), (300, "twice")]
    table = P.pack(docs(spark, rows), shard_rows=20)
    sizes = check([p.asDict() for p in table.collect()], rows)
    assert sum(s < 1024 for s in sizes) <= 6
    assert table.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert P.pack(docs(spark, [])).count() == 0


def test_bm25_scores_match_the_formula():
    rng = np.random.default_rng(0)
    rests = [rng.integers(0, 30, rng.integers(1, 40)) for _ in range(15)]
    df = np.array([sum(t in r for r in rests) for t in range(30)])
    idf = np.maximum(0.0, np.log((15 - df + 0.5) / (df + 0.5)))
    mean = np.mean([len(r) for r in rests])
    index = P.Index(rests, idf, mean)
    for k in range(15):
        want = [sum(idf[t] * c * (P.K1 + 1) / (c + P.K1 * (1 - P.B + P.B * len(r) / mean)) for t in set(rests[k].tolist()) if (c := int((r == t).sum()))) for r in rests]
        assert np.allclose(index.scores(k), want)


def test_neighbours_come_from_the_whole_corpus(spark):
    r = random.Random(3)
    # 30 topics of 12 documents; a window holds about 4
    words = [["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(40)] for _ in range(30)]
    rows = [(100 * t + k, " ".join(r.choice(words[t]) for _ in range(90))) for t in range(30) for k in range(12)]
    r.shuffle(rows)
    pieces = [p.asDict() for p in P.pack(docs(spark, rows), shard_rows=20).collect()]
    check(pieces, rows)
    by = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        by.setdefault(p["sequence_id"], []).append(p["doc_id"] // 100)
    near = [t == mine[0] for mine in by.values() for t in mine[1:]]
    assert sum(near) > 0.7 * len(near)
    # the first window against BM25 by brute force over all rests
    ids = dict(zip((d for d, _ in rows), reference_ids([x for _, x in rows]), strict=True))
    df = {}
    for x in ids.values():
        for t in set(x.tolist()):
            df[t] = df.get(t, 0) + 1
    n, mean = len(ids), np.mean([len(x) for x in ids.values()])
    least = min(p["sequence_id"] for p in pieces)
    seed, *rest = [p["doc_id"] for p in sorted((p for p in pieces if p["sequence_id"] == least), key=lambda p: p["offset"])]

    def score(d):
        x, total = ids[d].tolist(), 0.0
        for t in set(ids[seed].tolist()) & set(x):
            c = x.count(t)
            total += max(0.0, math.log((n - df[t] + 0.5) / (df[t] + 0.5))) * c * (P.K1 + 1) / (c + P.K1 * (1 - P.B + P.B * len(x) / mean))
        return total

    want = sorted((d for d in ids if d != seed), key=lambda d: -score(d))[: len(rest)]
    assert rest == want


def test_neighbours_fill_the_window():
    a, b = np.array([1, 2, 3, 4]), np.array([11, 12, 13, 14])
    rests = [a, b, a[::-1], b[::-1], np.array([1, 2, 11])]
    idf = np.full(20, math.log(2.0))
    got = P.fill(rests, idf, 4.0, window=8)
    by = {}
    for k, _, _, seq, _ in got:
        by.setdefault(seq, []).append(k)
    assert by[0] == [0, 2] and by[1] == [1, 3] and by[2] == [4]
