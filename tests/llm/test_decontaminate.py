import random
import time

import numpy as np

from tarnlight.llm import common
from tarnlight.llm import decontaminate as D

from .util import docs


def brute(item, doc, n):
    """Greedy tiling straight from its definition."""
    a, b, out = [False] * len(item), [False] * len(doc), []
    while True:
        best = None
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k] and not a[i + k] and not b[j + k]:
                    k += 1
                if k >= n and (best is None or (-k, i, j) < best):
                    best = (-k, i, j)
        if best is None:
            return out
        k, i, j = -best[0], best[1], best[2]
        a[i : i + k] = [True] * k
        b[j : j + k] = [True] * k
        out.append((k, i, j))


def test_tiles_match_the_definition():
    r = random.Random(0)
    for _ in range(300):
        item = np.array([r.randrange(4) for _ in range(r.randint(3, 14))], dtype=np.uint64) + np.uint64(1)
        doc = np.array([r.randrange(4) for _ in range(r.randint(0, 25))], dtype=np.uint64) + np.uint64(1)
        found = list(D.Block([(1, item)], 3).matches(doc, D.Powers()))
        tiles = found[0][1] if found else []
        assert sum(t[0] for t in tiles) == sum(t[0] for t in brute(item.tolist(), doc.tolist(), 3))
        assert tiles == brute(item.tolist(), doc.tolist(), 3)


def test_rolling_hash_equals_window_equality():
    rng = np.random.default_rng(0)
    words = common.mix(rng.integers(0, 3, 500).astype(np.uint64))
    h = D.windows(words, 4, D.Powers())
    keys = [tuple(words[i : i + 4]) for i in range(497)]
    assert len(set(h.tolist())) == len(set(keys))


ITEMS = [(1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, "one two three"), (3, None), (None, "red orange yellow green blue indigo violet"), (5, "")]


def test_passages_whole_reordered_and_clean(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = [
        (1, "x y ALPHA!! beta gamma, delta epsilon zeta eta theta iota kappa. end"),
        (2, "zeta eta theta iota kappa - - alpha beta gamma delta epsilon"),  # halves swapped
        (3, "alpha beta gamma delta and epsilon zeta eta theta iota"),  # one tile of five is half of the item
        (4, "alpha beta gamma delta epsilonn zeta eta theta x iota"),
        (5, "one two three"),
        (6, None),
        (7, ""),
        (None, "red orange yellow green blue indigo violet"),
        (8, "pad " * 30_000 + "red orange yellow green blue indigo violet"),
        (1, "x y ALPHA!! beta gamma, delta epsilon zeta eta theta iota kappa. end"),
    ]
    got = sorted((r["doc_id"] or 0, r["item_id"] or 0, r["covered"]) for r in D.contaminated(docs(spark, rows), items).collect())
    assert got == [(0, 0, 7), (1, 1, 10), (1, 1, 10), (2, 1, 10), (3, 1, 5), (8, 0, 7)]
    kept = D.contaminated(docs(spark, rows), items, keep=True)
    assert sorted(r["doc_id"] for r in kept.collect()) == [4, 5, 6, 7] and len(kept.columns) == 9
    assert D.contaminated(docs(spark, []), items).count() == 0
    assert D.contaminated(docs(spark, rows), items.limit(0)).count() == 0


def test_blocks_of_the_benchmark(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_WORDS", 8)
    items = spark.createDataFrame([(k, " ".join(f"i{k}w{j}" for j in range(8))) for k in range(6)], "item_id long, text string")
    rows = [(k, f"start {' '.join(f'i{k}w{j}' for j in range(8))} end") for k in range(8)]
    got = sorted((r["doc_id"], r["item_id"]) for r in D.contaminated(docs(spark, rows), items).collect())
    assert got == [(k, k) for k in range(6)]
    assert sorted(r["doc_id"] for r in D.contaminated(docs(spark, rows), items, keep=True).collect()) == [6, 7]


def test_corpus_separates(spark):
    sf = "/root/testdata/sf0.01"
    got = D.op9_decontamination(spark, sf).toPandas()
    assert len(got) and got.coverage.min() > 0.9


def test_repetition_is_thinned_without_loss():
    r = random.Random(2)
    for _ in range(60):
        unit = [r.randrange(3) for _ in range(r.randint(1, 4))]
        item = np.array((unit * 9)[: r.randint(3, 14)] + [r.randrange(3) for _ in range(3)], dtype=np.uint64) + np.uint64(1)
        doc = np.array([r.randrange(3) for _ in range(4)] + unit * r.randint(10, 40) + [r.randrange(3) for _ in range(6)], dtype=np.uint64) + np.uint64(1)
        found = list(D.Block([(1, item)], 3).matches(doc, D.Powers()))
        assert sum(t[0] for t in (found[0][1] if found else [])) == sum(t[0] for t in brute(item.tolist(), doc.tolist(), 3))
    block = D.Block([(1, np.full(2_000, 7, dtype=np.uint64))], 5)
    began = time.monotonic()
    ((_, tiles),) = block.matches(np.full(1_000_000, 7, dtype=np.uint64), D.Powers())
    assert sum(t[0] for t in tiles) == 2_000 and time.monotonic() - began < 60


def test_query_by_brute_force(spark):
    """Every document by every item of the smallest tables: pairs without a common window of five words have no tile."""
    sf = "/root/testdata/sf0.001"
    cache = common.WordHashes()
    items = {r["item_id"]: D.tokens(r["text"], cache).tolist() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    grams = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, w in items.items()}
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        words = D.tokens(r["text"], cache).tolist()
        mine = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        for k, w in items.items():
            at = [i for i, g in enumerate(mine) if g in grams[k]]
            if at:
                # only the stretches around common windows can hold tiles; a gap stands for the rest
                near = sorted({i + x for i in at for x in range(5)})
                short = [v for p, q in zip([near[0], *near], near) for v in ([-1] if q - p > 1 else []) + [words[q]]]
                covered = sum(t[0] for t in brute(w, short, 5))
                if covered >= 0.5 * len(w):
                    want.append((r["doc_id"], k, covered))
    got = [(r["doc_id"], r["item_id"], r["covered"]) for r in D.op9_decontamination(spark, sf).collect()]
    assert want and sorted(got) == sorted(want)
