import random


import numpy as np
import pytest
from tarnlight.llm import common
from tarnlight.llm import minhash as M

from .util import by_id, docs


def brute(rows, n, percent=80):
    """doc_id -> (shingles, component) by comparing all pairs."""
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        k = min(n, len(w))
        s = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()
        if d is not None and (d not in sets or len(s) > len(sets[d])):
            sets[d] = s
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def corpus(seed=0):
    r = random.Random(seed)
    word = lambda: "w" + str(r.randrange(3000))
    rows, k = [], 0
    for size, edits in ((1, 0), (2, 2), (3, 3), (40, 6), (25, 9), (12, 0), (5, 14)):
        for _ in range(3):
            base = [word() for _ in range(r.randint(40, 120))]
            for _ in range(size):
                mine = base[:]
                for _ in range(r.randint(0, edits)):
                    mine[r.randrange(len(mine))] = word()
                rows.append((k, " ".join(mine)))
                k += 1
    r.shuffle(rows)
    return rows


def same(spark, rows, n):
    got = by_id(M.near_duplicates(docs(spark, rows), n))
    want = brute(rows, n)
    assert {d: (g["n_shingles"], g["component_id"]) for d, g in got.items()} == want
    assert all(g["kept"] == (d == g["component_id"]) for d, g in got.items())


def test_components_equal_brute_force(spark):
    same(spark, corpus(), 2)


def test_five_words_and_odd_texts(spark):
    odd = [(900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "ONE"), (905, "one two three"), (906, "One\x0btwo\x0cthree"), (907, "Äpfel äpfel"), (908, "äpfel äpfel"), (None, "one"), (910, "pad word " * 9000), (911, "pad word " * 9000), (912, "a b c d e f"), (912, "a b c d e f"), (913, "x\u00a0y z"), (914, "x y z")]
    same(spark, corpus(1)[:80] + odd, 5)


def test_large_buckets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 8)
    monkeypatch.setattr(M, "PAIRS_PER_KEY", 5)
    monkeypatch.setattr(M, "BROADCAST_IDS", 3)
    same(spark, corpus(2), 2)


def test_sets_that_share_a_hash_stay_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    # eight names for all classes at first, sixteen times as many each round
    monkeypatch.setattr(M, "class_hash", lambda digest, salt: F.when(F.col(digest).isNotNull(), F.pmod(F.xxhash64(digest, F.lit(salt)), F.lit(8 << 4 * salt))))
    same(spark, corpus(4), 2)


def test_empty_table(spark):
    assert M.near_duplicates(docs(spark, []), 2).count() == 0


def test_bound_never_rules_out_a_link():
    rng = np.random.default_rng(0)
    for _ in range(500):
        a = common.mix(rng.integers(0, 400, rng.integers(1, 300)).astype(np.uint64))
        b = np.union1d(rng.choice(a, rng.integers(1, len(a) + 1)), common.mix(rng.integers(0, 400, 20).astype(np.uint64)))
        a, b = np.unique(a), np.unique(b)
        x, y = M.bitmap(a), M.bitmap(b)
        size = min(len(x), len(y))
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        got = M.bound(np.int64(len(a)), M.folded(x, size), len(b), M.folded(y, size), 80)
        assert got >= j - 1e-12 if j >= 0.8 else True


@pytest.mark.parametrize("local", [M.LOCAL_LINKS, 4])
def test_components_of_chains_and_stars(spark, monkeypatch, local):
    monkeypatch.setattr(M, "LOCAL_LINKS", local)
    edges = [(i, i + 1) for i in range(50)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["id"]: r["component"] for r in M.components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}
    assert M.components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


def test_repeated_ids_keep_their_links(spark):
    r = random.Random(7)
    a, b, c = (" ".join("w" + str(r.randrange(500)) for _ in range(60)) for _ in range(3))
    got = by_id(M.near_duplicates(docs(spark, [(5, a), (5, b), (9, b), (7, c), (3, c), (3, c)]), 2))
    assert {d: g["component_id"] for d, g in got.items()} == {5: 5, 9: 5, 7: 3, 3: 3}


def test_deduplicated_rows(spark):
    r = random.Random(8)
    a, b, c = (" ".join("w" + str(r.randrange(500)) for _ in range(60)) for _ in range(3))
    rows = [(5, a), (5, b), (9, b), (9, a + " more"), (7, c), (3, c), (3, c), (None, c), (None, "alone in here"), (1, None), (1, None), (2, ""), (4, "")]
    out = M.deduplicated(docs(spark, rows), 5)
    assert out.columns == docs(spark, rows).columns
    assert sorted(map(repr, ((x["doc_id"], x["text"]) for x in out.collect()))) == sorted(map(repr, [(5, a), (5, b), (3, c), (None, "alone in here"), (1, None), (2, ""), (4, "")]))
    assert M.deduplicated(docs(spark, []), 5).count() == 0


def test_rounds_that_never_settle_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(M, "MAX_ROUNDS", 1)
    monkeypatch.setattr(M, "LOCAL_LINKS", 2)
    try:
        M.components(spark.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long"), "t").count()
    except RuntimeError:
        return
    raise AssertionError("an unfinished result")
