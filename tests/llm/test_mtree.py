"""The search against all inner products, and bounds that must save work where vectors lie in groups."""

import random

import numpy as np
import pytest

from tarnlight.llm import mtree

SCHEMA = "vec_id long, embedding array<double>, shard long, v string, region int, query_id long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, 3) for i, v in rows], SCHEMA)


def brute(rows, k=10):
    import math

    held = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) and math.isfinite(1024 * x) for x in v):
            x = [math.floor(1024 * c) for c in v]
            held[i] = min(held.get(i, x), x)
    out = {}
    for q, x in held.items():
        if q % 100 == 0:
            scored = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(x, y, strict=False)))), i) for i, y in held.items() if i != q)
            out[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return {q: r for q, r in out.items() if r}


def results(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(v) for q, v in out.items()}


def found(spark, rows, shard=mtree.SHARD):
    vectors = mtree.scaled(frame(spark, rows))
    return results(mtree.nearest(mtree.index(vectors, 10, shard), vectors.where("vec_id % 100 = 0"), 10))


def clustered(n, seed, dim=6):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(8, dim))
    v = middle[rng.integers(8, size=n)] + 0.01 * rng.normal(size=(n, dim))
    return [(i * 5, [float(x) for x in r]) for i, r in enumerate(v)]


@pytest.mark.parametrize("shard", [mtree.SHARD, 100, 7])
def test_equals_all_products(spark, shard, monkeypatch):
    monkeypatch.setattr(mtree, "PAGE", 16)
    monkeypatch.setattr(mtree, "FANOUT", 4)
    monkeypatch.setattr(mtree, "QUERY_BLOCK", 3)
    rows = clustered(700, shard) + [(i, [0.25] * 6) for i in range(1, 400, 3)] + [(i, [0.0] * 6) for i in range(20_000, 20_020)]
    random.Random(2).shuffle(rows)
    assert found(spark, rows, shard) == brute(rows)


def test_nulls_lengths_repeats_and_large_values(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 1.0]), (100, [1e9, -3.5]), (200, [1e200, 1.0]), (300, []), (1, None), (None, [1.0]), (2, [nan, 1.0]), (3, [inf]), (4, [None, 1.0]), (5, [1.0]), (6, [-1e300, 2.0]), (7, [1e306]), (8, [0.5, 0.5, 0.5])]
    assert found(spark, rows) == brute([(i, None if v is None else v) for i, v in rows])


def test_no_rows_and_few_rows(spark):
    assert found(spark, []) == {}
    assert found(spark, [(100, [1.0, 0.0])]) == {}
    assert found(spark, [(100, [1.0, 0.0]), (3, [2.0, 1.0])]) == {100: [(1, 3, 2 << 20)]}
    assert found(spark, [(100, []), (200, [])]) == {100: [(1, 200, 0)], 200: [(1, 100, 0)]}


def test_bounds_save_products(monkeypatch):
    rows = np.floor(1024 * np.array([v for _, v in clustered(5000, 1)]))
    nodes = mtree.build(rows, rows[0])
    assert sum(len(n.rows) for n in nodes if not n.children) == len(rows)
    for n in nodes:
        assert len(n.children) > 0 or len(n.rows) <= mtree.PAGE
        assert np.allclose(mtree._distances(n.pivot[None], rows[n.rows]).max(), n.radius)
    place = {id(n): k for k, n in enumerate(nodes)}
    parent = {place[id(c)]: k for k, n in enumerate(nodes) for c in n.children}
    pages = [(k, parent.get(k, -1), n.pivot.tobytes(), n.radius, n.longest, n.to_parent, rows[e].tobytes(), mtree._distances(n.pivot[None], rows[e])[0].tobytes(), [[int(i)] for i in e]) for k, n in enumerate(nodes) for e in [n.rows if not n.children else n.rows[:0]]]
    tree, counted = mtree.Tree(pages, rows.shape[1]), []
    exact = mtree.products
    monkeypatch.setattr(mtree, "products", lambda a, b: counted.append(len(a) * len(b)) or exact(a, b))
    got = mtree.search(tree, rows[:50], list(range(50)), 10, np.full(50, -np.inf))
    for q in range(50):
        scored = sorted((-int(s), i) for i, s in enumerate(exact(rows[q : q + 1], rows)[0]) if i != q)
        assert got[q] == scored[:10]
    assert sum(counted) < 0.25 * 50 * len(rows)


def test_query_equals_all_products(spark, tmp_path):
    rows = clustered(600, 9)
    frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert results(mtree.op11_mtree(spark, str(tmp_path))) == brute(rows)
