"""Neighbours in the plane, spanning trees and clusters against plain versions of all pairs and of the whole hierarchy."""

import numpy as np
import pytest

from tarnlight.operators import cluster, hierarchy, plane


def frame(spark, xy):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "id long, x double, y double")


def reach(xy):
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    core = np.sort(d, 1)[:, 2]
    return core, np.maximum(d, np.maximum(core[:, None], core[None]))


def prim(r):
    n = len(r)
    dist, to, seen, out = r[0].copy(), np.zeros(n, dtype=int), np.zeros(n, dtype=bool), []
    seen[0] = True
    for _ in range(n - 1):
        k = int(np.where(seen, np.inf, dist).argmin())
        out.append((int(to[k]), k, float(dist[k])))
        seen[k] = True
        closer = r[k] < dist
        dist, to = np.where(closer, r[k], dist), np.where(closer, k, to)
    return out


def labels(n, tree, epsilon):
    """All edges of one length split a part at once; clusters by excess of mass, none born below epsilon."""
    rate = lambda d: min(1 / d, hierarchy.MAX_RATE) if d > 0 else hierarchy.MAX_RATE
    if n < 2:
        return [-1] * n

    def split(points, edges):
        h = max(d for _, _, d in edges)
        group = {p: p for p in points}
        for i, j, d in edges:
            if d < h:
                a, b = group[i], group[j]
                group = {p: a if g == b else g for p, g in group.items()}
        parts = {}
        for p, g in group.items():
            parts.setdefault(g, []).append(p)
        return h, [(p, [e for e in edges if e[2] < h and e[0] in p]) for p in parts.values()]

    birth, parent, lost, kids, size = [0.0], [-1], [[]], [[]], [n]
    todo = [(list(range(n)), list(tree), 0)]
    while todo:
        points, edges, c = todo.pop()
        h, parts = split(points, edges)
        big = [p for p in parts if len(p[0]) > 1]
        lost[c] += [(p[0][0], rate(h)) for p in parts if len(p[0]) == 1]
        for p in big:
            to = c
            if len(big) > 1:
                birth.append(rate(h))
                parent.append(c)
                lost.append([])
                kids.append([])
                size.append(len(p[0]))
                kids[c].append(to := len(birth) - 1)
            todo.append((*p, to))
    n_c = len(birth)
    stable = [sum(r for _, r in lost[c]) + sum(size[k] * birth[k] for k in kids[c]) - size[c] * birth[c] for c in range(n_c)]
    best, taken = stable[:], [True] * n_c
    for c in range(n_c - 1, -1, -1):
        below = sum(best[k] for k in kids[c])
        if kids[c] and below > stable[c]:
            best[c], taken[c] = below, False
    final, todo = set(), [0]
    while todo:
        c = todo.pop()
        if taken[c]:
            while c > 0 and birth[c] > 1 / epsilon:
                c = parent[c]
            final.add(c)
        else:
            todo += kids[c]

    def above(c):
        while parent[c] >= 0:
            c = parent[c]
            yield c

    final = {c for c in final if not any(a in final for a in above(c))}
    stay = min(1 / epsilon, max((r for _, r in lost[0]), default=0.0)) if final == {0} else 0.0
    out, found = [-1] * n, {}
    for c in final:
        todo, own = [c], []
        while todo:
            x = todo.pop()
            own += [p for p, r in lost[x] if r >= stay]
            todo += kids[x]
        if own:
            found[min(own)] = own
    for label, first in enumerate(sorted(found)):
        for p in found[first]:
            out[p] = label
    return out


@pytest.mark.parametrize("cell", [plane.CELL, 12])
def test_core_distances_and_trees(spark, monkeypatch, cell):
    rng = np.random.default_rng(cell)
    if cell == 12:
        monkeypatch.setattr(plane, "CELL", cell)
        monkeypatch.setattr(plane, "NEAR", 2)
        monkeypatch.setattr(plane, "CHUNK", 5)
    near = np.concatenate([rng.normal(size=(60, 2)) * 0.02 + rng.normal(size=2) * 3 for _ in range(5)])
    near[3] = near[4]
    near[10:14] = near[9]
    line = np.column_stack([np.zeros(90), rng.normal(size=90)])
    grid = np.array([(a, b) for a in range(9) for b in range(9)], dtype=float)
    for xy in (near, line, grid, np.zeros((7, 2)), near[:3], np.array([[0.0, 0.0], [0.0, 0.0], [1.0, 0.0]])):
        core, r = reach(xy)
        p = frame(spark, xy)
        assert [x["core"] for x in cluster.core_distances(p).orderBy("id").collect()] == pytest.approx(list(core))
        tree = cluster.spanning_tree(p).collect()
        linked = {i: i for i in range(len(xy))}
        for e in tree:
            a, b = linked[e["i"]], linked[e["j"]]
            assert a != b and e["d"] == pytest.approx(r[e["i"], e["j"]])
            linked = {k: a if v == b else v for k, v in linked.items()}
        assert len(tree) == len(xy) - 1 and sum(e["d"] for e in tree) == pytest.approx(sum(d for _, _, d in prim(r)))


def test_clusters_equal_the_whole_hierarchy(spark, monkeypatch):
    rng = np.random.default_rng(5)
    blobs = lambda k, n, s: np.concatenate([rng.normal(size=(n, 2)) * s + rng.normal(size=2) for _ in range(k)])
    twins = blobs(4, 25, 0.05)
    twins[3], twins[30:36], twins[60] = twins[4], twins[29], twins[61]
    grid = np.array([(a, b) for a in range(12) for b in range(12)], dtype=float)
    for xy in (blobs(5, 30, 0.05), blobs(2, 90, 0.003), twins, rng.normal(size=(200, 2)), grid, rng.normal(size=(120, 2)) * [1, 0], np.zeros((6, 2))):
        p = cluster.scaled(frame(spark, xy)).toPandas().sort_values("id")[["x", "y"]].to_numpy()
        want = labels(len(p), prim(reach(p)[1]), cluster.EPSILON)
        got = [r["cluster"] for r in cluster.hdbscan(frame(spark, xy)).orderBy("id").collect()]
        assert got == want


@pytest.mark.parametrize("local", [hierarchy.LOCAL_EDGES, 12])
def test_clusters_of_random_trees(spark, monkeypatch, local):
    """Trees of any shape, lengths distinct or in ties, with so few edges a task that they are contracted in groups and halves."""
    monkeypatch.setattr(hierarchy, "LOCAL_EDGES", local)
    rng = np.random.default_rng(local)
    for n, ties, way in ((40, False, 4), (60, True, 2), (50, False, 50), (2, False, 1), (30, True, 30))[: 3 if local == 12 else 5]:
        length = rng.choice([0.01, 0.015, 0.3, 0.5, 0.02], n - 1) if ties else np.exp(rng.uniform(np.log(0.002), np.log(0.8), n - 1))
        name = rng.permutation(n)
        tree = [(int(name[k]), int(name[max(0, k - int(rng.integers(1, way + 1)))]), float(d)) for k, d in zip(range(1, n), length, strict=True)]
        edges = spark.createDataFrame([(min(i, j), max(i, j), d) for i, j, d in tree], hierarchy.EDGES)
        parts = spark.createDataFrame([(i, 1, -1.0, 0, 0, 0, 0.0, 0.0, 0.0, False) for i in range(n)], hierarchy.PART)
        for epsilon in (0.02, 0.0001):
            got = {r["part"]: r["cluster"] for r in hierarchy.clusters(parts, edges, epsilon).collect()}
            assert [got[i] for i in range(n)] == labels(n, tree, epsilon), (n, ties, way, epsilon)


def test_forest_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "LOCAL_EDGES", 10)
    rng = np.random.default_rng(1)
    pairs = sorted({tuple(sorted(map(int, rng.choice(60, 2, replace=False)))) for _ in range(300)})
    rows = [(i, j, float(rng.integers(1, 30))) for i, j in pairs]
    got = hierarchy.forest(spark.createDataFrame(rows, hierarchy.EDGES)).collect()
    keep = hierarchy._kruskal(*(np.array(c) for c in zip(*rows, strict=True)))
    assert len(got) == len(keep) and sum(r["d"] for r in got) == sum(rows[k][2] for k in keep)


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(205, 203), (203, 209)]
    got = {r["v"]: r["c"] for r in hierarchy.components(spark.createDataFrame(links, "i long, j long")).collect()}
    assert got == {v: 0 if v < 50 else 100 if v < 200 else 203 for v in {x for e in links for x in e}}


def test_odd_points(spark):
    none = spark.createDataFrame([], "id long, x double, y double")
    assert cluster.hdbscan(none).collect() == [] and cluster.spanning_tree(none).collect() == []
    odd = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 0.0, 1.0), (3, None, 1.0), (4, float("nan"), 1.0)], "id long, x double, y double")
    assert {r["id"]: r["core"] for r in cluster.core_distances(odd).collect()} == pytest.approx({0: 1.0, 1: 2**0.5, 2: 2**0.5, 3: np.inf, 4: np.inf})
    assert [r["cluster"] for r in cluster.hdbscan(frame(spark, [(1.0, 2.0)])).collect()] == [-1]
    assert [r["cluster"] for r in cluster.hdbscan(frame(spark, [(1.0, 2.0), (2.0, 2.0)])).collect()] == [0, 0]
