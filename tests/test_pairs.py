"""Joins by a threshold: the pairs of all comparisons, found with far fewer."""

import math

import numpy as np
import pytest

from tarnlight.functions import bases
from tarnlight.operators import edges, pairs, sketches

CODES = [*bases.CODES, "N", "-", "U"]


def fits(a, b):
    return set(bases.CODES.get(a, bases.BASES)) & set(bases.CODES.get(b, bases.BASES))


def all_snps(seqs, budget, length):
    return {(i, j): n / length for i, a in seqs for j, b in seqs if (n := sum(not fits(x, y) for x, y in zip(a, b, strict=True))) <= budget}


def found(df):
    rows = df.collect()
    out = {(r["i"], r["j"]): r["d"] for r in rows}
    assert len(rows) == len(out)
    return out


def families(rng, n, length, codes, per):
    """Unrelated sequences with relatives a few changes away, and codes of every kind."""
    seqs = []
    for _ in range(n):
        base = rng.choice(list("ACGT"), length)
        for _ in range(int(rng.integers(1, 4))):
            s = base.copy()
            at = rng.choice(length, int(rng.integers(0, 7)), replace=False)
            s[at] = rng.choice(codes, len(at))
            seqs.append("".join(s))
    return [(k * per, s) for k, s in enumerate(seqs)]


@pytest.mark.parametrize("block", [pairs.BLOCK, 3])
def test_snp_threshold_with_every_code(spark, monkeypatch, block):
    rng = np.random.default_rng(block)
    length, threshold = 60, 0.05
    seqs = families(rng, 50, length, CODES, 3) + [(1001, "".join(rng.choice(CODES, length))), (1002, "N" * length)]
    seqs += [(2000 + k, "A" * length) for k in range(9)]  # many of one kind share all keys
    assert {c for _, s in seqs for c in s} >= set(CODES)
    monkeypatch.setattr(pairs, "BLOCK", block)
    monkeypatch.setattr(pairs.keyed, "__defaults__", (block,))
    df = spark.createDataFrame(seqs, "id long, seq string")
    budget = bases.snp_budget(threshold, length)
    assert found(edges.snp_threshold(df, length, threshold)) == pytest.approx(all_snps(seqs, budget, length))
    keys = edges.segment_keys(df, length, budget)
    wide = {r["id"] for r in keys.where("key is null").collect()}
    assert {1001, 1002} <= wide and len(wide) < 20
    assert pairs.comparisons(keys.where("key is not null")) < len(seqs) ** 2 / 4


def test_snp_threshold_falls_back_to_all_pairs(spark):
    seqs = [(k, "ACGTACGTAC"[: 9 - k % 2] + "C" * (1 + k % 2)) for k in range(12)]
    for threshold in (0.05, 0.9, 1.0):
        assert found(edges.snp_threshold(spark.createDataFrame(seqs, "id long, seq string"), 10, threshold)) == pytest.approx(all_snps(seqs, bases.snp_budget(threshold, 10), 10))


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.75, 1.0])
def test_jaccard_threshold_by_prefixes(spark, threshold):
    rng = np.random.default_rng(4)
    sets = {}
    for k in range(90):
        base = set(rng.choice(5000, int(rng.integers(1, 30)), replace=False).tolist())
        sets[3 * k] = base
        sets[3 * k + 1] = {x for x in base if rng.random() < 0.8} | set(rng.choice(5000, 2).tolist())
        sets[3 * k + 2] = base | {7}  # one that a third of all sets have
    sets |= {900 + k: set() for k in range(3)}
    cells = spark.createDataFrame([(i, f"f{x}") for i, s in sets.items() for x in s] + [(0, None), (None, "f1"), (99999, "f1")], "id long, feature string")
    nodes = spark.createDataFrame([(i,) for i in sets], "id long")
    want = {(i, j): d for i, a in sets.items() for j, b in sets.items() if i != j and (d := 1 - len(a & b) / len(a | b) if a | b else 0.0) < threshold}
    assert found(edges.jaccard_threshold(cells, nodes, threshold)) == pytest.approx(want)
    if threshold <= 0.5:
        assert pairs.comparisons(edges.prefix_keys(cells, nodes, threshold)) < len(sets) ** 2 / 10


def test_exact_neighbours_take_smallest_ids_of_ties(spark):
    rng = np.random.default_rng(2)
    d = rng.integers(0, 4, (40, 300)).astype(float)
    i, j = np.arange(40), np.sort(rng.choice(5000, 300, replace=False))
    for k in (1, 7, 300):
        keep = pairs.smallest(k, False, False)(i, j, d)
        for row in range(40):
            want = np.lexsort((j, np.where(i[row] == j, np.inf, d[row])))[: min(k, (i[row] != j).sum())]
            assert set(np.flatnonzero(keep[row])) == set(want)


def test_random_matches(spark):
    """Unrelated random sequences end at distance 1, related ones below."""
    rng = np.random.default_rng(5)
    length, ks = 3000, (5, 6, 7)
    base = rng.choice(list("ACGT"), length)
    near = base.copy()
    near[rng.choice(length, 30, replace=False)] = "A"
    seqs = {0: base, 1: near, 2: rng.choice(list("ACGT"), length), 3: rng.choice(list("ACGT"), length, p=[0.4, 0.1, 0.1, 0.4])}
    seqs = {i: "".join(s) for i, s in seqs.items()}
    rows = [(i, k, s[a : a + k]) for i, s in seqs.items() for k in ks for a in range(length - k + 1)]
    hashes = spark.createDataFrame(rows, "id long, k int, hash string").distinct()
    genomes = spark.createDataFrame([(i, float(length), *[s.count(c) / length for c in "ACGT"]) for i, s in seqs.items()], "id long, length double, a double, c double, g double, t double")
    plain = {(r["i"], r["j"]): r["core"] for r in sketches.all_distances(hashes).collect()}
    fixed = {(r["i"], r["j"]): r["core"] for r in sketches.all_distances(hashes, genomes).collect()}
    assert plain[0, 2] < 0.8 and fixed[0, 1] < 0.1
    again = sketches.core_accessory(sketches.random_jaccard(sketches.jaccard_by_k(hashes), genomes))
    assert {(r["i"], r["j"]): r["core"] for r in again.collect()} == pytest.approx(fixed)
    r = {(x["i"], x["j"], x["k"]): x["jaccard"] for x in sketches.random_jaccard(sketches.jaccard_by_k(hashes), genomes).collect()}
    assert max(r[0, 2, k] for k in ks) < 0.1 and r[0, 1, 7] > 0.7
    # a chance that is far below 1 for long k-mers: nothing is left of unrelated ones
    long = spark.createDataFrame([(i, k, s[a : a + k]) for i, s in seqs.items() for k in (12, 14) for a in range(length - k + 1)], "id long, k int, hash string").distinct()
    nodes = spark.createDataFrame([(i,) for i in seqs], "id long")
    far = {(x["i"], x["j"]): x["d"] for x in sketches.sketch_knn(long, nodes, 3, "core", genomes=genomes).collect()}
    assert min(far[0, 2], far[2, 3]) > 0.999 and far[0, 1] < 0.1


def test_sketch_neighbours_follow_the_last_bit_of_the_formula(spark):
    """Three samples of sf0.1 by their counts: the two distances to the first are equal but for rounding."""
    sizes = {0: (571, 578, 580), 1: (590, 594, 596), 2: (590, 595, 596)}
    both = (12, 6, 5)  # that either shares with the first, length by length
    rows = [(i, k + 1, f"{'a' if i == 0 or x < both[k] else i}:{x}") for i, ns in sizes.items() for k, n in enumerate(ns) for x in range(n)]

    def core(other):
        logs = [math.log(c / (n + m - c)) for c, n, m in zip(both, sizes[0], sizes[other], strict=True)]
        sy, sxy = logs[0] + logs[1] + logs[2], logs[0] + 2 * logs[1] + 3 * logs[2]
        return max(0.0, min(1.0, 1 - math.exp((3.0 * sxy - 6.0 * sy) / (3.0 * 14.0 - 36.0))))

    want = min((core(j), j) for j in (1, 2))
    assert 0 < abs(core(1) - core(2)) < 1e-12
    near = sketches.sketch_knn(spark.createDataFrame(rows, "id long, k int, hash string"), spark.createDataFrame([(i,) for i in sizes], "id long"), 1, "core")
    assert {r["i"]: (r["d"], r["j"]) for r in near.collect()}[0] == want
