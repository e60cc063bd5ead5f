"""Sets in blocks of which only those meet that share an element, against brute force."""

import numpy as np
import pytest

from tarnlight.operators import edges, pairs, sets, sketches
from tarnlight.plans import registry


def groups():
    """Six groups of sets that share nothing across groups, but for one set of three groups; and empty ones."""
    rng = np.random.default_rng(1)
    out = {1000 * c + 3 * k: set((500 * c + rng.choice(60, int(rng.integers(0, 9)), replace=False)).tolist()) for c in range(6) for k in range(20)}
    return out | {50_000: {3, 503, 1003}, -7: set()}


SETS = groups()
WANT = {(i, j): (1 - len(a & b) / len(a | b) if a | b else 0.0) for i, a in SETS.items() for j, b in SETS.items() if i != j}


@pytest.fixture(scope="module")
def tables(spark):
    cells = [(i, f"f{x}") for i, s in SETS.items() for x in s] + [(0, None), (None, "f1"), (99999, "f1")]
    return spark.createDataFrame(cells, "id long, feature string"), spark.createDataFrame([(i,) for i in SETS], "id long")


@pytest.fixture
def small(monkeypatch):
    for name, value in (("BLOCK", 8), ("LEAST", 4), ("FEW", 2), ("AT_ONCE", 50), ("BATCH", 100)):
        monkeypatch.setattr(sets, name, value)


def found(df):
    rows = df.collect()
    out = {(r["i"], r["j"]): r["d"] for r in rows}
    assert len(rows) == len(out)
    return out


@pytest.mark.parametrize("dense", [0, 10**9, 120])
def test_intersections(monkeypatch, dense):
    monkeypatch.setattr(sets, "DENSE", dense)
    monkeypatch.setattr(sets, "AT_ONCE", 40)
    rng = np.random.default_rng(dense % 7)
    a, b = ([set(rng.choice(40, int(rng.integers(0, 12)), replace=False).tolist()) | {99} for _ in range(n)] for n in (30, 17))
    one = lambda xs: sets.Sets(np.array([len(x) for x in xs]), np.array([v for x in xs for v in sorted(x)], dtype=np.int64))
    assert (sets.shared(one(a), one(b)) == [[len(x & y) for y in b] for x in a]).all()
    assert not sets.shared(one([set()]), one(b)).any()


def test_threshold_makes_no_copy_of_a_set_for_each_key(spark, monkeypatch, small):
    """Long sets have many rare features: joined by these, each would be copied as often."""
    rng = np.random.default_rng(3)
    own = {1000 * c + k: set((4000 * c + rng.choice(2000, 80, replace=False)).tolist()) for c in range(4) for k in range(12)}
    own |= {i + 100: set(sorted(s)[:60]) for i, s in own.items()}

    def never(*_args, **_kwargs):
        raise AssertionError("copied by keys")

    monkeypatch.setattr(pairs, "keyed", never)
    cells = spark.createDataFrame([(i, x) for i, s in own.items() for x in s], "id long, feature long")
    want = {(i, j): d for i, a in own.items() for j, b in own.items() if i != j and (d := 1 - len(a & b) / len(a | b)) < 0.85}
    assert found(edges.jaccard_threshold(cells, spark.createDataFrame([(i,) for i in own], "id long"), 0.85)) == want


@pytest.mark.parametrize("threshold", [0.4, 0.85, 1.5])
def test_thresholds_among_groups(tables, small, monkeypatch, threshold):
    monkeypatch.setattr(edges, "KEYED", 0)
    assert found(edges.jaccard_threshold(*tables, threshold)) == {k: d for k, d in WANT.items() if d < threshold}


@pytest.mark.parametrize("k", [3, 30])
def test_nearest_among_groups(tables, small, k):
    """Rows with fewer relatives than k get the smallest ids of those that they share nothing with, from blocks that they don't meet."""
    want = {(i, j): d for i in SETS for d, j in sorted((WANT[i, j], j) for j in SETS if j != i)[:k]}
    assert found(edges.jaccard_knn(*tables, k)) == want


def test_groups_meet_their_own_blocks(tables, small):
    cells, nodes = tables
    whole = cells.join(nodes, "id", "left_semi").where("feature is not null and id < 50000")  # without empty sets and the one of three groups
    blocks = edges.set_blocks(whole, whole.select("id"))
    known = [r[0] for r in blocks.select("b").orderBy("b").collect()]
    meets = sets._meeting(blocks, {b: at for at, b in enumerate(known)}, len(known))
    assert sum(len(r["past"]) for r in meets.collect()) < len(known) * (len(known) - 1) / 2


KS = (2, 5)


@pytest.fixture(scope="module")
def hashes(spark):
    """Sketches of two lengths, the longer of fewer hashes; some rows twice, others without id or hash."""
    rows = [(i, k, f"{k}:{x}") for i, s in SETS.items() for x in s for k in KS if k == 2 or x % 3]
    return spark.createDataFrame([*rows, *rows[:50], (0, 2, None), (None, 2, "2:1")], "id long, k int, hash string")


def indices(k):
    own = {i: {x for x in s if k == 2 or x % 3} for i, s in SETS.items()}
    return {(i, j, k): len(a & b) / len(a | b) for i, a in own.items() for j, b in own.items() if i < j and a & b}


@pytest.fixture
def no_dense_pairs(monkeypatch):
    def never(*_args, **_kwargs):
        raise AssertionError("all blocks met")

    monkeypatch.setattr(pairs, "distances", never)


def test_sketch_indices_among_groups(hashes, small, no_dense_pairs):
    got = {(r["i"], r["j"], r["k"]): r["jaccard"] for r in sketches.jaccard_by_k(hashes).collect()}
    assert got == indices(2) | indices(5)


@pytest.fixture(scope="module")
def genomes(spark):
    return spark.createDataFrame([(i, 5.0 + i % 7, 0.1, 0.2, 0.3, 0.4) for i in SETS], "id long, length double, a double, c double, g double, t double")


def test_sketch_indices_with_genomes_need_no_join(hashes, genomes, small, no_dense_pairs):
    got = {(r["i"], r["j"], r["k"]): r["jaccard"] for r in sketches.jaccard_by_k(hashes, genomes).collect()}
    want = {(r["i"], r["j"], r["k"]): r["jaccard"] for r in sketches.random_jaccard(sketches.jaccard_by_k(hashes), genomes).collect()}
    assert got == pytest.approx(want) and min(got.values()) == 0 < max(got.values())


def test_sketch_distances_among_groups(hashes, small, no_dense_pairs):
    got = {(r["i"], r["j"]): (r["core"], r["accessory"]) for r in sketches.all_distances(hashes).collect()}
    want = {(r["i"], r["j"]): (r["core"], r["accessory"]) for r in sketches.core_accessory(sketches.jaccard_by_k(hashes)).collect()}
    assert set(got) == set(want) and all(got[p] == pytest.approx(want[p]) for p in want)


def test_corrected_distances_among_groups(hashes, genomes, small, no_dense_pairs):
    got = {(r["i"], r["j"]): (r["core"], r["accessory"]) for r in sketches.all_distances(hashes, genomes).collect()}
    want = {(r["i"], r["j"]): (r["core"], r["accessory"]) for r in sketches.core_accessory(sketches.jaccard_by_k(hashes, genomes)).collect()}
    assert set(got) == set(want) and all(got[p] == pytest.approx(want[p]) for p in want)


def test_full_distances_among_groups(tables, small):
    """Blocks that share nothing are written as distance 1 from their ids alone."""
    assert found(edges.jaccard(*tables)) == WANT


def test_rounding_as_sql_does(spark):
    values = [0.9765625, 0.0, 1.0, 0.1234564999, 2.5, float("inf"), 0.5703125, None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "d double").select(*registry._rd("d")).collect()]
    assert got == [0.976563, 0.0, 1.0, 0.123456, 2.5, float("inf"), 0.570313, None]


@pytest.mark.parametrize("more", [0, 60])
def test_all_others_are_not_ranked(tables, small, monkeypatch, more):
    """As many neighbours as there are others, or more: no task collects candidates."""

    def never(*_args):
        raise AssertionError("ranked")

    monkeypatch.setattr(pairs, "smallest", never)
    assert found(edges.jaccard_knn(*tables, len(SETS) - 1 + more)) == WANT
