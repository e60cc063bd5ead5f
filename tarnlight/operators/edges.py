"""Sparse distance graphs: edges (i, j, d) by k nearest neighbours or by a threshold."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import bases
from . import pairs, sets, storage

DOUBLES = "array<double>"
#: Ways to read the ambiguous codes of a segment that have keys of their own.
READINGS = 64
#: Copies of a set, on average, that a join by its rarest features may make.
KEYED = 16


def vector_payload(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) with each vector as float64 bytes; null vectors are left out, lengths must agree."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.array(x, dtype="<f8").tobytes() for x in b.column(1).to_pylist()], pa.binary())], names=["id", "v"])

    return rows.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).cast(DOUBLES).alias("v")).mapInArrow(run, "id long, v binary")


def encoded(msa: DataFrame, length: int) -> DataFrame:
    """(id, A, C, G, T): bit planes of an alignment (id, seq) whose rows all have ``length`` positions, else an error."""
    seq = F.when(F.length("seq") == length, F.col("seq")).otherwise(F.raise_error(F.concat(F.lit("sequence of another length: "), F.col("id").cast("string"))))
    return msa.select("id", seq.alias("seq")).select("id", *[bases.plane(F.col("seq"), b, length).alias(b) for b in bases.BASES])


def plane_payload(planes: DataFrame, length: int) -> DataFrame:
    """(id, v) for the blocked kernel: the length and the planes' words as little-endian bytes."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            rows = zip(*(b.column(k).to_pylist() for k in range(1, 5)), strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([struct.pack(f"<{1 + sum(map(len, r))}q", length, *(w for p in r for w in p)) for r in rows], pa.binary())], names=["id", "v"])

    return planes.select("id", *bases.BASES).mapInArrow(run, "id long, v binary")


def snp_all(msa: DataFrame, length: int) -> DataFrame:
    """(i, j, snp) of all ordered pairs, self included: positions without a base in common."""
    rows = plane_payload(encoded(msa, length), length)
    return pairs.distances(rows, pairs.hamming_planes, lambda i, j, d: d >= 0, n=msa.count()).select("i", "j", F.col("d").cast("long").alias("snp"))


def snp_knn(msa: DataFrame, length: int, k: int) -> DataFrame:
    """EDGES of the k nearest and all ties; the self pair counts and stays, so k + 1 rows at least where there are as many."""
    rows = plane_payload(encoded(msa, length), length)
    near = pairs.distances(rows, pairs.hamming_planes, pairs.smallest(k + 1, True, True), n=msa.count())
    return near.select("i", "j", (F.col("d") / length).alias("d"))


def segment_keys(msa: DataFrame, length: int, budget: int) -> DataFrame:
    """(id, key) of an alignment (id, seq): a key for each of budget + 1 segments and each way to read its ambiguous codes; stored.

    Rows within the budget have a segment without a SNP, so a reading of it in common.  Rows of which a segment has more than
    READINGS have one row without key.
    """
    import itertools

    import numpy as np
    import pyarrow as pa

    cuts = np.linspace(0, length, min(length, budget + 1) + 1).astype(int)
    bits = {c: sorted(s) for c, s in bases.CODES.items()}

    def run(batches):
        for b in batches:
            out = []
            for i, seq in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = []
                for at, (lo, hi) in enumerate(itertools.pairwise(cuts)):
                    read = [bits.get(c, bases.BASES) for c in seq[lo:hi].upper()]
                    many = 1
                    for r in read:
                        many *= len(r)
                    if many > READINGS:
                        own = [(i, None)]
                        break
                    own += [(i, f"{at}:{''.join(r)}") for r in itertools.product(*read)]
                out += own
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[], []], (pa.int64(), pa.string()), strict=True)], names=["id", "key"])

    return storage.stored(msa.select("id", "seq").mapInArrow(run, "id long, key string"), "segments")


def snp_threshold(msa: DataFrame, length: int, threshold: float) -> DataFrame:
    """EDGES of at most the threshold's budget of SNPs, the self pair among them.

    Pairs that share a segment's key are compared; rows too ambiguous for keys are compared with all.  Where segments are so common
    that this compares more pairs than there are, all pairs are compared in blocks instead.
    """
    budget = bases.snp_budget(threshold, length)
    rows = plane_payload(encoded(msa, length), length)
    few = lambda i, j, d: (d <= budget) | (budget < 0)
    scaled = lambda near: near.select("i", "j", (F.col("d") / length).alias("d"))
    if 0 <= budget < length:
        n, keys = msa.count(), segment_keys(msa, length, budget)
        wide = keys.where("key is null").select("id")
        many = wide.count()
        narrow = keys.where("key is not null")
        if pairs.comparisons(narrow) + 2 * n * many < n * n:
            rows = storage.stored(rows, "planes")
            near = pairs.keyed(narrow, rows, pairs.hamming_planes, few)
            itself = rows.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0.0).alias("d"))
            # ambiguous rows are marked by an id set of their own: each with all others, both ways
            meets = pairs.across(rows.join(wide, "id"), rows, pairs.hamming_planes, few) if many else None
            return scaled(near.unionByName(itself) if meets is None else near.unionByName(meets).unionByName(itself).distinct())
        return scaled(pairs.distances(rows, pairs.hamming_planes, few, n=n))
    return scaled(pairs.distances(rows, pairs.hamming_planes, few))


def vector_knn(rows: DataFrame, id_col: str, vec_col: str, k: int) -> DataFrame:
    """EDGES of the k nearest by cosine distance, without self, ties to the smaller j."""
    keep = pairs.smallest(k, False, False) if k > 0 else lambda i, j, d: i[:, None] != j[None]
    return pairs.distances(vector_payload(rows, id_col, vec_col), pairs.cosine, keep, n=rows.count())


def first_k(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of each i, ties to the smaller j; all of them for k <= 0."""
    if k <= 0:
        return edges
    rank = F.row_number().over(W.partitionBy("i").orderBy("d", "j"))
    return edges.withColumn("r", rank).where(F.col("r") <= k).drop("r")


def set_payload(presence: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, v): the hashes of each node's distinct features (id, feature) as bytes; nodes (id) without any have none.

    Null ids and features don't count, nor do ids that aren't nodes.
    """
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.unique(np.array(x or [], dtype="<i8")).tobytes() for x in b.column(1).to_pylist()], pa.binary())], names=["id", "v"])

    cells = presence.where("id is not null and feature is not null").select("id", F.xxhash64("feature").alias("h")).distinct()
    own = cells.groupBy("id").agg(F.collect_list("h").alias("h"))  # one sample's features
    return nodes.select("id").distinct().join(own, "id", "left").mapInArrow(run, "id long, v binary")


def set_blocks(presence: DataFrame, nodes: DataFrame, n: int | None = None, block: int | None = None) -> DataFrame:
    """Blocks of the nodes' (id) distinct features (id, feature), see ``sets``; nulls, and ids that aren't nodes, don't count."""
    n = nodes.select("id").distinct().count() if n is None else n
    cells = presence.where("feature is not null").select("id", F.lit(0).alias("at"), F.xxhash64("feature").alias("h"))
    return sets.packed(cells, nodes, n, block=block)


def jaccard(presence: DataFrame, nodes: DataFrame, full: bool = True) -> DataFrame:
    """EDGES of Jaccard distances of feature sets, without self; presence: (id, feature), nodes: (id).

    With ``full`` between all nodes: 1 between sets that share nothing, 0 between two empty ones; else of pairs that share a feature.
    """
    if full:
        return sets.met(set_blocks(presence, nodes), **sets.every(sets.jaccard, 1.0))
    worn = nodes.join(presence.where("feature is not null"), "id", "left_semi")
    return _jaccard_where(set_blocks(presence, worn), lambda d: d < 1)


def _jaccard_where(blocks: DataFrame, keep) -> DataFrame:
    """EDGES that ``keep`` chooses by their distances; it takes none at 1."""

    def visit(a, b):
        d = sets.jaccard(a, b)
        x, y = np.nonzero(keep(d) & (a.ids[:, None] != b.ids[None]))
        yield a.ids[x], b.ids[y], d[x, y]

    return sets.met(blocks, visit, pairs.EDGES)


def jaccard_knn(presence: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """The k nearest by Jaccard distance, ties to the smaller j; fewer where there are fewer other nodes."""
    n = nodes.select("id").distinct().count()
    if k >= n - 1:  # all others: nothing to rank
        return sets.met(set_blocks(presence, nodes, n), **sets.every(sets.jaccard, 1.0))
    blocks = set_blocks(presence, nodes, n, max(1, min(sets.BLOCK, sets.HELD // max(1, k))))
    return sets.met(blocks, **sets.nearest(pairs.smallest(k, False, False), k, sets.jaccard, 1.0))


def prefix_keys(presence: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(id, key): each set's rarest features, so many that sets of a Jaccard distance below the threshold share one; stored.

    Sets that similar share more than (1 - threshold) times the size of either; in an order that all agree on, the first features of both,
    but for so many, must meet.
    """
    cells = presence.where("id is not null and feature is not null").select("id", F.xxhash64("feature").alias("h")).distinct().join(nodes.select("id").distinct(), "id", "left_semi")
    cells = storage.stored(cells, "cells")
    often = cells.groupBy("h").agg(F.count("*").alias("n"))
    own = cells.join(often, "h").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "h"))).alias("x"))  # one sample's features
    size = F.size("x")
    shared = F.greatest(F.lit(1), F.ceil(size * (1 - threshold - 1e-9)))
    return storage.stored(own.select("id", F.explode(F.slice("x", F.lit(1), (size - shared + 1).cast("int"))).alias("f")).select("id", F.col("f.h").alias("key")), "prefixes")


def jaccard_threshold(presence: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """EDGES strictly below the threshold, without self.

    Sets that share a feature of their prefixes are compared, and empty sets with each other.  Where that is more than all pairs, or
    would copy sets too often, blocks that share a feature are compared.
    """
    low = lambda i, j, d: (i[:, None] != j[None]) & (d < threshold)
    if threshold > 1:
        return jaccard(presence, nodes).where(F.col("d") < threshold)
    n = nodes.select("id").distinct().count()
    features = presence.groupBy("id").agg(F.count("feature").alias("m"))
    copies, cells = features.agg(F.sum(F.col("m") * F.ceil(F.col("m") * threshold)), F.sum("m")).first()
    if (copies or 0) > KEYED * (cells or 0):
        return _jaccard_where(set_blocks(presence, nodes, n), lambda d: d < threshold)
    keys = prefix_keys(presence, nodes, threshold)
    if pairs.comparisons(keys) >= n * n:
        return _jaccard_where(set_blocks(presence, nodes, n), lambda d: d < threshold)
    rows = storage.stored(set_payload(presence, nodes), "sets")
    empty = rows.where(F.length("v") == 0)
    return pairs.keyed(keys, rows, pairs.jaccard, low).unionByName(pairs.distances(empty, pairs.jaccard, low))


def below(edges: DataFrame, threshold: float) -> DataFrame:
    """Edges strictly below the threshold."""
    return edges.where(F.col("d") < threshold)
