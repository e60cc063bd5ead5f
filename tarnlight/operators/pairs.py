"""All-pairs distances in blocks.

Rows are packed into blocks, one row a block.  A panel of a few blocks is held by a task, past which all blocks stream: it
computes their distances as one matrix each and keeps only what the caller wants of them, so the k nearest of a row are
settled where they are found.  A task holds a panel, a block and their distances, whatever the input.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sets, storage

#: Rows in a block on average, blocks in a panel at most, and candidates that a panel collects before it drops the worse ones.
BLOCK, PANEL, HELD = 512, 8, 2_000_000
#: Rows of a block at least.
LEAST = 64
EDGES = "i long, j long, d double"


def packed(rows: DataFrame, block: int = BLOCK, n: int | None = None) -> tuple[DataFrame, int]:
    """(b, ids, sizes, data) of the n rows (id long, v binary), and the number of blocks; sizes are those of the payloads.

    Few rows make smaller blocks, so that all cores have some.
    """
    n = rows.count() if n is None else n
    block = min(block, max(LEAST, -(-n // (2 * rows.sparkSession.sparkContext.defaultParallelism))))
    blocks = max(1, -(-n // block))
    dealt = rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("b"), "id", "v")

    def pack(batches):
        b, ids, data = None, [], []
        for batch in batches:
            for x, i, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if x != b and ids:
                    yield _packed(b, ids, data)
                    ids, data = [], []
                b = x
                ids.append(i)
                data.append(v)
        if ids:
            yield _packed(b, ids, data)

    def _packed(b, ids, data):
        parts = (np.array(ids, dtype="<i8").tobytes(), np.array([len(v) for v in data], dtype="<i8").tobytes(), b"".join(data))
        return pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), *(pa.array([x], pa.binary()) for x in parts)], names=["b", "ids", "sizes", "data"])

    return storage.stored(dealt.repartition(blocks, "b").sortWithinPartitions("b", "id").mapInArrow(pack, "b long, ids binary, sizes binary, data binary"), "blocks"), blocks


def distances(rows: DataFrame, kernel: Callable, keep: Callable, block: int = BLOCK, n: int | None = None, out: str = EDGES) -> DataFrame:
    """EDGES of the pairs that ``keep`` chooses from all ordered pairs.

    rows: (id, v); kernel(a, b): distances of the payloads of a panel and a block, each a uint8 array (rows x width), or, if
    the kernel has ``ragged`` set, the payloads end to end and their sizes; keep(i, j, d): boolean matrix of what to emit for ids
    i and j and their distances d.  If it has ``prune``, that chooses once more from what all blocks gave a panel.  A kernel may give
    several matrices as an array of one more axis, of which ``out`` names the columns; ``keep`` sees the first.  n: the number of rows, where it is known.
    """
    blocks, n = packed(rows, block, n)
    return _streamed(blocks, n, blocks, kernel, keep, out)


def across(few: DataFrame, rows: DataFrame, kernel: Callable, keep: Callable, block: int = BLOCK) -> DataFrame:
    """EDGES between rows of ``few`` and others of ``rows``, which holds them too, in both directions and without self, as ``distances`` finds them."""
    own, n = packed(few, block)
    found = _streamed(own, n, packed(rows, block)[0], kernel, keep, EDGES).where("i <> j")
    return found.unionByName(found.select(F.col("j").alias("i"), F.col("i").alias("j"), "d")).distinct()


def _streamed(blocks: DataFrame, n: int, past: DataFrame, kernel: Callable, keep: Callable, out: str) -> DataFrame:
    """Panels of the n ``blocks``, by each of which all blocks of ``past`` stream."""
    tasks = 2 * blocks.sparkSession.sparkContext.defaultParallelism
    wide = min(PANEL, max(1, n // tasks))
    panels = -(-n // wide)
    own = blocks.select(F.floor(F.col("b") / wide).alias("panel"), F.lit(0).alias("side"), "b", "ids", "sizes", "data")
    every = past.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(panels - 1).cast("long"))).alias("panel"), F.lit(1).alias("side"), "b", "ids", "sizes", "data")
    both = own.unionByName(every).repartition(panels, "panel").sortWithinPartitions("panel", "side", "b").select("panel", "side", "ids", "sizes", "data")
    prune = getattr(keep, "prune", None)

    names = [c.split()[0] for c in out.split(", ")]

    def batch(found):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=names)

    def run(batches):
        panel, mine, held, count = None, [], [], 0

        def settled():
            found = [np.concatenate(c) for c in zip(*held, strict=True)]
            good = prune(*found[:3])
            return tuple(x[good] for x in found)

        for rows in batches:
            for number, side, *row in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                if number != panel:
                    if held:
                        yield batch(settled())
                    panel, mine, held, count = number, [], [], 0
                if side == 0:
                    mine.append(row)
                    continue
                if len(mine) > 1:
                    mine = [[b"".join(r[k] for r in mine) for k in range(3)]]
                if not mine:  # a number that no id was dealt to
                    continue
                i, j = (np.frombuffer(x, dtype="<i8") for x in (mine[0][0], row[0]))
                a, b = (_payloads(r, kernel) for r in (mine[0], row))
                d = kernel(a, b)
                layers = d if d.ndim == 3 else d[None]
                x, y = np.nonzero(keep(i, j, layers[0]))
                found = i[x], j[y], *(m[x, y].astype(np.float64) for m in layers)
                if prune is None:
                    yield batch(found)
                    continue
                held.append(found)
                count += len(x)
                if count > HELD:
                    held = [settled()]
                    count = len(held[0][0])
        if held:
            yield batch(settled())

    return both.mapInArrow(run, out)


def _payloads(row, kernel):
    ids, sizes, data = row
    flat = np.frombuffer(data, dtype=np.uint8)
    return (flat, np.frombuffer(sizes, dtype="<i8")) if getattr(kernel, "ragged", False) else flat.reshape(len(ids) // 8, -1)


def hamming_planes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions without a base in common, for payloads of a length (int64) and four planes of 64-bit words."""
    a, b = np.ascontiguousarray(a).view(np.uint64), np.ascontiguousarray(b).view(np.uint64)
    length, words = int(a[0, 0]), (a.shape[1] - 1) // 4
    same = np.zeros((len(a), len(b)), dtype=np.int64)
    for w in range(words):
        bits = np.zeros((len(a), len(b)), dtype=np.uint64)
        for p in range(4):
            k = 1 + p * words + w
            bits |= a[:, k, None] & b[None, :, k]
        same += np.bitwise_count(bits)
    return length - same


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 - cosine of float64 vectors; 1 where either is zero."""
    a, b = np.ascontiguousarray(a).view(np.float64), np.ascontiguousarray(b).view(np.float64)
    n = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None]
    return 1 - np.divide(a @ b.T, n, out=np.zeros_like(n), where=n > 0)


def euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of float64 vectors of few dimensions."""
    a, b = np.ascontiguousarray(a).view(np.float64), np.ascontiguousarray(b).view(np.float64)
    out = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        out += (a[:, k, None] - b[None, :, k]) ** 2
    return np.sqrt(out)


def shared(a, b) -> np.ndarray:
    """Sizes of the intersections of sets of 64-bit numbers, given end to end with their sizes in bytes."""
    return sets.shared(*(sets.Sets(sizes // 8, np.ascontiguousarray(flat).view(np.int64)) for flat, sizes in (a, b)))


def jaccard(a, b) -> np.ndarray:
    """Jaccard distances of sets; 0 between two empty ones."""
    both = shared(a, b)
    union = (a[1] // 8)[:, None] + (b[1] // 8)[None] - both
    return np.where(union > 0, 1 - both / np.maximum(1, union), 0.0)


jaccard.ragged = True


def smallest(k: int, ties: bool, self_too: bool):
    """keep: the k smallest distances of each row, ties to the smaller j; with ``ties`` all that equal the last of them.

    A matrix that holds a row's distances to one block gives its candidates, ``prune`` the final ones.
    """

    def keep(i, j, d):
        e = d if self_too else np.where(i[:, None] == j[None], np.inf, d)
        ok = np.isfinite(e)
        if e.shape[1] <= k:
            return ok
        cut = np.partition(e, k - 1, axis=1)[:, k - 1 : k]
        below = ok & (e <= cut)
        if ties:
            return below
        # exactly k: of those at the cut, the smallest ids
        order = slice(None) if (j[1:] > j[:-1]).all() else np.argsort(j)
        here = (e == cut)[:, order] & ok[:, order]
        need = k - (ok & (e < cut)).sum(1, keepdims=True)
        here &= np.cumsum(here, axis=1, dtype=np.int32) <= need
        below = ok & (e < cut)
        below[:, order] |= here
        return below

    def prune(i, j, d):
        order = np.lexsort((j, d, i))
        start = np.flatnonzero(np.diff(i[order], prepend=i[order[:1]] - 1))
        size = np.diff(start, append=len(order))
        rank = np.arange(len(order)) - np.repeat(start, size)
        last = d[order[start + np.minimum(size, k) - 1]]
        good = np.zeros(len(order), dtype=bool)
        good[order] = d[order] <= np.repeat(last, size) if ties else rank < k
        return good

    keep.prune = prune
    return keep


def keyed(keys: DataFrame, rows: DataFrame, kernel: Callable, keep: Callable, block: int = BLOCK) -> DataFrame:
    """EDGES of the ordered pairs that share a key and that ``keep`` chooses; keys: (id, key) without repeats, rows: (id, v) as for ``distances``.

    Rows of a key meet within tasks; those of a key of many are dealt into blocks, each two of which meet in a task.
    """
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    grid = F.ceil(F.col("n") / block).cast("long")
    own = keys.join(sizes, "key").select("key", "id", F.pmod(F.xxhash64("id", F.lit(5)), grid).alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), grid - 1)).alias("other"))
    dealt = own.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).cast("int").alias("side"), "id").join(rows, "id")
    dealt = dealt.select("key", "lo", "hi", "side", "id", "v").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "side", "id")

    def run(batches):
        key, held, found, count = None, [[], []], [], 0

        def met():
            a, b = held[0], held[1] if key[1] != key[2] else held[0]
            if not a or not b:
                return
            ids = [np.array([i for i, _ in side], dtype=np.int64) for side in (a, b)]
            d = kernel(*(_payloads((i.tobytes(), np.array([len(v) for _, v in side], dtype="<i8").tobytes(), b"".join(v for _, v in side)), kernel) for i, side in zip(ids, (a, b), strict=True)))
            x, y = np.nonzero(keep(ids[0], ids[1], d) & (ids[0][:, None] != ids[1][None]))
            i, j, e = ids[0][x], ids[1][y], d[x, y].astype(np.float64)
            found.append((i, j, e))
            if key[1] != key[2]:
                found.append((j, i, e))

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["i", "j", "d"])

        for b in batches:
            for k, lo, hi, side, i, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (k, lo, hi) != key:
                    if key is not None:
                        met()
                    key, held = (k, lo, hi), [[], []]
                    count = sum(len(f[0]) for f in found)
                    if count > 100_000:
                        yield batch()
                        found.clear()
                held[side].append((i, v))
        if key is not None:
            met()
        if found:
            yield batch()

    return dealt.mapInArrow(run, EDGES).distinct()


def comparisons(keys: DataFrame) -> int:
    """Pairs that ``keyed`` compares, self pairs among them."""
    return keys.groupBy("key").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
