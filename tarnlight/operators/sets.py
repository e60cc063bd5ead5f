"""All pairs of sets in blocks, where blocks that share no element don't meet.

Rows are dealt into blocks by ranges of their ids, so that copies of a set of samples, or any others that lie together, share blocks.  A panel
of a few blocks is held by a task, past which those blocks stream that have an element in common with it; of the others it is told the ids at
most.  Counting the elements of a pair of blocks takes as long as there are pairs of rows under each element, or, for an element that
many rows have, a column of a matrix product.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage

#: Rows in a block at most, blocks in a panel, bytes of sets in a panel (a block may have more), rows of a block at least.
BLOCK, PANEL, PANEL_BYTES, LEAST = 512, 8, 64 << 20, 64
#: Pairs of rows counted at once, columns of a matrix product, products that cost as much as counting a pair, rows in a batch of results.
AT_ONCE, COLUMNS, DENSE, BATCH = 2_000_000, 1024, 120, 200_000
#: Candidates that a panel collects before it drops the worse ones.
HELD = 2_000_000
#: Fewer blocks all meet; for more, one element of so many is looked at first.
FEW, SAMPLE = 12, 64
#: Numbers of a genome: its length and the shares of the bases.
BASES = ("a", "c", "g", "t")
GENOME = 1 + len(BASES)


class Sets:
    """Sets of 64-bit numbers, end to end with their sizes."""

    def __init__(self, sizes: np.ndarray, flat: np.ndarray):
        self.sizes, self.flat, self._index = sizes, flat, None

    def index(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Elements in rising order, where the rows of each begin and how many they are, and these rows."""
        if self._index is None:
            order = np.argsort(self.flat, kind="stable")
            e = self.flat[order]
            start = np.flatnonzero(np.concatenate([np.ones(min(1, len(e)), dtype=bool), e[1:] != e[:-1]]))
            rows = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)[order]
            self._index = e[start], start, np.diff(start, append=len(e)), rows
        return self._index


def shared(a: Sets, b: Sets) -> np.ndarray:
    """Sizes of the intersections."""
    n, m = len(a.sizes), len(b.sizes)
    out = np.zeros(n * m)
    (ea, sa, ca, ra), (eb, sb, cb, rb) = a.index(), b.index()
    if not len(ea) or not len(eb):
        return out.reshape(n, m)
    at = np.minimum(np.searchsorted(ea, eb), len(ea) - 1)
    y = np.flatnonzero(ea[at] == eb)
    x = at[y]
    dense = ca[x] * cb[y] * DENSE >= n * m
    # elements that few rows have: each row of b under one meets all rows of a under it
    x_few, y_few = x[~dense], y[~dense]
    own = cb[y_few]
    first = np.repeat(sb[y_few] - np.cumsum(own) + own, own) + np.arange(own.sum())
    row, start, count = rb[first], np.repeat(sa[x_few], own), np.repeat(ca[x_few], own)
    ends = np.cumsum(count)
    lo = 0
    while lo < len(count):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + AT_ONCE, side="right")))
        c = count[lo:hi]
        place = np.repeat(start[lo:hi] - np.cumsum(c) + c, c) + np.arange(c.sum())
        out += np.bincount(ra[place].astype(np.int64) * m + np.repeat(row[lo:hi], c), minlength=n * m)
        lo = hi
    out = out.reshape(n, m)
    for lo in range(0, int(dense.sum()), COLUMNS):
        sides = []
        for (_, start, count, rows), which, height in ((a.index(), x[dense], n), (b.index(), y[dense], m)):
            which = which[lo : lo + COLUMNS]
            c = count[which]
            side = np.zeros((height, len(which)), dtype=np.float32)
            side[rows[np.repeat(start[which] - np.cumsum(c) + c, c) + np.arange(c.sum())], np.repeat(np.arange(len(which)), c)] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out


class Block:
    """Rows of a block or panel: ids, Sets of each section, and genomes (rows x GENOME, zeros without)."""

    def __init__(self, ids: np.ndarray, sections: list[Sets], genomes: np.ndarray | None):
        self.ids, self.sections, self.genomes = ids, sections, genomes

    @staticmethod
    def read(ids: bytes, counts: bytes, genomes: bytes, data: bytes, n: int) -> Block:
        own = np.frombuffer(ids, dtype="<i8")
        sizes, flat, sections, at = np.frombuffer(counts, dtype="<i8").reshape(n, -1), np.frombuffer(data, dtype="<i8"), [], 0
        for s in sizes:
            sections.append(Sets(s, flat[at : at + s.sum()]))
            at += s.sum()
        return Block(own, sections, np.frombuffer(genomes, dtype="<f8").reshape(-1, GENOME) if genomes else None)

    @staticmethod
    def joined(blocks: list[Block]) -> Block:
        if len(blocks) == 1:
            return blocks[0]
        sections = [Sets(np.concatenate([x.sizes for x in s]), np.concatenate([x.flat for x in s])) for s in zip(*(b.sections for b in blocks), strict=True)]
        return Block(np.concatenate([b.ids for b in blocks]), sections, None if blocks[0].genomes is None else np.concatenate([b.genomes for b in blocks]))


def packed(cells: DataFrame, nodes: DataFrame, n: int, sections: int = 1, genomes: DataFrame | None = None, block: int | None = None) -> DataFrame:
    """Blocks (b, ids, counts, genomes, data) of the n different ids of ``nodes`` and the distinct elements of ``cells`` (id, at, h) in each section ``at``; stored.

    Other ids of ``cells``, and nulls, don't count.  genomes: (id, length, a, c, g, t).
    """
    block = block or BLOCK
    few = min(block, max(LEAST, -(-n // (2 * cells.sparkSession.sparkContext.defaultParallelism))))
    marks = nodes.where("id is not null").select("id", F.lit(-1).alias("at"), F.lit(0).cast("long").alias("h"))
    rows = cells.where("id is not null and at is not null and h is not null").select("id", F.col("at").cast("int").alias("at"), "h").unionByName(marks)
    with_genomes = genomes is not None
    if with_genomes:
        rows = rows.unionByName(_as_cells(genomes))

    def run(batches):
        got = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
        if not got:
            return
        ids, at, h = (np.concatenate(c) for c in zip(*got, strict=True))
        got.clear()
        order = np.lexsort((h, at, ids))
        ids, at, h = ids[order], at[order], h[order]
        other = (ids[1:] != ids[:-1]) | (at[1:] != at[:-1])
        new = np.concatenate([[True], other | ((h[1:] != h[:-1]) & (at[1:] >= 0))])  # of a genome's numbers the first
        ids, at, h = ids[new], at[new], h[new]
        own = ids[at == -1]
        for k, lo in enumerate(range(0, len(own), few)):
            mine = own[lo : lo + few]
            here = slice(np.searchsorted(ids, mine[0]), np.searchsorted(ids, mine[-1], side="right"))
            i, a, x = ids[here], at[here], h[here]
            row = np.minimum(np.searchsorted(mine, i), len(mine) - 1)
            known = mine[row] == i
            counts, data = [], []
            for s in range(sections):
                good = known & (a == s)
                counts.append(np.bincount(row[good], minlength=len(mine)).astype("<i8"))
                data.append(x[good])
            whole = np.zeros((len(mine), GENOME))
            for g in range(GENOME):
                good = known & (a == -2 - g)
                whole[row[good], g] = x[good].view(np.float64)
            out = (mine.tobytes(), np.concatenate(counts).tobytes(), whole.tobytes() if with_genomes else b"", np.concatenate(data).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([(TaskContext.get().partitionId() << 24) + k], pa.int64()), *(pa.array([v], pa.large_binary()).cast(pa.binary()) for v in out)], names=["b", "ids", "counts", "genomes", "data"])

    dealt = rows.repartitionByRange(max(1, -(-n // few)), "id")
    return storage.stored(dealt.mapInArrow(run, "b long, ids binary, counts binary, genomes binary, data binary"), "sets", free=True)


def _as_cells(genomes: DataFrame) -> DataFrame:
    """(id, at, h): numbers of whole genomes as the bits of doubles, at -2 and below."""

    def run(batches):
        for b in batches:
            for g in range(GENOME):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(b.num_rows, -2 - g, dtype=np.int32)), pa.array(b.column(1 + g).to_numpy(zero_copy_only=False).view(np.int64))], names=["id", "at", "h"])

    numbers = [F.col(c).cast("double").alias(c) for c in ("length", *BASES)]
    return genomes.where("id is not null").select("id", *numbers).dropna().mapInArrow(run, "id long, at int, h long")


def met(blocks: DataFrame, visit: Callable, out: str, away: Callable | None = None, prune: Callable | None = None, least: int | None = None, rows: int | None = None) -> DataFrame:
    """What ``visit(panel, block)`` gives of each panel and block with an element in common, columns named by ``out``: tuples of arrays.

    away(ids, others) gives the rest for the ids of a panel and those of each block that it doesn't meet, or once for the ``least`` smallest of
    these; two empty sets count as a common element.  prune(columns) chooses once more from what a panel got; then its results are held.
    rows: in a panel at most, where a caller needs fewer.
    """
    spark = blocks.sparkSession
    known = sorted(tuple(r) for r in blocks.select("b", (F.length("ids") / 8).cast("long"), F.length("data").cast("long")).collect())  # a row for each block
    panels = _panels(known, spark.sparkContext.defaultParallelism, rows)
    count = panels[-1] + 1 if panels else 1
    of = dict(zip([b for b, _, _ in known], panels, strict=True))
    names = [c.split()[0] for c in out.split(", ")]
    own = spark.createDataFrame(list(of.items()), "b long, panel int")
    past = _meeting(blocks, of, count)
    columns = ["panel", "side", "b", "ids", "counts", "genomes", "data"]
    mine = blocks.join(F.broadcast(own), "b").withColumn("side", F.lit(0))
    if past is None or away is not None:
        every = blocks.join(F.broadcast(own.select("b", F.col("panel").alias("home"))), "b").withColumn("panel", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).where("panel <> home")
        if past is not None:
            every = every.join(F.broadcast(past), "b", "left").withColumns({c: F.when(F.array_contains("past", F.col("panel")), F.col(c)) for c in ("counts", "genomes", "data")})
    else:
        every = blocks.join(F.broadcast(past), "b").withColumn("panel", F.explode("past"))
    both = mine.select(*columns).unionByName(every.withColumn("side", F.lit(1)).select(*columns)).repartition(count, "panel").sortWithinPartitions("panel", "side", "b")

    def run(batches):
        panel, parts, whole, held, n, rest = None, [], None, [], 0, np.zeros(0, dtype=np.int64)

        def settled():
            return prune(*(np.concatenate(c) for c in zip(*held, strict=True)))

        def results(found: Iterator) -> Iterator:
            nonlocal n
            for columns in found:
                if prune is None:
                    for lo in range(0, len(columns[0]), BATCH):
                        yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + BATCH]) for c in columns], names=names)
                    continue
                held.append(columns)
                n += len(columns[0])
                if n > HELD:
                    held[:] = [settled()]
                    n = len(held[0][0])

        def gathered() -> Iterator:
            """The panel's own blocks have all come: they meet each other."""
            nonlocal whole
            if whole is None and parts:
                whole = Block.joined(parts)
                for part in parts:
                    yield from results(visit(whole, part))

        def ended() -> Iterator:
            nonlocal n, rest
            yield from gathered()
            if len(rest):
                yield from results(away(whole.ids, rest))
                rest = rest[:0]
            if held:
                last = settled()
                for lo in range(0, len(last[0]), BATCH):
                    yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + BATCH]) for c in last], names=names)
            held.clear()
            n = 0

        for batch in batches:
            for at in range(batch.num_rows):
                number, side, ids, counts, genomes, data = (batch.column(k)[at].as_py() for k in (0, 1, 3, 4, 5, 6))
                if number != panel:
                    yield from ended()
                    panel, parts, whole = number, [], None
                if side == 0:
                    parts.append(Block.read(ids, counts, genomes, data, len(counts) // len(ids)))
                    continue
                yield from gathered()
                if data is None and least is not None:
                    rest = np.sort(np.append(rest, np.frombuffer(ids, dtype="<i8")))[:least]
                elif data is None:
                    yield from results(away(whole.ids, np.frombuffer(ids, dtype="<i8")))
                else:
                    yield from results(visit(whole, Block.read(ids, counts, genomes, data, len(counts) // len(ids))))
        yield from ended()

    return both.mapInArrow(run, out)


def _panels(known: list[tuple], cores: int, rows: int | None) -> list[int]:
    """The panel of each block: as many as PANEL in a row, such that all cores have work to the end, within bounds of rows and bytes."""
    wide = min(range(1, PANEL + 1), key=lambda w: (-(--(-len(known) // w) // cores) * w, -w))
    out, blocks, size, height = [], 0, 0, 0
    for _, n, data in known:
        if out and blocks < wide and size + data <= PANEL_BYTES and (rows is None or height + n <= rows):
            out.append(out[-1])
        else:
            out.append(out[-1] + 1 if out else 0)
            blocks = size = height = 0
        blocks, size, height = blocks + 1, size + data, height + n
    return out


def _meeting(blocks: DataFrame, of: dict[int, int], count: int) -> DataFrame | None:
    """(b, past): the panels, not its own, with which each block has an element in common; None where most pairs are such."""
    if len(of) < FEW:
        return None
    spark = blocks.sparkSession
    numbers = storage.sent(spark, (np.array(list(of)), np.array(list(of.values()))))

    def elements(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                b, counts, data = (batch.column(k)[at].as_py() for k in range(3))
                found = np.unique(np.frombuffer(data, dtype="<i8"))
                if not np.frombuffer(counts, dtype="<i8").all():
                    found = np.append(found, 0)  # stands for the empty sets too; an element 0 does no harm
                for lo in range(0, len(found), BATCH):
                    some = found[lo : lo + BATCH]
                    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.full(len(some), b))], names=["h", "b"])

    def meet(batches):
        got = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
        if not got:
            return
        h, b = (np.concatenate(c) for c in zip(*got, strict=True))
        names, panels = numbers()
        order = np.argsort(h, kind="stable")
        h, b = h[order], np.searchsorted(names, b[order])
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.repeat(np.diff(start, append=len(h)), np.diff(start, append=len(h)))
        first, seen, lo, ends = np.repeat(start, np.diff(start, append=len(h))), np.zeros((len(names), count), dtype=bool), 0, np.cumsum(size)
        while lo < len(h):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + AT_ONCE, side="right")))
            c = size[lo:hi]
            other = np.repeat(first[lo:hi] - np.cumsum(c) + c, c) + np.arange(c.sum())
            seen[np.repeat(b[lo:hi], c), panels[b[other]]] = True
            lo = hi
        x, y = np.nonzero(seen)
        away = panels[x] != y
        yield pa.RecordBatch.from_arrays([pa.array(names[x[away]]), pa.array(y[away].astype(np.int32))], names=["b", "panel"])

    every = blocks.select("b", "counts", "data").mapInArrow(elements, "h long, b long")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(of))
    some = every.where(F.pmod("h", F.lit(SAMPLE)) == 0).repartition("h").mapInArrow(meet, "b long, panel int").distinct().count()
    if some * 2 >= len(of) * (count - 1):
        return None
    found = every.repartition(parts, "h").mapInArrow(meet, "b long, panel int").distinct().groupBy("b").agg(F.collect_set("panel").alias("past"))  # panels of one block
    return storage.stored(found, "meets", free=True)


def nearest(keep: Callable, k: int, distance: Callable, apart: float) -> dict:
    """Arguments of ``met`` for the k that ``keep`` (see ``pairs.smallest``) chooses of each row's others by distance(panel, block); ``apart``: that of sets without a common element."""

    def visit(a, b):
        d = distance(a, b)
        x, y = np.nonzero(keep(a.ids, b.ids, d))
        yield a.ids[x], b.ids[y], d[x, y]

    def away(ids, others):
        yield np.repeat(ids, len(others)), np.tile(others, len(ids)), np.full(len(ids) * len(others), apart)

    def prune(i, j, d):
        good = keep.prune(i, j, d)
        return i[good], j[good], d[good]

    return {"visit": visit, "out": "i long, j long, d double", "away": away, "prune": prune, "least": k, "rows": max(1, HELD // max(1, k))}


def every(distance: Callable, apart: float) -> dict:
    """Arguments of ``met`` for all ordered pairs but a row with itself."""

    def visit(a, b):
        d = distance(a, b)
        wide = max(1, BATCH // len(b.ids))
        same = len(np.intersect1d(a.ids, b.ids)) > 0
        for lo in range(0, len(a.ids), wide):
            some = a.ids[lo : lo + wide]
            i, j, e = np.repeat(some, len(b.ids)), np.tile(b.ids, len(some)), d[lo : lo + wide].ravel()
            other = i != j
            yield (i[other], j[other], e[other]) if same else (i, j, e)

    def away(ids, others):
        wide = max(1, BATCH // len(others))
        for lo in range(0, len(ids), wide):
            some = ids[lo : lo + wide]
            yield np.repeat(some, len(others)), np.tile(others, len(some)), np.full(len(some) * len(others), apart)

    return {"visit": visit, "out": "i long, j long, d double", "away": away}


def jaccard(a: Block, b: Block, section: int = 0) -> np.ndarray:
    """Jaccard distances; 0 between two empty sets."""
    x, y = a.sections[section], b.sections[section]
    both = shared(x, y)
    union = x.sizes[:, None] + y.sizes[None] - both
    return np.where(union > 0, 1 - both / np.maximum(1, union), 0.0)
