"""Spanning forests of sparse graphs, and density clusters chosen from the single-linkage hierarchy of a spanning tree.

All edges of one length merge their parts at once, so the hierarchy depends on the distances alone and not on which of several spanning
trees is taken.  A part that edges have merged is summed up in a row: its points, and what choosing clusters by excess of mass needs
to know of everything within it.  So edges can be contracted in rising order, groups of them in parallel, without a tree of all points.

Clusters born below ``epsilon`` give way to those above, so edges shorter than that are contracted first.  What is left are parts that lie
``epsilon`` apart from each other: in a scaled plane, whose area is 4, these are a few ten thousand however many points there are, and
one task builds their tree and chooses clusters.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage

#: Edges that a task merges at most; more are contracted in groups first.
LOCAL_EDGES = 500_000
#: The rate, one over the distance, of points at no distance.
MAX_RATE = 1e290
EDGES = "i long, j long, d double"


def rate(d: float) -> float:
    return min(1 / d, MAX_RATE) if d > 0 else MAX_RATE


class Union:
    """Disjoint sets of the numbers below n; the smallest of a set stands for it."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _kruskal(i: np.ndarray, j: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Positions of the edges of a minimum spanning forest, by (d, i, j)."""
    ids, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    union, order = Union(len(ids)), np.lexsort((j, i, d))
    a, b = at[: len(i)][order].tolist(), at[len(i) :][order].tolist()
    return order[[k for k in range(len(order)) if union.join(a[k], b[k])]]


def forest(edges: DataFrame) -> DataFrame:
    """EDGES of a minimum spanning forest of a graph's edges, ties by i and j; stored.

    Tasks drop what closes a cycle within their partition.  While many edges are left, each part takes its least edge to another, and
    parts are contracted, at least halving their number each round.
    """
    spark = edges.sparkSession

    def kept(batches):
        held = [tuple(c.to_numpy() for c in b.columns) for b in batches if b.num_rows]
        if held:
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            good = _kruskal(*cols[:3])
            yield pa.RecordBatch.from_arrays([pa.array(c[good]) for c in cols], names=["u", "v", "d", "i", "j"])

    work = "u long, v long, d double, i long, j long"
    left = storage.stored(edges.select(F.col("i").alias("u"), F.col("j").alias("v"), "d", "i", "j").mapInArrow(_in_pieces(kept), work), "graph")
    tree = spark.createDataFrame([], EDGES)
    while left.count() > LOCAL_EDGES:
        ends = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v"), "d", "i", "j"))
        least = storage.stored(ends.groupBy("u").agg(F.min(F.struct("d", "i", "j", "v")).alias("e")).select("u", "e.*"), "least")
        tree = storage.stored(tree.unionByName(least.select("i", "j", "d").distinct()), "tree")
        part = components(least.select(F.col("u").alias("i"), F.col("v").alias("j")))
        moved = left.join(part.select(F.col("v").alias("u"), F.col("c").alias("cu")), "u").join(part.select("v", F.col("c").alias("cv")), "v").where("cu <> cv")
        least_between = moved.groupBy(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v")).agg(F.min(F.struct("d", "i", "j")).alias("e"))
        left = storage.stored(least_between.select("u", "v", "e.*"), "graph")
    last = left.repartition(1).mapInArrow(kept, work).select("i", "j", "d")
    return storage.stored(tree.unionByName(last), "tree")


def _in_pieces(kept):
    """``kept`` over some LOCAL_EDGES rows of a partition at a time."""

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= LOCAL_EDGES:
                yield from kept(held)
                held, size = [], 0
        yield from kept(held)

    return run


def components(links: DataFrame) -> DataFrame:
    """(v, c): each end of the links (i, j) with the smallest number that it is linked with; stored.

    Numbers fall along links and along what was found before, so rounds grow with the logarithm of the longest way.
    """
    spark = links.sparkSession
    ends = storage.new_path(spark, "links")
    both = storage.stored(links.select("i", "j").unionByName(links.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct(), "links", ends)
    old = storage.new_path(spark, "labels")
    label = storage.stored(both.groupBy(F.col("i").alias("v")).agg(F.least(F.min("j"), F.first("i")).alias("c")), "labels", old)
    while True:
        low = both.join(label.select(F.col("v").alias("j"), "c"), "j").groupBy("i").agg(F.min("c").alias("o"))
        # the part that a point was in follows the least number seen by any of it
        seen = label.join(low, label.v == low.i).select("v", "c", F.least("c", "o").alias("o"))
        hook = seen.groupBy("c").agg(F.min("o").alias("o"))
        step = seen.select("v", "c", F.col("o").alias("own")).join(hook, "c").select("v", F.col("c").alias("old"), F.least("own", "o").alias("n"))
        jump = step.select(F.col("v").alias("n"), F.col("n").alias("top"))
        path = storage.new_path(spark, "labels")
        new = storage.stored(step.join(jump, "n").select("v", F.col("top").alias("c"), (F.col("top") != F.col("old")).alias("moved")), "labels", path)
        storage.drop(spark, old)
        label, old = new.select("v", "c"), path
        if not new.where("moved").limit(1).count():
            storage.drop(spark, ends)
            return label


#: A part: its smallest position, points, the height at which it was last merged (-1 for a single point), and of that merge: points that
#: were single, merged parts, their points, the sum of what they are worth as clusters, and, of a lone one, see ``closed``.
PART = "part long, size long, height double, points long, parts long, part_points long, worth double, mass double, inner double, lost boolean"
FIELDS = tuple(x.split()[0] for x in PART.split(", "))


class Part:
    __slots__ = FIELDS

    def __init__(self, *values):
        for f, v in zip(FIELDS, values, strict=True):
            setattr(self, f, v)

    def row(self) -> tuple:
        return tuple(getattr(self, f) for f in FIELDS)


def closed(x: Part) -> tuple[float, float, bool]:
    """(mass, inner, lost) of a part that isn't merged any more at its height.

    mass: sum over its points of the rate at which they leave the cluster that runs into it; inner: what the clusters that this one splits into are
    worth, 0 where it doesn't; lost: whether any point leaves it without a split.
    """
    r = rate(x.height)
    mass = x.points * r
    if x.parts == 1:
        return mass + x.mass, x.inner, x.points > 0 or x.lost
    return (mass + x.part_points * r, x.worth, x.points > 0) if x.parts else (mass, 0.0, x.points > 0)


def merged(a: Part, b: Part, d: float) -> Part:
    """Two parts joined by an edge of length d, which is none shorter than those before."""
    out = Part(min(a.part, b.part), a.size + b.size, d, 0, 0, 0, 0.0, 0.0, 0.0, False)
    for x in (a, b):
        if x.height < 0:
            out.points += 1
        elif x.height == d:
            out.points += x.points
            if x.parts == 1:
                out.mass, out.inner, out.lost = x.mass, x.inner, x.lost
            out.parts, out.part_points, out.worth = out.parts + x.parts, out.part_points + x.part_points, out.worth + x.worth
        else:
            mass, inner, lost = closed(x)
            out.mass, out.inner, out.lost = mass, inner, lost
            out.parts, out.part_points = out.parts + 1, out.part_points + x.size
            # as a cluster born here it is worth its own stability or that of the clusters within
            out.worth += max(mass - x.size * rate(d), inner)
    return out


def _contract(parts: list[Part], edges: Iterable[tuple[int, int, float]]) -> tuple[list[Part], list[int]]:
    """Parts after merging along edges in rising order, and for each given part the number of the one that it ended in."""
    number = {p.part: k for k, p in enumerate(parts)}
    union, now = Union(len(parts)), list(parts)
    for i, j, d in edges:
        a, b = union.find(number[i]), union.find(number[j])
        both = merged(now[a], now[b], d)
        union.join(a, b)
        now[min(a, b)] = both
    roots = [union.find(k) for k in range(len(parts))]
    return [now[k] for k in sorted(set(roots))], [now[r].part for r in roots]


def _grouped(parts: DataFrame, edges: DataFrame, group) -> tuple[DataFrame, DataFrame]:
    """(members, parts) after contracting each group of edges in a task; ``group`` gives the key of parts and edges from their first position."""
    key_parts, key_edges = group
    empty = {f: F.lit(None).cast(t) for f, t in (x.split() for x in (PART + ", i long, j long, d double").split(", "))}
    sides = parts.join(key_parts, "part").select("g", F.lit(0).alias("side"), *FIELDS, *[empty[c].alias(c) for c in "ijd"])
    sides = sides.unionByName(edges.join(key_edges, "i").select("g", F.lit(1).alias("side"), *[empty[c].alias(c) for c in FIELDS], "i", "j", "d"))
    dealt = sides.repartition("g").sortWithinPartitions("g", "side", "d", "i", "j")

    def run(batches):
        key, held, links = None, [], []
        for b in batches:
            for g, side, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if g != key:
                    if held:
                        yield done(held, links)
                    key, held, links = g, [], []
                if side == 0:
                    held.append(Part(*row[: len(FIELDS)]))
                else:
                    links.append(row[len(FIELDS) :])
        if held:
            yield done(held, links)

    def done(held, links):
        after, of = _contract(held, links)
        by = {p.part: p for p in after}
        rows = [(p.part, c, *(by[c].row() if p.part == c else [None] * len(FIELDS))) for p, c in zip(held, of, strict=True)]
        kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
        names = ["v", "c", *(f"n_{f}" for f in FIELDS)]
        types = [pa.int64(), pa.int64(), *(kinds[x.split()[1]] for x in PART.split(", "))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    out = storage.stored(dealt.mapInArrow(run, "v long, c long, " + ", ".join(f"n_{x}" for x in PART.split(", "))), "contracted")
    rest = parts.join(key_parts, "part", "left_anti")
    new = out.where("n_part is not null").select(*[F.col(f"n_{f}").alias(f) for f in FIELDS])
    return out.select("v", "c"), new.unionByName(rest.select(*FIELDS))


def contracted(parts: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, parts): parts (PART) merged along the edges of a forest between them, and (v, c), where each part that edges touch ended.

    Edges of at most LOCAL_EDGES are one group.  More are grouped by what they connect; while a group has too many, the shorter half of all
    edges is contracted first and the other half, with the parts found, after it.
    """
    spark = edges.sparkSession
    n = edges.count()
    if n <= LOCAL_EDGES:
        one = lambda c: edges.select(F.col("i").alias(c)).unionByName(edges.select(F.col("j").alias(c))).distinct().withColumn("g", F.lit(0).cast("long"))
        return _grouped(parts, edges, (one("part"), one("i")))
    label = components(edges)
    if label.join(edges, label.v == edges.i).groupBy("c").count().agg(F.max("count")).first()[0] <= LOCAL_EDGES:
        return _grouped(parts, edges, (label.select(F.col("v").alias("part"), F.col("c").alias("g")), label.select(F.col("v").alias("i"), F.col("c").alias("g"))))
    middle = edges.approxQuantile("d", [0.5], 0.01)[0]
    low, high = edges.where(F.col("d") < middle), edges.where(F.col("d") >= middle)
    if not low.limit(1).count():
        low, high = edges.where(F.col("d") <= middle), edges.where(F.col("d") > middle)
    if not high.limit(1).count():  # all of one length, in which order doesn't matter
        low, high = (edges.where(F.pmod(F.xxhash64("i", "j"), F.lit(2)) == s) for s in (0, 1))
    first, between = contracted(parts, low)
    second, after = contracted(storage.stored(between, "parts"), storage.stored(relabelled(high, first), "edges"))
    later = second.select(F.col("v").alias("c"), F.col("c").alias("top"))
    through = first.join(later, "c", "left").select("v", F.coalesce("top", "c").alias("c"))
    return storage.stored(through.unionByName(second.join(first.select("v"), "v", "left_anti")), "members"), after


def relabelled(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges between the parts that their ends are members of; ends that are none stay."""
    at = lambda c: members.select(F.col("v").alias(c), F.col("c").alias(f"{c}_part"))
    return edges.join(at("i"), "i", "left").join(at("j"), "j", "left").select(F.coalesce("i_part", "i").alias("i"), F.coalesce("j_part", "j").alias("j"), "d")


class _Node:
    """A merge at one height: single points (as numbers of parts), merged nodes, and parts from below epsilon, all as children."""

    __slots__ = ("height", "size", "points", "nodes", "part")

    def __init__(self, height, size, points, nodes, part=None):
        self.height, self.size, self.points, self.nodes, self.part = height, size, points, nodes, part


def select(parts: list[Part], edges: list[tuple[int, int, float]], epsilon: float) -> dict[int, int]:
    """Cluster of each part (by its smallest position), -1 for noise, from parts and the edges of a tree between them, none shorter than epsilon.

    Clusters of at least two points are split down the tree; those of the largest total stability are taken (the root may be one), and any
    born below ``epsilon`` gives way to its first ancestor born above it.  Clusters are numbered by their smallest position.
    """
    if len(parts) == 1 and parts[0].height < 0:
        return {parts[0].part: -1}
    # a part of two points at one place may be merged as high as its neighbours, all others below epsilon
    top = {k: _Node(p.height, p.size, [], [], p) if p.height >= 0 else None for k, p in enumerate(parts)}
    number = {p.part: k for k, p in enumerate(parts)}
    union = Union(len(parts))
    for i, j, d in sorted(edges, key=lambda e: e[2]):
        a, b = union.find(number[i]), union.find(number[j])
        new = _Node(d, 0, [], [])
        for k in (a, b):
            x = top[k]
            if x is None:
                new.points.append(parts[k].part)
                new.size += 1
            elif x.height == d and x.part is None:
                if len(x.points) + len(x.nodes) > len(new.points) + len(new.nodes):
                    x, new = new, x
                new.points += x.points
                new.nodes += x.nodes
                new.size += x.size
            elif x.height == d:  # two points at one place, merged at this very height
                new.points += [x.part.part] * x.size
                new.size += x.size
            else:
                new.nodes.append(x)
                new.size += x.size
        union.join(a, b)
        top[min(a, b)] = new
    birth, parent, mass, size, inner, kids, lost, members = [0.0], [-1], [0.0], [0], [0.0], [[]], [0.0], [[]]
    todo = [(top[union.find(k)], 0) for k in {union.find(k) for k in range(len(parts))}]
    while todo:
        x, c = todo.pop()
        r = rate(x.height)
        if c == 0 and not size[0]:
            size[0] = x.size
        if x.part is not None:
            m, below, gone = closed(x.part)
            mass[c], inner[c] = mass[c] + m, inner[c] + below
            # all its points stay longer than any above, even if they leave in clusters of their own
            lost[c] = max(lost[c], r if gone else 0.0)
            members[c].append((x.part.part, r))
            continue
        mass[c] += r * len(x.points)
        if x.points:
            lost[c] = max(lost[c], r)
            members[c] += [(p, r) for p in x.points]
        if len(x.nodes) == 1:
            todo.append((x.nodes[0], c))
        for y in x.nodes if len(x.nodes) > 1 else []:
            mass[c] += r * y.size
            for table, v in zip((birth, parent, mass, size, inner, kids, lost, members), (r, c, 0.0, y.size, 0.0, [], 0.0, []), strict=True):
                table.append(v)
            kids[c].append(len(birth) - 1)
            todo.append((y, len(birth) - 1))
    n = len(birth)
    stable = [mass[c] - size[c] * birth[c] for c in range(n)]
    taken, best = [True] * n, stable[:]
    for c in range(n - 1, -1, -1):
        below = sum(best[k] for k in kids[c]) + inner[c]
        if (kids[c] or inner[c] > 0) and below > stable[c]:
            # clusters within a part are born below epsilon, so they give way to this one
            taken[c], best[c] = inner[c] > 0 and not kids[c], below
    final, todo = set(), [0]
    while todo:
        c = todo.pop()
        if not taken[c]:
            todo += kids[c]
            continue
        while c > 0 and birth[c] > 1 / epsilon:
            c = parent[c]
        final.add(c)
    for c in list(final):
        a = parent[c]
        while a >= 0:
            if a in final:
                final.discard(c)
            a = parent[a]
    # a lone root keeps only points that stayed until epsilon or until its densest part began to split
    stay = min(1 / epsilon, lost[0]) if final == {0} else 0.0
    found = {}
    for c in final:
        todo, own = [c], []
        while todo:
            x = todo.pop()
            own += [p for p, r in members[x] if r >= stay]
            todo += kids[x]
        if own:
            found[min(own)] = own
    out = {p.part: -1 for p in parts}
    for label, first in enumerate(sorted(found)):
        out.update(dict.fromkeys(found[first], label))
    return out


def clusters(parts: DataFrame, tree: DataFrame, epsilon: float) -> DataFrame:
    """(part, cluster) of parts (PART, positions to begin with), -1 for noise, by the edges (i, j, d) of a spanning tree between them; stored."""
    members, left = contracted(parts, storage.stored(tree.where(F.col("d") < epsilon), "short"))
    long = relabelled(tree.where(F.col("d") >= epsilon), members)
    nulls = lambda names: [F.lit(None).cast(dict(x.split() for x in (PART + ", " + EDGES).split(", "))[c]).alias(c) for c in names]
    sides = left.select(*FIELDS, *nulls("ijd")).unionByName(long.select(*nulls(FIELDS), "i", "j", "d"))

    def run(batches):
        held, links = [], []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[0] is None:
                    links.append(row[len(FIELDS) :])
                else:
                    held.append(Part(*row[: len(FIELDS)]))
        if held:
            found = select(held, links, epsilon)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int32())], names=["c", "cluster"])

    # parts are at least epsilon apart, so as many as fit the scaled plane; see the module's head
    chosen = storage.stored(sides.repartition(1).mapInArrow(run, "c long, cluster int"), "chosen")
    ended = parts.select("part").join(members.withColumnRenamed("v", "part"), "part", "left").select("part", F.coalesce("c", "part").alias("c"))
    return storage.stored(ended.join(chosen, "c").select("part", "cluster"), "clusters")
