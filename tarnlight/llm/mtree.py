"""Exact top-k search by inner product: best-first search in M-trees.

Vectors are dealt to the nearest of a bounded number of pivots, and such regions into shards of bounded size.  Each shard is an M-tree:
pages of routing nodes with a pivot, covering radius and distance to the parent's pivot, and pages of entries with theirs, stored
as a table.  For a query q of length |q|, the inner product with x is (|q|^2 + |x|^2 - d(q, x)^2) / 2, so lower bounds of distances by the triangle
inequality give upper bounds of scores: first from stored distances alone, then, where that isn't enough, from the distance to the node's
pivot.  A query first searches the shard of its own region, and then those shards whose root still allows a score above its k-th best.

Components are whole numbers of any size: sums that fit are taken in double precision, where they are exact, others in Python's integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Vectors in a shard on average, entries of a page, children of a routing node, and regions (pivots that are broadcast) at most.
SHARD, PAGE, FANOUT, REGIONS = 16_384, 128, 16, 1_024
#: Queries searched at once in a task, those that are held against all roots in a task, and roots taken at once.
QUERY_BLOCK, QUERY_PANEL, ROOT_BLOCK = 512, 4_096, 4_096
#: Sums of products up to here are exact in double precision; upper bounds are raised by this part against rounding.
EXACT, SLACK = 2.0**53, 1e-6
LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, exact; beyond a long they become its nearest value."""
    if not a.size or not b.size or float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in r] for r in x], dtype=object).reshape(x.shape)
    return np.clip(whole(a) @ whole(b).T, LONG_MIN, LONG_MAX).astype(np.int64)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, rounded."""
    with np.errstate(over="ignore", invalid="ignore"):
        d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T
        return np.sqrt(np.maximum(0, np.nan_to_num(d, nan=np.inf)))


def scaled(rows: DataFrame, by: int = 1_024) -> DataFrame:
    """(vec_id, v): floor(by * component) of rows (vec_id, embedding), as doubles.

    Rows without vec_id, with a null vector or a component that is null, not finite or not finite when scaled are left out.  Of rows that
    repeat a vec_id with different vectors, the smallest vector counts.  Shorter vectors are compared as if filled up with zeros.
    """
    wide = F.transform("embedding", lambda x: x.cast("double") * by)
    whole = F.transform(wide, lambda x: F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x))  # beyond 2^53 every double is whole
    fine = F.forall(wide, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return rows.where(F.col("vec_id").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def _packed(vectors: DataFrame, dim: int) -> DataFrame:
    """(vec_id, v): the vectors as bytes of ``dim`` doubles."""

    def run(batches):
        for b in batches:
            out = []
            for (v,) in common.rows(b, "v"):
                x = np.zeros(dim)
                x[: len(v)] = v
                out.append((x + 0.0).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["vec_id", "v"])

    return vectors.mapInArrow(run, "vec_id long, v binary")


def distinct(vectors: DataFrame, k: int) -> DataFrame:
    """(v, ids): each vector once with its k + 1 smallest ids; a query needs no more of them beside its own."""
    rank = F.row_number().over(W.partitionBy("v").orderBy("vec_id"))
    return vectors.withColumn("r", rank).where(F.col("r") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


class Node:
    """A page while a tree is built: rows of the shard below it, its pivot, and children, or none for a page of entries."""

    def __init__(self, rows: np.ndarray, pivot: np.ndarray, to_parent: float):
        self.rows, self.pivot, self.to_parent, self.children = rows, pivot, to_parent, []
        self.radius = self.longest = 0.0


def build(x: np.ndarray, pivot: np.ndarray) -> list[Node]:
    """The nodes of a shard's tree over distinct vectors, root first, children after their parent.

    A node of more than PAGE rows is split among FANOUT of its rows, each the farthest from those before it; where nearly all are nearest to
    one, rows are cut by their distance from it instead, so depth stays logarithmic.
    """
    root = Node(np.arange(len(x)), pivot, 0.0)
    nodes = [root]
    for node in nodes:
        own = x[node.rows]
        d = _distances(node.pivot[None], own)[0]
        node.radius = float(d.max(initial=0.0))
        node.longest = float(np.sqrt((own * own).sum(1)).max(initial=0.0))
        if len(own) <= PAGE:
            continue
        chosen = [int(np.argmax(d))]
        near = _distances(own[chosen], own)
        while len(chosen) < FANOUT and near.min(0).max() > 0:
            chosen.append(int(np.argmax(near.min(0))))
            near = np.concatenate([near, _distances(own[chosen[-1:]], own)])
        to = near.argmin(0)
        if np.bincount(to).max() > 0.9 * len(own):
            order = np.argsort(near[np.bincount(to).argmax()], kind="stable")
            parts = np.array_split(order, FANOUT)
        else:
            parts = [np.flatnonzero(to == c) for c in range(len(chosen))]
        for part in parts:
            if len(part):
                # the row nearest to the middle is the pivot
                middle = part[int(np.argmin(_distances(own[part].mean(0)[None], own[part])[0]))]
                child = Node(node.rows[part], own[middle], float(_distances(node.pivot[None], own[middle][None])[0, 0]))
                node.children.append(child)
                nodes.append(child)
    return nodes


PAGES = pa.schema([("shard", pa.int64()), ("node", pa.int32()), ("parent", pa.int32()), ("pivot", pa.binary()), ("radius", pa.float64()), ("longest", pa.float64()), ("to_parent", pa.float64()), ("vectors", pa.binary()), ("to_pivot", pa.binary()), ("ids", pa.list_(pa.list_(pa.int64())))])
PAGES_DDL = "shard long, node int, parent int, pivot binary, radius double, longest double, to_parent double, vectors binary, to_pivot binary, ids array<array<long>>"


class Index:
    """pages: the stored table of all shards' nodes; pivots of the regions, shards of each region, and the vectors' length."""

    def __init__(self, pages: DataFrame, pivots: np.ndarray, shards: dict[int, int], dim: int):
        self.pages, self.pivots, self.shards, self.dim = pages, pivots, shards, dim

    def region_of(self, rows: DataFrame, column: str = "v") -> DataFrame:
        """``rows`` with the region whose pivot is nearest to the vector bytes."""
        pivots, dim = common.sent(rows.sparkSession, self.pivots), self.dim  # at most REGIONS vectors

        def run(batches):
            at = pivots()
            for b in batches:
                x = np.frombuffer(b"".join(b.column(b.schema.get_field_index(column)).to_pylist()), dtype=np.float64).reshape(b.num_rows, dim)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_distances(x, at).argmin(1) if b.num_rows else [], pa.int64())], names=[*b.schema.names, "region"])

        return rows.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", region long")


def index(vectors: DataFrame, k: int = 10, shard: int = SHARD) -> Index:
    """M-trees over ``scaled`` vectors, all of them; the pivots of the regions are a sample by hash of at most REGIONS vectors.

    A region of many rows is cut into shards by hash, so no shard grows with a crowded region.
    """
    spark = vectors.sparkSession
    dim = vectors.agg(F.max(F.size("v"))).first()[0] or 0
    rows = common.staged(distinct(_packed(vectors, dim), k), "distinct")
    n = rows.count()
    regions = max(1, min(REGIONS, n // shard))
    held = [r["v"] for r in rows.orderBy(F.xxhash64("v"), "v").limit(regions).select("v").collect()]
    pivots = np.frombuffer(b"".join(held), dtype=np.float64).reshape(len(held), dim) if held else np.zeros((1, dim))
    found = Index(None, pivots, {}, dim)
    placed = common.staged(found.region_of(rows), "placed")
    found.shards = {r["region"]: -(-r["count"] // shard) for r in placed.groupBy("region").count().collect()}  # at most REGIONS rows
    first, start = {}, 0
    for region in sorted(found.shards):
        first[region] = start
        start += found.shards[region]
    send = common.sent(spark, (pivots, first))
    cuts = F.create_map(*[F.lit(x) for r, c in found.shards.items() for x in (r, c)])[F.col("region")] if found.shards else F.lit(1)
    base = F.create_map(*[F.lit(x) for r, c in first.items() for x in (r, c)])[F.col("region")] if first else F.lit(0)
    dealt = placed.withColumn("shard", (base + F.pmod(F.xxhash64("v"), cuts)).cast("long")).select("shard", "region", "v", "ids").repartition(max(1, start), "shard").sortWithinPartitions("shard", "v")

    def run(batches):
        pivots, _ = send()
        number, region, held, ids = None, None, [], []
        for b in batches:
            for s, r, v, i in common.rows(b, "shard", "region", "v", "ids"):
                if s != number and held:
                    yield from tree(number, pivots[region], held, ids)
                    held, ids = [], []
                number, region = s, r
                held.append(v)
                ids.append(i)
        if held:
            yield from tree(number, pivots[region], held, ids)

    def tree(number, pivot, held, ids):
        x = np.frombuffer(b"".join(held), dtype=np.float64).reshape(len(held), dim)
        nodes = build(x, pivot)
        place = {id(n): k for k, n in enumerate(nodes)}
        parent = {place[id(c)]: k for k, n in enumerate(nodes) for c in n.children}
        for lo in range(0, len(nodes), 64):
            out = []
            for k, n in enumerate(nodes[lo : lo + 64], lo):
                entries = n.rows if not n.children else n.rows[:0]
                out.append((number, k, parent.get(k, -1), n.pivot.tobytes(), n.radius, n.longest, n.to_parent, x[entries].tobytes(), _distances(n.pivot[None], x[entries])[0].tobytes(), [ids[e] for e in entries]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), PAGES, strict=True)], schema=PAGES)

    found.pages = common.staged(dealt.mapInArrow(run, PAGES_DDL), "pages")
    return found


class Tree:
    """A shard's pages in memory, for search."""

    def __init__(self, pages: list[tuple], dim: int):
        pages.sort(key=lambda p: p[0])
        vec = lambda x: np.frombuffer(x, dtype=np.float64).reshape(-1, dim) if dim else np.zeros((0, 0))
        self.pivot = np.concatenate([vec(p[2]) if dim else np.zeros((1, 0)) for p in pages])
        self.radius, self.longest, self.to_parent = (np.array([p[c] for p in pages]) for c in (3, 4, 5))
        self.ids = [p[8] for p in pages]
        self.vectors = [vec(p[6]) if dim else np.zeros((len(p[8]), 0)) for p in pages]
        self.to_pivot = [np.frombuffer(p[7], dtype=np.float64) for p in pages]
        self.length = [np.sqrt((v * v).sum(1)) for v in self.vectors]
        parents = np.array([p[1] for p in pages])
        self.children = [np.flatnonzero(parents == k) for k in range(len(pages))]


def _above(q_length: np.ndarray, length, apart) -> np.ndarray:
    """Upper bounds of inner products with vectors of at most ``length`` and at a distance of at least ``apart``."""
    with np.errstate(over="ignore", invalid="ignore"):
        apart = np.where(np.isfinite(apart), apart, 0)  # a distance too large for a double tells nothing
        size = q_length * q_length + length * length
        bound = np.minimum((size - apart * apart) / 2, q_length * length)
        return np.nan_to_num(bound + SLACK * size + 1, nan=np.inf)


def search(tree: Tree, queries: np.ndarray, own: list[int], k: int, worst: np.ndarray) -> list[list[tuple[int, int]]]:
    """The k best (-score, id) of each query in the shard, without its own id, of those that aren't below ``worst``.

    Each query visits its open nodes best bound first; those that visit one page at a time share one matrix product.  ``worst``,
    the k-th best scores so far (-inf where there are fewer), is raised as the search goes on.
    """
    n, pages = len(queries), len(tree.radius)
    found: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    length = np.sqrt((queries * queries).sum(1))
    away = np.full((n, pages), np.inf)  # distances to pivots of visited nodes
    bound = np.full((n, pages), -np.inf)  # of open nodes
    bound[:, 0] = np.inf
    going = np.arange(n)
    while len(going):
        at = bound[going].argmax(1)
        best = bound[going, at]
        more = best >= np.maximum(worst[going], np.nextafter(-np.inf, 0))
        going, at = going[more], at[more]
        for page in np.unique(at):
            q = going[at == page]
            bound[q, page] = -np.inf
            d = away[q, page] = _distances(queries[q], tree.pivot[page : page + 1])[:, 0]
            # with the distance known, the covering radius may already rule the node out
            open_ = _above(length[q], tree.longest[page], np.maximum(0, d - tree.radius[page]) * (1 - SLACK)) >= worst[q]
            q, d = q[open_], d[open_]
            if not len(q):
                continue
            kids = tree.children[page]
            if len(kids):
                # stored distances alone: |d(q, parent) - d(parent, child)| less the child's radius
                apart = np.maximum(0, np.abs(d[:, None] - tree.to_parent[kids]) - tree.radius[kids]) * (1 - SLACK)
                bound[q[:, None], kids] = _above(length[q][:, None], tree.longest[kids], apart)
                continue
            if not len(tree.ids[page]):
                continue
            # entries: by the stored distances, those that no query needs aren't computed
            limit = _above(length[q][:, None], tree.length[page], np.abs(d[:, None] - tree.to_pivot[page]) * (1 - SLACK)) >= worst[q][:, None]
            rows = np.flatnonzero(limit.any(0))
            score = products(queries[q], tree.vectors[page][rows])
            for a, s in zip(q.tolist(), score, strict=True):
                good = np.flatnonzero(s >= worst[a])
                if len(good) > 2 * k:  # at most k rows matter beside ties at the k-th
                    cut = np.partition(s[good], len(good) - k - 1)[len(good) - k - 1]
                    good = good[s[good] >= cut]
                new = [(-int(s[g]), i) for g in good.tolist() for i in tree.ids[page][rows[g]] if i != own[a]]
                if new:
                    found[a] = sorted(found[a] + new)[:k]
                    if len(found[a]) == k:
                        worst[a] = max(worst[a], -found[a][-1][0])
    return found


FOUND = "query_id long, vec_id long, score long"


def _searched(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """FOUND of asked rows (shard, query_id, q, worst): the k best of each in its shard that may be among the k best of all."""
    tagged = asked.select("shard", F.lit(1).alias("side"), "query_id", "q", "worst", *[F.lit(None).cast(f.dataType).alias(f.name) for f in index.pages.schema if f.name != "shard"])
    pages = index.pages.select("shard", F.lit(0).alias("side"), F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("binary").alias("q"), F.lit(None).cast("double").alias("worst"), *[c for c in index.pages.columns if c != "shard"])
    dealt = pages.unionByName(tagged).repartition(max(1, sum(index.shards.values())), "shard").sortWithinPartitions("shard", "side")
    dim = index.dim

    def answers(tree, block):
        queries = np.frombuffer(b"".join(q for _, q, _ in block), dtype=np.float64).reshape(len(block), dim)
        got = search(tree, queries, [i for i, _, _ in block], k, np.array([w for _, _, w in block]))
        out = [(block[a][0], i, -s) for a, rows in enumerate(got) for s, i in rows]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 3)], names=["query_id", "vec_id", "score"])

    def run(batches):
        number, pages, tree, block = None, [], None, []
        for b in batches:
            for s, side, qid, q, worst, *page in common.rows(b, "shard", "side", "query_id", "q", "worst", "node", "parent", "pivot", "radius", "longest", "to_parent", "vectors", "to_pivot", "ids"):
                if s != number:
                    if block:
                        yield answers(tree, block)
                    number, pages, tree, block = s, [], None, []
                if side == 0:
                    pages.append(tuple(page))
                    continue
                tree = tree or Tree(pages, dim)
                block.append((qid, q, worst))
                if len(block) == QUERY_BLOCK:
                    yield answers(tree, block)
                    block = []
        if block:
            yield answers(tree, block)

    return dealt.mapInArrow(run, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each of ``queries`` (``scaled``) with other ids, ties to the smaller.

    A row goes to a shard only if the shard's root allows a score that isn't below the k-th best of the query's own shard.
    """
    asked = common.staged(index.region_of(_packed(queries, index.dim).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "q"), "asked")
    roots = common.staged(index.pages.where("parent < 0").select("shard", "pivot", "radius", "longest"), "roots")
    minus = float("-inf")
    # the shard of its region that a query is dealt to, or any where its region has none
    total = max(1, sum(index.shards.values()))
    base, start = [], 0
    for r in sorted(index.shards):
        base += [F.lit(r), F.array(F.lit(start), F.lit(index.shards[r]))]
        start += index.shards[r]
    span = F.coalesce(F.create_map(*base)[F.col("region")], F.array(F.lit(0), F.lit(total))) if base else F.array(F.lit(0), F.lit(1))
    home = asked.withColumn("home", (span[0] + F.pmod(F.xxhash64("q"), span[1])).cast("long"))
    first = common.staged(_searched(index, home.select(F.col("home").alias("shard"), "query_id", "q", F.lit(minus).alias("worst")), k), "first")
    worst = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).otherwise(F.lit(minus)).alias("worst"))  # k rows each
    known = home.join(worst, "query_id", "left").select("query_id", "q", "home", F.coalesce("worst", F.lit(minus)).alias("worst"))
    second = _searched(index, _other_shards(known, roots, index.dim), k)
    return _best(first.unionByName(second), k).select("query_id", "rank", "vec_id", "score")


def _other_shards(known: DataFrame, roots: DataFrame, dim: int) -> DataFrame:
    """(shard, query_id, q, worst): the shards that queries (query_id, q, home, worst) must still search.

    A task holds the queries of a panel, past which all roots stream.
    """
    panels = max(1, -(-known.count() // QUERY_PANEL))
    sides = [
        known.select(F.pmod(F.xxhash64("query_id"), F.lit(panels)).alias("panel"), F.lit(0).alias("side"), F.col("query_id").alias("id"), F.col("q").alias("v"), "home", "worst", F.lit(0.0).alias("longest")),
        roots.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(panels - 1).cast("long"))).alias("panel"), F.lit(1).alias("side"), F.col("shard").alias("id"), F.col("pivot").alias("v"), F.lit(0).cast("long").alias("home"), F.col("radius").alias("worst"), "longest"),
    ]
    dealt = sides[0].unionByName(sides[1]).repartition(panels, "panel").sortWithinPartitions("panel", "side", "id")

    def run(batches):
        panel, held = None, []
        for b in batches:
            number, side = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            edges = np.flatnonzero((np.diff(number) != 0) | (np.diff(side) != 0)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(number)], strict=True):
                if lo == hi:
                    continue
                if number[lo] != panel:
                    panel, held = number[lo], []
                cols = [b.column(c).slice(lo, hi - lo) for c in range(2, 7)]
                ids, home, worst, longest = (cols[c].to_numpy(zero_copy_only=False) for c in (0, 2, 3, 4))
                v = cols[1].to_pylist()
                if side[lo] == 0:
                    held.append((ids, v, home, worst))
                elif held:
                    yield from asked(held, ids, v, worst, longest)

    def asked(held, shards, pivots, radii, longest):
        vec = lambda v: np.frombuffer(b"".join(v), dtype=np.float64).reshape(len(v), dim)
        pivots = vec(pivots)
        for ids, v, home, worst in held:
            q = vec(v)
            for lo in range(0, len(shards), ROOT_BLOCK):
                s = slice(lo, lo + ROOT_BLOCK)
                apart = np.maximum(0, _distances(q, pivots[s]) - radii[s]) * (1 - SLACK)
                x, y = np.nonzero((_above(np.sqrt((q * q).sum(1))[:, None], longest[s], apart) >= worst[:, None]) & (home[:, None] != shards[s]))
                for at in range(0, len(x), 4096):
                    i = x[at : at + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array(shards[s][y[at : at + 4096]]), pa.array(ids[i]), pa.array([v[k] for k in i], pa.binary()), pa.array(worst[i])], names=["shard", "query_id", "q", "worst"])

    return dealt.mapInArrow(run, "shard long, query_id long, q binary, worst double")


def op11_mtree(spark, sf_dir: str) -> DataFrame:
    """The 10 highest integer inner products of every row whose vec_id is divisible by 100, over all rows of embeddings."""
    vectors = common.staged(scaled(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "scaled")
    return nearest(index(vectors), vectors.where("vec_id % 100 = 0"), 10)


OP11_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
      from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0)
select query_id, rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s) where rank <= 10
"""
