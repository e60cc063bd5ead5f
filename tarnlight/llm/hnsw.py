"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Equal vectors are one node.  Nodes are dealt into shards of bounded size; each shard's graph is built by inserting its
nodes in order, each linked to diverse nearest predecessors (their distances come from blocked matrix products), and
stored as flat neighbour arrays.  Queries run against every shard in blocks, and the shards' results are merged.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Nodes in a shard on average, links a node keeps (twice as many on the ground level), candidates for them.
SHARD, LINKS, CANDIDATES = 4_096, 16, 64
#: Width of the search beam, and beam nodes that one step expands.
BEAM, STEP = 160, 4
#: Queries searched at once in a task.
QUERY_BLOCK = 512


def usable(vec: np.ndarray | None) -> bool:
    return vec is not None and len(vec) > 0 and bool(np.isfinite(vec).all()) and bool(vec.any())


def _diverse(near: np.ndarray, dist: np.ndarray, vectors: np.ndarray, most: int) -> np.ndarray:
    """Of candidates sorted by distance, those closer to the node than to any chosen one; filled up by the nearest."""
    v = vectors[near]
    between = np.maximum(0, (v * v).sum(1)[:, None] + (v * v).sum(1)[None] - 2 * v @ v.T)
    chosen: list[int] = []
    for i in range(len(near)):
        if len(chosen) == most:
            break
        if not chosen or (between[i, chosen] > dist[i]).all():
            chosen.append(i)
    if len(chosen) < most:
        rest = [i for i in range(len(near)) if i not in set(chosen)]
        chosen += rest[: most - len(chosen)]
    return near[chosen]


def _layer(vectors: np.ndarray, nodes: np.ndarray, links: int, most: int) -> list[np.ndarray]:
    """Neighbours of each of ``nodes`` (positions into nodes) after inserting them in order."""
    x = vectors[nodes]
    norm = (x * x).sum(1)
    out: list[list[int]] = [[] for _ in range(len(nodes))]
    for lo in range(0, len(nodes), 512):
        hi = min(len(nodes), lo + 512)
        d = np.maximum(0, norm[lo:hi, None] + norm[None, :hi] - 2 * x[lo:hi] @ x[:hi].T)
        for r in range(lo, hi):
            if not r:
                continue
            row = d[r - lo, :r]
            k = min(CANDIDATES, r)
            near = np.argpartition(row, k - 1)[:k] if k < r else np.arange(r)
            near = near[np.lexsort((near, row[near]))]
            got = _diverse(near, row[near], x, links)
            out[r].extend(got.tolist())
            for g in got.tolist():
                out[g].append(r)
    for r, mine in enumerate(out):
        if len(mine) > most:
            near = np.array(mine)
            dist = ((x[near] - x[r]) ** 2).sum(1)
            order = np.lexsort((near, dist))
            out[r] = _diverse(near[order], dist[order], x, most).tolist()
    return [np.array(m, dtype=np.int64) for m in out]


def _reach(neighbours: list[np.ndarray], vectors: np.ndarray, start: int) -> None:
    """Add links so that every node is reached from ``start``: the nearest reached node links to a lost one."""
    n = len(neighbours)
    seen = np.zeros(n, dtype=bool)

    def spread(front: list[int]) -> None:
        seen[front] = True
        while front:
            to = np.unique(np.concatenate([neighbours[i] for i in front]))
            to = to[~seen[to]] if len(to) else to
            seen[to] = True
            front = to.tolist()

    spread([start])
    while not seen.all():
        lost = int(np.flatnonzero(~seen)[0])
        have = np.flatnonzero(seen)
        best = have[int(((vectors[have] - vectors[lost]) ** 2).sum(1).argmin())]
        neighbours[best] = np.append(neighbours[best], lost)
        spread([lost])


def build(vectors: np.ndarray, seed: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels from the ground up, each (nodes, begin, neighbours): node k's neighbours are neighbours[begin[k]:begin[k + 1]]."""
    n = len(vectors)
    height = np.floor(-np.log(np.random.default_rng(seed).random(n)) / math.log(LINKS)).astype(int)
    height[0] = height.max()  # the first node, inserted before all others, is the entry
    levels = []
    for level in range(height.max() + 1):
        nodes = np.flatnonzero(height >= level)
        near = _layer(vectors, nodes, LINKS, 2 * LINKS if level == 0 else LINKS)
        if len(nodes) > 1:
            _reach(near, vectors[nodes], 0)
        begin = np.concatenate([[0], np.cumsum([len(m) for m in near])])
        levels.append((nodes, begin, nodes[np.concatenate([*near, np.zeros(0, dtype=np.int64)]).astype(np.int64)] if len(nodes) > 1 else np.zeros(0, dtype=np.int64)))
    return levels


def search(vectors: np.ndarray, levels, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, squared distances) of the nearest found for every query, both queries x beam, -1 and inf where fewer."""
    q, n = len(queries), len(vectors)
    norm, qn = (vectors * vectors).sum(1), (queries * queries).sum(1)

    def distance(rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        return np.maximum(0, norm[nodes] + qn[rows, None] - 2 * np.einsum("ij,ikj->ik", queries[rows], vectors[nodes]))

    def padded(begin, flat, at, width):
        k = np.arange(width)
        size = begin[at + 1] - begin[at]
        ok = k < size[..., None]
        return np.where(ok, flat[np.minimum(begin[at][..., None] + k, max(0, len(flat) - 1))], -1), ok

    at = np.zeros(q, dtype=np.int64)
    d = distance(np.arange(q), at[:, None])[:, 0]
    for nodes, begin, flat in levels[:0:-1]:
        place = np.full(n, -1)
        place[nodes] = np.arange(len(nodes))
        width = int(np.diff(begin).max()) if len(nodes) else 0
        moving = np.arange(q)
        while len(moving) and width:
            to, ok = padded(begin, flat, place[at[moving]], width)
            e = np.where(ok, distance(moving, np.maximum(to, 0)), np.inf)
            best = e.argmin(1)
            low = e[np.arange(len(moving)), best]
            better = low < d[moving]
            at[moving[better]], d[moving[better]] = to[np.arange(len(moving)), best][better], low[better]
            moving = moving[better]
    _, begin, flat = levels[0]
    width = int(np.diff(begin).max()) if n else 0
    held, dist, done = np.full((q, beam), -1), np.full((q, beam), np.inf), np.ones((q, beam), dtype=bool)
    held[:, 0], dist[:, 0], done[:, 0] = at, d, False
    seen = np.zeros((q, n), dtype=bool)
    seen[np.arange(q), at] = True
    active = np.arange(q)
    while len(active) and width:
        # the nearest nodes of each beam that aren't expanded yet
        key = np.where(done[active], np.inf, dist[active])
        pick = np.argpartition(key, STEP, axis=1)[:, :STEP] if beam > STEP else np.tile(np.arange(beam), (len(active), 1))
        chosen = np.take_along_axis(key, pick, 1) < np.inf
        more = chosen.any(1)
        active, pick, chosen = active[more], pick[more], chosen[more]
        if not len(active):
            break
        nodes = np.where(chosen, np.take_along_axis(held[active], pick, 1), -1)
        done[active[:, None], pick] |= chosen
        to, ok = padded(begin, flat, np.maximum(nodes, 0), width)
        ok &= (nodes >= 0)[..., None]
        to, ok = to.reshape(len(active), -1), ok.reshape(len(active), -1)
        ok &= ~seen[active[:, None], np.maximum(to, 0)]
        rows, cols = np.nonzero(ok)
        fresh = to[rows, cols]
        key = np.unique(rows * n + fresh)  # a node may be a neighbour of two that were expanded
        rows, fresh = key // n, key % n
        seen[active[rows], fresh] = True
        e = np.maximum(0, norm[fresh] + qn[active[rows]] - 2 * np.einsum("ij,ij->i", queries[active[rows]], vectors[fresh]))
        size = np.bincount(rows, minlength=len(active))
        wide = int(size.max()) if len(size) else 0
        slot = np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size)
        new, new_d = np.full((len(active), wide), -1), np.full((len(active), wide), np.inf)
        new[rows, slot], new_d[rows, slot] = fresh, e
        all_n, all_d = np.concatenate([held[active], new], 1), np.concatenate([dist[active], new_d], 1)
        all_done = np.concatenate([done[active], new < 0], 1)
        keep = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        held[active], dist[active], done[active] = (np.take_along_axis(a, keep, 1) for a in (all_n, all_d, all_done))
    return held, dist


INDEX = "shard long, dim int, first array<binary>, vectors binary, levels array<struct<nodes:binary,begin:binary,neighbours:binary>>"


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """(vec, ids): each usable vector once, as float64 bytes, with the k + 1 smallest of its ids.

    Ids are cut to k + 1 within tasks before the shuffle, so a vector that many rows share makes few rows: no other
    of its rows can be among any query's k nearest.
    """

    def local(batches):
        held: dict[bytes, list[int]] = {}
        for b in batches:
            for i, e in common.rows(b, "vec_id", "embedding"):
                v = None if e is None or any(c is None for c in e) else np.array(e, dtype=np.float64)
                if i is not None and usable(v):
                    ids = held.setdefault((v + 0.0).tobytes(), [])
                    ids.append(i)
                    if len(ids) > 4 * k + 8:
                        ids[:] = sorted(set(ids))[: k + 1]
            if len(held) > 50_000:
                yield _held(held, k)
                held = {}
        if held:
            yield _held(held, k)

    def _held(held, k):
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array([sorted(set(v))[: k + 1] for v in held.values()], pa.list_(pa.int64()))], names=["vec", "ids"])

    parts = rows.select("vec_id", "embedding").mapInArrow(local, "vec binary, ids array<long>")
    salted = parts.groupBy("vec", (F.element_at("ids", 1) % 16).alias("salt")).agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))
    return salted.groupBy("vec").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))


def index(vectors: DataFrame, shard: int = SHARD, name: str = "hnsw") -> DataFrame:
    """INDEX, one row a shard, as a table in the shared folder.  vectors: (vec, ids) of ``distinct_vectors``.

    Vectors of different lengths go to different shards.
    """
    vectors = common.staged(vectors, f"{name}-vectors")
    sizes = {r["dim"]: max(1, round(r["count"] / shard)) for r in vectors.groupBy((F.length("vec") / 8).cast("int").alias("dim")).count().collect()}  # a row for each length
    dim = (F.length("vec") / 8).cast("int")
    number = F.lit(1)
    for k, n in sizes.items():
        number = F.when(dim == k, F.lit(n)).otherwise(number)
    dealt = vectors.select(dim.alias("dim"), F.pmod(F.xxhash64("vec"), number).alias("shard"), "vec", "ids")

    def run(batches):
        held, key = [], None
        for b in batches:
            for d, s, vec, ids in common.rows(b, "dim", "shard", "vec", "ids"):
                if held and (d, s) != key:
                    yield _shard(key, held)
                    held = []
                key = (d, s)
                held.append((vec, ids))
        if held:
            yield _shard(key, held)

    parts = sum(sizes.values())
    graphs = dealt.repartition(max(1, parts), "dim", "shard").sortWithinPartitions("dim", "shard", "vec").mapInArrow(run, INDEX)
    return common.staged(graphs, name)


def _shard(key, held) -> pa.RecordBatch:
    # an order that isn't that of the bytes, so the first nodes spread over the space
    order = np.random.default_rng(len(held)).permutation(len(held))
    held = [held[i] for i in order]
    vectors = np.frombuffer(b"".join(v for v, _ in held), dtype=np.float64).reshape(len(held), -1)
    levels = [{"nodes": a.astype("<i4").tobytes(), "begin": b.astype("<i4").tobytes(), "neighbours": c.astype("<i4").tobytes()} for a, b, c in build(vectors, key[1])]
    ids = [np.array(i, dtype="<i8").tobytes() for _, i in held]
    level = pa.struct([(x, pa.binary()) for x in ("nodes", "begin", "neighbours")])
    return pa.RecordBatch.from_arrays([pa.array([key[1]], pa.int64()), pa.array([key[0]], pa.int32()), pa.array([ids], pa.list_(pa.binary())), pa.array([vectors.tobytes()], pa.binary()), pa.array([levels], pa.list_(level))], names=["shard", "dim", "first", "vectors", "levels"])


def nearest(graphs: DataFrame, queries: DataFrame, k: int = 10, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every query row (vec_id, embedding) but itself.

    Queries go to every shard of their vector length and are searched there in blocks of at most QUERY_BLOCK.  Rows that
    repeat a vec_id with other vectors are one row at the smallest of their distances.
    """
    shards = [(r["shard"], r["dim"]) for r in graphs.select("shard", "dim").collect()]  # two numbers a shard
    if not shards:
        return graphs.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    by_dim = {d: [s for s, x in shards if x == d] for d in {x for _, x in shards}}

    def usable_rows(batches):
        for b in batches:
            got = []
            for i, e in common.rows(b, "vec_id", "embedding"):
                v = None if e is None or any(c is None for c in e) else np.array(e, dtype=np.float64)
                if i is not None and usable(v):
                    got.append((i, len(v), (v + 0.0).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True) if got else [[], [], []], (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["query_id", "dim", "q"])

    asked = queries.select("vec_id", "embedding").mapInArrow(usable_rows, "query_id long, dim int, q binary").distinct()
    to = F.expr("cast(array() as array<bigint>)")
    for d, s in by_dim.items():
        to = F.when(F.col("dim") == d, F.sequence(F.lit(0).cast("long"), F.lit(len(s) - 1).cast("long"))).otherwise(to)
    sent = asked.select("query_id", "dim", "q", F.explode(to).alias("shard"))
    tagged = sent.select("dim", "shard", "query_id", "q", *[F.lit(None).cast(f.dataType).alias(f.name) for f in graphs.schema if f.name not in ("dim", "shard")])
    rows = graphs.select("dim", "shard", F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("binary").alias("q"), "first", "vectors", "levels").unionByName(tagged)
    dealt = rows.repartition(len(shards), "dim", "shard").sortWithinPartitions("dim", "shard", F.col("query_id").asc_nulls_first())

    def run(batches):
        graph, block = None, []
        for b in batches:
            for qid, q, first, vectors, levels in common.rows(b, "query_id", "q", "first", "vectors", "levels"):
                if qid is None:
                    if block:
                        yield _answers(graph, block, k, beam)
                        block = []
                    x = np.frombuffer(vectors, dtype=np.float64)
                    graph = (x.reshape(len(first), -1), [np.frombuffer(i, dtype="<i8") for i in first], [tuple(np.frombuffer(v[n], dtype="<i4").astype(np.int64) for n in ("nodes", "begin", "neighbours")) for v in levels])
                else:
                    block.append((qid, q))
                    if len(block) == QUERY_BLOCK:
                        yield _answers(graph, block, k, beam)
                        block = []
        if block:
            yield _answers(graph, block, k, beam)

    found = dealt.mapInArrow(run, "query_id long, vec_id long, score double")
    # at most k rows of each query and shard are merged in one shuffle, as sorted rows that can spill
    once = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _answers(graph, block, k: int, beam: int) -> pa.RecordBatch:
    vectors, ids, levels = graph
    queries = np.frombuffer(b"".join(q for _, q in block), dtype=np.float64).reshape(len(block), -1)
    held, dist = search(vectors, levels, queries, max(beam, 2 * k + 2))
    out = []
    for i, (qid, _) in enumerate(block):
        nodes = held[i][held[i] >= 0]
        exact = np.sqrt(((vectors[nodes] - queries[i]) ** 2).sum(1))
        least: dict[int, float] = {}
        for d, node in sorted(zip(exact.tolist(), nodes.tolist(), strict=True)):
            for v in ids[node].tolist():
                if v != qid:
                    least.setdefault(v, d)
        out += [(qid, v, d) for d, v in sorted((d, v) for v, d in least.items())[:k]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[], [], []], (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])


def op3_hnsw(spark, sf_dir: str) -> DataFrame:
    """The 10 nearest found of every row whose vec_id is divisible by 100, over all rows of embeddings."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(index(distinct_vectors(rows, 10)), rows.where("vec_id % 100 = 0"), 10)
