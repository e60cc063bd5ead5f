"""Near-duplicate documents by MinHash with tensored banding, verified exactly.

A document's set of word shingles gives GROUPS small collections of PER_GROUP minhashes; every pair of collections
is one table key, so GROUPS * (GROUPS - 1) / 2 tables of 2 * PER_GROUP minhashes need only GROUPS * PER_GROUP hashes.
Two sets of similarity 0.8 agree on a collection with probability 0.64 and miss all tables with 4e-5.

Equal sets are one class from the start.  Pairs that share a key with nobody else, and each class of a larger bucket
with a few others of its buckets, are compared first and the links found joined to components.  What is left, classes
that share a key but lie in different components, is compared in blocks within tasks.  A bitmap of each set bounds
the intersection from above, and pairs that pass this bound are compared on their full sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import hierarchy
from . import common

GROUPS, PER_GROUP = 13, 2
#: Link at 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Orders of a bucket's ids, each by the exclusive or with a number: a class is first compared with the ends of each.
ORDERS = (0, 0x5555555555555555)
#: Members of one block of a table's bucket; a larger bucket is compared block by block.
BLOCK = 2_048
#: Pairs with the same first document that one task verifies; more are dealt over several keys.
PAIRS_PER_KEY = 256
#: Documents whose ids are broadcast to pick texts; more are joined by a shuffle.
BROADCAST_IDS = 100_000
#: Links that a task makes a forest of at once.
LOCAL_LINKS = 200_000
#: Rounds that finding components (the paths in them shorten by a constant factor a round) and naming classes may take.
MAX_ROUNDS = 100
#: Bits of a set's bitmap for each shingle, rounded up to a power of two.
BITS_PER_SHINGLE = 4

SIGNATURE = "doc_id long, text_hash long, n_shingles long, digest string, groups array<long>, bitmap binary"


def bitmap(s: np.ndarray) -> np.ndarray:
    """A set's hashes folded into a power-of-two number of bits (64 at least), as 64-bit words."""
    bits = max(64, 1 << int(BITS_PER_SHINGLE * len(s) - 1).bit_length())
    at = (s >> np.uint64(7)) & np.uint64(bits - 1)
    out = np.zeros(bits, dtype=np.uint8)
    out[at.astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view(np.uint64)


def folded(b: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps (last axis) as ``size`` words would have held them: the low bits of a position survive folding."""
    while b.shape[-1] > size:
        half = b.shape[-1] // 2
        b = b[..., :half] | b[..., half:]
    return b


def bound(n: np.ndarray, maps: np.ndarray, m: int, one: np.ndarray, percent: int) -> np.ndarray:
    """Upper bounds of the similarity of sets with sizes n and one of size m, or -1 where they rule a link out.

    A bit in which two bitmaps differ stands for at least one element that only one of the sets has.
    """
    apart = np.bitwise_count(maps ^ one).sum(axis=-1, dtype=np.int64)
    both = np.minimum((n + m - apart) // 2, np.minimum(n, m))
    return np.where(100 * both >= percent * (n + m - both), both / np.maximum(1, n + m - both), -1.0)


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """SIGNATURE of each row; no words: 0 shingles, no digest and no groups."""

    def run(batches):
        import xxhash

        cache = common.WordHashes()
        seeds = common.mix(np.arange(1, GROUPS * PER_GROUP + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for b in batches:
            out = []
            for doc_id, text_hash, text in common.rows(b, "doc_id", "text_hash", "text"):
                s = common.shingle_set(text, n, cache)
                if not len(s):
                    out.append((doc_id, text_hash, 0, None, None, None))
                    continue
                low = np.array([common.mix(s ^ x).min() for x in seeds]).reshape(GROUPS, PER_GROUP)
                key = low[:, 0]
                for k in range(1, PER_GROUP):
                    key = common.mix(key * np.uint64(31) + low[:, k])
                out.append((doc_id, text_hash, len(s), xxhash.xxh3_128_hexdigest(s.tobytes()), key.view(np.int64).tolist(), bitmap(s).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.binary()), strict=True)], names=["doc_id", "text_hash", "n_shingles", "digest", "groups", "bitmap"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, SIGNATURE)


def class_hash(digest: str, salt: int) -> Column:
    """A class's 64-bit name from its digest; null without one."""
    return F.when(F.col(digest).isNotNull(), F.xxhash64(digest, F.lit(salt)))


def table_keys(classes: DataFrame) -> DataFrame:
    """(key, id, t) of every pair of collections of every class; t numbers the table."""
    pairs = F.array(*[F.struct(F.xxhash64(F.lit(i * GROUPS + j), F.col("groups")[i], F.col("groups")[j]).alias("key"), F.lit(i * GROUPS + j).alias("t")) for i in range(GROUPS) for j in range(i)])
    return classes.select("id", F.explode(pairs).alias("k")).select("k.key", "id", "k.t")


def _forests(batches):
    """(u, v) rows -> for each piece of at most LOCAL_LINKS of them, each end that isn't the smallest of its part with the smallest."""
    held, size = [], 0

    def forest():
        u, v = (np.concatenate(c) for c in zip(*held, strict=True))
        ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        union = hierarchy.Union(len(ids))
        for a, b in zip(at[: len(u)].tolist(), at[len(u) :].tolist(), strict=True):
            union.join(a, b)
        root = np.array([union.find(k) for k in range(len(ids))], dtype=np.int64)
        low = np.flatnonzero(root != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[low]), pa.array(ids[root[low]])], names=["u", "v"])

    for b in batches:
        for lo in range(0, b.num_rows, LOCAL_LINKS):
            part = b.slice(lo, LOCAL_LINKS)
            held.append(tuple(c.to_numpy() for c in part.columns))
            size += part.num_rows
            if size >= LOCAL_LINKS:
                yield forest()
                held, size = [], 0
    if held:
        yield forest()


def components(edges: DataFrame, name: str) -> DataFrame:
    """(id, component) of every node of the edges (a, b): the smallest id reachable.

    Tasks first keep a forest of the links that they have, so what repeats or closes a cycle there is gone before any shuffle.  At most LOCAL_LINKS that are left
    are one task's forest; with more, large-star and small-star steps take turns until nothing changes, each result a table in the shared folder.
    """
    spark = edges.sparkSession
    old, paths = None, []
    path = common.staged_path(spark, name)
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = common.staged(e.mapInArrow(_forests, "u long, v long"), name, f"{path}-forests")
    many = e.count() > LOCAL_LINKS
    if not many:
        e = common.staged(e.repartition(1).mapInArrow(_forests, "u long, v long"), name, f"{path}-all")
    for step in range(MAX_ROUNDS if many else 0):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        paths.append(f"{path}-{step}")
        e = common.staged(e, name, paths[-1])
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if len(paths) > 2:
            common.drop_staged(spark, paths.pop(0))
        if now == old:
            break
        old = now
    else:
        if many:
            raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def bounded(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the bitmaps don't rule out.  maps: (id, n, bitmap)."""
    a, b = (maps.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("bitmap").alias(f"map_{x}")) for x in "ab")
    sized = pairs.join(a, "a").join(b, "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")

    def run(batches):
        for batch in batches:
            out = []
            for x, y, n, m, p, q in common.rows(batch, "a", "b", "n_a", "n_b", "map_a", "map_b"):
                p, q = np.frombuffer(p, dtype=np.uint64), np.frombuffer(q, dtype=np.uint64)
                size = min(len(p), len(q))
                if bound(np.int64(n), folded(p, size), m, folded(q, size), percent) >= 0:
                    out.append((x, y))
            yield _pairs(out)

    return sized.mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, heads: DataFrame, n: int, percent: int, path: str) -> DataFrame:
    """The pairs (a, b) whose full sets are linked, as a table at ``path``.  heads: (id, doc_id, text_hash), docs: doc_id, text.

    The first document of a pair may have many partners: its text goes to as many keys as it has PAIRS_PER_KEY pairs.
    """
    spark = docs.sparkSession
    pairs = common.staged(pairs, "pairs", path + "-pairs")
    ids = pairs.select("a").unionByName(pairs.selectExpr("b as a")).distinct().withColumnRenamed("a", "id").join(heads, "id")
    ids = common.staged(ids, "ids", path + "-ids")
    named = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").alias("d")
    small = ids.count() <= BROADCAST_IDS
    wanted = (F.broadcast(ids) if small else ids).alias("w")
    texts = named.join(wanted, F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.text_hash") == F.col("w.text_hash"))).select("w.id", "d.text")
    texts = common.staged(texts, "texts", path + "-texts").dropDuplicates(["id"])
    counts = pairs.groupBy("a").agg(F.count("*").alias("n"))
    parts = F.ceil(F.col("n") / PAIRS_PER_KEY).cast("long")
    first = counts.join(texts, counts.a == texts.id).select("a", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "text")
    keyed = pairs.join(counts, "a").select("a", "b", F.pmod(F.xxhash64("b"), parts).alias("part"))
    second = keyed.join(texts, keyed.b == texts.id).select("a", "part", "b", "text")

    def run(batches):
        cache, a, part, mine = common.WordHashes(), None, None, None
        for batch in batches:
            out = []
            for x, p, b, text in common.rows(batch, "a", "part", "b", "text"):
                s = common.shingle_set(text, n, cache)
                if b is None:
                    a, part, mine = x, p, s
                elif (x, p) == (a, part):
                    both = len(np.intersect1d(mine, s, assume_unique=True))
                    if 100 * both >= percent * (len(mine) + len(s) - both):
                        out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[], []])], names=["a", "b"])

    both = first.unionByName(second).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    found = common.staged(both.mapInArrow(run, "a long, b long"), "links", path)
    for x in ("pairs", "ids", "texts"):
        common.drop_staged(spark, f"{path}-{x}")
    return found


def _block_survivors(percent: int, most: int | None):
    """Sorted rows (key, x, y, t, ask, wanted, id, component, n, bitmap, groups) -> pairs that the bitmaps don't rule out.

    A block is one (key, x, y): its ``ask`` rows are compared with the others that lie in other components, two wanted
    rows once.  A pair that shares several tables is given by the first of them only.  ``most``: of the partners of a
    row in one component, so many of the largest bound.
    """

    def pairs(block):
        told: dict[int, list] = {}
        for _, ask, wanted, i, comp, n, m, g in block:
            if not ask:
                told.setdefault(len(m) // 8, []).append((n, i, comp, wanted, g, m))
        packed = {k: (*(np.array([r[c] for r in v]) for c in range(5)), np.frombuffer(b"".join(r[5] for r in v), dtype=np.uint64).reshape(len(v), k)) for k, v in told.items()}
        narrow: dict[int, np.ndarray] = {}
        for t, ask, _, i, comp, n, m, g in block:
            if not ask:
                continue
            w, g = np.frombuffer(m, dtype=np.uint64), np.array(g)
            for k in (len(w) // 2, len(w), 2 * len(w)):  # other sizes of bitmap mean sizes too far apart
                if k not in packed:
                    continue
                ns, ids, comps, wanted, groups, maps = packed[k]
                at = np.flatnonzero((comps != comp) & (100 * np.minimum(ns, n) >= percent * np.maximum(ns, n)) & (~wanted | (ids > i)))
                if not len(at):
                    continue
                if k > len(w):
                    if k not in narrow:
                        narrow[k] = folded(maps, len(w))
                    maps = narrow[k]
                b = bound(ns[at], maps[at], n, folded(w, k), percent)
                at, b = at[b >= 0], b[b >= 0]
                if not len(at):
                    continue
                # the first two collections in common make the pair's first table
                agree = groups[at] == g
                low = agree.argmax(axis=1)
                agree[np.arange(len(at)), low] = False
                mine = agree.argmax(axis=1) * GROUPS + low == t
                at, b = at[mine], b[mine]
                if most is not None and len(at):
                    at = at[np.lexsort((ids[at], -b))]
                    kept: dict[int, int] = {}
                    chosen = []
                    for q in at.tolist():
                        c = int(comps[q])
                        kept[c] = kept.get(c, 0) + 1
                        if kept[c] <= most:
                            chosen.append(q)
                    at = chosen
                for q in at:
                    yield (i, int(ids[q])) if i < ids[q] else (int(ids[q]), i)

    def run(batches):
        key, block, seen = None, [], set()
        for batch in batches:
            for k, x, y, *row in common.rows(batch, "key", "x", "y", "t", "ask", "wanted", "id", "component", "n", "bitmap", "groups"):
                if (k, x, y) != key:
                    seen.update(pairs(block))
                    key, block = (k, x, y), []
                block.append(row)
            if len(seen) > 50_000:
                yield _pairs(seen)
                seen = set()
        seen.update(pairs(block))
        yield _pairs(seen)

    return run


def _pairs(found):
    found = sorted(found)
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def classes(docs: DataFrame, n: int, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, str]:
    """Members, links and the path of their tables, for each row of ``docs`` (doc_id, text).

    Members are (doc_id, text_hash, n_shingles, id): equal sets, told by digests of 128 bits, are one class ``id``, a
    64-bit hash that no two of them share; null without words.
    Links (a, b) are pairs of classes that are linked, enough of them to join all that are.
    """
    path = common.staged_path(docs.sparkSession, "near")
    sig = common.staged(signatures(docs, n), "near", path).withColumn("id", class_hash("digest", 0))
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("head")
    for salt in range(1, MAX_ROUNDS):
        one = sig.where("id is not null").groupBy("id").agg(head, F.first("n_shingles").alias("n"), F.first("groups").alias("groups"), F.first("bitmap").alias("bitmap"), F.min("digest").alias("least"), F.max("digest").alias("most"))
        of = common.staged(one.select("id", "head.doc_id", "head.text_hash", "n", "groups", "bitmap", "least", "most"), "near-classes", f"{path}-classes{salt}")
        clash = of.where("least <> most").select("id", "least")
        if not clash.limit(1).count():
            break
        # different sets under one id: all but that of the smallest digest are named anew
        renamed = F.when(F.col("digest") != F.col("least"), class_hash("digest", salt)).otherwise(F.col("id"))
        sig = common.staged(sig.join(clash, "id", "left").withColumn("id", renamed).drop("least"), "near-named", f"{path}-ids{salt}")
    else:
        raise RuntimeError(f"class ids still clash after {MAX_ROUNDS} rounds")
    member = sig.select("doc_id", "text_hash", "n_shingles", "id")
    heads = of.select("id", "doc_id", "text_hash")
    keys = table_keys(of)
    shared = keys.groupBy("key").agg(F.count("*").alias("rows"), F.min("id").alias("p"), F.max("id").alias("q")).where("p <> q")
    shared = common.staged(shared, "near-shared", path + "-shared")
    twos = shared.where("rows = 2").select(F.col("p").alias("a"), F.col("q").alias("b")).distinct()
    large = shared.where("rows > 2").select("key", "rows")
    bucket = common.staged(keys.join(large, "key"), "near-bucket", path + "-bucket")
    # each class of a larger bucket against the first and last of its buckets in a few orders
    turned = [F.col("id").bitwiseXOR(F.lit(x)) for x in ORDERS]
    ends = bucket.groupBy("key").agg(*[f(t).alias(f"{n}{k}") for k, t in enumerate(turned) for n, f in (("lo", F.min), ("hi", F.max))])
    mine = bucket.select("key", "id").join(ends, "key").groupBy("id").agg(*[f(f"{n}{k}").alias(f"{n}{k}") for k in range(len(ORDERS)) for n, f in (("lo", F.min), ("hi", F.max))])
    others = F.array(*[F.col(f"{n}{k}").bitwiseXOR(F.lit(x)) for k, x in enumerate(ORDERS) for n in ("lo", "hi")])
    pivots = mine.select(F.explode(F.array_distinct(others)).alias("a"), F.col("id").alias("b")).where("a <> b")
    maps = of.select("id", "n", "bitmap", "groups")
    links = verified(bounded(_once(pivots), maps, percent), docs, heads, n, percent, path + "-links0")
    # what shares a key but not a component: first the likeliest partners only, then all that are left
    for step, most in ((1, 1), (2, None)):
        comp = common.staged(components(links, "near-component"), "near-comp", f"{path}-comp{step}")
        asked = _candidates(bucket, comp, maps, percent, most)
        if step == 1:  # buckets of two classes, where these aren't joined yet
            asked = asked.unionByName(bounded(_once(_apart(twos, comp)), maps, percent)).distinct()
        links = links.unionByName(verified(asked, docs, heads, n, percent, f"{path}-links{step}"))
    return member, links, path


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each distinct doc_id of ``docs`` (doc_id, text).

    Links are those of 100 * intersection >= percent * union of the n-word shingle sets; a component's id is its
    smallest doc_id.  Null, empty and wordless texts have no shingles and stand alone.  Fewer than n words are one
    shingle.  Rows with a null doc_id can't be named and are left out.  Rows that repeat a doc_id are one document: it is
    linked with all that any of its texts is linked with, and n_shingles is that of its largest set.  Other columns are not read.
    """
    docs = docs.where("doc_id is not null")
    member, links, path = classes(docs, n, percent)
    one = member.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"), F.min("id").alias("id"), F.max("id").alias("other"))
    one = common.staged(one, "near-member", path + "-member")
    # the classes of one document's texts belong together
    several = member.join(one.where("id <> other").select("doc_id", F.col("id").alias("a")), "doc_id").where("id <> a").select("a", F.col("id").alias("b"))
    comp = components(links.unionByName(several), "near-component")
    least = one.where("id is not null").groupBy("id").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")).join(comp, "id", "left")
    least = common.staged(least.select("id", "least", "rows", F.coalesce("component", "id").alias("component")), "near-least", path + "-least")
    whole = least.groupBy("component").agg(F.min("least").alias("component_id"), F.sum("rows").alias("total")).where("total > 1")
    named = common.staged(least.join(whole, "component").select("id", "component_id"), "near-named", path + "-named")
    named = F.broadcast(named) if named.count() <= BROADCAST_IDS else named
    out = one.join(named, "id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def deduplicated(docs: DataFrame, n: int = 5, percent: int = PERCENT) -> DataFrame:
    """``docs`` (doc_id, text and any others) with one row of each group of linked texts, that of the smallest doc_id.

    Rows are told apart by doc_id and text: different texts under one doc_id are rows of their own, and of rows with the
    same doc_id and text one stays, also without words.  Otherwise wordless and null texts all stay.  Null doc_ids come last.
    """
    member, links, path = classes(docs, n, percent)
    comp = components(links, "near-component")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    least = member.where("id is not null").groupBy("id").agg(F.min(key).alias("least"), F.count("*").alias("rows")).join(comp, "id", "left")
    least = common.staged(least.select("id", "least", "rows", F.coalesce("component", "id").alias("component")), "near-least", path + "-least")
    whole = least.groupBy("component").agg(F.min("least").alias("head"), F.sum("rows").alias("total")).where("total > 1")
    named = common.staged(least.join(whole, "component").select("id", "head"), "near-named", path + "-named")
    named = F.broadcast(named) if named.count() <= BROADCAST_IDS else named
    same = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_hash") == F.col("head.text_hash"))
    gone = member.join(named, "id").where(~same).select("doc_id", "text_hash").distinct()
    gone = common.staged(gone, "near-gone", path + "-gone")
    less = (F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone).alias("g")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("i"), F.xxhash64("text").alias("h"))
    left = row.join(less, F.col("i").eqNullSafe(F.col("g.doc_id")) & (F.col("h") == F.col("g.text_hash")), "left_anti")
    if member.groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count():
        left = left.dropDuplicates(["i", "h"])
    return left.select("row.*")


def _once(pairs: DataFrame) -> DataFrame:
    """Each unordered pair once; which document comes first is kept from one of the rows."""
    low = pairs.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.min("a").alias("a"))
    return low.select("a", F.when(F.col("a") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("b"))


def _apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs (a, b) that lie in different components."""
    of = lambda x: comp.select(F.col("id").alias(x), F.col("component").alias(f"c_{x}"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b")


def _candidates(bucket: DataFrame, comp: DataFrame, maps: DataFrame, percent: int, most: int | None) -> DataFrame:
    """Pairs of classes that share a key, lie in different components and may be linked by their bitmaps."""
    sizes = comp.groupBy("component").agg(F.count("*").alias("members"))
    comp = comp.join(sizes, "component")
    row = bucket.select("key", "t", "id").join(comp, "id", "left").select("key", "t", "id", F.coalesce("component", "id").alias("component"), F.coalesce("members", F.lit(1)).alias("members"))
    # the largest component of a bucket is compared with by the others, not within itself
    per = row.groupBy("key", "component").agg(F.max("members").alias("members"), F.count("*").alias("here")).groupBy("key").agg(F.max(F.struct("members", "component", "here")).alias("main"), F.sum("here").alias("rows"))
    mixed = per.where("rows > main.here").select("key", F.col("main.component").alias("main"), "rows", (F.col("rows") - F.col("main.here")).alias("asking"))
    row = row.join(mixed, "key").withColumn("wanted", F.col("component") != F.col("main"))
    # a grid of blocks: the wanted rows of block x meet all rows of block y
    wide, high = (F.ceil(F.col(c) / BLOCK).cast("long") for c in ("asking", "rows"))
    own = lambda blocks: F.pmod(F.xxhash64("id", F.lit(3)), blocks)
    every = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    asks = row.where("wanted").select("key", "t", own(wide).alias("x"), every(high).alias("y"), F.lit(True).alias("ask"), "wanted", "id", "component")
    told = row.select("key", "t", every(wide).alias("x"), own(high).alias("y"), F.lit(False).alias("ask"), "wanted", "id", "component")
    dealt = asks.unionByName(told).join(maps, "id").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    found = dealt.select("key", "x", "y", "t", "ask", "wanted", "id", "component", "n", "bitmap", "groups").mapInArrow(_block_survivors(percent, most), "a long, b long")
    return found.distinct()


def op2_minhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents on 2-word shingles at 0.8."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=2)
