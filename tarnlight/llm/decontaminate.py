"""Benchmark decontamination by greedy string tiling.

Windows of MIN_MATCH words of the benchmark items, hashed by Karp-Rabin, are the seeds; documents that share seeds
with an item are tiled with it: the longest match of words that aren't covered yet is marked, again and again.  A
document is contaminated by an item if the tiles cover a large share of the item, in whatever order they stand.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words in the shortest tile, and the share of an item's words that tiles must cover.
MIN_MATCH, MIN_COVERAGE = 5, 0.5
#: Words of benchmark items that one block holds on average; each block has a pass of its own over the documents.
BLOCK_WORDS = 2_000_000
#: Periods, in words, of repetition that is thinned out.
PERIODS = 8
#: The rolling hash's base (odd, so that it has an inverse modulo 2^64).
BASE = 0x9E3779B97F4A7C15
MARKS = b"".join(bytes([c]) for c in range(33, 127) if not chr(c).isalnum())


def tokens(text: str | None, cache: common.WordHashes) -> np.ndarray:
    """Hashes of the words of a text: lower-cased, marks at their edges taken off, words of marks alone left out."""
    return np.array([cache[x] for w in (text or "").lower().encode("utf-8", "surrogatepass").split() if (x := w.strip(MARKS))], dtype=np.uint64)


class Powers:
    """BASE to the powers 0, 1, ... and their inverses modulo 2^64, longer when a longer text needs it."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << n.bit_length()
            step = np.full(size, BASE, dtype=np.uint64)
            back = np.full(size, pow(BASE, -1, 1 << 64), dtype=np.uint64)
            step[0] = back[0] = 1
            self.up, self.down = np.multiply.accumulate(step), np.multiply.accumulate(back)
        return self.up[:n], self.down[:n]


def windows(words: np.ndarray, n: int, powers: Powers) -> np.ndarray:
    """Karp-Rabin hashes of all windows of n words, from one running sum."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    up, down = powers.get(len(words))
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(words * up, dtype=np.uint64)])
    return common.mix((total[n:] - total[:-n]) * down[: len(words) - n + 1])


def inside_runs(h: np.ndarray, margin: int) -> np.ndarray:
    """Windows deep inside a stretch that repeats with a short period: farther than ``margin`` from both of its ends.

    An item of ``margin`` words can be laid over a longer stretch in the same ways at its ends as anywhere inside.
    """
    out = np.zeros(len(h), dtype=bool)
    for p in range(1, PERIODS + 1):
        if len(h) <= p + 2 * margin:
            break
        same = np.concatenate([[False], h[p:] == h[:-p], [False]])
        edge = np.flatnonzero(np.diff(same.astype(np.int8)))
        for a, b in zip(edge[::2], edge[1::2], strict=True):
            # windows a to b + p - 1 repeat; whole periods are kept
            if b + p - a > 2 * margin + 2 * p:
                out[a + margin + p : b - margin] = True
    return out


def tile(item: np.ndarray, doc: np.ndarray, at_item: np.ndarray, at_doc: np.ndarray, n: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy tiles (length, start in item, start in doc) from seeds: pairs of starts of equal windows of n words.

    Of equal lengths the first in the item, then in the document, is taken.
    """
    order = np.lexsort((at_item, at_doc - at_item))
    i, j = at_item[order], at_doc[order]
    cuts = np.flatnonzero((np.diff(j - i) != 0) | (np.diff(i) != 1)) + 1
    first, last = np.concatenate([[0], cuts]).astype(int), np.concatenate([cuts, [len(i)]]).astype(int)
    heap = [(-(b - a + n - 1), int(i[a]), int(j[a])) for a, b in zip(first, last, strict=True)]
    heapq.heapify(heap)
    used_i, used_j, found = np.zeros(len(item), dtype=bool), np.zeros(len(doc), dtype=bool), []
    while heap:
        size, a, b = heapq.heappop(heap)
        size = -size
        taken = used_i[a : a + size] | used_j[b : b + size]
        if not taken.any():
            used_i[a : a + size] = used_j[b : b + size] = True
            found.append((size, a, b))
        else:
            free = np.flatnonzero(np.diff(np.concatenate([[1], taken, [1]]).astype(np.int8)))
            for x, y in zip(free[::2], free[1::2], strict=True):
                if y - x >= n:
                    heapq.heappush(heap, (-int(y - x), a + int(x), b + int(x)))
    return found


class Block:
    """Items of one block: their words and a sorted seed table (hash, item, start)."""

    def __init__(self, items: list[tuple[int, np.ndarray]], n: int):
        powers = Powers()
        self.ids, self.words, self.n = [i for i, _ in items], [w for _, w in items], n
        self.longest = max(map(len, self.words), default=0)
        hashes = [windows(w, n, powers) for w in self.words]
        self.seed = np.concatenate([*hashes, np.zeros(0, dtype=np.uint64)])
        self.item = np.repeat(np.arange(len(items)), [len(h) for h in hashes])
        self.start = np.concatenate([*(np.arange(len(h)) for h in hashes), np.zeros(0, dtype=np.int64)])
        order = np.lexsort((self.start, self.item, self.seed))
        self.seed, self.item, self.start = self.seed[order], self.item[order], self.start[order]

    def matches(self, doc: np.ndarray, powers: Powers):
        """(item number, tiles) of each item that shares a seed with the document."""
        h = windows(doc, self.n, powers)
        if not len(h) or not len(self.seed):
            return
        lo = np.searchsorted(self.seed, h)
        known = self.seed[np.minimum(lo, len(self.seed) - 1)] == h
        if known.sum() > 2 * self.longest:
            known &= ~inside_runs(h, self.longest)
        at = np.flatnonzero(known)
        if not len(at):
            return
        lo, hi = lo[at], np.searchsorted(self.seed, h[at], side="right")
        count = hi - lo
        k = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        j = np.repeat(at, count)
        for item in np.unique(self.item[k]):
            of = self.item[k] == item
            yield int(item), tile(self.words[item], doc, self.start[k[of]], j[of], self.n)


OUT = "doc_id long, item_id long, covered int, item_words int, coverage double, tiles array<struct<words:int,in_item:int,in_doc:int>>"


def contaminated(docs: DataFrame, benchmark: DataFrame, min_coverage: float = MIN_COVERAGE, n: int = MIN_MATCH, keep: bool = False) -> DataFrame:
    """A row for each document and benchmark item that it contains, with the tiles (OUT); docs: doc_id, text.

    With ``keep``, instead the rows of ``docs`` whose document contains no item, all columns as they are.
    Null and empty texts contain nothing.  Items of fewer than ``n`` words (also null and empty ones) can't be told from
    chance and match nothing; an item with a null or repeated id counts by itself.  Documents with null or repeated
    doc_id are judged row by row.  The benchmark goes out in blocks of about BLOCK_WORDS words, with one pass over the
    documents for each; if there are several, a pass is written out before the next block is sent.
    """
    spark = docs.sparkSession
    sized = benchmark.select("item_id", "text").where("text is not null")
    words = sized.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = -(-words // BLOCK_WORDS) or 1
    cache = common.WordHashes()
    kept, found = docs, None
    for k in range(blocks):
        mine = sized.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k) if blocks > 1 else sized
        rows = sorted(((i, t) for i, t in mine.toLocalIterator()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        sent = common.sent(spark, Block([(i, w) for i, t in rows if len(w := tokens(t, cache)) >= n], n))
        if keep:
            kept = kept.mapInArrow(_scan(sent, min_coverage, True), kept.schema)
            kept = common.staged(kept, "decontaminated") if blocks > 1 else kept
        else:
            part = docs.select("doc_id", "text").mapInArrow(_scan(sent, min_coverage, False), OUT)
            part = common.staged(part, "contaminated") if blocks > 1 else part
            found = part if found is None else found.unionByName(part)
    return kept if keep else found


def _scan(sent, min_coverage: float, keep: bool):
    tiles_type = pa.list_(pa.struct([("words", pa.int32()), ("in_item", pa.int32()), ("in_doc", pa.int32())]))
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("covered", pa.int32()), ("item_words", pa.int32()), ("coverage", pa.float64()), ("tiles", tiles_type)])

    def run(batches):
        block, cache, powers = sent(), common.WordHashes(), Powers()
        for b in batches:
            out, clean = [], []
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            ids = b.column(b.schema.get_field_index("doc_id")).to_pylist()
            for doc_id, text in zip(ids, texts, strict=True):
                bad = False
                for item, tiles in block.matches(tokens(text, cache), powers):
                    covered, size = sum(t[0] for t in tiles), len(block.words[item])
                    if covered >= min_coverage * size:
                        bad = True
                        out.append((doc_id, block.ids[item], covered, size, covered / size, [dict(zip(("words", "in_item", "in_doc"), t, strict=True)) for t in tiles]))
                clean.append(not bad)
            if keep:
                yield b.filter(pa.array(clean, pa.bool_()))
            elif out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it contains."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs, items).select("doc_id", "item_id", "covered", "item_words", "coverage", F.size("tiles").alias("n_tiles"))
