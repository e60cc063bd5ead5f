"""Lexical retrieval packing: BM25 neighbours of a seed document fill its window.

Every document is tokenised once into a table in the shared folder.  Whole windows of a long document stand alone;
what is left of each document, its rest, is packed.  Rests are routed by content: a tree of centroids over projected BM25 weights
puts rests with common terms next to each other, and the order is cut into shards of bounded size, however many
rests are alike.  Each shard has an inverted index over its rests, with BM25 weights from statistics of the whole corpus.  A seed's
window is filled with the best neighbours of its shard that are still unused, the last of which is cut where the window
ends; what is left of it is the next seed.  A last window that isn't full goes to the next shard.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 1024
#: Rests in a shard at most; an index of so many stays within some 200 MB.
SHARD_ROWS = 4_096
#: Dimensions of the projection, rests that the tree of centroids is fitted on, children of its nodes, leaves for each shard.
DIMENSIONS, SAMPLE, FANOUT, LEAVES = 64, 32_768, 8, 1
#: Rests of a partition on average, of which one shard at a time is in memory.
PARTITION_ROWS = 16_384
#: BM25's saturation and length weights.
K1, B = 1.2, 0.75
#: The token that ends every document, and the tokenizer file.
END = 0
TOKENIZER = "byte_bpe_50k.json"
#: Pieces remembered by a worker at once, their longest, and the longest that isn't given to the tokenizer itself.
CACHED, CACHED_CHARS, PIECE_CHARS = 400_000, 24, 4_096
# Letters, numbers and white space among the characters up to U+024F.
LETTERS, NUMBERS, SPACES = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
# The byte-level split rule over these classes, and what lies outside of them (punctuation and currency signs are neither).
SPLIT = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
OUTSIDE = re.compile("[^\x00-\u024f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]")
_loaded: dict[str, object] = {}


class Pieces(dict):
    """Piece of a text -> bytes of its ids; short ones are remembered."""

    def __init__(self, merge, whole):
        self.merge, self.whole = merge, whole

    def __missing__(self, piece: str) -> bytes:
        if len(piece) > PIECE_CHARS:
            return array("I", self.whole.encode(piece, add_special_tokens=False).ids).tobytes()
        ids = array("I", self.merge(piece)).tobytes()
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHED:
                self.clear()
            self[piece] = ids
        return ids


def encoder(path: str | None = None):
    """text -> uint32 ids, equal to the ids of ``tokenizers`` for the byte-level vocabulary at ``path``.

    The merges of such a file are in the order of the ids, so tiktoken's merge loop over the same vocabulary gives the same
    ids of a piece; pieces are split here and remembered.  Texts with characters outside of SPLIT's classes, special
    tokens and very long pieces go to ``tokenizers`` itself.  The tests hold both against each other.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    if path not in _loaded:
        import json

        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # The printable stand-ins for bytes of byte-level vocabularies.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(c): c for c in plain} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in plain)}
        special = [t["content"] for t in spec.get("added_tokens", [])]
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        core = tiktoken.Encoding("bytes", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
        whole = Tokenizer.from_file(path)
        pieces = Pieces(core.encode_ordinary, whole)

        def encode(text: str) -> np.ndarray:
            if any(t in text for t in special) or not text.isascii() and OUTSIDE.search(text):
                return np.array(whole.encode(text, add_special_tokens=False).ids, dtype="<u4")
            return np.frombuffer(b"".join(map(pieces.__getitem__, SPLIT.findall(text))), dtype="<u4")

        _loaded[path] = encode
    return _loaded[path]


TOKENS = "doc_id long, salt long, doc_tokens long, rest_start long, rest binary, crcs array<long>"
TOKEN_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]


def tokenize(docs: DataFrame, window: int = WINDOW, path: str | None = None) -> DataFrame:
    """TOKENS of each row of ``docs``: its number of tokens, the CRC-32 of each whole window, the tokens left over (uint32 bytes).

    ``salt`` is a hash that differs between equal rows of a partition too.
    """

    def run(batches):
        encode, row = encoder(path), 0
        for b in batches:
            out = []
            for doc_id, text in common.rows(b, "doc_id", "text"):
                ids = np.append(encode(text or ""), np.uint32(END)).astype("<u4")
                whole = len(ids) // window * window
                crcs = [zlib.crc32(ids[i : i + window].tobytes()) for i in range(0, whole, window)]
                rest = ids[whole:].tobytes()
                row += 1
                salt = common.mix(np.array([zlib.crc32(rest) << 31 ^ row * 0x9E3779B1 ^ zlib.crc32(repr(doc_id).encode())], dtype=np.uint64))
                out.append((doc_id, int(salt.view(np.int64)[0]), len(ids), whole, rest, crcs))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), TOKEN_TYPES, strict=True)], names=["doc_id", "salt", "doc_tokens", "rest_start", "rest", "crcs"])

    return docs.select("doc_id", "text").mapInArrow(run, TOKENS)


def bags(rests: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of the rest, token, count) of each rest's distinct tokens, sorted, and the rests' lengths."""
    length = np.array([len(r) for r in rests], dtype=np.int64)
    key = np.repeat(np.arange(len(rests)), length) << 32 | np.concatenate([*rests, np.zeros(0, dtype=np.int64)]).astype(np.int64)
    key.sort()
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first] >> 32, key[first] & 0xFFFFFFFF, np.diff(first, append=len(key)), length


def _rests(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(r, dtype="<u4") for (r,) in common.rows(batch, "rest")]


def _frequencies(batches):
    """(rest) rows -> by token id, the rests that hold it."""
    n = np.zeros(1, dtype=np.int64)
    for b in batches:
        more = np.bincount(bags(_rests(b))[1], minlength=len(n))
        more[: len(n)] += n
        n = more
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_pydict({"token": at, "n": n[at]}, schema=pa.schema([("token", pa.int64()), ("n", pa.int64())]))


def _weights(token: np.ndarray, count: np.ndarray, length: np.ndarray, idf: np.ndarray, mean: float) -> np.ndarray:
    """BM25 weights of tokens in rests of these lengths."""
    return idf[token] * count * (K1 + 1) / (count + K1 * (1 - B + B * length / mean))


class Projection:
    """Rests as unit vectors: their BM25 weights times a random matrix, so common terms make them alike."""

    def __init__(self, idf: np.ndarray, mean: float):
        self.idf, self.mean = idf, mean
        self.matrix = np.random.default_rng(5).standard_normal((len(idf), DIMENSIONS), dtype=np.float32)

    def __call__(self, rests: list[np.ndarray]) -> np.ndarray:
        row, token, count, length = bags(rests)
        weight = _weights(token, count, length[row], self.idf, self.mean).astype(np.float32)
        ends = np.searchsorted(row, np.arange(len(rests) + 1))
        out = np.array([weight[i:j] @ self.matrix[token[i:j]] for i, j in zip(ends[:-1], ends[1:], strict=True)], dtype=np.float32).reshape(len(rests), DIMENSIONS)
        return out / np.maximum(1e-9, np.linalg.norm(out, axis=1, keepdims=True))


def _centroids(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """k-means on unit vectors; centroids in the order of a chain from each to the nearest that is left."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        for j in range(k):
            if (near == j).any():
                total = x[near == j].sum(0)
                c[j] = total / max(1e-9, float(np.linalg.norm(total)))
    order = [0]
    while len(order) < k:
        left = [j for j in range(k) if j not in order]
        order.append(left[int((c[left] @ c[order[-1]]).argmax())])
    return c[order]


def fit_tree(x: np.ndarray, share: float, leaf_rows: float) -> tuple:
    """(centroids, children) of a node, None for a leaf: split until a leaf stands for ``leaf_rows`` rests; share: vectors to rests."""
    rows = len(x) / share
    if rows <= leaf_rows or len(x) < 4:
        return None
    c = _centroids(x, min(FANOUT, len(x), math.ceil(rows / leaf_rows)))
    near = (x @ c.T).argmax(1)
    if len(np.unique(near)) < 2:  # equal vectors
        return None
    return c, [fit_tree(x[near == j], share, leaf_rows) for j in range(len(c))]


def route(tree: tuple | None, x: np.ndarray) -> np.ndarray:
    """Number of the leaf of each vector, in the order of the tree."""
    out, first = np.zeros(len(x), dtype=np.int64), [0]

    def walk(node, at):
        if node is None:
            out[at] = first[0]
            first[0] += 1
            return
        near = (x[at] @ node[0].T).argmax(1) if len(at) else np.zeros(0, dtype=int)
        for j, child in enumerate(node[1]):
            walk(child, at[near == j])

    walk(tree, np.arange(len(x)))
    return out


class Index:
    """Inverted index of a shard: postings (rest, BM25 weight) by token.

    Scores by tokens of at least an eighth of the shard come from one product of matrices, those by rarer tokens from postings.
    """

    def __init__(self, rests: list[np.ndarray], idf: np.ndarray, mean: float):
        d, t, c, length = bags(rests)
        good = idf[t] > 0
        d, t, c = d[good], t[good], c[good]
        w = _weights(t, c, length[d], idf, mean)
        self.n = len(rests)
        often = np.bincount(t, minlength=len(idf)) * 8 >= max(8, self.n)
        at, number = often[t], np.cumsum(often) - 1
        dense = np.zeros((int(often.sum()), self.n))
        dense[number[t[at]], d[at]] = w[at]
        self.dense = (dense > 0).astype(np.float64).T @ dense
        d, t, w = d[~at], t[~at], w[~at]
        self.terms = np.split(t, np.searchsorted(d, np.arange(1, self.n)))
        order = np.argsort(t, kind="stable")
        self.docs, self.weights = d[order], w[order]
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=len(idf)))])

    def scores(self, k: int) -> np.ndarray:
        """BM25 of every rest for the distinct tokens of rest k."""
        lo = self.begin[self.terms[k]]
        size = self.begin[self.terms[k] + 1] - lo
        at = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
        return self.dense[k] + np.bincount(self.docs[at], weights=self.weights[at], minlength=self.n)


def _ranked(score: np.ndarray, n: int):
    """Numbers of the n best scores, best first, equal ones in order; the first few are found without sorting all."""
    few = 16
    if n > 4 * few:
        top = np.flatnonzero(score >= np.partition(score, len(score) - few)[len(score) - few])
        yield from top[np.argsort(-score[top], kind="stable")].tolist()
        few = len(top)
    else:
        few = 0
    yield from np.argsort(-score, kind="stable")[few:n].tolist()


def fill(rests: list[np.ndarray], idf: np.ndarray, mean: float, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (rest, start in rest, length, sequence, offset) that use every token of the rests once.

    Seeds are taken in order, a cut neighbour first; equal scores go to the earlier rest.
    """
    index = Index(rests, idf, mean)
    used = np.zeros(len(rests), dtype=bool)
    at = np.zeros(len(rests), dtype=np.int64)
    pieces, sequence, cut, nxt = [], 0, -1, 0
    while True:
        if cut < 0:
            while nxt < len(rests) and used[nxt]:
                nxt += 1
            if nxt == len(rests):
                return pieces
            cut = nxt
        seed, cut, free = cut, -1, window
        queue = iter([seed])
        ranked = False
        while free:
            k = next(queue, None)
            if k is None:
                if ranked:
                    break
                ranked = True
                queue = _ranked(np.where(used, -1.0, index.scores(seed)), len(used) - int(used.sum()))
                continue
            used[k] = True
            size = min(free, len(rests[k]) - int(at[k]))
            pieces.append((k, int(at[k]), size, sequence, window - free))
            at[k] += size
            free -= size
            if at[k] < len(rests[k]):
                cut = k
        sequence += 1


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
PIECE_SCHEMA = pa.schema([(x.split()[0], pa.int64()) for x in PIECES.split(", ")])
ROUTED = "doc_id long, doc_tokens long, rest_start long, rest binary, salt long, leaf long, place long"


def pack(docs: DataFrame, window: int = WINDOW, shard_rows: int = SHARD_ROWS, path: str | None = None) -> DataFrame:
    """Pieces of all documents (doc_id, text; other columns are not read), one row each (PIECES).

    Null and empty texts are the end token alone.  Repeated rows and null ids are packed like any other.
    """
    spark = docs.sparkSession
    table = common.staged(tokenize(docs, window, path), "packing-tokens")
    rests = table.where(F.length("rest") > 0)
    total = rests.agg(F.count("*"), F.sum(F.length("rest"))).first()
    n, mean = total[0], (total[1] or 0) / 4 / max(1, total[0])
    seen = rests.select("rest").mapInArrow(_frequencies, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()  # at most a row for each token of the vocabulary
    df = np.zeros(int(seen.token.max()) + 1 if len(seen) else 1)
    df[seen.token.to_numpy(dtype=int)] = seen.n.to_numpy()
    idf = np.maximum(0.0, np.log((n - df + 0.5) / (df + 0.5)))
    tree = _tree(rests, n, idf, mean, shard_rows)
    sent = common.sent(spark, (idf, mean, tree))  # bounded by the vocabulary and SAMPLE

    def routed(batches):
        idf, mean, tree = sent()
        project = Projection(idf, mean)
        turn = np.random.default_rng(6).standard_normal((DIMENSIONS, 16), dtype=np.float32)
        for b in batches:
            x = project(_rests(b))
            # rests of a leaf by the side of 16 planes on which they lie
            place = (x @ turn > 0) @ (1 << np.arange(15, -1, -1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(route(tree, x)), pa.array(place.astype(np.int64))], names=[*b.schema.names, "leaf", "place"])

    def run(batches):
        idf, mean, _ = sent()
        held, first, leaf = [], TaskContext.get().partitionId() << 32, None

        def done(end: bool):
            """A batch of the shard's pieces, and what stands in its last window if that isn't full: the next shard takes it."""
            nonlocal first
            got = [np.frombuffer(r[3], dtype="<u4") for r in held]
            pieces = fill(got, idf, mean, window)
            last, left = pieces[-1][3], []
            if not end and pieces[-1][2] + pieces[-1][4] < window:
                left = [(*held[k][:2], held[k][2] + start, held[k][3][4 * start :], held[k][4]) for k, start, _, seq, _ in pieces if seq == last]
                pieces = [p for p in pieces if p[3] < last]
            out = [(held[k][0], held[k][2] + start, size, zlib.crc32(got[k][start : start + size].tobytes()), held[k][1], first + seq, offset) for k, start, size, seq, offset in pieces]
            first += last + 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * len(PIECE_SCHEMA))], schema=PIECE_SCHEMA), left

        for b in batches:
            for row in common.rows(b, "doc_id", "doc_tokens", "rest_start", "rest", "leaf"):
                # a shard ends with a leaf if it can
                if len(held) >= shard_rows or row[4] != leaf and 2 * len(held) >= shard_rows:
                    out, held = done(False)
                    yield out
                leaf = row[4]
                held.append(row)
        if held:
            yield done(True)[0]

    parts = min(max(2 * spark.sparkContext.defaultParallelism, math.ceil(n / PARTITION_ROWS)), math.ceil(n / shard_rows))
    near = rests.select("doc_id", "doc_tokens", "rest_start", "rest", "salt").mapInArrow(routed, ROUTED)
    # by salt too, so any number of rests alike spread over partitions
    near = near.repartitionByRange(max(1, parts), "leaf", "place", "salt").sortWithinPartitions("leaf", "place", "salt")
    tails = near.select("doc_id", "doc_tokens", "rest_start", "rest", "leaf").mapInArrow(run, PIECES)
    # sequences of whole windows are numbered from 2^62, above those of the rests
    whole = table.where(F.size("crcs") > 0).select("doc_id", "doc_tokens", F.posexplode("crcs").alias("k", "ids_crc32"))
    whole = whole.withColumn("at", F.monotonically_increasing_id())
    full = whole.select("doc_id", (F.col("k").cast("long") * window).alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("at") + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return tails.unionByName(full)


def _tree(rests: DataFrame, n: int, idf: np.ndarray, mean: float, shard_rows: int) -> tuple | None:
    """The tree of centroids, fitted on some SAMPLE rests chosen by salt; every rest is routed by it."""
    if n <= shard_rows:
        return None
    share = min(1.0, SAMPLE / n)
    sent = common.sent(rests.sparkSession, (idf, mean))

    def run(batches):
        project = Projection(*sent())
        for b in batches:
            x = project(_rests(b))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["salt", "x"])

    def fit(batches):
        got = [b.column(1).to_pylist() for b in batches]
        x = np.frombuffer(b"".join(v for g in got for v in g), dtype=np.float32).reshape(-1, DIMENSIONS)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit_tree(x, max(1, len(x)) / n, shard_rows / LEAVES))], pa.binary())], names=["tree"])

    some = rests if share == 1 else rests.where(F.col("salt") < int((2 * share - 1) * (1 << 63)))
    # one task has about SAMPLE rows of DIMENSIONS floats
    vectors = some.select("salt", "rest").mapInArrow(run, "salt long, x binary").repartition(1).sortWithinPartitions("salt", "x")
    return pickle.loads(vectors.mapInArrow(fit, "tree binary").first()[0])


def op4_packing(spark, sf_dir: str) -> DataFrame:
    """Every document cut and packed into sequences of at most 1024 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
