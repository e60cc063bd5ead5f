"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text, and how common such pairs are.

Texts are taken in blocks of several documents.  A block's texts are laid end to end; the byte offsets at which tokens of either
tokenizer end are counted once (``bincount``), a cut lies where both end, and prefix sums over the block, read at the documents'
offsets, give each document's results.  Where tokens of one tokenizer or the other end, one pair of overlapping tokens ends, so
the sorted ends list every link.  A block keeps its links as numbers of its distinct id pairs; these alone are counted over the corpus
and joined with their counts, a row for each block and pair, so that a pair that all documents hold isn't a row for each of them.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common, packing

#: Bytes of text that fill a block, and bytes whose ends are counted at once.
BLOCK_BYTES, MARK_BYTES = 4 << 20, 4 << 20
#: The two tokenizers' files: byte-level BPE and pieces with byte fallback.
TOKENIZER_A, TOKENIZER_B = packing.TOKENIZER, "piece_bpe_32k.model"
#: An id pair is one number, a << B_BITS | b; vocabularies must fit.
B_BITS = 15
# The character that stands for a space in pieces.
SPACE = "▁"


class Both:
    """The two tokenizers, the bytes of their tokens, and the text of ids followed by each separator."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.encode_a = packing.encoder(path_a)
        self.plain = Tokenizer.from_file(path_a)
        self.plain.encode_special_tokens = True  # the strings of special tokens are plain text
        with open(path_a, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f).get("added_tokens", [])]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(c): c for c in plain} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in plain)}
        vocab = self.plain.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = token.encode() if token in self.special else bytes(byte[c] for c in token)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        size = self.pieces.get_piece_size()
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in ((i, self.pieces.id_to_piece(i)) for i in range(size))]
        if size > 1 << B_BITS or len(self.bytes_a) > 1 << 31 - B_BITS:
            raise ValueError("an id pair must fit 31 bits")
        self.length_a, self.length_b = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.bytes_a, self.bytes_b))
        # ids as text with what follows: another of the group, or the other side or group
        self.written = [b"%d%c" % (i, c) for n, seps in ((len(self.bytes_a), b",|"), (size, b",;")) for c in seps for i in range(n)]

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids of a text by both and its bytes with the space; none where either doesn't give the text back."""
        none = np.zeros(0, dtype=np.int64)
        if not text:
            return none, none, 0
        spaced = " " + text
        a = self.plain.encode(spaced, add_special_tokens=False).ids if any(s in text for s in self.special) else self.encode_a(spaced)
        b = self.pieces.encode(text)
        raw = spaced.encode("utf-8", "surrogatepass")
        a = np.asarray(a, dtype=np.int64)
        if b"".join(map(self.bytes_a.__getitem__, a.tolist())) != raw or b"".join(map(self.bytes_b.__getitem__, b)) != raw:
            return none, none, 0
        return a, np.array(b, dtype=np.int64), len(raw)


def tokenizers(path_a: str | None = None, path_b: str | None = None) -> Both:
    """Both tokenizers; without paths those that the environment offers.  Tasks load their own: they don't survive pickling."""
    import public_tokenizers

    return Both(path_a or public_tokenizers.path(TOKENIZER_A), path_b or public_tokenizers.path(TOKENIZER_B))


def _marks(ends: np.ndarray, total: int) -> np.ndarray:
    """Whether a token ends at each of the offsets 0 .. total; ``ends`` is sorted."""
    out = np.zeros(total + 1, dtype=bool)
    for lo in range(0, total + 1, MARK_BYTES):
        hi = min(total + 1, lo + MARK_BYTES)
        i, j = np.searchsorted(ends, (lo, hi))
        out[lo:hi] = np.bincount(ends[i:j] - lo, minlength=hi - lo) > 0
    return out


class Aligned:
    """A block's alignment: counts by document, links in order (document, a, b as positions of tokens), groups as text."""

    def __init__(self, both: Both, texts: list[str | None]):
        parts = [both(t) for t in texts]
        a, b = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        until = np.cumsum([p[2] for p in parts])
        total = int(until[-1])
        end_a, end_b = np.cumsum(both.length_a[a]), np.cumsum(both.length_b[b])
        in_a, in_b = _marks(end_a, total), _marks(end_b, total)
        ends = np.flatnonzero(in_a | in_b)
        in_a, in_b = in_a[ends], in_b[ends]
        cut = in_a & in_b
        # prefix sums over the whole block, read at the documents' ends
        upto = np.searchsorted(ends, until, side="right")
        by_doc = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[upto], prepend=0)
        self.n_a, self.n_b, self.n_groups, self.n_links = (by_doc(x) for x in (in_a, in_b, cut, np.ones(len(ends), dtype=np.int64)))
        self.document = np.repeat(np.arange(len(texts)), self.n_links)
        at_a, at_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        self.pair = a[at_a] << B_BITS | b[at_b]
        # the written form: A ids of a group, then its B ids
        group = np.cumsum(cut) - cut
        group_a, group_b = group[in_a], group[in_b]
        n_groups = int(cut.sum())
        count_a, count_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
        last_a, last_b = cut[in_a], cut[in_b]
        code = np.empty(len(a) + len(b), dtype=np.int64)
        code[np.arange(len(a)) + (np.cumsum(count_b) - count_b)[group_a]] = a + last_a * len(both.bytes_a)
        code[np.arange(len(b)) + np.cumsum(count_a)[group_b]] = 2 * len(both.bytes_a) + b + last_b * len(both.bytes_b)
        self._code, self._written, self._at = code, both.written, np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])

    def groups(self, k: int) -> bytes:
        """`a1,a2|b1;a3|b2,b3` of document k."""
        return b"".join(map(self._written.__getitem__, self._code[self._at[k] : self._at[k + 1]].tolist()))[:-1]


COUNTS = ("n_a", "n_b", "n_groups", "n_links")
#: A block: its distinct pairs in order, the documents that hold each, and the rest as one value.  Numbers are little-endian int32.
BLOCKS = pa.schema([("block", pa.int64()), ("pairs", pa.binary()), ("holding", pa.binary()), ("rest", pa.binary())])
BLOCKS_DDL = "block long, pairs binary, holding binary, rest binary"
#: A block's rest, an Arrow stream of one row, so that rows of pairs need no columns for it: by document its id, counts, digest of groups and
#: number of distinct links; of these the number of the pair and how often it is linked; the pairs once more.
REST = pa.schema([("doc_id", pa.list_(pa.int64())), *[(c, pa.list_(pa.int64())) for c in COUNTS], ("groups_sha256", pa.list_(pa.string())), *[(c, pa.binary()) for c in ("pairs", "distinct", "at", "times")]])


def aligned_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Blocks of aligned documents (doc_id, text), stored; a text larger than a block is one of its own."""

    def block(both, number, ids, texts):
        x = Aligned(both, texts)
        held, times = np.unique(x.document << 31 | x.pair, return_counts=True)
        pairs, at, holding = np.unique(held & 0x7FFFFFFF, return_inverse=True, return_counts=True)
        distinct = np.bincount(held >> 31, minlength=len(ids))
        digest = [hashlib.sha256(x.groups(k)).hexdigest() if n else "" for k, n in enumerate(x.n_groups.tolist())]
        small = lambda v: [v.astype("<i4").tobytes()]
        batch = lambda schema, columns: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, REST) as w:
            w.write_batch(batch(REST, ([ids], *[[getattr(x, c)] for c in COUNTS], [digest], small(pairs), small(distinct), small(at), small(times))))
        return batch(BLOCKS, ([number], small(pairs), small(holding), [out.getvalue().to_pybytes()]))

    def run(batches):
        both, number = tokenizers(path_a, path_b), TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0
        for b in batches:
            for doc_id, text in common.rows(b, "doc_id", "text"):
                ids.append(doc_id)
                texts.append(text)
                size += len(text or "") + 64
                if size >= block_bytes:
                    yield block(both, number, ids, texts)
                    ids, texts, size, number = [], [], 0, number + 1
        if ids:
            yield block(both, number, ids, texts)

    return common.staged(docs.select("doc_id", "text").mapInArrow(run, BLOCKS_DDL), "aligned")


def _exploded(blocks: DataFrame) -> DataFrame:
    """(block, pair, holding): a row for each block and distinct pair of it."""

    def run(batches):
        for b in batches:
            for number, pairs, holding in common.rows(b, "block", "pairs", "holding"):
                pairs, holding = (np.frombuffer(x, dtype="<i4") for x in (pairs, holding))
                for lo in range(0, len(pairs), 1 << 16):
                    p = pairs[lo : lo + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), number)), pa.array(p), pa.array(holding[lo : lo + (1 << 16)])], names=["block", "pair", "holding"])

    return blocks.select("block", "pairs", "holding").mapInArrow(run, "block long, pair int, holding int")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(a, b, pair, n, best): documents that hold the linked ids, and whether no B id has more with this A id.

    Rows of an A id are as many as there are B ids at most, so the window is bounded by the vocabulary.
    """
    n = _exploded(blocks).groupBy("pair").agg(F.sum("holding").alias("n"))
    a = F.shiftright("pair", B_BITS)
    return n.select(a.alias("a"), F.col("pair").bitwiseAND((1 << B_BITS) - 1).alias("b"), "pair", "n", (F.col("n") == F.max("n").over(W.partitionBy(a))).alias("best"))


RESULTS = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in COUNTS], ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())])


def documents(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: a row for each row of the aligned documents.

    n_best: links whose pair is the most common of its A id, ties included; count_sum: sum of the links' counts.  Null and empty
    texts, and such that either tokenizer doesn't give back byte for byte, have zeros and an empty digest.
    """
    known = _exploded(blocks).select("block", "pair").join(counts.select("pair", (F.shiftleft("n", 1) + F.col("best").cast("long")).alias("value")), "pair")
    of_pairs = known.select("block", "pair", "value", F.lit(None).cast("binary").alias("rest"))
    whole = blocks.select("block", F.lit(None).cast("int").alias("pair"), F.lit(None).cast("long").alias("value"), "rest")

    def run(batches):
        held = []
        for b in batches:
            pair, value, rest = (b.column(k) for k in (1, 2, 3))
            start = 0
            for stop in [*np.flatnonzero(pair.is_null().to_numpy(zero_copy_only=False)).tolist(), len(pair)]:
                if stop > start:
                    held.append([c.slice(start, stop - start).to_numpy() for c in (pair, value)])
                if stop < len(pair):
                    yield result(rest[stop].as_buffer(), *((np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, dtype=np.int64),) * 2))
                    held = []
                start = stop + 1

    def result(rest, pair, value):
        row = pa.ipc.open_stream(rest).read_next_batch()
        pairs, distinct, at, times = (np.frombuffer(row.column(c)[0].as_buffer(), dtype="<i4").astype(np.int64) for c in ("pairs", "distinct", "at", "times"))
        if not np.array_equal(pair, pairs):
            raise ValueError("a block's pairs and their counts differ")
        upto = np.cumsum(distinct)
        by_doc = lambda v: pa.array(np.diff(np.concatenate([[0], np.cumsum(times * v[at])])[upto], prepend=0))
        of = lambda c: row.column(c).flatten()
        return pa.RecordBatch.from_arrays([of("doc_id"), *[of(c) for c in COUNTS], by_doc(value & 1), by_doc(value >> 1), of("groups_sha256")], schema=RESULTS)

    # a block's pairs in order, then its rest
    dealt = of_pairs.unionByName(whole).repartition("block").sortWithinPartitions("block", F.asc_nulls_last("pair"))
    return dealt.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in (*COUNTS, "n_best", "count_sum")) + ", groups_sha256 string")


def align(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``documents`` over rows (doc_id, text); rows that repeat a doc_id are documents of their own.  Each text is tokenised once."""
    blocks = aligned_blocks(docs, block_bytes)
    return documents(blocks, common.staged(pair_counts(blocks), "pair-counts"))


def op12_alignment(spark, sf_dir: str) -> DataFrame:
    """Every document's alignment and how common its links are."""
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
