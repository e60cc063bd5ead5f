"""Helpers that several operators share: shared-folder tables, word hashing, batch iteration."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ..operators.storage import drop as drop_staged
from ..operators.storage import new_path as staged_path
from ..operators.storage import sent
from ..operators.storage import stored as staged

__all__ = ["drop_staged", "sent", "staged", "staged_path"]
M64 = (1 << 64) - 1
#: Words whose hashes a worker remembers at once; beyond it the memory is cleared and filled anew.
WORD_CACHE = 400_000


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift-xor-multiply), elementwise."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, remembered for the words seen of late."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def split_words(text: str | None) -> list[bytes]:
    """Lower-case A-Z and split at space, tab, line feed, vertical tab, form feed and carriage return."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(text: str | None, cache: WordHashes) -> np.ndarray:
    return np.array([cache[w] for w in split_words(text)], dtype=np.uint64)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word windows, in order; a shorter sequence gives one hash of the whole, an empty one none."""
    if len(words) == 0:
        return words
    n = min(n, len(words))
    h = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - n + 1 + i])
    return h


def shingle_set(text: str | None, n: int, cache: WordHashes) -> np.ndarray:
    """The sorted distinct n-word shingles of a text as 64-bit hashes."""
    return np.unique(gram_hashes(word_hashes(text, cache), n))


def rows(batch: pa.RecordBatch, *names: str):
    """The named columns of an Arrow batch as Python lists, zipped."""
    return zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True)
