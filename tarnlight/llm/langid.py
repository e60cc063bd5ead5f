"""Language identification with spans: script ranges, per-word scores and a Viterbi pass.

Every word is scored for each language by a naive Bayes model over hashed character trigrams.  The scripts of a
word's letters narrow its candidate languages to those that use the script in the training texts.  Viterbi over the
words, with a penalty for each change of language, labels spans; the document's language is the one that covers
the most letters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Buckets of the hashed trigram table; the table has this many rows for each language, whatever the corpus.
BUCKETS = 1 << 16
#: Log-probability lost at each change of language within a text.
SWITCH_PENALTY = 12.0
#: Labelled rows that the model is fitted on at most (those of the smallest hash of doc_id).
MAX_TRAINING_ROWS = 20_000
#: Words whose scores a worker remembers at once.
SCORE_CACHE = 400_000
# First and last code points of scripts, by Unicode blocks.
SCRIPTS = [
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF),
    ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF), ("thai", 0xE00, 0xE7F),
    ("georgian", 0x10A0, 0x10FF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
]


def script_of(word: str) -> str:
    """The script of a word's first letter that lies in a known range, or '' for none."""
    for c in word:
        if c.isalpha():
            p = ord(c)
            for name, lo, hi in SCRIPTS:
                if lo <= p <= hi:
                    return name
    return ""


def _letters(word: str) -> str:
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


def trigram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the trigrams of lower-case words with their borders marked, and where each word's begin."""
    code = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    h = common.mix((code[:-2] << np.uint64(42)) | (code[1:-1] << np.uint64(21)) | code[2:]) % np.uint64(BUCKETS)
    ends = np.cumsum(np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words)))
    inside = np.ones(len(code), dtype=bool)  # windows that cross from one word into the next don't count
    inside[ends - 1] = inside[ends - 2] = False
    sizes = np.diff(ends, prepend=0) - 2
    return h[inside[: len(h)]].astype(np.int64), np.cumsum(sizes) - sizes


def _chunks(batches, *names: str, size: int = 2_000_000):
    """Rows of the named columns in lists of about ``size`` characters of the last column, at least one row each."""
    held, chars = [], 0
    for b in batches:
        for row in common.rows(b, *names):
            held.append(row)
            chars += len(row[-1] or "")
            if chars >= size:
                yield held
                held, chars = [], 0
    if held:
        yield held


def _count_batches(batches):
    """(lang, text) rows -> counts by (lang, bucket); bucket -1 - k counts words of script k."""
    from collections import Counter

    names = sorted({s[0] for s in SCRIPTS})
    counts: dict[str, np.ndarray] = {}
    for held in _chunks(batches, "lang", "text"):
        words: dict[str, Counter] = {}
        for lang, text in held:
            words.setdefault(lang, Counter()).update((text or "").lower().split())
        for lang, c in words.items():
            n = counts.setdefault(lang, np.zeros(BUCKETS + len(names), dtype=np.int64))
            got = [(w, k) for word, k in c.items() if (w := _letters(word))]
            if not got:
                continue
            buckets, starts = trigram_buckets([w for w, _ in got])
            k = np.array([k for _, k in got])
            n[:BUCKETS] += np.bincount(buckets, weights=np.repeat(k, np.diff(starts, append=len(buckets))), minlength=BUCKETS).astype(np.int64)
            for w, k in got:
                if s := script_of(w):
                    n[BUCKETS + names.index(s)] += k
    for lang, n in counts.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "bucket": np.where(at < BUCKETS, at, BUCKETS - 1 - at), "n": n[at]}, schema=pa.schema([("lang", pa.string()), ("bucket", pa.int64()), ("n", pa.int64())]))


class Model:
    """Log-probabilities by hashed trigram and language, and the languages of each script."""

    def __init__(self, languages: list[str], table: np.ndarray, by_script: dict[str, list[int]]):
        self.languages, self.table, self.by_script = languages, table, by_script


def fit(labelled: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> Model:
    """Fit on (doc_id, text, lang) rows with a label; ``max_rows`` of the smallest hash of doc_id bound the sample.

    Counts are summed in Spark by language and hash bucket, so at most BUCKETS rows a language reach the driver; the model
    has half a megabyte for each language of the sample.
    Without any labelled row the model has no language and every text is ``und``.
    """
    named = labelled.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    ids = named.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    sample = named.join(F.broadcast(ids.distinct()), "doc_id", "left_semi").select("lang", "text")  # at most max_rows ids
    counts = sample.mapInArrow(_count_batches, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counts.toPandas()
    languages = sorted(set(got.lang))
    at = {x: i for i, x in enumerate(languages)}
    names = sorted({s[0] for s in SCRIPTS})
    n = np.zeros((BUCKETS, len(languages)))
    by_script: dict[str, list[int]] = {}
    words = got[got.bucket < 0]
    for lang, bucket, count in zip(words.lang, words.bucket, words.n, strict=True):
        if count >= 0.001 * words[words.lang == lang].n.sum():
            by_script.setdefault(names[-1 - bucket], []).append(at[lang])
    grams = got[got.bucket >= 0]
    n[grams.bucket.to_numpy(), grams.lang.map(at).to_numpy(dtype=int)] = grams.n.to_numpy()
    table = np.log(n + 0.2) - np.log((n + 0.2).sum(axis=0))
    return Model(languages, (table - table.mean(axis=1, keepdims=True)) if languages else table, by_script)


class _Scores(dict):
    """lower-case word -> index of its row in ``matrix``; row 0 is a word without letters."""

    def __init__(self, model: Model):
        self.model, self.k = model, len(model.languages)
        self.matrix, self.size = np.zeros((1, max(1, self.k))), np.zeros(1)

    def learn(self, words: set[str]) -> None:
        """Score the words that aren't known yet, all at once; forget the others when there are too many."""
        if len(self) > SCORE_CACHE:
            self.clear()
            self.matrix, self.size = self.matrix[:1], self.size[:1]
        new, letters = [], []
        for word in words - self.keys():
            if w := _letters(word):
                new.append(word)
                letters.append(w)
            else:
                self[word] = 0
        if not new or not self.k:
            return
        buckets, starts = trigram_buckets(letters)
        s = np.add.reduceat(self.model.table[buckets], starts, axis=0)
        narrow = {x: out for x, some in self.model.by_script.items() if len(out := np.setdiff1d(np.arange(self.k), some))}
        if narrow:
            for i, w in enumerate(letters):
                if (out := narrow.get(script_of(w))) is not None:
                    s[i, out] = s[i].min() - SWITCH_PENALTY
        self.update(zip(new, range(len(self.matrix), len(self.matrix) + len(new)), strict=True))
        self.matrix, self.size = np.vstack([self.matrix, s]), np.concatenate([self.size, [len(w) for w in letters]])


def viterbi(s: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """The best language of each word for scores s (words x languages), each change costing ``penalty``.

    One language throughout is returned at once where no stretch of words gains over half the penalty by leaving
    it: a path with q changes leaves it in at most q + 1 <= 2q stretches, so it can't then win.
    """
    n, k = s.shape
    best = int(s.sum(axis=0).argmax())
    gain = np.cumsum(s.max(axis=1) - s[:, best])
    # a stretch may mix all the other languages; a bound by one of them at a time is tighter
    d = np.cumsum(s - s[:, best : best + 1], axis=0)
    if k == 1 or gain[-1] <= penalty / 2 or (d - np.minimum.accumulate(np.vstack([np.zeros(k), d[:-1]]), axis=0)).max() <= penalty / 2:
        return np.full(n, best)
    back, v = [], [0.0] * k
    for row in s.tolist():
        m = max(v)
        j = v.index(m)
        m -= penalty
        back.append([j if m > x else i for i, x in enumerate(v)])
        v = [(m if m > x else x) + y for x, y in zip(v, row, strict=True)]
    path, at = [0] * n, v.index(max(v))
    for i in range(n - 1, -1, -1):
        path[i] = at
        at = back[i][at]
    return np.array(path)


def label_words(words: list[str], scores: _Scores) -> tuple[str, float, list[tuple[str, int, int]]]:
    """(language, score, spans) of known words; a span is (language, first word, end word)."""
    ids = np.array([scores[w] for w in words], dtype=np.int64) if scores.k else np.zeros(0, dtype=np.int64)
    sizes = scores.size[ids]
    if not sizes.any():
        return "und", 0.0, []
    path = viterbi(scores.matrix[ids])
    by = np.bincount(path, weights=sizes, minlength=scores.k)
    best = int(by.argmax())
    cuts = np.flatnonzero(np.diff(path)) + 1
    spans = [(scores.model.languages[path[a]], int(a), int(b)) for a, b in zip([0, *cuts], [*cuts, len(path)], strict=True)]
    return scores.model.languages[best], float(by[best] / by.sum()) * _certainty(scores.matrix[ids[path == best]], best), spans


def _certainty(s: np.ndarray, best: int) -> float:
    """Logistic of the mean log-odds a word of the best language against the next; 1 if there is no other."""
    if s.shape[1] < 2:
        return 1.0
    mean = s.sum(axis=0) / max(1, int(s.any(axis=1).sum()))
    margin = mean[best] - np.delete(mean, best).max()
    return float(1 / (1 + np.exp(-np.clip(margin, -30, 30))))


SPAN = "array<struct<lang:string,first:long,last:long>>"


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and spans of every row of ``docs`` (doc_id, text; other columns are not read).

    Null, empty and letterless texts are ``und`` with score 0 and no spans.  Rows with a null or repeated doc_id are
    labelled like any other.  ``score`` is the share of letters that the predicted language covers, times how clearly
    its words are that language's: the logistic of their mean log-odds against the next language.
    """
    sent = common.sent(docs.sparkSession, model)  # bounded: BUCKETS numbers for each language of the sample
    spans = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("spans", spans)])

    def run(batches):
        scores = _Scores(sent())
        for held in _chunks(batches, "doc_id", "text"):
            texts = [(t or "").lower().split() for _, t in held]
            scores.learn(set().union(*texts))
            lang, score, found = zip(*(label_words(x, scores) for x in texts), strict=True)
            d = [d for d, _ in held]
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(lang), pa.array(score), pa.array([[{"lang": x, "first": y, "last": z} for x, y, z in s] for s in found], spans)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, lang_pred string, score double, spans {SPAN}")


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every document, learned from rows whose crc32(doc_id as text) mod 4 is not 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = fit(docs.where(part != 2))
    out = identify(docs, model).select("doc_id", "lang_pred", "score")
    return out.select("doc_id", F.coalesce(part == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
