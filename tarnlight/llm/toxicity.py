"""Toxicity: Levenshtein automata over a lexicon trie find abusive terms, also misspelled ones.

The lexicon is a short fixed list and the terms that mark toxic documents among the labelled rows.  Its trie is
intersected with the Levenshtein automata of the words met: a state is a set of (trie node, edits so far), built
when first reached and then remembered, so a word costs one table step a letter.  A window around every hit tells
quoted or reported use from abuse.  A logistic regression over the hits of a document gives its score.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled rows that lexicon and regression are fitted on at most (those of the smallest hash of doc_id).
MAX_TRAINING_ROWS = 20_000
#: A word becomes a term if it is in so many toxic training documents, so large a share of its documents is toxic, and
#: chance would give fewer than MAX_CHANCE such words among the sample's words of as many documents.
MIN_TOXIC_DOCS, MIN_SHARE, MAX_CHANCE = 3, 0.75, 0.5
#: Letters from which a term may be misspelled by one edit, and by two.
ONE_EDIT, TWO_EDITS = 5, 11
#: Words before a hit that are searched for a verb of reporting and a mark that is never closed.
WINDOW = 8
THRESHOLD = 0.7
#: The regression's weights without any labelled rows; labelled rows move them.
PRESET = [-3.0, 2.5, 1.0, 1.5, 0.5, 0.0, 0.0]
WORD_CACHE, STATES = 400_000, 40_000
# Abusive terms known without any labelled rows.
TERMS = ["clown", "disgusting", "idiot", "idiots", "imbecile", "loser", "losers", "moron", "morons", "pathetic", "scum", "stupid", "trash", "vermin", "worthless"]
# Verbs of reporting.
REPORTING = {"said", "says", "wrote", "called", "quoted", "quote", "reported", "term", "word", "insult", "slur", "dit", "sagte", "dijo"}
# Quotation marks and what closes them.
MARKS = {'"': '"', "“": "”", "„": "“”", "«": "»", "‘": "’"}
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”„«»‘’…¡¿"
FEATURES = 7


def edits_allowed(term: str) -> int:
    return 2 if len(term) >= TWO_EDITS else 1 if len(term) >= ONE_EDIT else 0


class Matcher:
    """The lexicon trie intersected with Levenshtein automata, determinised as words are met."""

    def __init__(self, terms: dict[str, float], harmless: set[str] = frozenset()):
        self.terms, self.harmless = terms, harmless
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[str | None] = [None]
        self.most = [0]  # edits allowed to any term below the node
        for term in sorted(terms):
            at, k = 0, edits_allowed(term)
            self.most[0] = max(self.most[0], k)
            for c in term:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                    self.most.append(0)
                at = self.children[at][c]
                self.most[at] = max(self.most[at], k)
            self.ends[at] = term
        self.words: dict[str, tuple[str, int] | None] = {}
        self._restart()

    def _restart(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.steps: list[dict[str, int]] = []
        self.found: list[tuple[str, int] | None] = []
        self.start = self._state({0: 0})

    def _state(self, edits: dict[int, int]) -> int:
        """The number of the state {node: fewest edits}, closed under leaving out letters of the term; -1 if empty."""
        heap = list(edits.items())
        while heap:
            node, e = heap.pop()
            if edits.get(node) != e:
                continue
            for child in self.children[node].values():
                if e < self.most[child] and edits.get(child, 9) > e + 1:
                    edits[child] = e + 1
                    heap.append((child, e + 1))
        key = tuple(sorted(edits.items()))
        if not key:
            return -1
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            best = min(((e, t) for node, e in key if (t := self.ends[node]) is not None and e <= edits_allowed(t)), default=None)
            self.found.append((best[1], best[0]) if best else None)
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        new: dict[int, int] = {}
        for node, e in self.sets[state]:
            if e < self.most[node] and new.get(node, 9) > e + 1:
                new[node] = e + 1  # an extra letter in the word
            for letter, child in self.children[node].items():
                k = e + (letter != c)
                if k <= self.most[child] and new.get(child, 9) > k:
                    new[child] = k
        to = self.steps[state][c] = self._state(new)
        return to

    def match(self, word: str) -> tuple[str, int] | None:
        """(term, edits) of the nearest term within its allowed edits, or None."""
        try:
            return self.words[word]
        except KeyError:
            pass
        if len(self.words) >= WORD_CACHE:
            self.words.clear()
        if len(self.sets) >= STATES:
            self._restart()
        state = self.start
        for c in word:
            state = to if (to := self.steps[state].get(c)) is not None else self._step(state, c)
            if state < 0:
                break
        hit = self.found[state] if state >= 0 else None
        if hit and hit[1] and word in self.harmless:
            hit = None
        self.words[word] = hit
        return hit


def clean_words(text: str | None) -> tuple[list[str], list[str]]:
    """White-space words, and the same lower-cased with marks at their edges taken off."""
    raw = (text or "").split()
    return raw, [w.strip(EDGES) for w in (text or "").lower().split()]


def quotations(raw: list[str]) -> tuple[list[tuple[int, int]], list[int]]:
    """Closed quotations (first and last word), in one pass over the text, and the words with marks that nothing closes.

    A mark at the front of a word opens a quotation if none is open; its partner at the end of a word closes it, at the next such word.
    A mark whose partner ends no later word opens none, so quotations behind it count all the same.
    """
    tails = [w.rstrip(".,;:!?)]}") for w in raw]
    last = {t[-1]: i for i, t in enumerate(tails) if t}
    spans, lost, opened, closing = [], [], -1, ""
    for i, (w, tail) in enumerate(zip(raw, tails, strict=True)):
        head = w.lstrip("([{")
        if opened < 0 and head and head[0] in MARKS:
            closing = MARKS[head[0]]
            if len(tail) > 1 and tail[-1] in closing:
                spans.append((i, i))
            elif any(last.get(c, -1) > i for c in closing):
                opened = i
            else:
                lost.append(i)
        elif opened >= 0 and tail and tail[-1] in closing:
            spans.append((opened, i))
            opened = -1
    return spans, lost


def quoted(words: list[str], i: int, spans: list[tuple[int, int]], lost: list[int]) -> bool:
    """Whether the word at i stands in a quotation, or closely after a verb of reporting and a mark that is never closed."""
    at = bisect.bisect_right(spans, (i, len(words))) - 1
    if at >= 0 and i <= spans[at][1]:
        return True
    lo = max(0, i - WINDOW)
    at = bisect.bisect_right(lost, i) - 1
    return at >= 0 and lost[at] >= lo and any(w in REPORTING for w in words[lo:i])


def features(text: str | None, matcher: Matcher) -> tuple[list[float], list[tuple[str, str, int, bool]]]:
    """The regression's inputs and the hits (word, term, edits, quoted) of a whole text; zeros for null or empty."""
    raw, words = clean_words(text)
    match = matcher.match
    found = [(i, w, m) for i, w in enumerate(words) if w and (m := match(w))]
    marks = quotations(raw) if found else ([], [])
    # lower case can change where white space is in a few scripts; then no word is known to be quoted
    hits = [(w, m[0], m[1], len(raw) == len(words) and quoted(words, i, *marks)) for i, w, m in found]
    abuse = [h for h in hits if not h[3]]
    exact = [h[1] for h in abuse if not h[2]]
    weights = [matcher.terms[t] for t in exact]
    return [
        1.0,
        math.log1p(len(exact)),
        max(weights, default=0.0),
        math.log1p(len(set(exact))),
        math.log1p(sum(1 for h in abuse if h[2])),
        math.log1p(sum(1 for h in hits if h[3])),
        math.sqrt(len(exact) / len(words)) if words else 0.0,
    ], hits


class Model:
    def __init__(self, terms: dict[str, float], harmless: set[str], weights: list[float]):
        self.terms, self.harmless, self.weights = terms, harmless, weights


def _word_counts(batches):
    """(toxic, fold, text) rows -> documents by word and fold: toxic ones and all."""
    counts: dict[tuple[str, int], list[int]] = {}
    for b in batches:
        for toxic, fold, text in common.rows(b, "toxic", "fold", "text"):
            for w in set(clean_words(text)[1]):
                c = counts.setdefault((w, fold), [0, 0])
                c[0] += toxic
                c[1] += 1
        if len(counts) > 500_000:
            yield _counted(counts)
            counts = {}
    if counts:
        yield _counted(counts)


def _counted(counts):
    return pa.RecordBatch.from_pydict({"word": [w for w, _ in counts], "fold": [f for _, f in counts], "toxic": [c[0] for c in counts.values()], "docs": [c[1] for c in counts.values()]}, schema=pa.schema([("word", pa.string()), ("fold", pa.int32()), ("toxic", pa.int64()), ("docs", pa.int64())]))


def _terms(counts: DataFrame, rate: float) -> dict[str, float]:
    """Terms and their log-odds from counts (word, toxic, docs), words of the sample.

    ``rate`` is the share of toxic documents.  A word of n documents, t of them toxic, comes up by chance with probability
    below C(n, t) rate^t, and C(n, t) is below (e n / (n - t))^(n - t).
    """
    if not 0 < rate < 1:
        return dict.fromkeys(TERMS, 2.0)
    clean = F.col("docs") - F.col("toxic")
    ways = F.when(clean > 0, clean * (1 + F.log(F.col("docs") / clean))).otherwise(0.0)
    telling = F.col("toxic") * -math.log(rate) - ways >= F.log(F.col("words") / MAX_CHANCE)
    alike = counts.groupBy("docs").agg(F.count("*").alias("words"))  # at most a row for each row of the sample
    good = counts.join(F.broadcast(alike), "docs").where((F.col("toxic") >= MIN_TOXIC_DOCS) & (F.col("toxic") >= MIN_SHARE * F.col("docs")) & (F.length("word") >= 3) & telling)
    learned = {w: math.log((t + 0.5) / (n - t + 0.5)) for w, t, n in good.select("word", "toxic", "docs").collect()}
    return dict.fromkeys(TERMS, 2.0) | dict(sorted(learned.items()))


def _harmless(counts: DataFrame, terms: dict[str, float]) -> set[str]:
    """Words close to a term that clean documents use: these are words of their own, not misspellings."""

    def near(batches):
        m = Matcher(terms)
        for b in batches:
            got = [(w, n) for w, n in common.rows(b, "word", "clean") if w and (hit := m.match(w)) and hit[1]]
            yield pa.RecordBatch.from_pydict({"word": [w for w, _ in got], "clean": [n for _, n in got]}, schema=pa.schema([("word", pa.string()), ("clean", pa.int64())]))

    clean = counts.where("docs - toxic >= 2 and toxic < 0.5 * docs").selectExpr("word", "docs - toxic as clean")
    found = clean.mapInArrow(near, "word string, clean long")
    return {w for (w,) in found.select("word").collect()}


def regress(x: np.ndarray, y: np.ndarray, preset: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Logistic regression with a ridge towards the preset weights (a weak one for the first input).

    Newton's method on a convex loss; a step is halved until the loss falls, so it can't run away.
    """
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 0.05 * ridge

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + (w - preset) @ penalty @ (w - preset) / 2)

    w = preset.astype(float)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ (w - preset))
        now = loss(w)
        while loss(w + step) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> Model:
    """Fit on the texts of the labelled rows: labels has doc_id and toxic (0 or 1; null rows are left out).

    Repeated labels of a document count once, as the largest.  At most ``max_rows`` documents are used.  The regression
    is fitted on the half of them whose words didn't make the lexicon it is fitted with; the lexicon then comes from both.
    Without labelled rows, the fixed terms and preset weights hold; few rows move them little.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)).cast("int"))
    path = common.staged_path(spark, "toxicity-sample")
    sample = common.staged(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id"), "toxicity-sample", path)  # at most max_rows rows are sent
    counts = common.staged(sample.mapInArrow(_word_counts, "word string, fold int, toxic long, docs long").groupBy("word", "fold").agg(F.sum("toxic").alias("toxic"), F.sum("docs").alias("docs")), "toxicity-words", path + "-words")
    total = counts.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("docs").alias("docs"))
    first = counts.where("fold = 0")
    rate = sample.agg(F.coalesce(F.avg("toxic"), F.lit(0.0))).first()[0]
    half = _terms(first, rate)
    trial = Matcher(half, _harmless(first, half))

    def inputs(batches):
        for b in batches:
            got = [(float(t), *features(x, trial)[0]) for t, x in common.rows(b, "toxic", "text")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in (zip(*got, strict=True) if got else [[]] * (FEATURES + 1))], names=["y", *(f"x{i}" for i in range(FEATURES))])

    got = sample.where("fold = 1").mapInArrow(inputs, "y double, " + ", ".join(f"x{i} double" for i in range(FEATURES))).toPandas().sort_values(["y", *(f"x{i}" for i in range(FEATURES))]).to_numpy()
    weights = regress(got[:, 1:], got[:, 0], np.array(PRESET))
    terms = _terms(total, rate)
    model = Model(terms, _harmless(total, terms), [float(w) for w in weights])
    common.drop_staged(spark, path)
    common.drop_staged(spark, path + "-words")
    return model


HIT = "array<struct<word:string,term:string,edits:int,quoted:boolean>>"


def score(docs: DataFrame, model: Model, clean: bool = False) -> DataFrame:
    """doc_id, score, predicted and hits of every row; with ``clean`` the rows of ``docs`` not predicted toxic, as they are.

    Null and empty texts have no hits and get the score of the intercept alone.  Rows with null or repeated doc_id are
    scored like any other; other columns are not read.
    """
    sent = common.sent(docs.sparkSession, model)  # words of the sample of MAX_TRAINING_ROWS rows at most
    hit = pa.list_(pa.struct([("word", pa.string()), ("term", pa.string()), ("edits", pa.int32()), ("quoted", pa.bool_())]))

    def run(batches):
        m = sent()
        matcher, w = Matcher(m.terms, m.harmless), m.weights
        for b in batches:
            scores, found = [], []
            for (text,) in common.rows(b, "text"):
                x, hits = features(text, matcher)
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, sum(p * q for p, q in zip(w, x, strict=True)))))))
                found.append([dict(zip(("word", "term", "edits", "quoted"), h, strict=True)) for h in hits])
            predicted = pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())
            if clean:
                yield b.filter(pa.array([s < THRESHOLD for s in scores], pa.bool_()))
            else:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), predicted, pa.array(found, hit)], names=["doc_id", "score", "predicted", "hits"])

    if clean:
        return docs.mapInArrow(run, docs.schema)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, score double, predicted int, hits {HIT}")


def held_out():
    """The rows that are never learned from: crc32(doc_id as text) mod 3 is 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned from labels of rows that aren't held out."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score(docs, fit(docs, labels.where(~held_out())))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")
