import random

import numpy as np
import pytest

from tarnlight.llm import toxicity as T

from .util import by_id, docs


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_matcher_equals_edit_distance():
    r = random.Random(3)
    terms = {"".join(r.choice("abc") for _ in range(r.randint(2, 12))): 1.0 for _ in range(25)}
    m = T.Matcher(terms)
    words = ["".join(r.choice("abcd") for _ in range(r.randint(1, 13))) for _ in range(3000)] + list(terms) + [t[1:] for t in terms] + [t + "d" for t in terms]
    hits = 0
    for w in words:
        best = min(((d, t) for t in terms if (d := distance(w, t)) <= T.edits_allowed(t)), default=None)
        assert m.match(w) == (best and (best[1], best[0])), w
        hits += best is not None
    assert hits > 50


def test_matcher_starts_over_when_full(monkeypatch):
    monkeypatch.setattr(T, "STATES", 5)
    monkeypatch.setattr(T, "WORD_CACHE", 5)
    m = T.Matcher({"idiot": 1.0, "moron": 1.0})
    assert [m.match(w) for w in ("idiot", "idjot", "hello", "moron", "moro", "xx", "idiots", "idiot")] == [("idiot", 0), ("idiot", 1), None, ("moron", 0), ("moron", 1), None, ("idiot", 1), ("idiot", 0)]


def test_quotation_is_not_abuse():
    m = T.Matcher({"idiot": 2.0}, {"idio"})
    flags = lambda text: [(h[0], h[3]) for h in T.features(text, m)[1]]
    assert flags("You are an idiot, he knew") == [("idiot", False)]
    assert flags('she said "you idiot" and left') == [("idiot", True)]
    assert flags("the word “idiot” is old") == [("idiot", True)]
    assert flags("An IDIOT!! and id1ot idio") == [("idiot", False), ("id1ot", False)]
    assert T.features(None, m) == T.features("", m)


def corpus(n=400):
    r = random.Random(1)
    clean = [f"w{k}" for k in range(80)] + ["oron"]
    rows, labels = [], []
    for k in range(n):
        words = [r.choice(clean) for _ in range(30)]
        if k % 4 == 0:
            for _ in range(3):
                words[r.randrange(30)] = r.choice(["moron", "grumfle", "idiot"])
        rows.append((k, " ".join(words)))
        labels.append((k, int(k % 4 == 0)))
    return rows, labels


def test_learned_terms_scores_and_odd_rows(spark):
    rows, labels = corpus()
    marks = spark.createDataFrame(labels + [(0, 0), (None, 1), (3, None), (9999, 1)], "doc_id long, toxic int")
    data = docs(spark, rows)
    model = T.fit(data, marks)
    assert "grumfle" in model.terms and "oron" in model.harmless
    odd = [(1000, None), (1001, ""), (1002, "you grumfel are a grumfl"), (1003, "w1 " * 30_000 + "oron"), (None, "grumfle " * 3), (1, rows[1][1])]
    out = T.score(docs(spark, rows + odd), model)
    assert out.count() == len(rows) + len(odd)
    got = by_id(out)
    assert all(got[k]["predicted"] == t for k, t in labels)
    assert got[1000]["score"] == got[1001]["score"] < 0.5 and got[1003]["predicted"] == 0 and got[None]["predicted"] == 1
    assert [h["term"] for h in got[1002]["hits"]] == ["grumfle"]
    kept = T.score(docs(spark, rows + odd), model, clean=True)
    assert kept.columns == data.columns and kept.count() == sum(1 - t for _, t in labels) + 5 - (got[1002]["predicted"] == 1)
    assert T.score(data.limit(0), model).count() == 0


def test_no_labels(spark):
    model = T.fit(docs(spark, [(1, "a")]), spark.createDataFrame([], "doc_id long, toxic int"))
    got = by_id(T.score(docs(spark, [(1, "you worthless idiot moron"), (2, "a fine day")]), model))
    assert got[1]["predicted"] == 1 and got[2]["predicted"] == 0


def test_regression_separates():
    x = np.array([[1.0, v] for v in (-2, -1, 1, 2)])
    w = T.regress(x, np.array([0.0, 0, 1, 1]), np.zeros(2))
    assert w[1] > 0
    # many rows that plain Newton steps overshoot on
    r = np.random.default_rng(0)
    n = 20_000
    toxic = r.random(n) < 0.1
    hits = np.where(toxic, r.poisson(6, n), 0).astype(float)
    x = np.column_stack([np.ones(n), np.log1p(hits), (hits > 0) * 4.0, np.log1p(hits), np.zeros(n), np.zeros(n), hits / 30])
    w = T.regress(x, toxic.astype(float), np.array(T.PRESET))
    p = 1 / (1 + np.exp(-(x @ w)))
    assert np.abs(p.mean() - toxic.mean()) < 0.005 and (p[hits > 0] > 0.7).all() and (p[hits == 0] < 0.05).all()


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.1"
    got = T.op10_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    hit = got[got.predicted == 1]
    assert (hit.toxic == 1).mean() > 0.97 and (got[got.toxic == 1].predicted == 1).mean() > 0.85


def test_quotations_are_opened_and_closed():
    m = T.Matcher({"idiot": 2.0})
    flags = lambda text: [h[3] for h in T.features(text, m)[1]]
    assert flags('"good morning" she said. You are an idiot') == [False]
    assert flags('after "good day" you idiot wrote "so long"') == [False]
    assert flags("he said “" + "word " * 30 + "idiot " + "word " * 30 + "end” and idiot") == [True, False]
    assert flags('she wrote "you idiot and never closed it') == [True]
    assert flags('"you idiot and never closed it') == [False]
    assert flags('("idiot"), «idiot», „idiot“ ‘idiot’ idiot') == [True, True, True, True, False]
    assert flags('it was 5" wide and "idiot" was said') == [True]


def brute_features(text, terms, harmless):
    """The inputs from the definitions: edit distances by table, quotations by a loop over all pairs of marks."""
    words = [w.strip(T.EDGES) for w in (text or "").lower().split()]
    hits = []
    for i, w in enumerate(words):
        best = min(((d, t) for t in terms if w and (d := distance(w, t)) <= T.edits_allowed(t)), default=None)
        if best and not (best[0] and w in harmless):
            hits.append((i, best[1], best[0]))
    return words, hits


def test_scores_of_the_query_by_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    data, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = T.fit(data, labels.where(~T.held_out()))
    got = {r["doc_id"]: r for r in T.score(data, model).collect()}
    query = {r["doc_id"]: r for r in T.op10_toxicity(spark, sf).collect()}
    few = sorted(data.collect(), key=lambda r: len(r["text"] or ""))[:120]
    for r in few:
        words, hits = brute_features(r["text"], model.terms, model.harmless)
        mine = got[r["doc_id"]]
        assert [(words[i], t, e) for i, t, e in hits] == [(h["word"], h["term"], h["edits"]) for h in mine["hits"]]
        abuse = [t for (i, t, e), h in zip(hits, mine["hits"], strict=True) if not h["quoted"] and not e]
        near = sum(1 for (i, t, e), h in zip(hits, mine["hits"], strict=True) if not h["quoted"] and e)
        x = [1.0, np.log1p(len(abuse)), max((model.terms[t] for t in abuse), default=0.0), np.log1p(len(set(abuse))), np.log1p(near), np.log1p(sum(h["quoted"] for h in mine["hits"])), (len(abuse) / max(1, len(words))) ** 0.5]
        want = 1 / (1 + np.exp(-float(np.dot(x, model.weights))))
        assert abs(want - mine["score"]) < 1e-9 and abs(query[r["doc_id"]]["score"] - want) < 1e-6
        assert query[r["doc_id"]]["predicted"] == int(query[r["doc_id"]]["score"] >= 0.7)


def naive_quotations(raw):
    """As the text says it: look for the partner of each mark, word by word."""
    spans, lost, i = [], [], 0
    while i < len(raw):
        head = raw[i].lstrip("([{")
        if head and head[0] in T.MARKS:
            ends = [j for j in range(i, len(raw)) if (t := raw[j].rstrip(".,;:!?)]}")) and t[-1] in T.MARKS[head[0]] and (j > i or len(t) > 1)]
            if ends:
                spans.append((i, ends[0]))
                i = ends[0]
            else:
                lost.append(i)
        i += 1
    return spans, lost


def test_quotations_equal_a_search_for_each_mark():
    rng = random.Random(4)
    marks = [*T.MARKS, *{c for v in T.MARKS.values() for c in v}]
    for _ in range(400):
        raw = [rng.choice(["", "(", *marks]) + rng.choice(["a", "bc", ""]) + rng.choice(["", ".", ")", *marks, *marks]) for _ in range(rng.randrange(1, 25))]
        raw = [w for w in raw if w]
        assert T.quotations(raw) == naive_quotations(raw)


@pytest.mark.parametrize("word", ['"word', "\u201ea", "\u2018tis", "\u00abmot"])
def test_marks_that_never_close(word):
    import time

    began = time.time()
    spans, lost = T.quotations([word] * 200_000)
    assert not spans and len(lost) == 200_000 and time.time() - began < 10


def test_no_documents_and_no_labels(spark):
    some = docs(spark, [(k, f"plain words {k}") for k in range(12)])
    none, labels = some.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = T.fit(some, labels)
    assert T.score(none, model).collect() == [] and T.score(none, model, clean=True).collect() == []
    assert T.fit(none, labels) is not None and len(T.score(some, model).collect()) == 12
