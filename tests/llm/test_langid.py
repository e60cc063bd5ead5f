import itertools
import random

import numpy as np

from tarnlight.llm import langid as L

from .util import by_id, docs

WORDS = {"en": "the of and thing with over under rather".split(), "de": "der die und nicht über straße wegen".split(), "ru": "и не на что это как".split()}


def texts(seed=0, n=60):
    r = random.Random(seed)
    return [(k, " ".join(r.choice(WORDS[lang]) for _ in range(12)), lang) for k, lang in enumerate(itertools.islice(itertools.cycle(WORDS), n))]


def test_viterbi_matches_all_paths():
    rng = np.random.default_rng(0)
    for _ in range(300):
        s = rng.normal(size=(rng.integers(1, 7), 3)) * rng.choice([0.3, 2, 6])
        value = lambda p: sum(s[i, k] for i, k in enumerate(p)) - 2.0 * sum(a != b for a, b in itertools.pairwise(p))  # noqa: B023
        best = max(value(p) for p in itertools.product(range(3), repeat=len(s)))
        assert abs(value(L.viterbi(s, 2.0).tolist()) - best) < 1e-9


def test_languages_spans_and_odd_texts(spark):
    rows = texts()
    mixed = "the thing with the of and over under " * 3 + "der die und nicht über straße wegen " * 8
    odd = [(100, None, "en"), (101, "", "en"), (102, "12 34 !!", "de"), (103, mixed, None), (None, "и не на", None), (104, "the " * 20_000, None), (5, rows[5][1], "en"), (105, "что это", None)]
    model = L.fit(docs(spark, rows))
    assert model.languages == ["de", "en", "ru"]
    out = L.identify(docs(spark, rows + odd), model)
    assert out.count() == len(rows) + len(odd)
    got = by_id(out)
    assert all(got[k]["lang_pred"] == lang for k, _, lang in rows)
    for k in (100, 101, 102):
        assert (got[k]["lang_pred"], got[k]["score"], got[k]["spans"]) == ("und", 0.0, [])
    assert [s["lang"] for s in got[103]["spans"]] == ["en", "de"] and got[103]["lang_pred"] == "de"
    assert [(s["first"], s["last"]) for s in got[103]["spans"]] == [(0, 24), (24, 80)]
    assert got[None]["lang_pred"] == "ru" and got[104]["lang_pred"] == "en" and got[105]["lang_pred"] == "ru"


def test_nothing_to_learn_from(spark):
    model = L.fit(docs(spark, [(1, "the", None), (2, None, "en")]))
    assert by_id(L.identify(docs(spark, [(1, "the of")]), model))[1]["lang_pred"] == "und"
    assert L.identify(docs(spark, []), model).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = L.op7_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.98


def test_query_by_brute_force(spark):
    """Words scored one by one from the model's table, and every path of short texts tried, against the whole query."""
    sf = "/root/testdata/sf0.001"
    data = spark.read.parquet(f"{sf}/documents.parquet")
    rows = data.collect()
    model = L.fit(data.where("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2"))
    got = by_id(L.op7_language_id(spark, sf))
    k = len(model.languages)
    tried = 0
    for r in rows:
        words = (r["text"] or "").lower().split()
        letters = ["".join(c for c in w if c.isalpha()) for w in words]
        s = np.zeros((len(words), k))
        for i, w in enumerate(letters):
            if not w:
                continue
            buckets = L.trigram_buckets([w])[0]
            s[i] = sum(model.table[b] for b in buckets)
            some = model.by_script.get(L.script_of(w))
            if some is not None and len(some) < k:
                s[i, [j for j in range(k) if j not in some]] = s[i].min() - L.SWITCH_PENALTY
        mine = got[r["doc_id"]]
        if not any(letters):
            assert mine["lang_pred"] == "und" and mine["score"] == 0
            continue
        # the best path by a table over all words, from its definition
        v, back = s[0].copy(), []
        for row in s[1:]:
            step = v[None] - L.SWITCH_PENALTY * (1 - np.eye(k))
            back.append(step.argmax(1))
            v = step.max(1) + row
        path = [int(v.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        by = np.zeros(k)
        for p, w in zip(reversed(path), letters, strict=True):
            by[p] += len(w)
        if np.sort(by)[-1] > np.sort(by)[-2] * 1.01:
            assert mine["lang_pred"] == model.languages[int(by.argmax())], r["doc_id"]
            tried += 1
        assert 0 < mine["score"] <= 1
    assert tried > 100
    assert sum(g["score"] == 1.0 for g in got.values()) < 0.05 * len(got)
