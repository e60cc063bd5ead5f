"""The stages on the driver's small tables, each held against brute force on its own input."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
import corpus_pipeline as C
from tarnlight.llm import common, registry, toxicity

from .test_minhash import brute as components
from .test_packing import check as check_pieces
from .test_pii import brute as base_spans

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first, seen = docs, {}
    for name, stage in C.STAGES[:-1]:
        out = common.staged(stage(spark, docs, SF), name)
        assert out.columns == first.columns
        seen[name] = (docs.toPandas(), out.toPandas())
        docs = out
    before, after = seen["toxicity"]
    labels = pd.read_parquet(f"{SF}/labels.parquet")
    toxic = set(labels[labels.toxic == 1].doc_id)
    gone = set(before.doc_id) - set(after.doc_id)
    worded = {d for d, t in zip(before.doc_id, before.text, strict=True) if set(t.lower().replace(",", " ").replace(".", " ").split()) & set(toxicity.TERMS)}
    assert len(gone & worded) >= 0.9 * len(worded) and gone <= worded | toxic
    before, after = seen["near_dedup"]
    want = components(list(zip(before.doc_id, before.text, strict=True)), 5)
    assert sorted(after.doc_id) == sorted(d for d, (_, c) in want.items() if c == d)
    before, after = seen["decontamination"]
    items = [t for t in pd.read_parquet(f"{SF}/benchmark.parquet").text]
    leaked = {d for d, t in zip(before.doc_id, before.text, strict=True) if any(x in t for x in items)}
    assert leaked and not leaked & set(after.doc_id)
    before, after = seen["pii"]
    text = dict(zip(after.doc_id, after.text, strict=True))
    for d, t in zip(before.doc_id, before.text, strict=True):
        if not base_spans(t):
            assert text[d] == t or "<" in text[d]
        else:
            assert base_spans(text[d]) == ""
    assert (after.n_chars == after.text.str.len()).all()
    rows = list(zip(after.doc_id, after.text, strict=True))
    check_pieces([r.asDict() for r in C.STAGES[-1][1](spark, docs, SF).collect()], rows)


def test_registered(spark):
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = c.execute(registry.oracle_sql()[name]).df()
    got = registry.queries()[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    rows = lambda df: sorted(repr(tuple(None if pd.isna(v) else int(v) if isinstance(v, float) else v for v in r)) for r in df[cols].itertuples(index=False, name=None))
    assert rows(want) == rows(got)
