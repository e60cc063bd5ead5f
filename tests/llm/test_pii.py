import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from tarnlight.llm import pii as P

from .util import docs

# The contract's patterns.
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if valid(kind, m.group())]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))


CASES = [
    "", None, "mail a.b@c.de, x@y z@w.org.uk_c@d.e", "a@b.com_x@y.com a@b a@@b.c @x.y", "1.2.3.4.5 256.1.1.1 001.02.3.255 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111  1111",
    "+1 (136) 555-7479 +49 30 1234567. +1 2 +++1234567890", "🙂é a@b.co ß 10.0.0.1", "0" * 30_000, "1 " * 20_000 + "4111111111111111", "x" * 100_000, "+1" + "-" * 20_000, ("ab@cd.ef " * 2000), "1.1.1.1" * 50, "4111111111111111 4111111111111111",
]


def base_text(spark, rows):
    data = docs(spark, rows)
    return [(r["doc_id"], r["b"]) for r in P.extract(data.select("doc_id", "text")).select("doc_id", P.joined("base").alias("b")).collect()]


def test_base_spans_equal_the_patterns(spark):
    r = random.Random(0)
    noise = ["".join(r.choice("a@b.c1 2-+()4é_\n") for _ in range(r.randint(0, 60))) for _ in range(1500)]
    digits = ["".join(r.choice("0123456789 .-+") for _ in range(r.randint(0, 70))) for _ in range(1500)]
    rows = list(enumerate(CASES + noise + digits)) + [(None, "a@b.cd"), (2, CASES[2])]
    got = base_text(spark, rows)
    assert sorted(map(repr, got)) == sorted(repr((d, brute(t))) for d, t in rows)


def test_candidates_are_added_and_base_stays(spark):
    rows = [(k, f"please call +1 (212) 555-{1000 + k} or mail me{k}@site.com now") for k in range(80)]
    rows += [(200, "please call (212) 555-9999 today"), (201, "write to joe [at] site [dot] com"), (202, "token 4111111111111112"), (203, "nothing at all"), (204, None)]
    found = {r["doc_id"]: r["s"] for r in P.find(docs(spark, rows)).select("doc_id", P.joined("spans").alias("s")).collect()}
    assert len(found) == len(rows)
    assert all(set(filter(None, brute(t).split(","))) <= set(filter(None, found[d].split(","))) for d, t in rows)
    assert found[200] == "phone:12:26" and found[202] == found[203] == found[204] == ""


def test_redaction(spark):
    rows = [(1, "é a@b.co then 10.0.0.1."), (2, None), (3, "clean"), (4, "card 4111 1111 1111 1111 or +1 (212) 555-1234x")]
    data = docs(spark, rows)
    out = P.redact(data)
    assert out.schema.names == data.schema.names
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got[1] == "é <email> then <ip>." and got[2] is None and got[3] == "clean"
    assert got[4] == "card <card> or <phone>x"
    assert P.redact(data.limit(0)).count() == 0 and P.find(data.limit(0)).count() == 0


def test_em_finds_reliable_labelers():
    rows = [((1, 1, 1, 1, -1), 60), ((1, 1, 1, -1, -1), 50), ((0, 0, 0, -1, 0), 80), ((0, 1, 0, -1, 0), 40), ((1, 0, 1, 1, -1), 5)]
    post = P.posteriors(rows)
    assert min(post[0], post[1], post[4]) > 0.9 and max(post[2], post[3]) < 0.1
    w = P.regress(rows, post)
    assert w[1] > 0 > w[2]


def test_no_python_in_the_plan(spark):
    plan = P.find(docs(spark, [(1, "a@b.co")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_query_columns(spark):
    got = P.op1_pii(spark, "/root/testdata/sf0.001").toPandas()
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert all(h == hashlib.sha256(brute(text[d]).encode()).hexdigest() for d, h in zip(got.doc_id, got.base_sha256, strict=True))


def test_gates_lose_no_match(spark):
    texts = ["signed María Lopez, today", "Dr García", "Mrs. Muñoz and José Peña", "Prof. Łukasz", "Carlos Ruiz", "Drive On", "NoDr Who", "a [at] b [dot] c", "(212) 555-9999", "123-45-6789", "DE89 3704 0044 0532 0130 00", ""]
    data = docs(spark, list(enumerate(texts)))
    for kind, pattern in P.LOOSE.items():
        for r in data.select("text", F.expr(P._spans(kind, "text", pattern)).alias("gated"), F.expr(P._matches("text", pattern)).alias("all")).collect():
            assert r["gated"] == r["all"], (kind, r["text"])
    names = {r["text"]: [x["value"] for x in r["s"]] for r in data.select("text", F.expr(P._spans("name", "text", P.LOOSE["name"])).alias("s")).collect()}
    assert names["signed María Lopez, today"] == ["María Lopez"] and names["Dr García"] == ["Dr García"]
    assert names["Mrs. Muñoz and José Peña"] == ["Mrs. Muñoz", "José Peña"] and names["NoDr Who"] == []


def test_very_many_matches(spark):
    texts = ["12345 " * 200_000, "ab@cd.ef " * 200_000, "1.2.3.4 " * 200_000, "4111111111111111, " * 50_000, "Dr Miller +1 (212) 555-1234 a@b.co 10.0.0.1 " * 20_000]
    data = docs(spark, list(enumerate(texts)))
    path = P.common.staged(data, "many")
    began = time.monotonic()
    got = {r["doc_id"]: (r["b"], r["s"]) for r in P.find(path).select("doc_id", F.size("base").alias("b"), F.size("spans").alias("s")).collect()}
    assert got[0][0] == 0 and got[1][0] == got[2][0] == 200_000 and got[3][0] == 50_000 and got[4][0] == 60_000
    clean = {r["doc_id"]: r["text"] for r in P.redact(path).select("doc_id", "text").collect()}
    assert clean[1] == "<email> " * 200_000 and clean[2] == "<ip> " * 200_000 and clean[3] == "<card>, " * 50_000
    assert "<phone> <email> <ip>" in clean[4] and "@" not in clean[4]
    assert time.monotonic() - began < 180


def test_no_documents(spark):
    none = docs(spark, [(1, "x")]).limit(0)
    assert P.find(none).collect() == [] and P.redact(none).collect() == []
    assert P.redact(none).columns == none.columns
