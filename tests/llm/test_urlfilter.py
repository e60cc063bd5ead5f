import random

import numpy as np
import pyarrow as pa  # noqa: F401
from pyspark.sql import functions as F

from tarnlight.llm import urlfilter as U

from .util import by_id


def brute(url, rules=U.RULES, listed=U.LISTED):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] + [len(path)])]
    under = lambda h: host == h or host.endswith("." + h)
    fit = [(len(r), r, v) for v, r in rules if under(r[: r.index("/")]) and path.startswith(r[r.index("/") :])]
    if fit:
        return host, path, max(fit)[1], max(fit)[2]
    return host, path, None, "block" if host and any(under(h) for h in listed) else "allow"


URLS = [None, "", "no scheme", "://", "http://", "http://com", "http://COM/", "https://a.Example.com/en/x?y#z", "http://www.example.com/en/", "http://x.www.example.com/en/a/b", "http://example.com/EN/", "http://net/es/", "http://a.net/fr", "http://a.net/fr/?q=://b", "http://casino-win.example.org", "http://m.casino-win.example.org?x", "http://notcasino-win.example.org/", "http://a..b./x", "http://h/\nq", "http://ÄÖ.com/é", "x://y://z/w", "http://" + "a." * 3000 + "net/es/"]


def pages(spark, urls):
    return spark.createDataFrame([(k, u, "h", "r") for k, u in urls], "page_id long, url string, host string, rule string")


def check(got, urls):
    assert sorted(map(repr, ((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got))) == sorted(repr((k, *brute(u))) for k, u in urls)


def test_verdicts_equal_brute_force(spark):
    r = random.Random(0)
    made = [f"http://{'.'.join(r.choice(['a', 'www', 'example', 'ads-track', 'org', 'net', 'com']) for _ in range(r.randint(1, 4)))}{r.choice(['', '/', '/en/', '/es/x', '/fr/', '/en'])}" for _ in range(1500)]
    urls = list(enumerate(URLS + made)) + [(None, made[0]), (3, URLS[3])]
    check(U.judge(pages(spark, urls)).collect(), urls)
    assert U.judge(pages(spark, urls).limit(0)).count() == 0


def test_lists_too_large_for_filters_are_joined(spark, monkeypatch):
    monkeypatch.setattr(U, "MAX_BITS", 1)
    urls = list(enumerate(URLS))
    check(U.judge(pages(spark, urls)).collect(), urls)


def test_lists_as_tables(spark, monkeypatch):
    monkeypatch.setattr(U, "PAGE_WORDS", 2)
    r = random.Random(1)
    rules = [(r.choice(["allow", "block"]), f"h{k}.com/{r.choice(['', 'a/', 'b/c/'])}") for k in range(40)]
    listed = [f"x{k}.org" for k in range(500)]
    urls = list(enumerate(URLS + [f"http://{r.choice(['', 'www.'])}h{r.randrange(50)}.com/{r.choice(['', 'a/', 'b/c/d'])}" for _ in range(300)] + [f"http://m.x{r.randrange(800)}.org/" for _ in range(400)]))
    tables = spark.createDataFrame(rules + rules[:3], "verdict string, rule string"), spark.createDataFrame([(h,) for h in [*listed, listed[0], None]], "host string")
    got = U.judge(pages(spark, urls), *tables).collect()
    assert sorted(map(repr, ((x["page_id"], x["host"], x["path"], x["rule"], x["verdict"]) for x in got))) == sorted(repr((k, *brute(u, rules, listed))) for k, u in urls)
    none = U.judge(pages(spark, urls), tables[0].limit(0), tables[1].limit(0)).collect()
    assert len(none) == len(urls) and {x["verdict"] for x in none} == {"allow"}


def test_cascade_is_exact_over_its_universe(spark):
    rng = np.random.default_rng(0)
    keys = rng.integers(-(1 << 62), 1 << 62, 6000)
    listed = rng.random(6000) < 0.3
    df = spark.createDataFrame([(int(k), bool(x)) for k, x in zip(keys, listed, strict=True)], "h long, listed boolean")
    cascade = U.build(df)
    assert len(cascade.levels) > 2
    assert (cascade.has(keys.view(np.uint64)) == listed).all()
    assert not U.build(df.where(~F.col("listed"))).has(keys.view(np.uint64)).any()


def test_by_id_helper(spark):
    assert by_id(pages(spark, [(1, "u")]), "page_id")[1]["url"] == "u"


def test_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string, host string")
    assert U.judge(none).collect() == []
    assert [r["verdict"] for r in U.judge(spark.createDataFrame([(1, None)], "page_id long, url string")).collect()] == ["allow"]


def test_jobs_do_not_grow_with_shuffle_partitions(spark, monkeypatch):
    kind = type(pages(spark, []))
    monkeypatch.setattr(kind, "repartition", lambda self, n, *cols, f=kind.repartition: f(self, max(40, n) if cols else n, *cols))
    jobs = lambda: max([-1, *spark.sparkContext.statusTracker().getJobIdsForGroup()])
    universe = spark.range(300).selectExpr("xxhash64(id) as h", "id % 3 = 0 as listed")
    before = jobs()
    cascade = U.build(universe)
    assert len(cascade.levels) > 1
    assert jobs() - before < 12 * len(cascade.levels)
