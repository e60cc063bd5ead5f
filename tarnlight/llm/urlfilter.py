"""URL filters by a Bloom filter cascade.

The corpus's complete key universe is every candidate key of its URLs: each domain suffix of a host, alone and with
the path prefixes that rules use.  A cascade's first level encodes the listed keys of the universe, the next the
keys that pass it wrongly, and so on in turn until no level is wrong: membership is then exact for every key of
the corpus, and the decision needs only the levels' bits, no join.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

# Rules (verdict, host and path), and hosts that the method's own list blocks.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
LISTED = ["free-bets.example.net", "free-bets.example.org", "spam-farm.example.org", "casino-win.example.org", "ads-track.example.org", "spam-farm.example.net", "casino-win.example.net", "ads-track.example.net"]
#: Bits that one level may have to be broadcast; a cascade with a larger one is replaced by a join on its keys.
MAX_BITS = 1 << 30
MAX_LEVELS = 64
#: 64-bit words in a page of a level's bits.
PAGE_WORDS = 1 << 14
#: Pages that one task lays out and the driver takes at once.
PART_PAGES = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both are empty where it is null or has no '://'."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


class Level:
    """One Bloom filter: ``size`` bits, ``probes`` positions a key."""

    def __init__(self, bits: np.ndarray, size: int, probes: int, seed: int):
        self.bits, self.size, self.probes, self.seed = bits, size, probes, seed

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), dtype=bool)
        for at in positions(hashes, self.size, self.probes, self.seed):
            found &= (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0
        return found


def positions(hashes: np.ndarray, size: int, probes: int, seed: int):
    h = common.mix(hashes + np.uint64(seed * 0x9E3779B97F4A7C15 & common.M64))
    step = common.mix(h ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
    for i in range(probes):
        yield (h + np.uint64(i) * step) % np.uint64(size)


class Cascade:
    """Levels in order; a key is listed if the first level that lacks it is an even one (counted from 1), or by the last."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), len(self.levels) % 2 == 1)
        open_ = np.arange(len(hashes))
        for i, level in enumerate(self.levels):
            passed = level.has(hashes[open_])
            out[open_[~passed]] = i % 2 == 1
            open_ = open_[passed]
        return out


def _bits(df: DataFrame, size: int, probes: int, seed: int) -> np.ndarray:
    """The level's bits from rows (h): words of bits are shuffled by page and laid into dense pages, which the driver joins."""

    def run(batches):
        for b in batches:
            h = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in positions(h, size, probes, seed):
                w, inverse = np.unique(at >> np.uint64(6), return_inverse=True)
                v = np.zeros(len(w), dtype=np.uint64)
                np.bitwise_or.at(v, inverse, np.uint64(1) << (at & np.uint64(63)))
                w = w.astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(w // PAGE_WORDS), pa.array(w % PAGE_WORDS), pa.array(v.view(np.int64))], names=["page", "w", "bits"])

    def pages(batches):
        page, held = None, None
        for b in batches:
            number, w, bits = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            cuts = np.flatnonzero(np.diff(number)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(number)], strict=True):
                if lo == hi:
                    continue
                if number[lo] != page:
                    if held is not None:
                        yield _page(page, held)
                    page, held = int(number[lo]), np.zeros(PAGE_WORDS, dtype=np.int64)
                np.bitwise_or.at(held, w[lo:hi], bits[lo:hi])
        if held is not None:
            yield _page(page, held)

    def _page(number, held):
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([held.tobytes()], pa.binary())], names=["page", "bits"])

    words = df.select("h").mapInArrow(run, "page long, w long, bits long")
    # the driver takes a partition at a time, each with a job of its own: as few as hold PART_PAGES pages, however many shuffles have
    count = size // 64 // PAGE_WORDS + 1
    parts = max(1, min(256, -(-count // PART_PAGES)))
    out = np.zeros((-(-size // 64) // PAGE_WORDS + 1) * PAGE_WORDS, dtype=np.uint64)
    for page, bits in words.repartition(parts, "page").coalesce(parts).sortWithinPartitions("page").mapInArrow(pages, "page long, bits binary").toLocalIterator():  # size bits in all
        out[page * PAGE_WORDS : (page + 1) * PAGE_WORDS] = np.frombuffer(bits, dtype=np.uint64)
    return out[: -(-size // 64)]


def build(universe: DataFrame) -> Cascade | None:
    """A cascade over ``universe`` (h: distinct key hashes, listed: boolean); None if a level would pass MAX_BITS."""
    spark = universe.sparkSession
    sent = universe.groupBy("listed").count().collect()
    inside = sum(r["count"] for r in sent if r["listed"])
    outside = sum(r["count"] for r in sent if not r["listed"])
    levels: list[Level] = []
    if not inside:
        return Cascade([Level(np.zeros(1, dtype=np.uint64), 64, 1, 0)])
    # of the keys still undecided, the next level encodes those of one side against those of the other
    for number in range(MAX_LEVELS):
        mine, other = (inside, outside) if number % 2 == 0 else (outside, inside)
        if number and not mine:
            return Cascade(levels)
        rate = min(0.5, max(1e-9, mine * math.sqrt(0.5) / max(1, other))) if number == 0 else 0.5
        size = max(64, math.ceil(mine * math.log(1 / rate) / math.log(2) ** 2))
        if size > MAX_BITS:
            return None
        probes = max(1, round(math.log(1 / rate) / math.log(2)))
        before = list(levels)
        side = number % 2 == 0
        keys = universe.where(F.col("listed") == side)
        levels.append(Level(_bits(_passing(keys, before), size, probes, number + 1), size, probes, number + 1))
        left = _passing(universe.where(F.col("listed") != side), levels).count()
        if side:
            outside = left
        else:
            inside = left
    raise RuntimeError("the cascade doesn't end: two keys share a hash")


def _passing(keys: DataFrame, levels: list[Level]) -> DataFrame:
    if not levels:
        return keys.select("h")
    sent = common.sent(keys.sparkSession, levels)  # bounded: MAX_BITS a level

    def run(batches):
        levels = sent()
        for b in batches:
            h = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            ok = np.ones(len(h), dtype=bool)
            for level in levels:
                ok &= level.has(h)
            yield b.filter(pa.array(ok))

    return keys.select("h").mapInArrow(run, "h long")


def suffixes(host: Column, most: int) -> Column:
    """A host and its parent domains, longest first, of at most ``most`` labels: no key of the lists has more."""
    labels = F.split(host, r"\.")
    first = F.greatest(F.lit(1), F.size(labels) - most + 1)
    return F.when((host == "") | F.lit(most < 1), F.expr("cast(array() as array<string>)")).otherwise(F.transform(F.sequence(first, F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))


def judge(pages: DataFrame, rules=RULES, listed=LISTED) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages`` (page_id, url; nothing else is read).

    The longest fitting rule decides; without one a URL is blocked if its host or a parent domain is listed, else
    allowed.  Null urls and urls without '://' have empty host and path, no rule, and are allowed.  Repeated and null
    page_ids are judged row by row.  ``rules`` are (verdict, rule) pairs or a table of these columns, ``listed`` hosts or a table
    (host); tables may be of any size, and neither they nor their keys pass through the driver.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "verdict string, rule string")
    if not isinstance(listed, DataFrame):
        listed = spark.createDataFrame([(h,) for h in listed], "host string")
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    slash = F.instr("rule", "/")
    lengths = sorted((r[0] for r in rules.select((F.length("rule") - slash + 1).alias("n")).where("n is not null").distinct().collect()), reverse=True)  # a row for each length of a path
    labels = lambda h: F.max(F.size(F.split(h, r"\.")))
    most = max(rules.agg(labels(F.substring("rule", F.lit(1), slash - 1))).first()[0] or 0, listed.agg(labels(F.col("host"))).first()[0] or 0)
    # candidate keys, each (kind and key): rule keys are suffix and path prefix, list keys the suffix
    named = urls.withColumn("suffix", suffixes(F.col("host"), most))
    no_prefix = F.expr("cast(array() as array<string>)")
    prefixes = no_prefix if not lengths else F.filter(F.array(*[F.when(F.length("path") >= n, F.substring(F.col("path"), 1, n)) for n in lengths]), lambda p: p.isNotNull())
    rule_keys = F.flatten(F.transform("suffix", lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    named = named.withColumn("rule_keys", rule_keys)
    hashed = lambda kind: lambda k: F.xxhash64(F.lit(kind), k)
    distinct = named.select("host", F.substring("path", 1, max([0, *lengths])).alias("path"), "suffix", "rule_keys").distinct()
    distinct = common.staged(distinct, "url-keys")
    verdicts = {}
    for name, keys, kind, column in (("allow", rules.where("verdict = 'allow'").select("rule"), "rule", "rule_keys"), ("block", rules.where("verdict = 'block'").select("rule"), "rule", "rule_keys"), ("listed", listed.select("host"), "host", "suffix")):
        universe = distinct.select(F.explode(column).alias("key")).distinct().select(hashed(kind)(F.col("key")).alias("h"))
        on_list = keys.toDF("key").where("key is not null").distinct().select(hashed(kind)(F.col("key")).alias("h"), F.lit(1).alias("on"))
        # which keys of the universe are listed is counted, not joined: 2 is in the universe only, 3 in both
        marked = universe.select("h", F.lit(2).alias("on")).unionByName(on_list).groupBy("h").agg(F.sum("on").alias("on")).where("on >= 2")
        marked = common.staged(marked.select("h", (F.col("on") == 3).alias("listed")), f"url-{name}")
        verdicts[name] = build(marked), marked
    if any(c is None for c, _ in verdicts.values()):
        return _by_join(named, verdicts, hashed)
    sent = common.sent(spark, {k: c for k, (c, _) in verdicts.items()})  # bounded by MAX_BITS

    def run(batches):
        cascades = sent()

        def which(lists: pa.ListArray, *names: str) -> list[pa.Array]:
            flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            return [cascades[n].has(flat) for n in names]

        for b in batches:
            col = lambda n: b.column(b.schema.get_field_index(n))  # noqa: B023, E731
            allow, block = which(col("rule_h"), "allow", "block")
            (bad,) = which(col("suffix_h"), "listed")
            rule, verdict, at, to = [], [], 0, 0
            for keys, hosts in zip(col("rule_keys").to_pylist(), col("suffix_h").to_pylist(), strict=True):
                fit = [(len(k), k, allow[at + i]) for i, k in enumerate(keys) if allow[at + i] or block[at + i]]
                best = max(fit, default=None)
                rule.append(best and best[1])
                verdict.append(("allow" if best[2] else "block") if best else "block" if bad[to : to + len(hosts)].any() else "allow")
                at, to = at + len(keys), to + len(hosts)
            yield pa.RecordBatch.from_arrays([col("page_id"), col("host"), col("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    keyed = named.select("page_id", "host", "path", "rule_keys", F.transform("rule_keys", hashed("rule")).alias("rule_h"), F.transform("suffix", hashed("host")).alias("suffix_h"))
    return keyed.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


def _by_join(named: DataFrame, verdicts: dict, hashed) -> DataFrame:
    """The same for lists too large to broadcast: distinct (host, path prefix) keys joined with the marked keys."""
    urls = named.withColumn("row", F.monotonically_increasing_id())
    lists = [m.where("listed").select("h", F.lit(n).alias("list")) for n, (_, m) in verdicts.items()]
    marked = lists[0].unionByName(lists[1]).unionByName(lists[2])
    keys = urls.select("row", F.explode(F.concat(F.transform("rule_keys", lambda k: F.struct(hashed("rule")(k).alias("h"), k.alias("key"))), F.transform("suffix", lambda k: F.struct(hashed("host")(k).alias("h"), k.alias("key"))))).alias("k")).select("row", "k.*")
    hit = keys.join(marked, "h").groupBy("row").agg(F.max(F.when(F.col("list") != "listed", F.struct(F.length("key").alias("n"), "key", "list"))).alias("r"), F.max(F.col("list") == "listed").alias("bad"))
    out = urls.join(hit, "row", "left")
    return out.select("page_id", "host", "path", F.col("r.key").alias("rule"), F.coalesce("r.list", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"))


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _suffix_test(host: str) -> str:
    return f"(host = '{host}' or ends_with(host, '.{host}'))"


def op6_sql(rules=RULES, listed=LISTED) -> str:
    """DuckDB SQL for op6_url_filter."""
    ranked = sorted(rules, key=lambda r: -len(r[1]))
    when = "".join(f" when {_suffix_test(r[: r.index('/')])} and starts_with(path, '{r[r.index('/') :]}') then '{r}'" for _, r in ranked)
    verdict = "".join(f" when rule = '{r}' then '{v}'" for v, r in ranked)
    bad = " or ".join(_suffix_test(h) for h in listed)
    return f"""
with a as (select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
b as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw from a),
c as (select page_id, translate(raw, '{UPPER}', '{LOWER}') as host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from b),
d as (select *, case{when} end as rule from c)
select page_id, host, path, rule, case{verdict} when {bad} then 'block' else 'allow' end as verdict from d"""
