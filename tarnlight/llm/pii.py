"""Personal data by weak supervision, with DataFrame and SQL functions only.

Base spans follow fixed patterns (email, ip, card, phone) and always stay.  Looser patterns give further candidates.
Five labelers vote on every span: strict form, shape, gazetteer, cue words before it, and signs against it.  Votes
are counted by pattern in Spark; expectation-maximisation over these few counts (at most 3^5 a kind) estimates each
labeler's reliability without any labels, and a logistic regression on the resulting posteriors is the final
classifier, applied as a SQL expression.  Candidates that it accepts are added to the base spans.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Probability from which a candidate becomes a span, characters before a span that are searched for cues.
ACCEPT, CUE_CHARS = 0.8, 40
#: Characters of a chunk of a text, from which spans are cut out without counting from the text's start.
CHUNK = 2_048
_names = itertools.count()
KINDS = ["email", "ip", "card", "phone", "name", "ssn", "iban"]
LABELERS = ["strict", "shape", "gazetteer", "cue", "against"]
# The base patterns, in forms that can't backtrack over long runs but match the same spans.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?=(?:[0-9][\x20-]?){12}[0-9])[0-9]++(?:[\x20-][0-9]++)*+",  # shorter numbers can't pass any check
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# First names that a surname makes a candidate.
FIRST = "James|Mary|Robert|Patricia|John|Jennifer|Michael|Linda|David|Elizabeth|William|Barbara|Richard|Susan|Joseph|Jessica|Thomas|Sarah|Charles|Karen|Hans|Klaus|Pierre|Marie|Jean|José|María|Carlos"
# Patterns of further candidates.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[({<] ?(?:at|AT) ?[\])}>] ?[A-Za-z0-9-]++(?: ?[\[({<] ?(?:dot|DOT) ?[\])}>] ?[A-Za-z0-9-]++|\.[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+(])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])",
    "name": rf"(?<!\p{{L}})(?=[A-Z])(?:(?:Mr|Mrs|Ms|Dr|Prof)\.?|{FIRST}) \p{{Lu}}[\p{{L}}\p{{M}}]{{1,20}}(?![\p{{L}}\p{{M}}])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
# What a text must hold for a base pattern to be tried at all.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
CUES = {
    "email": "mail|contact|write|kontakt|correo|courriel", "ip": r"\bip\b|address|host|server|client|login", "card": "card|visa|master|credit|payment|karte|carte|tarjeta",
    "phone": "phone|call|tel|fax|mobile|cell|anruf|llama", "name": "name|by|from|dear|contact|signed", "ssn": "ssn|social|security", "iban": "iban|account|bank|konto|compte|cuenta",
}
AGAINST = r"(?:token|key|sha|hash|version|isbn|order|serial|commit|build|license|licensed|invoice|part)\W{0,4}$"
# Top-level domains, and calling codes (ITU E.164) that are common.
DOMAINS = "com|org|net|edu|gov|io|de|fr|es|uk|info|eu|it|nl|ch|at|us|ca|au|co|biz|mx|br|jp|cn|in|ru"
CALLING = r"^\+(?:1|7|20|27|3[0-69]|4[013-9]|5[1-8]|6[0-6]|81|82|84|86|9[0-58])"


def _new(prefix: str) -> str:
    """A lambda variable's name that no other has."""
    return f"{prefix}{next(_names)}"


def _text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


# Expressions are SQL texts: they are large, and Spark parses a text much faster than Python builds Columns.


def _let(value: str, body) -> str:
    """``body(name)`` with ``value`` computed once."""
    v = _new("v")
    return f"element_at(transform(array({value}), {v} -> {body(v)}), 1)"


def _map(items: str, body) -> str:
    x = _new("x")
    return f"transform({items}, {x} -> {body(x)})"


def _keep(items: str, test) -> str:
    x = _new("x")
    return f"filter({items}, {x} -> {test(x)})"


def _scanned(items: str, zero: str, step) -> str:
    """array<struct<before,item>>: each item with the state before it; step(state, item) is the state after it.

    Arrays can only grow by copying, so items go in blocks of about the cube root of their number, joined at the end.
    """

    def run(x):
        acc, e, s, i, g, own, y, k, done = (_new(n) for n in ("acc", "e", "s", "i", "g", "own", "y", "k", "done"))
        none = f"slice(array(named_struct('before', {zero}, 'item', get({x}, 0))), 1, 0)"
        size = f"cast(greatest(64, ceil(cbrt(2 * size({x})))) as int)"
        blocks = f"transform(sequence(0, cast(floor((size({x}) - 1) / {size}) as int)), {k} -> slice({x}, {k} * {size} + 1, {size}))"
        more = f"named_struct('at', aggregate({e}, {acc}.at, ({s}, {i}) -> {step(s, i)}), 'out', concat({acc}.out, array(named_struct('at', {acc}.at, 'block', {e}))))"
        begun = f"aggregate({blocks}, named_struct('at', {zero}, 'out', slice(array(named_struct('at', {zero}, 'block', {x})), 1, 0)), ({acc}, {e}) -> {more}, {done} -> {done}.out)"
        grow = f"named_struct('at', {step(own + '.at', y)}, 'out', concat({own}.out, array(named_struct('before', {own}.at, 'item', {y}))))"
        whole = f"transform({begun}, {g} -> aggregate({g}.block, named_struct('at', {g}.at, 'out', {none}), ({own}, {y}) -> {grow}, {done} -> {done}.out))"
        return f"if(size({x}) = 0, {none}, flatten({whole}))"

    return _let(items, run)


NO_SPANS = "cast(array() as array<struct<start:bigint,end:bigint,value:string>>)"


def _matches(text: str, pattern: str) -> str:
    """array<struct<start,end,value>> of all matches, in code points; extraction and split find the same matches."""

    def spans(found):
        pieces = f"cast(arrays_zip({found}, slice(split({text}, {_text(pattern)}), 1, size({found}))) as array<struct<found:string,between:string>>)"
        at = _scanned(pieces, "0L", lambda at, p: f"{at} + length({p}.between) + length({p}.found)")
        made = _map(at, lambda r: f"named_struct('start', {r}.before + length({r}.item.between), 'end', {r}.before + length({r}.item.between) + length({r}.item.found), 'value', {r}.item.found)")
        return f"if(size({found}) = 0, {NO_SPANS}, {made})"

    return _let(f"regexp_extract_all({text}, {_text(pattern)}, 0)", spans)


def _cut(begin: str, end: str) -> str:
    """The text from begin to end (exclusive), from its chunks."""
    first, last = f"cast(floor({begin} / {CHUNK}) as int)", f"cast(floor(({end} - 1) / {CHUNK}) as int)"
    some = f"array_join(slice(chunks, {first} + 1, {last} - {first} + 1), '')"
    return f"if({end} > {begin}, substring({some}, cast({begin} - {first} * {CHUNK} + 1 as int), cast({end} - {begin} as int)), '')"


def _digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def _luhn(digits: str) -> str:
    """Whether a string of digits passes the Luhn check."""
    total, k = _new("t"), _new("k")
    digit = f"cast(substring({digits}, length({digits}) - {k}, 1) as int)"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, ({total}, {k}) -> {total} + if({k} % 2 = 1, if({digit} > 4, 2 * {digit} - 9, 2 * {digit}), {digit})) % 10 = 0"


def _mod97(value: str) -> str:
    """Whether an IBAN's check digits are right: its first four characters moved to the end, letters as 10 to 35."""
    n, c = _new("n"), _new("c")
    plain = f"replace({value}, ' ', '')"
    add = f"({n} * if({c} >= 'A', 100, 10) + if({c} >= 'A', ascii({c}) - 55, ascii({c}) - 48)) % 97"
    return f"aggregate(split(concat(substring({plain}, 5), substring({plain}, 1, 4)), ''), 0, ({n}, {c}) -> {add}) = 1"


def _valid(kind: str, value: str) -> str:
    if kind == "email":
        return "true"
    if kind == "ip":
        p = _new("p")
        part = f"regexp_replace({p}, '^0+(?=[0-9])', '')"
        return f"forall(split({value}, '[.]'), {p} -> if(length({part}) <= 3, cast({part} as int) <= 255, false))"
    if kind == "card":
        return _let(_digits(value), lambda d: f"if(length({d}) between 14 and 19, {_luhn(d)}, false)")
    return f"length({_digits(value)}) between 10 and 15"


def _spans(kind: str, text: str, pattern: str, needs: str = "") -> str:
    has = f"contains({text}, '{needs}')"
    if kind in ("ip", "card", "phone", "ssn", "iban"):
        has += f" and {text} rlike '[0-9]'"
    elif kind == "email" and not needs:
        has = f"{text} rlike {_text(r'[\[({<] ?(?:at|AT) ?[\])}>]')}"
    elif kind == "name":
        has = f"{text} rlike {_text(f'(?=[A-Z])(?:Mr|Ms|Mrs|Dr|Prof|{FIRST})[. ]')}"  # as every match begins
    return f"if({has}, {_matches(text, pattern)}, {NO_SPANS})"


def _votes(kind: str, s: str, base: bool) -> str:
    """The five votes on a span: 1 for, 0 against, -1 none."""
    value = f"{s}.value"
    like = lambda pattern, yes=1, no=0: f"if({value} rlike {_text(pattern)}, {yes}, {no})"
    size = f"length({_digits(value)})"
    shape = gaz = "-1"
    if kind == "email":
        strict = "1" if base else "-1"
        shape = f"if(length({value}) <= 80, 1, 0)"
        gaz = f"if(lower({value}) rlike {_text(rf'(?:[.]|dot ?[\])}}>] ?)(?:{DOMAINS})$')}, 1, 0)"
    elif kind == "ip":
        strict = f"if({_valid('ip', value)}, 1, 0)"
        shape = like(r"(?:^|\.)0[0-9]", 0, 1)
        gaz = like(r"^(?:0|127|255)\.", 0, -1)
    elif kind == "card":
        strict = f"if({_valid('card', value)}, 1, 0)"
        shape = f"if({size} in (15, 16), 1, 0)"
        gaz = f"if({_digits(value)} rlike '^(?:4|5[1-5]|3[47]|6011|65|35|2[2-7])', 1, 0)"
    elif kind == "phone":
        strict = f"if({size} between 10 and 15, 1, -1)" if base else "-1"
        shape = like(r"[0-9][ ().-]+[0-9]")
        gaz = like(CALLING, 1, -1)
    elif kind == "name":
        strict = like(r"^(?:Mr|Mrs|Ms|Dr|Prof)", 1, -1)
        shape = like(r"\p{Ll}{3}$")
        gaz = like(r"^(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20", -1, 1)
    elif kind == "ssn":
        strict = like("^(?:000|666|9)|-00-|-0000$", 0, 1)
    else:
        strict = f"if({_mod97(value)}, 1, 0)"
        shape = f"if(length(replace({value}, ' ', '')) between 15 and 34, 1, 0)"

    def votes(before):
        cue = f"if({before} rlike {_text(CUES[kind])}, 1, -1)"
        against = f"if({before} rlike {_text(AGAINST)} or {before} rlike '[a-z0-9_]$', 0, -1)"
        return "named_struct(" + ", ".join(f"'{n}', {v}" for n, v in zip(LABELERS, (strict, shape, gaz, cue, against), strict=True)) + ")"

    begin = f"greatest({s}.start - {CUE_CHARS}, 0L)"
    return _let(f"lower({_cut(begin, f'{s}.start')})", votes)


def _kinded(kind: str, spans: str, base: bool) -> str:
    return _map(spans, lambda s: f"named_struct('start', {s}.start, 'k', {KINDS.index(kind)}, 'end', {s}.end, 'v', {_votes(kind, s, base)})")


def _apart(base: str, loose: str) -> str:
    """The spans of ``loose`` that overlap none of ``base``: no base span reaches over their start or begins before their end."""
    fields = lambda s: ", ".join(f"'{c}', {s}.{c}" for c in ("start", "k", "end", "v"))
    tagged = lambda spans, is_base: _map(spans, lambda s: f"named_struct({fields(s)}, 'base', {is_base})")
    both = f"array_sort(concat({tagged(base, 'true')}, {tagged(loose, 'false')}))"
    reach = _scanned(both, "0L", lambda at, s: f"if({s}.base, greatest({at}, {s}.end), {at})")
    left = _map(_keep(reach, lambda r: f"{r}.item.base or {r}.before <= {r}.item.start"), lambda r: f"{r}.item")
    ahead = _scanned(f"reverse({left})", f"{(1 << 63) - 1}L", lambda at, s: f"if({s}.base, least({at}, {s}.start), {at})")
    free = _keep(ahead, lambda r: f"not {r}.item.base and {r}.before >= {r}.item.end")
    return f"reverse({_map(free, lambda r: f'named_struct({fields(r + ".item")})')})"


def extract(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base`` and ``loose``: sorted array<struct<start,k,end,v>>; k numbers KINDS.  The text's ``chunks`` are there too.

    ``loose`` holds candidates that overlap no base span, card-like numbers that fail the checks among them.
    Null texts are taken as empty.  Extra columns named like the added ones must be renamed first.
    """
    text = "coalesce(text, '')"
    raw = {f"_{k}": _spans(k, text, p, NEEDS[k]) for k, p in BASE.items()} | {f"_loose_{k}": _spans(k, text, p) for k, p in LOOSE.items()}
    found = docs.selectExpr("*", *[f"{e} as {c}" for c, e in raw.items()])
    chunks = f"if({' + '.join(f'size({c})' for c in raw)} = 0, null, regexp_extract_all({text}, {_text(f'(?s).{{1,{CHUNK}}}')}, 0)) as chunks"
    base = ", ".join(_kinded(k, _keep(f"_{k}", lambda s, k=k: _valid(k, f"{s}.value")), True) for k in BASE)
    failed = _keep("_card", lambda s: f"length({_digits(f'{s}.value')}) between 13 and 19 and not {_valid('card', f'{s}.value')}")
    loose = ", ".join([_kinded("card", failed, False), *[_kinded(k, f"_loose_{k}", False) for k in LOOSE]])
    names = [f"`{c}`" for c in docs.columns]
    out = found.selectExpr("*", chunks).selectExpr(*names, "chunks", f"array_sort(concat({base})) as base", f"array_sort(concat({loose})) as _loose")
    return out.selectExpr(*names, "chunks", "base", f"if(size(_loose) = 0 or size(base) = 0, _loose, {_apart('base', '_loose')}) as loose")


class Model:
    """The classifier: by kind an intercept and, for each labeler, a weight for its yes and one for its no."""

    def __init__(self, weights: dict[int, list[float]]):
        self.weights = weights

    def probability(self, s: str) -> str:
        cases = ""
        for k, w in self.weights.items():
            z = f"{w[0]!r}D" + "".join(f" + case {s}.v.{name} when 1 then {w[1 + 2 * j]!r}D when 0 then {w[2 + 2 * j]!r}D else 0D end" for j, name in enumerate(LABELERS))
            cases += f" when {k} then 1 / (1 + exp(-({z})))"
        return f"case {s}.k{cases} else 0D end" if cases else "0D"


def fit(spans: DataFrame) -> Model:
    """EM and the classifier from ``spans``, exploded: k and v.  Only counts by vote pattern reach the driver."""
    got = spans.groupBy("k", *[F.col(f"v.{n}").alias(n) for n in LABELERS]).count().collect()  # at most 3^5 rows a kind
    weights = {}
    for k in sorted({r["k"] for r in got}):
        rows = sorted((tuple(r[n] for n in LABELERS), r["count"]) for r in got if r["k"] == k)
        weights[k] = regress(rows, posteriors(rows))
    return Model(weights)


def posteriors(rows: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> list[float]:
    """EM for two classes with independent labelers; the first guess is that each is right four times in five.

    A labeler's rates are smoothed towards that guess by ten spans, which also names the classes.
    """
    n = len(LABELERS)
    right, prior = [[0.2, 0.8] for _ in range(n)], 0.5  # P(vote yes | class), votes given
    post: list[float] = []
    for _ in range(rounds):
        post = []
        for votes, _c in rows:
            a, b = math.log(prior), math.log(1 - prior)
            for j, v in enumerate(votes):
                if v >= 0:
                    a += math.log(right[j][1] if v else 1 - right[j][1])
                    b += math.log(right[j][0] if v else 1 - right[j][0])
            post.append(1 / (1 + math.exp(max(-50.0, min(50.0, b - a)))))
        total = sum(c for _, c in rows)
        prior = min(0.99, max(0.01, (sum(p * c for p, (_, c) in zip(post, rows, strict=True)) + 1) / (total + 2)))
        for j in range(n):
            for cls, guess in ((0, 0.2), (1, 0.8)):
                w = [(p if cls else 1 - p) * c * (v[j] >= 0) for p, (v, c) in zip(post, rows, strict=True)]
                yes = sum(x for x, (v, _) in zip(w, rows, strict=True) if v[j] == 1)
                right[j][cls] = min(0.999, max(0.001, (yes + 10 * guess) / (sum(w) + 10)))
    return post


def regress(rows, post, rounds: int = 400, ridge: float = 0.5) -> list[float]:
    """Weighted logistic regression on vote indicators by gradient steps with per-weight curvature."""
    x = [[1.0] + [float(f) for v in votes for f in (v == 1, v == 0)] for votes, _ in rows]
    w = [0.0] * len(x[0])
    for _ in range(rounds):
        z = [sum(a * b for a, b in zip(r, w, strict=True)) for r in x]
        p = [1 / (1 + math.exp(max(-50.0, min(50.0, -v)))) for v in z]
        for j in range(len(w)):
            g = sum((t - q) * r[j] * c for t, q, r, (_, c) in zip(post, p, x, rows, strict=True)) - ridge * w[j]
            h = sum(0.25 * r[j] * c for r, (_, c) in zip(x, rows, strict=True)) + ridge
            w[j] += g / h / 3
    return w


def chosen(model: Model) -> Column:
    """All spans: base ones, and accepted candidates that don't overlap an earlier accepted one; sorted."""
    good = _keep("loose", lambda s: f"{model.probability(s)} >= {ACCEPT}D")
    ends = _scanned(good, "-1L", lambda end, s: f"if({s}.start >= {end}, {s}.end, {end})")
    kept = _map(_keep(ends, lambda r: f"{r}.item.start >= {r}.before"), lambda r: f"{r}.item")
    return F.expr(f"if(size(loose) = 0, base, array_sort(concat(base, {kept})))")


def _kind_of(s: str) -> str:
    return f"element_at(array({', '.join(map(_text, KINDS))}), {s}.k + 1)"


def joined(spans: str) -> Column:
    """kind:start:end by start, then kind; comma-joined."""
    return F.expr(f"concat_ws(',', {_map(spans, lambda s: f'concat_ws(\':\', {_kind_of(s)}, {s}.start, {s}.end)')})")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (sorted arrays of start, k, end, v) of every row of ``docs`` (doc_id, text).

    Null and empty texts have none; rows with null or repeated doc_id are searched like any other; nothing else is read.
    """
    table = common.staged(extract(docs.select("doc_id", "text")).select("doc_id", "base", "loose"), "pii")
    model = fit(table.select(F.explode(F.concat("base", "loose")).alias("s")).select("s.k", "s.v"))
    return table.select("doc_id", "base", chosen(model).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle brackets, other columns as they are.

    A null text stays null.  The model is fitted on the same documents.
    """
    names = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col("text"))
    # texts are written once more with their spans, so nothing is extracted twice
    table = common.staged(extract(row).drop("text"), "pii-redact")
    model = fit(table.select(F.explode(F.concat("base", "loose")).alias("s")).select("s.k", "s.v"))
    table = table.withColumn("spans", chosen(model))
    # base spans of different kinds may overlap: a span that starts inside what is already cut only extends the cut
    reach = _scanned("spans", "0L", lambda at, s: f"greatest({at}, {s}.end)")
    pieces = _map(reach, lambda r: f"if({r}.item.start >= {r}.before, concat({_cut(f'{r}.before', f'{r}.item.start')}, '<', {_kind_of(f'{r}.item')}, '>'), '')")
    rest = _let(f"array_max({_map('spans', lambda s: f'{s}.end')})", lambda end: _cut(end, "length(_row.text)"))
    new = f"if(size(spans) = 0, _row.text, concat(array_join({pieces}, ''), {rest}))"
    return table.selectExpr(*[f"{new if c == 'text' else f'_row.`{c}`'} as `{c}`" for c in names])


def op1_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and digest of the base spans, and all spans."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.expr(f"cast(size({_keep('base', lambda s, k=k: f'{s}.k = {KINDS.index(k)}')}) as bigint) as n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
