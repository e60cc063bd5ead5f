"""DuckDB SQL for the core queries, written from the definitions and independent of the Spark plans."""

from __future__ import annotations

from ..functions.bases import BASES, CODES
from ..operators.plots import STEPS

ALPHABET = "ACGTMRWSYKVHDBN-"
# bit k of a code: it may stand for base k; unknown characters stand for all
_MASK = "case c " + " ".join(f"when '{c}' then {sum(1 << BASES.index(b) for b in s)}" for c, s in CODES.items()) + " else 15 end"
_MSA = f"""
chars as (select vec_id as id, k, substr('{ALPHABET}', 1 + cast(floor(abs(cast(embedding[k] as double)) * 100) as bigint) % 16, 1) as c from embeddings, range(1, 65) r(k)),
masks as (select id, k, {_MASK} as m from chars)"""
_PLANES = f"""{_MSA},
planes as (select id, {", ".join(f"sum(case when (m >> {b}) & 1 = 1 then cast(1 as hugeint) << cast(64 - k as int) else 0 end)::ubigint as p{b}" for b in range(4))} from masks group by id),
snp as (select a.id as i, b.id as j, 64 - bit_count((a.p0 & b.p0) | (a.p1 & b.p1) | (a.p2 & b.p2) | (a.p3 & b.p3)) as snp from planes a, planes b)"""
_JACCARD = """
cells as (select distinct l_suppkey as id, l_partkey as f from lineitem),
n as (select s_suppkey as id, count(f) as n from supplier left join cells on s_suppkey = id group by s_suppkey),
shared as (select a.id as i, b.id as j, count(*) as c from cells a join cells b using (f) where a.id <> b.id group by 1, 2),
jac as (select a.id as i, b.id as j, case when a.n = 0 and b.n = 0 then 0.0 else 1 - coalesce(c, 0) / cast(a.n + b.n - coalesce(c, 0) as double) end as d
        from n a join n b on a.id <> b.id left join shared s on s.i = a.id and s.j = b.id)"""
_KNN = """
vecs as (select vec_id as id, cast(embedding as double[]) as v from embeddings),
cosines as (select a.id as i, b.id as j, 1 - list_cosine_similarity(a.v, b.v) as d from vecs a join vecs b on a.id <> b.id),
knn as (select i, j, d from (select *, row_number() over (partition by i order by d, j) as r from cosines) where r <= 15)"""
_P = f"""{_KNN},
beta(i, lo, hi, b, done, step) as (
  select distinct i, cast(null as double), cast(null as double), cast(1 as double), false, 0 from knn
  union all
  select i, case when not stop and off > 0 then b else lo end, case when not stop and off <= 0 then b else hi end,
         case when stop then b when off > 0 then (case when hi is null then b * 2 else (b + hi) / 2 end) else (case when lo is null then b / 2 else (b + lo) / 2 end) end,
         stop, step + 1
  from (select *, abs(off) <= 1e-5 as stop from (
          select t.i, any_value(lo) as lo, any_value(hi) as hi, any_value(b) as b, any_value(step) as step,
                 ln(sum(exp(-d * b))) + any_value(b) * sum(d * exp(-d * b)) / sum(exp(-d * b)) - ln(5.0) as off
          from beta t join knn e on e.i = t.i where not done and step < 99 group by t.i))),
last as (select i, arg_max(b, step) as b from beta group by i),
raw as (select i, j, d, exp(-d * b) as e from knn join last using (i)),
p as (select i, j, d, e / sum(e) over (partition by i) as p from raw)"""
_POINTS = "pts as (select vec_id as id, cast(embedding[1] as double) as x, cast(embedding[2] as double) as y from embeddings)"
_FRAMES = """
fr as (select vec_id % 50 as id, vec_id // 50 as frame, cast(embedding[1] as double) as x, cast(embedding[2] as double) as y from embeddings),
z as (select frame, id, case when stddev_pop(x) over w > 0 then (x - avg(x) over w) / stddev_pop(x) over w else 0.0 end as x,
             case when stddev_pop(y) over w > 0 then (y - avg(y) over w) / stddev_pop(y) over w else 0.0 end as y from fr window w as (partition by frame)),
steps as (select frame, abs(x - lag(x) over w) as dx, abs(y - lag(y) over w) as dy from z window w as (partition by id order by frame)),
moves as (select frame, max(dx) as dx, max(dy) as dy from steps where dx is not null group by frame)"""
_CORE = f"""{_POINTS},
dd as materialized (select a.id as i, b.id as j, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) as d from pts a join pts b on a.id <> b.id),
core as materialized (select i as id, max(d) as core from (select *, row_number() over (partition by i order by d, j) as r from dd) where r <= 2 group by i)"""
_TELEMETRY = f"""{_POINTS.replace("pts as", "at0 as")}, nsq as (select (count(*) * (count(*) - 1))::double as n from embeddings), start as (select 1.0::double as eq),
""" + ",\n".join(
    f"""f{e} as (select a.id as k, b.id as l, 1 / (1 + (a.x - b.x) ** 2 + (a.y - b.y) ** 2) as q, a.x - b.x as dx, a.y - b.y as dy, a.id % 3 <> 0 as repel from at{e} a join at{e} b on b.id = a.id + 1 join embeddings v on v.vec_id = a.id where v.label % 3 = {e}),
g{e} as (select *, greatest(1 - {e} / 3.0::double, 1e-4) * case when repel then 2.0 / (eq * 5) * q * q else -2.0 * q end as g from f{e}, {f"after{e - 1}" if e else "start"}),
m{e} as (select id, sum(gx) as gx, sum(gy) as gy, count(*) as ends from (select k as id, g * dx as gx, g * dy as gy from g{e} union all select l, -g * dx, -g * dy from g{e}) group by id),
at{e + 1} as (select id, x + coalesce(gx, 0) as x, y + coalesce(gy, 0) as y from at{e} left join m{e} using (id)),
after{e} as (select greatest(1 - {e} / 3.0::double, 1e-4) as eta, (eq * n + (select sum(q) from f{e})) / (n + (select count(*) from f{e})) as eq, (select count(*) from f{e}) as draws, (select sum(ends - 1) from m{e})::bigint as clashes from {f"after{e - 1}" if e else "start"}, nsq)"""
    for e in range(3)
)
_TRIANGLE = "case when {0} <= 0.25 then 4 * {0} when {0} <= 0.75 then 2 - 4 * {0} else 4 * {0} - 4 end"
_LEVEL = "case when {0} < 0.025 then {0} / 0.025 when {0} < 0.125 then 1 - ({0} - 0.025) / 0.1 * (1 - 0.9) when {0} < 0.7 then 0.9 else 0.9 / 0.3 * (1 - {0}) end"
_SKETCH = """
h as (select distinct l_suppkey as id, k, case k when 1 then cast(l_partkey as varchar) when 2 then concat_ws('/', l_partkey, l_returnflag) else concat_ws('/', l_partkey, l_returnflag, l_linestatus) end as hash
      from lineitem, (values (1), (2), (3)) t(k)),
hn as (select id, k, count(*) as n from h group by 1, 2),
hs as (select a.id as i, b.id as j, a.k, count(*) as c from h a join h b on a.k = b.k and a.hash = b.hash and a.id < b.id group by 1, 2, 3),
jk as (select i, j, hs.k, c / cast(x.n + y.n - c as double) as jaccard from hs join hn x on x.id = i and x.k = hs.k join hn y on y.id = j and y.k = hs.k)"""
_CHANCE = """
ge as (select l_suppkey as id, avg(l_quantity) / 25 as n, avg((l_partkey % 4 = 0)::int) as a, avg((l_partkey % 4 = 1)::int) as c, avg((l_partkey % 4 = 2)::int) as g, avg((l_partkey % 4 = 3)::int) as t from lineitem group by 1),
qs as (select i, j, k, jaccard, x.n as n, y.n as m, (x.a * y.a + x.c * y.c + x.g * y.g + x.t * y.t) ** k as q from jk join ge x on x.id = i join ge y on y.id = j),
rs as (select *, (n * (1 - (1 - q) ** m) + m * (1 - (1 - q) ** n)) / 2 as shared from qs),
fixed as (select i, j, k, case when shared / (n + m - shared) < 1 then greatest(0, (jaccard - shared / (n + m - shared)) / (1 - shared / (n + m - shared))) else 0 end as jaccard from rs)"""
_NOTES = """
notes as (select event_id / 20.0 as start, 120.0 + event_id % 1200 as freq from events),
ts as (select start, freq, unnest(range(cast(ceil(start * {rate}) as bigint), cast(floor((start + 0.125) * {rate}) as bigint) + 1)) as t from notes),
amps as (select t, (t / {rate}.0 - start) * freq - floor((t / {rate}.0 - start) * freq) as ph, least((t / {rate}.0 - start) / 0.125, 1.0) as x from ts),
wave as (select t, sum(({triangle}) * ({level})) as amp from amps group by t)"""

_COLOURS = """
cl as (select vec_id as id, label - 1 as cluster from embeddings),
ks as (select cluster, row_number() over (order by cast(cluster as varchar)) as k from (select distinct cluster from cl)),
shade as (select cluster, """ + ", ".join(f"cast(case when cluster = -1 then 0 else (k + 1) * {step} % 255 end as integer) as {c}" for c, step in zip("rgb", STEPS, strict=True)) + """ from ks)"""
_CORE_KNN = """
pv as (select i, j, max(jaccard) filter (where k = 1) as j1, max(jaccard) filter (where k = 2) as j2, max(jaccard) filter (where k = 3) as j3 from jk group by i, j),
su as (select i, j, j1, j2, j3, (case when j1 is null then 0 else 1 end + case when j2 is null then 0 else 1 end + case when j3 is null then 0 else 1 end)::double as n,
              case when j1 is null then 0.0 else 1 end + case when j2 is null then 0 else 2 end + case when j3 is null then 0 else 3 end as sx,
              case when j1 is null then 0.0 else 1 end + case when j2 is null then 0 else 4 end + case when j3 is null then 0 else 9 end as sxx,
              coalesce(ln(j1), 0) + coalesce(ln(j2), 0) + coalesce(ln(j3), 0) as sy, coalesce(ln(j1), 0) + 2 * coalesce(ln(j2), 0) + 3 * coalesce(ln(j3), 0) as sxy from pv),
half as (select i, j, case when n = 1 then 1 - coalesce(j1, j2, j3) else greatest(0, least(1, 1 - exp((n * sxy - sx * sy) / (n * sxx::double - sx::double * sx::double)))) end as d from su),
dirs as (select i, j, d from half union all select j, i, d from half),
every as (select a.s_suppkey as i, b.s_suppkey as j, coalesce(d, 1.0) as d from supplier a join supplier b on a.s_suppkey <> b.s_suppkey left join dirs on dirs.i = a.s_suppkey and dirs.j = b.s_suppkey)"""
_STEREO = f"""{_FRAMES},
lim as (select least(min(dx), min(dy)) as lo, greatest(max(dx), max(dy)) as hi from moves),
fq as (select (row_number() over (order by frame) - 1) / 20.0::double as start, 120 + 1200 * (dx - lo) / (hi - lo) as fx, 120 + 1200 * (dy - lo) / (hi - lo) as fy from moves, lim),
ts as (select start, fx, fy, unnest(range(cast(ceil(start * 200) as bigint), cast(floor((start + 0.125) * 200) as bigint) + 1)) as t from fq),
ph as (select t, (t / 200.0::double - start) as x, (t / 200.0::double - start) * fx as a, (t / 200.0::double - start) * fy as b from ts),
am as (select t, a - floor(a) as a, b - floor(b) as b, x / 0.125 as x from ph),
"""


def _notes(rate: int) -> str:
    return _NOTES.format(rate=rate, triangle=_TRIANGLE.format("ph"), level=_LEVEL.format("x"))


SQL = {
    "iupac_encode": f"with {_MSA} select id, " + ", ".join(f"sum(case when (m >> {b}) & 1 = 1 and k {'<=' if w == 0 else '>'} 63 then cast(1 as bigint) << cast({'63 - k' if w == 0 else '0'} as int) else 0 end)::bigint as {base.lower()}{w}" for b, base in enumerate(BASES) for w in range(2)) + " from masks group by id",
    "snp_distance": f"with {_PLANES} select i, j, cast(snp as bigint) as snp from snp",
    "snp_knn_ties": f"with {_PLANES} select i, j, round(snp / 64.0, 6)::double as d from (select *, rank() over (partition by i order by snp) as r from snp) where r <= 16",
    "snp_threshold": f"with {_PLANES} select i, j, round(snp / 64.0, 6)::double as d from snp where snp <= 7",
    "jaccard_distance": f"with {_JACCARD} select i, j, round(d, 6) as d from jac",
    "jaccard_knn": f"with {_JACCARD} select i, j, round(d, 6) as d from (select *, row_number() over (partition by i order by d, j) as r from jac) where r <= 15",
    "jaccard_threshold": f"with {_JACCARD} select i, j, round(d, 6) as d from jac where d < 0.85",
    "vector_knn": f"with {_KNN} select i, j, round(d, 6) as d from knn",
    "perplexity_p": f"with recursive {_P} select i, j, round(p, 6) as p from p",
    "edge_normalise": f"with recursive {_P} select i, j, round(p / sum(p) over (), 9) as p from p",
    "raw_similarity": f"with {_KNN} select i, j, round(1 - d, 6) as p from knn",
    "labels_join": "with l as (select doc_id, count(*) as n, min(cast(toxic as varchar)) as label from labels group by doc_id) select d.doc_id as id, 'doc' || d.doc_id as name, case when n = 1 then label else '-1' end as label from documents d left join l using (doc_id)",
    "weights_join": "select doc_id as id, 'doc' || doc_id as name, cast(min(quality) as double) as w from labels group by doc_id",
    "weights_mismatch": "with bad as (select count(*) as n from (select doc_id from documents) d full join (select distinct doc_id from labels) l on d.doc_id = l.doc_id where d.doc_id is null or l.doc_id is null), w as (select doc_id, min(quality) as q from labels group by doc_id) select d.doc_id as id, 'doc' || d.doc_id as name, cast(case when bad.n > 0 then 1 else q end as double) as w from documents d left join w using (doc_id), bad",
    "name_symdiff": "select distinct 'doc' || doc_id as name, 'a' as side from documents where doc_id not in (select doc_id from labels) union all select distinct 'doc' || doc_id, 'b' from labels where doc_id not in (select doc_id from documents)",
    "cdf_table": f"with recursive {_P}, q as (select i, j, p / sum(p) over () as p from p) select i, j, round(sum(p) over w - p, 6) as cum_lo, round(sum(p) over w, 6) as cum_hi from q window w as (order by i, j rows between unbounded preceding and current row)",
    "weighted_draw": "with w as (select l_suppkey as id, count(*) as n from lineitem group by 1), c as (select id, sum(n) over (order by id) as hi, n from w), t as (select sum(n) as t from w), u as (select o_orderkey as draw, (o_orderkey * 7919 % 100003) / 100003.0 + 1e-6 as u from orders) select draw, id from u, t, c where u * t < hi and u * t >= hi - n",
    "sce_step": f"with {_POINTS}, f as (select a.id as k, b.id as l, 1 / (1 + (a.x - b.x) ** 2 + (a.y - b.y) ** 2) as q, a.x - b.x as dx, a.y - b.y as dy, a.id % 3 <> 0 as repel from pts a join pts b on b.id = a.id + 1), g as (select *, 0.7 * case when repel then 2.0 / (0.5 * 5) * q * q else -2.0 * q end as g from f), m as (select id, sum(gx) as gx, sum(gy) as gy from (select k as id, g * dx as gx, g * dy as gy from g union all select l, -g * dx, -g * dy from g) group by id) select id, round(x + coalesce(gx, 0), 6) as x, round(y + coalesce(gy, 0), 6) as y from pts left join m using (id)",
    "eq_update": "with recursive s as (select row_number() over (order by label) as t, sum(1 / (1 + cast(embedding[1] as double) ** 2)) as s, count(*) as n from embeddings group by label), n as (select cast(count(*) * (count(*) - 1) as double) as pairs from embeddings), r(t, eq) as (select 0::bigint, 1::double union all select r.t + 1, (eq * pairs + s.s) / (pairs + s.n) from r join s on s.t = r.t + 1, n) select round(arg_max(eq, t), 9) as eq from r",
    "telemetry": f"with {_TELEMETRY} {' union all '.join(f'select {e + 1}::int as epoch, round(100.0::double * {e + 1} / 3, 9) as percent, round(eta, 9) as eta, round(eq, 9) as eq, draws, clashes from after{e}' for e in range(3))}",
    "alias_mass": "select l_suppkey as id, round(count(*) / sum(count(*)) over ()::double, 9) as p from lineitem group by l_suppkey",
    # the slots in Walker's way: the last that lacks is filled from the last that has over
    "alias_draws": """with recursive w as (select l_suppkey as id, count(*)::double as w from lineitem group by 1),
f as (select list(id order by id) as ids, list(w * ((select count(*) from w) / (select sum(w) from w)) order by id) as fill from w),
slots(step, lack, more, fill, keep, other) as (
  select 0, list_filter(range(1, len(fill) + 1), lambda i: fill[i] < 1), list_filter(range(1, len(fill) + 1), lambda i: fill[i] > 1), fill, list_transform(fill, lambda x: 1.0::double), range(1, len(fill) + 1) from f
  union all
  select step + 1, case when left_b < 1 then list_append(lack[:-2], b) else lack[:-2] end, case when left_b <= 1 then more[:-2] else more end,
    list_transform(fill, lambda x, i: case when i = b then left_b else x end), list_transform(keep, lambda x, i: case when i = s then fill[s] else x end), list_transform(other, lambda x, i: case when i = s then b else x end)
  from (select *, lack[-1] as s, more[-1] as b, fill[more[-1]] - (1 - fill[lack[-1]]) as left_b from slots where len(lack) > 0 and len(more) > 0)),
last as (select keep, other, ids, len(ids) as n from (select * from slots order by step desc limit 1), f),
d as (select o_orderkey as draw, (o_orderkey * 7919 % 100003) / 100003.0::double as v from orders),
hit as (select draw, v * n as x, least(floor(v * n), n - 1)::bigint + 1 as k, keep, other, ids from d, last)
select draw, case when x - (k - 1) < keep[k] then ids[k] else ids[other[k]] end as id from hit""",
    "step_collisions": "with e as (select unnest([vec_id, vec_id + 1]) as id from embeddings), n as (select id, count(*) as n from e group by id) select cast(sum(n) as bigint) as touched, cast(sum(n - 1) as bigint) as collisions from n",
    "eq_prefix": "with s as (select label as step, round(avg(cast(embedding[1] as double)), 6) as eq from embeddings group by label) select f.step as frame, s.step, s.eq from s f join s on s.step <= f.step",
    "sorted_labels": "select label, cast(row_number() over (order by label) as integer) as k from (select distinct event_type as label from events)",
    "eta_schedule": "with n as (select count(*)::double as n from events) select event_id as step, round(greatest(1 - event_id / n, 1e-4)::double, 9) as eta, case when event_id < n / 10 then 8 else 2 end as attraction, round(2.0 / (1.0 / (event_id + 1) * 5)::double, 9)::double as repulsion from events, n",
    "frame_schedule": "with n as (select count(*) as n from events) select s_suppkey as supplier, cast(round(n * (1 - sqrt(1 - (s_suppkey % 399) / 400.0)), 0) as bigint) as step from supplier, n",
    "scale_centre": f"with {_POINTS}, s as (select avg(x) as ax, avg(y) as ay, (max(x) - min(x)) / 2 as hx, (max(y) - min(y)) / 2 as hy from pts) select id, round((x - ax) / hx, 6) as x, round((y - ay) / hy, 6) as y from pts, s",
    "zscore_frame": f"with {_FRAMES} select frame, id, round(x, 6) as x, round(y, 6) as y from z",
    "frame_delta": f"with {_FRAMES} select frame, round(dx, 6) as dx, round(dy, 6) as dy from moves",
    "freq_map": f"with {_FRAMES}, s as (select least(min(dx), min(dy)) as lo, greatest(max(dx), max(dy)) as hi from moves) select frame, round(120 + 1200 * (dx - lo) / (hi - lo), 6) as fx, round(120 + 1200 * (dy - lo) / (hi - lo), 6) as fy from moves, s",
    "core_distance": f"with {_CORE} select id, round(core, 6) as core from core",
    "mutual_reachability": f"""with {_POINTS},
near as materialized (select a.id, any_value(a.x) as x, any_value(a.y) as y, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 2)[2] as core from pts a join pts b on a.id <> b.id group by a.id)
select a.id as i, b.id as j, round(greatest(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), a.core, b.core), 6) as d from near a join near b on a.id <> b.id""",
    "hexbin": f"with {_POINTS}, s as (select min(x) as x0, min(y) as y0, (max(x) - min(x)) / 50 as sx, (max(y) - min(y)) / 28 as sy from pts), t as (select (x - x0) / sx as u, (y - y0) / sy as v, s.* from pts, s), c as (select *, (u - round_even(u, 0)) ** 2 + 3 * (v - round_even(v, 0)) ** 2 < (u - floor(u) - 0.5) ** 2 + 3 * (v - floor(v) - 0.5) ** 2 as a from t), h as (select case when a then round_even(u, 0) else floor(u) + 0.5 end * sx + x0 as cx, case when a then round_even(v, 0) else floor(v) + 0.5 end * sy + y0 as cy from c) select round(cx, 6) as cx, round(cy, 6) as cy, count(*) as n from h group by 1, 2",
    "class_sizes": "select cast(label as varchar) as label, count(*) as n from embeddings group by 1",
    "top_classes": "select cast(user_id as varchar) as label, count(*) as n from events group by 1 order by n desc, label limit 30",
    "point_size": "with n as (select count(*) as n from embeddings) select vec_id, label - 1 as label, cast((case when n > 10000 then 1.5 when n > 1000 then 3 else 7 end) * (case when label - 1 = -1 then 1 else 2 end) as double) as size, n <= 10000 as edge from embeddings, n",
    "n_clusters": "select count(distinct label - 1) filter (where label - 1 <> -1) as n_clusters from embeddings",
    "triangle_wave": f"select event_id, round({_TRIANGLE.format('(value / 10 - floor(value / 10))')}, 6) as amp from events",
    "adsr": f"select event_id, round({_LEVEL.format('(value / 7 - floor(value / 7))')}, 6) as level from events",
    "synth": f"with {_notes(1000)} select t, round(amp, 6) as amp from wave",
    "pcm_scale": f"with {_notes(100)}, s as (select max(abs(amp)) as m from wave) select t, cast(trunc(amp * 32767 / m) as smallint) as value from wave, s",
    "dot_lines": "select vec_id as id, '\"v' || vec_id || '\"[x=' || cast(5 * round(cast(embedding[1] as double), 3) + 0.0 as varchar) || ',y=' || cast(5 * round(cast(embedding[2] as double), 3) + 0.0 as varchar) || ']; ' as line from embeddings",
    "cluster_csv": "select 'v' || vec_id as id, label as hdbscan_cluster__autocolour from embeddings",
    "minhash_jaccard": f"with {_SKETCH} select i, j, k, round(jaccard, 6) as jaccard from jk",
    "core_accessory": f"with {_SKETCH}, f as (select i, j, regr_slope(ln(jaccard), k) as s, regr_intercept(ln(jaccard), k) as c, count(*) as n, min(jaccard) as one from jk group by 1, 2) select i, j, round(case when n = 1 then 1 - one else greatest(0, least(1, 1 - exp(s))) end, 6) as core, round(case when n = 1 then 0 else greatest(0, least(1, 1 - exp(c))) end, 6) as accessory from f",
    "random_jaccard": f"with {_SKETCH}, {_CHANCE} select i, j, k, round(jaccard, 6) as jaccard from fixed",
    "corrected_distances": f"with {_SKETCH}, {_CHANCE}, f as (select i, j, regr_slope(ln(jaccard), k) as s, regr_intercept(ln(jaccard), k) as c, count(*) as n, min(jaccard) as one from fixed where jaccard > 0 group by 1, 2) select i, j, round(case when n = 1 then 1 - one else greatest(0, least(1, 1 - exp(s))) end, 6) as core, round(case when n = 1 then 0 else greatest(0, least(1, 1 - exp(c))) end, 6) as accessory from f",
    "sketch_kmers": "select distinct l_suppkey as name, '1,2,3' as ks from lineitem",
    "sketch_knn": f"with {_SKETCH}, {_CORE_KNN} select i, j, round(d, 6) as d from (select *, row_number() over (partition by i order by d, j) as r from every) where r <= 15",
    "colour_map": f"with {_COLOURS.replace('label - 1 as cluster', 'label as cluster')} select cast(cluster as varchar) as label, r, g, b from shade",
    "noise_split": "select vec_id as id, label - 1 as cluster, label = 0 as noise, case when label = 0 then 0 else 1 end::integer as layer from embeddings",
    "plot_table": f"with {_POINTS}, {_COLOURS} select id, 'v' || id as name, round(x, 6) as x, round(y, 6) as y, cluster, r, g, b from pts join cl using (id) join shade using (cluster)",
    "self_draws": f"with {_POINTS}, f as (select a.id as k, b.id as l, 1 / (1 + (a.x - b.x) ** 2 + (a.y - b.y) ** 2) as q, a.x - b.x as dx, a.y - b.y as dy, a.id % 3 <> 0 as repel from pts a join pts b on b.id = a.id + 1 where a.id % 5 <> 0), g as (select *, 0.7 * case when repel then 2.0 / (0.5 * 5) * q * q else -2.0 * q end as g from f), m as (select id, sum(gx) as gx, sum(gy) as gy from (select k as id, g * dx as gx, g * dy as gy from g union all select l, -g * dx, -g * dy from g) group by id) select id, round(x + coalesce(gx, 0), 6) as x, round(y + coalesce(gy, 0), 6) as y from pts left join m using (id)",
    "first_layout": f"with u as (select vec_id as id, {', '.join(f"(('0x' || substr(md5(vec_id || ':1:{k}'), 1, 13))::bigint + 0.5::double) / 4503599627370496.0::double as u{k}" for k in (1, 2))} from embeddings) select id, round(sqrt(u1) * cos(u2 * 2 * pi()), 6) as x, round(sqrt(u1) * sin(u2 * 2 * pi()), 6) as y from u",
    "run_frames": "select event_id as step from events where event_id in (select cast(round(n * (1 - sqrt(1 - frame / 400.0)), 0) as bigint) from range(399) r(frame), (select count(*) as n from events))",
    "worker_split": "select s_suppkey as workers, cast(100000 // greatest(s_suppkey, 8) as bigint) as steps from supplier",
    "stereo": f"with {_STEREO} lv as (select t, sum(({_TRIANGLE.format('a')}) * ({_LEVEL.format('x')})) as l, sum(({_TRIANGLE.format('b')}) * ({_LEVEL.format('x')})) as r from am group by t), mx as (select max(abs(l)) as ml, max(abs(r)) as mr from lv) select t, cast(trunc(l * 32767 / ml) as smallint) as left, cast(trunc(r * 32767 / mr) as smallint) as right from lv, mx",
    "fasta_read": f"with {_MSA} select 'v' || id as name, string_agg(c, '' order by k) as seq, cast(64 as bigint) as length from chars group by id",
    "fastq_read": f"with {_MSA} select 'v' || id as name, string_agg(c, '' order by k) as seq, cast(64 as bigint) as length from chars group by id",
    "rtab_read": "select distinct 's' || l_suppkey as name, 'p' || l_partkey as feature from lineitem",
    "distances_reload": f"with {_KNN} select 'v' || i as name, j, round(d, 6) as d from knn",
    "labels_file": "select 'doc' || doc_id as name, cast(toxic as varchar) as label from labels",
    "weights_file": "select 'doc' || doc_id as name, cast(quality as double) as weight from labels",
    "names_file": "select s_name as name from supplier",
    "embedding_file": f"with {_POINTS} select round(x, 6) as x, round(y, 6) as y from pts",
    "bare_names": "select s_suppkey, s_name as name from supplier",
    "edge_count": f"with {_PLANES} select count(*) as n_edges from snp where snp <= 7",
    "jaccard_knn_all": f"with {_JACCARD} select i, j, round(d, 6) as d from jac",
    # Points in the order of Prim's algorithm: parts of the hierarchy are the intervals between longer joins, clusters those that split off
    "hdbscan_labels": f"""with recursive {_POINTS.replace("pts as", "p0 as")},
lim as (select avg(x) as ax, avg(y) as ay, (max(x) - min(x)) / 2 as hx, (max(y) - min(y)) / 2 as hy from p0),
pts as materialized (select id, (x - ax) / hx as x, (y - ay) / hy as y from p0, lim),
dd as materialized (select a.id as i, b.id as j, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) as d from pts a join pts b on a.id <> b.id),
core as materialized (select i as id, list_sort(list(d))[2] as core from dd group by i),
reach as materialized (select i, j, greatest(d, a.core, b.core) as d from dd join core a on a.id = i join core b on b.id = j),
prim(id, d, step) using key (id) as (
  select id, case when id = (select min(id) from pts) then 0.0 else 1e308 end::double, null::bigint from pts
  union all
  select p.id, case when p.id = u.id then p.d else least(p.d, r.d) end, case when p.id = u.id then u.n end
  from (select id, d, (select count(step) from recurring.prim) as n from recurring.prim where step is null order by d, id limit 1) u, recurring.prim p
  left join reach r on r.j = p.id and r.i = (select id from recurring.prim where step is null order by d, id limit 1)
  where p.step is null),
seq as materialized (select id, step as t, case when step = 0 then 'inf'::double else d end as w from prim union all select null, (select count(*) from pts), 'inf'::double),
low as materialized (select s.t, s.w, max(o.t) filter (o.t < s.t) as l, min(o.t) filter (o.t > s.t) - 1 as r from seq s join seq o on o.w > s.w where s.w < 'inf'::double group by s.t, s.w),
node as materialized (select distinct l, r, w as h, r - l + 1 as size, case when w > 0 then least(1 / w, 1e290) else 1e290 end as rate from low),
up as materialized (select a.*, p.l as pl, p.r as pr, p.rate as birth from node a left join node p on p.h = least((select w from seq where t = a.l), (select w from seq where t = a.r + 1)) and p.l <= a.l and p.r >= a.r),
point as materialized (select s.id, s.t, n.l, n.r, n.rate from seq s join seq o on o.t = s.t + 1 join node n on n.h = least(s.w, o.w) and n.l <= s.t and n.r >= s.t where s.id is not null),
inner_ as materialized (select pl as l, pr as r, count(*) as parts, sum(size) as part_points from up where pl is not null group by 1, 2),
single as materialized (select l, r, count(*) as points from point group by 1, 2),
head as materialized (select u.l, u.r, u.size, coalesce(u.birth, 0) as birth, row_number() over (order by u.size, u.l) as k from up u left join inner_ i on i.l = u.pl and i.r = u.pr where u.pl is null or i.parts >= 2),
owned as materialized (select n.l, n.r, n.rate, arg_min(h.k, h.size) as k from node n join head h on h.l <= n.l and h.r >= n.r group by all),
cl as materialized (select h.k, h.l, h.r, h.size, h.birth, sum(o.rate * (coalesce(s.points, 0) + case when i.parts >= 2 then i.part_points else 0 end)) - h.size * h.birth as stable
  from head h join owned o using (k) left join single s on s.l = o.l and s.r = o.r left join inner_ i on i.l = o.l and i.r = o.r group by h.k, h.l, h.r, h.size, h.birth),
kid as materialized (select h.k as kid, o.k from head h join up u on u.l = h.l and u.r = h.r join owned o on o.l = u.pl and o.r = u.pr),
best(k, best, taken) using key (k) as (
  select 0::bigint, 0::double, false
  union all
  select c.k, greatest(c.stable, coalesce(b.below, 0)), coalesce(b.below, 0) <= c.stable
  from cl c left join (select kid.k, sum(x.best) as below from recurring.best x join kid on kid.kid = x.k group by kid.k) b on b.k = c.k
  where c.k = (select max(k) + 1 from recurring.best)),
ok as materialized (select c.k, c.l, c.r, c.size, c.birth, taken from cl c join best using (k)),
top as materialized (select * from ok a where taken and not exists (select 1 from ok b where b.taken and b.size > a.size and b.l <= a.l and b.r >= a.r)),
risen as materialized (select distinct arg_min(b.k, b.size) as k from top a join ok b on b.l <= a.l and b.r >= a.r and b.birth <= 1 / 0.02 group by a.k),
final as materialized (select a.* from risen join ok a using (k) where not exists (select 1 from risen s join ok b on s.k = b.k where b.size > a.size and b.l <= a.l and b.r >= a.r)),
stay as (select case when (select count(*) from final) = 1 and (select birth from final limit 1) = 0 then least(1 / 0.02, (select max(p.rate) from point p join owned o on o.l = p.l and o.r = p.r join final f on f.k = o.k)) else 0 end as rate),
found as (select p.id, f.k from point p join final f on p.t between f.l and f.r, stay where p.rate >= stay.rate),
named as (select k, row_number() over (order by min(id)) - 1 as cluster from found group by k)
select pts.id, coalesce(cluster, -1)::int as cluster from pts left join found using (id) left join named using (k)""",
    # Prim's algorithm: a row a point with its least edge to the tree, one point joins in each step
    "mst_weight": f"""with recursive {_POINTS.replace("pts as", "p0 as")},
lim as (select avg(x) as ax, avg(y) as ay, (max(x) - min(x)) / 2 as hx, (max(y) - min(y)) / 2 as hy from p0),
pts as materialized (select id, (x - ax) / hx as x, (y - ay) / hy as y from p0, lim),
{_CORE[len(_POINTS) + 1 :].lstrip()},
reach as materialized (select i, j, greatest(d, a.core, b.core) as d from dd join core a on a.id = i join core b on b.id = j),
prim(id, d, done) using key (id) as (
  select id, case when id = (select min(id) from pts) then 0.0 else 1e308 end::double, false from pts
  union all
  select p.id, case when p.id = u.id then p.d else least(p.d, r.d) end, p.id = u.id
  from (select id, d from recurring.prim where not done order by d, id limit 1) u, recurring.prim p
  left join reach r on r.j = p.id and r.i = (select id from recurring.prim where not done order by d, id limit 1)
  where not p.done)
select count(*) - 1 as n_edges, round(sum(d), 6) as weight from prim""",
}
