"""Reference SQL (DuckDB dialect) for the registered queries.

The statements are written in long, relational form — one row per (item,
model, class) — so they check the Spark plans (wide arrays, per-batch
coefficient matrices) by an independent formulation.  Output doubles are
rounded as in the Spark queries; picks use the same tolerance rule.
"""

from __future__ import annotations

from itertools import combinations

# The F-ORD scorers, batch size and pick tolerance.
MODELS = ("A", "B", "C", "D", "E")
N_CLASSES = 5
BATCH = 2048
TOL = "1e-9"
REG_MODELS = ("P", "Q", "R")

FORD = """
base AS (
  select o_orderkey as item_id, cast(substr(o_orderpriority,1,1) as int)-1 as label,
         cast(c_mktsegment as varchar) as fa, cast(c_nationkey as varchar) as fb,
         cast(month(o_orderdate) as varchar) as fc,
         concat(o_orderstatus, cast(year(o_orderdate) as varchar)) as fd,
         cast(cast(floor(o_totalprice/10000) as int) as varchar) as fe
  from orders join customer on o_custkey = c_custkey),
feat AS (
  select item_id, label, 'A' as model, fa as f from base union all
  select item_id, label, 'B' as model, fb as f from base union all
  select item_id, label, 'C' as model, fc as f from base union all
  select item_id, label, 'D' as model, fd as f from base union all
  select item_id, label, 'E' as model, fe as f from base),
freq AS (select model, f, label as cls, count(*) as n from feat group by model, f, label),
tot AS (select model, f, count(*) as t from feat group by model, f),
classes AS (select 0 as cls union all select 1 union all select 2 union all select 3 union all select 4),
scores AS (
  select feat.item_id, feat.model, classes.cls,
         cast(coalesce(freq.n, 0) as double) / cast(tot.t as double) as score
  from feat join tot on feat.model = tot.model and feat.f = tot.f
  cross join classes
  left join freq on freq.model = feat.model and freq.f = feat.f and freq.cls = classes.cls),
truth AS (select item_id, label from base),
ranks AS (
  select item_id, model, cls, score,
         cast(rank() over (partition by item_id, model order by score desc) as double)
           + (count(*) over (partition by item_id, model, score) - 1) / 2.0 as rnk
  from scores)"""

BASE_ACC = """
bmx AS (select item_id, model, max(score) as mx from scores group by item_id, model),
bpk AS (select s.item_id, s.model, min(s.cls) as pred
        from scores s join bmx on s.item_id = bmx.item_id and s.model = bmx.model
        where s.score >= bmx.mx - {tol} group by s.item_id, s.model),
bacc AS (select model, sum(case when bpk.pred = truth.label then 1 else 0 end) as correct,
                count(*) as total
         from bpk join truth on bpk.item_id = truth.item_id group by model)""".format(tol=TOL)

FIRSTS = """
fb AS (select floor(item_id / {b}) as batch_id, min(item_id) as first_id from truth group by 1),
fr AS (select fb.batch_id, s.model, s.cls, s.score from scores s join fb on s.item_id = fb.first_id),
fn AS (select batch_id, model, cls,
              (score - min(score) over (partition by batch_id, model))
              / nullif(max(score) over (partition by batch_id, model)
                       - min(score) over (partition by batch_id, model), 0) as v from fr),
rsc AS (select batch_id, model, v,
               row_number() over (partition by batch_id, model order by v desc nulls last, cls) as pos
        from fn),
pairs AS (select a.batch_id, a.model as ma, b.model as mb, a.pos, a.v as av, b.v as bv
          from rsc a join rsc b on a.batch_id = b.batch_id and a.pos = b.pos and a.model <> b.model),
cd AS (select batch_id, ma, mb, sqrt(sum((av - bv) * (av - bv)) / {n}.0) as d
       from pairs group by batch_id, ma, mb),
cds AS (select batch_id, mb as model, avg(d) as strength from cd group by batch_id, mb),
kt AS (select *, row_number() over (partition by batch_id, ma, mb order by av, pos) as t from pairs),
kr AS (select *, row_number() over (partition by batch_id, ma, mb order by bv, t) as r from kt),
kl AS (select *, lag(r) over (partition by batch_id, ma, mb order by t) as pr from kr),
ksi AS (select batch_id, ma, mb, 3.0 * sum(abs(r - pr)) / {nn}.0 as d from kl group by batch_id, ma, mb),
kds AS (select batch_id, mb as model, avg(d) as strength from ksi group by batch_id, mb)""".format(
    b=BATCH, n=N_CLASSES, nn=N_CLASSES * N_CLASSES - 1)


def weights_cte(schemes) -> str:
    parts = []
    for s in schemes:
        if s == "AC":
            parts.append("select fb.batch_id, 'AC' as scheme, m.model, 1.0 as w from fb cross join "
                         "(select distinct model from scores) m")
        elif s == "WC-CDS":
            parts.append("select batch_id, 'WC-CDS' as scheme, model, strength as w from cds")
        elif s == "WC-KDS":
            parts.append("select batch_id, 'WC-KDS' as scheme, model, strength as w from kds")
        elif s == "WCP":
            parts.append("select fb.batch_id, 'WCP' as scheme, bacc.model, "
                         "(cast(bacc.correct as double) / bacc.total * 100.0) * 0.01 as w "
                         "from fb cross join bacc")
    return "bw AS (" + " union all ".join(parts) + ")"


def layout(schemes, kinds=("SC", "RC"), models=MODELS, full_set_only=False):
    outs = [(m, (i,), None) for i, m in enumerate(models)]
    sizes = [len(models)] if full_set_only else range(2, len(models) + 1)
    for s in schemes:
        for k in sizes:
            for c in combinations(range(len(models)), k):
                outs.append(("".join(models[i] for i in c) + "_" + s, c, s))
    return [(kind, name, mem, s) for kind in kinds for (name, mem, s) in outs]


def outs_cte(schemes, kinds=("SC", "RC"), full_set_only=False, models=MODELS) -> str:
    rows = []
    for j, (kind, name, mem, s) in enumerate(layout(schemes, kinds, models, full_set_only)):
        for i in mem:
            sch = "NULL" if s is None else f"'{s}'"
            rows.append(f"({j}, '{kind}', '{name}', {sch}, '{models[i]}')")
    return ("outs(j, kind, fusion_model, scheme, model) AS (VALUES " + ", ".join(rows) + "),\n"
            "outn AS (select distinct j, kind, fusion_model from outs)")


FUSED = """
fv AS (
  select r.item_id, o.j, o.kind, r.cls,
         sum(case when o.kind = 'SC' then coalesce(w.w, 1.0) * r.score
                  else r.rnk * (1.0 / coalesce(w.w, 1.0)) end)
         / sum(case when o.kind = 'SC' then coalesce(w.w, 1.0) else 1.0 / coalesce(w.w, 1.0) end) as v
  from ranks r join outs o on o.model = r.model
  left join bw w on w.batch_id = floor(r.item_id / {b}) and w.scheme = o.scheme and w.model = r.model
  where o.scheme is null or w.w <> 0
  group by r.item_id, o.j, o.kind, r.cls),
ext AS (select item_id, j, max(v) as mx, min(v) as mn from fv group by item_id, j),
pk AS (select fv.item_id, fv.j, min(fv.cls) as pred
       from fv join ext on fv.item_id = ext.item_id and fv.j = ext.j
       where (fv.kind = 'SC' and fv.v >= ext.mx - {tol}) or (fv.kind = 'RC' and fv.v <= ext.mn + {tol})
       group by fv.item_id, fv.j)""".format(b=BATCH, tol=TOL)

LAYER_ACC = """
lacc AS (select pk.j, sum(case when pk.pred = truth.label then 1 else 0 end) as correct, count(*) as total
         from pk join truth on pk.item_id = truth.item_id group by pk.j),
layer AS (select outn.j, outn.kind, outn.fusion_model, lacc.correct, lacc.total,
                 cast(lacc.correct as double) / lacc.total * 100.0 as accuracy
          from lacc join outn on lacc.j = outn.j)"""


def _with(*parts) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts)


ALL4 = ("AC", "WC-CDS", "WC-KDS", "WCP")
SEARCH_SCHEMES = ("AC", "WC-CDS", "WCP")
UNSUPERVISED = ("AC", "WC-CDS")


def ord_scores() -> str:
    return _with(FORD) + "\nselect item_id, model, cls, round(score, 6) as score from scores"


def base_accuracy() -> str:
    return _with(FORD, BASE_ACC) + """
select model as fusion_model, correct, total,
       round(cast(correct as double) / total * 100.0, 6) as accuracy from bacc"""


def avg_rank() -> str:
    return _with(FORD) + "\nselect item_id, model, cls, round(score, 6) as score, rnk as rank from ranks"


def ordinal_rank() -> str:
    return _with(FORD) + """
select item_id, model, cls, round(score, 6) as score,
       cast(row_number() over (partition by item_id, model order by score desc, cls) as double) as rank
from scores"""


def _curve(source: str, keys: str, value: str) -> str:
    """Both axes of a rank-score characteristic, each sorted by itself: the
    scaled values from the highest down and the average ranks from 1 up."""
    return f""",
nv AS (select {keys}, {value} as x,
              ({value} - min({value}) over (partition by {keys}))
              / nullif(max({value}) over (partition by {keys}) - min({value}) over (partition by {keys}), 0) as v,
              cast(rank() over (partition by {keys} order by {value} desc) as double)
                + (count(*) over (partition by {keys}, {value}) - 1) / 2.0 as r from {source}),
ax AS (select {keys}, v, row_number() over (partition by {keys} order by v desc nulls last) as position from nv),
ay AS (select {keys}, r, row_number() over (partition by {keys} order by r) as position from nv)
select {keys}, position, ay.r as rank, round(ax.v, 6) as value from ax join ay using ({keys}, position)"""


def rsc_item() -> str:
    return _with(FORD) + _curve("scores", "item_id, model", "score")


def rsc_mean() -> str:
    return _with(FORD) + """,
mean AS (select model, cls, round(avg(score), 9) as m from scores group by model, cls)""" + _curve("mean", "model", "m")


def rsc_mean_ranks() -> str:
    return _with(FORD) + """,
mean AS (select model, cls, round(avg(rnk), 9) as m from ranks group by model, cls)""" + _curve("mean", "model", "m")


def diversity_pairs() -> str:
    return _with(FORD, FIRSTS) + """
select batch_id, ma as model_a, mb as model_b, round(d, 6) as value from cd"""


def diversity_strength() -> str:
    return _with(FORD, FIRSTS) + "\nselect batch_id, model, round(strength, 6) as strength from cds"


def ksi_strength() -> str:
    return _with(FORD, FIRSTS) + "\nselect batch_id, model, round(strength, 6) as strength from kds"


def weights_all() -> str:
    return _with(FORD, BASE_ACC, FIRSTS, weights_cte(ALL4)) + """
select batch_id, scheme, model, round(w, 6) as weight from bw"""


def _layer(schemes, kinds=("SC", "RC"), full_set_only=False) -> str:
    return _with(FORD, BASE_ACC, FIRSTS, weights_cte(schemes),
                 outs_cte(schemes, kinds, full_set_only), FUSED, LAYER_ACC)


def layer_accuracy() -> str:
    return _layer(ALL4) + """
select kind, fusion_model, correct, total, round(accuracy, 6) as accuracy from layer"""


def layer_report() -> str:
    return _layer(ALL4) + """
select s.fusion_model, round(s.accuracy, 6) as sc, round(r.accuracy, 6) as rc
from layer s left join layer r on s.fusion_model = r.fusion_model and r.kind = 'RC'
where s.kind = 'SC'"""


def _matrices(kind: str) -> str:
    cols = ", ".join(f"floor(max(case when cls = {k} then val end) * 1e6 + 0.5) / 1e6 as c{k}"
                     for k in range(N_CLASSES))
    if kind == "SC":
        val = """(fv.v - mm.lo) / nullif(mm.hi - mm.lo, 0)"""
        extra = """,
mm AS (select floor(item_id / {b}) as batch_id, j, min(v) as lo, max(v) as hi from fv
       group by floor(item_id / {b}), j),
nv AS (select fv.item_id, fv.j, fv.cls, {val} as val
       from fv join mm on mm.batch_id = floor(fv.item_id / {b}) and mm.j = fv.j)""".format(b=BATCH, val=val)
    else:
        extra = """,
nv AS (select item_id, j, cls, v as val from fv)"""
    return (_with(FORD, BASE_ACC, FIRSTS, weights_cte(ALL4),
                  outs_cte(ALL4, (kind,)), FUSED) + extra + f"""
select nv.item_id, outn.fusion_model, {cols}
from nv join outn on nv.j = outn.j group by nv.item_id, outn.fusion_model""")


def score_combination() -> str:
    return _matrices("SC")


def rank_combination() -> str:
    return _matrices("RC")


def per_class_accuracy() -> str:
    return _with(FORD, BASE_ACC, FIRSTS, weights_cte(ALL4),
                 outs_cte(ALL4), FUSED) + """,
pc AS (select pk.j, c.cls, sum(case when truth.label = c.cls and pk.pred = truth.label then 1 else 0 end) as correct,
              sum(case when truth.label = c.cls then 1 else 0 end) as cnt
       from pk join truth on pk.item_id = truth.item_id cross join classes c group by pk.j, c.cls)
select outn.kind, outn.fusion_model, pc.cls, pc.correct, pc.cnt as count,
       round(cast(pc.correct as double) / nullif(pc.cnt, 0), 6) as class_accuracy
from pc join outn on pc.j = outn.j"""


def mean_class_accuracy() -> str:
    base_list = ", ".join(f"'{m}'" for m in MODELS)
    return _with(FORD, BASE_ACC, FIRSTS, weights_cte(ALL4),
                 outs_cte(ALL4), FUSED) + f""",
pc AS (select pk.j, c.cls,
              cast(sum(case when truth.label = c.cls and pk.pred = truth.label then 1 else 0 end) as double)
              / nullif(sum(case when truth.label = c.cls then 1 else 0 end), 0) as ca
       from pk join truth on pk.item_id = truth.item_id cross join classes c group by pk.j, c.cls),
g AS (select pc.cls, pc.ca,
             case when outn.fusion_model in ({base_list}) and outn.kind = 'SC' then 'base'
                  when outn.fusion_model not in ({base_list}) and outn.kind = 'SC' then 'sc'
                  when outn.fusion_model not in ({base_list}) and outn.kind = 'RC' then 'rc' end as grp
      from pc join outn on pc.j = outn.j),
a AS (select cls, avg(case when grp = 'base' then ca end) as base,
             avg(case when grp = 'sc' then ca end) as sc, avg(case when grp = 'rc' then ca end) as rc
      from g group by cls)
select cls, round(base, 6) as base, round(sc, 6) as sc, round(rc, 6) as rc,
       round((sc + rc) / 2, 6) as fused from a"""


def unsupervised_labels() -> str:
    lay = layout(UNSUPERVISED)
    cols = ", ".join(f"max(case when pk.j = {j} then pk.pred + 1 end) as \"{kind}_{name}\""
                     for j, (kind, name, _, _) in enumerate(lay))
    return (_with(FORD, BASE_ACC, FIRSTS, weights_cte(UNSUPERVISED), outs_cte(UNSUPERVISED), FUSED)
            + f"\nselect pk.item_id, {cols} from pk group by pk.item_id")


def unsupervised_labels_max() -> str:
    lay = layout(UNSUPERVISED, ("RC",))
    cols = ", ".join(f"max(case when pm.j = {j} then pm.pred + 1 end) as \"{kind}_{name}\""
                     for j, (kind, name, _, _) in enumerate(lay))
    return _with(FORD, BASE_ACC, FIRSTS, weights_cte(UNSUPERVISED), outs_cte(UNSUPERVISED, ("RC",)), FUSED) + f""",
pm AS (select fv.item_id, fv.j, min(fv.cls) as pred
       from fv join ext on fv.item_id = ext.item_id and fv.j = ext.j
       where fv.v >= ext.mx - {TOL} group by fv.item_id, fv.j)
select pm.item_id, {cols} from pm group by pm.item_id"""


def _vote_fused_cte() -> str:
    return """
vc AS (select item_id, pred, count(*) as n from pk group by item_id, pred),
vm AS (select item_id, max(n) as mx from vc group by item_id),
vote AS (select vc.item_id, min(vc.pred) as vote from vc join vm on vc.item_id = vm.item_id and vc.n = vm.mx
         group by vc.item_id)"""


def vote_fused() -> str:
    return _with(_layer(SEARCH_SCHEMES)[5:], _vote_fused_cte()) + "\nselect item_id, vote from vote"


def vote_fused_accuracy() -> str:
    return _with(_layer(SEARCH_SCHEMES)[5:], _vote_fused_cte()) + """
select sum(case when vote.vote = truth.label then 1 else 0 end) as correct, count(*) as total,
       round(cast(sum(case when vote.vote = truth.label then 1 else 0 end) as double) / count(*), 6) as accuracy
from vote join truth on vote.item_id = truth.item_id"""


def vote_combinations() -> str:
    rows = []
    combos = [c for k in range(2, len(MODELS) + 1) for c in combinations(range(len(MODELS)), k)]
    for ci, c in enumerate(combos):
        for i in c:
            rows.append(f"({ci}, '{''.join(MODELS[x] for x in c)}', '{MODELS[i]}')")
    return _with(FORD, BASE_ACC) + ",\ncm(combo, members, model) AS (VALUES " + ", ".join(rows) + """),
vc AS (select bpk.item_id, cm.combo, cm.members, bpk.pred, count(*) as n
       from bpk join cm on bpk.model = cm.model group by bpk.item_id, cm.combo, cm.members, bpk.pred),
vm AS (select item_id, combo, max(n) as mx from vc group by item_id, combo),
vote AS (select vc.item_id, vc.combo, vc.members, min(vc.pred) as vote
         from vc join vm on vc.item_id = vm.item_id and vc.combo = vm.combo and vc.n = vm.mx
         group by vc.item_id, vc.combo, vc.members)
select members, sum(case when vote.vote = truth.label then 1 else 0 end) as correct, count(*) as total,
       round(cast(sum(case when vote.vote = truth.label then 1 else 0 end) as double) / count(*), 6) as accuracy
from vote join truth on vote.item_id = truth.item_id group by members"""


def top_k_pool() -> str:
    return _layer(SEARCH_SCHEMES) + """,
thr AS (select max(cast(correct as double) / total * 100.0) as t from bacc),
sct AS (select 0 as src, j, kind, fusion_model, correct, accuracy,
               row_number() over (order by accuracy desc, j) as rn
        from layer, thr where kind = 'SC' and accuracy > thr.t),
rct AS (select 1 as src, j, kind, fusion_model, correct, accuracy,
               row_number() over (order by accuracy desc, j) as rn
        from layer, thr where kind = 'RC' and accuracy > thr.t),
pool AS (select * from sct where rn <= 4 union all select * from rct where rn <= 4)
select row_number() over (order by accuracy desc, src, rn) as position, kind, fusion_model, correct
from pool qualify position <= 4"""


def rank_invert() -> str:
    return _with(FORD) + """,
mx AS (select model, max(rnk) as m from ranks group by model)
select r.item_id, r.model, r.cls, round(1.0 - (r.rnk - 1) / nullif(mx.m - 1, 0), 6) as value
from ranks r join mx on r.model = mx.model"""


# ------------------------------------------------------------ regression

FREG = """
freg AS (
  select item_id, model,
         (cast(sum(cast(round(y * 100) as bigint)) over (partition by model, f) as double)
          / cast(count(*) over (partition by model, f) as double)) / 100.0 as score from (
   select o_orderkey as item_id, 'P' as model, cast(o_custkey as varchar) as f, o_totalprice as y from orders union all
   select o_orderkey, 'Q', cast(cast(o_orderdate as date) as varchar), o_totalprice from orders union all
   select o_orderkey, 'R', concat(o_orderstatus, o_orderpriority), o_totalprice from orders) t),
target AS (select o_orderkey as item_id, o_totalprice as y from orders),
qr AS (select item_id, model, score,
              row_number() over (partition by model order by score, item_id) as rank from freg)"""


def reg_ranks() -> str:
    return _with(FREG) + "\nselect item_id, model, rank from qr"


def reg_rsc() -> str:
    return _with(FREG) + """,
st AS (select model, min(score) as lo, max(score) as hi from freg group by model)
select f.model, row_number() over (partition by f.model order by f.score desc, f.item_id desc) as rank,
       round((f.score - st.lo) / nullif(st.hi - st.lo, 0), 6) as value,
       round(f.score / nullif(st.hi, 0), 6) as value_max
from freg f join st on f.model = st.model"""


REG_W = """
st AS (select model, min(score) as lo, max(score) as hi from freg group by model),
rv AS (select f.model, (f.score - st.lo) / nullif(st.hi - st.lo, 0) as v,
              row_number() over (partition by f.model order by f.score desc, f.item_id desc) as rnk
       from freg f join st on f.model = st.model),
rcd AS (select a.model as ma, b.model as mb, sqrt(sum((a.v - b.v) * (a.v - b.v)) / count(*)) as d
        from rv a join rv b on a.rnk = b.rnk and a.model <> b.model group by a.model, b.model),
rkt AS (select a.model as ma, b.model as mb, b.v as bv,
               row_number() over (partition by a.model, b.model order by a.v, a.rnk) as t
        from rv a join rv b on a.rnk = b.rnk and a.model <> b.model),
rkr AS (select *, row_number() over (partition by ma, mb order by bv, t) as r from rkt),
rkl AS (select *, lag(r) over (partition by ma, mb order by t) as prv from rkr),
rxi AS (select ma, mb, 3.0 * sum(abs(r - prv)) / (count(*) * count(*) - 1) as d from rkl group by ma, mb),
rw AS (select 'AC' as scheme, model, 1.0 as w from (select distinct model from freg) m
       union all select 'WC-CDS', mb, avg(d) from rcd group by mb
       union all select 'WC-KDS', mb, avg(d) from rxi group by mb)"""


def _reg_fused() -> str:
    rows = []
    j = 0
    for kind in ("SC", "RC"):
        for m in REG_MODELS:
            rows.append(f"({j}, '{kind}', '{m}', NULL, '{m}')")
            j += 1
        for s in ("AC", "WC-CDS", "WC-KDS"):
            for k in range(2, len(REG_MODELS) + 1):
                for c in combinations(REG_MODELS, k):
                    for m in c:
                        rows.append(f"({j}, '{kind}', '{''.join(c)}_{s}', '{s}', '{m}')")
                    j += 1
    return """
routs(j, kind, fusion_model, scheme, model) AS (VALUES """ + ", ".join(rows) + """),
rfv AS (select q.item_id, o.kind, o.fusion_model,
               coalesce(sum(case when o.kind = 'SC' then coalesce(w.w, 1.0) * q.score
                                 else cast(q.rank as double) * (1.0 / coalesce(w.w, 1.0)) end)
                        / nullif(sum(case when o.kind = 'SC' then coalesce(w.w, 1.0)
                                          else 1.0 / coalesce(w.w, 1.0) end), 0), 0.0) as value
        from qr q join routs o on o.model = q.model
        left join rw w on w.scheme = o.scheme and w.model = q.model
        where o.scheme is null or w.w <> 0
        group by q.item_id, o.kind, o.fusion_model)"""


def reg_fusion() -> str:
    return _with(FREG, REG_W, _reg_fused()) + """
select item_id, kind, fusion_model, floor(value * 1e4 + 0.5) / 1e4 as value from rfv"""


def reg_report() -> str:
    return _with(FREG, REG_W, _reg_fused()) + """,
my AS (select avg(y) as m from target)
select case when rfv.fusion_model in ('P','Q','R') then 'Base_' || rfv.fusion_model
            else rfv.kind || '_' || rfv.fusion_model end as model,
       round(1.0 - sum((t.y - rfv.value) * (t.y - rfv.value)) / sum((t.y - my.m) * (t.y - my.m)), 6) as r2,
       floor(sqrt(sum((t.y - rfv.value) * (t.y - rfv.value)) / count(*)) * 1e4 + 0.5) / 1e4 as rmse
from rfv join target t on rfv.item_id = t.item_id cross join my
where rfv.kind = 'SC'
group by rfv.kind, rfv.fusion_model"""


QUERIES = {
    "ord_scores": ord_scores, "base_accuracy": base_accuracy, "avg_rank": avg_rank,
    "ordinal_rank": ordinal_rank, "rsc_item": rsc_item, "rsc_mean": rsc_mean,
    "rsc_mean_ranks": rsc_mean_ranks, "unsupervised_labels_max": unsupervised_labels_max,
    "diversity_pairs": diversity_pairs, "diversity_strength": diversity_strength,
    "ksi_strength": ksi_strength, "weights_all": weights_all, "layer_accuracy": layer_accuracy,
    "layer_report": layer_report, "score_combination": score_combination,
    "rank_combination": rank_combination, "per_class_accuracy": per_class_accuracy,
    "mean_class_accuracy": mean_class_accuracy, "unsupervised_labels": unsupervised_labels,
    "vote_fused": vote_fused, "vote_fused_accuracy": vote_fused_accuracy,
    "vote_combinations": vote_combinations, "top_k_pool": top_k_pool, "rank_invert": rank_invert,
    "reg_ranks": reg_ranks, "reg_rsc": reg_rsc, "reg_fusion": reg_fusion, "reg_report": reg_report,
}


def all_sql() -> dict[str, str]:
    return {k: f() for k, f in QUERIES.items()}


# ------------------------------------------------------------ preparation

# The TPC-H market segments, sorted (the first is dropped).
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def prep_factorize() -> str:
    return """WITH f AS (select c_mktsegment, min(c_custkey) as first from customer group by c_mktsegment),
codes AS (select c_mktsegment, row_number() over (order by first) - 1 as segment_code from f)
select c.c_custkey, codes.segment_code from customer c left join codes on c.c_mktsegment = codes.c_mktsegment"""


def prep_onehot() -> str:
    cols = ", ".join(f"case when c_mktsegment = '{v}' then 1 else 0 end as \"c_mktsegment_{v}\""
                     for v in SEGMENTS[1:])
    return f"select c_custkey, {cols} from customer"


def prep_impute() -> str:
    return """WITH ev AS (select event_id, case when event_type = 'error' then null else value end as v from events),
m AS (select avg(v) as mv from ev)
select event_id, round(coalesce(v, m.mv), 6) as value, round(coalesce(v, m.mv) / 255.0, 6) as scaled
from ev cross join m"""


QUERIES.update({"prep_factorize": prep_factorize, "prep_onehot": prep_onehot,
                "prep_impute": prep_impute})


# ------------------------------------------------------------ reports

def tie_counts() -> str:
    return _with(FORD) + """,
t AS (select item_id, model, count(distinct score) < count(*) as tied from scores group by item_id, model)
select model, sum(case when tied then 1 else 0 end) as items_with_ties from t group by model"""


def diversity_log() -> str:
    cols = ", ".join(f"round(max(case when model = '{m}' then strength end), 6) as \"{m}\"" for m in MODELS)
    return _with(FORD, FIRSTS) + f"\nselect batch_id, {cols} from cds group by batch_id"


def layer_best() -> str:
    base_list = ", ".join(f"'{m}'" for m in MODELS)
    return _layer(ALL4) + f""",
bs AS (select fusion_model, accuracy from layer where kind = 'SC' order by accuracy desc, j limit 1),
br AS (select fusion_model, accuracy from layer where kind = 'RC' order by accuracy desc, j limit 1),
bb AS (select fusion_model, accuracy from layer where kind = 'SC' and fusion_model in ({base_list})
       order by accuracy desc, j limit 1)
select bs.fusion_model as best_sc_model, round(bs.accuracy, 6) as best_sc,
       br.fusion_model as best_rc_model, round(br.accuracy, 6) as best_rc,
       bb.fusion_model as best_base_model, round(bb.accuracy, 6) as best_base,
       round(greatest(bs.accuracy, br.accuracy) - bb.accuracy, 6) as improvement
from bs, br, bb"""


def performance_series() -> str:
    base_list = ", ".join(f"'{m}'" for m in MODELS)
    parts = []
    for s in ALL4:
        parts.append(f"""select '{s}' as scheme, s.fusion_model as label, 1 as size, s.j, s.accuracy as sc, s.accuracy as rc
  from layer s where s.kind = 'SC' and s.fusion_model in ({base_list})""")
        parts.append(f"""select '{s}', split_part(s.fusion_model, '_', 1), length(split_part(s.fusion_model, '_', 1)),
         s.j, s.accuracy, r.accuracy
  from layer s join layer r on r.fusion_model = s.fusion_model and r.kind = 'RC'
  where s.kind = 'SC' and s.fusion_model like '%\\_{s}' escape '\\'""")
    return _layer(ALL4) + ",\nser AS (" + "\n union all ".join(parts) + f"""),
st AS (select max(accuracy) as best_base from layer where kind = 'SC' and fusion_model in ({base_list})),
fl AS (select min(accuracy) - 10 as floor from layer where kind = 'SC')
select scheme, size, row_number() over (partition by scheme order by size, rc, j) as position, label,
       round(sc, 6) as sc, round(rc, 6) as rc, round(st.best_base, 6) as best_base, round(fl.floor, 6) as floor
from ser, st, fl"""


QUERIES.update({"tie_counts": tie_counts, "diversity_log": diversity_log, "layer_best": layer_best,
                "performance_series": performance_series})


def reg_ksi_strength() -> str:
    return _with(FREG) + """,
st AS (select model, min(score) as lo, max(score) as hi from freg group by model),
rv AS (select f.model, (f.score - st.lo) / nullif(st.hi - st.lo, 0) as v,
              row_number() over (partition by f.model order by f.score desc, f.item_id desc) as pos
       from freg f join st on f.model = st.model),
pr AS (select a.model as ma, b.model as mb, a.pos, a.v as av, b.v as bv
       from rv a join rv b on a.pos = b.pos and a.model <> b.model),
kt AS (select *, row_number() over (partition by ma, mb order by av, pos) as t from pr),
kr AS (select *, row_number() over (partition by ma, mb order by bv, t) as r from kt),
kl AS (select *, lag(r) over (partition by ma, mb order by t) as prv from kr),
n AS (select count(*) as n from freg where model = 'P'),
xi AS (select ma, mb, 3.0 * sum(abs(r - prv)) / (n.n * n.n - 1) as d from kl, n group by ma, mb, n.n)
select mb as model, round(avg(d), 6) as strength from xi group by mb"""


QUERIES.update({"reg_ksi_strength": reg_ksi_strength})


def vote_unsupervised() -> str:
    rows = []
    combos = [c for k in range(2, len(MODELS) + 1) for c in combinations(range(len(MODELS)), k)]
    for ci, c in enumerate(combos):
        for i in c:
            rows.append(f"({ci}, '{''.join(MODELS[x] for x in c)}', '{MODELS[i]}')")
    return _with(FORD, BASE_ACC) + ",\ncm(combo, members, model) AS (VALUES " + ", ".join(rows) + """),
vc AS (select bpk.item_id, cm.combo, cm.members, bpk.pred, count(*) as n
       from bpk join cm on bpk.model = cm.model group by bpk.item_id, cm.combo, cm.members, bpk.pred),
vm AS (select item_id, combo, max(n) as mx from vc group by item_id, combo)
select vc.item_id, vc.members, min(vc.pred) as vote
from vc join vm on vc.item_id = vm.item_id and vc.combo = vm.combo and vc.n = vm.mx
group by vc.item_id, vc.members"""


QUERIES.update({"vote_unsupervised": vote_unsupervised})


def output_validity() -> str:
    return _with(FORD, BASE_ACC, FIRSTS, weights_cte(ALL4), outs_cte(ALL4), FUSED) + """,
pb AS (select floor(item_id / {b}) as batch_id, j, max(case when v is null then 1 else 0 end) as nul,
              min(v) as lo, max(v) as hi, count(*) as n
       from fv group by floor(item_id / {b}), j),
full_rows AS (select j, count(*) as n from fv group by j),
bad AS (select pb.j, max(case when pb.nul = 1 or (outn.kind = 'SC' and pb.hi = pb.lo) then 1 else 0 end) as bad
        from pb join outn on pb.j = outn.j group by pb.j)
select outn.kind, outn.fusion_model,
       coalesce(bad.bad, 1) = 0 and full_rows.n = (select count(*) from truth) * {c} as valid
from outn left join bad on bad.j = outn.j left join full_rows on full_rows.j = outn.j""".format(b=BATCH, c=N_CLASSES)


QUERIES.update({"output_validity": output_validity})


def rsc_item_ranks() -> str:
    return _with(FORD) + _curve("ranks", "item_id, model", "rnk")


QUERIES.update({"rsc_item_ranks": rsc_item_ranks})


def reg_report_rc() -> str:
    return reg_report().replace("where rfv.kind = 'SC'", "where rfv.kind = 'RC'")


QUERIES.update({"reg_report_rc": reg_report_rc})


def accuracy_sorted() -> str:
    return _layer(ALL4) + """
select kind, row_number() over (partition by kind order by accuracy, j) as position, fusion_model,
       round(accuracy, 6) as accuracy from layer"""


def _is_test(key: str) -> str:
    return f"cast('0x' || substr(md5('42:' || cast({key} as varchar)), 1, 8) as bigint) % 100 < 20"


def prep_split() -> str:
    return f"select c_custkey, {_is_test('c_custkey')} as is_test from customer"


def ml_scorers() -> str:
    return f"""with t as (select count(*) as n from embeddings where {_is_test('vec_id')}),
c as (select max(label) + 1 as k from embeddings),
m(model) as (values ('random_forest'), ('decision_tree'), ('mlp'), ('svm'), ('adaboost'))
select m.model, t.n as items, t.n * c.k as scores, cast(0 as bigint) as invalid from m, t, c"""


def ml_stump() -> str:
    entries = ", ".join(f"({i}, {i + 1})" for i in range(8))
    return f"""with e as (select vec_id, label, {_is_test('vec_id')} as test, embedding from embeddings),
x as (select e.vec_id, e.label, e.test, f.i, floor(cast(e.embedding[f.slot] as double) * 8) as v
      from e cross join (values {entries}) f(i, slot)),
val as (select distinct i, v from x where not test),
cut as (select i, v, (v + lead(v) over (partition by i order by v)) / 2 as thr from val),
side as (select c.i, c.thr, x.v <= c.thr as low, x.label, count(*) as n
         from cut c join x on x.i = c.i and not x.test where c.thr is not null group by all),
leaf as (select i, thr, low, sum(n) as n, 1 - sum(cast(n as double) * n) / (cast(sum(n) as double) * sum(n)) as gini
         from side group by i, thr, low),
best as (select i, thr from leaf group by i, thr
         order by round(sum(n * gini) / sum(n), 12), i, thr limit 1),
shares as (select s.low, s.label, s.n, sum(s.n) over (partition by s.low) as total
           from side s join best b on s.i = b.i and s.thr = b.thr),
cls as (select unnest(range(0, (select max(label) + 1 from e where not test))) as cls)
select x.vec_id as item_id, 'stump' as model, cast(cls.cls as int) as cls,
       round(coalesce(cast(sh.n as double) / sh.total, 0.0), 6) as score
from x join best b on x.i = b.i and x.test cross join cls
left join shares sh on sh.low = (x.v <= b.thr) and sh.label = cls.cls"""


def prep_columns() -> str:
    return """with n as (select user_id, count(*) as n_events from events group by user_id)
select p.p_partkey as part, p.p_brand as brand, cast(p.p_size - 1 as int) as label,
       cast(substr(p.p_brand, 7, 1) as int) as code,
       array_to_string([case when i = cast(substr(p.p_brand, 7, 1) as int) then 1 else 0 end for i in range(6)], '') as hot,
       n.n_events as target, case when p.p_brand = 'Brand#13' then 'same' else 'rest' end as side
from part p join n on p.p_partkey = n.user_id
where p.p_name is not null and p.p_size is not null and (p.p_brand like '%3' or p.p_brand in ('Brand#11', 'Brand#22'))"""


def files_layer() -> str:
    return _layer(("AC",)) + """
select s.fusion_model, round(s.accuracy, 6) as sc, round(r.accuracy, 6) as rc
from layer s left join layer r on s.fusion_model = r.fusion_model and r.kind = 'RC'
where s.kind = 'SC'"""


def files_tables() -> str:
    return """select n_name, count(*) as suppliers, min(s_suppkey) as first_key
from supplier join nation on s_nationkey = n_nationkey group by n_name"""


QUERIES.update({"ml_stump": ml_stump, "files_layer": files_layer, "files_regression": reg_report, "files_tables": files_tables})
QUERIES.update({"accuracy_sorted": accuracy_sorted, "prep_split": prep_split, "ml_scorers": ml_scorers,
                "prep_columns": prep_columns})


def vote_recursive(rounds: int = 8) -> str:
    """The rounds unrolled: a round without gain keeps no voters, so those
    after it are empty (F-ORD stops long before the last one here)."""
    combos = [c for k in range(2, len(MODELS) + 1) for c in combinations(range(len(MODELS)), k)]
    cm = ", ".join(f"({j}, {i})" for j, c in enumerate(combos) for i in c)
    names = ", ".join(f"('{m}', {i})" for i, m in enumerate(MODELS))
    parts = [f"cm(combo, i) AS (VALUES {cm})", f"nm(model, i) AS (VALUES {names})",
             "v0 AS MATERIALIZED (select bpk.item_id, nm.i, nm.model as name, bpk.pred from bpk join nm on bpk.model = nm.model)"]
    for r in range(1, rounds + 1):
        gain = "" if r == 1 else f" where (select max(correct) from acc{r}) > (select max(correct) from top{r - 1})"
        parts.append(f"""vote{r} AS MATERIALIZED (
  select item_id, combo, pred from (
    select v.item_id, cm.combo, v.pred,
           row_number() over (partition by v.item_id, cm.combo order by count(*) desc, v.pred) as rn
    from v{r - 1} v join cm on v.i = cm.i group by v.item_id, cm.combo, v.pred) where rn = 1),
mem{r} AS (select cm.combo, string_agg(d.name, '' order by cm.i) as members
           from (select distinct i, name from v{r - 1}) d join cm on d.i = cm.i group by cm.combo),
acc{r} AS (select t.combo, mem{r}.members, t.correct from (
             select combo, sum(case when pred = truth.label then 1 else 0 end) as correct
             from vote{r} join truth on vote{r}.item_id = truth.item_id group by combo) t
           join mem{r} on t.combo = mem{r}.combo),
top{r} AS MATERIALIZED (
  select * from (select combo, members, correct, row_number() over (order by correct desc, combo) as position
                 from acc{r}{gain}) where position <= 5),
v{r} AS MATERIALIZED (
  select vote{r}.item_id, top{r}.position - 1 as i, 'C{r}(' || top{r}.members || ')' as name, vote{r}.pred
  from vote{r} join top{r} on vote{r}.combo = top{r}.combo)""")
    out = " union all ".join(f"select {r} as round, position, members, correct from top{r}" for r in range(1, rounds + 1))
    return _with(FORD, BASE_ACC, *parts) + "\n" + out


QUERIES.update({"vote_recursive": vote_recursive})


def _pooled(rnd: int, layer: str, sc_above: str, rc_above: str) -> str:
    """The four best outputs of a round above the thresholds, the score list's
    and the rank list's first four each."""
    lists = ",\n".join(f"""{k.lower()}{rnd} AS (select {src} as src, *, row_number() over (order by accuracy desc, j) as rn
  from {layer} where kind = '{k}' and accuracy > {above} qualify rn <= 4)"""
                       for src, (k, above) in enumerate((("SC", sc_above), ("RC", rc_above))))
    return f"""{lists},
both{rnd} AS (select * from sc{rnd} union all select * from rc{rnd}),
pool{rnd} AS (select *, row_number() over (order by accuracy desc, src, rn) as position from both{rnd} qualify position <= 4)"""


def search_two_rounds() -> str:
    """Round 2 is a layer over the pooled matrices: the same tables, read from
    ``scores2`` inside a statement of their own."""
    outs = outs_cte(SEARCH_SCHEMES, models=("1", "2", "3", "4")).split(",\noutn AS")[0].replace("outs(j", "outs0(j", 1)
    second = ",\n".join(p.strip() for p in (
        "scores AS (select * from scores2)",
        """ranks AS (select item_id, model, cls, score, cast(row_number() over (
             partition by item_id, model order by round(score, 9) desc, cls) as double) as rnk from scores)""",
        "bacc AS (select cast(position as varchar) as model, correct, total from pool1)",
        FIRSTS, weights_cte(SEARCH_SCHEMES), outs,
        """outs AS (select * from outs0 where j not in (
             select j from outs0 where model not in (select cast(position as varchar) from pool1)))""",
        """outn AS (select o.j, o.kind, string_agg('(' || p.kind || '_' || p.fusion_model || ')', '' order by o.model)
               || coalesce('_' || any_value(o.scheme), '') as fusion_model
             from outs o join pool1 p on o.model = cast(p.position as varchar) group by o.j, o.kind)""",
        FUSED, LAYER_ACC,
        f"""bad AS (select distinct j from (select j, kind, max(case when v is null then 1 else 0 end) as nul, min(v) as lo, max(v) as hi
             from fv group by j, kind, floor(item_id / {BATCH})) where nul = 1 or (kind = 'SC' and lo = hi))"""))
    return _layer(SEARCH_SCHEMES) + f""",
thr AS (select max(cast(correct as double) / total * 100.0) as t from bacc),
{_pooled(1, "layer", "(select t from thr)", "(select t from thr)")},
above AS (select max(accuracy) as s, coalesce(max(case when src = 1 then accuracy end), (select t from thr)) as r from both1),
span AS (select floor(item_id / {BATCH}) as batch_id, j, min(v) as lo, max(v) as hi from fv
         where j in (select j from pool1) group by 1, 2),
top AS (select j, max(hi) as hi from span group by j),
scores2 AS MATERIALIZED (
  select fv.item_id, cast(p.position as varchar) as model, fv.cls,
         case when p.kind = 'SC' then (fv.v - span.lo) / nullif(span.hi - span.lo, 0)
              else 1.0 - (fv.v - 1.0) / nullif(top.hi - 1.0, 0) end as score
  from fv join pool1 p on fv.j = p.j join top on top.j = fv.j
  join span on span.j = fv.j and span.batch_id = floor(fv.item_id / {BATCH})),
layer2 AS MATERIALIZED (WITH {second}
  select layer.* from layer where j not in (select j from bad)),
{_pooled(2, "layer2", "(select s from above)", "(select r from above)")}
select 1 as round, position, kind, fusion_model, correct, round(accuracy, 6) as accuracy from pool1 union all
select 2, position, kind, fusion_model, correct, round(accuracy, 6) from pool2"""


QUERIES.update({"search_two_rounds": search_two_rounds})
