"""DuckDB oracle SQL for the preparation queries in ``queries_prepare``."""

from __future__ import annotations

from bandwise.plans.queries_prepare import _IMP
from bandwise.registry import oracle

_MED = ("med as (select 'num' as column_name, quantile_cont(num, 0.5) as median from imp "
        "union all select 'seconds', quantile_cont(seconds, 0.5) from imp)")
_MODE = """mo as (
  select 'cat' as column_name, cat as mode from (select cat, count(*) as c from imp where cat is not null
    group by cat order by c desc, cat limit 1) a
  union all
  select 'label', label from (select label, count(*) as c from imp where label is not null
    group by label order by c desc, label limit 1) b)"""

oracle("impute_median", "select column_name as \"column\", median from med", ["obs"], [_IMP, _MED])
oracle("impute_mode", "select column_name as \"column\", mode from mo", ["obs"], [_IMP, _MODE])
oracle("impute_apply", """
select id, coalesce(num, (select median from med where column_name = 'num')) as num,
       coalesce(seconds, (select median from med where column_name = 'seconds')) as seconds,
       coalesce(cat, (select mode from mo where column_name = 'cat')) as cat,
       coalesce(label, (select mode from mo where column_name = 'label')) as label
from imp""", ["obs"], [_IMP, _MED, _MODE])
oracle("maxabs_center", """
select id, (num - mn) / greatest(xn - mn, mn - nn) as num, (seconds - ms) / greatest(xs - ms, ms - ns) as seconds
from imp, (select avg(num) as mn, max(num) as xn, min(num) as nn, avg(seconds) as ms, max(seconds) as xs,
                  min(seconds) as ns from imp) s""", ["obs"], [_IMP])
_CC = """cc as (select id, coalesce(num, (select median from med where column_name = 'num')) as num,
  coalesce(seconds, (select median from med where column_name = 'seconds')) as seconds from imp)"""
oracle("whiten_fit", """
select count(*) as n, avg(num) as mean_num, avg(seconds) as mean_seconds, covar_pop(num, num) as cov_num__num,
       covar_pop(num, seconds) as cov_num__seconds, covar_pop(seconds, seconds) as cov_seconds__seconds
from cc""", ["obs"], [_IMP, _MED, _CC])
# 2x2 Cholesky in closed form: a = sqrt(v11), b = v12 / a, c = sqrt(v22 - b^2);
# whitened = (x - mean) @ inv(L^T) / 3
oracle("whiten_apply", """
select id, ((num - m1) / a) / 3 as num, (-(num - m1) * b / (a * c) + (seconds - m2) / c) / 3 as seconds
from cc, (select m1, m2, a, b, sqrt(v22 - b * b) as c from (
  select m1, m2, v22, a, v12 / a as b from (
    select avg(num) as m1, avg(seconds) as m2, sqrt(covar_pop(num, num)) as a, covar_pop(num, seconds) as v12,
           covar_pop(seconds, seconds) as v22 from cc) s1) s2) s""", ["obs"], [_IMP, _MED, _CC])

_CATS = """ct as (
  select 'cat' as column_name, v as category, cast(row_number() over (order by v) - 1 as int) as code
  from (select distinct cat as v from imp where cat is not null) a
  union all
  select 'label', v, cast(row_number() over (order by v) - 1 as int)
  from (select distinct label as v from imp where label is not null) b)"""
oracle("infer_categories", "select column_name as \"column\", category, code from ct", ["obs"], [_IMP, _CATS])
oracle("ordinal_encode", """
select i.id, cast(case when i.label is null then -1 else c.code end as int) as label
from imp i left join (
  select v, cast(row_number() over (order by v) - 1 as int) as code
  from (select distinct i2.label as v from imp i2 join obs o on i2.id = o.id
        where o.gap_raw != 888 and i2.label is not null) a) c on i.label = c.v""", ["obs"], [_IMP])

_LEVELS = ["click", "error", "purchase", "signup", "view"]  # the event types of the fixture table


def _oh(levels, null_block):
    cols = []
    for lv in levels:
        e = f"case when cat = '{lv}' then 1.0 else 0.0 end"
        if null_block:
            e = f"case when cat is null then null else {e} end"
        cols.append(f"{e} as \"cat__{lv}\"")
    return "select id, " + ", ".join(cols) + " from imp"


oracle("one_hot", _oh(_LEVELS, False), ["obs"], [_IMP])
oracle("one_hot_drop_first", _oh(_LEVELS[1:], False), ["obs"], [_IMP])
oracle("one_hot_null", _oh(_LEVELS[1:], True), ["obs"], [_IMP])

# prepare(histboost): nulls kept, no log / scaling, ordinal codes (null -> -1) fitted on folds 1..4
_TREE = """
tr as (select o.*, case when o.cat_raw = '9' then null else o.cat_raw end as c1,
         case when o.gap_raw is null then null when o.gap_raw = 888 then 'not applicable' when o.gap_raw = 999 then null
              when o.gap_raw <= 3 then 'pleural' when o.gap_raw <= 6 then 'early' else 'normal' end as c2
       from obs o),
k1 as (select v, row_number() over (order by v) - 1 as code from (select distinct c1 as v from tr where fold != 0 and c1 is not null) a),
k2 as (select v, row_number() over (order by v) - 1 as code from (select distinct c2 as v from tr where fold != 0 and c2 is not null) b)"""
_TREE_SQL = """
select t.id,
  cast(case when m_start = 99 then null else (case when m_end - m_start < 0 then m_end - m_start + 12 else m_end - m_start end) end as double) as gestation_time,
  case when hhmm >= 0 and floor(hhmm / 100) <= 23 and hhmm % 100 <= 59 then cast(floor(hhmm / 100) * 3600 + (hhmm % 100) * 60 as double) end as hhmm,
  cast(m_end as double) as m_end, cast(case when m_start = 99 then null else m_start end as double) as m_start,
  case when num_raw = 99 then null else num_raw end as num_raw,
  y as target,
  cast(case when c1 is null then -1 else k1.code end as double) as cat_raw,
  cast(case when c2 is null then -1 else k2.code end as double) as gap_raw
from tr t left join k1 on t.c1 = k1.v left join k2 on t.c2 = k2.v"""
oracle("prepare_histboost", _TREE_SQL, ["obs"], [_TREE])
oracle("prepare_wildwood", _TREE_SQL, ["obs"], [_TREE])

# prepare(nn_regressor / nn_classifier): nulls kept, log of num_raw, max-abs scaling fitted on folds
# 1..4, count of missing numerics, drop-first one-hot with null blocks, target transform
_NUMS = ["gestation_time", "hhmm", "m_end", "m_start", "num_raw"]
_NN = """
nb as (select o.id, o.fold, o.y,
  cast(case when ms is null then null when m_end - ms < 0 then m_end - ms + 12 else m_end - ms end as double) as gestation_time,
  case when hhmm >= 0 and floor(hhmm / 100) <= 23 and hhmm % 100 <= 59 then cast(floor(hhmm / 100) * 3600 + (hhmm % 100) * 60 as double) end as hhmm,
  cast(m_end as double) as m_end, cast(ms as double) as m_start,
  ln((case when num_raw = 99 then null else num_raw end) + 0.1) as num_raw,
  case when cat_raw = '9' then null else cat_raw end as c1,
  case when gap_raw is null then null when gap_raw = 888 then 'not applicable' when gap_raw = 999 then null
       when gap_raw <= 3 then 'pleural' when gap_raw <= 6 then 'early' else 'normal' end as c2
  from (select *, case when m_start = 99 then null else m_start end as ms from obs) o),
ns as (select """ + ", ".join(
    f"avg({c}) as m_{c}, greatest(max({c}) - avg({c}), avg({c}) - min({c})) as d_{c}" for c in _NUMS) + """
  from nb where fold != 0)"""


def _nn_sql(target: str) -> str:
    scaled = ", ".join(f"({c} - m_{c}) / d_{c} as {c}" for c in _NUMS)
    missing = " + ".join(f"(case when {c} is null then 1 else 0 end)" for c in _NUMS)
    oh = []
    for col, var, levels in (("cat_raw", "c1", _LEVELS[1:]), ("gap_raw", "c2", ["normal", "not applicable", "pleural"])):
        for lv in levels:
            oh.append(f"case when {var} is null then null when {var} = '{lv}' then 1.0 else 0.0 end as \"{col}__{lv}\"")
    return f"select id, {scaled}, cast({missing} as double) as num_missing, {', '.join(oh)}, {target} as target from nb, ns"


_EDGES = "[" + ", ".join(repr(20.0 * (i + 1)) for i in range(9)) + "]"
oracle("prepare_nn_regressor",
       _nn_sql("case when y / 100 > 0 then ln(1 - exp(-abs(y / 100))) + greatest(y / 100, 0) end"), ["obs"], [_NN])
oracle("prepare_nn_classifier", _nn_sql(f"cast(len(list_filter({_EDGES}, lambda e: e < y)) as double)"), ["obs"], [_NN])

# prepare(ridge / nn_eim): medians / modes fitted on folds 1..4 fill nulls, then gap, log and
# whitening x_w = (x - mean) @ inv(L^T) / 3 with L = chol(population covariance), unrolled
# below for the five numeric columns as successive one-row CTEs.
_WN = ["gestation_time", "hhmm", "m_end", "m_start", "num_raw"]
_WB = """
wb as (select o.id, o.fold, o.y,
  case when hhmm >= 0 and floor(hhmm / 100) <= 23 and hhmm % 100 <= 59 then cast(floor(hhmm / 100) * 3600 + (hhmm % 100) * 60 as double) end as hh,
  cast(m_end as double) as me, cast(case when m_start = 99 then null else m_start end as double) as ms,
  case when num_raw = 99 then null else num_raw end as nr,
  case when cat_raw = '9' then null else cat_raw end as c1,
  case when gap_raw is null then null when gap_raw = 888 then 'not applicable' when gap_raw = 999 then null
       when gap_raw <= 3 then 'pleural' when gap_raw <= 6 then 'early' else 'normal' end as c2
  from obs o),
wm as (select quantile_cont(hh, 0.5) as q_hh, quantile_cont(me, 0.5) as q_me, quantile_cont(ms, 0.5) as q_ms,
              quantile_cont(nr, 0.5) as q_nr from wb where fold != 0),
wmo as (select (select c1 from wb where fold != 0 and c1 is not null group by c1 order by count(*) desc, c1 limit 1) as mo1,
               (select c2 from wb where fold != 0 and c2 is not null group by c2 order by count(*) desc, c2 limit 1) as mo2),
wi as (select b.id, b.fold, b.y, coalesce(b.hh, m.q_hh) as hhmm, coalesce(b.me, m.q_me) as m_end,
              coalesce(b.ms, m.q_ms) as m_start, ln(coalesce(b.nr, m.q_nr) + 0.1) as num_raw,
              coalesce(b.c1, mo.mo1) as c1, coalesce(b.c2, mo.mo2) as c2
       from wb b, wm m, wmo mo),
wg as (select *, case when m_end - m_start < 0 then m_end - m_start + 12 else m_end - m_start end as gestation_time from wi)"""


def _whiten_ctes() -> list[str]:
    p = len(_WN)
    stats = ", ".join([f"avg({c}) as mu{i}" for i, c in enumerate(_WN)] + [
        f"covar_pop({_WN[i]}, {_WN[j]}) as a{i}{j}" for i in range(p) for j in range(i + 1)])
    ctes = [f"ch0 as (select {stats} from wg where fold != 0)"]
    layer = 0
    for j in range(p):  # Cholesky column j
        cols = [f"sqrt(a{j}{j}" + "".join(f" - l{j}{k} * l{j}{k}" for k in range(j)) + f") as l{j}{j}"]
        ctes.append(f"ch{layer + 1} as (select *, {cols[0]} from ch{layer})")
        layer += 1
        below = [f"(a{i}{j}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j)) + f") / l{j}{j} as l{i}{j}"
                 for i in range(j + 1, p)]
        if below:
            ctes.append(f"ch{layer + 1} as (select *, {', '.join(below)} from ch{layer})")
            layer += 1
    # V = inv(U), U = L^T upper triangular: V_jj = 1/L_jj; V_ij = -(sum_{k=i+1..j} L_ki V_kj) / L_ii
    ctes.append(f"ch{layer + 1} as (select *, " + ", ".join(f"1.0 / l{j}{j} as v{j}{j}" for j in range(p))
                + f" from ch{layer})")
    layer += 1
    for d in range(1, p):  # fill by distance from the diagonal
        cols = []
        for i in range(p - d):
            j = i + d
            cols.append(f"-(" + " + ".join(f"l{k}{i} * v{k}{j}" for k in range(i + 1, j + 1)) + f") / l{i}{i} as v{i}{j}")
        ctes.append(f"ch{layer + 1} as (select *, {', '.join(cols)} from ch{layer})")
        layer += 1
    ctes.append(f"wv as (select * from ch{layer})")
    return ctes


def _whitened_sql(levels1, levels2, target: str) -> str:
    p = len(_WN)
    outs = []
    for j, c in enumerate(_WN):
        terms = " + ".join(f"(g.{_WN[i]} - v.mu{i}) * v.v{i}{j}" for i in range(j + 1))
        outs.append(f"({terms}) / 3 as {c}")
    oh = [f"case when c1 = '{lv}' then 1.0 else 0.0 end as \"cat_raw__{lv}\"" for lv in levels1]
    oh += [f"case when c2 = '{lv}' then 1.0 else 0.0 end as \"gap_raw__{lv}\"" for lv in levels2]
    return f"select g.id, {', '.join(outs)}, {', '.join(oh)}, {target} as target from wg g, wv v"


_GAP_LEVELS = ["early", "normal", "not applicable", "pleural"]
oracle("prepare_ridge", _whitened_sql(_LEVELS, _GAP_LEVELS, "(g.y - 3260.0) / 590.0"), ["obs"],
       [_WB] + _whiten_ctes())
oracle("prepare_nn_eim", _whitened_sql(
    _LEVELS[1:], _GAP_LEVELS[1:],
    "case when g.y / 100 > 0 then ln(1 - exp(-abs(g.y / 100))) + greatest(g.y / 100, 0) end"), ["obs"],
    [_WB] + _whiten_ctes())
