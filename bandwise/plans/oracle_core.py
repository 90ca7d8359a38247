"""DuckDB oracle SQL for the queries in ``queries_core`` (independent formulations)."""

from __future__ import annotations

from bandwise.constants import BIN_LABELS
from bandwise.registry import oracle

# FIXED VALUES, written here on their own so that the oracle shares no code with what it checks:
# erf approximation 7.1.26 of Abramowitz and Stegun; the 95 % point of the standard normal
AS_P = 0.3275911
AS_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
Z95 = 1.6448536269514722

SCORED = "scored as (select p.*, o.y, o.part, o.grp from preds p join obs o on p.id = o.id)"
QHAT = """
sc as (select p.model_id, p.id, greatest(p.lo - o.y, o.y - p.hi) as score
       from preds p join obs o on p.id = o.id where o.part = 'cal'),
rk as (select *, row_number() over (partition by model_id order by score, id) as r,
              count(*) over (partition by model_id) as n from sc),
qhat as (select model_id, score as qhat, n as n_cal from rk
         where r = least(n, cast(ceil((n + 1) * 0.9 - 1e-9) as bigint)))
"""


def win(y="y", lo="lo", hi="hi", a="0.1"):
    y, lo, hi = f"({y})", f"({lo})", f"({hi})"
    return (f"(abs({hi} - {lo})"
            f" + case when {y} < least({lo}, {hi}) then (2 / {a}) * (least({lo}, {hi}) - {y}) else 0 end"
            f" + case when {y} > greatest({lo}, {hi}) then (2 / {a}) * ({y} - greatest({lo}, {hi})) else 0 end)")


def cov(y="y", lo="lo", hi="hi"):
    y, lo, hi = f"({y})", f"({lo})", f"({hi})"
    return f"(case when {y} between least({lo}, {hi}) and greatest({lo}, {hi}) then 1.0 else 0.0 end)"


def pin(y, q, tau):
    y, q = f"({y})", f"({q})"
    return f"(case when {y} >= {q} then {tau} * ({y} - {q}) else (1 - {tau}) * ({q} - {y}) end)"


def softplus(x):
    return f"(ln(1 + exp(-abs({x}))) + greatest({x}, 0))"


def shq(z, c="center", s="spread", k="skew", t="tail"):
    return f"({c} + {t} * ({s} + 0.001) * sinh(asinh({z}) / {t} + {k} / {t}))"


def erf(x):
    t = f"(1.0 / (1.0 + {AS_P} * abs({x})))"
    a1, a2, a3, a4, a5 = AS_A
    poly = f"(((((({a5}) * {t} + ({a4})) * {t} + ({a3})) * {t} + ({a2})) * {t} + ({a1})) * {t})"
    y = f"(1.0 - {poly} * exp(-abs({x}) * abs({x})))"
    return f"(case when {x} < 0 then -{y} else {y} end)"


def list_lit(vals):
    return "[" + ", ".join(repr(float(v)) for v in vals) + "]"


# ------------------------------------------------------------------ flagship
oracle("calibrated_winkler", f"""
select s.model_id, q.qhat, q.n_cal, s.winkler, s.coverage, s.n from (
  select p.model_id, avg({win('o.y', 'p.lo - q.qhat', 'p.hi + q.qhat')}) as winkler,
         avg({cov('o.y', 'p.lo - q.qhat', 'p.hi + q.qhat')}) as coverage, count(*) as n
  from preds p join obs o on p.id = o.id join qhat q on q.model_id = p.model_id
  where o.part = 'fit' group by p.model_id) s
join qhat q on q.model_id = s.model_id""", ["preds"], [QHAT])

# ------------------------------------------------------------------ scores
oracle("winkler_score", f"select model_id, avg({win()}) as winkler, avg({cov()}) as coverage, count(*) as n "
       "from scored group by model_id", ["preds"], [SCORED])
oracle("coverage", f"select model_id, fold, avg({cov()}) as coverage from scored group by model_id, fold",
       ["preds"], [SCORED])
oracle("assert_finite", """
select model_id, cast(sum(case when y is null or lo is null or hi is null or isnan(y) or isnan(lo) or isnan(hi)
  or isinf(y) or isinf(lo) or isinf(hi) then 1 else 0 end) as bigint) as n_bad, count(*) as n
from scored group by model_id""", ["preds"], [SCORED])
oracle("performance_summary", f"select model_id, fold, avg({win()}) as winkler, avg({cov()}) as coverage, count(*) as n "
       "from scored group by grouping sets ((model_id, fold), (model_id))", ["preds"], [SCORED])
oracle("pinball_loss", f"""
select model_id, avg({pin('y', 'lo', 0.05)}) as pinball_lo, avg({pin('y', 'mid', 0.5)}) as pinball_mid,
       avg({pin('y', 'hi', 0.95)}) as pinball_hi
from scored group by model_id""", ["preds"], [SCORED])
oracle("d2_pinball", f"""
select s.model_id, avg({pin('s.y', 's.lo', 0.05)}) as pinball, avg({pin('s.y', 'b.base', 0.05)}) as pinball_base,
       1 - avg({pin('s.y', 's.lo', 0.05)}) / avg({pin('s.y', 'b.base', 0.05)}) as d2_pinball
from scored s join (select model_id, quantile_cont(y, 0.05) as base from scored group by model_id) b
  on s.model_id = b.model_id
group by s.model_id""", ["preds"], [SCORED])
oracle("mse_rmse", "select model_id, avg((y - mid) * (y - mid)) as mse, sqrt(avg((y - mid) * (y - mid))) as rmse "
       "from scored group by model_id", ["preds"], [SCORED])
_PER_FOLD = f"pf as (select model_id, fold, avg({win()}) as w from scored group by model_id, fold)"
oracle("mean_over_folds", "select model_id as candidate, avg(w) as mean_score, count(*) as n_folds from pf "
       "group by model_id", ["preds"], [SCORED, _PER_FOLD])
oracle("best_candidate", "select model_id as candidate, avg(w) as mean_score from pf group by model_id "
       "order by mean_score, candidate limit 1", ["preds"], [SCORED, _PER_FOLD])
oracle("target_quantiles", """
select quantile_cont(y, 0.05) as q05, quantile_cont(y, 0.95) as q95, avg(y) as mean_y,
       quantile_cont(y, 0.05) - avg(y) as off_lo, quantile_cont(y, 0.95) - avg(y) as off_hi
from obs""", ["obs"])
oracle("column_stats", """
select avg(y) as mean_y, avg(num) as mean_num, greatest(max(num) - avg(num), avg(num) - min(num)) as max_abs_dev_num,
       min(num) as min_num, max(num) as max_num
from (select y, case when num_raw = 99 then null else num_raw end as num from obs) t""", ["obs"])

# ------------------------------------------------------------------ conformal
oracle("conformal_fit", "select model_id, qhat, n_cal from qhat", ["preds"], [QHAT])
oracle("conformal_apply", """
select p.id, p.model_id, p.lo - q.qhat as lo, p.hi + q.qhat as hi
from preds p join obs o on p.id = o.id join qhat q on q.model_id = p.model_id where o.part = 'fit'""",
       ["preds"], [QHAT])
oracle("conformal_abs_residual", """
select model_id, score as qhat, n as n_cal from (
  select *, row_number() over (partition by model_id order by score, id) as r, count(*) over (partition by model_id) as n
  from (select model_id, id, abs(y - mid) as score from scored where part = 'cal') s) t
where r = least(n, cast(ceil((n + 1) * 0.9 - 1e-9) as bigint))""", ["preds"], [SCORED])
oracle("conformal_global", """
select score as qhat, n as n_cal from (
  select *, row_number() over (order by score, id, model_id) as r, count(*) over () as n
  from (select model_id, id, greatest(lo - y, y - hi) as score from scored where part = 'cal') s) t
where r = least(n, cast(ceil((n + 1) * 0.9 - 1e-9) as bigint))""", ["preds"], [SCORED])
_BYG = """
bg as (select *, case when grp % 3 != 0 then 'hot' when fold = 1 then null else 'g' || fold end as key,
         round(greatest(lo - y, y - hi), 0) as score from scored),
bgr as (select *, row_number() over (partition by key order by score, id, model_id) as r, count(*) over (partition by key) as n
        from bg where part = 'cal'),
bgq as (select key, score as qhat, n as n_cal from bgr where r = least(n, cast(ceil((n + 1) * 0.9 - 1e-9) as bigint)))"""
oracle("conformal_by_group", "select key, qhat, n_cal from bgq", ["preds"], [SCORED, _BYG])
oracle("conformal_apply_by_group", """
select b.id, b.model_id, b.key, b.lo - q.qhat as lo, b.hi + q.qhat as hi
from bg b join bgq q on b.key is not distinct from q.key where b.part = 'fit'""", ["preds"], [SCORED, _BYG])
oracle("conformal_two_sided", """
select model_id, n as n_cal,
  max(case when rl = least(n, cast(ceil((n + 1) * 0.95 - 1e-9) as bigint)) then lo - y end) as qhat_lower,
  max(case when ru = least(n, cast(ceil((n + 1) * 0.95 - 1e-9) as bigint)) then y - hi end) as qhat_upper
from (select *, row_number() over (partition by model_id order by lo - y, id) as rl,
        row_number() over (partition by model_id order by y - hi, id) as ru, count(*) over (partition by model_id) as n
      from scored where part = 'cal') t
group by model_id, n""", ["preds"], [SCORED])
_E = "ev as (select model_id, id, y, lo, hi, mid, abs((hi + lo - 2 * y) / (hi - lo)) as e from scored)"
_KB = f"""
er as (select *, row_number() over (partition by model_id order by e, id) as rk,
              count(*) over (partition by model_id) as n from ev),
cuts as (select model_id,
  max(case when rk = cast(round_even((n - 1) * {0.9 - 0.03!r}, 0) as bigint) + 1 then e end) as klo,
  max(case when rk = cast(round_even((n - 1) * {0.9 + 0.03!r}, 0) as bigint) + 1 then e end) as khi
  from er group by model_id),
kb as (select ev.model_id, avg(case when ev.e >= c.klo and ev.e <= c.khi then ev.e end) as k_b
       from ev join cuts c on ev.model_id = c.model_id group by ev.model_id)"""
oracle("trimmed_band_mean", "select model_id, k_b from kb", ["preds"], [SCORED, _E, _KB])
oracle("eim_score", "select ev.model_id, avg(kb.k_b * (hi - lo) + abs(y - mid)) as eim from ev "
       "join kb on ev.model_id = kb.model_id group by ev.model_id", ["preds"], [SCORED, _E, _KB])


# ------------------------------------------------------------------ HDI and draws
def _hdi_sql(src: str, key: str, val: str, tie: str) -> str:
    return f"""
select {key}, lower, upper from (
  select a.{key}, a.rk as i, a.{val} as lower, b.{val} as upper,
         row_number() over (partition by a.{key} order by b.{val} - a.{val}, a.rk) as o
  from (select *, row_number() over (partition by {key} order by {val}, {tie}) as rk,
               count(*) over (partition by {key}) as n from {src}) a
  join (select {key}, {val}, row_number() over (partition by {key} order by {val}, {tie}) as rk from {src}) b
    on a.{key} = b.{key} and b.rk = a.rk + cast(floor(a.n * 0.9) as bigint)) t
where o = 1"""


oracle("hdi", _hdi_sql("obs", "cat", "y", "id"), ["obs"])
_DRAWS = f"dr as (select s.id, g.draw, {softplus(shq('g.z'))} * 1000 as v from shash s, zgrid g)"
oracle("sample_intervals", _hdi_sql("dr", "id", "v", "draw"), ["shash", "zgrid"], [_DRAWS])
_STACK = f"""st as (select s.id, m.model_id, g.draw,
  {softplus(shq('g.z', c='(s.center + 0.05 * m.model_id)'))} * 1000 as value
  from shash s, zgrid g, (select 0 as model_id union all select 1 union all select 2) m)"""
oracle("stack_draws", "select id, model_id, draw, value from st", ["shash", "zgrid"], [_STACK])
oracle("pooled_hdi", _hdi_sql("st", "id", "value", "model_id, draw"), ["shash", "zgrid"], [_STACK])
oracle("pooled_hdi_long", _hdi_sql("st", "id", "value", "model_id, draw"), ["shash", "zgrid"], [_STACK])

_z_lo, _z_hi = -Z95, Z95
_STEP = 2 * (0.05 - 1e-6) / 19
_SHIFTS = "sh(k, zl, zh) as (values " + ", ".join(
    f"({k}, {_z_lo + 0.05 - 1e-6 - k * _STEP!r}, {_z_hi + 0.05 - 1e-6 - k * _STEP!r})" for k in range(20)) + ")"
oracle("min_width_shift", f"""
select id, k, lower, upper from (
  select id, k, lower, upper, row_number() over (partition by id order by upper - lower, k) as o from (
    select s.id, h.k, {softplus(shq('h.zl'))} * 1000 as lower, {softplus(shq('h.zh'))} * 1000 as upper
    from shash s, sh h) c) t
where o = 1""", ["shash"], [_SHIFTS])

# ------------------------------------------------------------------ bins
_CUM = """bc as (select grp, bin, p, cum, cum - p as cum0, max(cum) over (partition by grp) as total from (
  select grp, bin, p, sum(p) over (partition by grp order by bin rows between unbounded preceding and current row) as cum
  from binprob) t)"""
oracle("narrowest_bin_band", """
select grp, cast(i as int) as lower_bin, cast(j as int) as upper_bin, cast(i as double) as lower, cast(j as double) as upper
from (select grp, i, j, row_number() over (partition by grp order by j - i, i) as o from (
  select a.grp, a.bin as i, min(b.bin) as j from bc a join bc b
    on a.grp = b.grp and b.bin >= a.bin and b.cum >= a.cum0 + (0.9 - 1e-9)
  where a.total - a.cum0 >= 0.9 - 1e-9 group by a.grp, a.bin) e) t
where o = 1""", ["binprob"], [_CUM])
oracle("median_bin", """
select grp, cast(bin as int) as median_bin from (
  select grp, bin, row_number() over (partition by grp order by abs(cum - 0.5), bin) as o from bc) t where o = 1""",
       ["binprob"], [_CUM])
_MODE = """mb as (select grp, cast(bin as int) as mode_bin from (
  select grp, bin, row_number() over (partition by grp order by p desc, bin) as o from binprob) t where o = 1)"""
oracle("mode_bin", "select grp, mode_bin from mb", ["binprob"], [_MODE])
_EDGES = list_lit([(a + b) / 2 for a, b in zip(BIN_LABELS, BIN_LABELS[1:])])
_LABELS = list_lit(BIN_LABELS)
oracle("bin_index", f"""
select id, cast(len(list_filter({_EDGES}, lambda e: e < w)) as int) as bin,
       {_LABELS}[len(list_filter({_EDGES}, lambda e: e < w)) + 1] as bin_value
from (select id, y * 10 as w from obs) t""", ["obs"])
oracle("bin_value", f"select grp, {_LABELS}[mode_bin * 10 + 1] as bin_value from mb", ["binprob"], [_MODE])
oracle("bin_range_join", f"""
select id, cast(len(list_filter({_EDGES}, lambda e: e < w)) as int) as bin from (select id, y * 10 as w from obs) t""",
       ["obs"])

# ------------------------------------------------------------------ predictions tables
oracle("union_folds", "select id, model_id, fold, lo, hi from scored", ["preds"], [SCORED])
oracle("average_intervals", "select id, avg(lo) as lower, avg(hi) as upper from preds group by id", ["preds"])

# ------------------------------------------------------------------ scalars
oracle("softplus", f"""
select id, x, {softplus('x')} as sp,
  case when {softplus('x')} > 0 then ln(1 - exp(-abs({softplus('x')}))) + greatest({softplus('x')}, 0) end as sp_inv
from (select id, y / 100 - 1 as x from obs) t""", ["obs"])
oracle("zscore_fixed", "select id, (w - 3260) / 590 as z, ((w - 3260) / 590) * 590 + 3260 as back "
       "from (select id, y * 10 as w from obs) t", ["obs"])
oracle("scale_1000", "select id, y / 1000 as down, (y / 1000) * 1000 as up from obs", ["obs"])
_SEC = ("(case when hhmm >= 0 and floor(hhmm / 100) <= 23 and hhmm % 100 <= 59 "
        "then cast(floor(hhmm / 100) * 3600 + (hhmm % 100) * 60 as double) end)")
oracle("hhmm_to_seconds", f"select id, hhmm, {_SEC} as seconds from obs", ["obs"])
oracle("recode_interval", """
select id, case when gap_raw is null then null when gap_raw = 888 then 'not applicable' when gap_raw = 999 then '999'
  when gap_raw <= 3 then 'pleural' when gap_raw <= 6 then 'early' else 'normal' end as label from obs""", ["obs"])
oracle("cyclic_gap", """
select id, cast(case when d < 0 then d + 12 else d end as double) as gap from (
  select id, m_end - (case when m_start = 99 then null else m_start end) as d from obs) t""", ["obs"])
oracle("log_shift", "select id, ln((case when num_raw = 99 then null else num_raw end) + 0.1) as logged from obs",
       ["obs"])
oracle("sentinel_to_null", "select id, case when cat_raw = '9' then null else cat_raw end as cat, "
       "case when num_raw = 99 then null else num_raw end as num from obs", ["obs"])
oracle("count_missing", f"""
select id, cast((case when cat_raw = '9' then 1 else 0 end) + (case when num_raw = 99 then 1 else 0 end)
  + (case when {_SEC} is null then 1 else 0 end) + (case when m_start = 99 then 1 else 0 end) as int) as n_missing
from obs""", ["obs"])

# ------------------------------------------------------------------ distribution functions
oracle("normal_draws", """
select id, draw, sqrt(-2 * ln((a + 0.5) / 281474976710656.0::double)) * cos(2 * pi() * ((b + 0.5) / 281474976710656.0::double)) as z
from (select id, draw, ('0x' || substr(m, 1, 12))::bigint::double as a, ('0x' || substr(m, 13, 12))::bigint::double as b
      from (select id, draw, md5('7|' || id || '|' || draw) as m from obs, (select unnest(range(20))::int as draw) t) h) u""", ["obs"])
oracle("normal_ppf", f"select cat, {_z_lo!r} as z_lo, {_z_hi!r} as z_hi, count(*) as n from obs group by cat",
       ["obs"])
oracle("gaussian_interval", f"""
select s.id, s.model_id, s.mid - {_z_hi!r} * r.rmse as lower, s.mid + {_z_hi!r} * r.rmse as upper
from scored s join (select model_id, sqrt(avg((y - mid) * (y - mid))) as rmse from scored where part = 'fit'
                    group by model_id) r on s.model_id = r.model_id
where s.part = 'cal'""", ["preds"], [SCORED])
oracle("shash_quantile", f"select id, {shq(repr(_z_lo))} as q05, {shq('0.0')} as q50, {shq(repr(_z_hi))} as q95 "
       "from shash", ["shash"])


def _nll(tail):
    s = "(spread + 0.001)"
    z = f"((y1 - center) / ({s} * {tail}))"
    sz = f"sinh({tail} * asinh({z}) - skew)"
    return (f"-(ln(1 + {sz} * {sz}) / 2 - ({sz} * {sz}) / 2 - ln({s}) - ln(2 * pi()) / 2"
            f" - ln(1 + {z} * {z}) / 2)")


oracle("shash_nll", f"select id, {_nll('tail')} as nll, {_nll('1.0')} as nll3 from shash", ["shash"])
oracle("shash_heads", """
select id, 1 / (1 + exp(-(y1 - 2))) as spread, 1 / (1 + exp(y1 - 2)) - 0.5 as skew,
       0.95 + 0.1 / (1 + exp(-((y1 - 2) / 2))) as tail from shash""", ["shash"])
oracle("monotone_heads", f"""
select id, y1 - 2 as lower, y1 - 2 + {softplus('skew')} as median,
       y1 - 2 + {softplus('skew')} + {softplus('(center - 1)')} as upper from shash""", ["shash"])
_W = "(mu / sqrt(s2))"
oracle("expected_relu", f"""
select id, case when s2 = 0 then (mu + abs(mu)) / 2
  else sqrt(s2) * (exp(-({_W} * {_W}) / 2) / sqrt(2 * pi()) + ({_W} / 2) * (1 + {erf(_W + ' / sqrt(2)')})) end as er
from (select id, y / 100 - 2 as mu, cast(id % 4 as double) * 0.25 as s2 from obs) t""", ["obs"])


def _term(x, m, v):
    return f"coalesce(-(({x}) - {m}) * (({x}) - {m}) / {v} / 2 - ln(2 * pi() * {v}) / 2, 0)"


oracle("gaussian_loglik_masked", f"""
select id, {_term('(case when num_raw = 99 then null else num_raw end) / 10', 2.0, 1.5)}
  + {_term('y / 100', 0.5, 0.25)} + {_term(_SEC + ' / 3600', 12.0, 40.0)} as ll from obs""", ["obs"])
oracle("softmax_weights", """
select id, exp(l0 - t) / s as w0, exp(l1 - t) / s as w1, exp(l2 - t) / s as w2 from (
  select *, exp(l0 - t) + exp(l1 - t) + exp(l2 - t) as s from (
    select id, l0, l1, l2, greatest(l0, l1, l2) as t from (
      select id, y1 as l0, skew * 3 as l1, center * 2 as l2 from shash) a) b) c""", ["shash"])
oracle("eim_warmup_loss", """
select model_id, avg((lo - (m - 30)) * (lo - (m - 30)) + (hi - (m + 60)) * (hi - (m + 60)) + abs(mid - y)) as loss
from scored, (select avg(y) as m from scored) a group by model_id""", ["preds"], [SCORED])
