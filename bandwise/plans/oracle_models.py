"""DuckDB oracle for the one-feature ridge: every penalty's leave-one-out MSE in SQL, the best
penalty (ties -> smallest), then the Gaussian interval with the normal quantile as a literal."""

from __future__ import annotations

from bandwise.plans.queries_models import _ALPHAS
from bandwise.registry import oracle

_AL = "al(k, a) as (values " + ", ".join(f"({i}, {a!r})" for i, a in enumerate(_ALPHAS)) + ")"
_D = """
d as (select id, cast(m_end as double) as x, y from obs),
st as (select count(*) as n, avg(x) as mx, avg(y) as my, covar_pop(x, x) * count(*) as sxx,
              covar_pop(x, y) * count(*) as sxy from d),
fk as (select al.k, al.a, st.sxy / (st.sxx + al.a) as b from al, st),
loo as (select fk.k, avg(power(((d.y - st.my) - fk.b * (d.x - st.mx))
                    / (1 - (1.0 / st.n + (d.x - st.mx) * (d.x - st.mx) / (st.sxx + fk.a))), 2)) as mse
        from d, st, fk group by fk.k),
best as (select fk.b, loo.mse from loo join fk on loo.k = fk.k order by loo.mse, loo.k limit 1)"""
_Z = "1.6448536269514722"  # the 95 % point of the standard normal
oracle("ridge_interval", f"""
select d.id, st.my + best.b * (d.x - st.mx) as mid,
       st.my + best.b * (d.x - st.mx) - {_Z} * sqrt(best.mse) as lower,
       st.my + best.b * (d.x - st.mx) + {_Z} * sqrt(best.mse) as upper
from d, st, best""", ["obs"], [_AL, _D])


# ------------------------------------------------------------------ mixture pieces from a fixed start
import math  # noqa: E402

from bandwise.plans.oracle_core import erf as _erf  # noqa: E402
from bandwise.plans.queries_models import (FIXED_B, FIXED_MEANS, FIXED_VARS, FIXED_W,  # noqa: E402
                                           FIXED_WEIGHTS)

_COLS = ["a", "b", "c"]
_MIX = ("mx as (select id, (case when num_raw = 99 then null else num_raw end) / 10 as a, "
        "(case when hhmm >= 0 and floor(hhmm / 100) <= 23 and hhmm % 100 <= 59 then "
        "cast(floor(hhmm / 100) * 3600 + (hhmm % 100) * 60 as double) end) / 3600 as b, y / 100 as c from obs)")


def _loglik(c):
    t = [repr(math.log(FIXED_WEIGHTS[c]))]
    for j, x in enumerate(_COLS):
        m, v = FIXED_MEANS[c][j], FIXED_VARS[c][j]
        t.append(f"coalesce(-(({x}) - {m!r}) * (({x}) - {m!r}) / {v!r} / 2 - {math.log(2 * math.pi * v)!r} / 2, 0)")
    return " + ".join(t)


_RESP = (f"ll as (select *, {_loglik(0)} as l0, {_loglik(1)} as l1 from mx), "
         "rs as (select *, exp(l0 - greatest(l0, l1)) / (exp(l0 - greatest(l0, l1)) + exp(l1 - greatest(l0, l1))) as r0, "
         "exp(l1 - greatest(l0, l1)) / (exp(l0 - greatest(l0, l1)) + exp(l1 - greatest(l0, l1))) as r1 from ll)")


def _em_rows():
    parts = []
    for c in range(2):
        for j, x in enumerate(_COLS):
            m_old, v_old = FIXED_MEANS[c][j], FIXED_VARS[c][j]
            xt = f"coalesce({x}, {m_old!r})"
            parts.append(
                f"select {c} as component, '{x}' as column_name, sr, s1 / sr as mean, "
                f"(s2 - 2 * (s1 / sr) * s1 + (s1 / sr) * (s1 / sr) * sr) / sr + sm * {v_old!r} / sr + 1e-5 as var, "
                f"sr / n as weight from (select sum(r{c}) as sr, sum(r{c} * {xt}) as s1, sum(r{c} * {xt} * {xt}) as s2, "
                f"sum(case when {x} is null then r{c} else 0 end) as sm, count(*) as n from rs) t{c}{j}")
    return " union all ".join(parts)


oracle("em_step", f"select component, column_name, mean, var, weight from ({_em_rows()}) e", ["obs"],
       [_MIX, _RESP])


def _er_unit(u):
    terms = []
    for c in range(2):
        mean = [repr(FIXED_B[u])] + [f"coalesce({x}, {FIXED_MEANS[c][j]!r}) * {FIXED_W[j][u]!r}"
                                      for j, x in enumerate(_COLS)]
        var = [f"(case when {x} is null then {FIXED_VARS[c][j] * FIXED_W[j][u] ** 2!r} else 0.0 end)"
               for j, x in enumerate(_COLS)]
        m, v = "(" + " + ".join(mean) + ")", "(" + " + ".join(var) + ")"
        w = f"({m} / sqrt({v}))"
        er = (f"(case when {v} = 0 then ({m} + abs({m})) / 2 else sqrt({v}) * (exp(-({w} * {w}) / 2) / sqrt(2 * pi())"
              f" + ({w} / 2) * (1 + {_erf(w + ' / sqrt(2)')})) end)")
        terms.append(f"r{c} * {er}")
    return " + ".join(terms)


oracle("expected_relu_fixed", f"select id, {_er_unit(0)} as h0, {_er_unit(1)} as h1 from rs", ["obs"], [_MIX, _RESP])


# ------------------------------------------------------------------ conformal wrapper around a two-feature ridge
_CW = f"""
cd as (select id, cast(m_end as double) as x1, num_raw as x2, y, part from obs),
cs as (select count(*) as n, avg(x1) as m1, avg(x2) as m2, avg(y) as my,
              covar_pop(x1, x1) * count(*) as s11, covar_pop(x1, x2) * count(*) as s12,
              covar_pop(x2, x2) * count(*) as s22, covar_pop(x1, y) * count(*) as s1y,
              covar_pop(x2, y) * count(*) as s2y from cd where part = 'fit'),
cdet as (select al.k, al.a, (cs.s11 + al.a) * (cs.s22 + al.a) - cs.s12 * cs.s12 as det from al, cs),
cf as (select c.k, c.a, ((cs.s22 + c.a) * cs.s1y - cs.s12 * cs.s2y) / c.det as b1,
              ((cs.s11 + c.a) * cs.s2y - cs.s12 * cs.s1y) / c.det as b2,
              (cs.s22 + c.a) / c.det as i11, -cs.s12 / c.det as i12, (cs.s11 + c.a) / c.det as i22
       from cdet c, cs),
cl as (select cf.k, avg(power(((d.y - cs.my) - cf.b1 * (d.x1 - cs.m1) - cf.b2 * (d.x2 - cs.m2))
          / (1 - (1.0 / cs.n + cf.i11 * (d.x1 - cs.m1) * (d.x1 - cs.m1)
                  + 2 * cf.i12 * (d.x1 - cs.m1) * (d.x2 - cs.m2) + cf.i22 * (d.x2 - cs.m2) * (d.x2 - cs.m2))), 2)) as mse
       from cd d, cs, cf where d.part = 'fit' group by cf.k),
cb as (select cf.b1, cf.b2, cl.mse from cl join cf on cl.k = cf.k order by cl.mse, cl.k limit 1),
cp as (select d.id, d.y, d.part, cs.my + cb.b1 * (d.x1 - cs.m1) + cb.b2 * (d.x2 - cs.m2) as mid,
              {_Z} * sqrt(cb.mse) as half from cd d, cs, cb),
cq as (select score as qhat from (
         select *, row_number() over (order by score, id) as r, count(*) over () as n
         from (select id, greatest((mid - half) - y, y - (mid + half)) as score from cp where part = 'cal') s) t
       where r = least(n, cast(ceil((n + 1) * 0.9 - 1e-9) as bigint)))"""
oracle("conformal_wrapper", "select id, mid - half - qhat as lower, mid, mid + half + qhat as upper from cp, cq",
       ["obs"], [_AL, _CW])


# ------------------------------------------------------------------ one SHASH gradient from the fixed start
_AT = [[0.02, -0.01, 0.6], [0.01, 0.02, -0.4], [0.03, -0.02, 0.1], [-0.02, 0.01, 0.2]]
_HEAD = ", ".join(f"{w[0]} * a + {w[1]} * b + {w[2]} as h{i}" for i, w in enumerate(_AT))
_G = f"""
g0 as (select a, b, t, {_HEAD} from (select cast(m_end as double) as a, cast(grp % 10 as double) as b, y / 100 as t from obs) o),
g1 as (select *, 1 / (1 + exp(-h1)) as ss, 1 / (1 + exp(-h2)) as sk, 1 / (1 + exp(-h3)) as st from g0),
g2 as (select *, ss + 0.001 as s, sk - 0.5 as k, 0.95 + 0.1 * st as tail from g1),
g3 as (select *, (t - h0) / (s * tail) as z from g2),
g4 as (select *, sinh(tail * asinh(z) - k) as sh, cosh(tail * asinh(z) - k) as ch from g3),
g5 as (select *, sh * sh * sh / (1 + sh * sh) as d from g4),
g6 as (select *, d * ch * tail / sqrt(1 + z * z) + z / (1 + z * z) as gz from g5),
g7 as (select a, b, [-gz / (s * tail), (-gz * z / s + 1 / s) * ss * (1 - ss), -d * ch * sk * (1 - sk),
                     (-gz * z / tail + d * ch * asinh(z)) * 0.1 * st * (1 - st)] as g from g6)"""
oracle("shash_gradient", " union all ".join(
    f"select {h} as head, {j} as term, avg(g[{h + 1}] * {x}) as g from g7" for h in range(4) for j, x in enumerate(("a", "b", "1.0"))),
    ["obs"], [_G])


# ------------------------------------------------------------------ validation and averaging over three folds, of group bands
_GROUPS = [
    "t as (select id, cat, y, fold, cast(('0x' || substr(md5(cast(id as varchar)), 1, 8))::bigint % 3 as int) as f from obs)",
    "g as (select ff.f, t.cat, count(y) as n, sum(y) as s, sum(y * y) as q from t "
    "join (select distinct f from t where fold <> 0) ff on t.f <> ff.f where t.fold <> 0 group by ff.f, t.cat)",
    f"b as (select f, cat, s / n as mid, {_Z} * sqrt(greatest(q / n - (s / n) * (s / n), 0)) as half from g)",
    "oof as (select t.id, t.y, t.f, mid - half as lower, mid, mid + half as upper from t join b on t.f = b.f and t.cat = b.cat where t.fold <> 0)",
]
oracle("stack_out_of_fold_groups", "select id, f as sfold, lower, mid, upper from oof", ["obs"], _GROUPS)
oracle("predict_fold_average_groups", """
select t.id, avg(mid - half) as lower, avg(mid + half) as upper from t join b on t.cat = b.cat where t.fold = 0 group by t.id""", ["obs"], _GROUPS)
oracle("cross_validate_groups", """
select f as fold, avg(upper - lower + 2 / 0.1 * (greatest(lower - y, 0) + greatest(y - upper, 0))) as winkler,
  avg(case when y >= lower and y <= upper then 1.0 else 0.0 end) as coverage, count(*) as n
from oof group by rollup (f)""", ["obs"], _GROUPS)
