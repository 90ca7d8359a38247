"""Distribution functions as column expressions.

SHASH (sinh-arcsinh) parameterisation used throughout: ``center``, ``spread`` (> 0),
``skew``, ``tail`` (> 0). Quantile at standard-normal value z:
``center + tail*spread' * sinh(asinh(z)/tail + skew/tail)`` with ``spread' = spread + 1e-3``.
"""

from __future__ import annotations

import math
from statistics import NormalDist
from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from bandwise.functions.scalars import _c, sigmoid, softplus

SPREAD_OFFSET = 1e-3
LOG_2PI = math.log(2.0 * math.pi)
SQRT_2PI = math.sqrt(2.0 * math.pi)

# FIXED VALUES: Abramowitz & Stegun 7.1.26 rational approximation of erf (|error| <= 1.5e-7)
AS_P = 0.3275911
AS_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_draw(seed: int, key, draw) -> Column:
    """Standard-normal draw as a function of (seed, key, draw index): Box-Muller over two uniforms
    made of 48 bits each of the md5 of ``seed|key|draw``. A recomputed task reproduces it; no state,
    no driver round trip."""
    digits = F.md5(F.concat_ws("|", F.lit(str(seed)), _c(key).cast("string"), _c(draw).cast("string")).cast("binary"))
    u1, u2 = ((F.conv(F.substring(digits, at, 12), 16, 10).cast("double") + 0.5) / F.lit(2.0 ** 48) for at in (1, 13))
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)


def normal_ppf(p: float) -> float:
    """Standard normal quantile, computed once on the driver and used as a literal."""
    return NormalDist().inv_cdf(p)


def erf(x) -> Column:
    """erf via Abramowitz-Stegun 7.1.26 (Spark has no built-in erf)."""
    x = _c(x)
    ax = F.abs(x)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(AS_P) * ax)
    poly = F.lit(AS_A[4])
    for a in reversed(AS_A[:4]):
        poly = poly * t + F.lit(a)
    poly = poly * t
    y = F.lit(1.0) - poly * F.exp(-ax * ax)
    return F.when(x < 0, -y).otherwise(y)


def expected_relu(mu, sigma_sq) -> Column:
    """E[max(0, X)] for X ~ N(mu, sigma_sq); plain relu when sigma_sq == 0."""
    mu, s2 = _c(mu), _c(sigma_sq)
    s = F.sqrt(s2)
    w = mu / s
    val = s * (F.exp(-(w * w) / 2.0) / F.lit(SQRT_2PI) + (w / 2.0) * (F.lit(1.0) + erf(w / F.lit(math.sqrt(2.0)))))
    return F.when(s2 == 0, (mu + F.abs(mu)) / 2.0).otherwise(val)


def gaussian_loglik_masked(xs: Sequence, mus: Sequence, variances: Sequence) -> Column:
    """Diagonal normal log-density of a row; terms with a missing value contribute 0."""
    total = None
    for x, m, v in zip(xs, mus, variances):
        x, m, v = _c(x), _c(m), _c(v)
        term = -((x - m) * (x - m)) / v / 2.0 - F.log(F.lit(2.0 * math.pi) * v) / 2.0
        term = F.coalesce(term, F.lit(0.0))
        total = term if total is None else total + term
    return total


def softmax_weights(logits: Sequence) -> list[Column]:
    """Row-local softmax of a list of columns, shifted by the row maximum for stability."""
    ls = [_c(c) for c in logits]
    top = F.greatest(*ls) if len(ls) > 1 else ls[0]
    exps = [F.exp(c - top) for c in ls]
    denom = exps[0]
    for e in exps[1:]:
        denom = denom + e
    return [e / denom for e in exps]


def shash_quantile(z, center, spread, skew, tail, offset: float = SPREAD_OFFSET) -> Column:
    z, c, s, k, t = map(_c, (z, center, spread, skew, tail))
    return c + t * (s + F.lit(offset)) * F.sinh(F.asinh(z) / t + k / t)


def shash_nll(y, center, spread, skew, tail=None, offset: float = SPREAD_OFFSET) -> Column:
    """Negative log-density of y under SHASH (tail = 1 when not given)."""
    y, c, s, k = map(_c, (y, center, spread, skew))
    t = F.lit(1.0) if tail is None else _c(tail)
    s = s + F.lit(offset)
    z = (y - c) / (s * t)
    sz = F.sinh(t * F.asinh(z) - k)
    llk = (
        F.log(F.lit(1.0) + sz * sz) / 2.0
        - (sz * sz) / 2.0
        - F.log(s)
        - F.lit(LOG_2PI / 2.0)
        - F.log(F.lit(1.0) + z * z) / 2.0
    )
    return -llk


def shash_heads(raw_spread, raw_skew, raw_tail=None) -> dict[str, Column]:
    """Squash unbounded scores: spread in (0,1), skew in (-0.5,0.5), tail in (0.95,1.05)."""
    out = {
        "spread": sigmoid(raw_spread),
        "skew": sigmoid(raw_skew) - F.lit(0.5),
    }
    out["tail"] = F.lit(1.0) if raw_tail is None else F.lit(0.95) + F.lit(0.1) * sigmoid(raw_tail)
    return out


def monotone_heads(a, b, c) -> dict[str, Column]:
    """lower = a, median = lower + softplus(b), upper = median + softplus(c): never crossing."""
    lower = _c(a)
    median = lower + softplus(b)
    upper = median + softplus(c)
    return {"lower": lower, "median": median, "upper": upper}


def gaussian_interval(mean, rmse, coverage: float = 0.9) -> tuple[Column, Column]:
    """mean -/+ z * rmse with z the two-sided normal quantile for ``coverage``."""
    z = normal_ppf(0.5 + coverage / 2.0)
    m, r = _c(mean), _c(rmse)
    return m - F.lit(z) * r, m + F.lit(z) * r
