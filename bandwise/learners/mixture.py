"""Diagonal Gaussian mixture fitted with missing values, and expected-ReLU features
(``em_mixture_missing``, ``expected_relu_features``; SURVEY 2.12), re-aimed to full-data EM.

E-step: per row and component, log weight + masked normal log-density (missing terms add 0),
softmax across components. M-step: one pass of block sums of, per component,
sum r, and per (component, column) sum r*x~, sum r*x~^2 and sum r*[x missing], where x~ is x or
the current component mean when x is missing (null or NaN). Means and variances follow the in-fill rule
(variance of a missing entry adds the component's current variance) plus ``gamma``, and are kept
as running averages over iterations. Mixture weights are the mean responsibilities (used as log
weights in the E-step). Each iteration is one pass, which also yields the log-likelihood of the
parameters it started from.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwise.functions.distributions import AS_A, AS_P, expected_relu, softmax_weights
from bandwise.learners.blocks import Block, Fit, lockstep, pack


@dataclass
class MissingMixture:
    cols: Sequence[str]
    k: int = 3
    gamma: float = 1e-5
    iterations: int = 20
    accuracy: int = 1000
    means: np.ndarray = field(default=None, repr=False)   # k x p
    vars: np.ndarray = field(default=None, repr=False)    # k x p
    weights: np.ndarray = field(default=None, repr=False)  # k
    history: list = field(default_factory=list, repr=False)

    def _loglik_terms(self, means, vars_, weights) -> list[Column]:
        out = []
        for c in range(self.k):
            e = F.lit(float(math.log(max(weights[c], 1e-300))))
            for j, col in enumerate(self.cols):
                m, v = float(means[c, j]), float(vars_[c, j])
                x = F.col(col).cast("double")
                term = -((x - F.lit(m)) * (x - F.lit(m))) / F.lit(v) / 2.0 - F.lit(math.log(2 * math.pi * v) / 2.0)
                e = e + F.coalesce(term, F.lit(0.0))
            out.append(e)
        return out

    def responsibilities(self, means=None, vars_=None, weights=None) -> list[Column]:
        means = self.means if means is None else means
        vars_ = self.vars if vars_ is None else vars_
        weights = self.weights if weights is None else weights
        return softmax_weights(self._loglik_terms(means, vars_, weights))

    def log_likelihood(self, df: DataFrame) -> float:
        terms = self._loglik_terms(self.means, self.vars, self.weights)
        top = F.greatest(*terms) if len(terms) > 1 else terms[0]
        s = terms[0] - top
        tot = F.exp(s)
        for t in terms[1:]:
            tot = tot + F.exp(t - top)
        return df.agg(F.avg(top + F.log(tot))).first()[0]

    def init(self, df: DataFrame) -> None:
        p = len(self.cols)
        qs = [(c + 0.5) / self.k for c in range(self.k)]
        row = df.agg(*[F.percentile_approx(c, qs, self.accuracy).alias(f"q{j}") for j, c in enumerate(self.cols)],
                     *[F.var_pop(c).alias(f"v{j}") for j, c in enumerate(self.cols)]).first()
        self.means = np.array([[row[f"q{j}"][c] for j in range(p)] for c in range(self.k)], dtype=float)
        self.vars = np.array([[max(row[f"v{j}"] or 1.0, 1e-6)] * self.k for j in range(p)], dtype=float).T
        self.weights = np.full(self.k, 1.0 / self.k)

    def fit(self, df: DataFrame) -> "MissingMixture":
        data = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in self.cols])
        if self.means is None:
            self.init(data)
        lockstep(pack(data, {"x": list(self.cols)}), [MixtureFit(self, "x", lambda b: np.ones(len(b["x"]), bool))])
        return self


class MixtureFit(Fit):
    """The iterations of one ``MissingMixture`` over the matrix ``x`` of blocks (missing is NaN).

    ``mean`` and ``sd`` standardise the matrix first. A pass yields the row count, the log-likelihood, and
    for each component sum r, sum r x~, sum r x~^2 and sum r [missing].
    """

    def __init__(self, mix: MissingMixture, x: str, seen, mean=0.0, sd=1.0):
        self.mix, self.x, self.seen, self.mean, self.sd, self.it = mix, x, seen, mean, sd, 0
        self.size = 2 + mix.k + 3 * mix.k * len(mix.cols)

    def part(self):
        mix, name, seen, mean, sd = self.mix, self.x, self.seen, self.mean, self.sd
        k, means, vars_, logw = mix.k, mix.means, mix.vars, np.log(np.maximum(mix.weights, 1e-300))

        def run(block: Block) -> np.ndarray:
            x = (block[name][seen(block)] - mean) / sd
            gone = np.isnan(x)
            r, ll, filled = component_weights(x, gone, means, vars_, logw)
            out = [[len(x), ll.sum()], r.sum(0)]
            out += [np.concatenate([r[:, c] @ filled[c], r[:, c] @ filled[c] ** 2, r[:, c] @ gone]) for c in range(k)]
            return np.concatenate(out)

        return run

    def update(self, v: np.ndarray) -> bool:
        m, k = self.mix, self.mix.k
        n, ll, sr = v[0], v[1] / v[0], v[2:2 + k]
        s1, s2, sm = v[2 + k:].reshape(k, 3, len(m.cols)).transpose(1, 0, 2)
        m.history.append(float(ll))  # of the parameters the iteration started from, and after the last one
        if self.it == m.iterations:
            return False
        self.it += 1
        it, sr_ = self.it, np.maximum(sr, 1e-300)[:, None]
        new_means = ((it - 1) * m.means + s1 / sr_) / it
        dev = (s2 - 2 * new_means * s1 + new_means ** 2 * sr[:, None]) / sr_
        v_batch = dev + sm * m.vars / sr_ + m.gamma
        m.vars = ((it - 1) * m.vars + v_batch) / it
        m.means = new_means
        m.weights = ((it - 1) * m.weights + sr / n) / it
        return True


def component_weights(x: np.ndarray, gone: np.ndarray, means: np.ndarray, vars_: np.ndarray, logw: np.ndarray):
    """Weights of the components for every row, its log-likelihood, and the rows filled in by each component."""
    filled = [np.where(gone, m, x) for m in means]
    terms = np.stack([lw + np.where(gone, 0.0, -((f - m) ** 2) / v / 2 - np.log(2 * np.pi * v) / 2).sum(1)
                      for f, m, v, lw in zip(filled, means, vars_, logw)], 1)
    top = terms.max(1, keepdims=True)
    e = np.exp(terms - top)
    total = e.sum(1, keepdims=True)
    return e / total, top[:, 0] + np.log(total[:, 0]), filled


@dataclass
class MixtureLayer:
    """A hidden layer that integrates missing inputs out: features for any learner.

    A ``MissingMixture`` is fitted to the standardised inputs; each of ``units`` fixed random ReLU units
    contributes its expectation under the mixture given the observed inputs, and every input its
    expected value. Complete rows give the plain units and inputs. Applied by one Arrow UDF over the
    array of inputs, so all other columns stay as they are.
    """

    cols: Sequence[str]
    units: int = 16
    k: int = 3
    iterations: int = 20
    seed: int = 0

    def fit(self, df: DataFrame) -> "MixtureLayer":
        x = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in self.cols]
        st = df.select(*x).agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(self.cols)],
                               *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(self.cols)]).first()
        self.mean_ = np.array([st[f"m{i}"] or 0.0 for i in range(len(self.cols))])
        self.sd_ = np.array([st[f"s{i}"] or 1.0 for i in range(len(self.cols))])
        scaled = df.select(*[((c - F.lit(float(m))) / F.lit(float(s))).alias(n)
                             for n, c, m, s in zip(self.cols, [F.col(c).cast("double") for c in self.cols], self.mean_, self.sd_)])
        self.mix_ = MissingMixture(list(self.cols), self.k, iterations=self.iterations).fit(scaled)
        return self.units_of()

    def units_of(self) -> "MixtureLayer":
        """The fixed random units."""
        rng = np.random.default_rng(self.seed)
        self.W_ = rng.standard_normal((len(self.cols), self.units)) / np.sqrt(len(self.cols))
        self.b_ = rng.standard_normal(self.units) * 0.5
        return self

    def outputs(self, x: np.ndarray) -> np.ndarray:
        """Expected units and inputs of every row (missing is NaN)."""
        x = (x - self.mean_) / self.sd_
        gone = np.isnan(x)
        mix = self.mix_
        r, _, filled = component_weights(x, gone, mix.means, mix.vars, np.log(np.maximum(mix.weights, 1e-300)))
        out = np.zeros((len(x), self.W_.shape[1] + x.shape[1]))
        for c, f in enumerate(filled):
            hidden = _expected_relu(f @ self.W_ + self.b_, (gone * mix.vars[c]) @ (self.W_ * self.W_))
            out += r[:, c:c + 1] * np.concatenate([hidden, f], 1)
        return out

    def features(self) -> list[str]:
        return [f"_h{u}" for u in range(self.units)] + [f"_e{j}" for j in range(len(self.cols))]

    def transform(self, df: DataFrame) -> DataFrame:
        outputs, width = self.outputs, len(self.cols)

        @F.pandas_udf("array<double>")
        def layer(rows: pd.Series) -> pd.Series:
            return pd.Series(list(outputs(np.array(rows.tolist(), float).reshape(len(rows), width))))

        layer = layer.asNondeterministic()  # else the optimizer copies the call into every feature below
        d = df.withColumn("_layer", layer(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in self.cols])))
        return d.withColumns({n: F.get("_layer", F.lit(i)) for i, n in enumerate(self.features())}).drop("_layer")


def _ndtr(z: np.ndarray) -> np.ndarray:
    """Standard normal distribution function, by the approximation that ``distributions.erf`` uses."""
    x = np.abs(z) / math.sqrt(2.0)
    t = 1.0 / (1.0 + AS_P * x)
    tail = t * np.polyval(AS_A[::-1], t) * np.exp(-np.minimum(x * x, 700.0)) / 2
    return np.where(z < 0, tail, 1.0 - tail)


def _expected_relu(mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    """E max(0, N(mean, var)); where var is 0 it is max(0, mean)."""
    sd = np.sqrt(np.maximum(var, 1e-300))
    z = mean / sd
    out = mean * _ndtr(z) + sd * np.exp(-np.minimum(z * z, 1400) / 2) / np.sqrt(2 * np.pi)
    return np.where(var > 0, out, np.maximum(mean, 0.0))


def expected_relu_features(mix: MissingMixture, W: np.ndarray, b: np.ndarray, prefix: str = "h") -> list[Column]:
    """Per output unit u: sum_k r_k * E[relu(layer_k,u)] where component k fills a missing input
    with its mean (variance = its variance) and an observed input with itself (variance 0)."""
    r = mix.responsibilities()
    units = W.shape[1]
    outs = []
    for u in range(units):
        total = None
        for c in range(mix.k):
            mean = F.lit(float(b[u]))
            var = F.lit(0.0)
            for j, col in enumerate(mix.cols):
                x = F.col(col).cast("double")
                w = float(W[j, u])
                mean = mean + F.coalesce(x, F.lit(float(mix.means[c, j]))) * F.lit(w)
                var = var + F.when(x.isNull(), F.lit(float(mix.vars[c, j]) * w * w)).otherwise(F.lit(0.0))
            term = r[c] * expected_relu(mean, var)
            total = term if total is None else total + term
        outs.append(total.alias(f"{prefix}{u}"))
    return outs
