"""Multinomial logistic regression over blocks (the classifier of ``binned_density``; SURVEY 2.12).

The same model as ``LogisticRegression(family="multinomial")`` of Spark ML: features are centred and
standardised (and so penalised), intercepts start at the classes' log counts, L-BFGS of ten pairs with a strong Wolfe line search
stops after ``max_iter`` steps or when the loss no longer falls. An evaluation of loss and gradient is one pass over
packed matrices, whose products and exponentials NumPy takes in chunks that stay in the cache.
"""

from __future__ import annotations

from collections.abc import Generator

import numpy as np

from bandwise.learners.blocks import Block, Fit

CHUNK = 1024  # rows whose class scores are held at once
PAIRS = 10    # steps and gradient changes that L-BFGS keeps
TRIES = 10    # evaluations of one search for a bracket, and within a bracket
RECENT = 20   # losses whose greatest must lie above the last one for the descent to go on

Step = Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]


class SearchFailed(Exception):
    """No step along the direction meets the Wolfe conditions."""


def _direction(pairs: list[tuple[np.ndarray, np.ndarray]], grad: np.ndarray) -> np.ndarray:
    """The two-loop recursion; ``pairs`` of (step, change of the gradient), the newest first."""
    d, kept, scale = grad.copy(), [], 1.0
    if pairs:
        s, y = pairs[0]
        if not s @ y >= 0:
            raise SearchFailed
        scale = (s @ y) / (y @ y)
    for s, y in pairs:
        rho = s @ y
        a = (s @ d) / rho
        if np.isnan(a):
            raise SearchFailed
        kept.append((a, rho))
        d -= a * y
    d *= scale
    for (s, y), (a, rho) in zip(reversed(pairs), reversed(kept)):
        d += (a - (y @ d) / rho) * s
    return -d


def _between(low, high) -> float:
    """Minimum of the cubic through two points (step, loss, slope), kept off both ends."""
    (lt, lf, ld), (rt, rf, rd) = sorted((low, high), key=lambda p: p[0])
    d1 = ld + rd - 3 * (lf - rf) / (lt - rt)
    d2 = np.sqrt(d1 * d1 - ld * rd)
    t = rt - (rt - lt) * (rd + d2 - d1) / (rd - ld + 2 * d2)
    return float(min(max(t, lt + 0.1 * (rt - lt)), lt + 0.9 * (rt - lt)))


def _search(x: np.ndarray, f0: float, d0: float, direction: np.ndarray, t: float) -> Generator:
    """A step that meets the strong Wolfe conditions, with the loss and the gradient there."""
    c1, c2 = 1e-4, 0.9

    def at(t):
        f, g = yield x + t * direction
        return (t, f, g @ direction), g

    if not d0 <= 0:
        raise SearchFailed
    low, bracket = (0.0, f0, d0), None
    for i in range(TRIES):
        now, g = yield from at(t)
        if not np.isfinite(now[1]):
            t /= 2.0
            continue
        if now[1] > f0 + c1 * t * d0 or (now[1] >= low[1] and i > 0):
            bracket = low, now
            break
        if abs(now[2]) <= c2 * abs(d0):
            return t, now[1], g
        if now[2] >= 0:
            bracket = now, low
            break
        low, t = now, t * 1.5
    if bracket is None:
        raise SearchFailed
    low, high = bracket
    for _ in range(TRIES):
        now, g = yield from at(_between(low, high))
        if now[1] > f0 + c1 * now[0] * d0 or now[1] >= low[1]:
            high = now
            continue
        if abs(now[2]) <= c2 * abs(d0):
            return now[0], now[1], g
        if now[2] * (high[0] - low[0]) >= 0:
            high = low
        low = now
    raise SearchFailed


def lbfgs(x: np.ndarray, max_iter: int, tol: float) -> Step:
    """L-BFGS as a generator: it yields points, is sent (loss, gradient) there, and returns the last one.

    A search that fails is tried once more along the gradient; when that fails too, the descent ends.
    """
    f, g = yield x
    first, recent, pairs, failed, steps = f, [np.inf], [], False, 0
    while True:
        if steps >= max_iter or (len(recent) >= 2 and abs(f - max(recent)) <= tol * first) or np.linalg.norm(g) <= max(tol * f, 1e-8):
            return x
        try:
            d = _direction(pairs, g)
            t, f1, g1 = yield from _search(x, f, g @ d, d, 1.0 if steps else 1.0 / np.linalg.norm(d))
            if t * np.linalg.norm(g) < 1e-10:
                raise SearchFailed
        except SearchFailed:
            if failed:
                return x
            failed, pairs = True, []
            continue
        x1 = x + t * d
        pairs = [(x1 - x, g1 - g), *pairs][:PAIRS]
        x, f, g, failed, steps = x1, f1, g1, False, steps + 1
        recent = [*recent, f][-RECENT:]


def shares(scores: np.ndarray) -> np.ndarray:
    """Probabilities of the classes from their scores (changed in place); an infinite score takes all."""
    top = scores.max(1)
    sure = np.isposinf(top)
    scores -= np.where(sure, 0.0, top)[:, None]
    np.exp(scores, out=scores)
    if sure.any():
        scores[sure] = np.isinf(scores[sure])
    scores /= scores.sum(1)[:, None]
    return scores


def loss_sums(x: np.ndarray, y: np.ndarray, coef: np.ndarray, intercept: np.ndarray) -> np.ndarray:
    """Sums of the loss and of its gradient by class and [features, 1], over rows of features and class numbers."""
    loss, grad = 0.0, np.zeros((len(intercept), x.shape[1] + 1))
    z = np.ones((min(len(x), CHUNK), x.shape[1] + 1))
    for a in range(0, len(x), CHUNK):
        v, own = x[a: a + CHUNK], y[a: a + CHUNK]
        rows = np.arange(len(v))
        p = v @ coef.T
        p += intercept
        p -= p.max(1)[:, None]
        loss -= p[rows, own].sum()
        np.exp(p, out=p)
        total = p.sum(1)
        loss += np.log(total).sum()
        p /= total[:, None]
        p[rows, own] -= 1.0
        z[: len(v), :-1] = v
        grad += p.T @ z[: len(v)]
    return np.append(loss, grad.ravel())


class SoftmaxFit(Fit):
    """The passes of one fit over the matrix ``x`` and the class numbers ``y`` of blocks: means and class counts, deviations, then the descent.

    ``coef_`` (class by feature), ``intercept_`` and ``counts_`` are set when it is done. The classes are 0 to the greatest one seen;
    the number ``classes`` stands for a missing one, which is refused.
    """

    def __init__(self, features: int, classes: int, x: str = "x", y: str = "y", max_iter: int = 50, tol: float = 1e-6,
                 reg: float = 0.0):
        self.features, self.x, self.y, self.max_iter, self.tol, self.reg = features, x, y, max_iter, tol, reg
        self.reads = [x, y]
        self.mean, self.std, self.size = None, None, features + classes + 1
        self.classes = classes

    def part(self):
        name, label, classes, mean = self.x, self.y, self.classes, self.mean
        if mean is None:
            return lambda b: np.concatenate([b[name].sum(0), np.bincount(b[label], minlength=classes + 1)])
        if self.std is None:
            return lambda b: ((b[name] - mean) ** 2).sum(0)
        coef, intercept = self._plain(self.theta)
        return lambda b: loss_sums(b[name], b[label], coef, intercept)

    def _plain(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients and intercepts for the features as they are, from those of the standardised ones."""
        w = theta.reshape(self.classes, -1)
        coef = w[:, :-1] * self.inverse
        return coef, w[:, -1] - coef @ self.mean

    def update(self, total: np.ndarray) -> bool:
        if self.mean is None:
            counts = total[self.features: -1]
            if total[-1]:
                raise ValueError(f"{total[-1]:.0f} rows without a target")
            self.n, self.classes = counts.sum(), int(np.flatnonzero(counts)[-1]) + 1 if counts.any() else 0
            if not self.classes:
                raise ValueError("no row to fit")
            self.counts_, self.mean, self.size = counts[: self.classes], total[: self.features] / self.n, self.features
            return True
        if self.std is None:
            self.std = np.sqrt(total / max(self.n - 1, 1))
            self.inverse = np.divide(1.0, self.std, out=np.zeros_like(self.std), where=self.std != 0)
            if (self.counts_ > 0).sum() == 1:  # one class alone
                self.coef_ = np.zeros((self.classes, self.features))
                self.intercept_ = np.where(self.counts_ > 0, np.inf, 0.0)
                return False
            start = np.zeros((self.classes, self.features + 1))
            start[:, -1] = np.log1p(self.counts_) - np.log1p(self.counts_).mean()
            self.descent, self.size = lbfgs(start.ravel(), self.max_iter, self.tol), 1 + start.size
            self.theta = next(self.descent)
            return True
        g = total[1:].reshape(self.classes, -1)
        g = np.column_stack([(g[:, :-1] - g[:, -1:] * self.mean) * self.inverse, g[:, -1]])
        w = self.theta.reshape(self.classes, -1).copy()
        w[:, -1] = 0.0  # intercepts are not penalised
        try:
            self.theta = self.descent.send((total[0] / self.n + self.reg / 2 * (w * w).sum(), (g / self.n + self.reg * w).ravel()))
        except StopIteration as done:
            self.coef_, self.intercept_ = self._plain(done.value)
            return False
        return True
