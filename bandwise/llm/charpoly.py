"""Characteristic polynomial, real roots and null vectors of a symmetric integer matrix, exactly.

* ``modular``: the polynomial modulo one prime by reduction to Hessenberg form.
* ``combine``: coefficients from their residues by Chinese remaindering.
* ``top_roots``: the largest roots of a polynomial whose roots are all real. For such a polynomial the
  sign changes of the coefficients of p(x + a) are exactly the number of roots above a (Descartes'
  rule with equality), so bisection isolates the roots, repeated ones as one interval with their number.
* ``null_vectors``: inverse iteration in decimals of ``DIGITS`` digits with the isolated root.
"""

from __future__ import annotations

from decimal import Decimal, getcontext, localcontext

import numpy as np

DIGITS = 90  # of the elimination
_FRACTION = 256  # bits of a root after the point
_REFINED = 192  # bits to which a root is known, from its first


def primes(count: int) -> list[int]:
    """The ``count`` largest primes below 2^31 (products of residues fit 63 bits)."""
    small = np.ones(46342, bool)
    small[:2] = False
    for i in range(2, 216):
        if small[i]:
            small[i * i:: i] = False
    small = np.flatnonzero(small)
    found: list[int] = []
    top, width = 1 << 31, 1 << 16
    while len(found) < count:
        low = top - width
        left = np.ones(width, bool)
        for q in small:
            left[(-low) % q:: q] = False
        found += (low + np.flatnonzero(left)[::-1]).tolist()
        top = low
    return found[:count]


def coefficient_bound(matrix: list[list[int]]) -> int:
    """No coefficient of the polynomial of a positive semidefinite matrix exceeds this."""
    p = len(matrix)
    return (2 + sum(matrix[i][i] for i in range(p)) // max(1, p)) ** p


def modular(matrix: list[list[int]], q: int) -> list[int]:
    """Coefficients modulo ``q`` of det(x - matrix), from the constant to the leading 1."""
    p = len(matrix)
    a = np.array([[v % q for v in row] for row in matrix], np.int64).reshape(p, p)
    for k in range(p - 2):
        below = np.flatnonzero(a[k + 1:, k])
        if not len(below):
            continue
        j = k + 1 + below[0]
        if j != k + 1:
            a[[k + 1, j]] = a[[j, k + 1]]
            a[:, [k + 1, j]] = a[:, [j, k + 1]]
        f = a[k + 2:, k] * pow(int(a[k + 1, k]), -1, q) % q
        a[k + 2:] = (a[k + 2:] - f[:, None] * a[k + 1] % q) % q
        a[:, k + 1] = (a[:, k + 1] + (a[:, k + 2:] * f % q).sum(1)) % q
    polys = np.zeros((p + 1, p + 1), np.int64)  # row k: the polynomial of the leading k x k block
    polys[0, 0] = 1
    for k in range(1, p + 1):
        new = np.zeros(p + 1, np.int64)
        new[1:] = polys[k - 1, :-1]
        weights, chain = np.zeros(k, np.int64), 1
        weights[k - 1] = a[k - 1, k - 1]
        for i in range(k - 2, -1, -1):
            chain = chain * int(a[i + 1, i]) % q
            if not chain:
                break
            weights[i] = int(a[i, k - 1]) * chain % q
        polys[k] = (new - (weights[:, None] * polys[:k] % q).sum(0)) % q
    return polys[p].tolist()


def combine(residues: list[tuple[int, list[int]]]) -> list[int]:
    """The integers of least magnitude with the given residues."""
    modulus, out = 1, None
    for q, r in residues:
        if out is None:
            out = list(r)
        else:
            inv = pow(modulus, -1, q)
            out = [x + modulus * ((v - x) * inv % q) for x, v in zip(out, r)]
        modulus *= q
    return [x - modulus if 2 * x > modulus else x for x in out or []]


def _above(coefs: list[int], a: int) -> int:
    """Number of roots above ``a``, with multiplicity: sign changes after the shift by ``a``."""
    c = coefs[::-1]
    n = len(c)
    for i in range(n - 1, 0, -1):
        for j in range(1, i + 1):
            c[j] += a * c[j - 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def _sign(coefs: list[int], x: int) -> int:
    v = 0
    for c in reversed(coefs):
        v = v * x + c
    return (v > 0) - (v < 0)


def top_roots(coefs: list[int], count: int) -> list[tuple[Decimal, int]]:
    """The ``count`` largest positive roots with their multiplicities, falling.

    ``coefs``: of a polynomial without negative or complex roots, constant first, leading 1. The
    multiplicities add up to ``count`` or more (the last root may repeat), or to all positive roots.
    """
    zero = next(i for i, c in enumerate(coefs) if c)
    p = len(coefs) - 1 - zero
    c = [v << (_FRACTION * (p - i)) for i, v in enumerate(coefs[zero:])]  # roots times 2^_FRACTION
    if not p or not count:
        return []
    top = 1 << (-c[p - 1]).bit_length()  # all roots are positive, none exceeds their sum
    todo, out, have = [(0, top, p, 0)], [], 0
    while todo and have < count:
        lo, hi, n_lo, n_hi = todo.pop()
        if n_lo == n_hi:
            continue
        if n_lo - n_hi > 1 and hi - lo > max(1, hi >> _REFINED):
            mid = (lo + hi) // 2
            n_mid = _above(c, mid)
            todo += [(lo, mid, n_lo, n_mid), (mid, hi, n_mid, n_hi)]
            continue
        if n_lo - n_hi == 1:
            while hi - lo > max(1, hi >> _REFINED):
                mid = (lo + hi) // 2
                s = _sign(c, mid)
                if not s:
                    lo = hi = mid
                elif (s > 0) == (n_hi % 2 == 0):
                    hi = mid  # no root in (mid, hi]
                else:
                    lo = mid
        with localcontext() as ctx:
            ctx.prec = DIGITS
            out.append((Decimal(lo + hi) / 2 / (1 << _FRACTION), n_lo - n_hi))
        have += n_lo - n_hi
    return out


def null_vectors(matrix: list[list[int]], root: Decimal, multiplicity: int) -> np.ndarray:
    """Unit eigenvectors (rows, doubles) of the symmetric ``matrix`` at ``root``, orthogonal to each other.

    Each starts from fixed numbers, is made orthogonal to those before it, and passes two steps
    of inverse iteration. Its largest entry (the first of several) is positive.
    """
    p = len(matrix)
    rng = np.random.Generator(np.random.PCG64(p))
    with localcontext() as ctx:
        ctx.prec = DIGITS
        a = np.array([[Decimal(v) for v in row] for row in matrix], object).reshape(p, p)
        a[np.arange(p), np.arange(p)] -= root
        tiny = max((abs(v) for v in a.ravel()), default=Decimal(1)) * Decimal(10) ** (8 - DIGITS)
        order, factors = np.arange(p), np.zeros((p, p), object)
        for k in range(p):  # LU with row exchanges
            j = k + max(range(p - k), key=lambda i: abs(a[k + i, k]))
            for t in (a, factors, order):
                t[[k, j]] = t[[j, k]]
            if abs(a[k, k]) < tiny:
                a[k, k] = tiny if a[k, k] >= 0 else -tiny
            factors[k + 1:, k] = a[k + 1:, k] / a[k, k]
            a[k + 1:, k:] -= factors[k + 1:, k][:, None] * a[k, k:]
        out: list[np.ndarray] = []
        for _ in range(multiplicity):
            v = np.array([Decimal(x) for x in rng.standard_normal(p).tolist()], object)
            for _ in range(2):
                v = v[order]
                for k in range(p):
                    v[k + 1:] = v[k + 1:] - factors[k + 1:, k] * v[k]
                for k in range(p - 1, -1, -1):
                    v[k] = v[k] / a[k, k]
                    v[:k] = v[:k] - a[:k, k] * v[k]
                for u in out + out:
                    v = v - u * (u * v).sum()
                v = v / getcontext().sqrt((v * v).sum())
            lead = max(range(p), key=lambda i: abs(round(v[i], 30)))
            out.append(v if v[lead] > 0 else -v)
        return np.array([[float(x) for x in v] for v in out]).reshape(len(out), p)
