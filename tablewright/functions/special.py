"""Tail probabilities of the t, F and chi-square laws, for one aggregate row on the driver.

Regularised incomplete beta and gamma functions by series and continued
fractions (Lentz), as in standard numerical tables.
"""

from __future__ import annotations

import math

_TINY = 1e-300
_EPS = 1e-15


def _lentz(pairs, start: float) -> float:
    f = start or _TINY
    c, d = f, 0.0
    for a, b in pairs:
        d = b + a * d
        d = 1.0 / (d or _TINY)
        c = (b + a / c) or _TINY
        f *= c * d
        if abs(c * d - 1.0) < _EPS:
            break
    return f


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_inc(b, a, 1.0 - x)

    def terms():
        yield 1.0, 1.0
        for m in range(1, 100_000):
            yield -(a + m - 1) * (a + b + m - 1) * x / ((a + 2 * m - 2) * (a + 2 * m - 1)), 1.0
            yield m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0

    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    return front / a * _lentz(terms(), _TINY) if front else 0.0


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x)."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * _EPS:
            k += 1
            term *= x / k
            total += term
        return 1.0 - front * total

    def terms():
        yield 1.0, x + 1 - a
        for k in range(1, 100_000):
            yield -k * (k - a), x + 2 * k + 1 - a

    return front * _lentz(terms(), _TINY)


def t_two_sided(t: float, dof: float) -> float:
    return beta_inc(dof / 2, 0.5, dof / (dof + t * t))


def f_upper(f: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def chi2_upper(x: float, dof: float) -> float:
    return gamma_upper(dof / 2, x / 2)
