"""Normal and chi-square tails without scipy."""

from __future__ import annotations

import math
from statistics import NormalDist

_STD = NormalDist()


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def two_sided(z: float) -> float:
    """P(|Z| > |z|)."""
    return math.erfc(abs(z) / math.sqrt(2.0))


def normal_quantile(p: float) -> float:
    return _STD.inv_cdf(p)


def chi2_sf(x: float, df: float) -> float:
    """Upper tail of chi-square: the series below the mean, a continued fraction above it."""
    if math.isnan(x) or df <= 0:
        return math.nan
    if x <= 0:
        return 1.0
    a, z = df / 2.0, x / 2.0
    scale = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= z / k
            total += term
        return max(0.0, 1.0 - scale * total)
    tiny = 1e-300
    b = z + 1 - a
    c, d = 1 / tiny, 1 / b
    f = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        f *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * f


def bracket_p(stat: float, cv1: float, cv5: float, cv10: float) -> float:
    """A p-value read off three lower-tail critical values: .01 below the first, .5 above the last, linear between."""
    if math.isnan(stat):
        return math.nan
    if stat <= cv1:
        return 0.01
    for low, high, p, q in ((cv1, cv5, 0.01, 0.05), (cv5, cv10, 0.05, 0.10)):
        if stat <= high:
            return p + (stat - low) / (high - low) * (q - p)
    return 0.5
