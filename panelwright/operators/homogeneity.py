"""Slope homogeneity: dispersion around a pooled slope, and mean group against pooled."""

from __future__ import annotations

import math

import numpy as np

from ..functions.report import Report
from ..functions.tails import chi2_sf, two_sided
from .fit import CONST, TREND, PanelFit
from .ols import RANK_TOL, pooled_inverse_variance, weighted_sums


def _sums(fit: PanelFit):
    """The places of the slopes, and sums over units of their inverse variances and of these times the slopes."""
    if fit.spec.model == "ife":
        raise ValueError("the test needs a fit with unit coefficients")
    at = [i for i, t in enumerate(fit.terms) if t not in (CONST, TREND)]
    if not at:
        raise ValueError("no slope")
    n, w, wb, bwb = weighted_sums(fit.units, at, len(fit.names))
    if n < 2:
        raise ValueError("not enough units")
    return at, n, w, wb, bwb


def swamy_test(fit: PanelFit) -> dict:
    """The sum over units of (b - b*)'W(b - b*) around the pooled slopes b*, and its standardised form."""
    at, n, w, wb, bwb = _sums(fit)
    star, _ = pooled_inverse_variance(w, wb)
    s = float(bwb - 2 * star @ wb + star @ w @ star)
    k = len(at)
    delta = math.sqrt(n) * (s / n - k) / math.sqrt(2 * k)
    return Report("Homogeneity of slopes", {"statistic": s, "df": k * (n - 1), "p_value": chi2_sf(s, k * (n - 1)), "delta": delta, "p_delta": two_sided(delta), "n": n, "k": k})


def hausman_test(fit: PanelFit) -> dict:
    """Mean-group slopes against pooled ones."""
    at, _, w, wb, _ = _sums(fit)
    pool, v_pool = pooled_inverse_variance(w, wb)
    gap = fit.estimate[at] - pool
    d = fit.variance[np.ix_(at, at)] - v_pool
    h = float(gap @ np.linalg.pinv(d, rcond=RANK_TOL, hermitian=True) @ gap)
    return Report("Mean-group against pooled slopes", {"statistic": h, "df": len(at), "p_value": chi2_sf(abs(h), len(at)), "b_pool": pool})
