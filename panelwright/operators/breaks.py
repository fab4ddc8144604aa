"""Structural breaks in mean-group slopes: known date, unknown date, and several dates."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..functions.report import Report
from ..functions.tails import chi2_sf
from ..plans.formula import ModelSpec, parse
from ..sources.panel import Panel
from .fit import CONST
from .ols import RANK_TOL
from .rolling import regime_means, regimes

TRIMS = (0.01, 0.05, 0.10, 0.15, 0.20, 0.25)
#: Published critical values of the largest Wald statistic, a row
#: for each number of coefficients from 1 to 10 and a column for each trim.
CV10 = (
    (7.17, 6.14, 5.85, 5.63, 5.45, 5.31),
    (9.34, 8.15, 7.78, 7.56, 7.37, 7.22),
    (11.69, 10.17, 9.72, 9.44, 9.20, 9.02),
    (13.27, 11.89, 11.40, 11.09, 10.85, 10.65),
    (14.96, 13.49, 12.96, 12.65, 12.38, 12.18),
    (16.38, 14.89, 14.31, 13.99, 13.70, 13.47),
    (17.78, 16.16, 15.60, 15.21, 14.91, 14.66),
    (19.16, 17.43, 16.81, 16.42, 16.10, 15.84),
    (20.48, 18.67, 18.03, 17.63, 17.30, 17.04),
    (21.72, 19.89, 19.25, 18.81, 18.46, 18.17),
)
CV05 = (
    (8.85, 7.78, 7.17, 6.94, 6.76, 6.60),
    (11.27, 9.84, 9.20, 8.91, 8.69, 8.50),
    (13.72, 11.89, 11.18, 10.86, 10.59, 10.36),
    (15.65, 13.74, 12.94, 12.58, 12.29, 12.06),
    (17.34, 15.40, 14.59, 14.22, 13.91, 13.65),
    (18.97, 17.01, 16.16, 15.76, 15.43, 15.16),
    (20.55, 18.45, 17.57, 17.15, 16.80, 16.51),
    (21.95, 19.87, 18.96, 18.51, 18.15, 17.85),
    (23.45, 21.21, 20.29, 19.82, 19.45, 19.14),
    (24.66, 22.56, 21.62, 21.13, 20.75, 20.42),
)
CV01 = (
    (12.35, 11.29, 10.73, 10.53, 10.28, 10.10),
    (15.68, 13.96, 13.42, 13.05, 12.78, 12.56),
    (18.48, 16.09, 15.37, 15.04, 14.74, 14.50),
    (20.34, 17.95, 17.22, 16.87, 16.55, 16.27),
    (22.35, 19.78, 19.11, 18.73, 18.41, 18.15),
    (24.07, 21.49, 20.85, 20.37, 20.06, 19.77),
    (25.47, 23.12, 22.38, 21.87, 21.55, 21.25),
    (26.92, 24.65, 23.85, 23.32, 22.94, 22.64),
    (28.38, 26.12, 25.25, 24.73, 24.33, 24.01),
    (29.75, 27.49, 26.59, 26.04, 25.63, 25.31),
)


def sup_wald_cv(q: int, trim: float) -> tuple[float, float, float]:
    """Critical values at 10, 5 and 1 % for q coefficients (10 at most) and the nearest trim."""
    i = min(10, max(1, round(q))) - 1
    j = min(range(len(TRIMS)), key=lambda c: abs(TRIMS[c] - trim))
    return CV10[i][j], CV05[i][j], CV01[i][j]


def sup_wald_p(stat: float, cv: tuple[float, float, float]) -> float:
    """A p-value by interpolation of its logarithm; .01 from the last critical value up, .5 below the first."""
    if not math.isfinite(stat):
        return math.nan
    if stat >= cv[2]:
        return 0.01
    for low, high, p, q in ((cv[1], cv[2], 0.05, 0.01), (cv[0], cv[1], 0.10, 0.05)):
        if stat >= low:
            share = (stat - low) / (high - low)
            return math.exp(math.log(p) + share * (math.log(q) - math.log(p)))
    return 0.5


def wald_path(panel: Panel, spec: ModelSpec, times: list, dates: list, terms: list[str] | None = None) -> list[tuple]:
    """(date, Wald statistic, df) for each date; the date belongs to the first regime. One job fits all."""
    bounds = []
    for i, d in enumerate(dates):
        after = [t for t in times if t > d]
        if after:
            bounds += [(2 * i, times[0], d), (2 * i + 1, after[0], times[-1])]
    fits, names, _ = regimes(panel, spec, bounds)
    means = regime_means(fits, names, spec.model)
    at = [i for i, n in enumerate(names) if (n != CONST if terms is None else n in terms)]
    out = []
    for i, d in enumerate(dates):
        if at and 2 * i in means and 2 * i + 1 in means:
            (_, b1, v1), (_, b2, v2) = means[2 * i], means[2 * i + 1]
            gap, v = (b1 - b2)[at], (v1 + v2)[np.ix_(at, at)]
            out.append((d, float(gap @ np.linalg.pinv(v, rcond=RANK_TOL**2, hermitian=True) @ gap), len(at)))
    return out


def _candidates(times: list, trim: float) -> list:
    t = len(times)
    low, high = max(2, math.floor(trim * t) + 1), min(t - 1, t - math.floor(trim * t))
    if high <= low:
        raise ValueError(f"trim {trim} leaves no candidate for {t} periods")
    return times[low - 1 : high]


def break_test(
    panel: Panel, formula: str, break_date=None, trim: float = 0.15, n_breaks: int = 1, model: str = "cce", csa: str | None = "~ .", terms: list[str] | None = None, **params
) -> dict:
    """With a date: its Wald test. Without: the largest over candidate dates, and more dates if n_breaks is over 1.

    Further dates are the best of any segment in turn; no test stops them.
    """
    spec = parse(formula, csa, model=model, **params)
    times = [r[0] for r in panel.df.select(panel.time).distinct().orderBy(panel.time).collect()]
    if break_date is not None:
        if break_date not in times:
            raise ValueError(f"{break_date!r} is no period of the panel")
        got = wald_path(panel, spec, times, [break_date], terms)
        if not got:
            raise ValueError("no fit on one side of the date")
        return Report("Wald test of a break at a known date", {"type": "known", "statistic": got[0][1], "df": got[0][2], "p_value": chi2_sf(got[0][1], got[0][2]), "break_dates": [break_date]})
    path = wald_path(panel, spec, times, _candidates(times, trim), terms)
    if not path:
        raise ValueError("no candidate date has a fit")
    best = max(path, key=lambda r: r[1])
    cv = sup_wald_cv(best[2], trim)
    dates = [best[0]]
    for _ in range(n_breaks - 1):
        edges = sorted(dates)
        segments = [[t for t in times if (not k or t > edges[k - 1]) and (k == len(edges) or t <= edges[k])] for k in range(len(edges) + 1)]
        found = []
        for seg in segments:
            if len(seg) < max(10, math.ceil(1 / trim)):
                continue
            part = panel.with_df(panel.df.filter(F.col(panel.time).between(seg[0], seg[-1])))
            try:
                found += wald_path(part, spec, seg, _candidates(seg, trim), terms)
            except ValueError:
                continue
        if not found:
            break
        dates.append(max(found, key=lambda r: r[1])[0])
    return Report("Largest Wald test of a break at an unknown date", {
        "type": "unknown", "statistic": best[1], "df": best[2], "p_value": sup_wald_p(best[1], cv), "critical_values": cv,
        "break_date": best[0], "break_dates": sorted(dates), "candidates": [(d, w) for d, w, _ in path],
    })
