"""Numbers of factors, information criteria and the rank condition: small dense problems."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..functions.report import Report


def eigenvalue_ratio(values, k_max: int) -> int:
    """The k up to k_max with the largest ratio of neighbouring eigenvalues."""
    v = np.asarray(values, float)
    k = min(k_max, len(v) - 1)
    if k < 1:
        return 1
    return int(np.argmax(v[:k] / np.maximum(v[1 : k + 1], 1e-300))) + 1


def growth_ratio(values, k_max: int) -> int:
    """The k up to k_max with the largest ratio of growth rates of what remains."""
    v = np.asarray(values, float)
    k = min(k_max, len(v) - 2)
    if k < 1:
        return 1
    rest = np.array([v[i + 1 :].sum() for i in range(len(v))])
    g = [math.log1p(v[i] / max(rest[i], 1e-300)) / max(math.log1p(v[i + 1] / max(rest[i], 1e-300)), 1e-300) for i in range(k)]
    return int(np.argmax(g)) + 1


def information_criteria(fit, reference=None) -> dict:
    """IC1, IC2 and, against a reference fit with the most averages, PC1 and PC2."""
    s = fit.summary_row()
    n, t, obs = s["n_units"], round(s["t_bar"]), s["nobs"]
    m = len(fit.csa)
    var = s["ssr"] / obs
    rate = m * (n + t) / (n * t)
    p1, p2 = math.log(n * t / (n + t)), math.log(min(n, t))
    out = Report("Information criteria", {"ic1": math.log(var) + rate * p1, "ic2": math.log(var) + rate * p2, "pc1": None, "pc2": None, "s2": var, "m": m})
    if reference is not None:
        r = reference.summary_row()
        ref = r["ssr"] / r["nobs"]
        out |= {"pc1": var + rate * ref * p1, "pc2": var + rate * ref * p2}
    return out


def averages_rank(fit) -> tuple[int, int]:
    """Rank of the table of averages and its number of columns; a smaller rank means that some average says nothing new."""
    at = [c for c, n in zip(fit.columns, [x for x in fit.names if x != "(Intercept)"], strict=True) if n.startswith("~")]
    table = fit.design.select(fit.panel.time, *at).distinct().dropna().toPandas()[at].to_numpy(float)
    return (int(np.linalg.matrix_rank(table)) if len(table) else 0), len(at)


def rank_condition(fit, criterion: str = "er") -> dict:
    """m: factors in y by its eigenvalues; g: rank of the table of averages; rc: whether g reaches m."""
    from .depend import time_gram

    title = "Rank condition"
    if not fit.csa:
        return Report(title, {"m": 0, "g": 0, "rc": 1})
    p, y = fit.panel, fit.spec.y.expr(fit.panel.by_unit)
    d = p.df.select(p.unit, p.time, y.alias("_v"))
    n = d.select(p.unit).distinct().count()
    full = d.filter("_v is not null").groupBy(p.time).agg(F.count("*").alias("n")).filter(F.col("n") == n).select(p.time)
    times = [r[0] for r in full.orderBy(p.time).collect()]
    if len(times) < 3 or n < 3:
        return Report(title, {"m": None, "g": None, "rc": None})
    values = np.linalg.eigvalsh(time_gram(d.join(full, p.time), p.unit, p.time, "_v", times))[::-1][: min(n, len(times))]
    k_max = min(n, len(times)) // 2
    m = (eigenvalue_ratio if criterion == "er" else growth_ratio)(np.maximum(values, 0), k_max)
    g, _ = averages_rank(fit)
    return Report(title, {"m": m, "g": g, "rc": int(g >= m)})
