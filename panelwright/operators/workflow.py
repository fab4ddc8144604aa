"""Diagnostics in turn, and the model that they point to."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.report import Report
from ..plans.formula import parse
from ..sources.panel import Panel
from .coint import cointegration_test
from .depend import cd_tests
from .estimators import fit
from .ols import gram, solve_rows
from .select import information_criteria, rank_condition
from .unitroot import cips_test


def pooled_residuals(panel: Panel, y: str, xs: list[str]):
    """unit, time, resid of one regression over all complete rows; residuals stay keyed."""
    rows = panel.df.select(panel.unit, panel.time, F.col(y).cast("double").alias("y"), *[F.col(x).cast("double").alias(f"x{i}") for i, x in enumerate(xs)]).dropna()
    got = gram(rows.withColumn("one", F.lit(1)), ["one"], "y", [f"x{i}" for i in range(len(xs))]).collect()
    b = solve_rows(got)[0]["b"]
    e = F.col("y") - float(b[0]) - sum((F.col(f"x{i}") * float(v) for i, v in enumerate(b[1:])), F.lit(0.0))
    return rows.select(panel.unit, panel.time, e.alias("resid"))


def workflow(panel: Panel, formula: str, max_lags: int | None = None, level: float = 0.05) -> dict:
    """balance, unit roots, dependence, cointegration, rank and lag choice; then recommended and call.

    Dependence, integrated and cointegrated: pmg. Dependence and integrated:
    cce. Dependence alone: dynamic_cce. Otherwise mg. Lags of the averages are
    tried up to max_lags, by default the cube root of the mean number of periods.
    """
    spec = parse(formula)
    variables = spec.variables
    out = Report("Recommended model", {"balance": panel.balance().first().asDict(), "unit_root": {}})
    if max_lags is None:
        max_lags = max(1, math.floor(out["balance"]["t_bar"] ** (1 / 3) + 1e-9))
    for v in variables:
        try:
            out["unit_root"][v] = cips_test(panel, v)
        except ValueError as e:
            out["unit_root"][v] = {"error": str(e)}
    integrated = any(r.get("p_value", 0) > level for r in out["unit_root"].values() if "error" not in r)
    cd = cd_tests(pooled_residuals(panel, variables[0], variables[1:]), panel.unit, panel.time, "resid", ["pesaran"]).first()
    out["cd"] = cd.asDict()
    dependent = cd["p_value"] < level
    cointegrated = False
    if integrated:
        tests = cointegration_test(panel, f"{variables[0]} ~ {' + '.join(variables[1:])}").collect()
        out["cointegration"] = [t.asDict() for t in tests]
        cointegrated = any(t["p_value"] < level for t in tests)
    base = f"{variables[0]} ~ {' + '.join(variables[1:])}"
    static = fit(panel, base, "cce")
    out["rank"] = rank_condition(static)
    found = {}
    for lags in range(max_lags + 1):
        try:
            found[lags] = information_criteria(fit(panel, base, "cce", csa_lags=lags))["ic1"]
        except ValueError:
            continue
    out["ic"] = found
    best = min(found, key=found.get) if found else 0
    if dependent and integrated:
        model = "pmg" if cointegrated else "cce"
    else:
        model = "dynamic_cce" if dependent else "mg"
    lags = max(best, 1) if model in ("dynamic_cce", "pmg") else best
    out.update({"recommended": model, "lags": lags, "dependent": dependent, "integrated": integrated, "cointegrated": cointegrated})
    csa = "None" if model == "mg" else "'~ .'"
    out["call"] = f"fit(panel, {formula!r}, model={model!r}, csa={csa}, csa_lags={0 if model == 'mg' else lags})"
    return out
