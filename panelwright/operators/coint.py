"""Cointegration tests: error-correction regressions and tests on first-stage residuals."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import draw_counts
from ..functions.tails import bracket_p, normal_cdf
from ..plans.formula import parse
from ..sources.panel import Panel
from .ols import gram, ols, solve

#: Critical values at 10, 5 and 1 %.
WESTERLUND_CV = {"Gt": (-2.02, -2.17, -2.47), "Ga": (-8.49, -9.35, -11.11), "Pt": (-6.23, -6.55, -7.18), "Pa": (-4.50, -4.88, -5.58)}


def westerlund_units(panel: Panel, y: str, xs: list[str], lags: int = 1) -> DataFrame:
    """unit, n, alpha, se: the coefficient of the lagged level in each unit's error-correction regression."""
    w = panel.by_unit
    num = lambda c: F.col(c).cast("double")
    d = panel.df.select(panel.unit, panel.time, num(y).alias("y"), *[num(x).alias(f"x{i}") for i, x in enumerate(xs)])
    d = d.withColumns({"dy": F.col("y") - F.lag("y", 1).over(w), "ylag": F.lag("y", 1).over(w)})
    d = d.withColumns({f"x{i}lag": F.lag(f"x{i}", 1).over(w) for i in range(len(xs))} | {f"dx{i}": F.col(f"x{i}") - F.lag(f"x{i}", 1).over(w) for i in range(len(xs))})
    d = d.withColumns({f"dy{j}": F.lag("dy", j).over(w) for j in range(1, lags + 1)})
    cols = ["ylag", *[f"x{i}lag" for i in range(len(xs))], *[f"dx{i}" for i in range(len(xs))], *[f"dy{j}" for j in range(1, lags + 1)]]
    k = len(cols) + 1
    return ols(d, [panel.unit], "dy", cols, spare=1).select(
        panel.unit, "n", F.get("b", F.lit(1)).alias("alpha"), F.sqrt(F.get("v", F.lit(k + 1))).alias("se")
    )


def westerlund_aggregate(units: DataFrame, weight: str | None = None) -> dict[str, float]:
    """Gt, Ga, Pt and Pa. Pa equals Ga where no unit is missing; they differ in their critical values."""
    c = F.col(weight) if weight else F.lit(1)
    r = units.agg(
        F.sum(c), F.sum(c * F.col("alpha") / F.col("se")), F.sum(c * F.col("n") * F.col("alpha")), F.sum(c * F.col("alpha")), F.sum(c * F.col("se") ** 2)
    ).first()
    n, ts, na, a, v = (float(x) for x in r)
    return {"Gt": ts / n, "Ga": na / n, "Pt": a / math.sqrt(v) if v > 0 else math.nan, "Pa": na / n}


def cointegration_test(panel: Panel, formula: str, lags: int = 1, tests: list[str] | None = None, bootstrap: int = 0, seed: int = 0) -> DataFrame:
    """test, statistic, p_value. With bootstrap draws of units the p-value is twice the smaller tail share.

    Unit regressions do not depend on each other, so a draw of units is a draw
    of their rows; units whose regression failed keep their place in it.
    """
    spec = parse(formula, None)
    names = tests or list(WESTERLUND_CV)
    for t in names:
        if t not in WESTERLUND_CV:
            raise ValueError(f"test is one of {', '.join(WESTERLUND_CV)}")
    units = westerlund_units(panel, spec.y.var, list(dict.fromkeys(t.var for t in spec.xs)), lags).persist()
    stats = westerlund_aggregate(units)
    p = {t: bracket_p(stats[t], WESTERLUND_CV[t][2], WESTERLUND_CV[t][1], WESTERLUND_CV[t][0]) for t in names}
    if bootstrap:
        every = panel.df.select(panel.unit).distinct().join(units, panel.unit, "left")
        ok = F.col("alpha").isNotNull()
        sums = draw_counts(every, panel.unit, bootstrap, seed).groupBy("rep").agg(
            F.count("alpha").alias("m"), F.sum(F.col("alpha") / F.col("se")), F.sum(F.col("n") * F.col("alpha")), F.sum("alpha"), F.sum(F.when(ok, F.col("se") ** 2))
        )
        m, ts, na, a, v = np.array([tuple(r)[1:] for r in sums.filter("m > 0").collect()], float).T  # a row a draw
        boot = {"Gt": ts / m, "Ga": na / m, "Pt": a / np.sqrt(v), "Pa": na / m}
        p = {t: float(min(1.0, 2 * min((boot[t] <= stats[t]).mean(), (boot[t] >= stats[t]).mean()))) for t in names}
    units.unpersist()
    return panel.df.sparkSession.createDataFrame([(t, stats[t], p[t]) for t in WESTERLUND_CV if t in names], "test string, statistic double, p_value double")


def first_stage(panel: Panel, y: str, xs: list[str]) -> DataFrame:
    """unit, r (place among its complete rows), e: residuals of each unit's regression of y on xs."""
    num = lambda c: F.col(c).cast("double")
    d = panel.df.select(panel.unit, panel.time, num(y).alias("y"), *[num(x).alias(f"x{i}") for i, x in enumerate(xs)]).dropna()
    cols = [f"x{i}" for i in range(len(xs))]
    fits = ols(d, [panel.unit], "y", cols).filter(F.col("n") >= len(xs) + 3)
    e = F.col("y") - F.get("b", F.lit(0)) - sum((F.col(c) * F.get("b", F.lit(i + 1)) for i, c in enumerate(cols)), F.lit(0.0))
    w = Window.partitionBy(panel.unit).orderBy(panel.time)
    return d.join(fits.select(panel.unit, "b"), panel.unit).select(panel.unit, F.row_number().over(w).alias("r"), e.alias("e"))


def residual_cointegration_test(panel: Panel, formula: str, test: str = "pedroni", lags: int = 1) -> DataFrame:
    """test, statistic, p_value. pedroni: group t and group rho; kao: one pooled regression (its lags only set the least length)."""
    spec = parse(formula, None)
    u = panel.unit
    e = first_stage(panel, spec.y.var, list(dict.fromkeys(t.var for t in spec.xs)))
    w = Window.partitionBy(u).orderBy("r")
    d = e.withColumns({"de": F.col("e") - F.lag("e", 1).over(w), "elag": F.lag("e", 1).over(w), "size": F.count("*").over(Window.partitionBy(u))})
    if test == "kao":
        rows = d.filter((F.col("r") >= 3) & (F.col("size") >= lags + 3)).select(F.lit(1).alias("one"), "de", "elag")
        got = solve(gram(rows, ["one"], "de", ["elag"]).filter("n >= 3"), ["one"], intercept=False).first()
        s = got["b"][0] / math.sqrt(got["v"][0]) if got else math.nan
        out = [("ADF", s, normal_cdf(s) if got else math.nan)]
    elif test == "pedroni":
        d = d.withColumns({f"de{j}": F.lag("de", j).over(w) for j in range(1, lags + 1)})
        cols = ["elag", *[f"de{j}" for j in range(1, lags + 1)]]
        rows = d.filter((F.col("r") >= 3) & (F.col("size") >= lags + 4))
        size = d.groupBy(u).agg(F.max("size").alias("size"))
        fits = ols(rows, [u], "de", cols, intercept=False).join(size, u)
        b, k = F.get("b", F.lit(0)), len(cols)
        r = fits.agg(F.count("*"), F.avg(b / F.sqrt(F.get("v", F.lit(0)))), F.avg((F.col("size") - 1) * b)).first()
        zt, zr = (math.sqrt(r[0]) * (r[1] + 1.65), math.sqrt(r[0]) * r[2]) if r[0] else (math.nan, math.nan)
        out = [("Group t", zt, normal_cdf(zt)), ("Group rho", zr, normal_cdf(zr))]
        del k
    else:
        raise ValueError("test is pedroni or kao")
    return panel.df.sparkSession.createDataFrame(out, "test string, statistic double, p_value double")
