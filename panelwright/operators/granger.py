"""Panel causality: unit tests of lagged x in y, averaged and standardised."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.report import Report
from ..functions.tails import two_sided
from ..sources.panel import Panel
from .ols import gram, solve


def granger_units(panel: Panel, y: str, x: str, lags: int = 1) -> DataFrame:
    """unit, t (its rows) and w: the F ratio of the lags of x. Both regressions come from rows scanned once."""
    w, u = panel.by_unit, panel.unit
    num = lambda c: F.col(c).cast("double")
    d = panel.df.select(u, panel.time, num(y).alias("y"), num(x).alias("x"))
    ys, xs = [f"y{j}" for j in range(1, lags + 1)], [f"x{j}" for j in range(1, lags + 1)]
    d = d.withColumns({f"y{j}": F.lag("y", j).over(w) for j in range(1, lags + 1)} | {f"x{j}": F.lag("x", j).over(w) for j in range(1, lags + 1)})
    sizes = panel.df.filter(F.col(y).isNotNull() | F.col(x).isNotNull()).groupBy(u).agg(F.count("*").alias("t"))
    complete = d.dropna()
    full = solve(gram(complete, [u], "y", [*ys, *xs]).filter(F.col("n") > 2 * lags + 2), [u])
    small = solve(gram(complete, [u], "y", ys), [u])
    both = full.select(u, "n", F.col("ssr").alias("full")).join(small.select(u, F.col("ssr").alias("small")), u).join(sizes, u)
    df2 = F.col("n") - 2 * lags - 1
    return both.filter(F.col("t") > 3 * lags + 1).select(u, "t", (((F.col("small") - F.col("full")) / lags) / (F.col("full") / df2)).alias("w"))


def granger_test(panel: Panel, y: str, x: str, lags: int = 1, compat: bool = False) -> dict:
    """w_bar, z_bar, z_tilde and two-sided p-values.

    The statistic that is centred at the number of lags K is K times the F
    ratio; compat centres the ratio itself, which is right for K = 1 only.
    """
    k = lags
    units = granger_units(panel, y, x, lags)
    d = F.col("t") - 3 * k - 1
    ok = d > 4
    e = F.when(ok, k * d / (d - 2))
    v = F.when(ok, 2 * k * d * d * (k + d - 2) / ((d - 2) * (d - 2) * (d - 4)))
    r = units.agg(F.count("w"), F.avg("w"), F.avg(e), F.avg(v), F.count(e), F.avg("t")).first()
    if r[0] < 2:
        raise ValueError("fewer than 2 units could be estimated")
    w = r[1] * (1 if compat else k)
    z = math.sqrt(r[0] / (2 * k)) * (w - k)
    zt = (w - r[2]) / math.sqrt(r[3] / r[4]) if r[4] >= 2 else None
    return Report("Causality test", {"w_bar": w, "z_bar": z, "z_tilde": zt, "p_z": two_sided(z), "p_zt": None if zt is None else two_sided(zt), "n": r[0], "t_bar": r[5]})
