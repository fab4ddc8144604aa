"""Interactive fixed effects by iterated principal components.

Units never leave the executors: a round needs the T x T cross product of the
residuals, whose eigenvectors are the factors, and cross products of what the
factors leave. Both follow from one aggregate, the cross products of y and x by
pair of periods, which is made once.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..plans.formula import ModelSpec
from ..sources.panel import Panel
from .fit import PanelFit
from .ols import period_products


def balanced(panel: Panel, columns: list[str]):
    """Rows of the periods in which all units are complete or, if that leaves fewer than 3 periods, an error."""
    u, t = panel.unit, panel.time
    n = panel.df.select(u).distinct().count()
    rows = panel.df.select(u, t, *columns).dropna()
    full = rows.groupBy(t).agg(F.count("*").alias("n")).filter(F.col("n") == n).select(t)
    times = [r[0] for r in full.orderBy(t).collect()]
    if len(times) < 3 or n < 3:
        raise ValueError(f"balanced part too small: {n} x {len(times)}")
    return rows.join(full, t), times, n


def select_factors(g: np.ndarray, n: int, t: int) -> int:
    """The number of factors with the least log residual variance plus penalty."""
    values = np.linalg.eigvalsh(g)[::-1]
    total, most = values.sum(), min(10, t - 1, n - 1)
    rate = (n + t) / (n * t) * np.log(min(n, t))
    crit = [np.log(max(total - values[:r].sum(), 1e-300) / (n * t)) + r * rate for r in range(1, most + 1)]
    return int(np.argmin(crit)) + 1


def fit_ife(panel: Panel, spec: ModelSpec, rounds: int = 100, tol: float = 1e-8) -> PanelFit:
    from .estimators import design_columns

    wide, y, xs = design_columns(panel, spec)
    rows, times, n = balanced(panel.with_df(wide), [y, *xs])
    t, k, cols = len(times), len(xs), [y, *xs]
    if spec.constant:
        from pyspark.sql import Window

        w = Window.partitionBy(panel.unit)
        rows = rows.select(panel.unit, panel.time, *[(F.col(c) - F.avg(c).over(w)).alias(c) for c in cols])
    s = period_products(rows, panel.unit, panel.time, cols, times)

    def slopes(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = np.einsum("ijst,st->ij", s, m)  # sums of products after projection
        return np.linalg.solve(c[1:, 1:], c[1:, 0]), c

    r = max(1, spec.n_factors or select_factors(s[0, 0], n, t))
    beta, c = slopes(np.eye(t))
    for it in range(1, rounds + 1):  # noqa: B007
        w = np.concatenate([[1.0], -beta])
        e = np.einsum("i,j,ijst->st", w, w, s)
        values, vectors = np.linalg.eigh((e + e.T) / 2)
        f = vectors[:, ::-1][:, :r]
        m = np.eye(t) - f @ f.T
        new, c = slopes(m)
        done = np.max(np.abs(new - beta)) < tol
        beta = new
        if done:
            break
    w = np.concatenate([[1.0], -beta])
    rss = float(w @ c @ w)
    obs = n * t
    sigma2 = rss / (obs - n - k - n * r)
    v = sigma2 * np.linalg.inv(c[1:, 1:])
    names = [x.label for x in spec.xs]
    fit = PanelFit(spec, panel, rows, y, xs, names, k, rows.limit(0), beta, v)
    fit.info = {
        "n_factors": r, "factors": f * np.sqrt(t), "times": times, "iterations": it, "sigma2": sigma2, "rss": rss,
        "r2": 1 - rss / float(np.einsum("ss->", s[0, 0])), "n_units": n, "n_periods": t, "rmse": float(np.sqrt(rss / obs)),
    }
    return fit


def loadings(fit: PanelFit):
    """unit, loading (array): the products of each unit's residuals with the factors over T."""
    f, times = fit.info["factors"], fit.info["times"]
    p = fit.panel
    kind = fit.design.schema[p.time].dataType.simpleString()
    table = p.df.sparkSession.createDataFrame([(t, [float(x) for x in row]) for t, row in zip(times, f, strict=True)], f"`{p.time}` {kind}, _f array<double>")
    e = F.col(fit.y_column) - sum((F.col(c) * float(b) for c, b in zip(fit.columns, fit.estimate, strict=True)), F.lit(0.0))
    joined = fit.design.join(table, p.time)
    return joined.groupBy(p.unit).agg(F.array(*[F.sum(e * F.get("_f", F.lit(i))) / len(times) for i in range(f.shape[1])]).alias("loading"))
