"""Bootstrap errors and impulse responses."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draws import draw_counts, sign_array
from ..sources.scratch import cut
from .fit import CONST, PanelFit
from .ols import RANK_TOL, pooled_inverse_variance


def bootstrap(fit: PanelFit, kind: str = "cross_section", reps: int = 500, seed: int = 0) -> DataFrame:
    """term, estimate, std_error, low, high of what the fit reports.

    cross_section draws units and estimates as the fit does: mean-group slopes,
    slopes pooled by inverse variance (ccep), or slopes corrected by halves of
    the panel. wild flips the sign of each residual of mean-group slopes (each
    row's, as one sign a unit would leave every coefficient where it is); it is
    not defined for the others.
    """
    plain = fit.spec.model != "ccep" and "halves" not in fit.info
    if kind == "cross_section":
        means = _drawn(fit, reps, seed)
    elif kind == "wild":
        if not plain:
            raise ValueError("the wild bootstrap is of mean-group slopes")
        means = _wild(fit, reps, seed)
    else:
        raise ValueError("kind is cross_section or wild")
    low, high = np.quantile(means, 0.025, axis=0), np.quantile(means, 0.975, axis=0)
    spread = means.std(axis=0, ddof=1)
    rows = [(t, float(fit.estimate[i]), float(spread[i]), float(low[i]), float(high[i])) for i, t in enumerate(fit.terms)]
    return fit.spark.createDataFrame(rows, "term string, estimate double, std_error double, low double, high double")


def _drawn(fit: PanelFit, reps: int, seed: int) -> np.ndarray:
    """The estimate of each draw of units: a row a draw comes to the driver."""
    u, k, p = fit.panel.unit, fit.kept, len(fit.names)
    if fit.spec.model == "ccep":

        def weights(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    v = np.stack(pdf["v"]).reshape(len(pdf), p, p)[:, :k, :k]
                    w = np.linalg.pinv(v, rcond=RANK_TOL, hermitian=True)
                    wb = np.einsum("bij,bj->bi", w, np.stack(pdf["b"])[:, :k])
                    yield pd.DataFrame({u: pdf[u], "s": list(np.concatenate([w.reshape(len(pdf), -1), wb], axis=1))})

        kind = fit.units.schema[u].dataType.simpleString()
        own = fit.units.filter("sigma2 > 0").select(u, "b", "v").mapInPandas(weights, f"`{u}` {kind}, s array<double>")
        sums = draw_counts(own, u, reps, seed).groupBy("rep").agg(F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(k * k + k)]).alias("s"))
        return np.array([pooled_inverse_variance(np.reshape(r.s[: k * k], (k, k)), np.array(r.s[k * k :]))[0] for r in sums.collect()])
    mean = lambda: F.array(*[F.avg(F.get("b", F.lit(i))) for i in range(k)]).alias("m")
    draws = cut(draw_counts(fit.units.select(u, "b"), u, reps, seed).select("rep", u, "b"), "draws")
    found = {r.rep: np.array(r.m, float) for r in draws.groupBy("rep").agg(mean()).collect()}
    if "halves" in fit.info:
        halves = draws.select("rep", u).join(fit.info["halves"].select("_half", u, "b"), u).groupBy("rep", "_half").agg(mean()).collect()
        found = {r: 2 * m - 0.5 * np.sum([h.m for h in halves if h.rep == r], axis=0) for r, m in found.items()}
    return np.array([found[r] for r in sorted(found)])


def _wild(fit: PanelFit, reps: int, seed: int) -> np.ndarray:
    """Mean coefficients with signed residuals: b* = b + (X'X)^-1 X'(s e), unit by unit; sums over units come to the driver, a row a batch."""
    u, t, k, p = fit.panel.unit, fit.panel.time, fit.kept, len(fit.names)
    resid = fit.resid().select(u, t, "resid")
    rows = fit.design.dropna(subset=[fit.y_column, *fit.columns]).join(resid, [u, t])
    whole = lambda c: rows.schema[c].dataType.typeName() in ("long", "integer", "short", "byte")
    parts = [F.col(u).cast("long"), F.col(t).cast("long")] if whole(u) and whole(t) else [F.xxhash64(u, t), F.lit(0).cast("long")]
    cols = ([F.lit(1.0)] if CONST in fit.names else []) + [F.col(c) for c in fit.columns]
    held = rows.select(F.col(u).alias("u"), parts[0].alias("p"), parts[1].alias("q"), F.col("resid").alias("e"), F.array(*cols).alias("x"))
    kind = held.schema["u"].dataType.simpleString()
    draw = np.arange(1, reps + 1)

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((reps, p))
        x = np.stack(pdf["x"])
        for a in range(0, len(pdf), 512):
            some = slice(a, a + 512)
            signs = sign_array(draw[None, :], pdf["p"].to_numpy()[some, None], pdf["q"].to_numpy()[some, None], seed=seed)
            total += (signs * pdf["e"].to_numpy()[some, None]).T @ x[some]
        return pd.DataFrame({"u": pdf["u"].iloc[:1], "xe": [total.ravel()]})

    found = held.groupBy("u").applyInPandas(sums, f"u {kind}, xe array<double>")
    joined = found.join(fit.units.select(F.col(u).alias("u"), "b", "v", "sigma2"), "u")

    def stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                inverse = np.stack(pdf["v"]).reshape(len(pdf), p, p) / pdf["sigma2"].to_numpy()[:, None, None]
                b = np.stack(pdf["b"])[:, None, :k] + np.einsum("brj,bij->bri", np.stack(pdf["xe"]).reshape(len(pdf), reps, p), inverse)[:, :, :k]
                yield pd.DataFrame({"n": [len(pdf)], "s": [b.sum(axis=0).ravel()]})

    parts = joined.select("b", "v", "sigma2", "xe").mapInPandas(stars, "n long, s array<double>").collect()
    return np.sum([r.s for r in parts], axis=0).reshape(reps, k) / sum(r.n for r in parts)


def response(phis: dict[int, float], betas: dict[int, float], horizon: int) -> np.ndarray:
    """A unit shock's path: its own terms by lag, and the lags of y by order."""
    out = np.zeros(horizon + 1)
    for h in range(horizon + 1):
        out[h] = betas.get(h, 0.0) + sum(p * out[h - k] for k, p in phis.items() if h >= k)
    return out


def impulse_response(fit: PanelFit, impulse: str, horizon: int = 10, reps: int = 200, seed: int = 0, all_lags: bool = False) -> DataFrame:
    """horizon, response, low, high. all_lags: a shock to the variable works through its lags too."""
    y, terms = fit.spec.y.var, fit.spec.xs
    lags = {t.k: fit.terms.index(t.label) for t in terms if t.var == y and t.op == "L" and t.k > 0}
    if not lags:
        raise ValueError("no lag of the dependent variable")
    if impulse not in fit.terms:
        raise ValueError(f"no term {impulse!r}")
    own = next(t for t in terms if t.label == impulse)
    group = {t.k if t.op == "L" else 0: fit.terms.index(t.label) for t in terms if t.var == own.var and t.op in ("", "L")} if all_lags else {0: fit.terms.index(impulse)}

    def path(b) -> np.ndarray:
        return response({k: b[i] for k, i in lags.items()}, {k: b[i] for k, i in group.items()}, horizon)

    main = path(fit.estimate)
    low = high = [None] * (horizon + 1)
    if reps:
        paths = np.array([path(b) for b in _drawn(fit, reps, seed)])
        low, high = np.quantile(paths, 0.025, axis=0), np.quantile(paths, 0.975, axis=0)
    rows = [(h, float(main[h]), None if low[h] is None else float(low[h]), None if high[h] is None else float(high[h])) for h in range(horizon + 1)]
    return fit.spark.createDataFrame(rows, "horizon int, response double, low double, high double")
