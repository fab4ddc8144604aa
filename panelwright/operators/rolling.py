"""Fits over many parts of the periods in one job: a regime is one more key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.formula import ModelSpec, parse
from ..sources.panel import Panel
from .fit import CONST, TREND
from .ols import RANK_TOL, gram, pooled_inverse_variance, solve


#: Models that other keys for units and periods are enough for.
MODELS = ("mg", "cce", "dynamic_cce", "ccep", "csdl", "csardl", "pmg")


def regimes(panel: Panel, spec: ModelSpec, bounds: list[tuple]) -> tuple[DataFrame, list[str], str]:
    """Unit regressions for each (id, first period, last period): lags and averages are made inside each regime, so early rows are lost.

    Returns id, unit, b, ...; the reported terms' names; and the id's name.
    """
    from . import transforms as tr
    from .estimators import build, rewrite

    if spec.model not in MODELS:
        raise ValueError(f"regimes take the models {', '.join(MODELS)}")
    if spec.absorb or spec.csa_from != "global":
        raise ValueError("regimes take global averages and no absorption")
    s = panel.df.sparkSession
    kind = panel.df.schema[panel.time].dataType.simpleString()
    # A row a period and regime, so that rows meet their regimes by equality.
    times = [r[0] for r in panel.df.select(panel.time).distinct().collect()]
    cells = [(i, t) for i, first, last in bounds for t in times if first <= t <= last]
    table = s.createDataFrame(cells, f"_regime int, _time {kind}")
    need = list(dict.fromkeys([*spec.variables, *spec.csa_variables]))
    rows = panel.df.select(panel.unit, panel.time, *need).join(table, F.col(panel.time) == F.col("_time"))
    # A unit of a regime and a period of a regime are the keys from here on.
    own = Panel(
        rows.select(
            F.struct("_regime", panel.unit).alias("_ru"), F.struct("_regime", panel.time).alias("_rt"), *need
        ),
        "_ru",
        "_rt",
    )
    own, spec = rewrite(own, spec)
    if spec.csa_variables:
        lags = {v: spec.lags_of(v) for v in spec.csa_variables}
        means = own.df.groupBy("_rt").agg(*[F.avg(F.col(c).cast("double")).alias(f"csa_{c}") for c in spec.csa_variables])
        from pyspark.sql import Window

        w = Window.partitionBy("_rt._regime").orderBy(f"_rt.{panel.time}")
        means = means.withColumns({f"csa_{c}_L{k}": F.lag(f"csa_{c}", k).over(w) for c in spec.csa_variables for k in range(1, lags[c] + 1)})
        own = own.with_df(own.df.join(means, "_rt", "left"))
        names = tr.csa_names(spec.csa_variables, lags)
    else:
        names = []
    import dataclasses

    design, y, columns, _ = build(own, dataclasses.replace(spec, csa=(), csa_lags=0))
    design = design.join(own.df.select("_ru", "_rt", *[F.col(c).alias(f"_a{i}") for i, c in enumerate(names)]), ["_ru", "_rt"]) if names else design
    cols = [f"_c{i}" for i in range(len(columns))] + [f"_a{i}" for i in range(len(names))]
    keyed = design.select(F.col("_ru._regime").alias("_regime"), F.col(f"_ru.{panel.unit}").alias("_unit"), y, *cols)
    fits = solve(gram(keyed, ["_regime", "_unit"], y, cols).filter(F.col("n") > len(cols) + spec.constant), ["_regime", "_unit"], spec.constant)
    terms = ([CONST] if spec.constant else []) + [t.label for t in spec.xs] + ([TREND] if spec.trend else [])
    return fits, terms, "_regime"


def regime_means(fits: DataFrame, terms: list[str], model: str = "mg") -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """For each regime the number of units, coefficients and their variance: means over units (variance over N squared), or pooled for ccep."""
    k = len(terms)
    if model == "ccep":
        return _regime_pools(fits, k)
    aggs = [F.count("*").alias("n")] + [F.avg(F.get("b", F.lit(i))) for i in range(k)]
    aggs += [F.covar_pop(F.get("b", F.lit(i)), F.get("b", F.lit(j))) for i in range(k) for j in range(i, k)]
    out = {}
    at = np.triu_indices(k)
    for r in fits.groupBy("_regime").agg(*aggs).collect():  # a row a regime
        v = np.zeros((k, k))
        v[at] = np.array(r[k + 2 :], float) / r[1]
        out[r[0]] = (r[1], np.array(r[2 : k + 2], float), v + np.triu(v, 1).T)
    return out


def _regime_pools(fits: DataFrame, k: int) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    def weights(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                b = np.stack(pdf["b"])
                v = np.stack(pdf["v"]).reshape(len(pdf), b.shape[1], -1)[:, :k, :k]
                w = np.linalg.pinv(v, rcond=RANK_TOL, hermitian=True)
                sums = np.concatenate([w.reshape(len(pdf), -1), np.einsum("bij,bj->bi", w, b[:, :k])], axis=1)
                yield pd.DataFrame({"_regime": pdf["_regime"], "s": list(sums)})

    own = fits.filter("sigma2 > 0").select("_regime", "b", "v").mapInPandas(weights, "_regime int, s array<double>")
    sums = own.groupBy("_regime").agg(F.count("*").alias("n"), F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(k * k + k)]).alias("s"))
    return {r[0]: (r.n, *pooled_inverse_variance(np.reshape(r.s[: k * k], (k, k)), np.array(r.s[k * k :]))) for r in sums.collect()}


def rolling(panel: Panel, formula: str, window: int = 20, step: int = 1, min_units: int = 5, model: str = "cce", csa: str | None = "~ .", **params) -> DataFrame:
    """window_start, window_end, term, estimate, std_error, conf_low, conf_high for each window of periods."""
    if window < 2 or step < 1:
        raise ValueError("window is 2 at least and step 1")
    spec = parse(formula, csa, model=model, **params)
    times = [r[0] for r in panel.df.select(panel.time).distinct().orderBy(panel.time).collect()]
    if len(times) < window:
        raise ValueError(f"the panel has {len(times)} periods, the window {window}")
    bounds = [(i, times[a], times[a + window - 1]) for i, a in enumerate(range(0, len(times) - window + 1, step))]
    fits, terms, _ = regimes(panel, spec, bounds)
    cells = [(i, t) for i, a, z in bounds for t in times if a <= t <= z]
    kind = panel.df.schema[panel.time].dataType.simpleString()
    table = panel.df.sparkSession.createDataFrame(cells, f"_regime int, _time {kind}")
    sizes = panel.df.select(panel.unit, panel.time).join(table, F.col(panel.time) == F.col("_time")).groupBy("_regime").agg(F.count_distinct(panel.unit).alias("n"))
    enough = {r[0] for r in sizes.filter(F.col("n") >= min_units).collect()}
    rows = []
    for i, (_, b, v) in sorted(regime_means(fits, terms, spec.model).items()):
        if i in enough:
            for j, t in enumerate(terms):
                se = float(np.sqrt(max(v[j, j], 0.0)))
                rows.append((bounds[i][1], bounds[i][2], t, float(b[j]), se, float(b[j] - 1.96 * se), float(b[j] + 1.96 * se)))
    if not rows:
        raise ValueError("no window produced a fit")
    return panel.df.sparkSession.createDataFrame(
        rows, f"window_start {kind}, window_end {kind}, term string, estimate double, std_error double, conf_low double, conf_high double"
    )
