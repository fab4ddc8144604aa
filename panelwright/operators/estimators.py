"""Mean-group estimators: one plan from the specification to a row a unit."""

from __future__ import annotations

import contextlib
import dataclasses
import math
import weakref

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tails import two_sided
from ..plans.formula import ModelSpec, Term, classify, parse
from ..sources.panel import Panel
from . import transforms as tr
from .fit import CONST, TREND, PanelFit
from .ols import gram, pooled_inverse_variance, solve, weighted_sums

MODELS = ("mg", "cce", "dynamic_cce", "rcce", "ccep", "amg", "ife", "csdl", "csardl", "pmg")


def fit(panel: Panel, formula: str, model: str = "cce", csa: str | None = "~ .", weights: DataFrame | None = None, **params) -> PanelFit:
    """Fit a model.

    csa: variables whose averages over units are added; all by default, and
    with model mg too, unless it is None. params: the other fields of
    ModelSpec; absorb may be written as ``~ a + b``. weights: edges (unit_i, unit_j, w) where csa_from is spatial.
    """
    if model not in MODELS:
        raise ValueError(f"model is one of {', '.join(MODELS)}")
    options = {k: params.pop(k) for k in ("by",) if k in params}
    if isinstance(params.get("absorb"), str):
        params["absorb"] = tuple(x.strip() for x in params["absorb"].replace("~", "").split("+"))
    spec = parse(formula, csa, model=model, options=options, **params)
    if spec.correction not in (None, "jackknife", "half_panel"):
        raise ValueError(f"correction {spec.correction!r} is not implemented")
    return fit_spec(panel, spec, weights)


def design_columns(panel: Panel, spec: ModelSpec) -> tuple[DataFrame, str, list[str]]:
    """The panel's rows with the columns of y and the terms under safe names."""
    y, xs = f"_y_{spec.y.column}", [f"_x_{t.column}" for t in spec.xs]
    missing = [v for v in dict.fromkeys([*spec.variables, *spec.csa_variables]) if v not in panel.df.columns]
    if missing:
        raise ValueError(f"columns not found: {', '.join(missing)}")
    terms = {c: t.expr(panel.by_unit) for c, t in zip([y, *xs], [spec.y, *spec.xs], strict=True)}
    return panel.df.withColumns(terms), y, xs


def rewrite(panel: Panel, spec: ModelSpec) -> tuple[Panel, ModelSpec]:
    """Models that are others on changed columns."""
    if spec.model == "csdl":
        y = Term(spec.y.var, "D", 1)
        xs: list[Term] = []
        columns = {}
        for t in spec.xs:
            base = f"{t.var}__dx" if not t.op else f"{t.column}__dx"
            columns[f"{t.column}__lv"] = t.expr(panel.by_unit)
            columns[base] = t.expr(panel.by_unit)
        wide = panel.with_columns({k: v for k, v in columns.items() if k.endswith("__dx")})
        wide = wide.with_columns({c: F.col(c) - F.lag(c, 1).over(panel.by_unit) for c in columns if c.endswith("__dx")})
        for t in spec.xs:
            base = f"{t.var}__dx" if not t.op else f"{t.column}__dx"
            xs += [t, Term(base)] + [Term(base, "L", k) for k in range(1, spec.p_x + 1)]
        csa = spec.csa if spec.csa is not None else tuple(spec.variables)
        return wide, dataclasses.replace(spec, y=y, xs=tuple(xs), csa=csa)
    if spec.model == "amg":
        names = []
        wide, y, xs = design_columns(panel, spec)
        held = panel.with_df(wide)
        held = tr.attach_cdp(held, y, xs)
        names = [c for c in panel.df.columns] + ["cdp_level"]
        csa = spec.csa if spec.csa is not None else tuple(spec.variables)  # the process gets no average of its own
        return panel.with_df(held.df.select(*names)), dataclasses.replace(spec, xs=(*spec.xs, Term("cdp_level")), csa=csa)
    return panel, spec


def build(panel: Panel, spec: ModelSpec, weights: DataFrame | None = None) -> tuple[DataFrame, str, list[str], list[str]]:
    """unit, time, y and regressors; the averages' names; lazily."""
    rows, y, xs = design_columns(panel, spec)
    p = panel.with_df(rows)
    if spec.absorb:
        p = tr.absorb(p, [y, *xs], list(spec.absorb))
    csa: list[str] = []
    if spec.csa_variables:
        source = p
        if spec.absorb:  # averages are of what the regressions see
            known = {t.var: c for t, c in zip([spec.y, *spec.xs], [y, *xs], strict=True) if not t.op}
            source = p.with_columns({v: F.col(known[v]) for v in spec.csa_variables if v in known})
            p = source
        lags = spec.csa_lags
        if spec.csa_from == "spatial":
            if weights is None:
                raise ValueError("spatial averages need weights")
            p = tr.csa_spatial(p, spec.csa_variables, tr.spatial_weights(weights), lags)
        elif spec.csa_from == "cluster":
            p = tr.csa_cluster(p, spec.csa_variables, spec.options["by"], lags)
        else:
            p = tr.csa_global(p, spec.csa_variables, lags)
        csa = tr.csa_names(spec.csa_variables, lags)
        if spec.model == "rcce":
            p, csa = _principal_components(p, csa, spec.n_factors)
    extra = []
    if spec.trend:
        p = p.with_columns({"_trend": F.row_number().over(p.by_unit).cast("double")})
        extra = ["_trend"]
    columns = [*xs, *extra, *csa]
    return p.df.select(panel.unit, panel.time, F.col(y).alias("_y"), *[F.col(f"`{c}`").cast("double").alias(f"_c{i}") for i, c in enumerate(columns)]), "_y", columns, csa


def _principal_components(p: Panel, csa: list[str], n: int | None) -> tuple[Panel, list[str]]:
    """The first components of the table of averages (a row a period) in place of it."""
    from .select import growth_ratio

    table = p.df.select(p.time, *csa).distinct().dropna().orderBy(p.time).toPandas()
    x = table[csa].to_numpy(float)
    scale = x.std(axis=0)
    keep = scale > 1e-12
    x = (x[:, keep] - x[:, keep].mean(axis=0)) / scale[keep]
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    k = n or max(1, growth_ratio(s**2, max(1, len(s) - 1)))
    k = min(k, int((s > s[0] * 1e-10).sum()))
    names = [f"csa_pc{i + 1}" for i in range(k)]
    rows = [(t, *map(float, r)) for t, r in zip(table[p.time].tolist(), (u * s)[:, :k], strict=True)]
    kind = p.df.schema[p.time].dataType.simpleString()
    pcs = p.df.sparkSession.createDataFrame(rows, f"`{p.time}` {kind}, " + ", ".join(f"{c} double" for c in names))
    return p.with_df(p.df.drop(*csa).join(pcs, p.time, "left")), names


def mean_group(units: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Means of the first k coefficients over units, and their variance: cross products over N squared."""
    aggs = [F.count("*").alias("n")] + [F.avg(F.get("b", F.lit(i))) for i in range(k)]
    aggs += [F.covar_pop(F.get("b", F.lit(i)), F.get("b", F.lit(j))) for i in range(k) for j in range(i, k)]
    row = units.agg(*aggs).first()
    n = row[0]
    if not n:
        raise ValueError("no unit has enough rows")
    b = np.array(row[1 : k + 1], float)
    v = np.zeros((k, k))
    at = np.triu_indices(k)
    v[at] = np.array(row[k + 1 :], float) / n
    return b, v + np.triu(v, 1).T


def _release(units: DataFrame) -> None:
    """The unit table of a fit that is gone leaves the cache; a plan that still reads it makes it anew."""
    with contextlib.suppress(Exception):  # the session may have ended
        units.unpersist()


def fit_spec(panel: Panel, spec: ModelSpec, weights: DataFrame | None = None) -> PanelFit:
    if spec.model == "ife":
        from .ife import fit_ife

        return fit_ife(panel, spec)
    own_panel, own = rewrite(panel, spec)
    design, y, columns, csa = build(own_panel, own, weights)
    cols = [f"_c{i}" for i in range(len(columns))]
    # Averages that are all zero (absorbed periods) or equal to another column would make every system singular.
    if spec.absorb and csa:
        spread = design.agg(*[F.max(F.abs(F.col(f"_c{columns.index(c)}"))) for c in csa]).first()
        dead = {c for c, s in zip(csa, spread, strict=True) if s is None or s < 1e-8}
        pairs = [(c, n) for c, n in zip(cols, columns, strict=True) if n not in dead]
        cols, columns, csa = [c for c, _ in pairs], [n for _, n in pairs], [c for c in csa if c not in dead]
    labels = [t.label for t in own.xs] + ([TREND] if own.trend else [])
    if spec.model == "amg":  # the process is a nuisance column
        at = [t.column for t in own.xs].index("cdp_level")
        order = [i for i in range(len(columns)) if i != at]
        order = order[: len(own.xs) - 1 + own.trend] + [at] + order[len(own.xs) - 1 + own.trend :]
        cols, columns = [cols[i] for i in order], [columns[i] for i in order]
        labels = [x for i, x in enumerate(labels) if i != at]
    names = ([CONST] if own.constant else []) + labels + [f"~{c}" for c in columns[len(labels) :]]
    kept = len(labels) + own.constant
    u = panel.unit
    held = gram(design, [u], y, cols).filter(F.col("n") > len(cols) + own.constant)
    units = solve(held, [u], own.constant).persist()
    b, v = mean_group(units, kept)
    result = PanelFit(spec, panel, design, y, cols, names, kept, units, b, v, csa)
    weakref.finalize(result, _release, units)
    if own.correction and spec.model in ("cce", "dynamic_cce"):
        half = half_panel_mean if own.correction == "half_panel" else calendar_half_mean
        mean = half(result, own_panel)
        if mean is not None:
            result.estimate = 2 * b - mean
    if spec.model == "ccep":
        _, w, wb, _ = weighted_sums(units, list(range(kept)), len(names))
        result.estimate, result.variance = pooled_inverse_variance(w, wb)
    if spec.model in ("csardl", "pmg"):
        result.extra = long_run_rows(result, pooled=spec.model == "pmg")
    if spec.model == "csdl":
        level = [t.label for t in spec.xs]
        result.extra = [(*r[:7], "lr") for r in result.coef_rows if r[0] in level]
    return result


def calendar_half_mean(f: PanelFit, panel: Panel) -> np.ndarray | None:
    """Half of the sum of mean-group estimates over the first and second half of the periods."""
    grid = panel.periods()
    t = grid.count()
    half = F.when(F.col("pos") <= t // 2, 1).otherwise(2).alias("_half")
    return _halves(f, f.design.join(grid.select(f.panel.time, half), f.panel.time))


def half_panel_mean(f: PanelFit, panel: Panel) -> np.ndarray | None:
    """The same over the halves of each unit's own complete rows; units with a short half leave both."""
    u, w = f.panel.unit, Window.partitionBy(f.panel.unit)
    rows = f.design.dropna(subset=[f.y_column, *f.columns]).join(f.units.select(u), u, "left_semi")
    place = F.row_number().over(w.orderBy(f.panel.time))
    size = F.count("*").over(w)
    rows = rows.withColumns({"_at": place, "_n": size}).withColumn("_half", F.when(F.col("_at") <= F.floor(F.col("_n") / 2), 1).otherwise(2))
    k = len(f.names)
    rows = rows.filter((F.floor(F.col("_n") / 2) >= k + 1) & (F.col("_n") - F.floor(F.col("_n") / 2) >= k + 1))
    return _halves(f, rows, least_units=2)


def _halves(f: PanelFit, rows: DataFrame, least_units: int = 1) -> np.ndarray | None:
    u = f.panel.unit
    const = CONST in f.names
    g = gram(rows, ["_half", u], f.y_column, f.columns).filter(F.col("n") > len(f.names))
    b = solve(g, ["_half", u], const)
    f.info["halves"] = b
    means = b.groupBy("_half").agg(F.count("*").alias("n"), *[F.avg(F.get("b", F.lit(i))).alias(f"m{i}") for i in range(f.kept)]).collect()
    if len(means) < 2 or min(r["n"] for r in means) < least_units:
        return None
    return 0.5 * np.sum([[r[f"m{i}"] for i in range(f.kept)] for r in means], axis=0)


def long_run_units(f: PanelFit) -> tuple[DataFrame, list[str]]:
    """unit, adj, adj_var and for each variable lr_i, lr_var_i: long-run coefficients by the delta method.

    With d = 1 - sum of the lags of y: a long-run coefficient is its group's sum
    over d, with derivatives 1/d by its terms and sum/d^2 by the lags of y.
    """
    y_lags, groups = classify(f.spec)
    at = {t: f.names.index(t.label) for t in f.spec.xs}
    k = len(f.names)
    b = lambda t: F.get("b", F.lit(at[t]))
    v = lambda s, t: F.get("v", F.lit(at[s] * k + at[t]))
    total = lambda xs: sum(xs, F.lit(0.0))
    d = F.lit(1.0) - total([b(t) for t in y_lags])
    cols = [(-d).alias("adj"), total([v(s, t) for s in y_lags for t in y_lags]).alias("adj_var")]
    for i, terms in enumerate(groups.values()):
        s = total([b(t) for t in terms])
        grad = {**{t: F.lit(1.0) / d for t in terms}, **{t: s / (d * d) for t in y_lags}}
        cols += [
            (s / d).alias(f"lr_{i}"),
            total([grad[p] * grad[q] * v(p, q) for p in grad for q in grad]).alias(f"lr_var_{i}"),
        ]
    return f.units.select(f.panel.unit, *cols), list(groups)


def long_run_rows(f: PanelFit, pooled: bool) -> list[tuple]:
    """Adjustment and long-run coefficients as mean-group rows, and pooled by inverse variance."""
    units, names = long_run_units(f)
    aggs = [F.count("*").alias("n"), F.avg("adj").alias("adj"), F.var_samp("adj").alias("adj_v")]
    for i in range(len(names)):
        w = F.when((F.col(f"lr_var_{i}") > 0) & ~F.isnan(f"lr_var_{i}"), 1 / F.col(f"lr_var_{i}"))
        aggs += [F.avg(f"lr_{i}").alias(f"m{i}"), F.var_samp(f"lr_{i}").alias(f"v{i}"), F.sum(w * F.col(f"lr_{i}")).alias(f"p{i}"), F.sum(w).alias(f"w{i}")]
    r = units.agg(*aggs).first()

    def row(name: str, est: float, se: float, kind: str) -> tuple:
        t = est / se if se and se > 0 else math.nan
        return (name, est, se, t, two_sided(t) if not math.isnan(t) else math.nan, est - 1.96 * se, est + 1.96 * se, kind)

    root = lambda x: math.sqrt(x / r["n"]) if x is not None else math.nan
    out = [row("adjustment", r["adj"], root(r["adj_v"]), "adjustment")]
    out += [row(n, r[f"m{i}"], root(r[f"v{i}"]), "lr") for i, n in enumerate(names)]
    if pooled:
        out += [row(n, r[f"p{i}"] / r[f"w{i}"], math.sqrt(1 / r[f"w{i}"]), "lr_pooled") for i, n in enumerate(names) if r[f"w{i}"]]
    return out
