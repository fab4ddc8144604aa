"""What a fit returns: small DataFrames, and accessors over them."""

from __future__ import annotations

import dataclasses
import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tails import normal_quantile, two_sided
from ..plans.formula import ModelSpec
from ..sources.panel import Panel

CONST, TREND = "(Intercept)", "(trend)"


def coef_table(names: list[str], b: np.ndarray, v: np.ndarray, kind: str = "mg", level: float = 0.95) -> list[tuple]:
    """Rows (term, estimate, std_error, statistic, p_value, conf_low, conf_high, type)."""
    z = 1.96 if level == 0.95 else normal_quantile(0.5 + level / 2)
    rows = []
    for name, est, var in zip(names, np.asarray(b, float).tolist(), np.diag(v).tolist(), strict=True):
        se = math.sqrt(max(var, 0.0)) if not math.isnan(var) else math.nan
        t = est / se if se > 0 else math.nan
        rows.append((name, est, se, t, two_sided(t) if not math.isnan(t) else math.nan, est - z * se, est + z * se, kind))
    return rows


COEF = "term string, estimate double, std_error double, statistic double, p_value double, conf_low double, conf_high double, type string"


@dataclass
class PanelFit:
    """A fitted model.

    units: unit and the columns of ols.SOLVED, one row a unit that was not
    dropped; names: the coefficients' labels in the order of b, those of
    averages last; kept: how many of them are reported.
    """

    spec: ModelSpec
    panel: Panel
    design: DataFrame  # unit, time, y and regressors under safe names
    y_column: str
    columns: list[str]
    names: list[str]
    kept: int
    units: DataFrame
    estimate: np.ndarray
    variance: np.ndarray
    csa: list[str] = field(default_factory=list)
    extra: list[tuple] = field(default_factory=list)  # coefficient rows of other types
    info: dict = field(default_factory=dict)

    @property
    def spark(self):
        return self.design.sparkSession

    @property
    def terms(self) -> list[str]:
        return self.names[: self.kept]

    @property
    def coef_rows(self) -> list[tuple]:
        return coef_table(self.terms, self.estimate, self.variance) + self.extra

    def coef(self, include_lr: bool = True) -> DataFrame:
        rows = self.coef_rows if include_lr else coef_table(self.terms, self.estimate, self.variance)
        return self.spark.createDataFrame([tuple(None if isinstance(x, float) and math.isnan(x) else x for x in r) for r in rows], COEF)

    tidy = coef

    def __getitem__(self, term: str) -> float:
        return float(self.estimate[self.terms.index(term)])

    def unit_coef(self) -> DataFrame:
        """unit, term, estimate."""
        pairs = F.explode(F.arrays_zip(F.array(*[F.lit(t) for t in self.terms]).alias("term"), F.slice("b", 1, self.kept).alias("estimate")))
        return self.units.select(self.panel.unit, pairs.alias("x")).select(self.panel.unit, "x.term", "x.estimate")

    def vcov(self) -> DataFrame:
        rows = [(a, b, float(self.variance[i, j])) for i, a in enumerate(self.terms) for j, b in enumerate(self.terms)]
        return self.spark.createDataFrame(rows, "term_i string, term_j string, value double")

    def unit_stats(self) -> DataFrame:
        """Every unit of the panel: n, k, df_resid, sigma2, r2, rank_ok and dropped."""
        got = self.units.select(self.panel.unit, "n", "k", (F.col("n") - F.col("k")).alias("df_resid"), "sigma2", "r2", "rank_ok", F.lit(False).alias("dropped"))
        every = self.panel.df.select(self.panel.unit).distinct()
        return every.join(got, self.panel.unit, "left").withColumn("dropped", F.coalesce("dropped", F.lit(True)))

    def n_dropped(self) -> int:
        """How many units had too few rows. It scans the panel, so it is not part of a fit."""
        return self.panel.df.select(self.panel.unit).distinct().count() - self.units.count()

    def resid(self) -> DataFrame:
        """unit, time, fitted, resid for the rows that the regressions used."""
        unit, time = self.panel.unit, self.panel.time
        rows = self.design.dropna(subset=[self.y_column, *self.columns]).join(self.units.select(unit, "b"), unit)
        const = int(CONST in self.names)
        value = F.get("b", F.lit(0)) if const else F.lit(0.0)
        place = [i for i, n in enumerate(self.names) if n != CONST]
        fitted = sum((F.col(c) * F.get("b", F.lit(i)) for c, i in zip(self.columns, place, strict=True)), value)
        return rows.select(unit, time, fitted.alias("fitted"), (F.col(self.y_column) - fitted).alias("resid"))

    def fitted(self) -> DataFrame:
        return self.resid().select(self.panel.unit, self.panel.time, "fitted")

    def summary_row(self) -> dict:
        r = self.units.agg(
            F.sum("n").alias("nobs"), F.count("*").alias("n_units"), F.avg("n").alias("t_bar"), F.avg("r2").alias("r_squared"),
            F.sqrt(F.sum("ssr") / F.sum("n")).alias("rmse"), F.sum("ssr").alias("ssr"),
        ).first()
        return r.asDict()

    def glance(self) -> DataFrame:
        """One row: nobs, n_units, t_bar, r_squared, adj_r_squared, rmse, cd_statistic, cd_p_value, estimator, cr_lags."""
        from .depend import cd_tests

        s = self.summary_row()
        cd = cd_tests(self.resid(), self.panel.unit, self.panel.time, "resid", ["pesaran"]).first() if s["n_units"] > 1 else None
        k = len(self.names)
        n = s["nobs"]
        adj = 1 - (1 - s["r_squared"]) * (n - s["n_units"]) / (n - s["n_units"] * k) if s["r_squared"] is not None and n > s["n_units"] * k else None
        lags = self.spec.csa_lags if isinstance(self.spec.csa_lags, int) else max(self.spec.csa_lags.values(), default=0)
        row = (n, s["n_units"], s["t_bar"], s["r_squared"], adj, s["rmse"], cd and cd["statistic"], cd and cd["p_value"], self.spec.model, lags)
        return self.spark.createDataFrame(
            [row],
            "nobs long, n_units long, t_bar double, r_squared double, adj_r_squared double, rmse double, cd_statistic double, cd_p_value double, estimator string, cr_lags int",
        )

    def confint(self, level: float = 0.95, terms: list[str] | None = None) -> DataFrame:
        z = normal_quantile(0.5 + level / 2)
        rows = [(r[0], r[1] - z * r[2], r[1] + z * r[2], r[7]) for r in self.coef_rows if terms is None or r[0] in terms]
        return self.spark.createDataFrame(rows, "term string, conf_low double, conf_high double, type string")

    def predict(self, new: DataFrame | None = None, kind: str = "unit") -> DataFrame:
        """unit, time, prediction. unit: each unit's own coefficients; mg: the mean ones, without averages."""
        from .estimators import design_columns

        unit, time = self.panel.unit, self.panel.time
        if new is None and kind == "unit":
            return self.resid().select(unit, time, F.col("fitted").alias("prediction"))
        p = self.panel if new is None else Panel(new, unit, time)
        rows, _, xs = design_columns(p, self.spec)
        if kind == "mg":
            value = sum(
                (F.col(c) * float(self.estimate[self.terms.index(n)]) for c, n in zip(xs, [t.label for t in self.spec.xs], strict=True)),
                F.lit(float(self.estimate[0]) if CONST in self.terms else 0.0),
            )
            return rows.select(unit, time, value.alias("prediction"))
        joined = rows.join(self.units.select(unit, "b"), unit, "left")
        value = sum((F.col(c) * F.get("b", F.lit(self.names.index(n))) for c, n in zip(xs, [t.label for t in self.spec.xs], strict=True)), F.get("b", F.lit(0)) if CONST in self.names else F.lit(0.0))
        return joined.select(unit, time, value.alias("prediction"))

    def update(self, **changes) -> PanelFit:
        """The same panel under a changed specification."""
        from .estimators import fit_spec

        return fit_spec(self.panel, dataclasses.replace(self.spec, **changes))

    def histogram(self, term: str, bins: int = 20) -> DataFrame:
        """bin, low, high, n of the unit coefficients: the data of a plot."""
        x = self.unit_coef().filter(F.col("term") == term)
        lo, hi = x.agg(F.min("estimate"), F.max("estimate")).first()
        width = (hi - lo) / bins or 1.0
        at = F.least(F.lit(bins - 1), F.floor((F.col("estimate") - lo) / width)).cast("int")
        return x.groupBy(at.alias("bin")).agg(F.count("*").alias("n")).select("bin", (F.col("bin") * width + lo).alias("low"), ((F.col("bin") + 1) * width + lo).alias("high"), "n")

    def __repr__(self) -> str:
        lines = [f"{self.spec.model} fit of {self.spec.y.label}", f"{'term':<20}{'estimate':>12}{'std error':>12}{'p':>9}"]
        for r in self.coef_rows:
            stars = "".join("*" for cut in (0.05, 0.01, 0.001) if r[4] < cut)
            lines.append(f"{r[0]:<20}{r[1]:>12.5f}{r[2]:>12.5f}{r[4]:>9.4f} {stars}" + (f"  [{r[7]}]" if r[7] != "mg" else ""))
        return "\n".join(lines)

    summary = __repr__
