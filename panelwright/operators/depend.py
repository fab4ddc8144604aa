"""Cross-sectional dependence: pair statistics once, then five tests and the exponent."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draws import draw_counts, sign_array
from ..functions.report import Report
from ..functions.tails import normal_quantile, two_sided
from ..sources.scratch import cut
from .ols import ols, period_products

TESTS = ("pesaran", "cdw", "cdwplus", "pea", "cdstar")


def pair_table(df: DataFrame, unit: str, time: str, value: str) -> DataFrame:
    """i, j, t (common periods, 3 at least) and rho for all pairs of units.

    Pairs are the statistic itself, so their number grows with the square of
    the number of units; rows meet by period. A pair without variance has no
    rho and is left out.
    """
    a = df.filter(F.col(value).isNotNull()).select(F.col(unit).alias("i"), F.col(time).alias("t"), F.col(value).cast("double").alias("x"))
    b = a.select(F.col("i").alias("j"), "t", F.col("x").alias("y"))
    pairs = a.join(b, "t").filter("i < j").groupBy("i", "j")
    sums = pairs.agg(
        F.count("*").alias("t"), F.covar_pop("x", "y").alias("c"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy")
    )
    return sums.filter((F.col("t") >= 3) & (F.col("vx") > 0) & (F.col("vy") > 0)).select(
        "i", "j", "t", (F.col("c") / F.sqrt(F.col("vx") * F.col("vy"))).alias("rho")
    )


def _sizes(df: DataFrame, unit: str, time: str, value: str) -> tuple[int, int]:
    return tuple(df.filter(F.col(value).isNotNull()).agg(F.count_distinct(unit), F.count_distinct(time)).first())


def signed_sums(pairs: DataFrame, term, reps: int, seed: int) -> np.ndarray:
    """For each draw of signs the sum over pairs of w_i w_j times a term. Tasks sum their own pairs; a row a batch comes to the driver."""
    number = lambda c: F.col(c).cast("long") if pairs.schema[c].dataType.typeName() in ("long", "integer", "short", "byte") else F.xxhash64(c)
    draw = np.arange(1, reps + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            total = np.zeros(reps)
            for a in range(0, len(pdf), 1024):
                i, j, x = (pdf[c].to_numpy()[a : a + 1024, None] for c in ("i", "j", "x"))
                total += (sign_array(i, draw, seed=seed) * sign_array(j, draw, seed=seed) * x).sum(axis=0)
            yield pd.DataFrame({"s": [total]})

    rows = pairs.select(number("i").alias("i"), number("j").alias("j"), term.cast("double").alias("x")).mapInPandas(run, "s array<double>").collect()
    return np.sum([r[0] for r in rows], axis=0) if rows else np.zeros(reps)


def balanced_total(df: DataFrame, unit: str, time: str, value: str) -> float | None:
    """The sum over pairs of sqrt(T) rho where every unit has every period, from sums of standardised values by period; None elsewhere.

    Pairs need not be formed then: twice the sum of rho over pairs is the sum
    over periods of squared sums over units, less the number of units.
    """
    d = df.filter(F.col(value).isNotNull()).select(F.col(unit).alias("u"), F.col(time).alias("t"), F.col(value).cast("double").alias("x"))
    units = d.groupBy("u").agg(F.count("*").alias("n"), F.count_distinct("t").alias("k"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    least, most, wide, varied = units.agg(F.min("n"), F.max("n"), F.min("k"), F.sum((F.col("v") > 0).cast("long"))).first()
    periods = d.select("t").distinct().count()
    if least is None or not (least == most == wide == periods) or periods < 3:
        return None
    z = (F.col("x") - F.col("m")) / F.sqrt(F.col("v") * periods)
    sums = d.join(units.filter("v > 0"), "u").groupBy("t").agg(F.sum(z).alias("s"))
    total = sums.agg(F.sum(F.col("s") * F.col("s"))).first()[0]
    return math.sqrt(periods) * ((total or 0.0) - varied) / 2


def top_share(df: DataFrame, unit: str, time: str, value: str, n_pca: int = 1) -> float | None:
    """The share of the largest eigenvalues of the rows of periods in which every unit has a value; None for under 3 such."""
    n = df.select(unit).distinct().count()
    full = df.filter(F.col(value).isNotNull()).groupBy(time).agg(F.count("*").alias("n")).filter(F.col("n") == n).select(time)
    d = df.join(full, time)
    times = [r[0] for r in full.orderBy(time).collect()]
    if len(times) < 3:
        return None
    g = time_gram(d, unit, time, value, times)
    values = np.linalg.eigvalsh(g)[::-1]
    return float(values[:n_pca].sum() / values.sum())


def time_gram(df: DataFrame, unit: str, time: str, value: str, times: list) -> np.ndarray:
    """E'E, T x T: sums over units of products of two periods. It is as large as the number of periods squared."""
    return period_products(df, unit, time, [value], times)[0, 0]


def cd_tests(df: DataFrame, unit: str, time: str, value: str, tests: list[str] | None = None, reps: int = 500, seed: int = 0, n_pca: int = 1) -> DataFrame:
    """test, statistic, p_value (two-sided normal) of a column, by default without cdwplus.

    cdw keeps the published average over signed draws, which is near zero even
    under a strong factor; read it with that in mind.
    """
    tests = tests or [t for t in TESTS if t != "cdwplus"]
    for t in tests:
        if t not in TESTS:
            raise ValueError(f"test is one of {', '.join(TESTS)}")
    n, t_all = _sizes(df, unit, time, value)
    if n < 2:
        raise ValueError("two units at least are needed")
    scale = math.sqrt(2.0 / (n * (n - 1)))
    total = balanced_total(df, unit, time, value)
    pairs = None if total is not None and not {"pea", "cdw", "cdwplus"} & set(tests) else cut(pair_table(df, unit, time, value), "pairs")
    if total is None:
        total = pairs.agg(F.sum(F.sqrt("t") * F.col("rho"))).first()[0] or 0.0
    cd = scale * total
    out = []
    for name in tests:
        if name == "pesaran":
            s = cd
        elif name == "pea":
            least = 2 * math.sqrt(math.log(n) / t_all)
            s = cd + (pairs.filter(F.abs("rho") > least).agg(F.sum(F.abs("rho"))).first()[0] or 0.0)
        elif name == "cdw":
            s = scale * signed_sums(pairs, F.sqrt("t") * F.col("rho"), reps, seed).mean()
        elif name == "cdwplus":
            term = ((F.col("t") - 1) * F.col("rho") * F.col("rho") - 1) / F.lit(math.sqrt(2.0))
            s = math.sqrt(1.0 / (n * (n - 1))) * np.abs(signed_sums(pairs, term, reps, seed)).mean()
        else:
            theta = top_share(df, unit, time, value, n_pca)
            theta = None if theta is None else min(theta, 0.99)
            s = cd if theta is None else (cd + math.sqrt(t_all / 2) * theta) / (1 - theta)
        out.append((name, float(s), two_sided(s)))
    return df.sparkSession.createDataFrame(out, "test string, statistic double, p_value double")


def exponent_variable(df: DataFrame, unit: str, time: str, value: str, size: float = 0.05) -> dict:
    """alpha, se, low, high of the exponent of cross-sectional dependence of a variable."""
    d = df.filter(F.col(value).isNotNull())
    means = d.groupBy(time).agg(F.avg(value).alias("_m"))
    n = d.select(unit).distinct().count()
    mean, var = means.agg(F.avg("_m"), F.var_samp("_m")).first()
    rows = d.join(means, time).withColumn("_z", (F.col("_m") - mean) / math.sqrt(var))
    fits = ols(rows, [unit], value, ["_z"])
    enough = fits.filter("n >= 3")
    slope, se = F.get("b", F.lit(1)), F.sqrt(F.get("v", F.lit(3)))
    r = enough.agg(
        F.avg(F.when(F.abs(slope / se) > normal_quantile(1 - size / 2), slope * slope)).alias("mu2"), F.sum("sigma2").alias("c")
    ).first()
    mu2 = r["mu2"] if r["mu2"] is not None else 1e-10
    ln = math.log(n)
    alpha = 1 + math.log(var) / (2 * ln) - math.log(mu2) / (2 * ln) - r["c"] / (2 * n * ln * var)
    s = 1 / (2 * ln * math.sqrt(n))
    return Report("Exponent of cross-sectional dependence", {"alpha": alpha, "se": s, "low": alpha - 1.96 * s, "high": alpha + 1.96 * s})


def exponent_residual(df: DataFrame, unit: str, time: str, value: str, tuning: float = 0.5, reps: int = 100, seed: int = 0) -> dict:
    """alpha from the correlations that survive a threshold; .5 if none does. Units are drawn anew for the error.

    A unit drawn twice is a pair with correlation one, as in the published bootstrap.
    """
    n, t = _sizes(df, unit, time, value)
    title = "Exponent of cross-sectional dependence of residuals"
    least = tuning * math.sqrt(math.log(n * t) / t)
    pairs = cut(pair_table(df, unit, time, value).filter(F.abs("rho") > least), "strong_pairs")
    quad = 2 * (pairs.agg(F.sum("rho")).first()[0] or 0.0)
    if quad <= 0:
        return Report(title, {"alpha": 0.5, "se": None, "low": None, "high": None})
    counts = cut(draw_counts(df.select(unit).distinct(), unit, reps, seed).groupBy("rep", F.col(unit).alias("u")).agg(F.count("*").alias("c")), "draws")
    # A unit drawn c times makes c(c - 1) pairs with itself, of correlation one.
    same = counts.groupBy("rep").agg(F.sum(F.col("c") * (F.col("c") - 1)).alias("same"))
    ci, cj = (counts.select("rep", F.col("u").alias(x), F.col("c").alias(f"c{x}")) for x in ("i", "j"))
    sums = pairs.join(ci, "i").join(cj, ["rep", "j"]).groupBy("rep").agg(F.sum(F.col("ci") * F.col("cj") * F.col("rho")).alias("s"))
    rows = same.join(sums, "rep", "left").select(F.col("same") * (1.0 if least < 1 else 0.0) + 2 * F.coalesce("s", F.lit(0.0))).collect()  # a row a draw
    draws = np.array([r[0] for r in rows])
    alphas = np.where(draws > 0, np.log(np.maximum(draws, 1e-300)) / (2 * math.log(n)), 0.5)
    low, high = np.quantile(alphas, [0.025, 0.975])
    return Report(title, {"alpha": math.log(quad) / (2 * math.log(n)), "se": float(alphas.std(ddof=1)), "low": float(low), "high": float(high)})
