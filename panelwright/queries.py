"""Registered panel queries over panels derived from the star-schema tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import breaks, coint, depend, estimators, granger, homogeneity, resample, rolling, select, unitroot, workflow
from .operators import transforms as tr
from .operators.ife import loadings
from .operators.ols import partial_out
from .sources.panel import Panel, simulate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns])


def one_row(spark: SparkSession, values: dict, schema: str) -> DataFrame:
    return rounded(spark.createDataFrame([tuple(values.values())], schema))


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _of(df: DataFrame) -> Panel:
    # The panels are grouped by their index, so it needs no check.
    return Panel.of(df, "unit", "t", check=False)


def _orders(spark: SparkSession, d: str, time: Column) -> Panel:
    o = _table(spark, d, "orders").select("o_custkey", "o_totalprice", "o_orderdate")
    c = _table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy(F.col("c_nationkey").alias("unit"), time.cast("long").alias("t"))
    return _of(rows.agg(F.avg(F.ln("o_totalprice")).alias("y"), (F.avg("c_acctbal") / 1000).alias("x"), F.ln(F.count("*")).alias("z")))


def panel_a(spark: SparkSession, d: str) -> Panel:
    """Nations by quarter."""
    return _orders(spark, d, F.year("o_orderdate") * 4 + F.quarter("o_orderdate"))


def panel_b(spark: SparkSession, d: str) -> Panel:
    """Nations by month."""
    return _orders(spark, d, F.year("o_orderdate") * 12 + F.month("o_orderdate"))


def panel_c(spark: SparkSession, d: str) -> Panel:
    """Suppliers by month."""
    rows = _table(spark, d, "lineitem").groupBy(
        F.col("l_suppkey").alias("unit"), (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("long").alias("t")
    )
    return _of(rows.agg(F.avg(F.ln("l_extendedprice")).alias("y"), (F.avg("l_quantity") / 10).alias("x"), (F.avg("l_discount") * 10).alias("z")))


def panel_d(spark: SparkSession, d: str) -> Panel:
    """Users by day, with gaps."""
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long")
    rows = _table(spark, d, "events").groupBy(F.col("user_id").alias("unit"), day.alias("t"))
    return _of(rows.agg(F.avg(F.ln(1 + F.col("value"))).alias("y"), F.count("*").cast("double").alias("x")))


def panel_e(spark: SparkSession, d: str) -> Panel:
    """Customers by quarter, with gaps."""
    quarter = (F.year("o_orderdate") * 4 + F.quarter("o_orderdate")).cast("long")
    rows = _table(spark, d, "orders").groupBy(F.col("o_custkey").alias("unit"), quarter.alias("t"))
    return _of(rows.agg(F.avg(F.ln("o_totalprice")).alias("y")))


def _regions(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "nation").select(F.col("n_nationkey").alias("unit"), F.col("n_regionkey").alias("region"))


@query
def panel_balance(spark, d):
    b = panel_b(spark, d).balance()
    return rounded(b.select(*[F.col(c).cast("long") for c in ("n_units", "t_min", "t_max", "n_periods")], "t_bar", "balanced"))


@query
def lag_lead_diff(spark, d):
    p = tr.diff(tr.lag(tr.lag(panel_d(spark, d), ["y"], 1), ["y"], -1), ["y"], 2)
    return rounded(p.df.select("unit", "t", F.col("y__l1").alias("lag1"), F.col("y__lm1").alias("lead1"), F.col("y__d2").alias("diff2")))


@query
def panel_matrix(spark, d):
    """The grid of units and periods as arrays, digested by length and sum."""
    m = panel_d(spark, d).matrix("y")
    total = F.aggregate("row", F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))
    return rounded(m.select("unit", F.size("row").cast("long").alias("n_periods"), F.size(F.filter("row", lambda v: v.isNotNull())).cast("long").alias("n_values"), total.alias("total")))


@query
def csa_global_lagged(spark, d):
    return rounded(tr.csa_global(panel_b(spark, d), ["y", "x"], {"y": 2, "x": 1}).df.select("unit", "t", *tr.csa_names(["y", "x"], {"y": 2, "x": 1})))


@query
def csa_cluster(spark, d):
    p = panel_a(spark, d)
    p = p.with_df(p.df.join(_regions(spark, d), "unit"))
    return rounded(tr.csa_cluster(p, ["y"], "region", 1).df.select("unit", "t", "csa_y", "csa_y_L1"))


@query
def csa_wider(spark, d):
    """Averages over all customers for the panel of nations."""
    return rounded(tr.csa_wider(panel_a(spark, d), panel_e(spark, d), ["y"], 1).df.select("unit", "t", "csa_y", "csa_y_L1"))


@query
def csa_spatial(spark, d):
    r = _regions(spark, d)
    edges = r.alias("a").join(r.alias("b"), "region").select(F.col("a.unit").alias("unit_i"), F.col("b.unit").alias("unit_j"), F.lit(1.0).alias("w"))
    return rounded(tr.csa_spatial(panel_a(spark, d), ["y"], tr.spatial_weights(edges), 1).df.select("unit", "t", "csa_y", "csa_y_L1"))


@query
def absorb_one_way(spark, d):
    return rounded(tr.absorb(panel_c(spark, d), ["y", "x"], ["unit"]).df.select("unit", "t", "y", "x"))


@query
def absorb_two_way(spark, d):
    return rounded(tr.absorb(panel_b(spark, d), ["y", "x"], ["unit", "t"]).df.groupBy("unit").agg(F.sum(F.col("y") * F.col("x")).alias("yx"), F.count("*").alias("n")))


def _coef(fit) -> DataFrame:
    return rounded(fit.coef().select("term", "estimate", "std_error", "type"))


@query
def mg_simple(spark, d):
    return _coef(estimators.fit(panel_a(spark, d), "y ~ x", "mg", csa=None))


@query
def mg_trend(spark, d):
    return _coef(estimators.fit(panel_a(spark, d), "y ~ x", "mg", csa=None, trend=True))


@query
def cce_mg(spark, d):
    return _coef(estimators.fit(panel_a(spark, d), "y ~ x", "cce"))


@query
def cce_mg_suppliers(spark, d):
    return _coef(estimators.fit(panel_c(spark, d), "y ~ x + z", "cce"))


@query
def dynamic_cce_mg(spark, d):
    return _coef(estimators.fit(panel_a(spark, d), "y ~ L(y,1) + x", "dynamic_cce", csa_lags=1))


@query
def jackknife(spark, d):
    return _coef(estimators.fit(panel_a(spark, d), "y ~ x", "cce", correction="jackknife")).drop("std_error")


@query
def half_panel(spark, d):
    return _coef(estimators.fit(panel_a(spark, d), "y ~ x", "cce", correction="half_panel")).drop("std_error")


@query
def ccep_pool(spark, d):
    return _coef(estimators.fit(panel_a(spark, d), "y ~ x", "ccep", constant=False))


@query
def csdl_long_run(spark, d):
    return _coef(estimators.fit(panel_a(spark, d), "y ~ x", "csdl", p_x=1)).filter("type = 'lr'")


@query
def csardl_long_run(spark, d):
    return _coef(estimators.fit(panel_a(spark, d), "y ~ L(y,1) + x", "csardl")).filter("type <> 'mg'")


@query
def pmg_pool(spark, d):
    return _coef(estimators.fit(panel_a(spark, d), "y ~ L(y,1) + x", "pmg")).filter("type = 'lr_pooled'")


@query
def amg(spark, d):
    return _coef(estimators.fit(panel_a(spark, d), "y ~ x", "amg", csa=None))


@query
def rcce(spark, d):
    return _coef(estimators.fit(panel_a(spark, d), "y ~ x + z", "rcce"))


@query
def ife(spark, d):
    return _coef(estimators.fit(panel_a(spark, d), "y ~ x + z", "ife", n_factors=1))


@query
def ife_loadings(spark, d):
    found = loadings(estimators.fit(panel_a(spark, d), "y ~ x", "ife", n_factors=1))
    return rounded(found.select("unit", F.abs(F.get("loading", F.lit(0))).alias("size")))


@query
def cce_absorbed(spark, d):
    return _coef(estimators.fit(panel_a(spark, d), "y ~ x", "cce", absorb=("unit",), constant=False))


def _mg(spark, d):
    return estimators.fit(panel_a(spark, d), "y ~ x", "mg", csa=None)


@query
def residuals(spark, d):
    return rounded(_mg(spark, d).resid().withColumnRenamed("t", "t"))


@query
def unit_stats(spark, d):
    return rounded(_mg(spark, d).unit_stats().select("unit", "n", "df_resid", "sigma2", "r2", "dropped"))


@query
def glance(spark, d):
    g = _mg(spark, d).glance()
    return rounded(g.select("nobs", "n_units", "t_bar", "r_squared", "rmse", "cd_statistic"))


@query
def predict_mg(spark, d):
    return rounded(_mg(spark, d).predict(kind="mg"))


@query
def confint(spark, d):
    return rounded(_mg(spark, d).confint(0.95).select("term", "conf_low", "conf_high"), 5)


def _cd(spark, d, test):
    p = panel_a(spark, d)
    return rounded(depend.cd_tests(p.df, "unit", "t", "y", [test]).select("test", "statistic"))


@query
def cd_pesaran(spark, d):
    return _cd(spark, d, "pesaran")


@query
def cd_pea(spark, d):
    return _cd(spark, d, "pea")


@query
def cdw_portable(spark, d):
    return _cd(spark, d, "cdw")


@query
def cdwplus_portable(spark, d):
    return _cd(spark, d, "cdwplus")


@query
def cd_star(spark, d):
    return _cd(spark, d, "cdstar")


@query
def exponent_variable(spark, d):
    p = panel_a(spark, d)
    r = depend.exponent_variable(p.df, "unit", "t", "y")
    return one_row(spark, {k: r[k] for k in ("alpha", "se")}, "alpha double, se double")


@query
def exponent_residual(spark, d):
    r = depend.exponent_residual(_mg(spark, d).resid(), "unit", "t", "resid")
    return one_row(spark, r, "alpha double, se double, low double, high double")


@query
def granger_k1(spark, d):
    r = granger.granger_test(panel_a(spark, d), "y", "x", 1)
    return one_row(spark, {k: r[k] for k in ("w_bar", "z_bar", "z_tilde", "n")}, "w_bar double, z_bar double, z_tilde double, n long")


@query
def cips0(spark, d):
    r = unitroot.cips_test(panel_a(spark, d), "y")
    return one_row(spark, {k: r[k] for k in ("statistic", "p_value", "n")}, "statistic double, p_value double, n long")


@query
def cips_trend_lag(spark, d):
    r = unitroot.cips_test(panel_a(spark, d), "y", 1, True)
    return one_row(spark, {k: r[k] for k in ("statistic", "p_value", "n")}, "statistic double, p_value double, n long")


@query
def ips0(spark, d):
    r = unitroot.unit_root_test(panel_a(spark, d), "y")
    return one_row(spark, {k: r[k] for k in ("statistic", "n")}, "statistic double, n long")


@query
def llc1(spark, d):
    r = unitroot.unit_root_test(panel_a(spark, d), "y", "llc", 1)
    return one_row(spark, {k: r[k] for k in ("statistic", "n")}, "statistic double, n long")


@query
def westerlund(spark, d):
    return rounded(coint.cointegration_test(panel_a(spark, d), "y ~ x", lags=1).select("test", "statistic"))


@query
def westerlund_bootstrap(spark, d):
    return rounded(coint.cointegration_test(panel_a(spark, d), "y ~ x", lags=1, bootstrap=99))


@query
def pedroni(spark, d):
    return rounded(coint.residual_cointegration_test(panel_a(spark, d), "y ~ x").select("test", "statistic"))


@query
def kao(spark, d):
    return rounded(coint.residual_cointegration_test(panel_a(spark, d), "y ~ x", "kao").select("test", "statistic"))


@query
def swamy(spark, d):
    r = homogeneity.swamy_test(_mg(spark, d))
    return one_row(spark, {k: r[k] for k in ("statistic", "delta", "df")}, "statistic double, delta double, df long")


@query
def hausman(spark, d):
    r = homogeneity.hausman_test(_mg(spark, d))
    return one_row(spark, {k: r[k] for k in ("statistic", "df")}, "statistic double, df long")


@query
def rolling_mg(spark, d):
    r = rolling.rolling(panel_c(spark, d), "y ~ x", 24, 12, model="mg", csa=None)
    return rounded(r.select("window_start", "window_end", "term", "estimate", "std_error"))


@query
def rolling_cce(spark, d):
    r = rolling.rolling(panel_a(spark, d), "y ~ x", 16, 4, model="cce")
    return rounded(r.select("window_start", "window_end", "term", "estimate", "std_error"))


@query
def rolling_ccep(spark, d):
    r = rolling.rolling(panel_a(spark, d), "y ~ x", 16, 4, model="ccep", constant=False)
    return rounded(r.select("window_start", "window_end", "term", "estimate", "std_error"))


@query
def rolling_csardl(spark, d):
    r = rolling.rolling(panel_a(spark, d), "y ~ L(y,1) + x", 20, 4, model="csardl")
    return rounded(r.select("window_start", "window_end", "term", "estimate", "std_error"))


BREAK = 1997 * 4 + 4


@query
def break_known(spark, d):
    r = breaks.break_test(panel_a(spark, d), "y ~ x", BREAK, model="mg", csa=None)
    return one_row(spark, {k: r[k] for k in ("statistic", "df")}, "statistic double, df long")


@query
def break_unknown(spark, d):
    r = breaks.break_test(panel_a(spark, d), "y ~ x", model="mg", csa=None)
    return rounded(spark.createDataFrame(r["candidates"], "date long, wald double"))


@query
def break_several(spark, d):
    r = breaks.break_test(panel_b(spark, d), "y ~ x", model="mg", csa=None, n_breaks=3)
    return spark.createDataFrame([(x,) for x in r["break_dates"]], "date long")


@query
def irf_path(spark, d):
    f = estimators.fit(panel_a(spark, d), "y ~ L(y,1) + x", "mg", csa=None)
    return rounded(resample.impulse_response(f, "x", 10, 0).select("horizon", "response"))


@query
def irf_bands(spark, d):
    f = estimators.fit(panel_a(spark, d), "y ~ L(y,1) + x", "mg", csa=None)
    return rounded(resample.impulse_response(f, "x"))


@query
def boot_cs(spark, d):
    return rounded(resample.bootstrap(_mg(spark, d)))


@query
def boot_ccep(spark, d):
    return rounded(resample.bootstrap(estimators.fit(panel_a(spark, d), "y ~ x", "ccep", constant=False)))


@query
def boot_jackknife(spark, d):
    return rounded(resample.bootstrap(estimators.fit(panel_a(spark, d), "y ~ x", "cce", correction="jackknife")))


@query
def boot_wild(spark, d):
    return rounded(resample.bootstrap(_mg(spark, d), "wild"))


@query
def information_criteria(spark, d):
    p = panel_a(spark, d)
    f = estimators.fit(p, "y ~ x", "cce")
    r = select.information_criteria(f, f)
    return one_row(spark, {k: r[k] for k in ("ic1", "ic2", "pc1", "pc2", "m")}, "ic1 double, ic2 double, pc1 double, pc2 double, m long")


@query
def rank_condition(spark, d):
    r = select.rank_condition(estimators.fit(panel_a(spark, d), "y ~ x", "cce"))
    return spark.createDataFrame([(r["m"], r["g"], r["rc"])], "m long, g long, rc long")


@query
def recommended_model(spark, d):
    r = workflow.workflow(panel_a(spark, d), "y ~ x")
    return spark.createDataFrame([(r["recommended"], r["lags"], r["call"])], "model string, lags long, call string")


@query
def partialled_out(spark, d):
    p = panel_a(spark, d)
    return rounded(partial_out(p.df, ["unit"], ["y"], ["x", "z"]).select("unit", "t", "y"))


@query
def averages_rank(spark, d):
    r, k = select.averages_rank(estimators.fit(panel_a(spark, d), "y ~ x", "cce", csa_lags=1))
    return spark.createDataFrame([(r, k)], "rank long, n_columns long")


@query
def simulated_dynamic_cce(spark, d):
    """Recovery on a simulated design; it reads no table."""
    return _coef(estimators.fit(simulate(spark), "y ~ L(y,1) + x", "dynamic_cce", csa_lags=3))
