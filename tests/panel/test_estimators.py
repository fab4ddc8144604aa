"""Fits against numpy on simulated designs, recovery, invariance and errors."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.operators import breaks, coint, depend, estimators, granger, homogeneity, resample, rolling, select, unitroot, workflow
from panelwright.operators.fit import CONST
from panelwright.sources.panel import Panel, simulate


@pytest.fixture(scope="module")
def sim(spark):
    p = simulate(spark, 15, 30, seed=3)
    pdf = p.df.toPandas().sort_values(["unit", "time"]).reset_index(drop=True)
    return Panel.of(spark.createDataFrame(pdf), "unit", "time"), pdf


def numpy_cce(pdf, lags=0):
    m = pdf.groupby("time")[["y", "x"]].mean()
    cols = [m.rename(columns={c: f"{c}0" for c in m})]
    cols += [m.shift(k).rename(columns={c: f"{c}{k}" for c in m}) for k in range(1, lags + 1)]
    wide = pdf.join(pd.concat(cols, axis=1), on="time")
    out = {}
    for u, g in wide.groupby("unit"):
        g = g.sort_values("time")
        g = g.assign(yl=g.y.shift(1)).dropna()
        X = np.column_stack([np.ones(len(g)), g.yl, g.x, *[g[c] for c in wide.columns if c not in ("unit", "time", "y", "x")]])
        out[u] = np.linalg.lstsq(X, g.y.to_numpy(), rcond=None)[0][:3]
    return np.array([out[u] for u in sorted(out)])


@pytest.mark.parametrize("lags", [0, 2])
def test_dynamic_cce_equals_numpy(sim, lags):
    p, pdf = sim
    f = estimators.fit(p, "y ~ L(y,1) + x", "dynamic_cce", csa_lags=lags)
    b = numpy_cce(pdf, lags)
    assert np.allclose(f.estimate, b.mean(0), atol=1e-8)
    assert np.allclose(f.variance, np.cov(b.T, bias=True) / len(b), atol=1e-8)


def test_row_order_labels_and_scale_do_not_matter(spark, sim):
    _, pdf = sim
    moved = pdf.sample(frac=1, random_state=1).assign(unit=lambda d: 1000 - d.unit, x=lambda d: 10 * d.x)
    a = estimators.fit(sim[0], "y ~ x", "cce")
    b = estimators.fit(Panel.of(spark.createDataFrame(moved), "unit", "time"), "y ~ x", "cce")
    assert a["x"] == pytest.approx(10 * b["x"], rel=1e-8)


def test_recovery(spark):
    f = estimators.fit(simulate(spark), "y ~ L(y,1) + x", "dynamic_cce", csa_lags=3)
    assert abs(f["L(y,1)"] - 0.5) < 0.15 and abs(f["x"] - 1.0) < 0.15


def test_interactive_effects_recover(spark):
    rng = np.random.default_rng(5)
    n, t = 20, 30
    fac, load = rng.normal(size=t), rng.normal(1, 0.5, n)
    x = rng.normal(size=(n, t)) + 0.5 * load[:, None] * fac
    y = 0.6 * x + load[:, None] * fac + 0.3 * rng.normal(size=(n, t))
    rows = [(i, s, float(y[i, s]), float(x[i, s])) for i in range(n) for s in range(t)]
    p = Panel.of(spark.createDataFrame(rows, "unit long, time long, y double, x double"), "unit", "time")
    f = estimators.fit(p, "y ~ x", "ife", n_factors=1)
    assert abs(f["x"] - 0.6) < 0.05
    with pytest.raises(ValueError):
        homogeneity.swamy_test(f)


@pytest.mark.parametrize("model", ["rcce", "ccep", "amg", "csdl"])
def test_static_models_run(sim, model):
    f = estimators.fit(sim[0], "y ~ x", model)
    assert np.isfinite(f.estimate).all() and (np.diag(f.variance) > 0).all()


def test_pooled_differs_from_mean_group(sim):
    assert abs(estimators.fit(sim[0], "y ~ x", "ccep")["x"] - estimators.fit(sim[0], "y ~ x", "cce")["x"]) > 1e-6


def test_long_run(sim):
    f = estimators.fit(sim[0], "y ~ L(y,1) + x + L(x,1)", "pmg")
    kinds = {r[7]: r for r in f.coef_rows}
    assert kinds["adjustment"][1] < 0 and {"lr", "lr_pooled"} <= set(kinds)
    units, _ = estimators.long_run_units(f)
    r = units.toPandas()
    w = 1 / r.lr_var_0
    assert kinds["lr_pooled"][1] == pytest.approx((w * r.lr_0).sum() / w.sum())


def test_short_units_are_dropped(spark, sim):
    _, pdf = sim
    short = pd.concat([pdf, pdf[(pdf.unit == 1) & (pdf.time <= 2)].assign(unit=99)])
    f = estimators.fit(Panel.of(spark.createDataFrame(short), "unit", "time"), "y ~ x", "mg", csa=None)
    assert f.n_dropped() == 1
    assert [r.unit for r in f.unit_stats().filter("dropped").collect()] == [99]


def test_tables(sim):
    f = estimators.fit(sim[0], "y ~ x", "cce")
    g = f.glance().first()
    assert g.nobs == 450 and g.n_units == 15 and 0 < g.r_squared < 1
    e = f.resid().toPandas()
    assert len(e) == 450 and abs(e.groupby("unit").resid.sum()).max() < 1e-8
    assert f.fitted().count() == 450
    lo, hi = f.confint(0.9, ["x"]).select("conf_low", "conf_high").first()
    assert lo < f["x"] < hi
    assert f.predict().count() == 450 and f.predict(kind="mg").count() == 450
    assert f.update(trend=True).terms == [CONST, "x", "(trend)"]
    assert f.unit_coef().count() == 30 and f.vcov().count() == 4
    assert f.histogram("x", 5).agg(F.sum("n")).first()[0] == 15
    assert "cce fit" in repr(f)


def test_corrections(sim):
    base = estimators.fit(sim[0], "y ~ x", "cce")
    for c in ("jackknife", "half_panel"):
        f = estimators.fit(sim[0], "y ~ x", "cce", correction=c)
        assert abs(f["x"] - base["x"]) > 1e-9 and np.allclose(f.variance, base.variance)
    with pytest.raises(ValueError, match="not implemented"):
        estimators.fit(sim[0], "y ~ x", "cce", correction="recursive")


def test_absorbing_periods_drops_dead_averages(sim):
    f = estimators.fit(sim[0], "y ~ x", "cce", absorb="~ time")
    assert f.csa == [] and np.isfinite(f["x"])


def test_dependence(spark, sim):
    p = sim[0]
    got = {r.test: r.statistic for r in depend.cd_tests(p.df, "unit", "time", "y", list(depend.TESTS), reps=20).collect()}
    wide = sim[1].pivot(index="unit", columns="time", values="y").to_numpy()
    rho = np.corrcoef(wide)[np.triu_indices(15, 1)]
    cd = np.sqrt(2 / (15 * 14)) * np.sqrt(30) * rho.sum()
    assert got["pesaran"] == pytest.approx(cd) and got["pea"] >= got["pesaran"]
    values = np.linalg.svd(wide)[1] ** 2
    theta = min(values[0] / values.sum(), 0.99)
    assert got["cdstar"] == pytest.approx((cd + np.sqrt(15) * theta) / (1 - theta))
    with pytest.raises(ValueError):
        depend.cd_tests(p.df, "unit", "time", "y", ["nothing"])
    flat = spark.createDataFrame([(u, t, 1.0 if u == 1 else float(u * t % 5)) for u in range(1, 5) for t in range(10)], "unit long, time long, y double")
    assert np.isfinite(depend.cd_tests(flat, "unit", "time", "y", ["pesaran"]).first().statistic)


def test_exponents(spark):
    rng = np.random.default_rng(2)
    f = rng.normal(size=60)
    e = rng.normal(1, 0.3, 25)[:, None] * f + 0.5 * rng.normal(size=(25, 60))
    df = spark.createDataFrame([(i, t, float(e[i, t])) for i in range(25) for t in range(60)], "unit long, time long, y double")
    assert depend.exponent_variable(df, "unit", "time", "y")["alpha"] > 0.7
    r = depend.exponent_residual(df, "unit", "time", "y", reps=20)
    assert r["alpha"] > 0.7 and r["se"] > 0


def series(spark, a):
    return Panel.of(spark.createDataFrame([(i, t, float(a[i, t])) for i in range(a.shape[0]) for t in range(a.shape[1])], "unit long, time long, y double"), "unit", "time")


def test_unit_roots(spark):
    rng = np.random.default_rng(4)
    walk, noise = rng.normal(size=(20, 40)).cumsum(axis=1), rng.normal(size=(25, 60))
    assert unitroot.cips_test(series(spark, walk), "y")["p_value"] > 0.05
    assert unitroot.cips_test(series(spark, noise), "y")["p_value"] <= 0.01
    assert unitroot.unit_root_test(series(spark, noise), "y")["p_value"] < 0.01
    assert unitroot.unit_root_test(series(spark, noise), "y", "llc", 1, True)["p_value"] < 0.01
    with pytest.raises(ValueError):
        unitroot.cips_test(series(spark, noise[:, :2]), "y")


def test_grid_lags_leave_holes(spark):
    rng = np.random.default_rng(6)
    a = rng.normal(size=(6, 25))
    p = series(spark, a)
    holed = p.with_df(p.df.filter("not (unit = 0 and time = 10)"))
    n = unitroot.cips_units(holed, "y").count()
    assert n == 6


def test_cointegration(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(12, 60)).cumsum(axis=1)
    y = 0.8 * x + rng.normal(size=x.shape)
    rows = [(i, t, float(y[i, t]), float(x[i, t])) for i in range(12) for t in range(60)]
    p = Panel.of(spark.createDataFrame(rows, "unit long, time long, y double, x double"), "unit", "time")
    got = {r.test: r for r in coint.cointegration_test(p, "y ~ x").collect()}
    assert list(got) == ["Gt", "Ga", "Pt", "Pa"] and got["Gt"].p_value <= 0.01
    assert coint.cointegration_test(p, "y ~ x", bootstrap=30).count() == 4
    assert coint.residual_cointegration_test(p, "y ~ x").first().p_value < 0.01
    assert coint.residual_cointegration_test(p, "y ~ x", "kao").first().p_value < 0.01


def test_causality(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(25, 40))
    y = np.zeros_like(x)
    for t in range(1, 40):
        y[:, t] = 0.3 * y[:, t - 1] + 0.8 * x[:, t - 1] + 0.5 * rng.normal(size=25)
    rows = [(i, t, float(y[i, t]), float(x[i, t]), float(z)) for i in range(25) for t, z in zip(range(40), rng.normal(size=40), strict=True)]
    p = Panel.of(spark.createDataFrame(rows, "unit long, time long, y double, x double, z double"), "unit", "time")
    assert granger.granger_test(p, "y", "x")["p_z"] < 0.01
    assert granger.granger_test(p, "y", "z")["p_z"] > 0.01
    two = granger.granger_test(p, "y", "z", 2)
    assert two["w_bar"] == pytest.approx(2 * granger.granger_test(p, "y", "z", 2, compat=True)["w_bar"])


def test_homogeneity(sim):
    f = estimators.fit(sim[0], "y ~ x", "mg", csa=None)
    s, h = homogeneity.swamy_test(f), homogeneity.hausman_test(f)
    assert s["p_value"] < 0.05 and s["df"] == 14 and 0 <= h["p_value"] <= 1


def test_regimes_equal_refits(sim):
    p, _ = sim
    got = rolling.rolling(p, "y ~ L(y,1) + x", 20, 5, model="dynamic_cce", csa_lags=1).filter("window_start = 6 and term = 'x'").first()
    part = p.with_df(p.df.filter("time between 6 and 25"))
    f = estimators.fit(part, "y ~ L(y,1) + x", "dynamic_cce", csa_lags=1)
    assert got.estimate == pytest.approx(f["x"]) and got.std_error == pytest.approx(np.sqrt(f.variance[2, 2]))
    for kw in ({"window": 1}, {"step": 0}, {"window": 31}):
        with pytest.raises(ValueError):
            rolling.rolling(p, "y ~ x", **{"window": 20, **kw})


def test_breaks(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(20, 40))
    y = np.where(np.arange(40) < 20, 0.5, 2.0) * x + 0.3 * rng.normal(size=x.shape)
    rows = [(i, t + 1, float(y[i, t]), float(x[i, t])) for i in range(20) for t in range(40)]
    p = Panel.of(spark.createDataFrame(rows, "unit long, time long, y double, x double"), "unit", "time")
    r = breaks.break_test(p, "y ~ x", model="mg", csa=None)
    assert abs(r["break_date"] - 20) <= 2 and r["p_value"] == 0.01
    assert breaks.break_test(p, "y ~ x", 20, model="mg", csa=None)["p_value"] < 0.01
    assert len(breaks.break_test(p, "y ~ x", model="mg", csa=None, n_breaks=2)["break_dates"]) == 2
    with pytest.raises(ValueError):
        breaks.break_test(p, "y ~ x", trim=0.5)


def test_resampling(sim):
    f = estimators.fit(sim[0], "y ~ L(y,1) + x", "mg", csa=None)
    se = np.sqrt(np.diag(f.variance))
    for kind, share in (("cross_section", (0.6, 1.6)), ("wild", (0.05, 3.0))):
        got = resample.bootstrap(f, kind, reps=60).toPandas().std_error.to_numpy()
        assert ((got > share[0] * se) & (got < share[1] * se)).all(), (kind, got / se)
    r = resample.impulse_response(f, "x", 4, 30).orderBy("horizon").toPandas()
    assert r.response[0] == pytest.approx(f["x"]) and r.response[1] == pytest.approx(f["x"] * f["L(y,1)"])
    assert (r.low <= r.high).all()
    with pytest.raises(ValueError):
        resample.impulse_response(estimators.fit(sim[0], "y ~ x", "mg", csa=None), "x")


def test_workflow(sim):
    r = workflow.workflow(sim[0], "y ~ x", 1)
    assert r["recommended"] in estimators.MODELS and r["call"].startswith("fit(")


def test_model_errors(sim):
    for kw in ({"model": "nothing"}, {"formula": "y ~ nothing"}):
        with pytest.raises(ValueError):
            estimators.fit(sim[0], **{"formula": "y ~ x", **kw})


def test_streaming_gram(spark, sim, tmp_path):
    from panelwright.operators.ols import gram
    from panelwright.streaming import streaming_gram

    sim[0].df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(sim[0].df.schema).parquet(str(tmp_path / "in"))
    q = streaming_gram(stream, ["unit"], "y", ["x"]).writeStream.outputMode("complete").format("memory").queryName("grams").start()
    q.processAllAvailable()
    q.stop()
    a = {r.unit: r for r in spark.table("grams").collect()}
    for r in gram(sim[0].df, ["unit"], "y", ["x"]).collect():
        assert a[r.unit].n == r.n and np.allclose(a[r.unit].c, r.c)


def test_rank_of_averages(sim):
    p = sim[0].with_columns({"x2": 2 * F.col("x")})
    assert select.averages_rank(estimators.fit(p, "y ~ x", "cce")) == (2, 2)
    assert select.averages_rank(estimators.fit(p, "y ~ x", "cce", csa="~ y + x + x2")) == (2, 3)
    assert select.rank_condition(estimators.fit(p, "y ~ x", "mg", csa=None)) == {"m": 0, "g": 0, "rc": 1}


@pytest.mark.parametrize("kind", ["cluster", "spatial"])
def test_other_averages(spark, sim, kind):
    p = sim[0].with_columns({"g": F.col("unit") % 3})
    if kind == "cluster":
        f = estimators.fit(p, "y ~ x", "cce", csa_from="cluster", by="g")
    else:
        u = p.df.select("unit").distinct()
        edges = u.toDF("unit_i").crossJoin(u.toDF("unit_j")).filter("unit_i <> unit_j").withColumn("w", F.lit(1.0))
        f = estimators.fit(p, "y ~ x", "cce", csa_from="spatial", weights=edges)
    assert np.isfinite(f["x"]) and f.summary_row()["n_units"] == 15
