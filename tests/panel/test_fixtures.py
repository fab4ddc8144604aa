"""Hand-computed cases of transforms, formulas and small formulas."""

import math

import numpy as np
import pytest

from panelwright.functions.tails import bracket_p, chi2_sf, normal_cdf, two_sided
from panelwright.operators import transforms as tr
from panelwright.operators.breaks import sup_wald_cv, sup_wald_p
from panelwright.operators.ols import delta_method, partial_out, pooled_inverse_variance, solve_arrays, spread_around
from panelwright.operators.select import eigenvalue_ratio, growth_ratio
from panelwright.plans.formula import classify, parse
from panelwright.sources.panel import Panel, from_matrix, read


def panel(spark, rows, schema="unit long, t long, y double"):
    return Panel.of(spark.createDataFrame(rows, schema), "unit", "t")


def column(p, name):
    return [r[0] for r in p.df.orderBy("unit", "t").select(name).collect()]


def balanced(spark, n, t):
    return panel(spark, [(i, s, float((i - 1) * t + s)) for i in range(1, n + 1) for s in range(1, t + 1)])


def test_csa_means(spark):
    assert column(tr.csa_global(balanced(spark, 3, 4), ["y"]), "csa_y")[:4] == [5, 6, 7, 8]


def test_csa_lags_on_the_grid(spark):
    ys = [2, 4, 6, 8, 10, 8, 6, 4, 2, 0]
    p = tr.csa_global(panel(spark, [(i // 5 + 1, i % 5 + 1, float(y)) for i, y in enumerate(ys)]), ["y"], 2)
    assert column(p, "csa_y")[:5] == [5] * 5
    assert column(p, "csa_y_L1")[:5] == [None, 5, 5, 5, 5]
    assert column(p, "csa_y_L2")[:5] == [None, None, 5, 5, 5]


def test_csa_unbalanced(spark):
    rows = [(1, 1, 10.0), (1, 2, 20.0), (1, 3, 30.0), (2, 2, 40.0), (2, 3, 50.0)]
    assert column(tr.csa_global(panel(spark, rows), ["y"]), "csa_y")[:3] == [10, 30, 40]


def test_csa_lags_by_variable():
    assert tr.csa_names(["x", "y"], {"x": 1, "y": 2}) == ["csa_x", "csa_y", "csa_x_L1", "csa_y_L1", "csa_y_L2"]


def test_csa_from_a_wider_sample(spark):
    full = panel(spark, [(1, 1, 10.0), (2, 1, 40.0), (3, 1, 70.0)])
    part = full.with_df(full.df.filter("unit < 3"))
    assert column(tr.csa_wider(part, full, ["y"]), "csa_y") == [40, 40]


def test_csa_clusters(spark):
    rows = [(u, t, float(y), "A" if u < 3 else "B") for u, ys in enumerate([(1, 2, 3), (4, 5, 6), (10, 20, 30), (40, 50, 60)], 1) for t, y in enumerate(ys, 1)]
    p = tr.csa_cluster(panel(spark, rows, "unit long, t long, y double, g string"), ["y"], "g")
    got = {(r.unit, r.t): r.csa_y for r in p.df.collect()}
    assert got[1, 1] == 2.5 and got[3, 1] == 25


def test_lags_and_differences(spark):
    p = balanced(spark, 3, 4)
    assert column(tr.lag(p, ["y"], 1), "y__l1") == [None, 1, 2, 3, None, 5, 6, 7, None, 9, 10, 11]
    assert column(tr.lag(p, ["y"], 2), "y__l2")[:4] == [None, None, 1, 2]
    assert column(tr.lag(p, ["y"], -1), "y__lm1")[:4] == [2, 3, 4, None]
    assert column(tr.lag(p, ["y"], 0), "y__l0")[:2] == [1, 2]
    q = panel(spark, [(i // 4 + 1, i % 4 + 1, float(y)) for i, y in enumerate([1, 3, 6, 10, 5, 7, 12, 20])])
    assert column(tr.diff(q, ["y"]), "y__d1") == [None, 2, 3, 4, None, 2, 5, 8]


def test_lag_goes_by_row_over_gaps(spark):
    rows = [(1, 1, 10.0), (1, 2, 20.0), (1, 3, 30.0), (2, 2, 50.0), (2, 5, 60.0)]
    assert column(tr.lag(panel(spark, rows), ["y"], 1), "y__l1") == [None, 10, 20, None, 50]


def test_lag_range(spark):
    p = tr.lag_range(balanced(spark, 1, 5), "y", 0, 2)
    assert [column(p, f"y__l{k}")[2] for k in range(3)] == [3, 2, 1]
    with pytest.raises(ValueError):
        tr.lag_range(p, "y", 2, 1)


def test_index_errors(spark):
    with pytest.raises(ValueError, match="Duplicate"):
        panel(spark, [(1, 1, 1.0), (1, 1, 2.0)])
    with pytest.raises(ValueError, match="not found"):
        Panel.of(spark.createDataFrame([(1, 1)], "a long, t long"), "unit", "t")
    with pytest.raises(ValueError, match="Null"):
        panel(spark, [(None, 1, 1.0)])


def test_balance(spark):
    b = balanced(spark, 3, 4).balance().first()
    assert (b.n_units, b.t_min, b.t_max, b.balanced) == (3, 4, 4, True)
    p = balanced(spark, 3, 4)
    b = p.with_df(p.df.filter("y not in (4, 8)")).balance().first()
    assert (b.t_min, b.t_max, b.balanced) == (3, 4, False)


def test_nan_is_missing(spark):
    p = panel(spark, [(1, 1, float("nan")), (1, 2, 3.0), (2, 1, 5.0), (2, 2, 7.0)])
    assert column(tr.csa_global(p, ["y"]), "csa_y")[:2] == [5, 5]


def test_spatial_weights(spark):
    e = spark.createDataFrame([(1, 2, 2.0), (1, 3, 2.0), (2, 1, 1.0), (3, 1, 1.0), (1, 1, 9.0)], "unit_i long, unit_j long, w double")
    w = {(r.unit_i, r.unit_j): r.w for r in tr.spatial_weights(e).collect()}
    assert w == {(1, 2): 0.5, (1, 3): 0.5, (2, 1): 1.0, (3, 1): 1.0}
    with pytest.raises(ValueError, match="same units"):
        tr.spatial_weights(e, spark.createDataFrame([(1,), (2,), (3,), (4,)], "u long"))
    p = tr.csa_spatial(panel(spark, [(1, 1, 1.0), (2, 1, 4.0), (1, 2, 2.0)]), ["y"], tr.spatial_weights(e))
    assert column(p, "csa_y") == [2.0, 0.0, 1.0]  # a missing neighbour counts as 0


def test_two_way_absorption(spark):
    rows = [(i, t, float(10 * i + 3 * t + (i * t) % 3)) for i in range(6) for t in range(12) if (i, t) != (2, 3)]
    p = tr.absorb(panel(spark, rows), ["y"], ["unit", "t"])
    for g in ("unit", "t"):
        assert all(abs(r[0]) < 1e-8 for r in p.df.groupBy(g).agg({"y": "avg"}).select("avg(y)").collect())
    with pytest.raises(ValueError, match="not found"):
        tr.absorb(p, ["y"], ["nothing"])


def test_formula():
    s = parse("y ~ L(y,1) + L(y,2) + x + L(x,1) + z + L(z,1)")
    lags, groups = classify(s)
    assert [t.k for t in lags] == [1, 2] and [t.label for t in groups["x"]] == ["x", "L(x,1)"] and list(groups) == ["x", "z"]
    assert [t.label for t in parse("d(y) ~ Lrange(x, 0, 2) + D(z, 2)").xs] == ["x", "L(x,1)", "L(x,2)", "D(z,2)"]
    assert parse("y ~ x", "~ L(x, 1)").csa_variables == ["x"]
    for bad in ("y", "y ~ log(x)", "y ~ x:z", "y ~ Lrange(x,2,1)"):
        with pytest.raises(ValueError):
            parse(bad)


def test_pooling():
    # Long-run 1 and 2 with variances 1 and 4.
    b, v = pooled_inverse_variance(np.array([[1 + 1 / 4]]), np.array([1 + 2 / 4]))
    assert b[0] == pytest.approx(1.2) and v[0, 0] == pytest.approx(0.8)


def test_long_run_delta_method():
    # phi = .5, beta = .2 and .1, V = .01 I: a long-run coefficient of .6 and an adjustment of -.5.
    d = 0.5
    assert 0.3 / d == pytest.approx(0.6)
    var = 0.01 * (2 / d**2 + 0.3**2 / d**4)
    eps = 1e-6
    g = lambda x: (x[1] + x[2]) / (1 - x[0])
    x = np.array([0.5, 0.2, 0.1])
    jac = np.array([(g(x + eps * e) - g(x - eps * e)) / (2 * eps) for e in np.eye(3)])
    assert jac @ jac * 0.01 == pytest.approx(var, rel=1e-6)


def test_factor_numbers():
    v = [100, 80, 2, 1.5, 1, 0.8, 0.5, 0.3]
    assert eigenvalue_ratio(v, 4) == 2 and 1 <= growth_ratio(v, 4) <= 3


def test_break_values():
    cv = sup_wald_cv(3, 0.15)
    assert cv == (9.44, 10.86, 15.04)
    assert sup_wald_p(7.2046, cv) == 0.5
    triple = (9.44, 11.36, 15.04)
    assert sup_wald_p(5, triple) == 0.5 and 0.05 < sup_wald_p(10, triple) < 0.10 and sup_wald_p(20, triple) == 0.01
    assert sup_wald_cv(25, 0.15) == sup_wald_cv(10, 0.15)


def test_tails():
    assert normal_cdf(-1.959963984540054) == pytest.approx(0.025, abs=1e-12)
    assert two_sided(0) == 1
    for x, df, p in ((3.841458820694124, 1, 0.05), (18.307038053275146, 10, 0.05), (1074.6794, 1000, 0.05)):
        assert chi2_sf(x, df) == pytest.approx(p, rel=1e-5)
    assert bracket_p(-3, -2.5, -2.27, -2.15) == 0.01 and bracket_p(-2, -2.5, -2.27, -2.15) == 0.5
    assert bracket_p(-2.27, -2.5, -2.27, -2.15) == pytest.approx(0.05)


def test_singular_systems():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(30, 2))
    x = np.column_stack([x, x[:, 0]])
    y = x[:, 0] + rng.normal(size=30)
    a = np.column_stack([y, x])
    c = np.cov(a.T, bias=True)[np.triu_indices(4)]
    got = solve_arrays(np.array([30.0]), a.mean(0)[None], c[None])
    assert not got["rank_ok"][0] and np.isfinite(got["b"]).all()
    fitted = got["b"][0, 0] + x @ got["b"][0, 1:]
    z = np.column_stack([np.ones(30), x[:, :2]])
    assert np.allclose(fitted, z @ np.linalg.lstsq(z, y, rcond=None)[0], atol=1e-6)
    assert math.isnan(solve_arrays(np.array([2.0]), np.zeros((1, 2)), np.ones((1, 3)))["sigma2"][0])


def test_delta_method_of_a_ratio():
    value, var = delta_method(lambda b: b[0] / b[1], [3, 2], [[0.1, 0.01], [0.01, 0.05]])
    assert value[0] == pytest.approx(1.5) and var[0, 0] == pytest.approx(0.045625)


def test_spreads():
    assert spread_around([[1.0], [2.0], [3.0]], [2.0])[0, 0] == pytest.approx(2 / 9)
    b = np.array([[1, 2], [3, 4], [5, 6]], float)
    assert np.allclose(spread_around(b, b.mean(0)), 8 / 9)


def test_partial_out(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(40, 3))
    df = spark.createDataFrame([(i // 20, *map(float, r)) for i, r in enumerate(a)], "unit long, y double, x double, z double")
    got = np.array([r[0] for r in partial_out(df, ["unit"], ["y"], ["x", "z"]).orderBy("unit", "x").select("y").collect()])
    want = []
    for u in (a[:20], a[20:]):
        u = u[np.argsort(u[:, 1])]
        z = np.column_stack([np.ones(20), u[:, 1:]])
        want += list(u[:, 0] - z @ np.linalg.lstsq(z, u[:, 0], rcond=None)[0])
    assert np.allclose(got, want)


def test_matrices(spark):
    p = from_matrix(spark, [[1.0, float("nan"), 3.0], [4.0, 5.0, float("nan")]])
    assert {r.unit: r.row for r in p.matrix("y").collect()} == {0: [1, None, 3], 1: [4, 5, None]}
    assert {r.unit: r.row for r in p.matrix("y", "left").collect()} == {0: [1, 3], 1: [4, 5]}


def test_read(spark, tmp_path):
    balanced(spark, 2, 3).df.write.csv(str(tmp_path / "p"), header=True)
    p = read(spark, str(tmp_path / "p"), "unit", "t", "csv", header=True, inferSchema=True)
    assert p.balance().first().n_units == 2
