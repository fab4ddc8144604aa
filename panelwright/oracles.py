"""DuckDB statements for the panel queries.

Regressions are solved by Gram-Schmidt orthogonalisation with window sums, which
shares nothing with the covariance aggregates of the operators.
"""

from __future__ import annotations

from .functions.draws import hashed_sql, sign_sql

_ORDERS = """SELECT c_nationkey AS unit, CAST({t} AS BIGINT) AS t, avg(ln(o_totalprice)) AS y, avg(c_acctbal) / 1000 AS x, ln(count(*)) AS z
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"""
A = _ORDERS.format(t="year(o_orderdate) * 4 + quarter(o_orderdate)")
B = _ORDERS.format(t="year(o_orderdate) * 12 + month(o_orderdate)")
C = """SELECT l_suppkey AS unit, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS BIGINT) AS t, avg(ln(l_extendedprice)) AS y,
avg(l_quantity) / 10 AS x, avg(l_discount) * 10 AS z FROM lineitem GROUP BY 1, 2"""
D = """SELECT user_id AS unit, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS t, avg(ln(1 + value)) AS y,
CAST(count(*) AS DOUBLE) AS x FROM events GROUP BY 1, 2"""
E = """SELECT o_custkey AS unit, CAST(year(o_orderdate) * 4 + quarter(o_orderdate) AS BIGINT) AS t, avg(ln(o_totalprice)) AS y FROM orders GROUP BY 1, 2"""
W = "(PARTITION BY unit ORDER BY t)"


def ols(name: str, source: str, y: str, xs: list[str], keys: str = "unit", intercept: bool = True, spare: int = 0) -> str:
    """CTEs that end in one called name: keys, n, b_j, s_i_j (covariances), ssr, s2, tss; b_0 is the intercept."""
    k = len(xs)
    where = " AND ".join(f"{c} IS NOT NULL" for c in [y, *xs])
    w = f"OVER (PARTITION BY {keys})"
    centre = lambda c: f"({c}) - avg({c}) {w}" if intercept else f"({c})"
    out = [
        f"{name}_0 AS (SELECT {keys}, count(*) {w} AS n, avg({y}) {w} AS ybar, ({y}) - avg({y}) {w} AS ycen, "
        + ", ".join([f"avg({x}) {w} AS xbar{j}" for j, x in enumerate(xs, 1)] + [f"{centre(x)} AS q{j}" for j, x in enumerate(xs, 1)])
        + f", {centre(y)} AS yq FROM ({source}) WHERE {where})"
    ]
    keep = [*keys.split(", "), "n", "ybar", "ycen", *[f"xbar{j}" for j in range(1, k + 1)]]
    for j in range(1, k + 1):
        ratio = lambda c: f"sum({c} * q{j}) {w} / nullif(sum(q{j} * q{j}) {w}, 0)"  # noqa: E731, B023
        cols = [f"sum(q{j} * q{j}) {w} AS d{j}", f"{ratio('yq')} AS g{j}", f"yq - q{j} * ({ratio('yq')}) AS yq"]
        for m in range(j + 1, k + 1):
            cols += [f"{ratio(f'q{m}')} AS r{j}_{m}", f"q{m} - q{j} * ({ratio(f'q{m}')}) AS q{m}"]
        out.append(f"{name}_{j} AS (SELECT {', '.join(keep)}, {', '.join(cols)} FROM {name}_{j - 1})")
        keep += [f"d{j}", f"g{j}", *[f"r{j}_{m}" for m in range(j + 1, k + 1)]]
    more = [c for c in keep if c not in keys.split(", ") and c != "ycen"]
    total = k + intercept
    out.append(
        f"{name}_f AS (SELECT {keys}, " + ", ".join(f"max({c}) AS {c}" for c in more) + f", sum(yq * yq) AS ssr, sum(ycen * ycen) AS tss FROM {name}_{k} GROUP BY {keys} HAVING max(n) > {total + spare})"
    )
    cols = []
    for j in range(k, 0, -1):
        cols.append(f"g{j}" + "".join(f" - r{j}_{m} * b_{m}" for m in range(j + 1, k + 1)) + f" AS b_{j}")
        for m in range(j + 1, k + 1):
            cols.append("-(" + " + ".join(f"r{j}_{i} * {f'u{i}_{m}' if i != m else '1.0'}" for i in range(j + 1, m + 1)) + f") AS u{j}_{m}")
    cols.append(f"ssr / (n - {total}) AS s2")
    u = lambda i, m: "1.0" if i == m else f"u{i}_{m}"
    for i in range(1, k + 1):
        for j in range(i, k + 1):
            cols.append("s2 * (" + " + ".join(f"{u(i, m)} * {u(j, m)} / d{m}" for m in range(j, k + 1)) + f") AS s_{i}_{j}")
    if intercept:
        cols.append("ybar" + "".join(f" - b_{j} * xbar{j}" for j in range(1, k + 1)) + " AS b_0")
        pairs = [f"s_{min(i, j)}_{max(i, j)} * xbar{i} * xbar{j}" for i in range(1, k + 1) for j in range(1, k + 1)]
        cols.append("s2 / n" + "".join(f" + {p}" for p in pairs) + " AS s_0_0")
    out.append(f"{name} AS (SELECT *, {', '.join(cols)} FROM {name}_f)")
    return ",\n".join(out)


def coef(name: str, terms: dict[str, str], kind: str = "mg") -> str:
    """Mean-group rows from unit coefficients."""
    rows = [
        f"SELECT '{t}' AS term, round(avg({c}), 6) AS estimate, round(sqrt(var_pop({c}) / count(*)), 6) AS std_error, '{kind}' AS type FROM {name}"
        for t, c in terms.items()
    ]
    return " UNION ALL ".join(rows)


def _lags(source: str, spec: str) -> str:
    return f"SELECT *, {spec} FROM ({source}) WINDOW w AS {W}"


def _csa(source: str, cols: list[str], lags: int = 0) -> str:
    """source with averages by period, lagged on the grid of periods."""
    means = ", ".join(f"avg({c}) AS csa_{c}" for c in cols)
    more = "".join(f", lag(csa_{c}, {k}) OVER (ORDER BY t) AS csa_{c}_L{k}" for c in cols for k in range(1, lags + 1))
    return f"SELECT * FROM ({source}) JOIN (SELECT *{more} FROM (SELECT t, {means} FROM ({source}) GROUP BY t)) USING (t)"


A_CSA = _csa(A, ["y", "x"])
A_LAG = _lags(A, "lag(y) OVER w AS ylag, y - lag(y) OVER w AS dy, lag(x) OVER w AS xlag, x - lag(x) OVER w AS dx")
MG = {"(Intercept)": "b_0", "x": "b_1"}

ORACLES: dict[str, str] = {
    "panel_balance": f"""WITH p AS ({B}), s AS (SELECT unit, count(*) AS n FROM p GROUP BY unit)
SELECT CAST(count(*) AS BIGINT) AS n_units, CAST(min(n) AS BIGINT) AS t_min, CAST(max(n) AS BIGINT) AS t_max,
(SELECT CAST(count(DISTINCT t) AS BIGINT) FROM p) AS n_periods, round(avg(n), 6) AS t_bar, min(n) = max(n) AS balanced FROM s""",
    "lag_lead_diff": f"""SELECT unit, t, round(lag(y) OVER w, 6) AS lag1, round(lead(y) OVER w, 6) AS lead1, round(y - lag(y, 2) OVER w, 6) AS diff2
FROM ({D}) WINDOW w AS {W}""",
    "panel_matrix": f"""WITH p AS ({D}) SELECT unit, (SELECT CAST(count(DISTINCT t) AS BIGINT) FROM p) AS n_periods,
CAST(count(y) AS BIGINT) AS n_values, round(sum(y), 6) AS total FROM p GROUP BY unit""",
    "csa_global_lagged": f"""WITH p AS ({B}), m AS (SELECT t, avg(y) AS csa_y, avg(x) AS csa_x FROM p GROUP BY t),
g AS (SELECT *, lag(csa_y) OVER o AS csa_y_L1, lag(csa_y, 2) OVER o AS csa_y_L2, lag(csa_x) OVER o AS csa_x_L1 FROM m WINDOW o AS (ORDER BY t))
SELECT unit, t, round(csa_y, 6) AS csa_y, round(csa_x, 6) AS csa_x, round(csa_y_L1, 6) AS csa_y_L1, round(csa_y_L2, 6) AS csa_y_L2,
round(csa_x_L1, 6) AS csa_x_L1 FROM p JOIN g USING (t)""",
    "csa_cluster": f"""WITH p AS (SELECT a.*, n_regionkey AS region FROM ({A}) a JOIN nation ON unit = n_nationkey),
m AS (SELECT region, t, avg(y) AS csa_y FROM p GROUP BY 1, 2), g AS (SELECT *, lag(csa_y) OVER (PARTITION BY region ORDER BY t) AS l FROM m)
SELECT unit, t, round(csa_y, 6) AS csa_y, round(l, 6) AS csa_y_L1 FROM p JOIN g USING (region, t)""",
    "csa_wider": f"""WITH p AS ({A}), e AS ({E}), g AS (SELECT t, csa_y, lag(csa_y) OVER (ORDER BY t) AS l FROM (SELECT t, avg(y) AS csa_y FROM e GROUP BY t))
SELECT unit, t, round(csa_y, 6) AS csa_y, round(l, 6) AS csa_y_L1 FROM p LEFT JOIN g USING (t)""",
    "csa_spatial": f"""WITH p AS ({A}), e AS (SELECT a.n_nationkey AS i, b.n_nationkey AS j FROM nation a JOIN nation b
ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey), w AS (SELECT i, j, 1.0 / count(*) OVER (PARTITION BY i) AS w FROM e),
s AS (SELECT i, t, sum(w * y) AS v FROM w JOIN p ON j = unit GROUP BY 1, 2),
r AS (SELECT unit, p.t, coalesce(v, 0.0) AS v FROM p LEFT JOIN s ON i = unit AND s.t = p.t)
SELECT unit, t, round(v, 6) AS csa_y, round(lag(v) OVER {W}, 6) AS csa_y_L1 FROM r""",
    "absorb_one_way": f"""SELECT unit, t, round(y - avg(y) OVER (PARTITION BY unit), 6) AS y, round(x - avg(x) OVER (PARTITION BY unit), 6) AS x FROM ({C})""",
    "mg_simple": f"WITH {ols('f', A, 'y', ['x'])} {coef('f', MG)}",
    "mg_trend": f"WITH {ols('f', _lags(A, 'CAST(row_number() OVER w AS DOUBLE) AS trend'), 'y', ['x', 'trend'])} "
    + coef("f", {**MG, "(trend)": "b_2"}),
    "cce_mg": f"WITH {ols('f', A_CSA, 'y', ['x', 'csa_y', 'csa_x'])} {coef('f', MG)}",
    "cce_mg_suppliers": f"WITH {ols('f', _csa(C, ['y', 'x', 'z']), 'y', ['x', 'z', 'csa_y', 'csa_x', 'csa_z'])} "
    + coef("f", {**MG, "z": "b_2"}),
    "dynamic_cce_mg": f"WITH {ols('f', _csa(A_LAG, ['y', 'x'], 1), 'y', ['ylag', 'x', 'csa_y', 'csa_x', 'csa_y_L1', 'csa_x_L1'])} "
    + coef("f", {"(Intercept)": "b_0", "L(y,1)": "b_1", "x": "b_2"}),
    "ccep_pool": f"WITH {ols('f', A_CSA, 'y', ['x', 'csa_y', 'csa_x'], intercept=False)} "
    "SELECT 'x' AS term, round(sum(b_1 / s_1_1) / sum(1 / s_1_1), 6) AS estimate, round(sqrt(1 / sum(1 / s_1_1)), 6) AS std_error, 'mg' AS type FROM f",
    "csdl_long_run": f"WITH {ols('f', _csa(_lags(A_LAG, 'lag(dx) OVER w AS dx1'), ['y', 'x']), 'dy', ['x', 'dx', 'dx1', 'csa_y', 'csa_x'])} "
    + coef("f", {"x": "b_1"}, "lr"),
    "residuals": f"WITH {ols('f', A, 'y', ['x'])} SELECT unit, t, round(b_0 + b_1 * x, 6) AS fitted, round(y - b_0 - b_1 * x, 6) AS resid FROM ({A}) JOIN f USING (unit)",
    "partialled_out": f"WITH {ols('f', A, 'y', ['x', 'z'])} SELECT unit, t, round(y - b_0 - b_1 * x - b_2 * z, 6) AS y FROM ({A}) JOIN f USING (unit)",
    "unit_stats": f"WITH {ols('f', A, 'y', ['x'])} SELECT unit, CAST(n AS BIGINT) AS n, CAST(n - 2 AS BIGINT) AS df_resid, round(s2, 6) AS sigma2, "
    f"round(1 - ssr / tss, 6) AS r2, n IS NULL AS dropped FROM (SELECT DISTINCT unit FROM ({A})) LEFT JOIN f USING (unit)",
    "predict_mg": f"WITH {ols('f', A, 'y', ['x'])}, m AS (SELECT avg(b_0) AS a, avg(b_1) AS b FROM f) SELECT unit, t, round(a + b * x, 6) AS prediction FROM ({A}), m",
    "confint": f"WITH {ols('f', A, 'y', ['x'])}, c AS (SELECT '(Intercept)' AS term, avg(b_0) AS e, sqrt(var_pop(b_0) / count(*)) AS s FROM f "
    "UNION ALL SELECT 'x', avg(b_1), sqrt(var_pop(b_1) / count(*)) FROM f) "
    "SELECT term, round(e - 1.959963984540054 * s, 5) AS conf_low, round(e + 1.959963984540054 * s, 5) AS conf_high FROM c",
}

# Two halves of the periods, or of each unit's rows.
_HALF = (
    "SELECT '{t}' AS term, round(2 * (SELECT avg({c}) FROM f) - 0.5 * ((SELECT avg({c}) FROM h{w1}) + (SELECT avg({c}) FROM h{w2})), 6) AS estimate, 'mg' AS type"
)
_CAL = f"SELECT *, CASE WHEN dense_rank() OVER (ORDER BY t) <= (SELECT count(DISTINCT t) // 2 FROM ({A})) THEN 1 ELSE 2 END AS half FROM ({A_CSA})"
_OWN = (
    "SELECT *, CASE WHEN i <= m // 2 THEN 1 ELSE 2 END AS half FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY t) AS i, "
    f"count(*) OVER (PARTITION BY unit) AS m FROM ({A_CSA})) WHERE m // 2 >= 5 AND m - m // 2 >= 5"
)
for _name, _src in (("jackknife", _CAL), ("half_panel", _OWN)):
    ORACLES[_name] = (
        f"WITH {ols('f', A_CSA, 'y', ['x', 'csa_y', 'csa_x'])}, {ols('h', _src, 'y', ['x', 'csa_y', 'csa_x'], keys='unit, half')} "
        + " UNION ALL ".join(_HALF.format(t=t, c=c, w1=" WHERE half = 1", w2=" WHERE half = 2") for t, c in MG.items())
    )

# Long-run coefficients: b_1 is the lag of y, b_2 is x.
_LR = f"""WITH {ols('f', _csa(A_LAG, ['y', 'x']), 'y', ['ylag', 'x', 'csa_y', 'csa_x'])},
l AS (SELECT b_1 - 1 AS adj, b_2 / (1 - b_1) AS lr, s_2_2 / (1 - b_1) ^ 2 + 2 * s_1_2 * b_2 / (1 - b_1) ^ 3 + s_1_1 * b_2 ^ 2 / (1 - b_1) ^ 4 AS v FROM f) """
ORACLES["csardl_long_run"] = (
    _LR
    + """SELECT 'adjustment' AS term, round(avg(adj), 6) AS estimate, round(sqrt(var_samp(adj) / count(*)), 6) AS std_error, 'adjustment' AS type FROM l
UNION ALL SELECT 'x', round(avg(lr), 6), round(sqrt(var_samp(lr) / count(*)), 6), 'lr' FROM l"""
)
ORACLES["pmg_pool"] = (
    _LR + "SELECT 'x' AS term, round(sum(lr / v) / sum(1 / v), 6) AS estimate, round(sqrt(1 / sum(1 / v)), 6) AS std_error, 'lr_pooled' AS type FROM l WHERE v > 0"
)
_AMG = f"""d AS (SELECT * FROM ({A_LAG}) WHERE dy IS NOT NULL AND dx IS NOT NULL),
w AS (SELECT dy - avg(dy) OVER (PARTITION BY t) AS a, dx - avg(dx) OVER (PARTITION BY t) AS b FROM d),
s AS (SELECT sum(a * b) / sum(b * b) AS s FROM w), e AS (SELECT t, avg(dy) - (SELECT s FROM s) * avg(dx) AS e FROM d GROUP BY t),
c AS (SELECT t, e - first_value(e) OVER (ORDER BY t) AS c FROM e),
p AS (SELECT a.*, sum(coalesce(c, 0)) OVER (PARTITION BY unit ORDER BY a.t) AS cdp FROM ({A}) a LEFT JOIN c ON a.t = c.t)"""
ORACLES["amg"] = f"WITH {_AMG}, {ols('f', 'SELECT * FROM p', 'y', ['x', 'cdp'])} {coef('f', MG)}"
_WITHIN = "SELECT unit, t, y - avg(y) OVER (PARTITION BY unit) AS y, x - avg(x) OVER (PARTITION BY unit) AS x FROM (" + A + ")"
ORACLES["cce_absorbed"] = f"WITH {ols('f', _csa(_WITHIN, ['y', 'x']), 'y', ['x', 'csa_y', 'csa_x'], intercept=False)} {coef('f', {'x': 'b_1'})}"


def _pairs(source: str, value: str = "y") -> str:
    return f"""v AS ({source}), size AS (SELECT count(DISTINCT unit) AS n, count(DISTINCT t) AS t_all FROM v),
pairs AS (SELECT a.unit AS i, b.unit AS j, count(*) AS t, corr(a.{value}, b.{value}) AS rho
FROM v a JOIN v b ON a.t = b.t AND a.unit < b.unit GROUP BY 1, 2 HAVING count(*) >= 3)"""


_CD = "(SELECT sqrt(2.0 / (n * (n - 1))) * (SELECT sum(sqrt(t) * rho) FROM pairs) FROM size)"
ORACLES["cd_pesaran"] = f"WITH {_pairs(A)} SELECT 'pesaran' AS test, round({_CD}, 6) AS statistic"
ORACLES["cd_pea"] = (
    f"WITH {_pairs(A)} SELECT 'pea' AS test, round({_CD} + coalesce((SELECT sum(abs(rho)) FROM pairs, size WHERE abs(rho) > 2 * sqrt(ln(n) / t_all)), 0), 6) AS statistic"
)
_SIGNS = f"draws AS (SELECT unit, r, {sign_sql('unit', 'r')} AS w FROM (SELECT DISTINCT unit FROM v), (SELECT unnest(range(1, 501)) AS r))"
for _name, _term, _scale, _agg in (
    ("cdw", "sqrt(t) * rho", "2.0", "avg(s)"),
    ("cdwplus", "((t - 1) * rho * rho - 1) / sqrt(2.0)", "1.0", "avg(abs(s))"),
):
    ORACLES[f"{_name}_portable"] = (
        f"WITH {_pairs(A)}, {_SIGNS}, s AS (SELECT a.r, sum(a.w * b.w * ({_term})) AS s FROM pairs JOIN draws a ON a.unit = i JOIN draws b ON b.unit = j AND a.r = b.r GROUP BY 1) "
        f"SELECT '{_name}' AS test, round(sqrt({_scale} / (n * (n - 1))) * (SELECT {_agg} FROM s), 6) AS statistic FROM size"
    )
ORACLES["glance"] = (
    f"WITH {ols('f', A, 'y', ['x'])}, {_pairs(f'SELECT unit, t, y - b_0 - b_1 * x AS e FROM ({A}) JOIN f USING (unit)', 'e')} "
    f"SELECT CAST(sum(n) AS BIGINT) AS nobs, CAST(count(*) AS BIGINT) AS n_units, round(avg(n), 6) AS t_bar, round(avg(1 - ssr / tss), 6) AS r_squared, "
    f"round(sqrt(sum(ssr) / sum(n)), 6) AS rmse, round({_CD}, 6) AS cd_statistic FROM f"
)
ORACLES["exponent_variable"] = f"""WITH m AS (SELECT t, avg(y) AS m FROM ({A}) GROUP BY t), s AS (SELECT avg(m) AS mu, var_samp(m) AS v FROM m),
{ols('f', f'SELECT unit, t, y, (m - mu) / sqrt(v) AS zz FROM ({A}) JOIN m USING (t), s', 'y', ['zz'])},
g AS (SELECT coalesce(avg(b_1 ^ 2) FILTER (WHERE abs(b_1 / sqrt(s_1_1)) > 1.959963984540054), 1e-10) AS mu2, sum(s2) AS c, (SELECT count(DISTINCT unit) FROM ({A})) AS n FROM f)
SELECT round(1 + ln(v) / (2 * ln(n)) - ln(mu2) / (2 * ln(n)) - c / (2 * n * ln(n) * v), 6) AS alpha, round(1 / (2 * ln(n) * sqrt(n)), 6) AS se FROM g, s"""
ORACLES["granger_k1"] = f"""WITH {ols('f', A_LAG, 'y', ['ylag', 'xlag'], spare=1)}, {ols('r', A_LAG, 'y', ['ylag'])},
sizes AS (SELECT unit, count(*) AS t FROM ({A}) GROUP BY unit),
u AS (SELECT t, t - 4 AS d, (r.ssr - f.ssr) / (f.ssr / (f.n - 3)) AS w FROM f JOIN r USING (unit) JOIN sizes USING (unit) WHERE t > 4),
g AS (SELECT count(*) AS n, avg(w) AS w, avg(d / (d - 2.0)) FILTER (WHERE d > 4) AS e,
avg(2.0 * d * d * (d - 1) / ((d - 2) ^ 2 * (d - 4))) FILTER (WHERE d > 4) AS v, count(*) FILTER (WHERE d > 4) AS m FROM u)
SELECT round(w, 6) AS w_bar, round(sqrt(n / 2.0) * (w - 1), 6) AS z_bar, round((w - e) / sqrt(v / m), 6) AS z_tilde, CAST(n AS BIGINT) AS n FROM g"""

# The grid of units and periods with holes.
_GRID = f"SELECT u.unit, g.t, row_number() OVER (PARTITION BY u.unit ORDER BY g.t) AS pos, a.y FROM (SELECT DISTINCT unit FROM ({A})) u CROSS JOIN (SELECT DISTINCT t FROM ({A})) g LEFT JOIN ({A}) a ON a.unit = u.unit AND a.t = g.t"
_MEAN = f"SELECT t, lag(m) OVER (ORDER BY t) AS mlag, m - lag(m) OVER (ORDER BY t) AS dm FROM (SELECT t, avg(y) AS m FROM ({A}) GROUP BY t)"
_CADF = _lags(f"SELECT g.*, mlag, dm, lag(dm) OVER (PARTITION BY unit ORDER BY t) AS dm1 FROM ({_GRID}) g JOIN ({_MEAN}) USING (t)", "lag(y) OVER w AS ylag, y - lag(y) OVER w AS dy")
_CADF1 = f"SELECT *, lag(dy) OVER {W} AS dy1, CAST(pos AS DOUBLE) AS trend FROM ({_CADF})"


def _bracket(c1: float, c5: float, c10: float) -> str:
    return (
        f"CASE WHEN s <= {c1} THEN 0.01 WHEN s <= {c5} THEN 0.01 + (s - ({c1})) / (({c5}) - ({c1})) * 0.04 "
        f"WHEN s <= {c10} THEN 0.05 + (s - ({c5})) / (({c10}) - ({c5})) * 0.05 ELSE 0.5 END"
    )


ORACLES["cips0"] = f"""WITH {ols('f', _CADF, 'dy', ['ylag', 'mlag', 'dm'], spare=1)}, g AS (SELECT avg(greatest(-6.12, least(4.16, b_1 / sqrt(s_1_1)))) AS s, count(*) AS n FROM f)
SELECT round(s, 6) AS statistic, CAST(round({_bracket(-2.50, -2.27, -2.15)}, 6) AS DOUBLE) AS p_value, CAST(n AS BIGINT) AS n FROM g"""
ORACLES["cips_trend_lag"] = f"""WITH {ols('f', _CADF1, 'dy', ['ylag', 'mlag', 'dm', 'trend', 'dy1', 'dm1'], spare=1)},
g AS (SELECT avg(greatest(-6.19, least(2.61, b_1 / sqrt(s_1_1)))) AS s, count(*) AS n FROM f)
SELECT round(s, 6) AS statistic, CAST(round({_bracket(-3.06, -2.83, -2.72)}, 6) AS DOUBLE) AS p_value, CAST(n AS BIGINT) AS n FROM g"""
ORACLES["ips0"] = f"""WITH {ols('f', _CADF, 'dy', ['ylag'], spare=1)}
SELECT round(sqrt(count(*)) * (avg(b_1 / sqrt(s_1_1)) + 1.52) / sqrt(0.74), 6) AS statistic, CAST(count(*) AS BIGINT) AS n FROM f"""
ORACLES["llc1"] = f"""WITH {ols('f', _CADF1, 'dy', ['ylag', 'dy1'], spare=1)}
SELECT round(avg(b_1 / sqrt(s_1_1)) / (stddev_samp(b_1 / sqrt(s_1_1)) / sqrt(count(*))), 6) AS statistic, CAST(count(*) AS BIGINT) AS n FROM f"""
ORACLES["westerlund"] = f"""WITH {ols('f', _lags(A_LAG, 'lag(dy) OVER w AS dy1'), 'dy', ['ylag', 'xlag', 'dx', 'dy1'], spare=1)}
SELECT 'Gt' AS test, round(avg(b_1 / sqrt(s_1_1)), 6) AS statistic FROM f UNION ALL SELECT 'Ga', round(avg(n * b_1), 6) FROM f
UNION ALL SELECT 'Pt', round(sum(b_1) / sqrt(sum(s_1_1)), 6) FROM f UNION ALL SELECT 'Pa', round(sum(n * b_1) / count(*), 6) FROM f"""
_RES = f"""{ols('f', A, 'y', ['x'], spare=0)},
e AS (SELECT unit, row_number() OVER {W} AS r, t, y - b_0 - b_1 * x AS e, count(*) OVER (PARTITION BY unit) AS size FROM ({A}) JOIN f USING (unit) WHERE n >= 4),
d AS (SELECT unit, r, size, e - lag(e) OVER o AS de, lag(e) OVER o AS elag FROM e WINDOW o AS (PARTITION BY unit ORDER BY r)),
d1 AS (SELECT *, lag(de) OVER (PARTITION BY unit ORDER BY r) AS de1 FROM d)"""
ORACLES["pedroni"] = f"""WITH {_RES}, {ols('q', 'SELECT * FROM d1 WHERE r >= 3 AND size >= 5', 'de', ['elag', 'de1'], intercept=False)},
s AS (SELECT unit, max(size) AS size FROM d GROUP BY unit)
SELECT 'Group t' AS test, round(sqrt(count(*)) * (avg(b_1 / sqrt(s_1_1)) + 1.65), 6) AS statistic FROM q
UNION ALL SELECT 'Group rho', round(sqrt(count(*)) * avg((size - 1) * b_1), 6) FROM q JOIN s USING (unit)"""
ORACLES["kao"] = f"""WITH {_RES}, {ols('q', 'SELECT 1 AS one, de, elag FROM d WHERE r >= 3 AND size >= 4', 'de', ['elag'], keys='one', intercept=False)}
SELECT 'ADF' AS test, round(b_1 / sqrt(s_1_1), 6) AS statistic FROM q"""
ORACLES["swamy"] = f"""WITH {ols('f', A, 'y', ['x'])}, p AS (SELECT sum(b_1 / s_1_1) / sum(1 / s_1_1) AS b FROM f),
s AS (SELECT sum((b_1 - p.b) ^ 2 / s_1_1) AS s, count(*) AS n FROM f, p)
SELECT round(s, 6) AS statistic, round(sqrt(n) * (s / n - 1) / sqrt(2.0), 6) AS delta, CAST(n - 1 AS BIGINT) AS df FROM s"""
ORACLES["hausman"] = f"""WITH {ols('f', A, 'y', ['x'])}, p AS (SELECT sum(b_1 / s_1_1) / sum(1 / s_1_1) AS b, 1 / sum(1 / s_1_1) AS v, avg(b_1) AS m, var_pop(b_1) / count(*) AS vm FROM f)
SELECT round((m - b) ^ 2 / (vm - v), 6) AS statistic, CAST(1 AS BIGINT) AS df FROM p"""


def _windows(source: str, size: int, step: int) -> str:
    return f"""p AS ({source}), g AS (SELECT t, row_number() OVER (ORDER BY t) AS pos FROM (SELECT DISTINCT t FROM p)),
win AS (SELECT a.t AS w0, b.t AS w1 FROM g a JOIN g b ON b.pos = a.pos + {size - 1} WHERE (a.pos - 1) % {step} = 0),
wide AS (SELECT w0, w1, p.* FROM win JOIN p ON p.t BETWEEN w0 AND w1),
enough AS (SELECT w0 FROM wide GROUP BY w0 HAVING count(DISTINCT unit) >= 5)"""


def _window_rows(terms: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT w0 AS window_start, w1 AS window_end, '{t}' AS term, round(avg({c}), 6) AS estimate, round(sqrt(var_pop({c}) / count(*)), 6) AS std_error "
        "FROM f SEMI JOIN enough USING (w0) GROUP BY w0, w1"
        for t, c in terms.items()
    )


ORACLES["rolling_mg"] = f"WITH {_windows(C, 24, 12)}, {ols('f', 'SELECT * FROM wide', 'y', ['x'], keys='w0, w1, unit')} {_window_rows(MG)}"
ORACLES["rolling_cce"] = (
    f"WITH {_windows(A, 16, 4)}, withm AS (SELECT *, avg(y) OVER (PARTITION BY w0, t) AS csa_y, avg(x) OVER (PARTITION BY w0, t) AS csa_x FROM wide), "
    f"{ols('f', 'SELECT * FROM withm', 'y', ['x', 'csa_y', 'csa_x'], keys='w0, w1, unit')} {_window_rows(MG)}"
)
_WALD = "(a.m - b.m) ^ 2 / (a.v + b.v)"
ORACLES["break_known"] = f"""WITH {ols('f', f'SELECT *, CASE WHEN t <= {1997 * 4 + 4} THEN 1 ELSE 2 END AS side FROM ({A})', 'y', ['x'], keys='side, unit')},
g AS (SELECT side, avg(b_1) AS m, var_pop(b_1) / count(*) AS v FROM f GROUP BY side)
SELECT round({_WALD}, 6) AS statistic, CAST(1 AS BIGINT) AS df FROM g a JOIN g b ON a.side = 1 AND b.side = 2"""
ORACLES["break_unknown"] = f"""WITH p AS ({A}), g0 AS (SELECT t, row_number() OVER (ORDER BY t) AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT t FROM p)),
cand AS (SELECT t AS date FROM g0 WHERE pos >= greatest(2, CAST(floor(0.15 * n) AS BIGINT) + 1) AND pos <= least(n - 1, n - CAST(floor(0.15 * n) AS BIGINT))),
{ols('f', 'SELECT date, CASE WHEN t <= date THEN 1 ELSE 2 END AS side, p.* FROM cand, p', 'y', ['x'], keys='date, side, unit')},
g AS (SELECT date, side, avg(b_1) AS m, var_pop(b_1) / count(*) AS v FROM f GROUP BY 1, 2)
SELECT a.date, round({_WALD}, 6) AS wald FROM g a JOIN g b ON a.date = b.date AND a.side = 1 AND b.side = 2"""
ORACLES["irf_path"] = f"""WITH RECURSIVE {ols('f', A_LAG, 'y', ['ylag', 'x'])}, m AS (SELECT avg(b_1) AS p, avg(b_2) AS b FROM f),
path AS (SELECT 0 AS h, b AS r FROM m UNION ALL SELECT h + 1, r * p FROM path, m WHERE h < 10)
SELECT CAST(h AS INTEGER) AS horizon, round(r, 6) AS response FROM path"""
_DRAW = f"""units AS (SELECT *, row_number() OVER (ORDER BY unit) - 1 AS i, count(*) OVER () AS n_units FROM f),
draws AS (SELECT rep, ({hashed_sql('rep', 'place')}) % n AS i FROM (SELECT unnest(range(1, 501)) AS rep) CROSS JOIN (SELECT unnest(range(0, (SELECT count(*) FROM f))) AS place), (SELECT count(*) AS n FROM f)),
m AS (SELECT rep, avg(b_0) AS m0, avg(b_1) AS m1 FROM draws JOIN units USING (i) GROUP BY rep)"""
ORACLES["boot_cs"] = f"WITH {ols('f', A, 'y', ['x'])}, {_DRAW} " + " UNION ALL ".join(
    f"SELECT '{t}' AS term, round((SELECT avg(b_{j}) FROM f), 6) AS estimate, round(stddev_samp(m{j}), 6) AS std_error, round(quantile_cont(m{j}, 0.025), 6) AS low, round(quantile_cont(m{j}, 0.975), 6) AS high FROM m"
    for j, t in enumerate(MG)
)
_QUANTILES = "round(stddev_samp(m{j}), 6) AS std_error, round(quantile_cont(m{j}, 0.025), 6) AS low, round(quantile_cont(m{j}, 0.975), 6) AS high FROM m"
_POOL = "sum(b_1 / s_1_1) / sum(1 / s_1_1)"
ORACLES["boot_ccep"] = (
    f"WITH {ols('f', A_CSA, 'y', ['x', 'csa_y', 'csa_x'], intercept=False)}, {_DRAW.split('m AS (')[0]}"
    f"m AS (SELECT rep, {_POOL} AS m1 FROM draws JOIN units USING (i) GROUP BY rep) "
    f"SELECT 'x' AS term, round((SELECT {_POOL} FROM f), 6) AS estimate, " + _QUANTILES.format(j=1)
)
ORACLES["boot_jackknife"] = (
    f"WITH {ols('f', A_CSA, 'y', ['x', 'csa_y', 'csa_x'])}, {ols('h', _CAL, 'y', ['x', 'csa_y', 'csa_x'], keys='unit, half')}, {_DRAW.split('m AS (')[0]}"
    "whole AS (SELECT rep, avg(b_0) AS m0, avg(b_1) AS m1 FROM draws JOIN units USING (i) GROUP BY rep), "
    "side AS (SELECT rep, half, avg(h.b_0) AS m0, avg(h.b_1) AS m1 FROM draws JOIN units USING (i) JOIN h USING (unit) GROUP BY 1, 2), "
    "pair AS (SELECT rep, sum(m0) AS m0, sum(m1) AS m1 FROM side GROUP BY rep), "
    "m AS (SELECT rep, 2 * whole.m0 - 0.5 * pair.m0 AS m0, 2 * whole.m1 - 0.5 * pair.m1 AS m1 FROM whole JOIN pair USING (rep)) "
    + " UNION ALL ".join(
        f"SELECT '{t}' AS term, round(2 * (SELECT avg({c}) FROM f) - 0.5 * ((SELECT avg({c}) FROM h WHERE half = 1) + (SELECT avg({c}) FROM h WHERE half = 2)), 6) AS estimate, "
        + _QUANTILES.format(j=j)
        for j, (t, c) in enumerate(MG.items())
    )
)
# e x summed by unit with a sign a row and draw; (X'X)^-1 is the covariance over the variance.
ORACLES["boot_wild"] = (
    f"WITH {ols('f', A, 'y', ['x'])}, e AS (SELECT unit, t, x, y - b_0 - b_1 * x AS e FROM ({A}) JOIN f USING (unit)), "
    f"w AS (SELECT unit, rep, sum(e * ({sign_sql('rep', 'unit', 't')})) AS a, sum(e * x * ({sign_sql('rep', 'unit', 't')})) AS b "
    "FROM e, (SELECT unnest(range(1, 501)) AS rep) GROUP BY 1, 2), "
    "m AS (SELECT rep, avg(b_0 + (s_0_0 * a - s_1_1 * xbar1 * b) / s2) AS m0, avg(b_1 + (s_1_1 * b - s_1_1 * xbar1 * a) / s2) AS m1 FROM w JOIN f USING (unit) GROUP BY rep) "
    + " UNION ALL ".join(f"SELECT '{t}' AS term, round((SELECT avg({c}) FROM f), 6) AS estimate, " + _QUANTILES.format(j=j) for j, (t, c) in enumerate(MG.items()))
)
ORACLES["irf_bands"] = f"""WITH RECURSIVE {ols('f', A_LAG, 'y', ['ylag', 'x'])}, {_DRAW.split('m AS (')[0].replace('range(1, 501)', 'range(1, 201)')}
m AS (SELECT 0 AS rep, avg(b_1) AS p, avg(b_2) AS b FROM f UNION ALL SELECT rep, avg(b_1), avg(b_2) FROM draws JOIN units USING (i) GROUP BY rep),
path AS (SELECT rep, 0 AS h, b AS r FROM m UNION ALL SELECT path.rep, h + 1, r * p FROM path JOIN m USING (rep) WHERE h < 10)
SELECT CAST(h AS INTEGER) AS horizon, round(any_value(r) FILTER (WHERE rep = 0), 6) AS response,
round(quantile_cont(r, 0.025) FILTER (WHERE rep > 0), 6) AS low, round(quantile_cont(r, 0.975) FILTER (WHERE rep > 0), 6) AS high FROM path GROUP BY h"""
ORACLES["rolling_ccep"] = (
    f"WITH {_windows(A, 16, 4)}, withm AS (SELECT *, avg(y) OVER (PARTITION BY w0, t) AS csa_y, avg(x) OVER (PARTITION BY w0, t) AS csa_x FROM wide), "
    f"{ols('f', 'SELECT * FROM withm', 'y', ['x', 'csa_y', 'csa_x'], keys='w0, w1, unit', intercept=False)} "
    f"SELECT w0 AS window_start, w1 AS window_end, 'x' AS term, round({_POOL}, 6) AS estimate, round(sqrt(1 / sum(1 / s_1_1)), 6) AS std_error "
    "FROM f SEMI JOIN enough USING (w0) GROUP BY w0, w1"
)
ORACLES["rolling_csardl"] = (
    f"WITH {_windows(A, 20, 4)}, withm AS (SELECT *, avg(y) OVER (PARTITION BY w0, t) AS csa_y, avg(x) OVER (PARTITION BY w0, t) AS csa_x, "
    "lag(y) OVER (PARTITION BY w0, unit ORDER BY t) AS ylag FROM wide), "
    f"{ols('f', 'SELECT * FROM withm', 'y', ['ylag', 'x', 'csa_y', 'csa_x'], keys='w0, w1, unit')} "
    + _window_rows({"(Intercept)": "b_0", "L(y,1)": "b_1", "x": "b_2"})
)
ORACLES["information_criteria"] = f"""WITH {ols('f', A_CSA, 'y', ['x', 'csa_y', 'csa_x'])},
g AS (SELECT count(*) AS n, round(avg(n)) AS t, sum(ssr) / sum(n) AS s FROM f), r AS (SELECT *, 2 * (n + t) / (n * t) AS rate, ln(n * t / (n + t)) AS p1, ln(least(n, t)) AS p2 FROM g)
SELECT round(ln(s) + rate * p1, 6) AS ic1, round(ln(s) + rate * p2, 6) AS ic2, round(s + rate * s * p1, 6) AS pc1, round(s + rate * s * p2, 6) AS pc2, CAST(2 AS BIGINT) AS m FROM r"""
