"""Panel unit-root tests on the grid of units and periods."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.report import Report
from ..functions.tails import bracket_p, normal_cdf
from ..sources.panel import Panel
from .ols import ols

#: Critical values at 1, 5 and 10 %, and the bounds that unit statistics are cut to.
CIPS_CV = {False: (-2.50, -2.27, -2.15), True: (-3.06, -2.83, -2.72)}
CIPS_BOUNDS = {False: (-6.12, 4.16), True: (-6.19, 2.61)}
#: Mean and variance of unit statistics under the null.
IPS_MOMENTS = {False: (-1.52, 0.74), True: (-2.12, 0.56)}


def _grid(panel: Panel, column: str) -> DataFrame:
    g = panel.with_df(panel.df.filter(F.col(column).isNotNull())).grid([column])
    return g.select(panel.unit, "pos", F.col(column).cast("double").alias("y"))


def _statistics(rows: DataFrame, unit: str, lags: int, trend: bool, averages: bool) -> DataFrame:
    """unit, t: the ratio of the lagged level's coefficient to its error; lags are on the grid, so gaps leave holes."""
    w = Window.partitionBy(unit).orderBy("pos")
    cols = ["ylag"] + (["mlag", "dm"] if averages else []) + (["pos"] if trend else [])
    d = rows.withColumns({"ylag": F.lag("y", 1).over(w), "dy": F.col("y") - F.lag("y", 1).over(w)})
    for j in range(1, lags + 1):
        d = d.withColumn(f"dy{j}", F.lag("dy", j).over(w))
        cols.append(f"dy{j}")
        if averages:
            cols.append(f"dm{j}")
    fits = ols(d, [unit], "dy", cols, spare=1)
    k = len(cols) + 1
    return fits.select(unit, (F.get("b", F.lit(1)) / F.sqrt(F.get("v", F.lit(k + 1)))).alias("t"))


def cips_units(panel: Panel, column: str, lags: int = 0, trend: bool = False) -> DataFrame:
    rows = _grid(panel, column)
    w = Window.orderBy("pos")
    m = rows.groupBy("pos").agg(F.avg("y").alias("m"))
    m = m.withColumns({"mlag": F.lag("m", 1).over(w), "dm": F.col("m") - F.lag("m", 1).over(w)})
    m = m.withColumns({f"dm{j}": F.lag("dm", j).over(w) for j in range(1, lags + 1)}).drop("m")
    low, high = CIPS_BOUNDS[trend]
    t = _statistics(rows.join(m, "pos"), panel.unit, lags, trend, True)
    return t.withColumn("t", F.greatest(F.lit(low), F.least(F.lit(high), "t")))


def cips_test(panel: Panel, column: str, lags: int = 0, trend: bool = False) -> dict:
    """statistic, p_value, n: the mean of the units' cross-sectionally augmented statistics."""
    t = panel.df.filter(F.col(column).isNotNull()).agg(F.count_distinct(panel.time)).first()[0]
    if t < 3 + lags:
        raise ValueError(f"too few periods for {lags} lags")
    r = cips_units(panel, column, lags, trend).agg(F.avg("t"), F.count("t")).first()
    s = r[0] if r[0] is not None else math.nan
    return Report("Cross-sectionally augmented unit-root test", {"statistic": s, "p_value": bracket_p(s, *CIPS_CV[trend]), "n": r[1], "t": t})


def unit_root_test(panel: Panel, column: str, test: str = "ips", lags: int = 0, trend: bool = False) -> dict:
    """ips: the standardised mean of the units' statistics; llc: their mean over its standard error."""
    if test not in ("ips", "llc"):
        raise ValueError("test is ips or llc")
    r = _statistics(_grid(panel, column), panel.unit, lags, trend, False).agg(F.avg("t"), F.stddev_samp("t"), F.count("t")).first()
    if r[2] < 2:
        raise ValueError("fewer than 2 usable units")
    e, v = IPS_MOMENTS[trend]
    s = math.sqrt(r[2]) * (r[0] - e) / math.sqrt(v) if test == "ips" else r[0] / (r[1] / math.sqrt(r[2]))
    return Report("Panel unit-root test", {"test": test, "statistic": s, "p_value": normal_cdf(s), "n": r[2]})
