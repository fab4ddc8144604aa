"""Lags, cross-sectional averages, absorption and spatial averages as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.panel import Panel
from ..sources.scratch import cut


def lag(panel: Panel, columns: list[str], k: int) -> Panel:
    """Adds ``x__l{k}``: the value k rows before within the unit (after it if k < 0); gaps in time are not looked at."""
    name = lambda c: f"{c}__l{k if k >= 0 else f'm{-k}'}"
    return panel.with_columns({name(c): F.lag(F.col(c).cast("double"), k).over(panel.by_unit) if k else F.col(c).cast("double") for c in columns})


def diff(panel: Panel, columns: list[str], k: int = 1) -> Panel:
    """Adds ``x__d{k}``: the value less that k rows before."""
    return panel.with_columns({f"{c}__d{k}": F.col(c).cast("double") - F.lag(F.col(c).cast("double"), k).over(panel.by_unit) for c in columns})


def lag_range(panel: Panel, column: str, low: int, high: int) -> Panel:
    if low > high:
        raise ValueError(f"{low} is larger than {high}")
    for k in range(low, high + 1):
        panel = lag(panel, [column], k)
    return panel


def csa_names(columns: list[str], lags: int | dict) -> list[str]:
    """All contemporaneous averages, then lags by variable."""
    of = lambda c: lags.get(c, 0) if isinstance(lags, dict) else lags
    return [f"csa_{c}" for c in columns] + [f"csa_{c}_L{k}" for c in columns for k in range(1, of(c) + 1)]


def csa_table(panel: Panel, columns: list[str], lags: int | dict = 0, by: str | None = None) -> DataFrame:
    """Means over units by period, lagged on the grid of periods; by: within the groups of a column."""
    keys = [panel.time] if by is None else [by, panel.time]
    means = panel.df.groupBy(*keys).agg(*[F.avg(F.col(c).cast("double")).alias(f"csa_{c}") for c in columns])
    order = Window.orderBy(panel.time) if by is None else Window.partitionBy(by).orderBy(panel.time)
    of = lambda c: lags.get(c, 0) if isinstance(lags, dict) else lags
    return means.withColumns({f"csa_{c}_L{k}": F.lag(f"csa_{c}", k).over(order) for c in columns for k in range(1, of(c) + 1)})


def csa_global(panel: Panel, columns: list[str], lags: int | dict = 0) -> Panel:
    """Adds the averages of each period. The table joined has a row a period; Spark picks the join by its size."""
    return panel.with_df(panel.df.join(csa_table(panel, columns, lags), panel.time, "left"))


def csa_wider(panel: Panel, full: Panel, columns: list[str], lags: int | dict = 0) -> Panel:
    """Adds averages taken from a wider sample."""
    table = csa_table(full, columns, lags).withColumnRenamed(full.time, panel.time)
    return panel.with_df(panel.df.join(table, panel.time, "left"))


def csa_cluster(panel: Panel, columns: list[str], by: str, lags: int | dict = 0) -> Panel:
    """Adds averages within clusters, lagged on each cluster's own periods."""
    table = csa_table(panel, columns, lags, by)
    # Rows of units without a cluster keep NULL averages.
    return panel.with_df(panel.df.join(table, [by, panel.time], "left"))


def spatial_weights(edges: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """unit_i, unit_j, w with weights that sum to 1 for each unit_i; a unit without weight stays without.

    The diagonal is dropped. Null or NaN weights, two rows of a pair, and units
    that the panel does not have (where units is given) are errors.
    """
    bad = edges.filter(F.col("w").isNull() | F.isnan("w") | F.col("unit_i").isNull() | F.col("unit_j").isNull()).limit(1).collect()
    if bad:
        raise ValueError(f"weight missing: {bad[0]}")
    if edges.groupBy("unit_i", "unit_j").count().filter("count > 1").limit(1).collect():
        raise ValueError("a pair of units has two weights")
    if units is not None:
        known = units.toDF("u").distinct()
        both = edges.select(F.col("unit_i").alias("u")).union(edges.select("unit_j")).distinct()
        if both.join(known, "u", "left_anti").limit(1).collect() or known.join(both, "u", "left_anti").limit(1).collect():
            raise ValueError("weights and panel do not have the same units")
    own = edges.filter("unit_i <> unit_j")
    total = F.sum("w").over(Window.partitionBy("unit_i"))
    return own.withColumn("w", F.when(total > 0, F.col("w") / total).otherwise(F.col("w")))


def csa_spatial(panel: Panel, columns: list[str], weights: DataFrame, lags: int | dict = 0) -> Panel:
    """Adds weighted averages over neighbours; a missing neighbour counts as 0, and lags go by row within the unit."""
    of = lambda c: lags.get(c, 0) if isinstance(lags, dict) else lags
    p = panel.df.select(F.col(panel.unit).alias("unit_j"), F.col(panel.time).alias("_t"), *columns)
    sums = (
        weights.join(p, "unit_j")
        .groupBy("unit_i", "_t")
        .agg(*[F.sum(F.col("w") * F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(f"csa_{c}") for c in columns])
    )
    rows = panel.df.join(sums, (F.col(panel.unit) == F.col("unit_i")) & (F.col(panel.time) == F.col("_t")), "left").drop("unit_i", "_t")
    rows = rows.withColumns({f"csa_{c}": F.coalesce(f"csa_{c}", F.lit(0.0)) for c in columns})
    return panel.with_df(rows).with_columns(
        {f"csa_{c}_L{k}": F.lag(f"csa_{c}", k).over(panel.by_unit) for c in columns for k in range(1, of(c) + 1)}
    )


def demean(df: DataFrame, columns: list[str], group: str) -> DataFrame:
    """columns less their means by group, from an aggregate that is combined before the shuffle; null is a group."""
    means = df.groupBy(F.col(group).alias("_group")).agg(*[F.avg(F.col(c).cast("double")).alias(f"_mean_{i}") for i, c in enumerate(columns)])
    rows = df.join(means, F.col(group).eqNullSafe(F.col("_group")))
    return rows.withColumns({c: F.col(c).cast("double") - F.col(f"_mean_{i}") for i, c in enumerate(columns)}).select(*df.columns)


def absorb(panel: Panel, columns: list[str], groups: list[str], tol: float = 1e-10, rounds: int = 200) -> Panel:
    """columns less their means by each group; with several groups by alternating projections.

    Means are over rows that have a value. One number a round comes to the
    driver: the largest change.
    """
    for g in groups:
        if g not in panel.df.columns:
            raise ValueError(f"column to absorb {g!r} not found")

    df = panel.df.withColumns({c: F.col(c).cast("double") for c in columns})
    if len(groups) == 1:
        return panel.with_df(demean(df, columns, groups[0]))
    for _ in range(rounds):
        before = df.withColumns({f"_was_{c}": F.col(c) for c in columns})
        for g in groups:
            before = demean(before, columns, g)
        moved = cut(before, "absorb")
        change = moved.agg(F.max(F.greatest(F.lit(0.0), *[F.abs(F.col(c) - F.col(f"_was_{c}")) for c in columns]))).first()[0]
        df = moved.drop(*[f"_was_{c}" for c in columns])
        if change is None or change < tol:
            break
    return panel.with_df(df)


def common_dynamic_process(panel: Panel, y: str, xs: list[str]) -> DataFrame:
    """time, cdp: the cumulated effects of periods in a pooled regression of first differences.

    With differences less their period means the slopes come from one small
    aggregate; a period's effect is then what its means leave. The first
    differenced period is the reference.
    """
    from .ols import gram, solve_rows

    d = panel.with_columns(
        {f"_d{i}": F.col(c).cast("double") - F.lag(F.col(c).cast("double"), 1).over(panel.by_unit) for i, c in enumerate([y, *xs])}
    ).df.select(panel.time, *[f"_d{i}" for i in range(len(xs) + 1)])
    d = d.dropna(subset=[f"_d{i}" for i in range(len(xs) + 1)])
    within = demean(d, [f"_d{i}" for i in range(len(xs) + 1)], panel.time).withColumn("one", F.lit(1))
    rows = gram(within, ["one"], "_d0", [f"_d{i}" for i in range(1, len(xs) + 1)]).collect()
    if not rows:
        raise ValueError("no period has a complete first difference")
    b = solve_rows(rows, intercept=False)[0]["b"]
    means = d.groupBy(panel.time).agg(*[F.avg(f"_d{i}").alias(f"_d{i}") for i in range(len(xs) + 1)])
    effect = F.col("_d0") - sum((F.col(f"_d{i + 1}") * float(v) for i, v in enumerate(b)), F.lit(0.0))
    order = Window.orderBy(panel.time)
    effects = means.select(panel.time, effect.alias("e")).withColumn("e", F.col("e") - F.first("e").over(order))
    return effects


def attach_cdp(panel: Panel, y: str, xs: list[str], name: str = "cdp_level") -> Panel:
    """Adds the process's level: effects cumulated over each unit's rows, 0 for periods without one."""
    effects = common_dynamic_process(panel, y, xs)
    level = F.sum(F.coalesce("e", F.lit(0.0))).over(panel.by_unit.rowsBetween(Window.unboundedPreceding, 0))
    return panel.with_df(panel.df.join(effects, panel.time, "left").withColumn(name, level).drop("e"))
