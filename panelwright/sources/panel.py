"""Panels: tables keyed by unit and time.

A panel is a DataFrame and the names of its two index columns; the order of rows
is no property of it, so every operator states its own. NaN counts as missing and
becomes NULL once, here.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Panel:
    df: DataFrame
    unit: str
    time: str

    @classmethod
    def of(
        cls, df: DataFrame, unit: str | None = None, time: str | None = None, index: tuple[str, str] | None = None, check: bool = True
    ) -> Panel:
        """A validated panel; index is another way to name (unit, time).

        Rows with a null index are an error, and so are two rows of one cell.
        """
        if index is not None:
            unit, time = index
        for name in (unit, time):
            if name not in df.columns:
                raise ValueError(f"index column {name!r} not found")
        floats = {f.name for f in df.schema if f.dataType.typeName() in ("double", "float")}
        clean = df.select(*[F.nanvl(F.col(f"`{c}`"), F.lit(None)).alias(c) if c in floats else F.col(f"`{c}`") for c in df.columns])
        if check:
            bad = clean.groupBy(unit, time).count().filter((F.col("count") > 1) | F.col(unit).isNull() | F.col(time).isNull())
            row = bad.limit(1).collect()
            if row:
                what = "Null index" if None in row[0][:2] else "Duplicate cell"
                raise ValueError(f"{what}: ({unit}, {time}) = {tuple(row[0][:2])}")
        return cls(clean, unit, time)

    @property
    def by_unit(self) -> WindowSpec:
        return Window.partitionBy(self.unit).orderBy(self.time)

    def with_df(self, df: DataFrame) -> Panel:
        return Panel(df, self.unit, self.time)

    def with_columns(self, columns: dict[str, Column]) -> Panel:
        return self.with_df(self.df.withColumns(columns)) if columns else self

    def balance(self) -> DataFrame:
        """One row: n_units, t_min, t_max, t_bar, n_periods, balanced."""
        sizes = self.df.groupBy(self.unit).agg(F.count("*").alias("t"))
        periods = self.df.agg(F.count_distinct(self.time).alias("n_periods"))
        found = sizes.agg(
            F.count("*").alias("n_units"), F.min("t").alias("t_min"), F.max("t").alias("t_max"), F.avg("t").alias("t_bar")
        )
        return found.crossJoin(periods).withColumn("balanced", F.col("t_min") == F.col("t_max"))

    def periods(self) -> DataFrame:
        """The sorted grid of times as (time, pos); a table of T rows."""
        return self.df.select(self.time).distinct().withColumn("pos", F.row_number().over(Window.orderBy(self.time)))

    def grid(self, columns: Iterable[str]) -> DataFrame:
        """Every unit in every period, with NULL where there is no row, and the period's place."""
        cells = self.df.select(self.unit).distinct().crossJoin(F.broadcast(self.periods()))
        return cells.join(self.df.select(self.unit, self.time, *columns), [self.unit, self.time], "left")

    def matrix(self, column: str, align: str = "calendar") -> DataFrame:
        """One row a unit: its values as an array. Periods and units without any value are left out.

        calendar: on the grid of times, NULL where there is none; left: the
        unit's own values one after the other.
        """
        if align == "left":
            own = F.array_sort(F.collect_list(F.struct(F.col(self.time).alias("t"), F.col(column).cast("double").alias("v"))))
            return self.df.filter(F.col(column).isNotNull()).groupBy(self.unit).agg(F.transform(own, lambda c: c["v"]).alias("row"))
        seen = self.with_df(self.df.filter(F.col(column).isNotNull()).select(self.unit, self.time, column))
        cell = F.struct("pos", F.col(column).cast("double").alias("v"))
        return seen.grid([column]).groupBy(self.unit).agg(F.transform(F.array_sort(F.collect_list(cell)), lambda c: c["v"]).alias("row"))


def read(spark: SparkSession, path: str, unit: str, time: str, source: str = "parquet", **options) -> Panel:
    """A panel from any file source that Spark reads."""
    return Panel.of(spark.read.format(source).options(**options).load(path), unit, time)


def from_matrix(spark: SparkSession, rows, unit: str = "unit", time: str = "time", column: str = "y") -> Panel:
    """A panel from an N x T array, NaN for missing."""
    cells = [(i, t, float(v)) for i, row in enumerate(rows) for t, v in enumerate(row)]
    p = Panel.of(spark.createDataFrame(cells, f"{unit} long, {time} long, {column} double"), unit, time, check=False)
    return p.with_df(p.df.dropna())


def simulate(spark: SparkSession, n_units: int = 30, n_periods: int = 50, seed: int = 1) -> Panel:
    """y = a_i + b1_i y(-1) + b2_i x + g_i f + e with an AR(1) factor, b1 about .5 and b2 about 1.

    Draws are hashes, so the rows do not depend on the partitioning.
    """
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(seed)
    f = np.zeros(n_periods + 50)
    for t in range(1, len(f)):
        f[t] = 0.5 * f[t - 1] + rng.normal()
    factor = f.tolist()

    def unit(pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.random.default_rng([seed, int(pdf["unit"].iloc[0])])
        b1, b2, g, gx, a = own.uniform(0.3, 0.7), own.uniform(0.5, 1.5), own.normal(1, 0.3), own.normal(0.5, 0.2), own.normal()
        x, y = np.zeros(len(factor)), np.zeros(len(factor))
        for t in range(1, len(factor)):
            x[t] = 0.5 * x[t - 1] + gx * factor[t] + own.normal()
            y[t] = a + b1 * y[t - 1] + b2 * x[t] + g * factor[t] + 0.5 * own.normal()
        return pd.DataFrame(
            {"unit": pdf["unit"].iloc[0], "time": np.arange(1, n_periods + 1), "y": y[50:], "x": x[50:]}
        )

    df = spark.range(1, n_units + 1).withColumnRenamed("id", "unit").groupBy("unit").applyInPandas(unit, "unit long, time long, y double, x double")
    return Panel.of(df, "unit", "time", check=False)
