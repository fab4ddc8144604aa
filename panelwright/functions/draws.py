"""Random draws by integer arithmetic that Spark SQL and DuckDB evaluate alike."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import cut

#: A multiplicative generator modulo a prime; products stay below 2**63.
PRIME = 2147483647
FACTOR = 48271


def hashed(*parts: Column, seed: int = 0) -> Column:
    """A number from 0 to PRIME - 1 from whole numbers; squares mix what the products leave linear."""
    x = F.lit(seed % PRIME + 1).cast("long")
    for p in parts:
        for shift in (11, 7919):
            x = (x * F.lit(FACTOR) + F.pmod(p.cast("long"), F.lit(PRIME)) + F.lit(shift)) % F.lit(PRIME)
            x = (x * x + F.lit(shift)) % F.lit(PRIME)
    return (x * F.lit(FACTOR)) % F.lit(PRIME)


def hashed_sql(*parts: str, seed: int = 0) -> str:
    """The same in DuckDB."""
    x = f"CAST({seed % PRIME + 1} AS BIGINT)"
    for p in parts:
        for shift in (11, 7919):
            x = f"(({x}) * {FACTOR} + ((CAST({p} AS BIGINT) % {PRIME}) + {PRIME}) % {PRIME} + {shift}) % {PRIME}"
            x = f"(({x}) * ({x}) + {shift}) % {PRIME}"
    return f"(({x}) * {FACTOR}) % {PRIME}"


def sign(*parts: Column, seed: int = 0) -> Column:
    """+1 or -1."""
    return F.when(F.floor(hashed(*parts, seed=seed) / F.lit(1024)) % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))


def sign_sql(*parts: str, seed: int = 0) -> str:
    return f"CASE WHEN (({hashed_sql(*parts, seed=seed)}) // 1024) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END"


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """rows with _i, their place in the order of the key from 0: counted within ranges of the key, without one sort of all."""
    held = rows.repartitionByRange(key).sortWithinPartitions(key).withColumn("_m", F.monotonically_increasing_id())
    held = cut(held, "numbered")
    sizes = held.groupBy(F.shiftright("_m", 33).alias("_p")).agg(F.count("*").alias("_n"))
    # A row a range.
    before = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_p", F.coalesce(before, F.lit(0)).alias("_b"))
    place = F.col("_b") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return held.withColumn("_p", F.shiftright("_m", 33)).join(starts, "_p").withColumn("_i", place).select(*rows.columns, "_i")


def draw_counts(units: DataFrame, unit: str, reps: int, seed: int = 0) -> DataFrame:
    """rep, place and the columns of units: rows drawn with replacement, as many as there are.

    It has reps rows a unit; sums over it are made by Spark.
    """
    ranked = numbered(units, unit)
    n = ranked.count()
    id_ = F.col("id")
    draws = units.sparkSession.range(reps * n).select((F.floor(id_ / n) + 1).cast("long").alias("rep"), (id_ % max(1, n)).alias("place"))
    return draws.withColumn("_i", hashed(F.col("rep"), F.col("place"), seed=seed) % max(1, n)).join(ranked, "_i").drop("_i")


def hashed_array(*parts: np.ndarray, seed: int = 0) -> np.ndarray:
    """The same as hashed, of numpy arrays of whole numbers."""
    x = np.int64(seed % PRIME + 1)
    for p in parts:
        for shift in (11, 7919):
            x = (x * np.int64(FACTOR) + p % PRIME + shift) % PRIME
            x = (x * x + shift) % PRIME
    return (x * np.int64(FACTOR)) % PRIME


def sign_array(*parts: np.ndarray, seed: int = 0) -> np.ndarray:
    return np.where((hashed_array(*parts, seed=seed) // 1024) % 2 == 0, 1.0, -1.0)
