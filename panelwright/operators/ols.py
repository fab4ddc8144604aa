"""Per-unit least squares from mergeable aggregates.

``gram`` makes one row a group: the count, means and centred cross products of
y and the regressors. These are Spark's own covariance aggregates, combined on
the map side, so a row of the panel is shuffled at most as part of a sum.
``solve`` turns batches of such rows into coefficients with numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Relative size of a singular value that counts as zero.
RANK_TOL = float(np.sqrt(np.finfo(float).eps))
SOLVED = "n long, k int, b array<double>, v array<double>, ssr double, tss double, sigma2 double, r2 double, rank_ok boolean"


def gram(df: DataFrame, keys: list[str], y: str, xs: list[str]) -> DataFrame:
    """keys, n, m (means) and c (upper triangle of centred cross products over n) of [y, *xs] over complete rows."""
    cols = [y, *xs]
    d = df.select(*keys, *[F.col(f"`{c}`").cast("double").alias(f"_v{i}") for i, c in enumerate(cols)])
    d = d.dropna(subset=[f"_v{i}" for i in range(len(cols))])
    means = F.array(*[F.avg(f"_v{i}") for i in range(len(cols))])
    cross = F.array(*[F.covar_pop(f"_v{i}", f"_v{j}") for i in range(len(cols)) for j in range(i, len(cols))])
    return d.groupBy(*keys).agg(F.count("*").alias("n"), means.alias("m"), cross.alias("c"))


def solve_arrays(n: np.ndarray, m: np.ndarray, c: np.ndarray, intercept: bool = True) -> dict[str, np.ndarray]:
    """Batched least squares. m: (B, K+1), c: (B, (K+1)(K+2)/2). With an intercept it is the first coefficient."""
    size, cols = m.shape
    k = cols - 1
    s = np.zeros((size, cols, cols))
    i, j = np.triu_indices(cols)
    s[:, i, j] = c
    s[:, j, i] = c
    s *= n[:, None, None]
    tss = s[:, 0, 0].copy()
    if not intercept:
        s += n[:, None, None] * m[:, :, None] * m[:, None, :]
    xx, xy, yy = s[:, 1:, 1:], s[:, 1:, 0], s[:, 0, 0]
    # Columns are scaled to length one, so that the cutoff does not depend on units.
    scale = np.sqrt(np.maximum(np.einsum("bii->bi", xx), 0.0))
    safe = np.where(scale > 0, scale, 1.0)
    unit = xx / safe[:, :, None] / safe[:, None, :] if k else xx
    unit = np.nan_to_num(unit)
    if k:
        values = np.linalg.eigvalsh(unit)
        ok = (values[:, 0] > RANK_TOL**2 * np.maximum(values[:, -1], 1e-300)) & (scale > 0).all(axis=1)
    else:
        ok = np.ones(size, bool)
    inv = np.zeros_like(unit)
    if ok.any() and k:
        inv[ok] = np.linalg.inv(unit[ok])
    if (~ok).any():
        inv[~ok] = np.linalg.pinv(unit[~ok], rcond=RANK_TOL, hermitian=True)
    inv = inv / safe[:, :, None] / safe[:, None, :] if k else inv
    b = np.einsum("bij,bj->bi", inv, xy)
    ssr = np.maximum(yy - np.einsum("bi,bi->b", b, xy), 0.0)
    total = k + intercept
    df = n - total
    with np.errstate(divide="ignore", invalid="ignore"):
        sigma2 = np.where(df > 0, ssr / np.where(df > 0, df, 1), np.nan)
        r2 = np.where(tss > 0, 1 - ssr / np.where(tss > 0, tss, 1), np.nan)
    if intercept:
        mx = m[:, 1:]
        a = m[:, 0] - np.einsum("bi,bi->b", mx, b)
        full = np.zeros((size, total, total))
        cov = -np.einsum("bij,bj->bi", inv, mx)
        full[:, 1:, 1:] = inv
        full[:, 0, 1:] = full[:, 1:, 0] = cov
        full[:, 0, 0] = 1.0 / n - np.einsum("bi,bi->b", cov, mx)
        b, inv = np.concatenate([a[:, None], b], axis=1), full
    return {
        "n": n, "k": np.full(size, total), "b": b, "v": inv * sigma2[:, None, None], "ssr": ssr, "tss": tss, "sigma2": sigma2, "r2": r2, "rank_ok": ok,
    }


def solve(grams: DataFrame, keys: list[str], intercept: bool = True) -> DataFrame:
    """keys and the columns of SOLVED: coefficients b, their variance v row by row, and fit statistics."""
    kinds = ", ".join(f"`{k}` {grams.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            got = solve_arrays(pdf["n"].to_numpy(float), np.stack(pdf["m"]), np.stack(pdf["c"]), intercept)
            out = pdf[keys].reset_index(drop=True)
            out["n"], out["k"] = got["n"].astype("int64"), got["k"].astype("int32")
            out["b"] = list(got["b"])
            out["v"] = list(got["v"].reshape(len(out), -1))
            for c in ("ssr", "tss", "sigma2", "r2"):
                out[c] = got[c]
            out["rank_ok"] = got["rank_ok"]
            yield out

    return grams.select(*keys, "n", "m", "c").mapInPandas(run, (kinds + ", " if kinds else "") + SOLVED)


def solve_rows(rows: list, intercept: bool = True) -> list[dict]:
    """The same for a few collected rows."""
    got = solve_arrays(np.array([float(r["n"]) for r in rows]), np.array([r["m"] for r in rows]), np.array([r["c"] for r in rows]), intercept)
    return [{k: v[i] for k, v in got.items()} for i in range(len(rows))]


def ols(df: DataFrame, keys: list[str], y: str, xs: list[str], intercept: bool = True, spare: int = 0) -> DataFrame:
    """Regressions of y on xs by group; a group with no more rows than columns plus ``spare`` is left out."""
    enough = F.col("n") > len(xs) + intercept + spare
    return solve(gram(df, keys, y, xs).filter(enough), keys, intercept)


def weighted_sums(units: DataFrame, at: list[int], k: int) -> tuple[int, np.ndarray, np.ndarray, float]:
    """n, sum of W, sum of W b and sum of b'W b over units, W the inverse variance of the coefficients ``at`` of k.

    Tasks sum their own units; a row a batch comes to the driver.
    """
    m = len(at)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            b = np.stack(pdf["b"])[:, at]
            v = np.stack(pdf["v"]).reshape(len(pdf), k, k)[:, at][:, :, at]
            w = np.linalg.pinv(v, rcond=RANK_TOL, hermitian=True)
            wb = np.einsum("bij,bj->bi", w, b)
            sums = np.concatenate([[len(pdf)], w.sum(axis=0).ravel(), wb.sum(axis=0), [np.einsum("bi,bi->", b, wb)]])
            yield pd.DataFrame({"s": [sums]})

    rows = units.filter("sigma2 > 0").select("b", "v").mapInPandas(run, "s array<double>").collect()
    if not rows:
        raise ValueError("no unit has a variance")
    s = np.sum([r[0] for r in rows], axis=0)
    return int(s[0]), s[1 : 1 + m * m].reshape(m, m), s[1 + m * m : 1 + m * m + m], float(s[-1])


def pooled_inverse_variance(w: np.ndarray, wb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients weighted by their inverse variances, and the variance of that, from the sums of W and W b."""
    v = np.linalg.pinv(w, rcond=RANK_TOL, hermitian=True)
    return v @ wb, v


def period_products(df: DataFrame, unit: str, time: str, columns: list[str], times: list) -> np.ndarray:
    """(K, K, T, T): sums over units of column i at period s times column j at period t, over the periods given.

    Each task adds up outer products of its units' rows, and Spark adds up the
    tasks'; K T rows of as many numbers come to the driver.
    """
    spark, k, n = df.sparkSession, len(columns), len(times)
    kind = df.schema[time].dataType.simpleString()
    places = spark.createDataFrame(list(zip(times, range(n), strict=True)), f"_time {kind}, _pos int")
    values = F.array(*[F.col(f"`{c}`").cast("double") for c in columns])
    cells = df.join(places, F.col(time) == F.col("_time")).groupBy(unit).agg(F.collect_list(F.struct("_pos", values.alias("v"))).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n * k, n * k))
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                own = batch.column(0).slice(a, 1024)
                flat = own.flatten()
                e = np.zeros((len(own), n, k))
                row = np.repeat(np.arange(len(own)), np.asarray(own.value_lengths()))
                e[row, flat.field(0).to_numpy(zero_copy_only=False)] = np.nan_to_num(flat.field(1).flatten().to_numpy(zero_copy_only=False)).reshape(-1, k)
                wide = e.reshape(len(own), n * k)
                total += wide.T @ wide
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n * k, dtype=np.int32)), pa.array(list(total))], names=["i", "v"])

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for i, v in zip(pdf["i"], pdf["v"], strict=True):
                sums[i] = sums.get(i, 0.0) + v
        if sums:
            yield pd.DataFrame({"i": list(sums), "v": list(sums.values())})

    parts = cells.select("cells").mapInArrow(run, "i int, v array<double>").repartition("i")
    rows = parts.mapInPandas(total, "i int, v array<double>").collect()
    out = np.zeros((n * k, n * k))
    for i, v in rows:
        out[i] = v
    return out.reshape(n, k, n, k).transpose(1, 3, 0, 2)


def delta_method(g, b, v, step: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """g(b) and its variance J V J', with derivatives by central differences."""
    b = np.asarray(b, float)
    value = np.atleast_1d(g(b))
    sides = [(np.atleast_1d(g(b + step * e)) - np.atleast_1d(g(b - step * e))) / (2 * step) for e in np.eye(len(b))]
    jac = np.stack(sides, axis=1)
    return value, jac @ np.asarray(v, float) @ jac.T


def spread_around(bs, center) -> np.ndarray:
    """Cross products of unit coefficients around a pooled one, over N squared."""
    gap = np.asarray(bs, float) - np.asarray(center, float)
    return gap.T @ gap / len(gap) ** 2


def partial_out(df: DataFrame, keys: list[str], columns: list[str], on: list[str], intercept: bool = True) -> DataFrame:
    """df's complete rows with each column replaced by what regressions on ``on`` by group leave of it."""
    rows = df.dropna(subset=[*columns, *on])
    for c in columns:
        fits = solve(gram(rows, keys, c, on), keys, intercept).select(*keys, F.col("b").alias("_b"))
        fitted = sum((F.col(x).cast("double") * F.get("_b", F.lit(i + intercept)) for i, x in enumerate(on)), F.get("_b", F.lit(0)) if intercept else F.lit(0.0))
        rows = rows.join(fits, keys).withColumn(f"_r_{c}", F.col(c) - fitted).drop("_b")
    return rows.select(*[F.col(f"_r_{c}").alias(c) if c in columns else F.col(c) for c in df.columns])
