"""Tests and distributions, vectorised over distinct arguments; no table is collected.

Log-factorials come from one growing table. P-values agree with exact rationals to about 1e-11.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LOG_FACTORIAL = np.zeros(1)


def log_factorials(n: int) -> np.ndarray:
    """log k! for k = 0..n at least."""
    global _LOG_FACTORIAL
    if len(_LOG_FACTORIAL) <= n:
        size = max(n + 1, 2 * len(_LOG_FACTORIAL))
        _LOG_FACTORIAL = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, size, dtype=np.longdouble))))).astype(np.float64)
    return _LOG_FACTORIAL


#: probabilities, or comparisons, that are held at once
HELD = 4_000_000


def _parts(sizes: np.ndarray) -> Iterator[slice]:
    """Consecutive rows whose sizes sum up to HELD, one row at least."""
    total, at = np.concatenate(([0], np.cumsum(sizes))), 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(total, total[at] + HELD, "right")) - 1)
        yield slice(at, end)
        at = end


def _tables(q: np.ndarray, m: np.ndarray, n: np.ndarray, k: np.ndarray, reduce: Callable) -> np.ndarray:
    """For each row: the probabilities of all numbers of marked among k draws from m marked and n others, reduced with their row, themselves and the observed q."""
    q, m, n, k = (np.asarray(x, dtype=np.int64) for x in (q, m, n, k))
    low, size = np.maximum(0, k - n), np.minimum(m, k) - np.maximum(0, k - n) + 1
    f, out = log_factorials(int((m + n).max(initial=0))), np.empty(len(q))
    for part in _parts(size):
        length = size[part]
        row = np.repeat(np.arange(len(length)), length)
        i = np.arange(len(row)) + np.repeat(low[part] - (np.cumsum(length) - length), length)
        mm, nn, kk = m[part], n[part], k[part]
        fixed = f[mm] + f[nn] + f[kk] + f[mm + nn - kk] - f[mm + nn]
        p = np.exp(fixed[row] - f[i] - f[mm[row] - i] - f[kk[row] - i] - f[nn[row] - kk[row] + i])
        out[part] = reduce(row, i, p, q[part])
    return np.minimum(out, 1.0)


def mid_p(q: np.ndarray, m: np.ndarray, n: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Twice the smaller tail, of which the observed value counts half."""

    def tails(row, i, p, q):
        side = np.sign(i - q[row])
        above, below, at = (np.bincount(row, weights=np.where(side == s, p, 0.0), minlength=len(q)) for s in (1, -1, 0))
        return 2 * (np.minimum(above, below) + at / 2)

    return _tables(q, m, n, k, tails)


def fisher_exact(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Two-sided: the tables that are no likelier than the observed one, with a relative tolerance of 1e-7."""
    a, b, c, d = (np.asarray(x, dtype=np.int64) for x in (a, b, c, d))

    def no_likelier(row, i, p, q):
        seen = p[i == q[row]]
        return np.bincount(row, weights=np.where(p <= seen[row] * (1 + 1e-7), p, 0.0), minlength=len(q))

    return _tables(a, a + c, b + d, a + b, no_likelier)


def erfc(x: np.ndarray) -> np.ndarray:
    """Complementary error function of non-negative numbers: a series of positive terms below 2.5, a continued fraction from there."""
    x = np.asarray(x, dtype=np.float64)
    near = np.minimum(x, 2.5)
    term = total = 2 / math.sqrt(math.pi) * near * np.exp(-near * near)
    for j in range(1, 60):
        term = term * 2 * near * near / (2 * j + 1)
        total = total + term
    far, tail = np.maximum(x, 2.5), np.zeros_like(x)
    for j in range(120, 0, -1):
        tail = j / 2 / (far + tail)
    return np.where(x < 2.5, 1 - total, np.exp(-far * far) / math.sqrt(math.pi) / (far + tail))


@functools.lru_cache(10_000)
def _rank_sum_tails(nx: int, ny: int) -> np.ndarray:
    """Two-sided p-value of each value 0..nx*ny of the statistic without ties."""
    ways = np.zeros((nx + 1, nx * ny + 1))
    ways[0, 0] = 1
    for j in range(1, nx + ny + 1):  # ranks, each for x or for y
        for i in range(min(j, nx), 0, -1):
            shift = j - i
            if shift <= nx * ny:
                ways[i, shift:] += ways[i - 1, : nx * ny + 1 - shift]
    below = np.cumsum(ways[nx])
    tail = np.minimum(below, below[::-1])  # the distribution is symmetric
    return np.minimum(2 * tail / below[-1], 1.0)


def _rank_sums(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows of nx and ny values."""
    nx, ny = x.shape[1], y.shape[1]
    n, out = nx + ny, np.empty(len(x))
    for part in _parts(np.full(len(x), n * n)):
        both = np.concatenate((x[part], y[part]), axis=1)
        w = (x[part][:, :, None] > y[part][:, None, :]).sum(axis=(1, 2)) + (x[part][:, :, None] == y[part][:, None, :]).sum(axis=(1, 2)) / 2
        same = (both[:, :, None] == both[:, None, :]).sum(axis=2)
        ties = (same * same - 1).sum(axis=1)  # the sum of t^3 - t over groups of t equal values
        if nx < 50 and ny < 50:
            exact = _rank_sum_tails(nx, ny)[np.floor(w).astype(np.int64)]
        with np.errstate(divide="ignore", invalid="ignore"):
            sigma = np.sqrt(nx * ny / 12 * ((n + 1) - ties / (n * (n - 1))))
            off = np.maximum(np.abs(w - nx * ny / 2) - 0.5, 0) * (w != nx * ny / 2)
            normal = np.where(sigma > 0, np.minimum(erfc(np.where(sigma > 0, off / sigma, 0) / math.sqrt(2)), 1.0), np.nan)
        out[part] = np.where(ties == 0, exact, normal) if nx < 50 and ny < 50 else normal
    return out


def rank_sum(x: Sequence[Sequence[float]], y: Sequence[Sequence[float]]) -> np.ndarray:
    """Two-sided Wilcoxon rank-sum tests, row by row: exact below 50 values without ties, else normal with tie and continuity corrections; NaN where a side is empty or all values are equal.

    Rows of the same numbers of finite values are tested together.
    """
    sides = []
    for values in (x, y):
        size = np.array([len(v) for v in values], dtype=np.int64)
        flat = np.concatenate([np.empty(0), *[np.asarray(v, dtype=np.float64) for v in values]])
        row, good = np.repeat(np.arange(len(size)), size), np.isfinite(flat)
        size = np.bincount(row[good], minlength=len(size))
        sides.append((flat[good], size, np.cumsum(size) - size))
    out = np.full(len(sides[0][1]), np.nan)
    shapes, which = np.unique(np.stack([sides[0][1], sides[1][1]]), axis=1, return_inverse=True)
    for j, (nx, ny) in enumerate(shapes.T.tolist()):
        if nx and ny:
            rows = np.flatnonzero(which.ravel() == j)
            u, v = (flat[first[rows][:, None] + np.arange(k)] for (flat, _, first), k in zip(sides, (nx, ny), strict=True))
            out[rows] = _rank_sums(u, v)
    return out


def _columnwise(fn: Callable[..., np.ndarray], *cols: Column) -> Column:
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(fn(*(s.to_numpy() for s in batch)), dtype="float64")

    kinds = {2: Iterator[tuple[pd.Series, pd.Series]], 4: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]}
    run.__annotations__ = {"batches": kinds[len(cols)], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")(*cols)


def mid_p_column(q: Column, m: Column, n: Column, k: Column) -> Column:
    return _columnwise(mid_p, q, m, n, k)


def fisher_column(a: Column, b: Column, c: Column, d: Column) -> Column:
    return _columnwise(fisher_exact, a, b, c, d)


def rank_sum_column(x: Column, y: Column) -> Column:
    """Null where a side has no values."""
    p = _columnwise(rank_sum, x, y)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), p)


def g_test_column(mod_case: Column, un_case: Column, mod_control: Column, un_control: Column) -> Column:
    """Likelihood-ratio test of a binomial model with two groups, one degree of freedom, in native expressions but for erfc."""
    cells = [mod_case, un_case, mod_control, un_control]
    total = mod_case + un_case + mod_control + un_control
    rows, cols = (mod_case + un_case, mod_control + un_control), (mod_case + mod_control, un_case + un_control)
    g = F.lit(0.0)
    for i, c in enumerate(cells):
        g = g + F.when(c > 0, 2 * c * F.log(c * total / (rows[i // 2] * cols[i % 2]))).otherwise(0.0)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(erfc(np.sqrt(np.maximum(s.to_numpy(dtype="float64", na_value=np.nan), 0) / 2)))

    some = (rows[0] > 0) & (rows[1] > 0)
    return F.when(some, F.pandas_udf(run, "double")(F.when(some, g)))


#: rows whose p-values one task may order
ONE_TASK = 1_000_000


def _bh_global(distinct: DataFrame, out: str) -> DataFrame:
    up = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.orderBy(F.desc("__p")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = distinct.withColumn("__q", F.col("__p") * F.sum("__n").over(Window.partitionBy()) / F.sum("__n").over(up))
    return ranked.select("__p", F.least(F.lit(1.0), F.min("__q").over(down)).alias(out))


def _bh_bucketed(distinct: DataFrame, out: str) -> DataFrame:
    bucket = F.when(F.col("__p") <= 0, 40_000).otherwise(F.least(F.floor(-F.log10("__p") * 100), F.lit(39_999))).cast("int")
    distinct = distinct.withColumn("__b", bucket)
    up = Window.orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    sums = distinct.groupBy("__b").agg(F.sum("__n").alias("__bn")).withColumn("__before", F.coalesce(F.sum("__bn").over(up), F.lit(0))).withColumn("__total", F.sum("__bn").over(Window.partitionBy()))
    inside = Window.partitionBy("__b").orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)
    ranked = distinct.join(F.broadcast(sums.drop("__bn")), "__b").withColumn("__q", F.col("__p") * F.col("__total") / (F.col("__before") + F.sum("__n").over(inside)))
    above = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    least = ranked.groupBy("__b").agg(F.min("__q").alias("__m")).withColumn("__above", F.min("__m").over(above)).drop("__m")
    down = Window.partitionBy("__b").orderBy(F.desc("__p")).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.join(F.broadcast(least), "__b").select("__p", F.least(F.lit(1.0), F.min("__q").over(down), F.col("__above")).alias(out))


def bh_adjust(df: DataFrame, p_col: str = "p_val", out: str = "p_adjust", weight: str | None = None) -> DataFrame:
    """Benjamini-Hochberg adjustment over all rows, each standing for weight tests; null and NaN stay null and are not counted.

    df is read three times: write it first if it is dear. Works on distinct p-values with their counts. Those of up to ONE_TASK
    rows are ordered in one task; more are ranked inside buckets of -log10(p), whose sums and minima (at most 40,001 rows) are joined back.
    """
    p = F.col(p_col)
    valid = p.isNotNull() & ~F.isnan(p)
    distinct = df.where(valid).groupBy(p.alias("__p")).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("__n"))
    adjusted = _bh_bucketed(distinct, out) if df.count() > ONE_TASK else _bh_global(distinct, out)
    return df.drop(out).join(adjusted, F.when(valid, p) == F.col("__p"), "left").drop("__p")
