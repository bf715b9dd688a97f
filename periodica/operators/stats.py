"""Stationarity tests, autocorrelation and differencing per series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from periodica.operators.lag_products import unpack
from periodica.operators.panel import series_arrays

MAX_D = 2
ALPHA = 0.05
#: Values of one stacked transform.
ACF_VALUES = 1 << 20

# KPSS level test (fixed values): statistic and p-value.
KPSS_STAT = (0.347, 0.463, 0.574, 0.739)
KPSS_P = (0.10, 0.05, 0.025, 0.01)

# Dickey-Fuller test with constant and trend (fixed values): sample sizes, p-values, statistics.
DF_SIZES = (25, 50, 100, 250, 500, 100000)
DF_P = (0.01, 0.025, 0.05, 0.10, 0.90, 0.95, 0.975, 0.99)
DF_STAT = (
    (-4.38, -3.95, -3.60, -3.24, -1.14, -0.80, -0.50, -0.15),
    (-4.15, -3.80, -3.50, -3.18, -1.19, -0.87, -0.58, -0.24),
    (-4.04, -3.73, -3.45, -3.15, -1.22, -0.90, -0.62, -0.28),
    (-3.99, -3.69, -3.43, -3.13, -1.23, -0.92, -0.64, -0.31),
    (-3.98, -3.68, -3.42, -3.13, -1.24, -0.93, -0.65, -0.32),
    (-3.96, -3.66, -3.41, -3.12, -1.25, -0.94, -0.66, -0.33),
)


def difference(endog: DataFrame, d: int = 0, D: int = 0, m: int = 1) -> DataFrame:
    """``(1-B)^d (1-B^m)^D y``; rows without all their lags are dropped."""
    w = Window.partitionBy("series_id").orderBy("period_idx")
    out = endog.select("series_id", "period_idx", F.col("y").alias("z"))
    for step in [m] * D + [1] * d:
        out = out.withColumn("z", F.col("z") - F.lag("z", step).over(w))
    return out.filter(F.col("z").isNotNull())


def array_difference(y: Column, step: int = 1) -> Column:
    n = F.greatest(F.size(y) - step, F.lit(0))
    return F.zip_with(F.slice(y, 1 + step, n), F.slice(y, F.lit(1), n), lambda a, b: a - b)


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def kpss_columns(df: DataFrame, y: str = "y", out: str = "kpss") -> DataFrame:
    """Add the level-stationarity statistic of an array column."""
    n = F.greatest(F.size(y), F.lit(1))
    lags = F.floor(F.lit(3.0) * F.sqrt(n) / 13).cast("int")
    staged = df.withColumn("_e", _demean(y))
    fold = F.aggregate(
        "_e",
        F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("ss")),
        lambda a, e: F.struct((a["s"] + e).alias("s"), (a["ss"] + (a["s"] + e) * (a["s"] + e)).alias("ss")),
        lambda a: a["ss"],
    )
    own = _sum(F.transform("_e", lambda e: e * e))
    cross = _sum(
        F.transform(
            F.when(lags > 0, F.sequence(F.lit(1), F.greatest(lags, F.lit(1)))).otherwise(F.array().cast("array<int>")),
            lambda i: (F.lit(1.0) - i / (lags + 1))
            * _sum(
                F.zip_with(
                    F.slice("_e", i + 1, n - i), F.slice("_e", F.lit(1), n - i), lambda a, b: a * b
                )
            ),
        )
    )
    s2 = own / n + F.lit(2.0) / n * cross
    eta = fold / n / n
    return staged.withColumn(out, F.when(s2 > 0, eta / s2)).drop("_e")


def _demean(y: str) -> Column:
    mean = _sum(F.col(y)) / F.greatest(F.size(y), F.lit(1))
    return F.transform(y, lambda v: v - mean)


def interpolate(x: Column, xs: tuple[float, ...], ys: tuple[float, ...]) -> Column:
    """Piecewise linear interpolation, clamped at both ends."""
    out = F.lit(float(ys[-1]))
    for (x0, x1), (y0, y1) in reversed(list(zip(zip(xs, xs[1:]), zip(ys, ys[1:])))):
        out = F.when(x < x1, F.lit(y0) + (x - x0) * ((y1 - y0) / (x1 - x0))).otherwise(out)
    return F.when(x.isNull(), None).when(x <= xs[0], F.lit(float(ys[0]))).otherwise(out)


def kpss_stat(endog: DataFrame) -> DataFrame:
    """``(series_id, n, kpss, p_value)``."""
    stat = kpss_columns(series_arrays(endog))
    return stat.select("series_id", "n", "kpss", interpolate(F.col("kpss"), KPSS_STAT, KPSS_P).alias("p_value"))


def _ndiffs(constant: list[Column], more: list[Column], known: list[Column]) -> Column:
    """Difference while the test asks for it, at most twice; a constant series needs no more.

    A statistic that cannot be computed ends the search at the last order it could be.
    """
    out = F.lit(MAX_D)
    for d in range(MAX_D - 1, -1, -1):
        deeper = out if d + 1 == MAX_D else F.when(~known[d + 1], F.lit(d)).otherwise(out)
        deeper = F.when(constant[d + 1], F.lit(d + 1)).otherwise(deeper)
        out = F.when(more[d], deeper).otherwise(F.lit(d))
    out = F.when(~known[0], F.lit(0)).otherwise(out)
    return F.when(constant[0], F.lit(0)).otherwise(out)


def _constant(y: str) -> Column:
    return F.coalesce(F.array_max(y) == F.array_min(y), F.lit(True))


def ndiffs_of_arrays(arrays: DataFrame) -> DataFrame:
    """Add ``ndiffs`` (KPSS test) to rows with an array column ``y``."""
    df = arrays.withColumn("y0", F.col("y"))
    df = df.withColumn("y1", array_difference(F.col("y0"))).withColumn("y2", array_difference(F.col("y1")))
    for d in range(MAX_D):
        df = kpss_columns(df, f"y{d}", f"k{d}")
    more = [interpolate(F.col(f"k{d}"), KPSS_STAT, KPSS_P) < ALPHA for d in range(MAX_D)]
    known = [F.col(f"k{d}").isNotNull() for d in range(MAX_D)]
    const = [_constant(f"y{d}") for d in range(MAX_D + 1)]
    return df.withColumn("ndiffs", _ndiffs(const, more, known).cast("bigint")).drop("y0", "y1", "y2", "k0", "k1")


def kpss_ndiffs(endog: DataFrame) -> DataFrame:
    """Recommended differencing order by the KPSS test: ``(series_id, ndiffs)``."""
    return ndiffs_of_arrays(series_arrays(endog)).select("series_id", "ndiffs")


def adf_lags(n: Column) -> Column:
    """Lagged differences of the Dickey-Fuller regression for ``n`` observations."""
    return F.greatest(F.floor(F.pow(F.greatest(n - 1, F.lit(0)).cast("double"), F.lit(1 / 3)) + 1e-9), F.lit(0)).cast("int")


def _unit_root_solver(columns: int, level: int):
    """t statistic of column ``level`` from packed products, whose last column is the target; null where it has none.

    Columns are scaled to length one; ``used`` of them are not zero, and more rows than that are needed.
    """

    @F.pandas_udf("double")
    def solve(packed: pd.Series, rows: pd.Series, used: pd.Series) -> pd.Series:
        g = unpack(np.stack(packed.to_numpy()).astype(float), columns + 1)
        first = g[:, :1, :] / np.maximum(g[:, :1, :1], 1.0)  # the constant's means: taken out before anything is scaled
        g = g[:, 1:, 1:] - np.swapaxes(g[:, :1, 1:], 1, 2) @ first[:, :, 1:]
        a, b, total = g[:, :-1, :-1], g[:, :-1, -1], g[:, -1, -1]
        scale = np.sqrt(np.maximum(np.diagonal(a, axis1=1, axis2=2), 0.0))
        safe = np.where(scale > 0, scale, 1.0)
        values, vectors = np.linalg.eigh(a / (safe[:, :, None] * safe[:, None, :]))
        kept = values > 1e-11 * np.maximum(values[:, -1:], 1e-300)
        inverse = (vectors * np.where(kept, 1.0 / np.where(kept, values, 1.0), 0.0)[:, None, :]) @ np.swapaxes(vectors, 1, 2)
        inverse /= safe[:, :, None] * safe[:, None, :]
        coef = np.einsum("bij,bj->bi", inverse, b)
        free = rows.to_numpy() - used.to_numpy()
        left = np.maximum(total - (coef * b).sum(axis=1), 0.0)
        at = level - 1
        var = inverse[:, at, at] * left / np.where(free > 0, free, 1)
        good = (free > 0) & (kept.sum(axis=1) + 1 == used.to_numpy()) & (var > 0) & (left > 1e-13 * np.maximum(total, 1e-300))
        return pd.Series(np.where(good, coef[:, at] / np.sqrt(np.where(good, var, 1.0)), np.nan)).where(good, None)

    return solve.asNondeterministic()


def adf_stat(endog: DataFrame, most_lags: int) -> DataFrame:
    """``(series_id, n, stat)``: t statistic of the lagged level in the Dickey-Fuller regression with constant and trend.

    ``most_lags`` is the number of lagged differences of the longest series; a shorter one has the columns beyond its own
    number set to zero. Products are summed by Spark, one small matrix per series is solved.
    """
    whole = Window.partitionBy("series_id")
    run = whole.orderBy("period_idx")
    rows = endog.select("series_id", "period_idx", F.count("*").over(whole).alias("n"), (F.col("y") - F.avg("y").over(whole)).alias("y"), F.row_number().over(run).alias("t"))
    rows = rows.select("series_id", "n", "t", adf_lags(F.col("n")).alias("k"), F.lag("y").over(run).alias("level"), (F.col("y") - F.lag("y").over(run)).alias("dy"), "period_idx")
    lagged = [F.when(F.col("k") >= i, F.lag("dy", i).over(run)).otherwise(F.lit(0.0)).alias(f"d{i}") for i in range(1, most_lags + 1)]
    rows = rows.select("series_id", "n", "t", "k", "level", "dy", *lagged)
    middle = F.col("t") - F.col("n") / 2
    columns = [F.lit(1.0), middle, F.col("level"), *[F.col(f"d{i}") for i in range(1, most_lags + 1)], F.col("dy")]
    packed = F.array(*[F.sum(columns[i] * columns[j]) for i in range(len(columns)) for j in range(i, len(columns))])
    found = rows.filter(F.col("t") > F.col("k") + 1).groupBy("series_id").agg(F.first("n").alias("n"), F.first("k").alias("k"), F.count("*").alias("rows"), packed.alias("gram"))
    stat = _unit_root_solver(len(columns) - 1, 2)("gram", "rows", F.col("k") + 3)
    return found.select("series_id", "n", stat.alias("stat"))


def adf_p_value(stat: Column, n: Column) -> Column:
    """p-value interpolated over the sample size, then over the statistic, clamped at the ends of the table."""
    size = (n - 1).cast("double")
    at = [interpolate(size, tuple(float(v) for v in DF_SIZES), column) for column in zip(*DF_STAT)]
    out = F.lit(DF_P[-1])
    for j in reversed(range(len(DF_P) - 1)):
        share = (stat - at[j]) / (at[j + 1] - at[j])
        out = F.when(stat < at[j + 1], DF_P[j] + share * (DF_P[j + 1] - DF_P[j])).otherwise(out)
    return F.when(stat.isNotNull(), F.when(stat <= at[0], F.lit(DF_P[0])).otherwise(out))


def adf_ndiffs(endog: DataFrame) -> DataFrame:
    """Recommended differencing order by the augmented Dickey-Fuller test.

    ``(series_id, adf_stat, p_value, ndiffs)``; statistic and p-value are those of
    the undifferenced series.
    """
    longest = endog.groupBy("series_id").agg(F.count("*").alias("n")).agg(F.max(adf_lags(F.col("n")))).first()[0] or 0
    out = endog.groupBy("series_id").agg(F.count("*").alias("n"))
    for d in range(MAX_D + 1):
        level = difference(endog, d).withColumnRenamed("z", "y")
        flat = level.groupBy("series_id").agg((F.min("y") == F.max("y")).alias(f"flat{d}"))
        out = out.join(flat, "series_id", "left")
        if d < MAX_D:
            tested = adf_stat(level, longest).select("series_id", F.col("stat").alias(f"stat{d}"), adf_p_value(F.col("stat"), F.col("n")).alias(f"p{d}"))
            out = out.join(tested, "series_id", "left")
    p = [F.col(f"p{d}") for d in range(MAX_D)]
    const = [F.coalesce(f"flat{d}", F.lit(True)) for d in range(MAX_D + 1)]
    return out.select(
        "series_id", F.col("stat0").alias("adf_stat"), F.col("p0").alias("p_value"),
        _ndiffs(const, [F.coalesce(c > ALPHA, F.lit(False)) for c in p], [c.isNotNull() for c in p]).cast("bigint").alias("ndiffs"),
    )


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _acf(y: pd.Series) -> pd.Series:
    """Autocorrelations at lags 1..n; series of one length share a transform."""
    out = np.empty(len(y), dtype=object)
    for n, rows in y.groupby(y.map(len)).indices.items():
        step = max(1, ACF_VALUES // n)
        for lo in range(0, len(rows), step):
            mine = rows[lo : lo + step]
            e = np.stack(y.to_numpy()[mine]).astype(float)
            e -= e.mean(axis=1, keepdims=True)
            size = 1 << (2 * int(n) - 1).bit_length()
            f = np.fft.rfft(e, size, axis=1)
            c = np.fft.irfft(f * np.conj(f), size, axis=1)[:, : n + 1]
            c[:, n:] = 0.0
            flat = np.einsum("bn,bn->b", e, e) <= 0
            r = c[:, 1:] / np.where(flat, np.nan, c[:, 0])[:, None]
            for i, row in zip(mine, r, strict=True):
                out[i] = row
    return pd.Series(out)


# inferred filters must not evaluate a transform or a test a second time
_acf = _acf.asNondeterministic()


def autocorrelation(endog: DataFrame, max_lag: int | None = None) -> DataFrame:
    """``(series_id, lag, r, band95, band99)`` for lags ``1..n`` (or ``max_lag``).

    All lags of a series come from one transform in ``n log n``, so no pair of
    rows of a series is ever materialised.
    """
    out = (
        series_arrays(endog)
        .withColumn("_r", _acf("y"))
        .select("series_id", "n", F.posexplode("_r").alias("pos", "r"))
        .withColumn("lag", (F.col("pos") + 1).cast("bigint"))
    )
    if max_lag is not None:
        out = out.filter(F.col("lag") <= max_lag)
    # two-sided normal quantiles at 95 % and 99 % (fixed values)
    z95, z99 = 1.959963984540054, 2.5758293035489004
    return out.select(
        "series_id", "lag", "r", (z95 / F.sqrt("n")).alias("band95"), (z99 / F.sqrt("n")).alias("band99")
    )
