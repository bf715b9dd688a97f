"""Order selection: exhaustive by back-test error, automatic by information criterion."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from periodica.functions.css import Order
from periodica.operators.align import PanelDataset
from periodica.operators.backtest import calc_rmse
from periodica.operators.fit import require_specified
from periodica.operators.lag_products import LagProduct, unpack
from periodica.operators.moments import MAX_COLUMNS, ORDERS_PER_PLAN, difference_weights, on_moments, rolling_orders
from periodica.operators.orders import (
    AUTO_MAX_PQ,
    AUTO_MAX_SEASONAL,
    AUTO_MAX_TOTAL,
    ORDER_COLS,
    ORDER_SCHEMA,
    TREND_TERMS,
    auto_grid,
    auto_ranges,
    order_grid,
    overspecified,
    repeated_lags,
    repeats,
    total_order,
)
from periodica.operators.panel import dataset_arrays, series_arrays
from periodica.operators.stats import array_difference, ndiffs_of_arrays
from periodica.operators.units import information_udf, rolling_udf, series_units, unit_columns
from periodica.session import materialize

TRAINING_SHARE = 0.8
MAX_D = 2
MAX_SEASONAL_D = 1


def training_window(n: Column) -> Column:
    """``min(max(ceil(0.8 n), 1), n - 1)`` rows."""
    return F.least(F.greatest(F.ceil(F.lit(TRAINING_SHARE) * n), F.lit(1)), n - 1).cast("int")


def minimum_rows(ranges: Sequence[range], n_exog: int) -> int:
    """Rows below which every order of the grid is over-specified."""
    smallest = sum(ranges[i].start for i in (0, 2, 3, 5))
    return smallest + TREND_TERMS + n_exog + 1 + 1


def require_searchable(ds: PanelDataset, ranges: Sequence[range], on_invalid: str) -> PanelDataset:
    """Decide on counts alone, before any order is unfolded or fitted."""
    if any(len(r) == 0 for r in ranges):
        raise ValueError("an order range is empty")
    return require_specified(ds, minimum_rows(ranges, 0), on_invalid)


def _listed(ranges: Sequence[range], n_exog: int, trend: str) -> list[tuple[int, Order]]:
    """Rank and order of every order of the grid that sums of products answer, in grid order."""
    found = []
    for rank, (p, d, q, sp, sd, sq, m) in enumerate(itertools.product(*ranges)):
        if q == sq == 0 and m >= 2 and not repeated_lags((p, d, q), (sp, sd, sq, m)):
            order = Order(p, d, q, sp, sd, sq, m, trend)
            if on_moments(order, n_exog):
                found.append((rank, order))
    return found


def moment_scores(ds: PanelDataset, listed: Sequence[tuple[int, Order]]) -> DataFrame:
    """Back-test errors of orders without moving-average terms, ``ORDERS_PER_PLAN`` orders a job and table."""
    spark, nv = ds.df.sparkSession, len(ds.exog_vars)
    out = None
    for at in range(0, len(listed), ORDERS_PER_PLAN):
        part = listed[at : at + ORDERS_PER_PLAN]
        windows = rolling_orders(ds, [o for _, o in part], training_window(F.col("n")), [o.p + o.sp + TREND_TERMS + nv for _, o in part])
        scored = windows.groupBy("series_id", "o").agg(F.count("*").cast("int").alias("n_tests"), calc_rmse("prediction", "actual").alias("rmse"))
        rows = [(i, rank, *[getattr(o, c) for c in ORDER_COLS]) for i, (rank, o) in enumerate(part)]
        names = spark.createDataFrame(rows, f"o int, {ORDER_SCHEMA}")  # ORDERS_PER_PLAN rows
        found = scored.join(F.broadcast(names), "o").select("series_id", "order_id", *ORDER_COLS, "n_tests", "rmse")
        found = materialize(found) if len(listed) > ORDERS_PER_PLAN else found
        out = found if out is None else out.unionByName(found)
    return out


def brute_scores(
    ds: PanelDataset, ranges: Sequence[range], trend: str = "ct", on_invalid: str = "raise"
) -> DataFrame:
    """``(series_id, order_id, order columns, n_tests, rmse)`` of every valid order.

    Orders with repeated lags, or over-specified on the training window, are skipped. Orders without moving-average terms
    are scored by sums of products; the others, and windows that hold no complete row of an order's lags, by units.
    """
    ds = require_searchable(ds, ranges, on_invalid)
    nv = len(ds.exog_vars)
    listed = [] if ds.ragged else _listed(ranges, nv, trend)
    by_moments = moment_scores(ds, listed) if listed else None
    grid = order_grid(ds.df.sparkSession, ranges).filter((F.col("m") >= 2) & ~repeats())
    lags = (F.col("p") + 1) * (F.col("sp") + 1) - 1
    summed = (F.col("q") + F.col("sq") == 0) & (len(trend) + nv + lags * (1 + nv) <= MAX_COLUMNS) & F.lit(bool(listed))
    span = F.col("d") + F.col("m") * F.col("sd") + F.col("p") + F.col("m") * F.col("sp")
    if listed and all(len(r) == 1 and r.start == 0 for r in (ranges[2], ranges[5])):
        if len(listed) == grid.count():
            smallest = ds.realized.groupBy("series_id").agg(F.count("*").alias("n")).agg(F.min(training_window(F.col("n")))).first()[0]
            if smallest is None or smallest > max(o.lost + o.ar_span for _, o in listed):
                return by_moments
    units = series_units(ds, grid).withColumn("w", training_window(F.col("n")))
    valid = units.filter((F.col("w") >= 1) & ~overspecified("w", F.col("nx")) & (~summed | (F.col("w") <= span)))
    errors = F.zip_with("_p", F.slice("y", F.col("w") + 1, F.size("_p")), lambda a, b: (a - b) * (a - b))
    mse = F.aggregate(errors, F.lit(0.0), lambda s, v: s + v) / F.size("_p")
    scored = valid.withColumn("_p", rolling_udf(trend)(unit_columns("w"))).select(
        "series_id", "order_id", *ORDER_COLS, F.size("_p").alias("n_tests"), F.sqrt(mse).alias("rmse")
    )
    if by_moments is not None:
        scored = by_moments.unionByName(scored)
    return scored.filter(F.col("rmse").isNotNull() & ~F.isnan("rmse"))


def best_orders(scores: DataFrame, by: str = "rmse") -> DataFrame:
    """Smallest score per series; the first order of the grid wins ties."""
    pick = F.min_by(F.struct("order_id", *ORDER_COLS, by), F.struct(by, "order_id"))
    return scores.groupBy("series_id").agg(pick.alias("_b")).select("series_id", "_b.*")


def brute_search(ds: PanelDataset, ranges: Sequence[range], trend: str = "ct", on_invalid: str = "raise") -> DataFrame:
    """Best order per series by back-test error."""
    best = best_orders(brute_scores(ds, ranges, trend, on_invalid))
    if on_invalid == "raise":
        grid = order_grid(ds.df.sparkSession, ranges).filter((F.col("m") >= 2) & ~repeats())
        if grid.limit(1).count() == 0:
            raise ValueError("every order of the grid repeats an ordinary as a seasonal lag")
    return best


# --- automatic -----------------------------------------------------------------------------


def _ocsb(m: int):
    """Statistic of the seasonal unit-root regression, lag order (1..3) by AIC."""

    def regress(target: np.ndarray, cols: list[np.ndarray]):
        a = np.column_stack(cols)
        coef, _, rank, _ = np.linalg.lstsq(a, target, rcond=None)
        r = target - a @ coef
        return a, coef, r, rank

    def one(v) -> float:
        y = np.asarray(v, dtype=float)
        best = (np.inf, np.nan)
        for lag in (1, 2, 3):
            if len(y) < 2 * m + lag + 6:
                continue
            seasonal, plain = y[m:] - y[:-m], np.diff(y)
            both = np.diff(seasonal)  # both[i] belongs to row i + m + 1
            rows = np.arange(lag, len(both))
            lags = [both[rows - i] for i in range(1, lag + 1)]
            _, ar, _, _ = regress(both[rows], lags)
            s = seasonal.copy()
            s[lag:] -= sum(ar[i - 1] * seasonal[lag - i : len(seasonal) - i] for i in range(1, lag + 1))
            f = plain.copy()
            f[lag:] -= sum(ar[i - 1] * plain[lag - i : len(plain) - i] for i in range(1, lag + 1))
            # row t = i + m + 1: lagged seasonal s at t-1 -> index i, plain at t-m -> index i
            use = rows[rows >= 2 * lag]
            lags = [both[use - i] for i in range(1, lag + 1)]
            a, coef, r, rank = regress(both[use], [s[use], f[use], *lags])
            dof = len(use) - a.shape[1]
            if dof < 1 or rank < a.shape[1]:
                continue
            ssr = float(r @ r)
            aic = len(use) * np.log(ssr / len(use)) + 2 * a.shape[1] if ssr > 0 else -np.inf
            cov = np.linalg.pinv(a.T @ a) * (ssr / dof)
            if aic < best[0] and cov[1, 1] > 0:
                best = (aic, coef[1] / np.sqrt(cov[1, 1]))
        return best[1]

    @F.pandas_udf("double")
    def stat(y: pd.Series) -> pd.Series:
        return y.map(one)

    return stat.asNondeterministic()


def ocsb_critical(m: int) -> float:
    """Approximate 5 % critical value for season ``m`` (fixed coefficients)."""
    a = np.log(m) - 0.7656451
    return float(-0.2937411 * np.exp(-0.2850853 * a - 0.05983644 * a * a) - 1.652202)


def auto_differencing(ds: PanelDataset, m: int, d: int | None, D: int | None) -> DataFrame:
    """``(series_id, d, sd)``: given values, else the seasonal test, then the level test."""
    arr = series_arrays(ds.endogenous_data)
    if D is None:
        const = F.array_max("y") == F.array_min("y")
        need = F.coalesce(_ocsb(m)("y") > ocsb_critical(m), F.lit(False)) & ~const
        arr = arr.withColumn("sd", need.cast("int"))
    else:
        arr = arr.withColumn("sd", F.lit(D).cast("int"))
    if d is not None:
        return arr.select("series_id", F.lit(d).cast("int").alias("d"), "sd")
    base = F.col("y")
    for k in range(max(D or 0, MAX_SEASONAL_D)):
        base = F.when(F.col("sd") > k, array_difference(base, m)).otherwise(base)
    return ndiffs_of_arrays(arr.select("series_id", "sd", base.alias("y"))).select(
        "series_id", F.col("ndiffs").cast("int").alias("d"), "sd"
    )


def auto_products(ds: PanelDataset, m: int, differencing: DataFrame, trend: str) -> tuple[DataFrame, list[int]]:
    """One packed Gram matrix per series for all autoregressive candidates, and the lags it holds.

    Columns are the trend, the lags and z of the series differenced as ``differencing`` (series_id, d, sd) says; a lag before
    the first row is the mean. Every row that differencing leaves counts, for every candidate alike.
    """
    lags = sorted({i + m * j for i in range(AUTO_MAX_PQ + 1) for j in range(AUTO_MAX_SEASONAL + 1) if i + j <= AUTO_MAX_TOTAL} - {0})
    whole = Window.partitionBy("series_id")
    run = whole.orderBy("period_idx")
    choices = [(d, sd) for d in range(MAX_D + 1) for sd in range(MAX_SEASONAL_D + 1)]
    weights = {c: difference_weights(Order(0, c[0], 0, 0, c[1], 0, m)) for c in choices}
    steps = sorted({j for w in weights.values() for j in w})
    rows = ds.realized.join(differencing, "series_id").select(
        "series_id", "period_idx", "d", "sd", (F.col("period_idx") - F.min("period_idx").over(whole) + 1).cast("double").alias("t"),
        *[F.lag("y", s).over(run).alias(f"_y{s}") for s in steps],
    )
    z = None
    for (d, sd), w in weights.items():
        value = sum((F.col(f"_y{j}") * c for j, c in w.items()), F.lit(0.0))
        mine = (F.col("d") == d) & (F.col("sd") == sd)
        z = F.when(mine, value) if z is None else z.when(mine, value)
    rows = rows.select("series_id", "period_idx", "t", z.alias("z"))
    mean = F.avg("z").over(whole)
    level = mean if trend == "ct" else F.lit(0.0)  # with an intercept the level is free: taken out for more digits
    rows = rows.select("series_id", "t", (F.col("z") - level).alias("z"), *[(F.coalesce(F.lag("z", s).over(run), mean) - level).alias(f"_l{s}") for s in lags])
    columns = [*([F.lit(1.0)] if trend == "ct" else []), F.col("t"), *[F.col(f"_l{s}") for s in lags], F.col("z")]
    upper = [F.sum(columns[i] * columns[j]) for i in range(len(columns)) for j in range(i, len(columns))]
    grams = rows.filter(F.col("z").isNotNull()).groupBy("series_id").agg(F.count("*").alias("n_eff"), F.array(*upper).alias("gram"))
    return grams.join(differencing, "series_id"), lags


def auto_moment_scores(ds: PanelDataset, m: int, differencing: DataFrame, trend: str) -> DataFrame:
    """``(series_id, order_id, order columns, sse, n_eff)`` of the autoregressive candidates, all from one matrix a series."""
    grams, lags = auto_products(ds, m, differencing, trend)
    ranges = auto_ranges(m)
    orders = [(rank, o) for rank, o in _listed(ranges, 0, trend) if o.p + o.sp <= AUTO_MAX_TOTAL]
    g, width = len(trend), len(trend) + len(lags) + 1
    column = {lag: g + i for i, lag in enumerate(lags)}

    @F.pandas_udf("array<double>")
    def solve(packed: pd.Series) -> pd.Series:
        grams = unpack(np.stack(packed.to_numpy()).astype(float), width)
        found = []
        for _, o in orders:
            own = LagProduct(o, 0)
            keep = [*range(g), *[column[lag] for lag in own.lags], width - 1]
            found.append(own.solve(grams[:, keep][:, :, keep]).sse)
        return pd.Series(list(np.stack(found, axis=1)))

    numbered = F.array(*[F.struct(F.lit(rank).cast("bigint").alias("order_id"), F.lit(o.p).alias("p"), F.lit(o.sp).alias("sp")) for rank, o in orders])
    solved = grams.withColumn("_sse", solve.asNondeterministic()("gram"))
    each = solved.select("series_id", "d", "sd", "n_eff", F.explode(F.arrays_zip(numbered.alias("o"), F.col("_sse").alias("sse"))).alias("_e"))
    return each.select(
        "series_id", "_e.o.order_id", "_e.o.p", "d", F.lit(0).alias("q"), "_e.o.sp", "sd", F.lit(0).alias("sq"), F.lit(m).alias("m"), "_e.sse", "n_eff"
    )


def auto_scores(
    ds: PanelDataset, m: int, d: int | None, D: int | None, trend: str = "t"
) -> DataFrame:
    """Every candidate of the automatic grid with its AIC, or with the reason why it has none.

    All candidates of a series are scored on the same rows: all that differencing leaves, started from their mean.
    Without variables the autoregressive ones share one Gram matrix; the others are fitted as units. A candidate is left
    out as ``overspecified`` unless it has more rows than parameters (the one without lag terms is always tried), and as
    ``not estimable`` where the fit has no finite sum of squares.
    """
    differencing = materialize(auto_differencing(ds, m, d, D))
    grid = auto_grid(ds.df.sparkSession, m)
    shared = not ds.exog_vars and (d is None or d <= MAX_D) and (D is None or D <= MAX_SEASONAL_D)
    if shared:
        grid = grid.filter(F.col("q") + F.col("sq") > 0)
    units = series_units(ds, grid, differencing)
    units = units.withColumn("_s", information_udf(trend)(unit_columns())).select(
        "series_id", "order_id", *ORDER_COLS, "nx", "_s.sse", "_s.n_eff"
    )
    if shared:
        units = auto_moment_scores(ds, m, differencing, trend).withColumn("nx", F.lit(0)).unionByName(units)
    params = total_order() + F.col("nx") + TREND_TERMS + 1
    n = F.col("n_eff")
    reason = F.when((n < 1) | (params >= n) & (total_order() > 0), "overspecified").when(
        F.col("sse").isNull() | F.isnan("sse"), "not estimable"
    )
    tiny = F.greatest(F.col("sse"), F.lit(1e-300))
    llf = -n / 2 * (F.log(F.lit(2 * float(np.pi)) * tiny / n) + 1)
    return units.select("series_id", "order_id", *ORDER_COLS, params.alias("n_params"), "sse", "n_eff", reason.alias("reason")).withColumn(
        "aic", F.when(F.col("reason").isNull(), 2 * F.col("n_params") - 2 * llf)
    )


def auto_search(ds: PanelDataset, m: int = 4, d: int | None = None, D: int | None = None, trend: str = "t") -> DataFrame:
    """Best order per series by AIC."""
    return best_orders(auto_scores(ds, m, d, D, trend).filter("reason IS NULL"), "aic")


def units_of(ds: PanelDataset, orders: DataFrame) -> DataFrame:
    """Series arrays with their own order (one row per series in ``orders``)."""
    return dataset_arrays(ds.df).join(orders.select("series_id", "order_id", *ORDER_COLS), "series_id")
