"""Moving-average terms in two passes of least squares, without a recursion over the rows.

First pass: a long autoregression, whose residuals stand in for the unknown errors. Second pass: the model's own lags of z and
x beside lagged residuals, again from summed products; products of lag polynomials are solved on the same Gram matrix. Rows
are lagged by windows, products summed by aggregation, and only the small matrices reach numpy. The estimator is consistent;
on short series it lies further from the likelihood optimum than the iterated conditional fit of ``functions.css``.

A series needs ``rows_needed`` observations: enough for the long lags, the lagged residuals and more rows than parameters.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from periodica.functions.css import Order
from periodica.operators.align import PanelDataset
from periodica.operators.lag_products import LagProduct, error_lags, product_lags, scaled_pinv, unpack
from periodica.operators.moments import centered, difference_weights, fitted, lag_gain

#: Long lags when none are given: this many spans of the model, within these bounds.
LONG_SPANS, LEAST_LONG, MOST_LONG = 2, 4, 24


def long_lags(order: Order) -> int:
    span = max([0, *product_lags(order), *error_lags(order)])
    return max(LEAST_LONG, min(LONG_SPANS * span, MOST_LONG), span)


def rows_needed(order: Order, n_exog: int, long: int) -> int:
    first = order.lost + long + order.trend_cols + n_exog + long
    second = order.lost + max(long + max([0, *error_lags(order)]), order.ar_span) + LagProduct(order, n_exog).width + order.trend_cols
    return max(first, second) + 1


def lagged_rows(ds: PanelDataset, order: Order, long: int) -> DataFrame:
    """Realized rows with differenced z and x, their lags, and the regressors ``first`` of the long autoregression."""
    nv, weights = len(ds.exog_vars), difference_weights(order)
    lags = sorted({*range(1, long + 1), *product_lags(order)})
    whole = Window.partitionBy("series_id")
    run = whole.orderBy("period_idx")
    rows = ds.realized.select(
        "series_id", "period_idx", F.count("*").over(whole).alias("n"),
        (F.col("period_idx") - F.min("period_idx").over(whole) + 1).cast("double").alias("t"),
        (F.avg("y").over(whole) if centered(order) else F.lit(0.0)).alias("y_mean"),
        "y", *[F.get("x", F.lit(i)).alias(f"_x{i}") for i in range(nv)],
    )

    def differenced(name: str) -> Column:
        return sum((F.lag(name, j).over(run) * c if j else F.col(name) * c for j, c in weights.items()), F.lit(0.0))

    rows = rows.withColumn("y", F.col("y") - F.col("y_mean"))
    rows = rows.select("series_id", "period_idx", "n", "t", "y_mean", differenced("y").alias("z"), *[differenced(f"_x{i}").alias(f"_x{i}") for i in range(nv)])
    rows = rows.select(
        "*", *[F.lag("z", s).over(run).alias(f"_z{s}") for s in lags],
        *[F.lag(f"_x{i}", s).over(run).alias(f"_x{i}_{s}") for s in product_lags(order) for i in range(nv)],
    )
    trend = [F.lit(1.0), F.col("t")] if order.trend == "ct" else [F.col("t")]
    x = [F.col(f"_x{i}") for i in range(nv)]
    return rows.withColumn("first", F.when(F.col("t") > order.lost + long, F.array(*trend, *x, *[F.col(f"_z{s}") for s in range(1, long + 1)])))


def packed_products(vector: str, width: int) -> Column:
    c = [F.get(vector, F.lit(i)) for i in range(width)] + [F.col("z")]
    return F.array(*[F.sum(c[i] * c[j]) for i in range(width + 1) for j in range(i, width + 1)])


def least_squares(width: int):
    @F.pandas_udf("array<double>")
    def solve(packed: pd.Series) -> pd.Series:
        g = unpack(np.stack(packed.to_numpy()).astype(float), width + 1)
        return pd.Series(np.einsum("bij,bj->bi", scaled_pinv(g[:, :width, :width], 1e-11), g[:, :width, width]).tolist())

    return solve.asNondeterministic()


def error_rows(ds: PanelDataset, order: Order, long: int) -> DataFrame:
    """Rows of the second pass: ``(series_id, period_idx, n, y_mean, z, v)``, v ending in lagged residuals of the first."""
    nv = len(ds.exog_vars)
    rows = lagged_rows(ds, order, long)
    width = order.trend_cols + nv + long
    first = rows.filter("first IS NOT NULL").groupBy("series_id").agg(packed_products("first", width).alias("_g"))
    first = first.select("series_id", least_squares(width)("_g").alias("_c"))
    run = Window.partitionBy("series_id").orderBy("period_idx")
    rows = rows.join(first, "series_id").withColumn("_e", F.col("z") - fitted(F.col("first"), F.col("_c")))
    shocks = error_lags(order)
    rows = rows.select("*", *[F.lag("_e", s).over(run).alias(f"_e{s}") for s in shocks])
    trend = [F.lit(1.0), F.col("t")] if order.trend == "ct" else [F.col("t")]
    v = trend + [F.col(f"_x{i}") for i in range(nv)] + [F.col(f"_z{s}") for s in product_lags(order)]
    v += [F.col(f"_x{i}_{s}") for s in product_lags(order) for i in range(nv)] + [F.col(f"_e{s}") for s in shocks]
    start = order.lost + max(long + max([0, *shocks]), order.ar_span)
    return rows.filter(F.col("t") > start).select("series_id", "period_idx", "n", "y_mean", "z", F.array(*v).alias("v"))


def two_stage_fit(ds: PanelDataset, order: Order, long: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Estimates ``(series_id, n, n_eff, sse, adjusted, converged, est, se)`` and residuals ``(series_id, period_idx, resid)``.

    Every series must have :func:`rows_needed` rows. Standard errors are robust and take the residuals of the first pass as given.
    """
    long = long_lags(order) if long is None else long
    nv = len(ds.exog_vars)
    model = LagProduct(order, nv)
    g, k = order.trend_cols, order.trend_cols + model.width
    rows = error_rows(ds, order, long)

    @F.pandas_udf("par array<double>, coef array<double>, sse double, adjusted boolean, converged boolean")
    def solve(packed: pd.Series) -> pd.DataFrame:
        s = model.solve(unpack(np.stack(packed.to_numpy()).astype(float), k + 1))
        return pd.DataFrame({"par": s.par.tolist(), "coef": s.coef.tolist(), "sse": s.sse, "adjusted": s.adjusted, "converged": s.converged})

    grams = rows.groupBy("series_id").agg(F.first("n").alias("n"), F.count("*").alias("n_eff"), F.first("y_mean").alias("y_mean"), packed_products("v", k).alias("gram"))
    fits = grams.withColumn("_s", solve.asNondeterministic()("gram")).select("series_id", "n", "n_eff", "y_mean", "gram", "_s.*")
    residuals = rows.join(fits.select("series_id", "coef"), "series_id").select(
        "series_id", "period_idx", "v", (F.col("z") - fitted(F.col("v"), F.col("coef"))).alias("resid")
    )
    v, e2 = [F.get("v", F.lit(i)) for i in range(k)], F.col("resid") * F.col("resid")
    meat = residuals.groupBy("series_id").agg(F.array(*[F.sum(e2 * v[i] * v[j]) for i in range(k) for j in range(i, k)]).alias("meat"))
    shift = centered(order)

    @F.pandas_udf("array<double>")
    def errors(gram: pd.Series, meat: pd.Series, par: pd.Series, y_mean: pd.Series) -> pd.Series:
        p = np.stack(par.to_numpy()).astype(float)
        d = model.jacobian(p)
        dt = np.swapaxes(d, 1, 2)
        bread = scaled_pinv(dt @ unpack(np.stack(gram.to_numpy()).astype(float), k + 1)[:, :k, :k] @ d, 1e-13)
        cov = bread @ (dt @ unpack(np.stack(meat.to_numpy()).astype(float), k) @ d) @ bread
        if shift:  # the intercept of the uncentred data moves with the autoregressive terms
            to_raw = np.tile(np.eye(d.shape[2]), (len(cov), 1, 1))
            by_lag = model.polynomial(p[:, g + nv :])[1].sum(axis=1)
            to_raw[:, 0, g + nv : g + nv + model.ar_terms] = -y_mean.to_numpy()[:, None] * by_lag
            cov = to_raw @ cov @ np.swapaxes(to_raw, 1, 2)
        return pd.Series(np.sqrt(np.maximum(np.diagonal(cov, axis1=1, axis2=2), 0.0)).tolist())

    est = F.col("par")
    if shift:
        gain = lag_gain(F.col("par"), order, nv)
        est = F.concat(F.array(F.col("par")[0] + F.col("y_mean") * gain), F.slice("par", 2, g + nv + model.terms - 1))
    out = fits.withColumn("est", est).join(meat, "series_id").withColumn("se", errors("gram", "meat", "par", "y_mean"))
    return out.select("series_id", "n", "n_eff", "sse", "adjusted", "converged", "est", "se"), residuals.select("series_id", "period_idx", "resid")


def long_enough(ds: PanelDataset, order: Order, long: int | None = None) -> tuple[PanelDataset, DataFrame]:
    """The series with enough rows for both passes, and ``(series_id, n, needed)`` of the others."""
    needed = rows_needed(order, len(ds.exog_vars), long_lags(order) if long is None else long)
    counts = ds.realized.groupBy("series_id").agg(F.count("*").alias("n"))
    short = counts.filter(F.col("n") < needed).withColumn("needed", F.lit(needed))
    n = F.count_if(~F.col("is_future")).over(Window.partitionBy("series_id"))
    kept = ds.df.withColumn("_n", n).filter(F.col("_n") >= needed).drop("_n")
    return replace(ds, df=kept), short
