"""Regression with autoregressive errors as repeated passes over the rows, for any number of variables.

One pass regresses the residuals ``u = z - x beta`` on their own lags, filters z and x by the polynomial found, and regresses
filtered z on filtered x, which gives the next beta. Each half needs only narrow matrices (trend and lags, then trend and
variables), where one Gram matrix of all lags of all variables would grow with their product. Rows with their lags are
written once, parameters once a pass; passes end when no series moves by more than ``TOLERANCE`` or after ``max_passes``.
What had not settled by then is returned with ``converged`` false and the size of its last move, not hidden.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from periodica.functions.css import Order
from periodica.operators.align import PanelDataset
from periodica.operators.lag_products import LagProduct, product_lags, unpack
from periodica.operators.moments import centered, fitted, lag_gain
from periodica.operators.two_stage import lagged_rows, least_squares
from periodica.session import materialize

MAX_PASSES = 10
TOLERANCE = 1e-6


def _dot(row: list[Column], weights: str) -> Column:
    return fitted(F.array(*row), F.col(weights)) if row else F.lit(0.0)


def _packed(columns: list[Column]) -> Column:
    n = len(columns)
    return F.array(*[F.sum(columns[i] * columns[j]) for i in range(n) for j in range(i, n)])


def iterated_fit(ds: PanelDataset, order: Order, max_passes: int = MAX_PASSES, tolerance: float = TOLERANCE) -> DataFrame:
    """``(series_id, n, n_eff, sse, est, adjusted, passes, move, converged)`` of an order with lags of y and variables.

    ``est`` stands in the order of ``Order.names``; ``move`` is the largest change of a coefficient in the last pass, relative
    to one plus its size.
    """
    lags, nv = product_lags(order), len(ds.exog_vars)
    if order.q + order.sq or not lags or not nv:
        raise ValueError("iteration needs lags of y and variables, and takes no moving-average terms")
    if max_passes < 1:
        raise ValueError("at least one pass is needed")
    model, g = LagProduct(order, 0), order.trend_cols
    rows = materialize(lagged_rows(ds, order, 0))
    start = order.lost + order.ar_span
    trend = [F.lit(1.0), F.col("t")] if order.trend == "ct" else [F.col("t")]
    x = [F.col(f"_x{i}") for i in range(nv)]
    past = {s: [F.col(f"_x{i}_{s}") for i in range(nv)] for s in lags}

    @F.pandas_udf("a array<double>, nl array<double>, adjusted boolean")
    def errors_polynomial(packed: pd.Series) -> pd.DataFrame:
        s = model.solve(unpack(np.stack(packed.to_numpy()).astype(float), g + model.width + 1))
        return pd.DataFrame({"a": s.coef[:, g:].tolist(), "nl": s.par[:, g:].tolist(), "adjusted": s.adjusted})

    def regressed(found: DataFrame, columns: list[Column]) -> DataFrame:
        summed = found.groupBy("series_id").agg(_packed(columns).alias("_g"))
        return summed.withColumn("_c", least_squares(len(columns) - 1)("_g"))

    def slopes(packed: DataFrame) -> DataFrame:
        return packed.select("series_id", F.slice("_c", 1, g).alias("level"), F.slice("_c", g + 1, nv).alias("beta"))

    state = materialize(slopes(regressed(rows.filter(F.col("t") > order.lost), [*trend, *x, F.col("z")])))
    for passes in range(1, max_passes + 1):
        met = rows.filter(F.col("t") > start).join(state.select("series_id", F.col("beta").alias("_b")), "series_id")
        u = [F.col(f"_z{s}") - _dot(past[s], "_b") for s in lags] + [F.col("z") - _dot(x, "_b")]
        lagged = met.groupBy("series_id").agg(_packed([*trend, *u]).alias("_g"))
        poly = materialize(lagged.withColumn("_p", errors_polynomial.asNondeterministic()("_g")).select("series_id", "_p.*"))
        met = rows.filter(F.col("t") > start).join(poly.select("series_id", F.col("a").alias("_a")), "series_id")

        def filtered(now: Column, then: list[Column]) -> Column:
            return now - _dot(then, "_a")

        flat = [filtered(x[i], [past[s][i] for s in lags]) for i in range(nv)]
        new = slopes(regressed(met, [*trend, *flat, filtered(F.col("z"), [F.col(f"_z{s}") for s in lags])]))
        old = state.select("series_id", F.col("beta").alias("_old"))
        change = F.zip_with("beta", "_old", lambda b, o: F.abs(b - o) / (1 + F.abs(o)))
        state = materialize(new.join(old, "series_id").withColumn("move", F.array_max(change)).drop("_old").join(poly, "series_id"))
        if (state.agg(F.max("move")).first()[0] or 0.0) <= tolerance:
            break
    met = rows.filter(F.col("t") > start).join(state, "series_id")
    resid = F.col("z") - _dot(x, "beta") - sum((F.get("a", F.lit(b)) * (F.col(f"_z{s}") - _dot(past[s], "beta")) for b, s in enumerate(lags)), F.lit(0.0))
    resid = resid - _dot(trend, "level")
    sums = met.groupBy("series_id").agg(F.first("n").alias("n"), F.first("y_mean").alias("y_mean"), F.count("*").alias("n_eff"), F.sum(resid * resid).alias("sse"))
    est = F.concat("level", "beta", "nl")
    if centered(order):  # variables keep their own level, only y's mean was taken out
        first = F.col("level")[0] + F.col("y_mean") * lag_gain(F.concat("level", "beta", "nl"), order, nv)
        est = F.concat(F.array(first), F.slice("level", 2, g), "beta", "nl")
    return sums.join(state, "series_id").select(
        "series_id", "n", "n_eff", "sse", est.alias("est"), "adjusted", F.lit(passes).alias("passes"), "move", (F.col("move") <= tolerance).alias("converged")
    )
