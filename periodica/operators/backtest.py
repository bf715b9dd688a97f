"""Sliding-window back-tests: every window refits and forecasts one step."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from periodica.functions.css import Order
from periodica.operators.align import PanelDataset
from periodica.operators.fit import one_order_units, require_specified, required_rows, split_by_rows
from periodica.operators.moments import linear_rolling, on_moments
from periodica.operators.units import rolling_udf, unit_columns


def window_length(
    n: Column, window_size: float | None = None, window_rows: int | None = None, window_frac: float | None = None
) -> Column:
    """Training rows: a size up to 1 is a share (rounded up, at least one row), above 1 a count."""
    given = [v for v in (window_size, window_rows, window_frac) if v is not None]
    if len(given) != 1:
        raise ValueError("give exactly one of window_size, window_rows and window_frac")
    if window_size is not None:
        if window_size <= 1:
            window_frac = window_size
        else:
            window_rows = int(window_size)
    if window_rows is not None:
        if window_rows <= 0:
            raise AssertionError("window size must be > 0")
        return F.lit(window_rows)
    if not 0 < window_frac <= 1:
        raise AssertionError("window share must be above 0 and at most 1")
    return F.greatest(F.ceil(F.lit(float(window_frac)) * n).cast("int"), F.lit(1))


def check_window_fits(ds: PanelDataset, rows: int) -> None:
    """A window may not be longer than any series."""
    counts = ds.realized.groupBy("series_id").agg(F.count("*").alias("n"))
    if counts.filter(F.col("n") < rows).limit(1).count():
        raise AssertionError("window size cannot exceed the number of observations")


def sliding_window_forecast(
    ds: PanelDataset,
    order: Order,
    window_size: float | None = None,
    window_rows: int | None = None,
    window_frac: float | None = None,
    on_invalid: str = "raise",
    auto: bool = False,
) -> DataFrame:
    """``(series_id, period_idx, prediction, actual)`` for the rows after the first window."""
    window = window_length(F.col("n"), window_size, window_rows, window_frac)
    count = window_rows if window_rows is not None else (int(window_size) if (window_size or 0) > 1 else None)
    if count is not None and on_invalid == "raise":
        check_window_fits(ds, count)
    ds = require_specified(ds, required_rows(order, 0, auto), on_invalid, window)
    span = order.lost + order.ar_span
    rest, out = ds, None
    if on_moments(order, len(ds.exog_vars)) and not ds.ragged and (count is None or count > span):
        if count is None and span:  # windows that hold no complete row of lags go the other way
            ds, rest = split_by_rows(ds, window > span)
        else:
            rest = None
        out = linear_rolling(ds, order, window)
        if rest is None:
            return out
    units = unit_rolling(one_order_units(rest, order).withColumn("w", window), order.trend).drop("order_id")
    return units if out is None else out.unionByName(units)


def unit_rolling(units: DataFrame, trend: str) -> DataFrame:
    """Back-test rows of units that carry their window length ``w``."""
    run = rolling_udf(trend)(unit_columns("w"))
    out = units.filter(F.col("w") < F.col("n")).withColumn("_p", run)
    return out.select("series_id", "order_id", "first_idx", "w", "y", F.posexplode("_p").alias("pos", "prediction")).select(
        "series_id",
        "order_id",
        (F.col("first_idx") + F.col("w") + F.col("pos")).alias("period_idx"),
        "prediction",
        F.get("y", F.col("w") + F.col("pos")).alias("actual"),
    )


def calc_rmse(prediction: Column | str, actual: Column | str) -> Column:
    a = F.col(prediction) if isinstance(prediction, str) else prediction
    b = F.col(actual) if isinstance(actual, str) else actual
    return F.sqrt(F.avg((a - b) * (a - b)))


def sliding_window_rmse(backtest: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    return backtest.groupBy(*keys).agg(calc_rmse("prediction", "actual").alias("rmse"))
