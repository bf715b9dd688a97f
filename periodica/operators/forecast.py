"""Forecasts after the last realized period of every series."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from periodica.functions.css import Order
from periodica.operators.align import PanelDataset
from periodica.operators.fit import fit_units, one_order_units, require_specified, require_two_stages, required_rows, split_short
from periodica.operators.moments import linear_fit, linear_forecast, on_moments, raw_coefficients
from periodica.operators.two_stage import two_stage_fit

FORECAST_SCHEMA = "series_id string, h int, period_idx bigint, prediction double"


def empty_forecast(ds: PanelDataset) -> DataFrame:
    return ds.df.sparkSession.createDataFrame([], FORECAST_SCHEMA)


def check_horizon(ds: PanelDataset, n: int, on_invalid: str) -> PanelDataset:
    """Without variables any horizon will do; with them every step needs a future row."""
    if n < 0:
        raise ValueError("number of periods to predict must be >= 0")
    if ds.exog_vars and n > 0 and on_invalid == "raise":
        ds.require_future_rows(n)
    return ds


def forecast_order(ds: PanelDataset, order: Order, n: int, on_invalid: str = "raise", estimator: str = "conditional") -> DataFrame:
    """``(series_id, h, period_idx, prediction)`` of ``n`` periods, refitted on all rows.

    In quarantine mode a series without enough future variables has no forecast.
    """
    check_horizon(ds, n, on_invalid)
    ds = require_specified(ds, required_rows(order, 0), on_invalid, lost=order.lost)
    if n == 0:
        return empty_forecast(ds)
    if estimator == "two_stage" and order.q + order.sq and not ds.ragged:
        ds = require_two_stages(ds, order, on_invalid)
        est, residuals = two_stage_fit(ds, order)
        return linear_forecast(ds, order, est, n, residuals).filter(F.col("prediction").isNotNull())
    if on_moments(order, len(ds.exog_vars)) and not ds.ragged:
        ds, short = split_short(ds, order)
        est = raw_coefficients(linear_fit(ds, order), order, len(ds.exog_vars))
        out = linear_forecast(ds, order, est, n).filter(F.col("prediction").isNotNull())
        if short is None:
            return out
        return out.unionByName(unit_forecast(one_order_units(short, order), order.trend, n))
    return unit_forecast(one_order_units(ds, order), order.trend, n)


def unit_forecast(units: DataFrame, trend: str, n: int) -> DataFrame:
    fits = fit_units(units, trend, n)
    return fits.select("series_id", "first_idx", "n", F.posexplode("ahead").alias("pos", "prediction")).select(
        "series_id",
        (F.col("pos") + 1).alias("h"),
        (F.col("first_idx") + F.col("n") + F.col("pos")).alias("period_idx"),
        "prediction",
    )
