"""The three regression models over a panel. Each method returns lazy DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from periodica.errors import OverspecifiedError
from periodica.functions.css import Order
from periodica.operators import search
from periodica.operators.align import PanelDataset
from periodica.operators.backtest import check_window_fits, sliding_window_forecast, unit_rolling, window_length
from periodica.operators.fit import (
    FitTables,
    fit_order,
    fit_units,
    require_specified,
    required_rows,
    specification_rules,
    tables,
    unit_names,
    unit_residuals,
)
from periodica.operators.forecast import check_horizon, empty_forecast, forecast_order, unit_forecast
from periodica.operators.orders import (
    AUTO_PDQ,
    AUTO_SEASONAL,
    brute_ranges,
    check_order,
    overspecified,
    repeated_lags,
)
from periodica.session import materialize

MODEL_KINDS = ("SARIMARegression", "AutoARIMARegression", "BruteForceARIMARegression")


class SARIMARegression:
    """Seasonal autoregressive regression of one fixed order, with constant and linear trend."""

    trend = "ct"

    def __init__(
        self,
        p_d_q_order: Sequence[int] = (0, 0, 0),
        P_D_Q_order: Sequence[int] = (0, 0, 0, 4),
        on_invalid: str = "raise",
        estimator: str = "conditional",
    ):
        check_order(p_d_q_order, P_D_Q_order)
        repeats = repeated_lags(p_d_q_order, P_D_Q_order)
        if repeats:
            raise ValueError(f"repeat ordinary and seasonal lags of orders {sorted(repeats)}")
        self.p_d_q_order = tuple(p_d_q_order)
        self.P_D_Q_order = tuple(P_D_Q_order)
        self.on_invalid = on_invalid
        self.estimator = estimator

    @property
    def order(self) -> Order:
        return Order(*self.p_d_q_order, *self.P_D_Q_order, trend=self.trend)

    def rules(self, ds: PanelDataset) -> DataFrame:
        """Which series have rows enough for a fit, as ``(series_id, rule, ok)``."""
        o = self.order
        return specification_rules(ds, required_rows(o, 0), lost=o.lost)

    def fit(self, ds: PanelDataset) -> FitTables:
        return fit_order(ds, self.order, self.on_invalid, self.estimator)

    def predict(self, n: int, ds: PanelDataset) -> DataFrame:
        return forecast_order(ds, self.order, n, self.on_invalid, self.estimator)

    def sliding_window_forecast(
        self,
        ds: PanelDataset,
        window_size: float | None = None,
        window_rows: int | None = None,
        window_frac: float | None = None,
    ) -> DataFrame:
        return sliding_window_forecast(ds, self.order, window_size, window_rows, window_frac, self.on_invalid)


class _ChosenOrders:
    """Models whose order is a table row per series instead of a constant."""

    trend = "ct"
    on_invalid = "raise"
    #: automatic models count order 0 in the over-specification rule
    counts_terms = True

    def orders(self, ds: PanelDataset) -> DataFrame:
        raise NotImplementedError

    def rules(self, ds: PanelDataset) -> DataFrame:
        """Which series have rows enough for the smallest candidate, as ``(series_id, rule, ok)``."""
        return specification_rules(ds, required_rows(Order(0, 0, 0, 0, 0, 0, 2), 0))

    def _units(self, ds: PanelDataset) -> DataFrame:
        ds = require_specified(ds, required_rows(Order(0, 0, 0, 0, 0, 0, 2), 0), self.on_invalid)
        return self._with_orders(ds, self.orders(ds))

    def _with_orders(self, ds: PanelDataset, orders: DataFrame) -> DataFrame:
        """Series with their orders; in raise mode every series must have one."""
        if self.on_invalid == "raise":
            unknown = ds.realized.select("series_id").distinct().join(orders, "series_id", "left_anti")
            if not unknown.isEmpty():
                raise ValueError("no order was chosen for a series")
        return search.units_of(ds, orders)

    def _specified(self, units: DataFrame, rows: str) -> DataFrame:
        """Units whose order their rows allow; in raise mode all must be."""
        if not self.counts_terms:
            return units
        excess = overspecified(rows, F.col("nx")) | (F.col(rows) <= F.col("d") + F.col("m") * F.col("sd"))
        if self.on_invalid == "raise" and not units.filter(excess).isEmpty():
            raise OverspecifiedError("the chosen order is overspecified for a series")
        return units.filter(~excess)

    def fit(self, ds: PanelDataset) -> FitTables:
        est = materialize(fit_units(self._specified(self._units(ds), "n"), self.trend))
        return tables(est, unit_names(ds.exog_vars, self.trend), unit_residuals(est, ["series_id"]), ["series_id"])

    def predict(self, n: int, ds: PanelDataset) -> DataFrame:
        check_horizon(ds, n, self.on_invalid)
        units = self._specified(self._units(ds), "n")
        return empty_forecast(ds) if n == 0 else unit_forecast(units, self.trend, n)

    def sliding_window_forecast(
        self,
        ds: PanelDataset,
        window_size: float | None = None,
        window_rows: int | None = None,
        window_frac: float | None = None,
        select_on: str = "all",
    ) -> DataFrame:
        """Back-test with the order chosen once, on all rows or (``'train'``) on the first window only."""
        window = window_length(F.col("n"), window_size, window_rows, window_frac)
        count = window_rows if window_rows is not None else (int(window_size) if (window_size or 0) > 1 else None)
        if count is not None and self.on_invalid == "raise":
            check_window_fits(ds, count)
        needed = required_rows(Order(0, 0, 0, 0, 0, 0, 2), 0)
        ds = require_specified(ds, needed, self.on_invalid, window)
        if select_on not in ("all", "train"):
            raise ValueError(f"unknown select_on {select_on!r}")
        chosen = self.orders(ds if select_on == "all" else _first_window(ds, window))
        units = self._with_orders(ds, chosen).withColumn("w", window)
        return unit_rolling(self._specified(units, "w"), self.trend).drop("order_id")


def _first_window(ds: PanelDataset, window: Column) -> PanelDataset:
    whole = Window.partitionBy("series_id")
    marked = ds.realized.withColumn("n", F.count("*").over(whole)).withColumn(
        "_t", F.col("period_idx") - F.min("period_idx").over(whole)
    )
    return replace(ds, df=marked.filter(F.col("_t") < window).drop("n", "_t"))


class AutoARIMARegression(_ChosenOrders):
    """Order chosen per series by AIC over the capped grid; d and D kept when given."""

    trend = "t"
    counts_terms = False

    def __init__(
        self,
        p_d_q_order: Sequence[int | None] | None = None,
        P_D_Q_order: Sequence[int | None] | None = None,
        on_invalid: str = "raise",
    ):
        self.p_d_q_order = tuple(p_d_q_order) if p_d_q_order else AUTO_PDQ
        self.P_D_Q_order = tuple(P_D_Q_order) if P_D_Q_order else AUTO_SEASONAL
        check_order(self.p_d_q_order, self.P_D_Q_order, auto=True)
        self.on_invalid = on_invalid

    def orders(self, ds: PanelDataset) -> DataFrame:
        d, sd, m = self.p_d_q_order[1], self.P_D_Q_order[1], self.P_D_Q_order[3]
        return materialize(search.auto_search(ds, m, d, sd, self.trend))


class BruteForceARIMARegression(_ChosenOrders):
    """Order chosen per series by back-test error over a full grid, once, at construction."""

    def __init__(self, ds: PanelDataset, order_arg_ranges: Sequence[range], on_invalid: str = "raise"):
        self.on_invalid = on_invalid
        self._best = materialize(search.brute_search(ds, order_arg_ranges, self.trend, on_invalid))
        if on_invalid == "raise":
            lost = ds.realized.select("series_id").distinct().join(self._best, "series_id", "left_anti")
            if lost.limit(1).count():
                raise ValueError("no order of the grid is valid for every series")

    def orders(self, ds: PanelDataset | None = None) -> DataFrame:
        return self._best

    def rules(self, ds: PanelDataset) -> DataFrame:
        """Which series have an order that the search could score, as ``(series_id, rule, ok)``."""
        chosen = self._best.select("series_id", F.lit(True).alias("ok"))
        every = ds.realized.select("series_id").distinct().join(chosen, "series_id", "left")
        return every.select("series_id", F.lit("an_order_is_valid").alias("rule"), F.coalesce("ok", F.lit(False)).alias("ok"))


def make_model(
    kind: str, p_d_q_order: Sequence[int], P_D_Q_order: Sequence[int], ds: PanelDataset, on_invalid: str = "raise"
):
    """Model by name; the exhaustive one searches 0..p, 0..d, ... with a fixed season."""
    if kind == "SARIMARegression":
        return SARIMARegression(p_d_q_order, P_D_Q_order, on_invalid)
    if kind == "AutoARIMARegression":
        return AutoARIMARegression(p_d_q_order, P_D_Q_order, on_invalid)
    if kind == "BruteForceARIMARegression":
        return BruteForceARIMARegression(ds, brute_ranges(p_d_q_order, P_D_Q_order), on_invalid)
    raise ValueError(f"unknown model {kind!r}; expected one of {MODEL_KINDS}")
