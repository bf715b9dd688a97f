"""One DataFrame query per operator, each over whole tables.

Series: orders by priority (monthly or quarterly mean price), orders by customer
(many short series), events by type (daily). Variables: dated lineitem measures,
which run past the last order and so give real future periods.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from periodica.functions.css import Order
from periodica.functions.periods import period_index, period_label, quarter_label_index
from periodica.operators import search
from periodica.operators.align import (
    PanelDataset,
    align,
    align_by_period,
    exog_by_period,
    future_periods,
    overlap_bounds,
    resample_mean,
    series_spans_ok,
    aligned_rows,
    wide_exog_by_period,
)
from periodica.operators.backtest import sliding_window_forecast, sliding_window_rmse
from periodica.operators.fill import backfill_forward_fill, drop_empty_vars
from periodica.operators.fit import coefficient_table, fit_order
from periodica.operators.forecast import forecast_order
from periodica.operators.iterated import iterated_fit
from periodica.operators.lag_products import design_width
from periodica.operators.ledger import broken, quarantine
from periodica.operators.moments import design, products
from periodica.operators.orders import brute_ranges, order_grid, order_rules, overspecified, repeats
from periodica.operators.quality import series_rules
from periodica.operators.reduce import pca_fit, pca_loadings, standardize
from periodica.operators.two_stage import two_stage_fit
from periodica.operators.stats import adf_ndiffs, autocorrelation, difference, kpss_ndiffs, kpss_stat
from periodica.plans.models import AutoARIMARegression, BruteForceARIMARegression, SARIMARegression
from periodica.plans.run import RunConfig, run_on_dataset
from periodica.session import shared_folder
from periodica.sources.layouts import import_endogenous, import_exogenous, statement_series, year_month_series
from periodica.sources.sinks import write_outputs

MEASURES = ("l_quantity", "l_discount", "l_extendedprice")
AS_OF_YEAR = 2026
# these three tell lineitem rows apart
LINE_KEY = ("l_orderkey", "l_partkey", "l_suppkey")


def _r(c, digits: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def order_series(spark: SparkSession, sf: str, freq: str = "M", key: str = "o_orderpriority") -> DataFrame:
    rows = resample_mean(table(spark, sf, "orders"), [key], "o_orderdate", "o_totalprice", freq, out="y")
    return rows.select(F.col(key).cast("string").alias("series_id"), "period_idx", "y")


def event_series(spark: SparkSession, sf: str) -> DataFrame:
    rows = resample_mean(table(spark, sf, "events"), ["event_type"], "ts", "value", "D", out="y")
    return rows.withColumnRenamed("event_type", "series_id")


def ship_measures(spark: SparkSession, sf: str, freq: str = "M", measures=MEASURES) -> DataFrame:
    return wide_exog_by_period(table(spark, sf, "lineitem"), "l_shipdate", measures, freq)


def dataset(spark: SparkSession, sf: str, freq: str = "M", measures=MEASURES) -> PanelDataset:
    exog = ship_measures(spark, sf, freq, measures) if measures else None
    return align_by_period(order_series(spark, sf, freq), exog, freq, list(measures), on_invalid="keep")


def _measures(df: DataFrame, digits: int = 6) -> DataFrame:
    cols = [F.round(F.get("x", F.lit(i)), digits).alias(m) for i, m in enumerate(MEASURES)]
    return df.select("series_id", "period_idx", "is_future", _r("y", 4).alias("y"), *cols)


# --- alignment -----------------------------------------------------------------------------


def resample_mean_month(spark, sf):
    return order_series(spark, sf, "M").select(
        "series_id", "period_idx", period_label("period_idx", "M").alias("period"), _r("y", 4).alias("y")
    )


def resample_mean_quarter(spark, sf):
    return order_series(spark, sf, "Q").select(
        "series_id", "period_idx", period_label("period_idx", "Q").alias("period"), _r("y", 4).alias("y")
    )


def resample_mean_year(spark, sf):
    return order_series(spark, sf, "Y", "o_custkey").select(
        "series_id", "period_idx", period_label("period_idx", "Y").alias("period"), _r("y", 4).alias("y")
    )


def resample_mean_day(spark, sf):
    return event_series(spark, sf).select(
        "series_id", "period_idx", period_label("period_idx", "D").alias("period"), _r("y").alias("y")
    )


def resample_exog_wide(spark, sf):
    x = ship_measures(spark, sf)
    return x.select("period_idx", *[F.round(F.get("x", F.lit(i)), 6).alias(m) for i, m in enumerate(MEASURES)])


def resample_exog_long(spark, sf):
    events = table(spark, sf, "events").select(F.col("event_type").alias("var"), "ts", "value")
    names = ["click", "error", "purchase"]
    x = exog_by_period(events, names, "D")
    return x.select("period_idx", *[F.round(F.get("x", F.lit(i)), 6).alias(v) for i, v in enumerate(names)])


def overlap(spark, sf):
    return overlap_bounds(order_series(spark, sf), ship_measures(spark, sf))


def aligned_dataset(spark, sf):
    return _measures(dataset(spark, sf).df)


def aligned_without_exog(spark, sf):
    return dataset(spark, sf, "Q", ()).df.select("series_id", "period_idx", "is_future", _r("y", 4).alias("y"))


def realized_future_split(spark, sf):
    return dataset(spark, sf).df.groupBy("series_id", "is_future").agg(
        F.count("*").alias("n"), F.min("period_idx").alias("first_idx"), F.max("period_idx").alias("last_idx")
    )


def endogenous_data(spark, sf):
    return dataset(spark, sf, "Q").endogenous_data.select("series_id", "period_idx", _r("y", 4).alias("y"))


def exogenous_data(spark, sf):
    x = dataset(spark, sf, "Q").exogenous_data
    return x.select("series_id", "period_idx", *[_r(m).alias(m) for m in MEASURES])


def future_exogenous_data(spark, sf):
    x = dataset(spark, sf).future_exogenous_data
    return x.select("series_id", "period_idx", *[_r(m).alias(m) for m in MEASURES])


def future_exog_horizon(spark, sf):
    x = dataset(spark, sf).future_exogenous(2, ["l_discount", "l_quantity"], on_short="keep")
    return x.select("series_id", "period_idx", _r("l_discount").alias("l_discount"), _r("l_quantity").alias("l_quantity"))


def column_subset(spark, sf):
    x = dataset(spark, sf).downsample(["l_extendedprice", "l_quantity"]).exogenous_data
    return x.select("series_id", "period_idx", *[_r(m).alias(m) for m in ("l_extendedprice", "l_quantity")])


def frequency_check(spark, sf):
    daily = resample_mean(table(spark, sf, "orders"), ["o_orderpriority"], "o_orderdate", "o_totalprice", "D", out="y")
    endog = daily.withColumnRenamed("o_orderpriority", "series_id")
    rows = aligned_rows(endog, ship_measures(spark, sf, "D"), "D")
    return series_spans_ok(rows, len(MEASURES))


def gap_and_dup_check(spark, sf):
    return series_rules(order_series(spark, sf, "M", "o_custkey"))


def dataset_rule_table(spark, sf):
    endog = order_series(spark, sf, "Q", "o_custkey")
    return align_by_period(endog, ship_measures(spark, sf, "Q"), "Q", MEASURES, on_invalid="keep").rules()


def quarantined_dataset(spark, sf):
    endog = order_series(spark, sf, "Y", "o_custkey")
    ds = align_by_period(endog, ship_measures(spark, sf, "Y"), "Y", MEASURES, on_invalid="quarantine")
    return ds.df.groupBy("series_id").agg(F.count("*").alias("n"), _r(F.sum("y"), 4).alias("y_sum"))


def next_periods(spark, sf):
    out = future_periods(order_series(spark, sf, "M", "o_custkey"), 3)
    return out.select("series_id", F.col("h").cast("bigint").alias("h"), "period_idx")


# --- import layouts ------------------------------------------------------------------------

# one wide column per month, English and Spanish names in mixed case
GRID_MONTHS = (
    "January", "FEB", "marzo", "April", "mayo", "JUNIO", "julio", "Aug", "septiembre", "Oct", "NOVIEMBRE", "dic",
)


def _file(spark, kind: str) -> str:
    """A new path in the shared folder, for files made from the tables and read back."""
    return f"{shared_folder(spark)}/periodica-{kind}-{uuid.uuid4().hex}"


def _year_month_grid(spark, sf) -> DataFrame:
    orders = table(spark, sf, "orders")
    cells = [
        F.avg(F.when(F.month("o_orderdate") == i + 1, F.col("o_totalprice"))).cast("string").alias(name)
        for i, name in enumerate(GRID_MONTHS)
    ]
    return orders.groupBy(F.year("o_orderdate").alias("Year")).agg(*cells)


def year_month_unpivot(spark, sf):
    return year_month_series(_year_month_grid(spark, sf), "price").select("series_id", "period_idx", "period", _r("y", 4).alias("y"))


def year_month_scan(spark, sf):
    """The grid written as CSV and imported by its format."""
    path = _file(spark, "grid")
    _year_month_grid(spark, sf).write.option("header", True).csv(path)
    return import_endogenous(spark, path, "price", "excel_table", AS_OF_YEAR).select("series_id", "period_idx", "period", _r("y", 4).alias("y"))


def _statement_table(spark, sf) -> DataFrame:
    """Orders as a statement: labels by row, quarters by column, small cells written as '-'."""
    orders = table(spark, sf, "orders")
    cells = []
    for year in range(1995, 2002):
        for q in range(1, 5):
            inside = (F.year("o_orderdate") == year) & (F.quarter("o_orderdate") == q)
            mean = F.avg(F.when(inside, F.col("o_totalprice")))
            text = F.when(mean < 200000, F.lit("-")).otherwise(mean.cast("string"))
            cells.append(text.alias(f"Q{q} {year % 100:02d}"))
    label = F.concat(F.col("o_orderpriority"), F.lit(" "), F.col("o_orderstatus"))
    return orders.groupBy(label.alias("Description")).agg(F.lit("$").alias("Currency"), *cells)


def statement_import(spark, sf):
    out = statement_series(_statement_table(spark, sf), AS_OF_YEAR)
    return out.select("series_id", "period_idx", "period", _r("y", 4).alias("y"))


def statement_one_label(spark, sf):
    out = statement_series(_statement_table(spark, sf), AS_OF_YEAR, "2-HIGH O")
    return out.select("series_id", "period_idx", "period", _r("y", 4).alias("y"))


def statement_scan(spark, sf):
    """The statement written as CSV; one label imported by its format and checked."""
    path = _file(spark, "statement")
    _statement_table(spark, sf).write.option("header", True).csv(path)
    out = import_endogenous(spark, path, "2-HIGH O", "financial_statement", AS_OF_YEAR)
    return out.select("series_id", "period_idx", "period", _r("y", 4).alias("y"))


def dated_sheet_scan(spark, sf):
    """Daily ship measures as one sheet export a year, a third of the cells empty; read by line number and filled."""
    days = table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(
        F.count("*").alias("n"), *[F.avg(m).alias(m) for m in MEASURES]
    )
    shown = [F.when((F.col("n") + i) % 3 != 0, F.col(m).cast("string")).otherwise("") for i, m in enumerate(MEASURES)]
    rows = days.select(
        F.year("day").alias("sheet"), (F.dayofyear("day") + 6).alias("line"),
        F.concat_ws(",", F.date_format("day", "MM/dd/yyyy"), *shown).alias("value"),
    )
    top = ["ship measures", "", "01/01/1900,1", "," + ",".join(MEASURES), "unit,u,u,u", ""]
    heads = rows.select("sheet").distinct().select("sheet", F.posexplode(F.array(*[F.lit(t) for t in top])).alias("line", "value"))
    path = _file(spark, "sheets")
    # a sheet is a year of days, so one task can write it in order
    sheets = rows.unionByName(heads).repartition("sheet").sortWithinPartitions("sheet", "line")
    sheets.select("sheet", "value").write.partitionBy("sheet").text(path)
    out = import_exogenous(spark, path, "macro")
    return out.select("var", F.to_date("ts").alias("day"), _r("value").alias("value"))


def sink_round_trip(spark, sf):
    """The chain's data table written by the sink and read again."""
    outputs = run_on_dataset(dataset(spark, sf), RunConfig("", "excel_table", "price", AS_OF_YEAR))
    return _measures(spark.read.parquet(write_outputs(outputs, _file(spark, "out"), "parquet")["data"]))


def quarter_label_parse(spark, sf):
    orders = table(spark, sf, "orders")
    label = F.format_string("Q%d %02d", F.quarter("o_orderdate"), F.year("o_orderdate") % 100)
    return (
        orders.select(label.alias("label"), quarter_label_index(label, 2000).alias("period_idx"))
        .groupBy("label", "period_idx")
        .agg(F.count("*").alias("n"))
    )


def backfill_forward_fill_instants(spark, sf):
    events = table(spark, sf, "events").select(
        F.col("event_type").alias("var"), "ts", "event_id",
        F.when(F.col("value") >= 20, F.col("value")).alias("value"),
    )
    return backfill_forward_fill(events, tie=["event_id"]).select("var", "event_id", "value")


def backfill_forward_fill_days(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("var"), F.col("l_shipdate").alias("ts"),
        *LINE_KEY,
        F.when(F.col("l_discount") > 0.05, F.col("l_extendedprice")).alias("value"),
    )
    return backfill_forward_fill(rows, tie=LINE_KEY).select("var", *LINE_KEY, "value")


def drop_empty_variables(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("var"), F.col("l_shipdate").alias("ts"),
        *LINE_KEY,
        F.when((F.col("l_linestatus") == "O") & (F.col("l_tax") > 0.04), F.col("l_quantity")).alias("value"),
    )
    filled = drop_empty_vars(backfill_forward_fill(rows, tie=LINE_KEY))
    return filled.groupBy("var").agg(F.count("*").alias("n"), _r(F.avg("value")).alias("mean_value"))


# --- reduction and statistics --------------------------------------------------------------


def standardized(spark, sf):
    z = standardize(dataset(spark, sf))
    return z.select("series_id", "period_idx", *[_r(F.get("z", F.lit(i))).alias(f"z_{m}") for i, m in enumerate(MEASURES)])


TWO = ("l_quantity", "l_discount")


def pca_loadings_2var(spark, sf):
    out = pca_loadings(pca_fit(dataset(spark, sf, "M", TWO), 1.0), TWO)
    return out.select("series_id", F.col("component").cast("bigint").alias("component"), "component_name", "var", _r("loading").alias("loading"))


def pca_scores_2var(spark, sf):
    ds = dataset(spark, sf, "M", TWO).PCA(1.0)
    return ds.df.select("series_id", "period_idx", "is_future", *[_r(F.get("x", F.lit(i))).alias(f"pca{i}") for i in (0, 1)])


def pca_components_kept(spark, sf):
    fit = pca_fit(dataset(spark, sf, "M", TWO), 0.6)
    return fit.select("series_id", F.size("vec").cast("bigint").alias("n_components"), _r(F.get("ratio", F.lit(0))).alias("first_ratio"))


def pca_nvar(spark, sf):
    out = dataset(spark, sf).pca_loadings(0.9)
    return out.select("series_id", F.col("component").cast("bigint").alias("component"), "component_name", "var", _r("loading").alias("loading"))


def acf_table(spark, sf):
    out = autocorrelation(order_series(spark, sf))
    return out.select("series_id", "lag", _r("r").alias("r"), _r("band95").alias("band95"), _r("band99").alias("band99"))


def acf_daily_events(spark, sf):
    out = autocorrelation(event_series(spark, sf), 10)
    return out.select("series_id", "lag", _r("r").alias("r"), _r("band95").alias("band95"), _r("band99").alias("band99"))


def kpss_statistic(spark, sf):
    out = kpss_stat(order_series(spark, sf))
    return out.select("series_id", F.col("n").cast("bigint").alias("n"), _r("kpss").alias("kpss"), _r("p_value").alias("p_value"))


def kpss_differencing(spark, sf):
    return kpss_ndiffs(order_series(spark, sf))


def adf_differencing(spark, sf):
    out = adf_ndiffs(order_series(spark, sf))
    return out.select("series_id", _r("adf_stat", 4).alias("adf_stat"), _r("p_value", 4).alias("p_value"), "ndiffs")


def ordinary_difference(spark, sf):
    return difference(order_series(spark, sf), d=2).select("series_id", "period_idx", _r("z", 4).alias("z"))


def seasonal_difference(spark, sf):
    return difference(order_series(spark, sf), d=1, D=1, m=12).select("series_id", "period_idx", _r("z", 4).alias("z"))


# --- models --------------------------------------------------------------------------------

TREND = Order(0, 0, 0, 0, 0, 0, 4)
AR1 = Order(1, 0, 0, 0, 0, 0, 4)
MA1 = Order(0, 0, 1, 0, 0, 0, 4)
DIFF1 = Order(0, 1, 0, 0, 0, 0, 4)
ONE = ("l_discount",)


def _coef(out: DataFrame) -> DataFrame:
    return out.select("series_id", "param", _r("estimate", 4).alias("estimate"))


def fit_trend(spark, sf):
    out = fit_order(dataset(spark, sf, "M", ()), TREND, "quarantine").coefficients
    return out.select("series_id", "param", _r("estimate", 4).alias("estimate"), _r("std_err", 4).alias("std_err"), _r("z", 4).alias("z"), _r("ci_lo", 4).alias("ci_lo"), _r("ci_hi", 4).alias("ci_hi"))


def fit_trend_exog1(spark, sf):
    return _coef(fit_order(dataset(spark, sf, "M", ONE), TREND, "quarantine").coefficients)


def fit_ar1_trend(spark, sf):
    return _coef(fit_order(dataset(spark, sf, "M", ()), AR1, "quarantine").coefficients)


def fit_info(spark, sf):
    out = fit_order(dataset(spark, sf, "M", ()), TREND, "quarantine").information
    return out.select("series_id", F.col("n_obs").cast("bigint").alias("n_obs"), *[_r(c, 4).alias(c) for c in ("sigma2", "llf", "aic", "bic", "hqic")])


def fit_diagnostics(spark, sf):
    out = fit_order(dataset(spark, sf, "M", ()), TREND, "quarantine").diagnostics
    keep = ("ljung_box", "jarque_bera", "jarque_bera_p", "skew", "kurtosis", "heteroskedasticity")
    return out.select("series_id", *[_r(c).alias(c) for c in keep])


def fit_residuals(spark, sf):
    out = fit_order(dataset(spark, sf, "M", ()), DIFF1, "quarantine").residuals
    return out.select("series_id", "period_idx", _r("resid", 4).alias("resid"))


def fit_ma(spark, sf):
    return _coef(fit_order(dataset(spark, sf, "M", ()), Order(0, 0, 1, 0, 0, 1, 4), "quarantine").coefficients)


def fit_ma_two_stage(spark, sf):
    est, _ = two_stage_fit(dataset(spark, sf, "M", ()), MA1, long=4)
    names = F.array(*[F.lit(v) for v in MA1.names([])])
    return _coef(coefficient_table(est, names, ["series_id"]))


def fit_arma_two_stage(spark, sf):
    """Products of ordinary and seasonal terms on both sides, with a variable."""
    model = SARIMARegression((1, 0, 1), (0, 0, 1, 4), on_invalid="quarantine", estimator="two_stage")
    return _coef(model.fit(dataset(spark, sf, "M", ONE)).coefficients)


def forecast_arma_two_stage(spark, sf):
    model = SARIMARegression((1, 0, 1), (0, 0, 1, 4), on_invalid="quarantine", estimator="two_stage")
    return _forecast(model.predict(3, dataset(spark, sf, "M", ())))


def autoregression_gram(spark, sf):
    """The one matrix that answers every order up to (2, 0, 0)(1, 0, 0)4: summed products, in thousands."""
    order = Order(2, 0, 0, 1, 0, 0, 4)
    k = design_width(order, 0)
    scaled = [F.get("v", F.lit(i)) / (1 if i < 2 else 1000) for i in range(k)]
    rows = design(dataset(spark, sf, "M", ()), order).filter("v IS NOT NULL").select("series_id", (F.col("z") / 1000).alias("z"), F.array(*scaled).alias("v"))
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    grams = rows.groupBy("series_id").agg(F.array(*[F.sum(c) for c in products(k)]).alias("g"))
    place = F.array(*[F.struct(F.lit(i).cast("bigint").alias("i"), F.lit(j).cast("bigint").alias("j")) for i, j in pairs])
    cells = grams.select("series_id", F.explode(F.arrays_zip(place.alias("at"), F.col("g").alias("value"))).alias("c"))
    return cells.select("series_id", "c.at.i", "c.at.j", _r("c.value", 4).alias("value"))


def fit_seasonal_product(spark, sf):
    return _coef(fit_order(dataset(spark, sf, "M", ()), Order(2, 0, 0, 1, 0, 0, 4), "quarantine").coefficients)


def fit_autoregressive_errors(spark, sf):
    """One pass of the iteration: errors regressed on their last value, then filtered values on filtered values."""
    out = iterated_fit(dataset(spark, sf, "M", ONE), AR1, max_passes=1)
    names = F.array(*[F.lit(v) for v in AR1.names(list(ONE))])
    rows = out.select("series_id", "converged", F.explode(F.arrays_zip(names.alias("param"), F.col("est").alias("estimate"))).alias("r"))
    return rows.select("series_id", "r.param", _r("r.estimate", 3).alias("estimate"), "converged")


def unconverged_series(spark, sf):
    """How many passes the series take with all measures, and which had not settled by then."""
    ds = dataset(spark, sf, "M")
    out = iterated_fit(ds, Order(1, 0, 0, 1, 0, 0, 12), max_passes=4, tolerance=1e-4)
    return out.select("series_id", F.col("passes").cast("bigint").alias("passes"), "converged", (F.col("move") > 0).alias("moved"))


def fit_exog_ar(spark, sf):
    return _coef(fit_order(dataset(spark, sf), Order(1, 0, 0, 1, 0, 0, 4), "quarantine").coefficients)


GRID = (range(0, 3), range(0, 2), range(0, 3), range(0, 2), range(0, 2), range(0, 2), range(2, 5, 2))


def order_grid_valid(spark, sf):
    """Orders of the grid that fit at least one customer series, with the number of such series."""
    counts = order_series(spark, sf, "Q", "o_custkey")
    rules = order_rules(counts, order_grid(spark, GRID), 0)
    ok = rules.filter(~F.col("repeated_lags") & ~F.col("overspecified"))
    return ok.groupBy("order_id").agg(F.count("*").alias("n_series"))


def overspecified_flags(spark, sf):
    rules = order_rules(order_series(spark, sf, "Y", "o_custkey"), order_grid(spark, brute_ranges((1, 0, 1), (1, 0, 0, 2))), 1)
    return rules.select("series_id", "order_id", "n", "repeated_lags", "overspecified")


def _forecast(out: DataFrame) -> DataFrame:
    return out.select("series_id", F.col("h").cast("bigint").alias("h"), F.col("period_idx").cast("bigint").alias("period_idx"), _r("prediction", 4).alias("prediction"))


def forecast_trend(spark, sf):
    return _forecast(forecast_order(dataset(spark, sf, "M", ()), TREND, 6, "quarantine"))


def forecast_trend_exog1(spark, sf):
    return _forecast(forecast_order(dataset(spark, sf, "M", ONE), TREND, 3, "quarantine"))


def forecast_ar1(spark, sf):
    return _forecast(forecast_order(dataset(spark, sf, "M", ()), AR1, 4, "quarantine"))


def forecast_differenced(spark, sf):
    return _forecast(forecast_order(dataset(spark, sf, "M", ()), DIFF1, 4, "quarantine"))


def forecast_seasonal_arma(spark, sf):
    return _forecast(forecast_order(dataset(spark, sf), Order(1, 0, 1, 1, 0, 0, 12), 3, "quarantine"))


def _backtest(out: DataFrame) -> DataFrame:
    return out.select("series_id", "period_idx", _r("prediction", 4).alias("prediction"), _r("actual", 4).alias("actual"))


def rolling_forecast_trend(spark, sf):
    return _backtest(sliding_window_forecast(dataset(spark, sf, "M", ()), TREND, 0.8, on_invalid="quarantine"))


def rolling_forecast_exog1(spark, sf):
    return _backtest(sliding_window_forecast(dataset(spark, sf, "M", ONE), TREND, window_rows=48, on_invalid="quarantine"))


def rolling_forecast_ar1(spark, sf):
    return _backtest(sliding_window_forecast(dataset(spark, sf, "M", ()), AR1, window_rows=40, on_invalid="quarantine"))


def rolling_rmse(spark, sf):
    back = sliding_window_forecast(dataset(spark, sf, "M", ()), TREND, 0.8, on_invalid="quarantine")
    return sliding_window_rmse(back).select("series_id", _r("rmse", 4).alias("rmse"))


def rolling_forecast_arma(spark, sf):
    return _backtest(sliding_window_forecast(dataset(spark, sf, "M", ()), Order(1, 0, 1, 0, 0, 0, 4), 0.8, on_invalid="quarantine"))


AR_GRID = (range(2), range(2), range(1), range(1), range(1), range(1), range(4, 5))


def brute_autoregression_grid(spark, sf):
    scores = search.brute_scores(dataset(spark, sf, "M", ()), AR_GRID, on_invalid="quarantine")
    return scores.select("series_id", "order_id", F.col("p").cast("bigint").alias("p"), F.col("d").cast("bigint").alias("d"), _r("rmse", 4).alias("rmse"))


def rolling_forecast_seasonal_product(spark, sf):
    return _backtest(sliding_window_forecast(dataset(spark, sf, "M", ()), Order(1, 1, 0, 1, 0, 0, 12), 0.8, on_invalid="quarantine"))


def auto_candidates(spark, sf):
    """Every candidate of the automatic search, with its AIC or the reason why it has none."""
    out = search.auto_scores(dataset(spark, sf, "Q", ()), 4, None, None)
    return out.select("series_id", "order_id", "p", "d", "q", "sp", "sd", "sq", "n_params", "n_eff", "reason", _r("aic", 2).alias("aic"))


ZERO_LAG_GRID = (range(1), range(2), range(1), range(1), range(2), range(1), range(12, 13))


def brute_best_order(spark, sf):
    best = search.brute_search(dataset(spark, sf, "M", ()), ZERO_LAG_GRID, on_invalid="quarantine")
    return best.select("series_id", "order_id", F.col("d").cast("bigint").alias("d"), F.col("sd").cast("bigint").alias("sd"), _r("rmse", 4).alias("rmse"))


def brute_full(spark, sf):
    grid = brute_ranges((1, 1, 1), (1, 1, 0, 4))
    best = search.brute_search(dataset(spark, sf, "M", ()), grid, on_invalid="quarantine")
    return best.select("series_id", "order_id", "p", "d", "q", "sp", "sd", "sq", "m", _r("rmse", 2).alias("rmse"))


# p 0..3, d 0..2, q 0..3, P, D and Q 0..1, season 4: 384 orders
WIDE_GRID = (range(0, 4), range(0, 3), range(0, 4), range(0, 2), range(0, 2), range(0, 2), range(4, 5))


def brute_wide_grid(spark, sf):
    best = search.brute_search(dataset(spark, sf, "M", ()), WIDE_GRID, on_invalid="quarantine")
    return best.select("series_id", "order_id", "p", "d", "q", "sp", "sd", "sq", "m", _r("rmse", 2).alias("rmse"))


def brute_model_forecast(spark, sf):
    ds = dataset(spark, sf, "Q", ())
    model = BruteForceARIMARegression(ds, brute_ranges((1, 1, 0), (1, 0, 0, 4)), on_invalid="quarantine")
    return _forecast(model.predict(4, ds))


def auto_order(spark, sf):
    best = search.auto_search(dataset(spark, sf, "Q", ()), 4)
    return best.select("series_id", "p", "d", "q", "sp", "sd", "sq", "m", _r("aic", 2).alias("aic"))


def auto_sliding(spark, sf):
    model = AutoARIMARegression((0, 0, 0), (0, 0, 0, 4), on_invalid="quarantine")
    return _backtest(model.sliding_window_forecast(dataset(spark, sf, "Q", ()), 0.8))


def chain_subset_pca_forecast(spark, sf):
    cfg = RunConfig("", "excel_table", "price", AS_OF_YEAR, exog_vars=["l_quantity", "l_extendedprice"], pca=0.95, predict=3)
    return _forecast(run_on_dataset(dataset(spark, sf), cfg, on_invalid="quarantine")["predict"])


def quarantine_ledger(spark, sf):
    """Single orders of a customer and priority as yearly rows: pending cheap ones without a price, dear ones overflown."""
    price = F.col("o_totalprice")
    endog = table(spark, sf, "orders").select(
        F.concat_ws(" ", F.col("o_custkey").cast("string"), "o_orderpriority").alias("series_id"),
        period_index("o_orderdate", "Y").alias("period_idx"),
        F.when((F.col("o_orderstatus") == "P") & (price < 50000), F.lit(None).cast("double"))
        .when(price > 400000, F.lit(float("inf"))).otherwise(price).alias("y"),
    )
    ds, left_out = quarantine(endog, ship_measures(spark, sf, "Y", MEASURES[:1]), "Y", MEASURES[:1])
    return left_out.unionByName(broken(SARIMARegression((0, 0, 0), (0, 0, 0, 2)).rules(ds), "model"))


def quarterly_trend_backtest(spark, sf):
    """Flagship: mean order price per priority and quarter, rolling trend forecast."""
    return _backtest(sliding_window_forecast(dataset(spark, sf, "Q", ()), TREND, 0.8, on_invalid="quarantine"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        resample_mean_month, resample_mean_quarter, resample_mean_year, resample_mean_day,
        resample_exog_wide, resample_exog_long, overlap, aligned_dataset, aligned_without_exog,
        realized_future_split, endogenous_data, exogenous_data, future_exogenous_data,
        future_exog_horizon, column_subset, frequency_check, gap_and_dup_check, dataset_rule_table,
        quarantined_dataset, next_periods, year_month_unpivot, statement_import, statement_one_label,
        year_month_scan, statement_scan, dated_sheet_scan, sink_round_trip, quarantine_ledger,
        quarter_label_parse, backfill_forward_fill_instants, backfill_forward_fill_days,
        drop_empty_variables, standardized, pca_loadings_2var, pca_scores_2var, pca_components_kept,
        pca_nvar, acf_table, acf_daily_events, kpss_statistic, kpss_differencing, adf_differencing,
        ordinary_difference, seasonal_difference, fit_trend, fit_trend_exog1, fit_ar1_trend, fit_info,
        fit_diagnostics, fit_residuals, fit_ma, fit_ma_two_stage, fit_arma_two_stage, autoregression_gram, fit_seasonal_product, fit_autoregressive_errors, unconverged_series, fit_exog_ar, order_grid_valid, overspecified_flags,
        forecast_trend, forecast_trend_exog1, forecast_ar1, forecast_differenced, forecast_seasonal_arma,
        rolling_forecast_trend, rolling_forecast_exog1, rolling_forecast_ar1, rolling_rmse,
        rolling_forecast_arma, rolling_forecast_seasonal_product, brute_autoregression_grid, auto_candidates, forecast_arma_two_stage,
        brute_best_order, brute_full, brute_wide_grid, brute_model_forecast, auto_order, auto_sliding,
        chain_subset_pca_forecast, quarterly_trend_backtest,
    )
}
