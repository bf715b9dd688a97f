"""Fit one order to every series: coefficients, information, residual diagnostics."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from periodica.errors import InvariantError, OverspecifiedError
from periodica.functions.css import Order
from periodica.functions.tails import f_two_sided, normal_two_sided
from periodica.operators.align import PanelDataset
from periodica.operators.moments import linear_estimates, linear_fit, linear_residuals, on_moments
from periodica.operators.orders import ORDER_COLS, TREND_TERMS
from periodica.operators.panel import dataset_arrays
from periodica.operators.quality import as_rules
from periodica.operators.two_stage import long_enough, two_stage_fit
from periodica.operators.units import fit_udf, unit_columns
from periodica.session import materialize

#: two-sided 95 % normal quantile (fixed value)
Z95 = 1.959963984540054


@dataclass(frozen=True)
class FitTables:
    """Lazy tables of one fit, all keyed by ``series_id``."""

    coefficients: DataFrame
    information: DataFrame
    diagnostics: DataFrame
    residuals: DataFrame


def required_rows(order: Order, n_exog: int, auto: bool = False) -> int:
    """Smallest number of observations that is not over-specified."""
    terms = 0 if auto else order.p + order.q + order.sp + order.sq
    return n_exog + terms + TREND_TERMS + 1


def require_specified(
    ds: PanelDataset, needed: int, on_invalid: str, window: Column | None = None, lost: int = 0
) -> PanelDataset:
    """Series a model can be fitted to: one row per period, every value there, (window) length at least ``needed``
    and one for each of the series' own variables, and more than the ``lost`` rows that differencing uses up.

    ``'raise'`` fails on the first other series, ``'quarantine'`` leaves them out.
    """
    missing = F.col("x").isNull() | F.exists("x", lambda v: v.isNull() | F.isnan(v))
    bad_row = missing | (~F.col("is_future") & (F.col("y").isNull() | F.isnan("y")))
    real_idx = F.when(~F.col("is_future"), F.col("period_idx"))
    facts = {
        "n": F.count(real_idx),
        "_bad": F.count_if(bad_row),
        "_lo": F.min("period_idx"),
        "_hi": F.max("period_idx"),
        "_all": F.count("*"),
        "_nx": F.max(F.size("x")),
    }
    rows = F.col("n") if window is None else window
    whole = (F.col("_bad") == 0) & (F.col("_hi") - F.col("_lo") + 1 == F.col("_all")) & F.col("_once")
    short = (rows < F.coalesce("_nx", F.lit(0)) + needed) | (rows <= lost)
    if on_invalid == "raise":
        once = (F.count_distinct("period_idx") == F.count("*")).alias("_once")
        per = ds.df.groupBy("series_id").agg(*[c.alias(k) for k, c in facts.items()], once)
        worst = per.select((~whole).alias("broken"), short.alias("short")).filter("broken OR short")
        hit = worst.agg(F.bool_or("broken").alias("broken"), F.bool_or("short").alias("short")).first()
        if hit["broken"]:
            raise InvariantError("a series has gaps or missing values")
        if hit["short"]:
            raise OverspecifiedError("model is overspecified: remove exogenous variables or reduce the order")
        return ds
    if on_invalid != "quarantine":
        raise ValueError(f"unknown on_invalid {on_invalid!r}")
    per_series = Window.partitionBy("series_id")
    again = F.col("period_idx") == F.lag("period_idx").over(per_series.orderBy("period_idx"))
    marked = ds.df.select("*", again.alias("_again"), *[c.over(per_series).alias(k) for k, c in facts.items()])
    marked = marked.withColumn("_once", F.count_if("_again").over(per_series) == 0)
    return replace(ds, df=marked.filter(whole & ~short).select(*ds.df.columns))


def specification_rules(ds: PanelDataset, needed: int, window: Column | None = None, lost: int = 0) -> DataFrame:
    """The row counts that :func:`require_specified` asks for, as rules ``(series_id, rule, ok)``."""
    per = ds.df.groupBy("series_id").agg(
        F.count_if(~F.col("is_future")).alias("n"), F.coalesce(F.max(F.size("x")), F.lit(0)).alias("_nx")
    )
    rows = F.col("n") if window is None else window
    return as_rules(per, {"enough_rows_for_terms": rows >= F.col("_nx") + needed, "rows_left_after_differencing": rows > lost})


def split_by_rows(ds: PanelDataset, long_enough: Column) -> tuple[PanelDataset, PanelDataset | None]:
    """Series for which a condition on ``n`` holds, and the others (None when there are none)."""
    counts = ds.realized.groupBy("series_id").agg(F.count("*").alias("n"))
    if counts.agg(F.bool_and(long_enough)).first()[0] in (True, None):
        return ds, None
    n = F.count_if(~F.col("is_future")).over(Window.partitionBy("series_id"))
    marked = ds.df.withColumn("n", n).withColumn("_long", long_enough)
    cols = ds.df.columns
    return (
        replace(ds, df=marked.filter("_long").select(*cols)),
        replace(ds, df=marked.filter("NOT _long").select(*cols)),
    )


def one_order_units(ds: PanelDataset, order: Order) -> DataFrame:
    cols = [F.lit(getattr(order, c)).cast("int").alias(c) for c in ORDER_COLS]
    return dataset_arrays(ds.df).select("*", F.lit(0).cast("bigint").alias("order_id"), *cols)


def fit_units(units: DataFrame, trend: str, steps: int = 0) -> DataFrame:
    """Fitted units: key columns plus the struct fields of :func:`fit_udf`."""
    run = fit_udf(trend, steps)(unit_columns("n_future", "fx"))
    return units.withColumn("_f", run).select(
        "series_id", "order_id", *ORDER_COLS, "first_idx", "n", "nx", "_f.*"
    )


def unit_names(exog_vars: tuple[str, ...], trend: str) -> Column:
    """Parameter names of a unit as an array column over its order columns."""
    exog = F.slice(F.array(*[F.lit(v) for v in exog_vars]), F.lit(1), F.col("nx")) if exog_vars else F.array()

    def lags(col: str, prefix: str, step: Column) -> Column:
        seq = F.sequence(F.lit(1), F.greatest(F.col(col), F.lit(1)))
        named = F.transform(seq, lambda i: F.concat(F.lit(prefix), (i * step).cast("string")))
        return F.slice(named, F.lit(1), F.col(col))

    first = F.array(*[F.lit(v) for v in (("intercept", "drift") if trend == "ct" else ("drift",))])
    one, m = F.lit(1), F.col("m")
    return F.concat(
        first, exog.cast("array<string>"), lags("p", "ar.L", one), lags("sp", "ar.S.L", m),
        lags("q", "ma.L", one), lags("sq", "ma.S.L", m),
    )


def coefficient_table(est: DataFrame, names: Column, keys: list[str]) -> DataFrame:
    """Long ``(keys, pos, param, estimate, std_err, z, p_value, ci_lo, ci_hi)``."""
    rows = est.select(
        *keys, F.posexplode(F.arrays_zip(names.alias("name"), F.col("est"), F.col("se"))).alias("pos", "_r")
    ).select(*keys, "pos", F.col("_r.name").alias("param"), F.col("_r.est").alias("estimate"), F.col("_r.se").alias("std_err"))
    z = F.when(F.col("std_err") > 0, F.col("estimate") / F.col("std_err"))
    return rows.withColumn("z", z).select(
        "*",
        normal_two_sided("z").alias("p_value"),
        (F.col("estimate") - Z95 * F.col("std_err")).alias("ci_lo"),
        (F.col("estimate") + Z95 * F.col("std_err")).alias("ci_hi"),
    )


def information_columns(est: DataFrame, keys: list[str], params: Column) -> DataFrame:
    """Likelihood and information criteria; ``params`` counts the error variance too."""
    n, s2 = F.col("n_eff"), F.try_divide(F.col("sse"), F.col("n_eff"))
    llf = F.when(F.col("sse") > 0, -n / 2 * (F.log(F.lit(2 * math.pi) * s2) + 1))
    return est.select(*keys, F.col("n").alias("n_obs"), "n_eff", s2.alias("sigma2"), llf.alias("llf"), params.alias("n_params"), "adjusted").select(
        "*",
        (2 * F.col("n_params") - 2 * F.col("llf")).alias("aic"),
        (F.log("n_eff") * F.col("n_params") - 2 * F.col("llf")).alias("bic"),
        (2 * F.log(F.log("n_eff")) * F.col("n_params") - 2 * F.col("llf")).alias("hqic"),
    )


def residual_diagnostics(residuals: DataFrame, keys: list[str]) -> DataFrame:
    """Ljung-Box (lag 1), Jarque-Bera, skew, kurtosis and variance ratio of the residuals."""
    whole = Window.partitionBy(*keys)
    run = whole.orderBy("period_idx")
    r = residuals.select(
        *keys,
        "resid",
        F.avg("resid").over(whole).alias("_mean"),
        F.lag("resid").over(run).alias("_before"),
        F.row_number().over(run).alias("_i"),
        F.count("*").over(whole).alias("_n"),
    )
    dev, dev_before = F.col("resid") - F.col("_mean"), F.col("_before") - F.col("_mean")
    third = F.greatest(F.rint(F.col("_n") / 3), F.lit(1.0))
    sq = F.col("resid") * F.col("resid")
    agg = r.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.try_divide(F.sum(dev * dev_before), F.sum(dev * dev)).alias("r1"),
        F.skewness("resid").alias("skew"),
        (F.kurtosis("resid") + 3).alias("kurtosis"),
        F.sum(F.when(F.col("_i") > F.col("_n") - third, sq)).alias("late"),
        F.sum(F.when(F.col("_i") <= third, sq)).alias("early"),
        F.max(third).alias("third"),
    )
    n = F.col("n")
    lb = n * (n + 2) * F.col("r1") * F.col("r1") / F.when(n > 1, n - 1)
    jb = n / 6 * (F.col("skew") * F.col("skew") + (F.col("kurtosis") - 3) * (F.col("kurtosis") - 3) / 4)
    out = agg.select(
        *keys, "n", lb.alias("ljung_box"), jb.alias("jarque_bera"), "skew", "kurtosis",
        F.when(F.col("early") > 0, F.col("late") / F.col("early")).alias("heteroskedasticity"), "third",
    )
    return out.select(
        *keys,
        "n",
        "ljung_box",
        normal_two_sided(F.sqrt("ljung_box")).alias("ljung_box_p"),
        "jarque_bera",
        F.exp(-F.col("jarque_bera") / 2).alias("jarque_bera_p"),
        "skew",
        "kurtosis",
        "heteroskedasticity",
        f_two_sided("heteroskedasticity", "third").alias("heteroskedasticity_p"),
    )


ESTIMATORS = ("conditional", "two_stage")


def require_two_stages(ds: PanelDataset, order: Order, on_invalid: str) -> PanelDataset:
    """Series long enough for a two-stage fit; in raise mode all must be."""
    kept, short = long_enough(ds, order)
    if on_invalid == "raise" and not short.isEmpty():
        raise OverspecifiedError("a series is too short for a two-stage fit")
    return kept


def fit_order(ds: PanelDataset, order: Order, on_invalid: str = "raise", estimator: str = "conditional") -> FitTables:
    """Fit ``order`` to every series of ``ds``.

    ``estimator`` says how moving-average terms are fitted: by iterated conditional least squares, or by two passes.
    """
    if estimator not in ESTIMATORS:
        raise ValueError(f"unknown estimator {estimator!r}; expected one of {ESTIMATORS}")
    ds = require_specified(ds, required_rows(order, 0), on_invalid, lost=order.lost)
    if estimator == "two_stage" and order.q + order.sq and not ds.ragged:
        est, residuals = two_stage_fit(require_two_stages(ds, order, on_invalid), order)
        return tables(est.drop("converged"), F.array(*[F.lit(v) for v in order.names(list(ds.exog_vars))]), residuals, ["series_id"])
    if not on_moments(order, len(ds.exog_vars)) or ds.ragged:
        est = materialize(fit_units(one_order_units(ds, order), order.trend))
        return tables(est, unit_names(ds.exog_vars, order.trend), unit_residuals(est, ["series_id"]), ["series_id"])
    ds, short = split_short(ds, order)
    fits = materialize(linear_fit(ds, order))
    est = linear_estimates(ds, order, fits).drop("converged")
    residuals = linear_residuals(ds, order, fits).select("series_id", "period_idx", "resid")
    if short is not None:
        rest = materialize(fit_units(one_order_units(short, order), order.trend))
        est = est.unionByName(rest.select(*est.columns))
        residuals = residuals.unionByName(unit_residuals(rest, ["series_id"]))
    names = F.array(*[F.lit(v) for v in order.names(list(ds.exog_vars))])
    return tables(est, names, residuals, ["series_id"])


def split_short(ds: PanelDataset, order: Order) -> tuple[PanelDataset, PanelDataset | None]:
    """Set apart series too short to condition on their own lags (orders with lags only)."""
    if not order.ar_span:
        return ds, None
    return split_by_rows(ds, F.col("n") > order.lost + order.ar_span)


def unit_residuals(est: DataFrame, keys: list[str]) -> DataFrame:
    return est.select(*keys, "first_idx", "first_row", F.posexplode("resid").alias("pos", "resid")).select(
        *keys, (F.col("first_idx") + F.col("first_row") + F.col("pos")).alias("period_idx"), "resid"
    )


def tables(est: DataFrame, names: Column, residuals: DataFrame, keys: list[str]) -> FitTables:
    return FitTables(
        coefficient_table(est, names, keys),
        information_columns(est, keys, F.size("est") + 1),
        residual_diagnostics(residuals, keys),
        residuals,
    )
