"""Data rules as rows ``(series_id, rule, ok)``: one aggregation, no driver loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from periodica.errors import InvariantError


def as_rules(per_series: DataFrame, rules: dict) -> DataFrame:
    named = per_series.select("series_id", *[c.cast("boolean").alias(n) for n, c in rules.items()])
    return named.unpivot("series_id", list(rules), "rule", "ok")


def series_rules(series: DataFrame) -> DataFrame:
    """Rules of an imported series: no null, no repeated period, no gap."""
    # (series, period) first, so that a hot series is spread and distinct counts stay exact
    per_period = series.groupBy("series_id", "period_idx").agg(
        F.count("*").alias("n"), F.count_if(F.col("y").isNull() | F.isnan("y")).alias("n_null")
    )
    per_series = per_period.groupBy("series_id").agg(
        F.sum("n_null").alias("n_null"),
        F.max("n").alias("n_max"),
        F.count("*").alias("n_periods"),
        (F.max("period_idx") - F.min("period_idx") + 1).alias("span"),
    )
    return as_rules(
        per_series,
        {
            "no_null": F.col("n_null") == 0,
            "no_duplicate_period": F.col("n_max") == 1,
            "no_gap": F.col("n_periods") == F.col("span"),
        },
    )


def dataset_rules(ds: DataFrame, n_vars: int | None) -> DataFrame:
    """Rules of an aligned dataset ``(series_id, period_idx, is_future, y, x)``.

    ``n_vars=None`` lets the number of variables differ between series, not within one.
    """
    inf = float("inf")

    def finite(c):
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < inf)

    size_ok = F.lit(True) if n_vars is None else F.size("x") == n_vars
    x_ok = F.coalesce(size_ok & F.forall("x", finite), F.lit(False))
    per_period = ds.groupBy("series_id", "period_idx").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("is_future")).alias("n_future"),
        F.count_if(~F.col("is_future") & ~F.coalesce(finite(F.col("y")), F.lit(False))).alias("bad_y"),
        F.count_if(F.col("is_future") & F.col("y").isNotNull()).alias("future_y"),
        F.count_if(~x_ok).alias("bad_x"),
        F.min(F.size("x")).alias("x_lo"),
        F.max(F.size("x")).alias("x_hi"),
    )
    real = F.col("n_future") < F.col("n")
    future = F.col("n_future") > 0
    idx = F.col("period_idx")
    per_series = per_period.groupBy("series_id").agg(
        F.max("n").alias("n_max"),
        F.count_if(real).alias("n_real"),
        F.count_if(future).alias("n_future"),
        F.min(F.when(real, idx)).alias("real_lo"),
        F.max(F.when(real, idx)).alias("real_hi"),
        F.min(F.when(future, idx)).alias("fut_lo"),
        F.max(F.when(future, idx)).alias("fut_hi"),
        F.sum("bad_y").alias("bad_y"),
        F.sum("future_y").alias("future_y"),
        F.sum("bad_x").alias("bad_x"),
        (F.min("x_lo") == F.max("x_hi")).alias("same_x"),
    )
    c = F.col
    return as_rules(
        per_series,
        {
            "no_duplicate_period": c("n_max") == 1,
            "no_gap_realized": (c("n_real") == 0) | (c("real_hi") - c("real_lo") + 1 == c("n_real")),
            "no_gap_future": (c("n_future") == 0) | (c("fut_hi") - c("fut_lo") + 1 == c("n_future")),
            "future_follows_realized": (c("n_future") == 0) | (c("fut_lo") - F.coalesce(c("real_hi"), F.lit(-1)) == 1),
            "endog_finite": c("bad_y") == 0,
            "endog_only_realized": c("future_y") == 0,
            "exog_finite_and_complete": (c("bad_x") == 0) & c("same_x"),
            "one_realized_row": c("n_real") >= 1,
        },
    )


def raise_on_violations(rules: DataFrame, error: type[Exception] = InvariantError) -> None:
    """Fail when any rule is broken; only a few broken rows ever reach the driver."""
    bad = rules.filter(~F.col("ok")).limit(5).collect()
    if bad:
        raise error("; ".join(f"{r['series_id']!r} breaks {r['rule']}" for r in bad))


def keep_valid(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Quarantine mode: rows of series without a broken rule."""
    return df.join(rules.filter(~F.col("ok")).select("series_id").distinct(), "series_id", "left_anti")
