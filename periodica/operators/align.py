"""Align endogenous series with shared dated variables on one period index."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from periodica.errors import FrequencyError, IntersectionError
from periodica.functions.periods import CALENDAR_PERIODS, check_frequency, period_index, period_label
from periodica.operators.quality import dataset_rules, raise_on_violations
from periodica.session import bounded_side, materialize as written, materialize_all


def resample_mean(long: DataFrame, keys: Sequence[str], ts: str, value: str, freq: str, out: str = "value") -> DataFrame:
    """Mean per key and calendar period (partial aggregation absorbs hot keys)."""
    return (
        long.select(*keys, period_index(ts, freq).alias("period_idx"), F.col(value).alias(out))
        .groupBy(*keys, "period_idx")
        .agg(F.avg(out).alias(out))
    )


def exog_by_period(exog: DataFrame, exog_vars: Sequence[str], freq: str) -> DataFrame:
    """Long ``(var, ts, value)`` to one row per period, ``x`` in the order of ``exog_vars``.

    All variables are averaged in one conditional aggregation, so the shuffle
    carries one partial row per period and map task however many rows a variable has.
    """
    means = [F.avg(F.when(F.col("var") == v, F.col("value"))) for v in exog_vars]
    return (
        exog.filter(F.col("var").isin(list(exog_vars)))
        .select(period_index("ts", freq).alias("period_idx"), "var", "value")
        .groupBy("period_idx")
        .agg(F.array(*means).alias("x"))
    )


def wide_exog_by_period(table: DataFrame, ts: str, measures: Sequence[str], freq: str) -> DataFrame:
    """Same result for variables that are columns of one dated table."""
    return (
        table.select(period_index(ts, freq).alias("period_idx"), *measures)
        .groupBy("period_idx")
        .agg(F.array(*[F.avg(m) for m in measures]).alias("x"))
    )


def exog_vars_of(exog: DataFrame) -> list[str]:
    """Variable names of a long table (column names in effect, so few)."""
    return sorted(r["var"] for r in exog.select("var").distinct().collect())


def exog_bounds(exog_x: DataFrame) -> tuple[Column, Column]:
    """First and last exogenous period as scalar subqueries (no join)."""
    return (
        exog_x.agg(F.min("period_idx")).scalar(),
        exog_x.agg(F.max("period_idx")).scalar(),
    )


def overlap_bounds(
    endog: DataFrame, exog_x: DataFrame | None, bounds: tuple[Column, Column] | None = None
) -> DataFrame:
    """Per series: first period, current period and last exogenous period of the overlap.

    ``bounds`` gives the exogenous bounds when they are known already.
    """
    spans = endog.groupBy("series_id").agg(F.min("period_idx").alias("lo"), F.max("period_idx").alias("hi"))
    if exog_x is None:
        lo, hi, last = F.col("lo"), F.col("hi"), F.col("hi")
    else:
        x_lo, x_hi = bounds or exog_bounds(exog_x)
        lo, hi, last = F.greatest("lo", x_lo), F.least("hi", x_hi), x_hi
    return spans.select("series_id", lo.alias("start_idx"), hi.alias("current_idx"), last.alias("last_idx"))


def aligned_rows(
    endog: DataFrame,
    exog_x: DataFrame | None,
    freq: str,
    n_vars: int = 16,
    bounds: tuple[Column, Column] | None = None,
) -> DataFrame:
    """Rows ``(series_id, period_idx, is_future, y, x)`` from the start of the overlap on.

    Realized rows need no per-series bounds: inside one series they are exactly the
    rows between the exogenous bounds. Future rows are generated from one
    aggregated row per series. The variables come in by a join on the period,
    whose right side has at most one row per calendar period.
    """
    base = endog.select("series_id", "period_idx", "y")
    empty_x = F.array().cast("array<double>")
    if exog_x is None:
        return base.select("series_id", "period_idx", F.lit(False).alias("is_future"), "y", empty_x.alias("x"))
    x_lo, x_hi = bounds or exog_bounds(exog_x)
    realized = base.filter(F.col("period_idx").between(x_lo, x_hi)).select(
        "series_id", "period_idx", F.lit(False).alias("is_future"), "y"
    )
    spans = overlap_bounds(endog, exog_x, (x_lo, x_hi))
    first_future = F.greatest(F.col("current_idx") + 1, F.col("start_idx"))
    future = spans.filter(first_future <= F.col("last_idx")).select(
        "series_id",
        F.explode(F.sequence(first_future, F.col("last_idx"))).alias("period_idx"),
        F.lit(True).alias("is_future"),
        F.lit(None).cast("double").alias("y"),
    )
    side = bounded_side(exog_x, CALENDAR_PERIODS[check_frequency(freq)], 64 + 8 * n_vars)
    return realized.unionByName(future).join(side, "period_idx", "left").select(
        "series_id", "period_idx", "is_future", "y", "x"
    )


def series_spans_ok(rows: DataFrame, n_vars: int) -> DataFrame:
    """Per series: at least one realized row, and every row has every variable."""
    complete = F.lit(True) if n_vars == 0 else F.coalesce(
        F.forall("x", lambda v: v.isNotNull()), F.lit(False)
    )
    per = rows.groupBy("series_id").agg(
        (F.count_if(~F.col("is_future")) >= 1).alias("overlaps"),
        (
            (F.count_if(~complete) == 0)
            & (F.max("period_idx") - F.min("period_idx") + 1 == F.count("*"))
            & (F.count_distinct("period_idx") == F.count("*"))
        ).alias("frequency"),
    )
    return per.unpivot("series_id", ["overlaps", "frequency"], "rule", "ok")


def align(
    endog: DataFrame,
    exog: DataFrame | None,
    freq: str,
    exog_vars: Sequence[str] | None = None,
    on_invalid: str = "raise",
    materialize: bool = True,
) -> "PanelDataset":
    """Build a dataset from series rows and long dated variables.

    ``endog`` is ``(series_id, period_idx, y)``, ``exog`` is ``(var, ts, value)``.
    ``on_invalid`` is ``'raise'`` (check now), ``'quarantine'`` (drop offending
    series lazily) or ``'keep'`` (no check). ``materialize`` writes both inputs,
    already reduced to periods, to the shared folder, since every later step
    reads them again.
    """
    check_frequency(freq)
    names = [] if exog is None else list(exog_vars if exog_vars is not None else exog_vars_of(exog))
    exog_x = exog_by_period(exog, names, freq) if exog is not None else None
    return align_by_period(endog, exog_x, freq, names, on_invalid, materialize)


def align_by_period(
    endog: DataFrame,
    exog_x: DataFrame | None,
    freq: str,
    exog_vars: Sequence[str],
    on_invalid: str = "raise",
    materialize: bool = True,
) -> "PanelDataset":
    """:func:`align` for variables that already are one ``(period_idx, x)`` row per period."""
    names = list(exog_vars)
    bounds = None
    if materialize:
        endog = endog.select("series_id", "period_idx", "y")
        if exog_x is None:
            endog = written(endog)
        else:
            endog, exog_x = materialize_all(endog, exog_x)
            # one row from a table of at most one row per period; as constants they reach the scan
            lo, hi = exog_x.agg(F.min("period_idx"), F.max("period_idx")).first()
            bounds = F.lit(lo).cast("bigint"), F.lit(hi).cast("bigint")
    rows = aligned_rows(endog, exog_x, freq, len(names), bounds)
    if on_invalid == "raise":
        # every endogenous series must survive, even one that leaves no row at all
        met = endog.select("series_id").distinct().join(
            rows.filter(~F.col("is_future")).select("series_id").distinct(), "series_id", "left_anti"
        )
        if met.limit(1).count():
            raise IntersectionError("endogenous and exogenous data share no period")
        checks = series_spans_ok(rows, len(names))
        raise_on_violations(checks.filter(F.col("rule") == "frequency"), FrequencyError)
    elif on_invalid == "quarantine":
        per_series = Window.partitionBy("series_id")
        complete = F.lit(True) if not names else F.coalesce(F.forall("x", lambda v: v.isNotNull()), F.lit(False))
        rows = (
            rows.withColumn("_bad", F.count_if(~complete).over(per_series))
            .withColumn("_real", F.count_if(~F.col("is_future")).over(per_series))
            .withColumn("_step", F.col("period_idx") - F.lag("period_idx").over(per_series.orderBy("period_idx")))
            .withColumn("_jumps", F.count_if(F.col("_step") != 1).over(per_series))
            .filter((F.col("_bad") == 0) & (F.col("_real") > 0) & (F.col("_jumps") == 0))
            .drop("_bad", "_real", "_step", "_jumps")
        )
    elif on_invalid != "keep":
        raise ValueError(f"unknown on_invalid {on_invalid!r}")
    return PanelDataset(rows, freq, tuple(names))


@dataclass(frozen=True)
class PanelDataset:
    """A lazy aligned dataset: rows plus the frequency and the variable order."""

    df: DataFrame
    freq: str
    exog_vars: tuple[str, ...]
    #: after PCA the number of variables may differ between series
    ragged: bool = False

    @property
    def realized(self) -> DataFrame:
        return self.df.filter(~F.col("is_future"))

    @property
    def future(self) -> DataFrame:
        return self.df.filter(F.col("is_future"))

    @property
    def endogenous_data(self) -> DataFrame:
        return self.realized.select("series_id", "period_idx", "y")

    @property
    def exogenous_data(self) -> DataFrame:
        return self.realized.select("series_id", "period_idx", *self._x_columns())

    @property
    def future_exogenous_data(self) -> DataFrame:
        return self.future.select("series_id", "period_idx", *self._x_columns())

    def _x_columns(self) -> list[Column]:
        return [F.get("x", F.lit(i)).alias(v) for i, v in enumerate(self.exog_vars)]

    def with_labels(self) -> DataFrame:
        return self.df.withColumn("period", period_label("period_idx", self.freq))

    def future_exogenous(
        self, horizon: int | None = None, exog_vars: Sequence[str] | None = None, on_short: str = "raise"
    ) -> DataFrame:
        """First ``horizon`` future rows of each series (all when ``None``).

        ``on_short='raise'`` fails when a series has fewer future rows;
        ``'keep'`` returns what there is.
        """
        ds = self if exog_vars is None else self.downsample(exog_vars)
        out = ds.future_exogenous_data
        if horizon is None:
            return out
        if on_short == "raise":
            self.require_future_rows(horizon)
        first = F.min("period_idx").over(Window.partitionBy("series_id"))
        return out.withColumn("_first", first).filter(F.col("period_idx") - F.col("_first") < horizon).drop("_first")

    def require_future_rows(self, horizon: int) -> None:
        short = (
            self.df.groupBy("series_id").agg(F.count_if("is_future").alias("n")).filter(F.col("n") < horizon)
        )
        if horizon > 0 and short.limit(1).count():
            raise ValueError(f"not enough future exogenous data for horizon {horizon}")

    def downsample(self, exog_vars: Sequence[str]) -> "PanelDataset":
        """Keep only ``exog_vars``, in the order requested."""
        unknown = [v for v in exog_vars if v not in self.exog_vars]
        if unknown:
            raise KeyError(f"exogenous variables {unknown} not found in data")
        kept = [F.get("x", F.lit(self.exog_vars.index(v))) for v in exog_vars]
        x = F.array(*kept).cast("array<double>")
        return replace(self, df=self.df.withColumn("x", x), exog_vars=tuple(exog_vars))

    def materialize(self) -> "PanelDataset":
        """The same dataset, written once to the shared folder."""
        return replace(self, df=written(self.df))

    def rules(self) -> DataFrame:
        return dataset_rules(self.df, None if self.ragged else len(self.exog_vars))

    def validate(self) -> "PanelDataset":
        raise_on_violations(self.rules())
        return self

    def pca_loadings(self, explained_variance: float = 0.9) -> DataFrame:
        from periodica.operators.reduce import pca_fit, pca_loadings

        return pca_loadings(pca_fit(self, explained_variance), self.exog_vars)

    def PCA(self, explained_variance: float = 0.9, standardize_scores: bool = False) -> "PanelDataset":
        from periodica.operators.reduce import pca_transform

        return pca_transform(self, explained_variance, standardize_scores)

    def ADF_test(self) -> DataFrame:
        from periodica.operators.stats import adf_ndiffs

        return adf_ndiffs(self.endogenous_data)

    def KPSS_test(self) -> DataFrame:
        from periodica.operators.stats import kpss_ndiffs

        return kpss_ndiffs(self.endogenous_data)

    def autocorrelation(self, max_lag: int | None = None) -> DataFrame:
        from periodica.operators.stats import autocorrelation

        return autocorrelation(self.endogenous_data, max_lag)


def future_periods(endog: DataFrame, n: int) -> DataFrame:
    """The ``n`` periods after the last one of each series (none for ``n=0``)."""
    last = endog.groupBy("series_id").agg(F.max("period_idx").alias("last_idx"))
    steps = F.sequence(F.lit(1), F.lit(n)) if n > 0 else F.array().cast("array<int>")
    return last.select("series_id", "last_idx", F.explode(steps).alias("h")).select(
        "series_id", "h", (F.col("last_idx") + F.col("h")).alias("period_idx")
    )
