"""The whole chain: import, align, reduce, model, fit / predict / back-test."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from periodica.operators.align import PanelDataset, align, exog_by_period, exog_vars_of
from periodica.operators.ledger import broken, quarantine
from periodica.plans.models import MODEL_KINDS, make_model
from periodica.sources.layouts import (
    endog_frequency,
    import_endogenous,
    import_exogenous,
    read_statement,
    statement_quarantine,
    statement_series,
)


@dataclass(frozen=True)
class RunConfig:
    """Options of one run; ``None`` means "not asked for", zero is a value."""

    endog_path: str
    endog_format: str
    endog_var: str | None  # None: every label of a statement is a series
    as_of_year: int
    exog_path: str | None = None
    exog_format: str | None = None
    exog_vars: Sequence[str] | None = None
    pca: float | None = None
    model: str = "SARIMARegression"
    p_d_q_order: Sequence[int] = (0, 0, 0)
    P_D_Q_order: Sequence[int] = (0, 0, 0, 4)
    fit: bool = False
    predict: int | None = None
    sliding_window: float | None = None
    statistics: bool = False
    on_invalid: str = "raise"

    def check(self) -> "RunConfig":
        if (self.exog_path is None) != (self.exog_format is None):
            raise ValueError("exog_path and exog_format must be given together")
        if self.pca is not None and not 0.0 <= self.pca <= 1.0:
            raise ValueError("pca must be between 0 and 1")
        if any(v is not None and v < 0 for v in [*self.p_d_q_order, *self.P_D_Q_order]):
            raise ValueError("order terms must be >= 0")
        if self.sliding_window is not None and not 0.0 < self.sliding_window <= 1.0:
            raise ValueError("sliding_window must be above 0 and at most 1")
        if self.predict is not None and self.predict < 0:
            raise ValueError("predict must be >= 0")
        if self.on_invalid not in ("raise", "quarantine"):
            raise ValueError(f"unknown on_invalid {self.on_invalid!r}")
        if self.endog_var is None and (self.on_invalid == "raise" or self.endog_format != "financial_statement"):
            raise ValueError("all labels at once need a statement and on_invalid='quarantine'")
        if self.model not in MODEL_KINDS:
            raise ValueError(f"unknown model {self.model!r}")
        return self


def load_dataset(spark: SparkSession, cfg: RunConfig) -> PanelDataset:
    endog = import_endogenous(spark, cfg.endog_path, cfg.endog_var, cfg.endog_format, cfg.as_of_year)
    exog = None if cfg.exog_path is None else import_exogenous(spark, cfg.exog_path, cfg.exog_format)
    return align(endog.drop("period"), exog, endog_frequency(cfg.endog_format))


def load_panel(spark: SparkSession, cfg: RunConfig) -> tuple[PanelDataset, DataFrame]:
    """The dataset of all sound series and the ledger of the others, up to the model."""
    faults = None
    if cfg.endog_var is None:
        raw = read_statement(spark, cfg.endog_path)
        endog, faults = statement_series(raw, cfg.as_of_year), statement_quarantine(raw, cfg.as_of_year)
    else:
        endog = import_endogenous(spark, cfg.endog_path, cfg.endog_var, cfg.endog_format, cfg.as_of_year, validate=False)
    freq = endog_frequency(cfg.endog_format)
    names, exog_x = [], None
    if cfg.exog_path is not None:
        exog = import_exogenous(spark, cfg.exog_path, cfg.exog_format)
        names = exog_vars_of(exog)
        exog_x = exog_by_period(exog, names, freq)
    return quarantine(endog, exog_x, freq, names, faults)


def stationarity(ds: PanelDataset) -> DataFrame:
    """Order of differencing by each test, ``(series_id, test, ndiffs)``."""
    tests = [t.select("series_id", F.lit(name).alias("test"), "ndiffs") for name, t in (("adf", ds.ADF_test()), ("kpss", ds.KPSS_test()))]
    return tests[0].unionByName(tests[1])


def run_all(spark: SparkSession, cfg: RunConfig) -> dict[str, DataFrame]:
    """Lazy result tables by name; write them with ``sources.sinks.write_outputs``."""
    cfg.check()
    if cfg.on_invalid == "raise":
        return run_on_dataset(load_dataset(spark, cfg), cfg)
    ds, left_out = load_panel(spark, cfg)
    return run_on_dataset(ds, cfg, left_out=left_out)


def run_on_dataset(
    ds: PanelDataset, cfg: RunConfig, on_invalid: str | None = None, left_out: DataFrame | None = None
) -> dict[str, DataFrame]:
    """The chain after alignment, for data that is already in Spark.

    ``left_out`` is the ledger of :func:`periodica.operators.ledger.quarantine`; the output ``quarantine`` adds to it
    the series that the model refuses.
    """
    on_invalid = on_invalid or cfg.on_invalid
    cfg.check()
    if cfg.exog_vars is not None:
        ds = ds.downsample(cfg.exog_vars)
    out: dict[str, DataFrame] = {}
    if cfg.pca is not None and ds.exog_vars:
        out["pca"] = ds.pca_loadings(cfg.pca)
        ds = ds.PCA(cfg.pca)
    out["data"] = ds.with_labels()
    if cfg.statistics:
        out["stationarity"] = stationarity(ds)
        out["autocorrelation"] = ds.autocorrelation()
    if left_out is not None:
        out["quarantine"] = left_out
    if not (cfg.fit or cfg.predict is not None or cfg.sliding_window is not None):
        return out
    model = make_model(cfg.model, cfg.p_d_q_order, cfg.P_D_Q_order, ds, on_invalid)
    if left_out is not None:
        out["quarantine"] = left_out.unionByName(broken(model.rules(ds), "model"))
    if cfg.fit:
        fitted = model.fit(ds)
        out["fit"] = fitted.coefficients
        out["information"] = fitted.information
        out["diagnostics"] = fitted.diagnostics
    if cfg.predict is not None:
        out["predict"] = model.predict(cfg.predict, ds)
    if cfg.sliding_window is not None:
        out["sliding_window"] = model.sliding_window_forecast(ds, cfg.sliding_window)
    return out
