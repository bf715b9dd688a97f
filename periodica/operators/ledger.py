"""Series left out along the chain, as rows ``(series_id, stage, reason)``.

A series is listed at the first stage that refuses it, once for every rule it breaks there, and takes no part in later
stages. Stages, in order: ``import`` (a label that cannot be read), ``series`` (a null, a repeated period, a gap),
``align`` (no shared period, a period without variables), ``dataset`` (the rules of an aligned dataset, such as a value
that is not finite) and ``model`` (too few rows for its terms). The ledger has a few rows per refused series; it is
written once, and series are dropped by anti-joins against it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from periodica.operators.align import PanelDataset, align_by_period, series_spans_ok
from periodica.operators.quality import series_rules
from periodica.session import materialize

STAGES = ("import", "series", "align", "dataset", "model")
LEDGER_SCHEMA = "series_id string, stage string, reason string"


def broken(rules: DataFrame, stage: str) -> DataFrame:
    """Ledger rows of broken rules; a rule that cannot be decided counts as broken."""
    return _rows(rules.filter(~F.coalesce("ok", F.lit(False))), stage, "rule")


def _rows(df: DataFrame, stage: str, reason: str) -> DataFrame:
    return df.select(F.col("series_id").cast("string").alias("series_id"), F.lit(stage).alias("stage"), F.col(reason).alias("reason"))


def _without(df: DataFrame, ledger: DataFrame) -> DataFrame:
    return df.join(ledger.select("series_id").distinct(), "series_id", "left_anti")


def quarantine(
    endog: DataFrame, exog_x: DataFrame | None, freq: str, exog_vars: Sequence[str] = (), import_faults: DataFrame | None = None
) -> tuple[PanelDataset, DataFrame]:
    """The aligned dataset of the series that pass every rule, and the ledger of the others.

    ``endog`` and ``exog_x`` are as for ``align_by_period``; ``import_faults`` are rows ``(series_id, reason)`` of
    series that never became rows of ``endog``.
    """
    endog = materialize(endog.select("series_id", "period_idx", "y"))
    at_import = endog.sparkSession.createDataFrame([], LEDGER_SCHEMA) if import_faults is None else _rows(import_faults, "import", "reason")
    first = materialize(at_import.unionByName(broken(series_rules(endog), "series")))
    sound = _without(endog, first)
    rows = align_by_period(sound, exog_x, freq, exog_vars, on_invalid="keep")
    met = rows.df.select("series_id").distinct()
    spans = broken(series_spans_ok(rows.df, len(exog_vars)), "align").unionByName(
        _rows(sound.select("series_id").distinct().join(met, "series_id", "left_anti").withColumn("rule", F.lit("overlaps")), "align", "rule")
    )
    second = materialize(spans)
    aligned = PanelDataset(_without(rows.df, second), freq, tuple(exog_vars))
    third = materialize(broken(aligned.rules(), "dataset"))
    kept = PanelDataset(_without(aligned.df, third), freq, tuple(exog_vars)).materialize()
    return kept, first.unionByName(second).unionByName(third)
