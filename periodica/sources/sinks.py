"""Tabular sinks: one directory per named output."""

from __future__ import annotations

from pyspark.sql import DataFrame

OUTPUT_NAMES = (
    "data", "pca", "fit", "information", "diagnostics", "predict", "sliding_window",
    "stationarity", "autocorrelation", "quarantine",
)


def write_table(
    df: DataFrame,
    directory: str,
    fmt: str = "parquet",
    order_by: list[str] | None = None,
    mode: str = "errorifexists",
) -> str:
    """Write ``df``; ``order_by`` gives globally sorted part files (range shuffle, no single task)."""
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"unknown sink format {fmt!r}")
    out = df.orderBy(*order_by) if order_by else df
    writer = out.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(directory)
    return directory


def write_outputs(
    outputs: dict[str, DataFrame], base: str, fmt: str = "csv", mode: str = "errorifexists"
) -> dict[str, str]:
    """Write every named output under ``base`` and return the directories."""
    return {
        name: write_table(df, f"{base.rstrip('/')}/{name}", fmt, mode=mode)
        for name, df in outputs.items()
        if name in OUTPUT_NAMES
    }
