"""One array per series.

A series has at most one row per calendar period, so its array is bounded by the
calendar (see ``CALENDAR_PERIODS``), never by the size of the raw input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def series_arrays(endog: DataFrame) -> DataFrame:
    """``(series_id, first_idx, n, y)`` with ``y`` in period order."""
    packed = endog.groupBy("series_id").agg(
        F.sort_array(F.collect_list(F.struct("period_idx", "y"))).alias("_s")
    )
    return packed.select(
        "series_id",
        F.get("_s", F.lit(0))["period_idx"].alias("first_idx"),
        F.size("_s").alias("n"),
        F.col("_s.y").alias("y"),
    )


def dataset_arrays(df: DataFrame) -> DataFrame:
    """Realized and future arrays of an aligned dataset, variables flattened row by row."""
    packed = df.groupBy("series_id").agg(
        F.sort_array(F.collect_list(F.struct("period_idx", "is_future", "y", "x"))).alias("_s")
    )
    real = F.filter("_s", lambda r: ~r["is_future"])
    fut = F.filter("_s", lambda r: r["is_future"])
    return (
        packed.select("series_id", real.alias("_r"), fut.alias("_f"))
        .filter(F.size("_r") > 0)
        .select(
            "series_id",
            F.col("_r")[0]["period_idx"].alias("first_idx"),
            F.size("_r").alias("n"),
            F.size(F.col("_r")[0]["x"]).alias("nx"),
            F.col("_r.y").alias("y"),
            F.flatten("_r.x").alias("x"),
            F.size("_f").alias("n_future"),
            F.flatten("_f.x").alias("fx"),
        )
    )
