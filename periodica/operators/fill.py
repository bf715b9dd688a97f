"""Backfill and forward fill of long dated tables without one task per variable.

A window over a whole variable would put a hot variable in one task. Rows are dealt instead by ranges of
(variable, time, tie), which cuts a hot variable, and a hot instant of it, into as many pieces as their size asks for. Each
partition reports what it holds at its two edges; what flows over an edge is resolved on that table of one row a partition,
and rows then look only inside their own variable in their own partition, plus the two values that flow in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from periodica.session import materialize


def _edges(placed: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """One row a partition: its first and its last variable, each with its first and last value there."""
    at = F.when(F.col(value).isNotNull(), F.struct(*order))
    own = placed.groupBy("_pid", *keys).agg(F.min_by(value, at).alias("_first"), F.max_by(value, at).alias("_last"))
    facts = F.struct(*keys, "_first", "_last")
    return own.groupBy("_pid").agg(F.min_by(facts, F.struct(*keys)).alias("low"), F.max_by(facts, F.struct(*keys)).alias("high"))


def _flows(edges: Sequence[Row], keys: list[str]) -> list[tuple]:
    """(partition, its first variable, value that flows into it from before, its last variable, value that flows in from after)."""
    def name(edge: Row) -> tuple:
        return tuple(edge[k] for k in keys)

    before, held = [], None
    for e in edges:
        low, high = name(e["low"]), name(e["high"])
        inflow = held[1] if held is not None and held[0] == low else None
        before.append(inflow)
        out = e["high"]["_last"]
        held = high, inflow if out is None and low == high else out
    after, held = [], None
    for e in reversed(edges):
        low, high = name(e["low"]), name(e["high"])
        inflow = held[1] if held is not None and held[0] == high else None
        after.append(inflow)
        out = e["low"]["_first"]
        held = low, inflow if out is None and low == high else out
    return [(e["_pid"], name(e["low"]), b, name(e["high"]), a) for e, b, a in zip(edges, before, reversed(after), strict=True)]


def _nearest(part: list[str], order: list[str], value: str) -> tuple[Column, Column]:
    # "rows ... unbounded following" is quadratic in Spark, so the later
    # neighbour is read from a descending window with a growing frame.
    back = Window.partitionBy(*part).orderBy(*[F.col(c).desc() for c in order])
    fore = Window.partitionBy(*part).orderBy(*order)
    seen = (Window.unboundedPreceding, -1)
    return (
        F.last(value, ignorenulls=True).over(back.rowsBetween(*seen)),
        F.last(value, ignorenulls=True).over(fore.rowsBetween(*seen)),
    )


def backfill_forward_fill(
    df: DataFrame,
    keys: Sequence[str] = ("var",),
    ts: str = "ts",
    tie: Sequence[str] = ("row_no",),
    value: str = "value",
    partitions: int | None = None,
) -> DataFrame:
    """Null values take the next later value, else the last earlier one.

    Ties on ``ts`` are ordered by the ``tie`` columns. Rows are dealt to ``partitions`` ranges (the session's number of
    shuffle partitions unless given) and written once, because ranges come from a sample and must not be drawn again.
    """
    spark, keys, order = df.sparkSession, list(keys), [ts, *tie]
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(df.repartitionByRange(parts, *keys, *order).withColumn("_pid", F.spark_partition_id()))
    edges = _edges(placed, keys, order, value).orderBy("_pid").collect()  # one row a partition
    types = {f.name: f.dataType for f in df.schema.fields}
    names = StructType([StructField(k, types[k]) for k in keys])
    flow_type = StructType([
        StructField("_pid", IntegerType()), StructField("_low", names), StructField("_before", types[value]),
        StructField("_high", names), StructField("_after", types[value]),
    ])
    flows = F.broadcast(spark.createDataFrame(_flows(edges, keys), flow_type))
    later, earlier = _nearest(["_pid", *keys], order, value)
    rows = placed.select("*", later.alias("_next"), earlier.alias("_prev")).join(flows, "_pid")
    name = F.struct(*keys)
    from_after = F.when(name.eqNullSafe(F.col("_high")), F.col("_after"))
    from_before = F.when(name.eqNullSafe(F.col("_low")), F.col("_before"))
    return rows.withColumn(value, F.coalesce(value, "_next", from_after, "_prev", from_before)).select(*df.columns)


def drop_empty_vars(filled: DataFrame, value: str = "value") -> DataFrame:
    """After filling, a null can only belong to a variable with no value at all."""
    return filled.filter(F.col(value).isNotNull())
