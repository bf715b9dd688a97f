"""Model orders as an ordinary table, with the two validity rules as columns.

Columns ``p d q sp sd sq m``: seasonal terms carry an ``s`` because Spark column
names ignore case. ``order_id`` is the lexicographic rank in the grid.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ORDER_COLS = ("p", "d", "q", "sp", "sd", "sq", "m")
ORDER_SCHEMA = "order_id bigint, p int, d int, q int, sp int, sd int, sq int, m int"
TREND_TERMS = 1

# Automatic search: start values and caps (fixed values).
AUTO_PDQ = (2, None, 2)
AUTO_SEASONAL = (1, None, 1, 4)
AUTO_MAX_PQ = 5
AUTO_MAX_SEASONAL = 2
AUTO_MAX_TOTAL = 5


def check_order(pdq: Sequence[int | None], seasonal: Sequence[int | None], auto: bool = False) -> None:
    """Lengths 3 and 4, whole numbers, season of at least 2; d and D may be open in auto mode."""
    if len(pdq) != 3 or len(seasonal) != 4:
        raise AssertionError("order must be (p, d, q) and (P, D, Q, m)")
    for i, v in enumerate(list(pdq) + list(seasonal)):
        if v is None and auto and i in (1, 4):
            continue
        if v is None or v < 0:
            raise AssertionError("order terms must be whole numbers")
    if seasonal[3] < 2:
        raise AssertionError("the season must be at least 2")


def repeated_lags(pdq: Sequence[int], seasonal: Sequence[int]) -> set[int]:
    """Lags that occur both as ordinary and as seasonal lag of the same kind."""
    p, _, q = pdq
    sp, _, sq, m = seasonal
    return {m * i for i in range(1, sp + 1) if m * i <= p} | {m * i for i in range(1, sq + 1) if m * i <= q}


def orders_table(spark: SparkSession, orders: Sequence[tuple[Sequence[int], Sequence[int]]]) -> DataFrame:
    """A short explicit list of orders."""
    rows = [(i, *map(int, pdq), *map(int, seasonal)) for i, (pdq, seasonal) in enumerate(orders)]
    return spark.createDataFrame(rows, ORDER_SCHEMA)


def order_grid(spark: SparkSession, ranges: Sequence[range]) -> DataFrame:
    """Every combination of seven ranges, in lexicographic order.

    The rank is decoded in mixed radix from one distributed range, so the grid is
    never listed on the driver and needs no product of tables.
    """
    if len(ranges) != len(ORDER_COLS):
        raise ValueError("ranges must be given for p, d, q, P, D, Q and m")
    total = 1
    for r in ranges:
        total *= len(r)
    cols, stride = [], total
    for name, r in zip(ORDER_COLS, ranges):
        if not len(r):
            cols.append(F.lit(0).cast("int").alias(name))
            continue
        stride //= len(r)
        digit = F.floor(F.col("id") / stride) % len(r)
        cols.append((F.lit(r.start) + digit * r.step).cast("int").alias(name))
    return spark.range(total).select(F.col("id").alias("order_id"), *cols)


def brute_ranges(pdq: Sequence[int], seasonal: Sequence[int]) -> tuple[range, ...]:
    """Ranges 0..p, 0..d, ... with a fixed season."""
    *terms, m = list(pdq) + list(seasonal)
    return tuple(range(v + 1) for v in terms) + (range(m, m + 1),)


def auto_ranges(m: int) -> tuple[range, ...]:
    pq, s = range(AUTO_MAX_PQ + 1), range(AUTO_MAX_SEASONAL + 1)
    return pq, range(1), pq, s, range(1), s, range(m, m + 1)


def auto_grid(spark: SparkSession, m: int) -> DataFrame:
    """Candidates of the automatic search under its caps; d and D are filled in later."""
    grid = order_grid(spark, auto_ranges(m))
    return grid.filter(F.col("p") + F.col("q") + F.col("sp") + F.col("sq") <= AUTO_MAX_TOTAL).filter(~repeats())


def total_order() -> Column:
    return F.col("p") + F.col("q") + F.col("sp") + F.col("sq")


def repeats() -> Column:
    """True when an ordinary and a seasonal lag coincide."""

    def lags(n: str, step: Column) -> Column:
        some = F.transform(F.sequence(F.lit(1), F.greatest(F.col(n), F.lit(1))), lambda i: i * step)
        return F.when(F.col(n) > 0, some).otherwise(F.array().cast("array<int>"))

    one, m = F.lit(1), F.col("m")
    return F.arrays_overlap(lags("p", one), lags("sp", m)) | F.arrays_overlap(lags("q", one), lags("sq", m))


def overspecified(n: Column | str, n_exog: Column | int) -> Column:
    """Not (variables + lag terms + trend < observations); differencing is not counted."""
    rows = F.col(n) if isinstance(n, str) else n
    return ~(total_order() + TREND_TERMS + n_exog < rows)


def order_rules(endog: DataFrame, orders: DataFrame, n_exog: int) -> DataFrame:
    """``(series_id, order_id, n, repeated_lags, overspecified)``.

    Each series row carries the packed order list and unfolds it in place, so no
    product of tables is shuffled.
    """
    counts = endog.groupBy("series_id").agg(F.count("*").alias("n"))
    units = with_orders(counts, orders)
    return units.select(
        "series_id",
        "order_id",
        "n",
        repeats().alias("repeated_lags"),
        overspecified("n", n_exog).alias("overspecified"),
    )


def with_orders(df: DataFrame, orders: DataFrame) -> DataFrame:
    """Unfold every order next to every row; the order list travels as one scalar value."""
    packed = orders.agg(F.sort_array(F.collect_list(F.struct("order_id", *ORDER_COLS)))).scalar()
    keep = df.columns
    return df.select(*keep, F.explode(packed).alias("_o")).select(*keep, "_o.*")
