"""Work units: one row per (series, order), fitted in Arrow batches.

The UDFs are marked nondeterministic so that the optimizer never copies one into
a filter above it and pays for every fit twice.

Orders with products of lag polynomials or moving-average terms need iteration.
Each series is packed once (bounded by the calendar), spread over the cluster by
(series, block of orders), and its orders are unfolded next to it without
another shuffle. One Python call handles a whole Arrow batch and stacks units of
the same shape, so windows and series of one order are solved together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from periodica.functions import css
from periodica.operators.align import PanelDataset
from periodica.operators.orders import ORDER_COLS
from periodica.operators.panel import dataset_arrays

#: Series of one task in a panel too small to fill the cluster.
GROUP_SIZE = 64
TASKS_PER_PARTITION = 4
#: Values of one stacked solve (rows times design columns).
STACK_BUDGET = 4_000_000


def series_units(ds: PanelDataset, orders: DataFrame, per_series: DataFrame | None = None) -> DataFrame:
    """Series arrays next to every order of ``orders`` (``order_id`` and order columns).

    Columns of ``per_series`` join while a series still is one row, and replace
    order columns of the same name.
    """
    arrays = dataset_arrays(ds.df)
    if per_series is not None:
        arrays = arrays.join(per_series, "series_id")
    parts = int(ds.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_series = max(1, ds.df.select("series_id").distinct().count())
    # a large panel fills the cluster by itself; a small one has its orders spread, each series
    # travelling in n_blocks copies (at most GROUP_SIZE copies per task, whatever the panel)
    tasks = TASKS_PER_PARTITION * parts
    groups = min(tasks, -(-n_series // GROUP_SIZE))
    n_blocks = max(1, -(-tasks // groups))
    packed = orders.agg(F.sort_array(F.collect_list(F.struct("order_id", *ORDER_COLS)))).scalar()
    blocks = F.sequence(F.lit(0), F.lit(n_blocks - 1))
    # one partition per (group of series, block of orders): units of one order meet in one batch
    target = F.pmod(F.hash("series_id"), F.lit(groups)) * n_blocks + F.col("_b")
    spread = arrays.withColumn("_b", F.explode(blocks)).repartitionById(groups * n_blocks, target)
    # hashed, because neighbouring orders of a grid cost alike
    mine = F.filter("_all", lambda o: F.pmod(F.hash(o["order_id"]), F.lit(n_blocks)) == F.col("_b"))
    keep = arrays.columns
    from_order = [F.col(f"_o.{c}").alias(c) for c in ("order_id", *ORDER_COLS) if c not in keep]
    return spread.withColumn("_all", packed).select(*keep, F.explode(mine).alias("_o")).select(*keep, *from_order)


def _shapes(pdf: pd.DataFrame, extra: list[str]):
    """Row groups of one batch that share order and array shape, cut to a fixed memory budget."""
    keys = [*ORDER_COLS, "n", "nx", *extra]
    for key, rows in pdf.groupby(keys, sort=False).indices.items():
        named = dict(zip(keys, key))
        width = named["nx"] + named["p"] + named["q"] + named["sp"] + named["sq"] + 3
        step = max(1, int(STACK_BUDGET // (named["n"] * width)))
        for lo in range(0, len(rows), step):
            yield named, rows[lo : lo + step]


def _stack(pdf: pd.DataFrame, rows: np.ndarray, n: int, nx: int):
    y = np.stack([np.asarray(v, dtype=float) for v in pdf["y"].to_numpy()[rows]])
    x = np.stack([np.asarray(v, dtype=float).reshape(n, nx) for v in pdf["x"].to_numpy()[rows]])
    return y, x


def _order(named: dict, trend: str) -> css.Order:
    return css.Order(*[int(named[c]) for c in ORDER_COLS], trend=trend)


def unit_columns(*extra: str) -> Column:
    return F.struct(*ORDER_COLS, "n", "nx", "y", "x", *extra)


def fit_udf(trend: str, steps: int):
    """Fit (and forecast ``steps`` periods of) every unit of a batch."""

    @F.pandas_udf(
        "est array<double>, se array<double>, n_eff bigint, sse double, adjusted boolean,"
        " first_row int, resid array<double>, ahead array<double>"
    )
    def run(units: pd.DataFrame) -> pd.DataFrame:
        size = len(units)
        out = {
            "est": [None] * size, "se": [None] * size, "n_eff": [0] * size, "sse": [None] * size,
            "adjusted": [None] * size, "first_row": [None] * size, "resid": [None] * size, "ahead": [None] * size,
        }
        for named, rows in _shapes(units, ["n_future"]):
            order, n, nx = _order(named, trend), int(named["n"]), int(named["nx"])
            y, x = _stack(units, rows, n, nx)
            f = css.fit(y, x, order)
            if f is None:
                continue
            ahead = None
            if steps and (nx == 0 or named["n_future"] >= steps):
                fx = np.zeros((len(rows), steps, 0)) if nx == 0 else np.stack(
                    [np.asarray(v, dtype=float).reshape(-1, nx)[:steps] for v in units["fx"].to_numpy()[rows]]
                )
                ahead = css.forecast(y, x, fx, f, order, steps)
            for i, r in enumerate(rows):
                out["est"][r], out["se"][r] = f.est[i].tolist(), f.se[i].tolist()
                out["n_eff"][r], out["sse"][r] = f.resid.shape[1], float(f.sse[i])
                out["adjusted"][r], out["first_row"][r] = bool(f.adjusted[i]), int(f.first)
                out["resid"][r] = f.resid[i].tolist()
                if ahead is not None:
                    out["ahead"][r] = ahead[i].tolist()
        return pd.DataFrame(out)

    return run.asNondeterministic()


def rolling_udf(trend: str):
    """One-step forecasts of every window of every unit of a batch."""

    @F.pandas_udf("array<double>")
    def run(units: pd.DataFrame) -> pd.Series:
        out = [None] * len(units)
        for named, rows in _shapes(units, ["w"]):
            n, nx = int(named["n"]), int(named["nx"])
            y, x = _stack(units, rows, n, nx)
            got = css.rolling_forecast(y, x, int(named["w"]), _order(named, trend))
            for i, r in enumerate(rows):
                out[r] = got[i].tolist()
        return pd.Series(out)

    return run.asNondeterministic()


def information_udf(trend: str):
    """Sum of squares of every unit over all rows that differencing leaves."""

    @F.pandas_udf("sse double, n_eff bigint")
    def run(units: pd.DataFrame) -> pd.DataFrame:
        sse, n_eff = [np.nan] * len(units), [0] * len(units)
        for named, rows in _shapes(units, []):
            y, x = _stack(units, rows, int(named["n"]), int(named["nx"]))
            f = css.fit(y, x, _order(named, trend), robust=False, whole=True)
            if f is None:
                continue
            for i, r in enumerate(rows):
                sse[r], n_eff[r] = float(f.sse[i]), f.resid.shape[1]
        return pd.DataFrame({"sse": sse, "n_eff": n_eff})

    return run.asNondeterministic()
