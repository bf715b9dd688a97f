"""Autoregressive orders as Spark moments: lags by window, cross products by aggregation.

Without moving-average terms the model needs only the products of ``[1, t, differenced x, lagged z, lagged x]``: ordinary
least squares where its coefficients are free, and an iteration on the same matrix where lag polynomials multiply
(:mod:`periodica.operators.lag_products`). Spark builds the design columns and sums their products (whole series or
sliding window); only the small symmetric matrices reach numpy, one stacked solve per Arrow batch.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from periodica.functions.css import Order, pull_inside
from periodica.operators.align import PanelDataset
from periodica.operators.lag_products import LagProduct, design_width, product_lags, scaled_pinv, unpack

#: Beyond this many design columns the products no longer fit one aggregation.
MAX_COLUMNS = 40
#: Orders whose windows are unfolded next to a row in one plan.
ORDERS_PER_PLAN = 32


def on_moments(order: Order, n_exog: int) -> bool:
    """Whether an order is answered by sums of products (no moving-average terms, not too wide)."""
    return order.q + order.sq == 0 and design_width(order, n_exog) <= MAX_COLUMNS


def is_linear(order: Order, n_exog: int) -> bool:
    """Whether its coefficients are free, so that one least-squares solve answers it."""
    one_kind = order.p == 0 or order.sp == 0
    no_product = n_exog == 0 or order.p + order.sp == 0
    return on_moments(order, n_exog) and one_kind and no_product


def centered(order: Order) -> bool:
    """With an intercept and no differencing, series means can be taken out first."""
    return order.trend == "ct" and order.lost == 0


def design(ds: PanelDataset, order: Order) -> DataFrame:
    """Realized rows ``(series_id, period_idx, t, n, y, z, v, y_mean, x_mean)``.

    ``v`` is the regressor vector of the row and null where a lag is missing.
    """
    nv = len(ds.exog_vars)
    whole = Window.partitionBy("series_id")
    run = whole.orderBy("period_idx")
    rows = ds.realized.select(
        "series_id",
        "period_idx",
        "y",
        F.count("*").over(whole).alias("n"),
        (F.col("period_idx") - F.min("period_idx").over(whole) + 1).cast("double").alias("t"),
        *[F.get("x", F.lit(i)).alias(f"_x{i}") for i in range(nv)],
    )
    if centered(order):
        rows = rows.select(
            "*", F.avg("y").over(whole).alias("y_mean"),
            *[F.avg(f"_x{i}").over(whole).alias(f"_m{i}") for i in range(nv)],
        )
    else:
        rows = rows.select("*", F.lit(0.0).alias("y_mean"), *[F.lit(0.0).alias(f"_m{i}") for i in range(nv)])
    keep = ["series_id", "period_idx", "y", "n", "t", "y_mean", *[f"_m{i}" for i in range(nv)]]
    rows = rows.select(
        *keep, (F.col("y") - F.col("y_mean")).alias("z"),
        *[(F.col(f"_x{i}") - F.col(f"_m{i}")).alias(f"_x{i}") for i in range(nv)],
    )
    for step in [order.m] * order.sd + [1] * order.d:
        rows = rows.select(
            *keep, *[(F.col(c) - F.lag(c, step).over(run)).alias(c) for c in ["z", *[f"_x{i}" for i in range(nv)]]]
        )
    steps = product_lags(order)
    rows = rows.select(
        "*", *[F.lag("z", s).over(run).alias(f"_l{s}") for s in steps],
        *[F.lag(f"_x{i}", s).over(run).alias(f"_x{i}l{s}") for s in steps for i in range(nv)],
    )
    trend = [F.lit(1.0), F.col("t")] if order.trend == "ct" else [F.col("t")]
    parts = trend + [F.col(f"_x{i}") for i in range(nv)] + [F.col(f"_l{s}") for s in steps]
    parts += [F.col(f"_x{i}l{s}") for s in steps for i in range(nv)]
    ready = F.col("t") > order.lost + order.ar_span
    return rows.select(
        "series_id", "period_idx", "t", "n", "y", "z", "y_mean",
        F.array(*[F.col(f"_m{i}") for i in range(nv)]).cast("array<double>").alias("x_mean"),
        F.when(ready, F.array(*parts)).alias("v"),
    )


def products(k: int) -> list[Column]:
    """Upper triangle of the outer product of ``(v, z)``, row by row."""
    cols = [F.get("v", F.lit(i)) for i in range(k)] + [F.col("z")]
    return [cols[i] * cols[j] for i in range(k + 1) for j in range(i, k + 1)]


def gram_solver(order: Order, n_exog: int):
    """Parameters and design coefficients from packed products."""
    k, terms = design_width(order, n_exog), order.p + order.sp
    free = is_linear(order, n_exog)
    product = LagProduct(order, n_exog)

    @F.pandas_udf("coef array<double>, par array<double>, adjusted boolean, converged boolean")
    def solve(packed: pd.Series) -> pd.DataFrame:
        g = unpack(np.stack(packed.to_numpy()).astype(float), k + 1)
        if not free:
            s = product.solve(g)
            return pd.DataFrame({"coef": s.coef.tolist(), "par": s.par.tolist(), "adjusted": s.adjusted, "converged": s.converged})
        a, b = g[:, :k, :k], g[:, :k, k]
        coef = np.einsum("bij,bj->bi", scaled_pinv(a, 1e-11), b)
        hit = np.zeros(len(coef), dtype=bool)
        if terms:
            inside, hit = pull_inside(coef[:, k - terms :], 1.0)
            if hit.any():  # lag terms fixed at the pulled value, the rest solved again
                f = k - terms
                rest = b[hit, :f] - np.einsum("bij,bj->bi", a[hit][:, :f, f:], inside[hit])
                coef[hit, :f] = np.einsum("bij,bj->bi", scaled_pinv(a[hit][:, :f, :f], 1e-11), rest)
                coef[hit, f:] = inside[hit]
        return pd.DataFrame({"coef": coef.tolist(), "par": coef.tolist(), "adjusted": hit, "converged": True})

    return solve.asNondeterministic()  # never copied into a filter above it


def linear_fit(ds: PanelDataset, order: Order) -> DataFrame:
    """``(series_id, n, n_eff, gram, y_mean, x_mean, coef, par, adjusted, converged)`` from one grouped pass.

    ``coef`` are the coefficients of the design columns, ``par`` the parameters they follow from.
    """
    nv = len(ds.exog_vars)
    rows = design(ds, order).filter(F.col("v").isNotNull())
    sums = [F.sum(c) for c in products(design_width(order, nv))]
    grams = rows.groupBy("series_id").agg(
        F.first("n").alias("n"), F.count("*").alias("n_eff"), F.array(*sums).alias("gram"),
        F.first("y_mean").alias("y_mean"), F.first("x_mean").alias("x_mean"),
    )
    return grams.withColumn("_s", gram_solver(order, nv)("gram")).select(
        "series_id", "n", "n_eff", "gram", "y_mean", "x_mean", "_s.coef", "_s.par", "_s.adjusted", "_s.converged"
    )


def fitted(v: Column, coef: Column) -> Column:
    return F.aggregate(F.zip_with(v, coef, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def lag_gain(par: Column, order: Order, n_exog: int) -> Column:
    """``phi(1) Phi(1)`` of the parameters: what the lag polynomials leave of a constant."""
    first, gain = order.trend_cols + n_exog, F.lit(1.0)
    for start, count in ((first, order.p), (first + order.p, order.sp)):
        if count:
            gain = gain * (1 - F.aggregate(F.slice(par, start + 1, count), F.lit(0.0), lambda s, v: s + v))
    return gain


def raw_coefficients(fits: DataFrame, order: Order, n_exog: int) -> DataFrame:
    """Add ``est``: the parameters for the uncentred data, by expression only."""
    if not centered(order):
        return fits.withColumn("est", F.col("par"))
    level = F.col("y_mean")
    if n_exog:
        level = level - fitted(F.slice("par", 3, n_exog), F.col("x_mean"))
    shift = level * lag_gain(F.col("par"), order, n_exog)
    rest = F.slice("par", 2, 1 + n_exog + order.p + order.sp)
    return fits.withColumn("est", F.concat(F.array(F.col("par")[0] + shift), rest))


def linear_residuals(ds: PanelDataset, order: Order, fits: DataFrame) -> DataFrame:
    """Design rows with their residual: second pass, joined on the series."""
    rows = design(ds, order).filter(F.col("v").isNotNull()).select("series_id", "period_idx", "z", "v")
    return rows.join(fits.select("series_id", "coef"), "series_id").withColumn(
        "resid", F.col("z") - fitted(F.col("v"), F.col("coef"))
    )


def linear_estimates(ds: PanelDataset, order: Order, fits: DataFrame) -> DataFrame:
    """``(series_id, n, n_eff, sse, adjusted, est, se)`` with robust standard errors.

    The second pass sums squared residuals times the products of the regressors.
    """
    nv = len(ds.exog_vars)
    k = design_width(order, nv)
    res = linear_residuals(ds, order, fits)
    e2 = F.col("resid") * F.col("resid")
    v = [F.get("v", F.lit(i)) for i in range(k)]
    meat = [F.sum(e2 * v[i] * v[j]) for i in range(k) for j in range(i, k)]
    sums = res.groupBy("series_id").agg(F.sum(e2).alias("sse"), F.array(*meat).alias("meat"))
    shift, product, g = centered(order), LagProduct(order, nv), order.trend_cols

    @F.pandas_udf("array<double>")
    def errors(gram: pd.Series, meat: pd.Series, par: pd.Series, y_mean: pd.Series, x_mean: pd.Series) -> pd.Series:
        p = np.stack(par.to_numpy()).astype(float)
        d = product.jacobian(p)
        a = np.swapaxes(d, 1, 2) @ unpack(np.stack(gram.to_numpy()).astype(float), k + 1)[:, :k, :k] @ d
        bread = scaled_pinv(a, 1e-13)
        cov = bread @ (np.swapaxes(d, 1, 2) @ unpack(np.stack(meat.to_numpy()).astype(float), k) @ d) @ bread
        to_raw = np.tile(np.eye(d.shape[2]), (len(cov), 1, 1))
        if shift:  # the intercept of the uncentred data moves with the other parameters
            lag_sum, by_lag = product.polynomial(p[:, g + nv :])
            level = y_mean.to_numpy()
            if nv:
                means = np.stack(x_mean.to_numpy())
                level = level - (p[:, g : g + nv] * means).sum(axis=1)
                to_raw[:, 0, g : g + nv] = -means * (1.0 - lag_sum.sum(axis=1))[:, None]
            to_raw[:, 0, g + nv :] = -level[:, None] * by_lag.sum(axis=1)
        cov = to_raw @ cov @ np.swapaxes(to_raw, 1, 2)
        return pd.Series(np.sqrt(np.maximum(np.diagonal(cov, axis1=1, axis2=2), 0.0)).tolist())

    return (
        raw_coefficients(fits, order, nv)
        .join(sums, "series_id")
        .withColumn("se", errors("gram", "meat", "par", "y_mean", "x_mean"))
        .select("series_id", "n", "n_eff", "sse", "adjusted", "converged", "est", "se")
    )


def linear_forecast(ds: PanelDataset, order: Order, estimates: DataFrame, steps: int, residuals: DataFrame | None = None) -> DataFrame:
    """``(series_id, h, period_idx, prediction)`` by a fold over the future rows of a series.

    The fold keeps the last levels of ``u = y - x beta`` and applies the lag and
    difference polynomials as one recursion. Moving-average terms weigh the last
    ``residuals`` (series_id, period_idx, resid).
    """
    g, nv = order.trend_cols, len(ds.exog_vars)
    span = order.lost + order.ar_span
    whole = Window.partitionBy("series_id")
    est = F.col("est")
    beta = F.slice(est, g + 1, max(nv, 1)) if nv else F.array().cast("array<double>")
    rows = ds.df.withColumn("_last", F.max(F.when(~F.col("is_future"), F.col("period_idx"))).over(whole)).withColumn(
        "_first", F.min(F.when(~F.col("is_future"), F.col("period_idx"))).over(whole)
    )
    near = rows.filter(
        (~F.col("is_future") & (F.col("period_idx") > F.col("_last") - max(span, 1)))
        | (F.col("is_future") & (F.col("period_idx") <= F.col("_last") + steps))
    )
    packed = near.groupBy("series_id").agg(
        F.first("_last").alias("last"),
        F.first("_first").alias("first"),
        F.sort_array(F.collect_list(F.when(~F.col("is_future"), F.struct("period_idx", "y", "x")))).alias("past"),
        F.sort_array(F.collect_list(F.when(F.col("is_future"), F.struct("period_idx", "x")))).alias("ahead"),
    ).join(estimates.select("series_id", "est"), "series_id")
    shocks = error_weights(order, g + nv + order.p + order.sp)
    if shocks:
        late = residuals.withColumn("_back", F.row_number().over(Window.partitionBy("series_id").orderBy(F.col("period_idx").desc())))
        late = late.filter(F.col("_back") <= max(shocks)).groupBy("series_id").agg(
            F.transform(F.sort_array(F.collect_list(F.struct("_back", "resid"))), lambda r: r["resid"]).alias("shocks")
        )
        packed = packed.join(late, "series_id")

    def effect(x: Column) -> Column:
        return fitted(x, beta) if nv else F.lit(0.0)

    poly = _full_polynomial(order, g + nv)
    past = F.transform("past", lambda r: r["y"] - effect(r["x"]))
    hist = F.slice(past, -span, span) if span else F.array().cast("array<double>")
    start = F.struct(hist.alias("hist"), F.array().cast("array<double>").alias("out"))
    t0 = (F.col("last") - F.col("first") + 1).cast("double")

    def step(acc: Column, h: Column) -> Column:
        t = t0 + h
        drift = est[0] + est[1] * t if order.trend == "ct" else est[0] * t
        ar = F.lit(0.0)
        for lag, weight in poly.items():
            ar = ar + weight * F.element_at(acc["hist"], F.lit(-lag))
        u = drift - ar
        for lag, weight in shocks.items():  # errors after the last row are expected to be zero
            u = u + F.when(h <= lag, weight * F.coalesce(F.get("shocks", lag - h), F.lit(0.0))).otherwise(F.lit(0.0))
        gain = effect(F.get("ahead", h - 1)["x"]) if nv else F.lit(0.0)
        keep = F.concat(F.slice(acc["hist"], -(span - 1), span - 1), F.array(u)) if span > 1 else (
            F.array(u) if span else acc["hist"]
        )
        return F.struct(keep.alias("hist"), F.concat(acc["out"], F.array(u + gain)).alias("out"))

    run = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda a: a["out"])
    return packed.select("series_id", "last", F.posexplode(run).alias("pos", "prediction")).select(
        "series_id", (F.col("pos") + 1).alias("h"), (F.col("last") + F.col("pos") + 1).alias("period_idx"), "prediction"
    )


def _full_polynomial(order: Order, offset: int) -> dict[int, Column]:
    """Weights of lag 1.. of ``phi(B) Phi(B^m) (1-B)^d (1-B^m)^D`` as columns over ``est``."""
    phi = {i + 1: F.col("est")[offset + i] for i in range(order.p)}
    seasonal = {order.m * (j + 1): F.col("est")[offset + order.p + j] for j in range(order.sp)}
    ar = {0: F.lit(1.0), **{lag: -c for lag, c in phi.items()}}
    for lag, c in seasonal.items():
        for i, first in [(0, F.lit(1.0)), *[(i, -f) for i, f in phi.items()]]:
            ar[i + lag] = ar.get(i + lag, F.lit(0.0)) - first * c
    out: dict[int, Column] = {}
    for j, w in difference_weights(order).items():
        for lag, c in ar.items():
            if j + lag:
                out[j + lag] = out.get(j + lag, F.lit(0.0)) + float(w) * c
    return out


def error_weights(order: Order, offset: int) -> dict[int, Column]:
    """Weights of lag 1.. of ``theta(B) Theta(B^m)`` as columns over ``est``."""
    theta = {i + 1: F.col("est")[offset + i] for i in range(order.q)}
    out = dict(theta)
    for j in range(order.sq):
        c, lag = F.col("est")[offset + order.q + j], order.m * (j + 1)
        for i, first in [(0, F.lit(1.0)), *theta.items()]:
            out[i + lag] = out.get(i + lag, F.lit(0.0)) + first * c
    return out


def difference_weights(order: Order) -> dict[int, float]:
    """Weights of the lags in ``(1-B)^d (1-B^m)^D``."""
    diff = np.array([1.0])
    for s in [order.m] * order.sd + [1] * order.d:
        f = np.zeros(s + 1)
        f[0], f[s] = 1.0, -1.0
        diff = np.convolve(diff, f)
    return {j: float(w) for j, w in enumerate(diff) if w}


# --- sliding windows -----------------------------------------------------------------------


def window_rows(ds: PanelDataset, orders: Sequence[Order], window: Column, above: Sequence[int] | None = None) -> DataFrame:
    """Design rows of every order: ``(series_id, o, period_idx, i, rows, y, z, v)``.

    ``o`` numbers the orders, ``i`` the rows of a series that have all lags of their order, ``rows`` is how many of them a
    window of ``window`` observations (a column of ``n``) holds. Lags of y and x are taken once for all orders; differences
    and lags of differences are weighted sums of them, and the orders are unfolded in place. An order with a number in
    ``above`` is left out for series whose windows are not longer than that.
    """
    nv = len(ds.exog_vars)
    weights = [difference_weights(o) for o in orders]
    needed = sorted({j + lag for o, w in zip(orders, weights, strict=True) for j in w for lag in [0, *product_lags(o)]})
    whole = Window.partitionBy("series_id")
    run = whole.orderBy("period_idx")
    base = ds.realized.select(
        "series_id", "period_idx", "y", F.count("*").over(whole).alias("n"),
        (F.col("period_idx") - F.min("period_idx").over(whole) + 1).cast("double").alias("t"),
        *[F.get("x", F.lit(i)).alias(f"_x{i}") for i in range(nv)],
    )
    base = base.select(
        "*", *[F.lag("y", s).over(run).alias(f"_y_{s}") for s in needed],
        *[F.lag(f"_x{i}", s).over(run).alias(f"_x{i}_{s}") for s in needed for i in range(nv)],
    ).withColumn("w", window.cast("long"))

    def differenced(name: str, lag: int, w: dict[int, float]) -> Column:
        terms = [F.col(f"{name}_{j + lag}") * c if c != 1 else F.col(f"{name}_{j + lag}") for j, c in w.items()]
        return sum(terms[1:], terms[0])

    units = []
    for k, (o, w) in enumerate(zip(orders, weights, strict=True)):
        lags, span = product_lags(o), o.lost + o.ar_span
        trend = [F.lit(1.0), F.col("t")] if o.trend == "ct" else [F.col("t")]
        v = trend + [differenced(f"_x{i}", 0, w) for i in range(nv)] + [differenced("_y", s, w) for s in lags]
        v += [differenced(f"_x{i}", s, w) for s in lags for i in range(nv)]
        rows = F.col("w") - span
        if above is not None:
            rows = F.when(F.col("w") > above[k], rows).otherwise(F.lit(0))
        units.append(F.struct(
            F.lit(k).alias("o"), (F.col("t") - 1 - span).cast("long").alias("i"), rows.alias("rows"),
            differenced("_y", 0, w).alias("z"), F.array(*v).alias("v"),
        ))
    rows = base.select("series_id", "period_idx", "y", F.explode(F.array(*units)).alias("_u"))
    return rows.select("series_id", "period_idx", "y", "_u.*").filter((F.col("i") >= 0) & (F.col("rows") > 0))


def window_grams(rows: DataFrame, k: int, shifted: bool) -> DataFrame:
    """Products of the window before every row, ``(series_id, o, period_idx, y, z, z0, u, gram)``.

    Rows are cut into blocks as long as a window. A window then is the end of one block and the start of the next: a suffix
    sum and a prefix sum, both around an origin of their own (the last row before the later block), so that only numbers
    of the window's own size are added and none is ever taken away. ``u`` is the regressor vector from that origin,
    ``z0`` the origin's z. Without an intercept (``shifted`` false) the origin is zero. Windows are partitioned by series,
    order and block, so one long series does not meet in one task; the suffix sum travels to the row that needs it.
    """
    per = Window.partitionBy("series_id", "o")
    block = Window.partitionBy("series_id", "o", "b")
    up, down = block.orderBy("i"), block.orderBy(F.col("i").desc())
    rows = rows.withColumn("b", F.floor(F.col("i") / F.col("rows")))
    here = F.struct("v", "z")
    if shifted:
        rows = rows.withColumn("_before", F.lag(here).over(per.orderBy("i")))
        rows = rows.select("*", F.first("_before").over(up).alias("_o1"), F.first(here).over(down).alias("_o2"))

    def columns(origin: str) -> list[Column]:
        v = [F.get("v", F.lit(j)) for j in range(k)]
        if not shifted:
            return [*v, F.col("z")]
        return [v[0], *[c - F.get(F.col(f"{origin}.v"), F.lit(j)) for j, c in enumerate(v) if j], F.col("z") - F.col(f"{origin}.z")]

    def sums(c: list[Column], frame) -> Column:
        return F.array(*[F.sum(c[i] * c[j]).over(frame) for i in range(k + 1) for j in range(i, k + 1)])

    one, two = columns("_o1"), columns("_o2")
    summed = rows.select(
        "series_id", "o", "i", "rows", "period_idx", "y", "z", F.array(*one[:k]).alias("u"),
        (F.col("_o1.z") if shifted else F.lit(0.0)).alias("z0"),
        sums(one, up.rowsBetween(Window.unboundedPreceding, -1)).alias("_start"),
        sums(two, down.rowsBetween(Window.unboundedPreceding, 0)).alias("_end"),
    )
    own = F.struct("period_idx", "y", "z", "z0", "u", "rows")
    both = summed.select("series_id", "o", F.explode(F.array(
        F.struct(F.col("i").alias("at"), own.alias("own"), F.col("_start").alias("g")),
        F.struct((F.col("i") + F.col("rows")).alias("at"), F.lit(None).alias("own"), F.col("_end").alias("g")),
    )).alias("_p")).select("series_id", "o", "_p.*")
    size = (k + 1) * (k + 2) // 2
    met = both.groupBy("series_id", "o", "at").agg(
        F.first("own", ignorenulls=True).alias("own"), F.array(*[F.sum(F.get("g", F.lit(j))) for j in range(size)]).alias("gram")
    )
    return met.filter(F.col("at") >= F.col("own.rows")).select("series_id", "o", "own.period_idx", "own.y", "own.z", "own.z0", "own.u", "gram")


def window_solver(orders: Sequence[Order], n_exog: int, k: int):
    """Design coefficients of every window of a batch, whatever order each of them has."""
    products_of = [LagProduct(o, n_exog) for o in orders]

    @F.pandas_udf("array<double>")
    def solve(o: pd.Series, packed: pd.Series) -> pd.Series:
        out = np.empty(len(o), dtype=object)
        for number in o.unique():
            mine = np.flatnonzero(o.to_numpy() == number)
            own = products_of[number]
            keep = [*range(own.g + own.width), k]  # z stands behind the widest order's columns
            grams = unpack(np.stack(packed.to_numpy()[mine]).astype(float), k + 1)[:, keep][:, :, keep]
            for at, coef in zip(mine, own.solve(grams).coef, strict=True):
                out[at] = coef
        return pd.Series(out)

    return solve.asNondeterministic()


def rolling_orders(ds: PanelDataset, orders: Sequence[Order], window: Column, above: Sequence[int] | None = None) -> DataFrame:
    """``(series_id, o, period_idx, prediction, actual)``: one-step forecasts of every order from a refit on each window.

    All orders share one trend. The forecast of a row is its value minus the residual of its regressors under the
    coefficients of the window before it. Series whose window holds no complete row of an order's lags give no row for it.
    """
    nv = len(ds.exog_vars)
    k = max(design_width(o, nv) for o in orders)
    grams = window_grams(window_rows(ds, orders, window, above), k, orders[0].trend == "ct")
    solved = grams.withColumn("coef", window_solver(orders, nv, k)("o", "gram"))
    used = F.slice("u", 1, F.size("coef"))
    return solved.select(
        "series_id", "o", "period_idx",
        (F.col("y") - F.col("z") + F.col("z0") + fitted(used, F.col("coef"))).alias("prediction"), F.col("y").alias("actual"),
    )


def linear_rolling(ds: PanelDataset, order: Order, window: Column) -> DataFrame:
    """``(series_id, period_idx, prediction, actual)`` of one-step refits of one order on a sliding window."""
    return rolling_orders(ds, [order], window).drop("o")
