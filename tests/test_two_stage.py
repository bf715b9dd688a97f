"""Moving-average terms by two passes against direct least squares, simulations, and the shared Gram matrix of a search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from periodica import OverspecifiedError, SARIMARegression
from periodica.functions.css import Order
from periodica.operators import search
from periodica.operators.two_stage import long_lags, rows_needed, two_stage_fit
from periodica.operators.units import information_udf, series_units, unit_columns
from test_estimator import simulate


def direct(y, x, order, long):
    """Both passes with lstsq, for orders without products."""
    n = len(y)
    t = np.arange(1, n + 1.0)
    lag = lambda s, k: np.concatenate([np.full(k, np.nan), s[: n - k]])
    det = np.column_stack([np.ones(n), t, x])
    a = np.column_stack([det, *[lag(y, i) for i in range(1, long + 1)]])
    ok = np.isfinite(a).all(axis=1)
    e = np.full(n, np.nan)
    c, *_ = np.linalg.lstsq(a[ok], y[ok], rcond=None)
    e[ok] = y[ok] - a[ok] @ c
    b = np.column_stack([det, *[lag(y, i) for i in range(1, order.p + 1)], *[lag(e, i) for i in range(1, order.q + 1)]])
    ok = np.isfinite(b).all(axis=1)
    c, *_ = np.linalg.lstsq(b[ok], y[ok], rcond=None)
    return c, y[ok] - b[ok] @ c


@pytest.mark.parametrize("order, nx", [(Order(0, 0, 2, 0, 0, 0, 4), 0), (Order(2, 0, 1, 0, 0, 0, 4), 0), (Order(0, 0, 1, 0, 0, 0, 4), 2)])
def test_equals_both_passes_by_lstsq(panel, order, nx):
    rng = np.random.default_rng(20)
    data = {k: (simulate(n, 1, phi=0.4 if order.p else 0.0, theta=0.5, seed=n)[0] + 1000, rng.normal(size=(n, nx)), rng.normal(size=(2, nx))) for k, n in (("a", 90), ("b", 120))}
    est, resid = two_stage_fit(panel(data, n_vars=nx), order)
    rows = {r["series_id"]: r for r in est.collect()}
    left = {k: [r["resid"] for r in resid.filter(F.col("series_id") == k).orderBy("period_idx").collect()] for k in data}
    for k, (y, x, _) in data.items():
        c, e = direct(y, x, order, long_lags(order))
        np.testing.assert_allclose(rows[k]["est"], c, rtol=1e-6, atol=1e-7)
        np.testing.assert_allclose(left[k], e, atol=1e-7)
        assert rows[k]["converged"] and rows[k]["n_eff"] == len(e) and rows[k]["sse"] == pytest.approx(e @ e)


def test_products_are_recovered(panel):
    order = Order(1, 0, 1, 0, 0, 1, 4)
    y = simulate(600, 12, phi=0.5, theta=0.4, stheta=0.5, seed=21)
    est, _ = two_stage_fit(panel({f"s{i}": (v, [], []) for i, v in enumerate(y)}), order)
    rows = est.collect()
    got = dict(zip(order.names([]), np.mean([r["est"] for r in rows], axis=0)))
    assert got["ar.L1"] == pytest.approx(0.5, abs=0.08) and got["ma.L1"] == pytest.approx(0.4, abs=0.1) and got["ma.S.L4"] == pytest.approx(0.5, abs=0.1)
    assert all(r["converged"] and np.isfinite(r["se"]).all() for r in rows)


def test_model_by_two_passes(panel):
    y = simulate(150, 1, theta=0.6, seed=22)[0]
    ds = panel({"long": (y, [], []), "short": (y[:10], [], [])})
    strict, lenient = (SARIMARegression((0, 0, 1), (0, 0, 0, 4), on_invalid=m, estimator="two_stage") for m in ("raise", "quarantine"))
    with pytest.raises(OverspecifiedError):
        strict.fit(ds)
    fitted = lenient.fit(ds)
    assert {r["series_id"] for r in fitted.information.collect()} == {"long"}
    c, e = direct(y, np.zeros((150, 0)), Order(0, 0, 1, 0, 0, 0, 4), 4)
    ahead = {r["h"]: r["prediction"] for r in lenient.predict(2, ds).collect()}
    assert ahead[1] == pytest.approx(c[0] + c[1] * 151 + c[2] * e[-1], rel=1e-7)
    assert ahead[2] == pytest.approx(c[0] + c[1] * 152, rel=1e-7)
    assert rows_needed(Order(0, 0, 1, 0, 0, 0, 4), 0, 4) > 10
    with pytest.raises(ValueError):
        SARIMARegression(estimator="guess").fit(ds)


def test_search_scores_every_candidate_on_all_rows(panel):
    """Sums of products and units agree, and no candidate goes without a reason however short the series."""
    rng = np.random.default_rng(23)
    ds = panel({"short": (rng.normal(size=18).cumsum(), [], []), "long": (rng.normal(size=70).cumsum(), [], [])})
    scores = {(r["series_id"], r["order_id"]): r for r in search.auto_scores(ds, 4, 1, 0).collect()}
    grid = search.auto_grid(ds.df.sparkSession, 4)
    assert len(scores) == 2 * grid.count()
    assert {r["n_eff"] for k, r in scores.items() if k[0] == "short"} == {17} and {r["n_eff"] for k, r in scores.items() if k[0] == "long"} == {69}
    assert all((r["reason"] is None) == (r["aic"] is not None) for r in scores.values())
    wide = [r for k, r in scores.items() if k[0] == "short" and r["p"] + 4 * r["sp"] > 18 / 2 and r["reason"] is None]
    assert wide  # lags beyond half of the rows are candidates too
    units = series_units(ds, grid.filter("q + sq = 0"), search.auto_differencing(ds, 4, 1, 0))
    for r in units.withColumn("_s", information_udf("t")(unit_columns())).collect():
        assert scores[r["series_id"], r["order_id"]]["sse"] == pytest.approx(r["_s"]["sse"], rel=1e-5)
