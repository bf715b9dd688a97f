"""Iterated regression with autoregressive errors against the Gram matrix of all lags, and what it says when it has not settled."""

import numpy as np
import pytest

from periodica.functions.css import Order
from periodica.operators.iterated import iterated_fit
from periodica.operators.moments import linear_estimates, linear_fit
from test_estimator import simulate


def build(panel, nx=2):
    rng = np.random.default_rng(30)
    data = {}
    for i, n in enumerate((80, 110)):
        x = rng.normal(size=(n, nx)) + 5
        data[f"s{i}"] = (simulate(n, 1, phi=0.6, seed=i)[0] + x @ np.arange(1.0, nx + 1), x, x[:1])
    return panel(data, n_vars=nx)


@pytest.mark.parametrize("order", [Order(1, 0, 0, 0, 0, 0, 4), Order(1, 1, 0, 1, 0, 0, 5)])
def test_settles_where_the_one_matrix_does(panel, order):
    ds = build(panel)
    got = {r["series_id"]: r for r in iterated_fit(ds, order, max_passes=20, tolerance=1e-7).collect()}
    for r in linear_estimates(ds, order, linear_fit(ds, order)).collect():
        mine = got[r["series_id"]]
        assert mine["converged"] and mine["n_eff"] == r["n_eff"]
        np.testing.assert_allclose(mine["est"], r["est"], rtol=1e-4, atol=1e-4)
        assert mine["sse"] == pytest.approx(r["sse"], rel=1e-6)


def test_says_what_has_not_settled(panel):
    rows = iterated_fit(build(panel), Order(1, 0, 0, 0, 0, 0, 4), max_passes=1, tolerance=1e-12).collect()
    assert len(rows) == 2 and all(not r["converged"] and r["passes"] == 1 and r["move"] > 0 for r in rows)


def test_more_variables_than_one_matrix_holds(panel):
    rows = iterated_fit(build(panel, 14), Order(1, 0, 0, 1, 0, 0, 4), max_passes=8).collect()
    for r in rows:
        np.testing.assert_allclose(r["est"][2:16], np.arange(1.0, 15.0), atol=0.6)


def test_refuses_other_orders(panel):
    for order in (Order(0, 0, 0, 0, 0, 0, 4), Order(1, 0, 1, 0, 0, 0, 4)):
        with pytest.raises(ValueError):
            iterated_fit(build(panel), order)
