import numpy as np
import pytest
from pyspark.sql import functions as F

from periodica.functions import css
from periodica.functions.css import Order
from periodica.operators.backtest import sliding_window_forecast, unit_rolling, window_length
from periodica.operators.fit import fit_order, fit_units, one_order_units
from periodica.operators.forecast import forecast_order, unit_forecast
from periodica.operators.moments import is_linear, linear_estimates, linear_fit, on_moments, rolling_orders


def simulate(n, size, phi=0.0, sphi=0.0, theta=0.0, stheta=0.0, m=4, c=1.0, drift=0.02, seed=0):
    rng = np.random.default_rng(seed)
    burn = 200
    e = rng.normal(size=(size, n + burn))
    y = np.zeros_like(e)
    for t in range(m + 1, n + burn):
        y[:, t] = (
            phi * y[:, t - 1] + sphi * y[:, t - m] - phi * sphi * y[:, t - m - 1] + e[:, t] + theta * e[:, t - 1]
            + stheta * e[:, t - m] + theta * stheta * e[:, t - m - 1] + c + drift * max(t - burn + 1, 0)
        )
    return y[:, burn:]


@pytest.mark.parametrize("true,order", [
    (dict(phi=0.6), Order(1, 0, 0, 0, 0, 0, 4)),
    (dict(phi=0.6, sphi=0.5, m=12), Order(1, 0, 0, 1, 0, 0, 12)),
    (dict(theta=0.5), Order(0, 0, 1, 0, 0, 0, 4)),
    (dict(phi=0.6, theta=0.4), Order(1, 0, 1, 0, 0, 0, 4)),
    (dict(phi=0.5, theta=0.4, stheta=0.5), Order(1, 0, 1, 0, 0, 1, 4)),
])
def test_recovers_known_coefficients(true, order):
    y = simulate(400, 80, **true)
    f = css.fit(y, np.zeros((80, 400, 0)), order)
    got = dict(zip(order.names([]), f.est.mean(axis=0)))
    names = {"phi": "ar.L1", "sphi": f"ar.S.L{order.m}", "theta": "ma.L1", "stheta": f"ma.S.L{order.m}"}
    for k, name in names.items():
        if k in true:
            assert got[name] == pytest.approx(true[k], abs=0.05)
    assert got["drift"] == pytest.approx(0.02, abs=0.005)
    spread, claimed = f.est.std(axis=0), f.se.mean(axis=0)
    assert np.all(claimed < 1.5 * spread) and np.all(claimed > 0.6 * spread)


def test_zero_lags_is_least_squares_with_robust_errors():
    rng = np.random.default_rng(1)
    y, x = rng.normal(size=(2, 30)) + 1e5, rng.normal(size=(2, 30, 2))
    f = css.fit(y, x, Order(0, 0, 0, 0, 0, 0, 4))
    for i in range(2):
        a = np.column_stack([np.ones(30), np.arange(1, 31), x[i]])
        b, *_ = np.linalg.lstsq(a, y[i], rcond=None)
        r = y[i] - a @ b
        g = np.linalg.inv(a.T @ a)
        np.testing.assert_allclose(f.est[i], b, rtol=1e-7)
        np.testing.assert_allclose(f.se[i], np.sqrt(np.diag(g @ (a.T * r**2) @ a @ g)), rtol=1e-6)


def test_exogenous_regression_with_autoregressive_errors():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 300, 2))
    y = simulate(300, 60, phi=0.7, seed=3) + x @ np.array([2.0, -1.0])
    f = css.fit(y, x, Order(1, 0, 0, 0, 0, 0, 4))
    np.testing.assert_allclose(f.est.mean(axis=0)[2:], [2.0, -1.0, 0.7], atol=0.05)


def test_explosive_series_is_pulled_inside():
    y = 1.05 ** np.arange(60.0)[None] + np.random.default_rng(4).normal(size=(1, 60)) * 0.01
    f = css.fit(y, np.zeros((1, 60, 0)), Order(1, 0, 0, 0, 0, 0, 4))
    assert f.adjusted[0] and abs(f.est[0, -1]) < 1


@pytest.mark.parametrize("rows", [50, 700])
def test_ma_inversion(rows):
    rng = np.random.default_rng(5)
    b = np.concatenate([np.ones((3, 1)), rng.uniform(-0.5, 0.5, (3, 2))], axis=1)
    a = rng.normal(size=(3, rows, 2))
    out = css._invert_ma(css._impulse(b, rows), a)
    back = out.copy()
    back[:, 1:] += b[:, 1, None, None] * out[:, :-1]
    back[:, 2:] += b[:, 2, None, None] * out[:, :-2]
    np.testing.assert_allclose(back, a, atol=1e-10)


LINEAR = [Order(0, 0, 0, 0, 0, 0, 4), Order(0, 1, 0, 0, 1, 0, 4), Order(2, 0, 0, 0, 0, 0, 4), Order(1, 1, 0, 0, 0, 0, 4), Order(0, 0, 0, 2, 1, 0, 4)]


#: products of lag polynomials, and lags beside variables
PRODUCTS = [Order(1, 0, 0, 1, 0, 0, 4), Order(2, 1, 0, 1, 0, 0, 4), Order(1, 0, 0, 2, 1, 0, 3)]
WITH_VARIABLES = [Order(1, 0, 0, 0, 0, 0, 5), Order(1, 1, 0, 1, 0, 0, 5)]


def table(df, key, *cols):
    return {tuple(r[k] for k in key): [r[c] for c in cols] for r in df.collect()}


@pytest.mark.parametrize("order", LINEAR + PRODUCTS + WITH_VARIABLES)
def test_moments_agree_with_units(panel, order):
    rng = np.random.default_rng(6)
    nx = 2 if order.p + order.sp == 0 or order in WITH_VARIABLES else 0
    data = {}
    for name, n in (("a", 50), ("b", 61)):
        x = rng.normal(size=(n, nx)) + 100
        y = rng.normal(size=n).cumsum() + 1000 + (x.sum(axis=1) if nx else 0)
        data[name] = (y, x, rng.normal(size=(4, nx)) + 100)
    ds = panel(data, n_vars=nx)
    assert on_moments(order, nx)
    lin = table(linear_estimates(ds, order, linear_fit(ds, order)), ["series_id"], "est", "se", "sse", "n_eff")
    units = one_order_units(ds, order)
    uni = table(fit_units(units, "ct"), ["series_id"], "est", "se", "sse", "n_eff")
    free = is_linear(order, nx)
    for k in lin:  # the units stop iterating earlier than the sums of products do
        np.testing.assert_allclose(lin[k][0], uni[k][0], rtol=1e-6 if free else 1e-3, atol=1e-8 if free else 1e-4)
        np.testing.assert_allclose(lin[k][1], uni[k][1], rtol=1e-5 if free else 1e-2, atol=1e-8)
        assert lin[k][2] == pytest.approx(uni[k][2], rel=1e-8) and lin[k][3] == uni[k][3]
        assert lin[k][2] <= uni[k][2] * (1 + 1e-9)
    a = table(forecast_order(ds, order, 4), ["series_id", "h"], "prediction", "period_idx")
    b = table(unit_forecast(units, "ct", 4), ["series_id", "h"], "prediction", "period_idx")
    assert a.keys() == b.keys() and len(a) == 8
    for k in a:
        assert a[k][0] == pytest.approx(b[k][0], rel=1e-7 if free else 1e-5) and a[k][1] == b[k][1]
    for kw in ({"window_frac": 0.8}, {"window_rows": 40}):
        c = table(sliding_window_forecast(ds, order, **kw), ["series_id", "period_idx"], "prediction", "actual")
        d = table(unit_rolling(units.withColumn("w", window_length(F.col("n"), **kw)), "ct"), ["series_id", "period_idx"], "prediction", "actual")
        assert c.keys() == d.keys() and len(c) > 0
        for k in c:
            assert c[k][0] == pytest.approx(d[k][0], rel=1e-6 if free else 1e-5) and c[k][1] == d[k][1]


def test_windows_equal_refits_of_each_block():
    rng = np.random.default_rng(7)
    y = rng.normal(size=(2, 30)).cumsum(axis=1)
    order = Order(1, 0, 0, 0, 0, 0, 4)
    got = css.rolling_forecast(y, np.zeros((2, 30, 0)), 24, order)
    for s in range(2):
        for i in range(6):
            block = y[s, i : i + 24]
            a = np.column_stack([np.ones(23), np.arange(2, 25), block[:-1]])
            b, *_ = np.linalg.lstsq(a, block[1:], rcond=None)
            if abs(b[2]) < 1:
                assert got[s, i] == pytest.approx(b @ [1, 25, block[-1]], rel=1e-6)


@pytest.mark.parametrize("order", [Order(1, 1, 1, 0, 0, 0, 4), Order(1, 0, 1, 1, 1, 0, 4), Order(0, 2, 0, 0, 0, 1, 4)])
def test_forecast_recursion(order):
    """The forecast continues the differenced recursion with zero errors."""
    y = simulate(120, 2, phi=0.5, seed=8).cumsum(axis=1)
    x = np.zeros((2, 120, 0))
    f = css.fit(y, x, order)
    ahead = css.forecast(y, x, np.zeros((2, 5, 0)), f, order, 5)
    longer = np.concatenate([y, ahead], axis=1)
    blk = css._Block(longer, np.zeros((2, 125, 0)), order)
    pa, psa, pb, psb = blk.polys(f.est[:, 2:])
    inner = css._lagged(css._mul(pa, psa), blk.z, blk.start) - f.est[:, :2] @ blk.g.T
    e = css._invert_ma(css._impulse(css._mul(pb, psb), inner.shape[1]), inner[:, :, None])[:, :, 0]
    np.testing.assert_allclose(e[:, -5:], 0, atol=1e-6)
    np.testing.assert_allclose(e[:, :-5], f.resid, atol=1e-6)


def test_fit_tables(panel):
    rng = np.random.default_rng(9)
    n = 60
    ds = panel({"a": (simulate(n, 1, phi=0.5, seed=10)[0], rng.normal(size=(n, 1)), [])}, n_vars=1)
    for order in (Order(0, 0, 0, 0, 0, 0, 4), Order(1, 0, 1, 0, 0, 0, 4)):
        t = fit_order(ds, order)
        coef = t.coefficients.orderBy("pos").collect()
        assert [r["param"] for r in coef] == order.names(["x0"])
        for r in coef:
            assert r["ci_lo"] < r["estimate"] < r["ci_hi"] and 0 <= r["p_value"] <= 1
        info = t.information.first()
        k = len(coef) + 1
        assert info["aic"] == pytest.approx(2 * k - 2 * info["llf"]) and info["n_obs"] == n
        resid = np.array([r["resid"] for r in t.residuals.orderBy("period_idx").collect()])
        assert info["sigma2"] == pytest.approx((resid**2).mean())
        d = t.diagnostics.first()
        c = resid - resid.mean()
        assert d["skew"] == pytest.approx((c**3).mean() / (c**2).mean() ** 1.5)
        assert d["kurtosis"] == pytest.approx((c**4).mean() / (c**2).mean() ** 2)
        h = round(len(resid) / 3)
        assert d["heteroskedasticity"] == pytest.approx((resid[-h:] ** 2).sum() / (resid[:h] ** 2).sum())


def test_windows_far_from_the_origin_keep_their_digits(panel):
    """4,000 rows up to a million: every refit within 1e-6 of direct least squares on its own window."""
    rng = np.random.default_rng(9)
    n, w = 4000, 60
    noise = np.zeros(n)
    for t in range(1, n):
        noise[t] = 0.6 * noise[t - 1] + rng.normal()
    y = 250.0 * np.arange(n) + noise
    got = sliding_window_forecast(panel({"s": (y, [], [])}, first=0), Order(1, 0, 0, 0, 0, 0, 4), window_rows=w)
    got = {r["period_idx"]: r["prediction"] for r in got.collect()}
    assert sorted(got) == list(range(w, n))
    worst = 0.0
    for i in range(w, n):
        t = np.arange(w - 1) - w / 2.0
        block = y[i - w : i] - y[i - 1]
        a = np.column_stack([np.ones(w - 1), t, block[:-1]])
        c, *_ = np.linalg.lstsq(a, block[1:], rcond=None)
        direct = y[i - 1] + c @ [1.0, t[-1] + 1, block[-1]]
        worst = max(worst, abs(got[i] - direct))
    assert worst < 1e-6


def test_many_orders_in_one_plan_equal_single_ones(panel):
    rng = np.random.default_rng(10)
    ds = panel({"a": (rng.normal(size=40).cumsum() + 50, [], []), "b": (rng.normal(size=33).cumsum(), [], [])})
    orders = [Order(0, 0, 0, 0, 0, 0, 4), Order(2, 1, 0, 0, 0, 0, 4), Order(1, 0, 0, 1, 1, 0, 4), Order(0, 0, 0, 2, 0, 0, 4)]
    many = table(rolling_orders(ds, orders, F.lit(25)), ["o", "series_id", "period_idx"], "prediction")
    for i, o in enumerate(orders):
        one = table(sliding_window_forecast(ds, o, window_rows=25), ["series_id", "period_idx"], "prediction")
        assert len(one) == 23 and all(many[i, *k][0] == pytest.approx(v[0], rel=1e-9) for k, v in one.items())
