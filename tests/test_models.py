import time

import numpy as np
import pytest

from periodica import (
    AutoARIMARegression,
    BruteForceARIMARegression,
    OverspecifiedError,
    SARIMARegression,
    make_model,
)
from periodica.operators.backtest import sliding_window_rmse
from periodica.operators.orders import brute_ranges, order_grid, order_rules, orders_table, repeated_lags, repeats
from periodica.operators.search import auto_differencing, ocsb_critical

RNG = np.random.default_rng(0)


@pytest.fixture(autouse=True)
def own_numbers():
    """Every test draws from its own start, whichever tests ran before it."""
    global RNG
    RNG = np.random.default_rng(0)


def test_bad_windows_and_orders(panel):
    ds = panel({"a": (RNG.random(11), [], [])})
    model = SARIMARegression()
    for bad in (0, -1, 12):
        with pytest.raises(AssertionError):
            model.sliding_window_forecast(ds, bad)
    for order, seasonal in (((0, 0), (0, 0, 0, 4)), ((0, -1, 0), (0, 0, 0, 4)), ((0, 0, 0), (0, 0, 0, 1)), ((0, None, 0), (0, 0, 0, 4))):
        with pytest.raises(AssertionError):
            SARIMARegression(order, seasonal)
    AutoARIMARegression((0, None, 0), (0, None, 0, 4))
    assert AutoARIMARegression().p_d_q_order == (2, None, 2)


def test_order_grid_is_lexicographic(spark):
    import itertools

    ranges = (range(1, 3), range(0, 2), range(2, 0, -1), range(1), range(0, 5, 2), range(1), range(4, 6))
    got = [tuple(r)[1:] for r in order_grid(spark, ranges).orderBy("order_id").collect()]
    assert got == list(itertools.product(*ranges))


def test_order_rules(series, spark):
    rules = order_rules(series({"a": (0, np.ones(4)), "b": (0, np.ones(6))}), orders_table(spark, [((1, 2, 1), (0, 1, 0, 4)), ((0, 0, 0), (0, 0, 0, 2))]), 1)
    assert {(r["series_id"], r["order_id"]): r["overspecified"] for r in rules.collect()} == {
        ("a", 0): True, ("b", 0): False, ("a", 1): False, ("b", 1): False}


def test_brute_choice_equals_direct_search(panel):
    t = np.arange(40)
    ds = panel({"a": (RNG.normal(size=40).cumsum(), [], []), "b": (np.sin(t * np.pi / 2) * 5 + RNG.normal(size=40), [], [])})
    ranges = (range(2), range(2), range(1), range(2), range(2), range(1), range(4, 5))
    best = {r["series_id"]: r for r in BruteForceARIMARegression(ds, ranges).orders().collect()}
    scores = {"a": {}, "b": {}}
    import itertools

    for i, o in enumerate(itertools.product(*ranges)):
        back = SARIMARegression(o[:3], o[3:]).sliding_window_forecast(ds, 0.8)
        for r in sliding_window_rmse(back).collect():
            scores[r["series_id"]][i] = r["rmse"]
    for name, by_order in scores.items():
        first = min(by_order, key=lambda i: (by_order[i], i))
        assert best[name]["rmse"] == pytest.approx(by_order[first], rel=1e-4)
        assert by_order[best[name]["order_id"]] == pytest.approx(by_order[first], rel=1e-3)


def test_make_model(panel):
    ds = panel({"a": (RNG.random(12), [], [])})
    assert isinstance(make_model("SARIMARegression", (0, 0, 0), (0, 0, 0, 4), ds), SARIMARegression)
    assert isinstance(make_model("AutoARIMARegression", (0, 0, 0), (0, 0, 0, 4), ds), AutoARIMARegression)
    assert isinstance(make_model("BruteForceARIMARegression", (0, 1, 0), (0, 0, 0, 4), ds), BruteForceARIMARegression)
    assert brute_ranges((1, 0, 2), (0, 1, 0, 4)) == (range(2), range(1), range(3), range(1), range(2), range(1), range(4, 5))
    with pytest.raises(ValueError):
        make_model("Prophet", (0, 0, 0), (0, 0, 0, 4), ds)


def test_auto_differencing(panel):
    n = 160
    walk = RNG.normal(size=n).cumsum()
    seasonal = np.zeros(n)
    for t in range(4, n):
        seasonal[t] = seasonal[t - 4] + RNG.normal()
    ds = panel({"noise": (RNG.normal(size=n), [], []), "walk": (walk, [], []), "seasonal": (seasonal, [], []), "flat": (np.ones(n), [], [])})
    got = {r["series_id"]: (r["d"], r["sd"]) for r in auto_differencing(ds, 4, None, None).collect()}
    assert got["noise"] == (0, 0) and got["walk"] == (1, 0) and got["flat"] == (0, 0)
    assert got["seasonal"][1] == 1
    assert ocsb_critical(12) == pytest.approx(-1.803, abs=2e-3)
    fixed_ = {(r["d"], r["sd"]) for r in auto_differencing(ds, 4, 1, 1).collect()}
    assert fixed_ == {(1, 1)}


def test_auto_finds_autoregression(panel):
    y = np.zeros(300)
    for t in range(1, 300):
        y[t] = 0.8 * y[t - 1] + RNG.normal()
    ds = panel({"a": (y, [], [])})
    best = AutoARIMARegression((0, 0, 0), (0, 0, 0, 4)).orders(ds).first()
    assert best["p"] + best["q"] >= 1 and best["d"] == 0 and best["sd"] == 0
    train = AutoARIMARegression((0, 0, 0), (0, 0, 0, 4)).sliding_window_forecast(ds, window_rows=290, select_on="train")
    assert train.count() == 10


def test_quarantine_leaves_series_out(panel):
    ds = panel({"short": ([1.0], [], []), "long": (RNG.random(20), [], [])})
    with pytest.raises(OverspecifiedError):
        SARIMARegression().predict(1, ds)
    lenient = SARIMARegression(on_invalid="quarantine")
    assert {r["series_id"] for r in lenient.predict(1, ds).collect()} == {"long"}
    assert {r["series_id"] for r in lenient.fit(ds).information.collect()} == {"long"}
    assert {r["series_id"] for r in lenient.sliding_window_forecast(ds, 0.8).collect()} == {"long"}


def test_short_series_with_long_lags(panel):
    """A series or window without a complete row of lags still gets an answer."""
    ds = panel({"short": (RNG.random(10), [], []), "long": (RNG.random(40), [], [])})
    model = SARIMARegression((0, 0, 0), (1, 0, 0, 12))
    assert model.predict(3, ds).count() == 6
    assert {r["series_id"] for r in model.fit(ds).information.collect()} == {"short", "long"}
    back = model.sliding_window_forecast(ds, 0.8).collect()
    assert sum(r["series_id"] == "short" for r in back) == 2 and sum(r["series_id"] == "long" for r in back) == 8
    assert all(np.isfinite(r["prediction"]) for r in back)


def test_broken_series_are_refused_or_left_out(panel, spark):
    from dataclasses import replace

    from periodica import InvariantError

    ds = panel({"ok": (RNG.random(12), RNG.random((12, 1)), RNG.random((2, 1))), "gap": (RNG.random(12), RNG.random((12, 1)), [])}, n_vars=1)
    holed = replace(ds, df=ds.df.filter("NOT (series_id = 'gap' AND period_idx = 24003)"))
    unknown = replace(ds, df=ds.df.selectExpr(
        "series_id", "period_idx", "is_future", "y",
        "IF(series_id = 'gap' AND period_idx = 24003, array(CAST(NULL AS DOUBLE)), x) AS x"))
    for bad in (holed, unknown):
        for order in ((0, 0, 0), (1, 0, 1)):
            with pytest.raises(InvariantError):
                SARIMARegression(order).fit(bad)
            lenient = SARIMARegression(order, on_invalid="quarantine")
            assert {r["series_id"] for r in lenient.fit(bad).information.collect()} == {"ok"}
            assert {r["series_id"] for r in lenient.predict(1, bad).collect()} == {"ok"}


def test_perfect_fit_has_no_division_by_zero(panel):
    ds = panel({"line": (np.arange(20.0), [], []), "flat": (np.zeros(20), [], [])})
    out = SARIMARegression().fit(ds)
    assert out.diagnostics.count() == 2 and out.information.count() == 2 and out.coefficients.count() == 4


def line_after(y, steps):
    """The least-squares line through ``y``, carried on."""
    t = np.arange(len(y) + steps)
    slope, level = np.polyfit(t[: len(y)], y, 1)
    return (level + slope * t)[len(y) :]


def by_series(out, value="prediction"):
    found = {}
    for r in out.orderBy("series_id", "period_idx").collect():
        found.setdefault(r["series_id"], []).append((r["period_idx"], r[value]))
    return found


def test_trend_forecast_is_the_least_squares_line(panel):
    data = {"up": 4 + 0.3 * np.arange(23) + RNG.normal(size=23), "down": -0.8 * np.arange(31) + RNG.normal(size=31)}
    ds = panel({k: (y, [], []) for k, y in data.items()}, first=500)
    model = SARIMARegression((0, 0, 0), (0, 0, 0, 7))
    got = by_series(model.predict(4, ds))
    for k, y in data.items():
        assert [i for i, _ in got[k]] == [500 + len(y) + h for h in range(4)]
        assert [v for _, v in got[k]] == pytest.approx(line_after(y, 4), abs=1e-7)
    back = model.sliding_window_forecast(ds, window_rows=15)
    got, actual = by_series(back), by_series(back, "actual")
    for k, y in data.items():
        assert [v for _, v in got[k]] == pytest.approx([line_after(y[i - 15 : i], 1)[0] for i in range(15, len(y))], abs=1e-6)
        assert [v for _, v in actual[k]] == list(y[15:])


def test_exact_regressor_and_its_horizon(panel):
    x = RNG.normal(size=(29, 1))
    y = 3 - 0.2 * np.arange(29) + 1.5 * x[:, 0]
    ds = panel({"s": (y[:26], x[:26], x[26:])}, n_vars=1)
    model = SARIMARegression((0, 0, 0), (0, 0, 0, 6))
    assert [v for _, v in by_series(model.predict(3, ds))["s"]] == pytest.approx(y[26:], abs=1e-7)
    assert model.predict(0, ds).count() == 0
    for steps in (4, -2):
        with pytest.raises(ValueError):
            model.predict(steps, ds)


@pytest.mark.parametrize("kind, refused", [("fixed", 5), ("auto", 3), ("brute", 6)])
def test_fewest_rows_a_model_takes(panel, kind, refused):
    """Variables + lag terms + one for the trend must stay below the rows; the automatic model counts no lag terms,
    the search leaves one row more for its first test."""
    order, seasonal = (1, 0, 0), (0, 0, 1, 5)

    def run(n):
        ds = panel({"s": (RNG.normal(size=n), RNG.normal(size=(n, 2)), [])}, n_vars=2)
        if kind == "brute":
            return BruteForceARIMARegression(ds, tuple(range(v, v + 1) for v in (*order, *seasonal))).fit(ds)
        return (SARIMARegression if kind == "fixed" else AutoARIMARegression)(order, seasonal).fit(ds)

    with pytest.raises(OverspecifiedError):
        run(refused)
    if kind == "fixed":
        assert run(refused + 1).information.count() == 1
    assert run(refused + 10).information.count() == 1


def test_lags_named_twice(spark):
    cases = [((p, 0, q), (sp, 0, sq, m)) for p in range(5) for q in range(2) for sp in range(3) for sq in range(3) for m in (2, 4)]
    for order, seasonal in cases:
        m = seasonal[3]
        want = {i for i in range(1, order[0] + 1) if i % m == 0 and i <= m * seasonal[0]} | {i for i in range(1, order[2] + 1) if i % m == 0 and i <= m * seasonal[2]}
        assert set(repeated_lags(order, seasonal)) == want
    got = orders_table(spark, cases).withColumn("r", repeats()).orderBy("order_id").collect()
    assert [r["r"] for r in got] == [bool(repeated_lags(*c)) for c in cases]
    with pytest.raises(ValueError):
        SARIMARegression((4, 0, 0), (1, 0, 0, 4))
    SARIMARegression((3, 0, 0), (1, 0, 0, 4))


def test_grid_of_one_order_equals_the_fixed_model(panel):
    y = np.zeros(60)
    for t in range(1, 60):
        y[t] = 0.6 * y[t - 1] + RNG.normal()
    ds = panel({"s": (y, [], [])})
    brute = BruteForceARIMARegression(ds, (range(1, 2), range(1), range(1), range(1), range(1), range(1), range(5, 6)))
    fixed = SARIMARegression((1, 0, 0), (0, 0, 0, 5))
    assert [v for _, v in by_series(brute.predict(3, ds))["s"]] == pytest.approx([v for _, v in by_series(fixed.predict(3, ds))["s"]], rel=1e-3, abs=1e-3)


def test_hopeless_grids_are_refused_at_once(panel):
    ds = panel({"s": (RNG.normal(size=16), RNG.normal(size=(16, 6)), [])}, n_vars=6)
    ranges = (range(3, 9), range(2), range(4, 7), range(1, 30), range(2), range(1, 25), range(9, 80))
    for limit in (60, 1):  # the second call meets a warm session
        start = time.time()
        with pytest.raises(OverspecifiedError):
            BruteForceARIMARegression(ds, ranges)
        assert time.time() - start < limit
    plain = panel({"s": (RNG.normal(size=30), [], [])})
    with pytest.raises(ValueError):
        BruteForceARIMARegression(plain, (range(3, 4), range(1), range(1), range(1, 2), range(1), range(1), range(3, 4)))


def test_components_count_not_variables(panel):
    base = RNG.normal(size=12)
    x = np.outer(base, np.arange(1, 11)) + 1e-3 * RNG.normal(size=(12, 10))
    ds = panel({"s": (RNG.normal(size=12), x, [])}, n_vars=10)
    with pytest.raises(OverspecifiedError):
        SARIMARegression((1, 0, 0), (0, 0, 0, 4)).fit(ds)
    assert SARIMARegression((1, 0, 0), (0, 0, 0, 4)).fit(ds.PCA(0.8)).information.count() == 1


def test_a_repeat_does_not_hide_a_gap(panel, spark):
    from dataclasses import replace

    from periodica import InvariantError

    ds = panel({"ok": (RNG.normal(size=9), [], []), "twice": (RNG.normal(size=9), [], [])})
    bad = replace(ds, df=ds.df.selectExpr("series_id", "IF(series_id = 'twice' AND period_idx = 24002, 24001, period_idx) AS period_idx", "is_future", "y", "x"))
    with pytest.raises(InvariantError):
        SARIMARegression().fit(bad)
    assert {r["series_id"] for r in SARIMARegression(on_invalid="quarantine").fit(bad).information.collect()} == {"ok"}


def test_differencing_longer_than_a_series(panel):
    ds = panel({"ten": (RNG.normal(size=10), [], []), "forty": (RNG.normal(size=40), [], [])})
    for order in ((0, 0, 0), (0, 0, 1)):
        for call in (lambda m: m.fit(ds), lambda m: m.predict(1, ds)):
            with pytest.raises(OverspecifiedError):
                call(SARIMARegression(order, (0, 1, 0, 12)))
        lenient = SARIMARegression(order, (0, 1, 0, 12), on_invalid="quarantine")
        assert {r["series_id"] for r in lenient.predict(1, ds).collect()} == {"forty"}


def test_chosen_orders_meet_other_series(panel):
    ds = panel({"s": (RNG.normal(size=30), [], [])})
    model = BruteForceARIMARegression(ds, (range(2, 3), range(1), range(2, 3), range(1), range(1), range(1), range(4, 5)))
    with pytest.raises(OverspecifiedError):
        model.fit(panel({"s": (RNG.normal(size=5), [], [])}))
    with pytest.raises(ValueError):
        model.predict(1, panel({"other": (RNG.normal(size=30), [], [])}))
