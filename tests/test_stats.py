import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from periodica.functions.tails import f_cdf
from periodica.operators.reduce import covariances, pca_fit
from periodica.operators import reduce as reduce_mod
from periodica.operators.stats import DF_P, DF_SIZES, DF_STAT, adf_ndiffs, autocorrelation, difference, kpss_ndiffs, kpss_stat


def by_key(df, value="ndiffs"):
    return {r["series_id"]: r[value] for r in df.collect()}


def kpss(y):
    n, e = len(y), y - y.mean()
    lags = int(3 * math.sqrt(n) / 13)
    s2 = e @ e / n + 2 / n * sum((1 - i / (lags + 1)) * (e[i:] @ e[:-i]) for i in range(1, lags + 1))
    return (np.cumsum(e) ** 2).sum() / n**2 / s2


def test_kpss_against_numpy(series):
    rng = np.random.default_rng(1)
    data = {f"s{n}": (5, rng.normal(size=n).cumsum()) for n in (10, 30, 100, 400)}
    got = by_key(kpss_stat(series(data)), "kpss")
    for k, (_, y) in data.items():
        assert got[k] == pytest.approx(kpss(np.asarray(y)), rel=1e-9)


def test_ndiffs(series):
    rng = np.random.default_rng(2)
    walk = rng.normal(size=300).cumsum()
    data = {
        "constant": (0, np.ones(20)), "line": (0, np.arange(30.0)), "noise": (0, rng.normal(size=300)),
        "walk": (0, walk), "double": (0, walk.cumsum()), "one": (0, [1.0]),
    }
    assert by_key(kpss_ndiffs(series(data))) == {"constant": 0, "line": 1, "noise": 0, "walk": 1, "double": 2, "one": 0}
    adf = by_key(adf_ndiffs(series(data)))
    assert adf["noise"] == 0 and adf["walk"] == 1 and adf["double"] == 2 and adf["constant"] == 0


def test_adf_statistic_against_normal_equations(series):
    rng = np.random.default_rng(3)
    data = {f"s{n}": (7, rng.normal(size=n).cumsum() + 1e5) for n in (9, 30, 60, 140)} | {"line": (0, np.arange(40.0)), "two": (0, [1.0, 2.0])}
    got = {r["series_id"]: r for r in adf_ndiffs(series(data)).collect()}
    for name, (_, y) in data.items():
        n, dy = len(y), np.diff(y)
        k = int((n - 1) ** (1 / 3) + 1e-9)
        t = np.arange(k, n - 1)
        if len(t) <= 3 + k or name == "line":  # too few rows, or a level that is the trend
            assert got[name]["adf_stat"] is None and got[name]["p_value"] is None and got[name]["ndiffs"] == 0
            continue
        a = np.column_stack([np.ones(len(t)), t, y[t] - 1e5] + [dy[t - i] for i in range(1, k + 1)])
        g = np.linalg.inv(a.T @ a)
        c = g @ a.T @ dy[t]
        r = dy[t] - a @ c
        stat = c[2] / math.sqrt(g[2, 2] * (r @ r) / (len(t) - a.shape[1]))
        assert got[name]["adf_stat"] == pytest.approx(stat, rel=1e-6)
        table = [np.interp(n - 1, DF_SIZES, column) for column in zip(*DF_STAT)]
        assert got[name]["p_value"] == pytest.approx(np.interp(stat, table, DF_P), rel=1e-6)


def test_autocorrelation(series):
    rng = np.random.default_rng(4)
    y = rng.normal(size=37)
    got = {r["lag"]: r["r"] for r in autocorrelation(series({"a": (0, y)})).collect()}
    e = y - y.mean()
    assert sorted(got) == list(range(1, 38))
    for h in (1, 2, 17, 36):
        assert got[h] == pytest.approx((e[h:] @ e[:-h]) / (e @ e), abs=1e-12)
    assert got[37] == 0
    assert autocorrelation(series({"a": (0, y)}), 4).count() == 4


def test_difference(series):
    y = np.random.default_rng(5).normal(size=30)
    got = difference(series({"a": (100, y)}), d=1, D=1, m=4).orderBy("period_idx").collect()
    z = y[4:] - y[:-4]
    assert [r["period_idx"] for r in got] == list(range(105, 130))
    assert [r["z"] for r in got] == pytest.approx((z[1:] - z[:-1]).tolist())


def sklearn_like(x, share):
    """Principal components of standardised columns, largest absolute score positive."""
    std = x.std(axis=0)
    z = np.where(std > 0, (x - x.mean(axis=0)) / np.where(std > 0, std, 1), 0)
    u, s, vt = np.linalg.svd(z - z.mean(axis=0), full_matrices=False)
    top = np.abs(u).argmax(axis=0)
    vt *= np.sign(u[top, range(u.shape[1])])[:, None]
    ratio = s**2 / (s**2).sum()
    k = np.searchsorted(np.cumsum(ratio), share, side="right") + 1 if share < 1 else min(x.shape)
    return vt[:k], ratio[:k]


@pytest.mark.parametrize("share", [0.3, 0.8, 1.0])
@pytest.mark.parametrize("wide", [24, 0])
def test_pca_against_numpy(panel, monkeypatch, share, wide):
    monkeypatch.setattr(reduce_mod, "WIDE_VARS", wide)
    rng = np.random.default_rng(6)
    data = {}
    for name in ("a", "b"):
        x = rng.normal(size=(40, 5)) @ rng.normal(size=(5, 5)) + 10
        x[:, 4] = 3.0  # constant variable
        data[name] = (rng.normal(size=40), x, rng.normal(size=(3, 5)))
    ds = panel(data, n_vars=5)
    fit = {r["series_id"]: r for r in pca_fit(ds, share).collect()}
    scores = {k: {} for k in data}
    for r in ds.PCA(share).df.collect():
        scores[r["series_id"]][r["period_idx"]] = r["x"]
    for name, (_, x, fx) in data.items():
        vt, ratio = sklearn_like(x, share)
        keep = ratio > 1e-12
        assert len(fit[name]["vec"]) == len(vt)
        np.testing.assert_allclose(np.array(fit[name]["vec"])[keep], vt[keep], atol=1e-8)
        np.testing.assert_allclose(fit[name]["ratio"], ratio, atol=1e-10)
        got = np.array([scores[name][24000 + i] for i in range(43)])
        np.testing.assert_allclose(got[:, keep], (np.vstack([x, fx]) @ vt.T)[:, keep], atol=1e-7)
    assert covariances(ds).count() == 2
    ds.PCA(share).validate()


def test_pca_label_is_largest_loading(panel):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(30, 3))
    x[:, 2] = x[:, 0] * 2 + rng.normal(size=30) * 0.01
    for r in panel({"a": (np.ones(30), x, [])}, n_vars=3).pca_loadings(1.0).collect():
        assert r["component_name"].startswith(f"PCA{r['component']}_correlated_w_x")


def test_f_distribution():
    assert f_cdf(1.0, 26) == pytest.approx(0.5, abs=1e-12)
    # dof 2: F/(1+F); dof 4: 3x^2 - 2x^3 with x = F/(1+F)
    for v in (0.1, 0.7, 3.0, 20.0):
        x = v / (1 + v)
        assert f_cdf(v, 2) == pytest.approx(x, abs=1e-12)
        assert f_cdf(v, 4) == pytest.approx(3 * x**2 - 2 * x**3, abs=1e-12)
    assert F is not None
