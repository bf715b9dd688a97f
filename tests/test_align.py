import pytest
from pyspark.sql import functions as F

from periodica import FrequencyError, IntersectionError, align
from periodica.functions.periods import period_index, period_label
from periodica.operators.align import PanelDataset, future_periods
from periodica.operators.quality import series_rules

M2021 = 2021 * 12


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_period_index_and_label(spark):
    df = spark.sql("SELECT timestamp_ntz'1999-11-30 10:00:00' AS t")
    out = df.select(*[period_label(period_index("t", f), f).alias(f) for f in "YQMD"]).first()
    assert tuple(out) == ("1999", "1999Q4", "1999-11", "1999-11-30")


def test_no_exogenous(series):
    ds = align(series({"e": (2009 * 12, [1.1])}), None, "M")
    assert ds.exog_vars == ()
    assert rows(ds.endogenous_data, "period_idx", "y") == [(2009 * 12, 1.1)]
    assert ds.future_exogenous_data.count() == 0
    assert ds.PCA(0.5).exog_vars == ()
    with pytest.raises(KeyError):
        ds.downsample(["nope"])
    ds.validate()


def test_empty_overlap(series, exog):
    endog = series({"e": (1999 * 4 + 1, [-1, -2])})
    with pytest.raises(IntersectionError):
        align(endog, exog([("1999-10-01", {"v1": 1.1, "v2": 2.2})]), "Q")
    with pytest.raises(IntersectionError):
        align(endog, exog([("1990-10-01", {"v1": 1.1, "v2": 2.2})]), "Q")


def test_future_rows(series, exog):
    x = exog([(d, {"myVar": v}) for d, v in (
        ("2021-05-31", 1), ("2021-06-01", 2), ("2021-07-15", 3), ("2021-08-01", 4), ("2021-09-30", 5))])
    ds = align(series({"v": (M2021 + 5, [-2, -3])}), x, "M").validate()
    assert ds.exog_vars == ("myVar",)
    assert rows(ds.exogenous_data, "period_idx", "myVar") == [(M2021 + 5, 2.0), (M2021 + 6, 3.0)]
    assert rows(ds.endogenous_data, "y") == [(-3.0,), (-2.0,)]
    assert rows(ds.future_exogenous(exog_vars=["myVar"]), "period_idx", "myVar") == [(M2021 + 7, 4.0), (M2021 + 8, 5.0)]
    assert rows(ds.future_exogenous(horizon=1), "myVar") == [(4.0,)]
    assert ds.future_exogenous(horizon=0).count() == 0
    for none in (ds.downsample([]), ds.PCA(0.0)):
        assert none.exog_vars == ()
        assert none.df.filter(F.size("x") > 0).count() == 0
        assert none.future.count() == 2
        assert none.endogenous_data.count() == 2
    assert ds.pca_loadings(0.0).count() == 0


def test_mean_of_several_observations(series, exog):
    x = exog([("2021-05-01", {"var1": 17, "var2": 18}), ("2021-05-31", {"var1": 34, "var2": 36}),
              ("2021-06-01", {"var1": 1, "var2": 2}), ("2021-06-30", {"var1": -1, "var2": -2})])
    ds = align(series({"endog": (M2021 + 5, [1, 2])}), x, "M").validate()
    for same in (ds, ds.downsample(["var1", "var2"])):
        assert rows(same.exogenous_data, "period_idx", "var1", "var2") == [(M2021 + 5, 0.0, 0.0)]
        assert rows(same.endogenous_data, "y") == [(1.0,)]
        with pytest.raises(ValueError):
            same.future_exogenous(horizon=1)
        assert same.future_exogenous().count() == 0
    pca = ds.PCA(1.0)
    assert [len(r["x"]) for r in pca.df.collect()] == [1]
    load = ds.pca_loadings(1.0).collect()
    assert {r["var"] for r in load} == {"var1", "var2"} and len(load) == 2
    assert all(r["loading"] is not None and abs(r["loading"]) <= 1 for r in load)


def test_too_low_frequency(series, exog):
    x = exog([("1999-09-30", {"v": 1.1}), ("2000-01-01", {"v": 2.2})])
    endog = series({"a": (1999 * 4 + 2, [-1]), "b": (2000 * 4, [5.0])})
    with pytest.raises(FrequencyError):
        align(endog.filter("series_id = 'a'"), x, "Q")
    assert issubclass(FrequencyError, ValueError)
    kept = align(endog, x, "Q", on_invalid="quarantine").df
    assert {r["series_id"] for r in kept.collect()} == {"b"}


def test_series_rules(series, spark):
    good = series({"ok": (10, [1, 2, 3]), "gap": (10, [1])}).union(series({"gap": (12, [1]), "dup": (5, [1])}))
    bad = good.union(series({"dup": (5, [2])}))
    broken = {(r["series_id"], r["rule"]) for r in series_rules(bad).filter(~F.col("ok")).collect()}
    assert broken == {("gap", "no_gap"), ("dup", "no_duplicate_period")}


def test_dataset_rules_find_faults(spark):
    rows_ = [("a", 1, False, 1.0, [1.0]), ("a", 3, False, float("inf"), [1.0]), ("a", 9, True, 2.0, [float("nan")])]
    df = spark.createDataFrame(rows_, "series_id string, period_idx bigint, is_future boolean, y double, x array<double>")
    rules = {r["rule"]: r["ok"] for r in PanelDataset(df, "M", ("v",)).rules().collect()}
    assert rules == {
        "no_duplicate_period": True, "no_gap_realized": False, "no_gap_future": True, "future_follows_realized": False,
        "endog_finite": False, "endog_only_realized": False, "exog_finite_and_complete": False, "one_realized_row": True,
    }


def test_future_periods(series):
    out = future_periods(series({"a": (10, [1, 2]), "b": (4, [1])}), 2)
    assert rows(out, "series_id", "h", "period_idx") == [("a", 1, 12), ("a", 2, 13), ("b", 1, 5), ("b", 2, 6)]
    assert future_periods(series({"a": (10, [1])}), 0).count() == 0
