import numpy as np
import pytest

from periodica import RunConfig, run_all
from periodica.plans.run import run_on_dataset


def write(path, text):
    path.write_text(text)
    return str(path)


@pytest.fixture
def files(tmp_path):
    rng = np.random.default_rng(0)
    quarters = [f"Q{q} {y}" for y in range(10, 20) for q in (1, 2, 3, 4)]
    cells = ",".join(f"{v:.3f}" for v in rng.normal(size=40).cumsum() + 100)
    endog = write(tmp_path / "endog.csv", f"Currency,Description,{','.join(quarters)}\nUSD,EBITDA,{cells}\nUSD,other,{cells}\n")
    lines = ["a", "b", "c", ",gdp,rate,cpi", "d", "e"]
    for y in range(2010, 2021):
        for m in (1, 4, 7, 10):
            lines.append(f"{m:02d}/15/{y}," + ",".join(f"{v:.4f}" for v in rng.normal(size=3)))
    exog = write(tmp_path / "exog.csv", "\n".join(lines))
    return endog, exog


def test_whole_chain(spark, files):
    endog, exog = files
    cfg = RunConfig(
        endog, "financial_statement", "EBITDA", 2026, exog, "macro", pca=0.8, fit=True, predict=4, sliding_window=0.8,
        p_d_q_order=(1, 0, 0),
    )
    out = run_all(spark, cfg)
    assert set(out) == {"pca", "data", "fit", "information", "diagnostics", "predict", "sliding_window"}
    n_components = out["pca"].select("component").distinct().count()
    assert 1 <= n_components <= 3
    assert out["data"].count() == 44
    assert out["predict"].count() == 4 and out["sliding_window"].count() == 8
    names = [r["param"] for r in out["fit"].orderBy("pos").collect()]
    assert names == ["intercept", "drift", *[f"PCA{i}" for i in range(n_components)], "ar.L1"]


def test_chain_without_variables(spark, files):
    out = run_all(spark, RunConfig(files[0], "financial_statement", "EBITDA", 2026, predict=2, model="BruteForceARIMARegression", p_d_q_order=(0, 1, 0)))
    assert out["predict"].count() == 2 and "pca" not in out


def test_column_subset(panel):
    rng = np.random.default_rng(1)
    ds = panel({"a": (rng.normal(size=20), rng.normal(size=(20, 3)), rng.normal(size=(2, 3)))}, n_vars=3)
    out = run_on_dataset(ds, RunConfig("", "excel_table", "y", 2026, exog_vars=["x2"], fit=True))
    assert [r["param"] for r in out["fit"].orderBy("pos").collect()] == ["intercept", "drift", "x2"]


@pytest.mark.parametrize("bad", [
    dict(exog_path="x"), dict(exog_format="macro"), dict(pca=1.5), dict(p_d_q_order=(-1, 0, 0)), dict(sliding_window=1.2),
    dict(sliding_window=0.0), dict(model="x"), dict(predict=-1), dict(on_invalid="drop"), dict(endog_var=None),
    dict(endog_var=None, on_invalid="quarantine"),
])
def test_option_rules(bad):
    with pytest.raises(ValueError):
        RunConfig(**dict(endog_path="e", endog_format="excel_table", endog_var="y", as_of_year=2026) | bad).check()


def test_panel_mode_lists_what_it_leaves_out(spark, files, tmp_path):
    """Every label of a statement at once: a text, a repeated label and a label of too few quarters are listed, the rest is fitted."""
    quarters = [f"Q{q} {y}" for y in range(10, 20) for q in (1, 2, 3, 4)]
    rng = np.random.default_rng(7)
    rows = {"good": rng.normal(size=40).cumsum(), "other": rng.normal(size=40)}
    lines = [f"{k},{','.join(f'{v:.3f}' for v in r)}" for k, r in rows.items()]
    lines += ["text," + ",".join(["1"] * 39 + ["(1)"]), "twin," + ",".join(["1"] * 40), "twin," + ",".join(["2"] * 40), "endless," + ",".join(["1"] * 39 + ["Infinity"])]
    path = write(tmp_path / "all.csv", f"Description,{','.join(quarters)}\n" + "\n".join(lines) + "\n")
    cfg = RunConfig(path, "financial_statement", None, 2026, files[1], "macro", fit=True, predict=2, statistics=True, on_invalid="quarantine")
    out = run_all(spark, cfg)
    listed = {tuple(r) for r in out["quarantine"].collect()}
    assert listed == {("text", "import", "not a number"), ("twin", "import", "duplicate label"), ("endless", "dataset", "endog_finite")}
    for name in ("data", "fit", "predict", "autocorrelation", "stationarity"):
        assert {r[0] for r in out[name].select("series_id").distinct().collect()} == {"good", "other"}, name
    assert {r["test"] for r in out["stationarity"].collect()} == {"adf", "kpss"} and out["stationarity"].count() == 4


def test_ledger_names_the_first_stage(spark):
    """A gap, a repeat, a null, a series beyond the variables, an infinity and a short one; each at its first stage only."""
    from periodica.operators.ledger import broken, quarantine
    from periodica.plans.models import SARIMARegression
    from pyspark.sql import functions as F

    inf = float("inf")
    data = {
        "ok": [(100 + i, float(i % 5)) for i in range(12)], "gap": [(100, 1.0), (102, inf)], "twice": [(100, 1.0), (100, 2.0), (101, 1.0), (103, 1.0)],
        "null": [(100, None), (101, 1.0)], "late": [(300 + i, 1.0) for i in range(12)], "inf": [(100 + i, inf if i == 3 else 1.0) for i in range(12)],
        "short": [(110, 1.0), (111, 2.0)],
    }
    endog = spark.createDataFrame([(k, p, y) for k, rows in data.items() for p, y in rows], "series_id string, period_idx bigint, y double")
    exog_x = spark.range(90, 120).select(F.col("id").alias("period_idx"), F.array(F.sin(F.col("id"))).alias("x"))
    ds, left_out = quarantine(endog, exog_x, "M", ["x0"])
    model = SARIMARegression((1, 0, 0), on_invalid="quarantine")
    got = {tuple(r) for r in left_out.unionByName(broken(model.rules(ds), "model")).collect()}
    assert got == {
        ("gap", "series", "no_gap"), ("twice", "series", "no_duplicate_period"), ("twice", "series", "no_gap"), ("null", "series", "no_null"),
        ("late", "align", "overlaps"), ("inf", "dataset", "endog_finite"), ("short", "model", "enough_rows_for_terms"),
    }
    fitted = {r[0] for r in model.fit(ds).coefficients.select("series_id").distinct().collect()}
    assert fitted == {"ok"} and {r[0] for r in ds.df.select("series_id").distinct().collect()} == {"ok", "short"}
    empty, none = quarantine(endog.limit(0), None, "M")
    assert empty.df.count() == 0 and none.count() == 0
