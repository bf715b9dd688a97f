import datetime as dt

import pytest

from periodica import ImportFailed
from periodica.functions.periods import quarter_label_index
from periodica.sources.layouts import (
    EXOG_FORMATS,
    import_endogenous,
    import_exogenous,
    read_statement,
    statement_quarantine,
    statement_series,
)
from periodica.sources.sinks import write_outputs, write_table


def write(path, text):
    path.write_bytes(text.encode("utf-8"))
    return str(path)


def values(df):
    return [(r["period"], r["y"]) for r in df.orderBy("period_idx").collect()]


def statement(spark, path, var, year=2026):
    return import_endogenous(spark, path, var, "financial_statement", year)


def test_statement_without_quarters(spark, tmp_path):
    path = write(tmp_path / "a.csv", "Unit,Currency,Description\r\n,,a\r\n")
    assert statement(spark, path, "a").count() == 0


def test_statement_traps(spark, tmp_path):
    text = ('Description,Q1 11,Q1 2012,Q2 11,Q3 11\n"Total\n",1, 9 ,-, \n,,,,\nbad,"(123)",1,1,1\ncomma,"1,234",1,1,1\n'
            "twin,1,1,1,1\ntwin,2,2,2,2\ntrail ,1,1,1,1\n")
    path = write(tmp_path / "a.csv", text)
    assert values(statement(spark, path, "Total\n")) == [("2011Q1", 1.0), ("2011Q2", 0.0), ("2011Q3", 0.0)]
    assert values(statement(spark, path, "trail "))[0] == ("2011Q1", 1.0)
    for label in ("bad", "comma", "twin", "trail", "", "absent"):
        with pytest.raises(ImportFailed):
            statement(spark, path, label).collect()
    reasons = {r["series_id"]: r["reason"] for r in statement_quarantine(read_statement(spark, path), 2026).collect()}
    assert reasons == {"bad": "not a number", "comma": "not a number", "twin": "duplicate label"}


@pytest.mark.parametrize("as_of", [2026, 2099, 2100, 1999])
def test_quarter_label_century(spark, as_of):
    for year in (as_of, as_of + 1 - 100):
        labels = [(f"Q{q} {year % 100:02d}",) for q in (1, 2, 3, 4)]
        df = spark.createDataFrame(labels, "label string").select(quarter_label_index("label", as_of).alias("i"))
        assert [r["i"] for r in df.collect()] == [year * 4 + q for q in range(4)]
    odd = spark.createDataFrame([("Q5 10",), ("Q1 2010",), ("FQ1 10",)], "label string")
    assert all(r["i"] is None for r in odd.select(quarter_label_index("label", as_of).alias("i")).collect())


def year_month(spark, path, var="v"):
    return import_endogenous(spark, path, var, "excel_table", 2026)


def dated(spark, tmp_path, names, rows, name="m.csv"):
    lines = ["t,x", "01/01/1900,7", "", names, "unit,u", "src,s", *rows]
    return import_exogenous(spark, write(tmp_path / name, "\r\n".join(lines)), "macro")


def cells(df):
    return sorted((r["var"], r["ts"], r["value"]) for r in df.collect())


def test_unknown_formats(spark):
    with pytest.raises(ValueError):
        import_endogenous(spark, "x", "v", "parquet", 2026)
    with pytest.raises(ValueError):
        import_exogenous(spark, "x", "csv")
    assert set(EXOG_FORMATS) == {"macro"}


def test_missing_file(spark):
    with pytest.raises(ImportFailed):
        import_endogenous(spark, "/nowhere/a.csv", "v", "excel_table", 2026)


def test_parquet_tables_of_the_same_layouts(spark, tmp_path):
    grid = spark.createDataFrame([(2001, 1.5, None), (2000, None, 2.5)], "Year int, JAN double, December double")
    grid.write.parquet(str(tmp_path / "grid.parquet"))
    assert values(year_month(spark, str(tmp_path / "grid.parquet"))) == [("2000-12", 2.5), ("2001-01", 1.5)]
    cells = spark.createDataFrame([("bla", 1.0, None)], "Description string, `Q1 11` double, `Q2 11` double")
    cells.write.parquet(str(tmp_path / "st.parquet"))
    assert values(statement(spark, str(tmp_path / "st.parquet"), "bla")) == [("2011Q1", 1.0), ("2011Q2", 0.0)]


def test_statement_columns_in_any_order(spark, tmp_path):
    """Quarters are sorted, empty cells are zero, other columns and the byte-order mark do not matter."""
    rows = {"Net sales": {"Q2 18": 40.5, "Q4 17": -3.25, "Q1 18": None, "Q3 17": 11.0}, "Costs": {"Q2 18": 1.0, "Q4 17": 2.0, "Q1 18": 3.0, "Q3 17": 4.0}}
    heads = ["Q2 18", "Q4 17", "Q1 18", "Q3 17"]
    lines = [",".join(["Note", *heads[:2], "Description", *heads[2:]])]
    for name, cells in rows.items():
        shown = ["" if cells[h] is None else str(cells[h]) for h in heads]
        lines.append(",".join(["n", *shown[:2], name, *shown[2:]]))
    path = write(tmp_path / "s.csv", "\ufeff" + "\n".join(lines) + "\n")
    order = [("2017Q3", "Q3 17"), ("2017Q4", "Q4 17"), ("2018Q1", "Q1 18"), ("2018Q2", "Q2 18")]
    for name, cells in rows.items():
        assert values(statement(spark, path, name)) == [(p, cells[h] or 0.0) for p, h in order]
    assert {r["series_id"] for r in statement_series(read_statement(spark, path), 2026).collect()} == set(rows)


def test_grid_of_two_years(spark, tmp_path):
    names = ["Jan", "february", "MAR", "Abril", "mayo", "June", "julio", "Aug", "septiembre", "Oct", "NOVIEMBRE", "dec"]
    cells = {(2010, m): round(m * 1.25, 2) for m in range(5, 13)} | {(2011, m): -float(m) for m in range(1, 8)}
    lines = [",".join(["Year", *names])] + [",".join([str(y), *[str(cells.get((y, m), "")) for m in range(1, 13)]]) for y in (2011, 2010)]
    path = write(tmp_path / "grid.csv", "\n".join(lines) + "\n")
    assert values(year_month(spark, path, "sales")) == [(f"{y}-{m:02d}", v) for (y, m), v in sorted(cells.items())]
    holed = write(tmp_path / "holed.csv", "Year,February,May\n1990,1,2\n")
    with pytest.raises(AssertionError):
        year_month(spark, holed)
    with pytest.raises(ImportFailed):
        year_month(spark, write(tmp_path / "odd.csv", "Year,Smarch\n1990,1\n"))


def test_dated_sheet_fills_by_day(spark, tmp_path):
    """Rows come in any order; empty cells take the next value by day, then the last one."""
    rows = ["07/04/2015,9,", "07/01/2015,,5", "07/02/2015,6.5,", "07/03/2015,,", ",1,1"]
    out = cells(dated(spark, tmp_path, ',rate,"price, net",empty', [r + "," for r in rows]))
    days = [dt.datetime(2015, 7, d) for d in (1, 2, 3, 4)]
    want = [("price, net", d, 5.0) for d in days] + [("rate", d, v) for d, v in zip(days, (6.5, 6.5, 9.0, 9.0), strict=True)]
    assert out == want
    for i, (names, row) in enumerate(((",rate,rate", "07/01/2015,1,2"), (",,", "07/01/2015,1,2"), (",rate", "July,1"))):
        with pytest.raises(ImportFailed):
            dated(spark, tmp_path, names, [row], f"bad{i}.csv")


def test_lines_are_numbered_across_splits(spark, tmp_path):
    """A sheet read in many small splits, beside others of other widths, one without names and an empty one."""
    from periodica.sources.layouts import read_dated

    days = [dt.date(2001, 1, 1) + dt.timedelta(days=i) for i in range(400)]
    want, folder = {}, tmp_path / "sheets"
    folder.mkdir()
    for name, k, end in (("a.csv", 3, "\r\n"), ("b.csv", 1, "\n"), ("c.csv", 7, "\n")):
        top = ["t", "", "01/01/1900,9" * 30, "," + ",".join(f"{name}{j}" for j in range(k)), "u", ""]
        rows = [f"{d:%m/%d/%Y}," + ",".join(str(i * 10 + j) for j in range(k)) for i, d in enumerate(days)]
        (folder / name).write_bytes(end.join([*top, *rows, "", ""]).encode())
        want |= {(name, i + 7, f"{name}{j}"): float(i * 10 + j) for i in range(len(days)) for j in range(k)}
    (folder / "short.csv").write_text("x\n01/01/2000,1\n")
    (folder / "empty.csv").write_text("")
    (folder / "nameless.csv").write_text("a\nb\nc\n\ne\nf\n01/01/2000,5\n")
    want["nameless.csv", 7, ""] = 5.0
    for size in ("134217728", "2500"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0" if size == "2500" else "4194304")
        try:
            if size == "2500":
                assert spark.read.text(str(folder)).rdd.getNumPartitions() > 8
            got = {(r["file"].rsplit("/", 1)[1], r["line"], r["name"]): float(r["raw"]) for r in read_dated(spark, str(folder)).collect()}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert got == want


def test_every_output_is_written(spark, tmp_path):
    df = spark.createDataFrame([("a", i, float(i)) for i in (5, 3, 8)], "series_id string, h int, prediction double")
    out = write_table(df, str(tmp_path / "sorted"), "csv", order_by=["h"])
    assert [r["h"] for r in spark.read.option("header", True).csv(out).collect()] == ["3", "5", "8"]
    names = ["data", "pca", "fit", "information", "diagnostics", "predict", "sliding_window"]
    paths = write_outputs(dict.fromkeys(names, df), str(tmp_path / "out"), "parquet")
    assert sorted(paths) == sorted(names) and all(spark.read.parquet(p).count() == 3 for p in paths.values())
    with pytest.raises(ValueError):
        write_table(df, str(tmp_path / "x"), "xlsx")
