"""Readers for the three input layouts, each a lazy DataFrame -> DataFrame shaping.

* statement: one row per label, one column per quarter (``QX YY``)
* year_month: one row per year, one column per month name
* dated: a sheet export with variable names in line 4 and dated rows from line 7
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from periodica.errors import ImportFailed
from periodica.functions.periods import month_number, period_label, quarter_label_index
from periodica.operators.fill import backfill_forward_fill, drop_empty_vars
from periodica.operators.quality import raise_on_violations, series_rules
from periodica.session import materialize

# Cell texts read as null in statements (fixed values): the layout's own three first.
STATEMENT_NULLS = (
    "", "-", " ", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "n/a", "nan", "null",
)

# Lines of a dated sheet (fixed values, first line is 1).
DATED_NAMES_LINE = 4
DATED_FIRST_DATA_LINE = 7

SERIES_SCHEMA = "series_id string, period_idx bigint, period string, y double"
EXOG_SCHEMA = "var string, ts timestamp_ntz, value double"


def _strict_double(raw: Column, strict: bool) -> Column:
    # ANSI cast fails the job on "(123)" or "1,234"; the lenient form gives null.
    return raw.cast("double") if strict else raw.try_cast("double")


# --- statement -----------------------------------------------------------------------------


def read_statement(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Statement CSV as strings; quoted labels may hold newlines, labels are not trimmed.

    Several files must share one header. Spark checks that itself unless a header
    cell is empty, which it cannot compare. A ``.parquet`` table of the same layout
    is read as it is.
    """
    paths = [path] if isinstance(path, str) else list(path)
    if all(p.endswith(".parquet") for p in paths):
        return spark.read.parquet(*paths)
    reader = (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
    )
    df = reader.csv(paths)
    if any(re.fullmatch(r"_c\d+", c) for c in df.columns):
        return df
    return reader.option("enforceSchema", False).csv(paths)


def quarter_columns(columns: Sequence[str]) -> list[str]:
    """Columns whose whole name is ``QX YY``; every other column is dropped."""
    return [c for c in columns if re.fullmatch(r"Q[1-4]\s\d\d", c)]


def unpivot_quarters(df: DataFrame, label: str = "Description") -> DataFrame:
    """Wide quarters to ``(label, quarter, raw)`` rows."""
    quarters = quarter_columns(df.columns)
    if not quarters:
        return df.sparkSession.createDataFrame([], f"`{label}` string, quarter string, raw string")
    cols = [F.col(f"`{q}`").cast("string").alias(q) for q in quarters]
    return df.select(F.col(label), *cols).unpivot(label, quarters, "quarter", "raw")


def statement_series(
    df: DataFrame, as_of_year: int, endog: str | None = None, label: str = "Description"
) -> DataFrame:
    """Quarterly series of a statement.

    With ``endog`` the one label is picked by exact match and bad numbers fail
    the job. Without it every label becomes a series; a label that is repeated or
    holds text where a number belongs is left out (see :func:`statement_quarantine`).
    """
    cells = _statement_cells(df, as_of_year, label, strict=endog is not None)
    if endog is not None:
        if endog == "":
            raise ImportFailed("the endogenous label cannot be empty")
        picked = cells.filter(F.col("series_id") == endog)
        return _finish_statement(picked)
    good = cells.join(_label_faults(cells), "series_id", "left_anti")
    return _finish_statement(good)


def statement_quarantine(df: DataFrame, as_of_year: int, label: str = "Description") -> DataFrame:
    """Labels that panel mode leaves out, with the reason."""
    return _label_faults(_statement_cells(df, as_of_year, label, strict=False))


def _statement_cells(df: DataFrame, as_of_year: int, label: str, strict: bool) -> DataFrame:
    raw = F.when(~F.col("raw").isin(*STATEMENT_NULLS), F.col("raw"))
    return unpivot_quarters(df, label).filter(F.col(label).isNotNull()).select(
        F.col(label).alias("series_id"),
        quarter_label_index("quarter", as_of_year).alias("period_idx"),
        raw.alias("raw"),
        F.coalesce(_strict_double(raw, strict), F.lit(0.0)).alias("y"),
    )


def _label_faults(cells: DataFrame) -> DataFrame:
    # count per (label, quarter) first: map-side combined, so a hot label is many small groups
    per_cell = cells.groupBy("series_id", "period_idx").agg(
        F.count("*").alias("n"),
        F.max((F.col("raw").isNotNull() & F.col("raw").try_cast("double").isNull())).alias("text"),
    )
    return (
        per_cell.groupBy("series_id")
        .agg(F.max("n").alias("n"), F.max("text").alias("text"))
        .filter((F.col("n") > 1) | F.col("text"))
        .select("series_id", F.when(F.col("n") > 1, "duplicate label").otherwise("not a number").alias("reason"))
    )


def _finish_statement(cells: DataFrame) -> DataFrame:
    return cells.select("series_id", "period_idx", period_label("period_idx", "Q").alias("period"), "y")


# --- year by month -------------------------------------------------------------------------


def read_year_month(spark: SparkSession, path: str) -> DataFrame:
    """Year-by-month grid from CSV, or from a ``.parquet`` table of the same layout."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    return spark.read.option("header", True).csv(path)


def year_month_series(df: DataFrame, endog: str, year: str = "Year") -> DataFrame:
    """Year-by-month grid to a monthly series; empty cells are no observations."""
    months = [c for c in df.columns if c != year]
    if not months:
        return df.sparkSession.createDataFrame([], SERIES_SCHEMA)
    cells = df.select(
        F.col(year).cast("int").alias("year"),
        *[F.nullif(F.col(f"`{m}`").cast("string"), F.lit("")).alias(m) for m in months],
    ).unpivot("year", months, "month", "raw")
    known = F.coalesce(
        month_number("month"), F.raise_error(F.concat(F.lit("unknown month name: "), F.col("month")))
    )
    idx = F.col("year").cast("bigint") * 12 + known - 1
    return cells.filter(F.col("raw").isNotNull()).select(
        F.lit(endog).alias("series_id"),
        idx.cast("bigint").alias("period_idx"),
        period_label(idx, "M").alias("period"),
        F.col("raw").cast("double").alias("y"),
    )


# --- dated table ---------------------------------------------------------------------------


def numbered_lines(spark: SparkSession, path: str, header: int) -> DataFrame:
    """``(file, line, head, value)``: every line of every file with its number from 1, and line ``header`` of its file.

    A file is read in as many splits as its size asks for. The lines are written once with the split they start in and a
    number that counts up by one inside a split; lines before a split are a running sum over one row per split. Both
    come from that one written scan, so a changed cluster or a lost executor cannot move a split between passes. The
    join deals lines by split, whose size is bounded, so a file that holds most of the rows is no hot key.
    """
    at = ("file", "block")
    lines = materialize(spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        "value",
    ))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = materialize(
        lines.groupBy(*at).agg(F.min("seq").alias("first"), F.count("*").alias("n"))
        .select(*at, "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), "first")
        .select(*at, "n", "before", (F.col("before") - F.col("first") + 1).alias("shift"))
    )
    number = F.col("seq") + F.col("shift")
    holds = F.lit(header).between(F.col("before") + 1, F.col("before") + F.col("n"))
    heads = lines.join(splits.filter(holds), list(at)).filter(number == header).select("file", F.col("value").alias("head"))
    return lines.join(splits.select(*at, "shift").join(heads, "file", "left"), list(at)).select("file", number.alias("line"), "head", "value")


def read_dated(spark: SparkSession, path: str) -> DataFrame:
    """Cells of dated sheet exports as ``(file, line, col, name, day, raw)``; line numbers decide what is header."""
    # commas inside double quotes do not separate cells
    def cells_of(line: Column) -> Column:
        return F.transform(F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda c: F.regexp_replace(c, '^"|"$', ""))

    rows = numbered_lines(spark, path, DATED_NAMES_LINE).select(
        "file", "line", cells_of(F.col("head")).alias("names"), cells_of(F.col("value")).alias("cells")
    )
    # the condition on the line keeps the check of days above the join that numbers the lines
    day = F.when(F.col("line") >= DATED_FIRST_DATA_LINE, _sheet_day(F.get("cells", F.lit(0))))
    return (
        rows.withColumn("day", day)
        .filter(F.col("day").isNotNull())
        .select("file", "line", "day", "names", F.posexplode(F.slice("cells", F.lit(2), F.greatest(F.size("cells") - 1, F.lit(0)))))
        .select(
            "file",
            "line",
            (F.col("pos") + 1).alias("col"),
            F.coalesce(F.get("names", F.col("pos") + 1), F.lit("")).alias("name"),
            "day",
            F.nullif(F.trim("col"), F.lit("")).alias("raw"),
        )
    )


def _sheet_day(cell: Column) -> Column:
    """Null for an empty index cell, an error for text that is no date."""
    text = F.nullif(F.trim(cell), F.lit(""))
    day = F.coalesce(
        F.try_to_timestamp(text, F.lit("M/d/yyyy")),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd")),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")),
    ).cast("date")
    return F.when(text.isNull(), F.lit(None).cast("date")).otherwise(
        F.coalesce(day, F.raise_error(F.concat(F.lit("not a date: "), text)).cast("date"))
    )


def dated_exog(cells: DataFrame) -> DataFrame:
    """Filled long table ``(var, ts, value)`` of :func:`read_dated` cells."""
    long = cells.select(
        F.col("name").alias("var"),
        F.col("day").cast("timestamp_ntz").alias("ts"),
        F.col("line").alias("row_no"),
        F.col("raw").cast("double").alias("value"),
    )
    return drop_empty_vars(backfill_forward_fill(long)).select("var", "ts", "value")


def check_unique_names(cells: DataFrame) -> None:
    """Two kept columns of one file must not share a name, the empty name included."""
    clash = (
        cells.groupBy("file", "name", "col")
        .agg(F.count("raw").alias("n"))
        .filter((F.col("n") > 0) | (F.col("name") == ""))
        .groupBy("file", "name")
        .agg(F.count("*").alias("n_cols"))
        .filter(F.col("n_cols") > 1)
        .limit(1)
        .collect()
    )
    if clash:
        raise ImportFailed(f"column name {clash[0]['name']!r} appears more than once")


# --- format dispatch -----------------------------------------------------------------------


def _statement(spark: SparkSession, path: str, endog: str, as_of_year: int) -> DataFrame:
    raw = read_statement(spark, path)
    if endog == "" or raw.filter(F.col("Description") == endog).limit(2).count() != 1:
        raise ImportFailed(f"label {endog!r} must appear exactly once")
    return statement_series(raw, as_of_year, endog)


def _year_month(spark: SparkSession, path: str, endog: str, as_of_year: int) -> DataFrame:
    return year_month_series(read_year_month(spark, path), endog)


def _dated(spark: SparkSession, path: str) -> DataFrame:
    cells = read_dated(spark, path)
    check_unique_names(cells)
    return dated_exog(cells)


ENDOG_FORMATS: dict[str, tuple[Callable[..., DataFrame], str]] = {
    "financial_statement": (_statement, "Q"),
    "excel_table": (_year_month, "M"),
}
EXOG_FORMATS: dict[str, Callable[..., DataFrame]] = {"macro": _dated}


def endog_frequency(fmt: str) -> str:
    return ENDOG_FORMATS[fmt][1]


def import_endogenous(
    spark: SparkSession, path: str, endog: str, fmt: str, as_of_year: int, validate: bool = True
) -> DataFrame:
    """One named series from a file of a known format, checked on arrival."""
    if fmt not in ENDOG_FORMATS:
        raise ValueError(f"endogenous format {fmt!r} not recognized")
    try:
        series = ENDOG_FORMATS[fmt][0](spark, path, endog, as_of_year)
        if validate:
            raise_on_violations(series_rules(series))
    except PySparkException as err:
        raise ImportFailed(f"cannot import {path}: check layout, label and format") from err
    return series


def import_exogenous(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """Dated variables of a file of a known format, filled."""
    if fmt not in EXOG_FORMATS:
        raise ValueError(f"exogenous format {fmt!r} not recognized")
    try:
        return EXOG_FORMATS[fmt](spark, path)
    except PySparkException as err:
        raise ImportFailed(f"cannot import {path}: check layout and format") from err
