"""Run every query in Spark and its SQL in DuckDB and compare values, order aside."""

from __future__ import annotations

import sys
import time

import duckdb
import pyarrow as pa

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def kind(t: pa.DataType) -> str:
    """Integers of any width are one kind, and so are floats; other types stand for themselves."""
    if pa.types.is_integer(t):
        return "integer"
    if pa.types.is_floating(t):
        return "float"
    if pa.types.is_string(t) or pa.types.is_large_string(t):
        return "string"
    return str(t)


def sorted_rows(t: pa.Table, columns: list[str]) -> list[tuple]:
    rows = zip(*[t.column(c).to_pylist() for c in columns])
    return sorted(rows, key=lambda r: [(v is None, 0 if v is None else v) for v in r])


def difference(spark_table: pa.Table, sql_table: pa.Table) -> str | None:
    """What differs between two tables whose row order does not count, or None."""
    columns = sorted(spark_table.column_names)
    if columns != sorted(sql_table.column_names):
        return f"columns {columns} / {sorted(sql_table.column_names)}"
    if spark_table.num_rows != sql_table.num_rows:
        return f"rows {spark_table.num_rows} / {sql_table.num_rows}"
    for c in columns:
        kinds = kind(spark_table.schema.field(c).type), kind(sql_table.schema.field(c).type)
        if kinds[0] != kinds[1]:
            return f"column {c}: type {kinds[0]} / {kinds[1]}"
    pairs = zip(sorted_rows(spark_table, columns), sorted_rows(sql_table, columns))
    for a, b in pairs:
        if a != b:
            return f"row {dict(zip(columns, a))} / {dict(zip(columns, b))}"
    return None


def main(sf_dir: str, only: list[str]) -> int:
    sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
    import __spark_entry__ as entry
    from periodica.session import local_session

    spark, con = local_session(), duck(sf_dir)
    bad = 0
    for name, build in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            got = build(spark, sf_dir).toArrow()
        except Exception as err:  # noqa: BLE001
            print(f"FAIL {name}: {str(err)[:600]}")
            bad += 1
            continue
        took = time.time() - start
        sql = entry.oracle_sql().get(name)
        note = "no sql"
        if sql is not None:
            try:
                note = difference(got, con.execute(sql).to_arrow_table()) or "match"
            except Exception as err:  # noqa: BLE001
                note = f"sql error {str(err)[:400]}"
            bad += note != "match"
        print(f"{'ok  ' if note in ('match', 'no sql') else 'FAIL'} {name}: {got.num_rows} rows, {took:.2f}s, {note}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
