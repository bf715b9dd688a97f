import random

import pytest
from pyspark.sql import functions as F

from periodica.operators import fill


def brute(rows):
    """Next later non-null value, else the last earlier one, per variable."""
    out = {}
    for var in {r[0] for r in rows}:
        ordered = sorted((r for r in rows if r[0] == var), key=lambda r: (r[1], r[2]))
        vals = [r[3] for r in ordered]
        for i, r in enumerate(ordered):
            later = [v for v in vals[i:] if v is not None]
            earlier = [v for v in vals[: i + 1] if v is not None]
            out[(var, r[2])] = later[0] if later else (earlier[-1] if earlier else None)
    return out


@pytest.mark.parametrize("parts", [1, 3, 40])
@pytest.mark.parametrize("instants", [4, 500])
def test_fill_matches_brute_force(spark, parts, instants):
    rnd = random.Random(5)
    rows = []
    for i in range(600):
        var = "hot" if i % 3 else rnd.choice(["a", "b", "none", None])
        at = rnd.randrange(instants)
        value = None if var in ("none", None) or rnd.random() < 0.8 else float(i)
        rows.append((var, f"2020-01-{at // 60 + 1:02d} 00:00:{at % 60:02d}", i, value))
    df = spark.createDataFrame(rows, "var string, t string, row_no bigint, value double")
    df = df.withColumn("ts", F.col("t").cast("timestamp_ntz"))
    got = fill.backfill_forward_fill(df, partitions=parts)
    assert got.columns == df.columns
    assert {(r["var"], r["row_no"]): r["value"] for r in got.collect()} == brute(rows)
    assert {r["var"] for r in fill.drop_empty_vars(got).select("var").distinct().collect()} == {"hot", "a", "b"}


def test_values_flow_over_partitions_without_any(spark):
    """One value at each end of a variable that fills many partitions."""
    values = {3: 1.0, 996: 2.0}
    df = spark.createDataFrame([("v", i, values.get(i)) for i in range(1000)] + [("w", 5, None)], "var string, row_no bigint, value double")
    df = df.withColumn("ts", F.to_timestamp_ntz(F.lit("2020-01-01")))
    got = {(r["var"], r["row_no"]): r["value"] for r in fill.backfill_forward_fill(df, partitions=16).collect()}
    assert all(got["v", i] == (1.0 if i <= 3 else 2.0) for i in range(1000)) and got["w", 5] is None


def test_two_keys_and_an_empty_table(spark):
    df = spark.createDataFrame([("a", 1, 1, None), ("a", 2, 2, 7.0), ("a", 1, 3, 5.0)], "g string, var int, row_no bigint, value double")
    df = df.withColumn("ts", F.to_date(F.lit("2020-01-01")))
    got = fill.backfill_forward_fill(df, keys=("g", "var"), partitions=2)
    assert {r["row_no"]: r["value"] for r in got.collect()} == {1: 5.0, 2: 7.0, 3: 5.0}
    assert fill.backfill_forward_fill(df.limit(0), keys=("g", "var")).count() == 0


def test_fill_windows_are_split(spark):
    df = spark.range(10).select(F.lit("v").alias("var"), F.current_timestamp().alias("ts"), F.col("id").alias("row_no"), F.lit(1.0).alias("value"))
    plan = fill.backfill_forward_fill(df)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "windowspecdefinition" in line]
    assert windows and all("windowspecdefinition(_pid#" in w for w in windows) and "unboundedfollowing" not in plan.lower()
