import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark():
    from periodica.session import local_session

    return local_session("tests", "4")


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture
def series(spark):
    """Series rows from ``{name: (first period, values)}``."""

    def build(data):
        rows = [(k, first + i, float(v)) for k, (first, values) in data.items() for i, v in enumerate(values)]
        return spark.createDataFrame(rows, "series_id string, period_idx bigint, y double")

    return build


@pytest.fixture
def exog(spark):
    """Long dated variables from ``[(date text, {var: value})]``."""

    def build(rows):
        from pyspark.sql import functions as F

        flat = [(v, d, float(x)) for d, cells in rows for v, x in cells.items()]
        df = spark.createDataFrame(flat, "var string, d string, value double")
        return df.select("var", F.col("d").cast("timestamp_ntz").alias("ts"), "value")

    return build


@pytest.fixture
def panel(spark):
    """A dataset straight from arrays: ``{name: (y, x rows, future x rows)}``."""

    def build(data, freq="M", first=24000, n_vars=0):
        from periodica.operators.align import PanelDataset

        rows = []
        for name, (y, x, fx) in data.items():
            for i, v in enumerate(y):
                rows.append((name, first + i, False, float(v), [float(a) for a in (x[i] if n_vars else [])]))
            for i, a in enumerate(fx):
                rows.append((name, first + len(y) + i, True, None, [float(b) for b in a]))
        df = spark.createDataFrame(
            rows, "series_id string, period_idx bigint, is_future boolean, y double, x array<double>"
        )
        return PanelDataset(df, freq, tuple(f"x{i}" for i in range(n_vars)))

    return build
