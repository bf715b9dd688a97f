"""Session defaults, shared intermediate tables and the size guard for broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Largest side, in bytes, that is ever sent whole to every executor.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024

_local_folder: str | None = None


def local_session(app: str = "periodica", cpus: str = "8", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def bounded_side(df: DataFrame, max_rows: int, row_bytes: int) -> DataFrame:
    """Mark ``df`` for broadcast only when its proven size fits the limit.

    ``max_rows`` must be an upper bound that does not grow with the input (for
    example the number of periods in a calendar range). Above the limit the
    frame is returned unmarked, so the join is planned and re-planned by AQE as
    an ordinary shuffled join.
    """
    return F.broadcast(df) if max_rows * row_bytes <= BROADCAST_LIMIT_BYTES else df


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for intermediate tables; a local one only in local mode."""
    global _local_folder
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="periodica-")
    return _local_folder


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    Meant for small results of large scans that several later steps read: the raw
    data is scanned once, a lost executor costs no recomputation, and the planner
    knows the true size of the table when it chooses a join.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/periodica-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_all(*dfs: DataFrame) -> list[DataFrame]:
    """:func:`materialize` several independent frames at the same time."""
    with ThreadPoolExecutor(max_workers=len(dfs)) as pool:
        return list(pool.map(materialize, dfs))
