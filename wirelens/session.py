"""Session settings, and the ways this library cuts a plan in pieces.

`scratch_table` writes an intermediate result to the shared folder the cluster names in
``spark.checkpoint.dir`` and reads it back. It survives the loss of executors, is columnar (so later
readers prune columns) and tells the planner its size.

`measured_table` does the same and observes its size, so that a broadcast is decided on a known size.
`small_side` decides whether a per-capture lookup may be broadcast. It looks at the number of rows
first; a larger lookup is joined by shuffle.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SMALL_ROWS = 10_000
BROADCAST_ROWS = 500_000


def build_session(app: str = "wirelens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect. Cluster settings are left to the cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        **RUNTIME_SETTINGS,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Capturing the Python call site of every column costs more than building it.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


RUNTIME_SETTINGS = {
    # All text forms of times are UTC, as in the record schemas.
    "spark.sql.session.timeZone": "UTC",
    # The JVM does not compile methods above this size. Wide projections (parsed log lines, packet
    # measures) would run interpreted as one method; operator by operator they are compiled.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # By number of rows alone, batches of captured frames would fill the memory of Python workers.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
    # Keyed streaming state with lists and timers needs this store.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def adopt(spark: SparkSession) -> SparkSession:
    """Put the settings results and speed depend on into a session made elsewhere."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; a private one only on a local master without one (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="wirelens-"))
        root = spark.sparkContext.getCheckpointDir()
    return root


def scratch_folder(spark: SparkSession) -> str:
    """Where this application keeps its intermediate tables."""
    return f"{scratch_root(spark)}/wirelens/{spark.sparkContext.applicationId}"


#: Called when intermediate tables go; whoever keeps DataFrames over them forgets these.
ON_RELEASE: list = []


def release_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables, once its results are written."""
    for forget in ON_RELEASE:
        forget()
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: a durable cut of the lineage."""
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(table: DataFrame) -> None:
    """Delete a scratch table that nothing reads any more."""
    spark = table.sparkSession
    for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Meanwhile, a query's shuffle files go when it ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def measured_table(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, dict]:
    """A scratch table, its number of rows `n` and further aggregates, observed while writing."""
    seen = Observation()
    watched = df.observe(
        seen, F.count(F.lit(1)).alias("n"), *[m.alias(key) for key, m in measures.items()]
    )
    return scratch_table(watched, name), seen.get


def spread(df: DataFrame) -> DataFrame:
    """Share out rows that come in fewer pieces than there are cores, as from one compressed file.

    A table of many pieces is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small_side(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """`df` as a broadcastable table if it has at most `max_rows` rows, else `df` unchanged.

    Meant for one-row-per-capture lookups. At most ``max_rows + 1`` rows reach the driver; beyond
    that the caller's join runs as an ordinary shuffle join, where AQE splits a hot capture.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def broadcast_table(table: DataFrame, rows: int, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a scratch table whose measured rows are few enough; else no hint."""
    return F.broadcast(table) if rows <= max_rows else table
