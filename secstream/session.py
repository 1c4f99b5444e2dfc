"""Session settings and the one place that cuts lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

STREAM_STATE_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)


def local_session(cores: str = "8", app: str = "secstream") -> SparkSession:
    """A session for tests and the local benchmark; a cluster brings its own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", STREAM_STATE_PROVIDER)
        .config("spark.sql.dataFrameQueryContext.enabled", "false")  # no stack walk per Column
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def use_utc(spark: SparkSession) -> None:
    """Every event time in the library is UTC; day partitions and hours depend on it."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def work_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``, which all executors share.

    A run in one process without that setting gets a scratch folder; a cluster without it is an error,
    because a machine-local folder does not survive the loss of an executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    scratch = spark.conf.get("secstream.scratch.dir", None)
    if scratch is None:
        scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("secstream.scratch.dir", scratch)
    return scratch


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{work_dir(spark)}/secstream/{spark.sparkContext.applicationId}"


@contextmanager
def written(df: DataFrame, name: str = "batch") -> Iterator[DataFrame]:
    """``materialise`` for the length of a block; the table is removed afterwards."""
    spark, path = df.sparkSession, f"{own_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    try:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        _remove(spark, path)


def materialise(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Used where several branches read one expensive input. Unlike a cached DataFrame the written
    table survives lost executors, and unlike an RDD checkpoint it keeps column pruning, filter
    pushdown and the size statistics that join selection needs.
    """
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Remove the intermediate tables of this application; DataFrames that read them are of no more use."""
    _remove(spark, own_dir(spark))


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
