"""Session settings and the one way this package cuts lineage."""

from __future__ import annotations

import re
import tempfile
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cores: str = "8", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("dossier")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster or the caller has named.

    Only a local session, whose tasks all run in the driver's process, gets one of its own
    where none is named; anywhere else a missing name is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="dossier-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def find_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where it is installed, whatever their folder is."""
    root = str(Path(__file__).resolve().parents[1])
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        environment["PYTHONPATH"] = f"{root}:{known}".rstrip(":")


def spread(df: DataFrame, rows: int) -> DataFrame:
    """The rows of a stored table, dealt by a hash of their columns into tasks of about ``rows`` each.

    A well compressed file is one split however many rows it unfolds into, so a task's share
    would grow with the table. Only the number of rows is read beforehand; a table that fits one task stays.
    """
    tasks = -(-df.count() // rows)
    return df.repartition(tasks, *[F.col(f"`{c}`") for c in df.columns]) if tasks > 1 else df


def cut(df: DataFrame) -> DataFrame:
    """Write a small intermediate result that several branches read to the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Write an intermediate result that may be large to the shared folder by columns, and read it back.

    It takes a fraction of the space of ``cut``, and a branch reads the columns it needs.
    A column that Parquet cannot hold leaves the rows to ``cut``.
    """
    if any("void" in kind or kind == "interval" for _, kind in df.dtypes):
        return cut(df)
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
