"""Incremental forms of the batch loads as Structured Streaming queries.

Every query runs with ``availableNow``: it takes what has arrived since the last run,
commits and ends, so a lost executor or a restart costs no row and repeats none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from dossier.operators.intake import victim_key
from dossier.operators.ranking import first_per
from dossier.sources.keyed import KeyedTable


def file_stream(
    spark: SparkSession, path: str, schema: T.StructType, format: str = "json", **options: str
) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.schema(schema).format(format).options(**options).load(path)


def append_new(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Incremental ingest: files already taken are skipped by the checkpoint."""
    return (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def replace_by_key(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keyed load as a log: every micro-batch lands in its own folder.

    A repeated batch overwrites its folder, so the load is idempotent, and its cost follows
    the batch and not the table. ``current_rows`` reads the state.
    """

    def land(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (
        stream.writeStream.foreachBatch(land)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_rows(spark: SparkSession, out: str, key: str, *order: Column | str) -> DataFrame:
    """The last row per key over all batches of a keyed load."""
    log = spark.read.parquet(out)
    return first_per(log, key, F.desc("batch"), *order).drop("batch")


def compact(spark: SparkSession, out: str, target: str, key: str, *order: Column | str) -> None:
    """Write the current state of a keyed load as the first batch of a new log."""
    current_rows(spark, out, key, *order).write.mode("overwrite").parquet(f"{target}/batch=-1")


def replace_in_buckets(stream: DataFrame, table: KeyedTable, checkpoint: str, *order: Column | str) -> StreamingQuery:
    """Keyed load into a bucketed table: a micro-batch rewrites the buckets of its keys and no other.

    Within a batch the first row per key in the given order counts, between batches the
    later one. A repeated batch leaves the same rows.
    """
    return (
        stream.writeStream.foreachBatch(lambda batch, number: table.upsert(batch, *order))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def first_per_victim(
    stream: DataFrame, out: str, checkpoint: str, *order: Column | str, victim: str = "victim"
) -> StreamingQuery:
    """First record per victim over the life of the stream, as a log of new victims per micro-batch.

    The first records are the state of a streaming aggregate, so a micro-batch looks at its
    own victims only and costs the same however long the log is. Rows are compared by the
    time of their micro-batch, which a repeated batch keeps, and then by ``order``,
    ascending. A victim is written by the batch in which it is first seen. Partial results
    merge before the shuffle, so a victim with very many rows is no burden.
    """
    if not order:
        raise ValueError("name the order that tells which record of a victim is the first")
    row = F.struct(*[F.col(f"`{c}`") for c in stream.columns])
    keyed = stream.select(victim_key(victim).alias("victim_key"), F.current_timestamp().alias("_at"), F.struct(*order).alias("_order"), row.alias("_row"))
    seen = keyed.filter(F.col("victim_key") != "").groupBy("victim_key").agg(
        F.min_by("_row", F.struct("_at", "_order")).alias("_row"), F.min("_at").alias("_first"), F.max("_at").alias("_last")
    )
    fresh = seen.filter(F.col("_first") == F.col("_last")).select("_row.*", "victim_key")

    def land(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (
        fresh.writeStream.foreachBatch(land)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
