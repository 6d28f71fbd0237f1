"""Sinks: flat files, collections, graph files, keyed replacement."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dossier import functions as fn
from dossier import schemas
from dossier.operators.adjacency import BUCKETS, Adjacency, adjacency_rows, bucket_of
from dossier.operators.graph import Graph
from dossier.operators.ranking import first_per
from dossier.operators.tables import distinct_sources, require
from dossier.session import cut, stored

#: Rows that one task writes, some per cent less as a rule.
TASK_ROWS = 1_000_000
MAX_RECORDS_PER_FILE = 5_000_000


def _csv(df: DataFrame):
    return (
        df.write.mode("overwrite")
        .option("header", True)
        .option("quoteAll", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
    )


def as_text(df: DataFrame) -> DataFrame:
    """Every column as text with '' for NULL."""
    return df.select([fn.text(F.col(f"`{c}`").cast("string")).alias(c) for c in df.columns])


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with every field quoted and quotes doubled."""
    _csv(as_text(df)).csv(path)


def write_collections(tables: Mapping[str, DataFrame], out: str, format: str = "parquet") -> None:
    """One folder per document table, as Parquet or JSON lines."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite").option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
        writer.format(format).save(f"{out}/{name}")


def dealt(df: DataFrame, folder: str, *order: Column | str) -> DataFrame:
    """Rows for folders, dealt into tasks by the size of each folder.

    The rows are stored by columns and counted first: a folder gets a task of its own per TASK_ROWS
    rows (less a tenth, as they are dealt by a hash of their place), so a hot folder is
    written by many tasks and a small one as one file. Inside a task rows stand in the given
    order.
    """
    rows = stored(df)
    counts = rows.groupBy(folder).agg(F.count(F.lit(1)).alias("_n"))
    parts = counts.select(folder, F.ceil(F.col("_n") / (0.9 * TASK_ROWS)).alias("_parts"))
    before = Window.orderBy(folder).rowsBetween(Window.unboundedPreceding, -1)
    plan = cut(parts.withColumn("_first", F.coalesce(F.sum("_parts").over(before), F.lit(0))))  # one row per folder
    tasks = plan.agg(F.sum("_parts")).first()[0] or 1
    # Stored rows keep their place, so a task that is run again deals them alike.
    placed = rows.withColumn("_place", F.xxhash64(F.monotonically_increasing_id()))
    named = placed.join(F.broadcast(plan.withColumnRenamed(folder, "_folder")), F.col(folder).eqNullSafe(F.col("_folder")))
    task = (F.col("_first") + F.pmod("_place", "_parts")).cast("int")
    out = named.repartitionById(tasks, task).select(*df.columns)
    return out.sortWithinPartitions(folder, *order) if order else out


def write_by_sector(raw: DataFrame, out: str, format: str = "json") -> None:
    """Postings in one folder per sector slug; a large sector becomes several files."""
    df = raw.withColumn("sector_slug", fn.sector_slug("activity")).drop("_pos")
    writer = dealt(df, "sector_slug").write.mode("overwrite").option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
    writer.partitionBy("sector_slug").format(format).save(out)


def write_sources(industries: DataFrame, out: str) -> None:
    """Every cited address once, sorted."""
    distinct_sources(industries).orderBy("url").write.mode("overwrite").text(out)


def write_nodes(g: Graph, out: str) -> None:
    for label, fields in schemas.NODE_FIELDS.items():
        if label in g.nodes:
            write_csv(g.nodes[label].select(fields), f"{out}/nodes_{label.lower()}.csv")


def write_edges(g: Graph, out: str) -> None:
    """Edge files in one folder per type, written in one pass."""
    columns = ["type", "from", "from_label", "to", "to_label"]
    _csv(dealt(as_text(g.edges.select(columns)), "type")).partitionBy("type").csv(f"{out}/rels")


def write_adjacency(g: Graph, path: str, buckets: int = BUCKETS) -> Adjacency:
    """Both directions of every edge in hash buckets of their first end, each sorted by it; a hub's bucket is several files."""
    rows = adjacency_rows(g).withColumn("bucket", bucket_of(buckets))
    dealt(rows, "bucket", "label", "id").write.mode("overwrite").partitionBy("bucket").parquet(path)
    return Adjacency(path=path, buckets=buckets, spark=rows.sparkSession)


def bulk_victims(raw: DataFrame) -> DataFrame:
    """Postings in the ten columns of the compact CSV."""
    day = lambda c: F.left(fn.text(c), F.lit(10)).alias(c)
    return require(raw, "victim").select(
        "victim",
        fn.text("activity").alias("sector"),
        fn.text("group").alias("group"),
        fn.text("country").alias("country"),
        day("attackdate"),
        day("discovered"),
        fn.text("domain").alias("domain"),
        fn.text("data_size").alias("data_size"),
        F.when(fn.text("press") != "", "yes").otherwise("").alias("has_press"),
        fn.text("ransom").alias("ransom"),
    )


def write_bulk_csv(raw: DataFrame, path: str) -> None:
    write_csv(bulk_victims(raw), path)


def upsert(base: DataFrame, updates: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """Replace whole rows by key; the first update per key in the given order counts. Applying it twice changes nothing.

    The order may use columns of ``updates`` that ``base`` does not have.
    """
    if not order:
        raise ValueError("name the order that tells which update of a key counts")
    last = first_per(updates, key, *order).select(*base.columns)
    return base.join(last.select(key), key, "left_anti").unionByName(last)
