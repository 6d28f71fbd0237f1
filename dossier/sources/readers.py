"""Scans of landed files. Schemas are explicit; bad files and rows are skipped, never guessed.

Readers leave a ``_pos`` column wherever later steps depend on file and row order.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier import functions as fn
from dossier import schemas
from dossier.operators.graph import Graph, merge_edges
from dossier.operators.tables import require
from dossier.sources import ranges


def _whole_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(file, body) per file."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter=glob)
    return files.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("body"))


def read_postings_json(spark: SparkSession, path: str, glob: str = "sector_*.json") -> DataFrame:
    """Posting pulls: one JSON list of objects per file, read by many tasks where a file is large.

    A file that is no such list, or holds anything that is no JSON, gives no rows.
    """
    parts = ranges.records(spark, path, ranges.JSON_LIST, glob)
    first = F.col("block") == -1
    body = F.regexp_extract("text", r"(?s)^[\s\uFEFF]*[\[,]\s*(\{.*)$", 1)
    begun = F.when(first, F.rlike("text", F.lit(r"^[\s\uFEFF]*\["))).otherwise(F.rlike("text", F.lit(r"^\s*,")))
    parsed = F.from_json(body, T.StructType([*schemas.POSTING.fields, T.StructField("_bad", T.StringType())]), {"columnNameOfCorruptRecord": "_bad"})
    closed = F.rlike("text", F.lit(r"^\s*\]\s*\}$")) & ~first  # the last brace is the cut's own
    rows = parts.withColumn("_p", F.when(~F.col("rest"), parsed))
    fine = F.when(F.col("rest"), closed).otherwise(begun & (body != "") & F.col("_p._bad").isNull())
    broken = rows.filter(~fine).select("file").distinct()
    kept = rows.filter(~F.col("rest")).join(broken, "file", "left_anti")
    return require(kept.select("_p.*", F.struct("file", "block", "slot").alias("_pos")).drop("_bad"), "victim")


def posting_files(files: DataFrame) -> DataFrame:
    """Postings of landed files (file, body); a body that is no array or no JSON gives no rows."""
    lists = files.withColumn("body", fn.strip("body")).filter(F.startswith("body", F.lit("[")))
    rows = lists.select(
        "file", F.posexplode(F.from_json("body", T.ArrayType(schemas.POSTING))).alias("slot", "p")
    )
    return require(rows.select("p.*", F.struct("file", "slot").alias("_pos")), "victim")


def read_postings_csv(spark: SparkSession, path: str) -> DataFrame:
    """The compact posting CSV under the raw feed's column names; absent columns are blank."""
    header = spark.read.option("header", True).csv(path).columns
    schema = ", ".join(f"`{c}` STRING" for c in [*header, "_bad"])
    parts = ranges.records(spark, path, ranges.CSV).filter(F.col("block") != -1)  # without each file's header
    parts = parts.withColumn("text", F.regexp_replace("text", r"(\r?\n)?\r?$", "")).filter(fn.strip("text") != "")
    options = {"escape": '"', "columnNameOfCorruptRecord": "_bad", "maxCharsPerColumn": "-1"}
    parsed = parts.select(F.from_csv("text", F.lit(schema), options).alias("_r"), F.struct("file", "block", "slot").alias("_pos"))
    rows = require(parsed.select("_r.*", "_pos"), "victim")
    rows = rows.filter(F.col("_bad").isNull() | F.contains("_bad", F.lit(",")))
    value = lambda c: fn.text(c) if c in header else F.lit("")
    fields = {
        "victim": value("victim"),
        "activity": value("sector"),
        "group": value("group"),
        "country": value("country"),
        "attackdate": value("attackdate"),
        "discovered": value("discovered"),
        "domain": value("domain"),
        "data_size": value("data_size"),
        "press": F.when(value("has_press") != "", "y").otherwise(""),
        "ransom": value("ransom"),
        "url": F.lit(""),
        "claim_url": F.lit(""),
    }
    return rows.select(
        *[c.alias(name) for name, c in fields.items()],
        "_pos",
    )


def load_postings(spark: SparkSession, raw_dir: str, csv_path: str) -> tuple[DataFrame, str]:
    """Raw pulls if they hold rows, else the CSV, else nothing; says which was used."""
    for reader, path in ((read_postings_json, raw_dir), (read_postings_csv, csv_path)):
        try:
            rows = reader(spark, path)
            if rows.select("victim").head(1):
                return rows, path
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    return spark.createDataFrame([], schemas.POSTING), "none"


def read_journal(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Industry records from run journals, in journal and line order; missing journals are skipped.

    ``_pos`` is (number of the path, file, block, line): a journal may be a file or a folder,
    and keeps its order however its files are cut into splits.
    """
    journals = []
    for number, path in enumerate(paths):
        try:
            lines = spark.read.text(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        place = F.struct(
            F.lit(number).alias("journal"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),  # rises inside a block
        )
        journals.append(lines.select("value", place.alias("_pos")))
    if not journals:
        return spark.createDataFrame([], schemas.INDUSTRY).withColumn("_pos", F.lit(0).cast("long"))
    return journal_records(reduce(DataFrame.unionByName, journals))


def journal_records(lines: DataFrame, line: str = "value", schema: T.StructType = schemas.INDUSTRY) -> DataFrame:
    """Result payloads of journal lines, whether stored as objects or as JSON text.

    Entries and records are unfolded from arrays of one, so that no filter on them is moved
    below the parsing, where it would parse, and build the line, once more.
    """
    once = lambda c: F.explode(F.array(c))

    def part(name: str) -> Column:
        found = F.variant_get(F.col("_entry"), f"$.{name}", "variant")
        return F.when(~F.is_variant_null(found), found)

    rows = lines.select("*", once(F.try_parse_json(F.col(line))).alias("_entry")).filter(F.col("_entry").isNotNull())
    rows = rows.filter(F.try_variant_get("_entry", "$.type", "string") == "result").withColumn(
        "_value", F.coalesce(part("value"), part("result"), part("output"))
    )
    textual = F.schema_of_variant("_value") == "STRING"
    payload = F.when(textual, F.try_parse_json(F.try_variant_get("_value", "$", "string"))).otherwise(
        F.col("_value")
    )
    record = F.from_json(F.to_json(payload), schema)
    kept = [c for c in lines.columns if c != line]
    return require(rows.select(*kept, once(record).alias("_r")).select("_r.*", *kept), "industry")


def read_record_dir(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """One JSON object per file; files that are no object or name no industry are skipped."""
    return record_files(_whole_files(spark, path, glob))


def record_files(files: DataFrame) -> DataFrame:
    """Industry records of landed files (file, body), one object per file."""
    objects = files.withColumn("body", fn.strip("body")).filter(F.startswith("body", F.lit("{")))
    record = F.from_json("body", schemas.INDUSTRY)
    rows = objects.select(record.alias("_r"), F.col("file").alias("_pos")).select("_r.*", "_pos")
    return require(rows, "industry")


def read_synthesis(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SYNTHESIS).option("multiLine", True).json(path)


def split_payloads(df: DataFrame, body: str) -> tuple[DataFrame, DataFrame]:
    """Landed bodies and rejected ones: markup is rejected, a payload that is no list becomes ``[]``."""
    markup = F.startswith(fn.strip(fn.text(body)), F.lit("<"))
    parsed = F.try_parse_json(F.col(body))
    is_list = F.coalesce(F.startswith(F.schema_of_variant(parsed), F.lit("ARRAY")), F.lit(False))
    ok = df.filter(~markup).withColumn("payload", F.when(is_list, F.col(body)).otherwise("[]"))
    return ok, df.filter(markup)


def read_graph(spark: SparkSession, path: str) -> Graph:
    """The node and edge CSVs of a graph folder, one file or folder per label and edge type.

    Absent ones are left out.
    """
    reader = lambda: (
        spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    )
    nodes = {}
    for label, fields in schemas.NODE_FIELDS.items():
        try:
            df = reader().csv(f"{path}/nodes_{label.lower()}.csv")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        nodes[label] = df.select(
            [
                F.col(c).try_cast("int").alias(c) if c in schemas.INTEGER_NODE_FIELDS else F.col(c)
                for c in fields
            ]
        )
    by_type = {}
    for type in schemas.EDGE_TYPES:
        for name in (f"rels_{type.lower()}.csv", f"rels/type={type}"):
            try:
                df = reader().csv(f"{path}/{name}")
            except AnalysisException as error:
                if error.getCondition() != "PATH_NOT_FOUND":
                    raise
                continue
            rows = df.select("from", "from_label", F.lit(type).alias("type"), "to", "to_label")
            both = by_type[type].unionByName(rows) if type in by_type else rows
            by_type[type] = merge_edges(both)
    none = spark.createDataFrame([], schemas.EDGE)
    return Graph(nodes, lambda: reduce(DataFrame.unionByName, by_type.values(), none), by_type)
