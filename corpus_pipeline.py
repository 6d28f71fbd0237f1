"""The training-data pipeline: five stages over `documents`, each written as Parquet and read by the next.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of `documents`. Rows that repeat are treated alike in every stage.
"""

from __future__ import annotations

from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm import bpe, decontamination, line_dedup, near_dedup, toxicity
from dossier.session import shared_dir

VOCABULARY = "byte_bpe_50k.json"
#: Near-duplicates in the pipeline: words of a shingle, percent of similarity.
SHINGLE, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model predicts to be toxic go. It is learned from the labelled documents of the folder."""
    model = toxicity.learn(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose template recurs go; a document of which nothing is left goes too. `n_chars` follows the text."""
    kept = line_dedup.drop_lines(docs).filter((F.col("n_dropped") == 0) | (F.trim("text") != ""))
    return kept.withColumn("n_chars", F.when(F.col("n_dropped") == 0, F.col("n_chars")).otherwise(F.length("text"))).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id.

    Of an id with several texts only those go that are copies. A row with a null id is
    linked with nothing, so it always stays, copy or not.
    """
    found = near_dedup.near_duplicates(docs, size=SHINGLE, percent=PERCENT, text_hash=True)
    copies = found.filter(~F.col("kept")).select(F.col("doc_id").alias("copy"), F.col("text_hash").alias("copy_text")).distinct()
    same = (F.col("doc_id") == F.col("copy")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("copy_text"))
    return docs.join(copies, same, "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    key = F.struct(F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text"))
    found = decontamination.find_overlaps(docs.select(key.alias("key"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="key")
    leaks = found.filter("contaminated").select(F.col("key.doc_id").alias("leak"), F.col("key.text").alias("leak_text")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("leak")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("leak_text"))
    return docs.join(leaks, same, "left_anti")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of each document, with digests of them and of the text decoded from them."""
    return bpe.encode_texts(docs, public_tokenizers.path(VOCABULARY), outputs=("ids",))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_recurring_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", tokenize),
]

#: The stages learn a model and run a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents of a folder; each result is written to the shared folder and read again."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
