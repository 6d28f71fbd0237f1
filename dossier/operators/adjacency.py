"""Neighbours of a few nodes from a stored table instead of a scan of all edges.

The table has every edge twice, once from each end, with the neighbour's display name. It is
stored in one folder per hash bucket of (label, id) and sorted inside, so a lookup opens
the folders of the asked nodes and no other. Names are joined once, when it is written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.operators import graph as gr
from dossier.operators.ranking import ranked_list
from dossier.session import cut

BUCKETS = 64
ROWS = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("label", "id", "type", "nb_label", "nb_id", "nb_name")]
    + [T.StructField("outward", T.BooleanType()), T.StructField("bucket", T.IntegerType())]
)


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("label", "id"), F.lit(buckets)).cast("int")


def adjacency_rows(g: gr.Graph) -> DataFrame:
    """(label, id, type, nb_label, nb_id, nb_name, outward): both directions of every edge."""

    def ends(a: str, z: str, outward: bool) -> Column:
        return F.struct(
            F.col(f"{a}_label").alias("label"),
            F.col(a).alias("id"),
            "type",
            F.col(f"{z}_label").alias("nb_label"),
            F.col(z).alias("nb_id"),
            F.lit(outward).alias("outward"),
        )

    both = g.edges.select(F.explode(F.array(ends("from", "to", True), ends("to", "from", False))).alias("e")).select("e.*")
    names = gr.display_names(g).select(F.col("label").alias("nb_label"), F.col("id").alias("nb_id"), F.col("name").alias("nb_name"))
    rows = both.join(names, ["nb_label", "nb_id"], "left")
    return rows.select([c for c in ROWS.names if c != "bucket"])


@dataclass(frozen=True)
class Adjacency:
    """A stored adjacency table: where it is and how many buckets it has."""

    spark: SparkSession
    path: str
    buckets: int = BUCKETS

    def near(self, asked: DataFrame) -> DataFrame:
        """The rows of the asked nodes (label, id). Only bucket numbers come to the driver, at most as many as there are."""
        numbers = [r[0] for r in asked.select(bucket_of(self.buckets).alias("b")).distinct().collect()]
        rows = self.spark.read.schema(ROWS).parquet(self.path).filter(F.col("bucket").isin(numbers))
        return rows.drop("bucket").join(asked.select("label", "id"), ["label", "id"], "left_semi")


def neighbours(stored: Adjacency, ids: DataFrame) -> DataFrame:
    """Undirected one-hop neighbours of the given nodes; nodes without any are kept."""
    asked = cut(ids.select("label", "id"))
    return stored.near(asked).select("label", "id", "nb_label", "nb_id").join(asked, ["label", "id"], "right")


def _context(asked: DataFrame, near: DataFrame, n: int) -> DataFrame:
    """(label, id, items): the first n distinct display names of the neighbours."""
    distinct = near.select("label", "id", F.coalesce("nb_name", "nb_id").alias("name")).distinct()
    return ranked_list(distinct, ["label", "id"], n, {"name": F.col("name")}, "name")


def _cited(stored: Adjacency, near: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(label, id, items) of the addresses that the nodes cite, and of those that incidents beside them cite."""
    cites = (F.col("type") == "CITED_BY") & F.col("outward")
    own = near.filter(cites).select("label", "id", F.col("nb_id").alias("url"))
    beside = cut(near.filter(F.col("nb_label") == "Incident").select("label", "id", F.col("nb_id").alias("incident")).distinct())
    incidents = beside.select(F.lit("Incident").alias("label"), F.col("incident").alias("id")).distinct()
    cited = stored.near(incidents).filter(cites).select(F.col("id").alias("incident"), F.col("nb_id").alias("url"))
    via = cited.join(beside, "incident").select("label", "id", "url")
    first = lambda df: ranked_list(df.distinct(), ["label", "id"], n, {"url": F.col("url")}, "url")
    return first(own), first(via)


def _texts(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<string>"))


def neighbour_context(stored: Adjacency, ids: DataFrame, n: int = 6) -> DataFrame:
    """Per node the first ``n`` distinct neighbour names; hubs are cut before the shuffle."""
    asked = cut(ids.select("label", "id"))
    lists = _context(asked, stored.near(asked), n)
    return asked.join(lists, ["label", "id"], "left").select("label", "id", _texts("items.name").alias("linked"))


def cited_sources(stored: Adjacency, ids: DataFrame, n: int = 4) -> DataFrame:
    """Per node up to ``n`` source URLs: its own, then those of neighbouring incidents."""
    asked = cut(ids.select("label", "id"))
    return _with_sources(asked, *_cited(stored, stored.near(asked), n), n)


def _with_sources(asked: DataFrame, own: DataFrame, via: DataFrame, n: int) -> DataFrame:
    both = asked.join(own.withColumnRenamed("items", "_own"), ["label", "id"], "left").join(via.withColumnRenamed("items", "_via"), ["label", "id"], "left")
    return both.withColumn("urls", F.slice(F.concat(_texts("_own.url"), _texts("_via.url")), 1, n)).drop("_own", "_via")


def surroundings(stored: Adjacency, ids: DataFrame, names: int = 6, urls: int = 4) -> DataFrame:
    """(label, id, linked, urls): neighbour names and cited addresses from one lookup of the nodes."""
    asked = cut(ids.select("label", "id"))
    near = cut(stored.near(asked))
    linked = asked.join(_context(asked, near, names), ["label", "id"], "left").select("label", "id", _texts("items.name").alias("linked"))
    return _with_sources(linked, *_cited(stored, near, urls), urls)
