"""Lookups in the stored adjacency table equal scans of the graph, and read only what they need."""

import random
import re

import pytest
from pyspark.sql import functions as F

from dossier import schemas
from dossier.operators import adjacency
from dossier.operators import graph as gr
from dossier.operators import retrieval as rt
from dossier.sources import writers


@pytest.fixture(scope="module")
def graph(spark):
    random.seed(12)
    pick = random.choice
    groups, incidents, urls = [f"g{i}" for i in range(5)], [f"i{i}" for i in range(60)], [f"http://u/{i}" for i in range(12)]
    edges = {(f"x{i % 3}", "Industry", "HAD_INCIDENT", n, "Incident") for i, n in enumerate(incidents)}
    edges |= {(n, "Incident", "PERPETRATED_BY", pick(groups), "Group") for n in incidents for _ in range(2)}
    edges |= {(n, "Incident", "CITED_BY", pick(urls), "Source") for n in incidents[:40] for _ in range(3)}
    nodes = {
        "Incident": spark.createDataFrame([(n, f"victim {n}" if k % 4 else None) for k, n in enumerate(incidents)], "id string, victim string"),
        "Group": spark.createDataFrame([(n,) for n in groups], "id string"),
    }
    return gr.Graph(nodes, spark.createDataFrame(sorted(edges), schemas.EDGE))


@pytest.fixture(scope="module")
def stored(graph, tmp_path_factory):
    return writers.write_adjacency(graph, str(tmp_path_factory.mktemp("adjacency") / "table"), buckets=16)


ASKED = [("Group", "g1"), ("Incident", "i3"), ("Incident", "i50"), ("Industry", "x1"), ("Source", "http://u/2"), ("Theme", "none")]


def rows(df):
    return sorted((tuple(map(str, r)) for r in df.collect()))


def test_lookups_equal_scans(spark, graph, stored):
    asked = spark.createDataFrame(ASKED, "label string, id string")
    for name in ("neighbours", "neighbour_context", "cited_sources"):
        assert rows(getattr(adjacency, name)(stored, asked)) == rows(getattr(gr, name)(graph, asked)), name
    hits = asked.withColumns({"text": F.col("id"), "score": F.lit(0.5)})
    assert rows(rt.expand_hits(hits, stored)) == rows(rt.expand_hits(hits, graph))
    nobody = asked.filter("id = 'no'")
    assert all(getattr(adjacency, name)(stored, nobody).count() == 0 for name in ("neighbours", "neighbour_context", "cited_sources"))


def test_only_buckets_of_the_asked_are_read(spark, stored):
    asked = spark.createDataFrame(ASKED[:1], "label string, id string")
    near = stored.near(asked)
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (=|IN)", near._jdf.queryExecution().executedPlan().toString())
    assert len(near.select(F.input_file_name()).distinct().collect()) == 1
    kept = spark.read.schema(adjacency.ROWS).parquet(stored.path)
    assert kept.filter(F.col("bucket") != adjacency.bucket_of(16)).isEmpty()
