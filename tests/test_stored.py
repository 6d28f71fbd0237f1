"""Keys and node tables that several branches read are built once, and large rows are stored by columns."""

import pytest
from pyspark.sql import functions as F

from dossier import functions as fn
from dossier.operators import graph as gr
from dossier.plans.catalog import QUERIES
from dossier.plans.catalog import bindings as b
from dossier.session import stored
from dossier.sources import writers


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    tables = {
        "part": spark.range(60).selectExpr(
            "id AS p_partkey", "concat('hot ring ', id % 7) AS p_name", "concat('Brand#', id % 5) AS p_brand",
            "'LARGE' AS p_type", "CAST(id % 50 + 1 AS INT) AS p_size", "1.0D AS p_retailprice",
        ),
        "orders": spark.range(80).selectExpr(
            "id AS o_orderkey", "id % 30 AS o_custkey", "substr('FOP', CAST(id % 3 AS INT) + 1, 1) AS o_orderstatus",
            "4000.0D + id * 500 AS o_totalprice", "TIMESTAMP '2001-02-03' AS o_orderdate", "concat(id % 2 + 1, '-URGENT') AS o_orderpriority",
        ),
        "nation": spark.range(3).selectExpr("id AS n_nationkey", "concat('NATION_', id) AS n_name", "id % 2 AS n_regionkey"),
        "embeddings": spark.range(40).selectExpr("id AS vec_id", "array(CAST(id AS FLOAT)) AS embedding", "CAST(id % 5 AS INT) AS label"),
    }
    for name, rows in tables.items():
        rows.coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return path


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_keys_of_categories_are_built_once(spark, folder):
    g = b.graph(spark, folder)
    for rows in (g.nodes["Subcategory"].select("id").distinct(), g.nodes["Hazard"].select("id"), g.of_type("INCLUDES"), g.of_type("EXPOSES")):
        assert rows.count() > 0 and "regexp_replace" not in plan(rows)
    found = gr.merge_edges(gr.all_category_edges(b.records(spark, folder)))
    every = g.edges.filter(F.col("type").isin("FACES", "EXPOSES", "INCLUDES"))
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, found.collect()))


def test_no_join_tests_a_key_for_null(spark):
    texts = spark.createDataFrame([("A & B",), (None,)], "t string").select(fn.norm_key("t").alias("id"))
    assert not texts.schema["id"].nullable
    assert [r.id for r in texts.collect()] == ["a and b", ""]


def test_nodes_of_the_vector_table_are_built_once(spark, folder):
    rows = QUERIES["vector_table"](spark, folder)
    assert "Generate" not in plan(rows) and "regexp_replace" not in plan(rows)
    assert {r.label for r in rows.select("label").collect()} == {"Industry", "Hazard", "Exposure", "Incident", "Subcategory"}


def test_edges_that_meet_nodes_are_built_once(spark, folder):
    rows = QUERIES["edges_meet_nodes"](spark, folder)
    assert "ATTACKED_BY" not in plan(rows)
    assert all(r.edges == r.resolved for r in rows.collect()) and rows.count() == 10


def test_rows_for_folders_are_stored_by_columns(spark):
    rows = spark.range(100).selectExpr("id % 3 AS folder", "id")
    out = writers.dealt(rows, "folder", "id")
    assert out.inputFiles() and all("/stored-" in f for f in out.inputFiles())
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, rows.collect()))


def test_rows_that_parquet_cannot_hold_are_stored_too(spark):
    rows = spark.range(3).withColumn("none", F.lit(None))
    assert sorted(map(tuple, stored(rows).collect())) == [(0, None), (1, None), (2, None)]
