"""Rows are dealt into tasks by their number, and what unfolds them is evaluated once per row."""

from pyspark.sql import functions as F

from dossier import schemas
from dossier.operators import graph as gr
from dossier.plans.catalog import bindings as b
from dossier.session import spread
from dossier.sources import readers


def test_tasks_follow_the_rows(spark):
    for n in (100, 1000):
        rows = spread(spark.range(n).withColumn("x", F.lit(None).cast("string")).coalesce(1), 10)
        sizes = [r[0] for r in rows.groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert rows.rdd.getNumPartitions() == n // 10 and max(sizes) <= 40
        assert rows.agg(F.sum("id")).first()[0] == n * (n - 1) // 2
    one = spark.range(10).coalesce(1)
    assert spread(one, 10) is one


def test_records_of_one_file_are_dealt(spark, tmp_path, monkeypatch):
    parts = spark.range(500).selectExpr(
        "id AS p_partkey", "concat('hot ring ', id % 7) AS p_name", "concat('Brand#', id % 5) AS p_brand",
        "'LARGE' AS p_type", "CAST(id % 50 + 1 AS INT) AS p_size", "1.0D AS p_retailprice",
    )
    parts.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    whole = sorted(map(str, gr.subcategory_nodes(b.records(spark, str(tmp_path))).collect()))
    assert b.records(spark, str(tmp_path)).rdd.getNumPartitions() == 1
    monkeypatch.setattr(b, "RECORDS_A_TASK", 50)
    assert b.records(spark, str(tmp_path)).rdd.getNumPartitions() == 10
    assert sorted(map(str, gr.subcategory_nodes(b.records(spark, str(tmp_path))).collect())) == whole


def test_last_mention_of_a_subcategory_counts_whatever_its_spelling(spark):
    category = lambda name, subs: {"category": name, "description": "d", "subcategories": subs}
    rows = [
        ("a", [category("Old & Risk", ["Web-Shell", None]), category("--", ["x"])], [], 1),
        ("b", [category("old and risk", ["web shell", "Web  shell"])], [category("Old And Risk", ["WEB SHELL"])], 2),
        ("c", [category("Old/and risk", ["tape"])], None, 3),
    ]
    kind = schemas.CATEGORY.simpleString()
    records = spark.createDataFrame(rows, f"industry string, hazard_categories array<{kind}>, exposure_categories array<{kind}>, _pos long")
    nodes = {r.id: (r.name, r.parent, r.kind) for r in gr.subcategory_nodes(records).collect()}
    assert nodes == {
        "old and risk::web shell": ("WEB SHELL", "Old And Risk", "exposure"),
        "old and risk::": (None, "Old & Risk", "hazard"),
        "old and risk::tape": ("tape", "Old/and risk", "hazard"),
    }
    edges = gr.merge_edges(gr.subcategory_edges(records)).select("from_label", "to").collect()
    assert sorted(map(tuple, edges)) == [("Exposure", "old and risk::web shell"), *[("Hazard", i) for i in sorted(nodes)]]


def test_journal_lines_are_parsed_once(spark):
    lines = spark.createDataFrame([('{"type":"result","value":{"industry":"x"}}', 1), ('{"type":"result"}', 2), ("no", 3)], "value string, n int")
    rows = readers.journal_records(lines)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson(value") == 1 and plan.count("from_json(") == 1
    assert [(r.industry, r.n) for r in rows.collect()] == [("x", 1)]
