from pathlib import Path

import pytest
from pyspark.sql import functions as F

from dossier.operators import graph as gr
from dossier.operators import tables
from dossier.plans import jobs
from dossier.plans.catalog import bindings as b
from dossier.sources import readers

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no tables")


@pytest.fixture(scope="module")
def data(spark):
    return jobs.build_dataset(b.records(spark, FOLDER), b.raw_postings(spark, FOLDER), b.synthesis(spark, FOLDER))


def test_build_and_write(spark, data, tmp_path):
    jobs.write_dataset(data, str(tmp_path))
    docs = {name: spark.read.parquet(f"{tmp_path}/documents/{name}") for name in data.documents}
    brands = spark.read.parquet(f"{FOLDER}/part.parquet").select("p_brand").distinct().count()
    assert docs["industries"].count() == brands
    assert docs["victims"].count() == docs["victims"].select("_id").distinct().count()
    row = docs["insights"].first()
    assert row.total_victims == docs["victims"].count() and len(row.top_groups) == 15 and len(row.coverage) == 7
    assert row.researched_incidents == docs["incidents"].count()
    assert docs["taxonomy"].agg(F.sum("reach")).first()[0] == spark.read.parquet(f"{tmp_path}/documents/taxonomy_members").count()
    back = readers.read_graph(spark, f"{tmp_path}/graph")
    assert back.of_type("FACES").count() == data.graph.of_type("FACES").count()
    assert (tmp_path / "flat" / "incidents.csv").exists() and (tmp_path / "graph" / "bulk_victims.csv").exists()
    attacks = back.of_type("ATTACKED_BY")
    assert gr.resolve_edges(attacks, back.node_keys()).count() == attacks.count() > 0
    assert docs["insights_heatmap"].count() > 0 and "heatmap" not in docs["insights"].columns


def test_answers(spark):
    raw = b.raw_postings(spark, FOLDER)
    postings = tables.normalize_postings(raw)
    incidents = tables.incidents_table(b.records(spark, FOLDER))
    g = b.graph(spark, FOLDER)
    ask = lambda q, **o: jobs.answer(spark, q, postings, incidents, g, **o)
    lane, rows = ask("All attacks by Group 17?")
    assert lane == "entity" and "leak-site victims" in rows.first().text
    lane, rows = ask("How many victims in total?")
    assert lane == "analytical" and rows.count() == 8
    lane, rows = ask("Exposed in healthcare but not in energy?")
    assert lane == "relational" and rows.columns == ["type", "text"]
    lane, rows = ask("Why is retail a target?")
    assert lane == "analytical"
    given = g.nodes["Exposure"].select(
        F.lit("Exposure").alias("label"), "id", F.array(F.lit(1.0), F.length("id") / 100).cast("array<float>").alias("embedding")
    )
    from dossier.operators.retrieval import vector_table

    vectors = vector_table({"Exposure": g.nodes["Exposure"]}, given)
    lane, rows = ask("Why is retail a target?", vectors=vectors, question_vector=[0.0, 1.0])
    assert lane == "semantic" and rows.first().linked


def test_answers_with_facts(spark):
    raw = b.raw_postings(spark, FOLDER)
    postings = tables.normalize_postings(raw)
    incidents = tables.incidents_table(b.records(spark, FOLDER))
    ask = lambda q: jobs.answer_with_facts(spark, q, raw, postings, incidents, b.graph(spark, FOLDER))
    lane, _, facts = ask("All attacks by Group 17?")
    total = postings.filter(F.startswith(F.lower("group"), F.lit("group 17"))).count()
    assert lane == "entity" and facts.filter("fact = 'total'").first().value == total
    lane, _, facts = ask("How many victims in total?")
    assert lane == "analytical" and facts.filter("fact = 'total_victims'").first().value == postings.count()
    assert ask("Exposed in healthcare but not in energy?")[2] is None


def test_take_in(spark):
    industries = tables.dedupe_richest(b.records(spark, FOLDER))
    raw = b.raw_postings(spark, FOLDER)
    known = industries.first().industry
    rows = [
        (1, "other-cyber", known, raw.filter("victim <> '' AND trim(`group`) <> ''").first().victim, "unknown"),
        (2, "ransomware", known, "Acme Inc", "G"),
        (3, "ransomware", known, "ACME", "G"),
    ]
    df = spark.createDataFrame(rows, "_pos long, incident_type string, industry string, victim string, `group` string")
    fields = ["date", "country", "summary", "financial_impact", "ransom_demanded_or_paid", "downtime_and_recovery", "data_impact"]
    df = df.withColumns({c: F.lit("x") for c in fields}).withColumn("sources", F.array(F.lit("https://a")))
    statuses, added = jobs.take_in(industries, df, raw)
    got = {r._pos: (r.status, r.enriched) for r in statuses.collect()}
    assert got[2] == ("added", False) and got[3] == ("skip:duplicate-in-batch", False) and got[1][1]
    assert {r.ingest_source for r in added.collect()} == {"sec/news"}
