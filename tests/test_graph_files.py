"""Known results on a folder of graph CSVs, when GRAPH_CSV_DIR names one."""

import os

import pytest
from pyspark.sql import functions as F

from dossier import functions as fn
from dossier.operators import graph as gr
from dossier.operators import patterns as pt
from dossier.sources.readers import read_graph

FOLDER = os.environ.get("GRAPH_CSV_DIR")
pytestmark = pytest.mark.skipif(not FOLDER, reason="GRAPH_CSV_DIR is not set")


@pytest.fixture(scope="module")
def g(spark):
    return read_graph(spark, FOLDER)


def test_hazard_reach(g):
    rows = pt.hazard_reach(g).collect()
    assert [r.industries for r in rows[:5]] == [13, 12, 9, 9, 6]
    assert sum(r.industries == 1 for r in rows) == 45
    assert pt.reach_paths(g, "FACES", 10).select("dst").distinct().count() == 2
    assert pt.reach_paths(g, "EXPOSES", 10).count() == 0


def test_exposure_reach(g):
    reach = [r.reach for r in gr.reach(g.of_type("EXPOSES")).collect()]
    assert sorted(reach, reverse=True)[:3] == [3, 2, 2] and reach.count(1) == 83


def test_shared_and_missing(g):
    shared = {r.to for r in gr.shared_targets(g, "FACES", "Energy and Utilities", "Manufacturing").collect()}
    assert shared == {"extortion tactics", "initial access vectors", "insider and workforce risk"}
    only = gr.only_in(g, "EXPOSES", "Healthcare and Social Assistance", "Manufacturing")
    assert only.count() == 7
    both = gr.groups_in_both(g, "Healthcare and Social Assistance", "Finance and Insurance")
    assert {r.group for r in both.collect()} == {"ALPHV", "BlackCat", "Qilin", "not publicly disclosed"}


def test_groups(g):
    rows = [tuple(r) for r in pt.cross_sector_groups(g, 20).collect()][:6]
    assert rows == [
        ("not publicly disclosed", 8, 33),
        ("ALPHV", 5, 7),
        ("LockBit", 4, 5),
        ("BlackCat", 4, 4),
        ("Conti", 4, 4),
        ("Qilin", 4, 4),
    ]
    pairs = gr.path(g, ["HAD_INCIDENT", "PERPETRATED_BY"]).select("n0", "n2").distinct()
    per_group = pairs.groupBy("n2").count()
    assert per_group.count() == 109 and per_group.filter("count > 1").count() == 18


def test_families_and_keys(g):
    hazards = g.nodes["Hazard"].select(F.col("id").alias("to"), fn.family_of("id").alias("family"))
    rows = g.of_type("FACES").join(hazards, "to").groupBy("family").agg(
        F.count_distinct("from").alias("n"), F.count_distinct("to").alias("labels")
    )
    found = {r.family: (r.n, r.labels) for r in rows.collect()}
    assert found["Initial Access"] == (14, 2) and found["Regulatory & Legal"] == (14, 9)
    assert found["OT & Operational Disruption"] == (13, 14) and found["Other"] == (4, 5)
    exposures = g.nodes["Exposure"]
    assert exposures.filter(fn.family_of("id") == "Other").count() == 38
    assert exposures.filter(fn.raw_key("name") != F.col("id")).count() == 0
    assert g.nodes["Hazard"].filter(fn.raw_key("name") != F.col("id")).count() == 1
    assert g.nodes["Hazard"].filter(fn.norm_key("name") != F.col("id")).count() == 0


def test_incidents_and_countries(g):
    per_industry = gr.hop(g, "Industry", "HAD_INCIDENT").groupBy("from").count()
    top = per_industry.orderBy(F.desc("count")).limit(3).collect()
    assert [r["count"] for r in top] == [20, 17, 15]
    places = g.of_type("OCCURRED_IN").groupBy("to").count().orderBy(F.desc("count")).limit(4).collect()
    assert [tuple(r) for r in places] == [("United States", 72), ("United Kingdom", 10), ("USA", 8), ("US", 6)]
    assert g.nodes["Industry"].agg(F.sum("incident_count")).first()[0] == 148
