"""Known results on a small graph written by hand as CSV files: one assertion per pattern query."""

import pytest
from pyspark.sql import functions as F

from dossier.operators import graph as gr
from dossier.operators import patterns as pt
from dossier.sources.readers import read_graph

NODES = {
    "industry": ("id,sector_tag,incident_count,overview,distinct,extortion_leverage,downtime_tolerance", ["Health,Healthcare,2,Care,,,", "Making,Manufacturing,1,Goods,,,", "Power,Energy,0,Grid,,,"]),
    "hazard": ("id,name,description", ["phishing,Phishing,mail", "extortion,Extortion,threats", "ot outage,OT outage,plants"]),
    "exposure": ("id,name,description", ["records,Records,files", "plants,Plants,machines"]),
    "subcategory": ("id,name,parent,kind", ["records::scans,Scans,records,exposure", "records::bills,Bills,records,exposure"]),
    "incident": ("id,victim,date,country,financial_impact,ransom,downtime,data_impact,summary,source_count", ["Health::A,A,2020,US,$5 million,,,,x,1", "Health::B,B,2021,UK,,,,,y,1", "Making::C,C,2022,US,$7 million,,,,vendor z,1"]),
    "company": ("id", ["A", "B", "C"]),
    "group": ("id", ["Red", "Blue"]),
    "country": ("id", ["US", "UK"]),
    "source": ("id,host", ["https://s/1,s", "https://s/2,s"]),
    "victim": ("id,name,sector,attackdate,country,domain,has_press", ["V::S,V,S,2020-01-02,US,v.org,yes", "W::S,W,S,2021-01-02,UK,,"]),
}
EDGES = {
    "FACES": [("Health", "Industry", "phishing", "Hazard"), ("Making", "Industry", "phishing", "Hazard"), ("Power", "Industry", "phishing", "Hazard"), ("Health", "Industry", "extortion", "Hazard"), ("Power", "Industry", "ot outage", "Hazard")],
    "EXPOSES": [("Health", "Industry", "records", "Exposure"), ("Making", "Industry", "plants", "Exposure"), ("Power", "Industry", "plants", "Exposure")],
    "INCLUDES": [("records", "Exposure", "records::scans", "Subcategory"), ("records", "Exposure", "records::bills", "Subcategory")],
    "HAD_INCIDENT": [("Health", "Industry", "Health::A", "Incident"), ("Health", "Industry", "Health::B", "Incident"), ("Making", "Industry", "Making::C", "Incident")],
    "HIT": [("Health::A", "Incident", "A", "Company"), ("Health::B", "Incident", "B", "Company"), ("Making::C", "Incident", "C", "Company")],
    "PERPETRATED_BY": [("Health::A", "Incident", "Red", "Group"), ("Health::B", "Incident", "Blue", "Group"), ("Making::C", "Incident", "Red", "Group")],
    "OCCURRED_IN": [("Health::A", "Incident", "US", "Country"), ("Health::B", "Incident", "UK", "Country"), ("Making::C", "Incident", "US", "Country")],
    "CITED_BY": [("Health::A", "Incident", "https://s/1", "Source"), ("Making::C", "Incident", "https://s/2", "Source")],
    "ATTACKED_BY": [("V::S", "Victim", "Red", "Group"), ("W::S", "Victim", "Red", "Group"), ("W::S", "Victim", "Blue", "Group")],
}


@pytest.fixture(scope="module")
def g(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("graph")
    for label, (head, rows) in NODES.items():
        (folder / f"nodes_{label}.csv").write_text("\n".join([head, *rows]) + "\n")
    for name, rows in EDGES.items():
        (folder / f"rels_{name.lower()}.csv").write_text("from,from_label,to,to_label\n" + "\n".join(",".join(r) for r in rows) + "\n")
    return read_graph(spark, str(folder))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_every_edge_has_its_ends(g):
    assert gr.resolve_edges(g.edges, g.node_keys()).count() == g.edges.count() == sum(map(len, EDGES.values()))


def test_reach_and_sharing(g):
    assert rows(pt.hazard_reach(g).select("industries")) == [(1,), (1,), (3,)]
    assert rows(gr.reach(g.of_type("EXPOSES"))) == [("plants", 2), ("records", 1)]
    assert rows(gr.shared_targets(g, "FACES", "Health", "Power").select("to")) == [("phishing",)]
    assert rows(gr.only_in(g, "EXPOSES", "Health", "Making").select("to")) == [("records",)]
    assert rows(gr.groups_in_both(g, "Health", "Making").select("group")) == [("Red",)]
    assert gr.rematch(g, "FACES", F.col("reach") >= 3).count() == 3


def test_groups_and_victims(g):
    assert rows(pt.cross_sector_groups(g, 5)) == [("Blue", 1, 1), ("Red", 2, 2)]
    assert rows(pt.top_groups_graph(g, 5)) == [("Blue", 1), ("Red", 2)]
    assert rows(pt.sector_year(g.nodes["Victim"]).select("sector", "year")) == [("S", "2020"), ("S", "2021")]


def test_costs_and_inventory(g):
    assert [(r.victim, r.usd) for r in pt.disclosed_costs(g).collect()][:2] == [("C", 7e6), ("A", 5e6)]
    assert rows(pt.exposure_inventory(g, "Health")) == [("Records", "Bills"), ("Records", "Scans")]


def test_neighbours_of_a_hub_and_of_nothing(g, spark):
    asked = spark.createDataFrame([("Hazard", "phishing"), ("Hazard", "none")], "label string, id string")
    assert rows(gr.neighbours(g, asked).select("id", "nb_id")) == [("none", None), ("phishing", "Health"), ("phishing", "Making"), ("phishing", "Power")]
    assert rows(gr.cited_sources(g, spark.createDataFrame([("Industry", "Health")], "label string, id string")).select("id", F.array_join("urls", "|"))) == [("Health", "https://s/1")]
