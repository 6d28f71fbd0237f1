import json

from pyspark.sql import functions as F

from dossier import schemas
from dossier.operators import graph as gr
from dossier.operators import tables
from dossier.sources import readers, writers


def test_posting_pulls(spark, tmp_path):
    rows = [{"victim": "A", "activity": "X", "group": "g"}, {"victim": ""}, {"victim": "B", "infostealer": {"a": 1, "A": 2}}]
    (tmp_path / "sector_a.json").write_text("﻿" + json.dumps(rows, indent=1), encoding="utf-8")
    (tmp_path / "sector_b.json").write_text('{"victim": "object"}')
    (tmp_path / "sector_c.json").write_text('[{"victim": "broken"')
    (tmp_path / "year_2020.json").write_text('[{"victim": "other"}]')
    got = readers.read_postings_json(spark, str(tmp_path)).orderBy("_pos").collect()
    assert [(r.victim, r.activity) for r in got] == [("A", "X"), ("B", None)]
    found, used = readers.load_postings(spark, str(tmp_path), "/absent")
    assert found.count() == 2 and used == str(tmp_path)


def test_postings_csv_and_fallback(spark, tmp_path):
    path = tmp_path / "bulk.csv"
    text = 'victim,sector,group,has_press\r\n"A ""x"", y\nz",S,,yes\r\nB,T\r\nlone\r\n\r\n"C","","g",""\r\n'
    path.write_bytes(text.encode())
    rows, used = readers.load_postings(spark, str(tmp_path / "none"), str(path))
    got = [(r.victim, r.activity, r.group, r.press, r.country) for r in rows.orderBy("victim").collect()]
    assert used == str(path)
    assert got == [('A "x", y\nz', "S", "", "y", ""), ("B", "T", "", "", ""), ("C", "", "g", "", "")]
    empty, used = readers.load_postings(spark, str(tmp_path / "none"), str(tmp_path / "none.csv"))
    assert used == "none" and empty.count() == 0 and set(schemas.POSTING.names) == set(empty.columns)


def test_journal(spark, tmp_path):
    record = {"industry": "X", "overview": "o", "aggregate_stats": [{"metric": "m", "value": 5}]}
    lines = [
        {"type": "result", "value": record},
        {"type": "result", "value": None, "result": json.dumps({**record, "industry": "Y"})},
        {"type": "started", "value": record},
        {"type": "result", "output": "prose"},
        {"type": "result", "value": {"overview": "no name"}},
    ]
    path = tmp_path / "journal.jsonl"
    path.write_text("\n".join(map(json.dumps, lines)) + '\n{"type":"resu\n')
    rows = readers.read_journal(spark, [str(tmp_path / "absent"), str(path)]).orderBy("_pos").collect()
    assert [r.industry for r in rows] == ["X", "Y"] and rows[0].aggregate_stats[0].value == "5"


def test_record_folder_and_fold_in(spark, tmp_path):
    for name, body in {"a": '{"industry": "X"}', "b": "[1]", "c": "{broken", "d": '{"overview": "x"}'}.items():
        (tmp_path / f"{name}.json").write_text(body)
    base = readers.read_record_dir(spark, str(tmp_path))
    assert [r.industry for r in base.collect()] == ["X"]
    extra = spark.createDataFrame([("X (ransomware.live sector y)",), ("Z",)], "industry string")
    assert sorted(r.industry for r in tables.fold_in(base, extra).collect()) == ["X", "Z"]


def test_payload_guard(spark):
    df = spark.createDataFrame([(1, " \n<html>"), (2, "[1]"), (3, '{"a": 1}'), (4, "oops"), (5, None)], "i int, body string")
    ok, rejected = readers.split_payloads(df, "body")
    assert [r.i for r in rejected.collect()] == [1]
    assert {r.i: r.payload for r in ok.collect()} == {2: "[1]", 3: "[]", 4: "[]", 5: "[]"}


def test_csv_quotes_everything(spark, tmp_path):
    df = spark.createDataFrame([('a "b"', None, 1)], "x string, y string, z int").coalesce(1)
    writers.write_csv(df, str(tmp_path / "out"))
    part = next((tmp_path / "out").glob("part-*"))
    assert part.read_text().splitlines()[1] == '"a ""b""","","1"'


def test_graph_files(spark, tmp_path):
    edges = spark.createDataFrame([("a", "Industry", "FACES", "h", "Hazard")], schemas.EDGE)
    nodes = {
        "Hazard": spark.createDataFrame([("h", "H, x", 'say "d"')], "id string, name string, description string"),
        "Industry": spark.createDataFrame([("a", "", 3, "", "", "", "")], "id string, sector_tag string, incident_count int, overview string, distinct string, extortion_leverage string, downtime_tolerance string"),
    }
    g = gr.Graph(nodes, edges)
    writers.write_nodes(g, str(tmp_path))
    writers.write_edges(g, str(tmp_path))
    back = readers.read_graph(spark, str(tmp_path))
    assert back.nodes["Hazard"].first().description == 'say "d"'
    assert back.nodes["Industry"].first().incident_count == 3
    assert back.edges.collect() == edges.collect()
    nodes_out, links = gr.graph_export(back)
    assert {r.id for r in nodes_out.collect()} == {"Hazard:h", "Industry:a"} and links.first().target == "Hazard:h"


def test_sector_folders_and_sources(spark, tmp_path):
    df = spark.createDataFrame([("a", "Trans/Log"), ("b", None)], "victim string, activity string")
    writers.write_by_sector(df, str(tmp_path / "s"))
    assert {p.name for p in (tmp_path / "s").glob("sector_slug=*")} == {"sector_slug=trans_log", "sector_slug=(unclassified)"}
    nested = spark.createDataFrame([("X", [("v", ["b", "a"]), ("w", ["a"])])], "industry string, example_incidents array<struct<victim: string, sources: array<string>>>")
    writers.write_sources(nested, str(tmp_path / "u"))
    assert [r.value for r in spark.read.text(str(tmp_path / "u")).orderBy("value").collect()] == ["a", "b"]


def test_bulk_rows(spark):
    df = spark.createDataFrame(
        [("v", "s", "g", "c", "2020-01-02 03:04", None, "d", "1 GB", "x", None), ("", *["x"] * 9)],
        "victim string, activity string, `group` string, country string, attackdate string, discovered string, domain string, data_size string, press string, ransom string",
    )
    row = writers.bulk_victims(df).collect()
    assert [tuple(r) for r in row] == [("v", "s", "g", "c", "2020-01-02", "", "d", "1 GB", "yes", "")]
    assert writers.as_text(df.select(F.lit(None).alias("n"))).first().n == ""


def test_a_hot_folder_is_dealt_by_its_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "TASK_ROWS", 2000)
    many = [("v", "Hot One")] * 18_000 + [(f"w{i}", f"s{i % 4}") for i in range(400)]
    df = spark.createDataFrame(many, "victim string, activity string").repartition(3)
    writers.write_by_sector(df, str(tmp_path / "s"))
    files = {p.name: [len(f.read_text().splitlines()) for f in p.glob("part-*")] for p in (tmp_path / "s").glob("sector_slug=*")}
    assert sum(files["sector_slug=hot_one"]) == 18_000 and len(files["sector_slug=hot_one"]) >= 9
    assert max(files["sector_slug=hot_one"]) <= 2000
    assert [files[f"sector_slug=s{i}"] for i in range(4)] == [[100]] * 4
    assert spark.read.json(str(tmp_path / "s")).count() == 18_400
    writers.write_by_sector(df.limit(0), str(tmp_path / "none"))
