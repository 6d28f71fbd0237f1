"""Files cut into many small blocks give the records that a whole read gives, in their order."""

import json
import random

import pytest

from dossier.sources import ranges, readers


@pytest.fixture(params=["48b", "300b", "128m"])
def cut_small(spark, request):
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def text(n):
    return "".join(random.choices('ab{}[],:"\\ \n\ré漢\'', k=n))


def test_json_lists(spark, tmp_path, cut_small):
    random.seed(2)
    wanted, files = {}, {}
    for k in range(6):
        rows = [{"victim": "v" + text(random.randint(0, 40)), "activity": text(9), "nested": {"a": [{"b": text(5)}, "}"]}} for _ in range(random.choice([0, 1, 7, 30]))]
        files[f"sector_{k}.json"] = ("﻿ \n" if k % 2 else "") + json.dumps(rows, indent=random.choice([None, 1]), ensure_ascii=k % 3 == 0) + " \n" * (k % 3)
        wanted[k] = [(r["victim"], r["activity"]) for r in rows]
    good = json.dumps([{"victim": "v"}] * 5)
    files |= {"sector_w.json": good[:-1], "sector_x.json": good + "]", "sector_y.json": good.replace("},", "},,", 1), "sector_z.json": json.dumps({"victim": "object"}), "sector_e.json": "", "sector_n.json": good.replace('"v"}', '"v}', 1)}
    files["sector_m.json"] = good.replace('{"victim": "v"}', "{broken}", 1)
    for name, body in files.items():
        (tmp_path / name).write_text(body, encoding="utf-8", newline="")
    got = readers.read_postings_json(spark, str(tmp_path)).orderBy("_pos").collect()
    found = {}
    for r in got:
        found.setdefault(r._pos.file.rsplit("_", 1)[1].split(".")[0], []).append((r.victim, r.activity))
    for k, v in wanted.items():
        assert found.pop(str(k), []) == v
    assert found == {}


def test_csv(spark, tmp_path, cut_small):
    random.seed(3)
    quoted = lambda t: '"' + t.replace('"', '""') + '"'
    wanted = {}
    for k, end in enumerate(("\n", "\r\n")):
        rows = [("v" + text(random.randint(1, 30)).replace("\\", "/") + "v", random.choice(["s", 'x "y"', "a, b", ""])) for _ in range(40)]
        body = end.join(["victim,sector", *(f"{quoted(v)},{quoted(s)}" for v, s in rows)]) + (end if k else "")
        (tmp_path / f"{k}.csv").write_text(body, encoding="utf-8", newline="")
        wanted[str(k)] = rows
    got = readers.read_postings_csv(spark, str(tmp_path)).orderBy("_pos").collect()
    found = {}
    for r in got:
        found.setdefault(r._pos.file.rsplit("/", 1)[1].split(".")[0], []).append((r.victim, r.activity))
    assert found == wanted


def test_many_tasks_read_one_file(spark, tmp_path):
    (tmp_path / "sector_a.json").write_text(json.dumps([{"victim": f"v{i}"} for i in range(3000)]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4kb")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        assert ranges.fragments(spark, str(tmp_path), ranges.JSON_LIST).rdd.getNumPartitions() > 8
        rows = readers.read_postings_json(spark, str(tmp_path)).orderBy("_pos").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r.victim for r in rows] == [f"v{i}" for i in range(3000)]


def test_journal_folders_keep_their_order(spark, tmp_path, cut_small):
    line = lambda name: json.dumps({"type": "result", "value": {"industry": name}})
    names = iter(f"n{i:04d}" for i in range(1000))
    wanted = []
    for folder, count in (("second", 3), ("first", 4)):
        (tmp_path / folder).mkdir()
        for k in range(count):
            some = [next(names) for _ in range(20 * (k % 2) + 3)]
            wanted += some
            (tmp_path / folder / f"{k}.jsonl").write_text("\n".join(map(line, some)))
    rows = readers.read_journal(spark, [str(tmp_path / "second"), str(tmp_path / "absent"), str(tmp_path / "first")])
    assert [r.industry for r in rows.orderBy("_pos").collect()] == wanted
