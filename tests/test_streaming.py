from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.sources import keyed
from dossier.streaming import loads

SCHEMA = T.StructType([T.StructField("victim", T.StringType()), T.StructField("n", T.LongType())])


def land(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(f'{{"victim": "{v}", "n": {n}}}' for v, n in rows))


def test_each_file_is_taken_once(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    for name, rows in (("a.json", [("A", 1)]), ("b.json", [("B", 2), ("A", 3)])):
        land(source, name, rows)
        stream = loads.file_stream(spark, str(source), SCHEMA)
        loads.append_new(stream, out, str(tmp_path / "cp")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [("A", 1), ("A", 3), ("B", 2)]


def test_keyed_load_and_compaction(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    for name, rows in (("a.json", [("A", 1), ("B", 1)]), ("b.json", [("A", 0)])):
        land(source, name, rows)
        stream = loads.file_stream(spark, str(source), SCHEMA)
        loads.replace_by_key(stream, out, str(tmp_path / "cp")).awaitTermination()
    now = loads.current_rows(spark, out, "victim", F.desc("n"))
    assert sorted(map(tuple, now.collect())) == [("A", 0), ("B", 1)]
    loads.compact(spark, out, str(tmp_path / "small"), "victim", F.desc("n"))
    again = loads.current_rows(spark, str(tmp_path / "small"), "victim")
    assert sorted(map(tuple, again.collect())) == [("A", 0), ("B", 1)]


def test_first_record_per_victim_over_runs(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    for name, rows in (("a.json", [("A", 2), (" a ", 1)]), ("b.json", [("A", 0), ("B", 5), ("b", 4), ("", 5)])):
        land(source, name, rows)
        stream = loads.file_stream(spark, str(source), SCHEMA)
        loads.first_per_victim(stream, out, str(tmp_path / "cp"), "n").awaitTermination()
    rows = {r.victim_key: r.n for r in spark.read.parquet(out).collect()}
    assert rows == {"a": 1, "b": 4}


def test_first_records_are_state_and_not_read_back(spark, tmp_path):
    """A restart goes on with the state; what was written may be gone, and rows repeat very often."""
    source, out = tmp_path / "in", tmp_path / "out"
    runs = [[("A", n) for n in range(500, 0, -1)] + [("C", 7)], [("A", 0), ("D", 2), ("D", 1)], [("D", 0), ("C", 1)], [("E", 5)]]
    taken = []
    for k, rows in enumerate(runs):
        land(source, f"{k}.json", rows)
        stream = loads.file_stream(spark, str(source), SCHEMA)
        loads.first_per_victim(stream, str(out), str(tmp_path / "cp"), "n").awaitTermination()
        taken.append(sorted((r.victim_key, r.n) for r in spark.read.parquet(f"{out}/batch={k}").collect()))
        (out / f"batch={k}").rename(out / f"_read{k}")  # the next batch does not look at it
    assert taken == [[("a", 1), ("c", 7)], [("d", 1)], [], [("e", 5)]]


def test_keyed_table_rewrites_touched_buckets_only(spark, tmp_path):
    base = spark.createDataFrame([(i, f"v{i}", 0) for i in range(400)] + [(None, "nobody", 0)], "k long, v string, n int")
    table = keyed.create(base, str(tmp_path / "t"), "k", buckets=16)
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    before = files()
    update = spark.createDataFrame([(7, "late", 2), (7, "new", 1)], "k long, v string, n int")
    assert table.upsert(update, "n") == 1
    after = files()
    changed = {p.parent.name for p in before.keys() ^ after.keys()}
    assert len(changed) == 1 and {p for p in before if p.parent.name not in changed} <= after.keys()
    rows = {r.k: (r.v, r.n) for r in table.rows().collect()}
    assert len(rows) == 401 and rows[7] == ("new", 1) and rows[8] == ("v8", 0)
    assert table.upsert(update, "n") == 1 and {r.k: (r.v, r.n) for r in table.rows().collect()} == rows
    assert table.upsert(spark.createDataFrame([(None, "somebody", 3), (999, "added", 1)], "k long, v string, n int"), "n") in (1, 2)
    rows = {r.k: r.v for r in table.rows().collect()}
    assert len(rows) == 402 and rows[None] == "somebody" and rows[999] == "added"
    assert table.upsert(update.limit(0), "n") == 0 and table.rows().count() == 402


def test_keyed_stream_into_buckets(spark, tmp_path):
    source = tmp_path / "in"
    base = spark.createDataFrame([("A", 9), ("Z", 9)], SCHEMA)
    table = keyed.create(base, str(tmp_path / "t"), "victim", buckets=4)
    for name, rows in (("a.json", [("A", 1), ("B", 1), ("B", 2)]), ("b.json", [("A", 0)])):
        land(source, name, rows)
        stream = loads.file_stream(spark, str(source), SCHEMA)
        loads.replace_in_buckets(stream, table, str(tmp_path / "cp"), F.desc("n")).awaitTermination()
    assert sorted(map(tuple, table.rows().collect())) == [("A", 0), ("B", 2), ("Z", 9)]
