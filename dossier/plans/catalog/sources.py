"""Readers, writers and streaming loads, run on data derived from the given tables.

Queries that need files write the derived rows to a new folder under the shared folder
and read them back with the package's readers.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.operators import insights as ins
from dossier.operators import tables
from dossier.plans.catalog import bindings as b
from dossier.plans.catalog import tables as _tables  # noqa: F401  its SQL is read back here
from dossier.plans.catalog.registry import SQL, query
from dossier.session import shared_dir
from dossier.sources import keyed, readers, writers
from dossier.streaming import loads


def new_folder(spark) -> str:
    return f"{shared_dir(spark)}/run-{uuid4().hex}"


# --- bodies of landed files -----------------------------------------------------


@query(
    "posting_files",
    f"""WITH {b.RAW_POSTINGS} SELECT pos, victim, activity, "group" FROM raw WHERE victim <> '' AND press = ''""",
)
def posting_files(spark, folder):
    """One landed body per order: arrays with a byte order mark are read, objects and broken text are skipped."""
    raw = b.raw_postings(spark, folder)
    fields = F.struct("victim", "activity", "group")
    body = (
        F.when(F.col("press") == "", F.concat(F.lit("﻿ \n"), F.to_json(F.array(fields, F.struct(F.lit("").alias("victim"), F.lit("x").alias("activity"), F.lit("y").alias("group"))))))
        .when(F.col("ransom") != "", F.to_json(fields))
        .otherwise(F.concat(F.lit("[{"), F.to_json(fields)))
    )
    files = raw.select(F.col("_pos").cast("string").alias("file"), body.alias("body"))
    rows = readers.posting_files(files)
    return rows.select(F.col("_pos.file").cast("long").alias("pos"), "victim", "activity", "group")


@query(
    "journal_records",
    f"""WITH {b._PARTS.strip()} SELECT pos, industry, overview, len(subs) AS subs FROM p WHERE p_size % 5 <> 0""",
)
def journal_records(spark, folder):
    """One journal line per part: objects, JSON text, other entries, prose and broken lines."""
    records = b.records(spark, folder)
    payload = F.to_json(F.struct("industry", "overview", "hazard_categories"))
    kind = F.regexp_extract(F.get("aggregate_stats", F.lit(0))["value"], r"(\d+)", 1).cast("int") % 5
    q = F.to_json(F.struct(payload.alias("value")))
    text = F.regexp_replace(F.regexp_replace(q, r'^\{"value":', ""), r"\}$", "")
    line = (
        F.when(kind == 0, F.concat(F.lit('{"type":"started","value":'), payload, F.lit("}")))
        .when(kind == 1, F.concat(F.lit('{"type":"result","value":null,"result":'), payload, F.lit("}")))
        .when(kind == 2, F.concat(F.lit('{"type":"result","output":'), text, F.lit("}")))
        .otherwise(F.concat(F.lit('{"type":"result","value":'), payload, F.lit("}")))
    )
    lines = records.select("_pos", line.alias("value"))
    prose = records.select("_pos", F.lit('{"type":"result","value":"no JSON here"}').alias("value"))
    broken = records.select("_pos", F.lit('{"type":"result","value":{"indus').alias("value"))
    rows = readers.journal_records(lines.unionByName(prose).unionByName(broken))
    subs = F.size(F.get("hazard_categories", F.lit(0))["subcategories"]).cast("long")
    return rows.select(F.col("_pos").alias("pos"), "industry", "overview", subs.alias("subs"))


@query(
    "record_files",
    f"""WITH {b.INCIDENTS} SELECT pos, industry, count(*) AS incidents FROM incs WHERE p_size > 10 GROUP BY 1, 2""",
)
def record_files(spark, folder):
    """One body per record; small parts have a broken one."""
    records = b.records(spark, folder)
    size = F.regexp_extract(F.get("aggregate_stats", F.lit(0))["value"], r"(\d+)", 1).cast("int")
    payload = F.to_json(F.struct(*[c for c in records.columns if c != "_pos"]))
    files = records.select(
        F.col("_pos").cast("string").alias("file"),
        F.when(size > 10, payload).otherwise(F.substring(payload, 1, 20)).alias("body"),
    )
    rows = readers.record_files(files)
    return rows.select(
        F.col("_pos").cast("long").alias("pos"), "industry", F.size("example_incidents").cast("long").alias("incidents")
    )


@query(
    "split_payloads",
    """SELECT 'rejected' AS part, page_id AS id, '' AS payload FROM pages
    UNION ALL SELECT 'ok', event_id, '[]' FROM events UNION ALL SELECT 'ok', c_custkey, '["' || c_name || '"]' FROM customer""",
)
def split_payloads(spark, folder):
    """Pages are markup, event properties are objects, customer bodies are lists."""
    bodies = (
        b.table(spark, folder, "pages")
        .select(F.col("page_id").alias("id"), F.concat(F.lit(" \n"), "html").alias("body"))
        .unionByName(b.table(spark, folder, "events").select(F.col("event_id").alias("id"), F.col("props").alias("body")))
        .unionByName(
            b.table(spark, folder, "customer").select(
                F.col("c_custkey").alias("id"), F.to_json(F.array("c_name")).alias("body")
            )
        )
    )
    ok, rejected = readers.split_payloads(bodies, "body")
    return ok.select(F.lit("ok").alias("part"), "id", "payload").unionByName(
        rejected.select(F.lit("rejected").alias("part"), "id", F.lit("").alias("payload"))
    )


# --- files written and read back ---------------------------------------------------


@query(
    "bulk_victims",
    f"""WITH {b.RAW_POSTINGS} SELECT victim, activity AS sector, "group", country, left(attackdate, 10) AS attackdate, discovered, "domain", data_size,
      CASE WHEN press <> '' THEN 'yes' ELSE '' END AS has_press, ransom FROM raw WHERE victim <> ''""",
)
def bulk_victims(spark, folder):
    return writers.bulk_victims(b.raw_postings(spark, folder))


@query(
    "postings_csv",
    f"""WITH {b.RAW_POSTINGS} SELECT victim || chr(10) || '"q", ' || pos AS victim, activity, "group", left(attackdate, 10) AS attackdate,
      CASE WHEN press <> '' THEN 'y' ELSE '' END AS press, ransom, '' AS url FROM raw WHERE victim <> ''""",
)
def postings_csv(spark, folder):
    """The compact CSV written and read again; names hold quotes, commas and line breaks."""
    raw = tables.require(b.raw_postings(spark, folder), "victim")
    odd = F.concat("victim", F.lit('\n"q", '), F.col("_pos").cast("string"))
    path = new_folder(spark)
    writers.write_bulk_csv(raw.withColumn("victim", odd), path)
    rows, _ = readers.load_postings(spark, f"{path}/absent", path)
    return rows.select("victim", "activity", "group", "attackdate", "press", "ransom", "url")


@query(
    "write_by_sector",
    f"""WITH {b.RAW_POSTINGS} SELECT replace(replace(lower(coalesce(nullif(activity, ''), '(unclassified)')), '/', '_'), ' ', '_') AS sector_slug,
      victim, "group", attackdate, country FROM raw""",
)
def write_by_sector(spark, folder):
    path = new_folder(spark)
    writers.write_by_sector(b.raw_postings(spark, folder), path)
    fields = ("victim", "group", "attackdate", "country", "sector_slug")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in fields])
    return spark.read.schema(schema).json(path).select("sector_slug", *fields[:-1])


@query(
    "posting_lists",
    f"""WITH {b.RAW_POSTINGS} SELECT victim, activity, "group", '}} \\ " ] ,' || "group" AS description FROM raw WHERE victim <> ''""",
)
def posting_lists(spark, folder):
    """Postings written as JSON lists, one file each for sixteen parts, and read by ranges of their bytes."""
    path = new_folder(spark)
    raw = b.raw_postings(spark, folder)
    part = F.pmod(F.xxhash64("_pos"), F.lit(16)).cast("int").alias("part")
    entry = F.to_json(F.struct("victim", "activity", "group", F.concat(F.lit("} \\ \" ] ,"), F.col("group")).alias("description")))
    lines = raw.select(part, F.lit(1).alias("slot"), F.concat(F.lit(", "), entry).alias("value"))
    ends = spark.range(16).select(F.col("id").cast("int").alias("part"), F.explode(F.array(F.struct(F.lit(0).alias("slot"), F.lit('[{"victim": ""}').alias("value")), F.struct(F.lit(2).alias("slot"), F.lit("]").alias("value")))).alias("e"))
    every = lines.unionByName(ends.select("part", "e.slot", "e.value")).repartition(16, "part").sortWithinPartitions("part", "slot")
    every.select("part", "value").write.partitionBy("part").text(path)
    return readers.read_postings_json(spark, path, "*.txt").select("victim", "activity", "group", "description")


@query(
    "write_collections",
    f"""SELECT 'parquet' AS form, * FROM ({SQL["taxonomy"]}) UNION ALL SELECT 'json', * FROM ({SQL["taxonomy"]})""",
)
def write_collections(spark, folder):
    """The taxonomy collection as JSON and as Parquet, read back from both."""
    from dossier.operators import taxonomy

    docs = {"taxonomy": taxonomy.taxonomy(b.records(spark, folder))}
    path = new_folder(spark)
    writers.write_collections(docs, f"{path}/json", "json")
    writers.write_collections(docs, f"{path}/parquet")
    stored = spark.read.parquet(f"{path}/parquet/taxonomy")
    text = spark.read.schema(stored.schema).json(f"{path}/json/taxonomy")
    form = lambda df, name: df.select(F.lit(name).alias("form"), *stored.columns)
    return form(stored, "parquet").unionByName(form(text, "json"))


@query("write_sources", f"WITH {b.INCIDENTS} SELECT DISTINCT url FROM (SELECT unnest(sources) AS url FROM incs)")
def write_sources(spark, folder):
    path = new_folder(spark)
    writers.write_sources(b.records(spark, folder), path)
    return spark.read.text(path).withColumnRenamed("value", "url")


@query(
    "graph_files",
    f"""WITH {b.GRAPH} SELECT 'rels' AS kind, type AS name, "from" AS one, "to" AS two FROM edges
    UNION ALL SELECT 'nodes', CASE type WHEN 'hazard' THEN 'Hazard' ELSE 'Exposure' END, id, '' FROM cat_nodes
    UNION ALL SELECT 'nodes', 'Subcategory', id, '' FROM sub_nodes
    UNION ALL SELECT DISTINCT 'nodes', 'Victim', victim || '::' || activity, '' FROM raw WHERE trim(victim) <> ''
    UNION ALL SELECT DISTINCT 'nodes', 'Company', victim, '' FROM named
    UNION ALL SELECT DISTINCT 'nodes', 'Group', id, '' FROM (SELECT "to" AS id FROM edges WHERE type = 'PERPETRATED_BY'
      UNION ALL SELECT "group" FROM raw WHERE trim(victim) <> '' AND trim("group") <> '')
    UNION ALL SELECT DISTINCT 'nodes', 'Country', "to", '' FROM edges WHERE type = 'OCCURRED_IN'""",
)
def graph_files(spark, folder):
    """The whole graph written as CSV and read back: all its edges, and the nodes of seven labels."""
    g = b.graph(spark, folder)
    path = new_folder(spark)
    writers.write_nodes(g, path)
    writers.write_edges(g, path)
    back = readers.read_graph(spark, path)
    edges = back.edges.select(F.lit("rels").alias("kind"), F.col("type").alias("name"), F.col("from").alias("one"), F.col("to").alias("two"))
    labels = ["Hazard", "Exposure", "Subcategory", "Victim", "Company", "Group", "Country"]
    nodes = back.node_keys().filter(F.col("label").isin(labels))
    return edges.unionByName(nodes.select(F.lit("nodes").alias("kind"), F.col("label").alias("name"), F.col("id").alias("one"), F.lit("").alias("two")))


@query(
    "upsert",
    """WITH u AS (SELECT o_custkey AS c_custkey, arg_max('order ' || o_orderkey, o_orderkey) AS c_name, arg_max(o_totalprice, o_orderkey) AS c_acctbal
        FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
    SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM u) UNION ALL SELECT * FROM u""",
)
def upsert(spark, folder):
    """Customers replaced by their last pending order."""
    base = b.table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal")
    updates = (
        b.table(spark, folder, "orders")
        .filter("o_orderstatus = 'P'")
        .select(
            F.col("o_custkey").alias("c_custkey"),
            F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("c_name"),
            F.col("o_totalprice").alias("c_acctbal"),
            "o_orderkey",
        )
    )
    return writers.upsert(base, updates, "c_custkey", F.desc("o_orderkey"))


@query(
    "upsert_buckets",
    """WITH u AS (SELECT o_custkey AS c_custkey, arg_max('order ' || o_orderkey, o_orderkey) AS c_name, arg_max(o_totalprice, o_orderkey) AS c_acctbal
        FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
    SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM u) UNION ALL SELECT * FROM u""",
)
def upsert_buckets(spark, folder):
    """The same replacement in a table stored by buckets, applied twice."""
    base = b.table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal")
    stored = keyed.create(base, new_folder(spark), "c_custkey", buckets=16)
    pending = b.table(spark, folder, "orders").filter("o_orderstatus = 'P'")
    updates = pending.select(
        F.col("o_custkey").alias("c_custkey"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("c_name"),
        F.col("o_totalprice").alias("c_acctbal"),
        "o_orderkey",
    )
    for _ in range(2):
        stored.upsert(updates, F.desc("o_orderkey"))
    return stored.rows()


# --- streaming ------------------------------------------------------------------


def _event_stream(spark, folder):
    """The events table as a stream, be it one file or a folder of files."""
    path = f"{folder}/events.parquet"
    schema = spark.read.parquet(path).schema
    return loads.file_stream(spark, f"{folder}/event[s].parquet", schema, "parquet")


@query("append_new", "SELECT event_type, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1")
def append_new(spark, folder):
    """Events taken in twice; the second run finds nothing new."""
    path = new_folder(spark)
    for _ in range(2):
        loads.append_new(_event_stream(spark, folder), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    rows = spark.read.parquet(f"{path}/out")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


def _landed_in_order(spark, folder):
    """The events as a stream of two micro-batches, earlier ids first."""
    path = new_folder(spark)
    events = b.table(spark, folder, "events")
    half = events.agg(F.max("event_id")).first()[0] // 2
    for late in (False, True):
        events.filter((F.col("event_id") > half) == F.lit(late)).coalesce(1).write.mode("append").parquet(path)
    return loads.file_stream(spark, path, events.schema, "parquet", maxFilesPerTrigger="1")


@query(
    "replace_by_key",
    "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1",
)
def replace_by_key(spark, folder):
    """The last event per user over all batches of a keyed load."""
    path = new_folder(spark)
    loads.replace_by_key(_landed_in_order(spark, folder), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    rows = loads.current_rows(spark, f"{path}/out", "user_id", F.desc("event_id"))
    return rows.select("user_id", "event_type", "event_id")


@query(
    "replace_in_buckets",
    "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1",
)
def replace_in_buckets(spark, folder):
    """The last event per user, streamed into a table stored by buckets that starts with the events of the first users."""
    path = new_folder(spark)
    events = b.table(spark, folder, "events").select("user_id", "event_type", "event_id")
    early = events.groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("event_type"), F.min("event_id").alias("event_id"))
    stored = keyed.create(early, f"{path}/table", "user_id", buckets=16)
    stream = _landed_in_order(spark, folder).select("user_id", "event_type", "event_id")
    loads.replace_in_buckets(stream, stored, f"{path}/checkpoint", F.desc("event_id")).awaitTermination()
    return stored.rows()


@query("first_per_victim", "SELECT 'user ' || user_id AS victim_key, min(event_id) AS event_id FROM events GROUP BY 1")
def first_per_victim(spark, folder):
    """The first record of each user over two micro-batches."""
    path = new_folder(spark)
    stream = _landed_in_order(spark, folder).withColumn(
        "victim", F.concat(F.lit(" User "), F.col("user_id").cast("string"))
    )
    loads.first_per_victim(stream, f"{path}/out", f"{path}/checkpoint", "event_id").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("victim_key", "event_id")


@query(
    "sector_counts_of_files",
    f"""WITH {b.RAW_POSTINGS} SELECT activity AS sector, count(*) AS n FROM raw WHERE activity <> '' GROUP BY 1""",
)
def sector_counts_of_files(spark, folder):
    """Per-sector counts of a feed written by sector and read back."""
    path = new_folder(spark)
    writers.write_by_sector(b.raw_postings(spark, folder), path)
    schema = T.StructType([T.StructField("activity", T.StringType())])
    return ins.classified_only(ins.year_pull_by_sector(spark.read.schema(schema).json(path)))
