"""Routing, vector search and evidence over questions, embeddings and the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier import functions as fn
from dossier import rules
from dossier.operators import insights as ins
from dossier.operators import retrieval as rt
from dossier.operators import tables
from dossier.plans.catalog import bindings as b
from dossier.plans.catalog import functions, insights  # noqa: F401  their SQL is used here
from dossier.plans.catalog.registry import SQL, query
from dossier.session import cut, stored


def _hints_sql(table) -> str:
    parts = ", ".join(
        f"CASE WHEN contains(lower(question), {b.quoted(k)}) THEN {b.quoted(v)} END" for k, v in table.items()
    )
    return f"array_to_string(list_filter([{parts}], lambda h: h IS NOT NULL), '|')"


@query(
    "industry_hints",
    f"WITH {b.QUESTIONS.strip()} SELECT question_id, {_hints_sql(rules.INDUSTRY_HINTS)} AS industries, {_hints_sql(rules.SECTOR_HINTS)} AS sectors FROM questions",
)
def industry_hints(spark, folder):
    rows = rt.industry_hints(b.questions(spark, folder)).withColumn(
        "sectors", rt.hints("question", rules.SECTOR_HINTS)
    )
    return rows.select(
        "question_id", F.array_join("hints", "|").alias("industries"), F.array_join("sectors", "|").alias("sectors")
    )


@query("known_groups", f"""WITH {b.POSTINGS} SELECT DISTINCT lower("group") AS name FROM postings WHERE "group" <> ''""")
def known_groups(spark, folder):
    return rt.known_groups(tables.normalize_postings(b.raw_postings(spark, folder)))


def _detected() -> str:
    aliases = " ".join(
        f"WHEN regexp_matches(lower(question), '(^|[^a-z0-9])' || regexp_escape({b.quoted(a)}) || '([^a-z0-9]|$)') THEN {b.quoted(c)}"
        for a, c in rules.GROUP_ALIASES.items()
    )
    return f"""WITH {b.POSTINGS}, {b.QUESTIONS.strip()}, known AS (SELECT DISTINCT lower("group") AS name FROM postings WHERE length("group") >= 3),
      hit AS (SELECT question_id, first(name ORDER BY length(name) DESC, name) AS name FROM questions, known
        WHERE regexp_matches(lower(question), '(^|[^a-z0-9])' || name || '([^a-z0-9]|$)') GROUP BY 1),
      det AS (SELECT q.question_id AS question_id, question, CASE {aliases} ELSE hit.name END AS "group" FROM questions q LEFT JOIN hit USING (question_id))"""


@query("detect_group", f"""{_detected()} SELECT question_id, "group" FROM det""")
def detect_group(spark, folder):
    groups = rt.known_groups(tables.normalize_postings(b.raw_postings(spark, folder)))
    return rt.detect_group(b.questions(spark, folder), groups).select("question_id", "group")


@query(
    "route",
    f"""{_detected()} SELECT question_id, CASE WHEN "group" IS NOT NULL THEN 'entity'
      WHEN regexp_matches(question, {b.quoted(rules.RELATIONAL_QUESTION)}) THEN 'relational'
      WHEN regexp_matches(question, {b.quoted(rules.ANALYTICAL_QUESTION)}) THEN 'analytical' ELSE 'semantic' END AS lane FROM det""",
)
def route(spark, folder):
    groups = rt.known_groups(tables.normalize_postings(b.raw_postings(spark, folder)))
    return rt.route(b.questions(spark, folder), groups).select("question_id", "lane")


# --- vectors ------------------------------------------------------------------


@query(
    "vector_topk",
    f"WITH {b.VECTORS.strip()} SELECT label, id, text, round(score, 6) AS score FROM vectors ORDER BY vectors.score DESC, id LIMIT 20",
)
def vector_topk(spark, folder):
    hits = rt.vector_topk(b.vectors(spark, folder), b.query_vector(spark, folder), 20)
    return hits.withColumn("score", F.round("score", 6))


_QUOTAS = """quotas(label, quota, slot) AS (VALUES ('Incident', 3, 0), ('Industry', 2, 1), ('Hazard', 2, 2), ('Exposure', 2, 3), ('Subcategory', 3, 4)),
  ranked AS (SELECT v.*, slot, row_number() OVER (PARTITION BY label ORDER BY score DESC, id) AS r, quota FROM vectors v JOIN quotas USING (label)),
  uniq AS (SELECT * FROM ranked WHERE r <= quota QUALIFY row_number() OVER (PARTITION BY left(text, 100) ORDER BY slot, r) = 1)"""


@query(
    "vector_topk_by_type",
    f"WITH {b.VECTORS.strip()}, {_QUOTAS} SELECT label, id, text, round(score, 6) AS score FROM uniq ORDER BY uniq.score DESC, id LIMIT 8",
)
def vector_topk_by_type(spark, folder):
    hits = rt.vector_topk_by_type(b.vectors(spark, folder), b.query_vector(spark, folder))
    return hits.withColumn("score", F.round("score", 6))


@query(
    "retrieve_fallback",
    f"WITH {b.VECTORS.strip()} SELECT 'no ' || label AS label, id, text, round(score, 6) AS score FROM vectors ORDER BY vectors.score DESC, id LIMIT 8",
)
def retrieve_fallback(spark, folder):
    """No row has a listed type: the best of all of them."""
    other = b.vectors(spark, folder).withColumn("label", F.concat(F.lit("no "), "label"))
    hits = rt.retrieve(other, b.query_vector(spark, folder))
    return hits.withColumn("score", F.round("score", 6))


@query(
    "top_n_per_type",
    f"WITH {b.VECTORS.strip()} SELECT label, id, CAST(row_number() OVER (PARTITION BY label ORDER BY score DESC, id) AS INTEGER) AS rank FROM vectors QUALIFY rank <= 5",
)
def top_n_per_type(spark, folder):
    q = b.query_vector(spark, folder)
    scored = b.vectors(spark, folder).select("label", "id", rt.similarity(q).alias("score"))
    return rt.top_n_per(scored, "label", 5, F.desc("score"), "id").select("label", "id", F.col("_rank").alias("rank"))


@query(
    "dedupe_hits",
    "SELECT arg_min(doc_id, row(-n_chars, doc_id)) AS doc_id FROM documents WHERE left(text, 100) <> '' GROUP BY left(text, 100)",
)
def dedupe_hits(spark, folder):
    """Documents, longest first, one per first 100 characters."""
    d = b.table(spark, folder, "documents").select("doc_id", "text", (-F.col("n_chars")).alias("shorter"))
    return rt.dedupe_hits(d, ["shorter", "doc_id"]).select("doc_id")


@query("top_evidence", "SELECT event_id, value AS score FROM events ORDER BY value DESC, event_id LIMIT 8")
def top_evidence(spark, folder):
    e = b.table(spark, folder, "events").select("event_id", F.col("value").alias("score"))
    return rt.top_evidence(e, 6, "event_id")


@query(
    "vector_table",
    f"""WITH t AS ({SQL["rag_text"]})
    SELECT t.label AS label, id, text, vec_id FROM t JOIN embeddings ON vec_id = (length(id) * 3671 + ascii(id) * 37 + ascii(right(id, 1))) % (SELECT max(vec_id) + 1 FROM embeddings)""",
)
def vector_table(spark, folder):
    """Node texts with the embedding whose number a rule derives from the node's id; nodes are stored for both branches."""
    g = b.graph(spark, folder)
    embeddings = b.table(spark, folder, "embeddings").select("vec_id", "embedding")
    size = embeddings.agg(F.max("vec_id") + 1).scalar()
    number = ((F.length("id") * 3671 + F.ascii("id") * 37 + F.ascii(F.right("id", F.lit(1)))) % size).cast("long")
    labels = ("Industry", "Hazard", "Exposure", "Subcategory", "Incident")
    nodes = {label: stored(g.nodes[label]) for label in labels}
    ids = [nodes[label].select(F.lit(label).alias("label"), "id", number.alias("vec_id")) for label in labels]
    vectors = tables.union_runs(*ids).join(embeddings, "vec_id")
    return rt.vector_table(nodes, vectors).select("label", "id", "text", "vec_id")


@query(
    "expand_hits",
    f"""WITH {b.GRAPH}, hits AS (SELECT id, name || '.' AS text, CAST(1.0 / length(id) AS DOUBLE) AS s FROM cat_nodes WHERE type = 'exposure' ORDER BY s DESC, id LIMIT 8),
      nb AS (SELECT h.id AS id, i."from" AS name FROM hits h JOIN edges i ON i.type = 'EXPOSES' AND i."to" = h.id
        UNION SELECT h.id, s.name FROM hits h JOIN edges i ON i.type = 'INCLUDES' AND i.from_label = 'Exposure' AND i."from" = h.id JOIN sub_nodes s ON s.id = i."to"),
      t AS (SELECT * FROM nb QUALIFY row_number() OVER (PARTITION BY id ORDER BY name) <= 6)
    SELECT 'Exposure' AS type, round(s, 3) AS score, text, string_agg(name, '|' ORDER BY name) AS linked, '' AS urls FROM hits JOIN t USING (id) GROUP BY text, s, id""",
)
def expand_hits(spark, folder):
    g = b.graph(spark, folder)
    hits = cut(
        g.nodes["Exposure"]
        .select(
            F.lit("Exposure").alias("label"),
            "id",
            F.concat("name", F.lit(".")).alias("text"),
            (F.lit(1.0) / F.length("id")).alias("score"),
        )
        .orderBy(F.desc("score"), "id")
        .limit(8)
    )
    rows = rt.expand_hits(hits, b.adjacency(spark, folder))
    return rows.select("type", "score", "text", F.array_join("linked", "|").alias("linked"), F.array_join("urls", "|").alias("urls"))


# --- lanes --------------------------------------------------------------------

A, B = "Brand#3 Works", "Brand#7 Works"


@query(
    "relational_but_not",
    f"""WITH {b.GRAPH} SELECT 'Exposure' AS type, name AS text FROM cat_nodes WHERE type = 'exposure' AND id IN (SELECT "to" FROM edges WHERE type = 'EXPOSES' AND "from" = '{A}')
      AND id NOT IN (SELECT "to" FROM edges WHERE type = 'EXPOSES' AND "from" = '{B}')""",
)
def relational_but_not(spark, folder):
    return rt.relational(b.graph(spark, folder), A, B, but_not=True)


@query(
    "relational_both",
    f"""WITH {b.GRAPH}, paths AS (SELECT h."from" AS n0, a."to" AS n2 FROM edges h JOIN edges a ON a."from" = h."to" WHERE h.type = 'HAD_INCIDENT' AND a.type = 'PERPETRATED_BY')
    SELECT 'Group' AS type, text FROM (SELECT n2 AS text FROM paths WHERE n0 = '{A}' INTERSECT SELECT n2 FROM paths WHERE n0 = '{B}')""",
)
def relational_both(spark, folder):
    return rt.relational(b.graph(spark, folder), A, B)


_TOP_IN = f"""WITH {b.POSTINGS}, t AS (SELECT "group", count(*) AS n FROM postings WHERE %s GROUP BY 1 ORDER BY n DESC, 1 NULLS LAST LIMIT 10)
    SELECT "group", n FROM t WHERE "group" IS NOT NULL""".replace("%s", "sector = 'LOW'")


@query("top_groups_in", _TOP_IN)
def top_groups_in(spark, folder):
    return rt.top_groups_in(tables.normalize_postings(b.raw_postings(spark, folder)), "LOW")


_FOOT = f"""{b.POSTINGS}, hit AS (SELECT * FROM postings WHERE starts_with(lower("group"), 'group 1')),
  fp AS (SELECT 'total' AS panel, '' AS name, count(*) AS n FROM hit
    UNION ALL (SELECT 'sector', sector, count(*) AS n FROM hit GROUP BY 2 ORDER BY n DESC, 2 LIMIT 8)
    UNION ALL SELECT 'year', CAST("year" AS VARCHAR), count(*) FROM hit WHERE "year" IS NOT NULL GROUP BY 2
    UNION ALL SELECT * FROM (SELECT 'country', country, count(*) AS n FROM hit GROUP BY 2 ORDER BY n DESC, 2 NULLS LAST LIMIT 6) WHERE country IS NOT NULL)"""


@query("entity_footprint", f"WITH {_FOOT} SELECT panel, name, n FROM fp")
def entity_footprint(spark, folder):
    return rt.entity_footprint(tables.normalize_postings(b.raw_postings(spark, folder)), "group 1")


@query(
    "entity_evidence",
    f"""WITH {_FOOT}{b.INCIDENTS.replace(b._PARTS, "," + b._PARTS)},
      late AS (SELECT victim, row_number() OVER (ORDER BY attackdate DESC NULLS LAST, victim, _id) AS r FROM hit),
      cases AS (SELECT *, {b.sql_slug("industry")} || '--' || {b.sql_slug("victim")} AS _id FROM incs WHERE contains(lower("group"), 'group 1') AND victim <> '' ORDER BY victim, _id LIMIT 8)
    SELECT CAST(0 AS INTEGER) AS slot, 'footprint' AS type, 'GROUP 1: ' || format('{{:,}}', (SELECT n FROM fp WHERE panel = 'total')) || ' leak-site victims. Top sectors: '
      || (SELECT string_agg(name || ' (' || n || ')', ', ' ORDER BY n DESC, name) FROM (SELECT * FROM fp WHERE panel = 'sector' ORDER BY n DESC, name LIMIT 5))
      || '. Countries: ' || (SELECT string_agg(name || ' (' || n || ')', ', ' ORDER BY n DESC, name) FROM (SELECT * FROM fp WHERE panel = 'country' ORDER BY n DESC, name LIMIT 4)) AS text, '' AS urls
    UNION ALL SELECT 1, 'Incident', victim || ' (' || industry || '): ' || left(summary, 200), array_to_string(sources[1:3], '|') FROM cases
    UNION ALL SELECT 2, 'recent victims', 'Recent leak-site victims: ' || (SELECT string_agg(victim, ', ' ORDER BY r) FROM late WHERE r <= 12), ''""",
)
def entity_evidence(spark, folder):
    postings = tables.normalize_postings(b.raw_postings(spark, folder))
    incidents = tables.incidents_table(b.records(spark, folder))
    rows = rt.entity_evidence(postings, incidents, "group 1")
    return rows.withColumn("urls", F.array_join("urls", "|"))


_ANALYTICAL = f"""{b.POSTINGS}{b.INCIDENTS.replace(b._PARTS, "," + b._PARTS)},
      t AS (SELECT * FROM (SELECT "group", count(*) AS n FROM postings WHERE sector = 'LOW' GROUP BY 1 ORDER BY n DESC, 1 NULLS LAST LIMIT 10) WHERE "group" IS NOT NULL ORDER BY n DESC, 1 LIMIT 8)"""


@query(
    "analytical_evidence",
    f"""WITH {_ANALYTICAL}
    SELECT CAST(0 AS INTEGER) AS slot, 'totals' AS type, format('{{:,}}', (SELECT count(*) FROM postings)) || ' leak-site victims across ' || (SELECT count(DISTINCT "group") FROM postings) || ' groups and '
      || (SELECT count(DISTINCT country) FROM postings) || ' countries; ' || (SELECT count(*) FROM incs WHERE victim <> '') || ' researched incidents.' AS text
    UNION ALL SELECT slot + 1, 'coverage', field || ': ' || disclosed || ' of ' || total || ' disclosed (' || pct || '%)' FROM ({SQL["coverage"]})
    UNION ALL SELECT 8, 'aggregation', 'Top groups: ' || (SELECT string_agg("group" || ' (' || n || ')', ', ' ORDER BY n DESC, "group") FROM t)""",
)
def analytical_evidence(spark, folder):
    """Totals, coverage and sector line of the analytical lane."""
    postings = tables.normalize_postings(b.raw_postings(spark, folder))
    incidents = tables.incidents_table(b.records(spark, folder))
    return rt.analytical_evidence(postings, incidents, "LOW").drop("urls")


@query(
    "analytical_facts",
    f"""WITH {_ANALYTICAL}
    SELECT 'total_victims' AS fact, '' AS name, CAST(count(*) AS DOUBLE) AS value FROM postings
    UNION ALL SELECT 'group_count', '', count(DISTINCT "group") FROM postings UNION ALL SELECT 'country_count', '', count(DISTINCT country) FROM postings
    UNION ALL SELECT 'researched_incidents', '', count(*) FROM incs WHERE victim <> ''
    UNION ALL SELECT 'by_year', CAST("year" AS VARCHAR), count(*) FROM postings WHERE "year" IS NOT NULL GROUP BY 2
    UNION ALL SELECT 'top_groups', "group", n FROM ({SQL["top_groups"]}) UNION ALL SELECT 'top_countries', country, n FROM ({SQL["top_countries"]})
    UNION ALL SELECT 'coverage', field, disclosed FROM ({SQL["coverage"]})
    UNION ALL SELECT 'costliest', victim, usd FROM ({SQL["costliest"]}) UNION ALL SELECT 'largest_ransoms', victim, usd FROM ({SQL["largest_ransoms"]})
    UNION ALL SELECT 'top_groups_in', "group", n FROM ({_TOP_IN})
    UNION ALL SELECT 'by_sector', mode_name, n FROM (SELECT sector_key AS mode_name, count(*) AS n FROM postings WHERE sector_key IS NOT NULL GROUP BY 1)""",
)
def analytical_facts(spark, folder):
    """The figures of the analytical lane; sectors by their key."""
    raw = b.raw_postings(spark, folder)
    postings = tables.normalize_postings(raw)
    panels = ins.insight_panels(raw, postings, tables.incidents_table(b.records(spark, folder)))
    facts = rt.analytical_facts(panels, postings, "LOW")
    return facts.withColumn("name", F.when(F.col("fact") == "by_sector", fn.sector_key("name")).otherwise(F.col("name")))


@query("entity_facts", f"WITH {_FOOT} SELECT panel AS fact, name, CAST(n AS DOUBLE) AS value FROM fp")
def entity_facts(spark, folder):
    return rt.entity_facts(tables.normalize_postings(b.raw_postings(spark, folder)), "group 1")
