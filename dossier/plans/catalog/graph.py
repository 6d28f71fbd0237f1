"""Graph construction, edge operators and the named graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier.operators import adjacency
from dossier.operators import graph as gr
from dossier.operators import patterns as pt
from dossier.plans.catalog import bindings as b
from dossier.plans.catalog.registry import query
from dossier.session import stored

A, B = "Brand#3 Works", "Brand#7 Works"
G = "WITH " + b.GRAPH.strip()


def _node(name: str, label: str, sql: str):
    def run(spark, folder):
        return b.graph(spark, folder).nodes[label]

    query(name, sql)(run)


# --- nodes ------------------------------------------------------------------

_node(
    "industry_nodes",
    "Industry",
    f"""{G}, last AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY industry ORDER BY pos DESC) = 1)
    SELECT l.industry AS id, l.tag AS sector_tag, CAST((SELECT count(*) FROM incs i WHERE i.pos = l.pos) AS INTEGER) AS incident_count,
      left(l.overview, 1200) AS overview, coalesce('Distinct by ' || n_name, '') AS "distinct", '' AS extortion_leverage,
      coalesce(n_nationkey || ' hours', '') AS downtime_tolerance
    FROM last l LEFT JOIN nation ON l.p_brand = 'Brand#' || n_nationkey""",
)
_node("hazard_nodes", "Hazard", f"{G} SELECT id, name, description FROM cat_nodes WHERE type = 'hazard'")
_node("exposure_nodes", "Exposure", f"{G} SELECT id, name, description FROM cat_nodes WHERE type = 'exposure'")
_node("subcategory_nodes", "Subcategory", f"{G} SELECT id, name, parent, kind FROM sub_nodes")
_node(
    "incident_nodes",
    "Incident",
    f"""{G} SELECT id, victim, "date", country, financial_impact, ransom, downtime, data_impact, summary,
      CAST(source_count AS INTEGER) AS source_count FROM inc_nodes""",
)
_node("company_nodes", "Company", f"{G} SELECT DISTINCT victim AS id FROM named")
_node(
    "group_nodes",
    "Group",
    f"""{G} SELECT DISTINCT id FROM (SELECT "to" AS id FROM edges WHERE type = 'PERPETRATED_BY'
      UNION ALL SELECT "group" FROM raw WHERE trim(victim) <> '' AND trim("group") <> '')""",
)
_node("country_nodes", "Country", f"""{G} SELECT DISTINCT "to" AS id FROM edges WHERE type = 'OCCURRED_IN'""")
_node(
    "source_nodes",
    "Source",
    f"""{G} SELECT DISTINCT "to" AS id, regexp_replace(regexp_extract(lower("to"), '^https?://([^/?#:]+)', 1), '^www\\.', '') AS host
    FROM edges WHERE type = 'CITED_BY'""",
)
_node(
    "statistic_nodes",
    "Statistic",
    f"""{G} SELECT industry || '::' || {b.sql_norm_key("metric")} AS id, arg_max(metric, pos) AS metric, arg_max(left(value, 600), pos) AS value,
      arg_max(source, pos) AS source, arg_max(coalesce(source_url, ''), pos) AS source_url, 'industry' AS scope
    FROM stats WHERE metric <> '' GROUP BY 1
    UNION ALL SELECT 'GLOBAL::global loss ' || n_nationkey, 'Global loss ' || n_nationkey, '$' || n_nationkey || 'bn', 'Report', '', 'global' FROM nation""",
)
_node(
    "theme_nodes",
    "Theme",
    """SELECT 'theme ' || lower(replace(n_name, '_', ' ')) AS id, 'Theme ' || n_name AS name, 'hazard' AS kind FROM nation
    UNION ALL SELECT DISTINCT 'shared theme ' || n_regionkey, 'Shared/Theme ' || n_regionkey, 'hazard' FROM nation
    UNION ALL SELECT 'exposed ' || lower(replace(n_name, '_', ' ')), 'Exposed ' || n_name, 'exposure' FROM nation""",
)
_node(
    "victim_nodes",
    "Victim",
    f"""WITH {b.RAW_POSTINGS} SELECT victim || '::' || activity AS id, victim AS name, activity AS sector,
      arg_max(left(attackdate, 10), pos) AS attackdate, arg_max(country, pos) AS country, arg_max("domain", pos) AS "domain",
      arg_max(CASE WHEN press <> '' THEN 'yes' ELSE '' END, pos) AS has_press FROM raw WHERE trim(victim) <> '' GROUP BY ALL""",
)


# --- edges ------------------------------------------------------------------


@query("graph_edges", f'{G} SELECT "from", from_label, type, "to", to_label FROM edges')
def graph_edges(spark, folder):
    return b.graph(spark, folder).edges


@query(
    "group_mentions",
    f"""{G} SELECT id, unnest({b.sql_groups('"group"')}) AS name FROM named""",
)
def group_mentions(spark, folder):
    return gr.group_mentions(b.records(spark, folder))


@query(
    "graph_counts",
    f"""{G}, grp AS (SELECT DISTINCT id FROM (SELECT "to" AS id FROM edges WHERE type = 'PERPETRATED_BY'
        UNION ALL SELECT "group" FROM raw WHERE trim(victim) <> '' AND trim("group") <> ''))
    SELECT 'edge' AS kind, type AS name, count(*) AS n FROM edges GROUP BY 2
    UNION ALL SELECT 'node', 'Industry', count(DISTINCT industry) FROM p
    UNION ALL SELECT 'node', CASE type WHEN 'hazard' THEN 'Hazard' ELSE 'Exposure' END, count(*) FROM cat_nodes GROUP BY type
    UNION ALL SELECT 'node', 'Subcategory', count(*) FROM sub_nodes
    UNION ALL SELECT 'node', 'Incident', count(*) FROM inc_nodes
    UNION ALL SELECT 'node', 'Company', count(DISTINCT victim) FROM named
    UNION ALL SELECT 'node', 'Group', count(*) FROM grp
    UNION ALL SELECT 'node', 'Country', count(DISTINCT "to") FROM edges WHERE type = 'OCCURRED_IN'
    UNION ALL SELECT 'node', 'Source', count(DISTINCT "to") FROM edges WHERE type = 'CITED_BY'
    UNION ALL SELECT 'node', 'Statistic', (SELECT count(DISTINCT "to") FROM edges WHERE type = 'MEASURED_BY') + (SELECT count(*) FROM nation)
    UNION ALL SELECT 'node', 'Theme', 2 * (SELECT count(*) FROM nation) + (SELECT count(DISTINCT n_regionkey) FROM nation)
    UNION ALL SELECT 'node', 'Victim', count(*) FROM (SELECT DISTINCT victim, activity FROM raw WHERE trim(victim) <> '')""",
)
def graph_counts(spark, folder):
    return gr.graph_counts(b.graph(spark, folder))


@query(
    "graph_export",
    f"""{G} SELECT from_label || ':' || "from" AS source, to_label || ':' || "to" AS target, type FROM edges WHERE to_label <> 'Source'""",
)
def graph_export(spark, folder):
    """The links of the viewer export."""
    return gr.graph_export(b.graph(spark, folder))[1]


@query(
    "graph_export_nodes",
    f"""{G} SELECT 'Company:' || victim AS id, 'Company' AS label FROM (SELECT DISTINCT victim FROM named)
    UNION ALL SELECT 'Incident:' || id, 'Incident' FROM inc_nodes
    UNION ALL SELECT 'Subcategory:' || id, 'Subcategory' FROM sub_nodes""",
)
def graph_export_nodes(spark, folder):
    nodes, _ = gr.graph_export(b.graph(spark, folder))
    return nodes.filter(F.col("label").isin("Company", "Incident", "Subcategory")).select("id", "label")


_LOOSE = """loose AS (
  SELECT 'c' || o_custkey AS "from", 'Customer' AS from_label, 'ORDERED' AS type, 'p' || l_partkey AS "to", 'Part' AS to_label
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"""


def _loose_edges(spark, folder):
    o, line = b.table(spark, folder, "orders"), b.table(spark, folder, "lineitem")
    pairs = line.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return gr.edge_rows(
        pairs,
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")),
        "Customer",
        "ORDERED",
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")),
        "Part",
    )


@query(
    "resolve_edges",
    f"""WITH {_LOOSE} SELECT DISTINCT * FROM loose WHERE "from" IN (SELECT 'c' || c_custkey FROM customer WHERE c_acctbal > 5000)
      AND "to" IN (SELECT 'p' || p_partkey FROM part WHERE p_size > 25)""",
)
def resolve_edges(spark, folder):
    """Order edges whose customer is in credit and whose part is large."""
    c = b.table(spark, folder, "customer").filter("c_acctbal > 5000")
    p = b.table(spark, folder, "part").filter("p_size > 25")
    keys = c.select(
        F.lit("Customer").alias("label"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id")
    ).unionByName(
        p.select(F.lit("Part").alias("label"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"))
    )
    return gr.merge_edges(gr.resolve_edges(_loose_edges(spark, folder), keys))


@query(
    "resolve_edges_any_label",
    f"""{G}, n AS (SELECT CASE type WHEN 'hazard' THEN 'Hazard' ELSE 'Exposure' END AS label, id FROM cat_nodes
        UNION ALL SELECT 'Theme', id FROM cat_nodes WHERE starts_with(id, 'third'))
    SELECT e."from" AS "from", n.label AS from_label, e.type AS type, e."to" AS "to", e.to_label AS to_label
    FROM edges e JOIN n ON n.id = e."from" WHERE e.type = 'INCLUDES'""",
)
def resolve_edges_any_label(spark, folder):
    """INCLUDES edges against every label that has the source id; some ids occur under two."""
    g = b.graph(spark, folder)
    cats = [g.nodes[k].select(F.lit(k).alias("label"), "id") for k in ("Hazard", "Exposure")]
    third = g.nodes["Hazard"].filter(F.startswith("id", F.lit("third"))).select(F.lit("Theme").alias("label"), "id")
    subs = g.nodes["Subcategory"].select(F.lit("Subcategory").alias("label"), "id")
    keys = cats[0].unionByName(cats[1]).unionByName(third).unionByName(subs)
    return gr.resolve_edges(g.of_type("INCLUDES"), keys, any_label=True)


@query(
    "merge_edges",
    f"WITH {_LOOSE} SELECT DISTINCT * FROM loose",
)
def merge_edges(spark, folder):
    return gr.merge_edges(_loose_edges(spark, folder))


@query(
    "merge_nodes",
    """SELECT o_custkey AS id, arg_max(o_orderpriority, row(o_orderdate, o_orderkey)) AS priority,
      arg_max(o_orderstatus, row(o_orderdate, o_orderkey)) AS status FROM orders GROUP BY 1""",
)
def merge_nodes(spark, folder):
    """Customers with the properties of their last order."""
    rows = b.table(spark, folder, "orders").select(
        F.col("o_custkey").alias("id"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("status"),
        "o_orderdate",
        "o_orderkey",
    )
    return gr.last_values(rows, "id", ["priority", "status"], "o_orderdate", "o_orderkey")


@query(
    "hop",
    f"""{G} SELECT e."from" AS industry, h.name AS name FROM edges e JOIN cat_nodes h ON h.id = e."to" AND h.type = 'exposure' WHERE e.type = 'EXPOSES'""",
)
def hop(spark, folder):
    g = b.graph(spark, folder)
    edges = gr.with_target(g, gr.hop(g, "Industry", "EXPOSES", "Exposure"), "Exposure", "name")
    return edges.select(F.col("from").alias("industry"), "name")


@query(
    "hop_many_types",
    f"""{G} SELECT type, "from", "to" FROM edges WHERE from_label = 'Incident'
    UNION ALL SELECT 'axes', "from", "to" FROM edges WHERE type IN ('FACES', 'EXPOSES', 'HAD_INCIDENT')""",
)
def hop_many_types(spark, folder):
    """Any-type hop from incidents and a three-type hop from industries."""
    g = b.graph(spark, folder)
    any_type = gr.hop(g, "Incident").select("type", "from", "to")
    axes = gr.hop(g, "Industry", ["FACES", "EXPOSES", "HAD_INCIDENT"])
    return any_type.unionByName(axes.select(F.lit("axes").alias("type"), "from", "to"))


_PATHS = f"""{G}, paths AS (SELECT h."from" AS n0, h."to" AS n1, a."to" AS n2 FROM edges h JOIN edges a ON a."from" = h."to"
    WHERE h.type = 'HAD_INCIDENT' AND a.type = 'PERPETRATED_BY')"""


@query("path", f"{_PATHS} SELECT n0, n1, n2 FROM paths")
def path(spark, folder):
    return gr.path(b.graph(spark, folder), ["HAD_INCIDENT", "PERPETRATED_BY"])


@query(
    "shared_targets",
    f"""{G} SELECT "to" FROM edges WHERE type = 'EXPOSES' AND "from" = '{A}' INTERSECT SELECT "to" FROM edges WHERE type = 'EXPOSES' AND "from" = '{B}'""",
)
def shared_targets(spark, folder):
    return gr.shared_targets(b.graph(spark, folder), "EXPOSES", A, B)


@query(
    "only_in",
    f"""{G} SELECT "to" FROM edges WHERE type = 'EXPOSES' AND "from" = '{A}' EXCEPT SELECT "to" FROM edges WHERE type = 'EXPOSES' AND "from" = '{B}'""",
)
def only_in(spark, folder):
    return gr.only_in(b.graph(spark, folder), "EXPOSES", A, B)


@query(
    "groups_in_both",
    f"""{_PATHS} SELECT n2 AS "group" FROM paths WHERE n0 = '{A}' INTERSECT SELECT n2 FROM paths WHERE n0 = '{B}'""",
)
def groups_in_both(spark, folder):
    return gr.groups_in_both(b.graph(spark, folder), A, B)


@query("reach", f"""{G} SELECT "to", count(*) AS reach FROM edges WHERE type = 'EXPOSES' GROUP BY 1""")
def reach(spark, folder):
    return gr.reach(b.graph(spark, folder).of_type("EXPOSES"))


@query(
    "rematch",
    f"""{G} SELECT "from", from_label, type, "to", to_label FROM edges WHERE type = 'EXPOSES'
      AND "to" IN (SELECT "to" FROM edges WHERE type = 'EXPOSES' GROUP BY 1 HAVING count(*) BETWEEN 3 AND 20)""",
)
def rematch(spark, folder):
    return gr.rematch(b.graph(spark, folder), "EXPOSES", F.col("reach").between(3, 20))


_NEAR = f"""{G}, both_ways AS (SELECT from_label AS label, "from" AS id, to_label AS nb_label, "to" AS nb_id FROM edges
      UNION ALL SELECT to_label, "to", from_label, "from" FROM edges),
    asked AS (SELECT DISTINCT 'Group' AS label, "to" AS id FROM edges WHERE type = 'PERPETRATED_BY'
      UNION ALL SELECT 'Theme', 'theme ' || lower(replace(n_name, '_', ' ')) FROM nation)"""


def _asked(g):
    groups = g.of_type("PERPETRATED_BY").select(F.lit("Group").alias("label"), F.col("to").alias("id")).distinct()
    themes = g.nodes["Theme"].filter(F.startswith("id", F.lit("theme"))).select(F.lit("Theme").alias("label"), "id")
    return groups.unionByName(themes)


@query(
    "neighbours",
    f"""{_NEAR} SELECT label, id, nb_label, nb_id FROM asked LEFT JOIN both_ways USING (label, id)""",
)
def neighbours(spark, folder):
    g = b.graph(spark, folder)
    return gr.neighbours(g, _asked(g))


@query(
    "neighbour_context",
    f"""{_NEAR}, names AS (SELECT 'Incident' AS nb_label, id AS nb_id, victim AS name FROM inc_nodes UNION ALL
        SELECT 'Victim', victim || '::' || activity, victim FROM (SELECT DISTINCT victim, activity FROM raw WHERE trim(victim) <> '')),
      d AS (SELECT DISTINCT label, id, name FROM asked JOIN both_ways USING (label, id) JOIN names USING (nb_label, nb_id)),
      t AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY label, id ORDER BY name) <= 6)
    SELECT label, id, coalesce(string_agg(name, '|' ORDER BY name), '') AS linked FROM asked LEFT JOIN t USING (label, id) GROUP BY 1, 2""",
)
def neighbour_context(spark, folder):
    rows = adjacency.neighbour_context(b.adjacency(spark, folder), _asked(b.graph(spark, folder)))
    return rows.select("label", "id", F.array_join("linked", "|").alias("linked"))


@query(
    "cited_sources",
    f"""{_NEAR}, cited AS (SELECT "from" AS nb_id, "to" AS url FROM edges WHERE type = 'CITED_BY'),
      d AS (SELECT DISTINCT label, id, url FROM asked JOIN both_ways USING (label, id) JOIN cited USING (nb_id) WHERE nb_label = 'Incident'),
      t AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY label, id ORDER BY url) <= 4)
    SELECT label, id, coalesce(string_agg(url, '|' ORDER BY url), '') AS urls FROM asked LEFT JOIN t USING (label, id) GROUP BY 1, 2""",
)
def cited_sources(spark, folder):
    g = b.graph(spark, folder)
    rows = gr.cited_sources(g, _asked(g))
    return rows.select("label", "id", F.array_join("urls", "|").alias("urls"))


# --- named queries ------------------------------------------------------------

ROWS = 'SELECT "from" AS src, type, "to" AS dst'


@query("industry_hazards", f"""{G} {ROWS}, 1 AS depth FROM edges WHERE type = 'FACES'""")
def industry_hazards(spark, folder):
    return pt.industry_hazards(b.graph(spark, folder))


@query(
    "industry_profile",
    f"""{G} {ROWS}, 1 AS depth FROM edges WHERE type IN ('FACES', 'EXPOSES', 'HAD_INCIDENT') AND "from" = '{A}'""",
)
def industry_profile(spark, folder):
    return pt.industry_profile(b.graph(spark, folder), A)


@query(
    "industry_axes",
    f"""{G} {ROWS}, 1 AS depth FROM edges WHERE type IN ('FACES', 'EXPOSES') AND "from" = '{A}'""",
)
def industry_axes(spark, folder):
    return pt.industry_profile(b.graph(spark, folder), A, ["FACES", "EXPOSES"])


@query(
    "bowtie",
    f"""{G} {ROWS}, 1 AS depth FROM edges WHERE type = 'FACES' AND "from" IN ('{A}', '{B}')
      AND "to" IN (SELECT "to" FROM edges WHERE type = 'FACES' AND "from" = '{A}')
      AND "to" IN (SELECT "to" FROM edges WHERE type = 'FACES' AND "from" = '{B}')""",
)
def bowtie(spark, folder):
    return pt.bowtie(b.graph(spark, folder), A, B)


@query(
    "shared_names",
    f"""{G} SELECT name FROM cat_nodes WHERE type = 'hazard' AND id IN (SELECT "to" FROM edges WHERE type = 'FACES' AND "from" = '{A}')
      AND id IN (SELECT "to" FROM edges WHERE type = 'FACES' AND "from" = '{B}')""",
)
def shared_names(spark, folder):
    return pt.shared_names(b.graph(spark, folder), A, B)


@query(
    "cross_sector_paths",
    f"""{_PATHS}, w AS (SELECT n2 FROM paths GROUP BY 1 HAVING count(DISTINCT n0) >= 5)
    SELECT DISTINCT n0 AS src, 'HAD_INCIDENT' AS type, n1 AS dst, 1 AS depth FROM paths WHERE n2 IN (FROM w)
    UNION ALL SELECT DISTINCT n1, 'PERPETRATED_BY', n2, 2 FROM paths WHERE n2 IN (FROM w)""",
)
def cross_sector_paths(spark, folder):
    return pt.cross_sector_paths(b.graph(spark, folder), 5)



def _drill(wanted: str) -> str:
    return f"""{G}, i AS (SELECT * FROM edges WHERE type = 'INCLUDES' AND from_label = 'Exposure'),
      x AS (SELECT * FROM edges WHERE type = 'EXPOSES' AND {wanted})
    {ROWS}, 1 AS depth FROM x WHERE "to" IN (SELECT "from" FROM i)
    UNION ALL SELECT "from", type, "to", 2 FROM i WHERE "from" IN (SELECT "to" FROM x)"""


@query(
    "exposure_drill",
    _drill("\"to\" IN (SELECT id FROM cat_nodes WHERE type = 'exposure' AND contains(name, 'vaults'))"),
)
def exposure_drill(spark, folder):
    return pt.exposure_drill(b.graph(spark, folder), "vaults")


@query("industry_drill", _drill(f"\"from\" = '{A}'"))
def industry_drill(spark, folder):
    return pt.industry_drill(b.graph(spark, folder), A)


@query(
    "busiest_sample",
    f"""{G}, a AS (SELECT * FROM edges WHERE type = 'ATTACKED_BY')
    {ROWS}, 1 AS depth FROM a WHERE "to" IN (SELECT "to" FROM a GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5) ORDER BY dst, src LIMIT 300""",
)
def busiest_sample(spark, folder):
    return pt.busiest_sample(b.graph(spark, folder))


@query(
    "incident_star",
    f"""{G}, w AS (SELECT id FROM inc_nodes WHERE starts_with(victim, 'red ')), h AS (SELECT * FROM edges WHERE type = 'HAD_INCIDENT' AND "to" IN (FROM w))
    {ROWS}, 1 AS depth FROM h UNION ALL {ROWS}, 2 FROM edges WHERE from_label = 'Incident' AND "from" IN (SELECT "to" FROM h)""",
)
def incident_star(spark, folder):
    return pt.incident_star(b.graph(spark, folder), "red ")


def _reach(type: str, least: int) -> str:
    return f"""{G} {ROWS}, 1 AS depth FROM edges WHERE type = '{type}'
      AND "to" IN (SELECT "to" FROM edges WHERE type = '{type}' GROUP BY 1 HAVING count(*) >= {least})"""


@query("wide_hazards", _reach("FACES", 10))
def wide_hazards(spark, folder):
    return pt.reach_paths(b.graph(spark, folder), "FACES", 10)


@query("wide_exposures", _reach("EXPOSES", 10))
def wide_exposures(spark, folder):
    return pt.reach_paths(b.graph(spark, folder), "EXPOSES", 10)


@query(
    "group_footprint",
    f"""{_PATHS} SELECT DISTINCT n0 AS src, 'HAD_INCIDENT' AS type, n1 AS dst, 1 AS depth FROM paths WHERE contains(n2, 'crew 1')
    UNION ALL SELECT DISTINCT n1, 'PERPETRATED_BY', n2, 2 FROM paths WHERE contains(n2, 'crew 1')""",
)
def group_footprint(spark, folder):
    return pt.group_footprint(b.graph(spark, folder), "crew 1")


@query(
    "supply_chain_incidents",
    f"""{_PATHS}, w AS (SELECT id FROM inc_nodes WHERE contains(summary, 'third-party') OR contains(summary, 'supply chain')
        OR contains(victim, 'CDK') OR contains(victim, 'Change Healthcare'))
    SELECT DISTINCT n0 AS src, 'HAD_INCIDENT' AS type, n1 AS dst, 1 AS depth FROM paths WHERE n1 IN (FROM w)
    UNION ALL SELECT DISTINCT n1, 'PERPETRATED_BY', n2, 2 FROM paths WHERE n1 IN (FROM w)""",
)
def supply_chain_incidents(spark, folder):
    return pt.supply_chain_incidents(b.graph(spark, folder))


@query(
    "disclosed_paths",
    f"""{G} {ROWS}, 1 AS depth FROM edges WHERE type = 'HAD_INCIDENT' AND "to" IN (SELECT id FROM inc_nodes WHERE contains(financial_impact, '$'))""",
)
def disclosed_paths(spark, folder):
    return pt.disclosed_paths(b.graph(spark, folder))


@query(
    "hazard_reach",
    f"""{G} SELECT name AS hazard, count(*) AS industries FROM edges e JOIN cat_nodes h ON h.id = e."to" AND h.type = 'hazard' WHERE e.type = 'FACES' GROUP BY 1""",
)
def hazard_reach(spark, folder):
    return pt.hazard_reach(b.graph(spark, folder))


@query(
    "only_in_described",
    f"""{G} SELECT name, description FROM cat_nodes WHERE type = 'exposure' AND id IN (SELECT "to" FROM edges WHERE type = 'EXPOSES' AND "from" = '{A}')
      AND id NOT IN (SELECT "to" FROM edges WHERE type = 'EXPOSES' AND "from" = '{B}')""",
)
def only_in_described(spark, folder):
    return pt.only_in_described(b.graph(spark, folder), A, B)


@query(
    "cross_sector_groups",
    f"""{_PATHS} SELECT n2 AS "group", count(DISTINCT n0) AS industries, count(*) AS incidents FROM paths GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 20""",
)
def cross_sector_groups(spark, folder):
    return pt.cross_sector_groups(b.graph(spark, folder))


@query(
    "disclosed_costs",
    f"""{G} SELECT "from" AS industry, victim, financial_impact, downtime, {b.sql_usd("financial_impact")} AS usd
    FROM edges JOIN inc_nodes ON id = "to" WHERE type = 'HAD_INCIDENT' AND contains(financial_impact, '$')
    ORDER BY usd DESC NULLS LAST, industry, victim LIMIT 25""",
)
def disclosed_costs(spark, folder):
    return pt.disclosed_costs(b.graph(spark, folder))


@query(
    "exposure_inventory",
    f"""{G} SELECT x.name AS exposure, s.name AS specific FROM edges e JOIN cat_nodes x ON x.id = e."to" AND x.type = 'exposure'
      JOIN edges i ON i.type = 'INCLUDES' AND i.from_label = 'Exposure' AND i."from" = e."to" JOIN sub_nodes s ON s.id = i."to"
    WHERE e.type = 'EXPOSES' AND e."from" = '{A}'""",
)
def exposure_inventory(spark, folder):
    return pt.exposure_inventory(b.graph(spark, folder), A)


@query(
    "top_groups_graph",
    f"""{G} SELECT "to" AS "group", count(*) AS victims FROM edges WHERE type = 'ATTACKED_BY' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25""",
)
def top_groups_graph(spark, folder):
    return pt.top_groups_graph(b.graph(spark, folder))


@query(
    "year_of_victims",
    f"""WITH {b.RAW_POSTINGS}, v AS (SELECT victim, activity, arg_max(left(attackdate, 10), pos) AS d FROM raw WHERE trim(victim) <> '' GROUP BY ALL)
    SELECT activity AS sector, left(d, 4) AS "year", count(*) AS victims FROM v WHERE d <> '' GROUP BY 1, 2""",
)
def year_of_victims(spark, folder):
    """Sector x year over merged victims, as the graph stores them."""
    return pt.sector_year(gr.victim_nodes(b.raw_postings(spark, folder)))




@query(
    "edges_meet_nodes",
    f"""{G} SELECT type, count(*) AS edges, count(*) AS resolved FROM edges GROUP BY 1""",
)
def edges_meet_nodes(spark, folder):
    """Every edge type against the graph's own nodes: none is left without its ends."""
    g = b.graph(spark, folder)
    n = F.count(F.lit(1))
    edges = stored(g.edges)
    found = gr.resolve_edges(edges, g.node_keys()).groupBy("type").agg(n.alias("resolved"))
    counts = edges.groupBy("type").agg(n.alias("edges")).join(found, "type", "left")
    return counts.select("type", "edges", F.coalesce("resolved", F.lit(0).cast("long")).alias("resolved"))
