"""Document tables, flat tables and taxonomy over records and postings."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier.operators import insights as ins
from dossier.operators import search, tables, taxonomy
from dossier.plans.catalog import bindings as b
from dossier.plans.catalog import insights
from dossier.plans.catalog.registry import SQL, query

joined = lambda c, sep="|": F.array_join(c, sep)
big = lambda c: F.col(c).cast("long").alias(c)


@query(
    "normalize_postings",
    f"""WITH {b.POSTINGS} SELECT _id, victim, "group", sector_key, sector, country, attackdate, "year", discovered, "domain",
      data_size, has_press, claim_url, 'ransomware.live' AS source, 'now' AS ingested_at FROM postings""",
)
def normalize_postings(spark, folder):
    return tables.normalize_postings(b.raw_postings(spark, folder), F.lit("now"))


@query(
    "unique_postings",
    f"""WITH {b.POSTINGS} SELECT _id, data_size FROM (
      SELECT _id, data_size, pos AS o FROM postings UNION ALL SELECT _id, 'again ' || pos, pos + 1000000000 FROM postings WHERE has_press)
    QUALIFY row_number() OVER (PARTITION BY _id ORDER BY o DESC) = 1""",
)
def unique_postings(spark, folder):
    """Postings after a keyed load of a feed that repeats and changes its press-covered rows."""
    postings = tables.normalize_postings(b.raw_postings(spark, folder), F.lit("now"), keep=["_pos"])
    again = postings.filter("has_press").withColumns(
        {"data_size": F.concat(F.lit("again "), F.col("_pos").cast("string")), "_pos": F.col("_pos") + 1_000_000_000}
    )
    return tables.unique_postings(tables.union_runs(postings, again), "_pos").select("_id", "data_size")


@query(
    "incidents_table",
    f"""WITH {b.INCIDENTS} SELECT {b.sql_slug("industry")} || '--' || {b.sql_slug("victim")} AS _id, {b.sql_slug("industry")} AS industry_id,
      industry, victim, nullif("group", '') AS "group", nullif("date", '') AS "date", nullif(country, '') AS country,
      nullif(financial_impact, '') AS financial_text, {b.sql_usd("financial_impact")} AS financial_usd,
      nullif(ransom_demanded_or_paid, '') AS ransom_text, {b.sql_usd("ransom_demanded_or_paid")} AS ransom_usd,
      nullif(downtime_and_recovery, '') AS downtime_and_recovery, nullif(data_impact, '') AS data_impact, nullif(summary, '') AS summary,
      array_to_string(list_filter(sources, lambda u: {b.sql_url("u")}), '|') AS sources
    FROM incs WHERE victim <> ''""",
)
def incidents_table(spark, folder):
    docs = tables.incidents_table(b.records(spark, folder))
    money = [F.col(f"{m}.{f}").alias(f"{m}_{f}") for m in ("financial", "ransom") for f in ("text", "usd")]
    rest = [c for c in docs.columns if c not in ("financial", "ransom", "sources", "updated_at")]
    return docs.select(*rest, *money, joined("sources").alias("sources"))


@query(
    "incidents_flat",
    f"""WITH {b.INCIDENTS} SELECT industry, victim, "group", "date", country, financial_impact, ransom_demanded_or_paid,
      downtime_and_recovery, data_impact, summary, array_to_string(sources, ' ; ') AS sources FROM incs""",
)
def incidents_flat(spark, folder):
    return tables.incidents_flat(b.records(spark, folder))


@query(
    "taxonomy_flat",
    f"""WITH {b.CATEGORIES} SELECT industry, type, category, description, array_to_string(subs, ' | ') AS subcategories FROM cats""",
)
def taxonomy_flat(spark, folder):
    return tables.taxonomy_flat(b.records(spark, folder))


@query("stats_flat", f"WITH {b.STATS} SELECT industry, metric, value, source, source_url FROM stats")
def stats_flat(spark, folder):
    return tables.stats_flat(b.records(spark, folder))


@query("distinct_sources", f"WITH {b.INCIDENTS} SELECT DISTINCT url FROM (SELECT unnest(sources) AS url FROM incs)")
def distinct_sources(spark, folder):
    return tables.distinct_sources(b.records(spark, folder))


@query(
    "dataset_totals",
    f"""WITH {b.CATEGORIES}{b.INCIDENTS[len(b._PARTS):]}{b.STATS[len(b._PARTS):]}
    SELECT (SELECT count(*) FROM p) AS industries, (SELECT count(*) FROM incs) AS incidents,
      (SELECT count(*) FROM cats WHERE type = 'hazard') AS hazard_categories,
      (SELECT count(*) FROM cats WHERE type = 'exposure') AS exposure_categories,
      (SELECT CAST(sum(len(subs)) AS BIGINT) FROM cats) AS subcategories, (SELECT count(*) FROM stats) AS aggregate_stats,
      (SELECT count(DISTINCT url) FROM (SELECT unnest(sources) AS url FROM incs)) AS unique_sources""",
)
def dataset_totals(spark, folder):
    return tables.dataset_totals(b.records(spark, folder))


_RICH = f"""WITH {b.CATEGORIES}{b.INCIDENTS[len(b._PARTS):]}{b.STATS[len(b._PARTS):]},
  r AS (SELECT pos, sum(w) AS rich FROM (
      SELECT pos, CASE type WHEN 'hazard' THEN 10 ELSE 1 END AS w FROM cats
      UNION ALL SELECT pos, 100 FROM incs UNION ALL SELECT pos, 1 FROM stats) GROUP BY pos),
  best AS (SELECT p.* FROM p JOIN r USING (pos) QUALIFY row_number() OVER (PARTITION BY industry ORDER BY rich DESC, pos) = 1)"""


@query("dedupe_richest", f"{_RICH} SELECT industry, pos, overview FROM best")
def dedupe_richest(spark, folder):
    best = tables.dedupe_richest(b.records(spark, folder, canonical=False))
    return best.select("industry", F.col("_pos").alias("pos"), "overview")


@query(
    "fold_in",
    """WITH base AS (SELECT p_brand || ' Works' AS industry FROM part WHERE p_type = 'ECONOMY' AND p_size > 40)
    SELECT * FROM base UNION ALL SELECT p_brand || ' Works' FROM part WHERE p_brand || ' Works' NOT IN (SELECT industry FROM base)""",
)
def fold_in(spark, folder):
    """Large economy records, plus the records of brands that have none."""
    all_records = b.records(spark, folder)
    p = b.table(spark, folder, "part").filter("p_type = 'ECONOMY' AND p_size > 40")
    base = p.select(F.concat("p_brand", F.lit(" Works")).alias("industry"))
    return tables.fold_in(base, all_records.select("industry"))


_SUMMARY = f"""{b.POSTINGS},
  s AS (SELECT sector_key, count(*) AS total, CAST(round(count_if(has_press) / count(*) * 100) AS INTEGER) AS press_pct FROM postings GROUP BY 1)"""


@query(
    "with_sector_summary",
    f"""WITH {b._PARTS.strip()}, s AS ({SQL["sector_summary"]})
    SELECT pos, s.sector_key AS sector_key, s.total AS total, s.by_year AS by_year, s.top_groups AS top_groups, s.top_countries AS top_countries, s.press_pct AS press_pct, s.ransom_pct AS ransom_pct
    FROM p LEFT JOIN s ON lower(trim(p.tag)) = s.sector_key""",
)
def with_sector_summary(spark, folder):
    """Every field of the summary beside the record."""
    summary = ins.sector_summary(b.raw_postings(spark, folder))
    rows = tables.with_sector_summary(b.records(spark, folder), summary)
    packed = rows.select(F.col("_pos").alias("pos"), "bulk_summary.*")
    return insights.summary_texts(packed, "pos")


@query(
    "resolve_sector",
    f"""WITH {b._PARTS.strip()}, {b.RAW_POSTINGS},
      sec AS (SELECT DISTINCT CASE WHEN activity = '' THEN 'Unclassified' ELSE activity END AS sector FROM raw WHERE victim <> ''),
      loose AS (SELECT {b.sql_norm_key("sector")} AS k, min(sector) AS sector FROM sec GROUP BY 1)
    SELECT pos, coalesce(e.sector, l.sector) AS resolved_sector FROM p
      LEFT JOIN sec e ON trim(p.tag) = e.sector LEFT JOIN loose l ON {b.sql_norm_key("trim(p.tag)")} = l.k""",
)
def resolve_sector(spark, folder):
    postings = tables.normalize_postings(b.raw_postings(spark, folder))
    rows = tables.resolve_sector(b.records(spark, folder), postings.select("sector"))
    return rows.select(F.col("_pos").alias("pos"), "resolved_sector")


@query(
    "with_differentiators",
    f"""WITH {b._PARTS.strip()} SELECT pos, 'Distinct by ' || n_name AS "distinct", CAST(NULL AS VARCHAR) AS extortion_leverage,
      CASE WHEN n_nationkey IS NOT NULL THEN n_nationkey || ' hours' END AS downtime_tolerance
    FROM p LEFT JOIN nation ON p.p_brand = 'Brand#' || n_nationkey""",
)
def with_differentiators(spark, folder):
    rows = tables.with_differentiators(b.records(spark, folder), b.synthesis(spark, folder))
    return rows.select(F.col("_pos").alias("pos"), "distinct", "extortion_leverage", "downtime_tolerance")


@query(
    "with_incident_ids",
    f"""WITH {b.INCIDENTS}, ids AS (SELECT {b.sql_slug("industry")} AS industry_id, {b.sql_slug("industry")} || '--' || {b.sql_slug("victim")} AS incident_id
      FROM incs WHERE victim <> '')
    SELECT industry_id, incident_id FROM (SELECT DISTINCT industry, {b.sql_slug("industry")} AS industry_id FROM p) i LEFT JOIN ids USING (industry_id)""",
)
def with_incident_ids(spark, folder):
    records = b.records(spark, folder)
    rows = tables.with_incident_ids(records.select("industry").distinct(), tables.incidents_table(records))
    return rows.select("industry_id", "incident_id")


@query(
    "industries_table",
    f"""{_RICH}, {_SUMMARY}, hz AS (SELECT pos, string_agg(category || '=' || {b.sql_family(b.sql_norm_key("category"))}, '|' ORDER BY slot) AS hazards
        FROM cats WHERE type = 'hazard' GROUP BY pos),
      ic AS (SELECT pos, string_agg({b.sql_slug("industry")} || '--' || {b.sql_slug("victim")}, '|' ORDER BY slot) AS ids FROM incs WHERE victim <> '' GROUP BY pos)
    SELECT {b.sql_slug("best.industry")} AS _id, best.industry AS name, nullif(best.tag, '') AS ransomware_live_sector,
      nullif(best.overview, '') AS overview, 'Distinct by ' || n_name AS "distinct", hz.hazards AS hazards, ic.ids AS incident_ids, s.total AS bulk_total
    FROM best LEFT JOIN nation ON best.p_brand = 'Brand#' || n_nationkey LEFT JOIN hz USING (pos) LEFT JOIN ic USING (pos)
      LEFT JOIN s ON lower(trim(best.tag)) = s.sector_key""",
)
def industries_table(spark, folder):
    industries = tables.dedupe_richest(b.records(spark, folder))
    summary = ins.sector_summary(b.raw_postings(spark, folder))
    docs = tables.industries_table(industries, b.synthesis(spark, folder), summary)
    pairs = F.transform("hazards", lambda h: F.concat(h["category"], F.lit("="), h["family"]))
    return docs.select(
        "_id",
        "name",
        "ransomware_live_sector",
        "overview",
        F.col("differentiators.distinct").alias("distinct"),
        joined(pairs).alias("hazards"),
        joined("incident_ids").alias("incident_ids"),
        F.col("bulk_summary.total").alias("bulk_total"),
    )


# --- taxonomy -----------------------------------------------------------------

_KEYED = f"""WITH {b.CATEGORIES}, keyed AS (SELECT *, {b.sql_norm_key("category")} AS key FROM cats), k AS (SELECT * FROM keyed WHERE key <> '')"""


@query(
    "taxonomy",
    f"""{_KEYED} SELECT type || ':' || key AS _id, type, key, {b.sql_family("key")} AS family,
      first(description ORDER BY length(description) DESC, pos, slot) AS description,
      CAST(sum(len(subs)) AS BIGINT) AS subcategory_count, count(*) AS reach, count(DISTINCT industry) AS industry_reach
    FROM k GROUP BY type, key""",
)
def taxonomy_query(spark, folder):
    return taxonomy.taxonomy(b.records(spark, folder))


@query(
    "taxonomy_members",
    f"""{_KEYED} SELECT type, key, {b.sql_slug("industry")} AS industry_id, industry, category AS label_as_reported, array_to_string(subs, '+') AS subcategories FROM k""",
)
def taxonomy_members(spark, folder):
    rows = taxonomy.taxonomy_members(b.records(spark, folder))
    return rows.withColumn("subcategories", joined("subcategories", "+"))


@query(
    "category_index",
    f"""{_KEYED} SELECT type, key, {b.sql_label("key")} AS name, {b.sql_family("key")} AS family,
      first(description ORDER BY length(description) DESC, pos, slot) AS description, count(DISTINCT industry) AS reach FROM k GROUP BY type, key""",
)
def category_index(spark, folder):
    return taxonomy.category_index(b.records(spark, folder))


@query(
    "index_cells",
    f"""{_KEYED} SELECT type, key, industry, arg_max(category, row(pos, slot)) AS category,
      array_to_string(arg_max(subs, row(pos, slot)), '|') AS subcategories FROM k GROUP BY ALL""",
)
def index_cells(spark, folder):
    cells = taxonomy.index_cells(b.records(spark, folder))
    return cells.withColumn("subcategories", joined("subcategories"))


_CELLS = f"""{_KEYED}, cells AS (SELECT type, key, industry, arg_max(subs, row(pos, slot)) AS subs FROM k GROUP BY ALL)"""


@query(
    "family_rollup",
    f"""{_CELLS} SELECT {b.sql_family("key")} AS family, count(DISTINCT industry) AS industries, count(DISTINCT key) AS labels,
      CAST(sum(len(subs)) AS BIGINT) AS subcategories FROM cells WHERE type = 'hazard' GROUP BY 1""",
)
def family_rollup(spark, folder):
    return taxonomy.family_rollup(taxonomy.index_cells(b.records(spark, folder)))


@query(
    "family_labels",
    f"""{_CELLS} SELECT DISTINCT {b.sql_family("key")} AS family, key AS label FROM cells WHERE type = 'hazard'""",
)
def family_labels(spark, folder):
    return taxonomy.family_labels(taxonomy.index_cells(b.records(spark, folder)))


@query(
    "family_subcategories",
    f"""{_CELLS} SELECT {b.sql_family("key")} AS family, unnest(subs) AS subcategory FROM cells WHERE type = 'hazard'""",
)
def family_subcategories(spark, folder):
    return taxonomy.family_subcategories(taxonomy.index_cells(b.records(spark, folder)))


@query(
    "singletons",
    f"""{_KEYED}, i AS (SELECT type, key, count(DISTINCT industry) AS reach FROM k GROUP BY ALL)
    SELECT type, CAST(count_if(reach = 1) AS BIGINT) AS singletons, count(*) AS categories FROM i GROUP BY 1""",
)
def singletons(spark, folder):
    return taxonomy.singletons(taxonomy.category_index(b.records(spark, folder)))


@query(
    "presence_matrix",
    f"""{_CELLS} SELECT c.key AS key, i.industry AS industry, CAST(count(x.key) AS INTEGER) AS present
    FROM (SELECT DISTINCT key FROM cells WHERE type = 'exposure') c CROSS JOIN (SELECT 'Brand#' || x || y || ' Works' AS industry FROM range(1, 6) a(x), range(1, 6) b(y)) i
      LEFT JOIN (SELECT * FROM cells WHERE type = 'exposure') x ON x.key = c.key AND x.industry = i.industry GROUP BY 1, 2""",
)
def presence_matrix(spark, folder):
    cells = taxonomy.index_cells(b.records(spark, folder)).filter("type = 'exposure'")
    axis = [f"Brand#{x}{y} Works" for x in range(1, 6) for y in range(1, 6)]
    return taxonomy.presence_matrix(cells, "key", "industry", axis)


# --- searches and filters -------------------------------------------------------


@query(
    "search_industries",
    f"""WITH {b._PARTS.strip()} SELECT pos, industry FROM p LEFT JOIN nation ON p_brand = 'Brand#' || n_nationkey
    WHERE regexp_matches(lower(industry || chr(10) || overview || chr(10) || coalesce('Distinct by ' || n_name, '')), 'blue|by ger')""",
)
def search_industries(spark, folder):
    """Two searches over all three searched columns."""
    rows = tables.with_differentiators(b.records(spark, folder), b.synthesis(spark, folder))
    found = search.search_industries(rows, "Blue").unionByName(search.search_industries(rows, "by GER"))
    return found.select(F.col("_pos").alias("pos"), "industry").distinct()


@query(
    "search_categories",
    f"""WITH {b.CATEGORIES} SELECT pos, type, slot FROM cats WHERE contains(lower(category || description), 'widget')
      OR list_contains(list_transform(subs, lambda s: contains(lower(s), 'widget')), true)""",
)
def search_categories(spark, folder):
    rows = tables.explode_categories(b.records(spark, folder)).withColumnRenamed("category", "name")
    return search.search_categories(rows, "Widget").select(F.col("_pos").alias("pos"), "type", "slot")


@query(
    "search_incidents",
    f"""WITH {b.INCIDENTS} SELECT pos, slot, victim FROM incs
    WHERE contains(lower(victim || coalesce("group", '') || financial_impact || downtime_and_recovery || summary || industry), 'red crew')""",
)
def search_incidents(spark, folder):
    rows = search.search_incidents(tables.explode_incidents(b.records(spark, folder)), "Red Crew")
    return rows.select(F.col("_pos").alias("pos"), "slot", "victim")


@query(
    "by_group_prefix",
    f"""WITH {b.POSTINGS} SELECT _id, victim, "group" FROM postings WHERE starts_with(lower("group"), 'group 1')""",
)
def by_group_prefix(spark, folder):
    postings = tables.normalize_postings(b.raw_postings(spark, folder))
    return search.by_group_prefix(postings, "GROUP 1").select("_id", "victim", "group")


@query(
    "incidents_by_group",
    f"""WITH {b.INCIDENTS} SELECT pos, slot, "group" FROM incs WHERE contains(lower("group"), 'bolt gang')""",
)
def incidents_by_group(spark, folder):
    rows = search.incidents_by_group(tables.explode_incidents(b.records(spark, folder)), "Bolt Gang")
    return rows.select(F.col("_pos").alias("pos"), "slot", "group")


@query(
    "by_sector",
    f"""WITH {b.POSTINGS} SELECT 'spelling' AS match, _id FROM postings WHERE sector = 'HIGH'
    UNION ALL SELECT 'key', _id FROM postings WHERE sector_key = 'high'""",
)
def by_sector(spark, folder):
    postings = tables.normalize_postings(b.raw_postings(spark, folder))
    exact = search.by_sector(postings, "HIGH").select(F.lit("spelling").alias("match"), "_id")
    loose = search.by_sector(postings, "HIGH", exact=False).select(F.lit("key").alias("match"), "_id")
    return exact.unionByName(loose)


@query(
    "latest",
    f"""WITH {b.POSTINGS} SELECT _id, victim, attackdate FROM postings ORDER BY attackdate DESC NULLS LAST, victim, _id LIMIT 15""",
)
def latest(spark, folder):
    postings = tables.normalize_postings(b.raw_postings(spark, folder))
    return search.latest(postings).select("_id", "victim", "attackdate")


@query(
    "require",
    f"""WITH {b.STATS} SELECT industry, metric, source FROM stats WHERE metric <> '' AND source <> ''""",
)
def require(spark, folder):
    rows = tables.require(tables.stats_flat(b.records(spark, folder)), "metric", "source")
    return rows.select("industry", "metric", "source")


@query(
    "union_runs",
    """SELECT 'customer' AS run, c_name AS name, c_mktsegment AS segment FROM customer
    UNION ALL SELECT 'supplier', s_name, NULL FROM supplier""",
)
def union_runs(spark, folder):
    c = b.table(spark, folder, "customer").select(
        F.lit("customer").alias("run"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")
    )
    s = b.table(spark, folder, "supplier").select(F.lit("supplier").alias("run"), F.col("s_name").alias("name"))
    return tables.union_runs(c, s)
