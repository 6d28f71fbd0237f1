"""Validation rules, new-record intake and name matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier import rules
from dossier.operators import insights as ins
from dossier.operators import intake, matching, quality, tables
from dossier.plans.catalog import bindings as b
from dossier.plans.catalog.registry import query

# --- rules --------------------------------------------------------------------


@query(
    "check_overview",
    f"""WITH {b._PARTS.strip()} SELECT 'overview' AS rule, industry AS key, 'missing overview' AS message FROM p WHERE overview = ''""",
)
def check_overview(spark, folder):
    return quality.check_overview(b.records(spark, folder))


@query(
    "check_sizes",
    f"""WITH {b.CATEGORIES}{b.INCIDENTS[len(b._PARTS):]},
      n AS (SELECT pos, industry, (SELECT count(*) FROM cats c WHERE c.pos = p.pos AND type = 'hazard') AS h,
        (SELECT count(*) FROM cats c WHERE c.pos = p.pos AND type = 'exposure') AS e, (SELECT count(*) FROM incs i WHERE i.pos = p.pos) AS i FROM p)
    SELECT 'hazards' AS rule, industry AS key, 'only ' || h || ' hazard categories' AS message FROM n WHERE h < 5
    UNION ALL SELECT 'exposures', industry, 'only ' || e || ' exposure categories' FROM n WHERE e < 3
    UNION ALL SELECT 'incidents', industry, 'only ' || i || ' incidents' FROM n WHERE i < 2""",
)
def check_sizes(spark, folder):
    return quality.check_sizes(b.records(spark, folder), hazards=5, exposures=3, incidents=2)


@query(
    "check_incidents",
    f"""WITH {b.INCIDENTS} SELECT 'victim' AS rule, industry AS key, 'incident with no victim name' AS message FROM incs WHERE victim = ''""",
)
def check_incidents(spark, folder):
    return quality.check_incidents(b.records(spark, folder))


@query(
    "check_source_urls",
    f"""WITH {b.INCIDENTS}, u AS (SELECT industry, victim, unnest(sources) AS url FROM incs)
    SELECT 'source_url' AS rule, industry AS key, '"' || victim || '" has a non-URL source: ' || left(url, 60) AS message FROM u
    WHERE NOT regexp_matches(url, '(?i)^https?://')""",
)
def check_source_urls(spark, folder):
    return quality.check_source_urls(b.records(spark, folder))


@query(
    "check_stats",
    f"""WITH {b.STATS} SELECT 'stat_source' AS rule, industry AS key, 'stat "' || metric || '" has no source attribution' AS message
    FROM stats WHERE source = ''""",
)
def check_stats(spark, folder):
    return quality.check_stats(b.records(spark, folder))


@query(
    "validate",
    f"""WITH {b.INCIDENTS}{b.STATS[len(b._PARTS):]}, u AS (SELECT unnest(sources) AS url FROM incs), f AS (
      SELECT 'overview' AS rule FROM p WHERE overview = '' UNION ALL SELECT 'exposures' FROM p
      UNION ALL SELECT 'incidents' FROM p UNION ALL SELECT 'victim' FROM incs WHERE victim = ''
      UNION ALL SELECT 'source_url' FROM u WHERE NOT regexp_matches(url, '(?i)^https?://')
      UNION ALL SELECT 'stat_source' FROM stats WHERE source = '')
    SELECT rule, count(*) AS n FROM f GROUP BY 1""",
)
def validate(spark, folder):
    """All rules with their standard limits, counted; every record has fewer than 4 exposures."""
    return quality.validate(b.records(spark, folder)).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def _report_rows() -> str:
    stated = lambda c: f"(coalesce({c}, '') <> '' AND NOT {b.sql_matches(c, rules.NOT_DISCLOSED_ANYWHERE)})"
    tests = {
        "with a cited source": "len(sources) > 0",
        "with a financial figure": stated("financial_impact"),
        "with a ransom figure": stated("ransom_demanded_or_paid"),
        "with downtime/recovery": stated("downtime_and_recovery"),
    }
    return " UNION ALL ".join(
        f"SELECT {i} AS slot, '{label}' AS field, CAST(count_if({test}) AS BIGINT) AS disclosed, count(*) AS total FROM incs"
        for i, (label, test) in enumerate(tests.items())
    )


@query(
    "coverage_report",
    f"""WITH {b.INCIDENTS}, c AS ({_report_rows()}) SELECT CAST(slot AS INTEGER) AS slot, field, disclosed, total - disclosed AS undisclosed, total,
      CAST(round(disclosed / total * 100) AS INTEGER) AS pct FROM c""",
)
def coverage_report(spark, folder):
    return quality.coverage_report(b.records(spark, folder))


@query(
    "check_ids",
    f"""WITH {b.POSTINGS}{b.INCIDENTS.replace(b._PARTS, "," + b._PARTS)},
      i AS (SELECT {b.sql_slug("industry")} || '--' || {b.sql_slug("victim")} AS _id FROM incs WHERE victim <> '')
    SELECT 'victims' AS "table", count(*) AS documents, CAST(0 AS BIGINT) AS missing_id, count(*) - count(DISTINCT _id) AS repeated_id FROM postings
    UNION ALL SELECT 'incidents', count(*), 0, count(*) - count(DISTINCT _id) FROM i
    UNION ALL SELECT 'labels', (SELECT count(*) FROM documents), count(*) FILTER (WHERE l.doc_id IS NULL), 0 FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def check_ids(spark, folder):
    """Ids of postings and incidents, and labels as ids of documents: unlabelled ones have none."""
    d, labels = b.table(spark, folder, "documents"), b.table(spark, folder, "labels")
    labelled = d.join(labels.select("doc_id", F.col("doc_id").alias("_id")), "doc_id", "left").select("_id")
    tables_by_name = {
        "victims": tables.normalize_postings(b.raw_postings(spark, folder)),
        "incidents": tables.incidents_table(b.records(spark, folder)),
        "labels": labelled,
    }
    return quality.check_ids(tables_by_name)


@query(
    "cross_check",
    """WITH a AS (SELECT source, count(*) AS n FROM documents GROUP BY 1),
      c AS (SELECT source, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY 1)
    SELECT source, coalesce(a.n, 0) AS left_n, coalesce(c.n, 0) AS right_n, coalesce(a.n, 0) - coalesce(c.n, 0) AS diff FROM a FULL JOIN c USING (source)""",
)
def cross_check(spark, folder):
    """Documents per source against documents labelled good per source."""
    d, labels = b.table(spark, folder, "documents"), b.table(spark, folder, "labels")
    good = d.join(labels.filter("quality = 1"), "doc_id")
    return quality.cross_check(ins.count_by(d, "source"), ins.count_by(good, "source"), "source")


# --- intake -------------------------------------------------------------------


def _extracted(spark, folder):
    """Extracted records from lineitem: one per line, victims repeat over lines."""
    rows = b.table(spark, folder, "lineitem").selectExpr(
        "l_orderkey * 8 + l_linenumber AS _pos",
        """CASE l_returnflag WHEN 'A' THEN 'ransomware' WHEN 'R' THEN 'other-cyber' ELSE
             CASE WHEN l_linestatus = 'F' THEN 'data-extortion' END END AS incident_type""",
        """CASE WHEN l_quantity < 3 THEN 'UNKNOWN' WHEN l_quantity > 49 THEN 'No Such Works'
             ELSE concat('Brand#', l_suppkey % 25, ' Works') END AS industry""",
        """CASE WHEN l_linenumber = 7 THEN ' N/A ' WHEN l_linenumber = 6 THEN concat('customer#', lpad(CAST(l_partkey AS STRING), 9, '0'))
             ELSE concat('Firm ', l_partkey, CASE WHEN l_linenumber = 5 THEN ' Holdings, Inc.' ELSE '' END) END AS victim""",
        "CASE WHEN l_linestatus = 'F' THEN 'Unknown' ELSE concat('Crew ', l_suppkey) END AS `group`",
    )
    return rows


_EXTRACTED = """x AS (SELECT l_orderkey * 8 + l_linenumber AS pos,
    CASE l_returnflag WHEN 'A' THEN 'ransomware' WHEN 'R' THEN 'other-cyber' ELSE CASE WHEN l_linestatus = 'F' THEN 'data-extortion' END END AS incident_type,
    CASE WHEN l_quantity < 3 THEN 'UNKNOWN' WHEN l_quantity > 49 THEN 'No Such Works' ELSE 'Brand#' || (l_suppkey % 25) || ' Works' END AS industry,
    CASE WHEN l_linenumber = 7 THEN ' N/A ' WHEN l_linenumber = 6 THEN 'customer#' || lpad(CAST(l_partkey AS VARCHAR), 9, '0')
      ELSE 'Firm ' || l_partkey || CASE WHEN l_linenumber = 5 THEN ' Holdings, Inc.' ELSE '' END END AS victim,
    CASE WHEN l_linestatus = 'F' THEN 'Unknown' ELSE 'Crew ' || l_suppkey END AS "group" FROM lineitem)"""

_INDEX = f"""{b.RAW_POSTINGS}, idx AS (SELECT {b.sql_company("victim")} AS company_key, arg_min("group", pos) AS posted_group
    FROM raw WHERE {b.sql_company("victim")} <> '' AND "group" <> '' GROUP BY 1)"""


@query("attacker_index", f"WITH {_INDEX} SELECT company_key, posted_group FROM idx")
def attacker_index(spark, folder):
    return intake.attacker_index(b.raw_postings(spark, folder))


_ENRICHED = f"""{_EXTRACTED}, {_INDEX}, en AS (SELECT x.pos AS pos, industry, victim, {b.sql_company("victim")} AS company_key,
      lower(trim(coalesce("group", ''))) IN ('not publicly disclosed', 'unknown', 'n/a', '') AND posted_group IS NOT NULL AS enriched,
      incident_type AS t, "group" AS g, posted_group FROM x LEFT JOIN idx ON {b.sql_company("victim")} = idx.company_key),
    e AS (SELECT pos, industry, victim, company_key, enriched, CASE WHEN enriched THEN posted_group ELSE g END AS "group",
      CASE WHEN enriched AND t = 'other-cyber' THEN 'ransomware' ELSE t END AS incident_type FROM en)"""


@query("enrich_attacker", f"""WITH {_ENRICHED} SELECT pos, "group", incident_type, enriched FROM e""")
def enrich_attacker(spark, folder):
    index = intake.attacker_index(b.raw_postings(spark, folder))
    rows = intake.enrich_attacker(_extracted(spark, folder), index)
    return rows.select(F.col("_pos").alias("pos"), "group", "incident_type", "enriched")


_GATE = f"""CASE WHEN coalesce(incident_type, 'unclassified') NOT IN ('ransomware', 'data-extortion') THEN 'skip:' || coalesce(incident_type, 'unclassified')
    WHEN coalesce(industry, '') IN ('', 'UNKNOWN') THEN 'skip:industry-unknown'
    WHEN trim(victim) = '' OR regexp_matches(trim(victim), {b.quoted(rules.PLACEHOLDER_VICTIM)}) THEN 'skip:no-victim'"""


@query("accept_status", f"WITH {_EXTRACTED} SELECT pos, {_GATE} ELSE 'added' END AS status FROM x")
def accept_status(spark, folder):
    rows = intake.accept_status(_extracted(spark, folder))
    return rows.select(F.col("_pos").alias("pos"), "status")


_STATUS = f"""WITH {b.INCIDENTS}, {_ENRICHED},
    k AS (SELECT *, lower(trim(victim)) AS v, CASE WHEN company_key <> '' THEN 'k:' || company_key ELSE 'v:' || lower(trim(victim)) END AS org FROM e),
    s0 AS (SELECT *, {_GATE} WHEN industry NOT IN (SELECT industry FROM p) THEN 'skip:no-such-industry:' || industry
        WHEN v IN (SELECT lower(trim(victim)) FROM incs) THEN 'skip:duplicate' ELSE 'added' END AS own FROM k),
    f AS (SELECT org, min(pos) AS first_pos FROM s0 WHERE own = 'added' GROUP BY 1),
    st AS (SELECT s0.*, CASE WHEN pos > first_pos AND company_key <> '' THEN 'skip:duplicate-in-batch'
        WHEN pos > first_pos AND own = 'added' THEN 'skip:duplicate' ELSE own END AS status FROM s0 LEFT JOIN f USING (org))"""


def _statuses(spark, folder):
    records = b.records(spark, folder)
    index = intake.attacker_index(b.raw_postings(spark, folder))
    enriched = intake.enrich_attacker(_extracted(spark, folder), index)
    return intake.intake_status(enriched, records, tables.explode_incidents(records))


@query("intake_status", f"{_STATUS} SELECT pos, status FROM st")
def intake_status(spark, folder):
    return _statuses(spark, folder).select(F.col("_pos").alias("pos"), "status")


@query("status_counts", f"{_STATUS} SELECT split_part(status, ':', 1) AS status, count(*) AS n FROM st GROUP BY 1")
def status_counts(spark, folder):
    return intake.status_counts(_statuses(spark, folder))


@query(
    "first_accepted",
    f"""WITH {_EXTRACTED}, a AS (SELECT *, {b.sql_company("victim")} AS company_key, {_GATE} ELSE 'added' END AS status FROM x)
    SELECT company_key, min(pos) AS pos FROM a WHERE status = 'added' AND company_key <> '' GROUP BY 1""",
)
def first_accepted(spark, folder):
    accepted = intake.accept_status(_extracted(spark, folder)).filter("status = 'added'")
    return intake.first_accepted(accepted).select("company_key", F.col("_pos").alias("pos"))


@query(
    "new_only",
    f"""WITH {b.INCIDENTS}, {_EXTRACTED} SELECT pos, victim FROM x WHERE lower(trim(victim)) NOT IN (SELECT lower(trim(victim)) FROM incs)""",
)
def new_only(spark, folder):
    existing = tables.explode_incidents(b.records(spark, folder))
    rows = intake.new_only(_extracted(spark, folder), existing)
    return rows.select(F.col("_pos").alias("pos"), "victim")


@query(
    "known_industry",
    f"""WITH {b._PARTS.strip()}, {_EXTRACTED} SELECT pos, x.industry AS industry FROM x WHERE x.industry IN (SELECT industry FROM p)""",
)
def known_industry(spark, folder):
    rows = intake.known_industry(_extracted(spark, folder), b.records(spark, folder))
    return rows.select(F.col("_pos").alias("pos"), "industry")


@query(
    "to_incidents",
    f"""{_STATUS} SELECT industry, victim, "group", incident_type, 'sec/news' AS ingest_source FROM st WHERE status = 'added'""",
)
def to_incidents(spark, folder):
    added = _statuses(spark, folder).filter("status = 'added'")
    absent = ["date", "country", "summary", "financial_impact", "ransom_demanded_or_paid",
              "downtime_and_recovery", "data_impact"]
    full = added.withColumns({c: F.lit(None).cast("string") for c in absent}).withColumn(
        "sources", F.array().cast("array<string>")
    )
    return intake.to_incidents(full).select("industry", "victim", "group", "incident_type", "ingest_source")


# --- names in texts -------------------------------------------------------------

_NAMES = """names AS (SELECT item_id * 1000 + i AS position, s AS name FROM (SELECT item_id, unnest(string_split(text, '. ')) AS s,
      generate_subscripts(string_split(text, '. '), 1) - 1 AS i FROM benchmark) WHERE length(s) > 0
    UNION ALL SELECT 100000000 + n_nationkey, n_name FROM nation UNION ALL SELECT 200000000, 'thth'),
  firsts AS (SELECT lower(name) AS needle, arg_min(name, position) AS name, min(position) AS position FROM names GROUP BY 1)"""


def _names(spark, folder):
    """Sentences of the benchmark items, nation names and one short name, in list order."""
    sentences = b.table(spark, folder, "benchmark").select(
        "item_id", F.posexplode(F.split("text", r"\. ")).alias("slot", "name")
    ).select((F.col("item_id") * 1000 + F.col("slot")).alias("position"), "name")
    nations = b.table(spark, folder, "nation").select(
        (F.col("n_nationkey") + 100_000_000).cast("long").alias("position"), F.col("n_name").alias("name")
    )
    short = nations.limit(1).select(F.lit(200_000_000).cast("long").alias("position"), F.lit("thth").alias("name"))
    return sentences.filter(F.length("name") > 0).unionByName(nations).unionByName(short)


@query(
    "contained_names",
    f"""WITH {_NAMES} SELECT doc_id, needle FROM documents JOIN firsts ON contains(lower(text), needle)""",
)
def contained_names(spark, folder):
    d = b.table(spark, folder, "documents")
    return matching.contained_names(d, ["doc_id"], "text", _names(spark, folder))


@query(
    "corroborate",
    f"""WITH {_NAMES} SELECT doc_id, arg_min(name, position) AS matched_victim FROM documents JOIN firsts ON contains(lower(text), needle) GROUP BY 1""",
)
def corroborate(spark, folder):
    d = b.table(spark, folder, "documents")
    names = _names(spark, folder).groupBy("name").agg(F.min("position").alias("position"))
    rows = matching.corroborate(d, names, title="text")
    return rows.select("doc_id", "matched_victim")
