"""The package's inputs derived from the given tables, row by row, in Spark and in SQL.

``postings`` come from orders, nested ``records`` from part, ``questions`` from events,
``posts`` from documents, ``vectors`` from embeddings. Every derivation is a projection of
whole tables; the SQL texts state the same rows for the oracle.
"""

from __future__ import annotations

from collections.abc import Mapping
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier import rules
from dossier.operators.adjacency import Adjacency
from dossier.operators.graph import Graph, build_graph
from dossier.session import shared_dir, spread
from dossier.sources import writers


#: Rows that one task takes: a record unfolds into some thirty rows of a graph, a posting into one.
RECORDS_A_TASK, POSTINGS_A_TASK = 40_000, 300_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- raw postings from orders -------------------------------------------------


_POSTING_FIELDS = {
    "activity": """CASE WHEN label = 'NOT SPECIFIED' AND o_orderstatus = 'O' THEN ''
      WHEN o_orderstatus = 'F' THEN lower(label) ELSE label END""",
    "attackdate": "CASE WHEN place = 0 THEN 'n/a' ELSE day END",
    "claim_url": "''",
    "country": "CASE WHEN place = 24 THEN '' ELSE concat('NATION_', place) END",
    "data_size": "concat(floor(o_totalprice), ' GB')",
    "description": "CAST(NULL AS STRING)",
    "discovered": "left(day, 10)",
    "domain": "concat('c', o_custkey, '.example.com')",
    "group": """CASE WHEN o_orderstatus = 'O' AND label = 'LOW' THEN ''
      WHEN o_orderstatus = 'F' THEN concat(band, ' ') ELSE band END""",
    "press": "CASE WHEN o_orderstatus = 'F' THEN 'y' ELSE '' END",
    "ransom": "CASE WHEN label = 'URGENT' THEN 'yes' ELSE '' END",
    "screenshot": "CAST(NULL AS STRING)",
    "url": "CASE WHEN o_orderstatus = 'P' THEN concat('https://feed.example.org/p/', o_orderkey) ELSE '' END",
    "victim": """CASE WHEN o_totalprice < 5000 THEN ''
      ELSE concat('Customer#', lpad(CAST(o_custkey AS STRING), 9, '0')) END""",
}


def raw_postings(spark: SparkSession, folder: str) -> DataFrame:
    return _postings_of(table(spark, folder, "orders"))


def _postings_of(orders: DataFrame) -> DataFrame:
    o = orders.selectExpr(
        "*",
        "substr(o_orderpriority, 3) AS label",
        "o_custkey % 25 AS place",
        "CAST(o_orderdate AS STRING) AS day",
        "concat('Group ', floor(o_totalprice / 5000)) AS band",
    )
    return o.selectExpr(*[f"{e} AS {c}" for c, e in _POSTING_FIELDS.items()], "o_orderkey AS _pos")


RAW_POSTINGS = """
raw AS (
  SELECT CASE WHEN substr(o_orderpriority, 3) = 'NOT SPECIFIED' AND o_orderstatus = 'O' THEN ''
              WHEN o_orderstatus = 'F' THEN lower(substr(o_orderpriority, 3))
              ELSE substr(o_orderpriority, 3) END AS activity,
         CASE WHEN o_custkey % 25 = 0 THEN 'n/a' ELSE CAST(o_orderdate AS VARCHAR) END AS attackdate,
         '' AS claim_url,
         CASE WHEN o_custkey % 25 = 24 THEN '' ELSE 'NATION_' || (o_custkey % 25) END AS country,
         CAST(floor(o_totalprice) AS BIGINT) || ' GB' AS data_size,
         left(CAST(o_orderdate AS VARCHAR), 10) AS discovered,
         'c' || o_custkey || '.example.com' AS "domain",
         CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '5-LOW' THEN ''
              WHEN o_orderstatus = 'F' THEN 'Group ' || CAST(floor(o_totalprice / 5000) AS BIGINT) || ' '
              ELSE 'Group ' || CAST(floor(o_totalprice / 5000) AS BIGINT) END AS "group",
         CASE WHEN o_orderstatus = 'F' THEN 'y' ELSE '' END AS press,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'yes' ELSE '' END AS ransom,
         CASE WHEN o_orderstatus = 'P' THEN 'https://feed.example.org/p/' || o_orderkey ELSE '' END AS url,
         CASE WHEN o_totalprice < 5000 THEN '' ELSE 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') END AS victim,
         o_orderkey AS pos
  FROM orders
)"""

POSTINGS = (
    RAW_POSTINGS
    + """,
postings AS (
  SELECT CASE WHEN url <> '' THEN url
              ELSE 'rw-' || left(sha1(victim || '|' || "group" || '|' || attackdate || '|' || "domain" || '|' || country), 16)
         END AS _id,
         victim, nullif(trim("group"), '') AS "group",
         lower(trim(CASE WHEN activity = '' THEN 'Unclassified' ELSE activity END)) AS sector_key,
         CASE WHEN activity = '' THEN 'Unclassified' ELSE activity END AS sector,
         nullif(trim(country), '') AS country, nullif(attackdate, '') AS attackdate,
         CASE WHEN regexp_matches(left(attackdate, 4), '^[0-9]{4}$') THEN CAST(left(attackdate, 4) AS INTEGER) END AS "year",
         discovered, "domain", data_size, press <> '' AS has_press, nullif(claim_url, '') AS claim_url, pos
  FROM raw WHERE victim <> ''
)"""
)


# --- free texts about money from orders ---------------------------------------


def impact_text() -> Column:
    whole = F.floor("o_totalprice").cast("string")
    status = F.col("o_orderstatus")
    unit = F.when(status == "F", " million").when(status == "O", "k").otherwise("")
    return (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("$"), whole, unit))
        .when(
            F.col("o_orderpriority") == "2-HIGH",
            F.concat(F.lit("Not publicly disclosed; est. $"), whole, F.lit("m")),
        )
        .when(
            F.col("o_orderpriority") == "3-MEDIUM",
            F.concat(
                F.lit("Reportedly paid US$ "),
                F.floor(F.col("o_totalprice") / 1000).cast("string"),
                F.lit(",500.5 Thousand"),
            ),
        )
        .when(
            F.col("o_orderpriority") == "5-LOW",
            F.concat(
                F.lit("Attackers demanded a ransom of $"),
                F.floor(F.col("o_totalprice") / 50000).cast("string"),
                F.lit(" billion"),
            ),
        )
        .when(status == "F", "")
        .when(status == "O", "Unknown")
    )


IMPACT = """CASE o_orderpriority
  WHEN '1-URGENT' THEN '$' || CAST(floor(o_totalprice) AS BIGINT)
       || CASE o_orderstatus WHEN 'F' THEN ' million' WHEN 'O' THEN 'k' ELSE '' END
  WHEN '2-HIGH' THEN 'Not publicly disclosed; est. $' || CAST(floor(o_totalprice) AS BIGINT) || 'm'
  WHEN '3-MEDIUM' THEN 'Reportedly paid US$ ' || CAST(floor(o_totalprice / 1000) AS BIGINT) || ',500.5 Thousand'
  WHEN '5-LOW' THEN 'Attackers demanded a ransom of $' || CAST(floor(o_totalprice / 50000) AS BIGINT) || ' billion'
  ELSE CASE o_orderstatus WHEN 'F' THEN '' WHEN 'O' THEN 'Unknown' END END"""


# --- nested industry records from part ----------------------------------------


def _category(name: str, described: str, listed: str) -> str:
    return f"named_struct('category', {name}, 'description', {described}, 'subcategories', {listed})"


def _incident(victim: str, group: str, date: str, summary: str, financial: str, ransom: str) -> str:
    return f"""named_struct('victim', {victim}, 'group', {group}, 'date', {date}, 'country', country,
      'incident_type', 'ransomware', 'ingest_source', CAST(NULL AS STRING), 'summary', {summary},
      'financial_impact', {financial}, 'ransom_demanded_or_paid', {ransom},
      'downtime_and_recovery', downtime, 'data_impact', data_impact, 'sources', cited)"""


def _present(*items: str) -> str:
    return f"filter(array({', '.join(items)}), x -> x IS NOT NULL)"


_RECORD_PARTS = {
    "w1": "split_part(p_name, ' ', 1)",
    "w2": "split_part(p_name, ' ', 2)",
    "subs": "split(concat(p_name, ' ', p_type), ' ')",
    "told": "concat(p_name, ' seen in ', p_type, CASE WHEN p_size > 25 THEN ' often' ELSE '' END)",
    "money": """CASE p_size % 3 WHEN 0 THEN concat('$', p_size, ' million lost') WHEN 1 THEN 'Not publicly disclosed' ELSE '' END""",
    "ransom": """CASE p_size % 4 WHEN 0 THEN concat('Gang demanded $', p_size, ',000k')
      WHEN 1 THEN concat('reportedly paid $', p_size, 'm') WHEN 2 THEN 'unknown' END""",
    "downtime": "CASE WHEN p_size > 20 THEN concat(p_size, ' days') ELSE 'undisclosed' END",
    "data_impact": "CASE WHEN p_size > 30 THEN concat('third-party data of ', p_name) ELSE '' END",
}

_RECORD_FIELDS = {
    "ransomware_live_sector": """CASE p_type WHEN 'ECONOMY' THEN 'Urgent' WHEN 'MEDIUM' THEN ' high' WHEN 'PROMO' THEN 'medium'
      WHEN 'STANDARD' THEN 'low' WHEN 'LARGE' THEN 'Not-Specified' ELSE '' END""",
    "overview": "CASE WHEN p_size < 5 THEN '' ELSE concat(p_name, ' made by ', p_brand) END",
    "hazard_categories": _present(
        _category("concat('Third-Party / ', w2, ' Risk')", "told", "subs"),
        _category("concat(p_type, ' & ', w1, ' Exposure')", "told", "slice(subs, 1, 1)"),
        _category("concat('Insider ', w1, ' ', w2)", "concat('By ', p_brand)", "subs"),
        _category("'Initial Access Vector'", "told", "slice(subs, 2, 2)"),
        "CASE WHEN p_size > 10 THEN "
        + _category("concat('Network ', p_size, ' outage')", "told", "subs")
        + " END",
    ),
    "exposure_categories": _present(
        _category("concat(w1, ' ', w2, ' ', p_size, ' records')", "told", "subs"),
        _category("concat(p_type, ' systems')", "told", "subs"),
        "CASE WHEN p_size <= 30 THEN "
        + _category("concat(p_brand, ' ', w2, ' vaults')", "told", "subs")
        + " END",
    ),
    "example_incidents": _present(
        _incident(
            "concat('Customer#', lpad(CAST(p_partkey AS STRING), 9, '0'))",
            "concat(w1, ' crew ', p_size, '; ', w2, ' gang (aka ', p_type, ')')",
            "concat('2023-', lpad(CAST(p_size AS STRING), 2, '0'))",
            "concat('A supply chain case of ', p_name)",
            "money",
            "ransom",
        ),
        "CASE WHEN p_size > 25 THEN "
        + _incident(
            "concat(w1, ' ', w2, ' Group (unit ', p_size, ')')",
            "concat(w2, ' gang and ', p_type)",
            "'2022'",
            "'A second case'",
            "ransom",
            "money",
        )
        + " END",
        "CASE WHEN p_size > 40 THEN "
        + _incident("''", "CAST(NULL AS STRING)", "CAST(NULL AS STRING)", "''", "''", "CAST(NULL AS STRING)")
        + " END",
    ),
    "aggregate_stats": _present(
        """named_struct('metric', concat('Loss per ', w2), 'value', concat('$', p_size, 'm'),
          'source', CASE WHEN p_size % 4 = 0 THEN '' ELSE 'Survey' END, 'source_url', concat('https://stats.example.org/', p_size))""",
        """CASE WHEN p_size > 35 THEN named_struct('metric', '', 'value', 'n/a', 'source', '', 'source_url', CAST(NULL AS STRING)) END""",
    ),
}


def records(spark: SparkSession, folder: str, canonical: bool = True) -> DataFrame:
    """One research record per part; parts of a brand are runs about one industry."""
    country = "concat('United ', w2, ' (north)')"
    cited = """array(concat('https://www.', w1, '.example.com/', p_partkey), concat('www.', w2, '.example'),
      concat('HTTP://news.', w2, '.example.org/x'))"""
    note = "CASE WHEN p_size > 25 THEN concat('  (Ransomware.live sector tag: ', p_type, ')') ELSE '' END"
    name = "concat(p_brand, ' Works')" if canonical else f"concat(p_brand, ' Works', {note})"
    parts = spread(table(spark, folder, "part"), RECORDS_A_TASK).selectExpr(
        "*", *[f"{e} AS {c}" for c, e in _RECORD_PARTS.items()]
    )
    parts = parts.selectExpr("*", f"{country} AS country", f"{cited} AS cited")
    return parts.selectExpr(
        f"{name} AS industry",
        *[f"{e} AS {c}" for c, e in _RECORD_FIELDS.items()],
        "p_partkey AS _pos",
    )


_PARTS = """
p AS (
  SELECT p_partkey AS pos, p_brand || ' Works' AS industry, p_brand, p_name, p_type, p_size,
         split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2,
         CASE p_type WHEN 'ECONOMY' THEN 'Urgent' WHEN 'MEDIUM' THEN ' high' WHEN 'PROMO' THEN 'medium'
                     WHEN 'STANDARD' THEN 'low' WHEN 'LARGE' THEN 'Not-Specified' ELSE '' END AS tag,
         CASE WHEN p_size < 5 THEN '' ELSE p_name || ' made by ' || p_brand END AS overview,
         p_name || ' seen in ' || p_type || CASE WHEN p_size > 25 THEN ' often' ELSE '' END AS told,
         string_split(p_name || ' ' || p_type, ' ') AS subs
  FROM part
)"""

CATEGORIES = (
    _PARTS
    + """,
cats AS (
  SELECT pos, industry, 'hazard' AS type, 0 AS slot, 'Third-Party / ' || w2 || ' Risk' AS category, told AS description, subs FROM p
  UNION ALL SELECT pos, industry, 'hazard', 1, p_type || ' & ' || w1 || ' Exposure', told, subs[1:1] FROM p
  UNION ALL SELECT pos, industry, 'hazard', 2, 'Insider ' || w1 || ' ' || w2, 'By ' || p_brand, subs FROM p
  UNION ALL SELECT pos, industry, 'hazard', 3, 'Initial Access Vector', told, subs[2:3] FROM p
  UNION ALL SELECT pos, industry, 'hazard', 4, 'Network ' || p_size || ' outage', told, subs FROM p WHERE p_size > 10
  UNION ALL SELECT pos, industry, 'exposure', 0, w1 || ' ' || w2 || ' ' || p_size || ' records', told, subs FROM p
  UNION ALL SELECT pos, industry, 'exposure', 1, p_type || ' systems', told, subs FROM p
  UNION ALL SELECT pos, industry, 'exposure', 2, p_brand || ' ' || w2 || ' vaults', told, subs FROM p WHERE p_size <= 30
)"""
)

INCIDENTS = (
    _PARTS
    + """,
m AS (
  SELECT *,
    CASE p_size % 3 WHEN 0 THEN '$' || p_size || ' million lost' WHEN 1 THEN 'Not publicly disclosed' ELSE '' END AS money,
    CASE p_size % 4 WHEN 0 THEN 'Gang demanded $' || p_size || ',000k' WHEN 1 THEN 'reportedly paid $' || p_size || 'm'
                    WHEN 2 THEN 'unknown' END AS ransom,
    'United ' || w2 || ' (north)' AS country,
    CASE WHEN p_size > 20 THEN p_size || ' days' ELSE 'undisclosed' END AS downtime_and_recovery,
    CASE WHEN p_size > 30 THEN 'third-party data of ' || p_name ELSE '' END AS data_impact,
    ['https://www.' || w1 || '.example.com/' || pos, 'www.' || w2 || '.example', 'HTTP://news.' || w2 || '.example.org/x'] AS sources
  FROM p
),
incs AS (
  SELECT pos, industry, 0 AS slot, 'Customer#' || lpad(CAST(pos AS VARCHAR), 9, '0') AS victim,
         w1 || ' crew ' || p_size || '; ' || w2 || ' gang (aka ' || p_type || ')' AS "group",
         '2023-' || lpad(CAST(p_size AS VARCHAR), 2, '0') AS "date", country,
         'A supply chain case of ' || p_name AS summary, money AS financial_impact, ransom AS ransom_demanded_or_paid,
         downtime_and_recovery, data_impact, sources, w1, w2, p_type, p_size
  FROM m
  UNION ALL
  SELECT pos, industry, 1, w1 || ' ' || w2 || ' Group (unit ' || p_size || ')', w2 || ' gang and ' || p_type, '2022', country,
         'A second case', ransom, money, downtime_and_recovery, data_impact, sources, w1, w2, p_type, p_size
  FROM m WHERE p_size > 25
  UNION ALL
  SELECT pos, industry, 2, '', NULL, NULL, country, '', '', NULL, downtime_and_recovery, data_impact, sources, w1, w2, p_type, p_size
  FROM m WHERE p_size > 40
)"""
)

STATS = (
    _PARTS
    + """,
stats AS (
  SELECT pos, industry, 0 AS slot, 'Loss per ' || w2 AS metric, '$' || p_size || 'm' AS value,
         CASE WHEN p_size % 4 = 0 THEN '' ELSE 'Survey' END AS source, 'https://stats.example.org/' || p_size AS source_url FROM p
  UNION ALL SELECT pos, industry, 1, '', 'n/a', '', NULL FROM p WHERE p_size > 35
)"""
)


def synthesis(spark: SparkSession, folder: str) -> DataFrame:
    """One synthesis row per nation: themes, losses and differentiators of the brands of its number."""
    n = table(spark, folder, "nation")
    number = F.col("n_nationkey").cast("string")
    lit, cat = F.lit, F.concat
    return n.select(
        F.array(cat(lit("Theme "), "n_name"), cat(lit("Shared/Theme "), F.col("n_regionkey").cast("string"))).alias(
            "common_hazard_themes"
        ),
        F.array(cat(lit("Exposed "), "n_name")).alias("common_exposure_themes"),
        F.array(
            F.struct(
                cat(lit("Global loss "), number).alias("metric"),
                cat(lit("$"), number, lit("bn")).alias("value"),
                lit("Report").alias("source"),
                lit(None).cast("string").alias("source_url"),
            )
        ).alias("global_aggregate_losses"),
        F.array(
            F.struct(
                cat(lit("brand#"), number, lit(" works")).alias("industry"),
                cat(lit("Distinct by "), "n_name").alias("what_makes_it_distinct"),
                lit(None).cast("string").alias("primary_extortion_leverage"),
                cat(number, lit(" hours")).alias("downtime_tolerance"),
            )
        ).alias("industry_differentiators"),
    )


def graph(spark: SparkSession, folder: str) -> Graph:
    """The property graph of the records with the postings as its bulk layer."""
    postings = _postings_of(spread(table(spark, folder, "orders"), POSTINGS_A_TASK))
    return build_graph(records(spark, folder), synthesis(spark, folder), postings)


_STORED: dict[tuple[str, str], Adjacency] = {}


def adjacency(spark: SparkSession, folder: str) -> Adjacency:
    """The adjacency table of the graph, written to the shared folder when a session first asks for it."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _STORED:
        _STORED[key] = writers.write_adjacency(graph(spark, folder), f"{shared_dir(spark)}/adjacency-{uuid4().hex}")
    return _STORED[key]


# --- questions, posts, vectors -------------------------------------------------


def questions(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    user = F.col("user_id").cast("string")
    kind = lambda k: F.col("event_type") == k
    asked = (
        F.when(kind("view"), F.concat(F.lit("How many victims did GROUP "), user, F.lit(" hit?")))
        .when(kind("click"), F.lit("What is exposed in Healthcare but not in energy?"))
        .when(kind("error"), F.concat(F.lit("Total cases by year in Finance, user "), user))
        .when(kind("signup"), F.concat(F.lit("Why is retail a target for xgroup "), user, F.lit("?")))
        .otherwise(F.concat(F.lit("The Black Cat and group "), user, F.lit(" in education")))
    )
    return e.select(F.col("event_id").alias("question_id"), asked.alias("question"))


QUESTIONS = """
questions AS (
  SELECT event_id AS question_id, CASE event_type
    WHEN 'view' THEN 'How many victims did GROUP ' || user_id || ' hit?'
    WHEN 'click' THEN 'What is exposed in Healthcare but not in energy?'
    WHEN 'error' THEN 'Total cases by year in Finance, user ' || user_id
    WHEN 'signup' THEN 'Why is retail a target for xgroup ' || user_id || '?'
    ELSE 'The Black Cat and group ' || user_id || ' in education' END AS question
  FROM events
)"""

VECTOR_TYPES = {0: "Incident", 1: "Industry", 2: "Hazard", 3: "Exposure", 4: "Subcategory"}


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings under five node types and an unlisted one; neighbouring ids share a text."""
    e = table(spark, folder, "embeddings")
    kind = F.lit("Other")
    for number, name in VECTOR_TYPES.items():
        kind = F.when(F.col("label") == number, name).otherwise(kind)
    text = F.concat(F.lit("note "), F.floor(F.col("vec_id") / 40).cast("string"))
    return e.select(kind.alias("label"), F.col("vec_id").alias("id"), text.alias("text"), "embedding")


def query_vector(spark: SparkSession, folder: str) -> list[float]:
    """The vector of one row, as a caller's encoder would pass it."""
    return table(spark, folder, "embeddings").filter("vec_id = 0").select("embedding").first()[0]


VECTORS = """
q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 0),
vectors AS (
  SELECT CASE label WHEN 0 THEN 'Incident' WHEN 1 THEN 'Industry' WHEN 2 THEN 'Hazard' WHEN 3 THEN 'Exposure'
                    WHEN 4 THEN 'Subcategory' ELSE 'Other' END AS label,
         vec_id AS id, 'note ' || CAST(floor(vec_id / 40) AS BIGINT) AS text,
         list_dot_product(CAST(embedding AS DOUBLE[]), CAST(qv AS DOUBLE[])) AS score
  FROM embeddings, q
)"""


# --- SQL forms of the key functions ---------------------------------------------


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_strip(e: str) -> str:
    return f"trim({e}, {quoted(rules.WHITESPACE)})"


def sql_raw_key(e: str) -> str:
    e = f"replace(lower(coalesce({e}, '')), '&', ' and ')"
    e = f"regexp_replace({e}, '[/\\-–—_]+', ' ', 'g')"
    e = f"regexp_replace({e}, '[^a-z0-9 ]+', '', 'g')"
    return f"trim(regexp_replace({e}, ' +', ' ', 'g'))"


def sql_alias(key: str, aliases: Mapping[str, str] = rules.CATEGORY_ALIASES) -> str:
    whens = " ".join(f"WHEN {quoted(a)} THEN {quoted(t)}" for a, t in aliases.items())
    return f"CASE {key} {whens} ELSE {key} END"


def sql_norm_key(e: str) -> str:
    return sql_alias(sql_raw_key(e))


def sql_family(key: str) -> str:
    whens = " ".join(
        f"WHEN regexp_matches({key}, {quoted(p)}) THEN {quoted(n)}" for n, p in rules.CATEGORY_FAMILIES
    )
    return f"CASE {whens} ELSE {quoted(rules.DEFAULT_FAMILY)} END"


def sql_slug(e: str) -> str:
    e = f"regexp_replace(lower(coalesce({e}, '')), '[^a-z0-9]+', '-', 'g')"
    return f"left(regexp_replace({e}, '^-|-$', '', 'g'), 80)"


def sql_label(key: str) -> str:
    words = (
        f"list_transform(string_split({key}, ' '), lambda w: CASE WHEN w IN "
        f"({', '.join(map(quoted, rules.LABEL_ACRONYMS))}) THEN upper(w) WHEN w IN "
        f"({', '.join(map(quoted, rules.LABEL_SMALL_WORDS))}) THEN w "
        "ELSE upper(left(w, 1)) || substr(w, 2) END)"
    )
    return f"array_to_string({words}, ' ')"


def sql_matches(e: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({e}, {quoted(pattern)}), false)"


def sql_usd(e: str) -> str:
    amount = f"regexp_extract({e}, {quoted(rules.USD_AMOUNT)}, 1)"
    unit = f"lower(regexp_extract({e}, {quoted(rules.USD_AMOUNT)}, 2))"
    value = (
        f"TRY_CAST(replace({amount}, ',', '') AS DOUBLE) * CASE left({unit}, 1) WHEN 'b' THEN 1e9 "
        f"WHEN 'm' THEN 1e6 WHEN 'k' THEN 1e3 WHEN 't' THEN 1e3 ELSE 1.0 END"
    )
    return (
        f"CASE WHEN NOT {sql_matches(e, rules.NEGATED_DISCLOSURE)} AND ({value}) <= 5e9 THEN {value} END"
    )


def sql_disclosed(e: str) -> str:
    return f"({sql_strip(f'coalesce({e}, chr(32))')} <> '' AND NOT {sql_matches(e, rules.NEGATED_DISCLOSURE)})"


def sql_groups(e: str) -> str:
    parts = f"string_split_regex(coalesce({e}, ''), '[;,/]|\\band\\b')"
    names = f"list_transform({parts}, lambda g: trim(regexp_replace(g, '\\(.*?\\)', '', 'g')))"
    return f"list_filter({names}, lambda g: g <> '' AND length(g) <= 60)"


def sql_company(e: str) -> str:
    words = f"regexp_replace(lower(coalesce({e}, '')), {quoted(rules.COMPANY_SUFFIX)}, ' ', 'g')"
    return f"trim(regexp_replace({words}, '[^a-z0-9]+', ' ', 'g'))"


def sql_url(e: str) -> str:
    return f"regexp_matches({e}, '(?i)^https?:')"


# --- SQL forms of the graph -------------------------------------------------------

GRAPH = (
    INCIDENTS
    + CATEGORIES[len(_PARTS):]
    + STATS[len(_PARTS):]
    + ","
    + RAW_POSTINGS
    + f""",
keyed AS (SELECT *, {sql_norm_key("category")} AS key FROM cats),
named AS (SELECT *, industry || '::' || victim AS id FROM incs WHERE victim <> ''),
edges AS (
  SELECT DISTINCT * FROM (
    SELECT industry AS "from", 'Industry' AS from_label, CASE type WHEN 'hazard' THEN 'FACES' ELSE 'EXPOSES' END AS type,
           key AS "to", CASE type WHEN 'hazard' THEN 'Hazard' ELSE 'Exposure' END AS to_label FROM keyed WHERE key <> ''
    UNION ALL
    SELECT key, CASE type WHEN 'hazard' THEN 'Hazard' ELSE 'Exposure' END, 'INCLUDES', key || '::' || {sql_norm_key("s")}, 'Subcategory'
    FROM (SELECT key, type, unnest(subs) AS s FROM keyed WHERE key <> '')
    UNION ALL SELECT industry, 'Industry', 'HAD_INCIDENT', id, 'Incident' FROM named
    UNION ALL SELECT id, 'Incident', 'HIT', victim, 'Company' FROM named
    UNION ALL SELECT id, 'Incident', 'OCCURRED_IN', trim(regexp_replace(country, '\\(.*?\\)', '', 'g')), 'Country' FROM named
    UNION ALL SELECT id, 'Incident', 'PERPETRATED_BY', g, 'Group' FROM (SELECT id, unnest({sql_groups('"group"')}) AS g FROM named)
    UNION ALL SELECT id, 'Incident', 'CITED_BY', u, 'Source' FROM (SELECT id, unnest(sources) AS u FROM named) WHERE {sql_url("u")}
    UNION ALL SELECT industry, 'Industry', 'MEASURED_BY', industry || '::' || {sql_norm_key("metric")}, 'Statistic' FROM stats WHERE metric <> ''
    UNION ALL SELECT victim || '::' || activity, 'Victim', 'ATTACKED_BY', "group", 'Group' FROM raw
              WHERE trim(victim) <> '' AND trim("group") <> ''
  )
),
cat_nodes AS (
  SELECT type, key AS id, arg_max(category, row(pos, slot)) AS name, arg_max(left(description, 800), row(pos, slot)) AS description
  FROM keyed WHERE key <> '' GROUP BY type, key
),
sub_rows AS (
  SELECT key, type, category, pos, slot, unnest(subs) AS s, generate_subscripts(subs, 1) AS sub_slot FROM keyed WHERE key <> ''
),
sub_nodes AS (
  SELECT key || '::' || {sql_norm_key("s")} AS id, arg_max(s, row(pos, type = 'exposure', slot, sub_slot)) AS name,
         arg_max(category, row(pos, type = 'exposure', slot, sub_slot)) AS parent,
         arg_max(CASE type WHEN 'hazard' THEN 'hazard' ELSE 'exposure' END, row(pos, type = 'exposure', slot, sub_slot)) AS kind
  FROM sub_rows GROUP BY 1
),
inc_nodes AS (
  SELECT id, arg_max(victim, row(pos, slot)) AS victim, arg_max(coalesce("date", ''), row(pos, slot)) AS "date",
         arg_max(coalesce(country, ''), row(pos, slot)) AS country,
         arg_max(left(coalesce(financial_impact, ''), 600), row(pos, slot)) AS financial_impact,
         arg_max(left(coalesce(ransom_demanded_or_paid, ''), 400), row(pos, slot)) AS ransom,
         arg_max(left(coalesce(downtime_and_recovery, ''), 600), row(pos, slot)) AS downtime,
         arg_max(left(coalesce(data_impact, ''), 400), row(pos, slot)) AS data_impact,
         arg_max(left(coalesce(summary, ''), 900), row(pos, slot)) AS summary,
         arg_max(len(sources), row(pos, slot)) AS source_count
  FROM named GROUP BY id
)"""
)
