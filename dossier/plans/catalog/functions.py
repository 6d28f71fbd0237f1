"""Column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier import functions as fn
from dossier import rules
from dossier.operators import insights as ins
from dossier.operators import tables
from dossier.plans.catalog import bindings as b
from dossier.plans.catalog.registry import query


@query(
    "canonical_name",
    r"""SELECT p_partkey, regexp_replace(p_brand || ' Works' || CASE WHEN p_size > 25
        THEN '  (Ransomware.live sector tag: ' || p_type || ')' ELSE '' END,
        '(?i)\s*\(ransomware\.live sector[^)]*\)', '') AS name FROM part""",
)
def canonical_name(spark, folder):
    return b.records(spark, folder, canonical=False).select(
        F.col("_pos").alias("p_partkey"), fn.canonical_name("industry").alias("name")
    )


@query(
    "richness",
    f"""WITH {b.CATEGORIES}{b.INCIDENTS[len(b._PARTS):]}{b.STATS[len(b._PARTS):]}
    SELECT pos AS p_partkey, CAST(sum(w) AS INTEGER) AS richness FROM (
      SELECT pos, CASE type WHEN 'hazard' THEN 10 ELSE 1 END AS w FROM cats
      UNION ALL SELECT pos, 100 FROM incs UNION ALL SELECT pos, 1 FROM stats) GROUP BY pos""",
)
def richness(spark, folder):
    return b.records(spark, folder).select(F.col("_pos").alias("p_partkey"), fn.richness().alias("richness"))


@query("raw_key", f"SELECT doc_id, sha1({b.sql_raw_key('text')}) AS key_sha FROM documents")
def raw_key(spark, folder):
    d = b.table(spark, folder, "documents")
    return d.select("doc_id", F.sha1(fn.raw_key("text")).alias("key_sha"))


@query(
    "norm_key",
    f"""WITH {b.CATEGORIES} SELECT pos, type, slot, {b.sql_norm_key('category')} AS key,
    {b.sql_family(b.sql_norm_key('category'))} AS family, {b.sql_label(b.sql_norm_key('category'))} AS label FROM cats""",
)
def norm_key(spark, folder):
    """Canonical key, family and display label of every reported category."""
    rows = tables.explode_categories(b.records(spark, folder)).withColumn("key", fn.norm_key("category"))
    return rows.select(
        F.col("_pos").alias("pos"),
        "type",
        "slot",
        "key",
        fn.family_of("key").alias("family"),
        fn.display_label("key").alias("label"),
    )


@query(
    "family_of",
    f"SELECT doc_id, {b.sql_family(b.sql_raw_key('text'))} AS family FROM documents",
)
def family_of(spark, folder):
    d = b.table(spark, folder, "documents")
    return d.select("doc_id", fn.family_of(fn.raw_key("text")).alias("family"))


@query("slug", f"SELECT doc_id, {b.sql_slug('text')} AS slug FROM documents")
def slug(spark, folder):
    return b.table(spark, folder, "documents").select("doc_id", fn.slug("text").alias("slug"))


@query("hash16", "SELECT c_custkey, left(sha1(c_name), 16) AS h FROM customer")
def hash16(spark, folder):
    return b.table(spark, folder, "customer").select("c_custkey", fn.hash16("c_name").alias("h"))


@query("posting_id", f"WITH {b.POSTINGS} SELECT pos, _id FROM postings")
def posting_id(spark, folder):
    raw = tables.require(b.raw_postings(spark, folder), "victim")
    return raw.select(F.col("_pos").alias("pos"), fn.posting_id().alias("_id"))


@query(
    "parse_usd",
    f"SELECT o_orderkey, {b.sql_usd('t')} AS usd FROM (SELECT o_orderkey, {b.IMPACT} AS t FROM orders)",
)
def parse_usd(spark, folder):
    o = b.table(spark, folder, "orders").select("o_orderkey", b.impact_text().alias("t"))
    return o.select("o_orderkey", fn.parse_usd("t").alias("usd"))


@query(
    "money_struct",
    f"""SELECT o_orderkey, nullif(t, '') AS text, {b.sql_usd('t')} AS usd
    FROM (SELECT o_orderkey, {b.IMPACT} AS t FROM orders)""",
)
def money_struct(spark, folder):
    o = b.table(spark, folder, "orders").select("o_orderkey", b.impact_text().alias("t"))
    return o.select("o_orderkey", fn.money_struct("t").alias("m")).select("o_orderkey", "m.*")


@query(
    "disclosure_tests",
    f"""SELECT o_orderkey, {b.sql_disclosed('t')} AS disclosed,
      ({b.sql_disclosed('t')} AND {b.sql_matches('t', rules.RANSOM_PAID)}) AS paid,
      ({b.sql_disclosed('t')} AND {b.sql_matches('t', rules.RANSOM_DEMANDED)}) AS demanded,
      {b.sql_matches('t', rules.NOT_DISCLOSED_ANYWHERE)} AS not_disclosed_any,
      {b.sql_matches('t', rules.NOT_DISCLOSED_PREFIX)} AS not_disclosed_prefix
    FROM (SELECT o_orderkey, {b.IMPACT} AS t FROM orders)""",
)
def disclosure_tests(spark, folder):
    o = b.table(spark, folder, "orders").select("o_orderkey", b.impact_text().alias("t"))
    return o.select(
        "o_orderkey",
        fn.is_disclosed("t").alias("disclosed"),
        fn.is_paid("t").alias("paid"),
        fn.is_demanded("t").alias("demanded"),
        fn.is_not_disclosed_any("t").alias("not_disclosed_any"),
        fn.is_not_disclosed_prefix("t").alias("not_disclosed_prefix"),
    )


_PLACEHOLDER = """CASE event_type WHEN 'view' THEN ' Unknown ' WHEN 'click' THEN 'N/A' WHEN 'error' THEN ''
  WHEN 'signup' THEN 'Not Publicly Disclosed' ELSE 'The Company' || CASE WHEN value > 50 THEN ' ' || user_id ELSE '' END END"""


@query(
    "placeholder_names",
    f"""SELECT event_id, lower(trim(t)) IN ('not publicly disclosed', 'unknown', 'n/a', '') AS no_group,
      (trim(t) = '' OR regexp_matches(trim(t), {b.quoted(rules.PLACEHOLDER_VICTIM)})) AS no_victim
    FROM (SELECT event_id, {_PLACEHOLDER} AS t FROM events)""",
)
def placeholder_names(spark, folder):
    kind = lambda k: F.col("event_type") == k
    unit = F.concat(F.lit(" "), F.col("user_id").cast("string"))
    text = (
        F.when(kind("view"), " Unknown ")
        .when(kind("click"), "N/A")
        .when(kind("error"), "")
        .when(kind("signup"), "Not Publicly Disclosed")
        .otherwise(F.concat(F.lit("The Company"), F.when(F.col("value") > 50, unit).otherwise("")))
    )
    e = b.table(spark, folder, "events").select("event_id", text.alias("t"))
    return e.select(
        "event_id",
        fn.is_placeholder_group("t").alias("no_group"),
        fn.is_placeholder_victim("t").alias("no_victim"),
    )


@query(
    "year_of",
    f"""WITH {b.RAW_POSTINGS} SELECT pos, CASE WHEN regexp_matches(left(attackdate, 4), '^[0-9]{{4}}$')
    THEN CAST(left(attackdate, 4) AS INTEGER) END AS "year" FROM raw""",
)
def year_of(spark, folder):
    raw = b.raw_postings(spark, folder)
    return raw.select(F.col("_pos").alias("pos"), fn.year_of("attackdate").alias("year"))


@query(
    "sector_key",
    f"""WITH {b.RAW_POSTINGS} SELECT pos, lower(trim(coalesce(nullif(activity, ''), 'Unclassified'))) AS sector_key,
      replace(replace(lower(coalesce(nullif(activity, ''), '(unclassified)')), '/', '_'), ' ', '_') AS file_slug,
      nullif(trim("group"), '') AS "group" FROM raw""",
)
def sector_key(spark, folder):
    """Sector key, file slug and blank-to-NULL group of every posting."""
    return b.raw_postings(spark, folder).select(
        F.col("_pos").alias("pos"),
        fn.sector_key("activity").alias("sector_key"),
        fn.sector_slug("activity").alias("file_slug"),
        fn.blank_to_null("group").alias("group"),
    )


_ATTACKERS = """split_part(p_name, ' ', 1) || ' crew; ' || split_part(p_name, ' ', 2) || ' gang (aka x; y) and '
  || p_type || '/' || p_brand || ', ' || repeat('long name ', p_size % 10)"""


@query(
    "split_groups",
    f"""SELECT p_partkey, array_to_string({b.sql_groups('t')}, '|') AS as_written,
      array_to_string({b.sql_groups("regexp_replace(t, '" + chr(92) + "(.*?" + chr(92) + ")', '', 'g')")}, '|') AS notes_first
    FROM (SELECT p_partkey, {_ATTACKERS} AS t FROM part)""",
)
def split_groups(spark, folder):
    t = F.expr(_ATTACKERS)
    p = b.table(spark, folder, "part").select("p_partkey", t.alias("t"))
    return p.select(
        "p_partkey",
        F.array_join(fn.split_groups("t"), "|").alias("as_written"),
        F.array_join(fn.split_groups("t", strip_first=True), "|").alias("notes_first"),
    )


@query(
    "clean_country",
    r"""SELECT s_suppkey, trim(regexp_replace(' NATION_' || s_nationkey || ' (' || s_name || ') ', '\(.*?\)', '', 'g')) AS country
    FROM supplier""",
)
def clean_country(spark, folder):
    text = F.concat(
        F.lit(" NATION_"), F.col("s_nationkey").cast("string"), F.lit(" ("), "s_name", F.lit(") ")
    )
    return b.table(spark, folder, "supplier").select("s_suppkey", fn.clean_country(text).alias("country"))


@query(
    "host_of",
    r"""SELECT page_id, regexp_replace(regexp_extract(lower(url), '^https?://([^/?#:]+)', 1), '^www\.', '') AS host,
      regexp_replace(regexp_extract(lower('https://user:pw@WWW.' || substr(url, strpos(url, '://') + 3)),
        '^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www\.', '') AS host_of_login,
      regexp_matches(url, '^https?://') AS is_url, regexp_matches(upper(url), '(?i)^https?:') AS is_url_any_case,
      regexp_matches(upper(url), '^https?:') AS is_url_same_case
    FROM pages""",
)
def host_of(spark, folder):
    """Hosts and URL tests of every page address, plain and as a login address."""
    p = b.table(spark, folder, "pages")
    login = F.concat(F.lit("https://user:pw@WWW."), F.expr("substr(url, instr(url, '://') + 3)"))
    return p.select(
        "page_id",
        fn.host_of("url").alias("host"),
        fn.host_of(login).alias("host_of_login"),
        fn.is_url("url", slashes=True).alias("is_url"),
        fn.is_url(F.upper("url")).alias("is_url_any_case"),
        fn.is_url(F.upper("url"), any_case=False).alias("is_url_same_case"),
    )


@query("clip", "SELECT doc_id, left(text, 1200) AS kept, CAST(length(left(text, 1200)) AS INTEGER) AS n FROM documents")
def clip(spark, folder):
    d = b.table(spark, folder, "documents").select("doc_id", fn.clip("text", 1200).alias("kept"))
    return d.withColumn("n", F.length("kept"))


@query(
    "short_name",
    r"""SELECT p_partkey, left(regexp_replace(regexp_replace(p_type || ' ' || p_name || ' and ' || p_brand || ', rest', ' and .*', ''),
      ',.*', ''), 22) AS a, left(regexp_replace(regexp_replace(p_brand || ', ' || p_name || ' and more', ' and .*', ''), ',.*', ''), 22) AS b
    FROM part""",
)
def short_name(spark, folder):
    p = b.table(spark, folder, "part")
    a = F.concat("p_type", F.lit(" "), "p_name", F.lit(" and "), "p_brand", F.lit(", rest"))
    c = F.concat("p_brand", F.lit(", "), "p_name", F.lit(" and more"))
    return p.select("p_partkey", fn.short_name(a).alias("a"), fn.short_name(c).alias("b"))


def _sql_de_dash(e: str) -> str:
    out = e
    for pattern, replacement in (
        (r"\s*—\s*", ", "),
        (r",\s*,+", ", "),
        (r"([,;:])\s*,", r"\1 "),
        (r"\s+,", ","),
        (r",(\s*[.)\]])", r",\1"),
        (r"\s{2,}", " "),
    ):
        if replacement == r",\1":
            replacement = r"\1"
        out = f"regexp_replace({out}, '{pattern}', '{replacement}', 'g')"
    return f"CASE WHEN contains({e}, '—') THEN {b.sql_strip(out)} ELSE {e} END"


@query(
    "de_dash",
    f"""SELECT doc_id, sha1({_sql_de_dash('t')}) AS text_sha FROM
    (SELECT doc_id, replace(replace(text, ', ', ' — '), '. ', ' —. ') AS t FROM documents)""",
)
def de_dash(spark, folder):
    d = b.table(spark, folder, "documents")
    dashed = F.replace(
        F.replace("text", F.lit(", "), F.lit(" — ")), F.lit(". "), F.lit(" —. ")
    )
    return d.select("doc_id", F.sha1(fn.de_dash(dashed)).alias("text_sha"))


@query(
    "clean_payload",
    f"""SELECT page_id, {_sql_de_dash("'At ' || page_id || ' — ' || url")} AS told,
      {_sql_de_dash("'note —, ' || page_id")} AS note, url || ' — x' AS link, 'a — b' AS source_url FROM pages""",
)
def clean_payload(spark, folder):
    p = b.table(spark, folder, "pages")
    key = F.col("page_id").cast("string")
    payload = p.select(
        "page_id",
        F.concat(F.lit("At "), key, F.lit(" — "), "url").alias("told"),
        F.array(
            F.struct(
                F.concat(F.lit("note —, "), key).alias("note"),
                F.concat("url", F.lit(" — x")).alias("link"),
                F.lit("a — b").alias("source_url"),
            )
        ).alias("items"),
    )
    clean = fn.clean_payload(payload)
    return clean.select("page_id", "told", F.explode("items").alias("i")).select("page_id", "told", "i.*")


@query(
    "strip_html",
    r"""SELECT page_id, sha1(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
      '(?is)<(?:script.*?</script|style.*?</style)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'),
      '&[a-z]+;', ' ', 'g'), '[\s\x{000b}\x{0085}\p{Z}]+', ' ', 'g'))) AS text_sha FROM pages""",
)
def strip_html(spark, folder):
    p = b.table(spark, folder, "pages")
    return p.select("page_id", F.sha1(fn.strip_html("html")).alias("text_sha"))


@query(
    "company_key",
    f"""SELECT key_of, {b.sql_company('t')} AS key, lower(trim(split_part(t, ' (', 1))) AS org FROM (
      SELECT 'c' || c_custkey AS key_of, 'The ' || c_name || ' Holdings, Inc. (unit ' || c_nationkey || ')' AS t FROM customer
      UNION ALL SELECT 's' || s_suppkey, s_name || ' & Co.' FROM supplier)""",
)
def company_key(spark, folder):
    """Organisation keys of customers and suppliers."""
    c = b.table(spark, folder, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("key_of"),
        F.concat(
            F.lit("The "), "c_name", F.lit(" Holdings, Inc. (unit "), F.col("c_nationkey").cast("string"), F.lit(")")
        ).alias("t"),
    )
    s = b.table(spark, folder, "supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("key_of"),
        F.concat("s_name", F.lit(" & Co.")).alias("t"),
    )
    return c.unionByName(s).select("key_of", fn.company_key("t").alias("key"), fn.org_key("t").alias("org"))


@query(
    "filing_fields",
    """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN 'https://www.sec.gov/Archives/edgar/data/' || o_custkey || '/'
        || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') || '24/doc-' || o_orderkey || '.htm' END AS url,
      'Customer ' || o_custkey AS filer FROM orders""",
)
def filing_fields(spark, folder):
    """Document address and filer of filing hits; a hit without company number has no address."""
    o = b.table(spark, folder, "orders")
    order, customer = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    accession = F.concat(F.lpad(order, 10, "0"), F.lit("-24"))
    ciks = F.when(F.col("o_orderstatus") == "P", F.array().cast("array<string>")).otherwise(
        F.array(F.lpad(customer, 10, "0"))
    )
    hits = o.select(
        "o_orderkey",
        F.concat(accession, F.lit(":doc-"), order, F.lit(".htm")).alias("_id"),
        F.struct(
            accession.alias("adsh"),
            ciks.alias("ciks"),
            F.array(F.concat(F.lit("Customer "), customer, F.lit("  (CIK "), customer, F.lit(")"))).alias("display_names"),
        ).alias("_source"),
    )
    return hits.select("o_orderkey", fn.filing_url().alias("url"), fn.filer_name().alias("filer"))


@query(
    "fmt_usd",
    """SELECT o_orderkey, '$' || CASE WHEN v >= 1e9 THEN CASE WHEN v % 1e9 = 0 THEN CAST(CAST(v / 1e9 AS BIGINT) AS VARCHAR)
        ELSE printf('%.1f', floor(v / 1e9 * 10 + 0.5) / 10) END || 'B'
      WHEN v >= 1e6 THEN CAST(round(v / 1e6) AS BIGINT) || 'M' WHEN v >= 1e3 THEN CAST(round(v / 1e3) AS BIGINT) || 'K'
      ELSE CAST(CAST(v AS BIGINT) AS VARCHAR) END AS label
    FROM (SELECT o_orderkey, floor(o_totalprice / 100) * CASE o_orderstatus WHEN 'F' THEN 1e6 WHEN 'O' THEN 1e3 ELSE 0.25 * 4 END AS v FROM orders)""",
)
def fmt_usd(spark, folder):
    o = b.table(spark, folder, "orders")
    scale = F.when(F.col("o_orderstatus") == "F", 1e6).when(F.col("o_orderstatus") == "O", 1e3).otherwise(1.0)
    v = F.floor(F.col("o_totalprice") / 100).cast("double") * scale
    return o.select("o_orderkey", fn.fmt_usd(v).alias("label"))


@query(
    "pct",
    """SELECT o_orderpriority, o_orderstatus, CAST(round(f / n * 100) AS INTEGER) AS pct FROM (
      SELECT o_orderpriority, o_orderstatus, count(*) AS n, count_if(o_totalprice > 250000) AS f FROM orders GROUP BY ALL)""",
)
def pct(spark, folder):
    o = b.table(spark, folder, "orders").groupBy("o_orderpriority", "o_orderstatus")
    counted = o.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_totalprice") > 250000).alias("f"))
    return counted.select("o_orderpriority", "o_orderstatus", fn.pct(F.col("f"), F.col("n")).alias("pct"))


_PAIRS = f"""WITH {b.POSTINGS}, pairs AS (SELECT "group", sector_key, count(*) AS n FROM postings
  WHERE "group" IS NOT NULL GROUP BY ALL)"""


@query(
    "heat_bucket",
    f"""{_PAIRS} SELECT "group", sector_key, n, CAST(least(greatest(ceil(sqrt(n / (SELECT max(n) FROM pairs)) * 5), 1), 5) AS INTEGER)
    AS bucket FROM pairs""",
)
def heat_bucket(spark, folder):
    pairs = (
        tables.normalize_postings(b.raw_postings(spark, folder))
        .filter(F.col("group").isNotNull())
        .groupBy("group", "sector_key")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return ins.heat_buckets(pairs)


@query(
    "share_of_max",
    f"""WITH {b.POSTINGS}, g AS (SELECT "group", count(*) AS n FROM postings WHERE "group" IS NOT NULL GROUP BY 1)
    SELECT "group", n, round(greatest(1.5, n / (SELECT max(n) FROM g) * 100), 6) AS share FROM g""",
)
def share_of_max(spark, folder):
    counts = ins.count_by(tables.normalize_postings(b.raw_postings(spark, folder)), "group")
    return ins.share_of_max(counts, "n").withColumn("share", F.round("share", 6))


@query(
    "rag_text",
    f"""WITH {b.GRAPH}, last AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY industry ORDER BY pos DESC) = 1)
    SELECT 'Industry' AS label, l.industry AS id, left(l.industry || '. ' || left(l.overview, 1200) || ' ' || coalesce('Distinct by ' || n_name, '') || ' ', 2000) AS text
      FROM last l LEFT JOIN nation ON l.p_brand = 'Brand#' || n_nationkey
    UNION ALL SELECT 'Hazard' AS label, id, left(coalesce(name, '') || '. ' || coalesce(description, ''), 2000) AS text
      FROM cat_nodes WHERE type = 'hazard'
    UNION ALL SELECT 'Exposure', id, left(coalesce(name, '') || '. ' || coalesce(description, ''), 2000) FROM cat_nodes WHERE type = 'exposure'
    UNION ALL SELECT 'Subcategory', id, left(name || ' (' || parent || ')', 2000) FROM sub_nodes
    UNION ALL SELECT 'Incident', id, left(victim || '. ' || summary || ' Impact: ' || financial_impact || ' Downtime: ' || downtime, 2000) FROM inc_nodes""",
)
def rag_text(spark, folder):
    g = b.graph(spark, folder)
    parts = [
        g.nodes[label].select(
            F.lit(label).alias("label"), "id", F.left(fn.rag_text(label), F.lit(rules.RAG_TEXT_CHARS)).alias("text")
        )
        for label in ("Industry", "Hazard", "Exposure", "Subcategory", "Incident")
    ]
    return tables.union_runs(*parts)


@query(
    "with_defaults",
    f"""WITH {b.INCIDENTS} SELECT 'blank' AS form, pos, slot, coalesce("group", '') AS "group", coalesce("date", '') AS "date", victim FROM incs
    UNION ALL SELECT 'null', pos, slot, nullif("group", ''), nullif("date", ''), nullif(victim, '') FROM incs""",
)
def with_defaults(spark, folder):
    """Both guard forms: missing text as '' and blank text as NULL."""
    rows = tables.explode_incidents(b.records(spark, folder))
    forms = {"blank": fn.with_defaults(rows), "null": fn.with_defaults(rows, strings=None)}
    parts = [
        df.select(F.lit(form).alias("form"), F.col("_pos").alias("pos"), "slot", "group", "date", "victim")
        for form, df in forms.items()
    ]
    return tables.union_runs(*parts)
