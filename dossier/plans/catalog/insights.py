"""Dashboard panels over postings and incidents."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier import functions as fn
from dossier.operators import insights as ins
from dossier.operators import tables
from dossier.plans.catalog import bindings as b
from dossier.plans.catalog.registry import query


def postings_of(spark, folder):
    return tables.normalize_postings(b.raw_postings(spark, folder))


def incidents_of(spark, folder):
    return tables.incidents_table(b.records(spark, folder))


@query(
    "counts_by_dimension",
    f"""WITH {b.POSTINGS}
    SELECT 'sector' AS dimension, sector_key AS value, count(*) AS n FROM postings GROUP BY 2
    UNION ALL SELECT 'year', CAST("year" AS VARCHAR), count(*) FROM postings WHERE "year" IS NOT NULL GROUP BY 2
    UNION ALL SELECT 'group', "group", count(*) FROM postings WHERE "group" IS NOT NULL GROUP BY 2
    UNION ALL SELECT 'country', country, count(*) FROM postings WHERE country IS NOT NULL GROUP BY 2""",
)
def counts_by_dimension(spark, folder):
    return ins.counts_by_dimension(postings_of(spark, folder))


@query("count_by", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def count_by(spark, folder):
    return ins.count_by(b.table(spark, folder, "events"), "event_type")


@query(
    "distinct_counts",
    f"""WITH {b.POSTINGS} SELECT count(DISTINCT "group") AS group_count, count(DISTINCT country) AS country_count FROM postings""",
)
def distinct_counts(spark, folder):
    return ins.distinct_counts(postings_of(spark, folder))


@query("distinct_counts_approximate", "SELECT true AS groups_close, true AS countries_close")
def distinct_counts_approximate(spark, folder):
    """Whether the approximate counts lie within a tenth of the exact ones."""
    postings = postings_of(spark, folder)
    exact = ins.distinct_counts(postings).select(F.col("group_count").alias("g"), F.col("country_count").alias("c"))
    both = ins.distinct_counts(postings, approximate=True).join(exact)
    close = lambda a, e: F.abs(F.col(a) - F.col(e)) <= 0.1 * F.col(e)
    return both.select(close("group_count", "g").alias("groups_close"), close("country_count", "c").alias("countries_close"))


@query(
    "top_groups",
    f"""WITH {b.POSTINGS} SELECT "group", count(*) AS n FROM postings WHERE "group" IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 15""",
)
def top_groups(spark, folder):
    return ins.top_groups(postings_of(spark, folder))


@query(
    "top_countries",
    f"""WITH {b.POSTINGS} SELECT country, count(*) AS n FROM postings WHERE country IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 12""",
)
def top_countries(spark, folder):
    return ins.top_countries(postings_of(spark, folder))


@query(
    "display_casing",
    f"""WITH {b.POSTINGS}, c AS (SELECT sector_key, sector, count(*) AS n FROM postings GROUP BY ALL)
    SELECT sector_key, sector FROM c QUALIFY row_number() OVER (PARTITION BY sector_key ORDER BY n DESC, sector) = 1""",
)
def display_casing(spark, folder):
    return ins.display_casing(b.raw_postings(spark, folder))


@query(
    "heatmap",
    f"""WITH {b.POSTINGS}, g AS (SELECT "group", count(*) AS group_n FROM postings WHERE "group" IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10),
      s AS (SELECT sector_key, count(*) AS sector_n FROM postings GROUP BY 1),
      c AS (SELECT "group", sector_key, count(*) AS n FROM postings GROUP BY ALL)
    SELECT g."group" AS "group", s.sector_key AS sector_key, group_n, sector_n, coalesce(c.n, 0) AS n
    FROM g CROSS JOIN s LEFT JOIN c ON c."group" = g."group" AND c.sector_key = s.sector_key""",
)
def heatmap(spark, folder):
    return ins.heatmap(postings_of(spark, folder))


def _ranked(column: str, n: int) -> str:
    return f"""(SELECT sector_key, string_agg(v || '=' || n, '|' ORDER BY n DESC, v) AS t FROM (
        SELECT * FROM (SELECT sector_key, {column} AS v, count(*) AS n FROM postings_raw WHERE {column} <> '' GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY sector_key ORDER BY n DESC, v) <= {n}) GROUP BY 1)"""


@query(
    "sector_summary",
    f"""WITH {b.RAW_POSTINGS}, postings_raw AS (
        SELECT *, lower(trim(CASE WHEN activity = '' THEN 'Unclassified' ELSE activity END)) AS sector_key,
          CASE WHEN regexp_matches(left(attackdate, 4), '^[0-9]{{4}}$') THEN left(attackdate, 4) END AS y FROM raw WHERE victim <> ''),
      t AS (SELECT sector_key, count(*) AS total, CAST(round(count_if(press <> '') / count(*) * 100) AS INTEGER) AS press_pct,
          CAST(round(count_if(ransom <> '') / count(*) * 100) AS INTEGER) AS ransom_pct FROM postings_raw GROUP BY 1),
      y AS (SELECT sector_key, string_agg(y || '=' || n, '|' ORDER BY y) AS t FROM (
          SELECT sector_key, y, count(*) AS n FROM postings_raw WHERE y IS NOT NULL GROUP BY ALL) GROUP BY 1)
    SELECT t.sector_key AS sector_key, total, y.t AS by_year, g.t AS top_groups, c.t AS top_countries, press_pct, ransom_pct
    FROM t LEFT JOIN y USING (sector_key) LEFT JOIN {_ranked('"group"', 8)} g USING (sector_key) LEFT JOIN {_ranked('country', 6)} c USING (sector_key)""",
)
def sector_summary(spark, folder):
    return summary_texts(ins.sector_summary(b.raw_postings(spark, folder)))


def summary_texts(rows, *more):
    """The fields of sector summaries, lists as texts."""
    told = lambda c: F.array_join(
        F.transform(c, lambda x: F.concat(x["name"], F.lit("="), x["n"].cast("string"))), "|"
    ).alias(c)
    years = F.transform(
        F.map_entries("by_year"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    )
    return rows.select(
        *more, "sector_key", "total", F.array_join(F.array_sort(years), "|").alias("by_year"),
        told("top_groups"), told("top_countries"), "press_pct", "ransom_pct",
    )


_COVERAGE = f"""WITH {b.INCIDENTS}, i AS (SELECT *, nullif(financial_impact, '') AS ft, {b.sql_usd("financial_impact")} AS fu,
    nullif(ransom_demanded_or_paid, '') AS rt, {b.sql_usd("ransom_demanded_or_paid")} AS ru FROM incs WHERE victim <> '')"""


def _coverage_rows() -> str:
    from dossier import rules

    paid = lambda c: f"({b.sql_disclosed(c)} AND {b.sql_matches(c, rules.RANSOM_PAID)})"
    tests = {
        "Financial impact stated": b.sql_disclosed("ft"),
        "Financial amount ($)": "fu IS NOT NULL",
        "Ransom amount ($)": "ru IS NOT NULL",
        "Ransom demanded": f"({b.sql_disclosed('rt')} AND {b.sql_matches('rt', rules.RANSOM_DEMANDED)})",
        "Ransom paid": f"({paid('rt')} OR {paid('ft')})",
        "Downtime / recovery": b.sql_disclosed("downtime_and_recovery"),
        "Data impact": b.sql_disclosed("data_impact"),
    }
    rows = [
        f"SELECT {i} AS slot, '{label}' AS field, CAST(count_if({test}) AS BIGINT) AS disclosed, count(*) AS total FROM i"
        for i, (label, test) in enumerate(tests.items())
    ]
    return " UNION ALL ".join(rows)


@query(
    "coverage",
    f"""{_COVERAGE}, c AS ({_coverage_rows()}) SELECT CAST(slot AS INTEGER) AS slot, field, disclosed, total - disclosed AS undisclosed, total,
      CAST(round(disclosed / total * 100) AS INTEGER) AS pct FROM c""",
)
def coverage(spark, folder):
    return ins.coverage(incidents_of(spark, folder))


@query(
    "coverage_by_industry",
    f"""{_COVERAGE} SELECT industry, count(*) AS incidents, CAST(count_if(fu IS NOT NULL) AS BIGINT) AS financial, CAST(count_if(ru IS NOT NULL) AS BIGINT) AS ransom,
      CAST(count_if({b.sql_disclosed("downtime_and_recovery")}) AS BIGINT) AS downtime FROM i GROUP BY 1""",
)
def coverage_by_industry(spark, folder):
    return ins.coverage_by_industry(incidents_of(spark, folder))


def _largest(usd: str, text: str) -> str:
    id = f"{b.sql_slug('industry')} || '--' || {b.sql_slug('victim')}"
    return f"""{_COVERAGE}, f AS (SELECT {id} AS _id, victim, industry, {usd} AS usd, {text} AS text, lower(trim(split_part(victim, ' (', 1))) AS org
        FROM i WHERE {usd} > 0),
      o AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY org ORDER BY usd DESC, _id) = 1)
    SELECT victim, industry, usd, text FROM o ORDER BY usd DESC, victim, _id LIMIT 15"""


@query("costliest", _largest("fu", "ft"))
def costliest(spark, folder):
    return ins.costliest(incidents_of(spark, folder))


@query("largest_ransoms", _largest("ru", "rt"))
def largest_ransoms(spark, folder):
    return ins.largest_ransoms(incidents_of(spark, folder))


_BY_YEAR = f"""WITH {b.POSTINGS}, y AS (SELECT "year", count(*) AS n FROM postings WHERE "year" IS NOT NULL GROUP BY 1)"""


@query("trend", f"""{_BY_YEAR} SELECT "year", n FROM y WHERE "year" >= 1998""")
def trend(spark, folder):
    return ins.trend(ins.count_by(postings_of(spark, folder), "year"), 1998)


@query("peak_year", f"""{_BY_YEAR} SELECT "year", n FROM y ORDER BY n DESC, "year" LIMIT 1""")
def peak_year(spark, folder):
    return ins.peak_year(ins.count_by(postings_of(spark, folder), "year"))


@query(
    "sector_year",
    f"""WITH {b.POSTINGS} SELECT sector, left(attackdate, 4) AS "year", count(*) AS victims FROM postings WHERE attackdate <> '' GROUP BY 1, 2""",
)
def sector_year(spark, folder):
    return ins.sector_year(postings_of(spark, folder))


@query(
    "year_pull_by_sector",
    f"""WITH {b.RAW_POSTINGS} SELECT coalesce(nullif(activity, ''), '(unclassified)') AS sector, count(*) AS n FROM raw GROUP BY 1""",
)
def year_pull_by_sector(spark, folder):
    return ins.year_pull_by_sector(b.raw_postings(spark, folder))


@query(
    "classified_only",
    f"""WITH {b.RAW_POSTINGS} SELECT activity AS sector, count(*) AS n FROM raw WHERE activity <> '' GROUP BY 1""",
)
def classified_only(spark, folder):
    return ins.classified_only(ins.year_pull_by_sector(b.raw_postings(spark, folder)))


@query(
    "insights",
    f"""WITH {b.POSTINGS}{b.INCIDENTS.replace(b._PARTS, "," + b._PARTS)},
      g AS (SELECT "group", count(*) AS n FROM postings WHERE "group" IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 15),
      c AS (SELECT country, count(*) AS n FROM postings WHERE country IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 12),
      y AS (SELECT "year", count(*) AS n FROM postings WHERE "year" IS NOT NULL GROUP BY 1)
    SELECT (SELECT count(*) FROM postings) AS total, (SELECT count(DISTINCT "group") FROM postings) AS "groupCount",
      (SELECT count(DISTINCT country) FROM postings) AS "countryCount", (SELECT count(*) FROM incs WHERE victim <> '') AS incidents,
      (SELECT string_agg("group" || '=' || n, '|' ORDER BY n DESC, "group") FROM g) AS "topGroups",
      (SELECT string_agg(country || '=' || n, '|' ORDER BY n DESC, country) FROM c) AS "topCountries",
      (SELECT string_agg("year" || '=' || n, '|' ORDER BY "year") FROM y) AS "byYear" """,
)
def insights(spark, folder):
    """The packed insight row under its public names."""
    raw = b.raw_postings(spark, folder)
    panels = ins.insight_panels(raw, tables.normalize_postings(raw), incidents_of(spark, folder))
    view = fn.insights_view(ins.insights(panels))
    told = lambda c, name: F.array_join(
        F.transform(c, lambda x: F.concat(x[name].cast("string"), F.lit("="), x["n"].cast("string"))), "|"
    )
    return view.select(
        "total",
        "groupCount",
        "countryCount",
        F.get("coverage", F.lit(0))["total"].alias("incidents"),
        told("topGroups", "group").alias("topGroups"),
        told("topCountries", "country").alias("topCountries"),
        told("byYear", "year").alias("byYear"),
    )
