"""Dashboard aggregates over postings and incidents."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier import functions as fn
from dossier import rules
from dossier.operators.ranking import first_per, ranked_list, top_n
from dossier.operators.tables import require
from dossier.session import cut

DIMENSIONS = {
    "sector": "sector_key",
    "year": "year",
    "group": "group",
    "country": "country",
}


def _mark(dimension: str, value: Column) -> Column:
    return F.struct(F.lit(dimension).alias("dim"), value.alias("value"))


def counts_by_dimension(postings: DataFrame) -> DataFrame:
    """Rows (dimension, value, n) for sector, year, group and country in one scan and one shuffle."""
    marks = F.array(
        *[
            F.struct(F.lit(d).alias("dimension"), F.col(c).cast("string").alias("value"))
            for d, c in DIMENSIONS.items()
        ]
    )
    return (
        postings.select(F.explode(marks).alias("m"))
        .select("m.*")
        .filter(F.length("value") > 0)
        .groupBy("dimension", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def count_by(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Rows per value of a column, blanks left out."""
    c = F.col(column)
    return (
        df.filter(F.length(c.cast("string")) > 0)
        .groupBy(c.alias(name or column))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def top_groups(postings: DataFrame, n: int = 15) -> DataFrame:
    return top_n(count_by(postings, "group"), n, F.desc("n"), "group")


def top_countries(postings: DataFrame, n: int = 12) -> DataFrame:
    return top_n(count_by(postings, "country"), n, F.desc("n"), "country")


def distinct_counts(postings: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct groups and countries; the exact form pre-aggregates before it counts."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return postings.agg(count("group").alias("group_count"), count("country").alias("country_count"))


def display_casing(raw: DataFrame) -> DataFrame:
    """Most frequent spelling per sector key; the name decides ties."""
    spelled = require(raw, "victim").select(
        fn.sector_key("activity").alias("sector_key"), fn.sector_name("activity").alias("sector")
    )
    counts = spelled.groupBy("sector_key", "sector").agg(F.count(F.lit(1)).alias("n"))
    return first_per(counts, "sector_key", F.desc("n"), "sector").select("sector_key", "sector")


def heatmap(postings: DataFrame, top: int = 10) -> DataFrame:
    """Busiest groups x all sectors, empty cells as 0, ordered by group and sector size.

    The postings are read once; everything else derives from the (group, sector) counts.
    """
    pairs = cut(postings.groupBy("group", "sector_key").agg(F.count(F.lit(1)).alias("n")))
    named = pairs.filter(F.col("group").isNotNull())
    sizes = named.groupBy("group").agg(F.sum("n").alias("group_n"))
    busiest = top_n(sizes, top, F.desc("group_n"), "group")
    sectors = pairs.groupBy("sector_key").agg(F.sum("n").alias("sector_n"))
    rows = busiest.agg(F.collect_list(F.struct("group", "group_n"))).scalar()
    grid = sectors.withColumn("_rows", rows).select(
        "sector_key", "sector_n", F.explode("_rows").alias("_g")
    )
    cells = named.withColumnRenamed("n", "cell")
    return (
        grid.select("sector_key", "sector_n", "_g.*")
        .join(cells, ["group", "sector_key"], "left")
        .select(
            "group", "sector_key", "group_n", "sector_n", F.coalesce("cell", F.lit(0)).alias("n")
        )
        .orderBy(F.desc("group_n"), "group", F.desc("sector_n"), "sector_key")
    )


def heat_buckets(cells: DataFrame) -> DataFrame:
    """Matrix cells with their colour step relative to the fullest cell."""
    fullest = cells.agg(F.max("n")).scalar()
    return cells.withColumn("_max", fullest).select(
        "*", fn.heat_bucket("n", F.col("_max")).alias("bucket")
    ).drop("_max")


def share_of_max(df: DataFrame, value: str, by: str | None = None, floor: float = 1.5) -> DataFrame:
    """Bar length in percent of the largest value, over all rows or per panel ``by``."""
    if by is None:
        df = df.withColumn("_max", df.agg(F.max(value)).scalar())
    else:
        df = df.join(df.groupBy(by).agg(F.max(value).alias("_max")), by)
    share = F.greatest(F.lit(floor), F.try_divide(F.col(value), F.col("_max")) * 100)
    return df.withColumn("share", share).drop("_max")


def sector_summary(raw: DataFrame, groups: int = 8, countries: int = 6) -> DataFrame:
    """Bulk summary per sector: total, years, top groups and countries, press and ransom shares.

    One pass counts every (sector, dimension, value); the summary is assembled from those
    counts. Per sector it holds at most the four-digit years and the two short rankings.
    """
    present = lambda c: (fn.text(c) != "").cast("long")
    rows = require(raw, "victim").select(
        fn.sector_key("activity").alias("sector_key"),
        present("press").alias("press"),
        present("ransom").alias("ransom"),
        F.explode(
            F.array(
                _mark("total", F.lit("")),
                _mark("year", fn.year_of("attackdate").cast("string")),
                _mark("group", F.nullif(F.col("group"), F.lit(""))),
                _mark("country", F.nullif(F.col("country"), F.lit(""))),
            )
        ).alias("m"),
    )
    counts = cut(
        rows.filter(F.col("m.value").isNotNull())
        .groupBy("sector_key", "m.dim", "m.value")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("press").alias("press"), F.sum("ransom").alias("ransom"))
    )
    of = lambda dim: counts.filter(F.col("dim") == dim)
    item = {"name": F.col("value"), "n": F.col("n")}
    ranking = lambda dim, n, name: ranked_list(
        of(dim), "sector_key", n, item, F.desc("n"), "value"
    ).withColumnRenamed("items", name)
    years = of("year").groupBy("sector_key").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "n")))).alias("by_year")
    )
    totals = of("total").select(
        "sector_key",
        F.col("n").alias("total"),
        fn.pct(F.col("press"), F.col("n")).alias("press_pct"),
        fn.pct(F.col("ransom"), F.col("n")).alias("ransom_pct"),
    )
    return (
        totals.join(years, "sector_key", "left")
        .join(ranking("group", groups, "top_groups"), "sector_key", "left")
        .join(ranking("country", countries, "top_countries"), "sector_key", "left")
        .select(
            "sector_key", "total", "by_year", "top_groups", "top_countries", "press_pct", "ransom_pct"
        )
    )


# --- disclosure coverage ----------------------------------------------------


def coverage_tests() -> dict[str, Column]:
    """The seven disclosure tests of an incident row, by panel label."""
    financial, ransom = F.col("financial.text"), F.col("ransom.text")
    return {
        "Financial impact stated": fn.is_disclosed(financial),
        "Financial amount ($)": F.col("financial.usd").isNotNull(),
        "Ransom amount ($)": F.col("ransom.usd").isNotNull(),
        "Ransom demanded": fn.is_demanded(ransom),
        "Ransom paid": fn.is_paid(ransom) | fn.is_paid(financial),
        "Downtime / recovery": fn.is_disclosed("downtime_and_recovery"),
        "Data impact": fn.is_disclosed("data_impact"),
    }


def stacked_coverage(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """One row per test: rows passing, rows failing, percent; all tests share one aggregate."""
    one = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(test).alias(f"_{i}") for i, test in enumerate(tests.values())],
    )
    fields = F.array(
        *[
            F.struct(F.lit(i).alias("slot"), F.lit(label).alias("field"), F.col(f"_{i}").alias("disclosed"))
            for i, label in enumerate(tests)
        ]
    )
    return one.select("total", F.explode(fields).alias("f")).select(
        "f.slot",
        "f.field",
        "f.disclosed",
        (F.col("total") - F.col("f.disclosed")).alias("undisclosed"),
        "total",
        fn.pct(F.col("f.disclosed"), F.col("total")).alias("pct"),
    )


def coverage(incidents: DataFrame) -> DataFrame:
    return stacked_coverage(incidents, coverage_tests())


def coverage_by_industry(incidents: DataFrame) -> DataFrame:
    return (
        incidents.groupBy("industry")
        .agg(
            F.count(F.lit(1)).alias("incidents"),
            F.count_if(F.col("financial.usd").isNotNull()).alias("financial"),
            F.count_if(F.col("ransom.usd").isNotNull()).alias("ransom"),
            F.count_if(fn.is_disclosed("downtime_and_recovery")).alias("downtime"),
        )
        .orderBy(F.desc("incidents"), "industry")
    )


def _largest(incidents: DataFrame, money: str, n: int) -> DataFrame:
    """Largest figure per organisation, then the n largest of those; zero counts as no figure."""
    figures = incidents.filter(F.col(f"{money}.usd") > 0).select(
        "_id",
        "victim",
        "industry",
        F.col(f"{money}.usd").alias("usd"),
        F.col(f"{money}.text").alias("text"),
        fn.org_key("victim").alias("_org"),
    )
    per_org = first_per(figures, "_org", F.desc("usd"), "_id")
    return top_n(per_org, n, F.desc("usd"), "victim", "_id").select("victim", "industry", "usd", "text")


def costliest(incidents: DataFrame, n: int = 15) -> DataFrame:
    return _largest(incidents, "financial", n)


def largest_ransoms(incidents: DataFrame, n: int = 15) -> DataFrame:
    return _largest(incidents, "ransom", n)


# --- time and sector views --------------------------------------------------


def trend(by_year: DataFrame, from_year: int = 2018) -> DataFrame:
    return by_year.filter(F.col("year") >= from_year)


def peak_year(by_year: DataFrame) -> DataFrame:
    """The year with most rows, the earliest of equals."""
    return by_year.agg(
        F.max_by("year", F.struct(F.col("n"), -F.col("year"))).alias("year"), F.max("n").alias("n")
    )


def sector_year(postings: DataFrame) -> DataFrame:
    """Rows per sector and year text, in that order; rows without a date are left out."""
    return (
        postings.filter(F.length("attackdate") > 0)
        .groupBy("sector", F.left("attackdate", F.lit(4)).alias("year"))
        .agg(F.count(F.lit(1)).alias("victims"))
        .orderBy("sector", "year")
    )


def year_pull_by_sector(raw: DataFrame) -> DataFrame:
    """Records per sector over the yearly pulls, largest first."""
    sector = F.coalesce(F.nullif("activity", F.lit("")), F.lit(rules.UNCLASSIFIED_FILE_SECTOR))
    return (
        raw.groupBy(sector.alias("sector"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "sector")
    )


def classified_only(df: DataFrame, column: str = "sector") -> DataFrame:
    return df.filter(~fn.text(column).isin(rules.SECTORS_WITHOUT_CLASS))


# --- the assembled panel set ------------------------------------------------


def insight_panels(raw: DataFrame, postings: DataFrame, incidents: DataFrame) -> dict[str, DataFrame]:
    """Every dashboard panel as its own table."""
    counts = cut(counts_by_dimension(postings))
    of = lambda dim: counts.filter(F.col("dimension") == dim)
    ranked = lambda dim, n: top_n(
        of(dim).select(F.col("value").alias(dim), "n"), n, F.desc("n"), dim
    )
    sectors = of("sector").join(
        display_casing(raw).withColumnRenamed("sector_key", "value"), "value", "left"
    )
    return {
        "totals": postings.agg(F.count(F.lit(1)).alias("total_victims")).select(
            "total_victims",
            of("group").agg(F.count("*")).scalar().alias("group_count"),
            of("country").agg(F.count("*")).scalar().alias("country_count"),
            incidents.agg(F.count("*")).scalar().alias("researched_incidents"),
        ),
        "by_sector": sectors.select(F.coalesce("sector", "value").alias("sector"), "n").orderBy(
            F.desc("n"), "sector"
        ),
        "by_year": of("year").select(F.col("value").cast("int").alias("year"), "n").orderBy("year"),
        "top_groups": ranked("group", 15),
        "top_countries": ranked("country", 12),
        "heatmap": heatmap(postings),
        "coverage": coverage(incidents),
        "coverage_by_industry": coverage_by_industry(incidents),
        "costliest": costliest(incidents),
        "largest_ransoms": largest_ransoms(incidents),
    }


def insights(panels: Mapping[str, DataFrame]) -> DataFrame:
    """The panels of fixed length, packed into one row.

    The sector and industry panels grow with the number of sectors and industries and stay
    tables: ``by_sector``, ``heatmap`` and ``coverage_by_industry`` of ``insight_panels``.
    """

    def packed(name: str, *order: Column) -> Column:
        panel = panels[name]
        row = F.struct(*panel.columns)
        ranks = F.struct(*[c.alias(f"r{i}") for i, c in enumerate(order)])
        listed = F.array_sort(F.collect_list(F.struct(ranks.alias("rank"), row.alias("row"))))
        return panel.agg(listed["row"]).scalar().alias(name)

    desc = lambda c: -F.col(c)
    return panels["totals"].select(
        F.lit("current").alias("_id"),
        F.current_timestamp().cast("string").alias("generated_at"),
        "*",
        packed("by_year", F.col("year")),
        packed("top_groups", desc("n"), F.col("group")),
        packed("top_countries", desc("n"), F.col("country")),
        packed("coverage", F.col("slot")),
        packed("costliest", desc("usd"), F.col("victim")),
        packed("largest_ransoms", desc("usd"), F.col("victim")),
    )
