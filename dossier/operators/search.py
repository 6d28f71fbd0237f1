"""Text and key filters over the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier import functions as fn


def contains_text(query: str, *columns: str) -> Column:
    """The columns, joined without separator, contain the query; case is ignored."""
    joined = F.concat(*[fn.text(c) for c in columns])
    return F.contains(F.lower(joined), F.lit(query.lower()))


def search_industries(df: DataFrame, query: str) -> DataFrame:
    return df.filter(contains_text(query, "industry", "overview", "distinct"))


def search_categories(df: DataFrame, query: str) -> DataFrame:
    """Categories whose name, description or any subcategory contains the query."""
    q = F.lit(query.lower())
    nested = F.exists("subcategories", lambda s: F.contains(F.lower(s), q))
    return df.filter(
        contains_text(query, "name", "description") | F.coalesce(nested, F.lit(False))
    )


def search_incidents(df: DataFrame, query: str) -> DataFrame:
    columns = [
        "victim", "group", "financial_impact", "downtime_and_recovery", "summary", "industry",
    ]
    return df.filter(contains_text(query, *columns))


def by_group_prefix(postings: DataFrame, group: str) -> DataFrame:
    """Postings of a group family: names that start with the text, case ignored."""
    return postings.filter(F.startswith(F.lower("group"), F.lit(group.lower())))


def incidents_by_group(incidents: DataFrame, group: str) -> DataFrame:
    return incidents.filter(F.contains(F.lower("group"), F.lit(group.lower())))


def by_sector(postings: DataFrame, sector: str, exact: bool = True) -> DataFrame:
    """Postings of a sector by its spelling, or by its key so that all spellings meet."""
    if exact:
        return postings.filter(F.col("sector") == sector)
    return postings.filter(F.col("sector_key") == fn.sector_key(F.lit(sector)))


def latest(postings: DataFrame, n: int = 15) -> DataFrame:
    """Newest postings by date text."""
    return postings.orderBy(F.desc_nulls_last("attackdate"), "victim", "_id").limit(n)
