"""Expressions over nested records: richness, defaults, filing fields, public views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier import rules
from dossier.functions.keys import col, strip, text


def size_of(c: Column | str) -> Column:
    """Array length, 0 for NULL."""
    return F.when(col(c).isNull(), 0).otherwise(F.size(col(c)))


def richness() -> Column:
    """How much research an industry record holds."""
    return (
        size_of("example_incidents") * 100
        + size_of("hazard_categories") * 10
        + size_of("exposure_categories")
        + size_of("aggregate_stats")
    )


def with_defaults(df: DataFrame, strings: str | None = "") -> DataFrame:
    """Missing arrays become empty arrays, missing strings become ``strings``.

    With ``strings=None`` blank strings become NULL instead.
    """

    def guard(field: T.StructField) -> Column:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.ArrayType):
            c = F.coalesce(c, F.array().cast(field.dataType))
        elif isinstance(field.dataType, T.StringType):
            c = F.nullif(c, F.lit("")) if strings is None else F.coalesce(c, F.lit(strings))
        return c.alias(field.name)

    return df.select([guard(f) for f in df.schema.fields])


def filing_url(hit_id: Column | str = "_id", source: Column | str = "_source") -> Column:
    """Document address of a filing hit; NULL unless company, accession and file are all known."""
    source = col(source)
    cik = F.get(source["ciks"], F.lit(0)).try_cast("long").cast("string")
    accession = F.nullif(F.replace(source["adsh"], F.lit("-"), F.lit("")), F.lit(""))
    file = F.nullif(F.regexp_replace(col(hit_id), r"(?s)^[^:]*:", ""), F.lit(""))
    slash = F.lit("/")
    return F.concat(F.lit(rules.FILING_ARCHIVE), cik, slash, accession, slash, file)


def filer_name(source: Column | str = "_source") -> Column:
    first = F.get(col(source)["display_names"], F.lit(0))
    return strip(F.substring_index(text(first), "  (", 1))


def insights_view(insights: DataFrame) -> DataFrame:
    """The insight row under its public column names; panels that grow with the data are tables of their own."""

    def money(c: str) -> Column:
        return F.transform(
            c,
            lambda x: F.struct(
                x["victim"].alias("victim"),
                x["industry"].alias("industry"),
                x["usd"].alias("usd"),
                x["text"].alias("raw"),
            ),
        )

    return insights.select(
        F.col("total_victims").alias("total"),
        F.col("group_count").alias("groupCount"),
        F.col("country_count").alias("countryCount"),
        F.col("by_year").alias("byYear"),
        F.col("top_groups").alias("topGroups"),
        F.col("top_countries").alias("topCountries"),
        "coverage",
        money("costliest").alias("financial"),
        money("largest_ransoms").alias("ransom"),
        "generated_at",
    )
