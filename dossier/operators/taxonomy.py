"""Category taxonomy: merged categories, reach, families, presence matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier import functions as fn
from dossier.operators.ranking import last_values
from dossier.operators.tables import explode_categories


def category_members(industries: DataFrame) -> DataFrame:
    """One row per category an industry reports, with its canonical key."""
    return (
        explode_categories(industries)
        .filter(fn.has_key("category"))
        .withColumn("key", fn.norm_key("category"))
    )


def _per_industry(members: DataFrame) -> DataFrame:
    """Partial taxonomy per (type, key, industry): splits a hot category over its industries."""
    description = fn.text("description")
    best = F.struct(
        (-F.length(description)).alias("chars"),
        F.col("_pos").alias("pos"),
        F.col("slot").alias("slot"),
        description.alias("text"),
    )
    return members.groupBy("type", "key", "industry").agg(
        F.min(best).alias("best"),
        F.count(F.lit(1)).alias("members"),
        F.sum(fn.size_of("subcategories")).alias("subcategories"),
    )


def taxonomy(industries: DataFrame) -> DataFrame:
    """Merged categories: longest description, member and industry reach, subcategory count.

    The members are the rows of ``taxonomy_members``.
    """
    return (
        _per_industry(category_members(industries))
        .groupBy("type", "key")
        .agg(
            F.min("best").alias("best"),
            F.sum("members").cast("long").alias("reach"),
            F.count(F.lit(1)).alias("industry_reach"),
            F.sum("subcategories").cast("long").alias("subcategory_count"),
        )
        .select(
            F.concat_ws(":", "type", "key").alias("_id"),
            "type",
            "key",
            fn.family_of("key").alias("family"),
            F.col("best.text").alias("description"),
            "subcategory_count",
            "reach",
            "industry_reach",
        )
    )


def taxonomy_members(industries: DataFrame) -> DataFrame:
    """The members of each category, one row each."""
    return category_members(industries).select(
        "type",
        "key",
        fn.slug("industry").alias("industry_id"),
        "industry",
        F.col("category").alias("label_as_reported"),
        F.coalesce("subcategories", F.array().cast("array<string>")).alias("subcategories"),
    )


def index_cells(industries: DataFrame) -> DataFrame:
    """Category x industry cells; the last label an industry reports for a key counts."""
    members = category_members(industries).withColumn(
        "subcategories", F.coalesce("subcategories", F.array().cast("array<string>"))
    )
    return last_values(
        members, ["type", "key", "industry"], ["category", "subcategories"], "_pos", "slot"
    )


def category_index(industries: DataFrame) -> DataFrame:
    """Categories with label, family, longest description and industry reach, widest first."""
    return (
        taxonomy(industries)
        .select(
            "type",
            "key",
            fn.display_label("key").alias("name"),
            "family",
            "description",
            F.col("industry_reach").alias("reach"),
        )
        .orderBy("type", F.desc("reach"), "name")
    )


def family_rollup(cells: DataFrame, type: str = "hazard") -> DataFrame:
    """Families of one category kind: distinct industries, distinct labels, subcategories.

    Exposures are assets and stay as reported, so the roll-up is meant for hazards.
    """
    rows = cells.filter(F.col("type") == type).withColumn("family", fn.family_of("key"))
    marks = rows.select(
        "family",
        F.explode(
            F.array(
                F.struct(F.lit("industry").alias("kind"), F.col("industry").alias("value")),
                F.struct(F.lit("key").alias("kind"), F.col("key").alias("value")),
            )
        ).alias("m"),
        fn.size_of("subcategories").alias("subs"),
    )
    distinct = marks.groupBy("family", "m.kind", "m.value").agg(F.sum("subs").alias("subs"))
    of = lambda kind: F.col("kind") == kind
    return (
        distinct.groupBy("family")
        .agg(
            F.count_if(of("industry")).alias("industries"),
            F.count_if(of("key")).alias("labels"),
            F.sum(F.when(of("key"), F.col("subs"))).cast("long").alias("subcategories"),
        )
        .orderBy(F.desc("industries"), "family")
    )


def family_labels(cells: DataFrame, type: str = "hazard") -> DataFrame:
    """The labels of each family, one row per family and label."""
    rows = cells.filter(F.col("type") == type).select(fn.family_of("key").alias("family"), F.col("key").alias("label"))
    return rows.distinct()


def family_subcategories(cells: DataFrame, type: str = "hazard") -> DataFrame:
    """Every subcategory text of each family, one row per mention."""
    rows = cells.filter(F.col("type") == type)
    return rows.select(fn.family_of("key").alias("family"), F.explode("subcategories").alias("subcategory"))


def singletons(index: DataFrame) -> DataFrame:
    """Per category kind, how many categories exactly one industry reports."""
    return index.groupBy("type").agg(
        F.count_if(F.col("reach") == 1).alias("singletons"), F.count(F.lit(1)).alias("categories")
    )


def presence_matrix(cells: DataFrame, row: str, column: str, axis: Sequence[str]) -> DataFrame:
    """Row x column presence flags with the empty cells filled in, in long form.

    The column axis is the caller's list, so its size is that of the request and not of
    the data; cells outside it take no part. Rows come from the data, NULL included.
    """
    values = F.array(*[F.lit(x) for x in axis]) if axis else F.array().cast("array<string>")
    found = cells.groupBy(row).agg(F.collect_set(F.when(F.col(column).isin(list(axis)), F.col(column))).alias("_found"))
    each = found.select(row, "_found", F.explode(values).alias(column))
    return each.select(row, column, F.array_contains("_found", F.col(column)).cast("int").alias("present"))
