"""From nested industry records and flat postings to the document tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier import functions as fn
from dossier import rules, schemas
from dossier.operators.ranking import first_per, last_values


def position(df: DataFrame) -> Column:
    """Record order: the ``_pos`` column where a reader left one, else the industry name decides."""
    return F.col("_pos") if "_pos" in df.columns else F.lit(0)


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Keep rows in which every named column is present and not blank."""
    for c in columns:
        df = df.filter(F.length(F.col(f"`{c}`")) > 0)
    return df


def union_runs(*runs: DataFrame) -> DataFrame:
    """Several research runs as one table; columns a run lacks are NULL."""
    out, *rest = runs
    for run in rest:
        out = out.unionByName(run, allowMissingColumns=True)
    return out


def fold_in(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Append the extra records whose canonical name is new."""
    known = base.select(fn.canonical_name("industry").alias("_name")).distinct()
    new = extra.withColumn("_name", fn.canonical_name("industry")).join(known, "_name", "left_anti")
    return base.unionByName(new.drop("_name"), allowMissingColumns=True)


def dedupe_richest(records: DataFrame) -> DataFrame:
    """Per canonical name the record holding most research; the earlier record wins ties."""
    named = records.withColumn("industry", fn.canonical_name("industry"))
    return first_per(
        named.withColumn("_rich", fn.richness()), "industry", F.desc("_rich"), position(records)
    ).drop("_rich")


def explode_categories(
    industries: DataFrame, types: Sequence[str] = ("hazard", "exposure")
) -> DataFrame:
    """Categories of the given kinds in long form, one scan for both."""

    def tagged(field: str, kind: str) -> Column:
        items = F.coalesce(F.col(field), F.array().cast(f"array<{schemas.CATEGORY.simpleString()}>"))
        return F.transform(
            items,
            lambda c, i: F.struct(
                F.lit(kind).alias("type"),
                i.alias("slot"),
                c["category"].alias("category"),
                c["description"].alias("description"),
                c["subcategories"].alias("subcategories"),
            ),
        )

    both = F.concat(*[tagged(f"{kind}_categories", kind) for kind in types])
    return industries.select(
        position(industries).alias("_pos"), "industry", F.explode(both).alias("_c")
    ).select("_pos", "industry", "_c.*")


def explode_incidents(industries: DataFrame) -> DataFrame:
    return industries.select(
        position(industries).alias("_pos"),
        "industry",
        F.posexplode("example_incidents").alias("slot", "_e"),
    ).select("_pos", "industry", "slot", "_e.*")


def explode_stats(industries: DataFrame) -> DataFrame:
    return industries.select(
        position(industries).alias("_pos"),
        "industry",
        F.posexplode("aggregate_stats").alias("slot", "_s"),
    ).select("_pos", "industry", "slot", "_s.*")


# --- flat tables ------------------------------------------------------------


def incidents_flat(industries: DataFrame) -> DataFrame:
    return explode_incidents(industries).select(
        "industry",
        "victim",
        "group",
        "date",
        "country",
        "financial_impact",
        "ransom_demanded_or_paid",
        "downtime_and_recovery",
        "data_impact",
        "summary",
        F.array_join(F.coalesce("sources", F.array().cast("array<string>")), " ; ").alias("sources"),
    )


def taxonomy_flat(industries: DataFrame) -> DataFrame:
    subs = F.coalesce("subcategories", F.array().cast("array<string>"))
    return explode_categories(industries).select(
        "industry", "type", "category", "description", F.array_join(subs, " | ").alias("subcategories")
    )


def stats_flat(industries: DataFrame) -> DataFrame:
    return explode_stats(industries).select("industry", "metric", "value", "source", "source_url")


def distinct_sources(industries: DataFrame) -> DataFrame:
    """Every distinct address an incident cites."""
    return explode_incidents(industries).select(F.explode("sources").alias("url")).distinct()


# --- document tables --------------------------------------------------------


def normalize_postings(
    raw: DataFrame, ingested_at: Column | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """Bulk postings in their 15 normalised columns; rows without a victim are dropped.

    ``keep`` names further columns to carry along, such as the feed position.
    """
    filled = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    stamp = F.current_timestamp().cast("string") if ingested_at is None else ingested_at
    return require(raw, "victim").select(
        fn.posting_id().alias("_id"),
        "victim",
        fn.blank_to_null("group").alias("group"),
        fn.sector_key("activity").alias("sector_key"),
        fn.sector_name("activity").alias("sector"),
        fn.blank_to_null("country").alias("country"),
        filled("attackdate"),
        fn.year_of("attackdate").alias("year"),
        filled("discovered"),
        filled("domain"),
        filled("data_size"),
        (fn.text("press") != "").alias("has_press"),
        filled("claim_url"),
        F.lit(rules.POSTING_SOURCE).alias("source"),
        stamp.alias("ingested_at"),
        *keep,
    )


def unique_postings(postings: DataFrame, order: str) -> DataFrame:
    """One row per posting id, as a keyed load leaves them: the last by ``order``, ties by the values."""
    rest = [c for c in postings.columns if c not in ("_id", order)]
    return last_values(postings, "_id", rest, order, *rest)


def incidents_table(industries: DataFrame, updated_at: Column | None = None) -> DataFrame:
    filled = lambda c, name=None: F.nullif(F.col(c), F.lit("")).alias(name or c)
    stamp = F.current_timestamp().cast("string") if updated_at is None else updated_at
    urls = F.coalesce("sources", F.array().cast("array<string>"))
    return require(explode_incidents(industries), "victim").select(
        fn.incident_id("industry", "victim").alias("_id"),
        fn.slug("industry").alias("industry_id"),
        "industry",
        "victim",
        filled("group"),
        filled("date"),
        filled("country"),
        fn.money_struct("financial_impact").alias("financial"),
        fn.money_struct("ransom_demanded_or_paid").alias("ransom"),
        filled("downtime_and_recovery"),
        filled("data_impact"),
        filled("summary"),
        F.filter(urls, lambda u: fn.is_url(u)).alias("sources"),
        stamp.alias("updated_at"),
    )


def with_differentiators(industries: DataFrame, synthesis: DataFrame) -> DataFrame:
    """Add the three differentiator texts; the last entry per normalised name counts."""
    entries = synthesis.select(F.posexplode("industry_differentiators").alias("_slot", "_d"))
    keyed = entries.select(fn.norm_key("_d.industry").alias("_key"), "_slot", "_d.*")
    texts = ["what_makes_it_distinct", "primary_extortion_leverage", "downtime_tolerance"]
    last = last_values(keyed, "_key", texts, "_slot")
    return (
        industries.withColumn("_key", fn.norm_key("industry"))
        .join(last, "_key", "left")
        .drop("_key")
        .withColumnsRenamed(
            {"what_makes_it_distinct": "distinct", "primary_extortion_leverage": "extortion_leverage"}
        )
    )


def with_sector_summary(industries: DataFrame, summary: DataFrame) -> DataFrame:
    """Add the bulk summary of the sector an industry is tagged with; NULL without a match."""
    tagged = industries.withColumn(
        "sector_key", F.lower(fn.strip(fn.text("ransomware_live_sector")))
    )
    packed = summary.select("sector_key", F.struct(*summary.columns).alias("bulk_summary"))
    return tagged.join(packed, "sector_key", "left").drop("sector_key")


def resolve_sector(industries: DataFrame, sectors: DataFrame) -> DataFrame:
    """Add ``resolved_sector``: the sector spelt like the tag, else one with an equal normalised key."""
    tag = fn.strip(fn.text("ransomware_live_sector"))
    exact = sectors.select(F.col("sector").alias("_exact")).distinct()
    loose = (
        exact.select(fn.norm_key("_exact").alias("_key"), "_exact")
        .groupBy("_key")
        .agg(F.min("_exact").alias("_loose"))
    )
    return (
        industries.withColumn("_tag", tag)
        .withColumn("_key", fn.norm_key("_tag"))
        .join(exact, (F.col("_tag") == F.col("_exact")) & (F.col("_tag") != ""), "left")
        .join(loose, "_key", "left")
        .withColumn("resolved_sector", F.coalesce("_exact", "_loose"))
        .drop("_tag", "_key", "_exact", "_loose")
    )


def with_incident_ids(industries: DataFrame, incidents: DataFrame) -> DataFrame:
    """Industries with the ids of their incidents: one row per incident, and one without id where there is none."""
    ids = incidents.select("industry_id", F.col("_id").alias("incident_id"))
    return industries.withColumn("industry_id", fn.slug("industry")).join(ids, "industry_id", "left")


def industries_table(
    industries: DataFrame,
    synthesis: DataFrame | None = None,
    summary: DataFrame | None = None,
    updated_at: Column | None = None,
) -> DataFrame:
    """Curated industry documents.

    Incident ids come from the record's own incidents, so no join is needed for them.
    """
    stamp = F.current_timestamp().cast("string") if updated_at is None else updated_at
    df = fn.with_defaults(industries, strings=None)
    text = ["distinct", "extortion_leverage", "downtime_tolerance"]
    if synthesis is None:
        df = df.withColumns({c: F.lit(None).cast("string") for c in text})
    else:
        df = with_differentiators(df, synthesis)
    if summary is None:
        df = df.withColumn("bulk_summary", F.lit(None).cast("string"))
    else:
        df = with_sector_summary(df, summary)
    category = lambda c: [
        F.nullif(c["description"], F.lit("")).alias("description"),
        F.coalesce(c["subcategories"], F.array().cast("array<string>")).alias("subcategories"),
    ]
    return df.select(
        fn.slug("industry").alias("_id"),
        F.col("industry").alias("name"),
        "ransomware_live_sector",
        "overview",
        F.struct(*[F.nullif(F.col(c), F.lit("")).alias(c) for c in text]).alias("differentiators"),
        F.transform(
            "hazard_categories",
            lambda c: F.struct(
                c["category"].alias("category"),
                fn.family_of(fn.norm_key(c["category"])).alias("family"),
                *category(c),
            ),
        ).alias("hazards"),
        F.transform(
            "exposure_categories",
            lambda c: F.struct(c["category"].alias("category"), *category(c)),
        ).alias("exposures"),
        F.transform(
            "aggregate_stats",
            lambda s: F.struct(
                s["metric"].alias("metric"),
                s["value"].alias("value"),
                F.nullif(s["source"], F.lit("")).alias("source"),
                F.nullif(s["source_url"], F.lit("")).alias("source_url"),
            ),
        ).alias("aggregate_stats"),
        F.transform(
            F.filter("example_incidents", lambda e: F.length(e["victim"]) > 0),
            lambda e: fn.incident_id(F.col("industry"), e["victim"]),
        ).alias("incident_ids"),
        "bulk_summary",
        stamp.alias("updated_at"),
    )


def dataset_totals(industries: DataFrame) -> DataFrame:
    """One row of dataset sizes; nested arrays are measured in place."""

    def subcategories(field: str) -> Column:
        sizes = F.transform(field, lambda c: fn.size_of(c["subcategories"]).cast("long"))
        return F.coalesce(F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0))

    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    sizes = industries.agg(
        F.count(F.lit(1)).alias("industries"),
        total(fn.size_of("example_incidents")).alias("incidents"),
        total(fn.size_of("hazard_categories")).alias("hazard_categories"),
        total(fn.size_of("exposure_categories")).alias("exposure_categories"),
        total(
            subcategories("hazard_categories") + subcategories("exposure_categories")
        ).alias("subcategories"),
        total(fn.size_of("aggregate_stats")).alias("aggregate_stats"),
    )
    sources = distinct_sources(industries).agg(F.count("url").alias("n"))
    return sizes.withColumn("unique_sources", sources.scalar())
