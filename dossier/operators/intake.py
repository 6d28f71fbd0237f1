"""New records: attacker enrichment, acceptance gate, in-batch and global de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier import functions as fn
from dossier import rules
from dossier.operators.ranking import first_per
from dossier.session import cut


def attacker_index(postings: DataFrame, order: Column | str = "_pos") -> DataFrame:
    """First group posted per organisation key."""
    rows = postings.withColumn("company_key", fn.company_key("victim")).filter(
        (F.col("company_key") != "") & (fn.text("group") != "")
    )
    return first_per(rows, "company_key", order).select(
        "company_key", F.col("group").alias("posted_group")
    )


def enrich_attacker(records: DataFrame, index: DataFrame) -> DataFrame:
    """Fill unnamed attackers from the posting index; a hit makes other cyber cases ransomware."""
    keyed = records.withColumn("company_key", fn.company_key("victim"))
    joined = keyed.join(index, "company_key", "left")
    hit = fn.is_placeholder_group("group") & F.col("posted_group").isNotNull()
    upgraded = hit & (F.col("incident_type") == "other-cyber")
    return joined.withColumns(
        {
            "enriched": hit,
            "group": F.when(hit, F.col("posted_group")).otherwise(F.col("group")),
            "incident_type": F.when(upgraded, "ransomware").otherwise(F.col("incident_type")),
        }
    ).drop("posted_group")


def victim_key(c: Column | str) -> Column:
    return F.lower(fn.strip(fn.text(c)))


def new_only(records: DataFrame, existing: DataFrame) -> DataFrame:
    """Records whose victim no existing incident has, in any industry."""
    known = existing.select(victim_key("victim").alias("_victim")).distinct()
    return records.withColumn("_victim", victim_key("victim")).join(known, "_victim", "left_anti").drop("_victim")


def known_industry(records: DataFrame, industries: DataFrame) -> DataFrame:
    return records.join(industries.select("industry").distinct(), "industry", "left_semi")


def gate(known: Column | None = None, duplicate: Column | None = None) -> Column:
    """Status of one record by itself: the first failing test names the reason."""
    kind = F.coalesce(F.col("incident_type"), F.lit("unclassified"))
    status = F.when(
        ~kind.isin(rules.ACCEPTED_INCIDENT_TYPES), F.concat(F.lit("skip:"), kind)
    ).when(
        fn.text("industry").isin(["", rules.UNKNOWN_INDUSTRY]), "skip:industry-unknown"
    ).when(fn.is_placeholder_victim("victim"), "skip:no-victim")
    if known is not None:
        status = status.when(~known, F.concat(F.lit("skip:no-such-industry:"), F.col("industry")))
    if duplicate is not None:
        status = status.when(duplicate, "skip:duplicate")
    return status.otherwise("added")


def accept_status(records: DataFrame) -> DataFrame:
    """Gate on type, industry and victim alone."""
    return records.withColumn("status", gate())


def intake_status(
    records: DataFrame, industries: DataFrame, existing: DataFrame, order: str = "_pos", dry: bool = False
) -> DataFrame:
    """Status of every record of a batch, as if the batch were taken in one record at a time.

    The first accepted record of an organisation makes all later ones of that organisation
    duplicates. Its place is a minimum per organisation, merged before the shuffle and
    joined back, so an organisation with many filings is never gathered in one task.
    """
    known = industries.select("industry").distinct().withColumn("_known", F.lit(True))
    have = existing.select(victim_key("victim").alias("_victim")).distinct().withColumn("_have", F.lit(True))
    if "company_key" not in records.columns:
        records = records.withColumn("company_key", fn.company_key("victim"))
    rows = (
        records.withColumn("_victim", victim_key("victim"))
        .join(known, "industry", "left")
        .join(have, "_victim", "left")
        .withColumn("status", gate(F.col("_known").isNotNull(), F.col("_have").isNotNull()))
        .withColumn(
            "_org",
            F.when(F.col("company_key") != "", F.concat(F.lit("k:"), F.col("company_key"))).otherwise(
                F.concat(F.lit("v:"), F.col("_victim"))
            ),
        )
    )
    rows = cut(rows)  # the minimum and the statuses both read it
    first = (
        rows.filter(F.col("status") == "added").groupBy("_org").agg(F.min(order).alias("_first"))
    )
    later = F.col(order) > F.col("_first")
    keyed = F.col("company_key") != ""
    accepted = F.col("status") == "added"
    status = F.when(later & keyed, "skip:duplicate-in-batch")
    if not dry:
        status = status.when(later & accepted, "skip:duplicate")
    status = status.when(accepted, "dry" if dry else "added").otherwise(F.col("status"))
    return rows.join(first, "_org", "left").withColumn("status", status).drop(
        "_org", "_first", "_victim", "_known", "_have"
    )


def first_accepted(accepted: DataFrame, order: str = "_pos") -> DataFrame:
    """First accepted record per organisation."""
    keyed = accepted.withColumn("company_key", fn.company_key("victim"))
    return first_per(keyed.filter(F.col("company_key") != ""), "company_key", order)


def status_counts(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy(F.substring_index("status", ":", 1).alias("status")).agg(
        F.count(F.lit(1)).alias("n")
    )


def to_incidents(records: DataFrame) -> DataFrame:
    """Accepted records in the shape of the incident table's source rows."""
    blank = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    return records.select(
        "industry",
        "victim",
        blank("group"),
        blank("date"),
        blank("country"),
        "incident_type",
        F.lit(rules.INGEST_SOURCE).alias("ingest_source"),
        "summary",
        "financial_impact",
        "ransom_demanded_or_paid",
        "downtime_and_recovery",
        "data_impact",
        F.filter(F.coalesce("sources", F.array().cast("array<string>")), lambda s: s.isNotNull()).alias("sources"),
    )
