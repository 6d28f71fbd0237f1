"""The three end-to-end flows: build the dataset, answer a question, take in new records."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier import rules
from dossier.operators import graph as gr
from dossier.operators import insights as ins
from dossier.operators import intake, retrieval, tables, taxonomy
from dossier.sources import writers


@dataclass(frozen=True)
class Dataset:
    """Everything a build derives. Members are planned, not written; panels that several others read are stored on the way."""

    industries: DataFrame
    documents: dict[str, DataFrame]
    flat: dict[str, DataFrame]
    graph: gr.Graph
    raw_postings: DataFrame


def build_dataset(
    records: DataFrame, raw_postings: DataFrame, synthesis: DataFrame | None = None
) -> Dataset:
    """From research records and bulk postings to flat tables, six document tables and the graph."""
    industries = tables.dedupe_richest(records)
    postings = tables.unique_postings(
        tables.normalize_postings(raw_postings, keep=["_pos"]), "_pos"
    )
    incidents = tables.incidents_table(industries)
    summary = ins.sector_summary(raw_postings)
    panels = ins.insight_panels(raw_postings, postings, incidents)
    documents = {
        "industries": tables.industries_table(industries, synthesis, summary),
        "incidents": incidents,
        "victims": postings,
        "taxonomy": taxonomy.taxonomy(industries),
        "insights": ins.insights(panels),
        **{f"insights_{name}": panels[name] for name in ("by_sector", "heatmap", "coverage_by_industry")},
    }
    if synthesis is not None:
        documents["synthesis"] = synthesis.select(
            F.lit("current").alias("_id"),
            F.current_timestamp().cast("string").alias("generated_at"),
            "*",
        )
    flat = {
        "incidents": tables.incidents_flat(industries),
        "taxonomy": tables.taxonomy_flat(industries),
        "aggregate_stats": tables.stats_flat(industries),
        "taxonomy_members": taxonomy.category_members(industries).drop("_pos", "slot"),
    }
    return Dataset(industries, documents, flat, gr.build_graph(industries, synthesis, raw_postings), raw_postings)


def write_dataset(data: Dataset, out: str) -> None:
    writers.write_collections(data.documents, f"{out}/documents")
    writers.write_collections(
        {"taxonomy_members": data.flat["taxonomy_members"]}, f"{out}/documents"
    )
    for name in ("incidents", "taxonomy", "aggregate_stats"):
        writers.write_csv(data.flat[name], f"{out}/flat/{name}.csv")
    writers.write_sources(data.industries, f"{out}/flat/sources")
    writers.write_nodes(data.graph, f"{out}/graph")
    writers.write_edges(data.graph, f"{out}/graph")
    writers.write_bulk_csv(data.raw_postings, f"{out}/graph/bulk_victims.csv")


def _routed(spark: SparkSession, question: str, postings: DataFrame):
    """The question with its group, lane and hints, as one row."""
    asked = spark.createDataFrame([(0, question)], "question_id long, question string")
    return (
        retrieval.route(asked, retrieval.known_groups(postings))
        .withColumn("industries", retrieval.hints("question", rules.INDUSTRY_HINTS))
        .withColumn("sectors", retrieval.hints("question", rules.SECTOR_HINTS))
        .first()
    )


def answer(
    spark: SparkSession,
    question: str,
    postings: DataFrame,
    incidents: DataFrame,
    g: gr.Graph,
    vectors: DataFrame | None = None,
    question_vector: Sequence[float] | None = None,
    k: int = 6,
) -> tuple[str, DataFrame]:
    """Lane of one question and its evidence rows.

    Only the routed question, a single row, comes to the driver.
    """
    routed = _routed(spark, question, postings)
    lane = routed["lane"]
    if lane == "entity":
        return lane, retrieval.entity_evidence(postings, incidents, routed["group"])
    if lane == "relational" and len(routed["industries"]) >= 2:
        a, b = routed["industries"][:2]
        return lane, retrieval.relational(g, a, b, "but not" in question.lower())
    if lane == "analytical" or vectors is None or question_vector is None:
        sector = routed["sectors"][0] if routed["sectors"] else None
        return "analytical", retrieval.analytical_evidence(postings, incidents, sector)
    return lane, retrieval.expand_hits(retrieval.retrieve(vectors, question_vector, k), g)


def answer_with_facts(
    spark: SparkSession, question: str, raw_postings: DataFrame, postings: DataFrame, incidents: DataFrame, g: gr.Graph, **options
) -> tuple[str, DataFrame, DataFrame | None]:
    """Lane, evidence, and the figures beside it as rows (fact, name, value): of the group, or of the panels; none in the other lanes."""
    lane, evidence = answer(spark, question, postings, incidents, g, **options)
    routed = _routed(spark, question, postings)
    if lane == "entity":
        return lane, evidence, retrieval.entity_facts(postings, routed["group"])
    if lane == "analytical":
        panels = ins.insight_panels(raw_postings, postings, incidents)
        return lane, evidence, retrieval.analytical_facts(panels, postings, routed["sectors"][0] if routed["sectors"] else None)
    return lane, evidence, None


def take_in(
    industries: DataFrame, extracted: DataFrame, raw_postings: DataFrame, dry: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Statuses of a batch of extracted records, and the incident rows it adds."""
    existing = tables.explode_incidents(industries)
    enriched = intake.enrich_attacker(extracted, intake.attacker_index(raw_postings))
    statuses = intake.intake_status(enriched, industries, existing, dry=dry)
    added = statuses.filter(F.col("status") == "added")
    return statuses, intake.to_incidents(added)
