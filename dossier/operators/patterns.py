"""The named graph queries. Path queries return rows (src, type, dst, depth)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier import functions as fn
from dossier.operators import graph as gr
from dossier.operators.graph import Graph, hop, path, path_rows, rows_of
from dossier.operators.insights import sector_year
from dossier.operators.ranking import top_n

__all__ = [
    "bowtie", "busiest_sample", "cross_sector_groups", "cross_sector_paths", "disclosed_costs",
    "disclosed_paths", "exposure_drill", "exposure_inventory", "group_footprint", "hazard_reach",
    "incident_star", "industry_drill", "industry_hazards", "industry_profile", "only_in_described",
    "reach_paths", "sector_year", "shared_names", "supply_chain_incidents", "top_groups_graph",
]


def industry_hazards(g: Graph) -> DataFrame:
    return rows_of(hop(g, "Industry", "FACES", "Hazard"))


def industry_profile(
    g: Graph, industry: str, axes: Sequence[str] = ("FACES", "EXPOSES", "HAD_INCIDENT")
) -> DataFrame:
    """One industry's edges of the given types; two axes give the taxonomy view alone."""
    return rows_of(hop(g, "Industry", list(axes)).filter(F.col("from") == industry))


def bowtie(g: Graph, a: str, b: str, type: str = "FACES") -> DataFrame:
    """Edges from two industries to the targets they share."""
    both = gr.shared_targets(g, type, a, b)
    edges = g.of_type(type).filter(F.col("from").isin([a, b]))
    return rows_of(edges.join(both, "to", "left_semi"))


def shared_names(g: Graph, a: str, b: str, type: str = "FACES", label: str = "Hazard") -> DataFrame:
    both = gr.shared_targets(g, type, a, b).withColumnRenamed("to", "id")
    return g.nodes[label].join(both, "id").select("name")


def cross_sector_paths(g: Graph, min_reach: int = 2) -> DataFrame:
    """Paths industry -> incident -> group for groups found in several industries."""
    pairs = path(g, ["HAD_INCIDENT", "PERPETRATED_BY"]).select("n0", "n2").distinct()
    wide = pairs.groupBy(F.col("n2").alias("to")).agg(F.count(F.lit(1)).alias("reach"))
    wide = wide.filter(F.col("reach") >= min_reach)
    attacks = g.of_type("PERPETRATED_BY").join(wide, "to", "left_semi").select(gr.EDGE)
    return path_rows(g.of_type("HAD_INCIDENT"), attacks)


def exposure_drill(g: Graph, text: str) -> DataFrame:
    """Industries -> exposures whose name contains a text -> their subcategories."""
    wanted = g.nodes["Exposure"].filter(F.contains("name", F.lit(text))).select(F.col("id").alias("to"))
    exposes = hop(g, "Industry", "EXPOSES", "Exposure").join(wanted, "to", "left_semi")
    return path_rows(exposes, hop(g, "Exposure", "INCLUDES", "Subcategory"))


def industry_drill(g: Graph, industry: str) -> DataFrame:
    exposes = hop(g, "Industry", "EXPOSES", "Exposure").filter(F.col("from") == industry)
    return path_rows(exposes, hop(g, "Exposure", "INCLUDES", "Subcategory"))


def busiest_sample(g: Graph, groups: int = 5, rows: int = 300) -> DataFrame:
    """Attack edges of the busiest groups, the first ``rows`` in name order."""
    attacks = hop(g, "Victim", "ATTACKED_BY", "Group")
    busiest = top_n(gr.reach(attacks), groups, F.desc("reach"), "to")
    return top_n(rows_of(attacks.join(busiest, "to", "left_semi")), rows, "dst", "src")


def incident_star(g: Graph, prefix: str) -> DataFrame:
    """Incidents whose victim starts with a text, with everything they point to."""
    wanted = g.nodes["Incident"].filter(F.startswith("victim", F.lit(prefix))).select(F.col("id").alias("to"))
    had = hop(g, "Industry", "HAD_INCIDENT", "Incident").join(wanted, "to", "left_semi")
    return path_rows(had, hop(g, "Incident"))


def reach_paths(g: Graph, type: str, min_reach: int = 10) -> DataFrame:
    return rows_of(gr.rematch(g, type, F.col("reach") >= min_reach))


def group_footprint(g: Graph, text: str) -> DataFrame:
    attacks = g.of_type("PERPETRATED_BY").filter(F.contains("to", F.lit(text)))
    return path_rows(g.of_type("HAD_INCIDENT"), attacks)


def supply_chain_incidents(
    g: Graph,
    summary_texts: Sequence[str] = ("third-party", "supply chain"),
    victim_texts: Sequence[str] = ("CDK", "Change Healthcare"),
) -> DataFrame:
    """Incidents with a known group whose summary or victim holds one of the texts."""
    test = F.lit(False)
    for column, texts in (("summary", summary_texts), ("victim", victim_texts)):
        for text in texts:
            test = test | F.contains(column, F.lit(text))
    wanted = g.nodes["Incident"].filter(test).select(F.col("id").alias("to"))
    had = hop(g, "Industry", "HAD_INCIDENT", "Incident").join(wanted, "to", "left_semi")
    return path_rows(had, g.of_type("PERPETRATED_BY"))


def disclosed_paths(g: Graph) -> DataFrame:
    money = g.nodes["Incident"].filter(F.contains("financial_impact", F.lit("$")))
    had = hop(g, "Industry", "HAD_INCIDENT", "Incident")
    return rows_of(had.join(money.select(F.col("id").alias("to")), "to", "left_semi"))


def hazard_reach(g: Graph) -> DataFrame:
    """Industries per hazard, widest first."""
    per_target = gr.reach(hop(g, "Industry", "FACES", "Hazard")).withColumnRenamed("to", "id")
    return (
        g.nodes["Hazard"]
        .join(per_target, "id")
        .groupBy(F.col("name").alias("hazard"))
        .agg(F.sum("reach").cast("long").alias("industries"))
        .orderBy(F.desc("industries"), "hazard")
    )


def only_in_described(g: Graph, a: str, b: str) -> DataFrame:
    """Exposures of one industry that another lacks, with their description."""
    only = gr.only_in(g, "EXPOSES", a, b).withColumnRenamed("to", "id")
    return g.nodes["Exposure"].join(only, "id").select("name", "description")


def cross_sector_groups(g: Graph, n: int = 20) -> DataFrame:
    """Groups by distinct industries, then incidents."""
    pairs = path(g, ["HAD_INCIDENT", "PERPETRATED_BY"]).groupBy("n2", "n0").agg(F.count(F.lit(1)).alias("n"))
    groups = pairs.groupBy(F.col("n2").alias("group")).agg(
        F.count(F.lit(1)).alias("industries"), F.sum("n").cast("long").alias("incidents")
    )
    return top_n(groups, n, F.desc("industries"), F.desc("incidents"), "group")


def disclosed_costs(g: Graph, n: int = 25) -> DataFrame:
    """Incidents with a dollar figure, largest parsed figure first."""
    incidents = g.nodes["Incident"].filter(F.contains("financial_impact", F.lit("$")))
    had = hop(g, "Industry", "HAD_INCIDENT", "Incident").select(
        F.col("from").alias("industry"), F.col("to").alias("id")
    )
    rows = had.join(incidents, "id").withColumn("usd", fn.parse_usd("financial_impact"))
    return top_n(rows, n, F.desc_nulls_last("usd"), "industry", "victim").select(
        "industry", "victim", "financial_impact", "downtime", "usd"
    )


def exposure_inventory(g: Graph, industry: str) -> DataFrame:
    """One industry's exposures with their subcategory names, one row each."""
    exposes = hop(g, "Industry", "EXPOSES", "Exposure").filter(F.col("from") == industry)
    _, includes = gr.two_hops(exposes, hop(g, "Exposure", "INCLUDES", "Subcategory"))
    named = gr.with_target(g, includes, "Subcategory", F.col("name").alias("specific"))
    rows = named.select(F.col("from").alias("id"), "specific").join(
        g.nodes["Exposure"].select("id", F.col("name").alias("exposure")), "id"
    )
    return rows.select("exposure", "specific")


def top_groups_graph(g: Graph, n: int = 25) -> DataFrame:
    """Groups by attacked victims; repeat postings of one victim count once."""
    counts = gr.reach(hop(g, "Victim", "ATTACKED_BY", "Group"))
    return top_n(counts.select(F.col("to").alias("group"), F.col("reach").alias("victims")), n, F.desc("victims"), "group")
