"""Explicit schemas of every input; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.StringType()) for name in names]


CATEGORY = T.StructType(
    _strings("category", "description")
    + [T.StructField("subcategories", T.ArrayType(T.StringType()))]
)
INCIDENT = T.StructType(
    _strings(
        "victim",
        "group",
        "date",
        "country",
        "incident_type",
        "ingest_source",
        "summary",
        "financial_impact",
        "ransom_demanded_or_paid",
        "downtime_and_recovery",
        "data_impact",
    )
    + [T.StructField("sources", T.ArrayType(T.StringType()))]
)
STAT = T.StructType(_strings("metric", "value", "source", "source_url"))

INDUSTRY = T.StructType(
    _strings("industry", "ransomware_live_sector", "overview")
    + [
        T.StructField("hazard_categories", T.ArrayType(CATEGORY)),
        T.StructField("exposure_categories", T.ArrayType(CATEGORY)),
        T.StructField("example_incidents", T.ArrayType(INCIDENT)),
        T.StructField("aggregate_stats", T.ArrayType(STAT)),
    ]
)

SYNTHESIS = T.StructType(
    [
        T.StructField("common_hazard_themes", T.ArrayType(T.StringType())),
        T.StructField("common_exposure_themes", T.ArrayType(T.StringType())),
        T.StructField("global_aggregate_losses", T.ArrayType(STAT)),
        T.StructField(
            "industry_differentiators",
            T.ArrayType(
                T.StructType(
                    _strings(
                        "industry",
                        "what_makes_it_distinct",
                        "primary_extortion_leverage",
                        "downtime_tolerance",
                    )
                )
            ),
        ),
        T.StructField("cross_industry_comparison", T.StringType()),
        T.StructField("key_takeaways", T.ArrayType(T.StringType())),
        T.StructField("highest_risk_industries", T.ArrayType(T.StringType())),
    ]
)

# Raw feed fields; the nested infostealer block has keys that differ only in case and is left out.
POSTING = T.StructType(
    _strings(
        "activity",
        "attackdate",
        "claim_url",
        "country",
        "data_size",
        "description",
        "discovered",
        "domain",
        "group",
        "press",
        "ransom",
        "screenshot",
        "url",
        "victim",
    )
)

EDGE = T.StructType(_strings("from", "from_label", "type", "to", "to_label"))

# Node labels and their stored fields, in file order.
NODE_FIELDS = {
    "Industry": [
        "id",
        "sector_tag",
        "incident_count",
        "overview",
        "distinct",
        "extortion_leverage",
        "downtime_tolerance",
    ],
    "Hazard": ["id", "name", "description"],
    "Exposure": ["id", "name", "description"],
    "Subcategory": ["id", "name", "parent", "kind"],
    "Incident": [
        "id",
        "victim",
        "date",
        "country",
        "financial_impact",
        "ransom",
        "downtime",
        "data_impact",
        "summary",
        "source_count",
    ],
    "Company": ["id"],
    "Group": ["id"],
    "Country": ["id"],
    "Statistic": ["id", "metric", "value", "source", "source_url", "scope"],
    "Source": ["id", "host"],
    "Theme": ["id", "name", "kind"],
    "Victim": ["id", "name", "sector", "attackdate", "country", "domain", "has_press"],
}
INTEGER_NODE_FIELDS = {"incident_count", "source_count"}

# Edge types with the labels they join.
EDGE_TYPES = {
    "FACES": ("Industry", "Hazard"),
    "EXPOSES": ("Industry", "Exposure"),
    "INCLUDES": (None, "Subcategory"),
    "HAD_INCIDENT": ("Industry", "Incident"),
    "HIT": ("Incident", "Company"),
    "PERPETRATED_BY": ("Incident", "Group"),
    "OCCURRED_IN": ("Incident", "Country"),
    "CITED_BY": ("Incident", "Source"),
    "MEASURED_BY": ("Industry", "Statistic"),
    "ATTACKED_BY": ("Victim", "Group"),
}
