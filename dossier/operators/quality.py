"""Validation as data: every finding is a row (rule, key, message)."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier import functions as fn
from dossier.operators.insights import stacked_coverage
from dossier.operators.tables import explode_incidents, explode_stats


def findings(df: DataFrame, key: Column | str, rules: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """Apply several rules {name: (violated, message)} in one scan."""
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("rule"),
                F.coalesce(violated, F.lit(False)).alias("violated"),
                message.alias("message"),
            )
            for name, (violated, message) in rules.items()
        ]
    )
    key = F.col(key) if isinstance(key, str) else key
    return (
        df.select(key.alias("key"), F.explode(rows).alias("r"))
        .filter("r.violated")
        .select("r.rule", "key", "r.message")
    )


def check_overview(industries: DataFrame) -> DataFrame:
    return findings(
        industries,
        "industry",
        {"overview": (fn.text("overview") == "", F.lit("missing overview"))},
    )


def check_sizes(
    industries: DataFrame, hazards: int = 4, exposures: int = 4, incidents: int = 5
) -> DataFrame:
    limits = {
        "hazards": ("hazard_categories", hazards, "hazard categories"),
        "exposures": ("exposure_categories", exposures, "exposure categories"),
        "incidents": ("example_incidents", incidents, "incidents"),
    }
    rules = {}
    for name, (field, least, noun) in limits.items():
        n = fn.size_of(field)
        rules[name] = (n < least, F.concat(F.lit("only "), n.cast("string"), F.lit(f" {noun}")))
    return findings(industries, "industry", rules)


def _quoted(c: str, rest: str) -> Column:
    return F.concat(F.lit('"'), fn.text(c), F.lit(f'" {rest}'))


def check_incidents(industries: DataFrame) -> DataFrame:
    return findings(
        explode_incidents(industries),
        "industry",
        {
            "victim": (fn.text("victim") == "", F.lit("incident with no victim name")),
            "sources": (fn.size_of("sources") == 0, _quoted("victim", "has no sources")),
        },
    )


def check_source_urls(industries: DataFrame) -> DataFrame:
    """Cited sources that are no web address are usually made up."""
    rows = explode_incidents(industries).select(
        "industry", "victim", F.explode("sources").alias("url")
    )
    shown = F.left(F.col("url"), F.lit(60))
    return findings(
        rows,
        "industry",
        {
            "source_url": (
                ~fn.is_url("url", slashes=True),
                F.concat(_quoted("victim", "has a non-URL source: "), fn.text(shown)),
            )
        },
    )


def check_stats(industries: DataFrame) -> DataFrame:
    message = F.concat(F.lit('stat "'), fn.text("metric"), F.lit('" has no source attribution'))
    return findings(
        explode_stats(industries), "industry", {"stat_source": (fn.text("source") == "", message)}
    )


def validate(industries: DataFrame) -> DataFrame:
    checks = [check_overview, check_sizes, check_incidents, check_source_urls, check_stats]
    return reduce(DataFrame.unionByName, [check(industries) for check in checks])


def coverage_report(industries: DataFrame) -> DataFrame:
    """How many incidents cite a source and report money, ransom and downtime.

    This report looks for a non-disclosure phrase anywhere in a text; the dashboard panel
    looks at its start.
    """
    stated = lambda c: (fn.text(c) != "") & ~fn.is_not_disclosed_any(c)
    return stacked_coverage(
        explode_incidents(industries),
        {
            "with a cited source": fn.size_of("sources") > 0,
            "with a financial figure": stated("financial_impact"),
            "with a ransom figure": stated("ransom_demanded_or_paid"),
            "with downtime/recovery": stated("downtime_and_recovery"),
        },
    )


def check_ids(tables: Mapping[str, DataFrame], key: str = "_id") -> DataFrame:
    """Documents, documents without id and repeated ids per table."""

    def one(name: str, df: DataFrame) -> DataFrame:
        id = F.col(key).cast("string")
        per_id = df.groupBy(F.nullif(id, F.lit("")).alias("id")).agg(F.count(F.lit(1)).alias("n"))
        total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
        return per_id.agg(
            total("n").alias("documents"),
            total(F.when(F.col("id").isNull(), F.col("n"))).alias("missing_id"),
            total(F.when(F.col("id").isNotNull(), F.col("n") - 1)).alias("repeated_id"),
        ).select(F.lit(name).alias("table"), "*")

    return reduce(DataFrame.unionByName, [one(name, df) for name, df in tables.items()])


def cross_check(left: DataFrame, right: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Two counts of the same thing side by side, keys of either side kept."""
    a = left.select(key, F.col(n).alias("left_n"))
    b = right.select(key, F.col(n).alias("right_n"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return a.join(b, key, "full").select(key, zero("left_n"), zero("right_n")).withColumn(
        "diff", F.col("left_n") - F.col("right_n")
    )


def check_vectors(vectors: DataFrame, size: int, id: str = "id") -> DataFrame:
    """Vectors that cannot be scored against queries of a size: missing, of another length, or with a missing number."""
    broken = F.col("embedding").isNull() | (F.size("embedding") != size) | F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")))
    return vectors.filter(broken).select(id, F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("size"))
