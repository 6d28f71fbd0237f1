"""Question routing and evidence retrieval over the tables, the graph and stored vectors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier import functions as fn
from dossier import rules
from dossier.operators import adjacency
from dossier.operators import graph as gr
from dossier.operators.adjacency import Adjacency
from dossier.operators.insights import coverage
from dossier.operators.matching import longest_name, whole_word
from dossier.operators.ranking import first_per, top_n, top_n_per
from dossier.operators.search import by_group_prefix, by_sector, incidents_by_group, latest
from dossier.session import cut


# --- routing ----------------------------------------------------------------


def hints(c: Column | str, table: Mapping[str, str]) -> Column:
    """Values of the dictionary words a text contains, in dictionary order."""
    text = F.lower(fn.text(c))
    entries = F.array(
        *[F.struct(F.lit(k).alias("word"), F.lit(v).alias("value")) for k, v in table.items()]
    )
    return F.transform(F.filter(entries, lambda e: F.contains(text, e["word"])), lambda e: e["value"])


def industry_hints(questions: DataFrame, table: Mapping[str, str] = rules.INDUSTRY_HINTS) -> DataFrame:
    return questions.withColumn("hints", hints("question", table))


def known_groups(postings: DataFrame) -> DataFrame:
    """Distinct lower-cased group names."""
    return postings.filter(F.length("group") > 0).select(F.lower("group").alias("name")).distinct()


def detect_group(
    questions: DataFrame,
    groups: DataFrame,
    aliases: Mapping[str, str] = rules.GROUP_ALIASES,
    ordinary: Sequence[str] = rules.ORDINARY_WORD_GROUPS,
) -> DataFrame:
    """Add ``group``: the group a question names, or NULL.

    A listed alias wins, the first of the table; else the longest known name of three
    characters or more that stands alone, names that are ordinary words only when the
    question also speaks of attacks.
    """
    text = F.lower(fn.text("question"))
    alias = None
    for word, canonical in aliases.items():
        test = whole_word(text, word)
        alias = F.when(test, canonical) if alias is None else alias.when(test, canonical)
    meant = lambda t, needle: ~needle.isin(list(ordinary)) | t.rlike(rules.GROUP_INTENT)
    names = groups.filter(F.length("name") >= 3)
    found = longest_name(questions, "question", names, "_found", alone=True, accept=meant)
    return found.withColumn(
        "group", F.coalesce(alias, "_found") if alias is not None else F.col("_found")
    ).drop("_found")


def route(questions: DataFrame, groups: DataFrame) -> DataFrame:
    """Add ``group`` and ``lane``: a named group first, then relation words, then counting words."""
    lane = (
        F.when(F.col("group").isNotNull(), "entity")
        .when(fn.text("question").rlike(rules.RELATIONAL_QUESTION), "relational")
        .when(fn.text("question").rlike(rules.ANALYTICAL_QUESTION), "analytical")
        .otherwise("semantic")
    )
    return detect_group(questions, groups).withColumn("lane", lane)


# --- vectors ----------------------------------------------------------------


def vector_table(nodes: Mapping[str, DataFrame], vectors: DataFrame) -> DataFrame:
    """Node texts joined with given vectors (label, id, embedding); blank texts are left out.

    Both sides have a row per node, so neither is broadcast, however well its files are compressed.
    """
    rows = [
        nodes[label].select(F.lit(label).alias("label"), "id", fn.rag_text(label).alias("text"))
        for label in ("Industry", "Hazard", "Exposure", "Incident", "Subcategory")
        if label in nodes
    ]
    texts = reduce(DataFrame.unionByName, rows).filter(fn.strip("text") != "")
    clipped = texts.withColumn("text", F.left("text", F.lit(rules.RAG_TEXT_CHARS)))
    return clipped.join(vectors.hint("merge"), ["label", "id"])


def similarity(query: Sequence[float]) -> Column:
    """Dot product of the ``embedding`` column with one query vector: cosine for unit vectors.

    Each Arrow batch is scored as one matrix product, several times faster than folding
    the array element by element. A vector that is missing, of another length, or holds a
    missing or undefined number has no score.
    """
    q = np.asarray(query, dtype=np.float64)

    @F.arrow_udf("double")
    def score(vectors: pa.Array) -> pa.Array:
        fits = pc.fill_null(pc.equal(pc.list_value_length(vectors), len(q)), False)
        matrix = vectors.filter(fits).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(q))
        out = np.full(len(vectors), np.nan)
        out[fits.to_numpy(zero_copy_only=False)] = matrix.astype(np.float64) @ q
        return pa.array(out, mask=np.isnan(out))

    return score("embedding")


def vector_topk(vectors: DataFrame, query: Sequence[float], n: int, id: str = "id") -> DataFrame:
    """The n most similar rows, exact; rows without a score come last. Only the best n of every task are exchanged."""
    scored = vectors.withColumn("score", similarity(query))
    return top_n(scored.drop("embedding"), n, F.desc("score"), id)


def vector_topk_by_type(
    vectors: DataFrame,
    query: Sequence[float],
    quotas: Mapping[str, int] = rules.RETRIEVAL_QUOTAS,
    k: int = 6,
    type: str = "label",
    id: str = "id",
    text: str = "text",
) -> DataFrame:
    """Best rows of every type, merged: duplicates by text start dropped, best max(k, 8) kept."""
    scored = vectors.select(type, id, text, similarity(query).alias("score"))
    kind = F.lower(F.col(type).cast("string"))
    order = list(quotas)
    quota, slot = F.lit(0), F.lit(len(order))
    for i, name in enumerate(order):
        quota = F.when(kind == name, quotas[name]).otherwise(quota)
        slot = F.when(kind == name, i).otherwise(slot)
    wanted = scored.filter(kind.isin(order))
    best = top_n_per(wanted, type, max(quotas.values()), F.desc("score"), id).filter(
        F.col("_rank") <= quota
    )
    merged = dedupe_hits(best.withColumn("_slot", slot), ["_slot", "_rank"], text)
    return top_evidence(merged.drop("_slot", "_rank"), k, id)


def retrieve(vectors: DataFrame, query: Sequence[float], k: int = 6, **options) -> DataFrame:
    """Per-type retrieval; the best of all rows where no row has a listed type."""
    hits = cut(vector_topk_by_type(vectors, query, k=k, **options))
    if hits.isEmpty():
        id, type, text = (options.get(n, n) for n in ("id", "type", "text"))
        type = options.get("type", "label")
        hits = vector_topk(vectors, query, max(k, 8), id).select(type, id, text, "score")
    return hits


def dedupe_hits(hits: DataFrame, order: Sequence[str], text: str = "text") -> DataFrame:
    """Keep the first hit per first 100 characters of text; hits without text are dropped."""
    start = F.left(fn.text(text), F.lit(100))
    return first_per(
        hits.withColumn("_start", start).filter(F.col("_start") != ""), "_start", *order
    ).drop("_start")


def top_evidence(hits: DataFrame, k: int = 6, id: str = "id") -> DataFrame:
    return top_n(hits, max(k, 8), F.desc("score"), id)


def expand_hits(hits: DataFrame, g: gr.Graph | Adjacency) -> DataFrame:
    """Evidence of retrieved nodes: neighbour names, cited URLs, score to three digits.

    A stored adjacency table answers from the buckets of the hits; a graph is scanned.
    """
    ids = hits.select("label", "id")
    if isinstance(g, Adjacency):
        found = hits.join(adjacency.surroundings(g, ids.distinct()), ["label", "id"], "left")
    else:
        found = hits.join(gr.neighbour_context(g, ids, 6), ["label", "id"], "left").join(gr.cited_sources(g, ids, 4), ["label", "id"], "left")
    return (
        found.select(
            F.col("label").alias("type"), F.round("score", 3).alias("score"), "text", "linked", "urls"
        )
        .orderBy(F.desc("score"), "text")
    )


# --- lanes ------------------------------------------------------------------


def relational(g: gr.Graph, a: str, b: str, but_not: bool = False) -> DataFrame:
    """Exposures of ``a`` that ``b`` lacks, or the groups that hit both, as evidence rows."""
    if but_not:
        only = gr.only_in(g, "EXPOSES", a, b).withColumnRenamed("to", "id")
        rows = g.nodes["Exposure"].join(only, "id").select(F.col("name").alias("text"))
        return rows.select(F.lit("Exposure").alias("type"), "text")
    both = gr.groups_in_both(g, a, b)
    return both.select(F.lit("Group").alias("type"), F.col("group").alias("text"))


def top_groups_in(postings: DataFrame, sector: str, n: int = 10, exact: bool = True) -> DataFrame:
    """Busiest groups of a sector; unnamed groups hold a place and are dropped after the limit."""
    rows = by_sector(postings, sector, exact)
    counts = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    return top_n(counts, n, F.desc("n"), F.asc_nulls_last("group")).filter(F.col("group").isNotNull())


def entity_footprint(postings: DataFrame, group: str) -> DataFrame:
    """One group's postings as rows (panel, name, n): total, top sectors, years, top countries.

    One scan counts all panels. Missing years and countries are dropped after the limits.
    """
    mark = lambda panel, name: F.struct(F.lit(panel).alias("panel"), name.alias("name"))
    marks = F.array(
        mark("total", F.lit("")),
        mark("sector", F.col("sector")),
        mark("year", F.col("year").cast("string")),
        mark("country", F.col("country")),
    )
    counts = (
        by_group_prefix(postings, group)
        .select(F.explode(marks).alias("m"))
        .groupBy("m.panel", "m.name")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    limits = F.when(F.col("panel") == "sector", 8).when(F.col("panel") == "country", 6)
    ranked = top_n_per(
        counts.filter(F.col("panel").isin("sector", "country")),
        "panel",
        8,
        F.desc("n"),
        F.asc_nulls_last("name"),
    )
    short = ranked.filter((F.col("_rank") <= limits) & F.col("name").isNotNull()).drop("_rank")
    rest = counts.filter(
        (F.col("panel") == "total") | ((F.col("panel") == "year") & F.col("name").isNotNull())
    )
    return short.unionByName(rest)


def _line(df: DataFrame, order: Sequence[Column | str], n: int, item: Column) -> Column:
    """The first n rows as one text, items separated by commas."""
    top = top_n(df, n, *order)
    ranked = top_n_per(top.withColumn("_one", F.lit(1)), "_one", n, *order)
    items = F.array_sort(F.collect_list(F.struct("_rank", item.alias("item"))))
    return ranked.agg(F.array_join(items["item"], ", ")).scalar()


def _thousands(c: Column) -> Column:
    return F.format_number(c, 0)


def entity_evidence(postings: DataFrame, incidents: DataFrame, group: str) -> DataFrame:
    """Evidence rows (slot, type, text, urls) about one group."""
    footprint = entity_footprint(postings, group)
    panel = lambda name: footprint.filter(F.col("panel") == name)
    item = F.format_string("%s (%d)", F.col("name"), F.col("n"))
    no_urls = F.array().cast("array<string>")
    order = [F.desc("n"), "name"]
    head = panel("total").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(
        F.col("n"),
        _line(panel("sector"), order, 5, item).alias("sectors"),
        _line(panel("country"), order, 4, item).alias("countries"),
    )
    summary = head.select(
        F.lit(0).alias("slot"),
        F.lit("footprint").alias("type"),
        F.concat(
            F.lit(f"{group.upper()}: "),
            _thousands(F.col("n")),
            F.lit(" leak-site victims. Top sectors: "),
            fn.text("sectors"),
            F.when(fn.text("countries") != "", F.concat(F.lit(". Countries: "), F.col("countries"))).otherwise(""),
        ).alias("text"),
        no_urls.alias("urls"),
    )
    cases = top_n(incidents_by_group(incidents, group), 8, "victim", "_id")
    told = F.left(
        F.coalesce(F.nullif("summary", F.lit("")), F.col("financial.text"), F.lit("")), F.lit(200)
    )
    case_rows = cases.select(
        F.lit(1).alias("slot"),
        F.lit("Incident").alias("type"),
        F.concat("victim", F.lit(" ("), "industry", F.lit("): "), told).alias("text"),
        F.slice("sources", 1, 3).alias("urls"),
    )
    recent = latest(by_group_prefix(postings, group), 15)
    names = _line(recent, [F.desc_nulls_last("attackdate"), "victim", "_id"], 12, F.col("victim"))
    recent_row = head.select(names.alias("names")).filter(fn.text("names") != "").select(
        F.lit(2).alias("slot"),
        F.lit("recent victims").alias("type"),
        F.concat(F.lit("Recent leak-site victims: "), "names").alias("text"),
        no_urls.alias("urls"),
    )
    return summary.unionByName(case_rows).unionByName(recent_row)


def analytical_evidence(postings: DataFrame, incidents: DataFrame, sector: str | None = None) -> DataFrame:
    """Evidence rows (slot, type, text, urls): totals, coverage lines, a named sector's groups."""
    no_urls = F.array().cast("array<string>").alias("urls")
    totals = postings.agg(
        F.count(F.lit(1)).alias("victims"),
        F.count_distinct("group").alias("groups"),
        F.count_distinct("country").alias("countries"),
    ).withColumn("incidents", incidents.agg(F.count(F.lit(1))).scalar())
    rows = totals.select(
        F.lit(0).alias("slot"),
        F.lit("totals").alias("type"),
        F.concat(
            _thousands(F.col("victims")),
            F.format_string(
                " leak-site victims across %d groups and %d countries; %d researched incidents.",
                "groups",
                "countries",
                "incidents",
            ),
        ).alias("text"),
        no_urls,
    )
    lines = coverage(incidents).select(
        (F.col("slot") + 1).alias("slot"),
        F.lit("coverage").alias("type"),
        F.format_string("%s: %d of %d disclosed (%d%%)", "field", "disclosed", "total", "pct").alias("text"),
        no_urls,
    )
    rows = rows.unionByName(lines)
    if sector is not None:
        item = F.format_string("%s (%d)", F.col("group"), F.col("n"))
        line = _line(top_groups_in(postings, sector), [F.desc("n"), "group"], 8, item)
        top = totals.select(line.alias("line")).filter(fn.text("line") != "").select(
            F.lit(8).alias("slot"),
            F.lit("aggregation").alias("type"),
            F.concat(F.lit("Top groups: "), "line").alias("text"),
            no_urls,
        )
        rows = rows.unionByName(top)
    return rows


def analytical_facts(panels: Mapping[str, DataFrame], postings: DataFrame, sector: str | None = None) -> DataFrame:
    """The figures beside the analytical evidence, as rows (fact, name, value), from the insight panels."""
    row = lambda fact, name, value: F.struct(
        F.lit(fact).alias("fact"), fn.text(name).alias("name"), F.col(value).cast("double").alias("value")
    )
    totals = [row(c, F.lit(""), c) for c in ("total_victims", "group_count", "country_count", "researched_incidents")]
    parts = [panels["totals"].select(F.explode(F.array(*totals)).alias("r"))]
    listed = {
        "by_sector": ("sector", "n"), "by_year": ("year", "n"), "top_groups": ("group", "n"), "top_countries": ("country", "n"),
        "coverage": ("field", "disclosed"), "costliest": ("victim", "usd"), "largest_ransoms": ("victim", "usd"),
    }
    for fact, (name, value) in listed.items():
        parts.append(panels[fact].select(row(fact, F.col(name).cast("string"), value).alias("r")))
    if sector is not None:
        parts.append(top_groups_in(postings, sector).select(row("top_groups_in", F.col("group"), "n").alias("r")))
    return reduce(DataFrame.unionByName, parts).select("r.*")


def entity_facts(postings: DataFrame, group: str) -> DataFrame:
    """The figures beside the evidence about one group, as rows (fact, name, value)."""
    return entity_footprint(postings, group).select(F.col("panel").alias("fact"), "name", F.col("n").cast("double").alias("value"))
