"""The property graph: construction, hops, paths and pattern operators.

Nodes are one DataFrame per label, edges one DataFrame. Paths come back as their edges;
they are found with semi joins, so a hub never multiplies its neighbours on both sides.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import cache, partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier import functions as fn
from dossier import rules, schemas
from dossier.functions.keys import col
from dossier.operators.ranking import last_values, ranked_list
from dossier.operators.tables import (
    explode_categories,
    explode_incidents,
    explode_stats,
    require,
)
from dossier.session import stored

EDGE = ["from", "from_label", "type", "to", "to_label"]


class Lazy(Mapping):
    """Named DataFrames, each planned when it is first asked for."""

    def __init__(self, builders: Mapping[str, Callable[[], DataFrame]]):
        self._builders, self._built = dict(builders), {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name]()
        return self._built[name]

    def __iter__(self):
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)


class Graph:
    """Nodes by label and edges, either as one table or by type.

    ``by_type`` lets a query plan the edge types it needs and nothing else.
    """

    def __init__(
        self,
        nodes: Mapping[str, DataFrame],
        edges: DataFrame | Callable[[], DataFrame],
        by_type: Mapping[str, DataFrame] | None = None,
    ):
        self.nodes, self._edges, self.by_type = nodes, edges, by_type

    @property
    def edges(self) -> DataFrame:
        if callable(self._edges):
            self._edges = self._edges()
        return self._edges

    def of_type(self, types: str | Sequence[str] | None) -> DataFrame:
        """Edges of one type, of several, or of any."""
        if types is None:
            return self.edges
        types = [types] if isinstance(types, str) else list(types)
        if self.by_type is None:
            return self.edges.filter(F.col("type").isin(types))
        known = [self.by_type[t] for t in types if t in self.by_type]
        return reduce(DataFrame.unionByName, known) if known else self.edges.limit(0)

    def node_keys(self) -> DataFrame:
        """(label, id) of every node."""
        keys = [df.select(F.lit(label).alias("label"), "id") for label, df in self.nodes.items()]
        return reduce(DataFrame.unionByName, keys)


def edge_rows(
    df: DataFrame,
    source: Column | str,
    source_label: str,
    type: str,
    target: Column | str,
    target_label: str,
    complete: bool = False,
) -> DataFrame:
    """Edges from two id expressions; rows that miss an end are dropped.

    ``complete`` says that no row can miss one, which saves the test.
    """
    edges = df.select(
        col(source).cast("string").alias("from"),
        F.lit(source_label).alias("from_label"),
        F.lit(type).alias("type"),
        col(target).cast("string").alias("to"),
        F.lit(target_label).alias("to_label"),
    )
    return edges if complete else require(edges, "from", "to")


# --- construction -----------------------------------------------------------


def category_mentions(industries: DataFrame, types: Sequence[str] = ("hazard", "exposure")) -> DataFrame:
    """Categories as reported, once per distinct text of an industry, with the last place of that text and all keys.

    Keys are built here and nowhere else; a caller that stores the rows builds each of them once.
    """
    rows = explode_categories(industries, types).filter(fn.has_key("category"))
    texts = rows.groupBy("industry", "type", "category", "description", "subcategories").agg(
        F.max(F.struct("_pos", "slot")).alias("place")
    )
    keyed = texts.withColumns({"key": fn.norm_key("category"), "label": _label()})
    subs = F.transform("subcategories", lambda s: F.struct(s.alias("name"), fn.norm_key(s).alias("key")))
    return keyed.withColumn("subs", subs).drop("subcategories")


def category_nodes(industries: DataFrame, type: str) -> DataFrame:
    """Hazard or exposure nodes; the last label and description reported for a key count."""
    return _category_nodes(category_mentions(industries, [type]), type)


def _category_nodes(mentions: DataFrame, type: str) -> DataFrame:
    named = mentions.filter(F.col("type") == type).select(
        F.col("key").alias("id"),
        F.col("category").alias("name"),
        fn.clip("description", rules.CLIP["description"]).alias("description"),
        "place",
        "industry",
    )
    return last_values(named, "id", ["name", "description"], "place._pos", "industry", "place.slot")


def _subcategories(mentions: DataFrame) -> DataFrame:
    """One row per subcategory of a mention."""
    rows = mentions.select("industry", "label", "category", "key", "place", F.posexplode("subs").alias("sub_slot", "sub"))
    return rows.withColumn("id", F.concat("key", F.lit("::"), "sub.key"))


def subcategory_nodes(industries: DataFrame) -> DataFrame:
    return _subcategory_nodes(category_mentions(industries))


def _subcategory_nodes(mentions: DataFrame) -> DataFrame:
    exposures_last = (F.col("label") == "Exposure").alias("_kind")
    rows = _subcategories(mentions).select(
        "id",
        F.col("sub.name").alias("name"),
        F.col("category").alias("parent"),
        F.lower("label").alias("kind"),
        F.struct("place._pos", "industry", exposures_last, "place.slot", "sub_slot").alias("_place"),
    )
    return last_values(rows, "id", ["name", "parent", "kind"], "_place")


def industry_nodes(industries: DataFrame, synthesis: DataFrame | None = None) -> DataFrame:
    """Industry nodes with clipped overview and, where the synthesis has them, differentiators."""
    rows = require(industries, "industry").select(
        F.col("industry").alias("id"),
        fn.text("ransomware_live_sector").alias("sector_tag"),
        fn.size_of("example_incidents").alias("incident_count"),
        fn.clip("overview", rules.CLIP["overview"]).alias("overview"),
        (F.col("_pos") if "_pos" in industries.columns else F.lit(0)).alias("_pos"),
    )
    nodes = last_values(rows, "id", ["sector_tag", "incident_count", "overview"], "_pos", "overview")
    texts = ["distinct", "extortion_leverage", "downtime_tolerance"]
    if synthesis is None:
        return nodes.withColumns({c: F.lit("") for c in texts})
    entries = synthesis.select(F.posexplode("industry_differentiators").alias("_slot", "_d")).select(
        fn.norm_key("_d.industry").alias("_key"),
        "_slot",
        fn.clip("_d.what_makes_it_distinct", rules.CLIP["distinct"]).alias("distinct"),
        fn.clip("_d.primary_extortion_leverage", rules.CLIP["extortion_leverage"]).alias("extortion_leverage"),
        fn.clip("_d.downtime_tolerance", rules.CLIP["downtime_tolerance"]).alias("downtime_tolerance"),
    )
    first = nodes.groupBy(fn.norm_key("id").alias("_key")).agg(F.min("id").alias("id"))
    matched = last_values(entries, "_key", texts, "_slot").join(first, "_key").drop("_key")
    return nodes.join(matched, "id", "left").na.fill("", texts)


def _incidents(industries: DataFrame) -> DataFrame:
    return require(explode_incidents(industries), "victim").withColumn(
        "id", F.concat("industry", F.lit("::"), "victim")
    )


def incident_nodes(industries: DataFrame) -> DataFrame:
    clipped = {
        "financial_impact": "financial_impact",
        "ransom": "ransom_demanded_or_paid",
        "downtime": "downtime_and_recovery",
        "data_impact": "data_impact",
        "summary": "summary",
    }
    rows = _incidents(industries).select(
        "id",
        "victim",
        fn.text("date").alias("date"),
        fn.text("country").alias("country"),
        *[fn.clip(c, rules.CLIP[name]).alias(name) for name, c in clipped.items()],
        fn.size_of("sources").alias("source_count"),
        "_pos",
        "slot",
    )
    return last_values(rows, "id", schemas.NODE_FIELDS["Incident"][1:], "_pos", "slot")


def group_mentions(industries: DataFrame, strip_first: bool = False) -> DataFrame:
    """(incident id, group name) for every attacker an incident names."""
    return _incidents(industries).select(
        "id", F.explode(fn.split_groups("group", strip_first)).alias("name")
    )


def _bulk_groups(raw_postings: DataFrame) -> DataFrame:
    """Postings that name a victim and a group. A bulk group's id is its name as posted, as node and as edge end."""
    named = lambda c: fn.strip(fn.text(c)) != ""
    return raw_postings.filter(named("victim") & named("group"))


def group_nodes(
    industries: DataFrame, raw_postings: DataFrame | None = None, strip_first: bool = False
) -> DataFrame:
    ids = group_mentions(industries, strip_first).select(F.col("name").alias("id"))
    if raw_postings is not None:
        ids = ids.unionByName(_bulk_groups(raw_postings).select(F.col("group").alias("id")))
    return require(ids, "id").distinct()


def company_nodes(industries: DataFrame) -> DataFrame:
    return _incidents(industries).select(F.col("victim").alias("id")).distinct()


def country_nodes(industries: DataFrame) -> DataFrame:
    return require(
        _incidents(industries).select(fn.clean_country("country").alias("id")), "id"
    ).distinct()


def _cited(industries: DataFrame) -> DataFrame:
    rows = _incidents(industries).select("id", F.explode("sources").alias("url"))
    return rows.filter(fn.is_url("url"))


def source_nodes(industries: DataFrame) -> DataFrame:
    urls = _cited(industries).select(F.col("url").alias("id")).distinct()
    return urls.withColumn("host", fn.host_of("id"))


def _statistics(industries: DataFrame) -> DataFrame:
    rows = require(explode_stats(industries), "metric")
    return rows.withColumn("id", F.concat("industry", F.lit("::"), fn.norm_key("metric")))


def statistic_nodes(industries: DataFrame, synthesis: DataFrame | None = None) -> DataFrame:
    def fields(clip: int, scope: str) -> list[Column | str]:
        return [
            "id",
            "metric",
            fn.clip("value", clip).alias("value"),
            fn.text("source").alias("source"),
            fn.text("source_url").alias("source_url"),
            F.lit(scope).alias("scope"),
            "_pos",
            "slot",
        ]

    rows = _statistics(industries).select(*fields(rules.CLIP["stat_value"], "industry"))
    if synthesis is not None:
        losses = synthesis.select(
            F.lit(0).alias("_pos"), F.posexplode("global_aggregate_losses").alias("slot", "_s")
        ).select("_pos", "slot", "_s.*")
        overall = require(losses, "metric").withColumn(
            "id", F.concat(F.lit("GLOBAL::"), fn.norm_key("metric"))
        )
        rows = rows.unionByName(overall.select(*fields(rules.CLIP["global_stat_value"], "global")))
    return last_values(rows, "id", schemas.NODE_FIELDS["Statistic"][1:], "_pos", "slot")


def theme_nodes(synthesis: DataFrame) -> DataFrame:
    """Cross-cutting themes; an exposure theme replaces a hazard theme of the same key."""
    kinds = [("common_hazard_themes", "hazard", 0), ("common_exposure_themes", "exposure", 1)]
    rows = [
        synthesis.select(
            F.lit(kind).alias("kind"), F.lit(rank).alias("_kind"), F.posexplode(field).alias("slot", "name")
        )
        for field, kind, rank in kinds
    ]
    named = reduce(DataFrame.unionByName, rows).withColumn(
        "id", F.left(fn.norm_key("name"), F.lit(rules.CLIP["theme_key"]))
    )
    return last_values(require(named, "id"), "id", ["name", "kind"], "_kind", "slot")


def victim_nodes(raw_postings: DataFrame) -> DataFrame:
    """Bulk victims merged by (name, sector); the last posting's values count."""
    rows = raw_postings.filter(fn.strip(fn.text("victim")) != "").select(
        F.col("victim").alias("name"),
        fn.text("activity").alias("sector"),
        F.left(fn.text("attackdate"), F.lit(10)).alias("attackdate"),
        fn.text("country").alias("country"),
        fn.text("domain").alias("domain"),
        F.when(fn.text("press") != "", "yes").otherwise("").alias("has_press"),
        (F.col("_pos") if "_pos" in raw_postings.columns else F.lit(0)).alias("_pos"),
    )
    props = ["attackdate", "country", "domain", "has_press"]
    merged = last_values(rows, ["name", "sector"], props, "_pos", *props)
    return merged.select(F.concat("name", F.lit("::"), "sector").alias("id"), "*")


def _label() -> Column:
    return F.when(F.col("type") == "hazard", "Hazard").otherwise("Exposure")


def category_edges(industries: DataFrame, type: str) -> DataFrame:
    """FACES for hazards, EXPOSES for exposures."""
    return _category_edges(category_mentions(industries, [type]), type)


def _category_edges(mentions: DataFrame, type: str) -> DataFrame:
    rows = mentions.filter(F.col("type") == type)
    if type == "hazard":
        return edge_rows(rows, "industry", "Industry", "FACES", "key", "Hazard", complete=True)
    return edge_rows(rows, "industry", "Industry", "EXPOSES", "key", "Exposure", complete=True)


def subcategory_edges(industries: DataFrame) -> DataFrame:
    return _subcategory_edges(category_mentions(industries))


def _subcategory_edges(mentions: DataFrame) -> DataFrame:
    rows = _subcategories(mentions).select(F.col("key").alias("from"), F.col("label").alias("from_label"), F.col("id").alias("to"))
    kind = {"type": F.lit("INCLUDES"), "to_label": F.lit("Subcategory")}
    return rows.withColumns(kind).select(EDGE)


def incident_edges(industries: DataFrame, type: str, strip_first: bool = False) -> DataFrame:
    """Edges of one type that start or end at incidents."""
    if type == "PERPETRATED_BY":
        mentions = group_mentions(industries, strip_first)
        return edge_rows(mentions, "id", "Incident", type, "name", "Group")
    if type == "CITED_BY":
        return edge_rows(_cited(industries), "id", "Incident", type, "url", "Source")
    rows = _incidents(industries)
    if type == "HAD_INCIDENT":
        return edge_rows(rows, "industry", "Industry", type, "id", "Incident")
    if type == "HIT":
        return edge_rows(rows, "id", "Incident", type, "victim", "Company")
    return edge_rows(rows, "id", "Incident", "OCCURRED_IN", fn.clean_country("country"), "Country")


def _edge(source: Column, source_label: Column | str, type: Column | str, target: Column, target_label: Column | str) -> Column:
    parts = [source, source_label, type, target, target_label]
    return F.struct(*[(F.lit(p) if isinstance(p, str) else p).alias(n) for n, p in zip(EDGE, parts, strict=True)])


def all_category_edges(industries: DataFrame) -> DataFrame:
    """FACES, EXPOSES and INCLUDES from one scan."""
    return _all_category_edges(category_mentions(industries))


def _all_category_edges(mentions: DataFrame) -> DataFrame:
    key, label = F.col("key"), F.col("label")
    kind = F.when(F.col("type") == "hazard", "FACES").otherwise("EXPOSES")
    subs = F.transform(
        F.coalesce("subs", F.array().cast("array<struct<name:string,key:string>>")),
        lambda s: _edge(key, label, "INCLUDES", F.concat(key, F.lit("::"), s["key"]), "Subcategory"),
    )
    own = F.array(_edge(F.col("industry"), "Industry", kind, key, label))
    return mentions.select(F.explode(F.concat(own, subs)).alias("e")).select("e.*")


def all_incident_edges(industries: DataFrame, strip_first: bool = False) -> DataFrame:
    """Every edge of the incidents from one scan."""
    id = F.col("id")
    urls = F.filter(F.coalesce("sources", F.array().cast("array<string>")), lambda u: fn.is_url(u))
    own = F.array(
        _edge(F.col("industry"), "Industry", "HAD_INCIDENT", id, "Incident"),
        _edge(id, "Incident", "HIT", F.col("victim"), "Company"),
        _edge(id, "Incident", "OCCURRED_IN", fn.clean_country("country"), "Country"),
    )
    groups = F.transform(
        fn.split_groups("group", strip_first), lambda g: _edge(id, "Incident", "PERPETRATED_BY", g, "Group")
    )
    cited = F.transform(urls, lambda u: _edge(id, "Incident", "CITED_BY", u, "Source"))
    rows = _incidents(industries).select(F.explode(F.concat(own, groups, cited)).alias("e"))
    return require(rows.select("e.*"), "from", "to")


def statistic_edges(industries: DataFrame) -> DataFrame:
    return edge_rows(_statistics(industries), "industry", "Industry", "MEASURED_BY", "id", "Statistic")


def attack_edges(raw_postings: DataFrame) -> DataFrame:
    rows = _bulk_groups(raw_postings)
    victim = F.concat("victim", F.lit("::"), fn.text("activity"))
    return edge_rows(rows, victim, "Victim", "ATTACKED_BY", "group", "Group")


def merge_edges(edges: DataFrame) -> DataFrame:
    """Edges are unique by end points and type."""
    return edges.dropDuplicates(EDGE)


def build_graph(
    industries: DataFrame,
    synthesis: DataFrame | None = None,
    raw_postings: DataFrame | None = None,
    strip_first: bool = False,
) -> Graph:
    """The graph of the records; every label and edge type is planned when a query uses it.

    The mentions of categories are stored when the first label or type that needs them is asked for.
    """
    i = industries
    mentions = cache(lambda: stored(category_mentions(i)))
    nodes = {
        "Industry": lambda: industry_nodes(i, synthesis),
        "Hazard": lambda: _category_nodes(mentions(), "hazard"),
        "Exposure": lambda: _category_nodes(mentions(), "exposure"),
        "Subcategory": lambda: _subcategory_nodes(mentions()),
        "Incident": lambda: incident_nodes(i),
        "Company": lambda: company_nodes(i),
        "Group": lambda: group_nodes(i, raw_postings, strip_first),
        "Country": lambda: country_nodes(i),
        "Statistic": lambda: statistic_nodes(i, synthesis),
        "Source": lambda: source_nodes(i),
    }
    edges = {
        "FACES": lambda: _category_edges(mentions(), "hazard"),
        "EXPOSES": lambda: _category_edges(mentions(), "exposure"),
        "INCLUDES": lambda: _subcategory_edges(mentions()),
        "HAD_INCIDENT": lambda: incident_edges(i, "HAD_INCIDENT"),
        "HIT": lambda: incident_edges(i, "HIT"),
        "PERPETRATED_BY": lambda: incident_edges(i, "PERPETRATED_BY", strip_first),
        "OCCURRED_IN": lambda: incident_edges(i, "OCCURRED_IN"),
        "CITED_BY": lambda: incident_edges(i, "CITED_BY"),
        "MEASURED_BY": lambda: statistic_edges(i),
    }
    if synthesis is not None:
        nodes["Theme"] = lambda: theme_nodes(synthesis)
    if raw_postings is not None:
        nodes["Victim"] = lambda: victim_nodes(raw_postings)
        edges["ATTACKED_BY"] = lambda: attack_edges(raw_postings)

    def every_edge() -> DataFrame:
        parts = [_all_category_edges(mentions()), all_incident_edges(i, strip_first), statistic_edges(i)]
        if raw_postings is not None:
            parts.append(attack_edges(raw_postings))
        return merge_edges(reduce(DataFrame.unionByName, parts))

    merged = Lazy({name: partial(_merged, build) for name, build in edges.items()})
    return Graph(Lazy(nodes), every_edge, merged)


def _merged(build: Callable[[], DataFrame]) -> DataFrame:
    return merge_edges(build())


# --- edges, hops, paths -----------------------------------------------------


def resolve_edges(edges: DataFrame, node_keys: DataFrame, any_label: bool = False) -> DataFrame:
    """Keep edges whose two ends exist.

    With ``any_label`` the source may be a node of any label that has the id; an id found
    under two labels then gives two edges.
    """
    ends = node_keys.select("label", "id")
    target = ends.withColumnsRenamed({"label": "to_label", "id": "to"})
    kept = edges.join(target, ["to", "to_label"], "left_semi")
    source = ends.withColumnsRenamed({"label": "from_label", "id": "from"})
    if any_label:
        kept = kept.drop("from_label").join(source.distinct(), "from")
    else:
        kept = kept.join(source, ["from", "from_label"], "left_semi")
    return kept.select(EDGE)


def hop(
    g: Graph,
    source: str | None = None,
    types: str | Sequence[str] | None = None,
    target: str | None = None,
) -> DataFrame:
    """Edges of the given types between the given labels; None leaves a part open."""
    if types is None and (source or target):
        types = [
            name
            for name, (a, b) in schemas.EDGE_TYPES.items()
            if (source is None or a in (None, source)) and (target is None or b == target)
        ]
    edges = g.of_type(types)
    if source is not None:
        edges = edges.filter(F.col("from_label") == source)
    if target is not None:
        edges = edges.filter(F.col("to_label") == target)
    return edges


def with_target(g: Graph, edges: DataFrame, label: str, *fields: str) -> DataFrame:
    """Edges with properties of their target nodes."""
    props = g.nodes[label].select(F.col("id").alias("to"), *fields)
    return edges.filter(F.col("to_label") == label).join(props, "to")


def rows_of(edges: DataFrame, depth: int = 1) -> DataFrame:
    """Edges in the result form of a path query."""
    return edges.select(
        F.col("from").alias("src"), "type", F.col("to").alias("dst"), F.lit(depth).alias("depth")
    )


def two_hops(first: DataFrame, second: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges of ``first`` and ``second`` that lie on a path of one followed by the other."""
    starts = second.select(F.col("from").alias("to"), F.col("from_label").alias("to_label"))
    kept_first = first.join(starts, ["to", "to_label"], "left_semi").select(EDGE)
    ends = first.select(F.col("to").alias("from"), F.col("to_label").alias("from_label"))
    kept_second = second.join(ends, ["from", "from_label"], "left_semi").select(EDGE)
    return kept_first, kept_second


def path_rows(first: DataFrame, second: DataFrame) -> DataFrame:
    a, b = two_hops(first, second)
    return rows_of(a, 1).unionByName(rows_of(b, 2))


def path(g: Graph, types: Sequence[str]) -> DataFrame:
    """Full paths along a chain of edge types as columns n0, n1, ...; use for low-fan-out chains."""
    out = None
    for i, type in enumerate(types):
        step = g.of_type(type).select(
            F.col("from").alias(f"n{i}"),
            F.col("from_label").alias("_label"),
            F.col("to").alias(f"n{i + 1}"),
            F.col("to_label").alias("_next"),
        )
        if out is None:
            out = step.drop("_label")
        else:
            out = out.withColumnRenamed("_next", "_label").join(step, [f"n{i}", "_label"]).drop("_label")
    return out.select([f"n{i}" for i in range(len(types) + 1)])


def shared_targets(g: Graph, type: str, a: str, b: str) -> DataFrame:
    """Targets that both sources reach: one conditional aggregate, no self join."""
    ends = _reach_of(g.of_type(type), a, b)
    return ends.filter(F.col("in_a") & F.col("in_b")).select("to")


def only_in(g: Graph, type: str, a: str, b: str) -> DataFrame:
    """Targets that ``a`` reaches and ``b`` does not."""
    ends = _reach_of(g.of_type(type), a, b)
    return ends.filter(F.col("in_a") & ~F.col("in_b")).select("to")


def _reach_of(edges: DataFrame, a: str, b: str) -> DataFrame:
    source = F.col("from")
    return (
        edges.filter(source.isin([a, b]))
        .groupBy("to")
        .agg(F.bool_or(source == a).alias("in_a"), F.bool_or(source == b).alias("in_b"))
    )


def groups_in_both(g: Graph, a: str, b: str) -> DataFrame:
    """Groups behind incidents of both industries."""
    paths = path(g, ["HAD_INCIDENT", "PERPETRATED_BY"]).select(
        F.col("n0").alias("from"), F.col("n2").alias("to")
    )
    ends = _reach_of(paths, a, b)
    return ends.filter(F.col("in_a") & F.col("in_b")).select(F.col("to").alias("group"))


def reach(edges: DataFrame) -> DataFrame:
    """Incoming edges per target."""
    return edges.groupBy("to").agg(F.count(F.lit(1)).alias("reach"))


def rematch(g: Graph, type: str, predicate: Column | Callable[[Column], Column]) -> DataFrame:
    """All edges to the targets whose reach passes the predicate."""
    edges = g.of_type(type)
    test = predicate(F.col("reach")) if callable(predicate) else predicate
    return edges.join(reach(edges).filter(test), "to", "left_semi").select(EDGE)


def neighbours(g: Graph, ids: DataFrame) -> DataFrame:
    """Undirected one-hop neighbours of the given nodes (label, id); nodes without any are kept.

    The neighbours stand on the left of a right join, the side that adaptive execution can
    split, so a hub's neighbours are spread over tasks.
    """
    asked = ids.select("label", "id")
    return _near(g, asked).join(asked, ["label", "id"], "right")


def _near(g: Graph, asked: DataFrame) -> DataFrame:
    """Neighbours of the asked nodes: one scan of the edges, cut to those nodes at once."""
    ends = lambda a, z: F.struct(
        F.col(f"{a}_label").alias("label"),
        F.col(a).alias("id"),
        F.col(f"{z}_label").alias("nb_label"),
        F.col(z).alias("nb_id"),
    )
    both = g.edges.select(F.explode(F.array(ends("from", "to"), ends("to", "from"))).alias("e")).select("e.*")
    return both.join(asked, ["label", "id"], "left_semi")


def display_names(g: Graph) -> DataFrame:
    """(label, id, name) of the nodes that have a name or a victim; all others go by their id."""
    shown = {label: c for label, fields in schemas.NODE_FIELDS.items() for c in ("victim", "name") if c in fields}
    shown["Victim"] = "name"
    parts = [
        g.nodes[label].select(F.lit(label).alias("label"), "id", F.col(c).alias("name"))
        for label, c in shown.items()
        if label in g.nodes
    ]
    return reduce(DataFrame.unionByName, parts)


def neighbour_context(g: Graph, ids: DataFrame, n: int = 6) -> DataFrame:
    """Per node the first ``n`` distinct neighbour names; hubs are cut before the shuffle."""
    asked = ids.select("label", "id")
    names = display_names(g).withColumnsRenamed({"label": "nb_label", "id": "nb_id"})
    near = _near(g, asked).join(names, ["nb_label", "nb_id"], "left")
    distinct = near.select("label", "id", F.coalesce("name", "nb_id").alias("name")).distinct()
    lists = ranked_list(distinct, ["label", "id"], n, {"name": F.col("name")}, "name")
    empty = F.array().cast("array<string>")
    return asked.join(lists, ["label", "id"], "left").select(
        "label", "id", F.coalesce(F.col("items.name"), empty).alias("linked")
    )


def cited_sources(g: Graph, ids: DataFrame, n: int = 4) -> DataFrame:
    """Per node up to ``n`` source URLs: its own, then those of neighbouring incidents.

    A URL found both ways is listed twice, as the two lists are simply joined.
    """
    asked = ids.select("label", "id")
    cited = g.of_type("CITED_BY")
    own = cited.select(
        F.col("from_label").alias("label"), F.col("from").alias("id"), F.col("to").alias("url")
    ).join(asked, ["label", "id"], "left_semi")
    near = _near(g, asked).filter(F.col("nb_label") == "Incident")
    via = near.join(
        cited.filter(F.col("from_label") == "Incident").select(
            F.col("from").alias("nb_id"), F.col("to").alias("url")
        ),
        "nb_id",
    ).select("label", "id", "url")
    first = lambda df: ranked_list(
        df.distinct(), ["label", "id"], n, {"url": F.col("url")}, "url"
    )
    empty = F.array().cast("array<string>")
    return (
        asked.join(first(own).withColumnRenamed("items", "_own"), ["label", "id"], "left")
        .join(first(via).withColumnRenamed("items", "_via"), ["label", "id"], "left")
        .select(
            "label",
            "id",
            F.slice(
                F.concat(F.coalesce(F.col("_own.url"), empty), F.coalesce(F.col("_via.url"), empty)), 1, n
            ).alias("urls"),
        )
    )


def graph_counts(g: Graph) -> DataFrame:
    """Nodes per label and edges per type."""
    nodes = g.node_keys().groupBy(F.lit("node").alias("kind"), F.col("label").alias("name"))
    edges = g.edges.groupBy(F.lit("edge").alias("kind"), F.col("type").alias("name"))
    n = F.count(F.lit(1)).alias("n")
    return nodes.agg(n).unionByName(edges.agg(n))


def graph_export(g: Graph) -> tuple[DataFrame, DataFrame]:
    """Nodes and links for a viewer: ids are ``Label:id``, sources and links to them are left out."""
    nodes = [
        df.select(
            F.concat(F.lit(f"{label}:"), "id").alias("id"),
            F.lit(label).alias("label"),
            F.to_json(F.struct(*[c for c in df.columns if c != "id"])).alias("props")
            if len(df.columns) > 1
            else F.lit("{}").alias("props"),
        )
        for label, df in g.nodes.items()
        if label != "Source"
    ]
    links = g.edges.filter(F.col("to_label") != "Source").select(
        F.concat_ws(":", "from_label", "from").alias("source"),
        F.concat_ws(":", "to_label", "to").alias("target"),
        "type",
    )
    return reduce(DataFrame.unionByName, nodes), links
