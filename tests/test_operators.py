import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier import schemas
from dossier.operators import graph as gr
from dossier.operators import insights as ins
from dossier.operators import intake, matching, quality, ranking, tables, taxonomy
from dossier.operators import retrieval as rt
from dossier.sources import writers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def category(name, description="", subs=()):
    return (name, description, list(subs))


def industries(spark, *rows):
    """(name, hazards, exposures, incidents) -> nested records in order."""
    out = []
    for i, (name, hazards, exposures, cases) in enumerate(rows):
        full = [tuple({**dict.fromkeys(schemas.INCIDENT.names), **c}.values()) for c in cases]
        out.append((name, "Tag", "text", hazards, exposures, full, [("m", "1", None, None)], i))
    schema = T.StructType([*schemas.INDUSTRY.fields, T.StructField("_pos", T.IntegerType())])
    return spark.createDataFrame(out, schema)


def test_richest_record_wins_and_first_of_equals(spark):
    few, more = [category("A")], [category("A"), category("B")]
    df = industries(
        spark,
        ("X (ransomware.live sector a)", few, [], []),
        ("X", more, [], []),
        ("X", more, [category("E")][:0], []),
        ("Y", [], [], []),
    )
    rows = tables.dedupe_richest(df).orderBy("industry").collect()
    assert [(r.industry, r._pos) for r in rows] == [("X", 1), ("Y", 3)]


def test_category_texts_last_for_graph_longest_for_documents(spark):
    df = industries(
        spark,
        ("X", [category("Net Risk", "long text")], [], []),
        ("Y", [category("net-risk", "short")], [], []),
    )
    node = gr.category_nodes(df, "hazard").first()
    assert (node.id, node.name, node.description) == ("net risk", "net-risk", "short")
    doc = taxonomy.taxonomy(df).first()
    assert (doc.description, doc.reach, doc.industry_reach) == ("long text", 2, 2)


def test_graph_of_one_incident(spark):
    case = dict(victim="V", group="A (x; y) and B", country="US (TX)", sources=["https://www.s.org/1", "note"])
    g = gr.build_graph(industries(spark, ("X", [category("H", "", ["S"])], [category("E")], [case, {}])))
    rows = {(r["type"], r["from"], r["to"]) for r in g.edges.collect()}
    assert rows == {
        ("FACES", "X", "h"), ("EXPOSES", "X", "e"), ("INCLUDES", "h", "h::s"), ("HAD_INCIDENT", "X", "X::V"),
        ("HIT", "X::V", "V"), ("PERPETRATED_BY", "X::V", "A (x"), ("PERPETRATED_BY", "X::V", "y)"),
        ("PERPETRATED_BY", "X::V", "B"), ("OCCURRED_IN", "X::V", "US"), ("CITED_BY", "X::V", "https://www.s.org/1"),
        ("MEASURED_BY", "X", "X::m"),
    }
    assert g.nodes["Source"].first().host == "s.org"
    assert gr.resolve_edges(g.edges, g.node_keys()).count() == len(rows)


def test_long_lists_are_rows(spark):
    many = [category("H" + str(i % 3), "", [f"s{i}"]) for i in range(12)]
    rows = taxonomy.taxonomy_members(industries(spark, *[(f"I{k}", many, [], []) for k in range(1000)]))
    assert rows.count() == 12_000 and rows.filter("industry_id = 'i7'").count() == 12
    ids = spark.range(12_000).selectExpr("'x' AS industry_id", "concat('x--', id) AS _id")
    both = tables.with_incident_ids(spark.createDataFrame([("X",), ("Y",)], "industry string"), ids)
    assert sorted((r.industry_id, r["count"]) for r in both.groupBy("industry_id").count().collect()) == [("x", 12_000), ("y", 1)]


def test_rank_filters_limit_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    top = ranking.top_n_per(df, "k", 2, F.desc("id"))
    text = plan(top)
    assert text.index("Exchange") < text.rindex("WindowGroupLimit")
    assert sorted((r.k, r.id) for r in top.collect()) == [(0, 996), (0, 999), (1, 994), (1, 997), (2, 995), (2, 998)]


def test_unnamed_group_holds_a_place(spark):
    rows = [(None, "s", "s")] * 3 + [("a", "s", "s")] * 2 + [("b", "s", "s"), ("c", "t", "t")]
    df = spark.createDataFrame(rows, "`group` string, sector string, sector_key string")
    assert [tuple(r) for r in rt.top_groups_in(df, "s", 2).collect()] == [("a", 2)]


def test_heatmap_fills_empty_cells(spark):
    df = spark.createDataFrame([("a", "s"), ("a", "s"), ("b", "t"), (None, "u")], "`group` string, sector_key string")
    cells = {(r.group, r.sector_key): r.n for r in ins.heatmap(df, 1).collect()}
    assert cells == {("a", "s"): 2, ("a", "t"): 0, ("a", "u"): 0}


def test_presence_matrix_fills_the_given_axis(spark):
    df = spark.createDataFrame([("k", "x"), ("l", "y"), ("l", "y"), (None, "z"), ("k", None)], "key string, industry string")
    rows = sorted(((r.key, r.industry, r.present) for r in taxonomy.presence_matrix(df, "key", "industry", ["x", "y"]).collect()), key=repr)
    assert rows == sorted([("k", "x", 1), ("k", "y", 0), ("l", "x", 0), ("l", "y", 1), (None, "x", 0), (None, "y", 0)], key=repr)
    wide = [f"c{i}" for i in range(6000)]
    assert taxonomy.presence_matrix(df, "key", "industry", wide).count() == 3 * 6000
    assert taxonomy.presence_matrix(df, "key", "industry", []).count() == 0


def test_upsert_is_idempotent(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "k int, v string")
    once = writers.upsert(base, new, "k", F.desc("v"))
    twice = writers.upsert(once, new, "k", F.desc("v"))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "a"), (2, "d"), (3, "e")]


def test_findings(spark):
    df = industries(spark, ("X", [], [category("E")], [dict(victim="V", sources=["ftp://x"]), dict(victim="")]))
    found = {(r.rule, r.message) for r in quality.validate(df).collect()}
    assert ("hazards", "only 0 hazard categories") in found and ("victim", "incident with no victim name") in found
    assert ("source_url", '"V" has a non-URL source: ftp://x') in found
    assert ("stat_source", 'stat "m" has no source attribution') in found and ("sources", '"" has no sources') in found


def _sequential(records, known, have):
    """The batch taken in record by record."""
    import re

    from dossier import rules

    def key(name):
        return re.sub(r"[^a-z0-9]+", " ", re.sub(rules.COMPANY_SUFFIX, " ", name.lower())).strip()

    seen, have, out = set(), set(have), {}
    for pos, kind, industry, victim in records:
        v = victim.strip().lower()
        if key(victim) and key(victim) in seen:
            status = "skip:duplicate-in-batch"
        elif kind not in rules.ACCEPTED_INCIDENT_TYPES:
            status = f"skip:{kind}"
        elif industry in ("", "UNKNOWN"):
            status = "skip:industry-unknown"
        elif not v or re.match(rules.PLACEHOLDER_VICTIM, victim.strip()):
            status = "skip:no-victim"
        elif industry not in known:
            status = f"skip:no-such-industry:{industry}"
        elif v in have:
            status = "skip:duplicate"
        else:
            status = "added"
            have.add(v)
            seen.add(key(victim))
        out[pos] = status
    return out


@pytest.mark.parametrize("seed", range(3))
def test_intake_equals_one_by_one(spark, seed):
    random.seed(seed)
    victims = ["Acme Inc", "ACME", "acme ", "The Group", "the group", "Bolt", "Old", "N/A", "", "Nut Co"]
    records = [
        (i, random.choice(["ransomware", "data-extortion", "other-cyber"]), random.choice(["X", "X", "Y", "UNKNOWN", ""]), random.choice(victims))
        for i in range(120)
    ]
    df = spark.createDataFrame(records, "_pos int, incident_type string, industry string, victim string")
    known = spark.createDataFrame([("X",)], "industry string")
    existing = spark.createDataFrame([(" old ",)], "victim string")
    got = intake.intake_status(df, known, existing).select("_pos", "status").collect()
    assert {r._pos: r.status for r in got} == _sequential(records, {"X"}, {"old"})


def test_contained_names_equal_brute_force(spark):
    random.seed(7)
    word = lambda n: "".join(random.choices("abé .-", k=n))
    texts = [(i, word(random.randint(0, 60))) for i in range(80)] + [(99, None)]
    names = {word(n) for n in (1, 1, 2, 3, 4, 5, 7, 8, 9, 16, 17) for _ in range(4)} | {t[3:25].upper() for _, t in texts[:20]}
    expected = {(i, n.lower()) for i, t in texts if t for n in names if n and n.lower() in t.lower()}
    df = spark.createDataFrame(texts, "i int, t string")
    got = matching.contained_names(df, ["i"], "t", spark.createDataFrame([(n,) for n in names], "name string"))
    rows = [(r.i, r.needle) for r in got.collect()]
    assert set(rows) == expected and len(rows) == len(expected)


def test_names_where_keys_repeat_or_are_missing(spark):
    posts = spark.createDataFrame([(1, "alpha one"), (1, "beta two"), (None, "alpha x"), (2, None), (3, "")], "i int, t string")
    names = spark.createDataFrame([("beta", 1), ("alpha", 2)], "name string, position int")
    found = matching.contained_names(posts, ["i"], "t", names).collect()
    assert sorted(((r.i, r.needle) for r in found), key=repr) == [(1, "alpha"), (1, "beta"), (None, "alpha")]
    told = matching.corroborate(posts, names, title="t").collect()
    assert sorted(((r.i, r.t, r.matched_victim) for r in told), key=repr) == [(1, "alpha one", "alpha"), (1, "beta two", "beta"), (None, "alpha x", "alpha")]


def test_stands_alone_looks_at_every_place(spark):
    rows = [("akira2 akira", "akira", True), ("xakira akira2", "akira", False), ("a+b", "+", False), ("a + b", "+", True), ("play", "play", True), ("", "a", False), ("é-play-é", "play", True)]
    df = spark.createDataFrame(rows, "t string, n string, wanted boolean")
    assert df.filter(matching.stands_alone(F.col("t"), F.col("n")) != F.col("wanted")).count() == 0


def test_group_detection(spark):
    asked = [
        "Attacks by LockBit 3.0?", "who is play", "Did Play hit them?", "akira and akira2", "xakira", "A+B\\E gang", "Noberus or play",
    ]
    q = spark.createDataFrame(list(enumerate(asked)), "question_id int, question string")
    groups = spark.createDataFrame([("play",), ("akira",), ("akira2",), ("lockbit3",), ("a+b\\e",), ("ak",)], "name string")
    found = rt.detect_group(q, groups).orderBy("question_id")
    assert [r.group for r in found.collect()] == ["lockbit3", None, "play", "akira2", None, "a+b\\e", "alphv"]
    lanes = rt.route(q, groups).orderBy("question_id").collect()
    assert [r.lane for r in lanes][:2] == ["entity", "semantic"]


def test_vectors_and_evidence_order(spark):
    rows = [("Incident", i, f"t{i}", [1.0 - i / 10, i / 10]) for i in range(6)] + [("Hazard", 9, "t0", [1.0, 0.0])]
    v = spark.createDataFrame(rows, "label string, id int, text string, embedding array<float>")
    hits = rt.vector_topk_by_type(v, [1.0, 0.0]).collect()
    assert [(r.label, r.id) for r in hits] == [("Incident", 0), ("Incident", 1), ("Incident", 2)]
    assert [r.id for r in rt.vector_topk(v, [0.0, 1.0], 2).collect()] == [5, 4]


def test_vectors_that_do_not_fit_have_no_score(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0]), (3, None), (4, [None, 1.0]), (5, [0.5, 0.5]), (6, [])]
    v = spark.createDataFrame(rows, "id int, embedding array<double>")
    hits = rt.vector_topk(v, [1.0, 0.0], 6).collect()
    assert [(r.id, r.score) for r in hits] == [(1, 1.0), (5, 0.5), (2, None), (3, None), (4, None), (6, None)]
    assert sorted((r.id, r["size"]) for r in quality.check_vectors(v, 2).collect()) == [(2, 1), (3, None), (4, 2), (6, 0)]


def test_bulk_victims_merge(spark):
    rows = [("V", "S", "g", "2020", 1), ("V", "S", "h", "2021", 2), ("V", "T", " ", "2022", 3)]
    df = spark.createDataFrame(rows, "victim string, activity string, `group` string, attackdate string, _pos int")
    df = df.withColumns({c: F.lit("") for c in ("country", "domain", "press")})
    assert {(r.sector, r.attackdate) for r in gr.victim_nodes(df).collect()} == {("S", "2021"), ("T", "2022")}
    assert {(r["from"], r["to"]) for r in gr.attack_edges(df).collect()} == {("V::S", "g"), ("V::S", "h")}
