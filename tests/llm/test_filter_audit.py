from itertools import permutations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.llm import filter_audit
from dossier.llm.queries import SQL
from oracle_check import compare

LABELS = "doc_id long, quality int, toxic int, text string"


def brute(rows, marks):
    """Filter by filter, one document at a time."""
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    documents = []
    for i, text, part in rows:
        text = text or ""
        words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
        fails = "".join(
            letter
            for letter, failing in {
                "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
                "D": any(c in text for c in "#$%&*|"), "E": i is not None and first[text] < i,
            }.items()
            if failing
        )
        documents.append((part or "", fails, (i, "q") in marks, (i, "t") in marks))
    out = {}
    for part in {d[0] for d in documents}:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = [d for d in documents if d[0] == part]
            for step, letter in enumerate(order, 1):
                gone = [d for d in left if letter in d[1]]
                failing = [d for d in documents if d[0] == part and letter in d[1]]
                left = [d for d in left if letter not in d[1]]
                shapley[letter] += len(gone)
                out[part, order, step] = [len(left), len(gone), len(failing) - len(gone), sum(d[1] == letter for d in failing), sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for order in map("".join, permutations("ABCDE")):
            for step, letter in enumerate(order, 1):
                out[part, order, step].append(shapley[letter])
    return {(*k, *v) for k, v in out.items()}


def tables(spark, rows, labels):
    schema = T.StructType([T.StructField(n, k) for n, k in (("doc_id", T.LongType()), ("text", T.StringType()), ("source", T.StringType()), ("part", T.IntegerType()), ("mask", T.StringType()), ("n.dot", T.StringType()))])
    return spark.createDataFrame([(*r, 1, "m", "d") for r in rows], schema), spark.createDataFrame([(*r, "x") for r in labels], LABELS)


LONG = " ".join(f"word{i}" for i in range(300))
ROWS = [
    (1, LONG, "a"), (2, LONG, "b"), (2, LONG, "b"), (3, LONG + " $", "a"), (4, "SHOUT " * 250, "a"), (5, None, None), (6, "", ""), (7, "", "b"), (None, LONG, "a"),
    (None, "", None), (1, LONG, "b"), (8, "AB" + "c" * 98, "b"), (9, "ABC" + "c" * 97, "b"), (10, "a b\x0bc\x0cd\xa0e", "c"), (11, "one two one two one", "c"), (12, "ünï " * 60_000, "c"), (13, "x" * 70_000, "c"),
]
MARKS = [(1, 1, 0), (1, 0, 1), (3, 1, 1), (4, None, 1), (None, 1, 1), (99, 1, 1), (7, 1, None)]


def test_agrees_with_brute_force_and_sql(spark):
    docs, labels = tables(spark, ROWS, MARKS)
    made = filter_audit.audit(docs, labels)
    marks = {(i, k) for i, q, t in MARKS if i is not None for k, v in (("q", q), ("t", t)) if v == 1}
    rows = [tuple(r) for r in made.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(ROWS, marks)
    import duckdb

    db = duckdb.connect()
    db.register("documents", docs.select("doc_id", "text", "source").toArrow())
    db.register("labels", labels.toArrow())
    assert compare(made, db, SQL["op11_filter_audit"]) == ""


def test_random_masks_and_other_filters(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), "w " * int(n), f"s{i % 3}") for i, n in enumerate(rng.integers(0, 5, 60))]
    docs, labels = tables(spark, rows, [])
    checks = {"X": F.col("n_words") < 2, "Y": F.col("n_words") > 2}
    made = {tuple(r)[:5] for r in filter_audit.audit(docs, labels, checks, "Z").collect()}
    assert len(made) == 3 * 6 * 3
    for part in ("s0", "s1", "s2"):
        mine = [r for r in rows if r[2] == part]
        x = [r for r in mine if r[1].count("w") < 2]
        assert (part, "XYZ", 1, len(mine) - len(x), len(x)) in made


def test_removal_steps_are_the_first_failing_filter():
    orders, place = filter_audit.orders_of("ABCD")
    masks = np.array([[m >> i & 1 == 1 for i in range(4)] for m in range(16)])
    steps = filter_audit.removal_steps(masks, place)
    for mask, row in zip(masks, steps):
        failing = {"ABCD"[i] for i in range(4) if mask[i]}
        assert [next((k for k, x in enumerate(o) if x in failing), 4) for o in orders] == list(row)


def test_empty(spark):
    docs, labels = tables(spark, [], [])
    assert filter_audit.audit(docs, labels).collect() == []
