"""How filters interact: what each order of them removes, where, and what it costs.

The documents become masses first: how many of a part fail exactly which filters (a mask),
how many of those are marked good or toxic. A mask matrix (0 for a failing filter, far away
for a passing one) and the matrix of each filter's place in every order (the inverse
permutations) are combined by a min-plus product: the least sum is the step that removes
the mask in that order. The masses are scattered to those steps, and counts, redundancies
and Shapley sums follow. Masses are at most 2^filters rows a part, however many documents
there are; whatever depends on the number of documents stays in Spark's aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.session import cut, find_package

WORD = r"[^\x20\x09-\x0D]+"
#: Parts whose rows are made at once: a bound of a task's memory.
PARTS = 64
RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_checks() -> dict[str, Column]:
    """The filters A to D as conditions of failing, over the columns text, words and n_words."""
    capitals = F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))
    return {
        "A": F.col("n_words") < 200,
        "B": 100 * F.size(F.array_distinct("words")) < 50 * F.col("n_words"),
        "C": 100 * capitals > 2 * F.length("text"),
        "D": F.rlike("text", F.lit("[#$%&*|]")),
    }


def orders_of(letters: str) -> tuple[list[str], np.ndarray]:
    """All orders of the filters, and the place (from 0) of each filter in each: filters x orders."""
    orders = ["".join(p) for p in permutations(letters)]
    return orders, np.array([[order.index(letter) for order in orders] for letter in letters])


def removal_steps(fails: np.ndarray, place: np.ndarray) -> np.ndarray:
    """masks x orders: the place of the first failing filter, or the number of filters where none fails.

    The min-plus product of the mask matrix with the places.
    """
    filters = len(place)
    far = np.where(fails, 0, filters)
    return np.minimum((far[:, :, None] + place[None]).min(axis=1), filters)


def audit_parts(part: np.ndarray, mask: np.ndarray, weights: np.ndarray, parts: int, letters: str) -> dict[str, np.ndarray]:
    """Counts of parts x orders x steps from masses: rows of (part, mask) with weights (documents, good, toxic)."""
    filters = len(letters)
    orders, place = orders_of(letters)
    bits = np.arange(1 << filters)[:, None] >> np.arange(filters) & 1 == 1
    steps = removal_steps(bits, place)
    mass = np.zeros((parts, 1 << filters, 3), dtype=np.int64)
    np.add.at(mass, (part, mask), weights)
    gone = np.zeros((parts, len(orders), filters + 1, 3), dtype=np.int64)
    at = np.arange(len(orders))
    for m in range(1 << filters):  # one mask of every part to its step of every order
        gone[:, at, steps[m]] += mass[:, m, None]
    gone = gone[:, :, :filters]
    removed = gone[..., 0]
    at_step = np.argsort(place, axis=0, kind="stable").T  # orders x steps: the filter that stands there
    failing = np.stack([mass[:, bits[:, f], 0].sum(axis=1) for f in range(filters)], axis=1)
    alone = mass[:, 1 << np.arange(filters), 0]
    shapley = np.zeros((parts, filters), dtype=np.int64)
    for f in range(filters):
        shapley[:, f] = removed[:, at, place[f]].sum(axis=1)
    return {
        "kept": mass[:, :, 0].sum(axis=1)[:, None, None] - np.cumsum(removed, axis=2),
        "removed": removed,
        "redundant": failing[:, at_step] - removed,
        "unique_fails": alone[:, at_step],
        "good_lost": gone[..., 1],
        "toxic_lost": gone[..., 2],
        "shapley": shapley[:, at_step],
    }


def interactions(masses: DataFrame, letters: str) -> DataFrame:
    """One row per part, order of the filters and step, zeros included.

    `masses` has (part, mask, n, good, toxic); bit i of a mask is set where the i-th filter
    fails. There are as many orders as permutations, so this is meant for up to six filters.
    """
    find_package(masses.sparkSession)
    orders, _ = orders_of(letters)
    filters = len(letters)
    entry = F.struct("mask", "n", "good", "toxic")
    packed = masses.groupBy("part").agg(F.collect_list(entry).alias("masses"))  # at most 2^filters entries a part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PARTS):
                some = batch.slice(start, PARTS)
                lists = some.column(1)
                owner = np.repeat(np.arange(some.num_rows), lists.value_lengths().to_numpy())
                mask, *weights = (field.to_numpy() for field in lists.flatten().flatten())
                made = audit_parts(owner, mask, np.stack(weights, axis=1), some.num_rows, letters)
                count = len(orders) * filters
                names = some.column(0).take(pa.array(np.repeat(np.arange(some.num_rows), count)))
                order = pa.array(orders).take(pa.array(np.tile(np.repeat(np.arange(len(orders)), filters), some.num_rows)))
                step = pa.array(np.tile(np.arange(1, filters + 1, dtype=np.int32), some.num_rows * len(orders)))
                yield pa.RecordBatch.from_arrays(
                    [names, order, step, *(pa.array(v.ravel()) for v in made.values())], ["part", "filter_order", "step", *made]
                )

    return packed.mapInArrow(run, RESULT)


def masses_of(docs: DataFrame, labels: DataFrame, checks: Mapping[str, Column], id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(part, mask, n, good, toxic); the last bit of the mask is set for texts that a smaller id has too."""
    col = lambda name: F.col(f"`{name}`")
    rows = docs.select(col(id_col).alias("id"), F.coalesce(col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).withColumn("n_words", F.size("words"))
    mask = F.lit(0)
    for bit, failing in enumerate(checks.values()):
        mask = mask + F.when(failing, 1 << bit).otherwise(0)
    facts = rows.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))
    # Rows that repeat count once from here on, with their number.
    facts = facts.groupBy("id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    marked = lambda name: F.max(F.coalesce((F.col(name) == 1).cast("long"), F.lit(0)))
    marks = labels.select(col(id_col).alias("id"), "quality", "toxic").filter(F.col("id").isNotNull()).groupBy("id").agg(marked("quality").alias("good"), marked("toxic").alias("toxic"))
    zero = F.lit(0).cast("long")
    named = facts.filter(F.col("id").isNotNull()).join(marks, "id", "left").select(*facts.columns, F.coalesce("good", zero).alias("good"), F.coalesce("toxic", zero).alias("toxic"))
    nameless = facts.filter(F.col("id").isNull()).select(*facts.columns, zero.alias("good"), zero.alias("toxic"))
    weights = [F.col("n"), F.col("good") * F.col("n"), F.col("toxic") * F.col("n")]
    lead = F.min(F.when(F.col("id").isNotNull(), F.struct("id", *(w.alias(k) for w, k in zip(weights, "ngt")))))
    free = F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), zero)
    texts = named.unionByName(nameless).groupBy("digest", "part", "mask").agg(*(F.sum(w).alias(k) for w, k in zip(weights, "ngt")), free.alias("free"), lead.alias("lead"))
    texts = cut(texts)  # a few dozen bytes per text and part; two branches read it
    firsts = texts.groupBy("digest").agg(F.min("lead.id").alias("first"))
    first = F.col("lead.id") == F.col("first")
    # Of each text, the rows of its smallest id are no copies, nor are rows without an id.
    original = {k: F.when(first, F.col(f"lead.{k}")).otherwise(zero) + (F.col("free") if k == "n" else zero) for k in "ngt"}
    entries = F.array(
        F.struct(F.col("mask"), *(original[k].alias(k) for k in "ngt")),
        F.struct((F.col("mask") + (1 << len(checks))).alias("mask"), *((F.col(k) - original[k]).alias(k) for k in "ngt")),
    )
    out = texts.join(firsts, "digest", "left").select("part", F.explode(entries).alias("e")).filter("e.n > 0")
    return out.groupBy("part", "e.mask").agg(F.sum("e.n").alias("n"), F.sum("e.g").alias("good"), F.sum("e.t").alias("toxic"))


def audit(
    docs: DataFrame,
    labels: DataFrame,
    checks: Mapping[str, Column] | None = None,
    copies: str = "E",
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "source",
) -> DataFrame:
    """What every order of the filters does to each part, one row per part, order and step.

    kept: documents left after the step; removed: those that go here; redundant: those that
    fail the filter but went before; unique_fails: those that fail this filter alone;
    good_lost and toxic_lost: removed ones labelled quality 1 and toxic 1; shapley: what the
    filter removes, summed over all orders.

    `checks` names the text filters by a letter each; `copies` is the letter of the filter
    that documents fail whose text a smaller id has too, anywhere in the table. A null text
    is empty, a null part the empty text. Very long texts are read whole, on one task each.
    Rows that repeat count each; of an id with equal texts no row is a copy of the other. A
    row without an id is no copy and makes none, and has no label. A document with several
    labels is good or toxic if one of them says so. An empty table gives no rows.
    """
    checks = text_checks() if checks is None else checks
    return interactions(masses_of(docs, labels, checks, id_col, text_col, part_col), "".join(checks) + copies)
