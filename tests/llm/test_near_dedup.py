import random
import re

import numpy as np

from dossier.llm import near_dedup
from dossier.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute(rows, size, percent):
    rows = [(i, shingles(t, size)) for i, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, (i, s) in enumerate(rows):
        for b in range(a):
            j, t = rows[b]
            if i is not None and j is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                top[find(a)] = find(b)
    low = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            low[find(a)] = min(low.get(find(a), i), i)
    return sorted([(i, len(s), low[find(a)] if i is not None else None, i is None or low[find(a)] == i) for a, (i, s) in enumerate(rows)], key=repr)


def run(frame, size, percent):
    made = near_dedup.near_duplicates(frame, size=size, percent=percent)
    assert made.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted((tuple(r) for r in made.collect()), key=repr)


def test_agrees_with_brute_force(table, odd_rows, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)  # so that a group of copies takes several blocks
    random.seed(11)
    pool = [f"w{k}" for k in range(3000)]
    rows = list(odd_rows)
    for group in range(12):
        base = random.choices(pool, k=random.choice([2, 3, 6, 60, 150]))
        for _ in range(random.choice([1, 2, 30])):
            w = list(base)
            for _ in range(random.randint(0, max(1, len(w) // 20))):
                w[random.randrange(len(w))] = random.choice(pool)
            rows.append((100 + len(rows), " ".join(w).upper() if group % 2 else "  ".join(w)))
    for size, percent in ((3, 85), (5, 80)):
        assert run(table(rows), size, percent) == brute(rows, size, percent)
    assert run(table([]), 3, 85) == []


def test_pruning_keeps_what_may_reach_the_threshold():
    least = near_dedup.least_matches(0.85)
    assert least == sorted(least) and least[-1] < 0.85 * near_dedup.PLACES
    rng = np.random.default_rng(1)
    kept = sum(rng.binomial(near_dedup.PLACES, 0.85) >= least[-1] for _ in range(2000))
    assert kept == 2000


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 2), (2, 1), (10, 11), (11, 12), (12, 10), (7, 7), (20, 21), (1, 2)] + [(100, 100 + k) for k in range(1, 60)] + [(300 - k, 299 - k) for k in range(40)]
    made = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {n: made[n] for n in (1, 5, 12, 21, 159, 300)} == {1: 1, 5: 1, 12: 10, 21: 20, 159: 100, 300: 260}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def estimate(frame):
    """Bits of the number of bytes that the planner expects of a table."""
    return frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()


def test_estimates_of_sizes_do_not_grow_with_the_steps(spark):
    numbers = list(range(60))
    random.Random(5).shuffle(numbers)
    shuffled = spark.createDataFrame(list(zip(numbers[:-1], numbers[1:])), "a long, b long")
    chain = spark.range(1, 60).selectExpr("id AS a", "id - 1 AS b")
    for edges in (shuffled, chain):  # many rounds, and many doublings in one
        roots = components(edges)
        assert roots.distinct().count() == 60 and [r.root for r in roots.select("root").distinct().collect()] == [0]
        assert estimate(roots) < 64


def test_estimates_of_labelled_rows_stay_small(table):
    base = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(base[k : k + 100])) for k in range(0, 100, 5)]  # each text is near its neighbours only
    assert estimate(near_dedup.near_duplicates(table(rows), size=3, percent=85)) < 10_000
