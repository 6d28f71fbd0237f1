import hashlib
import math

import numpy as np
import pytest

from dossier.llm import centroids
from dossier.llm.queries import SQL
from oracle_check import compare


def brute(rows):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    center = [v for _, v in named[:8]]
    of = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(center))
    for _ in range(10):
        member = [of(v)[1] for _, v in kept]
        for k in range(len(center)):
            mine = [v for (_, v), m in zip(kept, member) if m == k]
            if mine:
                center[k] = [sum(column) // len(mine) for column in zip(*mine)]
    found = [(i, *of(v)) for i, v in kept] if center else []
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in center]
    total = sum(d for _, d, _ in found)
    return sorted(((i, k, d, sum(y for _, y, z in found if z == k), total, digest[k]) for i, d, k in found), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, id string")


def some_rows(n=300):
    rng = np.random.default_rng(11)
    middle = rng.normal(0, 0.4, (12, 64))
    rows = [(i, (middle[i % 12] + rng.normal(0, 0.1, 64)).tolist()) for i in range(n)]
    rows += [(1000 + i, [0.25] * 64) for i in range(40)]  # a common vector
    rows += [(2000 + i, rng.choice([-0.001, 0.0, 0.001], 64).tolist()) for i in range(60)]  # small differences, many ties
    return rows


ODD = [(1, None), (2, [None] * 64), (3, [0.1] * 63), (4, [math.nan] * 64), (5, [math.inf] + [0.0] * 63), (6, []), (None, [0.3] * 64), (7, [0.5] * 64), (7, [0.5] * 64), (7, [-0.5] * 64), (8, [16000.0] * 64), (9, [-16000.0] * 64)]


def test_agrees_with_brute_force_and_sql(spark):
    rows = some_rows() + ODD
    made = centroids.cluster_vectors(frame(spark, rows))
    assert sorted((tuple(r) for r in made.collect()), key=repr) == brute(rows)
    import duckdb

    db = duckdb.connect()
    db.register("embeddings", frame(spark, rows).toArrow())
    assert compare(made, db, SQL["op13_centroids"]) == ""


def test_few_rows_and_none(spark):
    rows = some_rows(5)[:5]
    assert sorted((tuple(r) for r in centroids.cluster_vectors(frame(spark, rows)).collect()), key=repr) == brute(rows)
    assert centroids.cluster_vectors(frame(spark, [])).collect() == []
    assert centroids.cluster_vectors(frame(spark, [(None, [0.5] * 64), (3, None)])).collect() == []


def test_numbers_that_do_not_fit_are_an_error(spark):
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster_vectors(frame(spark, [(1, [1e9] * 64)])).collect()


def test_transform_keeps_distances():
    rng = np.random.default_rng(2)
    x = rng.integers(-(1 << 24), 1 << 24, (40, 64))
    h = centroids.walsh()
    assert (h @ h.T == 64 * np.eye(64, dtype=np.int64)).all()
    assert list((np.diff(h, axis=1) != 0).sum(axis=1)) == list(range(64))
    assert (centroids.transform(x) == x @ h.T).all()
    assert centroids.untransform(centroids.transform(x).tolist()) == x.tolist()


@pytest.mark.parametrize("spread", [0, 1, 40, 1 << 24])
def test_search_is_exact_and_skips_coefficients(spread):
    rng = np.random.default_rng(spread)
    x, c = rng.integers(-spread, spread + 1, (500, 64)), rng.integers(-spread, spread + 1, (8, 64))
    c[5], x[:9] = c[2], c[2]  # equal centroids: ties
    which, distance, taken = centroids.nearest(centroids.transform(x), centroids.transform(c))
    full = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert (which == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
    smooth = np.cumsum(rng.integers(-9, 10, (500, 64)), axis=1)
    _, _, taken = centroids.nearest(centroids.transform(smooth), centroids.transform(smooth[:8]))
    assert taken < 0.6 * 500 * 8 * 64
