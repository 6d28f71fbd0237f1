import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.llm import topk


def brute(rows, k):
    fine = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            fine[i, tuple(math.floor(256 * x) for x in v)] = None
    out = []
    for q, a in fine:
        if q % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in fine if i != q and len(a) == len(b))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_agrees_with_brute_force(spark):
    random.seed(3)
    rows = [(i, [random.uniform(-1, 1) for _ in range(7)]) for i in range(400)]
    rows += [(i, [0.5] * 7) for i in range(400, 700)]  # one very common vector, which is asked for as well
    rows += [(700 + i, [float(x) for x in random.choices([-0.5, 0.25], k=7)]) for i in range(120)]  # many ties
    rows += [(1000, None), (1050, [None] * 7), (1100, [float("nan")] * 7), (1150, [math.inf] * 7), (None, [0.1] * 7), (1200, [0.3, 0.2]), (1250, [0.1, 0.2]), (1300, []), (100, rows[100][1])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    made = topk.top_k(frame, F.col("vec_id") % 50 == 0, 5)
    assert made.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r) for r in made.collect()) == brute(rows, 5)


def test_small_and_empty(spark):
    frame = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.5]), (2, [3.0, -1.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 50 == 0, 5).collect()) == brute([(0, [1.0, 2.0]), (1, [0.5, 0.5]), (2, [3.0, -1.0])], 5)
    assert topk.top_k(frame.filter("vec_id < 0"), F.col("vec_id") % 50 == 0, 5).collect() == []


def test_large_numbers_stay_exact(spark):
    rows = [(0, [2.0**22, 2.0**21 + 1]), (1, [2.0**20, 3.0]), (2, [2.0**20, 3.5]), (3, [-(2.0**20), 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top_k(frame, F.col("vec_id") == 0, 2).collect()) == brute(rows, 2)


def clustered(rng, n, centers, dim=64):
    middle = rng.normal(size=(centers, dim))
    x = middle[rng.integers(0, centers, n)] + rng.normal(size=(n, dim)) * 0.05
    return np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)


def test_the_cutoff_saves_products():
    rng = np.random.default_rng(5)
    x = clustered(rng, 4000, 60)
    q, keys = x[:200], np.arange(4000)
    scores = q @ x.T
    rows, columns, found = topk.first_phase(q, x, keys, 6)
    assert (scores[rows, columns] == found).all()
    cutoff = np.full(200, np.iinfo(np.int64).max)
    np.minimum.at(cutoff, rows, found)
    rows, columns, found, taken = topk.later_phases(q, x, cutoff)
    assert (scores[rows, columns] == found).all() and len(rows) == (scores >= cutoff[:, None]).sum()
    first = 200 * 4000 * topk.list_edges(64)[0] + 200 * topk.TRIED * 64
    assert taken + first < 0.5 * 200 * 4000 * 64


def test_later_phases_lose_nothing_on_any_data():
    rng = np.random.default_rng(6)
    for dim in (1, 2, 3, 7, 64):
        for spread in (1, 3, 1 << 20):
            q, x = rng.integers(-spread, spread + 1, (20, dim)), rng.integers(-spread, spread + 1, (150, dim))
            scores = q @ x.T
            for cutoff in (np.sort(scores, axis=1)[:, -6], scores.max(axis=1) + 1, np.full(20, np.iinfo(np.int64).min // 2)):
                rows, columns, found, _ = topk.later_phases(q, x, cutoff)
                wanted = np.nonzero(scores >= cutoff[:, None])
                assert set(zip(rows.tolist(), columns.tolist())) == set(zip(*(w.tolist() for w in wanted))) and (scores[rows, columns] == found).all()


def test_several_blocks_store_rows_once(spark, monkeypatch, tmp_path):
    random.seed(9)
    rows = [(i, [random.uniform(-1, 1) for _ in range(5)]) for i in range(1500)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    size = []
    for blocks in (4, 16):
        monkeypatch.setattr(topk, "QUERY_BLOCK", 30 // blocks + 1)
        monkeypatch.setattr(topk, "ROW_BLOCK", 200)
        folder = tmp_path / str(blocks)
        spark.sparkContext.setCheckpointDir(str(folder))
        assert sorted(tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 50 == 0, 5).collect()) == brute(rows, 5)
        size.append(sum(f.stat().st_size for f in folder.rglob("*") if f.is_file() and f.suffix != ".crc"))
    assert size[1] < 1.5 * size[0]


def test_numbers_beyond_64_bits_are_an_error(spark):
    frame = spark.createDataFrame([(0, [1e15, 1e15]), (1, [1e15, -1e15])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(frame, F.col("vec_id") == 0, 2).collect()
