import zlib
from pathlib import Path

import numpy as np
import pytest

from dossier.llm import toxicity

FOLDER = "/root/testdata/sf0.1"


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no tables")
def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = toxicity.learn(docs, labels)
    scored = {r.doc_id: r.score for r in toxicity.score_texts(docs, model).select("doc_id", "score").collect()}
    rows = [(scored[r.doc_id], r.toxic) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    score, truth = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    a, b = score[truth == 1][:, None], score[truth == 0][None]
    assert ((score >= 0.5) == truth).mean() > 0.97 and ((a > b) + 0.5 * (a == b)).mean() > 0.98
    assert 0 <= score.min() and score.max() <= 1


def test_rows_and_missing_labels(spark, table, odd_rows):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    frame = table(odd_rows)
    model = toxicity.learn(frame, labels)
    made = toxicity.score_texts(frame, model)
    assert made.columns == ["doc_id", "score", "predicted", "features"]
    assert [r.score for r in made.collect()] == [0.0] * len(odd_rows)
    assert toxicity.keep_clean(frame, model).columns == frame.columns and toxicity.keep_clean(frame, model).count() == len(odd_rows)
    assert toxicity.score_texts(table([]), model).collect() == []
    held = {r.doc_id: r.h for r in frame.select("doc_id", toxicity.held_out("doc_id").alias("h")).collect()}
    assert all(h == (zlib.crc32((b"" if i is None else str(i).encode())) % 5 == 0) for i, h in held.items())


def test_learns_from_few_rows_with_repeats_and_nulls(spark, table):
    rows = [(i, ("you are a vile gromp, gromp " if i % 2 else "a calm walk by the lake ") + f"number {i}") for i in range(200)]
    rows += [rows[1], (300, None), (None, "gromp")]
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(200)] + [(1, 1, 1), (300, 0, 1), (None, 1, 1), (5, None, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.learn(table(rows), labels)
    out = toxicity.score_texts(table([(1, "you vile gromp"), (2, "the calm lake"), (3, "")]), model).collect()
    assert [r.predicted for r in out] == [1, 0, 0]


def test_isotonic_is_monotone():
    rng = np.random.default_rng(3)
    score = rng.normal(size=500)
    points, levels = toxicity.fit_isotonic(score, (rng.random(500) < 1 / (1 + np.exp(-2 * score))).astype(float))
    assert (np.diff(points) > 0).all() and (np.diff(levels) > 0).all()


def brute_isotonic(score, y):
    """The largest mean from the left of the smallest mean to the right, over all runs of different scores."""
    values = np.unique(score)
    mean = lambda a, b: y[(score >= values[a]) & (score <= values[b])].mean()
    return [max(min(mean(a, b) for b in range(k, len(values))) for a in range(k + 1)) for k in range(len(values))]


def test_isotonic_with_ties_equals_brute_force():
    rng = np.random.default_rng(8)
    for n in (1, 2, 5, 40):
        for kinds in (1, 2, 4, 12):
            score, y = rng.integers(0, kinds, n) / 8.0, rng.integers(0, 2, n).astype(float)
            points, levels = toxicity.fit_isotonic(score, y)
            assert sorted(set(np.round(brute_isotonic(score, y), 9))) == sorted(np.round(levels, 9).tolist())
    score, y = np.array([0.3] * 10 + [0.9] * 2), np.array([0, 1, 0, 0, 1, 0, 0, 1, 0, 0, 1, 1], dtype=float)
    points, levels = toxicity.fit_isotonic(score, y)
    assert np.allclose(points, [0.3, 0.9]) and np.allclose(levels, [0.3, 1.0])
