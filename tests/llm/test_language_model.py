import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dossier.llm import language_model as lm


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", lower) if w]


class Brute:
    """Counts in a dictionary, probabilities by recursion."""

    def __init__(self, texts, order, shares):
        self.order, self.shares, self.c = order, shares, Counter()
        for text in texts:
            self.c.update(self.grams(text))
        self.tokens = {k[0]: v for k, v in self.c.items() if len(k) == 1 and k[0] != "<s>"}
        self.n, self.v = sum(self.tokens.values()), len(self.tokens)

    def p(self, w, h):
        if not h:
            return (self.tokens.get(w, 0) + 1) / (self.n + self.v + 1)
        if not self.c[h]:
            return self.p(w, h[1:])
        s = self.shares[len(h) - 1][self.c[h].bit_length() - 1]
        return s * self.c[(*h, w)] / self.c[h] + (1 - s) * self.p(w, h[1:])

    def grams(self, text):
        seq = ["<s>", *words(text), "</s>"]
        return Counter(tuple(seq[i : i + n]) for n in range(1, self.order + 1) for i in range(len(seq) - n + 1))

    def ratios(self, texts, size):
        """Each token of each text by the counts of all other texts."""
        out = np.zeros((lm.CLASSES, lm.BINS), dtype=int)
        for text in texts:
            own, seq = self.grams(text), ["<s>", *words(text), "</s>"]
            for i in range(size - 1, len(seq)):
                gram = tuple(seq[i - size + 1 : i + 1])
                context = self.c[gram[:-1]] - own[gram[:-1]]
                if context > 0:
                    ratio = (self.c[gram] - own[gram]) / context / self.p(gram[-1], gram[1:-1])
                    place = 0 if ratio == 0 else min(max(math.floor(2 * math.log2(ratio)) + lm.UNIT_BIN, 1), lm.BINS - 1)
                    out[context.bit_length() - 1, place] += 1
        return out

    def score(self, text):
        seq = ["<s>", *words(text), "</s>"]
        return sum(math.log10(self.p(seq[i], tuple(seq[max(0, i - self.order + 1) : i]))) for i in range(1, len(seq)))

    def row(self, i, text):
        out = bool(zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2)
        seq = [*words(text), "</s>"]
        base = sum(math.log10((self.tokens.get(w, 0) + 1) / (self.n + self.v + 1)) for w in seq)
        return i, out, len(seq), sum(w in self.tokens for w in seq), self.n, base, self.score(text)


def some_texts(n):
    random.seed(4)
    line = lambda: " ".join(random.choices("the a An cat dog Sat ran on mat ünï \x0b \xa0x".split(" "), k=random.randint(0, 30)))
    return [(i, line()) for i in range(n)]


def same(found, expected):
    key = lambda r: (r[0] is None, r[0] or 0, r[6])
    found, expected = sorted((tuple(r) for r in found), key=key), sorted(expected, key=key)
    assert [r[:5] for r in found] == [r[:5] for r in expected]
    assert np.allclose([r[5:] for r in found], [r[5:] for r in expected], rtol=1e-9, atol=1e-9)


SHARES = [np.linspace(0.2, 0.8, lm.CLASSES), np.linspace(0.7, 0.9, lm.CLASSES), np.full(lm.CLASSES, 0.6)]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_agrees_with_brute_force(spark, table, odd_rows, order, monkeypatch):
    monkeypatch.setattr(lm, "BUCKET_BYTES", 40_000)  # several buckets
    rows = odd_rows + some_texts(80)
    learned = [t for i, t in rows if zlib.crc32(str(i).encode() if i is not None else b"") % 7 != 2]
    model = Brute(learned, order, SHARES)
    docs = table(rows).repartition(3)  # several blocks
    same(lm.score_texts(docs, order=order, shares=SHARES[: order - 1]).collect(), [model.row(i, t) for i, t in rows])


def test_learned_shares(spark, table, odd_rows):
    rows = odd_rows + some_texts(60)
    learned = [t for i, t in rows if zlib.crc32(str(i).encode() if i is not None else b"") % 7 != 2]
    model = Brute(learned, 3, [])
    for size in (2, 3):
        model.shares.append(lm.fit_shares(model.ratios(learned, size)))
    same(lm.score_texts(table(rows).repartition(2), order=3).collect(), [model.row(i, t) for i, t in rows])


def test_fitted_share_is_the_best_one():
    counts = np.zeros((lm.CLASSES, lm.BINS), dtype=int)
    counts[3, [0, 5, 40, 60]] = 500, 40, 100, 30
    ratio = np.append(0.0, 2.0 ** ((np.arange(1, lm.BINS) - lm.UNIT_BIN + 0.5) / 2))
    likelihood = lambda s: (counts[3] * np.log(s * ratio + 1 - s)).sum() + math.log(s) + math.log(1 - s)
    best = max(np.arange(0.001, 1, 0.001), key=likelihood)
    assert abs(lm.fit_shares(counts)[3] - best) < 0.002


def test_brute_force_is_a_distribution():
    model = Brute([t for _, t in some_texts(30)], 3, SHARES)
    for h in [(), ("<s>",), ("the",), ("the", "cat"), ("<s>", "a"), ("never", "seen")]:
        assert math.isclose(sum(model.p(w, h) for w in [*model.tokens, "unknown"]), 1.0)


def test_blocks_split_and_nothing_learned(spark, table, odd_rows):
    rows = odd_rows + some_texts(20)
    docs = table(rows)
    for found in (lm.score_texts(docs, F.lit(False)).collect(), lm.score_texts(docs, F.lit(None).cast("boolean")).collect()):
        assert len(found) == len(rows) and {(r["score"], r["base_score"], r["train_tokens"], r["n_known"]) for r in found} == {(0.0, 0.0, 0, 0)}
    assert lm.score_texts(table([])).collect() == []
    made = lm.score_texts(docs)
    assert made.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def test_stretches_carry_the_history(monkeypatch):
    texts = pa.array([t for _, t in some_texts(12)] + ["the cat sat " * 3000])
    tokens = lm.tokens_of(texts)
    learned = np.ones(len(texts), dtype=bool)
    totals = [lm.counted(tokens, k, learned)[1] for k in (1, 2, 3)]
    keys = lm.counted(tokens, 1, learned)[0]
    real = totals[0][keys != np.uint64(lm.BEGIN_KEY)]
    grams = lm.grams_of(tokens, totals, SHARES[:2], len(real), int(real.sum()))
    automaton = lm.build(grams, SHARES)
    whole = []
    for stretch in (1 << 20, 256, 7, 1):
        monkeypatch.setattr(lm, "STRETCH", stretch)
        whole.append(lm.traverse(automaton, tokens, grams.index[0], 3))
    assert all(np.allclose(w, whole[0]) for w in whole)
    model = Brute(texts.to_pylist(), 3, SHARES)
    assert np.allclose(whole[0], [model.score(t) for t in texts.to_pylist()])


def test_beats_single_tokens_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    row = lm.score_texts(docs).filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert (row["s"] - row["b"]) / row["n"] > 0.3


def test_packing():
    rng = np.random.default_rng(1)
    for n in (np.zeros(0, dtype=np.int64), np.zeros(5, dtype=np.int64), rng.integers(0, 2**62, 99), rng.integers(0, 3, 1000)):
        assert (lm.unpack(lm.pack(n)) == n.astype(np.uint64)).all()
    keys = np.sort(rng.integers(0, 2**63, 1000).astype(np.uint64))
    edges = lm.bucket_edges(keys, 7)
    assert edges[0] == 0 and edges[-1] == 1000 and (np.diff(edges) > 0).all()
    a, b = (np.array([1, 4, 9], dtype=np.uint64), np.array([1, 2, 3])), (np.array([4, 7], dtype=np.uint64), np.array([10, 20]))
    assert [x.tolist() for x in lm.add_up([a, b])] == [[1, 12, 3], [12, 20]]
