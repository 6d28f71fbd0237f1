"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

The features of a text are the densities of words and word beginnings that mark toxic
texts, such words in disguise (letters replaced or split by signs), second-person words
near them, capitals and punctuation. The lexicon, the trees and the calibration are learned
from labelled rows: a sample of at most `SAMPLE_ROWS` of them, chosen by a hash of the id
alone, is bounded by that parameter, so its features fit the driver. Every text is scored
in full on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.arrow_text import ALNUM, DENSE, LOWER, Members, hash_text, hash_words, numbered, pieces, text_buffer, word_places, words_of
from dossier.session import find_package

#: Bounds of what is learned from: labelled rows, rows that the lexicon is counted over, entries kept.
SAMPLE_ROWS = 20_000
LEXICON_SIZE = 512
LEAST_SHARE, LEAST_ODDS = 0.005, 2.0
STEMS = (4, 5)
NEAR = 3
TREES, DEPTH, BINS, RATE = 60, 3, 32, 0.2

# Second-person words of the four languages; signs that stand for letters.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch euer sie ihnen tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros su sus".split()
DISGUISE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

FEATURES = (
    "log_words word_density stem_density any_count hidden_density near_second_person second_person_density "
    "capital_share shouted_share exclamation_rate question_rate other_sign_rate sign_run_rate digit_rate"
).split()


def _disguised() -> np.ndarray:
    table = LOWER.copy()
    for sign, letter in DISGUISE.items():
        table[ord(sign)] = ord(letter)
    return table


_DISGUISED = _disguised()
_CODES = np.arange(256)
_LETTER = ((_CODES >= 97) & (_CODES <= 122)) | ((_CODES >= 65) & (_CODES <= 90)) | (_CODES >= 128)
_CAPITAL = (_CODES >= 65) & (_CODES <= 90)
_DIGIT = (_CODES >= 48) & (_CODES <= 57)
_SIGN = (_CODES > 32) & (_CODES < 127) & ~_LETTER & ~_DIGIT


@dataclass
class Lexicon:
    words: np.ndarray
    stems: np.ndarray


def keys_of(words) -> np.ndarray:
    """Hashes of each word and its beginnings; the beginnings are marked so that they differ from whole words."""
    out = [words.hash]
    for n in STEMS:
        whole = words.end - words.start > n
        out.append(hash_words(words.data, words.start[whole], words.start[whole] + n) ^ np.uint64(n))
    return out


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def features(data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """One row per text and one column per feature; an empty text has zeros."""
    words = words_of(data, offsets, ALNUM)
    known, stem, second = Members(lexicon.words), Members(lexicon.stems), Members(np.array([hash_text(w) for w in SECOND_PERSON], dtype=np.uint64))
    n = np.diff(words.first)
    plain = known(words.hash)
    stems = np.zeros(len(words.hash), dtype=bool)
    for k in STEMS:
        at = np.flatnonzero(words.end - words.start > k)
        stems[at] |= stem(hash_words(words.data, words.start[at], words.start[at] + k) ^ np.uint64(k))
    you = second(words.hash)
    marked = np.flatnonzero(plain | stems)
    owner = np.repeat(np.arange(len(n)), n)
    near = np.zeros(len(words.hash), dtype=bool)
    for step in (*range(-NEAR, 0), *range(1, NEAR + 1)):
        other = np.clip(marked + step, 0, max(0, len(you) - 1))
        near[marked] |= you[other] & (owner[other] == owner[marked])
    start, end = word_places(data, offsets, DENSE)
    letter = _LETTER[_DISGUISED[data]]
    place = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(letter, out=place[1:])
    impure = np.flatnonzero((_per_text(~_LETTER[data], np.append(start, len(data))) > 0) & (place[end] > place[start])) if len(start) else start
    hidden = np.zeros(len(start), dtype=bool)
    hidden[impure] = known(hash_words(_DISGUISED[data][letter], place[start[impure]], place[end[impure]]))
    per_word = lambda v: _per_text(v, words.first)
    per_byte = lambda v: _per_text(v, offsets)
    capital = _CAPITAL[data]
    caps = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(capital, out=caps[1:])
    size = words.end - words.start
    shouted = (caps[words.end] - caps[words.start] == size) & (size > 1)
    sign = _SIGN[data]
    run = np.zeros(len(data), dtype=bool)
    run[1:] = sign[1:] & sign[:-1]
    length = np.maximum(1, np.diff(offsets))
    n1, plain_n = np.maximum(1, n), per_word(plain)
    letters = np.maximum(1, per_byte(_LETTER[data]))
    hidden_n = np.maximum(0, _per_text(hidden, np.searchsorted(start, offsets)) - plain_n)
    columns = [
        np.log1p(n), plain_n / n1, per_word(stems) / n1, np.log1p(per_word(plain | stems)), hidden_n / n1, per_word(near) / n1, per_word(you) / n1,
        per_byte(capital) / letters, per_word(shouted) / n1, per_byte(data == 33) / length, per_byte(data == 63) / length,
        per_byte(sign & (data != 33) & (data != 63)) / length, per_byte(run) / length, per_byte(_DIGIT[data]) / length,
    ]
    return np.stack(columns, axis=1).astype(np.float64)


# --- boosted trees --------------------------------------------------------------


@dataclass
class Trees:
    """Complete binary trees of one depth: cuts by (tree, node), values by (tree, leaf)."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - (len(leaf) - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray) -> Trees:
    """Newton boosting of the logistic loss over histograms of quantile bins."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    cuts = [np.unique(np.append(c[c < x[:, f].max()], 0.0)) for f, c in enumerate(cuts)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    width = max(len(c) for c in cuts) + 1
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    base = float(np.log(share / (1 - share)))
    raw = np.full(len(y), base)
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    out = Trees(np.zeros((TREES, inner), dtype=np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, leaves)), base)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(DEPTH):
            first, count = 2**level - 1, 2**level
            local = node - first
            best = np.zeros(count)
            choice = [(0, None)] * count
            for f, c in enumerate(cuts):
                slot = local * width + binned[:, f]
                gs = np.bincount(slot, g, count * width).reshape(count, width)
                hs = np.bincount(slot, h, count * width).reshape(count, width)
                gl, hl = np.cumsum(gs, axis=1), np.cumsum(hs, axis=1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                gain[(hl < 1e-3) | (ht - hl < 1e-3)] = 0
                at = gain[:, : len(c)].argmax(axis=1) if len(c) else np.zeros(count, dtype=int)
                for k in range(count):
                    if len(c) and gain[k, at[k]] > best[k] + 1e-9:
                        best[k], choice[k] = gain[k, at[k]], (f, int(at[k]))
            right = np.zeros(len(y), dtype=bool)
            for k, (f, at) in enumerate(choice):
                if at is not None:
                    out.feature[t, first + k], out.cut[t, first + k] = f, cuts[f][at]
                    right |= (local == k) & (binned[:, f] > at)
            node = 2 * node + 1 + right
        leaf = node - inner
        gs, hs = np.bincount(leaf, g, leaves), np.bincount(leaf, h, leaves)
        out.leaf[t] = -RATE * gs / (hs + 1)
        raw += out.leaf[t][leaf]
    return out


def fit_isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool equal scores, then adjacent violators; the points between which a calibrated score is interpolated.

    A point stands at the mean score of its pool; rows with one score are always in one pool.
    """
    values, at = np.unique(score, return_inverse=True)
    pools: list[list[float]] = []  # sum of labels, rows, sum of scores
    for value, labels, rows in zip(values, np.bincount(at, y), np.bincount(at)):
        pools.append([float(labels), float(rows), float(value) * float(rows)])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            labels, rows, total = pools.pop()
            pools[-1] = [pools[-1][0] + labels, pools[-1][1] + rows, pools[-1][2] + total]
    return np.array([p[2] / p[1] for p in pools]), np.array([p[0] / p[1] for p in pools])


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    points: np.ndarray
    levels: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.levels[0])
        return np.clip(np.interp(self.trees.raw(x), self.points, self.levels), 0.0, 1.0)


# --- learning and scoring on Spark ----------------------------------------------


def held_out(id_col: str) -> F.Column:
    """One row in five, by its id, is never learned from; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _lexicon(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Words and beginnings that are far more frequent in toxic texts: (words, beginnings)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            data, offsets = text_buffer(batch.column(1))
            words = words_of(data, offsets, ALNUM)
            label = batch.column(2).to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(label)), np.diff(words.first))
            for kind, keys in zip((0, *STEMS), keys_of(words)):
                of = owner if not kind else owner[words.end - words.start > kind]
                pair = np.unique(np.stack([keys, of.astype(np.uint64)]), axis=1)
                toxic = label[pair[1].astype(np.int64)] == 1
                key, at = np.unique(pair[0], return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(key), kind, dtype=np.int32)), pa.array(key.view(np.int64)), pa.array(np.bincount(at, toxic, len(key)).astype(np.int64)), pa.array(np.bincount(at, ~toxic, len(key)).astype(np.int64))],
                    ["kind", "key", "toxic", "clean"],
                )

    texts = sample.groupBy().agg(F.sum("label"), F.sum(1 - F.col("label"))).first()
    toxic, clean = (texts[0] or 0), (texts[1] or 0)
    if not toxic or not clean:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    rows = (
        sample.select("id", "text", "label").mapInArrow(count, "kind int, key long, toxic long, clean long")
        .groupBy("kind", "key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .filter((F.col("toxic") >= max(2, LEAST_SHARE * toxic)) & (odds >= LEAST_ODDS))
        .orderBy((odds * F.col("toxic")).desc(), "key").limit(LEXICON_SIZE).collect()
    )
    of = lambda kinds: np.array([r["key"] for r in rows if r["kind"] in kinds], dtype=np.int64).view(np.uint64)
    return of({0}), of(set(STEMS))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit lexicon, trees and calibration to a bounded sample of the labelled rows that are not held out."""
    named = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    named = named.filter(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out("id")).groupBy("id").agg(F.max("label").alias("label"))
    chosen = named.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS)  # at most SAMPLE_ROWS ids: small enough to broadcast
    sample = numbered(docs, id_col, text_col).join(F.broadcast(chosen), "id")
    words, stems = _lexicon(sample)
    lexicon = Lexicon(words, stems)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            x = features(*text_buffer(batch.column(1)), lexicon)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))], ["id", "label", "x"])

    kind = sample.schema["id"].dataType.simpleString()
    rows = sample.select("id", "text", "label").mapInArrow(run, f"id {kind}, label int, x array<double>").select("label", "x", (F.pmod(F.xxhash64("id", F.lit("calibrate")), F.lit(4)) == 0).alias("late"))
    # Ids may repeat: of their rows, those with the smallest features come first, so the rows learned from are always the same.
    table = rows.orderBy(F.xxhash64("x"), "x", "label").limit(2 * SAMPLE_ROWS).toArrow()
    y = table.column("label").to_numpy().astype(np.float64)
    late = np.array(table.column("late").to_pylist(), dtype=bool)
    if not len(y) or y.min() == y.max() or len(set(y[~late])) < 2:
        return Model(lexicon, None, np.zeros(1), np.array([y.mean() if len(y) else 0.0]))
    x = np.array(table.column("x").to_pylist(), dtype=np.float64)
    order = np.lexsort([*x.T, y])  # the same model whatever order the rows came in
    x, y, late = x[order], y[order], late[order]
    trees = fit_trees(x[~late], y[~late])
    points, levels = fit_isotonic(trees.raw(x[late]), y[late]) if late.any() else (np.array([-1.0, 1.0]), np.array([0.0, 1.0]))
    return Model(lexicon, trees, points, levels)


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score, predicted, and the features as an array.

    A null text counts as empty and is scored like one. Repeated rows and null ids give a
    row each. Without labelled rows of both kinds, every score is the share of toxic labels.
    Very long texts are scored whole, in one task.
    """
    source = numbered(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            x = features(*text_buffer(batch.column(1)), shared.value.lexicon)
            score = shared.value.score(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(list(x), pa.list_(pa.float64()))],
                ["id", "score", "predicted", "features"],
            )

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, score double, predicted int, features array<double>").withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, whose text is not predicted to be toxic.

    A null text counts as empty; repeated rows go or stay together; null ids do not matter.
    """
    find_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, place):
            score = shared.value.score(features(*text_buffer(batch.column(place)), shared.value.lexicon))
            yield batch.filter(pa.array(score < 0.5))

    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # names with dots could not be passed on
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
