"""Benchmark decontamination: a prefix-filtered join of item windows with whole documents.

A window is `size` consecutive words of a benchmark item. A document contains a window only
if it has the window's rarest word, so that word alone is the window's necessary prefix
(full containment leaves a prefix of one). Rarity is counted over all documents. A scan
finds the prefix words; around each it tests only the starts that keep the word inside a
window and the window inside the document. Two bit tables of fixed size stand in for the
words and windows in the scan, whatever the size of the benchmark; what passes them is
joined with the windows by its full words, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.arrow_text import ALNUM, Words, bit_table, combine, mix, numbered, pieces, slots, text_buffer, words_of
from dossier.session import cut

WINDOW = 10
WORD_BITS, WINDOW_BITS = 20, 22
FLUSH = 200_000


def _windows_at(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """The hash of the `size` words from each start."""
    return mix(combine([hashes[starts + i] for i in range(size)]) ^ np.uint64(size))


def _text(words: Words, a: int, b: int) -> str:
    return b" ".join(words.data[s:e].tobytes() for s, e in zip(words.start[a:b].tolist(), words.end[a:b].tolist())).decode()


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """(item, window, hash, words): every window of every item, with the hashes of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            words = words_of(*text_buffer(batch.column(1)), ALNUM)
            out: list[list] = [[], [], [], []]
            for k, item in enumerate(batch.column(0).to_pylist()):
                place = words.text(k)
                n = place.stop - place.start
                long = min(size, n)
                if not n:
                    continue
                hashes = words.hash[place]
                for i, h in enumerate(_windows_at(hashes, np.arange(n - long + 1), long).view(np.int64).tolist()):
                    values = (item, _text(words, place.start + i, place.start + i + long), h, hashes[i : i + long].view(np.int64).tolist())
                    for kept, value in zip(out, values):
                        kept.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.list_(pa.int64()))], ["item", "window", "hash", "words"])

    source = numbered(items, id_col, text_col).withColumn("id", F.coalesce(F.col("id").cast("string"), F.lit("")))
    return source.mapInArrow(run, "item string, window string, hash long, words array<long>")


def word_counts(docs: DataFrame, vocabulary: np.ndarray, bits: int = WORD_BITS) -> DataFrame:
    """(word, n): how often the words in the bit table occur in all documents; `docs` is (id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(vocabulary))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(shared.value).astype(bool)
        keys, counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["word", "n"])

        for batch in pieces(batches):
            hashes = words_of(*text_buffer(batch.column(1)), ALNUM).hash
            new, n = np.unique(hashes[wanted[slots(hashes, bits)]], return_counts=True)
            both, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
            keys, counts = both, np.bincount(at, np.concatenate([counts, n]), len(both)).astype(np.int64)
            if len(keys) > FLUSH:
                yield sent()
                keys, counts = keys[:0], counts[:0]
        yield sent()

    return docs.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _scan(docs: DataFrame, prefixes: np.ndarray, windows: np.ndarray, sizes: list[int]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((np.packbits(prefixes), np.packbits(windows), sizes))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed_words, packed_windows, sizes = shared.value
        rare, known = np.unpackbits(packed_words).astype(bool), np.unpackbits(packed_windows).astype(bool)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32()), ("window", pa.string())]))
        for batch in pieces(batches):
            words = words_of(*text_buffer(batch.column(1)), ALNUM)
            n = np.diff(words.first)
            hits: list[list] = [[] for _ in n]
            at = np.flatnonzero(rare[slots(words.hash, WORD_BITS)])
            text = np.searchsorted(words.first, at, side="right") - 1
            low, high = words.first[text], words.first[text + 1]
            for size in sizes:
                starts = at[:, None] - np.arange(size)[None]
                inside = (starts >= low[:, None]) & (starts + size <= high[:, None])
                starts = np.unique(starts[inside])
                if not len(starts):
                    continue
                gathered = _windows_at(words.hash, starts, size)
                starts = starts[known[slots(gathered, WINDOW_BITS)]]
                for s, k in zip(starts.tolist(), (np.searchsorted(words.first, starts, side="right") - 1).tolist()):
                    hits[k].append({"start": s - int(words.first[k]), "size": size, "window": _text(words, s, s + size)})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), pa.array(hits, kind)], ["id", "n_words", "hits"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, n_words long, hits array<struct<start: int, size: int, window: string>>")


def find_overlaps(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW
) -> DataFrame:
    """One row per document row: id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words; items without words have no windows. Repeated rows
    and null ids of documents give a row each; items that share an id count once. Without
    items every document is clean. `items_sha256` is that of the ids of the items found,
    sorted as strings and joined by commas.
    """
    source = numbered(docs, id_col, text_col)
    windows = cut(item_windows(items, item_id, item_text, size))
    distinct = windows.select("window", "hash", "words").dropDuplicates(["window"])
    vocabulary = bit_table(windows.select(F.explode("words").alias("word")), "word", WORD_BITS)
    counts = word_counts(source, vocabulary)
    ranked = distinct.select("window", F.explode("words").alias("word")).join(counts, "word", "left")
    prefixes = ranked.groupBy("window").agg(F.min_by("word", F.struct(F.coalesce("n", F.lit(0)), "word")).alias("word"))
    sizes = sorted(r[0] for r in distinct.select(F.size("words")).distinct().collect())  # at most `size` numbers
    scanned = _scan(source, bit_table(prefixes, "word", WORD_BITS), bit_table(distinct, "hash", WINDOW_BITS), sizes)
    scanned = cut(scanned.withColumn("row", F.monotonically_increasing_id()))
    hits = scanned.select("row", F.explode("hits").alias("hit")).select("row", "hit.*")
    found = hits.join(windows.select("window", "item").distinct(), "window")
    named = found.select("row", "item").distinct().groupBy("row").agg(F.count(F.lit(1)).alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item")), ","), 256).alias("items_sha256"))
    places = found.select("row", "start", "size").distinct().groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "size"))).alias("places"))
    covered = F.aggregate(
        "places",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda acc, p: F.struct(
            (acc["n"] + F.greatest(F.lit(0), p["start"] + p["size"] - F.greatest(acc["end"], p["start"]))).alias("n"),
            F.greatest(acc["end"], p["start"] + p["size"]).alias("end"),
        ),
    )["n"]
    marks = places.select("row", covered.alias("n_hit")).join(named, "row")
    out = scanned.drop("hits").join(marks, "row", "left")
    return out.select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )
