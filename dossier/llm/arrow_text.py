"""Whole texts as byte arrays: how the numpy operators read Arrow batches.

Texts stay UTF-8 bytes. Words are runs of bytes that a table calls word bytes; every byte
above 0x7F is one, so words never split a character. A batch is worked through in pieces
of a bounded number of text bytes (a single longer text is one piece, and the wide
intermediate arrays are then still made in stretches).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.session import find_package

PIECE_BYTES = 2 << 20
STRETCH = 1 << 17
_R = 0x9E3779B97F4A7C15 | 1
_R_INVERSE = pow(_R, -1, 1 << 64)


def lower_ascii() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def word_bytes(separators: bytes) -> np.ndarray:
    """Which byte values belong to words, given the ASCII ones that do not."""
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


LOWER = lower_ascii()
#: Letters, digits and everything beyond ASCII.
ALNUM = word_bytes(bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)))
#: Everything but white space.
DENSE = word_bytes(b" \t\n\x0b\x0c\r")


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or data is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], text: int = 1, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds at most `limit` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_buffer(batch.column(text))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64 bits; the usual final steps of a multiply-and-shift hash."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


_UP, _DOWN = _powers(_R, 4 * STRETCH), _powers(_R_INVERSE, 4 * STRETCH)


@dataclass
class Words:
    """The words of a piece: byte places, hashes and, per text, the first word's number."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def text(self, k: int) -> slice:
        return slice(int(self.first[k]), int(self.first[k + 1]))


def words_of(data: np.ndarray, offsets: np.ndarray, members: np.ndarray, lower: bool = True) -> Words:
    """Split the texts of a buffer into words and hash each one (64 bits)."""
    data = LOWER[data] if lower else data
    start, end = word_places(data, offsets, members)
    return Words(data, start, end, hash_words(data, start, end), np.searchsorted(start, offsets))


def word_places(data: np.ndarray, offsets: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = members[data]
    begins = inside[1:-1] & ~inside[:-2]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    begins[cuts] |= inside[1:-1][cuts]
    ends = inside[1:-1] & ~inside[2:]
    ends[cuts - 1] |= inside[1:-1][cuts - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def hash_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A polynomial of each word's bytes, mixed; made in stretches to keep wide arrays small."""
    out = np.empty(len(start), dtype=np.uint64)
    k = 0
    while k < len(start):
        base = int(start[k])
        n = max(k + 1, int(np.searchsorted(end, base + STRETCH, side="right")))
        span = int(end[n - 1]) - base
        up, down = (_UP, _DOWN) if span <= len(_UP) else (_powers(_R, span), _powers(_R_INVERSE, span))
        values = (data[base : base + span].astype(np.uint64) + np.uint64(1)) * up[:span]
        total = np.zeros(span + 1, dtype=np.uint64)
        np.cumsum(values, out=total[1:])
        at = start[k:n] - base
        out[k:n] = (total[end[k:n] - base] - total[at]) * down[at]
        k = n
    return mix(out)


def hash_text(word: str) -> int:
    """The hash that `hash_words` gives this word."""
    data = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(hash_words(data, np.array([0]), np.array([len(data)]))[0])


def combine(columns: list[np.ndarray]) -> np.ndarray:
    """One hash for each row of several columns of hashes, in order."""
    total = np.zeros(len(columns[0]), dtype=np.uint64)
    for column in columns:
        total = total * np.uint64(_R) + column
    return mix(total)


def runs_hash(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of every n consecutive words; empty when there are fewer."""
    count = len(hashes) - n + 1
    return combine([hashes[i : i + count] for i in range(n)]) if count > 0 else np.zeros(0, dtype=np.uint64)


class Members:
    """A set of hashes that numpy asks in bulk: a small bit table first, then exactly."""

    def __init__(self, hashes: np.ndarray, bits: int = 18) -> None:
        self.sorted = np.unique(np.asarray(hashes, dtype=np.uint64))
        self.shift = np.uint64(64 - bits)
        self.maybe = np.zeros(1 << bits, dtype=bool)
        self.maybe[self.sorted >> self.shift] = True

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = self.maybe[hashes >> self.shift]
        at = np.flatnonzero(out)
        if len(at):
            asked = hashes[at]
            place = np.minimum(np.searchsorted(self.sorted, asked), len(self.sorted) - 1)
            out[at] = self.sorted[place] == asked
        return out


def numbered(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) of a table, whatever its other columns are called."""
    find_package(df.sparkSession)
    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The places of hashes in a table of 2^bits bits."""
    return hashes >> np.uint64(64 - bits)


def bit_table(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """A table of 2^bits bits with those of the column's hashes set; at most 2^bits numbers reach the driver, in bounded packs."""
    words = df.select(F.shiftrightunsigned(column, 64 - bits).alias("slot")).distinct()
    packs = words.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 AS int))")).alias("bits"))
    found = packs.toArrow()
    table = np.zeros(1 << (bits - 6), dtype=np.int64)
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return np.unpackbits(table.view(np.uint8), bitorder="little").astype(bool)
