"""Byte tries: all places of many names in the texts of an Arrow batch, found at once.

A trie is four arrays. Nodes are numbered level by level in the order of their edges, so the
edge at place i leads to node i + 1 and an edge is one number, parent * 256 + byte. A batch
of texts is walked from all its bytes side by side: one step looks up one byte for every
start that is still alive. There is no loop over texts or names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Starts that are walked at once; bounds the arrays, however long a text is.
STRETCH = 1 << 20
_CODES = np.arange(256)
_ALNUM = ((_CODES >= 97) & (_CODES <= 122)) | ((_CODES >= 48) & (_CODES <= 57))


def byte_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; a missing text is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    if data is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


#: Size of the table of beginnings, in bits of its index.
TABLE_BITS = 20


def _pairs(data: np.ndarray) -> np.ndarray:
    """Each byte with the next one, as one number."""
    return data[:-1].astype(np.uint16) << np.uint16(8) | data[1:]


def _slots(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The place in a table of two pairs, or of two such places, that follow each other."""
    mixed = first.astype(np.uint32) * np.uint32(0x9E3779B1) + second.astype(np.uint32) * np.uint32(0x85EBCA77)
    return (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x9E3779B1) >> np.uint32(32 - TABLE_BITS)


@dataclass
class Trie:
    """edges: sorted; name: per node the name that ends there, or -1; first and second: the node of each byte and pair, or 0.

    Tables of fixed size tell which starts may matter at all: the single bytes and pairs
    that begin a name of one, or of two or three bytes; the first four bytes of names up to
    seven; the first four and, where these fit, the first eight of longer ones.
    """

    edges: np.ndarray
    name: np.ndarray
    first: np.ndarray
    second: np.ndarray
    one: np.ndarray
    short: np.ndarray
    four: np.ndarray
    more: np.ndarray
    eight: np.ndarray

    def child(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The next nodes, 0 where there is none."""
        key = node << 8 | byte
        place = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
        return np.where(self.edges[place] == key, place + 1, 0)

    def places(self, data: np.ndarray, offsets: np.ndarray, alone: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first byte in the buffer, name) of every place of every name.

        With `alone`, no ASCII letter or digit may touch the place (texts and names in small letters).
        """
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(self.edges):
            begins = np.zeros(len(data) + 1, dtype=bool)
            begins[offsets] = True
            for low in range(0, len(data), STRETCH):
                self._walk(data, offsets, begins, low, min(len(data), low + STRETCH), alone, found)
        if not found:
            return (np.zeros(0, dtype=np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found))

    def _walk(self, data, offsets, begins, low, high, alone, found) -> None:
        start = low + np.flatnonzero(self._may_start(data, low, high))
        if alone:
            start = start[begins[start] | ~_ALNUM[data[start - 1]]]  # the buffer's first byte begins a text
        edge = np.clip(offsets, low, high)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(edge))[start - low]
        limit = offsets[text + 1]
        node = np.zeros(len(start), dtype=np.int64)
        depth = 0
        while len(start):
            if depth == 0:
                node = self.first[data[start]]
            elif depth == 1:
                node = self.second[data[start].astype(np.int64) << 8 | data[start + 1]]
            else:
                node = self.child(node, data[start + depth])
            depth += 1
            go = np.flatnonzero(node)
            start, text, limit, node = start[go], text[go], limit[go], node[go]
            at = np.flatnonzero(self.name[node] >= 0)
            if alone:
                end = start[at] + depth
                at = at[(end == limit[at]) | ~_ALNUM[data[np.minimum(end, len(data) - 1)]]]
            if len(at):
                found.append((text[at], start[at], self.name[node[at]]))
            go = np.flatnonzero(start + depth < limit)
            start, text, limit, node = start[go], text[go], limit[go], node[go]

    def _may_start(self, data, low, high) -> np.ndarray:
        n = high - low
        some = np.append(data[low : high + 7], np.zeros(max(0, high + 7 - len(data)), dtype=np.uint8))
        pairs = _pairs(some)
        slots = _slots(pairs[: n + 4], pairs[2 : n + 6])
        out = self.four[slots[:n]]
        at = np.flatnonzero(self.more[slots[:n]])
        out[at] |= self.eight[_slots(slots[at], slots[at + 4])]
        if self.short.any():
            out |= self.short[pairs[:n]]
        if self.one.any():
            out |= self.one[some[:n]]
        return out


def build(names: pa.Array) -> Trie:
    """The trie of different names that are not empty; a name is known by its place in the array."""
    order = pc.sort_indices(names.cast(pa.large_binary())).to_numpy()
    data, offsets = byte_buffer(names.take(pa.array(order)))
    start, size = offsets[:-1], np.diff(offsets)
    node = np.zeros(len(order), dtype=np.int64)
    alive = np.flatnonzero(size > 0)
    edges, ends, nodes = [], [np.array([-1])], 1
    depth = 0
    while len(alive):
        # Names are sorted and nodes numbered in that order, so equal keys stand together.
        key = node[alive] << 8 | data[start[alive] + depth]
        fresh = np.append(True, key[1:] != key[:-1])
        node[alive] = np.cumsum(fresh) - 1 + nodes
        edges.append(key[fresh])
        end = np.full(int(fresh.sum()), -1)
        whole = alive[size[alive] == depth + 1]
        end[node[whole] - nodes] = order[whole]
        ends.append(end)
        nodes += len(end)
        alive = alive[size[alive] > depth + 1]
        depth += 1
    first, second = np.zeros(256, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)
    if edges:
        first[edges[0]] = np.arange(len(edges[0])) + 1
    if len(edges) > 1:
        second[edges[0][(edges[1] >> 8) - 1] << 8 | edges[1] & 255] = np.arange(len(edges[1])) + 1 + len(edges[0])
    one, short, (four, more, eight) = np.zeros(256, dtype=bool), np.zeros(1 << 16, dtype=bool), np.zeros((3, 1 << TABLE_BITS), dtype=bool)
    one[data[start[size == 1]]] = True
    pair = lambda begin, i: data[begin + i].astype(np.uint16) << np.uint16(8) | data[begin + i + 1]
    slot = lambda begin, i: _slots(pair(begin, i), pair(begin, i + 2))
    short[pair(start[(size == 2) | (size == 3)], 0)] = True
    four[slot(start[(size > 3) & (size < 8)], 0)] = True
    begin = start[size > 7]
    more[slot(begin, 0)] = True
    eight[_slots(slot(begin, 0), slot(begin, 4))] = True
    return Trie(np.concatenate([np.zeros(0, dtype=np.int64), *edges]), np.concatenate(ends), first, second, one, short, four, more, eight)


def named_in(trie: Trie, rows: pa.StructArray, texts: pa.Array, alone: bool = False) -> pa.ListArray:
    """Per text the rows of the different names in it, by their number."""
    data, offsets = byte_buffer(texts)
    text, _, name = trie.places(data, offsets, alone)
    pair = np.unique(text.astype(np.int64) << 32 | name)
    ends = np.searchsorted(pair, np.arange(len(texts) + 1, dtype=np.int64) << 32)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), rows.take(pa.array(pair & 0xFFFFFFFF)))
