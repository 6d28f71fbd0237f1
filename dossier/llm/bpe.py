"""Byte-level BPE as a streaming transducer with bounded lookahead, and its decoder.

Encoding cuts a text into pre-tokens. The bytes of a pre-token flow through a buffer; the
merges are applied to the buffer, and the tokens that end at least `lookahead` bytes
before its end are emitted, because no later byte can change them. The buffer's size
depends on the merge list alone, so a pre-token of any length takes constant memory.
Short pre-tokens fit the buffer and repeat often: their tokens are kept in a bounded table.

Sufficient lookahead. Run the merges, by rank, over some bytes twice, with different bytes
after them. The two token rows can differ only in a stretch at the end. It grows to the
left when a merge (a, b) joins the last equal token a to the first differing token b, and
then by the length of a; each merge can do so once. The next such merge (a', b') has a
later rank, and b' begins either with the product ab or, where the join did not happen,
with a that was itself not joined before. `sufficient_lookahead` takes the greatest sum of
lengths over all chains of merges that these rules permit.

Decoding maps ids to bytes and feeds them to a UTF-8 state machine that keeps the bytes of
an unfinished character between calls.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from dossier.llm.arrow_text import numbered, pieces

KEPT_WORDS = 300_000
KEPT_CHARS = 48
TOGETHER = 4096
NONE = (1 << 31) - 1
EDGE = (1 << 31) - 1
STRETCH_CHARS = 1 << 20
DECODE_IDS = 1 << 16

# The pre-token pattern of the vocabulary, in general and for texts below
# U+0250, where the standard library's classes can say it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACE = r"\t\n\x0b\x0c\r \x85\xa0"
_OTHER_NUMBERS = "²³¹¼½¾"
LATIN_PATTERN = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_{_OTHER_NUMBERS}]+| ?[\d{_OTHER_NUMBERS}]+"
    rf"| ?(?:[^\w{_SPACE}]|_)+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
_GENERAL, _LATIN = regex.compile(PATTERN), re.compile(LATIN_PATTERN)
_BEYOND_LATIN = re.compile("[^\x00-ɏ]")
_SAFE_CUT = re.compile(rf"[^{_SPACE}](?=[{_SPACE}])")


def byte_alphabet() -> dict[str, int]:
    """Which byte each character of a byte-level vocabulary stands for: printable ones for themselves, the rest in order from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Merges and tokens of a byte-level vocabulary file."""

    def __init__(self, body: bytes) -> None:
        spec = json.loads(body)
        letters = byte_alphabet()
        raw = lambda token: bytes(letters[c] for c in token)
        ids = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token_bytes: list[bytes] = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for token, i in ids.items():
            if token not in self.special:
                self.token_bytes[i] = raw(token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.byte_id = [ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.pairs: list[tuple[int, int, int]] = []
        self.rank: dict[tuple[int, int], int] = {}
        for merge in spec["model"]["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.rank[ids[a], ids[b]] = len(self.pairs)
            self.pairs.append((ids[a], ids[b], ids[a + b]))
        self.product = [c for _, _, c in self.pairs]
        self.lookahead = sufficient_lookahead(self.pairs, self.token_bytes)
        self.buffer = 4 * self.lookahead
        self.products = np.array(self.product or [0], dtype=np.int64)
        self.byte_ids = np.array(self.byte_id, dtype=np.int64)
        self.table = RankTable(self.rank)
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None


def sufficient_lookahead(pairs: list[tuple[int, int, int]], token_bytes: list[bytes]) -> int:
    """A number of bytes after which no token can change any more; see the module's text."""
    made_by = {c: r for r, (_, _, c) in reversed(list(enumerate(pairs)))}
    joined: dict[int, int] = {}  # product of the last join -> longest chain from there
    alone: dict[int, int] = {}  # token that was left alone -> longest chain from there
    later: dict[int, list[tuple[int, int]]] = {}  # rank -> what may be used for lower ranks only
    longest = 0
    for r in range(len(pairs) - 1, -1, -1):
        a, b, c = pairs[r]
        reach = len(token_bytes[a]) + max(joined.get(c, 0), alone.get(a, 0))
        longest = max(longest, reach)
        token = b
        alone[token] = max(alone.get(token, 0), reach)
        while True:
            joined[token] = max(joined.get(token, 0), reach)
            made = made_by.get(token)
            if made is None:
                break
            token = pairs[made][0]
            later.setdefault(made, []).append((token, reach))
        for token, reach in later.pop(r, ()):
            alone[token] = max(alone.get(token, 0), reach)
    return longest


def merged(parts: list[int], vocabulary: Vocabulary) -> list[int]:
    """Apply the merges to a row of ids: the lowest rank first, from left to right."""
    rank, product = vocabulary.rank.get, vocabulary.product
    none = NONE
    if len(parts) <= 64:
        ranks = [rank(pair, none) for pair in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [product[best]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), none)
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), none)
        return parts
    while True:  # a round applies one rank everywhere; a buffer holds few different ranks
        ranks = [rank(pair, none) for pair in zip(parts, parts[1:])]
        best = min(ranks, default=none)
        if best == none:
            return parts
        out, i, last = [], 0, len(parts) - 1
        while i < last:
            if ranks[i] == best:
                out.append(product[best])
                i += 2
            else:
                out.append(parts[i])
                i += 1
        if i == last:
            out.append(parts[last])
        parts = out


def stream_tokens(chunks: Iterable[bytes], vocabulary: Vocabulary) -> Iterator[list[int]]:
    """The tokens of one pre-token that arrives in chunks; each list is final."""
    byte_id, length = vocabulary.byte_id, vocabulary.token_bytes
    held = b""
    for chunk in chunks:
        held += chunk
        while len(held) >= vocabulary.buffer:
            tokens = merged([byte_id[x] for x in held[: vocabulary.buffer]], vocabulary)
            end, stable = vocabulary.buffer - vocabulary.lookahead, 0
            out = []
            for token in tokens:
                if stable + len(length[token]) > end:
                    break
                out.append(token)
                stable += len(length[token])
            held = held[stable:]
            yield out
    if held:
        yield merged([byte_id[x] for x in held], vocabulary)


def _pack(tokens: list[int]) -> bytes:
    return np.array(tokens, dtype="<u4").tobytes()


def _long_word(raw: bytes, vocabulary: Vocabulary) -> bytes:
    """Ids of a pre-token of any length as little-endian bytes."""
    step = vocabulary.buffer
    return b"".join(map(_pack, stream_tokens((raw[i : i + step] for i in range(0, len(raw), step)), vocabulary)))


class RankTable:
    """The merges as a hash table that numpy can ask for many pairs at once."""

    def __init__(self, rank: dict[tuple[int, int], int]) -> None:
        self.bits = max(10, (16 * len(rank)).bit_length())
        self.keys = np.full((1 << self.bits) + 64, -1, dtype=np.int64)
        self.ranks = np.full(len(self.keys), NONE, dtype=np.int32)
        self.probes = 1
        for (a, b), r in rank.items():
            at = int(self.slot(np.array([a << 32 | b], dtype=np.int64))[0])
            n = 1
            while self.keys[at] != -1:
                at, n = at + 1, n + 1
            self.keys[at], self.ranks[at], self.probes = a << 32 | b, r, max(self.probes, n)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) << 32 | b
        at = self.slot(keys)
        out = np.where(self.keys[at] == keys, self.ranks[at], NONE)
        for n in range(1, self.probes):
            out = np.where(self.keys[at + n] == keys, self.ranks[at + n], out)
        return out


def merge_together(words: list[bytes], vocabulary: Vocabulary) -> list[bytes]:
    """The ids of many short pre-tokens: in each step every word makes its next merge."""
    table, product = vocabulary.table, vocabulary.products
    lengths = np.array([len(w) for w in words])
    n, width = len(words), int(lengths.max()) + 1
    ids = np.full((n, width), EDGE, dtype=np.int64)
    ids[np.arange(width) < lengths[:, None]] = vocabulary.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
    after = np.tile(np.minimum(np.arange(1, width + 1), width - 1), (n, 1))
    before = np.tile(np.maximum(np.arange(-1, width - 1), 0), (n, 1))
    ranks = np.full((n, width), NONE, dtype=np.int32)
    ranks[:, :-1] = table.of(ids[:, :-1], ids[:, 1:])
    rows = np.arange(n)
    while len(rows):
        at = ranks[rows].argmin(axis=1)
        best = ranks[rows, at]
        go = best < NONE
        rows, at, best = rows[go], at[go], best[go]
        gone = after[rows, at]
        right, left = after[rows, gone], before[rows, at]
        made = product[best]
        ids[rows, at], ids[rows, gone] = made, EDGE
        after[rows, at], before[rows, right] = right, at
        ranks[rows, gone] = NONE
        ranks[rows, at] = table.of(made, ids[rows, right])
        inner = at > 0
        ranks[rows[inner], left[inner]] = table.of(ids[rows[inner], left[inner]], made[inner])
    alive = ids != EDGE
    packed = ids[alive].astype("<u4").tobytes()
    ends = (4 * np.cumsum(alive.sum(axis=1))).tolist()
    return [packed[a:b] for a, b in zip([0, *ends], ends)]


def learn(words: set[str], vocabulary: Vocabulary) -> dict[str, bytes]:
    """Ids of pre-tokens not met lately; short ones are kept for later, in two bounded generations."""
    found, short = {}, []
    for word in words:
        raw = word.encode()
        if len(word) <= KEPT_CHARS:
            short.append((len(raw), raw, word))
        else:
            found[word] = _long_word(raw, vocabulary)
    short.sort()
    for i in range(0, len(short), TOGETHER):
        some = short[i : i + TOGETHER]
        found.update(zip([x[2] for x in some], merge_together([x[1] for x in some], vocabulary)))
    vocabulary.kept.update((word, found[word]) for _, _, word in short)
    if len(vocabulary.kept) > KEPT_WORDS:
        vocabulary.older, vocabulary.kept = vocabulary.kept, {}
    return found


def lookup(words: list[str], vocabulary: Vocabulary) -> list[bytes]:
    """Ids of each pre-token as little-endian bytes."""
    found = list(map(vocabulary.kept.get, words))
    if None in found:
        missing = {w for w, x in zip(words, found) if x is None}
        again = {w: x for w in missing if (x := vocabulary.older.get(w)) is not None}
        vocabulary.kept.update(again)
        again.update(learn(missing - again.keys(), vocabulary))
        found = [x if x is not None else again[w] for x, w in zip(found, words)]
    return found


def stretches(text: str, size: int = STRETCH_CHARS) -> Iterator[str]:
    """Cut a text where a pre-token must end: between a non-space and a space."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE_CUT.search(text, start + size)
        if not cut:
            break
        yield text[start : cut.end()]
        start = cut.end()
    yield text[start:]


def pre_tokens(text: str) -> list[str]:
    return (_GENERAL if _BEYOND_LATIN.search(text) else _LATIN).findall(text)


def encode_together(texts: list[str], vocabulary: Vocabulary) -> list[list[bytes]]:
    """The ids of several texts, each as a list of stretches; new pre-tokens of all texts are merged at once."""
    plain = [k for k, text in enumerate(texts) if len(text) <= STRETCH_CHARS and not (vocabulary.split_special and vocabulary.split_special.search(text))]
    words = [pre_tokens(texts[k]) for k in plain]
    found = lookup(list(chain.from_iterable(words)), vocabulary)
    out: list[list[bytes]] = [[] for _ in texts]
    at = 0
    for k, some in zip(plain, words):
        out[k] = [b"".join(found[at : at + len(some)])]
        at += len(some)
    return out


def encode_stream(text: str, vocabulary: Vocabulary) -> Iterator[bytes]:
    """The ids of a whole text, as stretches of little-endian 32-bit numbers."""
    parts = vocabulary.split_special.split(text) if vocabulary.split_special else [text]
    for part in parts:
        if part in vocabulary.special:
            yield _pack([vocabulary.special[part]])
            continue
        for stretch in stretches(part):
            yield b"".join(lookup(pre_tokens(stretch), vocabulary))


class Decoder:
    """Ids to text, piece by piece; unfinished characters wait, broken ones become U+FFFD."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.token = vocabulary.token_bytes.__getitem__
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(map(self.token, ids)))

    def end(self) -> str:
        return self.state.decode(b"", True)


def encode(text: str, vocabulary: Vocabulary) -> np.ndarray:
    return np.frombuffer(b"".join(encode_stream(text, vocabulary)), dtype="<u4")


def decode(ids: Iterable[int], vocabulary: Vocabulary) -> str:
    decoder = Decoder(vocabulary)
    return decoder.feed(ids) + decoder.end()


_loaded: dict[str, Vocabulary] = {}


def vocabulary_of(body: bytes) -> Vocabulary:
    """The vocabulary of a file's content, built once per process."""
    key = hashlib.sha256(body).hexdigest()
    if key not in _loaded:
        _loaded[key] = Vocabulary(body)
    return _loaded[key]


def encode_texts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256, decoded_sha256 and the named outputs: ids (array<int>), decoded (string).

    The vocabulary file is read by the driver and broadcast; its size is that of the
    vocabulary, never of the data. Null and empty texts have no tokens and decode to an
    empty text. Repeated rows and null ids give a row each. Without outputs a text of any
    length passes through in stretches.
    """
    with open(vocabulary_path, "rb") as file:
        body = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of(body.value)
        for batch in pieces(batches):
            counts, made_hex, back_hex, tokens, shown = [], [], [], [], []
            texts = [text or "" for text in batch.column(1).to_pylist()]
            for text, known in zip(texts, encode_together(texts, vocabulary)):
                n, made, back, decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder(vocabulary)
                parts = []
                for packed in known or encode_stream(text, vocabulary):
                    made.update(packed)
                    numbers = np.frombuffer(packed, dtype="<i4")
                    n += len(numbers)
                    if "ids" in outputs:
                        tokens.append(numbers)
                    for i in range(0, len(numbers), DECODE_IDS):
                        piece = decoder.feed(numbers[i : i + DECODE_IDS].tolist())
                        back.update(piece.encode())
                        if "decoded" in outputs:
                            parts.append(piece)
                parts.append(rest := decoder.end())
                back.update(rest.encode())
                counts.append(n), made_hex.append(made.hexdigest()), back_hex.append(back.hexdigest()), shown.append("".join(parts))
            columns = {"id": batch.column(0), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(made_hex, pa.string()), "decoded_sha256": pa.array(back_hex, pa.string())}
            if "ids" in outputs:
                ends = pa.array(np.cumsum([0, *counts]).astype(np.int32))
                columns["ids"] = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, dtype=np.int32), *tokens])))
            if "decoded" in outputs:
                columns["decoded"] = pa.array(shown, pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    source = numbered(docs, id_col, text_col)
    kind = source.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ("ids" in outputs) + ", decoded string" * ("decoded" in outputs)
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)
