"""Log-probabilities of texts by a weighted backoff automaton over smoothed n-grams.

The model. p(w) = (c(w) + 1) / (N + V + 1) at the bottom, and above it, for a history h
with h' its shorter rest, p(w | h) = s c(h w) / c(h) + (1 - s) p(w | h'), where the share s
depends on c(h) by its power of two. So every p(. | h) sums to one over the V known tokens
and one unknown. The shares are those that make learned texts most probable when each is
judged by the counts of all others (deleted interpolation).
As an automaton: seen histories are states, seen n-grams are arcs with log p, and a failure
arc leads from h to h' with weight log(1 - s). A text is read once from left to right: the
state is carried from token to token, failure arcs are taken while the token has no arc,
and the weights add up.

The n-grams of a corpus fit no single task, so the counts never come together in one place:

1. Texts are packed into blocks of bounded size, which are written once.
2. A block sends each of its different n-grams once, with its count in learned texts. They
   travel as sorted hashes, packed by ranges of the hash (buckets), so that an n-gram that
   is everywhere costs one entry per block.
3. A bucket adds up the counts of all blocks and answers every block in the block's order.
4. A block with its answers holds the part of the automaton that its texts can meet. It adds
   to a table of fixed size (how often which ratio of c(h w) / c(h) to p(w | h') is met, by
   c(h)), from which the shares follow, order by order.
5. With the shares the part is built, and the block's texts are run through it.

All n-grams of all learned texts count; there are no cut-offs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.arrow_text import DENSE, combine, hash_text, text_buffer, words_of
from dossier.session import find_package, shared_dir

#: Text bytes of a block (a longer text is a block of its own), and per bucket.
BLOCK_BYTES, BUCKET_BYTES = 12 << 20, 12 << 20
ORDER = 2
FOLDS, HELD_OUT = 7, 2
#: The shares: classes of c(h) by powers of two, and bins of the ratio by half powers (bin 0 for a ratio of nothing).
CLASSES, BINS, UNIT_BIN = 48, 128, 32
#: Tokens that one run of the automaton reads; a longer text is read by several, each started from the history before it.
STRETCH = 256
#: Marks before and after a text. They hold a space, so no word is one of them.
BEGIN, END = np.uint64(hash_text("< begin")), np.uint64(hash_text("< end"))
_ONE = np.uint64(1)
BEGIN_KEY = int(BEGIN >> _ONE)


def held_out(id_col: str) -> F.Column:
    """One row in seven, by its id, is never learned from; a null id counts as an empty text and is learned from."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


# --- tokens and n-grams of a block ------------------------------------------------


@dataclass
class Tokens:
    """The tokens of texts with their marks: hashes, the place of each text's BEGIN (one more at the end), and each token's text."""

    hash: np.ndarray
    begin: np.ndarray
    owner: np.ndarray

    def place(self) -> np.ndarray:
        return np.arange(len(self.hash)) - self.begin[self.owner]


def tokens_of(column: pa.Array) -> Tokens:
    data, offsets = text_buffer(column)
    words = words_of(data, offsets, DENSE)
    texts = len(offsets) - 1
    count = np.diff(words.first)
    begin = words.first + 2 * np.arange(texts + 1)
    out = np.empty(int(begin[-1]), dtype=np.uint64)
    out[np.arange(len(words.hash)) + 2 * np.repeat(np.arange(texts), count) + 1] = words.hash
    out[begin[:-1]], out[begin[1:] - 1] = BEGIN, END
    return Tokens(out, begin, np.repeat(np.arange(texts), count + 2))


def ngram_ends(tokens: Tokens, order: int) -> np.ndarray:
    """Places where an n-gram of this order ends: all of it lies in one text."""
    return np.flatnonzero(tokens.place() >= order - 1)


def ngram_keys(tokens: Tokens, order: int, ends: np.ndarray) -> np.ndarray:
    """63-bit keys of the n-grams that end at these places."""
    if order == 1:
        return tokens.hash[ends] >> _ONE
    return combine([tokens.hash[ends - i] for i in range(order - 1, -1, -1)]) >> _ONE


def counted(tokens: Tokens, order: int, learned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams, sorted, and how often each stands in learned texts."""
    ends = ngram_ends(tokens, order)
    marked = np.sort((ngram_keys(tokens, order, ends) << _ONE) | learned[tokens.owner[ends]].astype(np.uint64))
    keys = marked >> _ONE
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.add.reduceat(marked & _ONE, first).astype(np.int64) if len(first) else np.zeros(0, dtype=np.int64)


# --- packing ----------------------------------------------------------------------


def pack(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0 on as planes of bytes, as many as the largest needs; planes of small numbers compress well."""
    numbers = numbers.astype("<u8")
    width = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + numbers.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(raw: bytes) -> np.ndarray:
    width = raw[0]
    planes = np.frombuffer(raw, dtype=np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def bucket_edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket, an equal range of the 63-bit keys, begins in sorted keys; and the end."""
    starts = [(b << 63) // buckets for b in range(buckets)]
    return np.append(np.searchsorted(keys, np.array(starts, dtype=np.uint64)), len(keys))


def _blocks(source: DataFrame) -> DataFrame:
    """(block, bytes, payload): rows (id, text, learned) in packs of BLOCK_BYTES of text."""

    def row(some: list[pa.RecordBatch], size: int) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, some[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for batch in pa.Table.from_batches(some).combine_chunks().to_batches():
                out.write_batch(batch)
        return pa.RecordBatch.from_arrays([pa.array([uuid4().hex]), pa.array([size]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "bytes", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            _, offsets = text_buffer(batch.column(1))
            start = 0
            while start < batch.num_rows:
                room = max(0, BLOCK_BYTES - size)
                end = max(start, int(np.searchsorted(offsets, offsets[start] + room, side="right")) - 1)
                if end == start and held:
                    yield row(held, size)
                    held, size = [], 0
                    continue
                end = max(end, start + 1)
                held.append(batch.slice(start, end - start))
                size += int(offsets[end] - offsets[start])
                start = end
        if held:
            yield row(held, size)

    return source.mapInArrow(run, "block string, bytes long, payload binary")


def _texts(payload: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(payload).read_all().combine_chunks().to_batches()[0]


def _packets(blocks: DataFrame, order: int, buckets: int) -> DataFrame:
    """(size, bucket, block, keys, counts): what a block sends to each bucket, for n-grams of each size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                texts = _texts(batch.column(1)[i].as_py())
                tokens, learned = tokens_of(texts.column(1)), texts.column(2).to_numpy(zero_copy_only=False)
                for size in range(1, order + 1):
                    keys, counts = counted(tokens, size, learned)
                    edges = bucket_edges(keys, buckets)
                    some = np.flatnonzero(np.diff(edges))
                    for part in np.array_split(some, max(1, len(some) // 256)):
                        of = [slice(edges[b], edges[b + 1]) for b in part]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(len(part), size, dtype=np.int32)), pa.array(part.astype(np.int32)), pa.array([batch.column(0)[i].as_py()] * len(part), pa.string()),
                                pa.array([pack(np.diff(keys[s], prepend=np.uint64((int(b) << 63) // buckets))) for b, s in zip(part, of)], pa.binary()), pa.array([pack(counts[s]) for s in of], pa.binary()),
                            ],
                            ["size", "bucket", "block", "keys", "counts"],
                        )

    return blocks.select("block", "payload").mapInArrow(run, "size int, bucket int, block string, keys binary, counts binary")


def add_up(packets: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """For packets of (sorted different keys, counts): the sum over all packets for each key, in each packet's order."""
    keys, counts = (np.concatenate(x) for x in zip(*packets))
    order = np.argsort(keys, kind="stable")  # the packets are sorted runs
    inner = keys[order]
    first = np.flatnonzero(np.append(True, inner[1:] != inner[:-1]))
    totals = np.empty(len(keys), dtype=np.int64)
    totals[order] = np.repeat(np.add.reduceat(counts[order], first), np.diff(np.append(first, len(keys))))
    return np.split(totals, np.cumsum([len(k) for k, _ in packets])[:-1])


def _answers(packets: DataFrame) -> DataFrame:
    """(size, bucket, block, totals, types, occurrences): the corpus counts in the order of the packet.

    types and occurrences, in one row of a bucket of single tokens: its learned tokens, without BEGIN.
    """

    def run(group: pa.Table) -> pa.Table:
        read = []
        for keys, counts in zip(group.column("keys").to_pylist(), group.column("counts").to_pylist()):
            # Keys from the bucket's lower end on, which is all that adding up needs.
            read.append((np.cumsum(unpack(keys), dtype=np.uint64), unpack(counts).astype(np.int64)))
        totals = add_up(read)
        types, occurrences = np.zeros(len(read), dtype=np.int64), np.zeros(len(read), dtype=np.int64)
        if group.column("size")[0].as_py() == 1:
            mark = BEGIN_KEY - (group.column("bucket")[0].as_py() << 63) // group.column("buckets")[0].as_py()
            keys, at = np.unique(np.concatenate([k for k, _ in read]), return_index=True)
            count = np.concatenate(totals)[at]
            if mark >= 0:
                count[keys == np.uint64(mark)] = 0
            types[0], occurrences[0] = (count > 0).sum(), count.sum()
        return pa.table([*(group.column(c) for c in ("size", "bucket", "block")), pa.array([pack(t) for t in totals], pa.binary()), pa.array(types), pa.array(occurrences)], ["size", "bucket", "block", "totals", "types", "occurrences"])

    return packets.groupBy("size", "bucket").applyInArrow(run, "size int, bucket int, block string, totals binary, types long, occurrences long")


# --- the shares -----------------------------------------------------------------------


@dataclass
class Grams:
    """The different n-grams of each size in some tokens, with their corpus counts.

    index[k]: per token the number of the n-gram of size k + 1 that ends there, or -1;
    sample[k]: per n-gram a place where it ends; totals[k]: its count, and p[k]: its probability.
    """

    index: list[np.ndarray]
    sample: list[np.ndarray]
    totals: list[np.ndarray]
    p: list[np.ndarray]

    def parts(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """For the n-grams of a size: the numbers of the histories, and of the rests, one token shorter."""
        end = self.sample[size - 1]
        return self.index[size - 2][end - 1], self.index[size - 2][end]


def grams_of(tokens: Tokens, totals: list[np.ndarray], shares: list[np.ndarray], types: int, occurrences: int) -> Grams:
    """Probabilities of the n-grams, as far as there are shares. totals[k]: counts of the different n-grams of size k + 1 by key."""
    out = Grams([], [], totals, [(totals[0] + 1) / (occurrences + types + 1)])
    for size in range(1, len(totals) + 1):
        ends = ngram_ends(tokens, size)
        _, at, inverse = np.unique(ngram_keys(tokens, size, ends), return_index=True, return_inverse=True)
        out.index.append(np.full(len(tokens.hash), -1, dtype=np.int64))
        out.index[-1][ends] = inverse
        out.sample.append(ends[at])
    for size, share in enumerate(shares, 2):
        history, rest = out.parts(size)
        context = totals[size - 2][history]
        s = share_of(share, context)
        out.p.append(s * totals[size - 1] / np.maximum(context, 1) + (1 - s) * out.p[-1][rest])
    return out


def share_of(share: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The share for histories with these counts; none for an unseen history."""
    return np.where(count > 0, share[np.maximum(np.frexp(count.astype(np.float64))[1] - 1, 0)], 0.0)


def ratios(tokens: Tokens, learned: np.ndarray, grams: Grams, size: int) -> np.ndarray:
    """CLASSES x BINS: how often a token of a learned text meets which ratio, its own text's counts left out."""

    def per_text(k: int) -> tuple[np.ndarray, np.ndarray]:
        places = np.flatnonzero((grams.index[k - 1] >= 0) & learned[tokens.owner])
        return np.unique((tokens.owner[places].astype(np.int64) << 40) | grams.index[k - 1][places], return_counts=True)

    pairs, own = per_text(size)
    shorter, shorter_own = per_text(size - 1)
    gram = pairs & ((1 << 40) - 1)
    history, rest = grams.parts(size)
    before = (pairs >> 40 << 40) | history[gram]
    context = grams.totals[size - 2][history[gram]] - shorter_own[np.searchsorted(shorter, before)]
    seen = context > 0
    count, context, own = (grams.totals[size - 1][gram] - own)[seen], context[seen], own[seen]
    ratio = count / context / grams.p[size - 2][rest[gram[seen]]]
    bins = np.zeros(len(ratio), dtype=np.int64)
    some = ratio > 0
    bins[some] = np.clip(np.floor(2 * np.log2(ratio[some])) + UNIT_BIN, 1, BINS - 1)
    kind = np.minimum(np.frexp(context.astype(np.float64))[1] - 1, CLASSES - 1)
    return np.bincount(kind * BINS + bins, own, CLASSES * BINS).astype(np.int64).reshape(CLASSES, BINS)


def fit_shares(table: np.ndarray) -> np.ndarray:
    """The share of each class that makes its ratios most probable, by expectation and maximisation.

    One token for and one against the history stand in every class, so no share is 0 or 1.
    """
    ratio = np.append(0.0, 2.0 ** ((np.arange(1, BINS) - UNIT_BIN + 0.5) / 2))
    share = np.full(CLASSES, 0.5)
    for _ in range(200):
        mine = share[:, None] * ratio
        share = ((table * mine / (mine + 1 - share[:, None])).sum(axis=1) + 1) / (table.sum(axis=1) + 2)
    return share


# --- the automaton ------------------------------------------------------------------


@dataclass
class Automaton:
    """States are numbered, 0 is the empty history. Arcs of other states are sorted by state * words + word."""

    words: int
    root_weight: np.ndarray
    root_next: np.ndarray
    arc: np.ndarray
    weight: np.ndarray
    next: np.ndarray
    fail_weight: np.ndarray
    fail_next: np.ndarray

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weights, next states) of reading one word in each of many states."""
        total, state = np.zeros(len(state)), state.copy()
        at = np.flatnonzero(state)
        while len(at):
            key = state[at] * self.words + word[at]
            place = np.searchsorted(self.arc, key)
            hit = self.arc[np.minimum(place, len(self.arc) - 1)] == key if len(self.arc) else np.zeros(len(at), dtype=bool)
            done, found = at[hit], place[hit]
            total[done] += self.weight[found]
            state[done] = -1 - self.next[found]  # negative: the word is read
            at = at[~hit]
            total[at] += self.fail_weight[state[at]]
            state[at] = self.fail_next[state[at]]
            at = at[state[at] > 0]
        root = state == 0
        total[root] += self.root_weight[word[root]]
        return total, np.where(root, self.root_next[word], -1 - state)


def build(grams: Grams, shares: list[np.ndarray]) -> Automaton:
    """The part of the automaton that the tokens of these n-grams can meet."""
    totals, order = grams.totals, len(grams.totals)
    state_of, states = [], 1
    for counts in totals[:-1]:
        seen = counts > 0
        state_of.append(np.where(seen, np.cumsum(seen) - 1 + states, 0))
        states += int(seen.sum())
    fail_weight, fail_next = np.zeros(states), np.zeros(states, dtype=np.int64)
    words = len(totals[0])
    arcs, weights, nexts = [], [], []
    state_at = lambda size, place: state_of[size - 1][grams.index[size - 1][place]]
    for size in range(2, order + 1):
        history, _ = grams.parts(size)
        seen = totals[size - 1] > 0
        end = grams.sample[size - 1][seen]
        arcs.append(state_of[size - 2][history[seen]] * words + grams.index[0][end])
        weights.append(np.log10(grams.p[size - 1][seen]))
        nexts.append(state_at(min(size, order - 1), end))
        # Failure arcs of the histories of one token less: to the state without their first token.
        known = totals[size - 2] > 0
        fail_weight[state_of[size - 2][known]] = np.log10(1 - share_of(shares[size - 2], totals[size - 2][known]))
        if size > 2:
            fail_next[state_of[size - 2][known]] = state_at(size - 2, grams.sample[size - 2][known])
    arc = np.concatenate([np.zeros(0, dtype=np.int64), *arcs])
    by = np.argsort(arc)
    flat = lambda parts, kind: np.concatenate([np.zeros(0, dtype=kind), *parts])[by]
    root_next = state_of[0] if order > 1 else np.zeros(words, dtype=np.int64)
    return Automaton(words, np.log10(grams.p[0]), root_next, arc[by], flat(weights, np.float64), flat(nexts, np.int64), fail_weight, fail_next)


def traverse(automaton: Automaton, tokens: Tokens, word: np.ndarray, order: int) -> np.ndarray:
    """The sum of weights of each text: all stretches are read side by side, each from left to right with its state.

    A state depends on the last order - 1 tokens alone, so a stretch inside a text first
    reads those before it, without counting them.
    """
    length = np.diff(tokens.begin)
    pieces = -(-(length - 1) // STRETCH)
    text = np.repeat(np.arange(len(length)), pieces)
    number = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = tokens.begin[text] + 1 + number * STRETCH  # the first token that counts
    end = np.minimum(start + STRETCH, tokens.begin[text + 1])
    place = np.maximum(tokens.begin[text], start - max(1, order - 1))
    state, total = np.zeros(len(text), dtype=np.int64), np.zeros(len(text))
    alive = np.arange(len(text))
    while len(alive):
        weight, state[alive] = automaton.step(state[alive], word[place[alive]])
        counts = place[alive] >= start[alive]
        total[alive[counts]] += weight[counts]
        place[alive] += 1
        alive = alive[place[alive] < end[alive]]
    return np.bincount(text, total, len(length))


# --- on Spark -------------------------------------------------------------------------


def _block_of(texts: pa.RecordBatch, answers: list[dict], order: int) -> tuple[Tokens, np.ndarray, list[np.ndarray]]:
    """The tokens of a block, which of its texts are learned from, and the totals of its n-grams."""
    totals = [np.concatenate([np.zeros(0, dtype=np.int64), *(unpack(a["totals"]).astype(np.int64) for a in answers if a["size"] == size)]) for size in range(1, order + 1)]
    return tokens_of(texts.column(1)), texts.column(2).to_numpy(zero_copy_only=False), totals


def _table(ready: DataFrame, order: int, shares: list[np.ndarray], types: int, occurrences: int) -> np.ndarray:
    """The ratios of all learned texts for the next size; every task sends at most CLASSES x BINS rows."""
    size = len(shares) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((CLASSES, BINS), dtype=np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                tokens, learned, totals = _block_of(_texts(batch.column(0)[i].as_py()), batch.column(1)[i].as_py(), order)
                total += ratios(tokens, learned, grams_of(tokens, totals[:size], shares, types, occurrences), size)
        kind, bins = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(bins.astype(np.int32)), pa.array(total[kind, bins])], ["kind", "bin", "n"])

    out = np.zeros((CLASSES, BINS), dtype=np.int64)
    for row in ready.mapInArrow(run, "kind int, bin int, n long").groupBy("kind", "bin").agg(F.sum("n").alias("n")).collect():
        out[row["kind"], row["bin"]] = row["n"]
    return out


def score_texts(docs: DataFrame, learn_from: F.Column | None = None, order: int = ORDER, shares: list[np.ndarray] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row per row of `docs`.

    score: log10 probability of the text's words and its end under the model of order
    `order`, learned from the rows where `learn_from` holds (by default, those that
    `held_out` leaves). base_score: the same under single tokens with add-one counts.
    n_known: tokens that stand in learned texts. `shares` gives the shares of the orders from
    2 on, by class of the history's count, instead of learning them.

    A null text is empty: one token, the end. Null ids and repeated rows give a row each and
    count each. Very long texts are read whole, in one task, which then needs memory in
    proportion. An empty table gives no rows; with nothing learned every token has
    probability one. Words are compared by 63-bit hashes.
    """
    spark = docs.sparkSession
    find_package(spark)
    learned = ~held_out(id_col) if learn_from is None else F.coalesce(learn_from, F.lit(False))
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), learned.alias("learned"))
    kind = source.schema["id"].dataType.simpleString()
    folder = f"{shared_dir(spark)}/language-model-{uuid4().hex}"

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    blocks = written(_blocks(source), "blocks")
    buckets = max(1, -(-(blocks.agg(F.sum("bytes")).first()[0] or 0) // BUCKET_BYTES))
    answers = written(_answers(_packets(blocks, order, buckets).withColumn("buckets", F.lit(buckets).cast("int"))), "answers")
    types, occurrences = answers.agg(F.coalesce(F.sum("types"), F.lit(0)), F.coalesce(F.sum("occurrences"), F.lit(0))).first()
    # All that a block needs, its texts and its answers, is bounded by the block.
    ordered = answers.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("size", "bucket", "totals"))).alias("answers"))
    ready = written(blocks.select("block", "payload").join(ordered, "block").select("payload", "answers"), "ready")
    fitted = [] if shares is None else list(shares)
    while len(fitted) < order - 1:
        fitted.append(fit_shares(_table(ready, order, fitted, types, occurrences)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield _scored(_texts(batch.column(0)[i].as_py()), batch.column(1)[i].as_py(), order, fitted, types, occurrences)

    out = ready.mapInArrow(run, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)


def _scored(texts: pa.RecordBatch, answers: list[dict], order: int, shares: list[np.ndarray], types: int, occurrences: int) -> pa.RecordBatch:
    """The scores of the texts of one block."""
    tokens, learned, totals = _block_of(texts, answers, order)
    grams = grams_of(tokens, totals, shares, types, occurrences)
    counts, base = totals[0][grams.index[0]], np.log10(grams.p[0])[grams.index[0]]
    begin = tokens.begin[:-1]
    counts[begin], base[begin] = 0, 0.0
    score = traverse(build(grams, shares), tokens, grams.index[0], order)
    known = np.add.reduceat((counts > 0).astype(np.int64), begin)
    return pa.RecordBatch.from_arrays(
        [texts.column(0), pa.array(~learned), pa.array(np.diff(tokens.begin) - 1), pa.array(known), pa.array(np.full(len(learned), occurrences, dtype=np.int64)), pa.array(np.add.reduceat(base, begin)), pa.array(score)],
        ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    )
