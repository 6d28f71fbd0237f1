"""Near-duplicates: MinHash bands, sequential Bayesian verification, and an exact check.

A text's set is that of its distinct shingles (runs of words). Texts with equal sets form a
class that is worked on once. Bands of the MinHash signature bring candidates together.
Candidates of a bucket are compared by batches of signature places; after each batch a pair
is dropped if the posterior probability (uniform prior) that its similarity reaches the
threshold is below `MISS`. Survivors are verified on their full sets.

A bucket may hold a large group of near copies, and its pairs are never all emitted. First
each member of a bucket sends its link to the most similar member before it; verified links
give components. Then only survivors between different components could still join them:
the members that have such pairs return to their bucket with their texts, and there the
pairs are verified in place, each in the first band that it shares, so that only links come
out and none that matters for a component is lost. A large bucket is dealt into blocks, and
pairs of blocks are compared in separate tasks.

The chance to lose a pair at the threshold t is (1 - t^r)^b from b bands of r places, some
4e-7 at 0.85 (25 bands of 5) and 8e-8 at 0.8 (31 bands of 4), and less than MISS per batch
from the pruning.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.arrow_text import DENSE, mix, numbered, pieces, runs_hash, text_buffer, words_of
from dossier.llm.components import components
from dossier.session import cut

PLACES = 125
BATCH = 25
MISS = 1e-6
#: Members and shingles of a block of a bucket, about.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20


def rows_per_band(threshold: float) -> int:
    return 5 if threshold >= 0.85 else 4 if threshold >= 0.75 else 3


def multipliers(n: int = PLACES) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_24)
    return rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Per text, the sorted distinct hashes of its shingles; a text of fewer words is one shingle, one without words has none."""
    words = words_of(data, offsets, DENSE)
    shingles = runs_hash(words.hash, size)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(shingles[a : b - size + 1]))
        elif b > a:
            out.append(runs_hash(words.hash[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest value of each of PLACES hash functions; made in stretches of shingles."""
    low = np.full(len(a), 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(shingles), 2048):
        h = (shingles[i : i + 2048] >> np.uint64(32)).astype(np.uint32)
        h = h[None, :] * a[:, None]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= b[:, None]
        low = np.minimum(low, h.min(axis=1))
    return low


def band_keys(low: np.ndarray, band_rows: int) -> np.ndarray:
    """One key for each band of a signature."""
    rows = low[: len(low) // band_rows * band_rows].reshape(-1, band_rows).astype(np.uint64)
    keys = np.arange(len(rows), dtype=np.uint64)
    for r in range(band_rows):
        keys = mix(keys ^ rows[:, r])
    return keys.view(np.int64)


def least_matches(threshold: float, miss: float = MISS, places: int = PLACES, batch: int = BATCH) -> list[int]:
    """For each number of compared places, the fewest matches whose posterior of reaching the threshold is at least `miss`."""

    def tail(matches: int, n: int) -> float:  # P(similarity >= threshold | matches of n), uniform prior: a sum of binomial terms
        log = lambda j: lgamma(n + 2) - lgamma(j + 1) - lgamma(n + 2 - j) + j * np.log(threshold) + (n + 1 - j) * np.log1p(-threshold)
        return float(sum(np.exp(log(j)) for j in range(matches + 1)))

    return [next(m for m in range(n + 1) if tail(m, n) >= miss) for n in range(batch, places + 1, batch)]


def survivors(left: np.ndarray, right: np.ndarray, least: list[int], allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j, matches) that no batch of places drops; `allowed` marks the pairs to look at."""
    i, j = np.nonzero(allowed)
    matches = np.zeros(len(i), dtype=np.int32)
    for k, needed in enumerate(least):
        span = slice(k * BATCH, (k + 1) * BATCH)
        for s in range(0, len(i), 1 << 16):
            e = s + (1 << 16)
            matches[s:e] += (left[i[s:e], span] == right[j[s:e], span]).sum(axis=1, dtype=np.int32)
        keep = matches >= needed
        i, j, matches = i[keep], j[keep], matches[keep]
    return i, j, matches


# --- Spark ----------------------------------------------------------------------


def _signed(source: DataFrame, size: int, band_rows: int) -> DataFrame:
    """(id, n, set_hash, bands, places): the size of each set, a 128-bit name for it, its band keys, and one byte per place followed by four per band key; and what `source` has besides (id, text)."""
    more = source.schema[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = multipliers()
        for batch in pieces(batches):
            n, names, bands, places = [], [], [], []
            for shingles in shingle_sets(*text_buffer(batch.column(1)), size):
                n.append(len(shingles))
                if not len(shingles):
                    names.append(None), bands.append(None), places.append(None)
                    continue
                names.append(set_name(shingles))
                low = signature(shingles, a, b)
                bands.append(band_keys(low, band_rows).tolist())
                places.append(low.astype(np.uint8).tobytes() + band_keys(low, band_rows).astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(names, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(places, pa.binary()), *batch.columns[2:]],
                ["id", "n", "set_hash", "bands", "places", *more.names],
            )

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, ", ".join([f"id {kind}, n long, set_hash binary, bands array<long>, places binary", *(f"{f.name} {f.dataType.simpleString()}" for f in more)]))


UNIT = ("bucket", "i", "j")


def _units(buckets: DataFrame) -> DataFrame:
    """Buckets as units of work: a member of block i meets every block j, so each pair of blocks is one unit."""
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other")
    each = buckets.select("*", other)
    return each.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "root", "id", "n", "places")


def _by_unit(rows: DataFrame, work: Callable[[dict[str, np.ndarray]], tuple[np.ndarray, ...] | None], binary: Callable, schema: str) -> DataFrame:
    """Run `work` on the rows of each unit; a unit's rows stand together, in one or more batches. `binary` turns the last column into an array."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        key = None
        out: list[tuple[np.ndarray, ...]] = []
        size = 0

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in out])) for k in range(len(names))], names)

        def close() -> None:
            nonlocal size
            if held and sum(map(len, held["id"])) > 1:
                found = work({c: np.concatenate(v) for c, v in held.items()})
                if found is not None and len(found[0]):
                    out.append(found)
                    size += len(found[0])

        for batch in batches:
            columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in (*UNIT, "block", "root", "id", "n")}
            columns["last"] = binary(batch.column(batch.num_columns - 1))
            new = np.ones(batch.num_rows, dtype=bool)
            new[1:] = np.any([columns[c][1:] != columns[c][:-1] for c in UNIT], axis=0)
            cuts = [*np.flatnonzero(new).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                this = tuple(columns[c][a] for c in UNIT)
                if this != key:
                    close()
                    held, key = {c: [] for c in columns}, this
                for c, v in columns.items():
                    held[c].append(v[a:b])
            if size > 50_000:
                yield sent()
                out, size = [], 0
        close()
        if out:
            yield sent()

    return rows.repartition(*UNIT).sortWithinPartitions(*UNIT, "id").mapInArrow(run, schema)


def _allowed(rows: dict[str, np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left rows, right rows, pairs to look at): sizes that permit the threshold, and different roots."""
    block, n, root = rows["block"], rows["n"], rows["root"]
    same = rows["i"][0] == rows["j"][0]
    left = np.arange(len(n)) if same else np.flatnonzero(block == rows["i"][0])
    right = left if same else np.flatnonzero(block != rows["i"][0])
    low, high = np.minimum(n[left][:, None], n[right][None]), np.maximum(n[left][:, None], n[right][None])
    allowed = (low >= threshold * high - 1e-9) & (root[left][:, None] != root[right][None])
    if same:
        allowed &= left[:, None] < right[None]
    return left, right, allowed


def _places(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)


def _first_met(x: np.ndarray, y: np.ndarray, bucket: int) -> np.ndarray:
    """Which pairs share no earlier band than this bucket's, so that a pair is worked on once.

    Band keys are compared by 32 bits; that two of them agree by chance is far less likely than MISS.
    """
    first = (x == y).argmax(axis=1)
    return x[np.arange(len(x)), first] == np.uint32(bucket & 0xFFFFFFFF)


def _nearest(buckets: DataFrame, threshold: float) -> DataFrame:
    """(a, b): each member of a unit with its most similar partner before it, if a pair of them survives."""
    least = least_matches(threshold)

    def work(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
        left, right, allowed = _allowed(rows, threshold)
        i, j, matches = survivors(rows["last"][left], rows["last"][right], least, allowed)
        a, b = rows["id"][left[i]], rows["id"][right[j]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((low, -matches, high))
        first = order[np.append(True, high[order][1:] != high[order][:-1])] if len(order) else order
        return low[first], high[first]

    return _by_unit(_units(buckets), work, _places, "a long, b long").distinct()


def _unsettled(buckets: DataFrame, threshold: float) -> DataFrame:
    """(bucket, i, j, id): the members of units with a surviving pair between different roots; no pair is sent."""
    least = least_matches(threshold)

    def work(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
        left, right, allowed = _allowed(rows, threshold)
        i, j, _ = survivors(rows["last"][left], rows["last"][right], least, allowed)
        i, j = left[i], right[j]
        bands = np.ascontiguousarray(rows["last"][:, PLACES:]).view(np.uint32)
        mine = _first_met(bands[i], bands[j], int(rows["bucket"][0]))
        at = np.union1d(i[mine], j[mine])
        return tuple(rows[c][at] for c in (*UNIT, "id"))

    return _by_unit(_units(buckets), work, _places, "bucket long, i int, j int, id long")


def _settled(members: DataFrame, size: int, percent: int, band_rows: int) -> DataFrame:
    """(a, b): links between different roots, found on full sets; in a unit at most one fewer than members. `members`: unit, block, root, id, n, text."""
    threshold = percent / 100
    least = least_matches(threshold)

    def sets(column: pa.Array) -> np.ndarray:
        out = np.empty(len(column), dtype=object)
        k = 0
        for piece in pieces(iter([pa.RecordBatch.from_arrays([column], ["text"])]), 0):
            for s in shingle_sets(*text_buffer(piece.column(0)), size):
                out[k] = s
                k += 1
        return out

    def work(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, ...] | None:
        a, b = multipliers()
        low = np.stack([signature(s, a, b) for s in rows["last"]])
        bands = np.stack([band_keys(x, band_rows).astype(np.uint32) for x in low])
        places = low.astype(np.uint8)
        left, right, allowed = _allowed(rows, threshold)
        i, j, matches = survivors(places[left], places[right], least, allowed)
        order = np.argsort(-matches, kind="stable")
        i, j = left[i[order]], right[j[order]]
        mine = _first_met(bands[i], bands[j], int(rows["bucket"][0]))
        i, j = i[mine], j[mine]
        top = {r: r for r in rows["root"].tolist()}

        def find(r: int) -> int:
            while top[r] != r:
                top[r] = top[top[r]]
                r = top[r]
            return r

        out = []
        for x, y in zip(i.tolist(), j.tolist()):
            p, q = find(int(rows["root"][x])), find(int(rows["root"][y]))
            if p != q and similar(rows["last"][x], rows["last"][y], percent):
                top[max(p, q)] = min(p, q)
                out.append((rows["id"][x], rows["id"][y]))
        return tuple(np.array(out, dtype=np.int64).T) if out else None

    return _by_unit(members, work, sets, "a long, b long")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity, exactly."""
    both = np.concatenate([x, y])
    both.sort()
    n = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * n >= percent * (len(x) + len(y) - n)


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose full sets reach the threshold. `texts`: (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(pieces(batches, 2), 3):
            left, right = (shingle_sets(*text_buffer(batch.column(k)), size) for k in (2, 3))
            keep = []
            for x, y in zip(left, right):
                keep.append(similar(x, y, percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a")
    two = one.join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
    return two.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, percent: int = 85, text_hash: bool = False) -> DataFrame:
    """One row per document row: id, n_shingles, component_id (smallest id reached over links), kept; with `text_hash` also the text's xxhash64.

    Documents are linked when 100 * intersection >= percent * union of their shingle sets.
    Null and empty texts have no shingles and no links; a null id is linked with nothing and
    is its own component, null. Rows that repeat an id are one document if their sets are
    linked, and the first counts as kept for each of them. Ties go to the smallest id.
    """
    threshold = percent / 100
    source = numbered(docs, id_col, text_col)
    source = source.withColumn("id", F.col("id").cast("long"))
    if text_hash:
        source = source.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    signed = cut(_signed(source, size, rows_per_band(threshold)))
    named = signed.filter("set_hash IS NOT NULL AND id IS NOT NULL")
    # One representative per set: its smallest id.
    sets = named.groupBy("set_hash").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("places").alias("places"))
    sets = cut(sets)
    # A row that repeats an id with another set would make the id stand for two sets: sets are numbered by their own key.
    keyed = sets.select(F.xxhash64("set_hash").alias("key"), "rep", "n", "bands", "places")
    banded = keyed.select(F.explode("bands").alias("bucket"), "key", "n")
    counted = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles")).filter("members > 1")
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    shared = cut(banded.join(counted.select("bucket", blocks.alias("n_blocks")), "bucket").select("bucket", "key", "n_blocks"))
    placed = keyed.select("key", "n", "places")
    buckets = shared.join(placed, "key").select("bucket", F.pmod(F.xxhash64("key", F.lit(7)), F.col("n_blocks")).cast("int").alias("block"), "n_blocks", F.col("key").alias("root"), F.col("key").alias("id"), "n", "places")
    chosen = sets.select(F.xxhash64("set_hash").alias("key"), F.col("rep").alias("id"))
    candidates = _nearest(buckets, threshold)
    involved = shared.select("key").distinct().join(chosen, "key")
    # The text of a set is that of its representative's row with that set.
    texts = source.filter("id IS NOT NULL").join(involved, "id")
    keyed_texts = cut(_keyed(texts, size).join(involved.select("key"), "key", "left_semi").dropDuplicates(["key"]).select(F.col("key").alias("id"), "text"))
    links = cut(_verified(candidates, keyed_texts, size, percent))
    roots = components(links)
    rooted = buckets.drop("root").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    mixed = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("bucket")
    rooted = cut(rooted.join(mixed, "bucket"))
    members = _unsettled(rooted, threshold).join(rooted.select("bucket", "id", "block", "root", "n"), ["bucket", "id"]).join(keyed_texts, "id")
    further = _settled(members.select(*UNIT, "block", "root", "id", "n", "text"), size, percent, rows_per_band(threshold))
    links = cut(links.union(further))
    return _labelled(signed, sets, components(links), id_col)


def _keyed(texts: DataFrame, size: int) -> DataFrame:
    """(key, text) of each row by its own set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            names = [set_name(s) for s in shingle_sets(*text_buffer(batch.column(1)), size)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), batch.column(1)], ["set_hash", "text"])

    return texts.select("id", "text").mapInArrow(run, "set_hash binary, text string").select(F.xxhash64("set_hash").alias("key"), "text")


def set_name(shingles: np.ndarray) -> bytes | None:
    """Equal sets have equal names: 128 bits of sums over the mixed members, and the size."""
    if not len(shingles):
        return None
    sums = [mix(shingles).sum(dtype=np.uint64), mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)]
    return np.array(sums).tobytes() + len(shingles).to_bytes(8, "little")


def _labelled(signed: DataFrame, sets: DataFrame, roots: DataFrame, id_col: str) -> DataFrame:
    """Give every row the smallest id of its component."""
    keyed = sets.select("set_hash", F.xxhash64("set_hash").alias("node"), "rep").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = keyed.groupBy("root").agg(F.min("rep").alias("component"))
    named = keyed.join(lowest, "root").select("set_hash", "component")
    out = signed.drop("bands", "places").join(named, "set_hash", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"), *[c for c in signed.columns if c == "text_hash"])
