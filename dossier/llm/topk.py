"""Exact top-k inner products by three phases with a uniform threshold.

Vectors become whole numbers. Equal vectors form one class that keeps its k + 1 smallest
ids, which is all that a query can need, since ties go to smaller ids; so a vector that
is very common is searched once. Classes are packed into blocks of bounded size, which are
stored once; a node is one of them. The queries are a stated set: they go to all nodes a
bounded block at a time, and each block makes two passes over the stored rows. The
dimensions are cut into lists, short ones first.

1. Each node ranks its rows for each query by the first list alone and sends the whole
   scores of the best. The k-th best of all nodes is the query's cutoff: no lower score can
   count.
2. The cutoffs go to the nodes. They add up list after list; what is left of a score is at
   most the product of the lengths of the vectors' rests, so pairs that cannot reach the
   cutoff any more are dropped after each list.
3. The pairs that are left after the last list are resolved: their sums are whole scores,
   exact, and the best are ranked, ties by id.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier.session import cut, find_package, shared_dir

#: Queries and rows that meet at a time; the parts of the dimensions at which lists end.
QUERY_BLOCK, ROW_BLOCK, LISTS = 1024, 4096, (1 / 8, 1 / 4, 1 / 2, 1)
#: Rows per query whose whole scores a node takes for the cutoff; the share of pairs below which single ones are scored.
TRIED, FEW = 64, 0.1


def whole_numbers(vector: str, scale: int = 256) -> Column:
    """floor(scale * x) of each component, or null if the vector or a component is null or not finite."""
    v = F.col(vector)
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when(fine, F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _packed(rows: DataFrame, block: str, size: int) -> DataFrame:
    """(block, dim, keys, numbers): the vectors of a block as two byte strings. Every task packs what it reads of a block; blocks are cut to `size`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict[tuple[int, int], list[int]] = {}
            dims = batch.column(2).to_pylist()
            for k, key in enumerate(zip(batch.column(0).to_pylist(), dims)):
                groups.setdefault(key, []).append(k)
            keys = batch.column(1).to_numpy()
            flat, ends = batch.column(3).flatten().to_numpy(), np.cumsum([0, *dims])
            out: list[list] = [[], [], [], []]
            for (b, dim), at in groups.items():
                for i in range(0, len(at), size):
                    some = at[i : i + size]
                    for kept, value in zip(out, (b, dim, keys[some].tobytes(), np.concatenate([flat[ends[k] : ends[k + 1]] for k in some]).tobytes() if dim else b"")):
                        kept.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())], ["block", "dim", "keys", "numbers"])

    return rows.select(F.col(block).alias("block"), "key", F.size("numbers").alias("dim"), "numbers").mapInArrow(run, "block long, dim int, keys binary, numbers binary")


def _matrix(raw: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.int64).reshape(n, dim)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit whole numbers; through floating point where that is exact, as it is far faster."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if largest >= 2.0**63:
        raise OverflowError("components whose inner products may not fit 64 bits")
    if largest >= 2.0**53:
        return a @ b.T
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)


def _rests(x: np.ndarray, edges: list[int]) -> list[np.ndarray]:
    """The length of each vector from each edge on, rounded up."""
    square = x.astype(np.float64) ** 2
    return [np.sqrt(square[:, e:].sum(axis=1)) * (1 + 1e-9) for e in edges]


def _best(scores: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best of each row: by score, then by smaller key (columns stand in the order of keys)."""
    n = scores.shape[1]
    if n <= k:
        return np.tile(np.argsort(keys, kind="stable"), (len(scores), 1))
    floor = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
    out = np.empty((len(scores), k), dtype=np.int64)
    for r in range(len(scores)):
        some = np.flatnonzero(scores[r] >= floor[r])
        out[r] = some[np.lexsort((keys[some], -scores[r, some]))[:k]]
    return out


def list_edges(dim: int) -> list[int]:
    return sorted({max(1, round(dim * part)) for part in LISTS} | {dim}) if dim else [0]


def first_phase(q: np.ndarray, x: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, whole score): of the TRIED rows that are best in the first list, the k best of each query."""
    edge = list_edges(q.shape[1])[0]
    _exact(q[:1], x[:1])  # the check of the numbers' size
    tried = _best(_exact(q[:, :edge], x[:, :edge]), keys, max(k, TRIED))
    scores = np.stack([x[of] @ v for of, v in zip(tried, q)]) if len(q) else np.zeros(tried.shape, dtype=np.int64)
    best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    rows = np.repeat(np.arange(len(q)), best.shape[1])
    return rows, np.take_along_axis(tried, best, axis=1).ravel(), np.take_along_axis(scores, best, axis=1).ravel()


def later_phases(q: np.ndarray, x: np.ndarray, cutoff: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, row, whole score) of all pairs that reach the query's cutoff, and the products taken for them."""
    edges = list_edges(q.shape[1])
    q_rest, x_rest = _rests(q, edges), _rests(x, edges)
    taken, begin = len(q) * len(x) * edges[0], edges[0]
    total = _exact(q[:, :begin], x[:, :begin])
    rows, columns = np.nonzero(total + q_rest[0][:, None] * x_rest[0][None] + 1 >= cutoff[:, None])
    total = total[rows, columns]
    for place, end in enumerate(edges[1:], 1):
        # Queries with many rows left take whole products, all others single pairs.
        broad = np.bincount(rows, minlength=len(q)) > FEW * len(x)
        whole = broad[rows]
        add = np.empty(len(rows), dtype=np.int64)
        add[~whole] = np.einsum("ij,ij->i", q[rows[~whole], begin:end], x[columns[~whole], begin:end])
        part = _exact(q[broad, begin:end], x[:, begin:end])
        add[whole] = part[(np.cumsum(broad) - 1)[rows[whole]], columns[whole]]
        total = total + add
        taken += (part.size + int((~whole).sum())) * (end - begin)
        keep = total + q_rest[place][rows] * x_rest[place][columns] + (end < q.shape[1]) >= cutoff[rows]
        rows, columns, total, begin = rows[keep], columns[keep], total[keep], end
    keep = total >= cutoff[rows]
    return rows[keep], columns[keep], total[keep], taken


def _phase(blocks: DataFrame, asked: dict[int, tuple[np.ndarray, np.ndarray]], k: int, cutoffs: dict[int, int] | None) -> DataFrame:
    """(q, r, score) that the nodes send for a block of queries: {dim: (keys, matrix)}."""
    shared = blocks.sparkSession.sparkContext.broadcast((asked, cutoffs))  # QUERY_BLOCK vectors, about

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, cutoffs = shared.value
        for batch in batches:
            for dim, raw_keys, raw in zip(*(batch.column(c).to_pylist() for c in ("dim", "keys", "numbers"))):
                if dim not in asked:
                    continue
                names, q = asked[dim]
                keys = np.frombuffer(raw_keys, dtype=np.int64)
                x = _matrix(raw, len(keys), dim)
                if cutoffs is None:
                    rows, columns, scores = first_phase(q, x, keys, k)
                else:
                    rows, columns, scores, _ = later_phases(q, x, np.array([cutoffs.get(n, np.iinfo(np.int64).min // 2) for n in names.tolist()]))
                yield pa.RecordBatch.from_arrays([pa.array(names[rows]), pa.array(keys[columns]), pa.array(scores)], ["q", "r", "score"])

    return blocks.mapInArrow(run, "q long, r long, score long")


def _matrices(asked: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """A block of queries by their number of dimensions."""
    table = asked.toArrow()
    keys, lists = table.column("key").to_numpy(), table.column("numbers").combine_chunks()
    dims = lists.value_lengths().to_numpy() if len(lists) else np.zeros(0, dtype=np.int64)
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(np.append(0, dims))
    out = {}
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        out[dim] = keys[at], np.stack([flat[ends[i] : ends[i] + dim] for i in at])
    return out


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("q").orderBy(F.desc("score"), "r")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the largest inner product for each query, itself left out.

    Ties go to the smaller id. Vectors that are null, hold null or a non-finite component,
    or have no id take no part; only vectors of one length are compared. Rows that repeat
    an id and vector count once; of an id with several vectors each row with a queried one
    asks, and no row of that id answers. A query with no candidate has no row. Components
    whose products may not fit 64 bits are an error.
    """
    find_package(vectors.sparkSession)
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("vector"), is_query.alias("asks"))
    rows = cut(rows.select("id", F.coalesce("asks", F.lit(False)).alias("asks"), whole_numbers("vector").alias("numbers")).filter("id IS NOT NULL AND numbers IS NOT NULL").distinct())
    # A class is named by its smallest id. Its first k + 1 ids hold all that a query can need.
    order = W.partitionBy("numbers").orderBy("id")
    firsts = rows.select("id", "numbers").distinct().withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1)
    classes = firsts.groupBy("numbers").agg(F.min("id").alias("key"), F.sort_array(F.collect_list("id")).alias("ids"))
    asking = rows.filter("asks").select("id", "numbers").distinct()
    classes = cut(classes)
    asked = cut(asking.select("numbers").distinct().join(classes, "numbers").select("key", "numbers"))
    q_blocks, r_blocks = max(1, -(-asked.count() // QUERY_BLOCK)), max(1, -(-classes.count() // ROW_BLOCK))
    # Rows are dealt into blocks by a hash; one task packs a block, and a pack never exceeds the block size.
    number = lambda n: F.pmod(F.xxhash64("key"), F.lit(n)).cast("long")
    dealt = classes.select("key", "numbers").withColumn("block", number(r_blocks)).repartition(r_blocks, "block")
    packed = cut(_packed(dealt, "block", ROW_BLOCK))
    folder = f"{shared_dir(vectors.sparkSession)}/topk-{uuid4().hex}"
    for block in range(q_blocks):
        some = _matrices(asked.filter(number(q_blocks) == block))
        # Phase 1: local lists to cutoffs. The query's own class answers for itself, so k + 1 classes count.
        first = _ranked(_phase(packed, some, k + 1, None), k + 1)
        cutoffs = {r["q"]: r["cutoff"] for r in first.groupBy("q").agg(F.min("score").alias("cutoff"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k + 1).collect()}
        # Phases 2 and 3: a block of queries has at most one cutoff each, so what goes back is bounded by the block.
        _ranked(_phase(packed, some, k + 1, cutoffs), k + 1).select("q", "r", "score").write.mode("overwrite").parquet(f"{folder}/block={block}")
    best = vectors.sparkSession.read.schema("q long, r long, score long").parquet(*[f"{folder}/block={block}" for block in range(q_blocks)])
    # Classes to ids: for each query id, the first k ids of its k + 1 best classes, its own id left out.
    named = best.join(classes.select(F.col("key").alias("r"), "ids"), "r").select("q", "score", F.explode("ids").alias("vec_id"))
    near = named.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k + 1)
    lists = near.groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))).alias("list"))
    members = asking.join(classes.select("numbers", F.col("key").alias("q")), "numbers").select(F.col("id").alias("query_id"), "q")
    own = members.join(lists, "q").select("query_id", F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("list"))
    out = own.select("query_id", F.posexplode("list").alias("place", "x"))
    return out.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.minus")).alias("score"))
