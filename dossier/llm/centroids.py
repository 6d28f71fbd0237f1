"""Centroid clustering in exact whole numbers, searched coarse to fine in Walsh-Hadamard space.

Vectors and centroids are taken through the Walsh-Hadamard transform of length 64, whose
rows are ordered by their number of sign changes. It multiplies every squared distance by
64 and gathers what smooth vectors differ in at the front, so partial sums of squared
coefficient differences are lower bounds that grow quickly. All centroids begin with the
coarse coefficients; the nearest so far is finished first, and its distance rules out every
centroid whose partial sum is larger (strictly, so ties stay). What is left is finished
over all 64 coefficients, hence exact.

The transform is linear, so the rounds add up coefficients and turn the few sums back. A
round leaves 64 sums and a count for each centroid and task; the driver sees one such row
per centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.session import cut, find_package

DIM, CENTROIDS, ROUNDS, SCALE = 64, 8, 10, 1024
#: Ends of the groups of coefficients, coarse to fine.
LEVELS = (4, 12, 28, 64)
#: Largest component: the sum of 64 squared coefficient differences then stays below 2^63.
LARGEST = 1 << 24


def walsh(dim: int = DIM) -> np.ndarray:
    """The Hadamard matrix of a power of two, its rows ordered by their sign changes."""
    h = np.ones((1, 1), dtype=np.int64)
    while len(h) < dim:
        h = np.block([[h, h], [h, -h]])
    return h[np.argsort((np.diff(h, axis=1) != 0).sum(axis=1), kind="stable")]


def transform(x: np.ndarray) -> np.ndarray:
    """Coefficients of rows of whole numbers, exact: through floating point while all sums fit it."""
    return (x.astype(np.float64) @ walsh(x.shape[1]).T.astype(np.float64)).astype(np.int64)


def untransform(sums: list[list[int]]) -> list[list[int]]:
    """Component sums from coefficient sums, in Python's unbounded whole numbers."""
    h = [[int(v) for v in row] for row in walsh(len(sums[0]))]
    return [[sum(c * row[i] for c, row in zip(of, h)) // len(h) for i in range(len(h))] for of in sums]


def nearest(x: np.ndarray, c: np.ndarray, levels: tuple[int, ...] = LEVELS) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, squared distance, coefficient differences taken) for rows of coefficients.

    Ties go to the smaller number.
    """
    n, k = len(x), len(c)
    row, of = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
    total = ((x[:, None, : levels[0]] - c[None, :, : levels[0]]) ** 2).sum(axis=2).ravel()
    taken = n * k * levels[0]
    # The nearest by the coarse coefficients is finished at once; its distance is the mark to beat.
    first = total.reshape(n, k).argmin(axis=1)
    mark = ((x - c[first]) ** 2).sum(axis=1)
    taken += n * (x.shape[1] - levels[0])
    rest = (of != first[row]) & (total <= mark[row])
    row, of, total = row[rest], of[rest], total[rest]
    for begin, end in zip(levels, levels[1:]):
        total = total + ((x[row, begin:end] - c[of, begin:end]) ** 2).sum(axis=1)
        taken += len(row) * (end - begin)
        keep = total <= mark[row]
        row, of, total = row[keep], of[keep], total[keep]
    best, which = mark.copy(), first.copy()
    # Whole distances now: later rows overwrite earlier ones, so the order ends with the best of each vector.
    order = np.lexsort((of, total, row))[::-1]
    row, of, total = row[order], of[order], total[order]
    better = (total < best[row]) | ((total == best[row]) & (of < which[row]))
    best[row[better]], which[row[better]] = total[better], of[better]
    return which.astype(np.int32), best // x.shape[1], taken


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, numbers): floor(SCALE * x) of the vectors that have DIM components, none null or non-finite."""
    v = F.col("vector")
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    fine = v.isNotNull() & (F.size(v) == DIM) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    number = lambda x: F.floor(x * SCALE).cast("long")
    small = F.forall(v, lambda x: F.abs(F.floor(x * SCALE)) <= LARGEST)
    numbers = F.when(small, F.transform(v, number)).otherwise(F.raise_error(F.lit(f"a component beyond {LARGEST // SCALE}: its squared distances are not certain to fit 64 bits")))
    return rows.filter(fine).select("id", numbers.alias("numbers"))


def _coefficients(rows: DataFrame) -> DataFrame:
    """(id, coefficients) with the coefficients as bytes of 32-bit numbers, which all fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = transform(batch.column(1).flatten().to_numpy().reshape(-1, DIM)).astype("<i4")
                yield pa.RecordBatch.from_arrays([batch.column(0), _bytes(x)], ["id", "coefficients"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, coefficients binary")


def _bytes(x: np.ndarray) -> pa.Array:
    size = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * size).astype(np.int32)), pa.py_buffer(x.tobytes())])


def _numbers(column: pa.Array) -> np.ndarray:
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, dtype="<i4").reshape(-1, DIM).astype(np.int64)


def _first(rows: DataFrame, centroids: int) -> list[list[int]]:
    """The vectors whose ids have the smallest hashes; equal ids go by their components. A null id is never one."""
    mark = F.sha2(F.concat(F.lit("3:"), F.col("id").cast("string")), 256)
    picked = rows.filter(F.col("id").isNotNull()).select(mark.alias("mark"), "numbers").orderBy("mark", "numbers").limit(centroids)
    return [list(r["numbers"]) for r in picked.collect()]


def _sums(kept: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """{centroid: (vectors, sums of their coefficients)}; each task sends one row per centroid and coefficient."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centroids), DIM + 1), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _numbers(batch.column(0))
                which, _, _ = nearest(x, centroids)
                order = np.argsort(which, kind="stable")
                at, count = np.unique(which[order], return_counts=True)
                total[at, 0] += count
                total[at, 1:] += np.add.reduceat(x[order], np.cumsum(count) - count, axis=0)
        some = np.flatnonzero(total[:, 0])
        cluster, place = np.repeat(some, DIM + 1), np.tile(np.arange(DIM + 1), len(some))
        yield pa.RecordBatch.from_arrays([pa.array(cluster.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(total[some].ravel())], ["cluster", "place", "total"])

    parts = kept.select("coefficients").mapInArrow(run, "cluster int, place int, total long")
    rows = parts.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total")).collect()
    out: dict[int, tuple[int, list[int]]] = {}
    for cluster in {r["cluster"] for r in rows}:
        values = {r["place"]: int(r["total"]) for r in rows if r["cluster"] == cluster}
        out[cluster] = values[0], [values[i + 1] for i in range(DIM)]
    return out


def cluster_vectors(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256): one row per vector that takes part.

    Vectors that are null, of another length than 64, or with a null or non-finite component
    take no part. Every row stands for itself, also where ids or vectors repeat; a row with a
    null id is clustered but is no first centroid. With fewer rows than centroids there are
    fewer centroids; without any row that has an id there are none, and no result. Ties go to the smaller centroid.
    A component beyond 16,384 in size is an error: distances might not fit 64 bits.
    """
    find_package(vectors.sparkSession)
    rows = whole_vectors(vectors, id_col, vector_col)
    kept = cut(_coefficients(rows))  # 256 bytes a vector, read by every round
    center = _first(rows, centroids)
    schema = f"id {rows.schema['id'].dataType.simpleString()}, cluster int, distance long"
    if not center:
        none = [F.lit(0).cast("int").alias("cluster"), *(F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256")]
        return kept.filter(F.lit(False)).select(F.col("id").alias(id_col), *none)
    for _ in range(rounds):
        for number, (count, sums) in _sums(kept, transform(np.array(center))).items():
            center[number] = [total // count for total in untransform([sums])[0]]
    final = transform(np.array(center))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                which, distance, _ = nearest(_numbers(batch.column(1)), final)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(which), pa.array(distance)], ["id", "cluster", "distance"])

    assigned = cut(kept.mapInArrow(assign, schema))  # 20 bytes a vector; the sums and the result read it
    inertia = {r["cluster"]: r["inertia"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    sums = F.create_map(*[F.lit(x).cast(kind) for pair in inertia.items() for x, kind in zip(pair, ("int", "long"))])
    names = F.array(*[F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in center])
    return assigned.select(
        F.col("id").alias(id_col), "cluster", "distance", sums[F.col("cluster")].alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"), names[F.col("cluster")].alias("centroid_sha256"),
    )
