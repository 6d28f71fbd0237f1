"""Large files whose records do not end at every line, read by many tasks.

Spark's text source cuts a file into blocks and a block into fragments, at line ends (CSV) or
closing braces (JSON lists). Whether a fragment ends a record depends on all that stands
before it: on the quotes, and for JSON on the depth. So the files are read twice:

1. every block says how it changes that state, for either state that it may begin in, and
   running sums over a file's blocks (a few numbers each) give the state they do begin in;
2. every block gives the records that lie in it, and its two ends; the ends of neighbouring
   blocks are put together.

No task holds more than a block or a record, and records keep the order of their file.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dossier.operators.tries import byte_buffer
from dossier.session import find_package

HEAD, WHOLE, TAIL = 0, 1, 2


@dataclass(frozen=True)
class Form:
    """How a kind of file is cut: what ends a fragment, whether it belongs to the record, and whether braces count."""

    separator: str
    keeps: bool
    nested: bool


CSV, JSON_LIST = Form("\n", False, False), Form("}", True, True)


def _changes(form: Form, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per fragment: quotes (0 or 1, odd or even), and the change of depth if it begins outside, or inside, of quotes."""
    quote = data == 34
    if form.nested:
        back = data == 92
        place = np.arange(len(data))
        solid = np.maximum.accumulate(np.where(back, -1, place)) if len(data) else place
        before = np.append(-1, solid[:-1])[: len(data)]
        begin = np.repeat(offsets[:-1], np.diff(offsets))
        run = place - 1 - np.maximum(before, begin - 1)  # backslashes right before, in this fragment
        quote &= run % 2 == 0
    total = np.append(0, np.cumsum(quote))
    odd = (total[offsets[1:]] - total[offsets[:-1]]) % 2
    if not form.nested:
        return odd, np.zeros((len(odd), 2), dtype=np.int64)
    inside = (total[:-1] - np.repeat(total[offsets[:-1]], np.diff(offsets))) % 2
    step = np.isin(data, (91, 123)).astype(np.int64) - np.isin(data, (93, 125))
    depth = np.stack([np.diff(np.append(0, np.cumsum(np.where(inside == k, step, 0)))[offsets]) for k in (0, 1)], axis=1)
    depth[:, 0] -= odd == 0  # the brace that ended the fragment, unless it stands in quotes
    depth[:, 1] -= odd == 1
    return odd, depth


def _running(form: Form, data: np.ndarray, offsets: np.ndarray, quoted: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The state after each fragment of a run that begins in a known one."""
    odd, change = _changes(form, data, offsets)
    after = (quoted + np.cumsum(odd)) % 2
    start = np.append(quoted, after[:-1])[: len(odd)]
    return after, depth + np.cumsum(change[np.arange(len(odd)), start])


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """The parts of a batch that come from one block each, in order."""
    files, blocks = batch.column(0), batch.column(1).to_numpy()
    codes = files.dictionary_encode().indices.to_numpy()
    edges = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(codes) != 0)) + 1
    for a, z in zip([0, *edges.tolist()], [*edges.tolist(), len(blocks)]):
        if z > a:
            yield (files[a].as_py(), int(blocks[a])), batch.slice(a, z - a)


def fragments(spark: SparkSession, path: str, form: Form, glob: str | None = None) -> DataFrame:
    """(file, block, slot, value) of all files, in order inside a block."""
    find_package(spark)
    reader = spark.read.option("lineSep", form.separator)
    lines = (reader.option("pathGlobFilter", glob) if glob else reader).text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("slot"), "value"
    )


def block_states(pieces: DataFrame, form: Form) -> DataFrame:
    """(file, block, quoted, depth): the state in which each block begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, odd, depth = None, 0, [0, 0]

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"file": held[0], "block": held[1], "odd": odd, "outside": depth[0], "inside": depth[1]}], schema=SUMMARY)

        for batch in batches:
            for key, part in _runs(batch):
                if key != held:
                    if held is not None:
                        yield row()
                    held, odd, depth = key, 0, [0, 0]
                change = _changes(form, *byte_buffer(part.column(3)))
                before = np.append(0, np.cumsum(change[0])[:-1]) % 2
                at = np.arange(len(before))
                # A block that has begun inside of quotes is always in the other state than one that began outside.
                depth = [d + int(change[1][at, (before + odd + k) % 2].sum()) for k, d in enumerate(depth)]
                odd = (odd + int(change[0].sum())) % 2
        if held is not None:
            yield row()

    sums = pieces.mapInArrow(run, "file string, block long, odd int, outside long, inside long")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    quoted = sums.withColumn("quoted", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    change = F.when(F.col("quoted") == 0, F.col("outside")).otherwise(F.col("inside"))
    depth = quoted.withColumn("change", change).withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0)))
    return depth.select("file", "block", F.col("quoted").cast("int").alias("quoted"), "depth")


SUMMARY = pa.schema([("file", pa.string()), ("block", pa.int64()), ("odd", pa.int32()), ("outside", pa.int64()), ("inside", pa.int64())])
PARTS = "file string, block long, slot long, kind int, text string"


def records(spark: SparkSession, path: str, form: Form, glob: str | None = None) -> DataFrame:
    """(file, block, slot, text, rest): the records of all files; block and slot give their order in the file.

    The first record of a file has the block -1. What is left of a file after its last record
    comes as a row too, marked as `rest` and with a separator after it; a reader judges it.
    """
    pieces = fragments(spark, path, form, glob)
    known = pieces.join(block_states(pieces, form), ["file", "block"]).select("file", "block", "slot", "value", "quoted", "depth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, quoted, depth, rest, seen = None, 0, 0, [], False
        glue = form.separator

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [[]] * 5
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["file", "block", "slot", "kind", "text"])

        def flush() -> list[tuple]:
            # The fragments after the block's last record; without one, all of them are the block's head.
            return [(*held, -1, TAIL if seen else HEAD, glue.join([*rest, ""]))]

        for batch in batches:
            for key, part in _runs(batch):
                rows: list[tuple] = []
                if key != held:
                    if held is not None:
                        rows += flush()
                    held, rest, seen = key, [], False
                    quoted, depth = part.column(4)[0].as_py(), part.column(5)[0].as_py()
                after, level = _running(form, *byte_buffer(part.column(3)), quoted, depth)
                quoted, depth = int(after[-1]), int(level[-1])
                values, slots = part.column(3).to_pylist(), part.column(2).to_numpy()
                begin = 0
                for end in np.flatnonzero((after == 0) & (level == (1 if form.nested else 0))).tolist():
                    text = glue.join([*rest, *values[begin : end + 1]]) + (glue if form.keeps else "")
                    rows.append((*held, int(slots[end]), WHOLE if seen else HEAD, text))
                    rest, begin, seen = [], end + 1, True
                rest += values[begin:]
                yield out(rows)
        if held is not None:
            yield out(flush())

    parts = known.sortWithinPartitions("file", "block", "slot").mapInArrow(run, PARTS)
    whole = parts.filter(F.col("kind") == WHOLE).select("file", "block", "slot", "text", F.lit(False).alias("rest"))
    ends = parts.filter(F.col("kind") != WHOLE)
    # A head belongs to the last tail before it, whatever blocks lie between.
    before = Window.partitionBy("file").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.coalesce(F.last(F.when(F.col("kind") == TAIL, F.col("block")), ignorenulls=True).over(before), F.lit(-1))
    joined = ends.withColumn("start", start).groupBy("file", "start").agg(F.array_sort(F.collect_list(F.struct("block", "kind", "slot", "text"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda x: x["text"]), "")
    rest = ~F.exists("parts", lambda x: x["slot"] >= 0)  # none of its parts ends a record
    return whole.unionByName(joined.select("file", F.col("start").alias("block"), F.lit(1 << 62).alias("slot"), text.alias("text"), rest.alias("rest")))
