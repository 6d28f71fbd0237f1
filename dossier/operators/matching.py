"""Which texts contain which names, without comparing every text with every name.

Names are dealt into byte tries of bounded size, and every task walks its texts through
them, whole Arrow batches at once. What is found comes back as a column beside the text, so
no text or row is shuffled, keys may repeat or be missing, and rows need no number. A list
of names beyond one trie gives several, each with its own pass over the batch. This is
exact for names of any length and number, and no text is shortened.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier import functions as fn
from dossier.operators import tries
from dossier.operators.ranking import first_per
from dossier.session import cut, find_package

#: Bytes of names in one trie: what a task holds of it at a time is some fifteen times that.
SHARD_BYTES = 4 << 20


def found_in(text: Column, names: DataFrame, alone: bool = False) -> Column:
    """The rows of `names` whose `needle` a text contains, as an array in no set order.

    Needles are different and not empty. With `alone`, no letter or digit may touch them.
    The names come to the driver one trie at a time, which SHARD_BYTES bounds.
    """
    spark = names.sparkSession
    find_package(spark)
    names = cut(names)
    size = names.agg(F.sum(F.octet_length("needle"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    dealt = [names] if shards == 1 else [names.filter(F.pmod(F.xxhash64("needle"), F.lit(shards)) == i) for i in range(shards)]
    return F.concat(*[_udf(part, alone)(text) for part in dealt])


def _udf(names: DataFrame, alone: bool):
    table = names.toArrow().combine_chunks()
    rows = pa.StructArray.from_arrays([c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in table.columns], fields=list(table.schema))
    shared = names.sparkSession.sparkContext.broadcast((tries.build(table.column("needle").combine_chunks()), rows))

    @F.arrow_udf(T.ArrayType(names.schema))
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trie, listed = shared.value
        for batch in batches:
            yield tries.named_in(trie, listed, batch, alone)

    return find


def _needles(names: DataFrame, name: str) -> DataFrame:
    return names.withColumn("needle", F.lower(F.col(name))).filter(F.length("needle") > 0)


def contained_names(
    texts: DataFrame,
    keys: Sequence[str],
    text: str,
    names: DataFrame,
    name: str = "name",
    accept: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """Rows (keys, needle) where the lower-cased text contains the lower-cased name.

    Every row of ``texts`` stands for itself, whatever its keys are. ``accept(text,
    needle)`` may narrow the matches.
    """
    needles = _needles(names, name).select("needle").distinct()
    low = F.lower(F.col(text))
    found = found_in(low, needles)
    if accept is not None:
        found = F.filter(found, lambda x: accept(low, x["needle"]))
    return texts.select(*keys, F.explode(found).alias("_found")).select(*keys, "_found.needle")


def longest_name(
    texts: DataFrame,
    text: str,
    names: DataFrame,
    result: str,
    alone: bool = False,
    accept: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """Add the longest accepted name a text contains, NULL without one; equals by name."""
    low = F.lower(fn.text(text))
    found = found_in(low, _needles(names, "name").select("needle").distinct(), alone)
    if accept is not None:
        found = F.filter(found, lambda x: accept(low, x["needle"]))
    best = F.array_min(F.transform(found, lambda x: F.struct((-F.length(x["needle"])).alias("l"), x["needle"].alias("n"))))
    return texts.withColumn(result, best["n"])


def whole_word(text: Column, word: str) -> Column:
    """The word stands alone in the text: no letter or digit touches it."""
    quoted = word.replace("\\E", "\\E\\\\E\\Q")
    return F.rlike(text, F.lit(f"(?<![a-z0-9])\\Q{quoted}\\E(?![a-z0-9])"))


def stands_alone(text: Column, needle: Column) -> Column:
    """As ``whole_word`` for a name in a column: compares the characters beside each place."""
    size = F.length(needle)
    touches = lambda at: F.substring(text, at, F.lit(1)).rlike("[a-z0-9]")
    here = lambda p: (F.substring(text, p, size) == needle) & ((p == 1) | ~touches(p - 1)) & ~touches(p + size)
    return F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - size + 1)), here)


def corroborate(
    posts: DataFrame,
    names: DataFrame,
    title: str = "post_title",
    name: str = "name",
    order: str = "position",
) -> DataFrame:
    """Posts whose title mentions a victim, with the first such victim in list order; equals by name."""
    listed = first_per(_needles(names, name), "needle", order)
    listed = listed.select("needle", F.col(name).alias("_name"), F.col(order).alias("_order"))
    found = found_in(F.lower(F.col(title)), listed)
    first = F.slice(F.array_sort(F.transform(found, lambda x: F.struct(x["_order"].alias("o"), x["_name"].alias("n")))), 1, 1)
    # An explosion, as a filter on what was found would be pushed down and find it twice.
    told = posts.filter(fn.text(title) != "").select("*", F.explode(first).alias("_first"))
    return told.withColumn("matched_victim", F.col("_first.n")).drop("_first")
