"""Line dedup by a tree of log templates of fixed depth.

A line is its white-space separated words, in lower case. Words that hold a digit are
variable fields. The tree has a level for the number of words and one for each of the first
`DEPTH` words; its leaves hold lines that may be instances of one template, or of several.
Within a group of lines, a leaf at first, a word stays part of the template where it is
frequent at its place; every other word there is a variable field too. Lines of which this
makes no template that recurs are grouped anew by the most frequent of their other words,
until no group is left that could recur. Each new group is smaller than `FREQUENT` of its
group, so the rounds grow with the logarithm of the largest leaf. A template needs a share of constant words, and more than the tree's path;
lines that miss this keep their own words, digits included, as their template, so neither
prose that only begins alike nor rows of numbers are ever merged.

A template recurs if at least `least_texts` different texts have it; a longer line says more
by itself and recurs from fewer texts on (`LONGER`). It stays in the text
with the smallest id (the first copy of what many repeat) and its lines are dropped from
all others. Exact copies of a text count as one text and are treated alike: removing them
is the work of another operator.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.arrow_text import _R, _UP, DENSE, Words, _powers, bit_table, combine, mix, numbered, pieces, slots, text_buffer, words_of
from dossier.session import cut

DEPTH = 3
LEAST_WORDS, LEAST_TEXTS = 3, 6
#: (words, texts): lines of so many words recur from so many different texts on. At most three entries.
LONGER = ((20, 3), (50, 2))
FREQUENT, CONSTANT = 0.3, 0.6
LEAF_BITS = 22
_VARIABLE = np.uint64(0x2545F4914F6CDD1D)


def masked_words(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
    """The words, those with a digit as one variable, and the hashes of all words as they stand."""
    words = words_of(data, offsets, DENSE)
    own = words.hash.copy()
    digits = np.zeros(len(data) + 1, dtype=np.int32)
    np.cumsum((data >= 48) & (data <= 57), out=digits[1:])
    words.hash[digits[words.end] > digits[words.start]] = _VARIABLE
    return words, own


def line_table(data: np.ndarray, offsets: np.ndarray, words: Words, own: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, number in the text, first word, words, leaf, template, fit) of every line; empty texts have one empty line.

    A line is fit to be a template if enough of its words are no variables; the template of
    others is made of their own words, if these hold variables. The last two bits of a template tell how many entries of `LONGER` its length reaches.
    """
    breaks = np.flatnonzero(data == 10)
    n = len(offsets) - 1
    starts = np.concatenate([offsets[:-1], breaks + 1])
    owner = np.concatenate([np.arange(n), np.searchsorted(offsets, breaks, side="right") - 1])
    order = np.argsort(owner * (len(data) + 2) + starts, kind="stable")
    starts, owner = starts[order], owner[order]
    number = np.arange(len(starts)) - np.searchsorted(owner, np.arange(n))[owner]
    first = np.searchsorted(words.start, starts)
    # A text's first word may stand at the start of the next text's line only if that text is empty.
    count = np.append(first[1:], len(words.start)) - first
    place = np.arange(len(words.hash)) - np.repeat(first, count)
    powers = _UP if len(place) == 0 or place.max() < len(_UP) else _powers(_R, int(place.max()) + 1)
    plain = np.zeros(len(words.hash) + 1, dtype=np.int64)
    np.cumsum(words.hash != _VARIABLE, out=plain[1:])
    plain = plain[first + count] - plain[first]
    fit = (plain >= CONSTANT * count) & (plain > DEPTH)
    total = np.zeros(len(words.hash) + 1, dtype=np.uint64)
    np.cumsum(np.where(np.repeat(fit, count), words.hash, own) * powers[place], out=total[1:])
    template = mix(mix(total[first + count] - total[first]) ^ count.astype(np.uint64))
    template = template & ~np.uint64(3) | np.searchsorted([n for n, _ in LONGER], count, side="right").astype(np.uint64)
    lead = [count.astype(np.uint64)]
    for k in range(DEPTH):
        at = np.minimum(first + k, max(0, len(words.hash) - 1))
        lead.append(np.where(k < count, words.hash[at] if len(words.hash) else np.uint64(0), np.uint64(1)))
    return owner, number, first, count, combine(lead), template, fit


def _lines(source: DataFrame) -> DataFrame:
    """(id, unit, templates, leaves): one row per text, with an entry per line; short lines have no template, unfit ones no leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            data, offsets = text_buffer(batch.column(1))
            owner, _, _, count, leaf, template, fit = line_table(data, offsets, *masked_words(data, offsets))
            bounds = pa.array(np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32))
            short = count < LEAST_WORDS
            lists = [pa.ListArray.from_arrays(bounds, pa.array(x.view(np.int64), mask=none)) for x, none in ((template, short), (leaf, short | ~fit))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *lists], ["id", "unit", "templates", "leaves"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, unit binary, templates array<long>, leaves array<long>")


def _words_in(source: DataFrame, leaves: np.ndarray) -> DataFrame:
    """(leaf, template, words): the masked words of each different line in the leaves of the bit table."""
    shared = source.sparkSession.sparkContext.broadcast(np.packbits(leaves))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(shared.value).astype(bool)
        for batch in pieces(batches):
            data, offsets = text_buffer(batch.column(1))
            words, own = masked_words(data, offsets)
            _, _, first, count, leaf, template, fit = line_table(data, offsets, words, own)
            at = np.flatnonzero(wanted[slots(leaf, LEAF_BITS)] & (count >= LEAST_WORDS) & fit)
            at = at[np.unique(template[at], return_index=True)[1]]
            ends = np.cumsum([0, *count[at]])
            place = np.repeat(first[at] - ends[:-1], count[at]) + np.arange(ends[-1])
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(words.hash[place].view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(leaf[at].view(np.int64)), pa.array(template[at].view(np.int64)), lists], ["leaf", "template", "words"])

    return source.mapInArrow(run, "leaf long, template long, words array<long>")


def recurring(source: DataFrame, lines: DataFrame, least_texts: int = LEAST_TEXTS) -> DataFrame:
    """(template, owner): the lines' templates that recur, and the text that keeps them. `source`: (id, text, unit)."""
    units = lines.groupBy("unit").agg(F.min("id").alias("id"), F.first("templates").alias("templates"), F.first("leaves").alias("leaves"))
    pairs = F.array_distinct(F.filter(F.arrays_zip("templates", "leaves"), lambda x: x["templates"].isNotNull()))
    each = units.select("id", "unit", F.explode(pairs).alias("x")).select("id", "unit", F.col("x.templates").alias("template"), F.col("x.leaves").alias("leaf"))
    own = cut(each.groupBy("leaf", "template").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "unit")).alias("owner")))
    variable = F.lit(int(_VARIABLE.view(np.int64)))
    # Leaves with several templates: place by place, which words are frequent there.
    groups = own.filter("leaf IS NOT NULL").groupBy("leaf").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")).filter((F.col("total") >= least_texts) & (F.col("kinds") > 1))
    groups = cut(groups.select("leaf", "total"))
    known = own.select("leaf", "template", "n").join(groups, "leaf")
    words = _words_in(source, bit_table(groups, "leaf", LEAF_BITS)).dropDuplicates(["template"])
    placed = words.join(known.drop("leaf"), "template").select(F.col("leaf").alias("group"), "template", "n", "total", F.size("words").alias("words"), F.posexplode("words").alias("place", "word"))
    placed = cut(placed.filter(F.col("word") != int(_VARIABLE.view(np.int64))))
    merged = placed.select("template", F.col("template").alias("general")).limit(0)
    while not placed.isEmpty():
        often = placed.groupBy("group", "place", "word").agg(F.sum("n").alias("m"), F.first("total").alias("total")).filter(F.col("m") >= least_texts)
        often = often.select("group", "place", "word", "m", (F.col("m") >= FREQUENT * F.col("total")).alias("stays"))
        marked = placed.join(often, ["group", "place", "word"])
        lines = marked.groupBy("group", "template", "n", "words").agg(
            F.count(F.when(F.col("stays"), 1)).alias("constant"),
            F.sort_array(F.collect_list(F.when(F.col("stays"), F.struct("place", "word")))).alias("list"),
            F.max(F.when(~F.col("stays"), F.struct("m", -F.col("place"), "word"))).alias("next"),
        )
        fit = (F.col("constant") >= CONSTANT * F.col("words")) & (F.col("constant") > DEPTH)
        lines = cut(lines.select("template", "n", F.when(fit, F.xxhash64("group", "list")).alias("general"), F.when(F.col("next").isNotNull(), F.xxhash64("group", "next")).alias("group")))
        enough = lines.filter("general IS NOT NULL").groupBy("general").agg(F.sum("n").alias("texts")).filter(F.col("texts") >= least_texts).select("general")
        made = cut(lines.select("template", "general").join(enough, "general").select("template", "general"))
        merged = merged.unionByName(made)
        rest = lines.filter("group IS NOT NULL").join(made, "template", "left_anti").select("template", "n", "group")
        groups = rest.groupBy("group").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")).filter((F.col("total") >= least_texts) & (F.col("kinds") > 1))
        rest = rest.join(groups.select("group", "total"), "group").select("template", "group", "total")
        placed = cut(placed.drop("group", "total").join(rest, "template"))
    grouped = own.join(merged, "template", "left").select("template", "n", "owner", F.coalesce("general", "template").alias("general"), F.col("general").isNotNull().alias("merged"))
    totals = grouped.groupBy("general").agg(F.sum("n").alias("texts"), F.min("owner").alias("first"), F.max("merged").alias("merged"))
    longer = F.element_at(F.array(F.lit(least_texts), *[F.lit(min(k, least_texts)) for _, k in LONGER]), F.col("general").bitwiseAND(3).cast("int") + 1)
    # Of merged lines the variable words are known by their counts alone, so they keep the higher number.
    totals = totals.filter(F.col("texts") >= F.when(F.col("merged"), least_texts).otherwise(longer))
    return grouped.join(totals, "general").select("template", F.col("first.unit").alias("owner")).distinct()


def without_lines(joined: DataFrame) -> DataFrame:
    """Rows with `text` and `drops` (line numbers, or null), and `kept`: the text without those lines.

    The numbers that stay are found by a hash set and looked up in the split text, which
    takes time in proportion to the lines.
    """
    split = joined.withColumn("lines", F.when(F.col("drops").isNotNull(), F.split("text", "\n", -1)))
    stays = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drops"))
    kept = F.array_join(F.transform(stays, lambda i: F.get(F.col("lines"), i)), "\n")
    return split.withColumn("kept", F.when(F.col("drops").isNull(), F.col("text")).otherwise(kept))


def free_name(docs: DataFrame, name: str) -> str:
    """The name, with as many underscores after it as it takes to be no column of the table."""
    while name in docs.columns:
        name += "_"
    return name


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_texts: int = LEAST_TEXTS) -> DataFrame:
    """All rows and columns of `docs`, the text without recurring lines, and `n_lines`, `n_dropped`.

    Where `docs` has columns of these two names, they stay and the new ones get an
    underscore (`free_name`). Lines end at a line feed. Null texts stay null and have no
    lines, an empty text has one. Blank lines and lines under `LEAST_WORDS` words are never
    dropped, in however many texts they stand: so short a line says nothing by itself. Equal texts, and so
    repeated rows, are treated alike. A text keeps a template if no text with it has a
    smaller id (null ids come first; ties go to the text with the smaller hash). Very long
    texts are read whole, in time in proportion to their length.
    """
    unit = F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")))
    source = numbered(docs, id_col, text_col).withColumn("unit", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    lines = cut(_lines(source))
    gone = recurring(source, lines, least_texts)
    each = lines.dropDuplicates(["unit"]).select("unit", F.posexplode("templates").alias("line", "template")).filter("template IS NOT NULL")
    # Written first, so that the join below reads both sides from their own shuffles and a text with very many copies can be split.
    drops = cut(each.join(gone, "template").filter(F.col("unit") != F.col("owner")).groupBy("unit").agg(F.collect_set("line").alias("drops")))
    # The caller's columns travel in a struct, so that no name of theirs can clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), unit.alias("unit"), F.col(f"`{text_col}`").cast("string").alias("text"))
    joined = without_lines(rows.join(drops, "unit", "left"))
    text = F.col("kept")
    n = F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit("\n")) + 1).cast("long")
    columns = [text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns]
    return joined.select(*columns, n.alias(free_name(docs, "n_lines")), F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias(free_name(docs, "n_dropped")))
