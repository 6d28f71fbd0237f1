"""Text cleaning, display forms and retrieval texts."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier import rules
from dossier.functions.keys import col, is_url, strip, text


def clip(c: Column | str, n: int) -> Column:
    """First ``n`` characters, '' for NULL."""
    return F.left(text(c), F.lit(n))


def display_label(
    key: Column | str,
    acronyms: Sequence[str] = rules.LABEL_ACRONYMS,
    small: Sequence[str] = rules.LABEL_SMALL_WORDS,
) -> Column:
    """Title-cased label of a canonical key."""

    def word(w: Column) -> Column:
        return (
            F.when(w.isin(list(acronyms)), F.upper(w))
            .when(w.isin(list(small)), w)
            .otherwise(F.initcap(w))
        )

    return F.array_join(F.transform(F.split(col(key), " "), word), " ")


def short_name(c: Column | str) -> Column:
    """Column heading: the name up to its first ' and ' or comma, 22 characters at most."""
    head = F.regexp_replace(text(c), r" and .*", "")
    return F.left(F.regexp_replace(head, r",.*", ""), F.lit(22))


def de_dash(c: Column | str) -> Column:
    """Em dashes become commas; the punctuation this doubles is repaired. Other texts stay as they are."""
    out = F.regexp_replace(col(c), r"\s*—\s*", ", ")
    for pattern, replacement in (
        (r",\s*,+", ", "),
        (r"([,;:])\s*,", "$1 "),
        (r"\s+,", ","),
        (r",(\s*[.)\]])", "$1"),
        (r"\s{2,}", " "),
    ):
        out = F.regexp_replace(out, pattern, replacement)
    return F.when(F.contains(col(c), F.lit("—")), strip(out)).otherwise(col(c))


def clean_payload(df: DataFrame, keep: Collection[str] = ("u", "source_url", "src")) -> DataFrame:
    """Apply ``de_dash`` to every string of every column, nested ones included.

    URLs and fields named in ``keep`` stay untouched.
    """

    def clean(c: Column, dtype: T.DataType) -> Column:
        if isinstance(dtype, T.StringType):
            return F.when(is_url(c, slashes=True), c).otherwise(de_dash(c))
        if isinstance(dtype, T.ArrayType):
            return F.transform(c, lambda x: clean(x, dtype.elementType))
        if isinstance(dtype, T.StructType):
            fields = [
                (c[f.name] if f.name in keep else clean(c[f.name], f.dataType)).alias(f.name)
                for f in dtype.fields
            ]
            return F.when(c.isNotNull(), F.struct(*fields))
        if isinstance(dtype, T.MapType):
            return F.transform_values(c, lambda _, v: clean(v, dtype.valueType))
        return c

    return df.select(
        [
            F.col(f"`{f.name}`")
            if f.name in keep
            else clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name)
            for f in df.schema.fields
        ]
    )


def strip_html(c: Column | str, limit: int | None = None) -> Column:
    """Visible text of a page: scripts, styles, tags and named entities removed, blanks squeezed."""
    out = F.regexp_replace(text(c), r"(?is)<(script|style).*?</\1>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]+>", " ")
    out = F.regexp_replace(out, r"&[a-z]+;", " ")
    out = F.trim(F.regexp_replace(out, r"(?U)\s+", " "))
    return out if limit is None else F.left(out, F.lit(limit))


def rag_text(label: str) -> Column:
    """Retrieval text of a node, built from the node columns of its label."""

    def joined(*parts: str) -> Column:
        return F.concat(*[text(F.col(p[1:])) if p[0] == "$" else F.lit(p) for p in parts])

    templates = {
        "Industry": ("$id", ". ", "$overview", " ", "$distinct", " ", "$extortion_leverage"),
        "Hazard": ("$name", ". ", "$description"),
        "Exposure": ("$name", ". ", "$description"),
        "Incident": (
            "$victim", ". ", "$summary", " Impact: ", "$financial_impact", " Downtime: ", "$downtime",
        ),
        "Subcategory": ("$name", " (", "$parent", ")"),
    }
    return joined(*templates[label])
