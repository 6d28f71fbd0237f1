"""Dollar figures, disclosure tests and small numeric formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier import rules
from dossier.functions.keys import col, let, strip, text


def _matches(c: Column | str, pattern: str) -> Column:
    return F.coalesce(col(c).rlike(pattern), F.lit(False))


def parse_usd(c: Column | str) -> Column:
    """First dollar figure of a text, scaled by its unit.

    NULL for a text that opens with a non-disclosure, that has no figure, or whose
    figure is above the ceiling for a single loss.
    """
    def scaled(part: Column) -> Column:
        amount, unit = part["amount"], part["unit"]
        scale = (
            F.when(unit.startswith("b"), 1e9)
            .when(unit.startswith("m"), 1e6)
            .when(unit.startswith("k") | unit.startswith("t"), 1e3)
            .otherwise(1.0)
        )
        return F.replace(amount, F.lit(","), F.lit("")).try_cast("double") * scale

    parts = F.struct(
        F.regexp_extract(col(c), rules.USD_AMOUNT, 1).alias("amount"),
        F.lower(F.regexp_extract(col(c), rules.USD_AMOUNT, 2)).alias("unit"),
    )
    value = let(let(parts, scaled), lambda v: F.when(v <= rules.USD_CEILING, v))
    return F.when(F.contains(col(c), F.lit("$")) & ~_matches(c, rules.NEGATED_DISCLOSURE), value)


def money_struct(c: Column | str) -> Column:
    return F.struct(F.nullif(col(c), F.lit("")).alias("text"), parse_usd(c).alias("usd"))


def is_disclosed(c: Column | str) -> Column:
    return (strip(text(c)) != "") & ~_matches(c, rules.NEGATED_DISCLOSURE)


def is_paid(c: Column | str) -> Column:
    return is_disclosed(c) & _matches(c, rules.RANSOM_PAID)


def is_demanded(c: Column | str) -> Column:
    return is_disclosed(c) & _matches(c, rules.RANSOM_DEMANDED)


def is_not_disclosed_any(c: Column | str) -> Column:
    """A non-disclosure phrase anywhere in the text (the test of the coverage report)."""
    return _matches(c, rules.NOT_DISCLOSED_ANYWHERE)


def is_not_disclosed_prefix(c: Column | str) -> Column:
    """A non-disclosure phrase at the start of the text (the test of the views)."""
    return _matches(c, rules.NOT_DISCLOSED_PREFIX)


def pct(n: Column, total: Column) -> Column:
    """Whole percent, halves rounded up; NULL when there is no total."""
    return F.round(F.try_divide(n, total) * 100).cast("int")


def fmt_usd(c: Column | str) -> Column:
    """Short money label: $1.2B, $3M, $40K, $350."""
    v = col(c).cast("double")
    whole = lambda x: F.round(x).cast("long").cast("string")
    billions = v / 1e9
    label = (
        F.when(
            v >= 1e9,
            F.concat(
                F.when(v % 1e9 == 0, whole(billions)).otherwise(F.format_string("%.1f", billions)),
                F.lit("B"),
            ),
        )
        .when(v >= 1e6, F.concat(whole(v / 1e6), F.lit("M")))
        .when(v >= 1e3, F.concat(whole(v / 1e3), F.lit("K")))
        .otherwise(F.regexp_replace(v.cast("string"), r"\.0$", ""))
    )
    return F.concat(F.lit("$"), label)


def heat_bucket(v: Column | str, maximum: Column) -> Column:
    """Colour step of a matrix cell: 0 when empty, else 1 to 5 on a square-root scale."""
    v = col(v)
    step = F.ceil(F.sqrt(F.try_divide(v, maximum)) * 5)
    return F.when(F.coalesce(v, F.lit(0)) == 0, 0).otherwise(
        F.least(F.greatest(step, F.lit(1)), F.lit(5))
    ).cast("int")
