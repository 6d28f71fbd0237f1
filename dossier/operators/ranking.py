"""First, top-n and list forms per key that hold up when one key owns a third of the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Keys = str | Sequence[str]


def names(keys: Keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def top_n(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top_n_per(df: DataFrame, keys: Keys, n: int, *order: Column | str) -> DataFrame:
    """First ``n`` rows per key.

    The rank filter becomes a limit per key in every input task before the shuffle, so a
    hot key sends ``n`` rows per task and no more.
    """
    window = Window.partitionBy(*names(keys)).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= n)


def first_per(df: DataFrame, keys: Keys, *order: Column | str) -> DataFrame:
    return top_n_per(df, keys, 1, *order).drop("_rank")


def last_values(df: DataFrame, keys: Keys, props: Sequence[str], *order: Column | str) -> DataFrame:
    """One row per key with the properties of its last row; partial results merge before the shuffle."""
    keys = names(keys)
    latest = F.max_by(F.struct(*props), F.struct(*order))
    return df.groupBy(*keys).agg(latest.alias("_last")).select(*keys, "_last.*")


def ranked_list(
    df: DataFrame, keys: Keys, n: int, values: Mapping[str, Column], *order: Column | str
) -> DataFrame:
    """Per key an array ``items`` of its first ``n`` rows, in order."""
    top = top_n_per(df, keys, n, *order)
    item = F.struct(F.col("_rank"), *[c.alias(k) for k, c in values.items()])
    lists = top.groupBy(*names(keys)).agg(F.array_sort(F.collect_list(item)).alias("items"))
    bare = F.transform("items", lambda x: F.struct(*[x[k].alias(k) for k in values]))
    return lists.withColumn("items", bare)

