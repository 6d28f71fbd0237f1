"""Connected components of a graph given as edges, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.session import stored

EDGES_PER_TASK = 100_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of the edges (a, b) with the smallest node that it reaches.

    In each round every node points to its smallest neighbour, chains of pointers are
    followed to their ends by doubling, and the edges are drawn between the ends. The
    graph at least halves, so the rounds are logarithmic. Minima are aggregated before the
    shuffle, so a node with very many neighbours is no burden. Null ends are not edges.
    The edges are counted, and every table has one task per EDGES_PER_TASK of them: the
    many short steps then cost few tasks, whatever the session's number of partitions is.

    The table of a step is stored as files, whose size is all that the next plan knows of it. A
    checkpoint hands on the estimate of its plan, and that of a join is the product of its
    sides: a number that has twice as many digits after every doubling, until it fills the
    driver. A small file may hold many rows, so the joins of the steps do not go by its size.
    """
    edges = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    tasks = max(1, -(-edges.count() // EDGES_PER_TASK))
    kept = lambda df: stored(df.coalesce(tasks))
    edges = edges.coalesce(tasks)
    labels = kept(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node")))
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        up = kept(both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("up")))
        while True:
            ends = up.select(F.col("node").alias("up"), F.col("up").alias("next"))
            further = kept(up.join(ends.hint("merge"), "up").select("node", F.col("next").alias("up"), (F.col("next") != F.col("up")).alias("moved")))
            up = further.select("node", "up")
            if further.filter("moved").isEmpty():
                break
        labels = kept(labels.join(up.withColumnRenamed("node", "root").hint("merge"), "root", "left").select("node", F.coalesce("up", "root").alias("root")))
        a, b = up.select(F.col("node").alias("a"), F.col("up").alias("x")), up.select(F.col("node").alias("b"), F.col("up").alias("y"))
        drawn = edges.join(a.hint("merge"), "a").join(b.hint("merge"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        edges = kept(drawn.filter("a < b").distinct())
    return labels
