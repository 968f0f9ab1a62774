"""Connected components by repeated contraction of an edge table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_components(edges: DataFrame, a: str, b: str, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, root) for every endpoint of an edge; root is one node of its component, the same for all of it.

    Each round every node takes the neighbour (or itself) that is first in the
    order of (hash, node) as its label and the edges are rewritten to labels.
    The hashed order makes the expected number of rounds logarithmic whatever
    the ids look like.  ``cut`` writes a table and reads it again (a reliable
    checkpoint), so lineage stays short.  Null endpoints are left out.
    """
    first = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    live = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    steps: list[DataFrame] = []
    live = cut(live.distinct())
    nodes = live.select(F.col("a").alias("node")).union(live.select("b")).distinct()
    live = live.where("a <> b")
    while not live.isEmpty():
        both = live.union(live.select("b", "a"))
        step = both.groupBy("a").agg(F.min(first("b")).alias("m"), F.first("a").alias("own"))
        step = cut(step.select("a", F.when(F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("v")) < F.col("m"), F.col("a")).otherwise(F.col("m.v")).alias("to")))
        steps.append(step)
        live = live.join(step.withColumnRenamed("to", "ta"), "a").join(step.select(F.col("a").alias("b"), F.col("to").alias("tb")), "b")
        live = cut(live.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).where("a <> b").distinct())
    out = nodes.select("node", F.col("node").alias("root"))
    for step in steps:
        out = out.join(step.select(F.col("a").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return out
