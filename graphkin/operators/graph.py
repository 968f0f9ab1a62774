"""Graph analytics on edge tables (src, dst, weight)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def chain(rows: DataFrame, vertex: str, order: list[str], stretch: Column) -> DataFrame:
    """src, dst: the vertex of each row and that of the row after it in a total order; the last row has none.

    stretch rises with the order.  Rows are ordered within each stretch; only the
    first row of every stretch, one for each, is ordered as a whole.
    """
    rows = rows.select(*order, F.col(vertex).alias("src"), stretch.alias("_s"))
    heads = rows.groupBy("_s").agg(F.min_by("src", F.struct(*order)).alias("_head"))
    heads = heads.select("_s", F.lead("_head").over(W.orderBy("_s")).alias("_next"))
    after = F.lead(F.struct("src")).over(W.partitionBy("_s").orderBy(*order))
    steps = rows.select("_s", "src", after.alias("_after")).join(heads.withColumnRenamed("_s", "_t"), F.col("_s").eqNullSafe(F.col("_t")))
    return steps.select("src", F.when(F.col("_after").isNotNull(), F.col("_after.src")).otherwise(F.col("_next")).alias("dst"))


def degrees(edges: DataFrame) -> DataFrame:
    """pk, in_degree, out_degree and the weighted ones, for every endpoint.  Both directions are summed in one shuffle."""
    w = F.coalesce(F.col("weight"), F.lit(1)) if "weight" in edges.columns else F.lit(1)
    ends = F.explode(F.array(F.struct(F.col("src").alias("pk"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("pk"), F.lit(0).alias("o"), F.lit(1).alias("i"))))
    both = edges.select(ends.alias("e"), w.alias("w")).select("e.*", "w")
    return both.groupBy("pk").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.sum(F.col("i") * F.col("w")).alias("weighted_in"), F.sum(F.col("o") * F.col("w")).alias("weighted_out"))


def contract(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """The meta-graph of clusters: src, dst, weight = number of edges; those inside a cluster are its loops.  membership: pk, cluster."""
    a, b = membership.select(F.col("pk").alias("src"), F.col("cluster").alias("ca")), membership.select(F.col("pk").alias("dst"), F.col("cluster").alias("cb"))
    return edges.join(a, "src").join(b, "dst").groupBy(F.col("ca").alias("src"), F.col("cb").alias("dst")).agg(F.count("*").alias("weight"))


def modularity(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """One row: the directed modularity of a partition, sum over clusters of L/m - Kout Kin / m^2."""
    w = F.coalesce(F.col("weight"), F.lit(1)).cast("double")
    a, b = membership.select(F.col("pk").alias("src"), F.col("cluster").alias("ca")), membership.select(F.col("pk").alias("dst"), F.col("cluster").alias("cb"))
    pairs = edges.join(a, "src").join(b, "dst").groupBy("ca", "cb").agg(F.sum(w).alias("w"))
    ends = F.explode(F.array(F.struct(F.col("ca").alias("c"), F.col("w").alias("o"), F.lit(0.0).alias("i"), F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0).alias("l")), F.struct(F.col("cb").alias("c"), F.lit(0.0).alias("o"), F.col("w").alias("i"), F.lit(0.0).alias("l"))))
    per = pairs.select(ends.alias("e")).select("e.*").groupBy("c").agg(F.sum("o").alias("o"), F.sum("i").alias("i"), F.sum("l").alias("l"))
    total = per.agg(F.sum("l").alias("l"), F.sum(F.col("o") * F.col("i")).alias("oi"), F.sum("o").alias("m"))
    return total.select((F.col("l") / F.col("m") - F.col("oi") / (F.col("m") * F.col("m"))).alias("modularity"))


def _neighbours(edges: DataFrame) -> DataFrame:
    """Undirected neighbour pairs (v, n), once each, without loops."""
    both = edges.select(F.col("src").alias("v"), F.col("dst").alias("n")).union(edges.select("dst", "src"))
    return both.where("v <> n").distinct()


def twins(edges: DataFrame) -> DataFrame:
    """v, kind (PARALLEL: same neighbours; SERIES: same neighbours and itself) and module: the smallest vertex of two or more twins."""
    pairs = _neighbours(edges)
    closed = pairs.union(pairs.select("v", F.col("v").alias("n")).distinct())

    def of(rows: DataFrame, kind: str) -> DataFrame:
        sets = rows.groupBy("v").agg(F.sort_array(F.collect_set("n")).alias("s"))
        found = sets.groupBy("s").agg(F.min("v").alias("module"), F.count("*").alias("k")).where("k > 1")
        return sets.join(found, "s").select("v", F.lit(kind).alias("kind"), "module")

    return of(pairs, "PARALLEL").union(of(closed, "SERIES"))
