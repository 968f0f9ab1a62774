"""One-to-one matchers.

A side is a DataFrame (pk bigint, name string, feature columns); matches are
(lhs_pk, lhs_name, rhs_pk, rhs_name, distance, matcher).  Every matcher is a
function of DataFrames; rows that are matched leave by ``remaining``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.schema import FeatureVector
from . import held
from .assignment import assign

MATCHES = "lhs_pk bigint, lhs_name string, rhs_pk bigint, rhs_name string, distance double, matcher string"
IMPORT, EXPORT = 1, 2
Cut = Callable[[DataFrame], DataFrame]


def remaining(rows: DataFrame, matches: DataFrame, side: str) -> DataFrame:
    return rows.join(matches.select(F.col(f"{side}_pk").alias("pk")), "pk", "left_anti")


def _named(pairs: DataFrame, lhs: DataFrame, rhs: DataFrame, matcher: str | Column) -> DataFrame:
    """pairs (lhs_pk, rhs_pk, distance) with both names."""
    a, b = lhs.select(F.col("pk").alias("lhs_pk"), F.col("name").alias("lhs_name")), rhs.select(F.col("pk").alias("rhs_pk"), F.col("name").alias("rhs_name"))
    return pairs.join(a, "lhs_pk").join(b, "rhs_pk").select("lhs_pk", "lhs_name", "rhs_pk", "rhs_name", "distance", F.lit(matcher).alias("matcher"))


# -- names


def _ranked(rows: DataFrame, *, stretches: int = 256) -> DataFrame:
    """rows (k, pk, ...) with n, the place of the key in its value from the largest down.

    A value that many rows share is not sorted in one task: rows are ranked
    within stretches of the keys, and the counts of the stretches above, at most
    ``stretches`` for each value, are added.
    """
    ends = rows.agg(F.min("pk").alias("_lo"), F.max("pk").alias("_hi"))
    rows = rows.join(F.broadcast(ends)).withColumn("_s", F.floor((F.col("pk") - F.col("_lo")) / ((F.col("_hi") - F.col("_lo") + 1) / stretches))).drop("_lo", "_hi")
    above = W.partitionBy("k").orderBy(F.desc("_s")).rowsBetween(W.unboundedPreceding, -1)
    counts = rows.groupBy("k", "_s").agg(F.count("*").alias("_n")).select("k", "_s", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_above"))
    placed = rows.withColumn("_i", F.row_number().over(W.partitionBy("k", "_s").orderBy(F.desc("pk"))))
    return placed.join(counts, ["k", "_s"]).withColumn("n", F.col("_above") + F.col("_i")).drop("_s", "_i", "_above")


def optimistic(lhs: DataFrame, rhs: DataFrame, key: Column, matcher: str = "optimistic") -> DataFrame:
    """The n-th largest key of each value on the left with the n-th largest on the right.  Null values match nothing."""

    def side(rows: DataFrame, p: str) -> DataFrame:
        ranked = _ranked(rows.select(key.alias("k"), "pk", "name").where(F.col("k").isNotNull()))
        return ranked.select("k", "n", F.col("pk").alias(f"{p}_pk"), F.col("name").alias(f"{p}_name"))

    both = side(lhs, "lhs").join(side(rhs, "rhs"), ["k", "n"])
    return both.select("lhs_pk", "lhs_name", "rhs_pk", "rhs_name", F.lit(None).cast("double").alias("distance"), F.lit(matcher).alias("matcher"))


def by_name(lhs: DataFrame, rhs: DataFrame) -> DataFrame:
    return optimistic(lhs, rhs, F.col("name"), "name")


def by_export(lhs: DataFrame, rhs: DataFrame) -> DataFrame:
    kind = F.col("function_type") == EXPORT
    return optimistic(lhs.where(kind), rhs.where(kind), F.col("name"), "export")


def import_name(name: Column) -> Column:
    """The name up to its first ``@@``, without one leading ``__imp_``."""
    return F.regexp_replace(F.regexp_replace(name, r"(?s)@@.*", ""), r"\A__imp_", "")


def by_import(lhs: DataFrame, rhs: DataFrame) -> DataFrame:
    kind = F.col("function_type") == IMPORT
    return optimistic(lhs.where(kind), rhs.where(kind), import_name(F.col("name")), "import")


# -- vectors


def _unique_pairs(lhs: DataFrame, rhs: DataFrame, by: list[str], features: list[str]) -> DataFrame:
    """(by, lhs_pk, rhs_pk): vectors that one row of each side has, within each value of by."""

    def side(rows: DataFrame, p: str) -> DataFrame:
        once = rows.groupBy(*by, *features).agg(F.count("*").alias("n"), F.min("pk").alias(f"{p}_pk")).where("n = 1").drop("n")
        return once.withColumn("h", F.xxhash64(*features))

    a = side(lhs, "lhs")
    b = side(rhs, "rhs").withColumnsRenamed({c: f"_{c}" for c in [*by, *features, "h"]})
    same = F.col("h") == F.col("_h")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    for c in features:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return a.join(b, same).select(*by, "lhs_pk", "rhs_pk")


def exact_singleton(lhs: DataFrame, rhs: DataFrame, features: list[str]) -> DataFrame:
    pairs = _unique_pairs(lhs, rhs, [], features).withColumn("distance", F.lit(0.0))
    return _named(pairs, lhs, rhs, "exact_singleton")


def inexact_singleton(lhs: DataFrame, rhs: DataFrame, vector: FeatureVector, *, how: str = "optimal") -> DataFrame:
    one = lambda rows: rows.withColumn("block", F.lit(""))
    return _named(assign(one(lhs), one(rhs), vector, how=how).drop("block"), lhs, rhs, f"{how}_singleton")


# -- neighbourhoods and windows


def _settle(pairs: DataFrame, priority: list[str]) -> DataFrame:
    """Of pairs that share a row, those that come first for both their rows."""
    order = [F.col(c) for c in priority]
    a, b = W.partitionBy("lhs_pk").orderBy(*order, "rhs_pk"), W.partitionBy("rhs_pk").orderBy(*order, "lhs_pk")
    ranked = pairs.select("*", F.row_number().over(a).alias("_a"), F.row_number().over(b).alias("_b"))
    return ranked.where("_a = 1 AND _b = 1").drop("_a", "_b")


def structural_blocks(seeds: DataFrame, lhs_edges: DataFrame, rhs_edges: DataFrame) -> DataFrame:
    """degree, lpk, rpk, dir for matched pairs of equal out-degree (dir 0) and equal in-degree (dir 1) in the whole graphs."""
    parts = []
    for direction, (key, _) in enumerate((("src", "dst"), ("dst", "src"))):
        deg = lambda e, p, key=key: e.groupBy(F.col(key).alias(p)).agg(F.count("*").alias(f"{p}_degree"))
        both = seeds.select(F.col("lhs_pk").alias("lpk"), F.col("rhs_pk").alias("rpk")).join(deg(lhs_edges, "lpk"), "lpk").join(deg(rhs_edges, "rpk"), "rpk").where("lpk_degree = rpk_degree")
        parts.append(both.select(F.col("lpk_degree").alias("degree"), "lpk", "rpk", F.lit(direction).alias("dir")))
    return parts[0].union(parts[1])


def _block_members(blocks: DataFrame, rows: DataFrame, edges: DataFrame, side: str) -> DataFrame:
    """The rows that are still unmatched among the neighbours of each block's vertex on one side."""
    out = edges.select(F.col("src").alias(side), F.col("dst").alias("pk"), F.lit(0).alias("dir")).union(edges.select("dst", "src", F.lit(1)))
    return blocks.join(out.distinct(), [side, "dir"]).join(rows, "pk")


def _in_blocks(blocks: DataFrame, a: DataFrame, b: DataFrame, by: list[str], vector: FeatureVector, how: str) -> DataFrame:
    """by, lhs_pk, rhs_pk, distance: the pairs of every block, each for itself."""
    if how == "exact":
        return _unique_pairs(a, b, by, vector.names).withColumn("distance", F.lit(0.0))
    block = F.concat_ws("/", *(F.format_string("%020d", F.col(c).cast("long")) for c in by))
    pairs = assign(a.withColumn("block", block), b.withColumn("block", block), vector, how=how)
    return pairs.join(blocks.withColumn("block", block), "block").drop("block")


STRUCTURAL, MONOTONIC = ["degree", "lpk", "rpk", "dir"], ["lo", "ro", "w"]


def structural_pairs(seeds: DataFrame, lhs: DataFrame, rhs: DataFrame, lhs_edges: DataFrame, rhs_edges: DataFrame, vector: FeatureVector, *, how: str = "exact", within: tuple[str, ...] = ()) -> DataFrame:
    """degree, lpk, rpk, dir, lhs_pk, rhs_pk, distance: what is found in the neighbourhoods of each matched pair.

    how: exact, optimal or greedy.  within (exact only): columns that both rows of a pair have to agree in.
    """
    blocks = structural_blocks(seeds, lhs_edges, rhs_edges)
    a, b = _block_members(blocks, lhs, lhs_edges, "lpk"), _block_members(blocks, rhs, rhs_edges, "rpk")
    return _in_blocks(blocks, a, b, [*STRUCTURAL, *within], vector, how)


def structural_round(seeds: DataFrame, lhs: DataFrame, rhs: DataFrame, lhs_edges: DataFrame, rhs_edges: DataFrame, vector: FeatureVector, *, how: str = "exact", within: tuple[str, ...] = ()) -> DataFrame:
    """lhs_pk, rhs_pk, distance: what one pass over the neighbourhoods of matched pairs finds."""
    return _settle(structural_pairs(seeds, lhs, rhs, lhs_edges, rhs_edges, vector, how=how, within=within), STRUCTURAL).select("lhs_pk", "rhs_pk", "distance")


def windows(matches: DataFrame, *, buckets: int = 1024) -> DataFrame:
    """lo, ro, w: the open starts of both gaps between consecutive matches (by left key) whose right keys ascend, and the smaller gap.

    Consecutive across tasks: matches are put into stretches of the key range;
    only the last match of each stretch (a row per stretch) is ordered as a whole.
    """
    m = matches.select("lhs_pk", "rhs_pk")
    ends = m.agg(F.min("lhs_pk").alias("lo"), F.max("lhs_pk").alias("hi"))
    m = m.join(F.broadcast(ends)).select("lhs_pk", "rhs_pk", F.floor((F.col("lhs_pk") - F.col("lo")) / ((F.col("hi") - F.col("lo") + 1) / buckets)).alias("s"))
    last = m.groupBy("s").agg(F.max(F.struct("lhs_pk", "rhs_pk")).alias("last"))
    before = last.select("s", F.lag("last").over(W.orderBy("s")).alias("before"))  # at most `buckets` rows
    order = W.partitionBy("s").orderBy("lhs_pk")
    prev = F.coalesce(F.lag(F.struct("lhs_pk", "rhs_pk")).over(order), F.col("before"))
    return m.join(F.broadcast(before), "s").select("lhs_pk", "rhs_pk", prev.alias("p")).where("rhs_pk > p.rhs_pk").select(F.col("p.lhs_pk").alias("lo"), F.col("p.rhs_pk").alias("ro"), F.least(F.col("lhs_pk") - F.col("p.lhs_pk"), F.col("rhs_pk") - F.col("p.rhs_pk")).alias("w"))


def _in_windows(gaps: DataFrame, rows: DataFrame, start: str) -> DataFrame:
    """Rows with a key in (start, start + w], by an equi-join on bins about as wide as a window."""
    width = gaps.agg(F.greatest(F.lit(1), F.ceil(F.avg("w"))).cast("long").alias("width"))  # one row
    g = gaps.join(F.broadcast(width))
    g = g.select("lo", "ro", "w", F.explode(F.sequence(F.floor((F.col(start) + 1) / F.col("width")), F.floor((F.col(start) + F.col("w")) / F.col("width")))).alias("bin"))
    r = rows.join(F.broadcast(width)).withColumn("bin", F.floor(F.col("pk") / F.col("width"))).drop("width")
    return g.join(r, "bin").where((F.col("pk") > F.col(start)) & (F.col("pk") <= F.col(start) + F.col("w"))).drop("bin")


def monotonic_pairs(matches: DataFrame, lhs: DataFrame, rhs: DataFrame, vector: FeatureVector, *, how: str = "exact", within: tuple[str, ...] = ()) -> DataFrame:
    """lo, ro, w, lhs_pk, rhs_pk, distance: what is found in each window between matches."""
    gaps = windows(matches)
    return _in_blocks(gaps, _in_windows(gaps, lhs, "lo"), _in_windows(gaps, rhs, "ro"), [*MONOTONIC, *within], vector, how)


def monotonic_round(matches: DataFrame, lhs: DataFrame, rhs: DataFrame, vector: FeatureVector, *, how: str = "exact", within: tuple[str, ...] = ()) -> DataFrame:
    """lhs_pk, rhs_pk, distance: what one pass over the windows between matches finds."""
    return _settle(monotonic_pairs(matches, lhs, rhs, vector, how=how, within=within), MONOTONIC).select("lhs_pk", "rhs_pk", "distance")


def fixpoint(step: Callable[[DataFrame, DataFrame, DataFrame, DataFrame], DataFrame], matches: DataFrame, lhs: DataFrame, rhs: DataFrame, matcher: str, cut: Cut, *, new_only: bool = False) -> DataFrame:
    """All matches after repeating step(matches, newest, lhs, rhs) until it adds nothing.

    With new_only the newest matches suffice for a pass; one over all matches
    then makes sure of the end, as a removal can make a vector unique.
    """
    newest, whole = matches, True
    while True:  # each round takes rows away, so this ends
        found = cut(_named(step(matches, newest, remaining(lhs, matches, "lhs"), remaining(rhs, matches, "rhs")), lhs, rhs, matcher))
        if found.isEmpty():
            if whole or not new_only:
                return matches
            newest, whole = matches, True
            continue
        matches, newest, whole = cut(matches.unionByName(found)), found if new_only else None, not new_only
        newest = matches if newest is None else newest


def structural(matches: DataFrame, lhs: DataFrame, rhs: DataFrame, lhs_edges: DataFrame, rhs_edges: DataFrame, vector: FeatureVector, cut: Cut, *, how: str = "exact") -> DataFrame:
    """Semi-naive: a pass starts from the matches that the one before it found.  Datasets that a task can hold are matched in one."""
    name = f"{how}_structural"
    if held.fits(lhs, rhs, lhs_edges, rhs_edges):
        return grown([("structural", how)], matches, lhs, rhs, (lhs_edges, rhs_edges), vector, cut)[0]
    return fixpoint(lambda _, new, a, b: structural_round(new, a, b, lhs_edges, rhs_edges, vector, how=how), matches, lhs, rhs, name, cut, new_only=True)


def monotonic(matches: DataFrame, lhs: DataFrame, rhs: DataFrame, vector: FeatureVector, cut: Cut, *, how: str = "exact") -> DataFrame:
    name = f"{how}_monotonic"
    if held.fits(lhs, rhs):
        return grown([("monotonic", how)], matches, lhs, rhs, None, vector, cut)[0]
    return fixpoint(lambda all_, _, a, b: monotonic_round(all_, a, b, vector, how=how), matches, lhs, rhs, name, cut)


def grown(passes: list[held.Pass], matches: DataFrame, lhs: DataFrame, rhs: DataFrame, edges: tuple[DataFrame, DataFrame] | None, vector: FeatureVector, cut: Cut) -> tuple[DataFrame, dict[str, tuple[int, float]]]:
    """All matches after repeating the passes in one task, and for each matcher how many it found and its seconds."""
    found = cut(held.repeat(passes, matches, lhs, rhs, edges, vector))
    seconds = F.sum(F.when(F.col("lhs_pk").isNull(), F.col("distance")))
    counts = {r["matcher"]: (r["n"], r["seconds"]) for r in found.groupBy("matcher").agg(F.count("lhs_pk").alias("n"), seconds.alias("seconds")).collect()}  # a row for each pass
    if not any(n for n, _ in counts.values()):
        return matches, counts
    return cut(matches.unionByName(_named(found.where("lhs_pk IS NOT NULL"), lhs, rhs, F.col("matcher")))), counts


def report(matches: DataFrame) -> DataFrame:
    """One row: pairs with equal and with different names."""
    same = F.col("lhs_name") == F.col("rhs_name")
    return matches.agg(F.count_if(same).alias("n_match"), F.count_if(~same).alias("n_mismatch"))
