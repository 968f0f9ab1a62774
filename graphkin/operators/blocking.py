"""Blocking: hierarchies of clusters, and locality-sensitive hashing.

A hierarchy has levels 0 (root) to ``levels - 1`` (the rows themselves).  A
cluster's id is the smallest key of its members, unique within its level.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregate import vector_sum
from ..functions.schema import CLUSTER_FEATURES, FeatureVector
from . import graph, modular
from .components import connected_components

PARALLEL, SERIES, PRIME = "PARALLEL", "SERIES", "PRIME"
#: edges that a task may hold as a whole
MAX_EDGES = 2_000_000
#: edges of a component up to which all its runs are one task's
SMALL = 10_000
Cut = Callable[[DataFrame], DataFrame]


@dataclass
class Hierarchy:
    """membership: level, cluster_id, pk.  clusters: level, cluster_id, cluster_type, parent.  meta: level, src, dst, weight."""

    levels: int
    membership: DataFrame
    clusters: DataFrame
    meta: DataFrame

    def at(self, level: int) -> DataFrame:
        if not 0 < level < self.levels - 1:
            raise ValueError(f"no clusters at level {level}")
        return self.clusters.where(F.col("level") == level)

    def members(self, level: int, cluster: int) -> DataFrame:
        return self.membership.where((F.col("level") == level) & (F.col("cluster_id") == cluster)).select("pk")

    def dendrogram(self) -> DataFrame:
        """parent, child, child_is_leaf, level (of the child)."""
        inner = self.clusters.select("parent", F.col("cluster_id").alias("child"), F.lit(False).alias("child_is_leaf"), "level")
        leaves = self.membership.where(F.col("level") == self.levels - 2).select(F.col("cluster_id").alias("parent"), F.col("pk").alias("child"), F.lit(True).alias("child_is_leaf"), F.lit(self.levels - 1).alias("level"))
        return inner.union(leaves)

    def dot(self, most: int = 10_000) -> str:
        """The dendrogram as Graphviz text; for small hierarchies."""
        rows = self.dendrogram().limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} nodes")
        lines = [f'  "{r["level"] - 1}:{r["parent"]}" -> "{r["level"]}:{r["child"]}";' for r in sorted(rows, key=lambda r: (r["level"], r["parent"] or 0, r["child"]))]
        return "\n".join(["digraph {", *lines, "}"])


def from_levels(edges: DataFrame, levels: list[DataFrame], types: DataFrame | None = None) -> Hierarchy:
    """A hierarchy of partitions, coarsest first: each a table of (pk, cluster_id)."""
    membership, clusters, meta = None, None, None
    for k, m in enumerate(levels, 1):
        rows = m.select(F.lit(k).alias("level"), "cluster_id", "pk")
        if k == 1:
            own = rows.select("level", "cluster_id").distinct().withColumn("parent", F.lit(None).cast("bigint"))
        else:
            up = levels[k - 2].select("pk", F.col("cluster_id").alias("parent"))
            own = rows.join(up, "pk").groupBy("level", "cluster_id").agg(F.min("parent").alias("parent"))
        own = own.withColumn("cluster_type", F.lit(PRIME)) if types is None else own.join(types, "cluster_id", "left")
        own = own.select("level", "cluster_id", "cluster_type", "parent")
        between = graph.contract(edges, m.select("pk", F.col("cluster_id").alias("cluster"))).select(F.lit(k).alias("level"), "src", "dst", "weight")
        membership = rows if membership is None else membership.union(rows)
        clusters = own if clusters is None else clusters.union(own)
        meta = between if meta is None else meta.union(between)
    weight = F.coalesce(F.col("weight"), F.lit(1)).cast("bigint") if "weight" in edges.columns else F.lit(1).cast("bigint")
    meta = meta.union(edges.select(F.lit(len(levels) + 1).alias("level"), "src", "dst", weight.alias("weight")))
    return Hierarchy(len(levels) + 2, membership, clusters, meta)


def from_groups(edges: DataFrame, groups: DataFrame) -> Hierarchy:
    """Three levels from any table (pk, grp) of groups recovered elsewhere."""
    ids = groups.groupBy("grp").agg(F.min("pk").alias("cluster_id"))
    return from_levels(edges, [groups.join(ids, "grp").select("pk", "cluster_id")])


def cluster_features(h: Hierarchy, level: int, rows: DataFrame, vector: FeatureVector, only: DataFrame | None = None) -> DataFrame:
    """level, cluster_id, c1 .. c5 and the summed vector of each cluster; rows that are missing by now add nothing, but c1 counts all members."""
    members = h.membership.where(F.col("level") == level)
    if only is not None:
        members = members.join(only.select("cluster_id"), "cluster_id", "left_semi")
    sums = vector_sum(members.join(rows.select("pk", *vector.names), "pk"), ["cluster_id"], vector)
    leaf = graph.degrees(h.meta.where(F.col("level") == level + 1)).select("pk", "weighted_in", "weighted_out")
    sizes = members.join(leaf, "pk", "left") if level + 1 == h.levels - 1 else members.withColumns({"weighted_in": F.lit(0), "weighted_out": F.lit(0)})
    sizes = sizes.groupBy("cluster_id").agg(F.count("*").cast("int").alias("c1"), F.coalesce(F.sum("weighted_in"), F.lit(0)).cast("int").alias("c2"), F.coalesce(F.sum("weighted_out"), F.lit(0)).cast("int").alias("c3"))
    own = graph.degrees(h.meta.where(F.col("level") == level)).select(F.col("pk").alias("cluster_id"), F.col("weighted_in").cast("int").alias("c4"), F.col("weighted_out").cast("int").alias("c5"))
    out = sizes.join(own, "cluster_id", "left").join(sums, "cluster_id", "left")
    zero = [F.coalesce(F.col(f.name), f.zero()).alias(f.name) for f in vector.features]
    return out.select(F.lit(level).alias("level"), "cluster_id", "c1", "c2", "c3", F.coalesce("c4", F.lit(0)).alias("c4"), F.coalesce("c5", F.lit(0)).alias("c5"), *zero)


def cluster_vector(vector: FeatureVector) -> FeatureVector:
    return FeatureVector(CLUSTER_FEATURES.features[:5] + vector.features)


# -- community consensus


def _near(code: np.ndarray, weight: np.ndarray, k: int) -> list[dict[int, float]]:
    """The neighbours of each vertex with the weights of both directions, in the order of the edges a * k + b."""
    a, b = code // k, code % k
    back = b * k + a
    at = np.minimum(np.searchsorted(code, back), len(code) - 1)
    both = weight + np.where(code[at] == back, weight[at], 0.0)
    ok = a != b
    v, n = np.stack([a, b], 1)[ok].ravel(), np.stack([b, a], 1)[ok].ravel()
    order = np.argsort(v.astype(np.uint16) if k <= 1 << 16 else v, kind="stable")
    n, z, ends = n[order].tolist(), np.repeat(both[ok], 2)[order].tolist(), [0, *np.cumsum(np.bincount(v, minlength=k)).tolist()]
    return [dict(zip(n[i:j], z[i:j], strict=True)) for i, j in pairwise(ends)]


def louvain(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, n: int, seed: int, resolution: float = 1.0, total: float | None = None) -> np.ndarray:
    """The community of each vertex 0 .. n - 1, by directed modularity: vertices move to the best neighbouring community, then communities become vertices.

    Weights are not negative.  total: the weight of the whole graph, where the edges are only a component of it.
    """
    rng = np.random.default_rng(seed)
    member = np.arange(n)
    total = float(weight.sum()) if total is None else total
    if not total:
        return member
    while True:
        k = int(member.max()) + 1
        code, inverse = np.unique(member[src].astype(np.int64) * k + member[dst], return_inverse=True)
        w = np.bincount(inverse, weights=weight)
        a, b = code // k, code % k
        out, into = np.bincount(a, weights=w, minlength=k), np.bincount(b, weights=w, minlength=k)
        near = _near(code, w, k)
        comm, size = list(range(k)), [1] * k
        links = [own.copy() for own in near]  # weights to communities, kept as vertices move
        other = [max(own.values(), default=0.0) for own in near]  # at least the largest of them to another community
        out, into = out.tolist(), into.tolist()
        sum_out, sum_in = out.copy(), into.copy()
        scale, least = resolution / total, 1e-12 * total
        moved_any, moved = False, True
        while moved:
            moved = False
            for v in rng.permutation(k).tolist():
                own, old, x, y = links[v], comm[v], out[v], into[v]
                sum_out[old] -= x
                sum_in[old] -= y
                best, most = old, own.get(old, 0.0) - scale * (x * sum_in[old] + y * sum_out[old]) + least
                if other[v] > most:  # a gain is at most the weight
                    for c, z in own.items():
                        if z > most:
                            g = z - scale * (x * sum_in[c] + y * sum_out[c])
                            if g > most:
                                best, most = c, g + least
                    z = own.get(best)
                    if z is None:
                        other[v] = max(own.values(), default=0.0)
                    else:
                        own[best] = 0.0
                        other[v] = max(own.values())
                        own[best] = z
                sum_out[best] += x
                sum_in[best] += y
                if best != old:
                    comm[v], moved, moved_any = best, True, True
                    size[old] -= 1
                    size[best] += 1
                    for u, z in near[v].items():
                        own = links[u]
                        if size[old] and (rest := own.get(old, 0.0) - z) > 0:
                            own[old] = rest
                        else:
                            own.pop(old, None)
                        if best in own:
                            z += own[best]
                        own[best] = z
                        if z > other[u] and comm[u] != best:
                            other[u] = z
        if not moved_any:
            return member
        _, dense = np.unique(np.array(comm), return_inverse=True)
        member = dense[member]


def _run(pdf: pd.DataFrame, run: int, seed: int, resolution: float, total: float | None = None) -> pd.DataFrame:
    names, flat = np.unique(np.concatenate([pdf["src"], pdf["dst"]]), return_inverse=True)
    half = len(pdf)
    c = louvain(flat[:half], flat[half:], pdf["weight"].to_numpy(float), len(names), seed + run, resolution, total)
    first = np.full(int(c.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, c, names)
    return pd.DataFrame({"run": run, "v": names, "c": first[c]})


def _plain(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", F.coalesce(F.col("weight").cast("double"), F.lit(1.0)).alias("weight"))


def _rooted(edges: DataFrame) -> DataFrame:
    """The edges with the root of their component."""
    roots = connected_components(edges, "src", "dst", lambda df: df.checkpoint())
    return edges.join(roots.withColumnRenamed("node", "src"), "src")


def _run_components(rooted: DataFrame, runs: int, seed: int, resolution: float, total: float) -> DataFrame:
    """run, v, c: every run on each component for itself, with the modularity of the whole graph."""
    many = rooted.crossJoin(F.broadcast(rooted.sparkSession.range(runs).withColumnRenamed("id", "run")))
    return many.groupBy("root", "run").applyInPandas(lambda key, pdf: _run(pdf.sort_values(["src", "dst"]), int(key[1]), seed, resolution, total), "run int, v bigint, c bigint")


def _runs(edges: DataFrame, runs: int, seed: int, resolution: float, first: int = 0) -> DataFrame:
    """run, v, c: the communities of every run from the first on."""
    spark, plain = edges.sparkSession, _plain(edges)
    if plain.limit(MAX_EDGES + 1).count() > MAX_EDGES:
        return _run_components(_rooted(plain), runs, seed, resolution, plain.agg(F.sum("weight")).first()[0])
    shared = spark.sparkContext.broadcast(plain.orderBy("src", "dst").toPandas())  # the whole graph fits each task

    def every(batches):
        for batch in batches:
            for run in batch["id"]:
                yield _run(shared.value, int(run), seed, resolution)

    return spark.range(first, runs, 1, min(runs - first, spark.sparkContext.defaultParallelism)).mapInPandas(every, "run int, v bigint, c bigint")


def agreed(labels: np.ndarray, need: int) -> np.ndarray:
    """For each vertex (a column) the first of those that it is linked with by equal labels in at least need runs (rows)."""
    _, first, kind = np.unique(labels, axis=1, return_index=True, return_inverse=True)
    classes, root = labels[:, first], np.arange(len(first))
    for i in range(len(first)):
        same = (classes[:, i : i + 1] == classes[:, i:]).sum(0) >= need
        own = np.unique(root[i:][same])
        root[np.isin(root, own)] = own[0]
    least = np.full(len(first), labels.shape[1])
    np.minimum.at(least, root[kind.ravel()], np.arange(labels.shape[1]))
    return least[root[kind.ravel()]]


def _small_components(rooted: DataFrame, runs: int, prob: float, seed: int, resolution: float, total: float) -> DataFrame:
    """pk, cluster_id: all runs of a component, and what they agree on, in one task; components of one shape are solved once."""
    need = int(np.ceil(prob * runs - 1e-9))

    def run(batches):
        known: dict[tuple, np.ndarray] = {}
        held = None

        def clusters(src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            names, flat = np.unique(np.concatenate([src, dst]), return_inverse=True)
            key = flat.tobytes(), weight.tobytes()
            if key not in known:
                if len(known) >= 10_000:
                    known.clear()
                known[key] = agreed(np.array([louvain(flat[: len(src)], flat[len(src) :], weight, len(names), seed + r, resolution, total) for r in range(runs)]), need)
            return names, names[known[key]]

        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            root, columns = pdf["root"].to_numpy(), [pdf[c].to_numpy() for c in ("src", "dst", "weight")]
            cuts = [0, *(np.flatnonzero(np.diff(root)) + 1).tolist(), len(root)]
            found = [clusters(*(c[a:b] for c in columns)) for a, b in zip(cuts, cuts[1:], strict=False)]
            return pd.DataFrame({"pk": np.concatenate([n for n, _ in found]), "cluster_id": np.concatenate([c for _, c in found])})

        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            open_ = held["root"] == held["root"].iloc[-1] if len(held) else None
            if len(held) and not open_.all():
                yield whole(held[~open_])
                held = held[open_]
        if held is not None and len(held):
            yield whole(held)

    columns = rooted.select("root", "src", "dst", "weight").repartition("root").sortWithinPartitions("root", "src", "dst")
    return columns.mapInPandas(run, "pk bigint, cluster_id bigint")


def consensus(edges: DataFrame, runs: int, prob: float, seed: int, resolution: float, cut: Cut) -> DataFrame:
    """pk, cluster_id: the communities that the runs on a graph agree on."""
    plain = _plain(edges)
    if plain.where("src <> dst").isEmpty():  # nothing can move
        return plain.select(F.col("src").alias("pk"), F.col("src").alias("cluster_id")).distinct()
    if plain.limit(MAX_EDGES + 1).count() <= MAX_EDGES:
        return _consensus_whole(edges, runs, prob, seed, resolution, cut)
    total, rooted = plain.agg(F.sum("weight")).first()[0], cut(_rooted(plain))
    large = cut(rooted.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > SMALL).select("root"))
    found = _small_components(rooted.join(large, "root", "left_anti"), runs, prob, seed, resolution, total)
    if large.isEmpty():
        return found
    return found.union(agreeing(_run_components(rooted.join(large, "root", "left_semi"), runs, seed, resolution, total), runs, prob, cut))


def _consensus_whole(edges: DataFrame, runs: int, prob: float, seed: int, resolution: float, cut: Cut) -> DataFrame:
    """pk, cluster_id of a graph that a task can hold.

    A pair that differs in more runs than prob allows is out whatever the other
    runs give.  If that holds of every pair after the first runs, all vertices stay
    alone, and the other runs, which cannot change that, are left out.
    """
    off = runs - int(np.ceil(prob * runs - 1e-9))
    early = 6 * (off + 1)
    if 2 * early > runs:
        return agreeing(_runs(edges, runs, seed, resolution), runs, prob, cut)
    labels = cut(_runs(edges, early, seed, resolution))
    vectors, classes, links = _agreements(labels, early, early - off, cut)
    if vectors.count() == classes.count() and links.isEmpty():
        return vectors.select(F.col("v").alias("pk"), F.col("v").alias("cluster_id"))
    return agreeing(labels.union(_runs(edges, runs, seed, resolution, early)), runs, prob, cut)


def _agreements(labels: DataFrame, runs: int, need: int, cut: Cut) -> tuple[DataFrame, DataFrame, DataFrame]:
    """v, label; lead, label; lead, lead2: the vertices' labels, their classes, and the pairs of classes that agree in at least need runs, which may repeat.

    Vertices with equal labels in all runs are one class.  Two classes that
    differ in at most d runs agree on all of one of d + 1 blocks of runs, so
    only classes that share a block are compared: no other pair can qualify.
    """
    blocks = min(runs, runs - need + 1)
    vectors = labels.groupBy("v").agg(F.transform(F.array_sort(F.collect_list(F.struct("run", "c"))), lambda x: x["c"]).alias("label"))
    classes = cut(vectors.groupBy("label").agg(F.min("v").alias("lead")))
    bounds = [round(k * runs / blocks) for k in range(blocks + 1)]
    keys = F.array(*(F.struct(F.lit(k).alias("b"), F.slice("label", bounds[k] + 1, bounds[k + 1] - bounds[k]).alias("part")) for k in range(blocks)))
    parts = classes.select("lead", "label", F.explode(keys).alias("k")).select("lead", "label", "k.b", "k.part")
    other = parts.select(F.col("lead").alias("lead2"), F.col("label").alias("label2"), "b", "part")
    same = F.size(F.filter(F.zip_with("label", "label2", lambda x, y: x == y), lambda x: x))
    return vectors, classes, parts.join(other, ["b", "part"]).where((F.col("lead") < F.col("lead2")) & (same >= need)).select("lead", "lead2")


def agreeing(labels: DataFrame, runs: int, prob: float, cut: Cut) -> DataFrame:
    """pk, cluster_id: components of vertices that share a community in at least prob of the runs."""
    vectors, classes, links = _agreements(labels, runs, int(np.ceil(prob * runs - 1e-9)), cut)
    roots = connected_components(links.distinct(), "lead", "lead2", cut)
    whole = vectors.join(classes, "label").select("v", "lead").join(roots.withColumnRenamed("node", "lead"), "lead", "left").select("v", F.coalesce("root", "lead").alias("root"))
    ids = whole.groupBy("root").agg(F.min("v").alias("cluster_id"))
    return whole.join(ids, "root").select(F.col("v").alias("pk"), "cluster_id")


def louvain_consensus(edges: DataFrame, cut: Cut, *, runs: int = 100, prob: float = 0.95, seed: int = 1, resolution: float = 1.0) -> Hierarchy | None:
    """Communities that the runs agree on, level by level while modularity rises; None where not even one level is gained."""
    base = cut(edges.select("src", "dst", (F.coalesce(F.col("weight"), F.lit(1)) if "weight" in edges.columns else F.lit(1)).cast("bigint").alias("weight")))
    current, levels, best = base, [], 0.0
    while True:
        found = cut(consensus(current, runs, prob, seed, resolution, cut))
        score = graph.modularity(current, found.select("pk", F.col("cluster_id").alias("cluster"))).first()[0]
        if score is None or score <= best:
            break
        if levels:
            up = found.select(F.col("pk").alias("below"), F.col("cluster_id").alias("above"))
            top = levels[-1].join(up, F.col("cluster_id") == F.col("below")).select("pk", F.col("above").alias("cluster_id"))
        else:
            top = found
        levels.append(cut(top))
        best = score
        current = cut(graph.contract(current, found.select("pk", F.col("cluster_id").alias("cluster"))))
    return from_levels(base, levels[::-1]) if levels else None


def modular_hierarchy(edges: DataFrame, cut: Cut) -> Hierarchy:
    """Three levels: each vertex in the module of the modular decomposition that is its parent."""
    tree = cut(modular.modules(edges, cut))
    types = tree.select(F.col("module").alias("cluster_id"), F.col("kind").alias("cluster_type")).distinct()
    return from_levels(edges, [tree.select("pk", F.col("module").alias("cluster_id"))], types)


# -- hashing


def planes(count: int, dims: int, seed: int = 0) -> list[list[float]]:
    return np.random.default_rng(seed).standard_normal((count, dims)).tolist()


def lsh_bucket(vector: Column, normals: list[list[float]]) -> Column:
    """The signs of the products with each plane, as bits; both sides have to use the same planes."""
    bits = F.lit(0)
    for k, normal in enumerate(normals):
        plane = F.array(*(F.lit(x) for x in normal))
        product = F.aggregate(F.zip_with(vector, plane, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + F.coalesce(x.cast("double"), F.lit(0.0)))
        bits = bits + F.when(product >= 0, 1 << k).otherwise(0)
    return bits


def function_bucket(count: int = 16, seed: int = 0) -> Column:
    """The bucket of a function by its vertex, edge and instruction classes."""
    vector = F.concat("vertex_classification", "edge_classification", "insn_bow").cast("array<double>")
    return lsh_bucket(vector, planes(count, 65, seed))
