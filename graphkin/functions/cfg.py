"""Features of control-flow graphs.

Counts of vertices are aggregates (``vertex_counts``).  What depends on the
traversal comes from one pass over each graph: graphs are packed into a row each
and many of them go to a task at a time.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENTER_ROOT, ENTER, BACK, FORWARD, LEAVE = 0, 1, 2, 3, 5
KEPT = 64

Graph = dict[int, list[int]]


def traverse(graph: Graph) -> tuple[list[tuple[int, int | None, int]], list[int]]:
    """(events, roots) of the depth-first traversal.

    It starts from the smallest vertex not yet done that has no incoming edge,
    else from the smallest one; neighbours go in ascending order.  An event is
    (code, from, to): entering a root or another vertex, meeting an open vertex
    or a closed one, leaving.
    """
    indegree = defaultdict(int)
    for targets in graph.values():
        for v in targets:
            indegree[v] += 1
    order = sorted(graph, key=lambda v: (indegree[v] > 0, v))
    state: dict[int, int] = {}
    events, roots = [], []
    for root in order:
        if root in state:
            continue
        roots.append(root)
        events.append((ENTER_ROOT, None, root))
        state[root] = 1
        stack = [(root, None, iter(sorted(graph[root])))]
        while stack:
            v, parent, rest = stack[-1]
            for w in rest:
                if w not in state:
                    events.append((ENTER, v, w))
                    state[w] = 1
                    stack.append((w, v, iter(sorted(graph[w]))))
                    break
                events.append((BACK if state[w] == 1 else FORWARD, v, w))
            else:
                events.append((LEAVE, parent, v))
                state[v] = 2
                stack.pop()
    return events, roots


def octal(events: list[tuple[int, int | None, int]]) -> str:
    """The signature: a digit for each event, without leading zeros."""
    return "".join(str(code) for code, _, _ in events).lstrip("0")


def bits(events: list[tuple[int, int | None, int]]) -> str:
    """The shorter signature of entering (1) and leaving (0)."""
    return "".join("1" if code <= ENTER else "0" for code, _, _ in events if code in (ENTER_ROOT, ENTER, LEAVE))


def depths(graph: Graph, events: list[tuple[int, int | None, int]]) -> dict[int, int]:
    """The longest path from the roots without back edges, found in reverse order of leaving."""
    back = {(v, w) for code, v, w in events if code == BACK}
    depth = dict.fromkeys(graph, 0)
    for v in [w for code, _, w in reversed(events) if code == LEAVE]:
        for w in graph[v]:
            if v != w and (v, w) not in back:
                depth[w] = max(depth[w], depth[v] + 1)
    return depth


def dominators(graph: Graph, roots: list[int]) -> dict[int, int]:
    """Immediate dominators below a common start vertex -1 that leads to every root."""
    full = {**graph, -1: list(roots)}
    order, seen = [], {-1}
    stack = [(-1, iter(full[-1]))]
    while stack:
        v, rest = stack[-1]
        step = next((w for w in rest if w not in seen), None)
        if step is None:
            order.append(v)
            stack.pop()
        else:
            seen.add(step)
            stack.append((step, iter(full[step])))
    rank = {v: k for k, v in enumerate(order)}
    before = defaultdict(list)
    for v in order:
        for w in full[v]:
            before[w].append(v)
    idom = {-1: -1}
    changed = True
    while changed:
        changed = False
        for v in reversed(order[:-1]):
            new = None
            for u in before[v]:
                if u not in idom:
                    continue
                if new is None:
                    new = u
                    continue
                x, y = u, new
                while x != y:
                    if rank[x] < rank[y]:
                        x = idom[x]
                    else:
                        y = idom[y]
                new = x
            if idom.get(v) != new:
                idom[v], changed = new, True
    del idom[-1]
    return idom


def edge_weights(graph: Graph, depth: dict[int, int]) -> dict[tuple[int, int], float]:
    """Transition probabilities that favour vertices far from every exit or trap."""
    ends = [v for v, t in graph.items() if not t or t == [v]]
    far = {v: 1 if v in ends or not ends else 1 + max(abs(depth[v] - depth[x]) for x in ends) for v in graph}
    return {(v, w): far[w] / sum(far[x] for x in t) for v, t in graph.items() for w in t}


def lump(graph: Graph, weight: dict[tuple[int, int], float]) -> tuple[list[list[int]], np.ndarray]:
    """The coarsest partition in which all of a block send the same weight to each block, and its transition matrix."""
    block = dict.fromkeys(graph, 0)
    while True:
        sent = {}
        for v, targets in graph.items():
            flow = defaultdict(float)
            for w in targets:
                flow[block[w]] += weight[v, w]
            sent[v] = (block[v], tuple(sorted((b, round(x, 12)) for b, x in flow.items())))
        names = {s: k for k, s in enumerate(sorted(set(sent.values())))}
        new = {v: names[sent[v]] for v in graph}
        if len(names) == len(set(block.values())):
            break
        block = new
    blocks = defaultdict(list)
    for v in sorted(graph):
        blocks[block[v]].append(v)
    ordered = sorted(blocks.values())
    at = {v: k for k, members in enumerate(ordered) for v in members}
    q = np.zeros((len(ordered), len(ordered)))
    for k, members in enumerate(ordered):
        for w in graph[members[0]]:
            q[k, at[w]] += weight[members[0], w]
    return ordered, q


def stationary(q: np.ndarray) -> list[float]:
    """The largest KEPT stationary probabilities, descending and padded with zeros.

    They solve p q = p, of which the last equation gives way to the sum of 1;
    where that has no or many solutions, the shortest of the nearest vectors
    counts.  Six digits are kept.
    """
    system = np.vstack([(q - np.eye(len(q))).T[:-1], np.ones(len(q))])
    right = np.eye(len(q))[-1]
    found = np.round(np.linalg.lstsq(system, right, rcond=None)[0], 6)
    largest = sorted((float(x) + 0.0 for x in found), reverse=True)[:KEPT]  # + 0.0: no negative zero
    return largest + [0.0] * (KEPT - len(largest))


def features(graph: Graph) -> dict:
    """All features of one graph; every vertex is a key of it."""
    events, roots = traverse(graph)
    back = [(v, w) for code, v, w in events if code == BACK and v != w]
    heads, tails = {w for _, w in back}, {v for v, _ in back}
    loops = [v for v, t in graph.items() if v in t]
    depth = depths(graph, events)
    edges = [0, 0, 0, 0]
    for v, targets in graph.items():
        for w in targets:
            gap = depth[w] - depth[v]
            if gap == 1:
                edges[0] += 1
            elif gap > 1:
                edges[1] += 1
            elif gap < 0:
                edges[2 if v in tails and w in heads else 3] += 1
    idom = dominators(graph, roots)
    tree: Graph = {v: [] for v in [-1, *graph]}
    for v, d in idom.items():
        tree[d].append(v)
    weight = edge_weights(graph, depth)
    blocks, q = lump(graph, weight) if graph else ([], np.zeros((0, 0)))
    return {
        "vertex_classification": [len(graph), len(roots), sum(not t for t in graph.values()), sum(t == [v] for v, t in graph.items()), len(loops), len(heads), len(tails)],
        "edge_classification": edges,
        "cfg_signature": octal(events),
        "idt_signature": octal(traverse(tree)[0]),
        "bit_signature": bits(events),
        "markov_lumping": stationary(q) if graph else [0.0] * KEPT,
        "depth": depth,
        "idom": idom,
        "weight": weight,
        "blocks": blocks,
    }


FEATURES = {
    "vertex_classification": pa.list_(pa.int32()),
    "edge_classification": pa.list_(pa.int32()),
    "cfg_signature": pa.string(),
    "idt_signature": pa.string(),
    "bit_signature": pa.string(),
    "markov_lumping": pa.list_(pa.float64()),
}
VERTICES = pa.list_(pa.struct([("vertex", pa.int64()), ("depth", pa.int32()), ("idom", pa.int64()), ("block", pa.int64())]))
WEIGHTS = pa.list_(pa.struct([("src", pa.int64()), ("dst", pa.int64()), ("weight", pa.float64())]))


def _graph(src: list, dst: list) -> Graph:
    graph: dict[int, set[int]] = {v: set() for v in src if v is not None}
    for v, w in zip(src, dst, strict=True):
        if v is not None and w is not None:
            graph.setdefault(w, set())
            graph[v].add(w)
    return {v: sorted(t) for v, t in graph.items()}


def _passes(edges: DataFrame, keys: list[str], kinds: dict[str, pa.DataType], schema: str, rows) -> DataFrame:
    """keys and the columns that rows(graph) gives for each graph.  One graph fits in a task; graphs are spread by key."""
    packed = edges.select(*keys, F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst")).distinct()
    packed = packed.groupBy(*keys).agg(F.collect_list(F.struct("src", "dst")).alias("_edges"))
    names = [f"`{k}` {edges.schema[k].dataType.simpleString()}" for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_edges")
            ends = lists.offsets.to_pylist()
            src, dst = (lists.values.field(k).to_pylist() for k in ("src", "dst"))
            found = [rows(_graph(src[a:b], dst[a:b])) for a, b in zip(ends, ends[1:])]  # noqa: B905
            columns = [pa.array([f[name] for f in found], kind) for name, kind in kinds.items()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *columns], [*keys, *kinds])

    return packed.mapInArrow(run, ", ".join([*names, schema]))


def cfg_features(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Per graph (keys): the features of its edges (src, dst); a row with a null dst is a vertex."""
    schema = "vertex_classification array<int>, edge_classification array<int>, cfg_signature string, idt_signature string, bit_signature string, markov_lumping array<double>"
    return _passes(edges, keys, FEATURES, schema, features)


def cfg_details(edges: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(vertices: keys, vertex, depth, idom, block (smallest vertex of the lumped block); edges: keys, src, dst, weight)."""

    def each(graph: Graph) -> dict:
        f = features(graph)
        block = {v: members[0] for members in f["blocks"] for v in members}
        return {
            "vertices": [{"vertex": v, "depth": d, "idom": f["idom"][v], "block": block[v]} for v, d in sorted(f["depth"].items())],
            "weights": [{"src": v, "dst": w, "weight": x} for (v, w), x in sorted(f["weight"].items())],
        }

    schema = "vertices array<struct<vertex: bigint, depth: int, idom: bigint, block: bigint>>, weights array<struct<src: bigint, dst: bigint, weight: double>>"
    found = _passes(edges, keys, {"vertices": VERTICES, "weights": WEIGHTS}, schema, each)
    return tuple(found.select(*keys, F.explode(c).alias("_x")).select(*keys, "_x.*") for c in ("vertices", "weights"))


def vertex_counts(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Per graph, n_all, n_exit, n_trap and n_loop: vertices, those without a way out, those whose only way leads back, those with a way back to themselves."""
    pairs = edges.select(*keys, "src", "dst").where("src IS NOT NULL")
    ends = F.explode(F.array(F.struct(F.col("src").alias("v"), F.col("dst").alias("w")), F.struct(F.col("dst").alias("v"), F.lit(None).cast(edges.schema["dst"].dataType).alias("w"))))
    steps = pairs.select(*keys, ends.alias("e")).select(*keys, "e.v", "e.w").where("v IS NOT NULL").distinct()
    per = steps.groupBy(*keys, "v").agg(F.count("w").alias("out"), F.max(F.coalesce(F.col("v") == F.col("w"), F.lit(False))).alias("loop"))
    count = lambda c: F.count_if(c).cast("int")
    return per.groupBy(*keys).agg(F.count("*").cast("int").alias("n_all"), count(F.col("out") == 0).alias("n_exit"), count((F.col("out") == 1) & F.col("loop")).alias("n_trap"), count(F.col("loop")).alias("n_loop"))
