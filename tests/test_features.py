import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphkin.functions import bags, cfg, distance
from graphkin.functions.aggregate import vector_sum
from graphkin.functions.schema import CLUSTER_FEATURES, FUNCTION_FEATURES, FeatureSpec, FeatureVector

# name: adjacency, signature (octal), vertex classes, edge classes, depths
GOLDEN = {
    "single": ({0: []}, "5", [1, 1, 1, 0, 0, 0, 0], [0, 0, 0, 0], [0]),
    "chain2": ({0: [1], 1: []}, "155", [2, 1, 1, 0, 0, 0, 0], [1, 0, 0, 0], [0, 1]),
    "self1": ({0: [0]}, "25", [1, 1, 0, 1, 1, 0, 0], [0, 0, 0, 0], [0]),
    "diamond": ({0: [1, 2], 1: [3], 2: [3], 3: []}, "11551355", [4, 1, 1, 0, 0, 0, 0], [4, 0, 0, 0], [0, 1, 1, 2]),
    "loop": ({0: [1], 1: [2, 3], 2: [1], 3: []}, "11251555", [4, 1, 1, 0, 0, 1, 1], [3, 0, 1, 0], [0, 1, 2, 2]),
    "trap": ({0: [0, 1], 1: [1]}, "21255", [2, 1, 0, 1, 2, 0, 0], [1, 0, 0, 0], [0, 1]),
    "skip": ({0: [1, 2], 1: [2], 2: []}, "115535", [3, 1, 1, 0, 0, 0, 0], [2, 1, 0, 0], [0, 1, 2]),
    "twoentry": ({0: [2], 1: [2], 2: []}, "155035", [3, 2, 1, 0, 0, 0, 0], [2, 0, 0, 0], [0, 0, 1]),
}


@pytest.mark.parametrize("name", GOLDEN)
def test_graph_features(name):
    graph, signature, vertices, edges, depth = GOLDEN[name]
    f = cfg.features(graph)
    assert (f["cfg_signature"], f["vertex_classification"], f["edge_classification"], list(f["depth"].values())) == (signature, vertices, edges, depth)
    assert f["markov_lumping"][0] == 1.0 and len(f["markov_lumping"]) == 64


graphs = st.integers(1, 7).flatmap(lambda n: st.lists(st.lists(st.integers(0, n - 1), unique=True, max_size=4), min_size=n, max_size=n).map(lambda t: {v: sorted(x) for v, x in enumerate(t)}))


@settings(max_examples=200, deadline=None)
@given(graphs)
def test_traversal_properties(graph):
    events, roots = cfg.traverse(graph)
    assert len(events) == len(graph) + sum(map(len, graph.values())) + len(roots)
    depth = cfg.depths(graph, events)
    back = {(v, w) for code, v, w in events if code == cfg.BACK}
    assert all(depth[w] >= depth[v] + 1 for v, t in graph.items() for w in t if v != w and (v, w) not in back)
    idom = cfg.dominators(graph, roots)
    for v in graph:  # no path from the start avoids the immediate dominator
        if idom[v] != -1:
            seen, stack = set(), [r for r in roots if r != idom[v]]
            while stack:
                x = stack.pop()
                if x not in seen and x != idom[v]:
                    seen.add(x)
                    stack += graph[x]
            assert v not in seen
    weight = cfg.edge_weights(graph, depth)
    for v, t in graph.items():
        assert not t or abs(sum(weight[v, w] for w in t) - 1) < 1e-9
    blocks, q = cfg.lump(graph, weight)
    at = {v: k for k, b in enumerate(blocks) for v in b}
    for b in blocks:  # all members of a block send the same weight to every block
        rows = [np.bincount([at[w] for w in graph[v]], [weight[v, w] for w in graph[v]], len(blocks)) if graph[v] else np.zeros(len(blocks)) for v in b]
        assert np.allclose(rows, rows[0]) and np.allclose(rows[0], q[at[b[0]]])


def test_cfg_features_of_a_table(spark):
    rows = [(k, v, w) for k, (g, *_) in enumerate(GOLDEN.values()) for v, t in g.items() for w in (t or [None])]
    df = spark.createDataFrame(rows, "pk long, src long, dst long")
    got = {r["pk"]: r["cfg_signature"] for r in cfg.cfg_features(df, ["pk"]).collect()}
    assert [got[k] for k in range(len(GOLDEN))] == [g[1] for g in GOLDEN.values()]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_distances(spark):
    a = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, distance.point(F.lit(0), F.lit(0))) == 0 and one(spark, distance.point(F.lit(0), F.lit(5))) == 1
    assert abs(one(spark, distance.point(F.lit(4), F.lit(5))) - 0.2) < 1e-12
    assert one(spark, distance.euclid(a(3, 4), a(0, 0))) == 1 and one(spark, distance.euclid(a(0, 0), a(0, 0))) == 0
    assert abs(one(spark, distance.euclid(a(1, 0), a(0, 1))) - 2**0.5) < 1e-12
    h = lambda x, y: one(spark, distance.hamming(distance.limbs(F.lit(x)), distance.limbs(F.lit(y))))
    assert abs(h("5", "155") - 3 / 7) < 1e-12 and abs(h("11551355", "115535") - 9 / 22) < 1e-12 and h("5", "5") == 0 and h("", "") == 0


@pytest.mark.parametrize("digits", ["1" * 20, "7" * 45, "12" * 31])
def test_limbs(spark, digits):
    got = one(spark, distance.limbs(F.lit(digits)))
    assert sum(x << (60 * k) for k, x in enumerate(got)) == int(digits, 8)


def test_schema():
    assert len(FUNCTION_FEATURES) == 10 and FUNCTION_FEATURES.slots == 391
    assert len(CLUSTER_FEATURES) == 15 and CLUSTER_FEATURES.slots == 396
    assert FUNCTION_FEATURES["insn_bow"].size == 54 and FUNCTION_FEATURES[0].name == "function_type"
    with pytest.raises(KeyError):
        FUNCTION_FEATURES["none"]


def test_vector_sum_and_flatten(spark):
    v = FeatureVector((FeatureSpec("a", 1, "point"), FeatureSpec("b", 2, "euclid"), FeatureSpec("s", 1, "hamming", summed=False, kind="limbs")))
    df = spark.createDataFrame([(1, 2, [1, 2], [5]), (1, 3, [10, 20], [6])], "k int, a int, b array<int>, s array<bigint>")
    r = vector_sum(df, ["k"], v).first()
    assert (r["a"], r["b"], r["s"]) == (5, [11, 22], [])
    assert df.select(v.flatten().alias("f")).first()["f"] == [2.0, 1.0, 2.0]
    with pytest.raises(ValueError):
        v.check(df.drop("b"))


def test_bags(spark):
    df = spark.createDataFrame([(1, "aab"), (1, "é"), (2, "ü"), (3, ""), (4, "a\nb")], "k int, s string")
    got = {r["k"]: r["string_bow"] for r in bags.string_bow(df, ["k"], "s").collect()}
    assert got[1][97] == 2 and got[1][98] == 1 and sum(got[1]) == 3 and sum(got[2]) == sum(got[3]) == 0 and sum(got[4]) == 3
    direct = bags.text_bow(df, "s", "b").where("s <> 'é'").collect()
    assert all(r["b"] == got[r["k"]] for r in direct)
    insns = spark.createDataFrame([(1, 0b101), (1, 1 << 53), (2, 0)], "k int, m bigint")
    bow = {r["k"]: r["insn_bow"] for r in bags.insn_bow(insns, ["k"], "m").collect()}
    assert bow[1][0] == bow[1][2] == bow[1][53] == 1 and sum(bow[1]) == 3 and sum(bow[2]) == 0
