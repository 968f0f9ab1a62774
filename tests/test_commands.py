"""The two commands, from raw tables to written results."""

import logging

import pytest
from pyspark.sql import functions as F

from graphkin import __main__ as match
from graphkin import export
from graphkin.functions.schema import FUNCTION_FEATURES
from graphkin.sources import tables


def raw(spark, path, shift, hidden=()):
    """A program of 12 functions, each a chain of blocks with a loop; keys are shifted."""
    keys = [shift + 16 * k for k in range(12)]
    rows = {
        "cfg": [(pk, v, v + 1 if v < k else None) for k, pk in enumerate(keys) for v in range(k + 1)] + [(pk, 1, 0) for pk in keys[3:]],
        "names": [(pk, f"sub_{pk}" if k in hidden else f"f{k}") for k, pk in enumerate(keys)],
        "calls": [(keys[k], keys[(5 * k + 1) % 12]) for k in range(12)] + [(keys[k], keys[k // 2]) for k in range(1, 12)],
        "insns": [(pk, 1 << (k + j) % 54) for k, pk in enumerate(keys) for j in range(3)],
        "strings": [(pk, "text" * (k % 3)) for k, pk in enumerate(keys) if k % 2],
        "xrefs": [(pk, k % 4, k % 3) for k, pk in enumerate(keys)],
        "types": [(pk, k == 0, k == 1) for k, pk in enumerate(keys)],
    }
    kinds = {"cfg": "pk bigint, src bigint, dst bigint", "names": "pk bigint, name string", "calls": "src bigint, dst bigint", "insns": "pk bigint, mask bigint", "strings": "pk bigint, text string", "xrefs": "pk bigint, code int, data int", "types": "pk bigint, is_import boolean, is_export boolean"}
    for name, kind in kinds.items():
        spark.createDataFrame(rows[name], kind).write.parquet(f"{path}/{name}")
    return keys


@pytest.fixture
def sets(spark, cut, tmp_path):
    keys = []
    for side, shift, hidden in (("a", 1000, ()), ("b", 5000, (4, 7, 9))):
        keys.append(raw(spark, f"{tmp_path}/{side}-raw", shift, hidden))
        assert export.main([f"{tmp_path}/{side}-raw", f"{tmp_path}/{side}"]) == 0
        groups = [(pk, k // 4) for k, pk in enumerate(keys[-1])]
        spark.createDataFrame(groups, "pk bigint, grp int").write.parquet(f"{tmp_path}/{side}/recover-apsnse")
    return tmp_path, keys


def test_export_and_load(spark, sets):
    folder, (keys, _) = sets
    rows, edges = tables.load(spark, f"{folder}/a")
    got = {r["pk"]: r for r in rows.collect()}
    assert sorted(got) == keys and edges.count() == 22  # f5 calls f2 by two calls
    f = got[keys[5]]
    assert (f["name"], f["function_type"], list(f["in_degree"]), f["out_degree"]) == ("f5", 0, [1, 2], 1)
    assert f["vertex_classification"][0] == 6 and sum(f["insn_bow"]) == 3 and f["string_bow"][ord("t")] == 4
    assert [got[k]["function_type"] for k in keys[:3]] == [1, 2, 0]
    with pytest.raises(ValueError):
        tables.export(rows.drop("insn_bow"), edges, f"{folder}/bad")
    assert FUNCTION_FEATURES.slots == 391


@pytest.mark.parametrize("options", [["-n", "-m"], ["-n", "-x"], ["-n", "-l", "recover-apsnse", "-x"]])
def test_match(spark, sets, options, capsys, monkeypatch):
    folder, (a, b) = sets
    monkeypatch.chdir(folder)
    assert match.main([f"{folder}/a", f"{folder}/b", f"{folder}/out", "-d", *options]) == 0
    log = logging.getLogger("graphkin")
    log.setLevel(logging.WARNING)
    log.removeHandler(log.handlers[-1])
    found = {r["lhs_pk"]: r["rhs_pk"] for r in spark.read.parquet(f"{folder}/out/matched").collect()}
    right = dict(zip(a, b, strict=True))
    assert all(found[x] == right[x] for k, x in enumerate(a) if k not in (4, 7, 9)) and len(set(found.values())) == len(found)
    left = {r["pk"] for r in spark.read.parquet(f"{folder}/out/unmatched1").collect()}
    assert left == set(a) - set(found) and spark.read.parquet(f"{folder}/out/unmatched2").count() == len(left)
    if "-x" not in options:
        assert found == right
    said = capsys.readouterr().out
    assert "n_match" in said and ("exact_singleton" in said) == ("-m" in options)
    assert (folder / "debug.log").read_text().startswith("import: 1\nname: 8\n")


def test_recovered_groups_are_read_beside_the_dataset(spark, sets):
    folder, (a, _) = sets
    assert tables.load_groups(spark, f"{folder}/a", "recover-apsnse").where(F.col("grp") == 0).count() == 4
    assert set(match.RECOVERED) <= set(next(x for x in match.arguments()._actions if x.dest == "match_hierarchical").choices)
