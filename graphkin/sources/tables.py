"""Datasets in Parquet: functions, their graph, and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schema import FUNCTION_FEATURES


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(functions, call edges) of an exported dataset."""
    rows = spark.read.parquet(f"{path}/functions")
    FUNCTION_FEATURES.check(rows)
    return rows.select("pk", "name", *FUNCTION_FEATURES.names), spark.read.parquet(f"{path}/edges")


def export(functions: DataFrame, edges: DataFrame, path: str) -> None:
    """Write a dataset, ranges of keys together so that crops read few files."""
    FUNCTION_FEATURES.check(functions)
    functions.select("pk", "name", *FUNCTION_FEATURES.names).repartitionByRange("pk").write.mode("overwrite").parquet(f"{path}/functions")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def save(matches: DataFrame, unmatched_lhs: DataFrame, unmatched_rhs: DataFrame, path: str) -> None:
    matches.write.mode("overwrite").parquet(f"{path}/matched")
    unmatched_lhs.select("pk", "name").write.mode("overwrite").parquet(f"{path}/unmatched1")
    unmatched_rhs.select("pk", "name").write.mode("overwrite").parquet(f"{path}/unmatched2")


#: the tables that ``assemble`` takes
RAW = ("cfg", "names", "calls", "insns", "strings", "xrefs", "types")


def export_raw(spark: SparkSession, source: str, path: str) -> None:
    """Write the dataset of the tables that a disassembler left in a folder."""
    raw = {name: spark.read.parquet(f"{source}/{name}") for name in RAW}
    export(assemble(**raw), raw["calls"].select("src", "dst").distinct(), path)


def load_groups(spark: SparkSession, path: str, method: str) -> DataFrame:
    """(pk, grp): the groups that a recovery method left beside a dataset."""
    return spark.read.parquet(f"{path}/{method}").select("pk", "grp")


def assemble(cfg: DataFrame, names: DataFrame, calls: DataFrame, insns: DataFrame, strings: DataFrame, xrefs: DataFrame, types: DataFrame) -> DataFrame:
    """functions from the tables that a disassembler gives, every row by pk.

    cfg(pk, src, dst), names(pk, name), calls(src, dst), insns(pk, mask),
    strings(pk, text), xrefs(pk, code, data), types(pk, is_import, is_export).
    """
    from ..functions import bags, cfg as graphs, distance

    shape = graphs.cfg_features(cfg, ["pk"])
    out = calls.distinct().groupBy(F.col("src").alias("pk")).agg(F.count("*").cast("int").alias("out_degree"))
    kind = F.when(F.col("is_import"), 1).when(F.col("is_export"), 2).otherwise(0)
    rows = names.join(types.select("pk", kind.alias("function_type")), "pk", "left").join(shape, "pk", "left").join(out, "pk", "left")
    rows = rows.join(xrefs.select("pk", F.array(F.col("code").cast("int"), F.col("data").cast("int")).alias("in_degree")), "pk", "left")
    rows = rows.join(bags.insn_bow(insns, ["pk"], "mask"), "pk", "left").join(bags.string_bow(strings, ["pk"], "text"), "pk", "left")
    for f in FUNCTION_FEATURES.features:
        value = distance.limbs(F.coalesce(F.col(f.name), F.lit(""))) if f.metric == "hamming" else F.coalesce(F.col(f.name), f.zero())
        rows = rows.withColumn(f.name, value)
    return rows.select("pk", "name", *FUNCTION_FEATURES.names)
