"""Relational operators on a dataset: rows (pk, name, features) and its graph's edges (src, dst, weight)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def select_equal(rows: DataFrame, column: str, value: object) -> DataFrame:
    """Rows whose scalar column has the value."""
    return rows.where(F.col(column) == F.lit(value))


def crop(rows: DataFrame, low: object, high: object, pk: str = "pk") -> DataFrame:
    """Rows of the open interval (low, high) of keys."""
    return rows.where((F.col(pk) > F.lit(low)) & (F.col(pk) < F.lit(high)))


def semi(rows: DataFrame, keys: DataFrame, pk: str = "pk") -> DataFrame:
    """Rows whose key is among the keys (a column of the same name)."""
    return rows.join(keys.select(pk), pk, "left_semi")


def anti(rows: DataFrame, keys: DataFrame, pk: str = "pk") -> DataFrame:
    """Rows whose key isn't among the keys: the rest after deleting them."""
    return rows.join(keys.select(pk), pk, "left_anti")


def lookup(rows: DataFrame, key: object, pk: str = "pk") -> DataFrame:
    return rows.where(F.col(pk) == F.lit(key))


def insert(rows: DataFrame, more: DataFrame) -> DataFrame:
    return rows.unionByName(more)


def successors(rows: DataFrame, edges: DataFrame, vertex: object | Column, pk: str = "pk") -> DataFrame:
    """Rows that the vertex has an edge to."""
    return semi(rows, edges.where(F.col("src") == vertex).select(F.col("dst").alias(pk)), pk)


def predecessors(rows: DataFrame, edges: DataFrame, vertex: object | Column, pk: str = "pk") -> DataFrame:
    """Rows that have an edge to the vertex."""
    return semi(rows, edges.where(F.col("dst") == vertex).select(F.col("src").alias(pk)), pk)
