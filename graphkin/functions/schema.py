"""Feature schemas: ordered, fixed-size columns with a distance and an aggregation each."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import distance


@dataclass(frozen=True)
class FeatureSpec:
    """One feature.  metric: point (a number), euclid (an array) or hamming (60-bit limbs, low first); summed: whether a cluster adds it up.

    Own callbacks take the place of the metric's: ``measure`` gives the distance
    of two columns, ``among`` (for assignment) those of a value to each of a list
    of values, as an array, and ``collect`` a group's aggregate of a column.
    """

    name: str
    size: int
    metric: str
    summed: bool = True
    kind: str = "int"
    measure: Callable[[Column, Column], Column] | None = None
    among: Callable[[Any, list], np.ndarray] | None = None
    collect: Callable[[Column], Column] | None = None

    @property
    def is_array(self) -> bool:
        return self.metric != "point"

    def data_type(self) -> T.DataType:
        base = {"int": T.IntegerType(), "double": T.DoubleType(), "limbs": T.LongType()}[self.kind]
        return T.ArrayType(base) if self.is_array else base

    def distance(self, a: Column, b: Column) -> Column:
        if self.measure:
            return self.measure(a, b)
        return {"point": distance.point, "euclid": distance.euclid, "hamming": distance.hamming}[self.metric](a, b)

    def zero(self) -> Column:
        if self.metric == "hamming":
            return F.array().cast("array<bigint>")
        value = F.lit(0).cast("double" if self.kind == "double" else "int")
        return F.array_repeat(value, self.size) if self.is_array else value


@dataclass(frozen=True)
class FeatureVector:
    """An ordered list of features."""

    features: tuple[FeatureSpec, ...]

    def __len__(self) -> int:
        return len(self.features)

    def __getitem__(self, key: int | str) -> FeatureSpec:
        if isinstance(key, int):
            return self.features[key]
        for f in self.features:
            if f.name == key:
                return f
        raise KeyError(key)

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.features]

    @property
    def slots(self) -> int:
        return sum(f.size for f in self.features)

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.data_type()) for f in self.features])

    def check(self, df: DataFrame) -> None:
        """Raise where df lacks a feature or has it in another type."""
        have = {f.name: f.dataType for f in df.schema}
        for f in self.features:
            got = have.get(f.name)
            if got is None:
                raise ValueError(f"no column {f.name}")
            if isinstance(got, T.ArrayType) != f.is_array:
                raise ValueError(f"column {f.name} is {got.simpleString()}")

    def distance(self, a: str, b: str) -> Column:
        """The mean of the features' distances between the struct columns a and b."""
        parts = [f.distance(F.col(f"{a}.{f.name}"), F.col(f"{b}.{f.name}")) for f in self.features]
        total = parts[0]
        for p in parts[1:]:
            total = total + p
        return total / len(parts)

    def pack(self, name: str) -> Column:
        return F.struct(*self.names).alias(name)

    def flatten(self) -> Column:
        """One array of doubles of all slots that are plain numbers; signatures are left out, as they have no bound."""
        parts = [(F.col(f.name) if f.is_array else F.array(f.name)).cast("array<double>") for f in self.features if f.metric != "hamming"]
        return F.concat(*parts)

    def unflatten(self, flat: Column) -> list[Column]:
        """The columns of the features that flatten() keeps."""
        out, at = [], 1
        for f in self.features:
            if f.metric == "hamming":
                continue
            part = F.slice(flat, at, f.size)
            out.append((part.cast(f.data_type()) if f.is_array else F.get(part, F.lit(0)).cast(f.data_type())).alias(f.name))
            at += f.size
        return out


FUNCTION_FEATURES = FeatureVector(
    (
        FeatureSpec("function_type", 1, "point"),
        FeatureSpec("vertex_classification", 7, "euclid"),
        FeatureSpec("edge_classification", 4, "euclid"),
        FeatureSpec("in_degree", 2, "euclid"),
        FeatureSpec("out_degree", 1, "point"),
        FeatureSpec("cfg_signature", 1, "hamming", summed=False, kind="limbs"),
        FeatureSpec("idt_signature", 1, "hamming", summed=False, kind="limbs"),
        FeatureSpec("insn_bow", 54, "euclid"),
        FeatureSpec("string_bow", 256, "euclid"),
        FeatureSpec("markov_lumping", 64, "euclid", kind="double"),
    )
)
#: members, in and out degree of the members one level below, in and out degree of the cluster
CLUSTER_FEATURES = FeatureVector(tuple(FeatureSpec(f"c{k}", 1, "point") for k in range(1, 6)) + FUNCTION_FEATURES.features)
