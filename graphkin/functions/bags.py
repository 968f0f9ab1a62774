"""Bags of characters and of instruction classes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLASSES = 54
BINS = 256


def is_ascii(text: Column) -> Column:
    return text.rlike(r"\A[\x00-\x7F]*\z")


def _dense(counts: DataFrame, keys: list[str], code: str, n: str, size: int, name: str) -> DataFrame:
    """An array of size counts for each group of the rows (keys, code, n)."""
    pairs = F.map_from_entries(F.collect_list(F.struct(F.col(code).cast("int"), F.col(n).cast("int"))))
    return counts.groupBy(*keys).agg(pairs.alias("m")).select(*keys, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0))).alias(name))


def char_counts(strings: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, code, n): characters of the strings that are ASCII as a whole."""
    chars = strings.where(is_ascii(F.col(text))).select(*keys, F.explode(F.split(text, "")).alias("ch")).where("ch <> ''")
    return chars.groupBy(*keys, F.ascii("ch").alias("code")).agg(F.count("*").alias("n"))


def string_bow(strings: DataFrame, keys: list[str], text: str) -> DataFrame:
    """string_bow for each group with any string; zero where none is ASCII."""
    some = _dense(char_counts(strings, keys, text), keys, "code", "n", BINS, "string_bow")
    zero = F.array_repeat(F.lit(0), BINS)
    return strings.select(*keys).distinct().join(some, keys, "left").select(*keys, F.coalesce("string_bow", zero).alias("string_bow"))


def text_bow(rows: DataFrame, text: str, name: str = "string_bow") -> DataFrame:
    """rows with the bag of one string each, by one pass over its bytes and without a shuffle; zero where it is null or not ASCII."""

    def count(column: pa.Array) -> np.ndarray:
        column = column.cast(pa.large_string()).fill_null("")
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        out = np.zeros((len(column), BINS), np.int64)
        for k, at in enumerate(offsets[:-1]):
            out[k] = np.bincount(raw[at : offsets[k + 1]], minlength=BINS)
        out[out[:, 128:].any(axis=1)] = 0
        return out.astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                bags = pa.FixedSizeListArray.from_arrays(pa.array(count(part.column(text)).ravel()), BINS)
                yield pa.RecordBatch.from_arrays([*part.columns, bags.cast(pa.list_(pa.int32()))], [*part.schema.names, name])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, `{name}` array<int>")


def insn_bow(insns: DataFrame, keys: list[str], mask: str) -> DataFrame:
    """Counts of the 54 classes of each group; mask has a bit for each class of an instruction."""
    bits = [F.sum(F.shiftright(F.col(mask), k).bitwiseAND(F.lit(1))).cast("int") for k in range(CLASSES)]
    return insns.groupBy(*keys).agg(F.array(*bits).alias("insn_bow"))
