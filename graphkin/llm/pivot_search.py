"""Exact top-k search by inner product with pivot-table elimination.

Vectors are integers, floor(scale * x).  The table holds, for each row, what its
distances to the pivots and to the origin determine: d(x, p)^2 = |x|^2 + |p|^2 -
2 <x, p>, so they fix its coordinates c in the span of the pivots and its height
h over that span.  Of all points with these distances none is nearer to a query
(C, H) than ((C - c)^2 + (H - h)^2)^0.5; as inner products are fixed by distances
and norms, no score is above <C, c> + H h.  This is the greatest bound that the
table allows; it covers what the triangle inequality gives with single pivots.
A query's candidates are scored in the order of the bound, until it falls below
the k-th best score: the rest can't enter.  The k-th best is kept from one batch
of a task to the next.

Pivots are data rows of a bounded sample (``SAMPLE`` rows, by a hash of the id),
each the farthest from the span of those before; any choice gives exact results.
The table is written once.  Queries are taken in blocks of ``QUERY_BLOCK``, one
after the other, and only the block at hand is sent to tasks; every block meets
every partition of candidates in place, so candidates are never shuffled.  Each
task returns k rows for each query, and a window keeps the best k of those.
``evaluated`` counts the rows of which a query computed the score.

Defined cases: vectors that are null, or hold null or non-finite components,
take no part, nor do rows without an id; vectors of another length than the
query's are no candidates for it; a vector of no components scores 0; equal
scores go by id; repeated rows are candidates and queries of their own, and only
the query's own row is none; other columns are ignored.  Components have to stay
below 2**24 / scale.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint

PIVOTS = 64
SAMPLE = 512
QUERY_BLOCK = 4096
QUERIES = 64  # whose bounds are one matrix
CANDIDATES = 8192  # held as one matrix at a time
SLACK = 1e-6  # of the product of norms: covers the rounding of the table, which is in single precision


def quantize(vectors: DataFrame, *, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """id, v (array<int>) of the vectors that take part."""
    x = F.col("x").cast("array<double>")
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    df = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("x")).where(F.col("id").isNotNull() & F.col("x").isNotNull()).select("id", x.alias("x"))
    return df.where(~bad).select("id", F.transform("x", lambda c: F.floor(c * scale).cast("int")).alias("v"))


def _matrix(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: (rows, matrix)."""
    offsets = column.offsets.to_numpy()
    flat, size = column.values.to_numpy(zero_copy_only=False), np.diff(offsets)
    out = {}
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        out[int(d)] = rows, flat[offsets[rows][:, None] + np.arange(d)].astype(np.float64)
    return out


def frame(sample: np.ndarray, pivots: int) -> np.ndarray:
    """[d, pivots]: an orthonormal frame of the span of the rows that are farthest from the span of those before."""
    rest, out = sample.copy(), []
    floor = 1e-9 * max(1.0, (sample * sample).sum(axis=1).max(initial=0.0))
    while len(out) < min(pivots, sample.shape[1]):
        height = (rest * rest).sum(axis=1)
        if height.max(initial=0.0) <= floor:
            break
        axis = rest[int(height.argmax())].copy()
        for e in out:  # again, for rounding
            axis -= e * (axis @ e)
        axis /= np.sqrt(axis @ axis)
        out.append(axis)
        rest -= np.outer(rest @ axis, axis)
    return np.array(out).T if out else np.zeros((sample.shape[1], 0))


def coordinates(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """[rows, pivots + 1]: the place in the span of the pivots and the height over it."""
    c = x @ axes
    return np.concatenate([c, np.sqrt(np.maximum((x * x).sum(axis=1) - (c * c).sum(axis=1), 0))[:, None]], axis=1)


class Search:
    """The queries of one length, and the best k of each that a task has found."""

    def __init__(self, rows: np.ndarray, x: np.ndarray, axes: np.ndarray, k: int) -> None:
        self.rows, self.x, self.k = rows, x, k
        self.table, self.norm = coordinates(x, axes), np.sqrt((x * x).sum(axis=1))
        self.scores, self.ids, self.keys = np.full((len(x), k), -np.inf), np.zeros((len(x), k), np.int64), np.full((len(x), k), -1, np.int64)
        self.evaluated = np.zeros(len(x), np.int64)

    def add(self, x: np.ndarray, table: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> None:
        norm = np.sqrt((x * x).sum(axis=1))
        for lo in range(0, len(self.x), QUERIES):
            upper = self.table[lo : lo + QUERIES] @ table.T
            upper += SLACK * self.norm[lo : lo + QUERIES, None] * norm[None, :] + SLACK
            for q, bound in enumerate(upper, lo):
                self._one(q, bound, x, ids, keys)

    def _one(self, q: int, bound: np.ndarray, x: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> None:
        left, step = np.flatnonzero(bound >= self.scores[q, -1]), 4 * self.k
        while len(left):
            if len(left) > step:  # the next by the bound
                cut = np.argpartition(-bound[left], step)
                part, left = left[cut[:step]], left[cut[step:]]
            else:
                part, left = left, left[:0]
            part = part[keys[part] != self.rows[q]]
            self.evaluated[q] += len(part)
            scores = np.concatenate([self.scores[q], x[part] @ self.x[q]])
            new_ids, new_keys = np.concatenate([self.ids[q], ids[part]]), np.concatenate([self.keys[q], keys[part]])
            best = np.lexsort((new_keys, new_ids, -scores))[: self.k]
            self.scores[q], self.ids[q], self.keys[q] = scores[best], new_ids[best], new_keys[best]
            left, step = left[bound[left] >= self.scores[q, -1]], step * 4

    def found(self) -> pa.RecordBatch:
        q, k = np.nonzero(self.keys >= 0)
        none = np.flatnonzero(~(self.keys >= 0).any(axis=1))  # their count only
        count = np.where(k == 0, self.evaluated[q], 0)
        pad = np.zeros(len(none), np.int64)
        columns = [np.r_[self.rows[q], self.rows[none]], np.r_[self.keys[q, k], pad - 1], np.r_[self.ids[q, k], pad], np.r_[self.scores[q, k].astype(np.int64), pad], np.r_[count, self.evaluated[none]]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query", "row", "id", "score", "evaluated"])


def top_k(vectors: DataFrame, is_query, *, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank (from 1), id_col, score and evaluated of the best k for every row where is_query (a Column over ``id``) holds."""
    spark, candidates = vectors.sparkSession, CANDIDATES
    rows = quantize(vectors, id_col=id_col, vec_col=vec_col, scale=scale)
    sample = rows.orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE).toArrow()["v"].combine_chunks()
    axes = {d: frame(x, pivots) for d, (_, x) in _matrix(sample).items()} if len(sample) else {}
    shared_axes = spark.sparkContext.broadcast(axes)

    def tabulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, candidates):
                piece = batch.slice(at, candidates)
                column = pa.concat_arrays([piece.column("v")])
                out: list = [None] * piece.num_rows
                for d, (where, x) in _matrix(column).items():
                    for i, c in zip(where, coordinates(x, shared_axes.value.get(d, np.zeros((d, 0)))).astype(np.float32), strict=True):
                        out[i] = c
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(out, pa.list_(pa.float32()))], [*piece.schema.names, "t"])

    table = rows.withColumn("row", F.monotonically_increasing_id())  # one for each row of the written table
    table = checkpoint(table.mapInArrow(tabulate, "id bigint, v array<int>, row bigint, t array<float>"))
    queries = table.where(is_query).select("row", "id", "v")
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    found = None
    for block in range(blocks):
        mine = queries.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block)
        part = mine.toArrow()  # about QUERY_BLOCK rows
        shared = spark.sparkContext.broadcast((part["row"].to_numpy(), part["v"].combine_chunks()))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            keys, lists = shared.value
            by_size = {d: Search(keys[at], x, shared_axes.value.get(d, np.zeros((d, 0))), k) for d, (at, x) in (_matrix(lists).items() if len(lists) else [])}
            for batch in batches:
                for at in range(0, batch.num_rows, candidates):
                    piece = batch.slice(at, candidates)
                    ids, rows = piece.column("id").to_numpy(), piece.column("row").to_numpy()
                    tables = _matrix(pa.concat_arrays([piece.column("t")]))
                    place = {i: (d, n) for d, (where, _) in tables.items() for n, i in enumerate(where.tolist())}
                    for d, (where, x) in _matrix(pa.concat_arrays([piece.column("v")])).items():
                        if d in by_size and len(where):
                            width = place[int(where[0])][0]
                            by_size[d].add(x, tables[width][1][[place[int(i)][1] for i in where]], ids[where], rows[where])
            for s in by_size.values():
                yield s.found()

        some = table.mapInArrow(run, "query bigint, row bigint, id bigint, score bigint, evaluated bigint")
        own = W.partitionBy("query")
        best = some.withColumns({"rank": F.row_number().over(own.orderBy((F.col("row") < 0), F.desc("score"), "id", "row")), "evaluated": F.sum("evaluated").over(own)})
        best = best.where((F.col("rank") <= k) & (F.col("row") >= 0)).join(F.broadcast(mine.select(F.col("row").alias("query"), F.col("id").alias("query_id"))), "query")
        best = best.select("query_id", "rank", F.col("id").alias(id_col), "score", "evaluated")
        best = checkpoint(best) if blocks > 1 else best  # one block of queries at a time
        found = best if found is None else found.union(best)
        if blocks > 1:
            shared.unpersist()
    return found
