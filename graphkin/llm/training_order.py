"""Token sequences in training order, as binary shards of fixed stride.

Texts are encoded, ended by the end-of-text token and cut into sequences of
``length`` tokens.  Sequence k of the document with id d has the number
``d * width + k``; a keyed Feistel network with cycle-walking permutes the range
of these numbers, so every sequence gets its place without any exchange.  The
range is cut into equal parts, one for each shard; a shard's task sorts its
sequences by place and writes them with a fixed stride.  The manifest's running
sum of the shards' sizes turns place into the global slot 0, 1, 2, ...: reading
can start at any slot with one seek.  The number of shards follows from the bytes
of their records, estimated at ``TOKEN`` bytes of text a token; where a token has
less, shards are larger by that factor.  Shards are written as they come, so
their size takes no memory; a very long text is encoded whole by its task.

Record: id (int64), k (uint32), number of tokens (uint32), ``length`` tokens
(uint16 where the vocabulary allows, else uint32; the rest of the last sequence
is filled with the end-of-text token), all little-endian.

Defined cases: a null or empty text is one sequence of the end token; negative
ids are mapped to natural numbers; ids repeated share numbers, and their
sequences are ordered by k and tokens; a null id counts as the smallest 64-bit
integer and comes back as null; other columns are ignored; no rows give no
shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import codec
from .common import Draft, checkpoint, new_path, shared_dir, store
from .textops import U64, mix

LENGTH = 512
SHARD = 64 << 20
TOKEN = 4
GROUP = 1024  # shards whose records are summed together first
NO_ID = -(1 << 63)
MOST = 1 << 62


def feistel(x: np.ndarray, size: int, key: int, rounds: int = 4) -> np.ndarray:
    """A keyed permutation of 0 .. size - 1 (of at most 2**62), by cycle-walking."""
    half = max(1, -(-max(1, (size - 1).bit_length()) // 2))
    mask = U64((1 << half) - 1)
    keys = mix(np.arange(1, rounds + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(key & 0xFFFFFFFFFFFFFFFF))

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> U64(half), v & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        return left << U64(half) | right

    out = once(x.astype(U64))
    while (far := out >= U64(size)).any():
        out[far] = once(out[far])
    return out


def _natural(ids: np.ndarray, most: int) -> np.ndarray:
    """0, -1, 1, -2, ... as 0, 1, 2, 3, ...; folded where the range is smaller."""
    return ((ids << 1) ^ (ids >> 63)).view(U64) % U64(most)


def materialise(docs: DataFrame, path: str, *, key: int = 0, length: int = LENGTH, id_col: str = "doc_id", text: str = "text", folder: str | None = None, shard_bytes: int = SHARD) -> DataFrame:
    """Write the shards; manifest rows: shard, path, records, stride, length, first_slot."""
    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "tokens")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    bpe = codec(path)
    wide, end = bpe.size > 1 << 16, next(iter(bpe.special.values()), 0)
    kind = np.dtype("<u4" if wide else "<u2")
    stride = 16 + length * kind.itemsize
    each = F.expr(f"octet_length(text) div {TOKEN * length}").cast("long") + 1  # records of a text
    facts = rows.agg(F.max(F.octet_length("text")).alias("longest"), F.sum(each).alias("records"), F.max("id").alias("most"), F.min("id").alias("least")).first()
    longest, total = facts["longest"] or 0, (facts["records"] or 0) * stride
    width = (longest + 1) // length + 1  # a token has a byte at least
    spread = max(2 * (facts["most"] or 0) + 1, -2 * (facts["least"] or 0)) + 1
    spread = min(spread, MOST // width)
    size = spread * width
    shards = max(1, -(-total // shard_bytes))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            step = max(1, int(batch.num_rows * (2 << 20) // max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                own, number, blobs = [], [], []
                for d, t in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    raw = np.append(bpe.encode(t), end).astype(kind).tobytes()
                    for k in range(0, len(raw), length * kind.itemsize):
                        own.append(d)
                        number.append(k // (length * kind.itemsize))
                        blobs.append(raw[k : k + length * kind.itemsize])
                ids, k = np.array(own, np.int64), np.array(number, np.int64)
                place = feistel(_natural(ids, spread) * U64(width) + k.astype(U64), size, key)
                shard = np.minimum((place.astype(np.float64) * (shards / size)).astype(np.int64), shards - 1)
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(place.astype(np.int64)), pa.array(ids), pa.array(k.astype(np.int32)), pa.array(blobs, pa.binary())], ["shard", "place", "id", "k", "tokens"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fill = np.full(length, end, kind).tobytes()
        current, out, count = None, None, 0

        def flush() -> pa.RecordBatch:
            out.done()
            return pa.RecordBatch.from_arrays([pa.array([current], pa.int64()), pa.array([out.uri]), pa.array([count], pa.int64())], ["shard", "path", "records"])

        for batch in batches:
            for shard, d, k, tokens in zip(*(batch.column(c).to_pylist() for c in ("shard", "id", "k", "tokens")), strict=True):
                if shard != current:
                    if out:
                        yield flush()
                    current, out, count = shard, Draft(f"{new_path(folder, f'shard-{shard:08d}')}.bin"), 0
                out.write(np.array([d], "<i8").tobytes() + np.array([k, len(tokens) // kind.itemsize], "<u4").tobytes() + tokens + fill[len(tokens) :])
                count += 1
        if out:
            yield flush()

    sequences = rows.mapInArrow(cut, "shard bigint, place bigint, id bigint, k int, tokens binary")
    ordered = sequences.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "place", "k", "tokens")
    written = checkpoint(ordered.mapInArrow(write, "shard bigint, path string, records bigint"))
    # running sums: within groups of shards, then over the groups' totals
    group = F.expr(f"shard div {GROUP}")
    sums = written.groupBy(group.alias("group")).agg(F.sum("records").alias("n"))
    before = lambda order: order.rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("group", F.coalesce(F.sum("n").over(before(W.orderBy("group"))), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("records").over(before(W.partitionBy("group").orderBy("shard"))), F.lit(0))
    out = written.withColumn("group", group).withColumn("inside", inside).join(sums, "group")
    return checkpoint(out.select("shard", "path", "records", F.lit(stride).alias("stride"), F.lit(length).alias("length"), (F.col("base") + F.col("inside")).alias("first_slot")))


def read_slots(manifest: DataFrame, start: int = 0, stop: int | None = None) -> DataFrame:
    """slot, id, k, n_tokens, tokens (binary) of the slots start .. stop - 1, each shard read from one offset on."""
    wanted = manifest.where(F.col("first_slot") + F.col("records") > start)
    wanted = wanted if stop is None else wanted.where(F.col("first_slot") < stop)
    # a row of the manifest stands for a whole shard
    wanted = wanted.repartition(max(1, min(wanted.count(), int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))), "shard")
    schema = pa.schema([("slot", pa.int64()), ("id", pa.int64()), ("k", pa.int64()), ("n_tokens", pa.int64()), ("tokens", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                lo = max(0, start - r["first_slot"])
                hi = r["records"] if stop is None else min(r["records"], stop - r["first_slot"])
                fs, where = store(r["path"])
                with fs.open_input_file(where) as file:
                    file.seek(lo * r["stride"])
                    for at in range(lo, hi, 4096):
                        n = min(4096, hi - at)
                        raw = np.frombuffer(file.read(n * r["stride"]), np.uint8).reshape(n, r["stride"])
                        ids = np.ascontiguousarray(raw[:, :8]).view("<i8").ravel()
                        meta = np.ascontiguousarray(raw[:, 8:16]).view("<u4")
                        each = (r["stride"] - 16) // r["length"]
                        tokens = [x[16 : 16 + int(m) * each].tobytes() for x, m in zip(raw, meta[:, 1], strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(r["first_slot"] + np.arange(at, at + n)), pa.array(ids, mask=ids == NO_ID), pa.array(meta[:, 0].astype(np.int64)), pa.array(meta[:, 1].astype(np.int64)), pa.array(tokens, pa.binary())], schema=schema)

    return wanted.mapInArrow(run, "slot bigint, id bigint, k bigint, n_tokens bigint, tokens binary")


def digest(slots: DataFrame) -> DataFrame:
    """slot, id, k, n_tokens, tokens_sha256."""
    return slots.select("slot", "id", "k", "n_tokens", F.sha2("tokens", 256).alias("tokens_sha256"))
