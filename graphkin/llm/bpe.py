"""Byte-level BPE encoding and decoding, equal to the tokenizer file's own library.

Ordinary texts are encoded whole.  A text of more than ``leaf`` characters is a
row for each leaf, encoded in parallel on any executor; neighbouring halves are
then joined as a tree.  A join re-encodes a window of tokens around it and
doubles the window until its outer ``AGREE`` tokens on both sides are those that
the halves had: a token sequence is the encoding of its bytes exactly if each
pair of neighbours is one, and every pair of the result lies in a half or in
the window.  If they never agree the window grows to both halves whole, which
is exact as well.  Strings of special tokens are cut out first, as the library
does, and leaves never cut one.

Long texts are known by their SHA-256, so equal ones are encoded once.

Defined cases: a null text is empty and has no tokens; decoding no tokens gives
an empty text; ids outside the vocabulary are an error; rows, repeated ones
included, come back one for one with all their columns (columns named like the
results are replaced).  A file whose merges, splitter or normaliser are not the
byte-level ones that this codec implements is refused.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fields

LEAF = 1 << 16
AGREE = 4
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _check(spec: dict) -> None:
    """Raise unless merges come in the order of the ids they make and texts are split and joined as this codec does."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        raise ValueError("not a plain byte-pair model")
    if spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or (spec.get("decoder") or {}).get("type") != "ByteLevel":
        raise ValueError("texts are not split and joined by the plain byte-level rule")
    if any(x.get("single_word") or x.get("lstrip") or x.get("rstrip") for x in spec["added_tokens"]):
        raise ValueError("added tokens with conditions on their neighbours")
    made = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    if None in made or any(a >= b for a, b in zip(made, made[1:])):  # noqa: B905
        raise ValueError("merges are not in the order of their ids")
    single = [i for token, i in model["vocab"].items() if len(token) == 1]
    if len(made) + len(single) + sum(x["content"] in model["vocab"] for x in spec["added_tokens"]) != len(model["vocab"]) or made and max(single) > made[0]:
        raise ValueError("tokens that no merge makes")


class Codec:
    """A byte-level BPE vocabulary file (tokenizer JSON)."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _check(spec)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        alphabet = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(printable))}
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(alphabet[ch] for ch in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.special = special
        self.size = 1 + max([*ranks.values(), *special.values()])
        self.bytes_of = [b""] * self.size
        for token, i in ranks.items():
            self.bytes_of[i] = token
        for token, i in special.items():
            self.bytes_of[i] = token.encode()
        self._bpe = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def plain(self, text: str) -> np.ndarray:
        return self._bpe.encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype(np.int32) if text else np.zeros(0, np.int32)

    def segments(self, text: str) -> list[tuple[str, int]]:
        """(ordinary text, id of the special token after it or -1)."""
        out = [(text, -1)]
        for token, i in self.special.items():
            if token in text:
                cut = []
                for part, after in out:
                    pieces = part.split(token)
                    cut += [(p, i) for p in pieces[:-1]] + [(pieces[-1], after)]
                out = cut
        return out

    def encode(self, text: str) -> np.ndarray:
        parts = []
        for part, after in self.segments(text):
            parts.append(self.plain(part))
            if after >= 0:
                parts.append(np.array([after], np.int32))
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The encoding of two ordinary texts' concatenation from their own encodings."""
        if not len(left) or not len(right):
            return np.concatenate([left, right])
        i = j = 16
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            while i < len(left) and self._continues(left[-i]):
                i += 1
            while j < len(right) and self._continues(right[j]):
                j += 1
            raw = self.raw(np.concatenate([left[len(left) - i :], right[:j]]))
            new = self.plain(raw.decode("utf-8"))
            a = i == len(left) or len(new) >= 2 * AGREE and np.array_equal(new[:AGREE], left[len(left) - i :][:AGREE])
            b = j == len(right) or len(new) >= 2 * AGREE and np.array_equal(new[-AGREE:], right[:j][-AGREE:])
            if a and b:
                return np.concatenate([left[: len(left) - i], new, right[j:]])
            i, j = i if a else 2 * i, j if b else 2 * j

    def _continues(self, token: int) -> bool:
        first = self.bytes_of[token][:1]
        return bool(first) and 0x80 <= first[0] < 0xC0

    def tree(self, parts: list[np.ndarray]) -> np.ndarray:
        """Neighbours are joined level by level."""
        while len(parts) > 1:
            parts = [self.join(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0] if parts else np.zeros(0, np.int32)

    def raw(self, ids) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def decode(self, ids) -> str:
        return self.raw(ids).decode("utf-8", "replace")


@lru_cache(4)
def codec(path: str) -> Codec:
    return Codec(path)


def _fields(df: DataFrame) -> str:
    return fields(df.schema)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    first = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=first[1:])
    return pa.ListArray.from_arrays(pa.array(first), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32)))


def _slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about so many bytes, so that no result outgrows memory."""
    rows = max(1, int(batch.num_rows * most // max(1, batch.column(column).nbytes)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def encode(docs: DataFrame, path: str, *, text: str = "text", leaf: int = LEAF) -> DataFrame:
    """docs with ids (array<int>)."""
    kept = docs.drop(*(c for c in docs.columns if c.lower() == "ids" and c != text))
    schema = f"{_fields(kept)}, ids array<int>"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            for part in _slices(batch, text):
                ids = [bpe.encode(t or "") for t in part.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, _lists(ids)], [*part.schema.names, "ids"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            for key, t in zip(batch.column("_key").to_pylist(), batch.column("_text").to_pylist(), strict=True):
                for k, (part, after) in enumerate(bpe.segments(t)):
                    for at in range(0, max(1, len(part)), leaf):
                        last = at + leaf >= len(part)
                        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([k], pa.int32()), pa.array([at // leaf], pa.int32()), pa.array([part[at : at + leaf]]), pa.array([after if last else -1], pa.int32())], ["_key", "_segment", "_leaf", "_text", "_after"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            ids = _lists([bpe.plain(t) for t in batch.column("_text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_segment"), batch.column("_leaf"), batch.column("_after"), ids], ["_key", "_segment", "_leaf", "_after", "ids"])

    def joined(table: pa.Table) -> pa.Table:
        bpe, table = codec(path), table.sort_by([("_segment", "ascending"), ("_leaf", "ascending")]).combine_chunks()
        segment, after = table["_segment"].to_pylist(), table["_after"].to_pylist()
        lists = [x.values.to_numpy() for x in table["ids"]]
        out, run = [], []
        for k, ids in enumerate(lists):
            run.append(ids)
            if k + 1 == len(lists) or segment[k + 1] != segment[k]:
                out.append(bpe.tree(run))
                run = []
                if after[k] >= 0:
                    out.append(np.array([after[k]], np.int32))
        return pa.table({"_key": table["_key"][:1], "ids": _lists([np.concatenate(out)])})

    is_long = F.coalesce(F.length(text) > leaf, F.lit(False))
    short = kept.where(~is_long).mapInArrow(whole, schema)
    long = kept.where(is_long).select(F.sha2(F.col(text).cast("binary"), 256).alias("_key"), F.struct(*(F.col(f"`{c}`") for c in kept.columns)).alias("_row"))
    texts = long.select("_key", F.col(f"_row.`{text}`").alias("_text"))
    pieces = texts.mapInArrow(leaves, "_key string, _segment int, _leaf int, _text string, _after int")
    # the same piece of equal texts is encoded once
    pieces = pieces.repartition("_key", "_segment", "_leaf").dropDuplicates(["_key", "_segment", "_leaf"])
    ids = pieces.mapInArrow(each, "_key string, _segment int, _leaf int, _after int, ids array<int>")
    ids = ids.groupBy("_key").applyInArrow(joined, "_key string, ids array<int>")
    return short.unionByName(long.join(ids, "_key").select(*(F.col(f"_row.`{c}`").alias(c) for c in kept.columns), "ids"))


def decode(encoded: DataFrame, path: str, *, ids: str = "ids") -> DataFrame:
    """encoded with decoded (string)."""
    kept = encoded.drop(*(c for c in encoded.columns if c.lower() == "decoded" and c != ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            for part in _slices(batch, ids):
                column = part.column(ids)
                out = [bpe.decode(x.values.to_numpy(zero_copy_only=False).tolist()) if x.is_valid else "" for x in column]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], [*part.schema.names, "decoded"])

    return kept.mapInArrow(run, f"{_fields(kept)}, decoded string")


def digest(encoded: DataFrame, *, ids: str = "ids") -> DataFrame:
    """encoded with n_tokens and ids_sha256: of the ids as little-endian unsigned 32-bit integers."""
    import hashlib

    kept = encoded.drop("n_tokens", "ids_sha256")
    rest = kept.drop(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            lists = [x.values.to_numpy(zero_copy_only=False).astype("<u4") if x.is_valid else np.zeros(0, "<u4") for x in column]
            keep = [k for k, name in enumerate(batch.schema.names) if name != ids]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keep), pa.array([len(x) for x in lists], pa.int64()), pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in lists], pa.string())],
                [*(batch.schema.names[k] for k in keep), "n_tokens", "ids_sha256"],
            )

    return kept.mapInArrow(run, f"{_fields(rest)}, n_tokens bigint, ids_sha256 string")
