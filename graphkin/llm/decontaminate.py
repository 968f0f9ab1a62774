"""Benchmark decontamination by SimHash of item-sized windows.

Every window of a document that has as many words as a benchmark item gets a
64-bit SimHash of its weighted n-word shingles, from prefix sums over the
document.  Items of that size are looked up by ``BLOCKS`` blocks of their
fingerprints: a distance of at most ``RADIUS`` means that some block differs in
two bits at most, so looking up each block within two bits finds every
fingerprint within the radius, and one random item in 120 besides.  Candidates
are verified by exact weighted similarity: the sum of the smaller over the sum of the larger weights, with
multiplicities.  Items beyond the radius are found by the shingles that they
share with a window: all whose shared weight can reach the threshold are verified
too, so none is missed.  A shingle weighs 1 + log(items / items that have it); one that
no item has weighs 1 + log(items).

A window's similarity to any item is at most the weight of its shingles that
some item has over the weight of all; windows for which that bound lies below
the threshold are not fingerprinted.  This loses nothing.

The index covers a block of the benchmark of bounded size (``MAX_CHARS``); a
larger benchmark is taken in several blocks, one after the other, with one scan
of the documents for each; only the block at hand is held.
Weights are those of the whole benchmark: how many items have each shingle is
counted once, and every task reads that table (16 bytes a shingle).

Defined cases: items without words match nothing; items shorter than n words are
one shingle of their own length; a document shorter than an item is one window;
null or empty texts have no leaks; item ids repeated with equal or other texts
are items of their own, the best match of an id counts; a null item id is kept
as null; columns named ``leaks`` are replaced, all others pass through.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .common import checkpoint, fields, shared_dir, store, tidy
from .ngram_join import _pieces

BLOCKS = 4
WIDTH = 64 // BLOCKS
RADIUS = 3 * BLOCKS - 1  # so that some block differs in two bits at most
MAX_CHARS = 16 << 20
SIEVE = 1 << 20
SPAN = 1 << 15  # words of a text whose fingerprints are summed at a time


def _bits(hashes: np.ndarray) -> np.ndarray:
    """[n, 64] of +1 and -1."""
    raw = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return raw.astype(np.float32) * 2 - 1


def _pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").reshape(-1)


class Prints:
    """The items' fingerprints, looked up by blocks together with the number of words.

    Two blocks within two bits of each other have a value within one bit of both
    in common, so items and windows stand for 1 + WIDTH values of each block.
    """

    def __init__(self, prints: np.ndarray, words: np.ndarray) -> None:
        self.prints = prints
        self.blocks = []
        for b in range(BLOCKS):
            values = self._near(prints, words, b).ravel()
            order = np.argsort(values, kind="stable")
            self.blocks.append((values[order], order // (1 + WIDTH)))

    @staticmethod
    def _near(prints: np.ndarray, words: np.ndarray, b: int) -> np.ndarray:
        """[prints, 1 + WIDTH]: number of words and a block's value, and all at one bit."""
        own = ((prints >> np.uint64(WIDTH * b)) & np.uint64((1 << WIDTH) - 1)).astype(np.int64)
        return (own[:, None] ^ np.r_[0, 1 << np.arange(WIDTH)][None, :]) | words.astype(np.int64)[:, None] << WIDTH

    def candidates(self, prints: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs of equal length within the radius."""
        pairs = [np.zeros(0, np.int64)]
        for b, (values, owners) in enumerate(self.blocks):
            probes = self._near(prints, words, b).ravel()
            lo = np.searchsorted(values, probes)
            some = np.flatnonzero(values[np.minimum(lo, len(values) - 1)] == probes)
            if len(some):
                size = np.searchsorted(values, probes[some], side="right") - lo[some]
                flat = np.arange(int(size.sum())) + np.repeat(lo[some] - np.cumsum(size) + size, size)
                pairs.append(np.repeat(some // (1 + WIDTH), size) * len(self.prints) + owners[flat])
        both = np.unique(np.concatenate(pairs))
        w, m = both // len(self.prints), both % len(self.prints)
        ok = np.bitwise_count(prints[w] ^ self.prints[m]) <= RADIUS
        return w[ok], m[ok]


def _item_shingles(texts: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(position, words, shingles) of the items that have words."""
    first, words = textops.words(texts)
    for k, m in enumerate(np.diff(first).tolist()):
        if m:
            yield k, m, textops.shingles(np.array([0, m]), words[first[k] : first[k + 1]], min(n, m))[1]


class Index:
    """Items (id, text) prepared for look-up; whole: (shingles, items that have each, items) of a benchmark of which these are a part."""

    def __init__(self, items: list[tuple[object, str]], n: int, threshold: float, whole: tuple[np.ndarray, np.ndarray, int] | None = None) -> None:
        self.n, self.threshold = n, threshold
        self.ids, self.bags, words = [], [], []
        has: Counter = Counter()
        for k, m, s in _item_shingles(pa.array([t or "" for _, t in items], pa.string()), n):
            words.append(m)
            self.ids.append(items[k][0])
            self.bags.append(Counter(s.tolist()))
            if whole is None:
                has.update(self.bags[-1].keys())
        if whole is None:
            keys = sorted(has)
            whole = np.array(keys, dtype=np.uint64), np.array([has[h] for h in keys], dtype=np.int64), len(self.ids)
        self.known, counts, total = whole
        total = max(1, total)
        self.unknown = 1.0 + float(np.log(total))
        self.weights = 1.0 + np.log(total / counts)
        self.sieve = np.zeros(SIEVE, dtype=bool)
        self.sieve[(self.known & np.uint64(SIEVE - 1)).astype(np.int64)] = True
        self.mass = [sum(w * c for w, c in zip(self._weigh(np.array(list(bag), dtype=np.uint64))[0].tolist(), bag.values(), strict=True)) for bag in self.bags]
        self.words, self.sizes = np.array(words, np.int64), sorted(set(words))
        self.prints = Prints(self._prints(), self.words)
        # the items that have each known shingle
        keys = np.array([h for bag in self.bags for h in bag], dtype=np.uint64)
        owners = np.repeat(np.arange(len(self.bags)), [len(bag) for bag in self.bags])
        order = np.argsort(keys, kind="stable")
        self.owners, self.first = owners[order], np.searchsorted(keys[order], np.append(self.known, np.uint64(0)))
        self.first[-1] = len(keys)

    def _prints(self) -> np.ndarray:
        out = []
        for bag in self.bags:
            s = np.array(list(bag.elements()), dtype=np.uint64)
            out.append(_pack((_bits(s) * self._weigh(s)[0].astype(np.float32)[:, None]).sum(axis=0, keepdims=True))[0])
        return np.array(out, dtype=np.uint64)

    def similarity(self, window: np.ndarray, item: int) -> float:
        bag, both, mine = self.bags[item], 0.0, 0.0
        counts = Counter(window.tolist())
        weights = self._weigh(np.array(list(counts), dtype=np.uint64))[0].tolist()
        for (h, c), w in zip(counts.items(), weights, strict=True):
            mine += w * c
            both += w * min(c, bag.get(h, 0))
        return round(both / (mine + self.mass[item] - both), 9)

    def _weigh(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weights, place among the known shingles or -1)."""
        maybe = np.flatnonzero(self.sieve[(s & np.uint64(SIEVE - 1)).astype(np.int64)])
        w, known = np.full(len(s), self.unknown), np.full(len(s), -1, np.int64)
        if len(maybe):
            at = np.minimum(np.searchsorted(self.known, s[maybe]), len(self.known) - 1)
            ok = self.known[at] == s[maybe]
            w[maybe[ok]], known[maybe[ok]] = self.weights[at[ok]], at[ok]
        return w, known

    def leaks(self, column: pa.Array) -> list[list[dict]]:
        """For each text its (item, start, words, similarity), the best window of each item id."""
        first, words = textops.words(column)
        out: list[list[dict]] = [[] for _ in range(len(column))]
        if not self.ids:
            return out
        best: dict[tuple[int, object], tuple] = {}
        for n in sorted({min(self.n, m) for m in self.sizes}):
            sizes = [m for m in self.sizes if min(self.n, m) == n]
            s_first, s = textops.shingles(first, words, n)
            if not len(s):
                continue
            weight, known = self._weigh(s)
            touched = np.unique(np.searchsorted(s_first, np.flatnonzero(known >= 0), side="right") - 1)
            for d in touched:
                a, b = int(s_first[d]), int(s_first[d + 1])
                self._document(int(d), s[a:b], weight[a:b], known[a:b], sizes, n, best)
        for (d, _), (item, start, m, sim) in best.items():
            out[d].append({"item_id": self.ids[item], "start": start, "n_words": m, "similarity": sim})
        for found in out:
            found.sort(key=lambda x: (x["item_id"] is None, x["item_id"] or 0, x["start"]))
        return out

    def _document(self, d: int, s: np.ndarray, weight: np.ndarray, known: np.ndarray, sizes: list[int], n: int, best: dict) -> None:
        at = np.flatnonzero(known >= 0)
        widest = max(sizes)
        cuts = np.flatnonzero(np.diff(at) > 2 * widest) + 1
        for run in np.split(at, cuts):  # stretches around known shingles
            lo, hi = max(0, int(run[0]) - widest), min(len(s), int(run[-1]) + widest + 1)
            for a in range(lo, hi, SPAN):
                self._stretch(d, s, weight, known, a, min(hi, a + SPAN + widest), a + SPAN if a + SPAN < hi else hi, sizes, n, best)

    def _stretch(self, d: int, s: np.ndarray, weight: np.ndarray, known: np.ndarray, lo: int, hi: int, stop: int, sizes: list[int], n: int, best: dict) -> None:
        """The windows that lie in lo .. hi and start before stop."""
        w, k = weight[lo:hi], known[lo:hi]
        total, hits = np.r_[0.0, np.cumsum(w)], np.r_[0.0, np.cumsum(w * (k >= 0))]
        begin, length = {}, {}
        for m in sizes:
            span = min(m - n + 1, len(s))
            if span > hi - lo:
                continue
            mass, hit = (total[span:] - total[:-span])[: stop - lo], (hits[span:] - hits[:-span])[: stop - lo]
            starts = np.flatnonzero((hit >= self.threshold * mass - 1e-9) & (hit > 0))
            if len(starts):
                begin[m], length[m] = starts, span
        if not begin:
            return
        pairs = {(m, int(x), item) for m, x, item in self._sharing(w, k, total, begin, length)}
        at, words = np.concatenate(list(begin.values())), np.repeat(list(begin), [len(x) for x in begin.values()])
        ends = at + np.array([length[m] for m in words.tolist()])
        sums = np.zeros((hi - lo + 1, 64))
        np.cumsum(_bits(s[lo:hi]) * w[:, None], axis=0, out=sums[1:])
        for x, item in zip(*self.prints.candidates(_pack(sums[ends] - sums[at]), words), strict=True):
            pairs.add((int(words[x]), int(at[x]), int(item)))
        for m, x, item in sorted(pairs):
            start = lo + x
            sim = self.similarity(s[start : start + length[m]], item)
            key = (d, self.ids[item])
            if sim >= self.threshold and (key not in best or (-sim, start, m) < (-best[key][3], best[key][1], best[key][2])):
                best[key] = (item, start, m, sim)

    def _sharing(self, w: np.ndarray, k: np.ndarray, total: np.ndarray, begin: dict[int, np.ndarray], length: dict[int, int]) -> Iterator[tuple[int, int, int]]:
        """(words, start, item) of windows whose similarity to the item can reach the threshold by the weight of their shingles that it has."""
        at = np.flatnonzero(k >= 0)
        size = self.first[k[at] + 1] - self.first[k[at]]
        flat = np.arange(int(size.sum())) + np.repeat(self.first[k[at]] - np.cumsum(size) + size, size)
        owners, places = self.owners[flat], np.repeat(at, size)
        order = np.argsort(owners, kind="stable")
        owners, places = owners[order], places[order]
        cuts = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]])
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(owners)], strict=True):
            item = int(owners[a])
            m = int(self.words[item])
            if m not in begin:
                continue
            own, starts = places[a:b], begin[m]
            sums = np.r_[0.0, np.cumsum(w[own])]
            both = sums[np.searchsorted(own, starts + length[m])] - sums[np.searchsorted(own, starts)]
            mass = total[starts + length[m]] - total[starts]
            for x in starts[both >= (self.threshold - 1e-8) * (mass + self.mass[item] - both)].tolist():
                yield m, x, item


def flag(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs with leaks: array<struct<item_id, start (word from 0), n_words, similarity>>, empty for clean documents."""
    df = docs.drop(*(c for c in docs.columns if c.lower() == "leaks" and c != text))
    kind = benchmark.schema[item_id].dataType.simpleString()
    leak = f"array<struct<item_id:{kind},start:int,n_words:int,similarity:double>>"
    items = benchmark.select(F.col(item_id).alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))
    chars = items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = -(-chars // MAX_CHARS) or 1
    names = df.columns
    whole = _benchmark_counts(items, n) if blocks > 1 else None
    out, last = df.withColumn("leaks", F.array().cast(leak)), None
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block).orderBy("i", "t")
        shared = docs.sparkSession.sparkContext.broadcast([(r["i"], r["t"]) for r in part.collect()])  # about MAX_CHARS
        out = _scan(out, names, shared, text, n, threshold, leak, whole)
        if blocks > 1:  # one block at a time
            out = checkpoint(out)
            shared.unpersist()
            tidy(docs.sparkSession, last)
            last = out
    return out


def _benchmark_counts(items: DataFrame, n: int) -> tuple[str, int]:
    """(URI of a table of shingles h and the number c of items that have each, number of items with words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(s) for _, _, s in _item_shingles(batch.column("t"), n)]
            h, c = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64)), pa.array(np.r_[len(sets), np.zeros(max(0, len(h) - 1), np.int64)][: len(h)])], ["h", "c", "items"])

    uri = shared_dir(items.sparkSession, "benchmark")
    items.select("t").mapInArrow(run, "h bigint, c bigint, items bigint").groupBy("h").agg(F.sum("c").alias("c"), F.sum("items").alias("items")).write.parquet(uri)
    return uri, items.sparkSession.read.schema("h bigint, c bigint, items bigint").parquet(uri).agg(F.sum("items")).first()[0] or 0


def _read_counts(whole: tuple[str, int]) -> tuple[np.ndarray, np.ndarray, int]:
    filesystem, path = store(whole[0])
    found = pyarrow.dataset.dataset(path, filesystem=filesystem, format="parquet").to_table(columns=["h", "c"])
    h, c = found["h"].to_numpy().view(np.uint64), found["c"].to_numpy()
    order = np.argsort(h)
    return h[order], c[order], whole[1]


def _best(leaks: list[dict]) -> list[dict]:
    """The best leak of each item id."""
    best: dict = {}
    for x in sorted(leaks, key=lambda x: (-x["similarity"], x["start"], x["n_words"])):
        best.setdefault(x["item_id"], x)
    return sorted(best.values(), key=lambda x: (x["item_id"] is None, x["item_id"] or 0, x["start"]))


_HELD: dict[str, Index] = {}


def _index(key: str, shared, n: int, threshold: float, whole: tuple[str, int] | None) -> Index:
    """The index of a scan, made once in each worker."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Index(shared.value, n, threshold, whole and _read_counts(whole))
    return _HELD[key]


def _scan(df: DataFrame, names: list[str], shared, text: str, n: int, threshold: float, leak: str, whole: tuple[str, int] | None) -> DataFrame:
    columns, key = fields([f for f in df.schema if f.name in names]), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(key, shared, n, threshold, whole)
        for part in _pieces(batches, text):
            before = part.column("leaks")
            found = [_best(old + new) if old else new for old, new in zip(before.to_pylist(), index.leaks(part.column(text)), strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(found, before.type)], [*names, "leaks"])

    return df.mapInArrow(run, f"{columns}, leaks {leak}")
