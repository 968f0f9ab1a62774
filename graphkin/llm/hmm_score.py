"""Scoring of texts by a hidden Markov language model.

Base: a smoothed unigram, q(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)), one unseen
word included.  The model multiplies it with the word's emission ratio in the
current state: p(w | s) = q(w) * P(w | s) / q(w) for every word of the training
texts and their end; unseen words keep q(w) in every state.

Training is Baum-Welch over the whole of every training text.  Texts are encoded
once, in chunks of at most ``CHUNK`` bytes (or one text) with a dictionary of
their own, and stay in the shared folder.  The words of all chunks are dealt to
buckets by ranges of their hashes.  In each round a chunk's task gets the factors
of its words from the buckets, runs the forward-backward algorithm and sends its
expected counts back; a bucket's task adds them up over the chunks.  So counts of
the corpus and expected counts by (word, state) are distributed tables that grow
with the corpus; the driver only holds the start, the steps and four totals.

Long texts: a text is cut into stretches of ``STRETCH`` tokens.  The product of
a stretch's step matrices carries the forward vector from its one end to the
other and the backward vector back, so all stretches are worked on at once and
the recursions are those of the whole text.

Numbers by word and state are exchanged and kept in single precision; sums and
recursions are in double precision.

Defined cases: a null or empty text is the end token alone; without training
texts every token has the unigram probability 1 of the formula; repeated rows
are scored each (and counted each, in training); columns other than the id and
the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops
from .common import checkpoint, new_path, put, shared_dir, store, tidy

STATES = 6
ROUNDS = 4
STRETCH = 1024  # tokens whose recursions are one sequence of NumPy steps
SHRINK = 500.0  # pseudo-counts of the base distribution
CHUNK = 48 << 20  # bytes of text that share a dictionary
PIECE = 2 << 20  # bytes of text that are worked on at a time
PAIRS = 400_000  # words of chunks that a bucket gets
END, RARE = 0, 1  # classes of the end and of unseen words in a whole vocabulary; words follow
_LN10 = np.log(10.0)


def noise(words: np.ndarray) -> np.ndarray:
    """[words, states]: the factors, in [0.5, 1.5), by which states differ at the start; they only depend on the word."""
    salt = np.arange(1, STATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return 0.5 + (textops.mix(words[:, None] ^ salt[None, :]) >> np.uint64(11)).astype(float) / (1 << 53)


_END_NOISE = noise(np.array([END], np.uint64))[0]


class Model:
    """Totals of the training texts and the parameters of the HMM.

    ``table`` has a row for each bucket: h, c and x, the words, their counts and
    their expected counts by state over their unigram mass.  ``ratios``, ``emit``
    and ``encode`` load all words on the driver: for small vocabularies.
    """

    def __init__(self, total: int, distinct: int, ends: int, buckets: int = 1) -> None:
        self.total, self.distinct, self.ends, self.buckets = total, distinct, ends, buckets
        self.norm = total + 0.1 * (distinct + 1)
        self.unseen = 0.1 / self.norm
        self.end_mass = (ends + 0.1) / self.norm if ends else self.unseen
        self.start = np.full(STATES, 1 / STATES)
        self.step = np.full((STATES, STATES), 0.1 / (STATES - 1)) + np.eye(STATES) * (0.9 - 0.1 / (STATES - 1))
        self.first, self.tokens, self.end = np.ones(STATES), None, np.zeros(STATES)
        self.table, self._all = None, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None, "_all": None}

    def begin(self, mass: np.ndarray) -> None:
        """mass: of all words, the unigram mass times the noise, by state."""
        self.first = mass + (self.end_mass * _END_NOISE if self.ends else 0.0)

    def update(self, start: np.ndarray, step: np.ndarray, tokens: np.ndarray, end: np.ndarray) -> None:
        """The parameters of expected counts: tokens and end by state, of all tokens and of the end."""
        self.tokens, self.end = tokens, end
        self.start = (start + 1) / (start + 1).sum()
        self.step = (step + 1) / (step + 1).sum(axis=1, keepdims=True)

    def factors(self, words: np.ndarray, x: np.ndarray | None, seen: np.ndarray | None = None) -> np.ndarray:
        """[end and words, states]: P(word | state) / q(word).  x: expected counts over unigram mass (None: before the first round); unseen words have 1."""
        known = 1 - self.unseen
        every = np.r_[END, words].astype(np.uint64)
        if self.tokens is None or x is None:
            out = noise(every) * known / np.maximum(self.first, 1e-300)
        else:
            out = (np.concatenate([self.end[None, :] / self.end_mass, x]) + SHRINK) * known / (self.tokens + SHRINK * known)
        if seen is not None:
            out[1:][~seen] = 1.0
        if not self.ends:
            out[0] = 1.0
        return out

    def whole(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words in ascending order, counts, ratios [end, unseen and words, states])."""
        if self._all is None:
            h, c, x = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros((0, STATES))]
            for r in self.table.orderBy("bucket").collect() if self.table is not None else []:
                h.append(np.frombuffer(r["h"], np.uint64))
                c.append(np.frombuffer(r["c"], np.int64))
                x.append(_by_state(r["x"]))
            h, c, x = (np.concatenate(y) for y in (h, c, x))
            f = self.factors(h, x)
            self._all = h, c, np.concatenate([f[:1], np.ones((1, STATES)), f[1:]])
        return self._all

    def ratios(self) -> np.ndarray:
        """[classes, states]: P(class | state) / Q(class)."""
        return self.whole()[2]

    @property
    def emit(self) -> np.ndarray:
        """[states, classes]."""
        mass = np.concatenate([[self.end_mass if self.ends else 0.0, self.unseen], (self.whole()[1] + 0.1) / self.norm])
        return (self.ratios() * mass[:, None]).T

    def encode(self, first: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, classes with an end for each text)."""
        h = self.whole()[0]
        at = np.minimum(np.searchsorted(h, words), max(0, len(h) - 1))
        known = h[at] == words if len(h) else np.zeros(len(words), bool)
        return _ended(first, np.where(known, at + 2, RARE).astype(np.int32))


def _by_state(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.float32).reshape(-1, STATES).astype(float)


def _ended(first: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, codes) with an end after each text."""
    out_first = first + np.arange(len(first))
    out = np.full(int(out_first[-1]), END, np.int32)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out[np.arange(len(codes)) + owner] = codes
    return out_first, out


class Steps:
    """Sequences ordered so that those with a token at step t are contiguous, and so are the tokens of each step."""

    def __init__(self, begin: np.ndarray, size: np.ndarray, codes: np.ndarray, ratio: np.ndarray) -> None:
        self.order = np.argsort(-size, kind="stable")
        short = np.sort(size)
        self.live = len(short) - np.searchsorted(short, np.arange(short.max(initial=0)), side="right")
        self.at = np.concatenate([[0], np.cumsum(self.live)])
        step = np.repeat(np.arange(len(self.live)), self.live)
        self.rank = np.arange(len(step)) - self.at[step]  # place of each token's sequence in the order
        self.codes = codes[begin[self.order][self.rank] + step]
        self.ratio = np.ascontiguousarray(ratio[self.codes].T)  # [states, tokens]

    def __iter__(self) -> Iterator[tuple[int, int, slice]]:
        """(step, sequences that have it, their tokens)."""
        for t, n in enumerate(self.live.tolist()):
            yield t, n, slice(int(self.at[t]), int(self.at[t]) + n)


class Stretches:
    """Texts cut into stretches, and the forward and backward vectors at the cuts.

    ``enter`` holds the state probabilities before the first token of each
    stretch.
    """

    def __init__(self, first: np.ndarray, codes: np.ndarray, model: Model, ratio: np.ndarray) -> None:
        size = np.diff(first)
        self.model = model
        self.parts = -(-size // STRETCH)  # of each text; none without tokens
        self.text = np.repeat(np.arange(len(size)), self.parts)
        self.at = np.cumsum(self.parts) - self.parts  # first stretch of each text
        place = np.arange(len(self.text)) - self.at[self.text]
        self.later = np.flatnonzero(place)
        begin = first[:-1][self.text] + place * STRETCH
        length = np.minimum(size[self.text] - place * STRETCH, STRETCH)
        self.steps = Steps(begin, length, codes, ratio)
        self.enter = np.tile(model.start, (len(self.text), 1))
        self.long = np.flatnonzero(self.parts > 1)
        inner = np.flatnonzero(self.parts[self.text] > 1)
        self.products = np.zeros((len(self.text), STATES, STATES))
        if len(inner):
            self._multiply(inner, Steps(begin[inner], length[inner], codes, ratio))
        self._along()

    def _multiply(self, inner: np.ndarray, steps: Steps) -> None:
        """[states, states] for each stretch of long texts: from before its first token to behind its last, up to a factor."""
        x, back, width = np.zeros((STATES, STATES, 0)), np.ascontiguousarray(self.model.step.T), 0
        for t, n, tokens in steps:
            r = steps.ratio[:, None, tokens]
            if t == 0:
                x = np.eye(STATES)[:, :, None] * r  # [to, from, stretches]
            else:
                if n < width:  # some end here
                    self._keep(inner[steps.order[n:width]], x[:, :, n:])
                    x = np.ascontiguousarray(x[:, :, :n])
                x = (back @ x.reshape(STATES, -1)).reshape(STATES, STATES, n)
                x *= r
                if t % 16 == 15:
                    x /= x.max(axis=(0, 1))
            width = n
        self._keep(inner[steps.order[:width]], x)

    def _keep(self, which: np.ndarray, x: np.ndarray) -> None:
        self.products[which] = (x / x.max(axis=(0, 1))).transpose(2, 1, 0)

    def _along(self) -> None:
        step, texts, k = self.model.step, self.long, 0
        while len(texts):  # once for each stretch of the longest text
            texts = texts[self.parts[texts] > k + 1]
            now = self.at[texts] + k
            v = np.einsum("ni,nij->nj", self.enter[now], self.products[now])
            self.enter[now + 1] = (v / v.sum(axis=1, keepdims=True)) @ step
            k += 1

    def behind(self) -> np.ndarray:
        """[stretches, states]: the backward vector behind the last token of each stretch, up to a factor."""
        out = np.ones((len(self.text), STATES))
        if len(self.long):
            for k in range(int(self.parts.max()) - 1, 0, -1):
                now = self.at[self.long[self.parts[self.long] > k]] + k
                v = np.einsum("nij,nj->ni", self.products[now], out[now]) @ self.model.step.T
                out[now - 1] = v / v.sum(axis=1, keepdims=True)
        return out

    def forward(self) -> tuple[np.ndarray, np.ndarray]:
        """(normalised forward vectors [states, tokens], scales) by steps."""
        steps, back = self.steps, np.ascontiguousarray(self.model.step.T)
        alpha, scale = np.empty_like(steps.ratio), np.empty(steps.ratio.shape[1])
        a = np.ascontiguousarray(self.enter[steps.order].T)
        for t, n, tokens in steps:
            if t:
                a = back @ a[:, :n]
            a *= steps.ratio[:, tokens]
            np.add.reduce(a, axis=0, out=scale[tokens])
            a /= scale[tokens]
            alpha[:, tokens] = a
        return alpha, scale


def forward(first: np.ndarray, codes: np.ndarray, model: Model, ratio: np.ndarray) -> np.ndarray:
    """Natural logarithm of the likelihood of each text over the base model's."""
    s = Stretches(first, codes, model, ratio)
    return np.bincount(s.text[s.steps.order][s.steps.rank], weights=np.log(s.forward()[1]), minlength=len(first) - 1)


def expectations(first: np.ndarray, codes: np.ndarray, model: Model, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts (start, step, emit [states, classes]) of whole texts by the forward-backward algorithm."""
    s = Stretches(first, codes, model, ratio)
    steps, (alpha, scale) = s.steps, s.forward()
    end = np.ascontiguousarray(s.behind()[steps.order].T)
    last, into = np.zeros_like(end), np.zeros_like(end)
    step, beta, m, after = np.zeros((STATES, STATES)), end[:, :0], 0, slice(0, 0)
    for _, n, tokens in reversed(list(steps)):
        full = np.empty((STATES, n))
        if m:
            beta *= steps.ratio[:, after]
            beta /= scale[after]
            step += alpha[:, tokens.start : tokens.start + m] @ beta.T
            full[:, :m] = model.step @ beta
        if n > m:  # these end here
            a = last[:, m:n] = alpha[:, tokens.start + m : tokens.stop]
            full[:, m:] = end[:, m:n] / (a * end[:, m:n]).sum(axis=0)
        alpha[:, tokens] *= full  # the posterior probabilities of the states
        beta, m, after = full, n, tokens
    if m:
        into = beta * steps.ratio[:, after] / scale[after]
    # the steps from one stretch of a text to the next
    where = np.empty(len(steps.order), np.int64)
    where[steps.order] = np.arange(len(steps.order))
    step += last[:, where[s.later - 1]] @ into[:, where[s.later]].T
    emit = np.stack([np.bincount(steps.codes, weights=a, minlength=len(ratio)) for a in alpha])
    heads = where[s.at[s.parts > 0]]
    return alpha[:, heads].sum(axis=1), step * model.step, emit


def _encoded(docs: DataFrame, folder: str) -> DataFrame:
    """docs(id, text) written as chunks; rows (path, texts, tokens, words): a file of codes by text and one of the words, ascending, at each path."""
    chunk, piece = CHUNK, PIECE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            words = np.unique(np.concatenate([own for _, _, own, _ in held]))
            path = new_path(folder)
            kind = pa.schema([("id", held[0][0].type), ("codes", pa.list_(pa.int32()))])
            sink, tokens = pa.BufferOutputStream(), 0
            with pa.ipc.new_stream(sink, kind, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for ids, first, own, at in held:
                    f, codes = _ended(first, (np.searchsorted(words, own).astype(np.int32) + 1)[at])
                    tokens += len(codes)
                    out.write_batch(pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(f.astype(np.int32)), pa.array(codes))], schema=kind))
            put(f"{path}.codes", [sink.getvalue()])
            put(f"{path}.words", [words.tobytes()])
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([sum(len(x[0]) for x in held)], pa.int64()), pa.array([tokens], pa.int64()), pa.array([len(words)], pa.int64())], ["path", "texts", "tokens", "words"])

        for batch in batches:
            ends, at = np.cumsum(np.diff(textops.utf8(batch.column("text"))[0])), 0
            while at < batch.num_rows:
                done = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, done + piece, side="right")))
                part = batch.slice(at, to - at)
                if held and size + int(ends[to - 1]) - done > chunk:
                    yield flush()
                    held, size = [], 0
                first, words = textops.words(part.column("text"))
                own, code = np.unique(words, return_inverse=True)
                held.append((pa.concat_arrays([part.column("id")]), first, own, code.astype(np.int32)))
                size += int(ends[to - 1]) - done
                at = to
        if held:
            yield flush()

    return checkpoint(docs.select("id", "text").mapInArrow(run, "path string, texts bigint, tokens bigint, words bigint"))


def _read(path: str) -> np.ndarray:
    fs, where = store(path)
    with fs.open_input_stream(where, compression=None) as f:
        return np.frombuffer(f.read(), np.uint64)


def _texts(path: str) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(ids, first, codes) of a chunk, by pieces; 0 is the end, the chunk's words follow."""
    fs, where = store(path)
    with fs.open_input_stream(where, compression=None) as f, pa.ipc.open_stream(f) as batches:
        for batch in batches:
            codes = batch.column("codes")
            yield batch.column("id"), codes.offsets.to_numpy().astype(np.int64), codes.values.to_numpy()


def _cut(words: np.ndarray, buckets: int) -> np.ndarray:
    """Bounds of the buckets in ascending words: equal ranges of the hashes."""
    edges = (np.arange(1, buckets, dtype=object) * (1 << 64) // buckets).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(words, edges), [len(words)]]).astype(np.int64)


def _parcels(path: str, bounds: np.ndarray, columns: dict[str, np.ndarray]) -> dict[str, pa.Array]:
    """Columns of path, bucket and the columns' parts, a row for each bucket that has words."""
    full = np.flatnonzero(np.diff(bounds))
    blobs = {k: pa.array([np.ascontiguousarray(x[bounds[b] : bounds[b + 1]]).tobytes() for b in full], pa.binary()) for k, x in columns.items()}
    return {"path": pa.array([path] * len(full), pa.string()), "bucket": pa.array(full, pa.int64()), **blobs}


def _requests(chunks: DataFrame, buckets: int) -> DataFrame:
    """path, bucket, h: the words of the chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                words = _read(f"{path}.words")
                yield pa.RecordBatch.from_pydict(_parcels(path, _cut(words, buckets), {"h": words}))

    return _dealt(chunks).mapInArrow(run, "path string, bucket bigint, h binary")


def _dealt(chunks: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Rows by path: each chunk stands for much work, however few bytes its rows have."""
    parts = min(chunks.count(), int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return (chunks.select("path") if rows is None else rows).repartition(max(1, parts), "path")


def _vocabulary(chunks: DataFrame, buckets: int, folder: str) -> DataFrame:
    """bucket, h, c, mass, seen: the words of each bucket, ascending, and their counts over all chunks; the place of each chunk's words goes to a file of the bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                words = _read(f"{path}.words")
                own = np.zeros(len(words) + 1, np.int64)
                for _, _, codes in _texts(f"{path}.codes"):
                    own += np.bincount(codes, minlength=len(own))
                yield pa.RecordBatch.from_pydict(_parcels(path, _cut(words, buckets), {"h": words, "n": own[1:].astype(np.int32)}))

    def add(table: pa.Table) -> pa.Table:
        bucket, parts = table["bucket"][0].as_py(), [np.frombuffer(x.as_buffer(), np.uint64) for x in table["h"]]
        h, at = np.unique(np.concatenate(parts), return_inverse=True)
        n = np.concatenate([np.frombuffer(x.as_buffer(), np.int32) for x in table["n"]])
        c = np.bincount(at, weights=n, minlength=len(h)).astype(np.int64)
        ends = np.cumsum([len(p) for p in parts]).tolist()
        index = pa.table({"path": table["path"], "at": pa.array([x.astype(np.int32).tobytes() for x in np.split(at, ends[:-1])], pa.binary())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, index.schema) as out:
            out.write_table(index)
        put(f"{folder}/bucket-{bucket}", [sink.getvalue()])
        return pa.table({"bucket": table["bucket"][:1], "h": pa.array([h.tobytes()], pa.binary()), "c": pa.array([c.tobytes()], pa.binary()), "words": pa.array([len(h)], pa.int64()), "n": pa.array([int(c.sum())], pa.int64())})

    rows = _dealt(chunks).mapInArrow(count, "path string, bucket bigint, h binary, n binary")
    return checkpoint(rows.groupBy("bucket").applyInArrow(add, "bucket bigint, h binary, c binary, words bigint, n bigint"))


def _places(folder: str, bucket: int) -> dict[str, np.ndarray]:
    fs, where = store(f"{folder}/bucket-{bucket}")
    with fs.open_input_stream(where, compression=None) as f, pa.ipc.open_stream(f) as batches:
        return {p: np.frombuffer(a, np.int32) for b in batches for p, a in zip(b["path"].to_pylist(), b["at"].to_pylist(), strict=True)}


def _round(chunks: DataFrame, words: DataFrame, table: DataFrame | None, model: Model, folder: str) -> DataFrame:
    """The table after one more round: bucket, h, c, x and sums, the buckets' shares of start, step, tokens and end."""
    buckets, whole = model.buckets, words.sparkSession.sparkContext.broadcast(model)

    def worked(path: str, x: np.ndarray | None) -> dict[str, pa.Array]:
        model, h = whole.value, _read(f"{path}.words")
        ratio = model.factors(h, x)
        emit, start, step = np.zeros((STATES, len(h) + 1)), np.zeros(STATES), np.zeros((STATES, STATES))
        for _, first, codes in _texts(f"{path}.codes"):
            a, b, c = expectations(first, codes, model, ratio)
            start, step = start + a, step + b
            emit += c
        emit = emit.T
        out = _parcels(path, _cut(h, buckets), {"g": emit[1:].astype(np.float32)})
        sums = np.concatenate([start[None, :], step, emit.sum(axis=0)[None, :], emit[:1]]).ravel().tolist()
        mine = textops.fold(np.frombuffer(path.encode(), np.uint8).astype(np.uint64)) % buckets  # spread over the buckets
        n = len(out["bucket"])
        return {
            "path": pa.concat_arrays([out["path"], pa.array([path])]),
            "bucket": pa.concat_arrays([out["bucket"], pa.array([mine], pa.int64())]),
            "g": pa.concat_arrays([out["g"], pa.array([None], pa.binary())]),
            "sums": pa.array([None] * n + [sums], pa.list_(pa.float64())),
        }

    def fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                yield pa.RecordBatch.from_pydict(worked(path, None))

    def again(table: pa.Table) -> pa.Table:
        table = table.sort_by("bucket")
        return pa.table(worked(table["path"][0].as_py(), np.concatenate([_by_state(x.as_buffer()) for x in table["x"]])))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, x in zip(batch.column("bucket").to_pylist(), batch.column("x"), strict=True):
                each = np.frombuffer(x.as_buffer(), np.float32).reshape(-1, STATES)
                for path, at in _places(folder, bucket).items():
                    yield pa.RecordBatch.from_pydict({"path": pa.array([path]), "bucket": pa.array([bucket], pa.int64()), "x": pa.array([each[at].tobytes()], pa.binary())})

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        model, sums = whole.value, np.zeros((STATES + 3, STATES))
        for row in left["sums"]:
            if row.is_valid:
                sums += np.array(row.as_py()).reshape(sums.shape)
        bucket = (right if right.num_rows else left)["bucket"][:1]
        h, c = (right[k][0].as_py() if right.num_rows else b"" for k in ("h", "c"))
        mass = (np.frombuffer(c, np.int64) + 0.1) / model.norm
        total = np.zeros((len(mass), STATES))
        if right.num_rows:
            places = _places(folder, bucket[0].as_py())
            for path, g in zip(left["path"].to_pylist(), left["g"], strict=True):
                if g.is_valid:  # a chunk has a word once
                    total[places[path]] += np.frombuffer(g.as_buffer(), np.float32).reshape(-1, STATES)
        x = (total / mass[:, None]).astype(np.float32)
        return pa.table({"bucket": bucket, **{k: pa.array([v], pa.binary()) for k, v in (("h", h), ("c", c), ("x", x.tobytes()))}, "sums": pa.array([sums.ravel().tolist()], pa.list_(pa.float64()))})

    schema = "path string, bucket bigint, g binary, sums array<double>"
    if table is None:
        rows = _dealt(chunks).mapInArrow(fresh, schema)
    else:
        known = table.where("length(x) > 0").select("bucket", "x").mapInArrow(expand, "path string, bucket bigint, x binary")
        # chunks without a word get nothing from the buckets
        known = known.unionByName(chunks.where("words = 0").select("path", F.lit(-1).cast("long").alias("bucket"), F.lit(b"").alias("x")))
        rows = _dealt(chunks, known).groupBy("path").applyInArrow(again, schema)
    added = rows.groupBy("bucket").cogroup(words.select("bucket", "h", "c").groupBy("bucket")).applyInArrow(add, "bucket bigint, h binary, c binary, x binary, sums array<double>")
    return checkpoint(added)


def train(docs: DataFrame, *, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """The model of docs(text), and its table of words by bucket (h and c: the words and their counts)."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "hmm")
    chunks = _encoded(docs.select(F.lit(0).alias("id"), "text"), folder)
    size = chunks.agg(F.sum("texts").alias("texts"), F.sum("words").alias("words")).first()
    ends = int(size["texts"] or 0)
    buckets = max(1, -(-int(size["words"] or 0) // PAIRS))
    words = _vocabulary(chunks, buckets, folder)
    facts = words.agg(F.sum("n").alias("n"), F.sum("words").alias("v")).first()
    model = Model(int(facts["n"] or 0) + ends, int(facts["v"] or 0) + bool(ends), ends, buckets)
    model.begin(_noise_mass(words, model))
    table = None
    for _ in range(rounds if ends else 0):
        old, table = table, _round(chunks, words, table, model, folder)
        sums = np.zeros((STATES + 3) * STATES)
        for r in table.select(F.posexplode("sums").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect():  # a few numbers
            sums[r["k"]] = r["v"]
        sums = sums.reshape(-1, STATES)
        model.update(sums[0], sums[1:-2], sums[-2], sums[-1])
        tidy(spark, old)
    model.table = words.select("bucket", "h", "c", F.lit(None).cast("binary").alias("x")) if table is None else table.where("length(h) > 0").select("bucket", "h", "c", "x")
    tidy(spark, folder, None if table is None else words)
    return model, model.table


def _noise_mass(words: DataFrame, model: Model) -> np.ndarray:
    """The unigram mass of words times their factors at the start, by state."""
    norm = model.norm

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(STATES)
        for batch in batches:
            for h, c in zip(batch.column("h"), batch.column("c"), strict=True):
                total += ((np.frombuffer(c.as_buffer(), np.int64) + 0.1) / norm) @ noise(np.frombuffer(h.as_buffer(), np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], [f"g{s}" for s in range(STATES)])

    names = [f"g{s}" for s in range(STATES)]
    found = words.select("h", "c").mapInArrow(run, ", ".join(f"{g} double" for g in names)).agg(*(F.sum(g) for g in names)).first()
    return np.array([x or 0.0 for x in found])


def score(docs: DataFrame, model: Model, table: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col, n_tokens, n_known, train_tokens, base_score and score (log10) of every row."""
    spark: SparkSession = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    chunks = _encoded(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), shared_dir(spark, "hmm"))
    shared = spark.sparkContext.broadcast(model)

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"path": pa.array([], pa.string()), "bucket": pa.array([], pa.int64()), "c": pa.array([], pa.binary()), "x": pa.array([], pa.binary())})
        h, c, x = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, STATES), np.float32)
        if right.num_rows:
            h, c = np.frombuffer(right["h"][0].as_buffer(), np.uint64), np.frombuffer(right["c"][0].as_buffer(), np.int64)
            x = np.frombuffer(right["x"][0].as_buffer(), np.float32).reshape(-1, STATES) if right["x"][0].is_valid else np.zeros((len(h), STATES), np.float32)
        counts, sums = [], []
        for own in left["h"]:
            own = np.frombuffer(own.as_buffer(), np.uint64)
            at = np.minimum(np.searchsorted(h, own), max(0, len(h) - 1))
            known = h[at] == own if len(h) else np.zeros(len(own), bool)
            n, s = np.zeros(len(own), np.int64), np.zeros((len(own), STATES), np.float32)
            n[known], s[known] = c[at[known]], x[at[known]]
            counts.append(n.tobytes())
            sums.append(s.tobytes())
        return pa.table({"path": left["path"], "bucket": left["bucket"], "c": pa.array(counts, pa.binary()), "x": pa.array(sums, pa.binary())})

    def scored(table: pa.Table) -> pa.Table:
        model, table = shared.value, table.sort_by("bucket")
        path = table["path"][0].as_py()
        words = _read(f"{path}.words")
        c = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table["c"]])
        x = np.concatenate([_by_state(x.as_buffer()) for x in table["x"]])
        ratio = model.factors(words, None if model.tokens is None else x, c > 0)
        count = np.concatenate([[model.ends], c])
        log = np.log10((count + 0.1) / model.norm)
        out = []
        for ids, first, codes in _texts(f"{path}.codes"):
            owner, n = np.repeat(np.arange(len(ids)), np.diff(first)), len(ids)
            base = np.bincount(owner, weights=log[codes], minlength=n)
            known = np.bincount(owner, weights=(count > 0)[codes], minlength=n).astype(np.int64)
            score = base + forward(first, codes, model, ratio) / _LN10
            out.append(pa.table([ids, pa.array(np.diff(first)), pa.array(known), pa.array(np.full(n, model.total, np.int64)), pa.array(base), pa.array(score)], ["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]))
        return pa.concat_tables(out)

    asked = _requests(chunks, model.buckets).groupBy("bucket").cogroup(table.select("bucket", "h", "c", "x").groupBy("bucket"))
    answers = asked.applyInArrow(look_up, "path string, bucket bigint, c binary, x binary")
    answers = answers.unionByName(chunks.where("words = 0").select("path", F.lit(-1).cast("long").alias("bucket"), F.lit(b"").alias("c"), F.lit(b"").alias("x")))
    schema = f"id {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return _dealt(chunks, answers).groupBy("path").applyInArrow(scored, schema).withColumnRenamed("id", id_col)
