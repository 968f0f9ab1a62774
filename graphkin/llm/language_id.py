"""Language identification by a mixture of n-gram models.

Model: per language, smoothed frequencies of byte n-grams (3 bytes, words
padded by one space at either end) hashed into ``BINS`` slots, counted over all
training documents; its size is fixed: languages x BINS.  The number of
languages is that of distinct training labels, at most ``MAX_LANGUAGES``.

Prediction: a word's likelihood under a language is the product over its
n-grams.  Expectation-maximisation over the words of a document (in a long one,
its distinct words and how often each occurs) estimates the proportions of the
languages; the set is then chosen by penalised likelihood
(log-likelihood less half a logarithm of the number of words for each language
more than one): single languages against the EM fit on those that hold at least
``MIN_SHARE``.  ``lang_pred`` is the language of the largest share in the chosen
set, ``score`` that share, ``languages`` the set.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
so is every text if no document could be learned from.  Ties go to the
language that sorts first.  Nulls in lang are not learned from.  Repeated rows
count each.  A very long text is taken in stretches that share its words; memory
grows with its distinct words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .common import fields, trimmed

BINS = 1 << 16
MAX_LANGUAGES = 1024
MIN_SHARE = 0.02
ROUNDS = 8
PIECE = 1 << 20  # bytes of text that are held as n-grams at a time


def _ngrams(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot of the 3-gram around each byte, first slot of each word): as many n-grams as the word has bytes."""
    low = textops._LOWER[raw].astype(np.uint32)
    before, after = np.empty_like(low), np.empty_like(low)
    before[1:], after[:-1] = low[:-1], low[1:]
    before[starts], after[ends - 1] = 32, 32
    slot = ((before * np.uint32(0x1F35) ^ low * np.uint32(0x9E3779B1) ^ after * np.uint32(0x85EBCA77)) * np.uint32(0xC2B2AE35)) >> np.uint32(16)
    lens = ends - starts
    first = np.cumsum(lens) - lens
    inside = np.zeros(len(raw) + 1, dtype=np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    return slot[np.cumsum(inside[:-1]) > 0], first


def _spans(column: pa.Array, hashed: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
    """(document of each word, n-gram slots, first slot of each word, their number, words' hashes if asked for) by stretches of text."""
    offsets, raw = textops.utf8(column)
    for a, b in textops._cuts(offsets, raw):
        lo, hi = np.searchsorted(offsets, a, side="left"), np.searchsorted(offsets, b, side="left")
        starts, ends = textops._bounds(raw[a:b], offsets[lo:hi] - a)
        if len(starts):
            slots, first = _ngrams(raw[a:b], starts, ends)
            yield np.searchsorted(offsets, starts + a, side="right") - 1, slots, first, ends - starts, textops._hash_span(raw[a:b], starts, ends) if hashed else None


def train(docs: DataFrame, *, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages in order, log-probabilities [BINS, languages]); counts are summed over the tasks, a fixed-size row of each."""
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            for owner, slots, _, lens, _ in _spans(batch.column("text")):
                of = langs[owner]
                for one in set(of):
                    got = np.bincount(slots[np.repeat(of == one, lens)], minlength=BINS)
                    sums[one] = sums.get(one, 0) + got
        for one, total in sums.items():
            cut = np.split(total.astype(np.int64), 16)
            yield pa.RecordBatch.from_arrays([pa.array([one] * 16), pa.array(range(16), pa.int32()), pa.array([x.tobytes() for x in cut], pa.binary())], ["lang", "part", "counts"])

    def total(table: pa.Table) -> pa.Table:
        whole = np.sum([np.frombuffer(x.as_buffer(), np.int64) for x in table["counts"]], axis=0)
        return pa.table({"lang": table["lang"][:1], "part": table["part"][:1], "counts": pa.array([whole.tobytes()], pa.binary())})

    schema = "lang string, part int, counts binary"
    rows = labelled.mapInArrow(trimmed(count), schema).groupBy("lang", "part").applyInArrow(total, schema).take(16 * MAX_LANGUAGES + 1)
    names = sorted({r["lang"] for r in rows})
    if len(rows) > 16 * MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counts, column = np.zeros((BINS, len(names))), {name: k for k, name in enumerate(names)}
    for r in rows:
        at = r["part"] * (BINS // 16)
        counts[at : at + BINS // 16, column[r["lang"]]] = np.frombuffer(r["counts"], np.int64)
    return names, np.log((counts + 0.05) / (counts.sum(axis=0) + 0.05 * BINS)) if names else counts


def _mixture(owner: np.ndarray, ll: np.ndarray, times: np.ndarray, n: int, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(proportions [n, languages], log-likelihood [n]) after ROUNDS of EM among the languages allowed to each document; times: how often each word occurs."""
    share = allowed / np.maximum(1, allowed.sum(axis=1, keepdims=True))
    top = ll.max(axis=1, keepdims=True)
    lik = np.exp(np.maximum(ll - top, -60.0))
    bounds = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    docs, size = owner[bounds], np.add.reduceat(times, bounds)[:, None]
    for _ in range(ROUNDS):
        w = lik * share[owner]
        w *= (times / np.maximum(w.sum(axis=1), 1e-300))[:, None]
        share[docs] = np.add.reduceat(w, bounds, axis=0) / size
    fit = np.zeros(n)
    fit[docs] = np.add.reduceat(times * (np.log(np.maximum((lik * share[owner]).sum(axis=1), 1e-300)) + top[:, 0]), bounds)
    return share, fit


def _words_of_long(column: pa.Array, model: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(log-likelihoods, times) of the distinct words of one text, in the order of their hashes."""
    known, ll, times = np.zeros(0, np.uint64), np.zeros((0, model.shape[1])), np.zeros(0)
    for _, slots, first, _, hashes in _spans(column, hashed=True):
        each, at, count = np.unique(hashes, return_index=True, return_counts=True)
        own = np.add.reduceat(model[slots], first, axis=0)[at]
        known, index, inverse = np.unique(np.concatenate([known, each]), return_index=True, return_inverse=True)
        ll = np.concatenate([ll, own])[index]
        times = np.bincount(inverse, weights=np.concatenate([times, count]), minlength=len(known))
    if len(known):
        yield ll, times


def _classify(column: pa.Array, names: list[str], model: np.ndarray, long: bool = False) -> tuple[list, np.ndarray, list]:
    n = len(column)
    letters = pc.match_substring_regex(column.cast(pa.large_string()), r"\p{L}").fill_null(False).to_numpy(zero_copy_only=False)
    if not names:
        return ["und"] * n, np.zeros(n), [[] for _ in range(n)]
    owners, lls, counts = [], [], []
    if long:
        for ll, times in _words_of_long(column, model):
            owners.append(np.zeros(len(ll), np.int64))
            lls.append(ll)
            counts.append(times)
    else:
        for owner, slots, first, _, _ in _spans(column):
            owners.append(owner)
            lls.append(np.add.reduceat(model[slots], first, axis=0).astype(np.float64))
            counts.append(np.ones(len(owner)))
    share, multi = np.zeros((n, len(names))), np.zeros(n, dtype=bool)
    single = np.zeros((n, len(names)))
    if owners:
        owner, ll, times = np.concatenate(owners), np.concatenate(lls), np.concatenate(counts)
        bounds = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        single[owner[bounds]] = np.add.reduceat(ll * times[:, None], bounds, axis=0)
        words = np.bincount(owner, weights=times, minlength=n)
        share, _ = _mixture(owner, ll, times, n, np.ones((n, len(names))))
        chosen = share >= MIN_SHARE
        chosen[np.arange(n), share.argmax(axis=1)] = True
        several = chosen.sum(axis=1) > 1
        at = several[owner]
        if at.any():
            refit, fit = _mixture(owner[at], ll[at], times[at], n, chosen.astype(float))
            better = fit - 0.5 * np.log(np.maximum(words, 1)) * (chosen.sum(axis=1) - 1) > single.max(axis=1)
            multi = several & better
            share[multi] = refit[multi]
    best = single.argmax(axis=1)
    best[multi] = share[multi].argmax(axis=1)
    score = np.where(multi, share.max(axis=1), 1.0)
    pred = [names[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
    sets = [([names[k] for k in np.flatnonzero(share[i] >= MIN_SHARE)] if multi[i] else [names[best[i]]]) if ok else [] for i, ok in enumerate(letters)]
    return pred, np.where(letters, np.clip(score, 0, 1), 0.0), sets


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], *, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and languages (array); columns of these names are replaced."""
    new = {"lang_pred", "score", "languages"}
    kept = docs.drop(*(c for c in docs.columns if c.lower() in new and c != text))
    if len({c.lower() for c in kept.columns}) < len(kept.columns):
        raise ValueError("column names differ in case only")
    (names, weights), most = model, PIECE
    shared = docs.sparkSession.sparkContext.broadcast((names, weights.astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weights = shared.value
        for batch in batches:
            ends, at = np.cumsum(np.diff(textops.utf8(batch.column(text))[0])), 0
            while at < batch.num_rows:  # at most PIECE bytes, or one document
                done = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
                part = batch.slice(at, to - at)
                pred, score, sets = _classify(part.column(text), names, weights, int(ends[to - 1]) - done > most)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(score), pa.array(sets, pa.list_(pa.string()))], [*part.schema.names, "lang_pred", "score", "languages"])
                at = to

    return kept.mapInArrow(trimmed(run), f"{fields(kept.schema)}, lang_pred string, score double, languages array<string>")
