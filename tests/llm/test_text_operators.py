import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphkin.llm import bpe, decontaminate, hmm_score, language_id, ngram_join, textops
from graphkin.llm.queries import QUERIES, vocabulary

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string"


def split(text):
    return [w.lower() for w in WORD.findall((text or "").encode())]


def bag(text, n):
    w = split(text)
    return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [tuple(w)] if w else []


def random_docs(seed, k=80, words=60):
    """Texts with exact and near copies, shared passages, nulls and empties."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    make = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage, texts = make(25), [None, "", " \n\t ", "One", "one two", "one two"]
    while len(texts) < k:
        base = make(rng.randint(5, words))
        if rng.random() < 0.3:
            base += passage
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 6])):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts.append(rng.choice([" ", "\n", "  "]).join(copy))
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_words_and_blocks(monkeypatch):
    texts = ["Ab c", None, "", " x\x0by\u00a0z ", "é" * 50 + " q", "Ab", "long " * 40]
    whole = textops.words(pa.array(texts))
    monkeypatch.setattr(textops, "BLOCK", 16)
    small = textops.words(pa.array(texts))
    assert (whole[0] == small[0]).all() and (whole[1] == small[1]).all()
    flat = [w for t in texts for w in split(t)]
    assert list(np.diff(whole[0])) == [len(split(t)) for t in texts]
    assert len(set(whole[1].tolist())) == len(set(flat)) and all((whole[1][i] == whole[1][j]) == (a == b) for i, a in enumerate(flat) for j, b in enumerate(flat))


@pytest.mark.parametrize(("seed", "n", "percent", "large"), [(1, 4, 85, 4096), (2, 5, 80, 0)])
def test_ngram_join(spark, monkeypatch, seed, n, percent, large):
    monkeypatch.setattr(ngram_join, "HEAVY_DF", 3)
    monkeypatch.setattr(ngram_join, "LARGE", large)
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", 200)
    docs = random_docs(seed)
    sets = {i: set(bag(t, n)) for i, t in docs}
    parent = {i: i for i, _ in docs}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in sets:
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and common * 100 >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    df = spark.createDataFrame(docs, DOCS).withColumns({"n": F.lit("x"), "g": F.lit(1), "key": F.lit(2)})
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.components(df, n=n, percent=percent).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i, _ in docs}


def test_ngram_join_of_odd_tables(spark):
    assert ngram_join.components(spark.createDataFrame([], DOCS)).collect() == []
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, None), (None, None)]
    got = sorted(((str(r["doc_id"]), r["component_id"]) for r in ngram_join.components(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert got == [("3", 3), ("3", 3), ("4", 4), ("None", 3), ("None", 3), ("None", None)]


def test_ngram_join_of_many_repeated_rows(spark):
    rng = random.Random(21)
    base = [f"w{rng.randrange(500)}" for _ in range(40)]
    near = [*base[:-1], "other"]
    rows = [(None, " ".join(base))] * 5000 + [(None, " ".join(near))] * 5000 + [(7, " ".join(near[:-1]))] * 2 + [(8, "one two")] * 3
    got = Counter((r["doc_id"], r["component_id"]) for r in ngram_join.components(spark.createDataFrame(rows, DOCS).repartition(6), n=4, percent=85).collect())
    assert got == {(None, 7): 10000, (7, 7): 2, (8, 8): 3}


def brute_leaks(docs, items, threshold=0.8):
    """Every window of an item's size, by multiset weights."""
    items = [(i, t) for i, t in items if split(t)]
    has = Counter(s for _, t in items for s in set(bag(t, min(5, len(split(t))))))
    weight = lambda s: 1 + np.log(len(items) / has[s]) if s in has else 1 + np.log(len(items))
    out = {}
    for d, text in docs:
        words = split(text)
        for i, t in items:
            m = len(split(t))
            n = min(5, m)
            want = Counter(bag(t, n))
            for at in range(max(1, len(words) - m + 1)):
                own = Counter(bag(" ".join(x.decode() for x in words[at : at + m]), n))
                keys = set(own) | set(want)
                top = sum(weight(s) * min(own[s], want[s]) for s in keys)
                low = sum(weight(s) * max(own[s], want[s]) for s in keys)
                if top / low >= threshold:
                    out[d, i] = max(out.get((d, i), 0), round(top / low, 6))
    return out


def test_decontamination(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(300)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.choice([3, 8, 20, 55])))) for k in range(12)] + [(20, ""), (21, None)]
    docs = [(0, None), (1, ""), (2, items[3][1]), (3, "w1 w2")]
    for k in range(10, 40):
        words = [rng.choice(vocab) for _ in range(rng.randint(5, 120))]
        if k % 2:
            inside = items[k % 12][1].upper().split()
            if len(inside) > 50 and k % 3:
                inside[25] = "other"
            at = rng.randrange(len(words))
            words[at:at] = inside
        docs.append((k, "\n".join(words)))
    df = spark.createDataFrame(docs, DOCS).withColumn("leaks", F.lit("old"))
    found = decontaminate.flag(df, spark.createDataFrame(items, "item_id bigint, text string"))
    got = {(r["doc_id"], x["item_id"]): round(x["similarity"], 6) for r in found.collect() for x in r["leaks"]}
    want = brute_leaks(docs, items)
    assert len(want) > 10 and got == want
    none = decontaminate.flag(df, spark.createDataFrame([], "item_id bigint, text string"))
    assert none.where(F.size("leaks") > 0).count() == 0 and none.count() == len(docs)


def test_decontamination_of_items_with_boilerplate(spark, monkeypatch):
    common = [f"c{k}" for k in range(60)]
    items = [(k, " ".join([*common, *(f"i{k}x{j}" for j in range(6))])) for k in range(12)]
    docs = []
    for k in range(24):
        words = items[k % 12][1].split()
        words[-1 - k % 3] = "changed"
        docs.append((k, " ".join(["before", *words, "after"])))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute_leaks(docs, items)
    for radius in (decontaminate.RADIUS, 0):  # candidates do not depend on the fingerprints
        monkeypatch.setattr(decontaminate, "RADIUS", radius)
        index = decontaminate.Index(items, 5, 0.8)
        got = {(d, x["item_id"]): round(x["similarity"], 6) for (d, _), found in zip(docs, index.leaks(pa.array([t for _, t in docs])), strict=True) for x in found}
        assert got == want and want
    assert decontaminate.flag(spark.createDataFrame(docs, DOCS), bench).where(F.size("leaks") > 0).count() == len({d for d, _ in want})


def test_blocks_of_the_benchmark_change_nothing(spark, monkeypatch):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(200)]
    common = " ".join(rng.choice(vocab) for _ in range(12))
    items = [(k, common + " " + " ".join(rng.choice(vocab) for _ in range(20))) for k in range(24)]
    items += [(k, t + f" extra{k}") for k, t in items[:6]] + [(30, ""), (31, None)]
    docs = []
    for k in range(60):
        inside = items[k % 24][1].split()
        for _ in range(k % 4):
            inside[rng.randrange(len(inside))] = "other"
        docs.append((k, " ".join([*(rng.choice(vocab) for _ in range(9)), *inside, *(rng.choice(vocab) for _ in range(9))])))
    docs, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id bigint, text string")
    leaks = lambda: {r["doc_id"]: [tuple(x) for x in r["leaks"]] for r in decontaminate.flag(docs, bench).collect()}
    want = leaks()
    monkeypatch.setattr(decontaminate, "MAX_CHARS", 900)
    got = leaks()
    assert got == want and 15 < sum(map(bool, want.values())) < 60


@pytest.mark.parametrize("span", [16, 1 << 15])
def test_long_texts_are_cut_without_loss(monkeypatch, span):
    monkeypatch.setattr(decontaminate, "SPAN", span)
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(30)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randint(6, 25)))) for k in range(8)]
    docs = [(k, " ".join(x for _ in range(6) for x in (rng.choice(items)[1], rng.choice(vocab)))) for k in range(6)]
    index = decontaminate.Index(items, 5, 0.8)
    got = {(d, x["item_id"]): round(x["similarity"], 6) for (d, _), found in zip(docs, index.leaks(pa.array([t for _, t in docs])), strict=True) for x in found}
    assert got == brute_leaks(docs, items) and len(got) > 15


def test_fingerprints_within_the_radius():
    rng = np.random.default_rng(1)
    prints, words = rng.integers(0, 1 << 63, 200, dtype=np.int64).astype(np.uint64), rng.integers(5, 8, 200)
    index = decontaminate.Prints(prints, words)
    probe, own = prints[:100].copy(), words[:100].copy()
    for k in range(100):
        for b in rng.choice(64, rng.integers(0, 16), replace=False):
            probe[k] ^= np.uint64(1) << np.uint64(b)
    own[:10] += 1
    w, m = index.candidates(probe, own)
    near = (np.bitwise_count(probe[:, None] ^ prints[None, :]) <= decontaminate.RADIUS) & (own[:, None] == words[None, :])
    assert set(zip(w.tolist(), m.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(near)), strict=True)) and 50 < near.sum() < 100


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


PIECES = ["a", "e", "é", "'", "'s", "re", " ", "  ", "\n", "\t", "1", "23", "!", "🙂", "日本", "<|endoftext|>", "<|endo", "ftext|>", "th", "ing", "ß", "\u0301", "..", "'ll", "\r\n", "\x00", "\u00a0"]


@pytest.mark.parametrize("leaf", [7, 64])
def test_bpe(spark, leaf):
    rng = random.Random(leaf)
    texts = [None, "", "<|endoftext|>", "x" * 500, "ab" * 300, " " * 200] + ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 120))) for _ in range(150)]
    df = spark.createDataFrame([*enumerate(texts), (1, ""), (3, texts[3]), (None, texts[4])], DOCS).withColumns({"ids": F.lit(0), "decoded": F.lit(0), "_key": F.lit("x"), "_text": F.lit(1), "a b": F.struct(F.lit(1).alias("x y"))})
    tok, back = library(), bpe.decode(bpe.encode(df, vocabulary(), leaf=leaf), vocabulary()).collect()
    assert len(back) == len(texts) + 3 and all(r['_key'] == 'x' and r["a b"]["x y"] == 1 for r in back)
    for r in back:
        want = tok.encode(r["text"] or "", add_special_tokens=False).ids
        assert list(r["ids"]) == want and r["decoded"] == tok.decode(want, skip_special_tokens=False)


def test_other_vocabulary_files_are_refused(tmp_path):
    import json

    spec = json.loads(Path(vocabulary()).read_text(encoding="utf-8"))
    swapped = [spec["model"]["merges"][1], spec["model"]["merges"][0], *spec["model"]["merges"][2:]]
    for k, change in enumerate(({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": spec["model"] | {"merges": swapped}})):
        (tmp_path / f"{k}.json").write_text(json.dumps(spec | change), encoding="utf-8")
        with pytest.raises(ValueError):
            bpe.Codec(str(tmp_path / f"{k}.json"))


def test_bpe_digest(spark):
    import hashlib

    df = spark.createDataFrame([(1, "hello world")], DOCS)
    r = bpe.digest(bpe.encode(df, vocabulary())).first()
    ids = library().encode("hello world", add_special_tokens=False).ids
    assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_hmm(spark, monkeypatch):
    monkeypatch.setattr(hmm_score, "CHUNK", 2000)
    monkeypatch.setattr(hmm_score, "PIECE", 500)
    monkeypatch.setattr(hmm_score, "PAIRS", 100)
    rng = random.Random(9)
    two = [[f"a{k}" for k in range(40)], [f"b{k}" for k in range(40)]]
    text = lambda: " ".join(rng.choice(two[rng.random() < 0.5][:n]) for n in [40] * rng.randint(0, 50))
    mono = lambda: " ".join(rng.choices(rng.choice(two), k=rng.randint(1, 50)))
    train = [(k, mono()) for k in range(120)] + [(200, None), (201, "")]
    test = [(300 + k, mono()) for k in range(30)] + [(400, None), (401, text()), (402, "never seen"), (402, "never seen"), (403, " ".join(mono() for _ in range(90)))]
    docs = spark.createDataFrame(train, DOCS)
    model, counts = hmm_score.train(docs)
    assert model.buckets > 1
    rows = {r["doc_id"]: r for r in hmm_score.score(spark.createDataFrame(test, DOCS).withColumn("id", F.lit(1)), model, counts).collect()}
    c = Counter(w for _, t in train for w in [*split(t), "end"])
    n, v = sum(c.values()), len(c)
    ratio = model.ratios()
    for d, t in test:
        tokens, r = [*split(t), "end"], rows[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(c[w] > 0 for w in tokens), n)
        base = sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        assert abs(r["base_score"] - base) < 1e-8
        classes = model.encode(*textops.words(pa.array([t])))[1]
        alpha, log = model.start * ratio[classes[0]], 0.0
        for k in classes[1:]:
            alpha = (alpha @ model.step) * ratio[k]
            log, alpha = log + np.log10(alpha.sum()), alpha / alpha.sum()
        assert abs(r["score"] - base - np.log10(alpha.sum()) - log) < 1e-8
    gain = [rows[300 + k]["score"] - rows[300 + k]["base_score"] for k in range(30)]
    assert sum(gain) > 0
    # expected counts are kept in single precision
    assert abs(model.emit.sum(axis=1) - 1).max() < 1e-6 and abs(model.step.sum(axis=1) - 1).max() < 1e-9
    empty, none = hmm_score.train(spark.createDataFrame([], DOCS))
    got = hmm_score.score(spark.createDataFrame([(1, "a b")], DOCS), empty, none).first()
    assert (got["n_tokens"], got["n_known"], got["train_tokens"], got["base_score"]) == (3, 0, 0, 0.0) and abs(got["score"]) < 1e-9


def plain_baum_welch(texts, rounds):
    """Start, steps, ratios by word and the log-likelihood of training texts after each round, token by token over whole texts."""
    texts = [[*split(t), None] for t in texts]
    c = Counter(w for t in texts for w in t)
    norm = sum(c.values()) + 0.1 * (len(c) + 1)
    q = {w: (n + 0.1) / norm for w, n in c.items()}
    known = 1 - 0.1 / norm
    word = lambda w: textops.words(pa.array([w.decode()]))[1][0] if w is not None else np.uint64(0)
    noise = {w: hmm_score.noise(np.array([word(w)], np.uint64))[0] for w in c}
    states = hmm_score.STATES
    ratio = {w: noise[w] * known / sum(q[x] * noise[x] for x in c) for w in c}
    start, step = np.full(states, 1 / states), np.full((states, states), 0.1 / (states - 1)) + np.eye(states) * (0.9 - 0.1 / (states - 1))
    logs = []
    for _ in range(rounds):
        s, a, g, log = np.zeros(states), np.zeros((states, states)), {w: np.zeros(states) for w in c}, 0.0
        for t in texts:
            alphas = [start * ratio[t[0]]]
            for w in t[1:]:
                alphas.append((alphas[-1] / alphas[-1].sum()) @ step * ratio[w])
            log += sum(np.log(x.sum()) for x in alphas)
            beta = np.ones(states)
            for k in range(len(t) - 1, -1, -1):
                post = alphas[k] * beta
                g[t[k]] += post / post.sum()
                if k:
                    pair = alphas[k - 1][:, None] * step * (ratio[t[k]] * beta)[None, :]
                    a += pair / pair.sum()
                    beta = step @ (ratio[t[k]] * beta)
                    beta /= beta.sum()
                else:
                    s += post / post.sum()
        logs.append(log)
        tokens = sum(g.values())
        start, step = (s + 1) / (s + 1).sum(), (a + 1) / (a + 1).sum(axis=1, keepdims=True)
        ratio = {w: (g[w] / q[w] + hmm_score.SHRINK) * known / (tokens + hmm_score.SHRINK * known) for w in c}
    return start, step, {word(w): r for w, r in ratio.items()}, logs


@pytest.mark.parametrize(("stretch", "chunk", "pairs"), [(7, 600, 20), (512, 1 << 20, 1 << 20)])
def test_hmm_training_is_baum_welch(spark, monkeypatch, stretch, chunk, pairs):
    """Against a plain restatement; stretches, chunks and buckets change nothing."""
    for name, value in (("CHUNK", chunk), ("PIECE", 300), ("PAIRS", pairs)):
        monkeypatch.setattr(hmm_score, name, value)
    rng = random.Random(3)
    two = [[f"a{k}" for k in range(12)], [f"b{k}" for k in range(12)]]
    texts = [" ".join(w for _ in range(rng.randint(0, 4)) for w in rng.choices(rng.choice(two), k=15)) for _ in range(40)]
    start, step, ratio, logs = plain_baum_welch(texts, 3)
    assert logs == sorted(logs)
    model, _ = hmm_score.train(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], DOCS), rounds=3)
    h, _, got = model.whole()
    assert np.allclose(model.start, start, rtol=1e-4) and np.allclose(model.step, step, rtol=1e-4)
    assert np.allclose(got[0], ratio[np.uint64(0)], rtol=1e-4) and set(h.tolist()) | {0} == {int(k) for k in ratio}
    assert all(np.allclose(got[k + 2], ratio[w], rtol=1e-4) for k, w in enumerate(h))
    monkeypatch.setattr(hmm_score, "STRETCH", stretch)
    first, codes = model.encode(*textops.words(pa.array(texts)))
    one = hmm_score.expectations(first, codes, model, got)
    logs = hmm_score.forward(first, codes, model, got)
    monkeypatch.setattr(hmm_score, "STRETCH", 1 << 20)
    assert all(np.allclose(x, y, rtol=1e-9, atol=1e-12) for x, y in zip(one, hmm_score.expectations(first, codes, model, got), strict=True))
    assert np.allclose(logs, hmm_score.forward(first, codes, model, got), rtol=1e-9)


def test_expected_counts_add_up():
    model = hmm_score.Model(200, 11, 5)
    rng = np.random.default_rng(2)
    classes, ratio = rng.integers(0, 12, 1300).astype(np.int32), rng.uniform(0.1, 3, (12, hmm_score.STATES))
    start, step, emit = hmm_score.expectations(np.array([0, 5, 5, 1300]), classes, model, ratio)
    assert abs(start.sum() - 2) < 1e-6 and abs(emit.sum() - 1300) < 1e-6 and abs(step.sum() - 1298) < 1e-6


def test_hmm_of_held_out_documents(spark):
    folder = Path("/root/testdata/sf0.01")
    if not folder.exists():
        pytest.skip("no tables here")
    got = QUERIES["op2_hmm_score"](spark, str(folder)).where("held_out AND n_tokens > 1")
    r = got.agg((F.sum("score") / F.sum("n_tokens")).alias("own"), (F.sum("base_score") / F.sum("n_tokens")).alias("base"), F.avg((F.col("score") > F.col("base_score")).cast("int")).alias("better")).first()
    assert r["own"] > r["base"] + 0.15 and r["better"] > 0.95


def test_language_id(spark):
    rng = random.Random(6)
    stems = {"aa": ["wen", "lor", "fim", "dak"], "bb": ["chi", "zun", "qua", "pli"]}
    make = lambda lang, n: " ".join("".join(rng.choices(stems[lang], k=2)) for _ in range(n))
    train = [(k, make(lang, 30), lang) for k in range(40) for lang in stems] + [(90, "zzz", None), (91, None, "aa")]
    model = language_id.train(spark.createDataFrame(train, "doc_id bigint, text string, lang string"))
    assert model[0] == ["aa", "bb"]
    tests = [(1, make("aa", 10)), (2, make("bb", 3)), (3, make("aa", 40) + " " + make("bb", 20)), (4, None), (5, "12 34 !"), (6, ""), (1, make("aa", 10))]
    df = spark.createDataFrame(tests, DOCS).withColumns({"score": F.lit("old"), "Languages": F.lit(1)})
    got = {r["doc_id"]: r for r in language_id.identify(df, model).collect()}
    assert [got[k]["lang_pred"] for k in range(1, 7)] == ["aa", "bb", "aa", "und", "und", "und"]
    assert got[3]["languages"] == ["aa", "bb"] and 0.55 < got[3]["score"] < 0.8 and got[1]["score"] == 1 and got[4]["score"] == 0
    none = language_id.train(spark.createDataFrame([], "doc_id bigint, text string, lang string"))
    assert language_id.identify(df, none).where("lang_pred = 'und'").count() == len(tests)


def plain_language_id(train, texts):
    """Language, score and set of each text, word by word."""
    grams = lambda w: [bytes((b" " + w + b" ")[i : i + 3]) for i in range(len(w))]
    slot = lambda g: ((g[0] * 0x1F35 ^ g[1] * 0x9E3779B1 & 0xFFFFFFFF ^ g[2] * 0x85EBCA77 & 0xFFFFFFFF) * 0xC2B2AE35 & 0xFFFFFFFF) >> 16
    counts = {}
    for t, lang in train:
        if t is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(slot(g) for w in split(t) for g in grams(w))
    names = sorted(counts)
    log = lambda g, lang: np.log((counts[lang][slot(g)] + 0.05) / (sum(counts[lang].values()) + 0.05 * language_id.BINS))
    out = []
    for t in texts:
        if not any(ch.isalpha() for ch in t or ""):
            out.append(("und", 0.0, []))
            continue
        words = [np.array([sum(log(g, lang) for g in grams(w)) for lang in names]) for w in split(t)]

        def fit(allowed, words=words):
            share = np.array(allowed, float) / sum(allowed)
            lik = [np.exp(np.maximum(w - w.max(), -60)) for w in words]
            for _ in range(language_id.ROUNDS):
                share = sum(x * share / (x * share).sum() for x in lik) / len(lik)
            return share, sum(np.log((x * share).sum()) + w.max() for x, w in zip(lik, words, strict=True))

        whole, share = sum(words), fit([1] * len(names))[0]
        chosen = [s >= language_id.MIN_SHARE or s == max(share) for s in share]
        best, score, found = names[int(whole.argmax())], 1.0, None
        if sum(chosen) > 1:
            share, log_fit = fit(chosen)
            if log_fit - 0.5 * np.log(len(words)) * (sum(chosen) - 1) > whole.max():
                best, score, found = names[int(share.argmax())], share.max(), [x for x, s in zip(names, share, strict=True) if s >= language_id.MIN_SHARE]
        out.append((best, score, found or [best]))
    return out


@pytest.mark.parametrize("piece", [60, 1 << 20])
def test_language_id_is_the_mixture(spark, monkeypatch, piece):
    """Against a plain restatement; how texts are cut changes nothing."""
    monkeypatch.setattr(language_id, "PIECE", piece)
    rng = random.Random(16)
    stems = {"aa": ["wen", "lor", "fi", "dak"], "bb": ["chi", "zu", "qua", "lor"], "cc": ["fi", "ßü", "ka", "dak"]}
    make = lambda lang, n: " ".join("".join(rng.choices(stems[lang], k=2)) for _ in range(n))
    train = [(make(lang, 12), lang) for _ in range(8) for lang in stems] + [("zzz", None), (None, "aa")]
    texts = [make(rng.choice(list(stems)), rng.randint(1, 9)) for _ in range(15)] + [make("aa", 12) + " " + make("bb", rng.randint(1, 30)) for _ in range(15)] + [make("cc", 5) + " " + make("bb", 6) + " " + make("aa", 7), None, "", "12", "Lor " * 30]
    model = language_id.train(spark.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate(train)], "doc_id bigint, text string, lang string"))
    rows = language_id.identify(spark.createDataFrame(list(enumerate(texts)), DOCS), model).orderBy("doc_id").collect()
    want = plain_language_id(train, texts)
    assert [(r["lang_pred"], r["languages"]) for r in rows] == [(x[0], x[2]) for x in want]
    assert np.allclose([r["score"] for r in rows], [x[1] for x in want], atol=1e-4) and any(0 < x[1] < 1 for x in want)


def test_language_id_of_held_out_documents(spark):
    folder = Path("/root/testdata/sf0.01")
    if not folder.exists():
        pytest.skip("no tables here")
    got = QUERIES["op10_language_id"](spark, str(folder)).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id")
    share = got.where("held_out AND lang IS NOT NULL").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert share[1] > 100 and share[0] >= 0.98
