import random
from collections import Counter
from zlib import crc32

import pytest
from test_text_operators import bag, brute_leaks, library, plain_language_id

import corpus_pipeline
from graphkin.llm.queries import ORACLE_SQL, QUERIES, vocabulary

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def folder(spark, tmp_path):
    rng = random.Random(11)
    stems = {"aa": ["wen", "lor", "fim", "dak", "tos"], "bb": ["chi", "zun", "qua", "pli", "rem"]}
    make = lambda lang, n: " ".join("".join(rng.choices(stems[lang], k=3)) for _ in range(n))
    leak, copy = make("aa", 30), make("bb", 80)
    near = copy.split()
    near[40] = "changed"
    docs = [(k, make(("aa", "bb")[k % 2], 50), ("aa", "bb")[k % 2]) for k in range(40)]
    docs += [(50, copy, "bb"), (51, copy, "bb"), (52, " ".join(near), "bb"), (53, make("aa", 20) + " " + leak + " " + make("aa", 20), "aa"), (54, "12 !! 34", "aa"), (55, None, "aa"), (56, "", None), (None, make("aa", 30), "aa"), (0, docs[0][1], "aa")]
    rows = [(d, t, lang, "s", len(t or "")) for d, t, lang in docs]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak), (2, make("bb", 25))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_pipeline(spark, folder):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "decontamination", "bpe"]
    out = corpus_pipeline.run(spark, folder)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out.select("doc_id").collect())
    assert got == [(False, k) for k in [*range(40), 50]] + [(True, 0)]
    from graphkin.llm.bpe import codec

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    bpe = codec(vocabulary())
    for r in out.where("doc_id IS NOT NULL").collect():
        assert list(r["ids"]) == bpe.encode(texts[r["doc_id"]]).tolist() and r["n_tokens"] == len(r["ids"])


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_near_copies_of_null_and_repeated_ids(spark, folder):
    rng = random.Random(5)
    make = lambda: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(60))
    near = lambda text: text.rsplit(" ", 1)[0] + " changed"
    a, b, c, d = (make() for _ in range(4))
    rows = [(1, a), (None, near(a)), (None, b), (None, near(b)), (7, c), (8, near(c)), (8, d), (8, d), (9, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "x", "s", 0) for i, t in rows], SCHEMA)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, folder).collect()]
    assert len(got) == 6 and {(1, a), (7, c), (8, d), (9, None), (None, "")} < set(got) and {b, near(b)} & {t for _, t in got}


def plain_pipeline(rows, items):
    """(id, text, tokens) of the documents that stay, stage by stage."""
    train = [(t, lang) for d, t, lang in rows if crc32(("" if d is None else str(d)).encode()) % 5]
    found = plain_language_id(train, [t for _, t, _ in rows])
    kept = [r for r, (lang, score, _) in zip(rows, found, strict=True) if lang != "und" and score >= corpus_pipeline.MIN_LANGUAGE_SHARE]
    distinct = sorted({(d, t) for d, t, _ in kept}, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    sets = [set(bag(t, 5)) for _, t in distinct]
    group = list(range(len(distinct)))
    find = lambda v: v if group[v] == v else find(group[v])
    for b in range(len(distinct)):
        for a in range(b):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and common * 100 >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                group[y] = x
    groups = {}
    for k, row in enumerate(distinct):
        groups.setdefault(find(k) if sets[k] else (k,), []).append(row)
    leaks = lambda t: bool(brute_leaks([(0, t)], items))
    encode = lambda t: tuple(library().encode(t, add_special_tokens=False).ids)
    # of a group without ids any row may stay, so it is known by all its texts
    return [(d, [(t, encode(t)) for e, t in members if e == d]) for members in groups.values() for d in [members[0][0]] if not leaks(members[0][1])]


@pytest.mark.parametrize("seed", [1, 2])
def test_pipeline_against_brute_force(spark, tmp_path, seed):
    rng = random.Random(seed)
    stems = {"aa": ["wen", "lor", "fi", "dak", "tos"], "bb": ["chi", "zu", "qua", "pli", "rem"]}
    make = lambda lang, n: " ".join("".join(rng.choices(stems[lang], k=2)) for _ in range(n))
    items = [(k, make(rng.choice("ab") * 2, rng.randint(8, 20))) for k in range(4)]
    rows = []
    for k in range(45):
        lang = rng.choice("ab") * 2
        text = make(lang, rng.randint(3, 45))
        if k % 9 == 0:
            text = f"{text} {items[k % 4][1]} {make(lang, 5)}"
        if k % 7 == 0:
            text = make("aa", 20) + " " + make("bb", 20)
        rows.append((rng.choice([None, k, k, k, k - 1]), text, lang if k % 11 else None))
        for _ in range(rng.choice([0, 0, 1, 3])):
            words = text.split()
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = make(lang, 1)
            rows.append((rng.choice([None, 100 + len(rows), k]), " ".join(words), lang))
    rows += [(900, None, "aa"), (901, "", None), (902, "12 34", "bb"), rows[3], rows[3]]
    spark.createDataFrame([(d, t, lang, "s", len(t or "")) for d, t, lang in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    want = plain_pipeline(rows, items)
    assert sum(got.values()) == len(want) and len(want) < len(rows) - 10
    for d, members in want:
        match = next((key for _, ids in members for key in [(d, ids)] if got[key]), None)
        assert match, (d, members)
        got[match] -= 1


def test_names():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 11)) and set(ORACLE_SQL) <= set(QUERIES)
