import gzip
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphkin.llm import chat_format, pivot_search, textops, training_order, url_filter, warc
from graphkin.llm.common import shared_dir, store
from graphkin.llm.queries import CONTROL_TEXT, URL_RULES, vocabulary


def test_pivot_search(spark, monkeypatch):
    monkeypatch.setattr(pivot_search, "QUERY_BLOCK", 7)
    monkeypatch.setattr(pivot_search, "CANDIDATES", 50)
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in np.round(rng.normal(size=6), 2 if k % 3 else 0)]) for k in range(220)]
    rows += [(300, rows[50][1]), (301, rows[50][1]), (300, rows[50][1]), (302, None), (303, [float("nan")] * 6), (304, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (305, [float("inf")] * 6), (306, [1.0]), (350, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("id", F.lit("x"))
    ok = [(k, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for k, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    want = Counter()
    for i, (q, own) in enumerate(ok):
        if q % 50 == 0:
            best = sorted((-int(own @ v), k) for j, (k, v) in enumerate(ok) if j != i and len(v) == len(own))[:5]
            want.update((q, r, k, -s) for r, (s, k) in enumerate(best, 1))
    for pivots in (0, 3, 64):
        found = pivot_search.top_k(df, F.col("id") % 50 == 0, pivots=pivots)
        assert Counter(tuple(r) for r in found.select("query_id", "rank", "vec_id", "score").collect()) == want
    assert pivot_search.top_k(df.limit(0), F.col("id") % 50 == 0).count() == 0


def test_pivots_eliminate(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(8, 48))
    df = spark.createDataFrame([(k, [float(x) for x in rng.normal(size=8) @ base]) for k in range(3000)], "vec_id bigint, embedding array<float>")
    share = lambda pivots: pivot_search.top_k(df, F.col("id") % 50 == 0, pivots=pivots).agg(F.avg("evaluated")).first()[0] / 3000
    assert share(8) < 0.05 < share(1)


def test_pivot_search_keeps_other_rows_of_one_id(spark):
    rows = [(0, [1.0, 0.0]), (5, [0.5, 0.25]), (5, [0.5, 0.75]), (5, [0.5, 0.75]), (6, [0.25, 0.0])]
    found = pivot_search.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), F.col("id") == 0, k=4)
    assert [(r["rank"], r["vec_id"], r["score"]) for r in found.orderBy("rank").collect()] == [(k, 5, 128 * 256) for k in (1, 2, 3)] + [(4, 6, 64 * 256)]


@pytest.mark.parametrize("size", [1, 2, 5, 64, 1000])
def test_feistel_is_a_permutation(size):
    assert sorted(training_order.feistel(np.arange(size), size, 42).tolist()) == list(range(size))


def test_training_order(spark):
    rng = random.Random(8)
    texts = [(k, "" if k == 3 else None if k == 4 else " ".join(rng.choices(["alpha", "beta", "été"], k=rng.randint(1, 60)))) for k in range(40)] + [(None, "none"), (-5, "below zero"), (7, "again")]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").withColumn("id", F.lit(1))
    make = lambda d, key: training_order.materialise(d, vocabulary(), key=key, length=16, shard_bytes=1500)
    manifest = make(df, 1)
    rows = training_order.read_slots(manifest).orderBy("slot").collect()
    assert manifest.count() > 1 and [r["slot"] for r in rows] == list(range(len(rows)))
    from graphkin.llm.bpe import codec

    bpe, want = codec(vocabulary()), []
    for d, t in texts:
        ids = [*bpe.encode(t or "").tolist(), 50256]
        want += [(str(d), k // 16, tuple(ids[k : k + 16])) for k in range(0, len(ids), 16)]
    assert sorted((str(r["id"]), r["k"], tuple(np.frombuffer(r["tokens"], "<u2").tolist())) for r in rows) == sorted(want)
    part = training_order.read_slots(manifest, 5, 17).orderBy("slot").collect()
    assert part == rows[5:17]
    assert training_order.read_slots(make(df.repartition(5), 1)).orderBy("slot").collect() == rows
    assert [r["id"] for r in training_order.read_slots(make(df, 2)).orderBy("slot").collect()] != [r["id"] for r in rows]
    assert make(df.limit(0), 1).count() == 0


def test_shards_of_short_texts(spark, monkeypatch):
    monkeypatch.setattr(training_order, "GROUP", 3)
    df = spark.createDataFrame([(k, f"t{k}") for k in range(500)], "doc_id bigint, text string")
    manifest = training_order.materialise(df, vocabulary(), length=64, shard_bytes=50 * (16 + 128))
    rows = manifest.orderBy("shard").collect()
    assert len(rows) == 10 and max(r["records"] for r in rows) < 100
    assert [r["first_slot"] for r in rows] == np.cumsum([0, *(r["records"] for r in rows)])[:-1].tolist()
    got = training_order.read_slots(manifest).orderBy("slot").collect()
    assert [r["slot"] for r in got] == list(range(500)) and sorted(r["id"] for r in got) == list(range(500))


def test_places_are_those_of_a_plain_feistel():
    def plain(x, size, key):
        half = max(1, -(-max(1, (size - 1).bit_length()) // 2))
        mix = lambda v: int(textops.mix(np.array([v & (2**64 - 1)], np.uint64))[0])
        while True:
            left, right = x >> half, x % (1 << half)
            for r in range(1, 5):
                left, right = right, left ^ (mix(right + mix(r * 0x9E3779B97F4A7C15 + key)) % (1 << half))
            x = left << half | right
            if x < size:
                return x

    for size, key in ((1000, 7), (37, 123456789)):
        assert training_order.feistel(np.arange(size), size, key).tolist() == [plain(x, size, key) for x in range(size)]


def windows_of(turns, budget, history):
    """A plain restatement of the windows."""
    t = [chat_format.OVERHEAD + len([w for w in x.replace("\x0b", " ").split()]) for _, x in turns]
    sys = 1 if turns and turns[0][0] == "system" else 0
    room = max(1, (budget - history - (t[0] if sys else 0)) // 2)
    out, total, last = [], 0, None
    for i in range(len(turns)):
        total += t[i]
        stretch = (total - 1) // room
        if stretch != last:
            back = []
            if i - 1 >= sys and t[i - 1] <= history:
                back = [i - 1]
                if i - 2 >= sys and t[i - 1] + t[i - 2] <= history:
                    back = [i - 2, i - 1]
            out.append([([0] if sys and i else []) + (back if i else []), []])
            last = stretch
        out[-1][1].append(i)
    return out


def escaped(x):
    return x.replace("\\", "\\e").replace("<", "\\l").replace("[", "\\b")


def test_chat_windows(spark):
    rng = random.Random(2)
    conversations = {}
    for c in range(12):
        turns = [("system", "be [kind] <s> \\l")] if c % 3 == 0 else []
        turns += [(("user", "assistant")[k % 2], " ".join(rng.choices(["a", "<s>", "[INST]", "\\b", "é🙂", CONTROL_TEXT, "\\"], k=rng.randint(0, 25)))) for k in range(rng.randint(1, 30))]
        conversations[c] = turns
    rows = [(c, k, r, x) for c, turns in conversations.items() for k, (r, x) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({"t": F.lit(1), "f": F.lit("x"), "sys": F.lit(0)})
    made = chat_format.format_windows(df.repartition(3), budget=80, history=20)
    got = {}
    for r in made.orderBy("conv_id", "window").collect():
        got.setdefault(r["conv_id"], []).append(r)
    one = lambda role, x: f"<s>{escaped(role)}[INST]{escaped(x)}[/INST]</s>"
    for c, turns in conversations.items():
        want = windows_of(turns, 80, 20)
        assert len(want) == len(got[c])
        for (old, new), r in zip(want, got[c], strict=True):
            assert r["formatted"] == "".join(one(*turns[i]) for i in old + new) and r["n_repeated"] == len(old) and r["n_new"] == len(new)
            loss = [r["formatted"][s["start"] - 1 : s["start"] - 1 + s["len"]] for s in r["loss_spans"]]
            assert loss == [escaped(turns[i][1]) for i in new if turns[i][0] == "assistant"]
            big = any(chat_format.OVERHEAD + len(turns[i][1].split()) > (80 - 20) // 2 - 10 for i in new)
            assert not r["over_budget"] or big
    back = {r["conv_id"]: r for r in chat_format.read_back(made).collect()}
    for c, turns in conversations.items():
        assert [tuple(x) for x in back[c]["turns"]] == turns
        assert back[c]["loss_text"] == "".join(x for r, x in turns if r == "assistant")


def test_chat_edges(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    rows = [(1, None, None, None), (1, 2, "user", ""), (None, 1, "user", "x"), (2, 1, "user", "same"), (2, 1, "user", "same")]
    back = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chat_format.read_back(chat_format.format_windows(spark.createDataFrame(rows, schema))).collect()}
    assert back == {1: [("", ""), ("user", "")], None: [("user", "x")], 2: [("user", "same")] * 2}
    assert chat_format.read_back(chat_format.format_windows(spark.createDataFrame([], schema))).count() == 0


def test_url_rules(spark):
    cases = {
        "http://A.Example.ORG/es/1": ("a.example.org", "/es/1", "example.org/es/", "block"),
        "https://example.org/en/12?x=/": ("example.org", "/en/12", "example.org/en/1", "block"),
        "https://example.org": ("example.org", "", None, "allow"),
        "x://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "http://b.com/de/#f": ("b.com", "/de/", "com/de/", "block"),
        "http://b.com/fr/": ("b.com", "/fr/", "com/fr/", "allow"),
        "no scheme": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "http://u.net?q=http://v.org/": ("u.net", "", None, "allow"),
    }
    df = spark.createDataFrame(list(enumerate(cases)), "page_id bigint, url string").withColumns({"Host": F.lit("old"), "n": F.lit(1), "kappa": F.lit(1), "_by_rule": F.lit(7), "domain": F.lit("d")})
    none = spark.createDataFrame([], "host string, bad int")
    got = {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df, none, URL_RULES).where("_by_rule = 7 AND domain = 'd'").collect()}
    assert got == cases


def test_domains(spark):
    hosts = {
        "a.b.example.org": ("example.org", "org"),
        "a.b.example.co.uk": ("example.co.uk", "co.uk"),
        "co.uk": ("co.uk", "co.uk"),
        "user@www.x.net:8080": ("x.net", "net"),
        "x.net.": ("x.net", "net"),
        "10.0.0.7:80": ("10.0.0.7", ""),
        "[::1]": ("[::1]", ""),
        "localhost": ("localhost", "localhost"),
        "": ("", ""),
        "a.city.kawasaki.jp": ("kawasaki.jp", "jp"),
    }
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    assert {r["host"]: (r["domain"], r["suffix"]) for r in url_filter.with_domains(df).collect()} == hosts
    table = spark.createDataFrame([("org",), ("uk",), ("co.uk",), ("kawasaki.jp",), ("jp",), ("Net",)], "suffix string")
    listed = hosts | {"a.city.kawasaki.jp": ("city.kawasaki.jp", "kawasaki.jp")}
    assert {r["host"]: (r["domain"], r["suffix"]) for r in url_filter.with_domains(df, table).collect()} == listed


def test_host_reputation(spark):
    labels = [("bad.spam.net", 1)] * 40 + [("ok.fine.net", 0)] * 40 + [("new.spam.net", 1), ("mixed.fine.net", 1), ("mixed.fine.net", None)] + [(f"h{k}.fine.net", 0) for k in range(30)]
    urls = ["http://bad.spam.net/", "http://ok.fine.net/", "http://mixed.fine.net/", "http://unknown.org/"]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id bigint, url string")
    got = [r["verdict"] for r in url_filter.judge(pages, spark.createDataFrame(labels, "host string, bad int"), []).orderBy("page_id").collect()]
    assert got == ["block", "allow", "allow", "allow"]


def test_warc(spark):
    long = "<p>" + "é\r\n\r\n" * 60
    rows = [(5, "http://a/\r\nX: y", long), (3, "u", long), (9, None, long), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (7, "u", "x" * 100), (8, "u", "x" * 100), (None, "u", long)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"digest": F.lit("d"), "first": F.lit(1), "id": F.lit(0)})
    manifest = warc.archive(df.repartition(3))
    records = warc.read(manifest).collect()
    assert len(records) == len(rows) == sum(r["records"] for r in manifest.collect())
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in records if r["payload"] is not None} == {k: t or "" for k, _, t in rows if k in (1, 2, 3, 4, 6, 7)}
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.resolve_revisits(warc.read(manifest)).collect()}
    head = {5: 3, 9: 3, None: 3, 8: 7}
    for k, _, t in rows:
        raw = (t or "").encode()
        assert got[k] == (len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if k in head else "response", head.get(k))
    assert warc.archive(df.limit(0)).count() == 0
    fs, path = store(manifest.first()["path"])
    with fs.open_input_file(path) as f:
        assert gzip.decompress(f.read()).startswith(b"WARC/1.1\r\n")


def test_archives_are_written_once(spark, tmp_path):
    folder = f"file://{tmp_path}/warc"
    pages = spark.createDataFrame([(k, "u", "x" * 200 if k % 3 else f"page {k} " * 40) for k in range(90)], "page_id bigint, url string, html string").repartition(5)
    manifest = warc.archive(pages, folder=folder)
    for _ in range(2):
        assert warc.resolve_revisits(warc.read(manifest)).count() == 90
    assert sorted(f"file://{p}" for p in (tmp_path / "warc").iterdir()) == sorted(r["path"] for r in manifest.collect())


def test_warc_of_text_ids_and_lost_responses(spark):
    long = "y" * 300
    pages = spark.createDataFrame([("b/1 é", "u", long), ("a>\r\n", "u", long), ("", "u", "short"), (None, "u", "z")], "page_id string, url string, html string")
    records = warc.read(warc.archive(pages), "string")
    got = {(r["page_id"], r["record_type"], r["refers_to"]) for r in records.collect()}
    assert got == {("a>\r\n", "response", None), ("b/1 é", "revisit", "a>\r\n"), ("", "response", None), (None, "response", None)}
    assert [r["payload_bytes"] for r in warc.resolve_revisits(records.where("record_type = 'revisit'")).collect()] == [None]


def test_many_records_in_one_archive(spark, tmp_path):
    folder = shared_dir(spark, "many")
    pages = spark.range(300).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.concat(F.col("id").cast("string"), F.lit("-")), 200).alias("html")).coalesce(1)
    assert warc.read(warc.archive(pages, folder=folder)).select("page_id").distinct().count() == 300
