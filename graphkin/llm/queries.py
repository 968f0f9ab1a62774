"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, decontaminate, hmm_score, language_id, ngram_join, pivot_search, training_order, url_filter, warc
from .common import bucket_of, table

WORD_SQL = r"'[^\x20\x09-\x0D]+'"
LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    fixed = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text")
    )
    back = chat_format.read_back(chat_format.format_windows(conversations.unionByName(fixed)))
    nl = F.lit("\n")
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], nl, t["text"], nl)), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP6_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (
  SELECT *, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 4 AS t,
    20 + length(role || text) + len(regexp_extract_all(role || text, '[\\<\[]')) AS n,
    row_number() OVER o AS i
  FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), p AS (
  SELECT *, sum(t) OVER o AS p, max(CASE WHEN i = 1 AND role = 'system' THEN t END) OVER (PARTITION BY conv_id) AS st,
    max(CASE WHEN i = 1 AND role = 'system' THEN n END) OVER (PARTITION BY conv_id) AS sn,
    lag(t, 1) OVER o AS t1, lag(t, 2) OVER o AS t2, lag(n, 1) OVER o AS n1, lag(n, 2) OVER o AS n2
  FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY i)
), s AS (
  SELECT *, (p - 1)::BIGINT // greatest(1, (1024 - 256 - coalesce(st, 0)) // 2)::BIGINT AS stretch FROM p
), w AS (
  SELECT *, i > 1 AND stretch <> lag(stretch, 1) OVER (PARTITION BY conv_id ORDER BY i) AS later,
    i > 1 AND NOT (i = 2 AND st IS NOT NULL) AND t1 <= 256 AS h1,
    i > 2 AND NOT (i = 2 AND st IS NOT NULL) AND NOT (i = 3 AND st IS NOT NULL) AND t1 <= 256 AND t1 + t2 <= 256 AS h2
  FROM s
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n + CASE WHEN later THEN coalesce(sn, 0) + CASE WHEN h1 THEN n1 ELSE 0 END + CASE WHEN h2 THEN n2 ELSE 0 END ELSE 0 END)::BIGINT AS formatted_chars
FROM w GROUP BY conv_id
"""


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcome of a page is that of the labels row with its id: bad if of low quality or toxic."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    labelled = pages.join(labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")), "page_id").select(url_filter.host_of(F.col("url")).alias("host"), "bad")
    return url_filter.judge(pages, labelled, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


OP7_SQL = r"""
WITH pg AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), hosts AS (
  SELECT host, count(*) AS n, sum(bad) AS bad,
    dom(host) AS domain, suf(host) AS suffix
  FROM (SELECT pg.host, CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END AS bad FROM pg JOIN labels ON page_id = doc_id)
  WHERE bad IS NOT NULL GROUP BY host
), domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
top AS (SELECT (coalesce(sum(bad), 0) + 0.5::DOUBLE) / (coalesce(sum(n), 0) + 1.0::DOUBLE) AS r0 FROM suffixes),
k1 AS (SELECT greatest(0.001, least(0.5, coalesce((sum(n * (bad::DOUBLE / n - r0) * (bad::DOUBLE / n - r0)) - sum(r0 * (1 - r0))) / nullif(sum(r0 * (1 - r0) * (n - 1)), 0), 0.5))) AS rho FROM suffixes, top),
s AS (SELECT suffix, ((1 / rho - 1) * r0 + bad) / (1 / rho - 1 + n) AS r1 FROM suffixes, top, k1),
ds AS (SELECT * FROM domains JOIN s USING (suffix)),
k2 AS (SELECT greatest(0.001, least(0.5, coalesce((sum(n * (bad::DOUBLE / n - r1) * (bad::DOUBLE / n - r1)) - sum(r1 * (1 - r1))) / nullif(sum(r1 * (1 - r1) * (n - 1)), 0), 0.5))) AS rho FROM ds),
d AS (SELECT domain, ((1 / rho - 1) * r1 + bad) / (1 / rho - 1 + n) AS r2 FROM ds, k2),
hd AS (SELECT * FROM hosts JOIN d USING (domain)),
k3 AS (SELECT 1 / greatest(0.001, least(0.5, coalesce((sum(n * (bad::DOUBLE / n - r2) * (bad::DOUBLE / n - r2)) - sum(r2 * (1 - r2))) / nullif(sum(r2 * (1 - r2) * (n - 1)), 0), 0.5))) - 1 AS kappa FROM hd),
j AS (
  SELECT pg.*, kappa * coalesce(r2, r1, r0) + coalesce(h.bad, 0) AS a, kappa * (1 - coalesce(r2, r1, r0)) + coalesce(h.n, 0) - coalesce(h.bad, 0) AS b
  FROM pg LEFT JOIN hosts h ON pg.host = h.host
  LEFT JOIN d ON d.domain = dom(pg.host) LEFT JOIN s ON s.suffix = suf(pg.host), top, k3
), m AS (
  SELECT page_id, host, path, CASE WHEN a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.5 THEN 'block' ELSE 'allow' END AS own,
    CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
      WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
      WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
      WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
      WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM j
)
SELECT page_id, host, path, rule, CASE WHEN rule IS NULL THEN own WHEN rule IN ('org/', 'com/fr/') THEN 'allow' ELSE 'block' END AS verdict FROM m
"""
_NAME = r"regexp_replace(regexp_replace(HOST, '(?s)^.*@', ''), '\.?(:[0-9]*)?$', '')"
_LAST = r"array_to_string(list_slice(string_split(NAME, '.'), -(CASE WHEN regexp_matches(NAME, '(^|\.)(co|com|org|net|ac|gov|edu)\.[a-z]{2}$') THEN 2 ELSE 1 END + MORE), -1), '.')"
_PICK = r"CASE WHEN regexp_matches(NAME, '^([0-9]+(\.[0-9]+){3}|\[.*)$') THEN OTHER ELSE LAST END"


def _domains(sql: str) -> str:
    """The functions dom and suf of a host, written out."""
    for host in ("host", "pg.host"):
        for f, more, other in (("dom", "1", "NAME"), ("suf", "0", "''")):
            sql = sql.replace(f"{f}({host})", _PICK.replace("LAST", _LAST).replace("MORE", more).replace("OTHER", other).replace("NAME", _NAME).replace("HOST", host))
    return sql


OP7_SQL = _domains(OP7_SQL)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = vocabulary()
    both = bpe.decode(bpe.encode(docs, path).drop("text"), path)
    return bpe.digest(both.withColumn("decoded_sha256", F.sha2(F.col("decoded").cast("binary"), 256)).drop("decoded")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = bucket_of(F.col("doc_id"), 5) == 0
    model = language_id.train(docs.where(~held_out))
    return language_id.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op6_chat_format": op6_chat_format,
    "op7_url_filter": op7_url_filter,
    "op9_bpe": op9_bpe,
    "op10_language_id": op10_language_id,
}
ORACLE_SQL: dict[str, str] = {"op6_chat_format": OP6_SQL, "op7_url_filter": OP7_SQL}


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.components(docs, n=4, percent=85).select("doc_id", "n_shingles", "component_id")


QUERIES["op1_ngram_join"] = op1_ngram_join
ORACLE_SQL["op1_ngram_join"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER_SQL}, {WORD_SQL}) AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 85 * (p.c + q.c - k)),
r(doc_id, node) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, y FROM r JOIN links ON node = x)
SELECT r.doc_id, coalesce(max(n.c), 0)::BIGINT AS n_shingles, min(node) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that it leaks."""
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text")
    found = decontaminate.flag(docs, items).select("doc_id", F.explode("leaks").alias("l"))
    return found.select("doc_id", "l.item_id", F.col("l.start").cast("long").alias("start_word"), F.col("l.n_words").cast("long").alias("n_words"), F.round("l.similarity", 6).alias("similarity"))


QUERIES["op4_decontaminate"] = op4_decontaminate


def op2_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = bucket_of(F.col("doc_id"), 10) == 0
    model, counts = hmm_score.train(docs.where(~held_out))
    return hmm_score.score(docs, model, counts).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pivot_search.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)
    return found.select(F.col("query_id").cast("long").alias("query_id"), "rank", F.col("vec_id").cast("long").alias("vec_id"), "score")


def op5_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each sequence, read back from the shards."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    manifest = training_order.materialise(docs, vocabulary(), key=20240917)
    return training_order.digest(training_order.read_slots(manifest)).select("slot", F.col("id").alias("doc_id"), F.col("k").alias("sequence"), "n_tokens", "tokens_sha256")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.resolve_revisits(warc.read(warc.archive(table(spark, sf_dir, "pages"))))


QUERIES |= {"op2_hmm_score": op2_hmm_score, "op3_pivot_search": op3_pivot_search, "op5_training_order": op5_training_order, "op8_warc": op8_warc}
ORACLE_SQL["op3_pivot_search"] = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r AS q, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
ORACLE_SQL["op8_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, octet_length(encode(t))::BIGINT AS payload_bytes, sha256(t) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS head FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN head = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN head <> page_id THEN head END AS refers_to FROM f
"""
ORACLE_SQL["op4_decontaminate"] = rf"""
WITH iw AS (SELECT item_id, regexp_extract_all({LOWER_SQL}, {WORD_SQL}) AS ws FROM benchmark),
i AS (SELECT row_number() OVER (ORDER BY item_id, ws) AS k, item_id, ws, len(ws) AS m, least(5, len(ws)) AS n FROM iw WHERE len(ws) > 0),
ish AS (SELECT k, m, n, array_to_string(ws[p:p+n-1], ' ') AS s FROM (SELECT *, unnest(range(1, m - n + 2)) AS p FROM i)),
w AS (SELECT n, s, 1 + ln((SELECT count(*) FROM i) / count(DISTINCT k)::DOUBLE) AS weight FROM ish GROUP BY n, s),
bag AS (SELECT k, m, n, s, count(*) AS c, any_value(weight) AS weight FROM ish JOIN w USING (n, s) GROUP BY k, m, n, s),
mass AS (SELECT k, sum(c * weight) AS mass FROM bag GROUP BY k),
dw AS (SELECT doc_id, regexp_extract_all({LOWER_SQL}, {WORD_SQL}) AS ws FROM documents),
dsh AS (SELECT doc_id, n, len(ws) AS l, p, array_to_string(ws[p:p+n-1], ' ') AS s FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM dw, (SELECT DISTINCT n FROM i))),
st AS (SELECT DISTINCT doc_id, k, m, n, unnest(range(greatest(1, p - (m - n)), least(p, greatest(1, l - m + 1)) + 1)) AS start FROM dsh JOIN bag USING (n, s)),
win AS (SELECT st.doc_id, st.k, st.m, st.n, start, dsh.s, count(*) AS c FROM st JOIN dsh ON dsh.doc_id = st.doc_id AND dsh.n = st.n AND p BETWEEN start AND start + st.m - st.n GROUP BY ALL),
sim AS (
  SELECT win.doc_id, win.k, win.m, start, sum(least(win.c, coalesce(bag.c, 0)) * coalesce(bag.weight, 0)) AS both_w,
    sum(win.c * coalesce(w.weight, 1 + ln((SELECT count(*) FROM i)::DOUBLE))) AS own_w
  FROM win LEFT JOIN bag ON bag.k = win.k AND bag.s = win.s LEFT JOIN w ON w.n = win.n AND w.s = win.s GROUP BY ALL
), r AS (SELECT doc_id, item_id, start, sim.m, round(both_w / (own_w + mass - both_w), 9) AS v FROM sim JOIN mass USING (k) JOIN i USING (k))
SELECT doc_id, item_id, start - 1 AS start_word, m AS n_words, round(v, 6) AS similarity FROM r WHERE v >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY v DESC, start, m) = 1
"""
