"""The registered queries of the matching engine and their SQL.

The driver's tables stand in for datasets: sides by parity of a key or by time,
event sequences for control-flow graphs, a user's next user for call graphs.
Every query runs over whole tables.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import bags, cfg, distance
from ..functions.aggregate import vector_sum
from ..functions.schema import FUNCTION_FEATURES, FeatureSpec, FeatureVector
from ..operators import blocking, dataset, graph, matchers, modular
from ..operators.components import connected_components
from ..sources import tables
from .diff import Options, Side, diff

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
MIDDLE = "2024-01-16"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession) -> str:
    """The session's checkpoint folder; spark.checkpoint.dir, or a temporary one where that is unset (tests), if it has none yet."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="graphkin-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint."""
    shared(df.sparkSession)
    return df.checkpoint()


# -- stand-ins


def parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("pk"), F.col("p_name").alias("name"), "p_brand", "p_type", "p_size")
    return p.where("pk % 2 = 0"), p.where("pk % 2 = 1")


PARTS_SQL = """
l AS (SELECT p_partkey AS pk, p_name AS name, p_brand, p_type, p_size FROM part WHERE p_partkey % 2 = 0),
r AS (SELECT p_partkey AS pk, p_name AS name, p_brand, p_type, p_size FROM part WHERE p_partkey % 2 = 1)
"""


def ranked_sql(key: str, where: str = "TRUE", extra: str = "") -> str:
    side = lambda s: f"(SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY pk DESC) AS n, {key} AS k FROM {s} WHERE {where})"
    return f"WITH {PARTS_SQL}{extra} SELECT a.pk AS lhs_pk, a.name AS lhs_name, b.pk AS rhs_pk, b.name AS rhs_name FROM {side('l')} a JOIN {side('r')} b ON a.k = b.k AND a.n = b.n"


def user_calls(spark: SparkSession, sf_dir: str, late: bool | None = None) -> DataFrame:
    """src, dst, weight: each user's next user over all events (or one half of the time)."""
    e = t(spark, sf_dir, "events")
    if late is not None:
        e = e.where(F.col("ts") >= MIDDLE) if late else e.where(F.col("ts") < MIDDLE)
    step = graph.chain(e, "user_id", ["ts", "event_id"], F.date_trunc("hour", "ts"))
    return step.where("dst IS NOT NULL").groupBy("src", "dst").agg(F.count("*").alias("weight"))


CALLS_SQL = """
calls AS (SELECT src, dst, count(*) AS weight FROM (SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL GROUP BY ALL)
"""


def half_calls_sql(name: str, condition: str) -> str:
    return f"{name} AS (SELECT src, dst, count(*) AS weight FROM (SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM events WHERE ts {condition} TIMESTAMP '{MIDDLE}') WHERE dst IS NOT NULL GROUP BY ALL)"


BOW = FeatureVector((FeatureSpec("bow", 5, "euclid"), FeatureSpec("days", 1, "point")))
TYPES = ["click", "error", "purchase", "signup", "view"]


def users(spark: SparkSession, sf_dir: str, late: bool) -> DataFrame:
    """pk, name, bow (events by type), days of the users of one half of the time."""
    e = t(spark, sf_dir, "events")
    e = e.where(F.col("ts") >= MIDDLE) if late else e.where(F.col("ts") < MIDDLE)
    counts = F.array(*(F.count_if(F.col("event_type") == k).cast("int") for k in TYPES))
    return e.groupBy(F.col("user_id").alias("pk")).agg(F.col("pk").cast("string").alias("name"), counts.alias("bow"), F.countDistinct(F.to_date("ts")).cast("int").alias("days"))


def user_sides(spark: SparkSession, sf_dir: str) -> tuple[Side, Side]:
    region = lambda rows: rows.select("pk", F.floor(F.col("pk") / 25).alias("grp"))
    sides = []
    for late in (False, True):
        rows = users(spark, sf_dir, late)
        sides.append(Side(rows, user_calls(spark, sf_dir, late), region(rows)))
    return sides[0], sides[1]


def event_cfgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, bucket, src, dst: types of consecutive events of a user in three days; the last one's dst is null."""
    e = t(spark, sf_dir, "events")
    e = e.select("user_id", F.floor(F.datediff("ts", F.lit("2024-01-01")) / 3).alias("bucket"), "ts", "event_id", (F.array_position(F.array(*map(F.lit, TYPES)), F.col("event_type")) - 1).alias("src"))
    return e.select("user_id", "bucket", "src", F.lead("src").over(W.partitionBy("user_id", "bucket").orderBy("ts", "event_id")).alias("dst"))


CFG_SQL = """
e AS (SELECT user_id, date_diff('day', DATE '2024-01-01', ts::DATE) // 3 AS bucket, ts, event_id, list_position(['click','error','purchase','signup','view'], event_type) - 1 AS src FROM events),
g AS (SELECT user_id, bucket, src, lead(src) OVER (PARTITION BY user_id, bucket ORDER BY ts, event_id) AS dst FROM e)
"""


def user_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "events").select(F.col("user_id").alias("pk")).distinct().withColumn("cluster", F.col("pk") % 7)


# -- dataset operators


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_size = 15")
def dataset_project_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.select_equal(t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), "p_size", 15)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 100 AND o_orderkey < 5000")
def dataset_crop_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.crop(t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), 100, 5000, "o_orderkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def dataset_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.lookup(t(spark, sf_dir, "customer").select("c_custkey", "c_name"), 42, "c_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def dataset_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = t(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return dataset.semi(t(spark, sf_dir, "customer").select("c_custkey", "c_name"), keys, "c_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def dataset_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = t(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return dataset.anti(t(spark, sf_dir, "customer").select("c_custkey", "c_name"), keys, "c_custkey")


@query("SELECT s_suppkey AS pk, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer")
def dataset_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = t(spark, sf_dir, "supplier"), t(spark, sf_dir, "customer")
    return dataset.insert(a.select(F.col("s_suppkey").alias("pk"), F.col("s_name").alias("name")), b.select(F.col("c_custkey").alias("pk"), F.col("c_name").alias("name")))


@query("SELECT count(*) AS n, count(DISTINCT doc_id) AS n_keys FROM documents")
def dataset_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_keys"))


@query(f"WITH {CALLS_SQL} SELECT DISTINCT user_id AS pk FROM events WHERE user_id IN (SELECT dst FROM calls WHERE src = 7)")
def neighbor_succ(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "events").select(F.col("user_id").alias("pk")).distinct()
    return dataset.successors(rows, user_calls(spark, sf_dir), 7)


@query(f"WITH {CALLS_SQL} SELECT DISTINCT user_id AS pk FROM events WHERE user_id IN (SELECT src FROM calls WHERE dst = 7)")
def neighbor_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "events").select(F.col("user_id").alias("pk")).distinct()
    return dataset.predecessors(rows, user_calls(spark, sf_dir), 7)


@query(
    f"WITH {CALLS_SQL}, e AS (SELECT src AS pk, 1 AS o, 0 AS i, weight AS w FROM calls UNION ALL SELECT dst, 0, 1, weight FROM calls) "
    "SELECT pk, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree, sum(i * w)::BIGINT AS weighted_in, sum(o * w)::BIGINT AS weighted_out FROM e GROUP BY pk"
)
def degree_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(user_calls(spark, sf_dir))


# -- distances


@query("SELECT c_custkey, round(CASE WHEN greatest(c_custkey, c_nationkey) = 0 THEN 0 ELSE abs(c_custkey - c_nationkey) / greatest(c_custkey, c_nationkey)::DOUBLE END, 6) AS d FROM customer")
def point_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t(spark, sf_dir, "customer")
    return c.select("c_custkey", F.round(distance.point(F.col("c_custkey"), F.col("c_nationkey")), 6).alias("d"))


@query(
    "WITH e AS (SELECT vec_id, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS next_id, embedding::DOUBLE[] AS a, (lead(embedding) OVER (PARTITION BY label ORDER BY vec_id))::DOUBLE[] AS b FROM embeddings) "
    "SELECT vec_id, next_id, round(list_distance(a, b) / greatest(sqrt(list_inner_product(a, a)), sqrt(list_inner_product(b, b))), 6) AS d FROM e WHERE next_id IS NOT NULL"
)
def euclidean_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = W.partitionBy("label").orderBy("vec_id")
    e = t(spark, sf_dir, "embeddings").select("vec_id", F.lead("vec_id").over(order).alias("next_id"), F.col("embedding").alias("a"), F.lead("embedding").over(order).alias("b"))
    return e.where("next_id IS NOT NULL").select("vec_id", "next_id", F.round(distance.euclid(F.col("a"), F.col("b")), 6).alias("d"))


@query("SELECT o_orderkey, round(CASE WHEN o_orderkey = o_custkey THEN 0 ELSE bit_count(xor(o_orderkey, o_custkey)) / length(bin(xor(o_orderkey, o_custkey)))::DOUBLE END, 6) AS d FROM orders")
def hamming_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.round(distance.hamming(F.array("o_orderkey"), F.array("o_custkey")), 6).alias("d"))


BOW_SQL = ", ".join(f"count(*) FILTER (event_type = '{k}')::DOUBLE" for k in TYPES)


@query(
    f"WITH u AS (SELECT user_id, ts >= TIMESTAMP '{MIDDLE}' AS late, [{BOW_SQL}] AS v, count(DISTINCT ts::DATE)::DOUBLE AS days FROM events GROUP BY ALL), "
    "p AS (SELECT a.user_id AS pk, a.v AS x, b.v AS y, a.days AS i, b.days AS j FROM u a JOIN u b ON a.user_id = b.user_id AND NOT a.late AND b.late) "
    "SELECT pk, round((list_distance(x, y) / greatest(sqrt(list_inner_product(x, x)), sqrt(list_inner_product(y, y))) + abs(i - j) / greatest(i, j)) / 2, 6) AS d FROM p"
)
def vector_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = users(spark, sf_dir, False).select("pk", BOW.pack("a"))
    b = users(spark, sf_dir, True).select("pk", BOW.pack("b"))
    return a.join(b, "pk").select("pk", F.round(BOW.distance("a", "b"), 6).alias("d"))


@query(f"SELECT user_id AS pk, list_transform([{BOW_SQL}, count(DISTINCT ts::DATE)::DOUBLE], lambda x: x::DOUBLE)::VARCHAR AS flat FROM events WHERE ts < TIMESTAMP '{MIDDLE}' GROUP BY user_id")
def vector_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = users(spark, sf_dir, False).select("pk", BOW.flatten().alias("flat"))
    back = rows.select("pk", *BOW.unflatten(F.col("flat")))
    return back.select("pk", F.concat(F.lit("["), F.array_join(BOW.flatten().cast("array<string>"), ", "), F.lit("]")).alias("flat"))


@query(
    f"WITH u AS (SELECT user_id, ts >= TIMESTAMP '{MIDDLE}' AS late, [{BOW_SQL}] AS v, count(DISTINCT ts::DATE) AS days FROM events GROUP BY ALL) "
    "SELECT a.user_id AS pk, round(list_distance(a.v, b.v) / greatest(sqrt(list_inner_product(a.v, a.v)), sqrt(list_inner_product(b.v, b.v))), 6) AS bow_distance, round(abs(a.days - b.days) / greatest(a.days, b.days)::DOUBLE, 6) AS days_distance, "
    "(a.v[1] + b.v[1])::BIGINT AS clicks, (a.v[5] + b.v[5])::BIGINT AS views, (a.days + b.days)::BIGINT AS days FROM u a JOIN u b ON a.user_id = b.user_id AND NOT a.late AND b.late"
)
def feature_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each feature's own distance and sum."""
    a, b = users(spark, sf_dir, False), users(spark, sf_dir, True)
    both = a.join(b.withColumnsRenamed({"bow": "bow2", "days": "days2", "name": "name2"}), "pk")
    apart = both.select("pk", *(F.round(BOW[f].distance(F.col(f), F.col(f"{f}2")), 6).alias(f"{f}_distance") for f in BOW.names))
    sums = vector_sum(a.unionByName(b), ["pk"], BOW).select("pk", F.col("bow")[0].cast("bigint").alias("clicks"), F.col("bow")[4].cast("bigint").alias("views"), F.col("days").cast("bigint").alias("days"))
    return apart.join(sums, "pk")


@query(
    "SELECT unnest(['function_type', 'vertex_classification', 'edge_classification', 'in_degree', 'out_degree', 'cfg_signature', 'idt_signature', 'insn_bow', 'string_bow', 'markov_lumping']) AS feature, unnest([1, 7, 4, 2, 1, 0, 0, 54, 256, 64]) AS slots, 0.0::DOUBLE AS total"
)
def feature_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zero vector of the function schema: slots of each feature (a signature has no limbs) and their sum."""
    zeros = [F.struct(F.lit(f.name).alias("feature"), (f.zero() if f.is_array else F.array(f.zero())).cast("array<double>").alias("v")) for f in FUNCTION_FEATURES.features]
    rows = spark.range(1).select(F.explode(F.array(*zeros)).alias("z")).select("z.*")
    return rows.select("feature", F.size("v").alias("slots"), F.aggregate("v", F.lit(0.0), lambda s, x: s + x).alias("total"))


# -- matchers


@query(ranked_sql("name"))
def optimistic_name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matchers.by_name(*parts(spark, sf_dir)).drop("distance", "matcher")


@query(
    ranked_sql("regexp_replace(regexp_replace(name, '(?s)@@.*', ''), '^__imp_', '')", "kind = 1")
    .replace("p_name AS name", "'__imp_' || p_name || '@@' || p_brand AS name, CASE p_size % 3 WHEN 0 THEN 0 ELSE p_size % 3 END AS kind")
)
def import_name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("__imp_"), "name", F.lit("@@"), "p_brand")
    a, b = (x.withColumns({"name": name, "function_type": F.col("p_size") % 3}) for x in parts(spark, sf_dir))
    return matchers.by_import(a, b).drop("distance", "matcher")


@query(ranked_sql("name", "p_size % 3 = 2"))
def export_name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (x.withColumn("function_type", F.col("p_size") % 3) for x in parts(spark, sf_dir))
    return matchers.by_export(a, b).drop("distance", "matcher")


@query(
    f"WITH {PARTS_SQL}, u AS (SELECT p_brand, p_type, p_size, min(pk) AS lhs_pk FROM l GROUP BY ALL HAVING count(*) = 1), v AS (SELECT p_brand, p_type, p_size, min(pk) AS rhs_pk FROM r GROUP BY ALL HAVING count(*) = 1) "
    "SELECT lhs_pk, a.name AS lhs_name, rhs_pk, b.name AS rhs_name, 0.0::DOUBLE AS distance FROM u JOIN v USING (p_brand, p_type, p_size) JOIN l a ON a.pk = lhs_pk JOIN r b ON b.pk = rhs_pk"
)
def exact_singleton_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matchers.exact_singleton(*parts(spark, sf_dir), ["p_brand", "p_type", "p_size"]).drop("matcher")


@query(
    r"""
WITH c AS (SELECT doc_id, ascii(ch)::BIGINT AS code, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents WHERE regexp_full_match(text, '(?s)[\x00-\x7F]*')) WHERE ch <> '' GROUP BY ALL),
v AS (SELECT d.doc_id, coalesce(string_agg(code || ':' || n, ',' ORDER BY code), '') AS v FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id WHERE d.text IS NOT NULL GROUP BY d.doc_id),
u AS (SELECT v, doc_id % 2 AS side, min(doc_id) AS pk FROM v GROUP BY ALL HAVING count(*) = 1)
SELECT a.pk AS lhs_pk, b.pk AS rhs_pk FROM u a JOIN u b ON a.v = b.v AND a.side = 0 AND b.side = 1
"""
)
def exact_singleton_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("pk"), F.lit("").alias("name"), "text")
    d = bags.text_bow(d, "text").drop("text")
    return matchers.exact_singleton(d.where("pk % 2 = 0"), d.where("pk % 2 = 1"), ["string_bow"]).select("lhs_pk", "rhs_pk")


def _visible(rows: DataFrame, prefix: str | None) -> DataFrame:
    """Only users who click at least as often as they view keep their names."""
    hidden = F.lit(None).cast("string") if prefix is None else F.concat(F.lit(prefix), "name")
    return rows.withColumn("name", F.when(F.col("bow")[0] >= F.col("bow")[4], F.col("name")).otherwise(hidden))


def _two_windows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    a, b = users(spark, sf_dir, False), users(spark, sf_dir, True)
    seeds = matchers.by_name(_visible(a, None), _visible(b, None))
    return a, b, user_calls(spark, sf_dir, False), user_calls(spark, sf_dir, True), seeds


DAYS = FeatureVector((FeatureSpec("days", 1, "point"), FeatureSpec("clicks", 1, "point")))


def _with_clicks(rows: DataFrame) -> DataFrame:
    return rows.withColumn("clicks", F.col("bow")[0])


#: Both halves' graphs, the users, those that names match, and the degrees of all.
HALVES_SQL = f"""
{half_calls_sql("le", "<")}, {half_calls_sql("re", ">=")},
u AS (SELECT user_id AS pk, ts >= TIMESTAMP '{MIDDLE}' AS late, count(DISTINCT ts::DATE) AS days, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'view') AS views, [{BOW_SQL}] AS v FROM events GROUP BY ALL),
seed AS (SELECT a.pk FROM u a JOIN u b ON a.pk = b.pk AND NOT a.late AND b.late WHERE a.clicks >= a.views AND b.clicks >= b.views),
od AS (SELECT src AS v, count(*) AS d FROM le GROUP BY 1), od2 AS (SELECT src AS v, count(*) AS d FROM re GROUP BY 1),
id AS (SELECT dst AS v, count(*) AS d FROM le GROUP BY 1), id2 AS (SELECT dst AS v, count(*) AS d FROM re GROUP BY 1),
deg AS (SELECT v, d, 0 AS dir, 0 AS side FROM od UNION ALL SELECT v, d, 0, 1 FROM od2 UNION ALL SELECT v, d, 1, 0 FROM id UNION ALL SELECT v, d, 1, 1 FROM id2),
near AS (SELECT DISTINCT src AS v, dst AS n, 0 AS dir, 0 AS side FROM le UNION SELECT dst, src, 1, 0 FROM le UNION SELECT src, dst, 0, 1 FROM re UNION SELECT dst, src, 1, 1 FROM re)
"""


def blocks_sql(matched: str, fresh: str = "TRUE") -> str:
    """blocks of the fresh pairs (l, r) of a relation, and lm and rm: the rows that it leaves unmatched among the neighbours of each."""
    member = lambda side, key, col: (
        f"SELECT degree, l, r, dir, days, clicks, v.pk, v.v AS bow FROM blocks b JOIN near ON near.side = {side} AND near.dir = b.dir AND near.v = b.{key} JOIN u v ON v.pk = near.n AND v.late = ({side} = 1) WHERE v.pk NOT IN (SELECT {col} FROM {matched})"
    ).replace("b JOIN near ON", "AS b JOIN near ON").replace("degree, l, r, dir, days", "b.degree, b.l, b.r, b.dir, days")
    return f"""
blocks AS (SELECT x.d AS degree, m.l, m.r, x.dir FROM {matched} m JOIN deg x ON x.v = m.l AND x.side = 0 JOIN deg y ON y.v = m.r AND y.side = 1 AND y.dir = x.dir AND y.d = x.d WHERE {fresh}),
lm AS ({member(0, "l", "l")}), rm AS ({member(1, "r", "r")})
"""


#: pairs c (degree, l, r, dir, lhs_pk, rhs_pk) that come first for both their rows
SETTLED_SQL = """
k AS (SELECT *, row_number() OVER (PARTITION BY lhs_pk ORDER BY degree, l, r, dir, rhs_pk) AS a, row_number() OVER (PARTITION BY rhs_pk ORDER BY degree, l, r, dir, lhs_pk) AS b FROM c)
"""
#: unique vectors of days and clicks in each block
UNIQUE_SQL = """
c AS (SELECT x.degree, x.l, x.r, x.dir, x.lhs_pk, y.rhs_pk FROM (SELECT degree, l, r, dir, days, clicks, min(pk) AS lhs_pk FROM lm GROUP BY ALL HAVING count(*) = 1) x
  JOIN (SELECT degree, l, r, dir, days, clicks, min(pk) AS rhs_pk FROM rm GROUP BY ALL HAVING count(*) = 1) y USING (degree, l, r, dir, days, clicks))
"""


@query(f"WITH {HALVES_SQL}, sd AS (SELECT pk AS l, pk AS r FROM seed), {blocks_sql('sd')}, {UNIQUE_SQL}, {SETTLED_SQL} SELECT lhs_pk, rhs_pk FROM k WHERE a = 1 AND b = 1")
def structural_exact_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, le, re, seeds = _two_windows(spark, sf_dir)
    a, b = _with_clicks(a), _with_clicks(b)
    found = matchers.structural_round(seeds, matchers.remaining(a, seeds, "lhs"), matchers.remaining(b, seeds, "rhs"), le, re, DAYS)
    return found.select("lhs_pk", "rhs_pk")


@query(
    f"""
WITH RECURSIVE {HALVES_SQL},
s(l, r, fresh, whole, n) AS (
  SELECT pk, pk, true, true, 0 FROM seed
  UNION ALL (
    WITH {blocks_sql("s", "fresh")}, {UNIQUE_SQL}, {SETTLED_SQL}, new AS (SELECT lhs_pk, rhs_pk FROM k WHERE a = 1 AND b = 1), many AS (SELECT count(*) AS c FROM new)
    SELECT l, r, c = 0, c = 0, n + 1 FROM s, many WHERE c > 0 OR NOT whole
    UNION ALL SELECT lhs_pk, rhs_pk, true, false, (SELECT max(n) + 1 FROM s) FROM new
  )
)
SELECT l AS lhs_pk, r AS rhs_pk FROM s WHERE n = (SELECT max(n) FROM s)
"""
)
def structural_exact_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, le, re, seeds = _two_windows(spark, sf_dir)
    found = matchers.structural(cut(seeds), cut(_with_clicks(a)), cut(_with_clicks(b)), cut(le), cut(re), DAYS, cut)
    return found.select("lhs_pk", "rhs_pk")


@query()
def structural_inexact_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, le, re, seeds = _two_windows(spark, sf_dir)
    return matchers.structural_round(seeds, matchers.remaining(a, seeds, "lhs"), matchers.remaining(b, seeds, "rhs"), le, re, BOW, how="optimal")


#: Greedy assignment in all blocks at once: dist(block columns, i, j, lhs_pk, rhs_pk, d) row by row.
def greedy_sql(by: str) -> str:
    return f"""
below AS (SELECT *, min(d) OVER (PARTITION BY {by}, j ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS below FROM dist),
g({by}, i, taken, j) AS (
  SELECT DISTINCT {by}, 0::BIGINT, []::BIGINT[], NULL::BIGINT FROM dist
  UNION ALL
  SELECT {by}, i, CASE WHEN p IS NULL THEN taken ELSE list_append(taken, p.j) END, p.j FROM (
    SELECT {by}, i, taken, min(struct_pack(d := d, j := j)) FILTER (d <= beside AND d <= below) AS p FROM (
      SELECT {by}, b.i, taken, b.j, b.d, below, min(b.d) OVER (PARTITION BY {by} ORDER BY b.j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS beside
      FROM (SELECT * EXCLUDE (j) REPLACE (i + 1 AS i) FROM g) JOIN below b USING ({by}, i) WHERE NOT list_contains(taken, b.j)) GROUP BY ALL)
),
c AS (SELECT dist.* FROM g JOIN dist USING ({by}, i, j))
"""


BOW_DISTANCE_SQL = "(list_distance(a.bow, b.bow) / greatest(sqrt(list_inner_product(a.bow, a.bow)), sqrt(list_inner_product(b.bow, b.bow))) + abs(a.days - b.days) / greatest(a.days, b.days)::DOUBLE) / 2"


@query(
    f"""
WITH RECURSIVE {HALVES_SQL}, sd AS (SELECT pk AS l, pk AS r FROM seed), {blocks_sql("sd")},
ln AS (SELECT *, row_number() OVER (PARTITION BY degree, l, r, dir ORDER BY pk) AS i FROM lm), rn AS (SELECT *, row_number() OVER (PARTITION BY degree, l, r, dir ORDER BY pk) AS j FROM rm),
dist AS (SELECT degree, l, r, dir, i, j, a.pk AS lhs_pk, b.pk AS rhs_pk, {BOW_DISTANCE_SQL} AS d FROM ln a JOIN rn b USING (degree, l, r, dir)),
{greedy_sql("degree, l, r, dir")}, {SETTLED_SQL} SELECT lhs_pk, rhs_pk, round(d, 6) AS distance FROM k WHERE a = 1 AND b = 1
"""
)
def structural_greedy_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, le, re, seeds = _two_windows(spark, sf_dir)
    found = matchers.structural_round(seeds, matchers.remaining(a, seeds, "lhs"), matchers.remaining(b, seeds, "rhs"), le, re, BOW, how="greedy")
    return found.withColumn("distance", F.round("distance", 6))


SEEDS_SQL = f"m AS ({ranked_sql('name').replace('WITH ' + PARTS_SQL, '')})"
GAPS_SQL = """
g AS (SELECT lhs_pk, rhs_pk, lag(lhs_pk) OVER o AS lo, lag(rhs_pk) OVER o AS ro FROM m WINDOW o AS (ORDER BY lhs_pk)),
w AS (SELECT lo, ro, least(lhs_pk - lo, rhs_pk - ro) AS w FROM g WHERE rhs_pk > ro)
"""


@query(f"WITH {PARTS_SQL}, {SEEDS_SQL}, {GAPS_SQL} SELECT lo, ro, w FROM w")
def monotonic_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matchers.windows(matchers.by_name(*parts(spark, sf_dir)))


KIND = FeatureVector((FeatureSpec("kind", 1, "point"), FeatureSpec("p_size", 1, "point")))


@query(
    f"""
WITH {PARTS_SQL}, {SEEDS_SQL}, {GAPS_SQL},
ka AS (SELECT pk, length(p_type) AS kind, p_size FROM l WHERE pk NOT IN (SELECT lhs_pk FROM m)), kb AS (SELECT pk, length(p_type) AS kind, p_size FROM r WHERE pk NOT IN (SELECT rhs_pk FROM m)),
x AS (SELECT lo, ro, w, kind, p_size, min(pk) AS lhs_pk FROM w JOIN ka ON pk > lo AND pk <= lo + w GROUP BY ALL HAVING count(*) = 1),
y AS (SELECT lo, ro, w, kind, p_size, min(pk) AS rhs_pk FROM w JOIN kb ON pk > ro AND pk <= ro + w GROUP BY ALL HAVING count(*) = 1),
c AS (SELECT * FROM x JOIN y USING (lo, ro, w, kind, p_size)),
k AS (SELECT *, row_number() OVER (PARTITION BY lhs_pk ORDER BY lo, ro, w, rhs_pk) AS a, row_number() OVER (PARTITION BY rhs_pk ORDER BY lo, ro, w, lhs_pk) AS b FROM c)
SELECT lhs_pk, rhs_pk FROM k WHERE a = 1 AND b = 1
"""
)
def monotonic_exact_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (x.withColumn("kind", F.length("p_type")) for x in parts(spark, sf_dir))
    seeds = matchers.by_name(a, b)
    found = matchers.monotonic_round(seeds, matchers.remaining(a, seeds, "lhs"), matchers.remaining(b, seeds, "rhs"), KIND)
    return found.select("lhs_pk", "rhs_pk")


@query()
def monotonic_inexact_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (x.withColumn("kind", F.length("p_type")) for x in parts(spark, sf_dir))
    seeds = matchers.by_name(a, b)
    return matchers.monotonic_round(seeds, matchers.remaining(a, seeds, "lhs"), matchers.remaining(b, seeds, "rhs"), KIND, how="optimal")


@query()
def assignment_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matchers.inexact_singleton(users(spark, sf_dir, False), users(spark, sf_dir, True), BOW).withColumn("distance", F.round("distance", 6))


def solve_sql(by: str) -> str:
    """costs (by, n_pairs, cost) of the best assignment in each block of dist (by, i, j, d): shortest augmenting paths, a step for each row of s."""
    on = " AND ".join(f"wide.{c} = x.{c}" for c in by.split(", "))
    return f"""
size AS (SELECT {by}, max(i) AS n, max(j) AS m FROM dist GROUP BY ALL),
wide AS (SELECT {by}, CASE WHEN n <= m THEN i ELSE j END AS line, list(d ORDER BY CASE WHEN n <= m THEN j ELSE i END) AS ds FROM dist JOIN size USING ({by}) GROUP BY ALL),
s({by}, few, row, col, u, v, mine, came, near, done, adding) AS (
  SELECT {by}, least(n, m), 1::BIGINT, 0::BIGINT, list_transform(range(least(n, m) + 1), lambda k: 0::DOUBLE), list_transform(range(greatest(n, m) + 1), lambda k: 0::DOUBLE),
    list_transform(range(greatest(n, m) + 1), lambda k: CASE WHEN k = 0 THEN 1::BIGINT ELSE 0::BIGINT END), list_transform(range(greatest(n, m) + 1), lambda k: 0::BIGINT),
    list_transform(range(greatest(n, m) + 1), lambda k: 'inf'::DOUBLE), list_transform(range(greatest(n, m) + 1), lambda k: false), false FROM size
  UNION ALL
  SELECT {by}, few,
    CASE WHEN adding AND col = 0 THEN row + 1 ELSE row END,
    CASE WHEN adding AND col = 0 THEN 0 WHEN adding THEN came[col + 1] ELSE list_position(best, least_) - 1 END,
    CASE WHEN adding THEN u ELSE list_transform(u, lambda x, k: CASE WHEN list_contains(busy, k - 1) THEN x + least_ ELSE x END) END,
    CASE WHEN adding THEN v ELSE list_transform(v, lambda x, k: CASE WHEN done2[k] THEN x - least_ ELSE x END) END,
    CASE WHEN adding AND col = 0 THEN list_transform(mine, lambda x, k: CASE WHEN k = 1 THEN row + 1 ELSE x END)
      WHEN adding THEN list_transform(mine, lambda x, k: CASE WHEN k = col + 1 THEN mine[came[col + 1] + 1] ELSE x END) ELSE mine END,
    CASE WHEN adding THEN came ELSE came2 END,
    CASE WHEN adding AND col = 0 THEN list_transform(near, lambda x: 'inf'::DOUBLE) WHEN adding THEN near ELSE list_transform(near2, lambda x, k: CASE WHEN done2[k] THEN x ELSE x - least_ END) END,
    CASE WHEN adding AND col = 0 THEN list_transform(done, lambda x: false) WHEN adding THEN done ELSE done2 END,
    CASE WHEN adding THEN col <> 0 ELSE mine[list_position(best, least_)] = 0 END
  FROM (SELECT *, list_min(best) AS least_ FROM (SELECT *, list_transform(near2, lambda x, k: CASE WHEN done2[k] THEN 'inf'::DOUBLE ELSE x END) AS best, list_filter(mine, lambda x, k: done2[k]) AS busy FROM (
    SELECT *, list_transform(near, lambda x, k: CASE WHEN NOT done2[k] AND red[k] < x THEN red[k] ELSE x END) AS near2, list_transform(came, lambda x, k: CASE WHEN NOT done2[k] AND red[k] < near[k] THEN col ELSE x END) AS came2 FROM (
      SELECT x.*, list_transform(done, lambda y, k: y OR k = col + 1) AS done2, list_transform(v, lambda y, k: CASE WHEN k = 1 THEN 'inf'::DOUBLE ELSE ds[k - 1] - u[mine[col + 1] + 1] - y END) AS red
      FROM s x LEFT JOIN wide ON {on} AND wide.line = mine[col + 1] WHERE row <= few))))
),
ends AS (SELECT {by}, unnest(mine) AS line, unnest(range(len(mine))) AS k FROM s WHERE row > few),
costs AS (SELECT {by}, count(*) AS n_pairs, round(sum(ds[k]), 6) AS cost FROM ends JOIN wide USING ({by}, line) WHERE k > 0 GROUP BY ALL)
"""


#: The distances d of the i-th user of the first half and the j-th of the second, by key.
COSTS_SQL = f"""
u AS (SELECT user_id, ts >= TIMESTAMP '{MIDDLE}' AS late, [{BOW_SQL}] AS v, count(DISTINCT ts::DATE)::DOUBLE AS days FROM events GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY late ORDER BY user_id) AS k FROM u),
c AS (SELECT a.k AS i, b.k AS j, a.user_id AS x, b.user_id AS y,
  (list_distance(a.v, b.v) / greatest(sqrt(list_inner_product(a.v, a.v)), sqrt(list_inner_product(b.v, b.v))) + abs(a.days - b.days) / greatest(a.days, b.days)) / 2 AS d FROM o a, o b WHERE NOT a.late AND b.late)
"""


@query(f"WITH RECURSIVE {COSTS_SQL}, dist AS (SELECT 0 AS one, i, j, d FROM c), {solve_sql('one')} SELECT n_pairs, cost FROM costs")
def assignment_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs and total distance of the best assignment (which pairs make it up may not be unique)."""
    found = matchers.inexact_singleton(users(spark, sf_dir, False), users(spark, sf_dir, True), BOW)
    return found.agg(F.count("*").alias("n_pairs"), F.round(F.sum("distance"), 6).alias("cost"))


@query(
    f"""
WITH RECURSIVE {COSTS_SQL},
b AS (SELECT *, min(d) OVER (PARTITION BY j ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS below FROM c),
s(i, taken, j, d) AS (
  SELECT 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::DOUBLE
  UNION ALL
  SELECT i, CASE WHEN p IS NULL THEN taken ELSE list_append(taken, p.j) END, p.j, p.d FROM (
    SELECT i, taken, min(struct_pack(d := d, j := j)) FILTER (d <= beside AND d <= below) AS p FROM (
      SELECT b.i, taken, b.j, b.d, below, min(b.d) OVER (ORDER BY b.j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS beside FROM s JOIN b ON b.i = s.i + 1 AND NOT list_contains(taken, b.j)) GROUP BY i, taken)
)
SELECT x AS lhs_pk, x::VARCHAR AS lhs_name, y AS rhs_pk, y::VARCHAR AS rhs_name, round(s.d, 6) AS distance FROM s JOIN c USING (i, j)
"""
)
def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matchers.inexact_singleton(users(spark, sf_dir, False), users(spark, sf_dir, True), BOW, how="greedy")
    return found.withColumn("distance", F.round("distance", 6)).drop("matcher")


@query(
    f"""
WITH RECURSIVE {HALVES_SQL}, sd AS (SELECT pk AS l, pk AS r FROM seed), {blocks_sql("sd")},
ln AS (SELECT *, row_number() OVER (PARTITION BY degree, l, r, dir ORDER BY pk) AS i FROM lm), rn AS (SELECT *, row_number() OVER (PARTITION BY degree, l, r, dir ORDER BY pk) AS j FROM rm),
dist AS (SELECT degree, l, r, dir, i, j, {BOW_DISTANCE_SQL} AS d FROM ln a JOIN rn b USING (degree, l, r, dir)),
{solve_sql("degree, l, r, dir")}
SELECT degree, l AS lpk, r AS rpk, dir, n_pairs, cost FROM costs
"""
)
def structural_inexact_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs and total distance of the best assignment in each neighbourhood, before those that share a row are settled."""
    a, b, le, re, seeds = _two_windows(spark, sf_dir)
    pairs = matchers.structural_pairs(seeds, matchers.remaining(a, seeds, "lhs"), matchers.remaining(b, seeds, "rhs"), le, re, BOW, how="optimal")
    return pairs.groupBy(*matchers.STRUCTURAL).agg(F.count("*").alias("n_pairs"), F.round(F.sum("distance"), 6).alias("cost"))


@query(
    f"""
WITH RECURSIVE {PARTS_SQL}, {SEEDS_SQL}, {GAPS_SQL},
ka AS (SELECT pk, length(p_type) AS kind, p_size FROM l WHERE pk NOT IN (SELECT lhs_pk FROM m)), kb AS (SELECT pk, length(p_type) AS kind, p_size FROM r WHERE pk NOT IN (SELECT rhs_pk FROM m)),
x AS (SELECT lo, ro, w, kind, p_size, row_number() OVER (PARTITION BY lo, ro, w ORDER BY pk) AS i FROM w JOIN ka ON pk > lo AND pk <= lo + w),
y AS (SELECT lo, ro, w, kind, p_size, row_number() OVER (PARTITION BY lo, ro, w ORDER BY pk) AS j FROM w JOIN kb ON pk > ro AND pk <= ro + w),
dist AS (SELECT lo, ro, w, i, j, (abs(x.kind - y.kind) / greatest(x.kind, y.kind)::DOUBLE + abs(x.p_size - y.p_size) / greatest(x.p_size, y.p_size)::DOUBLE) / 2 AS d FROM x JOIN y USING (lo, ro, w)),
{solve_sql("lo, ro, w")}
SELECT lo, ro, w, n_pairs, cost FROM costs
"""
)
def monotonic_inexact_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs and total distance of the best assignment in each window, before those that share a row are settled."""
    a, b = (x.withColumn("kind", F.length("p_type")) for x in parts(spark, sf_dir))
    seeds = matchers.by_name(a, b)
    pairs = matchers.monotonic_pairs(seeds, matchers.remaining(a, seeds, "lhs"), matchers.remaining(b, seeds, "rhs"), KIND, how="optimal")
    return pairs.groupBy(*matchers.MONOTONIC).agg(F.count("*").alias("n_pairs"), F.round(F.sum("distance"), 6).alias("cost"))


@query(f"WITH m AS ({ranked_sql('p_size').replace('WITH', 'WITH', 1)}) SELECT count(*) FILTER (lhs_name = rhs_name) AS n_match, count(*) FILTER (lhs_name <> rhs_name) AS n_mismatch FROM m")
def match_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matchers.report(matchers.optimistic(*parts(spark, sf_dir), F.col("p_size")))


@query(f"WITH m AS ({ranked_sql('name')}) SELECT p_partkey AS pk, p_name AS name FROM part WHERE p_partkey % 2 = 0 AND p_partkey NOT IN (SELECT lhs_pk FROM m)")
def unmatched_lhs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = parts(spark, sf_dir)
    return matchers.remaining(a, matchers.by_name(a, b), "lhs").select("pk", "name")


@query(f"WITH m AS ({ranked_sql('name')}) SELECT p_partkey AS pk, p_name AS name FROM part WHERE p_partkey % 2 = 1 AND p_partkey NOT IN (SELECT rhs_pk FROM m)")
def unmatched_rhs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = parts(spark, sf_dir)
    return matchers.remaining(b, matchers.by_name(a, b), "rhs").select("pk", "name")


# -- sources and sinks


def _raw(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Users as functions, in the tables that a disassembler would give."""
    e = t(spark, sf_dir, "events")
    pk = F.col("user_id").alias("pk")
    kind = F.array_position(F.array(*map(F.lit, TYPES)), F.col("event_type")).cast("int") - 1
    per = e.groupBy(pk).agg(F.count("*").alias("code"), F.countDistinct("event_type").alias("data"))
    return {
        "cfg": event_cfgs(spark, sf_dir).select(pk, "src", "dst"),
        "names": per.select("pk", F.concat(F.lit("u"), F.col("pk").cast("string")).alias("name")),
        "calls": user_calls(spark, sf_dir),
        "insns": e.select(pk, kind.alias("i")).select("pk", F.expr("shiftleft(1L, i)").alias("mask")),
        "strings": e.select(pk, F.col("event_type").alias("text")),
        "xrefs": per.select("pk", "code", "data"),
        "types": per.select("pk", (F.col("pk") % 3 == 0).alias("is_import"), (F.col("pk") % 2 == 0).alias("is_export")),
    }


@query(
    f"""
WITH {CFG_SQL}, {CALLS_SQL},
d AS (SELECT DISTINCT user_id, src, dst FROM g WHERE dst IS NOT NULL), vx AS (SELECT user_id, src AS v FROM g UNION SELECT user_id, dst FROM d),
vc AS (SELECT vx.user_id, vx.v, count(d.dst) AS o, count(*) FILTER (d.dst = vx.v) AS s FROM vx LEFT JOIN d ON d.user_id = vx.user_id AND d.src = vx.v GROUP BY ALL),
vn AS (SELECT user_id, count(*) AS n_all, count(*) FILTER (o = 0) AS n_exit, count(*) FILTER (s = 1) AS n_loop FROM vc GROUP BY ALL),
od AS (SELECT src, count(*) AS out_degree FROM calls GROUP BY src),
x AS (SELECT user_id, count(*) AS code, count(DISTINCT event_type) AS data, count(*) FILTER (event_type = 'purchase') AS purchases, sum(length(replace(event_type, 'e', 'ee')) - length(event_type)) AS e_chars FROM events GROUP BY user_id)
SELECT user_id AS pk, 'u' || user_id AS name, CASE WHEN user_id % 3 = 0 THEN 1 WHEN user_id % 2 = 0 THEN 2 ELSE 0 END AS function_type, n_all::INT AS n_all, n_exit::INT AS n_exit, n_loop::INT AS n_loop,
  code::INT AS code, data::INT AS data, coalesce(out_degree, 0)::INT AS out_degree, purchases::INT AS purchases, e_chars::INT AS e_chars
FROM x JOIN vn USING (user_id) LEFT JOIN od ON src = user_id
"""
)
def export_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset made of raw tables, written and loaded again."""
    folder = f"{shared(spark)}/dataset-{uuid.uuid4().hex}"
    for name, rows in _raw(spark, sf_dir).items():
        rows.write.parquet(f"{folder}/raw/{name}")
    tables.export_raw(spark, f"{folder}/raw", f"{folder}/set")
    rows, _ = tables.load(spark, f"{folder}/set")
    v, r = F.col("vertex_classification"), F.col("in_degree")
    return rows.select("pk", "name", "function_type", v[0].alias("n_all"), v[2].alias("n_exit"), v[4].alias("n_loop"), r[0].alias("code"), r[1].alias("data"), "out_degree", F.col("insn_bow")[2].alias("purchases"), F.col("string_bow")[101].alias("e_chars"))


@query(f"WITH {CALLS_SQL} SELECT src, dst, weight FROM calls")
def export_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of a dataset, written and loaded again."""
    folder = f"{shared(spark)}/dataset-{uuid.uuid4().hex}"
    empty = spark.createDataFrame([], "pk bigint, name string").select("pk", "name", *(f.zero().alias(f.name) for f in FUNCTION_FEATURES.features))
    tables.export(empty, user_calls(spark, sf_dir), folder)
    return tables.load(spark, folder)[1]


@query(ranked_sql("name"))
def matched_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _saved(spark, sf_dir, "matched").drop("distance", "matcher")


@query(
    f"WITH m AS ({ranked_sql('name')}) SELECT 1 AS side, p_partkey AS pk, p_name AS name FROM part WHERE p_partkey % 2 = 0 AND p_partkey NOT IN (SELECT lhs_pk FROM m) "
    "UNION ALL SELECT 2, p_partkey, p_name FROM part WHERE p_partkey % 2 = 1 AND p_partkey NOT IN (SELECT rhs_pk FROM m)"
)
def unmatched_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _saved(spark, sf_dir, "unmatched1", "unmatched2")


def _saved(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    a, b = parts(spark, sf_dir)
    found, folder = matchers.by_name(a, b), f"{shared(spark)}/result-{uuid.uuid4().hex}"
    tables.save(found, matchers.remaining(a, found, "lhs"), matchers.remaining(b, found, "rhs"), folder)
    if len(names) == 1:
        return spark.read.parquet(f"{folder}/{names[0]}")
    sides = [spark.read.parquet(f"{folder}/{name}").select(F.lit(k).alias("side"), "pk", "name") for k, name in enumerate(names, 1)]
    return sides[0].union(sides[1])


# -- features


@query(
    r"""
WITH c AS (SELECT lang, ascii(ch)::INT AS code, count(*) AS n FROM (SELECT lang, unnest(string_split(text, '')) AS ch FROM documents WHERE regexp_full_match(text, '(?s)[\x00-\x7F]*')) WHERE ch <> '' GROUP BY ALL)
SELECT lang, code, n FROM c
"""
)
def string_bow(spark: SparkSession, sf_dir: str) -> DataFrame:
    bag = bags.string_bow(t(spark, sf_dir, "documents"), ["lang"], "text")
    return bag.select("lang", F.posexplode("string_bow").alias("code", "k")).where("k > 0").select("lang", "code", F.col("k").cast("bigint").alias("n"))


@query("SELECT user_id, (list_position(['click','error','purchase','signup','view'], event_type) - 1)::INT AS class, count(*) AS n FROM events GROUP BY ALL")
def class_bow(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = F.expr("shiftleft(1L, cast(array_position(array('click','error','purchase','signup','view'), event_type) - 1 AS int))")
    bag = bags.insn_bow(t(spark, sf_dir, "events").withColumn("mask", mask), ["user_id"], "mask")
    return bag.select("user_id", F.posexplode("insn_bow").alias("class", "k")).where("k > 0").select("user_id", "class", F.col("k").cast("bigint").alias("n"))


@query(
    f"""
WITH {CFG_SQL}, d AS (SELECT DISTINCT * FROM g), v AS (SELECT user_id, bucket, src, count(dst) AS o, count(*) FILTER (dst = src) AS s FROM d GROUP BY ALL)
SELECT user_id, bucket::BIGINT AS bucket, count(*)::INT AS n_all, count(*) FILTER (o = 0)::INT AS n_exit, count(*) FILTER (o = 1 AND s = 1)::INT AS n_trap, count(*) FILTER (s = 1)::INT AS n_loop FROM v GROUP BY ALL
"""
)
def vertex_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cfg.vertex_counts(event_cfgs(spark, sf_dir), ["user_id", "bucket"])


#: The depth-first traversal of all graphs, a row for each graph and step: nb has the neighbours of
#: vertex v at v + 1, nxt the next neighbour to look at, st 1 for open and 2 for closed vertices.
DFS_SQL = f"""
RECURSIVE {CFG_SQL},
d AS (SELECT DISTINCT user_id, bucket, src, dst FROM g WHERE dst IS NOT NULL),
vx AS (SELECT user_id, bucket, src AS v FROM g UNION SELECT user_id, bucket, dst FROM d),
vo AS (SELECT vx.*, EXISTS (SELECT 1 FROM d WHERE d.user_id = vx.user_id AND d.bucket = vx.bucket AND d.dst = vx.v) AS entered FROM vx),
gr AS (SELECT user_id, bucket, list(v ORDER BY entered, v) AS vs FROM vo GROUP BY ALL),
na AS (SELECT user_id, bucket, src, list(dst ORDER BY dst) AS ns FROM d GROUP BY ALL),
nb AS (SELECT gr.user_id, gr.bucket, any_value(vs) AS vs, list(coalesce(ns, []) ORDER BY k) AS nb FROM gr, range(5) r(k) LEFT JOIN na ON na.user_id = gr.user_id AND na.bucket = gr.bucket AND na.src = k GROUP BY gr.user_id, gr.bucket),
walk(user_id, bucket, vs, nb, nxt, st, stack, code, a, b, step) AS (
  SELECT user_id, bucket, vs, nb, [1, 1, 1, 1, 1], [0, 0, 0, 0, 0], []::BIGINT[], -1, NULL::BIGINT, NULL::BIGINT, 0 FROM nb
  UNION ALL
  SELECT user_id, bucket, vs, nb,
    CASE WHEN w IS NOT NULL AND v IS NOT NULL THEN list_transform(nxt, lambda x, i: CASE WHEN i = v + 1 THEN x + 1 ELSE x END) ELSE nxt END,
    CASE WHEN new IS NOT NULL THEN list_transform(st, lambda x, i: CASE WHEN i = new + 1 THEN 1 ELSE x END)
      WHEN w IS NULL THEN list_transform(st, lambda x, i: CASE WHEN i = v + 1 THEN 2 ELSE x END) ELSE st END,
    CASE WHEN new IS NOT NULL THEN list_append(stack, new) WHEN w IS NULL THEN stack[1:len(stack) - 1] ELSE stack END,
    CASE WHEN v IS NULL THEN 0 WHEN w IS NULL THEN 5 WHEN new IS NOT NULL THEN 1 WHEN st[w + 1] = 1 THEN 2 ELSE 3 END,
    v, w, step + 1
  FROM (SELECT *, CASE WHEN v IS NULL THEN w WHEN st[w + 1] = 0 THEN w END AS new FROM (
    SELECT walk.* EXCLUDE (a, b, code), stack[-1] AS v, CASE WHEN len(stack) = 0 THEN list_filter(vs, lambda x: st[x + 1] = 0)[1] ELSE nb[stack[-1] + 1][nxt[stack[-1] + 1]] END AS w FROM walk))
  WHERE v IS NOT NULL OR w IS NOT NULL
),
ev AS (SELECT user_id, bucket, code, a, b, step FROM walk WHERE code >= 0),
bk AS (SELECT user_id, bucket, a AS src, b AS dst FROM ev WHERE code = 2 AND a <> b),
fw AS (SELECT * FROM d WHERE src <> dst AND NOT EXISTS (SELECT 1 FROM bk WHERE bk.user_id = d.user_id AND bk.bucket = d.bucket AND bk.src = d.src AND bk.dst = d.dst)),
paths(user_id, bucket, v, n) AS (SELECT user_id, bucket, v, 0 FROM vx UNION SELECT p.user_id, p.bucket, fw.dst, n + 1 FROM paths p JOIN fw ON fw.user_id = p.user_id AND fw.bucket = p.bucket AND fw.src = p.v),
dp AS (SELECT user_id, bucket, v, max(n) AS depth FROM paths GROUP BY ALL)
"""
#: Dominators by taking vertices away: x is above v if no root leads to v without it.
DOMINATORS_SQL = """
rt AS (SELECT user_id, bucket, b AS v FROM ev WHERE code = 0),
away(user_id, bucket, x, v) AS (
  SELECT rt.user_id, rt.bucket, vx.v, rt.v FROM rt JOIN vx ON vx.user_id = rt.user_id AND vx.bucket = rt.bucket AND vx.v <> rt.v
  UNION SELECT w.user_id, w.bucket, w.x, d.dst FROM away w JOIN d ON d.user_id = w.user_id AND d.bucket = w.bucket AND d.src = w.v WHERE d.dst <> w.x),
above AS (SELECT a.user_id, a.bucket, a.v, b.v AS x FROM vx a JOIN vx b ON a.user_id = b.user_id AND a.bucket = b.bucket AND a.v <> b.v
  WHERE NOT EXISTS (SELECT 1 FROM away w WHERE w.user_id = a.user_id AND w.bucket = a.bucket AND w.x = b.v AND w.v = a.v)),
high AS (SELECT user_id, bucket, v, count(*) AS n FROM above GROUP BY ALL),
im AS (SELECT vx.user_id, vx.bucket, vx.v, coalesce(arg_max(above.x, coalesce(high.n, 0)), -1) AS idom FROM vx
  LEFT JOIN above ON above.user_id = vx.user_id AND above.bucket = vx.bucket AND above.v = vx.v
  LEFT JOIN high ON high.user_id = above.user_id AND high.bucket = above.bucket AND high.v = above.x GROUP BY ALL)
"""
WEIGHTS_SQL = """
en AS (SELECT vx.* FROM vx LEFT JOIN d ON d.user_id = vx.user_id AND d.bucket = vx.bucket AND d.src = vx.v GROUP BY ALL HAVING count(d.dst) = 0 OR count(*) = 1 AND max(d.dst) = vx.v),
far AS (SELECT dp.user_id, dp.bucket, dp.v, CASE WHEN bool_or(en.v = dp.v) OR count(en.v) = 0 THEN 1 ELSE 1 + max(abs(dp.depth - x.depth)) END AS far FROM dp
  LEFT JOIN en ON en.user_id = dp.user_id AND en.bucket = dp.bucket LEFT JOIN dp x ON x.user_id = en.user_id AND x.bucket = en.bucket AND x.v = en.v GROUP BY ALL),
wt AS (SELECT d.user_id, d.bucket, d.src, d.dst, far / sum(far) OVER (PARTITION BY d.user_id, d.bucket, d.src)::DOUBLE AS weight FROM d JOIN far ON far.user_id = d.user_id AND far.bucket = d.bucket AND far.v = d.dst)
"""


def _lumped_sql(rounds: int) -> str:
    """Blocks b0, b1, ...: vertices stay together while they send the same weight to each block.  As many rounds as a graph may have vertices."""
    out = ["b0 AS (SELECT user_id, bucket, v, '' AS b FROM vx)"]
    for k in range(rounds):
        out.append(
            f"f{k} AS (SELECT wt.user_id, wt.bucket, wt.src AS v, string_agg(b || '=' || w, ',' ORDER BY b) AS f FROM (SELECT wt.user_id, wt.bucket, wt.src, t.b, round(sum(weight), 9)::VARCHAR AS w FROM wt JOIN b{k} t ON t.user_id = wt.user_id AND t.bucket = wt.bucket AND t.v = wt.dst GROUP BY ALL) wt GROUP BY ALL)"
        )
        out.append(f"b{k + 1} AS (SELECT s.user_id, s.bucket, s.v, md5(s.b || '|' || coalesce(f, '')) AS b FROM b{k} s LEFT JOIN f{k} f ON f.user_id = s.user_id AND f.bucket = s.bucket AND f.v = s.v)")
    return ",\n".join(out)


GRAPH = "user_id, bucket::BIGINT AS bucket"


@query()
def cfg_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All traversal features: vertex and edge classes, signatures with their limbs, lumped probabilities."""
    f = cfg.cfg_features(event_cfgs(spark, sf_dir), ["user_id", "bucket"])
    return f.withColumns({"cfg_limbs": distance.limbs(F.col("cfg_signature")), "idt_limbs": distance.limbs(F.col("idt_signature"))})


@query(
    f"""
WITH {DFS_SQL}, {DOMINATORS_SQL},
tree(user_id, bucket, v, path) AS (SELECT user_id, bucket, v, [v] FROM im WHERE idom = -1 UNION ALL SELECT im.user_id, im.bucket, im.v, list_append(path, im.v) FROM tree JOIN im ON im.user_id = tree.user_id AND im.bucket = tree.bucket AND im.idom = tree.v),
te AS (SELECT user_id, bucket, path, '1' AS code FROM tree UNION ALL SELECT user_id, bucket, list_append(path, 9), '5' FROM tree),
ts AS (SELECT user_id, bucket, string_agg(code, '' ORDER BY path) || '5' AS idt_signature FROM te GROUP BY ALL),
cs AS (SELECT user_id, bucket, ltrim(string_agg(code::VARCHAR, '' ORDER BY step), '0') AS cfg_signature, string_agg(CASE WHEN code <= 1 THEN '1' ELSE '0' END, '' ORDER BY step) FILTER (code IN (0, 1, 5)) AS bit_signature FROM ev GROUP BY ALL)
SELECT {GRAPH}, cfg_signature, bit_signature, idt_signature FROM cs JOIN ts USING (user_id, bucket)
"""
)
def cfg_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures of the traversal, in full and of entering and leaving only, and of the dominator tree."""
    return cfg.cfg_features(event_cfgs(spark, sf_dir), ["user_id", "bucket"]).select("user_id", "bucket", "cfg_signature", "bit_signature", "idt_signature")


@query(
    f"""
WITH {DFS_SQL}, heads AS (SELECT DISTINCT user_id, bucket, dst AS v FROM bk), tails AS (SELECT DISTINCT user_id, bucket, src AS v FROM bk),
gap AS (SELECT d.*, y.depth - x.depth AS gap, h.v IS NOT NULL AND t.v IS NOT NULL AS back FROM d JOIN dp x ON x.user_id = d.user_id AND x.bucket = d.bucket AND x.v = d.src JOIN dp y ON y.user_id = d.user_id AND y.bucket = d.bucket AND y.v = d.dst
  LEFT JOIN heads h ON h.user_id = d.user_id AND h.bucket = d.bucket AND h.v = d.dst LEFT JOIN tails t ON t.user_id = d.user_id AND t.bucket = d.bucket AND t.v = d.src),
ec AS (SELECT user_id, bucket, count(*) FILTER (gap = 1) AS n_tree, count(*) FILTER (gap > 1) AS n_forward, count(*) FILTER (gap < 0 AND back) AS n_back, count(*) FILTER (gap < 0 AND NOT back) AS n_cross FROM gap GROUP BY ALL),
rc AS (SELECT user_id, bucket, count(*) AS n_entry FROM ev WHERE code = 0 GROUP BY ALL), hc AS (SELECT user_id, bucket, count(*) AS n_head FROM heads GROUP BY ALL), tc AS (SELECT user_id, bucket, count(*) AS n_tail FROM tails GROUP BY ALL)
SELECT {GRAPH}, n_entry::INT AS n_entry, coalesce(n_head, 0)::INT AS n_head, coalesce(n_tail, 0)::INT AS n_tail, coalesce(n_tree, 0)::INT AS n_tree, coalesce(n_forward, 0)::INT AS n_forward, coalesce(n_back, 0)::INT AS n_back, coalesce(n_cross, 0)::INT AS n_cross
FROM rc LEFT JOIN hc USING (user_id, bucket) LEFT JOIN tc USING (user_id, bucket) LEFT JOIN ec USING (user_id, bucket)
"""
)
def cfg_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertex classes that depend on the traversal, and edge classes."""
    f = cfg.cfg_features(event_cfgs(spark, sf_dir), ["user_id", "bucket"])
    v, e = F.col("vertex_classification"), F.col("edge_classification")
    return f.select("user_id", "bucket", v[1].alias("n_entry"), v[5].alias("n_head"), v[6].alias("n_tail"), e[0].alias("n_tree"), e[1].alias("n_forward"), e[2].alias("n_back"), e[3].alias("n_cross"))


@query(f"WITH {DFS_SQL}, {DOMINATORS_SQL} SELECT {GRAPH}, v::BIGINT AS vertex, depth::INT AS depth, idom::BIGINT AS idom FROM im JOIN dp USING (user_id, bucket, v)")
def cfg_depth_dominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cfg.cfg_details(event_cfgs(spark, sf_dir), ["user_id", "bucket"])[0].drop("block")


@query(f"WITH {DFS_SQL}, {WEIGHTS_SQL} SELECT {GRAPH}, src::BIGINT AS src, dst::BIGINT AS dst, round(weight, 9) AS weight FROM wt")
def cfg_edge_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cfg.cfg_details(event_cfgs(spark, sf_dir), ["user_id", "bucket"])[1].withColumn("weight", F.round("weight", 9))


@query(f"WITH {DFS_SQL}, {WEIGHTS_SQL}, {_lumped_sql(5)} SELECT {GRAPH}, v::BIGINT AS vertex, (min(v) OVER (PARTITION BY user_id, bucket, b))::BIGINT AS block FROM b5")
def markov_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of the lumped chain."""
    return cfg.cfg_details(event_cfgs(spark, sf_dir), ["user_id", "bucket"])[0].select("user_id", "bucket", "vertex", "block")


# -- clusters and blocking


@query(
    "SELECT c_nationkey, sum(CASE c_mktsegment WHEN 'BUILDING' THEN 1 ELSE 0 END)::BIGINT AS n_building, count(*)::BIGINT AS n_all FROM customer GROUP BY c_nationkey"
)
def cluster_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = FeatureVector((FeatureSpec("bag", 2, "euclid"), FeatureSpec("signature", 1, "hamming", summed=False, kind="limbs")))
    rows = t(spark, sf_dir, "customer").select("c_nationkey", F.array((F.col("c_mktsegment") == "BUILDING").cast("int"), F.lit(1)).alias("bag"), F.array(F.col("c_custkey")).alias("signature"))
    s = vector_sum(rows, ["c_nationkey"], v)
    return s.where(F.size("signature") == 0).select("c_nationkey", F.col("bag")[0].cast("bigint").alias("n_building"), F.col("bag")[1].cast("bigint").alias("n_all"))


@query(
    f"""
WITH {CALLS_SQL}, m AS (SELECT DISTINCT user_id AS pk, user_id // 25 AS grp FROM events), c AS (SELECT grp, min(pk) AS cluster_id, count(*) AS c1 FROM m GROUP BY grp),
mm AS (SELECT pk, cluster_id FROM m JOIN c USING (grp)),
leaf AS (SELECT pk, coalesce((SELECT sum(weight) FROM calls WHERE dst = pk), 0) AS wi, coalesce((SELECT sum(weight) FROM calls WHERE src = pk), 0) AS wo FROM m),
meta AS (SELECT a.cluster_id AS s, b.cluster_id AS d, count(*) AS w FROM calls JOIN mm a ON a.pk = src JOIN mm b ON b.pk = dst GROUP BY ALL)
SELECT c.cluster_id, c1::INT AS c1, (SELECT sum(wi) FROM leaf JOIN mm USING (pk) WHERE mm.cluster_id = c.cluster_id)::INT AS c2, (SELECT sum(wo) FROM leaf JOIN mm USING (pk) WHERE mm.cluster_id = c.cluster_id)::INT AS c3,
  coalesce((SELECT sum(w) FROM meta WHERE d = c.cluster_id), 0)::INT AS c4, coalesce((SELECT sum(w) FROM meta WHERE s = c.cluster_id), 0)::INT AS c5 FROM c
"""
)
def cluster_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "events").groupBy(F.col("user_id").alias("pk")).agg(F.lit(1).alias("days"))
    h = blocking.from_groups(user_calls(spark, sf_dir), rows.select("pk", F.floor(F.col("pk") / 25).alias("grp")))
    v = FeatureVector((FeatureSpec("days", 1, "point"),))
    return blocking.cluster_features(h, 1, rows, v).select("cluster_id", "c1", "c2", "c3", "c4", "c5")


def _geography(spark: SparkSession, sf_dir: str) -> blocking.Hierarchy:
    """Customers below nations below regions."""
    c = t(spark, sf_dir, "customer").join(t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("pk"), "n_nationkey", "n_regionkey")
    levels = [c.select("pk", F.min("pk").over(W.partitionBy(k)).alias("cluster_id")) for k in ("n_regionkey", "n_nationkey")]
    edges = c.select(F.col("pk").alias("src"), (F.col("pk") + 1).alias("dst"))
    return blocking.from_levels(edges, levels)


GEO_SQL = "m AS (SELECT c_custkey AS pk, min(c_custkey) OVER (PARTITION BY n_regionkey) AS r, min(c_custkey) OVER (PARTITION BY n_nationkey) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey)"


@query(f"WITH {GEO_SQL} SELECT 1 AS level, r AS cluster_id, pk FROM m UNION ALL SELECT 2, n, pk FROM m")
def hierarchy_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _geography(spark, sf_dir).membership


@query(f"WITH {GEO_SQL} SELECT DISTINCT n AS cluster_id, r AS parent, 'PRIME' AS cluster_type FROM m")
def clusters_at_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _geography(spark, sf_dir).at(2).select("cluster_id", "parent", "cluster_type")


@query(f"WITH {GEO_SQL} SELECT DISTINCT NULL::BIGINT AS parent, r AS child, false AS child_is_leaf, 1 AS level FROM m UNION SELECT r, n, false, 2 FROM m UNION SELECT n, pk, true, 3 FROM m")
def dendrogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _geography(spark, sf_dir).dendrogram()


@query(f"WITH {CALLS_SQL} SELECT src % 7 AS src, dst % 7 AS dst, count(*) AS weight FROM calls GROUP BY ALL")
def meta_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.contract(user_calls(spark, sf_dir), user_groups(spark, sf_dir))


@query(
    f"""
WITH {CALLS_SQL}, w AS (SELECT src % 7 AS a, dst % 7 AS b, weight::DOUBLE AS w FROM calls), m AS (SELECT sum(w) AS m FROM w),
o AS (SELECT a AS c, sum(w) AS o, sum(w) FILTER (a = b) AS l FROM w GROUP BY 1), i AS (SELECT b AS c, sum(w) AS i FROM w GROUP BY 1)
SELECT round(sum(coalesce(l, 0)) / max(m) - sum(o * i) / (max(m) * max(m)), 9) AS modularity FROM o JOIN i USING (c), m
"""
)
def modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.modularity(user_calls(spark, sf_dir), user_groups(spark, sf_dir)).select(F.round("modularity", 9).alias("modularity"))


def order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers (even numbers) and their orders (odd): many small components."""
    return t(spark, sf_dir, "orders").select((F.col("o_custkey") * 2).alias("src"), (F.col("o_orderkey") * 2 + 1).alias("dst"))


ORDERS_SQL = "e AS (SELECT o_custkey * 2 AS a, o_orderkey * 2 + 1 AS b FROM orders)"


@query(
    f"""
WITH RECURSIVE {ORDERS_SQL}, u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, x) AS (SELECT a, a FROM u UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.x)
SELECT node, min(x) AS component FROM r GROUP BY node
"""
)
def connected_components_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = connected_components(order_edges(spark, sf_dir), "src", "dst", cut)
    names = roots.groupBy("root").agg(F.min("node").alias("component"))
    return roots.join(names, "root").select("node", "component")


QUERIES["connected_components"] = QUERIES.pop("connected_components_query")
ORACLE_SQL["connected_components"] = ORACLE_SQL.pop("connected_components_query")


@query(
    f"""
WITH {ORDERS_SQL}, u AS (SELECT a AS v, b AS n FROM e UNION SELECT b, a FROM e),
s AS (SELECT v, string_agg(n, ',' ORDER BY n) AS s FROM u GROUP BY v), c AS (SELECT v, string_agg(n, ',' ORDER BY n) AS s FROM (SELECT * FROM u UNION SELECT v, v FROM u) GROUP BY v),
f AS (SELECT 'PARALLEL' AS kind, v, min(v) OVER (PARTITION BY s) AS module, count(*) OVER (PARTITION BY s) AS k FROM s UNION ALL SELECT 'SERIES', v, min(v) OVER (PARTITION BY s), count(*) OVER (PARTITION BY s) FROM c)
SELECT v, kind, module FROM f WHERE k > 1
"""
)
def twin_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.twins(order_edges(spark, sf_dir))


def _small_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users' control-flow graphs as one graph of many components with up to five vertices."""
    vertex = lambda c: ((F.col("user_id") * 16 + F.col("bucket")) * 8 + F.col(c)).cast("bigint").alias(c)
    return event_cfgs(spark, sf_dir).where("dst IS NOT NULL").select(vertex("src"), vertex("dst"))


#: All sets of vertices of a component are tried as modules; those that overlap no other make up the tree.
MODULES_SQL = f"""
WITH RECURSIVE {CFG_SQL},
d AS (SELECT DISTINCT user_id * 16 + bucket AS h, src AS a, dst AS b FROM g WHERE dst IS NOT NULL),
vx AS (SELECT h, a AS v FROM d UNION SELECT h, b FROM d),
un AS (SELECT h, a, b FROM d WHERE a <> b UNION SELECT h, b, a FROM d WHERE a <> b),
am AS (SELECT vx.h, vx.v, coalesce(bit_or(1 << b), 0) AS near FROM vx LEFT JOIN un ON un.h = vx.h AND un.a = vx.v GROUP BY ALL),
reach(h, v, w) AS (SELECT h, v, v FROM vx UNION SELECT r.h, r.v, un.b FROM reach r JOIN un ON un.h = r.h AND un.a = r.w),
co AS (SELECT h, v, bit_or(1 << w) AS whole FROM reach GROUP BY ALL),
sets AS (SELECT h, whole, k AS s FROM (SELECT DISTINCT h, whole FROM co), range(1, 32) r(k) WHERE k & whole = k AND bit_count(k) > 1),
mo AS (SELECT * FROM sets WHERE NOT EXISTS (SELECT 1 FROM am WHERE am.h = sets.h AND sets.whole & (1 << am.v) <> 0 AND sets.s & (1 << am.v) = 0 AND am.near & sets.s NOT IN (0, sets.s))),
st AS (SELECT * FROM mo WHERE NOT EXISTS (SELECT 1 FROM mo o WHERE o.h = mo.h AND o.whole = mo.whole AND o.s & mo.s <> 0 AND o.s & mo.s <> o.s AND o.s & mo.s <> mo.s)),
within(h, s, co, v) AS (
  SELECT st.h, s, flip, min(v) FROM st JOIN vx ON vx.h = st.h AND s & (1 << v) <> 0, (VALUES (false), (true)) f(flip) GROUP BY ALL
  UNION SELECT w.h, w.s, w.co, b.v FROM within w JOIN am a ON a.h = w.h AND a.v = w.v JOIN vx b ON b.h = w.h AND w.s & (1 << b.v) <> 0 AND b.v <> w.v WHERE (a.near & (1 << b.v) <> 0) <> w.co),
split AS (SELECT h, s, bool_or(NOT co AND n < bit_count(s)) AS parallel, bool_or(co AND n < bit_count(s)) AS series FROM (SELECT h, s, co, count(*) AS n FROM within GROUP BY ALL) GROUP BY ALL),
up AS (SELECT co.h, co.v, arg_min(st.s, bit_count(st.s)) AS s FROM co JOIN st ON st.h = co.h AND st.whole = co.whole AND st.s & (1 << co.v) <> 0 GROUP BY ALL),
leaf AS (SELECT up.h * 8 + v AS pk, min(up.h * 8 + v) OVER (PARTITION BY up.h, up.s) AS module, CASE WHEN parallel THEN 'PARALLEL' WHEN series THEN 'SERIES' ELSE 'PRIME' END AS kind FROM up JOIN split ON split.h = up.h AND split.s = up.s),
lone AS (SELECT h * 8 + v AS pk, min(h * 8 + v) OVER () AS module, 'PARALLEL' AS kind FROM co WHERE bit_count(whole) = 1)
SELECT pk::BIGINT AS pk, module::BIGINT AS module, kind FROM (SELECT * FROM leaf UNION ALL SELECT * FROM lone)
"""


@query(MODULES_SQL)
def small_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modular.modules(_small_graphs(spark, sf_dir), cut)


@query(f"SELECT module AS cluster_id, kind AS cluster_type, count(*) AS n, min(pk) AS first_pk, max(pk) AS last_pk FROM ({MODULES_SQL}) GROUP BY ALL")
def modular_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decomposition as a hierarchy of three levels."""
    h = blocking.modular_hierarchy(_small_graphs(spark, sf_dir), cut)
    return h.membership.join(h.at(1), ["level", "cluster_id"]).groupBy("cluster_id", "cluster_type").agg(F.count("*").alias("n"), F.min("pk").alias("first_pk"), F.max("pk").alias("last_pk"))


PLANES = [[(k * k + 3 * d * k + d * d + k * d * d) % 17 - 8 for d in range(64)] for k in range(1, 17)]


@query(
    "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings) SELECT vec_id, ("
    + " + ".join(f"CASE WHEN list_inner_product(v, {p}::DOUBLE[]) >= 0 THEN {1 << k} ELSE 0 END" for k, p in enumerate(PLANES))
    + ")::INT AS bucket FROM v"
)
def lsh_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double"))
    return t(spark, sf_dir, "embeddings").select("vec_id", blocking.lsh_bucket(v, [[float(x) for x in p] for p in PLANES]).alias("bucket"))


@query(
    f"""
WITH RECURSIVE {ORDERS_SQL}, u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, x) AS (SELECT a, a FROM u UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.x)
SELECT 1 AS level, min(x) AS cluster_id, node AS pk FROM r GROUP BY node
"""
)
def louvain_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers amid their orders: whatever the order of moves, the communities are the components, and there is one level."""
    return blocking.louvain_consensus(order_edges(spark, sf_dir), cut).membership


@query()
def louvain_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of the graph of consecutive users, at every level."""
    h = blocking.louvain_consensus(user_calls(spark, sf_dir), cut)
    return h.membership if h else spark.createDataFrame([], "level int, cluster_id bigint, pk bigint")


@query(
    f"""
WITH {ORDERS_SQL}, n AS (SELECT a, count(DISTINCT b) AS n, min(b) AS first FROM e GROUP BY a)
SELECT DISTINCT b AS pk, CASE WHEN n = 1 THEN least(n.a, b) ELSE first END AS module, CASE WHEN n = 1 THEN 'SERIES' ELSE 'PARALLEL' END AS kind FROM e JOIN n ON n.a = e.a
UNION ALL SELECT a, CASE WHEN n = 1 THEN least(a, first) ELSE a END, 'SERIES' FROM n
"""
)
def modular_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every component is a customer amid orders: next to the customer stand the orders, in parallel if there are several."""
    return modular.modules(order_edges(spark, sf_dir), cut)


# -- whole diffs


#: The whole exact diff, a pass in each step: phase 0 and 2 neighbourhoods, 1 unique vectors, 3 windows.
PASSES_SQL = f"""
p(l, r, fresh, whole, phase, gain, n) AS (
  SELECT pk, pk, true, true, 0, false, 0 FROM seed
  UNION ALL (
    WITH {blocks_sql("p", "fresh AND phase IN (0, 2)")}, {UNIQUE_SQL}, {SETTLED_SQL},
    now AS (SELECT max(phase) AS now FROM p),
    fl AS (SELECT pk, days, clicks FROM u WHERE NOT late AND pk NOT IN (SELECT l FROM p)), fr AS (SELECT pk, days, clicks FROM u WHERE late AND pk NOT IN (SELECT r FROM p)),
    single AS (SELECT x.pk AS lhs_pk, y.pk AS rhs_pk FROM (SELECT days, clicks, min(pk) AS pk FROM fl GROUP BY ALL HAVING count(*) = 1) x JOIN (SELECT days, clicks, min(pk) AS pk FROM fr GROUP BY ALL HAVING count(*) = 1) y USING (days, clicks), now WHERE now = 1),
    gap AS (SELECT l, r, lag(l) OVER (ORDER BY l) AS lo, lag(r) OVER (ORDER BY l) AS ro FROM p WHERE phase = 3),
    win AS (SELECT lo, ro, least(l - lo, r - ro) AS w FROM gap WHERE r > ro),
    wx AS (SELECT lo, ro, w, days, clicks, min(pk) AS lhs_pk FROM win JOIN fl ON pk > lo AND pk <= lo + w GROUP BY ALL HAVING count(*) = 1),
    wy AS (SELECT lo, ro, w, days, clicks, min(pk) AS rhs_pk FROM win JOIN fr ON pk > ro AND pk <= ro + w GROUP BY ALL HAVING count(*) = 1),
    wk AS (SELECT lhs_pk, rhs_pk, row_number() OVER (PARTITION BY lhs_pk ORDER BY lo, ro, w, rhs_pk) AS a, row_number() OVER (PARTITION BY rhs_pk ORDER BY lo, ro, w, lhs_pk) AS b FROM wx JOIN wy USING (lo, ro, w, days, clicks)),
    new AS (SELECT lhs_pk, rhs_pk FROM k WHERE a = 1 AND b = 1 UNION ALL SELECT lhs_pk, rhs_pk FROM single UNION ALL SELECT lhs_pk, rhs_pk FROM wk WHERE a = 1 AND b = 1),
    many AS (SELECT count(*) AS c FROM new),
    next AS (
      SELECT max(n) + 1 AS n, bool_and(CASE WHEN phase IN (0, 2) THEN c = 0 ELSE true END) AS fresh,
        max(CASE WHEN phase IN (0, 2) THEN CASE WHEN c = 0 AND whole THEN phase + 1 ELSE phase END WHEN phase = 1 THEN 2 WHEN c > 0 THEN 3 ELSE 1 END) AS phase,
        bool_or(CASE WHEN phase = 0 OR phase = 3 AND c = 0 THEN false ELSE gain OR c > 0 END) AS gain
      FROM p, many HAVING NOT bool_and(phase = 3 AND c = 0 AND NOT gain)
    )
    SELECT p.l, p.r, next.fresh, next.fresh, next.phase, next.gain, next.n FROM p, next
    UNION ALL SELECT lhs_pk, rhs_pk, true, next.fresh, next.phase, next.gain, next.n FROM new, next
  )
),
found AS (SELECT l, r FROM p WHERE n = (SELECT max(n) FROM p))
"""
DIFF_SQL = f"WITH RECURSIVE {HALVES_SQL}, {PASSES_SQL} SELECT l AS lhs_pk, r AS rhs_pk FROM found"


@query(DIFF_SQL)
def diff_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some users keep their names; exact passes only."""
    a, b = user_sides(spark, sf_dir)
    a.rows, b.rows = _with_clicks(_visible(a.rows, None)), _with_clicks(_visible(b.rows, None))
    return diff(a, b, Options(imports=False, names=True, inexact=False, strict_exact=True), cut, DAYS).matches.select("lhs_pk", "rhs_pk")


@query(
    f"""
WITH RECURSIVE {HALVES_SQL}, {PASSES_SQL},
la AS (SELECT *, row_number() OVER (ORDER BY pk) AS i FROM u WHERE NOT late AND pk NOT IN (SELECT l FROM found)), ra AS (SELECT *, row_number() OVER (ORDER BY pk) AS j FROM u WHERE late AND pk NOT IN (SELECT r FROM found)),
part_of(x, y, d) AS (SELECT x, y, CASE WHEN greatest(x, y) = 0 THEN 0 ELSE abs(x - y) / greatest(x, y)::DOUBLE END FROM (SELECT DISTINCT a.days AS x, b.days AS y FROM la a, ra b UNION SELECT DISTINCT a.clicks, b.clicks FROM la a, ra b)),
dist AS (SELECT 0 AS one, i, j, (g.d + h.d) / 2 AS d FROM la a JOIN ra b ON true JOIN part_of g ON g.x = a.days AND g.y = b.days JOIN part_of h ON h.x = a.clicks AND h.y = b.clicks),
{solve_sql("one")}
SELECT (SELECT count(*) FROM found) AS n_exact, n_pairs AS n_inexact, cost FROM costs
"""
)
def diff_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some users keep their names; exact passes, then the best assignment of the rest."""
    a, b = user_sides(spark, sf_dir)
    a.rows, b.rows = _with_clicks(_visible(a.rows, None)), _with_clicks(_visible(b.rows, None))
    found = diff(a, b, Options(imports=False, names=True, strict_exact=True), cut, DAYS).matches
    last = F.col("matcher") == "optimal_singleton"
    return found.agg(F.count_if(~last).alias("n_exact"), F.count_if(last).alias("n_inexact"), F.round(F.sum(F.when(last, F.col("distance"))), 6).alias("cost"))


@query()
def diff_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff(*user_sides(spark, sf_dir), Options(imports=False), cut, BOW).matches


@query()
def diff_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some users keep their names on both sides; the rest follows from them."""
    a, b = user_sides(spark, sf_dir)
    a.rows, b.rows = _visible(a.rows, "l"), _visible(b.rows, "r")
    return diff(a, b, Options(imports=False, names=True), cut, BOW).matches


@query()
def diff_hierarchical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff(*user_sides(spark, sf_dir), Options(imports=False, hierarchy="groups"), cut, BOW).matches
