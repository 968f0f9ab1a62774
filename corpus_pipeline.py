"""The corpus pipeline: language ID, near duplicates, decontamination, BPE encoding.

Every stage takes (spark, docs, sf_dir), works on all documents that the one
before it kept and returns a DataFrame; all but the last return the columns of
documents.  ``run`` writes each result as Parquet to the shared folder and reads
it again for the next.

Defined cases: documents of one id and different texts are documents of their
own; repeated rows are copies, of which one stays; documents without an id are
compared like all others; texts that are null or have no letter have no language
and go in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphkin.llm import bpe, decontaminate, language_id, ngram_join
from graphkin.llm.common import bucket_of, shared_dir, table
from graphkin.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MIN_LANGUAGE_SHARE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or of which no language holds half, go."""
    model = language_id.train(docs.where(bucket_of(F.col("doc_id"), 5) != 0))
    found = language_id.identify(docs, model)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SHARE)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles at 0.8, the one of the smallest doc_id stays; those without an id come last."""
    rows = docs.withColumn("_row", F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text"))  # one for repeated rows
    found = ngram_join.components(rows.select("_row", "text"), id_col="_row", n=5, percent=80).select("_row", "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("first")
    keep = found.join(rows.select("_row", "doc_id").distinct(), "_row").groupBy("component_id").agg(first).select("first._row")
    return rows.join(keep, "_row", "left_semi").dropDuplicates(["_row"]).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.flag(docs, table(spark, sf_dir, "benchmark")).where(F.size("leaks") == 0).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids."""
    return bpe.encode(docs, vocabulary()).select(*(c for c in docs.columns if c != "text"), F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("bpe", encode),
]

#: SQL can't express the models of the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
