"""A training-data pipeline over documents: STAGES in order, each written as Parquet and reread as the next one's docs.

Rows without id are judged like others: decontamination and near-duplicate groups address a row by
a hash of its id and text; groups, which keep their row of the smallest id, make an id from the text
of a row without.

Defined cases, for each stage: an empty table stays empty; texts of any length are treated whole; columns
besides those of documents, whatever their names, pass through (but mix_copy and mix_order, which the
last stage makes). Repeated rows are alike to language_id, decontaminate and scan_secrets and stay as many
as they are; simhash_near_dedup leaves one of them. Ties: equally near languages go to the first by name,
groups keep their smallest id, and mix_sources orders equal keys arbitrarily.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmark.llm.common import free, materialize, new_path, scratch
from strandmark.llm.decontaminate import contamination
from strandmark.llm.langid import learn, predict
from strandmark.llm.mixing import mix
from strandmark.llm.secrets import redact_secrets
from strandmark.llm.simhash import similar_documents
from strandmark.sources import paths

#: words in a shingle, and the shingle similarity from which documents are near duplicates
SHINGLE, SIMILARITY = 5, 0.8
#: a text whose n-grams are this far from those of every learned language is rejected: of 10,000 texts in learned languages
#: the least score is 0.376, of texts in Italian, Finnish, Turkish, Hungarian, Polish and Russian and of random letters the largest 0.282
MIN_SCORE = 0.3
#: ids made for rows without one begin here
LARGE = 1 << 62


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject texts without letters (null and empty ones too) and texts that resemble no learned language; name the language of rows without."""
    pred, score = free("pred", docs), free("score", docs)
    said = predict(docs, learn(docs), pred_col=pred, score_col=score).where((F.col(pred) != "und") & (F.col(score) >= MIN_SCORE))
    return said.withColumn("lang", F.coalesce("lang", pred)).select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each group; repeated rows of an id and text are one. A row without id takes one from its text, larger than any other."""
    number = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text").bitwiseAND(LARGE - 1) + F.lit(LARGE))
    key = F.xxhash64(number, "text")
    found = materialize(similar_documents(docs.select(key.alias("doc_id"), "text"), SHINGLE, SIMILARITY), "groups")
    numbers = docs.select(key.alias("doc_id"), number.alias("number")).distinct()
    named = materialize(found.join(numbers, "doc_id").select("doc_id", "component_id", "number"), "numbered")
    first = named.groupBy("component_id").agg(F.min(F.struct("number", "doc_id")).alias("first"))
    mark = free("removed", docs)
    gone = named.join(first, "component_id").where(F.col("doc_id") != F.col("first.doc_id")).select(F.col("doc_id").alias(mark))
    kept = docs.join(materialize(gone.distinct(), "removed"), key == F.col(mark), "left_anti")
    again = materialize(found.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    return kept if again.isEmpty() else kept.dropDuplicates(["doc_id", "text"])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of the benchmark."""
    key = F.xxhash64("doc_id", "text")
    hits = contamination(docs.select(key.alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    mark = free("hit", docs)
    hit = materialize(hits.where("contaminated").select(F.col("doc_id").alias(mark)).distinct(), "contaminated")
    return docs.join(hit, key == F.col(mark), "left_anti")


def scan_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are replaced by marks, and n_chars follows."""
    return redact_secrets(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replicate documents towards the sources' target weights, and shuffle."""
    return mix(docs)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("decontaminate", decontaminate),
    ("scan_secrets", scan_secrets),
    ("mix_sources", mix_sources),
]
#: profiles, components and spans have no SQL form; tests/llm/test_pipeline.py compares with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed documents, in a table of the shared folder; all else that the stages wrote there is deleted."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_path(spark, name)
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.option("compression", "zstd").parquet(path)
        if last:
            paths.delete(spark, last)
        docs, last = spark.read.schema(out.schema).parquet(path), path
    return docs
