"""A training corpus in five stages; belongs to the ``llm`` subpackage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and reread as the next stage's docs.  All but the last return the columns of
``documents``.  A stage first deletes what earlier ones wrote for results that are gone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm._store import save, sweep
from chronoweave.llm.bpe import encode_documents
from chronoweave.llm.mixing import mixed
from chronoweave.llm.ngram_join import ngram_jaccard_join
from chronoweave.llm.quality import quality_filter
from chronoweave.llm.secret_scan import redact_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    sweep(spark)
    return quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows, one with the least doc_id (null last); documents without words all stay."""
    sweep(spark)
    keyed = save(docs.withColumn("_row", F.monotonically_increasing_id()))  # rows by a written key, as ids may be null or repeat
    found = ngram_jaccard_join(keyed, id_col="_row").select(F.col("doc_id").alias("_row"), "component_id")
    ranked = found.join(keyed.select("_row", F.col("doc_id").isNull().alias("none"), "doc_id"), "_row")
    stays = save(ranked.groupBy("component_id").agg(F.min(F.struct("none", "doc_id", "_row")).alias("least")).select("least._row"))
    return keyed.join(stays, "_row", "left_semi").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in the text and n_chars to match."""
    sweep(spark)
    return redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    sweep(spark)
    return mixed(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the token ids of each kept row."""
    sweep(spark)
    return encode_documents(docs)


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("secret scans", secrets),
    ("mixing", mixing),
    ("encoding", encoding),
]

#: Hash-ordered sampling, trained models and tokenizers have no SQL form; the tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir))
    return docs
