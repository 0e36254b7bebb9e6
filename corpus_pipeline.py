"""Documents to training tokens in five stages, each written before the next reads it.

Every stage works on all rows that its predecessor kept and takes the operators' own defaults.
Missing values: a null text counts as empty (language identification lets no such document
through); extra columns of the documents travel along until the last stage.

The stages run one after the other on the same executors, whose Python workers stay. Each therefore
takes small batches, a setting of the session that the stages leave set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelspark.llm import bpe, decontamination, exact_dedup, language_id, simhash_dedup
from voxelspark.llm.common import small_batches, table, written


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a letter, or unlike every language, go."""
    small_batches(spark)
    found = language_id.predicted("text", language_id.learn(docs))
    marked = docs.withColumn("__language", found)
    return marked.where((F.col("__language.lang_pred") != language_id.UNKNOWN) & (F.col("__language.score") > 0)).drop("__language")


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the smallest id."""
    small_batches(spark)
    return exact_dedup.deduplicated(docs)


def distinct_fingerprints(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones (five-word shingles, 0.8): the smallest id."""
    small_batches(spark)
    return simhash_dedup.deduplicated(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    small_batches(spark)
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digest of the decoded text."""
    small_batches(spark)
    return bpe.tokens(docs)


STAGES = [
    ("language identification", identified),
    ("exact deduplication", distinct_texts),
    ("simhash near deduplication", distinct_fingerprints),
    ("benchmark decontamination", decontaminated),
    ("bpe tokens", tokenized),
]

# Fingerprints, walks, profiles and merges have no SQL form; the tests hold the stages against
# brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
