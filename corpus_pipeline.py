"""A cleaning pipeline for training text: quality, near-duplicates, benchmark passages, tokens.

Stages take (spark, docs, sf_dir) and return a DataFrame. Each works on all rows that the one before
it kept; all but the last return the columns of ``documents``. Rows without a doc_id can't be named by
a decision on ids: the second and third stage keep them. Repeated rows of a document are one
document from the second stage on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqrank.llm import decontaminate, quality, sentencepieces, shared_shingles
from seqrank.llm.common import saved
from seqrank.session import share_code


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text scores one half or more; learned from the labels of those that may be learned from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.learn(docs, labels))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of every group whose texts share 0.8 of their five-word shingles (Jaccard)."""
    return shared_shingles.one_per_group(docs)


def unseen_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their SentencePiece ids; the text is what the ids decode to."""
    out = sentencepieces.with_tokens(docs)
    return out.select(*[out.decoded.alias("text") if c == "text" else out[c] for c in docs.columns if c in out.columns and c not in sentencepieces.NEW], "n_tokens", "ids")


STAGES = [
    ("quality classifier", good_quality),
    ("simhash near-duplicates", one_of_each),
    ("benchmark decontamination", unseen_benchmarks),
    ("sentencepiece tokens", tokens),
]

#: The classifier's tables, groups of fingerprints and token ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is a table that the next one reads."""
    share_code(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs, _ = saved(stage(spark, docs, sf_dir))
    return docs
