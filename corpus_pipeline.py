"""The corpus pipeline: documents in, token ids out. Part of the corpus operators in weftspark.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspark.llm import bpe, common, decontaminate, lines, quality, simhash


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest-neighbour classifier rejects go."""
    model = quality.fit(docs, common.table(spark, sf_dir, "labels").where(~quality.held_out()))
    return quality.score(docs, model, "__quality").where(F.col("__quality") >= quality.THRESHOLD).select(docs.columns)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on over one in a hundred of a source's texts go, if these texts are their own for the rest."""
    return lines.dedup_documents(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest id stays."""
    return simhash.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of each text."""
    return bpe.encode(docs, digests_only=False)


STAGES = [
    ("quality", good_quality),
    ("line dedup", without_boilerplate),
    ("near-dedup", without_copies),
    ("decontamination", without_benchmark),
    ("bpe", tokens),
]
#: No SQL: the classifier, the fingerprints and the tokenizer are beyond it. tests/llm has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another. What a stage keeps is written once, as the next one reads it several times."""
    common.prepare(spark)
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).checkpoint()
    return STAGES[-1][1](spark, docs, sf_dir)
