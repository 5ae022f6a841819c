"""The corpus pipeline: stages in order, each written as Parquet and reread as the next one's documents.

Every stage works on all documents that its predecessor kept, and its decisions take effect: the
classifier, the near-duplicate search and the decontamination drop documents, the PII stage rewrites
texts, packing returns the pieces of every document that is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelens.llm import decontam, neardup, packing, pii, quality
from quotelens.llm.common import read, stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from labelled documents outside the held-out fold.

    Where they don't hold both classes there is nothing to tell documents apart by, and all are kept.
    """
    net = quality.fit(docs, read(spark, sf_dir, "labels"))
    if net.prior is not None:
        return docs
    return quality.score(docs, net, keep_text=True).where(F.col("score") >= quality.ACCEPT).select(*docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one with the smallest doc_id."""
    return neardup.keep_one_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontam.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; ``n_chars`` follows the text."""
    redacted = pii.redact(pii.find(docs, pii.fit(docs)))
    return redacted.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(packing.MODEL))


STAGES = [
    ("quality classifier", quality_stage),
    ("near-duplicates", dedup_stage),
    ("decontamination", decontamination_stage),
    ("personal data", pii_stage),
    ("packing", packing_stage),
]

#: A learned classifier, learned spans and a tokenizer are not SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
