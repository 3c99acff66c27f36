"""A corpus pipeline in five stages, each written as Parquet and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliometry.llm import decontamination, jaccard_join, packing, quality_classifier, secrets
from foliometry.llm.tables import new_folder, read


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier, fitted on the labels, grades as good."""
    return quality_classifier.select_good(docs, quality_classifier.fit_classifier(docs, read(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts that share 0.8 or more of their five-word shingles."""
    return jaccard_join.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item, also none with other numbers, names or units."""
    return decontamination.without_leaks(docs, read(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    return secrets.redact(docs, new_folder(spark, "secret-ledger"))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2,048 ids."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", select_quality),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secret_scans", redact_secrets),
    ("packing", pack_documents),
]

#: The classifier is trained, which SQL cannot express; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
