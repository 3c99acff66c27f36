"""Quality rules: base rules on countable statistics, then monotonic boosted trees over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliometry.llm import boosted_trees
from foliometry.llm.statistics import text_statistics
from foliometry.llm.tables import arrow_pass, read, stored
from foliometry.llm.words import blocks

TRAINING_ROWS = 20_000
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

COUNTS = (
    "n_words", "n_chars", "word_chars", "n_symbols", "n_upper", "n_digits", "n_punctuation", "n_sentence_ends",
    "n_distinct_words", "n_lines", "n_dup_lines", "n_repeat_words",
)
STATISTICS = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS)

#: Feature, and how the verdict may move as it grows.
FEATURES = (
    ("log_words", 0),
    ("word_length", 0),
    ("symbols_per_word", -1),
    ("upper_share", -1),
    ("digit_share", -1),
    ("punctuation_per_word", 0),
    ("sentence_ends_per_word", 0),
    ("distinct_share", 0),
    ("words_per_line", 0),
    ("dup_line_share", -1),
    ("repeat_share", -1),
)


def statistics(documents: DataFrame) -> DataFrame:
    """doc_id and the counts of each whole text; a null or empty text has zeros. No shuffle; memory is a block of texts or one text."""

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        for row, end, data, offsets in blocks(batch.column("text")):
            yield {"doc_id": batch.column("doc_id")[row:end], **text_statistics(data, offsets)}

    return arrow_pass(documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), step, STATISTICS)


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    """(rows, features) in the order of FEATURES; a text without words has zeros."""
    c = {name: np.asarray(values, float) for name, values in counts.items()}
    words, chars, rows = np.maximum(c["n_words"], 1), np.maximum(c["n_chars"], 1), np.maximum(c["n_lines"], 1)
    columns = (
        np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / words, c["n_upper"] / chars, c["n_digits"] / chars, c["n_punctuation"] / words,
        c["n_sentence_ends"] / words, c["n_distinct_words"] / words, c["n_words"] / rows, c["n_dup_lines"] / rows, c["n_repeat_words"] / words,
    )
    return np.stack(columns, 1) if len(words) else np.zeros((0, len(FEATURES)))


def training_rows(labels: DataFrame, grade: F.Column, limit: int) -> DataFrame:
    """(doc_id, grade) of at most `limit` labelled documents, the ones with the smallest hashed ids; the lowest grade counts where they differ."""
    graded = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min(grade).alias("grade"))
    return graded.where("grade is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def fit_rules(counts: DataFrame, labels: DataFrame, limit: int = TRAINING_ROWS) -> boosted_trees.Forest:
    """Fit on at most `limit` labelled documents: (doc_id, quality) against their statistics."""
    sample = F.broadcast(training_rows(labels, F.col("quality"), limit))
    rows = counts.join(sample, "doc_id").groupBy("doc_id", "grade").agg(*(F.min(c).alias(c) for c in COUNTS)).orderBy("doc_id").toPandas()
    x = features({c: rows[c].to_numpy() for c in COUNTS})
    return boosted_trees.fit(x, (rows["grade"].to_numpy(float) > 0).astype(float), [d for _, d in FEATURES])


def judge(counts: DataFrame, forest: boosted_trees.Forest) -> DataFrame:
    """Add base_failed, score (probability of good quality) and kept."""
    spark = counts.sparkSession
    shared = spark.sparkContext.broadcast(forest)

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        c = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in COUNTS}
        score = 1 / (1 + np.exp(-shared.value.margin(features(c))))
        failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
        yield {"doc_id": batch.column("doc_id"), **c, "base_failed": failed, "score": score, "kept": ~failed & (score >= 0.5)}

    return arrow_pass(counts, step, f"{STATISTICS}, base_failed boolean, score double, kept boolean")


def quality_rules(documents: DataFrame, labels: DataFrame, limit: int = TRAINING_ROWS) -> DataFrame:
    """Statistics, base rules and verdict per row of documents.

    Null or empty texts fail the base rules; repeated rows are judged alike, once each; an empty table gives no rows. Without usable labels every
    document that passes the base rules is kept. Other columns, whatever their names, are ignored.
    """
    counts = stored(statistics(documents))
    return judge(counts, fit_rules(counts, labels, limit))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
