"""Quality classifier: ordinal cumulative-link regression of graded ratings on hashed words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliometry.llm.quality_rules import FEATURES, features, training_rows
from foliometry.llm.statistics import text_statistics
from foliometry.llm.tables import arrow_pass, read, stored
from foliometry.llm.words import LOWER, blocks, hashes, mix, owners, words

TRAINING_ROWS = 20_000
MIN_DOCUMENTS = 4
TABLE_BITS = 22
TEXT_BLOCK = 1 << 20
MIN_ASSOCIATION = 0.08
STEM_BYTES = (4, 5, 6)
STEPS = 400
RATE = 0.1
RIDGE = 1e-5
GRADES = 3
KEEP_FROM = 2
MIN_TAIL = 0.5

ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

#: Upper limits of the bins of each statistic that is hashed as a feature of its own.
STATISTIC_BINS = (0.0, 0.005, 0.01, 0.02, 0.04, 0.08, 0.12, 0.18, 0.25, 0.35, 0.5, 0.7, 1.0, 1.5, 2.5, 4.0, 6.0, 9.0, 14.0, 25.0, 60.0, 200.0)


@dataclass
class OrdinalModel:
    """weights: by hashed feature, shared by all grades; thresholds: ascending, one fewer than grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. grades-1, as columns."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))


def hashed_features(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of each text, ascending per text, and where each text's begin.

    A word counts lower-cased and without the punctuation around it, and so do its first 4, 5 and 6 bytes, which inflected forms share; what
    follows its last letter or digit counts as a feature of its own, as does a bin of each statistic. With weights, features of weight 0 are left out.
    """
    n = len(offsets) - 1
    starts, ends, first = words(data, offsets)
    place = np.arange(len(data), dtype=np.int64)
    firm = ALNUM[data]
    after = np.where(firm, place, len(data))
    after = np.minimum.accumulate(after[::-1])[::-1] if len(data) else after
    before = np.maximum.accumulate(np.where(firm, place, -1)) if len(data) else place
    core_start, core_end = (np.minimum(after[starts], ends), np.maximum(before[ends - 1] + 1, starts)) if len(starts) else (starts, ends)
    bare = core_start >= ends
    core_start, core_end = np.where(bare, starts, core_start), np.where(bare, ends, core_end)
    of_word = owners(first)
    small = LOWER[data]
    tail = core_end < ends
    keys = [hashes(small, core_start, core_end), hashes(small, core_end[tail], ends[tail]) ^ np.uint64(0x5DEECE66D)]
    texts = [of_word, of_word[tail]]
    for size in STEM_BYTES:
        longer = core_end - core_start > size
        keys.append(hashes(small, core_start[longer], core_start[longer] + size) ^ np.uint64(0xB5297A4D + size))
        texts.append(of_word[longer])
    x = features(text_statistics(data, offsets))
    bins = np.searchsorted(np.array(STATISTIC_BINS), x, "left").astype(np.uint64)
    for f in range(len(FEATURES)):
        keys.append(mix(bins[:, f] * np.uint64(1_000_003) + np.uint64((f + 1) << 40)))
        texts.append(np.arange(n))
    slots = (np.concatenate(keys) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
    of_slot = np.concatenate(texts)
    if weights is not None:
        heavy = weights[slots] != 0
        slots, of_slot = slots[heavy], of_slot[heavy]
    both = np.unique((of_slot << TABLE_BITS) | slots)
    return both & ((1 << TABLE_BITS) - 1), np.searchsorted(both >> TABLE_BITS, np.arange(n + 1))


def associated(rows: DataFrame) -> np.ndarray:
    """Features of MIN_DOCUMENTS texts or more whose grades differ: their correlation with some upper grades is MIN_ASSOCIATION or more, and at
    least 3 standard errors. rows: (grade, slots); counts are added up per batch, then per feature; only the features chosen come back."""

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        each = [np.frombuffer(x, np.int32) for x in batch.column("slots").to_pylist()]
        grades = np.repeat(batch.column("grade").to_numpy().astype(np.int64), [len(x) for x in each])
        both, n = np.unique(np.concatenate([np.zeros(0, np.int32), *each]).astype(np.int64) * GRADES + grades, return_counts=True)
        yield {"slot": both // GRADES, "grade": both % GRADES, "n": n}

    totals = {r["grade"]: r["count"] for r in rows.groupBy("grade").count().collect()}
    n = sum(totals.values())
    counts = arrow_pass(rows.select("grade", "slots"), step, "slot bigint, grade bigint, n bigint").groupBy("slot")
    above = [F.sum(F.when(F.col("grade") >= k, F.col("n")).otherwise(0)).alias(f"above{k}") for k in range(1, GRADES)]
    table = counts.agg(F.sum("n").alias("n"), *above).where(F.col("n") >= MIN_DOCUMENTS)
    strength = F.lit(0.0)
    for k in range(1, GRADES):
        p = sum(m for g, m in totals.items() if g >= k) / max(n, 1)
        if 0 < p < 1:
            strength = F.greatest(strength, F.abs(F.col(f"above{k}") - F.col("n") * p) / F.sqrt(F.col("n") * p * (1 - p)))
    chosen = table.where(strength >= max(3.0, MIN_ASSOCIATION * n**0.5)).select("slot").toArrow()
    return np.sort(chosen.column("slot").to_numpy())


def fit_ordinal(slots: np.ndarray, first: np.ndarray, grades: np.ndarray) -> OrdinalModel:
    """Adam on the cumulative-link likelihood, in which each grade weighs alike. Features that occur nowhere keep weight 0.

    Without rows, or with one grade only, all weights are 0 and every tail probability is 1 at or below that grade (no rows: all grades).
    """
    table = np.zeros(1 << TABLE_BITS, np.float32)
    seen = np.unique(grades)
    if len(seen) < 2:
        best = int(seen[0]) if len(seen) else GRADES - 1
        return OrdinalModel(table, np.where(np.arange(1, GRADES) <= best, -40.0, 40.0))
    kept, column = np.unique(slots, return_inverse=True)
    rows = np.repeat(np.arange(len(grades)), np.diff(first))
    n = len(grades)
    per_grade = np.bincount(grades, minlength=GRADES)
    weight = (n / len(seen) / np.maximum(per_grade, 1))[grades]
    at_least = (grades[:, None] >= np.arange(1, GRADES)[None, :]).astype(float)
    share = np.clip(at_least.mean(0), 1e-3, 1 - 1e-3)
    start = -np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(start), 0.05))
    x = np.concatenate([np.zeros(len(kept)), start[:1], gaps])
    moment, square = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, STEPS + 1):
        w, theta = x[: len(kept)], np.concatenate([x[len(kept) : len(kept) + 1], x[len(kept)] + np.cumsum(np.exp(x[len(kept) + 1 :]))])
        score = np.bincount(rows, w[column], n)
        above = np.concatenate([np.ones((n, 1)), 1 / (1 + np.exp(np.clip(theta[None, :] - score[:, None], -40, 40))), np.zeros((n, 1))], 1)
        slope = above * (1 - above)
        mine = np.arange(n), grades
        likelihood = np.maximum(above[mine] - above[np.arange(n), grades + 1], 1e-9)
        pull = weight / likelihood / n
        d_score = -(slope[mine] - slope[np.arange(n), grades + 1]) * pull
        d_theta = np.array([(np.where(grades == k, slope[:, k], 0) * pull - np.where(grades == k - 1, slope[:, k], 0) * pull).sum() for k in range(1, GRADES)])
        steps = np.exp(x[len(kept) + 1 :])
        gradient = np.concatenate([np.bincount(column, d_score[rows], len(kept)) + RIDGE * w, [d_theta.sum()], [d_theta[k:].sum() * steps[k - 1] for k in range(1, GRADES - 1)]])
        moment = 0.9 * moment + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        x = x - RATE * (moment / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-9)
    table[kept] = x[: len(kept)]
    return OrdinalModel(table, np.concatenate([x[len(kept) : len(kept) + 1], x[len(kept)] + np.cumsum(np.exp(x[len(kept) + 1 :]))]))


def grade_of(quality: str = "quality", toxic: str = "toxic") -> F.Column:
    """0: low quality, 1: good prose that is toxic, 2: good."""
    return F.when(F.col(quality) <= 0, 0).when(F.col(toxic) > 0, 1).when(F.col(quality) > 0, 2)


def fit_classifier(documents: DataFrame, labels: DataFrame, limit: int = TRAINING_ROWS) -> OrdinalModel:
    """Fit on at most `limit` labelled documents, by their features that are associated with the grades. One task fits; the driver gets weights only."""
    sample = F.broadcast(training_rows(labels, grade_of(), limit))

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        for row, end, data, offsets in blocks(batch.column("text"), TEXT_BLOCK):
            slots, first = hashed_features(data, offsets)
            slots = slots.astype(np.int32)
            yield {"doc_id": batch.column("doc_id")[row:end], "grade": batch.column("grade")[row:end], "slots": pa.array([slots[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())}

    rows = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).join(sample, "doc_id")
    found = arrow_pass(rows.select("doc_id", "grade", "text"), step, "doc_id bigint, grade int, slots binary")
    found = stored(found.groupBy("doc_id", "grade").agg(F.min("slots").alias("slots")))
    chosen = associated(found)

    def choose(batch: pa.RecordBatch) -> Iterator[dict]:
        each = [np.frombuffer(x, np.int32) for x in batch.column("slots").to_pylist()]
        yield {"doc_id": batch.column("doc_id"), "grade": batch.column("grade"), "slots": pa.array([x[np.isin(x, chosen)].tobytes() for x in each], pa.binary())}

    few = arrow_pass(found, choose, "doc_id bigint, grade int, slots binary")
    weighed = few.coalesce(1).mapInArrow(fit_rows, "slot bigint, weight double").toArrow()
    slot, weight = (weighed.column(name).to_numpy() for name in ("slot", "weight"))
    table = np.zeros(1 << TABLE_BITS, np.float32)
    table[slot[slot >= 0]] = weight[slot >= 0]
    return OrdinalModel(table, weight[slot < 0])


def fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slot, weight) of the model of all rows (doc_id, grade, slots): weights other than 0, then the thresholds, whose slot is -1."""
    schema = pa.schema([("doc_id", pa.int64()), ("grade", pa.int32()), ("slots", pa.binary())])
    few = pa.Table.from_batches([b.cast(schema) for b in batches], schema).sort_by("doc_id")
    each = [np.frombuffer(b, np.int32) for b in few.column("slots").to_pylist()]
    first = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
    slots = np.concatenate(each).astype(np.int64) if each else np.zeros(0, np.int64)
    model = fit_ordinal(slots, first, few.column("grade").to_numpy().astype(np.int64))
    heavy = np.flatnonzero(model.weights)
    slot = np.concatenate([heavy, np.full(GRADES - 1, -1)]).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(np.concatenate([model.weights[heavy].astype(float), model.thresholds]))], ["slot", "weight"])


def judged(model: OrdinalModel, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """expected_grade, p_good and kept of each text of a block."""
    slots, first = hashed_features(data, offsets, model.weights)
    score = np.bincount(owners(first), model.weights[slots].astype(float), len(offsets) - 1)
    tails = model.tails(score)
    good = tails[:, KEEP_FROM - 1]
    return {"expected_grade": tails.sum(1), "p_good": good, "kept": (np.diff(words(data, offsets)[2]) > 0) & (good >= MIN_TAIL)}


def classify(documents: DataFrame, model: OrdinalModel) -> DataFrame:
    """doc_id, expected_grade, p_good (P(grade >= 2)) and kept for each row of documents, over whole texts, without a shuffle.

    A null, empty or blank text has no words to judge and is rejected; repeated rows are judged alike; other columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        for row, end, data, offsets in blocks(batch.column("text"), TEXT_BLOCK):
            yield {"doc_id": batch.column("doc_id")[row:end], **judged(shared.value, data, offsets)}

    return arrow_pass(documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), step, "doc_id bigint, expected_grade double, p_good double, kept boolean")


def select_good(documents: DataFrame, model: OrdinalModel) -> DataFrame:
    """The rows of documents, with all their columns, that classify() would keep."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in blocks(batch.column("text"), TEXT_BLOCK):
                yield batch.slice(row, end - row).filter(pa.array(judged(shared.value, data, offsets)["kept"]))

    return documents.mapInArrow(run, documents.schema)


def quality_classifier(documents: DataFrame, labels: DataFrame, limit: int = TRAINING_ROWS) -> DataFrame:
    """Fit on labelled rows (doc_id, quality, toxic), then grade every document."""
    return classify(documents, fit_classifier(documents, labels, limit))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
