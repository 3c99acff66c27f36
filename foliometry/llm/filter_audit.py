"""Filter interaction audit: what five filters remove, alone and in every order, with whole-table duplicates found in radix tries.

Filters A to D look at one text; E fails for a text that a smaller doc_id has as well. Every task inserts its texts into a compressed trie whose
terminals hold the smallest id, so copies within a task are decided there and each text leaves it once. What is left is dealt into ranges of
adaptive prefixes: a prefix whose texts are more than ZONE_BYTES in all is doubled in length until none is, so that each zone's trie is bounded.
The failures of a row are a mask of five bits; rows are counted per part and mask, and all 120 orders are read off these 32 counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliometry.llm.tables import arrow_pass, read, stored
from foliometry.llm.text_trie import TextTrie

FILTERS = "ABCDE"
A, B, C, D, E = (1 << k for k in range(5))
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITALS_PERCENT = 200, 50, 3
CAPITALS = bytes(range(65, 91))
SYMBOLS = b"#$%&*|"
WORD_BREAKS = b" \t\n\v\f\r"

TRIE_BYTES = 32 << 20
ZONE_BYTES = 32 << 20
FIRST_PREFIX = 4
KEY_BYTES = 64
CHUNK_BYTES = 4 << 20
BROADCAST_ZONES = 1_000_000

DECIDED = "doc_id bigint, lang string, mask int, n bigint"
AUDIT = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


def words_in(text: bytes) -> tuple[int, int]:
    """How many words, and how many different ones. Long texts are read in chunks cut before white space; a word longer than a chunk makes its chunk longer."""
    if len(text) <= CHUNK_BYTES:
        found = text.split()
        return len(found), len(set(found))
    n, distinct, at = 0, set(), 0
    while at < len(text):
        end = at + CHUNK_BYTES
        while end < len(text) and text[end] not in WORD_BREAKS:
            end += 1
        found = text[at:end].split()
        n += len(found)
        distinct.update(found)
        at = end
    return n, len(distinct)


def failures(text: bytes, code_points: int) -> int:
    """The mask of A to D for one text."""
    n, distinct = words_in(text)
    capitals = len(text) - len(text.translate(None, CAPITALS))
    return (
        (A if n < MIN_WORDS else 0)
        | (B if 100 * distinct < MIN_DISTINCT_PERCENT * n else 0)
        | (C if 100 * capitals > MAX_CAPITALS_PERCENT * code_points else 0)
        | (D if len(text.translate(None, SYMBOLS)) < len(text) else 0)
    )


class Smallest:
    """A trie whose terminals hold [smallest id, mask, {lang: rows with that id}]; rows with larger ids are decided as they come."""

    def __init__(self):
        self.trie, self.held_bytes, self.decided = TextTrie(), 0, []

    def add(self, text: bytes, doc_id: int, lang: str | None, n: int, mask) -> None:
        """mask: a number, or what gives it for a text that is not held yet."""
        node = self.trie.terminal(text)
        if node.held is None:
            node.held = [doc_id, mask() if callable(mask) else mask, {lang: n}]
            self.held_bytes += len(text)
        elif doc_id > node.held[0]:
            self.decided.append((doc_id, lang, node.held[1] | E, n))
        else:
            if doc_id < node.held[0]:
                self.decided.extend((node.held[0], k, node.held[1] | E, m) for k, m in node.held[2].items())
                node.held[0], node.held[2] = doc_id, {}
            node.held[2][lang] = node.held[2].get(lang, 0) + n

    def smallest(self) -> Iterator[tuple[int, str | None, int, int, bytes]]:
        """(doc_id, lang, mask, n, text) of the rows with the smallest ids."""
        for node in self.trie.terminals():
            doc_id, mask, langs = node.held
            for lang, n in langs.items():
                yield doc_id, lang, mask, n, node.text[: node.end]


def within_tasks(documents: DataFrame) -> DataFrame:
    """(doc_id, lang, mask, n, text): n equal rows. A null text column tells that the mask is final; other rows have the smallest id of their text within a trie."""
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    target = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("mask", pa.int32()), ("n", pa.int64()), ("text", pa.binary())])

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), target, strict=True)], schema=target)

    def flushed(held: Smallest) -> Iterator[pa.RecordBatch]:
        waiting, size = [(*row, None) for row in held.decided], 0
        for row in held.smallest():
            waiting.append(row)
            size += len(row[4])
            if size > CHUNK_BYTES:
                yield emit(waiting)
                waiting, size = [], 0
        if waiting:
            yield emit(waiting)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Smallest()
        for batch in batches:
            sizes = pc.utf8_length(batch.column("text")).to_numpy(zero_copy_only=False)
            langs, ids = batch.column("lang").to_pylist(), batch.column("doc_id").to_pylist()
            for k, value in enumerate(batch.column("text").cast(pa.large_binary())):
                text = value.as_py()
                if ids[k] is None:
                    held.decided.append((None, langs[k], failures(text, int(sizes[k])), 1))
                else:
                    held.add(text, ids[k], langs[k], 1, lambda text=text, k=k: failures(text, int(sizes[k])))  # noqa: B023
                if held.held_bytes > TRIE_BYTES or len(held.decided) > 100_000:
                    yield from flushed(held)
                    held = Smallest()
        yield from flushed(held)

    return rows.mapInArrow(run, f"{DECIDED}, text binary")


def zone(length: Column | int) -> Column:
    """The prefix of so many bytes, by its hash; a hash that two prefixes share only puts their texts together."""
    return F.xxhash64(F.substring(F.col("text"), F.lit(1), F.lit(length) if isinstance(length, int) else length), F.lit(length) if isinstance(length, int) else length)


def heavy_zones(texts: DataFrame, zone_bytes: int) -> list[DataFrame]:
    """For prefixes of FIRST_PREFIX bytes, twice as many and so on: (heavy), the zones that hold more than zone_bytes and more than one text."""
    levels, active, length = [], texts, FIRST_PREFIX
    while True:
        sizes = active.groupBy(zone(length).alias("heavy")).agg(F.sum(F.length("text")).alias("size"), F.max(F.length("text")).alias("longest"))
        heavy = stored(sizes.where((F.col("size") > zone_bytes) & (F.col("longest") > length)).select("heavy"))
        n = heavy.count()
        if not n:
            return levels
        levels.append(F.broadcast(heavy) if n <= BROADCAST_ZONES else heavy)
        active = active.join(levels[-1], zone(length) == F.col("heavy"), "left_semi")
        length *= 2


def in_zones(texts: DataFrame, zone_bytes: int = ZONE_BYTES) -> DataFrame:
    """texts with `zone`, dealt into ranges of adaptive prefixes and sorted by zone inside: each zone lies in one task, in one piece."""
    length, placed = F.lit(FIRST_PREFIX), texts
    for k, heavy in enumerate(heavy_zones(texts, zone_bytes)):
        size = FIRST_PREFIX << k
        flagged = heavy.select(F.col("heavy").alias(f"heavy{k}"))
        placed = placed.join(flagged, zone(size) == F.col(f"heavy{k}"), "left")
        length = F.when(F.col(f"heavy{k}").isNotNull(), F.lit(size * 2)).otherwise(length)
    placed = placed.withColumn("prefix", length).withColumn("zone", zone(F.col("prefix")))
    key = F.substring(F.col("text"), F.lit(1), F.least(F.col("prefix"), F.lit(KEY_BYTES))).alias("key")
    return placed.select(*texts.columns, "zone", key).repartitionByRange("key", "zone").sortWithinPartitions("zone").drop("key")


def across_tasks(zoned: DataFrame) -> DataFrame:
    """(doc_id, lang, mask, n) with final masks: one trie per zone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("mask", pa.int32()), ("n", pa.int64())])

        def flushed(held: Smallest) -> Iterator[pa.RecordBatch]:
            rows = [*held.decided, *(row[:4] for row in held.smallest())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), target, strict=True)], schema=target)

        held, current = Smallest(), None
        for batch in batches:
            zones, ids, langs, masks, counts = (batch.column(c).to_pylist() for c in ("zone", "doc_id", "lang", "mask", "n"))
            for k, value in enumerate(batch.column("text")):
                if zones[k] != current:
                    yield from flushed(held)
                    held, current = Smallest(), zones[k]
                held.add(value.as_py(), ids[k], langs[k], counts[k], masks[k])
        yield from flushed(held)

    return zoned.mapInArrow(run, DECIDED)


def masks(documents: DataFrame, zone_bytes: int = ZONE_BYTES) -> DataFrame:
    """(doc_id, lang, mask, n): which filters the rows of documents fail, one or more rows per distinct (doc_id, lang, mask) with their number n.

    A row without doc_id neither is nor makes a duplicate; a null text is the empty one; rows with one doc_id and one text are not duplicates of
    each other. Extra columns are ignored. A task holds at most TRIE_BYTES of different texts and one long text more.
    """
    local = stored(within_tasks(documents))
    final = local.where("text is null").drop("text")
    return final.unionByName(across_tasks(in_zones(local.where("text is not null"), zone_bytes)))


def orders() -> list[tuple[str, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(order, step, and for each of the 32 masks 1 where its rows are kept, removed, redundant, unique, and 120 / failures for its share)."""
    mask = np.arange(32)
    failing = np.array([bin(m).count("1") for m in mask])
    rows = []
    for order in permutations(range(5)):
        before = 0
        for step, k in enumerate(order):
            bit = 1 << k
            fails, gone = mask & bit > 0, mask & before > 0
            rows.append(("".join(FILTERS[j] for j in order), step + 1, ~gone & ~fails, fails & ~gone, fails & gone, mask == bit, np.where(fails, 120 // np.maximum(failing, 1), 0)))
            before |= bit
    return rows


def read_off(counts: DataFrame) -> DataFrame:
    """The audit from (part, mask, n, good, toxic): 600 rows for each part."""
    struct = F.sort_array(F.collect_list(F.struct("mask", "n", "good", "toxic"))).alias("counts")

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        table = orders()
        matrices = [np.array([row[k] for row in table], np.int64) for k in range(2, 7)]
        names, steps = [row[0] for row in table], [row[1] for row in table]
        for part, found in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            n, good, toxic = np.zeros((3, 32), np.int64)
            for c in found:
                n[c["mask"]], good[c["mask"]], toxic[c["mask"]] = c["n"], c["good"], c["toxic"]
            kept, removed, redundant, unique, share = matrices
            yield {"part": [part] * len(names), "filter_order": names, "step": steps, "kept": kept @ n, "removed": removed @ n, "redundant": redundant @ n, "unique_fails": unique @ n, "good_lost": removed @ good, "toxic_lost": removed @ toxic, "shapley": share @ n}

    return arrow_pass(counts.groupBy("part").agg(struct), step, AUDIT)


def audit(documents: DataFrame, labels: DataFrame, zone_bytes: int = ZONE_BYTES) -> DataFrame:
    """One row per lang (a null one is the empty string), order of the five filters and step.

    An empty table gives no rows. A document labelled more than once is good, or toxic, if one of its labels says so. Only ids and masks meet the
    labels, summed per document, so no text is shuffled for them.
    """
    flag = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("bigint")), F.lit(0)).alias(c)
    judged = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality", "toxic").groupBy("doc_id").agg(flag("quality"), flag("toxic"))
    rows = masks(documents, zone_bytes).groupBy("doc_id", "lang", "mask").agg(F.sum("n").alias("n"))
    known = rows.join(judged, "doc_id", "left").fillna(0, ["quality", "toxic"])
    counts = known.groupBy(F.coalesce("lang", F.lit("")).alias("part"), "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("quality")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
    return read_off(counts)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM d),
j AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
    + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first_id, false)::INT AS mask
  FROM w LEFT JOIN j USING (doc_id)
),
counts AS (SELECT part, mask, bit_count(mask) AS failing, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
filters(name, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM filters a, filters b, filters c, filters d, filters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
),
steps AS (SELECT filter_order, s::INT AS step, bits[s] AS bit, coalesce(list_sum(bits[1:s - 1]), 0)::INT AS before FROM orders, range(1, 6) r(s))
SELECT part, filter_order, step,
  sum(CASE WHEN mask & (before + bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN mask & bit > 0 AND mask & before > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost,
  sum(CASE WHEN mask & bit > 0 THEN n * (120 // failing) ELSE 0 END)::BIGINT AS shapley
FROM counts, steps GROUP BY part, filter_order, step
"""
