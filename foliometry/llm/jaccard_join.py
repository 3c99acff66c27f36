"""N-gram Jaccard join by vertical partitioning of the global n-gram order, and the components of its links.

1. Each text becomes a set of hashed n-grams; equal sets share a signature and go on as one.
2. The hash range is cut into fragments. A fragment holds every set's n-grams of its range, packed, and counts in how many sets each occurs.
   N-grams of a single set can match nothing, so a fragment passes on only their number and the shared n-grams with their counts.
3. Per set the parts are summed. The global order is (count, hash), rarest first. Sets that J >= t links share an n-gram among their first
   n - ceil(t n) + 1; a set whose own n-grams fill that prefix is linked with nothing and leaves.
4. Candidates meet on prefix n-grams, under the length and position bounds. First every set meets only the most central set of each n-gram; what
   the verified links connect needs no further pair. Then the remaining candidates from different components meet.
5. Overlaps of a pair are counted fragment by fragment and summed; the sum decides exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliometry.llm.components import components
from foliometry.llm.tables import arrow_pass, free_names, read, stored
from foliometry.llm.words import LOWER, blocks, hashes, mix, owners, window_hashes, words

SHINGLE_WORDS = 3
THRESHOLD = (9, 10)
NEAR_SHINGLE_WORDS = 5
NEAR_THRESHOLD = (8, 10)
FRAGMENT_BYTES = 16 << 20
MIN_FRAGMENTS = 16
OVERLAP_FRAGMENTS = 8

HASH_BITS = 48
PACKED = "fragment bigint, signatures binary, sizes binary, counts binary, grams binary"
SHARED = "bucket bigint, signatures binary, sizes binary, alone binary, counts binary, grams binary, often binary"
SETS = "signature bigint, n bigint, alone bigint, grams array<bigint>"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-grams of each text, ascending, and where each text's begin. Fewer words than `size` are one n-gram, no word is none."""
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    each, of_word, count = hashes(data, starts, ends), owners(first), np.diff(first)
    windows = window_hashes(each, size)
    whole = of_word[: len(windows)] == of_word[len(of_word) - len(windows) :]
    short = np.flatnonzero((count > 0) & (count < size))
    brief = np.zeros(len(short), np.uint64)
    for k in range(size - 1):
        longer = count[short] > k
        brief[longer] = mix(brief[longer] * np.uint64(0x9FB21C651E98DF25) + each[first[short[longer]] + k])
    gram = np.concatenate([windows[whole], mix(brief + np.uint64(0xE7037ED1A0B428DB))]) >> np.uint64(64 - HASH_BITS)
    text = np.concatenate([of_word[: len(windows)][whole], short]).astype(np.uint64)
    both = np.unique((text << np.uint64(HASH_BITS)) | gram)
    return both & np.uint64((1 << HASH_BITS) - 1), np.searchsorted(both >> np.uint64(HASH_BITS), np.arange(len(offsets), dtype=np.uint64))


def signatures(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set, 0 for the empty set."""
    total = np.zeros(len(grams) + 1, np.uint64)
    np.cumsum(mix(grams + np.uint64(1)), out=total[1:])
    return np.where(np.diff(first) > 0, mix(np.diff(total[first]) + np.diff(first).astype(np.uint64)) | np.uint64(1), np.uint64(0)).view(np.int64)


def _row_blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    return blocks(batch.column("text"))


def set_rows(documents: DataFrame, size: int) -> DataFrame:
    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        for row, end, data, offsets in _row_blocks(batch):
            grams, first = shingle_sets(data, offsets, size)
            yield {"doc_id": batch.column("doc_id")[row:end], "n": np.diff(first), "signature": signatures(grams, first)}

    return arrow_pass(documents.select("doc_id", "text"), step, "doc_id bigint, n bigint, signature bigint")


def _packed(grams: np.ndarray) -> bytes:
    return np.ascontiguousarray(grams.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : HASH_BITS // 8]).tobytes()


def _unpacked(parts: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, HASH_BITS // 8)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, : HASH_BITS // 8] = raw
    return wide.reshape(-1).view("<u8").astype(np.uint64)


def _joined(column: pa.ChunkedArray, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def fragment_rows(documents: DataFrame, size: int, fragments: int) -> DataFrame:
    """Per block of texts and fragment: the signatures of the sets with n-grams there, their sizes, how many n-grams each has there, and these."""

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        for _, _, data, offsets in _row_blocks(batch):
            grams, first = shingle_sets(data, offsets, size)
            sizes, marks = np.diff(first), signatures(grams, first)
            _, once = np.unique(marks, return_index=True)
            fresh = np.zeros(len(sizes), bool)
            fresh[once] = True
            text = np.repeat(np.arange(len(sizes)), sizes)
            kept = fresh[text]
            text, grams = text[kept], grams[kept]
            fragment = ((grams >> np.uint64(HASH_BITS - 32)) * np.uint64(fragments)) >> np.uint64(32)
            order = np.argsort(fragment, kind="stable")
            fragment, text, grams = fragment[order], text[order], grams[order]
            runs = np.flatnonzero(np.diff(fragment.astype(np.int64) * len(sizes) + text, prepend=-1))
            counts = np.diff(runs, append=len(text))
            numbers, begins = np.unique(fragment[runs], return_index=True)
            stops = np.append(begins, len(runs))[1:]
            out: dict[str, list] = {"fragment": numbers.astype(np.int64), "signatures": [], "sizes": [], "counts": [], "grams": []}
            for a, b in zip(begins, stops, strict=True):
                low, high = runs[a], runs[b - 1] + counts[b - 1]
                out["signatures"].append(marks[text[runs[a:b]]].tobytes())
                out["sizes"].append(sizes[text[runs[a:b]]].astype("<i4").tobytes())
                out["counts"].append(counts[a:b].astype("<i4").tobytes())
                out["grams"].append(_packed(grams[low:high]))
            yield out

    return arrow_pass(documents.select("text"), step, PACKED)


def count_fragment(table: pa.Table, buckets: int) -> pa.Table:
    """In one fragment: how many sets hold each n-gram. Per bucket of signatures: n-grams of one set as a number, the shared ones with their counts."""
    marks, sizes, counts = _joined(table.column("signatures"), "<i8"), _joined(table.column("sizes"), "<i4"), _joined(table.column("counts"), "<i4")
    grams = _unpacked(table.column("grams").to_pylist())
    marks, once = np.unique(marks, return_index=True)
    starts = np.cumsum(counts) - counts
    counts = counts[once].astype(np.int64)
    grams = grams[np.repeat(starts[once] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]
    _, column, often = np.unique(grams, return_inverse=True, return_counts=True)
    often = often[column]
    run = np.repeat(np.arange(len(marks)), counts)
    shared = often > 1
    bucket = np.mod(marks, buckets)
    order = np.argsort(bucket, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    run, grams, often = rank[run[shared]], grams[shared], np.minimum(often[shared], 2**31 - 1)
    by_run = np.argsort(run, kind="stable")
    run, grams, often = run[by_run], grams[by_run], often[by_run]
    together = np.bincount(run, minlength=len(marks))
    alone = counts[order] - together
    border = np.searchsorted(run, np.arange(len(marks) + 1))
    numbers, begins = np.unique(bucket[order], return_index=True)
    stops = np.append(begins, len(marks))[1:]
    out: dict[str, list] = {name: [] for name in ("signatures", "sizes", "alone", "counts", "grams", "often")}
    for a, b in zip(begins, stops, strict=True):
        out["signatures"].append(marks[order[a:b]].tobytes())
        out["sizes"].append(sizes[once][order[a:b]].tobytes())
        out["alone"].append(alone[a:b].astype("<i4").tobytes())
        out["counts"].append(together[a:b].astype("<i4").tobytes())
        out["grams"].append(_packed(grams[border[a] : border[b]]))
        out["often"].append(often[border[a] : border[b]].astype("<i4").tobytes())
    return pa.table({"bucket": pa.array(numbers, pa.int64())} | {name: pa.array(values, pa.binary()) for name, values in out.items()})


def prefix_length(n: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    a, b = threshold
    return n - -(-a * n // b) + 1


def surviving_sets(table: pa.Table, threshold: tuple[int, int]) -> pa.Table:
    """In one bucket: sum each set's parts; keep sets whose unshared n-grams leave room in the prefix, shared n-grams in the global order."""
    marks, sizes = _joined(table.column("signatures"), "<i8"), _joined(table.column("sizes"), "<i4").astype(np.int64)
    alone, counts = _joined(table.column("alone"), "<i4"), _joined(table.column("counts"), "<i4").astype(np.int64)
    grams, often = _unpacked(table.column("grams").to_pylist()), _joined(table.column("often"), "<i4")
    marks, first, which = np.unique(marks, return_index=True, return_inverse=True)
    n, alone = sizes[first], np.bincount(which, alone, len(marks)).astype(np.int64)
    owner = np.repeat(which, counts)
    stays = alone < prefix_length(n, threshold)
    kept = stays[owner]
    owner, grams, often = owner[kept], grams[kept], often[kept]
    order = np.lexsort((grams, often, owner))
    offsets = np.searchsorted(owner[order], np.append(np.flatnonzero(stays), len(marks)))
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(grams[order].view(np.int64)))
    return pa.table({"signature": pa.array(marks[stays]), "n": pa.array(n[stays]), "alone": pa.array(alone[stays]), "grams": lists})


def least_overlap(n_a: Column, n_b: Column, threshold: tuple[int, int]) -> Column:
    a, b = threshold
    return F.ceil(a * (n_a + n_b) / (a + b) - 1e-9)


def _meeting(left: DataFrame, right: DataFrame, threshold: tuple[int, int], *more: Column) -> DataFrame:
    """Pairs of prefix rows under one n-gram that the length and position bounds allow, each once: (a, b, n_a, n_b), a < b."""
    x, y = left.alias("x"), right.alias("y")
    a, b = threshold
    least = least_overlap(F.col("x.n"), F.col("y.n"), threshold)
    near = (b * F.least("x.n", "y.n") >= a * F.greatest("x.n", "y.n")) & (F.col("x.n") - F.col("x.at") >= least) & (F.col("y.n") - F.col("y.at") >= least)
    condition = (F.col("x.gram") == F.col("y.gram")) & near
    for extra in more:
        condition = condition & extra
    swap = F.col("x.signature") > F.col("y.signature")
    pick = lambda c: (F.when(swap, F.col(f"y.{c}")).otherwise(F.col(f"x.{c}")), F.when(swap, F.col(f"x.{c}")).otherwise(F.col(f"y.{c}")))
    (low, high), (n_low, n_high) = pick("signature"), pick("n")
    return x.join(y, condition).select(low.alias("a"), high.alias("b"), n_low.alias("n_a"), n_high.alias("n_b")).distinct()


def linked(pairs: DataFrame, parts: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(a, b) of the pairs whose similarity reaches the threshold: overlaps are counted per fragment and summed."""
    a, b = threshold
    left = parts.select(F.col("signature").alias("a"), "part", F.col("grams").alias("left"))
    right = parts.select(F.col("signature").alias("b"), "part", F.col("grams").alias("right"))
    shared = pairs.join(left, "a").join(right, ["b", "part"]).select("a", "b", "n_a", "n_b", F.size(F.array_intersect("left", "right")).alias("overlap"))
    total = shared.groupBy("a", "b", "n_a", "n_b").agg(F.sum("overlap").alias("overlap"))
    return total.where((a + b) * F.col("overlap") >= a * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def links(documents: DataFrame, size: int, threshold: tuple[int, int]) -> DataFrame:
    """Components (node, component) over signatures of different sets; sets without a link are missing."""
    total = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    fragments = max(MIN_FRAGMENTS, -(-total // FRAGMENT_BYTES))
    counted = fragment_rows(documents, size, fragments).groupBy("fragment").applyInArrow(lambda t: count_fragment(t, fragments), SHARED)
    sets = stored(counted.groupBy("bucket").applyInArrow(lambda t: surviving_sets(t, threshold), SETS))
    a, b = threshold
    room = F.col("n") - F.ceil(a * F.col("n") / b - 1e-9) + 1 - F.col("alone")
    prefix = sets.select("signature", "n", "alone", F.posexplode(F.slice("grams", F.lit(1), room.cast("int"))).alias("place", "gram"))
    prefix = stored(prefix.select("gram", "signature", "n", "alone", (F.col("alone") + F.col("place")).alias("at")))
    shift = HASH_BITS - (OVERLAP_FRAGMENTS - 1).bit_length()
    cut = lambda f: F.struct(f.cast("int").alias("part"), F.filter("grams", lambda g: F.shiftright(g, shift) == f).alias("grams"))
    parts = sets.select("signature", F.explode(F.transform(F.sequence(F.lit(0), F.lit(OVERLAP_FRAGMENTS - 1)), cut)).alias("part"))
    parts = parts.select("signature", "part.part", "part.grams").where(F.size("grams") > 0)

    centres = prefix.groupBy("gram").agg(F.min(F.struct("alone", "signature", "n", "at")).alias("centre"), F.count("*").alias("members"))
    centres = centres.where("members > 1").select("gram", "centre.*")
    first = stored(_meeting(prefix, centres, threshold, F.col("x.signature") != F.col("y.signature")))
    near = stored(linked(first, parts, threshold))
    known = components(near)

    placed = prefix.join(known, prefix["signature"] == known["node"], "left").select(*prefix.columns, F.coalesce("component", "signature").alias("component"))
    placed = stored(placed)
    open_grams = placed.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("gram")
    rest = placed.join(open_grams, "gram", "left_semi")
    pairs = _meeting(rest, rest, threshold, F.col("x.signature") < F.col("y.signature"), F.col("x.component") != F.col("y.component"))
    late = stored(linked(pairs.join(first, ["a", "b"], "left_anti"), parts, threshold))
    return components(near.unionByName(late))


def jaccard_components(documents: DataFrame, size: int = SHINGLE_WORDS, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest linked doc_id) of each row of documents.

    Null, empty and blank texts have no n-gram and are their own component. Rows with equal sets are linked, repeated rows too; a null doc_id
    counts only where a component has no other. An empty table gives no rows; other columns are ignored.
    """
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = stored(set_rows(texts, size))
    found = links(texts, size, threshold)
    smallest = rows.where("n > 0").groupBy("signature").agg(F.min("doc_id").alias("doc_id"))
    grouped = smallest.join(found, smallest["signature"] == found["node"], "left").select("signature", "doc_id", F.coalesce("component", "signature").alias("component"))
    grouped = stored(grouped)
    least = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = grouped.join(least, "component").select("signature", "component_id")
    return rows.join(named, "signature", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(documents: DataFrame, size: int = NEAR_SHINGLE_WORDS, threshold: tuple[int, int] = NEAR_THRESHOLD) -> DataFrame:
    """documents, with all their columns, with one row of each component: the one with the smallest doc_id, the first of equal ones.

    Rows are numbered once and written with their numbers, so all later steps see the same ones. Texts without a word link with nothing and stay; null
    doc_ids come last. An empty table gives no rows; other columns keep names and values, whatever they are called.
    """
    (row,) = free_names(documents, "row")
    numbered = stored(documents.withColumn(row, F.monotonically_increasing_id()))
    found = jaccard_components(numbered.select(F.col(row).alias("doc_id"), "text"), size, threshold)
    ids = numbered.select(F.col(row).alias("doc_id"), F.col("doc_id").alias("own_id"))
    least = F.min(F.struct(F.col("own_id").isNull().alias("missing"), "own_id", "doc_id"))
    chosen = found.join(ids, "doc_id").groupBy("component_id").agg(least.alias("least")).select(F.col("least.doc_id").alias(row))
    return numbered.join(chosen, row, "left_semi").select(*documents.columns)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
shingles AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
sets AS (SELECT min(doc_id) AS rep, list_sort(s) AS s, len(s) AS n FROM shingles GROUP BY list_sort(s), len(s)),
grams AS (SELECT rep, n, unnest(s) AS gram FROM sets),
pairs AS (SELECT x.rep AS a, y.rep AS b FROM grams x JOIN grams y ON x.gram = y.gram AND x.rep < y.rep AND 10 * x.n >= 9 * y.n AND 10 * y.n >= 9 * x.n
    GROUP BY x.rep, y.rep, x.n, y.n HAVING 19 * count(*) >= 9 * (x.n + y.n)),
edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(node, seen) AS (SELECT rep, rep FROM sets UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.seen),
least AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, d.n::BIGINT AS n_shingles, CASE WHEN d.n = 0 THEN d.doc_id ELSE l.component_id END AS component_id
FROM (SELECT doc_id, list_sort(s) AS s, len(s) AS n FROM shingles) d JOIN sets USING (s, n) JOIN least l ON l.node = sets.rep
"""
