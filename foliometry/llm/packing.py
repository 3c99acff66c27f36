"""Lexical retrieval packing: BM25 neighbours of a seed fill its window, in bounded shards of lexically close pieces.

Every document's ids are cut into full windows and a rest. Full windows are sequences of their own. Rests are put into shards of about
`shard_pieces` by their rarest shared term, so that texts with a rare term in common lie together; terms that hold more rests than a shard
are split by a hash. Document frequencies cover all rests of the corpus; the tables that reach the driver are bounded by the vocabulary.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliometry.llm.tables import arrow_pass, new_folder, read
from foliometry.llm.tokenizing import encoder
from foliometry.llm.words import blocks

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
WINDOW = 2048
SHARD_PIECES = 512
K1, B = 1.2, 0.75

RESTS = "doc_id bigint, row bigint, doc_tokens bigint, full_crcs array<bigint>, rest binary, terms binary"
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def crc32(ids: np.ndarray) -> int:
    """Of little-endian unsigned 32-bit ids."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def window_rests(documents: DataFrame, vocabulary: str = VOCABULARY, window: int = WINDOW) -> DataFrame:
    """Per row of documents: its number of ids, the checksums of its full windows, the ids left and the different ones among these, written to the shared folder."""

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        code = encoder(vocabulary)
        for row, end, data, offsets in blocks(batch.column("text")):
            flat, where = code.ids_block(data, offsets)
            totals, crcs, rests, terms = [], [], [], []
            for k in range(end - row):
                ids = np.append(flat[where[k] : where[k + 1]], flat.dtype.type(END_ID))
                full = len(ids) // window * window
                totals.append(len(ids))
                crcs.append([crc32(ids[a : a + window]) for a in range(0, full, window)])
                rests.append(ids[full:].tobytes())
                terms.append(np.unique(ids[full:]).tobytes())
            found = {"full_crcs": pa.array(crcs, pa.list_(pa.int64())), "rest": pa.array(rests, pa.binary()), "terms": pa.array(terms, pa.binary())}
            yield {"doc_id": batch.column("doc_id")[row:end], "row": batch.column("row")[row:end], "doc_tokens": totals, **found}

    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("bigint"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("string"))
    path = new_folder(spark, "rests")
    arrow_pass(rows, step, RESTS).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(RESTS).parquet(path)


def _terms(batch: pa.RecordBatch, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The different terms of the batch's rests, one rest after another, and where each rest's begin."""
    column = batch.column("terms").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return np.ascontiguousarray(data[offsets[0] : offsets[-1]]).view(dtype), (offsets - offsets[0]) // dtype.itemsize


class Statistics:
    """Corpus-wide figures for BM25; idf is 0 for terms in half of all rests or more, which so never make neighbours."""

    def __init__(self, terms: np.ndarray, frequencies: np.ndarray, rests: int, mean_length: float):
        self.idf = np.zeros(int(terms.max(initial=-1)) + 1, np.float32)
        self.idf[terms] = np.maximum(0, np.log((rests - frequencies + 0.5) / (frequencies + 0.5)))
        self.frequency = np.zeros(len(self.idf), np.int64)
        self.frequency[terms] = frequencies
        self.mean_length = max(mean_length, 1.0)


def corpus_statistics(rests: DataFrame, dtype: np.dtype) -> Statistics:
    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        counts = np.bincount(_terms(batch, dtype)[0])
        terms = np.flatnonzero(counts)
        yield {"term": terms, "n": counts[terms]}

    counts = arrow_pass(rests.select("terms"), step, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    whole = rests.where(F.length("rest") > 0).agg(F.count("*").alias("n"), F.avg(F.length("rest")).alias("size")).first()
    return Statistics(counts.column("term").to_numpy(), counts.column("n").to_numpy(), whole["n"], (whole["size"] or 0) / dtype.itemsize)


def key_terms(rests: DataFrame, statistics: Statistics, dtype: np.dtype) -> DataFrame:
    """(row, key) per rest: its rarest term that another rest has too, or -1."""
    shared = rests.sparkSession.sparkContext.broadcast(statistics)

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        term, first = _terms(batch, dtype)
        often = shared.value.frequency[term]
        order = np.where(often > 1, often << 32 | term, np.iinfo(np.int64).max)
        key = np.full(batch.num_rows, -1, np.int64)
        some = np.flatnonzero(np.diff(first))
        best = np.minimum.reduceat(order, first[some]) if len(some) else np.zeros(0, np.int64)
        key[some] = np.where(best < np.iinfo(np.int64).max, best & 0xFFFFFFFF, -1)
        yield {**{c: batch.column(c) for c in batch.schema.names if c != "terms"}, "key": key}

    kept = [f"{f.name} {f.dataType.simpleString()}" for f in rests.schema if f.name != "terms"]
    return arrow_pass(rests, step, ", ".join([*kept, "key bigint"]))


def shard_layout(counts: list[tuple[int, int]], target: int) -> list[tuple[int, int, int]]:
    """(key, first shard, shards): neighbouring keys share a shard of about `target` rests, a larger key has several for itself."""
    layout, shard, filled = [], 0, 0
    for key, n in sorted(counts):
        if filled and filled + n > target:
            shard, filled = shard + 1, 0
        parts = max(1, -(-n // target))
        layout.append((key, shard, parts))
        shard, filled = (shard, filled + n) if parts == 1 else (shard + parts, 0)
    return layout


def fill_windows(rests: list[np.ndarray], statistics: Statistics, window: int) -> list[tuple[int, int, int, int, int]]:
    """(rest, begin, length, sequence, offset) of the pieces of one shard.

    The seed is the rest that was cut last, else the longest unused one. Its unused neighbours come by BM25 score, ties and unrelated ones in the
    order given; those that fit are taken whole, then the best one left is cut to fill the window to the last id.
    """
    n = len(rests)
    left = np.array([len(r) for r in rests], np.int64)
    begin, unused = np.zeros(n, np.int64), left > 0
    flat = np.concatenate(rests).astype(np.int64) if n else np.zeros(0, np.int64)
    both, tf = np.unique((flat << 32) | np.repeat(np.arange(n), left), return_counts=True)
    term, holder = both >> 32, both & 0xFFFFFFFF
    weight = statistics.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * left[holder] / statistics.mean_length))
    telling = weight > 0
    term, holder, weight = term[telling], holder[telling], weight[telling]
    heads = np.flatnonzero(np.diff(term, prepend=-1))
    sizes = np.diff(heads, append=len(term))
    slot = np.repeat(np.arange(len(heads)), sizes)
    by_rest = np.argsort(holder, kind="stable")
    own_slots, own_first = slot[by_rest], np.searchsorted(holder[by_rest], np.arange(n + 1))
    longest, at = np.argsort(-left, kind="stable"), 0
    pieces, sequence, seed = [], 0, -1
    while True:
        if seed < 0:
            while at < n and not unused[longest[at]]:
                at += 1
            if at == n:
                return pieces
            seed = int(longest[at])
        pieces.append((seed, int(begin[seed]), int(left[seed]), sequence, 0))
        unused[seed] = False
        offset, room, seed_of = int(left[seed]), window - int(left[seed]), seed
        seed = -1
        if room and unused.any():
            mine = own_slots[own_first[seed_of] : own_first[seed_of + 1]]
            reach = sizes[mine]
            posting = np.repeat(heads[mine] - np.concatenate([[0], np.cumsum(reach)[:-1]]).astype(np.int64), reach) + np.arange(int(reach.sum()))
            score = np.bincount(holder[posting], weight[posting], n)
            ranked = np.flatnonzero(unused)
            ranked = ranked[np.argsort(-score[ranked], kind="stable")]
            rejected = -1
            for one, size in zip(ranked.tolist(), left[ranked].tolist(), strict=True):
                if size <= room:
                    pieces.append((one, int(begin[one]), size, sequence, offset))
                    unused[one] = False
                    offset, room = offset + size, room - size
                    if not room:
                        break
                elif rejected < 0:
                    rejected = one
            if room and rejected >= 0:
                pieces.append((rejected, int(begin[rejected]), room, sequence, offset))
                begin[rejected] += room
                left[rejected] -= room
                seed = rejected
        sequence += 1


def pack(documents: DataFrame, vocabulary: str = VOCABULARY, window: int = WINDOW, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone. Repeated rows are packed each; an empty table gives no rows; other columns are ignored. Only the last
    sequence of a shard can be short of the window. Sequence ids are the shard number times 2**32 plus a number inside the shard.
    """
    spark = documents.sparkSession
    dtype = encoder(vocabulary).dtype
    rests = window_rests(documents, vocabulary, window)
    statistics = corpus_statistics(rests, dtype)
    keyed = key_terms(rests, statistics, dtype)
    counts = [(r["key"], r["count"]) for r in key_terms(rests.select("terms"), statistics, dtype).groupBy("key").count().collect()]
    layout = spark.createDataFrame(shard_layout(counts, shard_pieces) or [(-1, 0, 1)], "key bigint, first bigint, parts bigint")
    sharded = keyed.join(F.broadcast(layout), "key").withColumn("shard", F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts")))
    shared = spark.sparkContext.broadcast(statistics)

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        shard = int(table.column("shard")[0].as_py())
        ids = [np.frombuffer(x, dtype) for x in table.column("rest").to_pylist()]
        documents, totals = table.column("doc_id").to_pylist(), table.column("doc_tokens").to_pylist()
        rows, sequence = [], 0
        for k, begin, length, sequence, offset in fill_windows(ids, shared.value, window):
            rows.append((documents[k], totals[k] - len(ids[k]) + begin, length, crc32(ids[k][begin : begin + length]), totals[k], (shard << 32) + sequence, offset))
        for k, crcs in enumerate(table.column("full_crcs").to_pylist()):
            for part, crc in enumerate(crcs):
                sequence += 1
                rows.append((documents[k], part * window, window, crc, totals[k], (shard << 32) + sequence, 0))
        names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
        return pa.table({name: pa.array(column, pa.int64()) for name, column in zip(names, zip(*rows, strict=True), strict=True)})

    return sharded.groupBy("shard").applyInArrow(fill, PIECES)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
