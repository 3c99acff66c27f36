"""Training order on disk: sequences of ids take their global slots from a keyed permutation and lie in fixed-stride shard files.

Each input partition joins its documents' ids, an end id after each, into sequences of a fixed length and numbers them. The pair (partition,
number) is a position in a domain of partitions x 2**32, which a Feistel network permutes; values beyond the domain are walked on until
they fall inside. Shards are equal ranges of permuted values; a sequence's global slot is its rank among the values that occur, which
is the sum of the smaller shards' sizes plus its row in the shard file. So the texts are encoded once and moved once.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliometry.llm.tables import arrow_pass, new_folder, read, stored
from foliometry.llm.tokenizing import encoder
from foliometry.llm.words import blocks, mix

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
LENGTH = 2048
SHARD_BYTES = 32 << 20
BYTES_PER_ID = 2.5
KEY = 20_240_229
ROUNDS = 4
NUMBERS = 1 << 32

SEQUENCES = "position bigint, shard int, n_ids int, doc_ids array<bigint>, lengths array<int>, ids binary"
WRITTEN = "position bigint, shard int, row_in_shard bigint, n_ids int, ids_crc32 bigint, doc_ids array<bigint>, lengths array<int>"


def permuted(values: np.ndarray, domain: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """A keyed bijection of [0, domain): a balanced Feistel network on the next even number of bits, walked until inside."""
    half = np.uint64(max(1, (max(domain - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = mix(np.arange(rounds, dtype=np.uint64) + np.uint64(key * 0x9E3779B97F4A7C15 % (1 << 64)))
    out = values.astype(np.uint64)
    outside = np.ones(len(out), bool)
    while outside.any():
        left, right = out[outside] >> half, out[outside] & mask
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & mask)
        out[outside] = (left << half) | right
        outside = out >= np.uint64(domain)
    return out.astype(np.int64)


def sequences(documents: DataFrame, shards: int, vocabulary: str, length: int, key: int) -> DataFrame:
    """Sequences with their permuted positions; the last one of a partition is filled up with the end id, n_ids tells the real ones."""
    rows = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    domain = max(1, rows.rdd.getNumPartitions()) * NUMBERS
    width = -(-domain // shards)
    schema = pa.schema([("position", pa.int64()), ("shard", pa.int32()), ("n_ids", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(vocabulary)
        first, number = TaskContext.get().partitionId() * NUMBERS, 0
        ids, owners, sizes = np.zeros(0, code.dtype), [], []

        def cut(ids: np.ndarray, owners: list, sizes: list, final: bool) -> tuple[pa.RecordBatch, np.ndarray, list, list]:
            nonlocal number
            count = -(-len(ids) // length) if final else len(ids) // length
            ends = np.cumsum(np.array(sizes, np.int64))
            starts = ends - np.array(sizes, np.int64)
            made: list[list] = [[], [], [], []]
            for k in range(count):
                low, high = k * length, min((k + 1) * length, len(ids))
                a, b = int(np.searchsorted(ends, low, "right")), int(np.searchsorted(starts, high, "left"))
                made[0].append(high - low)
                made[1].append(owners[a:b])
                made[2].append([int(min(ends[j], high) - max(starts[j], low)) for j in range(a, b)])
                made[3].append(np.concatenate([ids[low:high], np.full(length - (high - low), END_ID, ids.dtype)]).tobytes())
            position = permuted(np.arange(number, number + count) + first, domain, key)
            number += count
            used = min(count * length, len(ids))
            a = int(np.searchsorted(ends, used, "right"))
            rest = [int(ends[j] - max(starts[j], used)) for j in range(a, len(owners))]
            columns = [position, position // width, *made]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema), ids[used:], owners[a:], rest

        for batch in batches:
            for row, end, data, offsets in blocks(batch.column("text")):
                flat, where = code.ids_block(data, offsets)
                ids = np.concatenate([ids, np.insert(flat, where[1:], flat.dtype.type(END_ID))])
                owners = owners + batch.column("doc_id")[row:end].to_pylist()
                sizes = sizes + (np.diff(where) + 1).tolist()
                made, ids, owners, sizes = cut(ids, owners, sizes, False)
                yield made
        if len(ids):
            yield cut(ids, owners, sizes, True)[0]

    return rows.mapInArrow(run, SEQUENCES)


def materialise(documents: DataFrame, folder: str, vocabulary: str = VOCABULARY, length: int = LENGTH, shard_bytes: int = SHARD_BYTES, key: int = KEY) -> DataFrame:
    """Write shard files under `folder` and return one row per sequence, ordered by nothing: slot, shard, row_in_shard, n_ids, ids_crc32, doc_ids, lengths.

    Sequence `row_in_shard` of a shard is the `stride` bytes from `row_in_shard * stride` of its file, so a reader resumes at any slot. Files are
    written under a name of their own and renamed when whole: a repeated task replaces equal content. A null or empty text is the end id alone;
    repeated rows are written each; an empty table gives no files and no rows; other columns are ignored.
    """
    spark = documents.sparkSession
    size = documents.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    shards = max(8, int(size / BYTES_PER_ID * encoder(vocabulary).dtype.itemsize / shard_bytes))
    dealt = sequences(documents, shards, vocabulary, length, key).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "position")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder if "://" in folder else _as_uri(folder))
        store.create_dir(path, recursive=True)
        mark, current, file, row = uuid.uuid4().hex, -1, None, 0

        def finish() -> None:
            file.close()
            store.move(f"{path}/.{current:08d}-{mark}", f"{path}/shard-{current:08d}.bin")

        for batch in batches:
            shard, ids = batch.column("shard").to_pylist(), batch.column("ids").to_pylist()
            rows, crcs = [], []
            for s, raw, n in zip(shard, ids, batch.column("n_ids").to_pylist(), strict=True):
                if s != current:
                    if file:
                        finish()
                    current, row = s, 0
                    file = store.open_output_stream(f"{path}/.{current:08d}-{mark}")
                file.write(raw)
                rows.append(row)
                crcs.append(zlib.crc32(np.frombuffer(raw, dtype)[:n].astype("<u4").tobytes()))
                row += 1
            columns = {"row_in_shard": pa.array(rows, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())}
            yield pa.RecordBatch.from_pydict({c.split()[0]: columns.get(c.split()[0], batch.column(c.split()[0]) if c.split()[0] in batch.schema.names else None) for c in WRITTEN.split(", ")})
        if file:
            finish()

    dtype = encoder(vocabulary).dtype
    written = stored(dealt.mapInArrow(write, WRITTEN))
    sizes = written.groupBy("shard").agg(F.count("*").alias("rows"))
    before = sizes.select("shard", F.coalesce(F.sum("rows").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return written.join(before, "shard").select((F.col("before") + F.col("row_in_shard")).alias("slot"), "shard", "row_in_shard", "n_ids", "ids_crc32", "doc_ids", "lengths")


def _as_uri(folder: str) -> str:
    return f"file://{folder.removeprefix('file:')}"


def read_sequences(folder: str, shard: int, row: int, count: int, vocabulary: str = VOCABULARY, length: int = LENGTH) -> np.ndarray:
    """(count, length) ids from a row of a shard file on, by one seek and one read."""
    from pyarrow import fs

    dtype = encoder(vocabulary).dtype
    store, path = fs.FileSystem.from_uri(folder if "://" in folder else _as_uri(folder))
    with store.open_input_file(f"{path}/shard-{shard:08d}.bin") as file:
        file.seek(row * length * dtype.itemsize)
        return np.frombuffer(file.read(count * length * dtype.itemsize), dtype).reshape(-1, length)


def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(read(spark, sf_dir, "documents"), new_folder(spark, "training-order"))
