"""Uniform shuffle into shards of exact size, by a communication matrix with the law of a uniform permutation.

Rows are numbered and put into blocks by a hash of that number. How many rows each block sends to each shard is drawn from the multivariate
hypergeometric law with both margins fixed: the block sizes and the shard sizes, which differ by one row at most. Each block permutes its
rows and deals them out by its row of the matrix; each shard permutes what it got, in sub-blocks. All steps are joins and windows over
bounded blocks; the matrix, one small row per block, is the only thing drawn on the driver.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliometry.llm.tables import read, stored

SHARDS = 8
BLOCK_ROWS = 250_000
MIN_BLOCKS = 64
SEED = 20_250_117


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of `draws` balls without replacement are good, by inversion from the mode outwards; exact up to rounding of doubles at any size."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))

    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    peak = math.exp(log_choose(good, mode) + log_choose(bad, draws - mode) - log_choose(good + bad, draws))
    u = rng.random() - peak
    up = down = mode
    p_up = p_down = peak
    while u > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode


def communication_matrix(blocks: dict[int, int], shards: int, seed: int) -> list[tuple[int, int, int, int]]:
    """(block, shard, first, end): the block's permuted rows [first, end) go to the shard; sums over blocks differ by one at most."""
    rng = random.Random(seed)
    total = sum(blocks.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    rows = []
    for block in sorted(blocks):
        left, others, first = blocks[block], sum(room), 0
        for shard in range(shards):
            others -= room[shard]
            n = hypergeometric(rng, room[shard], others, left)
            room[shard] -= n
            left -= n
            if n:
                rows.append((block, shard, first, first + n))
            first += n
    return rows


def draw(seed: int, what: str) -> Column:
    """A 64-bit hash of the row's number, one stream for each use."""
    return F.xxhash64(F.lit(seed), F.lit(what), F.col("row"))


def shuffle_into_shards(documents: DataFrame, shards: int = SHARDS, seed: int = SEED, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row; slot counts from 0 in each shard without gaps.

    The law is `rows`: shard sizes differ by one row at most, so grown_shard is null. A null text has size 1 and the checksum of no bytes. Equal rows
    are dealt like any other, each has its own number; an empty table gives no rows; other columns are ignored. Numbers, and so the shuffle,
    are the same for the same seed and the same split of the input files.
    """
    spark = documents.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = stored(
        documents.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            (F.octet_length(text) + 1).cast("bigint").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    total = rows.count()
    blocks = max(MIN_BLOCKS, -(-total // block_rows))
    dealt = rows.withColumn("block", F.pmod(draw(seed, "block"), F.lit(blocks)))
    counts = {r["block"]: r["count"] for r in dealt.groupBy("block").count().collect()}
    matrix = spark.createDataFrame(communication_matrix(counts, shards, seed), "block bigint, shard int, first bigint, end bigint")
    per_block = matrix.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("first", "shard"))).alias("plan"))
    locally = F.row_number().over(Window.partitionBy("block").orderBy(draw(seed, "local"), "row")) - 1
    chosen = F.aggregate("plan", F.lit(0), lambda found, part: F.when(part["first"] <= F.col("rank"), part["shard"]).otherwise(found))
    sent = dealt.withColumn("rank", locally).join(F.broadcast(per_block), "block").withColumn("shard", chosen.cast("int"))
    sent = sent.withColumn("part", F.pmod(draw(seed, "part"), F.lit(max(1, blocks // shards)))).select("doc_id", "size", "text_crc32", "row", "shard", "part")
    parts = sent.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("shard", "part", before.alias("before"))
    again = F.row_number().over(Window.partitionBy("shard", "part").orderBy(draw(seed, "again"), "row")) - 1
    return (
        sent.withColumn("rank", again)
        .join(F.broadcast(starts), ["shard", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("before") + F.col("rank")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shuffle_into_shards(read(spark, sf_dir, "documents"))
