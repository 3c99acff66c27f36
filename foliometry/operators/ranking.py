"""Row numbers inside groups that may hold a large share of all rows.

A plain window sorts a whole group in one task.  That is what groups get whose first key has at most
a block of rows: one shuffle, or none where the rows lie by some of the keys already.  Other groups are cut into blocks of the ordering
number; rows are numbered inside their block, and block offsets come from per-block counts.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliometry.runtime import stored

BLOCK = 1_000_000


def number_within(df: DataFrame, keys: list[str], order: str, name: str, block: int = BLOCK, counted: DataFrame | None = None) -> DataFrame:
    """Add ``name`` = 1, 2, ... per ``keys`` by the whole-number column ``order`` (unique per key).

    Rows without a key or number are left out.  ``counted`` has the rows of ``df`` where ``df`` itself is dear to count.
    """
    first = keys[0]
    large = (df if counted is None else counted).groupBy(first).count().where(F.col("count") > block).select(first)
    if large.isEmpty():
        return _number_groups(df, keys, order, name)
    large = stored(large)
    small = _number_groups(df.join(large, first, "left_anti"), keys, order, name)
    return small.unionByName(_number_blocks(df.join(large, first, "left_semi"), keys, order, name, block))


def _number_groups(df: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    known = reduce(and_, [F.col(c).isNotNull() for c in (*keys, order)])
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order)).cast("bigint")
    return df.where(known).withColumn(name, rank)


def _number_blocks(df: DataFrame, keys: list[str], order: str, name: str, block: int) -> DataFrame:
    blocks = df.withColumn("rank_block", F.floor(F.col(order) / block))
    counts = blocks.groupBy(*keys, "rank_block").agg(F.count("*").alias("block_rows"))
    before = Window.partitionBy(*keys).orderBy("rank_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "rank_block", F.coalesce(F.sum("block_rows").over(before), F.lit(0)).alias("rank_offset"))
    inside = Window.partitionBy(*keys, "rank_block").orderBy(order)
    return (
        blocks.join(offsets, [*keys, "rank_block"])
        .withColumn(name, F.col("rank_offset") + F.row_number().over(inside))
        .drop("rank_block", "rank_offset")
    )
