"""Incremental market data: landed bar files become revisions, the newest revision wins per day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from foliometry.operators.market import INSTRUMENT, merged_bars

STORED = T.StructType(
    [
        T.StructField("market_id", T.LongType()),
        T.StructField("instrument_type", T.StringType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("currency", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("raw_close", T.DoubleType()),
        T.StructField("adjusted_close", T.DoubleType()),
        T.StructField("revision", T.LongType()),
    ]
)


def merge_stream(bars: DataFrame, folder: str, checkpoint: str, order: tuple[str, ...] = ()) -> StreamingQuery:
    """Write every micro-batch of bars as one revision; a replayed batch overwrites its own folder.

    ``bars`` is a streaming frame with (market_id, instrument, date, raw_close, adjusted_close) and the
    columns of ``order``, by which the later of several observations of a day in one batch wins; equal
    orders, and a batch without one, are settled by the bar itself, so that a replay agrees.  The
    revision is the batch number, so a retry after a failure cannot add the same rows twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy("market_id", *INSTRUMENT, "date").agg(
            F.max(F.struct(*order, "raw_close", "adjusted_close")).alias("bar")
        )
        rows = latest.select("market_id", *INSTRUMENT, "date", "bar.raw_close", "bar.adjusted_close")
        rows.withColumn("revision", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return (
        bars.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_merged(spark: SparkSession, folder: str) -> DataFrame:
    return merged_bars(spark.read.schema(STORED).parquet(folder))
