"""Incremental bar merge over the event table as a file stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from foliometry.plans import fixtures
from foliometry.plans.catalog import query, rounded, sql_round
from foliometry.runtime import shared_folder
from foliometry.streaming import bars


@query(
    "bar_stream_merge",
    f"""SELECT CAST(0 AS BIGINT) AS market_id, 'SECURITY' AS instrument_type, 'U' || user_id AS ticker, 'USD' AS currency, CAST(ts AS DATE) AS date, {sql_round(4, 'arg_max(value, (ts, event_id))')} AS raw_close FROM events GROUP BY ALL""",
)
def _(spark, sf):
    schema = fixtures.read(spark, sf, "events").schema
    folder = f"{shared_folder(spark)}/bars-{uuid.uuid4().hex}"
    stream = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf)
        .select(
            F.lit(0).cast("bigint").alias("market_id"),
            F.lit("SECURITY").alias("instrument_type"),
            F.concat(F.lit("U"), F.col("user_id")).alias("ticker"),
            F.lit("USD").alias("currency"),
            F.to_date("ts").alias("date"),
            F.col("value").alias("raw_close"),
            F.col("value").alias("adjusted_close"),
            "ts",
            "event_id",
        )
    )
    bars.merge_stream(stream, f"{folder}/rows", f"{folder}/progress", ("ts", "event_id")).awaitTermination()
    merged = bars.read_merged(spark, f"{folder}/rows")
    return merged.select("market_id", "instrument_type", "ticker", "currency", "date", *rounded(4, "raw_close"))
