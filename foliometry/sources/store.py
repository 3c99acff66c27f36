"""Versioned tables in a folder: append a version, read the active one.

Rows are partitioned by publishing batch and by a hash shard of the account, not by account:
millions of accounts would make millions of folders.  A manifest row per (account, revision)
says which version is readable; older versions stay in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliometry.operators.versions import active_versions

P = "account_id"
SHARDS = 64


def sharded(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Rows with the hash shard of their account."""
    return rows.withColumn("shard", F.pmod(F.hash(P), F.lit(shards)))


def publish_version(
    rows: DataFrame, folder: str, revision: int, status: str = "ACTIVE", shards: int = SHARDS, batch: str = "all", placed: bool = False
) -> None:
    """Write ``rows`` as the given revision of every account in them, then its manifest.

    A (revision, batch) has folders of its own, which a repeated publication overwrites: it leaves the
    same rows, not twice as many. Accounts that are published apart name batches of their own.
    Rows that are ``placed`` lie by ``shard`` (as in ``sharded``) and day already and are not moved.  The manifest is counted from what was written.
    """
    path = f"{folder}/rows/revision={revision}/batch={batch}"
    # rows of one shard may be many: spread them by account and day, and let tasks write several files
    versioned = rows if placed else sharded(rows, shards).repartition("shard", "trade_date")
    versioned.write.option("compression", "zstd").partitionBy("shard").mode("overwrite").parquet(path)
    written = rows.sparkSession.read.schema(rows.drop("shard").schema).parquet(path)
    manifest = written.groupBy(P).agg(
        F.count("*").alias("row_count"), F.min("trade_date").alias("earliest_date"), F.max("trade_date").alias("latest_date")
    )
    manifest = manifest.select(
        P,
        F.lit(revision).alias("revision"),
        F.concat_ws("-", F.lit("dataset"), F.col(P).cast("string"), F.lit(str(revision))).alias("dataset_id"),
        F.lit(status).alias("status"),
        "row_count",
        "earliest_date",
        "latest_date",
    )
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest/published={revision}-{batch}")


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/manifest").drop("published")


def read_dataset(spark: SparkSession, folder: str, revision: int, account_id: int | None = None, shards: int = SHARDS) -> DataFrame:
    """Rows of one revision; one account reads a single shard folder."""
    rows = spark.read.parquet(f"{folder}/rows").where(F.col("revision") == revision)
    if account_id is not None:
        shard = F.pmod(F.hash(F.lit(account_id).cast("bigint")), F.lit(shards))
        rows = rows.where((F.col("shard") == shard) & (F.col(P) == account_id))
    return rows.drop("shard", "batch")


def read_active(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each account's highest published revision."""
    rows = spark.read.parquet(f"{folder}/rows").drop("shard", "batch")
    active = active_versions(read_manifest(spark, folder)).select(P, "revision", "dataset_id")
    return rows.join(active, [P, "revision"])


def read_active_marks(marks: DataFrame, state: DataFrame) -> DataFrame:
    """Marks of the snapshots that accounts currently point at, once per snapshot."""
    return marks.join(state.select("snapshot_id").distinct(), "snapshot_id", "left_semi")
