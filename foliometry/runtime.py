"""Lineage cuts and size checks used by jobs that need more than one pass."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which all executors share.

    Only a local session, whose driver is its one executor, gets a folder of its own where the setting is missing; a cluster gets an error.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="foliometry-"))
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """Write a table that later steps read to the shared folder and return the scan of it.

    Later plans start from a columnar scan with statistics and column pruning instead of replaying
    the ledger, and a lost executor costs a re-read instead of a re-run.  Unlike a checkpoint, the
    plan runs once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def plain_unions(spark: SparkSession) -> None:
    """Unions of this session promise no partitioning.

    Spark 4.1 lets a union pass for as many partitions as each of its parts; where the parts' numbers change while
    the query runs, a join above it fails with "Can't zip RDDs with unequal numbers of partitions".
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
