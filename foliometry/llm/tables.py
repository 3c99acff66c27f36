"""Helpers shared by the operators: reading tables, Arrow passes over whole partitions, tables in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from foliometry.runtime import shared_folder, stored

__all__ = ["arrow_pass", "free_names", "new_folder", "read", "stored"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores as it takes that no column of df has one of them."""
    taken, tail = {c.lower() for c in df.columns}, ""
    while any((name + tail).lower() in taken for name in names):
        tail += "_"
    return [name + tail for name in names]


def arrow_pass(df: DataFrame, step: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """Apply `step` to each Arrow batch; it yields columns by name, which are cast to the schema."""
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in step(batch):
                arrays = [columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], type=f.type) for f in target]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, target, strict=True)], schema=target)

    return df.mapInArrow(run, schema)
