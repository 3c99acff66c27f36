"""Ordered folds over keyed rows, for ledgers whose next step depends on an earlier rejection.

Rows are hash-partitioned by key, sorted inside the partition and streamed in blocks of whole
keys.  A fold that has a column form walks the keys of a block side by side in numpy; the few
longest keys of a block, and a key that fills a block alone, go row by row through the step
function, so a task holds one block and one key's running state, never a whole group.  A key with more than ``slice_rows`` rows is not given to one task: its rows are cut
into ordered slices of bounded size.  A fold with a scan does the slices side by side for keys whose
rows it proves to be accepted; for all others slice ``n`` runs as one job that starts from the state
slice ``n - 1`` wrote.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from foliometry.operators.lockstep import Block, key_starts
from foliometry.runtime import stored

SLICE_ROWS = 2_000_000
BLOCK_ROWS = 200_000
BATCH_ROWS = 20_000

STATE = "fold_state"
STEP = "step"  # 1, 2, ... within a key: the processing order of the emitting row


class Columns(Protocol):
    """A fold over the keys of a block side by side."""

    def advance(self, rows: np.ndarray, keys: np.ndarray) -> None:
        """One row of each of these keys."""

    def state(self, key: int) -> dict:
        """A key's state, as the step function has it."""

    def outputs(self) -> list[tuple[np.ndarray, dict[str, pa.Array]]]:
        """(rows, columns) per kind of output row; columns that are missing are those of the input row."""


@dataclass(frozen=True)
class Fold:
    """``step(state, row, emit)`` updates ``state`` (JSON-able) and emits output tuples.

    ``row`` holds the columns of ``inputs`` in order; the emitted tuple holds ``outputs`` in order,
    without the key columns before it and the ``step`` counter after it, which the runner adds.
    """

    keys: tuple[str, ...]
    order: tuple[str, str]  # (date, row number)
    inputs: tuple[str, ...]
    outputs: T.StructType
    initial: Callable[[], dict]
    step: Callable[[dict, tuple, Callable[[tuple], None]], None]
    columns: Callable | None = None  # the same fold as a Columns over a Block
    scan: Callable | None = None  # slices of large keys side by side: (rows, keys it cannot do)


def ordered_fold(df: DataFrame, fold: Fold, slice_rows: int = SLICE_ROWS) -> DataFrame:
    df = df.select(*fold.keys, *[c for c in fold.inputs if c not in fold.keys])
    sizes = df.groupBy(*fold.keys).count().where(F.col("count") > slice_rows)
    if sizes.isEmpty():
        return _run(df, fold, carried=False)
    return _fold_with_hot_keys(df, fold, sizes.select(*fold.keys), slice_rows)


def _fold_with_hot_keys(df: DataFrame, fold: Fold, hot: DataFrame, slice_rows: int) -> DataFrame:
    keys = list(fold.keys)
    parts = [_run(df.join(hot, keys, "left_anti"), fold, carried=False)]
    sliced = stored(_with_slices(df.join(hot, keys, "left_semi"), fold, slice_rows))
    if fold.scan is not None:
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in _schema(df, fold, carried=False))
        scanned, refused = fold.scan(sliced, keys, schema)
        parts.append(stored(scanned))
        sliced = stored(sliced.join(stored(refused), keys, "left_semi"))
    last = sliced.agg(F.max("fold_slice")).first()[0]

    state: DataFrame | None = None
    for n in range(0 if last is None else last + 1):
        rows = sliced.where(F.col("fold_slice") == n).drop("fold_slice").withColumn(
            STATE, F.lit(None).cast("string")
        )
        if state is not None:
            # a key whose rows ended in an earlier slice has no row here and needs no state
            live = state.join(rows.select(*keys).distinct(), keys, "left_semi")
            rows = rows.unionByName(live, allowMissingColumns=True)
        done = stored(_run(rows, fold, carried=True))
        parts.append(done.where(F.col(STATE).isNull()).drop(STATE))
        state = done.where(F.col(STATE).isNotNull()).select(*keys, STATE)
    return reduce(DataFrame.unionByName, parts)


def _with_slices(df: DataFrame, fold: Fold, slice_rows: int) -> DataFrame:
    """Number the slices of each key from counts per (date, row-number block), not from the rows."""
    keys = list(fold.keys)
    date, row = fold.order
    block = F.floor(F.col(row) / slice_rows)
    counts = df.groupBy(*keys, date, block.alias("fold_block")).count()
    before = Window.partitionBy(*keys).orderBy(date, "fold_block").rowsBetween(Window.unboundedPreceding, -1)
    slices = counts.select(
        *keys,
        date,
        "fold_block",
        F.floor(F.coalesce(F.sum("count").over(before), F.lit(0)) / slice_rows).cast("int").alias("fold_slice"),
    )
    return (
        df.withColumn("fold_block", block)
        .join(slices, [*keys, date, "fold_block"])
        .drop("fold_block")
    )


def _schema(df: DataFrame, fold: Fold, carried: bool) -> T.StructType:
    key_fields = [df.schema[k] for k in fold.keys]
    state = [T.StructField(STATE, T.StringType())] if carried else []
    return T.StructType(key_fields + list(fold.outputs.fields) + [T.StructField(STEP, T.LongType()), *state])


def _run(df: DataFrame, fold: Fold, carried: bool) -> DataFrame:
    schema = _schema(df, fold, carried)
    sort = [*fold.keys]
    if carried:
        sort.append(F.col(STATE).desc_nulls_last())  # the carried state precedes the key's rows
    columns = [*fold.keys, *fold.inputs] + ([STATE] if carried else [])
    ordered = df.repartition(*fold.keys).sortWithinPartitions(*sort, *fold.order)
    named = ordered.select(*[F.col(c).alias(f"f{i}") for i, c in enumerate(columns)])
    stream = _stream(fold, schema, carried) if carried or fold.columns is None else _blocks(fold, schema)
    return named.mapInArrow(stream, schema)


def _blocks(fold: Fold, schema: T.StructType):
    """Stream blocks of whole keys; a key longer than a block is streamed row by row from its first row on."""
    keys = [f"f{i}" for i in range(len(fold.keys))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        scalar = _stream(fold, schema, carried=False)
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < BLOCK_ROWS:
                continue
            block = pa.concat_batches(held)
            cut = int(key_starts([block.column(k) for k in keys])[-1])
            if cut:
                yield from _fold_block(fold, schema, block.slice(0, cut))
                held = [block.slice(cut)]
                continue
            follow = _Following(block, batches, keys)
            yield from scalar(follow.same_key())
            held = follow.rest
        if held:
            yield from _fold_block(fold, schema, pa.concat_batches(held))

    return run


class _Following:
    """The batches of the key that a block begins with, and what comes after it."""

    def __init__(self, block: pa.RecordBatch, batches: Iterator[pa.RecordBatch], keys: list[str]):
        self.block, self.batches, self.keys = block, batches, keys
        self.rest: list[pa.RecordBatch] = []

    def same_key(self) -> Iterator[pa.RecordBatch]:
        yield self.block
        last = self.block.slice(self.block.num_rows - 1)
        for batch in self.batches:
            starts = key_starts([pa.concat_arrays([last.column(k), batch.column(k)]) for k in self.keys])
            same = int(starts[1]) - 1 if len(starts) > 1 else batch.num_rows
            if same:
                yield batch.slice(0, same)
            if same < batch.num_rows:
                self.rest = [batch.slice(same)]
                return


def _fold_block(fold: Fold, schema: T.StructType, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Walk the keys side by side, finish the longest ones row by row, and put the output rows in the order of the input."""
    names = [*fold.keys, *fold.inputs]
    place = {name: i for i, name in reversed(list(enumerate(names)))}
    target = to_arrow_schema(schema)
    block = Block(pa.RecordBatch.from_arrays(batch.columns, names=[f"f{i}" for i in range(len(names))]), [f"f{i}" for i in range(len(fold.keys))])
    walker = fold.columns(block, {name: f"f{i}" for name, i in place.items()})
    walked = np.zeros(block.rows, bool)
    for rows, keys in block.walk():
        walker.advance(rows, keys)
        walked[rows] = True

    parts, order = [], []
    for kind, (rows, columns) in enumerate(walker.outputs()):
        done = walked[rows]
        rows = rows[done]
        taken, kept = batch.take(pa.array(rows)), pa.array(done)
        arrays = []
        for field in target:
            if field.name == STEP:
                arrays.append(pa.array(block.step[rows], pa.int64()))
            elif field.name in columns:
                arrays.append(columns[field.name].filter(kept).cast(field.type))
            else:
                arrays.append(taken.column(place[field.name]).cast(field.type))
        parts.append(pa.RecordBatch.from_arrays(arrays, schema=target))
        order.append(rows * 4 + kind)

    out: list[tuple] = []
    at: list[int] = []
    for key, t in block.left:
        state, start = walker.state(key), int(block.starts[key])
        rows = batch.slice(start + t, int(block.lengths[key]) - t)
        for n, row in enumerate(zip(*(c.to_pylist() for c in rows.columns))):
            index, before = start + t + n, len(out)

            def emit(values: tuple, row=row, step=t + n + 1) -> None:
                out.append((*row[: len(fold.keys)], *values, step))

            fold.step(state, row[len(fold.keys) :], emit)
            at.extend(index * 4 + j for j in range(len(out) - before))
    if out:
        parts.append(pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), target)], schema=target))
        order.append(np.array(at))
    table = pa.Table.from_batches(parts, schema=target)
    yield from table.take(pa.array(np.argsort(np.concatenate(order), kind="stable"))).combine_chunks().to_batches(max_chunksize=BATCH_ROWS)


def _stream(fold: Fold, schema: T.StructType, carried: bool):
    width = len(fold.keys)
    inputs = len(fold.inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow_schema = to_arrow_schema(schema)
        tail = (None,) if carried else ()
        blank = (None,) * (len(fold.outputs.fields) + 1)
        key, state, step = None, None, 0
        out: list[tuple] = []

        def emit(values: tuple) -> None:
            out.append((*key, *values, step, *tail))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [()] * len(arrow_schema)
            arrays = [pa.array(c, type=f.type) for c, f in zip(columns, arrow_schema)]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, schema=arrow_schema)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:width] != key:
                    if carried and key is not None:
                        out.append((*key, *blank, json.dumps([step, state])))
                    key, state, step = row[:width], fold.initial(), 0
                    if carried and row[-1] is not None:
                        step, state = json.loads(row[-1])
                        continue
                step += 1
                fold.step(state, row[width : width + inputs], emit)
            if out:
                yield flush()
        if carried and key is not None:
            out.append((*key, *blank, json.dumps([step, state])))
        if out:
            yield flush()

    return run
