"""Position ledgers of very large keys as a two-level scan of composable maps.

Where no row of a key is refused, a row's effect is a map that composes with others: the quantity
is shifted, the cost goes through c -> a c + b with a = 1 - sold / held for a sale and b = amount +
fee for a purchase.  Slices of a key are summed and composed side by side, a scan over the few
slices gives each its opening state, and all slices are then written side by side.  That no row is
refused is proved, not assumed: with the opening quantity known, every sale of a slice must leave a
quantity above -EPSILON.  Keys without that proof are handed back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliometry.runtime import stored
from foliometry.schema import EPSILON

SLICE = "fold_slice"


def affine_prefixes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the composition of all maps c -> a c + b up to it, by doubling."""
    a, b, step = a.copy(), b.copy(), 1
    while step < len(a):
        later_a, later_b = a[step:].copy(), b[step:].copy()
        b[step:] = later_a * b[:-step] + later_b
        a[step:] = later_a * a[:-step]
        step *= 2
    return a, b


def row_maps(quantity: np.ndarray, amount: np.ndarray, fee: np.ndarray, opening: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, held before, room): each row's cost map, and by how much the holding covers its sale."""
    held_after = opening + np.cumsum(quantity)
    held = np.concatenate([[opening], held_after[:-1]])
    buy, sold = quantity > 0, np.abs(quantity)
    share = np.divide(sold, held, out=np.zeros(len(held)), where=held > EPSILON)
    return np.where(buy, 1.0, 1.0 - share), np.where(buy, amount + fee, 0.0), held, np.where(buy, np.inf, held + EPSILON - sold)


def _columns(table: pa.Table) -> tuple[np.ndarray, ...]:
    return tuple(table.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("quantity", "amount", "fee"))


def scan_positions(sliced: DataFrame, keys: list[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """(ledger rows, keys that are handed back) of rows with slice numbers; slices of a key follow each other in time.

    A slice is the only thing that a task holds whole.
    """
    group = [*keys, SLICE]
    order = ["trade_date", "source_row_number"]
    sums = sliced.groupBy(*group).agg(
        F.sum("quantity").alias("change"), F.count("*").alias("n"), F.min("currency").alias("low"), F.max("currency").alias("high"), F.count_if(F.col("currency").isNull()).alias("blank")
    )
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    opening = sums.withColumns(
        {
            "opening": F.coalesce(F.sum("change").over(before), F.lit(0.0)),
            "rows_before": F.coalesce(F.sum("n").over(before), F.lit(0)),
            "mixed": (F.min("low").over(Window.partitionBy(*keys)) != F.max("high").over(Window.partitionBy(*keys))) | (F.sum("blank").over(Window.partitionBy(*keys)) > 0),
        }
    ).select(*group, "opening", "rows_before", "mixed")
    rows = stored(sliced.join(opening, group))

    def compose(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in order])
        a, b, _, room = row_maps(*_columns(table), table.column("opening")[0].as_py())
        whole_a, whole_b = affine_prefixes(a, b)
        fine = bool((room >= 0).all()) and not table.column("mixed")[0].as_py()
        named = {name: pa.array([k.as_py()], k.type) for name, k in zip(group, key)}
        return pa.table({**named, "a": [float(whole_a[-1])], "b": [float(whole_b[-1])], "fine": [fine]})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    ddl = ", ".join(f"{c} {kinds[c]}" for c in group)
    maps = stored(rows.groupBy(*group).applyInArrow(compose, f"{ddl}, a double, b double, fine boolean"))
    # a key has few slices: their maps are composed in order, one row per key
    listed = maps.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(SLICE, "a", "b"))).alias("maps"), F.bool_and("fine").alias("fine"))
    costs = F.aggregate(
        "maps",
        F.struct(F.lit(0.0).alias("cost"), F.array().cast(f"array<struct<{SLICE}:{kinds[SLICE]},opening_cost:double>>").alias("seen")),
        lambda s, m: F.struct((m["a"] * s["cost"] + m["b"]).alias("cost"), F.concat(s["seen"], F.array(F.struct(m[SLICE].alias(SLICE), s["cost"].alias("opening_cost")))).alias("seen")),
        lambda s: s["seen"],
    )
    opened = listed.where("fine").select(*keys, F.explode(costs).alias("slice")).select(*keys, "slice.*")

    def write(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in order])
        quantity, amount, fee = _columns(table)
        a, b, held, _ = row_maps(quantity, amount, fee, table.column("opening")[0].as_py())
        whole_a, whole_b = affine_prefixes(a, b)
        first = table.column("opening_cost")[0].as_py()
        cost = whole_a * first + whole_b
        before = np.concatenate([[first], cost[:-1]])
        buy = quantity > 0
        released = np.where(buy, 0.0, before * (1.0 - a))
        snap = lambda x: np.where(np.abs(x) < EPSILON, 0.0, x)
        out = {
            "quantity_after": snap(held + quantity),
            "cost_after": snap(cost),
            "realized_delta": np.where(buy, 0.0, amount - fee - released),
            "gross_buy": np.where(buy, amount, 0.0),
            "gross_sell": np.where(buy, 0.0, amount),
            "fee": fee,
            "issue_code": pa.nulls(len(buy), pa.string()),
            "step": table.column("rows_before")[0].as_py() + 1 + np.arange(len(buy)),
        }
        names = [part.split()[0] for part in schema.split(", ")]
        return pa.table({c: out[c] if c in out else table.column(c) for c in names})

    def in_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from write(pa.Table.from_batches(list(batches))).to_batches(max_chunksize=20_000)

    ledger = rows.join(opened, group).groupBy(*group).applyInArrow(in_batches, schema)
    return ledger, listed.where("not fine").select(*keys)
