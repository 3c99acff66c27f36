"""Internal rate of return with proof of uniqueness, for every key at once.

Net present value is evaluated on a fixed grid of log rates.  A sign change between neighbours is
bisected; a grid value within tolerance is a root as well.  The rate is reported only when exactly
one distinct root exists.  Flows are netted per day beforehand, so a key holds at most one flow per
calendar day.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: grid and bisection limits
LOWEST_LOG_RATE = float(np.log(1e-6))
HIGHEST_LOG_RATE = float(np.log(1_000_001))
GRID_STEPS = 1_600
BISECTIONS = 160
BLOCK = 100_000  # grid cells x flows evaluated at once


def npv(log_rates: np.ndarray, years: np.ndarray, amounts: np.ndarray) -> np.ndarray:
    step = max(1, BLOCK // len(years))
    parts = [
        np.exp(np.multiply.outer(-log_rates[i : i + step], years)) @ amounts for i in range(0, len(log_rates), step)
    ]
    return np.concatenate(parts)


def distinct_roots(days: np.ndarray, amounts: np.ndarray) -> list[float]:
    if len(amounts) < 2:
        return []
    years = (days - days[0]) / 365.0
    tolerance = max(1e-8, float(np.abs(amounts).sum()) * 1e-11)
    grid = LOWEST_LOG_RATE + (HIGHEST_LOG_RATE - LOWEST_LOG_RATE) * np.arange(GRID_STEPS + 1) / GRID_STEPS
    with np.errstate(over="ignore", invalid="ignore"):
        value = npv(grid, years, amounts)
    found = list(grid[np.abs(value) <= tolerance])
    finite = np.isfinite(value)
    change = finite[:-1] & finite[1:] & (np.sign(value[:-1]) * np.sign(value[1:]) < 0)
    for cell in np.flatnonzero(change):
        found.append(_bisect(grid[cell], grid[cell + 1], value[cell], years, amounts, tolerance))
    roots: list[float] = []
    for rate in sorted(float(np.expm1(x)) for x in found):
        if rate > -1 and np.isfinite(rate) and all(abs(r - rate) > 1e-7 * max(1.0, abs(rate)) for r in roots):
            roots.append(rate)
    return roots


def _bisect(left: float, right: float, left_value: float, years, amounts, tolerance: float) -> float:
    for _ in range(BISECTIONS):
        middle = (left + right) / 2
        value = float(np.exp(-middle * years) @ amounts)
        if abs(value) <= tolerance or abs(right - left) <= 1e-13:
            return middle
        if (left_value < 0) != (value < 0):
            right = middle
        else:
            left, left_value = middle, value
    return (left + right) / 2


def xirr(net: DataFrame, key: str = "account_id") -> DataFrame:
    """``net`` has (key, date, amount), one row per day; returns (key, root_count, xirr)."""
    kind = net.schema[key].dataType.simpleString()
    flows = net.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(F.unix_date("date").alias("day"), F.col("amount")))).alias("flows")
    )

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            bounds = lists.offsets.to_numpy()
            days = lists.values.field("day").to_numpy(zero_copy_only=False).astype(float)
            amounts = lists.values.field("amount").to_numpy(zero_copy_only=False)
            counts, rates = [], []
            for start, end in zip(bounds[:-1], bounds[1:]):
                roots = distinct_roots(days[start:end], amounts[start:end])
                counts.append(len(roots))
                rates.append(roots[0] if len(roots) == 1 else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int32()), pa.array(rates, pa.float64())],
                names=[key, "root_count", "xirr"],
            )

    return flows.mapInArrow(solve, f"{key} {kind}, root_count int, xirr double")
