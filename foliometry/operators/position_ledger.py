"""Moving-average security positions: one row per SECURITY transaction with the state after it."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliometry.operators.fold import SLICE_ROWS, Fold, ordered_fold
from foliometry.operators.lockstep import Block, doubles, named, snap
from foliometry.operators.scan import scan_positions
from foliometry.schema import EPSILON, SECURITY, clean, gross_native

MISMATCH = "CURRENCY_MISMATCH"
OVERSELL = "OVERSELL"

_OUTPUT = T.StructType(
    [
        T.StructField("currency", T.StringType()),
        T.StructField("trade_date", T.DateType()),
        T.StructField("source_row_number", T.LongType()),
        T.StructField("quantity_after", T.DoubleType()),
        T.StructField("cost_after", T.DoubleType()),
        T.StructField("realized_delta", T.DoubleType()),
        T.StructField("gross_buy", T.DoubleType()),
        T.StructField("gross_sell", T.DoubleType()),
        T.StructField("fee", T.DoubleType()),
        T.StructField("issue_code", T.StringType()),
    ]
)


def _snap(x: float) -> float:
    return 0.0 if abs(x) < EPSILON else x


def _step(s: dict, row: tuple, emit) -> None:
    currency, date, number, quantity, amount, fee = row
    if s["currency"] is None:
        s["currency"] = currency
    if currency != s["currency"]:
        emit((currency, date, number, None, None, 0.0, 0.0, 0.0, 0.0, MISMATCH))
        return
    held, cost = s["quantity"], s["cost"]
    if quantity > 0:
        s["quantity"], s["cost"] = held + quantity, cost + amount + fee
        emit((currency, date, number, s["quantity"], s["cost"], 0.0, amount, 0.0, fee, None))
        return
    sold = abs(quantity)
    if sold > held + EPSILON:
        emit((currency, date, number, held, cost, 0.0, 0.0, 0.0, 0.0, OVERSELL))
        return
    released = (cost / held if held > EPSILON else 0.0) * sold
    s["quantity"], s["cost"] = _snap(held - sold), _snap(cost - released)
    emit((currency, date, number, s["quantity"], s["cost"], amount - fee - released, 0.0, amount, fee, None))


class PositionColumns:
    """The same steps for many tickers side by side."""

    def __init__(self, block: Block, name: dict[str, str]):
        self.block = block
        self.currency, self.currencies = block.codes(name["currency"])
        self.quantity, self.amount, self.fee = (block.numbers(name[c]) for c in ("quantity", "amount", "fee"))
        self.own = self.currency[block.starts]
        self.held, self.cost = np.zeros((2, len(block.starts)))
        self.quantity_after, self.cost_after, self.realized, self.buy, self.sell, self.paid = np.zeros((6, block.rows))
        self.issue = np.zeros(block.rows, np.int32)

    def advance(self, rows: np.ndarray, keys: np.ndarray) -> None:
        q, amount, fee, held, cost = self.quantity[rows], self.amount[rows], self.fee[rows], self.held[keys], self.cost[keys]
        match = self.currency[rows] == self.own[keys]
        buy, sold = match & (q > 0), np.abs(q)
        over = match & ~buy & (sold > held + EPSILON)
        sell = match & ~buy & ~over
        released = np.divide(cost, held, out=np.zeros(len(rows)), where=held > EPSILON) * sold
        self.held[keys] = np.where(buy, held + q, np.where(sell, snap(held - sold), held))
        self.cost[keys] = np.where(buy, cost + amount + fee, np.where(sell, snap(cost - released), cost))
        self.quantity_after[rows], self.cost_after[rows] = self.held[keys], self.cost[keys]
        self.realized[rows] = np.where(sell, amount - fee - released, 0.0)
        self.buy[rows], self.sell[rows], self.paid[rows] = np.where(buy, amount, 0.0), np.where(sell, amount, 0.0), np.where(buy | sell, fee, 0.0)
        self.issue[rows] = np.where(over, 2, np.where(match, 0, 1))

    def state(self, key: int) -> dict:
        own = int(self.own[key])
        return {"currency": self.currencies[own] if own >= 0 else None, "quantity": float(self.held[key]), "cost": float(self.cost[key])}

    def outputs(self) -> list[tuple[np.ndarray, dict[str, pa.Array]]]:
        gated = self.issue != 1
        columns = {
            "quantity_after": doubles(self.quantity_after, gated),
            "cost_after": doubles(self.cost_after, gated),
            "realized_delta": doubles(self.realized),
            "gross_buy": doubles(self.buy),
            "gross_sell": doubles(self.sell),
            "fee": doubles(self.paid),
            "issue_code": named(self.issue, (MISMATCH, OVERSELL)),
        }
        return [(np.arange(self.block.rows), columns)]


POSITION_FOLD = Fold(
    keys=("account_id", "ticker"),
    order=("trade_date", "source_row_number"),
    inputs=("currency", "trade_date", "source_row_number", "quantity", "amount", "fee"),
    outputs=_OUTPUT,
    initial=lambda: {"currency": None, "quantity": 0.0, "cost": 0.0},
    step=_step,
    columns=PositionColumns,
)


def position_ledger(tx: DataFrame, slice_rows: int = SLICE_ROWS, side_by_side: bool = False) -> DataFrame:
    """The first SECURITY row of a ticker fixes its currency; rows in another one are blocked.

    With ``side_by_side``, slices of a key of more than ``slice_rows`` rows are scanned in parallel where no row of
    the key is refused; costs then equal the fold's up to rounding in the last places.
    """
    rows = tx.where(F.col("transaction_type") == SECURITY).withColumn("amount", gross_native())
    fold = replace(POSITION_FOLD, scan=scan_positions) if side_by_side else POSITION_FOLD
    return ordered_fold(rows, fold, slice_rows)


def positions(ledger: DataFrame) -> DataFrame:
    """Terminal position per (account, ticker, currency); exists once any gated-in row was seen."""
    accepted = F.col("issue_code").isNull()
    return (
        ledger.where(F.col("issue_code").isNull() | (F.col("issue_code") != MISMATCH))
        .groupBy("account_id", "ticker", "currency")
        .agg(
            F.max_by("quantity_after", "step").alias("quantity"),
            F.max_by("cost_after", "step").alias("cost_basis"),
            F.sum("realized_delta").alias("realized_pnl"),
            F.sum("gross_buy").alias("gross_buys"),
            F.sum("gross_sell").alias("gross_sells"),
            F.sum("fee").alias("fees"),
            F.count_if(accepted).alias("trade_count"),
        )
        .withColumn("quantity", clean("quantity"))
        .withColumn("cost_basis", clean("cost_basis"))
        .withColumn(
            "average_unit_cost",
            F.when(F.col("quantity") > EPSILON, F.col("cost_basis") / F.col("quantity")).otherwise(0.0),
        )
    )


def currency_totals(ledger: DataFrame) -> DataFrame:
    """Security totals per currency; a currency seen only through oversells appears with zeros."""
    sums = ledger.where(F.col("issue_code").isNull() | (F.col("issue_code") != MISMATCH)).groupBy(
        "account_id", "currency"
    )
    return sums.agg(
        F.sum("gross_buy").alias("gross_buys"),
        F.sum("gross_sell").alias("gross_sells"),
        F.sum("fee").alias("fees"),
        clean(F.sum(F.col("gross_sell") - F.col("gross_buy") - F.col("fee"))).alias("net_security_cash_flow"),
        clean(F.sum("realized_delta")).alias("realized_pnl"),
    )


def row_counts(tx: DataFrame) -> DataFrame:
    return tx.groupBy("account_id").agg(
        F.count_if(F.col("transaction_type") == SECURITY).alias("security_transaction_count"),
        F.count_if(F.col("transaction_type") != SECURITY).alias("deferred_transaction_count"),
    )
