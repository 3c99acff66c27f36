"""Foreign-currency cost pools and the TWD cost basis of securities bought out of them.

Pools never cross currencies, so foreign rows fold per (account, currency).  TWD securities use
no pool and fold per (account, ticker); ``fold_ticker`` is blank for foreign rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliometry.operators.fold import SLICE_ROWS, Fold, ordered_fold
from foliometry.operators.lockstep import Block, doubles, named, snap
from foliometry.schema import BASE_CURRENCY, EPSILON, SECURITY, clean, gross_native

POOL_AMOUNTS = (
    "explicit_fx_units_in",
    "external_cash_units_in",
    "automatic_units_in",
    "units_assigned_to_securities",
    "units_sold_to_twd",
    "units_withdrawn",
    "foreign_fee_units",
    "foreign_fee_twd_cost",
    "twd_fees",
    "realized_fx_delta",
)

_OUTPUT = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("trade_date", T.DateType()),
        T.StructField("source_row_number", T.LongType()),
        T.StructField("units_after", T.DoubleType()),  # null where the row left the pool untouched
        T.StructField("pool_cost_after", T.DoubleType()),
        *[T.StructField(name, T.DoubleType()) for name in POOL_AMOUNTS],
        T.StructField("quantity_after", T.DoubleType()),
        T.StructField("native_cost_after", T.DoubleType()),
        T.StructField("twd_cost_after", T.DoubleType()),
        T.StructField("realized_twd_delta", T.DoubleType()),
        T.StructField("issue_code", T.StringType()),
        T.StructField("required", T.DoubleType()),
        T.StructField("available", T.DoubleType()),
    ]
)

_SLOT = {name: i for i, name in enumerate(POOL_AMOUNTS)}


def _snap(x: float) -> float:
    return 0.0 if abs(x) < EPSILON else x


def _add(s: dict, units: float, cost: float) -> None:
    s["units"], s["cost"] = _snap(s["units"] + units), _snap(s["cost"] + cost)


def _release(s: dict, units: float) -> float | None:
    if s["units"] + EPSILON < units:
        return None
    released = (s["cost"] / s["units"] if s["units"] > EPSILON else 0.0) * units
    _add(s, -units, -released)
    if s["units"] == 0:
        s["cost"] = 0.0
    return released


def _step(s: dict, row: tuple, emit) -> None:
    currency, kind, ticker, date, number, quantity, amount, rate, fee = row
    slots = [0.0] * len(POOL_AMOUNTS)
    pooled = False  # does the source pool exist because of this row
    problem = (None, None, None)
    realized = 0.0
    foreign = currency != BASE_CURRENCY
    rated = rate is not None and rate > 0
    holding = None

    def note(**amounts: float) -> None:
        for name, value in amounts.items():
            slots[_SLOT[name]] += value

    if kind == "FX_BUY" or kind == "FX_SELL":
        if not foreign:
            problem = ("INVALID_FX_CURRENCY", None, None)
        elif not rated:
            problem = ("MISSING_FX_RATE", None, None)
        elif kind == "FX_BUY":
            pooled = True
            _add(s, amount, amount * rate + fee)
            note(explicit_fx_units_in=amount, twd_fees=fee)
        elif amount * rate - fee < -EPSILON:
            problem = ("NEGATIVE_NET_FX_PROCEEDS", None, None)
        else:
            pooled = True
            released = _release(s, amount)
            if released is None:
                problem = ("INSUFFICIENT_FOREIGN_POOL", amount, s["units"])
            else:
                note(units_sold_to_twd=amount, twd_fees=fee, realized_fx_delta=amount * rate - fee - released)
    elif kind == "CASH_IN":
        net = amount - fee
        if not rated:
            problem = ("MISSING_FX_RATE", None, None)
        elif net < -EPSILON:
            problem = ("NEGATIVE_NET_CASH_IN", None, None)
        else:
            pooled = True
            _add(s, net, net * rate)
            note(external_cash_units_in=net, foreign_fee_units=fee, foreign_fee_twd_cost=fee * rate)
    elif kind == "CASH_OUT":
        pooled = True
        average = s["cost"] / s["units"] if s["units"] > EPSILON else 0.0
        if _release(s, amount + fee) is None:
            problem = ("INSUFFICIENT_FOREIGN_POOL", amount + fee, s["units"])
        else:
            note(units_withdrawn=amount, foreign_fee_units=fee, foreign_fee_twd_cost=fee * average)
    else:
        holding = s["held"].setdefault(ticker, [0.0, 0.0, 0.0])
        if quantity > 0:
            native = amount + fee
            twd = native
            if foreign:
                pooled = True
                if s["units"] + EPSILON < native:
                    gap = native - s["units"]
                    if rated:
                        _add(s, gap, gap * rate)
                        note(automatic_units_in=gap)
                    else:
                        problem = ("MISSING_FX_RATE_FOR_AUTO_FUND", gap, s["units"])
                if problem[0] is None:
                    twd = _release(s, native)
                    if twd is None:
                        problem = ("INSUFFICIENT_FOREIGN_POOL", native, s["units"])
                    else:
                        note(units_assigned_to_securities=native)
            if problem[0] is None:
                holding[0] += quantity
                holding[1] += native
                holding[2] += twd
        else:
            sold, net = abs(quantity), amount - fee
            if sold > holding[0] + EPSILON:
                problem = ("OVERSELL", sold, holding[0])
            elif net < -EPSILON:
                problem = ("NEGATIVE_NET_SECURITY_PROCEEDS", None, None)
            elif foreign and net > EPSILON and not rated:
                problem = ("MISSING_SECURITY_SALE_FX", None, None)
            else:
                open_ = holding[0] > EPSILON
                out_native = (holding[1] / holding[0] if open_ else 0.0) * sold
                out_twd = (holding[2] / holding[0] if open_ else 0.0) * sold
                proceeds = net * (rate or 0.0) if foreign else net
                holding[:] = [_snap(holding[0] - sold), _snap(holding[1] - out_native), _snap(holding[2] - out_twd)]
                realized = proceeds - out_twd
                if holding[0] == 0:
                    holding[1] = holding[2] = 0.0
                if foreign and net > EPSILON:
                    pooled = True
                    _add(s, net, proceeds)

    pool = (s["units"], s["cost"]) if pooled else (None, None)
    state = tuple(holding) if holding is not None else (None, None, None)
    emit((ticker, date, number, *pool, *slots, *state, realized, *problem))


ISSUES = (
    "INVALID_FX_CURRENCY",
    "MISSING_FX_RATE",
    "NEGATIVE_NET_FX_PROCEEDS",
    "INSUFFICIENT_FOREIGN_POOL",
    "NEGATIVE_NET_CASH_IN",
    "MISSING_FX_RATE_FOR_AUTO_FUND",
    "OVERSELL",
    "NEGATIVE_NET_SECURITY_PROCEEDS",
    "MISSING_SECURITY_SALE_FX",
)
_ISSUE = {name: i for i, name in enumerate(ISSUES, 1)}


class FxColumns:
    """The same steps for many pools side by side; a holding is a number of (pool, ticker)."""

    def __init__(self, block: Block, name: dict[str, str]):
        self.block = block
        kind, kinds = block.codes(name["transaction_type"])
        self.kind = {k: kind == i for i, k in enumerate(kinds)}
        currency, currencies = block.codes(name["currency"])
        self.foreign = currency != (currencies.index(BASE_CURRENCY) if BASE_CURRENCY in currencies else len(currencies))
        self.ticker, self.tickers = block.codes(name["ticker"])
        self.holding, first = block.slots(self.ticker)
        self.quantity, self.amount, self.rate, self.fee = (block.numbers(name[c]) for c in ("quantity", "amount", "fx_rate", "fee"))
        self.units, self.cost = np.zeros((2, len(block.starts)))
        self.held = np.zeros((3, len(first)))  # quantity, native cost, TWD cost
        self.noted = np.zeros((len(POOL_AMOUNTS), block.rows))
        self.pool_after, self.state_after = np.zeros((2, block.rows)), np.zeros((3, block.rows))
        self.realized, self.required, self.available = np.zeros((3, block.rows))
        self.issue, self.pooled = np.zeros(block.rows, np.int32), np.zeros(block.rows, bool)

    def _is(self, kind: str, rows: np.ndarray) -> np.ndarray:
        return self.kind[kind][rows] if kind in self.kind else np.zeros(len(rows), bool)

    def advance(self, rows: np.ndarray, keys: np.ndarray) -> None:
        amount, fee, rate, quantity = self.amount[rows], self.fee[rows], self.rate[rows], self.quantity[rows]
        foreign, units, cost = self.foreign[rows], self.units[keys], self.cost[keys]
        holding = self.holding[rows]
        shares, native_cost, twd_cost = self.held[:, holding]
        rated = rate > 0
        issue, required, available = np.zeros(len(rows), np.int32), np.full(len(rows), np.nan), np.full(len(rows), np.nan)

        def block(where: np.ndarray, code: str, needed=None, there=None) -> np.ndarray:
            issue[where] = _ISSUE[code]
            if needed is not None:
                required[where], available[where] = needed[where], there[where]
            return where

        def note(slot: str, where: np.ndarray, value: np.ndarray) -> None:
            self.noted[_SLOT[slot], rows[where]] = value[where]

        def average(total: np.ndarray, parts: np.ndarray) -> np.ndarray:
            return np.divide(total, parts, out=np.zeros(len(rows)), where=parts > EPSILON)

        fx_buy, fx_sell, cash_in, cash_out = (self._is(k, rows) for k in ("FX_BUY", "FX_SELL", "CASH_IN", "CASH_OUT"))
        trade = self._is(SECURITY, rows)
        buy, sell = trade & (quantity > 0), trade & ~(quantity > 0)
        spent, net, gross, sold = amount + fee, amount - fee, amount * rate, np.abs(quantity)

        exchange = fx_buy | fx_sell
        refused = block(exchange & ~foreign, "INVALID_FX_CURRENCY") | block(((exchange & foreign) | cash_in) & ~rated, "MISSING_FX_RATE")
        fx_buy, fx_sell, cash_in = fx_buy & ~refused, fx_sell & ~refused, cash_in & ~refused
        fx_sell &= ~block(fx_sell & (gross - fee < -EPSILON), "NEGATIVE_NET_FX_PROCEEDS")
        cash_in &= ~block(cash_in & (net < -EPSILON), "NEGATIVE_NET_CASH_IN")
        pooled = fx_buy | fx_sell | cash_in | cash_out | (buy & foreign)

        # a purchase first adds what the pool lacks
        gap = spent - units
        short = buy & foreign & (units + EPSILON < spent)
        unrated = block(short & ~rated, "MISSING_FX_RATE_FOR_AUTO_FUND", gap, units)
        added = short & ~unrated
        buy &= ~unrated
        units, cost = np.where(added, snap(units + gap), units), np.where(added, snap(cost + gap * rate), cost)

        # what leaves the pool takes its average cost along
        wanted = np.where(fx_sell, amount, spent)
        leaving = fx_sell | cash_out | (buy & foreign)
        empty = block(leaving & (units + EPSILON < wanted), "INSUFFICIENT_FOREIGN_POOL", wanted, units)
        fx_sell, cash_out, buy, leaving = fx_sell & ~empty, cash_out & ~empty, buy & ~empty, leaving & ~empty
        each = average(cost, units)
        released = each * wanted
        units, cost = np.where(leaving, snap(units - wanted), units), np.where(leaving, snap(cost - released), cost)
        cost = np.where(leaving & (units == 0), 0.0, cost)

        # a sale needs the shares and, for its proceeds, a rate
        sell &= ~block(sell & (sold > shares + EPSILON), "OVERSELL", sold, shares)
        sell &= ~block(sell & (net < -EPSILON), "NEGATIVE_NET_SECURITY_PROCEEDS")
        sell &= ~block(sell & foreign & (net > EPSILON) & ~rated, "MISSING_SECURITY_SALE_FX")
        proceeds = np.where(foreign, net * np.nan_to_num(rate, nan=0.0), net)
        out_twd = average(twd_cost, shares) * sold
        left = snap(shares - sold)
        after_sale = [left, np.where(left == 0, 0.0, snap(native_cost - average(native_cost, shares) * sold)), np.where(left == 0, 0.0, snap(twd_cost - out_twd))]
        after_buy = [shares + quantity, native_cost + spent, twd_cost + np.where(foreign, released, spent)]
        self.held[:, holding] = [np.where(buy, b, np.where(sell, a, now)) for b, a, now in zip(after_buy, after_sale, (shares, native_cost, twd_cost))]
        paid_in = sell & foreign & (net > EPSILON)
        pooled |= paid_in

        gained = np.where(fx_buy, amount, net)
        value = np.where(fx_buy, gross + fee, np.where(cash_in, net * rate, proceeds))
        adding = fx_buy | cash_in | paid_in
        self.units[keys], self.cost[keys] = np.where(adding, snap(units + gained), units), np.where(adding, snap(cost + value), cost)

        note("explicit_fx_units_in", fx_buy, amount)
        note("external_cash_units_in", cash_in, net)
        note("automatic_units_in", added, gap)
        note("units_assigned_to_securities", buy & foreign, spent)
        note("units_sold_to_twd", fx_sell, amount)
        note("units_withdrawn", cash_out, amount)
        note("foreign_fee_units", cash_in | cash_out, fee)
        note("foreign_fee_twd_cost", cash_in | cash_out, np.where(cash_in, fee * rate, fee * each))
        note("twd_fees", fx_buy | fx_sell, fee)
        note("realized_fx_delta", fx_sell, gross - fee - released)
        self.realized[rows] = np.where(sell, proceeds - out_twd, 0.0)
        self.pooled[rows] = pooled
        self.pool_after[:, rows] = self.units[keys], self.cost[keys]
        self.state_after[:, rows] = self.held[:, holding]
        self.issue[rows], self.required[rows], self.available[rows] = issue, required, available

    def state(self, key: int) -> dict:
        start, end = self.block.starts[key], self.block.starts[key] + self.block.lengths[key]
        held = {self.tickers[t]: self.held[:, h].tolist() for t, h in zip(self.ticker[start:end].tolist(), self.holding[start:end].tolist()) if t >= 0}
        return {"units": float(self.units[key]), "cost": float(self.cost[key]), "held": held}

    def outputs(self) -> list[tuple[np.ndarray, dict[str, pa.Array]]]:
        trade = self.kind.get(SECURITY, np.zeros(self.block.rows, bool))
        columns = {name: doubles(self.noted[i]) for name, i in _SLOT.items()}
        columns |= {name: doubles(values, self.pooled) for name, values in zip(("units_after", "pool_cost_after"), self.pool_after)}
        columns |= {name: doubles(values, trade) for name, values in zip(("quantity_after", "native_cost_after", "twd_cost_after"), self.state_after)}
        columns |= {"realized_twd_delta": doubles(self.realized), "issue_code": named(self.issue, ISSUES)}
        columns |= {name: doubles(values, ~np.isnan(values)) for name, values in (("required", self.required), ("available", self.available))}
        return [(np.arange(self.block.rows), columns)]


FX_FOLD = Fold(
    keys=("account_id", "currency", "fold_ticker"),
    order=("trade_date", "source_row_number"),
    inputs=(
        "currency",
        "transaction_type",
        "ticker",
        "trade_date",
        "source_row_number",
        "quantity",
        "amount",
        "fx_rate",
        "fee",
    ),
    outputs=_OUTPUT,
    initial=lambda: {"units": 0.0, "cost": 0.0, "held": {}},
    step=_step,
    columns=FxColumns,
)


def fx_ledger(tx: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    security = F.col("transaction_type") == SECURITY
    twd = F.col("currency") == BASE_CURRENCY
    rows = (
        tx.withColumn("currency", F.upper("currency"))
        .where(~(twd & F.col("transaction_type").isin("CASH_IN", "CASH_OUT")))
        .withColumn("amount", gross_native())
        .withColumn("ticker", F.when(security, F.upper("ticker")))
        .withColumn("fold_ticker", F.when(security & twd, F.col("ticker")).otherwise(""))
    )
    return ordered_fold(rows, FX_FOLD, slice_rows).drop("fold_ticker")


def pools(ledger: DataFrame) -> DataFrame:
    """Terminal pool per foreign currency; exists once a row passed its rate and net checks."""
    return (
        ledger.where(F.col("units_after").isNotNull())
        .groupBy("account_id", "currency")
        .agg(
            clean(F.max_by("units_after", "step")).alias("units"),
            clean(F.max_by("pool_cost_after", "step")).alias("twd_cost_basis"),
            *[F.sum(name).alias(name) for name in POOL_AMOUNTS if name != "realized_fx_delta"],
            clean(F.sum("realized_fx_delta")).alias("realized_fx_pnl_twd"),
        )
        .withColumn(
            "average_fx_cost",
            F.when(F.col("units") > EPSILON, F.col("twd_cost_basis") / F.col("units")).otherwise(0.0),
        )
    )


def security_basis(ledger: DataFrame) -> DataFrame:
    """Terminal native and TWD cost per (account, ticker, currency), without any currency gate."""
    average = lambda c: F.when(F.col("quantity") > EPSILON, F.col(c) / F.col("quantity")).otherwise(0.0)
    return (
        ledger.where(F.col("ticker").isNotNull())
        .groupBy("account_id", "ticker", "currency")
        .agg(
            clean(F.max_by("quantity_after", "step")).alias("quantity"),
            clean(F.max_by("native_cost_after", "step")).alias("native_cost_basis"),
            clean(F.max_by("twd_cost_after", "step")).alias("twd_cost_basis"),
            clean(F.sum("realized_twd_delta")).alias("realized_pnl_twd"),
            F.count_if(F.col("issue_code").isNull()).alias("trade_count"),
        )
        .withColumn("average_native_unit_cost", average("native_cost_basis"))
        .withColumn("average_twd_unit_cost", average("twd_cost_basis"))
    )
