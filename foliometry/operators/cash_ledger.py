"""Multi-currency cash wallets with automatic funding of foreign purchases from TWD."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliometry.operators.fold import SLICE_ROWS, Fold, ordered_fold
from foliometry.operators.lockstep import Block, doubles, named, snap
from foliometry.schema import BASE_CURRENCY, EPSILON, SECURITY, clean

AMOUNTS = (
    "deposits",
    "withdrawals",
    "explicit_fx_in",
    "explicit_fx_out",
    "auto_funded_in",
    "auto_funding_out",
    "security_spent",
    "security_received",
    "fees",
)

_OUTPUT = T.StructType(
    [
        T.StructField("currency", T.StringType()),
        T.StructField("trade_date", T.DateType()),
        T.StructField("source_row_number", T.LongType()),
        *[T.StructField(name, T.DoubleType()) for name in AMOUNTS],
        T.StructField("balance_after", T.DoubleType()),
        T.StructField("issue_code", T.StringType()),
        T.StructField("required", T.DoubleType()),
        T.StructField("available", T.DoubleType()),
    ]
)

_SLOT = {name: i for i, name in enumerate(AMOUNTS)}


def _snap(x: float) -> float:
    return 0.0 if abs(x) < EPSILON else x


def _step(balances: dict, row: tuple, emit) -> None:
    kind, currency, date, number, quantity, amount, rate, fee = row
    touched: dict[str, list[float]] = {currency: [0.0] * len(AMOUNTS)}
    balances.setdefault(currency, 0.0)
    problem = (None, None, None)

    def book(wallet: str, change: float, **amounts: float) -> None:
        slots = touched.setdefault(wallet, [0.0] * len(AMOUNTS))
        for name, value in amounts.items():
            slots[_SLOT[name]] += value
        balances[wallet] = _snap(balances.get(wallet, 0.0) + change)

    def short(wallet: str, needed: float) -> bool:
        touched.setdefault(wallet, [0.0] * len(AMOUNTS))
        return balances.setdefault(wallet, 0.0) + EPSILON < needed

    rated = rate is not None and rate > 0
    if kind == "CASH_IN":
        if amount - fee < -EPSILON:
            problem = ("NEGATIVE_NET_CASH_IN", None, None)
        else:
            book(currency, amount - fee, deposits=amount, fees=fee)
    elif kind == "CASH_OUT":
        if short(currency, amount + fee):
            problem = ("CASH_OUT_EXCEEDS_BALANCE", amount + fee, balances[currency])
        else:
            book(currency, -(amount + fee), withdrawals=amount, fees=fee)
    elif kind in ("FX_BUY", "FX_SELL") and currency == BASE_CURRENCY:
        problem = ("INVALID_FX_CURRENCY", None, None)
    elif kind in ("FX_BUY", "FX_SELL") and not rated:
        problem = ("MISSING_FX_RATE", None, None)
    elif kind == "FX_BUY":
        cost = amount * rate
        if short(BASE_CURRENCY, cost + fee):
            problem = ("INSUFFICIENT_TWD_FOR_FX_BUY", cost + fee, balances[BASE_CURRENCY])
        else:
            book(BASE_CURRENCY, -(cost + fee), explicit_fx_out=cost, fees=fee)
            book(currency, amount, explicit_fx_in=amount)
    elif kind == "FX_SELL":
        gross = amount * rate
        if short(currency, amount):
            problem = ("FX_SELL_EXCEEDS_BALANCE", amount, balances[currency])
        elif gross - fee < -EPSILON:
            problem = ("NEGATIVE_NET_FX_PROCEEDS", None, None)
        else:
            book(currency, -amount, explicit_fx_out=amount)
            book(BASE_CURRENCY, gross - fee, explicit_fx_in=gross, fees=fee)
    elif quantity > 0:
        needed = amount + fee
        if currency != BASE_CURRENCY and short(currency, needed):
            gap = needed - balances[currency]
            if not rated:
                problem = ("MISSING_FX_RATE_FOR_AUTO_FUND", gap, balances[currency])
            elif short(BASE_CURRENCY, gap * rate):
                problem = ("INSUFFICIENT_TWD_FOR_AUTO_FUND", gap * rate, balances[BASE_CURRENCY])
            else:
                book(BASE_CURRENCY, -(gap * rate), auto_funding_out=gap * rate)
                book(currency, gap, auto_funded_in=gap)
        if problem[0] is None:
            if short(currency, needed):
                problem = ("INSUFFICIENT_CASH_FOR_SECURITY_BUY", needed, balances[currency])
            else:
                book(currency, -needed, security_spent=amount, fees=fee)
    elif amount - fee < -EPSILON:
        problem = ("NEGATIVE_NET_SECURITY_PROCEEDS", None, None)
    else:
        book(currency, amount - fee, security_received=amount, fees=fee)

    for wallet, slots in touched.items():
        blame = problem if wallet == currency else (None, None, None)
        emit((wallet, date, number, *slots, balances[wallet], *blame))


ISSUES = (
    "NEGATIVE_NET_CASH_IN",
    "CASH_OUT_EXCEEDS_BALANCE",
    "INVALID_FX_CURRENCY",
    "MISSING_FX_RATE",
    "INSUFFICIENT_TWD_FOR_FX_BUY",
    "FX_SELL_EXCEEDS_BALANCE",
    "NEGATIVE_NET_FX_PROCEEDS",
    "MISSING_FX_RATE_FOR_AUTO_FUND",
    "INSUFFICIENT_TWD_FOR_AUTO_FUND",
    "INSUFFICIENT_CASH_FOR_SECURITY_BUY",
    "NEGATIVE_NET_SECURITY_PROCEEDS",
)
_ISSUE = {name: i for i, name in enumerate(ISSUES, 1)}


class CashColumns:
    """The same steps for many accounts side by side; a wallet is a number of (account, currency)."""

    def __init__(self, block: Block, name: dict[str, str]):
        self.block = block
        kind, kinds = block.codes(name["transaction_type"])
        self.kind = {k: kind == i for i, k in enumerate(kinds)}
        self.currency, self.currencies = block.codes(name["currency"])
        base = self.currencies.index(BASE_CURRENCY) if BASE_CURRENCY in self.currencies else len(self.currencies)
        self.base = self.currency == base
        self.wallet, self.first = block.slots(self.currency)
        self.quantity, self.amount, self.rate, self.fee = (block.numbers(name[c]) for c in ("quantity", "amount_foreign", "fx_rate", "fee"))
        # balances of the wallets, then of each account's TWD wallet, which need not have a row of its own
        self.balance = np.zeros(len(self.first) + len(block.starts))
        self.wallet = np.where(self.base, len(self.first) + block.key, self.wallet)
        self.own, self.twd = np.zeros((2, len(AMOUNTS), block.rows))
        self.after, self.twd_after, self.required, self.available = np.zeros((4, block.rows))
        self.issue, self.touched = np.zeros(block.rows, np.int32), np.zeros(block.rows, bool)

    def _is(self, kind: str, rows: np.ndarray) -> np.ndarray:
        return self.kind[kind][rows] if kind in self.kind else np.zeros(len(rows), bool)

    def advance(self, rows: np.ndarray, keys: np.ndarray) -> None:
        amount, fee, rate, quantity, base = self.amount[rows], self.fee[rows], self.rate[rows], self.quantity[rows], self.base[rows]
        wallet, twd_wallet = self.wallet[rows], len(self.first) + keys
        own, twd = self.balance[wallet], self.balance[twd_wallet]
        rated = rate > 0
        issue, required, available = np.zeros(len(rows), np.int32), np.full(len(rows), np.nan), np.full(len(rows), np.nan)

        def block(where: np.ndarray, code: str, needed=None, there=None) -> np.ndarray:
            issue[where] = _ISSUE[code]
            if needed is not None:
                required[where], available[where] = needed[where], there[where]
            return where

        def note(to: np.ndarray, slot: str, where: np.ndarray, value: np.ndarray) -> None:
            to[_SLOT[slot], rows[where]] = value[where]

        spent, net = amount + fee, amount - fee
        cash_in = self._is("CASH_IN", rows)
        cash_in &= ~block(cash_in & (net < -EPSILON), "NEGATIVE_NET_CASH_IN")
        cash_out = self._is("CASH_OUT", rows)
        cash_out &= ~block(cash_out & (own + EPSILON < spent), "CASH_OUT_EXCEEDS_BALANCE", spent, own)
        fx_buy, fx_sell = self._is("FX_BUY", rows), self._is("FX_SELL", rows)
        refused = block((fx_buy | fx_sell) & base, "INVALID_FX_CURRENCY") | block((fx_buy | fx_sell) & ~base & ~rated, "MISSING_FX_RATE")
        fx_buy, fx_sell = fx_buy & ~refused, fx_sell & ~refused
        gross = amount * rate
        touched = fx_buy.copy()
        fx_buy &= ~block(fx_buy & (twd + EPSILON < gross + fee), "INSUFFICIENT_TWD_FOR_FX_BUY", gross + fee, twd)
        fx_sell &= ~block(fx_sell & (own + EPSILON < amount), "FX_SELL_EXCEEDS_BALANCE", amount, own)
        fx_sell &= ~block(fx_sell & (gross - fee < -EPSILON), "NEGATIVE_NET_FX_PROCEEDS")
        touched |= fx_sell

        trade = self._is(SECURITY, rows)
        buy, sell = trade & (quantity > 0), trade & ~(quantity > 0)
        sell &= ~block(sell & (net < -EPSILON), "NEGATIVE_NET_SECURITY_PROCEEDS")
        gap = spent - own
        short = buy & ~base & (own + EPSILON < spent)
        unrated = block(short & ~rated, "MISSING_FX_RATE_FOR_AUTO_FUND", gap, own)
        touched |= short & rated
        poor = block(short & rated & (twd + EPSILON < gap * rate), "INSUFFICIENT_TWD_FOR_AUTO_FUND", gap * rate, twd)
        funded = short & ~unrated & ~poor
        buy &= ~unrated & ~poor
        after_funding = np.where(funded, snap(own + gap), own)
        buy &= ~block(buy & (after_funding + EPSILON < spent), "INSUFFICIENT_CASH_FOR_SECURITY_BUY", spent, after_funding)

        new = np.where(cash_in | sell, snap(own + net), after_funding)
        new = np.where(cash_out, snap(own - spent), np.where(buy, snap(after_funding - spent), new))
        new = np.where(fx_buy, snap(own + amount), np.where(fx_sell, snap(own - amount), new))
        new_twd = np.where(fx_buy, snap(twd - (gross + fee)), np.where(fx_sell, snap(twd + (gross - fee)), np.where(funded, snap(twd - gap * rate), twd)))
        self.balance[twd_wallet] = new_twd
        self.balance[wallet] = new  # a row in TWD books only here, so this comes last
        self.after[rows], self.twd_after[rows] = new, new_twd

        note(self.own, "deposits", cash_in, amount)
        note(self.own, "withdrawals", cash_out, amount)
        note(self.own, "explicit_fx_in", fx_buy, amount)
        note(self.own, "explicit_fx_out", fx_sell, amount)
        note(self.own, "auto_funded_in", funded, gap)
        note(self.own, "security_spent", buy, amount)
        note(self.own, "security_received", sell, amount)
        note(self.own, "fees", cash_in | cash_out | buy | sell, fee)
        note(self.twd, "explicit_fx_out", fx_buy, gross)
        note(self.twd, "explicit_fx_in", fx_sell, gross)
        note(self.twd, "auto_funding_out", funded, gap * rate)
        note(self.twd, "fees", fx_buy | fx_sell, fee)
        self.touched[rows] = touched
        self.issue[rows], self.required[rows], self.available[rows] = issue, required, available

    def state(self, key: int) -> dict:
        start, end = self.block.starts[key], self.block.starts[key] + self.block.lengths[key]
        wallets = {self.currencies[c]: float(self.balance[w]) for c, w in zip(self.currency[start:end].tolist(), self.wallet[start:end].tolist()) if c >= 0}
        return {**wallets, BASE_CURRENCY: float(self.balance[len(self.first) + key])}

    def outputs(self) -> list[tuple[np.ndarray, dict[str, pa.Array]]]:
        own = {name: doubles(self.own[i]) for name, i in _SLOT.items()}
        own |= {"balance_after": doubles(self.after), "issue_code": named(self.issue, ISSUES)}
        own |= {"required": doubles(self.required, ~np.isnan(self.required)), "available": doubles(self.available, ~np.isnan(self.available))}
        rows = np.flatnonzero(self.touched)
        blank = pa.nulls(len(rows))
        twd = {name: doubles(self.twd[i, rows]) for name, i in _SLOT.items()}
        twd |= {"currency": pa.array([BASE_CURRENCY]).take(pa.array(np.zeros(len(rows), np.int64))), "balance_after": doubles(self.twd_after[rows])}
        return [(np.arange(self.block.rows), own), (rows, {**twd, "issue_code": blank, "required": blank, "available": blank})]


CASH_FOLD = Fold(
    keys=("account_id",),
    order=("trade_date", "source_row_number"),
    inputs=(
        "transaction_type",
        "currency",
        "trade_date",
        "source_row_number",
        "quantity",
        "amount_foreign",
        "fx_rate",
        "fee",
    ),
    outputs=_OUTPUT,
    initial=dict,
    step=_step,
    columns=CashColumns,
)


def tracking(tx: DataFrame) -> DataFrame:
    """Date from which an account's cash is tracked: its first non-SECURITY row; null if none."""
    first = F.min(F.when(F.col("transaction_type") != SECURITY, F.col("trade_date")))
    return tx.groupBy("account_id").agg(first.alias("tracked_from")).withColumn(
        "tracking_mode", F.when(F.col("tracked_from").isNull(), "UNTRACKED").otherwise("TRACKED")
    )


def cash_ledger(tx: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row per transaction and touched wallet; accounts without any cash row have no ledger."""
    tracked = tx.where(F.col("transaction_type") != SECURITY).select("account_id").distinct()
    rows = tx.withColumn("currency", F.upper("currency")).join(tracked, "account_id", "left_semi")
    return ordered_fold(rows, CASH_FOLD, slice_rows)


def wallets(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("account_id", "currency").agg(
        *[clean(F.sum(name)).alias(name) for name in AMOUNTS],
        clean(F.max_by("balance_after", "step")).alias("ending_balance"),
    )
