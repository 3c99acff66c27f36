"""Independent SQL of the derived tables and ledgers, as common table expressions.

Each entry names the expressions it reads; ``compose`` puts a query together with exactly the ones
it needs.  Ledgers are recursive queries over per-key row numbers.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql.strip()


def compose(sql: str) -> str:
    """Prefix ``sql`` with the expressions it refers to, dependencies first."""
    order: list[str] = []

    def visit(text: str, me: str | None) -> None:
        for word in dict.fromkeys(re.findall(r"[a-z_0-9]+", text)):
            if word in VIEWS and word != me and word not in order:
                visit(VIEWS[word], word)
                if word not in order:
                    order.append(word)

    visit(sql, None)
    if not order:
        return sql.strip()
    parts = []
    for n in order:
        recursive = re.search(rf"\b{n}\b", VIEWS[n])
        parts.append(f"{n} AS ({VIEWS[n]})" if recursive else f"{n} AS MATERIALIZED ({VIEWS[n]})")
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + sql.strip()


CLEAN = "CASE WHEN abs({0}) < 1e-9 THEN 0e0 ELSE {0} END"


def clean(expression: str) -> str:
    return CLEAN.format(f"({expression})")


view(
    "v_trades",
    """
SELECT l_suppkey AS account_id,
  date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) * 1000000000 + 200000000
    + row_number() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE)
      ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS source_row_number,
  CAST(l_shipdate AS DATE) AS trade_date, 'SECURITY' AS transaction_type,
  'T' || (l_partkey % 20) AS ticker,
  CASE (l_partkey % 20) % 3 WHEN 0 THEN 'TWD' WHEN 1 THEN 'USD' ELSE 'EUR' END AS currency,
  CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS quantity,
  l_extendedprice / l_quantity AS price, l_extendedprice AS amount_foreign,
  30 + (l_orderkey % 40) * 1e-1 AS rate,
  CAST((CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_tax * 100) AS BIGINT)) // 10000 AS DOUBLE) / 100 AS fee,
  l_orderkey, l_linenumber
FROM lineitem""",
)
view(
    "v_orders",
    """
SELECT o_custkey % (SELECT count(*) FROM supplier) AS account_id, CAST(o_orderdate AS DATE) AS trade_date,
  date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) * 1000000000 + 300000000
    + row_number() OVER (PARTITION BY o_custkey % (SELECT count(*) FROM supplier), CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS source_row_number,
  o_orderkey, o_totalprice, o_orderpriority,
  CAST((CAST(round(o_totalprice * 100) AS BIGINT) * 5) // 10000 AS DOUBLE) / 100 AS fee
FROM orders""",
)
view(
    "v_tx",
    """
SELECT account_id, source_row_number, trade_date, transaction_type, ticker, ccy AS currency, quantity, price, amount_foreign,
  CASE WHEN ccy = 'TWD' THEN 1e0 WHEN l_linenumber <> 7 THEN rate END AS fx_rate, fee
FROM (SELECT *, CASE WHEN ticker = 'T7' AND l_orderkey % 50 = 0 THEN 'EUR' ELSE currency END AS ccy FROM v_trades)
UNION ALL
SELECT account_id, source_row_number, trade_date,
  CASE o_orderpriority[1] WHEN '1' THEN 'CASH_IN' WHEN '2' THEN 'CASH_IN' WHEN '3' THEN 'FX_BUY' WHEN '4' THEN 'FX_SELL' ELSE 'CASH_OUT' END,
  '', CASE WHEN o_orderpriority[1] IN ('1', '5') THEN 'TWD' ELSE 'USD' END, 0e0, 0e0,
  CASE WHEN o_orderpriority[1] IN ('3', '4') THEN o_totalprice / 100 ELSE o_totalprice END,
  CASE WHEN o_orderpriority[1] IN ('1', '5') THEN 1e0 ELSE 30 + (o_orderkey % 40) * 1e-1 END, fee
FROM v_orders""",
)
view(
    "v_lots",
    """
SELECT account_id, 100000000 + CAST(substr(ticker, 2) AS BIGINT) AS source_row_number, DATE '1995-01-01' AS trade_date,
  'SECURITY' AS transaction_type, ticker, currency, qty AS quantity, 1000e0 AS price, qty * 1000 AS amount_foreign,
  CASE WHEN currency = 'TWD' THEN 1e0 ELSE 31e0 END AS fx_rate, 0e0 AS fee
FROM (SELECT account_id, ticker, currency, sum(CASE WHEN quantity < 0 THEN -quantity ELSE 0e0 END) + 10 AS qty
  FROM v_trades GROUP BY ALL)""",
)
view(
    "v_tx_clean",
    """
SELECT account_id, source_row_number, trade_date, transaction_type, ticker, currency, quantity, price, amount_foreign,
  CASE WHEN currency = 'TWD' THEN 1e0 ELSE rate END AS fx_rate, fee FROM v_trades
UNION ALL SELECT * FROM v_lots
UNION ALL
SELECT account_id, CASE currency WHEN 'TWD' THEN 1 WHEN 'USD' THEN 2 ELSE 3 END, DATE '1995-01-01', 'CASH_IN', '', currency, 0e0, 0e0,
  ceil(spent / 1e8) * 1e6 + 5e7, CASE WHEN currency = 'TWD' THEN 1e0 ELSE 305e-1 END, 0e0
FROM (SELECT account_id, currency, sum(CAST(round(amount_foreign * 100) AS BIGINT) + CAST(round(fee * 100) AS BIGINT)) AS spent
  FROM (SELECT account_id, currency, amount_foreign, fee FROM v_trades WHERE quantity > 0 UNION ALL
        SELECT account_id, currency, amount_foreign, fee FROM v_lots WHERE quantity > 0 UNION ALL
        SELECT account_id, CASE o_orderpriority[1] WHEN '4' THEN 'USD' ELSE 'TWD' END,
          CASE o_orderpriority[1] WHEN '3' THEN 50 * (300 + o_orderkey % 40) WHEN '4' THEN 400 ELSE 50000 END, 0
        FROM v_orders WHERE o_orderpriority[1] IN ('3', '4', '5')) GROUP BY ALL)
UNION ALL
SELECT account_id, source_row_number, trade_date, CASE o_orderpriority[1] WHEN '3' THEN 'FX_BUY' WHEN '4' THEN 'FX_SELL' WHEN '5' THEN 'CASH_OUT' ELSE 'CASH_IN' END, '',
  CASE WHEN o_orderpriority[1] IN ('1', '5') THEN 'TWD' ELSE 'USD' END, 0e0, 0e0,
  CASE o_orderpriority[1] WHEN '1' THEN 1e5 WHEN '2' THEN 1e3 WHEN '3' THEN 5e2 WHEN '4' THEN 4e2 ELSE 5e4 END,
  CASE WHEN o_orderpriority[1] IN ('1', '5') THEN 1e0 ELSE (300 + o_orderkey % 40) / 1e1 END, 0e0
FROM v_orders""",
)
view(
    "v_prices",
    """
SELECT 'T' || (l_partkey % 20) AS ticker, CASE (l_partkey % 20) % 3 WHEN 0 THEN 'TWD' WHEN 1 THEN 'USD' ELSE 'EUR' END AS currency,
  CAST(l_shipdate AS DATE) AS d, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS c, sum(CAST(l_quantity AS BIGINT)) AS q
FROM lineitem GROUP BY ALL""",
)
view(
    "v_rates",
    """
SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'USD' ELSE 'EUR' END AS currency, CAST(o_orderdate AS DATE) AS d,
  sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS c, count(*) AS q
FROM orders GROUP BY ALL""",
)
view(
    "v_marks_base",
    """
SELECT 'PRICE' AS mark_type, ticker, currency, last_day(d) AS mark_date, round(CAST(sum(c) AS DOUBLE) / sum(q) / 100 + 1.73e-6, 4) AS value, 'MONTHLY' AS source
FROM v_prices GROUP BY ALL
UNION ALL SELECT DISTINCT 'PRICE', ticker, currency, DATE '1995-01-01', 1000e0, 'MONTHLY' FROM v_prices
UNION ALL SELECT 'FX', '', currency, last_day(d), round(28 + CAST(sum(c) AS DOUBLE) / sum(q) / 1e7 + 1.73e-6, 4), 'MONTHLY' FROM v_rates GROUP BY currency, last_day(d)
UNION ALL SELECT DISTINCT 'FX', '', currency, DATE '1995-01-01', 31e0, 'MONTHLY' FROM v_rates""",
)
view(
    "v_marks",
    """
SELECT snapshot_id, date_diff('day', DATE '1995-01-01', mark_date) * 1000
    + row_number() OVER (PARTITION BY snapshot_id, mark_date ORDER BY mark_type, ticker, currency, source) AS source_row_number,
  mark_date, mark_type, ticker, currency, value, source
FROM (
  SELECT CAST(0 AS BIGINT) AS snapshot_id, * FROM v_marks_base
  UNION ALL SELECT 1, * FROM v_marks_base WHERE (currency <> 'EUR' OR mark_type = 'PRICE') AND ticker <> 'T16'
  UNION ALL SELECT 1, mark_type, ticker, currency, mark_date, CASE WHEN ticker = 'T13' THEN value + 1 ELSE value END, 'ALTERNATE'
  FROM v_marks_base WHERE ticker IN ('T3', 'T6', 'T13'))""",
)
view(
    "v_bars",
    """
SELECT *, round(raw_close * 95e-2 + 1.73e-6, 4) AS adjusted_close FROM (
  SELECT 'SECURITY' AS instrument_type, ticker, currency, d AS date, round(CAST(c AS DOUBLE) / q / 100 + 1.73e-6, 4) AS raw_close FROM v_prices
  UNION ALL SELECT 'FX', '', currency, d, round(28 + CAST(c AS DOUBLE) / q / 1e7 + 1.73e-6, 4) FROM v_rates)""",
)


def ledgers(suffix: str, tx: str) -> None:
    """The three ledgers over one transaction table."""
    view(
        f"pos_in{suffix}",
        f"""
SELECT *, row_number() OVER (PARTITION BY account_id, ticker ORDER BY trade_date, source_row_number) AS k FROM (
  SELECT *, CASE WHEN amount_foreign > 0 THEN amount_foreign ELSE abs(quantity) * price END AS amount,
    first_value(currency) OVER (PARTITION BY account_id, ticker ORDER BY trade_date, source_row_number) AS first_currency
  FROM {tx} WHERE transaction_type = 'SECURITY') WHERE currency = first_currency""",
    )
    view(
        f"pos_fold{suffix}",
        f"""
SELECT account_id, ticker, currency, CAST(NULL AS DATE) AS trade_date, CAST(0 AS BIGINT) AS source_row_number, CAST(0 AS BIGINT) AS k,
  0e0 AS quantity_after, 0e0 AS cost_after, 0e0 AS realized_delta, 0e0 AS gross_buy, 0e0 AS gross_sell, 0e0 AS fee, CAST(NULL AS VARCHAR) AS issue_code
FROM pos_in{suffix} WHERE k = 1
UNION ALL
SELECT r.account_id, r.ticker, r.currency, r.trade_date, r.source_row_number, r.k,
  CASE WHEN r.quantity > 0 THEN f.quantity_after + r.quantity WHEN -r.quantity > f.quantity_after + 1e-9 THEN f.quantity_after
    ELSE {clean("f.quantity_after + r.quantity")} END,
  CASE WHEN r.quantity > 0 THEN f.cost_after + r.amount + r.fee WHEN -r.quantity > f.quantity_after + 1e-9 THEN f.cost_after
    ELSE {clean("f.cost_after - f.cost_after / f.quantity_after * -r.quantity")} END,
  CASE WHEN r.quantity > 0 OR -r.quantity > f.quantity_after + 1e-9 THEN 0e0
    ELSE r.amount - r.fee - f.cost_after / f.quantity_after * -r.quantity END,
  CASE WHEN r.quantity > 0 THEN r.amount ELSE 0e0 END,
  CASE WHEN r.quantity > 0 OR -r.quantity > f.quantity_after + 1e-9 THEN 0e0 ELSE r.amount END,
  CASE WHEN r.quantity <= 0 AND -r.quantity > f.quantity_after + 1e-9 THEN 0e0 ELSE r.fee END,
  CASE WHEN r.quantity <= 0 AND -r.quantity > f.quantity_after + 1e-9 THEN 'OVERSELL' END
FROM pos_fold{suffix} f JOIN pos_in{suffix} r ON r.account_id = f.account_id AND r.ticker = f.ticker AND r.k = f.k + 1""",
    )
    view(
        f"pos_rows{suffix}",
        f"""
SELECT account_id, ticker, currency, trade_date, source_row_number, k, quantity_after, cost_after, realized_delta, gross_buy, gross_sell, fee, issue_code
FROM pos_fold{suffix} WHERE k > 0""",
    )
    view(
        f"pos_all{suffix}",
        f"""
SELECT account_id, ticker, currency, trade_date, source_row_number, quantity_after, cost_after, realized_delta, gross_buy, gross_sell, fee, issue_code FROM pos_rows{suffix}
UNION ALL
SELECT account_id, ticker, currency, trade_date, source_row_number, NULL, NULL, 0e0, 0e0, 0e0, 0e0, 'CURRENCY_MISMATCH' FROM (
  SELECT *, first_value(currency) OVER (PARTITION BY account_id, ticker ORDER BY trade_date, source_row_number) AS first_currency
  FROM {tx} WHERE transaction_type = 'SECURITY') WHERE currency <> first_currency""",
    )
    view(
        f"pos_end{suffix}",
        f"""
SELECT account_id, ticker, currency, max_by(quantity_after, k) AS quantity, max_by(cost_after, k) AS cost_basis, sum(realized_delta) AS realized_pnl,
  sum(gross_buy) AS gross_buys, sum(gross_sell) AS gross_sells, sum(fee) AS fees, count(*) FILTER (issue_code IS NULL) AS trade_count
FROM pos_rows{suffix} GROUP BY ALL""",
    )
    # cash: balances of TWD, USD and EUR side by side; one row per transaction
    view(
        f"cash_in{suffix}",
        f"""
SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY trade_date, source_row_number) AS k,
  CASE WHEN transaction_type = 'SECURITY' AND quantity <= 0 THEN 'SELL' WHEN transaction_type = 'SECURITY' THEN 'BUY' ELSE transaction_type END AS kind
FROM {tx} WHERE account_id IN (SELECT account_id FROM {tx} WHERE transaction_type <> 'SECURITY')""",
    )
    # verdict first (from the balances before the row), then the movements
    balance = "CASE r.currency WHEN 'TWD' THEN f.twd WHEN 'USD' THEN f.usd ELSE f.eur END"
    rated = "coalesce(r.fx_rate, 0) > 0"
    view(
        f"cash_fold{suffix}",
        f"""
SELECT account_id, CAST(0 AS BIGINT) AS k, 0e0 AS twd, 0e0 AS usd, 0e0 AS eur, CAST(NULL AS VARCHAR) AS issue_code, 0e0 AS gap, 0e0 AS own, 0e0 AS base,
  CAST(NULL AS DOUBLE) AS required, CAST(NULL AS DOUBLE) AS available
FROM cash_in{suffix} WHERE k = 1
UNION ALL
SELECT account_id, k, {clean("twd + base + CASE WHEN currency = 'TWD' THEN own ELSE 0e0 END")},
  {clean("usd + CASE WHEN currency = 'USD' THEN own ELSE 0e0 END")}, {clean("eur + CASE WHEN currency = 'EUR' THEN own ELSE 0e0 END")},
  issue_code, gap, own, base,
  CASE issue_code WHEN 'CASH_OUT_EXCEEDS_BALANCE' THEN amount_foreign + fee WHEN 'INSUFFICIENT_TWD_FOR_FX_BUY' THEN amount_foreign * fx_rate + fee
    WHEN 'FX_SELL_EXCEEDS_BALANCE' THEN amount_foreign WHEN 'MISSING_FX_RATE_FOR_AUTO_FUND' THEN gap WHEN 'INSUFFICIENT_TWD_FOR_AUTO_FUND' THEN gap * fx_rate
    WHEN 'INSUFFICIENT_CASH_FOR_SECURITY_BUY' THEN amount_foreign + fee END,
  CASE WHEN issue_code IN ('INSUFFICIENT_TWD_FOR_FX_BUY', 'INSUFFICIENT_TWD_FOR_AUTO_FUND') THEN twd
    WHEN issue_code IN ('CASH_OUT_EXCEEDS_BALANCE', 'FX_SELL_EXCEEDS_BALANCE', 'MISSING_FX_RATE_FOR_AUTO_FUND', 'INSUFFICIENT_CASH_FOR_SECURITY_BUY') THEN bal END
FROM (SELECT *,
    CASE WHEN issue_code IS NOT NULL THEN 0e0 WHEN kind = 'CASH_IN' THEN amount_foreign - fee WHEN kind = 'CASH_OUT' THEN -(amount_foreign + fee)
      WHEN kind = 'FX_BUY' THEN amount_foreign WHEN kind = 'FX_SELL' THEN -amount_foreign WHEN kind = 'BUY' THEN gap - (amount_foreign + fee) ELSE amount_foreign - fee END AS own,
    CASE WHEN issue_code IS NOT NULL THEN 0e0 WHEN kind = 'FX_BUY' THEN -(amount_foreign * fx_rate + fee) WHEN kind = 'FX_SELL' THEN amount_foreign * fx_rate - fee
      WHEN kind = 'BUY' AND gap > 0 THEN -(gap * fx_rate) ELSE 0e0 END AS base
  FROM (SELECT *,
      CASE WHEN kind = 'CASH_IN' AND amount_foreign - fee < -1e-9 THEN 'NEGATIVE_NET_CASH_IN'
        WHEN kind = 'CASH_OUT' AND bal + 1e-9 < amount_foreign + fee THEN 'CASH_OUT_EXCEEDS_BALANCE'
        WHEN kind IN ('FX_BUY', 'FX_SELL') AND currency = 'TWD' THEN 'INVALID_FX_CURRENCY'
        WHEN kind IN ('FX_BUY', 'FX_SELL') AND NOT rated THEN 'MISSING_FX_RATE'
        WHEN kind = 'FX_BUY' AND twd + 1e-9 < amount_foreign * fx_rate + fee THEN 'INSUFFICIENT_TWD_FOR_FX_BUY'
        WHEN kind = 'FX_SELL' AND bal + 1e-9 < amount_foreign THEN 'FX_SELL_EXCEEDS_BALANCE'
        WHEN kind = 'FX_SELL' AND amount_foreign * fx_rate - fee < -1e-9 THEN 'NEGATIVE_NET_FX_PROCEEDS'
        WHEN kind = 'BUY' AND gap > 0 AND NOT rated THEN 'MISSING_FX_RATE_FOR_AUTO_FUND'
        WHEN kind = 'BUY' AND gap > 0 AND twd + 1e-9 < gap * fx_rate THEN 'INSUFFICIENT_TWD_FOR_AUTO_FUND'
        WHEN kind = 'BUY' AND currency = 'TWD' AND bal + 1e-9 < amount_foreign + fee THEN 'INSUFFICIENT_CASH_FOR_SECURITY_BUY'
        WHEN kind = 'SELL' AND amount_foreign - fee < -1e-9 THEN 'NEGATIVE_NET_SECURITY_PROCEEDS' END AS issue_code
    FROM (SELECT r.account_id, r.k, r.kind, r.currency, r.amount_foreign, r.fee, r.fx_rate, {rated} AS rated, f.twd, f.usd, f.eur, {balance} AS bal,
        CASE WHEN r.kind = 'BUY' AND r.currency <> 'TWD' AND {balance} + 1e-9 < r.amount_foreign + r.fee THEN r.amount_foreign + r.fee - ({balance}) ELSE 0e0 END AS gap
      FROM cash_fold{suffix} f JOIN cash_in{suffix} r ON r.account_id = f.account_id AND r.k = f.k + 1)))""",
    )
    view(
        f"cash_done{suffix}",
        f"""
SELECT r.*, f.twd, f.usd, f.eur, f.issue_code, f.gap, f.own, f.base, f.required, f.available
FROM cash_fold{suffix} f JOIN cash_in{suffix} r ON r.account_id = f.account_id AND r.k = f.k""",
    )
    view(
        f"cash_rows{suffix}",
        f"""
SELECT account_id, currency, trade_date, source_row_number, k,
  CASE WHEN kind = 'CASH_IN' AND issue_code IS NULL THEN amount_foreign ELSE 0e0 END AS deposits,
  CASE WHEN kind = 'CASH_OUT' AND issue_code IS NULL THEN amount_foreign ELSE 0e0 END AS withdrawals,
  CASE WHEN kind = 'FX_BUY' AND issue_code IS NULL THEN amount_foreign ELSE 0e0 END AS explicit_fx_in,
  CASE WHEN kind = 'FX_SELL' AND issue_code IS NULL THEN amount_foreign ELSE 0e0 END AS explicit_fx_out,
  CASE WHEN kind = 'BUY' AND issue_code IS NULL THEN gap ELSE 0e0 END AS auto_funded_in, 0e0 AS auto_funding_out,
  CASE WHEN kind = 'BUY' AND issue_code IS NULL THEN amount_foreign ELSE 0e0 END AS security_spent,
  CASE WHEN kind = 'SELL' AND issue_code IS NULL THEN amount_foreign ELSE 0e0 END AS security_received,
  CASE WHEN kind IN ('FX_BUY', 'FX_SELL') OR issue_code IS NOT NULL THEN 0e0 ELSE fee END AS fees,
  CASE currency WHEN 'TWD' THEN twd WHEN 'USD' THEN usd ELSE eur END AS balance_after, issue_code, required, available
FROM cash_done{suffix}
UNION ALL
SELECT account_id, 'TWD', trade_date, source_row_number, k, 0e0, 0e0,
  CASE WHEN kind = 'FX_SELL' AND issue_code IS NULL THEN amount_foreign * fx_rate ELSE 0e0 END,
  CASE WHEN kind = 'FX_BUY' AND issue_code IS NULL THEN amount_foreign * fx_rate ELSE 0e0 END, 0e0,
  CASE WHEN kind = 'BUY' AND issue_code IS NULL THEN gap * fx_rate ELSE 0e0 END, 0e0, 0e0,
  CASE WHEN kind IN ('FX_BUY', 'FX_SELL') AND issue_code IS NULL THEN fee ELSE 0e0 END, twd, NULL, NULL, NULL
FROM cash_done{suffix} WHERE currency <> 'TWD' AND (
  (kind IN ('FX_BUY', 'FX_SELL') AND issue_code IS NULL) OR issue_code IN ('INSUFFICIENT_TWD_FOR_FX_BUY', 'INSUFFICIENT_TWD_FOR_AUTO_FUND')
  OR (kind = 'BUY' AND gap > 0 AND issue_code IS NULL))""",
    )
    view(
        f"wallets{suffix}",
        f"""
SELECT account_id, currency, sum(deposits) AS deposits, sum(withdrawals) AS withdrawals, sum(explicit_fx_in) AS explicit_fx_in,
  sum(explicit_fx_out) AS explicit_fx_out, sum(auto_funded_in) AS auto_funded_in, sum(auto_funding_out) AS auto_funding_out,
  sum(security_spent) AS security_spent, sum(security_received) AS security_received, sum(fees) AS fees, max_by(balance_after, k) AS ending_balance
FROM cash_rows{suffix} GROUP BY account_id, currency""",
    )
    # foreign pools; a ticker's quantity and costs are kept in maps keyed by ticker
    view(
        f"fx_in{suffix}",
        f"""
SELECT *, row_number() OVER (PARTITION BY account_id, currency, fold_ticker ORDER BY trade_date, source_row_number) AS k FROM (
  SELECT *, CASE WHEN amount_foreign > 0 THEN amount_foreign ELSE abs(quantity) * price END AS amount,
    CASE WHEN transaction_type = 'SECURITY' AND currency = 'TWD' THEN ticker ELSE '' END AS fold_ticker,
    CASE WHEN transaction_type = 'SECURITY' AND quantity <= 0 THEN 'SELL' WHEN transaction_type = 'SECURITY' THEN 'BUY' ELSE transaction_type END AS kind,
    coalesce(fx_rate, 0) > 0 AS rated, CASE WHEN transaction_type = 'SECURITY' THEN CAST(substr(ticker, 2) AS INTEGER) + 1 ELSE 21 END AS slot
  FROM {tx} WHERE NOT (currency = 'TWD' AND transaction_type IN ('CASH_IN', 'CASH_OUT')))""",
    )
    z = "list_transform(range(21), lambda x: 0e0)"
    view(
        f"fx_fold{suffix}",
        f"""
SELECT account_id, currency, fold_ticker, CAST(0 AS BIGINT) AS k, 0e0 AS units, 0e0 AS cost, {z} AS q, {z} AS n, {z} AS t,
  CAST(NULL AS VARCHAR) AS issue_code, 0e0 AS gap, 0e0 AS released, 0e0 AS out_n, 0e0 AS out_t, 0e0 AS proceeds, 0e0 AS units_before, 0e0 AS cost_before
FROM fx_in{suffix} WHERE k = 1
UNION ALL
SELECT account_id, currency, fold_ticker, k,
  CASE WHEN issue_code IS NOT NULL OR currency = 'TWD' THEN units
    WHEN kind = 'FX_BUY' THEN {clean("units + amount")} WHEN kind = 'CASH_IN' THEN {clean("units + (amount - fee)")}
    WHEN kind IN ('FX_SELL', 'CASH_OUT', 'BUY') THEN {clean("units + gap - need")}
    WHEN amount - fee > 1e-9 THEN {clean("units + (amount - fee)")} ELSE units END,
  CASE WHEN issue_code IS NOT NULL OR currency = 'TWD' THEN cost
    WHEN kind = 'FX_BUY' THEN {clean("cost + (amount * fx_rate + fee)")} WHEN kind = 'CASH_IN' THEN {clean("cost + (amount - fee) * fx_rate")}
    WHEN kind IN ('FX_SELL', 'CASH_OUT', 'BUY') THEN CASE WHEN {clean("units + gap - need")} = 0 THEN 0e0 ELSE {clean("pool_cost - released")} END
    WHEN amount - fee > 1e-9 THEN {clean("cost + proceeds")} ELSE cost END,
  CASE WHEN issue_code IS NOT NULL OR kind NOT IN ('BUY', 'SELL') THEN q ELSE list_transform(q, lambda v, i: CASE WHEN i = slot THEN
    CASE WHEN kind = 'BUY' THEN v + quantity ELSE {clean("v + quantity")} END ELSE v END) END,
  CASE WHEN issue_code IS NOT NULL OR kind NOT IN ('BUY', 'SELL') THEN n ELSE list_transform(n, lambda v, i: CASE WHEN i = slot THEN
    CASE WHEN kind = 'BUY' THEN v + (amount + fee) WHEN {clean("held + quantity")} = 0 THEN 0e0 ELSE {clean("v - out_n")} END ELSE v END) END,
  CASE WHEN issue_code IS NOT NULL OR kind NOT IN ('BUY', 'SELL') THEN t ELSE list_transform(t, lambda v, i: CASE WHEN i = slot THEN
    CASE WHEN kind = 'BUY' THEN v + CASE WHEN currency = 'TWD' THEN amount + fee ELSE released END WHEN {clean("held + quantity")} = 0 THEN 0e0 ELSE {clean("v - out_t")} END ELSE v END) END,
  issue_code, gap, released, out_n, out_t, proceeds, units, cost
FROM (SELECT *,
    CASE WHEN kind IN ('FX_BUY', 'FX_SELL') AND currency = 'TWD' THEN 'INVALID_FX_CURRENCY'
      WHEN kind IN ('FX_BUY', 'FX_SELL', 'CASH_IN') AND NOT rated THEN 'MISSING_FX_RATE'
      WHEN kind = 'FX_SELL' AND amount * fx_rate - fee < -1e-9 THEN 'NEGATIVE_NET_FX_PROCEEDS'
      WHEN kind = 'CASH_IN' AND amount - fee < -1e-9 THEN 'NEGATIVE_NET_CASH_IN'
      WHEN kind = 'BUY' AND currency <> 'TWD' AND gap > 0 AND NOT rated THEN 'MISSING_FX_RATE_FOR_AUTO_FUND'
      WHEN kind IN ('FX_SELL', 'CASH_OUT') AND units + 1e-9 < need THEN 'INSUFFICIENT_FOREIGN_POOL'
      WHEN kind = 'SELL' AND -quantity > held + 1e-9 THEN 'OVERSELL'
      WHEN kind = 'SELL' AND amount - fee < -1e-9 THEN 'NEGATIVE_NET_SECURITY_PROCEEDS'
      WHEN kind = 'SELL' AND currency <> 'TWD' AND amount - fee > 1e-9 AND NOT rated THEN 'MISSING_SECURITY_SALE_FX' END AS issue_code,
    CASE WHEN units + gap > 1e-9 THEN pool_cost / (units + gap) ELSE 0e0 END * need AS released,
    CASE WHEN held > 1e-9 THEN held_n / held ELSE 0e0 END * -quantity AS out_n, CASE WHEN held > 1e-9 THEN held_t / held ELSE 0e0 END * -quantity AS out_t,
    CASE WHEN currency = 'TWD' THEN amount - fee ELSE (amount - fee) * coalesce(fx_rate, 0) END AS proceeds
  FROM (SELECT *, cost + CASE WHEN gap > 0 AND rated THEN gap * fx_rate ELSE 0e0 END AS pool_cost
    FROM (SELECT r.account_id, r.currency, r.fold_ticker, r.k, r.kind, r.slot, r.quantity, r.amount, r.fee, r.fx_rate, r.rated, f.units, f.cost, f.q, f.n, f.t,
      f.q[r.slot] AS held, f.n[r.slot] AS held_n, f.t[r.slot] AS held_t,
      CASE r.kind WHEN 'FX_SELL' THEN r.amount WHEN 'CASH_OUT' THEN r.amount + r.fee WHEN 'BUY' THEN r.amount + r.fee ELSE 0e0 END AS need,
      CASE WHEN r.kind = 'BUY' AND r.currency <> 'TWD' AND f.units + 1e-9 < r.amount + r.fee THEN r.amount + r.fee - f.units ELSE 0e0 END AS gap
      FROM fx_fold{suffix} f JOIN fx_in{suffix} r ON r.account_id = f.account_id AND r.currency = f.currency AND r.fold_ticker = f.fold_ticker AND r.k = f.k + 1)))""",
    )
    view(
        f"fx_rows{suffix}",
        f"""
SELECT r.account_id, r.currency, r.fold_ticker, CASE WHEN r.transaction_type = 'SECURITY' THEN r.ticker END AS ticker, r.trade_date, r.source_row_number, r.k, r.kind,
  CASE WHEN touched THEN f.units END AS units_after, CASE WHEN touched THEN f.cost END AS pool_cost_after,
  CASE WHEN r.kind = 'FX_BUY' AND f.issue_code IS NULL THEN r.amount ELSE 0e0 END AS explicit_fx_units_in,
  CASE WHEN r.kind = 'CASH_IN' AND f.issue_code IS NULL THEN r.amount - r.fee ELSE 0e0 END AS external_cash_units_in,
  CASE WHEN r.kind = 'BUY' AND f.issue_code IS NULL THEN f.gap ELSE 0e0 END AS automatic_units_in,
  CASE WHEN r.kind = 'BUY' AND f.issue_code IS NULL AND r.currency <> 'TWD' THEN r.amount + r.fee ELSE 0e0 END AS units_assigned_to_securities,
  CASE WHEN r.kind = 'FX_SELL' AND f.issue_code IS NULL THEN r.amount ELSE 0e0 END AS units_sold_to_twd,
  CASE WHEN r.kind = 'CASH_OUT' AND f.issue_code IS NULL THEN r.amount ELSE 0e0 END AS units_withdrawn,
  CASE WHEN r.kind IN ('CASH_IN', 'CASH_OUT') AND f.issue_code IS NULL THEN r.fee ELSE 0e0 END AS foreign_fee_units,
  CASE WHEN r.kind = 'CASH_IN' AND f.issue_code IS NULL THEN r.fee * r.fx_rate
    WHEN r.kind = 'CASH_OUT' AND f.issue_code IS NULL AND f.units_before > 1e-9 THEN r.fee * (f.cost_before / f.units_before) ELSE 0e0 END AS foreign_fee_twd_cost,
  CASE WHEN r.kind IN ('FX_BUY', 'FX_SELL') AND f.issue_code IS NULL THEN r.fee ELSE 0e0 END AS twd_fees,
  CASE WHEN r.kind = 'FX_SELL' AND f.issue_code IS NULL THEN r.amount * r.fx_rate - r.fee - f.released ELSE 0e0 END AS realized_fx_delta,
  CASE WHEN r.transaction_type = 'SECURITY' THEN f.q[r.slot] END AS quantity_after, CASE WHEN r.transaction_type = 'SECURITY' THEN f.n[r.slot] END AS native_cost_after,
  CASE WHEN r.transaction_type = 'SECURITY' THEN f.t[r.slot] END AS twd_cost_after,
  CASE WHEN r.kind = 'SELL' AND f.issue_code IS NULL THEN f.proceeds - f.out_t ELSE 0e0 END AS realized_twd_delta, f.issue_code,
  CASE f.issue_code WHEN 'INSUFFICIENT_FOREIGN_POOL' THEN r.amount + CASE WHEN r.kind = 'FX_SELL' THEN 0e0 ELSE r.fee END
    WHEN 'MISSING_FX_RATE_FOR_AUTO_FUND' THEN f.gap WHEN 'OVERSELL' THEN -r.quantity END AS required,
  CASE WHEN f.issue_code IN ('INSUFFICIENT_FOREIGN_POOL', 'MISSING_FX_RATE_FOR_AUTO_FUND') THEN f.units WHEN f.issue_code = 'OVERSELL' THEN f.q[r.slot] END AS available
FROM (SELECT *, currency <> 'TWD' AND (issue_code IS NULL OR issue_code IN ('INSUFFICIENT_FOREIGN_POOL', 'MISSING_FX_RATE_FOR_AUTO_FUND')) AS open_ FROM fx_fold{suffix}) f
JOIN fx_in{suffix} r ON r.account_id = f.account_id AND r.currency = f.currency AND r.fold_ticker = f.fold_ticker AND r.k = f.k,
LATERAL (SELECT f.open_ AND (r.kind <> 'SELL' OR r.amount - r.fee > 1e-9) AS touched)""",
    )
    view(
        f"fx_pools{suffix}",
        f"""
SELECT account_id, currency, max_by(units_after, k) AS units, max_by(pool_cost_after, k) AS twd_cost_basis, sum(explicit_fx_units_in) AS explicit_fx_units_in,
  sum(external_cash_units_in) AS external_cash_units_in, sum(automatic_units_in) AS automatic_units_in, sum(units_assigned_to_securities) AS units_assigned_to_securities,
  sum(units_sold_to_twd) AS units_sold_to_twd, sum(units_withdrawn) AS units_withdrawn, sum(foreign_fee_units) AS foreign_fee_units,
  sum(foreign_fee_twd_cost) AS foreign_fee_twd_cost, sum(twd_fees) AS twd_fees, sum(realized_fx_delta) AS realized_fx_pnl_twd
FROM fx_rows{suffix} WHERE units_after IS NOT NULL GROUP BY account_id, currency""",
    )
    view(
        f"fx_basis{suffix}",
        f"""
SELECT account_id, ticker, currency, max_by(quantity_after, k) AS quantity, max_by(native_cost_after, k) AS native_cost_basis,
  max_by(twd_cost_after, k) AS twd_cost_basis, sum(realized_twd_delta) AS realized_pnl_twd, count(*) FILTER (issue_code IS NULL) AS trade_count
FROM fx_rows{suffix} WHERE ticker IS NOT NULL GROUP BY account_id, ticker, currency""",
    )


ledgers("", "v_tx")
ledgers("_clean", "v_tx_clean")
