"""Ledgers, point-in-time valuation, reconciliation and gates."""

from __future__ import annotations

from foliometry.operators import cash_ledger, fx_ledger, gate, position_ledger, valuation
from foliometry.operators.marks import snapshot_quotes
from foliometry.plans import fixtures
from foliometry.plans.catalog import query, rounded, sql_round, sql_rounded
from foliometry.plans.oracle_views import view
from foliometry.plans.account import book

P = "account_id"

_POS = ("quantity_after", "cost_after", "realized_delta", "gross_buy", "gross_sell", "fee")


@query(
    "position_ledger",
    f"SELECT account_id, ticker, currency, trade_date, source_row_number, {sql_rounded(4, *_POS)}, issue_code FROM pos_all",
)
def _(spark, sf):
    return book(spark, sf).security_ledger.select(
        P, "ticker", "currency", "trade_date", "source_row_number", *rounded(4, *_POS), "issue_code"
    )


_END = ("quantity", "cost_basis", "realized_pnl", "gross_buys", "gross_sells", "fees", "average_unit_cost")


@query(
    "positions",
    f"""SELECT account_id, ticker, currency, trade_count, {sql_rounded(3, *_END)} FROM (
SELECT *, CASE WHEN quantity > 1e-9 THEN cost_basis / quantity ELSE 0e0 END AS average_unit_cost FROM pos_end)""",
)
def _(spark, sf):
    return book(spark, sf).positions.select(P, "ticker", "currency", "trade_count", *rounded(3, *_END))


_TOT = ("gross_buys", "gross_sells", "fees", "net_security_cash_flow", "realized_pnl")


@query(
    "currency_totals",
    f"""SELECT account_id, currency, {sql_rounded(2, *_TOT)} FROM (SELECT account_id, currency, sum(gross_buy) AS gross_buys, sum(gross_sell) AS gross_sells,
sum(fee) AS fees, sum(gross_sell) - sum(gross_buy) - sum(fee) AS net_security_cash_flow, sum(realized_delta) AS realized_pnl FROM pos_rows GROUP BY ALL)""",
)
def _(spark, sf):
    return position_ledger.currency_totals(book(spark, sf).security_ledger).select(P, "currency", *rounded(2, *_TOT))


@query(
    "transaction_counts",
    """SELECT account_id, count(*) FILTER (transaction_type = 'SECURITY') AS security_transaction_count,
count(*) FILTER (transaction_type <> 'SECURITY') AS deferred_transaction_count FROM v_tx GROUP BY ALL""",
)
def _(spark, sf):
    return position_ledger.row_counts(fixtures.tx(spark, sf))


@query(
    "currency_gate",
    """SELECT account_id, ticker, currency, source_row_number, issue_code FROM pos_all WHERE issue_code = 'CURRENCY_MISMATCH'""",
)
def _(spark, sf):
    return (
        book(spark, sf)
        .security_ledger.where("issue_code = 'CURRENCY_MISMATCH'")
        .select(P, "ticker", "currency", "source_row_number", "issue_code")
    )


@query(
    "cash_tracking_mode",
    """SELECT account_id, min(trade_date) FILTER (transaction_type <> 'SECURITY') AS tracked_from,
CASE WHEN bool_or(transaction_type <> 'SECURITY') THEN 'TRACKED' ELSE 'UNTRACKED' END AS tracking_mode FROM v_tx GROUP BY ALL""",
)
def _(spark, sf):
    return cash_ledger.tracking(fixtures.tx(spark, sf))


_CASH = (*cash_ledger.AMOUNTS, "balance_after", "required", "available")


@query(
    "cash_ledger",
    f"SELECT account_id, currency, trade_date, source_row_number, {sql_rounded(3, *_CASH)}, issue_code FROM cash_rows",
)
def _(spark, sf):
    return book(spark, sf).cash_ledger.select(
        P, "currency", "trade_date", "source_row_number", *rounded(3, *_CASH), "issue_code"
    )


_WALLET = (*cash_ledger.AMOUNTS, "ending_balance")


@query("cash_wallets", f"SELECT account_id, currency, {sql_rounded(2, *_WALLET)} FROM wallets")
def _(spark, sf):
    return book(spark, sf).wallets.select(P, "currency", *rounded(2, *_WALLET))


_FX = (
    "units_after",
    "pool_cost_after",
    "quantity_after",
    "native_cost_after",
    "twd_cost_after",
    "realized_fx_delta",
    "realized_twd_delta",
    "required",
    "available",
)


@query(
    "fx_ledger",
    f"SELECT account_id, currency, ticker, trade_date, source_row_number, {sql_rounded(3, *_FX)}, issue_code FROM fx_rows",
)
def _(spark, sf):
    return book(spark, sf).fx_ledger.select(
        P, "currency", "ticker", "trade_date", "source_row_number", *rounded(3, *_FX), "issue_code"
    )


_POOL = (
    "units",
    "twd_cost_basis",
    *[n for n in fx_ledger.POOL_AMOUNTS if n != "realized_fx_delta"],
    "realized_fx_pnl_twd",
)


@query(
    "fx_cost_pools",
    f"""SELECT account_id, currency, {sql_rounded(2, *_POOL)}, {sql_round(6, 'CASE WHEN units > 1e-9 THEN twd_cost_basis / units ELSE 0e0 END')} AS average_fx_cost
FROM fx_pools""",
)
def _(spark, sf):
    return book(spark, sf).pools.select(P, "currency", *rounded(2, *_POOL), *rounded(6, "average_fx_cost"))


_BASIS = ("quantity", "native_cost_basis", "twd_cost_basis", "realized_pnl_twd")


@query(
    "security_twd_basis",
    f"""SELECT account_id, ticker, currency, trade_count, {sql_rounded(2, *_BASIS)},
{sql_round(4, 'CASE WHEN quantity > 1e-9 THEN twd_cost_basis / quantity ELSE 0e0 END')} AS average_twd_unit_cost FROM fx_basis""",
)
def _(spark, sf):
    return book(spark, sf).basis.select(
        P, "ticker", "currency", "trade_count", *rounded(2, *_BASIS), *rounded(4, "average_twd_unit_cost")
    )


view(
    "v_snapshots",
    "SELECT DISTINCT account_id, CASE WHEN account_id % 4 = 3 THEN 1 ELSE 0 END AS snapshot_id, DATE '2001-06-30' AS valuation_date FROM v_tx",
)
view(
    "v_daily_marks",
    """
SELECT snapshot_id, mark_type, ticker, currency, mark_date, max(value) - min(value) >= 1e-9 AS conflict,
  CASE WHEN max(value) - min(value) < 1e-9 THEN arg_min(value, (source, source_row_number)) END AS value, min(source) AS source
FROM v_marks GROUP BY ALL""",
)
view(
    "v_quotes",
    """
SELECT snapshot_id, mark_type, ticker, currency, max(mark_date) AS price_date, arg_max(CASE WHEN conflict THEN NULL ELSE value END, mark_date) AS any_value,
  arg_max(conflict, mark_date) AS conflict
FROM v_daily_marks WHERE mark_date <= DATE '2001-06-30' GROUP BY ALL""",
)
view(
    "v_quote",
    """SELECT q.snapshot_id, q.mark_type, q.ticker, q.currency, q.price_date, d.value, d.source, d.conflict
FROM v_quotes q JOIN v_daily_marks d ON d.snapshot_id = q.snapshot_id AND d.mark_type = q.mark_type AND d.ticker = q.ticker AND d.currency = q.currency AND d.mark_date = q.price_date""",
)
view(
    "v_components",
    f"""
SELECT s.account_id, s.snapshot_id, 'POSITION' AS asset_type, p.ticker, p.currency, p.quantity, p.cost_basis, m.value AS price, m.price_date,
  CASE WHEN p.currency = 'TWD' THEN 1e0 ELSE f.value END AS fx_rate, CASE WHEN p.currency = 'TWD' THEN s.valuation_date WHEN f.value IS NOT NULL THEN f.price_date END AS fx_date,
  p.quantity * m.value AS market_value_native, p.quantity * m.value - p.cost_basis AS unrealized_pnl_native,
  p.quantity * m.value * CASE WHEN p.currency = 'TWD' THEN 1e0 ELSE f.value END AS market_value_twd,
  m.value IS NULL AS missing_price, p.currency <> 'TWD' AND f.value IS NULL AS missing_fx
FROM pos_end p JOIN v_snapshots s USING (account_id)
LEFT JOIN (SELECT * FROM v_quote WHERE mark_type = 'PRICE' AND NOT conflict) m ON m.snapshot_id = s.snapshot_id AND m.ticker = p.ticker AND m.currency = p.currency
LEFT JOIN (SELECT * FROM v_quote WHERE mark_type = 'FX' AND NOT conflict) f ON f.snapshot_id = s.snapshot_id AND f.currency = p.currency
WHERE p.quantity > 1e-9
UNION ALL
SELECT s.account_id, s.snapshot_id, 'CASH', '', w.currency, w.ending_balance, NULL, NULL, NULL,
  CASE WHEN w.currency = 'TWD' THEN 1e0 ELSE coalesce(f.value, CASE WHEN abs(w.ending_balance) <= 1e-9 THEN 0e0 END) END,
  CASE WHEN w.currency = 'TWD' THEN s.valuation_date WHEN f.value IS NOT NULL THEN f.price_date END, w.ending_balance, NULL,
  CASE WHEN w.currency = 'TWD' THEN w.ending_balance ELSE coalesce(w.ending_balance * f.value, CASE WHEN abs(w.ending_balance) <= 1e-9 THEN 0e0 END) END,
  false, w.currency <> 'TWD' AND f.value IS NULL AND abs(w.ending_balance) > 1e-9
FROM wallets w JOIN v_snapshots s USING (account_id)
LEFT JOIN (SELECT * FROM v_quote WHERE mark_type = 'FX' AND NOT conflict) f ON f.snapshot_id = s.snapshot_id AND f.currency = w.currency""",
)
view(
    "v_totals",
    """
SELECT s.account_id, s.snapshot_id, s.valuation_date, coalesce(c.pv, 0e0) AS known_position_value_twd, coalesce(c.cv, 0e0) AS known_cash_value_twd,
  coalesce(c.n, 0) + coalesce(q.n, 0) AS blocking_issue_count, coalesce(m.n, 0) AS future_mark_count, coalesce(c.open_n, 0) AS open_position_count, coalesce(c.null_n, 0) = 0 AS positions_complete
FROM v_snapshots s
LEFT JOIN (SELECT account_id, sum(market_value_twd) FILTER (asset_type = 'POSITION') AS pv, sum(market_value_twd) FILTER (asset_type = 'CASH') AS cv, sum(missing_price::INT + missing_fx::INT) AS n,
  count(*) FILTER (asset_type = 'POSITION') AS open_n, count(*) FILTER (asset_type = 'POSITION' AND market_value_twd IS NULL) AS null_n FROM v_components GROUP BY account_id) c ON c.account_id = s.account_id
LEFT JOIN (SELECT snapshot_id, count(*) AS n FROM v_quote WHERE conflict GROUP BY snapshot_id) q ON q.snapshot_id = s.snapshot_id
LEFT JOIN (SELECT snapshot_id, count(*) AS n FROM v_marks WHERE mark_date > DATE '2001-06-30' GROUP BY snapshot_id) m ON m.snapshot_id = s.snapshot_id""",
)


@query(
    "as_of_marks",
    "SELECT snapshot_id, mark_type, ticker, currency, price_date AS mark_date, value, source, conflict FROM v_quote",
)
def _(spark, sf):
    b = book(spark, sf)
    return snapshot_quotes(b.marks, b.snapshots).select(
        "snapshot_id", "mark_type", "ticker", "currency", "mark_date", "value", "source", "conflict"
    )


_PART = ("quantity", "cost_basis", "price", "fx_rate", "market_value_native", "unrealized_pnl_native", "market_value_twd")


@query(
    "valuation_components",
    f"SELECT account_id, snapshot_id, asset_type, ticker, currency, price_date, fx_date, {sql_rounded(3, *_PART)}, missing_price, missing_fx FROM v_components",
)
def _(spark, sf):
    return book(spark, sf).components.select(
        P,
        "snapshot_id",
        "asset_type",
        "ticker",
        "currency",
        "price_date",
        "fx_date",
        *rounded(3, *_PART),
        "missing_price",
        "missing_fx",
    )


@query(
    "valuation_issues",
    """SELECT account_id, unnest(CASE WHEN missing_price AND missing_fx THEN ['MISSING_PRICE', 'MISSING_FX'] WHEN missing_fx THEN ['MISSING_FX'] ELSE ['MISSING_PRICE'] END) AS issue_code,
ticker, currency, CAST(NULL AS DATE) AS mark_date FROM v_components WHERE missing_price OR missing_fx
UNION ALL SELECT s.account_id, 'CONFLICTING_MARK', q.ticker, q.currency, q.price_date FROM v_quote q JOIN v_snapshots s USING (snapshot_id) WHERE q.conflict""",
)
def _(spark, sf):
    b = book(spark, sf)
    return valuation.valuation_issues(b.components, b.marks, b.snapshots)


@query(
    "account_valuation",
    f"""SELECT account_id, snapshot_id, valuation_date, {sql_rounded(2, 'known_position_value_twd', 'known_cash_value_twd')},
{sql_round(2, 'known_position_value_twd + known_cash_value_twd')} AS known_total_assets_twd,
CASE WHEN blocking_issue_count = 0 THEN {sql_round(2, 'known_position_value_twd + known_cash_value_twd')} END AS total_assets_twd,
CAST(blocking_issue_count AS BIGINT) AS blocking_issue_count, future_mark_count, open_position_count, positions_complete, blocking_issue_count = 0 AS complete FROM v_totals""",
)
def _(spark, sf):
    value = ("known_position_value_twd", "known_cash_value_twd", "known_total_assets_twd", "total_assets_twd")
    df = book(spark, sf).totals
    return df.select(*[c for c in df.columns if c not in value], *rounded(2, *value))


view(
    "v_reconciled",
    """SELECT c.account_id, c.ticker, c.currency, c.market_value_twd, b.twd_cost_basis, c.market_value_twd - b.twd_cost_basis AS unrealized_pnl_twd
FROM (SELECT * FROM v_components WHERE asset_type = 'POSITION') c LEFT JOIN (SELECT * FROM fx_basis WHERE quantity > 1e-9) b
ON b.account_id = c.account_id AND b.ticker = c.ticker AND b.currency = c.currency""",
)


@query(
    "cost_reconciliation",
    f"SELECT account_id, ticker, currency, {sql_rounded(2, 'market_value_twd', 'twd_cost_basis', 'unrealized_pnl_twd')} FROM v_reconciled",
)
def _(spark, sf):
    return book(spark, sf).reconciled.select(
        P, "ticker", "currency", *rounded(2, "market_value_twd", "twd_cost_basis", "unrealized_pnl_twd")
    )


_REC = (
    "total_position_market_value_twd",
    "total_position_twd_cost_basis",
    "total_unrealized_pnl_twd",
    "total_realized_pnl_twd",
)

_RECONCILIATION = """
SELECT t.account_id, ok AS complete, CASE WHEN ok THEN coalesce(r.v, 0e0) END AS total_position_market_value_twd, CASE WHEN ok THEN coalesce(r.c, 0e0) END AS total_position_twd_cost_basis,
  CASE WHEN ok THEN coalesce(r.u, 0e0) END AS total_unrealized_pnl_twd, CASE WHEN coalesce(i.n, 0) = 0 THEN coalesce(z.r, 0e0) END AS total_realized_pnl_twd,
  coalesce(r.missing, 0) AS missing_cost_count, coalesce(r.keys, '') AS missing_cost_keys, coalesce(i.n, 0) AS cost_blocking_issue_count
FROM {totals} t
LEFT JOIN (SELECT account_id, sum(market_value_twd) AS v, sum(twd_cost_basis) AS c, sum(unrealized_pnl_twd) AS u, count(*) FILTER (unrealized_pnl_twd IS NULL) AS open_ends,
  count(*) FILTER (twd_cost_basis IS NULL) AS missing,
  string_agg(ticker || ':' || currency, ',' ORDER BY ticker || ':' || currency) FILTER (twd_cost_basis IS NULL) AS keys FROM {rec} GROUP BY account_id) r ON r.account_id = t.account_id
LEFT JOIN (SELECT account_id, sum(r) AS r FROM (SELECT account_id, realized_pnl_twd AS r FROM {basis} UNION ALL SELECT account_id, realized_fx_pnl_twd FROM {pools}) GROUP BY account_id) z ON z.account_id = t.account_id
LEFT JOIN (SELECT account_id, count(*) AS n FROM {rows} WHERE issue_code IS NOT NULL GROUP BY account_id) i ON i.account_id = t.account_id,
LATERAL (SELECT t.blocking_issue_count = 0 AND coalesce(i.n, 0) = 0 AND coalesce(r.open_ends, 0) = 0 AS ok)"""

view(
    "v_reconciliation",
    _RECONCILIATION.format(totals="v_totals", rec="v_reconciled", basis="fx_basis", pools="fx_pools", rows="fx_rows"),
)

view(
    "v_components_clean",
    """
SELECT p.account_id, 'POSITION' AS asset_type, p.ticker, p.currency, p.quantity, p.cost_basis, m.value AS price, m.price_date, p.quantity * m.value AS market_value_native,
  p.quantity * m.value * CASE WHEN p.currency = 'TWD' THEN 1e0 ELSE f.value END AS market_value_twd
FROM pos_end_clean p LEFT JOIN (SELECT * FROM v_quote WHERE snapshot_id = 0 AND mark_type = 'PRICE') m ON m.ticker = p.ticker AND m.currency = p.currency
LEFT JOIN (SELECT * FROM v_quote WHERE snapshot_id = 0 AND mark_type = 'FX') f ON f.currency = p.currency WHERE p.quantity > 1e-9
UNION ALL
SELECT w.account_id, 'CASH', '', w.currency, w.ending_balance, NULL, f.value, f.price_date, w.ending_balance,
  w.ending_balance * CASE WHEN w.currency = 'TWD' THEN 1e0 ELSE f.value END
FROM wallets_clean w LEFT JOIN (SELECT * FROM v_quote WHERE snapshot_id = 0 AND mark_type = 'FX') f ON f.currency = w.currency""",
)
view(
    "v_totals_clean",
    """SELECT account_id, sum(market_value_twd) FILTER (asset_type = 'POSITION') AS known_position_value_twd, sum(market_value_twd) FILTER (asset_type = 'CASH') AS known_cash_value_twd,
sum(market_value_twd) AS total_assets_twd, 0 AS blocking_issue_count, count(*) FILTER (asset_type = 'POSITION') AS open_position_count FROM v_components_clean GROUP BY account_id""",
)
view(
    "v_reconciled_clean",
    """SELECT c.account_id, c.ticker, c.currency, c.market_value_twd, b.twd_cost_basis, c.market_value_twd - b.twd_cost_basis AS unrealized_pnl_twd
FROM (SELECT * FROM v_components_clean WHERE asset_type = 'POSITION') c LEFT JOIN (SELECT * FROM fx_basis_clean WHERE quantity > 1e-9) b
ON b.account_id = c.account_id AND b.ticker = c.ticker AND b.currency = c.currency""",
)
view(
    "v_reconciliation_clean",
    _RECONCILIATION.format(
        totals="v_totals_clean", rec="v_reconciled_clean", basis="fx_basis_clean", pools="fx_pools_clean", rows="fx_rows_clean"
    ),
)

_REC_COLUMNS = f"account_id, complete, {sql_rounded(1, *_REC)}, missing_cost_count, missing_cost_keys, cost_blocking_issue_count"


def _reconciliation(df):
    return df.select(
        P, "complete", *rounded(1, *_REC), "missing_cost_count", "missing_cost_keys", "cost_blocking_issue_count"
    )


@query("reconciliation_totals_blocked", f"SELECT {_REC_COLUMNS} FROM v_reconciliation")
def _(spark, sf):
    return _reconciliation(book(spark, sf).reconciliation)


@query("reconciliation_totals", f"SELECT {_REC_COLUMNS} FROM v_reconciliation_clean")
def _(spark, sf):
    return _reconciliation(book(spark, sf, clean=True).reconciliation)


_ISSUE_ROWS = """
SELECT account_id, 'SECURITY_ACCOUNTING' AS domain, issue_code, source_row_number, trade_date, ticker, currency, CAST(NULL AS DOUBLE) AS required, CAST(NULL AS DOUBLE) AS available
FROM pos_all WHERE issue_code IS NOT NULL
UNION ALL SELECT account_id, 'CASH_FX_FUNDING', issue_code, source_row_number, trade_date, NULL, currency, required, available FROM cash_rows WHERE issue_code IS NOT NULL"""
view("v_primary_issues", _ISSUE_ROWS)
view(
    "v_activation_issues",
    """SELECT * FROM v_primary_issues UNION ALL
SELECT account_id, 'FX_COST_BASIS', issue_code, source_row_number, trade_date, ticker, currency, required, available FROM fx_rows f WHERE issue_code IS NOT NULL
AND NOT EXISTS (SELECT 1 FROM v_primary_issues p WHERE p.account_id = f.account_id AND p.source_row_number = f.source_row_number)""",
)
view(
    "v_nav_issues",
    """SELECT * FROM v_primary_issues UNION ALL
SELECT account_id, 'FX_COST_BASIS', issue_code, source_row_number, trade_date, ticker, currency, required, available FROM fx_rows f WHERE issue_code IS NOT NULL
AND NOT EXISTS (SELECT 1 FROM v_primary_issues p WHERE p.account_id = f.account_id AND p.source_row_number = f.source_row_number AND p.issue_code = f.issue_code)""",
)
_ISSUE = f"account_id, domain, issue_code, source_row_number, trade_date, ticker, currency, {sql_rounded(3, 'required', 'available')}"


def _issues(df):
    return df.select(
        P, "domain", "issue_code", "source_row_number", "trade_date", "ticker", "currency", *rounded(3, "required", "available")
    )


@query("activation_issues", f"SELECT {_ISSUE} FROM v_activation_issues")
def _(spark, sf):
    b = book(spark, sf)
    return _issues(gate.activation_issues(b.security_ledger, b.cash_ledger, b.fx_ledger))


@query("nav_ledger_issues", f"SELECT {_ISSUE} FROM v_nav_issues")
def _(spark, sf):
    b = book(spark, sf)
    return _issues(gate.nav_issues(b.security_ledger, b.cash_ledger, b.fx_ledger))


@query(
    "activation_gate",
    """SELECT p.account_id, count(i.issue_code) AS blocking_issue_count, count(i.issue_code) = 0 AS may_activate
FROM (SELECT DISTINCT account_id FROM v_tx) p LEFT JOIN v_activation_issues i USING (account_id) GROUP BY ALL""",
)
def _(spark, sf):
    b = book(spark, sf)
    return gate.activation_gate(gate.activation_issues(b.security_ledger, b.cash_ledger, b.fx_ledger), b.tx)


@query(
    "issue_heads",
    """SELECT account_id, n, domain, issue_code, source_row_number FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY trade_date, source_row_number, domain) AS n
FROM v_activation_issues) WHERE n <= 10""",
)
def _(spark, sf):
    b = book(spark, sf)
    issues = gate.activation_issues(b.security_ledger, b.cash_ledger, b.fx_ledger)
    return gate.issue_heads(issues, 10).select(P, "n", "domain", "issue_code", "source_row_number")
