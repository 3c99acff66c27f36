"""Resources and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliometry.plans import envelope, queries_backtest, resources
from foliometry.plans.catalog import query, rounded, sql_round, sql_rounded
from foliometry.plans.oracle_views import view
from foliometry.plans.account import book

P = "account_id"


def _lineaged(of, name: str, **query):
    """A resource with the quality and lineage of each row's result."""
    return resources.with_lineage(of, name, resources.select(of, name, **query))


def _digits(df, digits: int, *names):
    return df.select(*[c for c in df.columns if c not in names], *rounded(digits, *names))


view(
    "v_versions",
    """SELECT account_id, account_id % 3 + 1 AS transaction_revision, account_id % 3 + CASE WHEN account_id % 10 = 9 THEN 0 ELSE 1 END AS bound_revision, account_id % 2 + 1 AS valuation_version,
CASE WHEN account_id % 7 <> 3 THEN account_id % 3 + CASE WHEN account_id % 7 = 5 THEN 0 ELSE 1 END END AS run_revision, CASE WHEN account_id % 7 <> 3 THEN 'run-' || account_id % 2 || '-' || (account_id % 4 + 1) END AS run_source,
CASE WHEN account_id % 7 <> 3 THEN DATE '2001-06-30' - CASE WHEN account_id % 7 = 1 THEN 6 ELSE 0 END END AS run_date, max(trade_date) AS latest_date, account_id % 10 = 9 AS stale FROM v_tx GROUP BY account_id""",
)
view(
    "v_own_issues",
    """SELECT account_id, unnest(CASE WHEN missing_price AND missing_fx THEN ['MISSING_PRICE', 'MISSING_FX'] WHEN missing_fx THEN ['MISSING_FX'] ELSE ['MISSING_PRICE'] END) AS code FROM v_components WHERE missing_price OR missing_fx
UNION ALL SELECT s.account_id, 'CONFLICTING_MARK' FROM v_quote q JOIN v_snapshots s USING (snapshot_id) WHERE q.conflict""",
)
view(
    "v_issues",
    """SELECT account_id, 'TRANSACTIONS' AS domain, issue_code AS code, trade_date AS date, ticker AS symbol FROM pos_all WHERE issue_code IS NOT NULL
UNION ALL SELECT account_id, 'CASH', issue_code, trade_date, NULL FROM cash_rows WHERE issue_code IS NOT NULL
UNION ALL SELECT account_id, 'FX_COST', issue_code, trade_date, ticker FROM fx_rows WHERE issue_code IS NOT NULL
UNION ALL SELECT account_id, 'VALUATION', code, NULL, NULL FROM v_own_issues WHERE account_id % 10 <> 9
UNION ALL SELECT account_id, 'VALUATION', 'TRANSACTION_VERSION_STALE', NULL, NULL FROM v_snapshots WHERE account_id % 10 = 9
UNION ALL SELECT account_id, 'PERFORMANCE', 'MISSING_VALUATION', NULL, NULL FROM v_snapshots WHERE account_id % 10 = 9
UNION ALL SELECT account_id, 'PERFORMANCE', 'INCOMPLETE_VALUATION', NULL, NULL FROM v_totals WHERE account_id % 10 = 9 OR blocking_issue_count > 0
UNION ALL SELECT DISTINCT account_id, 'PERFORMANCE', 'TRANSACTION_AFTER_VALUATION_DATE', CAST(NULL AS DATE), NULL FROM v_tx WHERE account_id % 10 <> 9 AND trade_date > DATE '2001-06-30'
UNION ALL SELECT account_id, 'PERFORMANCE', 'UNSUPPORTED_TOTAL_RETURN_COVERAGE', min(trade_date), NULL FROM v_tx GROUP BY account_id
UNION ALL SELECT account_id, 'MARKET_DATA', CASE account_id % 7 WHEN 3 THEN 'NO_RUN' WHEN 5 THEN 'TRANSACTION_VERSION_STALE' ELSE 'MARKET_DATA_DATE_STALE' END, CASE WHEN account_id % 7 = 1 THEN DATE '2001-06-24' END, NULL FROM v_snapshots WHERE account_id % 7 IN (1, 3, 5)""",
)
_OLD = "SELECT account_id, 'TRANSACTION_VERSION_STALE' AS code, 1 AS n FROM v_versions WHERE stale"
_OWN = "SELECT account_id, code, count(*) FROM v_own_issues GROUP BY ALL"
_LATE_TRADES = "SELECT DISTINCT account_id, 'TRANSACTION_AFTER_VALUATION_DATE', 1 FROM v_tx WHERE transaction_type = 'SECURITY' AND trade_date > DATE '2001-06-30'"
_UNVALUED = "SELECT DISTINCT account_id, 'INCOMPLETE_VALUATION', 1 FROM v_components WHERE asset_type = 'POSITION' AND market_value_twd IS NULL"
view(
    "v_security_blocks",
    f"SELECT account_id, issue_code AS code, count(*) AS n FROM v_security_events WHERE issue_code IS NOT NULL GROUP BY ALL UNION ALL {_LATE_TRADES} UNION ALL {_UNVALUED}",
)
_ESTIMATES = " UNION ALL ".join(f"SELECT account_id, '{code}', 1 FROM v_versions WHERE account_id NOT IN (SELECT account_id FROM v_security_blocks)" for code in envelope.LIMITATIONS)
_BY_FRESHNESS = "CASE WHEN stale THEN 'STALE' WHEN n > 0 THEN 'INCOMPLETE' ELSE 'COMPLETE' END"
_PLAIN = "CASE WHEN n > 0 THEN 'INCOMPLETE' ELSE 'COMPLETE' END"
_RUN_STATUS = "CASE WHEN account_id % 7 IN (1, 5) THEN 'STALE' WHEN account_id % 7 = 3 THEN 'INCOMPLETE' ELSE 'COMPLETE' END"


def _of_domain(name: str) -> str:
    return f"SELECT account_id, code, count(*) AS n FROM v_issues WHERE domain = '{name}' AND code NOT IN ('TRANSACTION_VERSION_STALE', 'UNSUPPORTED_TOTAL_RETURN_COVERAGE') GROUP BY ALL"


def _absent(code: str) -> str:
    return f"SELECT account_id, '{code}', 1 FROM v_versions WHERE stale"


def _digested(*parts: str) -> str:
    return f"""SELECT account_id, string_agg(code || ':' || n, ',' ORDER BY code || ':' || n) AS issues, sum(n) AS n FROM (
SELECT account_id, code, CAST(sum(n) AS BIGINT) AS n FROM (SELECT NULL AS account_id, '' AS code, 0 AS n WHERE false UNION ALL {' UNION ALL '.join(parts)}) GROUP BY ALL) GROUP BY account_id"""


def _enveloped(sql: str, parts: list[str], status: str | None, as_of: str, revision: str, source: str, version: str, key: str = P, digest: str | None = None) -> str:
    """Rows of `sql` with the status, issues and versions of their account."""
    head = f"{status} AS status, " if status else ""
    market = ", account_id % 2 AS market_id" if key == "market_id" else ""
    envelope_sql = f"""SELECT account_id{market}, {head}coalesce(issues, '') AS issues, {as_of} AS as_of_version, {revision} AS transaction_revision, valuation_version, {source} AS source_version, {version} AS calculation_version
FROM (SELECT v.*, issues, coalesce(n, 0) AS n FROM v_versions v LEFT JOIN ({digest or _digested(*parts)}) USING (account_id))"""
    return f"SELECT * FROM ({sql}) JOIN ({envelope_sql}) USING ({key})"


_VALUED = "DATE '2001-06-30'"
_SOURCE = "coalesce(run_source, 'parser-1')"
#: Of each resource: issue parts, status, date, revision, source and calculation version.
_LINEAGE = {
    "account_snapshot": ([_OLD, _of_domain("VALUATION"), _absent("MISSING_VALUATION")], _BY_FRESHNESS, _VALUED, "transaction_revision", _SOURCE, "'valuation-1'"),
    "transactions": ([_of_domain("TRANSACTIONS")], _PLAIN, "latest_date", "transaction_revision", "'parser-1'", "CAST(NULL AS VARCHAR)"),
    "cash_flows": ([_absent("") + " AND false"], _PLAIN, "latest_date", "transaction_revision", _SOURCE, "'performance-1'"),
    "security_cash_flows": (
        [_OLD, "SELECT * FROM v_security_blocks", _ESTIMATES],
        f"CASE WHEN NOT stale AND account_id NOT IN (SELECT account_id FROM v_security_blocks) THEN 'ESTIMATED' ELSE {_BY_FRESHNESS} END",
        _VALUED,
        "bound_revision",
        "'parser-1'",
        "'security-flow-1'",
    ),
    "positions": (
        [_OLD, _of_domain("TRANSACTIONS"), _of_domain("FX_COST"), _of_domain("VALUATION"), _absent("STALE_OR_MISSING_VALUATION")],
        _BY_FRESHNESS,
        _VALUED,
        "transaction_revision",
        _SOURCE,
        "'valuation-1+fx-cost-1'",
    ),
    "valuations": ([_OLD, _OWN], _BY_FRESHNESS, _VALUED, "bound_revision", "'parser-1'", "'valuation-1'"),
    "market": (["SELECT account_id, code, count(*) FROM v_issues WHERE domain = 'MARKET_DATA' GROUP BY ALL"], _RUN_STATUS, "run_date", "run_revision", "run_source", "CAST(NULL AS VARCHAR)"),
    "strategy_comparison": ([_absent("") + " AND false"], None, _VALUED, "transaction_revision", _SOURCE, "'strategy-1'"),
    "data_quality": (
        ["SELECT account_id, code, count(*) FROM v_issues GROUP BY ALL"],
        "CASE WHEN n = 0 THEN 'COMPLETE' WHEN stale OR account_id % 7 IN (1, 5) THEN 'STALE' ELSE 'INCOMPLETE' END",
        _VALUED,
        "transaction_revision",
        _SOURCE,
        "CAST(NULL AS VARCHAR)",
    ),
}


def _with_lineage(sql: str, name: str, key: str = P) -> str:
    return _enveloped(sql, *_LINEAGE[name], key=key)


_SNAP = ("total_assets_twd", "position_value_twd", "cash_value_twd")


@query(
    "account_snapshot",
    _with_lineage(
        f"""SELECT account_id, valuation_date AS as_of, 'TWD' AS base_currency, open_position_count, n AS transaction_count, CASE WHEN account_id % 10 = 9 THEN 'STALE' WHEN blocking_issue_count > 0 THEN 'INCOMPLETE' ELSE 'COMPLETE' END AS valuation_status,
{sql_rounded(2, *_SNAP)} FROM (SELECT *, account_id % 10 <> 9 AND blocking_issue_count = 0 AS ok, CASE WHEN ok THEN known_position_value_twd + known_cash_value_twd END AS total_assets_twd, CASE WHEN ok THEN known_position_value_twd END AS position_value_twd, CASE WHEN ok THEN known_cash_value_twd END AS cash_value_twd
FROM v_totals JOIN (SELECT account_id, count(*) AS n FROM v_tx GROUP BY account_id) USING (account_id))""",
        "account_snapshot",
    ),
)
def _(spark, sf):
    return _digits(_lineaged(book(spark, sf), "account_snapshot"), 2, *_SNAP)


@query(
    "transactions_filtered",
    _with_lineage(
        f"""SELECT account_id, 'tx-' || account_id || '-' || source_row_number AS transaction_id, trade_date AS date, ticker AS symbol, {sql_rounded(4, 'quantity', 'price')}, fx_rate AS fx_rate_twd
FROM v_tx WHERE ticker = 'T4' AND trade_date BETWEEN DATE '1996-03-01' AND DATE '1999-12-31'""",
        "transactions",
    ),
)
def _(spark, sf):
    fields = ["transaction_id", "date", "symbol", "quantity", "price", "fx_rate_twd"]
    filters = {"symbol": "t4", "from": "1996-03-01", "to": "1999-12-31"}
    return _digits(_lineaged(book(spark, sf), "transactions", fields=fields, filters=filters), 4, "quantity", "price")


@query(
    "transactions_page",
    _with_lineage(
        f"""SELECT account_id, 'tx-' || account_id || '-' || source_row_number AS transaction_id, trade_date AS date, {sql_rounded(2, 'amount_foreign')} FROM v_tx WHERE transaction_type = 'CASH_OUT' ORDER BY trade_date DESC, account_id, source_row_number LIMIT 200 OFFSET 300""",
        "transactions",
    ),
)
def _(spark, sf):
    query = {"fields": ["transaction_id", "date", "amount_foreign"], "filters": {"type": "cash_out"}, "sort": ("date", "desc")}
    _first, cursor = resources.page(book(spark, sf), "transactions", limit=300, **query)
    rows, _next = resources.page(book(spark, sf), "transactions", limit=200, cursor=cursor, **query)
    return _digits(resources.with_lineage(book(spark, sf), "transactions", rows), 2, "amount_foreign")


@query(
    "cash_flows",
    _with_lineage(
        f"""SELECT account_id, 'tx-' || account_id || '-' || source_row_number AS transaction_id, trade_date AS date, CASE transaction_type WHEN 'CASH_IN' THEN 'CONTRIBUTION' ELSE 'WITHDRAWAL' END AS type, currency, fx_rate AS fx_rate_twd,
{sql_round(2, 'amount_foreign')} AS amount_native, {sql_round(2, 'amount_foreign * fx_rate')} AS amount_twd FROM v_tx WHERE transaction_type IN ('CASH_IN', 'CASH_OUT')""",
        "cash_flows",
    ),
)
def _(spark, sf):
    return _digits(_lineaged(book(spark, sf), "cash_flows"), 2, "amount_native", "amount_twd")


@query(
    "security_cash_flows",
    _with_lineage(
        f"""SELECT account_id, date, kind AS type, {sql_rounded(2, 'amount_twd')}, {sql_round(2, "CASE kind WHEN 'PURCHASE' THEN -amount_twd ELSE amount_twd END")} AS signed_amount_twd, coalesce(CAST(source_row_number AS VARCHAR), '') AS source_row_numbers,
CASE WHEN source_row_number IS NULL THEN 'ACTIVE_POSITION_VALUATION' ELSE 'TRANSACTION' END AS source FROM v_security_events WHERE issue_code IS NULL""",
        "security_cash_flows",
    ),
)
def _(spark, sf):
    return _digits(_lineaged(book(spark, sf), "security_cash_flows"), 2, "amount_twd", "signed_amount_twd")


_POS = (
    "quantity",
    "average_unit_cost_native",
    "cost_basis_native",
    "cost_basis_twd",
    "price_native",
    "market_value_twd",
    "unrealized_pl_twd",
    "realized_pl_twd",
)


@query(
    "positions_resource",
    _with_lineage(
        f"""SELECT account_id, as_of, symbol, currency, {sql_rounded(2, *_POS)} FROM (SELECT p.account_id, DATE '2001-06-30' AS as_of, p.ticker AS symbol, p.currency, p.quantity, p.cost_basis / p.quantity AS average_unit_cost_native, p.cost_basis AS cost_basis_native,
b.twd_cost_basis AS cost_basis_twd, CASE WHEN live THEN c.price END AS price_native, CASE WHEN live THEN c.market_value_twd END AS market_value_twd, CASE WHEN live THEN r.unrealized_pnl_twd END AS unrealized_pl_twd, b.realized_pnl_twd AS realized_pl_twd
FROM (SELECT *, account_id % 10 <> 9 AS live FROM pos_end WHERE abs(quantity) > 1e-9) p LEFT JOIN fx_basis b USING (account_id, ticker, currency) LEFT JOIN (SELECT * FROM v_components WHERE asset_type = 'POSITION') c USING (account_id, ticker, currency) LEFT JOIN v_reconciled r USING (account_id, ticker, currency))""",
        "positions",
    ),
)
def _(spark, sf):
    return _digits(_lineaged(book(spark, sf), "positions"), 2, *_POS)


_VAL = ("quantity_or_units", "price_or_fx_rate", "market_value_native", "market_value_twd")


@query(
    "valuations_resource",
    _with_lineage(
        f"""SELECT account_id, as_of, asset_type, symbol, currency, source_date, complete, {sql_rounded(3, *_VAL)} FROM (SELECT account_id, DATE '2001-06-30' AS as_of, asset_type, ticker AS symbol, currency, quantity AS quantity_or_units,
CASE asset_type WHEN 'POSITION' THEN price ELSE fx_rate END AS price_or_fx_rate, CASE asset_type WHEN 'POSITION' THEN price_date ELSE fx_date END AS source_date, market_value_native, market_value_twd, market_value_twd IS NOT NULL AS complete FROM v_components)""",
        "valuations",
    ),
)
def _(spark, sf):
    return _digits(_lineaged(book(spark, sf), "valuations"), 3, *_VAL)


view(
    "v_market_bars",
    f"""SELECT CAST(0 AS BIGINT) AS market_id, * FROM v_bars
UNION ALL SELECT 1, * REPLACE ({sql_rounded(4, 'raw_close * 125e-2').rsplit(' AS ', 1)[0]} AS raw_close) FROM v_bars WHERE currency <> 'EUR'""",
)
for _name, _cond, _filters in (
    ("market_prices", "<> 'FX'", {}),
    ("fx_rates", "= 'FX'", {}),
    ("market_prices_of_account", "<> 'FX' AND market_id = 1", {"account_id": 3}),
):

    _sql = f"""SELECT market_id, date, instrument_type, ticker AS symbol, currency, {sql_rounded(4, 'raw_close', 'adjusted_close')} FROM v_market_bars WHERE instrument_type {_cond}"""

    @query(_name, f"SELECT * FROM ({_with_lineage(_sql, 'market', 'market_id')}) WHERE account_id = 3" if _filters else _sql)
    def _(spark, sf, _name=_name.removesuffix("_of_account"), _filters=_filters):
        rows = resources.select(book(spark, sf), _name, filters=_filters)
        if _filters:
            rows = resources.with_lineage(book(spark, sf), _name, rows, **_filters)
        return _digits(rows, 4, "raw_close", "adjusted_close")


@query(
    "strategy_comparison",
    _with_lineage(
        f"""SELECT account_id, request_id, mode, start_date, end_date, recovery_date, execution_count, blocking_code, status, {sql_rounded(0, *queries_backtest._S1)}, {sql_rounded(6, 'xirr', *queries_backtest._S6)} FROM b_results""",
        "strategy_comparison",
    ),
)
def _(spark, sf):
    rows = _lineaged(queries_backtest.request_book(spark, sf), "strategy_comparison")
    rows = rows.withColumn("blocking_code", queries_backtest.blocking_code()).drop("issue_codes")
    return _digits(_digits(rows, 0, *queries_backtest._S1), 6, "xirr", *queries_backtest._S6)


@query(
    "comparison_status",
    """SELECT request_id, CASE WHEN bool_or(blocking IS NOT NULL OR (mode, request_id) NOT IN (SELECT (mode, request_id) FROM b_single)) THEN 'INCOMPLETE' ELSE 'ESTIMATED' END AS status,
round(coalesce(max(CASE WHEN mode = 'LUMP_SUM' AND blocking IS NULL THEN paid END), 0e0) + 1.73e-2, 0) AS lump_sum_principal_twd FROM b_summary GROUP BY request_id""",
)
def _(spark, sf):
    from foliometry.operators.backtest import comparison_status

    df = comparison_status(queries_backtest._compare(spark, sf)[0])
    return df.select("request_id", "status", *rounded(0, "lump_sum_principal_twd"))


view("b_single", "SELECT request_id, mode FROM b_bisect WHERE n = 50 GROUP BY ALL HAVING count(*) = 1")


_SAID = " ".join(f"WHEN '{code}' THEN '{text.replace(chr(39), chr(39) * 2)}'" for code, text in envelope.MESSAGES.items())


@query(
    "data_quality",
    _with_lineage(f"SELECT account_id, domain, code, CASE code {_SAID} ELSE code END AS message, 'BLOCKING' AS severity, date, symbol FROM v_issues", "data_quality"),
)
def _(spark, sf):
    return _lineaged(book(spark, sf), "data_quality")


_META = {
    "nav": ("TWD", "valuation-1"),
    "cash_ratio": ("decimal", "valuation-1"),
    "twr": ("decimal", "returns-1"),
    "max_drawdown": ("decimal", "returns-1"),
    "xirr": ("decimal", "performance-1"),
    "realized_pl": ("TWD", "fx-cost-1"),
    "unrealized_pl": ("TWD", "fx-cost-1"),
}


def _metric(name: str, oracle_value: str, digits: int, source: str, complete: str, first: str, last: str, old: str, new: str, **parameters):
    """A metric over the clean book; every tenth account is stale, with the issues `old`; others that are not complete have `new`."""
    unit, version = _META[name]
    revision = "bound_revision" if name in ("nav", "cash_ratio", "twr", "max_drawdown") else "transaction_revision"

    @query(
        f"metric_{name}",
        f"""SELECT account_id, '{name}' AS metric, CASE WHEN account_id % 10 <> 9 AND {complete} THEN {sql_round(digits, oracle_value)} END AS value, {first} AS period_from, {last} AS period_to,
CASE WHEN account_id % 10 = 9 THEN 'STALE' WHEN {complete} THEN 'COMPLETE' ELSE 'INCOMPLETE' END AS status, {last} AS as_of, '{unit}' AS unit, '{version}' AS calculation_version, CASE WHEN account_id % 10 = 9 THEN '{old}' WHEN {complete} THEN '' ELSE '{new}' END AS issues,
{revision} AS transaction_revision, valuation_version, {_SOURCE} AS source_version FROM {source} JOIN v_versions USING (account_id)""",
    )
    def _(spark, sf):
        df = resources.evaluate(book(spark, sf, clean=True), name, **parameters)
        return df.select(P, "metric", *rounded(digits, "value"), "period_from", "period_to", "status", "as_of", "unit", "calculation_version", *_VERSIONS)


_VD = "DATE '2001-06-30'"
_VERSIONS = ("issues", "transaction_revision", "valuation_version", "source_version")
_STALE = "TRANSACTION_VERSION_STALE:1"
_metric("nav", "total_assets_twd", 1, "v_totals_clean", "true", _VD, _VD, _STALE, "")
_metric("cash_ratio", "known_cash_value_twd / total_assets_twd", 7, "v_totals_clean", "true", _VD, _VD, _STALE, "")
_metric("twr", "cumulative_twr", 7, "v_drawdown", "true", "start_date", "end_date", _STALE, "", coverage="COMPLETE")
_metric("max_drawdown", "maximum_drawdown", 7, "v_drawdown", "true", "start_date", "end_date", _STALE, "", coverage="COMPLETE")
view("v_late_clean", "SELECT DISTINCT account_id FROM v_tx_clean WHERE trade_date > DATE '2001-06-30'")
_metric(
    "xirr",
    "xirr",
    7,
    "(SELECT x.*, f.first, l.account_id IS NULL AS punctual FROM v_xirr x JOIN (SELECT account_id, min(date) AS first FROM v_events_clean GROUP BY ALL) f ON f.account_id = x.account_id LEFT JOIN v_late_clean l ON l.account_id = x.account_id)",
    "punctual",
    "first",
    "CASE WHEN account_id % 10 <> 9 THEN DATE '2001-06-30' END",
    f"INCOMPLETE_VALUATION:1,MISSING_VALUATION:1,{_STALE}",
    "TRANSACTION_AFTER_VALUATION_DATE:1",
)
_metric("realized_pl", "total_realized_pnl_twd", 1, "v_reconciliation_clean", "complete", "CAST(NULL AS DATE)", _VD, f"INCOMPLETE_COST_RECONCILIATION:1,{_STALE}", "INCOMPLETE_COST_RECONCILIATION:1")
_metric("unrealized_pl", "total_unrealized_pnl_twd", 1, "v_reconciliation_clean", "complete", "CAST(NULL AS DATE)", _VD, f"INCOMPLETE_COST_RECONCILIATION:1,{_STALE}", "INCOMPLETE_COST_RECONCILIATION:1")
