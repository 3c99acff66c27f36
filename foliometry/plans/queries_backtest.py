"""Backtests over a request per supplier."""

from __future__ import annotations

import datetime
from dataclasses import replace

from pyspark.sql import functions as F

from foliometry.operators import backtest, market
from foliometry.plans import fixtures
from foliometry.plans.catalog import query, rounded, sql_round, sql_rounded
from foliometry.plans.oracle_views import view
from foliometry.plans.account import book

R = "request_id"


def request_texts(spark, sf):
    k = F.col("s_suppkey")
    two = F.concat(F.lit("T"), k % 20, F.lit(":60, t"), (k + 7) % 20, F.lit(":40"))
    text = (
        F.when(k % 29 == 5, F.lit("ZZZ:100"))
        .when(k % 23 == 6, F.concat(F.lit("T"), k % 20, F.lit(":90")))
        .when(k % 19 == 7, F.lit("T1:50,T1:50"))
        .when(k % 17 == 8, F.lit("T1:0,T2:100"))
        .otherwise(two)
    )
    end = (
        F.when(k % 31 == 9, datetime.date(1995, 12, 31))
        .when(k % 13 == 4, datetime.date(2001, 10, 31))
        .when(k % 37 == 11, datetime.date(2002, 1, 31))
        .otherwise(F.lit(datetime.date(1998, 12, 31)))
    )
    return fixtures.read(spark, sf, "supplier").select(
        k.alias(R),
        (k - k % 2).alias("account_id"),
        F.date_add(F.lit(datetime.date(1996, 1, 10)), (k % 28).cast("int")).alias("start_date"),
        end.alias("end_date"),
        (1000.0 * (1 + k % 5)).alias("monthly_amount"),
        text.alias("text"),
    )


@fixtures.shared
def parsed_requests(spark, sf):
    df = request_texts(spark, sf).withColumn("allocations", backtest.parse_allocations(F.col("text")))
    issue = backtest.request_issue(F.col("allocations"), F.col("start_date"), F.col("end_date"), F.col("monthly_amount"))
    return df.withColumn("request_issue", issue)


def requests(spark, sf):
    return parsed_requests(spark, sf).where("request_issue is null").drop("text", "request_issue")


@fixtures.shared
def prices(spark, sf):
    return market.strategy_prices(fixtures.bars(spark, sf))


@fixtures.shared
def calendar(spark, sf):
    return backtest.market_calendar(requests(spark, sf), prices(spark, sf))


@fixtures.shared
def closed(spark, sf):
    return backtest.market_issues(requests(spark, sf), prices(spark, sf), calendar(spark, sf), market.MAX_GAP_DAYS)


def open_requests(spark, sf):
    return requests(spark, sf).join(closed(spark, sf).select(R).distinct(), R, "left_anti")


def open_calendar(spark, sf):
    return calendar(spark, sf).join(open_requests(spark, sf).select(R), R, "left_semi")


view(
    "b_requests",
    """SELECT *, CASE WHEN k % 17 = 8 AND NOT (k % 29 = 5 OR k % 23 = 6 OR k % 19 = 7) THEN 'INVALID_ALLOCATIONS' WHEN k % 31 = 9 THEN 'END_BEFORE_START' WHEN k % 29 = 5 THEN NULL WHEN k % 23 = 6 THEN 'WEIGHTS_NOT_ONE' WHEN k % 19 = 7 THEN 'DUPLICATE_TICKER' END AS request_issue,
CASE WHEN k % 29 = 5 THEN 'ZZZ' ELSE 'T' || (k % 20) END AS t1, 'T' || ((k + 7) % 20) AS t2 FROM (SELECT s_suppkey AS request_id, s_suppkey AS k, s_suppkey - s_suppkey % 2 AS account_id, DATE '1996-01-10' + CAST(s_suppkey % 28 AS INTEGER) AS start_date,
CASE WHEN s_suppkey % 31 = 9 THEN DATE '1995-12-31' WHEN s_suppkey % 13 = 4 THEN DATE '2001-10-31' WHEN s_suppkey % 37 = 11 THEN DATE '2002-01-31' ELSE DATE '1998-12-31' END AS end_date, 1000e0 * (1 + s_suppkey % 5) AS monthly_amount FROM supplier)""",
)
view("b_ok", "SELECT * FROM b_requests WHERE request_issue IS NULL")
view("b_prices", "SELECT ticker, date, price_twd FROM v_strategy_prices WHERE price_twd IS NOT NULL")
view(
    "b_calendar",
    """SELECT r.request_id, r.start_date, r.end_date, a.date, a.price_twd AS p1, b.price_twd AS p2 FROM b_ok r JOIN b_prices a ON a.ticker = r.t1 AND a.date BETWEEN r.start_date AND r.end_date JOIN b_prices b ON b.ticker = r.t2 AND b.date = a.date""",
)
view(
    "b_bars",
    """SELECT r.request_id, r.ticker, r.start_date, r.end_date, p.date, p.issue_code FROM (SELECT *, t1 AS ticker FROM b_ok UNION ALL SELECT *, t2 FROM b_ok WHERE t1 <> 'ZZZ') r
JOIN v_strategy_prices p ON p.ticker = r.ticker AND p.date BETWEEN r.start_date AND r.end_date""",
)


def _gapped(rows: str, key: str, word: str) -> str:
    return f"""SELECT request_id, CASE WHEN min(date) - min(start_date) > 14 OR min(end_date) - max(date) > 14 THEN 'TRUNCATED_{word}HISTORY' WHEN max(gap) > 14 THEN 'GAPPED_{word}HISTORY' END AS issue_code
FROM (SELECT *, date - lag(date) OVER (PARTITION BY {key} ORDER BY date) AS gap FROM {rows}) GROUP BY {key}"""


view(
    "b_broken",
    f"""SELECT DISTINCT request_id, issue_code FROM (SELECT request_id, 'MISSING_PRICE_SERIES' AS issue_code FROM b_ok WHERE t1 = 'ZZZ'
UNION ALL SELECT request_id, issue_code FROM b_bars UNION ALL {_gapped('b_bars', 'request_id, ticker', '')}) WHERE issue_code IS NOT NULL""",
)
view("b_whole", "SELECT * FROM b_ok WHERE request_id NOT IN (SELECT request_id FROM b_broken)")
view(
    "b_closed",
    f"""SELECT request_id, issue_code FROM b_broken UNION ALL SELECT request_id, 'NO_COMMON_TRADING_DATE' FROM b_whole WHERE request_id NOT IN (SELECT request_id FROM b_calendar)
UNION ALL SELECT request_id, issue_code FROM ({_gapped('b_calendar', 'request_id', 'COMMON_')}) WHERE issue_code IS NOT NULL AND request_id IN (SELECT request_id FROM b_whole)""",
)
view("b_open", "SELECT * FROM b_ok WHERE request_id NOT IN (SELECT request_id FROM b_closed)")
view("b_cal", "SELECT request_id, date, p1, p2 FROM b_calendar WHERE request_id IN (SELECT request_id FROM b_open)")
view(
    "b_dca",
    """SELECT request_id, requested_date, min(date) AS execution_date, min(monthly_amount) AS amount_twd FROM (
SELECT r.request_id, r.monthly_amount, s.requested_date, c.date FROM (SELECT request_id, monthly_amount, end_date, CAST(start_date + to_months(CAST(unnest(range(120)) AS INTEGER)) AS DATE) AS requested_date FROM b_open) s
JOIN b_open r ON r.request_id = s.request_id JOIN b_cal c ON c.request_id = s.request_id AND c.date >= s.requested_date WHERE s.requested_date <= s.end_date) GROUP BY request_id, requested_date""",
)
view(
    "b_planned",
    """SELECT request_id, 'DCA' AS mode, execution_date AS date, amount_twd FROM b_dca
UNION ALL SELECT d.request_id, 'LUMP_SUM', c.first, d.total FROM (SELECT request_id, count(*) * min(amount_twd) AS total FROM b_dca GROUP BY ALL) d JOIN (SELECT request_id, min(date) AS first FROM b_cal GROUP BY ALL) c USING (request_id)""",
)
view(
    "b_units",
    """SELECT f.request_id, f.mode, c.date, c.p1, c.p2, sum(coalesce(d.a, 0e0) * 6e-1 / c.p1) OVER w AS u1, sum(coalesce(d.a, 0e0) * 4e-1 / c.p2) OVER w AS u2 FROM (SELECT request_id, mode, min(date) AS first FROM b_planned GROUP BY ALL) f
JOIN b_cal c ON c.request_id = f.request_id AND c.date >= f.first LEFT JOIN (SELECT request_id, mode, date, sum(amount_twd) AS a FROM b_planned GROUP BY ALL) d ON d.request_id = f.request_id AND d.mode = f.mode AND d.date = c.date
WINDOW w AS (PARTITION BY f.request_id, f.mode ORDER BY c.date)""",
)
view(
    "b_trades",
    """SELECT r.request_id, t.trade_date AS requested_date, CASE WHEN t.quantity > 0 THEN 'CONTRIBUTION' ELSE 'WITHDRAWAL' END AS kind, (t.amount_foreign + CASE WHEN t.quantity > 0 THEN t.fee ELSE -t.fee END) * t.fx_rate AS amount_twd, t.source_row_number
FROM b_open r JOIN v_tx_clean t ON t.account_id = r.account_id AND t.transaction_type = 'SECURITY' AND t.trade_date BETWEEN r.start_date AND r.end_date""",
)
view(
    "b_late",
    "SELECT DISTINCT t.request_id FROM b_trades t JOIN (SELECT request_id, max(date) AS last FROM b_cal GROUP BY ALL) c USING (request_id) WHERE t.requested_date > c.last",
)
view(
    "b_events",
    """SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY date, o) AS k FROM (
SELECT request_id, date, p1, p2, 0 AS o, 'OPEN' AS kind, 0e0 AS amount_twd FROM b_cal WHERE request_id NOT IN (SELECT request_id FROM b_late)
UNION ALL SELECT t.request_id, c.date, c.p1, c.p2, t.source_row_number, t.kind, t.amount_twd FROM b_trades t ASOF JOIN b_cal c ON c.request_id = t.request_id AND c.date >= t.requested_date WHERE t.request_id NOT IN (SELECT request_id FROM b_late))""",
)
view(
    "b_replay",
    """SELECT request_id, CAST(0 AS BIGINT) AS k, 0e0 AS u1, 0e0 AS u2, 0e0 AS before, 0e0 AS after, CAST(NULL AS VARCHAR) AS issue FROM b_events WHERE k = 1
UNION ALL SELECT request_id, k, CASE WHEN bad THEN u1 WHEN kind = 'CONTRIBUTION' THEN u1 + amount_twd * 6e-1 / p1 WHEN kind = 'WITHDRAWAL' AND v > 1e-9 THEN greatest(0e0, u1 - amount_twd * (u1 * p1 / v) / p1) ELSE u1 END,
  CASE WHEN bad THEN u2 WHEN kind = 'CONTRIBUTION' THEN u2 + amount_twd * 4e-1 / p2 WHEN kind = 'WITHDRAWAL' AND v > 1e-9 THEN greatest(0e0, u2 - amount_twd * (u2 * p2 / v) / p2) ELSE u2 END,
  v, v + CASE WHEN bad OR kind = 'OPEN' THEN 0e0 WHEN kind = 'CONTRIBUTION' THEN amount_twd ELSE -amount_twd END, CASE WHEN bad THEN 'REPLAY_WITHDRAWAL_EXCEEDS_VALUE' END
FROM (SELECT e.request_id, e.k, e.kind, e.amount_twd, e.p1, e.p2, f.u1, f.u2, f.u1 * e.p1 + f.u2 * e.p2 AS v, e.kind = 'WITHDRAWAL' AND f.u1 * e.p1 + f.u2 * e.p2 + 1e-9 < e.amount_twd AS bad
  FROM b_replay f JOIN b_events e ON e.request_id = f.request_id AND e.k = f.k + 1 WHERE f.issue IS NULL)""",
)
view(
    "b_values",
    """SELECT request_id, mode, date, coalesce(lag(u1) OVER w * p1 + lag(u2) OVER w * p2, 0e0) AS before, u1 * p1 + u2 * p2 AS after FROM b_units WINDOW w AS (PARTITION BY request_id, mode ORDER BY date)
UNION ALL SELECT r.request_id, 'TRANSACTION_REPLAY', e.date, arg_min(r.before, r.k), arg_max(r.after, r.k) FROM b_replay r JOIN b_events e ON e.request_id = r.request_id AND e.k = r.k
JOIN (SELECT request_id, min(date) AS first FROM b_events WHERE kind <> 'OPEN' GROUP BY ALL) f ON f.request_id = r.request_id AND e.date >= f.first WHERE r.request_id NOT IN (SELECT request_id FROM b_replay WHERE issue IS NOT NULL) GROUP BY r.request_id, e.date""",
)
view(
    "b_curve",
    """SELECT *, greatest(1e0, max(growth_index) OVER (PARTITION BY request_id, mode ORDER BY date)) AS running_peak FROM (
SELECT *, product(CASE WHEN prev > 1e-9 THEN before / prev ELSE 1e0 END) OVER (PARTITION BY request_id, mode ORDER BY date) AS growth_index FROM (
SELECT *, lag(after) OVER (PARTITION BY request_id, mode ORDER BY date) AS prev FROM b_values))""",
)
view("b_dead", "SELECT DISTINCT request_id, mode FROM (SELECT *, lag(after) OVER (PARTITION BY request_id, mode ORDER BY date) AS prev FROM b_values) WHERE prev > 1e-9 AND before / prev <= 0")

_books = {}


def request_book(spark, sf):
    """The clean book with its requests; kept, so that all queries over it share one comparison."""
    key = fixtures.key_of("requests", spark, sf)
    if key not in _books:
        _books[key] = replace(book(spark, sf, clean=True), requests=requests(spark, sf), prices=prices(spark, sf))
    return _books[key]


def _compare(spark, sf):
    return request_book(spark, sf).comparison


@query(
    "strategy_requests",
    "SELECT request_id, request_issue, CASE WHEN request_issue = 'INVALID_ALLOCATIONS' THEN -1 WHEN k % 29 = 5 OR k % 23 = 6 THEN 1 ELSE 2 END AS legs FROM b_requests",
)
def _(spark, sf):
    return parsed_requests(spark, sf).select(R, "request_issue", F.coalesce(F.size("allocations"), F.lit(-1)).alias("legs"))


@query("strategy_calendar", f"SELECT request_id, date, 6e-1 AS weight_1, 4e-1 AS weight_2, {sql_round(3, 'p1')} AS price_1, {sql_round(3, 'p2')} AS price_2 FROM b_calendar")
def _(spark, sf):
    days = calendar(spark, sf).withColumns({f"price_{i}": F.col("prices")[i - 1] for i in (1, 2)})
    weights = [F.col("weights")[i - 1].alias(f"weight_{i}") for i in (1, 2)]
    return days.select(R, "date", *weights, *rounded(3, "price_1", "price_2"))


@query(
    "strategy_market_issues",
    "SELECT request_id, issue_code FROM b_closed",
)
def _(spark, sf):
    return closed(spark, sf)


@query("dca_schedule", f"SELECT request_id, requested_date, execution_date, {sql_rounded(2, 'amount_twd')} FROM b_dca")
def _(spark, sf):
    flows = backtest.dca_flows(open_requests(spark, sf), open_calendar(spark, sf))
    return flows.select(R, "requested_date", "execution_date", *rounded(2, "amount_twd"))


@query(
    "lump_sum_flow",
    f"SELECT request_id, date AS execution_date, {sql_rounded(2, 'amount_twd')} FROM b_planned WHERE mode = 'LUMP_SUM'",
)
def _(spark, sf):
    asked, days = open_requests(spark, sf), open_calendar(spark, sf)
    flows = backtest.lump_flows(backtest.dca_flows(asked, days), asked, days)
    return flows.select(R, "execution_date", *rounded(2, "amount_twd"))


@query(
    "replay_flows",
    f"""SELECT r.request_id, t.trade_date AS requested_date, CASE WHEN t.quantity > 0 THEN 'CONTRIBUTION' ELSE 'WITHDRAWAL' END AS kind, t.source_row_number,
{sql_rounded(2, '(t.amount_foreign + CASE WHEN t.quantity > 0 THEN t.fee ELSE -t.fee END) * t.fx_rate').rsplit(' AS ', 1)[0]} AS amount_twd, CASE WHEN t.fx_rate IS NULL THEN 'MISSING_REPLAY_FX' END AS issue_code
FROM b_ok r JOIN v_tx t ON t.account_id = r.account_id AND t.transaction_type = 'SECURITY' AND t.trade_date BETWEEN r.start_date AND r.end_date""",
)
def _(spark, sf):
    return backtest.replay_flows(requests(spark, sf), fixtures.tx(spark, sf)).select(
        R, "requested_date", "kind", "source_row_number", *rounded(2, "amount_twd"), "issue_code"
    )


@query(
    "replay_issues",
    """SELECT r.request_id, 'MISSING_REPLAY_FX' AS issue_code, count(*) AS rows FROM b_ok r JOIN v_tx t ON t.account_id = r.account_id AND t.transaction_type = 'SECURITY' AND t.trade_date BETWEEN r.start_date AND r.end_date AND t.fx_rate IS NULL GROUP BY ALL
UNION ALL SELECT request_id, 'NO_REPLAY_TRANSACTIONS', 1 FROM b_ok r WHERE NOT EXISTS (SELECT 1 FROM v_tx t WHERE t.account_id = r.account_id AND t.transaction_type = 'SECURITY' AND t.trade_date BETWEEN r.start_date AND r.end_date)""",
)
def _(spark, sf):
    asked, tx = requests(spark, sf), fixtures.tx(spark, sf)
    issues = backtest.replay_issues(asked, backtest.replay_flows(asked, tx), tx)
    return issues.groupBy(R, "issue_code").agg(F.count("*").alias("rows"))


@query(
    "strategy_curves",
    f"""SELECT request_id, mode, date, round(after + 1.73e-3, 1) AS total_assets_twd, {sql_rounded(6, 'growth_index')}, {sql_rounded(6, 'growth_index / running_peak - 1').rsplit(' AS ', 1)[0]} AS drawdown
FROM b_curve WHERE (request_id, mode) NOT IN (SELECT (request_id, mode) FROM b_dead)""",
)
def _(spark, sf):
    _summary, curve = _compare(spark, sf)
    return curve.select(R, "mode", "date", *rounded(1, "total_assets_twd"), *rounded(6, "growth_index", "drawdown"))


view(
    "b_exec",
    """SELECT request_id, mode, date, 'CONTRIBUTION' AS kind, amount_twd FROM b_planned
UNION ALL SELECT e.request_id, 'TRANSACTION_REPLAY', e.date, e.kind, e.amount_twd FROM b_events e WHERE e.kind <> 'OPEN' AND e.request_id NOT IN (SELECT request_id FROM b_replay WHERE issue IS NOT NULL)""",
)
view(
    "b_runs",
    """SELECT r.request_id, m.mode, CASE WHEN k.codes IS NOT NULL THEN k.codes WHEN d.request_id IS NOT NULL THEN 'INVALID_UNITIZED_RETURN' WHEN m.mode = 'TRANSACTION_REPLAY' AND r.request_id IN (SELECT request_id FROM b_late) THEN 'REPLAY_EVENT_AFTER_LAST_MARKET_DATE'
WHEN m.mode = 'TRANSACTION_REPLAY' AND r.request_id IN (SELECT request_id FROM b_replay WHERE issue IS NOT NULL) THEN 'REPLAY_WITHDRAWAL_EXCEEDS_VALUE' END AS blocking
FROM b_ok r CROSS JOIN (SELECT unnest(['DCA', 'LUMP_SUM', 'TRANSACTION_REPLAY']) AS mode) m LEFT JOIN b_dead d ON d.request_id = r.request_id AND d.mode = m.mode
LEFT JOIN (SELECT request_id, string_agg(issue_code, ',' ORDER BY issue_code) AS codes FROM b_closed GROUP BY ALL) k ON k.request_id = r.request_id""",
)
view(
    "b_ends",
    """SELECT request_id, mode, min(date) AS start_date, max(date) AS end_date, arg_max(after, date) AS terminal, arg_max(growth_index, date) AS idx, min(growth_index / running_peak - 1) AS dd FROM b_curve GROUP BY ALL""",
)
view(
    "b_trough",
    "SELECT c.request_id, c.mode, min(c.date) AS low, arg_min(c.running_peak, c.date) AS peak FROM b_curve c JOIN b_ends e USING (request_id, mode) WHERE e.dd < 0 AND c.growth_index / c.running_peak - 1 = e.dd GROUP BY ALL",
)
view(
    "b_recovery",
    "SELECT c.request_id, c.mode, min(c.date) AS recovery_date FROM b_curve c JOIN b_trough t USING (request_id, mode) WHERE c.date > t.low AND c.growth_index + 1e-9 >= t.peak GROUP BY ALL",
)
view(
    "b_summary",
    """SELECT r.request_id, r.mode, r.blocking, y.recovery_date, e.start_date, e.end_date, x.paid, x.taken, x.n, e.terminal, e.idx, e.dd, e.end_date - e.start_date AS days FROM b_runs r LEFT JOIN b_ends e USING (request_id, mode) LEFT JOIN b_recovery y USING (request_id, mode)
LEFT JOIN (SELECT request_id, mode, sum(amount_twd) FILTER (kind = 'CONTRIBUTION') AS paid, coalesce(sum(amount_twd) FILTER (kind = 'WITHDRAWAL'), 0e0) AS taken, count(*) AS n FROM b_exec GROUP BY ALL) x USING (request_id, mode)""",
)
_S1 = ("gross_contributions_twd", "gross_withdrawals_twd", "terminal_value_twd", "estimated_gain_twd")
_S6 = ("money_multiple", "cumulative_twr", "annualized_twr", "maximum_drawdown")


view(
    "b_figures",
    """SELECT request_id, mode, CASE WHEN ok THEN start_date END AS start_date, CASE WHEN ok THEN end_date END AS end_date, CASE WHEN ok THEN recovery_date END AS recovery_date, CASE WHEN ok THEN n ELSE 0 END AS execution_count, coalesce(blocking, '') AS blocking_code,
CASE WHEN ok THEN paid ELSE 0e0 END AS gross_contributions_twd, CASE WHEN ok THEN taken ELSE 0e0 END AS gross_withdrawals_twd, CASE WHEN ok THEN terminal END AS terminal_value_twd, CASE WHEN ok THEN terminal + taken - paid END AS estimated_gain_twd,
CASE WHEN ok THEN (terminal + taken) / paid END AS money_multiple, CASE WHEN ok THEN idx - 1 END AS cumulative_twr, CASE WHEN ok THEN pow(idx, 365e0 / days) - 1 END AS annualized_twr, CASE WHEN ok THEN dd END AS maximum_drawdown
FROM (SELECT *, blocking IS NULL AS ok FROM b_summary)""",
)


@query(
    "strategy_summary",
    f"""SELECT request_id, mode, start_date, end_date, recovery_date, execution_count, blocking_code, {sql_rounded(0, *_S1)}, {sql_rounded(6, *_S6)} FROM b_figures""",
)
def _(spark, sf):
    summary, _curve = _compare(spark, sf)
    fields = [R, "mode", "start_date", "end_date", "recovery_date", "execution_count", blocking_code()]
    return summary.select(*fields, *rounded(0, *_S1), *rounded(6, *_S6))


def blocking_code():
    """The codes that block a run; codes of its end, such as a missing rate of return, leave its figures."""
    late = F.col("issue_codes").isin("XIRR_NOT_FOUND", "MULTIPLE_XIRR_ROOTS", "ZERO_TIME_SPAN", "NO_CONTRIBUTION")
    return F.when(late, "").otherwise(F.col("issue_codes")).alias("blocking_code")


_LO, _HI = "ln(1e-6)", "ln(1000001e0)"
view(
    "b_net",
    """SELECT request_id, mode, date, sum(a) AS amount FROM (SELECT request_id, mode, date, CASE kind WHEN 'CONTRIBUTION' THEN -amount_twd ELSE amount_twd END AS a FROM b_exec UNION ALL SELECT request_id, mode, end_date, terminal FROM b_ends)
GROUP BY ALL HAVING abs(sum(a)) > 1e-9""",
)
view(
    "b_lists",
    "SELECT request_id, mode, list(amount) AS amounts, list(years) AS years FROM (SELECT *, (date - min(date) OVER (PARTITION BY request_id, mode)) / 365e0 AS years FROM b_net) GROUP BY request_id, mode HAVING count(*) >= 2",
)


def _npv(rate: str) -> str:
    return f"list_sum(list_transform(range(1, len(amounts) + 1), lambda j: amounts[j] * exp(-years[j] * ({rate}))))"


view(
    "b_grid",
    f"SELECT request_id, mode, amounts, years, i, {_LO} + ({_HI} - {_LO}) * i / 1600 AS x, {_npv(f'{_LO} + ({_HI} - {_LO}) * i / 1600')} AS v FROM b_lists, (SELECT unnest(range(1601)) AS i)",
)
view(
    "b_cells",
    """SELECT request_id, mode, amounts, years, x AS lo, nx AS hi, v AS vlo FROM (SELECT *, lead(x) OVER w AS nx, lead(v) OVER w AS nv FROM b_grid WINDOW w AS (PARTITION BY request_id, mode ORDER BY i)) WHERE (v < 0 AND nv > 0) OR (v > 0 AND nv < 0)""",
)
view(
    "b_bisect",
    f"""SELECT request_id, mode, amounts, years, lo, hi, vlo, 0 AS n FROM b_cells
UNION ALL SELECT request_id, mode, amounts, years, CASE WHEN (vlo < 0) <> (m < 0) THEN lo ELSE (lo + hi) / 2 END, CASE WHEN (vlo < 0) <> (m < 0) THEN (lo + hi) / 2 ELSE hi END, CASE WHEN (vlo < 0) <> (m < 0) THEN vlo ELSE m END, n + 1
FROM (SELECT *, {_npv('(lo + hi) / 2')} AS m FROM b_bisect WHERE n < 50)""",
)


view(
    "b_rates",
    """SELECT r.request_id, r.mode, CASE WHEN r.blocking IS NULL THEN x.xirr END AS xirr, CASE WHEN r.blocking IS NULL AND x.xirr IS NOT NULL THEN 'ESTIMATED' ELSE 'INCOMPLETE' END AS status
FROM b_runs r LEFT JOIN (SELECT request_id, mode, CASE WHEN count(*) = 1 THEN min(exp((lo + hi) / 2) - 1) END AS xirr FROM b_bisect WHERE n = 50 GROUP BY ALL) x USING (request_id, mode)""",
)
view("b_results", "SELECT f.*, r.xirr, r.status, b.account_id FROM b_figures f JOIN b_rates r USING (request_id, mode) JOIN b_ok b USING (request_id)")


@query("strategy_xirr", f"SELECT request_id, mode, {sql_rounded(6, 'xirr')}, status FROM b_rates")
def _(spark, sf):
    summary, _curve = _compare(spark, sf)
    return summary.select(R, "mode", *rounded(6, "xirr"), "status")
