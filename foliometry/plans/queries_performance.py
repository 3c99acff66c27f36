"""NAV history, time-weighted return, drawdown, cash flows and XIRR."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliometry.operators import flows, nav, returns
from foliometry.operators.xirr import xirr
from foliometry.plans import fixtures
from foliometry.plans.catalog import query, rounded, sql_round, sql_rounded
from foliometry.plans.oracle_views import view
from foliometry.plans.account import book

P = "account_id"


def _nav_views(suffix: str, tx: str, snapshot: str) -> None:
    view(
        f"v_span{suffix}",
        f"""SELECT account_id, CAST({snapshot} AS BIGINT) AS snapshot_id, min(trade_date) AS first_date, DATE '2001-06-30' AS valuation_date FROM {tx} GROUP BY account_id""",
    )
    view(
        f"v_nav_dates{suffix}",
        f"""
SELECT account_id, first_date AS as_of FROM v_span{suffix} WHERE first_date <= valuation_date
UNION SELECT account_id, valuation_date FROM v_span{suffix} WHERE first_date <= valuation_date
UNION SELECT s.account_id, m.mark_date FROM v_span{suffix} s JOIN (SELECT DISTINCT snapshot_id, mark_date FROM v_marks) m ON m.snapshot_id = s.snapshot_id AND m.mark_date BETWEEN s.first_date AND s.valuation_date
UNION SELECT s.account_id, t.trade_date FROM v_span{suffix} s JOIN {tx} t ON t.account_id = s.account_id AND t.transaction_type IN ('CASH_IN', 'CASH_OUT') AND t.trade_date BETWEEN s.first_date AND s.valuation_date""",
    )
    view(
        f"v_price_marks{suffix}",
        "SELECT snapshot_id, ticker, currency, mark_date, value, conflict FROM v_daily_marks WHERE mark_type = 'PRICE'",
    )
    view(
        f"v_fx_marks{suffix}",
        "SELECT snapshot_id, currency, mark_date, value, conflict FROM v_daily_marks WHERE mark_type = 'FX'",
    )
    view(
        f"v_held{suffix}",
        f"""
SELECT d.account_id, s.snapshot_id, d.as_of, k.ticker, k.currency, st.quantity_after AS quantity
FROM v_nav_dates{suffix} d JOIN v_span{suffix} s ON s.account_id = d.account_id
JOIN (SELECT account_id, ticker, currency, min(trade_date) AS first_day FROM pos_rows{suffix} GROUP BY ALL) k ON k.account_id = d.account_id AND d.as_of >= k.first_day
ASOF JOIN (SELECT account_id, ticker, trade_date, arg_max(quantity_after, k) AS quantity_after FROM pos_rows{suffix} GROUP BY account_id, ticker, trade_date) st
ON st.account_id = d.account_id AND st.ticker = k.ticker AND d.as_of >= st.trade_date""",
    )
    view(
        f"v_money{suffix}",
        f"""
SELECT d.account_id, s.snapshot_id, d.as_of, k.currency, st.balance_after AS balance
FROM v_nav_dates{suffix} d JOIN v_span{suffix} s ON s.account_id = d.account_id
JOIN (SELECT account_id, currency, min(trade_date) AS first_day FROM cash_rows{suffix} GROUP BY ALL) k ON k.account_id = d.account_id AND d.as_of >= k.first_day
JOIN (SELECT account_id, min(trade_date) AS tracked_from FROM {tx} WHERE transaction_type <> 'SECURITY' GROUP BY ALL) t ON t.account_id = d.account_id AND d.as_of >= t.tracked_from
ASOF JOIN (SELECT account_id, currency, trade_date, arg_max(balance_after, k) AS balance_after FROM cash_rows{suffix} GROUP BY account_id, currency, trade_date) st
ON st.account_id = d.account_id AND st.currency = k.currency AND d.as_of >= st.trade_date""",
    )
    view(
        f"v_parts{suffix}",
        f"""
SELECT h.account_id, h.as_of, 'P' AS kind, h.quantity * p.value * CASE WHEN h.currency = 'TWD' THEN 1e0 ELSE f.value END AS twd,
  CASE WHEN p.value IS NOT NULL THEN p.mark_date END AS price_date,
  CASE WHEN h.currency = 'TWD' THEN h.as_of WHEN f.value IS NOT NULL THEN f.mark_date END AS fx_date,
  (p.value IS NULL)::INT + (h.currency <> 'TWD' AND f.value IS NULL)::INT AS issues
FROM (SELECT * FROM v_held{suffix} WHERE quantity > 1e-9) h
ASOF LEFT JOIN v_price_marks{suffix} p ON p.snapshot_id = h.snapshot_id AND p.ticker = h.ticker AND p.currency = h.currency AND h.as_of >= p.mark_date
ASOF LEFT JOIN v_fx_marks{suffix} f ON f.snapshot_id = h.snapshot_id AND f.currency = h.currency AND h.as_of >= f.mark_date
UNION ALL
SELECT m.account_id, m.as_of, 'C', CASE WHEN m.currency = 'TWD' THEN m.balance ELSE coalesce(m.balance * f.value, CASE WHEN abs(m.balance) <= 1e-9 THEN 0e0 END) END, NULL,
  CASE WHEN m.currency = 'TWD' THEN m.as_of WHEN f.value IS NOT NULL THEN f.mark_date END, (m.currency <> 'TWD' AND f.value IS NULL AND abs(m.balance) > 1e-9)::INT
FROM v_money{suffix} m
ASOF LEFT JOIN v_fx_marks{suffix} f ON f.snapshot_id = m.snapshot_id AND f.currency = m.currency AND m.as_of >= f.mark_date""",
    )
    # every key's newest mark per snapshot and date; a conflict there blocks all accounts of the snapshot
    view(
        f"v_conflicts{suffix}",
        f"""
SELECT w.snapshot_id, w.as_of, count(*) FILTER (m.conflict) AS n FROM (SELECT DISTINCT s.snapshot_id, d.as_of FROM v_nav_dates{suffix} d JOIN v_span{suffix} s USING (account_id)) w
JOIN (SELECT DISTINCT snapshot_id, mark_type, ticker, currency FROM v_daily_marks) k ON k.snapshot_id = w.snapshot_id
ASOF JOIN v_daily_marks m ON m.snapshot_id = w.snapshot_id AND m.mark_type = k.mark_type AND m.ticker = k.ticker AND m.currency = k.currency AND w.as_of >= m.mark_date
GROUP BY w.snapshot_id, w.as_of""",
    )
    # a row's issues on a date: re-derived per date as security, else cash when tracked, else cost
    view(
        f"v_issue_dates{suffix}",
        f"""
SELECT account_id, source_row_number, issue_code, min(trade_date) AS day FROM (
  SELECT account_id, source_row_number, issue_code, trade_date FROM pos_all{suffix} WHERE issue_code IS NOT NULL
  UNION ALL SELECT account_id, source_row_number, issue_code, trade_date FROM fx_rows{suffix} WHERE issue_code IS NOT NULL
  UNION ALL SELECT c.account_id, c.source_row_number, c.issue_code, greatest(c.trade_date, t.tracked_from) FROM cash_rows{suffix} c
    JOIN (SELECT account_id, min(trade_date) AS tracked_from FROM {tx} WHERE transaction_type <> 'SECURITY' GROUP BY ALL) t ON t.account_id = c.account_id WHERE c.issue_code IS NOT NULL)
GROUP BY account_id, source_row_number, issue_code""",
    )
    view(
        f"v_flow_days{suffix}",
        f"""
SELECT account_id, trade_date AS as_of, sum(CASE WHEN transaction_type = 'CASH_IN' THEN amount_foreign * fx_rate ELSE 0e0 END) AS contribution_twd,
  sum(CASE WHEN transaction_type = 'CASH_OUT' THEN amount_foreign * fx_rate ELSE 0e0 END) AS withdrawal_twd, count(*) FILTER (fx_rate IS NULL) AS missing
FROM {tx} WHERE transaction_type IN ('CASH_IN', 'CASH_OUT') GROUP BY ALL""",
    )
    view(
        f"v_nav{suffix}",
        f"""
SELECT d.account_id, d.as_of, coalesce(n.n, 0) AS transaction_count, coalesce(f.contribution_twd, 0e0) AS contribution_twd, coalesce(f.withdrawal_twd, 0e0) AS withdrawal_twd,
  coalesce(p.pv, 0e0) AS position_value_twd, coalesce(p.cv, 0e0) AS cash_value_twd, coalesce(p.pv, 0e0) + coalesce(p.cv, 0e0) AS known_total_assets_twd,
  p.latest_price_date_used, p.latest_fx_date_used, coalesce(p.issues, 0) + coalesce(c.n, 0) + coalesce(i.n, 0) + coalesce(f.missing, 0) AS blocking_issue_count
FROM v_nav_dates{suffix} d JOIN v_span{suffix} s ON s.account_id = d.account_id
LEFT JOIN (SELECT account_id, as_of, sum(twd) FILTER (kind = 'P') AS pv, sum(twd) FILTER (kind = 'C') AS cv, max(price_date) AS latest_price_date_used, max(fx_date) AS latest_fx_date_used, sum(issues) AS issues
  FROM v_parts{suffix} GROUP BY ALL) p ON p.account_id = d.account_id AND p.as_of = d.as_of
LEFT JOIN v_conflicts{suffix} c ON c.snapshot_id = s.snapshot_id AND c.as_of = d.as_of
LEFT JOIN v_flow_days{suffix} f ON f.account_id = d.account_id AND f.as_of = d.as_of
ASOF LEFT JOIN (SELECT account_id, trade_date, sum(count(*)) OVER (PARTITION BY account_id ORDER BY trade_date) AS n FROM {tx} GROUP BY account_id, trade_date) n ON n.account_id = d.account_id AND d.as_of >= n.trade_date
ASOF LEFT JOIN (SELECT account_id, day, sum(count(*)) OVER (PARTITION BY account_id ORDER BY day) AS n FROM v_issue_dates{suffix} GROUP BY account_id, day) i ON i.account_id = d.account_id AND d.as_of >= i.day""",
    )


_nav_views("", "v_tx", "account_id % 4 = 3")
_nav_views("_clean", "v_tx_clean", "0")

_NAV = ("contribution_twd", "withdrawal_twd", "position_value_twd", "cash_value_twd", "known_total_assets_twd")


def _nav_sql(suffix: str) -> str:
    return f"""SELECT account_id, as_of, blocking_issue_count = 0 AS complete, CAST(transaction_count AS BIGINT) AS transaction_count, {sql_rounded(0, *_NAV)},
CASE WHEN blocking_issue_count = 0 THEN {sql_round(0, "known_total_assets_twd")} END AS total_assets_twd, latest_price_date_used, latest_fx_date_used,
CAST(blocking_issue_count AS BIGINT) AS blocking_issue_count FROM v_nav{suffix}"""


def _nav(df):
    amounts = (*_NAV, "total_assets_twd")
    return df.select(*[c for c in df.columns if c not in amounts], *rounded(0, *amounts))


@query("nav_dates", "SELECT account_id, as_of FROM v_nav_dates")
def _(spark, sf):
    return book(spark, sf).nav_dates


@query("nav_series", _nav_sql("_clean"))
def _(spark, sf):
    return _nav(book(spark, sf, clean=True).nav_points)


@query("nav_series_blocked", _nav_sql(""))
def _(spark, sf):
    return _nav(book(spark, sf).nav_points)


@query(
    "external_flow_days",
    f"SELECT account_id, as_of, {sql_rounded(2, 'contribution_twd', 'withdrawal_twd')}, missing AS missing_flow_fx FROM v_flow_days",
)
def _(spark, sf):
    return nav.external_flows(fixtures.tx(spark, sf)).select(
        P, "as_of", *rounded(2, "contribution_twd", "withdrawal_twd"), "missing_flow_fx"
    )


view(
    "v_requested",
    """SELECT DISTINCT l_suppkey AS account_id, CASE WHEN l_linenumber = 3 THEN '1997-02-30' WHEN l_linenumber = 4 THEN ' ' || strftime(last_day(CAST(l_shipdate AS DATE)), '%Y-%m-%d')
ELSE strftime(last_day(CAST(l_shipdate AS DATE)), '%Y-%m-%d') END AS date_text FROM lineitem""",
)


view(
    "v_asked",
    "SELECT DISTINCT account_id, try_cast(trim(date_text) AS DATE) AS as_of FROM v_requested WHERE try_cast(trim(date_text) AS DATE) IS NOT NULL",
)


def _requested(spark, sf):
    day = F.date_format(F.last_day(F.to_date("l_shipdate")), "yyyy-MM-dd")
    text = F.when(F.col("l_linenumber") == 3, "1997-02-30").when(F.col("l_linenumber") == 4, F.concat(F.lit(" "), day)).otherwise(day)
    return fixtures.read(spark, sf, "lineitem").select(F.col("l_suppkey").alias(P), text.alias("date_text")).distinct()


@query(
    "nav_requested_dates",
    """SELECT DISTINCT account_id, try_cast(trim(date_text) AS DATE) AS as_of, CASE WHEN try_cast(trim(date_text) AS DATE) IS NULL THEN 'INVALID_AS_OF_DATE' END AS issue_code FROM v_requested""",
)
def _(spark, sf):
    valid, bad = nav.requested_dates(_requested(spark, sf))
    return valid.withColumn("issue_code", F.lit(None).cast("string")).unionByName(
        bad.select(P, F.lit(None).cast("date").alias("as_of"), "issue_code").distinct()
    )


@query(
    "observation_dates",
    """SELECT * FROM v_asked UNION SELECT t.account_id, t.trade_date FROM (SELECT account_id, min(as_of) AS lo, max(as_of) AS hi FROM v_asked GROUP BY ALL) a
JOIN v_tx t ON t.account_id = a.account_id AND t.transaction_type IN ('CASH_IN', 'CASH_OUT') AND t.trade_date BETWEEN a.lo AND a.hi""",
)
def _(spark, sf):
    valid, _bad = nav.requested_dates(_requested(spark, sf))
    return nav.observation_dates(valid, fixtures.tx(spark, sf))


for _name, _cut in {
    "1M": "date_trunc('month', e) - INTERVAL 1 MONTH + (day(e) - 1) * INTERVAL 1 DAY",
    "3M": "date_trunc('month', e) - INTERVAL 3 MONTH + (day(e) - 1) * INTERVAL 1 DAY",
    "YTD": "date_trunc('year', e)",
    "1Y": "date_trunc('month', e) - INTERVAL 12 MONTH + (day(e) - 1) * INTERVAL 1 DAY",
}.items():

    @query(
        f"chart_range_{_name.lower()}",
        f"""SELECT v.account_id, v.as_of, {sql_round(1, "v.known_total_assets_twd")} AS total_assets_twd FROM v_nav_clean v
JOIN (SELECT account_id, max(as_of) AS e FROM v_nav_clean WHERE blocking_issue_count = 0 GROUP BY account_id) r ON r.account_id = v.account_id
WHERE v.blocking_issue_count = 0 AND v.as_of >= CAST({_cut} AS DATE)""",
    )
    def _(spark, sf, _name=_name):
        points = nav.chart_range(book(spark, sf, clean=True).nav_points, _name)
        return points.select(P, "as_of", *rounded(1, "total_assets_twd"))


view(
    "v_twr_in",
    """SELECT *, lag(known_total_assets_twd) OVER (PARTITION BY account_id ORDER BY as_of) AS prev, count(*) OVER (PARTITION BY account_id) AS n,
count(*) FILTER (blocking_issue_count > 0) OVER (PARTITION BY account_id) AS bad FROM v_nav_clean""",
)
view(
    "v_twr_step",
    """SELECT account_id, as_of, contribution_twd, withdrawal_twd, known_total_assets_twd,
CASE WHEN prev IS NULL THEN 1e0 ELSE greatest(0e0, (known_total_assets_twd + withdrawal_twd) / (prev + contribution_twd)) END AS factor,
(known_total_assets_twd + withdrawal_twd) / (prev + contribution_twd) - 1 AS period_return FROM v_twr_in WHERE n >= 2 AND bad = 0""",
)
view(
    "v_twr",
    """SELECT *, max(growth_index) OVER (PARTITION BY account_id ORDER BY as_of) AS running_peak_index, growth_index / max(growth_index) OVER (PARTITION BY account_id ORDER BY as_of) - 1 AS drawdown
FROM (SELECT *, product(factor) OVER (PARTITION BY account_id ORDER BY as_of) AS growth_index FROM v_twr_step)""",
)
_TWR = ("period_return", "growth_index", "running_peak_index", "drawdown")


@query(
    "twr_points",
    f"""SELECT account_id, as_of AS date, {sql_rounded(7, *_TWR)}, {sql_round(7, 'growth_index - 1')} AS cumulative_twr FROM v_twr""",
)
def _(spark, sf):
    return returns.twr_points(book(spark, sf, clean=True).observations).select(P, "date", *rounded(7, *_TWR, "cumulative_twr"))


@query(
    "twr_issues",
    """SELECT account_id, issue_code, CAST(dates AS BIGINT) AS dates FROM (
SELECT account_id, 'INCOMPLETE_NAV_POINT' AS issue_code, count(*) FILTER (blocking_issue_count > 0) AS dates FROM v_nav GROUP BY account_id
UNION ALL SELECT account_id, 'INSUFFICIENT_OBSERVATIONS', CASE WHEN count(*) < 2 THEN count(*) ELSE 0 END FROM v_nav GROUP BY account_id
UNION ALL SELECT account_id, 'UNSUPPORTED_TOTAL_RETURN_COVERAGE', count(*) FROM v_nav GROUP BY account_id) WHERE dates > 0""",
)
def _(spark, sf):
    return returns.twr_issues(book(spark, sf).observations, coverage="PRICE_ONLY")


view(
    "v_trough",
    """SELECT t.account_id, min(t.as_of) AS trough_date, arg_min(t.drawdown, t.as_of) AS maximum_drawdown, arg_min(t.running_peak_index, t.as_of) AS peak_index
FROM v_twr t JOIN (SELECT account_id, min(drawdown) AS deepest FROM v_twr GROUP BY account_id) d ON d.account_id = t.account_id AND t.drawdown <= d.deepest + 1e-9 AND d.deepest < -1e-9
GROUP BY t.account_id""",
)
view(
    "v_drawdown",
    """
SELECT s.account_id, s.start_date, s.end_date, s.end_date - s.start_date AS day_count, s.last_index - 1 AS cumulative_twr, pow(s.last_index, 365e0 / (s.end_date - s.start_date)) - 1 AS annualized_twr,
  coalesce(t.maximum_drawdown, 0e0) AS maximum_drawdown, coalesce(p.peak_date, s.start_date) AS peak_date, coalesce(t.trough_date, s.start_date) AS trough_date,
  CASE WHEN t.account_id IS NULL THEN s.start_date ELSE p.recovery_date END AS recovery_date, s.current_drawdown, s.current_drawdown < -1e-9 AS currently_in_drawdown, s.current_peak_date
FROM (SELECT account_id, min(as_of) AS start_date, max(as_of) AS end_date, arg_max(growth_index, as_of) AS last_index, arg_max(drawdown, as_of) AS current_drawdown,
  max(as_of) FILTER (growth_index + 1e-9 >= running_peak_index) AS current_peak_date FROM v_twr GROUP BY account_id) s
LEFT JOIN v_trough t ON t.account_id = s.account_id
LEFT JOIN (SELECT v.account_id, min(v.as_of) FILTER (v.as_of <= t.trough_date AND v.growth_index >= t.peak_index - 1e-9) AS peak_date,
  min(v.as_of) FILTER (v.as_of > t.trough_date AND v.growth_index + 1e-9 >= t.peak_index) AS recovery_date FROM v_twr v JOIN v_trough t ON t.account_id = v.account_id GROUP BY v.account_id) p ON p.account_id = s.account_id""",
)
_RATIO = ("cumulative_twr", "annualized_twr", "maximum_drawdown", "current_drawdown")


@query(
    "drawdown_summary",
    f"""SELECT account_id, start_date, end_date, CAST(day_count AS INTEGER) AS day_count, {sql_rounded(7, *_RATIO)}, peak_date, trough_date, CAST(trough_date - peak_date AS INTEGER) AS decline_days, recovery_date,
CAST(recovery_date - trough_date AS INTEGER) AS recovery_days, CAST(coalesce(recovery_date, end_date) - peak_date AS INTEGER) AS underwater_days, currently_in_drawdown, current_peak_date,
CAST(CASE WHEN currently_in_drawdown THEN end_date - current_peak_date ELSE 0 END AS INTEGER) AS current_underwater_days, true AS complete FROM v_drawdown""",
)
def _(spark, sf):
    df = returns.drawdown_summary(book(spark, sf, clean=True).observations)
    return df.select(*[c for c in df.columns if c not in _RATIO], *rounded(7, *_RATIO))


@query(
    "drawdown_labels",
    """SELECT account_id, CASE WHEN currently_in_drawdown THEN 'still in drawdown for ' || (end_date - current_peak_date) || ' days' ELSE 'back at the previous peak' END AS current_drawdown_hint,
coalesce(strftime(recovery_date, '%Y-%m-%d'), 'not recovered') AS recovery_date_value, 'from peak to recovery, or to the last point' AS underwater_hint FROM v_drawdown""",
)
def _(spark, sf):
    return returns.drawdown_labels(returns.drawdown_summary(book(spark, sf, clean=True).observations))


@query(
    "price_only_coverage",
    """SELECT account_id, start_date, end_date, CAST(NULL AS DOUBLE) AS cumulative_twr, CAST(NULL AS DOUBLE) AS maximum_drawdown, false AS complete FROM v_drawdown""",
)
def _(spark, sf):
    return returns.drawdown_summary(book(spark, sf, clean=True).observations, coverage="PRICE_ONLY").select(
        P, "start_date", "end_date", "cumulative_twr", "maximum_drawdown", "complete"
    )


@query(
    "last_observation_per_date",
    """SELECT account_id, date, arg_max(total, o_orderkey) AS total FROM (SELECT account_id, trade_date AS date, o_orderkey, o_totalprice AS total FROM v_orders) GROUP BY ALL""",
)
def _(spark, sf):
    raw = fixtures._orders(spark, sf).select(P, F.col("trade_date").alias("date"), "o_orderkey", F.col("o_totalprice").alias("total"))
    return returns.last_per_date(raw, "o_orderkey")


# --- flows and XIRR ---------------------------------------------------------------------------

view(
    "v_events_clean",
    """SELECT account_id, trade_date AS date, CASE transaction_type WHEN 'CASH_IN' THEN 'CONTRIBUTION' ELSE 'WITHDRAWAL' END AS kind, amount_foreign * fx_rate AS amount_twd, source_row_number
FROM v_tx_clean WHERE transaction_type IN ('CASH_IN', 'CASH_OUT') AND trade_date <= DATE '2001-06-30'
UNION ALL SELECT account_id, DATE '2001-06-30', 'TERMINAL_VALUE', total_assets_twd, NULL FROM v_totals_clean""",
)


def _terminal(b):
    return b.totals.select(
        P, "valuation_date", "complete", "total_assets_twd", "positions_complete", F.col("known_position_value_twd").alias("position_value_twd")
    )


@query(
    "external_cash_flow_events",
    f"""SELECT account_id, date, kind, {sql_rounded(2, "amount_twd")}, {sql_round(2, "CASE kind WHEN 'CONTRIBUTION' THEN -amount_twd ELSE amount_twd END")} AS signed_amount_twd,
coalesce(CAST(source_row_number AS VARCHAR), '') AS source_row_numbers FROM v_events_clean""",
)
def _(spark, sf):
    b = book(spark, sf, clean=True)
    rows = F.array_join(F.col("source_row_numbers").cast("array<string>"), ",").alias("source_row_numbers")
    return flows.external_events(b.tx, _terminal(b)).select(P, "date", "kind", *rounded(2, "amount_twd", "signed_amount_twd"), rows)


view(
    "v_net_clean",
    """SELECT account_id, date, sum(CASE kind WHEN 'CONTRIBUTION' THEN -amount_twd ELSE amount_twd END) AS amount FROM v_events_clean GROUP BY ALL
HAVING abs(sum(CASE kind WHEN 'CONTRIBUTION' THEN -amount_twd ELSE amount_twd END)) > 1e-9""",
)


@query("daily_net_flows", f"SELECT account_id, date, {sql_rounded(2, 'amount')} FROM v_net_clean")
def _(spark, sf):
    b = book(spark, sf, clean=True)
    return flows.daily_net_flows(flows.external_events(b.tx, _terminal(b))).select(P, "date", *rounded(2, "amount"))


# independent root search: value on the same grid, then repeated tenfold refinement of each bracket
_LO, _HI = "ln(1e-6)", "ln(1000001e0)"
view(
    "v_flow_years",
    "SELECT account_id, amount, (date - min(date) OVER (PARTITION BY account_id)) / 365e0 AS years FROM v_net_clean",
)
view("v_flow_lists", "SELECT account_id, list(amount) AS amounts, list(years) AS years FROM v_flow_years GROUP BY account_id")


def _npv(rate: str) -> str:
    return f"list_sum(list_transform(range(1, len(amounts) + 1), lambda j: amounts[j] * exp(-years[j] * ({rate}))))"


view(
    "v_grid",
    f"""SELECT account_id, amounts, years, i, {_LO} + ({_HI} - {_LO}) * i / 1600 AS x, {_npv(f"{_LO} + ({_HI} - {_LO}) * i / 1600")} AS v
FROM v_flow_lists, (SELECT unnest(range(1601)) AS i)""",
)
view(
    "v_cells",
    """SELECT account_id, amounts, years, x AS lo, nx AS hi, v AS vlo FROM (SELECT *, lead(x) OVER w AS nx, lead(v) OVER w AS nv FROM v_grid WINDOW w AS (PARTITION BY account_id ORDER BY i))
WHERE (v < 0 AND nv > 0) OR (v > 0 AND nv < 0)""",
)
view(
    "v_bisect",
    f"""SELECT account_id, amounts, years, lo, hi, vlo, 0 AS n FROM v_cells
UNION ALL SELECT account_id, amounts, years, CASE WHEN (vlo < 0) <> (m < 0) THEN lo ELSE (lo + hi) / 2 END, CASE WHEN (vlo < 0) <> (m < 0) THEN (lo + hi) / 2 ELSE hi END,
  CASE WHEN (vlo < 0) <> (m < 0) THEN vlo ELSE m END, n + 1
FROM (SELECT *, {_npv("(lo + hi) / 2")} AS m FROM v_bisect WHERE n < 50)""",
)
view(
    "v_xirr",
    "SELECT account_id, count(*) AS root_count, CASE WHEN count(*) = 1 THEN min(exp((lo + hi) / 2) - 1) END AS xirr FROM v_bisect WHERE n = 50 GROUP BY account_id",
)


@query("xirr", f"SELECT account_id, CAST(root_count AS INTEGER) AS root_count, {sql_rounded(7, 'xirr')} FROM v_xirr")
def _(spark, sf):
    b = book(spark, sf, clean=True)
    net = flows.daily_net_flows(flows.external_events(b.tx, _terminal(b)))
    return xirr(net).select(P, "root_count", *rounded(7, "xirr"))


_PERF = (
    "gross_contributions_twd",
    "gross_withdrawals_twd",
    "net_contributed_capital_twd",
    "terminal_assets_twd",
    "cumulative_profit_twd",
)
_LATE = "(SELECT account_id, count(*) AS late FROM {tx} WHERE trade_date > DATE '2001-06-30' GROUP BY account_id)"


@query(
    "performance_summary",
    f"""SELECT account_id, DATE '2001-06-30' AS valuation_date, {sql_rounded(1, *_PERF)}, {sql_rounded(6, "money_multiple")},
CASE WHEN late IS NULL THEN {sql_round(7, "xirr")} END AS xirr, CASE WHEN late IS NULL THEN '' ELSE 'TRANSACTION_AFTER_VALUATION_DATE' END AS issue_codes,
CAST(CASE WHEN late IS NULL THEN 0 ELSE 1 END AS BIGINT) AS blocking_issue_count, late IS NULL AS complete FROM (
SELECT e.*, c AS gross_contributions_twd, w AS gross_withdrawals_twd, c - w AS net_contributed_capital_twd, t AS terminal_assets_twd, t + w - c AS cumulative_profit_twd, (t + w) / c AS money_multiple,
x.xirr, l.late FROM (SELECT account_id, sum(amount_twd) FILTER (kind = 'CONTRIBUTION') AS c, coalesce(sum(amount_twd) FILTER (kind = 'WITHDRAWAL'), 0e0) AS w, sum(amount_twd) FILTER (kind = 'TERMINAL_VALUE') AS t
FROM v_events_clean GROUP BY account_id) e LEFT JOIN v_xirr x ON x.account_id = e.account_id LEFT JOIN {_LATE.format(tx="v_tx_clean")} l ON l.account_id = e.account_id)""",
)
def _(spark, sf):
    b = book(spark, sf, clean=True)
    df = flows.performance_summary(b.tx, _terminal(b))
    done = (*_PERF, "money_multiple", "xirr")
    return df.select(*[c for c in df.columns if c not in done], *rounded(1, *_PERF), *rounded(6, "money_multiple"), *rounded(7, "xirr"))


_SEC = (
    "gross_purchases_twd",
    "gross_sale_proceeds_twd",
    "net_security_capital_deployed_twd",
    "terminal_position_value_twd",
    "estimated_gain_twd",
)


def _security_views(suffix: str, tx: str, totals: str, complete: str) -> None:
    view(
        f"v_security_events{suffix}",
        f"""SELECT account_id, trade_date AS date, CASE WHEN quantity > 0 THEN 'PURCHASE' ELSE 'SALE' END AS kind, CASE WHEN quantity > 0 THEN amount_foreign + fee ELSE amount_foreign - fee END * fx_rate AS amount_twd,
  source_row_number, CASE WHEN fx_rate IS NULL THEN 'MISSING_SECURITY_FLOW_FX' END AS issue_code FROM {tx} WHERE transaction_type = 'SECURITY' AND trade_date <= DATE '2001-06-30' AND (quantity > 0 OR amount_foreign - fee > 1e-9)
UNION ALL SELECT account_id, DATE '2001-06-30', 'TERMINAL_POSITION_VALUE', known_position_value_twd, NULL, NULL FROM {totals} WHERE {complete}""",
    )
    view(
        f"v_security_summary{suffix}",
        f"""SELECT t.account_id, DATE '2001-06-30' AS valuation_date, c AS gross_purchases_twd, w AS gross_sale_proceeds_twd, c - w AS net_security_capital_deployed_twd, CASE WHEN {complete} THEN known_position_value_twd END AS terminal_position_value_twd,
  CASE WHEN n = 0 THEN known_position_value_twd + w - c END AS estimated_gain_twd, CASE WHEN n = 0 THEN (known_position_value_twd + w) / c END AS security_multiple, n AS blocking_issue_count, n = 0 AS complete
FROM (SELECT t.*, e.c, e.w, e.bad + CASE WHEN l.late IS NULL THEN 0 ELSE 1 END + CASE WHEN {complete} THEN 0 ELSE 1 END AS n FROM {totals} t JOIN (SELECT account_id, sum(amount_twd) FILTER (kind = 'PURCHASE') AS c,
  coalesce(sum(amount_twd) FILTER (kind = 'SALE'), 0e0) AS w, count(issue_code) AS bad FROM v_security_events{suffix} GROUP BY account_id) e ON e.account_id = t.account_id
  LEFT JOIN (SELECT account_id, count(*) AS late FROM {tx} WHERE transaction_type = 'SECURITY' AND trade_date > DATE '2001-06-30' GROUP BY account_id) l ON l.account_id = t.account_id) t""",
    )


_security_views("", "v_tx", "v_totals", "positions_complete")
_security_views("_clean", "(SELECT * FROM v_tx_clean WHERE trade_date <= DATE '2001-06-30')", "v_totals_clean", "true")


@query(
    "security_cash_flow_events",
    f"""SELECT account_id, date, kind, {sql_rounded(2, "amount_twd")}, {sql_round(2, "CASE kind WHEN 'PURCHASE' THEN -amount_twd ELSE amount_twd END")} AS signed_amount_twd,
coalesce(CAST(source_row_number AS VARCHAR), '') AS source_row_numbers, issue_code FROM v_security_events""",
)
def _(spark, sf):
    b = book(spark, sf)
    rows = F.array_join(F.col("source_row_numbers").cast("array<string>"), ",").alias("source_row_numbers")
    return flows.security_events(b.tx, _terminal(b)).select(
        P, "date", "kind", *rounded(2, "amount_twd", "signed_amount_twd"), rows, "issue_code"
    )


_SECURITY = f"""SELECT account_id, valuation_date, {sql_rounded(1, *_SEC)}, {sql_rounded(6, "security_multiple")}, CAST(blocking_issue_count AS BIGINT) AS blocking_issue_count, complete FROM """


def _security(df):
    done = (*_SEC, "security_multiple")
    return df.select(*[c for c in df.columns if c in (P, "valuation_date", "blocking_issue_count", "complete")], *rounded(1, *_SEC), *rounded(6, done[-1]))


@query("security_summary_blocked", _SECURITY + "v_security_summary")
def _(spark, sf):
    b = book(spark, sf)
    return _security(flows.security_summary(b.tx, _terminal(b)))


@query("security_summary", _SECURITY + "v_security_summary_clean")
def _(spark, sf):
    """Trades after the valuation date block the summary, so it runs on the trades up to it."""
    b = book(spark, sf, clean=True)
    upto = b.tx.where(F.col("trade_date") <= F.lit(fixtures.VALUATION_DATE))
    return _security(flows.security_summary(upto, _terminal(b)))
