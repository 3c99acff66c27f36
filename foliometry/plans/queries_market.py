"""Market-data revisions, universe, coverage and strategy prices."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from foliometry.operators import market
from foliometry.operators.marks import fx_with_tolerance
from foliometry.plans import fixtures
from foliometry.plans.catalog import query, rounded, sql_round, sql_rounded
from foliometry.plans.oracle_views import view

P = "account_id"
_CORRECTED_FROM = datetime.date(2001, 1, 1)


def runs(spark):
    rows = [(0, "run-1", 1, "ARCHIVED"), (0, "run-2", 2, "ACTIVE"), (0, "run-3", 3, "PENDING"), (0, "run-0", 0, "FAILED")]
    return spark.createDataFrame(rows, "market_id long, run_id string, revision int, status string")


def revision_bars(spark, sf):
    """Revision 1 holds every bar, 2 corrects the last year, 3 is pending and must not be read."""
    bars = fixtures.bars(spark, sf).withColumn("market_id", F.lit(0).cast("bigint"))
    scaled = lambda x: F.round(F.col("raw_close") * x + fixtures.NUDGE, 4)
    late = bars.where(F.col("date") >= F.lit(_CORRECTED_FROM))
    return (
        bars.withColumn("run_id", F.lit("run-1"))
        .unionByName(late.withColumn("raw_close", scaled(1.01)).withColumn("run_id", F.lit("run-2")))
        .unionByName(late.withColumn("raw_close", scaled(2)).withColumn("run_id", F.lit("run-3")))
    )


def segments(spark, sf):
    bar = F.struct("date", "raw_close", "adjusted_close")
    return revision_bars(spark, sf).groupBy("market_id", "run_id", *market.INSTRUMENT).agg(F.collect_list(bar).alias("bars"))


def merged(spark, sf):
    return market.merged_bars(market.exploded_segments(segments(spark, sf), runs(spark)))


view(
    "v_revision_bars",
    """SELECT 1 AS revision, * FROM v_bars UNION ALL SELECT 2, instrument_type, ticker, currency, date, round(raw_close * 101e-2 + 1.73e-6, 4), adjusted_close FROM v_bars WHERE date >= DATE '2001-01-01'""",
)
view(
    "v_merged_bars",
    """SELECT instrument_type, ticker, currency, date, arg_max(raw_close, revision) AS raw_close, arg_max(adjusted_close, revision) AS adjusted_close, max(revision) AS revision FROM v_revision_bars GROUP BY ALL""",
)


@query(
    "market_segments",
    f"SELECT CAST(0 AS BIGINT) AS market_id, revision, instrument_type, ticker, currency, date, {sql_rounded(4, 'raw_close', 'adjusted_close')} FROM v_revision_bars",
)
def _(spark, sf):
    return market.exploded_segments(segments(spark, sf), runs(spark)).select(
        "market_id", "revision", *market.INSTRUMENT, "date", *rounded(4, "raw_close", "adjusted_close")
    )


@query(
    "market_merge",
    f"SELECT CAST(0 AS BIGINT) AS market_id, instrument_type, ticker, currency, date, revision, {sql_rounded(4, 'raw_close', 'adjusted_close')} FROM v_merged_bars",
)
def _(spark, sf):
    return merged(spark, sf).select("market_id", *market.INSTRUMENT, "date", "revision", *rounded(4, "raw_close", "adjusted_close"))


@query(
    "marks_from_bars",
    f"""SELECT CAST(0 AS BIGINT) AS market_id, row_number() OVER (ORDER BY date, instrument_type, currency, ticker) AS source_row_number, date AS mark_date,
CASE instrument_type WHEN 'FX' THEN 'FX' ELSE 'PRICE' END AS mark_type, ticker, currency, {sql_rounded(4, 'raw_close').replace(' AS raw_close', ' AS value')} FROM v_merged_bars""",
)
def _(spark, sf):
    df = market.marks_from_bars(merged(spark, sf))
    return df.select(*[c for c in df.columns if c != "value"], *rounded(4, "value"))


@query(
    "latest_bar_dates",
    "SELECT CAST(0 AS BIGINT) AS market_id, instrument_type, ticker, currency, max(date) AS latest_date FROM v_revision_bars GROUP BY ALL",
)
def _(spark, sf):
    return market.latest_dates(market.exploded_segments(segments(spark, sf), runs(spark)))


view(
    "v_universe",
    """
SELECT account_id, 'SECURITY' AS instrument_type, ticker, arg_min(currency, (trade_date, source_row_number)) AS currency, ticker AS provider_symbol, min(trade_date) AS start_date
FROM v_tx WHERE transaction_type = 'SECURITY' GROUP BY account_id, ticker
UNION ALL SELECT account_id, 'BENCHMARK', 'SPY', 'USD', 'SPY', min(trade_date) FROM v_tx GROUP BY account_id
UNION ALL SELECT account_id, 'FX', '', currency, CASE currency WHEN 'USD' THEN 'TWD=X' ELSE currency || 'TWD=X' END, min(d) FROM (
  SELECT account_id, currency, trade_date AS d FROM v_tx WHERE currency <> 'TWD' UNION ALL SELECT account_id, 'USD', min(trade_date) FROM v_tx GROUP BY account_id) GROUP BY account_id, currency""",
)


@query("instrument_universe", "SELECT * FROM v_universe")
def _(spark, sf):
    return market.instrument_universe(fixtures.tx(spark, sf))


@query(
    "instrument_universe_incremental",
    """SELECT u.account_id, u.instrument_type, u.ticker, u.currency, u.provider_symbol, CASE WHEN l.latest_date IS NULL THEN u.start_date ELSE greatest(u.start_date, l.latest_date - 10) END AS start_date
FROM v_universe u LEFT JOIN (SELECT instrument_type, ticker, currency, max(date) AS latest_date FROM v_revision_bars GROUP BY ALL) l USING (instrument_type, ticker, currency)""",
)
def _(spark, sf):
    latest = market.latest_dates(market.exploded_segments(segments(spark, sf), runs(spark)))
    return market.instrument_universe(fixtures.tx(spark, sf), latest)


@query(
    "universe_issues",
    """SELECT account_id, 'CONFLICTING_CURRENCY' AS issue_code, ticker FROM v_tx WHERE transaction_type = 'SECURITY' GROUP BY account_id, ticker HAVING count(DISTINCT currency) > 1
UNION ALL SELECT account_id, 'TOO_MANY_INSTRUMENTS', '' FROM v_universe GROUP BY account_id HAVING count(*) > 20""",
)
def _(spark, sf):
    tx = fixtures.tx(spark, sf)
    return market.universe_issues(tx, market.instrument_universe(tx), max_instruments=20)


@query(
    "refresh_marks",
    f"""SELECT CAST(0 AS BIGINT) AS market_id, mark_date, mark_type, ticker, currency, {sql_rounded(4, 'value')}, max(mark_date) OVER () AS valuation_date FROM (
SELECT max(date) AS mark_date, CASE instrument_type WHEN 'FX' THEN 'FX' ELSE 'PRICE' END AS mark_type, ticker, currency, arg_max(raw_close, date) AS value FROM v_merged_bars GROUP BY instrument_type, ticker, currency)""",
)
def _(spark, sf):
    df = market.refresh_marks(merged(spark, sf))
    return df.select(*[c for c in df.columns if c != "value"], *rounded(4, "value"))


@query(
    "market_run_summary",
    """SELECT CAST(0 AS BIGINT) AS market_id, revision, count(DISTINCT instrument_type || '|' || ticker || '|' || currency) AS instrument_count, count(*) AS bar_count, min(date) AS earliest_bar_date, max(date) AS latest_bar_date
FROM v_revision_bars GROUP BY revision""",
)
def _(spark, sf):
    return market.run_summary(market.exploded_segments(segments(spark, sf), runs(spark)))


@query(
    "market_instrument_summary",
    f"""SELECT CAST(0 AS BIGINT) AS market_id, revision, instrument_type, ticker, currency, count(*) AS bar_count, min(date) AS earliest_bar_date, max(date) AS latest_bar_date, {sql_round(4, 'arg_max(raw_close, date)')} AS latest_raw_close
FROM v_revision_bars GROUP BY revision, instrument_type, ticker, currency""",
)
def _(spark, sf):
    df = market.instrument_summary(market.exploded_segments(segments(spark, sf), runs(spark)))
    return df.select(*df.columns[:-1], *rounded(4, "latest_raw_close"))


def _text(c: str) -> str:
    return f"CASE WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE CAST({c} AS VARCHAR) END"


view(
    "v_bar_hashes",
    f"""SELECT *, sha256('MARKET_PROVIDER|RAW_CLOSE|' || instrument_type || '|' || ticker || '|' || currency || '|' || CAST(date AS VARCHAR) || '|' || {_text('raw_close')} || '|' || {_text('adjusted_close')}) AS row_hash FROM v_bars""",
)
view(
    "v_series_hashes",
    "SELECT instrument_type, ticker, currency, sha256(string_agg(row_hash, '|' ORDER BY date)) AS series_hash FROM v_bar_hashes GROUP BY ALL",
)


def _one_market(spark, sf):
    return fixtures.bars(spark, sf).withColumn("market_id", F.lit(0).cast("bigint"))


@query("series_hashes", "SELECT CAST(0 AS BIGINT) AS market_id, instrument_type, ticker, currency, series_hash FROM v_series_hashes")
def _(spark, sf):
    return market.series_hash(_one_market(spark, sf))


@query(
    "source_version",
    "SELECT CAST(0 AS BIGINT) AS market_id, sha256(string_agg(series_hash, '|' ORDER BY series_hash)) AS source_version FROM v_series_hashes",
)
def _(spark, sf):
    return market.source_version(_one_market(spark, sf))


@query(
    "history_gaps",
    """SELECT instrument_type, ticker, currency, CAST(min(date) - DATE '1995-01-01' AS INTEGER) AS head, CAST(DATE '2001-11-15' - max(date) AS INTEGER) AS tail, CAST(max(gap) AS INTEGER) AS widest_gap,
CASE WHEN min(date) - DATE '1995-01-01' > 14 OR DATE '2001-11-15' - max(date) > 14 THEN 'TRUNCATED_HISTORY' WHEN max(gap) > 14 THEN 'GAPPED_HISTORY' END AS issue_code
FROM (SELECT *, date - lag(date) OVER (PARTITION BY instrument_type, ticker, currency ORDER BY date) AS gap FROM v_bars) GROUP BY ALL""",
)
def _(spark, sf):
    return market.history_gaps(
        fixtures.bars(spark, sf), list(market.INSTRUMENT), F.lit(datetime.date(1995, 1, 1)), F.lit(datetime.date(2001, 11, 15))
    )


view(
    "v_wanted_fx",
    "SELECT DISTINCT currency, date FROM v_bars WHERE instrument_type = 'SECURITY' AND currency <> 'TWD'",
)
view(
    "v_tolerant_fx",
    """SELECT w.currency, w.date, CASE WHEN w.date - f.date <= 10 THEN f.raw_close END AS rate, CASE WHEN w.date - f.date <= 10 THEN CAST(w.date - f.date AS INTEGER) END AS age_days
FROM v_wanted_fx w ASOF LEFT JOIN (SELECT * FROM v_bars WHERE instrument_type = 'FX') f ON f.currency = w.currency AND w.date >= f.date""",
)


@query("fx_with_tolerance", "SELECT currency, date, rate, age_days FROM v_tolerant_fx")
def _(spark, sf):
    bars = fixtures.bars(spark, sf)
    return fx_with_tolerance(bars, bars.where("instrument_type = 'SECURITY' and currency <> 'TWD'"))


view(
    "v_strategy_prices",
    """SELECT b.ticker, b.date, b.adjusted_close * CASE WHEN b.currency = 'TWD' THEN 1e0 ELSE f.rate END AS price_twd, CASE WHEN b.currency <> 'TWD' AND f.rate IS NULL THEN 'MISSING_HISTORICAL_FX' END AS issue_code
FROM (SELECT * FROM v_bars WHERE instrument_type = 'SECURITY') b LEFT JOIN v_tolerant_fx f ON f.currency = b.currency AND f.date = b.date""",
)


@query("strategy_prices", f"SELECT ticker, date, {sql_rounded(3, 'price_twd')}, issue_code FROM v_strategy_prices")
def _(spark, sf):
    return market.strategy_prices(fixtures.bars(spark, sf)).select("ticker", "date", *rounded(3, "price_twd"), "issue_code")
