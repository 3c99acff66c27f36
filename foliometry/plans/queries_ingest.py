"""File rows to typed transactions and marks, hashes, rejects, profile, provider documents."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import functions as F

from foliometry.functions import market
from foliometry.functions.search import contains_text
from foliometry.operators import gate, ingest
from foliometry.plans import fixtures
from foliometry.plans.catalog import query, rounded, sql_rounded
from foliometry.plans.oracle_views import view
from foliometry.runtime import shared_folder
from foliometry.schema import clean, gross_native, twd_rate
from foliometry.sources import files, provider

P = "account_id"


def _money(expression: str) -> str:
    v = f"CAST(round({expression} * 100) AS BIGINT)"
    return f"""(CASE WHEN {v} // 100 >= 1000 THEN ({v} // 100 // 1000) || ',' || lpad(CAST({v} // 100 % 1000 AS VARCHAR), 3, '0') ELSE CAST({v} // 100 AS VARCHAR) END || '.' || lpad(CAST({v} % 100 AS VARCHAR), 2, '0'))"""


view(
    "v_raw",
    f"""
SELECT account_id, source_row_number,
  CASE WHEN r % 41 = 0 THEN '1997-02-30' WHEN r % 43 = 0 THEN CAST(trade_date - DATE '1899-12-30' AS VARCHAR) WHEN r % 7 = 0 THEN year(trade_date) || '/' || month(trade_date) || '/' || day(trade_date)
    ELSE CAST(trade_date AS VARCHAR) END AS d,
  CASE WHEN r % 53 = 0 THEN 'SWAP' WHEN transaction_type = 'SECURITY' AND r % 5 = 0 THEN '' WHEN transaction_type = 'SECURITY' AND quantity > 0 THEN ' buy' WHEN transaction_type = 'SECURITY' THEN 'Sell'
    WHEN transaction_type = 'FX_BUY' THEN '換匯買入' WHEN transaction_type = 'FX_SELL' THEN 'forex_sell' WHEN transaction_type = 'CASH_IN' THEN 'Deposit' ELSE '出金' END AS t,
  CASE WHEN r % 61 = 0 THEN '' WHEN sec AND k % 4 = 0 THEN '23' || lpad(CAST(k AS VARCHAR), 2, '0') ELSE lower(ticker) END AS s,
  CASE WHEN sec THEN CAST(CAST(CASE WHEN r % 5 = 0 THEN quantity ELSE abs(quantity) END AS BIGINT) AS VARCHAR) ELSE '' END AS q,
  CASE WHEN r % 59 = 0 THEN '-1' WHEN sec THEN {_money('price')} ELSE '' END AS p, CASE WHEN sec THEN '' ELSE {_money('amount_foreign')} END AS a,
  CASE WHEN r % 47 = 0 OR fx_rate IS NULL THEN '' ELSE printf('%.1f', fx_rate) END AS x, {_money('fee')} AS f, CASE WHEN sec AND k % 4 = 0 THEN 'n/a' ELSE lower(currency) END AS c,
  CASE WHEN r % 3 = 0 THEN ' bulk ' ELSE '' END AS n
FROM (SELECT *, source_row_number AS r, transaction_type = 'SECURITY' AS sec, try_cast(substr(ticker, 2) AS INTEGER) AS k FROM v_tx)""",
)
view(
    "v_typed",
    """
SELECT *, CASE WHEN transaction_type = 'SECURITY' THEN abs(coalesce(raw_amount, price * quantity)) ELSE abs(coalesce(raw_amount, 0e0)) END AS amount_foreign FROM (
SELECT *, CASE WHEN word = 'SELL' AND q0 > 0 THEN -q0 WHEN word = 'BUY' AND q0 < 0 THEN abs(q0) ELSE q0 END AS quantity,
  CASE WHEN currency = 'TWD' THEN 1e0 ELSE raw_rate END AS fx_rate FROM (
SELECT account_id, source_row_number, upper(trim(t)) AS word, coalesce(try_cast(replace(q, ',', '') AS DOUBLE), 0e0) AS q0,
  CASE WHEN regexp_full_match(d, '[0-9]+') THEN DATE '1899-12-30' + CAST(d AS INTEGER)
    WHEN d LIKE '%/%' THEN try_cast(split_part(d, '/', 1) || '-' || lpad(split_part(d, '/', 2), 2, '0') || '-' || lpad(split_part(d, '/', 3), 2, '0') AS DATE) ELSE try_cast(d AS DATE) END AS trade_date,
  CASE WHEN regexp_full_match(s, '[0-9]{4,6}') THEN s || '.TW' ELSE upper(s) END AS ticker,
  CASE WHEN regexp_full_match(upper(c), '[A-Z]{3}') THEN upper(c) WHEN regexp_full_match(s, '[0-9]{4,6}') THEN 'TWD' ELSE 'USD' END AS currency,
  coalesce(try_cast(replace(p, ',', '') AS DOUBLE), 0e0) AS price, CASE WHEN a <> '' THEN CAST(replace(a, ',', '') AS DOUBLE) END AS raw_amount, CASE WHEN x <> '' THEN CAST(x AS DOUBLE) END AS raw_rate,
  CAST(replace(f, ',', '') AS DOUBLE) AS fee, trim(n) AS note,
  CASE WHEN upper(trim(t)) IN ('BUY', 'SELL') THEN 'SECURITY' WHEN t = '' AND q <> '' AND q <> '0' THEN 'SECURITY' WHEN t = '換匯買入' THEN 'FX_BUY' WHEN t = 'forex_sell' THEN 'FX_SELL'
    WHEN t = 'Deposit' THEN 'CASH_IN' WHEN t = '出金' THEN 'CASH_OUT' END AS transaction_type
FROM v_raw))""",
)
view(
    "v_parsed",
    """
SELECT *, CASE WHEN transaction_type IS NULL THEN 'UNSUPPORTED_TYPE' WHEN trade_date IS NULL THEN 'INVALID_DATE' WHEN transaction_type = 'SECURITY' AND ticker = '' THEN 'MISSING_TICKER'
  WHEN transaction_type = 'SECURITY' AND quantity = 0 THEN 'ZERO_QUANTITY' WHEN transaction_type = 'SECURITY' AND price <= 0 THEN 'NON_POSITIVE_PRICE'
  WHEN transaction_type <> 'SECURITY' AND amount_foreign <= 0 THEN 'NON_POSITIVE_AMOUNT'
  WHEN currency <> 'TWD' AND transaction_type IN ('CASH_IN', 'FX_BUY', 'FX_SELL') AND coalesce(fx_rate, 0e0) <= 0 THEN 'MISSING_FX_RATE' WHEN price < 0 OR fx_rate <= 0 THEN 'INVALID_FIELD' END AS reject_reason
FROM v_typed""",
)


def _text(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '' WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE CAST({c} AS VARCHAR) END"


_CONTENT = " || '|' || ".join(
    ["CAST(trade_date AS VARCHAR)", "transaction_type", "ticker", "currency"]
    + [_text(c) for c in ("quantity", "price", "amount_foreign", "fx_rate", "fee")]
    + ["''", "''", "note"]
)
view("v_accepted", f"SELECT *, sha256({_CONTENT}) AS content_hash FROM v_parsed WHERE reject_reason IS NULL")

@fixtures.shared
def parsed_transactions(spark, sf):
    """Typed rows are written once: rejects, hashes and the profile read them."""
    return ingest.parse_transactions(fixtures.raw_transactions(spark, sf))


_TYPED = ("quantity", "price", "amount_foreign", "fx_rate", "fee")


@query(
    "parse_transactions",
    f"SELECT account_id, source_row_number, trade_date, transaction_type, ticker, currency, {sql_rounded(4, *_TYPED)}, note, reject_reason FROM v_parsed",
)
def _(spark, sf):
    return ingest.parse_transactions(fixtures.raw_transactions(spark, sf)).select(
        P, "source_row_number", "trade_date", "transaction_type", "ticker", "currency", *rounded(4, *_TYPED), "note", "reject_reason"
    )


@query(
    "file_transactions",
    f"""SELECT account_id, CAST(1 + row_number() OVER (PARTITION BY account_id ORDER BY source_row_number) AS BIGINT) AS source_row_number, trade_date, transaction_type, ticker, currency,
{sql_rounded(4, *_TYPED)}, CASE WHEN source_row_number % 7 = 0 THEN 'two, "quoted"' || chr(10) || 'lines' ELSE note END AS note, reject_reason FROM v_parsed""",
)
def _(spark, sf):
    """A file per account, in two spellings and orders of the header, with quoted line breaks; read back with row numbers."""
    odd = F.col("source_row_number") % 7 == 0
    rows = fixtures.raw_transactions(spark, sf).withColumn("memo", F.when(odd, 'two, "quoted"\nlines').otherwise(F.col("memo")))
    other = ["memo", *[c for c in rows.columns if c != "memo"]]
    folder = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    _write_files(rows.where(F.col(P) % 2 == 0), f"{folder}/first")
    _write_files(rows.where(F.col(P) % 2 == 1).select(other).withColumnRenamed("Qty", "股數"), f"{folder}/second")
    raw = files.read_transactions(spark, f"{folder}/*/*").withColumn(P, _account_of_file())
    return ingest.parse_transactions(raw).select(
        P, "source_row_number", "trade_date", "transaction_type", "ticker", "currency", *rounded(4, *_TYPED), "note", "reject_reason"
    )


def _write_files(rows, folder: str) -> None:
    """One file per account in the order of the row numbers, which are not written."""
    ordered = rows.repartition(P).sortWithinPartitions(P, "source_row_number").drop("source_row_number")
    ordered.write.partitionBy(P).option("header", True).option("escape", '"').csv(folder)


def _account_of_file():
    return F.regexp_extract(files.FILE, "account_id=([0-9]+)", 1).cast("bigint")


@query("rejected_rows", "SELECT account_id, source_row_number, reject_reason FROM v_parsed WHERE reject_reason IS NOT NULL")
def _(spark, sf):
    return ingest.rejected(parsed_transactions(spark, sf))


@query(
    "transaction_hashes",
    """SELECT account_id, source_row_number, occurrence, content_hash, sha256(content_hash || '|occurrence:' || occurrence) AS row_hash FROM (
SELECT *, row_number() OVER (PARTITION BY account_id, content_hash ORDER BY source_row_number) AS occurrence FROM v_accepted)""",
)
def _(spark, sf):
    rows = ingest.accepted(parsed_transactions(spark, sf))
    return rows.select(P, "source_row_number", "occurrence", "content_hash", "row_hash")


@query(
    "dataset_profile",
    """SELECT account_id, CAST(count(*) AS BIGINT) AS row_count, count(DISTINCT ticker) FILTER (ticker <> '') AS ticker_count, min(trade_date) AS earliest_date, max(trade_date) AS latest_date,
CAST(count(*) FILTER (currency <> 'TWD' AND fx_rate IS NULL AND transaction_type IN ('SECURITY', 'CASH_OUT')) AS BIGINT) AS missing_fx_count,
CAST(count(*) - count(DISTINCT content_hash) AS BIGINT) AS repeated_content_count FROM v_accepted GROUP BY account_id""",
)
def _(spark, sf):
    rows = parsed_transactions(spark, sf).where("reject_reason is null")
    return gate.dataset_profile(rows)


view(
    "v_raw_marks",
    f"""SELECT snapshot_id AS account_id, source_row_number, CASE WHEN snapshot_id = 0 THEN '2001/06/30' ELSE CAST(mark_date AS VARCHAR) END AS vd,
CASE WHEN source_row_number % 23 = 0 THEN '2001-6-1' ELSE strftime(mark_date, '%Y/%m/%d') END AS d, CASE WHEN source_row_number % 29 = 0 THEN 'YIELD' WHEN mark_type = 'FX' THEN 'FX' ELSE 'PRICE' END AS t, ticker,
CASE WHEN source_row_number % 31 = 0 OR mark_type = 'PRICE' THEN '' ELSE currency END AS c, CASE WHEN source_row_number % 37 = 0 THEN -3e0 ELSE CAST(replace({_money('value')}, ',', '') AS DOUBLE) END AS value,
CASE WHEN source = 'MONTHLY' THEN 'MANUAL_UPLOAD' ELSE source END AS source FROM v_marks""",
)
view(
    "v_parsed_marks",
    """SELECT *, CASE WHEN mark_type IS NULL THEN 'UNSUPPORTED_TYPE' WHEN mark_type = 'FX' AND c = '' THEN 'MISSING_CURRENCY' WHEN mark_date IS NULL THEN 'INVALID_DATE' WHEN value <= 0 THEN 'NON_POSITIVE_VALUE' END AS reject_reason
FROM (SELECT account_id, source_row_number, CASE WHEN d <> '2001-6-1' THEN CAST(replace(d, '/', '-') AS DATE) END AS mark_date, nullif(t, 'YIELD') AS mark_type,
CASE WHEN t = 'PRICE' THEN ticker ELSE '' END AS ticker, CASE WHEN c <> '' THEN c WHEN t <> 'FX' THEN 'USD' END AS currency, value, source, c FROM v_raw_marks)""",
)


@query(
    "parse_marks",
    f"SELECT account_id, source_row_number, mark_date, mark_type, ticker, CASE WHEN mark_type IS NULL THEN NULL ELSE currency END AS currency, {sql_rounded(4, 'value')}, source, reject_reason FROM v_parsed_marks",
)
def _(spark, sf):
    known = F.when(F.col("mark_type").isNotNull(), F.col("currency")).alias("currency")
    return ingest.parse_marks(fixtures.raw_marks(spark, sf)).select(
        P, "source_row_number", "mark_date", "mark_type", "ticker", known, *rounded(4, "value"), "source", "reject_reason"
    )


@query(
    "file_marks",
    f"""SELECT account_id, CAST(1 + row_number() OVER (PARTITION BY account_id ORDER BY source_row_number) AS BIGINT) AS source_row_number, mark_date, mark_type, ticker,
CASE WHEN mark_type IS NULL THEN NULL ELSE currency END AS currency, {sql_rounded(4, 'value')}, source, reject_reason FROM v_parsed_marks""",
)
def _(spark, sf):
    """A file of marks per snapshot, read back with its row numbers."""
    folder = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    _write_files(fixtures.raw_marks(spark, sf), folder)
    parsed = ingest.parse_marks(files.read_marks(spark, f"{folder}/*").withColumn(P, _account_of_file()))
    known = F.when(F.col("mark_type").isNotNull(), F.col("currency")).alias("currency")
    return parsed.select(P, "source_row_number", "mark_date", "mark_type", "ticker", known, *rounded(4, "value"), "source", "reject_reason")


@query(
    "valuation_date_gate",
    """SELECT account_id, CASE WHEN count(DISTINCT vd) = 1 THEN max(CAST(replace(vd, '/', '-') AS DATE)) END AS valuation_date,
CASE WHEN count(DISTINCT vd) > 1 THEN 'SEVERAL_VALUATION_DATES' END AS refusal FROM v_raw_marks GROUP BY account_id""",
)
def _(spark, sf):
    return ingest.valuation_date_gate(ingest.parse_marks(fixtures.raw_marks(spark, sf)))


@query(
    "search_transactions",
    """SELECT account_id, source_row_number FROM v_tx WHERE CAST(trade_date AS VARCHAR) LIKE '%fx_s%' OR lower(transaction_type) LIKE '%fx\\_s%' ESCAPE '\\' OR lower(ticker) LIKE '%fx\\_s%' ESCAPE '\\'""",
)
def _(spark, sf):
    columns = ("trade_date", "transaction_type", "ticker", "currency")
    return fixtures.tx(spark, sf).where(contains_text(" FX_S", columns)).select(P, "source_row_number")


@query(
    "row_expressions",
    f"""SELECT account_id, source_row_number, {sql_rounded(4, 'gross', 'flow_twd', 'cleaned')}, rate FROM (
SELECT account_id, source_row_number, CASE WHEN amount_foreign > 0 THEN amount_foreign ELSE abs(quantity) * price END AS gross, amount_foreign * fx_rate AS flow_twd, fx_rate AS rate,
CASE WHEN abs(quantity * 1e-11) < 1e-9 THEN 0e0 ELSE quantity * 1e-11 END * 1e9 AS cleaned FROM v_tx)""",
)
def _(spark, sf):
    df = fixtures.tx(spark, sf).select(
        P,
        "source_row_number",
        gross_native().alias("gross"),
        market.external_flow_twd(F.col("currency"), F.col("amount_foreign"), F.col("fx_rate")).alias("flow_twd"),
        (clean(F.col("quantity") * 1e-11) * 1e9).alias("cleaned"),
        twd_rate().alias("rate"),
    )
    return df.select(P, "source_row_number", *rounded(4, "gross", "flow_twd", "cleaned"), "rate")


@query(
    "freshness",
    """SELECT o_orderkey, 5 - (o_orderkey % 11) AS age_days, CASE WHEN o_orderkey % 13 = 0 THEN 'MISSING_DATE' WHEN 5 - o_orderkey % 11 < 0 THEN 'FUTURE_DATE' WHEN 5 - o_orderkey % 11 > 4 THEN 'AGE_LIMIT_EXCEEDED' ELSE 'CURRENT' END AS reason,
o_orderkey % 13 = 0 OR 5 - o_orderkey % 11 < 0 OR 5 - o_orderkey % 11 > 4 AS stale,
CASE WHEN o_orderkey % 13 = 0 THEN 'market date is invalid, freshness cannot be confirmed' WHEN 5 - o_orderkey % 11 < 0 THEN 'market date ' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || ' lies after today, check the source'
ELSE 'market data ends on ' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || ', ' || (5 - o_orderkey % 11) || ' days old' END AS message FROM orders""",
)
def _(spark, sf):
    k = F.col("o_orderkey")
    day = F.to_date("o_orderdate")
    df = fixtures.read(spark, sf, "orders").select(
        "o_orderkey",
        F.when(k % 13 != 0, day).alias("as_of"),
        F.date_add(day, (5 - k % 11).cast("int")).alias("today"),
        (5 - k % 11).alias("age_days"),
    )
    as_of, today = F.col("as_of"), F.col("today")
    return df.select(
        "o_orderkey",
        "age_days",
        market.freshness_reason(as_of, today).alias("reason"),
        market.is_stale(as_of, today).alias("stale"),
        market.stale_message(as_of, today).alias("message"),
    )


@query(
    "quote_units",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, unit, CASE WHEN unit IN ('GBp', 'GBX') THEN 'GBP' WHEN unit <> 'usd' THEN unit END AS currency,
CASE WHEN unit IN ('GBp', 'GBX') THEN 'GBPTWD=X' WHEN unit = 'USD' THEN 'TWD=X' WHEN unit <> 'usd' THEN unit || 'TWD=X' END AS fx_symbol, round(l_extendedprice * CASE WHEN unit IN ('GBp', 'GBX') THEN 1e-2 WHEN unit <> 'usd' THEN 1e0 END * 305e-1 + 1.73e-6, 4) + 0e0 AS price_twd
FROM (SELECT *, CASE l_linenumber WHEN 1 THEN 'GBp' WHEN 2 THEN 'GBX' WHEN 3 THEN 'usd' WHEN 4 THEN 'JPY' ELSE 'USD' END AS unit FROM lineitem)""",
)
def _(spark, sf):
    line = F.col("l_linenumber")
    unit = F.when(line == 1, "GBp").when(line == 2, "GBX").when(line == 3, "usd").when(line == 4, "JPY").otherwise("USD")
    df = fixtures.read(spark, sf, "lineitem").withColumn("unit", unit)
    currency = market.quote_currency(F.col("unit"))
    price = market.adjusted_price_twd(F.col("l_extendedprice"), market.quote_scale(F.col("unit")), F.lit(30.5))
    return df.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_extendedprice",
        "unit",
        currency.alias("currency"),
        market.provider_fx_symbol(currency).alias("fx_symbol"),
        (F.round(price + 1.73e-6, 4) + 0.0).alias("price_twd"),
    )


NOW = datetime.datetime(2001, 11, 5, 12, 0)


def _documents(spark, sf):
    """One chart document per instrument, shaped like the provider's answer, from the daily bars.

    The last bar of T1 lies in an unfinished session, every tenth close of T2 is null, T3 stops early, T4 has a
    unit that nobody knows and T5 another currency than expected.
    """
    bars = fixtures.bars(spark, sf).where("instrument_type = 'SECURITY'").where("ticker <> 'T3' or date < '2001-06-01'")
    stamp = (F.unix_date("date").cast("bigint") * 86400 + 20 * 3600).alias("stamp")
    hole = (F.col("ticker") == "T2") & (F.dayofmonth("date") == 10)
    close = F.when(~hole, F.col("raw_close")).alias("close")
    adjusted = F.when(F.dayofmonth("date") != 11, F.col("adjusted_close")).alias("adjusted")
    per = bars.select("ticker", "currency", stamp, close, adjusted).groupBy("ticker", "currency").agg(
        F.array_sort(F.collect_list(F.struct("stamp", "close", "adjusted"))).alias("b")
    )
    last = F.element_at("b", -1)["stamp"]
    session = F.when(F.col("ticker") == "T1", F.struct(last.alias("start"), (last + 10**9).alias("end")))
    result = F.struct(
        F.struct(
            F.when(F.col("ticker") == "T4", "cents").otherwise(F.col("currency")).alias("currency"),
            F.lit("Asia/Taipei").alias("exchangeTimezoneName"),
            F.struct(session.alias("regular")).alias("currentTradingPeriod"),
        ).alias("meta"),
        F.col("b.stamp").alias("timestamp"),
        F.struct(
            F.array(F.struct(F.col("b.close").alias("close"))).alias("quote"),
            F.array(F.struct(F.col("b.adjusted").alias("adjclose"))).alias("adjclose"),
        ).alias("indicators"),
    )
    text = F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("chart")), {"ignoreNullFields": "false"})
    expected = F.when(F.col("ticker") == "T5", "JPY").otherwise(F.col("currency")).alias("expected_currency")
    return per.select(
        F.col("ticker").alias("symbol"), F.lit(fixtures.START).alias("start_date"), F.lit(None).cast("date").alias("end_date"), expected, text.alias("document")
    )


# 20:00 UTC is 04:00 of the next day in Taipei
view(
    "v_provider",
    """SELECT ticker AS symbol, currency, date + 1 AS date, CASE WHEN NOT (ticker = 'T2' AND day(date) = 10) THEN raw_close END AS raw_close, CASE WHEN day(date) <> 11 THEN adjusted_close END AS adjusted_close
FROM (SELECT *, max(date) OVER (PARTITION BY ticker) AS last FROM v_bars WHERE instrument_type = 'SECURITY' AND (ticker <> 'T3' OR date < DATE '2001-06-01'))
WHERE NOT (ticker = 'T1' AND date = last)""",
)
view(
    "v_refused",
    """SELECT symbol, CASE WHEN symbol = 'T4' THEN 'UNKNOWN_QUOTE_UNIT' WHEN symbol = 'T5' THEN 'CURRENCY_MISMATCH' WHEN count(*) FILTER (raw_close IS NULL) > 0 THEN 'MISSING_RAW_CLOSE' ELSE 'STALE_HISTORY' END AS issue_code FROM v_provider GROUP BY symbol
HAVING symbol IN ('T4', 'T5') OR count(*) FILTER (raw_close IS NULL) > 0 OR DATE '2001-11-05' - max(date) > 10""",
)


@query(
    "provider_bars",
    f"SELECT symbol, date, {sql_rounded(4, 'raw_close', 'adjusted_close')}, 'Asia/Taipei' AS exchange_timezone, currency AS quote_unit FROM v_provider WHERE symbol NOT IN (SELECT symbol FROM v_refused)",
)
def _(spark, sf):
    return provider.daily_bars(_documents(spark, sf), NOW, strict=True).select(
        "symbol", "date", *rounded(4, "raw_close", "adjusted_close"), "exchange_timezone", "quote_unit"
    )


@query(
    "provider_issues",
    "SELECT symbol, issue_code FROM v_refused",
)
def _(spark, sf):
    return provider.document_issues(_documents(spark, sf), NOW, strict=True).select("symbol", "issue_code")
