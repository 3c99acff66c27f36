"""Markets kept apart, quotes in sub-units, later observations, repeated publication, early serials, the shared folder."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from foliometry import runtime
from foliometry.functions import market as units
from foliometry.functions import parsing
from foliometry.operators import backtest, market
from foliometry.operators.marks import fx_with_tolerance
from foliometry.sources import files, provider, store
from foliometry.streaming import bars as bar_stream

DAY = datetime.date(2026, 1, 2)
BARS = "market_id long, instrument_type string, ticker string, currency string, date date, raw_close double, adjusted_close double, quote_unit string"


def two_markets(spark):
    rows = [(m, "FX", "", "GBP", DAY, rate, rate, "TWD") for m, rate in ((1, 30.0), (2, 33.0))]
    rows += [(m, "SECURITY", "VOD.L", "GBP", DAY, 200.0, 200.0, unit) for m, unit in ((1, "GBp"), (2, "GBP"))]
    return spark.createDataFrame(rows, BARS)


def test_rates_and_prices_per_market_and_unit(spark):
    bars = two_markets(spark)
    rates = fx_with_tolerance(bars, bars.where("instrument_type = 'SECURITY'"))
    assert sorted((r.market_id, r.rate) for r in rates.collect()) == [(1, 30.0), (2, 33.0)]
    prices = market.strategy_prices(bars).collect()
    assert sorted((r.market_id, r.price_twd) for r in prices) == [(1, pytest.approx(60.0)), (2, pytest.approx(6600.0))]


def test_universe_does_not_multiply(spark):
    tx = spark.createDataFrame(
        [(7, 1, datetime.date(2020, 1, 1), "SECURITY", "SPY", "USD")],
        "account_id long, source_row_number int, trade_date date, transaction_type string, ticker string, currency string",
    )
    ends = [(m, "SECURITY", "SPY", "USD", datetime.date(2021, m, 20)) for m in (1, 2)]
    latest = spark.createDataFrame(ends, "market_id long, instrument_type string, ticker string, currency string, latest_date date")
    link = spark.createDataFrame([(7, 2)], "account_id long, market_id long")
    start = lambda df: [r.start_date for r in df.where("ticker = 'SPY'").collect()]
    assert start(market.instrument_universe(tx, latest)) == [datetime.date(2021, 1, 20) - datetime.timedelta(market.OVERLAP_DAYS)]
    assert start(market.instrument_universe(tx, latest, link)) == [datetime.date(2021, 2, 20) - datetime.timedelta(market.OVERLAP_DAYS)]
    assert market.instrument_universe(tx, latest, link).count() == market.instrument_universe(tx).count()


def test_later_observation_of_a_batch_wins(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    line = '{{"market_id":0,"instrument_type":"SECURITY","ticker":"A","currency":"USD","date":"2026-01-01","raw_close":{},"seen":{}}}\n'
    (source / "a.json").write_text(line.format(100.0, 1) + line.format(90.0, 2))
    schema = "market_id long, instrument_type string, ticker string, currency string, date date, raw_close double, adjusted_close double, seen long"
    stream = spark.readStream.schema(schema).json(str(source))
    bar_stream.merge_stream(stream, str(tmp_path / "out"), str(tmp_path / "progress"), ("seen",)).awaitTermination()
    assert [r.raw_close for r in bar_stream.read_merged(spark, str(tmp_path / "out")).collect()] == [90.0]


def test_publication_can_be_repeated(spark, tmp_path):
    rows = spark.createDataFrame([(1, DAY), (2, DAY)], "account_id long, trade_date date")
    folder = str(tmp_path / "store")
    for _ in range(2):
        store.publish_version(rows, folder, 1, shards=2)
    store.publish_version(rows.where("account_id = 2"), folder, 1, shards=2, batch="late")
    store.publish_version(rows.where("account_id = 2"), folder, 2, shards=2)
    assert store.read_dataset(spark, folder, 2, shards=2).count() == 1
    assert store.read_dataset(spark, folder, 1, account_id=1, shards=2).count() == 1
    assert sorted((r.account_id, r.revision) for r in store.read_active(spark, folder).collect()) == [(1, 1), (2, 2)]


def test_early_serials_and_long_schedules(spark):
    dates = spark.createDataFrame([("1",), ("59",), ("60",), ("61",), ("0",)], "x string").select(parsing.calendar_date(F.col("x"))).collect()
    assert [r[0] for r in dates] == [datetime.date(1900, 1, 1), datetime.date(1900, 2, 28), None, datetime.date(1900, 3, 1), None]
    long = spark.sql("select date'1800-01-31' a, date'2020-01-30' b").select(F.size(units.monthly_dates(F.col("a"), F.col("b")))).first()[0]
    assert long == 220 * 12


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, name, default):
            return default

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.shared_folder(Session())


REQUEST = "request_id long, account_id long, start_date date, end_date date, monthly_amount double, allocations array<struct<ticker:string,weight:double>>"
PRICE = "ticker string, date date, price_twd double, issue_code string"


def refusals(spark, rows, legs, days=90, **options):
    """The codes that refuse a request of ``days`` days over (ticker, day number, price, issue)."""
    first = datetime.date(2026, 1, 1)
    request = spark.createDataFrame([(1, 1, first, first + datetime.timedelta(days), 100.0, [(t, 1 / len(legs)) for t in legs])], REQUEST)
    prices = spark.createDataFrame([(t, first + datetime.timedelta(n), p, issue) for t, n, p, issue in rows], PRICE)
    days = backtest.market_calendar(request, prices)
    found = backtest.market_issues(request, prices, days, market.MAX_GAP_DAYS, **options)
    return sorted(r.issue_code for r in found.collect())


def test_histories_that_refuse_a_request(spark):
    weekly = [("A", n, 100.0 + n, None) for n in range(0, 91, 7)]
    hole = [("A", 35, None, "MISSING_ADJUSTED_CLOSE") if n == 35 else (t, n, p, i) for t, n, p, i in weekly]
    assert refusals(spark, weekly, ["A"]) == []
    assert refusals(spark, hole, ["A"]) == ["MISSING_ADJUSTED_CLOSE"]
    assert refusals(spark, weekly[3:], ["A"]) == ["TRUNCATED_HISTORY"]
    assert refusals(spark, weekly[:5] + weekly[8:], ["A"]) == ["GAPPED_HISTORY"]
    assert refusals(spark, weekly[:5], ["A"]) == ["TRUNCATED_HISTORY"]
    assert refusals(spark, weekly[:5], ["A"], as_of=datetime.date(2026, 2, 10)) == []
    assert refusals(spark, weekly, ["A", "B"]) == ["MISSING_PRICE_SERIES"]
    apart = [("B", n, 50.0, None) for n in [0, *range(3, 90, 7), 84]]
    assert refusals(spark, weekly + apart, ["A", "B"]) == ["GAPPED_COMMON_HISTORY"]


def test_a_hole_blocks_all_modes_instead_of_moving_a_purchase(spark):
    first = datetime.date(2026, 1, 1)
    request = spark.createDataFrame([(1, 1, first, datetime.date(2026, 3, 1), 100.0, [("A", 1.0)])], REQUEST)
    rows = [("A", datetime.date(2026, m, 1), p, i) for m, p, i in ((1, 100.0, None), (2, None, "MISSING_ADJUSTED_CLOSE"), (3, 110.0, None))]
    tx = spark.createDataFrame(
        [],
        "account_id long, source_row_number int, trade_date date, transaction_type string, ticker string, currency string, quantity double, "
        "price double, amount_foreign double, fx_rate double, fee double",
    )
    summary, _curve = backtest.compare(request, spark.createDataFrame(rows, PRICE), tx)
    assert {r.issue_codes for r in summary.collect()} == {"MISSING_ADJUSTED_CLOSE"} and summary.count() == 3


def test_files_with_line_breaks_and_other_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\ufeffdate,qty,note\n2026-01-02,1,"two, ""quoted""\nlines"\n2026-01-03,2,\n')
    (tmp_path / "b.csv").write_text("memo,shares,date\nplain,3,2026-01-04\nshort\n")
    (tmp_path / "c.csv").write_text("")
    got = files.read_transactions(spark, str(tmp_path))
    assert set(got.columns) == {"source_file", "source_row_number", "account_id", "date", "quantity", "note"}
    cells = [(r.source_file[-5:], r.source_row_number, r.date, r.quantity, r.note) for r in got.collect()]
    assert sorted(cells, key=lambda c: c[:2]) == [
        ("a.csv", 2, "2026-01-02", "1", 'two, "quoted"\nlines'),
        ("a.csv", 3, "2026-01-03", "2", None),
        ("b.csv", 2, "2026-01-04", "3", "plain"),
        ("b.csv", 3, None, None, "short"),
    ]


def test_refused_documents_give_no_bars(spark):
    def document(currency, closes=(10.0, 11.0)):
        stamps = [1767355200 + 86400 * n for n in range(len(closes))]  # from 2026-01-02 12:00 UTC
        prices = [c if c else None for c in closes]
        chart = {"meta": {"currency": currency}, "timestamp": stamps, "indicators": {"quote": [{"close": prices}], "adjclose": [{"adjclose": prices}]}}
        return json.dumps({"chart": {"result": [chart]}})

    rows = [("GOOD", "USD", document("USD")), ("PENCE", "GBP", document("GBp")), ("OTHER", "TWD", document("USD"))]
    rows += [("UNIT", None, document("cents")), ("NONE", None, document("")), ("HOLE", "USD", document("USD", (10.0, 0)))]
    first = datetime.date(2026, 1, 1)
    docs = [(s, first, None, e, d) for s, e, d in rows] + [("GOOD", first, datetime.date(2026, 1, 2), "USD", document("EUR"))]
    docs = spark.createDataFrame(docs, "symbol string, start_date date, end_date date, expected_currency string, document string")
    now = datetime.datetime(2026, 1, 5)
    reasons = lambda strict: {(r.symbol, r.end_date is None): r.issue_code for r in provider.document_issues(docs, now, strict).collect()}
    assert reasons(False) == {("OTHER", True): "CURRENCY_MISMATCH", ("GOOD", False): "CURRENCY_MISMATCH"}
    assert reasons(True) == reasons(False) | {("UNIT", True): "UNKNOWN_QUOTE_UNIT", ("NONE", True): "MISSING_QUOTE_UNIT", ("HOLE", True): "MISSING_RAW_CLOSE"}
    bars = provider.daily_bars(docs, now, strict=True).collect()
    assert sorted((r.symbol, r.raw_close, r.quote_unit) for r in bars) == [("GOOD", 10.0, "USD"), ("GOOD", 11.0, "USD"), ("PENCE", 10.0, "GBp"), ("PENCE", 11.0, "GBp")]
