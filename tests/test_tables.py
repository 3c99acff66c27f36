import dataclasses
import datetime
import functools
import re

import numpy as np
import pytest
from builders import day, rows, transactions
from pyspark.sql import functions as F

from foliometry.functions import hashing, market, parsing
from foliometry.operators import backtest, ingest, lineage, versions
from foliometry.operators.marks import next_trading_date
from foliometry.operators.ranking import number_within
from foliometry.operators.xirr import distinct_roots, xirr
from foliometry.plans import resources
from foliometry.runtime import plain_unions
from foliometry.sources import files
from foliometry.streaming import bars as bar_stream


def test_lineage_ids_write_and_move_no_plan(spark, monkeypatch):
    """Both versions lie by account already: one stored and kept row, one fresh row, one shuffle in all."""
    from foliometry.plans import queries_versions
    from foliometry.plans.catalog import PLANS

    rows_ = transactions(spark, [(2, "2026-01-02", "SECURITY", "A", "TWD", 1, 10, 10, 1, 0), (3, "2026-01-03", "SECURITY", "B", "TWD", 1, 10, 10, 1, 0)])
    rows_ = rows_.repartition(4, "account_id").withColumn("incoming", F.explode(F.array(F.lit(False), F.lit(True)))).where("incoming or source_row_number = 2")
    rows_ = rows_.withColumn("row_hash", hashing.occurrence_hash(hashing.content_hash(rows_), F.lit(1)))
    both = rows_.withColumn("transaction_id", F.when(~F.col("incoming"), F.lit("tx-1-2")))
    monkeypatch.setattr(queries_versions, "_both", lambda spark, sf: both)
    monkeypatch.setattr(queries_versions, "stored", lambda df: pytest.fail("the plan was written"))
    monkeypatch.setattr(queries_versions.fixtures, "key_of", lambda *_: ("lineage_ids", "nowhere"))
    ids = PLANS["lineage_ids"](spark, "nowhere")
    assert [tuple(r) for r in ids.select("rows", "kept", "fresh").collect()] == [(2, 1, 1)]
    assert ids._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 1


def texts(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "x string")


def column(df, expression):
    return [r[0] for r in df.select(expression).collect()]


def test_calendar_dates(spark):
    df = texts(spark, "2026/1/2", "2026-1-2", "01/02/2026", "2026/1-2", "2026-02-30", "46024", "", None)
    want = [day("2026-01-02"), day("2026-01-02"), None, None, None, day("2026-01-02"), None, None]
    assert column(df, parsing.calendar_date(F.col("x"))) == want


def test_numbers(spark):
    df = texts(spark, "1,234.5", "，7", "", " ", "abc", "1d", "Infinity", "-2e3", None)
    assert column(df, parsing.number(F.col("x"))) == [1234.5, 7, 0, 0, 0, 0, 0, -2000, 0]
    assert column(df, parsing.nullable_number(F.col("x"))) == [1234.5, 7, None, 0, None, None, None, -2000, None]


def test_number_text(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 0.1, 15000000.0, 12345678.125, 1e-7, -0.0, 1e22, 0.0005, None)], "x double")
    want = ["1", "0.1", "15000000", "12345678.125", "1e-7", "0", "1e+22", "0.0005", ""]
    assert column(df, hashing.number_text(F.col("x"))) == want


def test_tickers_and_currencies(spark):
    df = texts(spark, " 2330 ", "aapl", "0050", "123")
    assert column(df, parsing.ticker(F.col("x"))) == ["2330.TW", "AAPL", "0050.TW", "123"]


def test_first_matching_header_in_file_order_wins():
    found = parsing.canonical_columns(["Note", "Trade Date", "date", "SYMBOL"], parsing.TRANSACTION_HEADERS)
    assert found["trade_date"] == "Trade Date" and found["ticker"] == "SYMBOL"


def test_rejects_and_repeated_fills(spark):
    raw = spark.createDataFrame(
        [
            (1, 2, "2026-01-02", "BUY", "AAPL", "1", "10", ""),
            (1, 3, "2026-01-02", "BUY", "AAPL", "1", "10", ""),
            (1, 4, "2026-01-02", "SELL", "AAPL", "1", "10", ""),
            (1, 5, "bad", "BUY", "AAPL", "1", "10", ""),
            (1, 6, "2026-01-02", "入金", "", "", "", "5"),
        ],
        "account_id long, source_row_number long, date string, type string, symbol string, qty string, price string, amount string",
    )
    parsed = ingest.parse_transactions(raw)
    assert {r.source_row_number: r.reject_reason for r in ingest.rejected(parsed).collect()} == {5: "INVALID_DATE", 6: "MISSING_FX_RATE"}
    good = rows(ingest.accepted(parsed), "source_row_number")
    assert good[2].content_hash == good[3].content_hash and good[2].row_hash != good[3].row_hash
    assert good[4].quantity == -1 and good[4].amount_foreign == 10


def test_file_rows_keep_their_numbers_across_blocks(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("date,qty\n" + "".join(f"2026-01-01,{i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = files.read_transactions(spark, str(path)).select("source_row_number", "qty").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted((r[0], int(r[1])) for r in got) == [(i + 2, i) for i in range(5000)]


def test_number_within_blocks(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7).alias("n"), (F.col("id") % 3).alias("k"))
    got = number_within(df, ["k"], "n", "rank", block=100).orderBy("k", "n").collect()
    for k in range(3):
        assert [r["rank"] for r in got if r["k"] == k] == list(range(1, sum(r["k"] == k for r in got) + 1))


def test_number_within_large_and_small_keys(spark):
    df = spark.createDataFrame([(k, n) for k, size in ((1, 30), (2, 4), (None, 3)) for n in range(size)] + [(2, None)], "k long, n long")
    got = [tuple(r) for r in number_within(df, ["k"], "n", "rank", block=10).collect()]
    assert sorted(got) == [(1, n, n + 1) for n in range(30)] + [(2, n, n + 1) for n in range(4)]
    plain = number_within(df, ["k"], "n", "rank")
    assert plain._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(tuple(r) for r in plain.collect()) == sorted(got)


def test_packed_hashes(spark):
    texts = ["ab" * 32, "AB" * 32, "x", "", "ab" * 31, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("k", hashing.packed(F.col("t")))
    got = df.select("t", hashing.unpacked(F.col("k")).alias("back"), F.octet_length("k").alias("size")).collect()
    assert [r["back"] for r in got] == texts
    assert [r["size"] for r in got] == [32, 97, 34, 33, 95, None]


def test_first_identity_in_one_shuffle(spark):
    rows = spark.createDataFrame(
        [(1, "a", 2, "late", 2), (1, "a", 1, "early", 1), (1, "b", 3, "own", 2), (2, "a", 1, "other", 2), (None, "a", 1, "none", 1), (1, None, 5, "none", 1)],
        "account_id long, row_hash string, source_row_number long, transaction_id string, revision int",
    )
    got = versions.first_identity(rows)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted((r["account_id"], r["row_hash"], r["revision"], r["first_id"]) for r in got.collect()) == [
        (1, "a", 1, "early"), (1, "a", 2, "early"), (1, "b", 2, "own"), (2, "a", 2, "other")
    ]


def test_roots():
    days = np.array([0.0, 365.0, 730.0])
    two = np.array([-1000.0, 2300.0, -1320.0])
    assert [round(r, 6) for r in distinct_roots(days, two)] == [0.1, 0.2]
    assert distinct_roots(days[:2], np.array([-1.0, -1.0])) == []


def test_xirr_reports_only_unique_rates(spark):
    flows = [("a", "2025-01-01", -100.0), ("a", "2026-01-01", 110.0), ("b", "2024-01-01", -1000.0), ("b", "2024-12-31", 2300.0), ("b", "2025-12-31", -1320.0)]
    df = spark.createDataFrame([(k, day(d), a) for k, d, a in flows], "account_id string, date date, amount double")
    got = rows(xirr(df), "account_id")
    assert got["a"].xirr == pytest.approx(0.1) and (got["b"].root_count, got["b"].xirr) == (2, None)


def test_schedule_clamps_to_month_ends(spark):
    df = spark.sql("select date'2026-01-31' as s, date'2026-03-31' as e, date'2026-03-30' as f")
    assert column(df, market.monthly_dates(F.col("s"), F.col("e"))) == [[day("2026-01-31"), day("2026-02-28"), day("2026-03-31")]]
    assert column(df, market.monthly_dates(F.col("s"), F.col("f"))) == [[day("2026-01-31"), day("2026-02-28")]]
    assert column(df, market.monthly_dates(F.col("e"), F.col("s"))) == [[]]


def test_freshness(spark):
    df = spark.sql("select date'2026-01-05' as t, explode(array(date'2026-01-01', date'2025-12-31', date'2026-01-06', null)) as d")
    assert column(df, market.freshness_reason(F.col("d"), F.col("t"))) == ["CURRENT", "AGE_LIMIT_EXCEEDED", "FUTURE_DATE", "MISSING_DATE"]


def test_backtest_golden(spark):
    days = ["2026-01-01", "2026-02-01", "2026-03-01", "2026-04-01"]
    prices = spark.createDataFrame([("A", day(d), p) for d, p in zip(days, (100.0, 110.0, 121.0, 133.1))], "ticker string, date date, price_twd double")
    request = spark.createDataFrame(
        [(1, 1, day(days[0]), day(days[-1]), 100.0, [("A", 1.0)])],
        "request_id long, account_id long, start_date date, end_date date, monthly_amount double, allocations array<struct<ticker:string,weight:double>>",
    )
    tx = transactions(spark, [(2, "2026-01-01", "SECURITY", "X", "TWD", 1, 100, 100, 1, 0), (3, "2026-02-01", "SECURITY", "X", "TWD", -1, 50, 50, 1, 0)])
    summary, curve = backtest.compare(request, prices, tx)
    got = rows(summary, "mode")
    assert got["DCA"].terminal_value_twd == pytest.approx(464.1) and got["LUMP_SUM"].terminal_value_twd == pytest.approx(532.4)
    assert got["LUMP_SUM"].cumulative_twr == pytest.approx(0.331)
    assert got["TRANSACTION_REPLAY"].terminal_value_twd == pytest.approx((100 * 1.1 - 50) * 1.21)
    assert {r.mode: r["count"] for r in curve.groupBy("mode").count().collect()} == {"DCA": 4, "LUMP_SUM": 4, "TRANSACTION_REPLAY": 4}


def test_contributions_to_several_legs(spark):
    days = [(1, day("2026-01-05"), [0.6, 0.4], [10.0, 20.0]), (1, day("2026-01-06"), [0.6, 0.4], [12.0, 25.0]), (1, day("2026-01-07"), [0.6, 0.4], [6.0, 50.0])]
    calendar = spark.createDataFrame(days, "request_id long, date date, weights array<double>, prices array<double>")
    paid = [(1, "DCA", day("2026-01-05"), 100.0), (1, "DCA", day("2026-01-07"), 100.0), (1, "LUMP_SUM", day("2026-01-06"), 200.0)]
    flows = spark.createDataFrame(paid, "request_id long, mode string, execution_date date, amount_twd double")
    values = backtest.contribution_values(flows, calendar)
    plan = values._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
    got = {(r["mode"], r["date"].day): (round(r["value_before"], 9), round(r["value_after"], 9)) for r in values.collect()}
    assert got == {("DCA", 5): (0, 100), ("DCA", 6): (122, 122), ("DCA", 7): (136, 236), ("LUMP_SUM", 6): (0, 200), ("LUMP_SUM", 7): (220, 220)}


def test_a_version_is_moved_once_and_published_as_it_lies(spark, tmp_path, monkeypatch):
    """Rows are hashed and numbered where they are written; the manifest is counted from the written rows."""
    from foliometry.plans import queries_versions
    from foliometry.sources import store

    trades = [(29 * n + 3, "2026-01-02", "SECURITY", "A", "TWD", 1, 10, 10, 1, 0) for n in (1, 2)]
    tx = transactions(spark, trades).unionByName(transactions(spark, trades[:1], account=2))
    for revision, counts in ((1, {1: 4, 2: 2}), (2, {1: 5, 2: 3})):
        version = queries_versions._version(tx, revision)
        plan = version._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1
        folder = str(tmp_path / str(revision))
        store.publish_version(version, folder, revision, shards=queries_versions.SHARDS, placed=True)
        got = store.read_dataset(spark, folder, revision, shards=queries_versions.SHARDS)
        assert "shard" not in got.columns and {r.account_id: r.n for r in got.groupBy("account_id").agg(F.count_distinct("row_hash").alias("n")).collect()} == counts
        assert {r.account_id: r.row_count for r in store.read_manifest(spark, folder).collect()} == counts
        assert store.read_dataset(spark, folder, revision, account_id=2, shards=queries_versions.SHARDS).count() == counts[2]


def test_common_numbers_need_no_lambda(spark):
    """number_cell prints as number_text does; only its odd forms are left to the lambda."""
    odd = [None, 0.0, -0.0, 1.0, -1.0, 0.5, 1e-3, 9.99e-4, 1e-7, 9999999.5, 1e7, 1.5e7, 12345678.9, 9.9e14, 1e15, 1e15 + 1, 9.3e18, 1e21, -2.5e22, 30.1, float("nan"), float("inf"), -float("inf")]
    df = spark.createDataFrame([(x,) for x in odd], "x double")
    got = df.select(hashing.number_text(F.col("x")).alias("a"), hashing.number_cell(F.col("x")).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] and len(got) == len(odd)
    priced = df.withColumnRenamed("x", "price")
    assert [r[0] for r in priced.select(hashing.canonical(priced, ("price", "note"))).collect()] == [r.a + "|" for r in got]


def test_lineage_takes_the_content_hash_of_its_rows(spark):
    """Rows that bring the hash of their content get the same plan as rows that do not, and no column more."""
    a, b = ("2026-01-01", "SECURITY"), ("2026-01-02", "SECURITY")
    old = [(2, *a, "X", "TWD", 1, 10, 10, 1, 0), (3, *a, "X", "TWD", 1, 10, 10, 1, 0), (4, *b, "Y", "TWD", 2, 10, 20, 1, 0)]
    new = [(2, *a, "X", "TWD", 1, 10, 10, 1, 0), (4, *b, "Y", "TWD", 2, 11, 22, 1, 0), (5, *b, "Z", "TWD", 1, 10, 10, 1, 0)]
    both = versions.sides(hashed(transactions(spark, old)), hashed(transactions(spark, new)))
    both = both.withColumn("transaction_id", F.when(~F.col("incoming"), F.concat(F.lit("id"), F.col("source_row_number")))).repartition(2, "account_id")
    plain = lineage.plan_of(both)
    brought = lineage.plan_of(both.withColumn("content_hash", hashing.content_hash(both)))
    assert brought.columns == plain.columns
    assert sorted(map(str, brought.collect())) == sorted(map(str, plain.collect())) and plain.count() == 3


def test_files_are_read_once_for_their_rows(spark, tmp_path):
    """Row numbers and places of columns come from a written table of blocks, not from another pass over the files."""
    (tmp_path / "a.csv").write_text('date,Qty,memo\n2026-01-02,1,"x, ""y""\nz"\n2026-1-3,2,\n')
    (tmp_path / "b.csv").write_text("memo,date,股數\nlast,2026/1/4,3\n")
    got = files.read_transactions(spark, str(tmp_path / "*.csv"))
    assert got._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 1
    cells = {(r.account_id[-5:], r.source_row_number): (r["date"], r["quantity"], r["memo"]) for r in got.collect()}
    assert cells == {("a.csv", 2): ("2026-01-02", "1", 'x, "y"\nz'), ("a.csv", 3): ("2026-1-3", "2", None), ("b.csv", 2): ("2026/1/4", "3", "last")}
    days = spark.createDataFrame([("2026-01-02",), ("2026-02-30",), ("2026-01-02\u2028",), ("2026/1-2",), ("2026-1-2",)], "x string")
    assert [r[0] and r[0].day for r in days.select(parsing.calendar_date(F.col("x"))).collect()] == [2, None, 2, None, 2]


def test_forward_as_of_reads_each_day_once(spark):
    """A frame that ends behind the last row is read anew for every row."""
    calendar = spark.createDataFrame([(1, day("2026-01-05")), (1, day("2026-01-09")), (1, day("2026-01-09")), (2, day("2026-01-07"))], "request_id long, date date")
    asked = [(1, None), (1, day("2026-01-01")), (1, day("2026-01-05")), (1, day("2026-01-06")), (1, day("2026-01-10")), (2, day("2026-01-06")), (3, day("2026-01-06"))]
    found = next_trading_date(calendar, spark.createDataFrame(asked, "request_id long, date date"))
    assert "unboundedfollowing" not in found._jdf.queryExecution().executedPlan().toString().lower()
    got = {(r.request_id, r.date and r.date.day): r.execution_date and r.execution_date.day for r in found.collect()}
    assert got == {(1, None): 5, (1, 1): 5, (1, 5): 5, (1, 6): 9, (1, 10): None, (2, 6): 7, (3, 6): None}


def test_days_of_a_request_are_moved_with_it(spark):
    """Bars that are broadcast meet the legs where their request lies; payments reach its days as one row."""
    prices = F.broadcast(spark.createDataFrame([("A", day("2026-01-05"), 10.0), ("B", day("2026-01-05"), 20.0), ("A", day("2026-01-06"), 11.0)], "ticker string, date date, price_twd double"))
    request = spark.createDataFrame(
        [(1, 1, day("2026-01-01"), day("2026-02-01"), 100.0, [("A", 0.6), ("B", 0.4)])],
        "request_id long, account_id long, start_date date, end_date date, monthly_amount double, allocations array<struct<ticker:string,weight:double>>",
    )
    moved = lambda df: re.findall(r"Exchange hashpartitioning\(([^)]*)", df._jdf.queryExecution().executedPlan().toString())
    calendar = backtest.market_calendar(request, prices)
    assert len(moved(calendar)) == 1 and "date" not in moved(calendar)[0]
    assert [(r.date, r.weights, r.prices) for r in calendar.collect()] == [(day("2026-01-05"), [0.6, 0.4], [10.0, 20.0])]
    flows = spark.createDataFrame([(1, "DCA", day("2026-01-05"), 100.0), (1, "DCA", None, 50.0)], "request_id long, mode string, execution_date date, amount_twd double")
    values = backtest.contribution_values(flows, calendar)
    assert not [keys for keys in moved(values) if re.search(r"(^|, )date#", keys)]
    assert [(r["date"], r["value_before"], r["value_after"]) for r in values.collect()] == [(day("2026-01-05"), 0, 100)]


def test_unions_promise_no_partitioning(spark):
    """As in data_quality: a join above a union whose parts are coalesced differently while the query runs."""
    plain_unions(spark)
    assert spark.conf.get("spark.sql.unionOutputPartitioning") == "false"
    part = lambda n: spark.range(n).select((F.col("id") % 7).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    plan = part(50).unionByName(part(90)).groupBy("k").agg(F.sum("n").alias("n"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3


def test_replay_overdraft_blocks_only_replay(spark):
    prices = spark.createDataFrame([("A", day("2026-01-01"), 100.0), ("A", day("2026-02-01"), 50.0)], "ticker string, date date, price_twd double")
    request = spark.createDataFrame(
        [(1, 1, day("2026-01-01"), day("2026-02-01"), 100.0, [("A", 1.0)])],
        "request_id long, account_id long, start_date date, end_date date, monthly_amount double, allocations array<struct<ticker:string,weight:double>>",
    )
    tx = transactions(spark, [(2, "2026-01-01", "SECURITY", "X", "TWD", 1, 100, 100, 1, 0), (3, "2026-02-01", "SECURITY", "X", "TWD", -1, 80, 80, 1, 0)])
    got = rows(backtest.compare(request, prices, tx)[0], "mode")
    assert got["TRANSACTION_REPLAY"].issue_codes == "REPLAY_WITHDRAWAL_EXCEEDS_VALUE"
    assert got["TRANSACTION_REPLAY"].terminal_value_twd is None and got["DCA"].terminal_value_twd is not None


def hashed(df):
    df = df.withColumn("content_hash", hashing.content_hash(df))
    numbered = number_within(df, ["account_id", "content_hash"], "source_row_number", "occurrence")
    return numbered.withColumn("row_hash", hashing.occurrence_hash(F.col("content_hash"), F.col("occurrence"))).drop("content_hash", "occurrence")


def test_lineage_cases(spark):
    """One account per case, planned together."""
    a, b = "2026-01-01", "2026-01-02"
    cases = {
        # unchanged and added
        1: ([(2, a, "X", 10)], [(2, a, "X", 10), (3, a, "Y", 1)], {2: ("UNCHANGED", "id2", False), 3: ("NEW", None, False)}),
        # repriced, same trade
        2: ([(2, a, "X", 10)], [(5, a, "X", 11)], {5: ("CORRECTED", "id2", False)}),
        # re-dated on its own row
        3: ([(2, a, "X", 10)], [(2, b, "X", 10)], {2: ("CORRECTED", "id2", False)}),
        # one deleted, one repriced: no guess
        4: ([(2, a, "X", 10), (3, b, "X", 20)], [(2, a, "X", 11)], {2: ("NEW", None, True)}),
        # both repriced, dates unchanged
        5: ([(2, a, "X", 10), (3, b, "X", 20)], [(2, a, "X", 11), (3, b, "X", 21)], {2: ("CORRECTED", "id2", False), 3: ("CORRECTED", "id3", False)}),
        # a repeated fill vanished
        6: ([(2, a, "X", 10), (3, a, "X", 10)], [(2, a, "X", 10)], {2: ("NEW", None, True)}),
        # everything removed
        7: ([(2, a, "X", 10)], [], {}),
    }
    security = lambda n, d, k, p: (n, d, "SECURITY", k, "TWD", 1, p, p, 1, 0)

    def side(i):
        parts = [transactions(spark, [security(*r) for r in case[i]], account=n) for n, case in cases.items() if case[i]]
        return hashed(functools.reduce(lambda x, y: x.unionByName(y), parts))

    before = side(0).withColumn("transaction_id", F.concat(F.lit("id"), F.col("source_row_number")))
    result = lineage.lineage_plan(before, side(1))
    got = {n: {} for n in cases}
    for r in result.collect():
        got[r.account_id][r.source_row_number] = (r.kind, r.transaction_id, r.ambiguous)
    assert got == {n: case[2] for n, case in cases.items()}
    summary = rows(lineage.plan_summary(result, before), "account_id")
    assert (summary[4].removed, summary[4].ambiguous) == (2, 1) and summary[7].removed == 1


def test_diff_counts_hashes_once(spark):
    base = "account_id long, row_hash string, trade_date date, source_row_number long"
    old = spark.createDataFrame([(1, "a", day("2026-01-01"), 2), (1, "b", day("2026-01-01"), 3)], base)
    new = spark.createDataFrame([(1, "a", day("2026-01-01"), 2), (1, "a", day("2026-01-01"), 3)], base)
    d = versions.dataset_diff(old, new).first()
    assert (d.added, d.removed, d.unchanged_rows, d.unchanged) == (0, 1, 1, False)
    assert [r.change for r in versions.diff_samples(old, new).collect()] == ["REMOVED"]


def test_versions_that_lie_by_account_are_not_moved_again(spark):
    """One table of both versions gives what two give, without another exchange."""
    security = lambda n, d, k, p: (n, d, "SECURITY", k, "TWD", 1, p, p, 1, 0)
    old = [security(n, f"2026-01-{n:02d}", "XY"[n % 2], n // 3) for n in range(2, 20)]
    new = [security(n + n // 9, f"2026-01-{n:02d}", "XY"[n % 2], n // 2) for n in range(2, 23) if n % 5]
    before, after = ([transactions(spark, side, account=a) for a in (1, 2, 3)] for side in (old, new))
    before, after = (hashed(functools.reduce(lambda x, y: x.unionByName(y), side)) for side in (before, after))
    before = before.withColumn("transaction_id", F.concat(F.lit("id"), F.col("source_row_number")))
    both = after.withColumns({"transaction_id": F.lit(None).cast("string"), "incoming": F.lit(True)}).unionByName(before.withColumn("incoming", F.lit(False)))
    placed = spark.createDataFrame(both.collect(), both.schema).repartition(3, "account_id")
    pairs = [
        (versions.diff_of(placed), versions.dataset_diff(before, after)),
        (versions.samples_of(placed.drop("transaction_id")), versions.diff_samples(before.drop("transaction_id"), after)),
        (lineage.plan_of(placed), lineage.lineage_plan(before, after)),
    ]
    for one, two in pairs:
        assert one._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
        assert sorted(map(str, one.select(*two.columns).collect())) == sorted(map(str, two.collect()))


def test_bar_stream_replay_is_idempotent_and_newest_wins(spark, tmp_path):
    source, folder = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    schema = "market_id long, instrument_type string, ticker string, currency string, date date, raw_close double, adjusted_close double"

    def land(name, close):
        (source / name).write_text(f'{{"market_id":0,"instrument_type":"SECURITY","ticker":"A","currency":"USD","date":"2026-01-01","raw_close":{close}}}\n')

    stream = lambda progress: bar_stream.merge_stream(
        spark.readStream.schema(schema).json(str(source)), folder, str(tmp_path / progress)
    ).awaitTermination()
    land("a.json", 1.0)
    stream("p")
    land("b.json", 2.0)
    stream("p")
    assert [r.raw_close for r in bar_stream.read_merged(spark, folder).collect()] == [2.0]
    assert spark.read.parquet(folder).count() == 2
    stream("p")
    assert spark.read.parquet(folder).count() == 2


def test_query_surface_refuses_what_is_not_registered(spark):
    for query, code in (
        (dict(name="nothing"), "UNKNOWN_RESOURCE"),
        (dict(name="positions", fields=["secret"]), "INVALID_FIELD"),
        (dict(name="positions", filters={"note": 1}), "INVALID_FILTER"),
        (dict(name="positions", sort=("price_native", "asc")), "INVALID_SORT"),
    ):
        with pytest.raises(resources.QueryError) as e:
            resources.select(None, **query)
        assert e.value.code == code
    with pytest.raises(resources.QueryError) as e:
        resources.page(None, "strategy_comparison", limit=10)
    assert e.value.code == "PAGINATION_NOT_SUPPORTED"
    with pytest.raises(resources.QueryError) as e:
        resources.decode_cursor("positions", resources.encode_cursor("transactions", 5))
    assert e.value.code == "INVALID_CURSOR"


def test_catalogue(spark):
    names = [r.name for r in resources.list_resources(spark).collect()]
    assert names == sorted(names) and len(names) == 10
    assert [r.name for r in resources.list_metrics(spark).collect()] == sorted(resources.METRICS)
    assert resources.describe(spark, "positions").where("sortable").count() == 5


def test_filters_keep_the_null_date_rule(spark):
    from foliometry.functions.search import equals_text, from_date, to_date

    df = spark.createDataFrame([(datetime.date(2026, 1, 1), "a"), (None, None)], "d date, s string")
    assert df.where(from_date(F.col("d"), "2026-01-01")).count() == 2
    assert df.where(to_date(F.col("d"), "2026-01-01")).count() == 1
    assert df.where(equals_text(F.col("s"), "A")).count() == 1 and df.where(equals_text(F.col("s"), None)).count() == 1


def test_pages_by_key_give_every_row_once(spark):
    """Nulls, ties and equal rows across page borders, ascending and descending."""
    rows = [(k % 3, ["CASH", "VALUATION"][k % 2], "C", None if k % 4 == 0 else datetime.date(2020, 1, 1 + k % 5), None if k % 5 == 0 else f"T{k % 2}") for k in range(60)]
    schema = "account_id long, domain string, code string, date date, symbol string"
    frame = spark.createDataFrame(rows, schema).selectExpr("account_id", "domain", "code", "'m' AS message", "'BLOCKING' AS severity", "date", "symbol")
    name = "data_quality"
    original = resources.RESOURCES[name]
    resources.RESOURCES[name] = dataclasses.replace(original, build=lambda _book: frame)
    try:
        for sort in (None, ("date", "asc"), ("date", "desc"), ("symbol", "desc")):
            order = resources._order(resources.RESOURCES[name], sort)
            whole = [tuple(r) for r in frame.select(*[f.name for f in original.fields]).orderBy(*[F.col(c).desc_nulls_last() if d else F.col(c).asc_nulls_first() for c, d in order]).collect()]
            got, cursor = [], None
            while True:
                page, cursor = resources.page(None, name, limit=7, cursor=cursor, sort=sort)
                got += [tuple(r) for r in page.collect()]
                if cursor is None:
                    break
            assert got == whole
        with pytest.raises(resources.QueryError) as e:
            resources.page(None, name, cursor=resources.page(None, name, limit=5)[1], sort=("date", "asc"))
        assert e.value.code == "INVALID_CURSOR"
    finally:
        resources.RESOURCES[name] = original
