import dataclasses
import random

import numpy as np
import pytest
from builders import FUNDING, FUNDING_MARKS, day, marks, rows, snapshot, transactions
from pyspark.sql import functions as F

from foliometry.operators import cash_ledger, flows, fx_ledger, gate, nav, position_ledger, returns, valuation
from foliometry.plans.account import Book


def near(x):
    return pytest.approx(x, abs=1e-6)


def funding_book(spark, extra=(), extra_marks=(), date="2026-06-30"):
    tx = transactions(spark, [*FUNDING, *extra])
    fresh = spark.createDataFrame([(1, "CURRENT", None)], "account_id long, freshness string, freshness_issue string")
    return Book(tx, marks(spark, [*FUNDING_MARKS, *extra_marks]), snapshot(spark, date), fresh)


def test_moving_average_partial_sale(spark):
    tx = transactions(
        spark,
        [
            (2, "2026-01-01", "SECURITY", "A", "TWD", 10, 1000, 10000, 1, 20),
            (3, "2026-01-02", "SECURITY", "A", "TWD", 10, 1200, 12000, 1, 20),
            (4, "2026-01-03", "SECURITY", "A", "TWD", -5, 1300, 6500, 1, 10),
        ],
    )
    ledger = position_ledger.position_ledger(tx)
    p = position_ledger.positions(ledger).first()
    assert (p.quantity, p.cost_basis, p.average_unit_cost, p.realized_pnl) == (15, near(16530), near(1102), near(980))
    assert position_ledger.currency_totals(ledger).first().net_security_cash_flow == near(-15550)


def test_oversell_and_currency_mismatch_block_only_their_row(spark):
    tx = transactions(
        spark,
        [
            (2, "2026-01-01", "SECURITY", "A", "USD", 5, 10, 50, 30, 0),
            (3, "2026-01-02", "SECURITY", "A", "USD", -6, 10, 60, 30, 0),
            (4, "2026-01-03", "SECURITY", "A", "TWD", 5, 10, 50, 1, 0),
            (5, "2026-01-04", "SECURITY", "A", "USD", -5, 12, 60, 30, 0),
        ],
    )
    got = rows(position_ledger.position_ledger(tx), "source_row_number")
    assert [got[n].issue_code for n in (2, 3, 4, 5)] == [None, "OVERSELL", "CURRENCY_MISMATCH", None]
    assert got[5].quantity_after == 0 and got[5].realized_delta == near(10)


def test_order_is_date_then_row_whatever_the_input_order(spark):
    shuffled = FUNDING[:]
    random.Random(3).shuffle(shuffled)
    a = fx_ledger.security_basis(fx_ledger.fx_ledger(transactions(spark, FUNDING)))
    b = fx_ledger.security_basis(fx_ledger.fx_ledger(transactions(spark, shuffled)))
    assert sorted(a.collect()) == sorted(b.collect())


def test_funding_sequence(spark):
    book = funding_book(spark)
    basis = rows(book.basis, "ticker")
    want = {"AAPL": 12820, "MSFT": 16025, "NVDA": 4807.5, "GOOG": 32290, "2330.TW": 8000}
    assert {k: r.twd_cost_basis for k, r in basis.items()} == {k: near(v) for k, v in want.items()}
    pool = book.pools.first()
    assert pool.automatic_units_in == near(55) and pool.units == 0
    total = book.totals.first()
    assert total.known_position_value_twd == near(83380)
    assert total.known_cash_value_twd == near(26257.5)
    assert total.total_assets_twd == near(109637.5)
    done = book.reconciliation.first()
    assert done.total_unrealized_pnl_twd == near(9437.5) and done.total_realized_pnl_twd == near(200)


def test_xirr_of_the_funding_sequence(spark):
    book = funding_book(spark)
    terminal = book.totals.select("account_id", "valuation_date", "complete", "total_assets_twd")
    summary = flows.performance_summary(book.tx, terminal).first()
    assert summary.xirr == pytest.approx(0.20511425515474535, abs=1e-10)
    assert summary.complete and summary.issue_codes == ""


def test_conflicting_newest_mark_hides_an_older_clean_one(spark):
    book = funding_book(spark, extra_marks=[("2026-06-01", "PRICE", "AAPL", "USD", 240), ("2026-06-30", "PRICE", "AAPL", "USD", 251, "B")])
    total = book.totals.first()
    assert total.total_assets_twd is None and total.blocking_issue_count == 2
    codes = {r.issue_code for r in valuation.valuation_issues(book.components, book.marks, book.snapshots).collect()}
    assert codes == {"CONFLICTING_MARK", "MISSING_PRICE"}


def test_agreeing_sources_pick_the_first_source_and_future_marks_are_ignored(spark):
    book = funding_book(spark, extra_marks=[("2026-06-30", "PRICE", "AAPL", "USD", 250, "A"), ("2026-07-01", "PRICE", "AAPL", "USD", 999)])
    part = book.components.where("ticker = 'AAPL'").first()
    assert (part.price, part.price_source) == (250, "A")
    assert book.totals.first().future_mark_count == 1


def test_cash_issue_codes(spark):
    tx = transactions(
        spark,
        [
            (2, "2026-01-01", "CASH_IN", "", "TWD", 0, 0, 10, 1, 20),
            (3, "2026-01-02", "CASH_OUT", "", "TWD", 0, 0, 5, 1, 0),
            (4, "2026-01-03", "FX_BUY", "", "TWD", 0, 0, 5, 1, 0),
            (5, "2026-01-03", "FX_BUY", "", "USD", 0, 0, 5, None, 0),
            (6, "2026-01-04", "FX_SELL", "", "USD", 0, 0, 5, 30, 0),
            (7, "2026-01-05", "SECURITY", "A", "USD", 1, 5, 5, None, 0),
            (8, "2026-01-05", "SECURITY", "A", "USD", 1, 5, 5, 30, 0),
            (9, "2026-01-06", "SECURITY", "B", "TWD", 1, 5, 5, 1, 0),
            (10, "2026-01-07", "SECURITY", "B", "TWD", -1, 1, 1, 1, 9),
            (11, "2026-01-08", "CASH_IN", "", "USD", 0, 0, 100, 30, 0),
            (12, "2026-01-09", "FX_SELL", "", "USD", 0, 0, 1, 30, 99),
        ],
    )
    ledger = cash_ledger.cash_ledger(tx)
    codes = {r.source_row_number: r.issue_code for r in ledger.where("issue_code is not null").collect()}
    assert codes == {
        2: "NEGATIVE_NET_CASH_IN",
        3: "CASH_OUT_EXCEEDS_BALANCE",
        4: "INVALID_FX_CURRENCY",
        5: "MISSING_FX_RATE",
        6: "FX_SELL_EXCEEDS_BALANCE",
        7: "MISSING_FX_RATE_FOR_AUTO_FUND",
        8: "INSUFFICIENT_TWD_FOR_AUTO_FUND",
        9: "INSUFFICIENT_CASH_FOR_SECURITY_BUY",
        10: "NEGATIVE_NET_SECURITY_PROCEEDS",
        12: "NEGATIVE_NET_FX_PROCEEDS",
    }


def test_untracked_account_has_no_wallets(spark):
    tx = transactions(spark, [(2, "2026-01-01", "SECURITY", "A", "TWD", 1, 5, 5, 1, 0)])
    assert cash_ledger.cash_ledger(tx).count() == 0
    assert cash_ledger.tracking(tx).first().tracking_mode == "UNTRACKED"


def test_gate_reports_a_row_once(spark):
    book = funding_book(spark, extra=[(10, "2026-06-11", "SECURITY", "GOOG", "USD", -9, 1, 9, 33, 0)])
    issues = gate.activation_issues(book.security_ledger, book.cash_ledger, book.fx_ledger).collect()
    assert [(i.domain, i.issue_code) for i in issues] == [("SECURITY_ACCOUNTING", "OVERSELL")]


@pytest.mark.parametrize("name", ["position", "cash", "fx"])
def test_sliced_fold_equals_whole_fold(spark, name):
    """A key larger than the slice is folded slice by slice, with the same rows as a single pass."""
    rng = random.Random(11)
    data = []
    for n in range(2, 400):
        kind = rng.choice(["SECURITY"] * 6 + ["CASH_IN", "CASH_OUT", "FX_BUY", "FX_SELL"])
        foreign = rng.random() < 0.6
        security = kind == "SECURITY"
        fx_kind = kind.startswith("FX")
        currency = "USD" if fx_kind or foreign else "TWD"
        rate = 1 if currency == "TWD" else (None if rng.random() < 0.1 else 30 + rng.random())
        quantity = rng.choice([-7, -3, 2, 5, 9]) if security else 0
        ticker = (currency[0] + rng.choice("AB")) if security else ""
        amount = round(rng.uniform(1, 900), 2)
        data.append((n, f"2026-{1 + n // 40:02d}-{1 + n % 28:02d}", kind, ticker, currency, quantity, 10, amount, rate, round(rng.random(), 2)))
    tx = transactions(spark, data).unionByName(transactions(spark, data[:20], account=2))
    fold = {"position": position_ledger.position_ledger, "cash": cash_ledger.cash_ledger, "fx": fx_ledger.fx_ledger}[name]
    whole, sliced = fold(tx), fold(tx, 25)
    key = lambda r: str(r)
    assert sorted(whole.collect(), key=key) == sorted(sliced.select(*whole.columns).collect(), key=key)


NAV_ROWS = [
    (2, "2026-01-01", "CASH_IN", "", "TWD", 0, 0, 10000, 1, 0),
    (3, "2026-01-02", "SECURITY", "AAA", "TWD", 10, 50, 500, 1, 0),
    (4, "2026-02-01", "SECURITY", "BBB", "USD", 2, 100, 200, 32, 0),
    (5, "2026-03-01", "SECURITY", "AAA", "TWD", -5, 60, 300, 1, 0),
]
NAV_MARKS = [
    ("2026-01-02", "PRICE", "AAA", "TWD", 50),
    ("2026-02-01", "PRICE", "AAA", "TWD", 55),
    ("2026-03-01", "PRICE", "AAA", "TWD", 60),
    ("2026-02-01", "PRICE", "BBB", "USD", 100),
    ("2026-03-01", "PRICE", "BBB", "USD", 110),
    ("2026-02-01", "FX", "", "USD", 32),
    ("2026-03-01", "FX", "", "USD", 33),
]


def nav_of(spark, data, dates):
    from builders import day

    book = Book(transactions(spark, data), marks(spark, NAV_MARKS), snapshot(spark, "2026-03-15"), None)
    asked = spark.createDataFrame([(1, day(d)) for d in dates], "account_id long, as_of date")
    return nav.nav_points(
        book.tx, book.security_ledger, book.cash_ledger, book.fx_ledger, book.tracking, book.marks, book.snapshots, asked
    )


def test_holdings_answer_every_date_from_one_shuffle_by_account(spark):
    """A state answers the dates up to the key's next one; the answers are not moved again."""
    d = lambda n: day(f"2026-01-{n:02d}")
    ledger = spark.createDataFrame(
        [(1, "A", "TWD", d(3), 5.0, 1, None), (1, "A", "TWD", d(3), 7.0, 2, None), (1, "A", "TWD", d(5), None, 3, None), (1, "A", "TWD", d(9), 2.0, 4, None),
         (1, "B", "TWD", d(4), 1.0, 1, None), (1, "B", "TWD", d(6), 0.0, 2, None), (2, "A", "TWD", d(1), 4.0, 1, None), (3, "A", "TWD", d(1), 4.0, 1, None)],
        "account_id long, ticker string, currency string, trade_date date, quantity_after double, step long, issue_code string",
    )
    asked = [(1, n) for n in (10, 2, 3, 4, 8, 9)] + [(2, 1), (2, 30)]
    dates = spark.createDataFrame([(a, 0, d(n)) for a, n in asked], "account_id long, snapshot_id long, as_of date")
    held = nav.holdings_on_dates(ledger, dates)
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    got = {(r.account_id, r.ticker, r.as_of.day): r.quantity for r in held.collect()}
    first = {(1, "A", 3): 7.0, (1, "A", 4): 7.0, (1, "A", 8): 7.0, (1, "A", 9): 2.0, (1, "A", 10): 2.0, (1, "B", 4): 1.0}
    assert got == first | {(2, "A", 1): 4.0, (2, "A", 30): 4.0}

def test_nav_never_looks_ahead(spark):
    got = nav_of(spark, NAV_ROWS, ["2026-01-15", "2026-02-15", "2026-03-15"]).orderBy("as_of").collect()
    assert [r.total_assets_twd for r in got] == [near(10000), near(10050), near(10960)]
    assert [r.transaction_count for r in got] == [2, 3, 4]


def test_cash_is_untracked_before_the_first_cash_row(spark):
    data = [(2, "2026-01-02", "SECURITY", "AAA", "TWD", 10, 50, 500, 1, 0), (3, "2026-02-01", "CASH_IN", "", "TWD", 0, 0, 100, 1, 0)]
    got = nav_of(spark, data, ["2026-01-15", "2026-02-15"]).orderBy("as_of").collect()
    assert got[0].complete and got[0].cash_value_twd == 0
    assert not got[1].complete and got[1].blocking_issue_count == 1


def observations(spark, data):
    from builders import day

    out = [(1, day(d), True, float(a), float(c), float(w)) for d, a, c, w in data]
    return spark.createDataFrame(
        out, "account_id long, date date, complete boolean, total_assets_twd double, contribution_twd double, withdrawal_twd double"
    )


def test_time_weighted_return_and_drawdown(spark):
    obs = observations(spark, [("2026-01-01", 100, 100, 0), ("2026-02-01", 110, 0, 0), ("2026-03-01", 99, 0, 0)])
    s = returns.drawdown_summary(obs).first()
    assert (s.cumulative_twr, s.maximum_drawdown) == (near(-0.01), near(-0.1))
    assert str(s.peak_date) == "2026-02-01" and str(s.trough_date) == "2026-03-01" and s.recovery_date is None
    assert returns.drawdown_summary(obs, "PRICE_ONLY").first().cumulative_twr is None


def test_total_loss_stays_zero_and_bad_denominators_block(spark):
    lost = observations(spark, [("2026-01-01", 100, 0, 0), ("2026-02-01", 0, 0, 0), ("2026-03-01", 50, 50, 0)])
    s = returns.drawdown_summary(lost).first()
    assert (s.cumulative_twr, s.annualized_twr) == (-1.0, -1.0)
    blocked = observations(spark, [("2026-01-01", 100, 0, 0), ("2026-02-01", 0, 0, 0), ("2026-03-01", 50, 0, 0)])
    assert [r.issue_code for r in returns.twr_issues(blocked).collect()] == ["NON_POSITIVE_TWR_DENOMINATOR"]
    assert returns.drawdown_summary(blocked).first().cumulative_twr is None


def test_flows_do_not_count_as_return(spark):
    obs = observations(spark, [("2026-01-01", 100, 0, 0), ("2026-02-01", 160, 50, 0), ("2026-03-01", 110, 0, 50)])
    assert returns.drawdown_summary(obs).first().cumulative_twr == near(160 / 150 * 160 / 160 - 1)


def _random_trades(n, keys, seed, clean):
    rng = random.Random(seed)
    data, held = [], {}
    for k in range(n):
        ticker = f"S{rng.randrange(keys)}"
        sell = rng.random() < 0.45
        most = held.get(ticker, 0)
        quantity = -rng.randrange(1, 9) if sell else rng.randrange(1, 9)
        if clean:
            quantity = -min(-quantity, most) if sell and most else abs(quantity)
        held[ticker] = max(0, most + quantity) if quantity > 0 or most + quantity >= 0 else most
        currency = "USD" if clean or rng.random() < 0.95 else "EUR"
        data.append((k + 1, f"20{20 + k // 400:02d}-{k // 30 % 12 + 1:02d}-{k % 28 + 1:02d}", "SECURITY", ticker, currency, quantity, 10 + k % 7, abs(quantity) * (10 + k % 7), 30, k % 3))
    return data


def test_side_by_side_equals_row_by_row(spark):
    """The column form of every ledger, with refused rows, to the last bit; a block of one key goes row by row."""
    rng = random.Random(8)
    trades = _random_trades(600, 40, 9, clean=False)
    cash = []
    for k in range(300):
        kind = rng.choice(["CASH_IN", "CASH_IN", "CASH_OUT", "FX_BUY", "FX_SELL"])
        currency = rng.choice(["TWD", "USD", "EUR"])
        rate = 1 if currency == "TWD" else rng.choice([None, 30, 31.5])
        cash.append((1000 + k, f"2020-{k % 12 + 1:02d}-{k % 28 + 1:02d}", kind, "", currency, 0, 0, rng.randrange(1, 9000), rate, rng.choice([0, 1, 9000])))
    tx = transactions(spark, trades + cash).withColumn("account_id", F.col("source_row_number") % 25)
    for module, name, build in ((position_ledger, "POSITION_FOLD", position_ledger.position_ledger), (cash_ledger, "CASH_FOLD", cash_ledger.cash_ledger), (fx_ledger, "FX_FOLD", fx_ledger.fx_ledger)):
        kept = getattr(module, name)
        try:
            setattr(module, name, dataclasses.replace(kept, columns=None))
            want = sorted(map(repr, build(tx).collect()))
        finally:
            setattr(module, name, kept)
        assert sorted(map(repr, build(tx).collect())) == want
        assert sum("None" not in w.rsplit("issue_code", 1)[1][:12] for w in want) > 20


def test_small_blocks_and_long_keys(spark, monkeypatch):
    """Blocks of a few rows, so that some keys fill several blocks."""
    import pyarrow as pa
    from pyspark.sql import types as T

    from foliometry.operators import fold

    monkeypatch.setattr(fold, "BLOCK_ROWS", 10)
    spec = position_ledger.POSITION_FOLD
    rows = [(1, t, "USD", None, k, float(q), 10.0 * abs(q), 1.0) for t, n in (("A", 3), ("B", 45), ("C", 2), ("D", 30), ("E", 1)) for k, q in enumerate([5, -2, 4, -9, 3] * 9) if k < n]
    columns = list(zip(*rows))
    kinds = [pa.int64(), pa.string(), pa.string(), pa.date32(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
    whole = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[f"f{i}" for i in range(8)])
    schema = T.StructType([T.StructField("account_id", T.LongType()), T.StructField("ticker", T.StringType()), *spec.outputs.fields, T.StructField("step", T.LongType())])
    for size in (1, 7, 100):
        batches = lambda: iter([whole.slice(k, size) for k in range(0, whole.num_rows, size)])
        got = [r for b in fold._blocks(spec, schema)(batches()) for r in b.to_pylist()]
        want = [r for b in fold._stream(spec, schema, carried=False)(batches()) for r in b.to_pylist()]
        assert got == want


def test_large_clean_keys_are_scanned(spark):
    """Slices side by side give the fold's ledger; keys with a refused row go slice after slice."""
    from foliometry.operators import scan

    for clean in (True, False):
        tx = transactions(spark, _random_trades(700, 3, 4, clean))
        whole, sliced = position_ledger.position_ledger(tx), position_ledger.position_ledger(tx, 40, side_by_side=True)
        order = lambda r: (r.ticker, r.step)
        a, b = sorted(whole.collect(), key=order), sorted(sliced.collect(), key=order)
        assert len(a) == len(b) == 700
        for x, y in zip(a, b):
            assert (x.ticker, x.step, x.source_row_number, x.issue_code) == (y.ticker, y.step, y.source_row_number, y.issue_code)
            for c in ("quantity_after", "cost_after", "realized_delta", "gross_buy", "gross_sell", "fee"):
                assert (x[c] is None) == (y[c] is None)
                assert x[c] is None or y[c] == pytest.approx(x[c], abs=1e-6)
    a, b = scan.affine_prefixes(np.array([2.0, 3.0, 0.0, 1.0]), np.array([1.0, 1.0, 5.0, 2.0]))
    assert a.tolist() == [2, 6, 0, 0] and b.tolist() == [1, 4, 5, 7]
