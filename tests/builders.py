"""Small literal tables."""

import datetime

from foliometry.schema import MARK, TRANSACTION


def day(text):
    return datetime.date.fromisoformat(text)


def transactions(spark, rows, account=1):
    """rows: (row, date, type, ticker, currency, quantity, price, amount, fx, fee)"""
    data = [
        (account, r, day(d), t, k, c, float(q), float(p), float(a), None if x is None else float(x), float(f))
        for r, d, t, k, c, q, p, a, x, f in rows
    ]
    return spark.createDataFrame(data, TRANSACTION)


def marks(spark, rows, snapshot=1):
    """rows: (date, type, ticker, currency, value[, source])"""
    data = [(snapshot, i + 2, day(m[0]), m[1], m[2], m[3], float(m[4]), m[5] if len(m) > 5 else "TEST") for i, m in enumerate(rows)]
    return spark.createDataFrame(data, MARK)


def snapshot(spark, date, account=1, snapshot_id=1):
    return spark.createDataFrame([(account, snapshot_id, day(date))], "account_id long, snapshot_id long, valuation_date date")


FUNDING = [
    (2, "2026-01-01", "CASH_IN", "", "TWD", 0, 0, 100000, 1, 0),
    (3, "2026-01-02", "FX_BUY", "", "USD", 0, 0, 2000, 32, 100),
    (4, "2026-01-05", "SECURITY", "2330.TW", "TWD", 10, 1000, 10000, 1, 0),
    (5, "2026-02-03", "SECURITY", "AAPL", "USD", 2, 200, 400, 32.5, 0),
    (6, "2026-03-10", "SECURITY", "2330.TW", "TWD", -2, 1100, 2200, 1, 0),
    (7, "2026-04-15", "SECURITY", "MSFT", "USD", 1, 500, 500, 33, 0),
    (8, "2026-05-20", "SECURITY", "NVDA", "USD", 1, 150, 150, 33.2, 0),
    (9, "2026-06-10", "SECURITY", "GOOG", "USD", 1, 1000, 1000, 33.5, 5),
]

FUNDING_MARKS = [
    ("2026-06-30", "PRICE", "2330.TW", "TWD", 1100),
    ("2026-06-30", "PRICE", "AAPL", "USD", 250),
    ("2026-06-30", "PRICE", "GOOG", "USD", 1050),
    ("2026-06-30", "PRICE", "MSFT", "USD", 550),
    ("2026-06-30", "PRICE", "NVDA", "USD", 160),
    ("2026-06-30", "FX", "", "USD", 33),
]


def rows(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}
