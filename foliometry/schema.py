"""Column schemas, enumerations and the expressions every operator shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPSILON = 1e-9
BASE_CURRENCY = "TWD"

SECURITY = "SECURITY"
TRANSACTION_TYPES = ("SECURITY", "FX_BUY", "FX_SELL", "CASH_IN", "CASH_OUT")
MARK_TYPES = ("PRICE", "FX")

TRANSACTION = T.StructType(
    [
        T.StructField("account_id", T.LongType()),
        T.StructField("source_row_number", T.LongType()),
        T.StructField("trade_date", T.DateType()),
        T.StructField("transaction_type", T.StringType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("currency", T.StringType()),
        T.StructField("quantity", T.DoubleType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("amount_foreign", T.DoubleType()),
        T.StructField("fx_rate", T.DoubleType()),
        T.StructField("fee", T.DoubleType()),
    ]
)

TRANSACTION_TEXT = ("budget_waterline", "budget_balance", "note")

MARK = T.StructType(
    [
        T.StructField("snapshot_id", T.LongType()),
        T.StructField("source_row_number", T.LongType()),
        T.StructField("mark_date", T.DateType()),
        T.StructField("mark_type", T.StringType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("currency", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("source", T.StringType()),
    ]
)

BAR = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("raw_close", T.DoubleType()),
        T.StructField("adjusted_close", T.DoubleType()),
        T.StructField("row_hash", T.StringType()),
    ]
)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c: str | Column) -> Column:
    """Snap a value closer to zero than EPSILON to exactly zero; null stays null."""
    c = col(c)
    return F.when(F.abs(c) < EPSILON, F.lit(0.0)).otherwise(c)


def gross_native() -> Column:
    """Explicit native amount when positive, else quantity times price."""
    return F.when(F.col("amount_foreign") > 0, F.col("amount_foreign")).otherwise(
        F.abs(F.col("quantity")) * F.col("price")
    )


def twd_rate() -> Column:
    """TWD per native unit: 1 for TWD rows, else the row's own positive finite rate, else null."""
    rate = F.col("fx_rate")
    usable = rate.isNotNull() & ~F.isnan(rate) & (rate > 0) & (rate < float("inf"))
    return F.when(F.col("currency") == BASE_CURRENCY, F.lit(1.0)).when(usable, rate)
