"""Content hashes over canonical text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRANSACTION_FIELDS = (
    "trade_date",
    "transaction_type",
    "ticker",
    "currency",
    "quantity",
    "price",
    "amount_foreign",
    "fx_rate",
    "fee",
    "budget_waterline",
    "budget_balance",
    "note",
)
MARK_FIELDS = ("mark_date", "mark_type", "ticker", "currency", "value", "source")
PROVIDER_BASIS = ("MARKET_PROVIDER", "RAW_CLOSE")


def number_text(c: Column) -> Column:
    """Shortest decimal form: 1.0 prints 1, 1.5E7 prints 15000000, 1.0E-7 prints 1e-7; null is blank."""
    size = F.abs(c)
    plain = c.cast("string")  # reached by fractions from 1e-3 up to 1e7 only, which print without an exponent
    whole = F.when(size < 1e15, c.cast("bigint").cast("string")).otherwise(c.cast("decimal(38,0)").cast("string"))
    expanded = F.regexp_replace(F.regexp_replace(c.cast("string").cast("decimal(38,18)").cast("string"), "0+$", ""), r"\.$", "")
    exponent = F.lower(F.regexp_replace(F.regexp_replace(c.cast("string"), r"\.0E", "E"), r"E(\d)", "E+$1"))
    return (
        F.when(c.isNull() | F.isnan(c) | (size == float("inf")), "")
        .when(size == 0, "0")
        .when((size >= 1e21) | (size < 1e-6), exponent)
        .when((c == F.floor(c)), whole)
        .when((size >= 1e7) | (size < 1e-3), expanded)
        .otherwise(plain)
    )


def number_cell(c: Column) -> Column:
    """As number_text; whole numbers and fractions that print without an exponent need none of its other forms.

    Those go through a lambda, which keeps the generated code small.
    """
    size = F.abs(c)
    return (
        F.when(c.isNull(), "")
        .when((size < 1e15) & (c == F.floor(c)), c.cast("bigint").cast("string"))
        .when((size >= 1e-3) & (size < 1e7), c.cast("string"))
        .otherwise(F.transform(F.array(c), number_text)[0])
    )


def canonical(df: DataFrame, fields: tuple[str, ...]) -> Column:
    """Fields joined by | ; missing columns and nulls are blank."""
    parts: list[Column] = []
    for name in fields:
        kind = df.schema[name].dataType.typeName() if name in df.columns else None
        if kind is None:
            parts.append(F.lit(""))
        elif kind == "double":
            parts.append(number_cell(F.col(name)))
        elif kind == "date":
            parts.append(F.coalesce(F.date_format(F.col(name), "yyyy-MM-dd"), F.lit("")))
        else:
            parts.append(F.coalesce(F.trim(F.col(name).cast("string")), F.lit("")))
    return F.concat_ws("|", *parts)


def packed(hashed: Column) -> Column:
    """A hash as half as many bytes, for keys that are shuffled; another text as bytes that no hash can equal."""
    return F.when(hashed.rlike("^[0-9a-f]{64}$"), F.unhex(hashed)).otherwise(F.concat(F.encode(hashed, "UTF-8"), F.unhex(F.lit("00" * 33))))


def unpacked(key: Column) -> Column:
    """The text that ``packed`` was made from."""
    return F.when(F.octet_length(key) == 32, F.lower(F.hex(key))).otherwise(F.decode(F.substring(key, F.lit(1), F.octet_length(key) - 33), "UTF-8"))


def content_hash(df: DataFrame, fields: tuple[str, ...] = TRANSACTION_FIELDS) -> Column:
    return F.sha2(canonical(df, fields), 256)


def occurrence_hash(content: Column, occurrence: Column) -> Column:
    """Repeated identical rows are separate fills: each gets its own stable hash."""
    return F.sha2(F.concat(content, F.lit("|occurrence:"), occurrence.cast("string")), 256)


def observation_hash(instrument_type: Column, ticker: Column, currency: Column, date: Column, raw: Column, adjusted: Column) -> Column:
    text = F.concat_ws(
        "|",
        *[F.lit(x) for x in PROVIDER_BASIS],
        instrument_type,
        ticker,
        currency,
        F.date_format(date, "yyyy-MM-dd"),
        number_text(raw),
        number_text(adjusted),
    )
    return F.sha2(text, 256)


def combined_hash(hashes: Column) -> Column:
    """One hash for a set of row hashes, independent of row order.

    Row hashes are sorted inside an array, so the caller groups by something of bounded size
    (an instrument's days, a snapshot's instruments), never a whole dataset.
    """
    return F.sha2(F.array_join(F.array_sort(hashes), "|"), 256)
