"""Quote units, provider symbols, freshness of dates and the monthly schedule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


STALE_AFTER_DAYS = 4


def quote_currency(unit: Column) -> Column:
    """Pence quotes belong to GBP; any other unit must be three capitals, else null."""
    return F.when(unit.isin("GBp", "GBX"), "GBP").when(unit.rlike("^[A-Z]{3}$"), unit)


def quote_scale(unit: Column) -> Column:
    return F.when(unit.isin("GBp", "GBX"), 0.01).when(unit.rlike("^[A-Z]{3}$"), 1.0)


def adjusted_price_twd(adjusted: Column, scale: Column, fx: Column) -> Column:
    """Null where the product is not finite and positive."""
    value = adjusted * scale * fx
    return F.when(~F.isnan(value) & (value > 0) & (value < float("inf")), value)


def provider_fx_symbol(currency: Column) -> Column:
    code = F.upper(F.trim(currency))
    return F.when(code == "USD", "TWD=X").otherwise(F.concat(code, F.lit("TWD=X")))


def age_days(as_of: Column, today: Column) -> Column:
    return F.datediff(today, as_of)


def freshness_reason(as_of: Column, today: Column, limit: int = STALE_AFTER_DAYS) -> Column:
    age = age_days(as_of, today)
    return (
        F.when(as_of.isNull(), "MISSING_DATE")
        .when(age < 0, "FUTURE_DATE")
        .when(age > limit, "AGE_LIMIT_EXCEEDED")
        .otherwise("CURRENT")
    )


def is_stale(as_of: Column, today: Column, limit: int = STALE_AFTER_DAYS) -> Column:
    return freshness_reason(as_of, today, limit) != "CURRENT"


def stale_message(as_of: Column, today: Column) -> Column:
    age = age_days(as_of, today)
    day = F.date_format(as_of, "yyyy-MM-dd")
    return (
        F.when(as_of.isNull(), "market date is invalid, freshness cannot be confirmed")
        .when(age < 0, F.format_string("market date %s lies after today, check the source", day))
        .otherwise(F.format_string("market data ends on %s, %d days old", day, age))
    )


def external_flow_twd(currency: Column, amount: Column, rate: Column) -> Column:
    """Amount in TWD; null without a usable rate."""
    usable = F.when(currency == "TWD", F.lit(1.0)).when(~F.isnan(rate) & (rate > 0) & (rate < float("inf")), rate)
    return amount * usable


def monthly_dates(start: Column, end: Column) -> Column:
    """Anchor-day schedule: start plus k months, clamped to month ends, up to ``end``."""
    span = F.floor(F.months_between(F.last_day(end), F.trunc(start, "month"))).cast("int")
    months = F.when(start <= end, F.sequence(F.lit(0), F.greatest(span, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(months, lambda k: F.add_months(start, k)), lambda d: d <= end)


