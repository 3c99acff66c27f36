"""Landed price-provider chart documents to daily bars."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliometry.functions.market import quote_currency

MAX_AGE_DAYS = 10
MAX_BOUNDED_AGE_DAYS = 14

CHART = (
    "struct<chart:struct<result:array<struct<"
    "meta:struct<currency:string,exchangeTimezoneName:string,"
    "currentTradingPeriod:struct<regular:struct<start:bigint,end:bigint>>>,"
    "timestamp:array<bigint>,"
    "indicators:struct<quote:array<struct<close:array<double>>>,adjclose:array<struct<adjclose:array<double>>>>"
    ">>,error:struct<code:string,description:string>>>"
)

_KEYS = ("symbol", "start_date", "end_date")


def parse_documents(documents: DataFrame) -> DataFrame:
    """``documents`` has (symbol, start_date, end_date, document); one row per document, parsed."""
    parsed = documents.withColumn("d", F.from_json("document", CHART))
    result = F.try_element_at("d.chart.result", F.lit(1))
    expected = F.col("expected_currency") if "expected_currency" in documents.columns else F.lit(None)
    return parsed.select(
        *_KEYS,
        expected.cast("string").alias("expected_currency"),
        F.col("d.chart.error.code").alias("provider_error"),
        result.alias("result"),
    )


def _points(documents: DataFrame, now: datetime.datetime) -> DataFrame:
    zone = F.coalesce(F.nullif(F.col("result.meta.exchangeTimezoneName"), F.lit("")), F.lit("UTC"))
    closes = F.try_element_at("result.indicators.quote", F.lit(1))["close"]
    adjusted = F.try_element_at("result.indicators.adjclose", F.lit(1))["adjclose"]
    now_seconds = int(now.replace(tzinfo=datetime.timezone.utc).timestamp())
    regular = F.col("result.meta.currentTradingPeriod.regular")
    df = parse_documents(documents).select(
        *_KEYS,
        zone.alias("exchange_timezone"),
        F.trim(F.coalesce(F.col("result.meta.currency"), F.lit(""))).alias("quote_unit"),
        regular["start"].alias("session_start"),
        regular["end"].alias("session_end"),
        closes.alias("closes"),
        adjusted.alias("adjusted"),
        F.posexplode("result.timestamp").alias("position", "stamp"),
    )
    # wall clock without a zone, so the date does not depend on the session's zone
    utc = F.expr("timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, stamp)")
    wall = F.convert_timezone(F.lit("UTC"), F.col("exchange_timezone"), utc)
    open_session = (
        (F.coalesce(F.col("session_start"), F.lit(0)) > 0)
        & (F.coalesce(F.col("session_end"), F.lit(0)) > now_seconds)
        & (F.col("stamp") >= F.col("session_start"))
        & (F.col("stamp") < F.col("session_end"))
    )
    at = lambda values: F.try_element_at(F.col(values), F.col("position") + 1)
    return (
        df.where("stamp is not null")
        .where(~F.coalesce(open_session, F.lit(False)))
        .select(
            *_KEYS,
            "exchange_timezone",
            "quote_unit",
            "position",
            F.to_date(wall).alias("date"),
            at("closes").alias("raw_close"),
            at("adjusted").alias("adjusted"),
        )
        .where((F.col("date") >= F.col("start_date")) & (F.col("end_date").isNull() | (F.col("date") <= F.col("end_date"))))
    )


def _valid(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (c > 0) & (c < float("inf"))


def _without(df: DataFrame, refused: DataFrame) -> DataFrame:
    same = [df[k].eqNullSafe(refused[k]) for k in _KEYS]
    return df.join(refused, same[0] & same[1] & same[2], "left_anti")


def daily_bars(documents: DataFrame, now: datetime.datetime, strict: bool = False) -> DataFrame:
    """Completed sessions, last observation per exchange-local date; unusable closes dropped.

    A refused document (``document_issues``) gives no bars.
    """
    refused = document_issues(documents, now, strict).select(*_KEYS).distinct()
    points = _without(_points(documents, now).where(_valid(F.col("raw_close"))), refused)
    pick = F.max_by(F.struct("raw_close", "adjusted", "exchange_timezone", "quote_unit"), "position")
    return (
        points.groupBy(*_KEYS, "date")
        .agg(pick.alias("bar"))
        .select(
            "symbol",
            "date",
            "bar.raw_close",
            F.when(_valid(F.col("bar.adjusted")), F.col("bar.adjusted")).alias("adjusted_close"),
            "bar.exchange_timezone",
            "bar.quote_unit",
        )
    )


def document_issues(
    documents: DataFrame, now: datetime.datetime, strict: bool = False, max_bars: int | None = None
) -> DataFrame:
    """Why a document is refused, one row per (symbol, start, end).

    Where documents carry an ``expected_currency``, another quote currency refuses them; null expects
    none.  ``strict`` also refuses a dated bar without close and a missing or unknown quote unit.
    ``max_bars`` is a limit of the caller, off by default.
    """
    points = _points(documents, now)
    good = _valid(F.col("raw_close"))
    today = now.date()
    end = F.least(F.coalesce(F.col("end_date"), F.lit(today)), F.lit(today))
    limit = F.when(F.col("end_date").isNull(), MAX_AGE_DAYS).otherwise(MAX_BOUNDED_AGE_DAYS)
    per = points.groupBy(*_KEYS).agg(
        F.count_distinct(F.when(good, F.col("date"))).alias("bars"),
        F.max(F.when(good, F.col("date"))).alias("latest"),
        F.count_if(~good).alias("holes"),
    )
    parsed = parse_documents(documents)
    unit = F.trim(F.coalesce(F.col("result.meta.currency"), F.lit("")))
    reason = (
        F.when(F.col("provider_error").isNotNull(), "PROVIDER_ERROR")
        .when(F.col("result").isNull(), "NO_RESULT")
        .when(F.lit(strict) & (F.col("holes") > 0), "MISSING_RAW_CLOSE")
        .when(F.lit(strict) & (unit == ""), "MISSING_QUOTE_UNIT")
        .when(F.lit(strict) & quote_currency(unit).isNull(), "UNKNOWN_QUOTE_UNIT")
        .when(F.upper(unit) != F.col("expected_currency"), "CURRENCY_MISMATCH")
        .when(F.lit(max_bars is not None) & (F.coalesce(F.col("bars"), F.lit(0)) > (max_bars or 0)), "TOO_MANY_BARS")
        .when(F.coalesce(F.col("bars"), F.lit(0)) == 0, "NO_COMPLETED_BAR")
        .when(F.datediff(end, "latest") > limit, "STALE_HISTORY")
    )
    per = per.select(*[F.col(k).alias(f"of_{k}") for k in _KEYS], "bars", "latest", "holes")
    same = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in _KEYS]
    return (
        parsed.join(per, same[0] & same[1] & same[2], "left")
        .select(*_KEYS, reason.alias("issue_code"))
        .where("issue_code is not null")
    )
