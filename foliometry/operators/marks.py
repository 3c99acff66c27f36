"""Strict as-of lookup of price and FX marks.

Marks are reduced to one row per (key, day) first, so an as-of window holds at most one row per
calendar day and key however many marks were observed.  On the newest day two values further
apart than EPSILON are a conflict, which hides the mark even if an older clean one exists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliometry.schema import BASE_CURRENCY, EPSILON

KEY = ("snapshot_id", "mark_type", "ticker", "currency")


def normalised_marks(marks: DataFrame) -> DataFrame:
    source = F.trim("source")
    return marks.select(
        "snapshot_id",
        "source_row_number",
        "mark_date",
        F.upper("mark_type").alias("mark_type"),
        F.when(F.upper("mark_type") == "FX", "").otherwise(F.upper(F.trim("ticker"))).alias("ticker"),
        F.upper(F.trim("currency")).alias("currency"),
        "value",
        F.when(source == "", "UNSPECIFIED").otherwise(source).alias("source"),
    )


def _valid(marks: DataFrame) -> DataFrame:
    v = F.col("value")
    return marks.where(F.col("mark_date").isNotNull() & v.isNotNull() & ~F.isnan(v) & (v > 0) & (v < float("inf")))


def invalid_marks(marks: DataFrame) -> DataFrame:
    """Blocking issue per unusable mark, whatever its ticker."""
    v = F.col("value")
    bad = v.isNull() | F.isnan(v) | (v <= 0) | (v == float("inf"))
    code = F.when(F.col("mark_date").isNull(), "INVALID_MARK_DATE").when(bad, "INVALID_MARK_VALUE")
    return marks.select(
        "snapshot_id", code.alias("issue_code"), "ticker", "currency", "mark_date", "source_row_number"
    ).where("issue_code is not null")


def daily_marks(marks: DataFrame) -> DataFrame:
    """One row per key and day: the selected value (null on conflict), its source and the verdict."""
    pick = F.struct("source", "source_row_number", "value")
    first = F.min_by("value", "source_row_number")
    spread = F.greatest(F.max("value") - first, first - F.min("value"))
    return (
        _valid(normalised_marks(marks))
        .groupBy(*KEY, "mark_date")
        .agg(
            F.min(pick).alias("pick"),
            (spread >= EPSILON).alias("conflict"),
        )
        .select(
            *KEY,
            "mark_date",
            F.when(~F.col("conflict"), F.col("pick.value")).alias("value"),
            F.col("pick.source").alias("source"),
            "conflict",
        )
    )


def snapshot_quotes(marks: DataFrame, snapshots: DataFrame) -> DataFrame:
    """As-of marks at the one valuation date each snapshot has."""
    return marks_on_dates(marks, snapshots.select("snapshot_id", F.col("valuation_date").alias("as_of")))


def marks_on_dates(marks: DataFrame, dates: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Newest mark at or before every wanted (snapshot, date), for every key of the snapshot or those in ``keys``.

    ``dates`` has (snapshot_id, as_of), ``keys`` the columns of KEY.  Wanted dates are days, so the
    result is bounded by keys x calendar days and never by the number of accounts that ask.
    """
    daily = daily_marks(marks)
    if keys is not None:
        daily = daily.join(keys.distinct(), [*KEY], "left_semi")
    wanted = daily.select(*KEY).distinct().join(dates.distinct(), "snapshot_id")
    seen = daily.select(*KEY, F.col("mark_date").alias("day"), F.lit(0).alias("ask"), F.struct("mark_date", "value", "source", "conflict").alias("mark"))
    asks = wanted.select(*KEY, F.col("as_of").alias("day"), F.lit(1).alias("ask"), F.lit(None).cast(seen.schema["mark"].dataType).alias("mark"))
    upto = Window.partitionBy(*KEY).orderBy("day", "ask").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        seen.unionByName(asks)
        .withColumn("mark", F.last("mark", ignorenulls=True).over(upto))
        .where("ask = 1 and mark is not null")
        .select(*KEY, F.col("day").alias("as_of"), "mark.mark_date", "mark.value", "mark.source", "mark.conflict")
    )


def conflicts_on_dates(marks: DataFrame, dates: DataFrame) -> DataFrame:
    """(snapshot_id, as_of, conflicts): how many keys' newest mark is a conflict on each wanted date.

    A conflict counts from its day until the key's next marked day, so the number on a date is a
    running sum of starts and ends; no key is put on days that it has no mark on.
    """
    in_order = Window.partitionBy(*KEY).orderBy("mark_date")
    spells = daily_marks(marks).withColumn("until", F.lead("mark_date").over(in_order)).where("conflict")
    starts = spells.select("snapshot_id", F.col("mark_date").alias("day"), F.lit(1).alias("n"))
    ends = spells.where("until is not null").select("snapshot_id", F.col("until").alias("day"), F.lit(-1).alias("n"))
    changes = starts.unionByName(ends).groupBy("snapshot_id", "day").agg(F.sum("n").alias("n")).withColumn("ask", F.lit(0))
    asks = dates.distinct().select("snapshot_id", F.col("as_of").alias("day"), F.lit(0).cast("bigint").alias("n"), F.lit(1).alias("ask"))
    upto = Window.partitionBy("snapshot_id").orderBy("day", "ask").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = changes.unionByName(asks).withColumn("conflicts", F.sum("n").over(upto)).where("ask = 1")
    return counted.select("snapshot_id", F.col("day").alias("as_of"), "conflicts")


def twd_fx(as_of: Column) -> tuple[Column, Column, Column]:
    """The implicit base rate: (rate, date, source) of TWD on any date."""
    return F.lit(1.0), as_of, F.lit("IMPLICIT_TWD_BASE")


def with_price(df: DataFrame, marks: DataFrame, on: list[str]) -> DataFrame:
    prices = marks.where((F.col("mark_type") == "PRICE") & F.col("value").isNotNull()).select(
        *on, "ticker", "currency", F.col("value").alias("price"), F.col("mark_date").alias("price_date"), F.col("source").alias("price_source")
    )
    return df.join(prices, [*on, "ticker", "currency"], "left")


def with_fx(df: DataFrame, marks: DataFrame, on: list[str], as_of: Column) -> DataFrame:
    rates = marks.where(
        (F.col("mark_type") == "FX") & F.col("value").isNotNull() & (F.col("currency") != BASE_CURRENCY)
    ).select(*on, "currency", F.col("value").alias("mark_fx"), F.col("mark_date").alias("mark_fx_date"), F.col("source").alias("mark_fx_source"))
    base = F.col("currency") == BASE_CURRENCY
    rate, date, source = twd_fx(as_of)
    return (
        df.join(rates, [*on, "currency"], "left")
        .withColumn("fx", F.when(base, rate).otherwise(F.col("mark_fx")))
        .withColumn("fx_date", F.when(base, date).otherwise(F.col("mark_fx_date")))
        .withColumn("fx_source", F.when(base, source).otherwise(F.col("mark_fx_source")))
        .drop("mark_fx", "mark_fx_date", "mark_fx_source")
    )


def fx_with_tolerance(bars: DataFrame, dates: DataFrame, max_age_days: int = 10) -> DataFrame:
    """Newest FX bar at or before each (currency, date), only if positive and young enough; per market where both tables name one."""
    keys = [c for c in ("market_id", "currency") if c == "currency" or c in bars.columns and c in dates.columns]
    daily = bars.where(F.col("instrument_type") == "FX").groupBy(*keys, "date").agg(F.max("raw_close").alias("close"))
    wanted = dates.select(*keys, "date").distinct().withColumn("wanted", F.lit(True))
    upto = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bar = F.last(F.when(F.col("close").isNotNull(), F.struct("date", "close")), ignorenulls=True).over(upto)
    age = F.datediff("date", F.col("bar.date"))
    usable = (age <= max_age_days) & (F.col("bar.close") > 0)
    return (
        daily.join(wanted, [*keys, "date"], "full_outer")
        .withColumn("bar", bar)
        .where("wanted")
        .select(*keys, "date", F.when(usable, F.col("bar.close")).alias("rate"), F.when(usable, age).alias("age_days"))
    )


def next_trading_date(calendar: DataFrame, wanted: DataFrame, key: str = "request_id") -> DataFrame:
    """Forward as-of: smallest calendar date at or after each wanted date of the same key."""
    days = calendar.select(key, F.col("date")).distinct().withColumn("open", F.col("date"))
    asks = wanted.select(key, "date").distinct().withColumn("wanted", F.lit(True))
    # from the last day back: a frame that grows is summed up row by row, one that shrinks is read anew for every row
    onward = Window.partitionBy(key).orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        days.join(asks, [key, "date"], "full_outer")
        .withColumn("execution_date", F.last("open", ignorenulls=True).over(onward))
        .where("wanted")
        .select(key, "date", "execution_date")
    )
