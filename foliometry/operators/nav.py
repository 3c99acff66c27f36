"""Net asset value of every account on every observation date.

The ledgers run once; a date reads the last state at or before it.  States are reduced to one row
per (key, day) before the as-of window, so a window never holds more than one row per calendar
day.  ``dates`` has (account_id, as_of).
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliometry.operators.gate import ledger_issues
from foliometry.operators.marks import conflicts_on_dates, invalid_marks, marks_on_dates
from foliometry.operators.position_ledger import MISMATCH
from foliometry.operators.valuation import value_positions, value_wallets
from foliometry.runtime import stored
from foliometry.schema import SECURITY, clean, twd_rate

P = "account_id"


def nav_dates(tx: DataFrame, marks: DataFrame, snapshots: DataFrame) -> DataFrame:
    """First trade, valuation date, and every mark and external-flow date between them."""
    span = (
        tx.groupBy(P)
        .agg(F.min("trade_date").alias("first_date"))
        .join(snapshots, P)
        .where(F.col("first_date") <= F.col("valuation_date"))
    )
    inside = F.col("as_of").between(F.col("first_date"), F.col("valuation_date"))
    ends = span.select(P, F.explode(F.array("first_date", "valuation_date")).alias("as_of"))
    mark_days = marks.where("mark_date is not null").select("snapshot_id", F.col("mark_date").alias("as_of")).distinct()
    marked = span.join(mark_days, "snapshot_id").where(inside).select(P, "as_of")
    flow_days = _external(tx).select(P, F.col("trade_date").alias("as_of")).distinct()
    flows = span.join(flow_days, P).where(inside).select(P, "as_of")
    return ends.unionByName(marked).unionByName(flows).distinct()


def observation_dates(requested: DataFrame, tx: DataFrame) -> DataFrame:
    """Requested dates plus the external-flow dates between the first and the last of them."""
    asked = requested.where("as_of is not null").select(P, "as_of").distinct()
    span = asked.groupBy(P).agg(F.min("as_of").alias("lo"), F.max("as_of").alias("hi"))
    flow_days = _external(tx).select(P, F.col("trade_date").alias("as_of")).distinct()
    inside = flow_days.join(span, P).where(F.col("as_of").between(F.col("lo"), F.col("hi"))).select(P, "as_of")
    return asked.unionByName(inside).distinct()


def requested_dates(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split (account_id, date_text) into valid distinct dates and INVALID_AS_OF_DATE issues."""
    raw = F.trim("date_text")
    day = F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(raw, "yyyy-MM-dd"))
    parsed = texts.withColumn("as_of", day)
    bad = parsed.where("as_of is null").select(P, F.lit("INVALID_AS_OF_DATE").alias("issue_code"), "date_text")
    return parsed.where("as_of is not null").select(P, "as_of").distinct(), bad


def _external(tx: DataFrame) -> DataFrame:
    return tx.where(F.col("transaction_type").isin("CASH_IN", "CASH_OUT"))


def _asked(dates: DataFrame) -> DataFrame:
    """One row per account and snapshot with all its dates, which are days, in order."""
    return dates.repartition(P).groupBy(P, "snapshot_id").agg(F.sort_array(F.collect_list("as_of")).alias("asked"))


def _earlier(day: str) -> Column:
    """How many of the asked dates come before ``day``."""
    day_ = F.coalesce(F.col(day), F.lit(datetime.date(1970, 1, 1)))  # as it is, but known to be no null: plain integers are sorted
    return (F.array_position(F.sort_array(F.concat("asked", F.array(day_))), day_) - 1).cast("int")


def _as_of(states: DataFrame, keys: list[str], asked: DataFrame, value: str) -> DataFrame:
    """Last known day state at or before every date of the account.

    A state answers the dates from its day until the day of the key's next one.  States lie by account and meet the
    account's dates as one row, so neither they nor the answers, many times as many, are moved again.
    """
    in_order = Window.partitionBy(*keys).orderBy("day")
    known = states.where("day is not null").withColumn("first", F.row_number().over(in_order) == 1)
    known = known.where(F.col("first") | F.col(value).isNotNull()).withColumn("until", F.lead("day").over(in_order))
    end = F.when(F.col("until").isNull(), F.size("asked")).otherwise(_earlier("until"))
    spans = known.join(asked, P).withColumns({"start": _earlier("day"), "end": end})
    mine = F.slice("asked", F.col("start") + 1, F.col("end") - F.col("start"))
    return spans.select(*keys, "snapshot_id", F.explode(mine).alias("as_of"), value)


def holdings_on_dates(security_ledger: DataFrame, dates: DataFrame) -> DataFrame:
    """Open quantities per date; ``dates`` has (account_id, snapshot_id, as_of)."""
    keys = [P, "ticker", "currency"]
    states = (
        security_ledger.where(F.col("issue_code").isNull() | (F.col("issue_code") != MISMATCH))
        .select(*keys, F.col("trade_date").alias("day"), "quantity_after", "step")
        .repartition(P)
        .groupBy(*keys, "day")
        .agg(F.max_by("quantity_after", "step").alias("quantity"))
    )
    return _as_of(states, keys, _asked(dates), "quantity").where("quantity > 0")


def wallets_on_dates(cash_ledger: DataFrame, tracking: DataFrame, dates: DataFrame) -> DataFrame:
    """Balances per date; before the first non-SECURITY row cash is untracked and has no wallets."""
    keys = [P, "currency"]
    states = (
        cash_ledger.select(*keys, F.col("trade_date").alias("day"), "balance_after", "step")
        .repartition(P)
        .groupBy(*keys, "day")
        .agg(F.max_by("balance_after", "step").alias("ending_balance"))
    )
    tracked = dates.join(tracking.select(P, "tracked_from"), P).where("tracked_from is null or as_of >= tracked_from")
    return _as_of(states, keys, _asked(tracked), "ending_balance")


def issue_days(security: DataFrame, cash: DataFrame, fx: DataFrame, tracking: DataFrame) -> DataFrame:
    """First date on which each distinct ledger issue is visible.

    A cost-basis issue repeats a primary issue of the same row and code.  A cash issue is invisible
    until cash is tracked, but where it repeats a cost-basis issue that one is visible before.
    """
    key = [P, "source_row_number", "issue_code"]
    sec = ledger_issues(security, "SECURITY_ACCOUNTING").select(*key, "trade_date")
    cash_ = ledger_issues(cash, "CASH_FX_FUNDING").join(tracking.select(P, "tracked_from"), P).select(
        *key, F.greatest("trade_date", "tracked_from").alias("trade_date")
    )
    fx_ = ledger_issues(fx, "FX_COST_BASIS").select(*key, "trade_date")
    every = sec.unionByName(cash_).unionByName(fx_)
    return every.groupBy(*key).agg(F.min("trade_date").alias("day"))


def _running(counts: DataFrame, dates: DataFrame, column: str) -> DataFrame:
    """Running total of per-day counts, read at every wanted date."""
    asks = dates.select(P, F.col("as_of").alias("day"), F.lit(1).alias("ask"), F.lit(0).cast("bigint").alias("n"))
    rows = counts.select(P, "day", F.lit(0).alias("ask"), F.col("n").cast("bigint").alias("n")).unionByName(asks)
    upto = Window.partitionBy(P).orderBy("day", "ask").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.withColumn(column, F.sum("n").over(upto)).where("ask = 1").select(P, F.col("day").alias("as_of"), column)
    )


def external_flows(tx: DataFrame) -> DataFrame:
    """Contributions, withdrawals and unrated flows per account and day."""
    amount = F.col("amount_foreign") * twd_rate()
    into = F.col("transaction_type") == "CASH_IN"
    return (
        _external(tx)
        .groupBy(P, F.col("trade_date").alias("as_of"))
        .agg(
            clean(F.coalesce(F.sum(F.when(into, amount)), F.lit(0.0))).alias("contribution_twd"),
            clean(F.coalesce(F.sum(F.when(~into, amount)), F.lit(0.0))).alias("withdrawal_twd"),
            F.count_if(amount.isNull()).alias("missing_flow_fx"),
        )
    )


def asked_keys(security: DataFrame, cash: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Mark keys that some account of a snapshot can need: its tickers' prices and its currencies' rates."""
    snap = snapshots.select(P, "snapshot_id")
    held = security.select(P, "ticker", "currency").distinct().join(snap, P).select("snapshot_id", "ticker", "currency").distinct()
    money = cash.select(P, "currency").distinct().join(snap, P).select("snapshot_id", "currency")
    prices = held.select("snapshot_id", F.lit("PRICE").alias("mark_type"), "ticker", "currency")
    rates = held.select("snapshot_id", "currency").unionByName(money).distinct()
    return prices.unionByName(rates.select("snapshot_id", F.lit("FX").alias("mark_type"), F.lit("").alias("ticker"), "currency"))


def nav_points(
    tx: DataFrame,
    security: DataFrame,
    cash: DataFrame,
    fx: DataFrame,
    tracking: DataFrame,
    marks: DataFrame,
    snapshots: DataFrame,
    dates: DataFrame,
) -> DataFrame:
    dates = stored(dates.join(snapshots.select(P, "snapshot_id"), P))
    days = dates.select("snapshot_id", "as_of").distinct()
    # quotes are bounded by keys and days; written, they have a size that tells whether they can go to the holdings
    quotes = stored(marks_on_dates(marks, days, asked_keys(security, cash, snapshots)))
    on = ["snapshot_id", "as_of"]
    as_of = F.col("as_of")
    wanted = dates.select(P, "as_of")
    held = holdings_on_dates(security, dates).withColumn("cost_basis", F.lit(0.0))
    money = wallets_on_dates(cash, tracking, dates)
    value = F.sum(F.coalesce(F.col("market_value_twd"), F.lit(0.0)))
    missing = F.sum(F.col("missing_price").cast("bigint") + F.col("missing_fx").cast("bigint"))
    positions = value_positions(held, quotes, on, as_of).groupBy(P, "as_of").agg(
        value.alias("position_value"), F.max("price_date").alias("latest_price_date_used"), F.max("fx_date").alias("position_fx_date"), missing.alias("position_issues")
    )
    wallets = value_wallets(money, quotes, on, as_of).groupBy(P, "as_of").agg(
        value.alias("cash_value"), F.max("fx_date").alias("wallet_fx_date"), missing.alias("wallet_issues")
    )
    conflicts = conflicts_on_dates(marks, days)
    invalid = invalid_marks(marks).groupBy("snapshot_id").agg(F.count("*").alias("invalid"))
    per_day = issue_days(security, cash, fx, tracking).groupBy(P, "day").agg(F.count("*").alias("n"))
    blocked = _running(per_day, wanted, "ledger_issues")
    rows = _running(tx.groupBy(P, F.col("trade_date").alias("day")).agg(F.count("*").alias("n")), wanted, "transaction_count")
    flows = external_flows(tx)
    zero = lambda c, kind="bigint": F.coalesce(F.col(c), F.lit(0).cast(kind))
    df = (
        dates.join(positions, [P, "as_of"], "left")
        .join(wallets, [P, "as_of"], "left")
        .join(conflicts, on, "left")
        .join(invalid, "snapshot_id", "left")
        .join(blocked, [P, "as_of"], "left")
        .join(rows, [P, "as_of"], "left")
        .join(flows, [P, "as_of"], "left")
        .withColumn(
            "blocking_issue_count",
            zero("position_issues") + zero("wallet_issues") + zero("conflicts") + zero("invalid") + zero("ledger_issues") + zero("missing_flow_fx"),
        )
        .withColumn("complete", F.col("blocking_issue_count") == 0)
        .withColumn("position_value_twd", clean(zero("position_value", "double")))
        .withColumn("cash_value_twd", clean(zero("cash_value", "double")))
        .withColumn("known_total_assets_twd", clean(F.col("position_value_twd") + F.col("cash_value_twd")))
    )
    return df.select(
        P,
        "as_of",
        "complete",
        zero("transaction_count").alias("transaction_count"),
        zero("contribution_twd", "double").alias("contribution_twd"),
        zero("withdrawal_twd", "double").alias("withdrawal_twd"),
        "position_value_twd",
        "cash_value_twd",
        "known_total_assets_twd",
        F.when(F.col("complete"), F.col("known_total_assets_twd")).alias("total_assets_twd"),
        "latest_price_date_used",
        F.greatest("position_fx_date", "wallet_fx_date").alias("latest_fx_date_used"),
        "blocking_issue_count",
    )


def chart_range(points: DataFrame, name: str, date: str = "as_of", value: str = "total_assets_twd") -> DataFrame:
    """Keep the points of 1M, 3M, YTD, 1Y or ALL before the last valid point of each account.

    Month arithmetic overflows like a calendar of day numbers: 31 March minus one month is 3 March.
    """
    valid = points.where(F.col(value).isNotNull() & ~F.isnan(value))
    if name == "ALL":
        return valid
    ends = valid.groupBy(P).agg(F.max(date).alias("range_end"))
    return valid.join(ends, P).where(F.col(date) >= range_start(F.col("range_end"), name)).drop("range_end")


def range_start(end: Column, name: str) -> Column:
    months = {"1M": 1, "3M": 3, "1Y": 12}
    if name == "YTD":
        return F.trunc(end, "year")
    first = F.add_months(F.trunc(end, "month"), -months[name])
    return F.date_add(first, F.dayofmonth(end) - 1)
