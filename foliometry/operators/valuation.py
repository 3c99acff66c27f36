"""Point-in-time valuation of positions and wallets, and its reconciliation with TWD cost.

``snapshots`` has (account_id, snapshot_id, valuation_date); a snapshot has one valuation date.
``components`` is the long table of valued positions and wallets that all totals come from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliometry.operators.marks import invalid_marks, snapshot_quotes, with_fx, with_price
from foliometry.schema import EPSILON, clean

P = "account_id"

COMPONENT_COLUMNS = (
    P,
    "snapshot_id",
    "valuation_date",
    "asset_type",
    "ticker",
    "currency",
    "quantity",
    "cost_basis",
    "price",
    "price_date",
    "price_source",
    "fx_rate",
    "fx_date",
    "fx_source",
    "market_value_native",
    "unrealized_pnl_native",
    "market_value_twd",
    "missing_price",
    "missing_fx",
)


def value_positions(holdings: DataFrame, quotes: DataFrame, on: list[str], as_of: Column) -> DataFrame:
    """Open positions with price, rate and value; a native value survives a missing rate."""
    df = with_price(holdings.where(F.col("quantity") > EPSILON), quotes, on)
    df = with_fx(df, quotes, on, as_of)
    native = F.col("quantity") * F.col("price")
    return df.select(
        *[c for c in holdings.columns if c not in ("quantity", "cost_basis")],
        F.lit("POSITION").alias("asset_type"),
        clean("quantity").alias("quantity"),
        clean("cost_basis").alias("cost_basis"),
        "price",
        "price_date",
        "price_source",
        F.col("fx").alias("fx_rate"),
        "fx_date",
        "fx_source",
        clean(native).alias("market_value_native"),
        clean(native - F.col("cost_basis")).alias("unrealized_pnl_native"),
        clean(native * F.col("fx")).alias("market_value_twd"),
        F.col("price").isNull().alias("missing_price"),
        F.col("fx").isNull().alias("missing_fx"),
    )


def value_wallets(balances: DataFrame, quotes: DataFrame, on: list[str], as_of: Column) -> DataFrame:
    """Wallet balances in TWD; a rate is needed only where the balance is not zero."""
    needs = F.abs(F.col("ending_balance")) > EPSILON
    df = with_fx(balances, quotes, on, as_of)
    balance = F.col("ending_balance")
    return df.select(
        *[c for c in balances.columns if c != "ending_balance"],
        F.lit("CASH").alias("asset_type"),
        F.lit("").alias("ticker"),
        clean(balance).alias("quantity"),
        F.lit(None).cast("double").alias("cost_basis"),
        F.lit(None).cast("double").alias("price"),
        F.lit(None).cast("date").alias("price_date"),
        F.lit(None).cast("string").alias("price_source"),
        F.coalesce(F.col("fx"), F.when(~needs, 0.0)).alias("fx_rate"),
        "fx_date",
        "fx_source",
        clean(balance).alias("market_value_native"),
        F.lit(None).cast("double").alias("unrealized_pnl_native"),
        clean(F.coalesce(balance * F.col("fx"), F.when(~needs, 0.0))).alias("market_value_twd"),
        F.lit(False).alias("missing_price"),
        (needs & F.col("fx").isNull()).alias("missing_fx"),
    )


def components(positions: DataFrame, wallets: DataFrame, marks: DataFrame, snapshots: DataFrame) -> DataFrame:
    quotes = snapshot_quotes(marks, snapshots)
    held = positions.select(P, "ticker", "currency", "quantity", "cost_basis").join(snapshots, P)
    cash = wallets.select(P, "currency", "ending_balance").join(snapshots, P)
    date = F.col("valuation_date")
    return (
        value_positions(held, quotes, ["snapshot_id"], date)
        .select(*COMPONENT_COLUMNS)
        .unionByName(value_wallets(cash, quotes, ["snapshot_id"], date).select(*COMPONENT_COLUMNS))
    )


def mark_issues(marks: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Blocking mark problems of a snapshot, whether or not anybody holds the ticker."""
    conflicts = snapshot_quotes(marks, snapshots).where("conflict").select(
        "snapshot_id", F.lit("CONFLICTING_MARK").alias("issue_code"), "ticker", "currency", "mark_date"
    )
    return conflicts.unionByName(invalid_marks(marks).drop("source_row_number"))


def valuation_issues(parts: DataFrame, marks: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One row per blocking valuation issue of an account."""
    by_snapshot = mark_issues(marks, snapshots).join(snapshots.select(P, "snapshot_id"), "snapshot_id").drop("snapshot_id")
    codes = F.filter(
        F.array(
            F.when(F.col("missing_price"), F.lit("MISSING_PRICE")),
            F.when(F.col("missing_fx"), F.lit("MISSING_FX")),
        ),
        lambda c: c.isNotNull(),
    )
    missing = parts.where("missing_price or missing_fx").select(
        P, F.explode(codes).alias("issue_code"), "ticker", "currency", F.lit(None).cast("date").alias("mark_date")
    )
    return missing.unionByName(by_snapshot)


def valuation_totals(parts: DataFrame, marks: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One row per account: known values, and the total only when no issue blocks it."""
    value = F.coalesce(F.col("market_value_twd"), F.lit(0.0))
    sums = parts.groupBy(P).agg(
        F.sum(F.when(F.col("asset_type") == "POSITION", value)).alias("positions_value"),
        F.sum(F.when(F.col("asset_type") == "CASH", value)).alias("cash_value"),
        F.sum(F.col("missing_price").cast("bigint") + F.col("missing_fx").cast("bigint")).alias("part_issues"),
        F.count_if(F.col("asset_type") == "POSITION").alias("open_position_count"),
        F.count_if((F.col("asset_type") == "POSITION") & F.col("market_value_twd").isNull()).alias("unvalued_positions"),
    )
    bad = mark_issues(marks, snapshots).groupBy("snapshot_id").agg(F.count("*").alias("mark_issues"))
    dates = snapshots.select("snapshot_id", "valuation_date").distinct()
    future = (
        marks.where("mark_date is not null and value > 0")
        .join(dates, "snapshot_id")
        .where("mark_date > valuation_date")
        .groupBy("snapshot_id")
        .agg(F.count("*").alias("future_marks"))
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    df = snapshots.join(sums, P, "left").join(bad, "snapshot_id", "left").join(future, "snapshot_id", "left")
    return (
        df.withColumn("known_position_value_twd", clean(zero("positions_value").cast("double")))
        .withColumn("known_cash_value_twd", clean(zero("cash_value").cast("double")))
        .withColumn("known_total_assets_twd", clean(F.col("known_position_value_twd") + F.col("known_cash_value_twd")))
        .withColumn("blocking_issue_count", zero("part_issues") + zero("mark_issues"))
        .withColumn("complete", F.col("blocking_issue_count") == 0)
        .select(
            P,
            "snapshot_id",
            "valuation_date",
            "known_position_value_twd",
            "known_cash_value_twd",
            "known_total_assets_twd",
            F.when(F.col("complete"), F.col("known_total_assets_twd")).alias("total_assets_twd"),
            "blocking_issue_count",
            zero("future_marks").alias("future_mark_count"),
            zero("open_position_count").alias("open_position_count"),
            (zero("unvalued_positions") == 0).alias("positions_complete"),
            "complete",
        )
    )


def reconcile(parts: DataFrame, basis: DataFrame) -> DataFrame:
    """Valued positions against open TWD cost positions."""
    cost = basis.where(F.col("quantity") > EPSILON).select(P, "ticker", "currency", "twd_cost_basis")
    return (
        parts.where("asset_type = 'POSITION'")
        .select(P, "ticker", "currency", "market_value_twd")
        .join(cost, [P, "ticker", "currency"], "left")
        .withColumn("unrealized_pnl_twd", clean(F.col("market_value_twd") - F.col("twd_cost_basis")))
    )


def reconciliation_totals(
    reconciled: DataFrame, totals: DataFrame, basis: DataFrame, pools: DataFrame, fx_issues: DataFrame
) -> DataFrame:
    """Totals only where valuation and cost are both complete; realised needs a clean cost ledger."""
    key = F.concat_ws(":", "ticker", "currency")
    sums = reconciled.groupBy(P).agg(
        F.sum("market_value_twd").alias("value"),
        F.sum("twd_cost_basis").alias("cost"),
        F.sum("unrealized_pnl_twd").alias("unrealized"),
        F.count_if(F.col("unrealized_pnl_twd").isNull()).alias("open_ends"),
        F.count_if(F.col("twd_cost_basis").isNull()).alias("missing_cost_count"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("twd_cost_basis").isNull(), key))), ",").alias("missing_cost_keys"),
    )
    realized = (
        basis.select(P, F.col("realized_pnl_twd").alias("r"))
        .unionByName(pools.select(P, F.col("realized_fx_pnl_twd").alias("r")))
        .groupBy(P)
        .agg(F.sum("r").alias("realized"))
    )
    blocked = fx_issues.groupBy(P).agg(F.count("*").alias("cost_issues"))
    df = totals.select(P, F.col("complete").alias("valued")).join(sums, P, "left").join(realized, P, "left").join(blocked, P, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    df = df.withColumn("complete", F.col("valued") & (zero("cost_issues") == 0) & (zero("open_ends") == 0))
    total = lambda c: F.when(F.col("complete"), clean(F.coalesce(F.col(c), F.lit(0.0))))
    return df.select(
        P,
        "complete",
        total("value").alias("total_position_market_value_twd"),
        total("cost").alias("total_position_twd_cost_basis"),
        total("unrealized").alias("total_unrealized_pnl_twd"),
        F.when(zero("cost_issues") == 0, clean(F.coalesce(F.col("realized"), F.lit(0.0)))).alias("total_realized_pnl_twd"),
        zero("missing_cost_count").alias("missing_cost_count"),
        F.coalesce(F.col("missing_cost_keys"), F.lit("")).alias("missing_cost_keys"),
        zero("cost_issues").alias("cost_blocking_issue_count"),
    )
