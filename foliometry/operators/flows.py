"""External and security cash flows, their summaries and the gates in front of XIRR."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliometry.operators.xirr import xirr
from foliometry.schema import EPSILON, SECURITY, clean, gross_native, twd_rate

P = "account_id"


def _issue(code: str, present) -> F.Column:
    return F.when(present, F.lit(code))


def _collect(*codes):
    return F.array_compact(F.array(*codes))


def external_events(tx: DataFrame, terminal: DataFrame) -> DataFrame:
    """CONTRIBUTION, WITHDRAWAL and TERMINAL_VALUE events in TWD; unrated flows are left out.

    ``terminal`` has (account_id, valuation_date, complete, total_assets_twd).
    """
    amount = F.col("amount_foreign") * twd_rate()
    into = F.col("transaction_type") == "CASH_IN"
    moved = (
        tx.where(F.col("transaction_type").isin("CASH_IN", "CASH_OUT"))
        .join(terminal.select(P, "valuation_date"), P)
        .where(F.col("valuation_date").isNull() | (F.col("trade_date") <= F.col("valuation_date")))
        .select(
            P,
            F.col("trade_date").alias("date"),
            F.when(into, "CONTRIBUTION").otherwise("WITHDRAWAL").alias("kind"),
            amount.alias("amount_twd"),
            F.when(into, -amount).otherwise(amount).alias("signed_amount_twd"),
            F.array("source_row_number").alias("source_row_numbers"),
        )
        .where("amount_twd is not null")
    )
    end = terminal.where("valuation_date is not null and complete and total_assets_twd >= 0").select(
        P,
        F.col("valuation_date").alias("date"),
        F.lit("TERMINAL_VALUE").alias("kind"),
        F.col("total_assets_twd").alias("amount_twd"),
        F.col("total_assets_twd").alias("signed_amount_twd"),
        F.array().cast("array<bigint>").alias("source_row_numbers"),
    )
    return moved.unionByName(end)


def daily_net_flows(events: DataFrame, key: str = P) -> DataFrame:
    return (
        events.groupBy(key, "date")
        .agg(clean(F.sum("signed_amount_twd")).alias("amount"))
        .where(F.abs("amount") > EPSILON)
    )


def _unrated_and_late(tx: DataFrame, terminal: DataFrame) -> DataFrame:
    external = F.col("transaction_type").isin("CASH_IN", "CASH_OUT")
    late = F.col("trade_date") > F.col("valuation_date")
    return (
        tx.join(terminal.select(P, "valuation_date"), P)
        .groupBy(P)
        .agg(
            F.count_if(late).alias("late_rows"),
            F.count_if(external & ~F.coalesce(late, F.lit(False)) & twd_rate().isNull()).alias("unrated_flows"),
        )
    )


def performance_summary(tx: DataFrame, terminal: DataFrame) -> DataFrame:
    """Contributions, profit, multiple and XIRR per account, with every blocking issue code."""
    events = external_events(tx, terminal)
    sums = events.groupBy(P).agg(
        clean(F.sum(F.when(F.col("kind") == "CONTRIBUTION", F.col("amount_twd")).otherwise(0.0))).alias("paid_in"),
        clean(F.sum(F.when(F.col("kind") == "WITHDRAWAL", F.col("amount_twd")).otherwise(0.0))).alias("taken_out"),
        F.count("*").alias("events"),
        F.min("date").alias("first_event"),
        F.max("date").alias("last_event"),
    )
    net = daily_net_flows(events)
    positive = net.groupBy(P).agg(F.count_if(F.col("amount") > EPSILON).alias("positive_days"))
    rates = xirr(net)
    df = (
        terminal.select(P, "valuation_date", "complete", "total_assets_twd")
        .join(_unrated_and_late(tx, terminal), P, "left")
        .join(sums, P, "left")
        .join(positive, P, "left")
        .join(rates, P, "left")
    )
    paid = F.coalesce(F.col("paid_in"), F.lit(0.0))
    taken = F.coalesce(F.col("taken_out"), F.lit(0.0))
    assets = F.when(F.col("complete"), F.col("total_assets_twd"))
    gates = _collect(
        _issue("MISSING_VALUATION", F.col("valuation_date").isNull()),
        _issue("INCOMPLETE_VALUATION", ~F.col("complete") | F.col("total_assets_twd").isNull()),
        _issue("TRANSACTION_AFTER_VALUATION_DATE", F.col("late_rows") > 0),
        _issue("MISSING_EXTERNAL_FLOW_FX", F.col("unrated_flows") > 0),
        _issue("NO_CONTRIBUTION", paid <= EPSILON),
        _issue("NO_POSITIVE_CASH_FLOW", F.coalesce(F.col("positive_days"), F.lit(0)) == 0),
        _issue("ZERO_TIME_SPAN", (F.col("events") >= 2) & (F.col("first_event") == F.col("last_event"))),
    )
    roots = F.coalesce(F.col("root_count"), F.lit(0))
    df = df.withColumn("gates", gates).withColumn(
        "issues",
        F.when(
            F.size("gates") == 0,
            _collect(_issue("XIRR_NOT_FOUND", roots == 0), _issue("MULTIPLE_XIRR_ROOTS", roots > 1)),
        ).otherwise(F.col("gates")),
    )
    # one issue per unrated flow row, one per other code
    repeats = F.greatest(F.coalesce(F.col("unrated_flows"), F.lit(0)) - 1, F.lit(0))
    return df.select(
        P,
        "valuation_date",
        paid.alias("gross_contributions_twd"),
        taken.alias("gross_withdrawals_twd"),
        clean(paid - taken).alias("net_contributed_capital_twd"),
        assets.alias("terminal_assets_twd"),
        clean(assets + taken - paid).alias("cumulative_profit_twd"),
        F.when(paid > EPSILON, (assets + taken) / paid).alias("money_multiple"),
        F.when(F.size("issues") == 0, F.col("xirr")).alias("xirr"),
        F.array_join("issues", ",").alias("issue_codes"),
        (F.size("issues") + repeats).cast("bigint").alias("blocking_issue_count"),
        (F.size("issues") == 0).alias("complete"),
    )


def security_events(tx: DataFrame, terminal: DataFrame) -> DataFrame:
    """PURCHASE, SALE and TERMINAL_POSITION_VALUE events, with the reason where a trade has none.

    ``terminal`` has (account_id, valuation_date, positions_complete, position_value_twd).
    """
    buy = F.col("quantity") > 0
    native = F.when(buy, gross_native() + F.col("fee")).otherwise(gross_native() - F.col("fee"))
    amount = clean(F.col("native") * F.col("rate"))
    invalid = F.isnan("native") | F.when(buy, F.col("native") <= 0).otherwise(F.col("native") < -EPSILON)
    skipped = ~buy & (F.col("native") <= EPSILON)
    trades = (
        tx.where(F.col("transaction_type") == SECURITY)
        .join(terminal.select(P, "valuation_date"), P)
        .where(F.col("valuation_date").isNull() | (F.col("trade_date") <= F.col("valuation_date")))
        .withColumn("native", native)
        .withColumn("rate", twd_rate())
        .where(invalid | ~skipped)
        .select(
            P,
            F.col("trade_date").alias("date"),
            F.when(buy, "PURCHASE").otherwise("SALE").alias("kind"),
            amount.alias("amount_twd"),
            F.when(buy, -amount).otherwise(amount).alias("signed_amount_twd"),
            F.array("source_row_number").alias("source_row_numbers"),
            F.when(invalid, "INVALID_SECURITY_PROCEEDS").when(F.col("rate").isNull(), "MISSING_SECURITY_FLOW_FX").alias("issue_code"),
        )
    )
    end = terminal.where("valuation_date is not null and positions_complete and position_value_twd >= 0").select(
        P,
        F.col("valuation_date").alias("date"),
        F.lit("TERMINAL_POSITION_VALUE").alias("kind"),
        F.col("position_value_twd").alias("amount_twd"),
        F.col("position_value_twd").alias("signed_amount_twd"),
        F.array().cast("array<bigint>").alias("source_row_numbers"),
        F.lit(None).cast("string").alias("issue_code"),
    )
    return trades.unionByName(end)


def security_summary(tx: DataFrame, terminal: DataFrame) -> DataFrame:
    events = security_events(tx, terminal)
    good = F.col("issue_code").isNull()
    sums = events.groupBy(P).agg(
        clean(F.sum(F.when(good & (F.col("kind") == "PURCHASE"), F.col("amount_twd")).otherwise(0.0))).alias("bought"),
        clean(F.sum(F.when(good & (F.col("kind") == "SALE"), F.col("amount_twd")).otherwise(0.0))).alias("sold"),
        F.count_if(~good).alias("row_issues"),
    )
    late = (
        tx.where(F.col("transaction_type") == SECURITY)
        .join(terminal.select(P, "valuation_date"), P)
        .where("trade_date > valuation_date")
        .groupBy(P)
        .agg(F.count("*").alias("late_rows"))
    )
    df = terminal.join(sums, P, "left").join(late, P, "left")
    bought = F.coalesce(F.col("bought"), F.lit(0.0))
    sold = F.coalesce(F.col("sold"), F.lit(0.0))
    unvalued = ~F.col("positions_complete") | F.col("position_value_twd").isNull() | (F.col("position_value_twd") < 0)
    count = (
        F.col("valuation_date").isNull().cast("bigint")
        + unvalued.cast("bigint")
        + F.coalesce(F.col("late_rows") > 0, F.lit(False)).cast("bigint")
        + F.coalesce(F.col("row_issues"), F.lit(0))
    )
    df = df.withColumn("blocking_issue_count", count).withColumn("complete", F.col("blocking_issue_count") == 0)
    value = F.when(F.col("positions_complete"), F.col("position_value_twd"))
    return df.select(
        P,
        "valuation_date",
        bought.alias("gross_purchases_twd"),
        sold.alias("gross_sale_proceeds_twd"),
        clean(bought - sold).alias("net_security_capital_deployed_twd"),
        value.alias("terminal_position_value_twd"),
        F.when(F.col("complete"), clean(value + sold - bought)).alias("estimated_gain_twd"),
        F.when(F.col("complete") & (bought > EPSILON), (value + sold) / bought).alias("security_multiple"),
        "blocking_issue_count",
        "complete",
    )
