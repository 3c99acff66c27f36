"""Issues of the three ledgers in one frame, the activation gate and the dataset profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliometry.schema import BASE_CURRENCY

P = "account_id"


def ledger_issues(ledger: DataFrame, domain: str) -> DataFrame:
    """Blocked rows of one ledger as (account, domain, code, row, date, ticker, currency, amounts)."""
    optional = lambda name, kind: (
        F.col(name) if name in ledger.columns else F.lit(None).cast(kind)
    ).alias(name)
    return ledger.where(F.col("issue_code").isNotNull()).select(
        P,
        F.lit(domain).alias("domain"),
        "issue_code",
        "source_row_number",
        "trade_date",
        optional("ticker", "string"),
        "currency",
        optional("required", "double"),
        optional("available", "double"),
    )


def activation_issues(security: DataFrame, cash: DataFrame, fx: DataFrame) -> DataFrame:
    """Cost-basis issues only for rows that no security or cash issue already blocks."""
    primary = ledger_issues(security, "SECURITY_ACCOUNTING").unionByName(ledger_issues(cash, "CASH_FX_FUNDING"))
    seen = primary.select(P, "source_row_number").distinct()
    extra = ledger_issues(fx, "FX_COST_BASIS").join(seen, [P, "source_row_number"], "left_anti")
    return primary.unionByName(extra)


def nav_issues(security: DataFrame, cash: DataFrame, fx: DataFrame) -> DataFrame:
    """As ``activation_issues``, but a cost-basis issue is a repeat only if the code agrees too."""
    primary = ledger_issues(security, "SECURITY_ACCOUNTING").unionByName(ledger_issues(cash, "CASH_FX_FUNDING"))
    seen = primary.select(P, "source_row_number", "issue_code").distinct()
    extra = ledger_issues(fx, "FX_COST_BASIS").join(seen, [P, "source_row_number", "issue_code"], "left_anti")
    return primary.unionByName(extra)


def activation_gate(issues: DataFrame, accounts: DataFrame) -> DataFrame:
    counts = issues.groupBy(P).agg(F.count("*").alias("n"))
    n = F.coalesce(F.col("n"), F.lit(0))
    return accounts.select(P).distinct().join(counts, P, "left").select(
        P, n.alias("blocking_issue_count"), (n == 0).alias("may_activate")
    )


def dataset_profile(tx: DataFrame) -> DataFrame:
    """Row count, tickers, date range, repeated content and missing rates of each dataset.

    ``content_hash`` groups are counted first, so repeated rows are combined before the shuffle.
    """
    missing_fx = (
        (F.col("currency") != BASE_CURRENCY)
        & F.col("fx_rate").isNull()
        & F.col("transaction_type").isin("SECURITY", "CASH_OUT")
    )
    groups = tx.groupBy(P, "content_hash").agg(
        F.count("*").alias("copies"),
        F.first("ticker").alias("ticker"),
        F.min("trade_date").alias("first_date"),
        F.max("trade_date").alias("last_date"),
        F.count_if(missing_fx).alias("missing_fx"),
    )
    return groups.groupBy(P).agg(
        F.sum("copies").alias("row_count"),
        F.count_distinct(F.when(F.col("ticker") != "", F.col("ticker"))).alias("ticker_count"),
        F.min("first_date").alias("earliest_date"),
        F.max("last_date").alias("latest_date"),
        F.sum("missing_fx").alias("missing_fx_count"),
        F.sum(F.col("copies") - 1).alias("repeated_content_count"),
    )


def issue_heads(issues: DataFrame, n: int = 10) -> DataFrame:
    """First ``n`` issues per account in processing order.

    Spark turns ``row_number() <= n`` into a per-task group limit before the shuffle, so a
    account with very many issues sends at most ``n`` rows per map task.
    """
    order = Window.partitionBy(P).orderBy("trade_date", "source_row_number", "domain")
    return issues.withColumn("n", F.row_number().over(order)).where(F.col("n") <= n)
