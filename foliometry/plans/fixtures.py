"""Account tables derived from the driver's trade tables, whole, with exact integer-cent amounts.

``l_suppkey`` is the account and ``l_partkey % 20`` the instrument.  Row numbers are unique per
account and ordered by (date, source): they come from a window over (account, day), so no
window ever spans a whole account.  Tables are written once per session and folder, because
every query starts from them as it would from stored account tables.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliometry.functions.market import is_stale
from foliometry.operators import versions
from foliometry.runtime import stored

VALUATION_DATE = datetime.date(2001, 6, 30)
START = datetime.date(1995, 1, 1)
NUDGE = 1.73e-6  # keeps exact halves of the fourth decimal from rounding differently per engine

COLUMNS = (
    "account_id",
    "source_row_number",
    "trade_date",
    "transaction_type",
    "ticker",
    "currency",
    "quantity",
    "price",
    "amount_foreign",
    "fx_rate",
    "fee",
)

_kept: dict[tuple, DataFrame] = {}


def key_of(name: object, spark: SparkSession, sf_dir: str) -> tuple:
    """What a kept table depends on: the session, the folder and the state of the files in it."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(sf_dir)
    entries = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    state = hash(tuple(sorted((e.getPath().getName(), e.getLen(), e.getModificationTime()) for e in entries)))
    return name, spark.sparkContext.applicationId, sf_dir, state


def shared(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Write a derived base table once per (session, folder)."""

    @wraps(build)
    def table(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = key_of(f"{build.__module__}.{build.__name__}", spark, sf_dir)
        if key not in _kept:
            _kept[key] = stored(build(spark, sf_dir))
        return _kept[key]

    return table


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("bigint")


def _row_number(source: int, *tie_break: str) -> Column:
    rank = F.row_number().over(Window.partitionBy("account_id", "trade_date").orderBy(*tie_break))
    day = F.datediff("trade_date", F.lit(START)).cast("bigint")
    return day * 1_000_000_000 + source * 100_000_000 + rank


def _currency(k: Column) -> Column:
    return F.when(k % 3 == 0, "TWD").when(k % 3 == 1, "USD").otherwise("EUR")


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey") % 20
    return (
        read(spark, sf_dir, "lineitem")
        .withColumn("account_id", F.col("l_suppkey"))
        .withColumn("trade_date", F.to_date("l_shipdate"))
        .withColumn(
            "source_row_number",
            _row_number(
                2,
                "l_orderkey",
                "l_linenumber",
                "l_partkey",
                "l_quantity",
                "l_extendedprice",
                "l_discount",
                "l_tax",
                "l_returnflag",
                "l_linestatus",
            ),
        )
        .select(
            "account_id",
            "source_row_number",
            "trade_date",
            F.lit("SECURITY").alias("transaction_type"),
            F.concat(F.lit("T"), k).alias("ticker"),
            _currency(k).alias("currency"),
            F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("quantity"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            F.col("l_extendedprice").alias("amount_foreign"),
            (30 + (F.col("l_orderkey") % 40) * 0.1).alias("rate"),
            (F.floor(cents("l_extendedprice") * cents("l_tax") / 10000) / 100).alias("fee"),
            "l_orderkey",
            "l_linenumber",
        )
    )


def account_count(spark: SparkSession, sf_dir: str) -> int:
    return read(spark, sf_dir, "supplier").count()


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        read(spark, sf_dir, "orders")
        .withColumn("account_id", F.col("o_custkey") % account_count(spark, sf_dir))
        .withColumn("trade_date", F.to_date("o_orderdate"))
        .withColumn("source_row_number", _row_number(3, "o_orderkey"))
    )


@shared
def tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades and cash movements with oversells, missing rates, shortfalls and a mixed-currency ticker."""
    mixed = (F.col("ticker") == "T7") & (F.col("l_orderkey") % 50 == 0)
    trades = _trades(spark, sf_dir).withColumn("currency", F.when(mixed, "EUR").otherwise(F.col("currency")))
    trades = trades.withColumn(
        "fx_rate",
        F.when(F.col("currency") == "TWD", 1.0).when(F.col("l_linenumber") != 7, F.col("rate")),
    ).select(*COLUMNS)

    priority = F.substring("o_orderpriority", 1, 1)
    kind = (
        F.when(priority.isin("1", "2"), "CASH_IN")
        .when(priority == "3", "FX_BUY")
        .when(priority == "4", "FX_SELL")
        .otherwise("CASH_OUT")
    )
    twd = priority.isin("1", "5")
    cash = _orders(spark, sf_dir).select(
        "account_id",
        "source_row_number",
        "trade_date",
        kind.alias("transaction_type"),
        F.lit("").alias("ticker"),
        F.when(twd, "TWD").otherwise("USD").alias("currency"),
        F.lit(0.0).alias("quantity"),
        F.lit(0.0).alias("price"),
        F.when(priority.isin("3", "4"), F.col("o_totalprice") / 100).otherwise(F.col("o_totalprice")).alias("amount_foreign"),
        F.when(twd, 1.0).otherwise(30 + (F.col("o_orderkey") % 40) * 0.1).alias("fx_rate"),
        (F.floor(cents("o_totalprice") * 5 / 10000) / 100).alias("fee"),
    )
    return trades.unionByName(cash)


@shared
def tx_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same trades and all orders, never blocked: opening lots cover every sale, opening deposits every purchase, exchange and withdrawal."""
    trades = _trades(spark, sf_dir).withColumn(
        "fx_rate", F.when(F.col("currency") == "TWD", 1.0).otherwise(F.col("rate"))
    )
    lots = (
        trades.groupBy("account_id", "ticker", "currency")
        .agg((F.sum(F.when(F.col("quantity") < 0, -F.col("quantity")).otherwise(0.0)) + 10).alias("quantity"))
        .select(
            "account_id",
            (F.lit(100_000_000) + F.substring("ticker", 2, 9).cast("bigint")).alias("source_row_number"),
            F.lit(START).alias("trade_date"),
            F.lit("SECURITY").alias("transaction_type"),
            "ticker",
            "currency",
            "quantity",
            F.lit(1000.0).alias("price"),
            (F.col("quantity") * 1000).alias("amount_foreign"),
            F.when(F.col("currency") == "TWD", 1.0).otherwise(31.0).alias("fx_rate"),
            F.lit(0.0).alias("fee"),
        )
    )
    buys = trades.select(*COLUMNS).unionByName(lots).where("quantity > 0")
    purchases = buys.select("account_id", "currency", (cents("amount_foreign") + cents("fee")).alias("cents"))
    priority = F.substring("o_orderpriority", 1, 1)
    tenths = 300 + F.col("o_orderkey") % 40  # of TWD per USD
    leaving = _orders(spark, sf_dir).select(
        "account_id",
        F.when(priority == "4", "USD").otherwise("TWD").alias("currency"),
        F.when(priority == "3", 5_000 * tenths).when(priority == "4", 40_000).when(priority == "5", 5_000_000).cast("bigint").alias("cents"),
    )
    spent = purchases.unionByName(leaving.where("cents is not null")).groupBy("account_id", "currency").agg(F.sum("cents").alias("spent"))
    deposits = spent.select(
        "account_id",
        F.when(F.col("currency") == "TWD", 1).when(F.col("currency") == "USD", 2).otherwise(3).cast("bigint").alias("source_row_number"),
        F.lit(START).alias("trade_date"),
        F.lit("CASH_IN").alias("transaction_type"),
        F.lit("").alias("ticker"),
        "currency",
        F.lit(0.0).alias("quantity"),
        F.lit(0.0).alias("price"),
        (F.ceil(F.col("spent") / 100_000_000) * 1_000_000.0 + 50_000_000.0).alias("amount_foreign"),
        F.when(F.col("currency") == "TWD", 1.0).otherwise(30.5).alias("fx_rate"),
        F.lit(0.0).alias("fee"),
    )
    kind = F.when(priority.isin("1", "2"), "CASH_IN").when(priority == "3", "FX_BUY").when(priority == "4", "FX_SELL").otherwise("CASH_OUT")
    amount = F.when(priority == "1", 100_000.0).when(priority == "2", 1_000.0).when(priority == "3", 500.0).when(priority == "4", 400.0).otherwise(50_000.0)
    external = _orders(spark, sf_dir).select(
        "account_id",
        "source_row_number",
        "trade_date",
        kind.alias("transaction_type"),
        F.lit("").alias("ticker"),
        F.when(priority.isin("1", "5"), "TWD").otherwise("USD").alias("currency"),
        F.lit(0.0).alias("quantity"),
        F.lit(0.0).alias("price"),
        amount.alias("amount_foreign"),
        F.when(priority.isin("1", "5"), 1.0).otherwise(tenths / 10).alias("fx_rate"),
        F.lit(0.0).alias("fee"),
    )
    return trades.select(*COLUMNS).unionByName(lots).unionByName(deposits).unionByName(external)


def _prices(spark: SparkSession, sf_dir: str, day: Column) -> DataFrame:
    k = F.col("l_partkey") % 20
    return (
        read(spark, sf_dir, "lineitem")
        .groupBy(F.concat(F.lit("T"), k).alias("ticker"), _currency(k).alias("currency"), day.alias("mark_date"))
        .agg(F.round(F.sum(cents("l_extendedprice")) / F.sum(F.col("l_quantity").cast("bigint")) / 100 + NUDGE, 4).alias("value"))
    )


def _rates(spark: SparkSession, sf_dir: str, day: Column) -> DataFrame:
    return (
        read(spark, sf_dir, "orders")
        .groupBy(F.when(F.col("o_orderkey") % 2 == 0, "USD").otherwise("EUR").alias("currency"), day.alias("mark_date"))
        .agg(F.round(28 + F.sum(cents("o_totalprice")) / F.count("*") / 10_000_000 + NUDGE, 4).alias("value"))
    )


@shared
def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month-end marks.  Snapshot 0 is clean; snapshot 1 has agreeing and conflicting second
    sources, a spell without EUR rates and no mark for one ticker."""
    prices = _prices(spark, sf_dir, F.last_day(F.to_date("l_shipdate"))).select(
        F.lit("PRICE").alias("mark_type"), "ticker", "currency", "mark_date", "value"
    )
    seeds = (
        prices.select("ticker", "currency")
        .distinct()
        .select(F.lit("PRICE").alias("mark_type"), "ticker", "currency", F.lit(START).alias("mark_date"), F.lit(1000.0).alias("value"))
    )
    rates = _rates(spark, sf_dir, F.last_day(F.to_date("o_orderdate"))).select(
        F.lit("FX").alias("mark_type"), F.lit("").alias("ticker"), "currency", "mark_date", "value"
    )
    rate_seeds = (
        rates.select("currency")
        .distinct()
        .select(F.lit("FX").alias("mark_type"), F.lit("").alias("ticker"), "currency", F.lit(START).alias("mark_date"), F.lit(31.0).alias("value"))
    )
    clean = prices.unionByName(seeds).unionByName(rates).unionByName(rate_seeds).withColumn("source", F.lit("MONTHLY"))
    zero = clean.withColumn("snapshot_id", F.lit(0).cast("bigint"))
    one = clean.where((F.col("currency") != "EUR") | (F.col("mark_type") == "PRICE")).where("ticker <> 'T16'").withColumn(
        "snapshot_id", F.lit(1).cast("bigint")
    )
    second = one.where(F.col("ticker").isin("T3", "T6", "T13")).withColumn("source", F.lit("ALTERNATE"))
    second = second.withColumn("value", F.when(F.col("ticker") == "T13", F.col("value") + 1).otherwise(F.col("value")))
    every = zero.unionByName(one).unionByName(second)
    order = Window.partitionBy("snapshot_id", "mark_date").orderBy("mark_type", "ticker", "currency", "source")
    day = F.datediff("mark_date", F.lit(START)).cast("bigint")
    return every.select(
        "snapshot_id",
        (day * 1000 + F.row_number().over(order)).alias("source_row_number"),
        "mark_date",
        "mark_type",
        "ticker",
        "currency",
        "value",
        "source",
    )


@shared
def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily closes per instrument: SECURITY bars from trades, FX bars from orders."""
    security = _prices(spark, sf_dir, F.to_date("l_shipdate")).select(
        F.lit("SECURITY").alias("instrument_type"), "ticker", "currency", F.col("mark_date").alias("date"), F.col("value").alias("raw_close")
    )
    fx = _rates(spark, sf_dir, F.to_date("o_orderdate")).select(
        F.lit("FX").alias("instrument_type"), F.lit("").alias("ticker"), "currency", F.col("mark_date").alias("date"), F.col("value").alias("raw_close")
    )
    return security.unionByName(fx).withColumn("adjusted_close", F.round(F.col("raw_close") * 0.95 + NUDGE, 4))


def market_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two markets: the bars as they are, and other closes of the same instruments without EUR."""
    first = bars(spark, sf_dir)
    second = first.where("currency <> 'EUR'").withColumn("raw_close", F.round(F.col("raw_close") * 1.25 + NUDGE, 4))
    market = lambda df, n: df.withColumn("market_id", F.lit(n).cast("bigint"))
    return market(first, 0).unionByName(market(second, 1))


def snapshots(accounts: DataFrame, valuation_date: datetime.date = VALUATION_DATE) -> DataFrame:
    """Every fourth account is valued with snapshot 1, the others with snapshot 0."""
    p = F.col("account_id")
    return accounts.select("account_id").distinct().select(
        "account_id",
        F.when(p % 4 == 3, 1).otherwise(0).cast("bigint").alias("snapshot_id"),
        F.lit(valuation_date).alias("valuation_date"),
    )


def clean_snapshots(accounts: DataFrame, valuation_date: datetime.date = VALUATION_DATE) -> DataFrame:
    return accounts.select("account_id").distinct().select(
        "account_id",
        F.lit(0).cast("bigint").alias("snapshot_id"),
        F.lit(valuation_date).alias("valuation_date"),
    )


TODAY = VALUATION_DATE + datetime.timedelta(days=3)


def bindings(tx_: DataFrame, snapshots_: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(state, bound snapshots, market runs): each account's stored version, and the versions its snapshot and its market run were made from.

    Every tenth snapshot and every seventh run (rest 5) are bound to the version before; every seventh
    account (rest 3) has no run, and every seventh run (rest 1) ends nine days before today.
    """
    p = F.col("account_id")
    dataset = lambda revision: F.concat(F.lit("ds-"), p.cast("string"), F.lit("-"), revision.cast("string"))
    revision = (p % 3 + 1).cast("bigint")
    state = tx_.groupBy("account_id").agg(F.max("trade_date").alias("latest_date")).select(
        "account_id", dataset(revision).alias("dataset_id"), revision.alias("stored_revision"), F.lit("parser-1").alias("parser_version"), "latest_date"
    )
    before = lambda late: revision - F.when(late, 1).otherwise(0)
    bound = snapshots_.select(
        "account_id",
        "snapshot_id",
        "valuation_date",
        dataset(before(p % 10 == 9)).alias("bound_dataset_id"),
        before(p % 10 == 9).alias("bound_revision"),
        (p % 2 + 1).cast("bigint").alias("valuation_version"),
    )
    runs = snapshots_.where(p % 7 != 3).select(
        "account_id",
        (p % 4 + 1).cast("bigint").alias("market_revision"),
        dataset(before(p % 7 == 5)).alias("run_dataset_id"),
        before(p % 7 == 5).alias("run_transaction_revision"),
        F.concat(F.lit("run-"), (p % 2).cast("string"), F.lit("-"), (p % 4 + 1).cast("string")).alias("market_source_version"),
        F.date_sub(F.lit(VALUATION_DATE), F.when(p % 7 == 1, 6).otherwise(0)).alias("latest_bar_date"),
    )
    return state, bound, runs


def freshness(tx_: DataFrame, snapshots_: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(freshness, market issues, version vector) of a book, from the versions its parts are bound to."""
    state, bound, runs = bindings(tx_, snapshots_)
    today = F.lit(TODAY)
    valued = versions.binding_freshness(state, bound, is_stale(F.col("valuation_date"), today))
    market = versions.market_freshness(state, runs, is_stale(F.col("latest_bar_date"), today))
    vector = (
        state.withColumnRenamed("stored_revision", "transaction_revision")
        .drop("dataset_id")
        .join(bound.select("account_id", "valuation_date", "bound_revision", "valuation_version"), "account_id", "left")
        .join(runs.drop("run_dataset_id", "market_revision"), "account_id", "left")
        .join(market.select("account_id", "market_freshness"), "account_id", "left")
    )
    issues = market.where("issue_code is not null").select("account_id", "issue_code", "date")
    return stored(valued.select("account_id", "freshness", "freshness_issue")), issues, stored(vector)


def _money_text(c: Column) -> Column:
    """12345.6 as 12,345.60 from whole cents."""
    v = F.round(c * 100).cast("bigint")
    units = F.floor(v / 100)
    head = F.floor(units / 1000)
    whole = F.when(head > 0, F.concat(head, F.lit(","), F.lpad((units % 1000).cast("string"), 3, "0"))).otherwise(units.cast("string"))
    return F.concat(whole, F.lit("."), F.lpad((v % 100).cast("string"), 2, "0"))


@shared
def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transactions as an uploaded file would spell them, with some unusable rows."""
    r = F.col("source_row_number")
    k = F.substring("ticker", 2, 9).cast("int")
    kind = (
        F.when(r % 53 == 0, "SWAP")
        .when((F.col("transaction_type") == "SECURITY") & (r % 5 == 0), "")
        .when((F.col("transaction_type") == "SECURITY") & (F.col("quantity") > 0), " buy")
        .when(F.col("transaction_type") == "SECURITY", "Sell")
        .when(F.col("transaction_type") == "FX_BUY", "換匯買入")
        .when(F.col("transaction_type") == "FX_SELL", "forex_sell")
        .when(F.col("transaction_type") == "CASH_IN", "Deposit")
        .otherwise("出金")
    )
    date = (
        F.when(r % 41 == 0, "1997-02-30")
        .when(r % 43 == 0, F.datediff("trade_date", F.lit(datetime.date(1899, 12, 30))).cast("string"))
        .when(r % 7 == 0, F.date_format("trade_date", "yyyy/M/d"))
        .otherwise(F.date_format("trade_date", "yyyy-MM-dd"))
    )
    security = F.col("transaction_type") == "SECURITY"
    return tx(spark, sf_dir).select(
        "account_id",
        "source_row_number",
        date.alias("交易日期"),
        kind.alias("Trade Type"),
        F.when(r % 61 == 0, "").when(security & (k % 4 == 0), F.concat(F.lit("23"), F.lpad(k.cast("string"), 2, "0"))).otherwise(F.lower("ticker")).alias("股票代號"),
        F.when(security, F.when(r % 5 == 0, F.col("quantity")).otherwise(F.abs("quantity")).cast("bigint").cast("string")).otherwise("").alias("Qty"),
        F.when(r % 59 == 0, "-1").when(security, _money_text(F.col("price"))).otherwise("").alias("price"),
        F.when(security, "").otherwise(_money_text(F.col("amount_foreign"))).alias("Amount"),
        F.when(r % 47 == 0, "").otherwise(F.format_string("%.1f", "fx_rate")).alias("FX Rate"),
        _money_text(F.col("fee")).alias("commission"),
        F.when(security & (k % 4 == 0), "n/a").otherwise(F.lower("currency")).alias("ccy"),
        F.when(r % 3 == 0, " bulk ").otherwise("").alias("memo"),
    )


@shared
def raw_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The marks as an uploaded file would spell them, one file per snapshot."""
    r = F.col("source_row_number")
    return marks(spark, sf_dir).select(
        F.col("snapshot_id").alias("account_id"),
        "source_row_number",
        F.when(F.col("snapshot_id") == 0, "2001/06/30").otherwise(F.date_format("mark_date", "yyyy-MM-dd")).alias("as_of_date"),
        F.when(r % 23 == 0, "2001-6-1").otherwise(F.date_format("mark_date", "yyyy/MM/dd")).alias("標記日期"),
        F.when(r % 29 == 0, "YIELD").when(F.col("mark_type") == "FX", "匯率").otherwise("close").alias("Type"),
        F.col("ticker").alias("symbol"),
        F.when((r % 31 == 0) | (F.col("mark_type") == "PRICE"), "").otherwise(F.col("currency")).alias("ccy"),
        F.when(r % 37 == 0, "-3").otherwise(_money_text(F.col("value"))).alias("close"),
        F.when(F.col("source") == "MONTHLY", "").otherwise(F.col("source")).alias("provider"),
    )
