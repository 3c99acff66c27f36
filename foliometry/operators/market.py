"""Market-data revisions, instrument universe, marks from bars and strategy price series.

``runs`` has (market_id, run_id, revision, status); ``segments`` one row per run and instrument with
its bars as an array of structs.  Corrections arrive as later revisions and win per day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliometry.functions.hashing import combined_hash, observation_hash
from foliometry.functions.market import adjusted_price_twd, provider_fx_symbol, quote_scale
from foliometry.operators.marks import fx_with_tolerance
from foliometry.schema import BASE_CURRENCY, SECURITY

P = "account_id"
INSTRUMENT = ("instrument_type", "ticker", "currency")
READABLE = ("ACTIVE", "ARCHIVED")
BENCHMARK = "SPY"
OVERLAP_DAYS = 10
MAX_GAP_DAYS = 14


def active_revision(runs: DataFrame) -> DataFrame:
    return runs.where("status = 'ACTIVE'").groupBy("market_id").agg(F.max("revision").alias("active_revision"))


def exploded_segments(segments: DataFrame, runs: DataFrame) -> DataFrame:
    """Bars of every readable run up to the active revision of its market."""
    readable = (
        runs.where(F.col("status").isin(*READABLE))
        .join(active_revision(runs), "market_id")
        .where("revision <= active_revision")
        .select("market_id", "run_id", "revision")
    )
    return segments.join(readable, ["market_id", "run_id"]).select(
        "market_id", "revision", *INSTRUMENT, F.inline("bars")
    )


def merged_bars(exploded: DataFrame) -> DataFrame:
    """The newest revision wins per instrument and day; an aggregate, so copies combine before the shuffle."""
    newest = F.max_by(F.struct("raw_close", "adjusted_close"), "revision")
    return (
        exploded.groupBy("market_id", *INSTRUMENT, "date")
        .agg(newest.alias("bar"), F.max("revision").alias("revision"))
        .select("market_id", *INSTRUMENT, "date", "bar.raw_close", "bar.adjusted_close", "revision")
    )


def marks_from_bars(bars: DataFrame) -> DataFrame:
    """FX bars become FX marks without ticker, all others PRICE marks, numbered by date."""
    fx = F.col("instrument_type") == "FX"
    df = bars.select(
        "market_id",
        F.col("date").alias("mark_date"),
        F.when(fx, "FX").otherwise("PRICE").alias("mark_type"),
        F.when(fx, "").otherwise(F.col("ticker")).alias("ticker"),
        "currency",
        F.col("raw_close").alias("value"),
        "instrument_type",
    )
    days = df.groupBy("market_id", "mark_date").agg(F.count("*").alias("n"))
    before = Window.partitionBy("market_id").orderBy("mark_date").rowsBetween(Window.unboundedPreceding, -1)
    offsets = days.select("market_id", "mark_date", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("market_id", "mark_date").orderBy("instrument_type", "currency", "ticker")
    return (
        df.join(offsets, ["market_id", "mark_date"])
        .withColumn("source_row_number", F.col("offset") + F.row_number().over(inside))
        .select("market_id", "source_row_number", "mark_date", "mark_type", "ticker", "currency", "value")
    )


def latest_dates(exploded: DataFrame) -> DataFrame:
    return exploded.groupBy("market_id", *INSTRUMENT).agg(F.max("date").alias("latest_date"))


def instrument_universe(tx: DataFrame, latest: DataFrame | None = None, markets: DataFrame | None = None) -> DataFrame:
    """Instruments to refresh per account, with the first day needed.

    Securities ever traded, foreign currencies seen, and the benchmark with USD from the start of
    the account where it is not traded.  Known history moves the start to its end less an overlap: the
    history of the account's market, where ``markets`` (account, market_id) links them, else the
    earliest end of any market, so that no market is left with a gap.
    """
    securities = (
        tx.where(F.col("transaction_type") == SECURITY)
        .groupBy(P, "ticker")
        .agg(F.min_by("currency", F.struct("trade_date", "source_row_number")).alias("currency"), F.min("trade_date").alias("start_date"))
    )
    currencies = tx.where(F.col("currency") != BASE_CURRENCY).groupBy(P, "currency").agg(F.min("trade_date").alias("start_date"))
    starts = tx.groupBy(P).agg(F.min("trade_date").alias("start_date"), F.count_if(F.col("transaction_type") == SECURITY).alias("n"))
    unbenchmarked = starts.where("n > 0").join(
        securities.where(F.col("ticker") == BENCHMARK).select(P), P, "left_anti"
    )
    fx = (
        currencies.unionByName(unbenchmarked.select(P, F.lit("USD").alias("currency"), "start_date"))
        .groupBy(P, "currency")
        .agg(F.min("start_date").alias("start_date"))
    )
    traded = starts.where("n > 0").select(P)
    every = (
        securities.select(P, F.lit("SECURITY").alias("instrument_type"), "ticker", "currency", F.col("ticker").alias("provider_symbol"), "start_date")
        .unionByName(
            unbenchmarked.select(
                P,
                F.lit("BENCHMARK").alias("instrument_type"),
                F.lit(BENCHMARK).alias("ticker"),
                F.lit("USD").alias("currency"),
                F.lit(BENCHMARK).alias("provider_symbol"),
                "start_date",
            )
        )
        .unionByName(
            fx.join(traded, P, "left_semi").select(
                P,
                F.lit("FX").alias("instrument_type"),
                F.lit("").alias("ticker"),
                "currency",
                provider_fx_symbol(F.col("currency")).alias("provider_symbol"),
                "start_date",
            )
        )
    )
    if latest is None:
        return every
    if markets is None:
        known = latest.groupBy(*INSTRUMENT).agg(F.min("latest_date").alias("latest_date"))
        dated = every.join(known, list(INSTRUMENT), "left")
    else:
        known = latest.groupBy("market_id", *INSTRUMENT).agg(F.max("latest_date").alias("latest_date"))
        dated = every.join(markets.select(P, "market_id").distinct(), P, "left").join(known, ["market_id", *INSTRUMENT], "left")
    return (
        dated
        .withColumn("start_date", F.greatest("start_date", F.date_sub("latest_date", OVERLAP_DAYS)))
        .select(*every.columns)
    )


def universe_issues(tx: DataFrame, universe: DataFrame, max_instruments: int | None = None) -> DataFrame:
    """Accounts whose universe cannot be refreshed; ``max_instruments`` is a limit of the caller, off by default."""
    mixed = (
        tx.where(F.col("transaction_type") == SECURITY)
        .groupBy(P, "ticker")
        .agg(F.count_distinct("currency").alias("n"))
        .where("n > 1")
        .select(P, F.lit("CONFLICTING_CURRENCY").alias("issue_code"), "ticker")
    )
    none = (
        tx.groupBy(P)
        .agg(F.count_if(F.col("transaction_type") == SECURITY).alias("n"))
        .where("n = 0")
        .select(P, F.lit("NO_SECURITY").alias("issue_code"), F.lit("").alias("ticker"))
    )
    if max_instruments is None:
        return mixed.unionByName(none)
    many = (
        universe.groupBy(P)
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > max_instruments)
        .select(P, F.lit("TOO_MANY_INSTRUMENTS").alias("issue_code"), F.lit("").alias("ticker"))
    )
    return mixed.unionByName(none).unionByName(many)


def refresh_marks(bars: DataFrame) -> DataFrame:
    """Last close of each instrument but benchmarks, with the valuation date of its market."""
    last = (
        bars.where("instrument_type <> 'BENCHMARK'")
        .groupBy("market_id", *INSTRUMENT)
        .agg(F.max("date").alias("mark_date"), F.max_by("raw_close", "date").alias("value"))
    )
    dates = last.groupBy("market_id").agg(F.max("mark_date").alias("valuation_date"))
    return last.join(dates, "market_id").select(
        "market_id",
        "mark_date",
        F.when(F.col("instrument_type") == "FX", "FX").otherwise("PRICE").alias("mark_type"),
        F.when(F.col("instrument_type") == "FX", "").otherwise(F.col("ticker")).alias("ticker"),
        "currency",
        "value",
        "valuation_date",
    )


def run_summary(exploded: DataFrame) -> DataFrame:
    """Counts and span of each revision."""
    per = instrument_summary(exploded)
    return per.groupBy("market_id", "revision").agg(
        F.count("*").alias("instrument_count"),
        F.sum("bar_count").alias("bar_count"),
        F.min("earliest_bar_date").alias("earliest_bar_date"),
        F.max("latest_bar_date").alias("latest_bar_date"),
    )


def instrument_summary(exploded: DataFrame) -> DataFrame:
    """Counts, span and latest close of each instrument of a revision."""
    return exploded.groupBy("market_id", "revision", *INSTRUMENT).agg(
        F.count("*").alias("bar_count"),
        F.min("date").alias("earliest_bar_date"),
        F.max("date").alias("latest_bar_date"),
        F.max_by("raw_close", "date").alias("latest_raw_close"),
    )


def with_row_hash(bars: DataFrame) -> DataFrame:
    c = F.col
    return bars.withColumn(
        "row_hash",
        observation_hash(c("instrument_type"), c("ticker"), c("currency"), c("date"), c("raw_close"), c("adjusted_close")),
    )


def series_hash(bars: DataFrame) -> DataFrame:
    """One hash per instrument over its days in date order (an instrument has one bar per day)."""
    rows = with_row_hash(bars).groupBy("market_id", *INSTRUMENT).agg(
        F.array_sort(F.collect_list(F.struct("date", "row_hash"))).alias("rows")
    )
    return rows.select("market_id", *INSTRUMENT, F.sha2(F.array_join(F.col("rows.row_hash"), "|"), 256).alias("series_hash"))


def source_version(bars: DataFrame) -> DataFrame:
    """One version per market over the hashes of its instruments."""
    return series_hash(bars).groupBy("market_id").agg(combined_hash(F.collect_list("series_hash")).alias("source_version"))


def history_gaps(dates: DataFrame, key: list[str], start, end, limit: int = MAX_GAP_DAYS) -> DataFrame:
    """TRUNCATED or GAPPED per key: late first day, early last day, or an inner gap over the limit."""
    in_order = Window.partitionBy(*key).orderBy("date")
    gap = F.datediff("date", F.lag("date").over(in_order))
    per = (
        dates.select(*key, "date", start.alias("window_start"), end.alias("window_end"))
        .withColumn("gap", gap)
        .groupBy(*key)
        .agg(
            F.datediff(F.min("date"), F.first("window_start")).alias("head"),
            F.datediff(F.first("window_end"), F.max("date")).alias("tail"),
            F.max("gap").alias("widest_gap"),
        )
    )
    code = F.when((F.col("head") > limit) | (F.col("tail") > limit), "TRUNCATED_HISTORY").when(
        F.col("widest_gap") > limit, "GAPPED_HISTORY"
    )
    return per.select(*key, "head", "tail", "widest_gap", code.alias("issue_code"))


def strategy_prices(bars: DataFrame) -> DataFrame:
    """Total-return price in TWD per ticker and day; a hole is an issue, never a skipped day.

    Markets are kept apart where the bars name them (``market_id``), and quotes in sub-units are scaled
    where the bars carry a ``quote_unit``.
    """
    market = [c for c in ("market_id",) if c in bars.columns]
    scale = quote_scale(F.col("quote_unit")) if "quote_unit" in bars.columns else F.lit(1.0)
    prices = bars.where("instrument_type <> 'FX'").select(*market, "ticker", "currency", "date", "adjusted_close", scale.alias("scale"))
    rates = fx_with_tolerance(bars, prices.where(F.col("currency") != BASE_CURRENCY))
    df = prices.join(rates, [*market, "currency", "date"], "left").withColumn(
        "fx", F.when(F.col("currency") == BASE_CURRENCY, 1.0).otherwise(F.col("rate"))
    )
    adjusted = F.col("adjusted_close")
    unusable = adjusted.isNull() | F.isnan(adjusted) | (adjusted <= 0)
    price = adjusted_price_twd(adjusted, F.col("scale"), F.col("fx"))
    return df.select(
        *market,
        "ticker",
        "date",
        price.alias("price_twd"),
        F.when(unusable, "MISSING_ADJUSTED_CLOSE")
        .when(F.col("fx").isNull(), "MISSING_HISTORICAL_FX")
        .when(price.isNull(), "INVALID_PRICE")
        .alias("issue_code"),
    )
