"""The account tables a query starts from, for one transaction table and its snapshots."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliometry.operators import backtest, cash_ledger, fx_ledger, gate, market, nav, position_ledger, returns, valuation
from foliometry.plans import fixtures
from foliometry.runtime import plain_unions, stored


@dataclass
class Book:
    """Lazy frames over one set of transactions; a frame is built once however often it is read."""

    tx: DataFrame
    marks: DataFrame
    snapshots: DataFrame
    freshness: DataFrame  # account_id, freshness, freshness_issue
    bars: DataFrame | None = None  # merged market bars with market_id
    market_issues: DataFrame | None = None  # account_id, issue_code, date
    markets: DataFrame | None = None  # account_id, market_id
    requests: DataFrame | None = None  # strategy requests with request_id and account_id
    prices: DataFrame | None = None  # ticker, date, price_twd, issue_code
    versions: DataFrame | None = None  # account_id and the versions its parts were made from
    issue_rows: Callable[[Book, str | None], DataFrame] | None = None  # issues of one domain, or of all

    @cached_property
    def every_issue(self) -> DataFrame:
        """Issues of all domains, written once: rows and their digest read them."""
        return stored(self.issue_rows(self, None))

    @cached_property
    def security_ledger(self) -> DataFrame:
        return stored(position_ledger.position_ledger(self.tx, side_by_side=True))

    @cached_property
    def cash_ledger(self) -> DataFrame:
        return stored(cash_ledger.cash_ledger(self.tx))

    @cached_property
    def fx_ledger(self) -> DataFrame:
        return stored(fx_ledger.fx_ledger(self.tx))

    @cached_property
    def tracking(self) -> DataFrame:
        return cash_ledger.tracking(self.tx)

    @cached_property
    def nav_dates(self) -> DataFrame:
        return nav.nav_dates(self.tx, self.marks, self.snapshots)

    @cached_property
    def comparison(self) -> tuple[DataFrame, DataFrame]:
        """Backtest summary and curves of all requests."""
        summary, curve = backtest.compare(self.requests, self.prices, self.tx, max_gap_days=market.MAX_GAP_DAYS)
        return stored(summary), curve

    @cached_property
    def strategies(self) -> DataFrame:
        """Backtest summary rows with the account of their request."""
        return self.comparison[0].join(self.requests.select("request_id", "account_id"), "request_id")

    @cached_property
    def nav_points(self) -> DataFrame:
        points = nav.nav_points(
            self.tx,
            self.security_ledger,
            self.cash_ledger,
            self.fx_ledger,
            self.tracking,
            self.marks,
            self.snapshots,
            self.nav_dates,
        )
        return stored(points)

    @cached_property
    def observations(self) -> DataFrame:
        return returns.observations(self.nav_points)

    @cached_property
    def positions(self) -> DataFrame:
        return position_ledger.positions(self.security_ledger)

    @cached_property
    def wallets(self) -> DataFrame:
        return cash_ledger.wallets(self.cash_ledger)

    @cached_property
    def pools(self) -> DataFrame:
        return fx_ledger.pools(self.fx_ledger)

    @cached_property
    def basis(self) -> DataFrame:
        return fx_ledger.security_basis(self.fx_ledger)

    @cached_property
    def components(self) -> DataFrame:
        return stored(valuation.components(self.positions, self.wallets, self.marks, self.snapshots))

    @cached_property
    def totals(self) -> DataFrame:
        return valuation.valuation_totals(self.components, self.marks, self.snapshots)

    @cached_property
    def fx_issues(self) -> DataFrame:
        return gate.ledger_issues(self.fx_ledger, "FX_COST")

    @cached_property
    def reconciled(self) -> DataFrame:
        return valuation.reconcile(self.components, self.basis)

    @cached_property
    def reconciliation(self) -> DataFrame:
        return valuation.reconciliation_totals(self.reconciled, self.totals, self.basis, self.pools, self.fx_issues)


_books: dict[tuple, Book] = {}


def book(spark: SparkSession, sf_dir: str, clean: bool = False) -> Book:
    """Books are kept per session: ledgers are written once, so every query over them shares one fold."""
    plain_unions(spark)
    key = fixtures.key_of(clean, spark, sf_dir)
    if key not in _books:
        tx = fixtures.tx_clean(spark, sf_dir) if clean else fixtures.tx(spark, sf_dir)
        snapshots = stored(fixtures.clean_snapshots(tx) if clean else fixtures.snapshots(tx))
        freshness, market_issues, versions = fixtures.freshness(tx, snapshots)
        markets = snapshots.select("account_id", (F.col("account_id") % 2).alias("market_id"))
        _books[key] = Book(
            tx, fixtures.marks(spark, sf_dir), snapshots, freshness, fixtures.market_bars(spark, sf_dir), market_issues, markets, versions=versions
        )
    return _books[key]
