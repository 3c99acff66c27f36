"""Quality and lineage of every result: status, issue digest, versions and date, one row per account.

A book joins the versions it was built from once; a result picks the issues that concern it.  The
digest is `code:count` per distinct code, in order of the codes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliometry.operators import flows, returns, valuation

P = "account_id"

VALUATION_VERSION = "valuation-1"
PERFORMANCE_VERSION = "performance-1"
RETURNS_VERSION = "returns-1"
FX_COST_VERSION = "fx-cost-1"
SECURITY_FLOW_VERSION = "security-flow-1"
STRATEGY_VERSION = "strategy-1"

#: Notes on an estimate of securities alone, which hold whenever it is complete.
LIMITATIONS = ("ESTIMATED_SECURITY_RETURN_SCOPE", "UNRECORDED_DISTRIBUTIONS_AND_CORPORATE_ACTIONS")
FRESHNESS_CODES = ("TRANSACTION_VERSION_STALE", "VALUATION_DATE_STALE")

#: What a code says to a reader.
MESSAGES = {
    "OVERSELL": "the sale is larger than the holding",
    "CURRENCY_MISMATCH": "the row's currency is not that of the security's first row",
    "NEGATIVE_NET_CASH_IN": "the fee is larger than the deposit",
    "CASH_OUT_EXCEEDS_BALANCE": "the withdrawal and its fee are larger than the balance",
    "INVALID_FX_CURRENCY": "an exchange needs a foreign currency",
    "MISSING_FX_RATE": "the row has no exchange rate",
    "INSUFFICIENT_TWD_FOR_FX_BUY": "the TWD balance does not cover the exchange",
    "FX_SELL_EXCEEDS_BALANCE": "the exchange is larger than the foreign balance",
    "NEGATIVE_NET_FX_PROCEEDS": "the fee is larger than the exchange",
    "MISSING_FX_RATE_FOR_AUTO_FUND": "a purchase lacks foreign cash and has no rate to fund it",
    "INSUFFICIENT_TWD_FOR_AUTO_FUND": "the TWD balance does not cover the automatic funding",
    "INSUFFICIENT_CASH_FOR_SECURITY_BUY": "the balance does not cover the purchase",
    "NEGATIVE_NET_SECURITY_PROCEEDS": "the fee is larger than the sale",
    "INSUFFICIENT_FOREIGN_POOL": "the cost pool holds too few units",
    "MISSING_SECURITY_SALE_FX": "the sale has no exchange rate",
    "MISSING_PRICE": "no price on or before the valuation date",
    "MISSING_FX": "no exchange rate on or before the valuation date",
    "CONFLICTING_MARK": "sources disagree on the newest mark",
    "MISSING_VALUATION": "there is no current valuation",
    "INCOMPLETE_VALUATION": "the valuation is not complete",
    "TRANSACTION_AFTER_VALUATION_DATE": "transactions follow the valuation date",
    "MISSING_EXTERNAL_FLOW_FX": "an external cash flow has no exchange rate",
    "TRANSACTION_VERSION_STALE": "bound to an older version of the transactions",
    "VALUATION_DATE_STALE": "the valuation date is too old",
    "MARKET_DATA_DATE_STALE": "the latest market day is too old",
    "NO_RUN": "no market run is active",
    returns.COVERAGE_ISSUE: "prices alone do not cover total returns",
}

ENVELOPE = ("status", "issues", "as_of_version", "transaction_revision", "valuation_version", "source_version", "calculation_version")


def message(code: Column) -> Column:
    pairs = [F.lit(x) for pair in MESSAGES.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[code], code)


def versions_of(book) -> DataFrame:
    """The book's version vector; a book without one has only its snapshots' dates."""
    if book.versions is not None:
        return book.versions
    columns = {"transaction_revision": "bigint", "bound_revision": "bigint", "valuation_version": "bigint", "run_transaction_revision": "bigint"}
    texts = {"parser_version": "string", "market_source_version": "string", "latest_bar_date": "date", "latest_date": "date", "market_freshness": "string"}
    blank = [F.lit(None).cast(kind).alias(name) for name, kind in (columns | texts).items()]
    return book.freshness.select(P).join(book.snapshots.select(P, "valuation_date"), P, "left").select(P, "valuation_date", *blank)


def coded(df: DataFrame, code: Column | str = "issue_code") -> DataFrame:
    return df.select(P, (F.col(code) if isinstance(code, str) else code).alias("code")).groupBy(P, "code").agg(F.count("*").alias("n"))


def digest(*parts: DataFrame) -> DataFrame:
    """(account_id, issues, n_issues) of issue counts; accounts without an issue are missing."""
    every = reduce(DataFrame.unionByName, parts).groupBy(P, "code").agg(F.sum("n").alias("n"))
    text = F.concat_ws(":", "code", F.col("n").cast("string"))
    return every.groupBy(P).agg(F.array_join(F.sort_array(F.collect_list(text)), ",").alias("issues"), F.sum("n").alias("n_issues"))


def by_freshness(freshness: Column, n: Column) -> Column:
    """STALE outranks INCOMPLETE (no snapshot or run, or any issue), which outranks COMPLETE."""
    return F.when(freshness == "STALE", "STALE").when((freshness != "CURRENT") | (n > 0), "INCOMPLETE").otherwise("COMPLETE")


class Issues:
    """Issue counts of a book by what they concern, as (account_id, code, n)."""

    def __init__(self, book):
        self.book = book

    def domain(self, name: str) -> DataFrame:
        """Of one domain, without reading what the others are made from."""
        found = coded(self.book.issue_rows(self.book, name), "code")
        return found.where(~F.col("code").isin(*FRESHNESS_CODES, returns.COVERAGE_ISSUE))

    @property
    def freshness(self) -> DataFrame:
        return coded(self.book.freshness.where("freshness_issue is not null"), "freshness_issue")

    def absent(self, code: str) -> DataFrame:
        """One issue for each account without a current valuation."""
        return coded(self.book.freshness.where("freshness <> 'CURRENT'"), F.lit(code))

    @property
    def own_valuation(self) -> DataFrame:
        """Of the snapshot's own valuation, current or not."""
        return coded(valuation.valuation_issues(self.book.components, self.book.marks, self.book.snapshots))

    @property
    def market(self) -> DataFrame:
        return coded(self.book.market_issues)

    def security(self, terminal: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Issues of the security flows, and (account_id, complete)."""
        summary = flows.security_summary(self.book.tx, terminal)
        rows = coded(flows.security_events(self.book.tx, terminal).where("issue_code is not null"))
        late = self.book.tx.where("transaction_type = 'SECURITY'").join(terminal.select(P, "valuation_date"), P).where("trade_date > valuation_date")
        late = coded(late.select(P).distinct(), F.lit("TRANSACTION_AFTER_VALUATION_DATE"))
        unvalued = terminal.where("not positions_complete or position_value_twd is null or position_value_twd < 0")
        return digest_parts(rows, late, coded(unvalued, F.lit("INCOMPLETE_VALUATION"))), summary.select(P, "complete")


def digest_parts(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def of_resource(book, name: str, security_terminal) -> DataFrame:
    """(account_id, *ENVELOPE) of a resource's rows."""
    issues, v = Issues(book), versions_of(book)
    source = F.coalesce("market_source_version", "parser_version")
    revision, as_of, version, status = F.col("transaction_revision"), F.col("valuation_date"), F.lit(None).cast("string"), None
    extra = None
    if name == "account_snapshot":
        parts, version = (issues.freshness, issues.domain("VALUATION"), issues.absent("MISSING_VALUATION")), F.lit(VALUATION_VERSION)
    elif name == "transactions":
        parts, as_of, source, status = (issues.domain("TRANSACTIONS"),), F.col("latest_date"), F.col("parser_version"), "plain"
    elif name == "cash_flows":
        unrated = book.tx.where("transaction_type in ('CASH_IN', 'CASH_OUT') and currency <> 'TWD' and fx_rate is null")
        parts, as_of, version, status = (coded(unrated, F.lit("MISSING_EXTERNAL_FLOW_FX")),), F.col("latest_date"), F.lit(PERFORMANCE_VERSION), "plain"
    elif name == "security_cash_flows":
        blocking, extra = issues.security(security_terminal(book))
        limits = digest_parts(*[coded(extra.where("complete"), F.lit(code)) for code in LIMITATIONS])
        parts, revision, source, version, status = (issues.freshness, blocking, limits), F.col("bound_revision"), F.col("parser_version"), F.lit(SECURITY_FLOW_VERSION), "estimate"
    elif name == "positions":
        parts = (issues.freshness, issues.domain("TRANSACTIONS"), issues.domain("FX_COST"), issues.domain("VALUATION"), issues.absent("STALE_OR_MISSING_VALUATION"))
        version = F.lit(f"{VALUATION_VERSION}+{FX_COST_VERSION}")
    elif name == "valuations":
        parts, revision, source, version = (issues.freshness, issues.own_valuation), F.col("bound_revision"), F.col("parser_version"), F.lit(VALUATION_VERSION)
    elif name in ("market_prices", "fx_rates"):
        parts, as_of, source, revision, status = (issues.market,), F.col("latest_bar_date"), F.col("market_source_version"), F.col("run_transaction_revision"), "market"
    elif name == "strategy_comparison":
        parts, version, status = (issues.absent("MISSING_VALUATION").where("false"),), F.lit(STRATEGY_VERSION), "rows"
    else:
        parts, status = (coded(book.every_issue, "code"),), "all"

    df = book.freshness.select(P, "freshness").join(v, P, "left").join(digest(*parts), P, "left")
    n = F.coalesce("n_issues", F.lit(0))
    state = by_freshness(F.col("freshness"), n)
    if status == "plain":
        state = F.when(n > 0, "INCOMPLETE").otherwise("COMPLETE")
    elif status == "market":
        state = by_freshness(F.col("market_freshness"), n)
    elif status == "estimate":
        df = df.join(extra, P, "left")
        state = F.when(F.coalesce("complete", F.lit(False)) & (F.col("freshness") == "CURRENT"), "ESTIMATED").otherwise(state)
    elif status == "all":
        state = F.when(n == 0, "COMPLETE").when((F.col("freshness") == "STALE") | F.coalesce(F.col("market_freshness") == "STALE", F.lit(False)), "STALE").otherwise("INCOMPLETE")
    elif status == "rows":
        state = F.lit(None).cast("string")
    columns = (F.coalesce("issues", F.lit("")), as_of, revision, F.col("valuation_version"), source, version)
    return df.select(P, state.alias("status"), *[c.alias(name) for c, name in zip(columns, ENVELOPE[1:])])


def of_metric(book, name: str, parameters: dict) -> DataFrame:
    """(account_id, issues, transaction_revision, valuation_version, source_version): issues hold where the metric is not COMPLETE."""
    issues, v = Issues(book), versions_of(book)
    revision = F.col("transaction_revision")
    if name in ("nav", "cash_ratio"):
        parts, revision = (issues.freshness, issues.own_valuation), F.col("bound_revision")
    elif name in ("twr", "max_drawdown"):
        found = returns.twr_issues(book.observations, parameters.get("coverage", "PRICE_ONLY"))
        parts, revision = (issues.freshness, coded(found)), F.col("bound_revision")
    elif name == "xirr":
        parts = (issues.freshness, issues.domain("PERFORMANCE"))
    else:
        whole = book.reconciliation.where("complete").join(book.freshness.where("freshness = 'CURRENT'").select(P), P, "left_semi").select(P)
        open_ = book.freshness.select(P).join(whole, P, "left_anti")
        parts = (issues.freshness, issues.domain("FX_COST"), coded(open_, F.lit("INCOMPLETE_COST_RECONCILIATION")))
    df = book.freshness.select(P).join(v, P, "left").join(digest(*parts), P, "left")
    return df.select(P, F.coalesce("issues", F.lit("")).alias("issues"), revision.alias("transaction_revision"), "valuation_version", F.coalesce("market_source_version", "parser_version").alias("source_version"))
