"""Query surface: ten resources and seven metrics over a book, with filter, projection, sort, page.

A resource is a lazy DataFrame builder plus the fields, filters and sorts it allows.  Everything is
keyed by account; filters and projections are put on top of the lazy frame, so Catalyst pushes
them down.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliometry.functions.search import equals_text, from_date, to_date
from foliometry.operators import flows, gate, returns, valuation
from foliometry.plans import envelope
from foliometry.plans.envelope import FX_COST_VERSION, PERFORMANCE_VERSION, RETURNS_VERSION, VALUATION_VERSION
from foliometry.plans.envelope import by_freshness as status
from foliometry.plans.account import Book
from foliometry.schema import twd_rate

P = "account_id"
VERSION = "1"
DEFAULT_PAGE, MAX_PAGE = 100, 500  # fixed values


class QueryError(ValueError):
    def __init__(self, code: str, message: str) -> None:
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    description: str
    nullable: bool = False
    unit: str | None = None
    values: tuple[str, ...] = ()


@dataclass(frozen=True)
class Resource:
    name: str
    description: str
    fields: tuple[Field, ...]
    build: Callable[[Book], DataFrame]
    filters: dict[str, str] = field(default_factory=dict)  # filter name -> column
    sorts: tuple[str, ...] = ()
    order: tuple[str, ...] = (P,)  # tie-break, so that pages are stable
    date: str | None = None
    paged: bool = True
    version: str = VERSION
    key: str = P  # the first column; a resource of markets is read through the account's market


@dataclass(frozen=True)
class Metric:
    name: str
    description: str
    unit: str
    version: str
    build: Callable[..., DataFrame]
    parameters: tuple[str, ...] = ()


RESOURCES: dict[str, Resource] = {}
METRICS: dict[str, Metric] = {}


def register_resource(resource: Resource) -> None:
    if resource.name in RESOURCES:
        raise QueryError("DUPLICATE_RESOURCE", resource.name)
    RESOURCES[resource.name] = resource


def register_metric(metric: Metric) -> None:
    if metric.name in METRICS:
        raise QueryError("DUPLICATE_METRIC", metric.name)
    METRICS[metric.name] = metric


def list_resources(spark: SparkSession) -> DataFrame:
    rows = [(r.name, r.description, r.version) for r in sorted(RESOURCES.values(), key=lambda r: r.name)]
    return spark.createDataFrame(rows, "name string, description string, version string")


def describe(spark: SparkSession, name: str) -> DataFrame:
    r = _resource(name)
    rows = [
        (f.name, f.kind, f.description, f.nullable, f.unit, list(f.values), f.name in r.filters.values(), f.name in r.sorts)
        for f in r.fields
    ]
    schema = "field string, type string, description string, nullable boolean, unit string, enum_values array<string>, filterable boolean, sortable boolean"
    return spark.createDataFrame(rows, schema)


def list_metrics(spark: SparkSession) -> DataFrame:
    rows = [(m.name, m.description, m.unit, m.version, list(m.parameters)) for m in sorted(METRICS.values(), key=lambda m: m.name)]
    return spark.createDataFrame(rows, "name string, description string, unit string, calculation_version string, allowed_parameters array<string>")


def _resource(name: str) -> Resource:
    if name not in RESOURCES:
        raise QueryError("UNKNOWN_RESOURCE", name)
    return RESOURCES[name]


def _allowed(given, allowed, code: str) -> None:
    unknown = [g for g in given if g not in allowed]
    if unknown:
        raise QueryError(code, ", ".join(unknown))


def select(
    book: Book,
    name: str,
    fields: list[str] | None = None,
    filters: dict | None = None,
    sort: tuple[str, str] | None = None,
) -> DataFrame:
    """All matching rows, lazily; ``sort`` is (field, asc or desc), nulls first ascending."""
    r = _resource(name)
    names = [f.name for f in r.fields]
    chosen = fields or names
    filters = filters or {}
    _allowed(chosen, names, "INVALID_FIELD")
    dated = ["from", "to"] if r.date else []
    _allowed(filters, [P, *r.filters, *dated], "INVALID_FILTER")
    if sort:
        _allowed([sort[0]], r.sorts, "INVALID_SORT")
    df = r.build(book)
    for key, value in filters.items():
        if key == "from":
            df = df.where(from_date(F.col(r.date), value))
        elif key == "to":
            df = df.where(to_date(F.col(r.date), value))
        elif key == P and r.key == P:
            df = df.where(F.col(P) == value)
        elif key == P:
            own = book.markets.where(F.col(P) == value).select(r.key).distinct()
            df = df.join(own, r.key, "left_semi")
        else:
            df = df.where(equals_text(F.col(r.filters[key]), value))
    if sort:
        column = F.col(sort[0])
        first = column.desc_nulls_last() if sort[1] == "desc" else column.asc_nulls_first()
        df = df.orderBy(first, *[c for c in r.order if c != sort[0]])
    return df.select(r.key, *[c for c in chosen if c != r.key])


def encode_cursor(name: str, position: object) -> str:
    text = json.dumps({"resource": name, "version": _resource(name).version, "position": position})
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def decode_cursor(name: str, cursor: str) -> dict:
    """{sort, after, seen}: the sort, the order key of the last row given, and how many equal rows were given with it."""
    try:
        data = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        position = data["position"]
        if data["resource"] != name or data["version"] != _resource(name).version or set(position) != {"sort", "after", "seen"}:
            raise ValueError
        if not isinstance(position["after"], list) or not isinstance(position["seen"], int) or position["seen"] < 1:
            raise ValueError
    except (ValueError, KeyError, TypeError) as e:
        raise QueryError("INVALID_CURSOR", "not a cursor of this resource version") from e
    return position


def _order(r: Resource, sort: tuple[str, str] | None) -> list[tuple[str, bool]]:
    """(column, descending) of a total order: the sort, the tie-break and then all other fields."""
    first = [(sort[0], sort[1] == "desc")] if sort else []
    rest = [*r.order, *[f.name for f in r.fields if f.name not in r.order]]
    return first + [(c, False) for c in rest if not sort or c != sort[0]]


def _beyond(df: DataFrame, order: list[tuple[str, bool]], after: list) -> Column:
    """Rows at or after a key; nulls come first ascending and last descending."""
    reached, same = F.lit(False), F.lit(True)
    for (name, descending), value in zip(order, after, strict=True):
        column, bound = F.col(name), F.lit(value).cast(df.schema[name].dataType)
        if value is None:
            later = F.lit(False) if descending else column.isNotNull()
        else:
            later = (column < bound) | column.isNull() if descending else column > bound
        reached, same = reached | (same & F.coalesce(later, F.lit(False))), same & column.eqNullSafe(bound)
    return reached | same


def page(book: Book, name: str, limit: int | None = None, cursor: str | None = None, **query) -> tuple[DataFrame, str | None]:
    """One page of a query and the cursor of the next page, null at the end.

    The cursor holds the last row's place in a total order, so a later page reads the rows behind it
    as a top-k and skips only rows equal to that one.  The query runs once; a page is at most
    MAX_PAGE rows.
    """
    r = _resource(name)
    if not r.paged:
        if limit is not None or cursor is not None:
            raise QueryError("PAGINATION_NOT_SUPPORTED", name)
        return select(book, name, **query), None
    limit = DEFAULT_PAGE if limit is None else limit
    if not 1 <= limit <= MAX_PAGE:
        raise QueryError("INVALID_PAGE_SIZE", f"limit must be 1 to {MAX_PAGE}")
    sort, fields = query.get("sort"), query.get("fields")
    position = decode_cursor(name, cursor) if cursor else None
    if position and position["sort"] != (list(sort) if sort else None):
        raise QueryError("INVALID_CURSOR", "the cursor belongs to another sort")
    _allowed(fields or [], [f.name for f in r.fields], "INVALID_FIELD")
    if sort:
        _allowed([sort[0]], r.sorts, "INVALID_SORT")
    order = _order(r, sort)
    df = select(book, name, filters=query.get("filters"))
    rows = df
    if position:
        if len(position["after"]) != len(order):
            raise QueryError("INVALID_CURSOR", "not a cursor of this resource version")
        rows = df.where(_beyond(df, order, position["after"]))
    rows = rows.orderBy(*[F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_first() for c, down in order])
    seen = position["seen"] if position else 0
    found = rows.offset(seen).limit(limit + 1).collect()
    given = found[:limit]
    following = None
    if len(found) > limit:
        key = lambda row: [row[c] for c, _ in order]
        last = key(given[-1])
        equal = sum(1 for row in given if key(row) == last)
        plain = [v.isoformat() if hasattr(v, "isoformat") else v for v in last]
        if equal == len(given) and position and position["after"] == plain:
            equal += seen
        following = encode_cursor(name, {"sort": list(sort) if sort else None, "after": plain, "seen": equal})
    chosen = fields or [f.name for f in r.fields]
    return df.sparkSession.createDataFrame(given, df.schema).select(r.key, *[c for c in chosen if c != r.key]), following


def with_lineage(book: Book, name: str, rows: DataFrame, account_id: int | None = None) -> DataFrame:
    """rows of a resource, each with the status, issue digest and versions of its account's result.

    Rows of a market have those of one account that reads it, which must be named.
    """
    quality = envelope.of_resource(_with_issues(book), name, security_terminal)
    if _resource(name).key != P:
        if account_id is None:
            raise QueryError("MISSING_ACCOUNT", "rows of a market have a quality for an account only")
        quality = quality.join(book.markets, P).where(F.col(P) == account_id)
        return rows.join(quality, _resource(name).key)
    taken = [c for c in quality.columns if c != P and c in rows.columns]
    return rows.join(quality.drop(*taken), P)


def _with_issues(book: Book) -> Book:
    book.issue_rows = book.issue_rows or issue_rows
    return book


def evaluate(book: Book, name: str, **parameters) -> DataFrame:
    if name not in METRICS:
        raise QueryError("UNKNOWN_METRIC", name)
    m = METRICS[name]
    _allowed(parameters, m.parameters, "INVALID_METRIC_PARAMETER")
    if parameters.get("from_") and parameters.get("to") and parameters["from_"] > parameters["to"]:
        raise QueryError("INVALID_METRIC_PARAMETER", "from lies after to")
    quality = envelope.of_metric(_with_issues(book), name, parameters)
    return m.build(book, **parameters).join(quality, P, "left").select(
        P,
        F.lit(name).alias("metric"),
        "value",
        F.lit(m.unit).alias("unit"),
        "period_from",
        "period_to",
        F.col("period_to").alias("as_of"),
        "status",
        F.lit(m.version).alias("calculation_version"),
        F.when(F.col("status") == "COMPLETE", "").otherwise(F.col("issues")).alias("issues"),
        "transaction_revision",
        "valuation_version",
        "source_version",
    )


# --- frames shared by resources and metrics -----------------------------------------------------


def current_totals(book: Book) -> DataFrame:
    """Valuation totals with freshness; accounts without a snapshot keep a row of nulls."""
    return book.freshness.join(book.totals, P, "left")


def terminal(book: Book) -> DataFrame:
    """End value for performance: only a current valuation counts."""
    current = F.col("freshness") == "CURRENT"
    return current_totals(book).select(
        P,
        F.when(current, F.col("valuation_date")).alias("valuation_date"),
        F.coalesce(current & F.col("complete"), F.lit(False)).alias("complete"),
        F.when(current, F.col("total_assets_twd")).alias("total_assets_twd"),
    )


def security_terminal(book: Book) -> DataFrame:
    """End value for security flows: the snapshot's own, current or not."""
    return book.totals.select(
        P, "valuation_date", "positions_complete", F.col("known_position_value_twd").alias("position_value_twd")
    )


def _count(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy(P).agg(F.count("*").alias(name))


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0))


# --- resources ----------------------------------------------------------------------------------


def account_snapshot(book: Book) -> DataFrame:
    open_ = _count(book.positions.where("abs(quantity) > 1e-9"), "open_position_count")
    # the position count of the totals is of valued components; the snapshot counts held positions
    df = (
        current_totals(book)
        .drop("open_position_count")
        .join(open_, P, "left")
        .join(_count(book.tx, "transaction_count"), P, "left")
    )
    current = F.col("freshness") == "CURRENT"
    whole = current & F.col("complete")
    return df.select(
        P,
        F.col("valuation_date").alias("as_of"),
        F.lit("TWD").alias("base_currency"),
        F.when(current, F.col("total_assets_twd")).alias("total_assets_twd"),
        F.when(whole, F.col("known_position_value_twd")).alias("position_value_twd"),
        F.when(whole, F.col("known_cash_value_twd")).alias("cash_value_twd"),
        _zero("open_position_count").alias("open_position_count"),
        _zero("transaction_count").alias("transaction_count"),
        status(F.col("freshness"), _zero("blocking_issue_count")).alias("valuation_status"),
    )


_OPTIONAL = (("budget_waterline", "double"), ("budget_balance", "double"), ("note", "string"))


def transactions(book: Book) -> DataFrame:
    return book.tx.select(
        P,
        _transaction_id(book).alias("transaction_id"),
        "source_row_number",
        F.col("trade_date").alias("date"),
        F.col("transaction_type").alias("type"),
        F.col("ticker").alias("symbol"),
        "currency",
        "quantity",
        "price",
        "amount_foreign",
        F.col("fx_rate").alias("fx_rate_twd"),
        "fee",
        *[(F.col(c) if c in book.tx.columns else F.lit(None)).cast(kind).alias(c) for c, kind in _OPTIONAL],
    )


def _transaction_id(book: Book) -> Column:
    if "transaction_id" in book.tx.columns:
        return F.col("transaction_id")
    return F.concat_ws("-", F.lit("tx"), F.col(P).cast("string"), F.col("source_row_number").cast("string"))


def cash_flows(book: Book) -> DataFrame:
    rate = F.when(F.col("currency") == "TWD", 1.0).otherwise(F.col("fx_rate"))
    into = F.col("transaction_type") == "CASH_IN"
    return book.tx.where(F.col("transaction_type").isin("CASH_IN", "CASH_OUT")).select(
        P,
        _transaction_id(book).alias("transaction_id"),
        F.col("trade_date").alias("date"),
        F.when(into, "CONTRIBUTION").otherwise("WITHDRAWAL").alias("type"),
        "currency",
        F.col("amount_foreign").alias("amount_native"),
        rate.alias("fx_rate_twd"),
        (F.col("amount_foreign") * rate).alias("amount_twd"),
    )


def security_cash_flows(book: Book) -> DataFrame:
    events = flows.security_events(book.tx, security_terminal(book)).where("issue_code is null")
    rows = F.array_join(F.col("source_row_numbers").cast("array<string>"), ",")
    return events.select(
        P,
        "date",
        F.col("kind").alias("type"),
        "amount_twd",
        "signed_amount_twd",
        rows.alias("source_row_numbers"),
        F.when(F.size("source_row_numbers") > 0, "TRANSACTION").otherwise("ACTIVE_POSITION_VALUATION").alias("source"),
    )


def positions(book: Book) -> DataFrame:
    key = [P, "ticker", "currency"]
    held = book.positions.where("abs(quantity) > 1e-9")
    current = book.freshness.where("freshness = 'CURRENT'").select(P)
    valued = book.components.where("asset_type = 'POSITION'").join(current, P, "left_semi").select(*key, "price", "market_value_twd")
    cost = book.basis.select(*key, "twd_cost_basis", "realized_pnl_twd")
    gain = book.reconciled.join(current, P, "left_semi").select(*key, "unrealized_pnl_twd")
    df = (
        held.join(valued, key, "left")
        .join(cost, key, "left")
        .join(gain, key, "left")
        .join(book.snapshots.select(P, "valuation_date"), P, "left")
    )
    return df.select(
        P,
        F.col("valuation_date").alias("as_of"),
        F.col("ticker").alias("symbol"),
        "currency",
        "quantity",
        F.col("average_unit_cost").alias("average_unit_cost_native"),
        F.col("cost_basis").alias("cost_basis_native"),
        F.col("twd_cost_basis").alias("cost_basis_twd"),
        F.col("price").alias("price_native"),
        "market_value_twd",
        F.col("unrealized_pnl_twd").alias("unrealized_pl_twd"),
        F.col("realized_pnl_twd").alias("realized_pl_twd"),
    )


def valuations(book: Book) -> DataFrame:
    position = F.col("asset_type") == "POSITION"
    return book.components.select(
        P,
        F.col("valuation_date").alias("as_of"),
        "asset_type",
        F.col("ticker").alias("symbol"),
        "currency",
        F.col("quantity").alias("quantity_or_units"),
        F.when(position, F.col("price")).otherwise(F.col("fx_rate")).alias("price_or_fx_rate"),
        F.when(position, F.col("price_date")).otherwise(F.col("fx_date")).alias("source_date"),
        "market_value_native",
        "market_value_twd",
        F.col("market_value_twd").isNotNull().alias("complete"),
    )


def _market(book: Book, fx: bool) -> DataFrame:
    kind = F.col("instrument_type") == "FX"
    return book.bars.where(kind if fx else ~kind).select(
        "market_id", "date", "instrument_type", F.col("ticker").alias("symbol"), "currency", "raw_close", "adjusted_close"
    )


def strategies(book: Book) -> DataFrame:
    if book.requests is None or book.prices is None:
        raise QueryError("NO_STRATEGY_REQUESTS", "the book has no request table or no prices")
    return book.strategies


DOMAINS = ("TRANSACTIONS", "CASH", "FX_COST", "VALUATION", "PERFORMANCE", "MARKET_DATA")


def issue_rows(book: Book, domain: str | None = None) -> DataFrame:
    """Every issue of a domain, or of all of them, one row each; the ledgers of other domains are not built."""
    if domain is None:
        return reduce(DataFrame.unionByName, [issue_rows(book, d) for d in DOMAINS])
    none, code, day = F.lit(None), F.col("issue_code"), F.col("trade_date")

    def rows(df: DataFrame, code: Column, date: Column, symbol: Column) -> DataFrame:
        return df.select(
            P,
            F.lit(domain).alias("domain"),
            code.alias("code"),
            envelope.message(code).alias("message"),
            F.lit("BLOCKING").alias("severity"),
            date.cast("date").alias("date"),
            symbol.cast("string").alias("symbol"),
        )

    if domain == "TRANSACTIONS":
        return rows(gate.ledger_issues(book.security_ledger, ""), code, day, F.col("ticker"))
    if domain == "CASH":
        return rows(gate.ledger_issues(book.cash_ledger, ""), code, day, none)
    if domain == "FX_COST":
        return rows(gate.ledger_issues(book.fx_ledger, ""), code, day, F.nullif(F.col("ticker"), F.lit("")))
    if domain == "VALUATION":
        current = book.freshness.where("freshness = 'CURRENT'").select(P)
        valued = valuation.valuation_issues(book.components, book.marks, book.snapshots).join(current, P, "left_semi")
        old = book.freshness.where("freshness_issue is not null").join(book.snapshots.select(P, "valuation_date"), P, "left")
        stale_day = F.when(F.col("freshness_issue") == "VALUATION_DATE_STALE", F.col("valuation_date"))
        return rows(valued, code, none, none).unionByName(rows(old, F.col("freshness_issue"), stale_day, none))
    if domain == "MARKET_DATA":
        return rows(book.market_issues, code, F.col("date"), none)
    summary = flows.performance_summary(book.tx, terminal(book))
    # an unrated external flow is one issue per row; the summary names its code once
    codes = summary.select(P, F.explode(F.split("issue_codes", ",")).alias("issue_code")).where(
        "issue_code not in ('', 'MISSING_EXTERNAL_FLOW_FX')"
    )
    dated = terminal(book).select(P, "valuation_date")
    unrated = (
        book.tx.where(F.col("transaction_type").isin("CASH_IN", "CASH_OUT") & twd_rate().isNull())
        .join(dated, P)
        .where("valuation_date is null or trade_date <= valuation_date")
        .withColumn("issue_code", F.lit("MISSING_EXTERNAL_FLOW_FX"))
    )
    starts = book.tx.groupBy(P).agg(F.min("trade_date").alias("first"))
    uncovered = book.snapshots.select(P).join(starts, P)
    return (
        rows(codes, code, none, none)
        .unionByName(rows(unrated, code, none, none))
        .unionByName(rows(uncovered, F.lit(returns.COVERAGE_ISSUE), F.col("first"), none))
    )


def data_quality(book: Book) -> DataFrame:
    """Every issue of every domain, one row each."""
    book.issue_rows = book.issue_rows or issue_rows
    return book.every_issue


# --- metrics --------------------------------------------------------------------------------------


def nav_metric(book: Book) -> DataFrame:
    df = current_totals(book).withColumn("status", status(F.col("freshness"), _zero("blocking_issue_count")))
    day = F.col("valuation_date")
    return df.select(
        P,
        F.when(F.col("status") == "COMPLETE", F.col("total_assets_twd")).alias("value"),
        day.alias("period_from"),
        day.alias("period_to"),
        "status",
    )


def cash_ratio_metric(book: Book) -> DataFrame:
    df = current_totals(book).withColumn("status", status(F.col("freshness"), _zero("blocking_issue_count")))
    ratio = F.when(F.col("total_assets_twd") > 0, F.try_divide("known_cash_value_twd", "total_assets_twd"))
    day = F.col("valuation_date")
    return df.select(
        P, F.when(F.col("status") == "COMPLETE", ratio).alias("value"), day.alias("period_from"), day.alias("period_to"), "status"
    )


def _return_metric(column: str):
    def build(book: Book, from_: str | None = None, to: str | None = None, coverage: str = "PRICE_ONLY") -> DataFrame:
        obs = book.observations
        if from_:
            obs = obs.where(F.col("date") >= F.lit(from_).cast("date"))
        if to:
            obs = obs.where(F.col("date") <= F.lit(to).cast("date"))
        df = book.freshness.join(returns.drawdown_summary(obs, coverage), P, "left")
        state = F.when(F.col("freshness") == "STALE", "STALE").when(F.coalesce("complete", F.lit(False)), "COMPLETE").otherwise("INCOMPLETE")
        df = df.withColumn("status", state)
        return df.select(
            P,
            F.when(F.col("status") == "COMPLETE", F.col(column)).alias("value"),
            F.col("start_date").alias("period_from"),
            F.col("end_date").alias("period_to"),
            "status",
        )

    return build


def xirr_metric(book: Book) -> DataFrame:
    end = terminal(book)
    first = flows.external_events(book.tx, end).groupBy(P).agg(F.min("date").alias("period_from"))
    df = book.freshness.join(flows.performance_summary(book.tx, end), P, "left").join(first, P, "left")
    usable = F.col("complete") & (F.col("freshness") == "CURRENT")
    df = df.withColumn("status", F.when(usable, "COMPLETE").otherwise(status(F.col("freshness"), F.lit(1))))
    return df.select(
        P, F.when(F.col("status") == "COMPLETE", F.col("xirr")).alias("value"), "period_from", F.col("valuation_date").alias("period_to"), "status"
    )


def _profit_metric(column: str):
    def build(book: Book) -> DataFrame:
        reconciled = book.reconciliation.select(P, F.col("complete").alias("reconciled"), column, "cost_blocking_issue_count")
        df = book.freshness.join(reconciled, P, "left").join(book.snapshots.select(P, "valuation_date"), P, "left")
        whole = F.coalesce(F.col("reconciled"), F.lit(False)) & (F.col("freshness") == "CURRENT")
        issues = _zero("cost_blocking_issue_count") + F.when(whole, 0).otherwise(1)
        df = df.withColumn("status", status(F.col("freshness"), issues))
        return df.select(
            P,
            F.when(F.col("status") == "COMPLETE", F.col(column)).alias("value"),
            F.lit(None).cast("date").alias("period_from"),
            F.col("valuation_date").alias("period_to"),
            "status",
        )

    return build


# --- registration -----------------------------------------------------------------------------------

_ACCOUNT = Field(P, "integer", "account the row belongs to")
_TWD = {"unit": "TWD"}


def _resource_of(name: str, description: str, build, fields: list[Field], filters, sorts, order, date=None, paged=True, key=_ACCOUNT) -> None:
    columns = filters if isinstance(filters, dict) else {f: f for f in filters}
    resource = Resource(name, description, (key, *fields), build, columns, tuple(sorts), (key.name, *order), date, paged, key=key.name)
    register_resource(resource)


_resource_of(
    "account_snapshot",
    "account totals from the active transactions and valuation",
    account_snapshot,
    [
        Field("as_of", "date", "valuation date", True),
        Field("base_currency", "string", "reporting currency"),
        Field("total_assets_twd", "number", "total assets", True, **_TWD),
        Field("position_value_twd", "number", "security value", True, **_TWD),
        Field("cash_value_twd", "number", "cash value", True, **_TWD),
        Field("open_position_count", "number", "non-zero positions", unit="count"),
        Field("transaction_count", "number", "active transactions", unit="count"),
        Field("valuation_status", "enum", "usability", values=("COMPLETE", "INCOMPLETE", "STALE")),
    ],
    ["as_of"],
    ["as_of"],
    [],
)
_resource_of(
    "transactions",
    "active transactions",
    transactions,
    [
        Field("transaction_id", "string", "logical identifier"),
        Field("source_row_number", "number", "row in the source file", unit="row"),
        Field("date", "date", "economic date"),
        Field("type", "enum", "transaction type", values=("SECURITY", "FX_BUY", "FX_SELL", "CASH_IN", "CASH_OUT")),
        Field("symbol", "string", "security, blank otherwise"),
        Field("currency", "string", "native currency"),
        Field("quantity", "number", "signed quantity", unit="shares"),
        Field("price", "number", "native price"),
        Field("amount_foreign", "number", "native amount"),
        Field("fx_rate_twd", "number", "TWD per unit", True, **_TWD),
        Field("fee", "number", "native fee"),
        Field("budget_waterline", "number", "budget line of the source row", True),
        Field("budget_balance", "number", "budget left by the source row", True),
        Field("note", "string", "note of the source row", True),
    ],
    ["transaction_id", "symbol", "type", "currency"],
    ["date", "symbol", "type", "currency", "source_row_number"],
    ["date", "source_row_number"],
    "date",
)
_resource_of(
    "cash_flows",
    "external contributions and withdrawals",
    cash_flows,
    [
        Field("transaction_id", "string", "source transaction"),
        Field("date", "date", "economic date"),
        Field("type", "enum", "direction", values=("CONTRIBUTION", "WITHDRAWAL")),
        Field("currency", "string", "native currency"),
        Field("amount_native", "number", "native amount"),
        Field("fx_rate_twd", "number", "TWD per unit", True, **_TWD),
        Field("amount_twd", "number", "amount in TWD", True, **_TWD),
    ],
    ["transaction_id", "type", "currency"],
    ["date", "type", "currency"],
    ["date", "transaction_id"],
    "date",
)
_resource_of(
    "security_cash_flows",
    "estimated TWD cash flows of securities with the terminal position value",
    security_cash_flows,
    [
        Field("date", "date", "trade or valuation date"),
        Field("type", "enum", "flow", values=("PURCHASE", "SALE", "TERMINAL_POSITION_VALUE")),
        Field("amount_twd", "number", "absolute amount", **_TWD),
        Field("signed_amount_twd", "number", "signed amount", **_TWD),
        Field("source_row_numbers", "string", "source rows, comma-separated"),
        Field("source", "enum", "origin", values=("TRANSACTION", "ACTIVE_POSITION_VALUATION")),
    ],
    ["type"],
    ["date", "type"],
    ["date", "type", "source_row_numbers"],
    "date",
)
_resource_of(
    "positions",
    "open positions with cost and available valuation",
    positions,
    [
        Field("as_of", "date", "valuation date", True),
        Field("symbol", "string", "security"),
        Field("currency", "string", "native currency"),
        Field("quantity", "number", "held quantity", unit="shares"),
        Field("average_unit_cost_native", "number", "moving-average unit cost"),
        Field("cost_basis_native", "number", "native cost"),
        Field("cost_basis_twd", "number", "TWD cost", True, **_TWD),
        Field("price_native", "number", "as-of price", True),
        Field("market_value_twd", "number", "market value", True, **_TWD),
        Field("unrealized_pl_twd", "number", "unrealised profit", True, **_TWD),
        Field("realized_pl_twd", "number", "realised profit", True, **_TWD),
    ],
    ["as_of", "symbol", "currency"],
    ["symbol", "currency", "quantity", "market_value_twd", "cost_basis_twd"],
    ["currency", "symbol"],
)
_resource_of(
    "valuations",
    "valued positions and cash",
    valuations,
    [
        Field("as_of", "date", "valuation date"),
        Field("asset_type", "enum", "asset type", values=("POSITION", "CASH")),
        Field("symbol", "string", "security, blank for cash"),
        Field("currency", "string", "native currency"),
        Field("quantity_or_units", "number", "quantity or balance"),
        Field("price_or_fx_rate", "number", "price or rate", True),
        Field("source_date", "date", "observation date", True),
        Field("market_value_native", "number", "native value", True),
        Field("market_value_twd", "number", "TWD value", True, **_TWD),
        Field("complete", "boolean", "fully valued"),
    ],
    ["as_of", "asset_type", "symbol", "currency"],
    ["as_of", "asset_type", "symbol", "currency", "market_value_twd"],
    ["asset_type", "currency", "symbol"],
)
_MARKET_KEY = Field("market_id", "integer", "market the row belongs to; a filter by account reads its market")
_MARKET = [
    Field("date", "date", "exchange-local date"),
    Field("instrument_type", "enum", "instrument", values=("SECURITY", "BENCHMARK", "FX")),
    Field("symbol", "string", "security or benchmark, blank for FX"),
    Field("currency", "string", "quote currency"),
    Field("raw_close", "number", "unadjusted close"),
    Field("adjusted_close", "number", "adjusted close", True),
]
for _name, _fx, _text in (("market_prices", False, "security and benchmark closes"), ("fx_rates", True, "TWD rates")):
    _resource_of(
        _name,
        _text,
        lambda book, fx=_fx: _market(book, fx),
        _MARKET,
        ["symbol", "currency", "instrument_type"],
        ["date", "symbol", "currency", "instrument_type"],
        ["date", "instrument_type", "currency", "symbol"],
        "date",
        key=_MARKET_KEY,
    )
_resource_of(
    "strategy_comparison",
    "three backtest rows per request; complete, never paged",
    strategies,
    [
        Field("request_id", "string", "request"),
        Field("mode", "enum", "plan", values=("DCA", "LUMP_SUM", "TRANSACTION_REPLAY")),
        Field("status", "enum", "quality", values=("ESTIMATED", "INCOMPLETE")),
        Field("start_date", "date", "first execution", True),
        Field("end_date", "date", "last common day", True),
        Field("gross_contributions_twd", "number", "paid in", **_TWD),
        Field("gross_withdrawals_twd", "number", "taken out", **_TWD),
        Field("terminal_value_twd", "number", "end value", True, **_TWD),
        Field("estimated_gain_twd", "number", "gain", True, **_TWD),
        Field("money_multiple", "number", "multiple", True),
        Field("xirr", "number", "dated-flow rate", True, "decimal"),
        Field("cumulative_twr", "number", "unitised growth", True, "decimal"),
        Field("annualized_twr", "number", "annualised growth", True, "decimal"),
        Field("maximum_drawdown", "number", "deepest fall", True, "decimal"),
        Field("recovery_date", "date", "recovery", True),
        Field("execution_count", "number", "executed flows", unit="count"),
        Field("issue_codes", "string", "limitations, comma-separated"),
    ],
    ["mode", "request_id"],
    ["mode", "request_id"],
    ["request_id", "mode"],
    paged=False,
)
_resource_of(
    "data_quality",
    "blocking and freshness issues of every domain",
    data_quality,
    [
        Field("domain", "enum", "domain", values=("TRANSACTIONS", "CASH", "FX_COST", "VALUATION", "PERFORMANCE", "MARKET_DATA")),
        Field("code", "string", "issue code"),
        Field("message", "string", "what the code says"),
        Field("severity", "enum", "severity", values=("BLOCKING",)),
        Field("date", "date", "date", True),
        Field("symbol", "string", "security", True),
    ],
    ["domain", "code", "symbol"],
    ["domain", "code", "date", "symbol"],
    ["domain", "code", "date", "symbol"],
    "date",
)

register_metric(Metric("nav", "current total assets", "TWD", VALUATION_VERSION, nav_metric))
register_metric(Metric("twr", "cumulative time-weighted return", "decimal", RETURNS_VERSION, _return_metric("cumulative_twr"), ("from_", "to", "coverage")))
register_metric(Metric("max_drawdown", "maximum drawdown", "decimal", RETURNS_VERSION, _return_metric("maximum_drawdown"), ("from_", "to", "coverage")))
register_metric(Metric("xirr", "money-weighted annual return", "decimal", PERFORMANCE_VERSION, xirr_metric))
register_metric(Metric("realized_pl", "realised security and FX profit", "TWD", FX_COST_VERSION, _profit_metric("total_realized_pnl_twd")))
register_metric(Metric("unrealized_pl", "unrealised profit", "TWD", FX_COST_VERSION, _profit_metric("total_unrealized_pnl_twd")))
register_metric(Metric("cash_ratio", "cash over total assets", "decimal", VALUATION_VERSION, cash_ratio_metric))
