"""Time-weighted return and drawdown from NAV observations.

Observations are one per account and calendar day, so every window here is bounded by days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliometry.schema import EPSILON, clean

P = "account_id"
COVERAGE_ISSUE = "UNSUPPORTED_TOTAL_RETURN_COVERAGE"

CURVE = ("period_return", "growth_index", "cumulative_twr", "running_peak_index", "drawdown")


def observations(nav: DataFrame) -> DataFrame:
    return nav.select(P, F.col("as_of").alias("date"), "complete", "total_assets_twd", "contribution_twd", "withdrawal_twd")


def last_per_date(raw: DataFrame, order: str) -> DataFrame:
    """The last observation of a date wins."""
    rest = [c for c in raw.columns if c not in (P, "date", order)]
    newest = raw.groupBy(P, "date").agg(F.max_by(F.struct(*rest), order).alias("o"))
    return newest.select(P, "date", *[f"o.{c}" for c in rest])


def _chain(obs: DataFrame) -> DataFrame:
    in_order = Window.partitionBy(P).orderBy("date")
    whole = Window.partitionBy(P)
    upto = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    missing = ~F.col("complete") | F.col("total_assets_twd").isNull()
    df = (
        obs.withColumn("n", F.count("*").over(whole))
        .withColumn("incomplete", F.count_if(missing).over(whole))
        .withColumn("previous_date", F.lag("date").over(in_order))
        .withColumn("previous_assets", F.lag("total_assets_twd").over(in_order))
        .withColumn("usable", (F.col("n") >= 2) & (F.col("incomplete") == 0))
    )
    later = F.col("usable") & F.col("previous_date").isNotNull()
    denominator = F.col("previous_assets") + F.col("contribution_twd")
    numerator = F.col("total_assets_twd") + F.col("withdrawal_twd")
    df = (
        df.withColumn("bad_denominator", later & (F.isnan(denominator) | (denominator <= EPSILON)))
        .withColumn("ratio", F.when(later & ~F.col("bad_denominator"), F.try_divide(numerator, denominator) - 1))
        .withColumn("bad_factor", F.coalesce(1 + F.col("ratio") < -EPSILON, F.lit(False)))
        .withColumn("blocked", F.count_if(F.col("bad_denominator") | F.col("bad_factor")).over(whole))
        .withColumn(
            "factor",
            F.when(F.col("usable") & F.col("previous_date").isNull(), F.lit(1.0)).when(
                F.col("ratio").isNotNull() & ~F.col("bad_factor"), F.greatest(F.lit(0.0), 1 + F.col("ratio"))
            ),
        )
        .withColumn("product", F.product("factor").over(upto))
        .withColumn(
            "growth_index",
            F.when(
                F.col("factor").isNotNull(),
                F.when(F.min("product").over(upto) < EPSILON, F.lit(0.0)).otherwise(F.col("product")),
            ),
        )
        .withColumn("period_return", F.when(~F.col("bad_factor"), clean("ratio")))
        .withColumn("cumulative_twr", clean(F.col("growth_index") - 1))
        .withColumn("summarised", F.col("usable") & (F.col("blocked") == 0))
        .withColumn("running_peak_index", F.when(F.col("summarised"), F.max("growth_index").over(upto)))
    )
    peak = F.col("running_peak_index")
    return df.withColumn(
        "drawdown", F.when(F.col("summarised"), clean(F.when(peak > EPSILON, F.col("growth_index") / peak - 1).otherwise(0.0)))
    )


def twr_points(obs: DataFrame, coverage: str = "COMPLETE") -> DataFrame:
    """Per-date chain; PRICE_ONLY coverage withholds every return but keeps the observations."""
    df = _chain(obs)
    if coverage == "PRICE_ONLY":
        for name in CURVE:
            df = df.withColumn(name, F.lit(None).cast("double"))
    return df.select(P, "date", "complete", "total_assets_twd", "contribution_twd", "withdrawal_twd", *CURVE)


def twr_issues(obs: DataFrame, coverage: str = "COMPLETE") -> DataFrame:
    """One row per issue code and account, with the number of dates it concerns."""
    per = _chain(obs).groupBy(P).agg(
        F.count("*").alias("n"),
        F.max("incomplete").alias("incomplete"),
        F.datediff(F.max("date"), F.min("date")).alias("day_count"),
        F.count_if("bad_denominator").alias("denominators"),
        F.count_if("bad_factor").alias("factors"),
    )
    found = [
        ("INSUFFICIENT_OBSERVATIONS", F.when(F.col("n") < 2, F.col("n"))),
        ("INCOMPLETE_NAV_POINT", F.when(F.col("incomplete") > 0, F.col("incomplete"))),
        ("ZERO_TIME_SPAN", F.when((F.col("n") >= 2) & (F.col("day_count") <= 0), F.lit(1))),
        ("NON_POSITIVE_TWR_DENOMINATOR", F.when(F.col("denominators") > 0, F.col("denominators"))),
        ("INVALID_GROWTH_FACTOR", F.when(F.col("factors") > 0, F.col("factors"))),
    ]
    if coverage == "PRICE_ONLY":
        found.append((COVERAGE_ISSUE, F.col("n")))
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("issue_code"), n.cast("bigint").alias("dates")) for c, n in found]))
    return per.select(P, rows.alias("i")).select(P, "i.issue_code", "i.dates").where("dates is not null")


def drawdown_summary(obs: DataFrame, coverage: str = "COMPLETE") -> DataFrame:
    """One row per account: cumulative and annualised return, maximum and current drawdown."""
    df = _chain(obs)
    in_order = Window.partitionBy(P).orderBy("date")
    whole = Window.partitionBy(P)
    index, peak, dd = F.col("growth_index"), F.col("running_peak_index"), F.col("drawdown")
    deepest = F.min("drawdown").over(whole)
    falls = deepest < -EPSILON
    # a later date replaces the trough only when lower by more than EPSILON
    trough = F.min(F.when(dd <= F.col("deepest") + EPSILON, F.struct("date", "drawdown", "running_peak_index"))).over(whole)
    df = (
        df.withColumn("deepest", deepest)
        .withColumn("trough", F.when(falls, trough))
        .withColumn("first_date", F.first("date").over(in_order))
    )
    at = F.col("trough.running_peak_index")
    reached = index >= at - EPSILON
    per = df.groupBy(P).agg(
        F.bool_and("summarised").alias("ok"),
        F.min("date").alias("start_date"),
        F.max("date").alias("end_date"),
        F.max_by("growth_index", "date").alias("last_index"),
        F.max_by("drawdown", "date").alias("current_drawdown"),
        F.first("trough").alias("trough"),
        F.min(F.when(reached & (F.col("date") <= F.col("trough.date")), F.col("date"))).alias("peak_before"),
        F.min(F.when(reached & (F.col("date") > F.col("trough.date")), F.col("date"))).alias("recovered"),
        F.max(F.when(index + EPSILON >= peak, F.col("date"))).alias("last_peak"),
    )
    ok = F.col("ok") & (F.datediff("end_date", "start_date") > 0)
    if coverage == "PRICE_ONLY":
        ok = F.lit(False)
    flat = F.col("trough").isNull()
    days = F.datediff("end_date", "start_date")
    total = clean(F.col("last_index") - 1)
    annual = F.when(1 + total <= EPSILON, F.lit(-1.0)).otherwise(clean(F.pow(1 + total, F.lit(365.0) / days) - 1))
    peak_date = F.when(flat, F.col("start_date")).otherwise(F.col("peak_before"))
    trough_date = F.when(flat, F.col("start_date")).otherwise(F.col("trough.date"))
    recovery = F.when(flat, F.col("start_date")).otherwise(F.col("recovered"))
    below = F.col("current_drawdown") < -EPSILON
    out = {
        "cumulative_twr": total,
        "annualized_twr": annual,
        "maximum_drawdown": F.coalesce(F.col("trough.drawdown"), F.lit(0.0)),
        "peak_date": peak_date,
        "trough_date": trough_date,
        "decline_days": F.datediff(trough_date, peak_date),
        "recovery_date": recovery,
        "recovery_days": F.datediff(recovery, trough_date),
        "underwater_days": F.datediff(F.coalesce(recovery, F.col("end_date")), peak_date),
        "current_drawdown": F.col("current_drawdown"),
        "currently_in_drawdown": below,
        "current_peak_date": F.col("last_peak"),
        "current_underwater_days": F.when(below, F.datediff("end_date", "last_peak")).otherwise(0),
    }
    return per.select(
        P, ok.alias("complete"), "start_date", "end_date", days.alias("day_count"), *[F.when(ok, c).alias(n) for n, c in out.items()]
    )


def drawdown_labels(summary: DataFrame) -> DataFrame:
    """The three texts a drawdown card shows."""
    unknown = ~F.col("complete") | F.col("currently_in_drawdown").isNull()
    return summary.select(
        P,
        F.when(unknown, "drawdown cannot be computed completely yet")
        .when(
            F.col("currently_in_drawdown"),
            F.format_string("still in drawdown for %d days", F.coalesce("current_underwater_days", F.lit(0))),
        )
        .otherwise("back at the previous peak")
        .alias("current_drawdown_hint"),
        F.when(unknown, "-")
        .otherwise(F.coalesce(F.date_format("recovery_date", "yyyy-MM-dd"), F.lit("not recovered")))
        .alias("recovery_date_value"),
        F.when(~unknown & F.col("underwater_days").isNotNull(), "from peak to recovery, or to the last point")
        .alias("underwater_hint"),
    )
