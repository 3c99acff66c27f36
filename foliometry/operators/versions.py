"""Dataset versions: diffs by row hash, binding of snapshots, active version and first identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliometry.functions.hashing import packed, unpacked

P = "account_id"
SAMPLES = 20


def sides(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both versions in one table, with the columns of ``new`` and ``incoming``."""
    return new.withColumn("incoming", F.lit(True)).unionByName(old.select(*new.columns).withColumn("incoming", F.lit(False)))


def changed_rows(rows: DataFrame) -> DataFrame:
    """Rows of either side (``incoming`` or not) whose hash the other side lacks, one per hash, as ADDED or REMOVED."""
    rest = [c for c in rows.columns if c not in (P, "row_hash", "incoming")]
    tagged = rows.withColumns({"side": F.when(F.col("incoming"), "ADDED").otherwise("REMOVED"), "hash_key": packed(F.col("row_hash"))})
    per = tagged.groupBy(P, "hash_key").agg(
        F.min("side").alias("side"),
        F.max("side").alias("other"),
        F.max_by(F.struct(*rest), "source_row_number").alias("row"),
    )
    return per.where("side = other").select(P, unpacked(F.col("hash_key")).alias("row_hash"), F.col("side").alias("change"), *[f"row.{c}" for c in rest])


def diff_samples(old: DataFrame, new: DataFrame, n: int = SAMPLES) -> DataFrame:
    """The first ``n`` added and removed rows per account, with the columns of ``new``; the limit is applied per task first."""
    return samples_of(sides(old, new), n)


def samples_of(rows: DataFrame, n: int = SAMPLES) -> DataFrame:
    """As diff_samples, of both versions in one table; where its rows lie by account already, nothing is moved."""
    order = Window.partitionBy(P, "change").orderBy("source_row_number", "row_hash")
    return changed_rows(rows).withColumn("n", F.row_number().over(order)).where(F.col("n") <= n)


def dataset_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row per account; hashes count once, and ``unchanged`` also needs equal row counts."""
    columns = [P, "row_hash", "trade_date"]
    return diff_of(sides(old.select(columns), new.select(columns)))


def diff_of(rows: DataFrame) -> DataFrame:
    """As dataset_diff, of both versions in one table; where its rows lie by account already, nothing is moved."""
    arrived, was = F.col("incoming"), ~F.col("incoming")
    day = F.when(arrived & F.col(P).isNotNull(), F.col("trade_date"))
    counts = rows.withColumn("hash_key", packed(F.col("row_hash"))).groupBy(P, "hash_key").agg(
        F.count_if(arrived).alias("incoming"), F.count_if(was).alias("previous"), F.min(day).alias("earliest"), F.max(day).alias("latest")
    )
    arrived, was = F.col("incoming") > 0, F.col("previous") > 0
    per = counts.groupBy(P).agg(
        F.sum("previous").alias("old_row_count"),
        F.sum("incoming").alias("new_row_count"),
        F.count_if(arrived & ~was).alias("added"),
        F.count_if(was & ~arrived).alias("removed"),
        F.count_if(arrived & was).alias("unchanged_rows"),
        F.min("earliest").alias("earliest_date"),
        F.max("latest").alias("latest_date"),
    )
    same = (F.col("added") == 0) & (F.col("removed") == 0) & (F.col("old_row_count") == F.col("new_row_count"))
    return per.withColumn("unchanged", same)


def mark_diff(old: DataFrame, new: DataFrame, key: str = "snapshot_id") -> DataFrame:
    """As dataset_diff but every mark counts, also repeated ones."""
    sides = new.select(key, "row_hash", F.lit(1).alias("incoming"), F.lit(0).alias("previous")).unionByName(
        old.select(key, "row_hash", F.lit(0).alias("incoming"), F.lit(1).alias("previous"))
    )
    counts = sides.groupBy(key, "row_hash").agg(F.sum("incoming").alias("incoming"), F.sum("previous").alias("previous"))
    per = counts.groupBy(key).agg(
        F.sum("previous").alias("old_mark_count"),
        F.sum("incoming").alias("new_mark_count"),
        F.sum(F.when(F.col("previous") == 0, F.col("incoming")).otherwise(0)).alias("added"),
        F.sum(F.when(F.col("incoming") == 0, F.col("previous")).otherwise(0)).alias("removed"),
    )
    return per.withColumn("unchanged_marks", F.col("new_mark_count") - F.col("added")).withColumn(
        "unchanged", (F.col("added") == 0) & (F.col("removed") == 0)
    )


def active_versions(manifest: DataFrame) -> DataFrame:
    """Account state: the highest revision whose manifest row is published."""
    return (
        manifest.where("status = 'ACTIVE'")
        .groupBy(P)
        .agg(F.max("revision").alias("revision"), F.max_by("dataset_id", "revision").alias("dataset_id"))
    )


def account_state(accounts: DataFrame, manifest: DataFrame) -> DataFrame:
    """Every account with its active dataset's metadata, if it has one."""
    active = active_versions(manifest).withColumnRenamed("revision", "stored_revision")
    details = manifest.select("dataset_id", "row_count", "earliest_date", "latest_date")
    return (
        accounts.select(P)
        .distinct()
        .join(active, P, "left")
        .join(details, "dataset_id", "left")
        .select(P, "dataset_id", F.coalesce("stored_revision", F.lit(0)).alias("stored_revision"), "row_count", "earliest_date", "latest_date")
    )


def binding_freshness(state: DataFrame, snapshots: DataFrame, stale_by_date) -> DataFrame:
    """CURRENT, STALE or NO_SNAPSHOT per account; a version mismatch outranks the date's age.

    ``snapshots`` has (account_id, snapshot_id, bound_dataset_id, bound_revision, valuation_date).
    """
    matches = (F.col("bound_dataset_id") == F.col("dataset_id")) & (F.col("bound_revision") == F.col("stored_revision"))
    reason = F.when(F.col("snapshot_id").isNull(), F.lit(None).cast("string")).when(
        ~F.coalesce(matches, F.lit(False)), "TRANSACTION_VERSION_STALE"
    ).when(stale_by_date, "VALUATION_DATE_STALE")
    df = state.join(snapshots, P, "left").withColumn("freshness_issue", reason)
    return df.select(
        P,
        "snapshot_id",
        "valuation_date",
        F.when(F.col("snapshot_id").isNull(), "NO_SNAPSHOT")
        .when(F.col("freshness_issue").isNotNull(), "STALE")
        .otherwise("CURRENT")
        .alias("freshness"),
        "freshness_issue",
    )


def market_freshness(state: DataFrame, runs: DataFrame, stale_by_date) -> DataFrame:
    """CURRENT, STALE or NO_RUN per account with the reason and, for an old market day, that day.

    ``runs`` has (account_id, market_revision, run_dataset_id, run_transaction_revision, latest_bar_date).
    """
    matches = (F.col("run_dataset_id") == F.col("dataset_id")) & (F.col("run_transaction_revision") == F.col("stored_revision"))
    reason = (
        F.when(F.col("market_revision").isNull(), "NO_RUN")
        .when(~F.coalesce(matches, F.lit(False)), "TRANSACTION_VERSION_STALE")
        .when(stale_by_date, "MARKET_DATA_DATE_STALE")
    )
    df = state.join(runs, P, "left").withColumn("issue_code", reason)
    return df.select(
        P,
        F.when(F.col("issue_code") == "NO_RUN", "NO_RUN").when(F.col("issue_code").isNotNull(), "STALE").otherwise("CURRENT").alias("market_freshness"),
        "issue_code",
        F.when(F.col("issue_code") == "MARKET_DATA_DATE_STALE", F.col("latest_bar_date")).alias("date"),
    )


def first_identity(rows: DataFrame) -> DataFrame:
    """Every stored row with the id of the earliest revision that holds the same row hash; a row hash is one window."""
    known = rows.where(F.col(P).isNotNull() & F.col("row_hash").isNotNull()).withColumn("hash_key", packed(F.col("row_hash")))
    same = Window.partitionBy(P, "hash_key").orderBy("revision", "transaction_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return known.withColumn("first_id", F.first("transaction_id").over(same)).drop("hash_key")


def dangling_bindings(snapshots: DataFrame, manifest: DataFrame) -> DataFrame:
    """Snapshots bound to a (account, dataset, revision) that does not exist."""
    known = manifest.select(P, F.col("dataset_id").alias("bound_dataset_id"), F.col("revision").alias("bound_revision"))
    return snapshots.join(known, [P, "bound_dataset_id", "bound_revision"], "left_anti")


def latest_per(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row per key as an aggregate."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, *[f"r.{c}" for c in rest])
