"""Which stored transaction an incoming row continues: identity kept only where evidence is unique.

Every group key of the matching holds the identity (type, ticker, currency): equal contents and equal
row hashes imply it.  Both sides are therefore put side by side and shuffled once, by account and
identity; all counts are windows inside that partitioning, and the n-th of several equal rows is
matched with the n-th of the other side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliometry.functions.hashing import content_hash, packed

P = "account_id"
IDENTITY = ("transaction_type", "ticker_key", "currency_key")
GROUP = (P, *IDENTITY)


def _side(rows: DataFrame, incoming: Column, payload: Column, transaction_id: Column) -> DataFrame:
    """Group keys, row hash, row number and, for incoming rows, all their columns as one."""
    return rows.select(
        P,
        "source_row_number",
        "trade_date",
        "transaction_type",
        F.upper("ticker").alias("ticker_key"),
        F.upper("currency").alias("currency_key"),
        packed(F.col("row_hash")).alias("row_hash"),
        packed(F.col("content_hash") if "content_hash" in rows.columns else content_hash(rows)).alias("content"),
        incoming.alias("incoming"),
        transaction_id.alias("stored_id"),
        payload.alias("payload"),
    )


def _counted(df: DataFrame, key: list[str], **conditions: Column) -> DataFrame:
    """Add how many rows of each row's group meet each condition."""
    group = Window.partitionBy(*key)
    return df.withColumns({name: F.count_if(condition).over(group) for name, condition in conditions.items()})


def lineage_plan(previous: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows with ``kind`` UNCHANGED, CORRECTED or NEW, the id they keep and ``ambiguous``.

    ``previous`` carries ``transaction_id`` and ``row_hash``; ``incoming`` carries ``row_hash``.  Row
    numbers are unique per account on each side.
    """
    whole = F.struct(*incoming.columns)
    none = F.lit(None).cast(incoming.select(whole.alias("w")).schema["w"].dataType)
    stored = _side(previous, F.lit(False), none, F.col("transaction_id"))
    both = stored.unionByName(_side(incoming, F.lit(True), whole, F.lit(None).cast("string")))
    return _matched(both.repartition(*GROUP), incoming.columns)


def plan_of(rows: DataFrame) -> DataFrame:
    """As lineage_plan, of both versions in one table, told apart by ``incoming``, whose rows lie by account already; nothing is moved.

    Rows may bring the ``content_hash`` that their row hash was made from.
    """
    columns = [c for c in rows.columns if c not in ("incoming", "transaction_id", "content_hash")]
    new = F.col("incoming")
    return _matched(_side(rows, new, F.when(new, F.struct(*columns)), F.when(~new, F.col("transaction_id"))), columns)


def _matched(df: DataFrame, columns: list[str]) -> DataFrame:
    new, old = F.col("incoming"), ~F.col("incoming")

    # repeated identical fills whose number changed: their occurrence hashes are no evidence
    df = _counted(df, [*GROUP, "content"], n_old=old, n_new=new)
    df = df.withColumn("shifted", new & (F.col("n_old") > 0) & (F.col("n_old") != F.col("n_new")))
    # the n-th row of a hash continues the n-th stored one
    df = df.withColumn("copy", F.row_number().over(Window.partitionBy(*GROUP, "row_hash", "incoming").orderBy("source_row_number")))
    df = df.withColumn("copy", F.when(~F.col("shifted"), F.col("copy")))
    same = Window.partitionBy(*GROUP, "row_hash", "copy")
    df = df.withColumns({"twin": F.max("stored_id").over(same), "twins": F.count("*").over(same)})
    exact = F.col("copy").isNotNull() & (F.col("twins") == 2)
    df = df.withColumn("exact", exact).drop("row_hash", "content", "copy", "twins", "n_old", "n_new")

    # from here on only rows without an exact match count; a missing key matches nothing
    known = F.col("ticker_key").isNotNull() & F.col("currency_key").isNotNull() & F.col("transaction_type").isNotNull()
    left = ~F.col("exact") & known
    semantic = [*GROUP, "trade_date"]

    # identity groups that are neither one-to-one nor equal as multisets of dated trades
    df = _counted(df, semantic, day_old=left & old, day_new=left & new)
    df = _counted(df, [*GROUP], n_old=left & old, n_new=left & new, n_unequal=left & (F.col("day_old") != F.col("day_new")))
    one_to_one = (F.col("n_old") == 1) & (F.col("n_new") == 1)
    unequal = left & (F.col("n_old") > 0) & (F.col("n_new") > 0) & (F.col("n_unequal") > 0) & ~one_to_one
    df = df.withColumn("ambiguous", new & ~F.col("exact") & (F.col("shifted") | unequal))

    # one-to-one by date and identity
    dated = left & F.col("trade_date").isNotNull()
    df = _counted(df, semantic, n_old=dated & old, n_new=dated & new & ~F.col("ambiguous"))
    day = Window.partitionBy(*semantic)
    both = dated & (F.col("n_old") > 0) & (F.col("n_new") > 0)
    single = both & (F.col("n_old") == 1) & (F.col("n_new") == 1)
    clear = new & ~F.col("ambiguous")
    df = df.withColumns(
        {
            "matched_id": F.when(single & clear, F.max(F.when(dated & old, F.col("stored_id"))).over(day)),
            "used": single & old,
            "ambiguous": F.col("ambiguous") | (both & ~single & clear),
        }
    )

    # what is left must be one-to-one per identity before the row number may speak
    open_ = new & left & F.col("matched_id").isNull()
    unused = old & left & ~F.col("used")
    df = _counted(df, [*GROUP], n_old=unused, n_new=open_)
    several = (F.col("n_old") > 0) & (F.col("n_new") > 0) & ~one_to_one
    df = df.withColumn("ambiguous", F.col("ambiguous") | (open_ & several))
    correction = [*GROUP, "source_row_number"]
    numbered = F.col("source_row_number").isNotNull()
    df = _counted(df, correction, n_old=unused & numbered, n_new=open_ & ~F.col("ambiguous") & numbered)
    row = Window.partitionBy(*correction)
    partner = F.max(F.when(unused, F.col("stored_id"))).over(row)
    df = df.withColumn("row_id", F.when(open_ & ~F.col("ambiguous") & numbered & one_to_one, partner))

    found = F.coalesce(F.when(F.col("exact"), F.col("twin")), "matched_id", "row_id")
    kind = F.when(F.col("exact"), "UNCHANGED").when(found.isNull(), "NEW").otherwise("CORRECTED")
    # the account is the column that the rows lie by, so what groups the plan by account moves nothing
    whole = [F.col(P) if c == P else F.col(f"payload.{c}").alias(c) for c in columns]
    out = df.where("incoming").select(
        *whole, found.alias("matched"), kind.alias("kind"), (F.col("ambiguous") & found.isNull()).alias("ambiguous_row")
    )
    return out.select(*columns, F.col("matched").alias("transaction_id"), "kind", F.col("ambiguous_row").alias("ambiguous"))


def plan_summary(plan: DataFrame, previous: DataFrame) -> DataFrame:
    kinds = plan.groupBy(P).agg(
        F.count_if(F.col("kind") == "UNCHANGED").alias("unchanged"),
        F.count_if(F.col("kind") == "CORRECTED").alias("corrected"),
        F.count_if(F.col("kind") == "NEW").alias("added"),
        F.count_if("ambiguous").alias("ambiguous"),
    )
    stored = previous.groupBy(P).agg(F.count("*").alias("stored"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return kinds.join(stored, P, "full_outer").select(
        P,
        zero("unchanged").alias("unchanged"),
        zero("corrected").alias("corrected"),
        zero("added").alias("added"),
        (zero("stored") - zero("unchanged") - zero("corrected")).alias("removed"),
        zero("ambiguous").alias("ambiguous"),
    )


def with_ids(plan: DataFrame, revision: int) -> DataFrame:
    """Kept ids, and for new rows an id derived from account, row hash and revision."""
    fresh = F.sha2(F.concat_ws("|", F.col(P).cast("string"), "row_hash", F.lit(str(revision))), 256)
    return plan.withColumn("transaction_id", F.coalesce("transaction_id", fresh))
