"""Subscription table: upsert, staleness, cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import money_sum

COLUMNS = ["id", "merchant", "amount", "frequency", "first_seen", "last_seen", "status", "created_at"]


def upsert_subscriptions(stored: DataFrame, batch: DataFrame, order: str = "seq") -> DataFrame:
    """New state: a batch row whose merchant and amount are active moves ``last_seen``; others are inserted.

    Several batch rows of one key are folded first (first row gives the id, last
    row gives ``last_seen``), so neither side of the join has a hot key. Stored
    rows that are not active stay as they are. Of several active stored rows with
    one key the one with the smallest id is moved.
    """
    fresh = batch.groupBy("merchant", "amount").agg(
        F.min_by(F.struct("id", "frequency", "first_seen", "status", "created_at"), order).alias("first"),
        F.max_by("last_seen", order).alias("seen"),
    )
    active = F.col("status") == "active"
    targets = (
        stored.where(active).groupBy("merchant", "amount").agg(F.min("id").alias("id"))
        .join(fresh.select("merchant", "amount", "seen"), ["merchant", "amount"])
        .select("id", "seen")
    )
    moved = (
        stored.join(targets, "id", "left")
        .withColumn("last_seen", F.coalesce("seen", "last_seen"))
        .select(COLUMNS)
    )
    known = stored.where(active).select("merchant", "amount").distinct()
    added = fresh.join(known, ["merchant", "amount"], "left_anti").select(
        F.col("first.id").alias("id"), "merchant", "amount", F.col("first.frequency").alias("frequency"),
        F.col("first.first_seen").alias("first_seen"), F.col("seen").alias("last_seen"),
        F.col("first.status").alias("status"), F.col("first.created_at").alias("created_at"),
    )
    return moved.unionByName(added)


def active_subscriptions(subscriptions: DataFrame) -> DataFrame:
    return subscriptions.where(F.col("status") == "active").orderBy("merchant", "id")


def _stale(as_of: str, stale_days: int):
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(stale_days))
    return (F.col("status") == "active") & (F.col("last_seen") < cutoff)


def stale_subscriptions(subscriptions: DataFrame, as_of: str, stale_days: int = 60) -> DataFrame:
    return subscriptions.where(_stale(as_of, stale_days))


def mark_stale(subscriptions: DataFrame, as_of: str, stale_days: int = 60) -> DataFrame:
    """New state of the table with the stale rows flipped."""
    status = F.when(_stale(as_of, stale_days), F.lit("stale")).otherwise(F.col("status"))
    return subscriptions.withColumn("status", status)


def subscription_cost(subscriptions: DataFrame) -> DataFrame:
    """Active monthly sum and twelve times that."""
    monthly = F.coalesce(money_sum(F.when(F.col("frequency") == "monthly", F.col("amount"))), F.lit(0.0))
    return subscriptions.where(F.col("status") == "active").agg(
        F.count("*").alias("n_active"),
        F.round(monthly, 2).alias("monthly_cost"),
        F.round(monthly * 12, 2).alias("annual_cost"),
    )
