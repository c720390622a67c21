"""Anomaly rules over the ledger (columns seq, id, date, merchant, amount, category)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import money, money_sum
from .shaping import sums_before

COLUMNS = ["id", "type", "severity", "description", "transaction_ids", "recommended_action", "resolved", "created_at"]


def anomaly_rows(
    df: DataFrame, *, kind: str, severity: str, description: Column, ids: Column, action: str, as_of: str
) -> DataFrame:
    """Rows in the shape of the anomalies table; the id is a hash of type and transactions."""
    return df.select(
        F.sha2(F.concat_ws("|", F.lit(kind), F.array_join(ids, ",")), 256).alias("id"),
        F.lit(kind).alias("type"),
        F.lit(severity).alias("severity"),
        description.alias("description"),
        ids.alias("transaction_ids"),
        F.lit(action).alias("recommended_action"),
        F.lit(False).alias("resolved"),
        F.lit(as_of).cast("timestamp_ntz").alias("created_at"),
    )


TIED_ROWS = 1 << 16  # numbers of rows of one date that are summed together


PART_BITS = 20


def date_blocks(unit: str, date: Column, seq: Column) -> Column:
    """Numbers of blocks that never decrease along (date, seq): a unit of time, and parts of it where dates stand at its start.

    Dates without a time of day all stand at the start of their unit; they are cut
    by ``seq``, so that one merchant's day is many blocks. Later dates of the unit
    follow as one. Unknown dates come first and are cut like a unit's start.
    """
    start = F.date_trunc(unit, date).cast("timestamp_ntz")
    number = F.coalesce(F.timestamp_diff(unit, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), start), F.lit(-1 << 40))
    part = F.when(date.eqNullSafe(start), F.least(F.floor(seq / TIED_ROWS), F.lit((1 << PART_BITS) - 1))).otherwise(1 << PART_BITS)
    return number * (2 << PART_BITS) + part


def spikes(txn: DataFrame, factor: float = 3.0, block: str = "MINUTE") -> DataFrame:
    """Transactions above ``factor`` times the merchant's average so far.

    ``block`` is the time unit that cuts a merchant's rows for the running sums.
    """
    blocks = txn.withColumn("_block_start", date_blocks(block, F.col("date"), F.col("seq")))
    history = sums_before(blocks, ["merchant"], "_block_start", ["date", "seq"], "amount")
    average = F.col("sum_before") / F.col("rows_before")
    return (
        history.where(F.col("rows_before") > 0)
        .withColumn("average", average)
        .where(F.col("amount") > F.lit(factor) * F.col("average"))
        .select("seq", "id", "merchant", "date", "amount", "average", "sum_before", "rows_before")
    )


def new_merchants(txn: DataFrame) -> DataFrame:
    """First transaction of every merchant; a partial aggregate, no window over the merchant."""
    order = F.struct("date", "seq")
    first = F.min_by(F.struct("seq", "id", "date", "amount"), order).alias("first")
    return txn.groupBy("merchant").agg(first).select("merchant", "first.*")


def busy_days(txn: DataFrame, deviations: float = 3.0) -> DataFrame:
    """Days on which an account has more than mean + ``deviations`` x sd of its daily counts.

    ``merchant`` is the account column; the window sees one row per account and day.
    """
    daily = txn.groupBy("merchant", F.to_date("date").alias("day")).agg(F.count("*").alias("n"))
    account = W.partitionBy("merchant")
    return (
        daily.withColumn("mean", F.avg("n").over(account))
        .withColumn("sd", F.stddev_pop("n").over(account))
        .where(F.col("n") > F.col("mean") + F.lit(deviations) * F.col("sd"))
    )


def category_spikes(txn: DataFrame, as_of: str, days: int = 7, factor: float = 2.0) -> DataFrame:
    """Periods in which a category's sum is above ``factor`` times the mean of its earlier periods."""
    end = F.lit(as_of).cast("timestamp_ntz")
    age = F.timestamp_diff("MICROSECOND", F.col("date"), end)
    period = F.floor((age - 1) / F.lit(days * 86_400_000_000)).cast("bigint")
    sums = (
        txn.where(F.col("date") < end)
        .groupBy("category", period.alias("periods_back"))
        .agg(money_sum(F.col("amount")).alias("total"))
    )
    earlier = W.partitionBy("category").orderBy(F.desc("periods_back")).rowsBetween(W.unboundedPreceding, -1)
    return sums.withColumn("mean_before", (F.sum(F.col("total").cast("decimal(24,4)")).over(earlier).cast("double") / F.count("total").over(earlier))).where(
        F.col("total") > F.lit(factor) * F.col("mean_before")
    )


def large(txn: DataFrame, threshold: float = 1000.0) -> DataFrame:
    return txn.where(F.col("amount") > threshold)


def anomaly_table(txn: DataFrame, duplicates: DataFrame, as_of: str, security: DataFrame | None = None) -> DataFrame:
    """Union of all rules in the shape of the anomalies table."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    parts = [
        anomaly_rows(
            duplicates, kind="DUPLICATE", severity="medium", description=F.col("description"),
            ids=F.array("id", "dup_id"), action="Review for duplicate charges", as_of=as_of,
        ),
        anomaly_rows(
            spikes(txn), kind="SPIKE", severity="medium",
            description=F.concat(F.col("merchant"), F.lit(" $"), money(F.col("amount")), F.lit(" against an average of $"), money(F.col("average"))),
            ids=F.array("id"), action="Check whether this amount is expected", as_of=as_of,
        ),
        anomaly_rows(
            new_merchants(txn), kind="NEW_MERCHANT", severity="low",
            description=F.concat(F.lit("First transaction with "), F.col("merchant"), F.lit(" $"), money(F.col("amount"))),
            ids=F.array("id"), action="Confirm that you know this merchant", as_of=as_of,
        ),
        anomaly_rows(
            busy_days(txn), kind="FREQUENCY", severity="medium",
            description=F.concat(F.col("n").cast("string"), F.lit(" transactions with "), F.col("merchant"), F.lit(" on "), day("day")),
            ids=F.array(F.concat_ws("@", F.col("merchant"), day("day"))), action="Review this day", as_of=as_of,
        ),
        anomaly_rows(
            category_spikes(txn, as_of), kind="CATEGORY_SPIKE", severity="medium",
            description=F.concat(F.col("category"), F.lit(" $"), money(F.col("total")), F.lit(" against a mean of $"), money(F.col("mean_before"))),
            ids=F.array(F.concat_ws("@", F.col("category"), F.col("periods_back").cast("string"))),
            action="Review spending in this category", as_of=as_of,
        ),
        anomaly_rows(
            large(txn), kind="LARGE", severity="high",
            description=F.concat(F.lit("Large transaction: "), F.col("merchant"), F.lit(" $"), money(F.col("amount"))),
            ids=F.array("id"), action="Verify transaction was authorized", as_of=as_of,
        ),
    ]
    if security is not None:
        parts.append(security)
    return reduce(DataFrame.unionByName, parts)


def anomaly_summary(anomalies: DataFrame, txn: DataFrame) -> DataFrame:
    """One row: 'Found n potential anomalies in m transactions'."""
    counts = anomalies.select(F.lit(1).alias("a"), F.lit(0).alias("t")).unionAll(
        txn.select(F.lit(0).alias("a"), F.lit(1).alias("t"))
    )
    return counts.agg(F.sum("a").alias("a"), F.sum("t").alias("t")).select(
        F.format_string("Found %d potential anomalies in %d transactions", "a", "t").alias("summary")
    )
