"""Reads, writes and reports over the transactions table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import money_sum
from ..schemas import ANOMALIES, AUDIT_LOG, SUBSCRIPTIONS, TRANSACTIONS
from ..sources.tables import read_table, write_table


def _instant(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def _days_before(as_of: str, days: int) -> Column:
    return _instant(as_of) - F.make_dt_interval(F.lit(days))


# --- reads -------------------------------------------------------------------------


def transactions(
    txn: DataFrame, as_of: str, days: int = 30, category: str | None = None, merchant: str | None = None
) -> DataFrame:
    """Rows since the cut-off, newest first; ``merchant`` is a LIKE text in any case."""
    out = txn.where(F.col("date") >= _days_before(as_of, days))
    if category:
        out = out.where(F.col("category") == category)
    if merchant:
        out = out.where(_like(merchant))
    return out.orderBy(F.desc("date"), "id")


def _like(merchant: str) -> Column:
    return F.col("merchant").ilike("%" + merchant.replace("\\", "\\\\") + "%")


def transaction_by_id(txn: DataFrame, tx_id: str) -> DataFrame:
    return txn.where(F.col("id") == tx_id)


def unresolved_anomalies(anomalies: DataFrame) -> DataFrame:
    return anomalies.where(~F.col("resolved")).orderBy(F.desc("created_at"), "id")


def resolve_anomalies(anomalies: DataFrame, ids: DataFrame) -> DataFrame:
    """New state of the table with the listed ids resolved."""
    wanted = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return (
        anomalies.join(wanted, "id", "left")
        .withColumn("resolved", F.col("resolved") | F.coalesce("_hit", F.lit(False)))
        .drop("_hit")
        .select(anomalies.columns)
    )


def resolved_hits(anomalies: DataFrame, ids: DataFrame) -> DataFrame:
    """One row: how many rows the listed ids touch."""
    return anomalies.join(ids.select("id").distinct(), "id", "left_semi").agg(F.count("*").alias("hits"))


# --- writes --------------------------------------------------------------------------


def upsert(stored: DataFrame, batch: DataFrame, key: str = "id", order: str = "load_seq") -> DataFrame:
    """Insert or replace by id: the row with the highest load number wins.

    An aggregate with map-side combine, not a window: copies of one id are folded
    before the shuffle.
    """
    both = stored.unionByName(batch)
    others = [c for c in both.columns if c not in (key, order)]
    # Equal load numbers: one of them, chosen by a hash, so that the result does not depend on the order of rows.
    latest = F.max_by(F.struct(*others), F.struct(order, F.xxhash64(*others))).alias("_row")
    return both.groupBy(key).agg(latest, F.max(order).alias(order)).select(key, "_row.*", order)


def replace_transactions(spark: SparkSession, df: DataFrame, path: str) -> int:
    """Clear and insert, all or nothing; returns the old number of rows, 0 for a new table."""
    old = read_table(spark, path, TRANSACTIONS).count()
    write_table(df.select([f.name for f in TRANSACTIONS]), path)
    return old


def upsert_table(spark: SparkSession, batch: DataFrame, path: str, key: str = "id", order: str = "load_seq") -> None:
    """``upsert`` into the table at ``path``, all or nothing; a repeated batch changes nothing."""
    write_table(upsert(read_table(spark, path, batch.schema), batch, key, order), path)


LEDGER_TABLES = {
    "transactions": TRANSACTIONS,
    "subscriptions": SUBSCRIPTIONS,
    "anomalies": ANOMALIES,
    "audit_log": AUDIT_LOG,
}
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def to_json_lines(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows as JSON lines: ISO dates, id list as a JSON array, flags as 0 or 1."""

    def value(f: T.StructField) -> Column:
        if isinstance(f.dataType, T.TimestampNTZType):
            return F.date_format(f.name, ISO)
        if isinstance(f.dataType, T.BooleanType):
            return F.col(f.name).cast("int")
        return F.col(f.name)

    return df.select(F.to_json(F.struct(*[value(f).alias(f.name) for f in schema])).alias("value"))


def from_json_lines(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """Inverse of ``to_json_lines``; a date that cannot be read becomes NULL."""

    def stored(f: T.StructField) -> T.DataType:
        if isinstance(f.dataType, T.TimestampNTZType):
            return T.StringType()
        return T.IntegerType() if isinstance(f.dataType, T.BooleanType) else f.dataType

    def value(f: T.StructField) -> Column:
        c = F.col(f"r.{f.name}")
        if isinstance(f.dataType, T.TimestampNTZType):
            return F.try_to_timestamp(c).cast("timestamp_ntz")
        return c.cast("boolean") if isinstance(f.dataType, T.BooleanType) else c

    text = T.StructType([T.StructField(f.name, stored(f)) for f in schema])
    return lines.select(F.from_json("value", text).alias("r")).select(*[value(f).alias(f.name) for f in schema])


def export_ledger(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        to_json_lines(df, LEDGER_TABLES[name]).write.mode("overwrite").text(f"{folder}/{name}")


def import_ledger(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {n: from_json_lines(spark.read.text(f"{folder}/{n}"), s) for n, s in LEDGER_TABLES.items()}


# --- reports -----------------------------------------------------------------------------


def spending_by_category(txn: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    return (
        txn.where(F.col("date") >= _days_before(as_of, days))
        .groupBy("category")
        .agg(F.round(money_sum(F.col("amount")), 2).alias("total"))
        .orderBy(F.desc("total"), "category")
    )


def category_share(totals: DataFrame) -> DataFrame:
    """Percent of the total and bar length per category; runs on the grouped rows only."""
    from pyspark.sql import Window as W

    everything = F.sum("total").over(W.partitionBy())
    percent = F.when(everything > 0, F.col("total") / everything * 100).otherwise(F.lit(0.0))
    return totals.select(
        "category",
        "total",
        F.round(percent, 1).alias("percent"),
        F.floor(percent / F.lit(3.33)).cast("int").alias("bar"),
    )


def spending_trend(txn: DataFrame, as_of: str, weeks: int = 4) -> DataFrame:
    """Rolling 7-day weeks back from ``as_of``; a week without transactions is kept as 0."""
    age = F.timestamp_diff("MICROSECOND", F.col("date"), _instant(as_of))
    week = F.floor((age - 1) / F.lit(7 * 86_400_000_000)).cast("bigint")
    sums = (
        txn.where((F.col("date") < _instant(as_of)) & (F.col("date") >= _days_before(as_of, 7 * weeks)))
        .groupBy(week.alias("week"))
        .agg(F.count("*").alias("n"), money_sum(F.col("amount")).alias("total"))
    )
    calendar = txn.sparkSession.range(weeks).withColumnRenamed("id", "week")
    back = lambda extra: F.date_format(_instant(as_of) - F.make_dt_interval((F.col("week") + extra).cast("int") * 7), "yyyy-MM-dd")
    return (
        calendar.join(sums, "week", "left")
        .select(
            "week",
            back(1).alias("week_start"),
            back(0).alias("week_end"),
            F.coalesce("n", F.lit(0)).alias("transaction_count"),
            F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total_spent"),
        )
        .orderBy("week")
    )


def _history(amount: Column) -> list[Column]:
    return [
        F.count("*").alias("count"),
        F.round(F.coalesce(money_sum(amount), F.lit(0.0)), 2).alias("total"),
        F.round(F.coalesce(money_sum(amount) / F.count(amount), F.lit(0.0)), 2).alias("average"),
        F.max("date").alias("last_seen"),
    ]


def merchant_history(txn: DataFrame, merchant: str) -> DataFrame:
    return txn.where(_like(merchant)).agg(*_history(F.col("amount"))).select(F.lit(merchant).alias("merchant"), "*")


def merchant_history_all(txn: DataFrame) -> DataFrame:
    return txn.groupBy("merchant").agg(*_history(F.col("amount")))


def table_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count of every table."""
    counts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows") for n, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def ledger_total(txn: DataFrame) -> DataFrame:
    return txn.agg(F.count("*").alias("n"), F.round(F.coalesce(money_sum(F.col("amount")), F.lit(0.0)), 2).alias("total"))


def period_change(txn: DataFrame, as_of: str, days: int) -> DataFrame:
    """This period against the one before, in one pass over both."""
    start, before = _days_before(as_of, days), _days_before(as_of, 2 * days)
    part = lambda cond: F.coalesce(money_sum(F.when(cond, F.col("amount"))), F.lit(0.0))
    sums = txn.where((F.col("date") >= before) & (F.col("date") < _instant(as_of))).agg(
        part(F.col("date") >= start).alias("now"), part(F.col("date") < start).alias("prev")
    )
    change = F.col("now") - F.col("prev")
    return sums.select(
        F.round("now", 2).alias("current_total"),
        F.round("prev", 2).alias("previous_total"),
        F.round(change, 2).alias("change"),
        F.when(F.col("prev") > 0, F.round(change / F.col("prev") * 100, 1)).otherwise(F.lit(0.0)).alias("change_pct"),
    )
