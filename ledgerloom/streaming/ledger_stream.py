"""Arriving transactions: id dedupe, duplicate charges, weekly spending, upserts.

Every table written from a micro-batch is keyed by the batch number, so a batch
that is repeated after a failure replaces its own rows and nothing else.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import money_sum
from ..operators.duplicates import HOURS, MICROS, matches_of_arrivals, micros_of
from ..operators.ledger import upsert
from ..operators.subscriptions import upsert_subscriptions
from ..sources.tables import drop_folder, is_complete, write_table
from .runs import run_batches


HOUR = MICROS // HOURS


def distinct_ids(txn: DataFrame, delay: str = "1 day") -> DataFrame:
    """First row of every id; state is dropped once the watermark has passed."""
    timed = txn.withColumn("event_time", F.col("date").cast("timestamp"))
    return timed.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["id"]).drop("event_time")


def weekly_spending(txn: DataFrame, delay: str = "1 day") -> DataFrame:
    """Sum per category and tumbling 7 days."""
    timed = txn.withColumn("event_time", F.col("date").cast("timestamp"))
    return (
        timed.withWatermark("event_time", delay)
        .groupBy(F.window("event_time", "7 days").alias("week"), "category")
        .agg(F.count("*").alias("n"), money_sum(F.col("amount")).alias("total"))
        .select(F.col("week.start").alias("week_start"), "category", "n", "total")
    )


def closing_row(txn: DataFrame, days: int = 16) -> DataFrame:
    """One row without values, ``days`` after the last date: when it arrives behind all others, every week before it is closed."""
    values = {f.name: F.lit(None).cast(f.dataType) for f in txn.schema if f.name != "date"}
    end = txn.agg(F.max("date").alias("date")).where("date is not null").withColumn("date", F.col("date") + F.make_dt_interval(F.lit(days)))
    return end.withColumns(values).select(txn.columns)


def keep_latest(stream: DataFrame, table: str, checkpoint: str) -> None:
    """Store the whole small result of an aggregation after every batch."""
    run_batches(stream, lambda batch, number: write_table(batch, table), checkpoint, mode="complete")


def _part(folder: str, number: int) -> str:
    return f"{folder}/batch={number}"


MATCH = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("id", T.StringType()),
    T.StructField("dup_seq", T.LongType()),
    T.StructField("dup_id", T.StringType()),
    T.StructField("merchant", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("hours", T.DoubleType()),
])
END = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("id", T.StringType()),
    T.StructField("merchant", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("micros", T.LongType()),
])
ENDS = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("cell", T.LongType()),
    T.StructField("time", T.LongType()),
    T.StructField("last", END),
])
PROGRESS = T.StructType([
    T.StructField("watermark", T.LongType()),
    T.StructField("rows", T.LongType()),
    T.StructField("late", T.LongType()),
    T.StructField("undated", T.LongType()),
    T.StructField("state_rows", T.LongType()),
])


def run_duplicates(txn: DataFrame, folder: str, checkpoint: str, delay_hours: int = 24) -> DataFrame:
    """Duplicate charges of an arriving ledger; returns the matches so far.

    A join of the stream with its own last 24 hours, on the interval of time and
    the step of the amount. The watermark is the greatest date of the earlier
    batches less ``delay_hours``: rows before it come too late and are set aside
    under ``late``, as are rows without a date, whose partners have no end; both are
    counted. State is the last row of each cell (merchant, amount step, 24 hours)
    that a row after the watermark can still reach, and nothing else: all rows of a
    cell match each other, so an arriving row can only be the first partner of the
    last one. (A join of two streams would keep every row of those hours and pair
    every row of a cell with all others.) No stored row is read again.

    "Later" is the order of arrival: by batch, in a batch by ``seq``. A batch that is
    repeated writes the same rows to the same folders.
    """
    spark = txn.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        mark, ends = None, spark.createDataFrame([], ENDS)
        if number > 0:
            mark = progress_of(spark, folder, number - 1)["watermark"]
            ends = spark.read.schema(ENDS).parquet(_part(f"{folder}/ends", number - 1))
        micros = micros_of(F.col("date"))
        late = F.lit(False) if mark is None else micros < mark
        counted = batch.agg(
            F.max(micros).alias("last"), F.count("*").alias("rows"), F.count_if(late).alias("late"), F.count_if(F.col("date").isNull()).alias("undated")
        ).first()
        batch.where(late | F.col("date").isNull()).write.mode("overwrite").parquet(_part(f"{folder}/late", number))
        found, last = matches_of_arrivals(batch.where(~late & F.col("date").isNotNull()), ends)
        found.write.mode("overwrite").parquet(_part(f"{folder}/matches", number))
        reached = [m for m in (mark, None if counted["last"] is None else counted["last"] - delay_hours * HOUR) if m is not None]
        mark = max(reached) if reached else None
        # A later row is at or after the watermark, so it reaches back to the cell that holds the watermark less 24 hours.
        kept = last if mark is None else last.where(F.col("time") >= (mark - MICROS) // MICROS)
        kept.write.mode("overwrite").parquet(_part(f"{folder}/ends", number))
        state = spark.read.schema(ENDS).parquet(_part(f"{folder}/ends", number)).count()
        done = [(mark, counted["rows"], counted["late"], counted["undated"], state)]
        spark.createDataFrame(done, PROGRESS).coalesce(1).write.mode("overwrite").parquet(_part(f"{folder}/progress", number))
        drop_folder(spark, _part(f"{folder}/ends", number - 2))  # the one before is kept for a repeat of this batch

    run_batches(txn, step, checkpoint)
    return first_matches(spark, folder)


def progress_of(spark: SparkSession, folder: str, number: int) -> Row:
    return spark.read.schema(PROGRESS).parquet(_part(f"{folder}/progress", number)).first()


def stream_progress(spark: SparkSession, folder: str) -> DataFrame:
    """Watermark after each batch, rows it had, rows that were late or undated, rows of state."""
    return spark.read.schema(T.StructType([*PROGRESS.fields, T.StructField("batch", T.LongType())])).parquet(f"{folder}/progress")


def late_rows(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """Rows that came too late to be compared, or without a date."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{folder}/late")


def first_matches(spark: SparkSession, folder: str) -> DataFrame:
    """For every row the partner that arrived first."""
    matches = spark.read.schema(T.StructType([*MATCH.fields, T.StructField("batch", T.LongType())])).parquet(f"{folder}/matches")
    best = F.min_by(F.struct("id", "dup_seq", "dup_id", "merchant", "amount", "hours"), F.struct("batch", "dup_seq")).alias("m")
    return matches.groupBy("seq").agg(best).select("seq", "m.*")


def run_upserts(txn: DataFrame, folder: str, checkpoint: str, compact_every: int = 16) -> DataFrame:
    """Insert or replace arriving rows by id; returns the current ledger.

    Each batch is stored as it came; the latest row per id is taken when the table
    is read. Every ``compact_every`` batches the current rows are written as one
    base, and what went into it is dropped: a reader sees the newest base and the
    batches after it. Bases and batches carry the batch number; a repeated batch
    writes the same again, and a base that is complete stays.
    """
    spark, schema = txn.sparkSession, txn.schema

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(_part(folder, number))
        if (number + 1) % compact_every == 0:
            base = f"{folder}/base={number}"
            if not is_complete(spark, base):
                drop_folder(spark, base)
                current_ledger(spark, folder, schema).write.parquet(base)
            for old in range(number - compact_every + 1, number + 1):
                drop_folder(spark, _part(folder, old))
            drop_folder(spark, f"{folder}/base={number - compact_every}")

    run_batches(txn, step, checkpoint)
    return current_ledger(spark, folder, schema)


def current_ledger(spark: SparkSession, folder: str, schema: T.StructType, order: str = "load_seq") -> DataFrame:
    """The latest row of each id, over the bases and batches that stand in the folder.

    A base repeats rows of its batches, and of equal rows one is taken, so it
    doesn't matter when those are still there.
    """
    stored = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(folder)
    return upsert(stored, stored.limit(0), order=order)


def _latest(spark: SparkSession, folder: str) -> int | None:
    """Highest batch number stored under ``folder``; None for a new table."""
    try:
        return spark.read.parquet(folder).agg(F.max("batch")).first()[0]
    except AnalysisException:
        return None


def run_subscription_upserts(sightings: DataFrame, start: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Fold arriving sightings into the subscription table; one version of the table per batch, of which the last two stay.

    ``start`` is version -1 and only stored when the folder is new, so a run that
    resumes from its checkpoint goes on from the last version.
    """
    spark, schema = sightings.sparkSession, start.schema
    if _latest(spark, folder) is None:
        start.write.mode("overwrite").parquet(_part(folder, -1))

    def stored(number: int) -> DataFrame:
        return spark.read.schema(schema).parquet(_part(folder, number))

    def step(batch: DataFrame, number: int) -> None:
        upsert_subscriptions(stored(number - 1), batch).write.mode("overwrite").parquet(_part(folder, number))
        drop_folder(spark, _part(folder, number - 2))  # the one before is kept for a repeat of this batch

    run_batches(sightings, step, checkpoint)
    return stored(_latest(spark, folder))
