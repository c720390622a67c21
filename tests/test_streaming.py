import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import duplicates as D
from ledgerloom.sources import views as V
from ledgerloom.streaming import ledger_stream as LS
from ledgerloom.streaming.runs import arriving, run_to_table


def test_upserts_resume_and_repeat(spark, sf_dir, tmp_path):
    txn = V.txn(spark, sf_dir).select("seq", "id", "amount").withColumn("load_seq", F.lit(1))
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    txn.write.parquet(source)
    first = LS.run_upserts(arriving(spark, source, txn.schema), out, mark)
    n = first.count()
    again = LS.run_upserts(arriving(spark, source, txn.schema), out, mark)
    assert again.count() == n == txn.count()
    txn.withColumn("amount", F.lit(0.0)).withColumn("load_seq", F.lit(2)).write.mode("append").parquet(source)
    last = LS.run_upserts(arriving(spark, source, txn.schema), out, mark)
    assert last.count() == n and last.agg(F.max("amount")).first()[0] == 0.0


def test_weekly_append_emits_only_closed_windows(spark, sf_dir, tmp_path):
    txn = V.txn(spark, sf_dir)
    source = str(tmp_path / "in")
    txn.write.parquet(source)
    stream = LS.weekly_spending(arriving(spark, source, txn.schema))
    table = run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    weeks = [r[0] for r in table.select("week_start").distinct().orderBy("week_start").collect()]
    assert len(weeks) >= 3


def test_subscription_stream_resumes(spark, sf_dir, tmp_path):
    batch = V.subscription_batch(spark, sf_dir)
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    batch.write.parquet(source)
    start = V.subscriptions(spark, sf_dir)
    one = LS.run_subscription_upserts(arriving(spark, source, batch.schema), start, out, mark).count()
    two = LS.run_subscription_upserts(arriving(spark, source, batch.schema), start, out, mark).count()
    assert one == two >= start.count()


NOW = dt.datetime(2025, 1, 1)
LEDGER = "seq long, id string, merchant string, amount double, date timestamp_ntz"


def arrive(spark, rows, folder):
    spark.createDataFrame(rows, LEDGER).coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("seed,delay", [(1, 24), (2, 0), (3, 72)])
def test_duplicates_of_a_stream_against_the_batch(spark, tmp_path, seed, delay):
    rng = random.Random(seed)
    rows, hour = [], 0.0
    for i in range(400):
        hour += rng.expovariate(1.0)
        rows.append((i, str(i), rng.choice(["Hot", "hot", "b"]), round(rng.randrange(0, 30) * 0.0037, 4), NOW + dt.timedelta(hours=hour)))
    folder, at = str(tmp_path / "in"), 0
    while at < len(rows):
        size = rng.randint(20, 120)
        arrive(spark, rows[at : at + size], folder)
        at += size
    df = spark.createDataFrame(rows, LEDGER)
    got = LS.run_duplicates(arriving(spark, folder, df.schema, files_per_batch=1), str(tmp_path / "out"), str(tmp_path / "checkpoint"), delay_hours=delay)
    pairs = lambda x: {(r["seq"], r["dup_seq"]) for r in x.collect()}
    assert pairs(got) == pairs(D.first_later_matches(df)) != set()
    done = LS.stream_progress(spark, str(tmp_path / "out")).orderBy("batch").collect()
    assert sum(r["rows"] for r in done) == 400 and all(r["late"] == 0 for r in done)
    # State is what 24 hours and the delay can hold, not all that came.
    assert max(r["state_rows"] for r in done) < 90 * (2 + delay / 24)


def test_late_and_undated_rows_are_set_aside(spark, tmp_path):
    folder = str(tmp_path / "in")
    hours = lambda h: NOW + dt.timedelta(hours=h)
    arrive(spark, [(1, "1", "m", 5.0, hours(0)), (2, "2", "m", 5.0, hours(100)), (9, "9", "m", 5.0, None)], folder)
    arrive(spark, [(3, "3", "m", 5.0, hours(80)), (4, "4", "m", 5.0, hours(10)), (5, "5", "m", 5.0, hours(101))], folder)
    stream = lambda: arriving(spark, folder, spark.createDataFrame([], LEDGER).schema, files_per_batch=1)
    out = str(tmp_path / "out")
    got = LS.run_duplicates(stream(), out, str(tmp_path / "checkpoint"))
    assert {(r["seq"], r["dup_seq"]) for r in got.collect()} == {(2, 3), (3, 5)}
    assert sorted(r["id"] for r in LS.late_rows(spark, out, stream().schema).collect()) == ["4", "9"]
    done = LS.stream_progress(spark, out).orderBy("batch").collect()
    assert [(r["rows"], r["late"], r["undated"]) for r in done] == [(3, 0, 1), (3, 1, 0)]
    arrive(spark, [(6, "6", "m", 5.0, hours(102))], folder)
    more = LS.run_duplicates(stream(), out, str(tmp_path / "checkpoint"))
    assert {(r["seq"], r["dup_seq"]) for r in more.collect()} == {(2, 3), (3, 5), (5, 6)}


def test_upserts_are_compacted(spark, tmp_path):
    import os

    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "id string, amount double, load_seq int"
    for k in range(7):
        spark.createDataFrame([(str(i), float(k), k) for i in range(k, k + 3)], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = arriving(spark, folder, spark.createDataFrame([], schema).schema, files_per_batch=1)
    rows = {r["id"]: r["amount"] for r in LS.run_upserts(stream, out, str(tmp_path / "checkpoint"), compact_every=3).collect()}
    assert rows == {str(i): float(min(i, 6)) for i in range(9)}
    assert sorted(n for n in os.listdir(out) if "=" in n) == ["base=5", "batch=6"]


def test_weeks_close_when_a_later_row_arrives(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [(i, str(i), "m", 1.0, NOW + dt.timedelta(days=i)) for i in range(20)]
    df = spark.createDataFrame(rows, LEDGER).withColumn("category", F.lit("c"))
    df.coalesce(1).write.mode("append").parquet(folder)
    LS.closing_row(df).write.mode("append").parquet(folder)
    stream = LS.weekly_spending(arriving(spark, folder, df.schema, files_per_batch=1))
    table = run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert sum(r["n"] for r in table.collect()) == 20 and table.where("category is null").count() == 0


def test_a_late_slice_is_a_batch_of_many_files(spark, tmp_path, monkeypatch):
    from ledgerloom.plans import stream_queries as SQ
    from ledgerloom.plans.registry import QUERIES

    monkeypatch.setattr(SQ, "shared_dir", lambda spark, name: str(tmp_path / "run"))
    events = spark.range(4000).selectExpr(
        "id AS event_id", "cast('2024-01-01' AS timestamp_ntz) + make_dt_interval(0, 0, cast(id AS int)) AS ts", "id % 7 AS user_id", "'view' AS event_type", "cast(id % 50 AS double) AS value", "'' AS props"
    )
    events.repartitionByRange(4, "event_id").write.parquet(str(tmp_path / "events.parquet"))
    late = QUERIES["STR3_late_charges"](spark, str(tmp_path)).count()
    # Rows of 4,000 minutes: of those that come last, all that lie a day before the end were passed by the watermark.
    assert late == len([i for i in range(0, 4000, 20) if i < 3999 - 1440])
    assert len(list((tmp_path / "run" / "in").glob("*.parquet"))) > 5
    assert len(list((tmp_path / "run" / "out" / "progress").glob("batch=*"))) == 5


def test_a_slice_of_arriving_mail_is_one_batch(spark, sf_dir, monkeypatch):
    from ledgerloom.operators.shaping import shared_dir
    from ledgerloom.plans import registry, stream_queries

    registry.load()
    folder = []
    monkeypatch.setattr(stream_queries, "shared_dir", lambda s, name: folder.append(str(shared_dir(s, name))) or folder[0])
    mail = stream_queries.V.mail
    monkeypatch.setattr(stream_queries.V, "mail", lambda s, d: mail(s, d).repartition(20))
    n = registry.QUERIES["STR1_mail_stream"](spark, sf_dir).count()
    assert n > 0
    batches = [f for f in os.listdir(folder[0].removeprefix("file://") + "/checkpoint/commits") if f.isdigit()]
    assert len(batches) == stream_queries.SLICES
