"""Whole-table writes, audit seals and null keys."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators import audit as A
from ledgerloom.operators import ledger as L
from ledgerloom.operators.shaping import last_before, sums_before
from ledgerloom.sources.tables import drop_old_versions, read_table, write_table

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("amount", T.DoubleType()), T.StructField("load_seq", T.IntegerType())])


def test_a_failed_write_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "table")
    assert read_table(spark, path, SCHEMA).count() == 0
    good = spark.createDataFrame([("a", 1.0, 0), ("b", 2.0, 0)], SCHEMA)
    write_table(good, path)
    bad = good.withColumn("amount", F.when(F.col("id") == "b", F.raise_error(F.lit("lost"))).otherwise(F.col("amount")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        write_table(bad, path)
    assert read_table(spark, path, SCHEMA).count() == 2
    # The table may be read while it is replaced, and a repeated batch changes nothing.
    batch = spark.createDataFrame([("b", 5.0, 1), ("c", 3.0, 1)], SCHEMA)
    for _ in range(2):
        L.upsert_table(spark, batch, path)
        assert sorted(tuple(r) for r in read_table(spark, path, SCHEMA).collect()) == [("a", 1.0, 0), ("b", 5.0, 1), ("c", 3.0, 1)]
    assert drop_old_versions(spark, path) >= 2
    assert read_table(spark, path, SCHEMA).count() == 3


def test_equal_load_numbers_have_one_winner(spark):
    rows = [("a", float(i), 1) for i in range(20)]
    got = {L.upsert(spark.createDataFrame(r, SCHEMA), spark.createDataFrame([], SCHEMA)).first()["amount"] for r in (rows, rows[::-1])}
    assert len(got) == 1


def entries(spark, numbers):
    rows = [("c", n, f"e{n}", "2025-01-01T00:00:00", "act", "tool", f"d{n}", 0, 0, "INFO") for n in numbers]
    return spark.createDataFrame(rows, "chain_id string, seq long, id string, timestamp string, action string, tool_used string, details string, redactions_applied int, security_flags int, level string")


def test_seals_show_what_a_segment_alone_does_not(spark):
    log = A.append_chain(entries(spark, range(35)), segment=10).cache()
    sealed = A.seals(log).cache()
    state = lambda l, s=sealed: A.verify_seals(l, s).first().asDict()
    assert state(log) == {"segments": 4, "missing_segments": 0, "changed_segments": 0, "broken_seals": 0, "is_valid": True}
    gone = log.where("segment <> 1")
    assert A.verify_chain(gone).first()["is_valid"] and not state(gone)["is_valid"] and state(gone)["missing_segments"] == 1
    assert state(log.where("seq <> 34"))["changed_segments"] == 1
    assert state(log, sealed.where("number <> 1"))["broken_seals"] == 2
    assert not state(log, sealed.withColumn("entries", F.col("entries") + 1))["is_valid"]


def test_late_rows_are_found(spark):
    log = A.append_chain(entries(spark, [1, 2, 5]))
    assert [r["seq"] for r in A.late_rows(entries(spark, [3, 6]), log).collect()] == [3]


def test_rows_without_a_key_are_kept(spark):
    df = spark.createDataFrame([(None, 1, 1.0), (None, 2, 1.0), ("a", 3, 5.0), (None, 4, 100.0)], "k string, seq long, v double").withColumn("b", F.lit(None).cast("long"))
    rows = sums_before(df, ["k"], "b", ["seq"], "v").orderBy("seq").collect()
    assert [(r["sum_before"], r["rows_before"]) for r in rows] == [(0.0, 0), (1.0, 1), (0.0, 0), (2.0, 2)]
    assert [r["found"] for r in last_before(df, ["k"], "seq", "v").orderBy("seq").collect()] == [None, 1.0, None, 1.0]
