"""The stored audit log: appends, repeats, late rows, what is gone or changed, proofs."""

from dataclasses import replace

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from ledgerloom.operators import audit as A
from ledgerloom.operators import auditlog as AL

ENTRIES = "chain_id string, seq long, id string, timestamp string, action string, tool_used string, details string, redactions_applied int, security_flags int, level string"


def entries(spark, chains, numbers):
    rows = [(c, n, f"{c}{n}", "2025-01-01T00:00:00", "act", "tool", f"d{n}", 0, 0, "INFO") for c in chains for n in numbers]
    return spark.createDataFrame(rows, ENTRIES)


def wrong(log):
    row = AL.verify_log(log).first().asDict()
    return {k for k, v in row.items() if k in AL.CHECKS and v} | ({"root"} if not row["root_ok"] else set()), row["is_valid"]


@pytest.fixture()
def small_fan(monkeypatch):
    monkeypatch.setattr(AL, "FAN", 3)


def test_appends_make_one_log_and_repeats_change_nothing(spark, tmp_path, small_fan):
    folder = str(tmp_path / "log")
    parts = [range(0, 13), range(13, 17), range(17, 40), range(40, 41)]
    records = [AL.append_log(spark, folder, entries(spark, "abc", p), k, segment=5) for k, p in enumerate(parts)]
    again = [AL.append_log(spark, folder, entries(spark, "abc", parts[k]), k, segment=5) for k in (2, 3)]
    assert [r["root"] for r in again] == [r["root"] for r in records[2:]] and AL.appends(spark, folder) == 4
    log = AL.stored_log(spark, folder)
    plain = A.append_chain(entries(spark, "abc", range(41)), segment=5)
    keys = ["chain_id", "segment", "seq", "entry_hash", "previous_hash"]
    assert sorted(log.entries.select(keys).collect()) == sorted(plain.select(keys).collect())
    assert wrong(log) == (set(), True)
    assert log.record["size"] == log.states.count() > 27  # more than three levels of three
    for k, old in enumerate(records):
        assert AL.is_consistent(old, log).first()["is_consistent"]
        assert wrong(AL.stored_log(spark, folder, k)) == (set(), True)
    proofs = AL.inclusion_proofs(log, log.states).select("number", "path", AL.proven(log.record).alias("ok")).collect()
    assert len(proofs) == log.record["size"] and all(r["ok"] for r in proofs) and max(len(r["path"]) for r in proofs) == 3


def test_what_is_gone_or_changed_shows(spark, tmp_path, small_fan):
    folder = str(tmp_path / "log")
    for k, p in enumerate([range(0, 22), range(22, 43)]):
        AL.append_log(spark, folder, entries(spark, "ab", p), k, segment=5)
    log = AL.stored_log(spark, folder)
    for segment in (0, 4, 8):  # the first, a middle and the last one
        gone = replace(log, entries=log.entries.where(f"not (chain_id = 'a' and segment = {segment})"))
        assert A.verify_chain(gone.entries).first()["is_valid"]
        assert wrong(gone) == ({"missing_segments"}, False)
        report = A.audit_report(gone.entries, "2025-01-02 00:00:00", state=AL.verify_log(gone)).first()
        assert not report["chain_integrity"]
    forged = entries(spark, "a", [100])
    assert wrong(replace(log, entries=log.entries.unionByName(A.append_chain(forged, segment=5)))) == ({"unknown_segments"}, False)
    last = replace(log, entries=log.entries.where("seq <> 42"))
    assert wrong(last) == ({"changed_segments"}, False)
    assert wrong(replace(log, states=log.states.where("number <> 3")))[0] >= {"missing_states", "broken_nodes"}
    assert wrong(replace(log, states=log.states.withColumn("entries", F.col("entries") + 1)))[0] >= {"broken_states", "changed_segments"}
    assert wrong(replace(log, nodes=log.nodes.where("number <> 1")))[0] >= {"broken_nodes"}
    assert wrong(replace(log, record=Row(size=log.record["size"], root="0" * 64, open=log.record["open"]))) == ({"root"}, False)


def test_a_log_cut_back_everywhere_shows_against_an_older_record(spark, tmp_path, small_fan):
    folder, other = str(tmp_path / "log"), str(tmp_path / "other")
    for k, p in enumerate([range(0, 22), range(22, 43)]):
        last = AL.append_log(spark, folder, entries(spark, "ab", p), k, segment=5)
    AL.append_log(spark, other, entries(spark, "ab", range(0, 22)), 0, segment=5)
    AL.append_log(spark, other, entries(spark, "ab", range(23, 43)), 1, segment=5)
    assert not AL.is_consistent(last, AL.stored_log(spark, folder, 0)).first()["is_consistent"]
    assert wrong(AL.stored_log(spark, other)) == (set(), True)
    assert not AL.is_consistent(last, AL.stored_log(spark, other)).first()["is_consistent"]


def test_late_rows_are_refused_or_renumbered(spark, tmp_path):
    folder = str(tmp_path / "log")
    AL.append_log(spark, folder, entries(spark, "ab", [1, 2, 5]), 0)
    with pytest.raises(ValueError, match="2 chains"):
        AL.append_log(spark, folder, entries(spark, "ab", [3, 6]), 1)
    assert AL.appends(spark, folder) == 1
    AL.append_log(spark, folder, entries(spark, "ab", [3, 6]), 1, late="renumber")
    log = AL.stored_log(spark, folder)
    assert wrong(log) == (set(), True)
    assert [(r["seq"], r["id"]) for r in log.entries.where("chain_id = 'a'").orderBy("seq").collect()] == [(1, "a1"), (2, "a2"), (5, "a5"), (6, "a3"), (9, "a6")]


def test_long_segments_and_empty_appends(spark, tmp_path):
    folder = str(tmp_path / "log")
    AL.append_log(spark, folder, entries(spark, "a", range(300)), 0)
    AL.append_log(spark, folder, entries(spark, "a", []), 1)
    AL.append_log(spark, folder, entries(spark, "a", range(300, 303)), 2)
    assert wrong(AL.stored_log(spark, folder)) == (set(), True)
