import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import anomalies as A
from ledgerloom.operators import audit as AU
from ledgerloom.operators import duplicates as D
from ledgerloom.operators import ledger as L
from ledgerloom.operators import shaping as SH
from ledgerloom.operators import subscriptions as S

NOW = dt.datetime(2025, 3, 1)
AS_OF = "2025-03-01 00:00:00"
SCHEMA = "seq long, id string, merchant string, amount double, category string, date timestamp_ntz"


def txn(spark, rows):
    """rows of (merchant, amount, category, days ago or None)"""
    data = [
        (i, str(i), m, a, c, None if d is None else NOW - dt.timedelta(days=d)) for i, (m, a, c, d) in enumerate(rows)
    ]
    return spark.createDataFrame(data, SCHEMA)


def test_reports(spark):
    t = txn(spark, [("Cafe", 25.0, "Dining", 1), ("Cafe", 15.0, "Dining", 2), ("Shop", 100.0, "Shopping", 3), ("Old", 7.0, "Other", 60)])
    got = [tuple(r) for r in L.spending_by_category(t, AS_OF).collect()]
    assert got == [("Shopping", 100.0), ("Dining", 40.0)]
    assert L.category_share(L.spending_by_category(t, AS_OF)).where("category = 'Dining'").first()["percent"] == 28.6
    weeks = L.spending_trend(t, AS_OF, 4).collect()
    assert len(weeks) == 4 and (weeks[0]["transaction_count"], weeks[0]["total_spent"]) == (3, 140.0) and weeks[3]["total_spent"] == 0.0
    assert L.transactions(t, AS_OF, 7, merchant="caf").count() == 2
    change = L.period_change(t, AS_OF, 40).first()
    assert (change["current_total"], change["previous_total"], change["change_pct"]) == (140.0, 7.0, 1900.0)


def test_golden_ledger(spark):
    rows = [
        ("2026-02-10", "Walmart.com", 8.99, "Shopping"), ("2026-02-10", "Walmart.com", 6.72, "Shopping"), ("2026-02-10", "Walmart.com", 40.09, "Shopping"),
        ("2026-02-09", "PayRange Inc.", 10.0, "Transport"), ("2026-02-08", "The Event Palette", 27.2, "Entertainment"),
        ("2026-02-08", "The Event Palette", 27.2, "Entertainment"), ("2026-02-07", "GoFun", 10.98, "Transport"),
        ("2026-02-06", "Discover Card", 4.68, "Bills/Utilities"), ("2026-02-06", "Discover Card", 195.32, "Bills/Utilities"),
        ("2026-02-06", "Walmart", 50.0, "Shopping"), ("2026-02-05", "Walmart.com", 6.34, "Shopping"),
        ("2026-02-05", "Discover Card", 195.32, "Bills/Utilities"), ("2026-02-05", "Walmart.com", 43.51, "Shopping"),
        ("2026-02-05", "Walmart.com", 2.92, "Income"), ("2026-02-03", "Walmart.com", 6.99, "Shopping"), ("2026-02-03", "Walmart.com", 4.37, "Shopping"),
    ]
    data = [(i, str(i), m, a, c, dt.datetime.fromisoformat(d)) for i, (d, m, a, c) in enumerate(rows)]
    t = spark.createDataFrame(data, SCHEMA)
    shares = {r["category"]: (r["total"], r["percent"], r["bar"]) for r in L.category_share(L.spending_by_category(t, "2026-02-20 00:00:00")).collect()}
    assert shares == {
        "Bills/Utilities": (395.32, 61.7, 18), "Shopping": (167.01, 26.1, 7), "Entertainment": (54.4, 8.5, 2),
        "Transport": (20.98, 3.3, 0), "Income": (2.92, 0.5, 0),
    }
    assert L.ledger_total(t).first()["total"] == 640.63
    found = {r["description"] for r in D.duplicates(t).collect()}
    assert found == {"Possible duplicate: The Event Palette $27.20", "Possible duplicate: Discover Card $195.32 (24.0h apart)"}


def test_merchant_history(spark):
    t = txn(spark, [("Starbucks", a, "Dining", 1) for a in (5.45, 6.20, 4.80)])
    row = L.merchant_history(t, "starbucks").first()
    assert (row["count"], row["total"], row["average"]) == (3, 16.45, 5.48)


def brute_force(rows):
    out = {}
    for i, (m1, a1, _, t1) in enumerate(rows):
        if not m1 or not a1:
            continue
        for j in range(i + 1, len(rows)):
            m2, a2, _, t2 = rows[j]
            if m1.lower() != m2.lower() or abs(a1 - a2) > 0.01:
                continue
            if t1 is None or t2 is None or abs((t1 - t2).total_seconds()) <= 86400:
                out[i] = j
                break
    return out


@pytest.mark.parametrize("seed,cents,unknown", [(1, 0.01, 0.0), (2, 0.01, 0.2), (3, 0.0037, 0.3), (4, 0.005, 0.05)])
def test_duplicates_against_brute_force(spark, seed, cents, unknown):
    rnd = random.Random(seed)
    rows = []
    for _ in range(600):
        merchant = rnd.choice(["Hot", "hot", "HOT", "b", "c", ""])
        amount = round(rnd.randrange(0, 40) * cents, 4)
        date = None if rnd.random() < unknown else NOW + dt.timedelta(hours=rnd.randrange(0, 240))
        rows.append((merchant, amount, "x", date))
    df = spark.createDataFrame([(i, str(i), m, a, c, t) for i, (m, a, c, t) in enumerate(rows)], SCHEMA)
    got = {r["seq"]: r["dup_seq"] for r in D.first_later_matches(df).collect()}
    assert got == brute_force(rows)


def test_last_before_carries_over_blocks(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice("ab"), i, i if rnd.random() < 0.1 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, seq long, p long")
    got = {r["seq"]: r["found"] for r in SH.last_before(df, ["k"], "seq", "p", block_rows=7).collect()}
    last = {}
    for k, i, p in rows:
        assert got[i] == last.get(k)
        if p is not None:
            last[k] = p


def test_spikes_against_brute_force(spark):
    rnd = random.Random(6)
    rows = [("Hot", round(rnd.expovariate(0.1) + 0.01, 2), "x", rnd.randrange(0, 5000) / 1000) for _ in range(500)]
    t = txn(spark, rows)
    got = {r["seq"] for r in A.spikes(t).collect()}
    want, history = set(), []
    for seq, amount in sorted(((i, r[1]) for i, r in enumerate(rows)), key=lambda x: (NOW - dt.timedelta(days=rows[x[0]][3]), x[0])):
        if history and amount > 3 * (round(sum(history), 2) / len(history)):
            want.add(seq)
        history.append(amount)
    assert got == want


def test_same_day_groups_are_not_squared(spark):
    t = txn(spark, [("Hot", 5.0, "x", 1)] * 50 + [("Solo", 1.0, "x", 1)])
    row = D.same_day_duplicates(t).first()
    assert (row["n"], row["pairs"], row["first_id"]) == (50, 1225, "0")
    assert D.same_day_members(t).count() == 49


def sub(i, merchant, amount, seen, status="active"):
    return (i, merchant, amount, "monthly", seen, seen, status, seen)


SUB = "id string, merchant string, amount double, frequency string, first_seen timestamp_ntz, last_seen timestamp_ntz, status string, created_at timestamp_ntz"


def test_subscriptions(spark):
    old, new = NOW - dt.timedelta(days=90), NOW
    stored = spark.createDataFrame([sub("s1", "Netflix", 15.99, old), sub("s2", "Hulu", 9.0, old, "cancelled")], SUB)
    batch = spark.createDataFrame([(1, *sub("n1", "Netflix", 15.99, new)), (2, *sub("n2", "Netflix", 22.99, new)), (3, *sub("n3", "Hulu", 9.0, new)), (4, *sub("n4", "Hulu", 9.0, NOW + dt.timedelta(days=1)))], "seq long, " + SUB)
    got = {r["id"]: (r["last_seen"], r["status"]) for r in S.upsert_subscriptions(stored, batch).collect()}
    assert got == {"s1": (new, "active"), "s2": (old, "cancelled"), "n2": (new, "active"), "n3": (NOW + dt.timedelta(days=1), "active")}
    stale = S.mark_stale(stored, AS_OF)
    assert {r["id"]: r["status"] for r in stale.collect()} == {"s1": "stale", "s2": "cancelled"}
    cost = S.subscription_cost(S.upsert_subscriptions(stored, batch)).first()
    assert (cost["monthly_cost"], cost["annual_cost"]) == (47.98, 575.76)


def test_upsert_and_replace(spark, tmp_path):
    stored = spark.createDataFrame([("a", 1.0, 0), ("b", 2.0, 0)], "id string, amount double, load_seq int")
    batch = spark.createDataFrame([("b", 3.0, 1), ("b", 4.0, 2), ("c", 5.0, 1)], "id string, amount double, load_seq int")
    assert {r["id"]: r["amount"] for r in L.upsert(stored, batch).collect()} == {"a": 1.0, "b": 4.0, "c": 5.0}


def entries(spark, n=10, chain="c"):
    rows = [(chain, i, f"id{i}", f"2025-02-{10 + i % 18:02d}T00:00:00", "email_processed" if i % 2 else "categorize", "tool", f"d{i}", 1, i % 2, "CRITICAL" if i % 2 else "INFO") for i in range(n)]
    return spark.createDataFrame(rows, "chain_id string, seq long, id string, timestamp string, action string, tool_used string, details string, redactions_applied int, security_flags int, level string")


def test_chain_detects_tampering(spark):
    log = AU.append_chain(entries(spark))
    first = log.where("seq = 0").first()
    assert first["previous_hash"] == "GENESIS"
    assert AU.verify_chain(log).first()["is_valid"] and AU.verify_chain(log.limit(0)).first()["is_valid"]
    changed = log.withColumn("details", F.when(F.col("seq") == 5, "other").otherwise(F.col("details")))
    assert not AU.verify_chain(changed).first()["is_valid"]
    assert [r["seq"] for r in AU.broken_rows(changed).collect()] == [5]
    assert [r["seq"] for r in AU.broken_rows(log.where("seq <> 5")).collect()] == [6]
    assert AU.chain_root(log).first() == AU.chain_root(AU.append_chain(entries(spark))).first()
    assert AU.chain_root(log).first() != AU.chain_root(AU.append_chain(entries(spark, 11))).first()


def test_chain_hash_is_the_plain_formula(spark):
    import hashlib

    log = AU.append_chain(entries(spark, 3)).orderBy("seq").collect()
    previous = "GENESIS"
    for r in log:
        text = "|".join([previous, r["id"], r["timestamp"], r["action"], r["tool_used"], r["details"], str(r["redactions_applied"]), str(r["security_flags"]), r["level"]])
        previous = hashlib.sha256(text.encode()).hexdigest()
        assert r["entry_hash"] == previous


def test_chain_goes_on_after_stored_head(spark):
    both = AU.append_chain(entries(spark, 10))
    head = AU.append_chain(entries(spark, 6))
    tail = AU.append_chain(entries(spark, 10).where("seq >= 6"), head)
    assert sorted(map(str, head.unionByName(tail).collect())) == sorted(map(str, both.collect()))


def test_audit_report(spark):
    row = AU.audit_report(AU.append_chain(entries(spark, 10)), "2025-02-21 00:00:00", 30).first()
    assert (row["total_actions"], row["emails_processed"], row["security_events"], row["total_redactions"]) == (10, 5, 5, 10)
    assert row["chain_integrity"] and row["actions_breakdown"] == {"categorize": 5, "email_processed": 5}


@pytest.mark.parametrize("seed,spread", [(1, 0.03), (2, 0.011), (3, 0.2)])
def test_dense_undated_amounts_against_brute_force(spark, seed, spread):
    rnd = random.Random(seed)
    rows = [("Hot", 10 + rnd.random() * spread, "x", None if rnd.random() < 0.5 else NOW + dt.timedelta(hours=rnd.randrange(0, 2000))) for _ in range(900)]
    df = spark.createDataFrame([(i, str(i), m, a, c, t) for i, (m, a, c, t) in enumerate(rows)], SCHEMA)
    assert {r["seq"]: r["dup_seq"] for r in D.first_later_matches(df).collect()} == brute_force(rows)


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    names = {re.sub(r"#\d+L?", "", line.split("Exchange", 1)[1].split("[plan_id")[0]) for line in plan.splitlines() if "Exchange hashpartitioning" in line}
    return len(names)


def test_duplicates_take_few_shuffles(spark):
    t = txn(spark, [("Hot", 1.0, "x", 1)])
    assert exchanges(D._sweep(D._prepared(t))) + exchanges(D.duplicates(t)) <= 10


def test_a_merchant_day_is_cut_into_many_blocks(spark):
    days = spark.range(300_000).selectExpr("id AS seq", "timestamp_ntz'2025-01-01' AS date")
    noon = spark.range(5).selectExpr("300000 + id AS seq", "timestamp_ntz'2025-01-01 00:00:30' AS date")
    blocks = days.union(noon).withColumn("b", A.date_blocks("MINUTE", F.col("date"), F.col("seq")))
    counts = blocks.groupBy("b").count().orderBy("b").collect()
    assert len(counts) == 6 and max(r["count"] for r in counts) <= A.TIED_ROWS and counts[-1]["count"] == 5


def test_the_sweep_of_duplicates_keeps_matches_only(spark):
    rows = [(k, str(k), "Shop", 1.0 + k % 40 / 100, None if k % 5 == 0 else f"2024-01-0{1 + k % 3} 00:00:00") for k in range(400)]
    txn = spark.createDataFrame(rows, "seq long, id string, merchant string, amount double, date string").withColumn("date", F.col("date").cast("timestamp_ntz"))
    met = D._sweep(D._prepared(txn))
    assert met.where("not ahead and abs(i.amount - j.amount) > 0.01").count() == 0 < met.count()
    # A row travels once: the point is made of it behind the shuffle.
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and plan.index("AS _point#") < plan.index("RepartitionByExpression")
