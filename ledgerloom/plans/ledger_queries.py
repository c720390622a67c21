"""Queries over the ledger: filters, joins, aggregates, anomalies, table writes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import anomalies as A
from ..operators import audit as AU
from ..operators import duplicates as D
from ..operators import injection as I
from ..operators import ledger as L
from ..operators import subscriptions as S
from ..functions.text import money_sum
from ..operators.shaping import shared_dir
from ..sources.tables import read_table
from ..schemas import TRANSACTIONS
from ..sources import views as V
from . import oracle as O
from .mail_queries import AS_OF, LEDGER, ledger
from .registry import query

E_AS_OF = V.EVENTS_AS_OF
ORDERS_AS_OF = "2001-08-02 00:00:00"
TXN = f"WITH {V.txn_cte()}\n"
TXO = f"WITH {V.txn_orders_cte()}\n"
BOTH = f"WITH {V.txn_cte()},\n{V.txn_orders_cte()}\n"
SUBS = f"WITH {V.subscriptions_cte()}\n"
DUPS = f"WITH {V.txn_cte()},\n{O.duplicate_pairs()}\n"


def _since(days: int, as_of: str = E_AS_OF) -> str:
    return f"TIMESTAMP '{as_of}' - INTERVAL {days} DAY"


def stamp(column: str, alias: str | None = None):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(alias or column)


def _stamp_sql(column: str, alias: str | None = None) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f') AS {alias or column}"


# --- filters and sorts -----------------------------------------------------------------------


@query(
    "FLT6_transactions",
    TXN + f"SELECT id, {_stamp_sql('date')}, merchant, amount, category FROM txn WHERE date >= {_since(7)} AND category = 'purchase' AND merchant ILIKE '%user_1%'",
)
def _(spark, sf_dir):
    out = L.transactions(V.txn(spark, sf_dir), E_AS_OF, 7, category="purchase", merchant="USER_1")
    return out.select("id", stamp("date"), "merchant", "amount", "category")


@query("FLT7_transaction_by_id", TXN + f"SELECT id, {_stamp_sql('date')}, merchant, amount FROM txn WHERE id = '77'")
def _(spark, sf_dir):
    return L.transaction_by_id(V.txn(spark, sf_dir), "77").select("id", stamp("date"), "merchant", "amount")


@query("FLT8_active_subscriptions", SUBS + f"SELECT id, merchant, amount, {_stamp_sql('last_seen')} FROM subs WHERE status = 'active'")
def _(spark, sf_dir):
    return S.active_subscriptions(V.subscriptions(spark, sf_dir)).select("id", "merchant", "amount", stamp("last_seen"))


_STALE = f"status = 'active' AND last_seen < {_since(20)}"


@query("FLT9_stale_subscriptions", SUBS + f"SELECT id, merchant, amount, {_stamp_sql('last_seen')} FROM subs WHERE {_STALE}")
def _(spark, sf_dir):
    return S.stale_subscriptions(V.subscriptions(spark, sf_dir), E_AS_OF, 20).select("id", "merchant", "amount", stamp("last_seen"))


@query("FLT9_mark_stale", SUBS + f"SELECT id, CASE WHEN {_STALE} THEN 'stale' ELSE status END AS status FROM subs")
def _(spark, sf_dir):
    return S.mark_stale(V.subscriptions(spark, sf_dir), E_AS_OF, 20).select("id", "status")


LARGE_ANOMALIES = "large AS (SELECT sha256(concat('LARGE|', id)) AS id, id AS transaction_ids, id AS tx, amount % 2 < 1 AS resolved, date AS created_at FROM txo WHERE amount > 400000)"


def large_anomalies(spark, sf_dir):
    """Stored anomalies: very large orders, some of them resolved."""
    big = A.large(V.txn_orders(spark, sf_dir), 400_000.0)
    rows = A.anomaly_rows(
        big.withColumn("flag", F.col("amount") % 2 < 1), kind="LARGE", severity="high", description=F.col("merchant"),
        ids=F.array("id"), action="Verify transaction was authorized", as_of=ORDERS_AS_OF,
    )
    state = big.select(
        F.sha2(F.concat_ws("|", F.lit("LARGE"), "id"), 256).alias("id"), (F.col("amount") % 2 < 1).alias("resolved"), F.col("date").alias("created_at")
    )
    return rows.drop("resolved", "created_at").join(state, "id").select(A.COLUMNS)


@query("FLT10_unresolved_anomalies", TXO.rstrip() + f",\n{LARGE_ANOMALIES}\nSELECT id, transaction_ids, {_stamp_sql('created_at')} FROM large WHERE NOT resolved")
def _(spark, sf_dir):
    out = L.unresolved_anomalies(large_anomalies(spark, sf_dir))
    return out.select("id", F.array_join("transaction_ids", ",").alias("transaction_ids"), stamp("created_at"))


def _chosen(spark, sf_dir):
    returned = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_returnflag = 'R'")
    return returned.select(F.sha2(F.concat(F.lit("LARGE|"), F.col("l_orderkey").cast("string")), 256).alias("id"))


_CHOSEN_SQL = "tx IN (SELECT cast(l_orderkey as varchar) FROM lineitem WHERE l_returnflag = 'R')"


@query("FLT11_resolve_anomaly", TXO.rstrip() + f",\n{LARGE_ANOMALIES}\nSELECT id, resolved OR {_CHOSEN_SQL} AS resolved FROM large")
def _(spark, sf_dir):
    return L.resolve_anomalies(large_anomalies(spark, sf_dir), _chosen(spark, sf_dir)).select("id", "resolved")


@query("FLT11_resolved_hits", TXO.rstrip() + f",\n{LARGE_ANOMALIES}\nSELECT count(*) AS hits FROM large WHERE {_CHOSEN_SQL}")
def _(spark, sf_dir):
    return L.resolved_hits(large_anomalies(spark, sf_dir), _chosen(spark, sf_dir))


@query("SRT1_newest_first", TXN + f"SELECT id, {_stamp_sql('date')}, amount FROM txn WHERE date >= {_since(3)} ORDER BY date DESC, id")
def _(spark, sf_dir):
    return L.transactions(V.txn(spark, sf_dir), E_AS_OF, 3).select("id", stamp("date"), "amount")


@query("SRT2_by_merchant", SUBS + "SELECT merchant, amount, id FROM subs WHERE status = 'active' ORDER BY merchant, id")
def _(spark, sf_dir):
    return S.active_subscriptions(V.subscriptions(spark, sf_dir)).select("merchant", "amount", "id")


# --- joins -------------------------------------------------------------------------------------------


@query(
    "JN1_duplicates",
    DUPS
    + "SELECT id, dup_id, merchant, amount, concat('Possible duplicate: ', merchant, ' $', printf('%.2f', amount),"
    " CASE WHEN hours > 0 THEN printf(' (%.1fh apart)', hours) ELSE '' END) AS description FROM dups",
)
def _(spark, sf_dir):
    return D.duplicates(V.txn(spark, sf_dir)).select("id", "dup_id", "merchant", "amount", "description")


def undated(spark, sf_dir):
    """Ledger with coarse amounts, one merchant in three, and every fifth date unknown."""
    return V.txn(spark, sf_dir).selectExpr(
        "seq", "id", "merchant", "floor(amount / 5) * 0.01D + 1 AS amount", "CASE WHEN seq % 5 = 0 THEN NULL ELSE date END AS date"
    )


_UNDATED = (
    f"WITH {V.txn_cte()},\ncoarse AS (SELECT seq, id, merchant, floor(amount / 5) * 0.01::DOUBLE + 1 AS amount,"
    f" CASE WHEN seq % 5 = 0 THEN NULL ELSE date END AS date FROM txn),\n{O.duplicate_pairs('coarse')}\n"
)


@query("JN1_duplicates_unknown_dates", _UNDATED + "SELECT id, dup_id, merchant, amount FROM dups")
def _(spark, sf_dir):
    return D.duplicates(undated(spark, sf_dir)).select("id", "dup_id", "merchant", "amount")


@query(
    "JN2_same_day_duplicates",
    BOTH
    + ", days AS (SELECT merchant, floor(amount / 50) * 50 AS amount, cast(date as date) AS d, seq, id FROM txn)\n"
    "SELECT merchant, amount, strftime(d, '%Y-%m-%d') AS day, count(*) AS n, arg_min(id, seq) AS first_id, count(*) * (count(*) - 1) // 2 AS pairs FROM days GROUP BY merchant, amount, d HAVING count(*) > 1",
)
def _(spark, sf_dir):
    rows = V.txn(spark, sf_dir).withColumn("amount", (F.floor(F.col("amount") / 50) * 50).cast("double"))
    return D.same_day_duplicates(rows).select(
        "merchant", "amount", F.date_format("day", "yyyy-MM-dd").alias("day"), "n", "first_id", "pairs"
    )


@query(
    "JN2_same_day_members",
    BOTH
    + ", days AS (SELECT merchant, floor(amount / 50) * 50 AS amount, cast(date as date) AS d, seq, id FROM txn),"
    " firsts AS (SELECT *, first_value(id) OVER (PARTITION BY merchant, amount, d ORDER BY seq) AS first_id FROM days)\n"
    "SELECT first_id, id, merchant, amount FROM firsts WHERE id <> first_id",
)
def _(spark, sf_dir):
    rows = V.txn(spark, sf_dir).withColumn("amount", (F.floor(F.col("amount") / 50) * 50).cast("double"))
    return D.same_day_members(rows).select("first_id", "id", "merchant", "amount")


@query(
    "JN6_anomaly_transactions",
    DUPS
    + "SELECT sha256(concat('DUPLICATE|', dups.id, ',', dup_id)) AS anomaly_id, t.id, t.merchant, t.amount FROM dups JOIN txn t ON t.id IN (dups.id, dups.dup_id)",
)
def _(spark, sf_dir):
    txn = V.txn(spark, sf_dir)
    rows = A.anomaly_rows(
        D.duplicates(txn), kind="DUPLICATE", severity="medium", description=F.col("description"), ids=F.array("id", "dup_id"),
        action="Review for duplicate charges", as_of=E_AS_OF,
    )
    return D.anomaly_transactions(rows, txn).select("anomaly_id", "id", "merchant", "amount")


# --- aggregates ------------------------------------------------------------------------------------------


@query("AGG1_spending_by_category", TXN + f"SELECT category, round(sum(amount), 2) AS total FROM txn WHERE date >= {_since(30)} GROUP BY category")
def _(spark, sf_dir):
    return L.spending_by_category(V.txn(spark, sf_dir), E_AS_OF)


@query("AGG1_spending_from_mail", LEDGER + "SELECT category, round(sum(amount), 2) AS total, count(*) AS n FROM ledger GROUP BY category")
def _(spark, sf_dir):
    return ledger(spark, sf_dir).groupBy("category").agg(F.round(money_sum(F.col("amount")), 2).alias("total"), F.count("*").alias("n"))


_SHARES = (
    f"totals AS (SELECT category, round(sum(amount), 2) AS total FROM txn WHERE date >= {_since(30)} GROUP BY category),\n"
    "shares AS (SELECT category, total, total / sum(total) OVER () * 100 AS p FROM totals)\n"
)


@query("AGG2_category_share", TXN.rstrip() + ",\n" + _SHARES + "SELECT category, total, round(p, 1) AS percent, cast(floor(p / 3.33::DOUBLE) as int) AS bar FROM shares")
def _(spark, sf_dir):
    return L.category_share(L.spending_by_category(V.txn(spark, sf_dir), E_AS_OF))


@query(
    "AGG3_spending_trend",
    TXN
    + f"SELECT w AS week, strftime(TIMESTAMP '{E_AS_OF}' - (w + 1) * INTERVAL 7 DAY, '%Y-%m-%d') AS week_start,"
    f" strftime(TIMESTAMP '{E_AS_OF}' - w * INTERVAL 7 DAY, '%Y-%m-%d') AS week_end, count(id) AS transaction_count, round(coalesce(sum(amount), 0), 2) AS total_spent"
    f" FROM range(6) r(w) LEFT JOIN txn ON date >= TIMESTAMP '{E_AS_OF}' - (w + 1) * INTERVAL 7 DAY AND date < TIMESTAMP '{E_AS_OF}' - w * INTERVAL 7 DAY GROUP BY w",
)
def _(spark, sf_dir):
    return L.spending_trend(V.txn(spark, sf_dir), E_AS_OF, weeks=6)


_HISTORY = "count(*) AS count, round(coalesce(sum(amount), 0), 2) AS total, round(coalesce(cast(sum(cast(amount as decimal(20,4))) as double) / count(*), 0), 2) AS average, strftime(max(date), '%Y-%m-%d %H:%M:%S.%f') AS last_seen"


def _history(df):
    return df.withColumn("last_seen", stamp("last_seen"))


@query("AGG4_merchant_history", TXN + f"SELECT 'User_12' AS merchant, {_HISTORY} FROM txn WHERE merchant ILIKE '%User_12%'")
def _(spark, sf_dir):
    return _history(L.merchant_history(V.txn(spark, sf_dir), "User_12"))


@query("AGG5_merchant_history_all", TXN + f"SELECT merchant, {_HISTORY} FROM txn GROUP BY merchant")
def _(spark, sf_dir):
    return _history(L.merchant_history_all(V.txn(spark, sf_dir)))


_STATS = (
    f"WITH {V.txn_cte()},\n{V.subscriptions_cte()},\n{V.txn_orders_cte()},\n{LARGE_ANOMALIES}\n"
    "SELECT 'transactions' AS table_name, count(*) AS n_rows FROM txn UNION ALL SELECT 'subscriptions', count(*) FROM subs"
    " UNION ALL SELECT 'anomalies', count(*) FROM large UNION ALL SELECT 'audit_log', count(*) FROM events"
)


def ledger_tables(spark, sf_dir):
    return {
        "transactions": V.txn(spark, sf_dir),
        "subscriptions": V.subscriptions(spark, sf_dir),
        "anomalies": large_anomalies(spark, sf_dir),
        "audit_log": V.audit_events(spark, sf_dir),
    }


@query("AGG6_table_stats", _STATS)
def _(spark, sf_dir):
    return L.table_stats(ledger_tables(spark, sf_dir))


@query(
    "AGG12_period_change",
    TXN
    + f", p AS (SELECT coalesce(sum(CASE WHEN date >= {_since(10)} THEN amount END), 0) AS n, coalesce(sum(CASE WHEN date < {_since(10)} THEN amount END), 0) AS b"
    f" FROM txn WHERE date >= {_since(20)} AND date < TIMESTAMP '{E_AS_OF}')\n"
    "SELECT round(n, 2) AS current_total, round(b, 2) AS previous_total, round(n - b, 2) AS change, CASE WHEN b > 0 THEN round((n - b) / b * 100, 1) ELSE 0 END AS change_pct FROM p",
)
def _(spark, sf_dir):
    return L.period_change(V.txn(spark, sf_dir), E_AS_OF, 10)


@query(
    "AGG13_subscription_cost",
    SUBS
    + "SELECT count(*) AS n_active, round(sum(CASE WHEN frequency = 'monthly' THEN amount ELSE 0 END), 2) AS monthly_cost,"
    " round(sum(CASE WHEN frequency = 'monthly' THEN amount ELSE 0 END) * 12, 2) AS annual_cost FROM subs WHERE status = 'active'",
)
def _(spark, sf_dir):
    return S.subscription_cost(V.subscriptions(spark, sf_dir))


# --- anomalies ---------------------------------------------------------------------------------------------


def _spike_cte(source: str) -> str:
    return (
        f"hist AS (SELECT *, cast(sum(cast(amount as decimal(20,4))) OVER w as double) AS sum_before, count(*) OVER w AS rows_before FROM {source}"
        " WINDOW w AS (PARTITION BY merchant ORDER BY date, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),\n"
        "spikes AS (SELECT * FROM hist WHERE rows_before > 0 AND amount > 3 * (sum_before / rows_before))"
    )


@query("ANO1_spike", TXN.rstrip() + f",\n{_spike_cte('txn')}\nSELECT id, merchant, amount, round(sum_before, 2) AS sum_before, rows_before FROM spikes")
def _(spark, sf_dir):
    return A.spikes(V.txn(spark, sf_dir)).select("id", "merchant", "amount", F.round("sum_before", 2).alias("sum_before"), "rows_before")


_NEW = "news AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY merchant ORDER BY date, seq) AS rn FROM {0}) WHERE rn = 1)"


@query("ANO2_new_merchant", TXO.rstrip() + f",\n{_NEW.format('txo')}\nSELECT id, merchant, amount, {_stamp_sql('date')} FROM news")
def _(spark, sf_dir):
    return A.new_merchants(V.txn_orders(spark, sf_dir)).select("id", "merchant", "amount", stamp("date"))


_BUSY = (
    "daily AS (SELECT merchant, cast(date as date) AS d, count(*) AS n FROM {0} GROUP BY 1, 2),\n"
    "busy AS (SELECT * FROM (SELECT *, avg(n) OVER (PARTITION BY merchant) AS m, stddev_pop(n) OVER (PARTITION BY merchant) AS sd FROM daily) WHERE n > m + {1} * sd)"
)


@query("ANO3_frequency", TXN.rstrip() + f",\n{_BUSY.format('txn', 2)}\nSELECT merchant, strftime(d, '%Y-%m-%d') AS day, n, round(m, 6) AS mean, round(sd, 6) AS sd FROM busy")
def _(spark, sf_dir):
    return A.busy_days(V.txn(spark, sf_dir), deviations=2.0).select(
        "merchant", F.date_format("day", "yyyy-MM-dd").alias("day"), "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd")
    )


def _cat_spike(source: str, as_of: str, days: int, factor: float) -> str:
    return (
        f"per AS (SELECT category, (date_diff('microsecond', date, TIMESTAMP '{as_of}') - 1) // {days * 86_400_000_000} AS periods_back, cast(sum(cast(amount as decimal(20,4))) as double) AS total"
        f" FROM {source} WHERE date < TIMESTAMP '{as_of}' GROUP BY 1, 2),\n"
        "cat AS (SELECT * FROM (SELECT *, cast(sum(cast(total as decimal(24,4))) OVER w as double) / count(*) OVER w AS mean_before FROM per WINDOW w AS (PARTITION BY category ORDER BY periods_back DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"
        f" WHERE total > {factor} * mean_before)"
    )


@query(
    "ANO4_category_spike",
    TXO.rstrip() + f",\n{_cat_spike('txo', ORDERS_AS_OF, 30, 1.1)}\nSELECT category, periods_back, round(total, 2) AS total, floor(mean_before * 100 + 0.5) AS mean_cents FROM cat",
)
def _(spark, sf_dir):
    return A.category_spikes(V.txn_orders(spark, sf_dir), ORDERS_AS_OF, 30, 1.1).select(
        "category", "periods_back", F.round("total", 2).alias("total"), F.floor(F.col("mean_before") * 100 + 0.5).cast("double").alias("mean_cents")
    )


@query("ANO5_large", TXO + "SELECT id, merchant, amount FROM txo WHERE amount > 1000")
def _(spark, sf_dir):
    return A.large(V.txn_orders(spark, sf_dir)).select("id", "merchant", "amount")


def _anomaly_parts(source: str, as_of: str) -> str:
    row = "SELECT sha256(concat('{k}|', {ids})) AS id, '{k}' AS type, '{s}' AS severity, {ids} AS transaction_ids FROM {t}"
    parts = [
        row.format(k="DUPLICATE", s="medium", ids="concat(id, ',', dup_id)", t="dups"),
        row.format(k="SPIKE", s="medium", ids="id", t="spikes"),
        row.format(k="NEW_MERCHANT", s="low", ids="id", t="news"),
        row.format(k="FREQUENCY", s="medium", ids="concat(merchant, '@', strftime(d, '%Y-%m-%d'))", t="busy"),
        row.format(k="CATEGORY_SPIKE", s="medium", ids="concat(category, '@', cast(periods_back as varchar))", t="cat"),
        row.format(k="LARGE", s="high", ids="id", t=f"(SELECT * FROM {source} WHERE amount > 1000)"),
    ]
    ctes = [O.duplicate_pairs(source), _spike_cte(source), _NEW.format(source), _BUSY.format(source, 3), _cat_spike(source, as_of, 7, 2)]
    return ",\n".join(ctes) + ",\nanomalies AS (" + "\nUNION ALL ".join(parts) + ")\n"


ANOMALIES = TXN.rstrip() + ",\n" + _anomaly_parts("txn", E_AS_OF)


def _anomaly_table(spark, sf_dir):
    txn = V.txn(spark, sf_dir)
    return A.anomaly_table(txn, D.duplicates(txn), E_AS_OF), txn


@query("ANO6_anomaly_table", ANOMALIES + "SELECT * FROM anomalies")
def _(spark, sf_dir):
    table, _ = _anomaly_table(spark, sf_dir)
    return table.select("id", "type", "severity", F.array_join("transaction_ids", ",").alias("transaction_ids"))


@query(
    "ANO6_summary_line",
    ANOMALIES + "SELECT concat('Found ', (SELECT count(*) FROM anomalies), ' potential anomalies in ', (SELECT count(*) FROM txn), ' transactions') AS summary",
)
def _(spark, sf_dir):
    return A.anomaly_summary(*_anomaly_table(spark, sf_dir))


@query(
    "SET1_anomaly_union",
    ANOMALIES.rstrip()
    + f",\n{V.mail_cte()},\nfound AS (SELECT id, {O.patterns_found('body')} AS f FROM mail),\n"
    "every AS (SELECT type FROM anomalies UNION ALL SELECT 'SECURITY' FROM found WHERE len(f) > 0)\nSELECT type, count(*) AS n FROM every GROUP BY type",
)
def _(spark, sf_dir):
    txn = V.txn(spark, sf_dir)
    flags = I.security_flags(I.injection_scan(V.mail(spark, sf_dir), "body"))
    table = A.anomaly_table(txn, D.duplicates(txn), E_AS_OF, I.security_anomalies(flags, AS_OF))
    return table.groupBy("type").agg(F.count("*").alias("n"))


# --- table writes ---------------------------------------------------------------------------------------------


_REVISED = "batch AS (SELECT cast(l_orderkey as varchar) AS id, cast(sum(cast(l_extendedprice as decimal(12,2))) as double) AS amount FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey)"


def revised_orders(spark, sf_dir):
    """Batch of corrected amounts: prices of returned items summed per order."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_returnflag = 'R'")
    amount = F.sum(F.col("l_extendedprice").cast("decimal(12,2)")).cast("double")
    return items.groupBy("l_orderkey").agg(amount.alias("amount")).select(
        F.col("l_orderkey").cast("string").alias("id"), "amount", F.lit(1).alias("load_seq")
    )


@query("SNK1_upsert_transactions", TXO.rstrip() + f",\n{_REVISED}\nSELECT id, coalesce(b.amount, t.amount) AS amount FROM txo t FULL JOIN batch b USING (id)")
def _(spark, sf_dir):
    stored = V.txn_orders(spark, sf_dir).select("id", "amount", F.lit(0).alias("load_seq"))
    return L.upsert(stored, revised_orders(spark, sf_dir)).select("id", "amount")


@query("SNK2_replace_transactions", TXN + f"SELECT 0 AS first_old, (SELECT count(*) FROM txn) AS second_old, count(*) AS n_rows, round(sum(amount), 2) AS total FROM txn WHERE date >= {_since(7)}")
def _(spark, sf_dir):
    path = shared_dir(spark, "replace") + "/transactions"
    txn = V.txn(spark, sf_dir)
    first = L.replace_transactions(spark, txn, path)
    second = L.replace_transactions(spark, L.transactions(txn, E_AS_OF, 7), path)
    table = read_table(spark, path, TRANSACTIONS)
    return table.agg(F.count("*").alias("n_rows"), F.round(money_sum(F.col("amount")), 2).alias("total")).select(
        F.lit(first).alias("first_old"), F.lit(second).alias("second_old"), "n_rows", "total"
    )


_UPSERT = (
    ", fresh AS (SELECT merchant, amount, arg_min(id, seq) AS id, arg_min(frequency, seq) AS frequency, arg_min(first_seen, seq) AS first_seen, arg_max(last_seen, seq) AS seen FROM sub_batch GROUP BY 1, 2),\n"
    "act AS (SELECT merchant, amount, min(id) AS id FROM subs WHERE status = 'active' GROUP BY 1, 2)\n"
    "SELECT s.id, s.merchant, s.amount, s.frequency, {0}, {1}, s.status FROM subs s LEFT JOIN act USING (id) LEFT JOIN fresh f ON act.merchant = f.merchant AND act.amount = f.amount\n"
    "UNION ALL SELECT f.id, f.merchant, f.amount, f.frequency, {2}, {3}, 'active' FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM act WHERE act.merchant = f.merchant AND act.amount = f.amount)"
).format(
    _stamp_sql("s.first_seen", "first_seen"), _stamp_sql("coalesce(f.seen, s.last_seen)", "last_seen"),
    _stamp_sql("f.first_seen", "first_seen"), _stamp_sql("f.seen", "last_seen"),
)


@query("SNK3_upsert_subscriptions", SUBS + _UPSERT)
def _(spark, sf_dir):
    out = S.upsert_subscriptions(V.subscriptions(spark, sf_dir), V.subscription_batch(spark, sf_dir))
    return out.select("id", "merchant", "amount", "frequency", stamp("first_seen"), stamp("last_seen"), "status")


@query("JN5_subscription_match", SUBS + "SELECT s.id, count(*) AS sightings FROM subs s JOIN sub_batch b ON s.merchant = b.merchant AND s.amount = b.amount WHERE s.status = 'active' GROUP BY s.id")
def _(spark, sf_dir):
    stored = S.active_subscriptions(V.subscriptions(spark, sf_dir)).select("id", "merchant", "amount")
    seen = V.subscription_batch(spark, sf_dir).groupBy("merchant", "amount").agg(F.count("*").alias("sightings"))
    return stored.join(seen, ["merchant", "amount"]).select("id", "sightings")


@query(
    "SNK4_upsert_anomalies",
    TXO.rstrip() + f",\n{LARGE_ANOMALIES}\nSELECT id, concat('[\"', tx, '\"]') AS transaction_ids, resolved OR {_CHOSEN_SQL} AS resolved FROM large",
)
def _(spark, sf_dir):
    stored = large_anomalies(spark, sf_dir)
    changed = stored.join(_chosen(spark, sf_dir).distinct(), "id", "left_semi").withColumn("resolved", F.lit(True))
    out = L.upsert(stored.withColumn("load_seq", F.lit(0)), changed.withColumn("load_seq", F.lit(1)))
    return out.select("id", F.to_json("transaction_ids").alias("transaction_ids"), "resolved")


@query("SNK7_export_import", TXN + f"SELECT id, {_stamp_sql('date')}, merchant, amount, category, is_subscription, source_email_id, confidence, {_stamp_sql('created_at')} FROM txn")
def _(spark, sf_dir):
    folder = shared_dir(spark, "export")
    L.export_ledger({"transactions": V.txn(spark, sf_dir)}, folder)
    back = L.from_json_lines(spark.read.text(f"{folder}/transactions"), TRANSACTIONS)
    return back.withColumn("date", stamp("date")).withColumn("created_at", stamp("created_at"))


@query(
    "SNK7_four_tables",
    f"WITH {V.txn_cte()},\n{V.subscriptions_cte()},\n{V.txn_orders_cte()},\n{V.audit_events_cte()},\n{LARGE_ANOMALIES}\n"
    "SELECT 'transactions' AS table_name, id, concat_ws('|', merchant, category, source_email_id, cast(is_subscription as varchar)) AS fields FROM txn"
    " UNION ALL SELECT 'subscriptions', id, concat_ws('|', merchant, frequency, status) FROM subs"
    " UNION ALL SELECT 'anomalies', id, concat_ws('|', tx, cast(resolved as varchar)) FROM large"
    " UNION ALL SELECT 'audit_log', id, concat_ws('|', chain_id, cast(seq as varchar), action, details) FROM audit_events",
)
def _(spark, sf_dir):
    """The whole ledger out to JSON lines and back; the audit chain that comes back still verifies."""
    folder = shared_dir(spark, "export-all")
    tables = ledger_tables(spark, sf_dir) | {"audit_log": AU.append_chain(V.audit_events(spark, sf_dir))}
    subs = tables["subscriptions"]
    tables["subscriptions"] = subs if "created_at" in subs.columns else subs.withColumn("created_at", F.col("first_seen"))
    L.export_ledger(tables, folder)
    back = L.import_ledger(spark, folder)
    fields = {
        "transactions": ["merchant", "category", "source_email_id", F.col("is_subscription").cast("string")],
        "subscriptions": ["merchant", "frequency", "status"],
        "anomalies": [F.array_join("transaction_ids", ","), F.col("resolved").cast("string")],
        "audit_log": ["chain_id", F.col("seq").cast("string"), "action", "details"],
    }
    parts = [back[name].select(F.lit(name).alias("table_name"), "id", F.concat_ws("|", *columns).alias("fields")) for name, columns in fields.items()]
    valid = AU.verify_chain(back["audit_log"]).where("is_valid").select("is_valid")
    return reduce(DataFrame.unionByName, parts).join(F.broadcast(valid), F.lit(True) == F.col("is_valid")).drop("is_valid")  # one row
