"""The scan: mail table in, clean mail, ledger, flags, anomalies, audit log and report out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators import auditlog as AL
from ..operators import duplicates as D
from ..operators import injection as I
from ..operators import mail as M
from ..operators.anomalies import anomaly_table
from ..operators.blocklist import Blocklist, with_reason
from ..operators.extraction import extract_transactions, ledger_rows
from ..operators.ledger import ledger_total
from ..operators.redact import redact, redaction_example, redaction_stats
from ..operators.shaping import numbered


def redacted_mail(mail: DataFrame, rules: Blocklist | DataFrame | None = None, details: bool = False) -> DataFrame:
    """Every mail with its block reason; unblocked ones redacted. Blocked mail keeps no text."""
    seen = with_reason(mail, rules).withColumn("_seen", F.when(F.col("reason") == "", F.col("body")))
    return redact(seen.drop("body"), "_seen", details=details)


def staged_mail(mail: DataFrame, rules: Blocklist | DataFrame | None = None, details: bool = False) -> DataFrame:
    """Every mail with its block reason; unblocked ones redacted and scanned.

    Blocked mail keeps no text. One pass over the mail; only a table of rules is joined.
    """
    return I.injection_scan(redacted_mail(mail, rules, details), "clean_text").drop("_seen")


def passed(staged: DataFrame) -> DataFrame:
    """Unblocked mail whose redaction did not fail."""
    return staged.where((F.col("reason") == "") & ~F.col("redaction_error"))


def details_of(mail: DataFrame, ids: DataFrame, rules: Blocklist | DataFrame | None = None) -> DataFrame:
    """Redaction reports of the chosen mails; only these are redacted."""
    chosen = mail.join(ids.select("id").distinct(), "id", "left_semi")
    return M.mail_detail(passed(staged_mail(chosen, rules, details=True)), ids)


def example_of(mail: DataFrame, good: DataFrame, rules: Blocklist | DataFrame | None = None, first: int = 64) -> DataFrame:
    """The first mail whose redaction can be shown before and after (``redaction_example``).

    ``good``: mails that passed, with ``redaction_count``. Details are made for the
    first mails with a redaction, and for eight times as many more while none of them will do.
    """
    after, number = None, first
    while True:
        rest = good.where("redaction_count > 0") if after is None else good.where((F.col("redaction_count") > 0) & (F.col("seq") > after))
        some = rest.select("seq").orderBy("seq").limit(number)
        few = mail.join(some, "seq", "left_semi")
        shown = passed(staged_mail(few, rules, details=True)).join(few.select("id", "body"), "id")
        found = redaction_example(shown)
        after = some.agg(F.max("seq")).first()[0]
        if after is None or not found.isEmpty():
            return found
        number *= 8


def scan_events(good: DataFrame, transactions: DataFrame, anomalies: DataFrame, as_of: str, days: int) -> DataFrame:
    """Audit entries of a scan, numbered from 0: its start, each mail, each transaction, each anomaly."""
    spark = good.sparkSession
    keep = ["chain_id", "timestamp", "kind", "place", "id"]

    def placed(df: DataFrame, kind: int, place: Column) -> DataFrame:
        return df.withColumns({"chain_id": F.lit("scan"), "timestamp": F.lit(as_of), "kind": F.lit(kind), "place": place.cast("bigint")})

    none = F.lit(None)
    start = placed(spark.range(1).select(F.concat(F.lit("scan "), F.lit(as_of)).alias("id")), 0, none)
    parts = [
        A.scan_start(start, keep, F.lit(days), F.lit("all")),
        A.email_processed(placed(good, 1, F.col("seq")), keep, F.col("id"), F.col("redaction_count"), F.col("is_suspicious")),
        A.categorized(placed(transactions, 2, F.col("seq")), keep, F.col("merchant"), F.col("amount"), F.col("category")),
        A.anomaly_detected(placed(anomalies, 3, none), keep, F.col("type"), F.col("severity"), F.col("description")),
    ]
    events = reduce(DataFrame.unionByName, parts)
    # The digest tells apart what agrees in all else.
    rows = events.withColumn("digest", F.xxhash64(*events.columns))
    return numbered(rows, ["kind", "place", "id", "digest"], "scan-events").withColumnRenamed("number", "seq").drop("kind", "place", "digest")


def scan(
    mail: DataFrame, as_of: str, out: str, days: int = 30, rules: Blocklist | DataFrame | None = None, financial_only: bool = False, run: int | None = None,
    example: bool = False,
) -> dict[str, DataFrame]:
    """Run every stage over the mail of the last ``days`` days and write one table per result under ``out``.

    ``financial_only`` takes only mail of financial senders or subjects.

    The clean mail is written first and everything else reads it, so the long
    regex chain runs once and a lost executor only repeats its own part. The raw
    body is stored nowhere. The audit log under ``out/audit`` goes on from scan to
    scan: ``run`` is the number of its append, by default the next one; the number of
    an append that is complete adds nothing. ``example`` puts a redaction before and
    after into the report, the one text that is shown as it came in.
    """
    spark = mail.sparkSession

    def stored(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{out}/{name}")
        return spark.read.schema(df.schema).parquet(f"{out}/{name}")

    chosen = M.financial_mail(mail, as_of, days) if financial_only else M.recent_mail(mail, as_of, days)
    staged = stored("clean_mail", staged_mail(chosen, rules))
    good = passed(staged)
    kept = ("seq",)
    transactions = stored("transactions", ledger_rows(extract_transactions(good, as_of, keep=kept), as_of, kept))
    flags = stored("security_flags", I.security_flags(good))
    found = anomaly_table(transactions, D.duplicates(transactions), as_of, I.security_anomalies(flags, as_of))
    anomalies = stored("anomalies", found)
    events = scan_events(good, transactions, anomalies, as_of, days)
    folder = f"{out}/audit"
    AL.append_log(spark, folder, events, AL.appends(spark, folder) if run is None else run, late="renumber")
    log = AL.stored_log(spark, folder).entries
    stats = M.pipeline_stats(staged, transactions)
    report = stored(
        "report",
        M.scan_report(stats, redaction_stats(good), ledger_total(transactions), days, example_of(chosen, good, rules) if example else None),
    )
    return {
        "clean_mail": staged,
        "transactions": transactions,
        "security_flags": flags,
        "anomalies": anomalies,
        "audit_log": log,
        "report": report,
    }
