"""Mail selection and reports over the mail table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import extract as E
from ..functions import mime as M
from ..functions.text import contains_any, text_or_empty
from ..rules import extraction as R
from ..schemas import HEADERS, mime_payload

MIME_DEPTH = 2  # levels of nested parts that are parsed with one schema; deeper payloads are walked part by part


def recent_mail(mail: DataFrame, as_of: str, days: int) -> DataFrame:
    """Mail newer than ``days`` days; a date that cannot be read counts as ``as_of``."""
    sent = E.header_date(F.col("date"), F.lit(as_of))
    return mail.where(F.try_to_date(sent, "yyyy-MM-dd") >= F.date_sub(F.lit(as_of).cast("date"), days))


def financial_mail(
    mail: DataFrame,
    as_of: str,
    days: int = 30,
    custom_senders: tuple[str, ...] = (),
    max_results: int | None = None,
) -> DataFrame:
    """Mail of a financial sender or with a financial subject, newer than ``days`` days.

    ``custom_senders`` are domains ('*@shop.example' or 'shop.example'). With
    ``max_results`` only the newest are returned.
    """
    domains = (*R.FINANCIAL_DOMAINS, *(s.rsplit("@", 1)[-1].lower() for s in custom_senders))
    domain = F.substring_index(F.lower(text_or_empty(F.col("sender_email"))), "@", -1)
    subject = F.lower(text_or_empty(F.col("subject")))
    sent = E.header_date(F.col("date"), F.lit(as_of))
    out = recent_mail(mail.where(domain.isin(*domains) | contains_any(subject, R.FINANCIAL_SUBJECTS)), as_of, days)
    return out if max_results is None else out.orderBy(sent.desc(), "id").limit(max_results)


def mail_with_body(meta: DataFrame, body: DataFrame) -> DataFrame:
    """Metadata joined with bodies; an id without a body drops out."""
    return meta.join(body.select("id", "body"), "id")


def mail_from_raw(raw: DataFrame, depth: int = MIME_DEPTH, max_chars: int | None = None) -> DataFrame:
    """Raw messages (id, headers and payload as JSON text) to the mail table.

    Parts may nest to any depth. A payload with at most ``depth`` lists of parts is
    parsed at once, any other one with a stack; the text is the same.
    """
    lists = (F.length("payload") - F.length(F.replace("payload", F.lit('"parts"'), F.lit("")))) / F.lit(len('"parts"'))
    shallow = M.mime_text(F.from_json("payload", mime_payload(depth)), depth, max_chars)
    text = F.when(lists <= depth, shallow).otherwise(F.coalesce(M.mime_text_of_json(F.col("payload"), max_chars), F.lit("")))
    parsed = raw.select("id", F.from_json("headers", HEADERS).alias("headers"), text.alias("body"))
    source = M.parse_from(M.header(F.col("headers"), "From"))
    return parsed.select(
        "id",
        source["sender"].alias("sender"),
        source["sender_email"].alias("sender_email"),
        M.header(F.col("headers"), "Subject").alias("subject"),
        M.header(F.col("headers"), "Date").alias("date"),
        "body",
    )


def mail_detail(redacted: DataFrame, ids: DataFrame) -> DataFrame:
    """Chosen mails with a redaction report that never shows an original.

    ``redacted`` carries ``redaction_details`` and, where known, ``issues``; error rows keep only an error text.
    """
    chosen = redacted.join(ids.select("id").distinct(), "id", "left_semi")
    report = F.struct(
        F.col("redaction_count").alias("redaction_count"),
        F.col("is_valid").alias("is_valid"),
        F.transform(
            "redaction_details", lambda d: F.struct(d["pattern"].alias("type"), d["replacement"].alias("replacement"))
        ).alias("details"),
        *(["issues"] if "issues" in redacted.columns else []),
    )
    ok = ~F.col("redaction_error")
    note = F.concat(
        F.lit("Email "), "id", F.lit(" accessed, "), F.col("redaction_count").cast("string"), F.lit(" redactions applied")
    )
    return chosen.select(
        "id", "sender", "sender_email", "subject", "date",
        F.when(ok, F.col("clean_text")).alias("redacted_body"),
        F.when(ok, report).alias("redaction_report"),
        F.when(ok, note).alias("audit_summary"),
        F.when(~ok, F.lit("Redaction failed — content withheld for safety")).alias("error"),
    )


def pipeline_stats(staged: DataFrame, extracted: DataFrame) -> DataFrame:
    """One row of counters over all fetched mail.

    ``staged`` has one row per mail with ``reason``, ``redaction_count``,
    ``redaction_error`` and ``is_suspicious``; ``extracted`` has the ledger rows.
    """
    passed = F.col("reason") == ""
    good = passed & ~F.col("redaction_error")
    counters = staged.agg(
        F.count("*").alias("fetched"),
        F.count_if(~passed).alias("blocked"),
        F.coalesce(F.sum(F.when(good, F.col("redaction_count"))), F.lit(0)).alias("redacted"),
        F.count_if(passed & F.col("redaction_error")).alias("failed_closed"),
        F.count_if(good & F.col("is_suspicious")).alias("injections"),
    )
    rows = counters.unionByName(extracted.agg(F.count("*").alias("extracted")), allowMissingColumns=True)
    return rows.agg(*[F.first(c, ignorenulls=True).alias(c) for c in rows.columns])


def scan_report(stats: DataFrame, redactions: DataFrame, total: DataFrame, days: int, example: DataFrame | None = None) -> DataFrame:
    """One JSON text: totals, pipeline and redaction counters, query days; the transactions stay a table.

    ``example`` (before, after) is shown where it is given; its first text is not redacted.
    """
    parts = (
        total.select(F.struct("*").alias("totals"))
        .unionByName(stats.select(F.struct("*").alias("pipeline_stats")), allowMissingColumns=True)
        .unionByName(redactions.select(F.struct("*").alias("redaction_stats")), allowMissingColumns=True)
    )
    if example is not None:
        parts = parts.unionByName(example.select(F.struct("before", "after").alias("redaction_example")), allowMissingColumns=True)
    row = parts.agg(*[F.first(c, ignorenulls=True).alias(c) for c in parts.columns])
    shown = [c for c in ("redaction_example",) if c in row.columns]
    return row.select(
        F.to_json(
            F.struct(
                F.col("totals.n").alias("total_transactions"),
                F.col("totals.total").alias("total_amount"),
                "pipeline_stats",
                "redaction_stats",
                *shown,
                F.lit(days).alias("query_days"),
            )
        ).alias("report")
    )
