"""Injection scan and the rows that follow from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import injection as I
from ..functions.text import folded
from .anomalies import anomaly_rows
from .shaping import computed_once


def injection_scan(df: DataFrame, column: str) -> DataFrame:
    """Adds ``patterns_found``, ``is_suspicious`` and ``risk_level``."""
    low = df.withColumn("_low", folded(F.col(column)))
    found = computed_once(low, df.columns, {"patterns_found": I.patterns_found(F.col(column), F.col("_low"))})
    return found.withColumn("is_suspicious", F.size("patterns_found") > 0).withColumn(
        "risk_level", I.risk_level(F.col("patterns_found"))
    )


def security_flags(scanned: DataFrame) -> DataFrame:
    """One row per suspicious mail."""
    return scanned.where("is_suspicious").select(
        F.col("id").alias("email_id"), "subject", "risk_level", "patterns_found"
    )


def security_anomalies(flags: DataFrame, as_of: str) -> DataFrame:
    """SECURITY anomaly of every flagged mail."""
    names = F.concat(F.lit("['"), F.array_join("patterns_found", "', '"), F.lit("']"))
    return anomaly_rows(
        flags,
        kind="SECURITY",
        severity="critical",
        description=F.concat(
            F.lit("Prompt injection detected in email "), "email_id", F.lit(": patterns="), names
        ),
        ids=F.array("email_id"),
        action="Review this email manually — may be phishing",
        as_of=as_of,
    )
