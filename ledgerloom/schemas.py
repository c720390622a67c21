"""Explicit schemas of every table; nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql import types as T

MAIL = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("sender", T.StringType()),
    T.StructField("subject", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("date", T.StringType()),
])

TRANSACTIONS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("date", T.TimestampNTZType()),
    T.StructField("merchant", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("category", T.StringType()),
    T.StructField("is_subscription", T.BooleanType()),
    T.StructField("source_email_id", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

SUBSCRIPTIONS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("merchant", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("frequency", T.StringType()),
    T.StructField("first_seen", T.TimestampNTZType()),
    T.StructField("last_seen", T.TimestampNTZType()),
    T.StructField("status", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

ANOMALIES = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("transaction_ids", T.ArrayType(T.StringType())),
    T.StructField("recommended_action", T.StringType()),
    T.StructField("resolved", T.BooleanType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

AUDIT_LOG = T.StructType([
    T.StructField("chain_id", T.StringType()),
    T.StructField("segment", T.LongType()),
    T.StructField("seq", T.LongType()),
    T.StructField("id", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("tool_used", T.StringType()),
    T.StructField("details", T.StringType()),
    T.StructField("redactions_applied", T.IntegerType()),
    T.StructField("security_flags", T.IntegerType()),
    T.StructField("level", T.StringType()),
    T.StructField("entry_hash", T.StringType()),
    T.StructField("previous_hash", T.StringType()),
])

BLOCKLIST = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("value", T.StringType()),
])

HEADERS = T.ArrayType(T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("value", T.StringType()),
]))


def mime_payload(depth: int) -> T.StructType:
    """MIME part schema; Spark has no recursive type, so nesting is unrolled."""
    fields = [
        T.StructField("mimeType", T.StringType()),
        T.StructField("body", T.StructType([T.StructField("data", T.StringType())])),
    ]
    if depth > 0:
        fields.append(T.StructField("parts", T.ArrayType(mime_payload(depth - 1))))
    return T.StructType(fields)
