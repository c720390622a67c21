"""File sources: mail JSON and blocklist configuration."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.blocklist import MAX_LITERALS, Blocklist
from ..schemas import BLOCKLIST, MAIL

logger = logging.getLogger(__name__)

KINDS = (("blocked_senders", "sender"), ("blocked_domains", "domain"), ("blocked_subject_patterns", "subject"))


def read_mail_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Mail files: one JSON array per file, or one object per line.

    Files of lines can be split between tasks; use them for large mailboxes.
    """
    return spark.read.schema(MAIL).option("multiLine", not lines).json(path)


def read_blocklist(spark: SparkSession, path: str) -> DataFrame:
    """(kind, value) rows in lower case; empty when the file is missing or bad, so nothing is blocked."""
    fields = [T.StructField(name, T.ArrayType(T.StringType())) for name, _ in KINDS]
    schema = T.StructType([*fields, T.StructField("_bad", T.StringType())])
    try:
        reader = spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "_bad")
        config = reader.json(path)
        bad = config.agg(F.count("_bad"), *[F.count(name) for name, _ in KINDS]).first()[0]
    except AnalysisException:
        bad = 1
    if bad:
        logger.warning("blocklist %s cannot be read, nothing is blocked", path)
        return spark.createDataFrame([], BLOCKLIST)

    def listed(name: str, kind: str) -> Column:
        values = F.coalesce(name, F.array().cast("array<string>"))
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), F.lower(v).alias("value")))

    entries = F.flatten(F.array(*[listed(name, kind) for name, kind in KINDS]))
    return config.select(F.inline(entries))


def blocklist_rules(table: DataFrame) -> Blocklist | DataFrame:
    """The table as plan literals when it is of configuration size, else the table itself, to be joined."""
    literal = literal_blocklist(table)
    return table if literal is None else literal


def literal_blocklist(table: DataFrame) -> Blocklist | None:
    """The table as plan literals, or None when it holds more entries than are written into a plan."""
    rows = table.limit(MAX_LITERALS + 1).collect()
    if len(rows) > MAX_LITERALS:
        return None
    return Blocklist(*(tuple(r["value"] for r in rows if r["kind"] == kind) for _, kind in KINDS))
