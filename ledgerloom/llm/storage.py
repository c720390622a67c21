"""Written intermediate tables: they cut the lineage and survive the loss of executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands in for a null id inside joins; the output keeps the null.
NO_ID = -(2**63)


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, a temporary one on a single machine and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base is None:
        if re.match(r"local(\[|$)", spark.sparkContext.master) is None:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/ledgerloom-llm-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/llm"


SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back; ``free``: the shuffle files of the write go with its end."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLES_GO, None)
    if free:
        spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        if free and before is None:
            spark.conf.unset(SHUFFLES_GO)
        elif free:
            spark.conf.set(SHUFFLES_GO, before)
    return spark.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows as the operators carry them: ``_id`` (null: ``NO_ID``), ``_key`` (64 bits of a hash of the text), ``_text``
    (null: empty) and all other columns in ``_row``, so that no name can clash.

    Rows that repeat both id and text are one document to the operators that
    compare documents; equal ids (also nulls) with different texts stay apart,
    but for equal 64-bit hashes: a chance of 3e-8 among a million rows of one id."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    row = F.struct(*rest, F.col(text_col).isNull().alias("_no_text"))
    return docs.select(row.alias("_row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64(text).alias("_key"), text.alias("_text"))


def unpacked(rows: DataFrame, columns: list[str], text_col: str, results: list[str]) -> DataFrame:
    """The carried columns with ``results`` behind them; a result takes the place of a column of its name."""
    taken = {r.lower() for r in results}
    kept = [F.col("_row")[c].alias(c) for c in columns if c != text_col and c.lower() not in taken]
    return rows.select(*kept, *results)


def row_type(rows: DataFrame) -> str:
    return rows.schema["_row"].dataType.simpleString()


def shown_id(column: str = "_id"):
    return F.when(F.col(column) != F.lit(NO_ID), F.col(column))


def windows_over(text, chars: int, windows: int = 10):
    """A text of at most ``chars`` characters whole; of a longer one as many characters, in windows spread evenly from its start to its end."""
    size = chars // windows
    at = F.sequence(F.lit(0), F.lit(windows - 1))
    cut = F.transform(at, lambda k: F.substr(text, (F.floor(k * (F.length(text) - size) / (windows - 1)) + 1).cast("int"), F.lit(size)))
    return F.when(text.isNull() | (F.length(text) <= chars), text).otherwise(F.array_join(cut, " "))
