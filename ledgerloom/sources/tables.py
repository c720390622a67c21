"""Tables that are replaced as a whole: a new version folder first, then a pointer file."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

POINTER = "CURRENT"


def write_table(df: DataFrame, path: str) -> None:
    """Replace the table at ``path``; ``df`` may read the table itself.

    The rows go to a folder of their own, and one rename of a small file makes them
    the table. A write that fails leaves the table as it was. Old versions stay
    until ``drop_old_versions``, so that running readers can end.
    """
    version = f"version-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    fs_path = jvm.org.apache.hadoop.fs.Path
    new, pointer = fs_path(f"{path}/next-{version}"), fs_path(f"{path}/{POINTER}")
    out = new.getFileSystem(conf).create(new, True)
    out.write(bytearray(version.encode()))
    out.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.getFileSystem(conf).getUri(), conf)
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = df.sparkSession.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.valueOf("OVERWRITE")
    files.rename(files.makeQualified(new), files.makeQualified(pointer), how)


def current_version(spark: SparkSession, path: str) -> str | None:
    """Name of the folder that holds the table, ``None`` before the first write."""
    try:
        return spark.read.text(f"{path}/{POINTER}").first()["value"]
    except AnalysisException:
        return None


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table at ``path`` as of now; without rows before the first write."""
    version = current_version(spark, path)
    if version is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{version}")


def drop_old_versions(spark: SparkSession, path: str) -> int:
    """Remove every version but the current one; returns how many."""
    version = current_version(spark, path)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(conf)
    old = [f.getPath() for f in files.listStatus(root) if f.isDirectory() and f.getPath().getName().startswith("version-") and f.getPath().getName() != version]
    for folder in old:
        files.delete(folder, True)
    return len(old)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder if it is there."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a write into the folder came to its end."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)
