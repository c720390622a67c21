"""Plan-shaping helpers shared by the operators."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def computed_once(df: DataFrame, keep: list[str], computed: dict[str, Column]) -> DataFrame:
    """``keep`` plus ``computed``, with the computed values fixed at this point of the plan.

    A filter on a long expression is otherwise pushed below the projection with
    the whole expression copied into it. A one-element ``inline`` runs inside
    whole-stage codegen, moves no data, and filters above it stay above it.
    """
    row = F.struct(*[c.alias(name) for name, c in computed.items()])
    return df.select(*keep, F.inline(F.array(row)))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash the rows over all cores when the scan has fewer splits than there are cores.

    For a small table before expensive per-row work; a table of many splits is
    left as it is read, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder that every executor can reach, below the folder that ``spark.checkpoint.dir`` names.

    Where the setting is missing, a single machine (local master) sets a temporary
    one; on a cluster that would be another folder on every executor, so it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base is None:
        if re.match(r"local(\[|$)", spark.sparkContext.master) is None:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    run = spark.sparkContext.applicationId
    return f"{base.rstrip('/')}/ledgerloom/{run}/{name}-{os.urandom(8).hex()}"


SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """``df`` written into the shared folder and read back, for rows that several branches of a plan use.

    ``free``: the shuffle files of the write go with its end.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
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


def is_small(df: DataFrame, rows: int) -> bool:
    """True when ``df`` has at most ``rows`` rows; reads no more than ``rows + 1``."""
    return df.limit(rows + 1).count() <= rows


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], spread: str, salts: int = 16, hint: str | None = None) -> DataFrame:
    """Inner equi-join that spreads every key of ``big`` over ``salts`` tasks.

    ``small`` holds few rows per key and is repeated once per salt, so one key
    with a large share of ``big`` does not end in one task. ``hint``: the join
    strategy, where Spark, which does not count the repeats, would broadcast them.
    """
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    repeated = repeated if hint is None else repeated.hint(hint)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    return salted.join(repeated, [*keys, "_salt"]).drop("_salt")


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys meet NULL keys; the keys of ``left`` are kept."""
    named = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = None
    for k in keys:
        equal = left[k].eqNullSafe(F.col(f"_r_{k}"))
        same = equal if same is None else same & equal
    return left.join(named, same, how).drop(*[f"_r_{k}" for k in keys])


def sums_before(df: DataFrame, keys: list[str], block: str, order: list[str], value: str) -> DataFrame:
    """Running sum and count of ``value`` over the earlier rows of each key.

    Adds ``sum_before`` and ``rows_before``. A key's rows are cut into blocks
    (``block`` must never decrease along ``order``): block totals are aggregated
    with map-side combine, summed over the earlier blocks, and joined to windows
    that only span one block, so a hot key is spread over many tasks.
    """
    block_keys = [*keys, block]
    exact = F.col(value).cast("decimal(20,4)")  # decimals add up alike in any order
    zero = F.lit(0).cast("decimal(30,4)")
    totals = df.groupBy(*block_keys).agg(F.sum(exact).alias("_sum"), F.count(value).alias("_rows"))
    earlier = W.partitionBy(*keys).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select(
        *block_keys,
        F.coalesce(F.sum("_sum").over(earlier), zero).alias("_base_sum"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_base_rows"),
    )
    inside = W.partitionBy(*block_keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (
        df.withColumn("_sum", F.coalesce(F.sum(exact).over(inside), zero))
        .withColumn("_rows", F.count(value).over(inside))
        .transform(lambda left: null_safe_join(left, bases, block_keys))
        .withColumn("sum_before", (F.col("_base_sum") + F.col("_sum")).cast("double"))
        .withColumn("rows_before", F.col("_base_rows") + F.col("_rows"))
        .drop("_sum", "_rows", "_base_sum", "_base_rows")
    )


def last_before(df: DataFrame, keys: list[str], seq: str, point: str, block_rows: int = 1 << 20, made: Column | None = None) -> DataFrame:
    """Latest non-NULL ``point`` with a smaller ``seq`` under the same key, as ``found``.

    ``seq`` is a unique whole number under a key, so a block ``seq div block_rows``
    never holds more than ``block_rows`` rows of a key. A row without a point in its
    own block takes the last one of the earlier blocks: each block hands its last
    point on, which is one row for each block that holds rows. Keys are not NULL.
    ``made``: the point as an expression of other columns, which is made behind the
    shuffle, so that it does not travel beside them.
    """
    block_keys = [*keys, "_block"]
    inside = W.partitionBy(*block_keys).orderBy(seq)
    blocks = df.withColumn("_block", F.floor(F.col(seq) / F.lit(block_rows)))
    if made is not None:
        blocks = blocks.repartition(*block_keys).withColumn(point, made)
    near = blocks.withColumn("_near", F.last(point, ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, -1)))
    last = near.withColumn("_more", F.lead(F.lit(True)).over(inside)).where(F.col("_more").isNull())
    ends = last.select(*[F.col(k).alias(f"_b_{k}") for k in block_keys], F.coalesce(point, "_near").alias("_end"))
    earlier = W.partitionBy(*[f"_b_{k}" for k in keys]).orderBy("_b__block").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(earlier)).where(F.col("_carried").isNotNull()).drop("_end")
    nullable = {f.name for f in df.schema if f.nullable}
    same = [F.col(k).eqNullSafe(F.col(f"_b_{k}")) if k in nullable else F.col(k) == F.col(f"_b_{k}") for k in block_keys]
    return near.join(carried, same, "left").withColumn("found", F.coalesce("_near", "_carried")).drop("_block", "_near", "_carried", *[f"_b_{k}" for k in block_keys])


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``number``: the place of each row in ``order`` (which tells all rows apart), from 0 without gaps.

    Rows before a range partition plus the place inside it; only one count for each partition is put in order.
    """
    ranged = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), name)
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    inside = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1
    placed = ranged.withColumn("_inside", inside).join(F.broadcast(starts), "_part")  # one row a partition
    return placed.withColumn("number", (F.col("_start") + F.col("_inside")).cast("bigint")).drop("_part", "_start", "_inside")
