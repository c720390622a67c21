"""Connected components of links between rows, as alternating star contractions over written tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored

HOT_KEYS = 1000  # at most so many keys can hold a thousandth of all rows


def join_hot(big: DataFrame, small: DataFrame, key: str, rows: int, count: str = "_count") -> DataFrame:
    """Inner join of ``big`` with ``small``, which has one row for each key and in ``count`` the rows that ``big`` has of it.

    Keys with a thousandth of the ``rows`` of ``big`` or more, at most ``HOT_KEYS`` of
    them, are joined where their rows are; the others are dealt out by key.
    """
    hot = F.col(count) >= max(1, rows // HOT_KEYS + 1)
    many, few = F.broadcast(small.where(hot)), small.where(~hot)
    return big.join(many, key).drop(count).unionByName(big.join(F.broadcast(small.where(hot).select(key)), key, "left_anti").join(few, key).drop(count))


def _star(links: DataFrame, rows: int, large: bool) -> DataFrame:
    """Every neighbour (large: every greater one; small: every smaller one, and the row itself) linked to the least of them."""
    sides = links.select(F.col("b").alias("u"), F.col("a").alias("v"))
    if large:
        sides = sides.unionByName(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    least = sides.groupBy("u").agg(F.min("v").alias("least"), F.count("*").alias("_count"))
    if large:
        least = least.withColumn("least", F.least("u", "least"))
    met = join_hot(sides, least, "u", rows * (2 if large else 1))
    if large:
        out = met.where("v > u").select(F.col("v").alias("b"), F.col("least").alias("a"))
    else:
        out = met.select(F.col("v").alias("b"), F.col("least").alias("a")).unionByName(least.select(F.col("u").alias("b"), F.col("least").alias("a")))
    return out.where("a < b").distinct()


def components(links: DataFrame, a: Column | str = "a", b: Column | str = "b") -> DataFrame:
    """(node, root): every node that has a link, with the least node of its component.

    Nodes may be of any type that can be ordered; null nodes and links of a node with itself are left out.
    """
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    links = stored(links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), a.isNotNull().alias("_a"), b.isNotNull().alias("_b")).where("_a and _b and a < b").select("a", "b").distinct(), "links")
    before = None
    while True:
        state = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        rows = state["n"]
        if not rows or state == before:
            break
        before = state
        links = stored(_star(stored(_star(links, rows, True), "star"), rows, False), "links")
    roots = links.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
