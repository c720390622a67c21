"""Sharding along a Hilbert curve: rows near each other in several metadata dimensions share a shard, so files can be pruned by any of them.

Each dimension is quantised to ``2**bits`` cells; the curve visits the cells of all
dimensions so that neighbours on it are neighbours in space. Rows are ordered by
their place on the curve, then by a hash of id and text, and the order is cut into
runs of equal length: shards differ by at most one row.

Places are counted in two steps, rows before a cell and rows within a part of it,
where a cell gets parts by its rows; so a cell that holds a third of all rows is
spread over tasks. Only the table of cells (at most 2**(bits * dimensions) rows)
is sent to all.

Nulls are a cell's value of their own (the lowest); texts that are null or empty
have no bytes. Rows that repeat are placed each on its own: equal texts lie in one shard
only where their cells are the same, as the law of equal counts goes first. A kept
column that is named as a result gives way to it. Empty tables give no rows.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .registry import query, table

PART_ROWS = 4096


@functools.cache
def curve_table(dims: int) -> tuple[list[int], list[int]]:
    """For state * 2**dims + cell: the cell's number in the order of the curve, and the state inside it.

    A state is the corner where the curve enters and the axis along which it leaves (Hamilton and Rau-Chaplin, 2007).
    """
    size, mask = 1 << dims, (1 << dims) - 1

    def turned(x: int, by: int) -> int:  # rotation to the left within dims bits
        by %= dims
        return (x << by | x >> (dims - by)) & mask

    def gray(i: int) -> int:
        return i ^ i >> 1

    place = {gray(i): i for i in range(size)}

    def leaving(i: int) -> int:
        odd = i if i % 2 else i - 1
        return 0 if i == 0 else (((odd + 1) & -(odd + 1)).bit_length() - 1) % dims

    number, state = [], []
    for enter in range(size):
        for axis in range(dims):
            for cell in range(size):
                at = place[turned(cell ^ enter, -(axis + 1))]
                corner = 0 if at == 0 else gray(2 * ((at - 1) // 2))
                number.append(at)
                state.append((enter ^ turned(corner, axis + 1)) * dims + (axis + leaving(at) + 1) % dims)
    return number, state


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """Place on the curve of a point whose coordinates are whole numbers below ``2**bits``."""
    dims = len(cells)
    number, state = (F.array(*[F.lit(x) for x in part]) for part in curve_table(dims))
    digits = []
    for level in range(bits - 1, -1, -1):
        digit = F.lit(0)
        for d, c in enumerate(cells):
            digit = digit.bitwiseOR(F.shiftleft(F.shiftright(c.cast("int"), level).bitwiseAND(1), d))
        digits.append(digit)

    def step(s: Column, digit: Column) -> Column:
        at = s["state"] * (1 << dims) + digit + 1
        return F.struct(F.element_at(state, at).alias("state"), (F.shiftleft(s["place"], dims).bitwiseOR(F.element_at(number, at).cast("long"))).alias("place"))

    return F.aggregate(F.array(*digits), F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("place")), step)["place"]


def ranged(value: Column, least, greatest, bits: int) -> Column:
    """Cell of a number by equal ranges."""
    if least is None or greatest == least:
        return F.lit(0)
    cell = F.floor((value.cast("double") - F.lit(float(least))) / F.lit(float(greatest) - float(least)) * ((1 << bits) - 1)) + 1
    return F.coalesce(F.least(cell, F.lit((1 << bits) - 1)), F.lit(0)).cast("int")


def magnitude(value: Column, bits: int) -> Column:
    """Cell of a size by its number of binary digits, in steps that suit ``bits``."""
    digits = F.when(value > 0, F.length(F.bin(value))).otherwise(0)
    return F.coalesce(F.least(digits, F.lit((1 << bits) - 1)), F.lit(0)).cast("int")


def named(value: Column, bits: int) -> Column:
    """Cell of a name by its hash; null is cell 0."""
    return F.when(value.isNull(), 0).otherwise(F.pmod(F.xxhash64(value), F.lit((1 << bits) - 1)) + 1).cast("int")


def hilbert_shards(rows: DataFrame, cells: dict[str, Column], order: list[str], keep: list[str], shards: int, bits: int = 4) -> DataFrame:
    """``keep``, curve (place on the curve), shard and slot (gapless from 0) of each row; ``order`` breaks ties on the curve."""
    if len(cells) * bits > 20:
        raise ValueError("at most 2**20 cells")
    spread = F.xxhash64(*order)
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row")
    placed = rows.select(row, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], hilbert_index(list(cells.values()), bits).alias("curve"), spread.alias("_h"))
    counts = placed.groupBy("curve").agg(F.count("*").alias("_n"))
    # Rows before a cell: over groups of 256 cells, then within the group.
    group = F.shiftright("curve", 8).alias("_g")
    groups = counts.groupBy(group).agg(F.sum("_n").alias("_n"))
    before = groups.select("_g", F.coalesce(F.sum("_n").over(W.orderBy("_g").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_first"), F.sum("_n").over(W.partitionBy(F.lit(0))).alias("_all"))
    inside = W.partitionBy("_g").orderBy("curve").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.withColumn("_g", group).withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(F.broadcast(before), "_g")
    starts = starts.select("curve", (F.col("_first") + F.col("_in")).alias("_start"), F.ceil(F.col("_n") / PART_ROWS).cast("long").alias("_parts"), "_all")
    placed = placed.join(F.broadcast(starts), "curve")  # a row for each cell
    part = F.floor(F.shiftrightunsigned("_h", 33) * F.col("_parts") / F.lit(2.0**31)).cast("long")
    placed = placed.withColumn("_part", part)
    parts = placed.groupBy("curve", "_part").agg(F.count("*").alias("_n"))
    earlier = W.partitionBy("curve").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("curve", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_skip"))
    number = F.row_number().over(W.partitionBy("curve", "_part").orderBy("_h", *[f"_o{i}" for i in range(len(order))])) - 1
    placed = placed.join(parts, ["curve", "_part"]).withColumn("_rank", F.col("_start") + F.col("_skip") + number)
    shard = F.floor(F.col("_rank") * shards / F.col("_all"))
    first = F.ceil(shard * F.col("_all") / shards)
    kept = [F.col("_row")[c].alias(c) for c in keep if c.lower() not in ("curve", "shard", "slot")]
    return placed.select(*kept, "curve", shard.cast("int").alias("shard"), (F.col("_rank") - first).cast("long").alias("slot"))


def document_cells(docs: DataFrame, id_col: str, text_col: str, names: list[str], bits: int = 4) -> dict[str, Column]:
    """Cells of documents: the range of the id, the magnitude of the text's bytes, and the named columns."""
    ends = docs.agg(F.min(id_col).alias("lo"), F.max(id_col).alias("hi")).first()
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0))
    return {"id": ranged(F.col(id_col), ends["lo"], ends["hi"], bits), "size": magnitude(size, bits)} | {n: named(F.col(n).cast("string"), bits) for n in names}


def write_shards(rows: DataFrame, placed: DataFrame, id_col: str, path: str) -> None:
    """Files of each shard in a folder of its own, in the order of the curve, for rows with unique ids."""
    at = placed.select(id_col, "shard", "slot")
    rows.join(at, id_col).repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


@query("op8_hilbert_shards")
def op8(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "text", "source", "lang", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    cells = document_cells(docs, "doc_id", "text", ["source", "lang"])
    out = hilbert_shards(rows, cells, ["text_crc32", "size", "doc_id"], ["doc_id", "size", "text_crc32"], shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
