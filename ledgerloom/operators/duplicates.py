"""Duplicate charges without comparing every pair of a merchant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import money
from .shaping import last_before, salted_join, written

TOLERANCE = 0.01
HOURS = 24
# Two amounts of one step differ by less than the tolerance, two times of one step
# by less than the time limit: rows of one cell always match.
AMOUNT_STEP = 0.0099
MICROS = HOURS * 3_600_000_000


def micros_of(date: Column) -> Column:
    """Microseconds since 1970."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), date)


def _steps(value: Column, reach: Column, step: Column) -> Column:
    """Numbers of all steps that come within ``reach`` of ``value``."""
    return F.sequence(F.floor((value - reach) / step).cast("bigint"), F.floor((value + reach) / step).cast("bigint"))


def _here() -> Column:
    return F.struct("seq", "id", "merchant", "amount", "micros")


def _prepared(txn: DataFrame) -> DataFrame:
    """Rows that can match, with the cells of amount and time they are in and near to."""
    return (
        txn.where((F.col("merchant") != "") & F.col("amount").isNotNull())
        .select(
            F.coalesce(F.lower("merchant"), F.lit("")).alias("key"), F.col("seq").cast("bigint").alias("seq"), "id", "merchant", "amount",
            micros_of(F.col("date")).alias("micros"),
        )
        .withColumn("amount_own", F.floor(F.col("amount") / F.lit(AMOUNT_STEP)).cast("bigint"))
        .withColumn("amount_near", _steps(F.col("amount"), F.lit(TOLERANCE + 1e-6), F.lit(AMOUNT_STEP)))
        .withColumn("time_own", F.floor(F.col("micros") / F.lit(MICROS)).cast("bigint"))
        .withColumn("time_near", F.coalesce(_steps(F.col("micros"), F.lit(MICROS), F.lit(MICROS)), F.array(F.lit(0))))
    )


# A row asks in all cells it comes near to and offers itself in its own cell only. In each lane the offering rows
# of one cell match each other, so they cut the sequence into stretches: a row can only be the first later match
# of the last row offered before it.
DATED, UNDATED, NEXT = 0, 1, 2
CELL = ["key", "lane", "cell", "time"]


def _cell(lane: int, cell: Column, time: Column, offers: Column) -> Column:
    return F.struct(F.lit(lane).alias("lane"), cell.alias("cell"), time.cast("bigint").alias("time"), offers.alias("offers"))


def _dated_cells() -> Column:
    """Cells of a row with a date: amount step and 24 hours."""
    own = lambda a, t: (a == F.col("amount_own")) & (t == F.col("time_own"))
    return F.flatten(F.transform("amount_near", lambda a: F.transform("time_near", lambda t: _cell(DATED, a, t, own(a, t)))))


def _all_cells() -> Column:
    """Cells of any row: with a date those above and, for rows without one, cells of the amount alone.

    In lane ``UNDATED`` every row looks back for a row without a date. In lane ``NEXT`` a row with a date looks forward for one.
    """
    known = F.col("micros").isNotNull()
    zero = F.lit(0)
    back = F.transform("amount_near", lambda a: _cell(UNDATED, a, zero, ~known & (a == F.col("amount_own"))))
    ahead = F.when(known, F.transform("amount_near", lambda a: _cell(NEXT, a, zero, F.lit(False)))).otherwise(F.array(_cell(NEXT, F.col("amount_own"), zero, F.lit(True))))
    return F.when(known, F.concat(_dated_cells(), back, ahead)).otherwise(F.concat(back, ahead))


def _point() -> Column:
    return F.when(F.col("_offers"), F.col("_here"))


def _probes(rows: DataFrame, cells: Column) -> DataFrame:
    """One row for each cell: the row as ``_here``, whether it offers itself (then it is the point), and its place in the order."""
    place = F.when(F.col("c.lane") == NEXT, -F.col("seq")).otherwise(F.col("seq"))
    out = rows.select("key", _here().alias("_here"), "seq", F.explode(cells).alias("c"))
    whole = [F.coalesce(F.col(f"c.{name}"), F.lit(0)).alias(name) for name in ("cell", "time")]
    return out.select("key", "c.lane", *whole, "_here", F.col("c.offers").alias("_offers"), place.alias("_place"))


def _close() -> Column:
    apart = F.abs(F.col("i.micros") - F.col("j.micros"))
    return (F.abs(F.col("i.amount") - F.col("j.amount")) <= TOLERANCE) & (apart.isNull() | (apart <= MICROS))


# Amounts of a neighbouring cell are only partly near enough, and the next row there may be one that is not. For such
# rows the cell is cut in halves LEVELS times: what is near enough is a few whole pieces and the pieces at the border.
LEVELS = 20
PIECES = 1 << LEVELS


def _piece(amount: Column, cell: Column) -> Column:
    return F.least(F.greatest(F.floor((amount / AMOUNT_STEP - cell) * PIECES), F.lit(0)), F.lit(PIECES - 1)).cast("bigint")


def _node(level: Column, number: Column) -> Column:
    return F.struct(level.cast("int").alias("level"), number.cast("bigint").alias("number"))


def _pieces_within() -> Column:
    """The pieces that cover the near part of a neighbouring cell: whole ones by the bits of the border, and the three at the border."""
    above = F.col("cell") > F.col("amount_own")
    border = _piece(F.when(above, F.col("i.amount") + TOLERANCE).otherwise(F.col("i.amount") - TOLERANCE), F.col("cell"))
    # From the upper end the pieces are numbered backwards, so that in both cases all below the border are near.
    # One less, as the piece before the border may hold rows that rounding puts on either side.
    upto = F.greatest(F.when(above, border).otherwise(PIECES - 1 - border) - 1, F.lit(0))
    level = lambda k: F.call_function("shiftright", upto, k)
    whole = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda k: level(k) % 2 == 1),
        lambda k: _node(k, F.when(above, level(k) - 1).otherwise(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.lit(LEVELS) - k) - level(k))),
    )
    edge = F.transform(F.filter(F.sequence(border - 1, border + 1), lambda p: (p >= 0) & (p < PIECES)), lambda p: _node(F.lit(0), p))
    return F.array_distinct(F.concat(whole, edge))


def _next_in_part(unsettled: DataFrame, rows: DataFrame) -> DataFrame:
    """(i, j) for rows with a date whose next row without one in a neighbouring cell is too far off in amount.

    Amounts of one border piece, which differ by less than 1e-8, are told apart only by the row that comes next.
    """
    asks = unsettled.withColumn("amount_own", F.floor(F.col("i.amount") / F.lit(AMOUNT_STEP)).cast("bigint"))
    asks = asks.select("key", "cell", F.explode(_pieces_within()).alias("n"), F.col("i").alias("_here"), F.lit(False).alias("_offers"))
    undated = rows.where(F.col("micros").isNull())
    own = _piece(F.col("amount"), F.col("amount_own"))
    halves = F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda k: _node(k, F.call_function("shiftright", own, k)))
    offers = undated.select("key", F.col("amount_own").alias("cell"), F.explode(halves).alias("n"), _here().alias("_here"), F.lit(True).alias("_offers"))
    both = asks.unionByName(offers).select("key", "cell", "n.level", "n.number", "_here", "_offers", (-F.col("_here.seq")).alias("_place"))
    found = last_before(both, ["key", "cell", "level", "number"], "_place", "_point", made=_point())
    return found.where(F.col("_point").isNull() & F.col("found").isNotNull()).select(F.col("_here").alias("i"), F.col("found").alias("j"))


def _firsts(pairs: DataFrame) -> DataFrame:
    """For each ``i`` the first ``j`` that matches."""
    first = F.min_by(F.struct("i", "j"), F.col("j.seq")).alias("p")
    return pairs.where((F.col("i.amount") != 0) & _close()).groupBy(F.col("i.seq").alias("seq")).agg(first).select(
        "seq",
        F.col("p.i.id").alias("id"),
        F.col("p.j.seq").alias("dup_seq"),
        F.col("p.j.id").alias("dup_id"),
        F.col("p.i.merchant").alias("merchant"),
        F.col("p.i.amount").alias("amount"),
        (F.abs(F.col("p.i.micros") - F.col("p.j.micros")) / F.lit(3.6e9)).alias("hours"),
    )


def _sweep(rows: DataFrame) -> DataFrame:
    """(key, cell, i, j, ahead): every row and cell with the last row offered before it, where the two match or, ``ahead``,
    the row looks forward for one without a date."""
    met = last_before(_probes(rows, _all_cells()), CELL, "_place", "_point", made=_point()).where(F.col("found").isNotNull())
    onward = F.col("lane") == NEXT
    pair = F.when(onward, F.struct(F.col("_here").alias("i"), F.col("found").alias("j"))).otherwise(F.struct(F.col("found").alias("i"), F.col("_here").alias("j")))
    met = met.where(~onward | ~F.col("_offers")).select("key", "cell", onward.alias("ahead"), F.inline(F.array(pair)))
    return met.where(((F.col("i.amount") != 0) & _close()) | (F.col("ahead") & _far()))


def _far() -> Column:
    return F.abs(F.col("i.amount") - F.col("j.amount")) > TOLERANCE


def first_later_matches(txn: DataFrame) -> DataFrame:
    """For each row the first later row (by ``seq``) with the same merchant in any
    case, an amount within 0.01 and a time within 24 hours or unknown. A row
    without a merchant or with amount 0 has no match of its own.

    Columns: seq, id, dup_seq, dup_id, merchant, amount, hours (NULL when a time is unknown).

    One sweep over the cells of all rows serves dated and undated rows; pairs grow
    linearly however dense the amounts or hot the merchant. The matches it finds are written
    once, as two branches read them.
    """
    rows = _prepared(txn)
    met = written(_sweep(rows), "duplicate-sweep", free=True)
    rest = _next_in_part(met.where(F.col("ahead") & _far()).select("key", "cell", "i"), rows)
    return _firsts(met.select("i", "j").unionByName(written(rest, "duplicate-rest", free=True)))


def matches_of_arrivals(new: DataFrame, ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Matches that arriving dated rows make with each other and with earlier ones, and the last row of every cell.

    ``ends``: key, cell, time and ``last``, the last row that came before in each
    cell. Nothing else of the earlier rows is needed, as the rows of one cell match
    each other. "Later" is the order of arrival: all of ``ends`` before the new rows, these by ``seq``.
    """
    probes = _probes(_prepared(new), _dated_cells())
    known = [F.coalesce(F.col(name), F.lit(zero)).alias(name) for name, zero in (("key", ""), ("cell", 0), ("time", 0))]
    before = ends.select(*known, F.lit(DATED).alias("lane"), F.col("last").alias("_here"), F.lit(True).alias("_offers"), F.lit(-1).cast("bigint").alias("_place"))
    both = probes.unionByName(before).withColumn("_point", _point())
    found = last_before(both, CELL, "_place", "_point").where((F.col("_place") >= 0) & F.col("found").isNotNull())
    last = both.where(F.col("_point").isNotNull()).groupBy("key", "cell", "time").agg(F.max_by("_point", "_place").alias("last"))
    return _firsts(found.select(F.col("found").alias("i"), F.col("_here").alias("j"))), last


def duplicates(txn: DataFrame) -> DataFrame:
    """``first_later_matches`` with the description."""
    apart = F.when(F.col("hours") > 0, F.format_string(" (%.1fh apart)", "hours")).otherwise(F.lit(""))
    return first_later_matches(txn).withColumn(
        "description",
        F.concat(F.lit("Possible duplicate: "), F.col("merchant"), F.lit(" $"), money(F.col("amount")), apart),
    )


def same_day_duplicates(txn: DataFrame) -> DataFrame:
    """Groups of equal merchant, amount and day with more than one row.

    ``first_id`` is the earliest row, ``n`` the size and ``pairs`` the number of
    pairs; the pairs themselves are not written out because a hot group would be
    squared. ``same_day_members`` lists the rows of the groups.
    """
    return (
        txn.groupBy("merchant", "amount", F.to_date("date").alias("day"))
        .agg(F.count("*").alias("n"), F.min_by("id", "seq").alias("first_id"), F.min("seq").alias("first_seq"))
        .where(F.col("n") > 1)
        .withColumn("pairs", (F.col("n") * (F.col("n") - 1) / 2).cast("bigint"))
    )


def same_day_members(txn: DataFrame) -> DataFrame:
    """Every later row of a same-day group next to the group's first row.

    The group side is salted: one group may hold a large share of all rows.
    """
    groups = same_day_duplicates(txn).select("merchant", "amount", "day", "first_id", "first_seq")
    rows = txn.withColumn("day", F.to_date("date"))
    return (
        salted_join(rows, groups, ["merchant", "amount", "day"], "seq")
        .where(F.col("seq") > F.col("first_seq"))
        .select("first_id", "id", "merchant", "amount", "day")
    )


def anomaly_transactions(anomalies: DataFrame, txn: DataFrame) -> DataFrame:
    """Every anomaly next to each transaction it names."""
    named = anomalies.select(F.col("id").alias("anomaly_id"), "type", F.explode("transaction_ids").alias("id"))
    return named.join(txn.select("id", "merchant", "amount", "date"), "id", "left")
