"""Windows of fixed width that occur more than once in a corpus, without a row for each window.

The windows are sorted into groups by digits, most significant first, and a group
of one is dropped as soon as it shows (a radix sort that stops at the window's end):

1. first digit: the window's anchor, its gram of least hash. Neighbouring windows
   share their anchor, so one row stands for a run of about (width - k) / 2 windows;
2. second digit: all codes of the run. Equal runs are equal windows, one by one;
3. where one anchor has several different runs (the edges of repeated passages), the
   first row of each run is opened into blocks, aligned to the anchor; the digit is
   the core that all windows of a block contain;
4. last digit: where one core has several different blocks, their single windows.

Before each shuffle a batch keeps one row of each group and settles the others, so
a passage that a third of all documents share costs a row for each batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .rolling import CHUNK, U, base, merged, mix, ranges, segments
from .storage import stored

#: codes(texts) yields (text number, codes of a piece, first window of the piece, windows in it)
Pieces = Callable[[list[bytes]], Iterator[tuple[int, np.ndarray, int, int]]]
ROWS = 1 << 17  # of an Arrow batch that leaves a task


def pieces_of(codes: np.ndarray, text: int, width: int) -> Iterator[tuple[int, np.ndarray, int, int]]:
    """A text of any length as overlapping pieces, each holding its windows whole."""
    total = len(codes) - width + 1
    for at in range(0, max(total, 0), CHUNK - width):
        n = min(CHUNK - width, total - at)
        yield text, codes[at : at + n + width - 1], at, n


def _gathered(pieces, size: int = CHUNK):
    """Pieces gathered until they hold ``size`` codes."""
    out, total = [], 0
    for p in pieces:
        if out and total + len(p[1]) > size:
            yield out
            out, total = [], 0
        out.append(p)
        total += len(p[1])
    if out:
        yield out


def _settle(cols: list[np.ndarray], keys: int):
    """One row of each group stays open, the one of the least place; rows at other places are settled.

    The group is made by the first ``keys`` columns, the place (_id, _key, pos) by the
    three behind them; a place that comes again is dropped. Returns (row order, more
    places follow, settled).
    """
    order = np.lexsort([*reversed(cols[: keys + 3])])
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in cols[:keys]])
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    other = np.logical_or.reduce([c[order] != c[order][first][group] for c in cols[keys : keys + 3]])
    more = np.logical_or.reduceat(other, first)[group] & new
    keep = new | other
    return order[keep], more[keep], other[keep]


def _out(cols: dict[str, np.ndarray | list]):
    names = list(cols)
    for lo in range(0, len(cols[names[0]]), ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(cols[c][lo : lo + ROWS]) for c in names], names=names)


def _places(*group: str):
    """(the row stands elsewhere than the group's first row, the group has several places)."""
    whole = W.partitionBy(*group).orderBy("_id", "_key", "pos").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    place = F.struct("_id", "_key", "pos")
    first, last = F.first(place).over(whole), F.last(place).over(whole)
    return place != first, first != last


def _grouped(rows: DataFrame, digit: str, rest: str, keep_first: bool):
    """(``known``: the row's windows occur elsewhere, ``opened``: the digit has rows with another rest).

    A settled row needs no partner: its digit is its own place, so that it is sent anywhere.
    """
    rows = rows.withColumn(digit, F.when(F.col("settled"), F.xxhash64("_id", "_key", "pos")).otherwise(F.col(digit)))
    by_digit = W.partitionBy(digit, "settled").orderBy(rest, "_id", "_key", "pos").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    other, shared = _places(digit, "settled", rest)
    known = F.col("settled") | (other if keep_first else shared | F.col("more"))
    opened = ~F.col("settled") & ~other & (F.first(rest).over(by_digit) != F.last(rest).over(by_digit))
    return rows.withColumns({"known": known, "opened": opened}).where("known or opened")


def squeezed(docs: DataFrame) -> DataFrame:
    """``_text`` as compressed bytes in ``_zip``: texts are shuffled at a third of their size."""
    keep = [c for c in docs.columns if c != "_text"]
    kind = docs.select(*keep).schema

    def squeeze(batches):
        zip_ = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = batch.column("_text").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([zip_.compress(t) for t in texts], pa.binary())], names=[*keep, "_zip"])

    return docs.mapInArrow(squeeze, kind.add("_zip", "binary"))


def unzipped(column) -> list[bytes]:
    unzip = zstandard.ZstdDecompressor()
    return [unzip.decompress(t) if t else b"" for t in column.to_pylist()]


def repeated_runs(docs: DataFrame, pieces: Pieces, width: int, k: int, block: int, keep_first: bool) -> DataFrame:
    """Rows (_id, _key, pos, n): the windows pos..pos+n-1 of the document occur elsewhere.

    ``docs`` has ``_id``, ``_key`` and ``_text``. With ``keep_first`` the earliest
    occurrence (smallest _id, _key, pos) of each window is left out.
    """

    def find(batches):
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            ids, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            found = []
            for group in _gathered(pieces(texts)):
                sizes = np.array([len(p[1]) for p in group])
                hi = np.cumsum(sizes)
                of, at, n, anchor, h, s = segments(np.concatenate([p[1] for p in group]), hi - sizes, hi, width, k)
                text, first = np.array([p[0] for p in group])[of], np.array([p[2] for p in group])[of]
                shape = (s & ~U(0xFFFF)) | (n.astype(U) << U(9)) | (anchor.astype(U) << U(2))
                found.append((h.view(np.int64), shape.view(np.int64), ids[text], keys[text], at + first))
            if not found:
                continue
            cols = [np.concatenate(c) for c in zip(*found)]
            if len(cols[0]):
                order, more, settled = _settle(cols, 2)
                h, shape, id_, key, pos = (c[order] for c in cols)
                yield from _out({"h": h, "s": shape | more << 1 | settled, "_id": id_, "_key": key, "pos": pos})

    runs = docs.select("_id", "_key", "_text").mapInArrow(find, "h long, s long, _id long, _key long, pos long")
    runs = runs.select("h", F.col("s").bitwiseAND(~3).alias("s"), "_id", "_key", "pos", F.col("s").bitwiseAND(2).cast("boolean").alias("more"), F.col("s").bitwiseAND(1).cast("boolean").alias("settled"))
    n, anchor = (F.shiftright("s", x).bitwiseAND(127).cast("int") for x in (9, 2))
    runs = stored(_grouped(runs, "h", "s", keep_first).select("_id", "_key", "pos", n.alias("n"), anchor.alias("anchor"), "known", "opened"), "runs")
    spans = _by_document(runs.where("opened"), "n", "anchor")

    def open_blocks(batches):
        for batch in batches:
            texts = unzipped(batch.column(2))
            ids, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            ends, (lo, n, anchor) = _lists(batch.column(3))
            found = []
            for text, codes, start, total in pieces(texts):
                own = slice(ends[text], ends[text + 1])
                here = (lo[own] >= start) & (lo[own] < start + total)
                if here.any():
                    found.append(_blocks(codes, lo[own][here] - start, n[own][here], anchor[own][here], width, block, ids[text], keys[text], start))
            if not found:
                continue
            core, rest, ids, keys, pos, first, n, values = (np.concatenate(c) for c in zip(*found))
            order, more, settled = _settle([core, rest, ids, keys, pos], 2)
            starts = np.concatenate(([0], np.cumsum(n)))[:-1]
            parts = [values[a : a + m] if open_ else None for a, m, open_ in zip(starts[order].tolist(), n[order].tolist(), (~settled).tolist())]
            yield from _out({"core": core[order], "rest": rest[order], "_id": ids[order], "_key": keys[order], "pos": pos[order], "n": n[order].astype(np.int32), "first": first[order].astype(np.int32), "more": more, "settled": settled, "hashes": parts})

    texts = squeezed(docs.select("_id", "_key", "_text"))
    blocks = texts.join(spans, ["_id", "_key"]).select("_id", "_key", "_zip", "spans")
    blocks = blocks.mapInArrow(open_blocks, "core long, rest long, _id long, _key long, pos long, n int, first int, more boolean, settled boolean, hashes array<long>")
    blocks = stored(_grouped(blocks, "core", "rest", keep_first).select("core", "_id", "_key", "pos", "n", "first", "known", "opened", F.when(F.col("opened"), F.col("hashes")).alias("hashes")), "blocks")
    single = blocks.where("opened").select("core", "_id", "_key", "pos", "first", F.posexplode("hashes").alias("j", "hash"))
    # Windows stand in rising places, so their distance from the anchor falls.
    single = single.select("core", (F.col("first") - F.col("j")).alias("off"), "hash", "_id", "_key", (F.col("pos") + F.col("j")).alias("pos"))
    other, shared = _places("core", "off", "hash")
    single = single.select("_id", "_key", "pos", F.lit(1).alias("n"), (other if keep_first else shared).alias("known"))
    return runs.select("_id", "_key", "pos", "n", "known").unionByName(blocks.select("_id", "_key", "pos", "n", "known")).unionByName(single).where("known").drop("known")


def _blocks(codes, lo, n, anchor, width, size, id_, key, pos):
    """The runs (first window ``lo``, ``n`` windows, ``anchor`` codes ahead) cut into blocks aligned to the anchor.

    Returns (core hash, hash of the block, id, key, place, distance of the first window from the anchor, windows, their hashes).
    """
    b0, b1 = base(0), base(1)
    p0, p1 = b0.prefix(codes), b1.prefix(codes)
    at = ranges(lo, n)
    run = np.repeat(np.arange(len(lo)), n)
    off = (lo + anchor)[run] - at
    cell = off // size
    new = np.ones(len(at), dtype=bool)
    new[1:] = (run[1:] != run[:-1]) | (cell[1:] != cell[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    hashes = b1.spans(p1, at, at + width)
    start, cell = (lo + anchor)[run[first]] - cell[first] * size, cell[first]  # the last window that the aligned block could hold
    core = mix(b0.spans(p0, start, start - size + 1 + width) ^ mix(cell.astype(U)))
    rest = mix(np.add.reduceat(mix(hashes ^ mix(off.astype(U))), first) ^ off[first].astype(U))
    return core.view(np.int64), rest.view(np.int64), np.full(len(first), id_), np.full(len(first), key), pos + at[first], off[first], count, hashes.view(np.int64)


def _by_document(runs: DataFrame, *more: str) -> DataFrame:
    """One row for each document, with the list of its runs in ``spans``."""
    return runs.select("_id", "_key", F.struct(F.col("pos").alias("at"), *more).alias("span")).groupBy("_id", "_key").agg(F.collect_list("span").alias("spans"))


def _lists(column: pa.ListArray):
    """(end of each row's list, the fields of all lists)."""
    flat = column.flatten()
    lengths = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    return np.concatenate(([0], np.cumsum(lengths))), [flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(flat.type.num_fields)]


def with_runs(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """``docs`` with ``_zip`` for ``_text`` and ``spans``, the repeated windows of each document (null: none)."""
    return squeezed(docs).join(_by_document(runs, "n"), ["_id", "_key"], "left")


def span_lists(column: pa.ListArray, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The covered ranges [lo, hi) of each row."""
    ends, (lo, n) = _lists(column)
    hi = lo + n - 1 + width
    return [merged(lo[a:b], hi[a:b]) for a, b in zip(ends[:-1], ends[1:])]

