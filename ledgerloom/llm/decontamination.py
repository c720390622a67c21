"""Benchmark decontamination: n-gram seeds find where a text could hold a benchmark item, Smith-Waterman scores it.

Every n-gram of an item is a seed, however often it occurs: which of them an edited
copy still holds cannot be told from counts. A seed in a text opens a window of the
item's length around its diagonal; near diagonals share a window. A window goes on
only if the words it has in common with the item could reach the threshold, which
loses nothing. Then the words of window and item are aligned locally (match +2, other
word -1, gap -1). The score is the alignment's share of the best that the item, or
``enough`` words of it, could reach.

The benchmark is a query set: it is taken in blocks of bounded size, each held
against all rows, so nothing but counts is shuffled.

Words are runs of letters, digits and characters beyond ASCII, whatever their case.
Nulls and empty texts match nothing; items that are null or have fewer words than
an n-gram have no seeds and are never reported. Items of equal text are reported
each; rows of the benchmark that repeat are one item. Texts of any length are read
whole, hashed in bounded pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import query, table
from .rolling import PLAIN_WORDS, base, ranges, word_batches
from .storage import keyed, row_type, unpacked

GRAM = 3
BLOCK_BYTES = 1 << 22  # of the benchmark's text held against all rows at once
MATCH, MISS, GAP = 2, 1, 1
PART = 1 << 20  # seeds, words of windows or cells of an alignment that are held at once


@dataclass
class Items:
    """A block of the benchmark: item numbers, their words, for each gram its hash, item and place, in order of the hash,
    the different words, and how often each item (item number * different words + word) holds each."""

    ids: list
    words: list[np.ndarray]
    grams: np.ndarray
    item: np.ndarray
    place: np.ndarray
    vocabulary: np.ndarray
    keys: np.ndarray
    count: np.ndarray


def _items(rows: list[tuple]) -> Items:
    texts = [t.encode() for _, t in rows]
    words = []
    for lo, hi, hashes, _, _, at in word_batches(texts, PLAIN_WORDS):
        words += [hashes[a:b] for a, b in zip(at[:-1], at[1:])]
    b0 = base(0)
    grams = [b0.grams(b0.prefix(w), GRAM) if len(w) >= GRAM else w[:0] for w in words]
    item = np.repeat(np.arange(len(words)), [len(g) for g in grams])
    place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.empty(0, np.int64)
    flat = np.concatenate(grams) if grams else np.empty(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    vocabulary, rank = np.unique(np.concatenate([*words, np.empty(0, np.uint64)]), return_inverse=True)
    keys, count = np.unique(np.repeat(np.arange(len(words)), [len(w) for w in words]) * len(vocabulary) + rank, return_counts=True)
    return Items([i for i, _ in rows], words, flat[order], item[order], place[order], vocabulary, keys, count)


def _hits(texts: list[bytes], grams: np.ndarray):
    """Groups of texts with (first text, end, words, first word of each text + end, places whose gram is one of ``grams``, their hashes)."""
    b0 = base(0)
    filter_ = np.zeros(1 << 20, dtype=bool)
    filter_[(grams >> np.uint64(44)).astype(np.int64)] = True
    for lo, hi, words, _, _, at in word_batches(texts, PLAIN_WORDS):
        if len(words) < GRAM or not len(grams):
            yield lo, hi, words, at, np.empty(0, np.int64), np.empty(0, np.uint64)
            continue
        hashes = b0.grams(b0.prefix(words), GRAM)
        places = np.flatnonzero(filter_[(hashes >> np.uint64(44)).astype(np.int64)])
        found = grams[np.minimum(np.searchsorted(grams, hashes[places]), len(grams) - 1)] == hashes[places]
        places = places[found]
        of = np.searchsorted(at, places, side="right") - 1
        places = places[places + GRAM <= at[of + 1]]  # not across texts
        yield lo, hi, words, at, places, hashes[places]


def align(windows: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best local score, end of it in the window) of each row of ``windows`` with ``item``; hash 0 stands for no word."""
    n, m = windows.shape
    drift = np.arange(m + 1, dtype=np.int32) * GAP
    row = np.zeros((n, m + 1), dtype=np.int32)
    best, end = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int64)
    for word in item:
        step = np.where(windows == word, MATCH, -MISS).astype(np.int32)
        new = np.zeros_like(row)
        new[:, 1:] = np.maximum(row[:, :-1] + step, row[:, 1:] - GAP)
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + drift, axis=1) - drift
        top = row.argmax(axis=1)
        value = row[np.arange(n), top]
        better = value > best
        best[better], end[better] = value[better], top[better]
    return best, end


def _parts(sizes: np.ndarray) -> Iterator[slice]:
    """Slices whose sizes add up to ``PART`` at most, or of one element."""
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PART, side="right")))
        yield slice(lo, hi)
        lo = hi


def _windows(at: np.ndarray, places: np.ndarray, hashes: np.ndarray, items: Items, sizes: np.ndarray):
    """(text, item, first word, end word) of the windows that the seeds open."""
    lo, hi = np.searchsorted(items.grams, hashes), np.searchsorted(items.grams, hashes, side="right")
    found = []
    for part in _parts(hi - lo):
        n = (hi - lo)[part]
        which, place = ranges(lo[part], n), np.repeat(places[part], n)
        text, item, start = np.searchsorted(at, place, side="right") - 1, items.item[which], place - items.place[which]
        cell = start // np.maximum(8, sizes[item] // 4)
        order = np.lexsort((cell, text, item))
        item, text, cell, start = item[order], text[order], cell[order], start[order]
        new = np.ones(len(item), dtype=bool)
        new[1:] = (item[1:] != item[:-1]) | (text[1:] != text[:-1]) | (cell[1:] != cell[:-1])
        first = np.flatnonzero(new)
        found.append((item[first], text[first], cell[first], np.minimum.reduceat(start, first), np.maximum.reduceat(start, first)))
    item, text, cell, lowest, highest = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((cell, text, item))
    item, text, cell, lowest, highest = (c[order] for c in (item, text, cell, lowest, highest))
    # Diagonals in the same or the next cell share a window.
    new = np.ones(len(item), dtype=bool)
    new[1:] = (item[1:] != item[:-1]) | (text[1:] != text[:-1]) | (cell[1:] > cell[:-1] + 1)
    first = np.flatnonzero(new)
    lowest, highest = np.minimum.reduceat(lowest, first), np.maximum.reduceat(highest, first)
    item, text = item[first], text[first]
    slack = sizes[item] // 4 + 4
    return text, item, np.maximum(lowest - slack, at[text]), np.minimum(highest + sizes[item] + slack, at[text + 1])


def _common(words: np.ndarray, item: np.ndarray, a: np.ndarray, b: np.ndarray, items: Items) -> np.ndarray:
    """How many words each window [a, b) has in common with its item, each as often as both hold it: no alignment matches more."""
    vocabulary, keys, count = items.vocabulary, items.keys, items.count
    at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
    known = np.flatnonzero(vocabulary[at] == words)
    at = at[known]
    a, b = np.searchsorted(known, a), np.searchsorted(known, b)
    out = np.zeros(len(item), dtype=np.int64)
    for part in _parts(b - a):
        n = (b - a)[part]
        window = np.repeat(np.arange(part.start, part.stop), n)
        wanted = item[window] * len(vocabulary) + at[ranges(a[part], n)]
        key = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        has = keys[key] == wanted
        pair, n = np.unique(window[has] * len(keys) + key[has], return_counts=True)
        np.add.at(out, pair // len(keys), np.minimum(n, count[pair % len(keys)]))
    return out


def _matches(words: np.ndarray, at: np.ndarray, places: np.ndarray, hashes: np.ndarray, items: Items, threshold: float, enough: int):
    """(text, item, score, first word, end word) of the alignments that reach the threshold."""
    if not len(places):
        return
    sizes = np.array([len(w) for w in items.words])
    text, item, a, b = _windows(at, places, hashes, items, sizes)
    able = MATCH * _common(words, item, a, b, items) >= threshold * MATCH * np.minimum(sizes[item], enough)
    text, item, a, b = text[able], item[able], a[able], b[able]
    for j in np.unique(item):
        own = np.flatnonzero(item == j)
        own = own[np.argsort(b[own] - a[own], kind="stable")]
        query_ = items.words[j]
        most = MATCH * min(len(query_), enough)
        lo = 0
        while lo < len(own):
            step = 64
            while step > 1 and step * int((b - a)[own[lo : lo + step][-1]]) > PART:
                step //= 2
            part = own[lo : lo + step]
            lo += step
            width = int((b[part] - a[part]).max())
            windows = np.zeros((len(part), width), dtype=np.uint64)
            for i, k in enumerate(part):
                windows[i, : b[k] - a[k]] = words[a[k] : b[k]]
            score, end = align(windows, query_)
            good = np.flatnonzero(score >= threshold * most)
            if len(good):
                # Backwards from the end, the same score shows where the alignment began.
                back = np.zeros((len(good), width), dtype=np.uint64)
                for i, g in enumerate(good):
                    back[i, : end[g]] = windows[g, : end[g]][::-1]
                _, length = align(back, query_[::-1])
                for g, n in zip(good, length):
                    k = part[g]
                    yield int(text[k]), int(j), min(1.0, float(score[g]) / most), int(a[k] + end[g] - n - at[text[k]]), int(a[k] + end[g] - at[text[k]])


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple]]:
    """The benchmark as lists of (id, text) of bounded size, one at a time."""
    items = benchmark.select(F.col(item_col).alias("_item"), F.col(text_col).cast("string").alias("_text")).where("_text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("_text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("_item", "_text"), F.lit(blocks)) == k)
        yield [(r["_item"], r["_text"]) for r in part.orderBy("_item", "_text").toLocalIterator()]


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    threshold: float = 0.5, enough: int = 50,
) -> DataFrame:
    """The columns of ``docs`` with the text, and ``leaks``: an array of (item, score, start, end) with word places."""
    rows = keyed(docs, id_col, text_col).select("_row", "_text")
    kind = f"_row {row_type(rows)}, _text string, leaks array<struct<item: {dict(benchmark.dtypes)[item_col]}, score: double, start: long, end: long>>"
    found = rows.withColumn("leaks", F.expr(f"cast(array() as {kind.rpartition('leaks ')[2]})"))
    for block in blocks_of(benchmark, item_col, item_text_col):
        found = found.mapInArrow(_finder(_items(block), threshold, enough), kind)
    text = F.when(~F.col("_row._no_text"), F.col("_text"))
    return unpacked(found.withColumn(text_col, text), docs.columns, text_col, [text_col, "leaks"])


def _finder(items: Items, threshold: float, enough: int):
    def find(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            leaks = batch.column(2).to_pylist()
            for lo, _, words, at, places, hashes in _hits(texts, np.unique(items.grams)):
                best: dict[tuple[int, int], tuple] = {}
                for text, item, *match in _matches(words, at, places, hashes, items, threshold, enough):
                    if match > list(best.get((text, item), ())):
                        best[text, item] = tuple(match)
                for (text, item), (score, start, end) in sorted(best.items()):
                    leaks[lo + text].append({"item": items.ids[item], "score": score, "start": start, "end": end})
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leaks, batch.schema.field(2).type)], names=["_row", "_text", "leaks"])

    return find


@query("op1_decontamination")
def op1(spark, sf_dir) -> DataFrame:
    """One row for each document and benchmark item that it holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", F.inline("leaks")).withColumnRenamed("item", "item_id")
