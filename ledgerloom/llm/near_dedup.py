"""MinHash near-dedup: DartMinHash signatures of word shingles, banded joining, and exact checks of what the bands find.

A text is the multiset of its shingles; a shingle that comes w times is a region
of weight w. Every unit of a region is hit by darts at hashed ranks, in layers of
growing rank; each dart falls on a hashed coordinate, and a coordinate keeps its
earliest dart. Texts agree in a coordinate with the probability of their weighted
Jaccard similarity (sum of the lesser over sum of the greater counts). Only as many
layers are thrown as fill all coordinates, so that a text costs its own length and
some k log k darts.

Texts with equal words are one class, which is compared once. In each bucket of a
band, members meet three leaders; where one is not linked to the first leader, all
members of the bucket meet: as pairs in small buckets, block by block within tasks in
large ones. Every pair is checked exactly.

Words are runs of letters, digits and characters beyond ASCII, whatever their case.
Texts of fewer words than a shingle are one shingle. Nulls, empty texts and texts
without words are alone in their group. Rows that repeat id and text are one
document. A null id counts as the smallest.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, join_hot
from .registry import query, table
from .repeats import squeezed, unzipped
from .rolling import PLAIN_WORDS, U, base, mix, word_batches
from .storage import keyed, shown_id, stored, unpacked

FEW = 8  # members of a bucket that are paired as rows; those of larger ones meet within tasks
BLOCK = 256  # members on one side of a task

#: Ends of the layers of ranks; a unit is hit by one dart a rank on average.
LAYERS = [2.0**i for i in range(-6, 16)]


def _poisson(mean: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, ... darts."""
    n = np.arange(int(mean + 12 * math.sqrt(mean) + 24))
    logs = n * math.log(mean) - mean - np.concatenate(([0.0], np.cumsum(np.log(n[1:]))))
    return np.cumsum(np.exp(logs))


_COUNTS = [_poisson(hi - lo) for lo, hi in zip([0.0, *LAYERS], LAYERS)]


def shingles(texts: list[bytes], size: int):
    """Yields groups of texts: (first text, end, number of words of each, hash of all words of each, text of each shingle, its hash)."""
    b0, b1 = base(0), base(1)
    for lo, hi, words, _, _, at in word_batches(texts, PLAIN_WORDS):
        n = np.diff(at)
        p0, p1 = b0.prefix(words), b1.prefix(words)
        whole = b0.spans(p0, at[:-1], at[1:]), b1.spans(p1, at[:-1], at[1:])
        count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
        start = np.repeat(at[:-1] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        text = np.repeat(np.arange(hi - lo), count)
        yield lo, hi, n, whole, text, b1.spans(p1, start, np.minimum(start + size, at[1:][text]))


def units(text: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The multisets as sets: each further copy of a shingle in a text becomes a unit of its own."""
    order = np.lexsort((shingle, text))
    text, shingle = text[order], shingle[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (shingle[1:] != shingle[:-1])
    first = np.flatnonzero(new)
    copy = np.arange(len(text)) - np.repeat(first, np.diff(np.append(first, len(text))))
    return text, mix(shingle + copy.astype(U) * U(0x9E3779B97F4A7C15))


def signatures(text: np.ndarray, unit: np.ndarray, texts: int, k: int) -> np.ndarray:
    """(texts, k): the earliest dart of each coordinate, as layer and hash; texts without units keep the greatest number."""
    none = U(2**64 - 1)
    out = np.full((texts, k), none, dtype=U)
    flat = out.reshape(-1)
    open_ = np.zeros(texts, dtype=bool)
    open_[text] = True
    for layer, counts in enumerate(_COUNTS):
        if not open_.any():
            break
        here = open_[text]
        text, unit = text[here], unit[here]
        seed = mix(unit ^ U((layer + 1) * 0xD1B54A32D192ED03 & (2**64 - 1)))
        darts = np.searchsorted(counts, (seed >> U(11)).astype(np.float64) * 2.0**-53, side="right")
        for part in _slices(darts):
            n = darts[part]
            number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            hashed = mix(np.repeat(seed[part], n) + (number.astype(U) + U(1)) * U(0x9E3779B97F4A7C15))
            coordinate = (mix(hashed ^ U(0x94D049BB133111EB)) % U(k)).astype(np.int64)
            np.minimum.at(flat, np.repeat(text[part], n) * k + coordinate, (hashed >> U(6)) | (U(layer) << U(58)))
        open_ &= (out == none).any(axis=1)
    return out


def _slices(darts: np.ndarray, size: int = 1 << 20):
    ends = np.cumsum(darts)
    lo = 0
    while lo < len(darts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, side="right")))
        yield slice(lo, hi)
        lo = hi


def _classes(rows: DataFrame, size: int, bands: int, band_rows: int) -> DataFrame:
    """(_id, _key, word hashes h0 and h1, hashes of the bands) of each document with words."""

    def find(batches):
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            for lo, hi, n, whole, text, shingle in shingles(texts, size):
                text, unit = units(text, shingle)
                has = np.flatnonzero(n)
                sig = signatures(text, unit, hi - lo, bands * band_rows)[has].reshape(len(has), bands, band_rows)
                band = np.arange(bands, dtype=U)[None, :] * U(0xBF58476D1CE4E5B9)
                for i in range(band_rows):
                    band = mix(band ^ sig[:, :, i]) * U(0x9E3779B97F4A7C15)
                hashes = pa.FixedSizeListArray.from_arrays(pa.array(band.reshape(-1).view(np.int64)), bands).cast(pa.list_(pa.int64()))
                own = [batch.column(i).to_numpy(zero_copy_only=False)[lo:hi][has] for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(own[0]), pa.array(own[1]), *(pa.array(w[has].view(np.int64)) for w in whole), hashes], names=["_id", "_key", "h0", "h1", "bands"])

    return rows.select("_id", "_key", "_text").mapInArrow(find, "_id long, _key long, h0 long, h1 long, bands array<long>")


def _checked(pairs: DataFrame, texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts have the similarity; ``texts`` holds (node, _zip)."""
    pairs = pairs.join(texts.select(F.col("node").alias("a"), F.col("_zip").alias("za")), "a").join(texts.select(F.col("node").alias("b"), F.col("_zip").alias("zb")), "b")

    def check(batches):
        for batch in batches:
            left, right = (unzipped(batch.column(i)) for i in (2, 3))
            both = [t for pair in zip(left, right) for t in pair]
            same = np.zeros(len(left), dtype=np.int64)
            total = np.zeros(len(left), dtype=np.int64)
            for lo, _, _, _, text, shingle in _pairwise(both, size):
                text, unit = units(text + lo, shingle)
                pair = text // 2
                order = np.lexsort((unit, pair))
                pair, unit = pair[order], unit[order]
                np.add.at(same, pair[1:][(unit[1:] == unit[:-1]) & (pair[1:] == pair[:-1])], 1)
                np.add.at(total, pair, 1)
            ok = same >= threshold * (total - same) - 1e-9
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok))], names=["a", "b"])

    kind = f"a {pairs.schema['a'].dataType.simpleString()}, b {pairs.schema['b'].dataType.simpleString()}"
    return pairs.select("a", "b", "za", "zb").mapInArrow(check, kind)


def _met_in_blocks(members: DataFrame, size: int, threshold: float) -> DataFrame:
    """Links (a, b) that join the members of each bucket as far as they are similar; every two blocks of a bucket are a task, and no pair leaves it.

    ``members`` holds bucket, node, _zip and _count, the members of the bucket.
    """
    blocks = F.ceil(F.col("_count") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("node"), blocks).cast("int")
    met = members.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    side = (F.col("block") > F.col("other")).cast("int").alias("side")
    met = met.select("bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), side, "node", "_zip")

    def compare(group: pa.Table) -> pa.Table:
        side = group.column("side").to_numpy()
        group = group.take(pa.array(np.argsort(side, kind="stable")))
        n, cut = len(side), int((side == 0).sum())
        first = cut if cut < n else 0
        nodes = group.column("node").combine_chunks()
        text, unit = [], []
        for lo, _, _, _, t, s in shingles(unzipped(group.column("_zip")), size):
            t, u = units(t + lo, s)
            text.append(t)
            unit.append(u)
        text, unit = np.concatenate(text), np.concatenate(unit)
        total = np.bincount(text, minlength=n)
        _, column, count = np.unique(unit, return_inverse=True, return_counts=True)
        # Only units of several texts count; they are multiplied as a matrix of zeros and ones, some columns at a time.
        shared = count > 1
        number = np.cumsum(shared) - 1
        text, column = text[shared[column]], number[column[shared[column]]]
        order = np.argsort(column, kind="stable")
        text, column = text[order], column[order]
        same = np.zeros((cut, n - first), dtype=np.float32)
        for lo in range(0, int(shared.sum()), 4096):
            a, b = np.searchsorted(column, (lo, lo + 4096))
            part = np.zeros((n, 4096), dtype=np.float32)
            part[text[a:b], column[a:b] - lo] = 1
            same += part[:cut] @ part[first:].T
        both = total[:cut, None] + total[None, first:] - same
        i, j = np.nonzero(same >= threshold * both - 1e-6)
        j += first
        found, chief = [], list(range(n))

        def lead(x: int) -> int:
            while chief[x] != x:
                chief[x] = chief[chief[x]]
                x = chief[x]
            return x

        for x, y in zip(i.tolist(), j.tolist()):
            p, q = lead(x), lead(y)
            if p != q:  # a link that joins two groups of the block; the others add nothing to the union
                chief[max(p, q)] = min(p, q)
                found.append((x, y))
        found = np.array(found, dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": nodes.take(pa.array(found[:, 0])), "b": nodes.take(pa.array(found[:, 1]))})

    kind = members.schema["node"].dataType.simpleString()
    return met.groupBy("bucket", "low", "high").applyInArrow(compare, f"a {kind}, b {kind}")


def _pairwise(both: list[bytes], size: int):
    """Shingles of texts in pairs; a pair is never parted."""
    at = 0
    while at < len(both):
        end, total = at, 0
        while end < len(both) and (end == at or total + len(both[end]) + len(both[end + 1]) < 1 << 19):
            total += len(both[end]) + len(both[end + 1])
            end += 2
        parts = [(lo + at, hi, n, whole, text, shingle) for lo, hi, n, whole, text, shingle in shingles(both[at:end], size)]
        text = np.concatenate([p[4] + p[0] - at for p in parts])
        yield at, end, None, None, text, np.concatenate([p[5] for p in parts])
        at = end


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8, bands: int = 24, band_rows: int = 5
) -> DataFrame:
    """The columns of ``docs`` with the text, and class_id (smallest id of equal words), group_id (smallest id reachable by links), kept.

    One document of each group is kept: its first row, were there several with the smallest id and text.
    """
    rows = keyed(docs, id_col, text_col)
    node = F.struct("_id", "_key")
    members = stored(_classes(rows, size, bands, band_rows), "members")
    classes = stored(members.select("h0", "h1", "bands", node.alias("node")).groupBy("h0", "h1").agg(F.min("node").alias("node"), F.first("bands").alias("bands"), F.count("*").alias("_count")), "classes")
    buckets = classes.select("node", F.explode("bands").alias("bucket"))
    leaders = [F.min_by("node", F.xxhash64(F.lit(i), "node")).alias(f"leader{i}") for i in range(3)]
    shared = stored(buckets.groupBy("bucket").agg(*leaders, F.count("*").alias("_count")).where("_count > 1"), "buckets")
    kept_buckets = stored(buckets.join(shared.select("bucket"), "bucket", "left_semi"), "bucketed")
    n = kept_buckets.count()
    met = join_hot(kept_buckets, shared, "bucket", n)
    pairs = met.select("node", F.explode(F.array("leader0", "leader1", "leader2")).alias("leader"))
    pairs = stored(_ordered(pairs, "node", "leader"), "pairs")
    needed = kept_buckets.select("node").distinct().select("node._id", "node._key")
    texts = squeezed(rows.select("_id", "_key", "_text")).join(needed, ["_id", "_key"], "left_semi").groupBy("_id", "_key").agg(F.first("_zip").alias("_zip"))
    texts = stored(texts.select(node.alias("node"), "_zip"), "texts")
    links = stored(_checked(pairs, texts, size, threshold), "links")
    # A bucket whose members are all linked to its first leader is settled; in the others all members meet.
    pair = [F.least("node", "leader0").alias("a"), F.greatest("node", "leader0").alias("b")]
    open_ = met.where("node <> leader0").select("bucket", *pair).join(links, ["a", "b"], "left_anti").select("bucket").distinct()
    grouped = stored(kept_buckets.join(open_, "bucket", "left_semi"), "open")
    sizes = stored(grouped.groupBy("bucket").agg(F.count("*").alias("_count")), "sizes")
    few = grouped.join(sizes.where(F.col("_count") <= FEW), "bucket")
    rest = few.select("bucket", "node").join(few.select("bucket", F.col("node").alias("leader")), "bucket").where("node < leader").select("node", "leader")
    rest = _ordered(rest, "node", "leader").join(pairs, ["a", "b"], "left_anti")
    more = _checked(stored(rest, "rest"), texts, size, threshold)
    many = grouped.join(sizes.where(F.col("_count") > FEW), "bucket").join(texts, "node")
    more = stored(more.unionByName(_met_in_blocks(many, size, threshold)), "more")
    roots = stored(components(links.unionByName(more)), "roots")
    named = classes.join(roots, "node", "left").select("h0", "h1", "node", F.coalesce("root", "node").alias("root"))
    named = stored(named.join(classes.select("h0", "h1", "_count"), ["h0", "h1"]), "named").withColumn("h", F.struct("h0", "h1")).drop("h0", "h1")
    of = join_hot(members.select(node.alias("own"), F.struct("h0", "h1").alias("h")), named, "h", members.count()).select("own._id", "own._key", "node", "root").dropDuplicates(["_id", "_key"])
    out = rows.join(of, ["_id", "_key"], "left")
    class_id, root = F.coalesce("node._id", "_id"), F.coalesce("root", node)
    out = out.select("_row", "_text", class_id.alias("class"), root["_id"].alias("group"), (root == node).alias("kept"))
    out = out.withColumns({text_col: F.when(~F.col("_row._no_text"), F.col("_text")), "class_id": shown_id("class"), "group_id": shown_id("group")})
    return unpacked(out, docs.columns, text_col, [text_col, "class_id", "group_id", "kept"])


def _ordered(pairs: DataFrame, x: str, y: str) -> DataFrame:
    return pairs.where(F.col(x) != F.col(y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))
                                 WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
c AS (SELECT doc_id, g, count(*) AS n FROM s GROUP BY ALL),
z AS (SELECT doc_id, sum(n) AS total FROM c GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.n, b.n)) AS same FROM c a JOIN c b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN z zx ON zx.doc_id = x JOIN z zy ON zy.doc_id = y WHERE same >= 0.8 * (zx.total + zy.total - same) - 1e-9),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.y FROM r JOIN l ON l.x = r.b),
k AS (SELECT w, min(doc_id) AS class_id FROM d WHERE len(w) > 0 GROUP BY w),
m AS (SELECT a AS doc_id, min(b) AS group_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(k.class_id, d.doc_id) AS class_id, m.group_id, m.group_id = d.doc_id AS kept
FROM d LEFT JOIN k ON k.w = d.w JOIN m ON m.doc_id = d.doc_id
"""


@query("op9_near_dedup", SQL)
def op9(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "class_id", "group_id", "kept")
