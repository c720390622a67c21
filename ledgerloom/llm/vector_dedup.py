"""Embedding near-dedup: a forest of random-projection trees, exact comparison within leaves, and union of the links.

Vectors meet only under equal labels. A label of at most ``UNIT`` numbers is one unit:
one task makes its trees and compares their leaves, so that neither trees nor leaves are
written. A larger label is divided into such units by ``DIVISIONS`` trees with a wider
margin, fitted on at most ``fit_rows`` vectors a round; a pair is compared where a unit
is the own one of either.

A set of at most ``leaf`` vectors is compared whole. A larger one is split by every tree:
at each node the vectors are projected on a random direction and cut at the median; those
near the cut go to both sides. Near is ``spill`` standard deviations of the projection, but
at least what keeps a pair at the threshold together but for a chance of some 1e-4 a cut: 1.5
times the standard deviation of the projection of its difference. A node of which a cut
would send more than ``MOST`` to one side (its vectors are hardly farther from each other
than links are) is compared whole, a unit once, not by tree; one too large for a task in
blocks, each pair of them in a task of its own.

A pair that meets in several leaves counts in the first of them. Equal vectors are
one class, compared once. Links are exact: cosine in double precision.

Null labels, null or empty vectors, zero vectors and vectors with null or
non-finite components link with nothing. Vectors of different length never link. Rows that repeat id,
label and vector are one vector; a null id counts as the smallest.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, join_hot
from .registry import query, table
from .storage import NO_ID, shown_id, stored

TREE_BITS = 56  # a leaf's number has the tree above so many bits of a hash
BLOCK = 1024  # vectors of one side of a comparison
MOST = 0.7  # of a node on one side of a cut; beyond it the trees make more rows than blocks compared whole
MAX_ROUNDS = 64  # a guard; every round splits each large node that can be split
UNIT = 1 << 22  # numbers of the vectors that one task compares
DIVISIONS = 2  # a pair that one division parts meets in the other
SURE = 2.0  # margin of their cuts, in standard deviations of a link's projection
ROWS_DEALT = 1  # rows for each vector that are dealt out to tasks at once


def _named(tree: int, *path) -> int:
    digest = hashlib.blake2b(repr(path).encode(), digest_size=8).digest()
    return tree << TREE_BITS | int.from_bytes(digest, "little") >> (64 - TREE_BITS)


def _direction(name: int, size: int) -> np.ndarray:
    v = np.random.default_rng(name).standard_normal(size)
    return v / np.linalg.norm(v)


def _grow(name: int, x: np.ndarray, share: float, leaf: int, spill: float, apart: float, sure: float = 1.5):
    """A tree over the sample ``x``, which is ``share`` of its node's vectors: None for a leaf, or (direction, cut, margin, left, right, names).

    ``apart`` is the distance of two unit vectors at the threshold.
    """
    if len(x) < 4 or len(x) / share <= leaf:
        return None
    r = _direction(name, x.shape[1])
    p = x @ r
    # Projections of a pair of links are at most ``apart`` apart: with half of it as margin none is ever parted.
    cut, margin = float(np.median(p)), min(apart / 2, max(float(p.std()) * spill, sure * apart / np.sqrt(x.shape[1]))) + 1e-9
    left, right = p < cut + margin, p >= cut - margin
    if max(left.mean(), right.mean()) > MOST + 0.5 / np.sqrt(len(x)):  # the sample's own error
        return None
    names = [_named(name >> TREE_BITS, name, side) for side in (0, 1)]
    return r, cut, margin, *(_grow(n, x[part], share, leaf, spill, apart, sure) for n, part in zip(names, (left, right))), names


def _route(tree, name: int, x: np.ndarray, rows: np.ndarray, out: list):
    if tree is None:
        out.append((rows, name))
        return
    r, cut, margin, left, right, names = tree
    p = x[rows] @ r
    _route(left, names[0], x, rows[p < cut + margin], out)
    _route(right, names[1], x, rows[p >= cut - margin], out)


def _matrix(column) -> np.ndarray:
    """The unit vectors of one length that a binary column holds."""
    flat = np.frombuffer(b"".join(column.to_pylist()), dtype="<f4").astype(np.float64).reshape(len(column), -1)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def _home(tree, name: int, x: np.ndarray, rows: np.ndarray, out: list):
    """Like ``_route``, with every vector on its own side of each cut alone."""
    if tree is None:
        out.append((rows, name))
        return
    r, cut, _, left, right, names = tree
    low = x[rows] @ r < cut
    _home(left, names[0], x, rows[low], out)
    _home(right, names[1], x, rows[~low], out)


def _routed(forest: dict[int, tuple]):
    """Moves the vectors of the nodes of ``forest`` to the ends of their trees, in ``units`` and in ``home``."""

    def step(batches):
        for batch in batches:
            table_ = pa.Table.from_batches([batch])
            for column, move in (("units", _route), ("home", _home)):
                lists = table_.column(column).combine_chunks()
                names, at = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                met = [int(n) for n in np.unique(names) if int(n) in forest]
                still = ~np.isin(names, met)
                rows, to = [at[still]], [names[still]]
                for name in met:
                    own = at[names == name]
                    out: list = []
                    move(forest[name], name, _matrix(table_.column("vec").take(pa.array(own))), np.arange(len(own)), out)
                    for some, n in out:
                        rows.append(own[some])
                        to.append(np.full(len(some), n, dtype=np.int64))
                rows, to = np.concatenate(rows), np.concatenate(to)
                order = np.lexsort((to, rows))
                ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(lists)))]).astype(np.int32)
                moved = pa.ListArray.from_arrays(pa.array(ends), pa.array(to[order], pa.int64()))
                table_ = table_.set_column(table_.column_names.index(column), column, moved)
            yield from table_.to_batches()

    return step


def _units(classes: DataFrame, leaf: int, spill: float, fit_rows: int, threshold: float) -> tuple[DataFrame, dict[int, int]]:
    """``classes`` with the units in which a vector is compared, its own one of each division in ``home``; and the sizes of
    units too large for one task, which no cut divides.

    A part of at most ``UNIT`` numbers is one unit. A larger one is divided by ``DIVISIONS``
    trees, whose splits are fitted on at most ``fit_rows`` vectors a round.
    """
    cap = F.greatest(F.lit(leaf), F.floor(F.lit(UNIT) / F.col("part.size"))).cast("long")
    sizes = classes.groupBy("part").agg(F.count("*").alias("_count")).where(F.col("_count") > cap)
    sized = classes.join(F.broadcast(sizes), "part", "left")  # fewer than rows / leaf parts are large
    name = F.xxhash64("part").bitwiseAND((1 << TREE_BITS) - 1)
    columns = ["node", "weight", "vec", F.col("part.size").alias("size")]
    whole = sized.where("_count is null").select(*columns, F.array(name).alias("units"), F.array(name).alias("home"))
    if sizes.isEmpty():
        return whole, {}
    roots = F.transform(F.sequence(F.lit(0), F.lit(DIVISIONS - 1)), lambda d: F.shiftleft(d.cast("long"), TREE_BITS).bitwiseOR(name))
    large = sized.where("_count is not null").select(*columns, roots.alias("units"), roots.alias("home"))
    apart = float(np.sqrt(max(0.0, 2 * (1 - threshold))))
    cap = F.greatest(F.lit(leaf), F.floor(F.lit(UNIT) / F.col("size"))).cast("long")
    settled: dict[int, int] = {}
    for turn in range(MAX_ROUNDS):
        counts = large.select(cap.alias("cap"), F.explode("units").alias("unit")).groupBy("unit").agg(F.count("*").alias("n"), F.first("cap").alias("cap"))
        over = {r["unit"]: (r["n"], r["cap"]) for r in counts.where("n > cap").collect() if r["unit"] not in settled}  # few: rows / cap
        if not over:
            break
        if turn == MAX_ROUNDS - 1:
            settled |= {k: n for k, (n, _) in over.items()}
            break
        # The sample is the same share of every node.
        share = min(1.0, fit_rows / sum(n for n, _ in over.values()))
        asked = F.broadcast(large.sparkSession.createDataFrame([(k,) for k in over], "unit long"))
        some = large.select("node", "vec", F.explode("units").alias("unit")).join(asked, "unit")
        picked = some.where(F.pmod(F.xxhash64("node", "unit", F.lit(turn)), F.lit(1 << 30)) < share * (1 << 30)).limit(2 * fit_rows).select("unit", "vec").collect()
        by_unit: dict[int, list] = {}
        for r in picked:
            by_unit.setdefault(r["unit"], []).append(bytes(r["vec"]))
        forest = {}
        for k, v in by_unit.items():
            x, most = _matrix(pa.array(sorted(v))), over[k][1]
            tree = _grow(k, x, share, most, spill, apart, SURE) or _grow(k, x, share, most, spill, apart)
            if tree is not None:
                forest[k] = tree
            elif len(x) >= 4:
                settled[k] = over[k][0]
        if forest:
            large = stored(large.mapInArrow(_routed(forest), large.schema), "divided", free=True)
    return whole.unionByName(large), settled


def _padded(lists: list[list[int]]) -> np.ndarray:
    width = max(map(len, lists))
    return np.array([v + [-1] * (width - len(v)) for v in lists], dtype=np.int64)


def _compare(threshold: float, trees: int, leaf: int, spill: float):
    apart = float(np.sqrt(max(0.0, 2 * (1 - threshold))))

    def leaves(unit: int, x: np.ndarray) -> list[np.ndarray]:
        """The rows of each leaf, tree by tree."""
        all_rows, out = np.arange(len(x)), []
        if len(x) <= leaf:
            return [all_rows]
        for tree in range(trees):
            name = _named(tree, unit)
            grown = _grow(name, x, 1.0, leaf, spill, apart)
            if grown is None:  # compared whole: the other trees have nothing to add
                return [all_rows]
            _route(grown, name, x, all_rows, out)
        return [rows for rows, _ in out] if trees else [all_rows]

    def compare(table_: pa.Table) -> pa.Table:
        """Links of one unit, or of two blocks of it: for each node the weight it is linked to and the least node of its group."""
        unit, two = table_.column("unit")[0].as_py(), table_.column("low")[0].as_py() != table_.column("high")[0].as_py()
        ids = table_.column("node").combine_chunks()
        side = table_.column("side").to_numpy()
        order = np.lexsort((ids.field("_key").to_numpy(), ids.field("_id").to_numpy(), side))
        table_ = table_.take(pa.array(order))
        side, weight = side[order], table_.column("weight").to_numpy()
        x = _matrix(table_.column("vec"))
        homes, units = _padded(table_.column("home").to_pylist()), _padded(table_.column("units").to_pylist())
        at_home = (homes == unit).any(axis=1)
        n, cut = len(side), int((side == 0).sum())
        whole = two or table_.column("blocks")[0].as_py() > 1
        groups = [np.arange(n)] if whole else leaves(unit, x)
        # The leaves of each row in order: a pair that meets in several counts in the first of them.
        of_row = np.concatenate(groups)
        number = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
        place = np.lexsort((number, of_row))
        count = np.bincount(of_row, minlength=n)
        own = np.full((n, int(count.max())), -1, dtype=np.int32)
        own[np.arange(own.shape[1])[None, :] < count[:, None]] = number[place]
        linked, group = np.zeros(n, dtype=np.int64), np.arange(n)

        def count_pairs(a, b, here):
            nonlocal group
            if len(groups) > 1:
                for p in range(own.shape[1]):  # most pairs met in the first tree already, and go at once
                    met = own[a, p]
                    early = (met >= 0) & (met < here)
                    if not early.any():
                        break
                    early[early] = (own[b[early]] == met[early][:, None]).any(axis=1)
                    a, b = a[~early], b[~early]
            if units.shape[1] > 1:
                # A pair counts in the first unit that is the own one of either and holds the other.
                keep = at_home[a] | at_home[b]
                a, b = a[keep], b[keep]
                early = np.zeros(len(a), dtype=bool)
                for one, other in ((a, b), (b, a)):
                    for d in range(homes.shape[1]):
                        h = homes[one, d]
                        early |= (h >= 0) & (h < unit) & (units[other] == h[:, None]).any(axis=1)
                a, b = a[~early], b[~early]
            np.add.at(linked, a, weight[b])
            np.add.at(linked, b, weight[a])
            open_ = group[a] != group[b]
            while open_.any():
                a, b = a[open_], b[open_]
                # The roots are linked, so that what hangs on them comes along.
                one, other = group[a], group[b]
                low = np.minimum(one, other)
                np.minimum.at(group, one, low)
                np.minimum.at(group, other, low)
                while (group[group] != group).any():
                    group = group[group]
                open_ = group[a] != group[b]

        for here, rows in enumerate(groups):
            first, second = (rows[rows < cut], rows[rows >= cut]) if two else (rows, rows)
            own_side = np.ones(len(first), dtype=bool) if two or units.shape[1] == 1 else at_home[first]
            # Those at home first: all pairs with them, and of pairs of them each once.
            first, second = (first, second) if two else (first[own_side], np.concatenate([first[own_side], first[~own_side]]))
            for lo in range(0, len(first), 256):
                some = first[lo : lo + 256]
                for at in range(0 if two else lo, len(second), 1 << 13):
                    others = second[at : at + (1 << 13)]
                    i, j = np.nonzero(x[some] @ x[others].T >= threshold)
                    if not two:
                        keep = i + lo < j + at
                        i, j = i[keep], j[keep]
                    for k in range(0, len(i), 1 << 16):
                        count_pairs(some[i[k : k + (1 << 16)]], others[j[k : k + (1 << 16)]], here)
        has = np.flatnonzero(linked > 0)
        node = table_.column("node")
        return pa.table({"node": node.take(pa.array(has)), "root": node.take(pa.array(group[has])), "n": pa.array(linked[has])})

    return compare


def _met(units: DataFrame, large: dict[int, int]) -> DataFrame:
    """A row for each unit of a vector; the blocks of a unit too large for one task meet pairwise, each pair in a task of its own."""
    spark = units.sparkSession
    met = units.select("node", "weight", "vec", "home", "units", F.explode("units").alias("unit"))
    blocks = F.lit(1)
    if large:
        sizes = spark.createDataFrame([(k, -(-n // BLOCK)) for k, n in large.items()], "unit long, _blocks int")
        met, blocks = met.join(F.broadcast(sizes), "unit", "left"), F.coalesce("_blocks", F.lit(1))
    met = met.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other").cast("int").alias("low"), F.greatest("block", "other").cast("int").alias("high")
    side = F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side")
    return met.select("node", "weight", "vec", "home", "units", "unit", "blocks", low, high, side)


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", threshold: float = 0.98,
    trees: int = 8, leaf: int = 512, spill: float = 0.1, fit_rows: int = 20_000,
) -> DataFrame:
    """One row for each distinct vector row: the id under its name, n_links, component_id, kept. Without ``label_col`` all rows are compared."""
    spark = vectors.sparkSession
    label = F.lit("") if label_col is None else F.col(label_col).cast("string")
    rows = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), F.col(vector_col).cast("array<double>").alias("_v"), F.col(vector_col).cast("array<float>").alias("_f"), label.alias("_label"))
    bad = F.exists("_v", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    norm = F.aggregate("_v", F.lit(0.0), lambda s, v: s + v * v)
    valid = F.coalesce(F.col("_label").isNotNull() & (F.size("_v") > 0) & ~bad & (norm > 0) & (norm < float("inf")), F.lit(False))
    key = F.xxhash64("_label", "_f")
    # 128 bits of label and vector stand for them in all that follows, so that vectors are dealt out once.
    both = F.struct(key.alias("a"), F.xxhash64(F.lit("other"), "_label", "_f").alias("b"))
    part = F.struct("_label", F.size("_f").alias("size"))
    rows = rows.select(F.struct("_id", key.alias("_key")).alias("own"), valid.alias("_valid"), both.alias("h"), part.alias("part"), "_f")
    members = stored(rows.select("own", "_valid", "h").dropDuplicates(["own"]), "members", free=True)

    def packed(batches):
        for batch in batches:
            vec = [np.array(v, dtype="<f4").tobytes() for v in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(vec, pa.binary())], names=["h", "part", "vec"])

    types = dict(rows.dtypes)
    vecs = rows.where("_valid").select("h", "part", "_f").mapInArrow(packed, f"h {types['h']}, part {types['part']}, vec binary")
    vecs = vecs.groupBy("h").agg(F.first("part").alias("part"), F.first("vec").alias("vec"))
    counted = members.where("_valid").groupBy("h").agg(F.min("own").alias("node"), F.count("*").alias("weight"))
    classes = stored(counted.join(vecs, "h").select("h", "node", "weight", "vec", "part"), "classes", free=True)
    units, large = _units(classes, leaf, spill, fit_rows, threshold)
    n, met_rows = units.agg(F.count("*"), F.sum(F.size("units"))).first()
    met_rows = (met_rows or 0) + sum(size * (-(-size // BLOCK) - 1) for size in large.values())
    # What is dealt out at once is at most about ROWS_DEALT rows a vector; its files go before the next share.
    shares = max(1, -(-met_rows // max(1, ROWS_DEALT * n)))
    met, dealt = _met(units, large), ["unit", "low", "high"]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    found = None
    for k in range(shares):
        some = met.where(F.pmod(F.xxhash64(*dealt), F.lit(shares)) == k) if shares > 1 else met
        links = some.repartition(tasks, *dealt).groupBy(*dealt).applyInArrow(_compare(threshold, trees, leaf, spill), f"node {types['own']}, root {types['own']}, n long")
        links = stored(links, "found", free=True)
        found = links if found is None else found.unionByName(links)
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("n").alias("n"))
    named = classes.select("h", "node", "weight").join(links, "node", "left").join(roots, "node", "left")
    named = named.select("h", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"), F.col("weight").alias("_count"))
    named = stored(named, "named", free=True)
    valid = members.where("_valid").select("own", "h")
    linked = join_hot(valid, named, "h", members.count()).select("own", "n_links", F.col("root._id").alias("root"))
    alone = members.where("not _valid").select("own", F.lit(0).cast("long").alias("n_links"), F.col("own._id").alias("root"))
    out = linked.unionByName(alone).select(F.col("own._id").alias("_id"), "n_links", "root")
    return out.select(shown_id().alias(id_col), "n_links", shown_id("root").alias("component_id"), (F.col("_id") == F.col("root")).alias("kept"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
n AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS s FROM v
      WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_dot_product(a.e, b.e) / (a.s * b.s) >= 0.98),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.y FROM r JOIN l ON l.x = r.b),
m AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
k AS (SELECT x AS vec_id, count(*) AS n_links FROM l GROUP BY x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM m LEFT JOIN k USING (vec_id)
"""


@query("op10_vector_dedup", SQL)
def op10(spark, sf_dir) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
