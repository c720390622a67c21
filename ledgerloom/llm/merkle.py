"""Merkle manifest of a dataset: a binary tree of hashes for each group of rows, one over the groups, and a proof for each row.

A leaf is the hash of a row's fields. The leaves of a group are ordered by id;
while more than one node remains, every two consecutive ones become the hash of
both, a last one alone the hash of itself. What remains is the group's subroot;
the subroots, in the order of the groups, give the root the same way.

Built levels are stored as rows that name their parent. A row reaches ``stride``
levels up: it holds the siblings met on that way (at most one a level), so that
2**stride rows of one block are hashed together and a climb takes few steps. The
climb is a recursive query: it starts at all leaves, each with the hash claimed
for its row, and joins the parent's row until there is none, appending siblings
and folding the hash. Where a group's tree ends, the row goes on through the tree
over the groups. Compared with the root, the fold tells whether the row is
the one that went into the tree.

Places in a group come from range partitions: rows before a partition plus the
place within it, so a group that holds most rows is spread over tasks. Far up many
rows climb to one node; the join there is broadcast while the node table is small,
and split by adaptive skew joins beyond that.

Nulls: a null field is ``-``, which no value can give, as values carry their
length; a null id comes before all others, a null group is a group of its own and
comes first. Equal ids are ordered by their leaf; rows that repeat are leaves each
of its own, with the same proof or not. An empty table has no root and no rows.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .registry import query, table
from .storage import stored

STRIDE = 9
TOP = "/"  # the tree over the groups; a group's own tree is '' (null) or '=' and its name
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


@dataclass
class Manifest:
    leaves: DataFrame  # the rows' payload in ``item``, leaf, place in the group, siblings, parent
    nodes: DataFrame  # rows above the leaves
    root: str | None
    steps: int  # rows that the longest climb joins


def leaf_hash(values: list[Column]) -> Column:
    """Hash of values, each as its length in bytes, ``:`` and itself, or ``-`` where it is null."""
    shown = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in shown]), 256)


def digits(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``place`` (gapless from 0) and ``size`` (rows) within each ``tree``."""
    ranged = stored(rows.repartitionByRange("tree", *order).withColumn("_part", F.spark_partition_id()), "merkle-ranged")
    counts = ranged.groupBy("tree", "_part").agg(F.count("*").alias("_n"))
    earlier = W.partitionBy("tree").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("tree", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"), F.sum("_n").over(W.partitionBy("tree")).alias("size"))
    number = F.row_number().over(W.partitionBy("tree", "_part").orderBy(*order)) - 1
    return ranged.withColumn("_number", number).join(starts, ["tree", "_part"]).withColumn("place", F.col("_start") + F.col("_number")).drop("_part", "_start", "_number")


_LEVELS = """aggregate(sequence(1, steps), array(transform(members, m -> lower(hex(m.hash)))), (done, k) -> concat(done, array(
    transform(sequence(0, cast((size(element_at(done, -1)) - 1) div 2 as int)),
              i -> sha2(concat(get(element_at(done, -1), 2 * i), coalesce(get(element_at(done, -1), 2 * i + 1), '')), 256)))))"""
_SIBLINGS = """if(steps = 0, cast(array() as array<binary>),
    transform(sequence(0, steps - 1), k -> unhex(get(levels[k], cast(shiftright(m.place % {width}, k) ^ 1 as int)))))"""


def _node(level: int | None, place: Column | None) -> Column:
    """Name of a node of ``tree``; without a level its group's leaf in the tree over the groups."""
    return F.concat(F.lit("top:"), "tree") if level is None else F.concat(F.lit(f"{level}:"), place.cast("string"), F.lit(":"), "tree")


def _linked(rows: DataFrame, level: int, stride: int, top: bool) -> DataFrame:
    """The node rows of one level: hash, siblings of the next levels, parent, and with the first of a block the hash it leads to.

    ``rows``: tree, place, size, hash, item. ``top``: the way ends at the root instead of going on in the tree over the groups.
    """
    width = 1 << stride
    steps = F.when(F.col("size") > 1, F.least(F.lit(stride), F.length(F.bin(F.col("size") - 1)))).otherwise(0)
    blocks = rows.groupBy("tree", F.floor(F.col("place") / width).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("place", "hash", "item"))).alias("members"), F.max("size").alias("size")
    )
    blocks = blocks.withColumn("steps", steps).withColumn("levels", F.expr(f"if(steps = 0, array(transform(members, m -> lower(hex(m.hash)))), {_LEVELS})"))
    out = blocks.select("*", F.explode("members").alias("m")).withColumn("siblings", F.expr(_SIBLINGS.format(width=width)))
    left = F.ceil(F.col("size") / F.pow(F.lit(2.0), "steps")).cast("long")  # nodes of the tree that remain
    end = F.lit(None).cast("string") if top else _node(None, None)
    leads_to = F.when(F.col("m.place") % width == 0, F.unhex(F.col("levels")[F.col("steps")][0]))
    return out.select(
        "tree", F.col("m.place").alias("place"), F.col("m.hash").alias("hash"), F.col("m.item").alias("item"), "siblings", "steps",
        F.when(left > 1, _node(level + stride, F.col("block"))).otherwise(end).alias("parent"), leads_to.alias("leads_to"), left.alias("left"), F.col("block").cast("long").alias("block"),
    )


def _built(rows: DataFrame, stride: int, top: bool) -> tuple[list[DataFrame], DataFrame]:
    """The linked rows of all levels, and (tree, hash) of what remains of each tree."""
    most = rows.agg(F.max("size")).first()[0] or 1
    levels = []
    for k in range(max(1, math.ceil((most - 1).bit_length() / stride))):
        if k:
            below = levels[-1].where("left > 1 and leads_to is not null")
            rows = below.select("tree", F.col("block").alias("place"), F.col("left").alias("size"), F.col("leads_to").alias("hash"), F.lit(None).cast("string").alias("item"))
        levels.append(stored(_linked(rows, k * stride, stride, top), "merkle-level"))
    done = [x.where("left = 1 and leads_to is not null").select("tree", F.col("leads_to").alias("hash")) for x in levels]
    return levels, functools.reduce(DataFrame.unionByName, done)


def merkle_manifest(rows: DataFrame, leaf: Column, id_col: str, group_col: str, item: Column, stride: int = STRIDE) -> Manifest:
    """The tree of ``rows``, ordered by ``id_col`` within ``group_col``; ``item`` travels with each leaf."""
    tree = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    own = stored(rows.select(tree.alias("tree"), F.col(id_col).alias("_id"), F.unhex(leaf).alias("hash"), item.alias("item")), "merkle-leaves")
    (leaves, *nodes), subroots = _built(_placed(own, ["_id", "hash"]).drop("_id"), stride, top=False)
    # The subroots are the leaves of the tree over the groups; each is found by its group's name.
    groups = _placed(subroots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("item"), "hash"), ["item"])
    (lowest, *higher), last = _built(groups, stride, top=True)
    root = last.first()
    kept = ["node", "way", "siblings", "parent", "subroot"]
    over = lowest.select(F.col("item").alias("tree"), F.col("place").alias("way"), "siblings", "parent", F.col("hash").alias("subroot"))
    entries = over.withColumn("node", _node(None, None)).select(*kept)
    none = F.lit(None).cast("binary").alias("subroot")
    for k, more in enumerate(nodes, 1):
        more = more.withColumn("node", _node(k * stride, F.col("place")))
        entries = entries.unionByName(more.where("left > 1").select("node", F.col("place").alias("way"), "siblings", "parent", none))
        # Where a group's tree ends, the way goes on at once in the tree over the groups.
        o = over.select("tree", *[F.col(c).alias(f"o_{c}") for c in over.columns if c != "tree"])
        through = more.where("left = 1").join(o, "tree")
        way = F.col("place") + F.col("o_way") * F.pow(F.lit(2.0), "steps").cast("long")
        entries = entries.unionByName(through.select("node", way.alias("way"), F.concat("siblings", "o_siblings").alias("siblings"), F.col("o_parent").alias("parent"), F.col("o_subroot").alias("subroot")))
    for k, more in enumerate(higher, 1):
        entries = entries.unionByName(more.select(_node(k * stride, F.col("place")).alias("node"), F.col("place").alias("way"), "siblings", "parent", none))
    return Manifest(leaves, stored(entries, "merkle-nodes"), digest_text(root), len(nodes) + 1 + len(higher))


def digest_text(row) -> str | None:
    return bytes(row["hash"]).hex() if row else None


def _folded(start: str, siblings: str, way: str) -> str:
    return f"""if(size({siblings}) = 0, {start}, aggregate(sequence(0, size({siblings}) - 1), {start}, (h, k) ->
        unhex(sha2(lower(case when get({siblings}, k) is null then hex(h) when (shiftright({way}, k) & 1) = 0
                   then concat(hex(h), hex(get({siblings}, k))) else concat(hex(get({siblings}, k)), hex(h)) end), 256))))"""


_JOINED = "aggregate({0}, cast('' as binary), (a, s) -> concat(a, coalesce(s, cast('' as binary))))"


def climbed(manifest: Manifest, claimed: Column, shown: list[str]) -> DataFrame:
    """``shown`` for each leaf, expressions over: item, leaf, subroot, proof (the siblings' digests, lowest first) and folded,
    the root that ``claimed`` leads to; digests are bytes.

    ``claimed``: the leaf to fold, an expression over item and hash.
    """
    spark = manifest.leaves.sparkSession
    leaves = manifest.leaves.withColumn("claimed", claimed)
    recursive = f"""
        WITH RECURSIVE climb(item, leaf, subroot, folded, proof, parent) MAX RECURSION LEVEL {manifest.steps + 1} AS (
            SELECT item, hash, cast(null AS binary), {_folded("claimed", "siblings", "place")}, {_JOINED.format("siblings")}, parent FROM {{leaves}}
            UNION ALL
            SELECT c.item, c.leaf, coalesce(n.subroot, c.subroot), {_folded("c.folded", "n.siblings", "n.way")},
                   concat(c.proof, {_JOINED.format("n.siblings")}), n.parent
            FROM climb c JOIN {{nodes}} n ON c.parent = n.node)
        SELECT {", ".join(shown)} FROM climb WHERE parent IS NULL"""
    # The limit on rows of a recursion guards against endless ones; this one ends at the root.
    limit = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    try:
        return stored(spark.sql(recursive, leaves=leaves, nodes=manifest.nodes), "merkle-climb")
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", limit)


#: Unsigned CRC-32 of the decimal doc_id, bit by bit.
_CRC = """(xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(length(doc_id::VARCHAR)),
        lambda i: list_prepend(ascii(substr(doc_id::VARCHAR, i + 1, 1))::BIGINT + 1, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[])))),
        lambda c, x: CASE WHEN x > 0 THEN xor(c, x - 1) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295))"""


def _sql_leaf(n_chars: str) -> str:
    values = ["doc_id::VARCHAR", "source", "lang", f"({n_chars})::VARCHAR", "text"]
    return "sha256(" + " || ".join(f"coalesce(strlen({v})::VARCHAR || ':' || {v}, '-')" for v in values) + ")"


_SQL = f"""
WITH RECURSIVE leaves AS (
    SELECT doc_id, coalesce('=' || lang, '') AS tree, {_sql_leaf("n_chars")} AS leaf,
           CASE WHEN {_CRC} % 7 = 0 THEN {_sql_leaf("n_chars + 1")} ELSE {_sql_leaf("n_chars")} END AS claimed
    FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves),
levels(tree, level, place, hash, size) AS (
    SELECT tree, 0, place, leaf, count(*) OVER (PARTITION BY tree) FROM placed
    UNION ALL
    SELECT tree, level + 1, place // 2, sha256(string_agg(hash, '' ORDER BY place)), (any_value(size) + 1) // 2
    FROM levels WHERE size > 1 GROUP BY tree, level, place // 2),
groups AS (SELECT tree, hash, row_number() OVER (ORDER BY tree::BLOB) - 1 AS place FROM levels WHERE size = 1),
tops(level, place, hash, size) AS (
    SELECT 0, place, hash, count(*) OVER () FROM groups
    UNION ALL
    SELECT level + 1, place // 2, sha256(string_agg(hash, '' ORDER BY place)), (any_value(size) + 1) // 2
    FROM tops WHERE size > 1 GROUP BY level, place // 2),
every AS (SELECT tree, level, place, hash, size FROM levels UNION ALL SELECT '/', level, place, hash, size FROM tops),
climb(doc_id, leaf, own, tree, level, place, folded, proof) AS (
    SELECT doc_id, leaf, tree, tree, 0, place, claimed, '' FROM placed
    UNION ALL
    SELECT c.doc_id, c.leaf, c.own,
           CASE WHEN e.size = 1 THEN '/' ELSE c.tree END, CASE WHEN e.size = 1 THEN 0 ELSE c.level + 1 END, CASE WHEN e.size = 1 THEN g.place ELSE c.place // 2 END,
           CASE WHEN e.size = 1 THEN c.folded WHEN s.hash IS NULL THEN sha256(c.folded)
                WHEN c.place % 2 = 0 THEN sha256(c.folded || s.hash) ELSE sha256(s.hash || c.folded) END,
           c.proof || CASE WHEN e.size = 1 THEN '' ELSE coalesce(s.hash, '') END
    FROM climb c JOIN every e ON e.tree = c.tree AND e.level = c.level AND e.place = c.place
    LEFT JOIN every s ON s.tree = c.tree AND s.level = c.level AND s.place = xor(c.place, 1::BIGINT)
    LEFT JOIN groups g ON g.tree = c.own
    WHERE NOT (c.tree = '/' AND e.size = 1))
SELECT c.doc_id, c.leaf, g.hash AS subroot, t.hash AS root, sha256(c.proof) AS proof_sha256, c.folded AS folded_root, c.folded = t.hash AS verified
FROM climb c JOIN tops t ON t.size = 1 AND c.tree = '/' AND c.level = t.level JOIN groups g ON g.tree = c.own
"""


@query("op13_merkle_manifest", _SQL)
def op13(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    values = {f: F.col(f) for f in FIELDS}
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = values | {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    changed = F.when(tampered, F.unhex(leaf_hash(list(more.values()))))
    manifest = merkle_manifest(docs, leaf_hash(list(values.values())), "doc_id", "lang", F.struct("doc_id", changed.alias("changed")))
    shown = ["item.doc_id", "leaf", "subroot", "unhex(sha2(lower(hex(proof)), 256)) AS proof", "folded"]
    out = climbed(manifest, F.coalesce("item.changed", "hash"), shown)
    root = F.lit(manifest.root).cast("string")
    return out.select(
        "doc_id", digits(F.col("leaf")).alias("leaf"), digits(F.col("subroot")).alias("subroot"), root.alias("root"), digits(F.col("proof")).alias("proof_sha256"),
        digits(F.col("folded")).alias("folded_root"), (digits(F.col("folded")) == root).alias("verified"),
    )
