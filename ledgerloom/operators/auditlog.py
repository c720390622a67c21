"""Stored audit log: entries, the states of their segments, and a tree of hashes over the states.

An append writes, each into a folder of its own number: the entries, one state for
every segment it touched (first and last number, entries, head), the last state of
every chain, the tree's new nodes and a record with the number of states and the
root. It reads the last states and the tree's open end, never the entries. A repeated
append changes nothing.

States are numbered in the order of appends. ``FAN`` of them are hashed into a node,
``FAN`` nodes into one above, and so on; only full nodes are stored, so no node ever
changes. The root is the hash of all nodes and states that have no parent yet (less
than ``FAN`` on each level). A state is proven by the siblings on its way up, an
older root by its open ends, which must still stand in the tree. What a segment's
own hash chain cannot show, a segment that is gone, changed whole, or never was
appended, shows as a difference between the log and the states.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import drop_folder
from .audit import CHAIN, SEALED, SEGMENT, append_chain, chain_checks, chain_ends, segment_states
from .shaping import numbered, salted_join

FAN = 64
NODE = T.StructType([T.StructField("level", T.IntegerType()), T.StructField("number", T.LongType()), T.StructField("hash", T.StringType())])
STATE = T.StructType([
    T.StructField("chain_id", T.StringType()),
    T.StructField("segment", T.LongType()),
    T.StructField("first_seq", T.LongType()),
    T.StructField("last_seq", T.LongType()),
    T.StructField("entries", T.LongType()),
    T.StructField("head", T.StringType()),
])
LEAF = T.StructType([*STATE.fields, T.StructField("number", T.LongType()), T.StructField("leaf", T.StringType())])
RECORD = T.StructType([T.StructField("size", T.LongType()), T.StructField("root", T.StringType()), T.StructField("open", T.ArrayType(NODE))])
EMPTY = Row(size=0, root=hashlib.sha256(b"0").hexdigest(), open=[])


@dataclass
class StoredLog:
    entries: DataFrame
    states: DataFrame  # with number and leaf
    nodes: DataFrame  # full nodes above the states
    record: Row  # size, root, open


def _batched(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("batch", T.LongType())])


def _part(folder: str, name: str, number: int) -> str:
    return f"{folder}/{name}/batch={number}"


def _earlier(spark: SparkSession, folder: str, name: str, schema: T.StructType, number: int) -> DataFrame:
    """Rows of the appends before ``number``; none before the first."""
    if number == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(_batched(schema)).parquet(f"{folder}/{name}").where(F.col("batch") < number).drop("batch")


def leaf_hash() -> Column:
    return F.sha2(F.concat_ws("|", F.lit("state"), *[F.col(c).cast("string") for c in ("number", *CHAIN, *SEALED)]), 256)


def _node_hash(level: Column, number: Column, children: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit("node"), level.cast("string"), number.cast("string"), F.array_join(children, "|")), 256)


def _root(size: int, open_nodes: list) -> str:
    """Hash of the number of states and the open nodes, highest level first."""
    ordered = sorted(open_nodes, key=lambda n: (-n["level"], n["number"]))
    return hashlib.sha256("|".join([str(size), *(n["hash"] for n in ordered)]).encode()).hexdigest()


def _is_open(size: int) -> Column:
    """Nodes of a tree over ``size`` states that have no parent."""
    out, level = F.lit(False), 0
    while size:
        out = out | ((F.col("level") == level) & (F.col("number") >= size // FAN * FAN) & (F.col("number") < size))
        size, level = size // FAN, level + 1
    return out


def _all_nodes(states: DataFrame, nodes: DataFrame) -> DataFrame:
    return states.select(F.lit(0).alias("level"), "number", F.col("leaf").alias("hash")).unionByName(nodes.select("level", "number", "hash"))


def _parents(children: DataFrame) -> DataFrame:
    """The full nodes above ``children`` (level, number, hash)."""
    grouped = children.groupBy((F.col("level") + 1).alias("level"), F.floor(F.col("number") / FAN).alias("number")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("number").alias("at"), "hash"))).alias("_in")
    )
    hashed = _node_hash(F.col("level"), F.col("number"), F.transform("_in", lambda c: c["hash"]))
    return grouped.where(F.size("_in") == FAN).select("level", "number", hashed.alias("hash"))


def in_order(new: DataFrame, ends: DataFrame, late: str = "refuse") -> DataFrame:
    """The rows with numbers behind the last one of their chain.

    A chain whose new rows start at or below its stored end is refused, or with
    ``late="renumber"`` its new rows are moved behind the end as they stand.
    """
    lows = new.groupBy("chain_id").agg(F.min("seq").alias("_low")).join(ends.select("chain_id", "last_seq"), "chain_id", "left")
    shift = F.when(F.col("_low") <= F.col("last_seq"), F.col("last_seq") + 1 - F.col("_low")).otherwise(0)
    shifts = lows.select("chain_id", shift.alias("_shift"))
    if late == "refuse":
        n = shifts.where("_shift > 0").count()
        if n:
            raise ValueError(f"rows of {n} chains are not behind the stored end")
        return new
    return salted_join(new, shifts, ["chain_id"], "seq").withColumn("seq", F.col("seq") + F.col("_shift")).drop("_shift").select(new.columns)


def append_log(spark: SparkSession, folder: str, new: DataFrame, number: int, late: str = "refuse", segment: int = SEGMENT) -> Row:
    """Append rows (chain_id, seq and the entry columns) as append ``number``, counted from 0; returns the new record.

    The record is written last: an append that has one is complete, and asking for it
    again changes nothing; one that was broken off writes over its own folders.
    One writer at a time. Keep the records somewhere else as well: whoever can
    write all folders could cut off the last appends, which only an older record shows.
    """
    complete = appends(spark, folder)
    if number < complete:
        return record_of(spark, folder, number)
    if number > complete:
        raise ValueError(f"append {complete} comes before {number}")
    before = record_of(spark, folder, number - 1) if number else EMPTY
    ends = spark.read.schema(STATE).parquet(_part(folder, "ends", number - 1)) if number else spark.createDataFrame([], STATE)

    def write(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(_part(folder, name, number))
        return spark.read.schema(df.schema).parquet(_part(folder, name, number))

    entries = write(append_chain(in_order(new, ends, late), ends, segment), "entries")
    entries.write.mode("overwrite").json(_part(folder, "lines", number))
    old = ends.select(*CHAIN, F.col("first_seq").alias("_first"), F.col("entries").alias("_entries"))
    states = segment_states(entries).join(old, CHAIN, "left").select(
        *CHAIN, F.coalesce("_first", "first_seq").alias("first_seq"), "last_seq", (F.col("entries") + F.coalesce("_entries", F.lit(0))).alias("entries"), "head"
    )
    leaves = numbered(states, CHAIN, "audit-states").withColumn("number", F.col("number") + before["size"])
    leaves = write(leaves.withColumn("leaf", leaf_hash()), "states")
    write(chain_ends(ends.unionByName(leaves.select(ends.columns))), "ends")

    size = before["size"] + leaves.count()
    earlier = _all_nodes(_earlier(spark, folder, "states", LEAF, number), _earlier(spark, folder, "nodes", NODE, number))
    layer, added, (had, has) = leaves.select(F.lit(0).alias("level"), "number", F.col("leaf").alias("hash")), [], (before["size"], size)
    while has // FAN > had // FAN:
        level = len(added)
        waiting = earlier.where((F.col("level") == level) & (F.col("number") >= had // FAN * FAN))
        added.append(f"{folder}/new-nodes/{number}/{level + 1}")
        _parents(waiting.unionByName(layer)).write.mode("overwrite").parquet(added[-1])
        layer = spark.read.schema(NODE).parquet(added[-1])
        had, has = had // FAN, has // FAN
    nodes = write(spark.read.schema(NODE).parquet(*added) if added else spark.createDataFrame([], NODE), "nodes")
    drop_folder(spark, f"{folder}/new-nodes/{number}")

    every = earlier.unionByName(_all_nodes(leaves, nodes))
    open_nodes = every.where(_is_open(size)).collect()  # less than FAN a level
    record = Row(size=size, root=_root(size, open_nodes), open=open_nodes)
    spark.createDataFrame([record], RECORD).coalesce(1).write.mode("overwrite").parquet(_part(folder, "records", number))
    if number:
        drop_folder(spark, _part(folder, "ends", number - 1))
    return record


def record_of(spark: SparkSession, folder: str, number: int) -> Row:
    return spark.read.schema(RECORD).parquet(_part(folder, "records", number)).first()


def appends(spark: SparkSession, folder: str) -> int:
    """How many appends are complete; the number of the next one."""
    try:
        return spark.read.schema(_batched(RECORD)).parquet(f"{folder}/records").agg(F.max("batch")).first()[0] + 1
    except AnalysisException:
        return 0


def stored_log(spark: SparkSession, folder: str, number: int | None = None) -> StoredLog:
    """The log after append ``number``, by default the last one."""
    last = appends(spark, folder) - 1 if number is None else number
    entries = spark.read.parquet(f"{folder}/entries").where(F.col("batch") <= last).drop("batch")
    states, nodes = (_earlier(spark, folder, name, schema, last + 1) for name, schema in (("states", LEAF), ("nodes", NODE)))
    return StoredLog(entries, states, nodes, record_of(spark, folder, last))


CHECKS = ["broken", "missing_segments", "changed_segments", "unknown_segments", "broken_states", "missing_states", "broken_nodes"]


def verify_log(log: StoredLog) -> DataFrame:
    """One row: entries, what is wrong with them, the segments, the states and the tree, root_ok, is_valid.

    Segments are compared with their last state: missing, changed, or unknown to
    the states. Nodes are computed again from what lies below them.
    """
    entries = chain_checks(log.entries).agg(F.count("*").alias("entries"), F.count_if(~(F.col("hash_ok") & F.col("link_ok"))).alias("broken"))
    then = log.states.groupBy(*CHAIN).agg(F.max_by(F.struct(*SEALED), "number").alias("then"))
    now = segment_states(log.entries).select(*CHAIN, F.struct(*SEALED).alias("now"))
    differ = F.col("now").isNotNull() & F.col("then").isNotNull() & ~F.col("now").eqNullSafe(F.col("then"))
    segments = now.join(then, CHAIN, "full").agg(
        F.count_if(F.col("now").isNull()).alias("missing_segments"), F.count_if(differ).alias("changed_segments"), F.count_if(F.col("then").isNull()).alias("unknown_segments")
    )
    size = log.record["size"]
    inside = F.col("number").between(0, size - 1)
    states = log.states.agg(
        F.count_if(~inside | (F.col("leaf") != leaf_hash())).alias("broken_states"), (F.lit(size) - F.count_distinct(F.when(inside, F.col("number")))).alias("missing_states")
    )
    every = _all_nodes(log.states, log.nodes)
    again = _parents(every).select("level", "number", F.col("hash").alias("again"))
    nodes = log.nodes.join(again, ["level", "number"], "full").agg(F.count_if(~F.col("hash").eqNullSafe(F.col("again"))).alias("broken_nodes"))
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("level")).alias("level"), "number", "hash")))
    opened = F.sha2(F.concat_ws("|", F.lit(str(size)), F.transform(ordered, lambda n: n["hash"])), 256)
    root = every.where(_is_open(size)).agg((opened == log.record["root"]).alias("root_ok"))
    rows = entries
    for part in (segments, states, nodes, root):
        rows = rows.unionByName(part, allowMissingColumns=True)
    out = rows.agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("entries", *CHECKS, "root_ok")])
    wrong = sum((F.col(c) for c in CHECKS), F.lit(0))
    return out.withColumn("is_valid", (wrong == 0) & F.col("root_ok"))


def is_consistent(old: Row, log: StoredLog) -> DataFrame:
    """One row: whether the tree of an older record is the beginning of this one.

    ``old`` is a record kept elsewhere. Full nodes never change, so all its open
    nodes must still stand in the tree, and they must give its root.
    """
    spark = log.states.sparkSession
    opened = spark.createDataFrame([tuple(n) for n in old["open"]], NODE)  # less than FAN a level
    kept = opened.join(_all_nodes(log.states, log.nodes), ["level", "number", "hash"], "left_semi").agg(F.count("*").alias("kept"))
    own = _root(old["size"], old["open"]) == old["root"] and old["size"] <= log.record["size"]
    return kept.select(F.lit(len(old["open"])).cast("bigint").alias("open_nodes"), "kept", (F.lit(own) & (F.col("kept") == len(old["open"]))).alias("is_consistent"))


def inclusion_proofs(log: StoredLog, asked: DataFrame) -> DataFrame:
    """For each ``number`` of ``asked`` the proof of that state: leaf, and for each level the hashes of the node above.

    ``path``: (level, number, hashes) of the nodes on the way up, each with all its children.
    """
    size, level = log.record["size"], 0
    every = _all_nodes(log.states, log.nodes)
    rows = asked.select("number").join(log.states.select("number", "leaf"), "number")
    path = F.array().cast("array<struct<level:int,number:bigint,hashes:array<string>>>")
    rows = rows.withColumn("path", path)
    while size >= FAN:
        here = every.where((F.col("level") == level) & (F.col("number") < size // FAN * FAN))
        groups = here.groupBy(F.floor(F.col("number") / FAN).alias("_up")).agg(F.sort_array(F.collect_list(F.struct(F.col("number").alias("at"), "hash"))).alias("_in"))
        step = F.struct(F.lit(level + 1).alias("level"), F.col("_up").alias("number"), F.transform("_in", lambda c: c["hash"]).alias("hashes"))
        up = F.floor(F.col("number") / F.lit(FAN ** (level + 1)))
        rows = rows.join(groups, up == F.col("_up"), "left").withColumn("path", F.when(F.col("_in").isNotNull(), F.concat("path", F.array(step))).otherwise(F.col("path"))).drop("_up", "_in")
        size, level = size // FAN, level + 1
    return rows


def proven(record: Row) -> Column:
    """Whether (number, leaf, path) is a proof that the state is in the tree of ``record``."""
    step = lambda h, s: F.when(F.array_contains(s["hashes"], h), _node_hash(s["level"], s["number"], s["hashes"]))
    top = F.aggregate("path", F.col("leaf"), step)
    return F.coalesce(top.isin([n["hash"] for n in record["open"]]), F.lit(False))
