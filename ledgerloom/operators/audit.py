"""Hash-chained audit log.

A log is many chains. The order of a chain is ``seq``, a unique whole number, and
a chain is cut into segments of ``SEGMENT`` numbers, each linked from 'GENESIS'.
A hash chain can only be computed in order, so the segment is the unit of work:
it never holds more than ``SEGMENT`` rows, however large the chain is. A chain
with fewer numbers than that is one plain linear chain. ``seals`` links the segments
of a chain to each other, so that a deleted segment shows, and ``chain_root`` binds
the segment heads together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import money
from .shaping import computed_once, salted_join

GENESIS = "GENESIS"
SEGMENT = 4096
ENTRY = ["id", "timestamp", "action", "tool_used", "details", "redactions_applied", "security_flags", "level"]
CHAIN = ["chain_id", "segment"]


def entry_hash(previous: Column, row: Column | None = None) -> Column:
    """SHA-256 over the previous hash and the entry, joined by '|'; NULL counts as ''."""
    field = (lambda n: F.col(n)) if row is None else (lambda n: row[n])
    values = [F.coalesce(field(n).cast("string"), F.lit("")) for n in ENTRY]
    return F.sha2(F.concat_ws("|", previous, *values), 256)


# --- events -----------------------------------------------------------------------------


def _event(df: DataFrame, keep: list[str], action: Column, tool: str, details: Column,
           redactions: Column | None = None, flags: Column | None = None, level: Column | None = None) -> DataFrame:
    zero = F.lit(0)
    return df.select(
        *keep,
        action.alias("action"),
        F.lit(tool).alias("tool_used"),
        details.alias("details"),
        (zero if redactions is None else redactions.cast("int")).alias("redactions_applied"),
        (zero if flags is None else flags.cast("int")).alias("security_flags"),
        (F.lit("INFO") if level is None else level).alias("level"),
    )


def scan_start(df: DataFrame, keep: list[str], days: Column, max_results: Column) -> DataFrame:
    details = F.format_string("Scan initiated: %s days, max %s emails", days.cast("string"), max_results.cast("string"))
    return _event(df, keep, F.lit("scan_start"), "fetch_financial_emails", details)


def email_processed(df: DataFrame, keep: list[str], email_id: Column, redactions: Column, injected: Column) -> DataFrame:
    note = F.when(injected, F.lit(" [PROMPT INJECTION DETECTED]")).otherwise(F.lit(""))
    details = F.concat(F.lit("Email "), email_id, F.lit(" processed: "), redactions.cast("string"), F.lit(" redactions"), note)
    level = F.when(injected, F.lit("CRITICAL")).otherwise(F.lit("INFO"))
    return _event(df, keep, F.lit("email_processed"), "pii_redactor", details, redactions, injected, level)


def categorized(df: DataFrame, keep: list[str], merchant: Column, amount: Column, category: Column) -> DataFrame:
    details = F.concat(F.lit("Categorized: "), merchant, F.lit(" $"), money(amount), F.lit(" -> "), category)
    return _event(df, keep, F.lit("categorize"), "categorize_transaction", details)


def anomaly_detected(df: DataFrame, keep: list[str], kind: Column, severity: Column, description: Column) -> DataFrame:
    details = F.concat(F.lit("["), kind, F.lit("/"), severity, F.lit("] "), description)
    level = (
        F.when(severity == "medium", F.lit("WARNING"))
        .when(severity.isin("high", "critical"), F.lit("CRITICAL"))
        .otherwise(F.lit("INFO"))
    )
    return _event(df, keep, F.lit("anomaly_detected"), "detect_anomalies", details, level=level)


def response_sent(df: DataFrame, keep: list[str], length: Column, leaked: Column) -> DataFrame:
    state = F.when(leaked, F.lit("PII FOUND AND REMOVED FROM OUTPUT")).otherwise(F.lit("clean"))
    details = F.concat(F.lit("Response ("), length.cast("string"), F.lit(" chars) — "), state)
    level = F.when(leaked, F.lit("CRITICAL")).otherwise(F.lit("INFO"))
    return _event(df, keep, F.lit("response_sent"), "response_sanitizer", details, flags=leaked, level=level)


def security_event(df: DataFrame, keep: list[str], kind: Column, details: Column) -> DataFrame:
    action = F.concat(F.lit("security_event:"), kind)
    return _event(df, keep, action, "security_monitor", details, flags=F.lit(1), level=F.lit("CRITICAL"))


# --- chain --------------------------------------------------------------------------------


def heads(log: DataFrame) -> DataFrame:
    """Last entry hash of every chain segment; a partial aggregate."""
    return log.groupBy(*CHAIN).agg(F.max_by("entry_hash", "seq").alias("head"))


PIECE = 64  # hashes folded at once; appending to a list copies it, so short lists are made and put together


def append_chain(new: DataFrame, ends: DataFrame | None = None, segment: int = SEGMENT) -> DataFrame:
    """Link new rows (chain_id, seq and the entry columns) after ``ends``, the last state of each chain (``chain_ends``) or a whole log.

    Each segment is folded on its own: a bounded list of rows, all segments in
    parallel. Only the last segment of a chain can go on, so the ends are all that
    is read of the stored log. A row at or below the end of its chain cannot be
    linked in order: ``late_rows`` finds such rows, ``auditlog.append_log`` refuses them.
    """
    rows = new.withColumn("segment", F.floor(F.col("seq") / F.lit(segment)))
    folded = rows.groupBy(*CHAIN).agg(F.array_sort(F.collect_list(F.struct("seq", *ENTRY))).alias("_rows"))
    if ends is None:
        folded = folded.withColumn("head", F.lit(GENESIS))
    else:
        if "entry_hash" in ends.columns:
            ends = chain_ends(segment_states(ends))
        folded = folded.join(ends.select(*CHAIN, "head"), CHAIN, "left").withColumn("head", F.coalesce("head", F.lit(GENESIS)))

    def piece(state: Column, k: Column) -> Column:
        rows = F.slice("_rows", k * PIECE + 1, F.lit(PIECE))
        made = F.aggregate(rows, F.array(state["head"]), lambda acc, row: F.concat(acc, F.array(entry_hash(F.element_at(acc, -1), row))))
        return F.struct(F.element_at(made, -1).alias("head"), F.concat(state["pieces"], F.array(made)).alias("pieces"))

    start = F.struct(F.col("head").alias("head"), F.array().cast("array<array<string>>").alias("pieces"))
    pieces = F.aggregate(F.sequence(F.lit(0), F.floor((F.size("_rows") - 1) / PIECE).cast("int")), start, piece, lambda state: state["pieces"])
    linked = computed_once(folded, [*CHAIN, "_rows"], {"_hashes": pieces})
    at = F.get("_hashes", F.floor(F.col("_at") / PIECE).cast("int"))
    return linked.select(*CHAIN, "_hashes", F.posexplode("_rows").alias("_at", "_row")).select(
        *CHAIN,
        "_row.*",
        F.get(at, F.col("_at") % PIECE + 1).alias("entry_hash"),
        F.get(at, F.col("_at") % PIECE).alias("previous_hash"),
    )


def chain_checks(log: DataFrame) -> DataFrame:
    """``log`` plus ``hash_ok`` and ``link_ok`` per row; the window spans one segment."""
    chain = W.partitionBy(*CHAIN).orderBy("seq")
    before = F.lag("entry_hash", 1, GENESIS).over(chain)
    return log.withColumn("hash_ok", F.col("entry_hash") == entry_hash(F.col("previous_hash"))).withColumn(
        "link_ok", F.col("previous_hash") == before
    )


def broken_rows(log: DataFrame) -> DataFrame:
    return chain_checks(log).where(~(F.col("hash_ok") & F.col("link_ok")))


def verify_chain(log: DataFrame) -> DataFrame:
    """One row: entries, broken entries, is_valid (an empty log is valid)."""
    bad = F.count_if(~(F.col("hash_ok") & F.col("link_ok")))
    return chain_checks(log).agg(F.count("*").alias("entries"), bad.alias("broken"), (bad == 0).alias("is_valid"))


def late_rows(new: DataFrame, stored: DataFrame) -> DataFrame:
    """The new rows whose number is not above the last stored one of their chain."""
    ends = stored.groupBy("chain_id").agg(F.max("seq").alias("_end"))
    return salted_join(new, ends, ["chain_id"], "seq").where(F.col("seq") <= F.col("_end")).drop("_end")


SEALED = ["first_seq", "last_seq", "entries", "head"]


def segment_states(log: DataFrame) -> DataFrame:
    """First and last number, entries and head of every segment; a partial aggregate."""
    return log.groupBy(*CHAIN).agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("entries"), F.max_by("entry_hash", "seq").alias("head")
    )


def chain_ends(states: DataFrame) -> DataFrame:
    """The last state of every chain, from states of segments."""
    last = F.max_by(F.struct("segment", *SEALED), F.struct("segment", "last_seq")).alias("_last")
    return states.groupBy("chain_id").agg(last).select("chain_id", "_last.*")


def seals(log: DataFrame) -> DataFrame:
    """The second level: one row for each segment of a chain, in order, each linked to the one before from 'GENESIS'.

    For chains of some thousand segments, whose list is folded in one task;
    ``auditlog`` keeps a tree over all segments of all chains instead. Store the
    seals apart from the log.
    """
    listed = segment_states(log).groupBy("chain_id").agg(F.array_sort(F.collect_list(F.struct("segment", *SEALED))).alias("_rows"))
    seal = lambda acc, r: F.sha2(F.concat_ws("|", F.element_at(acc, -1), *[r[c].cast("string") for c in ("segment", *SEALED)]), 256)
    folded = F.aggregate("_rows", F.array(F.lit(GENESIS)), lambda acc, r: F.concat(acc, F.array(seal(acc, r))))
    linked = computed_once(listed, ["chain_id", "_rows"], {"_seals": folded})
    out = linked.select("chain_id", "_seals", F.posexplode("_rows").alias("number", "_row"))
    return out.select("chain_id", "number", "_row.*", F.get("_seals", F.col("number")).alias("previous_seal"), F.get("_seals", F.col("number") + 1).alias("seal"))


def verify_seals(log: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: segments, those that are missing, those that are new or changed, breaks in the seals themselves, is_valid."""
    now = segment_states(log).select(*CHAIN, F.struct(*SEALED).alias("now"))
    then = stored.select(*CHAIN, F.struct(*SEALED).alias("then"))
    chain = W.partitionBy("chain_id").orderBy("number")
    fields = [F.col(c).cast("string") for c in ("previous_seal", "segment", *SEALED)]
    fits = (
        (F.col("seal") == F.sha2(F.concat_ws("|", *fields), 256))
        & (F.col("previous_seal") == F.lag("seal", 1, GENESIS).over(chain))
        & (F.col("number") == F.row_number().over(chain) - 1)
    )
    breaks = stored.select(F.lit(False).alias("missing"), F.lit(False).alias("changed"), (~fits).alias("break"), F.lit(0).alias("n"))
    met = now.join(then, CHAIN, "full").select(
        F.col("now").isNull().alias("missing"), (F.col("now").isNotNull() & ~F.col("now").eqNullSafe(F.col("then"))).alias("changed"), F.lit(False).alias("break"), F.lit(1).alias("n")
    )
    counted = met.unionByName(breaks).agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("segments"), *[F.count_if(F.col(c)).alias(f"{c}_segments" if c != "break" else "broken_seals") for c in ("missing", "changed", "break")]
    )
    return counted.withColumn("is_valid", F.col("missing_segments") + F.col("changed_segments") + F.col("broken_seals") == 0)


def chain_root(log: DataFrame, fan: int = 2, levels: int = 2) -> DataFrame:
    """Digest over all segment heads, as a tree.

    A leaf is the hash of chain, segment and head; leaves are grouped by the first
    ``fan * levels`` hex digits, hashed in order, and each level above drops
    ``fan`` digits. No group above the leaves has more than 16 ** fan members.
    """
    leaf = F.sha2(F.concat_ws("|", "chain_id", F.col("segment").cast("string"), "head"), 256)
    nodes = heads(log).select(leaf.alias("digest")).withColumn("path", F.left("digest", F.lit(fan * levels)))
    for level in range(levels, -1, -1):
        nodes = nodes.groupBy("path").agg(
            F.sha2(F.array_join(F.array_sort(F.collect_list("digest")), "|"), 256).alias("digest"),
        )
        nodes = nodes.withColumn("path", F.left("path", F.lit(max(fan * (level - 1), 0))))
    return nodes.select(F.col("digest").alias("root"))


# --- reads ----------------------------------------------------------------------------------


def audit_entries(log: DataFrame, count: int = 50, level: str | None = None) -> DataFrame:
    """The newest ``count`` entries."""
    out = log if level is None else log.where(F.col("level") == level)
    return out.orderBy(F.desc("timestamp"), F.desc("seq")).limit(count)


def _since(as_of: str, days: int) -> Column:
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    return F.to_timestamp_ntz("timestamp") >= cutoff


def security_events(log: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    return log.where((F.col("level") == "CRITICAL") & _since(as_of, days))


def audit_report(log: DataFrame, as_of: str, days: int = 7, state: DataFrame | None = None) -> DataFrame:
    """One row: counters of the period, entries per action, state of the whole log.

    ``state``: one row with ``is_valid`` (``auditlog.verify_log``, which also sees
    what is missing); without it only the entries that are there are verified.
    """
    period = log.where(_since(as_of, days))
    per_action = period.groupBy("action").agg(
        F.count("*").alias("n"),
        F.sum("redactions_applied").alias("redactions"),
        F.sum("security_flags").alias("flags"),
        F.count_if(F.col("level") == "CRITICAL").alias("critical"),
    )
    total = lambda c, cond=None: F.coalesce(F.sum(c if cond is None else F.when(cond, c)), F.lit(0))
    n = F.col("n")
    summary = per_action.agg(
        total(n).alias("total_actions"),
        total(n, F.col("action") == "email_processed").alias("emails_processed"),
        total(F.col("redactions")).alias("total_redactions"),
        total(n, F.col("action") == "anomaly_detected").alias("anomalies_found"),
        total(F.col("critical")).alias("security_events"),
        total(F.col("flags")).alias("total_security_flags"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("action", "n")))).alias("actions_breakdown"),
    )
    state = (verify_chain(log) if state is None else state).select(F.col("is_valid").alias("chain_integrity"))
    both = summary.unionByName(state, allowMissingColumns=True)
    return both.agg(F.lit(days).alias("period_days"), *[F.first(c, ignorenulls=True).alias(c) for c in both.columns])


def integrity_report(log: DataFrame, leaks: DataFrame, counts: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """One row: state of the log (as in ``audit_report``), leaked fields, table counts as a map, verdict."""
    none = F.lit(None)
    state = (verify_chain(log) if state is None else state).select("is_valid", none.cast("bigint").alias("leaks"), none.cast("map<string,bigint>").alias("tables"))
    leaked = leaks.agg(F.count("*").alias("leaks"))
    tables = counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("table_name", "n_rows")))).alias("tables"))
    rows = state.unionByName(leaked, allowMissingColumns=True).unionByName(tables, allowMissingColumns=True)
    joined = rows.agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("is_valid", "leaks", "tables")])
    return joined.select(
        F.col("is_valid").alias("chain_valid"), "leaks", "tables", (F.col("is_valid") & (F.col("leaks") == 0)).alias("passed")
    )
