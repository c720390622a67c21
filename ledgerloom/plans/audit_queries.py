"""Queries over the audit log."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators import auditlog as AL
from ..operators import ledger as L
from ..operators import redact as RD
from ..operators.shaping import shared_dir
from ..sources import views as V
from . import oracle as O
from .ledger_queries import ledger_tables
from .redaction_queries import _leak_scan_sql
from .registry import query

AS_OF = V.EVENTS_AS_OF
EVENTS = f"WITH {V.audit_events_cte()}\n"
CHAIN = f"WITH RECURSIVE {O.audit_ctes()}"


def chained(spark, sf_dir):
    return A.append_chain(V.audit_events(spark, sf_dir))


EARLY = "2024-01-15"


def kept_log(spark, sf_dir, segment: int = A.SEGMENT) -> str:
    """Folder of a log that was appended in two steps, the second one repeated."""
    folder = shared_dir(spark, "audit-log")
    events = V.audit_events(spark, sf_dir)
    for number, part in ((0, F.col("timestamp") < EARLY), (1, F.col("timestamp") >= EARLY), (1, F.col("timestamp") >= EARLY)):
        AL.append_log(spark, folder, events.where(part), number, segment=segment)
    return folder


def tampered(spark, sf_dir):
    """The chain with the details of some entries changed after the fact."""
    hit = F.col("redactions_applied") + F.col("security_flags") == 3
    return chained(spark, sf_dir).withColumn("details", F.when(hit, F.concat("details", F.lit("!"))).otherwise(F.col("details")))


@query(
    "AUD1_entry_hash",
    EVENTS
    + "SELECT id, sha256(concat_ws('|', 'GENESIS', id, timestamp, action, tool_used, details, cast(redactions_applied as varchar), cast(security_flags as varchar), level)) AS entry_hash FROM audit_events",
)
def _(spark, sf_dir):
    return V.audit_events(spark, sf_dir).select("id", A.entry_hash(F.lit("GENESIS")).alias("entry_hash"))


_EVENT_COLUMNS = ["id", "action", "tool_used", "details", "redactions_applied", "security_flags", "level"]
_INJECTED = "event_type = 'error'"
_SEVERITY = "CASE cast(event_id % 4 as int) WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END"


def _event_sql(action: str, tool: str, details: str, redactions: str = "0", flags: str = "0", level: str = "'INFO'") -> str:
    return (
        f"SELECT cast(event_id as varchar) AS id, {action} AS action, '{tool}' AS tool_used, {details} AS details,"
        f" {redactions} AS redactions_applied, {flags} AS security_flags, {level} AS level FROM events"
    )


_BUILT = "\nUNION ALL ".join([
    _event_sql("'scan_start'", "fetch_financial_emails", "concat('Scan initiated: ', cast(event_id % 90 as varchar), ' days, max 100 emails')"),
    _event_sql(
        "'email_processed'", "pii_redactor",
        f"concat('Email ', cast(event_id as varchar), ' processed: ', cast(event_id % 7 as varchar), ' redactions', CASE WHEN {_INJECTED} THEN ' [PROMPT INJECTION DETECTED]' ELSE '' END)",
        "cast(event_id % 7 as int)", f"CASE WHEN {_INJECTED} THEN 1 ELSE 0 END", f"CASE WHEN {_INJECTED} THEN 'CRITICAL' ELSE 'INFO' END",
    ),
    _event_sql("'categorize'", "categorize_transaction", "concat('Categorized: user_', cast(user_id as varchar), ' $', printf('%.2f', value), ' -> ', event_type)"),
    _event_sql(
        "'anomaly_detected'", "detect_anomalies", f"concat('[SPIKE/', {_SEVERITY}, '] ', props)",
        level=f"CASE WHEN {_SEVERITY} = 'medium' THEN 'WARNING' WHEN {_SEVERITY} = 'low' THEN 'INFO' ELSE 'CRITICAL' END",
    ),
    _event_sql(
        "'response_sent'", "response_sanitizer",
        f"concat('Response (', cast(length(props) as varchar), ' chars) — ', CASE WHEN {_INJECTED} THEN 'PII FOUND AND REMOVED FROM OUTPUT' ELSE 'clean' END)",
        flags=f"CASE WHEN {_INJECTED} THEN 1 ELSE 0 END", level=f"CASE WHEN {_INJECTED} THEN 'CRITICAL' ELSE 'INFO' END",
    ),
    _event_sql("concat('security_event:', event_type)", "security_monitor", "props", flags="1", level="'CRITICAL'"),
])


@query("AUD2_event_builders", _BUILT)
def _(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("id", F.col("event_id").cast("string"))
    injected = F.col("event_type") == "error"
    n = F.col("event_id")
    severity = F.when(n % 4 == 0, "low").when(n % 4 == 1, "medium").when(n % 4 == 2, "high").otherwise("critical")
    built = [
        A.scan_start(events, ["id"], n % 90, F.lit(100)),
        A.email_processed(events, ["id"], F.col("id"), n % 7, injected),
        A.categorized(events, ["id"], F.concat(F.lit("user_"), F.col("user_id").cast("string")), F.col("value"), F.col("event_type")),
        A.anomaly_detected(events, ["id"], F.lit("SPIKE"), severity, F.col("props")),
        A.response_sent(events, ["id"], F.length("props"), injected),
        A.security_event(events, ["id"], F.col("event_type"), F.col("props")),
    ]
    out = built[0]
    for df in built[1:]:
        out = out.unionByName(df)
    return out.select(_EVENT_COLUMNS)


@query("AUD3_verify_chain", "SELECT count(*) AS entries, 0 AS broken, true AS is_valid FROM events")
def _(spark, sf_dir):
    return A.verify_chain(chained(spark, sf_dir))


@query("AUD3_broken_rows", EVENTS + "SELECT id FROM audit_events WHERE redactions_applied + security_flags = 3")
def _(spark, sf_dir):
    return A.broken_rows(tampered(spark, sf_dir)).select("id")


@query("AUD4_append_chain", CHAIN + "\nSELECT id, chain_id, entry_hash, previous_hash FROM chain")
def _(spark, sf_dir):
    events = V.audit_events(spark, sf_dir)
    early = F.col("timestamp") < EARLY
    stored = A.append_chain(events.where(early))
    added = A.append_chain(events.where(~early), A.chain_ends(A.segment_states(stored)))
    return stored.unionByName(added).select("id", "chain_id", "entry_hash", "previous_hash")


_LEAF = "sha256(concat_ws('|', chain_id, cast(segment as varchar), head))"


@query(
    "AUD5_chain_root",
    CHAIN
    + ",\nheads AS (SELECT chain_id, segment, arg_max(entry_hash, seq) AS head FROM chain GROUP BY 1, 2),\n"
    f"leaves AS (SELECT {_LEAF} AS d FROM heads),\n"
    "l2 AS (SELECT left(d, 4) AS p, sha256(string_agg(d, '|' ORDER BY d)) AS d FROM leaves GROUP BY 1),\n"
    "l1 AS (SELECT left(p, 2) AS p, sha256(string_agg(d, '|' ORDER BY d)) AS d FROM l2 GROUP BY 1)\n"
    "SELECT sha256(string_agg(d, '|' ORDER BY d)) AS root FROM l1",
)
def _(spark, sf_dir):
    return A.chain_root(chained(spark, sf_dir))


_FIELDS = ["tool_used", "details", "action"]


@query(
    "AUD6_integrity_report",
    "WITH " + V.audit_events_cte() + ",\nleaks AS (" + _leak_scan_sql("audit_events", "id", _FIELDS) + ")\n"
    "SELECT true AS chain_valid, (SELECT count(*) FROM leaks) AS leaks, (SELECT count(*) FROM events) AS audit_rows, (SELECT count(*) FROM leaks) = 0 AS passed",
)
def _(spark, sf_dir):
    log = AL.stored_log(spark, kept_log(spark, sf_dir))
    leaks = RD.leak_scan(log.entries, "id", _FIELDS)
    report = A.integrity_report(log.entries, leaks, L.table_stats(ledger_tables(spark, sf_dir)), AL.verify_log(log))
    return report.select("chain_valid", "leaks", F.col("tables")["audit_log"].alias("audit_rows"), "passed")


@query("FLT12_audit_entries", EVENTS + "SELECT id, timestamp, level FROM audit_events WHERE level = 'WARNING' ORDER BY timestamp DESC, seq DESC LIMIT 50")
def _(spark, sf_dir):
    return A.audit_entries(V.audit_events(spark, sf_dir), 50, "WARNING").select("id", "timestamp", "level")


_PERIOD = f"cast(timestamp as timestamp) >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY"


@query("FLT13_security_events", EVENTS + f"SELECT id, timestamp, action FROM audit_events WHERE level = 'CRITICAL' AND {_PERIOD}")
def _(spark, sf_dir):
    return A.security_events(V.audit_events(spark, sf_dir), AS_OF).select("id", "timestamp", "action")


@query(
    "AGG14_audit_report",
    EVENTS.rstrip()
    + f",\np AS (SELECT * FROM audit_events WHERE {_PERIOD})\n"
    "SELECT 7 AS period_days, count(*) AS total_actions, cast(count_if(action = 'email_processed') as bigint) AS emails_processed, cast(sum(redactions_applied) as bigint) AS total_redactions,"
    " cast(count_if(action = 'anomaly_detected') as bigint) AS anomalies_found, cast(count_if(level = 'CRITICAL') as bigint) AS security_events, cast(sum(security_flags) as bigint) AS total_security_flags,"
    " (SELECT string_agg(concat(action, '=', n), ';' ORDER BY action) FROM (SELECT action, count(*) AS n FROM p GROUP BY 1)) AS actions_breakdown, true AS chain_integrity FROM p",
)
def _(spark, sf_dir):
    log = AL.stored_log(spark, kept_log(spark, sf_dir))
    out = A.audit_report(log.entries, AS_OF, state=AL.verify_log(log))
    text = F.array_join(F.transform(F.map_entries("actions_breakdown"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")
    return out.withColumn("actions_breakdown", text)


@query("SNK5_append_audit", CHAIN + "\nSELECT id, entry_hash, previous_hash FROM chain")
def _(spark, sf_dir):
    folder = kept_log(spark, sf_dir)
    table = AL.stored_log(spark, folder).entries
    lines = spark.read.schema(table.schema).option("recursiveFileLookup", True).json(folder + "/lines")
    keys = ["id", "entry_hash", "previous_hash"]
    return table.select(keys).join(lines.select(keys), keys, "left_semi")


_SEGMENTS = (
    ", g AS (SELECT DISTINCT chain_id, seq // 64 AS segment FROM audit_events),"
    " s AS (SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY segment) AS k, count(*) OVER (PARTITION BY chain_id) AS n FROM g),"
    " d AS (SELECT 'first' AS deleted, count(*) FILTER (WHERE k = 1) AS missing_segments FROM s UNION ALL SELECT 'middle', count(*) FILTER (WHERE k = n // 2 + 1) FROM s"
    " UNION ALL SELECT 'last', count(*) FILTER (WHERE k = n) FROM s)"
)


def without_segments(spark, sf_dir) -> dict[str, AL.StoredLog]:
    """The log without the first, a middle or the last segment of every chain."""
    log = AL.stored_log(spark, kept_log(spark, sf_dir, segment=64))
    chain = W.partitionBy("chain_id")
    listed = log.states.select(*A.CHAIN).distinct().withColumn("k", F.row_number().over(chain.orderBy("segment"))).withColumn("n", F.count("*").over(chain))
    which = {"first": F.col("k") == 1, "middle": F.col("k") == F.floor(F.col("n") / 2) + 1, "last": F.col("k") == F.col("n")}
    return {name: replace(log, entries=log.entries.join(listed.where(gone).select(*A.CHAIN), A.CHAIN, "left_anti")) for name, gone in which.items()}


@query("AGG14_deleted_segments", EVENTS.rstrip() + _SEGMENTS + " SELECT deleted, missing_segments, missing_segments = 0 AS chain_integrity FROM d")
def _(spark, sf_dir):
    """Each segment that is left verifies by itself; the report still says that the log is not whole."""
    out = None
    for name, log in without_segments(spark, sf_dir).items():
        state = AL.verify_log(log)
        row = A.audit_report(log.entries, AS_OF, state=state).select("chain_integrity").unionByName(state.select("missing_segments"), allowMissingColumns=True)
        row = row.agg(F.first("chain_integrity", ignorenulls=True).alias("chain_integrity"), F.first("missing_segments", ignorenulls=True).alias("missing_segments"))
        row = row.select(F.lit(name).alias("deleted"), "missing_segments", "chain_integrity")
        out = row if out is None else out.unionByName(row)
    return out


@query("AUD6_deleted_segments", EVENTS.rstrip() + _SEGMENTS + " SELECT deleted, missing_segments = 0 AS chain_valid, missing_segments = 0 AS passed FROM d")
def _(spark, sf_dir):
    counts = spark.createDataFrame([("audit_log", 0)], "table_name string, n_rows long")
    out = None
    for name, log in without_segments(spark, sf_dir).items():
        report = A.integrity_report(log.entries, log.entries.limit(0), counts, AL.verify_log(log)).select(F.lit(name).alias("deleted"), "chain_valid", "passed")
        out = report if out is None else out.unionByName(report)
    return out


_STATES = (
    EVENTS.rstrip() + f", g AS (SELECT DISTINCT timestamp >= '{EARLY}' AS late, chain_id, seq // 64 AS segment FROM audit_events),"
    " s AS (SELECT *, row_number() OVER (ORDER BY late, chain_id, segment) - 1 AS number, count(*) OVER () AS size FROM g)"
)


@query(
    "AUD5_inclusion_proofs",
    _STATES + " SELECT number, chain_id, segment, CASE WHEN number < size // 4096 * 4096 THEN 2 WHEN number < size // 64 * 64 THEN 1 ELSE 0 END AS steps, true AS proven FROM s",
)
def _(spark, sf_dir):
    """Every state of every segment with a proof that it is in the tree."""
    log = AL.stored_log(spark, kept_log(spark, sf_dir, segment=64))
    proofs = AL.inclusion_proofs(log, log.states).select("number", F.size("path").alias("steps"), AL.proven(log.record).alias("proven"))
    return log.states.select("number", "chain_id", "segment").join(proofs, "number")


@query("AUD5_consistency", _STATES + " SELECT count(*) FILTER (WHERE NOT late) AS older_size, count(*) AS size, true AS is_consistent, false AS forged FROM s")
def _(spark, sf_dir):
    """The record of the first append against the log after the second, and a record with a changed hash."""
    folder = kept_log(spark, sf_dir, segment=64)
    log, old = AL.stored_log(spark, folder), AL.record_of(spark, folder, 0)
    forged = Row(size=old["size"], root=old["root"], open=[Row(level=n["level"], number=n["number"], hash=n["hash"][::-1]) for n in old["open"]])
    found = AL.is_consistent(old, log).select("is_consistent", F.lit(None).cast("boolean").alias("forged"))
    other = AL.is_consistent(forged, log).select(F.lit(None).cast("boolean").alias("is_consistent"), F.col("is_consistent").alias("forged"))
    sizes = [F.lit(n).cast("bigint").alias(name) for n, name in ((old["size"], "older_size"), (log.record["size"], "size"))]
    return found.unionByName(other).agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("is_consistent", "forged")]).select(*sizes, "is_consistent", "forged")


@query(
    "AUD3_deleted_segments",
    EVENTS.rstrip()
    + ", g AS (SELECT DISTINCT chain_id, seq // 64 AS segment FROM audit_events), s AS (SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY segment) AS k FROM g)"
    " SELECT count(*) AS segments, count(*) FILTER (WHERE k = 2) AS missing_segments, 0 AS changed_segments, 0 AS broken_seals, count(*) FILTER (WHERE k = 2) = 0 AS is_valid FROM s",
)
def _(spark, sf_dir):
    """The second segment of every chain is gone, whole; each other segment still verifies by itself."""
    log = A.append_chain(V.audit_events(spark, sf_dir), segment=64)
    sealed = A.seals(log)
    gone = sealed.where("number = 1").select("chain_id", "segment")
    return A.verify_seals(log.join(gone, A.CHAIN, "left_anti"), sealed)


@query(
    "AUD3_deleted_seals",
    EVENTS.rstrip()
    + ", g AS (SELECT DISTINCT chain_id, seq // 64 AS segment FROM audit_events), s AS (SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY segment) AS k FROM g)"
    " SELECT count(*) AS segments, 0 AS missing_segments, count(*) FILTER (WHERE k = 1) AS changed_segments, count(*) FILTER (WHERE k > 1) AS broken_seals, count(*) = 0 AS is_valid FROM s",
)
def _(spark, sf_dir):
    """The first seal of every chain is gone: its segment is unknown, and every later seal stands at a wrong number."""
    log = A.append_chain(V.audit_events(spark, sf_dir), segment=64)
    return A.verify_seals(log, A.seals(log).where("number > 0"))
