"""Chat formatting in budgeted windows: prefix sums of turn tokens cut conversations into turn-aligned spans.

The turns of a conversation are cut where the sum of the tokens before a turn
enters the next half of the budget; a turn of more than half the budget is a span
of its own. A window shows the system turn, the last turns before its span that
fit a limited share, and the span. Only assistant texts of the span bear loss, so
every target is trained once: repeated turns are masked.

A span holds at most the budget's tokens, unless it is one turn that is longer by
itself: turns are never cut. Repeated turns have their own share on top (``history``
turns of at most ``history_tokens`` together, and the system turn).

Turns are ordered by turn (null first), role, text; turns that repeat are turns
like others. Null texts and roles are empty; a null conversation is one of its own.
The template marks turns with control strings; those inside texts and roles are
escaped by one more backslash after the ``<`` (``unescaped`` takes it away again).

Sums run over blocks of turns whose totals are carried over, so a conversation
that holds much of the table is spread over tasks; ``turn`` should count turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import join_hot
from .registry import query, table
from .storage import NO_ID, shown_id, stored

START, END = "<|im_start|>", "<|im_end|>\n"
BLOCK = 256  # numbers of turns of one block of running sums


def escaped(text: Column) -> Column:
    """``<|`` and its escapes get one more backslash: no control string is left, and no two texts become equal."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def estimated_tokens(text: Column) -> Column:
    """Four bytes a token and four tokens for the marks of a turn."""
    return F.floor((F.octet_length(text) + 3) / 4) + 4


def _running(turns: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Each value's sum over the earlier turns of the conversation, under its name."""
    totals = turns.groupBy("_conv", "_block").agg(*[F.sum(v).alias(f"_t_{k}") for k, v in values.items()], F.count("*").alias("_count"))
    earlier = W.partitionBy("_conv").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select(F.struct("_conv", "_block").alias("_at"), *[F.coalesce(F.sum(f"_t_{k}").over(earlier), F.lit(0)).alias(f"_b_{k}") for k in values])
    inside = W.partitionBy("_at").orderBy("_turn", "_role", "_text").rowsBetween(W.unboundedPreceding, -1)
    summed = turns.withColumn("_at", F.struct("_conv", "_block")).select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_s_{k}") for k, v in values.items()])
    summed = summed.join(bases, "_at")
    return summed.select(*[c for c in turns.columns], *[(F.col(f"_s_{k}") + F.col(f"_b_{k}")).alias(k) for k in values])


def chat_windows(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", tokens: Column | None = None,
    budget: int = 1024, history: int = 2, history_tokens: int = 256,
) -> DataFrame:
    """One row for each window: the conversation under its name, first (place of the span's first turn), turns (of the
    span), repeated (turns shown before it), formatted, loss (array of [start, end) in characters), tokens (of all turns shown).

    ``tokens`` counts the tokens of a turn from its columns; the default is an estimate from the bytes.
    """
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (text_col, role_col))
    count = estimated_tokens(text) if tokens is None else F.greatest(tokens, F.lit(1))
    turn = F.coalesce(F.col(turn_col).cast("long"), F.lit(NO_ID))
    rows = turns.select(F.coalesce(F.col(conv_col).cast("long"), F.lit(NO_ID)).alias("_conv"), turn.alias("_turn"), F.floor(turn / BLOCK).alias("_block"), role.alias("_role"), text.alias("_text"), count.cast("long").alias("_tokens"))
    half = budget // 2
    big = (F.col("_tokens") > half).cast("long")
    rows = _running(rows, {"_place": F.lit(1).cast("long"), "_before": F.col("_tokens"), "_bigs": big})
    # A span: the turns between two big ones whose start lies in the same half of the budget, or one big turn.
    cell = F.when(big == 1, -1 - F.col("_place")).otherwise(F.floor(F.col("_before") / half))
    shown = F.struct(F.col("_place").alias("place"), F.col("_role").alias("role"), escaped(F.col("_text")).alias("text"), F.col("_tokens").alias("tokens"))
    rows = stored(rows.select("_conv", "_place", "_role", "_tokens", "_bigs", cell.alias("_cell"), shown.alias("shown")), "turns")
    spans = rows.groupBy("_conv", "_bigs", "_cell").agg(F.array_sort(F.collect_list("shown")).alias("span"))  # at most a budget's turns
    spans = stored(spans.select("_conv", F.col("span")[0]["place"].alias("first"), "span"), "spans")
    # Each turn is offered to the spans that may begin within the next ``history`` turns.
    offers = rows.where((F.col("_tokens") <= history_tokens) & (F.col("_role") != "system"))
    offers = offers.select("_conv", F.explode(F.sequence(F.lit(1), F.lit(max(1, history)))).alias("ahead"), "shown", "_place")
    offers = offers.select("_conv", (F.col("_place") + F.col("ahead")).alias("first"), "ahead", "shown").where(F.lit(history > 0))
    offers = offers.groupBy("_conv", "first").agg(F.array_sort(F.collect_list(F.struct("ahead", "shown"))).alias("near"))
    # From the nearest on, as long as none is missing and their tokens fit.
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("used"))
    fits = F.aggregate("near", start, lambda s, x: F.when((x["ahead"] == s["n"] + 1) & (s["used"] + x["shown"]["tokens"] <= history_tokens), F.struct((s["n"] + 1).alias("n"), (s["used"] + x["shown"]["tokens"]).alias("used"))).otherwise(s))
    offers = offers.select("_conv", "first", F.reverse(F.slice(F.transform("near", lambda x: x["shown"]), F.lit(1), fits["n"])).alias("past"))
    spans = spans.join(offers, ["_conv", "first"], "left").withColumn("past", F.coalesce("past", F.slice("span", 1, 0)))
    system = rows.where("_role = 'system'").groupBy("_conv").agg(F.min("shown").alias("system"))
    sized = spans.groupBy("_conv").agg(F.count("*").alias("_count")).join(system, "_conv", "left")
    spans = join_hot(spans, stored(sized, "system"), "_conv", spans.count())
    # The system turn comes first, unless the window shows it anyway.
    seen = F.exists(F.concat("past", "span"), lambda x: x["place"] == F.col("system")["place"])
    system = F.when(F.col("system").isNotNull() & (F.col("system")["place"] < F.col("first")) & ~seen, F.array("system")).otherwise(F.slice("span", 1, 0))
    spans = spans.select("_conv", "first", F.concat(system, "past").alias("past"), "span")
    head = lambda x: F.concat(F.lit(START), F.url_encode(x["role"]), F.lit("\n"))
    whole = F.concat("past", "span")
    formatted = F.concat_ws("", F.transform(whole, lambda x: F.concat(head(x), x["text"], F.lit(END))))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int>>").alias("loss"))
    first = F.col("first")

    def walk(state: Column, x: Column) -> Column:
        begin = state["at"] + F.length(head(x))
        end = begin + F.length(x["text"])
        target = (x["place"] >= first) & (x["role"] == "assistant")
        more = F.concat(state["loss"], F.array(F.struct(begin.alias("start"), end.alias("end"))))
        return F.struct((end + len(END)).alias("at"), F.when(target, more).otherwise(state["loss"]).alias("loss"))

    return spans.select(
        shown_id("_conv").alias(conv_col), "first", F.size("span").alias("turns"), F.size("past").alias("repeated"), formatted.alias("formatted"),
        F.aggregate(whole, zero, walk)["loss"].alias("loss"), F.aggregate(whole, F.lit(0).cast("long"), lambda s, x: s + x["tokens"]).alias("tokens"),
    )


def read_back(windows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conversation, n_turns, turns, loss, formatted_chars): the turns (role, newline, text, newline each) and loss texts that the windows hold, in order."""
    marked = F.slice(F.split("formatted", r"<\|im_end\|>\n"), F.col("repeated") + 1, F.col("turns"))

    def plain(x: Column) -> Column:
        body = F.substring(x, F.lit(len(START) + 1), F.length(x))
        cut = F.instr(body, "\n")
        return F.concat(F.url_decode(F.substring(body, F.lit(1), cut - 1)), F.lit("\n"), unescaped(F.substring(body, cut + 1, F.length(body))), F.lit("\n"))

    loss = F.concat_ws("", F.transform("loss", lambda x: unescaped(F.substring(F.col("formatted"), x["start"] + 1, x["end"] - x["start"]))))
    parts = windows.select(conv_col, "first", "turns", F.concat_ws("", F.transform(marked, plain)).alias("text"), loss.alias("target"), F.length("formatted").cast("long").alias("chars"))
    # Blocks of windows are joined first, so that no conversation gathers its windows one by one.
    for block in (F.floor(F.col("first") / 4096), F.lit(0)):
        ordered = F.array_sort(F.collect_list(F.struct("first", "text", "target")))
        parts = parts.groupBy(conv_col, block.alias("_block")).agg(ordered.alias("o"), F.sum("turns").alias("turns"), F.sum("chars").alias("chars"), F.min("first").alias("first"))
        joined = [F.concat_ws("", F.col(f"o.{c}")).alias(c) for c in ("text", "target")]
        parts = parts.select(conv_col, "first", "turns", *joined, "chars")
    return parts.select(conv_col, F.col("turns").cast("long").alias("n_turns"), F.col("text").alias("turns"), F.col("target").alias("loss"), F.col("chars").alias("formatted_chars"))


SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
a AS (SELECT *, (octet_length(encode(text)) + 3) // 4 + 4 AS tokens, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS e,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS p FROM t),
b AS (SELECT *, coalesce(sum(tokens) OVER w, 0) AS before, coalesce(sum(CASE WHEN tokens > 512 THEN 1 ELSE 0 END) OVER w, 0) AS bigs,
             lag(tokens, 1) OVER (PARTITION BY conv_id ORDER BY p) AS t1, lag(tokens, 2) OVER (PARTITION BY conv_id ORDER BY p) AS t2,
             lag(role, 1) OVER (PARTITION BY conv_id ORDER BY p) AS r1, lag(role, 2) OVER (PARTITION BY conv_id ORDER BY p) AS r2,
             length(role) + length(e) + 24 AS n
      FROM a WINDOW w AS (PARTITION BY conv_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, lag(n, 1) OVER (PARTITION BY conv_id ORDER BY p) AS n1, lag(n, 2) OVER (PARTITION BY conv_id ORDER BY p) AS n2,
             CASE WHEN tokens > 512 THEN -1 - p ELSE before // 512 END AS cell FROM b),
s AS (SELECT conv_id, min(p) AS p, min_by(n, p) AS n FROM c WHERE role = 'system' GROUP BY conv_id),
f AS (SELECT c.*, c.p = min(c.p) OVER (PARTITION BY c.conv_id, bigs, cell) AS opens, s.p AS sp, s.n AS sn FROM c LEFT JOIN s USING (conv_id)),
g AS (SELECT *, opens AND t1 <= 256 AND r1 <> 'system' AS h1, opens AND t1 <= 256 AND r1 <> 'system' AND t1 + t2 <= 256 AND r2 <> 'system' AS h2 FROM f)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY p)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY p) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) + sum(CASE WHEN h1 THEN n1 ELSE 0 END) + sum(CASE WHEN h2 THEN n2 ELSE 0 END) + sum(CASE WHEN opens AND sp < p THEN sn ELSE 0 END) AS BIGINT) AS formatted_chars
FROM g GROUP BY conv_id
"""


@query("op7_chat_windows", SQL)
def op7(spark, sf_dir) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "'<|im_end|><|im_start|>assistant ok'"
    extra = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', {said}), (-1L, 1L, 'assistant', {said}) AS t(conv_id, turn, role, text)")
    out = read_back(chat_windows(turns.unionByName(extra)))
    return out.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
