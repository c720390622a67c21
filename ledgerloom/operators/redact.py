"""Three-pass redaction of a text column over tables of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pii import fold_digits
from ..functions.text import collapse_spaces, folded, sql_literal, strip
from ..rules import pii as R
from .shaping import computed_once, is_small, salted_join

# A pattern can only match where its cheap condition holds. {t} is the text of the
# stage, {d} the digit runs of the text that enters the pass: one scan takes them out,
# with what stands between their digits and two capitals before them, so that a
# condition on digits reads a few characters instead of the text. No stage adds a
# run or two capitals before one: tags hold at most four digits, between * and ].
#
# The stages are written as SQL text: one expression per stage instead of dozens
# of Column calls, which keeps the plan quick to build.
DIGIT_RUNS = r"(?U)(?:[A-Z]{2}\s*)?[\d(\-][\d\s\-.()]*"


def _in_runs(regex: str) -> str:
    return "{d} RLIKE r'(?U)" + regex.replace("{", "{{").replace("}", "}}") + "'"


GATES: dict[str, str] = {
    "card": _in_runs(r"\d{4}[\s\-]?\d{4,6}[\s\-]?\d{4}"),
    "card_digits": _in_runs(r"\d(?:[ \-]?\d){12}"),
    "six": _in_runs(r"\d{6}"),
    "seven": _in_runs(r"\d{7}"),
    "eight": _in_runs(r"\d{8}"),
    "nine": _in_runs(r"\d{9}"),
    "ten": _in_runs(r"[\d\-]{10}"),
    "phone": _in_runs(r"\d{3}\)?[\s\-.]?\d{3}[\s\-.]?\d{4}"),
    "ssn_digits": _in_runs(r"\d{3}[\- ]\d{2}[\- ]\d{4}"),
    "zip": _in_runs(r"[A-Z]{2}\s+\d{5}"),
    "dots": _in_runs(r"\d\.\d{1,3}\.\d"),
    "iban": _in_runs(r"[A-Z]{2}\d{2}"),
    "at": "contains({t}, '@')",
    "url": "contains({t}, '://') AND contains({t}, '=')",
    "stars": "contains({t}, '*-*')",
    "plus": "contains({t}, '+')",
}
GATES["ssn"] = f"({GATES['ssn_digits']} OR {GATES['stars']})"
CARD_NUMBER = "entity_CREDIT_CARD"  # the one rule that also looks at the check digit
IS_FIND = r"{m} RLIKE r'(?U)^\d'"


def _matches(text: str, p: R.Pattern) -> str:
    """Whole matches of ``p`` in order, as SQL."""
    found = f"regexp_extract_all({text}, {sql_literal(p.regex)}, 0)"
    if p.name == CARD_NUMBER:
        return f"filter({found}, m -> luhn_check(regexp_replace(m, r'[ \\-]', '')))"
    if p.skip_spans:
        return f"filter({found}, m -> {IS_FIND.format(m='m')})"
    return found


def replaced(text: str, p: R.Pattern) -> str:
    """``text`` with every match of ``p`` replaced, as SQL."""
    if p.skip_spans:
        # The texts between all matches, each followed by its match, or by the tag where that is a find.
        between, found = f"split({text}, {sql_literal(p.regex)}, -1)", f"regexp_extract_all({text}, {sql_literal(p.regex)}, 0)"
        return f"array_join(zip_with({between}, concat({found}, array('')), (t, m) -> concat(t, CASE WHEN {IS_FIND.format(m='m')} THEN '{p.replacement}' ELSE m END)), '')"
    if p.name == CARD_NUMBER:
        return f"aggregate(array_distinct({_matches(text, p)}), {text}, (acc, m) -> replace(acc, m, '{p.replacement}'))"
    return f"regexp_replace({text}, {sql_literal(p.regex)}, '{p.replacement}')"


def _count(text: str, p: R.Pattern) -> str:
    if p.name == CARD_NUMBER or p.skip_spans:
        return f"size({_matches(text, p)})"
    return f"regexp_count({text}, {sql_literal(p.regex)})"


def _details(text: str, p: R.Pattern) -> str:
    """One struct per match; offsets refer to the text before this stage."""
    # The texts between the matches and the matches are made once, then each match adds up what stands before it.
    parts = f"named_struct('between', split({text}, {sql_literal(p.regex)}, -1), 'found', regexp_extract_all({text}, {sql_literal(p.regex)}, 0))"
    size = "0, (acc, s) -> acc + length(s)"
    start = f"aggregate(slice(x.between, 1, k + 1), {size}) + aggregate(slice(x.found, 1, k), {size})"
    shown = f"'{p.replacement}'" if p.name == CARD_NUMBER or p.skip_spans else replaced("m", p)
    detail = f"named_struct('pattern', '{p.name}', 'original', m, 'replacement', {shown}, 'start', at, 'end', at + length(m))"
    details = f"transform(array({parts}), x -> transform(x.found, (m, k) -> transform(array({start}), at -> {detail})[0]))[0]"
    if p.name == CARD_NUMBER:
        return f"filter({details}, d -> luhn_check(regexp_replace(d.original, r'[ \\-]', '')))"
    return f"filter({details}, d -> {IS_FIND.format(m='d.original')})" if p.skip_spans else details


def _run_stages(
    df: DataFrame, column: str, passes: list[tuple[R.Pattern, ...]]
) -> tuple[DataFrame, list[str]]:
    """Add one column per stage; returns the frame and the names, the source text first."""
    names = [column]
    for number, patterns in enumerate(passes):
        if number == 0 and any(p.words for ps in passes for p in ps):
            df = df.withColumn("_folded", folded(F.col(column)))
        digits = f"_digits_{number}"
        runs = f"array_join(regexp_extract_all({names[-1]}, {sql_literal(DIGIT_RUNS)}, 0), '|')"
        # Where the first pass saw none, there are none.
        df = df.withColumn(digits, F.expr(runs if number == 0 else f"CASE WHEN _digits_0 = '' THEN '' ELSE {runs} END"))
        for p in patterns:
            before = names[-1]
            gate = GATES[p.gate].format(t=before, d=digits)
            if p.words:
                gate += " AND (" + " OR ".join(f"contains(_folded, '{w}')" for w in p.words) + ")"
            names.append(f"_stage_{len(names)}")
            df = df.withColumn(names[-1], F.expr(f"CASE WHEN {gate} THEN {replaced(before, p)} ELSE {before} END"))
    return df, names


def _stage_count(names: list[str], i: int, p: R.Pattern) -> Column:
    """Matches of stage ``i``; counted only where the stage changed the text.

    A tag has its one bracket in front, so tags neither overlap nor arise from parts: where the
    text before had none, those behind the stage are its matches. Else the regex counts again.
    """
    before, after = names[i], names[i + 1]
    count = _count(before, p)
    if p.name != CARD_NUMBER:
        tag = p.replacement[p.replacement.index("[") :].partition("$")[0]
        tags = f"cast((octet_length({after}) - octet_length(replace({after}, '{tag}', ''))) div {len(tag)} AS int)"
        count = f"CASE WHEN contains({before}, '{tag}') THEN {count} ELSE {tags} END"
    return F.expr(f"CASE WHEN {after} != {before} THEN {count} ELSE 0 END")


def _stage_details(names: list[str], i: int, p: R.Pattern) -> str:
    none = "cast(array() AS array<struct<pattern:string,original:string,replacement:string,start:int,end:int>>)"
    return f"CASE WHEN {names[i + 1]} != {names[i]} THEN {_details(names[i], p)} ELSE {none} END"


def apply_patterns(df: DataFrame, column: str, patterns: tuple[R.Pattern, ...], out: str = "clean_text") -> DataFrame:
    """The given stages only: adds ``out`` and ``n_<pattern>`` per stage."""
    keep = df.columns
    staged, names = _run_stages(df, column, [patterns])
    computed = {out: F.col(names[-1])}
    for i, p in enumerate(patterns):
        computed[f"n_{p.name}"] = _stage_count(names, i, p)
    return computed_once(staged, keep, computed)


def redact_regex(df: DataFrame, column: str, out: str = "clean_text") -> DataFrame:
    """Pass 1 with the match count of every pattern."""
    return apply_patterns(df, column, R.PATTERNS, out)


def redact_entities(df: DataFrame, column: str, out: str = "clean_text") -> DataFrame:
    """Pass 2: the structured entity types (IP, IBAN, card by check digit, ids, licences)."""
    return apply_patterns(df, column, R.ENTITIES, out)


def _issues(names: list[str], patterns: tuple[R.Pattern, ...]) -> str:
    """Rule and place of every match, as SQL; ``names``: the text before each stage and behind the last one."""
    parts = ", ".join(f"transform({_stage_details(names, i, p)}, d -> concat('{p.name} at ', d.start))" for i, p in enumerate(patterns))
    return f"flatten(array({parts}))"


def validate(df: DataFrame, column: str) -> DataFrame:
    """Pass 3: adds ``clean_text``, ``fixes``, ``is_valid`` and ``issues`` (the rule and where it matched, counted from 0 in
    the text that its stage reads; never the match itself)."""
    keep = df.columns
    staged, names = _run_stages(df, column, [R.LEAKS])
    counts = [_stage_count(names, i, p) for i, p in enumerate(R.LEAKS)]
    fixes = sum(counts[1:], counts[0])
    return computed_once(
        staged,
        keep,
        {
            "clean_text": F.col(names[-1]),
            "fixes": fixes,
            "is_valid": fixes == 0,
            "issues": F.expr(_issues(names, R.LEAKS)),
        },
    )


def redact(
    df: DataFrame,
    column: str = "body",
    *,
    entities: bool = True,
    details: bool = False,
    fold_width: bool = False,
) -> DataFrame:
    """All three passes in one narrow projection; no shuffle.

    Adds ``clean_text``, ``redaction_count`` (matches of pass 1 and 2 plus fixes
    of pass 3), ``by_type`` (map of pass 1 and 2 counts above 0), ``by_pass``
    (map), ``fixes``, ``is_valid`` and ``redaction_error``; with ``details`` also
    ``redaction_details`` and ``issues`` (as ``validate``). A NULL text is an error row: sentinel text, count 0.
    """
    keep = df.columns
    text = "_text"
    source = F.col(column)
    df = df.withColumn(text, fold_digits(source) if fold_width else source)
    later = (R.ENTITIES if entities else ()) + R.LEAKS
    patterns = R.PATTERNS + later
    staged, names = _run_stages(df, text, [R.PATTERNS, later])
    found = len(patterns) - len(R.LEAKS)
    # Counts are plain columns first: every later expression reads them by name.
    staged = staged.withColumns({f"_n_{i}": _stage_count(names, i, p) for i, p in enumerate(patterns)})
    total = lambda first, last: "coalesce(" + " + ".join(f"_n_{i}" for i in range(first, last)) + ", 0)" if last > first else "0"
    first_pass, every = len(R.PATTERNS), len(patterns)
    fixes = F.expr(total(found, every))
    entries = ", ".join(f"named_struct('key', '{p.name}', 'value', _n_{i})" for i, p in enumerate(patterns[:found]))
    by_pass = f"map('regex', {total(0, first_pass)}, 'entities', {total(first_pass, found)}, 'validation', {total(found, every)})"
    error = F.col(text).isNull()
    computed = {
        "clean_text": F.coalesce(F.col(names[-1]), F.lit(R.REDACTION_ERROR)),
        "redaction_count": F.expr(total(0, every)).cast("bigint"),
        "by_type": F.expr(f"map_from_entries(filter(array({entries}), e -> e.value > 0))"),
        "by_pass": F.expr(by_pass),
        "fixes": fixes,
        "is_valid": ~error & (fixes == 0),
        "redaction_error": error,
    }
    if details:
        parts = ", ".join(_stage_details(names, i, p) for i, p in enumerate(patterns[:found]))
        computed["redaction_details"] = F.expr(f"flatten(array({parts}))")
        computed["issues"] = F.expr(_issues(names[found:], R.LEAKS))
    return computed_once(staged, keep, computed)


PLACE = "array<struct<pattern:string,start:int,end:int>>"


def _back(place: str, edits: str, end: bool) -> str:
    """A place in the text behind a stage as a place in the text before it, as SQL; inside a replacement the start or end of what was replaced.

    ``edits``: start, end and size of the replacement, from left to right. The fold carries how much shorter the text has become so far.
    """
    inside = "e.end" if end else "e.start"
    beyond = f"{place} >= e.start - s.less + e.size" if not end else f"{place} > e.start - s.less + e.size"
    return (
        f"aggregate({edits}, named_struct('less', 0, 'at', cast(null AS int)), (s, e) -> CASE WHEN s.at IS NOT NULL THEN s"
        f" WHEN {beyond} THEN named_struct('less', s.less + e.end - e.start - e.size, 'at', s.at)"
        f" WHEN {place} > e.start - s.less THEN named_struct('less', s.less, 'at', {inside}) ELSE s END,"
        f" s -> coalesce(s.at, {place} + s.less))"
    )


def redaction_places(df: DataFrame, column: str = "body", *, entities: bool = True, out: str = "places") -> DataFrame:
    """Adds ``places``: pattern, start and end of every match of the passes 1 and 2 in the text as it came in, without the text itself.

    Each stage reads what the one before left, so its places are carried back
    through the edits of all earlier stages, last one first.
    """
    keep = df.columns
    patterns = R.PATTERNS + (R.ENTITIES if entities else ())
    staged, names = _run_stages(df, column, [R.PATTERNS, R.ENTITIES] if entities else [R.PATTERNS])
    shown = "transform({d}, d -> named_struct('pattern', d.pattern, 'start', d.start, 'end', d.end, 'size', length(d.replacement)))"
    staged = staged.withColumns({f"_e_{i}": F.expr(shown.format(d=_stage_details(names, i, p))) for i, p in enumerate(patterns)})
    staged = staged.withColumn("_edits", F.array(*[F.col(f"_e_{i}") for i in range(len(patterns))]))
    # A stage that found something carries its places back; ``k`` counts the stages before it.
    both = "named_struct('start', d.start, 'end', d.end)"
    step = f"named_struct('start', {_back('p.start', 'get(_edits, i - k)', False)}, 'end', {_back('p.end', 'get(_edits, i - k)', True)})"
    carried = f"aggregate(if(i = 0, cast(array() AS array<int>), sequence(1, i)), {both}, (p, k) -> {step})"
    places = f"flatten(transform(_edits, (es, i) -> transform(es, d -> named_struct('pattern', d.pattern, 'start', {carried}.start, 'end', {carried}.end))))"
    return computed_once(staged, keep, {out: F.coalesce(F.expr(places), F.array().cast(PLACE))})


def fail_closed(redacted: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows that may go on, and the quarantine without any text column.

    ``strict`` also withholds rows whose validation found something.
    """
    bad = F.col("redaction_error") | (F.lit(strict) & ~F.col("is_valid"))
    texts = [c for c in ("body", "subject", "clean_text", "redaction_details") if c in redacted.columns]
    return redacted.where(~bad), redacted.where(bad).drop(*texts)


NAME_BITS = 22  # hashes of first words; 64 of them share a row of the broadcast table, so it has at most 2**(NAME_BITS - 6) rows of two numbers


def redact_names(
    df: DataFrame, column: str, key: str, gazetteer: DataFrame, out: str = "clean_text", small: int = 100_000
) -> DataFrame:
    """Replace listed names (``name``, ``tag``) by their tags; whole words only, case as listed, longer names first.

    Names of several words are looked up as runs of as many words with one blank between.

    The hashes of the names' first words, ``NAME_BITS`` bits each, are the first
    filter, a bitmap for each size of name (its number of words): a run of words whose
    first word has a hash that no name of that size starts with goes no further, so of
    most texts nothing is shuffled. Where a name may start, the run is joined with the
    list, salted, because one name may be very frequent (a list of at most ``small``
    names is broadcast). Only matched names travel back to their text, at most one row
    per text.
    """
    word = r"(?U)[\w'\-#]+"
    names = gazetteer.select("name", "tag").groupBy("name").agg(F.min("tag").alias("tag"))
    bits = lambda text: F.shiftright(F.hash(text), 32 - NAME_BITS)
    listed = names.select(F.split("name", " ").alias("_n")).select(bits(F.get("_n", 0)).alias("_hash"), F.size("_n").alias("_size"))
    # 64 neighbouring hashes are the bits of one number, with the size of the names that start so.
    mark = F.expr("shiftleft(1L, _hash & 63)")
    marks = listed.groupBy(F.shiftright("_hash", 6).alias("_block"), "_size").agg(F.bit_or(mark).alias("_marks"))
    starts = marks.groupBy("_block").agg(F.collect_list(F.struct("_size", "_marks")).alias("_starts"))
    words = df.select(key, F.regexp_extract_all(F.col(column), F.lit(word), F.lit(0)).alias("_w"))
    places = words.select(key, "_w", F.posexplode(F.transform("_w", bits)).alias("_at", "_hash"))
    places = places.withColumn("_block", F.shiftright("_hash", 6)).join(F.broadcast(starts), "_block")
    fitting = F.expr("filter(_starts, s -> s._marks & shiftleft(1L, _hash & 63) <> 0)")
    runs = F.transform(fitting, lambda s: F.array_join(F.slice("_w", F.col("_at") + 1, s["_size"]), " "))
    asked = places.select(key, F.explode(runs).alias("name"))
    if is_small(gazetteer, small):
        hits = asked.join(F.broadcast(names), "name")
    else:
        # Repeated for the salts, a list that Spark takes for small is not: it is never broadcast.
        hits = salted_join(asked, names, ["name"], key, hint="merge")
    hits = hits.groupBy(key, "name").agg(F.first("tag").alias("tag"))
    found = hits.groupBy(key).agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct((-F.length("name")).alias("n"), "name", "tag"))), lambda x: F.struct(x["name"], x["tag"]))).alias("_names"))
    tagged = F.aggregate(
        F.map_entries("_names"),
        F.col(column),
        lambda text, e: F.regexp_replace(
            text, F.concat(F.lit(r"(?U)(?<![\w'\-#\[])\Q"), e["key"], F.lit(r"\E(?![\w'\-#])")), e["value"]
        ),
    )
    return (
        df.join(found, key, "left")
        .withColumn(out, F.when(F.col("_names").isNull(), F.col(column)).otherwise(tagged))
        .withColumn("names_found", F.coalesce(F.size("_names"), F.lit(0)))
        .drop("_names")
    )


def leak_scan(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row per (row, field, pattern) that matches, over every pattern of pass 1."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields])
    patterns = [("masked_card", R.MASKED_CARD)] + [(p.name, p.regex) for p in R.PATTERNS]
    names = F.array_compact(F.array(*[F.when(F.col("text").rlike(regex), F.lit(name)) for name, regex in patterns]))
    return (
        df.select(F.col(key), F.inline(cells))
        .select(key, "field", F.explode(names).alias("pattern"))
    )


def redaction_stats(redacted: DataFrame) -> DataFrame:
    """One row: mails, redactions, failed mails, counts by type and by pass.

    Rows that failed validation count as failed only.
    """
    valid = F.col("is_valid")
    types = [p.name for p in R.PATTERNS + R.ENTITIES]
    passes = ("regex", "entities", "validation")
    by_type = lambda t: F.sum(F.when(valid, F.coalesce(F.try_element_at("by_type", F.lit(t)), F.lit(0))).otherwise(0))
    by_pass = lambda p: F.sum(F.when(valid, F.col("by_pass")[p]).otherwise(0))
    row = redacted.agg(
        F.count("*").alias("total_mails"),
        F.sum(F.when(valid, F.col("redaction_count")).otherwise(0)).alias("total_redactions"),
        F.count_if(~valid).alias("failed_mails"),
        *[by_type(t).alias(f"_t_{i}") for i, t in enumerate(types)],
        *[by_pass(p).alias(f"_p_{p}") for p in passes],
    )
    typed = F.array(*[F.struct(F.lit(t).alias("key"), F.col(f"_t_{i}").alias("value")) for i, t in enumerate(types)])
    return row.select(
        "total_mails",
        "total_redactions",
        "failed_mails",
        F.map_from_entries(F.filter(typed, lambda e: e["value"] > 0)).alias("by_type"),
        F.create_map(*[x for p in passes for x in (F.lit(p), F.col(f"_p_{p}"))]).alias("by_pass"),
    )


def sanitize_output(df: DataFrame, column: str = "text") -> DataFrame:
    """The same redactor on outgoing text; a hit is a CRITICAL event."""
    return redact(df, column).withColumn(
        "level", F.when(F.col("redaction_count") > 0, F.lit("CRITICAL")).otherwise(F.lit("INFO"))
    )


def redaction_example(redacted: DataFrame, column: str = "body", order: str = "seq") -> DataFrame:
    """Before and after snippet of the first mail whose first redaction can be shown.

    Needs ``redaction_details``. Both texts are stripped of tags; each snippet is
    the redaction with 100 characters on either side, with ellipses where cut. It
    qualifies when the snippets differ and the first has over 20 characters.
    """
    def plain(text: Column) -> Column:
        return strip(collapse_spaces(F.regexp_replace(text, r"<[^>]+>", " ")))

    def window(text: Column, at: Column, size: Column) -> tuple[Column, Column, Column]:
        start = F.greatest(at - 101, F.lit(0))
        end = F.least(F.length(text), at - 1 + size + 100)
        return start, end, F.substr(text, start + 1, end - start)

    first = F.get(F.col("redaction_details"), 0)
    base = (
        redacted.where((F.col("redaction_count") > 0) & (F.size("redaction_details") > 0))
        .select(
            order,
            "redaction_count",
            plain(F.col(column)).alias("_orig"),
            plain(F.col("clean_text")).alias("_red"),
            first["replacement"].alias("_tag"),
            first["original"].alias("_value"),
        )
        .withColumn("_tag_at", F.expr("instr(_red, _tag)"))
        .withColumn("_value_at", F.expr("instr(_orig, _value)"))
    )
    r_start, r_end, r_text = window(F.col("_red"), F.col("_tag_at"), F.length("_tag"))
    o_start, o_end, o_text = window(F.col("_orig"), F.col("_value_at"), F.length("_value"))
    found = F.col("_value_at") > 0
    dots = F.lit("...")
    none = F.lit("")
    cut_right = F.when(o_end < F.length("_orig"), dots).otherwise(none)
    # A snippet cut on the right in both texts ends in two ellipses, as the fixed format has it.
    twice = F.when((r_end < F.length("_red")) & (o_end < F.length("_orig")), dots).otherwise(none)
    before = F.when(
        found, F.concat(F.when(o_start > 0, dots).otherwise(none), o_text, cut_right, twice)
    ).otherwise(
        F.concat(F.when(r_start > 0, dots).otherwise(none), F.substr(F.col("_orig"), r_start + 1, r_end - r_start))
    )
    after = F.concat(
        F.when(r_start > 0, dots).otherwise(none), r_text, F.when(r_end < F.length("_red"), dots).otherwise(none)
    )
    return (
        base.where(F.col("_tag_at") > 0)
        .select(order, before.alias("before"), after.alias("after"), "redaction_count")
        .where((F.col("before") != F.col("after")) & (F.length("before") > 20))
        .orderBy(order)
        .limit(1)
    )
