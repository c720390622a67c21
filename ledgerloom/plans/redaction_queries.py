"""Queries over the redaction passes: documents, pages, mail, conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extraction as X
from ..operators import ledger as L
from ..operators import mail as MO
from ..operators import redact as RD
from ..operators.shaping import spread, written
from ..rules import pii as P
from ..sources import views as V
from . import oracle as O
from .mail_queries import CLEAN, MAIL, clean, ledger, LEDGER
from .registry import query
from .scan import example_of, passed, redacted_mail, staged_mail


def _docs(spark, sf_dir):
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id")


def _pages(spark, sf_dir):
    return spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id")


def _one(name: str) -> tuple[P.Pattern, ...]:
    return tuple(p for p in P.PATTERNS if p.name == name)


def _single(qname: str, name: str) -> None:
    """One pattern alone over mail bodies and documents."""
    rule = {name: O.PASS1[name]}
    sql = (
        f"WITH {V.mail_cte()},\nsrc AS (SELECT id AS key, body AS text FROM mail UNION ALL SELECT concat('d-', cast(doc_id as varchar)), text FROM documents),\n"
        + O.stages("src", "text", rule, "st")
        + f"\nSELECT key, t_last AS clean_text, n_{name} AS n FROM st"
    )

    @query(qname, sql)
    def _(spark, sf_dir):
        mail = V.mail(spark, sf_dir).select(F.col("id").alias("key"), F.col("body").alias("text"))
        docs = _docs(spark, sf_dir).select(F.concat(F.lit("d-"), F.col("doc_id").cast("string")).alias("key"), "text")
        out = RD.apply_patterns(mail.unionByName(docs), "text", _one(name))
        return out.select("key", "clean_text", F.col(f"n_{name}").cast("bigint").alias("n"))


for _qname, _name in (
    ("RED2_card", "credit_card"), ("RED3_ssn", "ssn"), ("RED4_routing", "routing_number"), ("RED5_account", "account_number"),
    ("RED6_long_number", "generic_long_number"), ("RED7_phone", "phone_number"), ("RED8_secure_url", "secure_url"),
    ("RED9_email", "email_address"), ("RED10_address", "address"),
):
    _single(_qname, _name)


@query("RED1_masked_card", MAIL + "SELECT id, len(regexp_extract_all(body, '\\*{3,4}[\\-]?\\d{4}\\b')) AS n FROM mail")
def _(spark, sf_dir):
    n = F.regexp_count("body", F.lit(P.MASKED_CARD)).cast("bigint")
    return V.mail(spark, sf_dir).select("id", n.alias("n"))


def _chain_sql(source: str, key: str, column: str, rules: dict) -> str:
    counts = " + ".join(f"n_{k}" for k in rules)
    return O.stages(source, column, rules, "st") + f"\nSELECT {key}, t_last AS clean_text, {counts} AS n FROM st"


def _counted(df, key, patterns):
    total = sum((F.col(f"n_{p.name}") for p in patterns[1:]), F.col(f"n_{patterns[0].name}"))
    return df.select(key, "clean_text", total.cast("bigint").alias("n"))


@query("RED11_redact_regex_documents", "WITH " + _chain_sql("documents", "doc_id", "text", O.PASS1))
def _(spark, sf_dir):
    return _counted(RD.redact_regex(_docs(spark, sf_dir), "text"), "doc_id", P.PATTERNS)


@query("RED11_redact_regex_pages", "WITH " + _chain_sql("pages", "page_id", "html", O.PASS1))
def _(spark, sf_dir):
    return _counted(RD.redact_regex(_pages(spark, sf_dir), "html"), "page_id", P.PATTERNS)


@query("RED11_redact_regex_mail", f"WITH {V.mail_cte()},\n" + _chain_sql("mail", "id", "body", O.PASS1))
def _(spark, sf_dir):
    return _counted(RD.redact_regex(V.mail(spark, sf_dir), "body"), "id", P.PATTERNS)


_TYPE_ROWS = "\nUNION ALL ".join(f"SELECT id, '{k}' AS pattern, n_{k} AS n FROM clean WHERE n_{k} > 0" for k in (*O.PASS1, *O.ENTITIES))
_TAG_OF = {k: v[0] for k, v in {**O.PASS1, **O.ENTITIES}.items()}


@query("RED12_redaction_details", CLEAN + "\n" + _TYPE_ROWS)
def _(spark, sf_dir):
    rows = clean(spark, sf_dir, details=True).select("id", F.inline("redaction_details"))
    return rows.groupBy("id", "pattern").agg(F.count("*").alias("n"))


def _cards(text: str) -> str:
    runs = rf"regexp_extract_all({text}, '(?:^|[^\[{O.W}.\-*])([0-9](?:[ \-]?[0-9]){{12,18}})(?:$|[^{O.W}\]\-])', 1)"
    return f"list_distinct(list_filter({runs}, lambda m: " + O.luhn("regexp_replace(m, '[ \\-]', '', 'g')") + "))"


def _carded(source: str, name: str) -> str:
    return (
        f"{name}_c AS (SELECT *, {_cards('text')} AS cards FROM {source}),\n"
        f"{name} AS (SELECT doc_id, list_reduce(cards, lambda acc, m: replace(acc, m, '[CARD_REDACTED]'), text) AS text, n_cards + len(cards) AS n_cards FROM {name}_c),\n"
    )


_ENT = "WITH docs AS (SELECT doc_id, text, 0 AS n_cards FROM documents),\n" + _carded("docs", "once") + _carded("once", "carded")


@query(
    "RED13_redact_entities",
    _ENT
    + O.stages("carded", "text", O.ENTITIES, "st")
    + "\nSELECT doc_id, t_last AS clean_text, "
    + " + ".join(f"n_{k}" for k in O.ENTITIES)
    + " AS n_other, n_entity_IP_ADDRESS AS n_ip, n_cards > 0 AS has_card FROM st",
)
def _(spark, sf_dir):
    out = RD.redact_entities(_docs(spark, sf_dir), "text")
    others = [F.col(f"n_{p.name}") for p in P.ENTITIES if p.name != "entity_CREDIT_CARD"]
    return out.select(
        "doc_id", "clean_text", sum(others[1:], others[0]).cast("bigint").alias("n_other"),
        F.col("n_entity_IP_ADDRESS").cast("bigint").alias("n_ip"), (F.col("n_entity_CREDIT_CARD") > 0).alias("has_card"),
    )


_COUNTED = {k: v for k, v in (O.PASS1 | O.ENTITIES).items() if k != "entity_CREDIT_CARD"}


@query(
    "RED12_places",
    f"WITH {V.mail_cte()},\nsrc AS (SELECT id AS key, body FROM mail),\n" + O.stages("src", "body", O.PASS1 | O.ENTITIES, "st")
    + "\n" + " UNION ALL ".join(f"SELECT '{k}' AS pattern, cast(sum(n_{k}) as bigint) AS n, cast(sum(n_{k}) as bigint) AS n_matching FROM st HAVING sum(n_{k}) > 0" for k in _COUNTED),
)
def _(spark, sf_dir):
    """Where each redaction stood in the mail as it came in: what stands there is what the pattern matches."""
    found = RD.redaction_places(V.mail(spark, sf_dir).select("id", "body"), "body").select("body", F.explode("places").alias("p"))
    there = F.substr("body", F.col("p.start") + 1, F.col("p.end") - F.col("p.start"))
    regexes = {p.name: p.regex for p in P.PATTERNS + P.ENTITIES}
    matches = F.coalesce(*[F.when(F.col("p.pattern") == name, there.rlike(regex)) for name, regex in regexes.items()])
    counts = found.select("p.pattern", matches.alias("ok")).groupBy("pattern").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_matching"))
    return counts.where("pattern <> 'entity_CREDIT_CARD'")


def gazetteer(spark, sf_dir):
    """Names from the given tables: customers as persons, nations as places."""
    people = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_name").alias("name"), F.lit("[PERSON_REDACTED]").alias("tag"))
    places = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("name"), F.lit("[LOCATION_REDACTED]").alias("tag"))
    return people.unionByName(places)


def _named(names: str) -> str:
    """Texts with the names that a look-up of their words and pairs of words finds replaced, longer names first."""
    edge = r"[^\w''\-#"
    found = rf"'(^|{edge}\[])' || regexp_escape(x.name) || '($|{edge}])', '\1' || x.tag || '\2', 'g'"
    return (
        MAIL.rstrip()
        + f",\nnames AS ({names}),\n"
        r"words AS (SELECT id, regexp_extract_all(body, '[\w''\-#]+') AS w FROM mail),"
        "\nruns AS (SELECT id, unnest(w) AS run FROM words UNION SELECT id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words),\n"
        "hits AS (SELECT id, list({'n': -length(name), 'name': name, 'tag': tag} ORDER BY -length(name), name) AS found FROM runs JOIN names ON run = name GROUP BY id)\n"
        "SELECT id, list_reduce(list_prepend({'n': 0::BIGINT, 'name': '', 'tag': body}, coalesce(found, [])),"
        f" lambda a, x: {{'n': 0::BIGINT, 'name': '', 'tag': regexp_replace(regexp_replace(a.tag, {found}), {found})}}).tag AS clean_text FROM mail LEFT JOIN hits USING (id)"
    )


_NAMES = "SELECT c_name AS name, '[PERSON_REDACTED]' AS tag FROM customer UNION ALL SELECT n_name, '[LOCATION_REDACTED]' FROM nation"


@query("RED14_redact_names", _named(_NAMES))
def _(spark, sf_dir):
    return RD.redact_names(V.mail(spark, sf_dir), "body", "id", gazetteer(spark, sf_dir)).select("id", "clean_text")


@query("RED14_names_of_two_words", _named(_NAMES + " UNION ALL SELECT concat('Cafe ', n_name), '[SHOP_REDACTED]' FROM nation"))
def _(spark, sf_dir):
    """The longer name goes first: a shop named after a nation is a shop."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    shops = nation.select(F.concat(F.lit("Cafe "), "n_name").alias("name"), F.lit("[SHOP_REDACTED]").alias("tag"))
    names = gazetteer(spark, sf_dir).unionByName(shops)
    return RD.redact_names(V.mail(spark, sf_dir), "body", "id", names).select("id", "clean_text")


_LEAK_SQL = (
    "\nSELECT key, t_last AS clean_text, " + " + ".join(f"n_{k}" for k in O.LEAKS) + " AS fixes, "
    + "(" + " + ".join(f"n_{k}" for k in O.LEAKS) + ") = 0 AS is_valid FROM st"
)


@query("RED15_validate_documents", "WITH src AS (SELECT doc_id AS key, text FROM documents),\n" + O.stages("src", "text", O.LEAKS, "st") + _LEAK_SQL)
def _(spark, sf_dir):
    out = RD.validate(_docs(spark, sf_dir), "text")
    return out.select(F.col("doc_id").alias("key"), "clean_text", F.col("fixes").cast("bigint").alias("fixes"), "is_valid")


@query("RED15_validate_mail", f"WITH {V.mail_cte()},\nsrc AS (SELECT id AS key, body FROM mail),\n" + O.stages("src", "body", O.LEAKS, "st") + _LEAK_SQL)
def _(spark, sf_dir):
    out = RD.validate(V.mail(spark, sf_dir), "body")
    return out.select(F.col("id").alias("key"), "clean_text", F.col("fixes").cast("bigint").alias("fixes"), "is_valid")


_SCAN_FIELDS = ("merchant", "category", "source_email_id")
_RE2_TESTS = {"masked_card": ("\\*{3,4}[\\-]?\\d{4}\\b", "c")} | {k: (v[1], "i" if "i" in v[3] else "c") for k, v in O.PASS1.items()}


def _leak_scan_sql(source: str, key: str, fields) -> str:
    parts = [
        f"SELECT {key}, '{f}' AS field, '{name}' AS pattern FROM {source} WHERE regexp_matches({f}, {O.q(rx)}, '{flags}')"
        for f in fields
        for name, (rx, flags) in _RE2_TESTS.items()
    ]
    return "\nUNION ALL ".join(parts)


@query("RED16_leak_scan_ledger", LEDGER + _leak_scan_sql("ledger", "source_email_id", _SCAN_FIELDS))
def _(spark, sf_dir):
    rows = ledger(spark, sf_dir).withColumn("key", F.col("source_email_id"))
    return RD.leak_scan(rows, "key", list(_SCAN_FIELDS)).select(F.col("key").alias("source_email_id"), "field", "pattern")


@query("RED16_leak_scan_mail", MAIL + _leak_scan_sql("mail", "id", ("sender", "subject", "body")))
def _(spark, sf_dir):
    return RD.leak_scan(V.mail(spark, sf_dir), "id", ["sender", "subject", "body"]).select("id", "field", "pattern")


@query("RED17_redact_mail", CLEAN + "\nSELECT id, clean_text, redaction_count, fixes, is_valid FROM clean")
def _(spark, sf_dir):
    return clean(spark, sf_dir).select("id", "clean_text", "redaction_count", F.col("fixes").cast("bigint").alias("fixes"), "is_valid")


@query(
    "RED17_redact_documents",
    "WITH "
    + O.redacted("documents", "text", "clean")
    + "\nSELECT doc_id, clean_text, redaction_count, is_valid FROM clean",
)
def _(spark, sf_dir):
    return RD.redact(_docs(spark, sf_dir), "text").select("doc_id", "clean_text", "redaction_count", "is_valid")


@query(
    "RED18_sanitize_output",
    "WITH said AS (SELECT * FROM conversations WHERE role = 'assistant'),\n"
    + O.redacted("said", "text", "clean")
    + "\nSELECT conv_id, turn, clean_text, redaction_count, CASE WHEN redaction_count > 0 THEN 'CRITICAL' ELSE 'INFO' END AS level FROM clean",
)
def _(spark, sf_dir):
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'assistant'")
    return RD.sanitize_output(said).select("conv_id", "turn", "clean_text", "redaction_count", "level")


def _plain(text: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({text}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"


_EXAMPLE = (
    CLEAN
    + f",\nfirst_mail AS (SELECT seq, {_plain('body')} AS o, {_plain('clean_text')} AS r, redaction_count,"
    f" instr({_plain('clean_text')}, '[CARD_****') AS tag_at, regexp_extract(body, {O.q(O.CARD)}) AS v"
    " FROM clean WHERE seq = (SELECT min(seq) FROM clean WHERE redaction_count > 0)),\n"
    "cut AS (SELECT *, greatest(tag_at - 101, 0) AS rs, least(length(r), tag_at - 1 + 15 + 100) AS re,"
    " greatest(instr(o, v) - 101, 0) AS os, least(length(o), instr(o, v) - 1 + length(v) + 100) AS oe FROM first_mail)\n"
    "SELECT seq, concat(CASE WHEN os > 0 THEN '...' ELSE '' END, substr(o, os + 1, oe - os), CASE WHEN oe < length(o) THEN '...' ELSE '' END,"
    " CASE WHEN re < length(r) AND oe < length(o) THEN '...' ELSE '' END) AS before,"
    " concat(CASE WHEN rs > 0 THEN '...' ELSE '' END, substr(r, rs + 1, re - rs), CASE WHEN re < length(r) THEN '...' ELSE '' END) AS after,"
    " redaction_count FROM cut"
)


@query("RED19_redaction_example", _EXAMPLE)
def _(spark, sf_dir):
    mail = V.mail(spark, sf_dir)
    return example_of(mail, written(passed(staged_mail(mail)), "passed"))


@query("SNK6_report_with_example", f"SELECT before, after, 30 AS query_days FROM ({_EXAMPLE})")
def _(spark, sf_dir):
    """The report of a scan that shows one redaction before and after."""
    mail = V.mail(spark, sf_dir)
    staged = written(staged_mail(mail), "staged")
    good = passed(staged)
    rows = written(X.ledger_rows(X.extract_transactions(good, V.MAIL_AS_OF), V.MAIL_AS_OF), "ledger")
    report = MO.scan_report(MO.pipeline_stats(staged, rows), RD.redaction_stats(good), L.ledger_total(rows), 30, example_of(mail, good))
    back = F.from_json("report", "query_days int, redaction_example struct<before:string,after:string>")
    return report.select(back.alias("r")).select("r.redaction_example.*", "r.query_days")


@query(
    "FLT14_fail_closed",
    MAIL + "SELECT cast(count_if(body <> '') as bigint) AS passed, cast(count_if(body = '') as bigint) AS withheld FROM mail",
)
def _(spark, sf_dir):
    empty_is_error = F.nullif(F.col("body"), F.lit(""))
    redacted = RD.redact(V.mail(spark, sf_dir).withColumn("body", empty_is_error), "body")
    # Both sides read the same rows, which are redacted once.
    good, bad = RD.fail_closed(written(redacted.select("id", "clean_text", "is_valid", "redaction_error"), "redacted"))
    both = good.select(F.lit(1).alias("g"), F.lit(0).alias("b")).unionAll(bad.select(F.lit(0).alias("g"), F.lit(1).alias("b")))
    return both.agg(F.sum("g").alias("passed"), F.sum("b").alias("withheld"))


_BY_TYPE = "\nUNION ALL ".join(
    f"SELECT '{k}' AS type, cast(sum(n_{k}) as bigint) AS n FROM clean WHERE is_valid HAVING sum(n_{k}) > 0" for k in (*O.PASS1, *O.ENTITIES)
)


@query(
    "AGG10_redaction_stats",
    CLEAN
    + "\nSELECT count(*) AS total_mails, cast(sum(CASE WHEN is_valid THEN redaction_count ELSE 0 END) as bigint) AS total_redactions, cast(count_if(NOT is_valid) as bigint) AS failed_mails,"
    + " cast(sum(CASE WHEN is_valid THEN " + " + ".join(f"n_{k}" for k in O.PASS1) + " ELSE 0 END) as bigint) AS by_regex,"
    + " cast(sum(CASE WHEN is_valid THEN " + " + ".join(f"n_{k}" for k in O.ENTITIES) + " ELSE 0 END) as bigint) AS by_entities,"
    + " cast(sum(CASE WHEN is_valid THEN n_phone_number ELSE 0 END) as bigint) AS phones FROM clean",
)
def _(spark, sf_dir):
    return RD.redaction_stats(passed(redacted_mail(V.mail(spark, sf_dir)))).select(
        "total_mails", "total_redactions", "failed_mails", F.col("by_pass")["regex"].alias("by_regex"),
        F.col("by_pass")["entities"].alias("by_entities"), F.col("by_type")["phone_number"].alias("phones"),
    )


@query("SRT6_redactions_by_type", CLEAN + "\n" + _BY_TYPE)
def _(spark, sf_dir):
    stats = RD.redaction_stats(passed(redacted_mail(V.mail(spark, sf_dir))))
    return stats.select(F.explode("by_type").alias("type", "n")).orderBy(F.desc("n"), "type")
