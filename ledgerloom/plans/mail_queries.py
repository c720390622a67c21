"""Queries over mail: sources, filters, injection scan, extraction, categories."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import category as C
from ..functions import extract as E
from ..functions import injection as IF
from ..functions import mime as M
from ..functions.sqlfunctions import register
from ..operators import blocklist as B
from ..operators import extraction as X
from ..operators import injection as I
from ..operators import ledger as L
from ..operators import mail as MO
from ..operators.redact import redaction_stats
from ..operators.shaping import computed_once, shared_dir, spread, written
from ..rules import extraction as R
from ..sources import files
from ..sources import views as V
from . import oracle as O
from .registry import query
from .scan import details_of, passed, staged_mail

AS_OF = V.MAIL_AS_OF
MAIL = f"WITH {V.mail_cte()}\n"
CLEAN = O.clean_mail()


def joined(column: str, sep: str = ";"):
    return F.array_join(column, sep)


def clean(spark, sf_dir, details: bool = False) -> DataFrame:
    return passed(staged_mail(V.mail(spark, sf_dir), details=details))


def extracted(spark, sf_dir) -> DataFrame:
    return X.extract_transactions(clean(spark, sf_dir), AS_OF)


def ledger(spark, sf_dir) -> DataFrame:
    return X.ledger_rows(extracted(spark, sf_dir), AS_OF)


# --- sources -----------------------------------------------------------------------------


@query("SRC1_read_mail_json", MAIL + "SELECT id, sender, subject, body, date FROM mail")
def _(spark, sf_dir):
    folder = shared_dir(spark, "mail-json")
    V.mail(spark, sf_dir).select("id", "sender", "subject", "body", "date").write.json(folder + "/mail")
    return files.read_mail_json(spark, folder + "/mail", lines=True)


def _financial_sql(days: int) -> str:
    domains = ", ".join(O.q(d) for d in R.FINANCIAL_DOMAINS)
    return (
        f"(split_part(lower(sender_email), '@', -1) IN ({domains}) OR {O.any_word('lower(subject)', R.FINANCIAL_SUBJECTS)})"
        f" AND strptime({O.header_date('date', AS_OF)}, '%Y-%m-%d') >= TIMESTAMP '{AS_OF}' - INTERVAL {days} DAY"
    )


@query("SRC2_financial_mail", MAIL + f"SELECT id, sender_email, subject, date FROM mail WHERE {_financial_sql(30)}")
def _(spark, sf_dir):
    return MO.financial_mail(V.mail(spark, sf_dir), AS_OF).select("id", "sender_email", "subject", "date")


@query(
    "SRC3_mail_with_body",
    MAIL + "SELECT id, sender, subject, date, body FROM mail WHERE body <> ''",
)
def _(spark, sf_dir):
    mail = V.mail(spark, sf_dir)
    body = V.mail(spark, sf_dir).where("body <> ''").select("id", "body")
    return MO.mail_with_body(mail.select("id", "sender", "subject", "date"), body)


_DETAIL_TYPES = " ".join(
    f"|| repeat('{name};', CAST(n_{name} AS INT))" for name in (*O.PASS1, *O.ENTITIES)
)


@query(
    "SRC4_mail_detail",
    O.clean_mail()
    + f"SELECT id, sender, sender_email, subject, date, clean_text AS redacted_body, redaction_count, is_valid, '' {_DETAIL_TYPES} AS detail_types,"
    " concat('Email ', id, ' accessed, ', cast(redaction_count as varchar), ' redactions applied') AS audit_summary"
    " FROM clean WHERE seq IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
)
def _(spark, sf_dir):
    wanted = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_returnflag = 'R'")
    ids = wanted.select(F.concat(F.lit("m-"), F.col("l_orderkey").cast("string")).alias("id"))
    out = details_of(V.mail(spark, sf_dir), ids)
    types = F.array_join(F.transform("redaction_report.details", lambda d: F.concat(d["type"], F.lit(";"))), "")
    return out.select(
        "id", "sender", "sender_email", "subject", "date", "redacted_body",
        F.col("redaction_report.redaction_count").alias("redaction_count"),
        F.col("redaction_report.is_valid").alias("is_valid"),
        types.alias("detail_types"),
        "audit_summary",
    )


def raw_messages(spark, sf_dir) -> DataFrame:
    """Raw messages rendered from the mail view: MIME shape by kind, bodies in base64url."""
    b64 = F.translate(F.base64(F.encode("body", "UTF-8")), "+/", "-_")
    html = F.concat(F.lit("<html><body><p>"), F.replace("body", F.lit("\n"), F.lit("</p><p>")), F.lit("</p></body></html>"))
    b64_html = F.translate(F.base64(F.encode(html, "UTF-8")), "+/", "-_")
    part = lambda kind, data: F.struct(F.lit(kind).alias("mimeType"), F.struct(data.alias("data")).alias("body"))
    whole = lambda kind, parts: F.to_json(F.struct(F.lit(kind).alias("mimeType"), parts.alias("parts")))
    note = F.lit("VGhpcyBpcyB0aGUgb2xkIHBhcnQ")
    shape = F.col("seq") % 5
    payload = (
        F.when(shape == 0, F.to_json(part("text/plain", b64)))
        .when(shape == 1, F.to_json(part("text/html", b64_html)))
        .when(shape == 2, whole("multipart/alternative", F.array(part("text/plain", note), part("text/html", b64_html), part("text/plain", b64))))
        .when(shape == 3, whole("multipart/mixed", F.array(part("text/html", b64_html))))
        .otherwise(
            whole(
                "multipart/mixed",
                F.array(F.struct(F.lit("multipart/alternative").alias("mimeType"), F.array(part("text/plain", b64)).alias("parts"))),
            )
        )
    )
    named = lambda name, value: F.struct(F.lit(name).alias("name"), F.col(value).alias("value"))
    headers = F.to_json(F.array(named("FROM", "sender"), named("Subject", "subject"), named("date", "date"), named("from", "id")))
    return V.mail(spark, sf_dir).select("seq", "id", headers.alias("headers"), payload.alias("payload"))


def _raw_body(max_chars: int | None) -> str:
    html = "concat('<html><body><p>', replace(body, chr(10), '</p><p>'), '</p></body></html>')"
    return f"CASE WHEN seq % 5 = 2 AND body = '' THEN 'This is the old part' WHEN seq % 5 IN (1, 3) THEN {O.html_to_text(html, max_chars)} ELSE {O.truncated('body', max_chars)} END"


@query("SRC5_mime_text", MAIL + f"SELECT id, {_raw_body(None)} AS body FROM mail")
def _(spark, sf_dir):
    return MO.mail_from_raw(raw_messages(spark, sf_dir)).select("id", "body")


@query("SRC5_mime_text_cut", MAIL + f"SELECT id, {_raw_body(R.MAIL_BODY_CHARS)} AS body FROM mail")
def _(spark, sf_dir):
    return MO.mail_from_raw(raw_messages(spark, sf_dir), max_chars=R.MAIL_BODY_CHARS).select("id", "body")


@query("SRC5_mime_deep", MAIL + "SELECT id, CASE WHEN body = '' THEN '' ELSE body END AS body FROM mail")
def _(spark, sf_dir):
    """The body lies below seven multiparts."""
    data = F.translate(F.base64(F.encode("body", "UTF-8")), "+/", "-_")
    part = F.to_json(F.struct(F.lit("text/plain").alias("mimeType"), F.struct(data.alias("data")).alias("body")))
    for _level in range(7):
        part = F.concat(F.lit('{"mimeType":"multipart/mixed","parts":['), part, F.lit("]}"))
    return MO.mail_from_raw(raw_messages(spark, sf_dir).drop("payload").join(V.mail(spark, sf_dir).select("id", part.alias("payload")), "id")).select("id", "body")


@query("SRC5_mime_any_depth", MAIL + "SELECT id, CASE WHEN body = '' THEN 'Old text' ELSE body END AS body FROM mail")
def _(spark, sf_dir):
    """The body lies below none to 24 multiparts, each with an HTML part beside the next one."""
    data = lambda text: F.translate(F.base64(F.encode(text, "UTF-8")), "+/", "-_")
    part = lambda kind, text: F.to_json(F.struct(F.lit(kind).alias("mimeType"), F.struct(data(text).alias("data")).alias("body")))
    around = F.concat(F.lit('{"mimeType":"multipart/mixed","parts":['), part("text/html", F.lit("<p>Old</p>")), F.lit(","))
    text = F.when(F.col("body") == "", "Old text").otherwise(F.col("body"))
    wrapped = F.aggregate(F.slice(F.sequence(F.lit(1), F.lit(24)), F.lit(1), (F.col("seq") % 25).cast("int")), part("text/plain", text), lambda inner, _: F.concat(around, inner, F.lit("]}")))
    mails = V.mail(spark, sf_dir).select("id", F.lit("[]").alias("headers"), wrapped.alias("payload"))
    return MO.mail_from_raw(mails).select("id", "body")


@query("SRC5_mime_text_whole", MAIL + f"SELECT id, {_raw_body(None)} AS body FROM mail")
def _(spark, sf_dir):
    return MO.mail_from_raw(raw_messages(spark, sf_dir), max_chars=None).select("id", "body")


@query("SRC6_b64url_text", "SELECT doc_id, text FROM documents")
def _(spark, sf_dir):
    coded = F.rtrim(F.translate(F.base64(F.encode("text", "UTF-8")), "+/=", "-_ "))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", coded.alias("data")).select("doc_id", M.b64url_text(F.col("data")).alias("text"))


@query("SRC7_header", MAIL + "SELECT id, sender AS from_value, subject AS subject_value, date AS date_value, '' AS cc_value FROM mail")
def _(spark, sf_dir):
    from ..schemas import HEADERS

    parsed = raw_messages(spark, sf_dir).select("id", F.from_json("headers", HEADERS).alias("h"))
    value = lambda name: M.header(F.col("h"), name)
    return parsed.select(
        "id", value("From").alias("from_value"), value("subject").alias("subject_value"), value("Date").alias("date_value"),
        value("Cc").alias("cc_value"),
    )


@query("SRC8_parse_from", MAIL + "SELECT id, sender_name AS sender, sender_email FROM mail")
def _(spark, sf_dir):
    parsed = V.mail(spark, sf_dir).select("id", M.parse_from(F.col("sender")).alias("p"))
    return parsed.select("id", "p.sender", "p.sender_email")


_BASIC = "regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"


@query("SRC9_html_to_text_basic", f"SELECT page_id, {_BASIC} AS text FROM pages")
def _(spark, sf_dir):
    pages = spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id")
    return pages.select("page_id", M.html_to_text_basic(F.col("html")).alias("text"))


@query("SRC9_html_to_text_basic_cut", f"SELECT page_id, left({_BASIC}, {R.MAIL_BODY_CHARS}) AS text FROM pages")
def _(spark, sf_dir):
    pages = spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id")
    return pages.select("page_id", M.html_to_text_basic(F.col("html"), R.MAIL_BODY_CHARS).alias("text"))


@query("SRC9_html_to_text_basic_whole", f"SELECT page_id, {_BASIC} AS text FROM pages")
def _(spark, sf_dir):
    pages = spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id")
    return pages.select("page_id", M.html_to_text_basic(F.col("html"), None).alias("text"))


@query("SRC10_html_to_text", f"SELECT page_id, {O.html_to_text('html', None)} AS text FROM pages")
def _(spark, sf_dir):
    pages = spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id")
    return pages.select("page_id", M.html_to_text(F.col("html")).alias("text"))


@query("SRC10_html_to_text_cut", f"SELECT page_id, {O.html_to_text('html', R.MAIL_BODY_CHARS)} AS text FROM pages")
def _(spark, sf_dir):
    pages = spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id")
    return pages.select("page_id", M.html_to_text(F.col("html"), R.MAIL_BODY_CHARS).alias("text"))


@query("SRC10_html_to_text_whole", f"SELECT page_id, {O.html_to_text('html', None)} AS text FROM pages")
def _(spark, sf_dir):
    pages = spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id")
    return pages.select("page_id", M.html_to_text(F.col("html"), None).alias("text"))


@query(
    "SRC10_html_tables",
    "SELECT c_custkey, concat('Dear ', c_name, chr(10), 'Key | Segment', chr(10), cast(c_custkey as varchar), CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat(' | ', c_mktsegment, '\u2019s\u00a9') END, chr(10),"
    " 'Nation | ', cast(c_nationkey as varchar), chr(10), 'In all', chr(10), cast(c_acctbal as varchar), '\u20ac <b>') AS text FROM customer",
)
def _(spark, sf_dir):
    """Tables with tags, blanks and nothing in cells, a table inside a cell, cells without an end, entities by name and number."""
    table = "</p><TABLE class='t'><caption>Accounts</caption><tr><th>Key</th><th> &nbsp;</th><th>Seg<b>ment</b></th></tr>\n<tr><td><i>"
    segment = F.when(F.col("c_custkey") % 3 == 0, "&#160; ").otherwise(F.concat("c_mktsegment", F.lit("&#8217;<b>s</b>&copy;")))
    html = F.concat(
        F.lit("<style>td{}</style><p><!-- x --><img src=a>Dear "), "c_name", F.lit(table), F.col("c_custkey").cast("string"), F.lit("</i></td><td>"), segment,
        F.lit("<tr><td><table><tr><td>Nation<td><span> "), F.col("c_nationkey").cast("string"), F.lit(" </span></table></td></tr></table>In all<br>"), F.col("c_acctbal").cast("string"), F.lit("&#x20AC; &lt;b&gt;"),
    )
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return customers.select("c_custkey", M.html_to_text(html).alias("text"))


REASONS = MAIL.rstrip() + f",\nreasons AS (SELECT *, {O.block_reason()} AS reason FROM mail)\n"


@query("SRC11_read_blocklist", REASONS + "SELECT id, reason FROM reasons")
def _(spark, sf_dir):
    path = shared_dir(spark, "blocklist") + "/config"
    rules = B.Blocklist.default()
    config = json.dumps({"blocked_senders": rules.senders, "blocked_domains": rules.domains, "blocked_subject_patterns": rules.subjects})
    spark.createDataFrame([(config,)], "value string").coalesce(1).write.text(path)
    rules = files.blocklist_rules(files.read_blocklist(spark, path))
    return B.with_reason(V.mail(spark, sf_dir), rules).select("id", "reason")


# --- filters --------------------------------------------------------------------------------


@query("FLT1_block_reason", REASONS + "SELECT id, sender, subject, reason FROM reasons")
def _(spark, sf_dir):
    return V.mail(spark, sf_dir).select("id", "sender", "subject", B.block_reason(F.col("sender"), F.col("subject")).alias("reason"))


@query("FLT1_drop_blocked", REASONS + "SELECT id FROM reasons WHERE reason = ''")
def _(spark, sf_dir):
    return B.drop_blocked(V.mail(spark, sf_dir)).select("id")


@query(
    "FLT2_is_promotional",
    MAIL + f"SELECT id, {O.is_promotional('subject', 'body')} AS by_text, {O.promo_merchant('sender_name')} AS by_merchant FROM mail",
)
def _(spark, sf_dir):
    return V.mail(spark, sf_dir).select(
        "id",
        E.is_promotional(F.col("subject"), F.col("body")).alias("by_text"),
        E.is_promotional_merchant(F.col("sender_name")).alias("by_merchant"),
    )


@query("FLT3_marketing_footer", MAIL + f"SELECT id, {O.marketing_footer('body')} AS footer FROM mail")
def _(spark, sf_dir):
    return V.mail(spark, sf_dir).select("id", E.marketing_footer(F.col("body")).alias("footer"))


@query("FLT4_has_confirmation", MAIL + f"SELECT id, {O.has_confirmation('subject', 'body')} AS confirmed FROM mail")
def _(spark, sf_dir):
    return V.mail(spark, sf_dir).select("id", E.has_confirmation(F.col("subject"), F.col("body")).alias("confirmed"))


@query(
    "FLT5_unconfirmed_large",
    MAIL
    + f"SELECT id, list_max({O.amounts('body', 'subject')}) AS amount FROM mail WHERE list_max({O.amounts('body', 'subject')}) > 500"
    f" AND NOT {O.has_confirmation('subject', 'body')}",
)
def _(spark, sf_dir):
    amount = F.array_max(E.amounts(F.col("body"), F.col("subject")))
    found = computed_once(V.mail(spark, sf_dir), ["id", "subject", "body"], {"amount": amount})
    return found.where((F.col("amount") > R.LARGE_AMOUNT) & ~E.has_confirmation(F.col("subject"), F.col("body"))).select("id", "amount")


# --- injection ---------------------------------------------------------------------------------


_FOUND = O.patterns_found("body")


@query("INJ1_patterns_found", MAIL + f"SELECT id, array_to_string({_FOUND}, ';') AS patterns FROM mail")
def _(spark, sf_dir):
    return V.mail(spark, sf_dir).select("id", joined(IF.patterns_found(F.col("body"))).alias("patterns"))


@query("INJ2_base64_payload", MAIL + f"SELECT id, {O.base64_payload('body')} AS encoded FROM mail")
def _(spark, sf_dir):
    return V.mail(spark, sf_dir).select("id", IF.base64_payload(F.col("body")).alias("encoded"))


_SCANNED = MAIL.rstrip() + f",\nscanned AS (SELECT id, subject, {_FOUND} AS found FROM mail)\n"


@query(
    "INJ3_injection_scan",
    _SCANNED + f"SELECT id, len(found) > 0 AS is_suspicious, array_to_string(found, ';') AS patterns, {O.risk('found')} AS risk_level FROM scanned",
)
def _(spark, sf_dir):
    return I.injection_scan(V.mail(spark, sf_dir), "body").select(
        "id", "is_suspicious", joined("patterns_found").alias("patterns"), "risk_level"
    )


@query(
    "INJ3_injection_scan_conversations",
    f"WITH scanned AS (SELECT conv_id, turn, {O.patterns_found('text')} AS found FROM conversations)"
    f" SELECT conv_id, turn, len(found) > 0 AS is_suspicious, array_to_string(found, ';') AS patterns, {O.risk('found')} AS risk_level FROM scanned",
)
def _(spark, sf_dir):
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return I.injection_scan(conversations, "text").select(
        "conv_id", "turn", "is_suspicious", joined("patterns_found").alias("patterns"), "risk_level"
    )


@query(
    "INJ4_security_flags",
    _SCANNED + f"SELECT id AS email_id, subject, {O.risk('found')} AS risk_level, array_to_string(found, ';') AS patterns FROM scanned WHERE len(found) > 0",
)
def _(spark, sf_dir):
    flags = I.security_flags(I.injection_scan(V.mail(spark, sf_dir), "body"))
    return flags.select("email_id", "subject", "risk_level", joined("patterns_found").alias("patterns"))


@query(
    "INJ4_security_anomalies",
    _SCANNED
    + "SELECT sha256(concat('SECURITY|', id)) AS id, 'SECURITY' AS type, 'critical' AS severity,"
    " concat('Prompt injection detected in email ', id, ': patterns=[''', array_to_string(found, ''', '''), ''']') AS description,"
    " id AS transaction_ids, 'Review this email manually — may be phishing' AS recommended_action, false AS resolved FROM scanned WHERE len(found) > 0",
)
def _(spark, sf_dir):
    flags = I.security_flags(I.injection_scan(V.mail(spark, sf_dir), "body"))
    return I.security_anomalies(flags, AS_OF).withColumn("transaction_ids", joined("transaction_ids")).drop("created_at")


# --- extraction -----------------------------------------------------------------------------------


@query("EXT1_merchant", MAIL + f"SELECT id, {O.merchant('sender', 'subject', 'body')} AS merchant FROM mail")
def _(spark, sf_dir):
    return V.mail(spark, sf_dir).select("id", E.merchant(F.col("sender"), F.col("subject"), F.col("body")).alias("merchant"))


_AMOUNTS = O.amounts("body", "subject")


@query(
    "EXT2_amounts",
    MAIL + f"SELECT id, len({_AMOUNTS}) AS n, list_sum({_AMOUNTS}) AS total, list_min({_AMOUNTS}) AS least FROM mail",
)
def _(spark, sf_dir):
    found = computed_once(V.mail(spark, sf_dir), ["id"], {"a": E.amounts(F.col("body"), F.col("subject"))})
    total = F.when(F.size("a") > 0, F.aggregate("a", F.lit(0.0), lambda acc, x: acc + x))
    return found.select("id", F.size("a").cast("bigint").alias("n"), total.alias("total"), F.array_min("a").alias("least"))


@query("EXT3_amount", MAIL + f"SELECT id, list_max({_AMOUNTS}) AS amount FROM mail")
def _(spark, sf_dir):
    return V.mail(spark, sf_dir).select("id", F.array_max(E.amounts(F.col("body"), F.col("subject"))).alias("amount"))


@query("EXT4_body_date", MAIL + f"SELECT id, {O.body_date('body')} AS day FROM mail")
def _(spark, sf_dir):
    return V.mail(spark, sf_dir).select("id", E.body_date(F.col("body")).alias("day"))


@query("EXT5_header_date", MAIL + f"SELECT id, {O.header_date('date', AS_OF)} AS day FROM mail")
def _(spark, sf_dir):
    return V.mail(spark, sf_dir).select("id", E.header_date(F.col("date"), F.lit(AS_OF)).alias("day"))


@query("EXT6_payment_method", MAIL + f"SELECT id, {O.payment_method('body')} AS method FROM mail")
def _(spark, sf_dir):
    return V.mail(spark, sf_dir).select("id", E.payment_method(F.col("body")).alias("method"))


EXTRACTED = O.clean_mail(O.extracted_ctes()) + "\n"
LEDGER = O.clean_mail(O.ledger_ctes()) + "\n"


@query("EXT7_extract_transactions", EXTRACTED + "SELECT email_id, subject, merchant, amount, date, payment_method_type FROM extracted")
def _(spark, sf_dir):
    return extracted(spark, sf_dir)


_LEDGER_COLUMNS = "merchant, amount, category, is_subscription, source_email_id, confidence, subject, payment_method_type"


@query("EXT8_ledger_row", LEDGER + f"SELECT strftime(date, '%Y-%m-%d') AS day, {_LEDGER_COLUMNS} FROM ledger")
def _(spark, sf_dir):
    return ledger(spark, sf_dir).select(
        F.date_format("date", "yyyy-MM-dd").alias("day"), *_LEDGER_COLUMNS.split(", ")
    )


@query("EXT9_summary_merchant", MAIL + f"SELECT id, {O.summary_merchant()} AS merchant FROM mail")
def _(spark, sf_dir):
    return V.mail(spark, sf_dir).select("id", E.summary_merchant(F.col("sender_name"), F.col("sender_email")).alias("merchant"))


@query("EXT10_dollar_strings", MAIL + f"SELECT id, array_to_string(regexp_extract_all(body, {O.q(R.DOLLARS)}), ';') AS amounts FROM mail")
def _(spark, sf_dir):
    return V.mail(spark, sf_dir).select("id", joined(E.dollar_strings(F.col("body"))).alias("amounts"))


SUMMARY_ROWS = (
    O.clean_mail(
        f"summary_base AS (SELECT *, {O.summary_merchant()} AS merchant FROM clean),\n"
        f"summary_rows AS (SELECT date, merchant, regexp_extract_all(clean_text, {O.q(R.DOLLARS)}) AS amounts, subject,"
        f" {O.category_hint('subject', 'merchant')} AS category_hint, id AS email_id, seq FROM summary_base)"
    )
    + "\n"
)


@query("EXT11_summary_rows", SUMMARY_ROWS + "SELECT date, merchant, array_to_string(amounts, ';') AS amounts, subject, category_hint, email_id FROM summary_rows")
def _(spark, sf_dir):
    return X.summary_rows(clean(spark, sf_dir)).withColumn("amounts", joined("amounts")).drop("seq")


def _cue(word: str) -> str:
    return f"split_part(substr(body, instr(body, {O.q(word)}) + {len(word)}), chr(10), 1)"


_WORD = lambda s: f"nullif(regexp_extract({s}, '^\\s*(\\S+)', 1), '')"
_QUICK = (
    "coalesce(CASE "
    + " ".join(f"WHEN contains(body, {O.q(w)}) THEN {_WORD(_cue(w))}" for w in ("Merchant:", "merchant:", "payment to", "at "))
    + f" END, CASE WHEN contains(subject, 'at ') THEN {_WORD('split_part(subject, ' + O.q('at ') + ', -1)')}"
    + f" WHEN contains(subject, 'to ') THEN {_WORD('split_part(subject, ' + O.q('to ') + ', -1)')} END)"
)


@query(
    "EXT12_quick_merchant_amount",
    MAIL
    + f"SELECT id, {_QUICK} AS merchant, try_cast(replace(regexp_extract(concat(subject, ' ', body), '\\$(\\d{{1,3}}(?:,\\d{{3}})*(?:\\.\\d{{2}})?)', 1), ',', '') AS double) AS amount FROM mail",
)
def _(spark, sf_dir):
    return V.mail(spark, sf_dir).select(
        "id",
        E.quick_merchant(F.col("subject"), F.col("body")).alias("merchant"),
        E.quick_amount(F.col("subject"), F.col("body")).alias("amount"),
    )


# --- categories -------------------------------------------------------------------------------------


@query("CAT1_category", MAIL + f"SELECT id, {O.category('sender_name', 'subject')} AS category FROM mail")
def _(spark, sf_dir):
    return V.mail(spark, sf_dir).select("id", C.category(F.col("sender_name"), F.col("subject")).alias("category"))


@query("CAT2_category_hint", MAIL + f"SELECT id, {O.category_hint('subject', 'sender_name')} AS hint FROM mail")
def _(spark, sf_dir):
    return V.mail(spark, sf_dir).select("id", C.category_hint(F.col("subject"), F.col("sender_name")).alias("hint"))


@query("CAT3_is_subscription", MAIL + f"SELECT id, {O.is_subscription('sender_name', 'body')} AS subscribed FROM mail")
def _(spark, sf_dir):
    return V.mail(spark, sf_dir).select("id", C.is_subscription(F.col("sender_name"), F.col("body")).alias("subscribed"))


@query(
    "CAT4_categorize",
    MAIL
    + f"SELECT id, sender_name AS merchant, {O.category('sender_name', 'body')} AS category, {O.is_subscription('sender_name', 'body')} AS is_subscription,"
    f" list_max({_AMOUNTS}) AS amount, 0.6::DOUBLE AS confidence FROM mail",
)
def _(spark, sf_dir):
    rows = V.mail(spark, sf_dir).select(
        "id", F.col("sender_name").alias("merchant"), F.array_max(E.amounts(F.col("body"), F.col("subject"))).alias("amount"),
        F.col("body").alias("snippet"),
    )
    return X.categorize(rows).drop("snippet")


@query(
    "SQL_functions",
    MAIL
    + f"SELECT id, {O.category('sender_name', 'subject')} AS category, {O.payment_method('body')} AS method FROM mail",
)
def _(spark, sf_dir):
    register(spark)
    return V.mail(spark, sf_dir).selectExpr("id", "category_of(sender_name, subject) AS category", "payment_method(body) AS method")


@query(
    "FN_redact_and_risk",
    f"WITH {V.mail_cte()},\n{O.redacted('mail', 'body', 'done')},\nscanned AS (SELECT id, {_FOUND} AS found FROM mail)\n"
    f"SELECT id, clean_text, {O.risk('found')} AS risk FROM done JOIN scanned USING (id)",
)
def _(spark, sf_dir):
    """The SQL functions run all passes of the operators."""
    register(spark)
    return V.mail(spark, sf_dir).selectExpr("id", "redact_text(body) AS clean_text", "injection_risk(body) AS risk")


# --- joins and counters over mail -----------------------------------------------------------------------


@query("JN3_blocklist_join", REASONS + "SELECT id, reason FROM reasons")
def _(spark, sf_dir):
    return B.block_reason_join(V.mail(spark, sf_dir), B.Blocklist.default().table(spark)).select("id", "reason")


_PHRASES = (
    "phrases AS (SELECT concat('#', lpad(cast(c_custkey % 1000 as varchar), 3, '0')) AS phrase FROM customer UNION SELECT concat('firmation #', lpad(cast(c_custkey % 100 as varchar), 2, '0')) FROM customer"
    " UNION SELECT lpad(cast(c_custkey * 7 as varchar), 5, '0') FROM customer UNION SELECT lower(concat('for you in ', left(c_mktsegment, 4))) FROM customer UNION SELECT concat('never ', c_name, ' seen') FROM customer),\n"
)


@query(
    "JN3_many_phrases",
    f"WITH {_PHRASES}{V.mail_cte()}\nSELECT id, CASE WHEN EXISTS (SELECT 1 FROM phrases WHERE contains(lower(subject), phrase)) THEN 'subject' ELSE '' END AS reason FROM mail",
)
def _(spark, sf_dir):
    """Phrases that start and end inside words, one word or several, most of them in no subject."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    key = F.col("c_custkey")
    padded = lambda n, size: F.lpad(n.cast("string"), size, "0")
    values = [
        F.concat(F.lit("#"), padded(key % 1000, 3)), F.concat(F.lit("firmation #"), padded(key % 100, 2)), padded(key * 7, 5),
        F.lower(F.concat(F.lit("for you in "), F.left("c_mktsegment", F.lit(4)))), F.concat(F.lit("Never "), "c_name", F.lit(" seen")),
    ]
    rules = customer.select(F.lit("subject").alias("kind"), F.explode(F.array(*values)).alias("value"))
    return B.block_reason_join(V.mail(spark, sf_dir), rules).select("id", "reason")


@query("JN4_meta_body", MAIL + "SELECT id, sender_email, length(body) AS n FROM mail")
def _(spark, sf_dir):
    mail = V.mail(spark, sf_dir)
    both = MO.mail_with_body(mail.select("id", "sender_email"), V.mail(spark, sf_dir).select("id", "body"))
    return both.select("id", "sender_email", F.length("body").cast("bigint").alias("n"))


_SPENT = SUMMARY_ROWS.rstrip() + ",\nspent AS (SELECT merchant, category_hint, seq, cast(replace(replace(t, '$', ''), ',', '') as double) AS amount FROM (SELECT *, unnest(amounts) AS t FROM summary_rows) WHERE try_cast(replace(replace(t, '$', ''), ',', '') as double) IS NOT NULL)\n"


@query(
    "AGG7_local_summary",
    _SPENT
    + "SELECT 'last 7 days' AS period, round(sum(amount), 2) AS total_spent,"
    " (SELECT string_agg(concat(category_hint, '=', cast(cast(t as decimal(18,2)) as varchar)), ';' ORDER BY category_hint) FROM (SELECT category_hint, round(sum(amount), 2) AS t FROM spent GROUP BY 1)) AS by_category,"
    " (SELECT string_agg(concat(merchant, '=', cast(cast(t as decimal(18,2)) as varchar), '/', cast(n as varchar)), ';' ORDER BY t DESC, f) FROM"
    " (SELECT merchant, sum(amount) AS t, count(*) AS n, min(seq) AS f FROM spent GROUP BY 1 ORDER BY t DESC, f LIMIT 5)) AS top_merchants FROM spent",
)
def _(spark, sf_dir):
    out = X.local_summary(X.summary_rows(clean(spark, sf_dir)))
    text = lambda x: x.cast("decimal(18,2)").cast("string")
    return out.select(
        "period",
        "total_spent",
        F.array_join(F.transform(F.map_entries("by_category"), lambda e: F.concat(e["key"], F.lit("="), text(e["value"]))), ";").alias("by_category"),
        F.array_join(F.transform("top_merchants", lambda m: F.concat(m["name"], F.lit("="), text(m["total"]), F.lit("/"), m["count"].cast("string"))), ";").alias("top_merchants"),
    )


@query(
    "SRT3_top_merchants",
    _SPENT + "SELECT merchant, round(sum(amount), 2) AS total, count(*) AS n FROM spent GROUP BY 1 ORDER BY sum(amount) DESC, min(seq) LIMIT 5",
)
def _(spark, sf_dir):
    top = X.local_summary(X.summary_rows(clean(spark, sf_dir))).select(F.inline("top_merchants"))
    return top.select(F.col("name").alias("merchant"), "total", F.col("count").alias("n"))


@query("AGG8_ledger_total", LEDGER + "SELECT count(*) AS n, round(sum(amount), 2) AS total FROM ledger")
def _(spark, sf_dir):
    return L.ledger_total(ledger(spark, sf_dir))


PIPELINE_COLUMNS = (
    "(SELECT count(*) FROM reasons) AS fetched, (SELECT count(*) FROM reasons WHERE reason <> '') AS blocked,"
    " (SELECT cast(sum(redaction_count) as bigint) FROM clean) AS redacted, 0 AS failed_closed,"
    f" (SELECT count(*) FROM (SELECT {O.patterns_found('clean_text')} AS found FROM clean) WHERE len(found) > 0) AS injections,"
    " (SELECT count(*) FROM extracted) AS extracted"
)


@query("AGG9_pipeline_stats", EXTRACTED + f"SELECT {PIPELINE_COLUMNS}")
def _(spark, sf_dir):
    staged = written(staged_mail(V.mail(spark, sf_dir)), "staged")
    return MO.pipeline_stats(staged, X.extract_transactions(passed(staged), AS_OF))


_STATS_SQL = (
    "count(*) AS total_checks, cast(count_if(reason <> '') as bigint) AS blocked_count, cast(count_if(reason = 'sender') as bigint) AS blocked_by_sender,"
    " cast(count_if(reason = 'domain') as bigint) AS blocked_by_domain, cast(count_if(reason = 'subject') as bigint) AS blocked_by_subject,"
    " round(count_if(reason <> '') * 100.0::DOUBLE / count(*), 1) AS block_rate"
)


@query("AGG11_blocklist_stats", REASONS + f"SELECT {_STATS_SQL} FROM reasons")
def _(spark, sf_dir):
    reasons = V.mail(spark, sf_dir).select(B.block_reason(F.col("sender"), F.col("subject")).alias("reason"))
    return B.blocklist_stats(reasons)


@query(
    "SNK6_scan_report",
    LEDGER
    + f"SELECT (SELECT count(*) FROM ledger) AS total_transactions, (SELECT round(sum(amount), 2) FROM ledger) AS total_amount, {PIPELINE_COLUMNS},"
    " (SELECT count(*) FROM clean) AS total_mails, (SELECT count(*) FROM clean WHERE NOT is_valid) AS failed_mails, 30 AS query_days",
)
def _(spark, sf_dir):
    staged = written(staged_mail(V.mail(spark, sf_dir)), "staged")
    good = passed(staged)
    rows = written(X.ledger_rows(X.extract_transactions(good, AS_OF), AS_OF), "ledger")
    report = MO.scan_report(MO.pipeline_stats(staged, rows), redaction_stats(good), L.ledger_total(rows), 30)
    back = F.from_json(
        "report",
        "total_transactions bigint, total_amount double, query_days int,"
        " pipeline_stats struct<fetched:bigint,blocked:bigint,redacted:bigint,failed_closed:bigint,injections:bigint,extracted:bigint>,"
        " redaction_stats struct<total_mails:bigint,failed_mails:bigint>",
    )
    return report.select(back.alias("r")).select(
        "r.total_transactions", "r.total_amount", "r.query_days", "r.pipeline_stats.*", "r.redaction_stats.*"
    )


@query("SET2_distinct_amounts", MAIL + f"SELECT id, unnest({_AMOUNTS}) AS amount FROM mail")
def _(spark, sf_dir):
    return V.mail(spark, sf_dir).select("id", F.explode(E.amounts(F.col("body"), F.col("subject"))).alias("amount"))


@query("SRT5_sorted_amounts", MAIL + f"SELECT id, a[1] AS least, a[-1] AS largest FROM (SELECT id, {_AMOUNTS} AS a FROM mail) WHERE len(a) > 0")
def _(spark, sf_dir):
    found = computed_once(V.mail(spark, sf_dir), ["id"], {"a": E.amounts(F.col("body"), F.col("subject"))})
    return found.where(F.size("a") > 0).select("id", F.get("a", 0).alias("least"), F.element_at("a", -1).alias("largest"))


@query("SET3_risk_overlap", _SCANNED + f"SELECT {O.risk('found')} AS risk_level, count(*) AS n FROM scanned GROUP BY 1")
def _(spark, sf_dir):
    return I.injection_scan(V.mail(spark, sf_dir), "body").groupBy("risk_level").agg(F.count("*").alias("n"))


@query(
    "SRT4_newest_mail",
    MAIL + f"SELECT id, subject FROM mail WHERE {_financial_sql(3650)} ORDER BY {O.header_date('date', AS_OF)} DESC, id LIMIT 100",
)
def _(spark, sf_dir):
    return MO.financial_mail(V.mail(spark, sf_dir), AS_OF, days=3650, max_results=100).select("id", "subject")


# --- the rules that read only the front of a text, as the fixed values say -----------------------


@query("FLT2_is_promotional_window", MAIL + f"SELECT id, {O.is_promotional('subject', 'body', R.PROMO_BODY_CHARS)} AS by_text FROM mail")
def _(spark, sf_dir):
    return V.mail(spark, sf_dir).select("id", E.is_promotional(F.col("subject"), F.col("body"), chars=R.PROMO_BODY_CHARS).alias("by_text"))


@query("FLT4_has_confirmation_window", MAIL + f"SELECT id, {O.has_confirmation('subject', 'body', R.CONFIRM_BODY_CHARS)} AS confirmed FROM mail")
def _(spark, sf_dir):
    return V.mail(spark, sf_dir).select("id", E.has_confirmation(F.col("subject"), F.col("body"), R.CONFIRM_BODY_CHARS).alias("confirmed"))


@query(
    "EXT1_merchant_window",
    MAIL + f"SELECT id, {O.merchant('sender', 'subject', 'body', R.MERCHANT_BODY_CHARS, R.MERCHANT_CHARS)} AS merchant FROM mail",
)
def _(spark, sf_dir):
    name = E.merchant(F.col("sender"), F.col("subject"), F.col("body"), R.MERCHANT_BODY_CHARS, R.MERCHANT_CHARS)
    return V.mail(spark, sf_dir).select("id", name.alias("merchant"))


@query("EXT4_body_date_window", MAIL + f"SELECT id, {O.body_date('body', R.DATE_CHARS)} AS day FROM mail")
def _(spark, sf_dir):
    return V.mail(spark, sf_dir).select("id", E.body_date(F.col("body"), R.DATE_CHARS).alias("day"))


@query("EXT6_payment_method_window", MAIL + f"SELECT id, {O.payment_method('body', R.PAYMENT_CHARS)} AS method FROM mail")
def _(spark, sf_dir):
    return V.mail(spark, sf_dir).select("id", E.payment_method(F.col("body"), R.PAYMENT_CHARS).alias("method"))


_LATE = "concat(repeat('Our members read this letter with joy. ', 60), body)"


@query(
    "EXT7_late_receipt",
    MAIL
    + f"SELECT id, {O.merchant(O.q('noreply@x'), O.q(''), _LATE)} AS merchant, {O.body_date(_LATE)} AS day, {O.payment_method(_LATE)} AS method FROM mail",
)
def _(spark, sf_dir):
    """Merchant, date and card that stand behind the first 2,000 characters of a mail."""
    late = F.concat(F.repeat(F.lit("Our members read this letter with joy. "), F.lit(60)), F.col("body"))
    found = {"merchant": E.merchant(F.lit("noreply@x"), F.lit(""), late), "day": E.body_date(late), "method": E.payment_method(late)}
    return V.mail(spark, sf_dir).select("id", *[c.alias(n) for n, c in found.items()])


_SHOPS = tuple(f"shop{n:04d}.example" for n in range(2500))
_DOMAIN = "trim(split_part(trim(split_part(lower(sender), '<', -1), '>'), '@', -1))"


@query(
    "SRC11_large_blocklist",
    REASONS
    + f"SELECT id, CASE WHEN reason IN ('sender', 'domain') THEN reason WHEN contains(sender, '@') AND regexp_full_match({_DOMAIN}, 'shop([01][0-9]|2[0-4])[0-9][0-9]\\.example') THEN 'domain' ELSE reason END AS reason FROM reasons",
)
def _(spark, sf_dir):
    """A list of more entries than are written into a plan takes the join form."""
    path = shared_dir(spark, "blocklist") + "/config"
    rules = B.Blocklist.default()
    config = json.dumps({"blocked_senders": rules.senders, "blocked_domains": [*rules.domains, *_SHOPS], "blocked_subject_patterns": rules.subjects})
    spark.createDataFrame([(config,)], "value string").coalesce(1).write.text(path)
    return B.with_reason(V.mail(spark, sf_dir), files.blocklist_rules(files.read_blocklist(spark, path))).select("id", "reason")
