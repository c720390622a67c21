"""Raw-message functions: base64url text, headers, MIME bodies, HTML to text."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules.extraction import TRUNCATION_MARK
from .text import collapse_spaces, head, let, strip, text_or_empty


def b64url_text(data: Column) -> Column:
    """base64url -> text; bytes that are not UTF-8 become U+FFFD."""
    standard = F.translate(data, "-_", "+/")
    return F.make_valid_utf8(F.unbase64(standard).cast("string"))


def header(headers: Column, name: str) -> Column:
    """Value of the first header with this name in any case, else ''."""
    hit = F.filter(headers, lambda h: F.lower(h["name"]) == name.lower())
    return text_or_empty(F.get(hit, 0)["value"])


def parse_from(value: Column) -> Column:
    """'Name <a@b>' -> struct(sender, sender_email); any other text fills both."""
    shape = r"(?Ud)^(.+?)\s*<(.+?)>$"
    plain = strip(value)
    named = value.rlike(shape)
    name = F.regexp_replace(strip(F.regexp_extract(value, shape, 1)), r'^"+|"+$', "")
    address = strip(F.regexp_extract(value, shape, 2))
    return F.struct(
        F.when(named, name).otherwise(plain).alias("sender"),
        F.when(named, address).otherwise(plain).alias("sender_email"),
    )


def truncated(text: Column, max_chars: int | None = None) -> Column:
    """Cut an over-long mail body and mark the cut; ``None`` keeps the whole text."""
    if max_chars is None:
        return text
    return let(text, lambda t: F.when(F.length(t) > max_chars, F.concat(head(t, max_chars), F.lit(TRUNCATION_MARK))).otherwise(t))


def html_to_text_basic(html: Column, max_chars: int | None = None) -> Column:
    """Tags to blanks, white space collapsed, trimmed, cut."""
    text = strip(collapse_spaces(F.regexp_replace(html, r"<[^>]+>", " ")))
    return text if max_chars is None else head(text, max_chars)


# Parts of a page that are never read. The mark left behind is a tag, so the texts on both sides stay apart.
MARK = "<_>"
HTML_UNREAD = (
    r"(?s)<!--.*?-->",
    r"(?is)<(script|style|head|svg|noscript)\b[^>]*>.*?</\1\s*>",
    r"(?i)<(?:meta|link|img)\b[^>]*>",
)
TAG = r"<(?:[/!?]|[A-Za-z_])[^>]*>"
GRID_TAG = r"(?is)<(/?(?:table|tr|t[dh]))\b[^>]*>"
ENCODED_TEXT = r"(?i)data:image|Content-Transfer-Encoding:\s*base64"
LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"
ENTITY = r"&(?:#[0-9]+;?|#[xX][0-9A-Fa-f]+;?|[A-Za-z][A-Za-z0-9]*;)"
GRID_STEP = 64  # tags folded at once; appending to a list copies it, so short lists are made and put together


def _entity(entity: Column) -> Column:
    """The character that an entity stands for; unknown names stay as they are."""
    names = F.expr(f"map_from_arrays(split('{' '.join(name2codepoint)}', ' '), cast(split('{' '.join(map(str, name2codepoint.values()))}', ' ') AS array<bigint>))")
    digits = F.regexp_extract(entity, r"^&#[xX]?([0-9A-Fa-f]{1,8}?);?$", 1)
    base = F.when(F.lower(entity).startswith("&#x"), F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("bigint")
    point = F.when(entity.startswith("&#"), base).otherwise(F.try_element_at(names, F.regexp_replace(entity, "[&;]", "")))
    char = lambda p: F.when(p.between(1, 0xD7FF) | p.between(0xE000, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(p), 8, "0")), "UTF-32"))
    return F.coalesce(let(point, char), F.when(entity.startswith("&#"), "").otherwise(entity))


def decode_entities(text: Column) -> Column:
    """Named and numeric entities to characters, each once: ``&amp;lt;`` becomes ``&lt;``."""
    between = F.split(text, ENTITY, -1)
    found = F.transform(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)), _entity)
    put = F.zip_with(between, F.concat(found, F.array(F.lit(""))), lambda t, e: F.concat(t, e))
    return F.when(text.contains("&"), F.array_join(put, "")).otherwise(text)


def _texts(part: Column) -> Column:
    """Decoded texts between the tags, without blocks of encoded data."""
    return F.filter(F.transform(F.split(part, TAG), decode_entities), lambda t: ~t.rlike(ENCODED_TEXT))


def _grid_text(html: Column) -> Column:
    """Text of a page with tables: a walk over the table tags with a stack of what is open.

    The stack is a text: t table, r row (R: has text), c cell (C: has text, N: a table
    inside it has ended). A new row, cell or table end closes what it must.
    """
    parts, tags = F.split(html, GRID_TAG, -1), F.transform(F.regexp_extract_all(html, F.lit(GRID_TAG), F.lit(1)), F.lower)
    row = F.struct(parts.alias("parts"), F.concat(tags, F.array(F.lit(""))).alias("tags"))

    def shown(stack: Column, texts: Column, inside: Column) -> Column:
        """What a text adds to the page; ``inside`` is it within a cell, '' outside of one."""
        between = F.when(stack.endswith("C"), "").when(stack.endswith("N"), "\n").when(stack.endswith("Rc"), " | ").otherwise("\n")
        return F.when(inside != "", F.concat(between, inside)).when(stack == "", F.concat(F.lit("\n"), F.array_join(texts, "\n"), F.lit("\n"))).otherwise("")

    def moved(stack: Column, tag: Column) -> Column:
        """The stack behind a tag."""
        no_cell = F.regexp_replace(stack, "[cCN]$", "")
        to_table = F.regexp_replace(stack, "[^t]+$", "")
        outside = F.regexp_replace(F.regexp_replace(stack, "t[^t]*$", ""), "[cC]$", "N")
        return (
            F.when(tag == "table", F.concat(stack, F.lit("t")))
            .when(stack == "", stack)
            .when(tag == "/table", outside)
            .when(tag == "tr", F.concat(to_table, F.lit("r")))
            .when(tag == "/tr", to_table)
            .when(tag.isin("td", "th"), F.concat(no_cell, F.when(no_cell.endswith("t"), "rc").otherwise("c")))
            .when(tag.isin("/td", "/th"), no_cell)
            .otherwise(stack)
        )

    def step(state: Column, k: Column, row: Column) -> Column:
        stack = state["stack"]

        def with_texts(texts: Column) -> Column:
            inside = F.when(stack.rlike("[cCN]$"), F.array_join(F.transform(texts, strip), "")).otherwise("")
            return let(inside, lambda i: with_inside(texts, i))

        def with_inside(texts: Column, inside: Column) -> Column:
            after = F.when(inside != "", F.regexp_replace(stack, "[rR][cCN]$", "RC")).otherwise(stack)
            behind = let(after, lambda a: moved(a, F.get(row["tags"], k)))
            return F.struct(behind.alias("stack"), F.concat(state["shown"], F.array(shown(stack, texts, inside))).alias("shown"))

        return let(_texts(F.get(row["parts"], k)), with_texts)

    none = F.array().cast("array<string>")

    def steps(state: Column, k: Column, row: Column) -> Column:
        last = F.least(F.size(row["parts"]), (k + 1) * GRID_STEP) - 1
        start = F.struct(state["stack"].alias("stack"), none.alias("shown"))
        read_some = F.aggregate(F.sequence(k * GRID_STEP, last), start, lambda s, i: step(s, i, row))
        return let(read_some, lambda r: F.struct(r["stack"].alias("stack"), F.concat(state["shown"], F.array(F.array_join(r["shown"], ""))).alias("shown")))

    def walk(row: Column) -> Column:
        groups = F.sequence(F.lit(0), F.floor((F.size(row["parts"]) - 1) / GRID_STEP).cast("int"))
        start = F.struct(F.lit("").alias("stack"), none.alias("shown"))
        return F.aggregate(groups, start, lambda s, k: steps(s, k, row), lambda s: F.array_join(s["shown"], ""))

    return let(row, walk)


def html_to_text(html: Column, max_chars: int | None = None) -> Column:
    """Readable lines of an HTML page.

    Comments, script, style, head, svg, noscript, meta, link and img go, and texts
    that hold encoded images or attachments. Every tag ends a line, but for those in
    a table cell, whose texts are put together; the cells of a row that have text are
    joined by ' | '. A table inside a cell is read as rows of its own. Named and
    numeric entities are decoded; lines are trimmed and empty ones dropped; the
    result is cut at ``max_chars`` with a marker.
    """
    read = html
    for regex in HTML_UNREAD:
        read = F.regexp_replace(read, regex, MARK)
    text = let(read, lambda r: F.when(r.rlike(r"(?i)<t[dh]\b"), _grid_text(r)).otherwise(F.array_join(_texts(r), "\n")))
    lines = F.transform(F.split(text, LINE_END), strip)
    joined = F.array_join(F.filter(lines, lambda line: line != ""), "\n")
    return truncated(joined, max_chars)


def mime_text(payload: Column, depth: int, max_chars: int | None = None) -> Column:
    """Body text of a MIME payload whose schema nests ``depth`` levels of parts.

    A single text part is the body. Otherwise the parts are walked in order: the
    last plain sibling wins, a nested part only fills an empty plain slot, and
    HTML is used when no plain text was found.
    """
    data = payload["body"]["data"]
    kind = payload["mimeType"]
    has_data = text_or_empty(data) != ""
    body = F.when(has_data & (kind == "text/plain"), truncated(b64url_text(data), max_chars)).when(
        has_data & (kind == "text/html"), html_to_text(b64url_text(data), max_chars)
    )
    if depth == 0:
        return F.coalesce(body, F.lit(""))

    def step(found: Column, part: Column) -> Column:
        part_data = text_or_empty(part["body"]["data"])
        plain = F.when((part["mimeType"] == "text/plain") & (part_data != ""), b64url_text(part_data)).otherwise(
            found["plain"]
        )
        html = F.when((part["mimeType"] == "text/html") & (part_data != ""), b64url_text(part_data)).otherwise(
            found["html"]
        )
        if depth > 1:
            nested = F.when(F.size(part["parts"]) > 0, mime_text(part, depth - 1, max_chars)).otherwise(F.lit(""))
            plain = F.when(plain == "", nested).otherwise(plain)
        return F.struct(text_or_empty(plain).alias("plain"), text_or_empty(html).alias("html"))

    nothing = F.struct(F.lit("").alias("plain"), F.lit("").alias("html"))
    walked = F.aggregate(
        payload["parts"],
        nothing,
        step,
        lambda found: F.when(found["plain"] != "", truncated(found["plain"], max_chars)).otherwise(
            html_to_text(found["html"], max_chars)
        ),
    )
    return F.coalesce(body, walked, F.lit(""))


PART = "mimeType string, body struct<data:string>, parts array<string>"


def mime_text_of_json(payload: Column, max_chars: int | None = None) -> Column:
    """``mime_text`` of a payload given as JSON text, nested to any depth.

    The text is parsed once, as a variant, whose parts are cut out of it without
    another parse. What no strict parser takes (single quotes, names that come twice,
    a list instead of a part) is read by ``from_json``, level by level.
    """
    value = lambda v, path, kind: F.try_variant_get(v, path, kind)
    fields = lambda v: F.struct(value(v, "$.mimeType", "string").alias("mimeType"), F.struct(value(v, "$.body.data", "string").alias("data")).alias("body"), value(v, "$.parts", "array<variant>").alias("parts"))
    strict = F.when(payload.startswith("{"), F.try_parse_json(payload))
    by_text = _walked(payload, payload, lambda text: F.from_json(text, PART), "string", max_chars)
    return let(strict, lambda v: F.when(v.isNull(), by_text).otherwise(_walked(payload, v, fields, "variant", max_chars)))


def _walked(payload: Column, whole: Column, parse: Callable[[Column], Column], kind: str, max_chars: int | None) -> Column:
    """Body text of the part ``whole``; ``parse`` opens a part of type ``kind`` one level deep.

    Of a multipart's own plain parts the last one wins. Without a text there, the
    multiparts behind it are tried in order, then its last HTML part. So what is
    still to be tried is a list, and the first text found is the body. A step tries
    one entry: a multipart or the HTML of one, and each needs a bracket of
    ``payload``, so twice the brackets bound the steps.
    """
    data_of = lambda p, k: F.when((p["mimeType"] == k) & (text_or_empty(p["body"]["data"]) != ""), p["body"]["data"])
    entry = f"struct<parts:array<{kind}>,html:string>"
    nothing = F.array().cast(f"array<{entry}>")
    no_parts, no_html = F.lit(None).cast(f"array<{kind}>"), F.lit(None).cast("string")

    def seen(p: Column) -> Column:
        return F.struct(data_of(p, "text/plain").alias("plain"), data_of(p, "text/html").alias("html"), p["parts"].alias("parts"))

    def to_try(parts: Column, html: Column) -> Column:
        return F.struct(parts.alias("parts"), html.alias("html"))

    def state(text: Column, todo: Column) -> Column:
        """Once a text is found nothing is left to try."""
        return F.struct(text.alias("text"), F.when(text != "", nothing).otherwise(todo).alias("todo"))

    def read(parts: Column, rest: Column) -> Column:
        """The state after the multipart of these parts."""
        last = F.array_max(F.transform(parts, lambda p, i: F.when(p["plain"].isNotNull(), i).otherwise(-1)))
        html = F.array_compact(parts["html"])

        def after(at: Column) -> Column:
            text = F.when(at >= 0, b64url_text(F.get(parts, at)["plain"])).otherwise(F.lit(""))
            behind = F.filter(F.slice(parts, at + 2, F.size(parts)), lambda p: F.size(p["parts"]) > 0)
            # A multipart that has an HTML text of its own is not opened.
            inner = F.transform(behind, lambda p: to_try(F.when(p["html"].isNull(), p["parts"]).otherwise(no_parts), p["html"]))
            own = F.when(F.size(html) > 0, F.array(to_try(no_parts, F.get(html, F.size(html) - 1)))).otherwise(nothing)
            return let(text, lambda t: state(t, F.concat(inner, own, rest)))

        return let(last, after)

    def step(s: Column, _: Column) -> Column:
        first, rest = F.get(s["todo"], 0), F.slice(s["todo"], F.lit(2), F.greatest(F.size(s["todo"]), F.lit(1)))
        shown = let(html_to_text(b64url_text(first["html"]), max_chars), lambda t: state(t, rest))
        opened = let(F.transform(first["parts"], lambda c: let(parse(c), seen)), lambda parts: read(parts, rest))
        return F.when(F.size(s["todo"]) == 0, s).when(first["html"].isNotNull(), shown).otherwise(opened)

    def body(p: Column) -> Column:
        single = F.when(data_of(p, "text/plain").isNotNull(), truncated(b64url_text(p["body"]["data"]), max_chars)).when(
            data_of(p, "text/html").isNotNull(), html_to_text(b64url_text(p["body"]["data"]), max_chars)
        )
        brackets = F.length(payload) - F.length(F.replace(payload, F.lit("["), F.lit("")))
        start = state(F.lit(""), F.when(F.size(p["parts"]) > 0, F.array(to_try(p["parts"], no_html))).otherwise(nothing))
        walked = F.aggregate(F.sequence(F.lit(1), F.greatest(2 * brackets, F.lit(1))), start, step, lambda s: truncated(s["text"], max_chars))
        return F.coalesce(single, walked, F.lit(""))

    return let(parse(whole), body)
