"""Whitespace, HTML and hashing expressions."""

from __future__ import annotations

import html.entities
import json
from collections.abc import Callable, Iterable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions.patterns import SPACE

# --- Fixed values: tags that break a line, and tags whose content is hidden ---
BLOCK_TAGS = (
    "p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6",
    "section", "article", "ul", "ol", "table", "blockquote",
)
HIDDEN_TAGS = ("script", "style", "head")
# --- End of fixed values ------------------------------------------------------

# Attribute lists are matched possessively: Java walks a possessive group in a
# loop, so a tag with a huge attribute cannot exhaust the stack.
_ATTRS = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
_ATTRS_BEFORE_SLASH = r"""(?:[^>"'/]++|/(?!>)|"[^"]*+"|'[^']*+')*+"""
_WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
_HIDDEN = (
    r"(?is)<!--.*?--\s*>"
    rf"|<({'|'.join(HIDDEN_TAGS)})(?=[\s/>]){_ATTRS_BEFORE_SLASH}>.*?(?:</\1\s*>|\z)"
    r"|<!(?!--)[^>]*>|<\?[^>]*>"
)
_BLOCK = "|".join(BLOCK_TAGS)
_BLOCK_SELF_CLOSED = rf"(?i)<(?:{_BLOCK})(?=[\s/>]){_ATTRS_BEFORE_SLASH}/>"
_BLOCK_ANY = rf"(?i)<(?:{_BLOCK})(?=[\s/>]){_ATTRS}>|</(?:{_BLOCK})(?=[\s/>])[^>]*>"
_TAG = rf"<[a-zA-Z]{_ATTRS}>|<[a-zA-Z][^>]*>|</[^>]*>"
_ENTITY = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``.

    Spark shares repeated subexpressions only where they are evaluated
    unconditionally; inside a ``when`` branch this keeps them from being redone.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Trim all Unicode whitespace, not just spaces. Touches only the two ends."""
    return F.btrim(c, F.lit(_WHITESPACE))


def literal(value: object, ddl: str) -> Column:
    """A map or array constant as one expression; Spark folds it when planning."""
    return F.from_json(F.lit(json.dumps(value)), ddl)


def lookup(key: Column, table: dict, ddl: str = "string") -> Column:
    """A small constant table; null for a null or unknown key."""
    return F.try_element_at(literal(table, f"map<string,{ddl}>"), key)


def strip_or_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def collapse_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, rf"(?U){SPACE}+", " "))


def collapse_blank_lines(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)\n{SPACE}*\n{SPACE}*", "\n\n")


def html_to_text(c: Column) -> Column:
    """Readable text of an HTML fragment.

    Text without ``<`` is only stripped; its entities are left as they are.
    """
    return F.when(c.contains("<"), _strip_markup(c)).otherwise(collapse_blank_lines(strip(c)))


def _strip_markup(c: Column) -> Column:
    visible = F.regexp_replace(c, _HIDDEN, "")
    broken = F.regexp_replace(visible, _BLOCK_SELF_CLOSED, "\n\n")
    broken = F.regexp_replace(broken, _BLOCK_ANY, "\n")
    bare = F.regexp_replace(broken, _TAG, "")
    spaced = F.regexp_replace(decode_entities(bare), r"[ \t\r\f\x0b]+", " ")
    return strip(collapse_blank_lines(spaced))


def decode_entities(c: Column) -> Column:
    """Decode character references in one pass, so ``&amp;lt;`` gives ``&lt;``.

    The text is cut at its references, each is decoded on its own, and the
    pieces are joined again. Rows without ``&`` skip all of it.
    """
    return bind(
        c,
        lambda text: F.when(
            text.contains("&"),
            F.array_join(
                F.zip_with(
                    F.split(text, _ENTITY),
                    F.transform(F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(0)), _decode_one),
                    lambda piece, char: F.concat(piece, F.coalesce(char, F.lit(""))),
                ),
                "",
            ),
        ).otherwise(text),
    )


def _decode_one(token: Column) -> Column:
    # The references that make up nearly all of real feeds.
    common = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#x27;": "'", "&nbsp;": " "}
    rare = F.when(token.startswith("&#"), _numeric(token)).otherwise(_named(token))
    return F.coalesce(lookup(token, common), rare)


def _numeric(token: Column) -> Column:
    digits = F.regexp_extract(token, r"\A&#(?:[xX]([0-9a-fA-F]+)|[0-9]+)", 1)
    base10 = F.regexp_extract(token, r"\A&#([0-9]+)", 1)
    # Longer digit runs are out of range anyway; the cut keeps the cast safe.
    hexed = F.conv(F.substring(F.regexp_replace(digits, r"\A0+(?=.)", ""), 1, 8), 16, 10)
    plain = F.substring(F.regexp_replace(base10, r"\A0+(?=.)", ""), 1, 10)
    code = F.when(digits != "", hexed).otherwise(plain).try_cast("bigint")
    # Fixed rule: codes 128..159 mean the Windows-1252 characters.
    legacy = F.get(literal([_windows_char(i) for i in range(128, 160)], "array<string>"), (code - 128).cast("int"))
    scalar = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    replacement = F.lit("�")
    control = ((code >= 1) & (code <= 8)) | (code == 11) | ((code >= 14) & (code <= 31)) | (code == 127)
    noncharacter = ((code >= 0xFDD0) & (code <= 0xFDEF)) | (F.pmod(code, F.lit(0x10000)) >= 0xFFFE)
    return (
        F.when(code.isNull() | (code == 0), replacement)
        .when((code >= 128) & (code <= 159), legacy)
        .when(((code >= 0xD800) & (code <= 0xDFFF)) | (code > 0x10FFFF), replacement)
        .when(control | noncharacter, F.lit(""))
        .otherwise(scalar)
    )


def _windows_char(code: int) -> str:
    try:
        return bytes([code]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(code)


@cache
def _entity_tables() -> tuple[str, str]:
    """Named references from the standard library's HTML5 table."""
    table = html.entities.html5
    open_ended = sorted((n for n in table if not n.endswith(";")), key=len, reverse=True)
    return json.dumps(table), r"\A&(" + "|".join(open_ended) + ")"


def _named(token: Column) -> Column:
    table_json, open_ended = _entity_tables()
    table = F.from_json(F.lit(table_json), "map<string,string>")
    exact = F.try_element_at(table, F.substring(token, 2, 40))
    # Old names work without their semicolon; the longest such prefix counts.
    prefix = F.regexp_extract(token, open_ended, 1)
    partial = F.try_element_at(table, prefix)
    rest = token.substr(F.length(prefix) + 2, F.length(token))
    return F.coalesce(exact, F.when(prefix != "", F.concat(partial, rest)), token)


def first_line(text: Column) -> Column:
    """The first line that is not blank, stripped."""
    lines = F.split(text, r"[\n\r\x0b\x0c\x1c-\x1e\x85  ]")
    return F.get(F.filter(F.transform(lines, strip), lambda line: line != ""), F.lit(0))


def join_fields(columns: Iterable[Column]) -> Column:
    """Newline-join of the values that are neither null nor empty."""
    return F.concat_ws("\n", *[F.nullif(c, F.lit("")) for c in columns])


def searchable_text() -> Column:
    return join_fields([F.col(n) for n in ("title", "company", "location_text", "description")])


def short_sha256(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def content_hash(title: Column, company: Column, description: Column) -> Column:
    """Hash of what a listing says, blind to case and spacing."""
    parts = [title, F.coalesce(company, F.lit("")), description]
    return short_sha256(F.concat_ws(" ", *[F.lower(collapse_whitespace(p)) for p in parts]))


def normalise_tags(tags: Column) -> Column:
    cleaned = F.transform(tags, lambda t: F.lower(strip(t)))
    return F.array_sort(F.array_distinct(F.filter(cleaned, lambda t: t != "")))
