"""Slugs, keys, trims, mark-up and names."""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from showbill.functions.dates import let, match, present
from showbill.values import (
    BANNED_REPLACEMENTS, NAME_ALIASES, NAME_BLOCKED_PARTS, NAME_BLOCKLIST,
)

_SPACE = " \t\n\r\f\v"


def strip_ws(col: Column) -> Column:
    """Whitespace off both ends."""
    return F.trim(col, F.lit(_SPACE))


# --- ASCII folding --------------------------------------------------------------


#: Latin letters, punctuation and letter-like signs, whose marks ``fold_marks`` removes.
_LATIN_BLOCKS = ((0x80, 0x250), (0x1E00, 0x1F00), (0x2000, 0x20A0), (0x2100, 0x2190), (0x2460, 0x2500), (0xFB00, 0xFB07), (0xFF00, 0xFF60))
_ALL_BLOCKS = ((0x80, 0xD800), (0xE000, 0x110000))


@lru_cache(maxsize=2)
def fold_table(blocks: tuple = _ALL_BLOCKS) -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """(from, to, multi) for folding code points to ASCII, from the compatibility decompositions of Unicode.

    Characters that decompose to one ASCII character go into a ``translate`` table, those
    that decompose to several (ligatures, units, numerals) into a list. Everything else
    that is not ASCII is deleted afterwards.
    """
    src, dst, multi = [], [], []
    for char in map(chr, (code for block in blocks for code in range(*block))):
        if not unicodedata.decomposition(char):
            continue
        plain = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode("ascii")
        if len(plain) == 1:
            src.append(char)
            dst.append(plain)
        elif len(plain) > 1:
            multi.append((char, plain))
    return "".join(src), "".join(dst), tuple(multi)


def fold_ascii(col: Column) -> Column:
    """Accents and compatibility forms removed; characters without an ASCII form vanish.

    Text that is already ASCII, the usual case, skips the table; text without characters
    that become several is not taken apart.
    """
    src, dst, multi = fold_table()
    apart = r"[^\x00-\x7F]"
    spellings = F.lit([p for _, p in multi])
    among = F.lit("".join(c for c, _ in multi))

    def plain(char: Column) -> Column:  # what one character beyond ASCII becomes
        return let(F.instr(among, char), lambda at: F.when(at > 0, F.try_element_at(spellings, at)).otherwise(""))

    def spelt(text: Column) -> Column:  # only these characters are looked up, the pieces between them stay
        return let(F.translate(text, src, dst), lambda t: F.array_join(F.zip_with(
            F.split(t, apart, -1), F.regexp_extract_all(t, F.lit(apart), F.lit(0)),
            lambda piece, char: F.concat(piece, F.coalesce(plain(char), F.lit("")))), ""))

    return let(col, lambda text: F.when(text.rlike(apart), spelt(text)).otherwise(text))


def fold_marks(col: Column) -> Column:
    """Accents removed; characters without an ASCII form stay."""
    src, dst, _ = fold_table(_LATIN_BLOCKS)
    bare = F.regexp_replace(F.translate(col, src, dst), r"[̀-ͯ]", "")
    return F.when(col.rlike(r"[^\x00-\x7F]"), bare).otherwise(col)


# --- slugs ----------------------------------------------------------------------

SLUG_DIALECTS = ("safe", "plain", "event_id", "file", "cross", "share")


def slug(col: Column, dialect: str = "plain") -> Column:
    """Six slug dialects.

    ``safe``: fold, hyphenate, "event" when nothing is left. ``plain``: the same
    with "". ``event_id``: spaces to hyphens, quotes, colons and commas removed.
    ``file``: keeps dots and underscores. ``cross``: no folding. ``share``: accents
    removed, other characters to hyphens, "event" when nothing is left.
    """
    text = F.coalesce(col, F.lit(""))

    def hyphenate(c: Column, keep: str = "a-z0-9") -> Column:
        return F.regexp_replace(F.lower(c), f"[^{keep}]+", "-")

    def strip(c: Column) -> Column:
        return F.trim(c, F.lit("-"))

    if dialect == "plain":
        return strip(hyphenate(fold_ascii(text)))
    if dialect == "safe":
        return let(strip(hyphenate(fold_ascii(text))), lambda body: F.when(body == "", "event").otherwise(body))
    if dialect == "event_id":
        return F.translate(F.lower(text), " '\":,", "-")
    if dialect == "file":
        body = F.regexp_replace(hyphenate(text, "a-z0-9._-"), r"^[-.]+|[-.]+$", "")
        return F.regexp_replace(body, "-{2,}", "-")
    if dialect == "cross":
        return strip(hyphenate(F.trim(text)))
    if dialect == "share":
        return F.when(text == "", "").otherwise(let(strip(hyphenate(fold_marks(text))), lambda body: F.when(body == "", "event").otherwise(body)))
    raise ValueError(f"unknown slug dialect {dialect!r}")


# --- keys -----------------------------------------------------------------------

def title_key(col: Column, rule: str = "match") -> Column:
    """``match``: straight quotes, trimmed, lower; ``lower`` and ``upper``: trimmed and cased."""
    if rule == "match":
        return F.lower(F.trim(F.translate(F.coalesce(col, F.lit("")), "’‘ 　", "''  ")))
    if rule == "lower":
        return F.trim(F.lower(F.coalesce(col, F.lit(""))))
    if rule == "upper":
        return F.trim(F.upper(F.coalesce(col, F.lit(""))))
    raise ValueError(f"unknown rule {rule!r}")


def squeeze(col: Column) -> Column:
    """Runs of whitespace to one space, ends trimmed; a space by itself is left alone."""
    return F.trim(F.regexp_replace(col, r"\s{2,}|[\t\n\x0B\f\r]", " "))


def extraction_key(content: Column, schema: Column, operation: str) -> Column:
    """operation_md5(content)_md5(schema), 16 hex digits of each."""
    return F.concat(
        F.lit(operation + "_"), F.substring(F.md5(content), 1, 16),
        F.lit("_"), F.substring(F.md5(schema), 1, 16),
    )


def summary_key(title: Column, kind: Column) -> Column:
    return F.concat(title_key(title, "upper"), F.lit("_"), F.coalesce(kind, F.lit("unknown")))


# --- titles ---------------------------------------------------------------------

def split_by_author(col: Column) -> Column:
    """``struct<book,author>``: the text is split at its last " by "."""
    shape = r"(?s)^(.*)\s+by\s+(.*?)$"
    return let(col.rlike(shape), lambda has: F.struct(
        present(F.trim(F.when(has, F.regexp_extract(col, shape, 1)).otherwise(col))).alias("book"),
        present(F.trim(F.when(has, F.regexp_extract(col, shape, 2)))).alias("author"),
    ))


def series_of(col: Column) -> Column:
    """The part before the first colon."""
    return F.trim(F.substring_index(col, ":", 1))


def strip_suffix(col: Column, name: str) -> Column:
    """Drop a closing "at <venue>"."""
    words = r"\s+".join(w for w in name.split())
    return F.regexp_replace(col, rf"(?i)\s+at\s+{words}\s*$", "")


# --- mark-up --------------------------------------------------------------------

def md_to_html(col: Column) -> Column:
    """Heading marks off, bold, italic, paragraphs and breaks on, wrapped once."""
    text = F.regexp_replace(col, r"(?m)^#{1,6}\s*", "")
    text = F.regexp_replace(text, r"\*\*(.*?)\*\*", "<strong>$1</strong>")
    text = F.regexp_replace(text, r"\*(.*?)\*", "<em>$1</em>")
    text = F.replace(F.replace(text, F.lit("\n\n"), F.lit("</p><p>")), F.lit("\n"), F.lit("<br>"))
    return F.when(F.startswith(text, F.lit("<p>")), text).otherwise(F.concat(F.lit("<p>"), text, F.lit("</p>")))


_BLOCK_TAG = r"(?i)<(?:(?:p|br|li|div|h[1-4])(?:\s[^>]*)?/?|/(?:p|li|div|h[1-4])\s*)>"
_ANY_TAG = r"<[^>]+>"
_ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"


def _entity_char(token: Column) -> Column:
    """Character of one entity; an unknown name stays as it is."""
    name = F.substring(token, F.lit(2), F.length(token) - 2)
    digits = match(name, r"^#([0-9]+)$", 1).cast("int")
    hexed = F.conv(match(name, r"^#[xX]([0-9a-fA-F]+)$", 1), 16, 10).cast("int")
    code = F.coalesce(digits, hexed)
    valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    char = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    names = F.create_map(*[F.lit(x) for n, c in name2codepoint.items() for x in (n, chr(c))])
    return F.coalesce(F.try_element_at(names, name), char, token)


def unescape(col: Column) -> Column:
    """Entities to characters in one pass, so that nothing is decoded twice."""
    tokens = F.regexp_extract_all(col, F.lit(f"({_ENTITY})"), F.lit(1))
    decoded = F.zip_with(
        F.split(col, _ENTITY, -1), tokens,
        lambda piece, token: F.concat(piece, F.coalesce(_entity_char(token), F.lit(""))),
    )
    return F.when(col.contains("&"), F.array_join(decoded, "")).otherwise(col)


def html_text(col: Column, dialect: str = "visible") -> Column:
    """``visible``: block tags part words, others vanish, entities decoded.
    ``spaced``: every tag parts words. ``bare``: tags deleted, ends trimmed.
    """
    text = F.coalesce(col, F.lit(""))
    if dialect == "visible":
        def without_tags(t: Column) -> Column:
            bare = F.when(t.contains("<!--"), F.regexp_replace(t, r"(?s)<!--.*?-->", "")).otherwise(t)
            bare = F.regexp_replace(F.regexp_replace(bare, _BLOCK_TAG, " "), r"</?[A-Za-z!][^>]*>", "")
            return F.when(t.contains("<"), bare).otherwise(t)

        return let(text, lambda t: let(without_tags(t), lambda x: squeeze(F.replace(unescape(x), F.lit("\u00a0"), F.lit(" ")))))
    if dialect == "spaced":
        return squeeze(F.regexp_replace(text, _ANY_TAG, " "))
    if dialect == "bare":
        return strip_ws(F.regexp_replace(text, _ANY_TAG, ""))
    raise ValueError(f"unknown dialect {dialect!r}")


def replace_banned(col: Column) -> Column:
    """Overused phrases to plain ones, whole words, any case, in the listed order.

    A plain search in the lower-cased text decides which of the patterns have to run at
    all. No replacement brings in a phrase that was not there before.
    """
    def step(low: Column, phrase: str, plain: str):
        return lambda t: F.when(low.contains(phrase), F.regexp_replace(t, rf"(?iU)\b{phrase}\b", plain)).otherwise(t)

    def chain(low: Column) -> Column:
        out = col
        for phrase, plain in BANNED_REPLACEMENTS.items():
            out = let(out, step(low, phrase, plain))
        return out

    return let(F.lower(col), chain)


# --- trims ----------------------------------------------------------------------

def trim_words(col: Column, limit: int = 140, floor: int = 80) -> Column:
    """Cut at the last space inside the limit (not before ``floor``), with an ellipsis."""
    head = F.substring(col, 1, limit - 1)
    back = F.locate(" ", F.reverse(head))
    cut = F.when(back == 0, F.lit(-1)).otherwise(F.length(head) - back)
    cut = F.when(cut < floor, F.lit(limit - 1)).otherwise(cut)
    short = F.concat(F.rtrim(F.substring(col, F.lit(1), cut), F.lit(",;:.- ")), F.lit("…"))
    return F.when(F.length(col) <= limit, col).otherwise(short)


def truncate(col: Column, limit: int) -> Column:
    """At most ``limit`` characters, the last one an ellipsis when text was lost."""
    short = F.concat(F.rtrim(F.substring(col, 1, limit - 1), F.lit(_SPACE)), F.lit("…"))
    return F.when(F.length(col) <= limit, col).otherwise(short)


def excerpt(col: Column, limit: int = 240) -> Column:
    """Cut after the last sentence end in the second half of the limit, else at a word."""
    plain = html_text(col, "bare")
    head = F.substring(plain, 1, limit)
    out = None
    for end in (". ", "! ", "? "):
        back = F.locate(end[::-1], F.reverse(head))
        at = F.when(back == 0, F.lit(-1)).otherwise(F.length(head) - back - 1)
        whole = F.substring(head, F.lit(1), at + 1)
        out = F.when(at >= limit // 2, whole) if out is None else out.when(at >= limit // 2, whole)
    space = F.locate(" ", F.reverse(head))
    word = F.when(space == 0, head).otherwise(F.substring(head, F.lit(1), F.length(head) - space))
    out = out.otherwise(F.concat(F.rtrim(word, F.lit(",;:")), F.lit("…")))
    return F.when(F.length(plain) <= limit, plain).otherwise(out)


def wrap(col: Column, width: int, max_lines: int) -> Column:
    """Greedy line wrap; over-long words are cut, lost words leave an ellipsis on the last line."""
    words = F.filter(F.split(squeeze(F.coalesce(col, F.lit(""))), " "), lambda w: w != "")
    words = F.transform(
        words,
        lambda w: F.when(F.length(w) > width, F.concat(F.substring(w, 1, width - 1), F.lit("…"))).otherwise(w),
    )

    def bound(value: Column, body) -> Column:  # as ``let``, so that the lines are the only sum of the plan
        return F.element_at(F.transform(F.array(value), body), 1)

    def add(lines: Column, word: Column) -> Column:
        joined = F.concat(F.coalesce(F.get(lines, F.size(lines) - 1), F.lit("")), F.lit(" "), word)
        return bound(joined, lambda line: F.when(
            (F.size(lines) > 0) & (F.length(line) <= width), F.concat(F.slice(lines, F.lit(1), F.size(lines) - 1), F.array(line))).otherwise(
            F.concat(lines, F.array(word))))

    def cut(lines: Column) -> Column:
        last = F.concat(F.substring(F.get(lines, F.lit(max_lines - 1)), 1, width - 1), F.lit("…"))
        return (
            F.when(F.size(lines) == 0, F.array(F.lit("")))
            .when(F.size(lines) > max_lines, F.concat(F.slice(lines, 1, max_lines - 1), F.array(last)))
            .otherwise(lines)
        )

    return bound(F.aggregate(words, F.array().cast("array<string>"), add), cut)


# --- names ----------------------------------------------------------------------

def clean_name(col: Column) -> Column:
    """A person's name: placeholders to null, bare surnames to the full name."""
    name = F.trim(F.coalesce(col, F.lit("")))
    low = F.lower(name)
    blocked = low.isin(list(NAME_BLOCKLIST))
    for part in NAME_BLOCKED_PARTS:
        blocked = blocked | low.contains(part)
    full = name
    for alias, canonical in NAME_ALIASES.items():
        full = F.when(low == alias, canonical).otherwise(full)
    return F.when(~blocked, full)


def plain_name(col: Column) -> Column:
    """A name that is not one of the placeholder words; no alias is applied."""
    name = F.trim(F.coalesce(col, F.lit("")))
    return F.when(~F.lower(name).isin(list(NAME_BLOCKLIST)), name)


def address_parts(col: Column) -> Column:
    """``struct<street,locality,region,postal>`` of "<street>, <city>, <ST> <ZIP>".

    The postal code may be absent; text without a state tail is all street.
    """
    text = F.trim(F.coalesce(col, F.lit("")))
    shape = r"^(.*?)(?:^|,)\s*([^,]+?)\s*,\s*([A-Z]{2})(?:\s+(\d{5}(?:-\d{4})?))?\s*$"
    has = text.rlike(shape)
    street = F.trim(F.trim(F.regexp_extract(text, shape, 1), F.lit(", ")))
    return F.struct(
        F.when(has, street).otherwise(text).alias("street"),
        F.when(has, F.regexp_extract(text, shape, 2)).otherwise("").alias("locality"),
        F.when(has, F.regexp_extract(text, shape, 3)).otherwise("").alias("region"),
        F.when(has, F.regexp_extract(text, shape, 4)).otherwise("").alias("postal"),
    )


def title_words(col: Column) -> Column:
    """"some_key" -> "Some Key"."""
    return F.initcap(F.replace(col, F.lit("_"), F.lit(" ")))


def labelled(kind: Column, labels: dict[str, str], otherwise: Column | None = None) -> Column:
    """Label of a category from a plan-time table."""
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.try_element_at(table, kind), otherwise if otherwise is not None else title_words(kind))


def split_escape(col: Column) -> Column:
    """Calendar text escapes: backslash, semicolon, comma and line break."""
    out = F.replace(col, F.lit("\\"), F.lit("\\\\"))
    for char in (";", ","):
        out = F.replace(out, F.lit(char), F.lit("\\" + char))
    return F.replace(out, F.lit("\n"), F.lit("\\n"))
