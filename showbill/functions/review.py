"""Review text: refusals, scores, confidence, sections and the one-line hook."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from showbill.functions.dates import let, match
from showbill.functions.text import html_text, strip_ws, trim_words
from showbill.values import (
    DEFAULT_SCORE, EMOJI, HOOK_ARTIFACTS, HOOK_META, HOOK_PREFIXES, HOOK_REFUSALS, HOOK_TAILS,
    NON_JUDGEMENT_PATTERNS, REFUSAL_MIN_CHARS, REFUSAL_PATTERNS, REFUSAL_STUB, SCORE_PATTERNS,
    SOURCE_NOTE, THIN_EVIDENCE,
)

REFUSAL = "(?iu)" + "|".join(REFUSAL_PATTERNS)
NON_JUDGEMENT = "(?iu)" + "|".join(NON_JUDGEMENT_PATTERNS)


def contains_any(col: Column, phrases) -> Column:
    """True when a lower-cased text holds one of the phrases."""
    return reduce(lambda a, b: a | b, [col.contains(p) for p in phrases])


def is_refusal(col: Column) -> Column:
    """Refusal wording in a text of 40 or more trimmed characters."""
    long_enough = F.length(strip_ws(col)) >= REFUSAL_MIN_CHARS
    return F.coalesce(long_enough & col.rlike(REFUSAL), F.lit(False))


def filter_refusal(col: Column) -> Column:
    return F.when(is_refusal(col), REFUSAL_STUB).otherwise(col)


def confidence(col: Column) -> Column:
    """``low`` for empty, declined or thin text, else ``high``."""
    thin = contains_any(F.lower(col), THIN_EVIDENCE)
    return F.when((F.coalesce(col, F.lit("")) == "") | is_refusal(col) | thin, "low").otherwise("high")


def is_non_judgement(col: Column) -> Column:
    return F.coalesce(col, F.lit("")).rlike(NON_JUDGEMENT)


def score(col: Column) -> Column:
    """Score of the first pattern that matches, half-even rounded, within 0..10, else 5."""
    found = F.coalesce(*[match(col, "(?i)" + p, 1) for p in SCORE_PATTERNS]).try_cast("double")
    rounded = F.bround(F.coalesce(found, F.lit(float(DEFAULT_SCORE))), 0)
    return F.least(F.greatest(rounded, F.lit(0.0)), F.lit(10.0)).cast("int")


def strip_sources(col: Column) -> Column:
    """Citation marks and source notes removed, ends trimmed."""
    text = F.regexp_replace(col, r"\[\d+\]", "")
    text = F.regexp_replace(text, "(?is)" + SOURCE_NOTE, "")
    return strip_ws(text)


def parse_response(col: Column) -> Column:
    """``struct<score,summary,review_confidence>`` of a model reply."""
    return let(strip_sources(col), lambda summary: F.struct(
        score(col).alias("score"),
        filter_refusal(summary).alias("summary"),
        confidence(summary).alias("review_confidence"),
    ))


# --- sections -------------------------------------------------------------------

_PARAGRAPH = r"(?is)<p[^>]*>(.*?)</p>"
_STRONG = r"(?is)<strong[^>]*>(.*?)</strong>"
_RATING = r"(?i)^★\s*Rating:\s*(\d+(?:\.\d+)?)\s*/\s*10"
_RATING_BRACKET = r"(?i)^★\s*Rating:\s*\[?\s*(\d+(?:\.\d+)?)\s*/\s*10"


EMOJI_CLASS = "".join("-".join(rf"\x{{{end}}}" for end in part.split("-")) for part in EMOJI.split())


def paragraphs(col: Column) -> Column:
    """Inner mark-up of every paragraph, in order."""
    return F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(_PARAGRAPH), F.lit(1))


def split_strong(parts: Column) -> Column:
    """Paragraphs that hold several bold labels are split at their line breaks."""

    def pieces(p: Column) -> Column:
        several = F.size(F.regexp_extract_all(p, F.lit(r"(?i)<strong\b"), F.lit(0))) > 1
        split = F.filter(F.split(p, r"(?i)<br\s*/?>"), lambda x: F.trim(x) != "")
        return F.when(several, split).otherwise(F.array(p))

    return F.flatten(F.transform(parts, pieces))


def section(raw: Column, dialect: str = "digest") -> Column:
    """``struct<rating,emoji,label,body>`` of one paragraph.

    ``digest`` takes the rating without brackets; ``reader`` also with. The emoji is the
    leading run up to an ASCII letter, digit or space in a digest, of emoji for a reader.
    """
    pattern = _RATING if dialect == "digest" else _RATING_BRACKET
    leading = r"^([^\sA-Za-z0-9]*)" if dialect == "digest" else f"^([{EMOJI_CLASS}]*)"

    def read(text: Column, label: Column) -> Column:
        at = F.position(label, text)
        tail = F.substring(text, at + F.length(label), F.length(text))
        body = F.regexp_replace(tail, r"^[\s–—\-:]+|\s+$", "")
        return F.struct(
            match(text, pattern, 1).alias("rating"),
            F.regexp_extract(text, leading, 1).alias("emoji"),
            label.alias("label"),
            F.when((label != "") & (at > 0), body).otherwise(text).alias("body"),
        )

    label = F.coalesce(html_text(match(raw, _STRONG, 1), "bare"), F.lit(""))
    return let(html_text(raw, "bare"), lambda text: let(label, lambda name: read(text, name)))


# --- one-line hook --------------------------------------------------------------

_QUOTES = "\"'"


def _strip(col: Column, chars: str = _QUOTES) -> Column:
    return F.trim(col, F.lit(chars))


def clean_hook(col: Column) -> Column:
    """A publishable one-line hook, or null when the reply is not one."""

    def without_prefix(text: Column) -> Column:
        out = text
        for prefix in reversed(HOOK_PREFIXES):
            rest = F.regexp_replace(F.trim(F.substring(text, F.lit(len(prefix) + 1), F.length(text))), r"^[:,]\s*", "")
            out = F.when(F.startswith(F.lower(text), F.lit(prefix.lower())), rest).otherwise(out)
        return _strip(out)

    def without_artifact(text: Column) -> Column:
        out = text
        for artifact in reversed(HOOK_ARTIFACTS):
            out = F.when(text.contains(artifact), F.trim(F.substring_index(text, artifact, 1))).otherwise(out)
        return F.trim(_strip(out))

    def settle(text: Column) -> Column:
        rejected = (
            (F.length(text) < 10)
            | contains_any(F.lower(text), HOOK_META)
            | contains_any(text, HOOK_TAILS)
            | (F.endswith(text, F.lit("...")) & (F.length(text) < 30))
        )
        return F.when(~rejected, trim_words(text))

    def read(text: Column) -> Column:
        usable = ~contains_any(F.lower(text), HOOK_REFUSALS)
        return F.when(usable, let(without_prefix(text), lambda t: let(without_artifact(t), settle)))

    return let(F.trim(F.replace(_strip(col), F.lit("\n"), F.lit(" "))), read)
