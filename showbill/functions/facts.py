"""Facts read from prose, category rules, display forms and the gates on an event."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from showbill.functions.clock import clock_12h
from showbill.functions.dates import as_date, before, day, match, short_day
from showbill.functions.review import contains_any
from showbill.functions.text import squeeze, strip_ws
from showbill.values import (
    DIRECTOR_PHRASINGS,
    CLOSING_SOON_DAYS, ENGLISH_COUNTRIES, FILM_LANGUAGES, GATE_BOOK_WORDS, GATE_DESCRIPTION_WORDS,
    GATE_LONG_DESCRIPTION, GATE_OVERRIDABLE, GATE_SERIES_WORDS, GATE_TITLE_WORDS,
    GATE_VAGUE_FILM, LIVE_MARKERS, MOVIE_ALIASES, NON_FILM_WORDS, SUPPORTED_TYPES,
)


def nonblank(col: Column) -> Column:
    return F.coalesce(strip_ws(col), F.lit("")) != ""


def blank_to_null(col: Column) -> Column:
    return F.when(nonblank(col), col)


# --- film facts -----------------------------------------------------------------

def languages(info: Column, country: Column) -> Column:
    """Languages after "In ", without subtitles, in title case, each once."""
    text = F.replace(F.coalesce(info, F.lit("")), F.lit(" "), F.lit(" "))
    part = match(text, r"(?i)\bIn\s+(.+)$", 1)
    part = before(before(part, r"(?i:\s+with\s+[^.]*?subtitles?)"), r"[.;\n\r]")
    tokens = F.transform(
        F.regexp_extract_all(part, F.lit(r"(?is)(.*?)(?:,|/|&|\band\b|\z)"), F.lit(1)),
        lambda t: squeeze(F.trim(F.regexp_replace(F.trim(t), r"(?i)^in\s+", ""), F.lit(" ."))),
    )
    named = F.filter(tokens, lambda t: (t != "") & (F.lower(t) != "dcp"))
    joined = F.array_join(F.array_distinct(F.transform(named, F.initcap)), ", ")
    english = F.when(F.lower(F.trim(country)).isin(list(ENGLISH_COUNTRIES)), "English")
    return F.coalesce(F.nullif(joined, F.lit("")), english)


def film_facts(text: Column) -> Column:
    """``struct<director,release_year,runtime_minutes,country,language>`` read from prose."""
    flat = F.trim(F.regexp_replace(squeeze(text), r"(?:Earlier Event:|Later Event:).*", ""))
    language = match(flat, r"(?i)(?:Language:|In)\s+(" + "|".join(FILM_LANGUAGES) + ")", 1)
    return F.struct(
        F.trim(match(flat, r"(?i)(?:directed by|director:|dir\.)\s+([^,.]+)", 1)).alias("director"),
        match(flat, r"\b(19\d{2}|20\d{2})\b", 1).cast("int").alias("release_year"),
        match(flat, r"(?i)(\d{2,3})\s*(?:min|minutes)", 1).cast("int").alias("runtime_minutes"),
        match(flat, r"(?:Country:|From)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)", 1).alias("country"),
        F.initcap(language).alias("language"),
    )


def director_in_review(text: Column) -> Column:
    """Director named in a review; four phrasings, the first that occurs in that order."""
    return F.coalesce(*[match(text, p, 1) for p in DIRECTOR_PHRASINGS], F.lit(""))


# --- categories -----------------------------------------------------------------

def resolve_type(kind: Column, has_film_fields: Column, film_venue: Column) -> Column:
    """Published category: aliases and film venues to ``movie``, film fields decide blank or other."""
    raw = F.lower(F.trim(F.coalesce(kind, F.lit(""))))
    return (
        F.when(raw.isin(list(MOVIE_ALIASES)), "movie")
        .when((raw == "") & film_venue, "movie")
        .when(has_film_fields & raw.isin("", "other"), "movie")
        .when(raw != "", raw)
        .otherwise("other")
    )


def supported_type(kind: Column, film_venue: Column) -> Column:
    """``struct<type,reason>``: the type to process, or why the row is skipped."""
    blank = F.coalesce(kind, F.lit("")) == ""
    settled = F.when(blank & film_venue, "movie").otherwise(kind)
    good = F.coalesce(settled.isin(list(SUPPORTED_TYPES)), F.lit(False))
    reason = F.when(good, F.lit(None)).when(F.coalesce(settled, F.lit("")) == "", "untyped").otherwise("unsupported type")
    return F.struct(F.when(good, settled).alias("type"), reason.alias("reason"))


def classify_title(title: Column) -> Column:
    """``book_club`` or ``other``; pop-ups and theory nights are never book clubs."""
    return (
        F.when(title.rlike(r"(?i)pop[-\s]?up") | title.rlike(r"(?i)theory\s+night"), "other")
        .when(title.rlike(r"(?i)book\s+club"), "book_club")
        .otherwise("other")
    )


def is_live_title(title: Column) -> Column:
    return title.rlike("(?i)" + "|".join(LIVE_MARKERS))


def is_caps_title(title: Column) -> Column:
    """All letters are capitals, or there are none."""
    return ~title.rlike(r"\p{L}") | (title.rlike(r"\p{Lu}") & ~title.rlike(r"[\p{L}&&[^\p{Lu}]]"))


def is_film_listing(title: Column, description: Column) -> Column:
    """Neither title nor description holds a word for some other kind of event."""
    words = "|".join(NON_FILM_WORDS)
    hit = F.lower(title).rlike(words) | F.lower(F.coalesce(description, F.lit(""))).rlike(words)
    return ~hit


def is_specific(title: Column, description: Column, kind: Column, book: Column, author: Column,
                director: Column, featured_artist: Column, composers: Column) -> Column:
    """Does the row describe one event worth a hook?"""
    t, body = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(description, F.lit("")))
    has_book, has_author = F.coalesce(book, F.lit("")) != "", F.coalesce(author, F.lit("")) != ""
    known = (
        has_book | has_author
        | (F.coalesce(director, F.lit("")) != "")
        | (F.coalesce(featured_artist, F.lit("")) != "")
        | (F.coalesce(F.size(composers), F.lit(0)) > 0)
    )
    strict = [w for w in GATE_TITLE_WORDS if w not in GATE_OVERRIDABLE]
    soft = [w for w in GATE_TITLE_WORDS if w in GATE_OVERRIDABLE]
    strict_series = [w for w in GATE_SERIES_WORDS if w not in GATE_OVERRIDABLE]
    soft_series = [w for w in GATE_SERIES_WORDS if w in GATE_OVERRIDABLE]
    season_of = t.contains("season of") & (has_book | has_author)
    vetoed = (
        contains_any(t, strict)
        | (contains_any(t, soft) & ~known)
        | (contains_any(t, strict_series) & ~season_of)
        | (contains_any(t, soft_series) & ~season_of & ~known)
        | contains_any(body, GATE_DESCRIPTION_WORDS)
        | ((kind == "screening") & (contains_any(t, GATE_VAGUE_FILM) | contains_any(body, GATE_VAGUE_FILM)))
    )
    vague_club = (kind == "book_club") & ~has_book & ~has_author & contains_any(t, GATE_BOOK_WORDS)
    return F.coalesce(((F.length(body) > GATE_LONG_DESCRIPTION) & known) | (~vetoed & ~vague_club), F.lit(False))


# --- display --------------------------------------------------------------------

def rating_class(rating: Column) -> Column:
    return F.when(rating >= 8, "high").when(rating >= 5, "mid").otherwise("low")


def score_badge(rating: Column) -> Column:
    """``dark`` from 8, ``light`` below, nothing without a rating."""
    return F.when(rating.isNull(), "").when(rating >= 8, "dark").otherwise("light")


def when_text(date_text: Column, time_text: Column, style: str = "long") -> Column:
    """"Mon, Jun 15 · 7:00 PM"; an unreadable date is shown as it is."""
    base = F.coalesce(short_day(as_date(date_text)), date_text, F.lit(""))
    clock = clock_12h(time_text, style)
    return F.when(clock == "", base).otherwise(F.concat(base, F.lit(" · "), clock))


def run_note(end_date: Column, first_date: Column, scored: Column, today: str | date) -> Column:
    """``struct<text,closing_soon>`` for a run that has not ended."""
    now = day(today)
    end, first = as_date(end_date), as_date(first_date)
    left = F.datediff(end, F.lit(now))
    shown = ~scored & end.isNotNull() & (left >= 0)
    ahead = F.coalesce(first > F.lit(now), F.lit(False))
    soon = ~ahead & (left <= CLOSING_SOON_DAYS)
    word = F.when(soon, "Closes ").otherwise("Through ")
    return F.when(shown, F.struct(F.concat(word, short_day(end, weekday=False)).alias("text"), soon.alias("closing_soon")))


def share_text(title: Column, hook: Column) -> Column:
    return F.when(nonblank(hook), F.concat(title, F.lit(" — "), F.trim(hook))).otherwise(title)


def event_context(fields: dict[str, Column]) -> Column:
    """"Label: value" lines of the fields that are present."""
    return F.concat_ws("\n", *[
        F.when(nonblank(col), F.concat(F.lit(f"{label}: "), col)) for label, col in fields.items()
    ])


def detail_block(fields: dict[str, Column]) -> Column:
    """"Label: value" lines with "unknown" for the absent ones."""
    return F.concat_ws("\n", *[
        F.concat(F.lit(f"{label}: "), F.coalesce(blank_to_null(col), F.lit("unknown")))
        for label, col in fields.items()
    ])
