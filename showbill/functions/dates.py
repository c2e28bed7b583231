"""Date text in many shapes to ISO dates, and the calendar arithmetic around them.

Every parser returns null for what it cannot read: the session runs in ANSI mode,
so only ``try_`` conversions are used.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from showbill.values import (
    MONTHS_LONG, MONTHS_SHORT, WEEKDAYS_LONG, YEARLESS_GRACE_DAYS,
)

ISO_SHAPE = r"^\d{4}-\d{2}-\d{2}$"


def day(value: str | date) -> date:
    """A plan-time date parameter."""
    return value if isinstance(value, date) else date.fromisoformat(value)


def present(col: Column) -> Column:
    """The text, null when it is empty; the expression is evaluated once."""
    return let(col, lambda x: F.when(x != "", x))


def match(col: Column, pattern: str, group: int = 1) -> Column:
    """A regex group, null when the pattern or the group is absent."""
    return present(F.regexp_extract(col, pattern, group))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once.

    Parsers read one intermediate many times. Written out flat, the expression
    tree multiplies until its generated class is too large to compile; bound to
    a lambda variable it stays small. The value is the start of an empty sum, since an
    entry taken from an array asks for the type of the whole tree below for every row.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda bound, _: bound, body)


#: A character that parts a text where it holds none.
_CUT = "\x1e"


def cut_before(text: Column, at: str) -> Column:
    """The text in pieces that begin where the pattern ``at`` matches in any case.

    As a split at ``(?=at)``, which compiles its pattern for every text, but with an empty piece
    above a match at the start.
    """
    begin, mark = (f"<(?={at[1:]})", f"{_CUT}<") if at.startswith("<") else (f"(?={at})", _CUT)
    return let(text, lambda t: F.when(t.contains(_CUT), F.split(t, f"(?i)(?={at})")).otherwise(
        F.split(F.regexp_replace(t, f"(?i){begin}", mark), _CUT)))


def before(text: Column, at: str) -> Column:
    """What stands before the first match of the pattern ``at``, which matches no empty text; else the whole text."""
    return F.regexp_extract(text, rf"(?s)\A(.*?)(?:{at}|\z)", 1)


def iso(y: Column, m: Column, d: Column) -> Column:
    """ISO text of a year, month and day; null unless it is a day of the calendar."""
    text = F.concat(
        F.lpad(y.cast("string"), 4, "0"), F.lit("-"),
        F.lpad(m.cast("string"), 2, "0"), F.lit("-"),
        F.lpad(d.cast("string"), 2, "0"),
    )
    return text.try_cast("date").cast("string")


def as_date(col: Column) -> Column:
    """``DateType`` of exact ISO text, else null."""
    return F.when(col.rlike(ISO_SHAPE), col.try_cast("date"))


def _month_table(names: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])


def month_number(name: Column) -> Column:
    """Month of a full English name, its first three letters, or "sept"."""
    names = {m.lower()[:n]: i for i, m in enumerate(MONTHS_LONG, 1) for n in (3, len(m))}
    return F.try_element_at(_month_table({**names, "sept": 9}), F.lower(name))


def full_month_number(name: Column) -> Column:
    """Month of a full English name only."""
    return F.try_element_at(
        _month_table({m.lower(): i for i, m in enumerate(MONTHS_LONG, 1)}), F.lower(name)
    )


def pick(names, index: Column) -> Column:
    """The 1-based entry of a plan-time list of names."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), index)


# --- ISO normalization --------------------------------------------------------

def normalize_date(col: Column) -> Column:
    """ISO-shaped text is kept; else Y-m-d, m/d/Y, d/m/Y, Y/m/d are tried in that order."""
    dashed, slashed = r"^(\d{4})-(\d{1,2})-(\d{1,2})$", r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
    year_first = r"^(\d{4})/(\d{1,2})/(\d{1,2})$"
    return F.coalesce(
        F.when(col.rlike(ISO_SHAPE), col),
        iso(match(col, dashed, 1), match(col, dashed, 2), match(col, dashed, 3)),
        iso(match(col, slashed, 3), match(col, slashed, 1), match(col, slashed, 2)),
        iso(match(col, slashed, 3), match(col, slashed, 2), match(col, slashed, 1)),
        iso(match(col, year_first, 1), match(col, year_first, 2), match(col, year_first, 3)),
    )


def normalize_dates(arr: Column) -> Column:
    """Each entry to ISO; entries that no format reads are dropped."""
    empty = F.array().cast("array<string>")
    return F.coalesce(F.filter(F.transform(arr, normalize_date), lambda x: x.isNotNull()), empty)


def partial_date(col: Column) -> Column:
    """Leading ``YYYY-MM`` or ``YYYY-MM-DD``; a month alone means its first day."""
    head = r"^\s*(\d{4})-(\d{2})(?:-(\d{2}))?"
    read = iso(match(col, head, 1), match(col, head, 2), F.coalesce(match(col, head, 3), F.lit("01")))
    return F.when(col.rlike(r"\A\d{4}-\d{2}-\d{2}\z"), col.try_cast("date").cast("string")).otherwise(read)


# --- dates without a year -----------------------------------------------------

def infer_year(m: Column, d: Column, today: str | date, rule: str = "grace") -> Column:
    """Year of a month and day.

    ``grace``: this year unless that is more than 60 days past.
    ``month``: this year from the current month on, next year before it.
    """
    now = day(today)
    if rule == "month":
        return F.when(m >= now.month, F.lit(now.year)).otherwise(F.lit(now.year + 1))
    if rule != "grace":
        raise ValueError(f"unknown rule {rule!r}")
    candidate = iso(F.lit(now.year), m, d).cast("date")
    limit = now - timedelta(days=YEARLESS_GRACE_DAYS)
    return F.when(candidate < F.lit(limit), F.lit(now.year + 1)).when(
        candidate.isNotNull(), F.lit(now.year)
    )


_MONTH_DAY = r"(?i)(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+(\d{1,2})"


def date_range(col: Column, today: str | date) -> Column:
    """``struct<start,end>`` of a run; ``end`` only when the text holds two dates.

    ISO tokens are read first, else month names. A year in the text serves both
    ends; an end before its start belongs to the next year.
    """
    tokens = F.regexp_extract_all(col, F.lit(r"(\d{4}-\d{2}(?:-\d{2})?)"), F.lit(1))
    named = F.regexp_extract_all(col, F.lit(_MONTH_DAY), F.lit(0))

    def parts(token: Column) -> tuple[Column, Column]:
        return month_number(F.substring(token, 1, 3)), match(token, r"(\d{1,2})$", 1).cast("int")

    def token_date(token: Column) -> Column:  # a token is YYYY-MM or YYYY-MM-DD
        return F.when(F.length(token) == 7, F.concat(token, F.lit("-01"))).otherwise(token).try_cast("date").cast("string")

    def from_iso(found: Column) -> Column:
        last = F.when(F.size(found) > 1, token_date(F.get(found, F.size(found) - 1)))
        return F.struct(token_date(F.get(found, F.lit(0))).alias("start"), last.alias("end"))

    def with_start(found: Column, year: Column, start: Column) -> Column:
        m, d = parts(F.get(found, F.size(found) - 1))
        same = iso(year, m, d)
        end = F.when(same < start, iso(year + 1, m, d)).otherwise(same)
        return F.struct(
            start.alias("start"),
            F.when(start.isNotNull() & (F.size(found) > 1), end).alias("end"),
        )

    def from_names(found: Column) -> Column:
        m, d = parts(F.get(found, F.lit(0)))
        year = F.coalesce(match(col, r"\b(20\d{2})\b").cast("int"), infer_year(m, d, today))
        return let(year, lambda y: let(iso(y, m, d), lambda start: with_start(found, y, start)))

    return let(tokens, lambda t: F.when(F.size(t) > 0, from_iso(t)).otherwise(let(named, from_names)))


_RUN = r"(?i)^\s*(\w+)\s+(\d{1,2}),\s+(\d{4})\s*-\s*(\w+)\s+(\d{1,2}),\s+(\d{4})"
_PROSE = r"(?i)^\s*(?:\w+day,\s+)?(\w+)\s+(\d{1,2})(?:,\s+(\d{4}))?,\s*(.+)"
_CLOCK_RANGE = r"(?i)^(\d{1,2})(?::(\d{2}))?\s*-\s*(\d{1,2})(?::(\d{2}))?\s*(am|pm)"
_CLOCK = r"(?i)^(\d{1,2})(?::(\d{2}))?\s*(am|pm)"


def prose_datetime(col: Column, today: str | date) -> Column:
    """``struct<date,time>`` of "Saturday, July 18, 2-4 pm"; a dated run opens at 10:00."""
    now = day(today)

    def pair(d: Column, t: Column) -> Column:
        both = d.isNotNull() & t.isNotNull()
        return F.struct(F.when(both, d).alias("date"), F.when(both, t).alias("time"))

    def start_time(clock: Column) -> Column:
        def read(pattern: str, half_group: int) -> Column:
            hour, half = match(clock, pattern, 1).cast("int"), F.lower(match(clock, pattern, half_group))
            hour24 = (
                F.when((half == "pm") & (hour != 12), hour + 12)
                .when((half == "am") & (hour == 12), 0)
                .otherwise(hour)
            )
            minute = F.coalesce(match(clock, pattern, 2), F.lit("00"))
            return F.concat(F.lpad(hour24.cast("string"), 2, "0"), F.lit(":"), minute)

        return F.when(clock.rlike(_CLOCK_RANGE), read(_CLOCK_RANGE, 5)).otherwise(read(_CLOCK, 3))

    def dated(text: Column, m: Column) -> Column:
        d = match(text, _PROSE, 2).cast("int")
        year = F.coalesce(match(text, _PROSE, 3).cast("int"), infer_year(m, d, today), F.lit(now.year))
        written = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"),
                              F.lpad(d.cast("string"), 2, "0"))
        return pair(F.when(m.isNotNull(), written), let(F.trim(match(text, _PROSE, 4)), start_time))

    def read(text: Column) -> Column:
        run = iso(match(text, _RUN, 3), full_month_number(match(text, _RUN, 1)), match(text, _RUN, 2))
        return F.when(text.rlike(_RUN), pair(run, F.lit("10:00"))).otherwise(
            let(full_month_number(match(text, _PROSE, 1)), lambda m: dated(text, m))
        )

    return let(F.translate(F.trim(col), "–—", "--"), read)


def mdy_datetime(col: Column) -> Column:
    """``struct<date,time>`` of "6/30/25 7:00 pm"; a two-digit year is in this century."""
    shape = r"^\s*(\d{1,2})/(\d{1,2})/(\d{2}|\d{4})\s+(.+?)\s*$"
    y = match(col, shape, 3)
    y = F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y)
    text = F.concat(y, F.lit("-"), F.lpad(match(col, shape, 1), 2, "0"), F.lit("-"), F.lpad(match(col, shape, 2), 2, "0"))
    return F.struct(text.alias("date"), F.upper(match(col, shape, 4)).alias("time"))


# --- calendar -----------------------------------------------------------------

def iso_week(d: Column) -> Column:
    """``struct<year,week,label,monday,sunday>`` of the ISO week that holds a date."""
    year, week = F.extract(F.lit("YEAROFWEEK"), d), F.weekofyear(d)
    monday = F.date_sub(d, F.weekday(d))
    return F.struct(
        year.cast("int").alias("year"), week.alias("week"),
        F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0")).alias("label"),
        monday.alias("monday"), F.date_add(monday, 6).alias("sunday"),
    )


def week_start(label: Column) -> Column:
    """Monday of ``YYYY-Www``; null when the label is malformed or the week does not exist."""
    shape = r"^\s*(\d{4})-W(\d{2})\s*$"
    y, w = match(label, shape, 1), match(label, shape, 2).cast("int")
    jan4 = F.concat(y, F.lit("-01-04")).try_cast("date")
    monday = F.date_add(F.date_sub(jan4, F.weekday(jan4)), (w - 1) * 7)
    exists = (w >= 1) & (F.extract(F.lit("YEAROFWEEK"), monday) == y.cast("int"))
    return F.when(exists, monday)


def week_bounds(label: str) -> tuple[date, date]:
    """Monday and Sunday of a plan-time ISO week label; raises on a bad one."""
    year, week = datetime.strptime(label.strip() + "-1", "%G-W%V-%u").isocalendar()[:2]
    monday = date.fromisocalendar(year, week, 1)
    return monday, monday + timedelta(days=6)


def next_week(d: Column) -> Column:
    """Monday of the week after the one that holds a date."""
    return F.date_add(F.date_sub(d, F.weekday(d)), 7)


def season_label(d: Column) -> Column:
    """``2025-26``: a season starts in August."""
    start = F.year(d) - F.when(F.month(d) >= 8, 0).otherwise(1)
    return F.concat(start.cast("string"), F.lit("-"), F.lpad(((start + 1) % 100).cast("string"), 2, "0"))


def month_range(monday: Column, sunday: Column) -> Column:
    """"June 15–21, 1998", or both months named when they differ."""
    m1, m2 = pick(MONTHS_LONG, F.month(monday)), pick(MONTHS_LONG, F.month(sunday))
    d1, d2, y = (F.day(monday).cast("string"), F.day(sunday).cast("string"), F.year(sunday).cast("string"))
    one = F.concat(m1, F.lit(" "), d1, F.lit("–"), d2, F.lit(", "), y)
    two = F.concat(m1, F.lit(" "), d1, F.lit(" – "), m2, F.lit(" "), d2, F.lit(", "), y)
    return F.when(F.month(monday) == F.month(sunday), one).otherwise(two)


def short_day(d: Column, weekday: bool = True) -> Column:
    """"Mon, Jun 15", or "Jun 15"."""
    base = F.concat(pick(MONTHS_SHORT, F.month(d)), F.lit(" "), F.day(d).cast("string"))
    if not weekday:
        return base
    return F.concat(pick([w[:3] for w in WEEKDAYS_LONG], F.weekday(d) + 1), F.lit(", "), base)


# --- typed date queries ---------------------------------------------------------

def date_query(text: str, today: str | date):
    """A predicate over a ``DateType`` column for a typed date, or None.

    The query is one short string typed by a reader, so it is read once at plan
    time; Spark only ever sees the resulting comparison, which it can push down
    when the year is known.
    """
    import re

    s = (text or "").strip().lower()
    now = day(today)
    if s in ("today", "tomorrow"):
        wanted = now + timedelta(days=s == "tomorrow")
        return lambda d: d == F.lit(wanted)
    months = {m.lower()[:n]: i for i, m in enumerate(MONTHS_LONG, 1) for n in (3, len(m))}
    months["sept"] = 9
    y = m = d_ = None
    if hit := re.fullmatch(r"(\d{4})-(\d{1,2})-(\d{1,2})", s):
        y, m, d_ = (int(g) for g in hit.groups())
    elif hit := re.fullmatch(r"(\d{1,2})/(\d{1,2})(?:/(\d{2,4}))?", s):
        m, d_ = int(hit[1]), int(hit[2])
        y = None if hit[3] is None else int(hit[3]) + (2000 if int(hit[3]) < 100 else 0)
    elif hit := re.fullmatch(r"(?:([a-z]+)\.?\s+(\d{1,2})|(\d{1,2})\s+([a-z]+)\.?)(?:[,\s]+(\d{4}))?", s):
        m, d_ = months.get(hit[1] or hit[4]), int(hit[2] or hit[3])
        y = int(hit[5]) if hit[5] else None
    elif hit := re.fullmatch(r"([a-z]+)\.?", s):
        m = months.get(hit[1])
    if not m or not 1 <= m <= 12 or (d_ is not None and not 1 <= d_ <= 31):
        return None

    def predicate(d: Column) -> Column:
        if y is not None and d_ is not None:
            try:
                return d == F.lit(date(y, m, d_))
            except ValueError:
                return F.lit(False)
        test = F.month(d) == m
        if d_ is not None:
            test = test & (F.day(d) == d_)
        if y is not None:
            test = test & (F.year(d) == y)
        return test

    return predicate
