"""Clock readings in many shapes to ``HH:mm``, durations, and showing spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from showbill.functions.dates import as_date, let, match
from showbill.values import SHOW_HOURS, ZONE

_H24 = r"^(2[0-3]|[01]\d|\d):([0-5]\d|\d)(?::(?:6[01]|[0-5]\d|\d))?$"
_H12 = r"(?i)^\s*(1[0-2]|0[1-9]|[1-9]):([0-5]\d|\d)\s*([AP]M)\s*$"


def hhmm(hour: Column, minute: Column) -> Column:
    return F.concat(
        F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), F.lpad(minute.cast("string"), 2, "0")
    )


def afternoon(hour: Column, half: Column) -> Column:
    """24-hour reading of an hour with its am/pm mark; without a mark the hour stands."""
    mark = F.lower(half)
    return (
        F.when((mark == "pm") & (hour != 12), hour + 12)
        .when((mark == "am") & (hour == 12), F.lit(0))
        .otherwise(hour)
    )


def _reading(text: Column, pattern: str, h: int = 1, m: int | None = 2, half: int | None = None) -> Column:
    """``HH:mm`` of the groups of a pattern; each group is read once."""
    parts = F.struct(
        match(text, pattern, h).cast("int").alias("h"),
        (match(text, pattern, m) if m else F.lit("00")).alias("m"),
        (match(text, pattern, half) if half else F.lit(None).cast("string")).alias("half"),
    )
    return F.when(text.rlike(pattern), let(parts, lambda c: hhmm(
        afternoon(c["h"], c["half"]) if half else c["h"], F.coalesce(c["m"], F.lit("00")))))


def normalize_time(col: Column) -> Column:
    """``HH:mm`` where some known format reads the text; any other text is kept as it is."""
    return F.coalesce(
        F.when(col.rlike(r"^\d{2}:\d{2}$"), col), _reading(col, _H24), _reading(col, _H12, half=3), col)


def normalize_times(arr: Column) -> Column:
    return F.coalesce(F.transform(arr, normalize_time), F.array().cast("array<string>"))


_LOOSE = r"(?is)^\D*?(\d{1,2})(?::(\d{2}))?\s*(am|pm)?(.*)$"


def loose_time(col: Column) -> Column:
    """First clock reading in free text; the am/pm mark may follow a whole range."""

    def read(text: Column) -> Column:
        hour = match(text, _LOOSE, 1).cast("int")
        minute = F.coalesce(match(text, _LOOSE, 2), F.lit("0")).cast("int")
        half = F.coalesce(match(text, _LOOSE, 3), match(match(text, _LOOSE, 4), r"(?i)(am|pm)", 1))
        return let(F.struct(afternoon(hour, half).alias("h"), minute.alias("m")), lambda c: F.when(
            c["h"].between(0, 23) & c["m"].between(0, 59), hhmm(c["h"], c["m"])
        ))

    return let(F.trim(col), lambda t: F.when(t.rlike(r"\A(?:[01]\d|2[0-3]):[0-5]\d\z"), t).when(~t.rlike(r"^\d{4}-\d{2}-\d{2}"), read(t)))


_STRICT = r"(?i)^\s*(\d{1,2}):(\d{2})\s*([AP]M)\s*$"


def to_24h(col: Column) -> Column:
    """"5:15 PM" -> "17:15"; anything else null."""
    return _reading(col, _STRICT, half=3)


def is_clock_12h(col: Column) -> Column:
    """A 12-hour reading with the hour in 1..12 and the minute in 0..59."""
    return F.coalesce(col.rlike(r"(?i)^\s*(?:1[0-2]|0?[1-9]):[0-5]\d\s*[AP]M\s*$"), F.lit(False))


_PAGE12 = r"^(1[0-2]|0[1-9]|[1-9]):([0-5]\d|\d)\s+([AP]M)$"
_PAGE_HOUR = r"^(1[0-2]|0[1-9]|[1-9])\s+([AP]M)$"
_PAGE24 = r"^(2[0-3]|[01]\d|\d):([0-5]\d|\d)$"


def listing_time(col: Column) -> Column:
    """Page times: "7:30 p.m.", "7 PM" or "19:30"; else null."""
    return let(F.replace(F.upper(F.trim(col)), F.lit("."), F.lit("")), lambda t: F.coalesce(
        _reading(t, _PAGE12, half=3), _reading(t, _PAGE_HOUR, m=None, half=2), _reading(t, _PAGE24)))


_FEED = r"^(\d{1,2})(?::(\d{1,2}))?(AM|PM)$"
_FEED24 = r"^(\d{1,2}):(\d{1,2})$"


def clock_struct(col: Column) -> Column:
    """``struct<hour,minute>`` of a feed time: "7PM", "7:30 pm" or "19:30"; null out of range."""

    def read(text: Column) -> Column:
        hour = F.coalesce(
            afternoon(match(text, _FEED, 1).cast("int"), match(text, _FEED, 3)),
            match(text, _FEED24, 1).cast("int"),
        )
        minute = F.coalesce(match(text, _FEED, 2), match(text, _FEED24, 2), F.lit("0")).cast("int")
        return let(F.struct(hour.alias("hour"), minute.alias("minute")), lambda c: F.when(
            c["hour"].between(0, 23) & c["minute"].between(0, 59), c
        ))

    return let(F.replace(F.upper(F.trim(col)), F.lit(" "), F.lit("")), read)


def start_local(date_text: Column, time_text: Column) -> Column:
    """Local wall-clock start; null when the date or the time cannot be read."""
    d = as_date(date_text).cast("string")
    return let(clock_struct(time_text), lambda c: F.concat(
        d, F.lit(" "), hhmm(c["hour"], c["minute"]), F.lit(":00")
    ).try_cast("timestamp_ntz"))


def utc_of_local(local: Column, zone: str = ZONE) -> Column:
    """Instant of a local wall-clock time, as a zone-free UTC timestamp.

    In the hour that repeats when clocks go back, the standard-time reading is
    taken: an hour that converts to the same wall clock again one hour later is
    that repeated hour.
    """
    hour = F.expr("INTERVAL 1 HOUR")
    return let(F.convert_timezone(F.lit(zone), F.lit("UTC"), local), lambda at: F.when(
        F.convert_timezone(F.lit("UTC"), F.lit(zone), at + hour) == local, at + hour).otherwise(at))


def span(date_text: Column, time_text: Column) -> Column:
    """"start/end" stamps for a calendar link: two hours, or the whole day without a time."""
    d = as_date(date_text)
    stamp = "yyyyMMdd'T'HHmmss"
    timed = let(start_local(date_text, time_text), lambda start: F.concat(
        F.date_format(start, stamp), F.lit("/"),
        F.date_format(start + F.expr(f"INTERVAL {SHOW_HOURS} HOURS"), stamp),
    ))
    whole = F.concat(F.date_format(d, "yyyyMMdd"), F.lit("/"), F.date_format(F.date_add(d, 1), "yyyyMMdd"))
    return F.when(F.coalesce(time_text, F.lit("")) == "", whole).otherwise(timed)


def duration_minutes(col: Column) -> Column:
    """Minutes of "1:50", "1h 38min", "2 hrs, 5 mins", "90 min", "1h 50" or a bare "90"."""
    text = F.lower(F.trim(col))
    for old, new in (("\u00a0", " "), (".", ""), ("mins", "min"), ("minutes", "min"), ("hrs", "hr")):
        text = F.replace(text, F.lit(old), F.lit(new))
    colon, compact = r"^\s*(\d{1,2})\s*:\s*(\d{1,2})\s*$", r"(\d+)\s*h\s*(\d{1,2})\b"

    def number(s: Column, pattern: str, group: int = 1) -> Column:
        return match(s, pattern, group).try_cast("int")

    def tokens(s: Column) -> Column:
        found = F.struct(
            number(s, r"(\d+)\s*(?:h|hr|hour)\b").alias("h"), number(s, r"(\d+)\s*(?:m|min)\b").alias("m")
        )
        return let(found, lambda t: F.when(
            t["h"].isNotNull() | t["m"].isNotNull(),
            F.coalesce(t["h"], F.lit(0)) * 60 + F.coalesce(t["m"], F.lit(0)),
        ))

    return let(text, lambda s: F.coalesce(
        number(s, colon, 1) * 60 + number(s, colon, 2),
        tokens(s),
        number(s, compact, 1) * 60 + number(s, compact, 2),
        number(s, r"^\s*(\d{2,3})\s*$"),
    ))


def clock_12h(col: Column, style: str = "long") -> Column:
    """"19:30" -> "7:30 PM"; ``short`` gives "7:30pm" and drops ":00". Other text is kept."""
    shape = r"^(\d{1,2}):(\d{2})$"

    def show(c: Column) -> Column:
        h12 = F.when(c["h"] % 12 == 0, F.lit(12)).otherwise(c["h"] % 12).cast("string")
        if style == "short":
            tail = F.when(c["m"] == "00", F.lit("")).otherwise(F.concat(F.lit(":"), c["m"]))
            return F.concat(h12, tail, F.when(c["h"] >= 12, "pm").otherwise("am"))
        return F.concat(h12, F.lit(":"), c["m"], F.when(c["h"] >= 12, " PM").otherwise(" AM"))

    parts = F.struct(match(col, shape, 1).cast("int").alias("h"), match(col, shape, 2).alias("m"))
    return F.when(col.rlike(shape), let(parts, show)).otherwise(F.coalesce(col, F.lit("")))
