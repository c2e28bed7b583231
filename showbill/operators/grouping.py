"""From listings to events and showings: zip, flatten, group, finalize."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from showbill.functions.dates import as_date
from showbill.functions.text import slug


def first_row(df: DataFrame, keys: Sequence[str], fields: Sequence[str], ord: str = "ord",
              last: bool = False) -> DataFrame:
    """One row per key with the fields of its first (or last) row by ``ord``.

    A ``min_by`` over one struct keeps a single row per key in every map task, so
    a key with very many rows costs no more than any other after the shuffle.
    """
    take = F.max_by if last else F.min_by
    kept = df.groupBy(*keys).agg(take(F.struct(*fields), F.col(ord)).alias("_row"))
    return kept.select(*keys, *[F.col(f"_row.{f}").alias(f) for f in fields])


# --- listings with parallel arrays ------------------------------------------------

def time_at(times: Column, i: Column, default: str = "TBD", rule: str = "pairwise") -> Column:
    """Time that goes with the i-th date: its own, else the first one, else a default."""
    first = F.get(times, F.lit(0))
    if rule == "pairwise":
        return F.coalesce(F.get(times, i), first, F.lit(default))
    return F.coalesce(first, F.lit(default))


def zip_dates_times(listing: DataFrame, rule: str = "pairwise", default: str = "TBD") -> DataFrame:
    """One row per date of a listing, in position order; listings without dates give none."""
    return listing.select("*", F.posexplode("dates").alias("pos", "date")).withColumn(
        "time", time_at(F.col("times"), F.col("pos"), default, rule)
    )


def without_dates(listing: DataFrame) -> DataFrame:
    """The listings ``zip_dates_times`` cannot place."""
    return listing.where(F.coalesce(F.size("dates"), F.lit(0)) <= 0)


def flatten_showings(event: DataFrame, form: str = "list") -> DataFrame:
    """Nested showings to rows.

    The event's own showings if there are any; else dates with times when both
    arrays are equally long; else (``list`` only) dates without a time. The
    ``calendar`` form zips up to the shorter array and skips rows without a date
    or time.
    """
    shape = "array<struct<date:string,time:string,venue:string,url:string>>"
    own = F.transform("screenings", lambda s: F.struct(
        s["date"].alias("date"),
        s["time"].alias("time"),
        F.coalesce(F.nullif(s["venue"], F.lit("")), F.col("venue")).alias("venue"),
        F.coalesce(F.nullif(s["url"], F.lit("")), F.col("url")).alias("url"),
    ))

    def row(d: Column, t: Column) -> Column:
        return F.struct(d.alias("date"), t.alias("time"), F.col("venue").alias("venue"), F.col("url").alias("url"))

    zipped = F.transform(F.arrays_zip("dates", "times"), lambda z: row(z["dates"], z["times"]))
    bare = F.transform("dates", lambda d: row(d, F.lit("")))
    n_own, n_d, n_t = (F.coalesce(F.size(c), F.lit(0)) for c in ("screenings", "dates", "times"))
    if form == "list":
        rows = F.when(n_own > 0, own).when((n_d == n_t) & (n_d > 0), zipped).when(n_d > 0, bare)
        keep = F.coalesce(F.col("s.date"), F.lit("")) != ""
    elif form == "calendar":
        rows = F.when(n_own > 0, own).when((n_d > 0) & (n_t > 0), zipped)
        keep = (F.coalesce(F.col("s.date"), F.lit("")) != "") & (F.coalesce(F.col("s.time"), F.lit("")) != "")
    else:
        raise ValueError(f"unknown form {form!r}")
    flat = event.select(
        *[c for c in event.columns if c not in ("screenings", "dates", "times", "venue", "url")],
        F.explode(rows.cast(shape)).alias("s"),
    )
    return flat.where(keep).select("*", "s.date", "s.time", "s.venue", "s.url").drop("s")


# --- grouping -----------------------------------------------------------------------

def group_by_title(listing: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One event per title with the fields of its first listing.

    The showings stay rows of their own: they join back on ``title`` and are never
    gathered into one array.
    """
    return first_row(listing, ["title"], fields)


def unique_key(title: Column, dates: Column, times: Column) -> Column:
    """"title - dates times" of an event that is not grouped by title."""
    def joined(arr: Column) -> Column:
        return F.coalesce(F.nullif(F.array_join(arr, ","), F.lit("")), F.lit("TBD"))

    return F.concat(F.coalesce(title, F.lit("Unknown")), F.lit(" - "), joined(dates), F.lit(" "), joined(times))


def unique_events(listing: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One event per (title, dates, times); the last listing wins."""
    keyed = listing.withColumn("unique_key", unique_key(F.col("title"), F.col("dates"), F.col("times")))
    return first_row(keyed, ["unique_key"], fields, last=True)


def finalize(event: DataFrame, screening: DataFrame, key: str = "event_key") -> DataFrame:
    """Id, sorted distinct dates and times, first showing and showing count per event.

    Dates are at most one per calendar day and times at most one per minute, so
    both sets stay small however many showings an event has.
    """
    shown = screening.groupBy(key).agg(
        F.array_sort(F.collect_set(F.nullif("date", F.lit("")))).alias("dates"),
        F.array_sort(F.collect_set(F.nullif("time", F.lit("")))).alias("times"),
        F.min(F.struct(
            F.coalesce(F.nullif("date", F.lit("")), F.lit("9999-12-31")).alias("date"),
            F.coalesce(F.nullif("time", F.lit("")), F.lit("23:59")).alias("time"),
        )).alias("first"),
        F.count("*").alias("n_showings"),
    )
    return event.join(shown, key).withColumn("id", slug(F.col("title"), "event_id"))


def first_occurrence(screening: DataFrame, key: str = "event_key") -> DataFrame:
    """First date (the smallest) and first time (the first nonblank one by position)."""
    has_time = F.coalesce(F.col("time"), F.lit("")) != ""
    return screening.groupBy(key).agg(
        F.coalesce(F.min(F.nullif("date", F.lit(""))), F.lit("")).alias("first_date"),
        F.coalesce(F.min_by("time", F.when(has_time, F.col("ord"))), F.lit("")).alias("first_time"),
        F.min(F.struct(F.col("date"), F.col("time"))).alias("first_showing"),
    )


def keep_first(df: DataFrame, keys: Sequence[str], ord: str = "ord") -> DataFrame:
    """The first row of every key."""
    others = [c for c in df.columns if c not in keys]
    return first_row(df, keys, others, ord)


def upcoming(screening: DataFrame, today) -> DataFrame:
    """Showings from today on; unreadable dates are dropped."""
    from showbill.functions.dates import day

    d = F.col("d") if "d" in screening.columns else as_date(F.col("date"))
    return screening.where(d >= F.lit(day(today)))
