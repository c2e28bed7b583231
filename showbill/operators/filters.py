"""Filters and predicates over events, showings and candidate fields."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from showbill.functions.dates import date_query, day
from showbill.functions.facts import nonblank, supported_type
from showbill.functions.review import is_refusal
from showbill.functions.text import labelled, squeeze
from showbill.operators.ranking import in_range
from showbill.values import LABELS_READER, SPARSE_SHARE


# --- windows and search -----------------------------------------------------------------

def view_bounds(view: str, today) -> tuple:
    """First and last day of a view: today, week (7 days), weekend (Friday to Sunday)."""
    now = day(today)
    if view == "today":
        return now, now
    if view == "week":
        return now, now + timedelta(days=6)
    if view == "weekend":
        friday = now - timedelta(days=2) if now.weekday() == 6 else now + timedelta(days=4 - now.weekday())
        return friday, friday + timedelta(days=2)
    raise ValueError(f"unknown view {view!r}")


def in_window(screening: DataFrame, view: str, today) -> DataFrame:
    """Showings inside a view; the bounds are constants, so the scan is pruned."""
    return in_range(screening, *view_bounds(view, today))


def on_date(screening: DataFrame, query: str, today) -> DataFrame | None:
    """Showings on a typed date, or None when the text is not a date."""
    predicate = date_query(query, today)
    return None if predicate is None else screening.where(predicate(F.col("d")))


def reader_label(kind: Column) -> Column:
    kind = F.lower(F.coalesce(kind, F.lit("")))
    return labelled(kind, LABELS_READER, F.replace(kind, F.lit("_"), F.lit(" ")))


def text_match(query: str) -> Column:
    """The query occurs in title, venue, category or its label."""
    q = query.strip().lower()
    fields = [F.lower(F.coalesce(c, F.lit(""))) for c in ("title", "venue", "type")] + [F.lower(reader_label(F.col("type")))]
    out = fields[0].contains(q)
    for f in fields[1:]:
        out = out | f.contains(q)
    return out


def search(event: DataFrame, screening: DataFrame, query: str, today) -> DataFrame:
    """Events that match the text, or have a showing on the typed date."""
    if not query.strip():
        return event
    shown = on_date(screening, query, today)
    if shown is None:
        return event.where(text_match(query))
    hits = shown.select("event_key").distinct().withColumn("_shown", F.lit(True))
    return event.join(hits, "event_key", "left").where(
        F.coalesce("_shown", F.lit(False)) | text_match(query)).drop("_shown")


def filter_events(event: DataFrame, screening: DataFrame, today, query: str = "", saved: DataFrame | None = None,
                  category: str | None = None, view: str | None = None) -> DataFrame:
    """Query, saved, category and time filters together."""
    out = search(event, screening, query, today)
    if category is not None:
        out = out.where(F.lower(F.coalesce("type", F.lit("other"))) == category)
    if saved is not None:
        out = out.join(saved.select("event_key"), "event_key", "left_semi")
    if view is not None:
        out = out.join(in_window(screening, view, today).select("event_key"), "event_key", "left_semi")
    return out


def allowed_titles(event: DataFrame, titles: Sequence[str] | DataFrame) -> DataFrame:
    """Events whose title is on a list, given as values or as a table."""
    if isinstance(titles, DataFrame):
        return event.join(titles.select("title"), "title", "left_semi")
    return event.where(F.col("title").isin(list(titles)))


# --- gates ---------------------------------------------------------------------------------

def split_confidence(event: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(listings, research list): low confidence goes to the second."""
    low = F.lower(F.coalesce("review_confidence", F.lit("unknown"))) == "low"
    return event.where(~low), event.where(low)


def supported(df: DataFrame, film_venue: Column) -> tuple[DataFrame, DataFrame]:
    """(rows to process, rejects with a reason)."""
    judged = df.withColumn("_s", supported_type(F.col("type"), film_venue))
    kept = judged.where(F.col("_s.reason").isNull()).withColumn("type", F.col("_s.type")).drop("_s")
    rejects = judged.where(F.col("_s.reason").isNotNull()).withColumn("reason", F.col("_s.reason")).drop("_s")
    return kept, rejects


def is_sparse() -> Column:
    """A title, but neither description, runtime, year nor director."""
    absent = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    return (
        (F.coalesce("title", F.lit("")) != "") & ~nonblank(F.col("description"))
        & absent("runtime_minutes") & absent("release_year") & (F.coalesce("director", F.lit("")) == "")
    )


def sparse_policy(df: DataFrame, source: str, threshold: float = SPARSE_SHARE) -> DataFrame:
    """Sparse rows are dropped, or, where they are a large share of their source, kept with a placeholder.

    The share is a small aggregate joined back, so no source is gathered in one task.
    """
    marked = df.withColumn("sparse", is_sparse())
    share = marked.groupBy(source).agg(F.avg(F.col("sparse").cast("int")).alias("_share"))
    judged = marked.join(share, source)
    fill = F.col("sparse") & (F.col("_share") > threshold)
    note = F.concat("title", F.lit(" at "), source, F.lit(" — see venue for details"))
    return judged.where(~F.col("sparse") | (F.col("_share") > threshold)).withColumns({
        "description": F.when(fill, note).otherwise(F.col("description")),
        "one_liner_summary": F.when(fill, note).otherwise(F.col("one_liner_summary")),
    }).drop("_share")


def accept_fields(candidate: DataFrame, context: DataFrame, key: str = "event_key") -> DataFrame:
    """Verdict on every proposed field value.

    Accepted when the value occurs in the event's context text (whitespace squeezed),
    or when it is cited with at least one link.
    """
    joined = candidate.join(context, key)
    value = squeeze(F.col("value"))
    found = (F.col("evidence") == "substring") & squeeze(F.col("context")).contains(value)
    cited = (F.col("evidence") == "citation") & (F.coalesce(F.size("citations"), F.lit(0)) > 0)
    ok = (F.coalesce("value", F.lit("")) != "") & (found | cited)
    return joined.withColumn("accepted", F.coalesce(ok, F.lit(False))).drop("context")


def useful(required: Sequence[str], optional: Sequence[str]) -> Column:
    """Not everything is blank and all required fields are there."""
    filled = [nonblank(F.col(c).cast("string")) for c in (*required, *optional)]
    some = filled[0]
    for f in filled[1:]:
        some = some | f
    out = some
    for c in required:
        out = out & nonblank(F.col(c).cast("string"))
    return out


def clean_refusals(df: DataFrame, fields: Sequence[str] = ("description", "one_liner_summary")) -> DataFrame:
    """Declined text replaced by the stub; ``changed`` names the replaced fields."""
    from showbill.values import REFUSAL_STUB

    flags = {f: is_refusal(F.col(f)) for f in fields}
    changed = F.filter(F.array(*[F.when(flags[f], F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    return df.withColumn("changed", changed).withColumns(
        {f: F.when(F.array_contains("changed", f), F.lit(REFUSAL_STUB)).otherwise(F.col(f)) for f in fields})
