"""Ranking, top-k and ordered views.

A global order is only asked for together with a limit, or for an ordered export,
where Spark range-partitions it. Positions are numbered after the limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from showbill.functions.dates import as_date, day, iso_week, week_bounds
from showbill.functions.facts import nonblank
from showbill.functions.text import slug
from showbill.operators.scale import written
from showbill.values import (
    DIGEST_LIMIT, FEED_LIMIT, GROUP_LIMIT, PICKS_LIMIT, SECTION_ORDER, TEXT_DUMP_LIMIT,
    TOP_PICK_RATING,
)

NO_DATE = "9999-99-99"


def numbered(limited: DataFrame, *order) -> DataFrame:
    """Positions 1..k of an already limited result.

    Only ever called on a handful of rows: the window has no partition key.
    """
    return limited.withColumn("position", F.row_number().over(Window.orderBy(*order)))


def _rating_desc(col: str = "rating") -> Column:
    return F.coalesce(F.col(col), F.lit(-1)).desc()


def top_picks(event: DataFrame, first: DataFrame, min_rating: int = TOP_PICK_RATING) -> DataFrame:
    """Events rated ``min_rating`` or more: best first, then soonest, then title."""
    chosen = event.where(F.col("rating") >= min_rating).join(first, "event_key", "left")
    return chosen.orderBy(
        F.col("rating").desc(),
        F.coalesce(F.nullif("first_date", F.lit("")), F.lit(NO_DATE)), "title", "event_key",
    )


def in_range(screening: DataFrame, start, end) -> DataFrame:
    """Showings from ``start`` to ``end``, both included.

    ``shown_at`` is the stored column, so the bounds reach the file scan.
    """
    if "shown_at" in screening.columns:
        from datetime import datetime, time, timedelta

        low = datetime.combine(start, time.min)
        high = datetime.combine(end + timedelta(days=1), time.min)
        stamp = screening.schema["shown_at"].dataType.simpleString()
        return screening.where(
            (F.col("shown_at") >= F.lit(str(low)).cast(stamp)) & (F.col("shown_at") < F.lit(str(high)).cast(stamp))
        )
    return screening.where(F.col("d").between(F.lit(start), F.lit(end)))


def week_events(screening: DataFrame, start, end) -> DataFrame:
    """First showing and showing count of every event shown between two days."""
    return in_range(screening, start, end).groupBy("event_key").agg(
        F.min(F.struct("date", "time")).alias("first"), F.count("*").alias("n_showings")
    )


def digest(screening: DataFrame, fields: DataFrame, week: str, limit: int = DIGEST_LIMIT) -> DataFrame:
    """The best events of an ISO week.

    ``fields`` gives one row per event; it is asked only about the events of the
    week, whose keys Spark turns into a runtime filter on the larger side.
    """
    monday, sunday = week_bounds(week)
    shown = week_events(screening, monday, sunday)
    order = (_rating_desc(), F.col("first_date"), F.col("first_time"), F.col("event_key"))
    best = fields.join(shown, "event_key").select(
        "event_key", "title", "type", "venue", "rating", "url",
        F.col("first.date").alias("first_date"), F.col("first.time").alias("first_time"), "n_showings",
    ).orderBy(*order).limit(limit)
    return numbered(best, *order)


def digest_showings(picks: DataFrame, screening: DataFrame, week: str) -> DataFrame:
    """The showings of the picks inside their week, one row each."""
    monday, sunday = week_bounds(week)
    shows = in_range(screening, monday, sunday).select(
        "event_key", "date", "time", F.col("venue").alias("shown_at_venue"), F.col("url").alias("showing_url"), "ord")
    return shows.join(picks.select("event_key", "position"), "event_key")


def feed_rank(event: DataFrame, first: DataFrame, now, limit: int | None = FEED_LIMIT) -> DataFrame:
    """Upcoming events, then past, then undated; in each by rating, then soonest or latest."""
    d = as_date(F.col("first_date"))
    days = F.datediff(d, F.lit(day(now)))
    ranked = event.join(first, "event_key", "left").withColumn(
        "bucket", F.when(d.isNull(), 2).when(days >= 0, 0).otherwise(1)
    ).withColumn("distance", F.coalesce(F.abs(days), F.lit(0)))
    order = ("bucket", F.col("rating").desc_nulls_last(), "distance", "event_key")
    ranked = ranked.orderBy(*order)
    return ranked if limit is None else numbered(ranked.limit(limit), *order)


def text_rank(event: DataFrame, first: DataFrame, limit: int = TEXT_DUMP_LIMIT) -> DataFrame:
    """Rating, then first date, then title."""
    order = (_rating_desc(), F.col("first_date"), F.col("title"), F.col("event_key"))
    ranked = event.join(first, "event_key", "left").orderBy(*order).limit(limit)
    return numbered(ranked, *order)


def next_per_group(event: DataFrame, screening: DataFrame, by: str, today, k: int = GROUP_LIMIT) -> DataFrame:
    """The next ``k`` events of every venue or person.

    ``row_number <= k`` lets Spark drop all but ``k`` rows per group in each task
    before the shuffle, so a group with very many events stays cheap.
    """
    from showbill.operators.grouping import upcoming

    first = upcoming(screening, today).groupBy("event_key").agg(F.min(F.struct("date", "time")).alias("next"))
    rows = event.where(F.coalesce(F.trim(by), F.lit("")) != "").join(first, "event_key").select(
        "event_key", "title", by, "rating",
        F.col("next.date").alias("next_date"), F.col("next.time").alias("next_time"),
    )
    w = Window.partitionBy(by).orderBy("next_date", "next_time", F.lower("title"), "event_key")
    return rows.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def urgency_date(end_date: Column, first_date: Column, today) -> Column:
    """Closing date of a run that is open, else its first date."""
    now = str(day(today))
    end, first = F.nullif(end_date, F.lit("")), F.nullif(first_date, F.lit(""))
    return F.when(end.isNotNull() & (first <= now), end).otherwise(F.coalesce(first, end, F.lit("9999-12-31")))


def reader_order(event: DataFrame, today) -> DataFrame:
    """Scored events by rating and title, the others by urgency and title."""
    scored = F.col("type") == "movie"
    return event.withColumn("scored", scored).withColumn(
        "urgency", urgency_date(F.col("end_date"), F.col("first_date"), today)
    ).orderBy(
        F.col("scored").desc(),
        F.when(F.col("scored"), F.coalesce("rating", F.lit(0))).desc(),
        F.when(~F.col("scored"), F.col("urgency")),
        "title",
    )


# --- taste ------------------------------------------------------------------------

def collapse_signals(signal: DataFrame) -> DataFrame:
    """One row per (reader, event): what a run of signals does to whatever state it meets.

    A thumb equal to the current one clears it, any other one replaces it; a save toggles.
    So only the closing run of equal thumbs matters: its value, its length, and whether
    there was a different thumb before it. Counts and maxima give all of these, which
    Spark combines before the shuffle; no group is ever sorted or held in memory.
    """
    keys = ["user_id", "k"]
    pos = F.struct("ts", "ord")
    last = signal.groupBy(*keys).agg(
        F.max(F.when(F.col("thumb") == 1, pos)).alias("last_up"), F.max(F.when(F.col("thumb") == -1, pos)).alias("last_down"))
    value = F.when(F.col("last_up").isNull() & F.col("last_down").isNull(), 0).when(
        F.col("last_down").isNull() | (F.col("last_up") > F.col("last_down")), 1).otherwise(-1)
    other = F.when(value == 1, F.col("last_down")).otherwise(F.col("last_up"))
    marked = last.select(*keys, value.alias("value"), F.when(value != 0, other).alias("other"))
    after = F.col("other").isNull() | (pos > F.col("other"))
    return signal.join(marked, keys).groupBy(*keys, "value").agg(
        F.count_if((F.col("thumb") == F.col("value")) & after).alias("run"),
        F.bool_or(F.col("other").isNotNull()).alias("turned"),
        (F.count_if(F.col("saved")) % 2 == 1).alias("toggles_save"),
    )


def reader_weights(signal: DataFrame) -> DataFrame:
    """(user_id, k, weight): each reader's thumb (-1, 0, 1) plus one when saved; zero weights drop out.

    The same fold as the stream's, over all signals as one batch.
    """
    odd = F.col("run") % 2 == 1
    thumb = F.when(odd, F.col("value")).otherwise(0)
    return collapse_signals(signal).select(
        "user_id", "k", (thumb + F.col("toggles_save").cast("int")).alias("weight")).where(F.col("weight") != 0)


def weighted_events(event: DataFrame, weights: DataFrame, reader: int, modulo: int = 100) -> DataFrame:
    """The events one reader has a weight for, with the fields that bias and leaders need."""
    own = weights.where(F.col("user_id") == reader).select("k", "weight")
    return event.join(own, F.col("event_key") % modulo == F.col("k")).select("event_key", "title", "type", "venue", "weight")


def taste_bias(weighted: DataFrame, by: str) -> DataFrame:
    """Sum of weights per category or venue."""
    return weighted.groupBy(F.lower(F.col(by)).alias(by)).agg(F.sum("weight").alias("bias"))


def leader(weighted: DataFrame, by: str) -> DataFrame:
    """The strongest liked event of every category or venue; ties go to the smallest title."""
    liked = weighted.where((F.col("weight") > 0) & (F.coalesce("title", F.lit("")) != ""))
    return liked.groupBy(F.lower(F.col(by)).alias(by)).agg(
        F.min(F.struct((-F.col("weight")).alias("w"), "title")).alias("lead")
    ).select(by, "lead.title", (-F.col("lead.w")).alias("weight"))


def _bias_and_leader(weighted: DataFrame, by: str, key: str, tag: str) -> DataFrame:
    """``taste_bias`` and ``leader`` of every category or venue from one aggregate."""
    liked = (F.col("weight") > 0) & (F.coalesce("title", F.lit("")) != "")
    return weighted.groupBy(F.lower(F.col(by)).alias(key)).agg(
        F.sum("weight").alias(f"{tag}_bias"),
        F.min(F.when(liked, F.struct((-F.col("weight")).alias("w"), "title"))).alias("_lead"),
    ).select(key, f"{tag}_bias", F.col("_lead.title").alias(f"{tag}_leader"))


def attach_taste(picks: DataFrame, weighted: DataFrame) -> DataFrame:
    """Category and venue bias and leaders on every pick.

    The reader's weighted events are written once; the two sides have a row per category
    or venue, and Spark broadcasts those its statistics show to be small.
    """
    weighted = written(weighted, "weighted")
    out = picks.withColumns({"cat_key": F.lower("type"), "venue_key": F.lower("venue")})
    for by, key, tag in (("type", "cat_key", "cat"), ("venue", "venue_key", "venue")):
        out = out.join(_bias_and_leader(weighted, by, key, tag), key, "left")
    return out


def rerank_by_taste(picks: DataFrame, weighted: DataFrame, k: int = PICKS_LIMIT) -> DataFrame:
    """Rating plus half the bias, held within two points; the leader is the stated reason.

    The venue's leader is preferred; a pick never cites itself.
    """
    out = attach_taste(picks, weighted)
    cat, ven = F.coalesce("cat_bias", F.lit(0)), F.coalesce("venue_bias", F.lit(0))
    boost = F.greatest(F.lit(-2.0), F.least(F.lit(2.0), (cat + ven) * 0.5))
    by_venue = F.when((ven > 0) & (F.col("venue_leader") != F.col("title")), F.col("venue_leader"))
    by_cat = F.when((cat > 0) & (F.col("cat_leader") != F.col("title")), F.col("cat_leader"))
    order = (F.col("score").desc(), F.coalesce("rating", F.lit(0)).desc(), "title", "event_key")
    best = out.withColumns({
        "boost": boost,
        "score": F.coalesce("rating", F.lit(0)) + boost,
        "reason": F.when(boost > 0, F.coalesce(by_venue, by_cat)),
    }).orderBy(*order).limit(k)
    return numbered(best, *order)


# --- batches and sections -------------------------------------------------------------

def upcoming_weeks(screening: DataFrame, today, weeks_ahead: int) -> DataFrame:
    """ISO weeks with a showing between today and the horizon."""
    from datetime import timedelta

    now = day(today)
    rows = in_range(screening, now, now + timedelta(weeks=weeks_ahead))
    return rows.select(iso_week(F.col("d")).alias("w")).select(
        F.col("w.year").alias("year"), F.col("w.week").alias("week"), F.col("w.label").alias("label"),
        F.col("w.monday").alias("monday"), F.col("w.sunday").alias("sunday"),
    ).distinct()


def all_digests(screening: DataFrame, event: DataFrame, today, weeks_ahead: int,
                limit: int = DIGEST_LIMIT) -> DataFrame:
    """The digest of every upcoming week in one job.

    Like the single digest, a week counts all its seven days, also those before
    today in the current week.
    """
    from datetime import timedelta

    now = day(today)
    weeks = upcoming_weeks(screening, today, weeks_ahead).select("label")
    first_day = now - timedelta(days=now.weekday())
    horizon = now + timedelta(weeks=weeks_ahead)
    last_day = horizon + timedelta(days=6 - horizon.weekday())
    shown = in_range(screening, first_day, last_day).withColumn("label", iso_week(F.col("d"))["label"]).groupBy(
        "label", "event_key").agg(F.min(F.struct("date", "time")).alias("first"), F.count("*").alias("n_showings"))
    rows = shown.join(weeks, "label", "left_semi").join(event, "event_key")
    w = Window.partitionBy("label").orderBy(_rating_desc(), "first.date", "first.time", "event_key")
    return rows.withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit)


def tipsheet(picks: DataFrame, featured: int = 1, rows: int = 9) -> DataFrame:
    """Rank label of every pick: featured, row, or overflow; and "+N more" for its showings."""
    place = F.when(F.col("position") <= featured, "featured").when(
        F.col("position") <= featured + rows, "row").otherwise("overflow")
    extra = F.col("n_showings") - 1
    more = F.when(extra > 0, F.concat(F.lit("+"), extra.cast("string"), F.lit(" more"))).otherwise("")
    return picks.withColumns({"place": place, "more": more})


def category_sections(event: DataFrame, order=SECTION_ORDER) -> DataFrame:
    """Section number of every event; categories outside the fixed order come last."""
    names = F.array(*[F.lit(c) for c in order])
    at = F.array_position(names, F.lower(F.coalesce("type", F.lit("other"))))
    return event.withColumn("section", F.when(at == 0, F.lit(len(order) + 1)).otherwise(at))


def agenda(event: DataFrame, first: DataFrame) -> DataFrame:
    """All events in the order of their first showing; events without one come last."""
    rows = event.join(first, "event_key", "left")
    d = F.coalesce(F.col("first_showing.date"), F.lit("9999-12-31"))
    t = F.coalesce(F.col("first_showing.time"), F.lit("23:59"))
    return rows.withColumns({"agenda_date": d, "agenda_time": t}).orderBy("agenda_date", "agenda_time", "event_key")


def sample_per_source(rows: DataFrame, source: str, k: int = 3) -> DataFrame:
    """The first ``k`` rows of every source."""
    w = Window.partitionBy(source).orderBy("ord")
    return rows.withColumn("sample_no", F.row_number().over(w)).where(F.col("sample_no") <= k)


def first_usable_attempt(attempt: DataFrame, key: str = "event_key") -> DataFrame:
    """Content of the lowest attempt that is not blank and not a refusal."""
    from showbill.functions.facts import nonblank
    from showbill.functions.review import is_refusal

    good = nonblank(F.col("content")) & ~is_refusal(F.col("content"))
    return attempt.where(good).groupBy(key).agg(
        F.min_by(F.struct("attempt_no", "content"), "attempt_no").alias("hit")
    ).select(key, "hit.attempt_no", "hit.content")


def composer_upcoming(event: DataFrame, screening: DataFrame, person: str, today, name: str | None = None) -> DataFrame:
    """Upcoming events of one person, or of everyone: each once, in order.

    Events with the same id (or, without one, the same title and first showing) count once.
    """
    from showbill.operators.grouping import first_row, upcoming

    theirs = event.where(nonblank(F.col(person)))
    if name is not None:
        theirs = theirs.where(F.lower(F.col(person)) == name.lower())
    first = upcoming(screening, today).groupBy("event_key").agg(F.min(F.struct("date", "time")).alias("next"))
    rows = theirs.join(first, "event_key").select(
        "event_key", person, "title", "venue", "rating", slug(F.col("title"), "event_id").alias("id"),
        F.col("next.date").alias("first_date"), F.col("next.time").alias("first_time"))
    key = F.coalesce(F.nullif("id", F.lit("")), F.concat_ws("|", "title", "first_date", "first_time"))
    once = first_row(rows.withColumn("once", key), [person, "once"],
                     ["event_key", "title", "venue", "rating", "first_date", "first_time"], ord="event_key")
    return once.drop("once").orderBy(person, "first_date", "first_time", F.lower("title"))
