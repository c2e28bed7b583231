"""Rollups: venues, people, counts, coverage, suggestions, prospects, reader groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from showbill.functions.facts import nonblank
from showbill.functions.text import clean_name, labelled, slug
from showbill.operators.grouping import first_row, upcoming
from showbill.operators.filters import reader_label
from showbill.operators.scale import position_in_group, written
from showbill.values import CATEGORIES, LABELS_API, ROLE_OF_TYPE, SUGGEST_LIMIT


def venues(event: DataFrame, base_url: str) -> DataFrame:
    """Every venue with its count, categories, display name, address and page.

    Name and address are the first nonblank ones by event order.
    """
    rows = event.where(nonblank(F.col("venue"))).withColumn("name", F.trim("venue"))

    def first_of(field: str) -> Column:
        return F.min_by(F.trim(field), F.when(nonblank(F.col(field)), F.col("event_key")))

    out = rows.groupBy("name").agg(
        F.count("*").alias("event_count"),
        F.array_sort(F.collect_set(F.coalesce("type", F.lit("other")))).alias("categories"),
        first_of("venue_display_name").alias("_display"), first_of("venue_address").alias("_address"),
    )
    key = slug(F.col("name"))
    return out.select(
        key.alias("slug"), "name", F.coalesce("_display", "name").alias("display_name"),
        F.coalesce("_address", F.lit("")).alias("address"), "event_count", "categories",
        F.when(key != "", F.concat(F.lit(f"{base_url}venues/"), key, F.lit(".html"))).otherwise("").alias("page_url"),
    )


def event_people(event: DataFrame, fields: Sequence[str], clean: bool = False) -> DataFrame:
    """(event_key, role, name) rows; a name counts once per event whatever its case.

    The names of one event sit in one row, so they are deduplicated there, without a shuffle.
    """
    roles = F.create_map(*[F.lit(x) for pair in ROLE_OF_TYPE.items() for x in pair])
    values = F.array(*[clean_name(F.col(f)) if clean else F.trim(f) for f in fields])
    names = F.filter(values, lambda n: F.coalesce(n, F.lit("")) != "")
    low = F.transform(names, F.lower)
    once = F.filter(names, lambda n, i: F.array_position(low, F.lower(n)) == i + 1)
    role = F.try_element_at(roles, F.lower(F.trim("type")))
    return event.where(role.isNotNull()).select("event_key", role.alias("role"), F.explode(once).alias("name"))


def people(event: DataFrame, fields: Sequence[str], base_url: str, clean: bool = False) -> DataFrame:
    """Every person with role, event count and page links; the first spelling is shown."""
    rows = event_people(event, fields, clean).withColumn("name_key", F.lower("name"))
    out = rows.groupBy("role", "name_key").agg(F.count("*").alias("event_count"), F.min_by("name", "event_key").alias("name"))
    key = slug(F.col("name"))

    def page(ext: str) -> Column:
        return F.when(key != "", F.concat(F.lit(f"{base_url}people/"), key, F.lit(ext))).otherwise("")

    return out.select(key.alias("slug"), "name", "role", "event_count", page(".html").alias("page_url"), page(".ics").alias("ics_url"))


def category_counts(event: DataFrame) -> DataFrame:
    kind = F.coalesce("type", F.lit("other"))
    return event.groupBy(kind.alias("slug")).agg(F.count("*").alias("count")).withColumn("label", labelled(F.col("slug"), LABELS_API))


def dominant_category(event: DataFrame, by: str = "venue") -> DataFrame:
    """Most frequent category per venue; ties go to the largest name."""
    counts = event.groupBy(by, F.coalesce("type", F.lit("other")).alias("type")).agg(F.count("*").alias("n"))
    return counts.groupBy(by).agg(F.max_by("type", F.struct("n", "type")).alias("dominant"))


def venue_averages(event: DataFrame) -> DataFrame:
    return event.where(F.col("rating") > 0).groupBy("venue").agg(F.avg("rating").alias("venue_average"))


def derived_rating(event: DataFrame) -> DataFrame:
    """Own positive rating, else the venue's average rounded half up, else 5."""
    out = event.join(venue_averages(event), "venue", "left")
    own = F.when(F.col("rating") > 0, F.col("rating"))
    rounded = F.floor(F.col("venue_average") + 0.5).cast("int")
    return out.withColumn("derived_rating", F.coalesce(own, rounded, F.lit(5)))


def featured_composer(event: DataFrame, screening: DataFrame, fields: Sequence[str], today) -> DataFrame:
    """The composer with the most upcoming concerts; ties go to the one billed most prominently."""
    coming = upcoming(screening, today).select("event_key").distinct()
    concerts = event.where(F.lower(F.trim("type")) == "concert").join(coming, "event_key", "left_semi")
    names = event_people(concerts, fields, clean=False)
    from showbill.values import NAME_BLOCKLIST

    names = names.where(~F.lower("name").isin(list(NAME_BLOCKLIST))).withColumn("name_key", F.lower("name"))
    billed = names.join(concerts.select("event_key", "title", "program"), "event_key")
    score = F.when(F.lower("title").contains(F.col("name_key")), 2).otherwise(0) + F.when(
        F.lower(F.coalesce("program", F.lit(""))).contains(F.col("name_key")), 1).otherwise(0)
    totals = billed.groupBy("name_key").agg(
        F.count("*").alias("events"), F.sum(score).alias("score"), F.min_by("name", "event_key").alias("name"))
    best = F.max(F.struct("events", "score", (-F.length("name_key")).alias("shortness"), "name")).alias("best")
    return totals.agg(best).where(F.col("best").isNotNull()).select("best.name", "best.events", "best.score")


def coverage(event: DataFrame, first: DataFrame, categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """Every category with count, venues, first and last day and first title, also when empty."""
    rows = event.join(first, "event_key", "left")
    stats = rows.groupBy("type").agg(
        F.count("*").alias("events"), F.count_distinct("venue").alias("venues"),
        F.min(F.nullif("first_date", F.lit(""))).alias("first_date"), F.max("first_date").alias("last_date"),
        F.min_by("title", "event_key").alias("example"))
    names = event.sparkSession.createDataFrame([(c,) for c in categories], "type string")
    return names.join(stats, "type", "left").fillna(0, ["events", "venues"])


def suggest(event: DataFrame, query: str, limit: int = SUGGEST_LIMIT) -> DataFrame:
    """Venues and category labels that contain the query, in order, a limited number of each."""
    q = query.strip().lower()
    found = event.select(F.lit("venue").alias("kind"), F.col("venue").alias("value")).unionByName(
        event.select(F.lit("category").alias("kind"), reader_label(F.col("type")).alias("value")))
    hits = found.where((F.coalesce("value", F.lit("")) != "") & F.lower("value").contains(q)).distinct()
    w = Window.partitionBy("kind").orderBy("value")
    return hits.withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit)


def merge_prospects(prospect: DataFrame) -> DataFrame:
    """One row per (name, category): the longest description, the first link, the first spelling."""
    rows = prospect.withColumns({
        "name_key": F.lower(F.trim("name")), "category_key": F.lower(F.trim("category")),
        "description": F.coalesce("description", F.lit("")), "url": F.coalesce("url", F.lit("")),
    })
    # Longest first, then earliest: the order key sorts by missing length and position.
    longest = F.min_by("description", F.struct((-F.length("description")).alias("l"), F.col("ord").alias("o")))
    return rows.groupBy("name_key", "category_key").agg(
        F.min_by("name", "ord").alias("name"), F.min_by("category", "ord").alias("category"), longest.alias("description"),
        F.coalesce(F.min_by("url", F.when(F.col("url") != "", F.col("ord"))), F.lit("")).alias("url"),
        F.count("*").alias("mentions"))


def person_pages(event: DataFrame, fields: Sequence[str], min_events: int = 2, sharing_rows: int = 1_000_000) -> DataFrame:
    """People with enough events, each with a page name no one else has.

    The first of a shared slug keeps it; the others get their role and a number. Where no
    slug is shared by more than ``sharing_rows`` people, each is numbered by one task.
    """
    rows = event_people(event, fields, clean=True).withColumn("name_key", F.lower("name"))
    totals = rows.groupBy("role", "name_key").agg(F.count("*").alias("total_events"), F.min_by("name", "event_key").alias("name"))
    pages = totals.where(F.col("total_events") >= min_events).withColumn(
        "slug", F.coalesce(F.nullif(slug(F.col("name")), F.lit("")), F.concat("role", F.lit("-unknown"))))
    # Only slugs that several people share need numbers, and few do.
    pages = written(pages, "person-pages")
    sharing = pages.groupBy("slug").agg(F.min("role").alias("_lead_role"), F.count("*").alias("_sharing"))
    shared = written(sharing.where("_sharing > 1"), "shared-slugs")
    fields = ["role", "name", "slug", "page", "total_events"]
    alone = pages.join(shared, "slug", "left_anti").withColumn("page", F.col("slug")).select(*fields)
    if shared.isEmpty():
        return alone
    rows = pages.join(shared, "slug")
    if shared.agg(F.max("_sharing")).first()[0] <= sharing_rows:
        at = F.row_number().over(Window.partitionBy("slug", "role").orderBy("name_key"))
        numbered = rows.withColumn("position", at)
    else:
        numbered = position_in_group(rows, ["slug", "role"], "name_key")
    number = F.col("position") + F.when(F.col("role") == F.col("_lead_role"), 0).otherwise(1)
    return alone.unionByName(numbered.withColumn(
        "page", F.when(number == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", "role", number.cast("string")))).select(*fields))


def reader_groups(event: DataFrame, screening: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events merged by title across categories, their distinct showings).

    The first event gives the fields; low confidence of any of them sticks; showings are
    distinct on date and time, that of the first event kept.
    """
    named = event.withColumn("group_title", F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled")))
    fields = [c for c in event.columns if c not in ("event_key", "title", "review_confidence")]
    groups = named.groupBy("group_title").agg(
        F.min_by(F.struct("event_key", "title", *fields), "event_key").alias("_row"),
        F.bool_or(F.lower(F.coalesce("review_confidence", F.lit("unknown"))) == "low").alias("_low"),
        F.min_by(F.lower(F.coalesce("review_confidence", F.lit("unknown"))), "event_key").alias("_confidence"),
    ).select("group_title", "_row.*", F.when(F.col("_low"), "low").otherwise(F.col("_confidence")).alias("review_confidence"))
    shows = screening.select("event_key", "ord", "date", "time", F.col("venue").alias("show_venue"), F.col("url").alias("show_url")).join(
        named.select("event_key", "group_title"), "event_key").withColumn("_at", F.struct("event_key", "ord"))
    once = first_row(shows, ["group_title", "date", "time"], ["ord", "show_venue", "show_url"], ord="_at")
    return groups, once

