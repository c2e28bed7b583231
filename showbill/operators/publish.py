"""Published row shapes: public rows, feeds, calendar rows, structured metadata, text dump."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from showbill.functions.clock import start_local, utc_of_local
from showbill.functions.dates import as_date, let, pick
from showbill.functions.facts import nonblank
from showbill.functions.text import address_parts, html_text, labelled, slug, split_escape, truncate
from showbill.values import (
    CALENDAR_TAGS, JSONLD_HOOK, JSONLD_TEXT, LABELS_API, MONTHS_SHORT, SHOW_HOURS, TEXT_DUMP_REVIEW,
    TOP_PICK_RATING, WEEKDAYS_LONG, ZONE,
)


def present(df: DataFrame, name: str, default: str = "") -> Column:
    return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)


def public_shape(event: DataFrame, first: DataFrame, base_url: str) -> DataFrame:
    """Public row of every valid event; its showings stay a table of their own."""
    rows = event if "id" in event.columns else event.withColumn("id", slug(F.col("title"), "event_id"))
    rows = valid_events(rows).join(first, "event_key", "left")
    return rows.select(
        "event_key", "id", "title", F.coalesce(F.nullif("type", F.lit("")), F.lit("other")).alias("type"), "rating",
        present(rows, "one_liner_summary").alias("one_liner_summary"),
        html_text(present(rows, "description")).alias("description_text"),
        F.coalesce("venue", F.lit("")).alias("venue"),
        F.coalesce("first_date", F.lit("")).alias("date"), F.coalesce("first_time", F.lit("")).alias("time"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.concat(F.lit(f"{base_url}events/"), "id", F.lit(".html")).alias("shell_url"),
    )


def valid_events(event: DataFrame) -> DataFrame:
    """Events with an id and a title."""
    return event.where((F.coalesce("id", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != ""))


def week_brief(picks: DataFrame, n: int = 5) -> DataFrame:
    """Spoken brief of the first ``n`` picks, one row."""
    top = picks.where(F.col("position") <= n)
    head = F.concat(
        F.lit("Pick "), F.col("position").cast("string"), F.lit(": "), F.coalesce("title", F.lit("Untitled")),
        F.when(nonblank(F.col("venue")), F.concat(F.lit(" at "), "venue")).otherwise(""), F.lit("."),
        F.when(nonblank(F.col("hook")), F.concat(F.lit(" "), F.trim("hook"))).otherwise(""),
    )
    # At most n short lines reach the aggregate.
    lines = F.transform(F.array_sort(F.collect_list(F.struct("position", head.alias("line")))), lambda x: x["line"])
    count = F.count("*")
    intro = F.concat(F.lit("Top picks of the week. "), count.cast("string"),
                     F.when(count == 1, " event ahead.").otherwise(" events ahead."))
    return top.agg(F.array_join(F.concat(F.array(intro), lines), " ").alias("brief"))


# --- calendar --------------------------------------------------------------------------

def calendar_rows(showing: DataFrame, uid_domain: str = "showbill.local", zone: str = ZONE) -> DataFrame:
    """One calendar entry per showing with a readable date and time.

    Needs event_id, title, type, rating, hook, venue, url, date, time.
    """
    rows = showing.where((F.coalesce("date", F.lit("")) != "") & (F.coalesce("time", F.lit("")) != ""))
    # Both starts come out of a generator, so the parsing and the zone rules run once per row.
    starts = let(start_local(F.col("date"), F.col("time")), lambda at: F.struct(
        at.alias("start_local"), utc_of_local(at, zone).alias("start_utc")))
    rows = rows.select("*", F.inline_outer(F.array(starts))).where(F.col("start_local").isNotNull())
    rating = F.when(F.col("rating").isNotNull(), F.concat(F.col("rating").cast("string"), F.lit("/10")))
    stamp = F.regexp_replace("time", "[: ]", "")
    hours = F.expr(f"INTERVAL {SHOW_HOURS} HOURS")
    return rows.select(
        "*",
        F.concat_ws("-", F.coalesce(F.nullif("event_id", F.lit("")), F.lit("event")), "date",
                    F.concat(stamp, F.lit(f"@{uid_domain}"))).alias("uid"),
        (F.col("start_utc") + hours).alias("end_utc"),
        F.concat_ws(" ", F.concat(F.lit("["), rating, F.lit("]")), "title").alias("summary"),
        F.concat_ws(
            "\n\n", F.concat(F.lit("Rating: "), rating), F.nullif("hook", F.lit("")),
            F.concat(F.lit("Details: "), F.nullif("url", F.lit(""))),
        ).alias("details"),
        labelled(F.col("type"), CALENDAR_TAGS, F.lit("Event")).alias("tags"),
    )


def top_calendar(calendar: DataFrame, min_rating: int = TOP_PICK_RATING) -> DataFrame:
    return calendar.where(F.col("rating") >= min_rating)


def first_events(calendar: DataFrame, slug: str = "event_id") -> DataFrame:
    """Calendar entries for a set per slug: of events with one slug the first that has an entry counts.

    Needs event_key; an event none of whose showings is readable has no entries, so it has no
    set and keeps no other event from its slug. Blank slugs are left out.
    """
    rows = calendar.where(F.coalesce(slug, F.lit("")) != "")
    first = rows.groupBy(slug).agg(F.min("event_key").alias("event_key"))
    return rows.join(first, [slug, "event_key"], "left_semi")


def folded(line: Column) -> Column:
    """A content line as lines of at most 75 octets, further ones after a blank.

    Lines of single-octet characters are cut at 74 of them, others at 18 characters of up to
    four octets, so no character is cut in two.
    """
    plain = F.octet_length(line) == F.length(line)
    return F.when(plain, F.regexp_replace(line, r"(.{74})(?=.)", "$1\r\n ")).otherwise(F.regexp_replace(line, r"(.{18})(?=.)", "$1\r\n "))


def calendar_text(calendar: DataFrame, stamp: str) -> DataFrame:
    """The text block of every calendar entry; ``stamp`` (like 20240115T000000Z) is when it was made.

    Lines end in CR LF and are folded. Two showings of one event at one time have one uid,
    as the same showing in a calendar.
    """
    utc = "yyyyMMdd'T'HHmmss'Z'"
    lines = [
        F.lit("BEGIN:VEVENT"),
        F.concat(F.lit("UID:"), "uid"),
        F.lit(f"DTSTAMP:{stamp}"),
        F.concat(F.lit("DTSTART:"), F.date_format("start_utc", utc)),
        F.concat(F.lit("DTEND:"), F.date_format("end_utc", utc)),
        F.concat(F.lit("SUMMARY:"), split_escape(F.col("summary"))),
        F.concat(F.lit("DESCRIPTION:"), split_escape(F.col("details"))),
        F.concat(F.lit("LOCATION:"), split_escape(F.nullif("venue", F.lit("")))),
        F.concat(F.lit("URL:"), F.nullif("url", F.lit(""))),
        F.concat(F.lit("CATEGORIES:"), "tags"),
        F.lit("END:VEVENT"),
    ]
    return calendar.select("event_id", "uid", F.concat_ws("\r\n", *[folded(line) for line in lines]).alias("value"))


# --- feed ------------------------------------------------------------------------------

def feed_items(ranked: DataFrame, base_url: str, now_text: str) -> DataFrame:
    """Link, publication date and body of the ranked events."""
    rows = ranked.where(F.coalesce("title", F.lit("")) != "")
    d = F.coalesce(as_date(F.col("first_date")), F.lit(now_text).cast("date"))
    rfc = F.concat(
        pick([w[:3] for w in WEEKDAYS_LONG], F.weekday(d) + 1), F.lit(", "), F.lpad(F.day(d).cast("string"), 2, "0"),
        F.lit(" "), pick(MONTHS_SHORT, F.month(d)), F.lit(" "), F.year(d).cast("string"), F.lit(" 00:00:00 +0000"),
    )
    link = F.concat(F.lit(f"{base_url}events/"), slug(F.col("id"), "safe"), F.lit(".html"))
    hook, body = F.trim(present(rows, "hook")), present(rows, "description")
    html = F.concat_ws(
        "\n",
        F.concat(F.lit("<p><strong>Rating: "), F.col("rating").cast("string"), F.lit("/10</strong></p>")),
        F.when(hook != "", F.concat(F.lit("<p><em>"), hook, F.lit("</em></p>"))),
        F.nullif(body, F.lit("")),
        F.when(nonblank(F.col("venue")), F.concat(F.lit("<p><strong>Venue:</strong> "), "venue", F.lit("</p>"))),
        F.concat(F.lit('<p><a href="'), link, F.lit('">Open</a></p>')),
        F.when(nonblank(F.col("url")) & (F.col("url") != link), F.concat(F.lit('<p><a href="'), "url", F.lit('">Official page</a></p>'))),
    )
    return rows.select("position", "event_key", "title", link.alias("link"), rfc.alias("published"), html.alias("body"))


# --- text dump ---------------------------------------------------------------------------

def text_blocks(ranked: DataFrame, base_url: str) -> DataFrame:
    """The numbered block of every ranked event."""
    meta = F.concat_ws(" | ", F.nullif("venue", F.lit("")), F.nullif("first_date", F.lit("")), F.nullif("first_time", F.lit("")))
    review = truncate(html_text(present(ranked, "description")), TEXT_DUMP_REVIEW)
    hook = F.trim(present(ranked, "hook"))
    prefix = F.when(F.col("rating").isNotNull(), F.concat(F.lit("["), F.col("rating").cast("string"), F.lit("/10] "))).otherwise("")
    lines = F.concat_ws(
        "\n",
        F.concat(F.col("position").cast("string"), F.lit(". "), prefix, F.col("title")),
        F.nullif(meta, F.lit("")),
        F.when(hook != "", F.concat(F.lit("Hook: "), hook)),
        F.when(review != "", F.concat(F.lit("Review: "), review)),
        F.concat(F.lit(f"URL: {base_url}"), F.when(nonblank(F.col("id")), F.concat(F.lit("events/"), "id", F.lit(".html"))).otherwise("")),
    )
    return ranked.select("position", lines.alias("block"))


def statistics_lines(event: DataFrame) -> DataFrame:
    """Total, per category and per venue counts as ordered text lines."""
    kinds = event.groupBy(F.coalesce("type", F.lit("other")).alias("name")).agg(F.count("*").alias("n"))
    venues = event.where(F.coalesce("venue", F.lit("")) != "").groupBy(F.col("venue").alias("name")).agg(F.count("*").alias("n"))
    total = event.agg(F.count("*").alias("n"))
    return (
        total.select(F.lit(1).alias("part"), F.lit("").alias("name"), F.concat(F.lit("Total events: "), F.col("n").cast("string")).alias("line"))
        .unionByName(kinds.select(F.lit(2).alias("part"), "name", F.concat(
            F.lit("- "), labelled(F.col("name"), LABELS_API), F.lit(": "), F.col("n").cast("string")).alias("line")))
        .unionByName(venues.select(F.lit(3).alias("part"), "name", F.concat(
            F.lit("- "), "name", F.lit(": "), F.col("n").cast("string")).alias("line")))
    )


# --- structured metadata -------------------------------------------------------------------

def jsonld(event: DataFrame, base_url: str, locality: str = "", region: str = "") -> DataFrame:
    """Structured metadata of every event as JSON; absent parts are left out.

    Needs event_key, id, title, rating, hook, description, venue, venue_display_name,
    venue_address, first_date, first_url, url. ``locality`` and ``region`` stand in when
    the address has none.
    """
    key = slug(F.coalesce(F.nullif("id", F.lit("")), "title"), "safe")
    anchor = F.concat(F.lit(f"{base_url}#event="), key)
    page = F.concat(F.lit(f"{base_url}events/"), key, F.lit(".html"))
    hook = truncate(html_text(F.col("hook"), "spaced"), JSONLD_HOOK)
    body = truncate(html_text(F.col("description"), "spaced"), JSONLD_TEXT)
    text = F.coalesce(F.nullif(hook, F.lit("")), F.nullif(body, F.lit("")), F.col("title"))
    offer = F.coalesce(F.nullif(F.trim("first_url"), F.lit("")), F.nullif(F.trim("url"), F.lit("")), anchor)

    def blank(col: Column) -> Column:
        return F.nullif(col, F.lit(""))

    def place(a: Column) -> Column:
        address = F.struct(
            F.lit("PostalAddress").alias("@type"),
            F.coalesce(blank(a["locality"]), F.nullif(F.lit(locality), F.lit(""))).alias("addressLocality"),
            F.coalesce(blank(a["region"]), F.nullif(F.lit(region), F.lit(""))).alias("addressRegion"),
            blank(a["street"]).alias("streetAddress"),
            blank(a["postal"]).alias("postalCode"),
        )
        name = F.coalesce(blank(F.col("venue_display_name")), F.col("venue"))
        return F.struct(F.lit("Place").alias("@type"), name.alias("name"), address.alias("address"))

    payload = F.struct(
        F.lit("https://schema.org").alias("@context"), F.lit("Event").alias("@type"),
        F.col("title").alias("name"), text.alias("description"), page.alias("url"),
        blank(F.col("first_date")).alias("startDate"),
        F.when(nonblank(F.col("venue")), let(address_parts(F.col("venue_address")), place)).alias("location"),
        F.struct(F.lit("Offer").alias("@type"), offer.alias("url"),
                 F.lit("https://schema.org/InStock").alias("availability")).alias("offers"),
        F.when(F.col("rating").isNotNull(), F.struct(
            F.lit("AggregateRating").alias("@type"), F.col("rating").alias("ratingValue"),
            F.lit(10).alias("bestRating"), F.lit(0).alias("worstRating"), F.lit(1).alias("ratingCount"),
        )).alias("aggregateRating"),
    )
    json = F.replace(F.to_json(payload), F.lit("</"), F.lit("<\\/"))
    return event.where(nonblank(F.coalesce(F.nullif("id", F.lit("")), "title"))).select(
        "event_key", key.alias("slug"), json.alias("json"))
