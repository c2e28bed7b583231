"""Published shapes: envelopes, documents, calendars, feeds, metadata, manifests."""

from pyspark.sql import functions as F

from showbill.catalog.base import EVENT, MONTH_SHORT, SCREENING, TODAY, WEEKDAY_SHORT, query, with_
from showbill.catalog.joins import VENUE, venue_tables
from showbill.catalog.ranking import FEED, FIRST, TEXT_RANK, feed
from showbill.functions.text import slug
from showbill.operators import grouping as G
from showbill.operators import joins as J
from showbill.operators import publish as PB
from showbill.operators import ranking as R
from showbill.operators import rollups as RU
from showbill.sources import sinks as SK
from showbill.sources import tables as T
from showbill.values import LABELS_API

BASE = "https://example.org/"
EID = "translate(lower(title), ' ''\":,', '-')"


def events_with_id(spark, sf):
    return T.event(spark, sf).withColumn("id", slug(F.col("title"), "event_id"))


@query("k01_envelope", with_(SCREENING, EVENT) + """
  SELECT 'top-picks' AS dataset, '2024-01-15T00:00:00Z' AS generated_at, 'https://example.org/' AS site_url, count(*) AS count FROM event WHERE rating >= 7
  UNION ALL SELECT 'events', '2024-01-15T00:00:00Z', 'https://example.org/', count(*) FROM event
  UNION ALL SELECT 'categories', '2024-01-15T00:00:00Z', 'https://example.org/', count(DISTINCT type) FROM event""")
def k01(spark, sf):
    events = T.event(spark, sf)
    sets = {"top-picks": events.where("rating >= 7"), "events": events, "categories": RU.category_counts(events)}
    out = None
    for name, df in sets.items():
        part = SK.envelope_header(df, "2024-01-15T00:00:00Z", BASE).withColumn("dataset", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("k01_json_lines", with_(SCREENING, EVENT) + """
  SELECT concat('{"event_key":', event_key, ',"title":"', title, '","venue":"', venue, '"', CASE WHEN rating IS NULL THEN '' ELSE concat(',"rating":', rating) END, '}') AS value FROM event""")
def k01_lines(spark, sf):
    return SK.json_lines(T.event(spark, sf).select("event_key", "title", "venue", "rating"))


@query("k02_documents_by_slug", with_(SCREENING, EVENT) + """
  , s AS (SELECT *, CASE WHEN type = 'other' THEN '' ELSE replace(title, ' ', '-') END AS slug FROM event)
  SELECT slug, event_key, title, venue FROM s WHERE slug <> '' QUALIFY row_number() OVER (PARTITION BY slug ORDER BY event_key) = 1""")
def k02(spark, sf):
    rows = T.event(spark, sf).withColumn("slug", F.when(F.col("type") == "other", "").otherwise(slug(F.col("title"))))
    return SK.documents_by_slug(rows.select("slug", "event_key", "title", "venue"))


CALENDAR = f"""
cal AS (
  SELECT ord, event_key, {EID} AS event_id, title, type, rating, venue, url, date, CASE WHEN n = 5 THEN '' WHEN n = 6 THEN 'TBD' ELSE time END AS clock,
    CASE WHEN event_key % 2 = 0 THEN 'A hook; yes, this' ELSE '' END AS hook FROM screening),
rows_ AS (
  SELECT ord, event_key, event_id, concat(event_id, '-', date, '-', replace(clock, ':', ''), '@showbill.local') AS uid,
    CAST(CAST(concat(date, ' ', clock) AS TIMESTAMP) AT TIME ZONE 'America/Chicago' AT TIME ZONE 'UTC' AS TIMESTAMP) AS start_utc,
    concat(CASE WHEN rating IS NULL THEN '' ELSE concat('[', rating, '/10] ') END, title) AS summary,
    concat_ws(chr(10) || chr(10), CASE WHEN rating IS NOT NULL THEN concat('Rating: ', rating, '/10') END, nullif(hook, ''), concat('Details: ', url)) AS details,
    CASE type WHEN 'movie' THEN 'Movie,Film' WHEN 'concert' THEN 'Concert,Music' WHEN 'opera' THEN 'Opera,Music' WHEN 'book_club' THEN 'Book Club,Literature'
      WHEN 'visual_arts' THEN 'Visual Arts,Exhibition' ELSE 'Event' END AS tags, rating, venue, url
  FROM cal WHERE clock NOT IN ('', 'TBD'))"""


def calendar(spark, sf):
    n = F.col("n")
    rows = T.screening(spark, sf).withColumns({
        "event_id": slug(F.col("title"), "event_id"),
        "time": F.when(n == 5, "").when(n == 6, "TBD").otherwise(F.col("time")),
        "hook": F.when(F.col("event_key") % 2 == 0, "A hook; yes, this").otherwise("")})
    return PB.calendar_rows(rows)


@query("k03_calendar_rows", with_(SCREENING, CALENDAR) + """
  SELECT ord, uid, start_utc, start_utc + INTERVAL 2 HOUR AS end_utc, summary, details, tags FROM rows_""")
def k03(spark, sf):
    return calendar(spark, sf).select("ord", "uid", "start_utc", "end_utc", "summary", "details", "tags")


@query("k03_top_picks_text", with_(SCREENING, CALENDAR) + """
  , f AS (SELECT uid, unnest(['BEGIN:VEVENT', concat('UID:', uid), 'DTSTAMP:20240115T000000Z', strftime(start_utc, 'DTSTART:%Y%m%dT%H%M%SZ'), strftime(start_utc + INTERVAL 2 HOUR, 'DTEND:%Y%m%dT%H%M%SZ'),
    concat('SUMMARY:', summary), concat('DESCRIPTION:', replace(replace(replace(details, ';', '\\;'), ',', '\\,'), chr(10), '\\n')), concat('LOCATION:', venue), concat('URL:', url),
    concat('CATEGORIES:', tags), 'END:VEVENT']) AS line, generate_subscripts(range(11), 1) AS pos, ord FROM rows_ WHERE rating >= 7),
  g AS (SELECT *, regexp_replace(regexp_replace(line, '(.{74})', '\\1' || chr(13) || chr(10) || ' ', 'g'), '\\r\\n $', '') AS cut FROM f)
  SELECT uid, string_agg(cut, chr(13) || chr(10) ORDER BY pos) AS value FROM g GROUP BY uid, ord""")
def k03_text(spark, sf):
    return PB.calendar_text(PB.top_calendar(calendar(spark, sf)), "20240115T000000Z").select("uid", "value")


@query("k03_event_calendars", with_(SCREENING, CALENDAR) + """
  SELECT event_id, event_key, count(*) AS entries FROM rows_ JOIN (SELECT event_id, min(event_key) AS event_key FROM rows_ GROUP BY event_id) USING (event_id, event_key) GROUP BY event_id, event_key""")
def k03_events(spark, sf):
    return PB.first_events(calendar(spark, sf)).groupBy("event_id", "event_key").agg(F.count("*").alias("entries"))


@query("k03_person_calendars", with_(SCREENING, """
pers AS (SELECT s.*, c_name AS person FROM screening s JOIN orders ON order_key = o_orderkey JOIN customer ON o_custkey = c_custkey)""") + f"""
  SELECT person, concat({EID}, '-', date, '-', replace(time, ':', ''), '@showbill.local') AS uid, count(*) AS showings FROM pers
  WHERE type IN ('movie', 'concert', 'opera', 'book_club') GROUP BY ALL""")
def k03_person(spark, sf):
    from showbill.values import ROLE_OF_TYPE

    rows = T.screening(spark, sf, person=True).where(F.col("type").isin(list(ROLE_OF_TYPE))).withColumns({
        "event_id": slug(F.col("title"), "event_id"), "hook": F.lit("")})
    return PB.calendar_rows(rows).groupBy("person", "uid").agg(F.count("*").alias("showings"))


@query("k04_feed_items", with_(SCREENING, EVENT, FIRST, FEED, f"""
items AS (SELECT *, CAST(first_date AS DATE) AS d, CAST(isodow(CAST(first_date AS DATE)) - 1 AS INTEGER) AS dow,
  concat('https://example.org/events/', replace(title, ' ', '-'), '.html') AS link FROM feed)""") + f"""
  SELECT position, event_key, title, link, concat({WEEKDAY_SHORT}, ', ', strftime(d, '%d'), ' ', {MONTH_SHORT}, ' ', year(d), ' 00:00:00 +0000') AS published,
    concat_ws(chr(10), CASE WHEN rating IS NOT NULL THEN concat('<p><strong>Rating: ', rating, '/10</strong></p>') END,
      concat('<p><strong>Venue:</strong> ', venue, '</p>'), concat('<p><a href="', link, '">Open</a></p>'),
      concat('<p><a href="', url, '">Official page</a></p>')) AS body FROM items""")
def k04(spark, sf):
    ranked = feed(spark, sf).withColumn("id", slug(F.col("title"), "event_id"))
    return PB.feed_items(ranked, BASE, TODAY)


@query("k05_text_blocks", with_(SCREENING, EVENT, FIRST, TEXT_RANK) + """
  SELECT position, concat_ws(chr(10), concat(position, '. ', CASE WHEN rating IS NULL THEN '' ELSE concat('[', rating, '/10] ') END, title),
    concat(venue, ' | ', first_date, ' | ', first_time),
    CASE WHEN text IS NULL THEN NULL WHEN len(flat) <= 800 THEN concat('Review: ', flat) ELSE concat('Review: ', rtrim(flat[1:799]), '…') END,
    concat('URL: https://example.org/events/', replace(title, ' ', '-'), '.html')) AS block
  FROM (SELECT t.*, d.text, trim(regexp_replace(d.text, '\\s+', ' ', 'g')) AS flat FROM text_rank t LEFT JOIN documents d ON doc_id = event_key)""")
def k05(spark, sf):
    first = G.first_occurrence(T.showings(spark, sf))
    docs = T.table(spark, sf, "documents").select(F.col("doc_id").alias("event_key"), F.col("text").alias("description"))
    ranked = R.text_rank(events_with_id(spark, sf), first).join(docs, "event_key", "left")
    return PB.text_blocks(ranked, BASE)


def label_case(col, labels):
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.items()) + f" ELSE {col} END"


@query("k05_statistics", with_(SCREENING, EVENT) + f"""
  SELECT CAST(1 AS INTEGER) AS part, '' AS name, concat('Total events: ', count(*)) AS line FROM event
  UNION ALL SELECT 2, type, concat('- ', {label_case('type', LABELS_API)}, ': ', count(*)) FROM event GROUP BY type
  UNION ALL SELECT 3, venue, concat('- ', venue, ': ', count(*)) FROM event GROUP BY venue""")
def k05_stats(spark, sf):
    return PB.statistics_lines(T.event(spark, sf))


@query("k06_jsonld", with_(SCREENING, EVENT, VENUE, FIRST) + """
  SELECT event_key, replace(title, ' ', '-') AS slug,
    concat('{"@context":"https://schema.org","@type":"Event","name":"', title, '","description":"',
      CASE WHEN event_key % 3 = 0 THEN 'A hook.' WHEN event_key % 3 = 1 THEN concat('About ', venue) ELSE title END,
      '","url":"https://example.org/events/', replace(title, ' ', '-'), '.html","startDate":"', first_date,
      '","location":{"@type":"Place","name":"', venue_display_name, '","address":{"@type":"PostalAddress","addressLocality":"Austin","addressRegion":"TX"',
      CASE WHEN venue_address = '' THEN '' ELSE concat(',"streetAddress":"', split_part(venue_address, ', ', 1), '","postalCode":"', right(venue_address, 5), '"') END,
      '}},"offers":{"@type":"Offer","url":"', CASE WHEN event_key % 2 = 0 THEN url ELSE concat('https://example.org/#event=', replace(title, ' ', '-')) END,
      '","availability":"https://schema.org/InStock"}', CASE WHEN rating IS NULL THEN '' ELSE
        concat(',"aggregateRating":{"@type":"AggregateRating","ratingValue":', rating, ',"bestRating":10,"worstRating":0,"ratingCount":1}') END, '}') AS json
  FROM event_venue JOIN first_occ USING (event_key)""")
def k06(spark, sf):
    first = G.first_occurrence(T.showings(spark, sf))
    rows = J.attach_venue(events_with_id(spark, sf), *venue_tables(spark, sf)).join(first, "event_key")
    k = F.col("event_key")
    rows = rows.withColumns({
        "hook": F.when(k % 3 == 0, "<b>A</b> hook.").otherwise(""),
        "description": F.when(k % 3 == 1, F.concat(F.lit("<p>About </p>"), "venue")).otherwise(""),
        "first_url": F.lit(""), "url": F.when(k % 2 == 0, F.col("url")).otherwise(" ")})
    return PB.jsonld(rows, BASE, "Austin", "TX")


@query("k08_manifest_diff", with_(SCREENING, EVENT) + """
  , a AS (SELECT CASE WHEN event_key % 2 = 0 THEN concat('events/', event_key) ELSE concat('static/', event_key) END AS path, event_key FROM event)
  SELECT path, CASE WHEN path LIKE 'events/%' THEN 'pruned' ELSE 'lost' END AS state FROM a WHERE event_key % 5 = 0
  UNION ALL SELECT concat('new/', event_key), 'extra' FROM event WHERE event_key % 7 = 0""")
def k08(spark, sf):
    k = F.col("event_key")
    events = T.event(spark, sf)
    path = F.concat(F.when(k % 2 == 0, "events/").otherwise("static/"), k.cast("string")).alias("path")
    before = events.select(path)
    after = events.where(k % 5 != 0).select(path).unionByName(
        events.where(k % 7 == 0).select(F.concat(F.lit("new/"), k.cast("string")).alias("path")))
    return SK.manifest_diff(before, after, F.col("path").startswith("events/"))


@query("k08_feed_problems", with_(SCREENING) + """
  SELECT 'ballet' AS feed, CAST(1 AS BIGINT) AS at_least, CAST(NULL AS BIGINT) AS entries, 'missing' AS problem
  UNION ALL SELECT 'movie', 1000000000000, (SELECT count(*) FROM screening WHERE type = 'movie'), 'too few entries'""")
def k08_feeds(spark, sf):
    counts = T.screening(spark, sf).groupBy(F.col("type").alias("feed")).agg(F.count("*").alias("entries"))
    return SK.feed_problems(counts, {"ballet": 1, "movie": 1_000_000_000_000, "opera": 0})
