"""Rollups by venue, person, category and title."""

from pyspark.sql import functions as F

from showbill.catalog.base import EVENT, EVENT_PERSON, PERSON, SCREENING, TODAY, query, with_
from showbill.catalog.ranking import FIRST
from showbill.operators import grouping as G
from showbill.operators import rollups as RU
from showbill.sources import tables as T
from showbill.values import LABELS_API

BASE = "https://example.org/"


def label_case(col, labels):
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.items()) + f" ELSE {col} END"


@query("a04_venues", with_(SCREENING, EVENT) + """
  , e AS (SELECT *, CASE WHEN event_key % 3 = 0 THEN '' ELSE concat(venue, ' Hall ', event_key % 2) END AS display FROM event)
  SELECT replace(lower(venue), '#', '-') AS slug, venue AS name,
    COALESCE(arg_min(display, event_key) FILTER (WHERE display <> ''), venue) AS display_name, '' AS address,
    count(*) AS event_count, array_to_string(list_sort(list(DISTINCT type)), ',') AS categories,
    concat('https://example.org/venues/', replace(lower(venue), '#', '-'), '.html') AS page_url
  FROM e GROUP BY venue""")
def a04(spark, sf):
    rows = T.event(spark, sf).withColumns({
        "venue_display_name": F.when(F.col("event_key") % 3 == 0, " ").otherwise(
            F.concat("venue", F.lit(" Hall "), (F.col("event_key") % 2).cast("string"))),
        "venue_address": F.lit("")})
    out = RU.venues(rows, BASE)
    return out.withColumn("categories", F.array_join("categories", ","))


#: A second person field: the same name in capitals, another name, or nothing.
def people_rows(spark, sf):
    rows = T.event(spark, sf, person=True)
    k = F.col("event_key") % 3
    return rows.withColumn("person2", F.when(k == 0, F.upper("person")).when(k == 1, F.concat(F.lit("The "), "person")).otherwise(""))


PEOPLE = """
roles AS (SELECT *, CASE type WHEN 'movie' THEN 'director' WHEN 'concert' THEN 'composer' WHEN 'opera' THEN 'composer'
            WHEN 'book_club' THEN 'author' END AS role FROM event_person),
named AS (SELECT event_key, title, role, person AS name FROM roles WHERE role IS NOT NULL
  UNION ALL SELECT event_key, title, role, concat('The ', person) FROM roles WHERE role IS NOT NULL AND event_key % 3 = 1)"""


@query("a05_people", with_(SCREENING, PERSON, EVENT_PERSON, PEOPLE) + """
  SELECT regexp_replace(lower(arg_min(name, event_key)), '[^a-z0-9]+', '-', 'g') AS slug, arg_min(name, event_key) AS name, role,
    count(*) AS event_count, concat('https://example.org/people/', slug, '.html') AS page_url,
    concat('https://example.org/people/', slug, '.ics') AS ics_url
  FROM named GROUP BY role, lower(name)""")
def a05(spark, sf):
    return RU.people(people_rows(spark, sf), ["person", "person2"], BASE)


@query("a06_category_counts", with_(SCREENING, EVENT) + f"""
  SELECT type AS slug, count(*) AS count, {label_case('type', LABELS_API)} AS label FROM event GROUP BY type""")
def a06(spark, sf):
    return RU.category_counts(T.event(spark, sf))


@query("a07_dominant_category", with_(SCREENING, EVENT) + """
  , c AS (SELECT venue, type, count(*) AS n FROM event GROUP BY ALL)
  SELECT venue, type AS dominant FROM c QUALIFY row_number() OVER (PARTITION BY venue ORDER BY n DESC, type DESC) = 1""")
def a07(spark, sf):
    return RU.dominant_category(T.event(spark, sf))


@query("a08_derived_rating", with_(SCREENING, EVENT) + """
  , v AS (SELECT venue, avg(rating) AS a FROM event WHERE rating > 0 GROUP BY venue)
  SELECT event_key, CAST(CASE WHEN rating > 0 THEN rating ELSE COALESCE(floor(a + 0.5), 5) END AS INTEGER) AS derived_rating
  FROM event LEFT JOIN v USING (venue)""")
def a08(spark, sf):
    return RU.derived_rating(T.event(spark, sf)).select("event_key", "derived_rating")


@query("a09_featured_composer", with_(SCREENING, PERSON, EVENT_PERSON) + f"""
  , c AS (SELECT * FROM event_person WHERE type = 'concert' AND event_key IN (SELECT event_key FROM screening WHERE d >= DATE '{TODAY}')),
  named AS (SELECT event_key, person AS name FROM c UNION ALL SELECT event_key, concat('The ', person) FROM c WHERE event_key % 3 = 1),
  t AS (SELECT lower(name) AS k, count(*) AS events,
      CAST(sum(CASE WHEN event_key % 5 = 0 AND name LIKE 'Customer%' THEN 2 ELSE 0 END + CASE WHEN event_key % 2 = 0 AND name LIKE 'Customer%' THEN 1 ELSE 0 END) AS BIGINT) AS score,
      arg_min(name, event_key) AS name FROM named GROUP BY 1)
  SELECT name, events, score FROM t ORDER BY events DESC, score DESC, len(k), name DESC LIMIT 1""")
def a09(spark, sf):
    rows = people_rows(spark, sf).withColumns({
        "title": F.when(F.col("event_key") % 5 == 0, F.concat("title", F.lit(" with "), "person")).otherwise(F.col("title")),
        "program": F.when(F.col("event_key") % 2 == 0, F.concat(F.lit("Works by "), F.upper("person")))})
    return RU.featured_composer(rows, T.showings(spark, sf), ["person", "person2"], TODAY)


@query("a10_coverage", with_(SCREENING, EVENT, FIRST) + """
  , k(type) AS (VALUES ('movie'), ('concert'), ('book_club'), ('opera'), ('dance'), ('visual_arts'), ('other'), ('ballet'))
  SELECT type, count(event_key) AS events, count(DISTINCT venue) AS venues, min(first_date) AS first_date, max(first_date) AS last_date,
    arg_min(title, event_key) AS example FROM k LEFT JOIN (event JOIN first_occ USING (event_key)) USING (type) GROUP BY type""")
def a10(spark, sf):
    from showbill.values import CATEGORIES

    first = G.first_occurrence(T.showings(spark, sf))
    return RU.coverage(T.event(spark, sf), first, (*CATEGORIES, "ballet"))


@query("a16_suggest", with_(SCREENING, EVENT) + """
  , f AS (SELECT DISTINCT 'venue' AS kind, venue AS value FROM event WHERE contains(lower(venue), 'er')
    UNION SELECT DISTINCT 'category', CASE type WHEN 'opera' THEN 'Opera' WHEN 'concert' THEN 'Concert' ELSE 'Other' END FROM event WHERE type IN ('opera', 'other', 'concert'))
  SELECT kind, value, CAST(row_number() OVER (PARTITION BY kind ORDER BY value) AS INTEGER) AS position FROM f QUALIFY position <= 20""")
def a16(spark, sf):
    return RU.suggest(T.event(spark, sf), "ER", 20)


@query("a17_merge_prospects", with_(SCREENING) + """
  , p AS (SELECT ord, CASE WHEN n % 2 = 0 THEN upper(venue) ELSE venue END AS name, type AS category,
      repeat('x', CAST(order_key % 7 AS INTEGER)) AS description, CASE WHEN n = 3 THEN url ELSE '' END AS url FROM screening)
  SELECT lower(venue_name) AS name_key, category AS category_key, arg_min(name, ord) AS name, category, max(description) AS description,
    COALESCE(arg_min(url, ord) FILTER (WHERE url <> ''), '') AS url, count(*) AS mentions
  FROM (SELECT *, lower(name) AS venue_name FROM p) GROUP BY venue_name, category""")
def a17(spark, sf):
    rows = T.screening(spark, sf).select(
        "ord", F.when(F.col("n") % 2 == 0, F.upper("venue")).otherwise(F.col("venue")).alias("name"), F.col("type").alias("category"),
        F.expr("repeat('x', CAST(order_key % 7 AS INT))").alias("description"), F.when(F.col("n") == 3, F.col("url")).alias("url"))
    return RU.merge_prospects(rows)


@query("a18_person_pages", with_(SCREENING, PERSON, EVENT_PERSON) + """
  , roles AS (SELECT event_key, CASE type WHEN 'movie' THEN 'director' WHEN 'concert' THEN 'composer' WHEN 'opera' THEN 'composer'
       WHEN 'book_club' THEN 'author' END AS role, concat('Person ', CAST(right(person, 9) AS BIGINT) % 20,
         CASE event_key % 3 WHEN 0 THEN '' WHEN 1 THEN '!' ELSE '?' END) AS name FROM event_person),
  t AS (SELECT role, lower(name) AS k, count(*) AS total_events, arg_min(name, event_key) AS name FROM roles WHERE role IS NOT NULL GROUP BY ALL HAVING count(*) >= 2),
  s AS (SELECT *, trim(regexp_replace(k, '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM t),
  r AS (SELECT *, row_number() OVER (PARTITION BY slug, role ORDER BY k) AS rn, min(role) OVER (PARTITION BY slug) AS lead FROM s)
  SELECT role, name, slug, total_events, CASE WHEN rn = 1 AND role = lead THEN slug
     ELSE concat(slug, '-', role, '-', CASE WHEN role = lead THEN rn ELSE rn + 1 END) END AS page FROM r""")
def a18(spark, sf):
    rows = T.event(spark, sf, person=True).withColumn("person", F.expr(
        "concat('Person ', CAST(right(person, 9) AS BIGINT) % 20, CASE event_key % 3 WHEN 0 THEN '' WHEN 1 THEN '!' ELSE '?' END)"))
    return RU.person_pages(rows, ["person"])


@query("a19_reader_groups", with_(SCREENING, EVENT) + """
  , e AS (SELECT *, CASE WHEN event_key % 7 = 0 THEN 'Low' WHEN event_key % 2 = 0 THEN 'high' END AS conf FROM event)
  SELECT title AS group_title, min(event_key) AS event_key, arg_min(type, event_key) AS type, arg_min(venue, event_key) AS venue,
    CASE WHEN bool_or(COALESCE(conf, '') = 'Low') THEN 'low' ELSE arg_min(COALESCE(conf, 'unknown'), event_key) END AS review_confidence
  FROM e GROUP BY title""")
def a19(spark, sf):
    conf = F.when(F.col("event_key") % 7 == 0, "Low").when(F.col("event_key") % 2 == 0, "high")
    groups, _ = RU.reader_groups(T.event(spark, sf).withColumn("review_confidence", conf), T.screening(spark, sf))
    return groups.select("group_title", "event_key", "type", "venue", "review_confidence")


@query("a19_reader_showings", with_(SCREENING, EVENT) + """
  SELECT title AS group_title, date, time, venue AS show_venue, url AS show_url FROM screening
  QUALIFY row_number() OVER (PARTITION BY title, date, time ORDER BY event_key, ord) = 1""")
def a19_showings(spark, sf):
    rows = T.event(spark, sf).withColumn("review_confidence", F.lit("high"))
    _, shows = RU.reader_groups(rows, T.screening(spark, sf))
    return shows.select("group_title", "date", "time", "show_venue", "show_url")
