"""Listings to events: zip, flatten, group, finalize, first occurrence."""

from pyspark.sql import functions as F

from showbill.catalog.base import EVENT, LISTING, SCREENING, query, with_
from showbill.operators import grouping as G
from showbill.sources import tables as T

_ZIP = """
  SELECT ord, event_key, dates[i] AS date, CAST(i - 1 AS INTEGER) AS pos,
         {time} AS time
  FROM (SELECT *, unnest(range(1, len(dates) + 1)) AS i FROM listing)"""


@query("g02_zip_pairwise", with_(SCREENING, LISTING) + _ZIP.format(
    time="COALESCE(times[i], times[1], 'TBD')"))
def g02_pairwise(spark, sf):
    return G.zip_dates_times(T.listing(spark, sf)).select("ord", "event_key", "date", "pos", "time")


@query("g02_zip_first_time", with_(SCREENING, LISTING) + _ZIP.format(time="COALESCE(times[1], 'TBD')"))
def g02_first(spark, sf):
    return G.zip_dates_times(T.listing(spark, sf), rule="first").select("ord", "event_key", "date", "pos", "time")


@query("g02_zip_rejects", with_(SCREENING, LISTING) + " SELECT ord, event_key FROM listing WHERE len(dates) = 0")
def g02_rejects(spark, sf):
    return G.without_dates(T.listing(spark, sf)).select("ord", "event_key")


def published(spark, sf):
    """Published events in the three shapes that occur: nested, zipped, dates only."""
    shape = "array<struct<date:string,time:string,venue:string,url:string>>"
    nested = F.transform(F.arrays_zip("dates", "times"), lambda z: F.struct(
        z["dates"].alias("date"), z["times"].alias("time"), F.lit("").alias("venue"), F.lit(None).cast("string").alias("url")))
    rows = T.listing(spark, sf)
    return rows.withColumn("screenings", F.when(F.col("event_key") % 3 == 0, nested).cast(shape))


PUBLISHED = """
flat_list AS (
  SELECT ord, event_key, venue, url, date, time FROM (
    SELECT *, unnest(range(1, greatest(len(dates), CASE WHEN event_key % 3 = 0 THEN len(times) ELSE 0 END) + 1)) AS i FROM listing)
    CROSS JOIN LATERAL (SELECT dates[i] AS date,
      CASE WHEN event_key % 3 = 0 THEN times[i] WHEN len(times) = len(dates) THEN times[i] ELSE '' END AS time)
)"""


@query("g03_flatten_list", with_(SCREENING, LISTING, PUBLISHED) + " SELECT * FROM flat_list WHERE date <> ''")
def g03_list(spark, sf):
    flat = G.flatten_showings(published(spark, sf), "list")
    return flat.select("ord", "event_key", "venue", "url", "date", "time")


@query("g03_flatten_calendar", with_(SCREENING, LISTING) + """
  SELECT ord, event_key, venue, url, dates[i] AS date, times[i] AS time
  FROM (SELECT *, unnest(range(1, least(len(dates), len(times)) + 1)) AS i FROM listing)""")
def g03_calendar(spark, sf):
    flat = G.flatten_showings(published(spark, sf), "calendar")
    return flat.select("ord", "event_key", "venue", "url", "date", "time")


@query("a01_group_by_title", with_(SCREENING) + """
  , first_rows AS (SELECT * FROM screening QUALIFY row_number() OVER (PARTITION BY title ORDER BY ord) = 1)
  SELECT title, type, venue, rating, url FROM first_rows""")
def a01(spark, sf):
    return G.group_by_title(T.screening(spark, sf), ["type", "venue", "rating", "url"])


@query("a01_title_showings", with_(SCREENING) + """
  , first_rows AS (SELECT title, venue AS event_venue, event_key AS lead_key FROM screening
                   QUALIFY row_number() OVER (PARTITION BY title ORDER BY ord) = 1)
  SELECT title, event_venue, lead_key, ord, date, time FROM screening JOIN first_rows USING (title)""")
def a01_showings(spark, sf):
    shows = T.screening(spark, sf)
    events = G.group_by_title(shows, ["venue", "event_key"])
    events = events.withColumnsRenamed({"venue": "event_venue", "event_key": "lead_key"})
    return shows.join(events, "title").select("title", "event_venue", "lead_key", "ord", "date", "time")


@query("a02_unique_events", with_(SCREENING, LISTING) + """
  , keyed AS (SELECT *, concat(title, ' - ', CASE WHEN len(dates) = 0 THEN 'TBD' ELSE array_to_string(dates, ',') END, ' ',
                     CASE WHEN len(times) = 0 THEN 'TBD' ELSE array_to_string(times, ',') END) AS unique_key FROM listing)
  SELECT unique_key, ord, type, venue, url FROM keyed
  QUALIFY row_number() OVER (PARTITION BY unique_key ORDER BY ord DESC) = 1""")
def a02(spark, sf):
    return G.unique_events(T.listing(spark, sf), ["ord", "type", "venue", "url"])


@query("a03_finalize", with_(SCREENING, EVENT) + """
  SELECT event_key, title, translate(lower(title), ' ''":,', '-') AS id,
    array_to_string(list_sort(list(DISTINCT date)), ',') AS dates,
    array_to_string(list_sort(list(DISTINCT time)), ',') AS times,
    min(concat(date, ' ', time)) AS first, count(*) AS n_showings
  FROM event JOIN (SELECT event_key, date, time FROM screening) USING (event_key) GROUP BY event_key, title""")
def a03(spark, sf):
    shows = T.showings(spark, sf)
    done = G.finalize(T.event(spark, sf), shows)
    return done.select(
        "event_key", "title", "id", F.array_join("dates", ",").alias("dates"),
        F.array_join("times", ",").alias("times"),
        F.concat("first.date", F.lit(" "), "first.time").alias("first"), "n_showings",
    )


@query("w07_first_occurrence", with_(SCREENING) + """
  SELECT event_key, min(date) AS first_date, arg_min(time, ord) AS first_time FROM screening GROUP BY event_key""")
def w07(spark, sf):
    return G.first_occurrence(T.showings(spark, sf)).select("event_key", "first_date", "first_time")


@query("w09_keep_first_showing", with_(SCREENING) + """
  SELECT title, date, time, ord, venue FROM screening
  QUALIFY row_number() OVER (PARTITION BY title, date, time ORDER BY ord) = 1""")
def w09(spark, sf):
    return G.keep_first(T.screening(spark, sf).select("title", "date", "time", "ord", "venue").withColumn("pos", F.col("ord")),
                        ["title", "date", "time"], "pos").drop("pos")
