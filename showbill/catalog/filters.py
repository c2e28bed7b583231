"""Filters, windows, search and gates."""

from pyspark.sql import functions as F

from showbill.catalog.base import EVENT, EVENT_PERSON, PERSON, SCREENING, TODAY, query, with_
from showbill.catalog.ranking import SIGNAL
from showbill.functions.text import slug
from showbill.operators import filters as FL
from showbill.operators import grouping as G
from showbill.operators import postings as PO
from showbill.operators import ranking as R
from showbill.operators.publish import valid_events
from showbill.sources import signals
from showbill.sources import tables as T
from showbill.streaming.jobs import work_folder


@query("f01_valid_events", with_(SCREENING, EVENT) + """
  SELECT event_key, title FROM event WHERE event_key % 4 NOT IN (0, 1)""")
def f01(spark, sf):
    k = F.col("event_key") % 4
    rows = T.event(spark, sf).select(
        "event_key", F.when(k == 0, "").otherwise(F.col("title")).alias("title"),
        F.when(k == 1, None).otherwise(slug(F.col("title"), "event_id")).alias("id"))
    return valid_events(rows).select("event_key", "title")


@query("f03_upcoming", with_(SCREENING) + f" SELECT ord, event_key, date, time FROM screening WHERE d >= DATE '{TODAY}'")
def f03(spark, sf):
    return G.upcoming(T.showings(spark, sf), TODAY).select("ord", "event_key", "date", "time")


@query("f04_windows", with_(SCREENING) + f"""
  SELECT 'today' AS view, ord FROM screening WHERE date = '{TODAY}'
  UNION ALL SELECT 'week', ord FROM screening WHERE date >= '{TODAY}' AND date < '1998-06-22'
  UNION ALL SELECT 'weekend', ord FROM screening WHERE date IN ('1998-06-19', '1998-06-20', '1998-06-21')
  UNION ALL SELECT 'sunday', ord FROM screening WHERE date BETWEEN '1998-06-12' AND '1998-06-14'""")
def f04(spark, sf):
    shows = T.showings(spark, sf)
    parts = [FL.in_window(shows, v, TODAY).select(F.lit(v).alias("view"), "ord") for v in ("today", "week", "weekend")]
    parts.append(FL.in_window(shows, "weekend", "1998-06-14").select(F.lit("sunday").alias("view"), "ord"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


QUERIES = {
    "today": "d = DATE '1998-06-15'", "tomorrow": "d = DATE '1998-06-16'", "1998-6-20": "d = DATE '1998-06-20'",
    "6/14": "month(d) = 6 AND day(d) = 14", "07/04/1998": "d = DATE '1998-07-04'", "07/04/98": "d = DATE '2098-07-04'", "jun 14": "month(d) = 6 AND day(d) = 14",
    "14 June 1999": "d = DATE '1999-06-14'", "sept.": "month(d) = 9", "February 30": "FALSE",
}


@query("f05_date_query", with_(SCREENING) + " SELECT q, ord FROM (" + " UNION ALL ".join(
    f"SELECT '{q}' AS q, ord FROM screening WHERE {w}" for q, w in QUERIES.items()) + ")")
def f05(spark, sf):
    shows = T.showings(spark, sf)
    out = None
    for q in QUERIES:
        part = FL.on_date(shows, q, TODAY).select(F.lit(q).alias("q"), "ord")
        out = part if out is None else out.unionByName(part)
    return out


@query("f06_search_text", with_(SCREENING, EVENT) + """
  SELECT event_key, title FROM event WHERE contains(lower(title), 'bolt') OR contains(lower(venue), 'bolt')""")
def f06(spark, sf):
    return FL.search(T.event(spark, sf), T.showings(spark, sf), " Bolt ", TODAY).select("event_key", "title")


SEARCHED = ("bolt", " B ", "er", "book club", "t 1", "no such text")


@query("f06_search_postings", with_(SCREENING, EVENT) + f"""
  , q AS (SELECT unnest({list(SEARCHED)}) AS q)
  SELECT q, event_key FROM event, q WHERE contains(lower(title), lower(trim(q))) OR contains(lower(venue), lower(trim(q))) OR contains(type, lower(trim(q)))
    OR contains(CASE type WHEN 'movie' THEN 'film' ELSE replace(type, '_', ' ') END, lower(trim(q)))""")
def f06_postings(spark, sf):
    root = work_folder(spark)
    PO.write_postings(T.event(spark, sf), root, shard_rows=2000)
    parts = [PO.matching_events(spark, root, q).select(F.lit(q).alias("q"), "event_key") for q in SEARCHED]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("f06_search_label_or_date", with_(SCREENING, EVENT) + """
  SELECT event_key, 'book club' AS q FROM event WHERE type = 'book_club'
  UNION ALL SELECT event_key, 'june 15' FROM event WHERE event_key IN (SELECT event_key FROM screening WHERE month(d) = 6 AND day(d) = 15)""")
def f06_label(spark, sf):
    events, shows = T.event(spark, sf), T.showings(spark, sf)
    parts = [FL.search(events, shows, q, TODAY).select("event_key", F.lit(q).alias("q")) for q in ("book club", "june 15")]
    return parts[0].unionByName(parts[1])


@query("f07_filter_events", with_(SCREENING, EVENT, SIGNAL) + """
  SELECT event_key, title FROM event
  WHERE contains(lower(title), 'n') AND type = 'movie'
    AND event_key % 100 IN (SELECT k FROM weight_k WHERE weight > 0)
    AND event_key IN (SELECT event_key FROM screening WHERE date >= '1998-06-15' AND date < '1998-06-22')""")
def f07(spark, sf):
    liked = R.reader_weights(signals.taste_signals(spark, sf)).where("weight > 0").select("k").distinct()
    keys = T.table(spark, sf, "part").select(F.col("p_partkey").alias("event_key"))
    saved = keys.join(liked, F.col("event_key") % 100 == F.col("k"), "left_semi")
    return FL.filter_events(T.event(spark, sf), T.showings(spark, sf), TODAY, "n", saved, "movie", "week").select("event_key", "title")


# F08 ---------------------------------------------------------------------------------------
@query("f08_accept_fields", with_(SCREENING, PERSON, EVENT_PERSON) + """
  SELECT event_key, 'director' AS field, event_key % 4 IN (0, 2) AS accepted FROM event_person
  UNION ALL SELECT event_key, 'country', FALSE FROM event_person""")
def f08(spark, sf):
    rows = T.event(spark, sf, person=True)
    context = rows.select("event_key", F.concat_ws("\n", F.concat(F.lit("Title: "), "title"), F.concat(
        F.lit("By:  "), F.replace("person", F.lit("#"), F.lit("  no\n")))).alias("context"))
    k = F.col("event_key") % 4
    director = rows.select(
        "event_key", F.lit("director").alias("field"),
        F.when(k == 0, F.replace("person", F.lit("#"), F.lit(" no "))).when(k == 1, "Nobody Known").otherwise(F.col("person")).alias("value"),
        F.when(k >= 2, "citation").otherwise("substring").alias("evidence"),
        F.when(k == 2, F.array(F.lit("https://example.org"))).otherwise(F.array().cast("array<string>")).alias("citations"))
    country = rows.select(
        "event_key", F.lit("country").alias("field"), F.when(k == 1, "").otherwise(F.lit("Peru")).alias("value"),
        F.when(k == 2, "guess").otherwise("substring").alias("evidence"), F.lit(None).cast("array<string>").alias("citations"))
    return FL.accept_fields(director.unionByName(country), context).select("event_key", "field", "accepted")


RAW_SUPPORT = "CASE n WHEN 1 THEN '' WHEN 2 THEN 'puppetry' WHEN 3 THEN 'screening' ELSE type END"


@query("f09_supported", with_(SCREENING) + """
  , r AS (SELECT ord, CASE n WHEN 1 THEN '' WHEN 2 THEN 'puppetry' WHEN 3 THEN 'screening' ELSE type END AS kind, supp_key % 4 = 0 AS film FROM screening)
  SELECT ord, CASE WHEN kind = '' AND film THEN 'movie' WHEN kind IN ('', 'puppetry') THEN NULL ELSE kind END AS type,
    CASE WHEN kind = '' AND NOT film THEN 'untyped' WHEN kind = 'puppetry' THEN 'unsupported type' END AS reason FROM r""")
def f09(spark, sf):
    rows = T.screening(spark, sf).withColumn("type", F.expr(RAW_SUPPORT))
    kept, rejects = FL.supported(rows, F.col("supp_key") % 4 == 0)
    none = F.lit(None).cast("string")
    return kept.select("ord", "type", none.alias("reason")).unionByName(rejects.select("ord", none.alias("type"), "reason"))


@query("f10_sparse_policy", with_(SCREENING) + """
  , r AS (SELECT ord, venue, title, (order_key + event_key) % 10 < supp_key % 5 AS sparse FROM screening),
  s AS (SELECT *, avg(CAST(sparse AS INTEGER)) OVER (PARTITION BY venue) AS share FROM r)
  SELECT ord, CASE WHEN sparse THEN concat(title, ' at ', venue, ' — see venue for details') ELSE 'A film.' END AS description
  FROM s WHERE NOT sparse OR share > 0.2""")
def f10(spark, sf):
    sparse = (F.col("order_key") + F.col("event_key")) % 10 < F.col("supp_key") % 5
    none = F.lit(None).cast("int")
    rows = T.screening(spark, sf).select(
        "ord", "venue", "title", F.when(sparse, " ").otherwise("A film.").alias("description"), none.alias("runtime_minutes"),
        none.alias("release_year"), F.lit("").alias("director"), F.lit("").alias("one_liner_summary"))
    return FL.sparse_policy(rows, "venue").select("ord", "description")


@query("f14_allowed_titles", with_(SCREENING, EVENT) + """
  SELECT event_key, title FROM event WHERE title IN (SELECT concat(p_name, ' ', p_partkey % 500) FROM part WHERE p_brand = 'Brand#2')""")
def f14(spark, sf):
    wanted = T.table(spark, sf, "part").where("p_brand = 'Brand#2'").select(
        F.concat("p_name", F.lit(" "), (F.col("p_partkey") % 500).cast("string")).alias("title"))
    return FL.allowed_titles(T.event(spark, sf), wanted).select("event_key", "title")


@query("f15_useful", with_(SCREENING) + """
  SELECT ord, n % 3 <> 0 AND n % 4 <> 1 AS good FROM screening""")
def f15(spark, sf):
    rows = T.screening(spark, sf).select(
        "ord", F.when(F.col("n") % 3 == 0, " ").otherwise(F.col("title")).alias("a"),
        F.when(F.col("n") % 4 == 1, None).otherwise(F.col("date")).alias("b"), F.lit("").alias("c"))
    return rows.select("ord", FL.useful(["a", "b"], ["c"]).alias("good"))
