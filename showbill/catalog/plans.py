"""Whole questions: the reader's page, publishing, rating, refresh, and write-and-read round trips."""

from pyspark.sql import functions as F

from showbill.catalog.base import EVENT, LISTING, SCREENING, TODAY, query, with_
from showbill.catalog.joins import CACHE, RULE_CASE, RULES, published as published_reviews, season_pair, venue_tables
from showbill.catalog.ranking import BIAS, SIGNAL, weighted
from showbill.functions.text import slug
from showbill.plans import publish as PP
from showbill.plans import rating as PR
from showbill.plans import reader as RD
from showbill.plans import refresh as RF
from showbill.sources import season as SE
from showbill.sources import sinks as SK
from showbill.sources import tables as T
from showbill.streaming.jobs import work_folder

GROUPS = f"""
conf AS (SELECT *, CASE WHEN event_key % 7 = 0 THEN 'low' ELSE 'high' END AS review_confidence FROM event),
g AS (SELECT title, min(event_key) AS event_key, arg_min(type, event_key) AS type, arg_min(venue, event_key) AS venue,
   arg_min_null(rating, event_key) AS rating, bool_or(review_confidence = 'low') AS low FROM conf GROUP BY title),
sh AS (SELECT title, min(concat(date, ' ', time)) AS first, count(DISTINCT concat(date, ' ', time)) AS n_showings FROM screening WHERE event_key IN (SELECT event_key FROM conf) GROUP BY title),
va AS (SELECT venue, avg(rating) AS a FROM g WHERE rating > 0 GROUP BY venue),
groups AS (SELECT g.*, first[1:10] AS first_date, n_showings,
  CAST(CASE WHEN type = 'movie' THEN CASE WHEN rating > 0 THEN rating ELSE COALESCE(floor(a + 0.5), 5) END END AS INTEGER) AS derived_rating
  FROM g JOIN sh USING (title) LEFT JOIN va USING (venue))"""


def groups(spark, sf):
    conf = F.when(F.col("event_key") % 7 == 0, "low").otherwise("high")
    events = T.event(spark, sf).withColumn("review_confidence", conf)
    return RD.reader_groups(events, T.screening(spark, sf), TODAY)


@query("reader_groups", with_(SCREENING, EVENT, GROUPS) + """
  SELECT event_key, title, type, venue, rating, derived_rating, first_date, n_showings, CASE WHEN low THEN 'low' ELSE 'high' END AS review_confidence FROM groups""")
def reader_groups(spark, sf):
    return groups(spark, sf).select("event_key", "title", "type", "venue", "rating", "derived_rating", "first_date", "n_showings", "review_confidence")


@query("reader_listings", with_(SCREENING, EVENT, GROUPS) + f"""
  SELECT event_key, title, 'listing' AS list FROM groups WHERE NOT low AND first_date >= '1995-01-20'
  UNION ALL SELECT event_key, title, 'research' FROM groups WHERE low""")
def reader_listings(spark, sf):
    listed, research = RD.split_view(groups(spark, sf), "1995-01-20")
    return listed.select("event_key", "title", F.lit("listing").alias("list")).unionByName(
        research.select("event_key", "title", F.lit("research").alias("list")))


@query("reader_picks", with_(SCREENING, EVENT, GROUPS, SIGNAL, BIAS) + """
  , scored AS (
    SELECT event_key, e.title, rating, greatest(-2, least(2, (COALESCE(cb.bias, 0) + COALESCE(vb.bias, 0)) * 0.5)) AS boost,
      CASE WHEN boost > 0 THEN COALESCE(CASE WHEN vb.bias > 0 AND vl.title <> e.title THEN vl.title END, CASE WHEN cb.bias > 0 AND cl.title <> e.title THEN cl.title END) END AS reason
    FROM groups e LEFT JOIN cat_bias cb ON cb.cat = lower(e.type) LEFT JOIN ven_bias vb ON vb.ven = lower(e.venue)
    LEFT JOIN cat_lead cl ON cl.cat = lower(e.type) LEFT JOIN ven_lead vl ON vl.ven = lower(e.venue)
    WHERE NOT low AND first_date >= '1995-01-20' AND first_date < '1995-01-27')
  SELECT event_key, title, CAST(COALESCE(rating, 0) + boost AS DOUBLE) AS score, reason,
    CAST(row_number() OVER (ORDER BY COALESCE(rating, 0) + boost DESC, COALESCE(rating, 0) DESC, title, event_key) AS INTEGER) AS position
  FROM scored QUALIFY position <= 10""")
def reader_picks(spark, sf):
    listed, _ = RD.split_view(groups(spark, sf), "1995-01-20")
    out = RD.reader_picks(listed, weighted(spark, sf), "1995-01-20")
    return out.select("event_key", "title", F.col("score").cast("double").alias("score"), "reason", "position")


PUBLISH = """
pub AS (SELECT *, CASE WHEN type = 'movie' THEN title ELSE concat(title, ' - ', array_to_string(dates, ','), ' ',
     CASE WHEN len(times) = 0 THEN 'TBD' ELSE array_to_string(times, ',') END) END AS group_key FROM listing WHERE len(dates) > 0),
ev AS (SELECT group_key, title, type, venue, url, ord FROM pub QUALIFY row_number() OVER (PARTITION BY group_key ORDER BY CASE WHEN type = 'movie' THEN ord END, ord DESC) = 1),
sh AS (SELECT group_key, dates[i] AS date, COALESCE(times[i], times[1], 'TBD') AS time FROM (SELECT p.*, unnest(range(1, len(dates) + 1)) AS i FROM pub p
    WHERE type = 'movie' OR ord IN (SELECT ord FROM ev)))"""


@query("publish_events", with_(SCREENING, LISTING, PUBLISH) + """
  , meta AS (SELECT s_name AS venue, concat(s_name, ' of ', n_name) AS display_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 10 NOT IN (0, 1))
  SELECT group_key, title, type, venue, url, translate(lower(title), ' ''":,', '-') AS id, COALESCE(display_name, venue) AS venue_display_name,
    array_to_string(list_sort(list(DISTINCT date)), ',') AS dates, count(*) AS n_showings, concat('A bright night: ', title) AS description
  FROM ev JOIN sh USING (group_key) LEFT JOIN meta USING (venue) GROUP BY ALL""")
def publish_events(spark, sf):
    rows = T.listing(spark, sf).withColumn("description", F.concat(F.lit("A luminous night: "), "title"))
    events, _ = PP.published(rows, *venue_tables(spark, sf), ["title", "type", "venue", "url", "description"], ["description"])
    return events.select("group_key", "title", "type", "venue", "url", "id", "venue_display_name",
                         F.array_join("dates", ",").alias("dates"), "n_showings", "description")


@query("publish_showings", with_(SCREENING, LISTING, PUBLISH) + " SELECT * FROM sh")
def publish_showings(spark, sf):
    return PP.group_listings(T.listing(spark, sf), ["title", "type"])[1].select("group_key", "date", "time")


@query("rating_flow", with_(SCREENING, EVENT, CACHE) + f"""
  , e AS (SELECT *, {RULE_CASE} AS rule_no, event_key % 13 = 0 AS recurring FROM event),
  r AS (SELECT e.*, CASE WHEN rule_no IS NOT NULL THEN 'override' WHEN recurring THEN 'recurring' WHEN type = 'other' THEN 'ready'
      WHEN doc_id IS NOT NULL AND NOT refused THEN 'cache' WHEN len(title) % 3 = 0 THEN 'attempt 1' WHEN len(title) % 3 = 1 THEN 'attempt 2' ELSE 'stub' END AS origin, cached_rating
    FROM e LEFT JOIN cache ON upper(title) = cache_key)
  SELECT event_key, origin, CAST(CASE origin WHEN 'override' THEN CASE rule_no WHEN 1 THEN 9 WHEN 2 THEN 8 WHEN 3 THEN 7 WHEN 4 THEN 2 WHEN 5 THEN 6 END
     WHEN 'recurring' THEN 7 WHEN 'cache' THEN cached_rating WHEN 'attempt 1' THEN 8 WHEN 'attempt 2' THEN 3 WHEN 'stub' THEN 5 END AS INTEGER) AS score,
    CASE WHEN origin LIKE 'attempt%' THEN 'high' END AS review_confidence FROM r""")
def rating_flow(spark, sf):
    def strict(prompts):
        return prompts.map(lambda p: "★ Rating: [7.6/10] Fine." if len(p) % 3 == 0 else
                           "I cannot provide a review, the search results do not contain information.")

    def permissive(prompts):
        return prompts.map(lambda p: "[3/10] Thin." if len(p) % 3 == 1 else "")

    events = T.event(spark, sf).withColumns({
        "description": F.concat(F.lit("About "), "title"), "is_recurring": F.col("event_key") % 13 == 0})
    from showbill.operators.joins import rating_cache

    out = PR.rate(events, RULES, rating_cache(published_reviews(spark, sf)), [strict, permissive], F.col("title"))
    return out.select("event_key", "origin", "score", "review_confidence")


@query("refresh_problems", with_(SCREENING, LISTING) + """
  SELECT split_part(p, ':', 1) AS kind, count(*) AS n FROM (
    SELECT CASE WHEN trim(title) = '' OR len(dates) = 0 OR len(dates) <> len(times) THEN 'rejected' END AS p FROM listing WHERE event_key % 7 <> 6
    UNION ALL SELECT 'invalid' FROM listing WHERE event_key % 7 = 2 AND len(dates) > 0
    UNION ALL SELECT 'invalid' FROM listing WHERE event_key % 7 <> 6 AND trim(title) <> '' AND len(dates) > 0 AND len(dates) = len(times)
      AND type NOT IN ('concert', 'opera', 'dance'))
  WHERE p IS NOT NULL GROUP BY 1""")
def refresh_problems(spark, sf):
    old, _ = season_pair(spark, sf)
    none = F.lit(None).cast("array<string>")
    incoming = T.listing(spark, sf).where("damage <> 6").select(
        "ord", "title", "dates", "times", F.col("venue").alias("venue_name"), F.lit("").alias("venue"), none.alias("composers"),
        none.alias("works"), F.lit("x").alias("program"), F.lit("y").alias("series"), F.lit("").alias("featured_artist"), "type")
    _, problems = RF.check_refresh(old, incoming, "concert", None)
    kind = F.substring_index("problem", ":", 1)
    return problems.where(kind.isin("rejected", "invalid")).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


# --- round trips -----------------------------------------------------------------------------

@query("k07_publish_current", with_(SCREENING, EVENT) + " SELECT event_key, title, venue FROM event")
def k07(spark, sf):
    root = work_folder(spark)
    events = T.event(spark, sf).select("event_key", "title", "venue")
    SK.publish(events.limit(0), root, "2024-01-14")
    SK.publish(events, root, "2024-01-15")
    return SK.read_current(spark, root)


@query("k02_write_documents", with_(SCREENING, EVENT) + """
  SELECT replace(title, ' ', '-') AS slug, event_key FROM event QUALIFY row_number() OVER (PARTITION BY title ORDER BY event_key) = 1""")
def k02_written(spark, sf):
    path = work_folder(spark)
    SK.write_documents(T.event(spark, sf).select("event_key", slug(F.col("title")).alias("slug")), path, shard_rows=100)
    return spark.read.parquet(path).select("slug", "event_key")


@query("s02_load_published", with_(SCREENING, EVENT) + " SELECT CAST(event_key AS VARCHAR) AS id, title, venue, rating FROM event")
def s02(spark, sf):
    path = work_folder(spark)
    rows = T.event(spark, sf).select("event_key", F.col("event_key").cast("string").alias("id"), "title", "venue", "rating")
    SK.write_published(rows, path)
    return SE.load_published(spark, f"{path}/*").select("id", "title", "venue", "rating")


@query("k01_write_envelope", with_(SCREENING, EVENT) + " SELECT event_key, title FROM event WHERE rating >= 7")
def k01_written(spark, sf):
    path = work_folder(spark)
    SK.write_envelope(T.event(spark, sf).where("rating >= 7").select("event_key", "title"), path, "2024-01-15T00:00:00Z", "https://example.org/")
    return spark.read.schema("event_key bigint, title string").json(f"{path}/data")

