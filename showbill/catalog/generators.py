"""Recurrence, weeks, unions and distinct sets."""

from pyspark.sql import functions as F

from showbill.catalog.base import EVENT, SCREENING, TODAY, WEEKDAYS, query, with_
from showbill.operators import generators as GE
from showbill.operators import ranking as R
from showbill.sources import tables as T

WEEKDAY_CASE = "CASE s_suppkey % 8 " + " ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(WEEKDAYS)) + " ELSE 'someday' END"


def rules(spark, sf):
    """One weekly rule per venue."""
    return T.table(spark, sf, "supplier").select(
        F.col("s_name").alias("title"), F.expr(WEEKDAY_CASE.replace("s_suppkey", "s_suppkey")).alias("day_of_week"),
        F.when(F.col("s_suppkey") % 2 == 0, "7:00 PM").otherwise("10:30 AM").alias("time"), "s_suppkey")


def _weekly_sql(passed: str, title: str) -> str:
    return f"""
  SELECT {title} AS title, strftime(DATE '{TODAY}' + CAST((k + 7) % 7 + CASE WHEN k = 0 AND {passed} THEN 7 ELSE 0 END + 7 * w AS INTEGER), '%Y-%m-%d') AS date,
    CAST(w AS INTEGER) AS week
  FROM (SELECT s_name, s_suppkey, s_suppkey % 8 AS k, unnest(range(0, 8)) AS w FROM supplier WHERE s_suppkey % 8 < 7)"""


@query("g01_weekly_own_time", _weekly_sql("s_suppkey % 2 = 1", "s_name"))
def g01(spark, sf):
    return GE.weekly(rules(spark, sf), f"{TODAY} 12:00:00").select("title", "date", "week")


@query("g01_weekly_cutoff", _weekly_sql("TRUE", "concat(s_name, ' - ', CASE WHEN w = 0 THEN 'This Week''s Story' ELSE concat('Week ', w + 1) END)"))
def g01_cutoff(spark, sf):
    return GE.weekly(rules(spark, sf), f"{TODAY} 21:00:00", cutoff="21:00", numbered=True).select("title", "date", "week")


WEEKS = f"""
weeks AS (SELECT DISTINCT strftime(d, '%G-W%V') AS label, strftime(d - dow, '%Y-%m-%d') AS monday FROM screening
          WHERE d BETWEEN DATE '{TODAY}' + 3 AND DATE '{TODAY}' + 3 + 56)"""


@query("g04_upcoming_weeks", with_(SCREENING, WEEKS) + " SELECT * FROM weeks")
def g04(spark, sf):
    return R.upcoming_weeks(T.showings(spark, sf), "1998-06-18", 8).select("label", F.col("monday").cast("string").alias("monday"))


@query("g05_all_digests", with_(SCREENING, EVENT, WEEKS) + """
  , shown AS (SELECT strftime(d, '%G-W%V') AS label, event_key, min(concat(date, ' ', time)) AS first_show, count(*) AS n_showings FROM screening GROUP BY ALL)
  SELECT label, event_key, title, rating, first_show[1:10] AS first_date, n_showings,
    CAST(row_number() OVER (PARTITION BY label ORDER BY COALESCE(rating, -1) DESC, first_show, event_key) AS INTEGER) AS position
  FROM shown JOIN weeks USING (label) JOIN event USING (event_key) QUALIFY position <= 20""")
def g05(spark, sf):
    out = R.all_digests(T.showings(spark, sf), T.event(spark, sf), "1998-06-18", 8)
    return out.select("label", "event_key", "title", "rating", F.col("first.date").alias("first_date"), "n_showings", "position")


@query("u01_union_sources", with_(SCREENING) + """
  SELECT ord, title, CASE WHEN event_key % 3 = 0 THEN rating END AS rating, CASE WHEN event_key % 3 = 1 THEN venue END AS hall,
    CASE WHEN event_key % 3 = 2 THEN url END AS url FROM screening""")
def u01(spark, sf):
    s = T.screening(spark, sf)
    return GE.union_sources(s.where("event_key % 3 = 0").select("ord", "title", "rating"),
                            s.where("event_key % 3 = 1").select(F.col("venue").alias("hall"), "title", "ord"),
                            s.where("event_key % 3 = 2").select("url", "ord", "title"))


@query("u04_distinct_values", with_(SCREENING) + """
  SELECT 'time' AS field, time AS value FROM screening GROUP BY time UNION ALL SELECT 'type', type FROM screening GROUP BY type""")
def u04(spark, sf):
    s = T.screening(spark, sf)
    parts = [GE.distinct_values(s, c).select(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("time", "type")]
    return parts[0].unionByName(parts[1])


@query("s16_ingest_rows", with_(SCREENING) + """
  SELECT ord, source, venue, source_venue FROM (
    SELECT ord, rating, n, 'alpha' AS source, 'alpha' AS venue, NULL AS source_venue FROM screening WHERE event_key % 3 > 0
    UNION ALL SELECT ord, rating, n, 'beta', CASE WHEN n = 1 THEN 'beta' ELSE venue END, 'beta' FROM screening WHERE event_key % 3 = 0)
  WHERE rating IS NOT NULL AND n <> 7""")
def s16(spark, sf):
    return ingested(spark, sf)[0].select("ord", "source", "venue", "source_venue")


@query("s16_rejects", with_(SCREENING) + """
  SELECT ord, CASE WHEN event_key % 3 > 0 THEN 'alpha' ELSE 'beta' END AS source, CASE WHEN rating IS NULL THEN 'no rating' ELSE 'late line' END AS reason
  FROM screening WHERE rating IS NULL OR n = 7""")
def s16_rejects(spark, sf):
    return ingested(spark, sf)[1].select("ord", "source", "reason")


@query("s16_source_log", with_(SCREENING) + """
  SELECT source, count(ord) FILTER (WHERE rating IS NOT NULL AND n <> 7) AS kept, count(ord) FILTER (WHERE rating IS NULL OR n = 7) AS rejected, kept = 0 AS empty
  FROM (VALUES ('alpha'), ('beta'), ('gamma')) v(source) LEFT JOIN (
    SELECT *, CASE WHEN event_key % 3 > 0 THEN 'alpha' ELSE 'beta' END AS source FROM screening) USING (source) GROUP BY source""")
def s16_log(spark, sf):
    return ingested(spark, sf)[2]


def ingested(spark, sf):
    s = T.screening(spark, sf)
    sources = {
        "alpha": s.where("event_key % 3 > 0").drop("url"),
        "beta": s.where("event_key % 3 = 0").withColumn("venue", F.when(F.col("n") == 1, " ").otherwise(F.col("venue"))),
        "gamma": s.where("type = 'ballet'"),
    }
    return GE.ingest(sources, [("no rating", F.col("rating").isNull()), ("late line", F.col("n") == 7)], preserve=["beta"])
