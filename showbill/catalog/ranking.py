"""Ranking, top-k, digests and taste."""

from pyspark.sql import functions as F

from showbill.catalog.base import (
    EVENT, EVENT_PERSON, PERSON, SCREENING, TODAY, query, with_,
)
from showbill.operators import grouping as G
from showbill.operators import ranking as R
from showbill.plans.digest import weekly_digest
from showbill.sources import signals
from showbill.sources import tables as T

FIRST = """
first_occ AS (
  SELECT event_key, min(date) AS first_date, arg_min(time, ord) AS first_time,
         min(concat(date, ' ', time)) AS first_show
  FROM screening GROUP BY event_key)"""

WEEK = "1998-W25"
DIGEST = """
week_rows AS (SELECT * FROM screening WHERE d BETWEEN DATE '1998-06-15' AND DATE '1998-06-21'),
week_events AS (SELECT event_key, min(concat(date, ' ', time)) AS first_show, count(*) AS n_showings
                FROM week_rows GROUP BY event_key),
digest AS (
  SELECT event_key, title, type, venue, rating, url, first_show[1:10] AS first_date, first_show[12:16] AS first_time,
         n_showings,
         CAST(row_number() OVER (ORDER BY COALESCE(rating, -1) DESC, first_show, event_key) AS INTEGER) AS position
  FROM event JOIN week_events USING (event_key) QUALIFY position <= 20)"""

W02 = with_(SCREENING, EVENT, DIGEST) + " SELECT * FROM digest"


@query("w02_digest", W02)
def w02(spark, sf):
    return weekly_digest(spark, sf, WEEK)


@query("w02_digest_showings", with_(SCREENING, EVENT, DIGEST) + """
  SELECT position, event_key, w.date, w.time, w.venue AS shown_at_venue, w.url AS showing_url
  FROM week_rows w JOIN digest USING (event_key)""")
def w02_showings(spark, sf):
    rows = R.digest_showings(weekly_digest(spark, sf, WEEK), T.screening(spark, sf), WEEK)
    return rows.select("position", "event_key", "date", "time", "shown_at_venue", "showing_url")


@query("w01_top_picks", with_(SCREENING, EVENT, FIRST) + """
  SELECT event_key, title, rating, first_date FROM event JOIN first_occ USING (event_key) WHERE rating >= 7""")
def w01(spark, sf):
    first = G.first_occurrence(T.showings(spark, sf))
    return R.top_picks(T.event(spark, sf), first).select("event_key", "title", "rating", "first_date")


FEED = f"""
feed AS (
  SELECT event_key, title, type, venue, rating, url, first_date,
    CAST(CASE WHEN CAST(first_date AS DATE) >= DATE '{TODAY}' THEN 0 ELSE 1 END AS INTEGER) AS bucket,
    CAST(row_number() OVER (ORDER BY bucket, rating DESC NULLS LAST,
         abs(date_diff('day', DATE '{TODAY}', CAST(first_date AS DATE))), event_key) AS INTEGER) AS position
  FROM event JOIN first_occ USING (event_key) QUALIFY position <= 30)"""


def feed(spark, sf, limit=30):
    first = G.first_occurrence(T.showings(spark, sf))
    return R.feed_rank(T.event(spark, sf), first, TODAY, limit)


@query("w03_feed_rank", with_(SCREENING, EVENT, FIRST, FEED) + """
  SELECT position, event_key, title, rating, first_date, bucket FROM feed""")
def w03(spark, sf):
    return feed(spark, sf).select("position", "event_key", "title", "rating", "first_date", "bucket")


TEXT_RANK = """
text_rank AS (
  SELECT event_key, title, venue, rating, url, first_date, first_time,
    CAST(row_number() OVER (ORDER BY COALESCE(rating, -1) DESC, first_date, title, event_key) AS INTEGER) AS position
  FROM event JOIN first_occ USING (event_key) QUALIFY position <= 30)"""


@query("w04_text_rank", with_(SCREENING, EVENT, FIRST, TEXT_RANK) + """
  SELECT position, event_key, title, rating, first_date FROM text_rank""")
def w04(spark, sf):
    first = G.first_occurrence(T.showings(spark, sf))
    return R.text_rank(T.event(spark, sf), first).select("position", "event_key", "title", "rating", "first_date")


def _next(source, by):
    return f"""
  , nxt AS (SELECT event_key, min(concat(date, ' ', time)) AS nx FROM screening WHERE d >= DATE '{TODAY}' GROUP BY event_key)
  SELECT {by}, event_key, title, nx[1:10] AS next_date, nx[12:16] AS next_time,
    CAST(row_number() OVER (PARTITION BY {by} ORDER BY nx, lower(title), event_key) AS INTEGER) AS position
  FROM {source} JOIN nxt USING (event_key) QUALIFY position <= 40"""


@query("w05_next_per_venue", with_(SCREENING, EVENT) + _next("event", "venue"))
def w05_venue(spark, sf):
    rows = R.next_per_group(T.event(spark, sf), T.showings(spark, sf), "venue", TODAY)
    return rows.select("venue", "event_key", "title", "next_date", "next_time", "position")


@query("w05_next_per_person", with_(SCREENING, PERSON, EVENT_PERSON) + _next("event_person", "person"))
def w05_person(spark, sf):
    rows = R.next_per_group(T.event(spark, sf, person=True), T.showings(spark, sf), "person", TODAY)
    return rows.select("person", "event_key", "title", "next_date", "next_time", "position")


# --- taste ---------------------------------------------------------------------------

#: The reader the taste queries are run for.
READER_ID = 14

SIGNAL = f"""
sig AS (
  SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, ts, event_id, event_type
  FROM events WHERE event_type IN ('click', 'error', 'purchase')),
weight_k AS (
  SELECT user_id, k, COALESCE(list_reduce(list_prepend(0,
      list(CASE event_type WHEN 'click' THEN 1 ELSE -1 END ORDER BY ts, event_id) FILTER (WHERE event_type <> 'purchase')),
      lambda s, x: CASE WHEN s = x THEN 0 ELSE x END), 0)
    + CAST(count(*) FILTER (WHERE event_type = 'purchase') % 2 AS INTEGER) AS weight FROM sig GROUP BY user_id, k),
weighted AS (
  SELECT event_key, title, type, venue, CAST(weight AS INTEGER) AS weight
  FROM event JOIN weight_k ON event_key % 100 = k WHERE weight <> 0 AND user_id = {READER_ID})"""

BIAS = """
cat_bias AS (SELECT lower(type) AS cat, sum(weight) AS bias FROM weighted GROUP BY ALL),
ven_bias AS (SELECT lower(venue) AS ven, sum(weight) AS bias FROM weighted GROUP BY ALL),
cat_lead AS (SELECT lower(type) AS cat, title, weight FROM weighted WHERE weight > 0
  QUALIFY row_number() OVER (PARTITION BY lower(type) ORDER BY weight DESC, title, event_key) = 1),
ven_lead AS (SELECT lower(venue) AS ven, title, weight FROM weighted WHERE weight > 0
  QUALIFY row_number() OVER (PARTITION BY lower(venue) ORDER BY weight DESC, title, event_key) = 1)"""


def weighted(spark, sf):
    return R.weighted_events(T.event(spark, sf), R.reader_weights(signals.taste_signals(spark, sf)), READER_ID)


@query("w06_rerank_by_taste", with_(SCREENING, EVENT, DIGEST, SIGNAL, BIAS) + """
  , scored AS (
    SELECT event_key, e.title, rating, greatest(-2, least(2, (COALESCE(cb.bias, 0) + COALESCE(vb.bias, 0)) * 0.5)) AS boost,
      CASE WHEN boost > 0 THEN COALESCE(
        CASE WHEN vb.bias > 0 AND vl.title <> e.title THEN vl.title END,
        CASE WHEN cb.bias > 0 AND cl.title <> e.title THEN cl.title END) END AS reason
    FROM event e SEMI JOIN week_events w ON e.event_key = w.event_key
    LEFT JOIN cat_bias cb ON cb.cat = lower(e.type) LEFT JOIN ven_bias vb ON vb.ven = lower(e.venue)
    LEFT JOIN cat_lead cl ON cl.cat = lower(e.type) LEFT JOIN ven_lead vl ON vl.ven = lower(e.venue))
  SELECT event_key, title, rating, CAST(COALESCE(rating, 0) + boost AS DOUBLE) AS score, reason,
    CAST(row_number() OVER (ORDER BY COALESCE(rating, 0) + boost DESC, COALESCE(rating, 0) DESC, title, event_key) AS INTEGER) AS position
  FROM scored QUALIFY position <= 10""")
def w06(spark, sf):
    from showbill.functions.dates import week_bounds

    shown = R.week_events(T.showings(spark, sf), *week_bounds(WEEK))
    picks = T.event(spark, sf).join(shown, "event_key", "left_semi")
    out = R.rerank_by_taste(picks, weighted(spark, sf))
    return out.select("event_key", "title", "rating", F.col("score").cast("double").alias("score"), "reason", "position")


@query("w10_leaders", with_(SCREENING, EVENT, SIGNAL, BIAS) + """
  SELECT 'type' AS bucket_kind, cat AS bucket, title, weight FROM cat_lead
  UNION ALL SELECT 'venue', ven, title, weight FROM ven_lead""")
def w10(spark, sf):
    rows = weighted(spark, sf)
    parts = [R.leader(rows, by).select(F.lit(by).alias("bucket_kind"), F.col(by).alias("bucket"), "title", "weight")
             for by in ("type", "venue")]
    return parts[0].unionByName(parts[1])


@query("j10_attach_taste", with_(SCREENING, EVENT, SIGNAL, BIAS) + """
  SELECT e.event_key, CAST(cb.bias AS BIGINT) AS cat_bias, CAST(vb.bias AS BIGINT) AS venue_bias,
         cl.title AS cat_leader, vl.title AS venue_leader
  FROM event e
  LEFT JOIN cat_bias cb ON cb.cat = lower(e.type) LEFT JOIN ven_bias vb ON vb.ven = lower(e.venue)
  LEFT JOIN cat_lead cl ON cl.cat = lower(e.type) LEFT JOIN ven_lead vl ON vl.ven = lower(e.venue)""")
def j10(spark, sf):
    out = R.attach_taste(T.event(spark, sf), weighted(spark, sf))
    return out.select("event_key", "cat_bias", "venue_bias", "cat_leader", "venue_leader")


@query("w06_reader_weights", with_(SIGNAL.strip().split("\nweighted AS")[0].rstrip(",")) + """
  SELECT user_id, k, CAST(weight AS INTEGER) AS weight FROM weight_k WHERE weight <> 0""")
def w06_weights(spark, sf):
    return R.reader_weights(signals.taste_signals(spark, sf))


# --- orders and sections -----------------------------------------------------------------

READER = f"""
reader AS (
  SELECT event_key, title, type, COALESCE(rating, 0) AS rating, first_date, type = 'movie' AS scored,
    CASE WHEN event_key % 5 = 0 THEN strftime(CAST(first_date AS DATE) + 400, '%Y-%m-%d') ELSE '' END AS end_date,
    CASE WHEN event_key % 5 = 0 AND first_date <= '{TODAY}' THEN end_date ELSE first_date END AS urgency
  FROM event JOIN first_occ USING (event_key))"""


def reader_rows(spark, sf):
    first = G.first_occurrence(T.showings(spark, sf))
    end = F.when(F.col("event_key") % 5 == 0, F.date_add(F.col("first_date").cast("date"), 400).cast("string")).otherwise("")
    return T.event(spark, sf).join(first, "event_key").withColumn("end_date", end)


@query("w08_reader_order", with_(SCREENING, EVENT, FIRST, READER) + """
  SELECT event_key, title, scored, rating, urgency FROM reader""")
def w08(spark, sf):
    rows = R.reader_order(reader_rows(spark, sf), TODAY)
    return rows.select("event_key", "title", "scored", F.coalesce("rating", F.lit(0)).alias("rating"), "urgency")


@query("w08_reader_head", with_(SCREENING, EVENT, FIRST, READER) + """
  SELECT event_key, title, CAST(row_number() OVER (ORDER BY scored DESC, CASE WHEN scored THEN rating END DESC NULLS LAST,
    CASE WHEN NOT scored THEN urgency END NULLS FIRST, title, event_key) AS INTEGER) AS position
  FROM reader QUALIFY position <= 50""")
def w08_head(spark, sf):
    rows = R.reader_order(reader_rows(spark, sf), TODAY)
    order = (F.col("scored").desc(), F.when(F.col("scored"), F.coalesce("rating", F.lit(0))).desc(),
             F.when(~F.col("scored"), F.col("urgency")), "title", "event_key")
    return R.numbered(rows.orderBy(*order).limit(50), *order).select("event_key", "title", "position")


@query("w11_composer_upcoming", with_(SCREENING, PERSON, EVENT_PERSON) + f"""
  , nxt AS (SELECT event_key, min(concat(date, ' ', time)) AS nx FROM screening WHERE d >= DATE '{TODAY}' GROUP BY event_key)
  SELECT person, event_key, title, nx[1:10] AS first_date, nx[12:16] AS first_time
  FROM event_person JOIN nxt USING (event_key)
  QUALIFY row_number() OVER (PARTITION BY person, title ORDER BY event_key) = 1""")
def w11(spark, sf):
    rows = R.composer_upcoming(T.event(spark, sf, person=True), T.showings(spark, sf), "person", TODAY)
    return rows.select("person", "event_key", "title", "first_date", "first_time")


@query("w13_sample_per_source", with_(SCREENING) + """
  SELECT venue, ord, CAST(row_number() OVER (PARTITION BY venue ORDER BY ord) AS INTEGER) AS sample_no
  FROM screening QUALIFY sample_no <= 3""")
def w13(spark, sf):
    return R.sample_per_source(T.screening(spark, sf), "venue").select("venue", "ord", "sample_no")


@query("w14_tipsheet", with_(SCREENING, EVENT, DIGEST) + """
  SELECT position, event_key, CASE WHEN position = 1 THEN 'featured' WHEN position <= 10 THEN 'row' ELSE 'overflow' END AS place,
    CASE WHEN n_showings > 1 THEN concat('+', n_showings - 1, ' more') ELSE '' END AS more FROM digest""")
def w14(spark, sf):
    return R.tipsheet(weekly_digest(spark, sf, WEEK)).select("position", "event_key", "place", "more")


@query("w15_category_sections", with_(SCREENING, EVENT) + """
  SELECT event_key, type, CAST(CASE type WHEN 'movie' THEN 1 WHEN 'concert' THEN 2 WHEN 'opera' THEN 3 WHEN 'dance' THEN 4
    WHEN 'ballet' THEN 5 WHEN 'book_club' THEN 6 WHEN 'visual_arts' THEN 7 WHEN 'other' THEN 8 ELSE 9 END AS BIGINT) AS section
  FROM event""")
def w15(spark, sf):
    return R.category_sections(T.event(spark, sf)).select("event_key", "type", F.col("section").cast("bigint").alias("section"))


@query("w16_agenda", with_(SCREENING, EVENT, FIRST) + """
  SELECT event_key, title, first_show[1:10] AS agenda_date, first_show[12:16] AS agenda_time
  FROM event JOIN first_occ USING (event_key)""")
def w16(spark, sf):
    first = G.first_occurrence(T.showings(spark, sf))
    return R.agenda(T.event(spark, sf), first).select("event_key", "title", "agenda_date", "agenda_time")


# --- attempts --------------------------------------------------------------------------

#: Assistant turns in order are the attempts; every third conversation's first
#: attempt is replaced by a refusal, every fifth one by blanks.
ATTEMPT = """
attempt AS (
  SELECT conv_id AS event_key, CAST(turn AS BIGINT) AS attempt_no,
    CASE WHEN turn < 2 AND conv_id % 3 = 0 THEN 'I cannot provide a review: the search results do not contain information.'
         WHEN turn < 2 AND conv_id % 5 = 0 THEN '   ' ELSE text END AS content
  FROM conversations WHERE role = 'assistant')"""


def attempts(spark, sf):
    early = F.col("turn") < 2
    content = (
        F.when(early & (F.col("conv_id") % 3 == 0),
               "I cannot provide a review: the search results do not contain information.")
        .when(early & (F.col("conv_id") % 5 == 0), "   ").otherwise(F.col("text"))
    )
    return T.table(spark, sf, "conversations").where("role = 'assistant'").select(
        F.col("conv_id").alias("event_key"), F.col("turn").alias("attempt_no"), content.alias("content"))


@query("w12_first_usable_attempt", with_(ATTEMPT) + """
  SELECT event_key, attempt_no, content FROM attempt
  WHERE trim(content) <> '' AND content NOT LIKE 'I cannot provide a review%'
  QUALIFY row_number() OVER (PARTITION BY event_key ORDER BY attempt_no) = 1""")
def w12(spark, sf):
    return R.first_usable_attempt(attempts(spark, sf))
