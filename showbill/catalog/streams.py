"""Streams over the tables' files, run to completion and read back."""

from pyspark.sql import functions as F

from showbill.catalog.base import EVENT, SCREENING, query, with_
from showbill.functions.dates import iso_week, month_range
from showbill.operators.joins import showing_key
from showbill.sources import signals as SG
from showbill.sources import tables as T
from showbill.streaming import jobs as ST
from showbill.streaming import state as KS


def event_stream(spark, sf):
    rows = T.stream(spark, sf, "events")
    return rows.withColumns({
        "at": F.col("ts").cast("timestamp"),
        "weight": F.when(F.col("event_type").isin("purchase", "click"), 1).when(F.col("event_type") == "error", -1).otherwise(0)})


@query("t01_stream_new_showings", with_(SCREENING) + """
  , k AS (SELECT *, concat(title, '_', date, '_', time, '_', lower(venue)) AS showing_key FROM screening)
  SELECT showing_key, ord, event_key FROM k WHERE title NOT LIKE 'red %' QUALIFY row_number() OVER (PARTITION BY showing_key ORDER BY ord) = 1""")
def t01(spark, sf):
    def keyed(df):
        return df.withColumn("showing_key", showing_key(F.col("title"), F.col("date"), F.col("time"), F.col("venue")))

    shows = keyed(T.screening(spark, sf, lineitem=T.stream(spark, sf, "lineitem")))
    known = keyed(T.screening(spark, sf)).where("title LIKE 'red %'")
    path = ST.new_showings(shows.select("showing_key", "ord", "event_key", "date"), known, ST.work_folder(spark))
    return spark.read.parquet(path).select("showing_key", "ord", "event_key")


def taste_log(spark, sf):
    signals = SG.as_signals(T.stream(spark, sf, "events"))
    return spark.read.parquet(ST.stream_taste(signals, ST.work_folder(spark)))


#: State after a sequence of toggles, folded row by row.
TASTE = """
sig AS (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, ts, event_id, event_type FROM events WHERE event_type IN ('click', 'error', 'purchase')),
folded AS (
  SELECT user_id, k,
    list_reduce(list_prepend(0, list(CASE event_type WHEN 'click' THEN 1 ELSE -1 END ORDER BY ts, event_id) FILTER (WHERE event_type <> 'purchase')),
      lambda s, x: CASE WHEN s = x THEN 0 ELSE x END) AS thumb,
    count(*) FILTER (WHERE event_type = 'purchase') % 2 = 1 AS saved FROM sig GROUP BY user_id, k)"""


@query("t02_taste_state", f"WITH {TASTE}" + " SELECT user_id, k, CAST(COALESCE(thumb, 0) AS INTEGER) AS thumb, saved FROM folded")
def t02(spark, sf):
    return ST.taste_state(taste_log(spark, sf))


@query("t02_taste_bias", with_(SCREENING, EVENT, TASTE) + """
  , w AS (SELECT k, sum(COALESCE(thumb, 0) + CAST(saved AS INTEGER)) AS weight FROM folded GROUP BY k)
  SELECT type, CAST(sum(weight) AS BIGINT) AS bias FROM event JOIN w ON event_key % 100 = k GROUP BY type""")
def t02_bias(spark, sf):
    return ST.taste_bias(taste_log(spark, sf), T.event(spark, sf), "type")


@query("t02_taste_keyed", f"WITH {TASTE}" + " SELECT user_id, k, CAST(COALESCE(thumb, 0) AS INTEGER) AS thumb, saved FROM folded")
def t02_keyed(spark, sf):
    signals, folder = SG.as_signals(T.stream(spark, sf, "events")), ST.work_folder(spark)
    ST.run_now(KS.stream_keyed_taste(signals).writeStream.format("noop").outputMode("update"), folder)
    return KS.taste_now(spark, f"{folder}/progress")


@query("t03_silent_sources", """
  WITH r AS (SELECT c_custkey AS user_id, TIMESTAMP '2024-01-10' AS since FROM customer WHERE c_custkey % 2 = 0),
  e AS (SELECT user_id, max(ts) AS last_seen, count(*) AS rows FROM events GROUP BY user_id)
  SELECT user_id, last_seen, CASE WHEN since > last_seen OR last_seen IS NULL THEN since ELSE last_seen END + INTERVAL 48 HOUR AS alarm_at, COALESCE(rows, 0) AS rows
  FROM e FULL JOIN r USING (user_id)""")
def t03_silent(spark, sf):
    known = T.table(spark, sf, "customer").where("c_custkey % 2 = 0").select(
        F.col("c_custkey").alias("user_id"), F.lit("2024-01-10").cast("timestamp").alias("since"))
    alarms, folder = KS.silent_sources(event_stream(spark, sf), known, "user_id", "at"), ST.work_folder(spark)
    KS.run_one_batch(alarms.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out"), folder)
    out = spark.read.parquet(f"{folder}/out")
    return out.select(F.col("user_id").cast("long").alias("user_id"), F.col("last_seen").cast("timestamp_ntz").alias("last_seen"),
                      F.col("alarm_at").cast("timestamp_ntz").alias("alarm_at"), "rows")


@query("t03_quiet_sources", """
  WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
  s AS (SELECT user_id, ts, sum(CASE WHEN before IS NULL OR ts - before > INTERVAL 48 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM e),
  g AS (SELECT user_id, max(ts) AS last_seen, count(*) AS rows FROM s GROUP BY user_id, session)
  SELECT user_id, last_seen, last_seen + INTERVAL 48 HOUR AS alarm_at, rows FROM g
  WHERE last_seen + INTERVAL 48 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def t03(spark, sf):
    alarms = ST.quiet_sources(event_stream(spark, sf), "user_id", "at")
    out = spark.read.parquet(ST.to_table(alarms, ST.work_folder(spark)))
    return out.select("user_id", F.col("last_seen").cast("timestamp_ntz").alias("last_seen"),
                      F.col("alarm_at").cast("timestamp_ntz").alias("alarm_at"), "rows")


WEIGHT = "CASE WHEN event_type IN ('purchase', 'click') THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END"


@query("t04_signals_per_day", f"""
  SELECT date_trunc('day', ts) AS start, event_type, count(*) AS signals, CAST(sum({WEIGHT}) AS BIGINT) AS weight FROM events
  WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY ALL""")
def t04(spark, sf):
    days = ST.signal_windows(event_stream(spark, sf), "at", "1 day")
    out = spark.read.parquet(ST.to_table(days, ST.work_folder(spark)))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "signals", "weight")


@query("t04_signals_sliding_week", f"""
  WITH d AS (SELECT unnest(generate_series(DATE '2023-12-20', DATE '2024-02-10', INTERVAL 1 DAY)) AS start)
  SELECT CAST(start AS TIMESTAMP) AS start, event_type, count(*) AS signals, CAST(sum({WEIGHT}) AS BIGINT) AS weight FROM d JOIN events ON ts >= start AND ts < start + INTERVAL 7 DAY
  WHERE start + INTERVAL 7 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY ALL""")
def t04_week(spark, sf):
    weeks = ST.signal_windows(event_stream(spark, sf), "at", "7 days", "1 day")
    out = spark.read.parquet(ST.to_table(weeks, ST.work_folder(spark)))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "signals", "weight")


@query("t04_signal_sessions", """
  WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
  s AS (SELECT user_id, ts, sum(CASE WHEN before IS NULL OR ts - before > INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM e)
  SELECT user_id, min(ts) AS start, count(*) AS signals FROM s GROUP BY user_id, session
  HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def t04_sessions(spark, sf):
    sessions = ST.signal_sessions(event_stream(spark, sf), "at", "6 hours", "user_id")
    out = spark.read.parquet(ST.to_table(sessions, ST.work_folder(spark)))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "signals")


@query("t05_digest_once", with_(SCREENING) + """
  SELECT DISTINCT strftime(d, '%G-W%V') AS label FROM screening WHERE strftime(d, '%G-W%V') NOT IN (SELECT strftime(o_orderdate, '%G-W%V') FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 400000)""")
def t05(spark, sf):
    def digests(df, at):
        w = iso_week(F.col(at).cast("date"))
        subject = F.concat(F.lit("Top picks for "), month_range(w["monday"], w["sunday"]))
        return df.select(w["label"].alias("label"), subject.alias("subject"))

    sent = digests(T.table(spark, sf, "orders").where("o_orderstatus = 'P' AND o_totalprice > 400000"), "o_orderdate").distinct()
    path = ST.digest_once(digests(T.stream(spark, sf, "lineitem"), "l_shipdate"), sent, ST.work_folder(spark))
    return spark.read.parquet(path).select("label")
