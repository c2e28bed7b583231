"""Validation, source health, quality ratios, lint and freshness."""

from pyspark.sql import functions as F

from showbill.catalog.base import EVENT, LISTING, SCREENING, TODAY, query, with_
from showbill.catalog.review import NONJ_SQL, RAW_REPLY, REFUSAL_SQL
from showbill.functions import review as RV
from showbill.operators import quality as Q
from showbill.sources import tables as T
from showbill.values import BANNED_PHRASES


@query("a20_validate", with_(SCREENING, LISTING) + """
  , l AS (SELECT *, CASE WHEN n = 7 THEN 'puppetry' ELSE type END AS kind FROM listing)
  SELECT ord, 'error' AS level, m AS message FROM (
    SELECT ord, 'missing title' AS m FROM l WHERE trim(title) = ''
    UNION ALL SELECT ord, 'no dates' FROM l WHERE len(dates) = 0
    UNION ALL SELECT ord, 'no times' FROM l WHERE len(times) = 0
    UNION ALL SELECT ord, concat('mismatched lengths: ', len(dates), ' dates, ', len(times), ' times') FROM l WHERE len(dates) > 0 AND len(times) > 0 AND len(dates) <> len(times)
    UNION ALL SELECT ord, concat('invalid date: ', dates[1]) FROM l WHERE event_key % 7 = 2 AND len(dates) > 0
    UNION ALL SELECT ord, concat('invalid time: ', times[1]) FROM l WHERE event_key % 7 = 1 AND len(times) > 0
    UNION ALL SELECT ord, 'unknown category: puppetry' FROM l WHERE kind = 'puppetry')""")
def a20(spark, sf):
    rows = T.listing(spark, sf).withColumn("type", F.when(F.col("n") == 7, "puppetry").otherwise(F.col("type")))
    return Q.validate(rows)


@query("a20_field_names", with_(SCREENING, LISTING) + """
  SELECT ord, 'error' AS level, m AS message FROM (
    SELECT ord, concat('field name not in snake case: ', unnest(['showUrl', 'End Date'])) AS m, unnest([url, end_date]) AS v FROM listing) WHERE v IS NOT NULL""")
def a20_names(spark, sf):
    rows = T.listing(spark, sf).withColumnsRenamed({"url": "showUrl", "end_date": "End Date"})
    return Q.validate(rows).where(F.col("message").startswith("field name"))


HEALTH = """
health AS (
  SELECT venue, found, sampled, valid, valid / sampled AS rate, rate >= 0.5 AS healthy FROM (
    SELECT venue, count(*) AS found FROM listing GROUP BY venue) JOIN (
    SELECT venue, count(*) AS sampled, count(*) FILTER (WHERE trim(title) <> '' AND len(dates) > 0) AS valid FROM (
      SELECT * FROM listing QUALIFY row_number() OVER (PARTITION BY venue ORDER BY ord) <= 3) GROUP BY venue) USING (venue))"""


def health(spark, sf):
    valid = (F.trim("title") != "") & (F.size("dates") > 0)
    return Q.source_health(T.listing(spark, sf), "venue", valid)


@query("a11_source_health", with_(SCREENING, LISTING, HEALTH) + " SELECT * FROM health")
def a11(spark, sf):
    return health(spark, sf)


@query("a11_gate", with_(SCREENING, LISTING, HEALTH) + """
  SELECT CAST(sum(found) AS BIGINT) AS found, count(*) FILTER (WHERE healthy) AS healthy, count(*) FILTER (WHERE NOT healthy) AS failed,
    CASE WHEN sum(found) = 0 THEN 'no source produced any rows' WHEN count(*) FILTER (WHERE healthy) = 0 THEN 'every source failed'
      WHEN count(*) FILTER (WHERE NOT healthy) > count(*) FILTER (WHERE healthy) THEN 'more sources failed than passed' ELSE '' END AS reason,
    reason = '' AS go FROM health""")
def a11_gate(spark, sf):
    return Q.gate(health(spark, sf))


@query("a12_telemetry", with_(SCREENING, EVENT) + """
  SELECT concat('classified:', CASE WHEN event_key % 4 = 0 THEN 'abstained' ELSE type END) AS counter, count(*) AS value FROM event GROUP BY 1
  UNION ALL SELECT CASE WHEN rating > 4 THEN 'fields accepted' ELSE 'fields rejected' END, count(*) FROM event GROUP BY 1""")
def a12(spark, sf):
    events = T.event(spark, sf)
    verdicts = events.select((F.coalesce("rating", F.lit(0)) > 4).alias("accepted"))
    return Q.telemetry(verdicts, events.select(F.when(F.col("event_key") % 4 != 0, F.col("type")).alias("category")))


@query("a13_stale_sources", """
  SELECT user_id AS source, date_diff('second', max(ts), TIMESTAMP '2024-01-30 00:00:00') // 3600 AS age_hours FROM events
  WHERE ts < TIMESTAMP '2024-01-30 00:00:00' GROUP BY user_id HAVING date_diff('second', max(ts), TIMESTAMP '2024-01-30 00:00:00') > 48 * 3600
  UNION ALL SELECT -1, 72""")
def a13(spark, sf):
    ts = F.col("ts").cast("timestamp_ntz")
    log = T.table(spark, sf, "events").where(ts < F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")).groupBy(
        F.col("user_id").alias("source")).agg(F.max(F.date_trunc("SECOND", "ts").cast("timestamp_ntz")).alias("last_updated"))
    old = log.agg(F.lit(-1).cast("bigint").alias("source"), F.lit("2024-01-27 00:00:00").cast("timestamp_ntz").alias("last_updated"))
    return Q.stale_sources(log.unionByName(old), "2024-01-30 00:00:00").select("source", "age_hours")


@query("a13_quiet_venues", with_(SCREENING) + """
  SELECT s_name AS venue FROM supplier WHERE s_name NOT IN (SELECT venue FROM screening WHERE d >= DATE '2001-10-20')
  UNION ALL SELECT concat('Closed ', s_name) FROM supplier""")
def a13_quiet(spark, sf):
    known = T.table(spark, sf, "supplier").select(F.explode(F.array("s_name", F.concat(F.lit("Closed "), "s_name"))).alias("venue"))
    return Q.quiet_venues(known, T.screening(spark, sf), "2001-10-20")


@query("a14_quality_report", with_(SCREENING, EVENT) + """
  , e AS (SELECT *, event_key % 10 <> 0 AS hooked_, event_key % 15 <> 0 AS shown_ FROM event)
  SELECT venue, count(*) AS events, avg(CASE WHEN rating >= 0 THEN 1 ELSE 0 END) AS rated, avg(CASE WHEN hooked_ THEN 1 ELSE 0 END) AS hooked,
    avg(CASE WHEN shown_ THEN 1 ELSE 0 END) AS shown, rated >= 0.8 AND hooked >= 0.8 AND shown >= 0.9 AS ok FROM e GROUP BY venue""")
def a14(spark, sf):
    k = F.col("event_key")
    rows = T.event(spark, sf).withColumns({
        "hook": F.when(k % 10 == 0, " ").otherwise("A hook"), "n_showings": F.when(k % 15 == 0, 0).otherwise(2)})
    return Q.quality_report(rows)


@query("a14_refusing_events", f"""
  WITH r AS (SELECT doc_id, concat('<p>', {RAW_REPLY}, '</p>') AS d, CASE WHEN doc_id % 7 = 0 THEN 'I cannot create a hook, it would be speculative.' ELSE lang END AS h FROM documents),
  t AS (SELECT *, trim(regexp_replace(regexp_replace(d, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS x FROM r)
  SELECT doc_id, CASE WHEN len(x) >= 40 AND regexp_matches(x, {REFUSAL_SQL}) THEN 'description' ELSE 'hook' END AS field FROM t
  WHERE (len(x) >= 40 AND regexp_matches(x, {REFUSAL_SQL})) OR doc_id % 7 = 0""")
def a14_refusing(spark, sf):
    hook = F.when(F.col("doc_id") % 7 == 0, "I cannot create a hook, it would be speculative.").otherwise(F.col("lang"))
    rows = T.table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("<p>"), F.expr(RAW_REPLY), F.lit("</p>")).alias("description"), hook.alias("hook"))
    return Q.refusing_events(rows).select("doc_id", "field")


RAW_STYLE = """concat(text, CASE doc_id % 5 WHEN 0 THEN ' A Haunting, lush tour de force.' WHEN 1 THEN ' Profound meditation on loss; it resonates deeply.'
  WHEN 2 THEN repeat(' — ', 9) WHEN 3 THEN ' Lushness is profoundly odd — so — so.' ELSE '' END)"""
STYLE_SQL = "'(?i)\\b(" + "|".join(BANNED_PHRASES) + ")\\b'"


@query("a15_style_lint", f"""
  WITH r AS (SELECT doc_id, {RAW_STYLE} AS body, CASE WHEN doc_id % 6 = 0 THEN 'visceral — and poignant' ELSE '' END AS hook FROM documents),
  c AS (SELECT doc_id, len(body) - len(replace(body, '—', '')) + len(hook) - len(replace(hook, '—', '')) AS n FROM r)
  SELECT doc_id, 'body' AS field, unnest(regexp_extract_all(body, {STYLE_SQL}, 1)) AS finding FROM r
  UNION ALL SELECT doc_id, 'hook', unnest(regexp_extract_all(hook, {STYLE_SQL}, 1)) FROM r
  UNION ALL SELECT doc_id, 'all', concat('dashes: ', n) FROM c WHERE n > 8""")
def a15(spark, sf):
    hook = F.when(F.col("doc_id") % 6 == 0, "visceral — and poignant").otherwise("")
    rows = T.table(spark, sf, "documents").select("doc_id", F.expr(RAW_STYLE).alias("body"), hook.alias("hook"))
    return Q.style_lint(rows, "doc_id", ["body", "hook"])


@query("a21_failing_source", with_(SCREENING) + """
  SELECT order_key AS run,
    CAST(min(CASE WHEN event_key % 5 = 0 THEN 0 WHEN event_key % 5 = 1 THEN 1 WHEN event_key % 5 = 2 THEN 3 END) AS INTEGER) AS pattern_no FROM screening
  WHERE event_key % 5 < 3 GROUP BY order_key""")
def a21(spark, sf):
    k = F.col("event_key") % 5
    line = F.when(k == 0, F.concat(F.lit("❌ ["), F.col("n").cast("string"), F.lit("/7] Hall"), F.col("supp_key").cast("string"))).when(
        k == 1, F.concat(F.lit("Error scraping "), "venue", F.lit(" : timeout"))).when(
        k == 2, F.concat(F.lit("Failed - "), "venue")).otherwise("all fine")
    lines = T.screening(spark, sf).select(F.col("order_key").alias("run"), F.col("ord").alias("line_no"), line.alias("line"))
    return Q.failing_source(lines).select("run", "pattern_no")


@query("a22_decline_rate", f"""
  WITH r AS (SELECT lang, regexp_matches({RAW_REPLY}, {NONJ_SQL}) AS declined, CAST(doc_id % 11 AS INTEGER) AS score FROM documents)
  SELECT lang, count(*) AS reviews, avg(CASE WHEN declined THEN 1 ELSE 0 END) AS decline_rate, avg(score) AS mean_score, stddev_pop(score) AS score_spread,
    min(score) AS low_score, max(score) AS high_score FROM r GROUP BY lang""")
def a22(spark, sf):
    rows = T.table(spark, sf, "documents").select(
        "lang", RV.is_non_judgement(F.expr(RAW_REPLY)).alias("has_declined"), (F.col("doc_id") % 11).cast("int").alias("score"))
    return Q.decline_rate(rows, "lang")


@query("a14_view_counts", with_(SCREENING) + f"""
  SELECT 'today' AS view, count(DISTINCT event_key) AS events FROM screening WHERE date = '{TODAY}'
  UNION ALL SELECT 'week', count(DISTINCT event_key) FROM screening WHERE date >= '{TODAY}' AND date < '1998-06-22'
  UNION ALL SELECT 'weekend', count(DISTINCT event_key) FROM screening WHERE date BETWEEN '1998-06-19' AND '1998-06-21'""")
def a14_views(spark, sf):
    return Q.view_counts(T.showings(spark, sf), TODAY)


@query("a20_schema_warnings", with_(SCREENING) + """
  SELECT 'rating should be string, is int' AS warning, count(*) AS rows FROM screening""")
def a20_warnings(spark, sf):
    rows = T.screening(spark, sf)
    found = Q.schema_warnings(rows, {"title": "string", "rating": "string", "n": "int"})
    return rows.agg(F.count("*").alias("rows")).select(F.explode(F.array(*[F.lit(w) for w in found])).alias("warning"), "rows")
