"""Field normalizers on text derived from the showings, so that the right answer is known."""

from pyspark.sql import functions as F

from showbill.catalog.base import (
    LISTING, MONTH_NAME, MONTH_SHORT, PERSON, SCREENING, TODAY, WEEKDAY_NAME, WEEKDAY_SHORT, query, with_,
)
from showbill.functions import clock as C
from showbill.functions import dates as D
from showbill.functions import facts as A
from showbill.operators import normalize as N
from showbill.sources import tables as T

Y, M, DD = "CAST(year(d) AS STRING)", "CAST(month(d) AS STRING)", "CAST(day(d) AS STRING)"
M2, D2 = f"lpad({M}, 2, '0')", f"lpad({DD}, 2, '0')"
HOUR = "(10 + n)"
MIN = "substring(time, 4, 2)"
H12 = f"CAST((CASE WHEN {HOUR} % 12 = 0 THEN 12 ELSE {HOUR} % 12 END) AS STRING)"
HALF = f"(CASE WHEN {HOUR} >= 12 THEN 'PM' ELSE 'AM' END)"
AT24 = f"concat(CAST({HOUR} AS STRING), ':', {MIN})"


def raw(spark, sf, expr: str):
    """Showings with a text column made by an expression both engines read."""
    return T.screening(spark, sf).withColumn("raw", F.expr(expr))


def arms(key: str, *exprs: str) -> str:
    n = len(exprs)
    return f"CASE {key} % {n} " + " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(exprs)) + " END"


# P02 -----------------------------------------------------------------------------------
RAW_DATE = arms(
    "event_key", f"concat({Y}, '-', {M2}, '-', {D2})", f"concat({M}, '/', {DD}, '/', {Y})",
    f"concat({M2}, '/', {D2}, '/', {Y})", f"concat({DD}, '/', {M}, '/', {Y})",
    f"concat({Y}, '/', {M}, '/', {DD})", f"concat({Y}, '-', {M}, '-', {DD})", "'soon'", "'2026-13-45'",
)


@query("p02_normalize_dates", with_(SCREENING) + f"""
  SELECT ord, CASE
      WHEN event_key % 8 = 3 AND day(d) <= 12 THEN concat({Y}, '-', {D2}, '-', {M2})
      WHEN event_key % 8 = 6 THEN NULL WHEN event_key % 8 = 7 THEN '2026-13-45' ELSE date END AS date_iso,
    CAST(CASE WHEN event_key % 8 = 6 THEN 0 ELSE 1 END AS INTEGER) AS n_dates FROM screening""")
def p02(spark, sf):
    dates = D.normalize_dates(F.array("raw"))
    return raw(spark, sf, RAW_DATE).select("ord", F.get(dates, F.lit(0)).alias("date_iso"), F.size(dates).alias("n_dates"))


# P03, P04, P05 ---------------------------------------------------------------------------
RAW_TIME = arms(
    "event_key", AT24, f"concat({H12}, ':', {MIN}, ' ', {HALF})", f"concat({H12}, ':', {MIN}, lower({HALF}))",
    f"concat({AT24}, ':15')", f"concat(' ', {H12}, ':', {MIN}, '  ', {HALF}, ' ')", "'doors at dusk'",
    f"concat({H12}, ' ', {HALF})",
)


@query("p03_normalize_times", with_(SCREENING) + f"""
  SELECT ord, CASE WHEN event_key % 7 <= 4 THEN time WHEN event_key % 7 = 5 THEN 'doors at dusk'
    ELSE concat({H12}, ' ', {HALF}) END AS time_24 FROM screening""")
def p03(spark, sf):
    return raw(spark, sf, RAW_TIME).select("ord", F.get(C.normalize_times(F.array("raw")), F.lit(0)).alias("time_24"))


RAW_LOOSE = arms(
    "event_key", f"concat({H12}, ':', {MIN}, ' ', {HALF}, ' - late')",
    f"concat({H12}, '-', CAST((CASE WHEN {HOUR} % 12 = 11 THEN 12 ELSE {HOUR} % 12 + 1 END) AS STRING), ' ', lower({HALF}))",
    f"concat('Doors ', {AT24})", "date", "'to be announced'", f"concat('at ', {H12}, lower({HALF}))", "'99 o clock'",
)


@query("p04_loose_time", with_(SCREENING) + f"""
  SELECT ord, CASE event_key % 7 WHEN 0 THEN time WHEN 1 THEN concat(CAST({HOUR} AS STRING), ':00') WHEN 2 THEN time
     WHEN 5 THEN concat(CAST({HOUR} AS STRING), ':00') END AS time_24 FROM screening""")
def p04(spark, sf):
    return raw(spark, sf, RAW_LOOSE).select("ord", C.loose_time(F.col("raw")).alias("time_24"))


@query("p05_clock_forms", with_(SCREENING) + f"""
  SELECT ord, CASE WHEN event_key % 7 IN (1, 2, 4) THEN time END AS strict_24,
    event_key % 7 IN (1, 2, 4) AS is_12h,
    CASE WHEN event_key % 7 IN (0, 1, 2, 4) THEN {HOUR} * 60 + CAST({MIN} AS INTEGER)
         WHEN event_key % 7 = 6 THEN {HOUR} * 60 END AS feed_minute,
    CASE WHEN event_key % 7 IN (0, 1, 4) THEN time WHEN event_key % 7 = 6 THEN concat(CAST({HOUR} AS STRING), ':00') END AS page_time
  FROM screening""")
def p05(spark, sf):
    clock = C.clock_struct(F.col("raw"))
    return raw(spark, sf, RAW_TIME).select(
        "ord", C.to_24h(F.col("raw")).alias("strict_24"), C.is_clock_12h(F.col("raw")).alias("is_12h"),
        (clock["hour"] * 60 + clock["minute"]).alias("feed_minute"), C.listing_time(F.col("raw")).alias("page_time"))


# P06, P07 --------------------------------------------------------------------------------
RAW_PARTIAL = arms(
    "event_key", f"concat({Y}, '-', {M2})", f"concat({Y}, '-', {M2}, '-', {D2}, ' to later')",
    f"concat({Y}, '-', {M2}, '-31')", "'June 1998'", f"concat('  ', {Y}, '-', {M2}, '-', {D2})",
)


@query("p06_partial_date", with_(SCREENING) + f"""
  SELECT ord, CASE event_key % 5 WHEN 0 THEN concat({Y}, '-', {M2}, '-01') WHEN 1 THEN date
    WHEN 2 THEN CASE WHEN month(d) IN (1, 3, 5, 7, 8, 10, 12) THEN concat({Y}, '-', {M2}, '-31') END
    WHEN 4 THEN date END AS date_iso FROM screening""")
def p06(spark, sf):
    return raw(spark, sf, RAW_PARTIAL).select("ord", D.partial_date(F.col("raw")).alias("date_iso"))


CENTURY = "concat('20', substring(date, 3, 2))"  # a year the range rule reads
RAW_RANGE = arms(
    "event_key", f"concat(date, ' to ', {Y}, '-12-31')", f"concat({MONTH_NAME}, ' ', {DD}, ' - December 31, ', {CENTURY})",
    f"concat('December 20 - ', {MONTH_SHORT}, '. ', {DD}, ', ', {CENTURY})",
    f"concat('Fri, ', {MONTH_SHORT}, ' ', {DD})", "'on view now'", "date",
)


@query("p07_date_range", with_(SCREENING) + f"""
  , pieces AS (SELECT *, concat({M2}, '-', {D2}) AS md, CAST({CENTURY} AS INTEGER) AS cy,
      try_cast(concat('1998-', {M2}, '-', {D2}) AS DATE) AS this_year FROM screening)
  SELECT ord,
    CASE event_key % 6 WHEN 0 THEN date
      WHEN 1 THEN try_cast(concat(cy, '-', md) AS DATE)::VARCHAR
      WHEN 2 THEN concat(cy, '-12-20')
      WHEN 3 THEN try_cast(concat(CASE WHEN this_year < DATE '1998-04-16' THEN 1999 ELSE 1998 END, '-', md) AS DATE)::VARCHAR
      WHEN 5 THEN date END AS starts,
    CASE event_key % 6 WHEN 0 THEN concat({Y}, '-12-31')
      WHEN 1 THEN CASE WHEN try_cast(concat(cy, '-', md) AS DATE) IS NOT NULL THEN concat(cy, '-12-31') END
      WHEN 2 THEN try_cast(concat(CASE WHEN md < '12-20' THEN cy + 1 ELSE cy END, '-', md) AS DATE)::VARCHAR END AS ends
  FROM pieces""")
def p07(spark, sf):
    out = raw(spark, sf, RAW_RANGE).select("ord", D.date_range(F.col("raw"), TODAY).alias("r"))
    return out.select("ord", F.col("r.start").alias("starts"), F.col("r.end").alias("ends"))


@query("p08_infer_year", with_(SCREENING) + f"""
  SELECT ord, CAST(CASE WHEN try_cast(concat('1998-', {M2}, '-', {D2}) AS DATE) < DATE '1998-06-15' - 60 THEN 1999
      WHEN try_cast(concat('1998-', {M2}, '-', {D2}) AS DATE) IS NOT NULL THEN 1998 END AS INTEGER) AS grace_year,
    CAST(CASE WHEN month(d) >= 6 THEN 1998 ELSE 1999 END AS INTEGER) AS month_year FROM screening""")
def p08(spark, sf):
    m, d = F.month("d"), F.day("d")
    return T.screening(spark, sf).select(
        "ord", D.infer_year(m, d, TODAY, "grace").alias("grace_year"), D.infer_year(m, d, TODAY, "month").alias("month_year"))


RAW_PROSE = arms(
    "event_key", f"concat({WEEKDAY_NAME}, ', ', {MONTH_NAME}, ' ', {DD}, ', ', {H12}, '-11 ', lower({HALF}))",
    f"concat({MONTH_NAME}, ' ', {DD}, ', ', {Y}, ', ', {H12}, ':', {MIN}, ' ', {HALF})",
    f"concat({MONTH_NAME}, ' ', {DD}, ', ', {Y}, ' – December 31, 2030')",
    f"concat({MONTH_SHORT}, ' ', {DD}, ', noon')", "'sometime soon'",
)


@query("p09_prose_datetime", with_(SCREENING) + f"""
  , pieces AS (SELECT *, concat({M2}, '-', {D2}) AS md, try_cast(concat('1998-', {M2}, '-', {D2}) AS DATE) AS this_year FROM screening)
  SELECT ord,
    CASE event_key % 5 WHEN 0 THEN concat(CASE WHEN this_year < DATE '1998-06-15' - 60 THEN '1999-' ELSE '1998-' END, md)
      WHEN 1 THEN date WHEN 2 THEN date END AS date_iso,
    CASE event_key % 5 WHEN 0 THEN concat(CAST({HOUR} AS STRING), ':00') WHEN 1 THEN time WHEN 2 THEN '10:00' END AS time_24
  FROM pieces""")
def p09(spark, sf):
    out = raw(spark, sf, RAW_PROSE).select("ord", D.prose_datetime(F.col("raw"), TODAY).alias("p"))
    return out.select("ord", F.col("p.date").alias("date_iso"), F.col("p.time").alias("time_24"))


RAW_MDY = arms("event_key", f"concat({M}, '/', {DD}, '/', substring({Y}, 3, 2), ' ', {H12}, ':', {MIN}, ' ', lower({HALF}))",
               f"concat({M}, '/', {DD}, '/', {Y}, ' ', {H12}, ':', {MIN}, ' ', {HALF})", "'later this year'")


@query("p10_mdy_datetime", with_(SCREENING) + f"""
  SELECT ord, CASE event_key % 3 WHEN 0 THEN concat('20', substring(date, 3)) WHEN 1 THEN date END AS date_iso,
    CASE WHEN event_key % 3 < 2 THEN concat({H12}, ':', {MIN}, ' ', {HALF}) END AS time_12 FROM screening""")
def p10(spark, sf):
    out = raw(spark, sf, RAW_MDY).select("ord", D.mdy_datetime(F.col("raw")).alias("p"))
    return out.select("ord", F.col("p.date").alias("date_iso"), F.col("p.time").alias("time_12"))


MINUTES = "(60 + event_key % 100)"
RAW_LENGTH = arms(
    "order_key", f"concat('1h ', CAST({MINUTES} - 60 AS STRING), 'min')", f"concat(CAST({MINUTES} AS STRING), ' minutes')",
    f"concat('1 hr. ', CAST({MINUTES} - 60 AS STRING), ' mins')", "concat('1:', lpad(CAST(event_key % 60 AS STRING), 2, '0'))",
    f"CAST({MINUTES} AS STRING)", "'2h'", "'feature length'",
)


@query("p11_duration_minutes", with_(SCREENING) + f"""
  SELECT ord, CAST(CASE order_key % 7 WHEN 3 THEN 60 + event_key % 60 WHEN 5 THEN 120 WHEN 6 THEN NULL ELSE {MINUTES} END AS INTEGER) AS minutes
  FROM screening""")
def p11(spark, sf):
    return raw(spark, sf, RAW_LENGTH).select("ord", C.duration_minutes(F.col("raw")).alias("minutes"))


# P12, P14 --------------------------------------------------------------------------------
RAW_INFO = arms(
    "event_key", "'France, 1994, 98min, In French with English subtitles.'", "'USA, 1990, 100min'",
    "'Austria, 1931, 90min, In german, English and Romany; restored'", "'Japan, 1953, 136min'",
    "'UK, 1971, 90min, In DCP'", "'Chile, 2010, 97min, In Spanish/Mapudungun & spanish'",
)


@query("p12_languages", with_(SCREENING) + """
  SELECT ord, CASE event_key % 6 WHEN 0 THEN 'French' WHEN 1 THEN 'English' WHEN 2 THEN 'German, English, Romany'
    WHEN 4 THEN 'English' WHEN 5 THEN 'Spanish, Mapudungun' END AS languages FROM screening""")
def p12(spark, sf):
    country = F.substring_index("raw", ",", 1)
    return raw(spark, sf, RAW_INFO).select("ord", A.languages(F.col("raw"), country).alias("languages"))


RAW_BLURB = """concat('A quiet study. Directed by ', CASE WHEN event_key % 2 = 0 THEN 'Jane Campion' ELSE 'Bela Tarr' END,
  ', shown in ', CAST(1950 + event_key % 60 AS STRING), '. Runs ', CAST(80 + event_key % 70 AS STRING),
  ' minutes. From ', CASE WHEN event_key % 3 = 0 THEN 'New Zealand' ELSE 'Hungary' END, ', 35mm. Language: ',
  CASE WHEN event_key % 4 = 0 THEN 'FRENCH' ELSE 'english' END, '. Earlier Event: nothing')"""


@query("p14_film_facts", with_(SCREENING) + """
  SELECT ord, CASE WHEN event_key % 2 = 0 THEN 'Jane Campion' ELSE 'Bela Tarr' END AS director,
    CAST(1950 + event_key % 60 AS INTEGER) AS release_year, CAST(80 + event_key % 70 AS INTEGER) AS runtime_minutes,
    CASE WHEN event_key % 3 = 0 THEN 'New Zealand' ELSE 'Hungary' END AS country,
    CASE WHEN event_key % 4 = 0 THEN 'French' ELSE 'English' END AS language FROM screening""")
def p14(spark, sf):
    return raw(spark, sf, RAW_BLURB).select("ord", A.film_facts(F.col("raw")).alias("f")).select("ord", "f.*")


#: The facts that documents tell by themselves, by the same patterns.
FACT = "nullif(trim(regexp_extract(t, '{}', 1)), '')"


@query("p14_facts_of_documents", f"""
  WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) || ' Directed by ' || source || ', shown in ' || CAST(1950 + doc_id % 60 AS VARCHAR) || '.' AS t FROM documents WHERE text IS NOT NULL)
  SELECT doc_id, {FACT.format('(?i)(?:directed by|director:|dir[.])\\s+([^,.]+)')} AS director,
    CAST({FACT.format('\\b(19[0-9]{{2}}|20[0-9]{{2}})\\b').replace('{{', '{').replace('}}', '}')} AS INTEGER) AS release_year,
    CAST(nullif(regexp_extract(t, '(?i)([0-9]{{2,3}})\\s*(?:min|minutes)', 1), '') AS INTEGER) AS runtime_minutes FROM d""")
def p14_documents(spark, sf):
    docs = T.table(spark, sf, "documents").where("text IS NOT NULL")
    told = F.concat(F.trim(F.regexp_replace("text", r"\s+", " ")), F.lit(" Directed by "), "source", F.lit(", shown in "),
                    (1950 + F.col("doc_id") % 60).cast("string"), F.lit("."))
    return docs.select("doc_id", A.film_facts(told).alias("f")).select("doc_id", "f.director", "f.release_year", "f.runtime_minutes")


@query("p12_languages_of_regions", """
  SELECT s_suppkey, concat(upper(n_name[1]), lower(n_name[2:]), CASE WHEN s_suppkey % 2 = 0 THEN concat(', ', array_to_string(list_transform(string_split(r_name, ' '),
    lambda w: upper(w[1]) || lower(w[2:])), ' ')) ELSE '' END) AS languages
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def p12_regions(spark, sf):
    rows = T.table(spark, sf, "supplier").join(T.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(
        T.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    info = F.concat("s_name", F.lit(", In "), "n_name", F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit(" and "), "r_name")).otherwise(
        F.concat(F.lit(", in "), F.lower("n_name"))), F.lit(" with "), "r_name", F.lit(" subtitles"))
    return rows.select("s_suppkey", A.languages(info, F.col("n_name")).alias("languages"))


RAW_CREDIT = arms("event_key", "'It is directed by Agnes Varda with care'", "'As director Claire Denis shows'",
                  "'Here Chantal Akerman directs herself'", "'A film (dir. Maya Deren)'", "'directed by nobody'")


@query("p14_director_in_review", with_(SCREENING) + """
  SELECT ord, CASE event_key % 5 WHEN 0 THEN 'Agnes Varda' WHEN 1 THEN 'Claire Denis' WHEN 2 THEN 'Here Chantal Akerman'
    WHEN 3 THEN 'Maya Deren' ELSE '' END AS director FROM screening""")
def p14_director(spark, sf):
    return raw(spark, sf, RAW_CREDIT).select("ord", A.director_in_review(F.col("raw")).alias("director"))


# P01 ------------------------------------------------------------------------------------
@query("p01_snake_case", with_(SCREENING) + """
  SELECT ord, title AS event_title, [date] AS dates, [time] AS times, venue AS venue__name, url AS http_url,
         rating AS some_rating, TRUE AS kept_names FROM screening""")
def p01(spark, sf):
    mixed = T.screening(spark, sf).select(
        "ord", F.col("title").alias("eventTitle"), F.col("date").alias("Date"), "time",
        F.col("venue").alias("Venue Name"), F.col("url").alias("HTTPUrl"), F.col("rating").alias("some-rating"))
    out = N.snake_case(mixed)
    return out.withColumn("kept_names", F.size("raw_metadata") == 5).drop("raw_metadata")


# P17, P18, P39 ----------------------------------------------------------------------------
@query("p17_fill_defaults", with_(SCREENING) + """
  , raw AS (SELECT ord, venue, CASE WHEN n % 2 = 0 THEN '' ELSE type END AS category,
              CASE WHEN n % 3 = 0 THEN 'Peru' END AS country, supp_key FROM screening)
  SELECT ord, venue,
    CASE WHEN category <> '' THEN category WHEN supp_key % 3 = 0 THEN 'venue default' ELSE '' END AS category,
    COALESCE(country, CASE WHEN supp_key % 4 = 0 THEN 'Chile' END, 'USA') AS country, 'English' AS language,
    'No description available' AS one_liner_summary FROM raw""")
def p17(spark, sf):
    rows = T.screening(spark, sf).select(
        "ord", "venue", F.when(F.col("n") % 2 == 0, "").otherwise(F.col("type")).alias("category"),
        F.when(F.col("n") % 3 == 0, "Peru").alias("country"))
    venue = T.table(spark, sf, "supplier").select(F.col("s_name").alias("venue"), F.col("s_suppkey").alias("k"))
    overrides = venue.where("k % 3 = 0").select("venue", F.lit("category").alias("field"), F.lit("venue default").alias("default_value")).unionByName(
        venue.where("k % 4 = 0").select("venue", F.lit("country").alias("field"), F.lit("Chile").alias("default_value")))
    return N.fill_defaults(rows, overrides, ["category", "country", "language", "one_liner_summary"])


@query("p18_apply_template", with_(SCREENING, PERSON) + """
  , first_rows AS (SELECT * FROM screening_person QUALIFY row_number() OVER (PARTITION BY event_key ORDER BY ord) = 1)
  SELECT event_key, type, title, url,
    venue,
    CASE WHEN event_key % 4 = 0 THEN concat('<p><strong>', title, '</strong></p>')
         ELSE concat('<p>', title, ' by <em>', person, '</em></p>') END AS description,
    CASE WHEN event_key % 4 = 0 THEN rating ELSE -1 END AS rating,
    CASE WHEN event_key % 4 = 0 THEN 'high' ELSE 'unknown' END AS review_confidence,
    CASE WHEN event_key % 6 = 0 THEN 'A hook' ELSE '' END AS one_liner_summary,
    CASE WHEN type = 'movie' THEN person END AS director,
    CASE WHEN type = 'movie' THEN 'USA' END AS country, CASE WHEN type = 'movie' THEN 'English' END AS language,
    CASE WHEN type IN ('concert', 'opera', 'dance') THEN concat('Works for ', venue) END AS program,
    CASE WHEN type = 'book_club' THEN '' END AS author
  FROM first_rows""")
def p18(spark, sf):
    rows = T.event(spark, sf, person=True)
    rated = F.col("event_key") % 4 == 0
    rows = rows.select(
        "event_key", "title", "type", "venue", "url", F.col("person").alias("director"),
        F.concat(F.lit("Works for "), "venue").alias("program"),
        F.concat("title", F.lit(" by *"), "person", F.lit("*")).alias("description"),
        rated.alias("rated"), F.col("rating").alias("score"),
        F.when(rated, F.concat(F.lit("## **"), "title", F.lit("**"))).alias("review"),
        F.when(rated, "high").alias("review_confidence"),
        F.when(F.col("event_key") % 6 == 0, "A hook").alias("hook"))
    return N.apply_templates(rows).select(
        "event_key", "type", "title", "url", "venue", "description", "rating", "review_confidence", "one_liner_summary",
        "director", "country", "language", "program", "author")


@query("p39_resolve_type", with_(SCREENING) + """
  , raw AS (SELECT ord, CASE n WHEN 1 THEN ' Film ' WHEN 2 THEN '' WHEN 3 THEN 'other' WHEN 4 THEN 'Concert' ELSE type END AS kind,
              event_key % 2 = 0 AS has_film, supp_key % 5 = 0 AS film_venue FROM screening)
  SELECT ord, CASE WHEN kind = ' Film ' THEN 'movie'
    WHEN kind = '' AND film_venue THEN 'movie' WHEN has_film AND kind IN ('', 'other') THEN 'movie'
    WHEN kind = '' THEN 'other' ELSE lower(kind) END AS type FROM raw""")
def p39(spark, sf):
    n = F.col("n")
    kind = F.when(n == 1, " Film ").when(n == 2, "").when(n == 3, "other").when(n == 4, "Concert").otherwise(F.col("type"))
    return T.screening(spark, sf).select(
        "ord", A.resolve_type(kind, F.col("event_key") % 2 == 0, F.col("supp_key") % 5 == 0).alias("type"))


# P33, P34, P32 ---------------------------------------------------------------------------
@query("p33_season_label", with_(SCREENING) + """
  SELECT ord, CASE WHEN month(d) >= 8 THEN concat(year(d), '-', lpad(CAST((year(d) + 1) % 100 AS VARCHAR), 2, '0'))
    ELSE concat(year(d) - 1, '-', lpad(CAST(year(d) % 100 AS VARCHAR), 2, '0')) END AS season FROM screening""")
def p33(spark, sf):
    return T.screening(spark, sf).select("ord", D.season_label(F.col("d")).alias("season"))


@query("p34_iso_week", with_(SCREENING) + f"""
  SELECT ord, strftime(d, '%G-W%V') AS label, strftime(d - dow, '%Y-%m-%d') AS monday,
    strftime(d - dow + 6, '%Y-%m-%d') AS sunday, strftime(d - dow, '%Y-%m-%d') AS parsed_monday,
    strftime(d - dow + 7, '%G-W%V') AS next_label,
    CASE WHEN month(d - dow) = month(d - dow + 6)
      THEN concat({MONTH_NAME.replace('month(d)', 'month(d - dow)')}, ' ', day(d - dow), '–', day(d - dow + 6), ', ', year(d - dow + 6))
      ELSE concat({MONTH_NAME.replace('month(d)', 'month(d - dow)')}, ' ', day(d - dow), ' – ',
        {MONTH_NAME.replace('month(d)', 'month(d - dow + 6)')}, ' ', day(d - dow + 6), ', ', year(d - dow + 6)) END AS range_label
  FROM screening""")
def p34(spark, sf):
    w = D.iso_week(F.col("d"))
    return T.screening(spark, sf).select(
        "ord", w["label"].alias("label"), w["monday"].cast("string").alias("monday"), w["sunday"].cast("string").alias("sunday"),
        D.week_start(w["label"]).cast("string").alias("parsed_monday"),
        D.iso_week(D.next_week(F.col("d")))["label"].alias("next_label"),
        D.month_range(w["monday"], w["sunday"]).alias("range_label"))


@query("p32_calendar_span", with_(SCREENING) + """
  , raw AS (SELECT ord, date, d, CASE WHEN n = 1 THEN '' ELSE time END AS clock FROM screening)
  SELECT ord, CASE WHEN clock = '' THEN concat(strftime(d, '%Y%m%d'), '/', strftime(d + 1, '%Y%m%d'))
    ELSE concat(strftime(CAST(concat(date, ' ', clock) AS TIMESTAMP), '%Y%m%dT%H%M%S'), '/',
                strftime(CAST(concat(date, ' ', clock) AS TIMESTAMP) + INTERVAL 2 HOUR, '%Y%m%dT%H%M%S')) END AS span FROM raw""")
def p32(spark, sf):
    at = F.when(F.col("n") == 1, "").otherwise(F.col("time"))
    return T.screening(spark, sf).select("ord", C.span(F.col("date"), at).alias("span"))


# P28, P31, P40, P41 ------------------------------------------------------------------------
@query("p28_display", with_(SCREENING) + f"""
  SELECT ord, concat({WEEKDAY_SHORT}, ', ', {MONTH_SHORT}, ' ', day(d), ' · ', {H12}, ':', {MIN}, ' ', {HALF}) AS when_long,
    concat({H12}, CASE WHEN {MIN} = '00' THEN '' ELSE concat(':', {MIN}) END, lower({HALF})) AS clock_short,
    CASE WHEN rating >= 8 THEN 'high' WHEN rating >= 5 THEN 'mid' ELSE 'low' END AS rating_class,
    CASE WHEN rating IS NULL THEN '' WHEN rating >= 8 THEN 'dark' ELSE 'light' END AS badge FROM screening""")
def p28(spark, sf):
    return T.screening(spark, sf).select(
        "ord", A.when_text(F.col("date"), F.col("time")).alias("when_long"),
        C.clock_12h(F.col("time"), "short").alias("clock_short"),
        A.rating_class(F.col("rating")).alias("rating_class"), A.score_badge(F.col("rating")).alias("badge"))


@query("p41_run_note", with_(SCREENING) + f"""
  , raw AS (SELECT ord, event_key, d AS first_d, d + 60 AS e, type = 'movie' AS scored FROM screening),
  noted AS (SELECT ord, e AS d, NOT scored AND e >= DATE '{TODAY}' AS shown,
     first_d <= DATE '{TODAY}' AND e - DATE '{TODAY}' <= 14 AS soon FROM raw)
  SELECT ord, CASE WHEN shown THEN concat(CASE WHEN soon THEN 'Closes ' ELSE 'Through ' END, {MONTH_SHORT}, ' ', day(d)) END AS note,
    CASE WHEN shown THEN soon END AS closing_soon FROM noted""")
def p41(spark, sf):
    note = A.run_note(F.date_add("d", 60).cast("string"), F.col("date"), F.col("type") == "movie", TODAY)
    return T.screening(spark, sf).select("ord", note.alias("r")).select(
        "ord", F.col("r.text").alias("note"), F.col("r.closing_soon").alias("closing_soon"))


RAW_TITLE = arms("event_key", "concat(title, ' Pop-Up')", "concat('Theory  Night: ', title)", "concat('The Book Club reads ', title)",
                 "upper(title)", "'8 1/2'", "concat(title, ' (Live Event)')", "title")


@query("p40_classify_title", with_(SCREENING) + """
  SELECT ord, CASE WHEN event_key % 7 = 2 THEN 'book_club' ELSE 'other' END AS kind, event_key % 7 = 5 AS live,
    event_key % 7 IN (3, 4) AS caps FROM screening""")
def p40(spark, sf):
    t = F.col("raw")
    return raw(spark, sf, RAW_TITLE).select(
        "ord", A.classify_title(t).alias("kind"), A.is_live_title(t).alias("live"), A.is_caps_title(t).alias("caps"))


# P42 ----------------------------------------------------------------------------------------
STANDARD = f"""
std AS (
  SELECT ord, title, dates, times, end_date, url, event_key, n,
    CASE WHEN event_key % 7 = 2 THEN [] ELSE dates END AS clean_dates,
    CASE event_key % 7 WHEN 1 THEN list_transform(times, lambda t: strftime(strptime(t, '%I:%M %p'), '%H:%M')) ELSE times END AS t24
  FROM listing)"""


@query("p42_standardize", with_(SCREENING, LISTING, STANDARD) + f"""
  SELECT ord, trim(title) AS title, array_to_string(clean_dates, ',') AS dates,
    array_to_string(list_transform(range(1, len(clean_dates) + 1), lambda i: COALESCE(t24[i], '19:00')), ',') AS times,
    end_date, CASE WHEN trim(title) = '' THEN 'no title' WHEN len(clean_dates) = 0 THEN 'no date'
      WHEN COALESCE(end_date, list_max(clean_dates)) < '{TODAY}' THEN 'finished' END AS reject
  FROM std""")
def p42(spark, sf):
    out = N.standardize(T.listing(spark, sf, lineitem=T.dealt(spark, sf, "lineitem")), TODAY, "19:00", F.lit("https://example.org/"))
    return out.select("ord", "title", F.array_join("dates", ",").alias("dates"), F.array_join("times", ",").alias("times"),
                      "end_date", "reject")


@query("p42_venue_defaults", with_(SCREENING, LISTING) + f"""
  , raw AS (
    SELECT ord, supp_key, venue AS known_name, trim(title) AS title, end_date, event_key, n,
      CASE WHEN n % 3 = 0 THEN 'Guest Hall' WHEN n % 3 = 1 THEN ' ' END AS own_venue,
      CASE WHEN len(dates) = 0 AND supp_key % 7 = 0 THEN ['{TODAY}'] WHEN event_key % 7 = 2 THEN [] ELSE dates END AS dates,
      CASE event_key % 7 WHEN 1 THEN list_transform(times, lambda t: strftime(strptime(t, '%I:%M %p'), '%H:%M')) ELSE times END AS t24 FROM listing),
  judged AS (
    SELECT *, CASE WHEN supp_key % 11 = 0 THEN FALSE ELSE supp_key % 2 = 0 END AS preserve, CASE WHEN title = '' THEN 'no title' WHEN len(dates) = 0 THEN 'no date'
      WHEN COALESCE(end_date, list_max(dates)) < '{TODAY}' THEN 'finished' END AS reject FROM raw)
  SELECT ord, title, reject,
    CASE WHEN supp_key % 11 = 0 THEN CASE WHEN n % 3 = 0 THEN 'Guest Hall' END
      WHEN preserve AND n % 3 = 0 THEN 'Guest Hall' ELSE known_name END AS venue,
    CASE WHEN supp_key % 11 <> 0 AND supp_key % 4 = 0 THEN 'opera' ELSE 'other' END AS type,
    CASE WHEN supp_key % 3 = 0 THEN 'free' ELSE '' END AS price,
    array_to_string(list_transform(range(1, len(dates) + 1), lambda i: COALESCE(t24[i], CASE WHEN supp_key % 11 <> 0 AND supp_key % 5 = 0 THEN '18:30' ELSE '19:00' END)), ',') AS times
  FROM judged QUALIFY reject IS NOT NULL OR row_number() OVER (PARTITION BY supp_key, lower(title), dates[1], reject ORDER BY ord) = 1""")
def p42_venue(spark, sf):
    n = F.col("n")
    rows = T.listing(spark, sf, lineitem=T.dealt(spark, sf, "lineitem")).select(
        "ord", F.col("supp_key").alias("venue_key"), "title", "dates", "times", "end_date", "url",
        F.when(n % 3 == 0, "Guest Hall").when(n % 3 == 1, " ").alias("venue"), F.lit("").alias("price"))
    k = F.col("venue_key")
    supplier = T.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("venue_key"), F.col("s_name").alias("venue_name"))
    venues = supplier.where(k % 11 != 0).select(
        "*", F.when(k % 4 == 0, "opera").alias("category"), (k % 2 == 0).alias("preserve_venue_name"),
        F.when(k % 5 == 0, "18:30").alias("default_time"), F.lit("https://example.org/").alias("page_url"))
    defaults = supplier.where(k % 3 == 0).select("venue_key", F.lit("price").alias("field"), F.lit("free").alias("default_value")).unionByName(
        supplier.where(k % 7 == 0).select("venue_key", F.lit("dates").alias("field"), F.lit(TODAY).alias("default_value")))
    out = N.venue_rows(rows, venues, TODAY, defaults, ["price", "dates"])
    return out.select("ord", "title", "reject", "venue", "type", "price", F.array_join("times", ",").alias("times"))


@query("f02_drop_finished", with_(SCREENING, LISTING, STANDARD) + f"""
  SELECT ord FROM std WHERE COALESCE(COALESCE(end_date, list_max(CASE WHEN event_key % 7 = 2 THEN NULL ELSE dates END)) >= '{TODAY}', TRUE)""")
def f02(spark, sf):
    return T.listing(spark, sf).where(~N.finished(F.col("end_date"), F.col("dates"), TODAY)).select("ord")


@query("p42_season_row", with_(SCREENING, LISTING) + """
  SELECT ord, trim(title) AS title, COALESCE(CASE WHEN n % 3 <> 0 THEN venue END, 'Main Hall') AS venue_name,
    CASE WHEN trim(title) = '' THEN 'no title' WHEN len(dates) = 0 THEN 'no date'
      WHEN len(dates) <> len(times) THEN 'dates and times differ in length' END AS reject FROM listing""")
def p42_season(spark, sf):
    rows = T.listing(spark, sf).select(
        "ord", "title", "dates", "times", F.when(F.col("n") % 3 != 0, F.col("venue")).alias("venue_name"),
        F.lit("").alias("venue"), F.lit(None).cast("array<string>").alias("composers"),
        F.lit(None).cast("array<string>").alias("works"), F.lit("").alias("program"), F.lit("").alias("series"),
        F.lit("").alias("featured_artist"), "type")
    return N.season_row(rows, "concert", "Main Hall").select("ord", "title", "venue_name", "reject")
