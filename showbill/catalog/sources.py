"""Sources: payloads, feeds, pages, documents and replies made from the tables, then read back."""

from pyspark.sql import functions as F

from showbill.catalog.base import (
    LISTING, MONTH_NAME, MONTH_SHORT, SCREENING, TODAY, WEEKDAY_NAME, query, with_,
)
from showbill.catalog.normalize import DD, H12, HALF, MIN
from showbill.sources import calls as CL
from showbill.sources import pages as P
from showbill.sources import responses as RS
from showbill.sources import schedules as SC
from showbill.sources import season as SE
from showbill.sources import tables as T
from showbill.streaming.jobs import work_folder


# S01 ------------------------------------------------------------------------------------------
def season_payload(spark, sf):
    rows = T.listing(spark, sf)
    none = F.lit(None).cast("array<string>")
    e = F.struct(
        "title", F.lit("Programme").alias("program"), "dates", "times",
        F.when(F.col("n") == 2, F.concat(F.lit("Hall "), "venue")).alias("venue_name"), F.lit("Main").alias("series"),
        F.lit("").alias("featured_artist"), none.alias("composers"), none.alias("works"),
        F.when(F.col("event_key") % 4 == 0, F.col("type")).otherwise("").alias("type")).cast(SE.SEASON_EVENT)
    return rows.select("ord", F.create_map(F.concat(F.lit("v"), F.col("supp_key").cast("string")), F.array(e)).alias("payload"))


def season_registry(spark, sf):
    k = F.col("s_suppkey")
    return T.table(spark, sf, "supplier").select(
        F.concat(F.lit("v"), k.cast("string")).alias("venue_key"), F.col("s_name").alias("venue"),
        F.concat(F.lit("https://"), k.cast("string"), F.lit(".example.org")).alias("base_url"), F.lit("concert").alias("default_type"),
        F.when(k % 3 == 0, "dance").otherwise("").alias("assumed_type"), F.lit("7:30 PM").alias("default_time"),
        F.lit("Town Hall").alias("default_location"), (k % 2 == 0).alias("expand"))


@query("s01_season_events", with_(SCREENING, LISTING) + """
  , l AS (SELECT ord, title, venue, dates, times, supp_key, CASE WHEN n = 2 THEN concat('Hall ', venue) ELSE 'Town Hall' END AS location,
      CASE WHEN event_key % 4 = 0 THEN type WHEN supp_key % 3 = 0 THEN 'dance' ELSE 'concert' END AS type FROM listing)
  SELECT ord, title, venue, location, type, concat('https://', supp_key, '.example.org') AS url, dates[i] AS dates,
    COALESCE(times[i], times[1], '7:30 PM') AS times
  FROM (SELECT *, unnest(range(1, len(dates) + 1)) AS i FROM l WHERE supp_key % 2 = 0)
  UNION ALL SELECT ord, title, venue, location, type, concat('https://', supp_key, '.example.org'), array_to_string(dates, ','),
    CASE WHEN len(times) > 0 THEN array_to_string(times, ',') ELSE array_to_string(list_transform(dates, lambda x: '7:30 PM'), ',') END
  FROM l WHERE supp_key % 2 = 1""")
def s01(spark, sf):
    out = SE.season_events(season_payload(spark, sf), season_registry(spark, sf))
    return out.select("ord", "title", "venue", "location", "type", "url",
                      F.array_join("dates", ",").alias("dates"), F.array_join("times", ",").alias("times"))


# S03 ------------------------------------------------------------------------------------------
def productions(spark, sf):
    rows = T.listing(spark, sf)
    perf = F.transform(F.arrays_zip("dates", "times"), lambda z, i: F.struct(
        F.when(F.col("damage") == 3, "").when(F.col("damage") == 2, F.concat(z["dates"], F.lit(" soon"))).otherwise(
            F.concat(z["dates"], F.lit("T19:00:00+00:00"))).alias("iso8601DateString"),
        F.lit(None).cast("string").alias("performanceDate"),
        F.when(F.col("n") == 5, "").when(F.col("n") == 6, "Late").otherwise(F.lit("07:30pm")).alias("displayTime"),
        F.when((F.col("event_key") % 4 == 0) & (i == 0), False).alias("isPerformanceVisible"),
        F.when(F.col("n") == 1, F.concat(F.lit("p"), "url")).alias("actionUrl")))
    return rows.select(
        "ord", F.col("title").alias("productionTitle"), F.lit(" A show. ").alias("description"),
        F.when(F.col("n") == 2, F.col("url")).otherwise("").alias("actionUrl"), F.col("event_key").alias("productionSeasonId"),
        perf.alias("performances"))


@query("s03_production_screenings", with_(SCREENING, LISTING) + """
  SELECT ord, trim(title) AS title, dates[i] AS date, CASE WHEN n = 6 THEN 'LATE' ELSE '7:30 PM' END AS time,
    CASE n WHEN 1 THEN concat('p', url) WHEN 2 THEN url ELSE concat('https://x.org/', event_key) END AS url, 'A show.' AS description
  FROM (SELECT *, unnest(range(1, greatest(len(dates), len(times)) + 1)) AS i FROM listing)
  WHERE trim(title) <> '' AND event_key % 7 NOT IN (2, 3) AND n <> 5 AND NOT (event_key % 4 = 0 AND i = 1)""")
def s03(spark, sf):
    return SE.production_screenings(productions(spark, sf), "https://x.org", "Hall").select("ord", "title", "date", "time", "url", "description")


# S04 - S06 ------------------------------------------------------------------------------------
def parsed_rows(spark, sf):
    """The showings of a page or document each, dealt evenly: reading one costs far more than moving its row."""
    return T.screening(spark, sf, lineitem=T.dealt(spark, sf, "lineitem"))


def raw_pages(spark, sf, html):
    return parsed_rows(spark, sf).select("ord", F.expr(html).alias("html"))


RAW_ARTICLES = f"""concat('<html><body><nav><a href="/x">x</a></nav>',
  '<article class="a eventlist-event"><h1 class="eventlist-title"><a href="/e/', CAST(event_key AS STRING), '" class="eventlist-title-link">',
  CASE n WHEN 2 THEN 'Red Book Club: ' WHEN 3 THEN 'Pop-up ' ELSE '' END, title, ' &amp; more</a></h1>',
  CASE WHEN n = 4 THEN concat('<time class="event-date">', {WEEKDAY_NAME}, ', ', {MONTH_NAME}, ' ', {DD}, ', ', CAST(year(d) AS STRING), '</time>')
    ELSE concat('<time datetime="', date, '" class="event-date">x</time>') END,
  CASE WHEN n = 6 THEN '' ELSE concat('<time class="event-time-localized-start">', {H12}, ':', {MIN}, ' ', {HALF}, '</time>') END,
  '<div class="eventlist-excerpt">', CASE WHEN n = 1 THEN '<p>Short <b>text</b></p>' ELSE '' END, '</div>',
  '<div class="eventlist-description"><p>Long text</p></div></article>',
  '<article class="eventlist-event"><h1>', venue, '</h1></article></body></html>')"""


@query("s04_articles", with_(SCREENING) + """
  SELECT ord, concat(CASE n WHEN 2 THEN 'Red Book Club: ' WHEN 3 THEN 'Pop-up ' ELSE '' END, title, ' & more') AS title,
    concat('https://books.example.org/e/', event_key) AS url, date, time, CASE WHEN n = 1 THEN 'Short text' ELSE 'Long text' END AS description,
    CASE WHEN n = 2 THEN 'book_club' ELSE 'other' END AS type, CASE WHEN n = 2 THEN 'Red Book Club' END AS series
  FROM screening WHERE n <> 6""")
def s04(spark, sf):
    pages = raw_pages(spark, sf, RAW_ARTICLES)
    return P.articles_from_pages(pages, "https://books.example.org")


RAW_FILM = f"""concat('<html><body>', CASE WHEN n = 2 THEN '<h2>' ELSE '<h1 class="t">' END, title, CASE WHEN n = 2 THEN '</h2>' ELSE '</h1>' END,
  '<p>Directed by Agnes Varda<br></p><p class="t-smaller">France, ', CAST(1950 + event_key % 60 AS STRING), ', 1h ', CAST(10 + event_key % 40 AS STRING),
  'min, In French with English subtitles.</p><div class="c-screening-content"><p>On <i>', venue, '</i>.</p></div>',
  CASE WHEN n % 2 = 0 THEN concat('<li class="c-showtime-select__trigger" data-target="', replace(date, '-', ''), '">x</li>') ELSE '' END,
  '<div class="c-showtime-display" id="showtime-', replace(date, '-', ''), '"><a class="c-button b" href="#">', {H12}, ':', {MIN}, ' ', {HALF}, '</a>',
  '<a class="c-button">11:59 PM</a><a class="other">no</a></div>',
  '<div id="showtime-20300101" class="c-showtime-display"><a class="c-button">1:01 AM</a></div></body></html>')"""


@query("s05_film_pages", with_(SCREENING) + f"""
  , b AS (SELECT *, unnest([concat({H12}, ':', {MIN}, ' ', {HALF}), '11:59 PM', '1:01 AM']) AS shown FROM screening)
  SELECT ord, title, 'Agnes Varda' AS director, 'France' AS country, CAST(1950 + event_key % 60 AS INTEGER) AS release_year,
    CAST(70 + event_key % 40 AS INTEGER) AS runtime_minutes, 'French' AS language, concat('On ', venue, ' .') AS description,
    CASE WHEN shown = '1:01 AM' THEN '2030-01-01' ELSE date END AS date, shown AS time
  FROM b WHERE shown <> '1:01 AM' OR n % 2 = 1""")
def s05(spark, sf):
    pages = raw_pages(spark, sf, RAW_FILM)
    out = P.film_page_screenings(pages).drop("slot")
    return out.withColumn("description", F.regexp_replace("description", r"\s*\.$", " ."))


RAW_CLUB = f"""concat('<div class="x"><div class="collection-item-8 w-dyn"><div class="h1 smaller centered book-club">', type, '</div>',
  '<div class="body-text center book-club w-richtext">The ', venue, ' Book Club is lively. Hosted by First Light manager Ann Lee. ',
  {MONTH_NAME}, ' selection: ', title, ' by Bo Day. ', CASE WHEN n % 2 = 0
    THEN concat('Meeting the second Monday of the month, ', {MONTH_NAME}, ' ', {DD}, ', at 7 p.m.')
    ELSE concat('Meets ', {WEEKDAY_NAME}, ', ', {MONTH_NAME}, ' ', {DD}, 'th at 6:30pm') END, '</div></div>',
  '<div class="collection-item-8"><div class="h1 smaller centered book-club">Empty</div></div></div>')"""


@query("s06_club_meetings", with_(SCREENING) + f"""
  , p AS (SELECT *, CASE WHEN month(d) >= 6 THEN 1998 ELSE 1999 END AS y FROM screening)
  SELECT ord, concat(venue, ' Book Club') AS series, title AS book, 'Bo Day' AS author,
    concat(y, strftime(d, '-%m-%d')) AS date, CASE WHEN n % 2 = 0 THEN '7:00 PM' ELSE '6:30 PM' END AS time, 'Ann Lee' AS host,
    concat('The ', venue, ' Book Club is lively. Hosted by First Light manager Ann Lee.') AS description,
    concat(venue, ' Book Club - ', title) AS title
  FROM p WHERE NOT (month(d) = 2 AND day(d) = 29)""")
def s06(spark, sf):
    pages = raw_pages(spark, sf, RAW_CLUB)
    return P.club_meetings(pages, TODAY)


RAW_AUTHOR = f"""concat('<div class="h2 article">', venue, ': ', CASE WHEN n = 1 THEN 'The ' ELSE '' END, title, '</div><div class="subtitle">',
  CAST(month(d) AS STRING), '/', {DD}, '/', substring(date, 3, 2), ' ', {H12}, ':', {MIN}, ' ', lower({HALF}), '</div>',
  '<div class="body-text article w-richtext"><p>', CASE WHEN event_key % 3 = 0 THEN 'THE 5 TYPES OF WEALTH will teach you' WHEN event_key % 3 = 1
    THEN concat('In her debut book, RED: A LIFE, ', title, ' at Austin Public Library') ELSE 'About it' END, '</p></div>',
  CASE WHEN n % 2 = 0 THEN concat('<a href="', url, '?a=1&amp;b=2" class="button _3 tickets w-button">RSVP</a>') ELSE '<a class="button" href="/no">no</a>' END)"""


@query("s06_author_events", with_(SCREENING) + f"""
  SELECT ord, concat(venue, ': ', CASE WHEN n = 1 THEN 'The ' ELSE '' END, title) AS title, venue AS author,
    CASE WHEN n <> 1 THEN title WHEN event_key % 3 = 0 THEN 'THE 5 TYPES OF WEALTH' WHEN event_key % 3 = 1 THEN 'RED: A LIFE' END AS book,
    CASE WHEN event_key % 3 = 0 THEN 'THE 5 TYPES OF WEALTH will teach you' WHEN event_key % 3 = 1 THEN concat('In her debut book, RED: A LIFE, ', title, ' at Austin Public Library') ELSE 'About it' END AS description,
    CASE WHEN n % 2 = 0 THEN concat(url, '?a=1&b=2') END AS rsvp_url, CASE WHEN event_key % 3 = 1 THEN 'Austin Public Library Central Branch' ELSE 'First Light Books' END AS venue,
    concat('20', date[3:]) AS date, concat({H12}, ':', {MIN}, ' ', {HALF}) AS time FROM screening""")
def s06_author(spark, sf):
    pages = raw_pages(spark, sf, RAW_AUTHOR)
    return P.author_event(pages)


# S07 ------------------------------------------------------------------------------------------
RAW_SERIES = f"""concat('<p>intro</p><h2 class="bm-txt-1">Voyage Out</h2><p>about</p><h2 class="bm-txt-0">UPCOMING CLUBS</h2><p>',
  {WEEKDAY_NAME}, ', ', {MONTH_SHORT}, '. ', {DD}, ' - ', title, ' by Ann by the Sea by Bo Day. ',
  {WEEKDAY_NAME}, ', ', {MONTH_NAME}, ' 1 — ', venue, ' View all Monday, May 2 - gone</p>',
  '<h2 class="bm-txt-2">Paper Cuts @ ', venue, '</h2><h2>Other</h2><h2 class="bm-txt-0">Upcoming screenings</h2><div>Sunday, ', {MONTH_NAME}, ' 2 – ',
  upper(title), ' (dir. X)</div><h2 class="bm-txt-1">Last</h2><p>Friday, May 1 - Never</p>')"""


@query("s07_series_entries", with_(SCREENING) + f"""
  , p AS (SELECT *, CASE WHEN month(d) >= 6 THEN 1998 ELSE 1999 END AS y FROM screening),
  e AS (
    SELECT ord, 'Voyage Out' AS series, concat(title, ' by Ann by the Sea') AS book, 'Bo Day' AS author,
      CASE WHEN NOT (month(d) = 2 AND day(d) = 29) THEN concat(y, strftime(d, '-%m-%d')) END AS date, '5:00 PM' AS time, NULL AS hint FROM p
    UNION ALL SELECT ord, 'Voyage Out', venue, NULL, concat(y, strftime(d, '-%m-01')), '5:00 PM', NULL FROM p
    UNION ALL SELECT ord, concat('Paper Cuts @ ', venue), concat(upper(title), ' (dir. X)'), NULL, concat(y, strftime(d, '-%m-02')), '7:00 PM', upper(title) FROM p)
  SELECT ord, concat(series, ' - ', book) AS title, CASE WHEN hint IS NULL THEN 'book_club' ELSE 'other' END AS type, series,
    CASE WHEN hint IS NULL THEN book END AS book, author, date, time, CAST(NULL AS VARCHAR) AS host,
    CASE WHEN hint IS NULL THEN 'A regional reading series.' ELSE 'Book club meeting' END AS note, hint AS hint_title,
    CASE WHEN hint IS NOT NULL THEN date END AS hint_date
  FROM e WHERE date IS NOT NULL""")
def s07(spark, sf):
    pages = raw_pages(spark, sf, RAW_SERIES)
    details = spark.createDataFrame([("Voyage Out", "5:00 PM", None, "A regional reading series.")],
                                    "series string, time string, host string, note string")
    return P.series_entries(pages, details, TODAY, "ord")


# S08, S09, X02 ----------------------------------------------------------------------------------
@query("s08_discover_links", """
  WITH l AS (SELECT regexp_extract(url, '^(https?://[^/?#]+)', 1) AS base, unnest(regexp_extract_all(html, '(?i)<a\\b[^>]*\\bhref="([^"]*)"', 1)) AS href FROM pages)
  SELECT DISTINCT CASE WHEN href LIKE 'http%' THEN href WHEN href LIKE '/%' THEN base || href ELSE base || '/' || href END AS link
  FROM l WHERE contains(href, 'e')""")
def s08(spark, sf):
    return P.discover_links(T.table(spark, sf, "pages"), "e")


@query("s08_movie_links", """
  WITH l AS (SELECT regexp_extract(url, '^(https?://[^/?#]+)', 1) AS base, unnest(regexp_extract_all(html, '(?i)<a\\b[^>]*\\bhref="([^"]*)"', 1)) AS href FROM pages)
  SELECT DISTINCT base || href AS link FROM l WHERE href LIKE '/%' AND (contains(lower(base || href), 'tion') OR contains(lower(base || href), 'heit'))""")
def s08_words(spark, sf):
    return P.discover_links(T.table(spark, sf, "pages"), "/", ["tion", "heit"])


@query("s09_main_text", """
  WITH a AS (SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') AS h FROM pages),
  b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '(?is)<script\\b[^>]*>.*?</script>', '', 'g'),
    '(?is)<style\\b[^>]*>.*?</style>', '', 'g'), '(?is)<nav\\b[^>]*>.*?</nav>', '', 'g'), '(?is)<footer\\b[^>]*>.*?</footer>', '', 'g') AS h FROM a),
  c AS (SELECT page_id, regexp_extract(h, '(?is)<article(?:\\s[^>]*)?>(.*?)</article>', 1) AS h FROM b)
  SELECT page_id, replace(replace(replace(array_to_string(list_filter(list_transform(regexp_split_to_array(h, '<[^>]*>'), lambda x: trim(x, ' ' || chr(10) || chr(9))), lambda x: x <> ''), ' | '),
    '&quot;', '"'), '&middot;', '·'), '&amp;', '&') AS text FROM c""")
def s09(spark, sf):
    return T.table(spark, sf, "pages").select("page_id", P.main_text(F.col("html")).alias("text"))


@query("x02_parse_blocks", with_(SCREENING) + """
  SELECT ord, CAST(i AS INTEGER) AS pos, CASE WHEN i = 0 THEN concat(title, ' inner ', venue) ELSE 'second' END AS text
  FROM (SELECT *, unnest([0, 1]) AS i FROM screening)""")
def x02(spark, sf):
    html = F.concat(F.lit('<div>out<div class="a item b">'), "title", F.lit("<div>inner</div> <br>"), "venue",
                    F.lit('</div></div><p class="item">no</p><DIV class=item>second</DIV>'))
    pages = parsed_rows(spark, sf).select("ord", html.alias("html"))
    return P.parse_blocks(pages, "ord", "div", "item")


# S10 - S12 ------------------------------------------------------------------------------------
RAW_SCHEDULE = f"""concat('# Season', '\n## ', {MONTH_NAME}, ' ', CAST(year(d) AS STRING), '\n- **TOO EARLY** — 6:00 PM\n\n### ', {WEEKDAY_NAME}, ', ', {MONTH_NAME}, ' ', {DD},
  '\n- **', upper(title), '**  — ', {H12}, ':', {MIN}, ' ', {HALF}, ', 11:15 PM, noon\nsome prose\n- **', title, '** - 8:00 PM\n- **8 1/2** – 9:30 AM  \n### Friday, December 5\n- **NIGHT  SHOW** - 10:00 pm')"""


@query("s10_schedule_doc", with_(SCREENING) + f"""
  SELECT ord, upper(title) AS title, date, concat({H12}, ':', {MIN}, ' ', {HALF}) AS time_12, time AS time_24 FROM screening
  UNION ALL SELECT ord, upper(title), date, '11:15 PM', '23:15' FROM screening
  UNION ALL SELECT ord, '8 1/2', date, '9:30 AM', '09:30' FROM screening
  UNION ALL SELECT ord, 'NIGHT SHOW', concat(year(d), '-12-05'), '10:00 pm', '22:00' FROM screening""")
def s10(spark, sf):
    docs = parsed_rows(spark, sf).select("ord", F.expr(RAW_SCHEDULE).alias("text"))
    return SC.schedule_doc(docs, "ord")


RAW_TABBED = f"""concat('Schedule\n', {MONTH_SHORT}, ' ', {DD}, '\t', title, '\n', {MONTH_SHORT}, ' ', {DD}, ' \t', title, ' (Live Event) \nSept 3\t', venue, ' Film Festival\nXyz 4\tNothing\nno tab here')"""


@query("s11_schedule_table", with_(SCREENING) + """
  , e AS (SELECT concat(ord, '-', year(d), '.md') AS doc, right(ord, 12) AS o, ord, title, venue, d, date FROM screening)
  SELECT doc, title, concat(substring(regexp_extract(doc, '(\\d{4})', 1), 1, 4), strftime(d, '-%m-%d')) AS date, FALSE AS live FROM e
  UNION ALL SELECT doc, title, concat(regexp_extract(doc, '(\\d{4})', 1), strftime(d, '-%m-%d')), TRUE FROM e
  UNION ALL SELECT doc, concat(venue, ' Film Festival'), concat(regexp_extract(doc, '(\\d{4})', 1), '-09-03'), TRUE FROM e""")
def s11(spark, sf):
    docs = parsed_rows(spark, sf).select(F.concat("ord", F.lit("-"), F.year("d").cast("string"), F.lit(".md")).alias("doc"), F.expr(RAW_TABBED).alias("text"))
    return SC.schedule_table(SC.split_lines(docs)).select("doc", "title", "date", "live")


RAW_BULLETS = """concat('- [ ] Before (other) — x\n<!-- BEGIN -->\n- [ ] ', title, ' [2] (', upper(type), ' hall) — Nice place [1] — see https://a.org/x and https://b.org/', CAST(event_key AS STRING), ').\n',
  '* not a bullet\n  - [x] ', venue, ' (book club)\n- [X] Third (dance) - plain text\n<!-- END -->\n- [ ] After (other)')"""


@query("s12_prospect_bullets", with_(SCREENING) + """
  SELECT ord, title AS name, concat(lower(type), '_hall') AS category, 'Nice place — see https://a.org/x and' AS description, concat('https://b.org/', event_key) AS url FROM screening
  UNION ALL SELECT ord, venue, 'book_club', '', '' FROM screening
  UNION ALL SELECT ord, 'Third', 'dance', 'plain text', '' FROM screening""")
def s12(spark, sf):
    docs = parsed_rows(spark, sf).select("ord", F.expr(RAW_BULLETS).alias("text"))
    return SC.prospect_docs(docs, "ord", ("BEGIN", "END")).drop("pos")


# S13, X03 -------------------------------------------------------------------------------------
RAW_JSON_LIST = """concat('[{"title": "', title, '", "date": "', date, '"}, {"title": "Br{ace \\\\"q\\\\" ]", "date": null}')"""
RAW_REPLY_JSON = f"""CASE event_key % 6
  WHEN 0 THEN concat('{{"events": ', {RAW_JSON_LIST}, ']}}')
  WHEN 1 THEN concat('Here you go:\n```json\n{{"note": 1, "exhibitions": ', {RAW_JSON_LIST}, ']}}\n``` enjoy {{}}')
  WHEN 2 THEN concat('{{"events": ', {RAW_JSON_LIST}, ', {{"title": "cut sho')
  WHEN 3 THEN concat('{{"events": [], "results": ', {RAW_JSON_LIST}, ', 7]}}')
  WHEN 4 THEN 'no json at all'
  ELSE '{{"events": [{{"title": "never clo' END"""


@query("s13_response_events", with_(SCREENING) + """
  SELECT ord, CAST(i AS INTEGER) AS pos, CASE WHEN i = 0 THEN title ELSE 'Br{ace "q" ]' END AS title, CASE WHEN i = 0 THEN date END AS date
  FROM (SELECT *, unnest([0, 1]) AS i FROM screening WHERE event_key % 6 < 4)""")
def s13(spark, sf):
    rows = parsed_rows(spark, sf).select("ord", F.expr(RAW_REPLY_JSON).alias("text"))
    return RS.response_events(rows, "title:string,date:string")


@query("x03_salvage_json", with_(SCREENING) + """
  SELECT ord, CAST(CASE WHEN event_key % 6 < 4 THEN 2 ELSE 0 END AS INTEGER) AS n_entries FROM screening""")
def x03(spark, sf):
    rows = T.screening(spark, sf).select("ord", F.expr(RAW_REPLY_JSON).alias("text"))
    return rows.select("ord", F.size(RS.salvage_json(F.col("text"))).alias("n_entries"))


@query("x01_run_model", """
  SELECT doc_id, CASE WHEN contains(text, 'eau') THEN NULL ELSE concat('review: ', len(text)) END AS content,
    contains(text, 'eau') AS failed FROM documents""")
def x01(spark, sf):
    def stub(prompts):
        if prompts.str.contains("eau").any():
            raise ValueError("refused")
        return "review: " + prompts.str.len().astype(str)

    rows = T.table(spark, sf, "documents").select("doc_id", F.col("text").alias("prompt"))
    out = RS.run_model(rows, stub, "doc_id", partitions=4, batch=1)
    return out.select("doc_id", "content", F.col("error").isNotNull().alias("failed"))


@query("x01_call_log", """
  SELECT doc_id, 'review: ' || len(text) AS content, text IS NOT NULL AND NOT bool_or(doc_id % 2 = 0) OVER (PARTITION BY text) AS asked FROM documents""")
def x01_log(spark, sf):
    """The second run asks only what the first one, over the even documents, has not."""
    def stub(prompts):
        return "review: " + prompts.str.len().astype(str)

    rows = T.table(spark, sf, "documents").select("doc_id", F.col("text").alias("prompt"))
    log = f"{work_folder(spark)}/calls"
    CL.run_logged(rows.where("doc_id % 2 = 0"), stub, log, "stub", "doc_id", buckets=8, batch=100)
    return CL.run_logged(rows, stub, log, "stub", "doc_id", buckets=8, batch=100).drop("error")


# S14, S15 -------------------------------------------------------------------------------------
@query("s14_digest_entries", with_(SCREENING) + """
  , w AS (SELECT strftime(d, '%G-W%V') AS label, strftime(d - dow, '%Y-%m-%d') AS monday, count(*) AS n FROM screening GROUP BY ALL)
  SELECT label, monday, CAST(CASE n % 3 WHEN 0 THEN n WHEN 1 THEN 2 END AS INTEGER) AS picks,
    CASE WHEN n % 3 = 0 THEN concat('The ', n, ' top picks & more') ELSE '' END AS description FROM w""")
def s14(spark, sf):
    from showbill.functions.dates import iso_week

    weeks = T.screening(spark, sf).select(iso_week(F.col("d"))["label"].alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    n = F.col("n").cast("string")
    html = F.when(F.col("n") % 3 == 0, F.concat(F.lit('<META name="description" content=" The '), n, F.lit(' top picks &amp; more ">'))).when(
        F.col("n") % 3 == 1, '<ul><li class="x weekly-pick">a</li><li class="weekly-pick y">b</li><li class="weekly">c</li></ul>').otherwise("<p>")
    files = weeks.select(F.concat("label", F.lit(".html")).alias("file_name"), html.alias("html"))
    other = weeks.select(F.lit("about.html").alias("file_name"), F.lit("x").alias("html"))
    bad = weeks.select(F.concat(F.substring("label", 1, 6), F.lit("99.html")).alias("file_name"), F.lit("x").alias("html"))
    out = SC.digest_entries(files.unionByName(other).unionByName(bad))
    return out.select("label", F.col("monday").cast("string").alias("monday"), "picks", "description")


@query("s15_page_manifest", with_(SCREENING) + """
  SELECT concat('https://x.org/events/', event_key, '.html') AS url, max(date) AS last_change FROM screening GROUP BY ALL
  UNION ALL SELECT concat('https://x.org/', CASE WHEN type = 'opera' THEN '' ELSE 'wishlist.html' END), max(date) FROM screening WHERE type IN ('opera', 'dance') GROUP BY ALL""")
def s15(spark, sf):
    s = T.screening(spark, sf)
    path = F.concat(F.lit("events/"), F.col("event_key").cast("string"), F.lit(".html"))
    files = s.select(path.alias("path"), F.col("d").alias("modified")).unionByName(
        s.where("type = 'opera'").select(F.lit("index.html").alias("path"), F.col("d").alias("modified"))).unionByName(
        s.where("type = 'dance'").select(F.lit("wishlist.html").alias("path"), F.col("d").alias("modified"))).unionByName(
        s.select(F.concat(F.lit("private/"), "venue", F.lit(".html")).alias("path"), F.col("d").alias("modified"))).unionByName(
        s.select(F.concat(F.lit("events/deep/"), "venue", F.lit(".html")).alias("path"), F.col("d").alias("modified")))
    return SC.manifest(files, "https://x.org/").select("url", F.col("last_change").cast("string").alias("last_change"))
