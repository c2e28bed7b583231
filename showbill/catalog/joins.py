"""Lookups, caches, overrides, companions, anti joins and comparisons."""

from pyspark.sql import functions as F

from showbill.catalog.base import EVENT, EVENT_PERSON, LISTING, PERSON, SCREENING, query, with_
from showbill.catalog.ranking import ATTEMPT, attempts
from showbill.functions.text import slug, title_key
from showbill.operators import joins as J
from showbill.operators import quality as Q
from showbill.sources import tables as T


def venue_tables(spark, sf):
    """Code map without every tenth venue, venue table without every tenth other one."""
    s = T.table(spark, sf, "supplier").join(T.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    key = F.concat(F.lit("v"), F.col("s_suppkey").cast("string"))
    codes = s.where("s_suppkey % 10 <> 0").select(F.col("s_name").alias("code"), key.alias("venue_key"))
    venues = s.where("s_suppkey % 10 <> 1").select(
        key.alias("venue_key"), F.concat("s_name", F.lit(" of "), "n_name").alias("display_name"),
        F.concat(F.col("s_suppkey").cast("string"), F.lit(" Main St, Austin, TX 78"), F.lpad((F.col("s_suppkey") % 1000).cast("string"), 3, "0")).alias("address"))
    return codes, venues


VENUE = """
venue_meta AS (
  SELECT s_name AS venue, concat(s_name, ' of ', n_name) AS display_name,
    concat(s_suppkey, ' Main St, Austin, TX 78', lpad(CAST(s_suppkey % 1000 AS VARCHAR), 3, '0')) AS address
  FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 10 NOT IN (0, 1)),
event_venue AS (
  SELECT e.*, COALESCE(m.display_name, e.venue) AS venue_display_name, COALESCE(m.address, '') AS venue_address
  FROM event e LEFT JOIN venue_meta m USING (venue))"""


@query("j01_attach_venue", with_(SCREENING, EVENT, VENUE) + " SELECT event_key, venue, venue_display_name, venue_address FROM event_venue")
def j01(spark, sf):
    out = J.attach_venue(T.event(spark, sf), *venue_tables(spark, sf))
    return out.select("event_key", "venue", "venue_display_name", "venue_address")


RULES = [
    {"title": "Ring 1", "type": "movie", "rating": 9, "summary": "A ring."},
    {"title": "red", "venue": "Supplier#000000003", "rating": 8},
    {"title": "bolt", "rating": 7, "summary": "Bolts."},
    {"venue": "Supplier#000000005", "type": "dance", "rating": 2},
    {"title": "ring", "rating": 6},
]
RULE_CASE = """CASE WHEN contains(lower(title), 'ring 1') AND type = 'movie' THEN 1
  WHEN contains(lower(title), 'red') AND venue = 'Supplier#000000003' THEN 2 WHEN contains(lower(title), 'bolt') THEN 3
  WHEN venue = 'Supplier#000000005' AND type = 'dance' THEN 4 WHEN contains(lower(title), 'ring') THEN 5 END"""
J02 = with_(SCREENING, EVENT) + f"""
  SELECT event_key, CAST({RULE_CASE} AS INTEGER) AS rule_no,
    CAST(CASE {RULE_CASE} WHEN 1 THEN 9 WHEN 2 THEN 8 WHEN 3 THEN 7 WHEN 4 THEN 2 WHEN 5 THEN 6 END AS INTEGER) AS rating FROM event"""


@query("j02_apply_overrides", J02)
def j02(spark, sf):
    out = J.apply_overrides(T.event(spark, sf), RULES)
    return out.select("event_key", "override.rule_no", "override.rating")


@query("j02_many_overrides", J02)
def j02_many(spark, sf):
    padding = [{"title": f"no such title {i}", "rating": 1} for i in range(500)]
    out = J.apply_overrides(T.event(spark, sf), RULES + padding)
    return out.select("event_key", "override.rule_no", "override.rating")


# J03, J04, J15 ---------------------------------------------------------------------------
def published(spark, sf):
    """Published reviews under the event titles: the document with the part's number."""
    docs = T.table(spark, sf, "documents")
    parts = T.table(spark, sf, "part")
    title = F.concat("p_name", F.lit(" "), (F.col("p_partkey") % 500).cast("string"))
    text = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("I cannot provide a review. "), "text")).otherwise(F.col("text"))
    return parts.join(docs, F.col("p_partkey") == F.col("doc_id")).select(
        F.concat(F.lit(" "), title).alias("title"), F.when(F.col("doc_id") % 6 != 0, F.col("p_size")).alias("rating"),
        text.alias("description"), F.col("p_partkey").alias("ord"))


CACHE = """
cache AS (
  SELECT upper(concat(p_name, ' ', p_partkey % 500)) AS cache_key, p_size AS cached_rating, doc_id % 5 = 0 AS refused, doc_id
  FROM part JOIN documents ON p_partkey = doc_id WHERE doc_id % 6 <> 0
  QUALIFY row_number() OVER (PARTITION BY cache_key ORDER BY p_partkey DESC) = 1)"""


@query("j03_rating_cache", with_(SCREENING, EVENT, CACHE) + """
  SELECT event_key, CASE WHEN doc_id IS NOT NULL AND NOT refused THEN cached_rating END AS cached_rating,
    doc_id IS NOT NULL AND NOT refused AS hit FROM event LEFT JOIN cache ON upper(title) = cache_key""")
def j03(spark, sf):
    hits, misses = J.attach_rating_cache(T.event(spark, sf), J.rating_cache(published(spark, sf)))
    return hits.select("event_key", "cached_rating", F.lit(True).alias("hit")).unionByName(
        misses.select("event_key", F.lit(None).cast("int").alias("cached_rating"), F.lit(False).alias("hit")))


@query("j03_rating_cache_forced", with_(SCREENING, EVENT, CACHE) + """
  SELECT event_key, doc_id IS NOT NULL AND NOT refused AND event_key <> min(event_key) OVER (PARTITION BY upper(title)) AS hit
  FROM event LEFT JOIN cache ON upper(title) = cache_key""")
def j03_forced(spark, sf):
    hits, misses = J.attach_rating_cache(T.event(spark, sf), J.rating_cache(published(spark, sf)), force=True)
    return hits.select("event_key", F.lit(True).alias("hit")).unionByName(misses.select("event_key", F.lit(False).alias("hit")))


@query("j04_summary_cache", with_(SCREENING, EVENT) + """
  SELECT event_key, CASE WHEN event_key % 2 = 0 THEN concat('Hook ', title) END AS cached_hook FROM event""")
def j04(spark, sf):
    part = T.table(spark, sf, "part").where("p_partkey % 2 = 0")
    title = F.concat("p_name", F.lit(" "), (F.col("p_partkey") % 500).cast("string"))
    cache = part.select(title.alias("t"), T.category_of(F.col("p_type")).alias("type")).distinct().select(
        F.upper("t").alias("title_key"), "type", F.concat(F.lit("Hook "), "t").alias("summary"))
    events = T.event(spark, sf)
    # Odd events with the same title and type as an even one would hit too; keep the keys apart.
    events = events.withColumn("title", F.when(F.col("event_key") % 2 == 0, F.col("title")).otherwise(F.concat("title", F.lit("*"))))
    return J.attach_summary_cache(events, cache).select("event_key", "cached_hook")


@query("j15_resolve_rating", with_(SCREENING, EVENT, ATTEMPT) + """
  , f AS (SELECT event_key, content AS c1 FROM attempt WHERE trim(content) <> '' AND content NOT LIKE 'I cannot provide a review%'
          QUALIFY row_number() OVER (PARTITION BY event_key ORDER BY attempt_no) = 1)
  SELECT event_key, COALESCE(c1, text, concat('Unable to evaluate ', title, ' (no sources found).')) AS review,
    CASE WHEN c1 IS NOT NULL THEN 'attempt' WHEN text IS NOT NULL THEN 'secondary' ELSE 'stub' END AS origin,
    CAST(CASE WHEN COALESCE(c1, text) IS NULL THEN 5 END AS INTEGER) AS score
  FROM event LEFT JOIN f USING (event_key) LEFT JOIN documents ON doc_id = event_key""")
def j15(spark, sf):
    second = T.table(spark, sf, "documents").select(F.col("doc_id").alias("event_key"), F.col("text").alias("content"))
    out = J.resolve_rating(T.event(spark, sf), attempts(spark, sf), second)
    return out.select("event_key", "review", "origin", "score")


# J05 --------------------------------------------------------------------------------------
def hints(spark, sf):
    """Non-film events hint at a film: the head of some part's title, on their first date."""
    first = T.showings(spark, sf).groupBy("event_key").agg(F.min("date").alias("hint_date"))
    name = T.table(spark, sf, "part").select(F.col("p_partkey").alias("event_key"), "p_name", "p_size")
    rows = T.event(spark, sf).where("type NOT IN ('movie', 'screening')").join(first, "event_key").join(name, "event_key")
    hint = F.when(F.col("p_size") % 3 == 0, F.upper(F.substring_index("p_name", " ", 1))).when(
        F.col("p_size") % 3 == 1, F.concat(F.lit(" "), F.substring_index("p_name", " ", -1), F.lit(" 1"))).otherwise("")
    return rows.select("event_key", hint.alias("hint_title"), "hint_date")


COMPANION = """
hint AS (
  SELECT event_key, min(date) AS hint_date, any_value(CASE WHEN p_size % 3 = 0 THEN lower(split_part(p_name, ' ', 1))
     WHEN p_size % 3 = 1 THEN concat(split_part(p_name, ' ', -1), ' 1') ELSE '' END) AS needle
  FROM screening JOIN part ON event_key = p_partkey WHERE type NOT IN ('movie', 'screening') GROUP BY event_key),
films AS (SELECT DISTINCT event_key AS film_key, lower(title) AS film_title, date FROM screening WHERE type = 'movie'),
titled AS (SELECT film_title, date, min(film_key) AS first_key, max(film_key) AS film_key FROM films GROUP BY ALL),
matched AS (SELECT event_key, arg_min(film_key, first_key) AS film_key FROM hint JOIN titled
  ON date = hint_date AND needle <> '' AND contains(film_title, needle) GROUP BY event_key)"""


@query("j05_companions", with_(SCREENING, EVENT, COMPANION) + """
  SELECT event_key, film_key, title, venue, url, '' AS description, (SELECT min_by(s.time, s.ord) FROM screening s WHERE s.event_key = m.event_key) AS time
  FROM matched m JOIN event USING (event_key)""")
def j05(spark, sf):
    attached, _ = J.merge_companions(T.event(spark, sf), T.showings(spark, sf), hints(spark, sf))
    return attached.select("event_key", "film_key", "title", "venue", "url", "description", "time")


@query("j05_remaining", with_(SCREENING, EVENT, COMPANION) + " SELECT event_key FROM event WHERE event_key NOT IN (SELECT event_key FROM matched)")
def j05_remaining(spark, sf):
    _, remaining = J.merge_companions(T.event(spark, sf), T.showings(spark, sf), hints(spark, sf))
    return remaining.select("event_key")


# J06, J07 ---------------------------------------------------------------------------------
def listing_shows(spark, sf):
    """Showing keys of every listing; titles are the part names, so that listings overlap."""
    from showbill.operators.grouping import zip_dates_times

    flat = zip_dates_times(T.listing(spark, sf)).withColumn("short", F.substring_index("title", " ", 2))
    key = J.showing_key(F.col("short"), F.col("date"), F.substring("time", 1, 2), F.col("type"))
    return flat.select("ord", key.alias("showing_key"))


#: The rounds of the rule written out; the last one must leave nothing open.
def _rounds(n: int) -> str:
    parts = ["""
pairs AS MATERIALIZED (
  SELECT DISTINCT ord, concat(lower(trim(concat(string_split(title, ' ')[1], CASE WHEN len(string_split(title, ' ')) > 1 THEN ' ' || string_split(title, ' ')[2] ELSE '' END))), '_', dates[i], '_',
      lower(COALESCE(times[i], times[1], 'TBD')[1:2]), '_', type) AS k
  FROM (SELECT *, unnest(range(1, len(dates) + 1)) AS i FROM listing)),
known AS MATERIALIZED (SELECT DISTINCT k FROM pairs WHERE k LIKE 'red %'),
open0 AS MATERIALIZED (SELECT * FROM pairs WHERE ord NOT IN (SELECT ord FROM pairs SEMI JOIN known USING (k)))"""]
    for i in range(n):
        parts.append(f"""
win{i} AS MATERIALIZED (SELECT ord FROM (SELECT ord, ord = min(ord) OVER (PARTITION BY k) AS w FROM open{i}) GROUP BY ord HAVING bool_and(w)),
open{i + 1} AS MATERIALIZED (SELECT * FROM open{i} WHERE ord NOT IN (
   SELECT ord FROM open{i} WHERE k IN (SELECT k FROM open{i} SEMI JOIN win{i} USING (ord))))""")
    return ",".join(parts)


N_ROUNDS = 12


@query("j06_new_listings", with_(SCREENING, LISTING, _rounds(N_ROUNDS)) + " SELECT ord FROM (" + " UNION ALL ".join(
    f"SELECT ord FROM win{i}" for i in range(N_ROUNDS)) + f" UNION ALL SELECT DISTINCT ord || '?' FROM open{N_ROUNDS})")
def j06(spark, sf):
    shows = listing_shows(spark, sf)
    known = shows.where(F.col("showing_key").startswith("red ")).select("showing_key")
    return J.new_listings(shows, known)


@query("j07_new_names", """
  WITH c AS (SELECT c_custkey AS ord, concat(' Club  ', c_custkey % 97, CASE WHEN c_custkey % 2 = 0 THEN ' HALL' ELSE ' hall' END) AS name FROM customer),
  n AS (SELECT *, lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))) AS name_key FROM c)
  SELECT name_key, ord, name FROM n WHERE name_key NOT IN (SELECT concat('club ', s_suppkey, ' hall') FROM supplier WHERE s_acctbal > 3000)
  QUALIFY row_number() OVER (PARTITION BY name_key ORDER BY ord) = 1""")
def j07(spark, sf):
    k = F.col("c_custkey")
    cand = T.table(spark, sf, "customer").select(k.alias("ord"), F.concat(
        F.lit(" Club  "), (k % 97).cast("string"), F.when(k % 2 == 0, " HALL").otherwise(" hall")).alias("name"))
    known = T.table(spark, sf, "supplier").where("s_acctbal > 3000").select(F.concat(F.lit("Club "), F.col("s_suppkey").cast("string"), F.lit("  Hall ")).alias("name"))
    return J.new_names(cand, known)


# J08, J09, U02, U03 ---------------------------------------------------------------------------
def season_pair(spark, sf):
    """Old season rows and a refresh that loses some of them."""
    rows = T.listing(spark, sf).select("ord", "event_key", "n", "supp_key", "venue", F.trim("title").alias("title"), "dates", "damage")
    text = F.concat(F.lit("An evening with "), "title", F.lit(" and friends"))
    old = rows.withColumns({"program": text, "series": F.lit("Main"), "featured_artist": F.lit("")})
    new = rows.where("supp_key % 9 <> 0 AND damage <> 6").withColumns({
        "dates": F.when(F.col("damage") == 1, F.slice("dates", 1, 1)).otherwise(F.col("dates")),
        "program": F.when(F.col("damage") == 3, "").when(F.col("damage") == 4, "Evening").otherwise(text),
        "series": F.when(F.col("damage") == 0, " ").otherwise("Main"), "featured_artist": F.lit("Somebody"),
        "title": F.upper("title")})
    return old, new


@query("j08_refresh_regressions", with_(SCREENING, LISTING) + """
  , o AS (SELECT *, trim(title) AS t FROM listing), n AS (SELECT * FROM o WHERE supp_key % 9 <> 0 AND event_key % 7 <> 6),
  oi AS (SELECT * FROM o WHERE t <> '' QUALIFY row_number() OVER (PARTITION BY venue, lower(t) ORDER BY ord DESC) = 1),
  ni AS (SELECT venue, t, event_key % 7 AS damage, CASE WHEN event_key % 7 = 1 THEN dates[1:1] ELSE dates END AS new_dates FROM n WHERE t <> ''
         QUALIFY row_number() OVER (PARTITION BY venue, lower(t) ORDER BY ord DESC) = 1),
  j AS (SELECT oi.venue, oi.t AS title, oi.dates, ni.damage, new_dates FROM oi LEFT JOIN ni USING (venue, t) WHERE oi.venue IN (SELECT venue FROM n)),
  lost AS (SELECT venue, title, list_sort(list_distinct(list_filter(dates, lambda x: NOT list_contains(new_dates, x)))) AS gone FROM j WHERE damage IS NOT NULL)
  SELECT venue, NULL AS title, concat('would drop all ', count(*), ' events') AS problem FROM o WHERE venue NOT IN (SELECT venue FROM n) GROUP BY venue
  UNION ALL SELECT venue, title, 'disappeared' FROM j WHERE damage IS NULL
  UNION ALL SELECT venue, title, concat('lost dates ', array_to_string(gone, ', ')) FROM lost WHERE len(gone) > 0
  UNION ALL SELECT venue, title, 'blanked program' FROM j WHERE damage = 3
  UNION ALL SELECT venue, title, concat('program shrank from ', len(title) + 28, ' to 7') FROM j WHERE damage = 4
  UNION ALL SELECT venue, title, 'blanked series' FROM j WHERE damage = 0""")
def j08(spark, sf):
    return J.refresh_regressions(*season_pair(spark, sf))


def scraped(spark, sf):
    """The showings with a fifth of them lost, titles in capitals with curly quotes."""
    s = T.screening(spark, sf)
    return s.where("n <> 5").select(title_key(F.concat(F.upper("title"), F.lit(" ’x "))).alias("title_key"), "date", "time")


def truth(spark, sf):
    return T.screening(spark, sf).select(title_key(F.concat("title", F.lit(" 'X"))).alias("title_key"), "date", "time")


TRIPLES = """
t AS (SELECT DISTINCT concat(lower(title), ' ''x') AS title_key, date, time FROM screening),
h AS (SELECT DISTINCT concat(lower(title), ' ''x') AS title_key, date, time FROM screening WHERE n <> 5),
m AS (SELECT * FROM t EXCEPT SELECT * FROM h)"""


@query("j09_coverage", with_(SCREENING, TRIPLES) + """
  SELECT e AS expected, e - x AS found, (e - x) / e AS coverage FROM (SELECT count(*) AS e FROM t), (SELECT count(*) AS x FROM m)""")
def j09(spark, sf):
    return Q.coverage_vs_truth(scraped(spark, sf), truth(spark, sf))[0]


@query("j09_missing", with_(SCREENING, TRIPLES) + " SELECT * FROM m")
def j09_missing(spark, sf):
    return Q.coverage_vs_truth(scraped(spark, sf), truth(spark, sf))[1]


@query("u02_lost_keys", with_(SCREENING, TRIPLES) + " SELECT DISTINCT title_key, date FROM t EXCEPT SELECT title_key, date FROM h")
def u02(spark, sf):
    return J.lost_keys(truth(spark, sf), scraped(spark, sf), ["title_key", "date"])


@query("u03_common_keys", with_(SCREENING) + """
  SELECT DISTINCT lower(title) AS title FROM screening WHERE supp_key % 2 = 0
  INTERSECT SELECT lower(title) FROM screening WHERE supp_key % 2 = 1""")
def u03(spark, sf):
    s = T.screening(spark, sf).withColumn("title", F.lower("title"))
    return J.common_keys(s.where("supp_key % 2 = 0"), s.where("supp_key % 2 = 1"), ["title"])


# J11, J12, J13, J14 ---------------------------------------------------------------------------
@query("j11_dossier", with_(SCREENING, PERSON, EVENT_PERSON) + """
  , e AS (SELECT *, CAST(right(person, 9) AS BIGINT) AS pk FROM event_person),
  d AS (SELECT e.*, a.text AS person_text, b.text AS film_text,
     CASE WHEN type IN ('movie', 'screening') THEN 'Director'
          WHEN type IN ('concert', 'opera') THEN concat('Composer ', person) END AS role
    FROM e LEFT JOIN documents a ON a.doc_id = pk LEFT JOIN documents b ON type = 'movie' AND b.doc_id = event_key)
  SELECT event_key, concat_ws(chr(10),
     CASE WHEN role IS NOT NULL AND person_text IS NOT NULL THEN concat(role, ': ', person_text[1:300], '…') END,
     CASE WHEN type IN ('concert', 'opera') AND person_text IS NOT NULL THEN concat('Featured Artist: ', person_text[1:300], '…') END,
     CASE WHEN film_text IS NOT NULL THEN concat('Viewer rating: ', event_key % 5, '/5') END,
     CASE WHEN film_text IS NOT NULL THEN concat('Popular review: ', film_text[1:200], '…') END) AS dossier FROM d""")
def j11(spark, sf):
    docs = T.table(spark, sf, "documents")
    names = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("name"))
    person_fact = docs.join(names, "doc_id").select("name", F.col("text").alias("extract"))
    rows = T.event(spark, sf, person=True)
    rows = rows.withColumns({
        "release_year": F.col("event_key"), "director": F.col("person"), "featured_artist": F.col("person"),
        "composers": F.array("person", F.lit("Nobody"), F.col("person"))})
    film_fact = rows.where("type = 'movie'").select("title", "release_year").join(
        docs, F.col("release_year") == F.col("doc_id")).select(
        "title", "release_year", (F.col("doc_id") % 5).alias("rating"), F.col("text").alias("excerpt"))
    return J.attach_dossier(rows, person_fact, film_fact).select("event_key", "dossier")


def short_titles(spark, sf):
    """Titles cut to one or two words, so that some contain others."""
    words = F.when(F.col("n") % 2 == 0, F.substring_index("title", " ", 1)).otherwise(F.substring_index("title", " ", 2))
    return T.screening(spark, sf).select("ord", words.alias("title"), "date", "time")


@query("j12_similarity", with_(SCREENING) + """
  , r AS (SELECT CASE WHEN n % 2 = 0 THEN split_part(title, ' ', 1) ELSE concat(split_part(title, ' ', 1), ' ', split_part(title, ' ', 2)) END AS title, date, time FROM screening),
  g AS (SELECT title, date, time, count(*) AS n FROM r GROUP BY ALL),
  tt AS (SELECT DISTINCT title FROM g),
  p AS (SELECT a.title AS a, b.title AS b FROM tt a, tt b WHERE contains(a.title, b.title) OR contains(b.title, a.title)),
  dt AS (SELECT p.a AS title, date, time, sum(n) AS s FROM g JOIN p ON g.title = p.b GROUP BY ALL),
  dd AS (SELECT p.a AS title, date, sum(n) AS s FROM g JOIN p ON g.title = p.b GROUP BY ALL),
  dn AS (SELECT p.a AS title, sum(n) AS s FROM g JOIN p ON g.title = p.b GROUP BY ALL)
  SELECT g.title, g.date, g.time, g.n, g.n - 1 AS same, CAST(dt.s - g.n AS BIGINT) AS near, CAST(dd.s - dt.s AS BIGINT) AS day,
    CAST(dn.s - dd.s AS BIGINT) AS other_day,
    CAST(CASE WHEN same > 0 THEN 1 WHEN near > 0 THEN 0.9 WHEN dd.s > dt.s THEN 0.7 WHEN dn.s > dd.s THEN 0.4 ELSE 0 END AS DOUBLE) AS best
  FROM g JOIN dt USING (title, date, time) JOIN dd USING (title, date) JOIN dn USING (title)""")
def j12(spark, sf):
    return J.similarity(short_titles(spark, sf))


CLASSES = """
  , r AS (SELECT ord, CASE WHEN n % 2 = 0 THEN split_part(title, ' ', 1) ELSE concat(split_part(title, ' ', 1), ' ', split_part(title, ' ', 2)) END AS title, date, time FROM screening),
  g AS (SELECT title, date, time, min(ord) AS class FROM r GROUP BY ALL)"""


@query("j12_similar_pairs", with_(SCREENING) + CLASSES + """
  SELECT least(x.class, y.class) AS a, greatest(x.class, y.class) AS b, CAST(0.9 AS DOUBLE) AS score
  FROM g x JOIN g y USING (date, time) WHERE x.title <> y.title AND contains(x.title, y.title)""")
def j12_pairs(spark, sf):
    return J.similar_pairs(short_titles(spark, sf))[0]


@query("j12_similar_members", with_(SCREENING) + CLASSES + " SELECT ord, class FROM r JOIN g USING (title, date, time)")
def j12_members(spark, sf):
    return J.similar_pairs(short_titles(spark, sf))[1]


@query("j02_overrides_from_table", with_(SCREENING, EVENT) + """
  , rule AS (SELECT p_partkey AS rule_no, split_part(p_name, ' ', 1) AS needle, CASE WHEN p_partkey % 3 = 0 THEN concat('Supplier#', lpad(CAST(p_partkey % 10 AS VARCHAR), 9, '0')) END AS venue, p_size AS rating FROM part)
  SELECT event_key, min(rule_no) AS rule_no, CAST(min_by(rule.rating, rule_no) AS INTEGER) AS rating
  FROM event LEFT JOIN rule ON contains(lower(title), needle) AND (rule.venue IS NULL OR rule.venue = event.venue) GROUP BY event_key""")
def j02_table(spark, sf):
    k = F.col("p_partkey")
    rules = T.table(spark, sf, "part").select(
        k.alias("rule_no"), F.substring_index("p_name", " ", 1).alias("title"), F.col("p_size").alias("rating"),
        F.when(k % 3 == 0, F.concat(F.lit("Supplier#"), F.lpad((k % 10).cast("string"), 9, "0"))).alias("venue"))
    out = J.apply_overrides(T.event(spark, sf), rules)
    return out.select("event_key", F.col("override.rule_no").cast("long").alias("rule_no"), F.col("override.rating").cast("int").alias("rating"))


@query("j12_pair_score", with_(SCREENING) + """
  , f AS (SELECT event_key, min_by(title, ord) AS t, min_by(date, ord) AS date, min_by(time, ord) AS time FROM screening GROUP BY event_key),
  p AS (SELECT s.ord, s.title, s.date = f.date AS same_date, s.time = f.time AS same_time,
    CASE event_key % 4 WHEN 0 THEN concat(' ', upper(f.t)) WHEN 1 THEN split_part(f.t, ' ', 1) WHEN 2 THEN f.t || ' again' ELSE ' ' END AS other
    FROM screening s JOIN f USING (event_key))
  SELECT ord, CAST(CASE WHEN trim(other) = '' THEN 0 WHEN lower(trim(other)) = lower(title) AND same_date AND same_time THEN 1
    WHEN same_date AND same_time THEN 0.9 WHEN same_date THEN 0.7 ELSE 0.4 END AS DOUBLE) AS score FROM p""")
def j12_pair(spark, sf):
    from showbill.operators.grouping import first_row

    shows, k = T.screening(spark, sf), F.col("event_key")
    other = F.when(k % 4 == 0, F.concat(F.lit(" "), F.upper("title"))).when(k % 4 == 1, F.substring_index("title", " ", 1)).when(
        k % 4 == 2, F.concat("title", F.lit(" again"))).otherwise(" ")
    first = first_row(shows, ["event_key"], ["title", "date", "time"]).select(
        "event_key", F.struct(other.alias("title"), "date", "time").alias("first"))
    return shows.join(first, "event_key").select("ord", J.pair_score(F.struct("title", "date", "time"), F.col("first")).alias("score"))


@query("j13_attach_policy", with_(SCREENING) + """
  SELECT ord, supp_key % 4 IN (0, 3) AS to_classify, CASE WHEN supp_key % 4 = 1 THEN 'concert' END AS event_category FROM screening""")
def j13(spark, sf):
    policy = T.table(spark, sf, "supplier").where("s_suppkey % 4 <> 3").select(
        F.col("s_name").alias("venue"), (F.col("s_suppkey") % 4 == 0).alias("classify"),
        F.when(F.col("s_suppkey") % 4 == 2, "puppetry").otherwise("concert").alias("assumed"))
    return J.attach_policy(T.screening(spark, sf), policy).select("ord", "to_classify", "event_category")


@query("j14_cross_links", with_(SCREENING, PERSON, EVENT_PERSON) + """
  , e AS (SELECT *, replace(lower(venue), '#', '-') AS vs, replace(lower(person), '#', '-') AS ps FROM event_person)
  SELECT vs AS slug, event_key, 'venue' AS kind FROM e WHERE vs IN (SELECT replace(lower(s_name), '#', '-') FROM supplier WHERE s_acctbal > 0)
  UNION ALL SELECT ps, event_key, 'person' FROM e WHERE type IN ('movie', 'concert', 'opera', 'book_club')
    AND ps IN (SELECT replace(lower(c_name), '#', '-') FROM customer WHERE c_acctbal > 0)""")
def j14(spark, sf):
    venues = T.table(spark, sf, "supplier").where("s_acctbal > 0").select(slug(F.col("s_name"), "cross").alias("slug"))
    people = T.table(spark, sf, "customer").where("c_acctbal > 0").select(slug(F.col("c_name"), "cross").alias("slug"))
    return J.cross_links(T.event(spark, sf, person=True), venues, people)
