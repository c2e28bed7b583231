"""Review text: refusals, scores, confidence, sections, hooks, and the gates built on them."""

from pyspark.sql import functions as F

from showbill.catalog.base import SCREENING, query, with_
from showbill.catalog.normalize import arms, raw
from showbill.functions import facts as A
from showbill.functions import review as R
from showbill.operators import filters as FL
from showbill.operators import quality as Q
from showbill.sources import tables as T
from showbill.values import NON_JUDGEMENT_PATTERNS, REFUSAL_PATTERNS, REFUSAL_STUB, SCORE_PATTERNS, THIN_EVIDENCE


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


REFUSAL_SQL = lit("(?i)" + "|".join(REFUSAL_PATTERNS))
NONJ_SQL = lit("(?i)" + "|".join(NON_JUDGEMENT_PATTERNS))

#: Documents with wording mixed in that the rules react to; both engines read it.
RAW_REPLY = """CASE doc_id % 11
  WHEN 0 THEN concat('I cannot locate any review of this work. ', text)
  WHEN 1 THEN concat(text, ' However, the Search Results do not say more.')
  WHEN 2 THEN concat('There is insufficient evidence for a verdict. ', text)
  WHEN 3 THEN concat(text, ' I''m unable to say.')
  WHEN 4 THEN 'I cannot verify'
  WHEN 5 THEN concat('Could not verify the cast. ', text)
  WHEN 6 THEN ''
  WHEN 7 THEN concat('The available documentation is thin; no artist is named. ', text)
  WHEN 8 THEN concat(text, ' The works are not described.')
  ELSE text END"""


def replies(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id", "lang", "source", F.expr(RAW_REPLY).alias("raw"))


@query("p21_refusal", f"""
  WITH r AS (SELECT doc_id, {RAW_REPLY} AS raw FROM documents),
  j AS (SELECT *, len(trim(raw, ' ' || chr(10))) >= 40 AND regexp_matches(raw, {REFUSAL_SQL}) AS refused FROM r)
  SELECT doc_id, refused, CASE WHEN refused THEN {lit(REFUSAL_STUB)} ELSE raw END AS text FROM j""")
def p21(spark, sf):
    return replies(spark, sf).select("doc_id", R.is_refusal(F.col("raw")).alias("refused"), R.filter_refusal(F.col("raw")).alias("text"))


@query("p21_clean_refusals", f"""
  WITH r AS (SELECT doc_id, {RAW_REPLY} AS raw, CASE WHEN doc_id % 4 = 0 THEN 'I cannot create a hook, this would be speculative.' ELSE lang END AS hook FROM documents),
  j AS (SELECT *, len(trim(raw, ' ' || chr(10))) >= 40 AND regexp_matches(raw, {REFUSAL_SQL}) AS a, doc_id % 4 = 0 AS b FROM r)
  SELECT doc_id, concat_ws(',', CASE WHEN a THEN 'description' END, CASE WHEN b THEN 'one_liner_summary' END) AS changed,
    CASE WHEN b THEN {lit(REFUSAL_STUB)} ELSE hook END AS hook FROM j""")
def p21_clean(spark, sf):
    hook = F.when(F.col("doc_id") % 4 == 0, "I cannot create a hook, this would be speculative.").otherwise(F.col("lang"))
    rows = replies(spark, sf).select("doc_id", F.col("raw").alias("description"), hook.alias("one_liner_summary"))
    out = FL.clean_refusals(rows)
    return out.select("doc_id", F.array_join("changed", ",").alias("changed"), F.col("one_liner_summary").alias("hook"))


SCORE_HEAD = """CASE doc_id % 9 WHEN 0 THEN '★ Rating: [7.5/10] ' WHEN 1 THEN '★ rating: 8/10 ' WHEN 2 THEN 'Overall [9/10] '
  WHEN 3 THEN 'Rating: 2.5/10, or 9/10 ' WHEN 4 THEN 'a 3.6/10 night ' WHEN 5 THEN '★ Rating: 14/10 ' WHEN 6 THEN 'maybe [1/10] RATING: 6/10 '
  WHEN 7 THEN '0.5/10 ' ELSE 'no score ' END"""
RAW_SCORED = f"concat({SCORE_HEAD}, replace(text, '\n\n', '\n'), ' [3] as said [12].\n\nSources: one, two\nthree\n\nThe end. NOTE ON SOURCES: gone')"


SCORES_SQL = "COALESCE(" + ", ".join(f"nullif(regexp_extract(raw, {lit('(?i)' + p)}, 1), '')" for p in SCORE_PATTERNS) + ", '5')"
NOTE_SQL = "(?is)(?:NOTE ON SOURCES|NOTE ON SOURCE|SOURCES?|SOURCE NOTES?)\\s*:.*?(\\n\\n|\\z)"


@query("p22_parse_score", f"""
  WITH r AS (SELECT doc_id, {RAW_SCORED} AS raw FROM documents)
  SELECT doc_id, CAST(greatest(0, least(10, round_even(CAST({SCORES_SQL} AS DOUBLE), 0))) AS INTEGER) AS score,
    trim(regexp_replace(regexp_replace(raw, '\\[\\d+\\]', '', 'g'), '{NOTE_SQL}', '\\1', 'g'), ' ' || chr(10)) AS summary FROM r""")
def p22(spark, sf):
    docs = T.table(spark, sf, "documents")
    return docs.select("doc_id", R.parse_response(F.expr(RAW_SCORED)).alias("p")).select("doc_id", "p.score", "p.summary")


@query("p23_confidence", f"""
  WITH r AS (SELECT doc_id, {RAW_REPLY} AS raw FROM documents)
  SELECT doc_id, CASE WHEN raw = '' OR (len(trim(raw, ' ' || chr(10))) >= 40 AND regexp_matches(raw, {REFUSAL_SQL}))
    OR {' OR '.join(f"contains(lower(raw), {lit(p)})" for p in THIN_EVIDENCE)} THEN 'low' ELSE 'high' END AS confidence FROM r""")
def p23(spark, sf):
    return replies(spark, sf).select("doc_id", R.confidence(F.col("raw")).alias("confidence"))


@query("p25_non_judgement", f"""
  WITH r AS (SELECT doc_id, {RAW_REPLY} AS raw FROM documents)
  SELECT doc_id, regexp_matches(raw, {NONJ_SQL}) AS declined FROM r""")
def p25(spark, sf):
    return replies(spark, sf).select("doc_id", R.is_non_judgement(F.col("raw")).alias("declined"))


# P24 ----------------------------------------------------------------------------------------
#: Four paragraphs: rating, a bold label, an orphan header and a body without a label.
RAW_REVIEW = """concat('<p>★ Rating: ', CAST(doc_id % 11 AS STRING), '/10</p>',
  '<p><strong>🎭 Artistic Merit</strong> – ', text, '</p><p><STRONG>Originality:</STRONG></p>',
  '<p>✨ ', CASE WHEN doc_id % 4 = 0 THEN 'No artist is named. ' ELSE '' END, source, ' ', lang, '</p>')"""


@query("p24_review_sections", """
  WITH t AS (SELECT doc_id, source, lang, trim(text, ' ' || chr(10)) AS body FROM documents)
  SELECT doc_id, CAST(0 AS INTEGER) AS pos, CAST(doc_id % 11 AS VARCHAR) AS rating, '' AS label, '' AS emoji, '' AS body FROM t
  UNION ALL SELECT doc_id, 1, NULL, '🎭 Artistic Merit', '🎭', body FROM t
  UNION ALL SELECT doc_id, 2, NULL, 'Originality:', '', '' FROM t
  UNION ALL SELECT doc_id, 3, NULL, '', '✨', concat('✨ ', CASE WHEN doc_id % 4 = 0 THEN 'No artist is named. ' ELSE '' END, source, ' ', lang) FROM t""")
def p24(spark, sf):
    docs = T.table(spark, sf, "documents").select("doc_id", F.expr(RAW_REVIEW).alias("html"))
    out = Q.review_sections(docs, "doc_id", "html", "digest")
    rated = F.col("rating").isNotNull()
    return out.select("doc_id", "pos", "rating", F.when(rated, "").otherwise(F.col("label")).alias("label"),
                      F.when(rated, "").otherwise(F.col("emoji")).alias("emoji"), F.when(rated, "").otherwise(F.col("body")).alias("body"))


@query("p24_reader_sections", """
  WITH t AS (SELECT doc_id, source, lang, trim(text, ' ' || chr(10)) AS body FROM documents)
  SELECT doc_id, 'Artistic Merit' AS label, '🎭' AS emoji, body FROM t
  UNION ALL SELECT doc_id, 'Originality', '✨', concat(source, ' ', lang) FROM t WHERE doc_id % 4 <> 0""")
def p24_reader(spark, sf):
    docs = T.table(spark, sf, "documents").select("doc_id", F.expr(RAW_REVIEW).alias("html"))
    kept, _ = Q.reader_sections(docs, "doc_id", "html")
    return kept.select("doc_id", "label", "emoji", "body")


@query("p24_declined", """
  SELECT doc_id, CAST(CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS BIGINT) AS declined FROM documents WHERE doc_id % 4 = 0""")
def p24_declined(spark, sf):
    docs = T.table(spark, sf, "documents").select("doc_id", F.expr(RAW_REVIEW).alias("html"))
    return Q.reader_sections(docs, "doc_id", "html")[1]


# P27 ----------------------------------------------------------------------------------------
RAW_HOOK = arms(
    "event_key", "concat('\"', title, ' unfolds with quiet menace at ', venue, '\"')",
    "concat('Summary: ', title, ' lights up the night')", "concat('Here''s a summary: ', title, ' dances on\nand on')",
    "'I cannot create a summary'", "concat(title, ' is a festival of sorts')", "concat(title, ' burns slowly but surely\" This 10-word thing')",
    "'Too short'", "concat('An analysis of ', title, ' in full')", "concat('Slow and ', substring(title, 1, 4), '...')",
    "concat(title, ' ', repeat('very ', 40), 'long')",
)


@query("p27_clean_hook", with_(SCREENING) + """
  SELECT ord, CASE event_key % 10 WHEN 0 THEN concat(title, ' unfolds with quiet menace at ', venue)
    WHEN 1 THEN concat(title, ' lights up the night') WHEN 2 THEN concat(title, ' dances on and on')
    WHEN 5 THEN concat(title, ' burns slowly but surely')
    WHEN 9 THEN CASE WHEN len(title) + 210 <= 140 THEN '' ELSE concat(rtrim(concat(title, ' ', repeat('very ', 40))[1:
      139 - position(' ' IN reverse(concat(title, ' ', repeat('very ', 40))[1:139]))], ',;:.- '), '…') END END AS hook FROM screening""")
def p27(spark, sf):
    return raw(spark, sf, RAW_HOOK).select("ord", R.clean_hook(F.col("raw")).alias("hook"))


# F11, F12, F13 --------------------------------------------------------------------------------
RAW_GATE = arms("event_key", "title", "concat('The ', title, ' Gala')", "concat('Lecture on ', title)", "concat('A Season Of ', title, ' series')",
                "concat(title, ' Retrospective')", "concat('Monthly Meeting: ', title)", "concat('Reading Group ', title)", "concat('Tribute to ', title)")


@query("f11_is_specific", with_(SCREENING) + """
  , g AS (SELECT ord, event_key, type, n, supp_key % 2 = 0 AS known, supp_key % 3 = 0 AS long_text, type = 'book_club' AND supp_key % 2 = 0 AS has_book FROM screening)
  SELECT ord, CASE WHEN long_text AND known THEN TRUE
    WHEN event_key % 8 IN (2, 4, 5) THEN FALSE
    WHEN event_key % 8 IN (1, 7) THEN known
    WHEN event_key % 8 = 3 THEN has_book
    WHEN event_key % 8 = 6 THEN NOT (type = 'book_club' AND NOT has_book)
    ELSE TRUE END AS specific FROM g""")
def f11(spark, sf):
    rows = raw(spark, sf, RAW_GATE)
    known = F.col("supp_key") % 2 == 0
    club = F.col("type") == "book_club"
    none = F.lit(None).cast("string")
    text = F.when(F.col("supp_key") % 3 == 0, F.repeat(F.lit("word "), 120)).otherwise("short")
    return rows.select("ord", A.is_specific(
        F.col("raw"), text, F.col("type"), F.when(known & club, "A Book"), none, F.when(known & ~club, "A Director"), none,
        F.lit(None).cast("array<string>")).alias("specific"))


RAW_EVENING = arms("event_key", "title", "concat(title, ' Workshop')", "concat('Opening Night: ', title)", "concat('Cocktail PARTY ', title)", "title")


@query("f12_is_film_listing", with_(SCREENING) + """
  SELECT ord, event_key % 5 IN (0, 4) AND supp_key % 10 <> 0 AS film FROM screening""")
def f12(spark, sf):
    text = F.when(F.col("supp_key") % 10 == 0, "followed by a panel").otherwise("a quiet tale")
    return raw(spark, sf, RAW_EVENING).select("ord", A.is_film_listing(F.col("raw"), text).alias("film"))


@query("f13_split_confidence", f"""
  WITH r AS (SELECT doc_id, {RAW_REPLY} AS raw FROM documents),
  c AS (SELECT doc_id, raw = '' OR (len(trim(raw, ' ' || chr(10))) >= 40 AND regexp_matches(raw, {REFUSAL_SQL}))
    OR {' OR '.join(f"contains(lower(raw), {lit(p)})" for p in THIN_EVIDENCE)} AS low FROM r)
  SELECT doc_id, CASE WHEN low THEN 'research' ELSE 'listing' END AS list FROM c""")
def f13(spark, sf):
    rows = replies(spark, sf).select("doc_id", R.confidence(F.col("raw")).alias("review_confidence"))
    listed, research = FL.split_confidence(rows)
    return listed.select("doc_id", F.lit("listing").alias("list")).unionByName(research.select("doc_id", F.lit("research").alias("list")))
