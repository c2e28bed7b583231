"""Text functions: slugs, keys, mark-up, trims, names."""

from pyspark.sql import functions as F

from showbill.catalog.base import EVENT, PERSON, SCREENING, query, with_
from showbill.catalog.normalize import arms, raw
from showbill.catalog.ranking import DIGEST, FIRST, WEEK
from showbill.functions import facts as A
from showbill.functions import text as X
from showbill.operators import grouping as G
from showbill.operators import normalize as N
from showbill.plans.digest import weekly_digest
from showbill.sources import tables as T
from showbill.values import (
    BANNED_REPLACEMENTS, CALENDAR_TAGS, LABELS_API, LABELS_DIGEST, LABELS_READER, TEMPLATE_FIELDS,
    TEMPLATE_REQUIRED, PIPELINE_FIELDS,
)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# P13, P36 -----------------------------------------------------------------------------
RAW_BOOK = arms("event_key", "concat(title, ' by Ann by the Sea by ', venue)", "title", "concat('Night Club: ', title, ': two')",
                "concat(title, '  at  RED  Hall ')")


@query("p13_title_cleaning", with_(SCREENING) + """
  SELECT ord, CASE event_key % 4 WHEN 0 THEN concat(title, ' by Ann by the Sea') WHEN 1 THEN title
      WHEN 2 THEN concat('Night Club: ', title, ': two') ELSE concat(title, '  at  RED  Hall') END AS book,
    CASE WHEN event_key % 4 = 0 THEN venue END AS author,
    CASE event_key % 4 WHEN 0 THEN concat(title, ' by Ann by the Sea by ', venue) WHEN 1 THEN title WHEN 2 THEN 'Night Club'
      ELSE concat(title, '  at  RED  Hall') END AS series,
    CASE event_key % 4 WHEN 0 THEN concat(title, ' by Ann by the Sea by ', venue) WHEN 2 THEN concat('Night Club: ', title, ': two')
      ELSE title END AS bare FROM screening""")
def p13(spark, sf):
    s = X.split_by_author(F.col("raw"))
    return raw(spark, sf, RAW_BOOK).select(
        "ord", s["book"].alias("book"), s["author"].alias("author"), X.series_of(F.col("raw")).alias("series"),
        X.strip_suffix(F.col("raw"), "Red Hall").alias("bare"))


@query("p36_title_key", with_(SCREENING) + """
  SELECT ord, concat('o''', lower(title), ' ''x''') AS match_key, lower(concat('O’', title, ' ‘X’')) AS lower_key,
    upper(concat('O’', title, ' ‘X’')) AS upper_key FROM screening""")
def p36(spark, sf):
    t = F.concat(F.lit("  O’"), "title", F.lit(" ‘X’ "))
    return T.screening(spark, sf).select(
        "ord", X.title_key(t).alias("match_key"), X.title_key(t, "lower").alias("lower_key"), X.title_key(t, "upper").alias("upper_key"))


# P15 ------------------------------------------------------------------------------------
RAW_SLUG = arms("event_key", "concat(title, ' Café: Straße')", "concat('  ', upper(title), ' “Noël”, 3.5_b ')", "'***'", "''",
                "concat(title, ' — Ñandú''s')")


def _fold(expr):
    return f"regexp_replace(strip_accents({expr}), '[^\\x00-\\x7F]', '', 'g')"


def _hyphen(expr, keep="a-z0-9"):
    return f"regexp_replace(lower({expr}), '[^{keep}]+', '-', 'g')"


@query("p15_slugs", with_(SCREENING) + f"""
  , r AS (SELECT ord, {RAW_SLUG} AS raw FROM screening)
  SELECT ord, trim({_hyphen(_fold('raw'))}, '-') AS plain,
    CASE WHEN trim({_hyphen(_fold('raw'))}, '-') = '' THEN 'event' ELSE trim({_hyphen(_fold('raw'))}, '-') END AS safe,
    replace(replace(replace(replace(replace(lower(raw), ' ', '-'), '''', ''), '"', ''), ':', ''), ',', '') AS event_id,
    regexp_replace(regexp_replace({_hyphen('raw', 'a-z0-9._-')}, '^[-.]+|[-.]+$', '', 'g'), '-{{2,}}', '-', 'g') AS file,
    trim({_hyphen('trim(raw)')}, '-') AS cross,
    CASE WHEN raw = '' THEN '' WHEN trim({_hyphen('strip_accents(raw)')}, '-') = '' THEN 'event'
      ELSE trim({_hyphen('strip_accents(raw)')}, '-') END AS share FROM r""")
def p15(spark, sf):
    return raw(spark, sf, RAW_SLUG).select("ord", *[X.slug(F.col("raw"), d).alias(d) for d in X.SLUG_DIALECTS])


#: Words that only compatibility decompositions fold, and what is left of them.
UNICODE = (("5 ㎏ of 𝐀bc", "5 kg of abc"), ("㏑ Ⅷ", "ln viii"), ("Ｆｕｌｌ ǅ", "full dz"), ("ﷺ ½ €", "12"), ("", ""), ("한글 ẞ", ""))


@query("p15_unicode_slugs", with_(SCREENING) + f"""
  SELECT ord, trim({_hyphen("concat(title, ' ', CASE event_key % 6 " + ' '.join(f"WHEN {i} THEN '{p}'" for i, (_, p) in enumerate(UNICODE)) + " END)")}, '-') AS plain
  FROM screening""")
def p15_unicode(spark, sf):
    word = F.element_at(F.array(*[F.lit(u) for u, _ in UNICODE]), (F.col("event_key") % 6 + 1).cast("int"))
    return T.screening(spark, sf).select("ord", X.slug(F.concat("title", F.lit(" "), word)).alias("plain"))


@query("p15_slug_of_text", f"""
  SELECT doc_id, trim({_hyphen(_fold('text'))}, '-') AS plain FROM documents""")
def p15_text(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id", X.slug(F.col("text")).alias("plain"))


# P16 ------------------------------------------------------------------------------------
RAW_ADDRESS = arms(
    "event_key", "concat(CAST(event_key AS STRING), ' Elm St, Red Town, TX 78', lpad(CAST(event_key % 1000 AS STRING), 3, '0'))",
    "'Austin, TX'", "concat('Hall ', CAST(event_key AS STRING))", "'1 Main St, Suite 4, Waco, TX'", "''",
    "concat('9 Oak Rd, Elgin, TX 78621-', lpad(CAST(event_key % 10000 AS STRING), 4, '0'))")


@query("p16_address_parts", with_(SCREENING) + """
  SELECT ord,
    CASE event_key % 6 WHEN 0 THEN concat(event_key, ' Elm St') WHEN 2 THEN concat('Hall ', event_key) WHEN 3 THEN '1 Main St, Suite 4'
      WHEN 5 THEN '9 Oak Rd' ELSE '' END AS street,
    CASE event_key % 6 WHEN 0 THEN 'Red Town' WHEN 1 THEN 'Austin' WHEN 3 THEN 'Waco' WHEN 5 THEN 'Elgin' ELSE '' END AS locality,
    CASE WHEN event_key % 6 IN (0, 1, 3, 5) THEN 'TX' ELSE '' END AS region,
    CASE event_key % 6 WHEN 0 THEN concat('78', lpad(CAST(event_key % 1000 AS VARCHAR), 3, '0'))
      WHEN 5 THEN concat('78621-', lpad(CAST(event_key % 10000 AS VARCHAR), 4, '0')) ELSE '' END AS postal FROM screening""")
def p16(spark, sf):
    return raw(spark, sf, RAW_ADDRESS).select("ord", X.address_parts(F.col("raw")).alias("a")).select("ord", "a.*")


# P19, P20 -------------------------------------------------------------------------------
RAW_MD = "concat('## ', source, '\n**Lang** ', lang, ' is *', source, '*\n\n### ', text)"


@query("p19_md_to_html", f"""
  WITH m AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace({RAW_MD}, '(?m)^#{{1,6}}\\s*', '', 'g'),
     '\\*\\*(.*?)\\*\\*', '<strong>\\1</strong>', 'g'), '\\*(.*?)\\*', '<em>\\1</em>', 'g') AS x FROM documents)
  SELECT doc_id, concat('<p>', replace(replace(x, chr(10) || chr(10), '</p><p>'), chr(10), '<br>'), '</p>') AS html FROM m""")
def p19(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id", X.md_to_html(F.expr(RAW_MD)).alias("html"))


def _banned_sql(expr: str) -> str:
    for phrase, plain in BANNED_REPLACEMENTS.items():
        expr = f"regexp_replace({expr}, '(?i)\\b{phrase}\\b', '{plain}', 'g')"
    return expr


PHRASES = list(BANNED_REPLACEMENTS)
RAW_BANNED = "concat('A ', CASE doc_id % 18 " + " ".join(
    f"WHEN {i} THEN {quoted(p if i % 2 else p.title())}" for i, p in enumerate(PHRASES)) + " END, ' work. ', text, ' It is lush, hauntingly so.')"


@query("p20_replace_banned", f"SELECT doc_id, {_banned_sql(RAW_BANNED)} AS text FROM documents")
def p20(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id", X.replace_banned(F.expr(RAW_BANNED)).alias("text"))


# P26 ------------------------------------------------------------------------------------
@query("p26_trims", """
  WITH h AS (SELECT doc_id, text, text[1:139] AS head, text[1:240] AS big, trim(text, ' ' || chr(10)) AS plain FROM documents),
  cuts AS (SELECT *, CASE WHEN contains(head, ' ') THEN len(head) - position(' ' IN reverse(head)) ELSE -1 END AS cut_at,
     plain[1:240] AS p240 FROM h)
  SELECT doc_id,
    CASE WHEN len(text) <= 140 THEN text ELSE concat(rtrim(text[1:CASE WHEN cut_at < 80 THEN 139 ELSE cut_at END], ',;:.- '), '…') END AS trimmed,
    CASE WHEN len(text) <= 800 THEN text ELSE concat(rtrim(text[1:799], ' ' || chr(10)), '…') END AS truncated,
    CASE WHEN len(plain) <= 240 THEN plain
      WHEN contains(p240, '. ') AND len(p240) - position(' .' IN reverse(p240)) - 1 >= 120
        THEN p240[1:len(p240) - position(' .' IN reverse(p240))]
      WHEN contains(p240, '! ') AND len(p240) - position(' !' IN reverse(p240)) - 1 >= 120
        THEN p240[1:len(p240) - position(' !' IN reverse(p240))]
      ELSE concat(rtrim(CASE WHEN contains(p240, ' ') THEN p240[1:len(p240) - position(' ' IN reverse(p240))] ELSE p240 END, ',;:'), '…') END AS excerpt
  FROM cuts""")
def p26(spark, sf):
    t = F.col("text")
    return T.table(spark, sf, "documents").select(
        "doc_id", X.trim_words(t).alias("trimmed"), X.truncate(t, 800).alias("truncated"), X.excerpt(t).alias("excerpt"))


@query("p26_wrap", with_(SCREENING) + """
  , w AS (SELECT DISTINCT title, venue, string_split(trim(concat(title, ' at the ', venue, ' extraordinarily')), ' ') AS words FROM screening),
  l AS (SELECT *, string_split(list_reduce(list_transform(words, lambda x: CASE WHEN len(x) > 14 THEN concat(x[1:13], '…') ELSE x END),
      lambda acc, x: CASE WHEN len(string_split(acc, chr(10))[-1]) + 1 + len(x) <= 14 THEN concat(acc, ' ', x)
        ELSE concat(acc, chr(10), x) END), chr(10)) AS lines FROM w)
  SELECT title, venue, CASE WHEN len(lines) > 3 THEN concat(array_to_string(lines[1:2], '|'), '|', lines[3][1:13], '…')
    ELSE array_to_string(lines, '|') END AS wrapped FROM l""")
def p26_wrap(spark, sf):
    text = F.concat("title", F.lit(" at the "), "venue", F.lit(" extraordinarily"))
    rows = T.screening(spark, sf).select("title", "venue").distinct()
    return rows.select("title", "venue", F.array_join(X.wrap(text, 14, 3), "|").alias("wrapped"))


# P29, P30 -------------------------------------------------------------------------------
@query("p29_event_context", with_(SCREENING, EVENT) + """
  SELECT event_key, concat('Title: ', title, CASE WHEN event_key % 3 = 0 THEN '' ELSE concat(chr(10), 'Description: ', type, ' night') END,
     chr(10), 'Venue: ', venue, chr(10), 'URL: ', url) AS context,
   concat('Title: ', title, chr(10), 'Series: ', CASE WHEN event_key % 3 = 0 THEN 'unknown' ELSE concat(type, ' night') END) AS details
  FROM event""")
def p29(spark, sf):
    text = F.when(F.col("event_key") % 3 == 0, F.lit("  ")).otherwise(F.concat("type", F.lit(" night")))
    return T.event(spark, sf).select(
        "event_key",
        A.event_context({"Title": F.col("title"), "Description": text, "Venue": F.col("venue"), "URL": F.col("url")}).alias("context"),
        A.detail_block({"Title": F.col("title"), "Series": text}).alias("details"))


@query("p30_html_text", """
  SELECT page_id,
    trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
      '(?i)<(?:(?:p|br|li|div|h[1-4])(?:\\s[^>]*)?/?|/(?:p|li|div|h[1-4])\\s*)>', ' ', 'g'), '</?[A-Za-z!][^>]*>', '', 'g'),
      '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g')) AS visible,
    trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS spaced,
    trim(regexp_replace(html, '<[^>]+>', '', 'g'), ' ' || chr(10)) AS bare FROM pages""")
def p30(spark, sf):
    return T.table(spark, sf, "pages").select(
        "page_id", *[X.html_text(F.col("html"), d).alias(d) for d in ("visible", "spaced", "bare")])


# P31 ------------------------------------------------------------------------------------
RAW_KIND = "CASE WHEN n = 7 THEN 'puppet_show' ELSE type END"


def _label_sql(labels, other):
    return f"CASE {RAW_KIND} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in labels.items()) + f" ELSE {quoted(other)} END"


@query("p31_category_label", with_(SCREENING) + f"""
  SELECT ord, {_label_sql(LABELS_API, 'Puppet Show')} AS api_label, {_label_sql(LABELS_DIGEST, 'Puppet Show')} AS digest_label,
    {_label_sql(LABELS_READER, 'puppet show')} AS reader_label, {_label_sql(CALENDAR_TAGS, 'Event')} AS tags FROM screening""")
def p31(spark, sf):
    kind = F.expr(RAW_KIND)
    return T.screening(spark, sf).select(
        "ord", X.labelled(kind, LABELS_API).alias("api_label"), X.labelled(kind, LABELS_DIGEST).alias("digest_label"),
        X.labelled(kind, LABELS_READER, F.replace(kind, F.lit("_"), F.lit(" "))).alias("reader_label"),
        X.labelled(kind, CALENDAR_TAGS, F.lit("Event")).alias("tags"))


# P35 ------------------------------------------------------------------------------------
RAW_NAME = arms("event_key", "concat(' ', person, ' ')", "'Various Artists'", "'beethoven'", "concat('Consort of ', person)", "' TBA '",
                "'Saint-Saens'", "concat('The ', person, ' Ensemble')", "'N/A'")


@query("p35_clean_name", with_(SCREENING, PERSON) + """
  SELECT ord, CASE event_key % 8 WHEN 0 THEN person WHEN 2 THEN 'Ludwig van Beethoven' WHEN 5 THEN 'Camille Saint-Saëns' END AS name,
    CASE event_key % 8 WHEN 0 THEN person WHEN 2 THEN 'beethoven' WHEN 3 THEN concat('Consort of ', person) WHEN 5 THEN 'Saint-Saens'
      WHEN 6 THEN concat('The ', person, ' Ensemble') END AS plain FROM screening_person""")
def p35(spark, sf):
    rows = T.screening(spark, sf, person=True).withColumn("raw", F.expr(RAW_NAME))
    return rows.select("ord", X.clean_name(F.col("raw")).alias("name"), X.plain_name(F.col("raw")).alias("plain"))


# P37, P38, P43, P44 ------------------------------------------------------------------------
@query("p37_public_shape", with_(SCREENING, EVENT, FIRST) + """
  SELECT translate(lower(title), ' ''":,', '-') AS id, title, type, rating, venue, first_date AS date, first_time AS time, url,
    concat('https://example.org/events/', translate(lower(title), ' ''":,', '-'), '.html') AS shell_url, event_key
  FROM event JOIN first_occ USING (event_key)""")
def p37(spark, sf):
    from showbill.operators.publish import public_shape

    first = G.first_occurrence(T.showings(spark, sf))
    out = public_shape(T.event(spark, sf), first, "https://example.org/")
    return out.select("id", "title", "type", "rating", "venue", "date", "time", "url", "shell_url", "event_key")


@query("p38_cache_keys", """
  SELECT doc_id, concat('extract_', md5(text)[1:16], '_', md5(lang)[1:16]) AS extraction, concat(replace(upper(trim(text)), 'ẞ', 'SS'), '_', lang) AS summary,
    sha1(text) AS digest FROM documents""")
def p38(spark, sf):
    return T.table(spark, sf, "documents").select(
        "doc_id", X.extraction_key(F.col("text"), F.col("lang"), "extract").alias("extraction"),
        X.summary_key(F.col("text"), F.col("lang")).alias("summary"), F.sha1("text").alias("digest"))


@query("p43_share_text", with_(SCREENING, EVENT) + """
  SELECT event_key, CASE WHEN event_key % 2 = 0 THEN concat(title, ' — a night at ', venue) ELSE title END AS text FROM event""")
def p43(spark, sf):
    hook = F.when(F.col("event_key") % 2 == 0, F.concat(F.lit(" a night at "), "venue", F.lit(" "))).otherwise("")
    return T.event(spark, sf).select("event_key", A.share_text(F.col("title"), hook).alias("text"))


@query("p43_week_brief", with_(SCREENING, EVENT, DIGEST) + """
  SELECT concat('Top picks of the week. ', count(*), CASE WHEN count(*) = 1 THEN ' event ahead.' ELSE ' events ahead.' END, ' ',
     string_agg(concat('Pick ', position, ': ', title, ' at ', venue, '.'), ' ' ORDER BY position)) AS brief
  FROM digest WHERE position <= 5""")
def p43_brief(spark, sf):
    from showbill.operators.publish import week_brief

    return week_brief(weekly_digest(spark, sf, WEEK).withColumn("hook", F.lit("")))


def _field_rows():
    rows = []
    for kind, fields in TEMPLATE_FIELDS.items():
        for f in fields:
            rows.append((kind, f, f"The {f} of the {kind}.", f in TEMPLATE_REQUIRED[kind], f in PIPELINE_FIELDS))
    return rows


_FIELDS_SQL = ", ".join(f"({quoted(k)}, {quoted(f)}, {quoted(d)}, {r}, {p})" for k, f, d, r, p in _field_rows())


@query("p44_effective_schema", with_(SCREENING, EVENT) + f"""
  , template(type, field, description, required_on_publish, pipeline_made) AS (VALUES {_FIELDS_SQL}),
  policy AS (SELECT DISTINCT venue AS venue_key, type FROM event),
  venues AS (SELECT s_name AS venue_key, s_suppkey AS k FROM supplier)
  SELECT venue_key, type, field,
    CASE WHEN k % 3 = 0 AND field = 'times' THEN FALSE ELSE required_on_publish END AS required,
    CASE WHEN k % 4 = 0 AND field = 'title' THEN 'Name on the poster.' WHEN k % 3 = 0 AND field = 'times'
      THEN concat(description, ' Doors open earlier.') ELSE description END AS description,
    CASE WHEN k % 3 = 0 AND field = 'times' THEN '19:00' END AS default_value
  FROM policy JOIN template USING (type) JOIN venues USING (venue_key) WHERE NOT pipeline_made""")
def p44(spark, sf):
    template = spark.createDataFrame(
        _field_rows(), "type string, field string, description string, required_on_publish boolean, pipeline_made boolean")
    venue = T.table(spark, sf, "supplier").select(F.col("s_name").alias("venue_key"), F.col("s_suppkey").alias("k"))
    none = F.lit(None).cast("string")
    overrides = venue.where("k % 3 = 0").select(
        "venue_key", F.lit("times").alias("field"), F.lit(False).alias("required"), none.alias("description"),
        F.lit(" Doors open earlier.").alias("description_append"), F.lit("19:00").alias("default_value"),
    ).unionByName(venue.where("k % 4 = 0").select(
        "venue_key", F.lit("title").alias("field"), F.lit(None).cast("boolean").alias("required"),
        F.lit("Name on the poster.").alias("description"), none.alias("description_append"), none.alias("default_value")))
    policy = T.event(spark, sf).select(F.col("venue").alias("venue_key"), "type").distinct()
    return N.effective_schema(template, overrides, policy)
