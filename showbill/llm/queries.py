"""The registered queries of the corpus operators and the statements they are compared with."""

from __future__ import annotations

from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from showbill.llm import (
    bpe, decontaminate, divergence, fertility, jaccard_join, licenses, line_spread, near_dedup, pseudonyms, repeats, spelling, toxicity,
    url_cascade,
)
from showbill.llm.common import documents

QUALITY_VOCABULARY = "piece_bpe_32k.model"
RANKS = "byte_bpe_multi_50k.tiktoken"
#: Pages with less mark-up than this are listed by the url query.
LEAST_PAGE = 2000
#: In production the key is a secret of the session.
PSEUDONYM_KEY = "corpus pseudonyms"
#: Percent of the union that two documents share at least where the query links them.
LINKED = 85


def quality_vocabulary() -> str:
    return public_tokenizers.path(QUALITY_VOCABULARY)


def ranks() -> str:
    return public_tokenizers.path(RANKS)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    return repeats.remove_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_bytes",
        F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
        F.size(spans).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def _held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), _held_out)
    return toxicity.score(docs, model).select(
        "doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "spans")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), similarity=LINKED)


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymize(documents(spark, sf_dir).select("doc_id", "text"), PSEUDONYM_KEY)


def op7_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_cascade.judged(pages, url_cascade.thin_pages(pages, LEAST_PAGE))


def op8_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.quality(documents(spark, sf_dir), quality_vocabulary(), "doc_id").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_tokens", "n_byte_tokens", "entropy")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = {"ranks": ranks(), "pattern": public_tokenizers.PATTERN}
    return bpe.decode(bpe.encode(documents(spark, sf_dir), **codec), **codec).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_spread.drop_boilerplate(documents(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(documents(spark, sf_dir))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def _pipeline(run, spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)


SQL_OP5 = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_have >= 85 * (x.n + y.n - both_have)
), edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a
), c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

SQL_OP12 = SQL_OP5.replace(">= 85 *", f">= {jaccard_join.SIMILARITY} *").replace("component_id, d.doc_id = component_id AS kept", "component_id")

_RULES = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{{i}}}'"
    for i, (h, p, _) in sorted(enumerate(url_cascade.RULES), key=lambda r: -len(r[1][0]) - len(r[1][1])))
SQL_OP7 = f"""
WITH p AS (
  SELECT page_id, html,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages
), listed AS (SELECT DISTINCT host || path AS key FROM p WHERE host <> '' AND length(html) < {LEAST_PAGE}),
r AS (SELECT page_id, host, path, CASE {_RULES.format(*[h + q for h, q, _ in url_cascade.RULES])} END AS rule,
  CASE {_RULES.format(*[v for _, _, v in url_cascade.RULES])} END AS verdict FROM p)
SELECT page_id, host, path, rule,
  coalesce(verdict, CASE WHEN host <> '' AND host || path IN (SELECT key FROM listed) THEN 'block' ELSE 'allow' END) AS verdict FROM r
"""

SQL_OP10 = f"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), t AS (SELECT doc_id, source, pos, raw, trim(raw, ' ') AS line FROM l),
spread AS (SELECT line, min(struct_pack(doc_id := doc_id, pos := pos)) AS first FROM t WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= {line_spread.MIN_SITES}),
m AS (SELECT t.*, coalesce(struct_pack(doc_id := t.doc_id, pos := t.pos) <> spread.first, false) AS gone FROM t LEFT JOIN spread USING (line))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INTEGER)) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _checksums(polynomial: int = 0xEDB88320) -> list[int]:
    """The table of the reflected cyclic check sum of 32 bits."""
    table = list(range(256))
    for _ in range(8):
        table = [(x >> 1) ^ (polynomial if x & 1 else 0) for x in table]
    return table


# code points U+00C0 to U+00FF have two bytes, the first of them 195
_BYTES = "flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [195, ord(c) - 64] END))"
SQL_OP11 = f"""
WITH RECURSIVE t AS (SELECT {_checksums()} AS crc),
r AS (SELECT doc_id, unnest(regexp_extract_all({_LOWERED}, '[a-zÀ-ÿ]+')) AS run FROM documents),
d AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc_id, run, count(*) AS n FROM r GROUP BY ALL),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform({_BYTES}, lambda b: CAST(b AS BIGINT))),
  lambda x, b: xor(x >> 8, crc[(xor(x, b) & 255) + 1])), 4294967295) AS h FROM d, t),
m AS (SELECT CASE WHEN h % 97 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM m WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
x AS (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
e AS (
  SELECT a.word, b.word AS other, b.n FROM x a JOIN x b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
  UNION SELECT x.word, w.word, w.n FROM x JOIN w ON x.less = w.word
  UNION SELECT w.word, x.word, x.n FROM x JOIN w ON x.less = w.word
), b AS (SELECT word, count(*) AS n_near, min(struct_pack(least := -n, other := other)) AS best FROM e GROUP BY word),
f AS (SELECT word, CASE WHEN -best.least >= 2 * n THEN best.other END AS form, n, coalesce(n_near, 0) AS n_near,
  CASE WHEN -best.least >= 2 * n THEN -best.least END AS form_n FROM w LEFT JOIN b USING (word)),
s AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT s.word, f.word, f.form FROM s JOIN f ON f.word = s.next)
SELECT word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, root FROM s WHERE next IS NULL) USING (word)
"""

_SHARE = "1 + 1000000000 * ({n} + 5) // ({total} + 5 * v)"
SQL_OP13 = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all({_LOWERED}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents
), t AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
k AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= {divergence.LEAST_DOCS}),
l AS (SELECT lang, count(*) AS v, CAST(sum(lang_n) AS BIGINT) AS lang_total FROM k GROUP BY lang),
g AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce(lang_total, 0) AS lang_total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN l USING (lang)),
s AS (SELECT lang, source, CAST(sum(n) AS BIGINT) AS total FROM c JOIN k USING (lang, term) GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, {_SHARE.format(n="coalesce(n, 0)", total="coalesce(total, 0)")} AS own,
    {_SHARE.format(n="lang_n", total="lang_total")} AS whole
  FROM g JOIN k USING (lang) LEFT JOIN c ON (c.lang, c.source, c.term) = (g.lang, g.source, k.term) LEFT JOIN s ON (s.lang, s.source) = (g.lang, g.source)
), f AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(sum(abs(a.own - b.own)), 0) AS BIGINT) AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN p a ON (a.lang, a.source) = (x.lang, x.source) LEFT JOIN p b ON (b.lang, b.source, b.term) = (y.lang, y.source, a.term) GROUP BY ALL
  UNION ALL SELECT lang, source, 'term', term, own - whole FROM p WHERE n > 0 AND own > whole
)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM f
QUALIFY part = 'pair' OR rank <= {divergence.TOP_TERMS}
"""

SQL = {"op11_spelling": SQL_OP11, "op12_jaccard_join": SQL_OP12, "op13_divergence": SQL_OP13, "op5_near_dedup": SQL_OP5, "op7_url_cascade": SQL_OP7, "op10_line_spread": SQL_OP10}


def load() -> dict:
    """name -> (function, statement or None)."""
    import corpus_pipeline

    names = (op1_decontaminate, op2_repeats, op3_toxicity, op4_licenses, op5_near_dedup, op6_pseudonyms, op7_url_cascade,
             op8_fertility, op9_bpe, op10_line_spread, op11_spelling, op12_jaccard_join, op13_divergence)
    out = {f.__name__: (f, SQL.get(f.__name__)) for f in names}
    out["pipeline"] = (partial(_pipeline, corpus_pipeline.run), corpus_pipeline.ORACLE_SQL)
    return out
