"""Quality rules by tokeniser fertility, with rejection bands per language or script."""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from showbill.llm.common import text_blocks, stored
from showbill.llm.words import _WORD, mixed, span_hashes, words

#: How far, in quartile distances, a document may lie outside the quartiles of its group, below
#: and above, and the least distance that counts as one. Only few tokens of many kinds, or
#: many bytes, speak against a text, so these have one fence.
FENCES = {"chars": (3.0, 4.0, 0.02), "bytes": (None, 4.0, 0.02), "entropy": (2.0, None, 0.05)}
#: Length classes with fewer documents are judged with their neighbours, small languages with
#: their script and small scripts with all documents.
LEAST_DOCS = 50
#: Steps of the histograms from which the quartiles are read.
STEPS = 1000

_U = np.uint64
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: First bytes of UTF-8 sequences by script.
_SCRIPT_NAMES = ["Other", "Latin", "Greek", "Cyrillic", "Hebrew", "Arabic", "Indic", "Kana or Han", "Hangul"]
_SCRIPT = np.zeros(256, np.int64)
for _low, _high, _k in ((65, 90, 1), (97, 122, 1), (0xC3, 0xCA, 1), (0xCE, 0xCF, 2), (0xD0, 0xD4, 3), (0xD6, 0xD7, 4),
                        (0xD8, 0xDD, 5), (0xE0, 0xE0, 6), (0xE3, 0xE9, 7), (0xEA, 0xED, 8)):
    _SCRIPT[_low:_high + 1] = _k

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "n_byte_tokens")


class _Tokenizer:
    """Token ids of single words."""

    def __init__(self, path: str):
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])

    def encode(self, wanted: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, their number per word)."""
        ids = self.pieces.encode([w.decode("utf-8", "replace") for w in wanted], num_threads=1) if wanted else []
        return np.fromiter(chain.from_iterable(ids), np.int64), np.fromiter(map(len, ids), np.int64, len(ids))


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> _Tokenizer:
    return _Tokenizer(path)


def _doubled(keys: np.ndarray) -> np.ndarray:
    """Whether the key occurs more than once."""
    _, back, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return counts[back] > 1


def measured(texts: list[bytes], tokenizer: _Tokenizer) -> dict[str, np.ndarray]:
    """The measures of every text."""
    n = len(texts)
    data, starts, ends, of = words(texts, lower=False)
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])
    salt = mixed(np.arange(1, n + 1, dtype=_U))

    def per_text(at):
        return np.bincount(np.searchsorted(first, at, "right") - 1, minlength=n)[:n]

    out = {"n_words": np.bincount(of, minlength=n), "n_symbols": per_text(np.flatnonzero(_SYMBOL[data]))}
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    out["word_chars"] = np.bincount(of, weights=points[ends] - points[starts], minlength=n).astype(np.int64)
    # the script of most words, by their first characters
    seen = np.bincount(of * len(_SCRIPT_NAMES) + _SCRIPT[data[starts]], minlength=n * len(_SCRIPT_NAMES))
    out["script"] = seen.reshape(n, -1).argmax(axis=1)

    feeds = np.concatenate(([-1], np.flatnonzero(data == 10), [len(data)]))
    line_starts, line_ends = feeds[:-1] + 1, feeds[1:]
    filled = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[filled], line_ends[filled]
    line_of = np.searchsorted(first, line_starts, "right") - 1
    keys = span_hashes(data, line_starts, line_ends) ^ salt[line_of] if len(line_starts) else np.zeros(0, _U)
    _, lead = np.unique(keys, return_index=True)
    out["n_dup_lines"] = np.bincount(line_of, minlength=n) - np.bincount(line_of[lead], minlength=n)

    hashes = span_hashes(data, starts, ends) if len(starts) else np.zeros(0, _U)
    repeated = np.zeros(len(hashes) + 3, np.int64)
    if len(hashes) >= 3:
        at = np.flatnonzero(of[2:] == of[:-2])
        triples = mixed(hashes[at] * _WORD[0] + hashes[at + 1] * _WORD[1] + hashes[at + 2] * _WORD[2]) ^ salt[of[at]]
        at = at[_doubled(triples)]
        repeated += np.bincount(at, minlength=len(repeated)) - np.bincount(at + 3, minlength=len(repeated))
    out["n_repeat_words"] = np.bincount(of, weights=np.cumsum(repeated)[:len(hashes)] > 0, minlength=n).astype(np.int64)

    _, lead, back = np.unique(hashes, return_index=True, return_inverse=True)
    joined = data.tobytes()
    flat, sizes = tokenizer.encode([joined[a:b] for a, b in zip(starts[lead].tolist(), ends[lead].tolist(), strict=True)])
    base = np.cumsum(sizes) - sizes
    take = sizes[back]
    where = np.repeat(base[back], take) + np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
    tokens, token_of = flat[where], np.repeat(of, take)
    out["n_tokens"] = np.bincount(token_of, minlength=n)
    out["n_byte_tokens"] = np.bincount(token_of, weights=tokenizer.is_byte[tokens], minlength=n).astype(np.int64)
    keys, counts = np.unique(token_of * len(tokenizer.is_byte) + tokens, return_counts=True)
    owner = keys // len(tokenizer.is_byte)
    share = counts / np.maximum(out["n_tokens"], 1)[owner]
    out["entropy"] = np.bincount(owner, weights=-share * np.log2(share), minlength=n)
    return out


def _measured(path: str, schema: pa.Schema):
    def run(batches):
        tokenizer = _tokenizer(path)
        kept = [i for i, f in enumerate(schema) if f.name not in (*MEASURES, "script", "entropy")]
        for rows, texts in text_blocks(batches, "_text"):
            m = measured(texts, tokenizer)
            columns = [rows.column(i).cast(schema.field(i).type) for i in kept]
            columns += [pa.array(m[k], pa.int64()) for k in MEASURES]
            columns += [pa.array([_SCRIPT_NAMES[k] for k in m["script"]]), pa.array(m["entropy"], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def measures(docs: DataFrame, vocabulary: str, *kept: str) -> DataFrame:
    """The ``kept`` columns of every row with its measures; ``vocabulary`` is a sentencepiece model with byte fallback.

    Tokens are those of the single words, as the pieces of such a model begin anew with each
    word. Kept columns must not bear a measure's name.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, LongType, StringType, StructType

    rows = docs.select(*kept, F.col("text").cast("string").alias("_text"))
    schema = StructType(rows.schema.fields[:-1])
    for name in MEASURES:
        schema = schema.add(name, LongType())
    schema = schema.add("script", StringType()).add("entropy", DoubleType())
    return rows.mapInArrow(_measured(vocabulary, to_arrow_schema(schema)), schema)


def _values():
    """The three measures that have bands, as named numbers on a grid."""
    tokens = F.col("n_tokens")
    return {
        "chars": F.when(tokens > 0, F.round(F.col("word_chars") / tokens * STEPS)),
        "bytes": F.when(tokens > 0, F.round(F.col("n_byte_tokens") / tokens * STEPS)),
        "entropy": F.when(tokens > 0, F.round(F.col("entropy") * STEPS)),
    }


def _language():
    """The language, or the script of a document that has none."""
    return F.coalesce("_lang", F.concat(F.lit("script "), F.col("script")))


def _length():
    """The length class: the number of tokens in powers of two."""
    return F.floor(F.log2(F.col("n_tokens").cast("double"))).cast("int")


def _levels():
    """The groups a document can be judged in, from the finest: language, script, all documents."""
    keys = (F.col("language"), F.col("script"), F.lit(""))
    return F.explode(F.array(*[F.struct(F.lit(i).alias("level"), k.alias("key")) for i, k in enumerate(keys)])).alias("l")


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _sources(counts: DataFrame, least_docs: int) -> tuple[DataFrame, DataFrame]:
    """(language, script, length -> the level, key and length it is judged at, the lengths whose documents count there).

    A level serves if its documents of the nearest length classes come to ``least_docs``; no
    class farther away than needed counts. All documents together always serve.
    """
    held = counts.where("measure = 'chars'")
    sizes = stored(held.select(_levels(), "length", "n").groupBy("l.level", "l.key", "length").agg(F.sum("n").alias("n")), "quality-sizes")
    near = sizes.select("level", "key", "length").join(sizes.select("level", "key", F.col("length").alias("source"), "n"), ["level", "key"])
    near = near.withColumn("far", F.abs(F.col("source") - F.col("length")))
    own = Window.partitionBy("level", "key", "length")
    within = F.sum("n").over(own.orderBy("far").rangeBetween(Window.unboundedPreceding, 0))
    reach = F.min(F.when(F.col("within") >= least_docs, F.col("far"))).over(own)
    near = near.withColumn("within", within).withColumn("reach", reach).withColumn(
        "reach", F.when(F.col("level") == 2, F.coalesce("reach", F.max("far").over(own))).otherwise(F.col("reach")))
    near = stored(near.where("far <= reach").select("level", "key", "length", "source"), "quality-near")
    kinds = held.select("language", "script", "length").distinct()
    served = kinds.select("language", "script", "length", _levels()).select("language", "script", "length", "l.*").join(
        near.select("level", "key", "length").distinct(), ["level", "key", "length"])
    first = served.groupBy("language", "script", "length").agg(F.min(F.struct("level", "key")).alias("at"))
    return stored(first.select("language", "script", "length", "at.level", "at.key"), "quality-served"), near


def bands(rows: DataFrame, fences: dict = FENCES, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(language, script, length; low and high of each measure) from the quartiles over documents that pass the base rules.

    Every language, script and length class that occurs has a band: its own, or that of the
    finest group of ``least_docs`` it belongs to. The quartiles come from counted grid values,
    which add up over any number of tasks.
    """
    values = F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("value")) for k, v in _values().items()])
    counts = rows.where(~base_failed()).select(
        _language().alias("language"), "script", _length().alias("length"), F.explode(values).alias("v")).select(
        "language", "script", "length", "v.*").where("value is not null").groupBy(
        "measure", "language", "script", "length", "value").agg(F.count("*").alias("n"))
    counts = stored(counts, "quality-counts")
    served, near = _sources(counts, least_docs)
    group = ["level", "key", "length"]
    wanted = near.join(served.select(*group).distinct(), group)
    counts = counts.select("measure", F.col("length").alias("source"), "value", "n", _levels()).select("measure", "source", "value", "n", "l.*")
    counts = counts.join(wanted, ["level", "key", "source"]).groupBy("measure", *group, "value").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("measure", *group)
    ranked = counts.select("*", F.sum("n").over(w.orderBy("value")).alias("below"), F.sum("n").over(w).alias("all"))

    def quartile(q):
        return F.min(F.when(F.col("below") >= q * F.col("all"), F.col("value")))

    edges = ranked.groupBy("measure", *group).agg(quartile(0.25).alias("q1"), quartile(0.75).alias("q3"))
    limits = []
    for name, (below, above, least) in fences.items():
        reach = F.greatest(F.col("q3") - F.col("q1"), F.lit(least * STEPS))
        own = F.col("measure") == name
        limits += [F.max(F.when(own, F.lit(None).cast("double") if k is None else F.col(q) + sign * k * reach)).alias(f"_{edge}_{name}")
                   for edge, q, sign, k in (("low", "q1", -1, below), ("high", "q3", 1, above))]
    edges = edges.groupBy(*group).agg(*limits)
    return served.join(edges, group).drop("level", "key").select(
        F.col("language").alias("_language"), F.col("script").alias("_script"), F.col("length").alias("_length"), *edges.columns[3:])


def judged(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """``rows`` with base_failed and kept; the limits have a row per language, script and length class."""
    out = rows.withColumn("base_failed", base_failed()).join(
        limits, (_language() == F.col("_language")) & (F.col("script") == F.col("_script")) & (_length() == F.col("_length")), "left")
    passed = ~F.col("base_failed")
    for name, value in _values().items():
        passed = passed & F.coalesce(value >= F.col(f"_low_{name}"), F.lit(True)) & F.coalesce(value <= F.col(f"_high_{name}"), F.lit(True))
    return out.withColumn("kept", passed).drop(*limits.columns)


def _judged(docs: DataFrame, vocabulary: str, columns, fences: dict) -> tuple[DataFrame, dict]:
    renamed = {c: f"_kept_{i}" for i, c in enumerate(columns)}
    rows = docs.select(*[F.col(c).alias(n) for c, n in renamed.items()], F.col("lang").cast("string").alias("_lang"), "text")
    rows = stored(measures(rows, vocabulary, *renamed.values(), "_lang"), "quality-measures")
    # the bands have a few rows a language, and once they are written Spark knows it
    return judged(rows, stored(bands(rows, fences), "quality-bands")), renamed


def quality(docs: DataFrame, vocabulary: str, *kept: str, fences: dict | None = None) -> DataFrame:
    """Every row with its measures, base_failed and kept, and the columns ``kept``.

    base_failed: fewer than 50 words, or over half of the words in repeated three-word
    windows. Others are kept if characters per token, byte-fallback share and token entropy
    lie within the fences of the documents of like length in their language (script where
    lang is null). Where these are fewer than LEAST_DOCS, the nearest length classes join them,
    then the documents of the script and at last all documents count, so that every document
    is judged at every table size. Null and empty texts have
    no words and fail. Repeated rows are judged alike; an empty table gives no rows. Columns
    pass through unchanged if asked for by ``kept``, but for those with a measure's name.
    """
    out, renamed = _judged(docs, vocabulary, kept, fences or FENCES)
    names = [*MEASURES, "script", "entropy", "base_failed", "kept"]
    return out.select(*[F.col(n).alias(c) for c, n in renamed.items() if c not in names], *names)


def drop_low_quality(docs: DataFrame, vocabulary: str, fences: dict | None = None) -> DataFrame:
    """The documents that are kept, with all their columns."""
    out, renamed = _judged(docs, vocabulary, docs.columns, fences or FENCES)
    return out.where("kept").select(*[F.col(n).alias(c) for c, n in renamed.items()])
