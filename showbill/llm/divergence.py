"""Source divergence audit: hash-consed segment trees over term counts, traversed two at a time with a memo."""

from __future__ import annotations

import re
from collections import Counter
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from showbill.llm.common import batch_of, raw_texts, stored

#: Documents of a language that hold a term at least, for the term to be kept.
LEAST_DOCS = 30
#: Added to every count.
SMOOTH = 5
#: Shares are counted in parts of this.
SCALE = 1_000_000_000
#: Terms that are reported for a group at most (the top-k of the report).
TOP_TERMS = 50
#: Terms of a tree, and sources of a chunk: a task holds the trees of two chunks over one range of terms.
TREE_TERMS, CHUNK = 2048, 32
#: Entries that a counting task holds before it hands them on, and bytes of a text that it reads at a time.
HELD, PIECE_BYTES = 200_000, 1 << 20

_TERM = re.compile(rb"[a-z\x80-\xff]+")
_NO_TERM = re.compile(rb"[^a-z\x80-\xff]")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
#: Stands for "no term here" where a tree is filled up to a power of two.
_NONE = -1
_STEP = 100_000


def term_counts(text: bytes) -> Counter:
    """Occurrences of every term of a text, which is read in pieces that end between two terms."""
    out, start = Counter(), 0
    while start < len(text):
        gap = _NO_TERM.search(text, start + PIECE_BYTES) if start + PIECE_BYTES < len(text) else None
        end = gap.start() if gap else len(text)
        out.update(_TERM.findall(text[start:end]))
        start = end
    return out


def _counted(batches):
    held, size = {}, 0
    for batch in batches:
        for first in range(0, batch.num_rows, 64):
            rows = batch.slice(first, 64)
            for text, lang, source in zip(raw_texts(rows.column(0)), *(rows.column(i).to_pylist() for i in (1, 2)), strict=True):
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                found, before = term_counts(text.translate(_LOWER)), len(n)
                n.update(found)
                docs.update(found.keys())
                size += len(n) - before
                if size > HELD:
                    yield from _handed_on(held)
                    held, size = {}, 0
    yield from _handed_on(held)


def _handed_on(held: dict):
    for (lang, source), (n, docs) in held.items():
        yield batch_of(_COUNTS, [[lang] * (len(n) + 1), [source] * (len(n) + 1), [None, *(t.decode() for t in n)],
                                 [0, *n.values()], [0, *(docs[t] for t in n)]])


def share(n, total):
    """1 + floor(SCALE * (n + SMOOTH) / total) in whole numbers of 64 bits, for totals to 9e13; of columns or of arrays."""
    if isinstance(n, Column):
        a = n + SMOOTH
        high, rest = _div(a * (SCALE // _STEP), total), (a * (SCALE // _STEP)) % total
        return 1 + high * _STEP + _div(rest * _STEP, total)
    high, rest = np.divmod((n + SMOOTH) * (SCALE // _STEP), total)
    return 1 + high * _STEP + rest * _STEP // total


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def tree_levels(counts: np.ndarray) -> tuple[np.ndarray, list]:
    """Roots and levels, from the top, of the hash-consed segment trees over the rows of ``counts``.

    A node is named by its two children, so that equal subtrees are one node, wherever they
    stand and whichever row they belong to. The width is a power of two; leaves are counts.
    """
    levels, nodes = [], counts
    while nodes.shape[1] > 1:
        left, right = nodes[:, 0::2].ravel(), nodes[:, 1::2].ravel()
        low = int(nodes.min())
        width = int(nodes.max()) - low + 1
        named, inverse = np.unique((left - low) * width + (right - low), return_inverse=True)
        levels.append((named // width + low, named % width + low))
        nodes = inverse.reshape(len(counts), -1)
    return nodes[:, 0], levels[::-1]


def priced(counts: np.ndarray, totals: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of |share of row a - share of row b| over all columns, for every pair of rows.

    All pairs of trees are descended at once, level by level; node pairs with the same two
    totals are one entry, so that each is priced once. Equal nodes under equal totals cost nothing.
    """
    swap = totals[a] > totals[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    terms = counts.shape[1]
    wide = np.full((len(counts), 1 << max(0, (terms - 1).bit_length())), _NONE, np.int64)
    wide[:, :terms] = counts
    values, leaves = np.unique(wide, return_inverse=True)
    roots, levels = tree_levels(leaves.reshape(wide.shape))
    both, of = np.unique(np.stack((totals[a], totals[b]), 1), axis=0, return_inverse=True)
    of, u, v = of.ravel(), roots[a], roots[b]
    steps = []
    for depth in range(len(levels) + 1):
        width = int(max(u.max(initial=0), v.max(initial=0))) + 1
        keys, inverse = np.unique((of * width + u) * width + v, return_inverse=True)
        of, u, v = keys // width // width, keys // width % width, keys % width
        differ = (both[of, 0] != both[of, 1]) | (u != v)
        place = np.where(differ, np.cumsum(differ) - 1, -1)
        of, u, v = of[differ], u[differ], v[differ]
        steps.append(place[inverse])
        if depth < len(levels):
            left, right = levels[depth]
            of, u, v = np.tile(of, 2), np.concatenate((left[u], right[u])), np.concatenate((left[v], right[v]))
    x, y = values[u], values[v]
    price = np.where(x == _NONE, 0, np.abs(share(np.maximum(x, 0), both[of, 0]) - share(np.maximum(y, 0), both[of, 1])))
    for depth in range(len(levels), -1, -1):
        price = np.append(price, 0)[steps[depth]]
        if depth:
            price = price[:len(price) // 2] + price[len(price) // 2:]
    return price


def _task_prices(key, frame):
    lang, _, low, high = key
    groups = frame[frame["term"].isna()].sort_values("source", kind="stable")
    rows = frame[frame["term"].notna()]
    names, terms = groups["source"].to_numpy(), np.sort(rows["term"].unique())
    place = pd.Index(names)
    counts = np.zeros((len(names), groups["width"].iloc[0]), np.int64)
    counts[place.get_indexer(rows["source"]), np.searchsorted(terms, rows["term"].to_numpy())] = rows["n"].to_numpy()
    a, b = np.triu_indices(len(names), 1)
    if low != high:
        chunk = groups["chunk"].to_numpy()
        apart = chunk[a] != chunk[b]
        a, b = a[apart], b[apart]
    value = priced(counts, groups["total"].to_numpy(), a, b) if len(a) else np.zeros(0, np.int64)
    return pd.DataFrame({"lang": lang, "a": names[a], "b": names[b], "value": value})


def _pairs(groups: DataFrame, counts: DataFrame, terms: DataFrame, tree_terms: int, chunk: int) -> DataFrame:
    """(lang, source, item, value) of every two groups of a language, from trees over ranges of terms."""
    shape = groups.groupBy("lang").agg(
        F.ceil(F.count("*") / chunk).alias("chunks"), F.ceil(F.max("kept") / tree_terms).alias("ranges"))
    groups = groups.join(shape, "lang").withColumn("chunk", F.pmod(F.xxhash64("source"), "chunks"))
    in_range = F.pmod(F.xxhash64("term", F.lit(1)), "ranges")
    widths = terms.join(shape, "lang").groupBy("lang", in_range.alias("range")).agg(F.count("*").cast("int").alias("width"))
    heads = groups.join(widths, "lang").select("lang", "range", "source", "chunk", "chunks", "total", "width",
                                               F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"))
    cells = counts.join(groups.select("lang", "source", "chunk", "chunks", "ranges"), ["lang", "source"]).select(
        "lang", in_range.alias("range"), "source", "chunk", "chunks", F.lit(0).cast("long").alias("total"), F.lit(0).alias("width"), "term", "n")
    met = heads.unionByName(cells).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).select(
        "lang", "range", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"),
        "source", "chunk", "total", "width", "term", "n")
    sums = met.groupBy("lang", "range", "low", "high").applyInPandas(
        _task_prices, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    two = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    priced_pairs = sums.select("lang", two.alias("p"), "value").select("lang", "p.*", "value")
    bare = groups.where("kept = 0").select("lang", "source")
    free = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source != item").withColumn("value", F.lit(0).cast("long"))
    return priced_pairs.unionByName(free)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, tree_terms: int = TREE_TERMS, chunk: int = CHUNK) -> DataFrame:
    """lang, source, part, item, value, rank: how far the sources of a language stand from one another and from it.

    A null text, lang or source counts as empty. Every row is a document, also where ids
    repeat. A language without kept terms has pairs of value 0 and no terms; an empty table
    gives no rows; other columns are not read. Part ``pair`` has all other sources of the
    language, so it grows with the square of their number, as its contract says; chunks of
    sources and ranges of terms bound what a task holds. A long text is counted in pieces.
    """
    plain = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")]
    counts = docs.select(*plain).mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    counts = stored(counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "divergence-counts")
    terms = stored(counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"))
                   .where(F.col("docs") >= least_docs).select("lang", "term", "lang_n"), "divergence-terms")
    kept = stored(counts.join(terms, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "divergence-kept")
    langs = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("all_n"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("own_n"))
    zero = partial(F.coalesce, F.lit(0).cast("long"))
    groups = counts.select("lang", "source").distinct().join(langs, "lang", "left").join(sums, ["lang", "source"], "left").select(
        "lang", "source", F.coalesce("kept", zero()).alias("kept"),
        (F.coalesce("own_n", zero()) + SMOOTH * F.coalesce("kept", zero())).alias("total"),
        (F.coalesce("all_n", zero()) + SMOOTH * F.coalesce("kept", zero())).alias("lang_total"))
    groups = stored(groups, "divergence-groups")
    pairs = _pairs(groups, kept.select("lang", "source", "term", "n"), terms, tree_terms, chunk).withColumn("part", F.lit("pair"))
    own, whole = share(F.col("n"), F.col("total")), share(F.col("lang_n"), F.col("lang_total"))
    above = kept.join(groups, ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), (own - whole).alias("value"), F.lit("term").alias("part")).where("value > 0")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [pairs.withColumn("rank", F.row_number().over(by_value)), above.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)]
    return ranked[0].unionByName(ranked[1]).select("lang", "source", "part", "item", "value", "rank")
