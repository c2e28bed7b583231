"""MinHash near-duplicates: universal hash minima, bands, signature and exact checks, star components."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from showbill.llm.common import batch_of, id_or_least, id_or_null, placed, raw_texts, stored, text_blocks
from showbill.llm.words import mixed, shingle_sets

#: Minima of a signature at most.
MINIMA = 125
#: Links take 100 * intersection >= similarity * union; this is the default.
SIMILARITY = 85
#: Chance at most that no band holds a pair that is just similar enough.
MISSED = 5e-7
#: Pairs whose signatures agree in a share this many standard deviations below the similarity
#: are not read in full, a chance of about 1e-6.
DEVIATIONS = 4.7
#: Members of a family, and their shingles, that are compared in one task; larger families are
#: compared bucket by bucket, in blocks of about half that size.
FAMILY, FAMILY_SHINGLES = 2048, 2_000_000

_U = np.uint64
_RNG = np.random.default_rng(51)
_A = _RNG.integers(0, 2**64, MINIMA, dtype=_U) | _U(1)
_B = _RNG.integers(0, 2**64, MINIMA, dtype=_U)
_ROW = _RNG.integers(0, 2**64, MINIMA, dtype=_U) | _U(1)
_BAND = _RNG.integers(0, 2**64, MINIMA, dtype=_U)

_SIGNED = "doc_id long, text_hash long, n_shingles long, set_id binary, bands array<long>, signature binary"
_SIGNED_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.binary()),
    ("bands", pa.list_(pa.int64())), ("signature", pa.binary())])


def banding(similarity: int) -> tuple[int, int, float]:
    """(bands, minima of a band, least share of equal minima) for pairs of this similarity in percent.

    The bands are as narrow as MINIMA allows while MISSED holds: 25 of 5 for 85, 28 of 4 for 80.
    """
    share = similarity / 100
    for rows in range(MINIMA, 0, -1) if 0 < similarity < 100 else ():
        bands = max(1, math.ceil(math.log(MISSED) / math.log1p(-share**rows)))
        if bands * rows <= MINIMA:
            return bands, rows, share - DEVIATIONS * math.sqrt(share * (1 - share) / (bands * rows))
    raise ValueError(f"{MINIMA} minima do not find pairs of similarity {similarity}")


def minima(values: np.ndarray, sizes: np.ndarray, n: int = MINIMA) -> np.ndarray:
    """Least value of the first ``n`` universal hashes a * x + b over each nonempty set, sets by hashes."""
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1].astype(np.int64)
    out, work = np.empty((len(sizes), n), _U), np.empty_like(values)
    for i in range(n):
        np.multiply(values, _A[i], out=work)
        np.add(work, _B[i], out=work)
        out[:, i] = np.minimum.reduceat(work, starts)
    return out


def _signed(n_bands: int, n_rows: int):
    def run(batches):
        for rows, texts in text_blocks(batches):
            values, sizes = shingle_sets(texts)
            full = np.flatnonzero(sizes)
            bands, marks = [None] * len(texts), [None] * len(texts)
            if len(full):
                # sets stay in the processor's cache while all hashes pass over them
                least = np.concatenate([
                    minima(values[a:b], sizes[c:d][sizes[c:d] > 0], n_bands * n_rows) for a, b, c, d in _pieces(sizes)])
                folded = (least.reshape(-1, n_bands, n_rows) * _ROW[:n_rows]).sum(axis=2, dtype=_U)
                folded = mixed(folded + _BAND[:n_bands]).view(np.int64)
                short = mixed(least).astype(np.uint16)
                for j, i in enumerate(full):
                    bands[i], marks[i] = folded[j], short[j].tobytes()
            ends = np.cumsum(sizes)
            names = [hashlib.blake2b(values[e - n:e].tobytes(), digest_size=16).digest() if n else None
                     for e, n in zip(ends, sizes, strict=True)]
            yield batch_of(_SIGNED_ARROW, [rows.column(0), rows.column(2), sizes, names, bands, marks])

    return run


def _pieces(sizes: np.ndarray, limit: int = 1 << 14):
    """(first value, last value, first set, last set) of runs of whole sets of about ``limit`` values."""
    ends, a, c = np.cumsum(sizes), 0, 0
    while c < len(sizes):
        d = max(c + 1, int(np.searchsorted(ends, a + limit, "right")))
        b = int(ends[d - 1])
        if b > a:
            yield a, b, c, d
        a, c = b, d


def signatures(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """Per row: set size, id of the shingle set, band hashes and the shortened signature."""
    bands, rows, _ = banding(similarity)
    text = F.col("text").cast("string")
    return docs.select(id_or_least().alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash")).mapInArrow(
        _signed(bands, rows), _SIGNED)


def _agreeing(n: int, least: float):
    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, n) for i in (2, 3))
            yield batch.filter(pa.array((a == b).mean(axis=1) >= least)).select([0, 1])

    return run


def _linked(similarity: int):
    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                rows = batch.slice(first, 64)
                n = rows.num_rows
                values, sizes = shingle_sets(raw_texts(rows.column(2)) + raw_texts(rows.column(3)))
                ends = np.cumsum(sizes)
                keep = []
                for i in range(n):
                    x, y = (values[ends[k] - sizes[k]:ends[k]] for k in (i, n + i))
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(both > 0 and 100 * both >= similarity * (len(x) + len(y) - both))
                yield rows.filter(pa.array(keep, pa.bool_())).select([0, 1])

    return run


def confirm(pairs: DataFrame, docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """The (a, b) pairs whose full shingle sets are similar enough."""
    texts = docs.select(id_or_least().alias("id"), "text")
    both = (pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
            .join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b"))
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_linked(similarity), "a long, b long").distinct()


def _similar_signatures(pairs: DataFrame, classes: DataFrame, similarity: int) -> DataFrame:
    marks = classes.select("rep", "signature")
    both = (pairs.join(marks.select(F.col("rep").alias("a"), F.col("signature").alias("sa")), "a")
            .join(marks.select(F.col("rep").alias("b"), F.col("signature").alias("sb")), "b"))
    bands, rows, least = banding(similarity)
    return both.select("a", "b", "sa", "sb").mapInArrow(_agreeing(bands * rows, least), "a long, b long").distinct()


def common(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Number of common elements of every two of the sets that stand one after another."""
    n = len(sizes)
    out = np.zeros((n, n), np.int32)
    order = np.argsort(values, kind="stable")
    owner = np.repeat(np.arange(n), sizes)[order]
    first = np.flatnonzero(np.concatenate(([True] * bool(len(values)), np.diff(values[order]) != 0)))
    counts = np.diff(np.concatenate((first, [len(values)])))
    # rare elements are counted pair by pair, frequent ones by a product of matrices
    for c in np.unique(counts[(counts > 1) & (counts <= max(2, n // 10))]):
        holders = owner[first[counts == c][:, None] + np.arange(c)]
        for d in range(1, c):
            np.add.at(out.reshape(-1), (holders[:, :-d] * n + holders[:, d:]).ravel(), 1)
    often = np.flatnonzero(counts > max(2, n // 10))
    for k in range(0, len(often), 4096):
        own = often[k:k + 4096]
        held = np.zeros((n, len(own)), np.float32)
        held[owner[np.repeat(first[own], counts[own]) + _steps(counts[own])], np.repeat(np.arange(len(own)), counts[own])] = 1
        out += np.triu(held @ held.T, 1).astype(np.int32)
    return out + out.T


def _steps(counts: np.ndarray) -> np.ndarray:
    """0 .. c - 1 for every count c."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _joined(similarity, rep, component, texts, side=None):
    """One link for every two components of the members that have one (of different sides, where these are given)."""
    import pandas as pd

    values, sizes = shingle_sets([t.encode() for t in texts])
    both = common(values, sizes)
    linked = np.triu((both > 0) & (100 * both >= similarity * (sizes[:, None] + sizes[None, :] - both)), 1)
    linked &= component[:, None] != component[None, :]
    if side is not None:
        linked &= side[:, None] != side[None, :]
    x, y = np.nonzero(linked)
    links = pd.DataFrame({"a": np.minimum(rep[x], rep[y]), "b": np.maximum(rep[x], rep[y]),
                          "c": np.minimum(component[x], component[y]), "d": np.maximum(component[x], component[y])})
    return links.drop_duplicates(["c", "d"])[["a", "b"]]


def _within(similarity, frame):
    return _joined(similarity, *(frame[c].to_numpy() for c in ("rep", "component", "text")))


def _across(similarity, left, right):
    import pandas as pd

    if left.iloc[0]["i"] == left.iloc[0]["j"]:
        return _within(similarity, left)
    right.columns = left.columns
    both = pd.concat([left, right], ignore_index=True)
    return _joined(similarity, *(both[c].to_numpy() for c in ("rep", "component", "text")), np.arange(len(both)) < len(left))


def _open_links(buckets: DataFrame, classes: DataFrame, found: DataFrame, docs: DataFrame, family: int, similarity: int) -> DataFrame | None:
    """Links between members of a bucket that are not yet in one component; None if all buckets are settled.

    Open buckets that share members make a family, whose members are compared on their full
    sets within one task; only links come out. A family beyond the bounds is compared bucket
    by bucket: a bucket is cut into blocks, and every two blocks meet in a task of their own.
    """
    members = buckets.join(found, F.col("rep") == F.col("node"), "left").select(
        "bucket", "rep", F.coalesce("component", "rep").alias("component"))
    open_ = members.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("rep").alias("center"))
    rows = stored(members.join(open_.where("low < high").select("bucket", "center"), "bucket"), "near-open")
    if not rows.take(1):
        return None
    families = components(rows.select(F.col("rep").alias("a"), F.col("center").alias("b")), "near-families")
    reps = rows.select("rep", "component").distinct().join(
        families.select(F.col("node").alias("rep"), F.col("component").alias("family")), "rep").join(classes.select("rep", "n_shingles"), "rep")
    bounded = (F.col("members") <= family) & (F.col("total") <= FAMILY_SHINGLES)
    sizes = stored(reps.groupBy("family").agg(F.count("*").alias("members"), F.sum("n_shingles").alias("total")).select(
        "family", bounded.alias("bounded")), "near-sizes")
    reps = stored(reps.join(sizes, "family"), "near-reps")
    texts = docs.select(id_or_least().alias("rep"), F.col("text").cast("string").alias("text"))
    links = reps.where("bounded").select("family", "rep", "component").join(texts, "rep").groupBy("family").applyInPandas(
        lambda frame: _within(similarity, frame), "a long, b long")
    large = reps.where("not bounded").select("rep", "n_shingles")
    if large.take(1):
        own = rows.join(large, "rep")
        blocks = own.groupBy("bucket").agg(F.ceil(F.greatest(
            F.count("*") / (family / 2), F.sum("n_shingles") / (FAMILY_SHINGLES / 2))).alias("blocks"))
        own = own.join(blocks, "bucket").withColumn("own", F.pmod(F.xxhash64("rep"), "blocks")).join(texts, "rep")
        parts = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
        left = own.select("*", F.explode(F.filter(parts, lambda k: k >= F.col("own"))).alias("other")).select(
            "bucket", F.col("own").alias("i"), F.col("other").alias("j"), "rep", "component", "text")
        right = own.select("*", F.explode(F.filter(parts, lambda k: k <= F.col("own"))).alias("other")).select(
            "bucket", F.col("other").alias("i"), F.col("own").alias("j"), "rep", "component", "text")
        right = right.toDF(*[f"{c}_" for c in right.columns])
        met = left.groupBy("bucket", "i", "j").cogroup(right.groupBy("bucket_", "i_", "j_"))
        links = links.unionByName(met.applyInPandas(
            lambda a, b: _across(similarity, a, b) if len(a) and len(b) else a.head(0).rename(columns={"rep": "a", "component": "b"})[["a", "b"]],
            "a long, b long"))
    return links.distinct()


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """(node, component) of every node of undirected (a, b) links, by alternating large-star and small-star.

    Each step joins the edges with the least neighbour of their node, which is an
    aggregate, so that no neighbourhood is gathered. Steps are written to the shared
    folder and end when a round changes no edge.
    """
    edges = stored(links.where("a != b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-edges")
    seen = _mark(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        edges = stored(small, f"{name}-star")
        now = _mark(edges)
        if now == seen:
            break
        seen = now
    nodes = edges.groupBy("u").agg(F.min("v").alias("v"))
    return nodes.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        nodes.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and a sum over them that does not depend on their order."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def near_duplicates(docs: DataFrame, family: int = FAMILY, similarity: int = SIMILARITY) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept; ``similarity`` is the least of a link, in percent.

    Documents of one shingle set form a class that is treated as one. Classes that share a
    band are linked to the least of their bucket where the signatures and then the full sets
    agree; in buckets that still hold several components the members of different
    components are compared too, on their full sets. So each link between documents that share a band is found or already
    implied. A null or empty text has no shingle and is linked with nothing. A null doc_id
    counts as the smallest id. Rows that repeat a doc_id each get a row; equal texts are in
    one component anyway, and classes whose smallest doc_id is the same are one vertex. An
    empty table gives no rows; other columns than doc_id and text are not read.
    """
    return _judged(docs, family, similarity).select(
        id_or_null(F.col("doc_id")).alias("doc_id"), "n_shingles", id_or_null(F.col("component")).alias("component_id"), "kept")


def _judged(docs: DataFrame, family: int, similarity: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, component and kept of every row; a null id is the least number."""
    signed = stored(signatures(docs, similarity), "near-signed")
    full = signed.where("n_shingles > 0")
    classes = stored(full.groupBy("set_id").agg(
        F.min("doc_id").alias("rep"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("bands").alias("bands"),
        F.any_value("signature").alias("signature")), "near-classes")
    banded = classes.select("rep", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("rep").alias("center"), F.max("rep").alias("last")).where("center < last")
    buckets = stored(banded.join(shared, "bucket").select("bucket", "rep", "center"), "near-buckets")
    pairs = buckets.where("rep != center").select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct()
    links = stored(confirm(_similar_signatures(pairs, classes, similarity), docs, similarity), "near-links")
    found = stored(components(links, "near-first"), "near-first")
    more = _open_links(buckets.select("bucket", "rep"), classes, found, docs, family, similarity)
    if more is not None:
        found = stored(components(stored(links.unionByName(more), "near-links"), "near-all"), "near-all")
    names = classes.select("set_id", "rep").join(found, F.col("rep") == F.col("node"), "left").select(
        "set_id", F.coalesce("component", "rep").alias("component"))
    rows = signed.select("doc_id", "text_hash", "n_shingles", "set_id").join(names, "set_id", "left")
    component = F.coalesce("component", "doc_id")
    return rows.select("doc_id", "text_hash", "n_shingles", component.alias("component"), (F.col("doc_id") == component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, family: int = FAMILY, similarity: int = SIMILARITY) -> DataFrame:
    """The documents that stand for their group, each once, with all their columns.

    A row is known by its doc_id and text: of texts that repeat an id, those that are copies of
    another document go and the others stay. Rows that repeat both stay once. A null or empty
    text, or one of blanks, is linked with nothing, and all its rows stay, also under one id or
    none. An empty table gives no rows; columns of any name are kept.
    """
    rows, (doc_id, text) = placed(docs, "doc_id", "text")
    plain = rows.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kept = _judged(plain, family, similarity).where("kept and n_shingles > 0").select(
        F.col("doc_id").alias("_own"), F.col("text_hash").alias("_own_hash")).distinct()
    worded = F.coalesce(F.col(text).cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    stay = rows.where(worded).join(
        kept, (id_or_least(doc_id) == F.col("_own")) & (F.xxhash64(F.col(text).cast("string")) == F.col("_own_hash")), "left_semi")
    return stay.dropDuplicates([doc_id, text]).unionByName(rows.where(~worded)).toDF(*docs.columns)
