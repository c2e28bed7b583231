"""Jaccard join of word-shingle sets by PartEnum signatures: partitions of the feature domain and subsets of them.

Sets of a size band (a power of two to the next, with the sets just below it) differ in at
most ``k`` features where they are similar enough. The band's domain is cut into first-level
parts of three second-level parts each. For each first-level part a set signs every subset
of two of its parts that hold features. A part in which ``q`` parts hold features has such
a subset in common with a similar set unless the two differ in at least ``q - 1`` features
there, so the parts in order up to a weight, the sum of ``q - 1``, of more than ``k`` are
enough. All similar sets meet; there is no chance in it.

The bound holds for any part of the domain too, so features that stand in many sets are
left out at first. A set that has too few others for a weight of more than ``k`` signs its
single rare features as well, and after them subsets and single features of all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from showbill.llm.common import batch_of, id_or_least, id_or_null, raw_texts, stored, text_blocks
from showbill.llm.near_dedup import components
from showbill.llm.words import SHINGLE, mixed, shingle_sets, shingles

#: Links take 100 * intersection >= similarity * union.
SIMILARITY = 80
#: Features that the largest sets of a band have in a second-level part on average.
FEATURES = 1.2
#: Features that count as common at most. Which ones do changes the work, not the result.
MOST_COMMON = 20_000
#: Entries of a task's summary of common features.
SUMMARY = 16_384
#: Bins of a set's profile. The profiles of two sets differ by no more than the sets do.
BINS = 256
#: Members, and strays, of a bucket that are compared in one step.
MEMBERS, STRAYS = 4096, 1024
#: Pairs that a task remembers, so that it hands on each once for all the buckets that have it.
REMEMBERED = 200_000
#: Bytes of a long text that are read at a time.
PIECE_BYTES = 1 << 20

_U = np.uint64
_CONTENT, _LEFT, _RIGHT, _BAND, _KIND = np.random.default_rng(1206).integers(0, 2**64, 5, dtype=_U) | _U(1)
_SETS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.binary()), ("profile", pa.binary())])
_SIGNED = pa.schema([("sig", pa.int64()), ("rep", pa.int64())])
_COMMON = pa.schema([("feature", pa.int64()), ("n", pa.int64())])
_BUCKETS = pa.schema([("sig", pa.int64()), ("rep", pa.int64()), ("center", pa.int64())])
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _long_set(text: bytes) -> np.ndarray:
    """Features of one text, read in pieces that have four words in common."""
    out, rest, start, first = np.zeros(0, _U), b"", 0, True
    while start < len(text):
        end = min(len(text), start + PIECE_BYTES)
        while end < len(text) and text[end:end + 1].strip():
            near = min((x for x in (text.find(c, end, end + PIECE_BYTES) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if x >= 0), default=-1)
            end = near if near >= 0 else min(len(text), end + PIECE_BYTES)
        piece = rest + b" " + text[start:end]
        tail = piece.rsplit(None, SHINGLE - 1)
        start = end
        if len(piece.split(None, SHINGLE)) < SHINGLE and not (first and start >= len(text)):
            rest = piece
            continue
        out = np.union1d(out, shingles([piece])[0])
        rest, first = b" ".join(tail[1 - SHINGLE:]), False
    return out


def _sets(batches) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, features of their texts one after another, number per row) for Arrow batches."""
    for rows, texts in text_blocks(batches):
        if len(texts) == 1 and len(texts[0]) > PIECE_BYTES:
            values = _long_set(texts[0])
            yield rows, values, np.array([len(values)], np.int64)
        else:
            yield rows, *shingle_sets(texts)


def _digests(values: np.ndarray, sizes: np.ndarray) -> list[bytes | None]:
    ends = np.cumsum(sizes)
    return [hashlib.blake2b(values[e - n:e].tobytes(), digest_size=16).digest() if n else None for e, n in zip(ends, sizes, strict=True)]


def _profiled(batches):
    for rows, values, sizes in _sets(batches):
        owner = np.repeat(np.arange(len(sizes)), sizes)
        bins = np.bincount(owner * BINS + (values >> _U(64 - 8)).astype(np.int64), minlength=len(sizes) * BINS).reshape(-1, BINS)
        bins = np.minimum(bins, 255).astype(np.uint8)
        yield batch_of(_SETS, [rows.column(0), sizes, _digests(values, sizes), [b.tobytes() if n else None for b, n in zip(bins, sizes, strict=True)]])


def _summarised(batches):
    """Features of many sets with counts that are too low by as much as had to be taken off all."""
    features, counts = np.zeros(0, _U), np.zeros(0, np.int64)
    for _, values, _ in _sets(batches):
        features, place = np.unique(np.concatenate((features, values)), return_inverse=True)
        counts = np.bincount(place, np.concatenate((counts, np.ones(len(values), np.int64))), len(features)).astype(np.int64)
        if len(counts) > SUMMARY:
            counts -= np.partition(counts, len(counts) - SUMMARY)[len(counts) - SUMMARY]
            features, counts = features[counts > 0], counts[counts > 0]
    often = counts > 1
    yield batch_of(_COMMON, [features[often].view(np.int64), counts[often]])


def common_features(texts: DataFrame, n_sets: int, most: int = MOST_COMMON) -> np.ndarray:
    """At most ``most`` features, sorted, that stand in many sets: more than 64, and one in 2,000."""
    counts = texts.mapInArrow(_summarised, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    rows = counts.where(F.col("n") > max(64, n_sets // 2000)).orderBy(F.desc("n"), "feature").limit(most).collect()
    return np.sort(np.array([r["feature"] for r in rows], np.int64).view(_U))


def _part_signatures(values, owner, limit, band):
    """(signature, owner) of subsets of two parts, and the weight of every owner."""
    parts = np.ceil(2.0 ** (band + 1) / (3 * FEATURES)).astype(np.int64)
    place = (mixed(values * _CONTENT) % (3 * parts[owner]).astype(_U)).astype(np.int64)
    stride = int(3 * parts.max(initial=1))
    order = np.argsort(owner * stride + place, kind="stable")
    at, values = (owner * stride + place)[order], mixed(values)[order]
    if not len(at):
        return values, owner, np.zeros(len(limit), np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    held, at = np.add.reduceat(values, first), at[first]
    own, part = at // stride, at % stride // 3
    same = np.concatenate(([False], (own[1:] == own[:-1]) & (part[1:] == part[:-1])))
    total = np.cumsum(same)
    weight = np.bincount(own[same], minlength=len(limit))
    # weight of the owner's parts before this one: running sum at the start of the part less that at the start of the owner
    start = np.maximum.accumulate(np.where(same, 0, np.arange(len(at))))
    base = np.concatenate(([0], np.cumsum(weight)))[:-1]
    near = total[start] - base[own] <= limit[own]
    out = []
    for step in (1, 2):
        j = np.arange(step, len(at))
        both = same[j] & (start[j] <= j - step) & near[j]
        i = j[both] - step
        out.append((mixed(held[i] * _LEFT + held[i + step] * _RIGHT + part[i].astype(_U)), own[i]))
    return np.concatenate([s for s, _ in out]), np.concatenate([o for _, o in out]), weight


def _single_signatures(values, owner, limit, band):
    """(signature, owner) of the first features of every owner, in the order of their hashes."""
    n = np.bincount(owner, minlength=len(limit))
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    near = rank <= limit[owner]
    return mixed(values[near] * _LEFT), owner[near], n


def signatures(values: np.ndarray, sizes: np.ndarray, common: np.ndarray, similarity: int = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """(signature, index of its set) for sets that stand one after another."""
    band = np.frexp(np.maximum(sizes, 1))[1].astype(np.int64) - 1
    owner = np.repeat(np.arange(len(sizes)), sizes)
    rare = ~np.isin(values, common)
    most, sigs, owners = sizes * 100 // similarity, [], []
    for shift, partner in ((0, np.minimum(most, 2 ** (band + 1) - 1)), (1, np.where(most >= 2 ** (band + 1), most, 0))):
        limit = np.where(partner > 0, (100 - similarity) * (sizes + partner) // (100 + similarity), 0)
        wanting = limit > 0
        for kind, (only_rare, signed) in enumerate(((True, _part_signatures), (True, _single_signatures), (False, _part_signatures), (False, _single_signatures))):
            take = wanting[owner] & (rare | (not only_rare))
            sig, own, weight = signed(values[take], owner[take], limit, band + shift)
            sigs.append(mixed(sig + (band[own] + shift).astype(_U) * _BAND + _U(kind + 1) * _KIND))
            owners.append(own)
            wanting &= weight <= limit
            if not wanting.any():
                break
    return np.concatenate(sigs), np.concatenate(owners)


def _signed(common, similarity):
    def run(batches):
        often = common.value
        for rows, values, sizes in _sets(batches):
            own_set = [a == b for a, b in zip(_digests(values, sizes), rows.column(2).to_pylist(), strict=True)]
            sig, owner = signatures(values, sizes, often, similarity)
            kept = np.array(own_set)[owner]
            yield batch_of(_SIGNED, [sig[kept].view(np.int64), np.asarray(rows.column(0))[owner[kept]]])

    return run


def _shared_buckets(batches):
    """Of rows sorted by signature and set, those whose signature is not alone, with the least set of it."""
    held = None
    for batch in batches:
        sig, rep = (np.asarray(batch.column(i)) for i in (0, 1))
        if not len(sig):
            continue
        center, before = rep.copy(), np.zeros(len(sig), bool)
        if held is not None:
            sig, rep, center, before = (np.concatenate((x, y)) for x, y in zip(held, (sig, rep, center, before), strict=True))
        same = sig[1:] == sig[:-1]
        before[1:] |= same
        starts = np.flatnonzero(np.concatenate(([True], ~same)))
        center = np.repeat(center[starts], np.diff(np.concatenate((starts, [len(sig)]))))
        shared = before.copy()
        shared[:-1] |= same
        yield batch_of(_BUCKETS, [x[:-1][shared[:-1]] for x in (sig, rep, center)])
        held = [x[-1:] for x in (sig, rep, center, before)]
    if held is not None:
        yield batch_of(_BUCKETS, [x[held[3]] for x in held[:3]])


def _profiles(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BINS).astype(np.int16)


def _possible(similarity, n_a, n_b, profile_a, profile_b):
    """Whether sizes and profiles let two sets be similar enough."""
    alike = 100 * np.minimum(n_a, n_b) >= similarity * np.maximum(n_a, n_b)
    return alike & ((100 + similarity) * np.abs(profile_a - profile_b).sum(axis=-1, dtype=np.int64) <= (100 - similarity) * (n_a + n_b))


def _plausible(similarity):
    def run(batches):
        for batch in batches:
            n_a, n_b = (np.asarray(batch.column(i)) for i in (2, 3))
            yield batch.filter(pa.array(_possible(similarity, n_a, n_b, _profiles(batch.column(4)), _profiles(batch.column(5))))).select([0, 1])

    return run


def _met(similarity):
    """Pairs of a stray and a member of other components in every run of rows of one step."""
    def compared(run):
        rep, component, n, profile, stray = (np.concatenate(x) for x in zip(*run, strict=True))
        members = np.flatnonzero(~stray)
        for i in np.flatnonzero(stray):
            fit = (component[members] != component[i]) & _possible(similarity, n[i], n[members], profile[i], profile[members])
            for j in members[fit]:
                yield min(rep[i], rep[j]), max(rep[i], rep[j])

    def run(batches):
        key, held, seen = None, [], set()

        def handed_on(out):
            out = set(out) - seen
            if len(seen) + len(out) > REMEMBERED:
                seen.clear()
            seen.update(out)
            return batch_of(_PAIRS, list(zip(*out, strict=True)) if out else [[], []])

        for batch in batches:
            keys = np.stack([np.asarray(batch.column(i)) for i in (0, 1, 2)], 1)
            columns = [np.asarray(batch.column(i)) for i in (3, 4, 5)] + [_profiles(batch.column(6)), batch.column(7).to_numpy(zero_copy_only=False)]
            starts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1)))) if len(keys) else []
            out = []
            for a, b in zip(starts, [*starts[1:], len(keys)], strict=True):
                if held and tuple(keys[a]) != key:
                    out += compared(held)
                    held = []
                key = tuple(keys[a])
                held.append([c[a:b] for c in columns])
            yield handed_on(out)
        yield handed_on(compared(held) if held else ())

    return run


def _confirmed(similarity):
    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                rows = batch.slice(first, 64)
                n = rows.num_rows
                texts = raw_texts(rows.column(4)) + raw_texts(rows.column(5))
                distinct = {t: i for i, t in enumerate(dict.fromkeys(texts))}
                sets = []
                for _, values, sizes in _sets([pa.record_batch([pa.array(list(distinct), pa.binary())], ["text"])]):
                    sets += np.split(values, np.cumsum(sizes)[:-1])
                names = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                expected = rows.column(2).to_pylist() + rows.column(3).to_pylist()
                keep = []
                for i in range(n):
                    x, y = (distinct[texts[k]] for k in (i, n + i))
                    if names[x] != expected[i] or names[y] != expected[n + i]:
                        keep.append(False)
                        continue
                    both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    keep.append(100 * both >= similarity * (len(sets[x]) + len(sets[y]) - both))
                yield rows.filter(pa.array(keep, pa.bool_())).select([0, 1])

    return run


def _links(pairs: DataFrame, classes: DataFrame, docs: DataFrame, similarity: int) -> DataFrame:
    """The (a, b) pairs whose sets are similar enough: by sizes and profiles, then by the whole sets."""
    sides = [classes.select(F.col("rep").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("profile").alias(f"p_{x}")) for x in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "n_a", "n_b", "p_a", "p_b")
    both = stored(both.mapInArrow(_plausible(similarity), "a long, b long").distinct(), "jaccard-plausible")
    texts = [docs.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab"]
    names = [classes.select(F.col("rep").alias(x), F.col("set_id").alias(f"set_{x}")) for x in "ab"]
    both = both.join(names[0], "a").join(names[1], "b").join(texts[0], "a").join(texts[1], "b")
    return both.select("a", "b", "set_a", "set_b", "text_a", "text_b").mapInArrow(_confirmed(similarity), "a long, b long").distinct()


def _open_pairs(buckets: DataFrame, classes: DataFrame, found: DataFrame, similarity: int) -> DataFrame:
    """Pairs of a bucket that are in two components: each set outside the largest component next to all of the bucket.

    Buckets of the same sets are compared once, in steps of bounded size; only pairs that sizes and profiles leave come out.
    """
    of = found.select(F.col("node").alias("rep"), "component")
    members = buckets.join(of, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    by_part = members.groupBy("sig", "component").agg(F.count("*").alias("n"), F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("mark"))
    shape = by_part.groupBy("sig").agg(
        F.sum("n").alias("members"), F.sum("mark").alias("mark"), F.max(F.struct("n", "component")).alias("main")).where(
        (F.col("members") > 2) & (F.col("members") > F.col("main.n")))
    shape = shape.groupBy("members", "mark").agg(F.min("sig").alias("sig"), F.max("main").alias("main"))
    shape = shape.select("sig", F.col("main.component").alias("main"), F.ceil(F.col("members") / MEMBERS).alias("member_steps"),
                         F.ceil((F.col("members") - F.col("main.n")) / STRAYS).alias("stray_steps"))
    rows = members.join(shape, "sig").join(classes.select("rep", "n_shingles", "profile"), "rep")
    place, zero = F.xxhash64("rep"), F.lit(0).cast("long")
    every = rows.select("sig", F.explode(F.sequence(zero, F.col("stray_steps") - 1)).alias("i"), F.pmod(place, "member_steps").alias("j"),
                        "rep", "component", "n_shingles", "profile", F.lit(False).alias("stray"))
    strays = rows.where("component != main").select(
        "sig", F.pmod(place, "stray_steps").alias("i"), F.explode(F.sequence(zero, F.col("member_steps") - 1)).alias("j"),
        "rep", "component", "n_shingles", "profile", F.lit(True).alias("stray"))
    met = every.unionByName(strays).repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")
    return met.mapInArrow(_met(similarity), "a long, b long").distinct()


def jaccard_join(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id; ``similarity`` is the least of a link, in percent.

    Rows of one shingle set are one class. Sets with a signature in common are compared, each
    with the least set of the bucket, then those of a bucket in different components with one
    another, so no link is lost. A null or empty text has no features and is linked with
    nothing. A null doc_id counts as the smallest id; classes with the same smallest doc_id
    (rows that repeat an id) are one node. An empty table gives no rows; other columns than
    doc_id and text are not read. Features of a long text are made in pieces.
    """
    if not 0 < similarity < 100:
        raise ValueError("similarity is a percentage between 0 and 100")
    docs = docs.select(id_or_least().alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = stored(docs.mapInArrow(_profiled, "doc_id long, n_shingles long, set_id binary, profile binary"), "jaccard-sets")
    classes = stored(sets.where("n_shingles > 0").groupBy("set_id").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("profile").alias("profile")), "jaccard-classes")
    own = docs.join(classes.select(F.col("rep").alias("doc_id"), "set_id"), "doc_id")
    common = common_features(docs, classes.count())
    sent = docs.sparkSession.sparkContext.broadcast(common)
    signed = own.mapInArrow(_signed(sent, similarity), "sig long, rep long").repartition("sig").sortWithinPartitions("sig", "rep")
    buckets = stored(signed.mapInArrow(_shared_buckets, "sig long, rep long, center long"), "jaccard-buckets")
    pairs = stored(buckets.where("rep != center").select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct(), "jaccard-pairs")
    links = stored(_links(pairs, classes, docs, similarity), "jaccard-links")
    found = stored(components(links, "jaccard-first"), "jaccard-first")
    more = stored(_open_pairs(buckets.select("sig", "rep"), classes, found, similarity).join(pairs, ["a", "b"], "left_anti"), "jaccard-more")
    if more.take(1):
        links = stored(links.unionByName(_links(more, classes, docs, similarity)), "jaccard-links")
        found = stored(components(links, "jaccard-all"), "jaccard-all")
    named = classes.select("set_id", "rep").join(found, F.col("rep") == F.col("node"), "left").select(
        "set_id", F.coalesce("component", "rep").alias("component"))
    rows = sets.select("doc_id", "n_shingles", "set_id").join(named, "set_id", "left")
    return rows.select(id_or_null(F.col("doc_id")).alias("doc_id"), "n_shingles",
                       id_or_null(F.coalesce("component", "doc_id")).alias("component_id"))
