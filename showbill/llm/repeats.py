"""Exact substring dedup: longest-previous-factor arrays over the stretches that may repeat.

Every string of ``length`` bytes is assigned to the least hash among its 32-byte grams, its
anchor, so equal strings always have equal anchors. Consecutive starts with one anchor form
a run. Runs of equal bytes are settled by their fingerprint: all but the first are copies.
Runs that share the anchor but differ go, as text, to the longest-previous-factor step,
which finds for each start the longest match that begins earlier.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from showbill.llm.common import batch_of, id_or_least, id_or_null, raw_texts, stored, text_blocks
from showbill.llm.words import mixed, powers, span_hashes
from showbill.llm.words import _BACK, _BASE, _BYTE

LENGTH, GRAM = 100, 32
#: Low bits of a gram's key that hold its position.
POSITION_BITS = 24
#: Text bytes whose runs are cut together; longer texts go in pieces of this size, so that
#: working arrays do not grow with a text and positions keep within their bits.
PIECE_BYTES = 1 << 20
#: Text bytes whose runs meet in one bucket; buckets are as many as the corpus needs.
BUCKET_BYTES = 16 << 20
#: Different runs of one anchor that one task compares; anchors with more are settled by
#: grouping their strings.
GROUP_RUNS = 20_000
#: Run text that the longest-previous-factor step holds at a time.
STEP_BYTES = 1 << 20

_U = np.uint64
#: Anchor, fingerprint and place (doc_id, text hash, start) of a run, and its number of starts.
_RUN = np.dtype([("h", "<i8"), ("f", "<i8"), ("doc", "<i8"), ("t", "<i4"), ("s", "<i8"), ("n", "u1")])
_PLACE = np.dtype([("doc", "<i8"), ("t", "<i4"), ("s", "<i8"), ("n", "u1")])
_ORDER = ["h", "f", "doc", "t", "s"]


def anchored(data: np.ndarray, first: np.ndarray, last: np.ndarray, length: int = LENGTH):
    """(anchor hash, run start, run length, text index) of all runs of the texts data[first:last]."""
    gram = min(GRAM, length)
    grams, window = len(data) - gram + 1, length - gram + 1
    none = np.zeros(0, np.int64)
    if grams < window:
        return none, none, none, none
    if grams > 1 << POSITION_BITS:
        raise ValueError(f"{grams} grams do not fit {POSITION_BITS} bits of position")
    position = _U((1 << POSITION_BITS) - 1)
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE[data] * powers(_BASE, len(data)), out=total[1:])
    hashes = mixed((total[gram:] - total[:grams]) * powers(_BACK, grams))
    # least by the high bits, leftmost among equals by the position in the low ones
    key = (hashes & ~position) | np.arange(grams, dtype=_U)
    padded = np.full(-(-grams // window) * window, ~_U(0), _U)
    padded[:grams] = key
    square = padded.reshape(-1, window)
    left = np.minimum.accumulate(square, axis=1).ravel()
    right = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    n = grams - window + 1
    anchor = (np.minimum(right[:n], left[window - 1:window - 1 + n]) & position).astype(np.int64)
    long_ = np.flatnonzero(last - first >= length)
    sizes = (last - first - length + 1)[long_]
    starts = np.repeat(first[long_], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    if not len(starts):
        return none, none, none, none
    owner, anchor = np.repeat(long_, sizes), anchor[starts]
    cut = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]))))
    counts = np.diff(np.concatenate((cut, [len(starts)])))
    return hashes[anchor[cut]].view(np.int64), starts[cut], counts, owner[cut]


def _pieces(texts, length, size):
    """(text index, offset, piece): texts of over ``size`` bytes are cut into pieces that overlap."""
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), size):
            yield i, at, text if len(text) <= size else text[at:at + size + length - 1]


def _groups(pieces, size):
    """The pieces as (text indexes, offsets, pieces) of up to ``size`` bytes, one piece at least."""
    held, total = [], 0
    for piece in pieces:
        if held and total + len(piece[2]) > size:
            yield zip(*held, strict=True)
            held, total = [], 0
        held.append(piece)
        total += len(piece[2])
    if held:
        yield zip(*held, strict=True)


def _runs(buckets: int, length: int, piece_bytes: int = PIECE_BYTES):
    schema = pa.schema([("bucket", pa.int64()), ("runs", pa.binary()), ("copies", pa.binary())])

    def run(batches):
        for rows, texts in text_blocks(batches):
            for row, offsets, pieces in _groups(_pieces(texts, length, piece_bytes), piece_bytes):
                row, offsets = np.array(row, np.int64), np.array(offsets, np.int64)
                ids, hashes = (rows.column(i).to_numpy(zero_copy_only=False)[row] for i in (0, 2))
                data = np.frombuffer(b"".join(pieces), np.uint8)
                last = np.cumsum([len(p) for p in pieces])
                first = last - [len(p) for p in pieces]
                h, starts, counts, owner = anchored(data, first, last, length)
                if not len(h):
                    continue
                out = np.empty(len(h), _RUN)
                out["h"], out["f"] = h, span_hashes(data, starts, starts + counts + length - 1).view(np.int64)
                out["doc"], out["t"], out["s"], out["n"] = ids[owner], hashes[owner], starts - first[owner] + offsets[owner], counts
                copies, out = _copies(out)
                to = (out["h"].view(_U) % _U(buckets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                to, out = to[order], out[order]
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(to)) + 1, [len(to)]))
                names = [int(to[a]) for a in cuts[:-1]]
                blobs = [out[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                if len(copies):  # settled already: they may go anywhere
                    places = np.empty(len(copies), _PLACE)
                    for c in _PLACE.names:
                        places[c] = copies[c]
                    names, blobs = [*names, names[int(ids[0]) % len(names)]], [*blobs, b""]
                    yield batch_of(schema, [names, blobs, [b""] * (len(names) - 1) + [places.tobytes()]])
                else:
                    yield batch_of(schema, [names, blobs, [b""] * len(names)])

    return run


def _copies(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(runs with an equal one at an earlier place, the first of each kind); rows that repeat a document stand at one place."""
    runs = runs[np.lexsort([runs[c] for c in reversed(_ORDER)])]
    new = np.ones(len(runs), bool)
    new[1:] = (runs["h"][1:] != runs["h"][:-1]) | (runs["f"][1:] != runs["f"][:-1])
    lead = runs[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(runs) else runs
    later = (runs["doc"] != lead["doc"]) | (runs["t"] != lead["t"]) | (runs["s"] != lead["s"])
    return runs[later], runs[new]


def _settled(frame: pd.DataFrame) -> pd.DataFrame:
    """Copies (h is null) and, for anchors with different runs, the first of each (h is set)."""
    known = np.frombuffer(b"".join(frame["copies"]), _PLACE)
    copies, firsts = _copies(np.frombuffer(b"".join(frame["runs"]), _RUN))
    change = np.flatnonzero(np.concatenate(([True] * bool(len(firsts)), firsts["h"][1:] != firsts["h"][:-1])))
    sizes = np.diff(np.concatenate((change, [len(firsts)])))
    several = firsts[np.repeat(sizes, sizes) > 1]
    out = [pd.DataFrame({"doc_id": x["doc"], "t": x["t"], "s": x["s"], "n": x["n"].astype(np.int32), "h": pd.array(h, dtype="Int64")})
           for x, h in ((known, [None] * len(known)), (copies, [None] * len(copies)), (several, several["h"]))]
    return pd.concat(out, ignore_index=True)


def _ranks(data: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the 64 and of the 128 bytes from each position, by doubling; groups never match."""
    padded = np.concatenate((data, np.zeros(256, np.uint8)))
    eight = np.zeros(len(data), _U)
    for j in range(8):
        eight = (eight << _U(8)) | padded[j:j + len(data)]
    _, rank = np.unique(eight, return_inverse=True)
    rank, size, at64 = rank.astype(_U), 8, None
    rank = np.unique(group.astype(_U) * _U(len(data) + 1) + rank, return_inverse=True)[1].astype(_U)
    while size < 128:
        beyond = np.concatenate((rank[size:], np.zeros(min(size, len(rank)), _U)))[:len(rank)]
        rank = np.unique(rank * _U(len(data) + 1) + beyond, return_inverse=True)[1].astype(_U)
        size *= 2
        if size == 64:
            at64 = rank
    return at64, rank


def _previous_smaller(order: np.ndarray) -> np.ndarray:
    """For each place in suffix order the nearest place before it with a smaller position, or -1."""
    n = len(order)
    held = np.concatenate((order, [-1]))  # place -1 is smaller than all
    to = np.concatenate((np.arange(n) - 1, [-1]))
    open_ = np.arange(n)
    while len(open_):
        open_ = open_[held[to[open_]] > order[open_]]
        to[open_] = to[to[open_]]
    return to[:-1]


def covered_starts(runs: list[bytes], owned: list[int], groups: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each run, in order of position, its starts whose longest previous factor has ``length`` bytes.

    Only the first ``owned`` starts of a run belong to it. The suffixes are sorted by their
    first 128 bytes; among the suffixes before and after it in that order, the nearest that
    begin earlier in the text hold the longest earlier match.
    """
    sizes = np.array([len(r) for r in runs])
    base = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(runs), np.uint8)
    at64, rank = _ranks(data, np.repeat(np.array(groups), sizes))
    owned = np.array(owned)
    starts = np.repeat(base, owned) + np.arange(owned.sum()) - np.repeat(np.cumsum(owned) - owned, owned)
    suffixes = starts[np.lexsort((starts, rank[starts]))]
    previous = _previous_smaller(suffixes)
    following = len(suffixes) - 1 - _previous_smaller(suffixes[::-1])[::-1]
    covered = np.zeros(len(suffixes), bool)
    step = length - 64

    def matches(p, q):
        if length < 64:
            return np.array([data[a:a + length].tobytes() == data[b:b + length].tobytes() for a, b in zip(p, q, strict=True)], bool)
        return (at64[p] == at64[q]) & (at64[p + step] == at64[q + step])

    for near, ok in ((previous, previous >= 0), (following, following < len(suffixes))):
        i = np.flatnonzero(ok)
        covered[i] |= matches(suffixes[i], suffixes[near[i]])
    hit = np.sort(suffixes[covered])
    of = np.searchsorted(base, hit, "right") - 1
    return [hit[a:b] - base[k] for k, (a, b) in enumerate(zip(
        np.searchsorted(of, np.arange(len(runs))), np.searchsorted(of, np.arange(len(runs)), "right"), strict=True))]


def _run_texts(batches):
    schema = pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("t", pa.int32()), ("s", pa.int64()), ("n", pa.int32()), ("run", pa.binary())])
    for rows, texts in text_blocks(batches):
        keys = zip(*(rows.column(i).to_pylist() for i in (0, 2, 3)), strict=True)
        out = [(r["h"], i, t, r["s"], r["n"], text[r["s"]:r["s"] + r["n"] + r["more"]])
               for text, (i, t, runs) in zip(texts, keys, strict=True) for r in runs]
        yield batch_of(schema, list(zip(*out, strict=True)) if out else [[]] * 6)


def _factors(length: int):
    schema = pa.schema([("doc_id", pa.int64()), ("t", pa.int32()), ("s", pa.int64()), ("n", pa.int32())])

    def settle(rows: list[tuple]):
        found = covered_starts([r[5] for r in rows], [r[4] for r in rows], np.unique([r[0] for r in rows], return_inverse=True)[1], length)
        out = []
        for (_, doc, t, s, _, _), starts in zip(rows, found, strict=True):
            if len(starts):
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(starts) > 1) + 1, [len(starts)]))
                out += [(doc, t, s + int(starts[a]), int(b - a)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return batch_of(schema, list(zip(*out, strict=True)) if out else [[]] * 4)

    def run(batches):
        """Rows come sorted by anchor and position; whole anchors are settled together."""
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if size >= STEP_BYTES and row[0] != held[-1][0]:
                    yield settle(held)
                    held, size = [], 0
                if held and row[:4] == held[-1][:4]:
                    continue
                held.append(row)
                size += len(row[5])
        if held:
            yield settle(held)

    return run


def _by_grouping(runs: DataFrame, length: int) -> DataFrame:
    """Covered starts of anchors with very many different runs: their strings are grouped."""
    strings = runs.select("doc_id", "t", "s", "run", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")).select(
        F.struct("doc_id", "t", (F.col("s") + F.col("i")).alias("s")).alias("at"),
        F.substring(F.col("run"), F.col("i") + 1, F.lit(length)).alias("string"))
    first = strings.groupBy("string").agg(F.min("at").alias("first"))
    return strings.join(first, "string").where("at != first").select(
        "at.doc_id", "at.t", "at.s", F.lit(1).cast("int").alias("n"))


def _removed(length: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])

    def run(batches):
        for rows, texts in text_blocks(batches):
            spans, kept = [], []
            for text, runs in zip(texts, rows.column(2), strict=True):
                if not runs.is_valid:
                    spans.append([])
                    kept.append(text)
                    continue
                s, n = (runs.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("s", "n"))
                order = np.argsort(s)
                s, e = s[order], np.maximum.accumulate((s + n + length - 1)[order])
                new = np.concatenate(([True], s[1:] > e[:-1]))
                a, b = s[new], e[np.concatenate((new[1:], [True]))]
                b = np.minimum(b, len(text))
                spans.append([{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)])
                edges = [0, *np.stack((a, b), axis=1).ravel().tolist(), len(text)]
                kept.append(b"".join(text[x:y] for x, y in zip(edges[0::2], edges[1::2], strict=True)))
            yield batch_of(schema, [rows.column(0), [len(t) for t in texts], spans, kept])

    return run


def remove_repeats(
        docs: DataFrame, length: int = LENGTH, group_runs: int = GROUP_RUNS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """One row per input row: doc_id, n_bytes, spans (removed byte ranges, disjoint and maximal), kept (the other bytes).

    A byte goes if a string of ``length`` bytes over it also starts at a smaller doc_id, or
    earlier in the document; strings may overlap, and all are judged on the input. Texts
    count as UTF-8 bytes. A null text counts as empty and a null doc_id as the smallest id.
    Rows that repeat a document are one document; different texts under one doc_id are
    documents ordered by a hash of the text. Texts shorter than ``length`` stay whole. An empty table gives no rows,
    and columns other than doc_id and text are not read. Up to 127 bytes of length.
    """
    if not 1 <= length <= 127:
        raise ValueError("length must be between 1 and 127")
    docs = docs.select(id_or_least().alias("doc_id"), F.col("text").cast("string").alias("text"), F.hash(F.col("text").cast("string")).alias("t"))
    key = ["doc_id", "t"]
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(total / BUCKET_BYTES))
    runs = docs.mapInArrow(_runs(buckets, length, piece_bytes), "bucket long, runs binary, copies binary")
    settled = stored(runs.groupBy("bucket").applyInPandas(_settled, "doc_id long, t int, s long, n int, h long"), "repeats-runs")
    different = settled.where("h is not null")
    texts = different.groupBy(*key).agg(F.collect_list(F.struct("h", "s", "n", F.lit(length - 1).alias("more"))).alias("runs"))
    # the same rows of a repeated document give equal run texts, which count once
    texts = docs.join(texts, key).select("doc_id", "text", "t", "runs").mapInArrow(
        _run_texts, "h long, doc_id long, t int, s long, n int, run binary")
    many = stored(different.groupBy("h").count().where(F.col("count") > group_runs).select("h"), "repeats-many")
    step = texts
    covered = settled.where("h is null").select(*key, "s", "n")
    if many.take(1):
        covered = covered.unionByName(_by_grouping(texts.join(many, "h", "left_semi"), length))
        step = texts.join(many, "h", "left_anti")
    covered = covered.unionByName(step.repartition("h").sortWithinPartitions("h", "doc_id", "t", "s").mapInArrow(
        _factors(length), "doc_id long, t int, s long, n int"))
    places = covered.groupBy(*key).agg(F.collect_list(F.struct("s", "n")).alias("runs"))
    out = docs.join(places, key, "left").select("doc_id", "text", "runs").mapInArrow(
        _removed(length), "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
    return out.withColumn("doc_id", id_or_null(F.col("doc_id")))
