"""Benchmark decontamination: q-gram counts in overlapping diagonal bands, then banded alignment."""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from showbill.llm.common import batch_of, stored, text_blocks

#: Length of the q-grams in bytes: one 64-bit number.
Q = 8
#: Items are cut into segments of about this length; each may have a tenth of edits.
SEGMENT, EDITS = 80, 0.1
#: The removing operator drops a document that holds segments with this share of an item's length,
#: or one stretch of an item with this many bytes of verified segments.
SHARE, RUN = 0.5, 2 * SEGMENT
#: Step between diagonal bands, which are twice as wide; more than the edits of a segment.
BAND = 16
#: Benchmark text that is indexed and broadcast at a time; a larger benchmark takes several passes.
INDEX_BYTES = 2 << 20
#: Q-gram hits that are counted at a time, and rows of found segments that are joined to occurrences at a time.
HITS, ROWS = 1 << 20, 1 << 18
#: Bytes of the largest table of met q-grams.
FLAGS = 1 << 26
#: Segments of one item whose diagonals are at most this far apart belong to one occurrence.
DRIFT = 2 * BAND
#: Normalised text that is searched at a time; longer texts are cut into overlapping pieces.
PIECE, OVERLAP = 1 << 20, 1 << 10

_BITS = 22
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def normalised(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Letters and digits of a lower-cased text with single blanks between, and where they stand."""
    data = np.frombuffer(text.translate(_TABLE), np.uint8)
    blank = data == 32
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    at = np.flatnonzero(keep)
    return data[at], at


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... of n[i] numbers for every i, one after another."""
    return np.repeat(first - np.cumsum(n, dtype=n.dtype) + n, n) + np.arange(n.sum(), dtype=n.dtype)


class Index:
    """The q-grams of the distinct segments of some benchmark items."""

    def __init__(self, items: list[tuple], segment: int = SEGMENT, edits: float = EDITS):
        self.item, self.texts, sizes, budget, need = [], [], [], [], []
        known: dict[bytes, int] = {}
        grams, owner, offsets, uses = [], [], [], []
        for item, text in items:
            data = normalised(text)[0].tobytes().strip()
            if len(data) < Q:
                continue
            # items with a common opening have its segments in common
            n = max(1, round(len(data) / segment))
            for number in range(n):
                a, b = segment * number, segment * (number + 1) if number < n - 1 else len(data)
                part = data[a:b]
                if part not in known:
                    known[part] = len(self.texts)
                    size = b - a
                    # the lemma must leave at least one common q-gram
                    k = max(0, min(int(edits * size), (size - Q) // Q, BAND - 1))
                    codes = np.ndarray((size - Q + 1,), "<u8", part, strides=(1,)).copy()
                    grams.append(codes)
                    owner.append(np.full(len(codes), len(self.texts), np.int32))
                    offsets.append(np.arange(len(codes), dtype=np.int32))
                    self.texts.append(part)
                    budget.append(k)
                    need.append(size - Q + 1 - k * Q)
                uses.append((known[part], len(self.item), number, a))
            self.item.append(item)
            sizes.append(len(data))
        self.item_size = np.array(sizes, np.int64)
        self.budget, self.need = np.array(budget, np.int64), np.array(need, np.int64)
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        codes = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(codes, kind="stable")
        self.codes, self.first, self.count = np.unique(codes[order], return_index=True, return_counts=True)
        self.segment = np.concatenate(owner)[order] if owner else np.zeros(0, np.int32)
        self.offset = np.concatenate(offsets)[order] if offsets else np.zeros(0, np.int32)
        self.filter = np.zeros(1 << _BITS, bool)
        self.filter[(self.codes * _MULTIPLIER) >> np.uint64(64 - _BITS)] = True
        # where segments are used, by segment and item
        self.uses = np.array(sorted(uses), np.int64).reshape(-1, 4)
        self.use_key = self.uses[:, 0] * len(self.item) + self.uses[:, 1]

    def _hits(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the text that start an indexed q-gram, and which one."""
        codes = np.ndarray((len(data) - Q + 1,), "<u8", data.tobytes(), strides=(1,))
        at = np.flatnonzero(self.filter[(codes * _MULTIPLIER) >> np.uint64(64 - _BITS)])
        gram = np.minimum(np.searchsorted(self.codes, codes[at]), len(self.codes) - 1)
        same = self.codes[gram] == codes[at]
        return at[same], gram[same]

    def windows(self, data: np.ndarray, hits: int = HITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(segment, band) pairs with as many common q-grams as the lemma asks for, window by window.

        Windows hold about ``hits`` q-gram hits and overlap by more than a match, so that each
        match lies within one and its q-grams are counted together. A window of common grams
        that has more is counted in blocks whose sums are merged.
        """
        if len(data) < Q or not len(self.codes):
            return
        at, gram = self._hits(data)
        n = self.count[gram]
        total = np.cumsum(n)
        lap = int(self.sizes.max()) + 2 * BAND
        first = 0
        while first < len(at):
            done = total[first] - n[first]
            last = max(int(np.searchsorted(total, done + hits, "right")), int(np.searchsorted(at, at[first] + 4 * lap)), first + 1)
            yield self._enough(at[first:last], gram[first:last], hits)
            if last >= len(at):
                return
            first = int(np.searchsorted(at, at[last] - lap))

    def _enough(self, at, gram, hits):
        n = self.count[gram]
        block = (np.cumsum(n) - n) // hits
        # bands from the first that the window's places can lie in
        low = (int(at[0]) + SEGMENT * 4 - int(self.sizes.max())) // BAND if len(at) else 0
        own = (int(at[-1]) + SEGMENT * 4) // BAND + 2 - low if len(at) else 1
        # every q-gram of a segment counts once in a band; where most bands are met a table of flags is filled
        grams = int(self.sizes.max()) - Q + 1
        cells = len(self.texts) * own * grams
        flags = np.zeros(cells, bool) if cells <= min(FLAGS, 64 * int(n.sum())) else None
        kind = np.int64 if flags is None else np.int32
        met = np.zeros(0, np.int64)
        edges = np.flatnonzero(np.diff(block, prepend=-1, append=-1))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            hit = _spread(self.first[gram[a:b]].astype(kind), n[a:b].astype(kind))
            offset = self.offset[hit].astype(kind)
            diagonal = np.repeat(at[a:b].astype(kind) + kind(SEGMENT * 4 - low * BAND), n[a:b]) - offset
            cell = self.segment[hit].astype(kind) * kind(own * grams) + diagonal // kind(BAND) * kind(grams) + offset
            if flags is not None:
                flags[cell] = True
            else:
                met = np.unique(np.concatenate((met, cell)))
        # a band and the next one make one of twice the width; it is named after the first
        if flags is not None:
            table = flags.reshape(len(self.texts), own, grams)
            table[:, :-1] |= table[:, 1:]
            sums = np.count_nonzero(table, axis=2)
            segment, band = np.nonzero(sums >= self.need[:, None])
        else:
            both = np.unique(np.concatenate((met, met[met // grams % own > 0] - grams)))
            key, sums = np.unique(both // grams, return_counts=True)
            key = key[sums >= self.need[key // own]]
            segment, band = key // own, key % own
        return segment, (band + low) * BAND - SEGMENT * 4

    def candidates(self, data: np.ndarray, hits: int = HITS) -> tuple[np.ndarray, np.ndarray]:
        """The (segment, band) pairs of all windows."""
        found = list(self.windows(data, hits)) or [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        pairs = np.unique(np.concatenate([np.stack(f, axis=1) for f in found]), axis=0)
        return pairs[:, 0], pairs[:, 1]

    def _alignments(self, data, segment, diagonal, chunk: int = 512):
        """(candidates, edits, first end) by chunks: a row of edits for each end from the first on."""
        order = np.argsort(self.sizes[segment], kind="stable")
        for i in range(0, len(order), chunk):
            own = order[i:i + chunk]
            yield own, *self._banded(data, segment[own], diagonal[own])

    def _banded(self, data, segment, diagonal):
        size, budget, n = self.sizes[segment], self.budget[segment], len(segment)
        width, longest = 2 * BAND + 2 * BAND, int(size.max())
        base = diagonal - BAND
        span = base[:, None] + np.arange(longest + width)
        text = np.where((span >= 0) & (span < len(data)), data[np.clip(span, 0, len(data) - 1)], 0).astype(np.int16)
        pattern = np.zeros((n, longest), np.int16)
        for j, s in enumerate(segment):
            pattern[j, :size[j]] = np.frombuffer(self.texts[s], np.uint8)
        border = np.int32(10_000)  # nothing is matched across the border of texts
        along = np.cumsum(np.where(text == 0, border, 1).astype(np.int32), axis=1, dtype=np.int32)
        row, live = np.zeros((n, width), np.int32), np.arange(n)
        edits = np.full((n, width), border, np.int32)
        for i in range(longest):
            here = text[:, i:i + width]
            step = row + np.where(here == 0, border, (here != pattern[:, i:i + 1]).astype(np.int32))
            step[:, :-1] = np.minimum(step[:, :-1], row[:, 1:] + 1)
            sums = along[:, i:i + width]
            row = np.minimum(np.minimum.accumulate(step - sums, axis=1) + sums, border)
            done = np.flatnonzero(size[live] == i + 1)
            edits[live[done]] = row[done]
            if i % 8 == 7:
                # the least of a row never falls: what is over its budget stays so
                open_ = (row.min(axis=1) <= budget[live]) & (size[live] > i + 1)
                if not open_.any():
                    break
                if 2 * open_.sum() < len(live):
                    live, row, text, pattern, along = live[open_], row[open_], text[open_], pattern[open_], along[open_]
        return edits, base + size

    def aligned(self, data: np.ndarray, segment: np.ndarray, diagonal: np.ndarray):
        """(edits, end) of the best match of each segment that begins near the diagonal."""
        best, ends = np.empty(len(segment), np.int64), np.empty(len(segment), np.int64)
        for own, edits, first in self._alignments(data, segment, diagonal):
            at = edits.argmin(axis=1)
            best[own], ends[own] = edits[np.arange(len(own)), at], first + at
        return best, ends

    def regions(self, data: np.ndarray, hits: int = HITS) -> np.ndarray:
        """Rows (segment, end, edits) of every place within the edit budget that has no better neighbour."""
        out = []
        for segment, diagonal in self.windows(data, hits):
            for own, edits, first in self._alignments(data, segment, diagonal):
                least = edits <= self.budget[segment[own]][:, None]
                least[:, 1:] &= edits[:, 1:] <= edits[:, :-1]
                least[:, :-1] &= edits[:, :-1] <= edits[:, 1:]
                row, at = np.nonzero(least)
                if len(row):
                    out.append(np.stack((segment[own[row]], first[row] + at, edits[row, at]), axis=1))
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), np.int64)

    def _apart(self, found: np.ndarray) -> np.ndarray:
        """Of the rows (text, segment, end, edits) of overlapping places of a segment the best, by edits and end."""
        found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
        gap = np.maximum(1, self.sizes - self.budget)[found[:, 1]]
        new = np.ones(len(found), bool)
        new[1:] = (np.diff(found[:, 0]) != 0) | (np.diff(found[:, 1]) != 0) | (np.diff(found[:, 2]) >= gap[1:])
        run = np.cumsum(new) - 1
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(found))
        best = np.lexsort((found[:, 2], found[:, 3], run))[heads]
        long = np.flatnonzero(found[tails - 1, 2] - found[heads, 2] >= gap[heads])
        more = []
        for j in long:
            # places of one run that do not overlap with one another, the best first
            taken: list[int] = []
            for r in sorted(range(heads[j], tails[j]), key=lambda r: (found[r, 3], found[r, 2])):
                end = int(found[r, 2])
                p = bisect.bisect_left(taken, end)
                if (p == len(taken) or taken[p] - end >= gap[r]) and (p == 0 or end - taken[p - 1] >= gap[r]):
                    taken.insert(p, end)
                    more.append(r)
        keep = np.concatenate((np.delete(best, long), np.array(more, np.int64)))
        return found[np.sort(keep)]

    def _located(self, texts: list[bytes], hits: int = HITS, piece_bytes: int = PIECE) -> np.ndarray:
        """Rows (text, segment, end, edits) of every place of a segment in a text, in normalised bytes."""
        held, size, out = [], 0, []

        def search():
            data = np.concatenate([x for _, _, piece in held for x in (piece, [0])]).astype(np.uint8)
            first = np.cumsum([0, *(len(p) + 1 for _, _, p in held)])
            found = self.regions(data, hits)
            own = np.searchsorted(first, found[:, 1] - 1, "right") - 1
            text, offset = (np.array([h[c] for h in held], np.int64)[own] for c in (0, 1))
            out.append(np.stack((text, found[:, 0], found[:, 1] - first[own] + offset, found[:, 2]), axis=1))

        for i, text in enumerate(texts):
            data = normalised(text)[0]
            for at in range(0, max(1, len(data) - OVERLAP), piece_bytes - OVERLAP):
                piece = data[at:at + piece_bytes]
                if len(piece) < Q or not len(self.codes):
                    continue
                if held and size + len(piece) > piece_bytes:
                    search()
                    held, size = [], 0
                held.append((i, at, piece))
                size += len(piece)
        if held:
            search()
        found = np.concatenate(out) if out else np.zeros((0, 4), np.int64)
        return self._apart(found) if len(found) else found

    def _used(self, found: np.ndarray, rows: int = ROWS) -> Iterator[np.ndarray]:
        """Rows (text, item, number, diagonal, end, edits, size) of the places by item, some items at a time."""
        items, segment = len(self.item), found[:, 1]
        total = int(np.bincount(self.uses[:, 0], minlength=len(self.texts))[segment].sum())
        passes = min(items, -(-total // rows))
        for p in range(passes):
            low, high = (np.searchsorted(self.use_key, segment * items + items * q // passes) for q in (p, p + 1))
            n = high - low
            if not n.any():
                continue
            use, of = self.uses[_spread(low, n)], np.repeat(np.arange(len(found)), n)
            size = self.sizes[segment[of]]
            yield np.stack((found[of, 0], use[:, 1], use[:, 2], found[of, 2] - size - use[:, 3], found[of, 2], found[of, 3], size), axis=1)

    @staticmethod
    def occurrences(used: np.ndarray) -> np.ndarray:
        """Rows (text, item, matched bytes, edits, start, end) of every occurrence of an item or a part of it.

        Places of an item's segments on neighbouring diagonals and in their order make one
        occurrence; a segment that comes again begins another.
        """
        used = used[np.lexsort((used[:, 3], used[:, 1], used[:, 0]))]
        apart = np.ones(len(used), bool)
        apart[1:] = (np.diff(used[:, 0]) != 0) | (np.diff(used[:, 1]) != 0) | (np.diff(used[:, 3]) > DRIFT)
        group = np.cumsum(apart)
        order = np.lexsort((used[:, 2], used[:, 4] - used[:, 6], group))
        used, group = used[order], group[order]
        new = np.ones(len(used), bool)
        new[1:] = (np.diff(group) != 0) | (np.diff(used[:, 2]) <= 0)
        at = np.flatnonzero(new)
        return np.stack((
            used[at, 0], used[at, 1], np.add.reduceat(used[:, 6], at), np.add.reduceat(used[:, 5], at),
            np.maximum(0, np.minimum.reduceat(used[:, 4] - used[:, 6], at)), np.maximum.reduceat(used[:, 4], at)), axis=1)

    def matches(self, texts: list[bytes], hits: int = HITS, rows: int = ROWS, piece_bytes: int = PIECE) -> Iterator[tuple]:
        """(text index, item, matched share, edits, start, end) as columns, some occurrences at a time."""
        ids = np.array(self.item, object)
        for used in self._used(self._located(texts, hits, piece_bytes), rows):
            found = self.occurrences(used)
            found = found[np.lexsort((found[:, 4], found[:, 1], found[:, 0]))]
            start, end = np.empty(len(found), np.int64), np.empty(len(found), np.int64)
            bounds = np.flatnonzero(np.diff(found[:, 0], prepend=-1, append=-1))
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                where = normalised(texts[found[a, 0]])[1]
                start[a:b], end[a:b] = where[found[a:b, 4]], where[found[a:b, 5] - 1] + 1
            yield found[:, 0], ids[found[:, 1]], found[:, 2] / self.item_size[found[:, 1]], found[:, 3], start, end

    def holding(self, texts: list[bytes], share: float = SHARE, run: int = RUN) -> set[int]:
        """The texts that hold segments with a share of an item, or a run of its bytes in one occurrence."""
        out: set[int] = set()
        for used in self._used(self._located(texts)):
            once = used[np.unique(used[:, :3], axis=0, return_index=True)[1]]
            new = np.flatnonzero((np.diff(once[:, 0], prepend=-1) != 0) | (np.diff(once[:, 1], prepend=-1) != 0))
            part = np.add.reduceat(once[:, 6], new) / self.item_size[once[new, 1]]
            found = self.occurrences(used)
            out.update(once[new[part >= share], 0].tolist(), found[found[:, 2] >= run, 0].tolist())
        return out


def blocks(benchmark: DataFrame, index_bytes: int = INDEX_BYTES) -> tuple[int, Iterator]:
    """How many blocks of about ``index_bytes`` of item text there are, and the broadcast index of each in turn."""
    items = benchmark.select("item_id", F.lower(F.col("text").cast("string")).alias("text")).where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / index_bytes))

    def each():
        for block in range(n):
            rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block).collect()
            yield benchmark.sparkSession.sparkContext.broadcast(Index([(r.item_id, r.text.encode()) for r in rows]))

    return n, each()


_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("share", pa.float64()), ("edits", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def contaminated(docs: DataFrame, benchmark: DataFrame, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """(doc_id, item_id, share, edits, start, end) of every occurrence of a benchmark item, or of a part, in a document.

    Texts are compared as lower-cased letters and digits with single blanks between words.
    An item is cut into segments of about 80 bytes; a segment is found wherever an edit
    distance of a tenth of its length is met. By the q-gram lemma such a place shares a known
    number of 8-byte grams with the segment within a band of diagonals, so all others are
    passed over. Found segments of an item that follow one another make one occurrence, and
    ``share`` is their part of the item's length: an item that stands in a document twice gives
    two rows, and one copied in part gives a row with a small share. Of overlapping places of
    one segment the best counts. start and end are byte offsets in the lower-cased text; the
    start is reckoned from the first segment's end and length, so that its edits may shift it.
    Items of fewer than 8 bytes, and null or empty items and texts, match nothing. A null
    doc_id stays null and repeated rows give repeated results; items that repeat an item_id
    with another text count by themselves. Other columns are not read. Empty tables give no
    rows. Documents are not shuffled; a long text is searched piece by piece. A benchmark
    beyond ``index_bytes`` is taken in blocks, one broadcast at a time, with a pass over the
    documents and a written table for each.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text"))
    n, each = blocks(benchmark, index_bytes)
    out = None
    for index in each:
        def run(batches, index=index):
            for block, texts in text_blocks(batches):
                for text, *columns in index.value.matches(texts):
                    yield batch_of(_FOUND, [block.column(0).take(pa.array(text)), *columns])

        part = rows.mapInArrow(run, "doc_id long, item_id long, share double, edits long, start long, end long")
        if n > 1:
            part = stored(part, "contaminated")
            index.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(
        docs: DataFrame, benchmark: DataFrame, index_bytes: int = INDEX_BYTES, share: float = SHARE, run_bytes: int = RUN) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns.

    A document goes if the segments found in it make up ``share`` of an item, or ``run_bytes``
    of one in a single occurrence. Nulls, empty and long texts count as in ``contaminated``.
    """
    out = docs
    n, each = blocks(benchmark, index_bytes)
    for index in each:
        names = [f"_{i}" for i in range(len(docs.columns))]
        rows = out.toDF(*names)
        text = names[docs.columns.index("text")]

        def run(batches, index=index):
            for block, texts in text_blocks(batches, "_lower"):
                found = index.value.holding(texts, share, run_bytes)
                yield block.select(range(block.num_columns - 1)).filter(pa.array([i not in found for i in range(len(texts))], pa.bool_()))

        out = rows.withColumn("_lower", F.lower(F.col(text).cast("string"))).mapInArrow(run, rows.schema).toDF(*docs.columns)
        if n > 1:
            out = stored(out, "decontaminated")
            index.destroy()
    return out
