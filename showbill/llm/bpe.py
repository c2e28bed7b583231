"""Byte-level BPE by overlapping chunks that are stitched where their pre-tokens resynchronise."""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from showbill.llm.common import batch_of, text_blocks

#: Characters of a chunk and of its overlap with the next one.
CHUNK, OVERLAP = 1 << 15, 1 << 10

_IDS = np.dtype("<u4")


@lru_cache(maxsize=2)
def encoding(ranks: str, pattern: str):
    import tiktoken

    with open(ranks, "rb") as lines:
        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})


def boundaries(text: str, pattern: str) -> list[int]:
    """Ends of pre-tokens between a character that is no white space and an ASCII blank or line end.

    A text may be cut there: no match looks back, and none that ends so looks ahead. The end
    of the text is no such place, as its last match may be cut short.
    """
    import regex

    ends = (m.end() for m in regex.finditer(pattern, text))
    return [e for e in ends if e < len(text) and text[e] in " \t\r\n" and not text[e - 1].isspace()]


_CHUNK = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("idx", pa.int32()), ("start", pa.int64()), ("last", pa.bool_()), ("chunk", pa.string())])


def _chunks(size: int, overlap: int):
    def run(batches):
        for rows, texts in text_blocks(batches):
            for i, raw in zip(rows.column(0).to_pylist(), texts, strict=True):
                text, digest = raw.decode("utf-8", "replace"), hashlib.sha256(raw).digest()
                starts = list(range(0, max(1, len(text) - overlap), size - overlap))
                for k, at in enumerate(starts):
                    yield batch_of(_CHUNK, [[i], [digest], [k], [at], [k + 1 == len(starts)], [text[at:at + size]]])

    return run


def _edges(pattern: str, overlap: int):
    """Boundaries, as places in the document, within the overlaps at the head and the tail of a chunk."""
    schema = pa.schema([*_CHUNK, ("heads", pa.list_(pa.int64())), ("tails", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            heads, tails = [], []
            for start, text in zip(batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True):
                ends = np.array(boundaries(text, pattern), np.int64)
                heads.append((ends[ends <= overlap] + start).tolist())
                tails.append((ends[ends >= len(text) - overlap] + start).tolist())
            yield batch_of(schema, [*batch.columns, heads, tails])

    return run


_PIECE = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("idx", pa.int32()), ("start", pa.int64()), ("ids", pa.binary()), ("chunk", pa.string())])


def _pieces(ranks: str, pattern: str):
    """Ids of the stitched piece of a chunk; a chunk of a document that did not stitch stays text."""
    def run(batches):
        encode = encoding(ranks, pattern).encode_ordinary
        for batch in batches:
            rows = batch.to_pylist()
            ids = [np.array(encode(r["chunk"][r["from"] - r["start"]:None if r["to"] is None else r["to"] - r["start"]]), _IDS).tobytes()
                   if r["whole"] else None for r in rows]
            yield batch_of(_PIECE, [[r["doc_id"] for r in rows], [r["digest"] for r in rows], [r["idx"] for r in rows],
                                    [r["start"] for r in rows], ids, [None if r["whole"] else r["chunk"] for r in rows]])

    return run


_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def _joined(ranks: str, pattern: str):
    """Documents from pieces that come sorted by document and place; a repeated row's pieces come in a row."""
    def run(batches):
        codes = encoding(ranks, pattern)

        def finish(key, copies, ids, texts):
            if texts:
                text = texts[0][1]
                for start, more in texts[1:]:
                    text += more[len(text) - start:]
                ids = [np.array(codes.encode_ordinary(text), _IDS).tobytes()]
            ids = b"".join(ids)
            return batch_of(_OUT, [[key[0]] * copies, [len(ids) // 4] * copies, [ids] * copies])

        key, at, copies, ids, texts = None, -1, 0, [], []
        for batch in batches:
            for r in batch.to_pylist():
                if key != (r["doc_id"], r["digest"]):
                    if key:
                        yield finish(key, copies, ids, texts)
                    key, at, copies, ids, texts = (r["doc_id"], r["digest"]), -1, 0, [], []
                copies += r["idx"] == 0
                if r["idx"] > at:
                    at = r["idx"]
                    if r["ids"] is None:
                        texts.append((r["start"], r["chunk"]))
                    else:
                        ids.append(r["ids"])
        if key:
            yield finish(key, copies, ids, texts)

    return run


def _short(ranks: str, pattern: str):
    def run(batches):
        codes = encoding(ranks, pattern)
        for rows, texts in text_blocks(batches):
            ids = [codes.encode_ordinary(t.decode("utf-8", "replace")) for t in texts]
            yield batch_of(_OUT, [rows.column(0), [len(i) for i in ids], [np.array(i, _IDS).tobytes() for i in ids]])

    return run


def encode(docs: DataFrame, ranks: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids (as little-endian unsigned 32-bit numbers).

    A text of up to ``chunk`` characters is one chunk. Longer ones are cut into chunks that
    overlap; each is pre-tokenised by itself, and neighbours are joined at the first common
    boundary in their overlap. From a common boundary on both read alike, so the pieces
    between such boundaries, encoded by themselves, give the ids of the whole text. Where an
    overlap has no common boundary (a run of letters or blanks longer than it) the document
    is put together and encoded whole. Null and empty texts have no ids. Null doc_ids and
    repeated rows are kept as they are; an empty table gives no rows, and columns other than
    doc_id and text are not read.
    """
    if not 0 < 2 * overlap < chunk:
        raise ValueError("chunks must be more than twice as long as their overlap")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    long_ = F.coalesce(F.length("text") > chunk, F.lit(False))
    out = "doc_id long, n_tokens long, ids binary"
    short = docs.where(~long_).mapInArrow(_short(ranks, pattern), out)
    chunks = docs.where(long_).mapInArrow(
        _chunks(chunk, overlap), "doc_id long, digest binary, idx int, start long, last boolean, chunk string")
    # a long document's chunks go to many tasks
    edged = chunks.repartition("doc_id", "digest", "idx").mapInArrow(_edges(pattern, overlap), (
        "doc_id long, digest binary, idx int, start long, last boolean, chunk string, heads array<long>, tails array<long>"))
    seams = edged.select("doc_id", "digest", "idx", "last", "heads", "tails").distinct()
    w = Window.partitionBy("doc_id", "digest").orderBy("idx")
    seams = seams.withColumn("cut", F.array_min(F.array_intersect("heads", F.lag("tails").over(w)))).select(
        "doc_id", "digest", "idx", F.when(F.col("idx") == 0, F.lit(0).cast("long")).otherwise(F.col("cut")).alias("from"),
        F.lead("cut").over(w).alias("to"),
        F.min((F.col("idx") == 0) | F.col("cut").isNotNull()).over(Window.partitionBy("doc_id", "digest")).alias("whole"))
    both = edged.alias("e").join(seams.alias("s"), (
        F.col("e.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("e.digest") == F.col("s.digest")) & (F.col("e.idx") == F.col("s.idx"))))
    pieces = both.select("e.doc_id", "e.digest", "e.idx", "e.start", "e.chunk", "s.from", "s.to", "s.whole").mapInArrow(
        _pieces(ranks, pattern), "doc_id long, digest binary, idx int, start long, ids binary, chunk string")
    joined = pieces.repartition("doc_id", "digest").sortWithinPartitions("doc_id", "digest", "idx").mapInArrow(
        _joined(ranks, pattern), out)
    return short.unionByName(joined)


def decode(tokens: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """The rows doc_id, n_tokens, ids with ``decoded``: the tokens' bytes one after another."""
    schema = pa.schema([*_OUT, ("decoded", pa.binary())])

    def run(batches):
        codes = encoding(ranks, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                rows = batch.slice(i, 256)
                texts = [codes.decode_bytes(np.frombuffer(b or b"", _IDS).tolist()) for b in rows.column(2).to_pylist()]
                yield batch_of(schema, [*rows.columns, texts])

    return tokens.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")
