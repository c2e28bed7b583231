"""Spelling variants: an index of variable-length grams from a frequency-pruned dictionary, with per-word bounds.

Words are framed by a start and an end mark. A word is cut into the longest dictionary
gram at every position (two code points where none fits), less the grams that lie within
an earlier one. One edit leaves all grams whole but for the affected ones, whose largest
number over all edits is the word's bound: two near words have all but that many grams in
common, each at the same distance from the start or from the end. So near words share one
of the rarest ``bound + 1`` grams of each; the longer lists are never merged.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from showbill.llm.common import batch_of, raw_texts, stored

#: Code points and occurrences of a word at least; one in LOST_ONE_IN runs loses a code point.
LEAST_LENGTH, LEAST_COUNT, LOST_ONE_IN = 5, 3, 97
#: Code points of a gram, and grams of one length in the dictionary at most: only grams that fill more
#: than 1 / MOST_GRAMS of all positions enter it, so that its size is bounded whatever the vocabulary.
SHORTEST, LONGEST, MOST_GRAMS = 2, 8, 20_000
#: A form is at least this many times as frequent as the word.
TIMES = 2
#: Words that a counting task holds before it hands them on, and bytes of a text that it reads at a time.
HELD, PIECE_BYTES = 200_000, 1 << 20
#: Words that a task cuts into grams.
TASK_WORDS = 10_000

_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
_NO_RUN = re.compile(rb"[^a-z\x80-\xff]")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_START, _END = "\x02", "\x03"
_COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])
_LISTS = pa.schema([("list", pa.string()), ("longer", pa.bool_()), ("from_end", pa.bool_()), ("word", pa.string()), ("letters", pa.int64())])


def runs(text: bytes) -> Counter:
    """Occurrences of every lower-cased run of letters of a text, which is read in pieces that end between two runs."""
    out, start = Counter(), 0
    while start < len(text):
        gap = _NO_RUN.search(text, start + PIECE_BYTES) if start + PIECE_BYTES < len(text) else None
        end = gap.start() if gap else len(text)
        out.update(_RUN.findall(text[start:end].translate(_LOWER)))
        start = end
    return out


def misspelt(run: bytes, prefix: int) -> bytes:
    """The run, less a code point where the check sum of ``<doc_id>:<run>`` says so; ``prefix`` is that of ``<doc_id>:``."""
    h = zlib.crc32(run, prefix)
    if h % LOST_ONE_IN:
        return run
    text = run.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1:]).encode()


def _counted(batches):
    held: Counter = Counter()
    for batch in batches:
        for first in range(0, batch.num_rows, 64):
            rows = batch.slice(first, 64)
            for doc_id, text in zip(rows.column(0).to_pylist(), raw_texts(rows.column(1)), strict=True):
                prefix = zlib.crc32(b"%s:" % str("" if doc_id is None else doc_id).encode())
                for run, n in runs(text).items():
                    held[misspelt(run, prefix)] += n
                if len(held) > HELD:
                    yield _handed_on(held)
                    held = Counter()
    yield _handed_on(held)


def _handed_on(held: Counter) -> pa.RecordBatch:
    kept = [(w.decode(), n) for w, n in held.items()]
    return batch_of(_COUNTS, [[w for w, _ in kept], [n for _, n in kept]])


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of every word that is long and frequent enough."""
    counts = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_counted, "word string, n long")
    counts = counts.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.sum("n").alias("n"))
    return stored(counts.where(F.col("n") >= LEAST_COUNT), "spelling-words")


def framed(word: str) -> str:
    return f"{_START}{word}{_END}"


class GramDictionary:
    """Frequent grams with their counts, and the part of a gram that a cut may complete: its prefixes and suffixes."""

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        self.prefixes: dict[str, int] = {}
        self.suffixes: dict[str, int] = {}
        for gram in counts:
            for i in range(1, len(gram)):
                for parts, part in ((self.prefixes, gram[:i]), (self.suffixes, gram[i:])):
                    parts[part] = min(len(gram), parts.get(part, len(gram)))

    def cut(self, text: str, longest: int) -> list[tuple[int, int]]:
        """(start, end) of the variable-length grams of a framed word, in order."""
        out, reach = [], 0
        for p in range(len(text) - SHORTEST + 1):
            for end in range(min(len(text), p + longest), p + SHORTEST, -1):
                if text[p:end] in self.counts:
                    break
            else:
                end = p + SHORTEST
            if end > reach:
                out.append((p, end))
                reach = end
        return out

    def affected(self, text: str, grams: list[tuple[int, int]], longest: int) -> int:
        """Largest number of the grams that one edit between the marks may change.

        A gram left of the edit stays unless it or one before it may grow across the edit,
        which needs a dictionary gram that begins with all that lies from there to the edit;
        one to the right stays unless a new gram may swallow it, which needs a dictionary
        gram that ends with all from the edit to the end of the gram, or beyond.
        """
        size, left, right = len(text), [0], [0]
        for i in range(1, size):
            grows = i
            for p in range(max(0, i - longest + 1), i):
                if self.prefixes.get(text[p:i], longest + 1) <= longest:
                    grows = p
                    break
            left.append(sum(p < grows and e <= i for p, e in grams))
            swallowed = i
            for e in range(min(size, i + longest - 1), i, -1):
                if self.suffixes.get(text[i:e], longest + 1) <= longest:
                    swallowed = e
                    break
            right.append(sum(p >= i and e > swallowed for p, e in grams))
        replaced = max(len(grams) - left[i] - right[i + 1] for i in range(1, size - 1))
        inserted = max(len(grams) - left[i] - right[i] for i in range(1, size))
        return max(replaced, inserted)

    def lists(self, word: str, longest: int) -> list[tuple[str, int, int]]:
        """(gram, distance from the start, distance from the end) of the rarest ``bound + 1`` grams."""
        text = framed(word)
        grams = self.cut(text, longest)
        bound = self.affected(text, grams, longest)
        ordered = sorted((self.counts.get(text[p:e], 0), text[p:e], p, len(text) - e) for p, e in grams)
        return [entry[1:] for entry in ordered[:bound + 1]]


def longest_gram(length: int) -> int:
    """Grams no longer than the part of a framed word of this length that any edit leaves whole on one side.

    So at least one gram stays whole, and no word is without a list.
    """
    return max(SHORTEST + 1, min(LONGEST, length // 2 + 1))


def _gram_counts(shorter: set | None, length: int, batches):
    held: Counter = Counter()
    for batch in batches:
        for word in batch.column(0).to_pylist():
            text = framed(word)
            for p in range(len(text) - length + 1):
                gram = text[p:p + length]
                if shorter is None or (gram[1:] in shorter and gram[:-1] in shorter):
                    held[gram] += 1
        if len(held) > HELD:
            yield batch_of(_COUNTS, [list(held), list(held.values())])
            held = Counter()
    yield batch_of(_COUNTS, [list(held), list(held.values())])


def gram_dictionary(words: DataFrame, most: int = MOST_GRAMS) -> GramDictionary:
    """Grams of the words that are frequent enough, length by length, each from the frequent ones one shorter.

    At most ``most`` grams of a length fill more than 1 / ``most`` of all positions, so at
    most ``most`` times seven come to the driver and go to the tasks.
    """
    positions = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    counts: dict[str, int] = {}
    shorter = None
    for length in range(SHORTEST, LONGEST + 1):
        found = words.select("word").mapInArrow(partial(_gram_counts, shorter, length), "word string, n long").groupBy("word").agg(
            F.sum("n").alias("n")).where(F.col("n") > positions // most).collect()
        if not found:
            break
        counts |= {row["word"]: row["n"] for row in found}
        shorter = {row["word"] for row in found}
    return GramDictionary(counts)


def letters(word: str) -> int:
    """One bit for every letter that occurs, by code point; one edit changes two bits at most."""
    mask = 0
    for letter in word:
        mask |= 1 << (ord(letter) & 31)
    return mask


def _listed(dictionary, batches):
    grams = dictionary.value
    for batch in batches:
        rows = []
        for word in batch.column(0).to_pylist():
            size, mask = len(word), letters(word)
            for gram, start, end in grams.lists(word, longest_gram(size)):
                rows.append((f"{size} {start} {gram}", False, False, word, mask))
                rows.append((f"{size} -{end} {gram}", False, True, word, mask))
            if size > LEAST_LENGTH:
                for gram, start, end in grams.lists(word, longest_gram(size - 1)):
                    rows.append((f"{size - 1} {start} {gram}", True, False, word, mask))
                    rows.append((f"{size - 1} -{end} {gram}", True, True, word, mask))
        yield batch_of(_LISTS, list(zip(*rows, strict=True)) if rows else [[]] * 5)


def near_words(words: DataFrame, dictionary: GramDictionary) -> DataFrame:
    """(a, b) of every two words that differ by one inserted, deleted or replaced code point, once, in no order.

    A list holds the words of one length, and of one more, with a gram at the same place from
    the start or the end. Words of equal length meet by the start alone; all pairs that meet
    are verified in the join, first by the letters they have, and AQE splits long lists.
    """
    sent = words.sparkSession.sparkContext.broadcast(dictionary)
    lists = stored(words.select("word").mapInArrow(partial(_listed, sent), "list string, longer boolean, from_end boolean, word string, letters long"), "spelling-lists")
    a, b = lists.where("not longer").alias("a"), lists.alias("b")
    meet = (F.col("a.list") == F.col("b.list")) & (F.col("b.longer") | (~F.col("b.from_end") & (F.col("a.word") < F.col("b.word"))))
    alike = F.bit_count(F.col("a.letters").bitwiseXOR(F.col("b.letters"))) <= 2
    near = a.join(b, meet & alike & (F.levenshtein("a.word", "b.word", 1) == 1))
    return near.select(F.col("a.word").alias("a"), F.col("b.word").alias("b")).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word with a form, by doubling the steps; a form is twice as frequent, so steps are few."""
    steps = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = steps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        longer = stored(longer, "spelling-roots")
        steps = longer.select("word", "root")
        if not longer.where("moved").take(1):
            return steps


def variants(docs: DataFrame, most_grams: int = MOST_GRAMS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the documents.

    A null text has no words; a null doc_id is the empty string in the check sum. Rows that
    repeat count as often as they stand there, ties go to the smallest form in code-point
    order, an empty table gives no rows, and other columns are not read. A long text is
    counted in pieces.
    """
    words = vocabulary(docs)
    words = words.repartition(1 + words.count() // TASK_WORDS, "word")
    near = stored(near_words(words, gram_dictionary(words, most_grams)), "spelling-near")
    both = near.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select(
        F.col("p.a").alias("word"), F.col("p.b").alias("other"))
    counts = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = both.join(counts, "other").groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("least"), "other")).alias("best"))
    known = words.join(best, "word", "left").withColumn("best_n", -F.col("best.least"))
    formed = F.col("best_n") >= TIMES * F.col("n")
    known = stored(known.select("word", F.when(formed, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                F.when(formed, F.col("best_n")).alias("form_n")), "spelling-forms")
    roots = _roots(known.where("form is not null"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
