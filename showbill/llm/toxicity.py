"""Toxicity by a linear-chain conditional random field over words.

Words get labels from the documents' labels: a word is toxic where it, or a stem of it, stands
almost only in toxic documents. The field learns the labels of whole word sequences; its
forward-backward marginals give toxic spans, and a logistic function of them the score.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from showbill.llm.common import batch_of, id_or_least, stored, text_blocks
from showbill.llm.words import mixed, powers, _BACK, _BASE, _BYTE

#: Labelled documents that are fitted at most, by label.
MOST_TOXIC, MOST_CLEAN = 1500, 4500
#: Lengths in bytes of the stems that are features beside the word itself.
STEMS = (4, 5, 6)
#: Feature weights are held in a table of this size, whatever the vocabulary.
TABLE_BITS = 18
#: Words of a sequence; longer stretches without a line end are cut.
SEQUENCE = 48
#: Evidence in bits, beyond the number of features tried, that a feature stands in toxic
#: documents, and their least share.
EVIDENCE, PURITY = 2.0, 0.9
#: Rounds of the fit of the field, and the share of the sample that is left for the score.
EPOCHS, CALIBRATION = 40, 0.3
THRESHOLD = 0.7

_U = np.uint64
_EDGE = np.zeros(256, bool)
_EDGE[[b for b in range(33, 128) if not chr(b).isalnum()]] = True
_TABLE = bytes(10 if b in (10, 11, 12, 13) else 32 if b in (9, 32) else b for b in range(256))


class Words:
    """Features and sequences of the words of lower-cased texts."""

    @classmethod
    def of_many(cls, texts: list[bytes], size: int = 256) -> Words:
        """The words of any number of texts, read a few at a time; their places are left out."""
        parts = [cls(texts[i:i + size]) for i in range(0, len(texts), size)] or [cls([])]
        out = cls.__new__(cls)
        before = np.cumsum([0, *(len(p.of) for p in parts)])
        out.of = np.concatenate([p.of + i * size for i, p in enumerate(parts)])
        out.features = np.concatenate([p.features for p in parts])
        out.begins = np.concatenate([p.begins + n for p, n in zip(parts, before[:-1], strict=True)])
        out.lengths = np.concatenate([p.lengths for p in parts])
        return out

    def __init__(self, texts: list[bytes]):
        joined = b"\n".join(texts).translate(_TABLE)
        data = np.frombuffer(joined, np.uint8)
        gap = (data == 32) | (data == 10)
        edges = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
        starts, ends = edges[0::2], edges[1::2]
        # signs around a word are no part of it
        plain = np.concatenate((~(_EDGE[data] | gap), [False]))
        after = np.minimum.accumulate(np.where(plain, np.arange(len(data) + 1), len(data))[::-1])[::-1]
        before = np.maximum.accumulate(np.where(plain, np.arange(len(data) + 1), -1))
        a = np.minimum(after[starts], ends) if len(starts) else starts
        b = np.maximum(before[ends - 1] + 1, a) if len(starts) else ends
        full = b > a
        starts, ends = a[full], b[full]
        first = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        self.of = np.searchsorted(first, starts, "right") - 1
        self.starts, self.ends = starts - first[self.of], ends - first[self.of]
        total = np.zeros(len(data) + 1, _U)
        np.cumsum(_BYTE[data] * powers(_BASE, len(data)), out=total[1:])
        back = powers(_BACK, len(data) + 1)
        columns = [(total[ends] - total[starts]) * back[starts] + _U(1)]
        for k in STEMS:
            cut = np.minimum(ends, starts + k)
            columns.append((total[cut] - total[starts]) * back[starts] + _U(k))
        self.features = np.stack([mixed(c) for c in columns], axis=1) if len(starts) else np.zeros((0, 1 + len(STEMS)), _U)
        lines = np.searchsorted(np.flatnonzero(data == 10), starts)
        new = np.concatenate(([True] * bool(len(starts)), lines[1:] != lines[:-1]))
        begun = np.flatnonzero(new)
        place = np.arange(len(starts)) - (np.repeat(begun, np.diff(np.concatenate((begun, [len(starts)])))) if len(begun) else 0)
        new |= place % SEQUENCE == 0
        self.begins = np.flatnonzero(new)
        self.lengths = np.diff(np.concatenate((self.begins, [len(starts)])))

    def bins(self) -> np.ndarray:
        return (self.features >> _U(64 - TABLE_BITS)).astype(np.int32)


class Field:
    """A chain of two states (0 clean, 1 toxic), by log potentials."""

    def __init__(self, weights=None, bias=-3.0, transitions=None):
        self.weights = np.zeros(1 << TABLE_BITS) if weights is None else weights
        self.bias = bias
        self.transitions = np.array([[0.5, 0.0], [0.0, 0.5]]) if transitions is None else transitions

    def emissions(self, words: Words) -> np.ndarray:
        """Log odds of toxic at each word by its features."""
        return self._emissions(words.bins())

    def _emissions(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.bias, float)
        for column in bins.T:
            out += self.weights[column]
        return out

    def chains(self, words: Words, emissions: np.ndarray):
        """Log odds of the forward and of the backward messages at each word."""
        t = self.transitions
        order = np.argsort(-words.lengths, kind="stable")
        begins, lengths = words.begins[order], words.lengths[order]
        forward, backward = np.empty_like(emissions), np.zeros_like(emissions)
        longest = int(lengths[0]) if len(lengths) else 0
        alive = [int(np.searchsorted(-lengths, -i, "left")) for i in range(longest + 1)]  # chains longer than i
        if longest:
            forward[begins] = emissions[begins]
        for i in range(1, longest):
            at = begins[:alive[i]] + i
            x = forward[at - 1]
            forward[at] = emissions[at] + np.logaddexp(t[0, 1], t[1, 1] + x) - np.logaddexp(t[0, 0], t[1, 0] + x)
        for i in range(longest - 2, -1, -1):
            at = begins[:alive[i + 1]] + i
            x = emissions[at + 1] + backward[at + 1]
            backward[at] = np.logaddexp(t[1, 0], t[1, 1] + x) - np.logaddexp(t[0, 0], t[0, 1] + x)
        return forward, backward

    def marginals(self, words: Words) -> np.ndarray:
        """Log odds that each word is toxic, given its whole sequence."""
        forward, backward = self.chains(words, self.emissions(words))
        return forward + backward

    def fit(self, words: Words, labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.5, decay: float = 1e-5):
        """Gradient ascent on the sequences' likelihood, with a step size per weight."""
        bins, n = words.bins(), len(labels)
        inner = np.ones(n, bool)
        inner[words.begins] = False
        at = np.flatnonzero(inner)
        seen = np.bincount(labels[at - 1] * 2 + labels[at], minlength=4).reshape(2, 2)
        squares, bias_square, transition_squares = np.full(len(self.weights), 1e-8), 1e-8, np.full((2, 2), 1e-8)
        for _ in range(epochs):
            emissions = self._emissions(bins)
            forward, backward = self.chains(words, emissions)
            wrong = labels - 1 / (1 + np.exp(-np.clip(forward + backward, -40, 40)))
            gradient = -decay * self.weights
            for column in bins.T:
                gradient += np.bincount(column, weights=wrong, minlength=len(self.weights)) * (1e3 / n)
            x, a, t = emissions[at] + backward[at], forward[at - 1], self.transitions
            cells = np.stack((np.full(len(at), t[0, 0]), t[0, 1] + x, t[1, 0] + a, t[1, 1] + a + x))
            cells = np.exp(cells - cells.max(axis=0))
            expected = (cells / cells.sum(axis=0)).sum(axis=1).reshape(2, 2)
            squares += gradient**2
            self.weights += rate * gradient / np.sqrt(squares)
            g = wrong.sum() / n * 1e3
            bias_square += g * g
            self.bias += 0.2 * rate * g / np.sqrt(bias_square)
            g = (seen - expected) / n * 1e3
            transition_squares += g * g
            self.transitions = self.transitions + 0.2 * rate * g / np.sqrt(transition_squares)
        return self


def toxic_features(words: Words, toxic: np.ndarray) -> np.ndarray:
    """Features that stand in toxic documents far more often than the mix of documents explains."""
    share = toxic.mean() if len(toxic) else 0.5
    if not len(words.of) or share in (0.0, 1.0):
        return np.zeros(0, _U)
    # each feature once a document; the documents' words stand one after another
    seen = []
    bounds = np.searchsorted(words.of, np.arange(len(toxic) + 1))
    for label in (1, 0):
        own = [np.unique(words.features[bounds[i]:bounds[i + 1]]) for i in np.flatnonzero(toxic == label)]
        seen.append(np.concatenate(own) if own else np.zeros(0, _U))
    names, inverse = np.unique(np.concatenate(seen), return_inverse=True)
    hit = np.bincount(inverse[:len(seen[0])], minlength=len(names))
    miss = np.bincount(inverse[len(seen[0]):], minlength=len(names))
    # copies of a document are one witness: a feature counts once after the same word
    before = np.concatenate((np.zeros(1, _U), words.features[:-1, 0]))
    own = toxic[words.of] == 1
    features = words.features[own].ravel()
    _, lead = np.unique(mixed(features + mixed(np.repeat(before[own], words.features.shape[1]))), return_index=True)
    hit = np.minimum(hit, np.bincount(np.searchsorted(names, features[lead]), minlength=len(names)))
    pure = hit / (hit + miss)
    with np.errstate(divide="ignore", invalid="ignore"):
        bits = hit * np.log2(pure / share) + np.where(miss > 0, miss * np.log2((1 - pure) / (1 - share)), 0)
    return names[(bits >= np.log2(len(names)) + EVIDENCE) & (pure >= PURITY)]


def document_inputs(logits: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Per document: the greatest and the second greatest log odds of a word, and the log of the likely toxic words."""
    out = np.full((n, 3), -12.0)
    out[:, 2] = 0
    order = np.lexsort((-logits, of))
    bounds = np.searchsorted(of[order], np.arange(n + 1))
    some, two = np.flatnonzero(bounds[1:] > bounds[:-1]), np.flatnonzero(bounds[1:] > bounds[:-1] + 1)
    out[some, 0] = logits[order[bounds[some]]]
    out[two, 1] = logits[order[bounds[two] + 1]]
    out[:, 2] = np.log1p(np.bincount(of, weights=logits > 0, minlength=n))
    return np.clip(out, -12, 12)


def _logistic(inputs: np.ndarray, labels: np.ndarray, steps: int = 300) -> np.ndarray:
    x = np.concatenate((inputs / 10, np.ones((len(inputs), 1))), axis=1)
    w, weight = np.zeros(x.shape[1]), np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum()))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (weight * (labels - p)) - 1e-4 * w)
        w = w + np.clip(step, -2, 2)
        if abs(step).max() < 1e-6:
            break
    return w


class Model:
    def __init__(self, field: Field, logistic: np.ndarray):
        self.field, self.logistic = field, logistic

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, weights=self.field.weights, bias=self.field.bias, transitions=self.field.transitions, logistic=self.logistic)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Model:
        held = np.load(io.BytesIO(raw))
        return cls(Field(held["weights"], float(held["bias"]), held["transitions"]), held["logistic"])

    def scored(self, texts: list[bytes]):
        """(score per text, toxic words as (text index, start, end))."""
        words = Words(texts)
        logits = self.field.marginals(words)
        inputs = document_inputs(logits, words.of, len(texts))
        z = np.concatenate((inputs / 10, np.ones((len(texts), 1))), axis=1) @ self.logistic
        hit = np.flatnonzero(logits > 0)
        return 1 / (1 + np.exp(-z)), zip(words.of[hit].tolist(), words.starts[hit].tolist(), words.ends[hit].tolist(), strict=True)


def fitted(texts: list[bytes], toxic: np.ndarray) -> Model:
    """The field from one part of the labelled texts, the score from the other."""
    turn = np.arange(len(texts)) % 10 >= 10 * CALIBRATION
    own = [t for t, k in zip(texts, turn, strict=True) if k]
    words, labels = Words.of_many(own), toxic[turn]
    names = toxic_features(words, labels)
    marked = np.isin(words.features, names).any(axis=1) & (labels[words.of] == 1) if len(names) else np.zeros(len(words.of), bool)
    field = Field()
    if marked.any():
        field.fit(words, marked.astype(np.int64))
    del words
    other = Words.of_many([t for t, k in zip(texts, turn, strict=True) if not k])
    rest = toxic[~turn]
    if not len(rest) or rest.min() == rest.max():
        return Model(field, np.array([10.0, 0, 0, -2.0]))
    return Model(field, _logistic(document_inputs(field.marginals(other), other.of, len(rest)), rest))


def train(docs: DataFrame, labels: DataFrame, held_out) -> Model:
    """A model from at most MOST_TOXIC + MOST_CLEAN labelled documents that ``held_out(doc_id)`` leaves.

    The bounded sample is the documents of least hash; one task fits it. A doc_id with
    several labels counts as toxic if one of them is.
    """
    marks = labels.select(id_or_least().alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(
        F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.withColumn("turn", F.xxhash64("doc_id"))
    own = stored(marks.where("toxic = 1").orderBy("turn").limit(MOST_TOXIC).unionByName(
        marks.where("toxic = 0").orderBy("turn").limit(MOST_CLEAN)), "toxicity-sample")
    texts = docs.select(id_or_least().alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text")).join(own, "doc_id")

    def fit(batches):
        rows, found = [], []
        for batch in batches:
            for block, raw in text_blocks([batch]):
                rows += raw
                found += block.column(1).to_pylist()
        model = fitted(rows, np.array(found, np.int64))
        yield batch_of(pa.schema([("model", pa.binary())]), [[model.to_bytes()]])

    made = texts.repartition(1).sortWithinPartitions("turn", "doc_id").select("text", "toxic").mapInArrow(fit, "model binary").collect()
    return Model.from_bytes(bytes(made[0].model)) if made else Model(Field(), np.array([10.0, 0, 0, -2.0]))


_SCORED = pa.schema([
    ("doc_id", pa.int64()), ("score", pa.float64()),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per input row: doc_id, score, spans (toxic words as byte offsets in the lower-cased text).

    The score depends on the text alone. Null and empty texts, and texts without words, get
    the score of a document without toxic words. A null doc_id stays null, repeated rows get
    equal rows, and an empty table gives none; other columns are not read. Rows are scored
    where they are: the model has a fixed size and is sent to all tasks.
    """
    held = docs.sparkSession.sparkContext.broadcast(model.to_bytes())

    def run(batches):
        own = Model.from_bytes(held.value)
        for rows, texts in text_blocks(batches):
            scores, hits = own.scored(texts)
            spans: list[list] = [[] for _ in texts]
            for i, a, b in hits:
                spans[i].append({"start": a, "end": b})
            yield batch_of(_SCORED, [rows.column(0), scores, spans])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text")).mapInArrow(
        run, "doc_id long, score double, spans array<struct<start: long, end: long>>")
