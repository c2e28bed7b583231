"""Spelling variants, Jaccard join and divergence audit next to brute force on small and odd tables."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from showbill.llm import divergence, jaccard_join, spelling

SCHEMA = "doc_id long, text string, lang string, source string, word string, n long, sig string, rank int"
LOWER = {c: c + 32 for c in range(65, 91)}


def syllables(rng, n):
    return " ".join("".join(rng.choice(["th", "he", "in", "er", "an", "ou", "é"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    base, passage = syllables(rng, 150), syllables(rng, 70)
    words = base.split()
    out = [(1, base, "en", "a"), (2, base, "en", "b"), (2, base, "en", "b"), (3, None, None, None), (4, "", "en", "a"), (5, " \n\t ", "fr", "c"),
           (6, "a b", "en", "a"), (7, "A  b", "en", "b"), (8, "x" * 350, "en", "a"), (None, base + " tail", "en", "c"), (9, "Über ÜBER über ×÷ étude", "de", ""),
           (10, "a b c d", "en", None), (11, "a b c d e", "en", "a"), (12, "same text once", None, "z")]
    for i in range(13, 70):
        copy = list(words)
        for _ in range(rng.randint(0, 9)):
            copy[rng.randrange(len(copy))] = syllables(rng, 1)
        if i % 7 == 0:
            copy = copy[: rng.randint(3, 150)]
        out.append((i, " ".join(copy), rng.choice(["en", "fr"]), f"s{i % 6}"))
    out += [(i, syllables(rng, rng.randint(1, 120)) + "\n" + passage, "en", f"s{i % 9}") for i in range(70, 90)]
    out.append((90, syllables(rng, 20_000), "en", "long"))
    return [(*r, "w", 1, "s", 1) for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- spelling -------------------------------------------------------------------------------

def edits(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(rows):
    n = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    near = {w: [x for x in n if edits(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


@pytest.mark.parametrize("most", [20_000, 40])
def test_spelling_equals_all_pairs(docs, rows, most, monkeypatch):
    monkeypatch.setattr(spelling, "TASK_WORDS", 100)
    got = spelling.variants(docs, most)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = [tuple(r) for r in got.collect()]
    want = brute_variants(rows)
    assert len(got) == len(want) and set(got) == want
    assert sum(f is not None for _, f, *_ in want) > 100


def test_near_words_share_a_list():
    rng = random.Random(3)
    words = ["".join(rng.choice("abc" if i % 2 else "abcdefghijé") for _ in range(rng.randint(5, 18))) for i in range(400)]
    counts = Counter(w[i:i + k] for w in map(spelling.framed, words) for k in range(2, 9) for i in range(len(w) - k + 1))
    for least in (2, 5, 30, 10**6):
        grams = spelling.GramDictionary({g: c for g, c in counts.items() if c >= least})
        for word in words:
            i = rng.randrange(len(word) + 1)
            other = rng.choice([word[:i] + rng.choice("abcé") + word[i:], word[:i] + rng.choice("abcé") + word[i + 1:], word[:i] + word[i + 1:]])
            if len(other) < 5 or not edits(word, other):
                continue
            size = min(len(word), len(other))
            a, b = (grams.lists(w, spelling.longest_gram(size)) for w in (word, other))
            assert {x[:2] for x in a} & {x[:2] for x in b} or {x[::2] for x in a} & {x[::2] for x in b}, (word, other, least)


def test_long_texts_are_counted_in_pieces(monkeypatch):
    rng = random.Random(1)
    text = syllables(rng, 500).encode() + b"\xc3\xa9" * 300
    monkeypatch.setattr(spelling, "PIECE_BYTES", 64)
    monkeypatch.setattr(divergence, "PIECE_BYTES", 64)
    monkeypatch.setattr(jaccard_join, "PIECE_BYTES", 64)
    assert spelling.runs(text) == Counter(x.encode() for x in re.findall("[a-zÀ-ÿ]+", text.decode()))
    assert divergence.term_counts(text) == Counter(x.encode() for x in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text.decode()))
    for words in (text, b"  " + text + b"\n" * 200, b"a " * 70, b"x" * 500, b"x" * 200 + b" b " + b"y" * 200, b"a b c " + b" " * 300):
        assert np.array_equal(jaccard_join._long_set(words), jaccard_join.shingle_sets([words])[0]), words[:20]


# --- Jaccard join -----------------------------------------------------------------------------

def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def brute_components(rows, similarity):
    ids = defaultdict(set)
    for doc_id, text, *_ in rows:
        ids[-2**63 if doc_id is None else doc_id].add(frozenset(shingles(text)))
    component = {i: i for i in ids}

    def root(x):
        while component[x] != x:
            x = component[x]
        return x

    for (a, sets), (b, others) in itertools.combinations(ids.items(), 2):
        if any(100 * len(x & y) >= similarity * len(x | y) for x in sets for y in others if x and y):
            x, y = root(a), root(b)
            component[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("similarity,members", [(80, 4096), (80, 2), (60, 4096)])
def test_jaccard_join_equals_all_pairs(docs, rows, similarity, members, monkeypatch):
    monkeypatch.setattr(jaccard_join, "MEMBERS", members)
    monkeypatch.setattr(jaccard_join, "STRAYS", max(1, members // 2))
    want = brute_components(rows, similarity)
    got = jaccard_join.jaccard_join(docs, similarity)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    got = got.collect()
    back = {-2**63: None}
    assert Counter(tuple(r) for r in got) == Counter(
        (i, len(shingles(t)), back.get(want[-2**63 if i is None else i], want[-2**63 if i is None else i])) for i, t, *_ in rows)
    assert len({r["component_id"] for r in got}) < len(rows) - 10


@pytest.mark.parametrize("similarity", [80, 60, 90])
def test_similar_sets_share_a_signature(similarity):
    rng = np.random.default_rng(similarity)
    number = lambda n: rng.integers(0, 2**64, n, dtype=np.uint64)
    common = np.sort(number(60))
    met = 0
    for _ in range(400):
        a = np.unique(np.concatenate((number(int(rng.integers(1, 300))), common[: int(rng.integers(0, 60))])))
        b = np.unique(np.concatenate((rng.permutation(a)[int(len(a) * rng.random() * 0.3):], number(int(len(a) * rng.random() * 0.3)))))
        both = len(np.intersect1d(a, b))
        if 100 * both >= similarity * (len(a) + len(b) - both) and not np.array_equal(a, b):
            sig, owner = jaccard_join.signatures(np.concatenate((a, b)), np.array([len(a), len(b)]), common, similarity)
            assert set(sig[owner == 0]) & set(sig[owner == 1])
            met += 1
    assert met > 20


# --- divergence -------------------------------------------------------------------------------

def brute_audit(rows, least_docs, top):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in rows:
        terms = Counter(x.translate(LOWER) for x in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or ""))
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        counts[lang, source].update(terms)
        docs[lang].update(terms.keys())
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least_docs]

        def shares(count):
            total = sum(count[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (count[t] + 5) // total for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(q[t] - p[s][t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, ranked in (("pair", sorted(pairs)), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])):
                out += [(lang, s, part, item, -value, rank) for rank, (value, item) in enumerate(ranked, 1)]
    return out


@pytest.mark.parametrize("least_docs,tree_terms,chunk", [(2, 16, 2), (2, 2048, 32), (1, 100, 3), (500, 16, 2)])
def test_audit_equals_plain_sums(docs, rows, least_docs, tree_terms, chunk):
    got = divergence.audit(docs, least_docs, 7, tree_terms, chunk)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == sorted(brute_audit(rows, least_docs, 7))


def test_equal_subtrees_are_one_node():
    counts = np.array([[3, 0, 3, 0, 0, 0, 0, 0], [3, 0, 3, 0, 3, 0, 0, 0]], np.int64)
    roots, levels = divergence.tree_levels(counts)
    assert roots[0] != roots[1] and [len(left) for left, _ in levels] == [2, 3, 2]
    totals, first = np.array([100, 7]), np.array([0])
    value = divergence.priced(counts, totals, first, first + 1)
    p = [[1 + 10**9 * (int(c) + 5) // int(t) for c in row] for row, t in zip(counts, totals, strict=True)]
    assert value[0] == sum(abs(a - b) for a, b in zip(*p, strict=True))


def test_empty_tables(empty):
    assert spelling.variants(empty).collect() == []
    assert jaccard_join.jaccard_join(empty).collect() == []
    assert divergence.audit(empty).collect() == []
