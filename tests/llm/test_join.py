"""The Jaccard join against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from driftline.llm import ngram_join
from driftline.llm._components import connected_components
from driftline.llm._words import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def shingles(text, k=5):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    root, links = list(range(len(rows))), Counter()
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                ra, rb = root[a], root[b]
                root = [min(ra, rb) if x in (ra, rb) else x for x in root]
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root[i]] = min(least.get(root[i], r[0]), r[0])
    return sorted(((r[0], len(sets[i]), least.get(root[i]), links[i]) for i, r in enumerate(rows)), key=str)


def corpus(seed, n_groups, size, words):
    rng, rows, i = random.Random(seed), [], 0
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    for _ in range(n_groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(1, words))]
        for _ in range(rng.randint(1, size)):
            copy = list(base)
            for _ in range(int(len(copy) * rng.choice([0, 0, 0.01, 0.02, 0.05]))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                copy[0:0] = passage
            rows.append((i, (" " if rng.random() < 0.9 else "\n").join(copy), "en", "s"))
            i += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_random_corpora(spark, seed):
    rows = corpus(seed, 40, 12, 150)
    got = ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_large_group_is_verified_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 8)
    monkeypatch.setattr(ngram_join, "LISTED", 6)
    rows = corpus(9, 3, 60, 120)
    got = ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_edge_cases(docs, no_docs, rows):
    assert sorted(map(tuple, ngram_join.jaccard_join(docs).collect()), key=str) == brute(rows)
    assert ngram_join.jaccard_join(no_docs).count() == 0


def test_shingles_are_the_words_own():
    rng = random.Random(3)
    texts = ["".join(rng.choice("aB é\t\n\x0b1") for _ in range(rng.randint(0, 80))) for _ in range(500)]
    assert [len(s) for s in shingle_sets([t.encode() for t in texts])] == [len(shingles(t)) for t in texts]
    a, b = shingle_sets(["Aa b c d e f".encode(), "x aA B C D E F".encode()])
    assert set(a.tolist()) < set(b.tolist())


def test_common_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, 80)).astype(np.uint64) for _ in range(30)]
    got = ngram_join.common_counts(sets)
    off = ~np.eye(30, dtype=bool)
    assert (got[off] == np.array([[len(np.intersect1d(a, b)) for a in sets] for b in sets])[off]).all()


def test_prefix_bound_holds():
    """Linked sets share a tenth of the smaller one and one more in their prefixes under every order."""
    for n in range(1, 400):
        assert ngram_join.prefix_size(n) - ngram_join.extension(n) == n - -(-80 * n // 100) + 1
    rng = np.random.default_rng(6)
    table = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    orders = ngram_join.Orders(table, np.full(50, 9), 80)
    linked = 0
    for _ in range(3000):
        base = np.unique(np.concatenate([rng.choice(table, rng.integers(0, 30)), rng.integers(0, 1 << 63, rng.integers(1, 120), dtype=np.uint64)]))
        other = np.unique(np.concatenate([base[rng.random(len(base)) > 0.1], rng.integers(0, 1 << 63, rng.integers(0, 12), dtype=np.uint64)]))
        both = len(np.intersect1d(base, other))
        if len(other) and 180 * both >= 80 * (len(base) + len(other)):
            linked += 1
            for order in (0, 1):
                shared = len(np.intersect1d(orders.prefix(base, order)[0], orders.prefix(other, order)[0]))
                assert shared >= ngram_join.extension(min(len(base), len(other))) + 1
    assert linked > 500


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)]
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got.get(k, k) == v for k, v in root.items())


def test_shingle_in_many_blocks(spark, monkeypatch):
    """A frequent passage that makes up most of many texts: its sets fill several blocks and are never listed."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(300)]
    passage = [rng.choice(words) for _ in range(90)]
    rows = [(i, " ".join([*[rng.choice(words) for _ in range(rng.randint(0, 14))], *passage]), "en", "s") for i in range(260)]
    rows += [(1000 + i, " ".join(rng.choice(words) for _ in range(60)), "en", "s") for i in range(40)]
    got = ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_blocks_are_bounded_by_shingles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 500)
    monkeypatch.setattr(ngram_join, "PACK_SHINGLES", 700)
    monkeypatch.setattr(ngram_join, "ORDERED_SETS", 16)
    rows = corpus(4, 5, 40, 200)
    got = ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
