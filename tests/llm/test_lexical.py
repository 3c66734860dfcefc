import math
import re
from collections import Counter

import numpy as np
import pytest

from grovespark.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string, score string, item_id string", "item_id long, text string, doc_id string"


def words(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    tfs = [(d[0], Counter(words(d[1]))) for d in docs]
    tfs = [(i, c) for i, c in tfs if c]
    n_docs, length = len(tfs), sum(sum(c.values()) for _, c in tfs)
    df = Counter(t for _, c in tfs for t in c)
    out = []
    for item in items:
        scored = []
        for doc_id, c in tfs:
            m = 100 - 75 + 75 * sum(c.values()) * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in words(item[1]) if c[t])
            if s > 0:
                scored.append((-s, doc_id is None, doc_id or 0, doc_id))
        out += [(item[0], r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def corpus(seed, n=120):
    r = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["Été", "ß9", "İx", "naïve"]
    p = 1 / np.arange(1, len(vocabulary) + 1)
    draw = lambda size: list(r.choice(vocabulary, size, p=p / p.sum()))
    rows = [(k, r.choice([" ", "-", "_ ", "\n"]).join(draw(int(r.integers(1, 40)))), "s", "i") for k in range(n)]
    rows += [(1000 + k, rows[3][1], "s", "i") for k in range(30)]  # ties
    rows += [(None, rows[3][1], "s", "i"), (7, rows[7][1], "s", "i"), (7, rows[7][1], "s", "i"), (5, "", None, None), (6, None, None, None), (8, "-- !", None, None)]
    rows += [(2000, " ".join(draw(5000)), "s", "i")]
    items = [(k, " ".join(draw(12)), "d") for k in range(20)] + [(3, "w1 w1 W2", "d"), (None, "w4 été", "d"), (50, None, "d"), (51, "", "d"), (52, "absent", "d"), (53, rows[3][1], "d")]
    return rows, items


@pytest.mark.parametrize("seed,block,terms", [(1, 2_000_000, 200_000), (2, 40, 30), (3, 1, 200_000)])
def test_matches_brute_force(spark, monkeypatch, seed, block, terms):
    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", block)
    docs, items = corpus(seed)
    got = lexical.search(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), block_terms=terms)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)


@pytest.mark.parametrize("seed", range(30))
def test_block_keeps_the_first(seed):
    """The limited accumulators hold every document of the first k, with its whole score."""
    r = np.random.default_rng(seed)
    n, v, k = 300, 25, 5
    counts = r.poisson(r.random(v) * r.choice([0.05, 1.0], v), (n, v))
    doc, term = np.nonzero(counts)
    length = counts.sum(axis=1) + 1
    block = lexical.Block(np.arange(n), length, np.bincount(doc, minlength=n), term.astype(np.int32), counts[doc, term], v, n, int(length.sum()))
    df = (counts > 0).sum(axis=0)
    terms = np.lexsort((np.arange(v), df))
    factor = lexical.weights(df, n)[terms]
    m = 25 + 75 * length * n // length.sum()
    whole = sum(f * (10**9 * counts[:, t] // (1000 * counts[:, t] + 8 * m)) for t, f in zip(terms, factor))
    docs, scores = block.best(terms, factor, k, 0)
    assert (scores == whole[docs]).all()
    top = np.lexsort((np.arange(n), -whole))[:k]
    assert set(top[whole[top] > 0]) <= set(docs)
    known = int(np.sort(whole)[-2])
    docs, scores = block.best(terms, factor, k, known)
    assert set(np.flatnonzero(whole >= max(known, 1))) == set(docs) and not block.sum.any()


def test_creation_stops():
    """A frequent term gives no accumulators once rare terms have settled the first k."""
    n, term = 1000, np.r_[np.zeros(3, int), np.ones(1000, int)]
    doc = np.r_[[0, 1, 2], np.arange(1000)]
    order = np.lexsort((term, doc))
    block = lexical.Block(np.arange(n), np.full(n, 2), np.bincount(doc), term[order].astype(np.int32), np.ones(1003, int), 2, n, 2000)
    docs, scores = block.best(np.array([0, 1]), lexical.weights(np.array([3, 1000]), n) + 1, 3, 0)
    assert sorted(docs) == [0, 1, 2]


def test_long_texts_are_cut_between_terms():
    text = "ab cd-" * 500 + "x" * 70 + " y" * 90
    parts = lexical.cut_apart(text, 50)
    assert "".join(parts) == text and len(parts) > 20
    assert [w for p in parts for w in words(p)] == words(text)
    assert lexical.cut_apart("x" * 300, 50) == ["x" * 300]


def test_empty(spark):
    docs, items = corpus(4, 5)
    none = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert lexical.search(none[0], spark.createDataFrame(items, ITEMS)).count() == 0
    assert lexical.search(spark.createDataFrame(docs, DOCS), none[1]).count() == 0
    assert lexical.search(spark.createDataFrame([(1, None, None, None)], DOCS), spark.createDataFrame(items, ITEMS)).collect() == []
