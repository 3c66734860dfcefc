import hashlib
from collections import Counter

import numpy as np
import pytest

from grovespark.llm import fingerprints as fp

SCHEMA = "doc_id long, text string, fingerprint string, part string"


def paragraphs(text):
    """Cut as the module does, text by text."""
    raw, out, at = text.encode(), [], 0
    _, heads, _, h, _ = fp.scan_words([text])
    ends = {int(b) for a, b in zip(h[:-1], heads[1:]) if a % fp.WORDS == 0} | {i + 1 for i in range(len(raw) - 1) if raw[i] == 10 and raw[i + 1] != 10}
    for e in sorted(ends) + [len(raw)]:
        out.append(raw[at:e])
        at = e
    return Counter(p for p in out if p)


def likeness(a, b):
    x, y = paragraphs(a), paragraphs(b)
    either = sum((x | y).values())
    return sum((x & y).values()) / either if either else 1.0


def texts_of(seed, n=60):
    r = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(200)] + ["Été", "ß", "日本語", "😀"]
    draw = lambda size: "".join(str(r.choice(words)) + str(r.choice([" ", " ", " ", "  ", "\n", "\n\n"])) for _ in range(size))
    texts = [draw(int(r.choice([1, 5, 60, 300]))) for _ in range(n)]
    return texts + ["", " ", "\n", "x" * 500, "a " * 400, texts[2], texts[2] + "!", draw(8000)]


def brute(rows):
    order = sorted(((i, t or "") for i, t, *_ in rows), key=lambda r: (r[0] is None, r[0] or 0))
    out = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        new = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), round(likeness(t, new), 9), round(likeness(t, after), 9)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,scan", [(1, 2_000_000), (2, 3000)])
def test_versions_match_brute_force(spark, monkeypatch, seed, scan):
    monkeypatch.setattr(fp, "SCAN", scan)
    rows = [(7 * k % 100, t, "f", "p") for k, t in enumerate(texts_of(seed)) if len(t) < scan]
    rows += [(500, None, "f", "p"), (None, "last of all", "f", "p")]
    got = fp.versions(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got], key=str) == brute(rows)
    texts = dict((r[0], r[1] or "") for r in rows)
    by_print = {}
    for r in got:
        by_print.setdefault(bytes(r.fingerprint), set()).add(texts[r.doc_id])
        assert (bytes(r.fingerprint) == bytes(r.edited_fingerprint)) == (r.n_differing == 0)
    assert all(len(x) == 1 for x in by_print.values())
    again = fp.versions(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert sorted(got, key=str) == sorted(again, key=str)


def test_one_document_and_repeated_ids(spark):
    one = fp.versions(spark.createDataFrame([(4, "a b c d", "f", "p")], SCHEMA)).collect()
    assert [(r.doc_id, r.edited_sha256, r.near_next) for r in one] == [(4, hashlib.sha256(b"a b c a").hexdigest(), 1.0)]
    rows = [(1, "one text", "f", "p"), (1, "another text", "f", "p"), (1, "one text", "f", "p"), (1, None, "f", "p")]
    assert [r.doc_id for r in fp.versions(spark.createDataFrame(rows, SCHEMA)).collect()] == [1] * 4
    assert fp.versions(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_peeling_recovers_the_differing_digests(seed):
    r = np.random.default_rng(seed)
    keys = r.integers(0, 2**63, 4000).astype(np.uint64)
    sets = [set(r.choice(keys, n, replace=False).tolist()) for n in (0, 1, 3, 40, 40, 500, 2000)]
    sets += [sets[5] ^ set(keys[:4].tolist()), sets[6] ^ set(keys[:300].tolist()), sets[5]]
    key = np.array([k for s in sets for k in s], dtype=np.uint64)
    pairs = np.array([(i, j) for i in range(len(sets)) for j in range(len(sets))])
    pair, k, sign = fp.recovered(key, np.array([len(s) for s in sets]), pairs[:, 0], pairs[:, 1])
    for p, (i, j) in enumerate(pairs):
        for s, want in ((1, sets[i] - sets[j]), (-1, sets[j] - sets[i])):
            assert sorted(k[(pair == p) & (sign == s)].tolist()) == sorted(want)


def test_small_sketch_fails_and_is_retried_larger():
    key = fp.mix(np.arange(200, dtype=np.uint64))
    sizes = np.array([100, 100])
    base = fp.Sketches.of(key, sizes, fp.CELLS)
    *_, whole = base.less(np.array([0]), np.array([1])).peel()
    assert not whole[0]
    assert len(fp.recovered(key, sizes, np.array([0]), np.array([1]), base)[0]) == 200


def test_compare_and_fingerprint(spark):
    texts = texts_of(3, 20)
    rows = [(k, a, b, "z") for k, (a, b) in enumerate(zip(texts, texts[1:]))] + [(99, None, "", "z"), (98, texts[0], texts[0], None)]
    df = spark.createDataFrame(rows, "id long, a string, b string, likeness string")
    for r in fp.compare(df, "a", "b", ("id",)).collect():
        a, b = next((x[1] or "", x[2] or "") for x in rows if x[0] == r.id)
        x, y = paragraphs(a), paragraphs(b)
        assert (len(r.only_left), len(r.only_right)) == (sum((x - y).values()), sum((y - x).values()))
        assert abs(r.likeness - likeness(a, b)) < 1e-9
    docs = spark.createDataFrame([(k, t, "f", "p") for k, t in enumerate(texts)], SCHEMA)
    for r in fp.fingerprint(docs).collect():
        assert r.n_paragraphs == sum(paragraphs(texts[r.doc_id]).values()) and len(r.fingerprint) == 4 + 14 * fp.CELLS
    assert fp.fingerprint(docs.limit(0)).count() == 0 and fp.compare(df.limit(0), "a", "b", ("id",)).count() == 0


def test_edits_change_little(spark):
    """Changing one word of a long text leaves most digests alone."""
    text = " ".join(f"word{k * 7 % 613}" for k in range(2000))
    docs = spark.createDataFrame([(1, text, text.replace("word70 ", "other "))], "id long, a string, b string")
    r = fp.compare(docs, "a", "b", ("id",)).first()
    assert 0.9 < r.likeness < 1 and len(r.only_left) <= 12


def test_very_long_text_is_cut_at_blanks(monkeypatch):
    monkeypatch.setattr(fp, "SCAN", 100)
    text = "ab cd\n" * 200 + "x" * 500
    parts = list(fp._parts(text))
    assert "".join(parts) == text and all(p[-1] in " \n" for p in parts[:-1]) and len(parts) > 5
