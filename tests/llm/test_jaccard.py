import random
import re

import numpy as np
import pytest

from grovespark.llm import jaccard
from grovespark.llm.shingles import shingle_sets


def sets_of(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, width, percent):
    sets = [sets_of(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b, key=lambda k: rows[k][0])] = min(a, b, key=lambda k: rows[k][0])
    return sorted((rows[i][0], len(sets[i]), rows[find(i)][0]) for i in range(len(rows)))


def corpus(seed, n=160):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "Straße"]
    texts = []
    for _ in range(n // 4):
        base = [r.choice(words) for _ in range(r.choice([1, 2, 3, 9, 12, 15, 25, 60, 200, 500]))]
        texts.append(" ".join(base))
        for _ in range(3):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                at = r.randrange(len(copy) + 1)
                copy[at : at + r.choice([0, 1])] = r.choice([[], ["new"], [r.choice(words)]])
            texts.append((" \n" if r.random() < 0.2 else " ").join(w.upper() if r.random() < 0.05 and w.isascii() else w for w in copy))
    texts += [None, "", " \t\n", None]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize("seed,width,percent", [(1, 3, 90), (2, 5, 80), (3, 5, 80), (4, 2, 60)])
def test_matches_brute_force(spark, monkeypatch, seed, width, percent):
    if seed == 2:  # blocks that meet two by two, and segments of one hash, so that there are misfits
        monkeypatch.setattr(jaccard, "COMMON", 0.0)
        monkeypatch.setattr(jaccard, "BLOCK_CLASSES", 2)
        monkeypatch.setattr(jaccard, "MANY_BLOCKS", 1)
    if seed == 3:  # every chunk is a few texts
        monkeypatch.setattr(jaccard, "CHUNK_CHARS", 2000)
        monkeypatch.setattr(jaccard, "ASKED", 0.4)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(tuple(r) for r in jaccard.join(docs, width, percent).collect())
    assert got == brute(rows, width, percent)


def test_boilerplate_and_hot_near_copies(spark, monkeypatch):
    """Passages that all texts share, one group of near copies with a third of all rows, and links between passages' carriers."""
    monkeypatch.setattr(jaccard, "CHUNK_CHARS", 20_000)
    monkeypatch.setattr(jaccard, "PART_ENTRIES", 5000)
    r = random.Random(9)
    passage = [f"p{i}" for i in range(120)]
    hot = [f"h{i}" for i in range(150)]
    rows = []
    for k in range(210):
        if k % 3 == 0:
            words = [f"x{k}" if i == k % 150 else w for i, w in enumerate(hot)]
        else:
            words = passage[: r.randrange(30, 120)] + [f"u{k}y{i}" for i in range(r.randrange(5, 150))]
        rows.append((k, " ".join(words)))
    rows += [(500 + k, f"{rows[k][1]} tail{k}") for k in range(1, 210, 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for width, percent in ((5, 80), (3, 90)):
        got = sorted(tuple(r) for r in jaccard.join(docs, width, percent).collect())
        assert got == brute(rows, width, percent)


def test_repeated_null_and_clashing_columns(spark):
    """Repeated ids are rows of their own, null ids too; columns named like the operator's are ignored."""
    long = " ".join(f"long{i}" for i in range(60_000))
    rows = [(1, "a b c d e f g", 1, 2), (1, "other words are in this one", 3, 4), (2, "a b c d e f g", 5, 6), (None, "other words are in this one", 7, 8), (None, None, 9, 9), (4, long, 0, 0), (5, long + " more", 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class long, band int")
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(docs, 3, 90).collect()), key=str)
    assert found == sorted([(1, 5, 1), (1, 4, 1), (2, 5, 1), (None, 4, 1), (None, 0, None), (4, 59_998, 4), (5, 59_999, 4)], key=str)


def test_hot_copies_and_empty_table(spark):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(i, text if i % 3 else f"{text} {i}") for i in range(90)] + [(200, "all alone here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.component_id, r.doc_id == 200) for r in jaccard.join(docs, 3, 90).collect()} == {(0, False), (200, True)}
    assert jaccard.join(docs.limit(0), 3, 90).count() == 0


@pytest.mark.parametrize("block", [2048, 16])
def test_pipeline_links_two_of_many_loose_versions(spark, monkeypatch, block):
    """Every entry of the one linking pair is also in some of the loose versions, which link with nothing."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", block)
    monkeypatch.setattr(jaccard, "MANY_BLOCKS", 3)
    monkeypatch.setattr(jaccard, "ASKED", 0.0)
    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(1000)]
    rows = [(k, " ".join(f"v{k}x{i}" if r.random() < 0.11 else w for i, w in enumerate(base))) for k in range(1000)]
    rows += [(2000, " ".join(base)), (2001, " ".join(f"new{i}" if i % 45 == 20 else w for i, w in enumerate(base)))]
    one, *others = [sets_of(t, 5) for _, t in reversed(rows)]
    alike = [len(one & s) / len(one | s) for s in others]
    assert 0.8 <= alike[0] < 0.81 and max(alike[1:]) < 0.6
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {x.doc_id for x in corpus_pipeline.one_of_near_copies(spark, docs, "").collect()}
    assert {i for i, _ in rows} - kept == {2001}


@pytest.mark.parametrize("percent,asked", [(90, 0.15), (90, 0.0), (80, 0.15), (80, 0.5), (70, 0.15)])
def test_linking_sets_share_as_many_entries_as_asked(percent, asked):
    """Under the scheme that both are in; two misfits share one of theirs."""
    r = np.random.default_rng(3)
    plan = jaccard.allocate(percent, asked)
    tried = odd = 0
    for size in (4, 6, 12, 20, 40, 100, 500):
        for _ in range(100):
            one = np.unique(r.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2))
            cut = r.integers(0, 2 * size * (100 - percent) // (100 + percent) // 2 + 1)
            two = np.unique(np.r_[one[cut:], r.integers(0, 2**63, r.integers(0, cut + 1), dtype=np.uint64)])
            both = len(np.intersect1d(one, two))
            if 100 * both < percent * (len(one) + len(two) - both) or cut == 0:
                continue
            entries, number, scheme = jaccard.index_entries(np.r_[one, two], np.array([len(one), len(two)]), plan, percent)
            band = np.searchsorted(plan.low, [len(one), len(two)], side="right") - 1
            tried += 1
            plain = [jaccard.misfits(jaccard.cut_sets(s, np.array([len(s)]), plan, int(band[i] - band.min())), plan)[0] for i, s in enumerate((one, two))]
            a, b = (set(entries[(number == i) & (scheme == band[i] - band.min())].tolist()) for i in (0, 1))
            c, d = (set(entries[(number == i) & (scheme == jaccard.MISFIT)].tolist()) for i in (0, 1))
            odd += all(plain)
            assert len(a & b) >= plan.asked[band.min()] if not all(plain) else c & d
    assert tried > 100 and odd < tried / 3  # most fit, so that their entries do the work


def test_misfits_meet_each_other_alone(spark):
    """Sets in few segments: all elements of the two, but for a few, fall into one segment."""
    plan = jaccard.allocate(80)
    r = np.random.default_rng(5)
    one = np.unique(r.integers(0, 2**50, 60, dtype=np.uint64))
    two = np.r_[one[: len(one) - 5], np.uint64(2**52)]
    other = np.unique(r.integers(0, 2**63, 60, dtype=np.uint64) * np.uint64(2))
    entries, number, scheme = jaccard.index_entries(np.r_[one, two, other], np.array([len(one), len(two), len(other)]), plan, 80)
    assert set(number[scheme == jaccard.MISFIT].tolist()) >= {0, 1}
    odd = [set(entries[(number == i) & (scheme == jaccard.MISFIT)].tolist()) for i in range(3)]
    assert odd[0] & odd[1] and not odd[0] & odd[2]


def test_packets():
    r = np.random.default_rng(1)
    for top in (2**20, 2**40, 2**62):
        entries = np.sort(r.integers(0, top, 300, dtype=np.uint64))
        codes = r.integers(0, 2**48 - 1, 300, dtype=np.uint64)
        for width in (4, 5, 6):
            if top < 2**62 or width == 6:
                got = jaccard.unpack_rows(jaccard.pack_rows(entries, codes, width), width)
                assert (got[0] == entries).all() and (got[1] == codes).all()


def test_sets():
    flat, sizes = shingle_sets(["a b c a b c", "A B", None, "", "x" * 3000, "é " * 9], 3)
    assert sizes.tolist() == [3, 1, 0, 0, 1, 1]
    assert len(set(flat.tolist())) == len(flat)
