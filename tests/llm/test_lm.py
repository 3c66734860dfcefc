import math
import random
import re
import subprocess
import sys
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
pytest.importorskip("tiktoken")

from grovespark.llm import lm  # noqa: E402
from grovespark.llm.attention import STRIDE, Attention  # noqa: E402
from grovespark.llm.common import held_out  # noqa: E402

PATH = P.path("byte_bpe_50k.tiktoken")


def test_gradients():
    r = np.random.default_rng(0)
    first = np.zeros(50, dtype=bool)
    first[[3, 7, 49]] = True
    model = Attention(first, np.arange(50))
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    ids, alone = r.integers(0, 50, (4, 2 * STRIDE)), np.array([True, False, False, False])
    target, known = r.integers(0, 50, (4, STRIDE)), r.random((4, STRIDE)) < 0.8
    _, g = model.gradients(ids, alone, target, known)
    for k, v in model.p.items():
        at = tuple(r.integers(0, s) for s in v.shape)
        old = v[at]
        v[at] = old + 1e-4
        more, _ = model.gradients(ids, alone, target, known)
        v[at] = old - 1e-4
        less, _ = model.gradients(ids, alone, target, known)
        v[at] = old
        assert (more - less) / 2e-4 == pytest.approx(g[k][at], abs=1e-5, rel=0.01)


def test_scoring_equals_one_window_at_a_time_and_sums_to_one():
    r = np.random.default_rng(1)
    first = np.zeros(70, dtype=bool)
    first[[3, 7, 69]] = True
    model = Attention(first, np.arange(70))
    flat, alone, known, start = lm.layout(r.integers(0, 69, 100), np.array([60, 0, 40]), 69)
    lp, begins = model.score(flat, alone)
    stream = flat.ravel()
    for at in np.flatnonzero(known):
        row = at // STRIDE
        window = np.r_[flat[row - 1], flat[row]] if row else np.r_[flat[0], flat[0]]
        h = model.attend(window[None], alone[row : row + 1])[-1][0, at % STRIDE]
        every, _ = model.log_probabilities(np.repeat(h[None], 70, axis=0), np.arange(70))
        assert lp[at] == pytest.approx(every[stream[at + 1]], abs=1e-4)
        assert np.exp(every).sum() == pytest.approx(1, abs=1e-4)
        assert math.exp(begins[at]) == pytest.approx(np.exp(every[first]).sum(), abs=1e-4)


def test_against_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_CHARS", 3000)
    monkeypatch.setattr(lm, "PART_WORDS", 20)
    monkeypatch.setattr(lm, "PASSAGE", 90)
    monkeypatch.setattr(lm, "BEGIN", 30)
    monkeypatch.setattr(lm, "EACH", 5)
    r = random.Random(4)
    words = ["the", "of", "Über", "x" * 300, "\xa0odd", "naïve", "THE"] + [f"w{i}" for i in range(40)]
    rows = [(i, " \n".join(r.choice(words) for _ in range(r.choice([0, 1, 5, 80]))), "c") for i in range(200)] + [(500, None, "c"), (3, "twice the", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)
    got = {(x.doc_id, x.n_tokens, round(x.base_score, 6)): x for x in lm.score(docs, held_out(F.col("doc_id"), 10), PATH).collect()}
    counts, tokens = Counter(), {}
    for k, (i, t, _) in enumerate(rows):
        own = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or "")) + [None]
        tokens[k] = own
        if crc32(str(i).encode()) % 10:
            counts.update(own)
    n, v = sum(counts.values()), len(counts)
    for k, (i, _, _) in enumerate(rows):
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens[k])
        x = got[i, len(tokens[k]), round(base, 6)]
        assert (x.n_known, x.train_tokens, x.held_out) == (sum(counts[w] > 0 for w in tokens[k]), n, crc32(str(i).encode()) % 10 == 0)
        assert math.isfinite(x.score) and x.score < 0


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(docs, held_out(F.col("doc_id"), 10), PATH).count() == 0


def test_repeated_rows_do_not_fill_a_block(spark, monkeypatch):
    """A row repeated many times is one row of a block, counts each time and is returned each time."""
    monkeypatch.setattr(lm, "BLOCK_CHARS", 2000)
    text = "a repeated row of words " * 4
    rows = [(7, text)] * 300 + [(None, "nothing here")] * 2 + [(8, None)] * 3 + [(i, f"other {i}") for i in range(20, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    dealt, _ = lm.dealt_to_blocks(docs.withColumn("held_out", F.lit(False)))
    assert dealt.groupBy("block").agg(F.sum(F.length("text")).alias("n")).agg(F.max("n")).first()[0] < 2000
    assert dealt.agg(F.sum("times")).first()[0] == len(rows)
    got = lm.score(docs, F.lit(False), PATH).collect()
    assert Counter(x.doc_id for x in got) == Counter(i for i, _ in rows)
    tokens = sum(len((t or "").split()) + 1 for _, t in rows)
    assert {x.train_tokens for x in got} == {tokens}
    assert len({(x.base_score, x.score) for x in got if x.doc_id == 7}) == 1


def test_all_rows_held_out_and_very_long_text(spark):
    docs = spark.createDataFrame([(1, "word " * 200_000), (2, "b" * 300_000)], "doc_id long, text string")
    got = {x.doc_id: x for x in lm.score(docs, F.lit(True), PATH).collect()}
    assert (got[1].n_tokens, got[2].n_tokens) == (200_001, 2)
    assert all(x.n_known == x.train_tokens == 0 and math.isfinite(x.score) for x in got.values())


def blocks_of(spark, rows):
    ranks = lm.load_ranks(PATH)
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    return lm.stored(lm.read(lm.dealt_to_blocks(docs)[0], ranks, 1)).where("part < 0"), ranks


def test_every_training_text_is_counted_and_taught(spark, monkeypatch):
    """Subwords of all training texts count, also of a corpus beyond what a sample took whole (6 million characters), and all their symbols are trained on."""
    monkeypatch.setattr(lm, "BLOCK_CHARS", 2_000_000)
    r = random.Random(5)
    words = ["the", "of", "Over", "naïve"] + ["".join(r.choices("abcdefgh", k=r.randrange(2, 9))) for _ in range(500)]
    texts = [" ".join(r.choices(words, k=6000)) for _ in range(220)]
    texts[7] += " zyzzyvaquux"  # a word that occurs once
    assert sum(map(len, texts)) > 6_000_000
    blocks, ranks = blocks_of(spark, [(i, t, i % 10 == 0) for i, t in enumerate(texts)])
    counts = Counter(w for i, t in enumerate(texts) if i % 10 for w in t.lower().split())
    whole, expected = lm.Subwords(ranks, []), Counter()
    for w, n in counts.items():
        for i in whole.ids(" " + w).tolist():
            expected[i] += n
    often = lm.subword_counts(blocks, max(ranks.values()) + 1)
    assert {i: int(often[i]) for i in np.flatnonzero(often).tolist()} == expected
    subwords = lm.Subwords(ranks, list(expected)[:100])
    symbols = Counter()
    for w, n in counts.items():
        ids = whole.ids(" " + w)
        for x in subwords.symbols(ids, np.array([len(ids)]))[0].tolist():
            symbols[x] += n
    taught = Counter()
    for row in blocks.collect():
        ids, _, weights, n = lm.lessons(lm.unpacked(row), subwords)
        assert len(ids) == n
        taught.update(np.r_[ids.ravel()[1:], subwords.end][weights.ravel() > 0].tolist())
    assert taught.pop(subwords.end) == sum(i % 10 > 0 for i in range(220))
    assert taught == symbols


def test_rounds_meet_every_block(spark, monkeypatch):
    """Each block is trained on in one round, and averages weigh blocks by their tokens."""
    monkeypatch.setattr(lm, "BLOCK_CHARS", 2000)
    monkeypatch.setattr(lm, "PASSAGE", 90)
    monkeypatch.setattr(lm, "BEGIN", 10)
    met, averaged = [], lm.averaged

    def watched(found, groups):
        kept = lm.stored(found)
        met.append(kept.agg(F.count("*"), F.sum("n")).first())
        return averaged(kept, groups)

    monkeypatch.setattr(lm, "averaged", watched)
    r = random.Random(6)
    blocks, ranks = blocks_of(spark, [(i, " ".join(r.choices(["the", "of", "words"], k=40)), i % 10 == 0) for i in range(200)])
    lm.train(blocks, ranks)
    assert sum(x[0] for x in met) == blocks.count() > 10
    # three words of a symbol each, and an end
    assert sum(x[1] for x in met) == 180 * 41


def test_equal_rows_weigh_as_many_in_training(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_CHARS", 2000)
    rows = [(7, "the words", False)] * 900 + [(i, f"of {i}", False) for i in range(20, 30)]
    blocks, ranks = blocks_of(spark, rows)
    subwords = lm.Subwords(ranks, [])
    for row in blocks.collect():
        block = lm.unpacked(row)
        ids, _, weights, _ = lm.lessons(block, subwords)
        places = block["counts"] + 1
        length = subwords.symbols(block["ids"], block["pieces"])[1]
        per_doc = [int(x.sum()) + 1 for x in np.split(length[block["word"]], np.cumsum(block["counts"])[:-1])]
        assert weights.sum() == pytest.approx(np.dot(per_doc, block["times"])) and len(places) == len(per_doc)
        assert len(ids) <= 2 * 2000 // (lm.SYMBOL * STRIDE) + len(per_doc)


def test_large_ids_beside_a_null_id(spark):
    rows = [(2**53 + 1, "a b"), (None, "c"), (-(2**53) - 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(x.doc_id for x in lm.score(docs, F.lit(False), PATH).collect()) == Counter(i for i, _ in rows)


STEPS = """
import resource
import numpy as np
from grovespark.llm.attention import STRIDE, Attention
first = np.zeros(1257, dtype=bool)
first[:300] = True
model, ids = Attention(first, np.arange(1257)), np.random.default_rng(0).integers(0, 1257, (256 * 20, STRIDE)).astype(np.int32)
faults = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_minflt
fit = lambda: model.fit(ids, np.zeros(len(ids), dtype=bool), np.ones(ids.shape, dtype=np.float32), 1, 256)
fit()
begin = faults()
fit()
print((faults() - begin) / 20)
"""


def test_steps_reuse_their_memory():
    """A step of training maps no new memory for its arrays, which took a third of its time."""
    found = subprocess.run([sys.executable, "-c", STEPS], capture_output=True, text=True, check=True)
    assert float(found.stdout) < 200


def test_words_are_numbered_by_ascending_keys(monkeypatch):
    """Words get the same numbers however texts are sliced, each is written once, also one at the very begin."""
    r = random.Random(7)
    texts = ["first Word", None, "", " \n", "naïve\twörd " + "x" * 3000] + [" ".join(f"w{r.randrange(30)}" for _ in range(50)) for _ in range(20)]
    whole = lm.indexed(texts)
    monkeypatch.setattr(lm.slices, "__defaults__", (100,))
    cut = lm.indexed(texts)
    assert all(np.array_equal(a, b) for a, b in zip(whole[:3], cut[:3], strict=True)) and whole[3] == cut[3]
    word, counts, keys, written = whole
    assert (np.diff(keys.astype(object)) > 0).all()
    own = written.split(" ")[1:]
    expected = ["".join(c.lower() if c.isascii() else c for c in t or "").split() for t in texts]
    assert counts.tolist() == list(map(len, expected))
    assert [own[i] for i in word.tolist()] == [w for t in expected for w in t]
    assert sorted(own) == sorted({w for t in expected for w in t})
