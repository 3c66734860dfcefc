import random

import pytest

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")

from grovespark.llm import bpe  # noqa: E402


def texts():
    r = random.Random(1)
    odd = ["", "a\x1cb \x1f x", "    hi  x\x85y", "<|endoftext|>a<|endoftext|> b", "a'll'S", "x² ½", "\x00\x01", "\U0001f600" * 5 + "ab" * 2000, "a" * 1001, " " * 77]
    for _ in range(600):
        odd.append("".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 0x250), r.randrange(0x2000, 0x2070), r.randrange(9, 32), 0x1680, 97])) for _ in range(60)))
    return odd


def test_matches_library(spark):
    path = P.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    rows = [(i, t, "extra") for i, t in enumerate(texts())] + [(9999, None, "extra"), (0, "", "extra")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.encode(docs, path).collect()
    want = {i: t or "" for i, t, _ in rows}
    assert len(got) == len(rows)
    for r in got:
        encoding = library.encode(want[r.doc_id], add_special_tokens=False)
        assert r.ids == encoding.ids
        assert r.decoded == library.decode(encoding.ids, skip_special_tokens=False)


def test_forgetful_cache_gives_the_same():
    vocabulary = bpe.load_vocabulary(P.path("byte_bpe_50k.json"))
    small, large = bpe.Codec(vocabulary, cache_words=50), bpe.Codec(vocabulary)
    some = texts()[:100]
    assert [list(small.encode_all([t])) for t in some] == [list(large.encode_all([t])) for t in some]
    assert small.decode([list(small.encode_all(["é"]))[0][0][0]][:1]) == b"\xc3\xa9"
    assert large.decode([127]) == "�".encode() or large.decode([127])


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digests(docs, P.path("byte_bpe_50k.json")).count() == 0
