import os

import pytest

pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def test_stages_against_brute_force(spark, tmp_path):
    import corpus_pipeline
    from grovespark.llm import langid, mixing, pii
    from tests.llm.test_jaccard import brute

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "n-gram Jaccard join", "PII", "mixing sources to target weights", "BPE encoding and decoding"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    odd = spark.createDataFrame([(9001, "12 34 !!", "en", "a", 8), (9002, None, "en", None, 0), (9003, "", None, "a", 0)], docs.schema)
    now, columns = docs.union(odd), docs.columns
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, SF).write.parquet(f"{tmp_path}/{k}")
        kept.append((now := spark.read.parquet(f"{tmp_path}/{k}")).collect())
    assert all(list(rows[0].asDict()) == columns for rows in kept[:4])
    assert not {9001, 9002, 9003} & {r.doc_id for r in kept[0]} and len(kept[0]) >= 115
    texts = [(r.doc_id, r.text) for r in kept[0]]
    assert sorted(r.doc_id for r in kept[1]) == sorted(i for i, _, c in brute(texts, 5, 80) if i == c)
    work = pii.Pseudonyms(corpus_pipeline.pseudonym_key(spark))
    before = {r.doc_id: r.text for r in kept[1]}
    assert {r.doc_id: r.text for r in kept[2]} == {i: work.replace(t)[0] for i, t in before.items()}
    assert all(r.n_chars == len(r.text) for r in kept[2])
    times = {r.doc_id: r.copies for r in mixing.copies(spark.read.parquet(f"{tmp_path}/2")).collect()}
    assert sorted(r.doc_id for r in kept[3]) == sorted(i for i, n in times.items() for _ in range(n))
    assert len(kept[4]) == len(kept[3]) and all(r.ids for r in kept[4])
    assert langid.UNDETERMINED not in {r.lang for r in kept[0]}
