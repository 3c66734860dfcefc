import re

import pytest
from pyspark.sql import types as T

from grovespark.llm import mixing

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("copies", T.StringType())])


def brute_targets(sizes):
    """Share by weight, cap at three times the size, share the excess again until nobody is above."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = sum(weight[s] for s in order if s not in capped)
        share = {s: 3 * sizes[s] if s in capped else left * weight[s] / free for s in order}
        over = {s for s in order if s not in capped and share[s] > 3 * sizes[s]}
        if not over:
            return share
        capped |= over


def test_targets_and_copies(spark):
    rows, sizes = [], {}
    for i in range(400):
        source = [None, "a", "b", "c", "é", "Z", "empty"][i % 7 if i < 350 else 1]
        n = 0 if source == "empty" else (i * 37) % 50 * (1 if source in ("a", "b") else 9)
        text = None if i == 5 else " \t".join(["wörd"] * n)
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        sizes[source] = sizes.get(source, 0) + n
        rows.append((i, text, source, "x"))
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = mixing.copies(docs).collect()
    want = brute_targets(sizes)
    assert len(got) == 400
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.copies <= 3
        taken[r.source] += r["size"] * r.copies
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.3 * want[s] + 50
    again = {r.doc_id: r.copies for r in mixing.copies(docs.repartition(5)).collect()}
    assert again == {r.doc_id: r.copies for r in got}
    emitted = mixing.emit(docs)
    assert emitted.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in emitted.groupBy("doc_id").count().collect()}
    assert counts == {k: v for k, v in again.items() if v}


def test_empty(spark):
    docs = spark.createDataFrame([], DOCS)
    assert mixing.copies(docs).count() == 0
    assert mixing.emit(docs).count() == 0


def test_all_texts_empty(spark):
    docs = spark.createDataFrame([(1, None, "a", ""), (1, "", None, "")], DOCS)
    assert [(r.target, r.copies) for r in mixing.copies(docs).collect()] == [(0.0, 0), (0.0, 0)]
