"""Ranked lexical search: the best documents for each item, term at a time with limited accumulators.

Documents are read once to count, of the terms that the items hold, how often each
document has them; these postings are written to the shared folder.  Document
frequencies and lengths are aggregates over them.  Then every task takes its postings
in blocks of bounded size and scores all items of the block of items against them,
rarest term first.  A document gets an accumulator with the first of an item's terms
that it has, but only while the largest contributions of the terms still to come,
this one included, can reach the score of the kth best document so far; after that
the accumulators that there are go on to be updated exactly.  A bound below that
score cannot enter the first k, and one equal to it still can by its id, so results
are exact.  The k best of each task meet in two steps, so no task holds more than a
share of an item's candidates.

Items come to the driver a block of bounded vocabulary at a time, and each block reads the
documents once.  An item whose own vocabulary is larger is a block by itself.

Defined results: null or empty texts, and texts without a term, have no score and do
not count in N; an item without terms, or whose terms no document has, gives no row;
a repeated item_id or doc_id is an item or document of its own each time; equal
scores go by ascending doc_id, null ids last; columns other than the two that are
named are ignored; an empty table gives an empty result.  Terms are told apart by
64-bit hashes.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grovespark.llm.common import batched, stored
from grovespark.llm.shingles import scan_words

#: Characters outside terms: ASCII other than letters and digits.
APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Bytes outside terms.
APART_BYTES = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Distinct terms of a block of items; what a block sends to every task is bounded by this.
BLOCK_TERMS = 200_000
#: Characters scanned at once; longer texts are cut between terms.
SCAN = 4_000_000
#: Postings and documents that a task scores at once.
BLOCK_POSTINGS, BLOCK_DOCS = 2_000_000, 200_000
#: An item's candidates meet in so many parts first.
PARTS = 64


def cut_apart(text: str, size: int = SCAN) -> list[str]:
    """``text`` in parts of about ``size`` characters, cut where no term is."""
    parts, at, apart = [], 0, re.compile(APART)
    while len(text) - at > size:
        found = apart.search(text, at + size)
        if found is None:
            break
        parts.append(text[at : found.start()])
        at = found.start()
    return [*parts, text[at:]]


def terms_of(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text's place, hash) of every term occurrence, a bounded number of characters at once."""
    owners, parts, held = [], [], 0
    for k, text in enumerate(texts):
        for part in cut_apart(text or ""):
            if parts and held + len(part) > SCAN:
                yield _scanned(owners, parts)
                owners, parts, held = [], [], 0
            owners.append(k)
            parts.append(part)
            held += len(part)
    if parts:
        yield _scanned(owners, parts)


def _scanned(owners: list[int], parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    *_, hashes, counts = scan_words(parts, APART_BYTES)
    return np.repeat(np.array(owners, dtype=np.int64), counts), hashes


def query_terms(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct term hashes of one text and how often it has each."""
    found = [h for _, h in terms_of([text])]
    return np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)


def postings(docs: DataFrame, vocabulary: np.ndarray, text: str = "text") -> DataFrame:
    """doc_id, n (terms with repeats), terms (places in the sorted ``vocabulary``), tfs: a row a document with at least one term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows = batch.column(1).to_pylist(), batch.num_rows
            n, keys = np.zeros(rows, np.int64), []
            for owner, h in terms_of(texts):
                n += np.bincount(owner, minlength=rows)
                place = np.minimum(np.searchsorted(vocabulary, h), max(len(vocabulary) - 1, 0))
                hit = vocabulary[place] == h if len(vocabulary) else np.zeros(len(h), bool)
                keys.append(np.unique(owner[hit] * len(vocabulary) + place[hit], return_counts=True))
            key = np.concatenate([np.zeros(0, np.int64), *[k for k, _ in keys]])
            tf = np.concatenate([np.zeros(0, np.int64), *[c for _, c in keys]])
            key, again = np.unique(key, return_inverse=True)  # parts of a long text add up
            tf = np.bincount(again, weights=tf, minlength=len(key)).astype(np.int64)
            owner, place = np.divmod(key, max(len(vocabulary), 1))
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (place.astype(np.int32), tf)]
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *lists], names=["doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array(n > 0))

    return batched(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))).mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<long>")


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """A term's weight by the number of documents that hold it."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], dtype=np.int64)


class Block:
    """Postings of some documents, a term's together, with what each contributes before weights."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, vocabulary: int, n_docs: int, length: int):
        self.ids = ids
        owner = np.repeat(np.arange(len(ids)), sizes)
        m = 100 - 75 + (75 * n * n_docs) // length
        order = np.argsort(terms, kind="stable")
        self.docs = owner[order]
        tf = tfs[order]
        self.value = (1_000_000_000 * tf) // (1000 * tf + 8 * m[self.docs])
        self.start = np.searchsorted(terms[order], np.arange(vocabulary + 1))
        self.most = np.zeros(vocabulary, np.int64)
        held = np.flatnonzero(np.diff(self.start))
        if len(held):
            self.most[held] = np.maximum.reduceat(self.value, self.start[held])
        self.sum = np.zeros(len(ids), np.int64)

    def best(self, terms: np.ndarray, factor: np.ndarray, k: int, known: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) that hold all of the block's first ``k`` with scores of at least ``known``.

        ``terms``: rarest first; ``factor``: weight times occurrences in the item;
        ``known``: the kth best score of the blocks before, 0 without.
        """
        here = (self.start[terms + 1] > self.start[terms]) & (factor > 0)
        terms, factor = terms[here], factor[here]
        rest = np.cumsum((self.most[terms] * factor)[::-1])[::-1]
        held, at, kth = [], len(terms), known
        for i, (t, f) in enumerate(zip(terms.tolist(), factor.tolist(), strict=True)):
            if rest[i] < kth:  # no new document can reach the kth any more
                at = i
                break
            docs = self.docs[self.start[t] : self.start[t + 1]]
            self.sum[docs] += f * self.value[self.start[t] : self.start[t + 1]]
            held.append(docs)
            if len(docs) >= k:  # the kth of some of the documents is at most the kth of all
                now = self.sum[docs]
                kth = max(kth, int(np.partition(now, len(now) - k)[len(now) - k]))
        alive = np.unique(np.concatenate(held)) if held else np.zeros(0, np.int64)
        for t, f in zip(terms[at:].tolist(), factor[at:].tolist(), strict=True):
            lo, hi = self.start[t], self.start[t + 1]
            docs = self.docs[lo:hi]
            place = np.minimum(np.searchsorted(docs, alive), hi - lo - 1)
            met = docs[place] == alive
            self.sum[alive[met]] += f * self.value[lo:hi][place[met]]
        scores = self.sum[alive]
        self.sum[alive] = 0
        keep = scores >= max(known, 1)
        if (n := int(keep.sum())) > k:
            keep &= scores >= np.partition(scores[keep], n - k)[n - k]
        return alive[keep], scores[keep]


def first_k(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by id."""
    return np.lexsort((ids, -scores))[:k]


#: Stands for a null id, which comes last among ties.
NO_ID = np.iinfo(np.int64).max


def best_of_tasks(found: DataFrame, items: list[tuple[np.ndarray, np.ndarray]], vocabulary: int, n_docs: int, length: int, k: int) -> DataFrame:
    """item (its place in ``items``), doc_id, score: the k best of every task."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(items)
        held: list[pa.RecordBatch] = []

        def take() -> None:
            whole = pa.Table.from_batches(held).combine_chunks()
            ids = whole.column("doc_id").fill_null(NO_ID).to_numpy()
            lists = [whole.column(c).combine_chunks() for c in ("terms", "tfs")]
            terms, tfs = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
            sizes = lists[0].value_lengths().to_numpy(zero_copy_only=False)
            block = Block(ids, whole.column("n").to_numpy(), sizes, terms, tfs, vocabulary, n_docs, length)
            for i, (own, factor) in enumerate(items):
                ids_now, scores_now = best[i]
                docs, scores = block.best(own, factor, k, int(scores_now[-1]) if len(scores_now) == k else 0)
                if len(docs):
                    all_ids, all_scores = np.concatenate([ids_now, ids[docs]]), np.concatenate([scores_now, scores])
                    top = first_k(all_ids, all_scores, k)
                    best[i] = all_ids[top], all_scores[top]
            held.clear()

        postings_held = docs_held = 0
        for batch in batches:
            held.append(batch)
            postings_held, docs_held = postings_held + len(batch.column("terms").flatten()), docs_held + batch.num_rows
            if postings_held >= BLOCK_POSTINGS or docs_held >= BLOCK_DOCS:
                take()
                postings_held = docs_held = 0
        if held:
            take()
        place = np.repeat(np.arange(len(items)), [len(s) for _, s in best])
        ids = np.concatenate([x for x, _ in best]) if best else np.zeros(0, np.int64)
        scores = np.concatenate([s for _, s in best]) if best else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(ids, mask=ids == NO_ID), pa.array(scores)], names=["item", "doc_id", "score"])

    return found.mapInArrow(score, "item long, doc_id long, score long")


def first_of_each(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """``rows`` with rank up to k within ``by``: score descending, then doc_id, null ids last."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def item_blocks(items: DataFrame, text: str, most: int) -> Iterator[tuple[list, list, np.ndarray]]:
    """(ids, [(terms, occurrences)], vocabulary) of items, as many at a time as have ``most`` distinct terms together."""
    ids, own, held = [], [], 0
    for row in items.select(F.col("item_id").cast("long").alias("item_id"), F.col(text).cast("string").alias("text")).toLocalIterator():
        terms, times = query_terms(row["text"])
        if not len(terms):
            continue
        if ids and held + len(terms) > most:
            yield ids, own, np.unique(np.concatenate([t for t, _ in own]))
            ids, own, held = [], [], 0
        ids.append(row["item_id"])
        own.append((terms, times))
        held += len(terms)
    if ids:
        yield ids, own, np.unique(np.concatenate([t for t, _ in own]))


def search(docs: DataFrame, items: DataFrame, k: int = 10, text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: of each item the ``k`` documents with the highest score above 0."""
    spark, out = docs.sparkSession, None
    for ids, own, vocabulary in item_blocks(items, text, block_terms):
        found = stored(postings(docs, vocabulary, text))
        n_docs, length = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(vocabulary), np.int64)
        for row in found.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # one row a term of the block
            df[row["term"]] = row["count"]
        w, ranked = weights(df, n_docs), []
        for terms, times in own:
            place = np.searchsorted(vocabulary, terms)
            order = np.lexsort((place, df[place]))
            ranked.append((place[order], (w[place] * times)[order]))
        tops = best_of_tasks(found, ranked, len(vocabulary), n_docs, max(length, 1), k)
        salted = first_of_each(tops.withColumn("part", F.pmod(F.xxhash64("doc_id", "score"), F.lit(PARTS))), ["item", "part"], k).drop("rank")
        names = spark.createDataFrame(list(enumerate(ids)), "item long, item_id long")
        now = first_of_each(salted, ["item"], k).join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = now if out is None else out.unionByName(now)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


SQL = r"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents WHERE text IS NOT NULL),
docs AS MATERIALIZED (SELECT doc_id, row, ws, len(ws) AS n FROM words WHERE len(ws) > 0),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM docs),
tfs AS MATERIALIZED (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(ws) AS term FROM docs) GROUP BY row, term),
dfs AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM tfs, totals GROUP BY term, docs),
asked AS (
  SELECT item_id, item, term, count(*) AS times FROM (
    SELECT item_id, item, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT item_id, text, row_number() OVER () AS item FROM benchmark WHERE text IS NOT NULL)) GROUP BY item_id, item, term),
scores AS (
  SELECT item, item_id, t.row, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // length))))) AS BIGINT) AS score
  FROM asked JOIN dfs USING (term) JOIN tfs t USING (term) JOIN docs d ON d.row = t.row, totals GROUP BY item, item_id, t.row)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores JOIN docs USING (row) WHERE score > 0) WHERE rank <= 10"""
