"""Hard negatives by an inverted multi-index.

A vector is cut into two halves, each half has a codebook, and the two codewords of
a row are its cell.  An anchor's score of a row is at most, for each half, its inner
product with the codeword plus its own length times the codeword's radius; the sum
of the two half scores bounds all scores in a cell.  A multi-sequence heap visits
cells in the order of these sums, the best first, and stops as soon as the next sum
is below what the wanted rows have at least.  What they have at least is known after
a first round over the first cells: the fifth best row of the anchor's label, then
for each window of negatives the third best row in it, or the window's low end while
it has fewer.  So results are exact, however good the codebooks are.

Spark does the work in tiles.  Rows of neighbouring cells form parts of bounded size
(a cell that is larger is dealt over several parts), anchors form blocks by the part
that they lie in, and a tile is a part with a block of which some anchor visits it.
A task multiplies the two and gives back the first few rows of each anchor, never
all pairs.  Codebooks are fitted on a sample (``SAMPLE`` rows by a hash); the
table of cells has at most ``MOST_WORDS`` squared rows, whatever the input.

Defined results: rows with a null vec_id, label or vector, or a null or non-finite
component take no part; rows of the anchor's vec_id are no others; a repeated row is
a row each time as a positive or negative, and one anchor; missing components of a
shorter vector count as 0, so an empty vector scores 0 with all; ties go by vec_id;
an anchor without positives or a window without rows gives nothing; other columns are
ignored; an empty table gives an empty result.  Scores are exact below 2^53.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grovespark.llm.common import stored

#: Rows that the codebooks are fitted on, and steps of fitting.
SAMPLE, STEPS = 20_000, 10
#: Rows a cell holds on average, and the most codewords of a half.
CELL_ROWS, MOST_WORDS = 512, 256
#: Rows of a part; parts whose anchors form a block.
PART_ROWS, BLOCK_PARTS = 4096, 25
#: Rows that the first round looks at.
PROBE = 2048
#: Anchors scored at once in a tile, and visited cells sent at once.
SLAB, SEND = 256, 500_000


def usable(rows: DataFrame, label: Column) -> DataFrame:
    """vec_id, label, vec of the rows that take part; components are not yet rounded."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vec"))


def matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """Lists as rows of a matrix, filled up with 0."""
    flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def lists_of(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.argmin((words * words).sum(axis=1) - 2 * (x @ words.T), axis=1)


def codebook(x: np.ndarray, k: int) -> np.ndarray:
    """``k`` centres at most, by Lloyd's steps from the first rows."""
    words = np.unique(x, axis=0, return_index=True)[1]
    words = x[np.sort(words)[:k]].copy()
    for _ in range(STEPS):
        own = nearest(x, words)
        n = np.bincount(own, minlength=len(words))
        sums = np.zeros_like(words)
        np.add.at(sums, own, x)
        words[n > 0] = sums[n > 0] / n[n > 0, None]
    return words


class Index:
    """Codebooks, what each cell holds, and the parts that its rows lie in."""

    def __init__(self, width: int, words: tuple[np.ndarray, np.ndarray]):
        self.width, self.words = width, words
        self.shape = (len(words[0]), len(words[1]))

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.width // 2], x[:, self.width // 2 :]

    def place(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Cell of each row and its distance from the codeword in each half."""
        own = [nearest(h, w) for h, w in zip(self.halves(x), self.words)]
        away = [np.sqrt(((h - w[o]) ** 2).sum(axis=1)) for h, w, o in zip(self.halves(x), self.words, own)]
        return own[0] * self.shape[1] + own[1], away

    def learn_cells(self, cell: np.ndarray, n: np.ndarray, away: list[np.ndarray]) -> None:
        """What the table of cells says: rows and largest distances."""
        size = self.shape[0] * self.shape[1]
        self.n = np.zeros(size, np.int64)
        self.n[cell] = n
        self.cell_radius = np.zeros((2, size))
        for r, a in zip(self.cell_radius, away):
            r[cell] = a * (1 + 1e-9) + 1e-9
        grid = self.cell_radius.reshape(2, *self.shape)
        self.radius = grid[0].max(axis=1), grid[1].max(axis=0)
        self.first, self.parts = np.zeros(size, np.int64), np.ones(size, np.int64)
        part = held = 0
        for c in np.flatnonzero(self.n).tolist():
            if held and held + self.n[c] > PART_ROWS:
                part, held = part + 1, 0
            self.first[c], self.parts[c] = part, max(1, -(-int(self.n[c]) // PART_ROWS))
            held += int(self.n[c])
            if self.parts[c] > 1:
                part, held = part + int(self.parts[c]), 0

    def half_scores(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each half: inner products with the codewords, lengths, and bounds with the codewords' radii."""
        out = []
        for h, w, r in zip(self.halves(x), self.words, self.radius):
            length = np.sqrt((h * h).sum(axis=1))
            inner = h @ w.T
            slack = 1e-6 + 1e-10 * (np.abs(inner) + length[:, None] * r)
            out.append((inner, length, inner + length[:, None] * r + slack))
        return out


def sequence(one: np.ndarray, two: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """Pairs of places in the two lists by descending sum: the multi-sequence heap."""
    a, b = np.argsort(-one, kind="stable").tolist(), np.argsort(-two, kind="stable").tolist()
    heap = [(-(one[a[0]] + two[b[0]]), 0, 0)]
    while heap:
        less, x, y = heapq.heappop(heap)
        yield a[x], b[y], -less
        if y + 1 < len(b):
            heapq.heappush(heap, (-(one[a[x]] + two[b[y + 1]]), x, y + 1))
        if y == 0 and x + 1 < len(a):
            heapq.heappush(heap, (-(one[a[x + 1]] + two[b[0]]), x + 1, 0))


def visited(index: Index, halves: list[tuple], k: int, low: float, high: float, certified: float | None) -> list[int]:
    """Cells that anchor ``k`` of the batch visits for rows scoring from ``low`` to ``high``.

    Without ``certified`` those of the first round, which ends after ``PROBE`` rows; with it the
    rest, down to the last whose bound is not below it.
    """
    (in1, len1, up1), (in2, len2, up2) = ((h[0][k], h[1][k], h[2][k]) for h in halves)
    cells, seen, width = [], 0, index.shape[1]
    for i, j, bound in sequence(up1, up2):
        if bound < (low if certified is None or seen < PROBE else max(low, certified)):
            break
        c = i * width + j
        if not index.n[c]:
            continue
        middle, reach = in1[i] + in2[j], len1 * index.cell_radius[0, c] + len2 * index.cell_radius[1, c]
        slack = 1e-6 + 1e-10 * (abs(middle) + reach)
        if middle + reach + slack < low or middle - reach - slack > high:
            continue
        if seen >= PROBE and certified is None:
            break
        if (seen < PROBE) == (certified is None) and (certified is None or middle + reach + slack >= certified):
            cells.append(c)
        seen += int(index.n[c])
    return cells


VISIT = "part long, block long, anchor long, vec_id long, label long, vec array<double>, lows array<long>, highs array<long>, cells array<int>"


def visits(anchors: DataFrame, index: Index, certified: bool) -> DataFrame:
    """A row for each anchor and part that it visits: the anchor with its windows, and the cells there.

    ``anchors``: anchor, vec_id, label, vec, block, lows, highs and, if ``certified``, least.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("vec"), index.width)
            halves = index.half_scores(x)
            lows, highs = batch.column("lows").to_pylist(), batch.column("highs").to_pylist()
            least = batch.column("least").to_pylist() if certified else None
            owner, cell, held = [], [], 0
            for k in range(len(x)):
                open_ = [(lo, hi) for lo, hi in zip(lows[k], highs[k]) if lo <= hi] if lows[k] is not None else [(-np.inf, np.inf)]
                if not open_:
                    continue
                found = visited(index, halves, k, min(w[0] for w in open_), max(w[1] for w in open_), None if least is None else -np.inf if least[k] is None else least[k])
                owner.append(np.full(len(found), k))
                cell.append(np.array(found, dtype=np.int64))
                held += len(found)
                if held > SEND:
                    yield _sent(batch, index, np.concatenate(owner), np.concatenate(cell))
                    owner, cell, held = [], [], 0
            if held:
                yield _sent(batch, index, np.concatenate(owner), np.concatenate(cell))

    return anchors.mapInArrow(walk, VISIT)


def _sent(batch: pa.RecordBatch, index: Index, owner: np.ndarray, cell: np.ndarray) -> pa.RecordBatch:
    times = index.parts[cell]
    at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    owner, cell, part = np.repeat(owner, times), np.repeat(cell, times), np.repeat(index.first[cell], times) + at
    order = np.lexsort((cell, part, owner))
    owner, cell, part = owner[order], cell[order], part[order]
    new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (part[1:] != part[:-1])])
    rows = batch.select(["block", "anchor", "vec_id", "label", "vec", "lows", "highs"]).take(pa.array(owner[new]))
    cells = pa.ListArray.from_arrays(pa.array(np.r_[new, len(owner)].astype(np.int32)), pa.array(cell.astype(np.int32)))
    return pa.RecordBatch.from_arrays([pa.array(part[new]), *rows.columns, cells], names=["part", *rows.schema.names, "cells"])


def first_in_rows(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest finite entries of each row; of equal ones those further left."""
    if scores.shape[1] > k:
        kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        row, column = np.nonzero((scores >= kth[:, None]) & (scores > -np.inf))
    else:
        row, column = np.nonzero(scores > -np.inf)
    order = np.lexsort((column, -scores[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


def scored(found: DataFrame, rows: DataFrame, width: int, same: bool, k: int) -> DataFrame:
    """anchor, place (of the window), score, vec_id: for every tile the first ``k`` rows of each anchor and window.

    ``same``: rows of the anchor's label, in one window without ends; else rows of other labels.
    """
    tiles = found.select(F.col("part").alias("of_part"), F.col("block").alias("of_block")).distinct()
    dealt = rows.join(tiles, F.col("part") == F.col("of_part")).select("of_part", "of_block", "cell", "vec_id", "label", "vec")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64),) * 4]
        if left.num_rows and right.num_rows:
            one = lambda t, c: t.column(c).combine_chunks()
            order = np.argsort(one(right, "vec_id").to_numpy(), kind="stable")
            ids, labels, cells = (one(right, c).to_numpy()[order] for c in ("vec_id", "label", "cell"))
            y = np.floor(matrix(one(right, "vec"), width)[order])
            here, cells = np.unique(cells, return_inverse=True)
            for at in range(0, left.num_rows, SLAB):
                slab = left.slice(at, SLAB)
                lists = one(slab, "cells")
                asked = np.zeros((slab.num_rows, len(here) + 1), bool)
                wanted = lists.flatten().to_numpy(zero_copy_only=False)
                place = np.minimum(np.searchsorted(here, wanted), len(here) - 1)
                asked[np.repeat(np.arange(slab.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False)), np.where(here[place] == wanted, place, len(here))] = True
                fits = asked[:, cells] & ((one(slab, "label").to_numpy()[:, None] == labels) == same) & (one(slab, "vec_id").to_numpy()[:, None] != ids)
                s = np.where(fits, matrix(one(slab, "vec"), width) @ y.T, -np.inf)
                keys = one(slab, "anchor").to_numpy()
                if same:
                    i, j = first_in_rows(s, k)
                    out.append((keys[i], np.zeros(len(i), np.int64), s[i, j].astype(np.int64), ids[j]))
                    continue
                lows, highs = one(slab, "lows").to_pylist(), one(slab, "highs").to_pylist()
                for w in range(max(map(len, lows))):
                    lo, hi = (np.array([float(x[w]) if w < len(x) else end for x in xs]) for xs, end in ((lows, np.inf), (highs, -np.inf)))
                    i, j = first_in_rows(np.where((s >= lo[:, None]) & (s <= hi[:, None]), s, -np.inf), k)
                    out.append((keys[i], np.full(len(i), w), s[i, j].astype(np.int64), ids[j]))
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*out)], names=["anchor", "place", "score", "vec_id"])

    return found.groupBy("part", "block").cogroup(dealt.groupBy("of_part", "of_block")).applyInArrow(score, "anchor long, place long, score long, vec_id long")


def first_of_each(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "place").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def build(rows: DataFrame) -> tuple[Index, DataFrame]:
    """The index, and ``rows`` with components rounded and cell and part added, in the shared folder."""
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    width = max(width, 1)
    drawn = rows.orderBy(F.xxhash64("vec_id", "vec"), "vec_id").limit(SAMPLE).select("vec").toArrow()
    sample = np.floor(256 * matrix(drawn.column("vec").combine_chunks(), width)) if n else np.zeros((1, width))
    k = int(np.clip(round(np.sqrt(n / CELL_ROWS)), 1, MOST_WORDS))
    index = Index(width, (codebook(sample[:, : width // 2], k), codebook(sample[:, width // 2 :], k)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.floor(256 * matrix(batch.column("vec"), width))
            cell, away = index.place(x)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), lists_of(x), pa.array(cell.astype(np.int32)), *map(pa.array, away)], names=["vec_id", "label", "vec", "cell", "away1", "away2"])

    placed = stored(rows.mapInArrow(place, "vec_id long, label long, vec array<double>, cell int, away1 double, away2 double"))
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away1").alias("away1"), F.max("away2").alias("away2")).toPandas()  # MOST_WORDS squared rows at most
    index.learn_cells(cells.cell.to_numpy(), cells.n.to_numpy(), [cells.away1.to_numpy(), cells.away2.to_numpy()])
    table = rows.sparkSession.createDataFrame([(c, int(index.first[c]), int(index.parts[c])) for c in cells.cell.tolist()], "cell int, first long, parts long")
    dealt = placed.join(F.broadcast(table), "cell").withColumn("part", F.col("first") + F.pmod(F.xxhash64("vec_id", "label", "vec"), F.col("parts")))
    return index, dealt.select("vec_id", "label", "vec", "cell", "part")


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows``: as of ``usable``; components are multiplied by 256 and rounded down.  An anchor's positives are its
    ``positives`` best other rows of its label; a negative's score is from ``low`` to ``high`` percent of the positive's.
    """
    index, dealt = build(rows)
    width = index.width
    none = F.lit(None).cast("array<long>")
    first = dealt.where(is_anchor).withColumns({"anchor": F.xxhash64("vec_id", "label", "vec"), "block": F.floor(F.col("part") / BLOCK_PARTS)})
    columns = ["anchor", "vec_id", "label", "vec", "block", "lows", "highs"]
    anchors = stored(first.dropDuplicates(["anchor"]).withColumns({"lows": none, "highs": none}).select(columns))

    def both_rounds(anchors: DataFrame, same: bool, k: int, least: Column) -> DataFrame:
        """The first round, what it certifies, the second, and the first ``k`` of both."""
        probe = stored(first_of_each(scored(stored(visits(anchors, index, False)), dealt, width, same, k), k).drop("rank"))
        known = probe.groupBy("anchor", "place").agg(F.count("*").alias("n"), F.min("score").alias("kth")).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("place", F.when(F.col("n") == k, F.col("kth")).alias("kth")))).alias("kths"))
        certified = anchors.join(known, "anchor", "left").select(*columns, least.alias("least"))
        rest = scored(stored(visits(certified, index, True)), dealt, width, same, k)
        return stored(first_of_each(probe.unionByName(rest), k))

    best = both_rounds(anchors, True, positives, F.element_at("kths", F.lit(0).cast("long")))
    ends = F.array_sort(F.collect_list(F.struct("rank", F.expr(f"-((-score * {low}) div 100) + IF((-score * {low}) % 100 < 0, 1, 0)").alias("lo"), F.expr(f"(score * {high}) div 100 - IF((score * {high}) % 100 < 0, 1, 0)").alias("hi"))))
    windows = best.groupBy("anchor").agg(ends.alias("w")).select("anchor", F.transform("w", lambda w: w["lo"]).alias("lows"), F.transform("w", lambda w: w["hi"]).alias("highs"))
    open_ = stored(anchors.drop("lows", "highs").join(windows, "anchor").select(columns))
    # the least score that still matters: over the windows that are not empty the smallest of the kth best so far, or of the low end
    spans = F.transform(F.sequence(F.lit(0).cast("long"), F.size("lows").cast("long") - 1), lambda i: F.when(F.element_at("lows", (i + 1).cast("int")) <= F.element_at("highs", (i + 1).cast("int")), F.coalesce(F.element_at("kths", i), F.element_at("lows", (i + 1).cast("int")))))
    chosen = both_rounds(open_, False, negatives, F.array_min(spans))
    of = best.select("anchor", (F.col("rank") - 1).cast("long").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = anchors.select("anchor", F.col("vec_id").alias("anchor_id"))
    out = chosen.select("anchor", "place", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(of, ["anchor", "place"]).join(named, "anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


SQL = """
WITH usable AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM (SELECT DISTINCT * FROM usable WHERE vec_id % 50 = 0) a JOIN usable b ON a.vec_id != b.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3"""
