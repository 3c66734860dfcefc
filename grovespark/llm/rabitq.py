"""Near-duplicate embeddings by randomised-rotation binary codes.

A vector is rotated at random and kept as its signs, with one correction factor:
the inner product of the signs and the rotated vector.  Signs times another
rotated vector, over the factor, is an unbiased estimate of the cosine, and its
error is bounded with confidence.  A pair whose estimate plus bound stays below the
threshold is dropped; every other pair is computed again exactly in double
precision.  The bound is taken for pairs at the threshold, where it is tightest:
the error shrinks with the sine of the angle.

Vectors meet only within one label.  Where labels are large they meet in hash
tables on signs of further random directions, as many as the wanted miss rate
takes; how many bits a table has follows from the largest label, and below some ten
thousand rows the choice is no bits, hence all pairs.  Buckets are cut into blocks
of bounded size, every two blocks of a bucket meet in a task, and tasks give back
counts and a spanning forest, never pairs.  A pair that meets in several tables
counts in the first.  Equal vectors form one class that is compared once.

Defined results: vectors that are null, empty, all zero or hold null or non-finite
numbers, and those with a null label, link with nothing; vectors of different
length don't link; a repeated vec_id is a vector of its own each time, with that
id; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovespark.llm.common import cut
from grovespark.llm.components import components
from grovespark.llm.jaccard import by_group

BLOCK = 1024
#: Pairs computed exactly at once.
PAIRS = 16_384
#: Width of the confidence bound in standard deviations; a linking pair is lost with a chance of about 1e-9.
CONFIDENCE = 6.0
#: Chance that a pair just at the threshold meets in no table.
MISS = 1e-6
#: Nanoseconds to estimate a pair, and to put a vector into one more table.
PAIR_COST, TABLE_COST = 3.0, 5000.0


def tables_for(largest: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """(tables, bits each): the cheapest choice that keeps the miss rate."""
    keep, best = 1 - math.acos(threshold) / math.pi, (1, 0)
    least = PAIR_COST * largest + TABLE_COST
    for bits in range(1, 48):
        tables = math.ceil(math.log(miss) / math.log1p(-(keep**bits)))
        cost = tables * (PAIR_COST * largest / 2**bits + TABLE_COST)
        if cost < least:
            least, best = cost, (tables, bits)
    return best


def rotation(size: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(size).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def directions(size: int, tables: int, bits: int) -> np.ndarray:
    return np.random.default_rng([size, tables, bits]).normal(size=(tables, bits, size))


def bucket_codes(x: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """Bucket number of each row in each table."""
    if not bits:
        return np.zeros((len(x), 1), dtype=np.int64)
    sides = np.einsum("nd,tbd->ntb", x, directions(x.shape[1], tables, bits)) > 0
    return sides @ (1 << np.arange(bits, dtype=np.int64))


class Codes:
    """Rows of unit length with their signs after rotation and correction factors."""

    def __init__(self, x: np.ndarray):
        self.unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
        self.rotated = self.unit @ rotation(x.shape[1])
        self.signs = np.where(self.rotated >= 0, 1.0, -1.0) / math.sqrt(x.shape[1])
        self.factor = (self.signs * self.rotated).sum(axis=1)

    def undecided(self, other: Codes, threshold: float, confidence: float = CONFIDENCE) -> np.ndarray:
        """Pairs (row here, row of other) whose estimated cosine may reach the threshold."""
        estimate = (self.signs.astype(np.float32) @ other.rotated.T.astype(np.float32)) / self.factor[:, None].astype(np.float32)
        spread = np.sqrt(np.maximum(1 - self.factor**2, 0)) / self.factor / math.sqrt(max(self.signs.shape[1] - 1, 1))
        bound = confidence * spread * math.sqrt(max(1 - threshold**2, 0)) + 1e-4
        return np.argwhere(estimate + bound[:, None] >= threshold)


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of rows, in double precision."""
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def block_links(group: pd.DataFrame, threshold: float, tables: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of all linked pairs of the two blocks (or of the one) in ``group``."""
    x = np.array(group.embedding.tolist(), dtype=np.float64)
    codes, own, table = Codes(x), group.own.to_numpy(), int(group.table.iloc[0])
    left = np.flatnonzero(own == group.x.iloc[0])
    right = np.flatnonzero(own == group.y.iloc[0])
    a, b = Codes.__new__(Codes), Codes.__new__(Codes)
    for part, rows in ((a, left), (b, right)):
        part.rotated, part.signs, part.factor = codes.rotated[rows], codes.signs[rows], codes.factor[rows]
    pairs = a.undecided(b, threshold) if len(left) and len(right) else np.zeros((0, 2), dtype=np.int64)
    i, j = left[pairs[:, 0]], right[pairs[:, 1]]
    if group.x.iloc[0] == group.y.iloc[0]:
        i, j = np.minimum(i, j), np.maximum(i, j)  # undecided from either side
        both = np.unique(i * len(x) + j)
        i, j = both // len(x), both % len(x)
        i, j = i[i != j], j[i != j]
    keep = np.zeros(len(i), dtype=bool)
    for at in range(0, len(i), PAIRS):
        keep[at : at + PAIRS] = exact(x[i[at : at + PAIRS]], x[j[at : at + PAIRS]]) >= threshold
    i, j = i[keep], j[keep]
    if table:
        met = bucket_codes(x, tables, bits)[:, :table]
        first = ~(met[i] == met[j]).any(axis=1)
        i, j = i[first], j[first]
    return i, j


def forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    root = list(range(n))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    out = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        if (p := find(a)) != (q := find(b)):
            root[q] = p
            out.append((a, b))
    return out


def near_duplicates(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row a vector."""
    fine = "label IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < float('infinity')) AND exists(embedding, v -> v != 0)"
    plain = F.transform("embedding", lambda v: v + F.lit(0.0).cast("float"))  # -0.0 equals 0.0
    rows = vectors.select("vec_id", "label", plain.alias("embedding"), F.coalesce(F.expr(fine), F.lit(False)).alias("fine"))
    rows = rows.withColumn("node", F.when(F.col("fine"), F.xxhash64("label", "embedding")))
    classes = rows.where("fine").groupBy("node", "label", "embedding").agg(F.count("*").alias("copies"))
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    tables, bits = tables_for(largest, threshold)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, part in batch.groupby(batch.embedding.map(len)):
                codes = bucket_codes(np.array(part.embedding.tolist(), dtype=np.float64), tables, bits)
                yield part.assign(size=size, codes=list(codes))

    if bits:
        placed = classes.mapInPandas(place, "node long, label int, embedding array<float>, copies long, size int, codes array<long>")
        placed = placed.select("node", "label", "embedding", "copies", "size", F.posexplode("codes").alias("table", "code"))
    else:
        placed = classes.withColumns({"size": F.size("embedding"), "table": F.lit(0), "code": F.lit(0).cast("long")})
    bucket = ["label", "size", "table", "code"]
    blocks = placed.groupBy(*bucket).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = (
        placed.join(blocks, bucket)
        .withColumn("own", F.pmod(F.xxhash64(F.lit("block"), "node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(*bucket, F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "node", "copies", "embedding")
        .repartition(*[F.col(c) for c in (*bucket, "x", "y")])
        .sortWithinPartitions(*bucket, "x", "y", "node")
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in by_group(batches, [*bucket, "x", "y"]):
            if len(group) < 2:
                continue
            i, j = block_links(group, threshold, tables, bits)
            if not len(i):
                continue
            node, copies = group.node.to_numpy(), group.copies.to_numpy()
            found = np.bincount(i, weights=copies[j], minlength=len(node)) + np.bincount(j, weights=copies[i], minlength=len(node))
            some = np.flatnonzero(found)
            yield pd.DataFrame({"a": node[some], "b": pd.NA, "n": found[some].astype(np.int64)}).astype({"b": "Int64"})
            tree = forest(len(node), i, j)
            yield pd.DataFrame({"a": node[[p for p, _ in tree]], "b": pd.array(node[[q for _, q in tree]], dtype="Int64"), "n": 0})

    found = cut(dealt.mapInPandas(compare, "a long, b long, n long"))
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    roots = components(found.where("b IS NOT NULL").select("a", "b"))
    of_class = classes.select("node", "copies").join(counts, "node", "left").join(roots, "node", "left")
    named = rows.select("vec_id", "node").join(of_class, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.where("root IS NOT NULL").groupBy("root").agg(F.min("vec_id").alias("least"))
    links = F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).alias("n_links")
    out = named.join(least, "root", "left").select("vec_id", links, F.coalesce("least", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
