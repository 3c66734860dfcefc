"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs: lines, and within a line after each word whose hash is
a multiple of ``WORDS``, so that they are short and an edit changes only those that it
touches.  The digest of a paragraph covers its bytes, blanks and case included; the
second and later paragraph of equal bytes in a text have digests of their own.  Each digest goes into three
cells of a sketch; a cell holds how many digests it got, their sum and the sum of
their check values.  The fingerprint is the number of paragraphs with the sketch of
``CELLS`` cells.

Two versions are compared by subtracting their cells: what they share cancels.  Cells
with one digest left are read, the digest is taken out of its other cells, and so on
until all differing digests are recovered.  Where cells stay filled, the difference
is too large for the sketch and both sketches are made again with twice the cells;
sizes below the difference of the two numbers of paragraphs are not tried.  The
likeness of two versions is their shared digests over all digests of either.

``versions`` compares each document with its next one.  Texts are dealt to partitions
by ranges of their order, once; the last text of each partition meets the first one
of the next in a join of as many rows as there are partitions.

Defined results: a null text counts as empty; an empty text has no paragraphs, and
two such have the likeness 1; repeated ids go by a hash of the text and the text, null ids come last;
the next of the last document is the first, so that of a lone document is itself;
other columns are ignored; an empty table gives an empty result.  A text of more than
``SCAN`` characters ends a paragraph at the first blank after each of these, too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grovespark.llm.common import batched, fresh, kept_columns, schema_of, stored
from grovespark.llm.shingles import _FACTORS, _PLACES, mix, scan_words

#: Words of a paragraph on average where lines are longer.
WORDS = 4
#: Cells of a fingerprint's sketch, in three tables.
CELLS = 15
#: Characters hashed at once.
SCAN = 2_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _parts(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > SCAN:
        ends = [p for p in (text.find(c, at + SCAN) for c in " \n") if p >= 0]
        if not ends:
            break
        yield text[at : min(ends) + 1]
        at = min(ends) + 1
    yield text[at:]


def _digests(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Digest of each paragraph and the number of paragraphs of each part."""
    data = [p.encode() for p in parts]
    raw = np.frombuffer(b" ".join(data) + b" ", dtype=np.uint8)
    size = np.fromiter(map(len, data), dtype=np.int64, count=len(data))
    begin = np.cumsum(size + 1) - size - 1
    _, heads, _, h, _ = scan_words(parts)
    line = np.flatnonzero((raw[:-1] == 10) & (raw[1:] != 10)) + 1
    starts = np.unique(np.concatenate([begin[size > 0], line, heads[1:][h[:-1] % np.uint64(WORDS) == 0] if len(heads) else line[:0]]))
    owner = np.searchsorted(begin, starts, side="right") - 1
    inside = starts < begin[owner] + size[owner]
    starts, owner = starts[inside], owner[inside]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(parts), np.int64)
    ends = np.minimum(np.r_[starts[1:], len(raw)], begin[owner] + size[owner])
    value = raw.astype(np.uint64) + np.uint64(1)
    value[begin + size] = 0
    edges = starts if starts[0] == 0 else np.r_[0, starts]
    place = np.arange(len(raw)) - np.repeat(edges, np.diff(np.r_[edges, len(raw)]))
    value *= _FACTORS[place % _PLACES] + (place // _PLACES).astype(np.uint64) * _ODD
    return mix(np.add.reduceat(value, starts) + (ends - starts).astype(np.uint64) * _ODD), np.bincount(owner, minlength=len(parts))


def digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct digests of all texts one after the other, and the number of each."""
    owners, found, parts, of, held = [], [], [], [], 0

    def scan() -> None:
        d, n = _digests(parts)
        found.append(d)
        owners.append(np.repeat(np.array(of, dtype=np.int64), n))
        parts.clear()
        of.clear()

    for k, text in enumerate(texts):
        for part in _parts(text):
            if parts and held + len(part) > SCAN:
                scan()
                held = 0
            parts.append(part)
            of.append(k)
            held += len(part)
    if parts:
        scan()
    if not found:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    d, owner = np.concatenate(found), np.concatenate(owners)
    order = np.lexsort((d, owner))
    d, owner = d[order], owner[order]
    new = np.r_[True, (d[1:] != d[:-1]) | (owner[1:] != owner[:-1])] if len(d) else np.zeros(0, bool)
    again = np.arange(len(d)) - np.maximum.accumulate(np.where(new, np.arange(len(d)), 0)) if len(d) else np.zeros(0, np.int64)
    return mix(d + again.astype(np.uint64) * _ODD), np.bincount(owner, minlength=len(texts))


def cells_of(key: np.ndarray, cells: int) -> list[np.ndarray]:
    """The cell of each key in each of the three tables."""
    third = cells // 3
    seeds = mix(np.arange(3, dtype=np.uint64) + np.uint64(cells * 3))
    return [(mix(key + seed) % np.uint64(third)).astype(np.int64) + t * third for t, seed in enumerate(seeds)]


def check_of(key: np.ndarray) -> np.ndarray:
    return mix(key ^ np.uint64(0x5BD1E995A7C3F1B7)) >> np.uint64(32)


class Sketches:
    """Sketches of several texts: count, sum of keys and sum of checks of every cell."""

    def __init__(self, count: np.ndarray, keys: np.ndarray, checks: np.ndarray):
        self.count, self.keys, self.checks = count, keys, checks

    @classmethod
    def of(cls, key: np.ndarray, sizes: np.ndarray, cells: int) -> Sketches:
        total, check = len(sizes) * cells, check_of(key)
        count, keys, checks = np.zeros(total, np.int64), np.zeros(total, np.uint64), np.zeros(total, np.uint64)
        base = np.repeat(np.arange(len(sizes)) * cells, sizes)
        for cell in cells_of(key, cells):
            count += np.bincount(base + cell, minlength=total)
            np.add.at(keys, base + cell, key)
            np.add.at(checks, base + cell, check)
        return cls(*(x.reshape(len(sizes), cells) for x in (count, keys, checks)))

    def less(self, left: np.ndarray, right: np.ndarray) -> Sketches:
        """Cells of the left texts minus those of the right ones."""
        return Sketches(self.count[left] - self.count[right], self.keys[left] - self.keys[right], self.checks[left] - self.checks[right])

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, key, sign of +1 left or -1 right) of what is recovered, and which rows are recovered whole; cells are emptied."""
        rows, cells = self.count.shape
        count, keys, checks = (x.ravel() for x in (self.count, self.keys, self.checks))
        out = []
        look = np.arange(len(count))
        while len(look):
            look = look[np.abs(count[look]) == 1]
            sign = count[look]
            key = np.where(sign > 0, keys[look], np.uint64(0) - keys[look])
            pure = check_of(key) == np.where(sign > 0, checks[look], np.uint64(0) - checks[look])
            row, key, sign = look[pure] // cells, key[pure], sign[pure]
            order = np.lexsort((key, row))
            row, key, sign = row[order], key[order], sign[order]
            if len(row):
                first = np.r_[True, (row[1:] != row[:-1]) | (key[1:] != key[:-1])]
                row, key, sign = row[first], key[first], sign[first]
                out.append((row, key, sign))
            touched, check = [], check_of(key)
            for cell in cells_of(key, cells):
                at = row * cells + cell
                np.subtract.at(count, at, sign)
                np.subtract.at(keys, at, np.where(sign > 0, key, np.uint64(0) - key))
                np.subtract.at(checks, at, np.where(sign > 0, check, np.uint64(0) - check))
                touched.append(at)
            look = np.unique(np.concatenate(touched))
        empty = ~((count != 0) | (keys != 0) | (checks != 0)).reshape(rows, cells).any(axis=1)
        parts = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]
        return *parts, empty

    def packed(self, sizes: np.ndarray) -> list[bytes]:
        """A text's number of paragraphs, and 2, 8 and 4 bytes of each cell."""
        columns = [sizes.astype("<u4")[:, None], self.count.astype("<u2"), self.keys.astype("<u8"), self.checks.astype("<u4")]
        rows = np.concatenate([np.ascontiguousarray(c).view(np.uint8).reshape(len(sizes), -1) for c in columns], axis=1)
        return [r.tobytes() for r in rows]


def recovered(key: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray, base: Sketches | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, key, sign) of all digests that only the left or only the right text of a pair has."""
    end = np.cumsum(sizes)
    pending, cells, out = np.arange(len(left)), CELLS, []
    gap = np.abs(sizes[left] - sizes[right])
    while len(pending):
        now = pending[gap[pending] <= cells]
        if len(now):
            if base is not None and cells == CELLS:
                both = base.less(left[now], right[now])
            else:
                texts, place = np.unique(np.concatenate([left[now], right[now]]), return_inverse=True)
                n = sizes[texts]
                at = np.repeat((end - sizes)[texts] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                both = Sketches.of(key[at], n, cells).less(place[: len(now)], place[len(now) :])
            row, k, sign, whole = both.peel()
            fine = whole[row]
            out.append((now[row[fine]], k[fine], sign[fine]))
            pending = np.setdiff1d(pending, now[whole], assume_unique=True)
        cells *= 2
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))


def likeness(sizes: np.ndarray, left: np.ndarray, right: np.ndarray, differing: np.ndarray) -> np.ndarray:
    """Shared digests over all, 1 where neither has any."""
    both = sizes[left] + sizes[right]
    return np.where(both == 0, 1.0, (both - differing) / np.maximum(both + differing, 1))


def chunks(rows: list[tuple[str, ...]]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about SCAN characters together."""
    begin = held = 0
    for k, row in enumerate(rows):
        held += sum(map(len, row))
        if held >= SCAN:
            yield begin, k + 1
            begin, held = k + 1, 0
    if begin < len(rows):
        yield begin, len(rows)


def fingerprint(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep``, n_paragraphs and fingerprint (binary) of every text."""
    names = kept_columns(keep, ("n_paragraphs", "fingerprint"))
    own = fresh(names, "text_")[0]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(own).to_pylist()]
            for a, b in chunks([(t,) for t in texts]):
                key, sizes = digests(texts[a:b])
                some = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*[some.column(c) for c in names], pa.array(sizes), pa.array(Sketches.of(key, sizes, CELLS).packed(sizes))], names=[*names, "n_paragraphs", "fingerprint"])

    picked = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").cast("string").alias(own))
    return batched(picked).mapInArrow(sketch, schema_of(docs, names) + "n_paragraphs long, fingerprint binary")


def compare(pairs: DataFrame, left: str, right: str, keep: tuple[str, ...]) -> DataFrame:
    """The columns of ``keep``, only_left and only_right (digests recovered from the sketches) and likeness of two texts a row."""
    added = ("only_left", "only_right", "likeness")
    names = kept_columns(keep, added)
    one, two = fresh(names, "left_", "right_")

    def peel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = list(zip(*[[t or "" for t in batch.column(c).to_pylist()] for c in (one, two)]))
            for a, b in chunks(texts):
                n = b - a
                key, sizes = digests([t for row in texts[a:b] for t in row])
                at = np.arange(0, 2 * n, 2)
                pair, k, sign = recovered(key, sizes, at, at + 1)
                order = np.lexsort((k, pair))
                pair, k, sign = pair[order], k[order].view(np.int64), sign[order]
                lists = [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(pair[sign == s], minlength=n))].astype(np.int32)), pa.array(k[sign == s])) for s in (1, -1)]
                near = likeness(sizes, at, at + 1, np.bincount(pair, minlength=n))
                some = batch.slice(a, n)
                yield pa.RecordBatch.from_arrays([*[some.column(c) for c in names], *lists, pa.array(near)], names=[*names, *added])

    picked = pairs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{left}`").cast("string").alias(one), F.col(f"`{right}`").cast("string").alias(two))
    return batched(picked).mapInArrow(peel, schema_of(pairs, names) + "only_left array<long>, only_right array<long>, likeness double")


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by the beginning of the following text."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, n_paragraphs long, n_differing long"
RESULT_NAMES = [c.split()[0] for c in RESULT.split(", ")]


def described(ids: list, texts: list[str], following: list[str]) -> list[pa.Array]:
    """Columns of RESULT for texts with their next texts; equal strings are hashed once."""
    changed = [edited(t, f) for t, f in zip(texts, following)]
    place: dict[str, int] = {}
    own, new, after = (np.array([place.setdefault(t, len(place)) for t in xs], dtype=np.int64) for xs in (texts, changed, following))
    key, sizes = digests(list(place))
    base = Sketches.of(key, sizes, CELLS)
    n = len(texts)
    left, right = np.r_[own, own], np.r_[new, after]
    pair, *_ = recovered(key, sizes, left, right, base)
    differing = np.bincount(pair, minlength=2 * n)
    near, packed = likeness(sizes, left, right, differing), base.packed(sizes)
    sha = [hashlib.sha256(t.encode()).hexdigest() for t in changed]
    return [
        pa.array(ids, pa.int64()), pa.array(list(map(len, texts)), pa.int64()), pa.array(sha), pa.array([packed[k] for k in own.tolist()]), pa.array([packed[k] for k in new.tolist()]),
        pa.array(near[:n]), pa.array(near[n:]), pa.array(sizes[own]), pa.array(differing[:n]),
    ]


def versions(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_paragraphs, n_differing.

    Each text's version ends in the beginning of the next document, see ``edited``.
    """
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    order = [F.col("doc_id").asc_nulls_last(), F.col("h").asc(), F.col("text").asc()]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole.alias("text")).withColumn("h", F.xxhash64("text"))
    sorted_ = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order).select("doc_id", "text")
    names = ["kind", "part", "text", *RESULT_NAMES]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None

        def end(kind: int, doc_id: int | None, text: str) -> pa.RecordBatch:
            columns = [pa.array([kind]), pa.array([part]), pa.array([text]), pa.array([doc_id], pa.int64())]
            return pa.RecordBatch.from_arrays([*columns, *[pa.nulls(1, t) for t in kinds[1:]]], names=names)

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if last is None:
                if texts:
                    yield end(1, None, texts[0])
            else:
                ids, texts = [last[0], *ids], [last[1], *texts]
            for a, b in chunks([(t,) for t in texts[:-1]]):
                out = described(ids[a:b], texts[a:b], texts[a + 1 : b + 1])
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(b - a, np.int64)), pa.array(np.full(b - a, part)), pa.nulls(b - a, pa.string()), *out], names=names)
            if texts:
                last = ids[-1], texts[-1]
        if last is not None:
            yield end(2, *last)

    found = stored(batched(sorted_).mapInArrow(walk, "kind long, part long, text string, " + RESULT))
    firsts = found.where("kind = 1").select("part", F.col("text").alias("following"))
    # one row a partition: the next one that holds rows, after the last the first
    by_part = Window.orderBy("part")
    after = firsts.select("part").select("part", F.coalesce(F.lead("part").over(by_part), F.first("part").over(by_part)).alias("next_part"))
    lasts = found.where("kind = 2").select("part", "doc_id", "text").join(after, "part").join(firsts.withColumnRenamed("part", "next_part"), "next_part")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(described(*(batch.column(k).to_pylist() for k in range(3))), names=RESULT_NAMES)

    closed = lasts.select("doc_id", "text", "following").mapInArrow(close, RESULT)
    return found.where("kind = 0").select(*RESULT_NAMES).unionByName(closed)
