"""N-gram Jaccard join by universe-partition pigeonhole.

Two sets of s elements together link only if their symmetric difference is at most
H = floor(s * (1 - t) / (1 + t)) for a threshold t.  Per size band the universe of
hashes is cut into segments.  What a set has in a segment is indexed as it is (it must
be equal, so one difference spoils it), and for the first few segments of a band also
with everything one deletion away (two differences must fall there to spoil it).  Empty
segments, which many sets share by chance, are skipped.  A band has so many segments
that whatever H differences spoil, linking sets still share K index entries.  How many
segments have deletions, and how many spare ones make up for empty ones, is chosen per
band by cost: entries written against meetings over shingles that unrelated texts have
as well.  A set with so many empty segments that K entries are not certain is a
misfit; a pair is safe if one of the two fits, and misfits meet each other in an index
of their own, over the first n - ceil(t * n) + 1 shingles in the order of the hashes, of
which linking sets have one in common.  Documents index under their own band and the
one below, since linking sizes lie in the same or neighbouring bands.

So a class (the texts of one set) that shares fewer than K entries of a band with other
classes links with none there, and goes; texts that merely share a passage mostly end
here.  The rest is joined over the entries that they share: each entry connects its
classes with its smallest one, hence stars and not all pairs.  Within a chunk of text
an entry of several classes is known to be shared and one row stands for it, so at most
one row a chunk is in an entry wherever rows of an entry meet in one task.  Classes that share enough
within their chunk are sure to stay: they are linked with one such class of the entry
there and then, as pairs of classes, whatever the number of entries.

Hashes are 64 bits, classes 46 bits until they are verified, entries 14 bits more than
their number takes; equal codes of different classes or entries only add candidates
(a pair of classes of one code is lost, with a chance of 2^-46).  Entries travel packed,
sorted within a chunk, as gaps.

Connected candidates are then verified exactly, all against all inside a task, in
blocks of bounded size: a component of any size is cut into blocks and every two
blocks meet.  Tasks give back a spanning forest of the true links and not the pairs.
Components of more than ``MANY_BLOCKS`` blocks are refined first, and exactly so.  A link needs an
intersection of at least t times either set, so a class with fewer shingles in other
classes of its component links with none and leaves.  Of linking sets sorted by one
order, the first s - ceil(t * s) + 1 shingles of both have one in common; the order is
rarest in the component first, and only classes that share such a shingle stay together.

Defined results: null, empty and blank texts have the empty set and stand alone;
texts of fewer than ``width`` words have one shingle; repeated doc_ids are
rows of their own, and so are rows of a null doc_id (a group of null ids alone has a null
component_id); other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovespark.llm.common import batched, cut, stored
from grovespark.llm.components import components
from grovespark.llm.shingles import mix, set_keys, shingle_sets

CHUNK_CHARS = 2_000_000
#: Shingles and classes that one block of a verification holds.
BLOCK_SHINGLES = 1_000_000
BLOCK_CLASSES = 2048
#: Components of more blocks than this are refined before all their classes meet.
MANY_BLOCKS = 16
#: Entries that one part of the index holds, about.
PART_ENTRIES = 1_000_000
CHUNK_ROWS = 50_000
#: Bits of a class while candidates are found; two more tell under which scheme an entry is.
CLASS_BITS = 46
LOW = np.uint64((1 << CLASS_BITS) - 1)
#: Entries that candidates share, as a part of the differences that a link may have.
ASKED = 0.15
#: What a chance meeting costs against writing an index entry, and the part of a text's shingles that unrelated texts have as well.
MEETING_COST, COMMON = 20.0, 0.1
#: Schemes of an entry: the set's own band, the band below it, misfits of either.
OWN, BELOW, MISFIT = 0, 1, 2
#: Ids up to this many (16 bytes each) are broadcast; beyond it the join shuffles.
BROADCAST_IDS = 1_000_000


def bands(percent: int, largest: int = 1 << 40) -> np.ndarray:
    """Smallest size of each band; sizes of linking sets lie in one band or two neighbouring ones."""
    low, out = 1, []
    while low <= largest:
        out.append(low)
        low = max(low, low * 100 // percent) + 1
    return np.array(out, dtype=np.int64)


@dataclass(frozen=True)
class Plan:
    """Per band: its smallest size, differences of a link at most, segments, how many of them also with deletions, and entries that links share at least."""

    low: np.ndarray
    differences: np.ndarray
    segments: np.ndarray
    loose: np.ndarray
    asked: np.ndarray


def allocate(percent: int, asked: float | None = None) -> Plan:
    """The cheapest choice per band."""
    low = bands(percent)
    differences, segments, loose, need = (np.zeros(len(low), dtype=np.int64) for _ in range(4))
    for s in range(len(low) - 1):
        high = int(low[s + 1]) - 1
        h = (high + high * 100 // percent) * (100 - percent) // (100 + percent)
        if h == 0:  # only equal sets link
            continue
        k = max(1, int((ASKED if asked is None else asked) * (h + 1)))
        d = np.arange(min(h + k, 300) + 1, dtype=float)
        m = h + k - d
        for _ in range(8):  # spare segments for empty ones, and for those too small for deletions to count
            mean = low[s] / np.maximum(m, 1)
            lacking = (m + d * mean) * np.exp(-mean)
            m = h + k + np.floor(lacking + 1.5 * np.sqrt(lacking)) - d
        mean = low[s] / np.maximum(m, 1)
        met = (m + d * mean) * (np.exp(-mean * (1 - COMMON)) - np.exp(-mean))
        cost = np.where(m >= np.maximum(d, 1), m + d * mean + MEETING_COST * met, np.inf)
        best = int(cost.argmin())
        differences[s], segments[s], loose[s], need[s] = h, m[best], d[best], k
    return Plan(low, differences, segments, loose, need)


@dataclass
class Cut:
    """Sets cut into the segments of one scheme: for each set its segments, for each element its place, for each segment its set, number and elements."""

    scheme: np.ndarray
    m: np.ndarray
    at: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    edge: np.ndarray
    of: np.ndarray
    number: np.ndarray
    held: np.ndarray
    double: np.ndarray


def cut_sets(flat: np.ndarray, sizes: np.ndarray, plan: Plan, below: int) -> Cut:
    """By the set's own band or the band ``below`` it; segments are ranges of hashes, so sorted sets fall into slices."""
    scheme = np.searchsorted(plan.low, sizes, side="right") - 1 - below
    m = np.where(scheme >= 0, plan.segments[np.maximum(scheme, 0)], 0)
    scheme = np.maximum(scheme, 0)
    base = np.cumsum(m) - m
    at = np.flatnonzero(np.repeat(m > 0, sizes))
    owner = np.repeat(np.arange(len(sizes)), sizes)[at]
    place = base[owner] + (((flat[at] >> np.uint64(32)) * m[owner].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
    edge = np.searchsorted(place, np.arange(int(m.sum()) + 1))
    of = np.repeat(np.arange(len(sizes)), m)
    number, held = np.arange(len(of)) - np.repeat(base, m), np.diff(edge)
    return Cut(scheme, m, at, owner, place, edge, of, number, held, (held >= 2) & (number < plan.loose[scheme[of]]))


def misfits(c: Cut, plan: Plan) -> np.ndarray:
    """Which sets may share fewer entries with a linking set than their band asks for."""
    twice = np.bincount(c.of, c.double, minlength=len(c.m))
    once = np.bincount(c.of, (c.held > 0) & ~c.double, minlength=len(c.m))
    h = plan.differences[c.scheme]
    # the most that h differences spoil: segments without deletions first
    left = np.where(h <= once, once + twice - h, twice - (h - once) // 2)
    return (c.m > 0) & (left < plan.asked[c.scheme])


def index_entries(flat: np.ndarray, sizes: np.ndarray, plan: Plan, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, number of the set, scheme) for sorted sets that follow each other in ``flat``."""
    element = mix(flat + np.uint64(0x2545F491))
    start = np.cumsum(sizes) - sizes
    found = [(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), 0)]
    for below in (OWN, BELOW):
        c = cut_sets(flat, sizes, plan, below)
        if not c.m.any():
            continue
        prefix = np.r_[np.uint64(0), np.cumsum(element[c.at])]
        subset = prefix[c.edge[1:]] - prefix[c.edge[:-1]]
        tag = mix((c.scheme[c.of].astype(np.uint64) << np.uint64(40)) + c.number.astype(np.uint64))
        some, near = c.held > 0, c.double[c.place]
        found.append((mix(subset ^ tag)[some], c.of[some], below))
        g = c.place[near]
        found.append((mix((subset[g] - element[c.at[near]]) ^ tag[g]), c.owner[near], below))
        odd = np.flatnonzero(misfits(c, plan))
        if len(odd):
            first = sizes[odd] - -(-sizes[odd] * percent // 100) + 1
            at = np.repeat(start[odd] - (np.cumsum(first) - first), first) + np.arange(int(first.sum()))
            of = np.repeat(odd, first)
            found.append((mix(element[at] ^ mix(c.scheme[of].astype(np.uint64) + np.uint64(0xC0FFEE))), of, MISFIT))
    return np.concatenate([e for e, _, _ in found]), np.concatenate([n for _, n, _ in found]), np.concatenate([np.full(len(e), k) for e, _, k in found])


def chunks(batches: Iterator[pd.DataFrame], text: str, chars: int = CHUNK_CHARS) -> Iterator[pd.DataFrame]:
    """The rows in frames of about so many characters, whatever the batches are."""
    held, size = [], 0
    for batch in batches:
        length = batch[text].str.len().fillna(0).to_numpy()
        start = 0
        for i, n in enumerate(length):
            if (size and size + n > chars) or i - start >= CHUNK_ROWS:
                held.append(batch.iloc[start:i])
                if any(map(len, held)):
                    yield pd.concat(held)
                held, size, start = [], 0, i
            size += n
        held.append(batch.iloc[start:])
    if any(map(len, held)):
        yield pd.concat(held)


def classes_of(docs: DataFrame, width: int, plan: Plan, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, class key (null for the empty set) and size band."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in chunks(batches, text):
            flat, sizes = shingle_sets(chunk[text].tolist(), width)
            keys = pd.Series(set_keys(flat, sizes).view(np.int64), dtype="Int64", index=chunk.index)
            keys[sizes == 0] = pd.NA
            yield pd.DataFrame({"doc_id": chunk.doc_id.astype("Int64"), "n_shingles": sizes, "class": keys, "band": np.searchsorted(plan.low, sizes, side="right") - 1})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInPandas(run, "doc_id long, n_shingles long, class long, band int")


def narrow(column: np.ndarray, width: int) -> bytes:
    """The lower ``width`` bytes of each number."""
    return np.ascontiguousarray(column).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def widen(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(data, dtype=np.uint8).reshape(-1, width)
    return out.reshape(-1).view(np.uint64)


#: Stands for no class: a row that only bridges a gap too wide for its bytes.
NONE = np.uint64((1 << 48) - 1)


def pack_rows(entries: np.ndarray, codes: np.ndarray, width: int) -> bytes:
    """Rows sorted by entry: the first entry, gaps of ``width`` bytes, codes of six bytes."""
    gap, most = np.diff(entries, prepend=entries[:1]), np.uint64((1 << 8 * width) - 1)
    bridges = (gap // most).astype(np.int64)
    if bridges.any():
        at = np.cumsum(bridges + 1) - 1
        gaps, coded = np.full(int(at[-1]) + 1, most), np.full(int(at[-1]) + 1, NONE)
        gaps[at], coded[at] = gap % most, codes
        gap, codes = gaps, coded
    return entries[:1].tobytes() + narrow(gap, width) + narrow(codes, 6)


def unpack_rows(data: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    n = (len(data) - 8) // (width + 6)
    codes = widen(data[8 + n * width :], 6)
    entries = np.frombuffer(data, dtype=np.uint64, count=1) + np.cumsum(widen(data[8 : 8 + n * width], width))
    return entries[codes != NONE], codes[codes != NONE]


def pack(*columns: np.ndarray) -> bytes:
    """48 bits of each number, column by column."""
    return b"".join(narrow(c, 6) for c in columns)


def unpack(packets: pd.Series, columns: int) -> list[np.ndarray]:
    parts = [widen(x, 6).reshape(columns, -1) for x in packets]
    return list(np.concatenate([np.zeros((columns, 0), dtype=np.uint64), *parts], axis=1))


def dealt_out(part: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The rows of each part, in their order."""
    order = np.argsort(part, kind="stable")
    part, columns = part[order], [c[order] for c in columns]
    cuts = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, len(part)].tolist() if len(part) else []
    for x, y in zip(cuts, cuts[1:], strict=False):
        yield int(part[x]), [c[x:y] for c in columns]


def shared_by_several(entries: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Which rows, sorted by entry, are in an entry with another class."""
    if not len(entries):
        return np.zeros(0, dtype=bool)
    new = np.r_[True, entries[1:] != entries[:-1]]
    begin, classes = np.flatnonzero(new), codes >> np.uint64(2)
    return (np.minimum.reduceat(classes, begin) != np.maximum.reduceat(classes, begin))[np.cumsum(new) - 1]


def local_stars(entries: np.ndarray, local: np.ndarray, classes: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows of one chunk, sorted by entry: which go to meet other chunks, which of these stand for others, which of these are sure to stay, which are told as they are; and pairs (row, its star's class) of those sure to stay."""
    several = shared_by_several(entries, classes << np.uint64(2))
    sure = np.bincount(local[several], minlength=len(need)) >= need
    sure_row = sure[local] & several
    new = np.r_[True, entries[1:] != entries[:-1]][: len(entries)]
    begin, group = np.flatnonzero(new), np.cumsum(new) - 1
    none = np.uint64(2**63)
    star = np.minimum.reduceat(np.where(sure_row, classes, none), begin)[group] if len(entries) else classes
    headed, head = star != none, sure_row & (classes == star)
    open_group = np.bincount(group, several & ~sure_row, minlength=len(begin))[group] > 0 if len(entries) else several
    stands = (several & ~headed & new) | head
    pairs = np.flatnonzero(sure_row)
    _, once = np.unique(np.stack([local[pairs].astype(np.uint64), star[pairs]], axis=1), axis=0, return_index=True)
    pairs = pairs[once]
    told = several & (~sure_row | (head & open_group))
    return ~several | stands, stands, head, told, np.stack([pairs.astype(np.uint64), star[pairs]], axis=1)


def shared_entries(docs: DataFrame, width: int, percent: int, plan: Plan, shingles: int, text: str = "text") -> DataFrame:
    """entry, code (46 bits of the class and the scheme), star.

    Rows with an entry: several classes share it; they may repeat.  Rows without: the
    code shares as many entries as its band asks for, and some of them with the class ``star``.
    """
    parts, bits = 1 + shingles // PART_ENTRIES, min(62, max(40, shingles.bit_length() + 14))
    gap_bytes = -(-(bits - 14) // 8)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in chunks(batches, text):
            flat, sizes = shingle_sets(chunk[text].tolist(), width)
            keys = set_keys(flat, sizes)
            first = np.zeros(len(keys), dtype=bool)
            first[np.unique(keys, return_index=True)[1]] = True
            first &= sizes > 0
            entries, number, scheme = index_entries(flat[np.repeat(first, sizes)], sizes[first], plan, percent)
            entries >>= np.uint64(64 - bits)
            order = np.argsort(entries, kind="stable")
            entries, number, scheme = entries[order], number[order], scheme[order]
            classes = (keys[first] & LOW)[number]
            codes = (classes << np.uint64(2)) | scheme.astype(np.uint64)
            band = np.searchsorted(plan.low, sizes[first], side="right") - 1
            need = np.stack([plan.asked[band], plan.asked[np.maximum(band - 1, 0)], np.ones_like(band)], axis=1)
            goes, stands, sure, told, pairs = local_stars(entries, 3 * number + scheme, classes, np.maximum(need, 1).ravel())
            part = ((entries >> np.uint64(bits - 24)) * np.uint64(parts)) >> np.uint64(24)
            packets = []
            for kind, rows in ((0, goes & ~stands), (1, stands & ~sure), (2, stands & sure), (3, told)):
                # rows known to be shared go on as they are, to parts dealt by their class
                to = part[rows] if kind < 3 else mix(codes[rows]) % np.uint64(parts)
                packets += [(p, kind, pack_rows(*x, gap_bytes)) for p, x in dealt_out(to, entries[rows], codes[rows])]
            own = codes[pairs[:, 0].astype(np.int64)]
            packets += [(p, 4, pack(*x)) for p, x in dealt_out(mix(own) % np.uint64(parts), own, pairs[:, 1])]
            for a in range(0, len(packets), 64):
                yield pd.DataFrame(packets[a : a + 64], columns=["part", "kind", "packed"])

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        none = np.zeros(0, dtype=np.uint64)
        rows = [[unpack_rows(x, gap_bytes) for x in group.packed[group.kind == k]] for k in range(4)]
        entries, codes = (np.concatenate([none, *[x[i] for k in range(3) for x in rows[k]]]) for i in (0, 1))
        kind = np.repeat(np.arange(3), [sum(len(x[0]) for x in rows[k]) for k in range(3)])
        order = np.argsort(entries, kind="stable")
        entries, codes, kind = entries[order], codes[order], kind[order]
        new = np.r_[True, entries[1:] != entries[:-1]][: len(entries)]
        known = np.bincount(np.cumsum(new) - 1, kind > 0)[np.cumsum(new) - 1] > 0 if len(entries) else new
        several = shared_by_several(entries, codes)
        anew = ((kind == 0) & (several | known)) | ((kind == 2) & several)
        done = [np.concatenate([none, *[x[i] for x in rows[3]]]) for i in (0, 1)]
        own, star = unpack(group.packed[group.kind == 4], 2)
        found = np.r_[entries[anew], done[0]].view(np.int64)
        pad = lambda a, before, after: pd.array(np.r_[np.zeros(before, np.int64), a, np.zeros(after, np.int64)], dtype="Int64")
        entry, of = pad(found, 0, len(own)), pad(star.view(np.int64), len(found), 0)
        entry[len(found) :], of[: len(found)] = pd.NA, pd.NA
        return pd.DataFrame({"entry": entry, "code": np.r_[codes[anew], done[1], own].view(np.int64), "star": of})

    packets = docs.select(text).mapInPandas(run, "part int, kind int, packed binary")
    return packets.groupBy("part").applyInPandas(meet, "entry long, code long, star long")


def candidates(shared: DataFrame, members: DataFrame, plan: Plan) -> DataFrame:
    """a, b: classes (46 bits) that share as many entries with others as their band asks for, each linked with the smallest of an entry."""
    asked = F.array(*[F.lit(int(x)) for x in plan.asked])
    band_of = members.where("class IS NOT NULL").select(F.col("class").bitwiseAND(F.lit(int(LOW))).alias("node"), "band").distinct()
    often = shared.groupBy("code").agg(F.count("entry").alias("n"), F.count("star").alias("sure"))
    often = often.select("code", F.shiftright("code", 2).alias("node"), F.col("code").bitwiseAND(F.lit(3)).alias("scheme"), "n", "sure")
    enough = (F.col("sure") > 0) | (F.col("scheme") == MISFIT) | (F.col("n") >= F.get(asked, (F.col("band") - F.col("scheme")).cast("int")))
    kept = often.join(band_of, "node").where(enough).select("code").distinct()
    rows = stored(shared.where("entry IS NOT NULL").join(kept, "code").select("entry", F.shiftright("code", 2).alias("b")))
    least = rows.groupBy("entry").agg(F.min("b").alias("a"), F.max("b").alias("most")).where("a < most").select("entry", "a")
    local = shared.where("star IS NOT NULL").select(F.col("star").alias("a"), F.shiftright("code", 2).alias("b"))
    return rows.join(least, "entry").select("a", "b").union(local).where("a != b").distinct()


def by_group(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of rows sorted by ``keys``, each whole, one at a time."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        for _, part in batch.groupby(keys, sort=False):
            if held and (held[-1][keys].iloc[-1] != part[keys].iloc[0]).any():
                yield pd.concat(held)
                held = []
            held.append(part)
    if held:
        yield pd.concat(held)


def true_links(sets: list[np.ndarray], block: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the sets; of two blocks only links across are looked at.

    Elements of many sets are counted by a matrix product, the others by their lists.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), size)
    _, code, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.zeros((n, n), dtype=np.float32)
    common = often > max(8, n // 16)
    columns = np.full(len(often), -1)
    columns[common] = np.arange(common.sum())
    at = columns[code]
    for a in range(0, int(common.sum()), 4096):
        own = (at >= a) & (at < a + 4096)
        dense = np.zeros((n, min(4096, int(common.sum()) - a)), dtype=np.float32)
        dense[owner[own], at[own] - a] = 1
        shared += dense @ dense.T
    rare = ~common[code] & (often[code] > 1)
    order = np.argsort(code[rare], kind="stable")
    owners, codes = owner[rare][order], code[rare][order]
    for step in range(1, int(often[~common].max(initial=1))):
        same = codes[step:] == codes[:-step]
        np.add.at(shared, (owners[:-step][same], owners[step:][same]), 1)
    i, j = np.nonzero(np.triu(shared, 1))
    both = shared[i, j]
    link = 100 * both >= percent * (size[i] + size[j] - both)
    if (block != block[0]).any():
        link &= block[i] != block[j]
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for a, b in zip(i[link].tolist(), j[link].tolist(), strict=True):
        if find(a) != find(b):
            root[find(b)] = find(a)
            kept.append((a, b))
    return kept


def texts_of(docs: DataFrame, chosen: DataFrame, text: str) -> DataFrame:
    """``chosen`` with the text of its doc_id; few ids are broadcast."""
    if chosen.count() <= BROADCAST_IDS:
        chosen = F.broadcast(chosen)
    return docs.select("doc_id", text).join(chosen, "doc_id")


def own_sets(chunk: pd.DataFrame, width: int, text: str) -> tuple[pd.DataFrame, list[np.ndarray]]:
    """The rows whose text is the one of their class, and their sets; rows of one doc_id may have other texts."""
    flat, sizes = shingle_sets(chunk[text].tolist(), width)
    end = np.cumsum(sizes)
    own = set_keys(flat, sizes).view(np.int64) == chunk["class"].to_numpy()
    return chunk[own], [flat[e - s : e] for e, s in zip(end[own], sizes[own], strict=True)]


def shared_shingles(rows: DataFrame, width: int, parts: int, text: str) -> DataFrame:
    """code, n: how many shingles of a class (its lower 46 bits) are also in other classes of its root, or more than that where hashes collide."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in chunks(batches, text):
            kept, sets = own_sets(chunk.drop_duplicates(["class", text]), width, text)
            if not len(kept):
                continue
            codes, size = kept["class"].to_numpy().view(np.uint64) & LOW, [len(x) for x in sets]
            shingle = mix(np.concatenate(sets) ^ np.repeat(mix(kept["root"].to_numpy().view(np.uint64) + np.uint64(1)), size))
            owner = np.repeat(np.arange(len(sets)), size)
            shingle, first, back, often = np.unique(shingle, return_index=True, return_inverse=True, return_counts=True)
            here = np.bincount(owner, often[back] > 1, minlength=len(sets)).astype(np.uint64)
            part = ((shingle >> np.uint64(40)) * np.uint64(parts)) >> np.uint64(24)
            one, rest = often == 1, often > 1
            # a shingle of several classes of the chunk counts already and goes on once
            packets = [(p, 0, pack(*x)) for p, x in dealt_out(part[one], shingle[one], codes[owner[first[one]]])]
            packets += [(p, 1, pack(*x)) for p, x in dealt_out(part[rest], shingle[rest])]
            packets += [(p, 2, pack(*x)) for p, x in dealt_out(mix(codes) % np.uint64(parts), codes, here)]
            for a in range(0, len(packets), 64):
                yield pd.DataFrame(packets[a : a + 64], columns=["part", "kind", "packed"])

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        (shingle, owner), (rest,), (codes, here) = (unpack(group.packed[group.kind == k], c) for k, c in ((0, 2), (1, 1), (2, 2)))
        _, back, often = np.unique(np.r_[shingle, rest], return_inverse=True, return_counts=True)
        code, n = np.unique(owner[often[back[: len(shingle)]] > 1], return_counts=True)
        return pd.DataFrame({"code": np.r_[code, codes].astype(np.int64), "n": np.r_[n, here].astype(np.int64)})

    packets = rows.mapInPandas(run, "part int, kind int, packed binary")
    return packets.groupBy("part").applyInPandas(meet, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def refined(docs: DataFrame, large: DataFrame, width: int, percent: int, text: str = "text") -> DataFrame:
    """doc_id, class, n, root: those of ``large`` that may link, with roots such that links are within one as before."""
    load = large.agg(F.sum("n")).first()[0] or 0
    rows = texts_of(docs, large.select("doc_id", "class", "root"), text).select("class", "root", text)
    counted = shared_shingles(rows, width, 1 + load // PART_ENTRIES, text).withColumnRenamed("n", "shared")
    left = cut(large.withColumn("code", F.col("class").bitwiseAND(F.lit(int(LOW)))).join(counted, "code").where(F.col("shared") * 100 >= F.col("n") * percent).drop("code", "shared"))

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in chunks(batches, text):
            kept, found = own_sets(chunk.drop_duplicates(["class", text]), width, text)
            yield kept[["class", "root", "n"]].assign(elements=[x.view(np.int64) for x in found])

    told = texts_of(docs, left, text).select("class", "root", "n", text).mapInPandas(sets, "class long, root long, n long, elements array<long>")
    each = cut(told).select("class", "root", "n", F.explode("elements").alias("shingle"))
    often = each.groupBy("root", "shingle").agg(F.count("*").alias("often"))
    ranked = each.join(often, ["root", "shingle"]).groupBy("class", "root", "n").agg(F.sort_array(F.collect_set(F.struct("often", "shingle"))).alias("ranked"))
    least = F.ceil(F.col("n") * percent / 100).cast("int")
    begin = cut(ranked.select("class", "root", F.explode(F.slice("ranked", F.lit(1), F.col("n").cast("int") - least + 1)).alias("x")).select("class", "root", "x.shingle"))
    heads = begin.groupBy("root", "shingle").agg(F.min("class").alias("a"))
    groups = components(begin.join(heads, ["root", "shingle"]).select("a", F.col("class").alias("b")))
    return left.drop("root").join(groups.withColumnRenamed("node", "class"), "class").select("doc_id", "class", "n", "root")


def links(docs: DataFrame, members: DataFrame, candidate: DataFrame, width: int, percent: int, text: str = "text") -> DataFrame:
    """a, b: true links that connect exactly what true links connect."""
    groups = candidate.withColumnRenamed("node", "code")
    one = members.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"))
    placed = one.withColumn("code", F.col("class").bitwiseAND(F.lit(int(LOW)))).join(groups, "code").drop("code")
    def with_blocks(placed: DataFrame) -> DataFrame:
        load = placed.groupBy("root").agg(F.sum("n").alias("load"), F.count("*").alias("classes"))
        blocks = F.greatest(F.ceil(F.col("load") / BLOCK_SHINGLES), F.ceil(F.col("classes") / BLOCK_CLASSES)).cast("int")
        return cut(placed.join(load.select("root", blocks.alias("blocks")), "root").select("doc_id", "class", "n", "root", "blocks"))

    chosen = with_blocks(placed)
    large = chosen.where(F.col("blocks") > MANY_BLOCKS).drop("blocks")
    if not large.isEmpty():
        chosen = chosen.where(F.col("blocks") <= MANY_BLOCKS).union(with_blocks(refined(docs, large, width, percent, text)))

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in chunks(batches, text):
            kept, found = own_sets(chunk, width, text)
            yield kept[["class", "root", "blocks"]].assign(elements=[x.tobytes() for x in found])

    own_block = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    meet = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = (
        texts_of(docs, chosen, text)
        .select("class", "root", "blocks", text)
        .mapInPandas(sets, "class long, root long, blocks int, elements binary")
        .withColumn("own", own_block)
        .withColumn("other", meet)
        .select("class", "root", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "elements")
        .repartition(F.col("root"), F.col("x"), F.col("y"))
        .sortWithinPartitions("root", "x", "y", "class")
    )

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in by_group(batches, ["root", "x", "y"]):
            group = group.drop_duplicates("class")
            own = group["class"].to_numpy()
            found = true_links([np.frombuffer(e, dtype=np.uint64) for e in group.elements], group.own.to_numpy(), percent) if len(own) > 1 else []
            if found:
                yield pd.DataFrame({"a": own[[a for a, _ in found]], "b": own[[b for _, b in found]]})

    return dealt.mapInPandas(verify, "a long, b long")


def join(docs: DataFrame, width: int, percent: int, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: smallest doc_id reachable over pairs with 100 * intersection >= percent * union."""
    docs, plan = batched(docs), allocate(percent)
    members = cut(classes_of(docs, width, plan, text))
    shingles = members.agg(F.sum("n_shingles")).first()[0] or 0
    shared = stored(shared_entries(docs, width, percent, plan, shingles, text))
    groups = components(candidates(shared, members, plan))
    found = components(links(docs, members, groups, width, percent, text))
    rooted = members.join(found.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = rooted.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"))
    return rooted.join(least, "root", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))
