"""Scoring texts with a language model.

A causal self-attention model over subword ids is trained in numpy; a document is cut
into overlapping windows, each scoring its second half once with the first half as
context.  The model scores the document's words, lower-cased, followed by one end: a
word's probability is that of its subwords and of ending there.  It is interpolated
with the words' relative frequencies over all training documents: ``SHARE`` of the
first, the rest of the second.

All is learned from every training document's whole text.  Documents are dealt to blocks
of so many characters, and a block's texts are read once, into numbers of words and the
words' vocabulary ids; what follows works on these.  Subwords of all training texts are
counted by an aggregate, and the most frequent are the model's symbols.  The model begins
on a bounded part of the training texts, since models trained apart can only be averaged
if they began alike, and is then trained on all of them in rounds: each block trains from
the model so far, and the models of a round are averaged, a few at a time.

Counts of all words of all training documents are exact and never on one machine: each
block counts its own words and sends them, sorted and packed, to parts by ranges of their
hashes; a part adds up its words and answers every block with the totals in the block's
own order.  A word has one row of 12 bytes a block, however often it occurs.

Defined results: null text counts as empty and has the end alone; with no training
document all counts are 0; repeated rows repeat and count in training each time, a null
id is an id; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovespark.llm.attention import STRIDE, Attention, keep_memory
from grovespark.llm.common import removed, shared_folder, stored
from grovespark.llm.shingles import scan_words, word_hashes

#: Characters of a block, about, and so many are hashed at once; words that a part adds up, about.
BLOCK_CHARS = 4_000_000
HASH_CHARS = 100_000
PART_WORDS = 2_000_000
#: Characters of a passage, and of a symbol, about: the measures of what training takes at once.
PASSAGE, SYMBOL = 1500, 3
#: The model begins on about so many passages; then blocks are trained on, by so many at most at once, in so many rounds.
BEGIN, EACH, ROUNDS = 2000, 8000, 2
EPOCHS, LATER_RATE, BATCH = 6, 0.003, 256
#: The model's subwords beside the 256 bytes.
SUBWORDS = 1000
#: Weight of the attention model against word frequencies.
SHARE = 0.6
#: What separates words.
BLANKS = re.compile(r"[\x20\x09-\x0D]+")
#: The end's key among word hashes.
END_KEY = np.uint64(0x656E64)
SMOOTH = 0.1


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


class Subwords:
    """Words to symbols of the model: frequent subwords as they are, others by their bytes."""

    def __init__(self, ranks: dict[bytes, int], frequent: list[int]):
        self.ranks, self.encoding = ranks, None
        of_id = {i: b for b, i in ranks.items()}
        self.end = 256 + len(frequent)
        symbol = {i: 256 + k for k, i in enumerate(frequent)}
        parts = [[symbol[i]] if i in symbol else list(of_id.get(i, b"")) for i in range(max(of_id) + 1)]
        self.size = np.array([len(x) for x in parts])
        self.flat = np.array([s for x in parts for s in x], dtype=np.int32)
        self.offset = np.cumsum(self.size) - self.size
        self.starts = np.array([of_id.get(i, b"")[:1] == b" " for i in range(max(of_id) + 1)])
        self.first = np.zeros(self.end + 1, dtype=bool)
        self.first[[32, self.end]] = True
        self.first[256 : self.end] = self.starts[frequent]

    def ids(self, words: str) -> np.ndarray:
        """Vocabulary ids of words that each have a space before."""
        if self.encoding is None:
            import tiktoken

            self.encoding = tiktoken.Encoding("words", pat_str=" [^ ]*", mergeable_ranks=self.ranks, special_tokens={})
        return np.asarray(self.encoding.encode_to_numpy(words), dtype=np.int64) if words else np.zeros(0, dtype=np.int64)

    def pieces(self, ids: np.ndarray, n: int) -> np.ndarray:
        """How many of the ids each of n words has."""
        return np.bincount(np.cumsum(self.starts[ids]) - 1, minlength=n)

    def symbols(self, ids: np.ndarray, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All symbols of words in order, and how many each word has."""
        size = self.size[ids]
        total = np.r_[0, np.cumsum(size)]
        return self.flat[ragged(self.offset[ids], size)], np.diff(total[np.r_[0, np.cumsum(pieces)]])


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indexes start, start + 1, ... of every run, one after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def slices(texts: list[str | None], chars: int = HASH_CHARS) -> Iterator[list[str | None]]:
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop] or "") <= chars):
            size += len(texts[stop] or "")
            stop += 1
        yield texts[at:stop]
        at = stop


def layout(symbols: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents as rows of ``STRIDE`` tokens: rows, which rows have no context, places whose next token counts, place of each document.

    Each document is the end as a start sign, its symbols, and the end; it begins a
    row of its own, so its score doesn't depend on what else is in the block.
    """
    rows = -(-(sizes + 2) // STRIDE)
    start = (np.cumsum(rows) - rows) * STRIDE
    flat = np.full(int(rows.sum()) * STRIDE, end, dtype=np.int32)
    flat[ragged(start + 1, sizes)] = symbols
    known = np.zeros(len(flat), dtype=bool)
    known[ragged(start, sizes + 1)] = True
    alone = np.zeros(len(flat) // STRIDE, dtype=bool)
    alone[start // STRIDE] = True
    return flat.reshape(-1, STRIDE), alone, known, start


def indexed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, str]:
    """Number of each word among the distinct ones, words of each text, the distinct words' keys, ascending, and the words with a space before each."""
    scanned, at = [], 0
    for part in slices(texts):
        flat, heads, *rest = scan_words(part)
        scanned.append((flat, heads + at, *rest))
        at += len(flat)
    if not scanned:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), ""
    flat, heads, length, hashes, counts = map(np.concatenate, zip(*scanned, strict=True))
    order = np.argsort(hashes)
    keys = hashes[order]
    new = np.r_[True, keys[1:] != keys[:-1]][: len(keys)]
    word = np.empty(len(keys), dtype=np.int64)
    word[order] = np.cumsum(new) - 1
    place = order[new]
    begin, size = heads[place] - 1, length[place] + 1
    data = np.r_[flat, np.uint8(32)][ragged(begin, size)]  # a word at the very begin has no byte before it; -1 is the last
    data[np.cumsum(size) - size] = 32
    return word, counts, keys[new], data.tobytes().decode()


#: What is kept of a block's documents, in the order of ``row``: ids; held out 1, null id 2; times; words; then
#: the number of each word among the block's distinct ones, and these words' vocabulary ids, how many each has, and
#: their order by key, the end as the last word; ids that occur in training texts, and how often.
KEPT = {"doc_id": "<i8", "flags": "u1", "times": "<i8", "counts": "<i8", "word": "<u4", "ids": "<u4", "pieces": "<u4", "order": "<u4", "used": "<u4", "often": "<i8"}


def packed(x: np.ndarray) -> bytes:
    """Compressed, all first bytes of the numbers together, then all second ones; behind the number of bytes."""
    data = np.ascontiguousarray(x.view("u1").reshape(len(x), x.itemsize).T).tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpacked(row: object) -> dict[str, np.ndarray]:
    """The columns of ``KEPT`` that ``row`` has."""
    found = {}
    for k, kind in KEPT.items():
        if (cell := getattr(row, k, None)) is not None:
            data = np.frombuffer(pa.decompress(cell[8:], int.from_bytes(cell[:8], "little"), codec="zstd", asbytes=True), dtype="u1")
            found[k] = np.ascontiguousarray(data.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()
    return {k: v if k in ("flags", "word") else v.astype(np.int64) for k, v in found.items()}


def read(dealt: DataFrame, ranks: dict[bytes, int], parts: int) -> DataFrame:
    """Every block's texts as numbers: a row of ``KEPT`` whose part is -1, and for each part the block's words and how often they are in its training documents."""
    shared = dealt.sparkSession.sparkContext.broadcast(Subwords(ranks, []))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        keep_memory()
        rows = rows.sort_values("row", kind="stable")
        whole, learn = shared.value, np.where(rows.held_out.to_numpy(dtype=bool), 0, rows.times)
        word, counts, keys, written = indexed(rows.text.tolist())
        n = np.zeros(len(keys) + 1, dtype=np.int64)
        np.add.at(n, word, np.repeat(learn, counts))
        n[-1] = learn.sum()
        ids = whole.ids(written)
        pieces = whole.pieces(ids, len(keys))
        often = np.zeros(len(whole.size), dtype=np.int64)
        np.add.at(often, ids, np.repeat(n[:-1], pieces))
        used, keys = np.flatnonzero(often), np.r_[keys, END_KEY]
        order = np.argsort(keys)
        kept = {
            "doc_id": rows.doc_id, "flags": rows.held_out.to_numpy(dtype=bool) + 2 * rows.no_id.to_numpy(dtype=bool), "times": rows.times, "counts": counts,
            "word": word, "ids": ids, "pieces": pieces, "order": order, "used": used, "often": often[used],
        }
        keys, n = keys[order], n[order]
        n = n.astype("<u4" if n.max() < 2**32 else "<u8")
        edge = np.searchsorted(part_of(keys, parts), np.arange(parts + 1))
        some = np.flatnonzero(np.diff(edge))
        ends = list(zip(edge[some], edge[some + 1], strict=True))
        packets = pd.DataFrame({"part": some, "words": [keys[a:b].tobytes() for a, b in ends], "n": [n[a:b].tobytes() for a, b in ends]})
        texts = pd.DataFrame({"part": [-1], **{k: [packed(np.asarray(v).astype(KEPT[k]))] for k, v in kept.items()}})
        return pd.concat([texts, packets]).assign(block=rows.block.iloc[0]).astype(object).replace({np.nan: None})

    docs = dealt.select("block", "row", F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "held_out", "times", "text")
    return docs.groupBy("block").applyInPandas(run, "block int, part int, words binary, n binary, " + ", ".join(f"{k} binary" for k in KEPT))


def subword_counts(blocks: DataFrame, size: int) -> np.ndarray:
    """How often each id of a vocabulary of ``size`` occurs in the training documents of all blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for row in map(unpacked, batch.itertuples()):
                total[row["used"]] += row["often"]
        some = np.flatnonzero(total)
        yield pd.DataFrame({"id": some, "n": total[some]})

    often = np.zeros(size)
    # one row a vocabulary id at most
    for r in blocks.select("used", "often").mapInPandas(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        often[r.id] = r.n
    return often


def lessons(block: dict[str, np.ndarray], subwords: Subwords, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Training documents of a block as rows of tokens, which have no context, the weights of all places' next tokens, and the number of rows.

    A document that stands for many equal ones weighs as many.  Its rows are repeated, up
    to as many as a block has, and the rest is the weight of each, so that steps meet it evenly.
    With ``most`` only so many rows are made, of each document once; the number stays that of all.
    """
    learn, counts = block["flags"] % 2 == 0, block["counts"]
    flat, length = subwords.symbols(block["ids"], block["pieces"])
    word, counts, times = block["word"][np.repeat(learn, counts)], counts[learn], block["times"][learn]
    size = length[word]
    sizes = np.diff(np.r_[0, np.cumsum(size)][np.r_[0, np.cumsum(counts)]])
    rows = -(-(sizes + 2) // STRIDE)
    repeats = np.minimum(times, np.maximum(1, BLOCK_CHARS // (SYMBOL * STRIDE) // rows))
    n = int((rows * repeats).sum())
    if most is not None:
        stop = int(np.searchsorted(np.cumsum(rows), most)) + 1
        rows, sizes, times, repeats = rows[:stop], sizes[:stop], times[:stop], np.ones(len(rows[:stop]), dtype=np.int64)
        word = word[: int(counts[:stop].sum())]
        size = length[word]
    ids, alone, known, start = layout(flat[ragged((np.cumsum(length) - length)[word], size)], sizes, subwords.end)
    weights = (known.reshape(ids.shape) * np.repeat(times / repeats, rows)[:, None]).astype(np.float32)
    if (repeats > 1).any():
        order = ragged(np.repeat(start // STRIDE, repeats), np.repeat(rows, repeats))
        ids, alone, weights = ids[order], alone[order], weights[order]
    return ids[:most], alone[:most], weights[:most], n


def averaged(found: DataFrame, groups: int) -> bytes | None:
    """The mean of all models in ``found`` (place, n, weights), by n; a few are added up at a time, so that no task and not the driver has all."""

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(w, dtype=np.float32).astype(np.float64) * n for w, n in zip(part.weights, part.n, strict=True))
        return pd.DataFrame({"place": [int(part.place.iloc[0]) // 16], "n": [int(part.n.sum())], "weights": [(total / part.n.sum()).astype(np.float32).tobytes()]})

    while groups > 1:
        found = found.groupBy(F.floor(F.col("place") / 16)).applyInPandas(add, found.schema)
        groups = -(-groups // 16)
    last = found.collect()
    return last[0].weights if last else None


def begun(blocks: DataFrame, subwords: Subwords, begin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """About ``begin`` passages from the first training documents of all blocks, each once, as of ``lessons``; the number of rows of tokens that training has in all."""
    shared = blocks.sparkSession.sparkContext.broadcast(subwords)
    share = -(-begin * PASSAGE // (SYMBOL * STRIDE) // max(1, blocks.count()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep_memory()
        for batch in batches:
            for row in batch.itertuples():
                ids, alone, weights, n = lessons(unpacked(row), shared.value, share)
                yield pd.DataFrame({"block": [row.block], "n": [n], "ids": [ids.astype("<i4").tobytes()], "alone": [alone.tobytes()], "known": [(weights > 0).tobytes()]})

    columns = ["block", "flags", "times", "counts", "word", "ids", "pieces"]
    found = blocks.select(*columns).mapInPandas(run, "block int, n long, ids binary, alone binary, known binary").collect()
    found.sort(key=lambda r: r.block)
    ids, alone, known = (np.frombuffer(b"".join(r[k] for r in found), dtype=kind) for k, kind in (("ids", "<i4"), ("alone", bool), ("known", bool)))
    return ids.reshape(-1, STRIDE), alone, known.reshape(-1, STRIDE).astype(np.float32), sum(r.n for r in found)


def train(blocks: DataFrame, ranks: dict[bytes, int], begin: int | None = None, epochs: int | None = None) -> tuple[Subwords, Attention]:
    """Fit on the training documents of all blocks; begins with ``epochs`` over about ``begin`` passages (else ``EPOCHS``, ``BEGIN``)."""
    often = subword_counts(blocks, max(ranks.values()) + 1)
    frequent = [i for i in np.lexsort((np.arange(len(often)), -often))[:SUBWORDS].tolist() if often[i]]
    subwords = Subwords(ranks, frequent)
    first, alone, known, rows = begun(blocks, subwords, begin or BEGIN)
    use = np.zeros(subwords.end + 1)
    use[256 : subwords.end] = often[frequent]
    for i in np.setdiff1d(np.flatnonzero(often), frequent).tolist():
        np.add.at(use, subwords.flat[subwords.offset[i] : subwords.offset[i] + subwords.size[i]], often[i])
    use[subwords.end] = max(1, rows)
    model = Attention(subwords.first, use)
    model.fit(first, alone, known, epochs or EPOCHS, BATCH // 2)
    groups = 1 + (blocks.agg(F.max("block")).first()[0] or 0) // ROUNDS
    for turn in range(ROUNDS if rows > len(first) else 0):
        shared = blocks.sparkSession.sparkContext.broadcast((subwords, model))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            keep_memory()
            words, start = shared.value  # noqa: B023
            each = max(1, EACH * PASSAGE // (SYMBOL * STRIDE))
            for batch in batches:
                for row in batch.itertuples():
                    ids, alone, weights, _ = lessons(unpacked(row), words)
                    n, total = 0, 0
                    for a in range(0, len(ids), each):
                        at, own = slice(a, a + each), start.unpacked(start.packed())
                        own.fit(ids[at], np.r_[True, alone[at][1:]], weights[at], 1, BATCH, LATER_RATE)
                        weight = max(1, int(weights[at].sum(dtype=np.float64)))
                        n, total = n + weight, total + np.frombuffer(own.packed(), dtype=np.float32).astype(np.float64) * weight
                    if n:
                        yield pd.DataFrame({"place": [row.block // ROUNDS], "n": [n], "weights": [(total / n).astype(np.float32).tobytes()]})

        own = blocks.where(F.pmod("block", F.lit(ROUNDS)) == turn).select("block", "flags", "times", "counts", "word", "ids", "pieces")
        found = averaged(own.mapInPandas(run, "place long, n long, weights binary"), groups)
        model = model.unpacked(found) if found else model
    return subwords, model


def token_scores(block: dict[str, np.ndarray], subwords: Subwords, model: Attention) -> np.ndarray:
    """Natural log probability of each token of a block's documents under the model."""
    word, counts = block["word"], block["counts"]
    flat, size = subwords.symbols(block["ids"], block["pieces"])
    offset = np.cumsum(size) - size
    out = np.zeros(len(word) + len(counts))
    last = np.cumsum(counts + 1) - 1
    at, first_word = 0, np.cumsum(counts) - counts
    while at < len(counts):  # some documents at a time, to bound the memory
        stop = max(at + 1, int(np.searchsorted(first_word, first_word[at] + 60_000)))
        own = word[first_word[at] : first_word[at] + int(counts[at:stop].sum())]
        n = counts[at:stop]
        length = size[own]
        ends = np.r_[0, np.cumsum(length)][np.cumsum(n)]
        per_doc = np.diff(np.r_[0, ends])
        ids, alone, known, start = layout(flat[ragged(offset[own], length)], per_doc, subwords.end)
        lp, begins = model.score(ids, alone)
        # the place before each token's first symbol: words of a document one after the other, then its end
        lengths = np.ones(int(n.sum()) + len(n), dtype=np.int64)
        spot = np.cumsum(n + 1) - 1
        inner = np.ones(len(lengths), dtype=bool)
        inner[spot] = False
        lengths[inner] = length
        before = np.cumsum(lengths) - lengths
        head = np.repeat(start, n + 1) + before - np.repeat(before[spot - n], n + 1)
        total = np.add.reduceat(lp[ragged(head, lengths)], before)
        total -= begins[head]
        total[inner] += begins[head[inner] + length]
        out[last[at] - counts[at] : last[stop - 1] + 1] = total
        at = stop
    return out


def dealt_to_blocks(docs: DataFrame) -> tuple[DataFrame, int]:
    """block, row, doc_id, held_out, text, times, and the number of characters.

    Equal rows would all fall into one block.  Those that fill more than a block together
    are found by counts of their hashes, few by their size, and are one row with ``times``.
    """
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    keyed = docs.withColumn("row", F.xxhash64(F.lit("block"), "doc_id", "text", "held_out"))
    sizes = keyed.groupBy("row").agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 1).alias("chars"), F.count("*").alias("n"))
    hot = stored(sizes.where((F.col("n") > 1) & (F.col("chars") > BLOCK_CHARS)).select("row"))
    columns = ["row", "doc_id", "held_out", "text"]
    dealt = keyed.select(*columns, F.lit(1).cast("long").alias("times"))
    if not hot.isEmpty():
        once = keyed.join(hot, "row", "left_semi").groupBy(*columns).agg(F.count("*").alias("times"))
        dealt = dealt.join(hot, "row", "left_anti").unionByName(once)
    return dealt.withColumn("block", F.pmod("row", F.lit(1 + chars // BLOCK_CHARS)).cast("int")), chars


def word_totals(packets: DataFrame) -> DataFrame:
    """block, part, totals: how often each word of a block is in training documents, in the order of the part's words; found, all: words of the part that are, and their sum, in one row a part."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        words = np.frombuffer(b"".join(rows.words), dtype="<u8")
        n = np.concatenate([np.frombuffer(b, dtype=f"<u{8 * len(b) // len(a)}") for a, b in zip(rows.words, rows.n, strict=True)])
        keys, code = np.unique(words, return_inverse=True)
        total = np.bincount(code, weights=n, minlength=len(keys)).astype(np.int64)
        back = np.split(total[code].astype("<u4" if total.max() < 2**32 else "<u8"), np.cumsum(rows.words.str.len().to_numpy() // 8)[:-1])
        first = np.arange(len(rows)) == 0
        return pd.DataFrame({"block": rows.block, "part": rows.part, "size": [len(x) for x in back], "totals": [x.tobytes() for x in back], "found": np.where(first, (total > 0).sum(), 0), "all": np.where(first, total.sum(), 0)})

    return packets.groupBy("part").applyInPandas(add, "block int, part int, size int, totals binary, found long, all long")


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Ranges of hashes."""
    return (((keys >> np.uint64(40)) * np.uint64(parts)) >> np.uint64(24)).astype(np.int64)


def score(docs: DataFrame, held_out: Column, path: str, text: str = "text", share: float = SHARE, begin: int | None = None, epochs: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: of every document, learning from those not held out."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    dealt, chars = dealt_to_blocks(docs)
    parts, ranks = 1 + chars // 12 // PART_WORDS, load_ranks(path)
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession)
    found = read(dealt, ranks, parts).withColumn("kind", F.when(F.col("part") < 0, "texts").otherwise("packets"))
    found.write.partitionBy("kind").parquet(folder)
    of_kind = lambda kind: spark.read.schema(found.schema).parquet(folder).where(F.col("kind") == kind)
    totals = stored(word_totals(of_kind("packets").select("block", "part", "words", "n")))
    removed(spark, f"{folder}/kind=packets")
    blocks = of_kind("texts")
    n, v = totals.agg(F.coalesce(F.sum("all"), F.lit(0)), F.coalesce(F.sum("found"), F.lit(0))).first()
    shared = docs.sparkSession.sparkContext.broadcast(train(blocks, ranks, begin, epochs))

    def run(rows: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        keep_memory()
        block = unpacked(next(rows.itertuples()))
        word, counts, order = block["word"], block["counts"], block["order"]
        told = [np.frombuffer(x, dtype=f"<u{len(x) // size}") for _, size, x in sorted(zip(back.part, back["size"], back.totals, strict=True))]
        of_key = np.zeros(len(order), dtype=np.int64)
        of_key[order] = np.concatenate(told)
        tokens = counts + 1
        key_of = np.full(int(tokens.sum()), len(order) - 1)
        is_word = np.ones(len(key_of), dtype=bool)
        is_word[np.cumsum(tokens) - 1] = False
        key_of[is_word] = word
        model = token_scores(block, *shared.value)
        known, logs = of_key > 0, np.log10(of_key + SMOOTH) - math.log10(n + SMOOTH * (v + 1))
        start = np.cumsum(tokens) - tokens
        # a word without a count has the model's share alone; taken in logarithms, which hold any word length
        log10 = np.minimum(model, 0) / math.log(10)
        seen = known[key_of]
        own = np.where(seen, np.log10(share * 10**log10 + np.maximum((1 - share) / max(n, 1) * of_key, 1e-300)[key_of]), math.log10(share) + log10)
        add = lambda x: np.add.reduceat(x, start)
        return pd.DataFrame({
            "doc_id": block["doc_id"], "no_id": block["flags"] >= 2, "held_out": block["flags"] % 2 == 1, "times": block["times"],
            "n_tokens": tokens, "n_known": add(seen.astype(np.int64)), "train_tokens": n, "base_score": add(logs[key_of]), "score": add(own),
        })

    schema = "doc_id long, no_id boolean, held_out boolean, times long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    told = blocks.select("block", "flags", "doc_id", "times", "counts", "word", "ids", "pieces", "order")
    found = told.groupBy("block").cogroup(totals.groupBy("block")).applyInPandas(run, schema)
    every = found.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("times")
    return every.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")
