"""Byte-level BPE encoding and decoding.

Each word of the pre-tokenized text is merged with a priority queue of merge
ranks over a doubly linked list of symbols; queue entries whose symbols have
changed since are skipped.  Decoding concatenates the vocabulary's byte strings.

Rows are independent, so the operator is a single pass without a shuffle.  The
vocabulary (fixed size, tens of thousands of entries) is read on the driver from
the path given and broadcast.

Defined results: a null text counts as empty and gives no ids (``n_tokens`` 0,
decoded text empty); the special token's string inside a text becomes the special
id, as the public library does it; repeated rows give repeated results; columns of
the input that are not asked for are ignored, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from grovespark.llm.common import batched, kept_columns, schema_of

#: The code points that count as white space, and the pattern that splits text before merging.
SPACES = [0x20, *range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
PATTERN = r"'(?:s|t|re|ve|m|ll|d)| ?{letters}+| ?{numbers}+| ?{others}+|{spaces}+(?!{visible})|{spaces}+"

#: Distinct words whose ids a task remembers; it forgets all of them when there are more.
CACHE_WORDS = 200_000
#: Characters of text whose new words are merged together.
CHUNK_CHARS = 2_500_000


def char_class(chars: str, negated: bool = False) -> str:
    return "[" + "^" * negated + "".join(f"\\u{ord(c):04x}" for c in chars) + "]"


def splitters() -> tuple:
    """Two functions text -> words: for any text, and a faster one for text of code points below 256."""
    spaces = "".join(map(chr, SPACES))
    wide = regex.compile(
        PATTERN.format(
            letters=r"\p{L}", numbers=r"\p{N}", others=char_class(spaces, True)[:-1] + r"\p{L}\p{N}]", spaces=char_class(spaces), visible=char_class(spaces, True)
        )
    )
    latin = [chr(i) for i in range(256)]
    kinds = {
        "letters": [c for c in latin if regex.match(r"\p{L}", c)],
        "numbers": [c for c in latin if regex.match(r"\p{N}", c)],
        "spaces": [c for c in latin if c in spaces],
    }
    kinds["others"] = [c for c in latin if not any(c in x for x in kinds.values())]
    narrow = re.compile(PATTERN.format(visible=char_class("".join(kinds["spaces"]), True), **{k: char_class("".join(v)) for k, v in kinds.items()}))
    return wide.findall, narrow.findall


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a vocabulary file."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def load_vocabulary(path: str) -> dict:
    """``strings``: bytes by id; ``merges``: ``left id << 32 | right id`` to ``rank << 32 | merged id``; ``special``: id by string."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    of_char, ids = byte_alphabet(), spec["model"]["vocab"]
    strings = {i: bytes(of_char[c] for c in piece) for piece, i in ids.items()}
    merges = {}
    for rank, pair in enumerate(spec["model"]["merges"]):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        merges[(ids[left] << 32) | ids[right]] = (rank << 32) | ids[left + right]
    special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    strings |= {i: s.encode() for s, i in special.items()}
    return {"strings": strings, "merges": merges, "special": special}


class Codec:
    def __init__(self, vocabulary: dict, cache_words: int = CACHE_WORDS):
        self.special, self.strings = vocabulary["special"], vocabulary["strings"]
        keys = np.array(sorted(vocabulary["merges"]), dtype=np.int64)
        self.pair_keys = keys
        self.pair_ranks = np.array([vocabulary["merges"][k] >> 32 for k in keys.tolist()], dtype=np.int64)
        by_rank = sorted((m >> 32, k >> 32, k & 0xFFFFFFFF, m & 0xFFFFFFFF) for k, m in vocabulary["merges"].items())
        self.rules = [x[1:] for x in by_rank]
        self.of_byte = np.zeros(256, dtype=np.int64)
        for i, piece in self.strings.items():
            if len(piece) == 1:
                self.of_byte[piece[0]] = i
        self.wide, self.narrow = splitters()
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.ids_of: dict[str, tuple[int, ...]] = {}
        self.written: dict[str, str] = {}
        self.limit = cache_words

    def words(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.wide(text)
        return self.narrow(text)

    def pieces(self, text: str) -> list[str]:
        """Words of the text; a special token's string is a piece of its own."""
        if self.split is None or not any(s in text for s in self.special):
            return self.words(text)
        return list(chain.from_iterable([part] if part in self.special else self.words(part) for part in self.split(text) if part))

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair of symbols, -1 where they never merge."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)

    def merge(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of each word.

        The symbols of all words form one doubly linked list, cut between words.
        A heap holds the merge ranks that are due, with the positions queued under
        each; a position counts only if the rank's pair still stands there.  A merge
        makes pairs of later ranks only, so each rank is popped once.
        """
        data = [w.encode() for w in words]
        size = np.fromiter(map(len, data), dtype=np.int64, count=len(data))
        symbols = self.of_byte[np.frombuffer(b"".join(data), dtype=np.uint8)]
        n, ends = len(symbols), np.cumsum(size)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1], before[ends - size] = -1, -1
        due: list[int] = []
        queued: dict[int, list[np.ndarray]] = {}

        def push(at: np.ndarray) -> None:
            ranks = self.ranks_of(symbols[at], symbols[after[at]])
            at, ranks = at[ranks >= 0], ranks[ranks >= 0]
            if not len(at):
                return
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for rank, lo, hi in zip(ranks[np.r_[0, cuts]].tolist(), [0, *cuts.tolist()], [*cuts.tolist(), len(at)], strict=True):
                if rank not in queued:
                    heapq.heappush(due, rank)
                    queued[rank] = []
                queued[rank].append(at[lo:hi])

        push(np.flatnonzero(after >= 0))
        while due:
            rank = heapq.heappop(due)
            left, right, merged = self.rules[rank]
            at = queued.pop(rank)
            at = at[0] if len(at) == 1 else np.unique(np.concatenate(at))
            follow = after[at]
            fresh = (symbols[at] == left) & (follow >= 0) & (symbols[follow] == right)
            if left == right and fresh.any():  # of overlapping pairs the first wins
                taken, last = [], -1
                for p, q in zip(at[fresh].tolist(), follow[fresh].tolist(), strict=True):
                    if p != last:
                        taken.append(p)
                        last = q
                at = np.array(taken, dtype=np.int64)
            else:
                at = at[fresh]
            if not len(at):
                continue
            gone = after[at]
            symbols[at], symbols[gone] = merged, -1
            then = after[gone]
            after[at] = then
            tail = then >= 0
            before[then[tail]] = at[tail]
            push(np.unique(np.concatenate([at[tail], before[at][before[at] >= 0]])))
        alive = symbols >= 0
        ids = symbols[alive].tolist()
        stop = np.cumsum(alive)[ends - 1].tolist()
        return [tuple(ids[a:b]) for a, b in zip([0, *stop], stop, strict=False)]

    def learn(self, words: set[str]) -> None:
        """Fill the memory with the ids of these words."""
        new = [w for w in words if w not in self.ids_of]
        if len(self.ids_of) + len(new) > self.limit:
            self.ids_of, self.written, new = {}, {}, list(words)
        found = self.merge([w for w in new if w not in self.special]) if new else []
        at = iter(found)
        for w in new:
            ids = (self.special[w],) if w in self.special else next(at)
            self.ids_of[w], self.written[w] = ids, ",".join(map(str, ids)) + ","

    def encode_all(self, texts: list[str | None]) -> Iterator[tuple[list[int], str]]:
        """Ids of each text, and the same in decimal with a comma after each."""
        for chunk in chunks([t or "" for t in texts]):
            pieces = [self.pieces(t) for t in chunk]
            self.learn(set(chain.from_iterable(pieces)))
            for words in pieces:
                yield list(chain.from_iterable(map(self.ids_of.__getitem__, words))), "".join(map(self.written.__getitem__, words))

    def decode(self, ids: list[int]) -> bytes:
        """The text in UTF-8: vocabulary strings in order, with bytes that form no character replaced."""
        data = b"".join(map(self.strings.__getitem__, ids))
        try:
            data.decode()
        except UnicodeDecodeError:
            return data.decode("utf-8", "replace").encode()
        return data


def chunks(texts: list[str], chars: int = CHUNK_CHARS) -> Iterator[list[str]]:
    out, size = [], 0
    for t in texts:
        if out and size + len(t) > chars:
            yield out
            out, size = [], 0
        out.append(t)
        size += len(t)
    if out:
        yield out


def rows_of(batch: pd.DataFrame, text: str) -> Iterator[pd.DataFrame]:
    """The batch in frames of one chunk of text each, to bound what is held at once."""
    size, start = 0, 0
    for i, n in enumerate(batch[text].str.len().fillna(0)):
        if size and size + n > CHUNK_CHARS:
            yield batch.iloc[start:i]
            size, start = 0, i
        size += n
    yield batch.iloc[start:]


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), decoded: bool = True) -> DataFrame:
    """``keep`` columns with ``ids`` (array of int) and, if asked for, the text decoded from them; these take the place of kept columns of their name."""
    own = kept_columns(keep, ("ids", "decoded") if decoded else ("ids",))
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec(shared.value)
        for batch in batches:
            for part in rows_of(batch, text):
                ids, back = [], []
                for x, _ in codec.encode_all(part[text].tolist()):
                    ids.append(np.array(x, dtype=np.int32))
                    if decoded:
                        back.append(codec.decode(x).decode())
                out = part[own].assign(ids=ids)
                yield out.assign(decoded=back) if decoded else out

    kept = batched(docs).select(*dict.fromkeys([*own, text]))
    return kept.mapInPandas(run, schema_of(kept, own) + "ids array<int>" + ", decoded string" * decoded)


def digests(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """As ``encode``, but with the length and digests in place of the ids and the text, which then never leave Python."""
    own = kept_columns(keep, ("n_tokens", "ids_sha256", "decoded_sha256"))
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec(shared.value)
        for batch in batches:
            rows = [
                (len(ids), hashlib.sha256(written[:-1].encode()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest())
                for ids, written in codec.encode_all(batch[text].tolist())
            ]
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield batch[own].assign(n_tokens=n, ids_sha256=a, decoded_sha256=b)

    kept = batched(docs).select(*dict.fromkeys([*own, text]))
    return kept.mapInPandas(run, schema_of(kept, own) + "n_tokens long, ids_sha256 string, decoded_sha256 string")
