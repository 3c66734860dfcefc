"""Quality classifier: a linear-chain conditional random field over lines.

Every line of a document is good or bad.  A line's features are shares of character
classes of the line itself and of both neighbours; the chain adds weights for the
four transitions.  Forward-backward marginals, weighted by line length, give the
share of a document that is bad, and a logistic curve turns it into a score.

Documents are labelled, lines are not.  Training starts with every line having its
document's label, fits, then moves the lines of bad documents that the fit takes for
good, keeping at least the worst line of each, and fits again.  It uses a bounded
sample of about ``TRAIN_DOCS`` labelled rows chosen by a hash of the id, and of each
``TRAIN_LINES`` lines in a row from anywhere in it, the first drawn by a checksum of
the text; features are taken in the tasks and only they reach the driver.  Scoring is one pass
without a shuffle, and looks at the text alone.

Defined results: null text counts as empty, which is one line without characters;
with no labelled row of either kind every score is the share of good labels (or
0.5 without any); of several labels of one document the lowest counts, null ones
never; extra columns are ignored and repeated rows repeat.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovespark.llm.common import kept_columns, schema_of

TRAIN_DOCS = 3000
#: Lines of one document that training looks at.
TRAIN_LINES = 400
ROUNDS = 3
CHUNK_BYTES = 4_000_000

#: Character classes by byte; bytes not listed are "other".
CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "space": b" \t\r\x0b\x0c",
    "stop": b".,;:",
    "mark": b"!?",
    "quote": b"'\"()-",
    "symbol": b"#$%&*@^~+=<>\\/_`",
    "bar": b"|[]{}",
}
KIND = np.full(256, len(CLASSES) + 1, dtype=np.int64)
for _k, _own in enumerate(CLASSES.values()):
    KIND[list(_own)] = _k
KIND[128:] = len(CLASSES)
KINDS = len(CLASSES) + 2
OWN = KINDS + 7
FEATURES = 3 * OWN + 1


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all lines in order: features, length in bytes; and the number of lines of each text."""
    data = [(t or "").encode() + b"\n" for t in texts]
    flat = np.frombuffer(b"".join(data), dtype=np.uint8)
    size = np.fromiter(map(len, data), dtype=np.int64, count=len(data))
    ends = np.flatnonzero(flat == 10)
    starts = np.r_[0, ends[:-1] + 1]
    length = ends - starts
    lines = np.diff(np.searchsorted(ends, np.r_[0, np.cumsum(size)]))
    n = len(ends)
    owner = np.repeat(np.arange(n), length + 1)
    kind = KIND[flat]
    counts = np.bincount(owner * KINDS + kind, minlength=n * KINDS).reshape(n, KINDS).astype(np.float32)
    counts[:, KIND[10]] -= 1
    total = np.maximum(length, 1)[:, None].astype(np.float32)
    blank = (kind == 3) | (flat == 10)
    heads = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    words = np.maximum(np.bincount(owner[heads], minlength=n), 1)
    own = np.empty((n, OWN), dtype=np.float32)
    own[:, :KINDS] = counts / total
    own[:, KINDS] = np.log1p(length) / 5
    own[:, KINDS + 1] = np.minimum(length / words, 20) / 10
    own[:, KINDS + 2] = (counts[:, 5] + counts[:, 7] + counts[:, 8]) / words
    own[:, KINDS + 3] = length == 0
    last = flat[np.maximum(ends - 1, 0)]
    own[:, KINDS + 5 :] = repeats(flat, blank, heads, owner, n) / words[:, None]
    own[:, KINDS + 4] = (length > 0) & ((last == ord(".")) | (last == ord("?")))
    x = np.zeros((n, FEATURES), dtype=np.float32)
    x[:, :OWN] = own
    first = np.zeros(n, dtype=bool)
    first[np.cumsum(lines)[:-1]] = True
    first[0] = True
    after = np.flatnonzero(~first)
    x[after, OWN : 2 * OWN] = own[after - 1]
    x[after - 1, 2 * OWN : 3 * OWN] = own[after]
    x[:, -1] = 1
    return x, length, lines


def repeats(flat: np.ndarray, blank: np.ndarray, heads: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Words of each line that equal the word before, and the word before that; words are compared by a hash."""
    out = np.zeros((n, 2), dtype=np.float32)
    if not len(heads):
        return out
    place = np.arange(len(flat)) - heads[np.maximum(np.searchsorted(heads, np.arange(len(flat)), side="right") - 1, 0)]
    factors = np.random.default_rng(5).integers(1, 2**31, 64)
    digest = np.add.reduceat(np.where(blank, 0, flat * factors[place % 64]), heads)
    line = owner[heads]
    for back in (1, 2):
        same = (digest[back:] == digest[:-back]) & (line[back:] == line[:-back])
        out[:, back - 1] = np.bincount(line[back:][same], minlength=n)
    return out


class Chain:
    """Weights for the state bad (1) against good (0), and transitions between them."""

    def __init__(self):
        self.weights = np.zeros(FEATURES)
        self.moves = np.zeros((2, 2))
        self.curve = (0.0, 0.0)

    def marginals(self, x: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(bad) of each line, and expected transitions, by forward-backward over all documents at once."""
        n = len(x)
        emit = np.zeros((n, 2))
        emit[:, 1] = x @ self.weights
        start = np.r_[0, np.cumsum(lines)[:-1]]
        order = np.argsort(-lines, kind="stable")
        start, lines = start[order], lines[order]
        depth = int(lines.max())
        active = [int(np.searchsorted(-lines, -t, side="left")) for t in range(depth)]  # documents with more than t lines
        ahead, behind = emit.copy(), np.zeros((n, 2))
        for t in range(1, depth):
            at = start[: active[t]] + t
            before = ahead[at - 1]
            ahead[at] += np.logaddexp(before[:, :1] + self.moves[0], before[:, 1:] + self.moves[1])
        for t in range(depth - 2, -1, -1):
            at = start[: active[t + 1]] + t
            then = emit[at + 1] + behind[at + 1]
            behind[at] = np.logaddexp(self.moves[:, 0] + then[:, :1], self.moves[:, 1] + then[:, 1:])
        both = ahead + behind
        bad = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))
        inner = np.ones(n, dtype=bool)
        inner[start] = False
        to = np.flatnonzero(inner)
        pair = ahead[to - 1][:, :, None] + self.moves + (emit[to] + behind[to])[:, None, :]
        pair -= np.logaddexp(both[to, 0], both[to, 1])[:, None, None]
        return bad, np.exp(pair).sum(axis=0)

    def fit(self, x: np.ndarray, lines: np.ndarray, labels: np.ndarray, steps: int = 80, rate: float = 0.15, ridge: float = 1e-3) -> None:
        """Adam on the conditional likelihood of the line labels."""
        inner = np.ones(len(x), dtype=bool)
        inner[np.r_[0, np.cumsum(lines)[:-1]]] = False
        to = np.flatnonzero(inner)
        seen = np.zeros((2, 2))
        np.add.at(seen, (labels[to - 1], labels[to]), 1)
        mean, square = np.zeros(FEATURES + 4), np.zeros(FEATURES + 4)
        for step in range(1, steps + 1):
            bad, moves = self.marginals(x, lines)
            g = np.r_[x.T @ (bad - labels), (moves - seen).ravel()] / len(x)
            g += ridge * np.r_[self.weights, self.moves.ravel()]
            mean += 0.1 * (g - mean)
            square += 0.01 * (g * g - square)
            change = rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
            self.weights -= change[:FEATURES]
            self.moves -= change[FEATURES:].reshape(2, 2)

    def share(self, x: np.ndarray, length: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """Length-weighted mean of P(bad) of each document."""
        bad, _ = self.marginals(x, lines)
        start, weight = np.r_[0, np.cumsum(lines)[:-1]], length + 1.0
        return np.add.reduceat(bad * weight, start) / np.add.reduceat(weight, start)

    def score(self, share: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.curve[0] + self.curve[1] * np.log1p(50 * share))))


def learn(x: np.ndarray, length: np.ndarray, lines: np.ndarray, good: np.ndarray, rounds: int = ROUNDS) -> Chain:
    chain = Chain()
    if not len(good) or good.all() or not good.any():
        p = np.clip(good.mean() if len(good) else 0.5, 0.01, 0.99)
        chain.curve = (float(np.log(p / (1 - p))), 0.0)
        return chain
    owner = np.repeat(np.arange(len(lines)), lines)
    start = np.r_[0, np.cumsum(lines)[:-1]]
    labels = (1 - good)[owner]
    for _ in range(rounds):
        chain.fit(x, lines, labels)
        bad, _ = chain.marginals(x, lines)
        worst = np.maximum.reduceat(bad, start)[owner]
        labels = ((1 - good)[owner] & ((bad > 0.5) | (bad >= worst))).astype(np.int64)
    chain.fit(x, lines, labels)
    z, w = np.log1p(50 * chain.share(x, length, lines)), np.zeros(2)
    design = np.stack([np.ones_like(z), z], axis=1)
    for _ in range(50):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-design @ w))
        g = design.T @ (p - good) + 0.1 * w
        w -= np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2), g)
    chain.curve = (float(w[0]), float(w[1]))
    return chain


def train(docs: DataFrame, labels: DataFrame, usable: Column, train_docs: int = TRAIN_DOCS) -> Chain:
    """Fit on about ``train_docs`` of the labelled documents that ``usable`` (over doc_id) admits.

    An id may have many rows: equal ones count once, and of more than twice as many rows as documents a part is drawn by a hash.
    """
    known = labels.where(usable & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    total = known.count()
    dice = F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1_000_003)) / 1_000_003
    picked = known.where(dice < train_docs / max(total, 1)).orderBy(dice, "doc_id").limit(2 * train_docs)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "quality", "text").distinct()
    most, found = 2 * train_docs, rows.count()
    if found > most:
        rows = rows.where(F.pmod(F.xxhash64(F.lit("row"), "doc_id", "text"), F.lit(1_000_003)) < F.lit(1_000_003 * most / found))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, q, t in zip(batch.doc_id, batch.quality, batch.text, strict=True):
                x, length, _ = line_features([t])
                begin = zlib.crc32((t or "").encode()) % (max(len(x) - TRAIN_LINES, 0) + 1)
                lines = slice(begin, begin + TRAIN_LINES)
                yield pd.DataFrame({"doc_id": [i], "quality": [q], "x": [x[lines].tobytes()], "length": [length[lines].tobytes()]})

    sample = rows.mapInPandas(run, "doc_id long, quality int, x binary, length binary").toPandas().sort_values(["doc_id", "x"], kind="stable")
    if not len(sample):
        return learn(np.zeros((0, FEATURES)), np.zeros(0), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
    x = np.concatenate([np.frombuffer(b, dtype=np.float32).reshape(-1, FEATURES) for b in sample.x]).astype(np.float64)
    length = np.concatenate([np.frombuffer(b, dtype=np.int64) for b in sample.length])
    lines = np.array([len(b) // 8 for b in sample.length])
    return learn(x, length, lines, (sample.quality.to_numpy() > 0).astype(np.int64))


def score_texts(chain: Chain, texts: list[str | None]) -> np.ndarray:
    out, at = np.zeros(len(texts)), 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop] or "") <= CHUNK_BYTES):
            size += len(texts[stop] or "")
            stop += 1
        out[at:stop] = chain.score(chain.share(*line_features(texts[at:stop])))
        at = stop
    return out


def score(docs: DataFrame, chain: Chain, threshold: float = 0.3, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with score (0 to 1, higher: better) and predicted (1 from ``threshold`` on); these take the place of kept columns of their name."""
    own = kept_columns(keep, ("score", "predicted"))
    kept = docs.select(*dict.fromkeys([*own, text]))
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = score_texts(shared.value, batch[text].tolist())
            yield batch[own].assign(score=found, predicted=(found >= threshold).astype(np.int32))

    return kept.mapInPandas(run, f"{schema_of(kept, own)}score double, predicted int")
