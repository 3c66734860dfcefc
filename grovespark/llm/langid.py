"""Language identification with a byte convolutional network.

One-hot bytes go through filters of several widths, each filter's maximum over a
window is kept, and a softmax over these gives the language.  Forward and backward
passes are numpy.  Texts of any length are cut into windows of fixed length that
cover all their bytes, and a document's probabilities are the mean over its windows,
weighted by the bytes in each.

Training rows are a bounded sample: about ``per_language`` rows of each language,
chosen by a hash of id and text, and of each ``SAMPLE_CHARS`` characters from
anywhere in it, the place drawn by the same hash.  The trained weights (fixed size but for a row a language) go to the tasks; scoring is one pass
without a shuffle.

Defined results: a text that is null or holds no letter gets ``und`` with score 0,
and so does every text if nothing was learned; of equal probabilities the language
first in code point order wins; extra columns are ignored, repeated rows repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovespark.llm.common import batched, kept_columns, schema_of

UNDETERMINED = "und"
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
PER_LANGUAGE = 500
SAMPLE_CHARS = 1024
EPOCHS = 8
BATCH_WINDOWS = 512

#: A-Z count as a-z.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32
LETTER = regex.compile(r"\p{L}").search


def windows_of(data: bytes) -> np.ndarray:
    """The bytes in rows of ``WINDOW``, the last filled up with zeros."""
    rows = max(1, -(-len(data) // WINDOW))
    flat = np.zeros(rows * WINDOW, dtype=np.uint8)
    flat[: len(data)] = FOLD[np.frombuffer(data, dtype=np.uint8)]
    return flat.reshape(rows, WINDOW)


class Network:
    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.filters = [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, dtype=np.float32)
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(labels))).astype(np.float32)
        self.out_bias = np.zeros(len(labels), dtype=np.float32)

    @staticmethod
    def convolve(table: np.ndarray, x: np.ndarray) -> np.ndarray:
        length = x.shape[1] - len(table) + 1
        total = table[0].take(x[:, :length], axis=0)
        for k in range(1, len(table)):
            total += table[k].take(x[:, k : k + length], axis=0)
        return total

    @staticmethod
    def peak(a: np.ndarray) -> np.ndarray:
        """Maximum over the positions, by folding one half onto the other."""
        n = a.shape[1]
        while n > 1:
            half = (n + 1) // 2
            a = np.maximum(a[:, :half], a[:, n - half : n])
            n = half
        return a[:, 0]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.intp)
        pooled = np.concatenate([self.peak(self.convolve(t, x)) for t in self.filters], axis=1)
        z = np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        x = x.astype(np.intp)
        rows = np.arange(len(x))
        best = [self.convolve(t, x) for t in self.filters]
        where = [a.argmax(axis=1) for a in best]
        pooled = np.concatenate([np.take_along_axis(a, i[:, None], axis=1)[:, 0] for a, i in zip(best, where, strict=True)], axis=1)
        hidden = np.maximum(pooled + self.bias, 0)
        z = hidden @ self.out + self.out_bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[rows, y] -= 1
        p /= len(x)
        back = (p @ self.out.T) * (hidden > 0)
        grads = []
        for j, (table, at) in enumerate(zip(self.filters, where, strict=True)):
            g, own = np.zeros_like(table), back[:, j * FILTERS : (j + 1) * FILTERS]
            column = np.broadcast_to(np.arange(FILTERS), at.shape)
            for k in range(len(table)):
                np.add.at(g[k], (x[rows[:, None], at + k], column), own)
            grads.append(g)
        return [*grads, back.sum(axis=0), hidden.T @ p, p.sum(axis=0)]

    def weights(self) -> list[np.ndarray]:
        return [*self.filters, self.bias, self.out, self.out_bias]

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, batch: int = 64, seed: int = 11) -> Network:
        """Adam over shuffled batches."""
        rng, step = np.random.default_rng(seed), 0
        mean = [np.zeros_like(w) for w in self.weights()]
        square = [np.zeros_like(w) for w in self.weights()]
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                own = order[at : at + batch]
                step += 1
                for w, g, m, s in zip(self.weights(), self.gradients(x[own], y[own]), mean, square, strict=True):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        return self

    def classify(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [(UNDETERMINED, 0.0)] * len(texts)
        if not self.labels:
            return out
        pending, owners, held = [], [], 0
        total = np.zeros((len(texts), len(self.labels)))
        size = np.zeros(len(texts))

        def flush() -> None:
            nonlocal pending, owners, held
            if pending:
                x = np.concatenate(pending)
                owner = np.concatenate(owners)
                weight = (x != 0).sum(axis=1).astype(float)
                for a in range(0, len(x), BATCH_WINDOWS):
                    cut = slice(a, a + BATCH_WINDOWS)
                    np.add.at(total, owner[cut], self.probabilities(x[cut]) * weight[cut, None])
                np.add.at(size, owner, weight)
            pending, owners, held = [], [], 0

        for i, text in enumerate(texts):
            if text and LETTER(text):
                x = windows_of(text.encode())
                pending.append(x)
                owners.append(np.full(len(x), i))
                held += len(x)
                size[i] = 1e-9
                if held > 8 * BATCH_WINDOWS:
                    flush()
        flush()
        known = np.flatnonzero(size)
        share = total[known] / size[known, None]
        for i, k, p in zip(known.tolist(), share.argmax(axis=1).tolist(), share.max(axis=1).tolist(), strict=True):
            out[i] = (self.labels[k], min(1.0, p))
        return out


def train(docs: DataFrame, usable: Column, per_language: int = PER_LANGUAGE) -> Network:
    """Fit on about ``per_language`` rows of each language, of those that ``usable`` admits."""
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = {r.lang: per_language / r["count"] for r in rows.groupBy("lang").count().collect()}
    if not share:
        return Network([])
    drawn = rows.select("lang", "text", F.xxhash64(F.lit("langid"), "doc_id", "text").alias("hash")).withColumn("dice", F.pmod("hash", F.lit(1_000_003)) / 1_000_003)
    wanted = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])[F.col("lang")]
    begin = F.pmod(F.shiftright("hash", 20), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1) + 1
    part = F.substring(F.col("text"), begin.cast("int"), F.lit(SAMPLE_CHARS)).alias("text")
    sample = drawn.where(F.col("dice") < wanted).select("dice", "lang", part).orderBy("dice", "lang", "text").limit(2 * per_language * len(share)).toPandas()
    labels = sorted(share)
    found = [(windows_of(t.encode()), labels.index(k)) for t, k in zip(sample.text, sample.lang, strict=True) if LETTER(t)]
    if not found:
        return Network([])
    x = np.concatenate([w for w, _ in found])
    y = np.concatenate([np.full(len(w), k) for w, k in found])
    return Network(labels).fit(x, y)


def predict(docs: DataFrame, network: Network, text: str = "text", keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns with lang_pred and score (mean probability of that language), called ``names``; these take the place of kept columns of their name."""
    own = kept_columns(keep, names)
    kept = batched(docs).select(*dict.fromkeys([*own, text]))
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = shared.value.classify(batch[text].tolist())
            yield batch[own].assign(**{names[0]: [a for a, _ in found], names[1]: [b for _, b in found]})

    return kept.mapInPandas(run, f"{schema_of(kept, own)}`{names[0]}` string, `{names[1]}` double")
