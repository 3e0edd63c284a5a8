"""Quality classifier: supervised subword embeddings."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from . import labelled
from .hashing import WHITE, word_hashes, words_of

#: Labelled rows to learn from, bytes of each, at most.
TRAIN_ROWS, TRAIN_BYTES = 6_000, 1 << 15
BUCKET_BITS, DIM, EPOCHS, RATE = 17, 8, 4, 0.2
#: Lengths of the character n-grams, in UTF-8 bytes; white space marks a word's ends in them.
GRAMS = (2, 3, 4)
THRESHOLD = 0.3
#: Bytes that are looked at together.
_RUN = 1 << 20
_WHITE = re.compile(rb"[\x20\x09-\x0D]")


def buckets(raw: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(positions, buckets) of the words and, for each length, of the n-grams within marked words."""
    starts, ends = words_of(raw)
    out = [(starts, (word_hashes(raw, starts, ends) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))]
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = ~WHITE[raw]
    padded = np.zeros(len(raw) + 2, np.uint64)
    padded[1:-1] = np.where(inside[1:-1], raw, 0)
    for n in GRAMS:
        m = len(padded) - n + 1
        if m <= 0:
            continue
        value, whole = np.full(m, n, np.uint64), np.ones(m, bool)
        for i in range(n):
            value = value << np.uint64(8) | padded[i : i + m]
            if 0 < i < n - 1:
                whole &= inside[i : i + m]
        if n == 2:
            whole &= inside[:m] | inside[1 : 1 + m]
        at = np.flatnonzero(whole)
        out.append((at, ((value[at] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)))
    return out


def pieces(t: bytes) -> Iterator[tuple[int, int]]:
    """Ranges of about _RUN bytes that end before white space, where no feature is cut; a longer word stays whole."""
    at = 0
    while at < len(t):
        found = _WHITE.search(t, at + _RUN)
        end = found.start() if found else len(t)
        yield at, end
        at = end


def train(texts: list[bytes], labels: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """What each bucket adds to the log-odds of label 1, and their constant.

    A document is the mean of its features' vectors; a softmax layer of two classes reads it. Vectors and layer
    are learned by stochastic gradient descent, a document a step, at a rate that falls to 0. A step
    is divided by the squared length of the document's weights, so that long and short documents move alike.
    """
    rng = np.random.default_rng(seed)
    docs = []
    for t in texts:
        ids, n = np.unique(np.concatenate([b for _, b in buckets(np.frombuffer(t, np.uint8))]), return_counts=True)
        docs.append((ids.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)))
    e = rng.uniform(-1 / DIM, 1 / DIM, (1 << BUCKET_BITS, DIM)).astype(np.float32)
    w, b = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    order = np.concatenate([rng.permutation(len(docs)) for _ in range(EPOCHS)]) if docs else []
    for step, i in enumerate(order):
        ids, weight = docs[i]
        if not len(ids):
            continue
        rate = np.float32(RATE * (1 - step / len(order)))
        v = weight @ e[ids]
        z = v @ w + b
        p = np.exp(z - z.max())
        p /= p.sum()
        p[labels[i]] -= 1
        back = w @ p
        w -= rate * np.outer(v, p)
        b -= rate * p
        e[ids] -= (rate / (weight @ weight) * weight)[:, None] * back
    return e @ (w[:, 1] - w[:, 0]), float(b[1] - b[0])


class Scorer:
    """Probability of label 1 of whole texts."""

    def __init__(self, margin: np.ndarray, constant: float) -> None:
        self.margin, self.constant = margin, constant

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        total, count = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            for a, z in pieces(t):
                for _, b in buckets(np.frombuffer(t, np.uint8)[a:z]):
                    total[i] += self.margin[b].sum(dtype=np.float64)
                    count[i] += len(b)
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(1, count) + self.constant, -30, 30)))


def classify(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0, rows: int = TRAIN_ROWS, keep: tuple[str, ...] = (), max_bytes: int = TRAIN_BYTES) -> DataFrame:
    """One row per row of ``docs``: ``keep`` columns, doc_id, held_out, score, predicted.

    Learns from a sample of ``rows`` labelled rows of ``max_bytes`` each at most whose crc32(doc_id) modulo ``modulus`` isn't ``remainder``.
    score is the probability of label 1; a null, empty or blank text has no features and gets the model's
    constant. held_out is false for a null doc_id. Without labelled rows all score 0.5.
    """
    rule = labelled.held_out_rule(modulus, remainder)
    texts, y = labelled.sample(docs, labels, "quality", rule, rows, max_bytes)
    return labelled.scored(docs, rule, Scorer(*train(texts, y)), THRESHOLD, keep)
