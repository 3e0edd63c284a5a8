"""Toxicity by maximum-scoring segments of token log-odds."""

from __future__ import annotations

import re
import numpy as np
from pyspark.sql import DataFrame

from . import labelled
from .hashing import mix

#: Labelled rows to learn from, bytes of each, at most.
TRAIN_ROWS, TRAIN_BYTES = 8_000, 1 << 14
#: A chance of 1e-20 settles a text; from here on evidence counts by its logarithm.
KNEE = 20.0
#: Tokens that the Dirichlet prior of a class is worth, but for a fiftieth of the sample's at most.
PRIOR = 2_000.0
#: Standard deviations that a token must differ by to score (signed root of the likelihood ratio), and what each token costs a passage.
CAUTION, COST = 4.5, 0.5
THRESHOLD = 0.7
_WORD = re.compile(rb"[^\x00-\x26\x28-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


def log_odds(texts: list[bytes], labels: np.ndarray) -> dict[bytes, float]:
    """Token scores: log-odds between toxic and other texts under Dirichlet priors with the mean of the corpus.

    A token counts once for each pair of neighbours that it has in the texts of a class, so a passage that
    many texts copy votes once. Tokens whose likelihood ratio is within ``CAUTION`` standard deviations
    score nothing, and nothing is stored for them.
    """
    known: dict[bytes, int] = {}
    seen, held = ([[np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]] for _ in range(2))
    for t, y in zip(texts, labels):
        words = tokens(t)
        ids = np.zeros(len(words) + 2, np.uint64)
        ids[1:-1] = [known.setdefault(w, len(known) + 1) for w in words]
        # the token stays whole; its neighbours are mixed into the other bits
        around = mix(ids[:-2] << np.uint64(32) | ids[2:]) & np.uint64(0xFFFFFFFF)
        held[y].append(np.unique(ids[1:-1]))
        seen[y].append(np.unique(ids[1:-1] << np.uint64(32) | around))
    got = [np.bincount((np.unique(np.concatenate(x)) >> np.uint64(32)).astype(np.int64), minlength=len(known) + 1)[1:].astype(np.float64) for x in seen]
    n = [x.sum() for x in got]
    if not all(n):
        return {}
    worth = min(PRIOR, (n[0] + n[1]) / 50)
    prior = worth * (got[0] + got[1]) / (n[0] + n[1])
    y = [g + prior for g in got]
    delta = np.log(y[1] / (n[1] + worth - y[1])) - np.log(y[0] / (n[0] + worth - y[0]))

    def ratio(counts: list[np.ndarray], totals: list[float]) -> np.ndarray:
        expected = [(counts[0] + counts[1]) * x / sum(totals) for x in totals]
        return 2 * sum(np.where(g > 0, g * np.log(np.maximum(g, 1) / np.maximum(e, 1e-300)), 0) for g, e in zip(counts, expected))

    # by documents too: a text's frequent words are no independent evidence
    present = [np.bincount(np.concatenate(x).astype(np.int64), minlength=len(known) + 1)[1:].astype(np.float64) for x in held]
    sure = np.minimum(ratio(got, n), ratio(present, [float(np.sum(labels == k)) for k in (0, 1)])) > CAUTION**2
    words = list(known)
    return {words[i]: float(delta[i]) for i in np.flatnonzero(sure)}


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in one pass.

    ``stack`` holds candidates with the total before them (l) and at their end (r). A new positive
    score looks back for the nearest candidate that starts lower; if that one ends lower too, both
    and all between are one candidate, and the search goes on.
    """
    stack: list[tuple[int, int, float, float]] = []
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        start, low = i, before
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= low:
                j -= 1
            if j < 0 or stack[j][3] >= total:
                break
            start, low = stack[j][0], stack[j][2]
            del stack[j:]
            j -= 1
        stack.append((start, i + 1, low, total))
    return [(a, b, high - low) for a, b, low, high in stack]


def told(evidence: float) -> float:
    """Evidence as the logistic curve takes it: beyond KNEE it counts by its logarithm, so more evidence always tells more, and never fills a double."""
    return min(evidence, KNEE) + float(np.log(max(evidence, KNEE) / KNEE))


class Scorer:
    """Probability that a text is toxic, from its passages' scores against chance."""

    def __init__(self, odds: dict[bytes, float]) -> None:
        self.odds = odds
        self.toxic = {w for w, s in odds.items() if s > COST}
        self.rate, self.scale = 1.0, 1.0
        self.slope, self.constant = 1.0, 0.0

    def values(self, text: bytes) -> list[float]:
        """Token scores; none where no token scores more than nothing."""
        words, get = tokens(text), self.odds.get
        return [] if self.toxic.isdisjoint(words) else [get(w, 0.0) - COST for w in words]

    def evidence(self, text: bytes) -> float:
        """-log10 of the chance of the text's passages: each passage's E-value by the Gumbel law, in order of score.

        The expected number of passages of score s or more in n tokens of other text is scale * n *
        exp(-rate * s); the k best together have a chance of about E1 * ... * Ek / k!, as counts of a Poisson law.
        """
        v = self.values(text)
        if not v:
            return 0.0
        best = np.sort([s for _, _, s in segments(v)])[::-1]
        # log10 of E1 * ... * Ek / k! for every k, of all passages
        totals = np.cumsum(np.log10(self.scale * len(v)) - self.rate * best / np.log(10) - np.log10(np.arange(1, len(best) + 1)))
        return float(max(0.0, -totals.min()))

    def fit(self, texts: list[bytes], labels: np.ndarray) -> Scorer:
        """Extreme-value parameters from the other texts, then a logistic curve from evidence to probability."""
        other = [[self.odds.get(w, 0.0) - COST for w in tokens(t)] for t, y in zip(texts, labels) if y == 0]
        # one more token with the highest score, as these texts may happen to hold none
        flat = np.array([*[x for v in other for x in v], max(self.odds.values(), default=0.0) - COST])
        if len(flat) and flat.max() > 0 > flat.mean():
            # the positive root of the mean of exp(rate * score) = 1
            lo, hi = 1e-6, 1.0
            while np.exp(np.clip(hi * flat, None, 500)).mean() < 1:
                hi *= 2
            for _ in range(60):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if np.exp(np.clip(mid * flat, None, 500)).mean() < 1 else (lo, mid)
            self.rate = lo
            tops = [(len(v), max((s for _, _, s in segments(v)), default=0.0)) for v in other]
            # maximum likelihood of the Gumbel law's scale, given its rate
            self.scale = max(1e-9, len(tops) / max(1e-9, sum(n * np.exp(-self.rate * s) for n, s in tops)))
        x = np.array([told(self.evidence(t)) for t in texts])
        y = np.asarray(labels, np.float64)
        a = b = 0.0
        for _ in range(50 if len(x) and 0 < y.mean() < 1 else 0):
            p = 1 / (1 + np.exp(-(a * x + b)))
            w, g = p * (1 - p) + 1e-9, y - p
            h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
            da, db = np.linalg.solve(h, [(g * x).sum() - 1e-3 * a, g.sum()])
            a, b = a + da, b + db
        self.slope, self.constant = a, b
        return self

    def __call__(self, texts: list[bytes]) -> list[float]:
        return [float(1 / (1 + np.exp(-np.clip(self.slope * told(self.evidence(t)) + self.constant, -700, 700)))) for t in texts]

    def passages(self, text: bytes, chance: float = 0.01) -> list[tuple[int, int, float]]:
        """Token ranges of passages that texts of this length show with less than the given chance."""
        v = self.values(text)
        return [(a, b, s) for a, b, s in segments(v) if self.scale * len(v) * np.exp(-self.rate * s) < chance]


def classify(docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1, rows: int = TRAIN_ROWS, keep: tuple[str, ...] = (), max_bytes: int = TRAIN_BYTES) -> DataFrame:
    """One row per row of ``docs``: ``keep`` columns, doc_id, held_out, score, predicted.

    Learns from a sample of ``rows`` labelled rows of ``max_bytes`` each at most whose crc32(doc_id) modulo ``modulus`` isn't ``remainder``.
    score is the probability of label 1; null, empty and wordless texts have no passage and get the
    least score. held_out is false for a null doc_id. Without labelled rows of both kinds all score 0.5.
    """
    rule = labelled.held_out_rule(modulus, remainder)
    texts, y = labelled.sample(docs, labels, "toxic", rule, rows, max_bytes)
    return labelled.scored(docs, rule, Scorer(log_odds(texts, y)).fit(texts, y), THRESHOLD, keep)
