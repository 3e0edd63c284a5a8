"""Language-model scoring with a hierarchical Pitman-Yor model."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import runtime
from .hashing import lower, word_hashes, words_of

#: Strength of all restaurants; their discounts come from counts of counts.
STRENGTH = 1.0
#: Sweeps that give the restaurants' totals, samples that are averaged, and sweeps before these.
SWEEPS, SAMPLES, BURN = 2, 4, 1
#: Blocks whose requests one task answers. Each further task of a part gets a copy of the part's model and samples it anew,
#: while a part's requests are about what two blocks ask, so this only bounds what a very frequent word's part holds.
ANSWER_BLOCKS = 1024
#: Answers give log10 probabilities in steps of one part of so many, far below the spread between samples.
STEPS = 1024
END = np.uint64(0x1D8E4E27C47D124F)
_RUN = 1 << 20


class _Tokens:
    """A block's distinct words, its distinct (word, context) events and their places in the documents.

    The context of a word is 8 bits of its predecessor's hash and the predecessor's last byte (0 at a document's start); that
    restaurant's parent goes by the last byte alone, whose parent is the root. So there are 65,793 restaurants at most.
    """

    def __init__(self, table: pa.Table) -> None:
        self.ids, texts = B.texts(table)
        self.held = table.column("held").to_numpy(zero_copy_only=False).astype(bool)
        hashes, contexts, sizes = [], [], []
        for a, b in B.runs([len(t) + 1 for t in texts], _RUN):
            buf = lower(np.frombuffer(b"\n".join(texts[a:b]), np.uint8))
            starts, ends = words_of(buf)
            cut = np.searchsorted(starts, np.cumsum([0, *[len(t) + 1 for t in texts[a:b]]]))
            n = np.diff(cut)
            own = word_hashes(buf, starts, ends)
            last = (own >> np.uint64(56)).astype(np.int64) << 8 | buf[ends - 1]
            # each document's words, then its end
            place = np.arange(len(starts)) + np.repeat(np.arange(len(n)), n)
            h = np.full(len(starts) + len(n), END)
            h[place] = own
            c = np.zeros(len(h), np.int64)
            c[place + 1] = last
            hashes.append(h)
            contexts.append(c)
            sizes.append(n + 1)
        self.sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        self.words, word = np.unique(np.concatenate(hashes), return_inverse=True)
        events, self.event = np.unique(word << 16 | np.concatenate(contexts), return_inverse=True)
        self.event_word, self.event_context = events >> 16, (events & 0xFFFF).astype(np.uint16)
        self.counts = np.bincount(self.event, np.repeat(~self.held, self.sizes), minlength=len(events)).astype(np.int64)
        self.first = np.searchsorted(self.event_word, np.arange(len(self.words) + 1))


def _request(table: pa.Table, parts: int):
    t = _Tokens(table)
    for p, a, b in B.cuts(t.words, parts):
        x, y = t.first[a], t.first[b]
        yield p, B.dumps(words=t.words[a:b], n=np.diff(t.first[a : b + 1]).astype(np.uint16), context=t.event_context[x:y], count=t.counts[x:y])


def _merge(requests: list[bytes]) -> dict[str, np.ndarray]:
    """Distinct words, their events and counts."""
    got = [B.loads(x) for x in requests]
    every = np.concatenate([g["words"] for g in got])
    words, at = np.unique(every, return_inverse=True)
    owner = np.repeat(at, np.concatenate([g["n"] for g in got]))
    events, where = np.unique(owner << 16 | np.concatenate([g["context"] for g in got]), return_inverse=True)
    count = np.bincount(where, np.concatenate([g["count"] for g in got]), minlength=len(events)).astype(np.int64)
    return {"words": words, "n": np.bincount(events >> 16, minlength=len(words)), "context": (events & 0xFFFF).astype(np.uint16), "count": count}


def _seat(rng: np.random.Generator, customers: np.ndarray, pull: np.ndarray, discount: float) -> np.ndarray:
    """Tables of each dish after its customers have sat down one by one.

    pull: (strength + discount * tables of the restaurant) * the parent's probability of the dish, which
    weighs a new table against ``seated - discount * tables``. The first 16 customers are
    drawn one by one, then groups of a sixteenth of those seated are drawn as binomials.
    """
    tables = np.minimum(customers, 1).astype(np.float64)
    active, seated = np.flatnonzero(customers > 1), 1
    while len(active):
        step = max(1, seated // 16)
        t, a = tables[active], pull[active]
        n = np.minimum(customers[active] - seated, step)
        tables[active] += rng.binomial(n, a / (a + seated - discount * t)) if step > 1 else rng.random(len(active)) < a / (a + seated - discount * t)
        seated += step
        active = active[customers[active] > seated]
    return tables


class _Restaurants:
    """The dishes of one part of the vocabulary in all restaurants."""

    def __init__(self, model: dict[str, np.ndarray], totals: dict[tuple[int, int], tuple[float, float]], discounts: list[float], vocabulary: int) -> None:
        self.context = model["context"].astype(np.int64)
        self.word = np.repeat(np.arange(len(model["words"])), model["n"])
        self.count = model["count"]
        # dishes of the parents: a word by the last byte of the context
        parents, self.parent = np.unique(self.word << 8 | self.context & 255, return_inverse=True)
        self.parent_word, self.parent_context = parents >> 8, parents & 255
        self.words, self.discounts = len(model["words"]), discounts
        self.base = 1.0 / (vocabulary + 1)
        self.customers, self.tables = [np.zeros(1), np.zeros(256), np.zeros(65536)], [np.zeros(1), np.zeros(256), np.zeros(65536)]
        for (level, c), (n, t) in totals.items():
            self.customers[level][c], self.tables[level][c] = n, t
        self.t2 = np.minimum(self.count, 1).astype(np.float64)
        self.t1 = np.minimum(self._up(self.t2), 1)
        self.t0 = np.minimum(self._root(self.t1), 1)
        self.look()

    def _up(self, t2: np.ndarray) -> np.ndarray:
        return np.bincount(self.parent, t2, minlength=len(self.parent_word))

    def _root(self, t1: np.ndarray) -> np.ndarray:
        return np.bincount(self.parent_word, t1, minlength=self.words)

    def _pull(self, level: int, context: np.ndarray | int, parent: np.ndarray | float) -> np.ndarray:
        return (STRENGTH + self.discounts[level] * self.tables[level][context]) * parent

    def look(self) -> None:
        """Predictive probabilities from the root down."""

        def p(level, context, customers, tables, parent):
            return (np.maximum(customers - self.discounts[level] * tables, 0) + self._pull(level, context, parent)) / (STRENGTH + self.customers[level][context])

        zero = np.zeros(self.words, np.int64)
        self.p0 = p(0, zero, self._root(self.t1), self.t0, self.base)
        self.p1 = p(1, self.parent_context, self._up(self.t2), self.t1, self.p0[self.parent_word])
        self.p2 = p(2, self.context, self.count, self.t2, self.p1[self.parent])

    def sweep(self, rng: np.random.Generator) -> None:
        """Seat all customers anew, restaurants before their parents, and look again."""
        self.t2 = _seat(rng, self.count, self._pull(2, self.context, self.p1[self.parent]), self.discounts[2])
        c1 = self._up(self.t2).astype(np.int64)
        self.t1 = _seat(rng, c1, self._pull(1, self.parent_context, self.p0[self.parent_word]), self.discounts[1])
        c0 = self._root(self.t1).astype(np.int64)
        self.t0 = _seat(rng, c0, np.full(self.words, self._pull(0, 0, self.base)), self.discounts[0])
        self.look()

    def totals(self) -> pd.DataFrame:
        """By level and context: customers, tables, dishes with one and with two customers."""
        out = []
        for level, context, customers, tables in ((2, self.context, self.count, self.t2), (1, self.parent_context, self._up(self.t2), self.t1), (0, np.zeros(self.words, np.int64), self._root(self.t1), self.t0)):
            size = (1, 256, 65536)[level]
            rows = [np.bincount(context, x, minlength=size) for x in (customers, tables, customers == 1, customers == 2)]
            some = np.flatnonzero(rows[0])
            out.append(pd.DataFrame({"level": level, "context": some, "customers": rows[0][some], "tables": rows[1][some], "once": rows[2][some], "twice": rows[3][some]}))
        return pd.concat(out)


_TOTALS = "level long, context long, customers double, tables double, once double, twice double"


def _gather(models: DataFrame, totals: dict, discounts: list[float], vocabulary: int, sweep: int) -> tuple[dict, list[float]]:
    """Totals of all restaurants after a sweep over all parts: 65,793 rows at most, whatever the corpus."""

    def run(batches):
        for b in batches:
            for p, data in zip(b.column("p").to_pylist(), b.column("data")):
                r = _Restaurants(B.loads(data.as_py()), totals, discounts, vocabulary)
                if sweep:
                    for i in range(2):
                        r.sweep(np.random.default_rng([sweep, i, p]))
                yield pa.RecordBatch.from_pandas(r.totals().astype({"level": "int64", "context": "int64"}), preserve_index=False)

    rows = models.select("p", "data").mapInArrow(run, _TOTALS).groupBy("level", "context").agg(*[F.sum(c).alias(c) for c in ("customers", "tables", "once", "twice")]).collect()
    found = []
    for level in range(3):
        once, twice = (sum(r[c] for r in rows if r["level"] == level) for c in ("once", "twice"))
        found.append(min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5)
    return {(r["level"], r["context"]): (r["customers"], r["tables"]) for r in rows}, found


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows for which ``held_out`` is false train the model; all are scored. Tokens are the words between ASCII
    white space, A-Z lower-cased, and one end, so null and empty texts have one token. base_score is the
    sum of log10((c + 1) / (N + V + 1)); score is the sum of log10 of the predictive probability, averaged
    over samples of the seating. Repeated rows count as often as they occur. Without training rows both scores
    use the uniform base. Other columns are ignored.

    A block asks for its distinct (word, context) events; parts of the vocabulary, by hash, merge the
    counts of all blocks, so all events of a word meet, summed by block. Restaurants share only
    their totals: each sweep seats the dishes of all parts in parallel, given the totals of the last
    sweep, and adds up new ones, a table of bounded size. Blocked Gibbs sampling in this form treats
    other dishes' tables as of the last sweep. The last job samples with the totals settled and
    answers each block's events with averaged probabilities and counts.
    """
    packed = B.pack(docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held")), ("doc_id", "text", "held"))
    parts = B.parts_for(packed)
    requests = runtime.materialise(B.ask(packed, lambda table: _request(table, parts)), "requests")

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        m = _merge(list(pdf["data"]))
        known = np.bincount(np.repeat(np.arange(len(m["words"])), m["n"]), m["count"], minlength=len(m["words"]))
        return pd.DataFrame({"p": [pdf["p"].iloc[0]], "data": [B.dumps(**m)], "tokens": [int(known.sum())], "words": [int((known > 0).sum())]})

    models = runtime.materialise(requests.groupBy("p").applyInPandas(merged, "p int, data binary, tokens long, words long"), "models")
    sums = models.agg(F.sum("tokens"), F.sum("words")).first()
    total, vocabulary = int(sums[0] or 0), int(sums[1] or 0)
    totals, discounts = _gather(models, {}, [0.5] * 3, vocabulary, 0)
    for sweep in range(SWEEPS):
        totals, _ = _gather(models, totals, discounts, vocabulary, sweep + 1)

    def respond(key, pdf: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(model):
            return pd.DataFrame({"block": [], "p": [], "data": []})
        p = int(pdf["p"].iloc[0])
        m = B.loads(model["data"].iloc[0])
        r = _Restaurants(m, totals, discounts, vocabulary)
        mean = np.zeros(len(r.count))
        for i in range(BURN + SAMPLES):
            r.sweep(np.random.default_rng([SWEEPS + 1, i, p]))
            if i >= BURN:
                mean += r.p2 / SAMPLES
        known = np.bincount(r.word, r.count, minlength=r.words).astype(np.int64)
        events = r.word << 16 | r.context
        out = []
        for data in pdf["data"]:
            q = B.loads(data)
            at = np.searchsorted(m["words"], q["words"])
            e = np.searchsorted(events, np.repeat(at, q["n"]) << 16 | q["context"])
            out.append(B.dumps(p=np.rint(np.log10(mean[e]) * STEPS).astype(np.int16), known=known[at]))
        return pd.DataFrame({"block": pdf["block"].to_numpy(), "p": pdf["p"].to_numpy(), "data": out})

    # a part's model goes to as many tasks as its blocks need
    salts = max(1, -(-packed.count() // ANSWER_BLOCKS))
    salted = requests.withColumn("salt", F.pmod(F.hash("block"), F.lit(salts)))
    copies = models.select("p", "data", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    answers = salted.groupBy("p", "salt").cogroup(copies.groupBy("p", "salt")).applyInPandas(respond, "block long, p int, data binary")
    answers = runtime.materialise(answers, "answers")
    runtime.discard(requests, models)

    def apply(table, got):
        t = _Tokens(table)
        logs, known = np.zeros(len(t.counts)), np.zeros(len(t.words), np.int64)
        for p, a, b in B.cuts(t.words, parts):
            x = B.loads(got[p])
            logs[t.first[a] : t.first[b]], known[a:b] = x["p"] / STEPS, x["known"]
        doc = np.repeat(np.arange(len(t.sizes)), t.sizes)
        base = np.log10((known + 1) / (total + vocabulary + 1))
        word = t.event_word[t.event]
        sums = [np.bincount(doc, x, minlength=len(t.sizes)) for x in (known[word] > 0, base[word], logs[t.event])]
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": table.column("doc_id").combine_chunks(),
                "held_out": table.column("held").combine_chunks(),
                "n_tokens": pa.array(t.sizes, pa.int64()),
                "n_known": pa.array(sums[0].astype(np.int64)),
                "train_tokens": pa.array(np.full(len(t.sizes), total), pa.int64()),
                "base_score": pa.array(sums[1]),
                "score": pa.array(sums[2]),
            }
        )

    return B.finish(packed, answers, apply, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
