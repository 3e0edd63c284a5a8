"""Substring dedup by repeated-phrase automata."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks as B
from . import recurrence as R
from . import runtime
from .hashing import anchors, words_of, word_hashes

WINDOW = 50
#: Words of a phrase that an automaton looks for. Phrases are taken from a document every WINDOW - PHRASE + 1 words, so each of its windows holds one.
PHRASE = 8
#: Phrases of an automaton at most.
SHARD = 1 << 16
_RUN = 1 << 20


class _Words:
    """Words of one block, and the phrases that its windows select."""

    def __init__(self, table: pa.Table, window: int, phrase: int, select: bool = True) -> None:
        self.ids, self.texts = B.texts(table)
        hashes, sizes = [np.zeros(0, np.uint64)], []
        for a, b in B.runs([len(t) + 1 for t in self.texts], _RUN):
            buf = np.frombuffer(b"\n".join(self.texts[a:b]), np.uint8)
            starts, ends = words_of(buf)
            cut = np.searchsorted(starts, np.cumsum([0, *[len(t) + 1 for t in self.texts[a:b]]]))
            hashes.append(word_hashes(buf, starts, ends))
            sizes.extend(np.diff(cut).tolist())
        self.words = np.concatenate(hashes)
        self.offset = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        if select:
            self.found = anchors(self.words, self.offset, window, phrase)
            self.doc = self.ids[np.searchsorted(self.offset, self.found[2], "right") - 1]


class Automaton:
    """Aho-Corasick automaton of phrases, as rows of word hashes.

    Words of the phrases get numbers, all others share the number 0; a number is written in digits of 64 symbols, with symbols of
    its own for each place, so nodes have few children and matches begin at words.
    """

    def __init__(self, phrases: np.ndarray) -> None:
        import ahocorasick

        self.length = phrases.shape[1]
        self.inside = np.unique(phrases)
        self.places = max(1, -(-len(self.inside).bit_length() // 6))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_STRING)
        keys, size = self._spelled(phrases.ravel()), self.length * self.places
        for x in range(0, len(keys), size):
            self.automaton.add_word(keys[x : x + size], True)
        self.automaton.make_automaton()

    def _spelled(self, words: np.ndarray) -> str:
        at = np.minimum(np.searchsorted(self.inside, words), len(self.inside) - 1)
        numbers = np.where(self.inside[at] == words, at + 1, 0)
        return np.stack([(numbers >> 6 * k & 63) + 64 * k for k in range(self.places)], axis=1).astype("<u4").tobytes().decode("utf-32-le")

    def occurrences(self, words: np.ndarray) -> np.ndarray:
        """Whether a phrase begins at each of ``words``, which are streamed in overlapping runs."""
        out = np.zeros(len(words), bool)
        step = _RUN // 4
        for a in range(0, len(words), step):
            ends = np.fromiter((e for e, _ in self.automaton.iter(self._spelled(words[a : a + step + self.length - 1]))), np.int64)
            out[a + (ends + 1) // self.places - self.length] = True
        return out


def found_in(words: np.ndarray, phrases: np.ndarray, finder: type[Automaton]) -> np.ndarray:
    """Whether one of ``phrases`` (rows) begins at each of ``words``: these are streamed through automata of at most SHARD phrases each."""
    out = np.zeros(len(words), bool)
    for a in range(0, len(phrases), SHARD):
        out |= finder(phrases[a : a + SHARD]).occurrences(words)
    return out


def repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, finder: type[Automaton] = Automaton) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, spans (word ranges removed), kept (the other words, joined by a blank).

    A word (a run of bytes other than ASCII white space) is removed if a window of ``window`` words that covers it
    has a word sequence that also starts in a document with a smaller doc_id; windows are judged on the
    input. Null texts have no words; null doc_ids are the smallest; rows that share a doc_id never
    remove words from each other; texts of fewer words than a window stay whole.

    First recurring passages are confirmed: windows go by their least phrase, those of phrases that two documents or more have form regions,
    equal regions collapse to the one of the least doc_id, and windows of phrases with several different regions are compared one by one in
    an aggregate. Then the documents in which confirmed passages begin are cut: every ``window - phrase + 1`` words they
    give a phrase, by place and not by content. These are dealt to the blocks of documents that hold the passage, each of which
    compiles them into Aho-Corasick automata of bounded size and streams all its words through. Only confirmed windows that
    hold a phrase which an automaton found, wherever it found it, are removed. (Shards by phrase would each have to stream all
    documents, which grows with the square of the corpus; a block only streams itself, through the phrases of its own passages.)
    """
    if not phrase < window <= phrase + 63:
        raise ValueError("a phrase must be shorter than the window, by 63 words at most")
    packed, stride = B.pack(docs), window - phrase + 1

    def ask(block: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        s = _Words(table, window, phrase)
        by = np.argsort(s.found[0], kind="stable")
        h, doc = s.found[0][by], s.doc[by]
        heads = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
        low, high = (f.reduceat(doc, heads) if len(heads) else doc for f in (np.minimum, np.maximum))
        n = np.diff(np.append(heads, len(h)))
        yield pa.RecordBatch.from_pydict({"h": pa.array(h[heads].view(np.int64)), "block": pa.array(np.full(len(heads), block)), "low": pa.array(low), "high": pa.array(high), "many": pa.array(np.minimum(n, 2), pa.int32())})

    def regions(block: int, table: pa.Table, got: pa.Array) -> Iterator[pa.RecordBatch]:
        s = _Words(table, window, phrase)
        yield R.Regions(s.words, window, s.found, np.isin(s.found[0], got.to_numpy().view(np.uint64)), s.ids, s.offset, places=False).rows(block)

    def cut(table: pa.Table, starts: np.ndarray, windows: np.ndarray) -> pa.ListArray:
        words = _Words(table, window, phrase, select=False).words
        ends = np.cumsum(windows)
        each = np.repeat(starts - (ends - windows), windows) + np.arange(ends[-1])
        by = np.argsort(each, kind="stable")
        ws = np.empty(len(each), np.int64)
        ws[by] = R.spans(words, each[by], each[by] + window).view(np.int64)
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ws))

    found, first = R.firsts(packed, ask, regions, documents=True)
    leads = R.leads(packed, found, first, cut, "ws array<bigint>")
    bits = runtime.materialise(R.by_windows(leads, places=False), "bits", settle=True)

    def strided(table: pa.Table, starts: np.ndarray, windows: np.ndarray) -> pa.Array:
        """The phrases of the windows that begin at ``starts``, by their documents' places; words as halves of their hashes."""
        s = _Words(table, window, phrase, select=False)
        begin = s.offset[np.searchsorted(s.offset, starts, "right") - 1]
        low, high = -(-(starts - begin) // stride), (starts - begin + windows - 1 + stride - 1) // stride
        n = high - low + 1
        at = np.repeat(begin + low * stride, n) + stride * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        data = s.words[at[:, None] + np.arange(phrase)].astype("<u4").tobytes()
        ends = np.concatenate(([0], np.cumsum(n))) * phrase * 4
        return pa.array([data[a:b] for a, b in zip(ends, ends[1:])], pa.binary())

    confirmed = R.told(found, first, bits)
    wanted = first.select("h", "r", "block", "idx").join(confirmed.select("h", "r").distinct(), ["h", "r"])
    dealt = R.cut_out(packed, found, wanted, ("h", "r"), strided, "phrases binary", "phrases")
    told = R.answers(found, confirmed.join(dealt, ["h", "r"]), ("phrases",))
    runtime.discard(found, first, leads, bits, dealt)

    def apply(_: int, table: pa.Table, scan: bytes | None, got: pa.StructArray | None) -> Iterator[pa.RecordBatch]:
        ids, texts = B.texts(table)
        split = [t.split() for t in texts]
        offset = np.concatenate(([0], np.cumsum([len(x) for x in split]))).astype(np.int64)
        own = R.repeated(scan, got, ids, offset, places=False)
        if got is not None:
            phrases = np.frombuffer(b"".join(got.field("phrases").to_pylist()), "<u4").reshape(-1, phrase)
            matches = found_in(_Words(table, window, phrase, select=False).words.astype("<u4"), np.unique(phrases, axis=0), finder)
            before = np.concatenate(([0], np.cumsum(matches), np.full(stride, matches.sum())))
            own[: len(matches)] &= before[stride : stride + len(matches)] > before[: len(matches)]
        starts = np.flatnonzero(own)
        # words covered by a repeated window; windows stay within their documents
        edge = np.zeros(int(offset[-1]) + window + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + window, -1)
        gone = np.cumsum(edge)[: offset[-1]] > 0
        n, removed, cuts, kept = np.diff(offset), [], [], []
        for words, a, b in zip(split, offset, offset[1:]):
            own = gone[a:b]
            step = np.flatnonzero(np.diff(np.concatenate(([False], own, [False])).astype(np.int8))).tolist()
            spans = list(zip(step[::2], step[1::2]))
            removed.append(int(own.sum()))
            cuts.append([{"start": x, "end": y} for x, y in spans])
            for x, y in reversed(spans):
                del words[x:y]
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": table.column("doc_id").combine_chunks(),
                "n_words": pa.array(n, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "spans": pa.array(cuts, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                "kept": pa.array(kept, pa.binary()),
            }
        )

    return R.with_blocks(packed, told, apply, "doc_id long, n_words long, n_removed long, spans array<struct<start:bigint,end:bigint>>, kept binary")
