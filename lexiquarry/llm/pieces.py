"""SentencePiece encoding and decoding with the Tokenizers library."""

from __future__ import annotations

import functools
import itertools
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: The blank's stand-in in pieces.
META = "▁"
#: Types of pieces in the model file (fixed values of the format).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Texts in a call of the library, and words that a worker remembers.
BATCH, CACHE = 512, 300_000
#: New words that are encoded together.
LINE = 32


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True

    @property
    def unknown(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    @property
    def words_apart(self) -> bool:
        """No piece goes on after a word's end, so words can be encoded one by one."""
        return not any(re.search(f"[^{META}]{META}", p) for p, _, _ in self.pieces)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = varint()
        if (wire := key & 7) == 0:
            yield key >> 3, varint()
            continue
        n = {1: 8, 5: 4}[wire] if wire in (1, 5) else varint()
        yield key >> 3, data[at : at + n]
        at += n


def parse(data: bytes) -> Model:
    """The parts of a model file that encoding depends on."""
    out = Model()
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            out.pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
            out.kind, out.byte_fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
        elif number == 3:
            rules = dict(_fields(value))
            out.charsmap = rules.get(2, b"")
            out.add_dummy_prefix, out.remove_extra_whitespaces, out.escape_whitespaces = (bool(rules.get(i, 1)) for i in (3, 4, 5))
    if any(kind in (USER_DEFINED, UNUSED) for _, _, kind in out.pieces):
        raise ValueError("models with user-defined or unused pieces are not supported")
    return out


def build(model: Model):
    """A tokenizer of the Tokenizers library that works as the model does, on texts that ``prepare`` has marked."""
    from tokenizers import Tokenizer, models, normalizers

    rank = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    unknown = model.pieces[model.unknown][0]
    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=model.unknown, byte_fallback=model.byte_fallback)
    else:
        scores = {p: s for p, s, kind in model.pieces if kind == NORMAL}
        # each split of a piece into two pieces is a merge; the merged piece's score orders them
        merges = [(-s, rank[p], p[:i], p[i:]) for p, s in scores.items() for i in range(1, len(p)) if p[:i] in scores and p[i:] in scores]
        core = models.BPE(rank, [(a, b) for _, _, a, b in sorted(merges)], unk_token=unknown, fuse_unk=True, byte_fallback=model.byte_fallback)
    out = Tokenizer(core)
    if model.charsmap:
        out.normalizer = normalizers.Precompiled(model.charsmap)
    return out


class Codec:
    """Encodes and decodes with one model; words are remembered in a cache of bounded size.

    The ids of remembered words lie in one pool; a text is a gather of the pool by its words' numbers, and a decoded
    text one of the pieces' bytes by its ids.
    """

    def __init__(self, data: bytes) -> None:
        self.model = parse(data)
        self.tokenizer = build(self.model)
        self.apart = self.model.words_apart and not self.model.charsmap
        self._word = re.compile(f"{META}+[^{META}]*|[^{META}]+")
        known = [self._written(p, kind) for p, _, kind in self.model.pieces]
        self._piece_at, self._piece_bytes = _pool(known)
        self._marked = np.array([p.startswith(META) for p, _, _ in self.model.pieces])
        self._forget()

    def _written(self, piece: str, kind: int) -> bytes:
        if kind == UNKNOWN:
            return " ⁇ ".encode()
        return b"" if kind == CONTROL else bytes([int(piece[3:5], 16)]) if kind == BYTE else piece.replace(META, " ").encode()

    def _forget(self) -> None:
        self.cache: dict[str, int] = {}
        self._word_at, self._word_ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def prepare(self, text: str) -> str:
        """Blanks become markers, as the model's normaliser would make them."""
        if self.model.charsmap:
            text = self.tokenizer.normalizer.normalize_str(text)
        if self.model.remove_extra_whitespaces:
            text = re.sub(" +", " ", text.strip(" "))
        if self.model.add_dummy_prefix and text:
            text = " " + text
        return text.replace(" ", META) if self.model.escape_whitespaces else text

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): the ids of text i lie between offsets i and i + 1. Words not yet known are encoded in one multithreaded batch."""
        if not self.apart:
            got = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch([self.prepare(t) for t in texts], add_special_tokens=False)]
            return np.cumsum([0, *map(len, got)]), np.concatenate([np.zeros(0, np.int32), *got])
        marked = [self.prepare(t) for t in texts]
        # words apart by one marker are split by Arrow; the others, which keep runs of markers, one by one
        plain = np.array([t[:1] == META and t[-1] != META and META * 2 not in t for t in marked], bool)
        quick = pc.split_pattern(pa.array([t[1:] for t, q in zip(marked, plain) if q], pa.string()), META)
        slow = [self._word.findall(t) for t, q in zip(marked, plain) if not q]
        sizes = np.zeros(len(texts), np.int64)
        sizes[plain], sizes[~plain] = np.diff(quick.offsets.to_numpy()), [len(x) for x in slow]
        coded = quick.flatten().dictionary_encode()
        names = [META + w for w in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
        rest = [*itertools.chain.from_iterable(slow)]
        self._learn(set(names).union(rest), names)
        by_name = np.array([self.cache[w] for w in names], np.int64)
        numbers = np.zeros(int(sizes.sum()), np.int64)
        own = np.repeat(plain, sizes)
        numbers[own], numbers[~own] = by_name[coded.indices.to_numpy()], [self.cache[w] for w in rest]
        ends, ids = _gather(self._word_at, self._word_ids, numbers)
        return ends[np.concatenate(([0], np.cumsum(sizes)))], ids

    def _learn(self, words: set[str], plain: list[str]) -> None:
        """Put the ids of new words into the pool. Those of one marker at their start (``plain``) are encoded in lines of ``LINE`` words, whose ids fall apart at the markers."""
        new = words.difference(self.cache)
        if len(self.cache) + len(new) > CACHE:
            self._forget()
            new = words
        quick = [w for w in plain if w in new]
        lines = ["".join(quick[i : i + LINE]) for i in range(0, len(quick), LINE)]
        slow = [*new.difference(quick)]
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(lines + slow, add_special_tokens=False)] if new else []
        flat = np.fromiter(itertools.chain.from_iterable(ids[: len(lines)]), np.int32)
        starts = np.flatnonzero(self._marked[flat])
        if len(starts) != len(quick):
            raise ValueError("a word's pieces don't begin with a marker")
        self.cache.update(zip(quick + slow, range(len(self.cache), len(self.cache) + len(new))))
        ends = np.cumsum([len(flat), *map(len, ids[len(lines) :])])
        self._word_at = np.concatenate((self._word_at, self._word_at[-1] + np.concatenate((starts[1:], ends if len(starts) else ends[1:]))))
        self._word_ids = np.concatenate((self._word_ids, flat, np.fromiter(itertools.chain.from_iterable(ids[len(lines) :]), np.int32)))

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> list[bytes]:
        """UTF-8 of the texts of ids: pieces, bytes of unknown characters, without the leading marker."""
        ends, raw = _gather(self._piece_at, self._piece_bytes, ids)
        raw, cut = raw.tobytes(), ends[offsets].tolist()
        out = [raw[a:b] for a, b in zip(cut, cut[1:])]
        if self.model.add_dummy_prefix:
            out = [x[1:] if x[:1] == b" " else x for x in out]
        return [x if _is_text(x) else x.decode(errors="replace").encode() for x in out]

    def parity(self, data: bytes, texts: list[str]) -> None:
        """Raises ValueError where the reference library would give other ids."""
        own = _library(data)
        at, ids = self.encode(texts)
        for i, (t, theirs) in enumerate(zip(texts, own.encode(texts, num_threads=1))):
            if ids[at[i] : at[i + 1]].tolist() != theirs:
                raise ValueError(f"ids differ from the model's for {t[:80]!r}")


def _pool(items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(([0], np.cumsum([len(x) for x in items]))), np.frombuffer(b"".join(items), np.uint8)


def _gather(at: np.ndarray, pool: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pool's items of the given numbers, one after another, and where each begins (and the last ends)."""
    sizes = at[numbers + 1] - at[numbers]
    ends = np.concatenate(([0], np.cumsum(sizes)))
    return ends, pool[np.repeat(at[numbers] - ends[:-1], sizes) + np.arange(ends[-1])]


def _is_text(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


@functools.lru_cache(maxsize=2)
def _library(data: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=data)


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    with open(path, "rb") as f:
        return Codec(f.read())


#: Texts on which each task compares the ids with those of the model's own library, before texts of its own.
PROBES = ["", " ", "a", "  two  blanks ", "line\nbreak\ttab", "été naïve straße İ", "\U0001f600 中文 की", f"a{META}b {META}{META}", "x" * 50, "THE 3.14% (of) <s> </s> <unk> <0x41>", "\u0000\u0001 　", "a " * 40]


def encode(docs: DataFrame, model: str = MODEL, verify: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, ids, n_tokens, n_unknown, n_bytes (pieces that are single bytes), decoded, lossless.

    A null text is an empty one; both give no ids. decoded is the text of the ids; lossless says whether it is the
    text itself (a model that joins blanks or normalises loses some). If ``verify``, a task compares ``PROBES`` and
    then the first of every ``BATCH`` texts, whole, with the model's own library, and fails at the first difference.
    User-defined and unused pieces are refused: the model's library gives them rules of their own.
    ``model`` is a path that all executors can read.
    """
    runtime.ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        kinds = np.array([k for _, _, k in c.model.pieces], np.int8)
        with open(model, "rb") as f:
            data = f.read()
        if verify:
            c.parity(data, PROBES)
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                part = b.slice(at, BATCH)
                texts = [t or "" for t in part.column("text").to_pylist()]
                if verify:
                    c.parity(data, texts[:1])
                offsets, ids = c.encode(texts)
                decoded = c.decode(offsets, ids)
                kind = kinds[ids]
                count = lambda k: np.diff(np.concatenate(([0], np.cumsum(kind == k)))[offsets])  # noqa: B023, E731
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column("doc_id"),
                        "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())),
                        "n_tokens": pa.array(np.diff(offsets)),
                        "n_unknown": pa.array(count(UNKNOWN), pa.int64()),
                        "n_bytes": pa.array(count(BYTE), pa.int64()),
                        "decoded": pa.array(decoded, pa.binary()).cast(pa.string()),
                        "lossless": pa.array([x == y.encode() for x, y in zip(decoded, texts)]),
                    }
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, n_unknown long, n_bytes long, decoded string, lossless boolean")


def decode(tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """One row per row of ``tokens`` (doc_id, ids): doc_id, text; null ids give an empty text."""
    runtime.ready(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            ids = [x or [] for x in b.column("ids").to_pylist()]
            texts = c.decode(np.cumsum([0, *map(len, ids)]), np.fromiter(itertools.chain.from_iterable(ids), np.int64))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "text": pa.array(texts, pa.binary()).cast(pa.string())})

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
