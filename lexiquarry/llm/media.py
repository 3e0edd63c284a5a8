"""Media columns: content-addressed payloads in tar shards, described by header-only range reads."""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime

#: Samples in a row of the picture; payloads are padded with blanks to a positive multiple of it.
WIDTH = 192
#: Bytes of a member that hold its signature and header.
HEADER_BYTES = 33
#: Bytes of a tar shard, after which a task begins the next.
SHARD_BYTES = 256 << 20
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload_of(raw: bytes) -> bytes:
    return raw + b" " * (-len(raw) % WIDTH or (0 if raw else WIDTH))


def encode(payload: bytes) -> bytes:
    """The payload as the samples of an 8-bit grey PNG picture, WIDTH samples wide. Equal payloads give equal bytes."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = b"".join(b"\0" + payload[i : i + WIDTH] for i in range(0, len(payload), WIDTH))
    head = struct.pack(">IIBBBBB", WIDTH, len(payload) // WIDTH, 8, 0, 0, 0, 0)
    return _SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows, 6)) + chunk(b"IEND", b"")


def header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample, from the first HEADER_BYTES bytes."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG picture")
    width, height, depth = struct.unpack(">IIB", head[16:25])
    return width, height, depth


def decode(media: bytes) -> bytes:
    """The samples of a picture of ``encode``; a damaged one raises ValueError."""
    width, height, _ = header(media)
    at, packed = 8, []
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        data = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + data) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("checksum of a chunk")
        if kind == b"IDAT":
            packed.append(data)
        at += 12 + n
    rows = zlib.decompress(b"".join(packed))
    if len(rows) != height * (width + 1):
        raise ValueError("number of samples")
    return b"".join(rows[i + 1 : i + 1 + width] for i in range(0, len(rows), width + 1))


class TarShard:
    """A tar file that is written front to back; members are named by their SHA-256 and stored once."""

    def __init__(self, folder: str) -> None:
        self.path = f"{folder}/{uuid.uuid4().hex}.tar"
        self._fs, where = fs.FileSystem.from_uri(self.path)
        self._fs.create_dir(where.rpartition("/")[0], recursive=True)
        self._out = self._fs.open_output_stream(where)
        self._at = 0
        self._known: dict[bytes, tuple[int, int]] = {}

    def add(self, media: bytes) -> tuple[str, int, int]:
        digest = hashlib.sha256(media).digest()
        if digest not in self._known:
            info = tarfile.TarInfo(f"{digest.hex()}.png")
            info.size = len(media)
            head = info.tobuf(tarfile.USTAR_FORMAT)
            self._out.write(head + media + b"\0" * (-len(media) % 512))
            self._known[digest] = self._at + len(head), len(media)
            self._at += len(head) + len(media) + -len(media) % 512
        return digest.hex(), *self._known[digest]

    @property
    def size(self) -> int:
        return self._at

    def close(self) -> None:
        self._out.write(b"\0" * 1024)
        self._out.close()


class RangeReader:
    """Range reads from shards; the last shard stays open."""

    def __init__(self) -> None:
        self._path, self._file = None, None

    def __call__(self, path: str, offset: int, length: int) -> bytes:
        if path != self._path:
            self.close()
            system, where = fs.FileSystem.from_uri(path)
            self._file, self._path = system.open_input_file(where), path
        return self._file.read_at(length, offset)

    def close(self) -> None:
        if self._file:
            self._file.close()
        self._path = self._file = None


def store(docs: DataFrame, folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Store the text of each row; one row per row: doc_id, n_bytes, digest, shard, offset, length.

    Each task writes its own shards and holds every distinct payload once in a shard; nothing is
    shuffled. Shards have names of their own for each attempt, and only the rows of attempts that
    were committed reach the table returned, so a lost executor leaves an orphan file at worst.
    A null text is stored as an empty one, which is WIDTH blanks; repeated rows share a payload.
    """
    spark = docs.sparkSession
    runtime.ready(spark)
    folder = folder or runtime.fresh_path(spark, "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for b in batches:
            out = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
                raw = text or b""
                if shard is None:
                    shard = TarShard(folder)
                out.append((doc_id, len(raw), *_addressed(shard, raw)))
                if shard.size >= shard_bytes:
                    shard.close()
                    shard = None
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 6, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        if shard is not None:
            shard.close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return runtime.materialise(rows.mapInArrow(run, "doc_id long, n_bytes long, digest string, shard string, offset long, length long"), "media-index")


def _addressed(shard: TarShard, raw: bytes) -> tuple[str, str, int, int]:
    digest, offset, length = shard.add(encode(payload_of(raw)))
    return digest, shard.path, offset, length


def catalogue(index: DataFrame) -> DataFrame:
    """One address for each digest: digest, shard, offset, length, n_rows."""
    return index.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("a"), F.count("*").alias("n_rows")).select("digest", "a.*", "n_rows")


def metadata(index: DataFrame) -> DataFrame:
    """Adds width, height, bits, read from the header bytes alone of each payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = RangeReader()
        for b in batches:
            found = [header(read(s, o, min(n, HEADER_BYTES))) for s, o, n in zip(*(b.column(c).to_pylist() for c in ("shard", "offset", "length")))]
            columns = [pa.array(x, pa.int32()) for x in (zip(*found) if found else [[]] * 3)]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], names=[*b.schema.names, "width", "height", "bits"])
        read.close()

    return index.mapInArrow(run, index.schema.simpleString()[7:-1].replace(":", " ") + ", width int, height int, bits int")


def read_back(described: DataFrame) -> DataFrame:
    """Reads the stored bytes of each row: adds payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    feature joins what the header says with the mean sample (two decimals) and the number of distinct samples.
    Stored bytes that don't match their digest raise ValueError.
    """

    def features(read: RangeReader, digest: str, shard: str, offset: int, length: int, width: int, height: int, bits: int) -> tuple:
        media = read(shard, offset, length)
        own = hashlib.sha256(media).hexdigest()
        if own != digest:
            raise ValueError(f"{shard} at {offset}: stored bytes differ from their digest")
        payload = decode(media)
        counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
        mean = int(counts @ np.arange(256)) * 100 // len(payload)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), own, f"png:{width}x{height}x{bits}:mean={mean // 100}.{mean % 100:02d}:distinct={int((counts > 0).sum())}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, seen = RangeReader(), {}
        for b in batches:
            out = []
            for row in zip(*(b.column(c).to_pylist() for c in ("digest", "shard", "offset", "length", "width", "height", "bits"))):
                if row[:3] not in seen:
                    if len(seen) > 10_000:
                        seen.clear()
                    seen[row[:3]] = features(read, *row)
                out.append(seen[row[:3]])
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 6, types)]], names=[*b.schema.names, "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
        read.close()

    return described.mapInArrow(run, described.schema.simpleString()[7:-1].replace(":", " ") + ", payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_columns(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Store, describe by headers, read back: one row per row of ``docs`` with all columns of the three steps."""
    return read_back(metadata(store(docs, folder)))
