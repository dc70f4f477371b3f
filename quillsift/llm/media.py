"""Media columns: content-addressed pictures in tar shards, read back by byte ranges.

A payload (here: a text's bytes, filled up with 255 to whole rows of 576) is stored
without loss as an 8-bit grey PNG of 576 columns. Each task appends its pictures to tar
shards in the shared folder, named by digest, a picture once per shard; rows carry
digest, shard, offset and length. Metadata columns come from range reads of the first 33
bytes alone; features from the decoded samples.

A shard's name is unique to the attempt that writes it, and rows become visible only when
Spark commits them, so a lost or repeated task leaves at most an unused file behind.
Equal pictures in different shards are stored again: gathering them would move the payloads.

Defined cases: null and empty texts give one row of fill bytes; equal texts give equal
digests, metadata and features, also where rows repeat; a very long text is one tall picture; an
empty table gives an empty result and no shard; only ``doc_id`` and ``text`` are read, so further
columns of any name do no harm.
"""

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

from quillsift.llm import pieces
from quillsift.llm.common import fresh_path, staged

WIDTH = 576
FILL = 255
#: A shard is closed once it holds so many bytes.
SHARD_BYTES = 64 << 20
#: Bytes of a PNG that hold its signature and header chunk.
HEADER = 33
_SIGN = b"\x89PNG\r\n\x1a\n"


def payload_of(raw: bytes) -> bytes:
    """``raw`` and fill bytes up to a positive multiple of WIDTH."""
    return raw.ljust(max(1, -(-len(raw) // WIDTH)) * WIDTH, bytes([FILL]))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # a zero in front of each line: unfiltered
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGN + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 5)) + _chunk(b"IEND", b"")


def header_png(head: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from the first HEADER bytes."""
    if head[:8] != _SIGN or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", head[16:25])


def decode_png(stored: bytes) -> bytes:
    """The samples; every chunk's checksum is tested. Only unfiltered lines occur here."""
    width, height, _ = header_png(stored[:HEADER])
    at, data = HEADER, []
    while at < len(stored):
        size = struct.unpack(">I", stored[at : at + 4])[0]
        body = stored[at + 4 : at + 8 + size]
        if zlib.crc32(body) != struct.unpack(">I", stored[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("PNG chunk is damaged")
        if body[:4] == b"IDAT":
            data.append(body[4:])
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines are not expected")
    return lines[:, 1:].tobytes()


def features(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, and a 64-bit hash of whether each of 64 stretches is above the mean."""
    x = np.frombuffer(payload, np.uint8)
    n = np.bincount(x, minlength=256)
    p = n[n > 0] / len(x)
    cells = np.add.reduceat(x, np.arange(64) * len(x) // 64, dtype=np.int64) * 64
    mark = np.packbits(cells > x.sum(dtype=np.int64)).tobytes().hex()
    return f"{x.mean():.4f},{x.std():.4f},{-(p * np.log2(p)).sum():.4f},{mark}"


class ShardWriter:
    """Tar shards of one task."""

    def __init__(self, folder: str):
        self.fs, self.folder = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.out = None

    def put(self, digest: str, payload: bytes) -> tuple[str, int, int]:
        """Shard, offset and length of the picture with this digest."""
        if self.out is None:
            self.name, self.at, self.seen = f"shard-{uuid.uuid4().hex}.tar", 0, {}
            self.out = self.fs.open_output_stream(f"{self.folder}/{self.name}")
        if digest not in self.seen:
            stored = encode_png(payload)
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(stored)
            head = info.tobuf(tarfile.GNU_FORMAT)
            self.out.write(head + stored + bytes(-len(stored) % 512))
            self.seen[digest] = (self.name, self.at + len(head), len(stored))
            self.at += len(head) + len(stored) + -len(stored) % 512
        got = self.seen[digest]
        if self.at >= SHARD_BYTES:
            self.close()
        return got

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
            self.out = None


def store(docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, digest, shard, offset, length; the pictures lie in tar shards below ``folder``."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = ShardWriter(folder)
        for batch in batches:
            for part in pieces.slices(batch, "text"):
                data, bounds = pieces.buffers(part.column("text"))
                raw, rows = data.tobytes(), []
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    payload = payload_of(raw[a:b])
                    digest = hashlib.sha256(payload).hexdigest()
                    rows.append((digest, *shards.put(digest, payload)))
                digest, shard, offset, length = zip(*rows)
                yield pa.record_batch([part.column("doc_id"), pa.array(digest), pa.array(shard), pa.array(offset, pa.int64()), pa.array(length, pa.int64())], ["doc_id", "digest", "shard", "offset", "length"])
        shards.close()

    return staged(docs.select("doc_id", "text").mapInArrow(write, "doc_id long, digest string, shard string, offset long, length long"), "media-rows")


def read(rows: DataFrame, folder: str, what: str, columns: str) -> DataFrame:
    """Range reads for rows of :func:`store`, shard by shard in order of offset, a picture once.
    ``what``: "header" for width, height and bit depth alone, "whole" for these and everything from the samples."""
    stored = rows.agg(F.sum("length")).first()[0] or 0
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism * 4, stored // SHARD_BYTES)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, base = fs.FileSystem.from_uri(folder)
        shard, source, last, got = None, None, None, ()
        for batch in batches:
            out = []
            for name, at, size in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length"))):
                if name != shard:
                    shard, source = name, disk.open_input_file(f"{base}/{name}")
                if last != (name, at):
                    last = (name, at)
                    got = header_png(source.read_at(HEADER, at))
                    if what == "whole":
                        stored = source.read_at(size, at)
                        payload = decode_png(stored)
                        got += (len(payload.rstrip(bytes([FILL]))), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), features(payload))
                out.append(got)
            values = [pa.array(v) for v in zip(*out)] if out else []
            if values:
                kept = [batch.column(c) for c in ("doc_id", "digest")]
                names = ["doc_id", "digest", *[c.split()[0] for c in columns.split(", ")]]
                yield pa.record_batch([*kept, *[v.cast(pa.int64()) if pa.types.is_integer(v.type) else v for v in values]], names)

    near = rows.repartition(int(tasks), "shard").sortWithinPartitions("shard", "offset")
    return near.mapInArrow(fill, f"doc_id long, digest string, {columns}")


META = "width long, height long, bit_depth long"
WHOLE = META + ", n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_table(docs: DataFrame) -> DataFrame:
    """Store every text, read the stored bytes back and describe them."""
    folder = fresh_path(docs.sparkSession, "media")
    out = read(store(docs, folder), folder, "whole", WHOLE)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")


def metadata(rows: DataFrame, folder: str) -> DataFrame:
    """Header fields of stored pictures; reads HEADER bytes of each."""
    return read(rows, folder, "header", META)
