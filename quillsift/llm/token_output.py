"""Token ids of a corpus in binary segments, compressed by :mod:`rans`, and their reader.

Documents are ordered by id across the files (ranges of ids, sorted inside; null ids first,
equal ids by a hash of the text). Each task tokenises its range and closes a segment at the
first document end after ``SEGMENT`` ids: memory does not grow with the range. A segment
carries its frequency table, its documents' ids and lengths, its blocks and checksums, and
can be read without the others. File names are unique to the attempt, so repeated tasks do
no harm; the table of segments says which count.

Defined cases: a null or empty text has the end id alone; repeated ids are kept, each row
for itself, in the order of their texts' ids; a very long text makes a segment of its own size, in
blocks like any other; an empty table gives no segment; only ``doc_id`` and ``text`` are read, so
further columns of any name do no harm.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillsift.llm import pieces, rans
from quillsift.llm.common import fresh_path, join_small, staged
from quillsift.llm.tokens import encoder, vocabulary_path

SEGMENT = 2 << 20
#: Segments that one task reads where there are more than the cores need to be busy.
PER_TASK = 64
MAGIC = b"QSSEG001"
_PARTS = (("doc_ids", "<i8"), ("null_ids", "u1"), ("lengths", "<i8"), ("symbols", "<u4"), ("freq", "<u4"), ("states", "<u8"), ("sizes", "<u4"), ("crc", "<u4"), ("words", "<u4"))


def pack(doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One segment: magic, header length, JSON header with the checksum of each part, then the parts."""
    seg = rans.encode(ids)
    seg |= {"doc_ids": np.array([d or 0 for d in doc_ids], np.int64), "null_ids": np.array([d is None for d in doc_ids], np.uint8), "lengths": lengths}
    body = [np.ascontiguousarray(seg[k]).astype(kind).tobytes() for k, kind in _PARTS]
    head = json.dumps({"n": seg["n"], "bits": seg["bits"], "parts": [[len(b), zlib.crc32(b)] for b in body]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *body])


def unpack(raw: bytes) -> dict:
    """A segment's arrays; raises ValueError if a part is damaged."""
    if raw[:8] != MAGIC:
        raise ValueError("not a token segment")
    at = 12 + struct.unpack("<I", raw[8:12])[0]
    head = json.loads(raw[12:at])
    seg = {"n": head["n"], "bits": head["bits"]}
    for (name, kind), (size, crc) in zip(_PARTS, head["parts"]):
        part = raw[at : at + size]
        if zlib.crc32(part) != crc:
            raise ValueError(f"{name} is damaged")
        seg[name] = np.frombuffer(part, kind)
        at += size
    return seg


def write(docs: DataFrame, folder: str, vocabulary: str, end: int) -> DataFrame:
    """Tokenise and write every text; returns the staged table of segments (part, seq, file, offset, length, tokens, docs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, base = fs.FileSystem.from_uri(folder)
        disk.create_dir(base, recursive=True)
        part, name, out = TaskContext.get().partitionId(), f"tokens-{uuid.uuid4().hex}.bin", None
        enc = encoder(vocabulary_path(vocabulary))
        rows, held, ids, sizes, docs_in = [], 0, [], [], []

        def flush() -> None:
            nonlocal held, ids, sizes, docs_in, out
            raw = pack(docs_in, np.concatenate(sizes), np.concatenate(ids))
            out = out or disk.open_output_stream(f"{base}/{name}")
            out.write(raw)
            rows.append((part, len(rows), name, rows[-1][3] + rows[-1][4] if rows else 0, len(raw), held, len(docs_in)))
            held, ids, sizes, docs_in = 0, [], [], []

        for batch in batches:
            for piece in pieces.slices(batch, "text"):
                got, n = enc.ids(piece.column("text"))
                ends = np.cumsum(n)
                mine = np.insert(got, ends, np.uint32(end))
                n, ends, names, lo = n + 1, ends + np.arange(1, len(n) + 1), piece.column("doc_id").to_pylist(), 0
                while lo < len(n):
                    done = ends[lo - 1] if lo else 0
                    hi = min(len(n), int(np.searchsorted(ends, done + SEGMENT - held)) + 1)
                    ids.append(mine[done : ends[hi - 1]])
                    sizes.append(n[lo:hi])
                    docs_in += names[lo:hi]
                    held += int(ends[hi - 1] - done)
                    lo = hi
                    if held >= SEGMENT:
                        flush()
        if docs_in:
            flush()
        if out is not None:
            out.close()
            part, seq, file, offset, length, tokens, n = zip(*rows)
            yield pa.record_batch([pa.array(part, pa.int32()), pa.array(seq, pa.int32()), pa.array(file), *[pa.array(v, pa.int64()) for v in (offset, length, tokens, n)]], ["part", "seq", "file", "offset", "length", "tokens", "docs"])

    tie = F.xxhash64("text")
    near = docs.select("doc_id", "text").repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    return staged(near.mapInArrow(run, "part int, seq int, file string, offset long, length long, tokens long, docs long"), "segments")


def placed(segments: DataFrame) -> DataFrame:
    """Segments with ``base``, the ids in all segments before; the outer window runs over one row a part."""
    parts = segments.groupBy(F.col("part").alias("of")).agg(F.sum("tokens").alias("t"))
    before = F.coalesce(F.sum("t").over(Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = staged(parts.select("of", before.alias("front")), "segment-parts")
    inside = F.coalesce(F.sum("tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return join_small(segments.withColumn("inside", inside), parts, F.col("part") == F.col("of")).select("file", "offset", "length", (F.col("front") + F.col("inside")).alias("base"))


def read(segments: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files; a task has many segments and reads one at a time."""
    n = segments.count()
    tasks = max(1, min(n, 4 * segments.sparkSession.sparkContext.defaultParallelism), -(-n // PER_TASK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with disk.open_input_file(f"{root}/{row['file']}") as f:
                    seg = unpack(f.read_at(row["length"], row["offset"]))
                ids, n = rans.decode(seg).astype("<u4"), seg["lengths"]
                ends = np.cumsum(n)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * (b - a) : 4 * b]) for a, b in zip(n.tolist(), ends.tolist())]
                names = pa.array(seg["doc_ids"], mask=seg["null_ids"].astype(bool))
                yield pa.record_batch([names, pa.array(row["base"] + ends - n), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed(segments).repartition(tasks).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end: int = 2) -> DataFrame:
    """Write the whole corpus and describe every document from the files."""
    folder = fresh_path(docs.sparkSession, "tokens")
    return read(write(docs, folder, vocabulary, end), folder)
