"""Array kernels that cut whole batches of UTF-8 text into words or pre-tokens without per-character Python."""

from __future__ import annotations

import ctypes
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts of a batch are worked on in slices of about so many bytes (one text at least).
SLICE_BYTES = 4 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows whose ``column`` holds about ``limit`` bytes; nulls in it become empty."""
    at = batch.schema.get_field_index(column)
    batch = batch.set_column(at, column, pc.fill_null(batch.column(at), ""))
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.binary_length(batch.column(at)).to_numpy(zero_copy_only=False).astype(np.int64))
    lo, done = 0, 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield batch.slice(lo, hi - lo)
        lo, done = hi, int(ends[hi - 1])
    release()


def release() -> None:
    """Give freed memory back to the system. Workers live on from stage to stage, and what allocators keep for themselves counts as theirs."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_libc(), "malloc_trim", None)
    if trim is not None:
        trim(0)


@lru_cache(maxsize=1)
def _libc():
    try:
        return ctypes.CDLL(None)
    except OSError:  # a system without such a library
        return None


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins (and the last ends)."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def as_binary(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Pieces that follow each other without gaps, as one Arrow array."""
    offsets = np.append(starts, len(data)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def words(data: np.ndarray, bounds: np.ndarray, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """Runs of non-space bytes (ASCII white space), A-Z lower-cased; and each text's first word's number."""
    keep = ~_SPACE[data]
    start = keep.copy()
    start[1:] &= ~keep[:-1]
    firsts = bounds[:-1][np.diff(bounds) > 0]
    start[firsts] = keep[firsts]
    of = np.searchsorted(np.flatnonzero(start), bounds)
    kept = data[keep]
    return as_binary(_LOWER[kept] if lower else kept, np.flatnonzero(start[keep])), of


def points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each character of two bytes or more begins, how many bytes it has, and its code point."""
    at = np.flatnonzero(data >= 0xC0)
    size = 2 + (data[at] >= 0xE0).astype(np.int64) + (data[at] >= 0xF0)
    cp = data[at].astype(np.int64) & (0x7F >> size)
    for i in (1, 2, 3):
        more = size > i
        cp[more] = cp[more] << 6 | (data[at[more] + i] & 0x3F)
    return at, size, cp


def spread(out: np.ndarray, at: np.ndarray, size: np.ndarray, values: np.ndarray) -> None:
    """Give every byte of the characters at ``at`` its character's value."""
    for i in range(4):
        more = size > i
        out[at[more] + i] = values[more]


def coded(pieces: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Number of each piece in the list of distinct pieces, and that list."""
    d = pc.dictionary_encode(pieces)
    return d.indices.to_numpy(zero_copy_only=False), d.dictionary


# --- pre-tokens of the byte-level BPE: contractions, letters, numbers, other, white space ---

_S, _L, _N, _O, _UNKNOWN = range(5)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """The kind of every code point; one that Python's Unicode tables leave unassigned is unknown, as the library's may be newer."""
    out = np.full(sys.maxunicode + 1, _O, np.uint8)
    marks = np.frombuffer("".join(map(unicodedata.category, map(chr, range(len(out))))).encode(), np.uint8).reshape(-1, 2)
    out[marks[:, 0] == ord("L")] = _L
    out[marks[:, 0] == ord("N")] = _N
    out[(marks[:, 0] == ord("C")) & (marks[:, 1] == ord("n"))] = _UNKNOWN
    out[marks[:, 0] == ord("Z")] = _S
    out[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85]] = _S
    return out


def pre_tokens(data: np.ndarray, bounds: np.ndarray, specials: re.Pattern[bytes] | None = None, ask: Callable[[str], int] | None = None) -> tuple[pa.Array, np.ndarray]:
    """Pieces of texts, and each text's first piece's number.

    A piece is a run of one kind with at most one blank in front; of a longer white-space
    run before something, the last character stands apart (or is that blank); an apostrophe
    that opens a piece takes s, t, m, d, re, ve or ll with it. Each match of ``specials`` is
    a piece, and what stands before and behind it are texts of their own. ``ask`` gives the
    kind of a character that Python does not know; it is asked once.
    """
    n = len(data)
    if not n:
        return as_binary(data, np.zeros(0, np.int64)), np.zeros(len(bounds), np.int64)
    table = _kinds()
    kind = table[:256][data]
    lead, size, cp = points(data)
    if ask is not None:
        for c in np.unique(cp[table[cp] == _UNKNOWN]).tolist():
            table[c] = ask(chr(c))
    spread(kind, lead, size, table[cp])
    edges, whole = bounds[:-1][np.diff(bounds) > 0], []
    if specials is not None:
        raw, ends = data.tobytes(), bounds.tolist()
        whole = [m.span() for m in specials.finditer(raw)]
        inside = np.searchsorted(bounds, [a for a, _ in whole], "right")
        whole = [(a, b) for (a, b), i in zip(whole, inside.tolist()) if b <= ends[i]]
        edges = np.unique(np.concatenate([edges, [x for ab in whole for x in ab if x < n]]).astype(np.int64))
    start = np.ones(n, bool)
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    first = np.zeros(n + 4, bool)
    first[edges] = True
    first[n:] = True
    start |= first[:n]
    runs = np.flatnonzero(start & (kind != _S) & ~first[:n])
    runs = runs[kind[runs - 1] == _S]
    last = runs - 1
    for _ in range(3):
        last = last - ((data[last] & 0xC0) == 0x80)
    start[last] = True
    start[runs[data[runs - 1] == 0x20]] = False
    quote = np.flatnonzero((data == 0x27) & start)
    quote = quote[~first[quote + 1]]
    quote = quote[kind[quote + 1] == _L]
    if len(quote):
        tail = np.concatenate([data, np.zeros(4, np.uint8)])
        a = tail[quote + 1]
        b = np.where(first[quote + 2], 0, tail[quote + 2])
        size = np.where(np.isin(a, list(b"stmd")), 2, np.where(((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")), 3, 0))
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        rest = quote + size
        rest = rest[~first[rest]]
        start[rest[kind[rest] == _L]] = True
    for a, b in whole:
        start[a + 1 : b] = False
    starts = np.flatnonzero(start)
    return as_binary(data, starts), np.searchsorted(starts, bounds)
