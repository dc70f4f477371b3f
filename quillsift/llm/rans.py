"""Static range asymmetric numeral system over token ids, for whole arrays of lanes at a time.

A segment holds one frequency table and many independent blocks. A block of ``BLOCK`` ids
is dealt over ``LANES`` interleaved coder states that share one stream of 32-bit words; its
directory entry (states, word count, checksum) is the checkpoint from which it is decoded
alone. States stay in [2^31, 2^63), so a step moves at most one word.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK, LANES = 16384, 32
_LOW = 31


def table(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct ids, their frequencies (each 1 at least, adding up to 2^bits), and bits."""
    symbols, counts = np.unique(ids, return_counts=True)
    bits = max(12, len(symbols).bit_length() + 3)
    if not len(symbols):
        return symbols.astype(np.uint32), counts.astype(np.uint32), bits
    room = 1 << bits
    f = np.maximum(1, counts * room // counts.sum()).astype(np.int64)
    over = int(f.sum()) - room
    by_size = np.argsort(-f, kind="stable")
    if over < 0:
        f[by_size[0]] -= over
    while over > 0:  # each symbol has an eighth of the room at most in ones, so halving always frees enough
        give = np.minimum(f[by_size] // 2, np.maximum(0, over - np.concatenate([[0], np.cumsum(f[by_size] // 2)[:-1]])))
        f[by_size] -= give
        over -= int(give.sum())
    return symbols.astype(np.uint32), f.astype(np.uint32), bits


def _shape(n: int) -> tuple[int, int, np.ndarray]:
    """Blocks, steps, and for each step how many lanes (in order of block and lane) have an id."""
    blocks = max(1, -(-n // BLOCK))
    steps = BLOCK // LANES
    rest = n - (blocks - 1) * BLOCK
    return blocks, steps, (blocks - 1) * LANES + np.clip(rest - np.arange(steps) * LANES, 0, LANES)


def encode(ids: np.ndarray) -> dict:
    """Table, states and words of all blocks of a segment."""
    symbols, freq, bits = table(ids)
    f64, cum = freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64)
    blocks, steps, active = _shape(len(ids))
    grid = np.zeros(blocks * BLOCK, np.int64)
    grid[: len(ids)] = np.searchsorted(symbols, ids)
    grid = np.ascontiguousarray(grid.reshape(blocks, steps, LANES).transpose(1, 0, 2)).reshape(steps, -1)
    state = np.full(blocks * LANES, 1 << _LOW, np.uint64)
    owner, stream = [], []
    up, shift, word = np.uint64(63 - bits), np.uint64(bits), np.uint64(32)
    for s in range(steps - 1, -1, -1):
        a = int(active[s])
        x, f = state[:a], f64[(i := grid[s, :a])]
        full = np.flatnonzero(x >= (f << up))[::-1]
        if len(full):
            owner.append(full // LANES)
            stream.append((x[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
            x[full] >>= word
        q = x // f
        state[:a] = (q << shift) + (x - q * f) + cum[i]
    owner = np.concatenate(owner)[::-1] if owner else np.zeros(0, np.int64)
    words = np.concatenate(stream)[::-1] if stream else np.zeros(0, np.uint32)
    order = np.argsort(owner.astype(np.uint16) if blocks < 65536 else owner, kind="stable")
    crc = [zlib.crc32(ids[b * BLOCK : (b + 1) * BLOCK].astype("<u4").tobytes()) for b in range(blocks)]
    return {"n": len(ids), "bits": bits, "symbols": symbols, "freq": freq, "states": state, "sizes": np.bincount(owner, minlength=blocks).astype(np.uint32), "crc": np.array(crc, np.uint32), "words": words[order]}


def decode(seg: dict, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks ``first`` to ``last`` (excluded; all by default). Raises ValueError if a block is damaged."""
    blocks, _, _ = _shape(seg["n"])
    last = blocks if last is None else last
    n = min(seg["n"], last * BLOCK) - first * BLOCK
    if n <= 0:
        return np.zeros(0, np.uint32)
    count, steps, active = _shape(n)
    bits, freq = seg["bits"], seg["freq"]
    f64, cum = freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64)
    slot_of = np.repeat(np.arange(len(freq), dtype=np.int32), freq)
    state = seg["states"][first * LANES : last * LANES].copy()
    begins = np.concatenate([[0], np.cumsum(seg["sizes"].astype(np.int64))])[first:last]
    words, at = seg["words"], begins.copy()
    grid = np.zeros((steps, count * LANES), np.int32)
    mask, shift, word, low = np.uint64((1 << bits) - 1), np.uint64(bits), np.uint64(32), np.uint64(1 << _LOW)
    for s in range(steps):
        a = int(active[s])
        if not a:
            break
        x = state[:a]
        slot = x & mask
        i = slot_of[slot.astype(np.int64)]
        x = f64[i] * (x >> shift) + slot - cum[i]
        need = np.flatnonzero(x < low)
        if len(need):
            block = need // LANES
            each = np.bincount(block, minlength=count)
            x[need] = (x[need] << word) | words[at[block] + np.arange(len(need)) - (np.cumsum(each) - each)[block]]
            at += each
        state[:a] = x
        grid[s, :a] = i
    ids = seg["symbols"][grid.reshape(steps, count, LANES).transpose(1, 0, 2).reshape(-1)[:n]]
    for b in range(count):
        if zlib.crc32(ids[b * BLOCK : (b + 1) * BLOCK].astype("<u4").tobytes()) != int(seg["crc"][first + b]):
            raise ValueError(f"block {first + b} is damaged")
    if (state != low).any():
        raise ValueError("a coder state did not return to its start")
    return ids
