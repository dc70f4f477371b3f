"""Benchmark passages in documents, with edits, by q-gram lemma filtering.

Texts are compared as characters (code points) with A-Z lower-cased and white space as single
blanks. To find candidates, and for that alone, long repetitions such as ``-----`` or ``. . . .`` are cut to a few
characters; edits are counted between the texts as they are. An item is cut twice: into overlapping windows of
``WINDOW`` characters (shorter items are one window), for whole passages whose edits are spread unevenly, and into windows of
``SHORT`` characters every ``SHORT_STEP``, so that a copied stretch of ``SHORT + SHORT_STEP - 1``
characters holds a whole window wherever it lies. A region within ``k`` edits of a window keeps
all but ``k * Q`` of any set of its q-grams, on k + 1 neighbouring diagonals. So the q-grams that
a text shares with the benchmark are counted by window and overlapping diagonal band, bands that
reach the bound are regions, and a region is confirmed by an alignment along the band, of the whole texts
with their repetitions. A window may have as many edits as its length without what was cut allows. An edit within a
repetition that is cut can hide the windows that hold it; the item's other windows are not touched.

A q-gram that stands in more than ``COMMON`` places is left out of the set that is counted, as long
as the window's other q-grams suffice for the bound; windows that consist of little else are
counted with all of theirs, equal ones once. Hits are expanded in steps of ``STEP_HITS`` places,
so no text takes more memory than another. Texts are searched in slices of ``SLICE_BYTES``, as the
arrays of a slice take about 45 times its bytes.

Items of fewer than ``LEAST`` characters allow no edit and hold too few q-grams for a bound. They are
searched verbatim, between characters that are neither letters nor digits.

The benchmark's index travels to the tasks in portions of at most ``PORTION`` bytes of items,
counted before; an index holds about 40 bytes for each of them. A larger benchmark takes more
passes over the documents.

Defined cases: null and empty texts match nothing; items without text, without a letter or digit
(fewer than LEAST characters) or without an id are left out; equal items are each reported;
repeated rows are each reported; ties do not arise, every item is judged by itself; a very long
text is searched whole; no item or no document gives an empty result; further columns of any
name are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm import pieces
from quillsift.llm.common import content_bytes

Q = 12
#: Edits allowed for a character of a window.
EDITS = 0.05
WINDOW, STEP = 200, 100
SHORT, SHORT_STEP = 80, 20
#: From here on the lemma's bound is above zero with the edits allowed.
LEAST = 32
#: For candidates, repetitions of up to so many characters are cut to so many characters more than one period.
PERIOD, AGAIN = 4, 8
COMMON, STEP_HITS = 64, 1 << 17
PORTION, SLICE_BYTES = 4 << 20, 1 << 20
_BITS = 22


def normal(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points, A-Z lower-cased, with each run of white space as one blank and none at a text's start; and the new bounds."""
    blank = pieces._SPACE[data]
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    firsts = bounds[:-1][np.diff(bounds) > 0]
    keep[firsts] = ~blank[firsts]
    out = pieces._LOWER[data[keep]]
    out[blank[keep]] = 0x20
    bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
    begins = (out & 0xC0) != 0x80
    x = out.astype(np.uint32)
    if not begins.all():
        at, _, cp = pieces.points(out)
        x[at] = cp
        x, bounds = x[begins], np.concatenate([[0], np.cumsum(begins)])[bounds]
    return x, bounds


def repeated(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Characters that go on with a repetition of 1 to PERIOD characters which has lasted for AGAIN characters."""
    out, place = np.zeros(len(x), bool), np.arange(len(x))
    for p in range(1, PERIOD + 1):
        same = np.zeros(len(x), bool)
        same[p:] = x[p:] == x[:-p]
        for i in range(p):
            edge = bounds[:-1] + i
            same[edge[edge < len(x)]] = False
        out |= place - np.maximum.accumulate(np.where(same, -1, place)) > AGAIN
    return out


def whole_text(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    x = normal(raw, np.array([0, len(raw)]))[0] if len(raw) else np.zeros(0, np.uint32)
    return x[:-1] if len(x) and x[-1] == 0x20 else x


def kept(x: np.ndarray) -> np.ndarray:
    """Places of a text's characters without what is cut."""
    return np.flatnonzero(~repeated(x, np.array([0, len(x)])))


def normal_text(text: str) -> np.ndarray:
    """A text as candidates are sought in it."""
    x = whole_text(text)
    return x[kept(x)]


def grams(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each q-gram, out of hashes of 2, 4 and 8 characters."""
    if len(x) < Q:
        return np.zeros(0, np.uint64)
    h, four = x.astype(np.uint64), None
    for n, factor in ((1, 0x9E3779B97F4A7C15), (2, 0xD6E8FEB86659FD93), (4, 0xC2B2AE3D27D4EB4F)):
        h = h[:-n] * np.uint64(factor) + h[n:]
        h ^= h >> np.uint64(29)
        four = h if n == 2 else four
    h = h[:-4] * np.uint64(0x9FB21C651E98DF25) + four[8:]
    return h ^ (h >> np.uint64(32))


def budget(m: int) -> int:
    return int(m * EDITS)


def _expanded(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... n[i] of them, for all i."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Index:
    """Windows of a portion of the benchmark and their q-grams."""

    def __init__(self, items: list[tuple[int, str]]):
        full = [(item, x, kept(x)) for item, x in ((item, whole_text(text)) for item, text in items)]
        texts = [(item, x[at]) for item, x, at in full if len(at) >= LEAST]
        self.short: dict[str, list[int]] = {}
        for item, x, at in full:
            words = "".join(map(chr, x.tolist()))
            if len(at) < LEAST and any(map(str.isalnum, words)):
                self.short.setdefault(words, []).append(item)
        long = [(x, at) for _, x, at in full if len(at) >= LEAST]
        shifts = np.cumsum([0, *(len(x) for x, _ in long)])
        #: All items as they are, end to end; where each character of the cut ones stands in them, and where its item ends there.
        self.whole = np.concatenate([x for x, _ in long]) if long else np.zeros(0, np.uint32)
        self.stands = np.concatenate([np.zeros(0, np.int64), *(at + shift for (_, at), shift in zip(long, shifts))])
        self.ends = np.concatenate([np.zeros(0, np.int64), *(np.full(len(at), end) for (_, at), end in zip(long, shifts[1:]))])
        self.flat = np.concatenate([x for _, x in texts]) if texts else np.zeros(0, np.uint32)
        begins = np.cumsum([0, *(len(x) for _, x in texts)])
        item, start, size = [], [], []
        #: Numbers of the first window of each cut and of the one behind its last.
        self.cuts = [0]
        for most, step in ((WINDOW, STEP), (SHORT, SHORT_STEP)):
            for begin, (name, x) in zip(begins.tolist(), texts):
                if most == SHORT and len(x) <= SHORT:
                    continue  # the item is its one window already
                at = [0] if len(x) <= most else sorted({*range(0, len(x) - most, step), len(x) - most})
                item += [name] * len(at)
                start += [begin + c for c in at]
                size += [min(most, len(x))] * len(at)
            self.cuts.append(len(start))
        self.item = item
        #: Where a window, and its last q-gram, begin in all items laid end to end; both rise within a cut.
        self.start, self.size = np.array(start, np.int64), np.array(size, np.int64)
        self.last = self.start + self.size - Q
        self.edits = (self.size * EDITS).astype(np.int64)
        hashes = grams(self.flat)
        place = np.arange(len(hashes))
        mine = place + Q <= begins[np.searchsorted(begins, place, "right")] if len(texts) else np.zeros(0, bool)
        place = place[mine]
        order = np.argsort(hashes[place], kind="stable")
        self.place = place[order].astype(np.int32)
        self.gram, self.begin, self.count = np.unique(hashes[self.place], return_index=True, return_counts=True)
        rare = np.zeros(len(self.flat) + 1, np.int64)
        rare[self.place + 1] = np.repeat(self.count <= COMMON, self.count)
        rare = np.cumsum(rare)
        counted = rare[self.last + 1] - rare[self.start] if len(start) else np.zeros(0, np.int64)
        self.need = counted - self.edits * Q
        #: Windows of mostly common q-grams, equal ones once, and all q-grams of these.
        dull: dict[bytes, list[int]] = {}
        for w in np.flatnonzero(self.need < 1).tolist():
            dull.setdefault(self.window(w).tobytes() + self.uncut(w).tobytes(), []).append(w)
        self.alike = {ws[0]: ws for ws in dull.values()}
        at = [(w, grams(self.window(w))) for w in self.alike]
        self.dull_gram = np.concatenate([np.zeros(0, np.uint64), *(g for _, g in at)])
        order = np.argsort(self.dull_gram, kind="stable")
        self.dull_gram = self.dull_gram[order]
        self.dull_window = np.concatenate([np.zeros(0, np.int64), *(np.full(len(g), w) for w, g in at)])[order]
        self.dull_place = np.concatenate([np.zeros(0, np.int64), *(self.start[w] + np.arange(len(g)) for w, g in at)])[order]
        self.map = np.zeros(1 << _BITS, bool)
        self.map[(self.gram >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def window(self, w: int) -> np.ndarray:
        return self.flat[self.start[w] : self.start[w] + self.size[w]]

    def uncut(self, w: int) -> np.ndarray:
        """A window with its repetitions, up to the item's end if it is the item's last one."""
        last = self.start[w] + self.size[w] - 1
        closes = last + 1 == len(self.ends) or self.ends[last + 1] != self.ends[last]
        return self.whole[self.stands[self.start[w]] : self.ends[last] if closes else self.stands[last] + 1]

    def _counted(self, window: np.ndarray, place: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of (window, band) and how many positions hit each; a hit counts for its band and the one before."""
        band = (pos - (place - self.start[window]) + WINDOW) // (self.edits[window] + 1) + 1
        key = window << 40 | band
        key, pos = np.concatenate([key, key - 1]), np.concatenate([pos, pos])
        order = np.lexsort((pos, key))
        key, pos = key[order], pos[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (pos[1:] != pos[:-1])
        return np.unique(key[new], return_counts=True)

    def _hits(self, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Windows, places and positions of shared q-grams, some millions at a time and in order of position."""
        at = np.flatnonzero(self.map[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        i = np.minimum(np.searchsorted(self.gram, h[at]), max(0, len(self.gram) - 1))
        hit = self.gram[i] == h[at] if len(self.gram) else np.zeros(0, bool)
        at, i = at[hit], i[hit]
        plain = self.count[i] <= COMMON
        sources = [(at[plain], self.begin[i[plain]], self.count[i[plain]], None)]
        if len(self.dull_gram):
            lo = np.searchsorted(self.dull_gram, h[at], "left")
            n = np.searchsorted(self.dull_gram, h[at], "right") - lo
            sources.append((at[n > 0], lo[n > 0], n[n > 0], self.dull_window))
        for at, lo, n, windows in sources:
            ends = np.cumsum(n)
            done = 0
            while done < len(at):
                upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + STEP_HITS, "right")))
                some = _expanded(lo[done:upto], n[done:upto])
                pos = np.repeat(at[done:upto], n[done:upto])
                done = upto
                if windows is not None:
                    yield windows[some], self.dull_place[some], pos
                    continue
                place = self.place[some].astype(np.int64)
                for a, b in zip(self.cuts[:-1], self.cuts[1:]):  # windows that hold a place follow each other
                    first = a + np.searchsorted(self.last[a:b], place, "left")
                    each = a + np.searchsorted(self.start[a:b], place, "right") - first
                    window = _expanded(first, each)
                    ok = self.need[window] > 0  # the others are counted by all their q-grams
                    yield window[ok], np.repeat(place, each)[ok], np.repeat(pos, each)[ok]

    def regions(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window and first diagonal of each band that reaches its window's bound."""
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for window, place, pos in self._hits(grams(x)):
            key, n = self._counted(window, place, pos)  # all hits of a window at a position are in one step
            if len(keys):
                key, back = np.unique(np.concatenate([keys, key]), return_inverse=True)
                n = np.bincount(back, np.concatenate([counts, n]), len(key)).astype(np.int64)
            keys, counts = key, n
        window, band = keys >> 40, (keys & ((1 << 40) - 1)) - 1
        full = self.size[window] - Q + 1 - self.edits[window] * Q
        ok = counts >= np.where(self.need[window] > 0, self.need[window], full)
        return window[ok], band[ok] * (self.edits[window[ok]] + 1) - WINDOW


def align(window: np.ndarray, text: np.ndarray, most: int) -> int:
    """Fewest edits between the window and any stretch of ``text``; above ``most`` if it is more. ``most`` characters that no text
    has stand on both sides, so that paths may begin before the text or end behind it: a window's character beside one of them
    is as good as deleted. Row by row: cell j of row i stands for padded position i + j."""
    m, wide = len(window), len(text) - len(window) + 2 * most
    if wide < most:
        return most + 1
    if text.tobytes().find(window.tobytes()) % 4 == 0:
        return 0
    outside = np.full(most, 0xFFFFFFFF, np.uint32)
    text = np.concatenate([outside, text, outside])
    steps = np.arange(wide + 1)
    cost = np.zeros(wide + 1, np.int64)
    for i in range(m):
        here = cost + (text[i : i + wide + 1] != window[i])
        here[:-1] = np.minimum(here[:-1], cost[1:] + 1)
        cost = np.minimum.accumulate(here - steps) + steps
        if cost.min() > most:
            return most + 1
    return int(cost.min())


def portions(benchmark: DataFrame) -> Iterator[Index]:
    """The benchmark in indexes of about PORTION bytes of items each."""
    items = benchmark.select("item_id", "text").where("item_id is not null and text is not null")
    n = max(1, -(-content_bytes(items) // PORTION))
    for k in range(n):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        yield Index([(r["item_id"], r["text"]) for r in some.collect()])  # PORTION bytes


def _verbatim(short: dict[str, list[int]], texts: list[str]) -> Iterator[tuple[int, int]]:
    """(number of the text, item) of short items between characters that are neither letters nor digits."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for words in short:
        machine.add_word(words, words)
    machine.make_automaton()
    for doc, text in enumerate(texts):
        found = {w for end, w in machine.iter(text) if not text[end + 1 : end + 2].isalnum() and (end < len(w) or not text[end - len(w)].isalnum())}
        yield from ((doc, item) for w in found for item in short[w])


def stretches(x: np.ndarray, stands: np.ndarray, most: int) -> list[np.ndarray]:
    """A text in parts of which one holds any stretch of up to ``most`` characters that has characters with places ``stands`` on
    both sides or at an end: where more than two times ``most`` characters in a row were cut, the middle is left out."""
    edges = np.concatenate([[-1], stands, [len(x)]])
    wide = np.flatnonzero(np.diff(edges) > 2 * most + 1)
    begins = [0, *(int(edges[i + 1]) - most for i in wide)]
    ends = [*(int(edges[i]) + 1 + most for i in wide), len(x)]
    return [x[max(0, a) : b] for a, b in zip(begins, ends)]


def leaks(index: Index, texts: pa.Array) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """(number of the text, item) -> (size, edits) of its windows that are found within their budget."""
    full, ends = normal(*pieces.buffers(texts))
    keep = ~repeated(full, ends)
    x, stands, bounds = full[keep], np.flatnonzero(keep), np.concatenate([[0], np.cumsum(keep)])[ends]
    best: dict[tuple[int, int], int] = {}
    for w, d in zip(*(v.tolist() for v in index.regions(x))):
        k, t = int(index.edits[w]), index.uncut(w)
        lo, hi = max(d - k, 0), min(d + 3 * k + 2 + int(index.size[w]), len(x))
        for doc in range(int(np.searchsorted(bounds, lo, "right")) - 1, int(np.searchsorted(bounds, hi, "left"))):
            first, behind = max(lo, int(bounds[doc])), min(hi, int(bounds[doc + 1]))
            if first >= behind or not best.get((doc, w), k + 1):
                continue
            a = int(stands[first]) if first > bounds[doc] else int(ends[doc])
            b = int(stands[behind]) if behind < bounds[doc + 1] else int(ends[doc + 1])
            for part in stretches(full[a:b], stands[first:behind] - a, len(t) + k):
                best[doc, w] = min(best.get((doc, w), k + 1), align(t, part, k))
    found: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for (doc, w), e in best.items():
        if e <= index.edits[w]:
            for same in index.alike.get(w, [w]):
                found.setdefault((doc, index.item[same]), []).append((int(index.size[same]), e))
    if index.short:
        flat = full.astype("<u4").tobytes().decode("utf-32-le")
        for doc, item in _verbatim(index.short, [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]):
            found.setdefault((doc, item), []).append((0, 0))
    return found


def searched(index: Index, batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, dict[tuple[int, int], list[tuple[int, int]]]]]:
    """A batch of rows in slices, each with the leaks of its texts."""
    for part in pieces.slices(batch, "text", SLICE_BYTES):
        yield part, leaks(index, part.column("text"))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, edits (of the item's best window among the longest that match) and windows (how many match) of each leaked item."""

    def one(index: Index) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(index)  # PORTION bytes of items

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, rows in searched(shared.value, batch):
                    if rows:
                        names = part.column("doc_id").to_pylist()
                        edits = [min((-size, e) for size, e in v)[1] for v in rows.values()]
                        values = [names[d] for d, _ in rows], [i for _, i in rows], edits, [len(v) for v in rows.values()]
                        yield pa.record_batch([pa.array(v, pa.int64()) for v in values], ["doc_id", "item_id", "edits", "windows"])

        return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, edits long, windows long")

    return reduce(DataFrame.union, map(one, portions(benchmark)))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found, with all their columns."""

    def without(rows: DataFrame, index: Index) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(index)  # PORTION bytes of items

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = 0
                for part, found in searched(shared.value, batch):
                    keep = np.ones(part.num_rows, bool)
                    keep[[doc for doc, _ in found]] = False
                    yield batch.slice(at, part.num_rows).filter(pa.array(keep))
                    at += part.num_rows

        return rows.mapInArrow(run, rows.schema)

    return reduce(without, portions(benchmark), docs)
