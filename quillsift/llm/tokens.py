"""Token counts and ids of a public byte-level BPE vocabulary, by distinct pre-token.

The library is asked once per distinct pre-token that a worker meets; a text's count is
then the sum over its pre-tokens of frequency times count, joined on dictionary codes
inside the task. A join of (document, pre-token) rows across the cluster would move more
bytes than the texts themselves, and a vocabulary of all pre-tokens has no bounded size,
so each worker keeps its own table, emptied when it passes ``MEMO`` entries. Counting keeps
numbers alone. Pre-tokens are cut the same way in all scripts; special strings are pieces
of their own, as in the library.

Defined cases: a null or empty text has no token; repeated rows give equal results; a very
long text is one slice and counted whole; there is nothing to tie; an empty table gives an
empty result; only ``doc_id`` and ``text`` are read, so further columns do no harm.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quillsift.llm import pieces

#: Pre-tokens that a worker remembers.
MEMO = 500_000

_encoders: dict[str, "Encoder"] = {}


def vocabulary_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """One vocabulary in one worker: pre-token -> number of its ids, and pre-token -> row of a growing table of ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        specials = sorted((t.content.encode() for t in self.library.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.specials = re.compile(b"|".join(map(re.escape, specials))) if specials else None
        self.sizes_of: dict[bytes, int] = {}
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.sizes = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)
        self.begins = np.zeros(0, np.int64)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def kind(self, ch: str) -> int:
        """The library's kind of a character: one of a letter, a number or another sign forms one piece with it, or none does."""
        split = self.library.pre_tokenizer.pre_tokenize_str
        return next((kind for mark, kind in (("a", pieces._L), ("1", pieces._N), (".", pieces._O)) if len(split(mark + ch)) == 1), pieces._S)

    def pre_tokens(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        return pieces.pre_tokens(*pieces.buffers(texts), self.specials, self.kind)

    def counted(self, distinct: pa.Array) -> np.ndarray:
        """Numbers of ids of the distinct pre-tokens. The ids of unknown ones are made a few thousand at a time and dropped."""
        names = distinct.to_pylist()
        if len(self.sizes_of) > MEMO:
            self.sizes_of.clear()
        new = [p for p in names if p not in self.sizes_of]
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            self.sizes_of.update(zip(some, map(len, self.whole([p.decode() for p in some]))))
        return np.fromiter(map(self.sizes_of.__getitem__, names), np.int64, len(names))

    def rows(self, distinct: pa.Array) -> np.ndarray:
        """Table rows of the distinct pre-tokens; unknown ones are encoded by the library."""
        names = distinct.to_pylist()
        if len(self.known) > MEMO:
            self.clear()
        new = [p for p in names if p not in self.known]
        if new:
            got = self.whole([p.decode() for p in new])
            sizes = np.array([len(x) for x in got], np.int64)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.begins = np.concatenate([self.begins, len(self.flat) + np.cumsum(sizes) - sizes])
            self.flat = np.concatenate([self.flat, np.fromiter((i for x in got for i in x), np.uint32, int(sizes.sum()))])
            self.sizes = np.concatenate([self.sizes, sizes])
        return np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text: frequencies of its distinct pre-tokens times their counts, added up."""
        parts, of = self.pre_tokens(texts)
        if not len(parts):
            return np.zeros(len(texts), np.int64)
        code, distinct = pieces.coded(parts)
        size = self.counted(distinct)
        doc = np.repeat(np.arange(len(of) - 1), np.diff(of))
        pair, frequency = np.unique(doc * len(distinct) + code, return_counts=True)
        doc, code = np.divmod(pair, len(distinct))
        return np.bincount(doc, weights=frequency * size[code], minlength=len(of) - 1).astype(np.int64)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and each text's number of ids."""
        parts, of = self.pre_tokens(texts)
        if not len(parts):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        code, distinct = pieces.coded(parts)
        row = self.rows(distinct)[code]
        size = self.sizes[row]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.begins[row] - (ends - size), size) + np.arange(ends[-1])]
        return ids, np.diff(np.append(0, ends)[of])


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file, made once."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) for every whole text. A ``.model``
    vocabulary goes to sentencepiece text by text; its pieces cross word borders, so there is no table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary_path(vocabulary)
        piecewise = path.endswith(".model")
        if piecewise:
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_file=path)
        for batch in batches:
            for part in pieces.slices(batch, "text"):
                texts = part.column("text")
                n = np.array([len(model.encode(t)) for t in texts.to_pylist()], np.int64) if piecewise else encoder(path).counts(texts)
                size = pc.binary_length(texts).cast(pa.int64())
                yield pa.record_batch([part.column("doc_id"), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
