"""Language of words, spans and texts.

A word is a run of letters (with their marks) of one script; signs in between, and a change of
script, end it, so glued text such as a Latin name inside Chinese falls apart. Where a script sets
no blanks (Han, Kana) a run is cut into pairs of characters. A word's script, read from code point
ranges, narrows the candidate languages to those that
the training texts write in that script. Over these, a word's score is its smoothed log
probability in each language: its count in the training texts backed off to a byte
four-gram model of words. A Viterbi pass with a penalty for each switch of language labels
every word, so a mixed text falls into spans; the text's language is the one with most
words, and its score that language's share of the words.

The classifier is fitted on at most about ``SAMPLE`` texts a language, chosen by a hash of
their ids among the labelled rows that are not held out; its tables have a fixed number of
cells a language. Prediction reads the text alone.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; with no
labelled row everything is ``und``; ties go to the language that sorts first; repeated
rows get equal results; a very long text is labelled whole, word by word, in memory that grows
with its number of words; an empty table gives an empty result; other columns, of any name,
are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.llm import pieces

UND = "und"
#: Expected number of training texts a language.
SAMPLE = 1500
CELLS = 1 << 18
#: What a switch of language costs, and the most by which one word can speak against a language.
SWITCH, MOST = 8.0, 6.0
#: What a word costs in a language that is not written in its script: more than to leave the language for one word.
CLOSED = 2 * SWITCH + MOST
#: A language is a candidate for a script that so large a part of its words use.
SCRIPT_SHARE = 0.01

#: First code points of Unicode ranges and the scripts that begin there.
SCRIPT_RANGES = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0900, "Devanagari"),
    (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"),
    (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"),
    (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Han"), (0xAC00, "Hangul"),
    (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Other"), (0x20000, "Han"),
)
_STARTS = [a for a, _ in SCRIPT_RANGES]
SCRIPTS = sorted({s for _, s in SCRIPT_RANGES})
_SCRIPT_AT = np.array([SCRIPTS.index(s) for _, s in SCRIPT_RANGES])
_LATIN = SCRIPTS.index("Latin")

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: Scripts without blanks between words.
_UNSPACED = np.array([SCRIPTS.index("Han"), SCRIPTS.index("Kana")])


@lru_cache(maxsize=1)
def _lettered() -> np.ndarray:
    """Whether each code point is a letter or a mark on one."""
    return np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)])


def _scripts(points: np.ndarray) -> np.ndarray:
    return _SCRIPT_AT[np.searchsorted(_STARTS, points, "right") - 1]


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def text_words(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """Codes of the words of all texts, the distinct words and their scripts (-1: no letter in it), and each text's first word."""
    data, bounds = pieces.buffers(texts)
    firsts = bounds[:-1][np.diff(bounds) > 0]
    keep = _LETTER[data]
    breaks = np.zeros(0, np.int64)
    if len(data) and data.max() >= 0x80:
        at, size, point = pieces.points(data)
        some = _lettered()[point]
        at, size, kind = at[some], size[some], _scripts(point[some])
        for i in range(int(size.max(initial=0))):
            keep[at[size > i] + i] = True
        joins = np.zeros(len(at), bool)  # to the character in front, which is not ASCII either
        joins[1:] = at[1:] == at[:-1] + size[:-1]
        joins &= ~np.isin(at, firsts)
        same = joins.copy()
        same[1:] &= kind[1:] == kind[:-1]
        nth = np.arange(len(at)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(at)))) if len(at) else at
        behind = at + size
        behind, strange = behind[behind < len(data)], kind[behind < len(data)] != _LATIN
        # where another script begins, every second character without blanks, and Latin letters after another script
        breaks = np.concatenate([at[~same & (joins | (kind != _LATIN))], at[np.isin(kind, _UNSPACED) & (nth % 2 == 0)], behind[strange & (data[behind] < 0x80)]])
    start = keep.copy()
    start[1:] &= ~keep[:-1]
    start[breaks] |= keep[breaks]
    start[firsts] = keep[firsts]
    of = np.searchsorted(np.flatnonzero(start), bounds)
    code, distinct = pieces.coded(pieces.as_binary(pieces._LOWER[data[keep]], np.flatnonzero(start[keep])))
    names = distinct.to_pylist()
    script = np.full(len(names), _LATIN)
    for i, w in enumerate(names):
        if not w.isascii():
            letters = [c for c in w.decode() if c.isalpha()]
            script[i] = _scripts(ord(letters[0])) if letters else -1
    return code, names, script, of


def _cells(names: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A cell for each word; the cells of all its four-grams with marked ends; and where each word's four-grams begin."""
    joined = b"".join(b"\x01\x01\x01" + w + b"\x02" for w in names)
    x = np.frombuffer(joined + b"\x00\x00\x00", np.uint8).astype(np.uint64)
    gram = x[:-3] | x[1:-2] << np.uint64(8) | x[2:-1] << np.uint64(16) | x[3:] << np.uint64(24)
    at = (gram * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(46)).astype(np.int64)
    sizes = np.array([len(w) + 4 for w in names], np.int64)
    begins = np.cumsum(sizes) - sizes
    mine = np.arange(len(joined)) - np.repeat(begins, sizes) < np.repeat(sizes - 3, sizes)
    import xxhash

    word = np.fromiter((xxhash.xxh64_intdigest(w) >> 46 for w in names), np.int64, len(names))
    counts = sizes - 3
    return word, at[: len(joined)][mine], np.cumsum(counts) - counts


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces.slices(batch, "text"):
            langs = pc.dictionary_encode(part.column("lang"))
            doc_lang = langs.indices.to_numpy()
            code, names, script, of = text_words(part.column("text"))
            if not len(code):
                continue
            word, gram, begins = _cells(names)
            lang = np.repeat(doc_lang, np.diff(of))
            for k, name in enumerate(langs.dictionary.to_pylist()):
                n = np.bincount(code[lang == k], minlength=len(names))
                n[script < 0] = 0
                weight = np.repeat(n, np.diff(np.append(begins, len(gram))))
                found = [(0, np.bincount(word, n, CELLS)), (1, np.bincount(gram, weight, CELLS)), (2, np.bincount(np.maximum(script, 0), n, len(SCRIPTS)))]
                for kind, h in found:
                    at = np.flatnonzero(h)
                    yield pa.record_batch([pa.array([name] * len(at), pa.string()), pa.array(np.full(len(at), kind, np.int32)), pa.array(at.astype(np.int32)), pa.array(h[at].astype(np.int64))], ["lang", "kind", "cell", "n"])


class Model:
    """Per language and cell: log probabilities of words and four-grams; which languages use which script."""

    def __init__(self, langs: list[str], words: np.ndarray, grams: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        grams = grams.astype(np.float32) + 0.1
        self.gram = np.log(grams / grams.sum(axis=1, keepdims=True)).T.astype(np.float32).copy()
        self.word = words.T.astype(np.float32).copy()
        self.total = words.sum(axis=1).astype(np.float32)
        share = scripts / np.maximum(1, scripts.sum(axis=1, keepdims=True))
        self.open = (share >= SCRIPT_SHARE).T.copy()
        self.open[~self.open.any(axis=1)] = True

    def scores(self, names: list[bytes], script: np.ndarray) -> np.ndarray:
        """For each distinct word and language, how far below the best language it is; 0 for all if it has no letter."""
        if not names:
            return np.zeros((0, len(self.langs)), np.float32)
        word, gram, begins = _cells(names)
        spelled = np.add.reduceat(self.gram[gram], begins, axis=0)
        prior = np.exp(np.maximum(spelled, -60.0))
        s = np.log((self.word[word] + 50.0 * prior) / (self.total + 50.0) + np.float32(1e-30))
        s = np.where(self.open[np.maximum(script, 0)], s, -np.inf)
        s = np.where(np.isfinite(s), np.maximum(s - s.max(axis=1, keepdims=True), -MOST), -CLOSED).astype(np.float32)
        s[script < 0] = 0
        return s


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on rows of (doc_id, text, lang) that are labelled and not held out."""
    rows = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null").where(~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    if not sizes:
        return None
    langs = sorted(sizes)
    part = F.create_map(*[x for l in langs for x in (F.lit(l), F.lit(min(1.0, sample / sizes[l])))])
    u = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 20)) / float(1 << 20)
    chosen = rows.where(u < part[F.col("lang")]).select("text", "lang")
    got = chosen.mapInArrow(_histograms, "lang string, kind int, cell int, n long").groupBy("lang", "kind", "cell").agg(F.sum("n").alias("n")).toArrow()
    lang = pc.index_in(got.column("lang"), pa.array(langs)).to_numpy()
    kind, cell, n = (got.column(c).to_numpy() for c in ("kind", "cell", "n"))
    tables = [np.zeros((len(langs), size)) for size in (CELLS, CELLS, len(SCRIPTS))]
    for k, t in enumerate(tables):
        t[lang[kind == k], cell[kind == k]] = n[kind == k]
    return Model(langs, *tables)


def viterbi(scores: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The best label of each word; texts are ``of[i]:of[i+1]``. All texts advance together, a word at a time."""
    size = np.diff(of)
    order = np.argsort(-size, kind="stable")
    at, size = of[:-1][order], size[order]
    live = len(size) - np.searchsorted(size[::-1], np.arange(1, (size.max(initial=0)) + 1))
    jump = np.zeros(scores.shape, bool)
    source = np.zeros(len(scores), np.int16)
    total = np.zeros((len(size), scores.shape[1]), np.float32)
    for t, a in enumerate(live.tolist()):
        now, here = total[:a], at[:a] + t
        best = now.argmax(axis=1)
        top = now[np.arange(a), best][:, None] - SWITCH
        moved = now < top
        jump[here] = moved
        source[here] = best
        now = np.where(moved, top, now) + scores[here]
        total[:a] = now - now.max(axis=1, keepdims=True)
    label = np.zeros(len(scores), np.int16)
    state = total.argmax(axis=1)
    for t in range(len(live) - 1, -1, -1):
        a = int(live[t])
        here, s = at[:a] + t, state[:a]
        label[here] = s
        state[:a] = np.where(jump[here, s], source[here], s)
    return label


def predict(docs: DataFrame, model: Model | None, spans: bool = False) -> DataFrame:
    """doc_id, lang_pred, score, n_spans (and with ``spans`` their list, as language:first word-last word)."""
    names = ["doc_id", "lang_pred", "score", "n_spans", *["spans"] * spans]
    schema = "doc_id long, lang_pred string, score double, n_spans long" + ", spans string" * spans
    if model is None:
        return docs.select("doc_id", F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_spans"), *[F.lit("").alias("spans")] * spans)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # CELLS cells a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in pieces.slices(batch, "text", slice_bytes(m)):
                code, words, script, of = text_words(part.column("text"))
                label = viterbi(m.scores(words, script)[code], of)
                doc = np.repeat(np.arange(len(of) - 1), np.diff(of))
                lang, score = verdict(m, label, script[code] >= 0, doc, len(of) - 1)
                edge = np.ones(len(label), bool)
                edge[1:] = (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])
                columns = [part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score), pa.array(np.bincount(doc[edge], minlength=len(of) - 1))]
                if spans:
                    lists: list[list[str]] = [[] for _ in lang]
                    cut = np.append(np.flatnonzero(edge), len(label))
                    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                        lists[doc[a]].append(f"{m.langs[label[a]]}:{a - of[doc[a]]}-{b - 1 - of[doc[a]]}")
                    columns.append(pa.array([",".join(x) for x in lists]))
                yield pa.record_batch(columns, names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def slice_bytes(model: Model) -> int:
    """Slices of text whose scores for all languages stay small."""
    return max(1 << 20, min(4 << 20, (48 << 20) // len(model.langs)))


def verdict(model: Model, label: np.ndarray, lettered: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[list[str], np.ndarray]:
    """Each text's language and the share of its words."""
    k = len(model.langs)
    votes = np.bincount(doc[lettered] * k + label[lettered], minlength=n_docs * k).reshape(-1, k)
    n = votes.sum(axis=1)
    return [model.langs[b] if c else UND for b, c in zip(votes.argmax(axis=1).tolist(), n.tolist())], votes.max(axis=1) / np.maximum(1, n)


def accepted(docs: DataFrame, model: Model | None, least: float = 0.4) -> DataFrame:
    """The rows whose text has a language with a score of ``least`` or more, with all their columns. Without a model, where
    nothing is labelled, no text can be rejected and all rows stay."""
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            at = 0
            for part in pieces.slices(batch, "text", slice_bytes(m)):
                code, words, script, of = text_words(part.column("text"))
                doc = np.repeat(np.arange(len(of) - 1), np.diff(of))
                lang, score = verdict(m, viterbi(m.scores(words, script)[code], of), script[code] >= 0, doc, len(of) - 1)
                keep = np.array([x != UND for x in lang]) & (score >= least)
                yield batch.slice(at, part.num_rows).filter(pa.array(keep))
                at += part.num_rows

    return docs.mapInArrow(run, docs.schema)


def language_table(docs: DataFrame) -> DataFrame:
    out = predict(docs, train(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "n_spans")
