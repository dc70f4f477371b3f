"""Log-bilinear language model, trained in numpy by noise-contrastive estimation, and a unigram base.

The texts become blocks of word codes: one row holds some megabytes of text as codes into
its own list of distinct words, so later steps shuffle distinct words of blocks and no
tokens. Word counts are added up over the blocks' training documents and joined back to the
blocks (block, position, count); a task then has the exact count of every word it scores.

The vocabulary is the most frequent words, ``32 * cube root of N`` of them for N training
tokens, so it grows with the corpus (15,000 for half a gigabyte, 800,000 for 100 TB, when
the parameters are about 100 MB), the end token, and one entry for all other words. The last
``CONTEXT`` words' vectors, each times the context matrix of its distance, add up to the
predicted vector. Entries are dealt by frequency to classes of equal size; the predicted vector
times a class's vector, then times the vectors of the class's words, give P(class) and
P(word | class), so a token's probability is normalised over the whole vocabulary at the cost of
two square roots of it. A word outside takes the probability of the entry for others times its
smoothed share among such words; all tokens' probabilities add up to one in every context.

Training reads every training token once: tasks run stochastic steps over their blocks, with
noise classes and noise words drawn from the unigram distribution, and their parameters are
averaged by numbers of tokens. That happens ``ROUNDS`` times, each time over its own part of the
blocks. Parameters never leave the size above, whatever the corpus. A block's name comes from its
content and sums are taken in a fixed order, so a table in the same files and on as many cores gives
the same scores again.

Defined cases: a null or empty text is the end token alone; with no training document the
counts are 0 and the model is uniform; a very long text is a block of its own and scored whole;
equally frequent words enter the vocabulary in their own order; repeated rows get scores of
equal texts, each for itself; an empty table gives an empty result; only ``doc_id`` and ``text``
are read, so further columns do no harm.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm import pieces
from quillsift.llm.common import staged
from quillsift.llm.langid import held_out

#: Words of context, size of the vectors, noise classes a step and noise words a token, tokens a step, rounds of averaging.
CONTEXT, DIM, NOISE_CLASSES, NOISE_WORDS, STEP, ROUNDS = 3, 24, 32, 3, 4096, 2
RATE = 0.1
#: About so many bytes of text make a block.
BLOCK_BYTES = 8 << 20
#: Gradients of a token that occurs more often in a step are added up by a loop of their own.
SHORT_RUN = 16
#: Vocabulary entries of other words and of the end token.
OTHER, END = 0, 1
_BLOCK = "block long, doc_ids array<long>, held array<boolean>, sizes array<long>, codes binary, words array<binary>, train_n array<long>"


def _press(codes: np.ndarray) -> bytes:
    """32-bit codes by byte planes; the upper planes are nearly empty."""
    return zlib.compress(np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpress(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


def _list(values: pa.Array) -> pa.Array:
    """One row that holds all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def blocks(docs: DataFrame, parts: int = 7, part: int = 2) -> DataFrame:
    """The staged blocks; the end token is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in pieces.slices(batch, "text", BLOCK_BYTES):
                found, of = pieces.words(*pieces.buffers(some.column("text")))
                code, distinct = pieces.coded(found)
                held = some.column("held").to_numpy(zero_copy_only=False)
                rank = np.empty(len(distinct), np.int64)
                order = np.argsort(-np.bincount(code, minlength=len(distinct)), kind="stable")
                rank[order] = np.arange(1, len(distinct) + 1)
                names = pa.concat_arrays([pa.array([b""], distinct.type), distinct.take(pa.array(order))])
                codes = np.insert(rank[code], of[1:], 0)
                sizes = np.diff(of) + 1
                train = np.bincount(codes[np.repeat(~held, sizes)], minlength=len(names))
                packed = _press(codes)
                # a name by content: the same table gives the same blocks, and so the same rounds and parameters
                name = hashlib.blake2b(packed + repr(some.column("doc_id").to_pylist()).encode(), digest_size=8)
                for part_of in pieces.buffers(names):
                    name.update(part_of)
                block = int.from_bytes(name.digest()) >> 1
                columns = [_list(x) for x in (some.column("doc_id").cast(pa.int64()), pa.array(held), pa.array(sizes), names, pa.array(train))]
                yield pa.record_batch([pa.array([block]), *columns[:3], pa.array([packed], pa.binary()), *columns[3:]], ["block", "doc_ids", "held", "sizes", "codes", "words", "train_n"])

    return staged(docs.select("doc_id", "text", held_out(F.col("doc_id"), parts, part).alias("held")).mapInArrow(run, _BLOCK), "lm-blocks")


def vocabulary_size(n: int) -> int:
    """Entries for n training tokens, with those of other words and of the end."""
    return 2 + round(32 * n ** (1 / 3))


@dataclass
class Stats:
    """Counts of the training part: tokens, distinct tokens, and of the words outside the vocabulary."""

    n: int
    v: int
    n_other: int
    v_other: int
    words: list[bytes]
    entry_counts: np.ndarray

    @property
    def entries(self) -> dict[bytes, int]:
        return {b"": END} | {w: i + 2 for i, w in enumerate(self.words)}


def statistics(counts: DataFrame, size: int | None = None) -> Stats:
    """From (word, c) of all training words."""
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("c")).first()
    top = counts.where(F.octet_length("word") > 0).orderBy(F.desc("c"), "word").limit((size or vocabulary_size(n)) - 2).collect()  # the vocabulary
    ends = counts.where(F.octet_length("word") == 0).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    n_other = n - ends - sum(r["c"] for r in top)
    return Stats(n, v, n_other, max(0, v - len(top) - (ends > 0)), [bytes(r["word"]) for r in top], np.array([n_other, ends, *(r["c"] for r in top)], np.float64))


class Model:
    """Parameters: vectors of context words, a matrix for each distance, vectors and biases of classes and of words."""

    def __init__(self, counts: np.ndarray, dim: int = DIM, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.size = len(counts)
        self.wide = int(np.ceil(np.sqrt(self.size)))  # words a class, and classes
        share = np.zeros(self.wide * self.wide)
        share[: self.size] = counts + 1.0
        share = (share / share.sum()).reshape(self.wide, self.wide)
        mass = share.sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            inside = np.where(mass[:, None] > 0, share / mass[:, None], 0.0)
            self.p = {
                "context": rng.normal(0, 0.1, (self.size, dim)),
                "matrix": np.concatenate([np.eye(dim) / (i + 1) for i in range(CONTEXT)]),
                "class": np.zeros((self.wide, dim)),
                "class_bias": np.log(mass)[:, None],
                "word": np.zeros((self.wide * self.wide, dim)),
                "word_bias": np.log(inside).reshape(-1, 1),
            }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        #: Noise distributions, over classes and over the words of each class, as running sums; and the logs of expected noise.
        self.mass, self.upto, self.class_upto = mass, np.cumsum(share.reshape(-1)), np.cumsum(mass)
        self.class_noise = np.log(NOISE_CLASSES * np.maximum(mass, 1e-30)).astype(np.float32)
        self.word_noise = np.log(NOISE_WORDS * np.maximum(inside.reshape(-1), 1e-30)).astype(np.float32)

    def log_probs(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Normalised natural log probabilities of words after contexts, by products of batches and matrices."""
        p, wide, out = self.p, self.wide, np.empty(len(word), np.float64)
        d = p["context"].shape[1]
        turned = [p["context"] @ p["matrix"][j * d : (j + 1) * d] for j in range(CONTEXT)]
        for at in range(0, len(word), 1 << 15):
            some, w = context[at : at + (1 << 15)], word[at : at + (1 << 15)]
            q = turned[0].take(some[:, 0], axis=0)
            for j in range(1, CONTEXT):
                q += turned[j].take(some[:, j], axis=0)
            kind, got = w // wide, np.empty(len(w), np.float32)
            reach = np.sqrt(np.einsum("nd,nd->n", q, q).max(initial=0.0))
            for lo in range(0, len(w), 1024):  # parts that stay in the processor's cache
                got[lo : lo + 1024] = _log_share(q[lo : lo + 1024], p["class"], p["class_bias"][:, 0], kind[lo : lo + 1024], reach)
            order = np.argsort(_narrow(kind, wide), kind="stable")
            ends = np.cumsum(np.bincount(kind, minlength=wide))
            for k in np.flatnonzero(np.diff(ends, prepend=0)).tolist():
                rows = slice(k * wide, (k + 1) * wide)
                for lo in range(ends[k - 1] if k else 0, ends[k], 1024):
                    mine = order[lo : min(lo + 1024, ends[k])]
                    got[mine] += _log_share(q.take(mine, axis=0), p["word"][rows], p["word_bias"][rows, 0], w[mine] - k * wide, reach)
            out[at : at + len(w)] = got
        return out

    def learn(self, near: np.ndarray, outside: np.ndarray, state: dict[str, np.ndarray], rng: np.random.Generator) -> None:
        """One step of noise-contrastive estimation with rates by AdaGrad.

        ``near`` holds tokens that follow each other, the first ``CONTEXT`` of them as context only. Where ``outside`` holds in
        column j, the token j + 1 before belongs to another document, and the end token stands for it. Gradients of contexts are
        added up by token before they are by word."""
        p, d, word = self.p, self.p["context"].shape[1], near[CONTEXT:]
        vectors, kind, n = p["context"].take(near, axis=0), word // self.wide, len(word)
        ends = [np.flatnonzero(outside[:, j]) for j in range(CONTEXT)]
        before = [vectors[CONTEXT - 1 - j :][:n].copy() for j in range(CONTEXT)]
        for x, at in zip(before, ends):
            x[at] = p["context"][END]
        q = sum(before[j] @ p["matrix"][j * d : (j + 1) * d] for j in range(CONTEXT))
        ones = np.concatenate([q, np.ones((n, 1), np.float32)], axis=1)
        noise = np.searchsorted(self.class_upto, rng.random(NOISE_CLASSES) * self.class_upto[-1], "right")
        # classes: one true one and shared noise
        bias = p["class_bias"][:, 0] - self.class_noise
        true, drawn = p["class"].take(kind, axis=0), p["class"].take(noise, axis=0)
        good = 1.0 - _logistic(np.einsum("nd,nd->n", q, true) + bias[kind])
        bad = -_logistic(q @ drawn.T + bias[noise])
        to_q = good[:, None] * true + bad @ drawn
        to_class = np.concatenate([good[:, None] * ones, bad.T @ ones])
        self._add("class", np.concatenate([kind, noise]), lambda order: to_class.take(order, axis=0), state, self.wide)
        # words of the true class: the true one and noise of its own
        begin = np.where(kind > 0, self.upto[kind * self.wide - 1], 0.0)
        drawn = np.searchsorted(self.upto, begin + rng.random((NOISE_WORDS, n), np.float32) * self.mass[kind], "right")
        drawn = np.clip(drawn, kind * self.wide, np.minimum(kind * self.wide + self.wide, self.size) - 1)
        every = np.concatenate([word[None, :], drawn])
        rows = p["word"].take(every, axis=0)
        g = -_logistic(np.einsum("knd,nd->kn", rows, q) + (p["word_bias"][:, 0] - self.word_noise).take(every))
        g[0] += 1.0
        to_q += np.einsum("kn,knd->nd", g, rows)
        self._add("word", every.reshape(-1), lambda order: _scaled(ones.take(order % n, axis=0), g.reshape(-1).take(order)), state, self.size)
        back = np.zeros((len(near) + 1, d), np.float32)  # behind the tokens the end
        for j, at in enumerate(ends):
            mine = to_q @ p["matrix"][j * d : (j + 1) * d].T
            back[-1] += mine[at].sum(axis=0)
            mine[at] = 0.0
            back[CONTEXT - 1 - j :][:n] += mine
        turn = np.concatenate([x.T @ to_q for x in before])
        self._add("context", np.append(near, END), lambda order: back.take(order, axis=0), state, self.size)
        self._step("matrix", slice(None), turn / n, state)

    def _add(self, name: str, rows: np.ndarray, grad: Callable[[np.ndarray], np.ndarray], state: dict[str, np.ndarray], size: int) -> None:
        """Add up the gradients of each row, given in any order asked for, then step; a column beyond the vectors is the bias."""
        rows = _narrow(rows, size)
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        begins = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        g = _sums(grad(order), begins)
        d = self.p[name].shape[1]
        self._step(name, rows[begins].astype(np.int64), g[:, :d], state)
        if g.shape[1] > d:
            self._step(f"{name}_bias", rows[begins].astype(np.int64), g[:, d:], state)

    def _step(self, name: str, rows, g: np.ndarray, state: dict[str, np.ndarray]) -> None:
        if name not in state:
            state[name] = np.full_like(self.p[name], 1e-2)
        seen, value, total = state[name], self.p[name], g * g
        total += seen if isinstance(rows, slice) else seen.take(rows, axis=0)
        seen[rows] = total
        by = RATE * g
        by /= np.sqrt(total, out=total)
        by += value if isinstance(rows, slice) else value.take(rows, axis=0)
        value[rows] = by


def _narrow(x: np.ndarray, size: int) -> np.ndarray:
    """In 16 bits where they suffice, as these sort in linear time."""
    return x.astype(np.uint16) if size <= 1 << 16 else x


def _sums(rows: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sums of runs of rows: of short runs all second rows, then all third ones and so on; a long run at once."""
    sizes = np.diff(begins, append=len(rows))
    out, deep = rows.take(begins, axis=0), 1
    live = np.flatnonzero((sizes > 1) & (sizes <= SHORT_RUN))
    while len(live):
        out[live] += rows.take(begins.take(live) + deep, axis=0)
        deep += 1
        live = live[sizes.take(live) > deep]
    for i in np.flatnonzero(sizes > SHORT_RUN).tolist():
        out[i] = rows[begins[i] : begins[i] + sizes[i]].sum(axis=0)
    return out


def _scaled(rows: np.ndarray, by: np.ndarray) -> np.ndarray:
    rows *= by[:, None]
    return rows


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _log_share(q: np.ndarray, vectors: np.ndarray, bias: np.ndarray, at: np.ndarray, reach: float) -> np.ndarray:
    """Log of the softmax of ``q @ vectors.T + bias`` in each row at one place; no row of ``q`` is longer than ``reach``."""
    s = q @ vectors.T
    s += bias
    top = s[np.arange(len(s)), at]
    if reach * np.sqrt(np.einsum("nd,nd->n", vectors, vectors).max()) + bias.max() > 80.0:  # sums of larger powers could overflow
        np.minimum(s, np.float32(80.0), out=s)
    np.exp(s, out=s)
    return top - np.log(s @ np.ones(s.shape[1], s.dtype))


def _openings(sizes: np.ndarray, deep: int) -> np.ndarray:
    """Places of the first ``deep`` tokens of each document."""
    begins = np.cumsum(sizes) - sizes
    return np.concatenate([begins[sizes > i] + i for i in range(deep)])


def contexts(now: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The entries before each token of its document; the end token stands in front of a document."""
    out = np.full((len(now), CONTEXT), END, np.int64)
    for j in range(CONTEXT):
        out[j + 1 :, j] = now[: max(0, len(now) - j - 1)]
        out[_openings(sizes, j + 1), j] = END
    return out


def steps(now: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What :meth:`Model.learn` takes, for runs of ``STEP`` tokens."""
    outside = np.zeros((len(now), CONTEXT), bool)
    for j in range(CONTEXT):
        outside[_openings(sizes, j + 1), j] = True
    led = np.concatenate([np.full(CONTEXT, END), now])
    for at in range(0, len(now), STEP):
        yield led[at : at + STEP + CONTEXT], outside[at : at + STEP]


_CHUNK = 1 << 12


def train(table: DataFrame, stats: Stats, rounds: int = ROUNDS, dim: int = DIM) -> Model:
    """Average what the tasks learn from their blocks, round by round."""
    context = table.sparkSession.sparkContext
    model, words = Model(stats.entry_counts, dim), context.broadcast(stats.words)  # vocabulary_size(n) words

    for turn in range(rounds):
        shared = context.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine, known, state, rng, done = shared.value, pa.array([b"", *words.value], pa.binary()), {}, np.random.default_rng(turn), 0
            mine.p = {k: v.copy() for k, v in mine.p.items()}
            for batch in batches:
                for i in range(batch.num_rows):
                    held, sizes, distinct = (batch.column(c)[i].values for c in ("held", "sizes", "words"))
                    # the end is entry 1, the words follow, and 0 is what is none of them
                    entry = pc.fill_null(pc.index_in(distinct.cast(pa.binary()), known), OTHER - 1).to_numpy().astype(np.int64) + 1
                    learns, sizes = ~held.to_numpy(zero_copy_only=False), sizes.to_numpy()
                    own = entry[_unpress(batch.column("codes")[i].as_py())][np.repeat(learns, sizes)]
                    for near, outside in steps(own, sizes[learns]):
                        mine.learn(near, outside, state, rng)
                    done += len(own)
            if done:
                for name, value in mine.p.items():
                    for at in range(0, len(value), _CHUNK):
                        part = np.ascontiguousarray(value[at : at + _CHUNK])
                        yield pa.record_batch([pa.array([name]), pa.array([at]), pa.array([done]), pa.array([part.tobytes()], pa.binary())], ["name", "at", "n", "part"])

        def mean(group: pa.Table) -> pa.Table:
            rows = sorted(zip(group.column("n").to_pylist(), group.column("part").to_pylist()))  # sums of floats depend on their order
            n, parts = np.array([r[0] for r in rows], np.float64), np.stack([np.frombuffer(r[1], np.float32) for r in rows])
            part = np.where(np.isfinite(parts[0]), (n / n.sum()) @ np.where(np.isfinite(parts), parts, 0.0), parts[0]).astype(np.float32)
            return pa.table({"name": group.column("name").slice(0, 1), "at": group.column("at").slice(0, 1), "part": pa.array([part.tobytes()], pa.binary())})

        some = table.where(F.pmod(F.xxhash64("block"), F.lit(rounds)) == turn).select("held", "sizes", "codes", "words")
        learned = some.coalesce(context.defaultParallelism).mapInArrow(run, "name string, at long, n long, part binary")
        for r in learned.groupBy("name", "at").applyInArrow(mean, "name string, at long, part binary").collect():  # the parameters
            value = model.p[r["name"]]
            value[r["at"] : r["at"] + _CHUNK] = np.frombuffer(r["part"], np.float32).reshape(-1, value.shape[1])
    return model


def prepare(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Staged blocks, their words (block, pos, w), and staged counts (word, c) of the training part."""
    table = blocks(docs)
    mine = table.select("block", F.posexplode(F.arrays_zip("words", "train_n")).alias("pos", "w"))
    return table, mine, staged(mine.groupBy(F.col("w.words").alias("word")).agg(F.sum("w.train_n").alias("c")).where("c > 0"), "lm-counts")


def scored(table: DataFrame, mine: DataFrame, counts: DataFrame, stats: Stats, model: Model) -> DataFrame:
    """Scores of all documents of the blocks."""
    spark, n, v, n_other, v_other = table.sparkSession, stats.n, stats.v, stats.n_other, stats.v_other
    shared, size = spark.sparkContext.broadcast(model), model.size  # vocabulary_size(n) vectors

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        at, packed = right.column("pos").to_numpy(), right.column("packed").to_numpy()
        for row in left.to_pylist():
            codes, sizes = _unpress(row["codes"]), np.array(row["sizes"], np.int64)
            c, entry = np.zeros(codes.max() + 1), np.zeros(codes.max() + 1, np.int64)
            c[at], entry[at] = packed // size, packed % size
            entry[0] = END
            now = entry[codes]
            begins = np.cumsum(sizes) - sizes
            base = np.log10((c + 1.0) / (n + v + 1.0))[codes]
            rest = np.log10((c + 1.0) / (n_other + v_other + 1.0))[codes]
            lm = shared.value.log_probs(contexts(now, sizes), now) / np.log(10) + np.where(now == OTHER, rest, 0.0)
            add = lambda x: pa.array(np.add.reduceat(x, begins))
            parts.append(pa.table([pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(row["sizes"], pa.int64()), add((c > 0)[codes].astype(np.int64)), pa.array([n] * len(begins), pa.int64()), add(base), add(lm)], names))
        return pa.concat_tables(parts) if parts else pa.table([pa.array([], f.type) for f in kinds], names)

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds = pa.schema(list(zip(names, [pa.int64(), pa.bool_(), *[pa.int64()] * 3, pa.float64(), pa.float64()])))
    entries = spark.createDataFrame([(bytearray(w), i) for w, i in stats.entries.items()], "word binary, entry long")
    numbered = counts.join(F.broadcast(entries), "word", "left")  # vocabulary_size(n) rows
    packed = (F.col("c") * size + F.coalesce("entry", F.lit(OTHER))).alias("packed")
    back = mine.select("block", "pos", F.col("w.words").alias("word")).join(numbered, "word").select(F.col("block").alias("of_block"), F.col("pos").cast("long").alias("pos"), packed)
    whole = table.select("block", "doc_ids", "held", "sizes", "codes")
    return whole.groupBy("block").cogroup(back.groupBy("of_block")).applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score(docs: DataFrame, size: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every text."""
    table, mine, counts = prepare(docs)
    stats = statistics(counts, size)
    return scored(table, mine, counts, stats, train(table, stats))
