"""Near-duplicate groups by b-bit MinHash, confirmed on the full shingle sets.

One pass over the texts hashes five-word shingles, takes 128 minima, packs their low two
bits into a signature and mixes each four minima into a band key. Texts with the same
shingle set form one class from there on, so copies cost nothing more. Classes that share
a band key are candidates; of these, a bit count over two signatures, corrected for the
quarter of low bits that agree by chance, drops what is far below the threshold, and the
rest is confirmed by intersecting the full sets.

Buckets are never expanded into all their pairs: in a few rounds each bucket compares its
members with one leader (another one each round) and components grow from the confirmed
links; members in the leader's component are skipped. Of what is left in different components,
a member is set aside if too few of its shingles occur in any other component to reach the
threshold with whatever text; the others are compared completely, on arrays, by tests that
bound the similarity from above (sizes, signatures, bitmaps of the sets), each pair in the first
band it shares. Large buckets fall into parts, and each two parts are a piece of work of their own. So no
link between members of a bucket is lost. Components are found by alternating large-star and small-star
steps; all tables between steps lie in the shared folder.

A pair of similarity 0.75 shares no band with probability (1 - 0.75^4)^32 = 5e-6.

Defined cases: a text with fewer than five words is one shingle as a whole; one without
words is linked with nothing; a null text counts as empty. A null id never becomes a
component's id unless all its ids are null. Rows that repeat an id are judged each by
their text. A very long text is one set like any other. Ties between leaders go by digest.
An empty table gives an empty result. Further columns, of any name, are neither read nor
changed.

Texts are read twice at most: for the signatures, and for the full sets of classes that share
a band. Tables of intermediate steps are deleted before the result is returned.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.llm import pieces
from quillsift.llm.common import join_small, scratch, staged, unused

WORDS = 5
HASHES, ROWS = 128, 4
BITS = 2
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Estimates below this are six standard deviations under the threshold.
CUT = 0.47
#: Members of one part of a bucket in complete comparisons, and 64-bit words that one step of them holds.
PART, CELLS = 2048, 1 << 21
#: Rounds with leaders go on until one confirms less than this part of what the best one did.
SHRINK = 20

_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    import xxhash

    found, of = pieces.words(*pieces.buffers(texts))
    if not len(found):
        return [np.zeros(0, np.uint64)] * len(texts)
    code, distinct = pieces.coded(found)
    word = np.fromiter(map(xxhash.xxh64_intdigest, distinct.to_pylist()), np.uint64, len(distinct))[code]
    wide = np.zeros(max(0, len(word) - WORDS + 1), np.uint64)
    for j in range(WORDS):
        wide = wide * np.uint64(0x9E3779B97F4A7C15) + word[j : j + len(wide)]
        wide ^= wide >> np.uint64(29)
    wide = _mix(wide)
    out = []
    for a, b in zip(of[:-1].tolist(), of[1:].tolist()):
        if b - a >= WORDS:
            s = np.sort(wide[a : b - WORDS + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        else:
            out.append(np.array([xxhash.xxh64_intdigest(word[a:b].tobytes(), seed=1)] if b > a else [], np.uint64))
    return out


def digest(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def minima(shingles: np.ndarray) -> np.ndarray:
    low = np.full(HASHES, np.uint64(2**64 - 1))
    for at in range(0, len(shingles), 2048):
        low = np.minimum(low, (shingles[at : at + 2048, None] * _A + _B).min(axis=0))
    return low


def sign(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of BITS low bits a hash in 64-bit words, and band keys, for rows of minima."""
    bits = (_mix(low) & np.uint64((1 << BITS) - 1)).reshape(len(low), -1, 64 // BITS)
    packed = (bits << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64)
    rows, key = low.reshape(len(low), -1, ROWS), np.zeros((len(low), HASHES // ROWS), np.uint64)
    for j in range(ROWS):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, j])
    return packed.view(np.int64), _mix(key + np.arange(HASHES // ROWS, dtype=np.uint64)).view(np.int64)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n, digest, sig, bands of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces.slices(batch, "text"):
                sets = shingle_sets(part.column("text"))
                sig, bands = sign(np.stack([minima(s) for s in sets]))
                yield pa.record_batch([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(map(digest, sets), pa.binary()), _lists(sig), _lists(bands)], ["doc_id", "n", "digest", "sig", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, digest binary, sig array<long>, bands array<long>")


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """One bit for each hash modulo a power of two of 8 bits a shingle or more; halves of a longer map fold onto a shorter one."""
    size = 64 << max(0, (len(shingles) - 1).bit_length() - 3)
    bits = np.zeros(size, bool)
    bits[(shingles & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view("<i8")


def full_sets(docs: DataFrame) -> DataFrame:
    """digest, shingles (array of hashes), bits (their bitmap) of every text that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces.slices(batch, "text"):
                sets = [s for s in shingle_sets(part.column("text")) if len(s)]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.record_batch([pa.array(map(digest, sets), pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array([bitmap(s) for s in sets], pa.list_(pa.int64()))], ["digest", "shingles", "bits"])

    return docs.select("text").mapInArrow(run, "digest binary, shingles array<long>, bits array<long>")


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two signatures: agreeing hashes by bit count, less the share that agrees by chance."""
    low, differ = F.lit(0x5555555555555555), F.lit(0)
    for i in range(HASHES * BITS // 64):
        x = a[i].bitwiseXOR(b[i])
        differ = differ + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(low))
    chance = 1.0 / (1 << BITS)
    return (1.0 - differ / HASHES - chance) / (1.0 - chance)


def near(a_n: Column, b_n: Column, a_sig: Column, b_sig: Column) -> Column:
    """Sizes allow the threshold, and the estimate is not far below it."""
    return (F.least(a_n, b_n) * 100 >= F.greatest(a_n, b_n) * PERCENT) & (estimate(a_sig, b_sig) >= CUT)


def sets_of(asked: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Staged (digest, shingles, bits) of the asked digests. The texts with the least id of an asked class are read again,
    once for all rounds; they are exchanged only where the ids are too many to broadcast."""
    lows = staged(classes.join(asked, "digest", "left_semi").select(F.col("low").alias("of")).distinct(), "asked-ids")
    some = join_small(docs.select("doc_id", "text"), lows, F.col("doc_id").eqNullSafe(F.col("of")), "left_semi")
    return staged(join_small(full_sets(some), staged(asked, "asked"), "digest", "left_semi").groupBy("digest").agg(F.first("shingles").alias("shingles"), F.first("bits").alias("bits")), "sets")


def parted(left: DataFrame) -> DataFrame:
    """Rows of ``left`` with the two parts ``i`` <= ``j`` of their bucket that meet: every pair of a bucket's members meets once.
    Buckets of more than PART members fall into parts by digest, and a member comes once for each part that its own one meets."""
    sizes = staged(left.groupBy("band").agg(F.count("*").alias("m")).where(F.col("m") > PART), "large-buckets")
    cut = join_small(left, sizes, "band", "left").withColumn("parts", F.coalesce(F.ceil(F.col("m") / PART), F.lit(1)))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("digest"), "parts").cast("int")).withColumn("met", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)))
    return cut.withColumns({"i": F.least("part", "met"), "j": F.greatest("part", "met")}).drop("m", "parts", "met")


def _matrix(column: pa.Array, wide: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, wide)


def meetings(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the two rows of each pair that meets, a million pairs or so at a time. Rows lie by band, i, j and part."""
    band, i, j, part = (rows.column(c).to_numpy() for c in ("band", "i", "j", "part"))
    begins = np.flatnonzero(np.concatenate([[True], (band[1:] != band[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
    sizes = np.diff(np.append(begins, len(band)))
    end, here = np.repeat(begins + sizes, sizes), np.arange(len(band))
    second = np.repeat(begins + np.add.reduceat((part == i).astype(np.int64), begins), sizes)
    first = np.where(i == j, here + 1, np.where(part == i, second, end))
    upto = np.cumsum(end - first)
    lo = 0
    while lo < len(here):
        done = upto[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, done + CELLS // 4, "right")))
        many = (end - first)[lo:hi]
        a = np.repeat(here[lo:hi], many)
        yield a, np.arange(len(a)) + np.repeat(first[lo:hi] - (upto[lo:hi] - many - done), many)
        lo = hi


def tested(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Those pairs of :func:`meetings` in different components that tests from above cannot rule out, each in the first band it shares."""
    n, most, band = (rows.column(c).to_numpy() for c in ("n", "most", "band"))
    comp = rows.column("comp").combine_chunks().dictionary_encode().indices.to_numpy()
    sig, bands, maps = (rows.column(c).combine_chunks() for c in ("sig", "bands", "bits"))
    sig, bands = _matrix(sig, HASHES * BITS // 64), _matrix(bands, HASHES // ROWS)
    flat, wide = maps.flatten().to_numpy(zero_copy_only=False).view(np.uint64), maps.value_lengths().to_numpy()
    begin, place, bits = np.cumsum(wide) - wide, np.zeros(len(wide), np.int64), {}
    for w in np.unique(wide).tolist():
        mine = np.flatnonzero(wide == w)
        place[mine], bits[w] = np.arange(len(mine)), flat[begin[mine][:, None] + np.arange(w)]
    chance = 1.0 / (1 << BITS)

    def likely(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = sig[a] ^ sig[b]
        differ = np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(axis=1, dtype=np.int64)
        return (1.0 - differ / HASHES - chance) / (1.0 - chance) >= CUT

    def at_first(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return bands[a, (bands[a] == bands[b]).argmax(axis=1)] == band[a].view(np.uint64)

    def reach(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """False only for pairs that cannot be linked: a bit that only one of two bitmaps has stands for a shingle that only it has,
        so bit counts bound the intersection from above."""
        out = np.ones(len(a), bool)
        kinds = wide[a].astype(np.int64) << 32 | wide[b]
        for kind in np.unique(kinds).tolist():
            small = min(kind >> 32, kind & 0xFFFFFFFF)
            if max(kind >> 32, kind & 0xFFFFFFFF) > 2 * small:
                continue
            mine = np.flatnonzero(kinds == kind)
            for lo in range(0, len(mine), max(1, CELLS // (4 * small))):
                at = mine[lo : lo + max(1, CELLS // (4 * small))]
                x, y = (v if v.shape[1] == small else v[:, :small] | v[:, small:] for v in (bits[int(w)][place[p]] for w, p in ((kind >> 32, a[at]), (kind & 0xFFFFFFFF, b[at]))))
                total = lambda v: np.bitwise_count(v).sum(axis=1, dtype=np.int64)
                both = total(x & y)
                top = np.minimum(n[a[at]] - total(x) + both, n[b[at]] - total(y) + both)
                out[at] = top * 100 >= (n[a[at]] + n[b[at]] - top) * PERCENT
        return out

    for a, b in meetings(rows):
        least = np.minimum(most[a], most[b])
        ok = (comp[a] != comp[b]) & (np.minimum(n[a], n[b]) * 100 >= np.maximum(n[a], n[b]) * PERCENT) & (least * 100 >= (n[a] + n[b] - least) * PERCENT)
        a, b = a[ok], b[ok]
        for test in (likely, at_first, reach):
            for_sure = [test(a[lo : lo + CELLS // 32], b[lo : lo + CELLS // 32]) for lo in range(0, len(a), CELLS // 32)]
            ok = np.concatenate(for_sure) if for_sure else np.zeros(0, bool)
            a, b = a[ok], b[ok]
        yield a, b


def linkable(parts: DataFrame) -> DataFrame:
    """(p, q) of digests: pairs of :func:`parted` rows that are to be confirmed. Whole groups of (band, i, j) are compared by arrays,
    many small ones at once; a task holds one batch and the group that goes on in the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in itertools.chain(batches, [None]):
            rows = pa.Table.from_batches([x for x in (rest, batch) if x is not None]).combine_chunks() if rest is not None or batch is not None else None
            if rows is None or not rows.num_rows:
                continue
            cut = rows.num_rows
            if batch is not None:
                last = [rows.column(c).to_numpy() == rows.column(c)[-1].as_py() for c in ("band", "i", "j")]
                cut = int(np.argmax(last[0] & last[1] & last[2]))
            rest = rows.slice(cut).combine_chunks().to_batches()[0] if cut < rows.num_rows else None
            if cut:
                whole = rows.slice(0, cut)
                names = whole.column("digest").combine_chunks()
                for a, b in tested(whole):
                    if len(a):
                        yield pa.record_batch([names.take(pa.array(a)), names.take(pa.array(b))], ["p", "q"])
        pieces.release()

    columns = ["band", "i", "j", "part", "digest", "n", "comp", "most", "sig", "bands", "bits"]
    return parts.select(*columns).repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "part").mapInArrow(run, "p binary, q binary")


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b of digests) whose full sets reach the threshold."""
    got = pairs.join(sets.select(F.col("digest").alias("b"), F.col("shingles").alias("sb")), "b").join(sets.select(F.col("digest").alias("a"), F.col("shingles").alias("sa")), "a")
    both = F.size(F.array_intersect("sa", "sb"))
    return staged(got.where(both * 100 >= (F.size("sa") + F.size("sb") - both) * PERCENT).select("a", "b"), "links")


def shareable(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(digest, most) of the members (digest, n, comp) that can still be linked with another component: ``most`` of their
    shingles occur in other components, which bounds every intersection from above, and at least PERCENT of n is needed."""
    tokens = sets.join(members, "digest").select("digest", F.xxhash64("comp").alias("comp"), F.explode("shingles").alias("token"))
    across = tokens.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("token")
    most = tokens.select("token", "digest").join(across, "token", "left_semi").groupBy("digest").agg(F.count("*").alias("most"))
    return staged(most.join(members.select("digest", "n"), "digest").where(F.col("most") * 100 >= F.col("n") * PERCENT).select("digest", "most"), "shareable")


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node reached) for all nodes of edges (a, b), by alternating stars."""
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    while True:
        e = staged(e, "edges")
        total = e.count()
        if total == e.select("a").distinct().count() and e.join(e.select(F.col("a").alias("x")), F.col("b") == F.col("x"), "left_semi").isEmpty():
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        low = e.union(e.select("b", "a")).groupBy("a").agg(F.min("b").alias("lo")).select(F.col("a").alias("x"), F.least("a", "lo").alias("lo"))
        e = staged(join_small(e, staged(low, "low"), F.col("b") == F.col("x")).select("a", F.col("lo").alias("b")).where("a <> b").distinct(), "large")
        low = staged(e.groupBy("a").agg(F.min("b").alias("lo")), "low")
        rest = join_small(e, low, "a").where("b <> lo").select(F.col("b").alias("a"), F.col("lo").alias("b"))
        e = rest.union(low.select("a", F.col("lo").alias("b"))).distinct()


def _grown(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels (digest, comp) after more links between digests."""
    if labels is None:
        return staged(components(links).select(F.col("node").alias("digest"), F.col("root").alias("comp")), "labels")
    of = lambda c: F.coalesce(F.col("comp"), F.col(c))
    known = lambda c: labels.select(F.col("digest").alias(c), "comp")
    up = links.join(known("a"), "a", "left").select(of("a").alias("a"), "b").join(known("b"), "b", "left").select("a", of("b").alias("b"))
    roots = staged(components(up), "roots")
    old = labels.join(roots.withColumnRenamed("node", "comp"), "comp", "left").select("digest", F.coalesce("root", "comp").alias("comp"))
    return staged(old.union(roots.select("node", "root")), "labels")


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    rows = staged(signatures(docs), "signatures", keep=True)
    with scratch(docs.sparkSession):
        ids = _named(docs, rows)
    out = join_small(rows.select("doc_id", "n", "digest"), ids, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _named(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Staged (digest, least): the least id of each class's component."""
    classes = staged(rows.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("low"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "classes")
    keyed = classes.select("digest", F.explode("bands").alias("band"))
    shared = staged(keyed.groupBy("band").count().where("count > 1").select("band"), "shared-bands")
    crowded = staged(join_small(keyed, shared, "band"), "crowded").join(classes.select("digest", "n", "sig"), "digest")
    crowded = staged(crowded.select("band", "digest", "n", "sig"), "crowded")
    labels: DataFrame | None = None
    sets: DataFrame | None = None
    turn, leaders, most = 0, True, 0
    while True:
        marked = crowded.withColumn("comp", F.col("digest"))
        if labels is not None:
            marked = crowded.join(labels, "digest", "left").withColumn("comp", F.coalesce("comp", "digest"))
        head = F.min(F.struct(F.xxhash64(F.lit(turn), "digest").alias("h"), "digest", "n", "sig", "comp")).alias("head")
        mixed = marked.groupBy("band").agg(head, F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("band", "head")
        mixed, marked = staged(mixed, "mixed"), staged(marked, "marked")
        if mixed.isEmpty():
            break
        if sets is None:
            sets = sets_of(crowded.select("digest").distinct(), docs, classes)
        if leaders:
            found = join_small(marked, mixed, "band").where(F.col("comp") != F.col("head.comp"))
            found = found.where(near(F.col("n"), F.col("head.n"), F.col("sig"), F.col("head.sig"))).select(F.col("digest").alias("p"), F.col("head.digest").alias("q"))
            pairs = staged(found.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), "pairs")
            asked = staged(pairs.select(F.col("a").alias("digest")).union(pairs.select("b")).distinct(), "asked")
            links = pairs if pairs.isEmpty() else confirm(pairs, join_small(sets, asked, "digest", "left_semi"))
        else:
            left = staged(join_small(marked, mixed.select("band"), "band", "left_semi"), "left")
            members = staged(left.select("digest", "n", "comp").distinct(), "members")
            able = shareable(members, sets).join(sets.select("digest", "bits"), "digest").join(classes.select("digest", "bands"), "digest")
            left = staged(join_small(left, staged(able, "able"), "digest"), "left")
            found = linkable(parted(left))
            pairs = staged(found.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), "pairs")
            links = pairs if pairs.isEmpty() else confirm(pairs, sets)
        new = links.count()
        if new:
            labels = _grown(labels, links)
        if not leaders:
            break
        most = max(most, new)
        turn, leaders = turn + 1, new * SHRINK >= most > 0
    named = classes.select("digest", "low").withColumn("comp", F.col("digest"))
    if labels is not None:
        named = classes.select("digest", "low").join(labels, "digest", "left").withColumn("comp", F.coalesce("comp", "digest"))
    named = staged(named, "named")
    least = staged(named.groupBy("comp").agg(F.min("low").alias("least")), "least")
    return staged(join_small(named, least, "comp").select("digest", "least"), "ids", keep=True)


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id its group keeps; rows that share an id stay or go together."""
    name = unused(docs, "gone")
    gone = groups(docs).groupBy("doc_id").agg(F.max("kept").alias("kept")).where(~F.col("kept")).select(F.col("doc_id").alias(name))
    return join_small(docs, staged(gone, "gone"), F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")
