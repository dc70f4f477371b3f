"""Nearest neighbours by multiprobe p-stable hashing, Euclidean distance.

A table hashes a vector by six Gaussian projections, shifted and cut into slots of a width
proportional to the radius searched. For a neighbour at distance r the difference of two
projections is normal with deviation r, so a query knows for each of its own and the
adjacent slots how likely the neighbour lies there, and by products for each perturbed
bucket. It visits buckets of all tables in that order of estimated success until the
estimated miss over all tables is at most ``1 - success``.

Radii come from the data: a bounded sample of the queries (``SAMPLE``, by smallest digest)
is searched exactly over all rows, and quantiles of the distances to their farthest wanted
neighbour are the radii, from small to large. A query is settled at a radius if its wanted
neighbours all lie within it, for then each was found with at least that probability; the
others go on to the next one. What no radius settles (isolated vectors, or queries that would
visit more than ``PROBES`` buckets) is compared with all rows, exactly, in blocks of queries.

Distances within a bucket are exact: a product of matrices finds who can be near, with slack
for its rounding, and differences decide. Only a query's nearest leave a bucket, never pairs.
Equal vectors are one item with their smallest ids. Buckets with many items or many queries
are split into parts of both, every part of items meeting every part of queries, so no task
holds a hot bucket; sums of counts find them.

Defined cases: vectors that are null, zero or empty, or hold null or non-finite entries, take
no part, nor do rows without an id. Vectors of different lengths have no distance; a query's
candidates are those of its own length. Repeated rows count once. Different vectors under one
id are queries of their own (with a row of ranks each) and candidates of others, but never
neighbours of their own id. Ties go to the smaller id. With fewer candidates than wanted
all are returned; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillsift.llm.common import join_small, scratch, staged
from quillsift.llm.vectors import matrices

TABLES, HASHES = 4, 6
#: Width of a slot in radii.
WIDTH = 3.0
#: Estimated probability with which a neighbour within the radius is in a visited bucket.
SUCCESS = 0.95
#: A query that would visit more buckets is searched at the next radius, in the end exactly.
PROBES = 512
#: Queries whose exact distances give the radii, the quantiles used, and the ratio below which the smaller radius is left out.
SAMPLE, QUANTILES, RATIO = 128, (0.1, 0.5, 0.95), 1.5
#: Items and queries in a part of a bucket.
ITEMS, QUERIES = 4096, 512
#: Bytes of queries that meet all rows in one pass.
BLOCK_BYTES = 16 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=64)
def projections(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Gaussian directions (length x tables * hashes) and shifts in slots, the same everywhere."""
    rng = np.random.default_rng([12, length])
    return rng.standard_normal((length, TABLES * HASHES)), rng.random(TABLES * HASHES)


def slots(block: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Slots and the places within them, (rows, tables, hashes)."""
    directions, shifts = projections(block.shape[1])
    at = (block @ directions / (WIDTH * radius) + shifts).reshape(len(block), TABLES, HASHES)
    whole = np.floor(at)
    return np.clip(whole, -(2.0**62), 2.0**62).astype(np.int64), at - whole


def cells(slot: np.ndarray, length: int) -> np.ndarray:
    """One number for each bucket: (rows, tables, ..., hashes) -> (rows, tables, ...). Buckets of other tables and lengths have others."""
    key = np.full(slot.shape[:-1], length, np.uint64) + np.arange(TABLES, dtype=np.uint64).reshape(1, -1, *[1] * (slot.ndim - 3)) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(HASHES):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + slot[..., j].astype(np.uint64))
    return key.view(np.int64)


_STEPS = np.stack(np.meshgrid(*[[-1, 0, 1]] * HASHES, indexing="ij"), axis=-1).reshape(-1, HASHES)


def success(place: np.ndarray) -> np.ndarray:
    """Probability that a neighbour at the radius lies in each perturbed bucket: (rows, tables, hashes) -> (rows, tables, 3^hashes), in the order of _STEPS."""
    edges = np.stack([(d - place) * WIDTH for d in (-1, 0, 1, 2)], axis=-1)
    below = 0.5 * (1 + np.vectorize(math.erf, otypes=[float])(edges / math.sqrt(2)))
    mass = np.diff(below, axis=-1)
    out = mass[:, :, 0, :]
    for j in range(1, HASHES):
        out = (out[..., :, None] * mass[:, :, j, None, :]).reshape(*out.shape[:2], -1)
    return out


def visits(block: np.ndarray, radius: float, wanted: float = SUCCESS) -> list[np.ndarray]:
    """The buckets that each query visits, in order; none for a query that would need more than PROBES."""
    slot, place = slots(block, radius)
    chance, out = success(place), []
    for s, c in zip(slot, chance):
        order = np.argsort(-c.reshape(-1), kind="stable")[:PROBES]
        table, step = np.divmod(order, len(_STEPS))
        reached = np.cumsum((table[:, None] == np.arange(TABLES)) * c.reshape(-1)[order, None], axis=0)
        enough = np.flatnonzero(np.prod(1 - reached, axis=1) <= 1 - wanted)
        if not len(enough):
            out.append(np.zeros(0, np.int64))
            continue
        n = enough[0] + 1
        every = cells((s[:, None, :] + _STEPS[None])[None], block.shape[1])[0]
        out.append(every[table[:n], step[:n]])
    return out


def nearest(q: np.ndarray, x: np.ndarray, low: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of the ``keep`` nearest rows of each query, ties by ``low``."""
    with np.errstate(over="ignore", invalid="ignore"):
        norms, own = (x * x).sum(axis=1), (q * q).sum(axis=1)
        d2 = own[:, None] + norms - 2 * (q @ x.T)
        if len(x) > keep and np.isfinite(d2).all():
            i, j = np.nonzero(d2 <= (np.partition(d2, keep - 1, axis=1)[:, keep - 1] + 1e-9 * (own + norms.max()))[:, None])
        else:
            i, j = (a.reshape(-1) for a in np.indices(d2.shape))
        far = np.sqrt(((q[i] - x[j]) ** 2).sum(axis=1))
    return _cut(i, j, far, low[j], keep)


def _cut(i, j, far, low, keep):
    order = np.lexsort((low, far, i))
    i, j, far = i[order], j[order], far[order]
    starts = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else np.zeros(0, np.int64)
    nth = np.arange(len(i)) - np.repeat(starts, np.diff(np.append(starts, len(i))))
    return i[nth < keep], j[nth < keep], far[nth < keep]


def items(vectors: DataFrame, every: int, keep: int) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors (key, vec, asked, ids: their ``keep`` smallest ids), and the queries (key, query_id)."""
    kind = vectors.schema["embedding"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, block in matrices(batch.column("embedding")):
                some = (block != 0).any(axis=1)
                keys = [hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in block[some] + 0.0]
                part = batch.take(pa.array(rows[some]))
                yield pa.record_batch([pa.array(keys, pa.binary()), part.column("vec_id"), part.column("embedding")], ["key", "vec_id", "vec"])

    base = staged(vectors.select("vec_id", "embedding").filter("vec_id IS NOT NULL").mapInArrow(run, f"key binary, vec_id long, vec {kind}"), "vectors")
    asked = F.col("vec_id") % every == 0
    named = base.select("key", "vec_id").distinct()
    first = named.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))).filter(F.col("nth") <= keep)
    ids = first.groupBy("key").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    one = base.groupBy("key").agg(F.any_value("vec").alias("vec"), F.bool_or(asked).alias("asked"))
    return staged(one.join(ids, "key"), "items"), staged(named.filter(asked).select("key", F.col("vec_id").alias("query_id")), "queries")


def _dense(column: pa.Array) -> np.ndarray:
    return column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _low(ids: pa.Array) -> np.ndarray:
    return pc.list_element(ids, 0).to_numpy(zero_copy_only=False)


def everything(all_items: DataFrame, queries: DataFrame, keep: int) -> DataFrame:
    """(qkey, key, ids, distance): the nearest items of each query by comparison with all, a pass for each BLOCK_BYTES of queries."""
    total = queries.agg(F.count("*").alias("n"), F.sum(F.size("vec") * 8 + 64).alias("bytes")).first()
    blocks = max(1, -(-(total["bytes"] or 0) // BLOCK_BYTES))
    schema = "qkey binary, key binary, ids array<long>, distance double"
    out = all_items.sparkSession.createDataFrame([], schema)
    for number in range(blocks if total["n"] else 0):
        rows = queries.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == number).select("key", "vec").collect()  # about BLOCK_BYTES
        by_length: dict[int, list] = {}
        for r in rows:
            by_length.setdefault(len(r["vec"]), []).append(r)
        sides = {n: ([bytes(r["key"]) for r in some], np.array([r["vec"] for r in some], np.float64)) for n, some in by_length.items()}

        def run(batches: Iterator[pa.RecordBatch], sides=sides) -> Iterator[pa.RecordBatch]:
            best: dict[int, pa.Table] = {}
            for batch in batches:
                for at, x in matrices(batch.column("vec")):
                    if x.shape[1] not in sides or not len(x):
                        continue
                    q, part = sides[x.shape[1]][1], batch.take(pa.array(at))
                    low, found = _low(part.column("ids")), []
                    for start in range(0, len(q), QUERIES):
                        i, j, far = nearest(q[start : start + QUERIES], x, low, keep)
                        found.append((i + start, j, far))
                    i, j, far = (np.concatenate(c) for c in zip(*found))
                    more = pa.table([pa.array(i), part.column("key").take(pa.array(j)), part.column("ids").take(pa.array(j)), pa.array(low[j]), pa.array(far)], ["q", "key", "ids", "low", "distance"])
                    both = pa.concat_tables([best[x.shape[1]], more]).combine_chunks() if x.shape[1] in best else more
                    _, kept, _ = _cut(both["q"].to_numpy(), np.arange(len(both)), both["distance"].to_numpy(), both["low"].to_numpy(), keep)
                    best[x.shape[1]] = both.take(pa.array(kept))
            for n, t in best.items():
                names = pa.array(sides[n][0], pa.binary()).take(t["q"].combine_chunks())
                for b in pa.table([names, t["key"], t["ids"], t["distance"]], ["qkey", "key", "ids", "distance"]).to_batches(65536):
                    yield b

        out = out.unionByName(staged(all_items.select("key", "vec", "ids").mapInArrow(run, schema), "compared"))
    return out


def hashed(all_items: DataFrame, queries: DataFrame, radius: float, keep: int) -> tuple[DataFrame, DataFrame]:
    """(qkey, key, ids, distance) of the nearest items in the visited buckets, and the keys of the queries that visited any."""
    kind = all_items.schema["vec"].dataType.simpleString()

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, block in matrices(batch.column("vec")):
                part = batch.take(pa.array(np.repeat(rows, TABLES)))
                yield pa.record_batch([pa.array(cells(slots(block, radius)[0], block.shape[1]).reshape(-1)), *(part.column(c) for c in ("key", "vec", "ids"))], ["cell", "key", "vec", "ids"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, block in matrices(batch.column("vec")):
                for start in range(0, len(rows), QUERIES):
                    found = visits(block[start : start + QUERIES], radius)
                    part = batch.take(pa.array(np.repeat(rows[start : start + QUERIES], [len(f) for f in found])))
                    yield pa.record_batch([pa.array(np.concatenate(found)), part.column("key"), part.column("vec")], ["cell", "key", "vec"])

    indexed = all_items.select("key", "vec", "ids").mapInArrow(index, f"cell long, key binary, vec {kind}, ids array<long>")
    probes = staged(queries.select("key", "vec").mapInArrow(probe, f"cell long, key binary, vec {kind}"), "probes")
    heavy = lambda df, most, name: staged(df.groupBy("cell").count().filter(F.col("count") > most).select("cell", F.ceil(F.col("count") / most).cast("int").alias(name)), name)
    items_in, queries_in = heavy(indexed, ITEMS, "parts"), heavy(probes, QUERIES, "blocks")

    def dealt(df: DataFrame, own: str, other: str, kind: int) -> DataFrame:
        df = join_small(join_small(df, items_in, "cell", "left"), queries_in, "cell", "left").fillna(1, ["parts", "blocks"])
        mine = F.pmod(F.xxhash64("key"), F.col(own)).cast("int")
        return df.withColumns({own: mine, other: F.explode(F.sequence(F.lit(0), F.col(other) - 1)), "kind": F.lit(kind)})

    sides = dealt(probes, "blocks", "parts", 0).unionByName(dealt(indexed, "parts", "blocks", 1), allowMissingColumns=True)
    together = sides.repartition("cell", "parts", "blocks").sortWithinPartitions("cell", "parts", "blocks", "kind")

    def compare(group: pa.Table) -> pa.RecordBatch | None:
        n = int(pc.sum(pc.equal(group["kind"], 0)).as_py())
        if n in (0, len(group)):
            return None
        q, x = group.slice(0, n).combine_chunks(), group.slice(n).combine_chunks()
        low = _low(x["ids"].chunk(0))
        i, j, far = nearest(_dense(q["vec"].chunk(0)), _dense(x["vec"].chunk(0)), low, keep)
        return pa.record_batch([q["key"].chunk(0).take(pa.array(i)), x["key"].chunk(0).take(pa.array(j)), x["ids"].chunk(0).take(pa.array(j)), pa.array(far)], ["qkey", "key", "ids", "distance"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the group that a batch has left unfinished
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            name = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("cell", "parts", "blocks")], axis=1)
            starts = [0, *(np.flatnonzero((name[1:] != name[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(starts, starts[1:]):
                if held and tuple(name[a]) != last:
                    found = compare(pa.Table.from_batches(held))
                    if found is not None:
                        yield found
                    held = []
                held.append(batch.slice(a, b - a))
                last = tuple(name[a])
        if held:
            found = compare(pa.Table.from_batches(held))
            if found is not None:
                yield found

    return together.mapInArrow(meet, "qkey binary, key binary, ids array<long>, distance double"), probes.select("key").distinct()


def merged(found: DataFrame, keep: int) -> DataFrame:
    """qkey, near: the ``keep`` nearest (distance, id) of each query, in order. An item that several tables found counts once."""
    once = found.groupBy("qkey", "key").agg(F.min("distance").alias("distance"), F.any_value("ids").alias("ids"))
    ranked = once.withColumn("nth", F.row_number().over(Window.partitionBy("qkey").orderBy("distance", F.element_at("ids", 1)))).filter(F.col("nth") <= keep)
    pairs = F.transform("ids", lambda i: F.struct(F.col("distance"), i.alias("id")))
    return ranked.groupBy("qkey").agg(F.slice(F.sort_array(F.flatten(F.collect_list(pairs))), 1, keep).alias("near"))


def radii(all_items: DataFrame, queries: DataFrame, keep: int) -> list[float]:
    """Radii to search at, from small to large: quantiles of the exact distances of a bounded sample of the queries."""
    some = queries.orderBy("key").limit(SAMPLE)
    far = [r["far"] for r in merged(everything(all_items, some, keep), keep).select(F.element_at("near", -1)["distance"].alias("far")).collect()]
    out: list[float] = []
    for r in sorted(np.quantile([f for f in far if f > 0 and math.isfinite(f)], QUANTILES).tolist(), reverse=True) if any(f > 0 and math.isfinite(f) for f in far) else []:
        if not out or out[-1] > RATIO * r:
            out.append(r)
    return out[::-1]


def search(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found for each row whose vec_id is divisible by ``every``."""
    keep = k + 1  # a query finds itself
    with scratch(vectors.sparkSession):
        all_items, named = items(vectors, every, keep)
        left, done = staged(all_items.filter("asked").select("key", "vec"), "left"), []
        for radius in radii(all_items, left, keep):
            found, visited = hashed(all_items, left, radius, keep)
            best = merged(found, keep).join(visited.withColumnRenamed("key", "qkey"), "qkey", "left_semi")
            settled = staged(best.filter((F.size("near") == keep) & (F.element_at("near", -1)["distance"] <= radius)), "settled")
            done.append(settled)
            left = staged(left.join(settled.select(F.col("qkey").alias("key")), "key", "left_anti"), "left")
        done.append(merged(everything(all_items, left, keep), keep))
        best = done[0]
        for more in done[1:]:
            best = best.unionByName(more)
        others = F.slice(F.filter("near", lambda n: n["id"] != F.col("query_id")), 1, k)
        rows = named.join(best.withColumnRenamed("qkey", "key"), "key").select("query_id", F.posexplode(others).alias("at", "n"))
        return staged(rows.select("query_id", (F.col("at") + 1).alias("rank"), F.col("n.id").alias("vec_id"), F.col("n.distance").alias("score")), "neighbours", keep=True)
