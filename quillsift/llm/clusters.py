"""Centroid clustering with Yinyang bounds.

Centroids are put into groups once. Each vector keeps its centroid, an upper bound of the
distance to it and for each group a lower bound of the distance to the group's other
centroids. After a move of the centroids the bounds are widened by how far they moved. A
vector whose upper bound stays below all its lower bounds keeps its centroid unread (the
global filter); of the others, first the upper bound is made exact, then only groups whose
lower bound is not above it are scanned, exactly, in integers. Bounds are rounded outwards
and ties are scanned, so the result is that of comparing everything with everything.

A round is one pass: the table of vectors with their bounds is read, judged in Arrow
batches and written to the shared folder for the next one; sums of members are added up by
task and then by Spark. The driver holds centroids, groups and sums: k x dimensions numbers.

Defined cases: vectors that are null, have another number of components than ``length`` or
hold entries that are null or not finite take no part; nor do those with a component beyond
2^27 / scale, whose squared distances need not fit 64 bits. Null ids come last among the
candidates for first centroids; rows that repeat an id are vectors of their own, ties between
them go by their components. With fewer vectors than centroids there are as many centroids as
vectors; equal centroids all stay, the first gets the members, empty ones stay where they are.
Equal vectors share everything but their ids. An empty table gives an empty result. Other
columns, of any name, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm.common import scratch, staged
from quillsift.llm.vectors import integers, lists, task_sums

#: Rounds of the grouping of centroids.
GROUPING = 8
#: Outward rounding of bounds: far above the error of a square root and of a few sums.
SLACK = 1e-12


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to integer centroids. Products of doubles are exact while all sums stay below 2^53."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    kind = np.float64 if 4 * x.shape[1] * most * most < 1 << 53 else np.int64
    a, b = x.astype(kind), c.astype(kind)
    return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)


def grouped(centroids: np.ndarray, groups: int) -> np.ndarray:
    """The group of each centroid: a plain k-means over the centroids, with the first ones as seeds."""
    points = centroids.astype(np.float64)
    heads = points[: min(groups, len(points))].copy()
    of = np.zeros(len(points), np.int64)
    for _ in range(GROUPING):
        of = ((points[:, None, :] - heads[None]) ** 2).sum(axis=2).argmin(axis=1)
        for g in range(len(heads)):
            if (of == g).any():
                heads[g] = points[of == g].mean(axis=0)
    return np.unique(of, return_inverse=True)[1]


def _up(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64)) * (1 + SLACK)


def _down(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64)) * (1 - SLACK)


def first(x: np.ndarray, centroids: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Centroid, squared distance, upper bound and lower bounds of each row, by looking at everything."""
    d2 = squared(x, centroids)
    at, rows = d2.argmin(axis=1), np.arange(len(x))
    own = d2[rows, at]
    others = _down(d2)
    others[rows, at] = np.inf
    lower = np.stack([others[:, group == g].min(axis=1, initial=np.inf) for g in range(group.max() + 1)], axis=1)
    return at, own, _up(own), lower


def moved(x: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, group: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Centroids, upper and lower bounds after the centroids moved by ``drift``, and how many distances were computed."""
    at, upper = at.copy(), (upper + drift[at]) * (1 + SLACK)
    farthest = np.array([drift[group == g].max() for g in range(group.max() + 1)])
    lower = np.maximum(lower - farthest, 0) * (1 - SLACK)
    open_ = np.flatnonzero(upper >= lower.min(axis=1))
    looked = len(open_)
    best = ((x[open_] - centroids[at[open_]]) ** 2).sum(axis=1)
    upper[open_] = _up(best)
    still = upper[open_] >= lower[open_].min(axis=1)
    open_, best = open_[still], best[still]
    for g in range(lower.shape[1]):
        members = np.flatnonzero(group == g)
        near = upper[open_] >= lower[open_, g]
        rows, was, had = open_[near], at[open_[near]], best[near]
        if not len(rows):
            continue
        looked += len(rows) * len(members)
        d2 = squared(x[rows], centroids[members])
        far = np.iinfo(np.int64).max
        d2[was[:, None] == members[None]] = far
        nth = d2.argmin(axis=1)
        line = np.arange(len(rows))
        least, which = d2[line, nth], members[nth]
        d2[line, nth] = far
        rest = d2.min(axis=1)
        better = (least < had) | ((least == had) & (least != far) & (which < was))
        # the group's nearest centroid but the row's own
        lower[rows, g] = np.where(np.where(better, rest, least) == far, np.inf, _down(np.where(better, rest, least)))
        left = rows[better]
        lower[left, group[was[better]]] = np.minimum(lower[left, group[was[better]]], _down(had[better]))
        at[left], upper[left] = which[better], _up(least[better])
        best[np.flatnonzero(near)[better]] = least[better]
    return at, upper, lower, looked


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _start(table: DataFrame, centroids: np.ndarray, group: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at, _, upper, lower = first(_matrix(batch.column("x")), centroids, group)
                yield pa.record_batch([batch.column("vec_id"), batch.column("x"), pa.array(at.astype(np.int32)), pa.array(upper), lists(lower)], ["vec_id", "x", "cluster", "upper", "lower"])

    return table.mapInArrow(run, f"vec_id {table.schema['vec_id'].dataType.simpleString()}, x array<long>, cluster int, upper double, lower array<double>")


def _round(state: DataFrame, centroids: np.ndarray, group: np.ndarray, drift: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at, upper, lower, _ = moved(_matrix(batch.column("x")), batch.column("cluster").to_numpy(), batch.column("upper").to_numpy(), _matrix(batch.column("lower")), centroids, group, drift)
                yield pa.record_batch([batch.column("vec_id"), batch.column("x"), pa.array(at.astype(np.int32)), pa.array(upper), lists(lower)], ["vec_id", "x", "cluster", "upper", "lower"])

    return state.mapInArrow(run, state.schema)


def _means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floor of each cluster's mean; an empty cluster's centroid stays."""
    k, size = centroids.shape

    def part(batch: pa.RecordBatch) -> np.ndarray:
        at, x = batch.column("cluster").to_numpy(), _matrix(batch.column("x"))
        out = np.zeros((k, size + 1), np.int64)
        order = np.argsort(at, kind="stable")
        there, starts = np.unique(at[order], return_index=True)
        out[there, :size] = np.add.reduceat(x[order], starts, axis=0)
        out[:, size] = np.bincount(at, minlength=k)
        return out

    sums = np.array(task_sums(state.select("cluster", "x"), part, "long", k * (size + 1)), dtype=object).reshape(k, size + 1)
    return np.array([[s // r[size] for s in r[:size]] if r[size] else c for r, c in zip(sums.tolist(), centroids.tolist())], np.int64)


def _distances(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = batch.column("cluster").to_numpy()
                yield pa.record_batch([batch.column("vec_id"), batch.column("cluster"), pa.array(((_matrix(batch.column("x")) - centroids[at]) ** 2).sum(axis=1))], ["vec_id", "cluster", "distance"])

    return state.mapInArrow(run, f"vec_id {state.schema['vec_id'].dataType.simpleString()}, cluster int, distance long")


def yinyang(vectors: DataFrame, k: int = 16, rounds: int = 3, groups: int = 4, scale: int = 64, length: int = 64, salt: str = "1:") -> tuple[DataFrame, np.ndarray]:
    """The assignments (vec_id, cluster, distance) after ``rounds`` moves of the centroids, as a written table, and the centroids."""
    with scratch(vectors.sparkSession):
        table = staged(integers(vectors, scale, length=length), "vectors")
        seeds = table.orderBy(F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "x").limit(k).collect()
        centroids = np.array([r["x"] for r in seeds], np.int64).reshape(len(seeds), length)
        if not len(centroids):
            return staged(table.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), "clusters", keep=True), centroids
        group = grouped(centroids, groups)
        state = staged(_start(table, centroids, group), "bounds")
        for _ in range(rounds):
            means = _means(state, centroids)
            drift, centroids = _up(((means - centroids) ** 2).sum(axis=1)), means
            state = staged(_round(state, centroids, group, drift), "bounds")
        return staged(_distances(state, centroids), "clusters", keep=True), centroids


def cluster_table(vectors: DataFrame, k: int = 16, rounds: int = 3, groups: int = 4, scale: int = 64, length: int = 64) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part."""
    found, centroids = yinyang(vectors, k, rounds, groups, scale, length)
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    # one row a centroid, k at most
    described = vectors.sparkSession.createDataFrame([(i, sums.get(i, 0), sum(sums.values()), d) for i, d in enumerate(digests)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(described), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
