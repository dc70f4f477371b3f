"""Whitening of embeddings by a matrix-free block Lanczos method.

The covariance is never formed. A pass over the table of integer vectors multiplies the
centred data with a block of vectors, X'(Xv)/n; each task adds up a (dimensions x block)
matrix and Spark adds the tasks'. On the driver the block is orthogonalised twice against
the whole basis; columns that vanish (breakdown: an invariant subspace is exhausted) are
replaced by fresh random directions orthogonal to the basis, so repeated eigenvalues and
further subspaces are found too. The basis and its image give Ritz pairs and their true
residuals. When the residuals of all wanted pairs are at rounding level the iteration starts
again from a random block orthogonal to the basis, as an eigenvalue that occurs more often
than a block has columns would hide; it ends when it converges to the same values once more,
or when the basis spans the whole space.

Centring is exact: with integers x, their sums S and number n, a row's deviations n*x - S
are integers, taken relative to the rounded mean so that products stay in 64 bits. The
trace, and with it the shares that components explain, comes from the squared deviations.
A last pass computes the covariance of the whitened rows and how far it is from the identity.

What the driver holds: sums, the basis and its image, at most dimensions x dimensions numbers.

Defined cases: rows whose vector is null, or holds a null or non-finite entry (or one beyond
2^27 / scale in magnitude, whose square leaves 64 bits), are dropped. All vectors of a table
must have one length to have a covariance; where lengths differ, the commonest one counts
(of equally common ones the longer) and rows of others are dropped. A component without
variance (below 1e-12 of the trace) cannot be scaled: its whitened values are null and it is
left out of the identity check. With one row, or equal rows only, that holds for all.
A deviation beyond 64 bits is null. Null and repeated ids are rows like any other; an empty
table, or vectors without entries, give an empty result. Other columns are not read. Of
components with equal eigenvalues any orthonormal choice is right; the choice is one for all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm.common import staged
from quillsift.llm.vectors import integers, lists, task_sums

#: Vectors multiplied in one pass.
BLOCK = 16
#: Residuals of Ritz pairs, relative to the largest eigenvalue, at which they have converged.
TOLERANCE = 1e-13
#: The same for the pair behind the wanted ones.
ROUGH = 1e-4
#: What is left of a column after orthogonalisation, relative to its length, at which it counts as vanished.
VANISHED = 1e-10
#: Shares of the trace below this are no variance.
NOTHING = 1e-12


@dataclass(frozen=True)
class Model:
    """Sums and number of the fitted rows, eigenvalues by size, unit eigenvectors as columns, shares, and the check of the whitened covariance."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float
    passes: int

    @property
    def scales(self) -> np.ndarray:
        """What projections are divided by; NaN for components without variance."""
        return np.where(self.explained > NOTHING, np.sqrt(np.maximum(self.values, 0)), np.nan)


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - S, exactly: 64-bit integers, or Python's where those could overflow."""
    middle = [(2 * s + n) // (2 * n) for s in sums]
    apart, rest = x - np.array(middle, np.int64), [s - n * m for s, m in zip(sums, middle)]
    if len(apart) and (int(np.abs(apart).max()) + 1) * n >= 1 << 62:
        apart = apart.astype(object)
    return apart * n - np.array(rest, apart.dtype)


def squares(d: np.ndarray) -> list[int | None]:
    """The rows' sums of squares, exactly; None beyond 64 bits."""
    if d.dtype == object or (d.size and int(np.abs(d).max()) ** 2 * d.shape[1] >= 1 << 63):
        return [v if v < 1 << 63 else None for v in (d.astype(object) ** 2).sum(axis=1)]
    return (d * d).sum(axis=1).tolist()


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)


def _fill(block: np.ndarray, basis: np.ndarray, width: int, rng: np.random.Generator) -> np.ndarray:
    """``width`` orthonormal columns orthogonal to ``basis``: what is left of the block's columns, then random ones."""
    out = basis
    pending = list(block.T)
    while out.shape[1] - basis.shape[1] < width:
        v = pending.pop(0) if pending else rng.standard_normal(len(basis))
        size = np.linalg.norm(v)
        if size == 0:
            continue
        v = v / size
        for _ in range(2):
            v = v - out @ (out.T @ v)
        left = np.linalg.norm(v)
        if left > VANISHED:
            v = v / left
            v = v - out @ (out.T @ v)
            out = np.column_stack([out, v / np.linalg.norm(v)])
    return out[:, basis.shape[1] :]


def lanczos(multiply: Callable[[np.ndarray], np.ndarray], size: int, wanted: int, block: int = BLOCK, tolerance: float = TOLERANCE, seed: int = 11) -> tuple[np.ndarray, np.ndarray, int]:
    """Largest eigenvalues, their unit eigenvectors and the passes taken, of the symmetric matrix that ``multiply`` stands for."""
    rng = np.random.default_rng(seed)
    nothing = np.zeros((size, 0))
    basis, image, passes, confirmed = nothing, nothing, 0, None
    fresh = _fill(nothing, basis, min(block, size), rng)
    while True:
        product = multiply(fresh)
        passes += 1
        basis, image = np.column_stack([basis, fresh]), np.column_stack([image, product])
        inner = basis.T @ image
        values, small = np.linalg.eigh((inner + inner.T) / 2)
        values, small = values[::-1][: wanted + 1], small[:, ::-1][:, : wanted + 1]
        vectors = basis @ small
        residuals, largest = np.linalg.norm(image @ small - vectors * values, axis=0), max(abs(values[0]), 1e-300)
        settled = len(values) > wanted and residuals[:wanted].max() <= tolerance * largest and residuals[wanted] <= ROUGH * largest
        values, vectors = values[:wanted], vectors[:, :wanted]
        if basis.shape[1] == size or (settled and confirmed is not None and np.abs(values - confirmed).max() <= 10 * tolerance * largest):
            return values, vectors / np.linalg.norm(vectors, axis=0), passes
        width = min(block, size - basis.shape[1])
        confirmed = values if settled else confirmed
        fresh = _fill(nothing if settled else product, basis, width, rng)


def fit(vectors: DataFrame, components: int = 32, scale: int = 64, shift: int = 0, block: int = BLOCK) -> tuple[DataFrame, Model | None]:
    """The table of integer vectors (vec_id, x) that take part, and the model fitted to all of them (None if there are none)."""
    table = staged(integers(vectors, scale, shift), "whitening", keep=True)
    lengths = table.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    if lengths is None or lengths["length"] == 0:
        return table.limit(0), None
    size, n = lengths["length"], lengths["count"]
    table = table.filter(F.size("x") == size)
    sums = tuple(task_sums(table, lambda b: _rows(b).sum(axis=0), "long", size))
    x = table.select("x")

    def centred(batch: pa.RecordBatch) -> np.ndarray:
        return deviations(_rows(batch), n, sums).astype(np.float64) / n

    def multiply(v: np.ndarray) -> np.ndarray:
        def part(batch: pa.RecordBatch) -> np.ndarray:
            c = centred(batch)
            return c.T @ (c @ v)

        return np.array(task_sums(x, part, "double", v.size)).reshape(v.shape) / n

    trace = task_sums(x, lambda b: np.array([(centred(b) ** 2).sum()]), "double", 1)[0] / n
    values, found, passes = lanczos(multiply, size, min(components, size), block)
    explained = values / trace if trace > 0 else np.zeros(len(values))
    model = Model(n, sums, values, found, explained, 0.0, passes)
    usable = np.flatnonzero(~np.isnan(model.scales))
    if len(usable):
        shape, by = (len(usable), len(usable)), found[:, usable] / model.scales[usable]

        def spread(batch: pa.RecordBatch) -> np.ndarray:
            z = centred(batch) @ by
            return z.T @ z

        covariance = np.array(task_sums(x, spread, "double", shape[0] * shape[1])).reshape(shape) / n
        model = Model(n, sums, values, found, explained, float(np.abs(covariance - np.eye(len(usable))).max()), passes + 1)
    return table, model


def transform(table: DataFrame, model: Model) -> DataFrame:
    """vec_id, deviation (exact squared deviation of n * x) and whitened (array, null for components without variance) of integer vectors."""
    by, n, sums = model.vectors / model.scales, model.n, model.sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = deviations(_rows(batch), n, sums)
                z = d.astype(np.float64) / n @ by
                whitened = pa.ListArray.from_arrays(lists(z).offsets, pa.array(z.reshape(-1), mask=np.isnan(z.reshape(-1))))
                yield pa.record_batch([batch.column("vec_id"), pa.array(squares(d), pa.int64()), whitened], ["vec_id", "deviation", "whitened"])

    return table.mapInArrow(run, f"vec_id {table.schema['vec_id'].dataType.simpleString()}, deviation long, whitened array<double>")


def whitening_table(vectors: DataFrame, components: int = 32, scale: int = 64, shift: int = 1_000_000, block: int = BLOCK) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    table, model = fit(vectors, components, scale, shift, block)
    if model is None:
        return table.select("vec_id", *(F.lit(None).cast(k).alias(c) for c, k in (("component", "int"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))))
    shares = F.array(*(F.lit(float(e)) for e in model.explained))
    return transform(table, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
