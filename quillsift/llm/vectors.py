"""Helpers of the vector operators: lists of an Arrow column as matrices, exact integers, and sums over tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Integers beyond this need not have 64-bit squared distances; such components count as not finite.
LARGEST = 1 << 27


def matrices(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix of doubles) for each length of list that occurs. Lists that are null, or hold entries that are null or not finite, are in none."""
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.list_flatten(column).cast(pa.float64()).to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))[:-1]]) if len(sizes) else sizes
    out = []
    for size in np.unique(sizes[sizes >= 0]):
        rows = np.flatnonzero(sizes == size)
        block = values[starts[rows][:, None] + np.arange(size)]
        sound = np.isfinite(block).all(axis=1)
        out.append((rows[sound], block[sound]))
    return out


def lists(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix as Arrow lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]), pa.array(np.ascontiguousarray(matrix).reshape(-1)))


def integers(vectors: DataFrame, scale: int, shift: int = 0, length: int | None = None) -> DataFrame:
    """vec_id and x = floor(scale * embedding) + shift for the sound vectors (of ``length`` components, where that is given)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, block in matrices(batch.column("embedding")):
                if length is not None and block.shape[1] != length:
                    continue
                with np.errstate(over="ignore"):
                    x = np.floor(scale * block)
                fits = (np.abs(x) <= LARGEST).all(axis=1)
                yield pa.record_batch([batch.column("vec_id").take(pa.array(rows[fits])), lists(x[fits].astype(np.int64) + shift)], ["vec_id", "x"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, x array<long>")


def task_sums(table: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], kind: str, size: int) -> list:
    """``size`` sums over all rows: ``part`` gives a batch's share, a task adds its batches up, Spark adds the tasks'.
    kind: long (exact, summed as decimals) or double."""
    dtype = np.int64 if kind == "long" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype)
        for batch in batches:
            if batch.num_rows:
                total += part(batch).reshape(-1)
        yield pa.record_batch([lists(total[None, :])], ["part"])

    summed = F.sum(F.col("v").cast("decimal(38,0)") if kind == "long" else F.col("v"))
    at = table.mapInArrow(run, f"part array<{kind}>").select(F.posexplode("part").alias("at", "v")).groupBy("at").agg(summed.alias("v"))
    out = [0] * size
    for r in at.collect():
        out[r["at"]] = int(r["v"]) if kind == "long" else r["v"]
    return out
