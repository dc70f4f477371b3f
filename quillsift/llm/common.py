"""Shared helpers of the corpus operators: shared-folder tables and checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only up to this many bytes of counted content.
BROADCAST_BYTES = 32 << 20

_own: dict[str, str] = {}
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset, a temporary one in local mode; a cluster must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        app, master = spark.sparkContext.applicationId, spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="quillsift-")
        base = _own[app]
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/quillsift-{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back: cuts the lineage and survives lost executors.
    Inside :func:`scratch` the table goes at the end unless it is to ``keep``."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    if _open and not keep:
        _open[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that are staged inside, in the end. What is returned must not read them."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def content_bytes(df: DataFrame) -> int:
    """Upper estimate of what ``df`` holds in memory, counted over all its rows."""
    row = F.lit(16)
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        row = row + (F.coalesce(F.octet_length(c), F.lit(0)) + 16 if kind in ("string", "binary") else F.lit(16))
    return df.agg(F.sum(row)).first()[0] or 0


def join_small(left: DataFrame, right: DataFrame, on, how: str = "inner", limit: int | None = None) -> DataFrame:
    """Join with ``right`` (a staged table): broadcast when its counted content is at most ``limit`` (BROADCAST_BYTES)
    bytes, else a shuffled join whose hot partitions adaptive execution splits."""
    return left.join(F.broadcast(right) if content_bytes(right) <= (BROADCAST_BYTES if limit is None else limit) else right, on, how)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")
