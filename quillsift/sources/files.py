"""Folders of files as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FORMATS = ("parquet", "csv", "json", "orc")


def table(spark: SparkSession, path: str, kind: str | None = None, **options: str) -> DataFrame:
    """One table; the format follows from the path's ending unless it is given."""
    kind = kind or path.rstrip("/").rpartition(".")[2].lower()
    if kind not in FORMATS:
        raise ValueError(f"{path}: format is none of {', '.join(FORMATS)}")
    if kind == "csv":
        options = {"header": "true"} | options
    return spark.read.options(**options).format(kind).load(path)


def folder(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Every file or folder below ``path`` that ends in a known format, by its name without the ending. Lists through Spark's
    own file systems, so any store that Spark reads will do."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)
    names = sorted(s.getPath().getName() for s in found)
    return {n.rpartition(".")[0]: table(spark, f"{path.rstrip('/')}/{n}") for n in names if n.rpartition(".")[2].lower() in FORMATS}


def catalog(spark: SparkSession, database: str | None = None) -> dict[str, DataFrame]:
    """The tables of Spark's catalog."""
    return {t.name: spark.table(t.name if t.isTemporary else f"{t.namespace[-1]}.{t.name}") for t in spark.catalog.listTables(database) if t.name}
