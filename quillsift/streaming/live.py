"""The scan over a stream: cells are judged as they come, and their evidence is added up in the stream's state.

A cell is judged alone, so the scan's expressions run on a stream as they are. The sums of evidence are a streaming
aggregation with one row of state for each column, detector and label, however long the stream runs; after each micro-batch
they replace the table from which findings can be made at any time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quillsift.functions.rulebook import Names
from quillsift.operators import cells, detect, score
from quillsift.plans.scan import ScanConfig

#: Tables of sums that are kept, so that one that is being read does not go.
KEPT = 2


def sums(stream: DataFrame, table: str, config: ScanConfig | None = None) -> DataFrame:
    """The evidence of a stream of rows so far, as a streaming aggregation."""
    config = config or ScanConfig()
    known = Names(config.book)
    names = cells.wanted(cells.flattened(stream.schema))
    maps = any(isinstance(kind, T.MapType) for _, kind in cells.leaves(stream.schema))
    found = detect.judged(cells.cells(stream, table, config.scan_decimals), {c: known.context(c) for c in names}, config.book, not config.ner_only, maps)
    return detect.evidence(found)


def _batches(spark: SparkSession, store: str) -> list[tuple[int, object]]:
    """Numbers and paths of the finished tables of sums, oldest first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(store)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    found = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("batch=")]
    done = [p for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted((int(p.getName().partition("=")[2]), p) for p in done) if done else []


def start(stream: DataFrame, table: str, store: str, checkpoint: str, config: ScanConfig | None = None, continuous: bool = False) -> StreamingQuery:
    """Judge a stream of rows; the sums so far are written below ``store`` after each micro-batch, a repeated one writes the same
    again, and older ones are deleted. Takes what is there and ends, unless it is to be ``continuous``."""
    spark = stream.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(f"{store}/batch={number}")  # a row for each column and label
        for _, path in _batches(spark, store)[:-KEPT]:
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    out = sums(stream, table, config).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", checkpoint)
    return (out if continuous else out.trigger(availableNow=True)).start()


def windowed(stream: DataFrame, when: str, label: str, width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Cells per window of event time in which a label's rule fires: rows of (window, matched), late rows beyond ``late`` dropped."""
    hit = detect.rule_number(label, F.col("value")).isNotNull()
    return stream.withWatermark(when, late).where(hit).groupBy(F.window(when, width)).agg(F.count("*").alias("matched"))


def findings(spark: SparkSession, store: str, names: list[tuple[str, str]], config: ScanConfig | None = None) -> DataFrame:
    """Findings of everything judged so far."""
    config = config or ScanConfig()
    done = _batches(spark, store)
    if not done:
        return score.name_findings(spark, detect.by_name(names, config.book), config.book)
    values, scanned = detect.added(spark.read.parquet(done[-1][1].toString()))
    return score.findings(values, scanned, detect.column_evidence(spark, names, config.book), config.book)
