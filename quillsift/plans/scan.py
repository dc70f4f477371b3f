"""Scan modes and the scan itself: tables in, findings out.

All tables of a scan form one job: their cells are unpivoted and judged by expressions on one row a cell,
and meet again in one small aggregation. Its sums, one row a column and label, are written once; scoring reads them.
A scan that reads no rows, of names or of empty tables, is made on the driver without any job.
"""

from __future__ import annotations

import logging
import threading
import uuid
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from functools import cached_property, reduce
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillsift.functions.cell import Ner, recogniser
from quillsift.functions.rulebook import Detector, Names, Rulebook, rulebook
from quillsift.operators import cells, detect, score
from quillsift.sources.source import CellSource, Countable, Named, Source, as_source
from quillsift.sources.staging import staged

log = logging.getLogger(__name__)
Result = TypeVar("Result")

MODES = {"metascan": "Meta Scan", "datascan": "Data Scan", "deepscan": "Deep Scan", "spacyscan": "Spacy Scan"}
AUTO_TITLE = "Auto Scan"
#: Auto mode reads tables with fewer rows whole; a deep scan of more than the second number of rows is asked for (fewer with a recogniser).
AUTO_ROWS, LARGE_ROWS, LARGE_ROWS_NER = 10_000, 100_000, 10_000


@dataclass(frozen=True)
class ScanConfig:
    """Mode ("" for auto), filters and options of a scan.

    ``spacyscan`` is a sampled scan with the recogniser and all findings printed; ``ner`` is a function or a
    :class:`Detector` that :func:`~quillsift.functions.cell.recogniser` has made. ``detectors`` are further ones of one's own.
    ``on_large_table`` is asked (table, rows) before a large table is read whole; if it says no, the table keeps its name
    findings only.
    """

    mode: str = ""
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    region: str = ""
    ner: Ner | Detector | None = None
    ner_only: bool = False
    print_all: bool = False
    print_summary: bool = False
    scan_decimals: bool = True
    on_large_table: Callable[[str, int], bool] | None = field(default=None, compare=False)
    detectors: tuple[Detector, ...] = ()

    def __post_init__(self) -> None:
        if self.mode and self.mode not in MODES:
            raise ValueError(f"mode {self.mode!r} is none of {', '.join(sorted(MODES))}")
        if self.print_all and self.print_summary:
            raise ValueError("print_all and print_summary exclude each other")
        if self.ner_only and self.mode not in ("", "spacyscan"):
            raise ValueError("ner_only goes with spacyscan alone")
        if self.mode == "spacyscan":
            if self.ner is None:
                raise ValueError("spacyscan needs a recogniser")
            object.__setattr__(self, "print_all", not self.print_summary)

    @property
    def title(self) -> str:
        return MODES.get(self.mode, AUTO_TITLE)

    @cached_property
    def book(self) -> Rulebook:
        own = () if self.ner is None else (self.ner if isinstance(self.ner, Detector) else recogniser(self.ner),)
        return rulebook(self.region, (*own, *self.detectors))


@dataclass(frozen=True)
class TablePlan:
    """What is read of a table: "names" only, a "sample", or "all" rows."""

    table: str
    reads: str
    rows: int


def plan(config: ScanConfig, table: str, count: Callable[[], int]) -> TablePlan:
    """Rows are counted only where the mode depends on them."""
    if config.mode == "metascan":
        return TablePlan(table, "names", -1)
    rows = count()
    if rows == 0:
        return TablePlan(table, "names", 0)
    if config.mode in ("datascan", "spacyscan") or not config.mode and rows >= AUTO_ROWS:
        return TablePlan(table, "sample", rows)
    large = rows > (LARGE_ROWS_NER if config.ner else LARGE_ROWS)
    if config.mode == "deepscan" and large and config.on_large_table and not config.on_large_table(table, rows):
        return TablePlan(table, "names", rows)
    return TablePlan(table, "all", rows)


def dealt(df: DataFrame) -> DataFrame:
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """A table in fewer partitions than there are cores is small; it is dealt out, since judging costs more than moving it."""
    return dealt(df) if df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism else df


def value_cells(config: ScanConfig, source: Source, plans: Iterable[TablePlan]) -> DataFrame | None:
    """Counted cells of all tables that are read. Texts of columns are counted as they are and made tidy once each, not once a cell."""
    read = [p for p in plans if p.reads != "names"]
    if not read:
        return None
    if isinstance(source, CellSource):
        return detect.counted(reduce(DataFrame.unionByName, [source.cells(p.table, p.reads == "sample") for p in read]))
    # a sample is one partition; to ask for their number would run it
    tables = {p.table: dealt(source.sample(p.table)) if p.reads == "sample" else spread(source.whole(p.table)) for p in read}
    each, long = (reduce(DataFrame.unionByName, [cells.texts(df, t, config.scan_decimals, least) for t, df in tables.items()]) for least in (None, detect.SHORT))
    return detect.counted(each, long).withColumn("value", cells.tidy(F.col("value")))


def judge(config: ScanConfig, cell_rows: DataFrame, names: Iterable[tuple[str, str]], open_names: bool = False) -> DataFrame:
    """Counted cells of columns with these names, judged as the configuration says."""
    known = Names(config.book)
    return detect.judged(cell_rows, {c: known.context(c) for _, c in names}, config.book, not config.ner_only, open_names)


def row_counts(config: ScanConfig, source: Source, tables: list[str]) -> dict[str, int]:
    """Rows of the tables, in one job where the source can; none are counted for a scan of names."""
    if config.mode == "metascan" or not tables:
        return {}
    return source.counts(tables) if isinstance(source, Countable) else {t: source.rows(t) for t in tables}


def scan(spark: SparkSession, tables: Source | Mapping[str, DataFrame], config: ScanConfig | None = None) -> DataFrame:
    """Findings over the chosen tables of a source, or over DataFrames by name: table, column, label, detector_type, detector,
    weight, confidence, tier, domain, context_matched, matched_count, scanned_count."""
    config, source = config or ScanConfig(), as_source(tables)
    known = source.tables()
    chosen = cells.chosen(known, config.include, config.exclude)
    missing = [t for t in chosen if t not in known]
    if missing:
        raise KeyError(f"no such table: {', '.join(missing)}")
    counts = row_counts(config, source, chosen)
    plans = [plan(config, t, lambda t=t: counts[t]) for t in chosen]
    read = [p for p in plans if p.reads != "names"]
    listed = source.names(chosen) if isinstance(source, Named) else {t: cells.flattened(source.schema(t)) for t in chosen}
    names = [(t, c) for t in chosen for c in cells.wanted(listed[t])]
    if not read:
        return score.name_findings(spark, detect.by_name(names, config.book), config.book)
    by_name = detect.column_evidence(spark, names, config.book)
    found = value_cells(config, source, read)
    open_names = isinstance(source, CellSource) or any(isinstance(kind, T.MapType) for p in read for _, kind in cells.leaves(source.schema(p.table)))
    values, scanned = detect.added(staged(detect.evidence(judge(config, found, names, open_names)), "evidence"))
    return score.findings(values, scanned, by_name, config.book)


def scan_targets(
    spark: SparkSession,
    targets: Mapping[str, Callable[[], Source | Mapping[str, DataFrame]]],
    config: ScanConfig | None = None,
    timeout: float | None = None,
    report: Callable[[str, DataFrame], None] | None = None,
) -> tuple[DataFrame | None, dict[str, str]]:
    """Several databases: findings with a ``target`` column, and why targets were skipped. A database that cannot be opened, or
    whose scan fails, does not end the others' scan; what failed inside a scan is logged. Opening, listing, scanning and, if
    given, ``report`` (name, findings) together may take ``timeout`` seconds."""
    parts, skipped = [], {}
    for name, load in targets.items():
        opened: list[Source | Mapping[str, DataFrame]] = []

        def work(name=name, load=load, opened=opened) -> DataFrame:
            opened.append(load())
            found = scan(spark, opened[0], config)
            if report is not None:
                report(name, found)
            return found

        try:
            parts.append(with_timeout(spark, timeout, work).withColumn("target", F.lit(name)))
        except TimeoutError as e:
            skipped[name] = f"stopped: {e}"
        except Exception as e:
            if opened:
                log.exception("scan of %s", name)
            skipped[name] = f"scan failed: {e}" if opened else f"not opened: {e}"
    return (reduce(DataFrame.unionByName, parts) if parts else None), skipped


def with_timeout(spark: SparkSession, seconds: float | None, work: Callable[[], Result]) -> Result:
    """Run ``work``; after ``seconds`` (None: no limit) TimeoutError is raised and its Spark jobs are cancelled.

    The work has a thread of its own, since what hangs outside Spark (a connection, a library) cannot be stopped; that thread
    is left behind, and whatever job it still starts is cancelled."""
    if seconds is None:
        return work()
    context, group, done = spark.sparkContext, f"quillsift-{uuid.uuid4().hex}", threading.Event()
    out: list[tuple[Result | None, BaseException | None]] = []

    def run() -> None:
        context.setJobGroup(group, "scan", interruptOnCancel=True)
        try:
            out.append((work(), None))
        except BaseException as e:  # noqa: BLE001 - raised again where the result is awaited
            out.append((None, e))
        finally:
            done.set()

    def sweep() -> None:
        while True:
            context.cancelJobGroup(group)
            if done.wait(0.5) or context._jsc is None:
                return

    threading.Thread(target=inheritable_thread_target(spark)(run), daemon=True).start()
    if not done.wait(seconds):
        threading.Thread(target=sweep, daemon=True).start()
        done.wait(GRACE)
        raise TimeoutError(f"no end after {seconds:g} seconds")
    result, error = out[0]
    if error is not None:
        raise error
    return result


#: Seconds that work which is late gets to end by itself once its jobs are cancelled.
GRACE = 5.0
#: Seconds for a database, unless the caller says otherwise.
DEFAULT_TIMEOUT = 300.0
