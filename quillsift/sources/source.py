"""What a scan asks of a store: its tables, their schemas and rows, and a table whole or as a sample."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillsift.operators import cells


@runtime_checkable
class Source(Protocol):
    """A sample is repeatable and has at most ``cells.SAMPLE_ROWS`` rows."""

    def tables(self) -> list[str]: ...

    def schema(self, table: str) -> T.StructType: ...

    def rows(self, table: str) -> int: ...

    def whole(self, table: str) -> DataFrame: ...

    def sample(self, table: str) -> DataFrame: ...


@runtime_checkable
class CellSource(Source, Protocol):
    """A store without columns: it gives (table, column, value) itself."""

    def cells(self, table: str, sample: bool) -> DataFrame: ...


@runtime_checkable
class Countable(Protocol):
    """A source that counts the rows of several tables at once."""

    def counts(self, tables: list[str]) -> dict[str, int]: ...


@runtime_checkable
class Named(Protocol):
    """A source that lists the columns of several tables at once, or names without a schema (keys)."""

    def names(self, tables: list[str]) -> dict[str, list[str]]: ...


class Frames:
    """DataFrames by name; a sample is taken by Spark."""

    def __init__(self, tables: Mapping[str, DataFrame]):
        self.frames = tables

    def tables(self) -> list[str]:
        return list(self.frames)

    def schema(self, table: str) -> T.StructType:
        return self.frames[table].schema

    def rows(self, table: str) -> int:
        return self.frames[table].count()

    def counts(self, tables: list[str]) -> dict[str, int]:
        each = [self.frames[t].agg(F.count("*").alias("n")).select(F.lit(t).alias("table"), "n") for t in tables]
        return {r["table"]: r["n"] for r in reduce(DataFrame.unionByName, each).collect()} if each else {}

    def whole(self, table: str) -> DataFrame:
        return self.frames[table]

    def sample(self, table: str) -> DataFrame:
        return cells.sample(self.frames[table])


def as_source(tables: Source | Mapping[str, DataFrame]) -> Source:
    return Frames(tables) if isinstance(tables, Mapping) else tables
