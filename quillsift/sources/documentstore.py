"""A document store (Mongo) read in ranges of ``_id``, without a connector: a Spark Python data source.

The client is made by a factory named in the options, on the driver for bounds, schema and counts and in each task for
its range, so ``pymongo`` is needed only where such a factory uses it. Bounds are ids that the server draws and sorts, so
ranges follow its order of ids whatever their types; each document is in one range.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterable, Iterator, Mapping
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillsift.operators.cells import SAMPLE_ROWS
from quillsift.sources.keyvalue import client_of

#: Ids drawn for each range, documents drawn for the schema, and documents to a range.
DRAWN, SCHEMA_ROWS, PART_ROWS = 20, 1_000, 500_000
_ATOMS = ((bool, T.BooleanType()), (int, T.LongType()), (float, T.DoubleType()), (str, T.StringType()), (bytes, T.BinaryType()), (datetime, T.TimestampType()))


def kind_of(value) -> T.DataType | None:
    """The type of a value; text for what has none, None for a missing one."""
    if value is None:
        return None
    if isinstance(value, Mapping):
        return schema_of([value])
    if isinstance(value, (list, tuple)):
        return T.ArrayType(T.StringType())
    return next((kind for cls, kind in _ATOMS if isinstance(value, cls)), T.StringType())


def widened(a: T.DataType | None, b: T.DataType | None) -> T.DataType | None:
    """A type for values of both; text where nothing else is."""
    if a is None or b is None or a == b:
        return b if a is None else a
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        kinds = {f.name: f.dataType for f in a}
        for f in b:
            kinds[f.name] = widened(kinds.get(f.name), f.dataType)
        return T.StructType([T.StructField(n, k) for n, k in kinds.items()])
    return T.DoubleType() if {type(a), type(b)} == {T.LongType, T.DoubleType} else T.StringType()


def schema_of(documents: Iterable[Mapping]) -> T.StructType:
    """Fields in the order in which they come first; one that is missing everywhere is text, an empty document is text."""
    kinds: dict[str, T.DataType | None] = {}
    for d in documents:
        for name, value in d.items():
            kinds[name] = widened(kinds.get(name), kind_of(value))
    fitting = lambda k: T.StringType() if k is None or isinstance(k, T.StructType) and not k.fields else k
    return T.StructType([T.StructField(n, fitting(k)) for n, k in kinds.items()])


def _text(value) -> str:
    if isinstance(value, str):
        return value
    if isinstance(value, (Mapping, list, tuple)):
        return json.dumps(value, default=_text, ensure_ascii=False)
    return base64.b64encode(value).decode() if isinstance(value, bytes) else str(value)


def fitted(value, kind: T.DataType):
    """A value in the form that Spark takes for a type; None for what does not fit (a document that the drawn ones were not like)."""
    if value is None:
        return None
    if isinstance(kind, T.StringType):
        return _text(value)
    if isinstance(kind, T.StructType):
        return tuple(fitted(value.get(f.name), f.dataType) for f in kind) if isinstance(value, Mapping) else None
    if isinstance(kind, T.ArrayType):
        return [None if v is None else _text(v) for v in value] if isinstance(value, (list, tuple)) else [_text(value)]
    if isinstance(kind, T.DoubleType):
        return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None
    cls = next(c for c, k in _ATOMS if k == kind)
    return value if isinstance(value, cls) and isinstance(value, bool) == (cls is bool) else None


def collection_of(options: Mapping[str, str]):
    return client_of(options["client"])[options["database"]][options["collection"]]


class DocumentReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: Mapping[str, str]):
        self.kind, self.options = schema, dict(options)

    def partitions(self):
        if "sample" in self.options:
            return [InputPartition((None, None))]
        parts = max(1, int(self.options.get("partitions", "1")))
        drawn = [] if parts == 1 else list(collection_of(self.options).aggregate([{"$sample": {"size": DRAWN * parts}}, {"$project": {"_id": 1}}, {"$sort": {"_id": 1}}]))
        bounds: list = []
        for d in drawn[DRAWN::DRAWN]:
            if not bounds or d["_id"] != bounds[-1]:
                bounds.append(d["_id"])
        return [InputPartition(p) for p in zip([None, *bounds], [*bounds, None])]

    def read(self, partition) -> Iterator[tuple]:
        collection = collection_of(self.options)
        if "sample" in self.options:
            found = collection.aggregate([{"$sample": {"size": int(self.options["sample"])}}])
        else:
            low, high = partition.value
            found = collection.find().hint([("_id", 1)])
            found = found if low is None else found.min([("_id", low)])
            found = found if high is None else found.max([("_id", high)])
        for d in found:
            yield tuple(fitted(d.get(f.name), f.dataType) for f in self.kind)


class DocumentSource(DataSource):
    """``spark.read.format("documentstore").option("client", "package.module.factory")`` with ``database`` and ``collection``."""

    @classmethod
    def name(cls):
        return "documentstore"

    def schema(self):
        return schema_of(collection_of(self.options).aggregate([{"$sample": {"size": SCHEMA_ROWS}}]))

    def reader(self, schema):
        return DocumentReader(schema, self.options)


class Documents:
    """The collections of a database as a source of scans; ids are ignored by name when cells are taken, nested fields flattened."""

    def __init__(self, spark: SparkSession, client: str, database: str, part_rows: int = PART_ROWS):
        self.spark, self.client, self.database, self.part_rows = spark, client, database, part_rows
        self._schemas: dict[str, T.StructType] = {}
        spark.dataSource.register(DocumentSource)

    def _options(self, table: str) -> dict[str, str]:
        return {"client": self.client, "database": self.database, "collection": table}

    def tables(self) -> list[str]:
        return sorted(n for n in client_of(self.client)[self.database].list_collection_names() if n and not n.startswith("system."))

    def schema(self, table: str) -> T.StructType:
        """Of some drawn documents, without a Spark job."""
        if table not in self._schemas:
            self._schemas[table] = schema_of(collection_of(self._options(table)).aggregate([{"$sample": {"size": SCHEMA_ROWS}}]))
        return self._schemas[table]

    def rows(self, table: str) -> int:
        """What the server keeps count of."""
        return collection_of(self._options(table)).estimated_document_count()

    def _read(self, table: str, more: dict[str, str]) -> DataFrame:
        return self.spark.read.format("documentstore").schema(self.schema(table)).options(**self._options(table), **more).load()

    def whole(self, table: str) -> DataFrame:
        return self._read(table, {"partitions": str(max(1, -(-self.rows(table) // self.part_rows)))})

    def sample(self, table: str) -> DataFrame:
        return self._read(table, {"sample": str(SAMPLE_ROWS)})
