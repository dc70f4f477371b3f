"""A key-value store as a table of cells: the key is the column, the keyspace the table.

Names and values are read in two steps. A Spark Python data source lists the names, each by one task: in a
cluster's ranges of hash slots, elsewhere by one walk with a cursor, since a server without slots has no other.
The names are dealt out, and all tasks read the values of theirs in pipelines, a batch of keys a round trip.

The client is made in the task by a factory named in the options, so any client will do that has ``scan_iter``,
``type`` and the readers of its types; ``pipeline`` and, in a cluster, ``execute_command`` are used if it has them.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillsift.operators.cells import SAMPLE_ROWS, tidy

#: Hash slots of a cluster.
SLOTS = 16_384
#: Items of a list or a scan that are asked for at once, and keys of a pipeline.
ITEMS, KEYS = 1_000, 500
#: Names that are drawn for a look at names alone.
NAMES = 100


def client_of(factory: str):
    module, _, name = factory.rpartition(".")
    return getattr(importlib.import_module(module), name)()


def _bytes(key) -> bytes:
    return key if isinstance(key, bytes) else str(key).encode()


def at_once(client, calls: list[Callable]) -> list:
    """The results of calls on a client, in one round trip if it has pipelines."""
    if not hasattr(client, "pipeline"):
        return [call(client) for call in calls]
    pipe = client.pipeline(transaction=False)
    for call in calls:
        call(pipe)
    return pipe.execute()


def random_keys(client, n: int) -> list[bytes]:
    """``n`` draws of a random key, repeats left out."""
    seen: dict[bytes, None] = {}
    for at in range(0, n, KEYS):
        drawn = at_once(client, [lambda c: c.randomkey()] * min(KEYS, n - at))
        seen |= {_bytes(k): None for k in drawn if k is not None}
        if None in drawn:
            break
    return list(seen)


def slot_keys(client, first: int, behind: int) -> Iterator[bytes]:
    """Names of the keys in a range of a cluster's hash slots."""
    for at in range(first, behind, KEYS):
        slots = range(at, min(at + KEYS, behind))
        sizes = at_once(client, [lambda c, s=s: c.execute_command("CLUSTER COUNTKEYSINSLOT", s) for s in slots])
        full = [(s, n) for s, n in zip(slots, sizes) if n]
        for some in at_once(client, [lambda c, s=s, n=n: c.execute_command("CLUSTER GETKEYSINSLOT", s, n) for s, n in full]):
            yield from map(_bytes, some)


def _first_call(kind: str, key: bytes) -> Callable | None:
    return {
        "string": lambda c: c.get(key), "list": lambda c: c.lrange(key, 0, ITEMS - 1),
        "set": lambda c: c.sscan(key, 0, count=ITEMS), "hash": lambda c: c.hscan(key, 0, count=ITEMS), "zset": lambda c: c.zscan(key, 0, count=ITEMS),
    }.get(kind)


def _flat(kind: str, items) -> Iterator:
    if kind == "hash" or kind == "zset":
        for pair in items.items() if isinstance(items, dict) else items:
            yield from pair
    else:
        yield from items


def values(client, keys: list[bytes]) -> Iterator[tuple[bytes, str]]:
    """(key, text) of everything under the keys, by their types; hashes and sorted sets give every item, names and scores among
    them. Types come in one round trip, first parts in another; what is longer is read on by itself."""
    kinds = [k.decode() if isinstance(k, bytes) else k for k in at_once(client, [lambda c, key=key: c.type(key) for key in keys])]
    asked = [(key, kind, call) for key, kind in zip(keys, kinds) if (call := _first_call(kind, key)) is not None]
    for (key, kind, _), got in zip(asked, at_once(client, [call for *_, call in asked])):
        if kind == "string":
            found: Iterator = iter([got])
        elif kind == "list":
            found = _rest_of_list(client, key, got)
        else:
            found = _rest_of_scan(client, kind, key, got)
        for v in found:
            if v is not None:
                yield key, v.decode(errors="replace") if isinstance(v, bytes) else str(v)


def _rest_of_list(client, key: bytes, part) -> Iterator:
    at = 0
    while part:
        yield from part
        at += ITEMS
        part = client.lrange(key, at, at + ITEMS - 1) if len(part) == ITEMS else []


def _rest_of_scan(client, kind: str, key: bytes, got) -> Iterator:
    more = {"set": "sscan", "hash": "hscan", "zset": "zscan"}[kind]
    while True:
        cursor, items = got
        yield from _flat(kind, items)
        if int(cursor) == 0:
            return
        got = getattr(client, more)(key, cursor, count=ITEMS)


class KeyReader(DataSourceReader):
    """Parts are ranges of slots in a cluster, shares of the draws for a sample, else one walk over all names."""

    def __init__(self, options):
        self.options = options

    def partitions(self):
        parts, draws = max(1, int(self.options.get("partitions", "1"))), int(self.options.get("sample", "0"))
        if draws:
            return [InputPartition(("draws", draws * i // parts, draws * (i + 1) // parts)) for i in range(parts)]
        if self.options.get("cluster", "false") == "true":
            return [InputPartition(("slots", SLOTS * i // parts, SLOTS * (i + 1) // parts)) for i in range(parts)]
        return [InputPartition(("all", 0, 0))]

    def read(self, partition):
        client = client_of(self.options["client"])
        how, a, b = partition.value if partition is not None else ("all", 0, 0)
        for key in random_keys(client, b - a) if how == "draws" else slot_keys(client, a, b) if how == "slots" else map(_bytes, client.scan_iter()):
            yield (key,)


class KeySource(DataSource):
    """``spark.read.format("keyvalue").option("client", "package.module.factory")``: the names of the keys."""

    @classmethod
    def name(cls):
        return "keyvalue"

    def schema(self):
        return "key binary"

    def reader(self, schema):
        return KeyReader(self.options)


class KeyValues:
    """A keyspace as a source of scans; its keys are names that are judged as they come. ``partitions`` tasks read it."""

    def __init__(self, spark: SparkSession, client: str, db: int = 0, partitions: int = 1, cluster: bool = False):
        self.spark, self.client, self.db, self.partitions, self.cluster = spark, client, db, partitions, cluster
        spark.dataSource.register(KeySource)

    def tables(self) -> list[str]:
        return [f"db{self.db}"]

    def schema(self, table: str) -> T.StructType:
        return T.StructType()

    def names(self, tables: list[str]) -> dict[str, list[str]]:
        """Some names of keys, drawn at random."""
        drawn = [k.decode(errors="replace") for k in random_keys(client_of(self.client), NAMES)]
        return {t: drawn for t in tables}

    def rows(self, table: str) -> int:
        return client_of(self.client).dbsize()

    def keys(self, sample: bool = False) -> DataFrame:
        """The names of all keys, or of up to SAMPLE_ROWS drawn ones."""
        given = {"client": self.client, "partitions": str(self.partitions), "cluster": str(self.cluster).lower(), "sample": str(SAMPLE_ROWS if sample else 0)}
        found = self.spark.read.format("keyvalue").options(**given).load()
        return found.dropDuplicates(["key"]) if sample else found

    def cells(self, table: str, sample: bool) -> DataFrame:
        factory = self.client

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            client = None
            for batch in batches:
                client = client_of(factory) if client is None else client
                for at in range(0, batch.num_rows, KEYS):
                    found = list(values(client, batch.column("key").slice(at, KEYS).to_pylist()))
                    yield pa.record_batch([pa.array([k.decode(errors="replace") for k, _ in found], pa.string()), pa.array([v for _, v in found], pa.string())], ["column", "value"])

        read = self.keys(sample).repartition(self.partitions).mapInArrow(run, "column string, value string")
        return read.select(F.lit(table).alias("table"), "column", tidy(F.col("value")).alias("value")).where("value is not null")

    def whole(self, table: str) -> DataFrame:
        return self.cells(table, False)

    def sample(self, table: str) -> DataFrame:
        return self.cells(table, True)
