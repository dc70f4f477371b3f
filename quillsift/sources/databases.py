"""Databases as tables: engines, connection settings, JDBC options, catalog and sampling queries.

No driver or server is part of this repository; everything up to ``spark.read`` is plain data and tested as such.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from datetime import date, datetime
from decimal import Decimal
from urllib.parse import parse_qs, quote, unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quillsift.operators.cells import SAMPLE_ROWS, SAMPLE_SEED, wanted

_CERTIFICATES = ("sslrootcert", "sslcert", "sslkey")
SSL_MODES = ("disable", "allow", "prefer", "require", "verify-ca", "verify-full")
#: Engines with default port and schema.
ENGINES = {"postgres": (5432, "public"), "mysql": (3306, ""), "sqlserver": (1433, "dbo"), "mongodb": (27017, ""), "redis": (6379, "")}


def engine_name(name: str) -> str:
    """Lower-cased and trimmed; none means postgres."""
    name = name.strip().lower() or "postgres"
    if name not in ENGINES:
        raise ValueError(f"engine {name!r} is none of {', '.join(ENGINES)}")
    return name


@dataclass(frozen=True)
class Database:
    host: str
    database: str
    engine: str = "postgres"
    port: int = 0
    user: str = ""
    password: str = field(default="", repr=False)
    schema: str = ""
    sslmode: str = "require"
    sslrootcert: str = ""
    sslcert: str = ""
    sslkey: str = ""

    def __post_init__(self) -> None:
        object.__setattr__(self, "engine", engine_name(self.engine))
        port, schema = ENGINES[self.engine]
        object.__setattr__(self, "port", self.port or port)
        object.__setattr__(self, "schema", self.schema or schema or self.database)
        object.__setattr__(self, "sslmode", self.sslmode or "require")
        if self.sslmode not in SSL_MODES:
            raise ValueError(f"sslmode {self.sslmode!r} is none of {', '.join(SSL_MODES)}")
        if not self.host or not self.database and self.engine != "redis":
            raise ValueError("host and database must be given")

    @property
    def label(self) -> str:
        return f"{self.host}_{self.port}_{self.database}"


def is_uri(text: str) -> bool:
    return text.strip().lower().startswith(("postgres://", "postgresql://"))


def from_uri(text: str) -> Database:
    """A postgres URI with host and database."""
    if not is_uri(text):
        raise ValueError("not a postgres URI")
    u = urlsplit(text.strip())
    options = {k: v[-1] for k, v in parse_qs(u.query).items()}
    host, name = u.hostname or options.get("host", ""), unquote(u.path.lstrip("/")) or options.get("dbname", "")
    if not host or not name:
        raise ValueError("the URI must name a host and a database")
    return Database(host, name, "postgres", u.port or 0, unquote(u.username or ""), unquote(u.password or ""), **{k: options.get(k, "") for k in ("sslmode", *_CERTIFICATES)})


def keyword_dsn(db: Database) -> str:
    """Keyword form of a postgres connection; values are quoted where they need it."""

    def show(v: str) -> str:
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" if not v or any(c in v for c in " '\\\t\n") else v

    parts = {"host": db.host, "port": str(db.port), "user": db.user, "password": db.password, "dbname": db.database, "sslmode": db.sslmode} | {k: getattr(db, k) for k in _CERTIFICATES}
    return " ".join(f"{k}={show(v)}" for k, v in parts.items() if v)


def jdbc_url(db: Database) -> str:
    if db.engine == "postgres":
        cert = "".join(f"&{k}={getattr(db, k)}" for k in _CERTIFICATES if getattr(db, k))
        return f"jdbc:postgresql://{db.host}:{db.port}/{db.database}?sslmode={db.sslmode}{cert}"
    if db.engine == "mysql":
        return f"jdbc:mysql://{db.host}:{db.port}/{db.database}?sslMode={'DISABLED' if db.sslmode == 'disable' else 'REQUIRED'}"
    if db.engine == "sqlserver":
        return f"jdbc:sqlserver://{db.host}:{db.port};databaseName={db.database};encrypt={'false' if db.sslmode == 'disable' else 'true'}"
    raise ValueError(f"{db.engine} is not read over JDBC")


def quoted(db: Database, name: str) -> str:
    if db.engine == "mysql":
        return "`" + name.replace("`", "``") + "`"
    if db.engine == "sqlserver":
        return "[" + name.replace("]", "]]") + "]"
    return '"' + name.replace('"', '""') + '"'


def qualified(db: Database, table: str) -> str:
    return table if db.engine == "mongodb" else f"{quoted(db, db.schema)}.{quoted(db, table)}"


def tables_query(db: Database) -> str:
    """Names of the base tables of the schema."""
    text = db.schema.replace("'", "''")
    return f"SELECT table_name FROM information_schema.tables WHERE table_schema = '{text}' AND table_type = 'BASE TABLE' ORDER BY table_name"


def schema_query(db: Database) -> str:
    return f"SELECT schema_name FROM information_schema.schemata WHERE schema_name = '{db.schema.replace(chr(39), chr(39) * 2)}'"


def sample_query(db: Database, table: str, columns: list[str], rows: int = SAMPLE_ROWS, seed: int = SAMPLE_SEED) -> str:
    """A repeatable sample in the engine's own SQL."""
    names, where = ", ".join(quoted(db, c) for c in columns), qualified(db, table)
    if db.engine == "mysql":
        return f"SELECT {names} FROM {where} ORDER BY RAND({seed}) LIMIT {rows}"
    if db.engine == "sqlserver":
        return f"SELECT TOP {rows} {names} FROM {where} TABLESAMPLE ({rows} ROWS) REPEATABLE ({seed})"
    return f"SELECT {names} FROM {where} TABLESAMPLE BERNOULLI (10) REPEATABLE ({seed}) LIMIT {rows}"


def key_query(db: Database, table: str) -> str:
    """Columns of the table's primary key, in order."""
    schema, name = (t.replace("'", "''") for t in (db.schema, table))
    return (
        "SELECT k.column_name FROM information_schema.key_column_usage k JOIN information_schema.table_constraints c "
        "ON k.constraint_name = c.constraint_name AND k.table_schema = c.table_schema AND k.table_name = c.table_name "
        f"WHERE c.constraint_type = 'PRIMARY KEY' AND k.table_schema = '{schema}' AND k.table_name = '{name}' ORDER BY k.ordinal_position"
    )


#: Seconds to connect, and for a statement of the catalog, before a host counts as hanging. What reads rows may take longer.
CONNECT_SECONDS, CATALOG_SECONDS = 10, 60
#: Names of the drivers' connection timeouts, and how many of their units a second has.
_TIMEOUTS = {"postgres": (("connectTimeout", 1), ("loginTimeout", 1)), "mysql": (("connectTimeout", 1000),), "sqlserver": (("loginTimeout", 1),)}


def options(db: Database, query: str) -> dict[str, str]:
    waits = {name: str(CONNECT_SECONDS * units) for name, units in _TIMEOUTS.get(db.engine, ())}
    return {"url": jdbc_url(db), "user": db.user, "password": db.password, "query": query, "fetchsize": "10000"} | waits


def partitioned(db: Database, table: str, column: str, low: int, high: int, parts: int) -> dict[str, str]:
    """Options that read a table in parallel ranges of a numeric column; rows without a value are in the first."""
    base = {k: v for k, v in options(db, "").items() if k != "query"}
    return base | {"dbtable": qualified(db, table), "partitionColumn": quoted(db, column), "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}


def literal(db: Database, value: object) -> str:
    """A value of a key in the engine's SQL."""
    if isinstance(value, (int, Decimal)):
        return str(value)
    if isinstance(value, datetime):
        return f"{{ts '{value:%Y-%m-%d %H:%M:%S.%f}'}}" if db.engine == "sqlserver" else f"TIMESTAMP '{value:%Y-%m-%d %H:%M:%S.%f}'"
    if isinstance(value, date):
        return f"'{value:%Y-%m-%d}'" if db.engine == "sqlserver" else f"DATE '{value:%Y-%m-%d}'"
    text = str(value).replace("'", "''")
    return "'" + (text.replace("\\", "\\\\") if db.engine == "mysql" else text) + "'"


def next_query(db: Database, table: str, key: str, after: object | None, skip: int) -> str:
    """The key that ``skip`` rows lie in front of, of the rows with a key above ``after``, in the key's order."""
    k = quoted(db, key)
    some = f"SELECT {k} AS k FROM {qualified(db, table)} WHERE {k} {'IS NOT NULL' if after is None else '> ' + literal(db, after)} ORDER BY {k}"
    return f"{some} LIMIT 1 OFFSET {skip}" if db.engine == "mysql" else f"{some} OFFSET {skip} ROWS FETCH NEXT 1 ROWS ONLY"


def ranges(db: Database, key: str, bounds: Sequence[object]) -> list[str]:
    """Conditions that part the rows at the bounds; rows without a key are in the first part."""
    k = quoted(db, key)
    marks = [literal(db, b) for b in bounds]
    if not marks:
        return ["1 = 1"]
    inner = [f"{k} >= {a} AND {k} < {b}" for a, b in zip(marks, marks[1:])]
    return [f"({k} < {marks[0]} OR {k} IS NULL)", *inner, f"{k} >= {marks[-1]}"]


def slices(db: Database, columns: Sequence[str], parts: int, pages: int = 0) -> list[str]:
    """Conditions that part a table without a key: by page ranges in postgres, by a checksum of the row elsewhere."""
    if db.engine == "postgres":
        cuts = sorted({pages * i // parts for i in range(1, parts)} - {0})
        marks = [f"'({c},0)'::tid" for c in cuts]
        return [" AND ".join(x for x in (a and f"ctid >= {a}", b and f"ctid < {b}") if x) or "1 = 1" for a, b in zip(["", *marks], [*marks, ""])]
    if db.engine == "mysql":
        row = ", ".join(f"COALESCE(CAST({quoted(db, c)} AS CHAR), '')" for c in columns)
        return [f"MOD(CRC32(CONCAT_WS('|', {row})), {parts}) = {i}" for i in range(parts)]
    return [f"ABS(CAST(BINARY_CHECKSUM(*) AS BIGINT)) % {parts} = {i}" for i in range(parts)]


def pages_query(db: Database, table: str) -> str:
    """How many pages a postgres table has."""
    name = qualified(db, table).replace("'", "''")
    return f"SELECT pg_relation_size('{name}') / current_setting('block_size')::int AS pages"


def names_query(db: Database) -> str:
    """Columns of all base tables of the schema, in order."""
    text = db.schema.replace("'", "''")
    return (
        "SELECT c.table_name, c.column_name FROM information_schema.columns c JOIN information_schema.tables t ON c.table_schema = t.table_schema AND c.table_name = t.table_name "
        f"WHERE c.table_schema = '{text}' AND t.table_type = 'BASE TABLE' ORDER BY c.table_name, c.ordinal_position"
    )


def counts_query(db: Database, tables: Sequence[str]) -> str:
    return " UNION ALL ".join(f"SELECT {i} AS i, COUNT(*) AS n FROM {qualified(db, t)}" for i, t in enumerate(tables))


def _jdbc(spark: SparkSession, given: dict[str, str], predicates: list[str] | None = None) -> DataFrame:
    """A DataFrame from JDBC options; a partition for each of the predicates, if there are any."""
    if predicates is None:
        return spark.read.format("jdbc").options(**given).load()
    return spark.read.jdbc(given["url"], given["dbtable"], predicates=predicates, properties={k: v for k, v in given.items() if k not in ("url", "dbtable")})


class Jdbc:
    """The base tables of a database as a source of scans.

    The engine draws the samples. A table read whole comes in a partition for about every ``part_rows`` rows: in ranges of
    an integer column, of the primary key if it has one; else in ranges of the first column of its primary key, whatever its
    type, at bounds that the engine finds by walking the key's index once; and without a key by pages or a checksum.
    Columns of all tables come from one query of the catalog, counts of many tables from one query. Connections and catalog
    queries have time limits. ``reader`` opens a DataFrame from JDBC options and predicates. Raises ValueError if the schema
    does not exist.
    """

    def __init__(self, spark: SparkSession, db: Database, reader: Callable[..., DataFrame] = _jdbc, part_rows: int = 500_000):
        self.spark, self.db, self.reader, self.part_rows = spark, db, reader, part_rows
        if self._catalog(schema_query(db)).isEmpty():
            raise ValueError(f"schema {db.schema} does not exist")
        self._schemas: dict[str, T.StructType] = {}
        self._keys: dict[str, list[str]] = {}

    def _query(self, query: str) -> DataFrame:
        return self.reader(self.spark, options(self.db, query))

    def _catalog(self, query: str) -> DataFrame:
        return self.reader(self.spark, options(self.db, query) | {"queryTimeout": str(CATALOG_SECONDS)})

    def names(self, tables: list[str]) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {t: [] for t in tables}
        for table, column in self._catalog(names_query(self.db)).collect():
            if table in out:
                out[table].append(column)
        return out

    def counts(self, tables: list[str]) -> dict[str, int]:
        out = {}
        for at in range(0, len(tables), 100):
            some = tables[at : at + 100]
            out |= {some[int(r[0])]: int(r[1]) for r in self._query(counts_query(self.db, some)).collect()}
        return out

    def tables(self) -> list[str]:
        return [r[0] for r in self._catalog(tables_query(self.db)).collect() if r[0]]

    def schema(self, table: str) -> T.StructType:
        if table not in self._schemas:
            self._schemas[table] = self._query(f"SELECT * FROM {qualified(self.db, table)} WHERE 1 = 0").schema
        return self._schemas[table]

    def rows(self, table: str) -> int:
        return int(self._query(f"SELECT COUNT(*) AS n FROM {qualified(self.db, table)}").first()[0])

    def split_column(self, table: str) -> str | None:
        """An integer column to read by: the first of the primary key, else the first of the table."""
        whole = {f.name for f in self.schema(table) if isinstance(f.dataType, T.IntegralType) or isinstance(f.dataType, T.DecimalType) and f.dataType.scale == 0}
        keys = self.keys(table) if whole else []
        return next((c for c in [*keys, *self.schema(table).names] if c in whole), None)

    def keys(self, table: str) -> list[str]:
        if table not in self._keys:
            self._keys[table] = [r[0] for r in self._catalog(key_query(self.db, table)).collect()]
        return self._keys[table]

    def bounds(self, table: str, key: str) -> list[object]:
        """Keys that part the table into ranges of ``part_rows`` rows, each found from the one before."""
        out: list[object] = []
        while (r := self._query(next_query(self.db, table, key, out[-1] if out else None, self.part_rows - (1 if out else 0))).first()) is not None:
            out.append(r[0])
        return out

    def conditions(self, table: str, rows: int) -> list[str]:
        """Predicates for a table that has no integer column."""
        kinds = {f.name: f.dataType for f in self.schema(table)}
        key = next((k for k in self.keys(table)[:1] if isinstance(kinds.get(k), (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType))), None)
        if key is not None:
            return ranges(self.db, key, self.bounds(table, key))
        pages = int(self._catalog(pages_query(self.db, table)).first()[0]) if self.db.engine == "postgres" else 0
        return slices(self.db, self.schema(table).names, -(-rows // self.part_rows), pages)

    def whole(self, table: str) -> DataFrame:
        column, name = self.split_column(table), qualified(self.db, table)
        if column:
            c = quoted(self.db, column)
            low, high, n = self._query(f"SELECT MIN({c}) AS low, MAX({c}) AS high, COUNT(*) AS n FROM {name}").first()
            if n > self.part_rows and low is not None:
                return self.reader(self.spark, partitioned(self.db, table, column, int(low), int(high) + 1, -(-int(n) // self.part_rows)))
        elif (n := self.rows(table)) > self.part_rows:
            base = {k: v for k, v in options(self.db, "").items() if k != "query"}
            return self.reader(self.spark, base | {"dbtable": name}, self.conditions(table, n))
        return self._query(f"SELECT * FROM {name}")

    def sample(self, table: str) -> DataFrame:
        return self._query(sample_query(self.db, table, wanted(self.schema(table).names) or self.schema(table).names))


def mongo_options(db: Database, collection: str, sample: bool = False, uri: str = "") -> dict[str, str]:
    """Options of the Mongo connector; a sample is drawn by the server."""
    who = f"{quote(db.user, safe='')}:{quote(db.password, safe='')}@" if db.user else ""
    out = {"connection.uri": uri or f"mongodb://{who}{db.host}:{db.port}", "database": db.database, "collection": collection}
    return out | ({"aggregation.pipeline": json.dumps([{"$sample": {"size": SAMPLE_ROWS}}])} if sample else {})


def _connector(spark: SparkSession, given: dict[str, str]) -> DataFrame:
    return spark.read.format("mongodb").options(**given).load()


def _collections(uri: str, database: str) -> list[str]:
    import pymongo  # optional; needed where collections are not named

    return pymongo.MongoClient(uri)[database].list_collection_names()


class Mongo:
    """The collections of a Mongo database as a source of scans; nested fields are flattened when cells are taken.

    ``collections`` names them, else they are listed. ``uri`` replaces host, port and user.
    """

    def __init__(
        self,
        spark: SparkSession,
        db: Database,
        collections: Iterable[str] | None = None,
        uri: str = "",
        reader: Callable[[SparkSession, dict[str, str]], DataFrame] = _connector,
        lister: Callable[[str, str], list[str]] = _collections,
    ):
        self.spark, self.db, self.uri, self.reader, self.lister = spark, db, uri, reader, lister
        self.named = None if collections is None else list(collections)

    def tables(self) -> list[str]:
        found = self.named if self.named is not None else sorted(self.lister(mongo_options(self.db, "", uri=self.uri)["connection.uri"], self.db.database))
        return [n for n in found if n and not n.startswith("system.")]

    def schema(self, table: str) -> T.StructType:
        return self.whole(table).schema

    def rows(self, table: str) -> int:
        return self.whole(table).count()

    def whole(self, table: str) -> DataFrame:
        return self.reader(self.spark, mongo_options(self.db, table, uri=self.uri))

    def sample(self, table: str) -> DataFrame:
        return self.reader(self.spark, mongo_options(self.db, table, sample=True, uri=self.uri))
