"""From tables to cells: which columns are read, how values become text, samples, and the unpivot."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names that are never scanned.
IGNORED = (
    r"(?i)^(created|updated|deleted|committed)[\s_-]?(at|by|on)$",
    r"(?i)^.*timestamp.*$",
    r"(?i)^(created|updated|modified|deleted|committed|inserted|last_modified|expiry|expiration|effective|issue|invoice|payment)_date$",
    r"(?i)_time$",
)
IGNORED_NAMES = frozenset({"user_agent", "id"})

SAMPLE_FRACTION, SAMPLE_ROWS, SAMPLE_SEED = 0.1, 10_000, 47
#: Bins in which a sample is counted.
BINS = 4096

#: White space that trimming removes.
_BLANKS = "\t\n\x0b\x0c\r \x85\xa0                　"


def ignored(name: str) -> bool:
    name = name.lower()
    return name != "email_id" and (name in IGNORED_NAMES or any(re.search(p, name) for p in IGNORED))


def wanted(names: Iterable[str]) -> list[str]:
    """Names that are scanned, in order."""
    return [n for n in names if not ignored(n)]


def _leaf(c: Column, kind: T.DataType, decimals: bool) -> Column | None:
    """A column of a scannable type as text; None for types that are never scanned."""
    if isinstance(kind, T.StringType):  # with char and varchar
        return c.cast("string")
    if isinstance(kind, T.BinaryType):
        return F.try_validate_utf8(c)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(kind, T.DecimalType) and decimals:
        return c.cast("string")
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        kept = F.filter(c, lambda x: x.isNotNull())
        return F.when(F.size(kept) > 0, F.array_join(kept, ", "))
    return None


def leaves(schema: T.StructType, path: tuple[str, ...] = ()) -> Iterable[tuple[tuple[str, ...], T.DataType]]:
    """Path and type of every column that is no struct."""
    for f in schema.fields:
        if isinstance(f.dataType, T.StructType):
            yield from leaves(f.dataType, (*path, f.name))
        else:
            yield (*path, f.name), f.dataType


def flattened(schema: T.StructType) -> list[str]:
    """Dotted names of all leaves, scannable or not."""
    return [".".join(path) for path, _ in leaves(schema)]


def _at(path: tuple[str, ...]) -> Column:
    return F.col(".".join(f"`{p.replace('`', '``')}`" for p in path))


def scannable(df: DataFrame, decimals: bool = True) -> dict[str, Column]:
    """Dotted name -> text expression of every column that is scanned. Numbers and booleans are not; maps are left to :func:`cells`."""
    out = {}
    for path, kind in leaves(df.schema):
        name = ".".join(path)
        text = None if ignored(name) else _leaf(_at(path), kind, decimals)
        if text is not None:
            out[name] = text
    return out


def tidy(value: Column) -> Column:
    """The value without carriage returns and outer white space; null for missing and blank ones."""
    trimmed = F.btrim(F.replace(value, F.lit("\r"), F.lit("")), F.lit(_BLANKS))
    return F.when((value != "") & ~value.isin("NULL", "<nil>") & (trimmed != ""), trimmed)


def texts(df: DataFrame, table: str, decimals: bool = True, longer: int | None = None) -> DataFrame:
    """(table, column, value), one row a cell that is not null, its text not yet :func:`tidy`; only scanned columns are read. With ``longer``
    only texts of more bytes than that: columns that cannot have one are not read."""
    columns = scannable(df, decimals)
    if longer is not None:
        short = (T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType)
        columns = {".".join(path): columns[".".join(path)] for path, kind in leaves(df.schema) if ".".join(path) in columns and not isinstance(kind, short)}
    kept = lambda text: text.isNotNull() if longer is None else F.octet_length(text) > longer
    parts = []
    if columns:
        entries = [F.struct(F.lit(name).alias("column"), text.alias("value")) for name, text in columns.items()]
        parts.append(df.select(F.explode(F.array(*entries)).alias("cell")).select("cell.*"))
    for path, kind in leaves(df.schema):
        if isinstance(kind, T.MapType) and isinstance(kind.valueType, T.StringType) and not ignored(".".join(path)):
            each = df.select(F.explode(_at(path)).alias("k", "v"))
            parts.append(each.select(F.concat(F.lit(".".join(path) + "."), F.col("k").cast("string")).alias("column"), F.col("v").cast("string").alias("value")))
    if not parts:
        return df.sparkSession.createDataFrame([], "table string, column string, value string")
    return reduce(DataFrame.unionByName, parts).where(kept(F.col("value"))).select(F.lit(table).alias("table"), "column", "value")


def cells(df: DataFrame, table: str, decimals: bool = True) -> DataFrame:
    """(table, column, value), one row a cell that is not blank. Only scanned columns are read."""
    return texts(df, table, decimals).select("table", "column", tidy(F.col("value")).alias("value")).where("value is not null")


def draw(df: DataFrame, seed: int = SAMPLE_SEED) -> Column:
    """A number from 0 to 1 for each row, from the MD5 of the seed and the row's scanned cells with their lengths: the same in
    every layout of files and in every engine. Rows whose scanned cells are equal have the same one."""
    texts = [F.concat(F.coalesce(F.length(t).cast("string"), F.lit("")), F.lit(":"), F.coalesce(t, F.lit(""))) for t in scannable(df).values()]
    digest = F.md5(F.concat(F.lit(f"{seed}|"), *texts))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)


def sample(df: DataFrame, fraction: float = SAMPLE_FRACTION, rows: int = SAMPLE_ROWS, seed: int = SAMPLE_SEED) -> DataFrame:
    """A Bernoulli sample by :func:`draw`; of more than ``rows`` rows those with the smallest numbers.

    Where the cut lies is found by counts of rows in bins, so that no task sorts or holds the sample: bins below it are
    taken whole, only the bin with the cut is ordered."""
    if fraction <= 0 or rows <= 0:
        return df.limit(0)
    name = "drawn"
    while name in df.columns:
        name += "_"
    at = F.floor(F.col(name) * (BINS / fraction))
    kept = df.withColumn(name, draw(df, seed)).where(F.col(name) < fraction)
    below = 0
    for b in kept.groupBy(at.alias("bin")).count().orderBy("bin").collect():  # BINS rows at most
        if below + b["count"] > rows:
            cut = kept.where(at == b["bin"]).orderBy(name).limit(rows - below)
            return kept.where(at < b["bin"]).unionByName(cut).drop(name)
        below += b["count"]
    return kept.drop(name)


def counts(cell_rows: DataFrame) -> DataFrame:
    """(table, column, scanned): cells that are not blank."""
    return cell_rows.groupBy("table", "column").agg(F.count("*").alias("scanned"))


def chosen(catalog: Iterable[str], include: Iterable[str] = (), exclude: Iterable[str] = ()) -> list[str]:
    """Tables to scan: the include list replaces the catalog; the exclude list applies to bare names after that."""
    include = [n.strip() for n in include if n.strip()]
    exclude = {n.strip() for n in exclude}
    return [n for n in (include or list(catalog)) if n and n.rpartition(".")[2] not in exclude]
