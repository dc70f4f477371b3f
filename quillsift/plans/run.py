"""Scans of the databases that a configuration file or a URI names, with reports in a folder for each.

    python -m quillsift --config /etc/scan --mode deepscan --engine mysql
    python -m quillsift postgres://user@host/shop?sslmode=verify-full

The JDBC driver of the engine must be among Spark's jars (``spark.jars`` in its configuration).

``config.toml`` has a list ``instances`` with ``engine, host, port, user, password, databases`` and, by engine,
``sslmode, sslrootcert, sslcert, sslkey`` (postgres), ``tlsmode`` (mysql), ``encrypt`` (sqlserver), ``uri`` (mongodb),
``redis_dbs``, ``cluster`` and ``partitions`` (redis), and ``client``, the factory of a client (redis; for mongodb in place of
the connector).
"""

from __future__ import annotations

import argparse
import os
import sys
import tomllib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

from quillsift.plans import report
from quillsift.plans.scan import DEFAULT_TIMEOUT, MODES, ScanConfig, scan_targets
from quillsift.sources import databases
from quillsift.sources.documentstore import Documents
from quillsift.sources.keyvalue import KeyValues
from quillsift.sources.source import Source

OFF = ("false", "disable", "disabled", "0", "no")


@dataclass(frozen=True)
class Target:
    engine: str
    host: str
    name: str
    label: str
    open: Callable[[SparkSession], Source]


def arguments(argv: Sequence[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="quillsift", description="Find personal data in databases.")
    p.add_argument("uri", nargs="?", default="", help="a postgres URI, in place of a configuration file")
    p.add_argument("--config", default=".", help="folder of config.toml")
    p.add_argument("--mode", default="", choices=["", *sorted(MODES)], help="empty: by the size of a table")
    for name in ("engine", "host", "database"):
        p.add_argument(f"--{name}", default="", help=f"scan this {name} only")
    p.add_argument("--schema", default="")
    for name in ("include", "exclude"):
        p.add_argument(f"--{name}", default="", help="tables, with commas")
    p.add_argument("--region", default="")
    p.add_argument("--print-all", action="store_true", help="findings of all confidences")
    p.add_argument("--print-summary", action="store_true")
    p.add_argument("--no-timeout", action="store_true", help=f"no limit of {DEFAULT_TIMEOUT:g} seconds a database")
    p.add_argument("--output", default="scan_results", help="folder of the reports")
    return p.parse_args(argv)


def targets(instances: Sequence[dict], schema: str = "") -> Iterator[Target]:
    """The databases of a configuration, in order. An engine that is not known fails when its target is opened."""
    for at in instances:
        given = str(at.get("engine", ""))
        try:
            engine = databases.engine_name(given)
        except ValueError as e:
            def fail(spark: SparkSession, e: ValueError = e) -> Source:
                raise e

            for name in at.get("databases") or [""]:
                yield Target(given, at.get("host", ""), name, f"{at.get('host', '')}_{name}", fail)
            continue
        host, uri = at.get("host", ""), at.get("uri", "")
        port = at.get("port") or databases.ENGINES[engine][0]
        if engine == "redis":
            for n in at.get("redis_dbs") or [0]:
                yield Target(engine, host, f"db{n}", f"{host}_{port}_db{n}", lambda spark, n=n, at=at: KeyValues(spark, at["client"], n, int(at.get("partitions", 1)), bool(at.get("cluster", False))))
            continue
        place = urlsplit(uri).netloc.rpartition("@")[2].replace(":", "_").replace(",", "_") if uri else f"{host}_{port}"
        off = str(at.get({"mysql": "tlsmode", "sqlserver": "encrypt"}.get(engine, ""), "")).lower() in OFF
        ssl = {k: at.get(k, "") for k in ("sslmode", "sslrootcert", "sslcert", "sslkey")} if engine == "postgres" else {"sslmode": "disable" if off else ""}
        for name in at.get("databases", []):
            def open_(spark: SparkSession, at: dict = at, engine: str = engine, name: str = name, uri: str = uri, host: str = host, port: int = port, ssl: dict = ssl) -> Source:
                db = databases.Database(host or "mongodb", name, engine, port, at.get("user", ""), at.get("password", ""), schema if engine in ("postgres", "sqlserver") else "", **ssl)
                if engine == "mongodb":
                    return Documents(spark, at["client"], name) if at.get("client") else databases.Mongo(spark, db, at.get("collections"), uri)
                return databases.Jdbc(spark, db)

            yield Target(engine, host, name, f"{place}_{name}", open_)


def from_uri(uri: str, schema: str = "") -> Target:
    db = databases.from_uri(uri)
    if schema:
        db = replace(db, schema=schema)
    return Target(db.engine, db.host, db.database, db.label, lambda spark: databases.Jdbc(spark, db))


def chosen(found: Sequence[Target], engine: str = "", host: str = "", database: str = "") -> list[Target]:
    """Targets that pass the filters; ValueError if no target has the database asked for."""
    out = [t for t in found if engine in ("", t.engine) and host in ("", t.host) and database in ("", t.name)]
    if database and not out:
        raise ValueError(f"no database {database!r} is configured")
    return out


class Prompt:
    """Asks at the terminal before a large table is read whole: yes, no, or yes to all. Without a terminal nothing is asked."""

    def __init__(self, read: Callable[[str], str] = input, interactive: bool | None = None):
        self.read, self.all = read, not (sys.stdin.isatty() if interactive is None else interactive)

    def __call__(self, table: str, rows: int) -> bool:
        while not self.all:
            answer = self.read(f"Read all {rows:,} rows of {table}? [y]es, [n]o, yes to [a]ll: ").strip().lower()
            if answer in ("y", "n"):
                return answer == "y"
            self.all = answer == "a"
        return True


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None, ask: Callable[[str, int], bool] | None = None) -> int:
    """Scan and write reports; the number of targets that were skipped is the result."""
    a = arguments(argv)
    names = lambda text: tuple(n for n in text.split(",") if n.strip())
    config = ScanConfig(a.mode, names(a.include), names(a.exclude), a.region, print_all=a.print_all, print_summary=a.print_summary, on_large_table=ask or Prompt())
    if a.uri:
        found = [from_uri(a.uri, a.schema)]
    else:
        with open(os.path.join(a.config, "config.toml"), "rb") as f:
            found = list(targets(tomllib.load(f).get("instances", []), a.schema))
    spark = spark or SparkSession.builder.appName("quillsift").getOrCreate()

    def show(t: Target) -> Callable[[str, DataFrame], None]:
        def write(_: str, findings: DataFrame) -> None:
            print(report.summary_text(findings) if config.print_summary else report.text(findings, config.print_all))
            folder = os.path.join(a.output, t.label)
            report.write_logs(findings, folder, config.print_all)
            report.write_html(findings, os.path.join(folder, "report.html"), t.label, config.print_all)

        return write

    skips = 0
    for t in chosen(found, a.engine, a.host, a.database):
        print(f"{t.label} ({t.engine}), {config.title}")
        _, skipped = scan_targets(spark, {t.label: lambda t=t: t.open(spark)}, config, None if a.no_timeout else DEFAULT_TIMEOUT, show(t))
        if skipped:
            skips += 1
            print(f"skipped, {skipped[t.label]}")
    return skips
