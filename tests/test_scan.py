"""Cells, scoring, modes, reports, sources, streaming and the registered queries."""

import datetime
import glob
import os
import tomllib

import pytest
from pyspark.sql import functions as F

from quillsift.operators import cells, score
from quillsift.plans import catalogue, report, run
from quillsift.plans.scan import ScanConfig, plan, scan, scan_targets, spread, with_timeout
from quillsift.sources import databases, files, keyvalue
from quillsift.streaming import live


def test_ignored_columns():
    assert cells.wanted(["id", "user_agent", "created_at", "x_timestamp_y", "issue_date", "start_time", "email_id", "name", "birth_date"]) == ["email_id", "name", "birth_date"]
    assert cells.chosen(["a", "s.b", "c"], exclude=["b"]) == ["a", "c"] and cells.chosen(["a"], include=[" z ", "a"], exclude=["a"]) == ["z"]


def test_cells_by_type(spark):
    row = (1, "  x\r ", "NULL", datetime.date(2024, 5, 6), b"ok", b"\xff", ["a", None, "b"], {"k": "v"}, ("in", 3), 2.5, True)
    df = spark.createDataFrame([row, (2, "", "<nil>", None, None, None, [], {}, None, None, None)], "n int, s string, u string, d date, b binary, bad binary, l array<string>, m map<string,string>, o struct<leaf:string,num:int>, f double, t boolean")
    got = {(r["column"], r["value"]) for r in cells.cells(df, "t").collect()}
    assert got == {("s", "x"), ("d", "2024-05-06"), ("b", "ok"), ("l", "a, b"), ("m.k", "v"), ("o.leaf", "in")}
    assert cells.flattened(df.schema)[-4:] == ["o.leaf", "o.num", "f", "t"]
    assert cells.cells(df.select("n"), "t").count() == 0


def test_only_scanned_columns_are_read(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
    tree = cells.cells(spread(df), "customer")._jdf.queryExecution().executedPlan().toString()
    assert "c_mktsegment" in tree and "c_acctbal" not in tree


def evidence(spark, hits, scanned, names):
    return (
        spark.createDataFrame(hits, "table string, column string, detector string, label string, weight double, matched long, in_context boolean"),
        spark.createDataFrame(scanned, "table string, column string, scanned long"),
        spark.createDataFrame(names, "table string, column string, label string, weight double"),
    )


@pytest.mark.parametrize("name_weight, matched, n, want, band", [(1.0, 1, 10_000, 0.50003, "Medium"), (1.0, 90, 100, 0.77, "High"), (0.5, 5, 100, 0.265, "Low"), (None, 50, 100, 0.3, "Low")])
def test_weight_merge(spark, name_weight, matched, n, want, band):
    parts = evidence(spark, [("t", "c", "regex", "PANNumber", 0.6 * matched, matched, False)], [("t", "c", n)], [("t", "c", "PANNumber", name_weight)] if name_weight else [])
    r = score.findings(*parts).where("detector_type = 'value detector'").first()
    assert abs(r["weight"] - want) < 1e-9 and r["confidence"] == band and (r["matched_count"], r["scanned_count"]) == (matched, n)


def test_density_bounds(spark):
    hits = [("t", f"c{m}", "regex", "Email", float(m), m, False) for m in (29, 30, 31)] + [("t", "two", "regex", "Email", 10.0, 10, False), ("t", "two", "regex", "CreditCard", 10.0, 10, True), ("t", "one", "regex", "Email", 10.0, 10, False), ("t", "ctx", "regex", "Email", 1.0, 1, True)]
    scanned = [("t", c, 100) for c in ("c29", "c30", "c31", "two", "one", "ctx")]
    found = {(r["column"], r["label"]) for r in score.findings(*evidence(spark, hits, scanned, [])).collect()}
    assert found == {("c30", "Email"), ("c31", "Email"), ("two", "Email"), ("two", "CreditCard"), ("ctx", "Email")}


def test_cap_gate_and_winner(spark):
    hits = [("t", "a", "regex", "Phone", 90.0, 90, False), ("t", "b", "regex", "UAN", 80.0, 80, False), ("u", "b", "regex", "UAN", 80.0, 80, False), ("t", "n", "regex", "Email", 50.0, 50, True), ("t", "n", "regex", "Phone", 60.0, 60, False)]
    names = [("t", "n", "Email", 0.5), ("t", "n", "UAN", 1.0), ("t", "m", "EPFMemberID", 1.0)]
    rows = {(r["table"], r["column"], r["label"], r["detector_type"]): r for r in score.findings(*evidence(spark, hits, [(t, c, 100) for t, c in (("t", "a"), ("t", "b"), ("u", "b"), ("t", "n"))], names)).collect()}
    assert rows["t", "a", "Phone", "value detector"]["weight"] == 0.69 and rows["t", "a", "Phone", "value detector"]["confidence"] == "Medium"
    assert ("t", "b", "UAN", "value detector") in rows and ("u", "b", "UAN", "value detector") not in rows
    assert {k[2] for k in rows if k[1] == "n"} == {"UAN", "Phone"}


def test_modes():
    assert plan(ScanConfig(), "t", lambda: 9_999).reads == "all" and plan(ScanConfig(), "t", lambda: 10_000).reads == "sample"
    assert plan(ScanConfig("metascan"), "t", lambda: 1 / 0).reads == "names" and plan(ScanConfig("deepscan"), "t", lambda: 0).reads == "names"
    assert plan(ScanConfig("deepscan", on_large_table=lambda t, n: False), "t", lambda: 100_001).reads == "names" and plan(ScanConfig("deepscan"), "t", lambda: 100_001).reads == "all"
    assert ScanConfig().title == "Auto Scan" and ScanConfig("datascan").title == "Data Scan"
    for bad in ({"mode": "x"}, {"print_all": True, "print_summary": True}, {"mode": "spacyscan"}, {"mode": "deepscan", "ner_only": True}):
        with pytest.raises(ValueError):
            ScanConfig(**bad)
    assert ScanConfig("spacyscan", ner=lambda t: []).print_all


def test_scan_of_documents_in_a_table(spark):
    pad = "p" * 600
    row = (1, '{"cvv":"312"}', '{"x":"' + pad + '","cvv":"312"}', "<r><cvv>312</cvv></r>", "cvv=312&note=abc", f"padding={pad}&cvv=312", "bob@example.com " + "word " * 150 + "bob@example.com")
    df = spark.createDataFrame([row], "id int, a string, b string, c string, d string, e string, f string")
    got = {r["column"]: r for r in scan(spark, {"t": df}).collect()}
    assert all(got[c]["label"] == "CVV" and got[c]["weight"] == 1.0 and got[c]["matched_count"] == 1 and got[c]["context_matched"] for c in "abcde")
    assert (got["f"]["label"], got["f"]["matched_count"], got["f"]["scanned_count"]) == ("Email", 1, 1)


def test_partitions_and_order_do_not_matter(spark):
    df = catalogue.derived(spark, "/root/testdata/sf0.001").drop("c_custkey")
    one = sorted(map(str, scan(spark, {"t": df.coalesce(1)}).withColumn("weight", F.round("weight", 9)).collect()))
    assert one == sorted(map(str, scan(spark, {"t": df.orderBy(F.rand(3)).repartition(7)}).withColumn("weight", F.round("weight", 9)).collect())) and one


def test_empty_table_keeps_its_names(spark):
    rows = scan(spark, {"t": spark.createDataFrame([], "email string, x string")}).collect()
    assert [(r["column"], r["label"], r["scanned_count"]) for r in rows] == [("email", "Email", 0)]
    with pytest.raises(KeyError):
        scan(spark, {}, ScanConfig(include=("gone",)))


def test_targets_and_timeout(spark):
    found, skipped = scan_targets(spark, {"good": lambda: {"t": spark.createDataFrame([("a@b.co",)], "email string")}, "bad": lambda: 1 / 0})
    assert {r["target"] for r in found.collect()} == {"good"} and list(skipped) == ["bad"]
    assert with_timeout(spark, 60, lambda: spark.range(3).count()) == 3
    with pytest.raises(TimeoutError):
        with_timeout(spark, 0.5, lambda: spark.range(4).select(F.udf(lambda x: __import__("time").sleep(5) or x, "long")("id").alias("x")).agg(F.sum("x")).collect())
    with pytest.raises(ZeroDivisionError):
        with_timeout(spark, 60, lambda: 1 / 0)
    assert spark.range(3).count() == 3


def findings(spark):
    return scan(spark, {"users": spark.createDataFrame([(f"u{i}@x.co", "m") for i in range(10)], "email string, `<b>` string")})


def test_reports(spark, tmp_path):
    f = findings(spark).cache()
    assert "10/10" in report.text(f) and "email as Email" in report.summary_text(f)
    assert [os.path.basename(p) for p in report.write_logs(f, str(tmp_path))] == ["high_findings.log"]
    page = report.html_page(f, "<Scan>")
    assert "&lt;Scan&gt;" in page and "100% (10/10)" in page and open(report.write_html(f, str(tmp_path / "r.html"))).read().startswith("<!doctype")
    assert report.counters(f).first()["tables"] == 1 and report.shown(f, True).count() >= report.shown(f).count()
    empty = f.limit(0)
    assert report.write_logs(empty, str(tmp_path / "e")) == [] and "No findings" in report.text(empty)


def test_connections():
    db = databases.from_uri(" PostgreSQL://bob:p%40ss@h:6000/shop?sslmode=verify-full ")
    assert (db.host, db.port, db.database, db.password, db.sslmode) == ("h", 6000, "shop", "p@ss", "verify-full") and "p@ss" not in repr(db)
    assert databases.jdbc_url(db) == "jdbc:postgresql://h:6000/shop?sslmode=verify-full"
    assert databases.keyword_dsn(databases.Database("h", "d", password="a 'b\\")) == r"host=h port=5432 password='a \'b\\' dbname=d sslmode=require"
    for bad in ("postgres://h", "postgres:///d", "mysql://h/d"):
        with pytest.raises(ValueError):
            databases.from_uri(bad)
    with pytest.raises(ValueError):
        databases.Database("h", "d", sslmode="maybe")
    assert databases.engine_name("") == "postgres" and databases.Database("h", "d", "sqlserver").schema == "dbo" and databases.Database("h", "d", "mysql").schema == "d"
    assert databases.sample_query(databases.Database("h", "d", "mysql"), "t`x", ["a"]) == "SELECT `a` FROM `d`.`t``x` ORDER BY RAND(47) LIMIT 10000"
    assert "TABLESAMPLE (10000 ROWS) REPEATABLE (47)" in databases.sample_query(databases.Database("h", "d", "sqlserver"), "t", ["a"])
    assert 'FROM "public"."t" TABLESAMPLE BERNOULLI (10) REPEATABLE (47) LIMIT 10000' in databases.sample_query(databases.Database("h", "d"), "t", ["a"])
    assert databases.partitioned(databases.Database("h", "d"), "t", "k", 0, 9, 3)["numPartitions"] == "3"


@pytest.fixture(scope="module")
def shop(spark):
    """A database in memory with the catalog views of the engines, and a reader of it; ``asked`` holds what was read."""
    url = "jdbc:derby:memory:shop;create=true"
    con = spark._jvm.java.sql.DriverManager.getConnection(url)
    run = con.createStatement().execute
    for text in (
        'CREATE SCHEMA "public"',
        "CREATE SCHEMA information_schema",
        "CREATE TABLE information_schema.schemata (schema_name VARCHAR(20))",
        "CREATE TABLE information_schema.tables (table_name VARCHAR(20), table_schema VARCHAR(20), table_type VARCHAR(20))",
        "CREATE TABLE information_schema.table_constraints (constraint_name VARCHAR(20), table_schema VARCHAR(20), table_name VARCHAR(20), constraint_type VARCHAR(20))",
        "CREATE TABLE information_schema.key_column_usage (constraint_name VARCHAR(20), table_schema VARCHAR(20), table_name VARCHAR(20), column_name VARCHAR(20), ordinal_position INT)",
        "CREATE TABLE information_schema.columns (table_schema VARCHAR(20), table_name VARCHAR(20), column_name VARCHAR(20), ordinal_position INT)",
        'CREATE TABLE "public"."people" ("Mail" VARCHAR(40) NOT NULL, "born" DATE)',
        "INSERT INTO information_schema.columns VALUES ('public', 'users', 'age', 1), ('public', 'users', 'Key', 2), ('public', 'users', 'email', 3), ('public', 'notes', 'text', 1), ('public', 'v', 'w', 1)",
        "INSERT INTO information_schema.table_constraints VALUES ('pk2', 'public', 'people', 'PRIMARY KEY')",
        "INSERT INTO information_schema.key_column_usage VALUES ('pk2', 'public', 'people', 'Mail', 1)",
        'INSERT INTO "public"."people" VALUES ' + ", ".join(f"('o''{i % 10}{i:03d}@x.co', DATE('1990-01-{i % 28 + 1:02d}'))" for i in range(200)),
        'CREATE TABLE "public"."users" ("age" INT, "Key" BIGINT, "email" VARCHAR(40))',
        'CREATE TABLE "public"."notes" ("text" VARCHAR(40))',
        "INSERT INTO information_schema.schemata VALUES 'public'",
        "INSERT INTO information_schema.tables VALUES ('users', 'public', 'BASE TABLE'), ('notes', 'public', 'BASE TABLE'), ('v', 'public', 'VIEW')",
        "INSERT INTO information_schema.table_constraints VALUES ('pk', 'public', 'users', 'PRIMARY KEY')",
        "INSERT INTO information_schema.key_column_usage VALUES ('pk', 'public', 'users', 'Key', 1)",
        "INSERT INTO \"public\".\"notes\" VALUES 'x', 'call me'",
        'INSERT INTO "public"."users" VALUES ' + ", ".join(f"({i % 7}, {i}, 'u{i}@x.co')" for i in range(100)) + ", (1, NULL, 'none@x.co')",
    ):
        run(text)
    asked = []

    def reader(session, given, predicates=None):
        asked.append(given)
        given = {k: v for k, v in given.items() if k not in ("connectTimeout", "loginTimeout")} | {"url": url}
        if predicates is not None:
            return databases._jdbc(session, {k: v for k, v in given.items() if v}, predicates)
        if "query" in given:
            given["query"] = given["query"].replace("TABLESAMPLE BERNOULLI (10) REPEATABLE (47) LIMIT 10000", "FETCH FIRST 10 ROWS ONLY")
        return session.read.format("jdbc").options(**{k: v for k, v in given.items() if v}).load()

    return reader, asked


def test_database_source(spark, shop):
    reader, asked = shop
    db = databases.Jdbc(spark, databases.Database("h", "d"), reader, part_rows=30)
    assert db.tables() == ["notes", "users"] and db.rows("users") == 101 and db.split_column("users") == "Key" and db.split_column("notes") is None
    whole = db.whole("users")
    assert whole.rdd.getNumPartitions() == 4 and whole.count() == 101 and whole.distinct().count() == 101
    assert db.whole("notes").rdd.getNumPartitions() == 1 and db.whole("notes").count() == 2
    assert db.sample("users").columns == ["age", "Key", "email"] and db.sample("users").count() == 10
    shown = lambda f: sorted(map(str, f.withColumn("weight", F.round("weight", 9)).collect()))
    assert shown(scan(spark, db)) == shown(scan(spark, {t: db.whole(t) for t in db.tables()}))
    del asked[:]
    found = scan(spark, db, ScanConfig("datascan", include=("users",))).where("detector_type like '%ata%'").collect()
    assert {r["scanned_count"] for r in found if r["column"] == "email"} <= {10, 0} and any("TABLESAMPLE" in o.get("query", "") for o in asked) and not any("partitionColumn" in o for o in asked)


def test_tables_without_an_integer_column_are_read_in_ranges(spark, shop):
    reader, asked = shop
    db = databases.Jdbc(spark, databases.Database("h", "d"), reader, part_rows=30)
    assert db.split_column("people") is None and len(db.bounds("people", "Mail")) == 6
    whole = db.whole("people")
    assert whole.rdd.getNumPartitions() == 7 and whole.count() == 200 and whole.distinct().count() == 200
    assert max(len(p) for p in whole.select("Mail").rdd.glom().collect()) == 30
    assert databases.Jdbc(spark, databases.Database("h", "d"), reader).whole("people").rdd.getNumPartitions() == 1
    my = databases.Database("h", "d", "mysql")
    assert databases.ranges(my, "k", ["a\\b", "c'd"]) == ["(`k` < 'a\\\\b' OR `k` IS NULL)", "`k` >= 'a\\\\b' AND `k` < 'c''d'", "`k` >= 'c''d'"]
    assert databases.ranges(my, "k", [datetime.date(2024, 1, 2)])[1] == "`k` >= DATE '2024-01-02'" and databases.ranges(my, "k", []) == ["1 = 1"]
    assert databases.next_query(my, "t", "k", None, 9).endswith("`k` IS NOT NULL ORDER BY `k` LIMIT 1 OFFSET 9")
    assert databases.slices(databases.Database("h", "d"), ["a"], 3, 90) == ["ctid < '(30,0)'::tid", "ctid >= '(30,0)'::tid AND ctid < '(60,0)'::tid", "ctid >= '(60,0)'::tid"]
    assert databases.slices(databases.Database("h", "d"), ["a"], 3, 0) == ["1 = 1"]
    assert databases.slices(my, ["a", "b"], 2)[1] == "MOD(CRC32(CONCAT_WS('|', COALESCE(CAST(`a` AS CHAR), ''), COALESCE(CAST(`b` AS CHAR), ''))), 2) = 1"
    assert databases.slices(databases.Database("h", "d", "sqlserver"), ["a"], 2)[0] == "ABS(CAST(BINARY_CHECKSUM(*) AS BIGINT)) % 2 = 0"


def test_the_catalog_is_asked_once(spark, shop):
    reader, asked = shop
    db = databases.Jdbc(spark, databases.Database("h", "d"), reader)
    assert db.names(["users", "notes", "gone"]) == {"users": ["age", "Key", "email"], "notes": ["text"], "gone": []} and db.counts(["notes", "users"]) == {"notes": 2, "users": 101}
    del asked[:]
    found = scan(spark, db, ScanConfig("metascan")).collect()
    assert [(r["table"], r["column"], r["label"]) for r in found] == [("users", "email", "Email")] and len(asked) == 2  # tables and columns
    assert all(o["connectTimeout"] == "10" and o["queryTimeout"] == "60" for o in asked)
    waits = databases.options(databases.Database("h", "d", "mysql"), "q")
    assert waits["connectTimeout"] == "10000" and databases.options(databases.Database("h", "d", "sqlserver"), "q")["loginTimeout"] == "10"


def test_mongo_source(spark):
    asked = []

    def reader(session, given):
        asked.append(given)
        return session.createDataFrame([(("a@b.co",), 1)], "who struct<email: string>, n int")

    db = databases.Mongo(spark, databases.Database("h", "d", "mongodb", user="a", password="p@"), reader=reader, lister=lambda uri, name: ["users", "system.views", "old"])
    assert db.tables() == ["old", "users"] and db.rows("users") == 1
    assert {r["column"] for r in scan(spark, db, ScanConfig("datascan")).collect()} == {"who.email"}
    assert any("$sample" in o.get("aggregation.pipeline", "") for o in asked) and asked[0]["connection.uri"] == "mongodb://a:p%40@h:27017"
    assert databases.Mongo(spark, databases.Database("h", "d", "mongodb"), ["one"], "mongodb://other").tables() == ["one"]


def test_configuration(spark, tmp_path, monkeypatch, capsys, shop):
    (tmp_path / "config.toml").write_text(
        '[[instances]]\nhost = "a"\ndatabases = ["d", "e"]\nsslmode = "disable"\n'
        '[[instances]]\nengine = "mysql"\nhost = "b"\nport = 7\ndatabases = ["d"]\ntlsmode = "false"\n'
        '[[instances]]\nengine = "mongodb"\nuri = "mongodb://me:secret@m:1,n:2/x"\ndatabases = ["d"]\n'
        '[[instances]]\nengine = "oracle"\nhost = "c"\ndatabases = ["d"]\n'
        '[[instances]]\nengine = "redis"\nhost = "r"\nredis_dbs = [0, 3]\nclient = "x.y"\n'
    )
    found = list(run.targets(tomllib.loads((tmp_path / "config.toml").read_text())["instances"]))
    assert [t.label for t in found] == ["a_5432_d", "a_5432_e", "b_7_d", "m_1_n_2_d", "c_d", "r_6379_db0", "r_6379_db3"]
    assert [t.label for t in run.chosen(found, database="d", host="a")] == ["a_5432_d"] and len(run.chosen(found, engine="redis")) == 2
    with pytest.raises(ValueError):
        run.chosen(found, database="gone")
    opened, real = [], databases.Jdbc
    monkeypatch.setattr(databases, "Jdbc", lambda session, db: opened.append(db) or real(session, db, shop[0]))
    out = str(tmp_path / "out")
    assert run.main(["--config", str(tmp_path), "--host", "a", "--database", "d", "--exclude", "notes", "--output", out], spark) == 0
    assert os.path.exists(f"{out}/a_5432_d/report.html") and opened[0].sslmode == "disable" and "email" in capsys.readouterr().out
    assert run.main(["--config", str(tmp_path), "--engine", "oracle", "--output", out], spark) == 1 and "not opened" in capsys.readouterr().out
    assert run.main(["postgres://h/d", "--schema", "public", "--mode", "metascan", "--print-summary", "--no-timeout", "--output", out], spark) == 0


def test_large_tables_are_asked_for():
    answers = iter(["", "maybe", "n", "y", "A"])
    ask = run.Prompt(lambda text: next(answers), interactive=True)
    assert [ask("t", 200_000) for _ in range(4)] == [False, True, True, True] and next(answers, None) is None
    assert run.Prompt(lambda text: 1 / 0, interactive=False)("t", 200_000)


def test_database_without_schema(spark):
    with pytest.raises(ValueError):
        databases.Jdbc(spark, databases.Database("h", "d"), lambda s, o: s.createDataFrame([], "n string"))


class FakeStore:
    data = {"k1": ("string", b"a@b.co"), "k2": ("list", [b"1", b"2"]), "k3": ("hash", {b"f": b"v"}), "k4": ("zset", [(b"m", 1.5)]), "k5": ("set", [b"s"]), "k6": ("stream", [])}

    def scan_iter(self):
        return iter(k.encode() for k in self.data)

    def type(self, key):
        return self.data[key.decode()][0].encode()

    def get(self, key):
        return self.data[key.decode()][1]

    def lrange(self, key, a, b):
        return self.data[key.decode()][1][a : b + 1]

    def sscan(self, key, cursor, count):
        items = self.data[key.decode()][1]
        if isinstance(items, dict):
            return 0, items
        return (cursor + 2 if cursor + 2 < len(items) else 0), items[cursor : cursor + 2]

    hscan = zscan = sscan

    def __init__(self):
        self.draws = iter([b"k1", b"k2", b"k1", None])

    def randomkey(self):
        return next(self.draws, None)


class Cluster(FakeStore):
    """With pipelines and hash slots; ``trips`` counts round trips."""

    trips = 0

    def pipeline(self, transaction):
        store, calls = self, []

        class Pipe:
            def __getattr__(self, name):
                return lambda *a, **k: calls.append((name, a, k))

            def execute(self):
                Cluster.trips += 1
                return [getattr(store, name)(*a, **k) for name, a, k in calls]

        return Pipe()

    def execute_command(self, command, slot, *most):
        mine = [k for i, k in enumerate(self.data) if i * 3000 == slot]
        return len(mine) if command.startswith("CLUSTER COUNT") else mine[: most[0]]


@pytest.mark.parametrize("kind", [FakeStore, Cluster])
def test_key_value_store(kind, monkeypatch):
    client = kind()
    keys = list(map(str.encode, kind.data))
    rows = list(keyvalue.values(client, keys))
    assert rows[0] == (b"k1", "a@b.co") and (b"k4", "1.5") in rows and (b"k3", "f") in rows and len(rows) == 8
    assert keyvalue.random_keys(kind(), 9) == [b"k1", b"k2"]
    monkeypatch.setitem(kind.data, "k2", ("list", [str(i).encode() for i in range(2502)]))
    monkeypatch.setitem(kind.data, "k5", ("set", [str(i).encode() for i in range(7)]))
    assert [v for k, v in keyvalue.values(client, [b"k2", b"k5"])] == [str(i) for i in range(2502)] + [str(i) for i in range(7)]


def test_each_key_is_listed_by_one_task(monkeypatch):
    monkeypatch.setitem(__import__("sys").modules, __name__, __import__("sys").modules[FakeStore.__module__])
    read = keyvalue.KeyReader({"client": f"{__name__}.Cluster", "cluster": "true", "partitions": "4"})
    listed = [[k for k, in read.read(p)] for p in read.partitions()]
    assert len(listed) == 4 and sorted(k for part in listed for k in part) == sorted(map(str.encode, FakeStore.data)) and sum(map(bool, listed)) == 4
    Cluster.trips = 0
    assert len(list(keyvalue.slot_keys(Cluster(), 0, keyvalue.SLOTS))) == 6 and Cluster.trips == 2 * -(-keyvalue.SLOTS // keyvalue.KEYS)
    one = keyvalue.KeyReader({"client": f"{__name__}.FakeStore", "partitions": "4"})
    assert len(one.partitions()) == 1 and len(list(one.read(one.partitions()[0]))) == 6
    draws = keyvalue.KeyReader({"client": f"{__name__}.FakeStore", "partitions": "3", "sample": "10"})
    assert [p.value for p in draws.partitions()] == [("draws", 0, 3), ("draws", 3, 6), ("draws", 6, 10)] and [k for k, in draws.read(draws.partitions()[2])] == [b"k1", b"k2"]


def test_key_values_through_spark(spark, tmp_path):
    """The source as a whole, with a client that a module on the executors' path makes."""
    (tmp_path / "kv_client.py").write_text(
        "class Store:\n"
        "    data = {f'user:{i}:email': f'u{i}@x.co' for i in range(40)}\n"
        "    def scan_iter(self): return iter(self.data)\n"
        "    def type(self, key): return 'string'\n"
        "    def get(self, key): return self.data[key.decode()]\n"
        "    def randomkey(self): import random; return random.choice(list(self.data))\n"
        "    def dbsize(self): return len(self.data)\n"
    )
    spark.sparkContext.addPyFile(str(tmp_path / "kv_client.py"))
    store = keyvalue.KeyValues(spark, "kv_client.Store", 2, 4)
    assert store.cells("db2", False).distinct().count() == 40 and store.keys().count() == 40
    assert {(r["table"], r["label"]) for r in scan(spark, store, ScanConfig("metascan")).collect()} == {("db2", "Email")}
    found = scan(spark, store, ScanConfig("datascan")).where("detector_type = 'value detector' and label = 'Email'")
    assert found.count() == store.sample("db2").select("column").distinct().count() == 40


def test_scan_of_key_values(spark, monkeypatch):
    rows = [("db0", "email:1", "a@b.co"), ("db0", "note", " "), ("db0", "note", "x")]
    store = keyvalue.KeyValues(spark, f"{__name__}.FakeStore")
    monkeypatch.setattr(store, "rows", lambda t: 3)
    monkeypatch.setattr(store, "cells", lambda t, sample: spark.createDataFrame(rows, "table string, column string, value string"))
    assert ("db0", "email:1", "Email") in {(r["table"], r["column"], r["label"]) for r in scan(spark, store).collect()}


def test_files(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/a.parquet")
    spark.range(2).write.option("header", True).csv(f"{tmp_path}/b.csv")
    spark.range(4).write.json(f"{tmp_path}/c.json")
    spark.range(5).write.orc(f"{tmp_path}/d.orc")
    assert {n: df.count() for n, df in files.folder(spark, str(tmp_path)).items()} == {"a": 3, "b": 2, "c": 4, "d": 5}
    with pytest.raises(ValueError):
        files.table(spark, "x.doc")
    spark.range(1).createOrReplaceTempView("one_row")
    assert "one_row" in files.catalog(spark)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"u{i}@x.co", f"call 98765{i:05d}") for i in range(20)]
    df = spark.createDataFrame(rows, "email string, col_1 string").repartition(4)
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    live.start(stream, "t", f"{tmp_path}/store", f"{tmp_path}/check").awaitTermination(120)
    got = live.findings(spark, f"{tmp_path}/store", [("t", "email"), ("t", "col_1")])
    shown = lambda f: sorted(map(str, f.withColumn("weight", F.round("weight", 9)).collect()))
    assert shown(got) == shown(scan(spark, {"t": df}))


def test_state_of_a_stream_stays_small(spark, tmp_path):
    kinds = "email string, note string, m map<string,string>"
    for i in range(12):
        spark.createDataFrame([(f"u{i}{j}@x.co", f"call 98765{i:02d}{j:03d}", {"gender": "male"}) for j in range(5)], kinds).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    assert [r["label"] for r in live.findings(spark, f"{tmp_path}/store", [("t", "email")]).collect()] == ["Email"]  # nothing judged yet
    q = live.start(stream, "t", f"{tmp_path}/store", f"{tmp_path}/check")
    q.awaitTermination(200)
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in map(lambda p: __import__("json").loads(p.json), q.recentProgress) if p["stateOperators"]]
    assert len(sizes) >= 10 and sizes[-1] == sizes[1] and len(glob.glob(f"{tmp_path}/store/batch=*")) == live.KEPT
    got = live.findings(spark, f"{tmp_path}/store", [("t", "email"), ("t", "note"), ("t", "m")])
    shown = lambda f: sorted(map(str, f.withColumn("weight", F.round("weight", 9)).collect()))
    assert shown(got) == shown(scan(spark, {"t": spark.read.schema(kinds).parquet(f"{tmp_path}/in")}))


def test_windowed_stream(spark, tmp_path):
    df = spark.createDataFrame([(datetime.datetime(2024, 1, 1, 0, m), v) for m, v in ((1, "a@b.co"), (5, "x"), (12, "c@d.co"), (50, "z"))], "at timestamp, value string")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    out = live.windowed(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "at", "Email")
    q = out.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["matched"] for r in spark.table("windows").collect()) == [1, 1]


def test_queries_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry

    con = duckdb.connect()
    for p in glob.glob("/root/testdata/sf0.001/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    oracle = catalogue.oracle_sql()
    assert set(oracle) <= set(entry.queries())
    for name in ("scan_cells_unpivot", "meta_scan_columns", "detect_email", "detect_cin", "detect_birthdate", "validate_verhoeff", "validate_ipv6", "pair_detect", "row_merge", "field_winner", "occurrence_groups", "column_winner", "extract_query", "segment_512", "scan_deep_derived", "scan_sample_10pct", "region_filter", "hit_aggregate", "extract_pages_url", "fields_in_sql", "detect_creditcard"):
        df = catalogue.queries()[name](spark, "/root/testdata/sf0.001")
        want = con.execute(oracle[name]).df()
        names = sorted(df.columns)
        assert names == sorted(want.columns)
        norm = lambda rows: sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)
        assert norm(df.select(*names).toPandas().astype(object).values.tolist()) == norm(want[names].astype(object).values.tolist()), name
    assert entry.entry(spark).count() > 0
